"""Time the headline queries. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from sieve.operators.spool import release
from sieve.queries import QUERIES
from sieve.session import get_session

HEADLINE = (
    "threshold_sweep", "token_model", "scores", "undersample", "stratified_split", "negative_sampling", "batches",
    "chunks", "graded_corpus", "topic_left_join", "misfits", "balance_profile", "token_lengths", "vocabulary",
    "pair_encoding", "attributions", "background_attributions", "top_words", "topic_result", "explanation_checks",
    "sampled_attributions", "rebuild_text", "latest_verdict", "article_xml", "csv_round_trip", "chunk_files",
    "result_store", "verdict_stream", "topic_linear_models",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session(cores, "sieve-bench")
    QUERIES["threshold_sweep"](spark, sf_dir).collect()  # start the JVM's compilers
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        # Every row and column is computed, nothing is brought to the driver.
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    release(spark)
    spark.stop()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cores": cores,
    }))


if __name__ == "__main__":
    main()

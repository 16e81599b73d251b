"""Session settings."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Settings a running session can take. Everything about cluster size (executors, memory,
# shuffle partitions) stays with whoever submits the job.
RUNTIME_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot join key is split even where that costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows travel to Python in batches of so many bytes at most (and one row), for texts may be long.
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
    # Streaming state on local disk instead of the heap: one row per article adds up.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def apply_defaults(spark: SparkSession) -> SparkSession:
    """Set the runtime options the operators count on."""
    for key, value in RUNTIME_DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def get_session(cores: int | None = None, app: str = "sieve", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the submitted session."""
    cores = cores or os.cpu_count() or 4
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.memory", os.environ.get("SIEVE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
    )
    for key, value in {**RUNTIME_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

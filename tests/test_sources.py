from __future__ import annotations

import gzip
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql.types import StructType

from sieve import schemas
from sieve.operators.spool import children, new_dir, publish
from sieve.sources import batches, files, pubmed, tables

TOPIC = """Topic: CD000001

Title: Invented test for a condition

Objective: To assess the test
 in adults.
Further lines belong to the objective.
"""


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode() if isinstance(text, str) else text)


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_topic_file(spark, tmp_path):
    put(tmp_path / "a" / "topics" / "1", TOPIC)
    topics, rejected = files.read_topics(spark, str(tmp_path))
    expected = " To assess the test  in adults. Further lines belong to the objective."
    assert rows(topics) == [("CD000001", "Invented test for a condition", expected)]
    assert rejected.count() == 0


def test_topic_variants(spark, tmp_path):
    put(tmp_path / "topics" / "many", TOPIC.replace("Objective:", "Objectives:").replace("CD000001", "CD2"))
    put(tmp_path / "topics" / "crlf", TOPIC.replace("\n", "\r\n").replace("CD000001", "CD3"))
    put(tmp_path / "topics" / "late_title", TOPIC.replace("CD000001", "CD4") + "Title: Another\n")
    put(tmp_path / "topics" / "twice", "Topic: CD5\nTitle: x\nObjective: a\nObjective: b Objective: c\n")
    put(tmp_path / "topics" / "no_title", TOPIC.replace("Title:", "Name:"))
    put(tmp_path / "topics" / "no_objective", "Topic: CD7\nTitle: x\n")
    put(tmp_path / "topics" / "no_topic", "Title: x\nObjective: y\n")
    put(tmp_path / "elsewhere" / "1", TOPIC)
    topics, rejected = files.read_topics(spark, str(tmp_path))
    objective = " To assess the test  in adults. Further lines belong to the objective."
    title = "Invented test for a condition"
    assert rows(topics, "topic_id") == [
        ("CD2", title, objective),
        ("CD3", title, objective),
        ("CD4", "Another", objective + " Title: Another"),
        ("CD5", "x", " b  c"),
    ]
    reasons = {os.path.basename(r["path"]): r["reason"] for r in rejected.collect()}
    assert reasons == {"no_title": "no title", "no_objective": "no objective", "no_topic": "no topic"}


def test_scan_with_suffixes(spark, tmp_path):
    for name in ("x.qrels", "y.2019qrels", "z.txt", "sub/w.qrels"):
        put(tmp_path / name, "content of " + name)
    found = files.scan_files(spark, str(tmp_path), suffixes=["qrels", ".csv"])
    assert sorted(r["content"] for r in found.collect()) == [
        "content of sub/w.qrels", "content of x.qrels", "content of y.2019qrels",
    ]
    assert files.scan_files(spark, str(tmp_path)).count() == 4


def test_judgments(spark, tmp_path):
    put(tmp_path / "qrels" / "f", "CD000001  0  11111  1\nCD000001\t0 22222 0\n\nCD000002 0 33333 2\nbad line\na b x 1\n")
    put(tmp_path / "topics" / "f", "CD000009 0 1 1\n")
    judgments, rejected = files.read_judgments(spark, str(tmp_path))
    assert rows(judgments, "pid") == [("CD000001", "11111", 1), ("CD000001", "22222", 0), ("CD000002", "33333", 2)]
    assert rows(rejected, "value") == [("a b x 1",), ("bad line",)]
    assert rows(files.judged_ids(judgments), "pid")[0] == ("CD000001", "11111")


def article(pid, title=None, abstract=()):
    t = "" if title is None else f"<ArticleTitle>{title}</ArticleTitle>"
    a = "".join(f"<AbstractText Label='L'>{x}</AbstractText>" for x in abstract)
    a = f"<Abstract>{a}</Abstract>" if abstract else ""
    return (
        f'<PubmedArticle><MedlineCitation><PMID Version="1">{pid}</PMID><Article>{t}{a}</Article>'
        f"<CommentsCorrectionsList><CommentsCorrections><PMID>999</PMID></CommentsCorrections></CommentsCorrectionsList>"
        "</MedlineCitation></PubmedArticle>\n"
    )


def articles(*records):
    return "<?xml version='1.0'?>\n<PubmedArticleSet>\n" + "".join(records) + "</PubmedArticleSet>\n"


CASES = {
    "1": ("T <i>it</i> tail", ["A"]),
    "2": ("<i>lead</i> x", ["  padded \n"]),
    "3": ("a &amp; b &lt; c", ["first", "second"]),
    "4": (None, []),
    "5": ("", ["x <b>y</b>"]),
}


def test_article_xml(spark, tmp_path):
    xml = articles(*[article(k, *v) for k, v in CASES.items()])
    put(tmp_path / "pubmed25n0001.xml.gz", gzip.compress(xml.encode()))
    put(tmp_path / "pubmed25n0002.xml.gz", gzip.compress(articles(article("6", "other", ["z"])).encode()))
    compat = rows(pubmed.sweep(spark, str(tmp_path), compat=True)[0], "pid")
    assert compat == [
        ("1", "T ", "A"), ("2", None, "  padded \n"), ("3", "a & b < c", "first"), ("4", None, None),
        ("5", None, "x "), ("6", "other", "z"),
    ]
    stripped = rows(pubmed.sweep(spark, str(tmp_path), compat=True, stripped=True)[0], "pid")
    assert [r[1:] for r in stripped][:2] == [("T", "A"), (None, "padded")]
    whole = rows(pubmed.sweep(spark, str(tmp_path))[0], "pid")
    assert [r[1] for r in whole] == ["T it tail", "lead x", "a & b < c", None, None, "other"]
    assert whole[4][2] == "x y" and whole[2][2] == "first second"
    assert pubmed.sweep(spark, str(tmp_path))[1].count() == 0


def test_broken_records_take_no_others_along(spark, tmp_path):
    broken = article("2", "t2", ["b"]).replace("</PubmedArticle>", "</PubmedArticl>")
    inner = article("4", "t4", ["d"]).replace("</ArticleTitle>", "</Title>")
    xml = articles(article("1", "t1", ["a"]), broken, article("3", "t3", ["c"]), inner, article("5", "t5", ["e" * 50_000]))
    put(tmp_path / "batch.xml", xml)
    found, rejected = pubmed.read_articles(spark, str(tmp_path / "batch.xml"))
    assert sorted(r["pid"] for r in found.collect()) == ["1", "3", "5"]
    got = {r["reason"]: r for r in rejected.collect()}
    assert set(got) == {"record without end", "record does not parse"}
    assert "t2" in got["record without end"]["content"] and "t4" in got["record does not parse"]["content"]
    assert all(r["file"].endswith("batch.xml") for r in got.values())


def test_drawn_shards_are_read(spark, tmp_path):
    for i in range(6):
        put(tmp_path / f"pubmed25n000{i}.xml.gz", gzip.compress(articles(article(str(i), "t", ["a"])).encode()))
    names = pubmed.shards(spark, 0, 5).filter("shard in (2, 4)")
    found, rejected = pubmed.read_shards(spark, str(tmp_path), names)
    assert sorted(r["pid"] for r in found.collect()) == ["2", "4"] and rejected.count() == 0


def test_plain_xml_and_flat_records(spark, tmp_path):
    flat = "<Set><PubmedArticle><PMID>7</PMID><Article><ArticleTitle>t</ArticleTitle></Article></PubmedArticle></Set>"
    put(tmp_path / "batch.xml", flat)
    assert rows(pubmed.read_articles(spark, str(tmp_path / "batch.xml"))[0]) == [("7", "t", None)]


def test_truncated_gzip_keeps_what_came_before(spark, tmp_path):
    import random

    noise = random.Random(1)
    word = lambda: "".join(noise.choices("abcdefghij", k=8))
    records = [article(str(i), f"title {i}", [" ".join(word() for _ in range(200))]) for i in range(400)]
    whole = gzip.compress(articles(*records).encode())
    put(tmp_path / "pubmed25n0001.xml.gz", whole[: len(whole) // 2])
    put(tmp_path / "pubmed25n0002.xml.gz", gzip.compress(articles(article("x1", "t", ["a"])).encode()))
    read, rejected = pubmed.sweep(spark, str(tmp_path))
    found = {r["pid"] for r in read.collect()}
    broken = [r["file"] for r in rejected.filter("reason = 'file breaks off'").collect()]
    assert len(broken) == 1 and broken[0].endswith("0001.xml.gz")
    assert "x1" in found
    kept = {p for p in found if p != "x1"}
    assert 50 < len(kept) < 400
    assert kept == {str(i) for i in range(len(kept))}


def test_shard_names(spark):
    names = pubmed.shards(spark)
    assert names.count() == 1274
    assert rows(names, "shard")[0] == (1, "pubmed25n0001.xml.gz")
    assert rows(names, "shard")[-1] == (1274, "pubmed25n1274.xml.gz")


def test_csv(spark, tmp_path):
    text = (
        'PMID,ArticleTitle,Abstract\n1,"a, b","says ""no""\nnext line"\n2,NA,\n3,N/A,nan\n'
        '4,"  spaced  ",x\\y\n'
    )
    put(tmp_path / "in.csv", text)
    got = rows(tables.read_csv(spark, str(tmp_path / "in.csv"), schemas.ARTICLES_CSV), "PMID")
    assert got == [("1", "a, b", 'says "no"\nnext line'), ("2", None, None), ("3", None, None), ("4", "  spaced  ", "x\\y")]
    back = spark.createDataFrame(got, schemas.ARTICLES_CSV)
    tables.write_csv(back, str(tmp_path / "out"))
    assert rows(tables.read_csv(spark, str(tmp_path / "out"), schemas.ARTICLES_CSV), "PMID") == got


def test_csv_rejects(spark, tmp_path):
    put(tmp_path / "in.csv", "topic_id,PID,relevance,title,abstract\nt,1,1,a,b\nt,2,many,a,b\n")
    assert tables.read_csv(spark, str(tmp_path / "in.csv"), schemas.GRADED_CSV).count() == 2
    bad = rows(tables.rejected_csv(spark, str(tmp_path / "in.csv"), schemas.GRADED_CSV))
    assert bad == [("t,2,many,a,b",)]


def test_csv_shards(spark, tmp_path):
    put(tmp_path / "chunk_0.csv", "PID,title,abstract\n1,a,b\n")
    put(tmp_path / "chunk_1.csv", "PID,title,abstract\n2,c,d\n")
    put(tmp_path / "other.csv", "PID,title,abstract\n3,e,f\n")
    got = rows(tables.read_csv(spark, str(tmp_path / "chunk*.csv"), schemas.CHUNK_CSV), "PID")
    assert got == [("1", "a", "b"), ("2", "c", "d")]


def test_result_runs(spark):
    store = new_dir(spark, "store")
    fields = StructType.fromDDL("pid string, position int")
    make = lambda *r: spark.createDataFrame(r, "topic_id string, pid string, position int")
    tables.append_results(make(("CD01", "a", 0), ("CD012010", "b", 0)), store)
    tables.append_results(make(("CD01", "c", 0)), store)
    tables.append_results(make(("CD01", "d", 0), ("CD2", "e", 0)), store)
    one = tables.read_results(spark, store, fields, "CD01").select("run_id", "pid")
    assert rows(one, "run_id") == [(0, "a"), (1, "c"), (2, "d")]
    assert tables.read_results(spark, store, fields, "CD01", prefix=True).count() == 4
    assert rows(tables.topic_catalogue(spark, store, fields), "topic_id") == [("CD01",), ("CD012010",), ("CD2",)]
    assert tables.read_results(spark, store, fields, "CD2").select("run_id").first()[0] == 0


def test_damaged_result_file_is_skipped(spark):
    store = new_dir(spark, "store")
    fields = StructType.fromDDL("pid string")
    tables.append_results(spark.createDataFrame([("t", "a")], "topic_id string, pid string"), store)
    (folder,) = [p for p in children(spark, store) if "append=" in p]
    with open(f"{folder.removeprefix('file:')}/topic_id=t/damaged.parquet", "wb") as f:
        f.write(b"not a table")
    assert rows(tables.read_results(spark, store, fields, "t").select("pid")) == [("a",)]


def test_empty_catalogue(spark):
    store = new_dir(spark, "store")
    spark.createDataFrame([], "topic_id string, run_id int, pid string").write.parquet(store)
    with pytest.raises(LookupError):
        tables.topic_catalogue(spark, store, StructType.fromDDL("pid string"))


def test_two_writers_and_one_that_breaks_off(spark):
    store = new_dir(spark, "writers")
    fields = StructType.fromDDL("pid string")
    make = lambda who: spark.createDataFrame([(t, f"{who}-{t}") for t in ("t", "u", who)] + [(None, who)], "topic_id string, pid string")
    with ThreadPoolExecutor(4) as pool:
        commits = list(pool.map(lambda who: tables.append_results(make(who), store), ["a", "b", "c", "d"]))
    assert sorted(commits) == [0, 1, 2, 3]
    got = [(r["run_id"], r["pid"]) for r in tables.read_results(spark, store, fields, "t").collect()]
    assert sorted(n for n, _ in got) == [0, 1, 2, 3] and {p for _, p in got} == {f"{w}-t" for w in "abcd"}
    assert all(tables.read_results(spark, store, fields, w).first()["run_id"] == 0 for w in "abcd")
    # One that breaks off before its commit: rows are there, and even run numbers, but nobody sees them.
    make("lost").write.partitionBy("topic_id").parquet(f"{store}/append=lost")
    spark.createDataFrame([("t", 4)], "topic_id string, run_id int").write.parquet(f"{store}/_commits/runs-lost")
    assert tables.read_results(spark, store, fields, "t").count() == 4
    assert "lost" not in {r[0] for r in tables.topic_catalogue(spark, store, fields).collect()}
    assert tables.append_results(make("e"), store) == 4
    assert tables.read_results(spark, store, fields, "t").agg({"run_id": "max"}).first()[0] == 4


def test_a_published_file_is_there_once(spark):
    path = f"{new_dir(spark, 'claims')}/x"
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: publish(spark, path, f"writer {i}"), range(8)))
    assert sum(won) == 1 and spark.read.text(path).first()[0] == f"writer {won.index(True)}"
    assert [p.rsplit("/", 1)[1] for p in children(spark, path.rsplit("/", 1)[0])] == ["x"]


def test_batches_are_read_from_their_own_files(spark):
    path = new_dir(spark, "export")
    data = [(t, f"p{i:03d}", i // 4, i % 4) for t, n in (("007", 90), ("7", 10), (None, 5)) for i in range(n)]
    df = spark.createDataFrame(data, "topic_id string, pid string, batch_id bigint, row_in_batch bigint").repartition(5)
    batches.write_batches(df, path, per_file=5)
    for topic, n in (("007", 90), ("7", 10), (None, 5)):
        for batch in range(-(-n // 4)):
            out = batches.read_batch(spark, path, batch, topic_id=topic)
            assert [(r["topic_id"], r["pid"]) for r in out.collect()] == [(topic, f"p{i:03d}") for i in range(batch * 4, min(n, batch * 4 + 4))]
            assert len(out.inputFiles()) == 1
        rest = batches.read_from(spark, path, 1, topic_id=topic)
        assert {r["pid"] for r in rest.collect()} == {f"p{i:03d}" for i in range(4, n)}
    scan = batches.read_from(spark, path, 17, topic_id="007")._jdf.queryExecution().executedPlan().toString()
    assert "file_no" in scan.split("PartitionFilters")[1].split("]")[0]
    index = batches.batch_index(spark, path).collect()
    assert sum(r["n_rows"] for r in index) == len(data) and all(r["n_rows"] <= 4 for r in index)
    with pytest.raises(LookupError):
        batches.read_batch(spark, path, 99, topic_id="7")
    with pytest.raises(FileExistsError):
        batches.write_batches(df, path)
    df.write.parquet(f"{path}-half/rows")  # broken off
    with pytest.raises(FileNotFoundError):
        batches.read_batch(spark, f"{path}-half", 0, topic_id="7")

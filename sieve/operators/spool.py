"""Intermediate tables on shared storage.

A spooled table is computed once, survives the loss of executors, and has a known size on
disk, which is what decides whether it may be broadcast.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_dirs: dict[str, str] = {}


@dataclass(frozen=True)
class Spooled:
    df: DataFrame
    path: str
    bytes: int


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, with one subfolder per application.

    Only a local session without that setting gets a temporary folder of its own.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = context.applicationId
        if app not in _local_dirs:
            _local_dirs[app] = tempfile.mkdtemp(prefix="sieve-")
        root = _local_dirs[app]
    return f"{root.rstrip('/')}/sieve-{context.applicationId}"


def new_dir(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _file_system(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


def stored_bytes(spark: SparkSession, path: str) -> int:
    jpath, fs = _file_system(spark, path)
    return fs.getContentSummary(jpath).getLength()


def path_exists(spark: SparkSession, path: str) -> bool:
    jpath, fs = _file_system(spark, path)
    return fs.exists(jpath)


def children(spark: SparkSession, path: str) -> list[str]:
    """Paths of what lies in a folder; a folder that is not there has none."""
    jpath, fs = _file_system(spark, path)
    return [str(s.getPath()) for s in fs.listStatus(jpath)] if fs.exists(jpath) else []


def delete(spark: SparkSession, path: str) -> None:
    jpath, fs = _file_system(spark, path)
    fs.delete(jpath, True)


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with ``text``, whole and at once; False where there is one already, whoever else tries."""
    jpath, fs = _file_system(spark, path)
    draft, _ = _file_system(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(draft, False)
    stream.write(text.encode())
    stream.close()
    try:
        if jpath.toUri().getScheme() in (None, "file") and fs.getScheme() == "file":
            os.link(draft.toUri().getPath(), jpath.toUri().getPath())  # fails where the name is taken; a rename would replace
            return True
        jvm = spark._jvm
        none = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = none
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(jpath.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, jpath, options)
        return True
    except FileExistsError:
        return False
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in str(e.java_exception.getClass().getName()):
            return False
        raise
    finally:
        fs.delete(draft, False)


def spool(df: DataFrame, name: str = "table", compression: str | None = None) -> Spooled:
    """Write ``df`` as Parquet into the shared folder and read it back; ``zstd`` suits whole texts."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.parquet(path, compression=compression)
    return Spooled(spark.read.schema(df.schema).parquet(path), path, stored_bytes(spark, path))


def release(spark: SparkSession) -> None:
    """Delete what this application has spooled. Call it when no result is read any more."""
    delete(spark, shared_dir(spark))


def broadcast_limit(spark: SparkSession) -> int:
    """``spark.sql.autoBroadcastJoinThreshold`` in bytes."""
    text = spark.conf.get("spark.sql.autoBroadcastJoinThreshold").strip().lower()
    units = {"k": 2**10, "m": 2**20, "g": 2**30}
    text = text.removesuffix("b")
    return int(text[:-1]) * units[text[-1]] if text and text[-1] in units else int(text)


def planned_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate, the one its own choice of a broadcast rests on."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


# A key is hot when it holds more than 1/HOT_SHARE of the weight, so there are at most
# HOT_SHARE hot keys whatever the data; each is spread over SALTS tasks.
HOT_SHARE = 1000
SALTS = 64


def lookup(
    rows: DataFrame,
    dim: DataFrame | Spooled,
    on: list[str],
    how: str = "left",
    spread: str = "pid",
    weight: str | None = None,
    null_safe: bool = False,
) -> DataFrame:
    """Join ``rows`` to ``dim``, which has one row per ``on`` key, whatever the skew of ``rows``.

    A dim within the broadcast limit goes to the rows and nothing is shuffled; one that is not
    known to be that small is spooled to find out. A larger one is joined by shuffle with the hot
    keys salted by ``spread``: the keys with much ``weight`` if that column is named, else all
    keys (per-topic tables, which stay far smaller than the rows).
    """
    limit = broadcast_limit(rows.sparkSession)
    columns = (dim.df if isinstance(dim, Spooled) else dim).columns
    columns = [*rows.columns, *[c for c in columns if c not in on]]

    def joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
        if not null_safe:
            return left.join(right, keys, how).select(*columns)
        for k in keys:
            right = right.withColumnRenamed(k, f"_same_{k}")
        same = [F.col(k).eqNullSafe(F.col(f"_same_{k}")) for k in keys]
        return left.join(right, reduce(lambda a, b: a & b, same), how).select(*columns)

    if not isinstance(dim, Spooled):
        if planned_bytes(dim) <= limit:
            return joined(rows, dim, on)
        dim = spool(dim, "dim")
    if dim.bytes <= limit:
        return joined(rows, F.broadcast(dim.df), on)

    salt = F.pmod(F.xxhash64(F.col(spread)), F.lit(SALTS)).cast("int")
    copies = F.sequence(F.lit(0), F.lit(SALTS - 1))
    if weight is None:
        salted_rows = rows.withColumn("_salt", salt)
        salted_dim = dim.df.withColumn("_salt", F.explode(copies))
    else:
        total = dim.df.agg(F.sum(weight)).first()[0] or 0
        is_hot = F.col(weight) * HOT_SHARE > total
        hot = dim.df.filter(is_hot).select(*[F.col(k).alias(f"_hot_{k}") for k in on], F.lit(True).alias("_hot"))
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in on])
        # Where null matches nothing, rows with a null key may lie anywhere.
        anywhere = F.lit(False) if null_safe else reduce(lambda a, b: a | b, [F.col(k).isNull() for k in on])
        salted_rows = (
            rows.join(F.broadcast(hot), same, "left")  # < HOT_SHARE rows
            .withColumn("_salt", F.when(F.col("_hot") | anywhere, salt).otherwise(0))
            .select(*rows.columns, "_salt")
        )
        salted_dim = dim.df.withColumn("_salt", F.explode(F.when(is_hot, copies).otherwise(F.array(F.lit(0)))))
    return joined(salted_rows, salted_dim, [*on, "_salt"])

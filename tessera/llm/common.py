"""What several operators share: the shared folder, written tables, connected components."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import clean_shuffles, setting

#: A word: a maximal run of bytes other than ASCII white space. ``bytes.split()`` cuts at exactly these.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) a temporary one is made; on a cluster
    that is an error, as executors would not see each other's files.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tessera-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    if path.startswith("file:/") and "://" not in path:  # as Java writes it
        path = "file://" + path.removeprefix("file:")
    return path if "://" in path else "file://" + os.path.abspath(path)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Bytes of an Arrow batch while an operator writes a table: texts are long, and batches are held several times over.
BATCH_BYTES = 8 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession):
    """Plans made within send batches of at most BATCH_BYTES to Python; the session's setting comes back."""
    return setting(spark, _BATCH_KEY, str(BATCH_BYTES))


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with small_batches(spark), clean_shuffles(spark):
        df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(df: DataFrame) -> None:
    """Deletes a written table that nothing reads any more."""
    delete(df.sparkSession, df.shared_path)


def partitions_for(spark: SparkSession, least: int = 1) -> int:
    """The session's shuffle partitions; the driver of a large job sizes these to its data."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def release_memory() -> None:
    """Gives what a finished task held back to the system: Python workers live on and serve other stages."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def open_fs(path: str):
    """(file system, path) of a URI: local, hdfs, s3, ... by pyarrow; usable on the executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)



#: Ids (8 bytes each) up to which a set of them is broadcast; beyond, both sides are shuffled.
BROADCAST_IDS = 1_000_000


def row_key(df: DataFrame) -> Column:
    """A hash of a row's id and text: tells rows apart that have no id or share one."""
    return F.xxhash64(df["doc_id"], df["text"])


def filter_by_ids(df: DataFrame, ids: DataFrame, key: str | Column, how: str) -> DataFrame:
    """``df`` with (left_semi) or without (left_anti) the rows whose ``key`` is in the one column of ``ids``.

    The ids are written and counted first: few are broadcast, so that texts are not shuffled; many are not. What computes
    them runs once, and its plan is no part of the result's.
    """
    ids = written(ids.toDF("_id").where("_id is not null").distinct(), "ids")
    few = ids.count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, (df[key] if isinstance(key, str) else key) == ids["_id"], how)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows ``(node, component)`` for every node of ``edges(a, b)`` (long); component: its smallest node.

    Alternating large-star and small-star contraction. Minima are partial aggregates and come back by
    equi-joins that adaptive execution may split, so that a hub with very many links is no hot task.
    Every round is a written table. Self links and repeated links are harmless; nulls are dropped.
    Raises if ``max_rounds`` rounds don't suffice, rather than return a wrong answer.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = written(e, "links")

    def sign(df: DataFrame) -> tuple:
        r = df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        return tuple(r)

    before = sign(e)
    if not before[0]:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = written(large.distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        old, e = e, written(small, "small")
        discard(large)
        discard(old)
        after = sign(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("connected_components: not settled; raise max_rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)

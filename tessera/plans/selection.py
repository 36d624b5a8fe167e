"""Draws, pools, chunks and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import batching, sampling
from tessera.session import load

from .registry import query

ORDER = "md5(CAST({0} AS VARCHAR) || ':{1}'), {0}"


def order(c: str, seed: int) -> str:
    return ORDER.format(c, seed)


@query(f"WITH a AS (SELECT doc_id FROM documents ORDER BY {order('doc_id', 1)} LIMIT 100), b AS (SELECT doc_id FROM a ORDER BY {order('doc_id', 2)} LIMIT 30) SELECT doc_id, doc_id IN (SELECT doc_id FROM b) AS inner_draw FROM a")
def nested_sample(spark, d):
    """A draw within a draw."""
    a = sampling.draw(load(spark, d, "documents").select("doc_id"), "doc_id", 100, 1)
    b = sampling.draw(a, "doc_id", 30, 2).select(F.col("doc_id").alias("b"))
    return a.join(b, F.col("doc_id") == F.col("b"), "left").select("doc_id", F.col("b").isNotNull().alias("inner_draw"))


@query(f"WITH r AS (SELECT * FROM labels WHERE quality = 0), n AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {order('doc_id', 3)}) AS rn FROM labels WHERE quality = 1) WHERE rn <= 3 * (SELECT count(*) FROM r)) SELECT doc_id, quality FROM r UNION ALL SELECT doc_id, quality FROM n")
def neg_subsample(spark, d):
    """All of the rare class, three times as many of the other."""
    return sampling.with_ratio(load(spark, d, "labels"), F.col("quality") == 0, "doc_id", 3, 3).select("doc_id", "quality")


@query(f"SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {order('vec_id', 4)}) AS rn FROM embeddings) WHERE rn <= 7")
def balanced_sample(spark, d):
    return sampling.draw_per_class(load(spark, d, "embeddings").select("vec_id", "label"), "label", "vec_id", 7, 4)


@query(
    f"""
WITH p AS (SELECT doc_id, 'positive' AS pool, 0 AS k FROM labels WHERE toxic = 1)
, w AS (SELECT doc_id, 'whole' AS pool, 1 AS k FROM labels ORDER BY {order('doc_id', 5)} LIMIT 40)
, h AS (SELECT doc_id, 'hard' AS pool, 2 AS k FROM labels WHERE quality = 0 ORDER BY {order('doc_id', 5)} LIMIT 10)
, u AS (SELECT * FROM p UNION ALL SELECT * FROM w UNION ALL SELECT * FROM h)
SELECT doc_id, pool FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS rn FROM u) WHERE rn = 1
"""
)
def pool_union(spark, d):
    """Capped pools; a row in several stays in the first."""
    x = load(spark, d, "labels")
    one = lambda df: df.select("doc_id")
    return sampling.pools([("positive", one(x.where("toxic = 1")), None), ("whole", one(x), 40), ("hard", one(x.where("quality = 0")), 10)], "doc_id", 5).select("doc_id", "pool")


@query("WITH x AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rn, count(*) OVER () AS n FROM documents) SELECT doc_id, CAST(floor(rn / CAST(ceil(n / 7.0) AS BIGINT)) AS INT) AS chunk FROM x")
def chunk_shards(spark, d):
    return sampling.chunks(load(spark, d, "documents").select("doc_id"), ["doc_id"], 7).select("doc_id", "chunk")


BATCHES = f"""
WITH l AS (SELECT doc_id AS id, n_chars AS length FROM documents)
, r AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY {order('id', 6)}) - 1) / 32) AS BIGINT) AS megabatch FROM l)
, p AS (SELECT *, CAST(row_number() OVER (PARTITION BY megabatch ORDER BY length DESC, id) - 1 AS INT) AS place FROM r)
"""


@query(BATCHES + "SELECT id, length, megabatch, place FROM p")
def length_batches(spark, d):
    x = load(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("length"))
    return batching.megabatches(x, "id", "length", 32, 6).select("id", "length", "megabatch", "place")


@query()
def even_chunks(spark, d):
    return batching.even_chunks(load(spark, d, "documents"), "doc_id", "n_chars", 8, 4, 6)


@query()
def modality_batches(spark, d):
    x = load(spark, d, "documents").withColumn("len", F.when(F.col("doc_id") % 3 == 0, -F.col("n_chars")).otherwise(F.col("n_chars")))
    return batching.modality_batches(x, "doc_id", "len", 8, 4, 6)

"""Operator 5, maximum inner product search by score-aware (anisotropic) quantisation.

Vectors are cut into subspaces of ``SUB`` dimensions with 16 centroids each, so a code takes four bits a
subspace. Codes and centroids minimise a loss in which the part of the residual that is parallel to the
vector counts more than the rest, as that part is what disturbs large inner products. A search builds a
table of query-centroid products, scans the codes of a block with it (two subspaces a lookup) and ranks
the best ``RERANK`` of each block exactly, in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SUB, CENTROIDS = 2, 16
#: Parallel errors weigh (d - 1) * t**2 / (1 - t**2) times the orthogonal ones.
THRESHOLD = 0.2
#: Vectors the centroids are fitted on: those of the smallest id hashes, at most so many.
SAMPLE, ROUNDS, SEED = 16_384, 12, 7
#: Vectors and queries of one search task; candidates of a block that are ranked exactly.
BLOCK, QUERIES, RERANK = 16_384, 4_096, 300


def weight(dim: int, t: float = THRESHOLD) -> float:
    return max(1.0, (dim - 1) * t * t / (1 - t * t))


def encode(x: np.ndarray, books: np.ndarray, g: float, rounds: int = 3) -> np.ndarray:
    """Codes (n, subspaces) by coordinate descent on the anisotropic loss, from the nearest centroids."""
    n, m = len(x), len(books)
    parts = x.reshape(n, m, -1)
    norm = np.maximum((x**2).sum(axis=1), 1e-30)
    dist = ((parts[:, :, None, :] - books[None]) ** 2).sum(axis=3)  # |r|^2 by subspace and centroid
    dots = (parts**2).sum(axis=2)[:, :, None] - np.einsum("nmd,mkd->nmk", parts, books)  # <r, x>
    codes = dist.argmin(axis=2)
    rows = np.arange(n)
    total = np.take_along_axis(dots, codes[:, :, None], 2)[:, :, 0].sum(axis=1)
    for _ in range(rounds):
        before = codes.copy()
        for j in range(m):
            rest = total - dots[rows, j, codes[:, j]]
            loss = dist[:, j] + (g - 1) * (rest[:, None] + dots[:, j]) ** 2 / norm[:, None]
            codes[:, j] = loss.argmin(axis=1)
            total = rest + dots[rows, j, codes[:, j]]
        if (codes == before).all():
            break
    return codes.astype(np.uint8)


def fit(x: np.ndarray, g: float, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Centroids (subspaces, 16, SUB): k-means starts, then codes and centroids in turn under the same loss."""
    rng = np.random.default_rng(seed)
    n, m = len(x), x.shape[1] // SUB
    parts = x.reshape(n, m, SUB)
    pick = np.stack([rng.choice(n, size=CENTROIDS, replace=n < CENTROIDS) for _ in range(m)])
    books = np.stack([parts[pick[j], j] for j in range(m)]).astype(np.float64)
    norm = np.maximum((x**2).sum(axis=1), 1e-30)
    for i in range(rounds):
        codes = encode(x, books, 1.0 if i < rounds // 2 else g, rounds=1)
        h = 0.0 if i < rounds // 2 else (g - 1)
        r = parts - books[np.arange(m)[None, :], codes]
        total = (r * parts).sum(axis=(1, 2))
        for j in range(m):
            p = parts[:, j]
            others = total - (r[:, j] * p).sum(axis=1)
            want = h * (others + (p**2).sum(axis=1)) / norm
            for c in range(CENTROIDS):
                own = codes[:, j] == c
                if own.any():
                    q = p[own]
                    a = np.eye(SUB) * own.sum() + h * np.einsum("ni,nj,n->ij", q, q, 1 / norm[own])
                    books[j, c] = np.linalg.solve(a, q.sum(axis=0) + (want[own, None] * q).sum(axis=0))
    return books


def scan(q: np.ndarray, codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Approximate products of one query with all coded vectors; ``codes`` hold two subspaces a byte."""
    table = np.einsum("mkd,md->mk", books, q.reshape(len(books), SUB)).astype(np.float32)
    pairs = (table[1::2, :, None] + table[0::2, None, :]).reshape(len(table) // 2, -1)  # high four bits: the odd one
    out = pairs[0][codes[0]]
    for j in range(1, len(pairs)):
        out += pairs[j][codes[j]]
    return out


def packed(codes: np.ndarray) -> np.ndarray:
    """Two codes a byte: (n, subspaces / 2)."""
    return (codes[:, 0::2] | codes[:, 1::2] << 4).astype(np.uint8)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` largest scores, equal ones by smaller id; ``ids`` ascend."""
    if len(scores) <= k:
        return np.lexsort((ids, -scores))
    edge = np.partition(scores, -k)[-k]
    sure = np.nonzero(scores > edge)[0]
    tied = np.nonzero(scores == edge)[0][: k - len(sure)]
    at = np.r_[sure, tied]
    return at[np.lexsort((ids[at], -scores[at]))]


def usable(table: DataFrame, id_col="vec_id", vec_col="embedding") -> DataFrame:
    """``vec_id, v, dim``: rows with an id whose vector has finite numbers only and isn't all zeros."""
    v = F.col(vec_col).cast("array<double>")
    fine = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return table.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(fine & F.col("vec_id").isNotNull()).withColumn("dim", F.size("v"))


def build_index(rows: DataFrame, dim: int, sample: int = SAMPLE) -> tuple[DataFrame, np.ndarray]:
    """(index, centroids). The index, a written table, has every row: ``vec_id, block, code, vec``."""
    width = -(-dim // (2 * SUB)) * 2 * SUB  # an even number of subspaces; zeros fill up
    few = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow()["v"]
    x = np.array(few.to_pylist(), np.float64).reshape(-1, dim)
    g = weight(dim)
    books = fit(np.pad(x, ((0, 0), (0, width - dim))), g)
    n_blocks = max(1, -(-rows.count() // BLOCK))
    held = rows.sparkSession.sparkContext.broadcast(books)  # width * 16 doubles

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            y = b.column(1).flatten().to_numpy().reshape(-1, dim)
            codes = packed(encode(np.pad(y, ((0, 0), (0, width - dim))), held.value, g))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([v.tobytes() for v in y], pa.binary())], ["vec_id", "code", "vec"])

    index = rows.select("vec_id", "v").mapInArrow(run, "vec_id long, code binary, vec binary")
    index = index.withColumn("block", F.pmod(F.xxhash64(F.lit(SEED), "vec_id"), F.lit(n_blocks)).cast("int"))
    return common.written(index, "index"), books


def search(table: DataFrame, is_query, k: int = 20, rerank: int = RERANK, id_col="vec_id", vec_col="embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query row its ``k`` nearest other rows found.

    Nearness is the inner product; ties go to smaller ids. Rows without an id, and null, zero, empty or
    non-finite vectors take no part, nor do vectors of another length than most (ties: the longer) have.
    Rows of the query's own id are left out; other repeated ids are candidates each. Queries and blocks
    of rows meet in pairs of bounded size; a block gives its ``k`` best after exact ranking.
    Other columns play no part, whatever their names; an empty table gives an empty result.
    """
    spark = table.sparkSession
    rows = usable(table, id_col, vec_col)
    dims = rows.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
    empty = "query_id long, rank int, vec_id long, score double"
    if dims is None:
        return spark.createDataFrame([], empty)
    dim = dims[0]
    rows = rows.where(F.col("dim") == dim)
    index, books = build_index(rows, dim)
    held = spark.sparkContext.broadcast(books)
    queries = index.where(is_query(F.col("vec_id"))).select("vec_id", "vec")
    n_queries = queries.count()
    n_parts = max(1, -(-n_queries // QUERIES))
    n_blocks = (index.agg(F.max("block")).first()[0] or 0) + 1
    # Each block of rows meets each part of the queries in one task: (block, part) is the key of both sides.
    left = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))))
    right = queries.withColumn("part", F.pmod(F.xxhash64(F.lit(SEED + 1), "vec_id"), F.lit(n_parts)).cast("int"))
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def compare(key, data, qs):
        out = [[], [], []]
        if data.num_rows and qs.num_rows:
            data = data.sort_by("vec_id")
            ids = data["vec_id"].to_numpy()
            whole = lambda t, c, kind, w: np.frombuffer(b"".join(t[c].to_pylist()), kind).reshape(-1, w)
            x = whole(data, "vec", "<f8", dim)
            codes = np.ascontiguousarray(whole(data, "code", np.uint8, len(held.value) // 2).T)
            width = len(held.value) * SUB
            for qid, q in zip(qs["vec_id"].to_pylist(), whole(qs, "vec", "<f8", dim)):
                near = scan(np.pad(q, (0, width - dim)), codes, held.value)
                at = np.sort(best(near, ids, rerank + 1))
                at = at[ids[at] != qid]
                exact = np.zeros(len(at))
                for j in range(dim):  # term by term, so that equal vectors have equal scores in any block
                    exact += x[at, j] * q[j]
                at2 = best(exact, ids[at], k)
                out[0].append(np.full(len(at2), qid, np.int64))
                out[1].append(ids[at][at2])
                out[2].append(exact[at2])
        cols = [np.concatenate(c) if c else np.empty(0, t) for c, t in zip(out, (np.int64, np.int64, np.float64))]
        return pa.Table.from_arrays([pa.array(c) for c in cols], ["query_id", "vec_id", "score"])

    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(compare, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_ann(spark, sf_dir: str) -> DataFrame:
    """The contract's query: rows whose id is divisible by 20 against all others."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda c: c % 20 == 0)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER () AS r FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
), n AS (
  SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), w AS (
  SELECT * FROM n WHERE len(e) = (SELECT len(e) FROM n GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM w q JOIN w c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), k AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= 20
"""

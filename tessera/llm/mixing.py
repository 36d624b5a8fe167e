"""Operator 10, mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents fall into groups by a hash of their id, at most ``groups`` for a source, and each group into blocks of some
``block_words`` words, so that blocks stay small however large a source is. A source's target is met by whole
passes over its groups and a partial pass over a permutation of them, and a group's draw draws all its blocks. The quotas of
all sources (numbers of block draws) are then split exactly among output shards of ``shard_words`` words: a binary
tree halves the shards, and each node draws how many of each source's draws go left from a multivariate hypergeometric law.
A leaf thereby owns a range of each source's permuted draws, disjoint from all others, and its documents are
shuffled locally by a keyed hash.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

GROUPS = 1024
SHARD_WORDS, BLOCK_WORDS = 4_000_000, 65_536
#: Block draws that the tree's law can split; where there would be more, blocks are made larger.
MOST_DRAWS = 500_000_000
SEED = 17
#: Draws (some 40 bytes a row) up to which their table is broadcast; beyond, a plain join.
BROADCAST_ROWS = 500_000


def n_words(col) -> F.Column:
    """The number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(col, F.lit(r"[^ \t\n\u000B\f\r]+")), F.lit(0)).cast("long")


def _seed(*parts) -> int:
    return int.from_bytes(hashlib.sha256(repr(parts).encode()).digest()[:8], "little")


def targets(sized: DataFrame, weights: tuple = (1, 2, 3), most: int = 3) -> DataFrame:
    """One row per source: ``src`` (its rank by code point, null last), ``source_size``, ``weight``, ``target``.

    Water filling: a source stops at ``most`` times its size and the excess goes to the others by weight.
    Works on one row per source; the windows run over those only.
    """
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = total.withColumn("src", F.row_number().over(order) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("src") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("src"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    share = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    # While capped sources come first this level rises; it peaks at the first source that isn't capped.
    ranked = ranked.withColumn("at", left / share).withColumn("level", F.max("at").over(everything))
    capped = F.col("weight") * F.col("level") >= F.col("cap")
    return ranked.select("src", "source", "source_size", "n_docs", "weight", capped.alias("capped"), F.when(capped, F.col("cap")).otherwise(F.col("weight") * F.col("level")).alias("target"))


def split_ranges(quotas: list[int], n_shards: int, seed: int, shard: int) -> list[tuple[int, int]]:
    """For one shard, (first draw, number of draws) of each source, by walking down the splitting tree."""
    left, counts = np.zeros(len(quotas), np.int64), np.array(quotas, np.int64)
    lo, hi = 0, n_shards
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.default_rng(_seed(seed, "node", lo, hi))
        total = int(counts.sum())
        take = round(total * (mid - lo) / (hi - lo))
        got = rng.multivariate_hypergeometric(counts, take, method="marginals") if total else counts
        if shard < mid:
            counts, hi = got, mid
        else:
            left, counts, lo = left + got, counts - got, mid
    return list(zip(left.tolist(), counts.tolist()))


def pick_groups(src: int, sizes: dict[int, int], target: float, capped: bool, most: int, seed: int) -> list[int]:
    """The draws of one source in order: whole passes, then the groups of a partial pass, each pass permuted.

    Groups of the partial pass are taken in permuted order as they fit. If the sum is off the target by a
    thousandth or more, single draws are added, left out or exchanged while that brings it nearer; a group
    is drawn ``most`` times at most.
    """
    groups = np.array(sorted(sizes))
    words = np.array([sizes[b] for b in groups.tolist()], np.int64)
    total = int(words.sum())
    passes = most if capped else int(target // total) if total else 1
    order = lambda p: np.random.default_rng(_seed(seed, "pass", src, p)).permutation(len(groups))
    times = np.full(len(groups), passes)
    if total and not capped:
        rest = target - passes * total
        for i in order(passes).tolist():
            if 0 < words[i] <= rest:
                times[i] += 1
                rest -= words[i]
        for _ in range(100):
            if abs(rest) < target / 1000:
                break
            add = np.append(np.where((times < most) & (words > 0), words, 1 << 60), 0)
            drop = np.append(np.where((times > 0) & (words > 0), words, 1 << 60), 0)
            left = np.abs(rest - (add[:, None] - drop[None, :]))
            i, j = np.unravel_index(int(left.argmin()), left.shape)
            if left[i, j] >= abs(rest):
                break
            rest -= int(add[i] - drop[j])
            if i < len(groups):
                times[i] += 1
            if j < len(groups):
                times[j] -= 1
    return [int(groups[i]) for p in range(int(times.max(initial=0))) for i in order(p) if times[i] > p]


def permutation(n: int, seed: int, src: int) -> tuple[int, int]:
    """(a, c) of a permutation i -> (a i + c) mod n that spreads neighbours; both follow the seed, so another one gives other neighbours."""
    a = max(1, round(n * 0.6180339887498949) - _seed(seed, "step", src) % max(n // 8, 1))
    while math.gcd(a, n) != 1:
        a += 1
    return a, _seed(seed, "draws", src) % max(n, 1)


def draw_plan(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=(1, 2, 3), most=3, groups=GROUPS, block_words=BLOCK_WORDS, shard_words=SHARD_WORDS, seed=SEED):
    """(sized, sources, draws): documents with sizes; one row per source; one row per draw of a block.

    ``draws(src, grp, sub, pos, shard)``. Reruns agree: everything follows from ids, sizes and the seed. The driver
    holds some numbers per source, as the tree's law is one over all sources.
    """
    spark = docs.sparkSession
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    sized = common.written(sized, "sized")
    sources = targets(sized, weights, most)
    total = sized.agg(F.sum("size")).first()[0] or 0
    words = max(block_words, -(-total * most // MOST_DRAWS))
    subs = F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.lit(float(words)) / F.least("n_docs", F.lit(groups)))).cast("long")
    sources = common.written(sources.withColumn("subs", subs), "sources")
    tagged = with_blocks(sized, sources, "doc_id", groups, seed)
    per_group = tagged.groupBy("src", "grp").agg(F.sum("size").alias("words"))
    facts = sources.select("src", "target", "capped")

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:  # at most ``groups`` rows, whatever the source's size
        src = int(pdf.src.iloc[0])
        got = pick_groups(src, dict(zip(pdf.grp.tolist(), pdf.words.tolist())), float(pdf.target.iloc[0]), bool(pdf.capped.iloc[0]), most, seed)
        return pd.DataFrame({"src": src, "grp": np.array(got, np.int64), "nth": np.arange(len(got), dtype=np.int64)})

    picked = per_group.join(facts, "src").groupBy("src").applyInPandas(plan, "src int, grp long, nth long")
    picked = common.written(picked, "picked")
    rows = picked.groupBy("src").count().join(sources.select("src", "subs"), "src").collect()  # one per source
    quota = {r.src: r["count"] * r.subs for r in rows}
    n_shards = max(1, min(-(-int(total) // shard_words), sum(quota.values())))
    quotas = [quota.get(i, 0) for i in range(max(quota, default=-1) + 1)]
    order = spark.createDataFrame([(i, q, *permutation(q, seed, i)) for i, q in quota.items()], "src int, quota long, a long, c long")
    expanded = picked.join(sources.select("src", "subs"), "src").join(order, "src").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("subs") - 1)).alias("sub"))
    draws = expanded.select("src", "grp", "sub", F.pmod(F.col("a") * (F.col("nth") * F.col("subs") + F.col("sub")) + F.col("c"), "quota").alias("pos"))

    def leaves(batches):
        for pdf in batches:
            for s in pdf.id.tolist():
                ranges = split_ranges(quotas, n_shards, seed, s)
                yield pd.DataFrame([(i, s, a, n) for i, (a, n) in enumerate(ranges) if n], columns=["src", "shard", "first", "n"])

    tree = spark.range(n_shards).mapInPandas(leaves, "src int, shard long, first long, n long")
    tree = tree.select("src", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("pos"))
    draws = draws.join(tree, ["src", "pos"])
    return sized, sources, F.broadcast(draws) if sum(quotas) <= BROADCAST_ROWS else draws


def with_blocks(docs: DataFrame, sources: DataFrame, id_col="doc_id", groups=GROUPS, seed=SEED, source_col="source") -> DataFrame:
    """``docs`` with ``src``, ``grp`` and ``sub``: source, group and block; the source table has one row per source and is broadcast while small."""
    tags = sources.select(F.col("source").alias("_source"), "src", F.least(F.col("n_docs"), F.lit(groups)).alias("_groups"), F.col("subs").alias("_subs"))
    tags = F.broadcast(tags) if tags.count() <= BROADCAST_ROWS else tags
    out = docs.join(tags, docs[source_col].eqNullSafe(F.col("_source")))
    out = out.withColumn("grp", F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.col("_groups")))
    return out.withColumn("sub", F.pmod(F.xxhash64(F.lit(seed), F.lit("block"), F.col(id_col)), F.col("_subs"))).drop("_source", "_groups", "_subs")


def taken(docs: DataFrame, groups=GROUPS, most=3, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken, shards``, a row per row of ``docs``.

    ``shards`` are the output shards that the splitting tree deals the row's draws to, in order, comma-joined: ``most`` at most.
    A null text or one without words has size 0; a null source is a source of its own, the last; rows of a
    null id are one block's. Rows of a repeated id are drawn together; a very long document is drawn whole. Other
    columns play no part, whatever their names. An empty table gives an empty result.
    """
    sized, sources, draws = draw_plan(docs, groups=groups, most=most, **options)
    times = draws.groupBy("src", "grp", "sub").agg(F.count(F.lit(1)).alias("times"), F.array_join(F.sort_array(F.collect_list("shard")), ",").alias("shards"))
    tagged = with_blocks(sized, sources, groups=groups, seed=options.get("seed", SEED))
    out = tagged.join(times, ["src", "grp", "sub"], "left")
    facts = sources.select("src", "source_size", "target")
    facts = F.broadcast(facts) if sources.count() <= BROADCAST_ROWS else facts
    return out.join(facts, "src").select("doc_id", "size", "source_size", "target", (F.col("size") * F.coalesce("times", F.lit(0))).cast("long").alias("taken"), F.coalesce("shards", F.lit("")).alias("shards"))


def mix(docs: DataFrame, groups=GROUPS, most=3, seed=SEED, **options) -> DataFrame:
    """The mixed corpus: the columns of ``docs`` (once per draw of a row's block), dealt by shard, shuffled within.

    Rows are treated as in ``taken``; equal keys of the shuffle, which only rows of one id have, stay side by side.
    """
    sized, sources, draws = draw_plan(docs, groups=groups, most=most, seed=seed, **options)
    names = docs.columns
    row = docs.select(F.struct(*[docs[c] for c in names]).alias("_row"))  # clashing names stay apart
    row = row.select("_row", F.col("_row.doc_id").alias("_id"), F.col("_row.source").alias("_src"))
    tagged = with_blocks(row, sources, "_id", groups, seed, "_src")
    out = tagged.join(draws, ["src", "grp", "sub"])
    out = out.withColumn("_key", F.xxhash64(F.lit(seed), "shard", "_id", "pos"))
    out = out.repartition(common.partitions_for(docs.sparkSession), "shard").sortWithinPartitions("shard", "_key")
    return out.select(*[F.col("_row").getField(c).alias(c) for c in names])


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """The contract's query over all of ``documents``."""
    return taken(spark.read.parquet(f"{sf_dir}/documents.parquet"))

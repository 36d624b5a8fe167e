"""Grouped, stratified folds: rows of one group share a fold, classes are spread evenly."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import with_row_numbers


def assign(groups: list[tuple], k: int, seed: int = 0) -> dict:
    """{group: fold} of (group, n_negative, n_positive), greedily: uneven groups first, each where shares stay closest.

    Ties go to the fold with fewer rows, then the lower fold; equal groups are taken in the order of a hash.
    """
    import hashlib

    if len(groups) < k:
        raise ValueError(f"{len(groups)} groups for {k} folds")
    counts = np.array([g[1:] for g in groups], float)
    total = np.maximum(counts.sum(axis=0), 1)
    mixed = [hashlib.md5(f"{g[0]}:{seed}".encode()).hexdigest() for g in groups]
    order = sorted(range(len(groups)), key=lambda i: (-counts[i].std(), mixed[i]))
    held, out, spot = np.zeros((k, counts.shape[1])), {}, np.eye(k)[:, :, None]
    for i in order:
        trial = held[None] + spot * counts[i]  # one table for each fold that the group may go to
        key = np.round((trial / total).std(axis=1).mean(axis=1), 12)
        best = min(range(k), key=lambda f: (key[f], held[f].sum(), f))  # noqa: B023
        held[best] += counts[i]
        out[groups[i][0]] = best
    return out


#: Groups up to which all are assigned greedily on the driver (some 100 bytes each); beyond, the largest of them are.
GREEDY = 20_000


def class_counts(df: DataFrame, group: str, y: str) -> DataFrame:
    """``_g, n0, n1``: a row per group with its negatives and positives."""
    return df.groupBy(F.col(group).alias("_g")).agg(F.count_if(F.col(y) != 1).alias("n0"), F.count_if(F.col(y) == 1).alias("n1"))


def group_folds(df: DataFrame, group: str, y: str, k: int, seed: int = 0) -> DataFrame:
    """``_g, fold``: a row per group.

    The largest GREEDY groups go to the driver, which assigns them one by one. All others are smaller than these: ordered by
    their class counts they are dealt out to and fro over the folds, by row numbers, without leaving the executors.
    """
    return folds_of_counts(class_counts(df, group, y), k, seed)


def folds_of_counts(stats: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """As ``group_folds``, out of the groups' ``class_counts``."""
    kind = stats.schema["_g"].dataType.simpleString()
    held = stats.withColumn("_size", F.col("n0") + F.col("n1")).withColumn("_mix", F.xxhash64(F.col("_g").cast("string"), F.lit(seed))).persist()
    n = held.count()
    largest = held.orderBy(F.desc("_size"), "_mix").limit(GREEDY).select("_g", "n0", "n1")
    folds = assign([tuple(r) for r in largest.collect()], k, seed)
    out = stats.sparkSession.createDataFrame([(g, f) for g, f in folds.items()], f"_g {kind}, fold int")
    if n > GREEDY:
        rest = held.join(out.select(F.col("_g").alias("_known"), F.lit(True).alias("_done")), F.col("_g").eqNullSafe(F.col("_known")), "left").where("_done is null").select("_g", "n0", "n1", "_mix")
        at = F.pmod(F.col("row_number"), F.lit(2 * k))
        dealt = with_row_numbers(rest, [F.desc("n1"), F.desc("n0"), "_mix"]).select("_g", F.when(at < k, at).otherwise(2 * k - 1 - at).cast("int").alias("fold"))
        out = out.unionByName(dealt)
    held.unpersist()
    return out


def grouped_folds(df: DataFrame, group: str, y: str, k: int, seed: int = 0) -> DataFrame:
    """``df`` with ``fold``, see ``group_folds``; too few groups raise. Null groups share a fold."""
    table = group_folds(df, group, y, k, seed)
    return df.join(table, df[group].eqNullSafe(table["_g"])).drop("_g")


def inner_folds(n_groups: int, k: int = 3) -> int:
    """The number of inner folds that the groups allow."""
    return k if n_groups >= k else max(2, n_groups - 1)


def leaking_groups(df: DataFrame, group: str, fold: str = "fold") -> DataFrame:
    """Groups in more than one fold: none, if the folds are sound."""
    return df.groupBy(group).agg(F.count_distinct(fold).alias("n_folds")).where("n_folds > 1")


def fold_table(df: DataFrame, group: str, y: str, fold: str = "fold") -> DataFrame:
    """Per fold: rows, positives, negatives and distinct groups, at its own side and in all other folds."""
    own = df.groupBy(fold).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(y) == 1).alias("n_pos"), F.count_if(F.col(y) != 1).alias("n_neg"), F.count_distinct(group).alias("n_groups"))
    total = df.agg(F.count(F.lit(1)).alias("_n"), F.count_distinct(group).alias("_g"))
    only = df.groupBy(group).agg(F.count_distinct(fold).alias("k"), F.min(fold).alias(fold)).where("k = 1").groupBy(fold).agg(F.count(F.lit(1)).alias("_only"))
    out = own.join(only, fold, "left").crossJoin(F.broadcast(total))
    return out.select(fold, "n", "n_pos", "n_neg", "n_groups", (F.col("_n") - F.col("n")).alias("n_train"), (F.col("_g") - F.coalesce("_only", F.lit(0))).alias("n_train_groups"))

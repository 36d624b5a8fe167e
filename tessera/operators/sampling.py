"""Reproducible draws: rows in the order of a keyed hash of their ids, so that neither partitions nor engines matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import with_row_numbers


def order_of(id_col: str, seed: int) -> list[Column]:
    return [F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")).cast("binary")), F.col(id_col)]


#: Draws of up to so many rows are a top-k, which ends in one task; larger ones a distributed sort.
TOP_K = 100_000


def draw(df: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement (all, if fewer), the first in hash order."""
    if n <= TOP_K:
        return df.orderBy(*order_of(id_col, seed)).limit(n)
    hashed = df.withColumn("_h", order_of(id_col, seed)[0])
    return with_row_numbers(hashed, ["_h", id_col]).where(F.col("row_number") < n).drop("_h", "row_number", "n_rows")


def draw_per_class(df: DataFrame, label: str, id_col: str, n: int, seed: int) -> DataFrame:
    """``n`` rows of each class."""
    w = Window.partitionBy(label).orderBy(*order_of(id_col, seed))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def with_ratio(df: DataFrame, is_rare: Column, id_col: str, ratio: int, seed: int) -> DataFrame:
    """All rows of the rare class and ``ratio`` times as many of the other, at most all of it. Raises without rare rows."""
    rare, rest = df.where(is_rare), df.where(~is_rare)
    n = rare.count()
    if not n:
        raise ValueError("the class to keep is empty")
    return rare.unionByName(draw(rest, id_col, ratio * n, seed))


def pools(parts: list[tuple[str, DataFrame, int | None]], id_col: str, seed: int) -> DataFrame:
    """Tagged pools, each capped by a draw, united; a row that is in several stays in the first."""
    out = None
    for i, (name, df, n) in enumerate(parts):
        own = (df if n is None else draw(df, id_col, n, seed)).withColumn("pool", F.lit(name)).withColumn("_p", F.lit(i))
        out = own if out is None else out.unionByName(own)
    w = Window.partitionBy(id_col).orderBy("_p")
    return out.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_p")


def chunks(df: DataFrame, order: list, k: int) -> DataFrame:
    """``chunk``: runs of ceil(n / k) rows in order (not ntile); late chunks may be empty.

    Row numbers come of per-partition counts over a range-partitioned order, not of one global window.
    """
    return with_row_numbers(df, order).withColumn("chunk", F.floor(F.col("row_number") / F.ceil(F.col("n_rows") / F.lit(k))).cast("int"))


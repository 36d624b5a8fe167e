"""Length-grouped batches: rows shuffled by hash, cut into megabatches, sorted by length within, dealt to workers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ordered, sampling


def megabatches(df: DataFrame, id_col: str, length: str, size: int, seed: int) -> DataFrame:
    """``megabatch`` and ``place`` (from 0, longest first) of every row."""
    got = ordered.with_row_numbers(df.withColumn("_h", sampling.order_of(id_col, seed)[0]), ["_h", id_col]).drop("_h", "n_rows")
    got = got.withColumn("megabatch", F.floor(F.col("row_number") / size).cast("long")).drop("row_number")
    w = Window.partitionBy("megabatch").orderBy(F.desc(length), id_col)
    return got.withColumn("place", F.row_number().over(w) - 1)


def deal(lengths: list[int], k: int) -> list[int]:
    """The worker of each row of a megabatch, longest first: the least loaded one that isn't full.

    Rows that don't divide evenly are dealt in turn.
    """
    n = len(lengths)
    if n % k:
        return [i % k for i in range(n)]
    load, count, out = [0] * k, [0] * k, []
    for x in lengths:
        w = min((i for i in range(k) if count[i] < n // k), key=lambda i: (load[i], i))
        load[w] += x
        count[w] += 1
        out.append(w)
    return out


def even_chunks(df: DataFrame, id_col: str, length: str, batch: int, workers: int, seed: int) -> DataFrame:
    """``megabatches`` with the ``worker`` of each row; a megabatch (batch * workers rows) is one group."""
    got = megabatches(df.select(F.col(id_col).alias("id"), F.col(length).cast("long").alias("length")), "id", "length", batch * workers, seed)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        return pdf.assign(worker=deal(pdf.length.tolist(), workers))[["id", "length", "megabatch", "place", "worker"]]

    return got.groupBy("megabatch").applyInPandas(run, "id long, length long, megabatch long, place long, worker int")


def modality_batches(df: DataFrame, id_col: str, length: str, batch: int, workers: int, seed: int) -> DataFrame:
    """``id, length, modality, megabatch, place``: positive lengths (with images) and negative ones apart.

    Full megabatches hold one modality and come in hash order. What either modality has left over makes a
    mixed one: in front if it is full, its rest (or all of it) at the end.
    """
    size = batch * workers
    x = df.select(F.col(id_col).alias("id"), F.abs(F.col(length)).cast("long").alias("length"), F.when(F.col(length) > 0, "mm").otherwise("lang").alias("modality"))
    parts = []
    for i, m in enumerate(("mm", "lang")):
        own = megabatches(x.where(F.col("modality") == m), "id", "length", size, seed + i)
        last = own.agg(F.max("megabatch").alias("last"))
        parts.append(own.crossJoin(F.broadcast(last)))  # one row
    both = parts[0].unionByName(parts[1])
    full = both.where("megabatch < last").withColumn("h", F.md5(F.concat("modality", F.lit(":"), F.col("megabatch").cast("string"), F.lit(f":{seed}")).cast("binary")))
    order = ordered.with_row_numbers(full.select("modality", "megabatch", "h").distinct(), ["h", "modality", "megabatch"]).withColumn("n", F.col("row_number") + 1)
    full = full.join(order.select("modality", "megabatch", "n"), ["modality", "megabatch"]).select("id", "length", "modality", F.col("n").cast("long").alias("megabatch"), "place")
    mixed = both.where("megabatch = last").withColumn("at", F.row_number().over(Window.orderBy(F.desc("modality"), "place")) - 1)  # two megabatches at most
    n_mixed = mixed.agg(F.count(F.lit(1)).alias("n_mixed"))
    end = order.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n_full"))
    mixed = mixed.crossJoin(F.broadcast(n_mixed)).crossJoin(F.broadcast(end))
    front = (F.col("n_mixed") >= size) & (F.col("at") < size)
    mixed = mixed.select("id", "length", "modality", F.when(front, F.lit(0)).otherwise(F.col("n_full") + 1).cast("long").alias("megabatch"), F.when(front | (F.col("n_mixed") < size), F.col("at")).otherwise(F.col("at") - size).cast("int").alias("place"))
    return full.unionByName(mixed)

"""Row numbers, running sums and exact quantiles over a range-partitioned order: no task sees all rows.

The dealt rows are written to the shared folder before they are counted. Range bounds come of a random sample, so
two readers of one plan could be dealt differently; a written table is the same for both, and survives lost executors.
Running sums of up to SMALL rows, which are counted first, are one window's work and nothing is written for them.
Who takes a result to the driver deletes such tables at once (``temporary``); those of a result that is still to be computed stay.
"""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import shared_path

#: Rows up to which one task orders all of them (some 100 bytes each).
SMALL = 100_000
#: Bits of a monotonically increasing id that number the rows of a partition.
PLACE_BITS = 33


_made: list[list[str]] = []


@contextmanager
def temporary(spark):
    """Deletes the tables that were written within, at its end: for results that have been collected by then."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def counted(df: DataFrame) -> tuple[DataFrame, bool]:
    """(``df``, kept so that counting and using it compute it once; whether it has at most SMALL rows)."""
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    return held, held.count() <= SMALL


def in_order(df: DataFrame, order: list) -> DataFrame:
    """``df`` as a written table with ``_part``, the range a row is in, and ``_place``, its place there from 0."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    path = shared_path(spark, "ordered")
    if _made:
        _made[-1].append(path)
    dealt.write.parquet(path)
    rows = spark.read.schema(dealt.schema).parquet(path)
    return rows.withColumn("_part", F.shiftright("_at", PLACE_BITS)).withColumn("_place", F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))).drop("_at")


def with_row_numbers(df: DataFrame, order: list) -> DataFrame:
    """``row_number`` from 0 in the given order and ``n_rows``; the order should have few ties, as these stay in one task."""
    rows = in_order(df, order)
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("n_rows"))
    out = rows.join(F.broadcast(before), "_part")  # one row per partition
    return out.withColumn("row_number", F.col("_place") + F.col("_before")).drop("_part", "_place", "_before")


def running_sums(df: DataFrame, keys: list[str], order: list, sums: dict[str, tuple[str, str]]) -> DataFrame:
    """For each column of ``sums``, (name of its sum per key up to and with the row, name of its sum per key).

    A key's rows may lie in many ranges, so a hot key is shared out; null keys count as a key. Rows should be
    distinct in keys and order.
    """
    held, small = counted(df)
    if small:
        key = Window.partitionBy(*keys)
        upto = key.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return held.select(*df.columns, *[x for c, (name, total) in sums.items() for x in (F.sum(c).over(upto).alias(name), F.sum(c).over(key).alias(total))])
    rows = in_order(held, [*keys, *order])
    held.unpersist()
    per = rows.groupBy("_part", *keys).agg(*[F.sum(c).alias(f"_sum_{c}") for c in sums])
    key, earlier = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select(
        F.col("_part").alias("_p"),
        *[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)],
        *[F.coalesce(F.sum(f"_sum_{c}").over(earlier), F.lit(0)).alias(f"_before_{c}") for c in sums],
        *[F.sum(f"_sum_{c}").over(key).alias(total) for c, (_, total) in sums.items()],
    )
    upto = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({name: F.sum(c).over(upto) for c, (name, _) in sums.items()})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)], F.col("_part") == F.col("_p"))
    out = local.join(base, same).withColumns({name: F.col(name) + F.col(f"_before_{c}") for c, (name, _) in sums.items()})
    return out.select(*df.columns, *[x for names in sums.values() for x in names])


def quantiles(df: DataFrame, values: dict[str, Column], at: list[float]) -> DataFrame:
    """``name, q``: the exact quantiles of each named value, linear between neighbours; nulls don't count, and a name
    without values has no row. All values are dealt and written together, as distinct values with their counts."""
    pairs = F.array(*[F.struct(F.lit(k).alias("name"), v.cast("double").alias("v")) for k, v in values.items()])
    steps = df.select(F.explode(pairs).alias("x")).select("x.*").where("v is not null").groupBy("name", "v").agg(F.count(F.lit(1)).alias("n"))
    return quantiles_of(steps, ["name"], at)


def quantiles_of(steps: DataFrame, keys: list[str], at: list[float]) -> DataFrame:
    """``keys, q``: the exact quantiles of each key out of its distinct values, rows ``keys, v, n``; null keys are keys."""
    s = running_sums(steps, keys, ["v"], {"n": ("upto", "total")})
    holds = lambda place: (F.col("upto") > place) & (F.col("upto") - F.col("n") <= place)
    got, out = [F.max("total").alias("total")], []
    for i, p in enumerate(at):
        place = (F.col("total") - 1) * F.lit(float(p))
        got += [F.max(F.when(holds(F.floor(place)), F.col("v"))).alias(f"lo{i}"), F.max(F.when(holds(F.ceil(place)), F.col("v"))).alias(f"hi{i}")]
        lo, hi = F.col(f"lo{i}"), F.col(f"hi{i}")
        out.append(F.when(lo == hi, lo).otherwise((F.ceil(place) - place) * lo + (place - F.floor(place)) * hi))
    return s.groupBy(*keys).agg(*got).select(*keys, F.array(*out).alias("q"))


def with_next(df: DataFrame, keys: list[str], order: list[str], following: dict[str, str]) -> DataFrame:
    """``df`` with the values that the columns of ``following`` have in the key's next row, under its names; null in the last row.

    A range's last row takes them from the first row of the next range that has rows: one row a range is carried over.
    Null keys count as a key.
    """
    held, small = counted(df)
    if small:
        w = Window.partitionBy(*keys).orderBy(*order)
        return held.select(*df.columns, *[F.lead(c).over(w).alias(name) for c, name in following.items()])
    rows = in_order(held, [*keys, *order])
    held.unpersist()
    within = Window.partitionBy("_part").orderBy("_place")
    first = rows.where("_place = 0").select("_part", F.struct(*keys, *following).alias("_row"))
    carried = first.select("_part", F.lead("_row").over(Window.orderBy("_part")).alias("_carried"))
    got = rows.withColumn("_next", F.lead(F.struct(*keys, *following)).over(within)).join(F.broadcast(carried), "_part")  # a row per range
    got = got.withColumn("_next", F.coalesce("_next", "_carried"))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_next.{k}")) for k in keys], F.col("_next").isNotNull())
    return got.select(*df.columns, *[F.when(same, F.col(f"_next.{c}")).alias(name) for c, name in following.items()])

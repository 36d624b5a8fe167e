"""Grouped distribution reports: counts of samples, persons and series, spreads, totals, cross-checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import quantiles, quantiles_of, temporary

TOTAL = "TOTAL"


QUARTILES = {"median": 0.5, "q1": 0.25, "q3": 0.75}


def spread(col, prefix: str, digits: int = 6) -> list:
    """Mean, minimum, maximum and number of a column; nulls don't count. The quartiles come of ``quartiles``."""
    c = F.col(col) if isinstance(col, str) else col
    return [F.round(F.avg(c), digits).alias(f"{prefix}_mean"), F.min(c).alias(f"{prefix}_min"), F.max(c).alias(f"{prefix}_max"), F.count(c).alias(f"{prefix}_n")]


def quartiles(steps: DataFrame, prefix: str, digits: int = 6) -> DataFrame:
    """``g, t`` and the exact quartiles, linear between neighbours, of each group out of ``g, t, v, n``: distinct values and their counts."""
    q = quantiles_of(steps.where("v is not null"), ["g", "t"], list(QUARTILES.values()))
    return q.select("g", "t", *[F.round(F.col("q")[i], digits).alias(f"{prefix}_{n}") for i, n in enumerate(QUARTILES)])


def breakdown(df: DataFrame, group: str, person: str, series: str, measure: str, resolved: str, categories: list[str] | None = None) -> DataFrame:
    """The report per group and, as TOTAL, over all rows (distinct counts aren't additive, so it is computed anew).

    Rows per person come of a first aggregate by group and person; the rest of a second by group; grouping sets make the
    total beside the groups. All are partial aggregates, so a hot group moves as partial sums; exact quartiles come of
    running sums over distinct values, so no group is in one buffer. Listed categories without rows appear with
    zero counts and null spreads. A null group is a group of its own.
    """
    x = df.select(F.col(group).cast("string").alias("g"), F.col(person).alias("_person"), F.col(series).alias("_series"), F.col(measure).alias("_measure"), F.col(resolved).alias("_resolved"))
    both = lambda *more: x.groupingSets([["g", *more], [*more]], "g", *more)
    t = F.grouping("g").cast("int").alias("t")
    per = both("_person").agg(t, F.count(F.lit(1)).alias("n"), F.count_if("_resolved").alias("nr"))
    people = per.groupBy("g", "t").agg(
        F.count("_person").alias("n_patients"), F.sum("n").alias("n_samples"), *spread("n", "spp"), F.sum("nr").alias("n_samples_resolved"), F.count_if((F.col("nr") > 0) & F.col("_person").isNotNull()).alias("n_patients_resolved"),
    )
    rest = both().agg(t, F.count_distinct("_series").alias("n_series"), *spread("_measure", "measure"))
    middle = [
        quartiles(per.groupBy("g", "t", F.col("n").cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n")), "spp"),
        quartiles(both("_measure").agg(t, F.count(F.lit(1)).alias("n")).select("g", "t", F.col("_measure").cast("double").alias("v"), "n"), "measure"),
    ]
    out = people
    for i, more in enumerate([rest, *middle]):
        more = more.withColumnsRenamed({"g": f"_g{i}", "t": f"_t{i}"})
        out = out.join(more, out["g"].eqNullSafe(more[f"_g{i}"]) & (out["t"] == more[f"_t{i}"]), "left").drop(f"_g{i}", f"_t{i}")
    name = F.when(F.col("t") == 1, TOTAL).otherwise(F.col("g"))
    out = out.withColumn("category", name).drop("g", "t")
    out = out.withColumn("resolution_pct", F.round(F.coalesce(F.try_divide(F.col("n_samples_resolved") * 100.0, "n_samples"), F.lit(0.0)), 4))
    out = out.withColumn("n_series", F.when(F.col("category") != TOTAL, F.col("n_series")))
    if categories:
        listed = df.sparkSession.createDataFrame([(c,) for c in categories], "c string")
        out = out.join(F.broadcast(listed), F.col("category") == F.col("c"), "full_outer").withColumn("category", F.coalesce("category", "c")).drop("c")
        zero = [c for c in ("n_patients", "n_samples", "n_series", "spp_n", "measure_n", "n_samples_resolved", "n_patients_resolved") if c in out.columns]
        keep_null = F.col("category") == TOTAL
        out = out.withColumns({c: F.when(keep_null & F.lit(c == "n_series"), F.col(c)).otherwise(F.coalesce(c, F.lit(0))) for c in zero}).withColumn("resolution_pct", F.coalesce("resolution_pct", F.lit(0.0)))
    return out


def in_priority_order(df: DataFrame, col: str, order: list[str]) -> DataFrame:
    """Sorted by a listed order, unlisted values last, by name."""
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(col))
    return df.orderBy(F.when(rank > 0, rank).asc_nulls_last(), col)


def medians(df: DataFrame, values: dict) -> dict:
    """The exact median of each named value, as a literal; null without values."""
    with temporary(df.sparkSession):
        got = {r["name"]: r["q"][0] for r in quantiles(df, values, [0.5]).collect()}  # one number a name
    return {c: F.lit(got.get(c)).cast("double") for c in values}


def mad_flags(df: DataFrame, size: str, detected: str, k: float = 3.0) -> DataFrame:
    """Outlier flags by median ± k * 1.4826 * MAD: on log10 of the size both ways, on the detection low only.

    The medians come back as one number each; a MAD of zero counts as 1e-9, so nothing is flagged for noise.
    """
    x = df.withColumn("_l", F.log10(F.greatest(F.col(size).cast("double"), F.lit(1.0)))).withColumn("_d", F.col(detected).cast("double"))
    med = medians(x, {"_l": F.col("_l"), "_d": F.col("_d")})
    dev = medians(x, {c: F.abs(F.col(c) - med[c]) for c in med})
    edge = {c: F.lit(k * 1.4826) * F.when(dev[c] == 0, F.lit(1e-9)).otherwise(dev[c]) for c in med}
    out = x.withColumn("outlier_lo", F.col("_l") < med["_l"] - edge["_l"]).withColumn("outlier_hi", F.col("_l") > med["_l"] + edge["_l"]).withColumn("outlier_low_detection", F.col("_d") < med["_d"] - edge["_d"])
    return out.select(*df.columns, "outlier_lo", "outlier_hi", "outlier_low_detection")


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """``bin, n``: equal-width bins between minimum and maximum, the last closed; nulls don't count."""
    ends = df.agg(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi"))
    x = df.where(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("x")).crossJoin(F.broadcast(ends))
    bin_ = F.least(F.floor(F.coalesce(F.try_divide(F.col("x") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * bins), F.lit(bins - 1))
    return x.groupBy(bin_.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def composition(df: DataFrame, labels: dict) -> DataFrame:
    """``grouping, level, n``: value counts of several label expressions stacked, by one pass over the rows."""
    levels = F.array(*[F.struct(F.lit(k).alias("grouping"), v.cast("string").alias("level")) for k, v in labels.items()])
    return df.select(F.explode(levels).alias("x")).select("x.*").where("level is not null").groupBy("grouping", "level").agg(F.count(F.lit(1)).alias("n"))


def release_guard(left: DataFrame, right: DataFrame, key: str, most: float = 0.001) -> DataFrame:
    """One row: distinct non-null keys of the left, those missing at the right, the share, and whether it is too large."""
    a = left.select(key).where(F.col(key).isNotNull()).distinct()
    b = right.select(key).where(F.col(key).isNotNull()).distinct()
    lost = a.join(b, key, "left_anti").agg(F.count(F.lit(1)).alias("n_missing"))
    out = a.agg(F.count(F.lit(1)).alias("n_keys")).crossJoin(lost)  # one row each
    share = F.coalesce(F.try_divide(F.col("n_missing").cast("double"), "n_keys"), F.lit(0.0))
    return out.select("n_keys", "n_missing", F.round(share, 6).alias("missing_share"), (share <= most).alias("ok"))


def assert_release(left: DataFrame, right: DataFrame, key: str, most: float = 0.001) -> None:
    r = release_guard(left, right, key, most).first()
    if not r.n_keys:
        raise ValueError("no keys")
    if not r.ok:
        raise ValueError(f"{r.n_missing} of {r.n_keys} keys are missing")


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key: the first in the given order (drop-duplicates; reversed orders give last-write-wins)."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")

"""Ranking and classification metrics. Curves are built over distinct scores, so windows see one row per score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import quantiles, running_sums, with_next


def confusion(df: DataFrame, keys: list[str], y: str = "y", score: str = "score", at: float = 0.5) -> DataFrame:
    """Counts, accuracy, sensitivity, specificity, precision and F1 per key; 0 where a ratio has no base."""
    p, t = F.col(score) >= at, F.col(y) == 1
    c = df.groupBy(*keys).agg(F.count_if(p & t).alias("tp"), F.count_if(~p & ~t).alias("tn"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"))
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0)), 9)
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    return c.select(*keys, "tp", "tn", "fp", "fn", ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"), ratio(tp, tp + fn).alias("sensitivity"), ratio(tn, tn + fp).alias("specificity"), ratio(tp, tp + fp).alias("precision"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def score_steps(df: DataFrame, keys: list[str], y: str = "y", score: str = "score") -> DataFrame:
    """Per key and distinct score: positives and negatives at it, and at it or above (``tp``, ``fp``), with the key's totals."""
    steps = df.groupBy(*keys, score).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg"))
    return running_sums(steps, keys, [F.desc(score)], {"pos": ("tp", "n_pos"), "neg": ("fp", "n_neg")})


def roc_auc(df: DataFrame, keys: list[str], y: str = "y", score: str = "score") -> DataFrame:
    """The chance that a positive outranks a negative, ties by half; null if a class is missing."""
    s = score_steps(df, keys, y, score)
    below = F.col("n_neg") - F.col("fp")  # negatives of smaller scores
    part = F.sum(F.col("pos") * (below + F.col("neg") * F.lit(0.5)).cast("double"))
    return s.groupBy(*keys).agg(F.round(F.try_divide(part, F.max(F.col("n_pos").cast("double") * F.col("n_neg"))), 9).alias("roc_auc"))


def average_precision(df: DataFrame, keys: list[str], y: str = "y", score: str = "score") -> DataFrame:
    """The step integral of precision over recall."""
    s = score_steps(df, keys, y, score)
    part = F.sum(F.col("pos") * F.col("tp").cast("double") / (F.col("tp") + F.col("fp")))
    return s.groupBy(*keys).agg(F.round(F.try_divide(part, F.max("n_pos").cast("double")), 9).alias("average_precision"))


def pr_trapezoid(df: DataFrame, keys: list[str], y: str = "y", score: str = "score") -> DataFrame:
    """The trapezoid integral of the same curve, begun at recall 0 and precision 1: another number than the step integral."""
    s = score_steps(df, keys, y, score).where("n_pos > 0")
    tp, seen = F.col("tp").cast("double"), F.col("tp") + F.col("fp")
    tp0, seen0 = tp - F.col("pos"), seen - F.col("pos") - F.col("neg")  # at the score before
    r, r0, p, p0 = tp / F.col("n_pos"), tp0 / F.col("n_pos"), tp / seen, F.coalesce(F.try_divide(tp0, seen0), F.lit(1.0))
    area = (r - r0) * (p + p0) / 2
    return s.withColumn("a", area).groupBy(*keys).agg(F.round(F.sum("a"), 9).alias("pr_auc"))


def brier(df: DataFrame, keys: list[str], y: str = "y", score: str = "score") -> DataFrame:
    return df.groupBy(*keys).agg(F.round(F.avg((F.col(score) - F.col(y)) * (F.col(score) - F.col(y))), 9).alias("brier"))


def roc_points(df: DataFrame, keys: list[str], y: str = "y", score: str = "score") -> DataFrame:
    """(x, y) points of the ROC curve per key, the origin included."""
    s = score_steps(df, keys, y, score)
    curve = s.select(*keys, (F.col("fp") / F.col("n_neg")).alias("x"), (F.col("tp") / F.col("n_pos")).alias("y"))
    return curve.unionByName(s.select(*keys).distinct().withColumn("x", F.lit(0.0)).withColumn("y", F.lit(0.0)))


def interpolate(curve: DataFrame, keys: list[str], grid: int) -> DataFrame:
    """``keys, i, x, y``: piecewise linear curves on ``i / grid``; of several points at one x the highest counts.

    Segments name the grid points they cover, so each is produced from its own segment: no range join.
    """
    top = curve.groupBy(*keys, "x").agg(F.max("y").alias("y"))
    seg = with_next(top, keys, ["x"], {"x": "x2", "y": "y2"})
    first, last = F.ceil(F.round(F.col("x") * grid, 9)).cast("int"), F.when(F.col("x2").isNull(), F.lit(grid)).otherwise(F.ceil(F.round(F.col("x2") * grid, 9)).cast("int") - 1)
    seg = seg.withColumn("a", first).withColumn("b", F.least(last, F.lit(grid))).where("a <= b").withColumn("i", F.explode(F.sequence("a", "b")))
    at = F.col("i") / F.lit(float(grid))
    value = F.coalesce(F.col("y") + F.try_divide((at - F.col("x")) * (F.col("y2") - F.col("y")), F.col("x2") - F.col("x")), F.col("y"))
    return seg.select(*keys, "i", at.alias("gx"), value.alias("gy"))


def calibration(df: DataFrame, bins: int, y: str = "y", score: str = "score") -> DataFrame:
    """``bin, n, mean_score, positive_share`` in equal bins of the score's unit interval."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(score), 9).alias("mean_score"), F.round(F.avg(F.col(y).cast("double")), 9).alias("positive_share"))


def quantile_bins(df: DataFrame, bins: int, y: str = "y", score: str = "score") -> DataFrame:
    """As ``calibration``, in bins between exact quantiles of the score; the edges are one row."""
    edges = quantiles(df, {"score": F.col(score)}, [i / bins for i in range(1, bins)]).agg(F.first("q").alias("edges"))
    x = df.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter("edges", lambda e: e <= F.col(score))))
    return x.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(score), 9).alias("mean_score"), F.round(F.avg(F.col(y).cast("double")), 9).alias("positive_share"))

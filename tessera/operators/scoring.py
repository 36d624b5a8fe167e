"""Scores of predicted against reference answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def yes_no_scores(df: DataFrame, pred: str, label: str) -> DataFrame:
    """One row of counts and scores over 1 / 0 columns; the small terms stand where the published scorer has them."""
    p, t, eps = F.col(pred) == 1, F.col(label) == 1, 1e-6
    c = df.agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & ~t).alias("tn"), F.count_if(~p & t).alias("fn"))
    d = {x: F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn")}
    n = d["tp"] + d["fp"] + d["tn"] + d["fn"]
    precision, recall = d["tp"] / (d["tp"] + d["fp"] + eps), d["tp"] / (d["tp"] + d["fn"] + eps)
    out = c.withColumn("p", precision).withColumn("r", recall)
    return out.select("tp", "fp", "tn", "fn", F.round("p", 9).alias("precision"), F.round("r", 9).alias("recall"), F.round(2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r") + eps), 9).alias("f1"), F.round(F.try_divide(d["tp"] + d["tn"], n), 9).alias("accuracy"), F.round(F.try_divide(d["tp"] + d["fp"], n), 9).alias("yes_ratio"))


def soft_accuracy(pred: Column, answers: Column) -> Column:
    """Leave-one-out agreement with ten answers, closed form in the number that equal the prediction. Raises for another number of answers."""
    m = F.size(F.filter(answers, lambda a: a == pred)).cast("double")
    value = (m * F.least(F.lit(1.0), (m - 1) / 3) + (10 - m) * F.least(F.lit(1.0), m / 3)) / 10
    return F.when(F.size(answers) == 10, value).otherwise(F.raise_error("ten answers are needed").cast("double"))


def exact_match(pred: Column, answers: Column) -> Column:
    return F.coalesce(F.array_contains(answers, pred), F.lit(False)).cast("int")


def anls(pred: Column, answers: Column) -> Column:
    """The best normalized edit similarity to any answer, 0 below one half; null if both texts are empty."""
    p = F.lower(F.regexp_replace(pred, r"^\s+|\s+$", ""))

    def one(a):
        b = F.lower(F.regexp_replace(a, r"^\s+|\s+$", ""))
        s = 1 - F.try_divide(F.levenshtein(p, b).cast("double"), F.greatest(F.length(p), F.length(b)))
        return F.when(s < 0.5, 0.0).otherwise(s)

    return F.array_max(F.transform(answers, one))


def bleu(df: DataFrame, pred: str, ref: str, id_col: str, order: int = 4) -> DataFrame:
    """One row: corpus BLEU over white-space words with clipped n-gram counts and the brevity penalty."""
    split = lambda c: F.filter(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), r"\s+"), lambda w: w != "")
    x = df.select(F.col(id_col).alias("id"), split(pred).alias("p"), split(ref).alias("r"))
    lengths = x.agg(F.sum(F.size("p")).alias("lp"), F.sum(F.size("r")).alias("lr"))

    def grams(side):
        ngrams = lambda n: F.when(F.size(side) >= n, F.transform(F.sequence(F.lit(1), F.size(side) - n + 1), lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.slice(side, i, n), " ").alias("g"))))
        every = F.flatten(F.filter(F.array(*[ngrams(n) for n in range(1, order + 1)]), lambda a: a.isNotNull()))
        return x.select("id", F.explode(every).alias("g")).select("id", "g.*").groupBy("id", "n", "g").agg(F.count(F.lit(1)).alias(f"c_{side}"))

    hit = grams("p").join(grams("r"), ["id", "n", "g"], "left")
    per = hit.groupBy("n").agg(F.sum(F.least("c_p", F.coalesce("c_r", F.lit(0)))).alias("m"), F.sum("c_p").alias("t"))
    total = per.agg(F.count(F.lit(1)).alias("k"), F.min("m").alias("least"), F.avg(F.log(F.greatest(F.col("m"), F.lit(1)).cast("double") / F.col("t"))).alias("lg")).crossJoin(lengths)
    penalty = F.when(F.col("lp") < F.col("lr"), F.exp(1 - F.col("lr").cast("double") / F.col("lp"))).otherwise(1.0)
    score = F.when((F.col("k") == order) & (F.col("least") > 0), penalty * F.exp("lg")).otherwise(0.0)
    return total.select(F.col("lp").alias("pred_words"), F.col("lr").alias("ref_words"), F.round(score, 9).alias("bleu"))


def annotated(results: DataFrame, notes: DataFrame, key: str, question: str, at: str | None = None) -> DataFrame:
    """Each result with its annotation's columns, joined on ``key`` and the lower-cased question.

    Of annotations that repeat a key the last by ``at`` counts, without it the largest. A result without an annotation is an error.
    """
    more = [c for c in notes.columns if c not in (key, question, at)]
    note = F.struct(*more)
    side = notes.groupBy(F.col(key).alias("_k"), F.lower(question).alias("_q")).agg((F.max_by(note, at) if at else F.max(note)).alias("_note"))
    got = results.join(side, (results[key] == F.col("_k")) & (F.lower(results[question]) == F.col("_q")), "left")
    note = F.when(F.col("_k").isNull(), F.raise_error(F.concat(F.lit("no annotation of "), F.col(key).cast("string")))).otherwise(F.col("_note"))
    return got.withColumn("_note", note).select(*results.columns, "_note.*")

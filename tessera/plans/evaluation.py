"""Ranking metrics, folds and fits over labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import folds, grid, metrics, models, sampling
from tessera.session import load

from .registry import query

SCORED = "WITH x AS (SELECT d.doc_id, d.source, CAST(quality AS BIGINT) AS y, CAST(d.doc_id % 5 AS BIGINT) AS fold, CAST(least(n_chars, 3000) // 100 AS DOUBLE) / 30 AS score FROM documents d JOIN labels USING (doc_id))"
STEPS = SCORED + """, s AS (SELECT fold, score, count_if(y = 1) AS pos, count_if(y <> 1) AS neg FROM x GROUP BY ALL)
, c AS (SELECT *, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, sum(pos) OVER e AS np, sum(neg) OVER e AS nn FROM s WINDOW d AS (PARTITION BY fold ORDER BY score DESC), e AS (PARTITION BY fold))
"""


def scored(spark, d):
    x = load(spark, d, "documents").join(load(spark, d, "labels"), "doc_id")
    score = F.floor(F.least("n_chars", F.lit(3000)) / 100).cast("double") / 30
    return x.select("doc_id", "source", F.col("quality").cast("long").alias("y"), (F.col("doc_id") % 5).alias("fold"), score.alias("score"))


CONFUSION = "count_if(score >= 0.5 AND y = 1) AS tp, count_if(score < 0.5 AND y <> 1) AS tn, count_if(score >= 0.5 AND y <> 1) AS fp, count_if(score < 0.5 AND y = 1) AS fn"
RATIOS = "round(CAST(tp+tn AS DOUBLE)/(tp+tn+fp+fn),9) AS accuracy, round(coalesce(CAST(tp AS DOUBLE)/nullif(tp+fn,0),0),9) AS sensitivity, round(coalesce(CAST(tn AS DOUBLE)/nullif(tn+fp,0),0),9) AS specificity, round(coalesce(CAST(tp AS DOUBLE)/nullif(tp+fp,0),0),9) AS precision, round(coalesce(2.0::DOUBLE*tp/nullif(2*tp+fp+fn,0),0),9) AS f1"


@query(SCORED + f", c AS (SELECT fold, {CONFUSION} FROM x GROUP BY 1) SELECT fold, tp, tn, fp, fn, {RATIOS} FROM c")
def confusion(spark, d):
    return metrics.confusion(scored(spark, d), ["fold"])


@query(SCORED + ", r AS (SELECT fold, y, rank() OVER (PARTITION BY fold ORDER BY score) + (count(*) OVER (PARTITION BY fold, score) - 1) / 2.0::DOUBLE AS rk FROM x) SELECT fold, round((sum(CASE WHEN y = 1 THEN rk ELSE 0.0::DOUBLE END) - count_if(y = 1) * (count_if(y = 1) + 1) / 2.0::DOUBLE) / (CAST(count_if(y = 1) AS DOUBLE) * count_if(y <> 1)), 9) AS roc_auc FROM r GROUP BY 1")
def roc_auc(spark, d):
    return metrics.roc_auc(scored(spark, d), ["fold"])


@query(STEPS + "SELECT fold, round(sum(CAST(pos AS DOUBLE) / np * tp / (tp + fp)), 9) AS average_precision FROM c GROUP BY 1")
def avg_precision(spark, d):
    return metrics.average_precision(scored(spark, d), ["fold"])


@query(STEPS + ", p AS (SELECT fold, score, CAST(tp AS DOUBLE)/np AS r, CAST(tp AS DOUBLE)/(tp+fp) AS p FROM c), t AS (SELECT fold, (r - lag(r,1,0.0::DOUBLE) OVER w) * (p + lag(p,1,1.0::DOUBLE) OVER w) / 2 AS a FROM p WINDOW w AS (PARTITION BY fold ORDER BY score DESC)) SELECT fold, round(sum(a), 9) AS pr_auc FROM t GROUP BY 1")
def pr_trapezoid(spark, d):
    return metrics.pr_trapezoid(scored(spark, d), ["fold"])


@query(SCORED + " SELECT fold, round(avg((score - y) * (score - y)), 9) AS brier FROM x GROUP BY 1")
def brier(spark, d):
    return metrics.brier(scored(spark, d), ["fold"])


AUC = SCORED + ", r AS (SELECT fold, y, rank() OVER (PARTITION BY fold ORDER BY score) + (count(*) OVER (PARTITION BY fold, score) - 1) / 2.0::DOUBLE AS rk FROM x), a AS (SELECT fold, round((sum(CASE WHEN y = 1 THEN rk ELSE 0.0::DOUBLE END) - count_if(y = 1) * (count_if(y = 1) + 1) / 2.0::DOUBLE) / (CAST(count_if(y = 1) AS DOUBLE) * count_if(y <> 1)), 9) AS v FROM r GROUP BY 1)"


@query(AUC + " SELECT count(*) AS n_folds, round(avg(v),8) AS mean_auc, min(v) AS min_auc, max(v) AS max_auc, round(coalesce(stddev_samp(v),0),8) AS std_auc FROM a")
def fold_summary(spark, d):
    """Spread over folds, sample deviation, 0 for a single fold."""
    a = metrics.roc_auc(scored(spark, d), ["fold"])
    v = F.col("roc_auc")
    return a.agg(F.count(F.lit(1)).alias("n_folds"), F.round(F.avg(v), 8).alias("mean_auc"), F.min(v).alias("min_auc"), F.max(v).alias("max_auc"), F.round(F.coalesce(F.stddev_samp(v), F.lit(0.0)), 8).alias("std_auc"))


@query(AUC + " SELECT count_if(fold <> 2) AS n_ran, count_if(fold = 2) AS n_skipped, round(avg(v) FILTER (fold <> 2),8) AS mean_auc, round(stddev_pop(v) FILTER (fold <> 2),8) AS std_auc FROM a")
def probe_summary(spark, d):
    """As the other summary over the folds that ran, population deviation."""
    a = metrics.roc_auc(scored(spark, d), ["fold"])
    v = F.when(F.col("fold") != 2, F.col("roc_auc"))
    return a.agg(F.count_if(F.expr("fold <> 2")).alias("n_ran"), F.count_if(F.expr("fold = 2")).alias("n_skipped"), F.round(F.avg(v), 8).alias("mean_auc"), F.round(F.stddev_pop(v), 8).alias("std_auc"))


@query(STEPS + "SELECT fold, round(score, 9) AS score, round(CAST(fp AS DOUBLE)/nn, 9) AS fpr, round(CAST(tp AS DOUBLE)/np, 9) AS tpr FROM c")
def roc_curve(spark, d):
    s = metrics.score_steps(scored(spark, d), ["fold"])
    return s.select("fold", F.round("score", 9).alias("score"), F.round(F.col("fp") / F.col("n_neg"), 9).alias("fpr"), F.round(F.col("tp") / F.col("n_pos"), 9).alias("tpr"))


@query(
    STEPS
    + """, p AS (SELECT fold, CAST(fp AS DOUBLE)/nn AS x, CAST(tp AS DOUBLE)/np AS y FROM c UNION ALL SELECT DISTINCT fold, 0.0::DOUBLE, 0.0::DOUBLE FROM c)
, t AS (SELECT fold, x, max(y) AS y FROM p GROUP BY ALL), g AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM t WINDOW w AS (PARTITION BY fold ORDER BY x))
, q AS (SELECT CAST(i AS INT) AS i, i / 20.0::DOUBLE AS gx FROM range(21) r(i))
, v AS (SELECT fold, i, gx, coalesce(y + (gx - x) * (y2 - y) / (x2 - x), y) AS gy FROM q JOIN g ON round(gx, 9) >= round(x, 9) AND (x2 IS NULL OR round(gx, 9) < round(x2, 9)))
SELECT i, round(gx, 9) AS fpr, round(avg(gy), 8) AS mean_tpr, round(stddev_pop(gy), 8) AS std_tpr, count(*) AS n FROM v GROUP BY ALL
"""
)
def roc_interp(spark, d):
    """The curves of all folds on one grid: mean and population deviation per point."""
    g = metrics.interpolate(metrics.roc_points(scored(spark, d), ["fold"]), ["fold"], 20)
    return g.groupBy("i", F.round("gx", 9).alias("fpr")).agg(F.round(F.avg("gy"), 8).alias("mean_tpr"), F.round(F.stddev_pop("gy"), 8).alias("std_tpr"), F.count(F.lit(1)).alias("n"))


@query(SCORED + " SELECT CAST(least(floor(score * 10), 9) AS INT) AS bin, count(*) AS n, round(avg(score), 9) AS mean_score, round(avg(CAST(y AS DOUBLE)), 9) AS positive_share FROM x GROUP BY 1")
def calibration(spark, d):
    return metrics.calibration(scored(spark, d), 10)


@query(SCORED + ", e AS (SELECT quantile_cont(score, [0.2, 0.4, 0.6, 0.8]) AS q FROM x) SELECT CAST(len(list_filter(q, lambda v: v <= score)) AS INT) AS bin, count(*) AS n, round(avg(score), 9) AS mean_score, round(avg(CAST(y AS DOUBLE)), 9) AS positive_share FROM x, e GROUP BY 1")
def quantile_calibration(spark, d):
    return metrics.quantile_bins(scored(spark, d), 5)


@query(SCORED + " SELECT y, count(*) AS n, round(CAST((SELECT count(*) FROM x) AS DOUBLE) / (2 * count(*)), 9) AS weight FROM x GROUP BY 1")
def class_weights(spark, d):
    x = scored(spark, d).groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    total = x.agg(F.sum("n").alias("t"))
    return x.crossJoin(F.broadcast(total)).select("y", "n", F.round(F.col("t") / (2 * F.col("n")), 9).alias("weight"))  # one row


@query(SCORED + ", t AS (SELECT count(*) AS n, count(DISTINCT source) AS g FROM x) SELECT fold, count(*) AS n, count_if(y = 1) AS n_pos, count_if(y <> 1) AS n_neg, count(DISTINCT source) AS n_groups, t.n - count(*) AS n_train, (SELECT count(DISTINCT b.source) FROM x b WHERE b.fold <> a.fold) AS n_train_groups FROM x a, t GROUP BY fold, t.n")
def fold_table(spark, d):
    return folds.fold_table(scored(spark, d), "source", "y")


@query(SCORED + " SELECT CAST(5 AS BIGINT) AS n_folds, (SELECT count(*) FROM x) AS n_rows, (SELECT count(DISTINCT source) FROM x) AS n_groups, (SELECT count_if(y = 1) FROM x) AS n_pos, CAST(0 AS BIGINT) AS n_leaking, true AS stratified, true AS even")
def fold_leakage(spark, d):
    """Folds by source: every row has one, no source is in two, each fold's share of positives is within 0.1 of the whole's, and
    no two folds differ in rows by more than the largest source."""
    x = folds.grouped_folds(scored(spark, d).drop("fold"), "source", "y", 5)
    leak = folds.leaking_groups(x, "source").agg(F.count(F.lit(1)).alias("n_leaking"))
    per = x.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("share"), F.count_if(F.col("y") == 1).alias("pos"))
    largest = x.groupBy("source").count().agg(F.max("count").alias("largest"))
    whole = per.agg(F.count(F.lit(1)).alias("n_folds"), F.sum("n").alias("n_rows"), F.sum("pos").alias("n_pos"), F.max(F.struct("share")).alias("hi"), F.min(F.struct("share")).alias("lo"), (F.max("n") - F.min("n")).alias("gap"))
    groups = x.agg(F.count_distinct("source").alias("n_groups"))
    share = F.col("n_pos") / F.col("n_rows")
    got = whole.crossJoin(groups).crossJoin(leak).crossJoin(largest)  # one row each
    return got.select("n_folds", "n_rows", "n_groups", "n_pos", "n_leaking", ((F.col("hi.share") - share <= 0.1) & (share - F.col("lo.share") <= 0.1)).alias("stratified"), (F.col("gap") <= F.col("largest")).alias("even"))


@query()
def grouped_folds(spark, d):
    x = folds.grouped_folds(scored(spark, d).drop("fold"), "source", "y", 5)
    return x.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("y"), 6).alias("positive_share"))


@query()
def logreg_probe(spark, d):
    """Held-out quality per fold of a balanced L2 model of one label against the rest."""
    e = load(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), (F.col("label") == 0).cast("int").alias("y"), (F.col("vec_id") % 3).alias("fold"))
    got = models.cross_validate(e, "v", "y", "fold")
    return metrics.roc_auc(got, ["fold"]).join(metrics.pr_trapezoid(got, ["fold"]), "fold")


@query()
def elastic_net(spark, d):
    """Held-out quality per fold of the elastic net whose C and l1 ratio (ten by five) three grouped inner folds chose."""
    e = load(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 40).alias("series"), F.col("embedding").cast("array<double>").alias("v"), (F.col("label") < 3).cast("int").alias("y"))
    got = grid.nested(e, "v", "y", "series", rounds=100)
    return metrics.average_precision(got, ["fold", "c", "l1_ratio"]).join(metrics.roc_auc(got, ["fold"]), "fold")


@query()
def pca_var(spark, d):
    """Shares of variance and the scores' own variances, which are in the same proportion."""
    e = load(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    scored, shares = models.principal_components(e, "v", 10)
    own = scored.select(F.posexplode("scores").alias("component", "score")).groupBy("component").agg(F.var_pop("score").alias("variance"))
    return own.select("component", "variance", F.element_at(F.array(*[F.lit(float(s)) for s in shares]), F.col("component") + 1).alias("share"))


#: Samples of the drawn maps, as published: all pairs of them are looked at by one machine.
DRAWN = 2000


@query()
def linkage(spark, d):
    """Leaf order by average linkage on 1 - r of a draw of samples, all of them if they are fewer."""
    import numpy as np

    e = sampling.draw(load(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id", DRAWN, 7).orderBy("vec_id").collect()
    ids, x = [r.vec_id for r in e], np.array([r.embedding for r in e], float).reshape(len(e), -1)
    merges = models.average_linkage(1 - np.corrcoef(x))
    return spark.createDataFrame([(ids[k], i) for i, k in enumerate(models.leaf_order(merges))], "vec_id long, leaf int")


@query()
def tsne_map(spark, d):
    """A map of a draw of samples, by their first principal components over all samples."""
    import numpy as np

    e = load(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    scored, _ = models.principal_components(e, "v", 50)
    rows = sampling.draw(scored.select("vec_id", "scores"), "vec_id", DRAWN, 7).orderBy("vec_id").collect()
    y = models.tsne(np.array([r.scores for r in rows], float), 30.0, 100)
    return spark.createDataFrame([(r.vec_id, float(a), float(b)) for r, (a, b) in zip(rows, y)], "vec_id long, x double, y double")

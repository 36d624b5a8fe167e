"""Runs of named steps with manifests, reports, saved models, the predict seam."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.session import load, shared_path
from tessera.sources import readers, writers

from . import steps
from .registry import query


@query(
    """
SELECT 'qc' AS step, 'ok' AS status, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS n_rows UNION ALL SELECT 'labels', 'ok', (SELECT count(*) FROM documents JOIN labels USING (doc_id))
UNION ALL SELECT 'missing', 'error', NULL UNION ALL SELECT 'summary', 'ok', (SELECT count(DISTINCT source) FROM documents)
"""
)
def step_manifest(spark, d):
    """A run that goes on after a step fails; its manifest, written as JSON and read again."""
    run, out = steps.Steps(stop_on_error=False), shared_path(spark, "run")

    @run.step("qc")
    def qc(results):
        return load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("n")).count()

    @run.step("labels")
    def labels(results):
        return load(spark, d, "documents").join(load(spark, d, "labels"), "doc_id").count()

    @run.step("missing")
    def missing(results):
        return load(spark, d, "no_such_table").count()

    @run.step("summary")
    def summary(results):
        return load(spark, d, "documents").select("source").distinct().count()

    results = run.run()
    rows = [(name, m["status"], results.get(name)) for name, m in run.manifest.items()]
    writers.json_lines(spark.createDataFrame(rows, "step string, status string, n_rows long"), f"{out}/manifest")
    return spark.read.schema("step string, status string, n_rows long").json(f"{out}/manifest")


_SECTIONS = """
WITH l AS (SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS c FROM documents GROUP BY 1), q AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1)
, t AS (
  SELECT 0 AS s, 0 AS k, '' AS o, '## Documents' AS line UNION ALL SELECT 0, 1, '', '| lang | n | characters |' UNION ALL SELECT 0, 2, '', '|---|---|---|' UNION ALL SELECT 0, 3, lang, '| ' || lang || ' | ' || n || ' | ' || c || ' |' FROM l
  UNION ALL SELECT 1, 0, '', '## Labels' UNION ALL SELECT 1, 1, '', '| quality | n |' UNION ALL SELECT 1, 2, '', '|---|---|' UNION ALL SELECT 1, 3, CAST(quality AS VARCHAR), '| ' || quality || ' | ' || n || ' |' FROM q
)
SELECT CAST(row_number() OVER (ORDER BY s, k, o) - 1 AS INTEGER) AS at, line FROM t
"""


@query(_SECTIONS)
def report_lines(spark, d):
    """A Markdown report of two tables, as its lines."""
    langs = load(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("characters")).orderBy("lang")
    quality = load(spark, d, "labels").groupBy("quality").agg(F.count(F.lit(1)).alias("n")).orderBy("quality")
    text = writers.report([("Documents", langs), ("Labels", quality)])
    return spark.createDataFrame(list(enumerate(x for x in text.split("\n") if x)), "at int, line string")


@query("SELECT count(*) AS n, count(*) AS n_equal, CAST(10 AS BIGINT) AS n_labels FROM embeddings")
def saved_model(spark, d):
    """A fitted pipeline saved, loaded again and applied: the same predictions."""
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector

    e = load(spark, d, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("raw"), F.col("label").cast("double").alias("label"))
    fitted = Pipeline(stages=[StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(maxIter=5)]).fit(e)
    out = shared_path(spark, "model")
    fitted.write().overwrite().save(out)
    one = fitted.transform(e).select("vec_id", F.col("prediction").alias("a"))
    two = PipelineModel.load(out).transform(e).select("vec_id", F.col("prediction").alias("b"))
    labels = e.agg(F.count_distinct("label").alias("n_labels"))
    return one.join(two, "vec_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") == F.col("b")).alias("n_equal")).crossJoin(labels)  # one row each


@query("SELECT vec_id, round(list_aggregate(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), 'avg'), 6) AS pooled, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS top FROM embeddings")
def pooled_features(spark, d):
    """The seam for a frozen encoder: a function over batches of rows, here mean pooling and the largest component."""
    import numpy as np

    def encode(pdf):
        x = np.array(pdf.embedding.tolist(), np.float64).reshape(len(pdf), -1)
        return pdf.assign(pooled=x.mean(axis=1).round(6), top=x.argmax(axis=1))[["vec_id", "pooled", "top"]]

    return steps.predict(load(spark, d, "embeddings").select("vec_id", "embedding"), encode, 128, "vec_id long, pooled double, top int")


@query("SELECT conv_id, CAST(8 AS INTEGER) AS width, CASE WHEN conv_id % 4 = 0 THEN CAST(sum(length(text)) AS DOUBLE) * 8 ELSE 0.0::DOUBLE END AS total FROM conversations GROUP BY conv_id")
def image_tensor(spark, d):
    """Image features of a fixed width, zeros for conversations without an image."""
    c = load(spark, d, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).cast("double").alias("n"))
    tensor = F.when(F.col("conv_id") % 4 == 0, F.array_repeat("n", 8)).otherwise(F.array_repeat(F.lit(0.0), 8))
    return c.select("conv_id", tensor.alias("t")).select("conv_id", F.size("t").alias("width"), F.aggregate("t", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("SELECT round(avg(CAST(quality AS DOUBLE)), 6) AS value FROM labels")
def reference_scalar(spark, d):
    """A number of an earlier run's summary: the first file that is there, the first key that it has."""
    out = shared_path(spark, "summaries")
    load(spark, d, "labels").agg(F.round(F.avg(F.col("quality").cast("double")), 6).alias("mean_auc"), F.count(F.lit(1)).alias("n")).write.json(f"{out}/second")
    value = readers.first_scalar(spark, [f"{out}/first", f"{out}/second"], ["auc", "mean_auc", "n"])
    return spark.createDataFrame([(value,)], "value double")

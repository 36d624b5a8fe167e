"""Job 1: intake of new samples into a labelled cohort, incremental.

    python -m jobs.cohort_intake --samples DIR --out DIR --checkpoint DIR [--config FILE] [--master M]

New files of sample metadata land in a folder. Each run takes those that it has not seen (a file stream with a
checkpoint, all that is available), and labels each sample: the first disease category in order of priority, all that match,
the subtype of samples of the subtyped category, and the key of its person. Below ``out``:

- ``labels``, Parquet by ``batch`` and ``category``: a row per sample.
- ``refused``, Parquet by ``batch``: rows without an id.
- ``counts``, Parquet by ``batch``: partial counts of each batch by category and series, some rows a batch.
- ``report``, one JSON file: per category samples, series, samples of several categories and resolved persons' samples.
  It adds up ``counts``, so that its cost grows with batches and not with samples.

A batch that was written but not yet marked as done is taken again under its old number after a restart, and dynamic partition
overwrite puts it in the place of the first writing: nothing is lost or counted twice. A run without new files changes
nothing. Nulls in text columns count as empty. Samples that land twice count twice, as two samples. Files must land whole and
under a new name each.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common
from tessera.functions import entity, nets

DEFAULTS = {
    "id": "doc_id", "series": "source", "text": ["text"], "measure": "n_chars", "format": "parquet", "schema": None, "files_per_batch": 64,
    "nets": {}, "subtyped": "cardiovascular", "subtypes": nets.SUBTYPE_NETS,
}
COUNTS = "category string, series string, n bigint, n_multi bigint, n_resolved bigint, measure bigint, batch bigint"
LABELS = "doc_id bigint, series string, measure bigint, n_matched int, matched array<string>, subtype string, person string, resolved boolean, batch bigint, category string"


def categories(config: dict) -> dict:
    """The config's nets before the built-in ones, in order of priority."""
    return {**{k: tuple(v) for k, v in config["nets"].items()}, **nets.DISEASE_NETS}


def label(rows: DataFrame, config: dict) -> DataFrame:
    """The labels of samples that have an id."""
    hay = nets.haystack(*[F.col(c) for c in config["text"]])
    body = F.concat_ws(", ", *[F.coalesce(F.col(c), F.lit("")) for c in config["text"]])
    series, pid = F.coalesce(F.col(config["series"]), F.lit("")), entity.patient_id(body)
    got = rows.withColumn("_hay", hay).select(
        F.col(config["id"]).cast("bigint").alias("doc_id"), series.alias("series"), F.col(config["measure"]).cast("bigint").alias("measure"),
        nets.all_matches_of_lower(F.col("_hay"), categories(config)).alias("matched"), nets.all_matches_of_lower(F.col("_hay"), config["subtypes"]).alias("subtypes"), pid.alias("pid"),
    )
    subtype = F.coalesce(F.get("subtypes", F.lit(0)), F.lit(nets.UNRESOLVED))
    category = F.coalesce(F.get("matched", F.lit(0)), F.lit(nets.UNLABELED))
    return got.select(
        "doc_id", "series", "measure", F.size("matched").alias("n_matched"), "matched", F.when(category == config["subtyped"], subtype).alias("subtype"),
        entity.patient_key(F.col("series"), F.col("pid"), F.col("doc_id").cast("string"), F.col("doc_id")).alias("person"), (F.col("pid").isNotNull() & (F.col("series") != "")).alias("resolved"), category.alias("category"),
    )


def take_batch(rows: DataFrame, batch: int, out: str, config: dict) -> tuple[int, int]:
    """Writes a batch's labels, refused rows and partial counts, each in the place of an earlier writing of the same batch.

    Returns how many rows were labelled and refused."""
    spark = rows.sparkSession
    own = F.lit(batch).cast("bigint").alias("batch")
    known = F.col(config["id"]).isNotNull()

    def put(df: DataFrame, name: str, *by: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", *by).parquet(f"{out}/{name}")

    def written(name: str, schema: str) -> DataFrame:
        """The batch's own folder only: the cost of a batch does not grow with those before it."""
        try:
            return spark.read.schema(schema).option("basePath", f"{out}/{name}").parquet(f"{out}/{name}/batch={batch}")
        except AnalysisException as e:  # a batch without such rows has no folder
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], schema)

    put(label(rows.where(known), config).select("*", own), "labels", "category")
    # Rows of one batch are counted from what was written, so that texts are read and matched once.
    counts = written("labels", LABELS).groupBy("category", "series").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_matched") > 1).alias("n_multi"), F.count_if("resolved").alias("n_resolved"), F.sum("measure").alias("measure"))
    put(counts.select("*", own), "counts")
    n = written("counts", COUNTS).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    put(rows.where(~known).select(F.to_json(F.struct("*")).alias("row"), own), "refused")
    refused = written("refused", "row string, batch bigint").count()
    common.LOG.info("batch %d: %d samples labelled, %d refused, in %s", batch, n, refused, out)
    return n, refused


def report(spark: SparkSession, out: str) -> DataFrame:
    """``category, n_samples, n_series, n_multi, n_resolved, measure`` out of the batches' partial counts."""
    counts = spark.read.schema(COUNTS).parquet(f"{out}/counts")
    return counts.groupBy("category").agg(F.sum("n").alias("n_samples"), F.count_distinct("series").alias("n_series"), F.sum("n_multi").alias("n_multi"), F.sum("n_resolved").alias("n_resolved"), F.sum("measure").alias("measure"))


def run(spark: SparkSession, samples: str, out: str, checkpoint: str, config: dict) -> DataFrame:
    """Takes what is new below ``samples``, then writes the report; returns all labels. ``config`` as DEFAULTS."""
    for name, kind, by in (("labels", LABELS, ["batch", "category"]), ("counts", COUNTS, ["batch"]), ("refused", "row string, batch bigint", ["batch"])):
        spark.createDataFrame([], kind).write.mode("append").partitionBy(*by).parquet(f"{out}/{name}")  # so that a first run without files has tables, too
    # Without a schema in the config that of what lies there; as a pattern the path may be a folder or a single file.
    schema = config["schema"] or spark.read.format(config["format"]).load(samples).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["files_per_batch"]).format(config["format"]).load(samples[:-1] + f"[{samples[-1]}]")
    done: list[tuple[int, int]] = []
    taken = stream.writeStream.foreachBatch(lambda df, batch: done.append(take_batch(df, batch, out, config))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    taken.awaitTermination()
    common.LOG.info("read %d new rows in %d batches: %s", sum(map(sum, done)), len(done), samples)
    labels = spark.read.schema(LABELS).parquet(f"{out}/labels")
    summary = report(spark, out)
    summary.coalesce(1).write.mode("overwrite").json(f"{out}/report")  # a row per category
    common.log_table("wrote the report of", f"{out}/report", summary, spark.read.schema(summary.schema).json(f"{out}/report").count())
    return labels


def main(argv: list[str] | None = None) -> None:
    args = common.command_line(argv, __file__, __doc__.split("\n")[0], {"samples": "folder that files land in", "out": "output folder", "checkpoint": "folder of the stream's checkpoint"})
    spark = common.session("cohort_intake", args.master)
    try:
        run(spark, args.samples.rstrip("/"), args.out.rstrip("/"), args.checkpoint, common.read_config(spark, args.config, DEFAULTS))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()

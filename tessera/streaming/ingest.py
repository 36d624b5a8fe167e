"""Streams over landing directories: incremental labels, windowed counts, de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import nets


def landing(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def label_stream(stream: DataFrame, text: str, table: dict) -> DataFrame:
    """The stateless label columns on a stream."""
    hay = F.lower(F.coalesce(F.col(text), F.lit("")))
    return stream.withColumn("category", nets.first_match(hay, table)).withColumn("n_matched", F.size(nets.all_matches(hay, table)))


def windowed_counts(stream: DataFrame, ts: str, key: str, value: str, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts and sums per event-time window and key, windows ``slide`` apart (their width, if None); in append mode rows later
    than the watermark are dropped by Spark."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width, slide).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def session_counts(stream: DataFrame, ts: str, key: str, value: str, gap: str, late: str) -> DataFrame:
    """Counts and sums per key and session: events that follow each other by less than ``gap``."""
    got = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return got.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total")


def first_arrivals(stream: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    """The stream without repeats of ``keys`` that come within ``late`` of each other in event time; state older than that is let go."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Processes what has landed, then stops; a rerun with the same checkpoint goes on from there."""
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def run_totals(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Processes what has landed; ``out`` holds the totals over all that came so far, replaced by every batch."""
    q = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()


#: The mergeable sums of the first pass.
_SUMS = "n bigint, total double, squares double, batch bigint"


def land_sums(stream: DataFrame, key: str, value: str, sums: str, checkpoint: str) -> None:
    """The first of two passes: per batch and key the number of values, their sum and the sum of their squares, below ``sums``.

    A batch that is taken again replaces its own sums, so nothing counts twice; a new file costs its own rows only.
    """

    def take(rows: DataFrame, batch: int) -> None:
        v = F.col(value).cast("double")
        part = rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("total"), F.sum(v * v).alias("squares"), F.lit(batch).cast("bigint").alias("batch"))
        part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(sums)

    stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def standardized(landed: DataFrame, key: str, value: str, sums: str) -> DataFrame:
    """The second pass: ``landed`` with ``z``, by the mean and population deviation of all that the first pass has taken.

    A late file changes the sums and with them every row of its keys, so this pass maps what has landed so far when it is read.
    """
    spark = landed.sparkSession
    kind = landed.schema[key].dataType.simpleString()
    s = spark.read.schema(f"`{key}` {kind}, {_SUMS}").parquet(sums).groupBy(key).agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")])
    mean = F.col("total") / F.col("n")
    dev = F.sqrt(F.greatest(F.col("squares") / F.col("n") - mean * mean, F.lit(0.0)))
    s = s.select(F.col(key).alias("_k"), mean.alias("_mean"), F.when(dev > 0, dev).otherwise(1.0).alias("_dev"))
    got = landed.join(s, landed[key].eqNullSafe(s["_k"]), "left")
    return got.withColumn("z", (F.col(value) - F.col("_mean")) / F.col("_dev")).drop("_k", "_mean", "_dev")

"""A synthetic count corpus, from hashes of row numbers: the same rows on any cluster, for tests and demos."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def unit(*parts) -> F.Column:
    """A number in [0, 1) from a hash of its parts."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 30)).cast("double") / (1 << 30)


def _ids(spark: SparkSession, n: int | DataFrame) -> DataFrame:
    """``sample_index``: 0 to n - 1, or the ids of a one-column table."""
    return spark.range(n).toDF("sample_index") if isinstance(n, int) else n.toDF("sample_index")


def samples(spark: SparkSession, n: int | DataFrame, positive: float = 0.1, seed: int = 1) -> DataFrame:
    """Sample metadata: accession, series of 25, title, tissue, characteristics, date, single-cell probability."""
    i, s = F.col("sample_index"), F.lit(seed)
    hit = unit(i, s) < positive
    tissue = F.element_at(F.array(*[F.lit(t) for t in ("blood", "brain", "liver", "muscle")]), (F.floor(unit(i, s + 1) * 4) + 1).cast("int"))
    return _ids(spark, n).select(
        "sample_index",
        F.concat(F.lit("GSM"), (i + 1_000_000).cast("string")).alias("geo_accession"),
        F.concat(F.lit("GSE"), (F.floor(i / 25) + 200_000).cast("string")).alias("series_id"),
        F.when(hit, "heart failure cohort").otherwise("control cohort").alias("title"),
        tissue.alias("source_name_ch1"),
        F.concat(F.lit("tissue: "), tissue, F.lit(", subject id: P"), F.floor(i / 2).cast("string")).alias("characteristics_ch1"),
        F.date_format(F.date_add(F.lit("2012-01-01").cast("date"), F.floor(unit(i, s + 2) * 4700).cast("int")), "yyyy-MM-dd").alias("submission_date"),
        F.pow(unit(i, s + 3), F.lit(6)).alias("singlecellprobability"),
    )


def counts(spark: SparkSession, n_genes: int, n_samples: int | DataFrame, seed: int = 1) -> DataFrame:
    """``sample_index, gene_idx, count``: skewed gene means times sample depth, zeros left out."""
    cells = _ids(spark, n_samples).select("sample_index", F.explode(F.sequence(F.lit(0), F.lit(n_genes - 1))).alias("gene_idx"))
    mean = F.exp(unit("gene_idx", F.lit(seed + 4)) * 6 - 2) * (0.5 + unit("sample_index", F.lit(seed + 5)))
    drawn = F.floor(-F.log(1 - unit("sample_index", "gene_idx", F.lit(seed))) * mean).cast("int")
    return cells.withColumn("count", drawn).where("count > 0")

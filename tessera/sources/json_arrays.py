"""JSON arrays of objects, read and written in parts: no task holds a file, and no driver plans its bytes.

Spark's text source cuts files at every ``}`` into pieces, in as many tasks as a file has splits. Where an element of the
array ends depends on all that stands before, but only by two numbers: whether a string is open and how many brackets
are. Each piece says what it does to them if it starts outside and if it starts inside a string; sums along a split, and
sums over splits (a row each), then give both numbers at every piece. Pieces of one element are put together and parsed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.ordered import with_row_numbers
from tessera.session import shared_path


def _brackets(text) -> F.Column:
    """Opening less closing brackets of text without strings."""
    count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    return count("{") + count("[") - count("}") - count("]")


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """``file, split, at, piece, quotes, out, within``: what stands between two ``}``, with the closing one, in the files' order.

    ``quotes``: quotation marks that open or close a string; ``out`` and ``within``: the change of open brackets if the piece starts
    outside or inside a string.
    """
    meta = [F.col(f"_metadata.{c}").alias(a) for c, a in (("file_path", "file"), ("file_block_start", "split"), ("file_size", "size"))]
    raw = spark.read.option("lineSep", "}").option("recursiveFileLookup", True).text(path).select(*meta, F.monotonically_increasing_id().alias("at"), F.col("value").alias("piece"))
    target = shared_path(spark, "json_pieces")
    raw.write.parquet(target)
    raw = spark.read.schema(raw.schema).parquet(target)
    # A file that doesn't end with } has a last piece without one.
    ends = raw.groupBy("file").agg(F.max(F.struct("split", "at")).alias("last"), (F.sum(F.octet_length("piece") + 1) == F.max("size")).alias("closed")).select(F.col("file").alias("_f"), F.col("last.at").alias("_at"), "closed")
    got = raw.join(ends, (raw["file"] == F.col("_f")) & (raw["at"] == F.col("_at")), "left")
    got = got.withColumn("piece", F.when(F.coalesce("closed", F.lit(True)), F.concat("piece", F.lit("}"))).otherwise(F.col("piece")))
    plain = F.regexp_replace("piece", r"\\.", "")  # escaped marks open and close nothing
    got = got.withColumn("_p", plain)
    quotes = F.length("_p") - F.length(F.replace("_p", F.lit('"'), F.lit("")))
    bare = lambda text: F.regexp_replace(text, r'"[^"]*+(?:"|$)', "")
    inside = bare(F.regexp_replace("_p", r'^[^"]*+(?:"|$)', ""))
    return got.select("file", "split", "at", "piece", quotes.alias("quotes"), _brackets(bare(F.col("_p"))).alias("out"), _brackets(inside).alias("within"))


def elements(spark: SparkSession, path: str) -> DataFrame:
    """``number, json``: the elements of the arrays below ``path``, in the order of files and places, from 0.

    A folder's files are read as one text in the order of their names: each may be an array, or all of them together one.
    Raises for text that isn't a sequence of arrays of objects.
    """
    along = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    got = pieces(spark, path).withColumn("_q", F.coalesce(F.sum("quotes").over(along), F.lit(0)) % 2)
    got = got.withColumn("d0", F.when(F.col("_q") == 0, F.col("out")).otherwise(F.col("within"))).withColumn("d1", F.when(F.col("_q") == 0, F.col("within")).otherwise(F.col("out")))
    splits = got.groupBy("file", "split").agg(F.sum("quotes").alias("q"), F.sum("d0").alias("s0"), F.sum("d1").alias("s1"))
    before = Window.orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1)  # a row per split of a file
    splits = splits.withColumn("odd", F.coalesce(F.sum("q").over(before), F.lit(0)) % 2)
    splits = splits.withColumn("s", F.when(F.col("odd") == 0, F.col("s0")).otherwise(F.col("s1")))
    splits = splits.withColumn("base", F.coalesce(F.sum("s").over(before), F.lit(0))).select("file", "split", "odd", "base")
    upto = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    got = got.join(splits, ["file", "split"]).withColumn("d", F.when(F.col("odd") == 0, F.col("d0")).otherwise(F.col("d1")))
    got = got.withColumn("depth", F.col("base") + F.sum("d").over(upto)).withColumn("string", (F.col("_q") + F.col("odd") + F.col("quotes")) % 2)
    # An element closes where a } leaves just the array open.
    got = got.withColumn("ends", ((F.col("depth") == 1) & (F.col("string") == 0) & F.endswith("piece", F.lit("}"))).cast("long"))
    target = shared_path(spark, "json_depths")
    got = got.select("file", "split", "at", "piece", "depth", "string", "ends")
    got.write.parquet(target)
    got = spark.read.schema(got.schema).parquet(target)
    last = got.agg(F.max(F.struct("file", "split", "at", "depth", "string")).alias("x"), F.min("depth").alias("least")).first()
    if last.x and (last.x.depth or last.x.string or last.least < 0):
        raise ValueError(f"{path}: no sequence of JSON arrays: {last.x.depth} brackets open at the end, {last.least} at least")
    counts = got.groupBy("file", "split").agg(F.sum("ends").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).select("file", "split", "first")
    got = got.join(counts, ["file", "split"]).withColumn("number", F.col("first") + F.coalesce(F.sum("ends").over(along), F.lit(0)))
    whole = got.groupBy("number").agg(F.max("ends").alias("ends"), F.array_sort(F.collect_list(F.struct("file", "split", "at", "piece"))).alias("x"))
    text = F.array_join(F.transform("x", lambda p: p["piece"]), "")
    # What stands before an element: the array's bracket, a comma, or both ends of two arrays.
    head = F.regexp_extract(text, r"^[\s,\[\]]*+", 0)
    fine = F.when(F.col("ends") == 1, F.replace(F.regexp_replace(head, r"\s", ""), F.lit("[]"), F.lit("")).isin(",", "[", "][")).otherwise(F.regexp_replace(text, r"[\s\[\]]", "") == "")
    checked = F.when(fine, F.substring(text, F.length(head) + 1, F.length(text))).otherwise(F.raise_error(F.concat(F.lit("damaged JSON array before: "), F.substring(text, 1, 80))))
    return whole.select("number", "ends", checked.alias("json")).where("ends = 1 OR json IS NULL").select("number", "json")


def read(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The elements of JSON arrays as rows. An element that doesn't fit the schema is an error."""
    return elements(spark, path).select(F.from_json("json", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def write(df: DataFrame, path: str, order: list) -> None:
    """``df`` as one JSON array, in the given order, over the part files of a folder: put together in the order of their names
    they are the array. Nulls are left out of objects."""
    numbered = with_row_numbers(df.select(F.to_json(F.struct(*df.columns)).alias("json"), *[(c if isinstance(c, F.Column) else F.col(c)).alias(f"_o{i}") for i, c in enumerate(order)]), [f"_o{i}" for i in range(len(order))])
    last = F.col("row_number") == F.col("n_rows") - 1
    value = F.concat(F.when(F.col("row_number") == 0, "[").otherwise(","), "json", F.when(last, "]").otherwise(""))
    rows = numbered.select("row_number", value.alias("value"))
    if not rows.take(1):
        rows = df.sparkSession.createDataFrame([(0, "[]")], "row_number long, value string")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(n, "row_number").sortWithinPartitions("row_number").select("value").write.mode("overwrite").text(path)

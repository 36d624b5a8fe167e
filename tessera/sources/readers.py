"""Sources: JSON arrays, JSON lines with damage counted, keyed JSON, CSV dimensions, .npy, directories of shards."""

from __future__ import annotations

import fnmatch

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import json_arrays


def table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet or CSV, by the path's ending."""
    if path.rstrip("/").endswith((".csv", ".csv.gz")):
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    return spark.read.parquet(path)


def first_present(df: DataFrame, *names: str, required: bool = False) -> str | None:
    """The first of the candidate column names that the table has."""
    found = next((n for n in names if n in df.columns), None)
    if found is None and required:
        raise KeyError(f"none of {names} in {df.columns}")
    return found


def field(df: DataFrame, name: str, default: str = "") -> F.Column:
    """A text column with nulls as ``default``; ``default`` itself where the column is absent."""
    return F.coalesce(F.col(name).cast("string"), F.lit(default)) if name in df.columns else F.lit(default)


def decoded(col, errors: str = "replace") -> F.Column:
    """Bytes as text; bytes that are no UTF-8 become replacement marks, or go."""
    text = F.decode(F.col(col) if isinstance(col, str) else col, "UTF-8")
    return text if errors == "replace" else F.regexp_replace(text, "�", "")


def json_array(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The elements of JSON arrays of objects; a file is read in as many tasks as it has splits."""
    return json_arrays.read(spark, path, schema)


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, one row with the number of lines that aren't JSON of the schema)."""
    form = F.from_json("value", schema + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    got = spark.read.text(path).where("trim(value) <> ''").select(form.alias("r"))
    return got.where("r._corrupt_record is null").select("r.*").drop("_corrupt_record"), got.agg(F.count("r._corrupt_record").alias("n_bad"))


def keyed_json(df: DataFrame, col: str, value: str) -> DataFrame:
    """``key, value`` rows of an object of objects in a text column."""
    return df.select(F.explode(F.from_json(col, f"map<string,{value}>")).alias("key", "value"))


def shards(spark: SparkSession, path: str, pattern: str, schema: str, fmt: str = "json") -> DataFrame:
    """All files of a directory whose names match, with ``file`` and the first number in the name as ``part``."""
    got = spark.read.schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).format(fmt).load(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+/[^/]+)$", 1)
    return got.select("*", name.alias("file"), F.regexp_extract(name, "([0-9]+)", 1).alias("part"))


def npy(spark: SparkSession, path: str) -> DataFrame:
    """``file, row, vector`` of .npy files of one or two dimensions; where a folder has a ``_manifest``, of those that it lists."""
    import io

    import numpy as np
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                x = np.atleast_2d(np.load(io.BytesIO(data.as_py()), allow_pickle=False)).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(x)), pa.array(np.arange(len(x))), pa.array(list(x), pa.list_(pa.float64()))], ["file", "row", "vector"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content")
    try:
        listed = spark.read.schema("file string").json(f"{path}/_manifest")
        files = files.join(listed, F.substring_index("path", "/", -1) == F.col("file"), "left_semi")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    return files.mapInArrow(run, "file string, row long, vector array<double>")


def in_order(df: DataFrame, key: str, wanted: list) -> DataFrame:
    """The rows of the wanted keys in the caller's order (``pos``), repeats included. The list is the caller's, so it is small."""
    kind = df.schema[key].dataType.simpleString()
    ids = df.sparkSession.createDataFrame([(i, w) for i, w in enumerate(wanted)], f"pos int, {key} {kind}")
    return df.join(F.broadcast(ids), key).orderBy("pos")


def resolve(names: list[str], pattern: str, explicit: str | None = None) -> str:
    """The explicit path, else the first match in sorted order, else an error."""
    if explicit:
        return explicit
    found = sorted(n for n in names if fnmatch.fnmatch(n, pattern))
    if not found:
        raise FileNotFoundError(pattern)
    return found[0]


def first_scalar(spark: SparkSession, paths: list[str], keys: list[str]) -> float | None:
    """The number under the first of ``keys`` in the first of the JSON files that exists; None if there is none."""
    for path in paths:
        try:
            text = spark.read.text(path, wholetext=True).agg(F.max("value").alias("t"))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        return text.select(F.coalesce(*[F.get_json_object("t", f"$.{k}").cast("double") for k in keys]).alias("x")).first().x
    return None

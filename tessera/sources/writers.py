"""Sinks: CSV, JSON lines, JSON arrays and objects, .npy files, Markdown tables, manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import json_arrays


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def json_array(df: DataFrame, path: str, order: list) -> None:
    """One JSON array in the given order, over the part files of a folder."""
    json_arrays.write(df, path, order)


def npy(df: DataFrame, column: str, path: str) -> int:
    """The vectors of ``column`` as .npy matrices in the folder ``path``, some per task; the number of rows.

    Each attempt of a task writes under names of its own, and ``_manifest`` below ``path``, JSON lines that Spark commits at the end,
    lists the files of those that ended well. Readers go by it, so what a lost attempt left behind is never read.
    """

    def run(batches):
        import io
        import uuid

        import numpy as np
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        target, root = fs.FileSystem.from_uri(path)
        target.create_dir(root, recursive=True)
        attempt = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        for k, b in enumerate(batches):
            rows = b.column(0).to_pylist()
            if not rows:
                continue
            held = io.BytesIO()
            np.save(held, np.array(rows, np.float64))
            name = f"{attempt}-{k:06d}.npy"
            with target.open_output_stream(f"{root}/{name}") as f:
                f.write(held.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(rows)], pa.int64())], ["file", "n"])

    listed = df.select(F.col(column).cast("array<double>").alias("v")).where("v is not null").mapInArrow(run, "file string, n long")
    listed.write.mode("overwrite").json(f"{path}/_manifest")
    return df.sparkSession.read.schema("file string, n long").json(f"{path}/_manifest").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def as_json(df: DataFrame) -> DataFrame:
    """One column ``json``: an object per row, nulls left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def as_object(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row ``json``: an object of all key-value pairs; of repeated keys the largest value. For report-sized tables."""
    one = df.groupBy(key).agg(F.max(value).alias("v"))
    return one.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).cast("string"), "v"))))).alias("json"))


def manifest(df: DataFrame) -> str:
    """The only row of a summary as JSON."""
    return json.dumps(df.first().asDict(recursive=True), default=str, sort_keys=True)


def markdown(df: DataFrame, headers: dict[str, str] | None = None) -> str:
    """A report-sized table as Markdown; nulls are empty cells."""
    names = df.columns
    head = [(headers or {}).get(c, c) for c in names]
    rows = ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in df.collect()]
    return "\n".join(["| " + " | ".join(head) + " |", "|" + "---|" * len(names), *rows])


def report(sections: list[tuple[str, DataFrame]], headers: dict[str, str] | None = None) -> str:
    """A Markdown report: a heading and a report-sized table per section."""
    return "\n\n".join(f"## {title}\n\n{markdown(df, headers)}" for title, df in sections) + "\n"

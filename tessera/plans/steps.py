"""Named steps with a manifest: run all or some, go on after a failure or stop at it."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import functions as F


class Steps:
    def __init__(self, stop_on_error: bool = True):
        self.steps: dict[str, Callable] = {}
        self.stop = stop_on_error
        self.manifest: dict[str, dict] = {}

    def step(self, name: str):
        """Registers a function under a name; the first registration stays."""

        def keep(f):
            self.steps.setdefault(name, f)
            return f

        return keep

    def run(self, only: list[str] | None = None, **context) -> dict:
        unknown = set(only or ()) - set(self.steps)
        if unknown:
            raise KeyError(f"unknown steps: {sorted(unknown)}")
        results = {}
        for name, f in self.steps.items():
            if only and name not in only:
                continue
            began = time.time()
            try:
                results[name] = f(results=results, **context)
                self.manifest[name] = {"status": "ok", "seconds": round(time.time() - began, 3)}
            except Exception as e:
                self.manifest[name] = {"status": "error", "error": str(e)[:500], "seconds": round(time.time() - began, 3)}
                if self.stop:
                    raise
        return results


def predict(df, function, batch: int, schema: str):
    """The seam for a model: ``function(pandas frame) -> pandas frame`` over batches of at most ``batch`` rows."""

    def run(frames):
        for pdf in frames:
            for i in range(0, len(pdf), batch):
                yield function(pdf.iloc[i : i + batch])

    return df.mapInPandas(run, schema)


def answer_pending(questions, key: str, function, batch: int, schema: str, out: str, chunks: int = 8, most: int | None = None) -> int:
    """Answers the ``questions`` that ``out`` lacks, as JSON lines appended chunk by chunk; returns how many were open.

    ``key`` tells questions apart and is a column of ``schema``. A chunk is one append, so that a run that ends early, by a fault or
    by ``most`` chunks, leaves whole answers; the next run leaves out what it finds answered, and each question is answered once.
    Null keys are never answered; of repeated ones one row is.
    """
    spark = questions.sparkSession
    asked = questions.where(F.col(key).isNotNull()).dropDuplicates([key])
    spark.createDataFrame([], schema).write.mode("append").json(out)  # so that a first run finds a table
    done = spark.read.schema(schema).json(out).select(key)
    part = F.pmod(F.xxhash64(key), F.lit(chunks)).alias("chunk")
    open_ = asked.join(done, key, "left_anti").groupBy(part).count().orderBy("chunk").collect()  # a row per chunk
    for r in open_[:most]:
        # What is answered is read again: a chunk of before may have ended halfway.
        done = spark.read.schema(schema).json(out).select(key)
        rows = asked.where(part == r.chunk).join(done, key, "left_anti")
        predict(rows, function, batch, schema).write.mode("append").json(out)
    return sum(r["count"] for r in open_)


class Registry:
    """Models by a part of their name; of several that match the last registered counts."""

    def __init__(self):
        self.items: dict[str, object] = {}

    def register(self, key: str, item):
        self.items.setdefault(key, item)

    def find(self, name: str):
        found = [v for k, v in self.items.items() if k.lower() in name.lower()]
        if not found:
            raise KeyError(name)
        return found[-1]

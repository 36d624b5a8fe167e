"""Sessions and the driver's tables."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build(app: str = "tessera", master: str | None = None, **conf) -> SparkSession:
    """A session with what the operators rely on: UTC and adaptive execution (skew joins included)."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """Plans made within have this setting; the session's comes back."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


#: Shuffle files of a table go when it is written: else they stay until the driver happens to collect its garbage.
CLEAN_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def clean_shuffles(spark: SparkSession):
    """Tables written within leave no shuffle files."""
    return setting(spark, CLEAN_KEY, "true")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path that driver and executors share: below spark.checkpoint.dir; on one machine without it a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"

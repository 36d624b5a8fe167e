"""What the jobs share: configs, the command line, the log."""

from __future__ import annotations

import argparse
import json
import logging
import os

from pyspark.sql import DataFrame, SparkSession

LOG = logging.getLogger("jobs")


def read_config(spark: SparkSession, path: str, defaults: dict) -> dict:
    """A JSON object from any path that Spark reads, over ``defaults``; unknown names are an error."""
    got = json.loads(spark.read.text(path, wholetext=True).first()[0])
    unknown = sorted(set(got) - set(defaults))
    if unknown:
        raise KeyError(f"{path}: unknown settings {unknown}")
    return defaults | got


def default_config(module_file: str) -> str:
    return "file://" + os.path.splitext(os.path.abspath(module_file))[0] + ".json"


def command_line(argv: list[str] | None, module_file: str, what: str, paths: dict[str, str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(description=what)
    for name, text in paths.items():
        p.add_argument(f"--{name}", required=True, help=text)
    p.add_argument("--config", default=default_config(module_file), help="JSON settings")
    p.add_argument("--master", help="a Spark master; spark-submit's own if left out")
    return p.parse_args(argv)


def session(app: str, master: str | None) -> SparkSession:
    from tessera.session import build

    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return build(app, master)


def log_table(action: str, path: str, df: DataFrame, rows: int) -> None:
    LOG.info("%s %d rows, columns %s: %s", action, rows, ",".join(df.columns), path)

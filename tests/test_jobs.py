"""The jobs over growing and odd input, rerun, replayed, and from the command line."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import cohort_intake, common, instruction_set, queries
from tessera.functions import nets

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAMPLES = "doc_id long, source string, text string, n_chars long"
ROWS = [
    (1, "GSE1", "heart failure, donor: A7; left ventricle", 10), (2, "GSE1", "Lung CANCER and heart failure", 20), (3, "GSE2", "nothing here", 30), (4, None, "hypertension, patient id: 9", 40),
    (5, "GSE2", None, None), (None, "GSE3", "cancer", 1), (6, "GSE3", "renal biopsy, subject: unknown", 5), (6, "GSE3", "renal biopsy, subject: unknown", 5), (7, "GSE4", "x" * 200_000 + " melanoma", 200_009),
]


def land(spark, folder, rows, schema=SAMPLES, parts=1):
    spark.createDataFrame(rows, schema).selectExpr("*", "'extra' AS category", "1 AS batch").repartition(parts).write.mode("append").parquet(folder)


def state(labels):
    return sorted((r.doc_id, r.series, r.measure, tuple(r.matched), r.n_matched, r.subtype, r.person, r.resolved, r.category) for r in labels.collect())


def summary(spark, out):
    return sorted((r.category, r.n_samples, r.n_series, r.n_multi, r.n_resolved) for r in spark.read.json(f"{out}/report").collect())


@pytest.fixture
def config():
    return cohort_intake.DEFAULTS | {"files_per_batch": 2}


def test_intake_takes_only_what_is_new(spark, tmp_path, config):
    landing, out, mark = (f"file://{tmp_path}/{x}" for x in ("landing", "out", "mark"))
    land(spark, landing, ROWS[:4])
    first = cohort_intake.run(spark, landing, out, mark, config)
    assert state(first) == [
        (1, "GSE1", 10, ("cardiovascular",), 1, "heart_failure", "GSE1::a7", True, "cardiovascular"),
        (2, "GSE1", 20, ("cardiovascular", "cancer_neoplasm"), 2, "heart_failure", "__unresolved__::2", False, "cardiovascular"),
        (3, "GSE2", 30, (), 0, None, "__unresolved__::3", False, nets.UNLABELED),
        (4, "", 40, ("cardiovascular",), 1, "hypertension", "__unresolved__::4", False, "cardiovascular"),
    ]
    seen = {p: p.stat().st_mtime_ns for p in Path(tmp_path, "out/labels").rglob("*.parquet")}
    land(spark, landing, ROWS[4:], parts=5)
    second = state(cohort_intake.run(spark, landing, out, mark, config))
    assert len(second) == 8 and second[:4] == state(first)[:4]
    assert {(r[0], r[8]) for r in second[4:]} == {(5, nets.UNLABELED), (6, "renal"), (7, "cancer_neoplasm")}
    assert all(p.stat().st_mtime_ns == t for p, t in seen.items())  # earlier batches are left alone
    assert summary(spark, out) == sorted([("cardiovascular", 3, 2, 1, 1), (nets.UNLABELED, 2, 1, 0, 0), ("renal", 2, 1, 0, 0), ("cancer_neoplasm", 1, 1, 0, 0)])
    refused = [json.loads(r.row) for r in spark.read.parquet(f"{out}/refused").collect()]
    assert [r["text"] for r in refused] == ["cancer"]
    assert state(cohort_intake.run(spark, landing, out, mark, config)) == second  # nothing new
    # All at once gives the same.
    other = cohort_intake.run(spark, landing, f"{out}2", f"{mark}2", config | {"files_per_batch": 100})
    assert state(other) == second and summary(spark, f"{out}2") == summary(spark, out)


def test_a_batch_without_its_mark_is_not_counted_twice(spark, tmp_path, config):
    landing, out, mark = (f"file://{tmp_path}/{x}" for x in ("landing", "out", "mark"))
    land(spark, landing, ROWS[:4])
    cohort_intake.run(spark, landing, out, mark, config)
    land(spark, landing, ROWS[4:])
    want = state(cohort_intake.run(spark, landing, out, mark, config))
    totals = summary(spark, out)
    commits = Path(tmp_path, "mark/commits")
    last = max(int(p.name) for p in commits.iterdir() if p.name.isdigit())
    for p in (commits / str(last), commits / f".{last}.crc"):
        p.unlink(missing_ok=True)  # as if the driver was lost between writing and marking
    assert state(cohort_intake.run(spark, landing, out, mark, config)) == want
    assert summary(spark, out) == totals


def test_intake_of_an_empty_folder(spark, tmp_path, config):
    os.mkdir(tmp_path / "landing")
    paths = [f"file://{tmp_path}/{x}" for x in ("landing", "out", "mark")]
    assert cohort_intake.run(spark, *paths, config | {"schema": SAMPLES}).count() == 0
    land(spark, paths[0], ROWS[:2])
    assert cohort_intake.run(spark, *paths, config | {"schema": SAMPLES}).count() == 2


def test_nets_are_searched_by_arrow_with_the_same_matches(spark, config):
    """Words are not tried one by one in Java; matches, their order and odd characters are as ``nets.all_matches`` has them."""
    odd = config | {"nets": {"odd": ("a.b", "ción de", "(x)", "two\nlines", "-?"), "none": ()}}
    texts = [None, "", "A.B axb", "CIÓN DE", "İ ſ K Σς Ω HIV", "two\nlines hiv lupus", "(X)", "\x00hiv", "ardsarrhythmia 😀 adrenal insufficiency", "-?*", "renal " * 50_000 + "copd"]
    rows = spark.createDataFrame([(i, "s", t, 1) for i, t in enumerate(texts)], SAMPLES)
    got = cohort_intake.label(rows, odd)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "RLIKE" not in plan.upper() and "ArrowEvalPython" in plan
    want = rows.select("doc_id", nets.all_matches(nets.haystack(F.col("text")), cohort_intake.categories(odd)).alias("m"), nets.first_match(nets.haystack(F.col("text")), odd["subtypes"], nets.UNRESOLVED).alias("s")).collect()
    found = {r.doc_id: r for r in got.collect()}
    assert len(found) == len(texts) and {r.doc_id: r.m for r in want} == {k: r.matched for k, r in found.items()}
    assert all(found[r.doc_id].subtype == (r.s if found[r.doc_id].category == "cardiovascular" else None) for r in want)
    assert found[2].matched == ["odd"] and found[3].matched == ["odd"] and found[10].category == "respiratory" and found[10].matched == ["respiratory", "renal"]


def test_a_batch_without_samples_or_refused_rows(spark, tmp_path, config):
    landing, out, mark = (f"file://{tmp_path}/{x}" for x in ("landing", "out", "mark"))
    land(spark, landing, [(None, "GSE3", "cancer", 1)])
    assert cohort_intake.run(spark, landing, out, mark, config).count() == 0
    land(spark, landing, ROWS[:2])
    assert cohort_intake.run(spark, landing, out, mark, config).count() == 2 and summary(spark, out) == [("cardiovascular", 2, 1, 1, 1)]
    assert spark.read.parquet(f"{out}/refused").count() == 1


TURNS = "conv_id long, turn long, role string, text string"
TALK = [
    (1, 0, "user", "What is this?"), (1, 1, "assistant", "A heart."), (1, 2, "user", "Sure?"), (1, 3, "assistant", None),
    (2, 0, "system", "be kind"), (2, 1, "user", "What is this?"), (2, 2, "assistant", "A lung."),
    (3, 0, "user", "What is this?"), (3, 1, "assistant", "A lung."), (4, 0, "user", "alone"), (5, 0, "system", "only"),
    (6, 0, "user", "w " * 500), (6, 1, "assistant", "long"), (None, 0, "user", "lost"), (9, 0, "user", "q"), (9, 1, "assistant", "a"),
] + [(7, i, "user" if i % 2 == 0 else "assistant", "t") for i in range(100)]


def test_instruction_set(spark, tmp_path):
    path, out = f"file://{tmp_path}/turns", f"file://{tmp_path}/out"
    spark.createDataFrame(TALK, TURNS).selectExpr("*", "'x' AS split", "1 AS bucket").write.parquet(path)
    config = instruction_set.DEFAULTS | {"max_words": 300}
    got = {r.conv_id: r for r in instruction_set.run(spark, path, out, config).collect()}
    assert {k: r.reason for k, r in got.items()} == {1: None, 2: None, 3: "copy", 4: "unpaired", 5: "empty", 6: "too_long", 7: "too_long", 9: None}
    assert got[1].prompt.endswith("USER: What is this? ASSISTANT: A heart.</s>USER: Sure? ASSISTANT: </s>") and got[1].n_rounds == 2
    assert got[1].split == got[2].split  # they open alike
    assert (got[1].n_words, got[1].bucket, got[9].n_words, got[9].bucket) == (6, 3, 2, 1)
    rows = sorted(map(tuple, got.values()), key=repr)
    again = instruction_set.run(spark, path, out, config).collect()
    assert sorted(map(tuple, again), key=repr) == rows
    manifest = spark.read.json(f"{out}/manifest")
    assert manifest.agg(F.sum("n")).first()[0] == len(got)
    spark.createDataFrame(TALK[:4], TURNS).write.mode("overwrite").parquet(path)
    assert [r.conv_id for r in instruction_set.run(spark, path, out, config).collect()] == [1]  # no rows of before are left
    spark.createDataFrame([], TURNS).write.mode("overwrite").parquet(path)
    assert instruction_set.run(spark, path, out, config).collect() == []


def test_splits_keep_their_shares(spark):
    rows = spark.range(20_000).select(instruction_set.split_of(F.concat(F.lit("question "), F.col("id").cast("string")), {"a": 3, "b": 1}, "s").alias("x"))
    n = {r.x: r["count"] for r in rows.groupBy("x").count().collect()}
    assert set(n) == {"a", "b"} and abs(n["a"] / 20_000 - 0.75) < 0.02


def test_configs(spark, tmp_path):
    for module in (cohort_intake, instruction_set):
        got = common.read_config(spark, common.default_config(module.__file__), module.DEFAULTS)
        assert set(got) == set(module.DEFAULTS)
    (tmp_path / "bad.json").write_text('{"colour": 1}')
    with pytest.raises(KeyError, match="colour"):
        common.read_config(spark, f"file://{tmp_path}/bad.json", instruction_set.DEFAULTS)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_as_duckdb(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    want = con.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    df = queries.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(tuple, df.select(*names).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_command_lines(spark, tmp_path):
    """Each job as a process of its own, with its config file."""
    land(spark, f"file://{tmp_path}/landing", ROWS)
    spark.createDataFrame(TALK, TURNS).write.parquet(f"file://{tmp_path}/turns")
    run = lambda *a: subprocess.run([sys.executable, "-m", *a, "--master", "local[2]"], cwd=ROOT, check=True, capture_output=True, text=True, timeout=240).stderr
    log = run("jobs.cohort_intake", "--samples", f"file://{tmp_path}/landing", "--out", f"file://{tmp_path}/cohort", "--checkpoint", f"file://{tmp_path}/mark")
    assert "read 9 new rows" in log and "8 samples labelled" in log
    assert spark.read.parquet(f"file://{tmp_path}/cohort/labels").count() == 8
    log = run("jobs.instruction_set", "--conversations", f"file://{tmp_path}/turns", "--out", f"file://{tmp_path}/set")
    assert "wrote" in log and spark.read.json(f"file://{tmp_path}/set/records").count() == 4

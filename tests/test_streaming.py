"""Streams over landing directories."""

import pytest
from pyspark.sql import functions as F

from tessera.plans import steps
from tessera.streaming import ingest

NETS = {"a": ("heart",), "b": ("renal",)}


def test_labels_go_on_from_the_checkpoint(spark, tmp_path):
    src, out, mark = (f"file://{tmp_path}/{x}" for x in ("src", "out", "mark"))
    put = lambda rows: spark.createDataFrame(rows, "id long, text string").write.mode("append").parquet(src)
    put([(1, "Heart of renal"), (2, None)])
    run = lambda: ingest.run_available(ingest.label_stream(ingest.landing(spark, src, "id long, text string"), "text", NETS), out, mark)
    run()
    put([(3, "adrenal")])
    run()
    run()
    got = {r.id: (r.category, r.n_matched) for r in spark.read.parquet(out).collect()}
    assert got == {1: ("a", 2), 2: ("unclear_unlabeled", 0), 3: ("b", 1)} and spark.read.parquet(out).count() == 3


def test_windows_close_behind_the_watermark(spark, tmp_path):
    src, out, mark = (f"file://{tmp_path}/{x}" for x in ("src", "out", "mark"))
    rows = [("2024-01-01 00:05:00", "x", 1.0), ("2024-01-01 00:55:00", "x", 2.0), ("2024-01-01 01:10:00", "y", 4.0), ("2024-01-01 09:00:00", "x", 8.0)]
    for r in rows:
        spark.createDataFrame([r], "t string, k string, v double").select(F.to_timestamp("t").alias("ts"), "k", "v").write.mode("append").parquet(src)
    s = ingest.landing(spark, src, "ts timestamp, k string, v double")
    ingest.run_available(ingest.windowed_counts(s, "ts", "k", "v", "1 hour", "10 minutes"), out, mark)
    got = sorted((str(r.start), r.k, r.n, r.total) for r in spark.read.parquet(out).collect())
    assert got == [("2024-01-01 00:00:00", "x", 2, 3.0), ("2024-01-01 01:00:00", "y", 1, 4.0)]


EVENTS = "ts timestamp, k string, v double"


def land(spark, src, rows):
    spark.createDataFrame(rows, "t string, k string, v double").select(F.to_timestamp("t").alias("ts"), "k", "v").coalesce(1).write.mode("append").parquet(src)


def test_late_rows_after_the_watermark_are_dropped(spark, tmp_path):
    src, out, mark = (f"file://{tmp_path}/{x}" for x in ("src", "out", "mark"))
    run = lambda: ingest.run_available(ingest.windowed_counts(ingest.landing(spark, src, EVENTS), "ts", "k", "v", "2 hours", "10 minutes", "1 hour"), out, mark)
    land(spark, src, [("2024-01-01 00:30:00", "x", 1.0), ("2024-01-01 05:00:00", "x", 2.0)])
    run()
    land(spark, src, [("2024-01-01 00:40:00", "x", 100.0), ("2024-01-01 09:00:00", "x", 4.0)])  # the first is too late
    run()
    run()
    got = sorted((str(r.start), r.n, r.total) for r in spark.read.parquet(out).collect())
    assert got == [("2023-12-31 23:00:00", 1, 1.0), ("2024-01-01 00:00:00", 1, 1.0), ("2024-01-01 04:00:00", 1, 2.0), ("2024-01-01 05:00:00", 1, 2.0)]


def test_sessions_grow_over_runs(spark, tmp_path):
    src, out, mark = (f"file://{tmp_path}/{x}" for x in ("src", "out", "mark"))
    run = lambda: ingest.run_totals(ingest.session_counts(ingest.landing(spark, src, EVENTS), "ts", "k", "v", "1 hour", "1 day"), out, mark)
    land(spark, src, [("2024-01-01 00:00:00", "x", 1.0), ("2024-01-01 01:30:00", "x", 2.0), ("2024-01-01 00:10:00", "y", 3.0)])
    run()
    land(spark, src, [("2024-01-01 00:45:00", "x", 4.0)])  # joins the two sessions
    run()
    got = sorted((r.k, str(r.start), str(r.end), r.n, r.total) for r in spark.read.parquet(out).collect())
    assert got == [("x", "2024-01-01 00:00:00", "2024-01-01 02:30:00", 3, 7.0), ("y", "2024-01-01 00:10:00", "2024-01-01 01:10:00", 1, 3.0)]


def test_repeats_are_dropped_over_runs(spark, tmp_path):
    src, out, mark = (f"file://{tmp_path}/{x}" for x in ("src", "out", "mark"))
    run = lambda: ingest.run_available(ingest.first_arrivals(ingest.landing(spark, src, EVENTS), "ts", ["k"], "1 day"), out, mark)
    land(spark, src, [("2024-01-01 00:00:00", "x", 1.0), ("2024-01-01 00:00:00", "x", 1.0), ("2024-01-01 00:10:00", "y", 3.0)])
    run()
    land(spark, src, [("2024-01-01 00:20:00", "x", 1.0), ("2024-01-01 00:20:00", "z", 1.0)])
    run()
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == ["x", "y", "z"]


def test_two_passes_equal_the_batch_after_each_landing(spark, tmp_path):
    src, sums, mark = (f"file://{tmp_path}/{x}" for x in ("src", "sums", "mark"))
    rows = [("2024-01-01 00:00:00", k, v) for k, v in (("x", 1.0), ("x", 5.0), ("y", 2.0), (None, 4.0), ("x", None))]
    for more in (rows, [("2024-01-01 00:00:00", "x", 12.0), ("2024-01-01 00:00:00", "z", 7.0)], []):
        if more:
            land(spark, src, more)
        ingest.land_sums(ingest.landing(spark, src, EVENTS), "k", "v", sums, mark)
        landed = spark.read.parquet(src)
        got = sorted(((r.k, r.v, r.z) for r in ingest.standardized(landed, "k", "v", sums).collect()), key=repr)
        pdf = landed.toPandas()
        for k, v, z in got:
            own = pdf[pdf.k.isna() if k is None else pdf.k == k].v.dropna()
            assert z is None if v is None else abs(z - (v - own.mean()) / (own.std(ddof=0) or 1)) < 1e-9


def test_a_prediction_run_goes_on_where_it_was_killed(spark, tmp_path):
    out = f"file://{tmp_path}/answers"
    q = spark.createDataFrame([(f"q{i}", f"text {i}") for i in range(200)] + [("q1", "text 1"), (None, "lost")], "id string, text string")
    schema = "id string, text string, run int"

    def model(run, fails=None):
        def f(pdf):
            if fails and (pdf.id == fails).any():
                raise RuntimeError("killed")
            return pdf.assign(text=pdf.text.str.upper(), run=run)

        return f

    with pytest.raises(Exception, match="killed"):
        steps.answer_pending(q, "id", model(1, "q7"), 16, schema, out)
    before = spark.read.schema(schema).json(out).count()
    assert before < 200
    assert steps.answer_pending(q, "id", model(2), 16, schema, out) == 200 - before
    assert steps.answer_pending(q, "id", model(3), 16, schema, out) == 0
    got = spark.read.schema(schema).json(out).collect()
    assert len(got) == 200 and {r.id: r.text for r in got} == {f"q{i}": f"TEXT {i}" for i in range(200)} and {r.run for r in got} == {1, 2} - ({1} if not before else set())

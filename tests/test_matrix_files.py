"""Slices of .npy matrices: only the rows and columns asked for are read."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.sources import matrix_files, readers, writers


def rows(df):
    return sorted((r.file.rsplit("/", 1)[1], r.row, list(r.vector)) for r in df.collect())


@pytest.mark.parametrize("dtype", ["<f8", "<f4", ">i4", "u1"])
def test_ranges(spark, tmp_path, dtype):
    x = np.arange(60).reshape(12, 5).astype(dtype)
    np.save(tmp_path / "a.npy", x)
    np.save(tmp_path / "b.npy", x[:2] + 1)
    (tmp_path / "note.txt").write_text("no matrix")
    path = f"file://{tmp_path}"
    every = rows(matrix_files.npy_slices(spark, path))
    assert every == [("a.npy", i, x[i].astype(float).tolist()) for i in range(12)] + [("b.npy", i, (x[i] + 1).astype(float).tolist()) for i in range(2)]
    assert rows(matrix_files.npy_slices(spark, f"{path}/a.npy", "3:5", "1:3")) == [("a.npy", i, x[i, 1:3].astype(float).tolist()) for i in (3, 4)]
    assert rows(matrix_files.npy_slices(spark, f"{path}/a.npy", "10:99")) == [("a.npy", i, x[i].astype(float).tolist()) for i in (10, 11)]
    assert rows(matrix_files.npy_slices(spark, path, "50:60")) == []
    parts = matrix_files.npy_slices(spark, f"{path}/a.npy").rdd.getNumPartitions()
    many = spark.read.format("npy_slices").option("partitionBytes", str(2 * 5 * np.dtype(dtype).itemsize)).load(f"{path}/a.npy")
    assert parts == 1 and many.rdd.getNumPartitions() == 6 and many.count() == 12


def test_filters_reach_the_reader(spark, tmp_path):
    x = np.arange(40.0).reshape(20, 2)
    np.save(tmp_path / "a.npy", x)
    key, before = "spark.sql.python.filterPushdown.enabled", spark.conf.get("spark.sql.python.filterPushdown.enabled", None)
    spark.conf.set(key, "true")
    try:
        df = matrix_files.npy_slices(spark, f"file://{tmp_path}/a.npy")
        for cond, want in ((F.col("row") == 7, [7]), ((F.col("row") > 16) & (F.col("row") <= 18), [17, 18]), (F.col("row").isin(3, 11), [3, 11]), (F.col("row") < 0, [])):
            assert [r[1] for r in rows(df.where(cond))] == want
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    reader = matrix_files.FilteringReader({"path": f"file://{tmp_path}/a.npy"})
    list(reader.pushFilters([matrix_files.In(("row",), (3, 11)), matrix_files.LessThan(("row",), 10)]))
    assert [(p.first, p.last, p.wanted) for p in reader.partitions()] == [(3, 4, (3,))]


def test_a_huge_file_is_not_read_whole(spark, tmp_path):
    """A sparse file of 80 GB, of which ten rows and some columns are read."""
    path = tmp_path / "huge.npy"
    n, width = 100_000_000, 100
    with open(path, "wb") as f:
        np.lib.format.write_array_header_1_0(f, {"descr": "<f8", "fortran_order": False, "shape": (n, width)})
        start = f.tell()
        f.seek(start + (77_000_000 * width + 3) * 8)
        f.write(np.float64(2.5).tobytes())
        f.truncate(start + n * width * 8)
    began = time.time()
    got = rows(matrix_files.npy_slices(spark, f"file://{path}", "76999995:77000005", "2:5"))
    assert time.time() - began < 60
    assert len(got) == 10 and got[5] == ("huge.npy", 77_000_000, [0.0, 2.5, 0.0])


def test_files_that_do_not_fit(spark, tmp_path):
    np.save(tmp_path / "f.npy", np.asfortranarray(np.ones((3, 4))))
    with pytest.raises(Exception, match="do not lie together"):
        matrix_files.npy_slices(spark, f"file://{tmp_path}/f.npy").collect()
    np.save(tmp_path / "s.npy", np.array(["text"]))
    with pytest.raises(Exception, match="no numbers"):
        matrix_files.npy_slices(spark, f"file://{tmp_path}/s.npy").collect()


def test_written_vectors(spark, tmp_path):
    df = spark.range(50).select(F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v")).repartition(3)
    assert writers.npy(df, "v", f"file://{tmp_path}/out") == 50
    got = matrix_files.npy_slices(spark, f"file://{tmp_path}/out", columns="0:1")
    assert sorted(r.vector[0] for r in got.collect()) == list(range(50))


def test_files_of_lost_attempts_are_not_read(spark, tmp_path):
    df = spark.range(50).select(F.array(F.col("id").cast("double")).alias("v")).repartition(3)
    out = f"file://{tmp_path}/out"
    assert writers.npy(df, "v", out) == 50
    np.save(tmp_path / "out" / "part-000001-lost-000000.npy", np.ones((9, 1)))
    assert readers.npy(spark, out).count() == 50 and matrix_files.npy_slices(spark, out).count() == 50
    assert writers.npy(df.limit(7), "v", out) == 7  # written again: the earlier files are no longer listed
    assert readers.npy(spark, out).count() == 7 and matrix_files.npy_slices(spark, out).count() == 7

"""Operators against independent computations."""

import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import batching, blocks, folds, grid, groups, matrix, metrics, models, ordered, sampling, scoring
from tessera.plans import steps
from tessera.sources import readers, writers


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(3)
    data = [(i, rng.randint(0, 12) / 12, int(rng.random() < 0.4)) for i in range(300)]
    return data, spark.createDataFrame(data, "id int, score double, y int")


def test_ranking_metrics(scored):
    data, df = scored
    pos, neg = [s for _, s, y in data if y], [s for _, s, y in data if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    points, tp, fp = [], 0, 0
    for s in sorted({s for _, s, _ in data}, reverse=True):
        tp, fp = tp + pos.count(s), fp + neg.count(s)
        points.append((tp / len(pos), tp / (tp + fp)))
    ap = sum((r - r0) * p for (r, p), r0 in zip(points, [0] + [r for r, _ in points]))
    curve = [(0, 1), *points]
    trap = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(curve, curve[1:]))
    assert metrics.roc_auc(df, []).first()[0] == pytest.approx(auc, abs=1e-9)
    assert metrics.average_precision(df, []).first()[0] == pytest.approx(ap, abs=1e-9)
    assert metrics.pr_trapezoid(df, []).first()[0] == pytest.approx(trap, abs=1e-9)
    one_class = df.where("y = 1")
    assert metrics.roc_auc(one_class, []).first()[0] is None


def test_golden_confusion(spark):
    """Published fold counts give their published ratios."""
    tp, tn, fp, fn = 1387, 4805, 275, 410
    data = [(1.0, 1)] * tp + [(0.0, 0)] * tn + [(1.0, 0)] * fp + [(0.0, 1)] * fn
    r = metrics.confusion(spark.createDataFrame(data, "score double, y int"), []).first()
    assert (r.tp, r.tn, r.fp, r.fn) == (tp, tn, fp, fn)
    assert r.accuracy == pytest.approx((tp + tn) / len(data), abs=1e-9) and r.f1 == pytest.approx(2 * tp / (2 * tp + fp + fn), abs=1e-9)


def test_interpolation(spark):
    curve = spark.createDataFrame([(0.0, 0.0), (0.0, 0.3), (0.25, 0.5), (1.0, 1.0)], "x double, y double")
    got = {r.i: r.gy for r in metrics.interpolate(curve, [], 8).collect()}
    want = np.interp(np.arange(9) / 8, [0, 0.25, 1], [0.3, 0.5, 1])
    assert [got[i] for i in range(9)] == pytest.approx(want.tolist())


def test_quantile_normalization_golden(spark):
    ref = spark.createDataFrame([(i, float(i)) for i in (1, 2, 3, 4)], "rank int, ref double")
    for col, want in (([7, 7, 5, 9], [2.5, 2.5, 1, 4]), ([3, 1, 4, 2], [3, 1, 4, 2])):
        c = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(col)], "sample int, feature int, value double")
        assert [r[0] for r in matrix.quantile_normalize(c, ref).orderBy("feature").select("normalized").collect()] == want


def test_align_fills_and_counts(spark):
    v = spark.createDataFrame([(1, 5, 0.5), (2, 9, 1.0)], "s int, g long, value double")
    vocab = spark.createDataFrame([(1, 9), (0, 5), (2, 7)], "pos int, g long")
    got = {r.s: (list(r.vector), r.n_missing) for r in matrix.align(v, vocab, "s", "g").collect()}
    assert got == {1: ([0.5, -10.0, -10.0], 2), 2: ([-10.0, 1.0, -10.0], 2)}


def test_mad_of_zero_flags_nothing(spark):
    q = spark.createDataFrame([(i, 10.0 + i, 5) for i in range(9)], "id int, size double, det int")
    assert groups.mad_flags(q, "size", "det").where("outlier_low_detection").count() == 0


def test_breakdown_totals_are_recomputed(spark):
    rows = [("a", "p1", "s1", 1, True), ("b", "p1", "s1", 2, True), (None, "p2", "s2", None, False)]
    out = groups.breakdown(spark.createDataFrame(rows, "g string, p string, s string, m int, r boolean"), "g", "p", "s", "m", "r", ["a", "b", "z", groups.TOTAL])
    got = {r.category: r for r in out.collect()}
    assert got[groups.TOTAL].n_patients == 2 and got[groups.TOTAL].n_samples == 3 and got[groups.TOTAL].n_series is None
    assert got["z"].n_samples == 0 and got["z"].measure_mean is None and got[None].n_samples == 1


def test_release_guard_raises(spark):
    a, b = spark.range(10).toDF("k"), spark.range(5).toDF("k")
    with pytest.raises(ValueError):
        groups.assert_release(a, b, "k")
    groups.assert_release(b, a, "k")
    with pytest.raises(ValueError):
        groups.assert_release(b.where("k > 100"), a, "k")


def test_folds_do_not_leak(spark):
    rng = random.Random(1)
    data = [(f"g{rng.randint(0, 30)}", int(rng.random() < 0.3)) for _ in range(500)]
    x = folds.grouped_folds(spark.createDataFrame(data, "g string, y int"), "g", "y", 5)
    assert x.count() == 500 and folds.leaking_groups(x, "g").count() == 0 and x.select("fold").distinct().count() == 5
    with pytest.raises(ValueError):
        folds.grouped_folds(spark.createDataFrame(data, "g string, y int").where("g < 'g1'"), "g", "y", 50)
    assert (folds.inner_folds(9), folds.inner_folds(2), folds.inner_folds(1)) == (3, 2, 2)


def test_draws(spark, monkeypatch):
    x = spark.range(100).toDF("id")
    a = {r[0] for r in sampling.draw(x, "id", 30, 1).collect()}
    assert len(a) == 30 and a == {r[0] for r in sampling.draw(x.repartition(9), "id", 30, 1).collect()}
    assert sampling.draw(x, "id", 1000, 1).count() == 100
    monkeypatch.setattr(sampling, "TOP_K", 5)
    assert a == {r[0] for r in sampling.draw(x, "id", 30, 1).collect()} and sampling.draw(x, "id", 1000, 1).columns == ["id"]
    with pytest.raises(ValueError):
        sampling.with_ratio(x, F.col("id") < 0, "id", 3, 1)
    c = {r.id: r.chunk for r in sampling.chunks(spark.range(5).toDF("id"), ["id"], 4).collect()}
    assert c == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2}


def test_batches(spark):
    assert batching.deal([9, 8, 2, 1], 2) == [0, 1, 1, 0] and batching.deal([5, 4, 3], 2) == [0, 1, 0]
    x = spark.createDataFrame([(i, (i % 7 + 1) * (1 if i % 3 else -1)) for i in range(50)], "id long, n long")
    got = batching.modality_batches(x, "id", "n", 4, 2, 1).collect()
    assert sorted(r.id for r in got) == list(range(50))
    by = {}
    for r in got:
        by.setdefault(r.megabatch, []).append(r)
    pure = [b for b in by.values() if len({r.modality for r in b}) == 1 and len(b) == 8]
    assert len(pure) >= 4 and max(map(len, by.values())) <= 8
    even = batching.even_chunks(x.withColumn("n", F.abs("n")), "id", "n", 4, 2, 1).collect()
    sizes = {}
    for r in even:
        sizes[(r.megabatch, r.worker)] = sizes.get((r.megabatch, r.worker), 0) + 1
    assert all(v == 4 for (m, _), v in sizes.items() if m < 6)


@pytest.mark.parametrize("m,want", [(1, 0.3), (2, 0.6), (3, 0.9), (4, 1.0), (10, 1.0)])
def test_soft_accuracy(spark, m, want):
    x = spark.createDataFrame([("p", ["p"] * m + ["q"] * (10 - m))], "p string, a array<string>")
    assert x.select(scoring.soft_accuracy(F.col("p"), F.col("a"))).first()[0] == pytest.approx(want)


def test_anls(spark):
    x = spark.createDataFrame([("kitten", ["sitting", "kitten"]), ("abc", ["xyz"])], "p string, a array<string>")
    assert [r[0] for r in x.select(scoring.anls(F.col("p"), F.col("a"))).collect()] == [1.0, 0.0]


def test_models(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 120)
    v = rng.normal(0, 1, (120, 3)) + y[:, None] * 2
    df = spark.createDataFrame([(i, [float(a) for a in v[i]] + [1.0], int(y[i]), i % 3) for i in range(120)], "id int, v array<double>, y int, fold int")
    got = models.cross_validate(df, "v", "y", "fold")
    assert got.count() == 120 and metrics.roc_auc(got, []).first()[0] > 0.9
    scores, shares = models.principal_components(spark.createDataFrame([([11.0, 0.0],), ([13.0, 0.0],), ([15.0, 0.0],)], "v array<double>"), "v", 1)
    assert shares[0] == pytest.approx(1.0) and sorted(abs(r[0][0]) for r in scores.select("scores").collect()) == pytest.approx([0, 2, 2])
    d = np.array([[0, 1, 5, 6], [1, 0, 5, 6], [5, 5, 0, 2], [6, 6, 2, 0]], float)
    m = models.average_linkage(d)
    assert m[:, 2].tolist() == pytest.approx([1, 2, 5.5]) and m[-1, 3] == 4 and sorted(models.leaf_order(m)) == [0, 1, 2, 3]


def test_linkage_and_map_at_published_sizes():
    import time

    rng = np.random.default_rng(3)
    d = rng.random((60, 60))
    d = d + d.T
    plain, size, heights = d.copy(), {i: 1 for i in range(60)}, []
    while len(size) > 1:
        h, i, j = min((plain[i, j], i, j) for i in size for j in size if i < j)
        heights.append(h)
        plain[i] = (size[i] * plain[i] + size[j] * plain[j]) / (size[i] + size[j])
        plain[:, i] = plain[i]
        size[i] += size.pop(j)
    m = models.average_linkage(d)
    assert m[:, 2].tolist() == pytest.approx(heights) and m[-1, 3] == 60
    began = time.time()
    models.average_linkage(1 - np.corrcoef(rng.normal(0, 1, (2000, 50))))
    assert time.time() - began < 10
    x = np.repeat(np.eye(3) * 20, 40, axis=0) + rng.normal(0, 1, (120, 3))
    y = models.tsne(x, 10.0, 150)
    centre = y.reshape(3, 40, 2).mean(axis=1)
    near = ((y[:, None] - centre[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (near == np.repeat(range(3), 40)).mean() > 0.9


def test_correlations_in_blocks(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(0, 1, (11, 6))
    v[4] = 1.0
    cells = spark.createDataFrame([(3 * i, j, float(v[i, j])) for i in range(11) for j in range(6)], "sample long, feature int, value double")
    got = {(r.i, r.j): r.r for r in matrix.correlations(cells, block=4).collect()}
    assert len(got) == 55
    for (i, j), r in got.items():
        assert r is None if 12 in (i, j) else r == pytest.approx(np.corrcoef(v[i // 3], v[j // 3])[0, 1])
    assert matrix.correlations(cells.limit(0)).count() == 0


def test_vectors_lie_once_besides_their_correlations(spark):
    """Of vectors of single precision one copy of four bytes a value is written, and no shuffle files stay."""
    from tessera.session import CLEAN_KEY

    v = np.random.default_rng(8).normal(0, 1, (700, 64)).astype(np.float32)
    ids = np.random.default_rng(9).permutation(700) * 3 - 900
    vectors = spark.createDataFrame([(int(i), x) for i, x in zip(ids, v.astype(float).tolist())], "id long, v array<double>")
    folders = [spark.conf.get("spark.checkpoint.dir").removeprefix("file://"), *[f.getPath() for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]]
    held = lambda: {p: os.path.getsize(p) for top in folders for d, _, names in os.walk(top) for x in names if os.path.exists(p := f"{d}/{x}") and (top == folders[0] or x.startswith("shuffle_"))}
    before, set_to = held(), spark.conf.get(CLEAN_KEY, None)
    got = matrix.vector_correlations(vectors, block=100)
    until = time.time() + 20
    more = lambda: sum(n for p, n in held().items() if p not in before)
    while more() > 1.3 * v.nbytes and time.time() < until:
        time.sleep(0.2)
    assert more() <= 1.3 * v.nbytes and spark.conf.get(CLEAN_KEY, None) == set_to
    want = dict(zip(ids.tolist(), range(700)))
    r = np.corrcoef(v.astype(float))
    rows = got.collect()
    assert len({(x.i, x.j) for x in rows}) == len(rows) == 700 * 699 // 2
    assert all(x.i < x.j for x in rows) and np.allclose([x.r for x in rows], [r[want[x.i], want[x.j]] for x in rows], atol=1e-12)


def test_correlations_move_no_copies_of_vectors(spark):
    """Each vector goes into one block; blocks meet without being copied for each other block, so little is shuffled."""
    v = np.random.default_rng(3).normal(0, 1, (200, 8))
    vectors = spark.createDataFrame([(i, v[i].tolist()) for i in range(200)], "id long, v array<double>")
    got = matrix.vector_correlations(vectors, block=10)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan
    want = np.corrcoef(v)
    rows = got.collect()
    assert len({(r.i, r.j) for r in rows}) == len(rows) == 200 * 199 // 2
    assert all(r.i < r.j and r.r == pytest.approx(want[r.i, r.j]) for r in rows)


def test_align_fills_gaps(spark):
    values = spark.createDataFrame([("s", "c", 3.0), ("s", "a", 1.0), ("t", "x", 9.0), ("u", "e", 5.0)], "sample string, feature string, value double")
    vocabulary = spark.createDataFrame([(k, i * 2) for i, k in enumerate("abcde")], "feature string, pos int")
    got = {r.sample: (r.vector, r.n_missing) for r in matrix.align(values, vocabulary, "sample", "feature").collect()}
    assert got == {"s": ([1.0, -10.0, 3.0, -10.0, -10.0], 3), "t": ([-10.0] * 5, 5), "u": ([-10.0] * 4 + [5.0], 4)}


def test_results_need_annotations(spark):
    notes = spark.createDataFrame([(1, "What?", "x"), (1, "what?", "y")], "id int, q string, note string")
    good = spark.createDataFrame([(1, "WHAT?")], "id int, q string")
    assert [r.note for r in scoring.annotated(good, notes, "id", "q").collect()] == ["y"]
    with pytest.raises(Exception, match="no annotation of 2"):
        scoring.annotated(good.unionByName(spark.createDataFrame([(2, "what?")], "id int, q string")), notes, "id", "q").collect()


def test_vectors_as_array_files(spark, tmp_path):
    x = spark.createDataFrame([(i, [float(i), 0.5]) for i in range(10)] + [(10, None)], "id int, v array<double>").repartition(3)
    assert writers.npy(x, "v", f"file://{tmp_path}/a") == 10
    assert sorted(r.vector[0] for r in readers.npy(spark, f"file://{tmp_path}/a").collect()) == [float(i) for i in range(10)]


def test_steps():
    p = steps.Steps(stop_on_error=False)
    p.step("a")(lambda results: 1)
    p.step("b")(lambda results: 1 / 0)
    p.step("c")(lambda results: results["a"] + 1)
    assert p.run() == {"a": 1, "c": 2} and p.manifest["b"]["status"] == "error"
    with pytest.raises(KeyError):
        p.run(only=["x"])
    p.stop = True
    with pytest.raises(ZeroDivisionError):
        p.run()
    r = steps.Registry()
    r.register("phi", 1)
    r.register("phi-2", 2)
    assert r.find("microsoft/Phi-2") == 2


def test_sinks(spark):
    x = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert writers.as_json(x).first()[0] == '{"k":1,"v":"a"}'
    assert writers.markdown(x).splitlines()[2:] == ["| 1 | a |", "| 2 |  |"]
    assert writers.as_object(x, "k", "v").first()[0].startswith('{"1":"a"')
    assert steps.predict(x, lambda p: p.assign(n=len(p))[["k", "n"]], 1, "k int, n long").where("n = 1").count() == 2


def test_row_numbers_of_a_sampled_order(spark):
    """More rows than the range bounds' sample holds, with columns that counting doesn't need."""
    df = spark.range(60_000).select(F.xxhash64("id").alias("h"), "id", F.sha2(F.col("id").cast("string"), 256).alias("s"))
    got = ordered.with_row_numbers(df, ["h"]).toPandas().sort_values("row_number")
    assert got.row_number.tolist() == list(range(60_000))
    assert got.h.is_monotonic_increasing and (got.n_rows == 60_000).all()
    assert ordered.with_row_numbers(df.where("id < 0"), ["h"]).count() == 0


@pytest.mark.parametrize("small", [0, ordered.SMALL])
def test_running_sums_share_out_a_hot_key(spark, monkeypatch, small):
    monkeypatch.setattr(ordered, "SMALL", small)
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, (F.col("id") % 50).cast("string"))
    df = spark.range(30_000).select(key.alias("k"), F.xxhash64("id").alias("o"), (F.col("id") % 7).alias("n"), "id")
    got = ordered.running_sums(df, ["k"], [F.desc("o")], {"n": ("upto", "total")})
    assert got.columns == ["k", "o", "n", "id", "upto", "total"]
    want = df.toPandas().sort_values("o", ascending=False)
    want["upto"] = want.groupby("k", dropna=False).n.cumsum()
    want["total"] = want.groupby("k", dropna=False).n.transform("sum")
    have = got.toPandas().set_index("id").sort_index()
    want = want.set_index("id").sort_index()
    assert have.upto.tolist() == want.upto.tolist() and have.total.tolist() == want.total.tolist()


def test_tables_of_collected_results_are_deleted(spark, monkeypatch):
    monkeypatch.setattr(ordered, "SMALL", 0)
    made, real = [], ordered.shared_path
    monkeypatch.setattr(ordered, "shared_path", lambda *a: made.append(real(*a)) or made[-1])
    df = spark.range(100).withColumn("x", F.col("id") % 7)
    assert groups.mad_flags(df, "id", "x").count() == 100
    assert made and not any(os.path.exists(p.removeprefix("file://")) for p in made)


@pytest.mark.parametrize("small", [0, ordered.SMALL])
def test_exact_quantiles(spark, monkeypatch, small):
    monkeypatch.setattr(ordered, "SMALL", small)
    at = [0.0, 0.1, 1 / 3, 0.5, 0.95, 1.0]
    xs = [float(random.Random(3).randrange(40)) for _ in range(9)] + [i * 0.37 % 5 for i in range(4_000)] + [2.5] * 2_000
    df = spark.createDataFrame([(x,) for x in [*xs, None]], "x double").repartition(7)
    got = dict(ordered.quantiles(df, {"x": F.col("x"), "minus": -F.col("x"), "none": F.lit(None)}, at).collect())
    assert got["x"] == pytest.approx(np.quantile(xs, at).tolist(), abs=1e-12)
    assert got["minus"] == pytest.approx((-np.quantile(xs, [1 - p for p in at])).tolist(), abs=1e-12)
    assert set(got) == {"x", "minus"}


def test_align_keeps_the_last_of_repeated_features(spark):
    values = spark.createDataFrame([(1, "a", 9.0, 0), (1, "a", 2.0, 5), (1, "b", 3.0, 1), (2, "x", 1.0, 0), (3, "c", 4.0, 2), (3, "c", 7.0, 1)], "s int, g string, value double, at int")
    vocab = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "pos int, g string")
    got = {r.s: (list(r.vector), r.n_missing) for r in matrix.align(values, vocab, "s", "g", at="at").collect()}
    assert got == {1: ([2.0, 3.0, -10.0], 1), 2: ([-10.0] * 3, 3), 3: ([-10.0, -10.0, 4.0], 2)}
    got = {r.s: list(r.vector) for r in matrix.align(values, vocab, "s", "g").collect()}
    assert got[1] == [9.0, 3.0, -10.0] and got[3] == [-10.0, -10.0, 7.0]


def test_the_last_annotation_counts(spark):
    notes = spark.createDataFrame([(1, "Q?", "z", 1), (1, "q?", "a", 2)], "id int, q string, note string, line int")
    results = spark.createDataFrame([(1, "q?")], "id int, q string")
    assert [tuple(r) for r in scoring.annotated(results, notes, "id", "q", "line").collect()] == [(1, "q?", "a")]


def noisy(spark, n=300, d=8, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * rng.uniform(0.5, 5, d) + rng.normal(size=d)
    x[:, 3] = 2.0  # a constant column
    y = (x[:, 0] / 5 + x[:, 1] / 3 + rng.normal(size=n) > 0.5).astype(int)
    return x, y, spark.createDataFrame([(i, x[i].tolist(), int(y[i]), i % 30) for i in range(n)], "id int, v array<double>, y int, g int")


def test_grid_fits_are_those_of_separate_fits(spark):
    x, y, df = noisy(spark)
    halves = [np.arange(300) % 2 == 0, np.arange(300) % 3 > 0]
    weights = [np.where(m, np.where(y == 1, m.sum() / (2 * (y[m] == 1).sum()), m.sum() / (2 * (y[m] == 0).sum())), 0.0) for m in halves]
    wide = df.join(spark.createDataFrame([(i, float(weights[0][i]), float(weights[1][i])) for i in range(300)], "id int, a double, b double"), "id")
    points = [(s, c, r) for s in (0, 1) for c in (0.01, 1.0, 100.0) for r in (0.1, 0.9)]
    w, b, passes = grid.fit(blocks.pack(wide, "v", ["y", "a", "b"]), 8, 0, [1, 2], points)
    assert passes < 400
    for k in (0, 1):
        part = wide.where("a > 0" if k == 0 else "b > 0")
        train, _ = models.standardize(part, part, "v")
        mean, dev = x[halves[k]].mean(axis=0), x[halves[k]].std(axis=0)
        dev[dev < 1e-9] = 1
        for i, (s, c, r) in enumerate(points):
            if s == k and r == 0.9:
                m = models.fit_logistic(train, "y", c, r)
                want = m.coefficients.toArray() / dev
                assert np.abs(want - w[:, i]).max() < 1e-4 and abs(m.intercept - (want * mean).sum() - b[i]) < 1e-4


def test_nested_folds_choose_as_separate_fits_do(spark):
    _, _, df = noisy(spark, 240)
    points = [(0.003, 0.5), (1.0, 0.5)]
    got = grid.nested(df, "v", "y", "g", 3, 2, [c for c, _ in points], [0.5])
    rows = got.toPandas()
    assert sorted(rows.id) == list(range(240)) and got.columns == ["id", "y", "g", "fold", "c", "l1_ratio", "score"]
    assert rows.groupby("g").fold.nunique().max() == 1 and rows.groupby("fold").c.nunique().max() == 1
    whole = folds.grouped_folds(df, "g", "y", 3)
    for k in range(3):
        train = whole.where(F.col("fold") != k).drop("fold")
        inner = folds.grouped_folds(train, "g", "y", 2, 1)
        means = []
        for c, r in points:
            ap = []
            for j in range(2):
                a, b = models.standardize(inner.where(F.col("fold") != j), inner.where(F.col("fold") == j), "v")
                scored = models.fit_logistic(a, "y", c, r).transform(b).select("y", models.vector_to_array("probability")[1].alias("score"))
                ap.append(metrics.average_precision(scored, []).first()[0])
            means.append(-np.mean(ap))
        assert rows[rows.fold == k].c.unique().tolist() == [points[int(np.argmin(means))][0]]


def test_principal_components_of_dense_and_sparse_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 20)) @ rng.normal(size=(20, 20))
    want = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, v array<double>")
    out, shares = models.principal_components(df, "v", 5)
    assert shares == pytest.approx((want / want.sum())[:5].tolist(), abs=1e-9)
    s = np.array([r.scores for r in out.orderBy("id").collect()])
    assert s.var(axis=0).tolist() == pytest.approx(want[:5].tolist(), rel=1e-6) and np.abs(np.corrcoef(s.T) - np.eye(5)).max() < 1e-6
    at = F.filter(F.sequence(F.lit(0), F.lit(19)), lambda i: F.get("v", i) != 0)
    sparse = df.select("id", F.struct(at.alias("indices"), F.transform(at, lambda i: F.get("v", i)).alias("values")).alias("v"))
    assert models.principal_components(sparse, "v", 5, width=20)[1] == pytest.approx(shares, abs=1e-9)


def test_wide_components(spark):
    """As many columns as a genome has genes: a few values a row, two strong directions."""
    rng = np.random.default_rng(5)
    rows = [(i, ([1, 40_000], [float(5 * rng.normal()), float(3 * rng.normal())]) if i % 2 else ([int(rng.integers(67_000))], [0.01])) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, v struct<indices: array<int>, values: array<double>>")
    _, shares = models.principal_components(df, "v", 2, width=67_000, rounds=15)
    assert sum(shares) > 0.99 and shares[0] > shares[1] > 0.1


@pytest.mark.parametrize("small", [0, ordered.SMALL])
def test_next_rows_over_range_borders(spark, monkeypatch, small):
    monkeypatch.setattr(ordered, "SMALL", small)
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, (F.col("id") % 20).cast("string"))
    df = spark.range(3_000).select(key.alias("k"), F.xxhash64("id").alias("x"), "id")
    got = ordered.with_next(df, ["k"], ["x"], {"x": "x2", "id": "id2"}).toPandas().set_index("id").sort_index()
    want = df.toPandas().sort_values("x")
    want["x2"], want["id2"] = want.groupby("k", dropna=False).x.shift(-1), want.groupby("k", dropna=False).id.shift(-1)
    want = want.set_index("id").sort_index()
    assert got.id2.fillna(-1).tolist() == want.id2.fillna(-1).tolist()
    assert got.x2.isna().sum() == got.id2.isna().sum() == df.select("k").distinct().count()


@pytest.mark.parametrize("small", [0, ordered.SMALL])
def test_quartiles_by_group(spark, monkeypatch, small):
    monkeypatch.setattr(ordered, "SMALL", small)
    rng = random.Random(6)
    rows = [(rng.choice(["a", "a", "a", "b", None]), f"p{rng.randint(0, 60)}", f"s{rng.randint(0, 9)}", rng.choice([None, rng.randint(0, 50)]), rng.random() < 0.5) for _ in range(700)]
    got = {r.category: r for r in groups.breakdown(spark.createDataFrame(rows, "g string, p string, s string, m int, r boolean"), "g", "p", "s", "m", "r").collect()}
    assert set(got) == {"a", "b", None, "TOTAL"}
    for name, r in got.items():
        own = [x for x in rows if name == "TOTAL" or x[0] == name]
        m = [x[3] for x in own if x[3] is not None]
        per = list(__import__("collections").Counter(x[1] for x in own).values())
        assert (r.measure_q1, r.measure_median, r.measure_q3) == pytest.approx(np.quantile(m, [0.25, 0.5, 0.75]).tolist(), abs=1e-6)
        assert (r.spp_q1, r.spp_median, r.spp_q3) == pytest.approx(np.quantile(per, [0.25, 0.5, 0.75]).tolist(), abs=1e-6)
        assert (r.n_samples, r.n_patients, r.measure_n) == (len(own), len(per), len(m))


def test_nested_folds_score_held_out_rows_only(spark, monkeypatch):
    """A row is scored by the models it is held out for, and a pass has a task per core, however the input is cut."""
    _, _, df = noisy(spark, 240)
    packed, scored, pack, scores = [], [], grid.B.pack, grid.scores

    def counted(*a):
        scored.append(scores(*a).count())
        return scores(*a)

    monkeypatch.setattr(grid.B, "pack", lambda x, *a: packed.append(x.rdd.getNumPartitions()) or pack(x, *a))
    monkeypatch.setattr(grid, "scores", counted)
    got = grid.nested(df.repartition(17), "v", "y", "g", 3, 2, [0.01, 1.0], [0.5], rounds=5)
    assert got.count() == 240
    assert scored == [240 * 2 * 2, 240] and packed == [spark.sparkContext.defaultParallelism]  # rows x outer folds they train in x points


def test_many_groups_are_dealt_without_the_driver(spark, monkeypatch):
    df = spark.range(60_000).select(F.concat(F.lit("g"), F.floor(F.sqrt(F.col("id") * 100)).cast("string")).alias("g"), (F.pmod(F.xxhash64("id"), F.lit(5)) == 0).cast("int").alias("y"))
    whole = folds.fold_table(folds.grouped_folds(df, "g", "y", 5), "g", "y").collect()
    monkeypatch.setattr(folds, "GREEDY", 100)
    got = folds.grouped_folds(df, "g", "y", 5)
    assert folds.leaking_groups(got, "g").count() == 0 and got.count() == 60_000
    for r in [*folds.fold_table(got, "g", "y").collect(), *whole]:
        assert abs(r.n / 12_000 - 1) < 0.01 and abs(r.n_pos / (60_000 / 25) - 1) < 0.05


def test_folds_fitted_side_by_side(spark):
    _, _, df = noisy(spark)
    x = df.withColumn("fold", (F.col("id") % 3).cast("int"))
    a = grid.cross_validate(x, "v", "y", 3).toPandas().set_index("id").score.sort_index()
    b = models.cross_validate(x, "v", "y", "fold").toPandas().set_index("id").score.sort_index()
    assert len(a) == 300 and np.abs(a - b).max() < 1e-4


def test_reports_and_reference_numbers(spark, tmp_path):
    x = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert writers.report([("One", x), ("Two", x.limit(0))], {"k": "Key"}) == "## One\n\n| Key | v |\n|---|---|\n| 1 | a |\n| 2 |  |\n\n## Two\n\n| Key | v |\n|---|---|\n"
    (tmp_path / "b.json").write_text('{"n": 3, "auc": 0.75}')
    path = lambda n: f"file://{tmp_path}/{n}.json"
    assert readers.first_scalar(spark, [path("a"), path("b")], ["mean_auc", "auc", "n"]) == 0.75
    assert readers.first_scalar(spark, [path("b")], ["x"]) is None and readers.first_scalar(spark, [path("a")], ["x"]) is None

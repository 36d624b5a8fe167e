"""Elastic-net logistic models of many grid points and training sets at once, and their choice in nested grouped folds.

Each model is a column of one coefficient matrix. A step of the proximal gradient method needs one pass over the data for all
columns, so that the number of Spark jobs does not depend on the grid or on the number of folds. Features are standardized
by each training set's own means and population deviations, within the pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import folds, metrics

# The published grid.
CS = tuple(float(c) for c in np.logspace(-4, 4, 10))
RATIOS = (0.1, 0.3, 0.5, 0.7, 0.9)
# Fixed values end.

#: Rows of a block that a step takes at once: what it makes of them for one training set stays in the processor's cache.
ROWS = 1024
#: Bytes of packed rows in a partition.
PART_BYTES = 64 << 20


def logistic(z: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-z)), in the place of ``z``."""
    np.clip(z, -500, 500, out=z)
    np.negative(z, out=z)
    np.exp(z, out=z)
    z += 1
    return np.reciprocal(z, out=z)


def statistics(blocks: DataFrame, sets: list[int], d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, means, population deviations) of each training set; ``sets``: the columns of ``e`` that hold its weights, 0 for rows outside."""

    def sums(x, e):
        inside = (e[:, sets] > 0).astype(float)
        return np.concatenate([inside.sum(axis=0), (inside.T @ x).ravel(), (inside.T @ (x * x)).ravel()])

    s, k = B.total(blocks, sums, len(sets) * (1 + 2 * d)), len(sets)
    n = np.maximum(s[:k], 1)
    mean = s[k : k + k * d].reshape(k, d) / n[:, None]
    var = s[k + k * d :].reshape(k, d) / n[:, None] - mean * mean
    dev = np.sqrt(np.maximum(var, 0))
    return n, mean, np.where(dev > 1e-9 * np.maximum(np.abs(mean), 1), dev, 1.0)


def fit(blocks: DataFrame, d: int, y: int, sets: list[int], columns: list[tuple[int, float, float]], rounds: int = 400, tol: float = 1e-7) -> tuple[np.ndarray, np.ndarray, int]:
    """(coefficients d x columns, intercepts, passes) for raw features. ``columns``: (place in ``sets``, C, l1 ratio) of each model.

    The objective is the weighted mean log-loss plus 1 / (C n) times the elastic-net term, intercepts free.
    """
    n, mean, dev = statistics(blocks, sets, d)
    at = np.array([c[0] for c in columns])
    lam = 1 / (np.array([c[1] for c in columns]) * n[at])
    l1, l2 = lam * np.array([c[2] for c in columns]), lam * (1 - np.array([c[2] for c in columns]))
    mu, sd = mean[at].T, dev[at].T
    which = np.array(sets)

    def largest():
        """The largest eigenvalue of each set's weighted Gram matrix, a little raised: power iteration, a pass a step."""
        v, value = np.ones((d + 1, len(sets))) / np.sqrt(d + 1), np.ones(len(sets))
        for _ in range(30):
            a = v[:d] / dev.T
            c = v[d] - (mean.T * a).sum(axis=0)

            def image(x, e, a=a, c=c):
                r = (x @ a + c) * e[:, which]
                return np.concatenate([(x.T @ r).ravel(), r.sum(axis=0)])

            s = B.total(blocks, image, (d + 1) * len(sets))
            low = s[d * len(sets) :] / n
            up = (s[: d * len(sets)].reshape(d, -1) / n - mean.T * low) / dev.T
            w = np.vstack([up, low])
            old, value = value, np.linalg.norm(w, axis=0)
            v = w / np.maximum(value, 1e-300)
            if np.all(np.abs(value - old) <= 1e-3 * value):
                break
        return value * 1.05

    step = 1 / (0.25 * largest()[at] + l2)
    g = len(columns)
    w, b = np.zeros((d, g)), np.zeros(g)
    u, c, t = w.copy(), b.copy(), np.ones(g)
    live = np.ones(g, bool)
    for used in range(1, rounds + 1):
        on = np.nonzero(live)[0]  # settled models take no part in later passes
        a = u[:, on] / sd[:, on]
        k = c[on] - (mu[:, on] * a).sum(axis=0)
        owned = [(which[i], m, a[:, m], k[m]) for i in np.unique(at[on]) for m in [np.nonzero(at[on] == i)[0]]]

        def gradient(x, e, owned=owned, g=len(on)):
            out = np.zeros((d + 1, g))
            for i in range(0, len(x), ROWS):
                part, extra = x[i : i + ROWS], e[i : i + ROWS]
                for column, m, own_a, own_k in owned:
                    inside = np.nonzero(extra[:, column])[0]  # rows outside a training set add nothing to its models
                    own, weight = part[inside], extra[inside]
                    r = own @ own_a
                    r += own_k
                    logistic(r)
                    r -= weight[:, y : y + 1]
                    r *= weight[:, column : column + 1]
                    out[:d, m] += own.T @ r
                    out[d, m] += r.sum(axis=0)
            return out.ravel()

        s = (B.total(blocks, gradient, (d + 1) * len(on)).reshape(d + 1, -1) / n[at[on]]).ravel()
        low = s[d * len(on) :]
        up = (s[: d * len(on)].reshape(d, -1) - mu[:, on] * low) / sd[:, on] + l2[on] * u[:, on]
        moved = u[:, on] - step[on] * up
        new_w = np.sign(moved) * np.maximum(np.abs(moved) - step[on] * l1[on], 0)
        new_b = c[on] - step[on] * low
        # Momentum starts anew where it points uphill.
        uphill = ((u[:, on] - new_w) * (new_w - w[:, on])).sum(axis=0) + (c[on] - new_b) * (new_b - b[on]) > 0
        t_old = np.where(uphill, 1.0, t[on])
        t_new = (1 + np.sqrt(1 + 4 * t_old**2)) / 2
        pace = np.where(uphill, 0.0, (t_old - 1) / t_new)
        change = np.maximum(np.abs(new_w - w[:, on]).max(axis=0, initial=0), np.abs(new_b - b[on]))
        u[:, on], c[on] = new_w + pace * (new_w - w[:, on]), new_b + pace * (new_b - b[on])
        w[:, on], b[on], t[on] = new_w, new_b, t_new
        live[on[change < tol]] = False
        if not live.any():
            break
    raw = w / sd
    return raw, b - (mu * raw).sum(axis=0), used


def nested(df: DataFrame, features: str, y: str, group: str, outer: int = 5, inner: int = 3, cs=CS, ratios=RATIOS, seed: int = 0, rounds: int = 400) -> DataFrame:
    """The rows of ``df`` (without features) with ``fold, c, l1_ratio, score``: held-out scores of every outer fold by the model that
    the mean average precision over its inner folds chose, of equal ones the first of the grid.

    Folds keep groups together and spread classes (``folds.grouped_folds``). Weights are n / (2 n_class). All inner models are
    fitted side by side, then all chosen ones.
    """
    points = [(float(c), float(r)) for c in cs for r in ratios]
    keep = [c for c in df.columns if c != features]
    # Folds are of groups: all of them come out of one table of the groups' class counts, and the rows are joined once.
    stats = folds.class_counts(df, group, y).persist()
    table = stats.join(folds.folds_of_counts(stats, outer, seed).withColumnRenamed("_g", "_own"), F.col("_g").eqNullSafe(F.col("_own"))).drop("_own").persist()
    every = table.select("_g", "fold")
    names: list[tuple[int, int | None]] = []
    for k in range(outer):
        train = table.where(F.col("fold") != k).select("_g", "n0", "n1")
        fits = folds.inner_folds(train.count(), inner)
        own = folds.folds_of_counts(train, fits, seed + 1).select(F.col("_g").alias("_own"), F.col("fold").alias(f"_inner{k}"))
        every = every.join(own, F.col("_g").eqNullSafe(F.col("_own")), "left").drop("_own")
        names += [(k, None), *[(k, j) for j in range(fits)]]
    every = every.persist()
    every.count()
    rows = df.join(every, df[group].eqNullSafe(every["_g"])).drop("_g")
    inside = [(F.col("fold") != k) if j is None else (F.col("fold") != k) & (F.col(f"_inner{k}") != j) for k, j in names]
    pos = F.col(y) == 1
    counts = rows.agg(*[F.count_if(m).alias(f"n{i}") for i, m in enumerate(inside)], *[F.count_if(m & pos).alias(f"p{i}") for i, m in enumerate(inside)]).first()

    def weight(i):
        n, p = counts[f"n{i}"], counts[f"p{i}"]
        return F.when(inside[i], F.when(pos, n / (2.0 * max(p, 1))).otherwise(n / (2.0 * max(n - p, 1)))).otherwise(0.0)

    d = rows.select(F.size(features)).first()[0]
    # Every pass has a task per partition: as many as cores, more only if these would hold too much.
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-sum(counts[f"n{i}"] for i, (_, j) in enumerate(names) if j is None) * 8 * (d + 1 + len(names)) // (max(outer - 1, 1) * PART_BYTES)))
    rows = rows.repartition(parts)
    packed = B.pack(rows.select(F.col(features), pos.cast("double").alias("_y"), *[weight(i).alias(f"_w{i}") for i in range(len(names))]), features, ["_y", *[f"_w{i}" for i in range(len(names))]])
    tuned = [i for i, (_, j) in enumerate(names) if j is not None]
    models = [(i, *p) for i in range(len(tuned)) for p in points]
    w, b, _ = fit(packed, d, 0, [1 + i for i in tuned], models, rounds)
    # A row is scored by those models that its inner fold was held out of; it has no inner fold where its outer one is held out.
    held = [(f"_inner{names[i][0]}", names[i][1], range(at * len(points), (at + 1) * len(points))) for at, i in enumerate(tuned)]
    valid = scores(rows.withColumn("y", F.col(y)), features, ["y"], w, b, held)
    k_of = F.element_at(F.array(*[F.lit(names[i][0]) for i in tuned]), (F.floor(F.col("model") / len(points)) + 1).cast("int"))
    ap = metrics.average_precision(valid, ["model"]).groupBy(k_of.alias("k"), (F.col("model") % len(points)).alias("point")).agg(F.avg(F.coalesce("average_precision", F.lit(0.0))).alias("ap")).collect()  # a row per outer fold and grid point
    best = [min((-r.ap, r.point) for r in ap if r.k == k)[1] for k in range(outer)]
    finals = [i for i, (_, j) in enumerate(names) if j is None]
    w, b, _ = fit(packed, d, 0, [1 + i for i in finals], [(k, *points[best[k]]) for k in range(outer)], rounds)
    for kept in (packed, table, stats):
        kept.unpersist()
    chosen = lambda x: F.element_at(F.array(*[F.lit(points[best[k]][x]) for k in range(outer)]), F.col("fold") + 1)
    return scores(rows, features, [*keep, "fold"], w, b, [("fold", k, [k]) for k in range(outer)]).select(*keep, "fold", chosen(0).alias("c"), chosen(1).alias("l1_ratio"), "score")


def scores(df: DataFrame, features: str, columns: list[str], w: np.ndarray, b: np.ndarray, held: list[tuple[str, int, list[int]]]) -> DataFrame:
    """``columns, model, score``: the probability of each row by those models that it is held out for. ``held``: (column, its value in
    such rows, models)."""
    kind = df.select(*columns).schema
    marks = list(dict.fromkeys(c for c, _, _ in held))

    def run(batches):
        for t in batches:
            if not len(t):
                continue
            x = B.matrix_of(t.column(0))
            seen = {c: t.column(1 + len(columns) + i).to_numpy(zero_copy_only=False) for i, c in enumerate(marks)}
            for c, value, models in held:
                at, models = np.nonzero(seen[c] == value)[0], np.array(models)
                if len(at):
                    p = logistic(x[at] @ w[:, models] + b[models])
                    again = pa.array(np.tile(at, len(models)))
                    yield pa.RecordBatch.from_arrays([*[t.column(1 + i).take(again) for i in range(len(columns))], pa.array(np.repeat(models, len(at)).astype(np.int32)), pa.array(p.T.ravel())], [*columns, "model", "score"])

    return df.select(features, *columns, *[F.col(c).cast("int").alias(f"_mark{i}") for i, c in enumerate(marks)]).mapInArrow(run, kind.add("model", "integer").add("score", "double"))


def cross_validate(df: DataFrame, features: str, y: str, k: int, fold: str = "fold", c: float = 1.0, l1_ratio: float = 0.0) -> DataFrame:
    """The rows of ``df`` without features, with ``score``: held-out scores of each of the folds 0 to k - 1 by a balanced model of
    the others. All folds are fitted in the same passes."""
    keep = [x for x in df.columns if x != features]
    pos = F.col(y) == 1
    inside = [F.col(fold) != j for j in range(k)]
    n = df.agg(*[F.count_if(m).alias(f"n{j}") for j, m in enumerate(inside)], *[F.count_if(m & pos).alias(f"p{j}") for j, m in enumerate(inside)]).first()
    weight = lambda j: F.when(inside[j], F.when(pos, n[f"n{j}"] / (2.0 * max(n[f"p{j}"], 1))).otherwise(n[f"n{j}"] / (2.0 * max(n[f"n{j}"] - n[f"p{j}"], 1)))).otherwise(0.0)
    packed = B.pack(df.select(F.col(features), pos.cast("double").alias("_y"), *[weight(j).alias(f"_w{j}") for j in range(k)]), features, ["_y", *[f"_w{j}" for j in range(k)]])
    w, b, _ = fit(packed, df.select(F.size(features)).first()[0], 0, list(range(1, k + 1)), [(j, c, l1_ratio) for j in range(k)])
    packed.unpersist()
    return scores(df, features, keep, w, b, [(fold, j, [j]) for j in range(k)]).drop("model")

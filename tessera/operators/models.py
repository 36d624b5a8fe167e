"""Fits: class-balanced logistic models in grouped cross-validation, principal components, linkage, embedding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from . import blocks


def standardize(train: DataFrame, test: DataFrame, features: str) -> tuple[DataFrame, DataFrame]:
    """Both sides by the training side's means and population deviations; constant columns are divided by 1.

    One pass over vectors however many columns there are; the statistics come back as one broadcast row.
    """
    held = train.select(array_to_vector(features).alias("v")).select(Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("s"))
    stats = held.select(vector_to_array("s.mean").alias("_mean"), vector_to_array("s.variance").alias("_var"), F.col("s.count").alias("_n"))
    dev = F.transform("_var", lambda x: F.sqrt(F.greatest(x * (F.col("_n") - 1) / F.col("_n"), F.lit(0.0))))
    stats = stats.select("_mean", F.transform(dev, lambda x: F.when(x > 0, x).otherwise(1.0)).alias("_dev"))
    z = F.zip_with(F.zip_with(features, "_mean", lambda x, m: x - m), "_dev", lambda x, s: x / s)
    return tuple(df.crossJoin(F.broadcast(stats)).withColumn("features", array_to_vector(z)).drop("_mean", "_dev") for df in (train, test))


def fit_logistic(train: DataFrame, y: str, c: float = 1.0, l1_ratio: float = 0.0):
    """A logistic model with weights n / (2 n_class). C of the usual objective maps to regParam = 1 / (C n)."""
    n, pos = train.agg(F.count(F.lit(1)), F.count_if(F.col(y) == 1)).first()
    weight = F.when(F.col(y) == 1, n / (2.0 * max(pos, 1))).otherwise(n / (2.0 * max(n - pos, 1)))
    data = train.withColumn("_w", weight).withColumn("_y", F.col(y).cast("double"))
    lr = LogisticRegression(featuresCol="features", labelCol="_y", weightCol="_w", regParam=1.0 / (c * max(n, 1)), elasticNetParam=l1_ratio, standardization=False, maxIter=100)
    return lr.fit(data)


def cross_validate(df: DataFrame, features: str, y: str, fold: str, c: float = 1.0) -> DataFrame:
    """The rows of ``df`` without features, with ``score``: held-out scores of every fold by a balanced L2 model of the others."""
    out = None
    keep = [x for x in df.columns if x != features]
    for k in [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]:
        a, b = standardize(df.where(F.col(fold) != k), df.where(F.col(fold) == k), features)
        got = fit_logistic(a, y, c).transform(b).withColumn("score", vector_to_array("probability")[1]).select(*keep, "score")
        out = got if out is None else out.unionByName(got)
    return out


def principal_components(df: DataFrame, features: str, k: int, width: int | None = None, spare: int = 10, rounds: int = 60, tol: float = 1e-10) -> tuple[DataFrame, list[float]]:
    """(df with centred ``scores``, shares of variance) by subspace iteration, for any number of rows and many columns.

    ``features`` are arrays, or structs of ``indices`` and ``values`` with the given ``width``. A round multiplies ``k + spare`` directions
    by the covariance in one pass of block products; neither it nor an average per column is ever built. The driver holds
    two matrices of columns by directions (67,000 by 60: 32 MB each) and makes them orthogonal. Rounds end when the
    variances change by less than ``tol`` of the largest. There are at most min(rows, columns) - 1 components, or all columns.
    """
    packed = blocks.pack(df, features, [], width)
    d = width or df.select(F.size(features)).first()[0]
    s = blocks.total(packed, lambda x, e: np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)]), 2 * d + 1)
    n, mean = max(s[0], 1.0), s[1 : d + 1] / max(s[0], 1.0)
    whole = (s[d + 1 :] / n - mean * mean).sum()
    k = min(k, d)
    q = np.linalg.qr(np.random.default_rng(0).normal(size=(d, min(d, k + spare))))[0]
    values = np.zeros(k)
    for _ in range(rounds):

        def product(x, e, q=q):
            c = x - mean
            return (c.T @ (c @ q)).ravel()

        image = blocks.total(packed, product, q.size).reshape(q.shape) / n
        found, turn = np.linalg.eigh(q.T @ image)
        order = np.argsort(-found)
        old, values = values, found[order][:k]
        top = q @ turn[:, order]
        q = np.linalg.qr(image @ turn[:, order])[0]
        if np.abs(values - old).max() <= tol * max(values[0], 1e-300):
            break
    packed.unpersist()
    top = top[:, :k] * np.where(top[np.abs(top).argmax(axis=0), np.arange(top.shape[1])] < 0, -1, 1)[:k]
    columns = [c for c in df.columns if c != "scores"]

    def project(batches):
        for t in batches:
            x = blocks.matrix_of(t.column(0), width)
            rows = list((x - mean) @ top) if len(t) else []
            yield pa.RecordBatch.from_arrays([*t.columns[1:], pa.array(rows, pa.list_(pa.float64()))], [*columns, "scores"])

    out = df.select(F.col(features).alias("_x"), *columns).mapInArrow(project, df.select(*columns).schema.add("scores", ArrayType(DoubleType())))
    return out, (np.maximum(values, 0) / max(whole, 1e-300)).tolist()


def average_linkage(dist: np.ndarray) -> np.ndarray:
    """(n - 1) x 4 merges (left, right, height, size) by average linkage, lowest first, for some thousand rows on one machine.

    Chains of nearest neighbours: each step looks at one row, so that all of it takes about n squared steps.
    """
    n = len(dist)
    d = dist.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, live = np.ones(n), np.ones(n, bool)
    found, chain = [], []
    for _ in range(n - 1):
        if not chain:
            chain.append(int(live.argmax()))
        while True:
            i = chain[-1]
            j = int(d[i].argmin())
            if len(chain) > 1 and d[i, chain[-2]] <= d[i, j]:
                j = chain[-2]
                break
            chain.append(j)
        del chain[-2:]
        i, j = min(i, j), max(i, j)
        found.append((d[i, j], i, j))
        row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        row[~live] = np.inf
        d[i], d[:, i] = row, row
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        live[j] = False
        size[i] += size[j]
    out, top, count = [], list(range(n)), np.ones(2 * n - 1)
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for step, (height, i, j) in enumerate(sorted(found, key=lambda x: x[0])):
        i, j = root(i), root(j)
        a, b = sorted((top[i], top[j]))
        count[n + step] = count[a] + count[b]
        out.append((a, b, height, count[n + step]))
        parent[j], top[i] = i, n + step
    return np.array(out)


def leaf_order(merges: np.ndarray) -> list[int]:
    """Leaves from left to right."""
    n = len(merges) + 1
    out, todo = [], [2 * n - 2]
    while todo:
        x = todo.pop()
        if x < n:
            out.append(int(x))
        else:
            todo += [int(merges[x - n][1]), int(merges[x - n][0])]
    return out


def tsne(x: np.ndarray, perplexity: float = 30.0, rounds: int = 300, seed: int = 0) -> np.ndarray:
    """Exact two-dimensional t-SNE by gradient descent, for some thousand rows: a few n x n arrays."""
    n = len(x)

    def square(z):
        own = (z * z).sum(axis=1)
        return np.maximum(own[:, None] + own[None] - 2 * (z @ z.T), 0)

    d = square(x)
    p = np.zeros((n, n))
    for i in range(n):
        lo, hi, beta = 0.0, np.inf, 1.0
        own = np.delete(d[i], i)
        for _ in range(50):
            w = np.exp(-(own - own.min()) * beta)
            h = np.log(w.sum()) + beta * ((own - own.min()) * w).sum() / w.sum()
            if abs(h - np.log(min(perplexity, (n - 1) / 3))) < 1e-5:
                break
            lo, hi = (beta, hi) if h > np.log(min(perplexity, (n - 1) / 3)) else (lo, beta)
            beta = beta * 2 if hi == np.inf else (lo + hi) / 2
        p[i, np.arange(n) != i] = w / w.sum()
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    rng = np.random.default_rng(seed)
    y, v = rng.normal(0, 1e-4, (n, 2)), np.zeros((n, 2))
    for t in range(rounds):
        q = 1 / (1 + square(y))
        np.fill_diagonal(q, 0)
        w = ((p * (12 if t < 100 else 1)) - q / q.sum()) * q
        g = 4 * (w.sum(axis=1)[:, None] * y - w @ y)
        v = (0.5 if t < 100 else 0.8) * v - max(n / 12, 10) * g
        y = y + v
        y -= y.mean(axis=0)
    return y

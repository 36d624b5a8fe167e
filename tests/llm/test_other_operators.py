"""Archive, vector search, shared helpers, the pipeline, the registered queries."""

import math
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import session
from tessera.llm import ann, common, queries, warc_store

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_duckdb(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    want = con.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    df = queries.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=repr) == sorted(want.fetchall(), key=repr)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_other_queries_cover_their_table(spark, sf, name):
    table = "pages" if name.startswith("op1_") else "documents"
    assert queries.QUERIES[name](spark, sf).count() == spark.read.parquet(f"{sf}/{table}.parquet").count()


# --- archive


def test_archive_round_trip(spark):
    big, other = "ü" * 80, "x" * 150
    rows = [(1, "u", big), (3, "u", big), (1, "v", big), (None, "u", big), (5, None, None), (6, "a", ""), (7, "a\r\nb", "sm"), (8, "b", "sm"), (9, "c", other)]
    pages = spark.createDataFrame([(*r, "extra", 1) for r in rows], "page_id long, url string, html string, digest string, row int")
    folder = common.new_path(spark, "archive")
    warc_store.write_archive(pages, folder)
    assert spark.read.parquet(f"{folder}/payloads").count() == 4
    got = warc_store.read_back(spark, folder).collect()
    assert len(got) == len(rows)
    heavy = [r for r in got if r.payload_bytes == 160]
    assert sorted(r.record_type for r in heavy) == ["response"] + ["revisit"] * 3
    lead = [r for r in heavy if r.record_type == "response"]
    assert lead[0].page_id == 1 and all(r.refers_to == 1 for r in heavy if r.record_type == "revisit")
    assert all(r.record_type == "response" and r.refers_to is None for r in got if r.payload_bytes < 100)
    out = common.new_path(spark, "warc")
    files = [r.file for r in warc_store.export_files(spark, folder, out).collect()]
    back = warc_store.read_files(spark, files).collect()
    payloads = sorted((r.payload.decode() for r in back if r.fields["WARC-Type"] == "response"))
    assert payloads == sorted(["", "", "sm", "sm", big, other])
    exact = {bytes(r.record) for r in warc_store.records(spark, folder).select("record").collect()}
    assert all(warc_store.parse_records(x) for x in exact)


def test_archive_finds_damage(spark):
    folder = common.new_path(spark, "archive")
    warc_store.write_archive(spark.createDataFrame([(1, "u", "x" * 120)], "page_id long, url string, html string"), folder)
    p = spark.read.parquet(f"{folder}/payloads").selectExpr("digest", "cast('other' as binary) as payload").collect()
    spark.createDataFrame(p, "digest string, payload binary").write.mode("overwrite").parquet(f"{folder}/payloads")
    with pytest.raises(Exception, match="does not match"):
        warc_store.read_back(spark, folder).collect()


def test_archive_checks_lengths_and_names_its_records(spark):
    folder = common.new_path(spark, "archive")
    warc_store.write_archive(spark.createDataFrame([(1, "u", "x" * 120), (2, "v", "x" * 120), (3, "w", "long " * 400_000)], "page_id long, url string, html string"), folder)
    heads = {r.page_id: r.header.decode() for r in spark.read.parquet(f"{folder}/headers").collect()}
    assert heads[1].split("WARC-Record-ID: ")[1].split("\r")[0] == heads[2].split("WARC-Refers-To: ")[1].split("\r")[0]
    assert {r.page_id: r.payload_bytes for r in warc_store.read_back(spark, folder).collect()} == {1: 120, 2: 120, 3: 2_000_000}
    bad = [(*r[:7], bytearray(r.header.replace(b"Content-Length: 120", b"Content-Length: 121"))) for r in spark.read.parquet(f"{folder}/headers").collect()]
    schema = spark.read.parquet(f"{folder}/headers").schema
    spark.createDataFrame(bad, schema).write.mode("overwrite").parquet(f"{folder}/headers")
    with pytest.raises(Exception, match="Content-Length"):
        warc_store.read_back(spark, folder).collect()


def test_archive_of_nothing(spark):
    folder = common.new_path(spark, "archive")
    warc_store.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc_store.read_back(spark, folder).count() == 0


# --- vector search


def brute_search(ids, x, queries_, k):
    out = []
    for q in queries_:
        s = sorted(((-float(sum(a * b for a, b in zip(x[i], x[q]))), ids[i]) for i in range(len(ids)) if ids[i] != ids[q]))[:k]
        out += [(ids[q], n + 1, v, -a) for n, (a, v) in enumerate(s)]
    return out


def test_search_with_ties_and_bad_rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(90, 6)).astype(np.float32)
    x[40:70] = x[40]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(200, None), (220, [0.0] * 6), (240, [math.nan] * 6), (260, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (280, [math.inf] + [1.0] * 5), (300, [1.0] * 5), (320, []), (None, [9.0] * 6)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + bad], "vec_id long, embedding array<float>, code string, rank int")
    got = [tuple(r) for r in ann.search(df, lambda c: c % 20 == 0, 5).orderBy("query_id", "rank").collect()]
    want = brute_search(list(range(90)), x.astype(float), range(0, 90, 20), 5)
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want])
    few = ann.search(df.where("vec_id in (0, 1, 2)"), lambda c: c == 0, 20).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]
    assert ann.search(df.limit(0), lambda c: c == 0).count() == 0 and ann.search(df.where("vec_id >= 200"), lambda c: c < 250, 3).count() == 0


def test_recall_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 700)
    monkeypatch.setattr(ann, "QUERIES", 20)
    x = np.random.default_rng(1).normal(size=(2000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(df, lambda c: c % 50 == 0, 20, rerank=100).toPandas()
    hit = 0
    for q, g in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:20]) & set(g.vec_id))
    assert len(got) == 40 * 20 and hit / len(got) >= 0.9


def test_parallel_errors_weigh_more():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16))
    g = ann.weight(16, 0.5)
    books = ann.fit(x, g)
    parallel = lambda h: np.abs(((x - np.concatenate([books[j][c] for j, c in enumerate(ann.encode(x, books, h).T)], axis=1)) * x).sum(axis=1)).mean()
    assert parallel(g) < parallel(1.0)


# --- helpers and pipeline


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (5, 5), (8, 7), (7, 4), (3, 2)] + [(100 + i, 101 + i) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 50)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got[3] == 1 and got[9] == 4 and got[140] == 100 and got[1049] == 1000 and 5 not in got
    assert len(got) == len({x for a, b in edges if a != b for x in (a, b)})
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_filter_by_ids_both_ways(spark, monkeypatch):
    df, ids = spark.range(10).toDF("k"), spark.createDataFrame([(1,), (2,), (2,), (None,)], "x long")
    for bound in (100, 0):
        monkeypatch.setattr(common, "BROADCAST_IDS", bound)
        assert common.filter_by_ids(df, ids, "k", "left_semi").count() == 2 and common.filter_by_ids(df, ids, "k", "left_anti").count() == 8


def test_filter_by_ids_computes_them_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    ids = spark.range(3).mapInArrow(count, "id long")
    assert common.filter_by_ids(spark.range(10).toDF("k"), ids, "k", "left_anti").count() == 7 and seen.value == 3


def test_written_tables_leave_no_shuffle_files(spark):
    folders = [f.getPath() for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    held = lambda: {x for top in folders for _, _, names in os.walk(top) for x in names if x.startswith("shuffle_")}
    before, key = held(), session.CLEAN_KEY
    set_to = spark.conf.get(key, None)
    df = spark.range(1000).repartition(5, "id").groupBy((F.col("id") % 10).alias("k")).count()
    out = common.written(df, "counts")
    until = time.time() + 20
    while held() - before and time.time() < until:
        time.sleep(0.1)
    assert not held() - before and spark.conf.get(key, None) == set_to
    assert out.count() == 10 and df.count() == 10


@pytest.fixture(scope="module")
def stages():
    import corpus_pipeline

    return corpus_pipeline


def test_pipeline_stages(spark, sf, stages):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    counts = [docs.count()]
    for _, f in stages.STAGES[:-1]:
        docs = common.written(f(spark, docs, sf), "stage")
        assert docs.columns == names
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] > 0.5 * counts[0]
    last = stages.STAGES[-1][1](spark, docs, sf)
    assert last.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and last.count() == counts[4]
    assert stages.run(spark, sf).count() == counts[4]


def test_pipeline_plans_stay_small(spark, sf, stages, monkeypatch):
    """All jobs of a plan run at once, and the driver holds what each of them sends."""
    plain, found = common.written, []

    def written(df, name, *more):
        found.append((df._jdf.queryExecution().executedPlan().toString().count("Exchange "), name))
        return plain(df, name, *more)

    monkeypatch.setattr(common, "written", written)
    stages.run(spark, sf)
    assert len(found) > 20 and max(found)[0] <= 16, sorted(found)[-5:]


def test_pipeline_on_odd_and_no_rows(spark, sf, stages, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        names = docs.columns
        for _, f in stages.STAGES[:-1]:
            docs = common.written(f(spark, docs, sf), "stage")
            assert docs.columns == names
        assert stages.STAGES[-1][1](spark, docs, sf).count() == docs.count()

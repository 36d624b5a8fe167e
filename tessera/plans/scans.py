"""Scans, projections, joins with defaults, positional joins, set operations, sinks, streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import nets
from tessera.sources import matrix_files, readers, writers
from tessera.session import load, shared_path
from tessera.streaming import ingest

from . import steps
from .registry import DEMO_NETS, query, sql_first


@query("SELECT count(*) AS n_rows, max(doc_id) + 1 AS n_ids FROM documents")
def table_shape(spark, d):
    return load(spark, d, "documents").agg(F.count(F.lit(1)).alias("n_rows"), (F.max("doc_id") + 1).alias("n_ids"))


@query("SELECT doc_id, coalesce(lang, '') AS lang, '' AS missing, source AS series FROM documents")
def field_scan(spark, d):
    """Projection by name: an absent column reads as empty, a renamed one by its candidates."""
    x = load(spark, d, "documents")
    name = readers.first_present(x, "series_id", "series", "source", required=True)
    return x.select("doc_id", readers.field(x, "lang").alias("lang"), readers.field(x, "title").alias("missing"), F.col(name).alias("series"))


WANTED = (42, 7, 101, 7, 3, 150)


@query("SELECT CAST(pos AS INT) AS pos, doc_id, n_chars FROM (VALUES " + ", ".join(f"({i}, {w})" for i, w in enumerate(WANTED)) + ") t(pos, doc_id) JOIN documents USING (doc_id)")
def lookup_in_order(spark, d):
    return readers.in_order(load(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", list(WANTED)).select("pos", "doc_id", "n_chars")


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS INT) % 10 AS k, count(*) AS n FROM events GROUP BY ALL")
def json_props(spark, d):
    k = F.from_json("props", "k int")["k"] % 10
    return load(spark, d, "events").groupBy("event_type", k.alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, text AS decoded FROM documents")
def byte_decode(spark, d):
    return load(spark, d, "documents").select("doc_id", readers.decoded(F.encode("text", "UTF-8")).alias("decoded"))


@query("SELECT p_partkey, p_name, CAST(p_size AS INT) AS p_size FROM part")
def csv_dimension(spark, d):
    """A dimension written as CSV and read again with its schema, columns pruned."""
    path = shared_path(spark, "part") + ".csv"
    writers.csv(load(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"), path)
    return readers.table(spark, path, "p_partkey long, p_name string, p_size int, p_retailprice double").select("p_partkey", "p_name", "p_size")


@query("SELECT count(*) FILTER (event_id % 13 <> 0) AS n_good, count(*) FILTER (event_id % 13 = 0) AS n_bad, CAST(sum(CASE WHEN event_id % 13 <> 0 THEN user_id END) AS BIGINT) AS users FROM events")
def json_lines_damage(spark, d):
    """JSON lines of which some are cut off: good rows and the number of bad lines."""
    path = shared_path(spark, "events")
    e = load(spark, d, "events").select("event_id", "user_id")
    line = F.to_json(F.struct("event_id", "user_id"))
    e.select(F.when(F.col("event_id") % 13 == 0, F.substring(line, 1, 9)).otherwise(line).alias("value")).write.text(path)
    good, bad = readers.json_lines(spark, path, "event_id long, user_id long")
    return good.agg(F.count(F.lit(1)).alias("n_good"), F.sum("user_id").alias("users")).crossJoin(bad).select("n_good", "n_bad", "users")  # one row each


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS name, c_nationkey AS nation FROM customer")
def keyed_json(spark, d):
    """An object of objects, a line of it per segment, opened to rows."""
    c = load(spark, d, "customer")
    entry = F.struct(F.col("c_custkey").cast("string").alias("k"), F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")).alias("v"))
    lines = c.groupBy("c_mktsegment", (F.col("c_custkey") % 64).alias("b")).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("j"))
    return readers.keyed_json(lines, "j", "struct<name:string,nation:int>").select("key", "value.name", "value.nation")


@query("SELECT CAST(conv_id % 3 AS VARCHAR) AS part, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1")
def shard_merge(spark, d):
    """Answer shards in directories of their own, merged by one scan; the shard number is read from the name."""
    path = shared_path(spark, "shards")
    c = load(spark, d, "conversations").withColumn("shard", F.col("conv_id") % 3)
    c.write.partitionBy("shard").json(path)
    got = readers.shards(spark, path, "*.json", "conv_id long, turn long, role string, text string")
    return got.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("SELECT item_id, 'v1_' || CAST(item_id AS VARCHAR) AS qid, CAST(item_id AS INT) AS image_id, text AS caption FROM benchmark")
def prefix_ids(spark, d):
    return load(spark, d, "benchmark").select("item_id", F.concat(F.lit("v1_"), F.col("item_id").cast("string")).alias("qid"), F.expr("try_cast(item_id AS int)").alias("image_id"), F.col("text").alias("caption"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_discount >= 0.05 AS INT) AS pred FROM lineitem")
def threshold_pred(spark, d):
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") >= 0.05).cast("int").alias("pred"))


@query("SELECT conv_id, turn, contains(CASE WHEN conv_id % 4 = 0 THEN '<image>' || text ELSE text END, '<image>') AS multimodal FROM conversations")
def multimodal_flag(spark, d):
    t = F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit("<image>"), "text")).otherwise(F.col("text"))
    return load(spark, d, "conversations").select("conv_id", "turn", F.contains(t, F.lit("<image>")).alias("multimodal"))


@query("SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_default_join(spark, d):
    return load(spark, d, "documents").select("doc_id", "source").join(load(spark, d, "labels"), "doc_id", "left").select("doc_id", "source", "quality", "toxic")


@query("SELECT o_orderkey AS sample, c_mktsegment AS segment, n_name AS nation, year(o_orderdate) AS year FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def sample_meta_join(spark, d):
    o = load(spark, d, "orders")
    x = o.join(load(spark, d, "customer"), o.o_custkey == F.col("c_custkey")).join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return x.select(F.col("o_orderkey").alias("sample"), F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"), F.year("o_orderdate").cast("long").alias("year"))


GENES = ("part 1", "PART 20", "Part 7", "absent")


@query("SELECT p_partkey, coalesce(upper(p_name) IN (SELECT upper(x) FROM (VALUES " + ", ".join(f"('{g}')" for g in GENES) + ") t(x)), false) AS listed FROM part")
def gene_list_flag(spark, d):
    """Case-insensitive membership in a curated list."""
    listed = spark.createDataFrame([(g,) for g in GENES], "g string").select(F.upper("g").alias("g")).distinct()
    p = load(spark, d, "part")
    return p.join(F.broadcast(listed), F.upper("p_name") == F.col("g"), "left").select("p_partkey", F.col("g").isNotNull().alias("listed"))


@query("WITH a AS (SELECT conv_id AS qid, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations WHERE conv_id % 3 <> 0) SELECT q.qid, coalesce(a.text, '') AS answer FROM (SELECT DISTINCT conv_id AS qid FROM conversations) q LEFT JOIN a ON a.qid = q.qid AND rn = 1")
def answers_default(spark, d):
    """Questions with their last answer, empty where there is none."""
    c = load(spark, d, "conversations")
    last = c.where("conv_id % 3 <> 0").groupBy(F.col("conv_id").alias("qid")).agg(F.max_by("text", "turn").alias("text"))
    return c.select(F.col("conv_id").alias("qid")).distinct().join(last, "qid", "left").select("qid", F.coalesce("text", F.lit("")).alias("answer"))


@query("WITH p AS (SELECT item_id, row_number() OVER (ORDER BY item_id) AS i FROM benchmark), q AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i FROM documents) SELECT CAST(p.i - 1 AS BIGINT) AS place, item_id, doc_id FROM p JOIN q USING (i)")
def positional_zip(spark, d):
    """Two tables side by side by explicit ordinals; what one has more is left out."""
    from tessera.operators.ordered import with_row_numbers

    a = with_row_numbers(load(spark, d, "benchmark").select("item_id"), ["item_id"]).select(F.col("row_number").alias("place"), "item_id")
    b = with_row_numbers(load(spark, d, "documents").select("doc_id"), ["doc_id"]).select(F.col("row_number").alias("place"), "doc_id")
    return a.join(b, "place").select("place", "item_id", "doc_id")


@query("WITH e AS (SELECT * FROM events WHERE event_type IN ('click', 'view', 'purchase')), r AS (SELECT e.event_id, b.i FROM e JOIN (VALUES (0, -1e9::DOUBLE, 10.0::DOUBLE), (1, 10.0::DOUBLE, 40.0::DOUBLE), (2, 40.0::DOUBLE, 1e9::DOUBLE)) b(i, lo, hi) ON value >= lo AND value < hi) SELECT CAST(i AS INT) AS bucket, count(*) AS n FROM r GROUP BY 1")
def range_buckets(spark, d):
    """A search in sorted edges: an expression over a literal array instead of a range join."""
    e = load(spark, d, "events").where(F.col("event_type").isin("click", "view", "purchase"))
    edges = F.array(F.lit(10.0), F.lit(40.0))
    return e.groupBy(F.size(F.filter(edges, lambda x: x <= F.col("value"))).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH a AS (SELECT doc_id FROM documents WHERE lang = 'en'), b AS (SELECT doc_id FROM labels) SELECT (SELECT count(*) FROM (SELECT doc_id FROM a UNION ALL SELECT doc_id FROM b)) AS n_union_all, (SELECT count(*) FROM (SELECT doc_id FROM a UNION SELECT doc_id FROM b)) AS n_union, (SELECT count(*) FROM (SELECT doc_id FROM a EXCEPT SELECT doc_id FROM b)) AS n_except, (SELECT count(*) FROM (SELECT doc_id FROM a INTERSECT SELECT doc_id FROM b)) AS n_intersect")
def set_ops(spark, d):
    """All four set operations of two id sets out of one grouped union."""
    a = load(spark, d, "documents").where("lang = 'en'").select("doc_id", F.lit(1).alias("a"), F.lit(0).alias("b"))
    b = load(spark, d, "labels").select("doc_id", F.lit(0).alias("a"), F.lit(1).alias("b"))
    g = a.unionByName(b).groupBy("doc_id").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    n = lambda c: F.count_if(F.expr(c))
    return g.agg(F.sum(F.col("a") + F.col("b")).alias("n_union_all"), F.count(F.lit(1)).alias("n_union"), n("a > 0 AND b = 0").alias("n_except"), n("a > 0 AND b > 0").alias("n_intersect"))


@query("WITH c AS (SELECT conv_id % 5 AS label, conv_id, max(text) AS t FROM conversations WHERE role = 'user' GROUP BY ALL) SELECT conv_id, CAST(label AS BIGINT) AS label, 'human' AS q_from, '<image>\n' || t AS q, 'gpt' AS a_from, 'class ' || CAST(label AS VARCHAR) AS a FROM c")
def record_build(spark, d):
    """Nested conversation records as they are exported, opened again for comparison."""
    c = load(spark, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.max("text").alias("t")).withColumn("label", F.col("conv_id") % 5)
    turn = lambda who, value: F.struct(F.lit(who).alias("from"), value.alias("value"))
    rec = c.withColumn("conversations", F.array(turn("human", F.concat(F.lit("<image>\n"), "t")), turn("gpt", F.concat(F.lit("class "), F.col("label").cast("string")))))
    back = rec.withColumn("j", F.from_json(F.to_json(F.struct("conv_id", "label", "conversations")), "conv_id long, label long, conversations array<struct<from:string,value:string>>"))
    turn_ = lambda i, f: F.get(F.col("j.conversations"), F.lit(i))[f]
    return back.select("j.conv_id", "j.label", turn_(0, "from").alias("q_from"), turn_(0, "value").alias("q"), turn_(1, "from").alias("a_from"), turn_(1, "value").alias("a"))


@query("SELECT doc_id, " + sql_first("text", DEMO_NETS, nets.UNLABELED) + " AS category FROM documents")
def stream_labels(spark, d):
    """Documents labelled as a stream over their directory, all that has landed."""
    out, mark = shared_path(spark, "labels"), shared_path(spark, "mark")
    src = shared_path(spark, "landing")
    load(spark, d, "documents").write.parquet(src)
    s = ingest.landing(spark, src, spark.read.parquet(src).schema)
    ingest.run_available(ingest.label_stream(s, "text", DEMO_NETS).select("doc_id", "category"), out, mark)
    return spark.read.parquet(out)


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    """Event-time windows per day and type: the events as a stream, its watermark so wide that old files count, too."""
    out = shared_path(spark, "windows")
    # As a pattern the path may be a folder or a single file.
    stream = ingest.landing(spark, f"{d}/events.parque[t]", load(spark, d, "events").schema)
    kind = stream.schema["ts"].dataType.simpleString()
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    ingest.run_totals(ingest.windowed_counts(stream, "ts", "event_type", "value", "1 day", "36500 days"), f"{out}/totals", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/totals").withColumn("total", F.round("total", 4)).withColumn("start", F.col("start").cast(kind))


@query("SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark, d):
    li = load(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY revenue DESC LIMIT 10")
def join_revenue(spark, d):
    li, o, c, n = (load(spark, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    x = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return x.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("revenue")).limit(10)


@query("SELECT conv_id AS id, CAST(turn AS INT) AS line, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1")
def last_wins(spark, d):
    """Of repeated keys the last line counts."""
    c = load(spark, d, "conversations")
    return c.groupBy(F.col("conv_id").alias("id")).agg(F.max("turn").cast("int").alias("line"), F.max_by("text", "turn").alias("text"))


@query("SELECT CAST(i - 1 AS INT) AS dim, count(*) AS n, round(sum(CAST(embedding[i] AS DOUBLE)), 6) AS total FROM embeddings, range(1, 65) r(i) GROUP BY 1")
def npy_scan(spark, d):
    """All vectors written as array files and read again: rows and sum by dimension."""
    out = shared_path(spark, "arrays")
    writers.npy(load(spark, d, "embeddings"), "embedding", out)
    x = readers.npy(spark, out).select(F.posexplode("vector").alias("dim", "v"))
    return x.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 6).alias("total"))


@query("SELECT user_id, event_id, CAST(rn AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn <= 2")
def result_sort(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return load(spark, d, "events").withColumn("place", F.row_number().over(w)).where("place <= 2").select("user_id", "event_id", "place")


@query("SELECT vec_id, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i:04d}" for i in range(64)) + " FROM embeddings")
def wide_columns(spark, d):
    """A vector laid out in columns, and those columns chosen by the pattern of their names."""
    wide = load(spark, d, "embeddings").select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i:04d}") for i in range(64)])
    return wide.select("vec_id", wide.colRegex("`^e[0-9]+$`"))


@query("SELECT '| ' || lang || ' | ' || CAST(count(*) AS VARCHAR) || ' | ' || printf('%.2f', round(avg(n_chars), 2)) || ' |' AS line FROM documents GROUP BY lang")
def markdown_rows(spark, d):
    """The rows of a Markdown table, formatted on the executors."""
    g = load(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 2).alias("m"))
    return g.select(F.format_string("| %s | %d | %.2f |", "lang", "n", "m").alias("line"))


@query("SELECT '{' || string_agg('\"' || source || '\":\"' || CAST(n AS VARCHAR) || '\"', ',' ORDER BY source) || '}' AS json FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)")
def object_export(spark, d):
    """One JSON object of all keys."""
    g = load(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).cast("string").alias("n"))
    return writers.as_object(g, "source", "n")


@query("SELECT '{\"item_id\":' || CAST(item_id AS VARCHAR) || ',\"n\":' || CAST(length(text) AS VARCHAR) || '}' AS json FROM benchmark")
def json_export(spark, d):
    b = load(spark, d, "benchmark").select("item_id", F.length("text").alias("n"))
    return writers.as_json(b)


@query()
def toy_corpus(spark, d):
    """A synthetic count corpus with a sample per document, labelled and summed: samples by net and mean library size."""
    from tessera.sources import toy

    ids = load(spark, d, "documents").select("doc_id")
    s = toy.samples(spark, ids)
    size = toy.counts(spark, 60, ids).groupBy("sample_index").agg(F.sum("count").alias("library_size"))
    label = nets.first_match(nets.haystack(F.col("title"), F.col("source_name_ch1"), F.col("characteristics_ch1")), nets.DISEASE_NETS)
    return s.join(size, "sample_index", "left").groupBy(label.alias("category")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("library_size", F.lit(0))).alias("mean_size"))


@query("SELECT item_id, text FROM benchmark")
def json_array_scan(spark, d):
    """A table written as one JSON array over several files and read again in parts."""
    out = shared_path(spark, "json_array")
    b = load(spark, d, "benchmark").select("item_id", "text")
    writers.json_array(b, out, ["item_id"])
    return readers.json_array(spark, out, b.schema)


@query("SELECT conv_id AS id, turn - min(turn) OVER (PARTITION BY conv_id) AS place, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END AS \"from\", text AS value FROM conversations")
def nested_array_scan(spark, d):
    """Instruction samples, a record with its list of turns each, as a JSON array; read again and opened."""
    out = shared_path(spark, "samples")
    c = load(spark, d, "conversations")
    who = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    turn = F.struct("turn", who.alias("from"), F.col("text").alias("value"))
    samples = c.groupBy(F.col("conv_id").alias("id")).agg(F.array_sort(F.collect_list(turn)).alias("conversations"))
    writers.json_array(samples, out, ["id"])
    back = readers.json_array(spark, out, samples.schema)
    first = F.col("conversations")[0]["turn"]
    return back.select("id", first.alias("first"), F.explode("conversations").alias("x")).select("id", (F.col("x.turn") - F.col("first")).alias("place"), "x.from", "x.value")


def event_stream(spark, d):
    """The events as a stream, with the type their times have in the table; as a pattern the path may be a folder or a file."""
    stream = ingest.landing(spark, f"{d}/events.parque[t]", load(spark, d, "events").schema)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")), stream.schema["ts"].dataType.simpleString()


@query("SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS start FROM events) GROUP BY ALL")
def sliding_windows(spark, d):
    """Two-day windows that start each day, by type, of the events as a stream."""
    out = shared_path(spark, "windows")
    stream, kind = event_stream(spark, d)
    ingest.run_totals(ingest.windowed_counts(stream, "ts", "event_type", "value", "2 days", "7 days", "1 day"), f"{out}/totals", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/totals").withColumn("total", F.round("total", 4)).withColumn("start", F.col("start").cast(kind))


@query(
    """
WITH g AS (SELECT user_id, ts, value, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))
, s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k
"""
)
def event_sessions(spark, d):
    """Sessions of users, ended by six hours without an event, of the events as a stream."""
    out = shared_path(spark, "sessions")
    stream, kind = event_stream(spark, d)
    ingest.run_totals(ingest.session_counts(stream, "ts", "user_id", "value", "6 hours", "7 days"), f"{out}/totals", f"{out}/checkpoint")
    got = spark.read.parquet(f"{out}/totals")
    return got.select("user_id", F.col("start").cast(kind).alias("start"), F.col("end").cast(kind).alias("end"), "n", F.round("total", 4).alias("total"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def distinct_arrivals(spark, d):
    """Events of which some land twice, as a stream without the repeats, counted by type."""
    out = shared_path(spark, "arrivals")
    e = load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e.unionByName(e.where("event_id % 3 = 0")).write.parquet(f"{out}/landing")
    stream = ingest.landing(spark, f"{out}/landing", e.schema)
    ingest.run_available(ingest.first_arrivals(stream, "ts", ["event_id"], "36500 days"), f"{out}/events", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT event_id, event_type, round((value - avg(value) OVER w) / CASE WHEN stddev_pop(value) OVER w > 0 THEN stddev_pop(value) OVER w ELSE 1 END, 6) AS z FROM events WINDOW w AS (PARTITION BY event_type)")
def two_pass_zscore(spark, d):
    """Statistics by type from a stream over all files, then all rows mapped with them."""
    out = shared_path(spark, "two_pass")
    stream, _ = event_stream(spark, d)
    ingest.land_sums(stream, "event_type", "value", f"{out}/sums", f"{out}/checkpoint")
    got = ingest.standardized(load(spark, d, "events"), "event_type", "value", f"{out}/sums")
    return got.select("event_id", "event_type", F.round("z", 6).alias("z"))


@query("SELECT conv_id || ':' || turn AS question_id, CASE WHEN contains(lower(text), 'the') THEN 'yes' ELSE 'no' END AS text, CAST(length(text) AS BIGINT) AS n FROM conversations WHERE role = 'user'")
def resumed_predictions(spark, d):
    """Every question answered once by a stand-in model, in two runs of which the first ends after three chunks."""
    out = shared_path(spark, "answers")
    q = load(spark, d, "conversations").where("role = 'user'").select(F.concat_ws(":", "conv_id", "turn").alias("question_id"), "text")

    def model(pdf):
        return pdf.assign(n=pdf.text.str.len(), text=pdf.text.str.lower().str.contains("the", regex=False).map({True: "yes", False: "no"}))[["question_id", "text", "n"]]

    schema = "question_id string, text string, n long"
    for most in (3, None):
        steps.answer_pending(q, "question_id", model, 64, schema, out, most=most)
    return spark.read.schema(schema).json(out)


@query("SELECT CAST(i - 11 AS INT) AS dim, count(*) AS n, round(sum(CAST(embedding[i] AS DOUBLE)), 6) AS total FROM embeddings, range(11, 21) r(i) GROUP BY 1")
def npy_columns(spark, d):
    """Ten columns of all vectors, read from array files without the others."""
    out = shared_path(spark, "arrays")
    writers.npy(load(spark, d, "embeddings"), "embedding", out)
    x = matrix_files.npy_slices(spark, out, columns="10:20").select(F.posexplode("vector").alias("dim", "v"))
    return x.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 6).alias("total"))

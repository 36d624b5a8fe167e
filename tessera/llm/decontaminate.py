"""Operator 8, benchmark decontamination by SimHash over item-sized windows. DataFrame functions only.

1. Windows: a window of an item's size that is similar to it shares shingles with it. For each document and item,
   running sums along the document give the weight of shared shingles in every window, and all windows whose shared
   weight allows the similarity go on; a window may lie anywhere, also stick out of its document at either end.
   The shingles of the benchmark are broadcast only while they are few; else both sides are shuffled.
2. Each such window gets a 64-bit SimHash, its shingles weighted by their length in characters.
3. Multi-index blocks: distinct fingerprints of windows meet the items of their size whose block is within ``NEAR`` bits of
   theirs. With ``BLOCKS`` blocks this guarantees every pair within ``RADIUS`` bits; the item side, small by nature, lists the
   neighbours of its blocks (548 rows an item). A larger radius would not choose: random pairs differ in 32 of 64 bits.
   Similar pairs beyond the radius exist, above all of short items, whose few shingles decide many bits at once. What
   step 1 named and the blocks did not find is therefore the exact way for the rest, and goes to step 4 too.
4. The weighted Jaccard similarity of the shingles, repeats counted, is computed exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

K, SIMILARITY = 5, 0.8
BLOCKS, NEAR = 4, 2
RADIUS = BLOCKS * (NEAR + 1) - 1
#: Benchmark shingles (some 40 bytes each) and documents with windows (8 bytes) up to which they are broadcast.
BROADCAST_SHINGLES, BROADCAST_IDS = 1_000_000, 2_000_000


def words(col) -> F.Column:
    """Lower-cased runs of letters and digits; none for null."""
    text = F.trim(F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))


def shingles(hashes, k: int) -> F.Column:
    """The hashes of all ``k`` consecutive words, in order; none for shorter texts."""
    at = F.sequence(F.lit(1), F.size(hashes) - (k - 1))
    return F.when(F.size(hashes) >= k, F.transform(at, lambda i: F.xxhash64(*[F.element_at(hashes, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))


def _lengths(n, k: int) -> F.Column:
    """The lengths in characters of all ``k`` consecutive words, joined by one space, from the words' lengths."""
    at = F.sequence(F.lit(1), F.size(n) - (k - 1))
    return F.when(F.size(n) >= k, F.transform(at, lambda i: sum((F.element_at(n, i + j) for j in range(1, k)), F.element_at(n, i)) + (k - 1))).otherwise(F.array().cast("array<bigint>"))


def texts(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """``doc_id, copy, text``; ``copy`` tells rows of one id apart by their text."""
    row = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return row.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("copy"), "text")


def with_shingles(df: DataFrame, k: int, text_col="text") -> DataFrame:
    """``df`` with ``h`` and ``len``: the hashes and lengths of the shingles of ``text_col`` in order."""
    # Each array is a column of its own: inside a lambda function it would be computed for every element.
    out = df.withColumn("_w", words(F.col(text_col)))
    out = out.withColumn("_h", F.transform("_w", lambda x: F.xxhash64(x))).withColumn("_n", F.transform("_w", lambda x: F.length(x).cast("long")))
    return out.withColumn("h", shingles(F.col("_h"), k)).withColumn("len", _lengths(F.col("_n"), k)).drop("_w", "_h", "_n")


def elements(df: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, e, w``: the shingles ``(h, len)`` of each group of rows, ``e`` tells repeats apart."""
    one = df.groupBy(*keys, "h").agg(F.max("len").alias("w"), F.count(F.lit(1)).alias("n"))
    return one.select(*keys, "w", "h", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("j")).select(*keys, F.xxhash64("h", "j").alias("e"), "w")


def fingerprints(parts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, fp, total``: for each of 64 bits the sign of the weighted sum of ±1 over the elements, and the weights' sum."""
    ones = [F.expr(f"sum(if(getbit(e, {b}) = 1, w, 0L)) AS b{b}") for b in range(64)]
    sums = parts.groupBy(*keys).agg(F.sum("w").alias("total"), *ones)
    fp = " | ".join(f"if(2 * b{b} > total, shiftleft(1L, {b}), 0L)" for b in range(64))
    return sums.select(*keys, F.expr(fp).alias("fp"), "total")


def _block_spans() -> list[tuple[int, int]]:
    ends = [round(64 * i / BLOCKS) for i in range(BLOCKS + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def _block(fp, start: int, size: int) -> F.Column:
    return F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << size) - 1))


def benchmark_items(benchmark: DataFrame, id_col="item_id", text_col="text") -> DataFrame:
    """``item_id, size, k, text``: items with at least one word; those under ``K`` words are one shingle. Repeated rows go."""
    got = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    got = got.withColumn("size", F.size(words(F.col("text")))).where(F.col("size") > 0)
    return got.withColumn("k", F.least("size", F.lit(K))).withColumn("item", F.xxhash64("item_id", "text")).distinct()


def item_shingles(items: DataFrame) -> DataFrame:
    """``item, item_id, size, k, h, len``: a row per shingle of each item."""
    sizes = [r[0] for r in items.select("k").distinct().collect()]  # at most K values
    out = None
    for k in sorted(sizes):
        got = with_shingles(items.where(F.col("k") == k), k).select("item", "item_id", "size", "k", F.explode(F.arrays_zip("h", "len")).alias("x")).select("item", "item_id", "size", "k", "x.*")
        out = got if out is None else out.unionByName(got)
    return out


def hits(docs: DataFrame, own: DataFrame) -> DataFrame:
    """``doc_id, copy, pos, item, size, k, len, total``: where the shingles of ``docs`` are shingles of items."""
    sizes = sorted(r[0] for r in own.select("k").distinct().collect())
    out = None
    for k in sizes:
        side = own.where(F.col("k") == k).select("h", "item", "size", "k", "len", "total")
        side = F.broadcast(side) if side.count() <= BROADCAST_SHINGLES else side
        hashed = docs.select("doc_id", "copy", F.transform(words(F.col("text")), lambda x: F.xxhash64(x)).alias("hw"))
        met = hashed.select("doc_id", "copy", F.posexplode(shingles(F.col("hw"), k)).alias("pos", "h")).join(side, "h").drop("h")
        out = met if out is None else out.unionByName(met)
    return out.distinct()  # rows that repeat an id and a text are one


def windows(met: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``doc_id, copy, start, item, size, k``: all windows of an item's size that may reach the similarity ``least`` with it.

    The shared weight ``m`` of a similarity m / (a + b - m) of ``least`` or more is at least ``least`` times the
    item's weight. A shingle at ``pos`` lies in the windows that start from ``pos - (size - k)`` to ``pos``, so
    the sum of the weights of hits is a running sum along the starts, and stays the same between two changes.
    """
    change = F.array(F.struct((F.col("pos") - (F.col("size") - F.col("k"))).alias("start"), F.col("len").alias("by")), F.struct((F.col("pos") + 1).alias("start"), (-F.col("len")).alias("by")))
    key = ["doc_id", "copy", "item", "size", "k", "total"]
    steps = met.select(*key, F.explode(change).alias("x")).groupBy(*key, "x.start").agg(F.sum("x.by").alias("by"))
    along = Window.partitionBy("doc_id", "copy", "item").orderBy("start")
    held = steps.withColumn("m", F.sum("by").over(along.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next", F.lead("start").over(along))
    held = held.where((F.col("m") > 0) & (F.col("m") >= F.col("total") * (least - 1e-9)))
    return held.select("doc_id", "copy", "item", "size", "k", F.explode(F.sequence("start", F.col("next") - 1)).alias("start"))


def window_elements(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``doc_id, copy, start, size, k, e, w`` of the windows; only documents that have windows are cut into words again."""
    ids = found.select(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy")).distinct()
    few = ids.count() <= BROADCAST_IDS
    picked = docs.join(F.broadcast(ids) if few else ids, (docs["doc_id"] == F.col("_id")) & (docs["copy"] == F.col("_copy")), "left_semi").dropDuplicates(["doc_id", "copy"])
    out = None
    for k in sorted(r[0] for r in found.select("k").distinct().collect()):
        cut = with_shingles(picked, k).select("doc_id", "copy", "h", "len")
        # Windows of a document are dealt by runs of its words, so that a long one is no hot group.
        at = found.where(F.col("k") == k).select("doc_id", "copy", "start", "size", "k").distinct()
        both = cut.join(at, ["doc_id", "copy"])
        first = F.greatest("start", F.lit(0))
        n = F.least(F.col("start") + F.col("size") - (k - 1), F.size("h")) - first
        part = F.arrays_zip(F.slice("h", first + 1, n).alias("h"), F.slice("len", first + 1, n).alias("len"))
        got = both.where(n > 0).select("doc_id", "copy", "start", "size", "k", F.explode(part).alias("x")).select("doc_id", "copy", "start", "size", "k", F.col("x.h").alias("h"), F.col("x.len").alias("len"))
        out = got if out is None else out.unionByName(got)
    return elements(out, ["doc_id", "copy", "start", "size", "k"])


def block_join(fps: DataFrame, items: DataFrame) -> DataFrame:
    """``size, fp, item, hamming``: all pairs of ``fps(size, fp)`` and ``items(item, size, fp)`` of one size within RADIUS bits, by multi-index blocks."""
    own, other = [], []
    for i, (start, size) in enumerate(_block_spans()):
        masks = F.array(*[F.lit(m) for m in range(1 << size) if m.bit_count() <= NEAR])
        near = F.transform(masks, lambda m: F.struct(F.lit(i).alias("b"), _block(F.col("fp"), start, size).bitwiseXOR(m).alias("v")))  # noqa: B023
        own.append(near)
        other.append(F.struct(F.lit(i).alias("b"), _block(F.col("fp"), start, size).alias("v")))
    left = items.select("item", "size", F.col("fp").alias("item_fp"), F.explode(F.concat(*own)).alias("x")).select("item", "size", "item_fp", "x.*")
    right = fps.select("size", "fp", F.explode(F.array(*other)).alias("x")).select("size", "fp", "x.*")
    # The listed neighbours are many times the items that Spark's estimate sees: never broadcast them.
    pairs = right.join(left.hint("merge"), ["size", "b", "v"])
    pairs = pairs.withColumn("hamming", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))).where(F.col("hamming") <= RADIUS)
    return pairs.select("size", "fp", "item", "hamming").distinct()


def candidates(wins: DataFrame, marks: DataFrame) -> DataFrame:
    """``doc_id, copy, start, size, total, item, hamming, by_blocks``: the pairs of windows and items to verify.

    ``wins(doc_id, copy, start, size, k, item, fp, total)`` has a row for each item that a window may be similar to by its
    shared weight. The blocks find pairs by fingerprints alone; the named pairs that they leave are added.
    """
    key = ["doc_id", "copy", "start", "size"]
    near = block_join(wins.select("size", "fp").distinct(), marks)
    # Written, as the rest is what these leave: the search is planned and run once.
    found = common.written(wins.select(*key, "k", "fp", "total").distinct().join(near, ["size", "fp"]).select(*key, "k", "total", "item", "hamming", F.lit(True).alias("by_blocks")), "found_by_blocks")
    left = wins.join(found.select(*key, "item"), [*key, "item"], "left_anti").join(marks.select("item", F.col("fp").alias("item_fp")), "item")
    left = left.select(*key, "k", "total", "item", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))).alias("hamming"), F.lit(False).alias("by_blocks"))
    return found.unionByName(left)


NO_LEAKS = "doc_id long, item_id long, start int, n_words int, hamming int, similarity double"


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``doc_id, item_id, start, n_words, hamming, similarity``: for each document and item the best window at ``least`` or more.

    Ties go to the earliest window. Null texts and items without words match nothing; null document ids
    are left out; rows that repeat an id count as one document with all their windows. Repeated items are
    reported under each of their ids. Items of one word match every place of that word. Very long texts are
    searched whole. Other columns play no part, whatever their names. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    items = common.written(benchmark_items(benchmark), "items")
    if items.isEmpty():
        return spark.createDataFrame([], NO_LEAKS)
    own = common.written(item_shingles(items), "item_shingles")
    parts = common.written(elements(own, ["item"]), "item_elements")
    marks = common.written(fingerprints(parts, ["item"]).join(items.select("item", "size").distinct(), "item"), "item_fingerprints")
    rows = texts(docs)
    distinct = common.written(own.groupBy("item", "size", "k", "h").agg(F.max("len").alias("len")).join(marks.select("item", "total"), "item"), "item_weights")
    met = common.written(hits(rows, distinct), "hits")
    found = common.written(windows(met, least), "windows")
    common.discard(met)
    if found.isEmpty():
        return spark.createDataFrame([], NO_LEAKS)
    key = ["doc_id", "copy", "start", "size", "k"]
    held = common.written(window_elements(rows, found), "window_elements")
    wins = common.written(found.join(fingerprints(held, key), key), "window_fingerprints")
    # Each step is a query of its own: one plan for all of them, with twenty jobs at a time, took the driver's memory.
    pairs = common.written(candidates(wins, marks), "candidates").join(marks.select("item", F.col("total").alias("item_total")), "item")
    shared = pairs.join(held, key).join(parts.select("item", "e"), ["item", "e"])
    full = shared.groupBy("doc_id", "copy", "start", "item", "size", "hamming", "total", "item_total").agg(F.sum("w").alias("m"))
    full = full.withColumn("similarity", F.col("m") / (F.col("total") + F.col("item_total") - F.col("m"))).where(F.col("similarity") >= least)
    named = full.join(items.select("item", "item_id"), "item")
    best = named.groupBy("doc_id", "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "start", "size", "hamming")).alias("m"))
    return best.select("doc_id", "item_id", F.col("m.start").cast("int").alias("start"), F.col("m.size").cast("int").alias("n_words"), F.col("m.hamming").cast("int").alias("hamming"), (-F.col("m.s")).alias("similarity"))


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    """The documents that contain benchmark items, over all of ``documents`` and ``benchmark``."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("hamming")


OP8_SQL = """
WITH d AS (
  SELECT doc_id, list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda w: w <> '') AS w FROM documents WHERE doc_id IS NOT NULL
), t AS (
  SELECT item_id, list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda w: w <> '') AS w FROM benchmark
), u AS (
  SELECT item_id, w, len(w) AS size, least(len(w), 5) AS k FROM t WHERE len(w) > 0
), ug AS (
  SELECT item_id, size, k, i, array_to_string(w[i:i+k-1], ' ') AS g FROM (SELECT *, unnest(range(1, size - k + 2)) AS i FROM u)
), dg AS (
  SELECT doc_id, k, i, array_to_string(w[i:i+k-1], ' ') AS g FROM (SELECT d.doc_id, d.w, s.k, unnest(range(1, greatest(len(d.w) - s.k + 2, 1))) AS i FROM d, (SELECT DISTINCT k FROM u) s)
), a AS (
  SELECT DISTINCT doc_id, k, size, CAST(unnest(range(i - (size - k) - 1, i)) AS BIGINT) AS start FROM (SELECT DISTINCT doc_id, ug.k, size, dg.i FROM dg JOIN ug ON dg.g = ug.g AND dg.k = ug.k)
), x AS (
  SELECT DISTINCT a.doc_id, a.k, a.size, a.start, d.w[greatest(start, 0)+1 : least(start + size, len(d.w))] AS w FROM a JOIN d USING (doc_id)
), xg AS (
  SELECT doc_id, k, size, start, array_to_string(w[i:i+k-1], ' ') AS g, count(*) AS n FROM (SELECT *, unnest(range(1, greatest(len(w) - k + 2, 1))) AS i FROM x) GROUP BY ALL
), un AS (
  SELECT item_id, size, k, g, count(*) AS n FROM ug GROUP BY ALL
), sh AS (
  SELECT doc_id, start, xg.size, xg.k, item_id, sum(least(xg.n, un.n) * length(g)) AS m FROM xg JOIN un USING (size, k, g) GROUP BY ALL
), xw AS (SELECT doc_id, start, size, k, sum(n * length(g)) AS t FROM xg GROUP BY ALL), uw AS (SELECT item_id, sum(n * length(g)) AS t FROM un GROUP BY ALL)
, s AS (
  SELECT doc_id, item_id, start, size, CAST(m AS DOUBLE) / (xw.t + uw.t - m) AS similarity FROM sh JOIN xw USING (doc_id, start, size, k) JOIN uw USING (item_id)
), b AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start, size) AS rn FROM s WHERE similarity >= 0.8
)
SELECT doc_id, item_id, CAST(start AS INTEGER) AS start, CAST(size AS INTEGER) AS n_words, similarity FROM b WHERE rn = 1
"""

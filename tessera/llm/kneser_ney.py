"""Operator 4, quality by an interpolated modified Kneser-Ney model of trusted text.

The model is of order five over characters as they are (code points), so neither its alphabet nor its
size is bounded: what it gathers grows with the corpus. Nothing of it comes to the driver or is broadcast.

1. Documents are packed into blocks. A block lists its distinct n-grams, each with its count in the block's
   trusted training documents, and sends them to shards, which the first characters of an n-gram choose.
2. Shards add up the counts. Continuation counts, context totals, discounts and back-off weights follow
   level by level as aggregates, windows over a context and equi-joins with the next lower order, so that
   each distinct n-gram of the corpus gets its probability once.
3. Shards join the probabilities to the lists of the blocks; each block gets its n-grams back with their
   logarithms and sums them by document.

A document is rejected if its perplexity lies above its language's threshold: a quantile over that
language's trusted documents that were held out of the training.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

ORDER = 5
#: Pads a text at both ends; in a text itself it counts as U+FFFD.
EDGE = "\0"
#: Bytes of text from which a block is full (larger blocks list fewer n-grams per character), and characters that are sorted at a time.
BLOCK_CHARS, CHUNK = 32_000_000, 1 << 18
#: Listed n-grams from which a block's lists are merged.
MERGE = 1_500_000
#: An alphabet smaller than this lets an n-gram fit 64 bits; a block beyond it is halved, and a single text beyond it
#: has its n-grams as strings of bytes.
ALPHABET = 7131
#: Labelled trusted ids up to which they are broadcast (8 bytes each); beyond, a shuffle join.
BROADCAST_IDS = 1_000_000
#: The quantile of held-out trusted log-perplexity; one trusted document in so many is held out; a language with
#: fewer held-out documents than this has the quantile over all languages; log-perplexities are ranked in steps of 1 / BINS.
QUANTILE, HOLD_OUT, LEAST_HELD, BINS = 0.99, 5, 50, 1000


def pieces(text: str | None):
    """A padded text, cut where it is long; each piece of n characters holds n - 4 n-grams, none is in two."""
    p = EDGE * (ORDER - 1) + (text or "").replace(EDGE, "�") + EDGE
    for a in range(0, len(p) - ORDER + 1, CHUNK):
        yield p[a : a + CHUNK + ORDER - 1]


def chunks(texts):
    """``(owners, code points, ends)``: pieces put together to about CHUNK characters; the text of each and where it ends."""
    owners, parts, held = [], [], 0
    for i, t in enumerate(texts):
        for p in pieces(t):
            owners.append(i)
            parts.append(p)
            held += len(p)
            if held >= CHUNK:
                yield owners, np.frombuffer("".join(parts).encode("utf-32-le"), "<u4"), np.cumsum([len(x) for x in parts])
                owners, parts, held = [], [], 0
    if parts:
        yield owners, np.frombuffer("".join(parts).encode("utf-32-le"), "<u4"), np.cumsum([len(x) for x in parts])


def alphabet(texts) -> np.ndarray:
    """The sorted code points of texts and EDGE."""
    seen = np.zeros(0x110000, bool)
    for _, x, _ in chunks(texts):
        seen[x] = True
    seen[0] = True
    return np.nonzero(seen)[0].astype(np.uint32)


def ranks(letters: np.ndarray) -> np.ndarray:
    out = np.zeros(0x110000, np.uint64)
    out[letters] = np.arange(len(letters), dtype=np.uint64)
    return out


def codes(x: np.ndarray, rank: np.ndarray, r: int) -> np.ndarray:
    """The n-grams that start at each of ``x``: numbers to base ``r``, or where these don't fit 64 bits the bytes of their ranks.

    Both sort alike; byte strings are of one length, so zeros at their ends, which numpy does not show, tell none apart.
    """
    d = rank[x]
    n = len(d) - ORDER + 1
    if r >= ALPHABET:
        if n <= 0:
            return np.empty(0, f"S{4 * ORDER}")
        return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(d.astype(">u4"), ORDER)).view(f"S{4 * ORDER}").ravel()
    out = d[:n].copy()
    for k in range(1, ORDER):
        out *= np.uint64(r)
        out += d[k : n + k]
    return out


def points_of(u: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """The code points of n-grams as ``codes`` gives them, a row each."""
    if u.dtype.kind == "S":
        return letters[np.frombuffer(u.tobytes(), ">u4").reshape(-1, ORDER).astype(np.int64)].astype("<u4")
    points = np.empty((len(u), ORDER), "<u4")
    for k in range(ORDER - 1, -1, -1):
        u, digit = np.divmod(u, np.uint64(len(letters)))
        points[:, k] = letters[digit.astype(np.int64)]
    return points


def _inside(ends: np.ndarray) -> np.ndarray:
    """Which windows of a chunk lie in one piece."""
    ok = np.ones(int(ends[-1]) - ORDER + 1, bool)
    at = (ends[:-1, None] - np.arange(1, ORDER)).ravel()
    ok[at] = False
    return ok


def strings(column):
    """The texts of an Arrow column one by one."""
    for x in column:
        yield x.as_py()


def merged(found: list, times: list) -> tuple[np.ndarray, np.ndarray]:
    u, where = np.unique(np.concatenate(found), return_inverse=True)
    return u, np.bincount(where, np.concatenate(times)).astype(np.int32)


def block_grams(column, trained: list) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a block as rows of ORDER code points, in order, and their counts in its trained texts."""
    letters = alphabet(strings(column))
    rank, r = ranks(letters), len(letters)
    found, times, held = [], [], 0
    for counted in (True, False):
        for _, x, ends in chunks(t for t, y in zip(strings(column), trained) if y == counted):
            u, n = np.unique(codes(x, rank, r)[_inside(ends)], return_counts=True)
            found.append(u)
            times.append(n.astype(np.int32) if counted else np.zeros(len(u), np.int32))
            held += len(u)
            if held > MERGE:
                u, n = merged(found, times)
                found, times, held = [u], [n], 0
    u, counts = merged(found, times)
    return points_of(u, letters), counts


def shard_of(points: np.ndarray, shards: int) -> np.ndarray:
    """The shard of n-grams: a hash of their first three characters."""
    z = np.zeros(len(points), np.uint64)
    for k in range(3):
        z = (z ^ points[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        z ^= z >> np.uint64(29)
    return (z % np.uint64(shards)).astype(np.int64)


def as_text(points: np.ndarray) -> str:
    return points.astype("<u4").tobytes().decode("utf-32-le")


PACKED = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("grams", pa.string()), ("counts", pa.binary()), ("body", pa.binary())])


def pack_block(table: pa.Table, shards: int):
    """The rows of one block, or of its halves where its alphabet is too large."""
    import uuid

    column = table.column("text")
    if len(column) > 1 and len(alphabet(strings(column))) >= ALPHABET:
        half = len(column) // 2
        yield from pack_block(table.slice(0, half), shards)
        yield from pack_block(table.slice(half), shards)
        return
    block = uuid.uuid4().int >> 65
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip([block, -1, None, None, sink.getvalue().to_pybytes()], PACKED)], schema=PACKED)
    del sink
    points, counts = block_grams(column, [x == 1 for x in table.column("role").to_pylist()])
    to = shard_of(points, shards)
    order = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(shards + 1))
    rows = []
    for s in np.nonzero(np.diff(cuts))[0].tolist():
        at = order[cuts[s] : cuts[s + 1]]
        rows.append((block, s, as_text(points[at]), counts[at].astype("<i4").tobytes(), None))
    yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), PACKED)], schema=PACKED)


def pack(docs: DataFrame, shards: int, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Blocks of ``docs(doc_id, lang, text, role)``: for each block a row with ``shard`` -1 and its documents in ``body``,
    and a row for each shard with the n-grams it sends there, one after the other, and their counts.

    ``role`` is 1 for training, 2 for trusted but held out, else 0.
    """

    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.column(2).nbytes
            if n >= block_chars:
                table, held, n = pa.Table.from_batches(held), [], 0
                yield from pack_block(table, shards)
                table = None
                common.release_memory()
        if sum(len(b) for b in held):
            yield from pack_block(pa.Table.from_batches(held), shards)
        held = []
        common.release_memory()

    return docs.select("doc_id", "lang", "text", "role").mapInArrow(run, "block long, shard int, grams string, counts binary, body binary")


def tally(messages: DataFrame, shards: int) -> DataFrame:
    """``shard, gram, c``: the n-grams of all blocks with their counts in training text, one shard at a time."""

    def run(batches):
        shard, total = None, {}

        def rows():
            names = list(total)
            for i in range(0, len(names), 50_000):
                part = names[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(part), pa.int32()), pa.array(part), pa.array([total[g] for g in part], pa.int64())], ["shard", "gram", "c"])

        for b in batches:
            for s, grams, counts in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                if s != shard:
                    yield from rows()
                    shard, total = s, {}
                grams = grams.as_py()
                for g, c in zip((grams[i : i + ORDER] for i in range(0, len(grams), ORDER)), np.frombuffer(counts.as_py(), "<i4").tolist()):
                    total[g] = total.get(g, 0) + c
        yield from rows()
        common.release_memory()

    dealt = messages.select("shard", "grams", "counts").repartition(shards, "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, "shard int, gram string, c long")


def discounts(n: list[int]) -> list[float]:
    """D1, D2, D3+ from the numbers of n-grams seen once to four times; safe for sparse counts."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    out = []
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.5
        out.append(min(max(d, 0.1), k - 0.05))
    return out


def shares(counts: DataFrame, n: int) -> DataFrame:
    """``counts(gram, c)`` of order ``n`` with the discounted share of an n-gram in its context and the weight left to the lower order.

    An n-gram that training text lacks has count 0: no share, and all the weight if its context is unseen, too.
    """
    seen = counts.agg(*[F.count_if(F.col("c") == k) for k in (1, 2, 3, 4)]).first()
    d1, d2, d3 = discounts(list(seen))
    d = F.when(F.col("c") == 0, 0.0).when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
    # A context is followed by at most as many n-grams as there are characters.
    by = Window.partitionBy("ctx")
    out = counts.withColumn("ctx", F.substring("gram", 1, n - 1)).withColumn("d", d)
    out = out.withColumn("total", F.sum("c").over(by)).withColumn("held", F.sum("d").over(by)).drop("ctx")
    share = F.when(F.col("total") > 0, (F.col("c") - F.col("d")) / F.col("total")).otherwise(0.0)
    back = F.when(F.col("total") > 0, F.col("held") / F.col("total")).otherwise(1.0)
    return out.withColumn("share", share).withColumn("back", back).drop("d", "total", "held")


def probabilities(counts: DataFrame) -> DataFrame:
    """``shard, gram, nll``, written, from ``shard, gram, c``: interpolated from the lowest order, by joins on suffixes.

    Below the single characters all seen ones and one more, for those unseen, are equally likely.
    """
    levels = {ORDER: counts}
    for n in range(ORDER - 1, 0, -1):  # lower orders count the distinct predecessors of an n-gram
        low = levels[n + 1].groupBy(F.substring("gram", 2, n).alias("gram")).agg(F.count_if(F.col("c") > 0).alias("c"))
        levels[n] = common.written(low, f"types{n}")
    v = levels[1].where("c > 0").count() + 1
    p = shares(levels[1], 1).select("gram", (F.col("share") + F.col("back") / v).alias("p"))
    lower = []
    for n in range(2, ORDER + 1):
        low = p.select(F.col("gram").alias("suffix"), F.col("p").alias("low"))
        here = shares(levels[n], n).withColumn("suffix", F.substring("gram", 2, n - 1)).join(low, "suffix")
        p = here.select(*(["shard"] if n == ORDER else []), "gram", (F.col("share") + F.col("back") * F.col("low")).alias("p"))
        if n < ORDER:  # written, so that the driver never plans and runs all orders at once
            lower.append(p := common.written(p, f"p{n}"))
    model = common.written(p.select("shard", "gram", (-F.log("p")).cast("float").alias("nll")), "model")
    for table in [*lower, *(levels[n] for n in range(1, ORDER))]:
        common.discard(table)
    return model


def replies(messages: DataFrame, model: DataFrame, shards: int) -> DataFrame:
    """``block, grams, nll``: each shard's part of the model joined to what the blocks asked of it."""

    def answer(key, left: pa.Table, right: pa.Table) -> pa.Table:
        held = dict(zip(right.column("gram").to_pylist(), right.column("nll").to_pylist()))
        out = []
        for g in left.column("grams"):
            g = g.as_py()
            out.append(np.array([held[g[i : i + ORDER]] for i in range(0, len(g), ORDER)], "<f4").tobytes())
        return pa.table({"block": left.column("block"), "grams": left.column("grams"), "nll": pa.array(out, pa.binary())})

    got = messages.select("block", "shard", "grams").groupBy("shard").cogroup(model.groupBy("shard"))
    return got.applyInArrow(answer, "block long, grams string, nll binary")


def text_scores(column, grams: str, nll: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text of a block its number of n-grams and the sum of their negative log-probabilities."""
    letters = alphabet(strings(column))
    rank, r = ranks(letters), len(letters)
    own = codes(np.frombuffer(grams.encode("utf-32-le"), "<u4"), rank, r)[::ORDER]
    order = np.argsort(own)
    own, nll = own[order], nll[order].astype(np.float64)
    n, total = np.zeros(len(column), np.int64), np.zeros(len(column))
    for owners, x, ends in chunks(strings(column)):
        ok = _inside(ends)
        c = codes(x, rank, r)
        c[~ok] = own[0]
        u, where = np.unique(c, return_inverse=True)
        upto = np.append(0.0, np.cumsum(np.where(ok, nll[np.searchsorted(own, u)][where], 0.0)))
        first = np.append(0, ends[:-1])
        last = ends - ORDER + 1
        np.add.at(n, owners, last - first)
        np.add.at(total, owners, upto[last] - upto[first])
    return n, total


def score(blocks: DataFrame, answers: str) -> DataFrame:
    """``doc_id, lang, role, n_grams, nll``: the mean negative log-probability of each document's n-grams.

    A block reads its own part of ``answers``, a folder of ``replies`` by block.
    """

    def run(batches):
        fs, root = common.open_fs(answers)
        for b in batches:
            for block, body in zip(b.column(0).to_pylist(), b.column(1)):
                table = pa.ipc.open_stream(body.as_buffer()).read_all()
                got = pa.parquet.ParquetDataset(f"{root}/block={block}", filesystem=fs, partitioning=None).read(["grams", "nll"])
                grams = "".join(got.column("grams").to_pylist())
                values = np.frombuffer(b"".join(got.column("nll").to_pylist()), "<f4")
                n, total = text_scores(table.column("text"), grams, values)
                for x in pa.table({"doc_id": table.column("doc_id"), "lang": table.column("lang"), "role": table.column("role"), "n_grams": pa.array(n), "nll": pa.array(total / n)}).to_batches(max_chunksize=50_000):
                    yield x
        common.release_memory()

    return blocks.where("shard < 0").select("block", "body").mapInArrow(run, "doc_id long, lang string, role int, n_grams long, nll double")


def document_scores(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, lang, role, n_grams, nll`` per row of ``docs(doc_id, lang, text, role)``, by a model of the rows of role 1."""
    spark = docs.sparkSession
    shards = common.partitions_for(spark)
    blocks = common.written(pack(docs, shards, block_chars), "blocks")
    messages = blocks.where("shard >= 0")
    counts = common.written(tally(messages, shards), "grams")
    model = probabilities(counts)
    answers = common.new_path(spark, "replies")
    with common.small_batches(spark):
        replies(messages, model, shards).repartition(shards, "block").write.partitionBy("block").option("compression", "zstd").parquet(answers)
    out = common.written(score(blocks, answers), "scores")
    for table in (blocks, counts, model):
        common.discard(table)
    common.delete(spark, answers)
    return out


def thresholds(held_out: DataFrame, quantile: float = QUANTILE, least: int = LEAST_HELD) -> DataFrame:
    """``lang, threshold`` (of nll): the quantile over a language's held-out documents, by exact counts in bins of 1 / BINS.

    The quantile is rounded up to a bin's end: a document less than 1 / BINS of log-perplexity above it is kept, too.
    A row with a null language holds the quantile over all; languages of fewer than ``least`` documents have no row.
    """
    bins = held_out.select("lang", F.ceil(F.col("nll") * BINS).alias("bin"))
    per = bins.where("lang is not null").unionByName(bins.withColumn("lang", F.lit(None).cast("string"))).groupBy("lang", "bin").count()
    w = Window.partitionBy("lang")
    ranked = per.withColumn("upto", F.sum("count").over(w.orderBy("bin"))).withColumn("n", F.sum("count").over(w))
    ranked = ranked.where(F.col("upto") >= F.ceil(F.col("n") * quantile)).where((F.col("n") >= least) | F.col("lang").isNull())
    return ranked.groupBy("lang").agg((F.min("bin") / BINS).alias("threshold"))


def judge(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, least: int = LEAST_HELD, block_chars: int = BLOCK_CHARS, key=None) -> DataFrame:
    """``doc_id, lang, n_grams, nll, perplexity, threshold, keep``, a row per row of ``docs``.

    If ``key`` is given, a column of ``docs`` that is long, it takes the place of ``doc_id`` in the result.

    Trusted are the documents that ``labels`` calls of quality 1 (null ids and labels: not trusted; repeated
    labels count once). One in HOLD_OUT of them, chosen by a hash of the text so that copies stay together,
    is not trained on; the thresholds are quantiles over those. Null or rare languages have the threshold
    over all; without held-out documents everything is kept. A text equal to its threshold is kept. A null
    text scores like an empty one: the end of text alone. Very long texts are scored whole, in pieces.
    Rows of a repeated id are judged each for itself. Other columns play no part, whatever their names;
    an empty table gives an empty result.
    """
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("_good")).distinct()
    few = good.count() <= BROADCAST_IDS
    pick = F.broadcast(good) if few else good
    row = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("doc_id").cast("long") if key is None else key).alias("key"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    held = F.pmod(F.xxhash64("text"), F.lit(HOLD_OUT)) == 0
    role = F.when(F.col("_good").isNull(), 0).when(held, 2).otherwise(1).cast("int")
    scores = document_scores(row.join(pick, row["doc_id"] == pick["_good"], "left").withColumn("role", role).withColumn("doc_id", F.col("key")), block_chars)
    limits = common.written(thresholds(scores.where("role = 2"), quantile, least), "thresholds")
    overall = limits.where("lang is null").select(F.col("threshold").alias("overall"))
    out = scores.join(limits.where("lang is not null"), "lang", "left").join(F.broadcast(overall), F.lit(True), "left")  # one row
    limit = F.coalesce("threshold", "overall")
    return out.select("doc_id", "lang", "n_grams", "nll", F.exp("nll").alias("perplexity"), limit.alias("threshold"), F.coalesce(F.col("nll") <= limit, F.lit(True)).alias("keep"))


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """All of ``documents`` judged by a model of their trusted part."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))

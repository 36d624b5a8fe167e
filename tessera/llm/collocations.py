"""Operator 12, collocations: n-grams prefiltered by merged count-min sketches, counted exactly, scored, subsumed.

Documents are packed into blocks of coded words; codes are per language, so all counts are too. Three sketches
follow each other, of words, of word pairs whose words are left, and of triples and quadruples whose pairs are left:

1. Each block sends, per sketch row and shard, the cells of its distinct n-grams (sorted, as compressed gaps) and
   their counts, which stop at ``least``. Merging a shard adds these partial sketches up; sums are never too small.
   Its answer to a block is one bit per cell sent: ``least`` or more? No sketch comes to one place.
2. What any row estimates below ``least`` goes; an n-gram of ``least`` occurrences is kept by every row of its own
   sketch and of those of its parts, so none is lost.
3. A last pass over the blocks counts the survivors by their words (no hashes), blocks' counts are added up, and those
   below ``least`` go. The parts of a frequent phrase are frequent, so the same table has the counts of all its parts.

Scores and subsumption are joins of that table with itself.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .substring_dedup import _bits, _gaps, _mix, _packed, _parts, _ungaps, cells_of

#: Occurrences of a phrase, words of the longest, percent of a phrase's occurrences that subsume it, phrases reported.
LEAST, LONGEST, COVERED, TOP = 30, 4, 80, 2000
UNKNOWN = "und"
#: Text bytes of a block; more make fewer and larger messages.
BLOCK_BYTES = 8 << 20
#: Sketch rows; a row has a cell per n-gram occurrence, at least. Cells of a shard: between these powers of two.
ROWS, SHARD_BITS = 2, (20, 28)
#: Folds A-Z and tabs, and makes one byte of all that ends a piece.
_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + _ENDS, b"abcdefghijklmnopqrstuvwxyz " + b"\n" * len(_ENDS))
_BLOCK = "n long, langs array<struct<lang string, entries long, words long>>, dictionary binary, codes binary, alive binary"
_ARROW = pa.schema([("n", pa.int64()), ("langs", pa.list_(pa.struct([("lang", pa.string()), ("entries", pa.int64()), ("words", pa.int64())]))), ("dictionary", pa.binary()), ("codes", pa.binary()), ("alive", pa.binary())])


def _zip(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data)


def _unzip(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def _row(langs: list[dict], words: list[bytes], codes: np.ndarray, n: int, alive: np.ndarray | None = None) -> dict:
    mask = None if alive is None else _zip(np.packbits(alive).tobytes())
    return {"n": n, "langs": langs, "dictionary": _zip(b"\n".join(words)), "codes": _zip(codes.astype("<u4").tobytes()), "alive": mask}


def _cut(text: bytes, size: int):
    """A folded text in parts of about ``size`` bytes, cut between pieces only."""
    while len(text) > size:
        at = text.rfind(b"\n", 0, size)
        at = text.find(b"\n", size) if at < 0 else at
        if at < 0:
            break
        yield text[:at]
        text = text[at + 1 :]
    yield text


def code_block(texts: dict[str, list[bytes]]) -> dict:
    """A block of folded texts by language: distinct words, and the texts as their numbers from 1, 0 between pieces."""
    langs, words, codes = [], [], []
    for lang, parts in texts.items():
        body = b"\n".join(parts).replace(b"\n", b" \n ")
        flat = pa.compute.split_pattern(pa.array([body], pa.large_binary()), " ").values.dictionary_encode()
        own = flat.dictionary.to_pylist()
        number, n = np.empty(len(own), np.int64), 0
        for i, w in enumerate(own):
            if w and w != b"\n":
                n += 1
                number[i] = len(words) + n
            else:
                number[i] = 0 if w else -1
        words += [w for w in own if w and w != b"\n"]
        at = number[flat.indices.to_numpy()]
        at = at[at >= 0]
        codes += [at, np.zeros(1, np.int64)]
        langs.append({"lang": lang, "entries": n, "words": int((at > 0).sum())})
    flat = np.concatenate(codes) if codes else np.empty(0, np.int64)
    return _row(langs, words, flat, int((flat > 0).sum()))


def pack_blocks(docs: DataFrame, text_col="text", lang_col="lang", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The written table of coded blocks. A very long text is cut between its pieces, over several blocks if need be."""

    def run(batches):
        held, size = {}, 0
        for b in batches:
            langs = b.column(0).to_pylist()
            for lang, x in zip(langs, b.column(1)):
                for part in _cut((x.as_py() or b"").translate(_FOLD), block_bytes):
                    held.setdefault(lang, []).append(part)
                    size += len(part) + 1
                    if size >= block_bytes:
                        yield pa.RecordBatch.from_pylist([code_block(held)], schema=_ARROW)
                        held, size = {}, 0
        if held:
            yield pa.RecordBatch.from_pylist([code_block(held)], schema=_ARROW)

    got = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).cast("string").cast("binary").alias("text"))
    with common.small_batches(docs.sparkSession):
        rows = got.mapInArrow(run, _BLOCK)
    return common.written(rows.withColumn("block", F.monotonically_increasing_id()), "phrase_blocks", "none")


class Block:
    """A block's words, their hashes by language, and the places that n-grams may still start at."""

    def __init__(self, row: dict):
        from xxhash import xxh3_64_intdigest

        self.row, self.langs = row, row["langs"]
        self.codes = np.frombuffer(_unzip(row["codes"]), "<u4").astype(np.int64)
        data = _unzip(row["dictionary"])
        self.words = data.split(b"\n") if data else []
        self.size = len(self.words) + 1
        hashes, at = [0], 0
        for x in self.langs:
            seed = xxh3_64_intdigest(x["lang"].encode())
            hashes += [xxh3_64_intdigest(w, seed) for w in self.words[at : at + x["entries"]]]
            at += x["entries"]
        self.hashes = np.array(hashes, np.uint64)
        self.alive = None if row["alive"] is None else np.unpackbits(np.frombuffer(_unzip(row["alive"]), np.uint8), count=len(self.codes)).astype(bool)

    def starts(self, n: int) -> np.ndarray:
        """Where an n-gram starts that may be frequent: of words for pairs, of pairs that are left for longer ones."""
        if n == 1:
            return np.nonzero(self.codes > 0)[0]
        ok = (self.codes[:-1] > 0) & (self.codes[1:] > 0) if self.alive is None or n == 2 else self.alive[:-1]
        for j in range(1, n - 1):
            ok = ok[:-1] & self.alive[j : j + len(ok) - 1]
        return np.nonzero(ok)[0] if len(self.codes) >= n else np.empty(0, np.int64)

    def distinct(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(places, each place's n-gram by number, the first place and the count of each n-gram), told apart by their words."""
        at = self.starts(n)
        key = self.codes[at]
        for j in range(1, n):
            # Numbers of shorter n-grams and codes fit 31 bits each, as a block has fewer words.
            key = (np.unique(key, return_inverse=True)[1] if j > 1 else key) * self.size + self.codes[at + j]
        _, first, number, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        return at, number, at[first], count

    def hash(self, first: np.ndarray, n: int) -> np.ndarray:
        total = np.full(len(first), n, np.uint64)
        for j in range(n):
            total = _mix(total ^ self.hashes[self.codes[first + j]], j & 1) * np.uint64(0x9E3779B97F4A7C15)
        return _mix(total, 0)


def fold_cells(hashes: np.ndarray, counts: np.ndarray, row: int, bits: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct cells, their counts up to ``least``, each hash's cell by number)."""
    cells, number = np.unique(cells_of(hashes, row, bits), return_inverse=True)
    sums = np.bincount(number, np.minimum(counts, least), len(cells)) if len(cells) else np.empty(0)
    return cells, np.minimum(sums, least).astype(np.int64), number


class Sketch:
    """One merged sketch over blocks: the cells sent, the shards' sums, and what a block learns of them."""

    def __init__(self, blocks: DataFrame, sizes: tuple[int, ...], least: int):
        total, n_blocks = blocks.agg(F.sum("n"), F.count(F.lit(1))).first()
        total = max(total or 0, 1)
        self.sizes, self.least = sizes, least
        self.bits = max(16, math.ceil(math.log2(total * len(sizes))))
        # A message should hold some hundred cells, as far as a shard's memory allows.
        self.shard_bits = min(self.bits, max(SHARD_BITS[0], min(SHARD_BITS[1], self.bits - int(math.log2(max(1.0, total / max(n_blocks, 1) / 8192))))))
        self.kind = "<u1" if least < 1 << 8 else "<u4"

    def grams(self, block: Block) -> tuple[list, np.ndarray, np.ndarray]:
        """(``distinct`` of each size, all hashes, all counts)."""
        got = [block.distinct(n) for n in self.sizes]
        return got, np.concatenate([block.hash(g[2], n) for g, n in zip(got, self.sizes)]), np.concatenate([g[3] for g in got])

    def answers(self, blocks: DataFrame) -> DataFrame:
        """``block, row, shard, data``: one bit per cell that a block sent."""
        sent = pa.schema([("row", pa.int32()), ("shard", pa.int64()), ("block", pa.int64()), ("cells", pa.binary()), ("counts", pa.binary())])
        least, kind, shard_bits = self.least, self.kind, self.shard_bits

        def send(batches):
            for b in batches:
                for row in b.to_pylist():
                    _, hashes, counts = self.grams(Block(row))
                    out = []
                    for r in range(ROWS):
                        cells, sums, _ = fold_cells(hashes, counts, r, self.bits, least)
                        for s, i, j in _parts(cells, shard_bits):
                            out.append({"row": r, "shard": s, "block": row["block"], "cells": _gaps(cells[i:j] - np.uint64(s << shard_bits)), "counts": _zip(sums[i:j].astype(kind).tobytes())})
                    if out:
                        yield pa.RecordBatch.from_pylist(out, schema=sent)

        def merge(key, t):
            """Adds up the partial sketches of a shard; sums stop at ``least``, more isn't asked for."""
            sums = np.zeros(1 << shard_bits, kind)
            sent = list(zip(t["cells"].to_pylist(), t["counts"].to_pylist()))
            for data, counts in sent:
                at = _ungaps(data)
                sums[at] = np.minimum(sums[at].astype(np.int64) + np.frombuffer(_unzip(counts), kind), least)
            back = [_packed(sums[_ungaps(data)] >= least) for data, _ in sent]
            return pa.table({"block": t["block"], "row": t["row"], "shard": t["shard"], "data": pa.array(back, pa.binary())})

        messages = blocks.mapInArrow(send, "row int, shard long, block long, cells binary, counts binary")
        got = messages.groupBy("row", "shard").applyInArrow(merge, "block long, row int, shard long, data binary")
        return common.written(got, "phrase_answers")

    def survivors(self, block: Block, answers: list[dict]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """``distinct`` of each size, and which of the n-grams every row estimates at ``least`` or more."""
        got, hashes, counts = self.grams(block)
        fine = np.ones(len(hashes), bool)
        for r in range(ROWS):
            cells, _, number = fold_cells(hashes, counts, r, self.bits, self.least)
            fine &= _bits([(a["shard"], a["data"]) for a in answers if a["row"] == r], len(cells))[number]
        out, at = [], 0
        for g in got:
            out.append((*g, fine[at : at + len(g[2])]))
            at += len(g[2])
        return out

    def narrowed(self, blocks: DataFrame) -> DataFrame:
        """The blocks after this sketch, a written table: rare words become breaks, rare pairs lose their mark."""
        answers = self.answers(blocks)

        def run(key, own, got):
            out = []
            for row in own.to_pylist():
                block = Block(row)
                ((at, number, _, _, fine),) = self.survivors(block, got.to_pylist())
                out.append((_without_words(block, number, fine) if self.sizes == (1,) else _with_pairs(block, at[fine[number]])) | {"block": row["block"]})
            return pa.Table.from_pylist(out, schema=_ARROW.append(pa.field("block", pa.int64())))

        out = common.written(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, _BLOCK + ", block long"), "phrase_blocks", "none")
        common.discard(answers)
        common.discard(blocks)
        return out


def _without_words(block: Block, number: np.ndarray, fine: np.ndarray) -> dict:
    """Only frequent words stay; runs of others become one break."""
    known = np.zeros(block.size, bool)
    known[np.unique(block.codes[block.codes > 0])] = fine  # numbers of words follow their codes
    renumbered = np.where(known, np.cumsum(known), 0)
    codes = renumbered[block.codes]
    codes = codes[(codes > 0) | np.r_[False, codes[:-1] > 0]]
    langs, at = [], 0
    for x in block.langs:
        langs.append(x | {"entries": int(known[1 + at : 1 + at + x["entries"]].sum())})
        at += x["entries"]
    words = [w for w, k in zip(block.words, known[1:].tolist()) if k]
    return _row(langs, words, codes, int(((codes[:-1] > 0) & (codes[1:] > 0)).sum()) if len(codes) else 0)


def _with_pairs(block: Block, at: np.ndarray) -> dict:
    alive = np.zeros(len(block.codes), bool)
    alive[at] = True
    row = {k: block.row[k] for k in ("langs", "dictionary", "codes")}
    return row | {"n": int((alive[:-1] & alive[1:]).sum()), "alive": _zip(np.packbits(alive).tobytes())}


def counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, text_col="text", lang_col="lang", block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(``lang, phrase, words, a``: all words and phrases of up to ``longest`` words that occur ``least`` times; ``lang, n``: all words).

    ``a`` is exact, overlaps included. Both are written tables.
    """
    if longest < 2 or least < 1:
        raise ValueError("phrases have two words or more and occur at least once")
    blocks = pack_blocks(docs, text_col, lang_col, block_bytes)
    sizes = common.written(blocks.select(F.explode("langs").alias("x")).groupBy("x.lang").agg(F.sum("x.words").alias("n")), "phrase_langs")
    blocks = Sketch(blocks, (1,), least).narrowed(blocks)
    blocks = Sketch(blocks, (2,), least).narrowed(blocks)
    last = Sketch(blocks, tuple(range(3, longest + 1)), least) if longest > 2 else None
    answers = last.answers(blocks) if last else None
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("a", pa.int64())])

    def exact(own: list[dict], got: list[dict]):
        for row in own:
            block = Block(row)
            # A pair that is marked is told from others by its own mark, as all its places have it.
            one, two = block.distinct(1), block.distinct(2)
            found = [(1, one[2], one[3])] + [(2, two[2][m], two[3][m]) for m in (block.alive[two[2]],)]
            if last:
                found += [(n, g[2][g[4]], g[3][g[4]]) for n, g in zip(last.sizes, last.survivors(block, got))]
            ends, names = np.cumsum([x["entries"] for x in block.langs]), [x["lang"] for x in block.langs]
            for n, first, count in found:
                codes = [block.codes[first + j].tolist() for j in range(n)]
                lang = np.searchsorted(ends, block.codes[first] - 1, side="right").tolist()
                phrases = [b" ".join([block.words[c - 1] for c in cs]).decode("utf-8", "replace") for cs in zip(*codes)]
                yield pa.table([pa.array([names[i] for i in lang], pa.string()), pa.array(phrases, pa.string()), pa.array([n] * len(phrases), pa.int32()), pa.array(count, pa.int64())], schema=schema)

    def with_answers(key, own, got):
        return pa.concat_tables([schema.empty_table(), *exact(own.to_pylist(), got.to_pylist())])

    def alone(batches):
        for b in batches:
            for t in exact(b.to_pylist(), []):
                yield from t.to_batches()

    kinds = "lang string, phrase string, words int, a long"
    parts = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(with_answers, kinds) if last else blocks.mapInArrow(alone, kinds)
    out = common.written(parts.groupBy("lang", "phrase", "words").agg(F.sum("a").alias("a")).where(F.col("a") >= least), "phrase_counts")
    common.discard(blocks)
    if last:
        common.discard(answers)
    return out, sizes


def _wide(name: str) -> str:
    return f"CAST({name} AS DECIMAL(19,0))"


def score(found: DataFrame, covered: int = COVERED) -> DataFrame:
    """``lang, phrase, words, a, l, r, score, subsumed`` of the phrases of two words or more in ``counts``' table.

    ``score`` is the floor of 2000000 a / (l + r) at the cut that makes it lowest, ties to the earliest cut; ``l`` and ``r`` are
    that cut's parts. ``subsumed``: a longer phrase contains it and has ``covered`` percent of its occurrences or more.
    """
    phrases = found.where("words > 1").withColumn("w", F.split("phrase", " "))
    cuts = phrases.select("lang", "phrase", "words", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "words", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("x"), F.expr("array_join(slice(w, k + 1, words - k), ' ')").alias("y"))
    part = found.select("lang", "phrase", "a")
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("x"), F.col("a").alias("l")), ["lang", "x"])
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("y"), F.col("a").alias("r")), ["lang", "y"])
    cuts = cuts.withColumn("score", F.expr(f"(CAST(2000000 AS DECIMAL(7,0)) * {_wide('a')}) div ({_wide('l')} + {_wide('r')})"))
    lowest = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m")).select("lang", "phrase", "words", "a", "m.l", "m.r", "m.score")
    inner = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(w, i, m), ' '))))")
    longer = phrases.where("words > 2").select("lang", "a", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    both = lowest.join(longer, ["lang", "phrase"], "left")
    covers = F.expr(f"coalesce(CAST(100 AS DECIMAL(3,0)) * {_wide('longer')} >= CAST({covered} AS DECIMAL(3,0)) * {_wide('a')}, false)")
    return both.withColumn("subsumed", covers).drop("longer")


def first_per_lang(scored: DataFrame, sizes: DataFrame, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases that are not subsumed.

    Ties in score and count go by the phrases' UTF-8 bytes. A language is cut to ``top`` in 64 parts before it is ranked as one.
    """
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    kept = scored.where("NOT subsumed").withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return kept.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, covered: int = COVERED, top: int = TOP, text_col="text", lang_col="lang", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best collocations of each language.

    A null text counts as empty, a null language as ``und``; empty texts have no phrases; a language without frequent
    phrases has no rows. Repeated rows count each. Texts are taken whole, whatever their length. Other columns play no
    part, whatever their names; an empty table gives an empty result.
    """
    found, sizes = counts(docs, least, longest, text_col, lang_col, block_bytes)
    return first_per_lang(score(found, covered), sizes, top)


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    """The contract's query over all of ``documents``."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), p AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces
), n AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang
), g AS (
  SELECT lang, k, array_to_string(w[i:i+k-1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)
), f AS (
  SELECT lang, k AS words, phrase, count(*) AS a, string_split(phrase, ' ') AS w FROM g GROUP BY ALL HAVING count(*) >= 30
), cut AS (
  SELECT lang, phrase, words, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k+1:words], ' ') AS y
  FROM (SELECT *, unnest(range(1, words)) AS k FROM f WHERE words > 1)
), s AS (
  SELECT c.lang, c.phrase, c.words, c.a, c.k, x.a AS l, y.a AS r, CAST((CAST(2000000 AS HUGEINT) * c.a) // (CAST(x.a AS HUGEINT) + y.a) AS BIGINT) AS score
  FROM cut c JOIN f x ON c.lang = x.lang AND c.x = x.phrase JOIN f y ON c.lang = y.lang AND c.y = y.phrase
), best AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_ AS (
  SELECT lang, array_to_string(w[i:i+m-1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, w, a, m, unnest(range(1, words - m + 2)) AS i FROM (SELECT *, unnest(range(2, words)) AS m FROM f WHERE words > 2)) GROUP BY ALL
), kept AS (
  SELECT b.* FROM best b LEFT JOIN inner_ i ON b.lang = i.lang AND b.phrase = i.phrase WHERE NOT coalesce(CAST(100 AS HUGEINT) * i.longer >= CAST(80 AS HUGEINT) * b.a, false)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""

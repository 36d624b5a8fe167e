"""Operator 6, removal of repeated word windows with a count-min prefilter.

Documents are packed into blocks, rows of a written table. Three passes read it:

1. Each block sends, per sketch row and shard, the cells its windows fall into (sorted, as compressed
   gaps; a cell says whether two documents of the block are in it). Merging a shard's partial sketches
   gives counts that never are too small. Its answer to a block is one bit per cell sent: two or more?
   So neither the sketch nor any list of all windows ever comes to one place, and no one broadcasts it.
2. The windows that all rows estimate repeated go, with a 96-bit fingerprint and the block's smallest
   document, to an exact grouping by fingerprint. It answers one bit per window: is it in a smaller
   document of another block?
3. With these bits a block knows the words to remove: a window's occurrences outside the smallest
   document that has it.

A window in two documents of one or two blocks raises its cells to two in every row, so none is lost.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 13
#: Text bytes of a block. Larger blocks make fewer and larger messages: 128 MB suit a corpus of many TB.
BLOCK_BYTES = 6 << 20
#: Sketch rows, and cells per window and row (at least; the number of cells is a power of two).
ROWS, CELLS = 2, 4
#: The cells of a shard lie between these powers of two (a byte each while merging).
SHARD_BITS = (20, 28)
#: Windows of one exact group task, about.
GROUP = 1 << 21


def pack_blocks(docs: DataFrame, id_col="doc_id", text_col="text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The written table ``block, n_windows, ids, none, counts, words``: documents' words joined by single spaces.

    ``ids`` (int64), ``none`` (1: the id is null) and ``counts`` (int64, words per document) are packed; ``words`` is zstd.
    """

    def run(batches):
        import zstandard

        ids, counts, parts, size = [], [], [], 0

        def block():
            n = np.array(counts, np.int64)
            none = np.array([d is None for d in ids], np.uint8)
            windows = int(np.maximum(n - WINDOW + 1, 0)[none == 0].sum())
            body = zstandard.ZstdCompressor(level=3).compress(b" ".join(p for p in parts if p))
            row = [windows, np.array([d or 0 for d in ids], np.int64).tobytes(), none.tobytes(), n.tobytes(), body]
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["n_windows", "ids", "none", "counts", "words"])

        for b in batches:
            for d, x in zip(b.column(0).to_pylist(), b.column(1)):
                words = (x.as_py() or "").encode("utf-8", "surrogatepass").split()
                parts.append(b" ".join(words))
                ids.append(d)
                counts.append(len(words))
                size += len(parts[-1]) + 16
                if size >= block_bytes:
                    yield block()
                    ids, counts, parts, size = [], [], [], 0
        if ids:
            yield block()

    got = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = got.mapInArrow(run, "n_windows long, ids binary, none binary, counts binary, words binary")
    return common.written(rows.withColumn("block", F.monotonically_increasing_id()), "blocks", "none")


def _mix(x: np.ndarray, k: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64((0xBF58476D1CE4E5B9, 0x94D049BB133111EB)[k])
    return x ^ (x >> np.uint64(32))


def _factors(k: int) -> list[np.uint64]:
    rng = np.random.default_rng(13 + k)
    return [np.uint64(int(x) * 2 + 1) for x in rng.integers(1 << 62, size=WINDOW)]


class Block:
    """A block's words and windows. Windows of documents without an id take no part."""

    def __init__(self, row: dict):
        import zstandard
        from xxhash import xxh3_128_digest

        self.ids = np.frombuffer(row["ids"], np.int64)
        self.none = np.frombuffer(row["none"], np.uint8).astype(bool)
        self.counts = np.frombuffer(row["counts"], np.int64)
        self.text = zstandard.ZstdDecompressor().decompress(row["words"])
        self.first = np.cumsum(self.counts) - self.counts
        n = int(self.counts.sum())
        values = pa.array([self.text], pa.string()) if n else pa.array([], pa.string())
        flat = pa.compute.ascii_split_whitespace(values).values.dictionary_encode()
        assert len(flat) == n
        self.lengths = pa.compute.binary_length(flat.dictionary).to_numpy()[flat.indices.to_numpy()] if n else np.empty(0, np.int64)
        digests = b"".join([xxh3_128_digest(w) for w in flat.dictionary.cast(pa.binary()).to_pylist()])
        hashes = np.frombuffer(digests, np.uint64).reshape(-1, 2)
        at = flat.indices.to_numpy()
        per_doc = np.where(self.none, 0, np.maximum(self.counts - WINDOW + 1, 0))
        self.doc = np.repeat(np.arange(len(self.ids)), per_doc)
        self.start = np.repeat(self.first - (np.cumsum(per_doc) - per_doc), per_doc) + np.arange(int(per_doc.sum()))
        self.hashes, self.at = hashes, at
        h, total = hashes[at, 0] if n else np.empty(0, np.uint64), np.zeros(max(n - WINDOW + 1, 0), np.uint64)
        for j, c in enumerate(_factors(0)):
            total += h[j : j + len(total)] * c
        self.one = _mix(_mix(total, 0), 1)[self.start]

    def second(self, place: np.ndarray) -> np.ndarray:
        """Another 32 bits of some windows, from other word hashes."""
        total, start = np.zeros(len(place), np.uint64), self.start[place]
        for j, c in enumerate(_factors(1)):
            total += self.hashes[self.at[start + j], 1] * c
        return _mix(_mix(total, 1), 0) >> np.uint64(32)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct first hashes; whether two documents (by place) have one; each window's hash by number."""
        order = np.argsort(self.one, kind="stable")
        h, d = self.one[order], self.doc[order]
        new = np.r_[True, h[1:] != h[:-1]] if len(h) else np.empty(0, bool)
        other = np.r_[False, (h[1:] == h[:-1]) & (d[1:] != d[:-1])] if len(h) else new
        at = np.nonzero(new)[0]
        number = np.empty(len(h), np.int64)
        number[order] = np.cumsum(new) - 1
        return h[at], np.logical_or.reduceat(other, at) if len(at) else other, number


def cells_of(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The cells of sorted hashes in a sketch row; row 0 keeps their order."""
    return (hashes if row == 0 else _mix(hashes, 1)) >> np.uint64(64 - bits)


def merge_cells(hashes: np.ndarray, twice: np.ndarray, row: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct cells, whether a cell has two documents or two windows, each hash's cell by number)."""
    cells, order = cells_of(hashes, row, bits), None
    if row:
        order = np.argsort(cells, kind="stable")
        cells, twice = cells[order], twice[order]
    new = np.r_[True, cells[1:] != cells[:-1]] if len(cells) else np.empty(0, bool)
    at = np.nonzero(new)[0]
    size = np.diff(np.r_[at, len(cells)])
    number = np.cumsum(new) - 1
    if order is not None:
        back = np.empty_like(number)
        back[order] = number
        number = back
    return cells[at], (size > 1) | (np.logical_or.reduceat(twice, at) if len(at) else False), number


def _gaps(cells: np.ndarray) -> bytes:
    import zstandard

    gaps = np.diff(cells, prepend=np.uint64(0))
    kind = "<u2" if not len(gaps) or gaps.max() < 1 << 16 else "<u4"
    return kind[2].encode() + zstandard.ZstdCompressor(level=1).compress(gaps.astype(kind).tobytes())


def _ungaps(data: bytes) -> np.ndarray:
    import zstandard

    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), "<u" + chr(data[0])), dtype=np.int64)


def _parts(sorted_keys: np.ndarray, shift: int) -> list[tuple[int, int, int]]:
    """(shard, from, to) of sorted keys by their bits from ``shift`` up."""
    shard = (sorted_keys >> np.uint64(shift)).astype(np.int64)
    if not len(shard):
        return []
    at = np.r_[0, np.nonzero(shard[1:] != shard[:-1])[0] + 1, len(shard)]
    return list(zip(shard[at[:-1]].tolist(), at[:-1].tolist(), at[1:].tolist()))


def _bits(data: list[tuple[int, bytes]], n: int) -> np.ndarray:
    """Answers of all shards, in shard order, as booleans. ``data``: (shard, packed bits with their number before)."""
    out = [np.unpackbits(np.frombuffer(x, np.uint8, offset=4), count=int.from_bytes(x[:4], "little")) for _, x in sorted(data)]
    out = np.concatenate(out).astype(bool) if out else np.empty(0, bool)
    assert len(out) == n
    return out


def _packed(mask: np.ndarray) -> bytes:
    return len(mask).to_bytes(4, "little") + np.packbits(mask).tobytes()


def candidates(block: Block, answers: list[dict], bits: int) -> tuple[np.ndarray, ...]:
    """The windows that every sketch row estimates repeated.

    (places in the block's windows, their entry), then per entry, sorted by fingerprint: first hash, second
    hash, place of the smallest document.
    """
    h, twice, at = block.distinct()
    fine = np.ones(len(h), bool)
    for r in range(ROWS):
        cells, _, number = merge_cells(h, twice, r, bits)
        full = _bits([(a["shard"], a["data"]) for a in answers if a["row"] == r], len(cells))
        fine &= full[number]
    place = np.nonzero(fine[at])[0] if len(h) else np.empty(0, np.int64)
    one, two, doc = block.one[place], block.second(place), block.doc[place]
    order = np.lexsort((block.ids[doc], two, one))
    one, two, doc, place = one[order], two[order], doc[order], place[order]
    new = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])] if len(one) else np.empty(0, bool)
    first = np.nonzero(new)[0]
    return place, np.cumsum(new) - 1, one[first], two[first], doc[first]


def dedup(docs: DataFrame, id_col="doc_id", text_col="text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` per row, and ``kept`` words on demand by ``kept_texts``.

    A null text has no words; texts under WINDOW words lose none. A row without an id is kept whole and
    takes no windows from others. Rows of one id take nothing from each other, as neither id is smaller.
    A document is in one block, however long it is, and a task holds a block's words several times over. Other columns play no part, whatever
    their names; an empty table gives an empty result.
    """
    return _run(docs, id_col, text_col, block_bytes, False)


def kept_texts(docs: DataFrame, id_col="doc_id", text_col="text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """As ``dedup``, with the column ``kept``: the words that stay, joined by single spaces."""
    return _run(docs, id_col, text_col, block_bytes, True)


def _run(docs: DataFrame, id_col, text_col, block_bytes, with_text) -> DataFrame:
    blocks = pack_blocks(docs, id_col, text_col, block_bytes)
    total, n_blocks = blocks.agg(F.sum("n_windows"), F.count(F.lit(1))).first()
    total = max(total or 0, 1)
    bits = max(16, math.ceil(math.log2(total * CELLS)))
    # A message should hold some hundred cells, as far as a shard's memory allows.
    shard_bits = min(bits, max(SHARD_BITS[0], min(SHARD_BITS[1], bits - int(math.log2(max(1.0, total / max(n_blocks, 1) / 8192))))))
    exact_bits = max(0, math.ceil(math.log2(total / GROUP)))

    def send(batches):
        for b in batches:
            for row in b.to_pylist():
                h, twice, _ = Block(row).distinct()
                out = []
                for r in range(ROWS):
                    cells, full, _ = merge_cells(h, twice, r, bits)
                    for s, i, j in _parts(cells, shard_bits):
                        out.append({"row": r, "shard": s, "block": row["block"], "cells": _gaps(cells[i:j] - np.uint64(s << shard_bits)), "full": np.packbits(full[i:j]).tobytes()})
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("row", pa.int32()), ("shard", pa.int64()), ("block", pa.int64()), ("cells", pa.binary()), ("full", pa.binary())]))

    def merge(key, t):
        """Adds up the partial sketches of a shard; counts stop at 2, more isn't asked for."""
        counts = np.zeros(1 << shard_bits, np.uint8)
        sent = list(zip(t["cells"].to_pylist(), t["full"].to_pylist()))
        for data, full in sent:
            at = _ungaps(data)
            counts[at] = np.minimum(counts[at] + 1 + np.unpackbits(np.frombuffer(full, np.uint8), count=len(at)), 2)
        back = [_packed(counts[_ungaps(data)] > 1) for data, _ in sent]
        return pa.table({"block": t["block"], "row": t["row"], "shard": t["shard"], "data": pa.array(back, pa.binary())})

    messages = blocks.mapInArrow(send, "row int, shard long, block long, cells binary, full binary")
    answers = messages.groupBy("row", "shard").applyInArrow(merge, "block long, row int, shard long, data binary")
    answers = common.written(answers, "sketch_answers")

    item = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("one", pa.binary()), ("two", pa.binary()), ("doc", pa.binary())])

    def ask(key, own, got):
        import zstandard

        out = []
        for row in own.to_pylist():
            block = Block(row)
            _, _, one, two, doc = candidates(block, got.to_pylist(), bits)
            for s, i, j in _parts(one, 64 - exact_bits) if exact_bits else [(0, 0, len(one))] * bool(len(one)):
                ids = zstandard.ZstdCompressor(level=1).compress(block.ids[doc[i:j]].tobytes())
                out.append({"shard": s, "block": row["block"], "one": one[i:j].tobytes(), "two": two[i:j].astype("<u4").tobytes(), "doc": ids})
        return pa.Table.from_pylist(out, schema=item)

    def group(key, t):
        """The smallest document of each fingerprint; a block learns which of its entries have a smaller one elsewhere."""
        import zstandard

        plain = zstandard.ZstdDecompressor()
        one = np.frombuffer(b"".join(t["one"].to_pylist()), np.uint64)
        two = np.frombuffer(b"".join(t["two"].to_pylist()), np.uint32)
        ids = np.frombuffer(b"".join(plain.decompress(x) for x in t["doc"].to_pylist()), np.int64)
        order = np.lexsort((ids, two, one))
        a, b = one[order], two[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        least = ids[order][np.nonzero(new)[0]][np.cumsum(new) - 1]
        smaller = np.empty(len(ids), bool)
        smaller[order] = least < ids[order]
        ends = np.cumsum([len(x) // 8 for x in t["one"].to_pylist()]).tolist()
        back = [_packed(smaller[i:j]) for i, j in zip([0, *ends[:-1]], ends)]
        return pa.table({"block": t["block"], "row": pa.array([ROWS] * t.num_rows, pa.int32()), "shard": t["shard"], "data": pa.array(back, pa.binary())})

    asked = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(ask, "shard long, block long, one binary, two binary, doc binary")
    exact = asked.groupBy("shard").applyInArrow(group, "block long, row int, shard long, data binary")
    both = answers.unionByName(common.written(exact, "exact_answers"))

    def finish(key, own, got):
        cols = [[], [], [], [], []]
        answers_ = got.to_pylist()
        for row in own.to_pylist():
            block = Block(row)
            place, entry, one, _, doc = candidates(block, answers_, bits)
            smaller = _bits([(a["shard"], a["data"]) for a in answers_ if a["row"] == ROWS], len(one))
            gone = smaller[entry] | (block.ids[block.doc[place]] > block.ids[doc[entry]])
            edge = np.zeros(len(block.lengths) + 1, np.int64)
            np.add.at(edge, block.start[place[gone]], 1)
            np.add.at(edge, block.start[place[gone]] + WINDOW, -1)
            keep = np.cumsum(edge)[:-1] == 0
            ends = np.cumsum(block.lengths + 1)
            begins = ends - block.lengths - 1
            n_kept = np.cumsum(np.r_[0, keep])
            for i, (d, no, f, n) in enumerate(zip(block.ids.tolist(), block.none.tolist(), block.first.tolist(), block.counts.tolist())):
                k = keep[f : f + n]
                step = np.nonzero(np.diff(np.r_[False, k, False]))[0]
                runs = zip(begins[f + step[::2]].tolist(), (ends[f + step[1::2] - 1] - 1).tolist()) if n else ()
                kept = b" ".join([block.text[x:y] for x, y in runs])
                for col, v in zip(cols, (None if no else d, n, n - int(n_kept[f + n] - n_kept[f]), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None)):
                    col.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in list(zip(cols, kinds))[: 5 if with_text else 4]], names[: 5 if with_text else 4])

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    return blocks.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(finish, schema)


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's query over all of ``documents``."""
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = """
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
), p AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM d WHERE doc_id IS NOT NULL
), g AS (
  SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS g FROM p
), m AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM g
), c AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM m WHERE least < doc_id
), r AS (
  SELECT doc_id, list(j) AS gone FROM c GROUP BY 1
), k AS (
  SELECT d.doc_id, len(w) AS n, coalesce(len(gone), 0) AS x,
    CASE WHEN gone IS NULL THEN w ELSE list_select(w, list_filter(range(1, len(w) + 1), lambda q: NOT list_contains(gone, q))) END AS kept
  FROM d LEFT JOIN r USING (doc_id)
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(x AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""

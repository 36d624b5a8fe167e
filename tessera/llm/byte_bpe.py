"""Operator 11, byte-level BPE by rank files: encoding with a hierarchical-bitmap rank queue, and decoding.

A pre-token is a match of the pattern. Its bytes are a linked list; a queue has one bucket of list positions per
merge rank, and a bitmap of two levels over the ranks: a bit of the upper level says that a word of the lower one is
not zero. Finding the first set bit of both gives the lowest rank, whatever the length of the pre-token. A position whose pair has changed since is stale and skipped. The work is linear in a pre-token's
bytes but for the sorting of a bucket, so that pre-tokens of megabytes are no special case.

Merges of one rank go from left to right, the lowest rank first, as the reference definition of the merges says.
"""

from __future__ import annotations

import base64
import struct
import sys
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Pre-tokens in a Python worker's cache (some 230 bytes each), and their longest length; longer ones are encoded each time.
CACHE, CACHED_LENGTH = 800_000, 64
#: Characters from which on a text's pre-tokens are taken some thousands at a time.
LONG, PART = 1_000_000, 50_000


class Encoder:
    """Ids of pre-tokens and texts, and their bytes again. ``ranks``: bytes to rank; every single byte needs one."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = CACHE):
        import regex

        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the rank file lacks {len(missing)} of the 256 bytes")
        self.ranks, self.pattern, self.most = ranks, regex.compile(pattern), cache
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        # Two levels of bitmap words, each of about the square root of the ranks in bits; all zero between two calls.
        self.shift = -(-len(self.bytes).bit_length() // 2)
        self.words = [0] * ((len(self.bytes) >> self.shift) + 1)
        self.cache = _Cache(self)

    def pieces(self, token: bytes) -> list[int]:
        """The ids of one pre-token's bytes."""
        ranks = self.ranks
        whole = ranks.get(token)
        if whole is not None:
            return [whole]
        n, rank_of, words, shift = len(token), ranks.get, self.words, self.shift
        low = (1 << shift) - 1
        after = list(range(1, n + 2))  # where the part that starts at a position ends
        before = list(range(-1, n + 1))  # the start of the part on its left
        pair = [rank_of(token[i : i + 2]) for i in range(n - 1)]  # rank of a part with its right neighbour, or None
        pair.append(None)
        buckets: dict[int, list[int]] = {}
        top = 0  # the upper level: bit w says that words[w] isn't zero
        for i, rank in enumerate(pair):
            if rank is None:
                continue
            if rank in buckets:
                buckets[rank].append(i)
            else:
                buckets[rank] = [i]
                w = rank >> shift
                words[w] |= 1 << (rank & low)
                top |= 1 << w
        while top:
            w = (top & -top).bit_length() - 1
            word = words[w]
            rank = w << shift | (word & -word).bit_length() - 1
            words[w] = word = word & (word - 1)
            if not word:
                top &= top - 1
            todo = buckets.pop(rank)
            if len(todo) > 1:
                todo.sort()
            done = 0
            for i in todo:
                done += 1
                if pair[i] != rank:
                    continue  # stale: the part is gone or has another neighbour
                j = after[i]
                end = after[j]
                after[i] = end
                before[end] = i
                pair[j] = pair[i] = None
                lower = False
                if end < n:
                    new = rank_of(token[i : after[end]])
                    if new is not None:
                        pair[i] = new
                        lower = new < rank
                        if new in buckets:
                            buckets[new].append(i)
                        else:
                            buckets[new] = [i]
                            w = new >> shift
                            words[w] |= 1 << (new & low)
                            top |= 1 << w
                left = before[i]
                if left >= 0:
                    pair[left] = new = rank_of(token[left:end])
                    if new is not None:
                        lower = lower or new < rank
                        if new in buckets:
                            buckets[new].append(left)
                        else:
                            buckets[new] = [left]
                            w = new >> shift
                            words[w] |= 1 << (new & low)
                            top |= 1 << w
                if lower and done < len(todo):  # a lower rank has come up: it goes first
                    buckets[rank] = todo[done:]
                    words[rank >> shift] |= 1 << (rank & low)
                    top |= 1 << (rank >> shift)
                    break
        out, i = [], 0
        while i < n:
            j = after[i]
            out.append(ranks[token[i:j]])
            i = j
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if len(self.cache) > self.most:
            self.cache.clear()
        if len(text) <= LONG:
            return b"".join(map(self.cache.__getitem__, self.pattern.findall(text)))
        found, out = (m.group() for m in self.pattern.finditer(text)), []
        while part := b"".join(map(self.cache.__getitem__, islice(found, PART))):
            out.append(part)
            if len(self.cache) > self.most:
                self.cache.clear()
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The bytes of packed ids. Raises KeyError for an id that the rank file lacks."""
        known, n = self.bytes, len(self.bytes)
        numbers = memoryview(ids).cast("I") if _LITTLE else [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)]
        out = []
        for i in range(0, len(numbers), LONG):
            got = numbers[i : i + LONG].tolist() if _LITTLE else numbers[i : i + LONG]
            if got and (max(got) >= n):
                raise KeyError(f"id {max(got)} is not in the rank file")
            out.append(b"".join([known[x] for x in got]))
        return b"".join(out)


_LITTLE = sys.byteorder == "little"


class _Cache(dict):
    """Packed ids by pre-token; long ones are not kept."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, token: str) -> bytes:
        ids = self.encoder.pieces(token.encode("utf-8"))
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(token) <= CACHED_LENGTH:
            self[token] = packed
        return packed


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file's lines: a token's base64 and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, data.splitlines()))}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return parse_ranks(f.read())


def shared_encoder(spark, ranks: str | None, pattern: str | None, cache: int):
    """A function for tasks that gives the encoder of their Python worker.

    The rank file (a megabyte at most for 50,000 ranks) is broadcast as it is. A worker that serves several tasks gets the
    same broadcast object each time and keeps its encoder there, with the pre-tokens that it knows by then.
    """
    with open(ranks or default_ranks(), "rb") as f:
        shared = spark.sparkContext.broadcast({"file": f.read()})
    pattern = pattern or default_pattern()

    def get() -> Encoder:
        held = shared.value
        if "encoder" not in held:
            held["encoder"] = Encoder(parse_ranks(held["file"]), pattern, cache)
        return held["encoder"]

    return get


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encode(docs: DataFrame, ranks: str | None = None, pattern: str | None = None, id_col="doc_id", text_col="text", cache: int = CACHE) -> DataFrame:
    """``doc_id, n_tokens, ids`` per row: a text's ids, packed as little-endian unsigned 32-bit integers.

    ``ranks``: path of a rank file on the driver. A null or empty text has no ids. Texts are encoded whole,
    whatever their length; rows that repeat an id or a text, or have no id, are encoded each. Nothing is shuffled.
    Other columns play no part, whatever their names; an empty table gives an empty result.
    """

    get = shared_encoder(docs.sparkSession, ranks, pattern, cache)

    def run(batches):
        encoder = get()
        for b in batches:
            # One text at a time is a Python string: a batch of long ones is not held twice.
            ids = [encoder.encode(x.as_py() or "") for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])
        b = ids = None
        common.release_memory()

    with common.small_batches(docs.sparkSession):
        return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks: str | None = None, ids_col="ids") -> DataFrame:
    """``encoded`` with ``decoded``: the bytes of each row's packed ids (null for null). An unknown id is an error."""
    get = shared_encoder(encoded.sparkSession, ranks, None, 0)

    def run(batches):
        encoder = get()
        for b in batches:
            got = [None if not x.is_valid else encoder.decode(x.as_py()) for x in b.column(columns.index(ids_col))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.binary())], [*columns, "decoded"])

    schema = encoded.drop("decoded").schema.add("decoded", "binary")
    columns = schema.names[:-1]
    return encoded.select(*columns).mapInArrow(run, schema)


def op11_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """The contract's query over all of ``documents``: ids, decoded again, as digests."""
    both = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

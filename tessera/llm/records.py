"""Operator 2, token ids as length-delimited binary records with an offset index.

A record file holds frames in ascending document order: an unsigned 64-bit payload length, the masked
CRC-32C of these eight bytes, the payload and the masked CRC-32C of the payload, all little-endian (the
framing that TFRecord readers know). A payload is: flags (bit 0: the document id is null), id width in
bytes (2 or 4), two zero bytes, document id (signed 64), then the ids. The index beside it (``.idx``)
has, per frame, document id, offset, payload length and number of ids as signed 64-bit integers, so
that a reader may shuffle and seek.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: CRC-32C (Castagnoli), reflected; mask constant of the framing.
POLY, MASK = 0x82F63B78, 0xA282EAD8
CHUNK = 512
HEADER = "<BBxxq"
END_ID = 1
#: Characters tokenized at a time, words kept in a Python worker's cache.
SLICE_CHARS, CACHE_WORDS = 4_000_000, 900_000
#: Text bytes per file: a task knows a word once, so fewer and larger files cost less.
FILE_BYTES = 64 << 20
#: Words whose letters and closing stops the tokenizer keeps apart; composed letters only.
PLAIN, STOPS = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]*$", ".,"

_tables: dict[str, np.ndarray] = {}


def _crc_tables() -> dict[str, np.ndarray]:
    """``at``: the CRC register of byte b with k zero bytes after it, flat over (k from CHUNK - 1 down, b); ``skip``: CHUNK zero bytes."""
    if not _tables:
        t = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            t = np.where(t & 1, (t >> 1) ^ np.uint32(POLY), t >> 1).astype(np.uint32)
        step = lambda x: t[x & 0xFF] ^ (x >> np.uint32(8))
        rows = [t]
        for _ in range(CHUNK - 1):
            rows.append(step(rows[-1]))
        _tables["at"] = np.concatenate(rows[::-1])
        skip = (np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * 8)[:, None]).astype(np.uint32)
        for _ in range(CHUNK):
            skip = step(skip)
        _tables["skip"] = skip
        _tables["base"] = (np.arange(CHUNK, dtype=np.int32) * 256)[None, :]
    return _tables


def masked_crcs(parts: list[bytes]) -> np.ndarray:
    """The masked CRC-32C of each part (of four bytes or more), vectorised over chunks of all parts."""
    tables = _crc_tables()
    n = np.array([len(p) for p in parts], np.int64)
    chunks = -(-n // CHUNK)
    first = np.cumsum(chunks) - chunks
    buf = np.zeros(int(chunks.sum()) * CHUNK, np.uint8)
    for p, k, c, f in zip(parts, n.tolist(), chunks.tolist(), first.tolist()):
        end = (f + c) * CHUNK
        buf[end - k : end] = np.frombuffer(p, np.uint8)
        buf[end - k : end - k + 4] ^= 0xFF  # the register starts at all ones
    mat = buf.reshape(-1, CHUNK)
    crc = np.empty(len(mat), np.uint32)
    for i in range(0, len(mat), 2048):
        at = tables["base"] + mat[i : i + 2048]
        crc[i : i + 2048] = np.bitwise_xor.reduce(tables["at"][at], axis=1)
    out = np.zeros(len(parts), np.uint32)
    skip = tables["skip"]
    order = np.argsort(-chunks, kind="stable")
    for j in range(int(chunks.max(initial=0))):
        live = order[: np.searchsorted(-chunks[order], -j, side="left")]
        x = out[live]
        x = skip[0][x & 0xFF] ^ skip[1][x >> 8 & 0xFF] ^ skip[2][x >> 16 & 0xFF] ^ skip[3][x >> 24]
        out[live] = x ^ crc[first[live] + j]
    out ^= np.uint32(0xFFFFFFFF)
    return ((out >> np.uint32(15)) | (out << np.uint32(17))) + np.uint32(MASK)


class WordEncoder:
    """Ids of texts, by way of their distinct words, cut at ASCII white space.

    Right for tokenizers that drop white space and never join across it (it is checked on load); a word
    is encoded by the library once per cache, texts are put together from the words' ids.
    """

    def __init__(self, path: str, end_id: int | None = END_ID, cache_words: int = CACHE_WORDS):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.whole = not _cuts_at_space(json.load(open(path, encoding="utf-8")))
        self.end = [] if end_id is None else [end_id]
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.cache_words = cache_words
        self._reset()

    def _reset(self) -> None:
        """Forgets all words. ``at``: a word's number; ``pool``: all words' ids, word n from ``first[n]``, ``count[n]`` of them."""
        self.at: dict[bytes, int] = {}
        self.pool, self.first, self.count = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text (no nulls), with the end id."""
        end = np.array(self.end, np.uint32)
        if self.whole:
            got = self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)
            return [np.array(x.ids + self.end, np.uint32) for x in got]
        if len(self.at) > self.cache_words:
            self._reset()
        split = pa.compute.ascii_split_whitespace(texts)
        lists = split.offsets.to_numpy()
        words = split.values.slice(int(lists[0]), int(lists[-1] - lists[0])).dictionary_encode()
        # A word of Latin-1 letters and closing stops is the ids of its lower-cased letters, then those of the stops.
        plain = pa.compute.match_substring_regex(words.dictionary, PLAIN)
        stem = pa.compute.utf8_rtrim(words.dictionary, STOPS)
        stops = pa.compute.utf8_slice_codeunits(words.dictionary, 0, 0)
        if pa.compute.any(plain).as_py():
            after = pa.compute.replace_substring_regex(words.dictionary, f"^.*?([{STOPS}]*)$", r"\1")
            stops = pa.compute.if_else(plain, after, stops)
        stem = pa.compute.if_else(plain, pa.compute.utf8_lower(stem), words.dictionary)
        parts = pa.concat_arrays([stem, stops]).dictionary_encode()
        number = self._numbers(parts.dictionary)[parts.indices.to_numpy()].reshape(2, -1)
        pool, count = _gather(self.pool, self.first[number.T.ravel()], self.count[number.T.ravel()])
        count = count.reshape(-1, 2).sum(axis=1)
        at = words.indices.to_numpy()
        flat, count = _gather(pool, (np.cumsum(count) - count)[at], count[at])
        cut = np.r_[0, np.cumsum(count)][lists - lists[0]].tolist()
        return [np.concatenate([flat[a:b], end]) for a, b in zip(cut[:-1], cut[1:])]

    def _numbers(self, words: pa.Array) -> np.ndarray:
        """The words' numbers; those not known yet are encoded, each as a text of its own."""
        at = self.at
        keys = words.cast(pa.binary()).to_pylist()
        out = np.fromiter((at.get(w, -1) for w in keys), np.int64, len(keys))
        new = np.nonzero(out < 0)[0]
        if len(new):
            n = len(at)
            out[new] = np.arange(n, n + len(new))
            at.update(zip((keys[i] for i in new.tolist()), range(n, n + len(new))))
            fresh = words.take(pa.array(new)).to_pylist()
            parts = [self.tokenizer.encode(fresh[i : i + 4096], is_pretokenized=True, add_special_tokens=False) for i in range(0, len(fresh), 4096)]
            count = np.zeros(len(fresh), np.int64)
            for k, x in enumerate(parts):
                if x.ids:
                    count[k * 4096 : k * 4096 + 4096] += np.bincount(np.array(x.word_ids, np.int64), minlength=len(fresh[k * 4096 : k * 4096 + 4096]))
            self.first = np.r_[self.first, len(self.pool) + np.cumsum(count) - count]
            self.count = np.r_[self.count, count]
            self.pool = np.concatenate([self.pool, *[np.array(x.ids, np.uint32) for x in parts]])
        return out


def _gather(pool: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs pool[first : first + count], one after another, and their lengths."""
    ends = np.cumsum(count)
    return pool[np.repeat(first - (ends - count), count) + np.arange(int(count.sum()))], count


def _cuts_at_space(spec: dict) -> bool:
    """Whether the tokenizer's definition keeps words apart and drops the space between them."""
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    split = pre[0].get("pattern", {}).get("Regex", "")
    kinds = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    added = "".join(x["content"] for x in spec.get("added_tokens", []))
    return pre[0].get("behavior") == "Removed" and bool(pre[0].get("invert")) and " ?" not in split and kinds == ["NFC", "Replace", "Lowercase"] and not any(c.isspace() for c in added) and spec.get("post_processor") is None


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def write_records(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int | None = END_ID, files: int | None = None, id_col="doc_id", text_col="text", cache_words: int = CACHE_WORDS, keep: bool = False) -> DataFrame:
    """Writes all rows in ascending id order as record files under ``folder``; returns the manifest.

    Manifest: a row per file with ``part, file, records, tokens, start`` (``start``: ids in all files
    before). Rows with a null id come first; a null text counts as empty and has the end id only. Rows
    of one id follow each other in the order of their texts' hashes; they may go to different files. A task
    writes under a name of its own, and only the attempt that ends well gets into the manifest. ``keep``: a Python worker keeps
    its encoder and known words from task to task, which takes less time and more memory.
    """
    spark = docs.sparkSession
    key = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    key = key.withColumn("h", F.xxhash64("text"))
    n = files or max(1, -(-(key.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // FILE_BYTES))
    order = ["doc_id", "h", "salt"]  # the salt lets rows that are alike be dealt to several files
    shared = spark.sparkContext.broadcast({}) if keep else None  # a worker has the same object in all its tasks
    dealt = key.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order).drop("h", "salt")

    def run(batches):
        import os

        path = tokenizer or default_tokenizer()
        part = TaskContext.get().partitionId()
        encoder, fs, out, index = None, None, None, []
        target = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}"
        records = tokens = offset = 0
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1)
            sizes = np.array(pa.compute.binary_length(texts), np.int64)
            cuts = np.unique(np.r_[0, np.searchsorted(np.cumsum(sizes), np.arange(SLICE_CHARS, sizes.sum() + SLICE_CHARS, SLICE_CHARS)) + 1, len(sizes)])
            cuts = cuts[cuts <= len(sizes)]
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if encoder is None:
                    held = shared.value if keep else {}
                    if "encoder" not in held:
                        held["encoder"] = WordEncoder(path, end_id, cache_words)
                    encoder = held["encoder"]
                    held = None
                    fs, at = common.open_fs(target)
                    fs.create_dir(os.path.dirname(at), recursive=True)
                    out = fs.open_output_stream(at + ".rec")
                kind = "<u2" if encoder.width == 2 else "<u4"
                payloads = []
                for d, x in zip(ids[i:j], encoder.encode(texts.slice(i, j - i))):
                    payloads.append(struct.pack(HEADER, d is None, encoder.width, d or 0) + x.astype(kind).tobytes())
                    index.append((d or 0, offset, len(payloads[-1]), len(x)))
                    offset += 16 + len(payloads[-1])
                    tokens += len(x)
                lengths = [struct.pack("<Q", len(p)) for p in payloads]
                crc_l, crc_p = masked_crcs(lengths).astype("<u4"), masked_crcs(payloads).astype("<u4")
                out.write(b"".join(x for n_, a, p, c in zip(lengths, crc_l, payloads, crc_p) for x in (n_, a.tobytes(), p, c.tobytes())))
                records += j - i
        if out is not None:
            out.close()
            with fs.open_output_stream(at + ".idx") as f:
                f.write(np.array(index, "<i8").tobytes())
            yield pa.RecordBatch.from_pylist([{"part": part, "file": target + ".rec", "records": records, "tokens": tokens}], schema=_MANIFEST)
        encoder = b = texts = index = payloads = lengths = None
        common.release_memory()

    manifest = common.written(dealt.mapInArrow(run, "part int, file string, records long, tokens long"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


_MANIFEST = pa.schema([("part", pa.int32()), ("file", pa.string()), ("records", pa.int64()), ("tokens", pa.int64())])


def frames(stream, block: int = 4 << 20):
    """Lists of checked payloads of a record file, some megabytes at a time. Raises on any damage."""
    rest = b""
    while True:
        got = stream.read(block)
        rest += got
        at, lengths, payloads, sums = 0, [], [], []
        while len(rest) - at >= 12:
            size = int.from_bytes(rest[at : at + 8], "little")
            if len(rest) - at < 16 + size:
                break
            lengths.append(rest[at : at + 8])
            payloads.append(rest[at + 12 : at + 12 + size])
            sums.append((rest[at + 8 : at + 12], rest[at + 12 + size : at + 16 + size]))
            at += 16 + size
        if payloads:
            check_frames(lengths, payloads, sums)
            yield payloads
        rest = rest[at:]
        if not got:
            if rest:
                raise ValueError("record file: cut off within a frame")
            return


def check_frames(lengths, payloads, sums) -> None:
    for parts, k in ((lengths, 0), (payloads, 1)):
        if (masked_crcs(parts) != np.frombuffer(b"".join(s[k] for s in sums), "<u4")).any():
            raise ValueError("record file: wrong checksum")


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    """(document id, ids) of a payload."""
    null, width, doc = struct.unpack_from(HEADER, payload)
    return None if null else doc, np.frombuffer(payload, "<u2" if width == 2 else "<u4", offset=struct.calcsize(HEADER))


def read_at(file: str, offsets: list[int]) -> list[tuple[int | None, np.ndarray]]:
    """The records at some offsets of the index, in any order: the shuffled reader's access."""
    fs, at = common.open_fs(file)
    out = []
    with fs.open_input_file(at) as f:
        for o in offsets:
            f.seek(o)
            head = f.read(12)
            size = int.from_bytes(head[:8], "little")
            body = f.read(size + 4)
            check_frames([head[:8]], [body[:size]], [(head[8:], body[size:])])
            out.append(unpack(body[:size]))
    return out


def read_index(file: str) -> np.ndarray:
    """(document id, offset, payload length, number of ids) per record of a ``.rec`` file."""
    fs, at = common.open_fs(file.removesuffix(".rec") + ".idx")
    with fs.open_input_stream(at) as f:
        return np.frombuffer(f.read(), "<i8").reshape(-1, 4)


def read_records(manifest: DataFrame, files: int | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every record, read back from the files, one task per few files."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                fs, at = common.open_fs(row["file"])
                start, seen = row["start"], 0
                with fs.open_input_stream(at) as f:
                    for payloads in frames(f):
                        docs, starts, counts, sums = [], [], [], []
                        for p in payloads:
                            d, ids = unpack(p)
                            docs.append(d)
                            starts.append(start)
                            counts.append(len(ids))
                            sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                            start += len(ids)
                        seen += len(docs)
                        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                if seen != row["records"]:
                    raise ValueError(f"{row['file']}: {seen} records, {row['records']} expected")

    n = files or max(1, manifest.count())
    dealt = manifest.repartitionByRange(n, "part")
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenize_and_read(docs: DataFrame, tokenizer: str | None = None, cache_words: int = CACHE_WORDS, keep: bool = False) -> DataFrame:
    """Writes ``docs`` as record files in the shared folder and reads them back.

    A null text counts as empty; very long texts are encoded whole; rows that are alike get records of their own, in
    any order among each other. Other columns play no part, whatever their names; an empty table gives an empty
    result. ``cache_words`` trades a task's memory (some 140 bytes a word) for time; it changes no result."""
    folder = common.new_path(docs.sparkSession, "records")
    return read_records(write_records(docs, folder, tokenizer, cache_words=cache_words, keep=keep))


def op2_token_records(spark, sf_dir: str) -> DataFrame:
    """The contract's query over all of ``documents``."""
    return tokenize_and_read(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=True)

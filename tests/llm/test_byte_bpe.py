"""Byte-level BPE: the rank queue against tiktoken, round trips, odd rows."""

import hashlib
import random
import struct

import pytest

from tessera.llm import byte_bpe


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.Encoder(byte_bpe.load_ranks(byte_bpe.default_ranks()), byte_bpe.default_pattern())


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=byte_bpe.default_pattern(), mergeable_ranks=byte_bpe.load_ranks(byte_bpe.default_ranks()), special_tokens={})


def ids(encoder, text):
    return [x for (x,) in struct.iter_unpack("<I", encoder.encode(text))]


def test_same_ids_as_the_library(encoder, library):
    rng = random.Random(3)
    for _ in range(1500):
        letters = rng.choice(["ab", "abc ", "the and of'sll", "aeiou\n\t ", "019 ,.", "漢字かな😀", "abcdefghijklmnop", "éèüß́  "])
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 150)))
        assert ids(encoder, text) == library.encode_ordinary(text)
        assert encoder.decode(encoder.encode(text)).decode() == text


def test_every_kind_of_character(encoder, library):
    for base in range(0, 0x110000, 0x400):
        text = "".join(f"a{chr(c)}1{chr(c)} {chr(c)}." for c in range(base, base + 0x400, 7) if not 0xD800 <= c < 0xE000)
        assert ids(encoder, text) == library.encode_ordinary(text)


def test_long_pre_tokens(encoder, library):
    for text in ("ab" * 100_000 + "c" * 100_000, "-" * 300_001, " " * 50_000 + "x", "a b" * 500_000):
        assert ids(encoder, text) == library.encode_ordinary(text)
    assert not any(encoder.words)  # the bitmap is empty again


def test_queue_against_plain_merges(library):
    """A rank file in which merges bring up lower ranks than their own, and ties that must go from left to right."""
    rng = random.Random(9)
    for _ in range(60):
        tokens = {"".join(rng.choice("abc") for _ in range(rng.randint(2, 5))).encode() for _ in range(40)}
        ranks = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(rng.sample(sorted(tokens), len(tokens)))}
        mine = byte_bpe.Encoder(ranks, r".+")
        for _ in range(20):
            text = "".join(rng.choice("abc") for _ in range(rng.randint(1, 60)))
            parts = [bytes([b]) for b in text.encode()]
            while text.encode() not in ranks:
                found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
                if not found:
                    break
                _, i = min(found)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            want = [ranks[text.encode()]] if text.encode() in ranks else [ranks[p] for p in parts]
            assert ids(mine, text) == want


def test_cache_size_changes_nothing(encoder):
    small = byte_bpe.Encoder(encoder.ranks, byte_bpe.default_pattern(), 2)
    for text in ("one two three one two three " * 20, "x" * 200):
        assert small.encode(text) == encoder.encode(text)


def test_bad_files_and_ids(encoder):
    with pytest.raises(ValueError, match="lacks 256"):
        byte_bpe.Encoder({b"ab": 0}, ".+")
    with pytest.raises(KeyError, match="not in the rank file"):
        encoder.decode(struct.pack("<I", 1 << 30))


def test_odd_rows(spark, odd_docs, no_docs, library):
    got = byte_bpe.decode(byte_bpe.encode(odd_docs)).collect()
    rows = odd_docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    want = sorted((r.doc_id is None, r.doc_id or 0, len(library.encode_ordinary(r.text or "")), (r.text or "").encode()) for r in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, bytes(r.decoded)) for r in got) == want
    assert byte_bpe.decode(byte_bpe.encode(no_docs)).collect() == []


def test_query_digests(spark, sf, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in byte_bpe.op11_byte_bpe(spark, sf).collect():
        want = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()

"""Collocations against a plain count; sketches lose nothing; odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import collocations as col

DOCS = "doc_id long, text string, lang string"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def plain_counts(rows, longest=4):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(str.maketrans(UPPER, LOWER))):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    return n, f


def plain(rows, least=30, longest=4, covered=80, top=2000):
    n, f = plain_counts(rows, longest)
    found = {g: a for g, a in f.items() if a >= least and len(g[1]) > 1}
    by_lang = {}
    for (lang, w), a in found.items():
        if any(len(v) > len(w) and m == lang and 100 * b >= covered * a and any(v[i : i + len(w)] == w for i in range(len(v))) for (m, v), b in found.items()):
            continue
        score, _, l, r = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        by_lang.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, got in by_lang.items() for i, (s, a, p, l, r) in enumerate(sorted(got)[:top]))


def corpus(seed, n=400):
    rng = random.Random(seed)
    words = ["New", "york", "city", "of", "the", "é́a", "漢字", "a\x00b", "x", "don't", " ", "\x1c"] + [f"w{i}" for i in range(60)]
    out = []
    for _ in range(n):
        w = [words[min(int(rng.expovariate(0.15)), len(words) - 1)] for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice([["new", "York", "city"], ["out", "of", "the", "blue"], ["one", "two", "three", "four", "five"], ["z", "z", "z", "z", "z"]])
        out.append(("".join(x + rng.choice([" ", " ", " ", "\t ", ", ", ".", "\n", " \x0b", "!? "]) for x in w), rng.choice(["en", "en", "en", "de", None, "und", ""])))
    return out


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("block_bytes", [200, 1 << 20])
def test_same_rows_as_a_plain_count(spark, seed, block_bytes):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], DOCS).repartition(3)
    got = col.collocations(df, 7, block_bytes=block_bytes).collect()
    assert sorted(map(tuple, got)) == plain(rows, 7)
    assert len(got) > 40


@pytest.mark.parametrize("least,longest,covered,top", [(1, 2, 80, 10), (5, 3, 50, 7), (300, 4, 80, 2000), (4, 5, 100, 50)])
def test_parameters(spark, least, longest, covered, top):
    rows = corpus(5, 120)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], DOCS)
    got = col.collocations(df, least, longest, covered, top).collect()
    assert sorted(map(tuple, got)) == plain(rows, least, longest, covered, top)


def test_crowded_sketches_lose_nothing(spark, monkeypatch):
    """Sketches far too small keep more than is due, and never less."""
    monkeypatch.setattr(col, "ROWS", 1)
    real = col.cells_of
    monkeypatch.setattr(col, "cells_of", lambda h, row, bits: real(h, row, bits) & np.uint64(3))
    rows = corpus(7, 150)
    got = col.collocations(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], DOCS), 6).collect()
    assert sorted(map(tuple, got)) == plain(rows, 6)


def test_all_counts_are_exact(spark):
    rows = corpus(8)
    found, sizes = col.counts(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], DOCS), 10, block_bytes=500)
    n, f = plain_counts(rows)
    assert {(r.lang, tuple(r.phrase.split(" "))): r.a for r in found.collect()} == {k: a for k, a in f.items() if a >= 10}
    assert {r.lang: r.n for r in sizes.collect()} == {k: v for k, v in n.items() if v or k in {("und" if x is None else x) for _, x in rows}}


def test_scores_beyond_64_bits(spark):
    big = 9_000_000_000_000_000_000
    rows = [("en", "a b", 2, big), ("en", "a", 1, big + 5), ("en", "b", 1, big + 1), ("en", "a b c", 3, big // 5 * 4), ("en", "c", 1, big // 5 * 4), ("en", "b c", 2, big // 5 * 4)]
    got = {r.phrase: r for r in col.score(spark.createDataFrame(rows, "lang string, phrase string, words int, a long")).collect()}
    assert got["a b"].score == 2_000_000 * big // (2 * big + 6) == 999_999
    assert got["a b"].subsumed and got["b c"].subsumed and not got["a b c"].subsumed
    a = big // 5 * 4
    assert (got["a b c"].score, got["a b c"].l, got["a b c"].r) == (2_000_000 * a // (big + 5 + a), big + 5, a)  # both cuts score alike: the first counts


def test_long_texts_are_cut_between_pieces_only():
    text = b"\n".join(b"x" * (i % 70) for i in range(300))
    parts = list(col._cut(text, 100))
    assert b"\n".join(parts) == text and max(map(len, parts)) <= 140
    assert list(col._cut(b"y" * 500, 100)) == [b"y" * 500]


def test_long_texts_and_hot_pieces(spark):
    text = "the cat sat on the mat. " * 20_000 + "one two " * 100_000
    got = col.collocations(spark.createDataFrame([(1, text, "en"), (2, text, "en")], DOCS), block_bytes=50_000).collect()
    assert sorted(map(tuple, got)) == plain([(text, "en")] * 2)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.text, r.lang) for r in odd_docs.select("text", "lang").collect()]
    assert sorted(map(tuple, col.collocations(odd_docs, 3).collect())) == plain(rows, 3)
    assert col.collocations(no_docs).collect() == []
    assert col.collocations(spark.createDataFrame([(1, None, None), (2, "", "en"), (3, " . ", "de")], DOCS)).collect() == []

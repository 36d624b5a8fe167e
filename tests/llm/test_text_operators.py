"""Operators on texts: contract queries against brute force, odd rows, empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import decontaminate, html_text, kneser_ney, mixing, pii, records, simhash_dedup, substring_dedup


def collect(df, key="doc_id"):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- SimHash near-duplicates


def brute_components(ids, fps, r):
    n, label = len(ids), list(range(len(ids)))
    for _ in range(n):
        new = [min(label[j] for j in range(n) if bin(fps[i] ^ fps[j]).count("1") <= r) for i in range(n)]
        if new == label:
            break
        label = new
    low = {}
    for i, g in zip(ids, label):
        low[g] = min(low.get(g, i), i)
    return {i: low[g] for i, g in zip(ids, label)}


def test_fingerprint_by_hand():
    from xxhash import xxh64_intdigest

    text = "One two THREE four five"
    words = [w.lower() for w in text.split()]
    grams = [" ".join(words[i : i + 3]) for i in range(3)]
    bits = 0
    for b in range(64):
        if 2 * sum(xxh64_intdigest(g.encode(), 42) >> b & 1 for g in grams) > len(grams):
            bits |= 1 << b
    assert simhash_dedup.fingerprint(text.encode()) == bits
    assert simhash_dedup.fingerprint(b" \n") == 0
    assert simhash_dedup.fingerprint("É a".encode()) == xxh64_intdigest("É a".encode(), 42)  # only A-Z is folded


def test_components_against_brute_force(spark, odd_docs):
    got = collect(simhash_dedup.components(odd_docs))
    assert len(got) == odd_docs.count()
    with_id = {(d, f) for d, f, _ in got if d is not None}
    ids, fps = zip(*sorted(with_id))
    want = brute_components(list(ids), [f & (1 << 64) - 1 for f in fps], 2)
    assert all(c == want[d] for d, f, c in got if d is not None)
    assert all(c is None for d, _, c in got if d is None)


@pytest.mark.parametrize("r,m", [(2, 4), (3, 5), (5, 7)])
def test_links_connect_what_is_close(spark, r, m, monkeypatch):
    rng = np.random.default_rng(r)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = set()
    for b in base:
        for _ in range(60):
            x = int(b)
            for bit in rng.integers(0, 64, rng.integers(0, 2 * r)):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = sorted(fps)
    monkeypatch.setattr(simhash_dedup, "GROUP", 8)
    monkeypatch.setattr(simhash_dedup, "LIMIT", 20)  # the second level is needed, too
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    got = simhash_dedup.links(df, r, m).collect()
    unsigned = lambda x: x & (1 << 64) - 1
    assert all(bin(unsigned(a) ^ unsigned(b)).count("1") <= r for a, b in got)
    parent = {x: x for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in got:
        parent[find(unsigned(a))] = find(unsigned(b))
    want = brute_components(list(range(len(fps))), fps, r)
    groups = {}
    for i, x in enumerate(fps):
        groups.setdefault(find(x), set()).add(want[i])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_one_document_of_each_group_stays(spark, odd_docs, no_docs):
    kept = simhash_dedup.without_near_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = Counter(r.doc_id for r in kept.select("doc_id").collect())
    assert not any(200 + i in ids for i in range(5)) and ids[0] == 1 and ids[3] == 1 and ids[None] == 2
    assert sum(ids[i] for i in (300, 301, 302)) == 1
    assert all(ids[i] == 1 for i in range(30))
    assert simhash_dedup.without_near_copies(no_docs).count() == 0 and simhash_dedup.components(no_docs).count() == 0


@pytest.mark.parametrize("group, limit", [(64, 16384), (4, 16384)])
def test_near_copies_are_those_of_shingle_similarity(spark, group, limit, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "GROUP", group)
    monkeypatch.setattr(simhash_dedup, "LIMIT", limit)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    texts = []
    for n in (12, 40, 80, 200):
        for _ in range(6):
            words = [word() for _ in range(n)]
            texts.append(words)
            for edits in (1, 2, 3, 4, 6):  # similarities on both sides of 0.8
                other = list(words)
                for i in rng.sample(range(n), edits):
                    other[i] = word()
                texts.append(other)
            texts.append(sorted(words))  # the same words in another order
            texts.append(words * 7)  # a loop of the text
    texts = [" ".join(x) for x in texts]
    sets = [{tuple(x.split()[i : i + 5]) for i in range(len(x.split()) - 4)} for x in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id for r in simhash_dedup.without_near_copies(docs).collect()}
    assert got == {i for i in range(len(texts)) if find(i) == i}


def similar_components(texts):
    sets = [{tuple(x.split()[i : i + 5]) for i in range(len(x.split()) - 4)} for x in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(texts))]


def test_short_texts_are_compared_at_all_bits(spark):
    """Texts of some ten shingles, whose fingerprints may lie far apart: no copy of 0.8 is missed."""
    rng = random.Random(4)
    word = lambda i: "".join(rng.choice("abcdefghijklmnop") for _ in range(5)) + str(i)
    texts = []
    for i in range(1500):
        words = [word(i) for _ in range(rng.choice([8, 9, 10, 12, 13]))]
        texts += [" ".join(words), " ".join(words[: len(words) - (len(words) - 4) // 5])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id for r in simhash_dedup.without_near_copies(docs).collect()}
    assert not any(2 * i + 1 in got for i in range(1500) if 5 * (len(texts[2 * i + 1].split()) - 4) >= 4 * (len(texts[2 * i].split()) - 4))


def test_dense_groups_keep_most_links(spark):
    """Hundreds of documents under one anchor at similarities around 0.8: nine of ten that a chain of similar ones links to a smaller id go."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    texts = []
    for n in (60, 150, 400):
        base = [word() for _ in range(n)]
        for _ in range(250):
            other = list(base)
            for i in rng.sample(range(n), rng.randint(0, max(2, n // 20))):
                other[i] = word()
            texts.append(" ".join(other))
    rng.shuffle(texts)
    root = similar_components(texts)
    gone = {i for i in range(len(texts)) if root[i] != i}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = set(range(len(texts))) - {r.doc_id for r in simhash_dedup.without_near_copies(docs).collect()}
    assert got <= gone and len(gone) > 300
    print(f"dense groups: {len(got)} of {len(gone)} found")
    assert len(got) >= 0.9 * len(gone)


@pytest.mark.parametrize("limit, family", [(16384, 2_000_000), (40, 9_000)])
def test_dense_groups_lose_no_link(spark, limit, family, monkeypatch):
    """As above, but every link counts, also where anchors and families are cut into parts."""
    monkeypatch.setattr(simhash_dedup, "LIMIT", limit)
    monkeypatch.setattr(simhash_dedup, "FAMILY", family)
    rng = random.Random(22)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    texts = []
    for n in (30, 150, 400):
        base = [word() for _ in range(n)]
        for _ in range(120):
            other = list(base)
            for i in rng.sample(range(n), rng.randint(0, max(2, n // 20))):
                other[i] = word()
            texts.append(" ".join(other))
    rng.shuffle(texts)
    root = similar_components(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id for r in simhash_dedup.without_near_copies(docs).collect()}
    assert got == {i for i in range(len(texts)) if root[i] == i} and 50 < len(got) < 300


def test_rows_that_share_many_anchors_meet_under_one(spark):
    """Sketches go to an anchor of each set of rows, not to each anchor; rows that are alike count as rows."""
    rng = random.Random(3)
    held = {row: rng.sample(range(100), rng.randint(1, 6)) for row in range(60)}
    for row in range(60, 90):  # near copies and copies of three documents
        held[row] = [1000 * (row % 3) + i for i in range(200)] + [5000 + row % 2]
    want = {}
    for a in {a for x in held.values() for a in x}:
        rows = frozenset(row for row, x in held.items() if a in x)
        if len(rows) > 1:
            want[rows] = min(a, want.get(rows, a))
    nodes = spark.createDataFrame([(row // 2, row, x) for row, x in held.items()], "doc_id long, row long, bits array<long>")
    got = {r.bits: r["size"] for r in simhash_dedup.anchor_sets(nodes).collect()}
    assert got == {a: len(rows) for rows, a in want.items()} and len(got) < 110


def test_sketches_deny_no_similar_pair():
    rng = np.random.default_rng(5)
    for n in (3, 60, 250, 260, 600, 2000, 40_000):
        sets = [rng.integers(0, 1 << 63, n, dtype=np.uint64)]
        for m in (0, n // 9, n // 4):  # similarities of 1, 0.8 and 0.6
            sets.append(np.r_[sets[0][: n - m], rng.integers(0, 1 << 63, m, dtype=np.uint64)])
        sets.append(np.r_[sets[0], rng.integers(0, 1 << 63, n // 4, dtype=np.uint64)])  # longer: of 0.8, maybe of another width
        sets.append(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        widths = [simhash_dedup.parity_bits(len(s)) for s in sets]
        odd = [simhash_dedup.parities(s, np.zeros(len(s), np.int64), 1, w).tobytes() for s, w in zip(sets, widths)]
        got = simhash_dedup.Sketches(np.array([len(s) for s in sets]), odd).possible(np.zeros(5, np.int64), np.arange(1, 6))
        assert got[[0, 1, 3]].all() and (n < 60 or n > 20_000 or not got[4])


# --- repeated windows


def brute_windows(rows):
    first = {}
    for d, t in rows:
        w = (t or "").encode().split()
        for j in range(len(w) - 12):
            if d is not None:
                key = tuple(w[j : j + 13])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        keep = [True] * len(w)
        for j in range(len(w) - 12):
            if d is not None and first[tuple(w[j : j + 13])] < d:
                keep[j : j + 13] = [False] * 13
        kept = b" ".join(x for x, k in zip(w, keep) if k)
        out.append((d, len(w), len(w) - sum(keep), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [300, 6 << 20])
def test_windows_against_brute_force(spark, odd_docs, block_bytes):
    docs = odd_docs.where("doc_id is null or doc_id <> 400")
    shared = " ".join(f"w{i}" for i in range(40))
    more = spark.createDataFrame([(500, "a b " + shared), (501, shared + " c"), (499, "x " + shared.replace("w20 ", "")), (502, shared + " " + shared)], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(more)
    assert collect(substring_dedup.dedup(docs, block_bytes=block_bytes)) == brute_windows([tuple(r) for r in docs.collect()])


def test_windows_long_and_empty(spark, odd_docs, no_docs):
    got = {r.doc_id: r for r in substring_dedup.kept_texts(odd_docs.where("doc_id in (300, 301, 302, 400)")).collect()}
    assert (got[400].n_words, got[400].n_removed) == (30_000, 0) and got[300].kept == "" and got[302].n_words == 0
    assert substring_dedup.dedup(no_docs).count() == 0


# --- personal data


def brute_spans(text):
    found = []
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    for k, (kind, p) in enumerate(kinds):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = kind == "email" or kind == "phone" and 9 <= len(digits) <= 15 or kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))
            if kind == "card" and 12 <= len(digits) <= 19:
                ok = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
            if ok:
                found.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(found)]


PII = ["a@b.c x@y @z.com a.b@c-d.e.f@g.h", "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112 4111111111111111222", "+1 (886) 555-7964, +123 +12345678 +1.2.3.4.5.6.7.8.9", "é😀 me@x.io 10.0.0.1 +49 30 1234567 4242424242424242", "", "no digits", "1" * 5000 + "@x.y", "a@b.c@d.e f@g..h", "+1 234 567 8901 234 567 8901 234"]


def test_base_spans_against_plain_patterns():
    for text in PII:
        assert [f"{k}:{a}:{b}" for a, b, k in pii.base_spans(text)] == brute_spans(text), text[:60]


def test_pii_query_and_bootstrap(spark, odd_docs, no_docs):
    rows = [(i, t) for i, t in enumerate(PII)] + [(None, "me@x.io"), (90, None)]
    rows += [(100 + i, f"account holder id: user{i}@mail.com then") for i in range(9)] + [(200, "account holder id: ZX-77123-Q, then"), (201, "plain 77123-ZX here")]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in enumerate(PII):
        want = brute_spans(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest() and set(want) <= set(got[i].spans.split(",")) | {""}
        assert got[i].n_email == sum(s.startswith("email") for s in want)
    assert got[200].spans == "id:19:29" and got[201].spans == "" and got[90].spans == "" and got[None].n_email == 1
    # A common word is no pattern, however many seeds it introduces.
    rows = [(i, f"the dog and the cat met the fox near the user{i}@mail.com then the end") for i in range(30)] + [(99, "we saw the 7086638319846192 there")]
    assert all("id:" not in r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert pii.find(odd_docs).count() == odd_docs.count() and pii.find(no_docs).count() == 0


BADGES = [(i, f"contact mail: user{i}@x.example.com today") for i in range(60)]
BADGES += [(100 + i, f"contact mail: QX-10{i}00-K today, badge no QX-10{i}00-K was seen") for i in range(12)]
BADGES += [(200, "another badge no ZZ-55512-Q was seen"), (201, "plain ZZ-55512-Q here"), (202, "the mail: is late"), (203, "no badge no")]


def plain_scores(rows):
    """The rounds of the bootstrap over plain dictionaries; other uses by walking through the words."""
    links, others = {}, Counter()
    texts = {t for _, t in rows if t}
    for t in texts:
        spans = pii.base_spans(t)
        places = [(a, b, True) for a, b, _ in spans] + [(a, b, pii.is_key(t[a:b])) for a, b in pii.candidates(t, spans)]
        for a, b, seed in places:
            for p in pii.context(t, a, b):
                links.setdefault(p, {})[t[a:b].lower()] = seed
                others[p] -= 1
        flat = " ".join(t.lower().split())
        words = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\W_]+", flat)]
        for i, (a, b, w) in enumerate(words):
            if not any(c.isalpha() for c in w):
                continue
            near = i and a - words[i - 1][1] <= pii.GAP
            if i + 1 < len(words) and words[i + 1][0] - b <= pii.GAP:
                others["<" + flat[a : words[i + 1][0]].rstrip()] += 1
                if near:
                    others["<" + flat[words[i - 1][0] : words[i + 1][0]].rstrip()] += 1
            if near:
                others[">" + flat[words[i - 1][1] : b].lstrip()] += 1
    links = {p: x for p, x in links.items() if len(x) >= pii.LEAST_SEEDS}
    n = {p: len(x) + max(others[p], 0) + 1 for p, x in links.items()}
    links = {p: x for p, x in links.items() if len(x) / n[p] >= pii.CONFIDENCE}
    seeds = {i for x in links.values() for i, s in x.items() if s}
    trust = dict.fromkeys(seeds, 1.0)
    while True:
        score = {p: (sum(i in trust for i in x), sum(trust.get(i, 0) for i in x) / n[p]) for p, x in links.items()}
        good = {p for p, (k, v) in score.items() if k >= pii.LEAST_SEEDS and v >= pii.CONFIDENCE}
        new = dict.fromkeys(seeds, 1.0)
        for i in {i for p in good for i in links[p]} - seeds:
            new[i] = 1 - np.prod([1 - score[p][1] for p in good if i in links[p]])
        if len(new) == len(trust):
            return {p: v for p, v in score.items() if v[0]}
        trust = new


@pytest.mark.parametrize("most", [100_000, 0])
def test_bootstrap_learns_in_rounds_and_as_a_plain_one(spark, monkeypatch, most):
    monkeypatch.setattr(pii, "BROADCAST_PATTERNS", most)
    rows = BADGES + BADGES[:3]
    seen, score = {}, pii.pattern_scores

    def keep(*args, **options):
        out = score(*args, **options)
        seen.update({r.pattern: (r.seeds, r.score) for r in out.collect()})
        return out

    monkeypatch.setattr(pii, "pattern_scores", keep)
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = plain_scores(rows)
    assert seen.keys() == want.keys() and all(seen[p] == (want[p][0], pytest.approx(want[p][1])) for p in want)
    assert not any("@" in t for _, t in rows if "badge" in t)  # no base seed shows this pattern
    assert got[200] == "id:17:27" and got[201] == "" and got[100].count("id:") == 2


def test_planted_keys_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where("doc_id is not null")
    got = {r.doc_id: r.spans for r in pii.find(docs).collect()}
    n = 0
    for d, t in docs.collect():
        for m in re.finditer(r'token = "([0-9a-f]{40})"', t or ""):
            n += 1
            assert f"id:{m.start(1)}:{m.end(1)}" in got[d].split(",")
    assert n >= 5


def test_candidates_of_each_kind():
    kinds = ["Tel 01 23 45 67 89 now", "call 555 123 4567.", "write jane.doe at host dot com please", "by (name [at] mail [dot] host)", "follow @some_body there", "key='AB-123-xyz'", "year 2023 and 1.2"]
    want = [["01 23 45 67 89"], ["555 123 4567"], ["jane.doe at host dot com"], ["name [at] mail [dot] host"], ["@some_body"], ["AB-123-xyz"], []]
    assert [[t[a:b] for a, b in pii.candidates(t, [])] for t in kinds] == want
    assert pii.candidates("a@b.c 01 23 45 67 89", [(6, 20, "phone")]) == []
    assert pii.candidates("x at " * 20_000 + "9" * 50_000 + " 1" * 20_000, [])  # in linear time


# --- decontamination


def brute_leaks(docs, items):
    """(doc, item): (start, similarity) of the best of all windows; the earliest of equals."""
    norm = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = {}
    for d, t in docs:
        w = norm(t)
        for i, q in items:
            v = norm(q)
            k = min(5, len(v))
            if d is None or not v:
                continue
            grams = lambda x: Counter(" ".join(x[j : j + k]) for j in range(len(x) - k + 1))  # noqa: B023, E731
            b = grams(v)
            for s in range(-len(v), len(w)):
                a = grams(w[max(s, 0) : max(s + len(v), 0)])
                if a:
                    m = sum(len(g) * min(n, b[g]) for g, n in a.items())
                    x = m / (sum(len(g) * n for g, n in a.items()) + sum(len(g) * n for g, n in b.items()) - m)
                    if x >= 0.8 and ((d, i) not in out or x > out[d, i][1] + 1e-12 or x > out[d, i][1] - 1e-12 and s < out[d, i][0]):
                        out[d, i] = (s, x)
    return out


def same_leaks(got, want):
    assert {(r.doc_id, r.item_id) for r in got} == set(want)
    assert all((r.start, r.similarity) == (want[r.doc_id, r.item_id][0], pytest.approx(want[r.doc_id, r.item_id][1])) for r in got)


def test_leaks_against_brute_force(spark, odd_docs, no_docs):
    item = "The quick brown fox, jumps over the lazy dog while seven wizards brew a strange green potion at night"
    words = item.split()
    near = " ".join(words[:9] + ["BIG"] + words[10:])
    items = [(1, item), (2, "tiny text"), (3, None), (4, "!!!"), (5, item), (6, " ".join(f"z{i}" for i in range(60))), (7, "zebra"), (8, "go go go go go go go go go go"), (6, " ".join(f"z{i}" for i in range(60)))]
    docs = [(1, "a b c " + item.upper() + " d"), (2, near), (3, " ".join(words[:10])), (4, "some Tiny, text here"), (5, None), (None, item), (7, "q " + " ".join(f"z{i}" for i in range(1, 60))), (8, item + " " + item)]
    docs += [(9, "zebra " * 50 + "one ZEBRA"), (10, "go " * 40), (11, "stop " + "go " * 9 + "stop"), (12, item), (12, item)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench)
    same_leaks(got.collect(), brute_leaks(docs, items))
    assert decontaminate.leaks(no_docs, bench).count() == 0 and decontaminate.leaks(odd_docs, bench.limit(0)).count() == 0
    assert {r.doc_id for r in decontaminate.leaks(odd_docs, bench.where("item_id <> 7")).collect()} == set()


def test_leaks_with_words_put_in_and_left_out(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    items, docs = [], []
    for i in range(60):
        words = [word() for _ in range(rng.randint(14, 70))]
        items.append((i, " ".join(words)))
        for j in range(6):
            out = list(words)
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(len(out))
                n = rng.randint(1, 4)
                if rng.random() < 0.5:
                    out[at:at] = [word() for _ in range(n)]
                else:
                    del out[at : at + n]
            docs.append((10 * i + j, " ".join([word() for _ in range(rng.randint(0, 30))] + out + [word() for _ in range(rng.randint(0, 30))])))
    want = {}
    for d in docs:  # no two items share a shingle
        want |= brute_leaks([d], [items[d[0] // 10]])
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert 100 < len(want) < len(docs)
    same_leaks(got, want)


def test_blocks_meet_within_the_radius(spark):
    rng = np.random.default_rng(1)
    pairs = []
    for i in range(40):
        x = int(rng.integers(0, 1 << 63))
        y = x
        for b in rng.choice(64, decontaminate.RADIUS, replace=False):
            y ^= 1 << int(b)
        pairs.append((i, x, y - (1 << 64) if y >> 63 else y))
    wins = spark.createDataFrame([(7, x) for _, x, _ in pairs], "size int, fp long")
    items = spark.createDataFrame([(i, 7, y) for i, _, y in pairs] + [(100 + i, 8, y) for i, _, y in pairs], "item long, size int, fp long")
    found = decontaminate.block_join(wins, items).collect()
    assert {r.item for r in found} == set(range(40)) and all(r.hamming <= decontaminate.RADIUS for r in found)


def test_what_blocks_leave_is_verified_too(spark):
    """Two windows at 1 and at 40 bits, both named by their shared weight: the first comes of the blocks, the second is added."""
    wins = spark.createDataFrame([(1, 0, 3, 9, 5, 77, 0b1, 50), (2, 0, 4, 9, 5, 77, (1 << 40) - 1, 50)], "doc_id long, copy long, start int, size int, k int, item long, fp long, total long")
    marks = spark.createDataFrame([(77, 0, 50, 9), (78, 0b11, 50, 9)], "item long, fp long, total long, size int")
    got = {(r.doc_id, r.item, r.hamming, r.by_blocks) for r in decontaminate.candidates(wins, marks).collect()}
    assert got == {(1, 77, 1, True), (1, 78, 1, True), (2, 77, 40, False)}


def test_short_items_at_document_edges(spark):
    """Items of one to ten words of which a document holds all but one, at its start, its end or alone: none is lost."""
    rng = random.Random(88)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 14)))
    items, docs, want = [], [], {}
    for i in range(3000):
        words = [word() + str(i) for _ in range(rng.choice([1, 2, 5, 7, 9, 10, 10, 10]))]
        items.append((i, " ".join(words)))
        part = words[:-1] if i % 2 else words[1:]
        docs.append((i, " ".join([*(["pre"] if i % 6 == 1 else []), *(part or words), *(["post"] if i % 6 == 2 else [])])))
        want |= brute_leaks([docs[-1]], [items[-1]])
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(want) > 1500
    same_leaks(got, want)
    beyond = sum(r.hamming > decontaminate.RADIUS for r in got)
    assert 0 < beyond < len(got)  # the blocks alone would lose these


def test_keys_and_unseen_identifiers_are_told_apart(spark):
    """Patterns of e-mail addresses find account numbers that no rule names; keys beside the same words are counted as keys."""
    rows = [(i, f"write to account user{i}@mail.example.com today") for i in range(12)] + [(20, "write to account QX-77812-K today"), (21, "account 9f8e7d6c5b4a3f2e1d0c9b8a today"), (22, "nothing")]
    got = {r.doc_id: (r.spans, r.n_key, r.n_unseen) for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[20] == ("id:17:27", 0, 1) and got[21] == ("id:8:32", 1, 0) and got[22] == ("", 0, 0)


def test_other_uses_are_counted_in_all_texts_and_once(spark, monkeypatch):
    seeds = [(i, f"number user{i}@mail.example.com") for i in range(12)]
    found = [(20, "number QX-77812-K")]
    both = [(30 + i, "number zed@mail.example.com and number it") for i in range(40)]  # one text, copied
    plain = [(100 + i, f"the number {'abcdefghijklmnopqrst'[i]} is odd") for i in range(20)]  # no digit, no @
    spans = lambda rows: {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for most in (pii.BROADCAST_PATTERNS, 0):
        monkeypatch.setattr(pii, "BROADCAST_PATTERNS", most)
        assert "id:7:17" in spans(seeds + found + both)[20]
        assert spans(seeds + found + plain)[20] == ""


# --- quality model


def plain_kneser_ney(trained, order=5):
    """The probability of (context, character) by a plain recursion over Counters."""
    pad = lambda t: "\0" * (order - 1) + (t or "").replace("\0", "\ufffd") + "\0"
    grams = lambda t: [pad(t)[i : i + order] for i in range(len(pad(t)) - order + 1)]
    levels = {order: Counter(g for t in trained for g in grams(t))}
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    cuts = {n: kneser_ney.discounts([sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]) for n, c in levels.items()}
    followers = {n: {} for n in levels}
    for n, c in levels.items():
        for g, v in c.items():
            followers[n].setdefault(g[:-1], []).append(v)

    def prob(g):
        n = len(g)
        if not n:
            return 1 / (len(levels[1]) + 1)
        own, d = followers[n].get(g[:-1], []), cuts[n]
        if not own:
            return prob(g[1:])
        cut = lambda v: d[min(v, 3) - 1] if v else 0
        v = levels[n][g]
        return (v - cut(v)) / sum(own) + sum(map(cut, own)) / sum(own) * prob(g[1:])

    return prob, grams, set(levels[1])


TRAINED = ["abracadabra abba", "a cab abates", "bad dab abd bad dab", "漢字 😀 abc", "", None, "a cab abates"]


def test_one_text_with_a_large_alphabet(spark):
    """9,000 distinct characters in one text: its n-grams are told apart, and scores are those of the plain model."""
    big = "".join(chr(0x4E00 + i) for i in range(9000)) + "abra" + chr(0x4E00) * 20_000
    points, counts = kneser_ney.block_grams(pa.array([big]), [True])
    want = Counter(("\0" * 4 + big + "\0")[i : i + 5] for i in range(len(big) + 1))
    assert {kneser_ney.as_text(p[None]): int(c) for p, c in zip(points, counts)} == dict(want)
    texts = [*TRAINED, big[:9100], "abra " * 5]
    rows = [(i, "en", t, int(i < len(TRAINED) + 1)) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in kneser_ney.document_scores(spark.createDataFrame(rows, "doc_id long, lang string, text string, role int")).collect()}
    prob, grams, _ = plain_kneser_ney(texts[:-1])
    for d, _, t, _ in rows:
        assert got[d].n_grams == len(grams(t)) and got[d].nll == pytest.approx(-sum(np.log(prob(g)) for g in grams(t)) / len(grams(t)), abs=1e-5)


def test_plain_model_is_a_distribution():
    prob, _, letters = plain_kneser_ney(TRAINED)
    for ctx in ("abra", "\0\0\0\0", "zzzz", " aba"):
        assert sum(prob(ctx + c) for c in [*letters, "\uabcd"]) == pytest.approx(1)


@pytest.mark.parametrize("block_chars,chunk,letters", [(24_000_000, 1 << 18, 7131), (20, 7, 7131), (24_000_000, 50, 9)])
def test_scores_against_plain_kneser_ney(spark, monkeypatch, block_chars, chunk, letters):
    monkeypatch.setattr(kneser_ney, "CHUNK", chunk)
    monkeypatch.setattr(kneser_ney, "ALPHABET", letters)  # blocks of larger alphabets are halved
    texts = TRAINED + ["abracadabra abba", "unseen ж letters", "ab\0ab", "abba " * 40, "", None]
    rows = [(i if i else None, "en", t, int(i < len(TRAINED))) for i, t in enumerate(texts)]
    got = kneser_ney.document_scores(spark.createDataFrame(rows, "doc_id long, lang string, text string, role int"), block_chars).collect()
    prob, grams, _ = plain_kneser_ney(TRAINED)
    want = [(d, len(grams(t)), -sum(np.log(prob(g)) for g in grams(t)) / len(grams(t))) for d, _, t, _ in rows]
    key = lambda x: (x[0] is None, x[0] or 0)
    for (d, n, nll), r in zip(sorted(want, key=key), sorted(got, key=lambda r: key((r.doc_id,)))):
        assert (d, n) == (r.doc_id, r.n_grams) and nll == pytest.approx(r.nll, abs=1e-5)


def test_thresholds_are_quantiles_by_language(spark):
    rng = np.random.default_rng(4)
    rows = [("en", float(x)) for x in rng.uniform(1, 3, 400)] + [("de", float(x)) for x in rng.uniform(2, 3, 60)] + [("fr", 2.5)] * 3 + [(None, 9.0)]
    got = {r.lang: r.threshold for r in kneser_ney.thresholds(spark.createDataFrame(rows, "lang string, nll double"), 0.9).collect()}
    for lang, some in (("en", [x for k, x in rows if k == "en"]), ("de", [x for k, x in rows if k == "de"]), (None, [x for _, x in rows])):
        exact = sorted(some)[-(-len(some) * 9 // 10) - 1]
        assert exact <= got.pop(lang) <= exact + 1 / kneser_ney.BINS + 1e-9
    assert not got  # fr has too few documents
    assert kneser_ney.thresholds(spark.createDataFrame([], "lang string, nll double")).count() == 0


def test_judging(spark, odd_docs, no_docs):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = kneser_ney.judge(docs, labels).join(labels, "doc_id").toPandas()
    assert got[got.quality == 1].keep.mean() > 0.97 and got[got.quality == 0].keep.mean() < 0.2
    few = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (1, 1, 1), (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    assert kneser_ney.judge(odd_docs, few).count() == odd_docs.count()
    assert kneser_ney.judge(odd_docs, few.limit(0)).where("not keep").count() == 0
    assert kneser_ney.judge(no_docs, few).count() == 0


# --- mixing


def test_targets_by_water_filling(spark):
    x = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 500), ("d", 0)], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(x).collect()}
    # weights by code point: a 1, b 2, c 3, d 1, null 2; a stops at 30, d at 0
    assert got["a"] == 30 and got["d"] == 0
    assert got["b"] == pytest.approx(2480 * 2 / 7) and got["c"] == pytest.approx(2480 * 3 / 7) and got[None] == pytest.approx(2480 * 2 / 7)


def test_tree_splits_exactly():
    quotas, n = [100, 7, 0, 1], 13
    parts = [mixing.split_ranges(quotas, n, 5, s) for s in range(n)]
    for i, q in enumerate(quotas):
        at = 0
        for p in parts:
            assert p[i][0] == at
            at += p[i][1]
        assert at == q
    sizes = [sum(c for _, c in p) for p in parts]
    assert max(sizes) - min(sizes) <= 4 and sum(sizes) == sum(quotas)


def test_draws_are_disjoint_and_spread():
    for n in (1, 2, 3, 10, 97, 1024, 99_991):
        a, c = mixing.permutation(n, 5, 0)
        assert len({(a * i + c) % n for i in range(n)}) == n


def plain_targets(docs, weights=(1, 2, 3), most=3):
    """The size and the target of each source, by filling up in rounds."""
    by = {}
    for d, t, s in docs:
        by.setdefault(s, []).append((d, len(re.findall("[^ \t\n\x0b\x0c\r]+", t or ""))))
    names = sorted(by, key=lambda s: (s is None, s))
    size = {s: sum(n for _, n in by[s]) for s in names}
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, target, left = sum(size.values()), {}, set(names)
    while True:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] >= most * size[s]}
        if not over:
            target |= share
            return size, target
        target |= {s: most * size[s] for s in over}
        left -= over
        if not left:
            return size, target


@pytest.mark.parametrize("options", [{}, {"groups": 4, "block_words": 300, "shard_words": 2000}])
def test_mix(spark, sf, odd_docs, no_docs, options):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    t = mixing.taken(docs, **options).toPandas()
    again = mixing.taken(docs.repartition(7), **options).toPandas()
    assert t.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    assert (t.taken <= 3 * t["size"]).all() and len(t) == docs.count()
    by = t.merge(docs.select("doc_id", "source").toPandas(), on="doc_id").groupby("source", dropna=False).agg({"taken": "sum", "target": "first", "source_size": "first"})
    size, target = plain_targets([tuple(r) for r in docs.select("doc_id", "text", "source").collect()])
    assert all(r.source_size == size[s] and r.target == pytest.approx(target[s]) for s, r in by.iterrows())
    if not options:
        assert (abs(by.taken - by.target) <= 0.05 * by.target + 50).all()
    n = mixing.mix(docs, **options).groupBy("doc_id").count().toPandas().set_index("doc_id")["count"]
    assert all(n.get(r.doc_id, 0) * r["size"] == r.taken for _, r in t.iterrows())
    assert mixing.taken(odd_docs, **options).count() == odd_docs.count() and mixing.mix(odd_docs, **options).columns == odd_docs.columns
    assert mixing.taken(no_docs, **options).count() == 0 and mixing.mix(no_docs, **options).count() == 0


def test_shards_are_of_a_size_and_disjoint(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sized, sources, draws = mixing.draw_plan(docs, groups=8, block_words=500, shard_words=20_000)
    rows = draws.collect()
    assert len({(r.src, r.pos) for r in rows}) == len(rows) and sources.agg({"subs": "max"}).first()[0] > 3
    words = mixing.with_blocks(sized, sources, groups=8).groupBy("src", "grp", "sub").sum("size").collect()
    size = {r[:3]: r[3] for r in words}
    shard = Counter()
    for r in rows:
        shard[r.shard] += size.get((r.src, r.grp, r.sub), 0)
    assert len(shard) > 10 and max(shard.values()) < 3 * 20_000


# --- token records


def test_checksums():
    assert records.masked_crcs([b"123456789"])[0] == (((0xE3069283 >> 15) | (0xE3069283 << 17)) + 0xA282EAD8) & 0xFFFFFFFF
    rng = np.random.default_rng(0)
    parts = [rng.bytes(int(n)) for n in (4, 5, 511, 512, 513, 1500, 70_000)]

    def slow(b):
        c = 0xFFFFFFFF
        for x in b:
            c ^= x
            for _ in range(8):
                c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
        c ^= 0xFFFFFFFF
        return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF

    assert records.masked_crcs(parts).tolist() == [slow(p) for p in parts]


def test_records_against_the_library(spark, odd_docs, no_docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(records.default_tokenizer())
    docs = odd_docs.select("doc_id", "text", "rank").unionByName(spark.createDataFrame([(600, "<|endoftext|> A<|ENDOFTEXT|>, É. don't!! 12½ é,  x y", "r"), (601, "Ends,. with.stops,", "r")], "doc_id long, text string, rank string"))
    got = [tuple(r) for r in records.tokenize_and_read(docs).collect()]
    want = Counter()
    for d, t in docs.select("doc_id", "text").collect():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want[d, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((d, n, c) for d, _, n, c in got) == want
    got.sort(key=lambda r: r[1])
    assert [r[1] for r in got] == np.cumsum([0] + [r[2] for r in got[:-1]]).tolist()
    order = [-1 if r[0] is None else r[0] for r in got]
    assert order == sorted(order)
    assert records.tokenize_and_read(no_docs).count() == 0


def test_index_and_damage(spark, odd_docs, tmp_path):
    m = records.write_records(odd_docs, f"file://{tmp_path}/r", files=2).collect()
    for row in m:
        index = records.read_index(row.file)
        back = records.read_at(row.file, index[::-1, 1].tolist())
        assert [len(x) for _, x in back] == index[::-1, 3].tolist() and len(index) == row.records
    path = m[0].file.removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[-6] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(ValueError):
        list(records.frames(open(path, "rb")))
    with pytest.raises(ValueError):
        list(records.frames(__import__("io").BytesIO(bytes(data[:-9]))))


# --- pages


PAGES = [
    ("<html><head><title>T</title><style>p{}</style></head><body><nav><a href='/'>Home</a></nav><article><h1>A &amp; B</h1><p>One\n  two<br>three</p><p>Be.</p></article><footer>(c)</footer></body></html>", "A & B One two three Be."),
    ("<article><p>text</p><div class='comments'><p>nice</p></div><form>sign</form><aside>side</aside><p>end</article>", "text end"),
    ("<div id=sidebar>s</div><div class=content><h1>Head</h1><p>" + "long text here " * 10 + "</p><p>short</p><p>" + "more text " * 12 + "</p></div><div class='cookie-notice'>ok</div>", "Head " + ("long text here " * 10).strip() + " short " + ("more text " * 12).strip()),
    ("<p>a<script>var t='</p>'; if (a<b) {}</script>b<!-- <p>x</p> -->c</p>", "abc"),
    ("plain &lt;b&gt; text", "plain <b> text"), ("", ""), (None, ""), ("<article>cut <p off", "cut"), ("<script>never closed", ""), ('<p title="x>y</p>z', "y z"), ("<p title='a>b' class=x>y<P>z", "y z"),
    ("<article><div class='entry-header'><h1>H</h1></div><p class=notice>n<p>text</p><div class='content-sidebar'>s</div><div class='content has-sidebar'>in</div><span id='ad-1'>a<span>b</span></span>z</article>", "H text in z"),
    ("<body><div id='header'>site</div><main><p>m</p></main><div class='postComments'>c</div></body>", "m"),
]


@pytest.mark.parametrize("page,want", PAGES)
def test_main_text(page, want):
    assert html_text.main_text(page) == want


def test_names_and_references():
    long = "text of the article " * 9
    page = f"<article><p>{long}</p><div class='share-price'><p>{long}</p></div><div class='share-buttons'>Share</div><div class='related-posts widget'>x</div><p>a &amp<b>; b</b> &lt;i&gt;</p></article>"
    assert html_text.main_text(page) == f"{long.strip()} {long.strip()} a &; b <i>"


def test_surges_against_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        w = [rng.choice([0, 0, 0, 5, 40, 90, 300]) for _ in range(rng.randint(0, 25))]
        total = lambda i: sum(w[i : i + 3])  # noqa: B023, E731
        want, i = [], 0
        while i < len(w):
            if w[i] and total(i) >= 90:
                j = next((k for k in range(i, len(w)) if total(k) == 0), len(w))
                want.append((i, j))
                i = j
            i += 1
        assert html_text.spans(w, 3, 90) == want


def test_surges_choose_among_articles_and_the_rest():
    story = [f"line {i} of a long story " + "with many words " * 8 for i in range(6)]
    card = "card " + "teaser words " * 8
    plain = "".join(f"<p>{x}</p>" for x in story)
    text = " ".join(x.strip() for x in story)
    empty = "<p><a href=x>link</a></p>" * 4
    assert text in html_text.main_text(f"<div>{plain}</div>{empty}<article><p>{card}</p></article>")
    assert html_text.main_text(f"<article><p>few words</p></article>{empty}<div>{plain}</div>") == text
    assert html_text.main_text(f"<article>{plain}</article>{empty}<article><p>tip</p></article>") == text
    second = html_text.main_text(f"<article>{plain}</article>{empty}<article><p>{card}</p><p>end</p></article><div><p>{card}</p></div>")
    assert second == f"{text} {card.strip()} end"


@pytest.mark.parametrize("name", ["layout no-sidebar", "has-sidebar main-content", "page-wrapper modal-open", "site comments-open", "content-with-nav", "ad-free-page", "login-required article-body", "entry-content has-footer", "sidebar-left-layout grid", "cookie-x-wrapper"])
@pytest.mark.parametrize("inner", ["article", "div"])
def test_wrappers_with_class_words_empty_no_page(name, inner):
    text = "A line of the story, with some more words than a window needs for a surge of text. " * 2
    page = f"<body><nav><a href=x>menu</a></nav><div class='{name}'><{inner}><p>{text}</p><p>End.</p></{inner}><div class='comments'><p>{'reader says so ' * 30}</p></div></div><div class='sidebar'>x</div></body>"
    assert html_text.main_text(page) == f"{text.strip()} End."
    assert html_text.main_text(f"<form action=x>{page}</form>") == f"{text.strip()} End."
    assert html_text.main_text(page.replace("<body>", "<body><form><div id='ads-of-x'>").replace("</body>", "</div></form></body>")) == f"{text.strip()} End."


def test_marked_elements_stay_out_of_pages_with_text():
    text = "A line of the story, with some more words than a window needs for a surge of text. " * 2
    other = "and this is as long as the story itself, or longer still, but no part of it. " * 5
    for marked in (f"<form>{other}</form>", f"<div class='sidebar-x-y'>{other}</div>", f"<div class='comments'>{other}</div>", f"<div class='comment-list'><article>{other}</article></div>"):
        assert html_text.main_text(f"<div><p>{text}</p></div>{marked}") == text.strip()
        assert html_text.main_text(f"<article><p>short</p></article>{marked}") == "short"
    assert html_text.main_text(f"<div class='comments'>{other}</div><p>hi</p>") == "hi"
    assert html_text.main_text("<form>name <input> password <input></form>") == ""
    assert html_text.main_text("<div class='modal-x'>" * 30 + f"<p>{text}</p>") == text.strip()


def test_short_articles_and_owners():
    text = "A line of the story, with some more words than a window needs for a surge of text. " * 2
    assert html_text.main_text(f"<article><p>{text}</p></article><article><p>A second one, short but whole.</p></article><article><a href=x>Read more about this.</a></article>") == f"{text.strip()} A second one, short but whole."
    for owner in ("© 2024 The Owner. All rights reserved.", "Copyright (c) 2020 A B", "(c) 1999 x"):
        assert html_text.main_text(f"<div><p>{text}</p><p>{owner}</p></div>") == text.strip()
    assert html_text.main_text(f"<div><p>{text}</p><p>Copyright law is old.</p></div>") == f"{text.strip()} Copyright law is old."


def test_pages_by_construction():
    """Random pages of nested wrappers whose article is known, as an independent form of the rules."""
    rng = random.Random(17)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))
    wrap = ["<div>{}</div>", "<section class='page'>{}</section>", "<div class='layout has-sidebar'>{}</div>", "<div id='site-content'>{}</div>", "<table><tr><td>{}</td></tr></table>", "<form method=post>{}</form>", "<div class='nav-x-layout'>{}</div>"]
    apart = ["<nav>{}</nav>", "<aside>{}</aside>", "<div class='comments'>{}</div>", "<div role=banner>{}</div>", "<footer>{}</footer>", "<div id='cookie-bar'>{}</div>", "<script>{}</script>", "<ul class='menu'><li>{}</li></ul>", "<div style='display: none'>{}</div>", "<div class='related-posts'>{}</div>", "<!-- {} -->", "<button>{}</button>"]
    for _ in range(400):
        want, body = [], []
        for _ in range(rng.randint(1, 6)):
            text = words(rng.randint(16, 60))
            want.append(text)
            cut = text.split(" ")
            cut[1], cut[3] = f"<b>{cut[1]}</b>", f"<i>{cut[3]}</i> \n"
            body.append(f"<p>{' '.join(cut)}</p>")
            if rng.random() < 0.4:
                body.append(rng.choice(apart).format(words(rng.randint(1, 80))))
        page = "".join(body)
        if rng.random() < 0.5:
            page = f"<article>{page}</article>"
        for _ in range(rng.randint(0, 4)):
            page = rng.choice(wrap).format(page)
            page = "".join(rng.choice(apart).format(words(rng.randint(1, 80))) if rng.random() < 0.5 else "" for _ in range(2)) + page
        assert html_text.main_text(f"<!doctype html><html><head><title>{words(3)}</title></head><body>{page}</body></html>") == " ".join(want), page


def test_pages_query(spark, sf):
    rows = [(i, None if i == 2 else f"u{i}", p, "extra") for i, (p, _) in enumerate(PAGES)] + [(None, None, "<p" * 20_000, "x")]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert all(got[i].text == w and got[i].n_chars == len(w) for i, (_, w) in enumerate(PAGES)) and got[2].url is None
    for r in spark.read.parquet(f"{sf}/pages.parquet").limit(20).collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(__import__("html").unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", body)]
        assert html_text.main_text(r.html) == " ".join(x for x in blocks if x)
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_shards_of_the_query_are_those_of_the_tree(spark):
    rng = random.Random(31)
    rows = [(i, "w " * rng.randint(0, 60), f"s{rng.randint(0, 4)}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    options = {"block_words": 100, "shard_words": 1500}
    got = {r.doc_id: r for r in mixing.taken(docs, **options).collect()}
    _, sources, draws = mixing.draw_plan(docs, **options)
    per = Counter(r.shard for r in draws.collect())
    assert len(per) > 3 and max(per.values()) - min(per.values()) <= 1  # the tree splits draws evenly
    for d, t, _ in rows:
        shards = [int(x) for x in got[d].shards.split(",") if x]
        assert shards == sorted(shards) and got[d].taken == len(shards) * got[d].size and len(shards) <= 3
    mixed = mixing.mix(docs, **options).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in mixed} == {d: len(r.shards.split(",")) for d, r in got.items() if r.shards}


def test_permutations_follow_the_seed():
    for n in (1, 2, 7, 64, 1000, 99_991):
        steps = set()
        for seed in range(12):
            a, c = mixing.permutation(n, seed, 0)
            assert len({(a * i + c) % n for i in range(n)}) == n
            steps.add(a)
        assert len(steps) > 2 or n < 64

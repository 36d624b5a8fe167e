"""Operator 7, personal data: base patterns and bootstrapped contextual extraction.

Base spans are e-mail and IP addresses, card and phone numbers, by fixed patterns. They, and long generated
keys (``is_key``), are the seeds of a bootstrap over the whole corpus:

1. What stands right before an entity (its last word, or two, with the marks between) and the word right after
   it are lexical patterns. Candidates are identifier-like strings that no base span touches: tokens with digits, runs of
   digit groups, written-out addresses and handles.
2. A pattern's score is the trust in the distinct instances it introduces over their number and the number of its
   other uses in all documents. An instance that patterns of high confidence introduce is trusted in turn, by
   1 - prod(1 - score), and counts as a seed from then on, so that patterns which no seed shows can be learnt in
   the next round. The rounds are joins of narrow tables and end when nothing new is trusted.
3. Candidates, and keys, that a high-confidence pattern introduces are added as spans of kind ``id``.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, insort
from collections import Counter
from operator import add

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone", "id")
#: A pattern needs so many distinct trusted instances and this score; there are so many rounds at most.
LEAST_SEEDS, CONFIDENCE, ROUNDS = 3, 0.7, 8
#: Identifier-like: a token of so many letters, digits and joints, so many of them digits; a run of digit groups of so many digits.
TOKEN_CHARS, TOKEN_DIGITS, RUN_DIGITS = 6, 3, 7
#: A generated key: so many letters and digits, so many of each.
KEY_CHARS, KEY_EACH = 20, 4
#: Characters beside an entity in which its context words are sought, and those that may lie between two words of a pattern.
CONTEXT, GAP = 80, 8
#: Patterns (some 100 bytes each) up to which they are broadcast.
BROADCAST_PATTERNS = 100_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is taken whole (possessive) and never entered in its middle: same matches, linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_SPACE = " \t\n\x0b\x0c\r"
_EDGE = re.compile(r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping e-mail addresses, found from their @ signs."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        if at >= last:
            start = at
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                out.append((start, m.end()))
                last = m.end()
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind in the order of KINDS."""
    out = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split(".")):
                out.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


_WORD = re.compile(r"[^\W_]+")


def _lettered(word: str) -> bool:
    return any(c.isalpha() for c in word)


def _flat(text: str) -> str:
    """Lower case, white space as single spaces; patterns are pieces of this."""
    return " ".join(text.lower().split())


def context(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns at an entity: ``<`` and its last word, or last two, up to it; ``>`` and all up to the end of the next word."""
    out = []
    before = text[max(0, start - CONTEXT) : start]
    if start > CONTEXT and text[start - CONTEXT - 1].isalnum():
        before = before[_WORD.match(before).end() :] if _WORD.match(before) else before  # cut in its middle
    flat = _flat(before)
    words = list(_WORD.finditer(flat))[-2:]
    if words and _lettered(words[-1][0]) and len(flat) - words[-1].end() <= GAP:
        out.append("<" + flat[words[-1].start() :])
        if len(words) == 2 and words[1].start() - words[0].end() <= GAP:
            out.append("<" + flat[words[0].start() :])
    after = text[end : end + CONTEXT]
    flat = _flat(after)
    word = _WORD.search(flat)
    cut = word and word.end() == len(flat) and text[end + CONTEXT : end + CONTEXT + 1].isalnum() and after[-1:].isalnum()
    if word and not cut and word.start() <= GAP and _lettered(word[0]):
        out.append(">" + flat[: word.end()])
    return out


_PARTS = re.compile(r"([^\W_]+)")


def wanted_keys(patterns) -> tuple[dict, dict]:
    """For ``other_uses``: what stands in a flat text for each left and each right pattern, with or without a space at its open end."""
    left = {key: p for p in patterns if p[0] == "<" for key in (p[1:], p[1:] + " ")}
    right = {key: p for p in patterns if p[0] == ">" for key in (p[1:], " " + p[1:])}
    return left, right


def other_uses(flat: str, wanted, contexts: list[list[str]]) -> dict[str, int]:
    """How often the patterns of ``wanted`` (all, if None) stand in a flat text between two words other than at its entities."""
    parts = _PARTS.split(flat)  # gaps and words in turn
    words, gaps = parts[1::2], parts[::2]
    left = list(map(add, words, gaps[1:-1]))
    two = list(map(add, left, left[1:]))
    right = map(add, gaps[1:-1], words[1:])
    uses: dict[str, int] = {}
    if wanted is None:
        near = [len(g) <= GAP for g in gaps]
        ok = [_lettered(w) for w in words]
        uses = Counter("<" + x.rstrip() for i, x in enumerate(left) if ok[i] and near[i + 1])
        uses.update("<" + x.rstrip() for i, x in enumerate(two) if ok[i + 1] and near[i + 1] and near[i + 2])
        uses.update(">" + x.lstrip() for i, x in enumerate(right) if ok[i + 1] and near[i + 1])
    else:
        for known, places in ((wanted[0], left), (wanted[0], two), (wanted[1], right)):
            if known:
                found = Counter(places)
                for key in known.keys() & found.keys():
                    uses[known[key]] = uses.get(known[key], 0) + found[key]
    for c in contexts:
        for p in c:
            if p in uses:
                uses[p] -= 1
    return {p: n for p, n in uses.items() if n > 0}


#: Runs of digit groups, written-out addresses, handles; each in linear time.
_RUN = re.compile(r"(?<![0-9A-Za-z])[0-9]++(?:[ ./()-]{1,2}+[0-9]++)++(?![0-9A-Za-z])")
_SPELT = re.compile(r"(?<![\w.])[A-Za-z0-9._+-]{1,64}+ ?[(\[]?at[)\]]? ?[A-Za-z0-9-]{1,64}+(?: ?[(\[]?dot[)\]]? ?[A-Za-z0-9-]{1,64}+)++", re.I)
_HANDLE = re.compile(r"(?<![\w@.])@[A-Za-z][A-Za-z0-9_]{2,63}+(?![\w@.]*@)")


def is_key(token: str) -> bool:
    """Whether a string looks like a generated key: only letters and digits, many, and enough of each."""
    return len(token) >= KEY_CHARS and token.isascii() and token.isalnum() and KEY_EACH <= sum(c.isdigit() for c in token) <= len(token) - KEY_EACH


def _tokens(text: str):
    """Tokens with digits, trimmed to letters and digits at both ends; of ``name=value`` the value."""
    last = 0
    for m in _DIGITS.finditer(text):
        a, b = m.start(), m.end()
        if a < last:
            continue
        while a > last and text[a - 1] not in _SPACE:
            a -= 1
        n = len(text)
        while b < n and text[b] not in _SPACE:
            b += 1
        last = b
        token = text[a:b]
        cut = _EDGE.sub("", token)
        if "=" in cut:  # the name is context
            cut = cut.rpartition("=")[2].lstrip("\"'")
        i = a + token.rfind(cut)
        if sum(c.isalnum() for c in cut) >= TOKEN_CHARS and sum("0" <= c <= "9" for c in cut) >= TOKEN_DIGITS:
            yield i, i + len(cut)


def candidates(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Identifier-like places that no base span touches, by start; of two that overlap the earlier kind of these stays:
    written-out addresses, runs of digit groups, handles, tokens."""
    found: list[tuple[int, int]] = []
    if "dot" in text.lower():
        found += [m.span() for m in _SPELT.finditer(text)]
    found += [m.span() for m in _RUN.finditer(text) if sum(c.isdigit() for c in m[0]) >= RUN_DIGITS]
    if "@" in text:
        found += [m.span() for m in _HANDLE.finditer(text)]
    found += _tokens(text)
    out: list[tuple[int, int]] = []
    held = sorted((a, b) for a, b, _ in taken)
    for a, b in found:
        k = bisect_left(held, (a, b))
        if (k == len(held) or held[k][0] >= b) and (not k or max(y for _, y in held[max(0, k - 4) : k]) <= a):
            out.append((a, b))
            insort(held, (a, b))
    return sorted(out)


#: What a text must hold to have spans or candidates.
HOLDS = "[0-9@]|(?i:dot)"
_HELD = re.compile(HOLDS)


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """Per row its base spans and its occurrences: ``doc_id, n_*, base, found`` with ``found`` an array of
    ``(start, end, base, seed, instance, patterns)``. ``instance`` is a hash of the surface string."""
    kinds = KINDS[:4]
    counts = [f"n_{k}" for k in kinds]
    item = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("seed", pa.bool_()), ("instance", pa.int64()), ("patterns", pa.list_(pa.string()))])
    schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in counts], ("base", pa.string()), ("found", pa.list_(item))])

    def run(batches):
        from xxhash import xxh64_intdigest

        def occurrences(text, places):
            return [{"start": a, "end": b, "base": base, "seed": base or is_key(text[a:b]), "instance": xxh64_intdigest(text[a:b].lower().encode()) - (1 << 63), "patterns": context(text, a, b)} for a, b, base in places]

        for b in batches:
            texts = b.column(1)
            hit = pa.compute.fill_null(pa.compute.match_substring_regex(texts, HOLDS), False)
            base, found, numbers = [""] * len(b), [[]] * len(b), [[0] * len(b) for _ in kinds]
            for i in pa.compute.indices_nonzero(hit).to_pylist():
                text = texts[i].as_py()
                spans = base_spans(text)
                base[i] = joined(spans)
                for k, row in zip(kinds, numbers):
                    row[i] = sum(x[2] == k for x in spans)
                found[i] = occurrences(text, [(x, y, True) for x, y, _ in spans] + [(x, y, False) for x, y in candidates(text, spans)])
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, pa.int64()) for x in numbers], pa.array(base), pa.array(found, pa.list_(item))], schema=schema)

    got = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return got.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in counts) + ", base string, found array<struct<start long, end long, base boolean, seed boolean, instance long, patterns array<string>>>")


def count_other_uses(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """``pattern, others``: how often each of ``patterns`` stands beside something else than an entity, over all texts of
    ``docs(doc_id, text)``, each distinct text once. Few patterns are broadcast; many are joined to the
    counts of all places. Only texts that repeat are counted by text, those of one row are added up by task."""
    few = patterns.count() <= BROADCAST_PATTERNS
    held = docs.sparkSession.sparkContext.broadcast(frozenset(r.pattern for r in patterns.select("pattern").collect())) if few else None

    schema = pa.schema([("whole", pa.int64()), ("pattern", pa.string()), ("n", pa.int64())])

    def run(batches):
        import ahocorasick

        wanted = wanted_keys(held.value) if few else None
        machine = ahocorasick.Automaton()  # tells texts without any of the patterns at once
        for p in held.value if few else ():
            machine.add_word(p[1:], 1)
        if len(machine):
            machine.make_automaton()
        total: dict[str, int] = {}

        def rows(got, whole):
            return pa.RecordBatch.from_arrays([pa.array([whole] * len(got), pa.int64()), pa.array(got.keys(), pa.string()), pa.array(got.values(), pa.int64())], schema=schema)

        for b in batches:
            for t, w in zip(b.column(0), b.column(1)):
                text = t.as_py()
                flat = _flat(text)
                if few and not (len(machine) and next(machine.iter(flat), None)):
                    continue
                contexts = []
                if _HELD.search(text):
                    spans = base_spans(text)
                    contexts = [context(text, x, y) for x, y in [*[z[:2] for z in spans], *candidates(text, spans)]]
                got = other_uses(flat, wanted, contexts)
                if w.is_valid:
                    yield rows(got, w.as_py())
                    continue
                for k, x in got.items():
                    total[k] = total.get(k, 0) + x
            if len(total) > 200_000:
                yield rows(total, None)
                total = {}
        yield rows(total, None)
        common.release_memory()

    texts = docs.where("text is not null").select("doc_id", "text", F.xxhash64("text").alias("whole"))
    twice = common.written(texts.groupBy("whole").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1"), "repeated")
    if twice.count() <= common.BROADCAST_IDS:
        texts = texts.join(F.broadcast(twice), "whole", "left").where("rows is null or first is null or doc_id = first")
        texts = texts.withColumn("whole", F.when(F.col("rows").isNotNull(), F.col("whole")))
    got = texts.select("text", "whole").mapInArrow(run, "whole long, pattern string, n long")
    if not few:
        got = got.join(patterns.select("pattern"), "pattern", "left_semi")
    got = common.written(got, "uses")
    once = got.where("whole is not null").dropDuplicates(["whole", "pattern"]).groupBy("pattern").agg(F.sum("n").alias("n"))
    rest = got.where("whole is null").groupBy("pattern").agg(F.sum("n").alias("n"))
    return once.unionByName(rest).groupBy("pattern").agg(F.sum("n").alias("others"))


def pattern_scores(links: DataFrame, docs: DataFrame, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """``pattern, score, seeds`` from distinct ``pattern, instance, seed``; only patterns with enough instances.

    A pattern's score is the trust in its instances over their number, its other uses in all of ``docs`` and one;
    ``seeds`` counts the trusted ones. A seed's trust is 1, any other instance's 1 - prod(1 - score) over its patterns
    with at least LEAST_SEEDS trusted instances and a score of ``confidence``; without such patterns it has none. Both sides are
    equi-joins on the graph's links.
    """
    base = common.written(links.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_SEEDS), "patterns")

    def weighed(patterns, others):
        """A pattern that would not pass with all its instances trusted never will: the rest goes without it."""
        got = patterns.join(others, "pattern", "left").withColumn("all", F.col("n") + F.coalesce("others", F.lit(0)) + 1)
        return got.where(F.col("n") / F.col("all") >= confidence).drop("others")

    # The other uses in texts that hold entities are a part of all: common words go at once.
    first = common.written(weighed(base, count_other_uses(docs.where(F.col("text").rlike(HOLDS)), base)), "patterns").drop("all")
    kept = common.written(weighed(first, count_other_uses(docs, first)).select("pattern", F.col("all").alias("n")), "patterns")
    graph = common.written(links.join(kept.select("pattern"), "pattern"), "graph")
    trust = common.written(graph.where("seed").select("instance", F.lit(1.0).alias("trust")).distinct(), "trust")
    scores, before = None, trust.count()
    for _ in range(rounds):
        summed = graph.join(trust, "instance").groupBy("pattern").agg(F.count(F.lit(1)).alias("seeds"), F.sum("trust").alias("held"))
        old, scores = scores, common.written(summed.join(kept, "pattern").select("pattern", "seeds", (F.col("held") / F.col("n")).alias("score")), "scores")
        good = scores.where((F.col("seeds") >= LEAST_SEEDS) & (F.col("score") >= confidence))
        doubt = F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9))))
        got = graph.join(good.select("pattern", "score"), "pattern").groupBy("instance").agg(F.when(F.max("seed"), 1.0).otherwise(1 - F.exp(doubt)).alias("trust"))
        seeds = graph.where("seed").select("instance", F.lit(1.0).alias("trust")).distinct()
        last, trust = trust, common.written(got.unionByName(seeds).groupBy("instance").agg(F.max("trust").alias("trust")), "trust")
        for table in (last, old):
            if table is not None:
                common.discard(table)
        if (now := trust.count()) == before:
            break
        before = now
    for table in (base, graph, trust):
        common.discard(table)
    return scores


def find(docs: DataFrame, id_col="doc_id", text_col="text", confidence: float = CONFIDENCE) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_key, n_unseen`` per row.

    The counts and the hash are of base spans; ``spans`` also has those of kind ``id``: ``n_key`` of them are generated
    keys, which the rule ``is_key`` had made seeds, ``n_unseen`` are identifiers that no rule names and patterns alone found. A null or empty text has no
    spans; very long texts are searched whole. Rows of one id or of one text are judged each for itself; the scores
    count distinct strings, and other uses once per distinct text. Spans that start at one place go by kind. Other columns
    play no part, whatever their names; an empty table gives an empty result.
    """
    rows = common.written(scan(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "scanned")
    each = rows.select("row", F.explode("found").alias("x")).select("row", "x.*")
    links = each.select("instance", "seed", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    links = common.written(links, "links")
    good = pattern_scores(links, texts, confidence).where((F.col("score") >= confidence) & (F.col("seeds") >= LEAST_SEEDS)).select("pattern")
    new = each.where("not base").select("row", "start", "end", "seed", F.explode("patterns").alias("pattern")).join(good, "pattern", "left_semi").drop("pattern").distinct()
    added = new.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("added"), F.count_if("seed").alias("n_key"), F.count_if(~F.col("seed")).alias("n_unseen"))
    out = rows.drop("found").join(added, "row", "left")
    # All spans by start, then kind: base spans never overlap added ones, so starts differ.
    old = F.when(F.col("base") == "", F.array().cast("array<string>")).otherwise(F.split("base", ","))
    part = lambda s: F.struct(F.split(s, ":")[1].cast("long").alias("start"), s.alias("s"))
    more = F.transform(F.coalesce("added", F.array().cast("array<struct<start:bigint,end:bigint>>")), lambda x: F.struct(x["start"].alias("start"), F.concat_ws(":", F.lit("id"), x["start"].cast("string"), x["end"].cast("string")).alias("s")))
    order = F.concat(F.transform(old, lambda s: part(s)), more)
    rank = lambda s: F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.split(s, ":")[0])
    ordered = F.array_sort(F.transform(order, lambda x: F.struct(x["start"].alias("start"), rank(x["s"]).alias("k"), x["s"].alias("s"))))
    spans = F.array_join(F.transform(ordered, lambda x: x["s"]), ",")
    return out.select("doc_id", *[f"n_{k}" for k in KINDS[:4]], F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), F.when(F.col("added").isNull(), F.col("base")).otherwise(spans).alias("spans"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_key", "n_unseen")])


def op7_pii(spark, sf_dir: str) -> DataFrame:
    """The contract's query over all of ``documents``."""
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))

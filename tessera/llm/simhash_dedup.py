"""Operator 9, SimHash near-duplicates: pigeonhole blocks, a join on blocks, a Hamming check.

A fingerprint is cut into ``m`` blocks. Two that differ in at most ``r`` bits agree on at least ``m - r``
whole blocks, so they meet under at least one of the C(m, m - r) keys made of that many blocks. Under a
key only distinct fingerprints meet (copies are aggregated first), and a key that many fingerprints
share is cut again in the same way over its remaining bits. Small groups are compared pairwise; in a
larger one a search over the not yet reached members emits a spanning set of links, never all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Distinct fingerprints of one key that are compared pairwise; those that one task searches; beyond, the key is cut again.
GROUP, LIMIT = 64, 16384
#: The near-dedup stage: words of a shingle, the least and most bits of a set's parity sketch, and the radius within which a
#: family is searched first. Sets of similarity 0.8 differ in 9.7 bits of their SimHash on average, with a deviation of 2.9.
SHINGLE, PARITY, RADIUS = 5, (128, 16384), 24
#: Documents of one anchor that are compared pairwise at once; of more, a spanning forest is looked for.
FEW = 4
#: Shingles of a family that one task holds (twice: tasks are pairs of parts); larger families are cut.
FAMILY = 2_000_000


def shingles(text: bytes, k: int = 3) -> list[int]:
    """The hashes of a text's ``k``-word shingles in order; of the whole text if it has no more words; none without words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return []
    n = len(words)
    line = b" ".join(words)
    if n <= k:
        return [xxh64_intdigest(line, 42)]
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1).tolist()
    starts = [0] + [e + 1 for e in ends[: n - k]]
    return [xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, ends[k - 1 :])]


def fingerprint(text: bytes, k: int = 3, distinct: bool = False) -> int:
    """The 64-bit SimHash of one text over its ``k``-word shingles, repeats included unless ``distinct``."""
    hashes = shingles(text, k)
    return simhash(np.array(list(set(hashes)) if distinct else hashes, np.uint64))


def simhash(h: np.ndarray) -> int:
    """The 64-bit SimHash of a text's hashed features; 0 for none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):  # bounded memory for very long texts
        part = h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, distinct: bool = False) -> DataFrame:
    """``(doc_id, fp)`` per row; ``fp`` holds the 64 bits as a signed long. A null text has no words: 0."""

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.large_binary())
            got = [fingerprint(x.as_py() or b"", k, distinct) for x in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(got, np.uint64).view(np.int64))], ["doc_id", "fp"])
        common.release_memory()

    pair = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return pair.mapInArrow(run, "doc_id long, fp long")


def block_masks(r: int, m: int, bits: int = 64, within: int = (1 << 64) - 1) -> list[int]:
    """The masks of the keys: every choice of ``m - r`` of ``m`` blocks of the bits set in ``within``."""
    at = [i for i in range(bits) if within >> i & 1]
    blocks = [sum(1 << i for i in part.tolist()) for part in np.array_split(np.array(at, dtype=object), m)]
    return [sum(c) for c in combinations(blocks, m - r)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def group_links(key_a: np.ndarray, fp: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
    """Links at ``r`` bits or fewer in sorted groups of at most GROUP fingerprints: vectorised, by offset."""
    a, b = [], []
    off = 1
    while off < len(fp):
        same = key_a[off:] == key_a[:-off]
        if not same.any():
            break
        i = np.nonzero(same)[0]
        close = np.bitwise_count(fp[i].view(np.uint64) ^ fp[i + off].view(np.uint64)) <= r
        a.append(fp[i[close]])
        b.append(fp[i[close] + off])
        off += 1
    empty = np.empty(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


def spanning_links(fp: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within a group of distinct fingerprints: fewer links than members.

    A breadth-first search; each member is compared with those not reached yet, so a dense group costs
    little more than its size. Each link is itself of ``r`` bits or fewer.
    """
    rest = fp.view(np.uint64)
    a, b = [], []
    while len(rest):
        queue, rest = [rest[:1]], rest[1:]
        while queue and len(rest):
            for x in queue.pop():
                close = np.bitwise_count(rest ^ x) <= r
                if close.any():
                    found = rest[close]
                    rest = rest[~close]
                    a.append(np.full(len(found), x))
                    b.append(found)
                    queue.append(found)
    empty = np.empty(0, np.uint64)
    a, b = (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)
    return a.view(np.int64), b.view(np.int64)


def _keyed(fps: DataFrame, masks: list[int]) -> DataFrame:
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(x))).alias("bits")) for i, x in enumerate(masks)])
    return fps.select("fp", *[c for c in fps.columns if c != "fp"], F.explode(keys).alias("k")).select("*", "k.t", "k.bits").drop("k")


def _sizes(keyed: DataFrame, by: list[str]) -> DataFrame:
    return keyed.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def _sorted_groups(batches):
    """Streams groups of a sorted partition: whole groups only, some thousand rows at a time."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t])
        t = t.combine_chunks()
        ts, bits = t["t"].to_numpy(), t["bits"].to_numpy()
        last = np.nonzero((ts != ts[-1]) | (bits != bits[-1]))[0]
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield t.slice(0, cut)
        rest = t.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


def links(fps: DataFrame, r: int = 2, m: int = 4) -> DataFrame:
    """``(a, b)``: links that connect just what "at most ``r`` bits apart" connects among distinct ``fp``.

    Every pair within ``r`` bits is connected by emitted links of which each is itself within ``r`` bits.
    """
    assert 0 < r < m
    masks = block_masks(r, m)
    n = common.partitions_for(fps.sparkSession)

    def compare(batches):
        for t in _sorted_groups(batches):
            ts, bits, fp = (t[c].to_numpy() for c in ("t", "bits", "fp"))
            at = np.r_[0, np.nonzero((ts[1:] != ts[:-1]) | (bits[1:] != bits[:-1]))[0] + 1, len(fp)]
            size = np.diff(at)
            few = np.repeat(size <= GROUP, size)
            got = [group_links(np.repeat(np.arange(len(size)), size)[few], fp[few], r)]
            got += [spanning_links(fp[at[i] : at[i + 1]], r) for i in np.nonzero(size > GROUP)[0].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in got])) for k in (0, 1)], ["a", "b"])
        common.release_memory()

    keyed = _keyed(fps.select("fp"), masks)
    sizes = common.written(_sizes(keyed, ["t", "bits"]), "blocks")
    dealt = lambda df: df.repartition(n, "t", "bits").sortWithinPartitions("t", "bits").mapInArrow(compare, "a long, b long")
    out = dealt(keyed.join(sizes.where(F.col("n") <= LIMIT).select("t", "bits"), ["t", "bits"]))
    big = sizes.where(F.col("n") > LIMIT).select("t", "bits")
    if big.isEmpty():
        return out.where("a <> b").distinct()
    # Keys of the second level: the outer blocks and m - r of m blocks of the remaining bits. For r = 2 and
    # m = 4 they leave 16 bits, so that a group has at most 65,536 members.
    subs = [block_masks(r, m, within=~x & (1 << 64) - 1) for x in masks]
    pick = [F.array(*[F.struct(F.lit(i * len(s) + j).alias("t"), F.lit(_signed(masks[i] | x)).alias("mask")) for j, x in enumerate(s)]) for i, s in enumerate(subs)]
    again = keyed.join(big, ["t", "bits"]).select("fp", F.explode(F.element_at(F.array(*pick), F.col("t") + 1)).alias("s"))
    again = dealt(again.select("fp", "s.t", F.col("fp").bitwiseAND(F.col("s.mask")).alias("bits")))
    return out.unionByName(again).where("a <> b").distinct()


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, r: int = 2, m: int = 4, distinct: bool = False) -> DataFrame:
    """``(doc_id, fp, component_id)`` per row of ``docs``.

    Rows with a null id get a fingerprint and a null component. Repeated ids stay repeated rows. Texts
    without words have fingerprint zero and link like any other. An empty table gives an empty result.
    Other columns of ``docs`` play no part, whatever their names.
    """
    fps = common.written(fingerprints(docs, id_col, text_col, k, distinct), "fingerprints")
    nodes = common.written(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct_fp")
    pairs = links(nodes, r, m)
    rep = pairs.join(nodes.select(F.col("fp").alias("a"), F.col("rep").alias("ra")), "a").join(nodes.select(F.col("fp").alias("b"), F.col("rep").alias("rb")), "b")
    comp = common.connected_components(rep.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    named = nodes.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    out = fps.join(named, "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def parities(flat: np.ndarray, row: np.ndarray, rows: int, width: int) -> np.ndarray:
    """Per row the parity of the number of its hashes in each of ``width`` buckets, as 64-bit words."""
    odd = np.bincount(row * width + (flat & np.uint64(width - 1)).astype(np.int64), minlength=rows * width) & 1
    return np.packbits(odd.astype(np.uint8).reshape(rows, width), axis=1).view(np.uint64)


def parity_bits(n: int) -> int:
    """Bits of the sketch of a set of ``n``: half of it at least, as unlike sets could not be told apart by fewer."""
    return min(max(PARITY[0], 1 << max(0, (n + 1) // 2 - 1).bit_length()), PARITY[1])


def alike(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can have a similarity of 0.8."""
    return 5 * np.minimum(n, m) >= 4 * np.maximum(n, m)


class Sketches:
    """Sizes and parity sketches of sets, and which pairs of them can have a similarity of 0.8.

    Sets of similarity 0.8 differ in at most (n + m) / 9 elements, and each of these changes the parity of one bucket. So a
    pair whose sketches differ in more is denied, and never wrongly. Sketches of alike sets are of one width or of one and
    its double, which folds to the half by exclusive or.
    """

    def __init__(self, n: np.ndarray, sketches: list[bytes]):
        self.n, self.place = n, np.zeros(len(n), np.int64)
        self.width = np.array([len(x) for x in sketches], np.int64)
        self.own, self.half = {}, {}
        for w in np.unique(self.width).tolist():
            at = np.nonzero(self.width == w)[0]
            self.place[at] = np.arange(len(at))
            m = self.own[w] = np.frombuffer(b"".join([sketches[i] for i in at.tolist()]), np.uint64).reshape(len(at), -1)
            self.half[w] = m[:, : w // 16] ^ m[:, w // 16 :]

    def possible(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For each pair of indices of ``x`` and ``y``."""
        ok = alike(self.n[x], self.n[y])
        i = np.nonzero(ok)[0]
        x, y = x[i], y[i]
        swap = self.width[x] > self.width[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        far, wx, wy = np.empty(len(i), np.int64), self.width[x], self.width[y]
        for w in np.unique(wx).tolist():
            for v, of in ((w, self.own), (2 * w, self.half)):
                k = np.nonzero((wx == w) & (wy == v))[0]
                if len(k):
                    far[k] = np.bitwise_count(self.own[w][self.place[x[k]]] ^ of[v][self.place[y[k]]]).sum(axis=1, dtype=np.int64)
        ok[i] = 9 * far <= self.n[x] + self.n[y]
        return ok

    def forest(self, start: int, end: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Pairs of indices from ``start`` to ``end``: a spanning forest of the possible ones."""
        a, b, rest = [], [], np.arange(start, end)
        while len(rest):
            queue, rest = [rest[:1]], rest[1:]
            while queue and len(rest):
                for x in queue.pop():
                    ok = self.possible(np.full(len(rest), x), rest)
                    if ok.any():
                        found, rest = rest[ok], rest[~ok]
                        a.append(np.full(len(found), x))
                        b.append(found)
                        queue.append(found)
        return a, b


def anchors(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """``(doc_id, n, whole, parity, bits)`` per row with an id: size, digest and parity sketch of the set of ``k``-word
    shingles, and its anchors, the smallest fifth of its hashes and one.

    Two sets of a similarity of 0.8 or more have an anchor in common: of a set of n hashes the partner
    has at least 0.8 n, so it can't miss all of the n - ceil(0.8 n) + 1 smallest.
    """

    def run(batches):
        from xxhash import xxh128_digest

        for b in batches:
            sizes, whole, odd, keys = [], [], [], []
            for x in b.column(1).cast(pa.large_binary()):
                h = np.unique(np.array(shingles(x.as_py() or b"", k), np.uint64))
                sizes.append(len(h))
                whole.append(xxh128_digest(h.tobytes()))
                odd.append(parities(h, np.zeros(len(h), np.int64), 1, parity_bits(len(h))).tobytes())
                keys.append((h[: len(h) - (4 * len(h) + 4) // 5 + 1] ^ np.uint64(1 << 63)).view(np.int64))  # in the same order when signed
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *keys])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(whole, pa.binary()), pa.array(odd, pa.binary()), keys], ["doc_id", "n", "whole", "parity", "bits"])
        common.release_memory()

    pair = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return pair.where("doc_id is not null").mapInArrow(run, "doc_id long, n long, whole binary, parity binary, bits array<long>")


def _in_parts(rows: DataFrame, size: str, limit: int) -> DataFrame:
    """``rows``, which hold the ``size`` of their group, with ``t``: groups of up to ``limit`` whole, larger ones cut into parts of which
    every two meet under one ``t``, so that a task holds at most some two parts, and every two rows of a group meet."""
    rows = rows.withColumn("_parts", F.ceil(F.col(size) / limit).cast("int")).withColumn("_o", F.pmod(F.xxhash64("doc_id"), "_parts").cast("int"))
    others = F.when(F.col("_parts") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("_parts") - 1), lambda z: z != F.col("_o")))
    rows = rows.withColumn("_z", F.explode(others))
    pair = F.least("_o", "_z").cast("long") * F.col("_parts") + F.greatest("_o", "_z")
    return rows.withColumn("t", pair).drop("_o", "_z", "_parts", size)


def _groups(t: pa.Table) -> np.ndarray:
    ts, bits = t["t"].to_numpy(), t["bits"].to_numpy()
    return np.r_[0, np.nonzero((ts[1:] != ts[:-1]) | (bits[1:] != bits[:-1]))[0] + 1, len(ts)]


def anchor_sets(nodes: DataFrame) -> DataFrame:
    """``(bits, size)``: of all anchors that just the same ``size`` rows share, two at least, the smallest.

    Near copies share a fifth of their shingles, but are one set of rows, and a further anchor of a set gives no further pair.
    A set is known by its size, its first and last row and an exclusive or of 64-bit hashes; only row numbers are moved.
    """
    keyed = nodes.select("row", F.explode("bits").alias("bits"))
    own = keyed.groupBy("bits").agg(F.count(F.lit(1)).alias("size"), F.min("row").alias("low"), F.max("row").alias("high"), F.bit_xor(F.xxhash64("row")).alias("rows"))
    return own.where("size > 1").groupBy("size", "low", "high", "rows").agg(F.min("bits").alias("bits")).select("bits", "size")


def near_pairs(nodes: DataFrame) -> DataFrame:
    """``(a, b)``: pairs of ids that share an anchor and can have a similarity of 0.8 (``Sketches``); they connect just what all such pairs connect.

    ``nodes`` are rows of ``anchors`` with a number of their own, ``row``. Sketches go only to one anchor of each set of rows (``anchor_sets``).
    An anchor of more than FEW documents gives a spanning forest of its pairs, so fewer pairs than members. One of more
    than LIMIT is cut into parts of which every two meet in a task.
    """
    parts = common.partitions_for(nodes.sparkSession)

    def compare(batches):
        for t in _sorted_groups(batches):
            ids, sizes, at = t["doc_id"].to_numpy(), t["n"].to_numpy(), _groups(t)
            sets = Sketches(sizes, t["parity"].to_pylist())
            size = np.diff(at)
            group = np.repeat(np.arange(len(size)), size)
            few = np.nonzero(size[group] <= FEW)[0]
            a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for off in range(1, min(FEW, len(few))):
                same = group[few[off:]] == group[few[:-off]]
                x, y = few[:-off][same], few[off:][same]
                ok = sets.possible(x, y)
                a.append(x[ok])
                b.append(y[ok])
            for i in np.nonzero(size > FEW)[0].tolist():
                x, y = sets.forest(at[i], at[i + 1])
                a += x
                b += y
            # Neighbours in a family share many anchors: what one batch finds twice goes once.
            x, y = ids[np.concatenate(a)], ids[np.concatenate(b)]
            pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1)[x != y], axis=0)
            for i in range(0, len(pairs), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[i : i + 100_000, c]) for c in (0, 1)], ["a", "b"])
        common.release_memory()

    sets = common.written(anchor_sets(nodes), "anchors")
    few = sets.count() <= common.BROADCAST_IDS
    members = common.written(nodes.select("row", F.explode("bits").alias("bits")).join(F.broadcast(sets) if few else sets, "bits"), "members")
    dealt = _in_parts(members.join(nodes.select("row", "doc_id", "n", "parity"), "row").drop("row"), "size", LIMIT)
    return dealt.repartition(parts, "bits", "t").sortWithinPartitions("bits", "t", "doc_id").mapInArrow(compare, "a long, b long").distinct()


def family_links(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs: links of a Jaccard similarity of 0.8 or more, exactly, which connect just what all such links connect.

    A breadth-first search compares each member with those within RADIUS bits that it has not reached. Then each member outside
    of the largest component is compared with the members of all other components that its parity sketch does not tell apart, at whatever bits.
    """
    n = np.array([len(s) for s in sets])
    start = np.r_[0, np.cumsum(n)]
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(n)), n)
    odd = parities(flat, row, len(n), 1 << max(6, int(n.max() - 1).bit_length()))
    fp = np.array([simhash(s) for s in sets], np.uint64)
    names, codes = np.unique(flat, return_inverse=True)
    mark = np.zeros(len(names), bool)
    comp = np.arange(len(n))
    a, b = [], []

    def similar(x: int, some: np.ndarray) -> np.ndarray:
        some = some[alike(n[some], n[x])]
        some = some[9 * np.bitwise_count(odd[some] ^ odd[x]).sum(axis=1, dtype=np.int64) <= n[some] + n[x]]
        own = codes[start[x] : start[x + 1]]
        mark[own] = True
        both = np.array([np.count_nonzero(mark[codes[start[y] : start[y + 1]]]) for y in some.tolist()], np.int64)
        mark[own] = False
        return some[9 * both >= 4 * (n[some] + n[x])]

    rest = np.arange(len(n))
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            found = similar(x, rest[np.bitwise_count(fp[rest] ^ fp[x]) <= RADIUS])
            if len(found):
                rest = np.setdiff1d(rest, found, assume_unique=True)
                comp[found] = comp[x]
                a += [x] * len(found)
                b += found.tolist()
                queue += found.tolist()
    for x in np.nonzero(comp != np.bincount(comp).argmax())[0].tolist():
        for y in similar(x, np.nonzero(comp != comp[x])[0]).tolist():
            if comp[y] != comp[x]:
                comp[comp == comp[y]] = comp[x]
                a.append(x)
                b.append(y)
    return np.array(a, np.int64), np.array(b, np.int64)


def similar_pairs(docs: DataFrame, families: DataFrame, nodes: DataFrame, k: int = SHINGLE) -> DataFrame:
    """``(a, b)``: links of ids whose sets of ``k``-word shingles have a Jaccard similarity of 0.8 or more, exactly: of each of the
    ``families(node, component)`` as many as connect what all of them do. Texts are moved once for each pair of a family's parts."""
    parts = common.partitions_for(docs.sparkSession)

    def search(batches):
        for t in _sorted_groups(batches):
            ids, at, a, b = t["doc_id"].to_numpy(), _groups(t).tolist(), [], []
            for i, j in zip(at[:-1], at[1:]):
                sets = [np.unique(np.array(shingles(x.as_py() or b"", k), np.uint64)) for x in t["text"].slice(i, j - i).cast(pa.large_binary())]
                x, y = family_links(sets)
                a.append(ids[i:j][x])
                b.append(ids[i:j][y])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in (a, b)], ["a", "b"])
        common.release_memory()

    own = nodes.groupBy("doc_id").agg(F.sum("n").alias("n"))
    own = common.written(own.join(families.select(F.col("node").alias("doc_id"), F.col("component").alias("bits")), "doc_id"), "family_sizes")
    own = own.join(own.groupBy("bits").agg(F.sum("n").alias("_n")), "bits")
    members = common.written(_in_parts(own, "_n", FAMILY).select(F.col("doc_id").alias("_id"), "bits", "t"), "families")
    if members.count() <= common.BROADCAST_IDS:
        members = F.broadcast(members)
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(members, F.col("doc_id") == F.col("_id")).drop("_id")
    return some.repartition(parts, "bits", "t").sortWithinPartitions("bits", "t").mapInArrow(search, "a long, b long").where("a <> b").distinct()


def without_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near copies, that of the smallest id.

    Near copies have a Jaccard similarity of 0.8 or more between their sets of five-word shingles. Families of documents that
    share anchors and that no bound tells apart are searched by SimHash and closed exactly, so no link is lost, and only
    verified links make groups. Rows that repeat an id are taken for copies: of each such id one row stays. Rows with a null id stay.
    """
    rows = common.written(anchors(docs).withColumn("row", F.monotonically_increasing_id()), "anchored")
    first = rows.groupBy("whole").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    copies = common.written(rows.select("doc_id", "whole", "row").join(first, "whole").where("doc_id <> rep").select("doc_id", "rep", "row"), "copies")
    nodes = common.filter_by_ids(rows, copies.select("row"), "row", "left_anti")
    families = common.connected_components(near_pairs(nodes))
    edges = similar_pairs(docs, families, nodes)
    edges = edges.unionByName(copies.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    comp = common.connected_components(edges)
    gone = comp.where("component < node").select(F.col("node").alias("doc_id"))
    kept = common.filter_by_ids(docs, gone, "doc_id", "left_anti")
    twice = rows.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.isEmpty():
        return kept
    row = F.struct(*[kept[c] for c in kept.columns])
    single = common.filter_by_ids(kept, twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(row).alias("row")).select("row.*")
    return common.filter_by_ids(kept, twice, "doc_id", "left_anti").unionByName(single)


def op9_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's query: 3-word shingles, links at two bits or fewer."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = components(docs)
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

"""Exact Jaccard join of shingle sets by universe partition and the pigeonhole principle.

Sets. A document's set holds its distinct shingles of k words (words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased; with fewer words the
whole sequence; without words it is empty and linked with nothing), as 64-bit hashes. Two sets link when
den * |intersection| >= num * |union|, which is when they differ in at most H = (a + b)(den - num) div (den + num) elements.
Callers choose k, num and den; SHINGLE, NUM and DEN are those of op4_jaccard_join. Equal sets share one 64-bit name.

Signatures. Sizes are cut into tiers (the larger size of a pair decides), and the hash universe of each tier into segments. In a
tier for small sets a segment is indexed with its one-deletion neighbourhood: (H + 1) / 2 segments are enough, as one of them
differs in one element at most. For larger sets deletions would cost a row per element, so H + 1 exact segments are indexed;
empty segments, which many sets share, are passed over where spare segments leave more filled ones than elements that differ (a
set with too many empty segments emits them all: two such sets still meet, and with any other set the filled segments of that
one are enough). A set emits only as many segments as its largest possible partner asks for.

Allocation by cost. Spare segments mean that linked sets share several. Once the buckets are counted, each set passes over as many of
its signatures in a tier as that leaves free, the most crowded first: with e empty segments passed over, (2 spare - e) div 2, so
that two linked sets lose no more than 2 spare of the 2 spare + 1 they share. What only a common passage brings together goes
mostly here. With deletions or exact segments the choice is by size, as a deletion costs a row per element.

Buckets. Sets that share a signature are compared pair by pair in buckets of at most PAIRS sets, so pairs grow with the rows. In
a larger bucket (near copies, most of which do not link with each other) each set is held against a core C, the elements that most of
REFERENCES sampled sets have. With D = set xor C, a pair differs in |Dx| + |Dy| - 2 |Dx and Dy| elements. Either that is at most H
whatever the overlap, and then both link with the set of least (den + num) |D| - (den - num) |set|, so a star holds all such
pairs; or the D's share at least (|Dx| + |Dy| - H) / 2 elements, and then, in one order, the first H / 2 + 1 of the smaller D and the
first H + 1 of the larger have one in common (C's own elements last, as the others are rarer). These prefixes are the next
signatures, each set's shorter prefix being held against the longer ones, and so on until no bucket that holds several components
is large (has many shorter prefixes in it); what counts as large grows with every level, so few levels are needed and the last always ends.
C only decides how much is compared, never what links.

Candidates pass parity sketches (256 bits in the rows themselves, then 2 bits an element at least, folded to one length: sets differ in
no fewer elements than the sketches do in bits) and are then verified on whole sets, which are built again from the texts of the candidates only.
Components are found by spreading the least label over links.

No step holds a bucket in memory: sizes come from windows, which spill, hubs and references are aggregates, and pairs come from joins
that Spark can split. Which hub a bucket goes to is free, as pairs are only made within a bucket's group; so a hub's buckets follow it
to the heaviest hub that it meets, and most sets have one row of prefixes. A group that its star holds whole has none.

Edge cases: null text is an empty set; repeated rows and equal texts share one set; rows of one doc_id with different texts are
sets of their own; rows without doc_id get the smallest doc_id of their component, or null. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if, forget, mix, written

SHINGLE, NUM, DEN = 4, 85, 100
SMALL, GROWTH = 24, 2**0.5  # sizes up to SMALL use deletions; above, tiers grow by GROWTH
SPARE, TIER_BITS = 2, 6
PAIRS, STEP, REFERENCES = 8, 8, 7  # sets in a bucket that is compared pair by pair, growing by STEP a level; sets that vote on a larger one's core
BROADCAST_IDS = 200_000
SETS = "doc_id long, n long, h long, key long, sketch binary, parity array<long>, sigs array<long>, free array<long>"
_SLICE = 1 << 19  # bytes of text that are hashed at a time

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if not _powers or len(_powers[-1][0]) < n:
        size = max(n, _SLICE + 1)
        ones = lambda b: np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64))))
        _powers[:] = [(ones(_BASE), ones(_INVERSE))]
    return _powers[-1]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; text i is data[offsets[i]:offsets[i + 1]] (UTF-8 bytes)."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    data, offsets = data[lo:hi], offsets - lo
    n_docs = len(offsets) - 1
    if not len(data):
        return [np.zeros(0, np.uint64)] * n_docs
    word = ~_BLANK[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True  # a text's end also ends its last word
    starts = np.flatnonzero(word & (first[:-1] | np.concatenate(([True], ~word[:-1]))))
    first[offsets[1:]] = True
    ends = np.flatnonzero(word & (first[1:] | np.concatenate((~word[1:], [True])))) + 1
    if not len(starts):
        return [np.zeros(0, np.uint64)] * n_docs
    up, down = _power(len(data) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[_FOLD[data]] * up[: len(data)], dtype=np.uint64)))
    h = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _PLACE[63])
    at = np.searchsorted(starts, offsets)
    grams = h * _PLACE[0]
    if len(h) >= k:
        grams = mix(sum((h[i : len(h) - k + 1 + i] * _PLACE[i] for i in range(k)), np.zeros(len(h) - k + 1, np.uint64)))
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            short = np.array([np.uint64(b - a)]) * _PLACE[62]
            out.append(mix(short + (h[a:b] * _PLACE[20 : 20 + b - a]).sum(dtype=np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def most_apart(a: int, b: int, num: int = NUM, den: int = DEN) -> int:
    """The largest symmetric difference of linked sets of these sizes."""
    return (a + b) * (den - num) // (den + num)


class Signatures:
    """The tiers and what a set emits in each."""

    def __init__(self, num: int = NUM, den: int = DEN):
        self.num, self.den = num, den
        low = 1
        while most_apart(low + 1, low + 1, num, den) == 0:
            low += 1
        self.edges = [low]  # pairs up to this size differ in nothing: they are one set

    def _grow(self, n: int) -> None:
        while self.edges[-1] < n:
            top = self.edges[-1]
            self.edges.append(max(top + 1, min(2 * top, SMALL) if top < SMALL else int(top * GROWTH)))

    def of(self, s: np.ndarray) -> np.ndarray:
        """The set's signatures; the low TIER_BITS of each are its tier."""
        return self.with_allowance(s)[0]

    def with_allowance(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The signatures, and for each tier how many of them may be passed over without losing a pair (tier << 16 | number)."""
        n = len(s)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        partner = n * self.den // self.num
        self._grow(partner)
        own = mix(s ^ _PLACE[60])
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(own, dtype=np.uint64)))
        out, free = [], []
        for tier in range(1, len(self.edges)):
            low, top = self.edges[tier - 1], self.edges[tier]
            if partner <= low or n > top:
                continue
            seed = np.uint64(tier * int(_PLACE[61]) % 2**64)
            h = most_apart(top, top, self.num, self.den)
            if top <= SMALL:
                m = (h + 2) // 2
                cut = self._cut(s, m)
                sums = total[cut[1:]] - total[cut[:-1]]
                segment = np.repeat(np.arange(m, dtype=np.uint64), np.diff(cut))
                out.append(self._tagged(sums + seed + np.arange(m, dtype=np.uint64) * _PLACE[59], tier))
                out.append(self._tagged(np.repeat(sums, np.diff(cut)) - own + seed + segment * _PLACE[59], tier))
                continue
            spare = SPARE + -(-h * 35 // 1000)
            m = h + 1 + 2 * spare
            used = most_apart(n, min(top, partner), self.num, self.den) + 1 + 2 * spare
            cut = self._cut(s, m)[: used + 1]
            keep = np.ones(len(cut) - 1, bool)
            empty = np.flatnonzero(np.diff(cut) == 0)
            if len(empty) <= 2 * spare:  # more filled segments than elements that differ, so one of them is shared
                keep[empty] = False
                free.append(tier << 16 | (2 * spare - len(empty)) // 2)
            sums = total[cut[1:]] - total[cut[:-1]] + seed + np.arange(len(keep), dtype=np.uint64) * _PLACE[59]
            out.append(self._tagged(sums[keep], tier))
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64), np.array(free, np.int64)

    @staticmethod
    def _tagged(sums: np.ndarray, tier: int) -> np.ndarray:
        return mix(sums) & ~np.uint64((1 << TIER_BITS) - 1) | np.uint64(tier)

    @staticmethod
    def _cut(s: np.ndarray, m: int) -> np.ndarray:
        """Where the m equal parts of the hash universe begin and end in the sorted set."""
        segment = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        return np.searchsorted(segment, np.arange(m + 1, dtype=np.uint64))


def _texts(column: pa.Array, k: int) -> Iterator[list[np.ndarray]]:
    """Shingle sets of a string column, some bytes at a time, read from Arrow's own buffers."""
    column = column.fill_null("")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _SLICE, side="right")) - 1)
        j = min(j, len(column))
        yield shingle_sets(raw, offsets[i : j + 1], k)
        i = j


def _name(s: np.ndarray) -> int:
    """A set's 64-bit name, of its elements and its size."""
    return int(mix(mix(s ^ _PLACE[58]).sum(dtype=np.uint64, keepdims=True) + np.array([len(s)], np.uint64) * _PLACE[57]).view(np.int64)[0]) if len(s) else 0


def sketch(s: np.ndarray) -> bytes:
    """Parities of the elements by the low bits of their hashes, in a power of two of bits (64 and 2 per element at least)."""
    if not len(s):
        return b""
    bits = max(64, 1 << (2 * len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1 == 1, bitorder="little").tobytes()


def parity(s: np.ndarray) -> np.ndarray:
    """The same in 256 bits, whatever the size: rows of candidates carry it, so that most pairs are ruled out as they are made."""
    return np.packbits(np.bincount((s & np.uint64(255)).astype(np.int64), minlength=256) & 1 == 1, bitorder="little").view(np.int64)


def sketches_apart(a: bytes, b: bytes) -> int:
    """A lower bound of the elements in which two sets differ. Halves laid on each other give the sketch of half the length."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64)))


def _sign(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """A set that this task has had before is not signed again: copies cost no rows."""
    signatures, seen = Signatures(num, den), set()
    for batch in batches:
        row = 0
        for sets in _texts(batch.column(1), k):
            names, made, sketches, parities = [_name(s) for s in sets], [], [], []
            for s, h in zip(sets, names, strict=True):
                fresh = len(s) and h not in seen
                seen.add(h)
                made.append(signatures.with_allowance(s) if fresh else (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
                sketches.append(sketch(s) if fresh else None)
                parities.append(parity(s) if fresh else None)
            ids, keys = batch.column(0).slice(row, len(sets)), batch.column(2).slice(row, len(sets))
            columns = [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.int64()), keys, pa.array(sketches, pa.binary()), pa.array(parities, pa.list_(pa.int64())), _lists([a.view(np.int64) for a, _ in made]), _lists([b for _, b in made])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "h", "key", "sketch", "parity", "sigs", "free"])
            row += len(sets)


def _whole_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for sets in _texts(batch.column(0), k):
            yield pa.RecordBatch.from_arrays([pa.array([_name(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["h", "elements"])


def _near(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches do not rule them out."""
    for batch in batches:
        keep = [sketches_apart(a, b) <= most_apart(n, m, num, den) for a, b, n, m in zip(*(batch.column(c).to_pylist() for c in ("s1", "s2", "n1", "n2")), strict=True)]
        yield batch.select(["h1", "h2"]).filter(pa.array(keep, pa.bool_()))


def _set(x) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), np.uint64)


def _inside(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which elements of the sorted set x the sorted set y has."""
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x if len(y) else np.zeros(len(x), bool)


def _compare(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
            x, y = _set(a), _set(b)
            both = int(np.count_nonzero(_inside(x, y)))
            keep.append(den * both >= num * (len(x) + len(y) - both))
        yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _core(pdf: pd.DataFrame) -> pd.DataFrame:
    """The elements that most of a hub's reference sets (REFERENCES rows at most) have."""
    found, n = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["elements"]]), return_counts=True)
    return pd.DataFrame({"hub": pdf["hub"].iloc[:1], "core": [found[2 * n > len(pdf)].tobytes()]})


def _prefixes(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Each set's rank for the star of its hub, and the first elements of what it and the core do not share."""
    for batch in batches:
        rank, first, out = [], [], []
        for hub, a, b in zip(batch.column("hub").to_pylist(), batch.column("elements"), batch.column("core"), strict=True):
            x, core, seed = _set(a), _set(b), mix(np.array([hub], np.int64).view(np.uint64))
            more, less = mix(x[~_inside(x, core)] ^ seed), mix(core[~_inside(core, x)] ^ seed)
            apart, n = np.concatenate((np.sort(more), np.sort(less))), len(x)
            rank.append((den + num) * len(apart) - (den - num) * n)
            most = most_apart(n, n * den // num, num, den)
            out.append(apart[: most + 1].view(np.int64))
            first.append(len(apart) - max(1, len(apart) - most // 2) + 1)
        yield pa.RecordBatch.from_arrays([batch.column("hub"), batch.column("h"), pa.array(rank, pa.int64()), pa.array(first, pa.int64()), _lists(out)], ["hub", "h", "rank", "first", "sigs"])


def components(links: DataFrame) -> tuple[DataFrame, str]:
    """(node, label): the least node of each component of links (u, v), by spreading labels over links and following them."""
    spark = links.sparkSession
    edges, edges_at = written(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct(), "graph-edges")
    labels, at = written(edges.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label")), "graph-labels")
    while True:
        near = edges.join(labels.withColumnsRenamed({"node": "v", "label": "l"}), "v").groupBy("u").agg(F.min("l").alias("l"))
        spread = labels.join(near.withColumnRenamed("u", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "l").alias("label"))
        spread, spread_at = written(spread, "graph-spread")
        jump = spread.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        new, new_at = written(spread.join(jump, "label").select("node", "old", F.least("label", "beyond").alias("label")), "graph-labels")
        moved = new.where("old <> label").limit(1).count()
        forget(spark, at, spread_at)
        labels, at = new.select("node", "label"), new_at
        if not moved:
            forget(spark, edges_at)
            return labels, at


def _apart(buckets: DataFrame) -> tuple[DataFrame, str]:
    """The rows (sig, h, short, c) of buckets that hold several components c, with the number k of short prefixes in the bucket. A window, so
    that the rows are made and shuffled once."""
    bucket = Window.partitionBy("sig")
    told = buckets.withColumns({"c0": F.min("c").over(bucket), "c1": F.max("c").over(bucket), "k": F.count_if("short").over(bucket)})
    return written(told.where("c0 <> c1 and k > 0").select("sig", "h", "short", "c", "k"), "sets-apart")


def _pairs(apart: DataFrame, nodes: DataFrame, most: int, num: int, den: int) -> DataFrame:
    """Pairs within the small buckets: of different components, and of sizes and parities that can link."""
    few = apart.where(F.col("k") <= most).join(nodes.select("h", "n", "parity"), "h")
    # Both sides are the same but for names, so that Spark shuffles them once.
    side = lambda i: few.select(F.col("parity").alias(f"p{i}"), "sig", F.col("h").alias(f"h{i}"), F.col("n").alias(f"n{i}"), F.col("c").alias(f"c{i}"), F.col("short").alias(f"short{i}"))
    fits = f"short1 and (h1 < h2 or not short2) and h1 <> h2 and c1 <> c2 and {den} * least(n1, n2) >= {num} * greatest(n1, n2)"
    fits += " and " + " + ".join(f"bit_count(p1[{i}] ^ p2[{i}])" for i in range(4)) + f" <= (n1 + n2) * {den - num} div {den + num}"
    return side(1).join(side(2), "sig").where(fits).select(F.least("h1", "h2").alias("h1"), F.greatest("h1", "h2").alias("h2")).distinct()


def _groups(apart: DataFrame, most: int) -> DataFrame:
    """hub, h: the large buckets by their hubs, the sets that are in most of them. Where a hub is in buckets of a heavier one, all of its
    own go there too: a set whose buckets have several hubs would else have prefixes for each."""
    large = apart.where(F.col("k") > most).select("sig", "h")
    weight = large.groupBy("h").agg(F.count("*").alias("w"))
    hubs = large.join(weight, "h").groupBy("sig").agg(F.max(F.struct("w", "h")).alias("m"))
    placed = large.join(hubs, "sig").groupBy("m", "h").agg(F.lit(1).alias("one")).select("m", "h")
    above = placed.groupBy("h").agg(F.max("m").alias("top")).select(F.col("h").alias("hub"), F.col("top.h").alias("top"))
    return placed.select(F.col("m.h").alias("hub"), "h").join(above, "hub").select(F.col("top").alias("hub"), "h").distinct()


class _Join:
    """The sets of one table, and what is asked of them."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, k: int, num: int, den: int):
        self.docs, self.nodes, self.k, self.num, self.den = docs, nodes, k, num, den
        self.sets: DataFrame | None = None
        self.used: list[str] = []

    def keep(self, df: DataFrame, tag: str) -> DataFrame:
        df, at = written(df, tag)
        self.used.append(at)
        return df

    def near(self, pairs: DataFrame) -> DataFrame:
        """The pairs (h1, h2) that the sketches leave."""
        side = lambda i: self.nodes.select(F.col("h").alias(f"h{i}"), F.col("n").alias(f"n{i}"), F.col("sketch").alias(f"s{i}"))
        both = pairs.join(side(1), "h1").join(side(2), "h2").select("h1", "h2", "n1", "n2", "s1", "s2")
        return self.keep(both.mapInArrow(partial(_near, num=self.num, den=self.den), "h1 long, h2 long"), "sets-near")

    def fetch(self, names: DataFrame) -> None:
        """Whole sets of the names (h), built from one text of each."""
        ids, ids_at = written(self.nodes.join(names.distinct(), "h", "left_semi").select(F.col("doc_id").alias("__id"), F.col("h").alias("__h")), "sets-ids")
        few = broadcast_if(ids.select("__id").distinct(), ids.count(), BROADCAST_IDS)
        texts = self.docs.join(few, self.docs["doc_id"].eqNullSafe(few["__id"]), "left_semi").select("text")
        made = texts.mapInArrow(partial(_whole_sets, k=self.k), "h long, elements binary").join(ids.select(F.col("__h").alias("h")), "h", "left_semi")
        self.sets = self.keep(made.groupBy("h").agg(F.min("elements").alias("elements")), "sets-whole")
        forget(self.docs.sparkSession, ids_at)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The linked ones (u, v) of pairs (h1, h2)."""
        side = lambda i, x: self.sets.select(F.col("h").alias(f"h{i}"), F.col("elements").alias(x))
        both = pairs.join(side(1, "a"), "h1").join(side(2, "b"), "h2").select(F.col("h1").alias("u"), F.col("h2").alias("v"), "a", "b")
        return self.keep(both.mapInArrow(partial(_compare, num=self.num, den=self.den), "u long, v long"), "sets-links")

    def centred(self, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Star links (u, v) of each group, and the prefixes (h, first, sigs) of sets in groups that a star does not hold whole."""
        lots = groups.groupBy("hub").agg(*[F.min(F.struct(F.xxhash64("h", F.lit(i)), "h")).alias(f"m{i}") for i in range(REFERENCES)])
        references = lots.select("hub", F.explode(F.array_distinct(F.array(*[F.col(f"m{i}.h") for i in range(REFERENCES)]))).alias("h"))
        core = self.keep(references.join(self.sets, "h").select("hub", "elements").groupBy("hub").applyInPandas(_core, "hub long, core binary"), "sets-core")
        placed = groups.join(self.sets, "h").join(core, "hub").select("hub", "h", "elements", "core")
        placed = self.keep(placed.mapInArrow(partial(_prefixes, num=self.num, den=self.den), "hub long, h long, rank long, first long, sigs array<long>"), "sets-centred")
        star = placed.groupBy("hub").agg(F.min(F.struct("rank", "h")).alias("m"), F.max("rank").alias("most")).select("hub", F.col("m.rank").alias("least"), F.col("m.h").alias("v"), "most")
        stars = self.keep(placed.select("hub", "rank", "h").join(star, "hub").where("rank + least <= 0 and h <> v").select(F.col("h").alias("u"), "v").distinct(), "sets-links")
        return stars, placed.join(star.where("most + least > 0"), "hub", "left_semi").select("h", "first", "sigs")


def _prefix_buckets(placed: DataFrame, labels: DataFrame) -> DataFrame:
    """The buckets (sig, h, short, c) that the prefixes of sets make. Components are looked up before the prefixes become rows."""
    named = placed.join(labels.withColumnRenamed("node", "h"), "h", "left").withColumn("c", F.coalesce("label", "h"))
    return named.select("h", "c", "first", F.posexplode("sigs").alias("at", "sig")).select("sig", "h", (F.col("at") < F.col("first")).alias("short"), "c")


def _classes(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, key (a hash of the text), n, h, label (the component, null: linked with nothing else) and component_id of every row of docs."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed, _ = written(docs.withColumn("key", F.xxhash64("text")).mapInArrow(partial(_sign, k=k, num=num, den=den), SETS), "sets")
    some = signed.where("n > 0")
    nodes, nodes_at = written(some.groupBy("h").agg(F.max("n").alias("n"), F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.max("doc_id").alias("last"), F.min("sketch").alias("sketch"), F.min("parity").alias("parity")), "sets-nodes")
    join = _Join(docs, nodes, k, num, den)

    rows = some.select("h", F.explode("sigs").alias("sig"))
    bucket = Window.partitionBy("sig")
    met = rows.withColumns({"h0": F.min("h").over(bucket), "h1": F.max("h").over(bucket), "met": F.count("*").over(bucket)}).where("h0 <> h1")
    shared = met.select("sig", "h", "met").distinct().withColumn("tier", F.col("sig").bitwiseAND((1 << TIER_BITS) - 1))
    free = some.select("h", F.explode("free").alias("f")).distinct().select("h", F.shiftright("f", 16).alias("tier"), F.col("f").bitwiseAND(0xFFFF).alias("free"))
    crowded = Window.partitionBy("h", "tier").orderBy(F.desc("met"), "sig")  # a set's signatures of one tier
    taken = shared.join(free, ["h", "tier"], "left").withColumn("r", F.row_number().over(crowded)).where(F.col("r") > F.coalesce("free", F.lit(0)))
    buckets = taken.select("sig", "h", F.lit(True).alias("short"), F.col("h").alias("c"))
    labels, labels_at, links, most = None, None, None, PAIRS
    while True:
        apart, at = _apart(buckets)
        join.used.append(at)
        pairs, groups = join.near(_pairs(apart, nodes, most, num, den)), join.keep(_groups(apart, most), "sets-groups")
        if labels is None:  # later levels hold no other sets than these
            join.fetch(pairs.select(F.col("h1").alias("h")).unionByName(pairs.select(F.col("h2").alias("h"))).unionByName(groups.select("h")))
        found = join.verified(pairs)
        large = groups.limit(1).count()
        if large:
            stars, placed = join.centred(groups)
            found = found.unionByName(stars)
        links = found if links is None else links.unionByName(found)
        if labels_at:
            forget(spark, labels_at)
        labels, labels_at = components(links)
        if not large:
            break
        buckets = _prefix_buckets(placed, labels)
        most *= STEP

    # Only sets with copies or links need their component looked up.
    named = nodes.join(labels.withColumnRenamed("node", "h"), "h", "left").withColumn("label", F.coalesce("label", "h"))
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    known = named.join(least, "label").where("label <> h or copies > 1 or component_id <> doc_id or last <> doc_id").select("h", "label", "component_id")
    known, _ = written(known, "sets-components")
    forget(spark, labels_at, nodes_at, *join.used)
    out = signed.select("doc_id", "key", "n", "h").join(known, "h", "left")
    return out.withColumn("label", F.when(F.col("n") > 0, F.coalesce("label", "h"))).withColumn("component_id", F.coalesce("component_id", "doc_id"))


def similarity_classes(docs: DataFrame, k: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links lead to) of every row of docs (doc_id, text)."""
    return _classes(docs, k, num, den).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, k: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id (of its different texts there, one; rows without a doc_id come
    last). Of rows that repeat a doc_id and its text one stays. Texts without words are linked with nothing and stay."""
    found = _classes(docs, k, num, den).select("doc_id", "key", "label")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    several = found.where("label is not null").groupBy("label").agg(F.min(order).alias("first"), F.count("*").alias("k")).where("k > 1").select("label", "first")
    rows = found.join(several, "label", "left").groupBy("doc_id", "key").agg(F.count("*").alias("n"), F.first("label").alias("label"), F.first("first").alias("first"))
    gone = F.col("first").isNotNull() & ~(F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & F.col("first.key").eqNullSafe(F.col("key")))
    again = (F.col("n") > 1) & (F.col("doc_id").isNotNull() | F.col("label").isNotNull())
    marked, _ = written(rows.where(gone | again).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), gone.alias("__gone")), "sets-marked")
    marked = broadcast_if(marked, marked.count(), BROADCAST_IDS)
    seen = docs.join(marked, docs["doc_id"].cast("long").eqNullSafe(marked["__id"]) & (F.xxhash64(docs["text"]) == marked["__key"]), "left")
    once = seen.where("__gone is null").select(*[docs[c] for c in docs.columns])
    repeated = seen.where("not __gone").dropDuplicates(["__id", "__key"]).select(*[docs[c] for c in docs.columns])
    return once.unionByName(repeated)


def op4_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similarity_classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

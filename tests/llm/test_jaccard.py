import itertools
import random
import re

import numpy as np

import corpus_pipeline
from fieldtopo.llm import jaccard as j

from .helpers import empty, frame


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())


def plain(rows):
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            parent[find(b)] = find(a)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[k][0] for k in range(len(rows)) if find(k) == find(i) and rows[k][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=repr)


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    for _ in range(n):
        base = rng.choices(vocabulary, k=rng.choice([2, 3, 5, 8, 12, 17, 30, 60, 150]))
        rows.append((i := i + 1, " ".join(base)))
        for _ in range(rng.randrange(4)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, max(1, len(base) // 40)])):
                what = rng.randrange(3)
                at = rng.randrange(len(copy) + 1)
                if what == 0:
                    copy.insert(at, rng.choice(vocabulary))
                elif copy and what == 1:
                    copy.pop(min(at, len(copy) - 1))
                elif copy:
                    copy[min(at, len(copy) - 1)] = rng.choice(vocabulary)
            rows.append((i := i + 1, " ".join(copy)))
    rng.shuffle(rows)
    return rows


def answer(df):
    return sorted(map(tuple, j.similarity_classes(df).collect()), key=repr)


def test_equals_brute_force(spark):
    rows = corpus(1)
    assert answer(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)


def test_chains_of_near_copies(spark):
    """Neighbours in the chain link, its ends do not; some share a bucket with none of the hubs."""
    words = [f"c{i}" for i in range(90)]
    rows = []
    for i in range(25):
        rows.append((100 - i, " ".join(words)))
        words[(i * 37) % 90] = f"n{i}"
    rows += [(500 + i, " ".join(f"q{i}x{k}" for k in range(40))) for i in range(20)]
    assert answer(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)


def test_awkward_rows(spark):
    df = frame(spark)
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert answer(df) == plain(rows)
    assert j.similarity_classes(empty(spark)).count() == 0


def test_keep_one(spark):
    text = " ".join(f"t{i}" for i in range(50))
    df = frame(spark, [(3, text), (2, text), (2, text), (9, "alone in the world of words"), (4, None), (5, "")])
    assert sorted(r.doc_id for r in j.keep_one(df).collect()) == [2, 4, 5, 9]


def test_signatures_meet_for_every_linked_pair():
    """The pigeonhole argument, tried on random pairs at the very threshold."""
    rng, s = np.random.default_rng(5), j.Signatures()
    for n in [6, 7, 9, 12, 13, 20, 24, 25, 30, 33, 46, 47, 66, 100, 131, 400, 1000]:
        for _ in range(30):
            common = rng.integers(0, 2**64, n, dtype=np.uint64)
            for extra in range(j.most_apart(n, n) + 1):
                a_more = int(rng.integers(0, extra + 1))
                a = np.unique(np.concatenate((common, rng.integers(0, 2**64, a_more, dtype=np.uint64))))
                b = np.unique(np.concatenate((common, rng.integers(0, 2**64, extra - a_more, dtype=np.uint64))))
                if len(a) != len(b) and 0 < extra and 100 * n < 85 * (n + extra):
                    continue
                if 100 * n >= 85 * (n + extra):
                    assert extra == 0 or len(np.intersect1d(s.of(a), s.of(b))), (n, extra)


def test_spread_empty_segments_do_not_hide_a_pair():
    """Sets whose elements fill one part of the universe share most empty segments."""
    rng, s = np.random.default_rng(6), j.Signatures()
    for n in [30, 60, 200]:
        common = rng.integers(0, 2**60, n, dtype=np.uint64)
        a = np.unique(np.concatenate((common, rng.integers(0, 2**60, 1, dtype=np.uint64))))
        assert len(np.intersect1d(s.of(a), s.of(np.unique(common))))


def test_shingle_hashes_do_not_depend_on_the_batch():
    texts = ["a b c d e", "", "A  B\tC d E", "x", "y z", "a b c d e f"]
    raw = "".join(texts).encode()
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    together = j.shingle_sets(np.frombuffer(raw, np.uint8), offsets)
    for t, s in zip(texts, together, strict=True):
        alone = j.shingle_sets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0]
        assert np.array_equal(alone, s) and len(s) == len(shingles(t))
    assert np.array_equal(together[0], together[2])


def test_near_copies_stage_takes_five_words_and_four_fifths(spark):
    """The stage against brute force, on pairs on either side of both thresholds."""
    rng = random.Random(11)
    rows = corpus(3, 50)
    for n in (12, 23, 24, 40, 47, 90):  # one changed word breaks five 5-word shingles of n - 4, four 4-word ones of n - 3
        base = [f"s{n}x{rng.random()}" for _ in range(n)]
        for at in (0, 1, 2, 3, n // 2):
            rows.append((len(rows) + 1000, " ".join([*base[:at], "changed", *base[at + 1 :]])))

    def five(text):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets, label = [five(t) for _, t in rows], {i: i for i, _ in rows}
    for (a, _), x in zip(rows, sets, strict=True):
        for (b, _), y in zip(rows, sets, strict=True):
            if a < b and x and y and 5 * len(x & y) >= 4 * len(x | y) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {i: low if c == high else c for i, c in label.items()}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.one_of_each(spark, df, "").collect()}
    assert got == set(label.values())
    assert got != {r.doc_id for r in j.keep_one(df).collect()}


def test_signatures_meet_at_four_fifths():
    rng, s = np.random.default_rng(7), j.Signatures(80, 100)
    for n in [4, 5, 8, 9, 16, 17, 20, 24, 25, 33, 60, 120, 500]:
        for extra in range(1, n + 1):
            if 100 * n < 80 * (n + extra):
                break
            for _ in range(10):
                common = rng.integers(0, 2**64, n, dtype=np.uint64)
                more, k = rng.integers(0, 2**64, extra, dtype=np.uint64), int(rng.integers(0, extra + 1))
                a, b = np.unique(np.concatenate((common, more[:k]))), np.unique(np.concatenate((common, more[k:])))
                assert len(np.intersect1d(s.of(a), s.of(b))), (n, extra)


def versions(seed, n, words=60):
    """Copies with few to many edits of a text and of two later versions of it, so that most share buckets and few link."""
    rng = random.Random(seed)
    base = [f"v{i}" for i in range(words)]
    second = base[: words // 2] + [f"x{i}" for i in range(words // 2)]
    third = second[: words // 4] + ["and"] * 3 + second[words // 4 :]
    rows = []
    for i in range(n):
        copy = list(rng.choice([base, second, third]))
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 5, 6])):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(copy)))
    return rows


def test_large_buckets_of_which_few_link(spark, monkeypatch):
    rows = versions(21, 160)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert answer(df) == plain(rows)
    monkeypatch.setattr(j, "PAIRS", 2)  # several levels of cores
    rows = versions(22, 90, 40) + [(1000 + i, t) for i, t in versions(23, 60, 9)]
    assert answer(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)


def test_sketches_never_rule_out_too_much():
    rng = np.random.default_rng(9)
    for n, m in [(1, 1), (3, 50), (40, 45), (200, 300), (1000, 20)]:
        for _ in range(20):
            common = rng.integers(0, 2**64, min(n, m), dtype=np.uint64)
            a = np.unique(np.concatenate((common, rng.integers(0, 2**64, n, dtype=np.uint64))))
            b = np.unique(np.concatenate((common[: m // 2], rng.integers(0, 2**64, m, dtype=np.uint64))))
            assert j.sketches_apart(j.sketch(a), j.sketch(b)) <= len(np.setxor1d(a, b))
            assert j.sketches_apart(j.sketch(a), j.sketch(a)) == 0
            assert int(np.bitwise_count((j.parity(a) ^ j.parity(b)).view(np.uint64)).sum()) <= len(np.setxor1d(a, b))


def test_keep_one_goes_by_texts_not_by_ids(spark):
    text, other, near = (" ".join(f"{p}{i}" for i in range(80)) for p in "tut")
    near += " end"
    rows = [(2, text), (6, text), (6, other), (None, text), (6, other), (7, near), (7, near + " of it"), (8, ""), (8, ""), (None, None), (None, None)]
    got = sorted(((r.doc_id, r.text) for r in j.keep_one(frame(spark, rows)).collect()), key=repr)
    assert got == sorted([(2, text), (6, other), (8, ""), (None, None), (None, None)], key=repr)
    two = [(9, near), (9, near + " of it"), (12, near)]
    assert [r.doc_id for r in j.keep_one(frame(spark, two)).collect()] == [9]
    assert j.keep_one(frame(spark, rows)).columns == frame(spark, rows).columns


def test_allowances_lose_no_linked_pair():
    """Linked sets still meet when each passes over as many shared signatures as it may, in the worst order for the other."""
    rng, s, tiers = np.random.default_rng(12), j.Signatures(), (1 << j.TIER_BITS) - 1

    def left(sigs, free, first):
        drop = []
        for f in free.tolist():
            own = [x for x in first if x & tiers == f >> 16 and x in sigs]
            drop += own[: f & 0xFFFF]
        return sigs - set(drop)

    for n in (28, 40, 61, 100, 150, 400):
        for _ in range(60):
            common = rng.integers(0, 2 ** int(rng.choice([60, 63, 64])), n, dtype=np.uint64)
            extra = max(x for x in range(n) if 100 * n >= 85 * (n + x))
            k = int(rng.integers(0, extra + 1))
            more = rng.integers(0, 2**64, extra, dtype=np.uint64)
            a, b = np.unique(np.concatenate((common, more[:k]))), np.unique(np.concatenate((common, more[k:])))
            (x, fx), (y, fy) = s.with_allowance(a), s.with_allowance(b)
            x, y = set(x.tolist()), set(y.tolist())
            both = sorted(x & y)
            x2, y2 = left(x, fx, both), left(y, fy, both[::-1])
            assert x2 & y2, (n, k)


def test_buckets_of_one_hub_follow_it_to_a_heavier_one(spark):
    buckets = {1: (1, 2, 3), 2: (1, 2, 3), 3: (3, 4, 5), 4: (4, 5, 6), 5: (7, 8, 9)}
    rows = [(sig, h, 30, True, h, len(hs)) for sig, hs in buckets.items() for h in hs]
    found = j._groups(spark.createDataFrame(rows, "sig long, h long, n long, short boolean, c long, k long"), 2).collect()
    assert sorted(r.h for r in found) == list(range(1, 10))  # sets 4 and 5 had a row for each of two hubs
    hub = {r.h: r.hub for r in found}
    assert all(len({hub[h] for h in hs}) == 1 for hs in buckets.values())


def test_groups_that_a_star_holds_have_no_prefixes(spark):
    base = set(range(1, 201))
    sets = {1: base, 2: base - {5}, 3: base - {9} | {301}, 4: base | {302}, 11: base, 12: set(range(401, 601)), 13: base - {7}}
    join = j._Join(None, None, 4, 85, 100)
    join.sets = spark.createDataFrame([(h, bytearray(np.array(sorted(s), np.uint64).tobytes())) for h, s in sets.items()], "h long, elements binary")
    groups = spark.createDataFrame([(h // 10, h, len(s)) for h, s in sets.items()], "hub long, h long, n long")
    stars, rest = join.centred(groups)
    assert {frozenset(r) for r in stars.where("u < 10").collect()} == {frozenset((h, v)) for h in (1, 2, 3, 4) for v in {r.v for r in stars.where("u < 10").collect()} if h != v}
    assert {r.h for r in rest.collect()} == {11, 12, 13}  # one of them is not in its star

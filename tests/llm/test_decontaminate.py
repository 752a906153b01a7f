import re

from fieldtopo.llm import decontaminate as d

from .helpers import empty, frame

ITEM = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(text, items):
    w, hit, found = words(text), set(), set()
    for item_id, t in items:
        v = words(t)
        n = min(10, len(v))
        for window in {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else ():
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) == window:
                    hit |= set(range(i, i + n))
                    found.add(str(item_id))
    return len(w), len(hit), sorted(found)


DOCS = [
    (1, f"before, {ITEM.upper()}! after"),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota"),
    (3, "x alpha beta gamma delta epsilon zeta eta theta iota kappa y tiny item z beta gamma delta epsilon zeta eta theta iota kappa lambda"),
    (4, None),
    (5, ""),
    (6, "tiny item tiny item"),
    (6, "nothing of it"),
    (7, f"{ITEM} " * 200),
    (None, f"no id {ITEM}"),
]
ITEMS = [(10, ITEM), (11, "Tiny item"), (12, None), (13, "..."), (2, ITEM + " nu")]


def test_equals_brute_force(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted(((r.doc_id is None, r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in d.contamination(docs, items).collect()), key=repr)
    want = sorted(((i is None, i, *plain(t, ITEMS)) for i, t in DOCS), key=repr)
    assert got == want


def test_a_large_benchmark_is_shuffled_with_the_same_result(spark, monkeypatch):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = sorted(map(repr, d.contamination(docs, items).collect()))
    monkeypatch.setattr(d, "BROADCAST_WINDOWS", 0)
    assert sorted(map(repr, d.contamination(docs, items).collect())) == want


def test_cutting(spark):
    docs = frame(spark, [(1, f"Before, {ITEM}! After (it)."), (2, "Clean text."), (3, ITEM), (4, None)])
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    got = {r.doc_id: r.text for r in d.cut_out(docs, items, 0.9).collect()}
    assert got[2] == "Clean text." and got[4] is None and 3 not in got
    assert got[1].startswith("Before,") and got[1].endswith("! After (it).") and "Alpha" not in got[1]
    assert d.cut_out(docs, items, 0.0).count() == 2
    assert d.cut_out(docs, items).columns == docs.columns


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.contamination(empty(spark), items).count() == 0
    assert d.contamination(frame(spark).select("doc_id", "text"), none).where("n_hit > 0").count() == 0
    assert d.contamination(frame(spark), none).count() == frame(spark).count()


def test_cutting_keeps_columns_of_its_own_names(spark):
    docs = spark.createDataFrame([(1, f"Before, {ITEM}! After (it) with some more words behind.", "mine"), (2, "clean", "kept")], "doc_id long, text string, hit_spans string")
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    got = {r.doc_id: r for r in d.cut_out(docs, items).collect()}
    assert got[1].hit_spans == "mine" and "Alpha" not in got[1].text and got[2].text == "clean"


def test_cutting_without_broadcast_is_the_same(spark, monkeypatch):
    docs = frame(spark, DOCS)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = sorted(map(repr, d.cut_out(docs, items, 0.5).collect()))
    monkeypatch.setattr(d, "BROADCAST_HITS", 0)
    monkeypatch.setattr(d, "BROADCAST_WINDOWS", 0)
    assert sorted(map(repr, d.cut_out(docs, items, 0.5).collect())) == want

"""Source divergence: against a plain dense evaluation and the SQL, with the awkward groups."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from fieldtopo.llm import divergence as D

from .helpers import AWKWARD, rows_of

SCHEMA = "doc_id long, text string, lang string, source string, value long, term string, rank int"


def plain(rows, min_df=D.MIN_DF, most=D.MOST_TERMS):
    docs = [(r[1] or "", r[2] or "", r[3] or "") for r in rows]
    df, groups = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        terms = re.findall("[^\x00-\x40\\[-`{-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        df[lang].update(set(terms))
        groups[lang, source].update(terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in df[lang].items() if n >= min_df]
        v = len(kept)
        shares = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[u] for u in kept) + v) for t in kept}
        mine = {s: c for (g, s), c in groups.items() if g == lang}
        p = {s: shares(c) for s, c in mine.items()}
        q = shares(sum(mine.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in mine:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in mine if o != s))
            out += [(lang, s, "pair", o, -v_, i) for i, (v_, _, o) in enumerate(pairs, 1)]
            terms = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if mine[s][t] and p[s][t] > q[t])
            out += [(lang, s, "term", t, -v_, i) for i, (v_, _, t) in enumerate(terms[:most], 1)]
    return sorted(out, key=repr)


def made(spark, rows, **more):
    return rows_of(D.divergences(spark.createDataFrame(rows, SCHEMA), **more))


def test_equals_dense_evaluation(spark):
    texts = ["red red blue sky", "blue Sky tree", "RED tree naïve 中文", "中文 naïve sky sky sky", "green blue red", None, "", "123 !!", "ÀB àb sky"]
    rows = [(i, texts[i * i % 9], ["en", "fr", None, "de"][i % 7 % 4], ["a", "b", None, "C", "é"][i * 3 % 11 % 5], 1, "x", 2) for i in range(60)]
    rows += [rows[3], rows[3], (None, "lone words here", "xx", "only", 0, "", 0), (None, None, "yy", "p", 0, "", 0), (None, None, "yy", "q", 0, "", 0)]
    assert made(spark, rows) == plain(rows)
    assert made(spark, rows, min_df=1, most_terms=2) == plain(rows, 1, 2)
    odd = [(i, t, "en", f"s{k % 2}", 0, "", 0) for k, (i, t) in enumerate(AWKWARD)]
    assert made(spark, odd, min_df=1) == plain(odd, 1)
    assert made(spark, []) == []


def test_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(D, "_BROADCAST_GROUPS", 0)
    rows = [(i, f"sky tree w{i % 5} w{i % 3}".replace("5", "five"), "en", f"s{i % 4}", 0, "", 0) for i in range(40)]
    assert made(spark, rows) == plain(rows)


@pytest.mark.parametrize("count, total", [(0, 1), (0, 3), (4, 5), (123_456_789_012, 9_000_000_000_000_000), (9_000_000_000_000_000 - 1, 9_000_000_000_000_000), (17, 1_000_000_007)])
def test_exact_shares(spark, count, total):
    got = spark.range(1).select(D.share(F.lit(count).cast("long"), F.lit(total).cast("long")).alias("p")).first().p
    assert got == 1 + 10**9 * (count + 1) // total


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = D.op13_source_divergence(spark, sf_dir)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    assert got.columns == columns and dict(got.dtypes)["rank"] == "int"
    want = con.execute(D.ORACLE).fetchall()
    assert rows_of(got) == sorted(want, key=repr)

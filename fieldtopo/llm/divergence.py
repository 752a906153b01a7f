"""How far the sources of a language differ in their words: exact smoothed term distributions, compared as integers.

Every document becomes a sparse vector (its distinct terms and their counts). A language's vocabulary are the terms that at least
MIN_DF of its documents hold, with no other bound on its size. The vectors of a (language, source) group are summed; p = 1 + floor(10^9
(count + 1) / (N + V)) is a term's smoothed share, and f(p, q) = floor((p - q)^2 / q) the term's part in a chi-square-like distance.

What a fitted count vectoriser gathers in one driver, the vocabulary, is a table here, as it grows with the corpus; the counts are
the same. Vectors are summed by term, so no dense vector is made, and most terms of a group are not held by another: p is then that of count 0, p0.
So a pair's sum over all V terms is V f(p0, q0), plus what each source's own terms change against the other's q0 (or p0) by their
histogram of counts, plus what terms that both hold change beyond that. Only these last are joined, on the term.

All arithmetic is in 64-bit integers: shares by long division in three steps, so N + V may reach 9 x 10^15.

Edge cases: null text, lang and source count as ''. A group without kept terms has its rows (N = 0; value 0 where V = 0). Repeated
rows are documents of their own. A language of one source has no pairs. Extra columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if, forget, written

MIN_DF, MOST_TERMS, SCALE = 3, 200, 1_000_000_000
_TERM = re.compile(r"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_BROADCAST_GROUPS = 50_000
VECTORS = "lang string, source string, terms array<string>, counts array<long>"


def document_vectors(docs: DataFrame) -> DataFrame:
    """VECTORS of (text, lang, source), a row for each document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = (t.as_py() for t in part.column(0))
                made = [Counter(_TERM.findall(t.lower() if t.isascii() else t.translate(_LOWER))) for t in texts]
                ends = pa.array(np.cumsum([0, *map(len, made)]), pa.int32())
                terms = pa.array(list(chain.from_iterable(made)), pa.string())
                counts = pa.array(list(chain.from_iterable(m.values() for m in made)), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.ListArray.from_arrays(ends, terms), pa.ListArray.from_arrays(ends, counts)], ["lang", "source", "terms", "counts"])

    read = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")])
    return read.mapInArrow(work, VECTORS)


def group_counts(vectors: DataFrame) -> DataFrame:
    """(lang, source, term, n, df): the sums of the groups' vectors, and how many of their documents hold the term."""
    cells = vectors.select("lang", "source", F.explode(F.arrays_zip("terms", "counts")).alias("c"))
    return cells.groupBy("lang", "source", F.col("c.terms").alias("term")).agg(F.sum("c.counts").alias("n"), F.count("*").alias("df"))


def kept_terms(counts: DataFrame, min_df: int = MIN_DF) -> DataFrame:
    """(lang, source, term, n, n_lang) of the terms that enough documents of their language hold; n_lang: occurrences in the language."""
    by_term = Window.partitionBy("lang", "term")
    rows = counts.withColumn("df_lang", F.sum("df").over(by_term)).withColumn("n_lang", F.sum("n").over(by_term))
    return rows.where(F.col("df_lang") >= min_df).select("lang", "source", "term", "n", "n_lang")


def share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 (count + 1) / total), exactly: a thousand times the remainder is divided, three times over."""
    whole, rest = count + 1, total
    out = _quotient(whole, rest) * SCALE + 1
    left = whole % rest
    for weight in (1_000_000, 1_000, 1):
        out, left = out + _quotient(left * 1000, rest) * weight, (left * 1000) % rest
    return out


def _quotient(a: Column, b: Column) -> Column:
    """a div b of non-negative longs, with no detour over doubles."""
    return F.call_function("div", a, b)


def part(p: Column, q: Column) -> Column:
    return _quotient((p - q) * (p - q), q)


def _sizes(groups: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, source, total) of every group and (lang, total, v) of every language; total is N + V, or 1 where both are 0."""
    terms = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    one_each = kept.groupBy("lang", "term").agg(F.first("n_lang").alias("n")).groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("v"))
    langs = groups.select("lang").distinct().join(one_each, "lang", "left").fillna(0, ["n", "v"])
    by_lang = langs.select("lang", F.greatest(F.col("n") + F.col("v"), F.lit(1)).alias("total"), "v")
    sized = groups.join(terms, ["lang", "source"], "left").fillna(0, ["n"]).join(by_lang.select("lang", "v"), "lang")
    return sized.select("lang", "source", F.greatest(F.col("n") + F.col("v"), F.lit(1)).alias("total"), "v"), by_lang


def divergences(docs: DataFrame, min_df: int = MIN_DF, most_terms: int = MOST_TERMS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    counts, counts_at = written(group_counts(document_vectors(docs)), "term-counts")
    kept, _ = written(kept_terms(counts, min_df), "term-kept")
    forget(docs.sparkSession, counts_at)
    groups = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    sized, by_lang = _sizes(groups, kept)
    sized, _ = written(sized, "term-groups")
    by_lang, _ = written(by_lang, "term-langs")
    n_groups = sized.count()
    few = lambda df: broadcast_if(df, n_groups, _BROADCAST_GROUPS)

    # Shares of the terms that occur in a group, and p0 of those that do not.
    groups = sized.withColumn("p0", share(F.lit(0).cast("long"), F.col("total")))
    terms = kept.join(few(groups), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total")))

    q = share(F.col("n_lang"), F.col("q_total"))
    listed = terms.join(few(by_lang.select("lang", F.col("total").alias("q_total"))), "lang").withColumn("q", q).where("p > q")
    by_group = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    listed = listed.select("lang", "source", "term", part(F.col("p"), F.col("q")).alias("value")).withColumn("rank", F.row_number().over(by_group)).where(F.col("rank") <= most_terms)
    top = listed.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")

    # Every ordered pair, as if no term occurred; then each side's own terms against the other's p0, by distinct counts.
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = groups.join(few(other), "lang").where("source <> item")
    base = pairs.select("lang", "source", "item", (F.col("v") * part(F.col("p0"), F.col("q0"))).alias("value"))
    shares, _ = written(terms.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("k")), "term-shares")
    mine, yours, p, q, p0, q0, k = (F.col(c) for c in ("source", "item", "p", "q", "p0", "q0", "k"))
    own = shares.join(few(other), "lang").where(mine != yours).groupBy("lang", "source", "item").agg(F.sum(k * (part(p, q0) - part(p0, q0))).alias("value"))
    theirs = shares.select("lang", F.col("source").alias("item"), p.alias("q"), p0.alias("q0"), "k").join(few(groups.select("lang", "source", "p0")), "lang").where(mine != yours)
    theirs = theirs.groupBy("lang", "source", "item").agg(F.sum(k * (part(p0, q) - part(p0, q0))).alias("value"))
    # What terms that both hold change beyond that.
    right = terms.select("lang", "term", mine.alias("item"), p.alias("q"), p0.alias("q0"))
    both = terms.select("lang", "term", "source", "p", "p0").join(right, ["lang", "term"]).where(mine != yours)
    both = both.groupBy("lang", "source", "item").agg(F.sum(part(p, q) - part(p, q0) - part(p0, q) + part(p0, q0)).alias("value"))
    summed = base.unionByName(own).unionByName(theirs).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ranked = summed.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return ranked.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").unionByName(top)


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    return divergences(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
t AS (SELECT rid, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT rid) >= {MIN_DF}),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
held AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT g.lang, g.source, coalesce(sum(h.n), 0) AS n, coalesce(any_value(v.v), 0) AS v FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source LEFT JOIN v ON v.lang = g.lang GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS c, CAST(1 + ({SCALE}::HUGEINT * (coalesce(h.n, 0) + 1)) // (g.n + g.v) AS HUGEINT) AS p
  FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term),
q AS (SELECT k.lang, k.term, CAST(1 + ({SCALE}::HUGEINT * (k.n + 1)) // (v.n + v.v) AS HUGEINT) AS q FROM kept k JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT p.lang, p.source, p.term AS item, ((p.p - q.q) * (p.p - q.q)) // q.q AS value FROM p JOIN q USING (lang, term) WHERE p.c > 0 AND p.p > q.q)
SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM pairs
UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM terms) WHERE rank <= {MOST_TERMS}"""

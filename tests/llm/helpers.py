"""Small document tables with every awkward row in them."""

from __future__ import annotations

AWKWARD = [
    (None, "a text without an id that is long enough to count"),
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "!!! ??? 123"),
    (5, "one"),
    (6, "same words here and there again"),
    (6, "same words here and there again"),
    (6, "other words under the same id, not equal"),
    (7, "naïve café – Ünïcode ÀÉÎ ſharp ß 中文 text 🙂 mixed"),
    (8, "x" * 70_000),
    (9, "the quick brown fox jumps over the lazy dog " * 3000),
    (10, " " * 5000 + "end"),
    (11, "digits 1 22 333 4444 " * 400),
]


def frame(spark, rows=AWKWARD):
    """(doc_id, text) and columns whose names the operators use themselves."""
    data = [(i, t, "en", "src0", 7, "mine", 0.5, "kept") for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double, extra string")


def empty(spark):
    return frame(spark, []).select("doc_id", "text")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)

"""Language identification by rank-order profiles (out-of-place distance between n-gram rankings).

A profile is a language's most frequent 1- to 3-grams in order. A document gets the language whose profile its own ranking is
nearest to: each of its n-grams costs the difference of the two ranks, or the profile's length where the profile lacks it.
Learning takes a sample of labelled rows of bounded expected size (`max_train`), drawn by a hash of the id for each language by
its own share: rare languages give every row, the others the same number; counting is done by Spark, and only the head of each ranking reaches the driver.

Edge cases: null text or a text without a letter gives `und` with score 0. Ties go to the language that sorts first.
Repeated rows get the same answer. No labelled row at all: every text is `und`. The columns `lang_pred` and `score` are
replaced where the input has columns of these names (`names` chooses others); other columns are kept.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROFILE, MAX_TRAIN, UNKNOWN = 300, 20_000, "und"
HELD = 1 << 19  # n-grams of texts that a worker holds before it adds them up
ROWS = 256  # that a worker returns at a time; a batch can be a whole split of the input
_MASK = (1 << 21) - 1
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 1- to 3-grams of the text's letters, other characters as one space, packed to integers; and their counts."""
    empty = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not text:
        return empty
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _letter_table()[code]
    if not letter.any():
        return empty
    code = np.where(letter, code, 32)
    code = code[np.concatenate(([True], letter[1:] | letter[:-1]))]  # one space for a run of others
    two = (code[:-1] << 21) | code[1:]
    three = (code[:-2] << 42) | two[1:]
    return np.unique(np.concatenate((code[code != 32], two, three)), return_counts=True)


def ranking(text: str | None, size: int = PROFILE) -> np.ndarray:
    """The text's most frequent n-grams in order; ties by code."""
    grams, counts = ngrams(text)
    return grams[np.argsort(-counts, kind="stable")[:size]]


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of all parts, and their counts."""
    grams, where = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return grams, np.bincount(where, np.concatenate([c for _, c in parts]), len(grams)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by: dict[str, list] = {}
        held: dict[str, int] = {}
        for text, lang in zip(batch.column(0), batch.column(1), strict=True):
            lang = lang.as_py()
            parts = by.setdefault(lang, [])
            parts.append(ngrams(text.as_py()))
            held[lang] = held.get(lang, 0) + len(parts[-1][0])
            if sum(held.values()) > HELD:  # the language that holds most is added up
                lang = max(held, key=held.__getitem__)
                by[lang], held[lang] = [_summed(by[lang])], 0
        for lang, parts in by.items():
            grams, n = _summed(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.int64()), pa.array(n)], ["lang", "gram", "n"])


def shares(rows: dict[str, int], max_train: int) -> dict[str, float]:
    """The share of its rows that each language gives: the same number of rows each, or all where it has fewer; max_train together."""
    out, left = {}, float(max_train)
    for i, (lang, n) in enumerate(sorted(rows.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = min(1.0, left / (len(rows) - i) / n)
        left -= out[lang] * n
    return out


def learn_profiles(labelled: DataFrame, max_train: int = MAX_TRAIN, size: int = PROFILE) -> dict[str, np.ndarray]:
    """lang -> ranked n-grams, from rows (doc_id, text, lang). About max_train rows at most are read as text."""
    labelled = labelled.where("lang is not null and text is not null")
    share = shares({r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}, max_train)
    bounds = {lang: int(x * (1 << 30)) for lang, x in share.items() if x < 1}
    sample = labelled
    if bounds:
        bound = F.create_map(*[F.lit(x) for pair in bounds.items() for x in pair])[F.col("lang")]
        drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("profile")), F.lit(1 << 30))
        sample = labelled.where(drawn < F.coalesce(bound, F.lit(1 << 30)))
    counts = sample.select("text", "lang").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    salt = F.pmod(F.xxhash64("gram"), F.lit(16))
    from pyspark.sql import Window

    order = Window.partitionBy("lang", salt).orderBy(F.desc("n"), "gram")
    heads = counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= size).select("lang", "gram", "n").toPandas()
    return {lang: part.sort_values(["n", "gram"], ascending=[False, True])["gram"].to_numpy()[:size] for lang, part in heads.groupby("lang")}


class _Model:
    """Profiles as sorted codes with their ranks, for lookups by bisection."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE):
        self.langs, self.size = sorted(profiles), size
        self.tables = []
        for lang in self.langs:
            order = np.argsort(profiles[lang], kind="stable")
            self.tables.append((profiles[lang][order], order))

    def predict(self, text: str | None) -> tuple[str, float]:
        grams = ranking(text, self.size)
        if not len(grams) or not self.langs:
            return UNKNOWN, 0.0
        at, best = np.arange(len(grams)), None
        for lang, (codes, ranks) in zip(self.langs, self.tables, strict=True):
            i = np.minimum(np.searchsorted(codes, grams), len(codes) - 1)
            d = float(np.where(codes[i] == grams, np.minimum(np.abs(ranks[i] - at), self.size), self.size).mean())
            if best is None or d < best[1]:
                best = lang, d
        return best[0], 1.0 - best[1] / self.size


def identify(df: DataFrame, profiles: dict[str, np.ndarray], text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """df with the predicted language and its score (1: the same ranking, 0: nothing in common), in columns of these names."""
    df = df.drop(*names)
    at = df.columns.index(text_col)
    schema = T.StructType([*df.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _Model(profiles)
        for part in (batch.slice(lo, ROWS) for batch in batches for lo in range(0, batch.num_rows, ROWS)):
            out = [model.predict(t.as_py()) for t in part.column(at)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], [f.name for f in schema])

    return df.mapInArrow(work, schema)


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def learn_from_documents(docs: DataFrame, max_train: int = MAX_TRAIN) -> dict[str, np.ndarray]:
    return learn_profiles(docs.where(~held_out()).select("doc_id", "text", "lang"), max_train)


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = learn_from_documents(docs)
    found = identify(docs.select("doc_id", "text"), profiles).select("doc_id", "lang_pred", "score")
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")

"""From raw documents to token ids in five stages; each reads all that the one before kept, written as Parquet in between.

language    the language is predicted from the text, never read off; a document stays if it is one of KEEP_LANGUAGES (None: any that
            was learned) with a score of MIN_SCORE or more. Texts without a letter, and texts too unlike every language, go
lines       lines of recurring templates and repeated passages go, except in the first document that holds them; documents left without text go
near_copies one document of each Jaccard component stays (five-word shingles, linked at 0.8 or more; op4_jaccard_join has its own four words and 0.85)
benchmark   the words of benchmark windows are cut out; a document of which too little is left goes
tokens      ids by byte-level BPE, checked by decoding

All but the last return the columns of documents, and no column of theirs is touched but text and n_chars.

Edge cases, by stage. Null or empty text: language rejects it, as it has no letter; run on their own, the other stages keep such
rows as they are, and tokens gives them no ids. Very long texts are read whole everywhere. Ties: of languages at the same distance
the first in order; of documents with the same line or text that of the smallest doc_id, rows without one coming last. Repeated
rows: near_copies keeps one of those that share doc_id and text; before it they are treated alike. Empty tables stay empty. Extra
columns are kept, whatever their names (`score`, `n_lines`, `hit_spans`), by all stages but the last, which has columns of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtopo.llm import byte_bpe, decontaminate, jaccard, language, line_dedup
from fieldtopo.llm.common import shared_path

MOST_CONTAMINATED = 0.5  # share of a document's words in benchmark windows above which it goes whole
KEEP_LANGUAGES: list[str] | None = None  # of the languages that were learned; None keeps them all
MIN_SCORE = 0.05  # the least score of a predicted language: 1 is its profile's own ranking, 0 has nothing in common with it
NEAR_COPIES = 5, 80, 100  # words a shingle, and the threshold as a fraction


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    profiles = language.learn_from_documents(docs)
    found = language.identify(docs, profiles, names=("__lang", "__score"))
    wanted = F.col("__lang") != language.UNKNOWN if KEEP_LANGUAGES is None else F.col("__lang").isin(*KEEP_LANGUAGES)
    return found.where(wanted & (F.col("__score") >= MIN_SCORE)).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = line_dedup.dedup_lines(docs, names=("__lines", "__dropped"))
    kept = cut.where((F.col("__dropped") == 0) | (F.length(F.trim(F.col("text"))) > 0))
    return _recount(kept, docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, *NEAR_COPIES).select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return _recount(decontaminate.cut_out(docs, items, MOST_CONTAMINATED), docs.columns)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    made = byte_bpe.encode(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    whole = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return made.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", whole.alias("round_trip"))


def _recount(docs: DataFrame, columns: list[str]) -> DataFrame:
    counted = docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in columns else docs
    return counted.select(*columns)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", keep_language),
    ("lines", drop_lines),
    ("near_copies", one_of_each),
    ("benchmark", drop_benchmark),
    ("tokens", to_tokens),
]

ORACLE_SQL = None  # ranked profiles and byte-level BPE are beyond SQL; tests/llm compares the stages with plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = shared_path(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs

"""Benchmark decontamination: a broadcast table of test n-gram hashes, scanned over training token windows, then verified.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. A window is 10 consecutive item words; an item of fewer
words, but not none, is one window. Hashes only propose: a hit counts once the words themselves agree.
DataFrame functions only.

Edge cases: null text has no words (n_words 0, not contaminated). Rows of one doc_id and equal text get equal results, one per
row; texts that differ under one doc_id are told apart. An empty benchmark hits nothing. `cut_out` keeps
every column, whatever its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if, lower_ascii, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # the same words before lower-casing
WINDOW = 10
BROADCAST_WINDOWS = 500_000  # windows of some 100 bytes; a larger benchmark is joined by a shuffle instead
BROADCAST_HITS = 50_000  # texts with hits, of some 100 bytes; more are joined by a shuffle


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0))


def _key(words: Column) -> Column:
    """Hash of a window: of its words' hashes in order."""
    return F.xxhash64(F.transform(words, lambda w: F.xxhash64(w)))


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: length, words, key, and the ids (as strings) of the items that hold them."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where("size(w) > 0")
    length = F.least(F.size("w"), F.lit(window))
    at = F.explode(F.sequence(F.lit(0), F.size("w") - length))
    each = w.select("item_id", "w", length.alias("length"), at.alias("at")).select("item_id", "length", F.expr("slice(w, at + 1, length)").alias("window"))
    return each.groupBy("length", "window").agg(F.collect_set("item_id").alias("items"))


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Verified occurrences: doc_id, text_key, at (0-based word), length, items."""
    table = benchmark_windows(items, window)
    sizes = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `window` rows
    lengths = sorted(sizes)
    if not lengths:
        lengths = [window]
    table = table.withColumn("key", _key(F.col("window")))
    n_windows, with_words = sum(sizes.values()), F.coalesce(words(F.col("text")), F.array().cast("array<string>"))
    base = docs.select("doc_id", F.xxhash64("text").alias("text_key"), with_words.alias("w"))
    hashed = base.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    one = lambda n: F.transform("h", lambda x, i: F.xxhash64(F.slice("h", i + 1, F.lit(n))))
    keys = one(lengths[0]) if len(lengths) == 1 else F.concat(*[one(n) for n in lengths])
    at = [(F.col("pos") % F.col("n_w")).alias("at"), F.get(F.array(*[F.lit(n) for n in lengths]), F.expr("pos div n_w").cast("int")).alias("length")]
    # The keys stand in a column of their own, so that exploding them runs in compiled code and copies no words. Outer, as Spark
    # would else add a filter on their number and push it down to where they are made.
    same = "slice(w, at + 1, length) = window"
    if n_windows <= BROADCAST_WINDOWS:
        scanned = hashed.select("doc_id", "text_key", "w", F.size("w").alias("n_w"), F.posexplode_outer(keys).alias("pos", "key"))
        placed = scanned.join(F.broadcast(table), "key").select("*", at[0], at[1].alias("l")).where("l = length")
        return placed.where(same).select("doc_id", "text_key", "at", "length", "items")
    # A larger benchmark: positions and keys alone are shuffled, and the words are looked at again in texts with a proposed hit.
    scanned = hashed.select("doc_id", "text_key", F.size("w").alias("n_w"), F.posexplode_outer(keys).alias("pos", "key")).select("doc_id", "text_key", "key", *at)
    proposed = scanned.join(table, ["key", "length"]).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "at", "length", "window", "items").distinct()
    placed = base.join(proposed, base["doc_id"].eqNullSafe(F.col("__id")) & (base["text_key"] == F.col("__key")))
    return placed.where(same).select("doc_id", "text_key", "at", "length", "items")


def hit_texts(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_key, item_ids (sorted strings) and spans (word ranges from, to) of the texts with hits, and of no others."""
    found = hits(docs, items, window).groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_set(F.struct("at", "length"))).alias("at"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids")
    )
    none = F.array().cast("array<struct<from:int,to:int>>")

    def merge(acc: Column, x: Column) -> Column:
        end, last = x["at"] + x["length"], F.element_at(acc, -1)
        new = F.struct(x["at"].alias("from"), end.alias("to"))
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["from"].alias("from"), F.greatest(last["to"], end).alias("to"))))
        return F.when(F.size(acc) == 0, F.array(new)).when(x["at"] <= last["to"], grown).otherwise(F.concat(acc, F.array(new)))

    return found.withColumn("spans", F.aggregate("at", none, merge)).drop("at")


def _covered() -> Column:
    return F.aggregate("spans", F.lit(0), lambda t, s: t + s["to"] - s["from"])


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of docs: doc_id, text_key, n_words, n_hit, item_ids (sorted strings), spans (word ranges from, to)."""
    found = hit_texts(docs, items, window).withColumnsRenamed({"doc_id": "__id", "text_key": "__key"})
    none = F.array().cast("array<struct<from:int,to:int>>")
    every = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.coalesce(F.regexp_count("text", F.lit(_RAW_WORD)), F.lit(0)).cast("long").alias("n_words"))
    out = every.join(found, every["doc_id"].eqNullSafe(found["__id"]) & (every["text_key"] == found["__key"]), "left").drop("__id", "__key")
    return out.select("doc_id", "text_key", "n_words", F.coalesce(_covered(), F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), F.coalesce("spans", none).alias("spans"))


def cut_out(docs: DataFrame, items: DataFrame, most_share: float = 1.0, window: int = WINDOW) -> DataFrame:
    """docs with the words of benchmark windows cut out of `text`, separators left as they are; documents of whose words more
    than that share is hit go whole (0: every contaminated document goes). Other texts stay as they are, and where few texts are hit none
    is shuffled: the hits are written, and broadcast where their number allows."""
    found, _ = written(hit_texts(docs.select("doc_id", "text"), items, window).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("spans").alias("__spans"), _covered().alias("__hit")), "hits")
    bad = broadcast_if(found, found.count(), BROADCAST_HITS)
    got = docs.join(bad, docs["doc_id"].eqNullSafe(bad["__id"]) & (F.xxhash64(docs["text"]) == bad["__key"]), "left")
    text = docs["text"]
    n_words = F.when(F.col("__hit").isNotNull(), F.regexp_count(text, F.lit(_RAW_WORD)))
    got = got.where(F.col("__hit").isNull() | (F.col("__hit") <= F.lit(most_share) * n_words))
    raw, gaps = F.regexp_extract_all(text, F.lit(_RAW_WORD), F.lit(0)), F.split(text, _RAW_WORD, -1)
    kept = F.transform(raw, lambda w, i: F.when(F.exists("__spans", lambda s: (i >= s["from"]) & (i < s["to"])), F.lit("")).otherwise(w))
    rebuilt = F.array_join(F.flatten(F.zip_with(gaps, kept, lambda g, w: F.array(g, F.coalesce(w, F.lit(""))))), "")
    whole = F.when(F.col("__spans").isNull(), text).otherwise(rebuilt)
    return got.select(*[whole.alias("text") if c == "text" else docs[c] for c in docs.columns])


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    got = contamination(docs, items)
    return got.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )

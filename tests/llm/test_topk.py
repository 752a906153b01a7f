import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtopo.llm import topk


def plain(rows, k=5):
    v = [(i, np.floor(256 * np.array(x, float)).astype(int)) for i, x in rows if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)]
    out = []
    for i, q in v:
        if i % 50 == 0:
            best = sorted((-int(q @ p), j) for j, p in v if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("case", ["even", "few_long", "ties", "close"])
def test_equals_brute_force(spark, monkeypatch, case):
    monkeypatch.setattr(topk, "CHUNK", 40)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "SEED", 60)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8)) * (rng.lognormal(0, 1.5, (400, 1)) if case == "few_long" else 0.2)
    if case == "ties":
        x = np.round(x * 4) / 4
    if case == "close":
        x = np.repeat(rng.normal(size=(8, 8)), 50, 0) + rng.normal(size=(400, 8)) * 0.02
    rows = [(i, [float(np.float32(c)) for c in r]) for i, r in enumerate(x)]
    rows += [(1000, None), (1001, [None] * 8), (1050, [float("nan")] * 8), (1100, [float("inf")] + [0.0] * 7), (1150, [0.0] * 8)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, label string")
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0).collect()))
    assert got == plain(rows)


def test_small_and_empty_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (3, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert topk.top_k(df, F.col("vec_id") % 50 == 0).count() == 1
    assert topk.top_k(df.where("vec_id < 0"), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(df.where("vec_id = 0"), F.col("vec_id") % 50 == 0).count() == 0


def test_vectors_meet_in_few_bytes(spark):
    """A chunk goes to Python as one value of as many bytes as its components need, not as lists of longs."""
    df = spark.createDataFrame([(i, [i / 100.0] * 8) for i in range(100)], "vec_id long, embedding array<float>")
    (row,) = topk._pack(topk.quantised(df), [F.lit(0)], ["part"]).collect()
    assert (row.width, len(row.vectors), len(row.ids)) == (2, 1600, 800)
    wide = spark.createDataFrame([(0, [3e38, 1.0]), (1, [-3e38]), (2, [1e6, 2.0])], "vec_id long, embedding array<float>")
    assert [r.width for r in topk._pack(topk.quantised(wide), [F.lit(0)], ["part"]).collect()] == [8]


def test_queries_of_one_chunk_have_their_own_bounds(spark, monkeypatch):
    monkeypatch.setattr(topk, "TOGETHER", 3)
    monkeypatch.setattr(topk, "CHUNK", 200)
    monkeypatch.setattr(topk, "SEED", 100)
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(c)) for c in r * (4.0 if i % 3 else 0.01)]) for i, r in enumerate(rng.normal(size=(900, 6)))]
    rows += [(i, v) for i, v in rows if i % 100 == 0]  # repeated ids
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0).collect())) == plain(rows)


def test_blocks_are_never_gathered_in_the_driver(spark, monkeypatch):
    """Spark guesses packed rows at a few bytes a column, so a join by its guess broadcasts a copy of each block for each chunk."""
    monkeypatch.setattr(topk, "CHUNK", 40)
    monkeypatch.setattr(topk, "SEED", 60)
    df = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(400)], "vec_id long, embedding array<float>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        plan = topk.top_k(df, F.col("vec_id") % 50 == 0)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    sent = re.findall(r"\) BroadcastExchange\nInput \[\d+\]: \[(.*)\]", plan)
    assert sent and all(re.fullmatch(r"bucket#\d+, part#\d+L", x) for x in sent)


def test_chunks_without_vectors(spark, monkeypatch):
    """Blocks that are sent to a chunk into which no id fell find nothing there, nor in the chunk before it."""
    monkeypatch.setattr(topk, "CHUNK", 1)
    monkeypatch.setattr(topk, "PARTS", 1000)
    monkeypatch.setattr(topk, "SEED", 6)
    rows = [(i, [1.0 + i % 3 / 100, float(i % 2)]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0).coalesce(1).collect())) == plain(rows)

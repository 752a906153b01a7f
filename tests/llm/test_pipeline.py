import hashlib

import public_tokenizers as P
import pytest

import corpus_pipeline
from fieldtopo.llm.byte_bpe import load
from fieldtopo.llm.oracles import ORACLES
from fieldtopo.llm.registry import QUERIES


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], sf_dir).persist())
    return out


def test_stages_keep_the_columns_and_only_drop(stages):
    docs, *kept, last = stages
    seen = docs.count()
    for df in kept:
        assert df.columns == docs.columns
        n = df.count()
        assert 0 < n <= seen
        seen = n
    assert last.count() == seen and last.where("not round_trip").count() == 0


def test_tokens_are_those_of_the_library(stages):
    encoder, _ = load(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    texts = {r.doc_id: r.text for r in stages[-2].collect()}
    assert all(list(r.ids) == encoder.encode_ordinary(texts[r.doc_id]) for r in stages[-1].collect())


def test_no_benchmark_window_is_left(spark, sf_dir, stages):
    from fieldtopo.llm.decontaminate import contamination

    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert contamination(stages[3], items).where("n_hit > 0").count() > 0
    assert contamination(stages[4], items).where("n_hit > 0").count() == 0


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(ORACLES[name]).fetchdf()
    got = QUERIES[name](spark, sf_dir).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda df: sorted(map(repr, df[columns].astype(str).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_contract_of_op6_and_op8(spark, sf_dir):
    encoder, _ = load(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in QUERIES["op6_byte_bpe"](spark, sf_dir).collect():
        ids = encoder.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


EDGES = [
    (None, "this row has no id but the words of the language that others have too"),
    (1, None), (2, ""), (3, " \n\t"), (4, "123 456 !!!"),
    (5, "the same row of text twice in the table and the words of it are these"), (5, "the same row of text twice in the table and the words of it are these"),
    (6, "the first of all that and the second of all these " * 4000),
    (7, "of the and that " * 3 + "x" * 70_000),
]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_each_stage_on_awkward_rows_and_clashing_columns(spark, sf_dir, name):
    """Nulls, empty and very long texts, repeated rows; columns that are named like those the operators add keep their values."""
    names = ["score", "lang_pred", "n_lines", "n_dropped", "hit_spans", "component_id", "key", "label"]
    rows = [(i, t, "en", "s", len(t or ""), *[f"{n}{k}" for n in names]) for k, (i, t) in enumerate(EDGES)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    got = dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir).collect()
    if name == "tokens":
        assert len(got) == len(rows) and all(r.round_trip for r in got) and sorted(r.n_tokens for r in got)[:2] == [0, 0]
        return
    own = {r[5]: r for r in rows}
    for r in got:
        assert [r[n] for n in names] == list(own[r.score][5:]) and r.n_chars == (len(r.text) if r.text is not None else own[r.score][4] if name in ("language", "near_copies") else None)
    kept = sorted((repr(r.doc_id), r.text is None or len(r.text)) for r in got)
    if name == "language":
        assert {r.doc_id for r in got} >= {None, 5, 6} and not {1, 2, 3, 4} & {r.doc_id for r in got}
    elif name == "near_copies":
        assert len(got) == len(rows) - 1, kept
    else:
        assert len(got) == len(rows), kept


def test_language_stage_goes_by_its_prediction(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "KEEP_LANGUAGES", ["fr"])
    kept = corpus_pipeline.keep_language(spark, docs, sf_dir).select("lang").collect()
    assert len(kept) > 5 and sum(r.lang == "fr" for r in kept) > 0.9 * len(kept)
    monkeypatch.setattr(corpus_pipeline, "KEEP_LANGUAGES", None)
    foreign = spark.createDataFrame([(1, "这 是 另 一 种 语 言", "en"), (2, "the words of the text", "en")], "doc_id long, text string, lang string")
    mixed = docs.select("doc_id", "text", "lang").unionByName(foreign.withColumn("doc_id", foreign.doc_id + 10**9))
    left = {r.doc_id for r in corpus_pipeline.keep_language(spark, mixed, sf_dir).where("doc_id > 999999999").collect()}
    assert left == {10**9 + 2}

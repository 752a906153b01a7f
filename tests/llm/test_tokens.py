import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex

from fieldtopo.llm import byte_bpe, token_files
from fieldtopo.llm.common import shared_path

from .helpers import AWKWARD, empty, frame

BPE, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")


def test_chunked_encoding_equals_the_library(spark):
    encoder, _ = byte_bpe.load(BPE, P.PATTERN)
    rng = random.Random(3)
    texts = ["".join(rng.choices(["a", "b ", "  ", "\n", "'s", "'re ", "1", "...", "é", "中", "word", " \t", "🙂"], k=rng.randrange(400))) for _ in range(60)]
    rows = AWKWARD + [(100 + i, t) for i, t in enumerate(texts)]
    for chunk, overlap in ((60, 20), (500, 100), (32768, 2048)):
        got = byte_bpe.encode(frame(spark, rows), BPE, P.PATTERN, chunk=chunk, overlap=overlap).select("doc_id", "text", "ids", "decoded", "extra").collect()
        assert len(got) == len(rows)
        for r in got:
            assert list(r.ids) == encoder.encode_ordinary(r.text or ""), (chunk, r.doc_id)
            assert bytes(r.decoded) == (r.text or "").encode()
    again = byte_bpe.decode_ids(byte_bpe.encode(frame(spark), BPE, P.PATTERN, decode=False), BPE, P.PATTERN)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in again.collect())


@pytest.mark.parametrize("size,overlap", [(12, 6), (20, 8), (64, 16)])
def test_stitching_equals_one_pass(size, overlap):
    pattern, rng = regex.compile(P.PATTERN), random.Random(size)
    for _ in range(400):
        text = "".join(rng.choices("ab  \n\t1.'srel", k=rng.randrange(1, 200)))
        chunks = [(s, text[s : s + size]) for s in range(0, len(text), size - overlap)]
        got = byte_bpe.stitch(pattern, [(s, t, byte_bpe.boundaries(pattern, t)) for s, t in chunks])
        assert got == byte_bpe.boundaries(pattern, text)


def test_one_chunk_texts_are_encoded_by_pieces(monkeypatch):
    """The library sees pre-tokens only, and ordinary documents are longer than a chunk."""
    e, calls = byte_bpe._Encoder(BPE, P.PATTERN), []
    library = e.encoder

    class Recorder:
        def encode_ordinary(self, text):
            calls.append(text)
            return library.encode_ordinary(text)

    monkeypatch.setattr(e, "encoder", Recorder())
    text = "It's 12 o'clock,  and all is well.\n\n Yes 🙂"
    assert e.whole(text) == library.encode_ordinary(text)
    assert len(calls) > 5 and all(byte_bpe.boundaries(e.pattern, c) == [len(c)] for c in calls)
    assert byte_bpe.CHUNK <= 4_096


def test_chunks_meet_as_ids_and_not_as_texts(spark):
    """What is sent to where a text's chunks meet holds no text, and the text is read off it, whatever the overlap cut apart."""
    e, rng = byte_bpe._Encoder(BPE, P.PATTERN), random.Random(5)
    for size, overlap in ((12, 4), (40, 10), (64, 1)):
        for _ in range(100):
            text = "".join(rng.choices(["wording", "  ", "\n", "'re ", "1", "é", "中", "🙂", "aaaa"], k=rng.randrange(1, 80)))
            starts = list(range(0, len(text), size - overlap))
            packed = [e.packed(text[s : s + size]) for s in starts]
            again, ids = e.joined(starts, [p[0] for p in packed], [p[1] for p in packed])
            assert (again, ids.tolist()) == (text, e.encoder.encode_ordinary(text))
    made = byte_bpe.encode(frame(spark, [(1, "some words " * 900)]), BPE, P.PATTERN)
    plan = made._jdf.queryExecution().optimizedPlan().toString().split("\n")
    exchanges = [line for line in plan if "RepartitionByExpression" in line or "Sort [" in line]
    assert exchanges and not any("__ends" in line or "FlatMapGroupsInPandas" in line for line in plan)


def test_workers_hold_results_of_few_rows(spark, monkeypatch):
    """Of a batch as long as a split, results are made and returned in parts, and pre-tokens are kept packed, twice _PIECES at most."""
    sizes, of = [], byte_bpe.pa.RecordBatch
    source = of.from_pydict({"doc_id": list(range(700))})
    assert [p.num_rows for p in byte_bpe._parts(iter([source, source.slice(0, 3)]))] == [256, 256, 188, 3]
    monkeypatch.setattr(byte_bpe, "_PIECES", 50)
    e = byte_bpe._Encoder(BPE, P.PATTERN)
    for i in range(40):
        text = " ".join(f"word{chr(97 + (i * k) % 26)}{chr(97 + k % 26)}x" for k in range(30)) + " héllo 🙂"
        assert e.whole(text) == e.encoder.encode_ordinary(text)
        sizes.append((len(e.known), len(e.known.before)))
    assert all(a <= 50 and b <= 50 for a, b in sizes) and any(b for _, b in sizes)
    assert all(isinstance(x, bytes) for x in e.known.values())


def test_texts_of_very_many_chunks_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(byte_bpe, "DEAL", 3)
    encoder, _ = byte_bpe.load(BPE, P.PATTERN)
    rows = [(i, "some wörds 🙂 " * n) for i, n in enumerate((1, 5, 20, 40, 90))]
    got = byte_bpe.encode(frame(spark, rows), BPE, P.PATTERN, chunk=60, overlap=20).collect()
    assert {r.doc_id: (r.text, list(r.ids)) for r in got} == {i: (t, encoder.encode_ordinary(t)) for i, t in rows} and len(got) == 5


def test_encode_empty_table(spark):
    assert byte_bpe.encode(empty(spark), BPE, P.PATTERN).count() == 0


def test_record_files_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    rows = [*AWKWARD, (19, "a<|endoftext|>b <|STARTOFTEXT|> <|startoftext|>x"), (20, "It's Ünder\x1cscore x <|endoftext|> ÀB ΣΑΣ"), (21, "tabs\tand\r\nlines")]
    root = shared_path(spark, "test")
    index = token_files.write_tokens(frame(spark, rows), root, WORDS)
    got = token_files.read_tokens(token_files.with_starts(index), root).orderBy("start").collect()
    assert len(got) == len(rows)
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])
    start = 0
    for r in got:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert r.start == start and r.n_tokens == len(ids) and ids in want[r.doc_id]
        want[r.doc_id].remove(ids)
        start += len(ids)
    order = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert order == sorted(order)
    some = token_files.read_tokens(token_files.read_index(spark, root).where("doc_id % 3 = 0"), root)  # any subset, any order
    assert {r.doc_id for r in some.collect()} == {i for i, _ in rows if i is not None and i % 3 == 0}


def test_frames_detect_damage():
    record = token_files.frame(b"abcdef")
    assert token_files.unframe(record) == b"abcdef"
    for at in (0, 9, 13, len(record) - 1):
        broken = bytearray(record)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            token_files.unframe(bytes(broken))
    c = zlib.crc32(b"x")
    assert token_files.masked_crc(b"x") == ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def test_record_files_of_an_empty_table(spark):
    root = shared_path(spark, "test")
    index = token_files.write_tokens(empty(spark), root, WORDS)
    assert token_files.read_tokens(token_files.with_starts(index), root).count() == 0


def test_special_strings_are_what_the_library_makes_of_them():
    from tokenizers import Tokenizer

    tokenizer, rng = Tokenizer.from_file(WORDS), random.Random(8)
    encoder = token_files.WordEncoder(WORDS)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endof", "text|>", " ", "a", "It's", "12", "É", "\n", "<|"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(9))) for _ in range(2000)]
    for text, data in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(data, "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_contract_of_op8(spark, sf_dir):
    from tokenizers import Tokenizer

    from fieldtopo.llm.registry import QUERIES

    tokenizer, start, want = Tokenizer.from_file(WORDS), 0, []
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect():
        ids = np.asarray([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op8_token_records"](spark, sf_dir).collect())
    assert got == want

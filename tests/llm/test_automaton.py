"""The merge automaton against merging step by step, and against the library."""

import random

import numpy as np
import public_tokenizers as P
import pytest

from fieldtopo.llm import merge_automaton as M

from .helpers import AWKWARD, empty, frame

WORDS = P.path("word_bpe_49k.json")


def plain_bpe(symbols, ranks, made):
    """The lowest rank first, of equal ranks the leftmost, until no pair merges."""
    symbols = list(symbols)
    while pairs := [(ranks[p], i) for i, p in enumerate(zip(symbols[:-1], symbols[1:], strict=True)) if p in ranks]:
        _, i = min(pairs)
        symbols[i : i + 2] = [made[symbols[i], symbols[i + 1]]]
    return symbols


@pytest.mark.parametrize("seed", range(6))
def test_accepts_just_what_merging_makes(seed):
    """Random merge tables with equal halves, dead merges and long chains: of all token sequences that spell a word, one is accepted."""
    rng = random.Random(seed)
    labels, merges = ["a", "b", "c"], []
    while len(merges) < 14:
        a, b = rng.choice(labels), rng.choice(labels)
        if a + b not in labels:
            merges.append((a, b))
            labels.append(a + b)
    number = {w: i for i, w in enumerate(labels)}
    automaton = M.Automaton(len(labels), [(number[a], number[b], number[a + b]) for a, b in merges])
    ranks = {(number[a], number[b]): i for i, (a, b) in enumerate(merges)}
    made = {(number[a], number[b]): number[a + b] for a, b in merges}

    def accepted(word, state=0):
        if not word:
            return [[]]
        out = []
        for w, i in number.items():
            if word.startswith(w) and (to := automaton.arc(state, i)) >= 0:
                out += [[i, *rest] for rest in accepted(word[len(w) :], to)]
        return out

    for _ in range(150):
        word = "".join(rng.choices("abc", k=rng.randrange(1, 9)))
        assert accepted(word) == [plain_bpe([number[c] for c in word], ranks, made)]


def test_a_token_made_twice_is_refused():
    with pytest.raises(ValueError):
        M.Automaton(4, [(0, 1, 3), (1, 2, 3)])


def test_equals_the_library(spark):
    e = M.encoder_of(WORDS)
    rng = random.Random(5)
    parts = ["a", "b", "aa", "the", "ing", "s", "0", "é", "中", "ß", "'s", "'RE", "...", "-", "_", " ", "\t", "́", "İ", "Σ", "🙂", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "\x1f", "\x85", "ﬁ"]
    rows = AWKWARD + [(100 + i, "".join(rng.choices(parts, k=rng.randrange(60)))) for i in range(400)]
    got = M.encode(frame(spark, rows), WORDS).collect()
    assert len(got) == len(rows)
    for r in got:
        want = e.library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == e.library.decode(want, skip_special_tokens=False), r.doc_id
        assert r.extra == "kept" and r.lang_pred == "mine"
    again = M.decode_ids(M.encode(frame(spark), WORDS).withColumnRenamed("decoded", "before"), WORDS).collect()
    assert all(r.decoded == r.before for r in again)
    assert M.encode(empty(spark), WORDS).count() == 0


def test_forgetting_changes_nothing(monkeypatch):
    e = M.Encoder(WORDS)
    text = " ".join(f"word{i} thing{i % 7}" for i in range(300))
    want = e.encode(text)
    monkeypatch.setattr(M, "_KEPT", 5)
    monkeypatch.setattr(M, "_ROWS", 20)
    for _ in range(3):
        assert e.encode(text) == want
    assert np.frombuffer(want[0], np.int32).tolist() == e.library.encode(text, add_special_tokens=False).ids


def test_query(spark, sf_dir):
    import hashlib

    e = M.encoder_of(WORDS)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    for r in M.op12_merge_automaton(spark, sf_dir).collect():
        ids = e.library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(e.library.decode(ids, skip_special_tokens=False).encode()).hexdigest()

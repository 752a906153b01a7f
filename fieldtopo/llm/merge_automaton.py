"""BPE as a deterministic automaton over tokens, compiled from the merges by one gadget a merge.

The automaton accepts exactly the token sequences that BPE makes. It begins with one state that every symbol leads back to. A
merge (a, b) -> c forbids a before b: the state q that arcs labelled a lead to is copied without its arc b, those arcs lead to
the copy, and wherever an arc a leaves, an arc c leaves to where b led from q (for a = b to q itself, as a third a may follow).
All arcs with one label lead to one state, so a state is a copy chain (`parent`, `removed`, `step`) and a label has one
`target`; the arcs of c leave where a left when c was made, which `arc` reads off the chain by labels' left parts. Nothing of
size states x labels is ever held: rows of the transition table are filled as texts need them.

A word is encoded by walking its symbols: from the state at a place, a trie gives the labels that the following symbols spell,
and the table says which of them may follow. The longest is tried first, and given up where it leads nowhere; BPE of every prefix is unique, so a
place has one state, is tried once, and a word takes time linear in its length. Decoding emits the labels of the ids.

Texts are normalised and split before, as the tokenizer file says. Pieces without a space never merge with each other, so a
worker keeps the pieces it met. Special tokens' strings are taken out of the raw text first and have ids of their own.

Edge cases: null text counts as empty (no ids, empty text). Repeated rows are encoded row by row. Very long pieces take a list as
long as they are and are not kept. Columns called `ids` or `decoded` are replaced; others are kept. Ids that the file does not
have raise an error on decoding. An empty table stays empty.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LETTERS = "a-zA-ZÀ-ÖØ-öø-įı-ňŊ-ǯǱ-ɏ"  # lower-cased one to one, left alone by NFC
_SIMPLE = re.compile(f"[\t\n\r -~{_LETTERS}]*")
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}ⱥⱦ]+|[0-9]|[^\\s0-9{_LETTERS}ⱥⱦ]+")
_SPACES = re.compile("[\t\n\r\f\v ]+")
_KEPT, _ROWS, _LONGEST = 400_000, 2_000_000, 64  # pieces and table entries that a worker keeps, and the longest piece that it keeps


class Automaton:
    """Labels are ids 0 to n-1; `merges` are (left, right, made) in order, each made once and out of labels that are there."""

    def __init__(self, n: int, merges: list[tuple[int, int, int]]):
        self.left, self.born = [-1] * n, [0] * n
        self.parent, self.removed, self.step = [-1], [-1], [0]
        self.target = [0] * n
        made_by_merge = {c for _, _, c in merges}
        if len(made_by_merge) < len(merges):
            raise ValueError("a token is made by two merges")
        self.dead = set(made_by_merge)
        self.table: dict[int, bool] = {}
        self.n = n
        for step, (a, b, c) in enumerate(merges, 1):
            self._merge(step, a, b, c)

    def _merge(self, step: int, a: int, b: int, c: int) -> None:
        q = self.target[a]
        if a in self.dead or b in self.dead or not self._has(q, b):
            return  # earlier merges never leave a before b, so c never comes about
        copy = len(self.parent)
        self.parent.append(q)
        self.removed.append(b)
        self.step.append(step)
        self.target[c] = q if a == b else self.target[b]
        self.target[a] = copy
        self.left[c], self.born[c] = a, step
        self.dead.discard(c)

    def _has(self, state: int, label: int) -> bool:
        """Whether an arc with the label leaves the state: it was not removed from the state's chain while the label was there, and
        when the label was made, an arc of its left part left the state's ancestor of that time."""
        while label >= 0:
            while self.step[state] > self.born[label]:
                if self.removed[state] == label:
                    return False
                state = self.parent[state]
            label = self.left[label]
        return True

    def arc(self, state: int, label: int) -> int:
        """The state that the label leads to, or -1."""
        key = state * self.n + label
        leaves = self.table.get(key)
        if leaves is None:
            if len(self.table) >= _ROWS:
                self.table.clear()
            leaves = self.table[key] = label not in self.dead and self._has(state, label)
        return self.target[label] if leaves else -1


class Encoder:
    """A tokenizer file's merges as an automaton, its normaliser and splitter, and the labels of its ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
            raise ValueError("not a plain merge table")
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.library = Tokenizer.from_file(path)
        specials = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        size = max([*vocab.values(), *specials.values()]) + 1
        self.labels: list[str | None] = [None] * size
        for word, i in [*vocab.items(), *specials.items()]:
            self.labels[i] = word
        self.automaton = Automaton(size, [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges])
        self.specials = specials
        self.special = re.compile("|".join(f"({re.escape(s)})" for s in specials) or r"(?!)")
        self.end = end
        # The trie over symbols: a word's last symbol carries the end mark, so such labels hang on the marked symbol.
        made = {a + b for a, b in merges}
        self.trie: dict = {}
        for word, i in vocab.items():
            if word in made or len(word.removesuffix(end)) == 1:
                node = self.trie
                for symbol in self._symbols(word):
                    node = node.setdefault(symbol, {})
                node[""] = i
        self.lengths = [len(self._symbols(w)) if w else 0 for w in self.labels]
        self.pieces: dict[str, tuple[bytes, str]] = {}
        self.words: dict[str, tuple[bytes, str]] = {}

    def _symbols(self, word: str) -> list[str]:
        stem = word.removesuffix(self.end) if self.end else word
        if stem == word or not stem:
            return list(word)
        return [*stem[:-1], stem[-1] + self.end]

    def walk(self, piece: str) -> list[int]:
        """Ids of one piece (byte-level letters, no end mark): from each place the longest label that may follow goes first. As a place
        has one state whatever the way to it, one that led nowhere is never entered again."""
        symbols = [*piece[:-1], piece[-1] + self.end]
        n, automaton, trie = len(symbols), self.automaton, self.trie
        ids: list[int] = []
        open_: list[tuple[int, list[tuple[int, int]]]] = []  # of every place on the way: its state, and the labels not tried yet
        i, state, closed = 0, 0, set()
        while i < n:
            node, j, found = trie, i, []
            while j < n and (node := node.get(symbols[j])) is not None:
                j += 1
                if (label := node.get("")) is not None:
                    found.append((j, label))
            while True:
                if found:
                    j, label = found.pop()
                    if j not in closed and (to := automaton.arc(state, label)) >= 0:
                        open_.append((state, found))
                        ids.append(label)
                        i, state = j, to
                        break
                elif open_:
                    closed.add(i)
                    state, found = open_.pop()
                    i -= self.lengths[ids.pop()]
                else:
                    raise ValueError(f"the vocabulary has no symbol for a part of {piece!r}")
        return ids

    def _entry(self, pieces: list[str]) -> tuple[bytes, str]:
        ids = [i for p in pieces for i in self.walk(p)]
        return np.asarray(ids, np.int32).tobytes(), " ".join(self.labels[i] for i in ids)

    def _piece(self, piece: str) -> tuple[bytes, str]:
        """Of a simple text: a pre-token as it stands, or in its byte letters."""
        return self._entry([piece] if piece.isascii() else [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(piece)])

    def _word(self, word: str) -> tuple[bytes, str]:
        return self._entry([p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(word))])

    def _look_up(self, keys: list[str], known: dict, make) -> list[tuple[bytes, str]]:
        out = list(map(known.get, keys))
        if None in out:
            if len(known) > _KEPT:
                known.clear()  # what is frequent comes back at once
            for i, (k, e) in enumerate(zip(keys, out, strict=True)):
                if e is None and (e := known.get(k)) is None:
                    e = make(k)
                    if len(k) <= _LONGEST:
                        known[k] = e
                out[i] = e
        return out

    def _plain(self, text: str) -> list[tuple[bytes, str]]:
        """Entries of a text without special strings."""
        if _SIMPLE.fullmatch(text):
            return self._look_up(_PIECES.findall(text.lower()), self.pieces, self._piece)
        return [e for e in self._look_up([w for w in _SPACES.split(text) if w], self.words, self._word) if e[0]]

    def encode(self, text: str | None) -> tuple[bytes, str]:
        """The ids as little-endian 32-bit integers, and the text that they decode to."""
        if not text:
            return b"", ""
        if self.specials and self.special.search(text):
            parts: list[tuple[bytes, str]] = []
            for part in self.special.split(text):
                if part in self.specials:
                    parts.append((np.int32(self.specials[part]).tobytes(), part))
                elif part:
                    parts += self._plain(part)
        else:
            parts = self._plain(text)
        return b"".join(map(itemgetter(0), parts)), " ".join(map(itemgetter(1), parts))

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.labels[i] for i in ids)


@cache
def encoder_of(path: str) -> Encoder:
    """One automaton for all tasks of a Python worker."""
    return Encoder(path)


def encode(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """df with `ids` (array<int>) and `decoded`, the text of the labels."""
    df = df.drop("ids", "decoded")
    at = df.columns.index(text_col)
    schema = T.StructType([*df.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder_of(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                made = [e.encode(t.as_py()) for t in part.column(at)]
                flat = np.frombuffer(b"".join([m[0] for m in made]), np.int32)
                ends = np.cumsum([0, *[len(m[0]) // 4 for m in made]]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array([m[1] for m in made], pa.string())], [f.name for f in schema])

    return df.mapInArrow(work, schema)


def decode_ids(df: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """df with `decoded`: the labels of the ids, joined by spaces; null ids give an empty text."""
    df = df.drop("decoded")
    at = df.columns.index(ids_col)
    schema = T.StructType([*df.schema.fields, T.StructField("decoded", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder_of(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([e.decode(x.as_py() or []) for x in batch.column(at)], pa.string())], [f.name for f in schema])

    return df.mapInArrow(work, schema)


def op12_merge_automaton(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = encode(docs, P.path("word_bpe_49k.json"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

"""Byte-level BPE: overlapping chunks are pre-tokenised in parallel, stitched where their boundaries meet again, then encoded.

A text of at most CHUNK code points is one chunk, pre-tokenised and encoded by pieces where it is. A longer one becomes rows of overlapping chunks, which Spark deals out where one text has many: each is
pre-tokenised and encoded on its own, and the rows of one text then meet as ids and numbers of ids a pre-token, in few bytes: as byte-level
ids hold every byte, the text is read off them. The pattern never looks behind, so two segmentations that share
one boundary agree from there on: chunk k is followed up to a boundary that chunk k+1 has too, and k+1 from there. Ends near
the end of a chunk, or in its last run of white space, are not trusted. Where an overlap holds no common boundary, the text
between is pre-tokenised again from the last trusted end, so the result is always that of the whole text. Pre-tokens that no chunk has are encoded there.
Decoding concatenates the raw bytes of the ids.

Edge cases: null text counts as empty (no ids, empty bytes). Repeated rows are encoded row by row. Columns called `ids` or
`decoded` are replaced; other columns are kept. Spark's strings are valid UTF-8, so the bytes come back as they were.
"""

from __future__ import annotations

import base64
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK, OVERLAP, MARGIN = 4_096, 256, 4
DEAL = 64  # chunks of one text that a task takes on
ROWS = 256  # that a worker holds results of; a batch can be a whole split of the input
_PIECES = 50_000


@cache
def load(path: str, pattern: str):
    """The encoder of a rank file, its pre-token pattern, and every id's bytes."""
    import regex
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    encoder = tiktoken.Encoding(path.rsplit("/", 1)[-1], pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return encoder, regex.compile(pattern)


@cache
def id_widths(path: str, pattern: str) -> np.ndarray:
    """Bytes of every id."""
    encoder, _ = load(path, pattern)
    out = np.zeros(encoder.n_vocab, np.int64)
    for i in encoder._mergeable_ranks.values():
        out[i] = len(encoder.decode_single_token_bytes(i))
    return out


def boundaries(pattern, text: str) -> list[int]:
    """Ends of the pre-tokens, in code points."""
    return [m.end() for m in pattern.finditer(text)]


def stitch(pattern, chunks: list[tuple[int, str, list[int]]]) -> list[int]:
    """Pre-token ends of a whole text from its chunks (start, text, own ends), ordered by start; consecutive chunks overlap."""
    out: list[int] = []
    start, text, ends = chunks[0]
    at = 0  # a true boundary; ends are absolute from here on
    ends = list(ends)
    for next_start, next_text, next_ends in chunks[1:]:
        safe = start + len(text.rstrip()) - MARGIN
        good = ends[bisect_right(ends, at) : bisect_right(ends, safe)]
        late = good[bisect_right(good, next_start - 1) :]
        theirs = {next_start, *(next_start + e for e in next_ends[: bisect_right(next_ends, safe - next_start)])}
        meet = next((e for e in late if e in theirs), None)
        if meet is not None:
            out += good[: bisect_right(good, meet)]
            start, text, ends, at = next_start, next_text, [next_start + e for e in next_ends], meet
            continue
        out += good
        at = out[-1] if out else 0
        text = text[at - start :] + next_text[start + len(text) - next_start :]
        start = at
        ends = [start + e for e in boundaries(pattern, text)]
    return out + [e for e in ends if e > at]


class _Known(dict):
    """Packed ids of pre-tokens; those not seen yet are encoded. Of those seen, the last _PIECES to twice as many are kept."""

    def __init__(self, owner: _Encoder):
        super().__init__()
        self.owner, self.before, self.code = owner, {}, np.dtype(owner.kind).char

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            ids = array(self.code, self.owner.encoder.encode_ordinary(piece)).tobytes()
        if len(self) >= _PIECES:
            self.before = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class _Encoder:
    def __init__(self, path: str, pattern: str):
        self.encoder, self.pattern = load(path, pattern)
        self.widths = id_widths(path, pattern)
        self.kind = np.uint16 if self.encoder.n_vocab <= 1 << 16 else np.int32
        self.known = _Known(self)

    def split(self, text: str) -> list[str]:
        """The pre-tokens, where the pattern takes in the whole text as the library's do; otherwise what lies between their ends."""
        out = self.pattern.findall(text) if not self.pattern.groups else []
        if sum(map(len, out)) != len(text):
            ends = boundaries(self.pattern, text)
            out = [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        return out

    def whole(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(map(self.known.__getitem__, self.split(text))), self.kind).tolist()

    def packed(self, text: str) -> tuple[bytes, bytes]:
        """Ids of a chunk, and how many each of its pre-tokens has."""
        found = list(map(self.known.__getitem__, self.split(text)))
        return b"".join(found), (np.fromiter(map(len, found), np.int32) // np.dtype(self.kind).itemsize).tobytes()

    def joined(self, starts: list[int], ids: list[bytes], counts: list[bytes]) -> tuple[str, np.ndarray]:
        """The text and the ids of overlapping chunks, each given by its start, its ids and the numbers of ids of its pre-tokens."""
        ids_of, counts_of = [np.frombuffer(x, self.kind) for x in ids], [np.frombuffer(x, np.int32) for x in counts]
        parts, texts, edges, length = [], [], [], 0
        for start, own, n in zip(starts, ids_of, counts_of, strict=True):
            raw = self.encoder.decode_bytes(own.tolist())
            points = np.concatenate(([0], np.cumsum(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80)))  # code points before each byte
            ends = points[np.concatenate(([0], np.cumsum(self.widths[own])))[np.cumsum(n)]]
            chunk = raw.decode()
            parts.append((start, chunk, ends.tolist()))
            edges.append(start + np.concatenate(([0], ends)))
            texts.append(chunk[length - start :])
            length = max(length, start + len(chunk))
        text = "".join(texts)
        ends = np.array(stitch(self.pattern, parts), np.int64)
        begins = np.concatenate(([0], ends[:-1]))
        # Pre-tokens of the whole text among those of the chunks, by begin and end.
        key = lambda a, b: a * (len(text) + 1) + b
        known = np.concatenate([key(e[:-1], e[1:]) for e in edges])
        first = np.concatenate(([0], np.cumsum(np.concatenate(counts_of))))
        by = np.argsort(known, kind="stable")
        at = by[np.minimum(np.searchsorted(known[by], key(begins, ends)), len(by) - 1)]
        found = known[at] == key(begins, ends)
        made = [np.frombuffer(self.known[text[a:b]], self.kind) for a, b in zip(begins[~found].tolist(), ends[~found].tolist(), strict=True)]
        flat = np.concatenate([*ids_of, *made]).astype(np.int32)
        more = np.concatenate(([0], np.cumsum([len(m) for m in made]))).astype(np.int64) + first[-1]
        lo, hi = first[at], first[at + 1]
        lo[~found], hi[~found] = more[:-1], more[1:]
        n = hi - lo
        return text, flat[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of ROWS rows."""
    return (batch.slice(lo, ROWS) for batch in batches for lo in range(0, batch.num_rows, ROWS))


def _lists(rows: list[list[int]]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    flat = np.concatenate([np.asarray(r, np.int32) for r in rows]) if rows else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, decode: bool = True) -> DataFrame:
    """df with `ids` (array<int>) and, if asked, `decoded` (the bytes that the ids stand for)."""
    if overlap >= chunk:
        raise ValueError("the overlap has to be shorter than a chunk")
    df = df.drop("ids", "decoded")
    names = df.columns
    at = names.index(text_col)
    added = [T.StructField("ids", T.ArrayType(T.IntegerType()))] + [T.StructField("decoded", T.BinaryType())] * decode
    schema = T.StructType([*df.schema.fields, *added])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _Encoder(path, pattern)
        for part in _parts(batches):
            ids = [e.whole(t.as_py() or "") for t in part.column(at)]
            more = [pa.array([e.encoder.decode_bytes(x) for x in ids], pa.binary())] if decode else []
            yield pa.RecordBatch.from_arrays([*part.columns, _lists(ids), *more], [f.name for f in schema])

    text = F.col(text_col)
    short = df.where(text.isNull() | (F.length(text) <= chunk)).mapInArrow(whole, schema)

    # Long texts: every chunk row holds the other columns too, so nothing has to be joined back. The chunks of one text go to many
    # tasks where that is more than DEAL of them; fewer are quicker encoded where they are read than moved.
    others = [c for c in names if c != text_col]
    length = F.length(text)

    def cut(rows: DataFrame, name: Column) -> DataFrame:
        starts = F.sequence(F.lit(0), length - 1, F.lit(chunk - overlap))
        return rows.withColumn("__row", name).withColumn("__at", F.explode(starts)).withColumn("__chunk", F.substring(text, F.col("__at") + 1, F.lit(chunk))).drop(text_col)

    row, most = F.monotonically_increasing_id(), chunk * DEAL
    dealt = cut(df.where(length > most), -1 - row).repartition("__row", "__at")
    chunks = cut(df.where((length > chunk) & (length <= most)), row), dealt

    n_others = len(others)  # the chunk rows have the other columns first, then __row, __at

    def encode_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _Encoder(path, pattern)
        for part in _parts(batches):
            made = [e.packed(t.as_py()) for t in part.column(n_others + 2)]
            columns = [*part.columns[: n_others + 2], pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*others, "__row", "__at", "__ids", "__counts"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted, so a text's chunks follow each other, here or in the next part."""
        e = _Encoder(path, pattern)
        rows = ((b, i, r) for b in _parts(batches) for i, r in enumerate(zip(*(b.column(n_others + j).to_pylist() for j in range(4)), strict=True)))
        for _, of in groupby(rows, key=lambda x: x[2][0]):
            parts = list(of)
            batch, i, _ = parts[0]
            whole_text, ids = e.joined(*(list(x) for x in list(zip(*(p[2] for p in parts), strict=True))[1:]))
            made = {c: batch.column(k).slice(i, 1) for k, c in enumerate(others)} | {text_col: pa.array([whole_text], pa.string()), "ids": _lists([ids])}
            if decode:
                made["decoded"] = pa.array([e.encoder.decode_bytes(ids.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([made[f.name] for f in schema], [f.name for f in schema])

    fields = [f for f in chunks[0].schema.fields if f.name != "__chunk"] + [T.StructField("__ids", T.BinaryType()), T.StructField("__counts", T.BinaryType())]
    packed = [c.select(*others, "__row", "__at", "__chunk").mapInArrow(encode_chunks, T.StructType(fields)) for c in chunks]
    meeting = packed[0].unionByName(packed[1]).repartition("__row").sortWithinPartitions("__row", "__at")
    stitched = meeting.mapInArrow(join, schema)
    return short.unionByName(stitched)


def decode_ids(df: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """df with `decoded`: the concatenated bytes of the ids; null ids give empty bytes."""
    df = df.drop("decoded")
    at = df.columns.index(ids_col)
    schema = T.StructType([*df.schema.fields, T.StructField("decoded", T.BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = load(path, pattern)
        for batch in batches:
            made = pa.array([encoder.decode_bytes(x.as_py() or []) for x in batch.column(at)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [f.name for f in schema])

    return df.mapInArrow(work, schema)


def op6_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = encode(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

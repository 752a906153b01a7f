"""Token-ID output: length-delimited binary records with masked checksums, and a separate offset index for shuffled reads.

A record is: data length (8 bytes, little-endian), masked CRC-32 of these 8 bytes (4), data (the ids, little-endian unsigned
integers of ITEM bytes), masked CRC-32 of the data (4). Masking turns the checksum right by 15 bits and adds a constant, so
that checksums of data that hold checksums stay telling. Files follow each other in ascending doc_id order (a range partition
each, nulls first) and are named by partition; the index is a Parquet table of (file, row, doc_id, at, n_bytes, n_tokens), one
row per record, so a reader can take records in any order or any subset.

Executors write through pyarrow's file systems to a temporary name and rename it when the file is complete: a task that runs again
(lost executor, speculation) replaces the same bytes. Only one number per file goes to the driver.

Edge cases: null text counts as empty and holds the end id alone. The strings of special tokens get their ids, as in the library. Repeated rows are separate records, in an order made
definite by the text's hash. An empty table gives an empty index. Columns other than doc_id and text are not written.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path

END_ID, ITEM = 2, 2
MASK = 0xA282EAD8
INDEX = "file string, row long, doc_id long, at long, n_bytes long, n_tokens long"
_WORDS = 200_000


def masked_crc(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    head = struct.pack("<Q", len(data))
    return b"".join((head, struct.pack("<I", masked_crc(head)), data, struct.pack("<I", masked_crc(data))))


def unframe(record: bytes) -> bytes:
    (n,) = struct.unpack_from("<Q", record)
    if masked_crc(record[:8]) != struct.unpack_from("<I", record, 8)[0] or len(record) != n + 16:
        raise ValueError("broken record length")
    data = record[12 : 12 + n]
    if masked_crc(data) != struct.unpack_from("<I", record, 12 + n)[0]:
        raise ValueError("broken record data")
    return data


# Latin letters that lower-case one to one and that normalisation leaves alone; texts of these and plain ASCII are simple.
_LETTERS = "a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u01ef\u01f1-\u024f"
_SIMPLE = re.compile(f"[\t\n\r -~{_LETTERS}]*")
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}\u2c65\u2c66]+|[0-9]|[^\\s0-9{_LETTERS}\u2c65\u2c66]+")  # of lower-cased simple texts
_SPACES = str.maketrans("\t\n\r\f\v", "     ")


class WordEncoder:
    """Texts to the bytes of their ids. Pieces that the tokenizer never joins are encoded once and looked up.

    In a simple text these are its pre-tokens (`[letters]+`, one digit, other characters, contractions); they go to the
    library many at a time, each ending at the first word-final id. Any other text is cut at ASCII white space only, and the
    library normalises and splits the words itself. Texts that hold a special token's string go to the library whole, which
    cuts them at these strings before all else and gives their ids.
    """

    def __init__(self, path: str, item: int = ITEM):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)", re.IGNORECASE)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.final = np.zeros(max(vocabulary.values()) + 1, bool)
        self.final[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.dtype = {2: "<u2", 4: "<u4"}[item]
        self.pieces, self.words = _Recent(), _Recent()

    def _alone(self, words: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _together(self, pieces: list[str]) -> list[bytes]:
        parts = [pieces[lo : lo + 256] for lo in range(0, len(pieces), 256)]
        out: list[bytes] = []
        for part, e in zip(parts, self.tokenizer.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.asarray(e.ids, self.dtype)
            ends = np.flatnonzero(self.final[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                raw, at = ids.tobytes(), [0, *(ends * ids.itemsize).tolist()]
                out += [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            else:
                out += self._alone(part)
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        odd = [i for i, t in enumerate(texts) if t and self.special.search(t)]
        if odd:
            plain, texts = list(texts), [None if i in set(odd) else t for i, t in enumerate(texts)]
            out = self.encode(texts)
            for i, data in zip(odd, self._alone([plain[i] for i in odd]), strict=True):
                out[i] = data
            return out
        simple = [t is not None and _SIMPLE.fullmatch(t) is not None for t in texts]
        cut = [_PIECES.findall(t.lower()) if plain else (t or "").translate(_SPACES).split(" ") for t, plain in zip(texts, simple, strict=True)]
        self.pieces.add(set().union(*(c for c, plain in zip(cut, simple, strict=True) if plain)), self._together)
        self.words.add(set().union(*(c for c, plain in zip(cut, simple, strict=True) if not plain)), self._alone)
        return [b"".join(map((self.pieces if plain else self.words).new.__getitem__, c)) for c, plain in zip(cut, simple, strict=True)]


class _Recent:
    """What was looked up lately: once full, the entries move to an older half, from which they return when met again."""

    def __init__(self):
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def add(self, keys: set[str], make) -> None:
        if len(self.new) > _WORDS:
            self.new, self.old = {}, self.new
        new, old = self.new, self.old
        missing = []
        for k in keys:
            if k not in new:
                if k in old:
                    new[k] = old[k]
                else:
                    missing.append(k)
        new.update(zip(missing, make(missing), strict=True))


@cache
def encoder_of(path: str, item: int) -> WordEncoder:
    """One encoder for all tasks of a Python worker."""
    return WordEncoder(path, item)


def _open(root: str) -> tuple[pafs.FileSystem, str]:
    """The folder's file system. Hadoop's names of object stores are those of the same stores here."""
    scheme, mark, rest = root.partition("://")
    return pafs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3", "abfss": "abfs"}.get(scheme, scheme) + mark + rest)


def write_tokens(docs: DataFrame, root: str, path: str, end_id: int = END_ID, item: int = ITEM) -> DataFrame:
    """Encode (doc_id, text), write the record files under root/records and the index under root/index; the index."""
    spark = docs.sparkSession
    fs, base = _open(root)
    fs.create_dir(f"{base}/records", recursive=True)
    end = int(end_id).to_bytes(item, "little")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, store = encoder_of(path, item), _open(root)
        out_fs, out_base = store
        name = f"part-{TaskContext.get().partitionId():06d}.rec"
        temporary = f"{out_base}/records/.{name}.{uuid.uuid4().hex}"
        at = row = 0
        with out_fs.open_output_stream(temporary) as f:
            for batch in batches:
                for lo in range(0, batch.num_rows, 64):
                    part = batch.slice(lo, 64)
                    lengths, sizes, blob = [], [], []
                    for data in encoder.encode(part.column(1).to_pylist()):
                        record = frame(data + end)
                        blob.append(record)
                        sizes.append(len(record))
                        lengths.append(len(data) // item + 1)
                    f.write(b"".join(blob))
                    n = part.num_rows
                    offsets = at + np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64) if n else np.zeros(0, np.int64)
                    columns = [pa.array([name] * n, pa.string()), pa.array(np.arange(row, row + n)), part.column(0), pa.array(offsets), pa.array(sizes, pa.int64()), pa.array(lengths, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["file", "row", "doc_id", "at", "n_bytes", "n_tokens"])
                    at, row = at + sum(sizes), row + n
        out_fs.move(temporary, f"{out_base}/records/{name}")

    dealt = docs.select("doc_id", "text").repartitionByRange(F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), F.xxhash64("text"))
    dealt.mapInArrow(work, INDEX).write.mode("overwrite").parquet(f"{root}/index")
    return read_index(spark, root)


def read_index(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{root}/index")


def read_tokens(index: DataFrame, root: str, item: int = ITEM) -> DataFrame:
    """The index's records with `ids` (bytes of little-endian unsigned 32-bit integers), checked against both checksums."""
    dtype = {2: "<u2", 4: "<u4"}[item]
    names = [*index.columns, "ids"]
    file_at, at_at, n_at = (index.columns.index(c) for c in ("file", "at", "n_bytes"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(root)
        name, f = None, None
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part, out = batch.slice(lo, 512), []
                for file, at, n in zip(*(part.column(i).to_pylist() for i in (file_at, at_at, n_at)), strict=True):
                    if file != name:
                        if f:
                            f.close()
                        name, f = file, fs.open_input_file(f"{base}/records/{file}")
                    out.append(np.frombuffer(unframe(f.read_at(n, at)), dtype).astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names)
        if f:
            f.close()

    from pyspark.sql import types as T

    return index.mapInArrow(work, T.StructType([*index.schema.fields, T.StructField("ids", T.BinaryType())]))


def with_starts(index: DataFrame) -> DataFrame:
    """index with `start`: the ids of all records before. One sum per file passes the driver; the rest is a window within each file."""
    from pyspark.sql import Window

    spark = index.sparkSession
    totals = index.groupBy("file").agg(F.sum("n_tokens").alias("n")).orderBy("file").toPandas()
    before = totals["n"].cumsum() - totals["n"]
    offsets = spark.createDataFrame(list(zip(totals["file"].tolist(), before.astype(int).tolist(), strict=True)), "file string, file_start long")
    running = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("row")) - F.col("n_tokens")
    joined = index.join(F.broadcast(offsets), "file")  # one row per file
    return joined.withColumn("start", F.col("file_start") + running).drop("file_start")


def op8_token_records(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    root = shared_path(spark, "tokens")
    index = write_tokens(docs, root, P.path("word_bpe_49k.json"))
    got = read_tokens(with_starts(index), root)
    return got.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

"""Mesh, tree, seed and octree files: readers by byte ranges, and writers whose parts are streamed into one file.

Formats (little-endian). `.tb`: int32 counts of triangles and vertices, then rows of a, b, c, label (int32) and of x, y, z (float32), label
(int32). `.bin`: a float32 time, int32 counts of vertices and triangles, x, y, z, then a, b, c, no labels. `.t`: the counts and rows of `.tb`
as text without labels, then, if any, all triangles' labels and all vertices'. `.ctb`: int32 count of nodes, a node as id, its neighbours
above and below, each list after its length. `.dfo`: an octree depth first, a node as a byte of flags (1: eight children follow,
2: never merged, 4: unknown, 8: carved) and a float32. Seeds: text, a count, then seed, first and last slice of its window.

Rows of fixed length are read by ranges of rows. Text is read by ranges of bytes: a first pass counts each range's words, so that the
second knows which numbers it holds. Nodes of a tree have any length, so a first pass streams over the lengths and marks a start every
`NODES` nodes. A depth-first octree can only be read from its start: one task streams it, with a stack of one entry a level.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.order import numbered
from .shared import written
from .volumes import _store

ROWS, BYTES, NODES = 1 << 18, 1 << 22, 1 << 14
TRIANGLES, VERTICES = "t long, a long, b long, c long, label int", "v long, x double, y double, z double, label int"
TREE, OCTREE = "id long, up array<long>, down array<long>", "level int, ix long, iy long, iz long, value double, flags int"


def _counts(path: str, suffix: str) -> tuple[int, int, int]:
    """Triangles, vertices, and the size of the head."""
    store, at = _store(path)
    with store.open_input_file(at) as f:
        if suffix == ".bin":
            _, nv, nt = struct.unpack("<fii", f.read(12))
            return nt, nv, 12
        return *struct.unpack("<ii", f.read(8)), 8


def _fixed(spark: SparkSession, path: str, n: int, start: int, kind: np.dtype, make: Callable, schema: str) -> DataFrame:
    """Rows of a fixed length from `start` on, a range of rows a task."""

    step = ROWS

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, at = _store(path)
        with store.open_input_file(at) as f:
            for pdf in batches:
                for k in pdf["id"]:
                    a, b = int(k) * step, min(n, (int(k) + 1) * step)
                    f.seek(start + a * kind.itemsize)
                    yield make(np.arange(a, b), np.frombuffer(f.read((b - a) * kind.itemsize), kind))

    return spark.range(-(-n // step)).mapInPandas(work, schema)


def read_mesh(spark: SparkSession, path: str, suffix: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(TRIANGLES, VERTICES) of a mesh file."""
    suffix = suffix or "." + path.rsplit(".", 1)[1]
    if suffix == ".t":
        return _read_text(spark, path)
    nt, nv, head = _counts(path, suffix)
    labelled = suffix == ".tb"
    tri = np.dtype([("p", "<i4", 3)] + [("label", "<i4")] * labelled)
    ver = np.dtype([("p", "<f4", 3)] + [("label", "<i4")] * labelled)
    frame = lambda names: lambda at, rows: pd.DataFrame({names[0]: at, **{c: rows["p"][:, i].astype(float if c in "xyz" else "int64") for i, c in enumerate(names[1:])}, "label": rows["label"] if labelled else np.int32(0)})
    tris_at = head if labelled else head + nv * ver.itemsize
    verts_at = head + nt * tri.itemsize if labelled else head
    return _fixed(spark, path, nt, tris_at, tri, frame("tabc"), TRIANGLES), _fixed(spark, path, nv, verts_at, ver, frame("vxyz"), VERTICES)


def _words(f, size: int, k: int, step: int) -> list[bytes]:
    """The words that start in the k-th range of bytes."""
    a, b = k * step, min(size, (k + 1) * step)
    f.seek(max(0, a - 1))
    data = f.read(b - max(0, a - 1))
    if a:
        inside = not data[:1].isspace()  # the word before the range goes on into it
        data = data[1:]
        if inside:
            cut = next((i for i, c in enumerate(data) if chr(c).isspace()), len(data))
            data = data[cut:]
    words = data.split()
    if words and not data[-1:].isspace():  # the last word's end lies beyond the range
        while more := f.read(64):
            cut = next((i for i, c in enumerate(more) if chr(c).isspace()), len(more))
            words[-1] += more[:cut]
            if cut < len(more):
                break
    return words


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """(index long, value double) of the numbers of a text file: their places from its start."""
    store, at = _store(path)
    size, step = store.get_file_info(at).size, BYTES
    n = -(-size // step)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, at = _store(path)
        with store.open_input_file(at) as f:
            for pdf in batches:
                yield pd.DataFrame({"k": pdf["id"], "n": [len(_words(f, size, int(k), step)) for k in pdf["id"]]})

    counted = spark.range(n).repartition(max(1, min(n, 256)), "id").mapInPandas(count, "k long, n long")
    first = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("k", F.coalesce(F.sum("n").over(first), F.lit(0)).alias("first"))  # a row for each range

    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, at = _store(path)
        with store.open_input_file(at) as f:
            for pdf in batches:
                for k, base in zip(pdf["k"], pdf["first"], strict=True):
                    word = np.array(_words(f, size, int(k), step), object).astype(float)
                    yield pd.DataFrame({"index": base + np.arange(len(word)), "value": word})

    return starts.repartition(max(1, min(n, 256)), "k").mapInPandas(values, "index long, value double")


def first_words(path: str, n: int) -> list[int]:
    """The whole numbers that a text file begins with."""
    store, at = _store(path)
    with store.open_input_file(at) as f:
        return [int(w) for w in _words(f, store.get_file_info(at).size, 0, 256)[:n]]


def _read_text(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    nt, nv = first_words(path, 2)
    edges = np.cumsum([2, 3 * nt, 3 * nv, nt, nv]).tolist()  # corners, places, both kinds' labels
    index = F.col("index")
    part = F.when(index < edges[0], -1).when(index < edges[1], 0).when(index < edges[2], 1).when(index < edges[3], 2).when(index < edges[4], 3).otherwise(-1)
    off = index - F.element_at(F.array(*[F.lit(e) for e in edges[:4]]), F.col("part") + 1)
    wide = F.when(F.col("part") < 2, 3).otherwise(1)
    cells = read_words(spark, path).withColumn("part", part).where("part >= 0").withColumn("off", off)
    col = F.when(F.col("part") < 2, F.col("off") % 3).otherwise(3)
    rows = cells.select((F.col("part") % 2 == 1).alias("vertex"), F.floor(F.col("off") / wide).alias("row"), col.alias("col"), "value")
    rows = rows.groupBy("vertex", "row").agg(*[F.max(F.when(F.col("col") == i, F.col("value"))).alias(f"c{i}") for i in range(4)])
    label = F.coalesce("c3", F.lit(0)).cast("int").alias("label")
    pick = lambda vertex, names, kind: rows.where(F.col("vertex") == vertex).select(F.col("row").alias(names[0]), *[F.col(f"c{i}").cast(kind).alias(c) for i, c in enumerate(names[1:])], label)
    return pick(False, "tabc", "long"), pick(True, "vxyz", "double")


def _joined(parts: DataFrame, path: str, head: bytes) -> None:
    """Write a file: the head, then the parts (part long, data binary) in order. Tasks write a file each, one task streams them together
    under a hidden name, and renames it."""
    store, at = _store(path)
    folder = f"{at}.parts-{uuid.uuid4().hex}"
    store.create_dir(folder, recursive=True)

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, _ = _store(path)
        for pdf in batches:
            for k, data in zip(pdf["part"], pdf["data"], strict=True):
                hidden = f"{folder}/.{k:012d}.{uuid.uuid4().hex}"
                with out.open_output_stream(hidden) as f:
                    f.write(data)
                out.move(hidden, f"{folder}/{k:012d}")
            yield pd.DataFrame({"part": pdf["part"]})

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, _ = _store(path)
        hidden = f"{at}.{uuid.uuid4().hex}"
        with out.open_output_stream(hidden) as f:
            f.write(head)
            for pdf in batches:
                for k in pdf["part"]:
                    with out.open_input_stream(f"{folder}/{k:012d}") as part:
                        while block := part.read(BYTES):
                            f.write(block)
        out.move(hidden, at)
        yield pd.DataFrame({"part": [0]})

    done, _ = written(parts.mapInPandas(put, "part long"), "file-parts")  # a row a part
    done.repartition(1).sortWithinPartitions("part").mapInPandas(join, "part long").count()
    store.delete_dir(folder)


def _parts(rows: DataFrame, keys: list[str], make: Callable[[pd.DataFrame], bytes], first: int = 0) -> DataFrame:
    """(part, data) of rows in the order of the keys, ROWS of them a part."""
    placed = numbered(rows, [F.col(k) for k in keys], "__n").withColumn("part", F.floor(F.col("__n") / ROWS) + first)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "data": [make(pdf.sort_values("__n"))]})

    return placed.groupBy("part").applyInPandas(work, "part long, data binary")


def write_mesh(tris: DataFrame, verts: DataFrame, path: str, suffix: str | None = None, time: float = 0.0) -> None:
    """Write TRIANGLES over dense vertex numbers and VERTICES; `.tb` and `.t` with labels."""
    suffix = suffix or "." + path.rsplit(".", 1)[1]
    nt, nv = tris.count(), verts.count()
    after = -(-nt // ROWS) + 1
    pack = lambda pdf, names, kind: pdf[list(names)].to_numpy().astype(kind)
    if suffix == ".t":
        line = lambda names: lambda pdf: "".join(" ".join(f"{v:.9g}" for v in row) + "\n" for row in pdf[list(names)].to_numpy()).encode()
        far = after + -(-nv // ROWS) + 1
        parts = [_parts(tris, ["t"], line("abc")), _parts(verts, ["v"], line("xyz"), after), _parts(tris, ["t"], line(["label"]), far), _parts(verts, ["v"], line(["label"]), far + after)]
        joined = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
        return _joined(joined, path, f"{nt} {nv}\n".encode())

    def labelled(names: str, kind: str):
        def make(pdf: pd.DataFrame) -> bytes:
            out = np.empty(len(pdf), np.dtype([("p", kind, 3), ("label", "<i4")]))
            out["p"], out["label"] = pack(pdf, names, kind), pdf["label"]
            return out.tobytes()

        return make

    if suffix == ".tb":
        return _joined(_parts(tris, ["t"], labelled("abc", "<i4")).unionByName(_parts(verts, ["v"], labelled("xyz", "<f4"), after)), path, struct.pack("<ii", nt, nv))
    plain = lambda names, kind: lambda pdf: pack(pdf, names, kind).tobytes()
    before = -(-nv // ROWS) + 1
    _joined(_parts(verts, ["v"], plain("xyz", "<f4")).unionByName(_parts(tris, ["t"], plain("abc", "<i4"), before)), path, struct.pack("<fii", time, nv, nt))


def write_tree(rows: DataFrame, path: str) -> None:
    """Write TREE in the order of the ids."""

    def make(pdf: pd.DataFrame) -> bytes:
        out: list[int] = []
        for i, up, down in zip(pdf["id"], pdf["up"], pdf["down"], strict=True):
            out += [i, len(up), *up, len(down), *down]
        return np.asarray(out, "<i4").tobytes()

    _joined(_parts(rows, ["id"], make), path, struct.pack("<i", rows.count()))


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """TREE of a tree file."""

    most = NODES

    def starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _ in pdf["id"]:
                store, at = _store(path)
                with store.open_input_stream(at, buffer_size=BYTES) as f:
                    (left,), place = struct.unpack("<i", f.read(4)), 4
                    while left:
                        n, begin = min(left, most), place
                        for _ in range(n):
                            _, up = struct.unpack("<ii", f.read(8))
                            f.read(4 * up)
                            (down,) = struct.unpack("<i", f.read(4))
                            f.read(4 * down)
                            place += 12 + 4 * (up + down)
                        left -= n
                        yield pd.DataFrame({"at": [begin], "end": [place]})

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, at = _store(path)
        with store.open_input_file(at) as f:
            for pdf in batches:
                for a, b in zip(pdf["at"], pdf["end"], strict=True):
                    f.seek(a)
                    data, i, out = np.frombuffer(f.read(b - a), "<i4").tolist(), 0, []
                    while i < len(data):
                        up = data[i + 1]
                        down = data[i + 2 + up]
                        out.append((data[i], data[i + 2 : i + 2 + up], data[i + 3 + up : i + 3 + up + down]))
                        i += 3 + up + down
                    yield pd.DataFrame(out, columns=["id", "up", "down"])

    marks = spark.range(1).mapInPandas(starts, "at long, end long")
    return marks.repartition(max(1, spark.sparkContext.defaultParallelism), "at").mapInPandas(work, TREE)


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """(seed, first, last) of a seed file; its first line, the count, has one word."""
    words = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("w")).where(F.size("w") == 3)
    return words.select(*[F.col("w")[i].cast("long").alias(n) for i, n in enumerate(("seed", "first", "last"))])


def read_octree(spark: SparkSession, path: str) -> DataFrame:
    """OCTREE of a depth-first file: the root has level 0; child k of a node lies at (2 ix + k % 2, 2 iy + k // 2 % 2, 2 iz + k // 4)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _ in pdf["id"]:
                store, at = _store(path)
                with store.open_input_stream(at, buffer_size=BYTES) as f:
                    stack, out = [(0, 0, 0, 0)], []
                    while stack:
                        level, x, y, z = stack.pop()
                        flags, value = struct.unpack("<Bf", f.read(5))
                        out.append((level, x, y, z, value, flags))
                        if flags & 1:
                            stack += [(level + 1, 2 * x + k % 2, 2 * y + k // 2 % 2, 2 * z + k // 4) for k in range(7, -1, -1)]
                        if len(out) == NODES:
                            yield pd.DataFrame(out, columns=[c.split()[0] for c in OCTREE.split(", ")])
                            out = []
                    yield pd.DataFrame(out, columns=[c.split()[0] for c in OCTREE.split(", ")])

    return spark.range(1).mapInPandas(work, OCTREE)


def write_octree(nodes: DataFrame, depth: int, path: str) -> None:
    """Write OCTREE (flag 1 is set where a node has children) depth first: nodes are ordered by their path, eight children a step."""
    step = lambda level: F.when(F.col("level") >= level, sum((F.call_function("shiftright", F.col(a), F.col("level") - level).bitwiseAND(F.lit(1)) * (1 << i) for i, a in enumerate(("ix", "iy", "iz"))), F.lit(0)) + 1).otherwise(0)

    def make(pdf: pd.DataFrame) -> bytes:
        out = np.empty(len(pdf), np.dtype([("flags", "u1"), ("value", "<f4")]))
        out["flags"], out["value"] = pdf["flags"], pdf["value"]
        return out.tobytes()

    way = nodes.withColumns({f"__{k}": step(k) for k in range(1, depth + 1)})
    _joined(_parts(way, [f"__{k}" for k in range(1, depth + 1)] or ["level"], make), path, b"")

"""Volume files: readers and writers of the binary grid formats, one file for each slab of slices.

Formats (little-endian): `.v` three int32 sizes and float32 values; `.vb` the same with uint8; `.v4d` four sizes and float32;
`.vo` three sizes and int32 ranks; `.v2` three sizes, then two bitmaps (positive, known) of (n + 8) div 8 bytes, lowest bit first.
A slab is a whole file of its own, so no task holds a volume; its first slice is in its name.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .grids import Dims, address, coordinates

TYPES = {".v": np.dtype("<f4"), ".vb": np.dtype("u1"), ".v4d": np.dtype("<f4"), ".v4db": np.dtype("u1"), ".vo": np.dtype("<i4"), ".vo4d": np.dtype("<i4"), ".raw": np.dtype("<u2")}
FOUR = {".v4d", ".v4db", ".vo4d"}  # formats with a fourth size, the steps
CELLS = 1 << 20  # cells that a task reads at a time


def encode(suffix: str, sizes: tuple[int, ...], values: np.ndarray, known: np.ndarray | None = None) -> bytes:
    sizes = (*sizes, 1)[: 4 if suffix in FOUR else 3] if len(sizes) < 4 else sizes
    head = np.asarray(sizes, "<i4").tobytes()
    if suffix == ".raw":
        return values.astype(TYPES[suffix]).tobytes()
    if suffix != ".v2":
        return head + values.astype(TYPES[suffix]).tobytes()
    n = int(np.prod(sizes))
    maps = (values >= 0, np.ones(n, bool) if known is None else known)
    return head + b"".join(np.packbits(m, bitorder="little").tobytes().ljust((n + 8) // 8, b"\0") for m in maps)


def decode(suffix: str, data: bytes) -> tuple[tuple[int, ...], np.ndarray]:
    """Sizes and values; `.v2` gives 1, -1 and, where unknown, 0."""
    k = 4 if suffix in FOUR else 3
    sizes = tuple(np.frombuffer(data, "<i4", k).tolist())
    n = int(np.prod(sizes))
    if suffix != ".v2":
        return sizes, np.frombuffer(data, TYPES[suffix], n, 4 * k)
    size = (n + 8) // 8
    positive, known = (np.unpackbits(np.frombuffer(data, np.uint8, size, 12 + i * size), count=n, bitorder="little").astype(bool) for i in (0, 1))
    return sizes, np.where(known, np.where(positive, 1, -1), 0)


def write_slabs(cells: DataFrame, dims: Dims, root: str, suffix: str, slices: int = 12) -> DataFrame:
    """Write (id, z, val) as files of that many slices; (slab, n) of what was written."""
    fs, base = _store(root)
    fs.create_dir(base, recursive=True)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        slab = int(pdf["slab"].iloc[0])
        deep = len(pdf) // dims.slice
        data = encode(suffix, (dims.nx, dims.ny, deep), pdf["val"].to_numpy())
        store, at = _store(root)
        name, hidden = f"{at}/slab-{slab * slices:06d}{suffix}", f"{at}/.slab-{slab * slices:06d}{suffix}.{uuid.uuid4().hex}"
        if suffix == ".raw":  # first, so that no volume is ever without its sizes
            with store.open_output_stream(f"{name}.header") as f:
                f.write(f"{dims.nx} {dims.ny} {deep}\n".encode())
        with store.open_output_stream(hidden) as f:
            f.write(data)
        store.move(hidden, name)
        return pd.DataFrame({"slab": [slab], "n": [len(pdf)]})

    keyed = cells.select("id", "val", F.floor(F.col("z") / slices).alias("slab"))
    return keyed.groupBy("slab").applyInPandas(work, "slab long, n long")


def read_slabs(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """(id, val double) of all slabs of a folder."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                sizes, values = (sizes_of(path, suffix)[0], np.frombuffer(content, TYPES[suffix])) if suffix == ".raw" else decode(suffix, content)
                first = int(path.rsplit("slab-", 1)[1].split(".")[0])
                yield pd.DataFrame({"id": first * sizes[0] * sizes[1] + np.arange(len(values)), "val": values.astype(float)})

    files = spark.read.format("binaryFile").option("pathGlobFilter", f"slab-*{suffix}").load(root)
    return files.select("path", "content").mapInPandas(work, "id long, val double")


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """The path's file system. Hadoop's names of object stores are those of the same stores here."""
    if path.startswith("file:/") and not path.startswith("file://"):  # as Spark names local files
        path = "file://" + path[5:]
    scheme, mark, rest = path.partition("://")
    return pafs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3", "abfss": "abfs"}.get(scheme, scheme) + mark + rest)


def sizes_of(path: str, suffix: str) -> tuple[tuple[int, ...], int]:
    """A file's sizes and the offset of its values. `.raw` has its sizes as text in `<file>.header`."""
    store, at = _store(path)
    if suffix == ".raw":
        with store.open_input_file(f"{at}.header") as f:
            return tuple(int(w) for w in f.read().split()[:3]), 0
    k = 4 if suffix in FOUR else 3
    with store.open_input_file(at) as f:
        return tuple(np.frombuffer(f.read(4 * k), "<i4").tolist()), 4 * k


def read_volume(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(id, x, y, z[, t], val double[, known]) of one file of any name, read by ranges of its cells: only the sizes pass the driver.
    `.v2` gives the signs and whether they are known."""
    sizes, start = sizes_of(path, suffix)
    n = int(np.prod(sizes))
    bitmap = (n + 8) // 8

    def bits(f, base: int, a: int, b: int) -> np.ndarray:
        f.seek(base + a // 8)
        raw = np.frombuffer(f.read((b + 7) // 8 - a // 8), np.uint8)
        return np.unpackbits(raw, bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, at = _store(path)
        with store.open_input_file(at) as f:
            for pdf in batches:
                for k in pdf["id"]:
                    a, b = int(k) * CELLS, min(n, (int(k) + 1) * CELLS)
                    if suffix == ".v2":
                        positive, known = bits(f, start, a, b), bits(f, start + bitmap, a, b)
                        yield pd.DataFrame({"id": np.arange(a, b), "val": np.where(positive, 1.0, -1.0), "known": known})
                        continue
                    kind = TYPES[suffix]
                    f.seek(start + a * kind.itemsize)
                    yield pd.DataFrame({"id": np.arange(a, b), "val": np.frombuffer(f.read((b - a) * kind.itemsize), kind).astype(float), "known": True})

    chunks = spark.range(-(-n // CELLS)) if n else spark.range(0)
    cells = chunks.mapInPandas(work, "id long, val double, known boolean")
    dims = Dims(*sizes[:3], sizes[3] if len(sizes) > 3 else 1)
    return cells.select("id", *coordinates(dims), "val", *(["known"] if suffix == ".v2" else []))


def _ranges(spark: SparkSession, path: str, start: int, n: int, kind: np.dtype) -> DataFrame:
    """(id, val double) of n values from `start` on, read by ranges."""
    step = CELLS

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, at = _store(path)
        with store.open_input_file(at) as f:
            for pdf in batches:
                for k in pdf["id"]:
                    a, b = int(k) * step, min(n, (int(k) + 1) * step)
                    f.seek(start + a * kind.itemsize)
                    yield pd.DataFrame({"id": np.arange(a, b), "val": np.frombuffer(f.read((b - a) * kind.itemsize), kind).astype(float)})

    return spark.range(-(-n // step)).mapInPandas(work, "id long, val double")


def read_big_endian(spark: SparkSession, path: str) -> DataFrame:
    """(id, x, y, z, val) of a `.v` file in the other byte order, which holds distances: densities here, so negated, its slices from the last to the first."""
    store, at = _store(path)
    with store.open_input_file(at) as f:
        dims = Dims(*np.frombuffer(f.read(12), ">i4").tolist())
    cells = _ranges(spark, path, 12, dims.n, np.dtype(">f4")).select("id", *coordinates(dims), "val")
    turned = cells.withColumn("z", (dims.nz - 1 - F.col("z")).cast("int"))
    return turned.select(address(dims).alias("id"), "x", "y", "z", (-F.col("val")).alias("val"))


def read_analyze(spark: SparkSession, path: str) -> DataFrame:
    """(id, x, y, z, val) of an image file of bytes whose sizes are in the `.hdr` file beside it (big-endian shorts from byte 42 on)."""
    base = path.removesuffix(".hdr").removesuffix(".img")
    store, at = _store(f"{base}.hdr")
    with store.open_input_file(at) as f:
        f.seek(42)
        dims = Dims(*np.frombuffer(f.read(6), ">i2").tolist())
    return _ranges(spark, f"{base}.img", 0, dims.n, np.dtype("u1")).select("id", *coordinates(dims), "val")


def read_dat(spark: SparkSession, path: str) -> DataFrame:
    """(id, x, y, z, val) of a text volume: three sizes, then the values with x slowest."""
    from .mesh_files import first_words, read_words

    dims = Dims(*first_words(path, 3))
    i = F.col("index") - 3
    places = [F.floor(i / (dims.ny * dims.nz)).cast("int").alias("x"), (F.floor(i / dims.nz) % dims.ny).cast("int").alias("y"), (i % dims.nz).cast("int").alias("z")]
    cells = read_words(spark, path).where(i.between(0, dims.n - 1)).select(*places, F.col("value").alias("val"))
    return cells.select(address(dims).alias("id"), "x", "y", "z", "val")


def read_bitmaps(spark: SparkSession, path: str, n: int, count: int = 1, start: int = 0) -> DataFrame:
    """(id, bit0, bit1, ...) of bitmaps that follow each other, (n + 8) div 8 bytes each, lowest bit first; of a carving the last one counts."""
    step, size = CELLS, (n + 8) // 8

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, at = _store(path)
        with store.open_input_file(at) as f:
            for pdf in batches:
                for k in pdf["id"]:
                    a, b = int(k) * step, min(n, (int(k) + 1) * step)  # whole bytes, as the step is a multiple of 8
                    out = {"id": np.arange(a, b)}
                    for c in range(count):
                        f.seek(start + c * size + a // 8)
                        out[f"bit{c}"] = np.unpackbits(np.frombuffer(f.read((b - a + 7) // 8), np.uint8), bitorder="little")[: b - a].astype(bool)
                    yield pd.DataFrame(out)

    return spark.range(-(-n // step)).mapInPandas(work, "id long, " + ", ".join(f"bit{c} boolean" for c in range(count)))


def write_bitmaps(cells: DataFrame, columns: list[str], n: int, path: str) -> None:
    """Write boolean columns of (id, ...), a bit for each of n cells, as bitmaps that follow each other."""
    from .mesh_files import _joined

    step, size = CELLS, (n + 8) // 8
    last = -(-n // step) - 1

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["k"].iloc[0])
        own = min(n, (k + 1) * step) - k * step
        rows = []
        for c, name in enumerate(columns):
            bits = np.zeros(own, bool)
            bits[pdf["id"].to_numpy() - k * step] = pdf[name].to_numpy(bool)
            data = np.packbits(bits, bitorder="little").tobytes()
            rows.append((c * (last + 1) + k, data.ljust(size - last * step // 8, b"\0") if k == last else data))
        return pd.DataFrame(rows, columns=["part", "data"])

    parts = cells.select("id", *columns, F.floor(F.col("id") / step).alias("k")).groupBy("k").applyInPandas(pack, "part long, data binary")
    _joined(parts, path, b"")


def write_steps(cells: DataFrame, dims: Dims, root: str, suffix: str) -> DataFrame:
    """Write (id, t, val) as one file a step (a series of one step, `step-<t>`), whole steps being a task's unit; (t, n) of what was written."""
    fs, base = _store(root)
    fs.create_dir(base, recursive=True)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, t = pdf.sort_values("id"), int(pdf["t"].iloc[0])
        store, at = _store(root)
        hidden = f"{at}/.step-{t:06d}{suffix}.{uuid.uuid4().hex}"
        with store.open_output_stream(hidden) as f:
            f.write(encode(suffix, (dims.nx, dims.ny, dims.nz, 1), pdf["val"].to_numpy()))
        store.move(hidden, f"{at}/step-{t:06d}{suffix}")
        return pd.DataFrame({"t": [t], "n": [len(pdf)]})

    return cells.select("id", "t", "val").groupBy("t").applyInPandas(work, "t long, n long")


def tree_rows(edges: DataFrame) -> DataFrame:
    """(id, up, down): one row for each node with its neighbours above and below, the layout of tree files."""
    down = edges.where("upper is not null").groupBy(F.col("upper").alias("id")).agg(F.array_sort(F.collect_list("node")).alias("down"))
    up = edges.select(F.col("node").alias("id"), F.array_compact(F.array("upper")).alias("up"))
    return up.join(down, "id", "left").withColumn("down", F.coalesce("down", F.array().cast("array<bigint>")))


def read_steps(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """(t, id, val) of the step files of a folder, stacked to a series: t is in a file's name, id is that of the whole series."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                sizes, values = decode(suffix, content)
                t = int(path.rsplit("step-", 1)[1].split(".")[0])
                yield pd.DataFrame({"t": t, "id": t * int(np.prod(sizes[:3])) + np.arange(len(values)), "val": values.astype(float)})

    files = spark.read.format("binaryFile").option("pathGlobFilter", f"step-*{suffix}").load(root)
    return files.select("path", "content").mapInPandas(work, "t int, id long, val double")


def write_images(cells: DataFrame, dims: Dims, root: str) -> DataFrame:
    """Write (z, y, x, grey 0 to 255) as a grey image file a slice (`P5`), and give (z, n) of what was written."""
    fs, base = _store(root)
    fs.create_dir(base, recursive=True)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, z = pdf.sort_values(["y", "x"]), int(pdf["z"].iloc[0])
        store, at = _store(root)
        hidden = f"{at}/.slice-{z:06d}.pgm.{uuid.uuid4().hex}"
        with store.open_output_stream(hidden) as f:
            f.write(f"P5\n{dims.nx} {dims.ny}\n255\n".encode() + pdf["grey"].to_numpy(np.uint8).tobytes())
        store.move(hidden, f"{at}/slice-{z:06d}.pgm")
        return pd.DataFrame({"z": [z], "n": [len(pdf)]})

    return cells.select("z", "y", "x", "grey").groupBy("z").applyInPandas(work, "z long, n long")


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """(z, y, x, grey) of the image files of a folder."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                _, sizes, _, grey = content.split(b"\n", 3)
                nx, ny = (int(w) for w in sizes.split())
                at = np.arange(nx * ny)
                yield pd.DataFrame({"z": int(path.rsplit("slice-", 1)[1].split(".")[0]), "y": at // nx, "x": at % nx, "grey": np.frombuffer(grey, np.uint8, nx * ny)})

    return spark.read.format("binaryFile").option("pathGlobFilter", "slice-*.pgm").load(root).select("path", "content").mapInPandas(work, "z long, y long, x long, grey int")

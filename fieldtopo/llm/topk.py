"""Exact top-k by inner product: vectors are grouped by length, each group is pruned by what is left to beat, products are verified.

Candidates fall into buckets of similar length (a power of BAND each), large buckets into chunks by a hash of the id; queries
into blocks. Every query first meets the chunks of the longest vectors (about SEED rows), which gives it a k-th best score to beat. A block of
queries is sent to a chunk only if the block's largest |q| times the chunk's longest vector can reach the least of these scores. They meet by a
shuffle in which each chunk goes ahead of its blocks: a join would guess the blocks' size from their columns, and gather all copies in the driver. There
are about PARTS chunks, of CHUNK vectors at least and WIDE components at most, so that copies grow with the table and not with its square. Within
a chunk a query needs a local cosine of at least score / (|q| |p|): above 1 the chunk is passed over, at high values only
candidates whose coordinate lies in the feasible range of the query's strongest coordinates are tried (coordinate pruning),
otherwise the prefix of vectors that are long enough (length pruning). What is left gets its exact integer product.

The k-th best of SEED is a lower bound of the final k-th best, so no answer is lost; ties go to the smaller id and are therefore
never pruned (bounds are compared with slack). Components become floor(256 x).

Edge cases: rows without an id and vectors that are null or hold null or non-finite components take no part. Fewer than k candidates: all of them.
Repeated ids: rows of a query's own id are not its candidates; a repeated query id is answered once per row. Shorter vectors count
as padded with zeros. Zero vectors and equal scores need no special care. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BAND, CHUNK, QUERY_BLOCK, SEED = 1.05, 4096, 512, 2048
PARTS, WIDE = 64, 1 << 21
SEED_COPIES = 16  # of the first chunks, each for a share of the blocks
SCALE, K, COORDINATE_FROM, FOCUS = 256, 5, 0.8, 3
TOGETHER = 128  # queries multiplied at once
HITS = "q_row long, query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<long>, norm double) of the vectors that take part."""
    bad = F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    v = F.transform(vec_col, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & ~bad).select(F.col(id_col).alias("vec_id"), v.alias("v")).withColumn("norm", norm)


def _matrix(lists: pa.Array) -> np.ndarray:
    """Rows of a list array, the shorter ones padded with zeros."""
    lengths = np.diff(np.asarray(lists.offsets))
    flat = np.asarray(lists.flatten(), np.int64)
    wide = int(lengths.max(initial=0))
    out = np.zeros((len(lengths), wide), np.int64)
    out[np.arange(wide) < lengths[:, None]] = flat
    return out


class _Rows:
    """Whole vectors and what goes with them, as packed by `_pack`."""

    def __init__(self, row: dict):
        self.ids, self.norm = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["norms"], np.float64)
        n = len(self.ids)
        self.rows = np.frombuffer(row["vectors"], f"i{row['width']}").reshape(n, -1)
        self.most = float(np.abs(self.rows.astype(np.float64)).max(initial=0))
        self.real = self.rows.astype(np.float64)
        self.q_row, self.least = np.frombuffer(row["q_rows"], np.int64), np.frombuffer(row["leasts"], np.float64)


def _products(p: _Rows, q: _Rows, at_p, at_q) -> np.ndarray:
    """Exact integer products of rows of q (down) with rows of p; floats serve while every sum stays below 2**53."""
    d = min(p.rows.shape[1], q.rows.shape[1])
    if d * p.most * q.most < 2.0**53:
        return q.real[at_q, :d] @ p.real[at_p, :d].T
    return q.rows[at_q, :d].astype(np.int64) @ p.rows[at_p, :d].astype(np.int64).T


class _Chunk(_Rows):
    """Vectors by falling length; their directions and every coordinate's order are made where a query asks for them."""

    _unit = None

    def by_coordinate(self) -> tuple[np.ndarray, np.ndarray]:
        if self._unit is None:
            unit = self.real / np.maximum(self.norm, 1e-300)[:, None]
            order = np.argsort(unit, axis=0, kind="stable")
            self._unit = order, np.take_along_axis(unit, order, 0)
        return self._unit

    def reaches(self, q: _Rows) -> tuple[np.ndarray, np.ndarray]:
        """For every query the least local cosine (-1: all vectors are candidates) and the number of vectors that are long enough."""
        every = (q.least <= 0) | (q.norm == 0)
        need = np.where(every, 0.0, q.least / np.where(q.norm == 0, 1.0, q.norm))
        enough = np.searchsorted(-self.norm, -need * (1 - 1e-9), side="right")
        local = need / self.norm[0] if self.norm[0] else np.full(len(need), 2.0)
        return np.where(every, -1.0, local), np.where(every, len(self.ids), enough)

    def candidates(self, q: np.ndarray, q_norm: float, local: float, enough: int) -> np.ndarray:
        """Places of the vectors in the feasible range of the query's strongest coordinates."""
        order, ranges = self.by_coordinate()
        theta, unit = min(local, 1.0) - 1e-9, q / q_norm
        best = None
        for f in np.argsort(-np.abs(unit))[:FOCUS]:
            if f >= ranges.shape[1]:
                continue
            half = np.sqrt(max(0.0, (1 - theta * theta) * (1 - unit[f] ** 2)))
            low, high = unit[f] * theta - half, unit[f] * theta + half
            low, high = (-1.0 if unit[f] <= -theta else low), (1.0 if unit[f] >= theta else high)
            a, b = np.searchsorted(ranges[:, f], low - 1e-9), np.searchsorted(ranges[:, f], high + 1e-9, side="right")
            if best is None or b - a < len(best):
                best = order[a:b, f]
        if best is None:
            return np.arange(enough)
        return best[best < enough]

    def top(self, q: _Rows, at: np.ndarray, at_q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, vec_id, score) of the k best of the vectors `at` for each of the queries `at_q`, without those below its bound."""
        score, ids = _products(self, q, at, at_q), self.ids[at]
        own = ids == q.ids[at_q][:, None]
        score[own] = np.iinfo(np.int64).min
        keep = ~own
        if score.dtype == np.float64:
            keep &= score >= q.least[at_q][:, None]
        if len(ids) > k and np.count_nonzero(keep) > 4 * k * len(at_q):
            keep &= score >= np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k, None]
        i, j = np.nonzero(keep)
        best = score[i, j].astype(np.int64)
        by = np.lexsort((ids[j], -best, i))
        i, j, best = i[by], j[by], best[by]
        first = np.searchsorted(i, i)
        few = np.arange(len(i)) - first < k
        return at_q[i[few]], ids[j[few]], best[few]


_PACKED = "width int, ids binary, norms binary, vectors binary, q_rows binary, leasts binary, longest double, need double"


def _pack(df: DataFrame, key: list[Column], names: list[str]) -> DataFrame:
    """One row for each key, its vectors by falling length in as few bytes as hold their components (groups are bounded by CHUNK or
    QUERY_BLOCK in expectation)."""
    kinds = {c: t for c, t in df.select(*[c.alias(a) for c, a in zip(key, names, strict=True)]).dtypes}
    extra = [c for c in ("q_row", "least") if c in df.columns]

    def work(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        column = lambda name: group.column(name).combine_chunks() if group.column(name).num_chunks != 1 else group.column(name).chunk(0)
        ids, norm, rows = np.asarray(column("vec_id")), np.asarray(column("norm")), _matrix(column("v"))
        by = np.lexsort((ids, -norm))
        low, high = int(rows.min(initial=0)), int(rows.max(initial=0))
        width = next(w for w in (2, 4, 8) if -(1 << 8 * w - 1) <= low and high < 1 << 8 * w - 1)
        q_row = np.asarray(column("q_row"))[by] if "q_row" in extra else np.zeros(0, np.int64)
        least = np.asarray(column("least").cast("double", safe=False).fill_null(float("-inf")))[by] if "least" in extra else np.zeros(0)
        made = [width, ids[by].tobytes(), norm[by].tobytes(), rows[by].astype(f"i{width}").tobytes(), q_row.tobytes(), least.tobytes(), float(norm.max(initial=0)), float(least.min(initial=np.inf))]
        return pa.table({a: group.column(a).slice(0, 1) for a in names} | {f.split()[0]: pa.array([x], {"int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}[f.split()[1]]) for f, x in zip(_PACKED.split(", "), made, strict=True)})

    rows = df.select(*[c.alias(a) for c, a in zip(key, names, strict=True)], "vec_id", "v", "norm", *extra)
    return rows.groupBy(*names).applyInArrow(work, ", ".join(f"{a} {kinds[a]}" for a in names) + ", " + _PACKED)


_KEY = ["bucket", "part", "copy"]


def _search(chunks: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """Best k of every query in each chunk that its block is sent to: packed rows x by bucket, part and copy of a chunk."""

    def hits(chunk: _Chunk, q: _Rows) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        local, enough = chunk.reaches(q)
        some = np.flatnonzero((local <= 1 + 1e-9) & (enough > 0))
        near = local[some] >= COORDINATE_FROM
        for i in some[near].tolist():  # few vectors each
            yield chunk.top(q, chunk.candidates(q.real[i], float(q.norm[i]), float(local[i]), int(enough[i])), np.array([i]), k)
        rest = some[~near]
        rest = rest[np.argsort(-enough[rest], kind="stable")]
        for lo in range(0, len(rest), TOGETHER):  # as many vectors as the first of them takes
            yield chunk.top(q, np.arange(enough[rest[lo]]), rest[lo : lo + TOGETHER], k)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, chunk = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                *key, kind, row = (batch.column(j)[i].as_py() for j in range(5))
                if kind == 0:
                    last, chunk = key, _Chunk(row)
                if kind == 0 or key != last:  # no vector has come to a chunk that is missing
                    continue
                q = _Rows(row)
                found = list(hits(chunk, q))
                at, ids, score = (np.concatenate([f[j] for f in found] + [np.zeros(0, np.int64)]) for j in range(3))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q.q_row[at], q.ids[at], ids, score)], ["q_row", "query_id", "vec_id", "score"])

    both = chunks.select(*_KEY, F.lit(0).alias("kind"), "x").unionByName(blocks.select(*_KEY, F.lit(1).alias("kind"), "x"))
    return both.repartition(*_KEY).sortWithinPartitions(*_KEY, "kind").mapInArrow(work, HITS)


def top_k(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of (vec_id, embedding) where is_query holds, against all others."""
    rows = quantised(vectors)
    bucket = F.floor(F.log(F.greatest("norm", F.lit(1e-9))) / F.log(F.lit(BAND))).cast("int")
    rows = rows.withColumn("bucket", bucket)
    bands = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).collect()  # one row per band of length
    sizes = sorted(((r["bucket"], r["n"]) for r in bands), reverse=True)
    queries, _ = written(rows.where(is_query).withColumn("q_row", F.monotonically_increasing_id()), "topk-queries")  # written: the row numbers have to stay
    if not sizes:
        return queries.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score"))
    total, widest = sum(n for _, n in sizes), max(r["d"] for r in bands)
    per_chunk = max(CHUNK, min(total // PARTS, WIDE // max(1, widest)))
    parts = {b: max(1, -(-n // per_chunk)) for b, n in sizes}
    n_queries = queries.count()
    blocks = max(1, -(-n_queries // QUERY_BLOCK))
    count_of = F.create_map(*[F.lit(x) for b, p in parts.items() for x in (b, p)])
    chunked = rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), count_of[F.col("bucket")]))
    block = F.pmod(F.xxhash64("vec_id", F.lit("query")), F.lit(blocks))

    # Seed: chunks from the longest bucket down until SEED rows are seen. That is a few chunks however large the table is.
    seed, seen = [], 0
    for b, n in sizes:
        for p in range(parts[b]):
            if seen < SEED:
                seed.append((b, p))
                seen += n / parts[b]
    chunks, _ = written(_pack(chunked, [F.col("bucket"), F.col("part")], ["bucket", "part"]), "topk-chunks")  # read twice
    spark = vectors.sparkSession
    seed_keys = F.broadcast(spark.createDataFrame(seed, "bucket int, part long"))
    whole = F.struct("width", "ids", "norms", "vectors", "q_rows", "leasts")
    packed = lambda q: _pack(q.withColumn("block", block), [F.col("block")], ["block"]).select("block", whole.alias("x"), "longest", "need")
    chunks = chunks.select("bucket", "part", whole.alias("x"))
    first = packed(queries.withColumn("least", F.lit(None).cast("long")))
    places = F.array(*[F.struct(F.lit(b).alias("bucket"), F.lit(p).cast("long").alias("part")) for b, p in seed])
    copies = F.lit(min(blocks, SEED_COPIES))
    dealt = first.select("x", F.pmod("block", copies).cast("int").alias("copy"), F.explode(places).alias("to")).select("x", "copy", "to.bucket", "to.part")
    ahead = chunks.join(seed_keys, ["bucket", "part"]).withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    per_query = Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id")
    best = lambda hits: hits.withColumn("rank", F.row_number().over(per_query)).where(F.col("rank") <= k)
    seeded, _ = written(best(_search(ahead, dealt, k)), "topk-seed")
    bound = seeded.groupBy("q_row").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k).select("q_row", "least")

    # The rest: a block goes to the chunks that it can still gain from.
    later = packed(queries.join(bound.hint("merge"), "q_row", "left"))
    if sum(parts.values()) == len(seed):
        found = seeded
    else:
        todo = F.flatten(F.transform(F.array(*[F.struct(F.lit(b).alias("bucket"), F.lit(p).cast("long").alias("n")) for b, p in parts.items()]), lambda s: F.transform(F.sequence(F.lit(0).cast("long"), s["n"] - 1), lambda i: F.struct(s["bucket"].alias("bucket"), i.alias("part")))))
        reach = F.lit(BAND) ** (F.col("to.bucket") + 1) * F.col("longest") * (1 + 1e-9)
        sent = later.withColumn("to", F.explode(todo)).where((F.col("need") <= 0) | (reach >= F.col("need"))).select(F.col("to.bucket").alias("bucket"), F.col("to.part").alias("part"), "x")
        sent, rest = (d.join(seed_keys, ["bucket", "part"], "left_anti").withColumn("copy", F.lit(0)) for d in (sent, chunks))
        found = best(seeded.drop("rank").unionByName(_search(rest, sent, k)))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_top_k(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % 50 == 0)

"""Dense grids made from the star-schema tables: one row per cell with its address and an integer value.

A grid is read once, pre-aggregated by cell and completed with the empty cells (value 0). Cells are addressed with x fastest:
id = (z * ny + y) * nx + x, and with a time step t slowest where there is one.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Dims(NamedTuple):
    nx: int
    ny: int
    nz: int
    nt: int = 1

    @property
    def n(self) -> int:
        return self.nx * self.ny * self.nz * self.nt

    @property
    def slice(self) -> int:
        return self.nx * self.ny


LI, LI_SMALL, EVENTS, VECTORS, LI_4D = Dims(16, 16, 84), Dims(8, 8, 12), Dims(12, 5, 30), Dims(64, 32, 1), Dims(6, 6, 6, 7)
BLOCK, ORDERS_A_GRID = Dims(16, 16, 12), 512  # grids by ranges of orders: as many as the table needs


def address(dims: Dims, x="x", y="y", z="z", t=None) -> Column:
    """Cell id of integer coordinates."""
    x, y, z = (F.col(c) if isinstance(c, str) else c for c in (x, y, z))
    plane = z if t is None else (F.col(t) if isinstance(t, str) else t) * dims.nz + z
    return ((plane * dims.ny + y) * dims.nx + x).cast("long")


def coordinates(dims: Dims, cell="id") -> list[Column]:
    """x, y, z (and t, where the grid has steps) of a cell id."""
    c = F.col(cell) if isinstance(cell, str) else cell
    div = lambda a, b: F.floor(a / F.lit(b))
    out = [(c % dims.nx).cast("int").alias("x"), (div(c, dims.nx) % dims.ny).cast("int").alias("y"), (div(c, dims.slice) % dims.nz).cast("int").alias("z")]
    return out + [div(c, dims.slice * dims.nz).cast("int").alias("t")] * (dims.nt > 1)


def dense(sparse: DataFrame, dims: Dims, spark: SparkSession) -> DataFrame:
    """Every cell of the grid; sparse has (id, val) with at most one row per cell."""
    cells = spark.range(dims.n).select("id", *coordinates(dims))
    return cells.join(sparse, "id", "left").withColumn("val", F.coalesce("val", F.lit(0)).cast("long"))


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate"]
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*cols)


def _grouped(df: DataFrame, dims: Dims, val: Column, x: Column, y: Column, z: Column, t: Column | None = None) -> DataFrame:
    inside = (z >= 0) & (z < dims.nz) if t is None else (t >= 0) & (t < dims.nt)
    return df.where(inside).groupBy(address(dims, x.cast("int"), y.cast("int"), z.cast("int"), t).alias("id")).agg(val.cast("long").alias("val"))


def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity shipped by part class, supplier class and month: 16 x 16 x 84."""
    li, month = _lineitem(spark, sf_dir), (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1
    return dense(_grouped(li, LI, F.sum(F.col("l_quantity").cast("long")), F.col("l_partkey") % 16, F.col("l_suppkey") % 16, month), LI, spark)


def shipped_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by calendar month: 8 x 8 x 12."""
    li = _lineitem(spark, sf_dir)
    return dense(_grouped(li, LI_SMALL, F.sum(F.col("l_quantity").cast("long")), F.col("l_partkey") % 8, F.col("l_suppkey") % 8, F.month("l_shipdate") - 1), LI_SMALL, spark)


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by user class, event type and day of month: 12 x 5 x 30 (many ties)."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", "ts")
    kind = F.array_position(F.array(*[F.lit(k) for k in ("click", "error", "purchase", "signup", "view")]), F.col("event_type")) - 1
    return dense(_grouped(ev.where(kind >= 0), EVENTS, F.count("*"), F.col("user_id") % 12, kind, F.dayofmonth("ts") - 1), EVENTS, spark)


def shipped_4d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity by part, supplier and order class over years: 6 x 6 x 6 x 7."""
    li, t = _lineitem(spark, sf_dir), F.year("l_shipdate") - 1995
    return dense(_grouped(li, LI_4D, F.sum(F.col("l_quantity").cast("long")), F.col("l_partkey") % 6, F.col("l_suppkey") % 6, F.col("l_orderkey") % 6, t), LI_4D, spark)


def shipped_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of 16 x 16 x 12 cells for every ORDERS_A_GRID order keys (part class, supplier class, month): their number grows with the
    table. grid_id comes before the cell's own columns."""
    li = _lineitem(spark, sf_dir)
    grid_id = F.floor(F.col("l_orderkey") / ORDERS_A_GRID).alias("grid_id")
    cell = address(BLOCK, (F.col("l_partkey") % 16).cast("int"), (F.col("l_suppkey") % 16).cast("int"), F.month("l_shipdate") - 1)
    sparse = li.groupBy(grid_id, cell.alias("id")).agg(F.sum(F.col("l_quantity").cast("long")).cast("long").alias("val"))
    ids = sparse.select("grid_id").distinct().select("grid_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BLOCK.n - 1).cast("long"))).alias("id"))
    return ids.select("grid_id", "id", *coordinates(BLOCK)).join(sparse, ["grid_id", "id"], "left").withColumn("val", F.coalesce("val", F.lit(0)).cast("long"))


def sparse_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grid_id, id, val) of the same grids without the cells that nothing falls into, dealt out by grid_id once for all that is asked by grid."""
    li = _lineitem(spark, sf_dir)
    grid_id = F.floor(F.col("l_orderkey") / ORDERS_A_GRID).alias("grid_id")
    cell = address(BLOCK, (F.col("l_partkey") % 16).cast("int"), (F.col("l_suppkey") % 16).cast("int"), F.month("l_shipdate") - 1)
    rows = li.select(grid_id, cell.alias("id"), F.col("l_quantity").cast("long").alias("val")).repartition("grid_id")
    inside = F.when(F.col("id").between(0, BLOCK.n - 1), F.col("id"))  # others leave their grid as it is; lists drop nulls
    cells = rows.groupBy("grid_id", inside.alias("id")).agg(F.coalesce(F.sum("val"), F.lit(0).cast("long")).alias("val"))
    return cells.withColumn("val", F.when(F.col("id").isNotNull(), F.col("val")))


def _sql(dims: Dims, source: str, name: str) -> str:
    t = f", CAST(i // {dims.slice * dims.nz} AS INT) AS t" if dims.nt > 1 else ""
    return f"""{name} AS (SELECT i AS id, CAST(i % {dims.nx} AS INT) AS x, CAST((i // {dims.nx}) % {dims.ny} AS INT) AS y, CAST((i // {dims.slice}) % {dims.nz} AS INT) AS z{t}, CAST(coalesce(v, 0) AS BIGINT) AS val
  FROM range({dims.n}) r(i) LEFT JOIN ({source}) s ON s.sid = r.i)"""


SQL = {
    "li": _sql(LI, "SELECT ((((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1) * 16 + l_suppkey % 16) * 16 + l_partkey % 16) AS sid, SUM(CAST(l_quantity AS BIGINT)) AS v FROM lineitem WHERE year(l_shipdate) BETWEEN 1995 AND 2001 GROUP BY 1", "g"),
    "li_small": _sql(LI_SMALL, "SELECT (((month(l_shipdate) - 1) * 8 + l_suppkey % 8) * 8 + l_partkey % 8) AS sid, SUM(CAST(l_quantity AS BIGINT)) AS v FROM lineitem GROUP BY 1", "g"),
    "events": _sql(EVENTS, "SELECT (((day(ts) - 1) * 5 + list_position(['click','error','purchase','signup','view'], event_type) - 1) * 12 + user_id % 12) AS sid, COUNT(*) AS v FROM events WHERE day(ts) <= 30 AND list_position(['click','error','purchase','signup','view'], event_type) > 0 GROUP BY 1", "g"),
    "blocks": f"""s AS (SELECT l_orderkey // {ORDERS_A_GRID} AS grid_id, (((month(l_shipdate) - 1) * 16 + l_suppkey % 16) * 16 + l_partkey % 16) AS sid, SUM(CAST(l_quantity AS BIGINT)) AS v FROM lineitem GROUP BY 1, 2),
g AS (SELECT b.grid_id, i AS id, CAST(i % 16 AS INT) AS x, CAST((i // 16) % 16 AS INT) AS y, CAST(i // 256 AS INT) AS z, CAST(coalesce(v, 0) AS BIGINT) AS val FROM (SELECT DISTINCT grid_id FROM s) b CROSS JOIN range({BLOCK.n}) r(i) LEFT JOIN s ON s.grid_id = b.grid_id AND s.sid = r.i)""",
    "li_4d": _sql(LI_4D, "SELECT ((((year(l_shipdate) - 1995) * 6 + l_orderkey % 6) * 6 + l_suppkey % 6) * 6 + l_partkey % 6) AS sid, SUM(CAST(l_quantity AS BIGINT)) AS v FROM lineitem WHERE year(l_shipdate) BETWEEN 1995 AND 2001 GROUP BY 1", "g"),
}

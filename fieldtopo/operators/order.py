"""Total orders of cells: ranks by (value, id) without ever sorting the whole grid in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

BLOCK = 1 << 16


def numbered(df: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """df with `name`: 0-based place in the order of the keys.

    Rows are dealt out by ranges of the keys and sorted within them; the table is written, so that a lost task finds the same ranges
    again. One count per range is then all that has to be added up, in a broadcast row each."""
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__m", F.monotonically_increasing_id())
    placed, _ = written(placed.withColumn("__p", F.shiftright("__m", 33)).withColumn("__at", F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).drop("__m"), "ranked")
    counts = placed.groupBy("__p").agg(F.count("*").alias("__n"))  # one row per range
    running = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("__p", F.coalesce(F.sum("__n").over(running), F.lit(0)).alias("__first"))
    joined = placed.join(F.broadcast(first), "__p")
    return joined.select(*df.columns, (F.col("__first") + F.col("__at")).cast("long").alias(name))


def ranked(df: DataFrame, value: str = "val", cell: str = "id", name: str = "ord", descending: bool = False) -> DataFrame:
    """df with `name`: 0-based rank by value, then id (both falling if descending)."""
    way = F.desc if descending else F.asc
    return numbered(df, [way(value), way(cell)], name)


def ranked_within(df: DataFrame, keys: list[str], value: str = "val", cell: str = "id", name: str = "ord") -> DataFrame:
    """Ranks within each slice, window or grid of bounded size."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(value, cell)) - 1).cast("long"))


def reversed_order(df: DataFrame, n: int, order: str = "ord") -> DataFrame:
    return df.withColumn(order, F.lit(n - 1) - F.col(order))


def running_extreme(df: DataFrame, value: str, order: str, name: str, largest: bool = True) -> DataFrame:
    """df with the running maximum in order (or the minimum from the end): block extremes first, then within each block."""
    keyed = df.withColumn("__block", F.floor(F.col(order) / BLOCK))
    way, agg = (F.asc, F.max) if largest else (F.desc, F.min)
    pick = F.greatest if largest else F.least
    ahead = keyed.groupBy("__block").agg(agg(value).alias("__m"))
    ahead = ahead.withColumn("__before", agg("__m").over(Window.orderBy(way("__block")).rowsBetween(Window.unboundedPreceding, -1))).drop("__m")
    within = keyed.withColumn("__own", agg(value).over(Window.partitionBy("__block").orderBy(way(order))))
    return within.join(ahead, "__block").withColumn(name, pick("__own", "__before")).drop("__block", "__own", "__before")

"""Octrees as a relation of cells (level, ix, iy, iz, f, unknown); level 0 is the finest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build(finest: DataFrame, levels: int) -> DataFrame:
    """All levels from the finest cells (ix, iy, iz, f, unknown).

    Extremes of extremes are those of the cells, so every cell names its ancestor at each level and one aggregation makes all levels:
    map tasks merge most of these rows before the one shuffle."""
    up = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")
    at = [F.expr(f"CAST(shiftright(CAST({c} AS BIGINT), level) AS BIGINT)").alias(c) for c in ("ix", "iy", "iz")]
    cells = finest.select("ix", "iy", "iz", "f", "unknown", up).select("level", *at, "f", "unknown")
    out = cells.groupBy("level", "ix", "iy", "iz").agg(F.min("f").alias("lo"), F.max("f").alias("hi"), F.bool_and("unknown").alias("unknown"))
    merged = F.when(F.col("hi") < 0, F.col("hi")).when(F.col("lo") > 0, F.col("lo")).otherwise(0)
    return out.withColumn("f", merged)


def coarsest_cover(cells: DataFrame, tree: DataFrame, levels: int) -> DataFrame:
    """cells with the largest level at which the tree holds a cell over them (0 where none does)."""
    at = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")
    keys = cells.select("id", "x", "y", "z", at).select("id", "level", *[F.expr(f"CAST(shiftright({a}, level) AS BIGINT)").alias(f"i{a}") for a in "xyz"])
    found = keys.join(tree.select("level", "ix", "iy", "iz"), ["level", "ix", "iy", "iz"]).groupBy("id").agg(F.max("level").alias("level"))
    return cells.join(found, "id", "left").withColumn("level", F.coalesce("level", F.lit(0)))


def children(cells: DataFrame) -> DataFrame:
    """The eight children of each cell; child = x + 2 y + 4 z of their place in it."""
    each = cells.withColumn("child", F.explode(F.sequence(F.lit(0), F.lit(7))))
    bits = {"ix": F.col("child") % 2, "iy": F.floor(F.col("child") / 2) % 2, "iz": F.floor(F.col("child") / 4)}
    return each.select((F.col("level") - 1).alias("level"), *[(F.col(c) * 2 + b).alias(c) for c, b in bits.items()], "child")

"""Registration of jobs with the SQL that states the same result for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import grids

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def longs(df: DataFrame) -> DataFrame:
    """df with every integer column as long, as the oracles have them."""
    return df.select(*[F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])


def job(sql: str | None = None, grid: str | None = None, longs_of: str = "", flags: str = "", recursive: bool = False):
    """Register a job. sql is a query that may use the grid's table g and more WITH parts before it (name AS (...), ... SELECT ...).
    longs_of and flags name the result's integer and boolean columns."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: longs(f(spark, sf_dir))
        if sql:
            cols = ", ".join([f"CAST({c} AS BIGINT) AS {c}" for c in longs_of.split()] + flags.split())
            parts, _, last = sql.rpartition("\n---\n")
            with_parts = ",\n".join(p for p in (grids.SQL[grid] if grid else "", parts.strip()) if p)
            ORACLES[f.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{with_parts}{',' if with_parts else ''} answer AS ({last.strip()})\nSELECT {cols} FROM answer"
        return f

    return add


NEIGHBOURS_26 = "off AS (SELECT dx, dy, dz, row_number() OVER (ORDER BY dz, dy, dx) - 1 AS bit FROM (SELECT unnest([-1,0,1]) AS dx) CROSS JOIN (SELECT unnest([-1,0,1]) AS dy) CROSS JOIN (SELECT unnest([-1,0,1]) AS dz) WHERE dx <> 0 OR dy <> 0 OR dz <> 0)"
ORDERED = "o AS (SELECT *, row_number() OVER (ORDER BY val, id) - 1 AS ord FROM g)"
# The two-dimensional ring of a slice mask, and the strict three-dimensional test, stated over sets of cells instead of bits.
SLICE_MASK = f"""{ORDERED}, {NEIGHBOURS_26},
m2 AS (SELECT a.id, a.z, a.ord, coalesce(bit_or(CASE WHEN b.ord < a.ord THEN CAST(1 << CAST(off2.bit AS INT) AS BIGINT) ELSE 0 END), 0) AS mask
  FROM o a CROSS JOIN (SELECT dx, dy, row_number() OVER (ORDER BY dy, dx) - 1 AS bit FROM off WHERE dz = 0) off2
  LEFT JOIN o b ON b.x = a.x + off2.dx AND b.y = a.y + off2.dy AND b.z = a.z GROUP BY ALL)"""
VOLUME_MASK = f"""{ORDERED}, {NEIGHBOURS_26},
m3 AS (SELECT a.id, a.z, a.ord, coalesce(bit_or(CASE WHEN b.ord < a.ord THEN CAST(1 AS BIGINT) << CAST(off.bit AS INT) ELSE 0 END), 0) AS mask
  FROM o a CROSS JOIN off LEFT JOIN o b ON b.x = a.x + off.dx AND b.y = a.y + off.dy AND b.z = a.z + off.dz GROUP BY ALL)"""
RING_TEST = """ring AS (SELECT mask, [(mask >> r) & 1 FOR r IN [0,1,2,4,7,6,5,3]] AS b FROM (SELECT DISTINCT mask FROM m2)),
closedring AS (SELECT mask, [CASE WHEN i % 2 = 1 THEN greatest(b[i], b[(i + 6) % 8 + 1], b[i % 8 + 1]) ELSE b[i] END FOR i IN range(1, 9)] AS c FROM ring),
test2 AS (SELECT mask, list_sum([CASE WHEN c[i] <> c[i % 8 + 1] THEN 1 ELSE 0 END FOR i IN range(1, 9)]) AS transitions FROM closedring)"""
STRICT_TEST = """masks AS (SELECT DISTINCT mask FROM {source}),
marked AS (SELECT DISTINCT mask, dx, dy, dz FROM (
  SELECT mask, dx, dy, dz FROM masks, off WHERE (mask >> CAST(bit AS INT)) & 1 = 1)),
closure AS (SELECT DISTINCT m.mask, o2.dx, o2.dy, o2.dz FROM marked m JOIN off o2 ON (m.dx = 0 OR m.dx = o2.dx) AND (m.dy = 0 OR m.dy = o2.dy) AND (m.dz = 0 OR m.dz = o2.dz)),
sides AS (SELECT k.mask, off.bit, off.dx, off.dy, off.dz, EXISTS (SELECT 1 FROM closure c WHERE c.mask = k.mask AND c.dx = off.dx AND c.dy = off.dy AND c.dz = off.dz) AS inside FROM masks k CROSS JOIN off),
steps AS (SELECT a.bit AS a, b.bit AS b FROM off a JOIN off b ON abs(a.dx - b.dx) + abs(a.dy - b.dy) + abs(a.dz - b.dz) = 1),
seeds AS (SELECT mask, inside, min(bit) AS bit FROM sides GROUP BY ALL),
reach(mask, inside, bit) AS (SELECT mask, inside, bit FROM seeds UNION SELECT r.mask, r.inside, s.bit FROM reach r JOIN steps ON steps.a = r.bit JOIN sides s ON s.mask = r.mask AND s.bit = steps.b AND s.inside = r.inside),
test3 AS (SELECT k.mask, NOT (coalesce(a.n, 0) > 0 AND coalesce(a.n, 0) = coalesce(c.n, 0) AND coalesce(b.n, 0) > 0 AND coalesce(b.n, 0) = coalesce(d.n, 0)) AS critical FROM masks k
  LEFT JOIN (SELECT mask, count(*) AS n FROM reach WHERE inside GROUP BY 1) a USING (mask) LEFT JOIN (SELECT mask, count(*) AS n FROM reach WHERE NOT inside GROUP BY 1) b USING (mask)
  LEFT JOIN (SELECT mask, count(*) AS n FROM sides WHERE inside GROUP BY 1) c USING (mask) LEFT JOIN (SELECT mask, count(*) AS n FROM sides WHERE NOT inside GROUP BY 1) d USING (mask))"""

"""Runs in an order (gaps and islands) without one task a key.

A window over all rows of a key sorts them in one task. Here time is cut into ranges at approximate quantiles,
windows run within (key, range), and what crosses a range's edge (the row before, the number of runs so far) comes
from a table with one row per key and range.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered_runs(
    df: DataFrame, keys: list[str], time: str, ties: list[str], begins: Callable[[Column, Column], Column], carry: list[str], ranges: int | None = None
) -> DataFrame:
    """Add ``run``, the number of the run a row is in (from 1), in the order of ``time``, then ``ties``.

    ``begins(before, row)`` gets structs of the columns ``carry`` and says whether the row begins a run; the first
    row of a key always does. Keys compare null-safe by grouping; ``time`` must not be null, ``ties`` must make the order total.
    """
    row = F.struct(*carry)
    flagged = _with_previous(df, keys, time, ties, carry, ranges).withColumn("_new", F.when(F.col("_before").isNull() | begins(F.col("_before"), row), 1).otherwise(0))
    inside = Window.partitionBy(*keys, "_part").orderBy(time, *ties)
    over = Window.partitionBy(*keys).orderBy("_part")
    totals = flagged.groupBy(*keys, "_part").agg(F.sum("_new").alias("_sum"))
    so_far = totals.withColumn("_base", F.coalesce(F.sum("_sum").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    same = [flagged[k].eqNullSafe(so_far[k]) for k in keys] + [flagged["_part"] == so_far["_part"]]
    running = F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    out = flagged.withColumn("_run", running)
    same = [out[k].eqNullSafe(so_far[k]) for k in keys] + [out["_part"] == so_far["_part"]]
    return out.join(so_far, same).select(*[out[c] for c in df.columns], (out["_run"] + so_far["_base"]).alias("run"))


def previous_rows(df: DataFrame, keys: list[str], time: str, ties: list[str], carry: list[str], ranges: int | None = None) -> DataFrame:
    """Add ``before``: the columns ``carry`` of the row before in the order of ``time``, then ``ties``; null for a key's first."""
    return _with_previous(df, keys, time, ties, carry, ranges).withColumnRenamed("_before", "before").drop("_part")


def _with_previous(df: DataFrame, keys: list[str], time: str, ties: list[str], carry: list[str], ranges: int | None) -> DataFrame:
    """Adds _part, the range of time a row is in, and _before.

    Very many rows of one time (of the zero that stands in for none, say) are several ranges.
    """
    n = ranges or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = df.agg(F.percentile_approx(time, [i / n for i in range(1, n)], 10_000).alias("c")).first()["c"] or []
    part = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c < F.col(time))) if cuts else F.lit(0)
    crowded = sorted({c for c in cuts if cuts.count(c) > 1})
    # a time at which several quantiles fall holds many rows; within it the tie's first two characters divide them
    crowded = sorted({c for c in cuts if cuts.count(c) > 1})
    if crowded and dict(df.dtypes)[ties[0]] == "string":
        one, two = (F.coalesce(F.ascii(F.substring(ties[0], i, 1)), F.lit(0)) for i in (1, 2))
        fine = F.when(one >= 255, F.lit(1 << 16)).otherwise(one * 256 + F.least(two, F.lit(255)))
        part = part * (1 << 17) + F.when(F.col(time).isin(crowded), fine + 1).otherwise(0)
    row = F.struct(*carry)
    placed = df.withColumn("_part", part)
    inside = Window.partitionBy(*keys, "_part").orderBy(time, *ties)
    edges = placed.groupBy(*keys, "_part").agg(F.max_by(row, F.struct(time, *ties)).alias("_last"))
    over = Window.partitionBy(*keys).orderBy("_part")
    edges = edges.withColumn("_edge", F.lag("_last").over(over)).drop("_last")
    same = [placed[k].eqNullSafe(edges[k]) for k in keys] + [placed["_part"] == edges["_part"]]
    joined = placed.join(edges, same).select(placed["*"], edges["_edge"])
    return joined.withColumn("_before", F.coalesce(F.lag(row).over(inside), F.col("_edge"))).drop("_edge")

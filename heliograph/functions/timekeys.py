"""Neighbours and positions of long series without a window over a whole series.

Rows are windowed by series and day; what crosses a day's border goes through one small row for each series and day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def seconds(ts: str | Column) -> Column:
    """Whole seconds since the epoch of a zone-less time."""
    return F.unix_seconds((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def from_seconds(s: Column) -> Column:
    return F.timestamp_seconds(s).cast("timestamp_ntz")


def with_neighbour(df: DataFrame, series: str, ts: str, values: list[str], ahead: bool = True, prefix: str = "next_", ties: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``prefix``+``ts`` and ``prefix``+each of ``values``: those of the next (or previous) row of its series by time.

    ``ties`` order rows of equal time; they come first among ``values``.
    """
    names = [ts, *values]
    day = df.withColumn("_day", F.to_date(ts))
    row = F.struct(*[F.col(n) for n in names])
    step = F.lead if ahead else F.lag
    inside = step(row).over(Window.partitionBy(series, "_day").orderBy(ts, *ties))
    edge = (F.min if ahead else F.max)(row)
    edges = day.groupBy(series, "_day").agg(edge.alias("_edge"))
    edges = edges.withColumn("_over", step("_edge").over(Window.partitionBy(series).orderBy("_day"))).select(series, "_day", "_over")
    out = day.withColumn("_in", inside).join(edges, [series, "_day"]).withColumn("_n", F.coalesce("_in", "_over"))
    return out.select(*df.columns, *[F.col("_n")[n].alias(prefix + n) for n in names])


def with_both_neighbours(df: DataFrame, series: str, ts: str, values: list[str]) -> DataFrame:
    """``df`` with ``last_`` and ``next_`` of ``ts`` and of each of ``values``: both neighbours from one window and one join."""
    names = [ts, *values]
    day = df.withColumn("_day", F.to_date(ts))
    row = F.struct(*[F.col(n) for n in names])
    inside = Window.partitionBy(series, "_day").orderBy(ts)
    edges = day.groupBy(series, "_day").agg(F.min(row).alias("_first"), F.max(row).alias("_last"))
    over = Window.partitionBy(series).orderBy("_day")
    edges = edges.select(series, "_day", F.lag("_last").over(over).alias("_before"), F.lead("_first").over(over).alias("_after"))
    out = day.withColumns({"_l": F.lag(row).over(inside), "_n": F.lead(row).over(inside)}).join(edges, [series, "_day"])
    out = out.withColumns({"_l": F.coalesce("_l", "_before"), "_n": F.coalesce("_n", "_after")})
    return out.select(*df.columns, *[F.col("_l")[n].alias(f"last_{n}") for n in names], *[F.col("_n")[n].alias(f"next_{n}") for n in names])


def with_position(df: DataFrame, block: str, block_order: list[Column], inside: list[Column], name: str = "pos", series: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with its 0-based position (in its ``series``) when blocks (such as days) follow ``block_order`` and rows ``inside``
    within a block.

    Blocks are counted, their counts summed up in order over one row a block, and rows numbered within their block.
    """
    keys = [*series, block]
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*series).orderBy(*block_order).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*inside)))
    return ranked.join(sizes, keys).withColumn(name, (F.col("_before") + F.col("_r") - 1).cast("long")).drop("_before", "_r")

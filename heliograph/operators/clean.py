"""Power series: regular grids, gaps and filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, IntegralType, LongType, StructField, StructType
from pyspark.sql.window import Window

from heliograph.functions.scratch import new_folder
from heliograph.functions.timekeys import from_seconds, seconds, with_both_neighbours, with_neighbour


def to_readings(df: DataFrame, sensor: str, time: str, value: str) -> DataFrame:
    """``sensor_id, ts, kw``: times cut to whole seconds, readings of equal time averaged."""
    picked = df.select(F.col(sensor).alias("sensor_id"), F.date_trunc("second", F.col(time)).cast("timestamp_ntz").alias("ts"), F.col(value).cast("double").alias("kw"))
    return picked.groupBy("sensor_id", "ts").agg(F.avg("kw").alias("kw"))


def between_times(df: DataFrame, start: str, end: str, closed: str = "both", ts: str = "ts") -> DataFrame:
    """Rows from ``start`` to ``end``; ``closed`` is both, left, right or neither."""
    a, b = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    low = F.col(ts) >= a if closed in ("both", "left") else F.col(ts) > a
    high = F.col(ts) <= b if closed in ("both", "right") else F.col(ts) < b
    return df.where(low & high)


def drop_intervals(df: DataFrame, intervals: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows in no interval ``start_ts .. end_ts`` (both ends belong to it); intervals are spread to days for an equi-join."""
    days = intervals.select("start_ts", "end_ts", F.explode(F.sequence(F.to_date("start_ts"), F.to_date("end_ts"))).alias("_d"))
    kept = df.join(days, (F.to_date(ts) == F.col("_d")) & (F.col(ts) >= F.col("start_ts")) & (F.col(ts) <= F.col("end_ts")), "left_anti")
    return kept


def drop_nonpositive(df: DataFrame, value: str = "kw") -> DataFrame:
    return df.where(F.col(value) > 0)


def gaps(readings: DataFrame, max_gap: int) -> DataFrame:
    """``sensor_id, start_ts, end_ts`` of neighbours more than ``max_gap`` seconds apart."""
    near = with_neighbour(readings.select("sensor_id", "ts"), "sensor_id", "ts", [])
    return near.where(seconds("next_ts") - seconds("ts") > max_gap).select("sensor_id", F.col("ts").alias("start_ts"), F.col("next_ts").alias("end_ts"))


def drop_gaps(df: DataFrame, readings: DataFrame, max_gap: int) -> DataFrame:
    """Rows that lie in no gap of their sensor's readings, ends included; gaps are spread to days for an equi-join."""
    wide = gaps(readings, max_gap).select(F.col("sensor_id").alias("_s"), "start_ts", "end_ts", F.explode(F.sequence(F.to_date("start_ts"), F.to_date("end_ts"))).alias("_d"))
    inside = (F.col("sensor_id") == F.col("_s")) & (F.to_date("ts") == F.col("_d")) & (F.col("ts") >= F.col("start_ts")) & (F.col("ts") <= F.col("end_ts"))
    return df.join(wide, inside, "left_anti")


def resample_first(df: DataFrame, every: int) -> DataFrame:
    """The first value of each bin of ``every`` seconds, labelled by the bin's start."""
    start = from_seconds(F.floor(seconds("ts") / every) * every)
    return df.groupBy("sensor_id", start.alias("ts")).agg(F.min_by("kw", "ts").alias("kw"))


def interpolate_grid(readings: DataFrame, every: int, max_gap: int | None = None) -> DataFrame:
    """Linear interpolation on a grid of ``every`` seconds from the first reading to before the last; a first reading off the grid
    also labels the start of its bin. Points are made inside each segment between neighbours.

    With ``max_gap`` no point lies in a gap of more seconds, ends included, as ``drop_gaps`` leaves it: a gap's segment makes none,
    and neither does the reading that ends it.
    """
    near = with_neighbour(readings, "sensor_id", "ts", ["kw"]) if max_gap is None else with_both_neighbours(readings, "sensor_id", "ts", ["kw"])
    near = near.where("next_ts is not null").withColumn("t0", seconds("ts")).withColumn("t1", seconds("next_ts"))
    if max_gap is not None:
        near = near.where(F.col("t1") - F.col("t0") <= max_gap).withColumn("_ends", F.coalesce(F.col("t0") - seconds("last_ts") > max_gap, F.lit(False)))
    begins = F.col("t0") if max_gap is None else F.col("t0") + F.col("_ends").cast("int")
    first = F.ceil(begins / every) * every
    last = F.floor((F.col("t1") - 1) / every) * every
    points = near.where(first <= last).select("sensor_id", "t0", "t1", "kw", "next_kw", F.explode(F.sequence(first, last, F.lit(every).cast("long"))).alias("g"))
    grid = points.select("sensor_id", from_seconds(F.col("g")).alias("ts"), (F.col("kw") + (F.col("next_kw") - F.col("kw")) * (F.col("g") - F.col("t0")) / (F.col("t1") - F.col("t0"))).alias("kw"))
    begin = readings.groupBy("sensor_id").agg(F.min("ts").alias("ts"), F.min_by("kw", "ts").alias("kw"), F.count(F.lit(1)).alias("n"))
    begin = begin.where((seconds("ts") % every != 0) & (F.col("n") > 1)).select("sensor_id", from_seconds(F.floor(seconds("ts") / every) * every).alias("ts"), "kw")
    return grid.unionByName(begin)


def daily_profile(df: DataFrame, closed: bool) -> DataFrame:
    """``sensor_id, day, n, first_kw, last_kw``; closed days also hold the midnight that ends them."""
    wide = df.select("sensor_id", "ts", "kw", F.explode(_days(closed)).alias("day"))
    return wide.groupBy("sensor_id", "day").agg(F.count(F.lit(1)).alias("n"), F.min_by("kw", "ts").alias("first_kw"), F.max_by("kw", "ts").alias("last_kw"))


def day_series(df: DataFrame, closed: bool = False) -> DataFrame:
    """``sensor_id, day, series``: the readings of a day in time order as an array of ``ts, kw``; closed days also hold the
    midnight that ends them. A day's grid bounds the array."""
    wide = df.select("sensor_id", "ts", "kw", F.explode(_days(closed)).alias("day"))
    return wide.groupBy("sensor_id", "day").agg(F.array_sort(F.collect_list(F.struct("ts", "kw"))).alias("series"))


def _days(closed: bool) -> Column:
    day = F.to_date("ts")
    return F.when(F.col("ts") == day.cast("timestamp_ntz"), F.array(day, F.date_sub(day, 1))).otherwise(F.array(day)) if closed else F.array(day)


def clock_time(ts: Column) -> Column:
    """Seconds of the day."""
    return seconds(ts) % 86400


def drop_repeats(df: DataFrame, content: str, series: str | None = None, ts: str = "ts", ties: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose content differs from the row just before in time (equal times by ``ties``); of a run only the first stays."""
    own = df.withColumn("_s", F.lit(0) if series is None else F.col(series)).withColumn("_h", F.sha2(F.col(content).cast("string"), 256))
    near = with_neighbour(own, "_s", ts, [*ties, "_h"], ahead=False, prefix="_b", ties=ties)
    return near.where(F.col("_b_h").isNull() | (F.col("_b_h") != F.col("_h"))).select(*df.columns)


def _meters(v: np.ndarray, there: np.ndarray, begins: np.ndarray, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """How many values the last ``n`` rows of each row hold, and their mean, lower median, least and greatest; ``there`` marks rows with
    a value, ``begins`` is the first row of each row's series."""
    at = np.arange(len(v))
    padded = lambda x: np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(n - 1, x.dtype), x]), n)
    held = padded(there) & (np.arange(n) >= (begins - at + n - 1)[:, None])
    count, last = held.sum(axis=1), np.nan if v.dtype.kind == "f" else np.iinfo(v.dtype).max
    mean = np.where(held, padded(v), v.dtype.type(0)).sum(axis=1, dtype=np.float64) / np.maximum(count, 1)
    w = np.sort(np.where(held, padded(v), last), axis=1)
    return count, [mean, w[at, np.maximum(count - 1, 0) // 2], w[:, 0], w[at, np.maximum(count - 1, 0)]]


def rolling_meter(df: DataFrame, series: str, order: list[str], value: str, block: Column, n: int = 20, size: int = 4096, ranges: int | None = None) -> DataFrame:
    """Window mean, lower median, least, greatest, latest of the last ``n``, and the mean so far; nulls are left out. Values other than
    whole numbers are worked out as doubles.

    ``block`` never falls along ``order`` and holds a bounded number of rows (a day, a range of steps). Rows are shuffled once, to
    ``ranges`` of series and block, sorted there and read ``size`` at a time. What a series that goes on from one range to the next
    has so far goes through one small row a range: the last ``n - 1`` values, the sum and the count.
    """
    spark, names, kind = df.sparkSession, df.columns, df.schema[value].dataType
    whole = isinstance(kind, IntegralType)
    inner, arrow = (LongType(), pa.int64()) if whole else (DoubleType(), pa.float64())
    at, of = names.index(value), names.index(series)
    ranged = df.repartitionByRange(*([ranges] if ranges else []), F.col(series), block).sortWithinPartitions(series, *order)
    ranged = ranged.withColumn("_v", F.col(value).cast(inner))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ready, first = TaskContext.get().partitionId(), None, True
        before = begin = None
        tail, held = np.empty(0, np.int64 if whole else np.float64), np.empty(0, bool)
        total, known = 0.0, 0
        plain = lambda v, there: pa.array(v, arrow, mask=~there).to_pylist()
        for piece in (b.slice(i, size) for b in batches for i in range(0, b.num_rows, size)):
            m, own, column = piece.num_rows, piece.column(of), piece.column(len(names))
            begin = own.slice(0, 1) if begin is None else begin
            near = pa.concat_arrays([own.slice(0, 1) if before is None else before, own])
            a, b = near.slice(0, m), near.slice(1)
            same = np.asarray(pc.equal(a, b).fill_null(False)) | (np.asarray(a.is_null()) & np.asarray(b.is_null()))
            same[0] &= before is not None
            before = own.slice(m - 1, 1)
            t = len(tail) if same[0] else 0
            if not same[0]:
                first, total, known = ready is None, 0.0, 0
            starts = np.flatnonzero(np.r_[True, ~same[1:]])
            there = np.r_[held[len(held) - t :], ~np.asarray(column.is_null())]
            v = np.r_[tail[len(tail) - t :], column.fill_null(0).to_numpy()]
            index = np.cumsum(np.r_[0, ~same[1:]])
            begins = np.where(index == 0, 0, starts[index] + t)
            count, found = _meters(v, there, np.r_[np.zeros(t, np.int64), begins], n)
            sums, counts = np.empty(m), np.empty(m, np.int64)
            for i, j in zip(starts, [*starts[1:], m], strict=True):
                np.cumsum(np.where(there[t + i : t + j], v[t + i : t + j], 0), dtype=np.float64, out=sums[i:j])
                np.cumsum(there[t + i : t + j], out=counts[i:j])
            sums[: starts[1] if len(starts) > 1 else m] += total
            counts[: starts[1] if len(starts) > 1 else m] += known
            total, known = float(sums[-1]), int(counts[-1])
            in_first = (index == 0) & first
            first = bool(in_first[-1])
            heads = np.flatnonzero(in_first & (np.arange(m) + t < n - 1)) if t < n - 1 else []
            head = [None] * m
            for i in heads:
                head[i] = plain(v[: t + i + 1], there[: t + i + 1])
            if ready is not None:
                yield packed(*ready)
            low = max(int(begins[-1]), len(v) - (n - 1))
            tail, held = v[low:], there[low:]
            none = count[t:] == 0
            new = [pa.array(found[0][t:], pa.float64(), mask=none), *[pa.array(x[t:], arrow, mask=none) for x in found[1:]]]
            new.append(pa.array(sums / np.maximum(counts, 1), mask=counts == 0))
            here = [pa.array(np.full(m, part, np.int32)), pa.array(sums), pa.array(counts), pa.array(in_first), pa.array(head, pa.list_(arrow))]
            ready = [*piece.columns[:-1], *new], here
        if ready is not None:
            yield packed(*ready, (plain(tail, held), begin))

    def packed(columns: list[pa.Array], here: list[pa.Array], leaves: tuple[list, pa.Array] | None = None) -> pa.RecordBatch:
        """``_edge`` of rows of a range's first series; the last row of a range ``leaves`` its values to the next one."""
        m, shown = len(columns[0]), np.array(here[3])
        tail, opened = pa.nulls(m, pa.list_(arrow)), pa.nulls(m, columns[of].type)
        if leaves is not None:
            shown[-1] = True
            tail, opened = pa.array([None] * (m - 1) + [leaves[0]], pa.list_(arrow)), pa.concat_arrays([opened.slice(1), leaves[1]])
        edges = pa.StructArray.from_arrays([*here, tail, opened], edge.fieldNames(), mask=pa.array(~shown))
        return pa.RecordBatch.from_arrays([*columns, edges], schema.fieldNames())

    values = ArrayType(inner)
    edge = StructType().add("part", IntegerType()).add("sum", DoubleType()).add("count", LongType()).add("first", BooleanType()).add("head", values).add("tail", values).add("opened", df.schema[series].dataType)
    schema = StructType([*df.schema.fields, *[StructField(k, v) for k, v in {"mean_n": DoubleType(), "_median": inner, "_min": inner, "_max": inner, "_mean": DoubleType(), "_edge": edge}.items()]])
    path = new_folder(spark, "rolling")
    ranged.mapInArrow(run, schema).write.parquet(path)
    out = spark.read.schema(schema).parquet(path)

    ends = out.where("_edge.tail is not null").select(F.col(series).alias("_s"), "_edge.*")
    leaves = ends.select("_s", "part", F.lit(1).alias("_k"), "tail", "sum", "count")
    opens = ends.select(F.col("opened").alias("_s"), "part", F.lit(0).alias("_k"), *[F.lit(None).cast(ends.schema[c].dataType).alias(c) for c in ("tail", "sum", "count")])
    along = Window.partitionBy("_s").orderBy("part", "_k")
    upto, late = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(-2 * n, -1)
    carried = leaves.union(opens).select(F.col("part").alias("_part"), "_k", F.sum("sum").over(upto).alias("_before"), F.sum("count").over(upto).alias("_known"), F.flatten(F.collect_list("tail").over(late)).alias("_past")).where("_k = 0 and _known is not null").drop("_k")
    out = out.join(F.broadcast(carried), F.when(F.col("_edge.first"), F.col("_edge.part")) == F.col("_part"), "left")
    count = F.col("_edge.count") + F.col("_known")
    total = F.col("_edge.sum") + F.col("_before")
    so_far = F.when(F.col("_part").isNull(), F.col("_mean")).when(count > 0, total / count)
    past = F.concat("_past", "_edge.head")  # of rows that reach back over the start of a range
    near = F.array_sort(F.array_compact(F.slice(past, F.greatest(F.size(past) - (n - 1), F.lit(1)), n)))
    out = out.withColumn("_w", F.when(F.col("_edge.head").isNotNull() & F.col("_past").isNotNull(), near))
    pick = lambda i, plain: F.when(F.col("_w").isNull(), F.col(plain)).otherwise(F.get("_w", i)).cast(kind)
    mean = F.aggregate("_w", F.lit(0.0), lambda a, x: a + x) / F.when(F.size("_w") > 0, F.size("_w"))
    return out.select(
        *names,
        F.when(F.col("_w").isNull(), F.col("mean_n")).otherwise(mean).alias("mean_n"),
        so_far.alias("mean_all"),
        pick(F.floor((F.size("_w") - 1) / 2).cast("int"), "_median").alias("median_n"),
        pick(F.lit(0), "_min").alias("min_n"),
        pick(F.size("_w") - 1, "_max").alias("max_n"),
    )

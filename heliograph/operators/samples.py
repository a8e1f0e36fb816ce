"""Frames, power and lagged samples; day splits and folds."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.functions.timekeys import from_seconds, seconds, with_position


def split_by_days(df: DataFrame, days: list[str], ts: str = "ts") -> DataFrame:
    """``split`` is test strictly inside a listed day (its midnight isn't), else trainval; days listed twice count once."""
    midnight = F.col(ts) == F.to_date(ts).cast("timestamp_ntz")
    return df.withColumn("split", F.when(F.to_date(ts).cast("string").isin(sorted(set(days))) & ~midnight, "test").otherwise("trainval"))


def label_condition(df: DataFrame, sunny: list[str], ts: str = "ts") -> DataFrame:
    return df.withColumn("cond", F.when(F.to_date(ts).cast("string").isin(sorted(set(sunny))), "sunny").otherwise("cloudy"))


def pair_frames(frames: DataFrame, pv: DataFrame) -> DataFrame:
    """Frames with the power at exactly their time; others are dropped."""
    return frames.join(pv.select(F.col("sensor_id").alias("camera_id"), "ts", "kw"), ["camera_id", "ts"])


def add_horizon(df: DataFrame, pv: DataFrame, horizons: list[int]) -> DataFrame:
    """A row for each horizon (seconds) with ``pv_pred``, the power exactly that much later; rows without it are dropped."""
    ahead = df.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons]))).withColumn("_t", from_seconds(seconds("ts") + F.col("horizon")))
    target = pv.select(F.col("sensor_id").alias("camera_id"), F.col("ts").alias("_t"), F.col("kw").alias("pv_pred"))
    return ahead.join(target, ["camera_id", "_t"]).drop("_t")


def lag_stack(frames: DataFrame, pv: DataFrame, height: int, step: int) -> DataFrame:
    """``camera_id, ts, pv_log``: frames for which a frame and a power value exist at each of ``height`` lags 0, 1, … of ``step``
    seconds; the array begins with now."""
    paired = pair_frames(frames, pv)
    sent = paired.select("camera_id", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("j"), "ts", "kw")
    sent = sent.select("camera_id", "j", from_seconds(seconds("ts") + F.col("j") * step).alias("ts"), "kw")
    stacks = sent.groupBy("camera_id", "ts").agg(F.array_sort(F.collect_list(F.struct("j", "kw"))).alias("s"))
    return stacks.where(F.size("s") == height).select("camera_id", "ts", F.transform("s", lambda x: x["kw"]).alias("pv_log"))


#: Neighbouring maps that are put together at once in ``thin``.
FAN = 64


def _entries(t: np.ndarray, border: int) -> int:
    """How many of the sorted times can be the first kept one of a stretch: those up to ``border``, and the next."""
    return int(np.searchsorted(t, border, "right")) + 1


def thin(candidates: DataFrame, anchor: DataFrame, min_gap: int, fan: int = FAN) -> DataFrame:
    """Greedy thinning in time order: keep a candidate more than ``min_gap`` seconds after the last kept one; the first
    reference is the series' ``anchor`` (``camera_id, ts``).

    Times are dealt to buckets of a day or ``fan`` gaps. The last kept time before a bucket lies before its start, so only times up to
    one gap into it, and the next one, can be its first kept one: each bucket is a map from these to its last kept time. Maps of
    ``fan`` neighbouring buckets are put together to one of their stretch, and so on up to one map a series; then the first kept
    time goes down again from stretch to parts. A group holds what a day or ``fan`` gaps can hold at most, whatever the length of
    the series, and the number of rounds grows with its logarithm.
    """
    size = max(86400, fan * min_gap)
    first = anchor.select("camera_id", seconds("ts").alias("a"))
    late = candidates.select("camera_id", seconds("ts").alias("s")).join(first, "camera_id").where(F.col("s") - F.col("a") > min_gap)
    low, high = late.agg(F.min("s"), F.max("s")).first()
    low = (low or 0) // size
    levels = 0
    while fan**levels <= (high or 0) // size - low:
        levels += 1
    late = late.select("camera_id", (F.floor(F.col("s") / size) - low).alias("bucket"), "s").distinct()
    camera = candidates.schema["camera_id"].dataType.simpleString()
    start = lambda bucket, level: (bucket * fan**level + low) * size

    def following(t: np.ndarray) -> np.ndarray:
        return np.searchsorted(t, t + min_gap, "right")

    def exits(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf["s"].to_numpy(np.int64))
        near, last = following(t), t.copy()
        for i in range(len(t) - 1, -1, -1):
            if near[i] < len(t):
                last[i] = last[near[i]]
        n = _entries(t, start(key[1], 0) - 1 + min_gap)
        return pd.DataFrame({"camera_id": key[0], "bucket": key[1], "entry": t[:n], "last": last[:n]})

    def parts_of(pdf: pd.DataFrame) -> list[tuple[int, np.ndarray, np.ndarray]]:
        return [(int(b), g["entry"].to_numpy(np.int64), g["last"].to_numpy(np.int64)) for b, g in pdf.sort_values(["bucket", "entry"]).groupby("bucket")]

    def put_together(level: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
        def stretch(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            parts = parts_of(pdf)
            every = np.concatenate([entry for _, entry, _ in parts])
            every = every[: _entries(every, start(key[1], level) - 1 + min_gap)]
            last = np.full(len(every), np.iinfo(np.int64).min // 2)
            for _, entry, end in parts:
                own = np.searchsorted(entry, every)
                begins = (own < len(entry)) & (entry[np.minimum(own, len(entry) - 1)] == every)
                at = np.where(begins, own, np.searchsorted(entry, last + min_gap, "right"))
                go = (begins | (last > np.iinfo(np.int64).min // 2)) & (at < len(entry))
                last = np.where(go, end[np.minimum(at, len(entry) - 1)], last)
            return pd.DataFrame({"camera_id": key[0], "bucket": key[1], "entry": every, "last": last})

        return stretch

    def handed_down(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        kept, rows = None, []
        for bucket, entry, end in parts_of(pdf):
            at = int(np.searchsorted(entry, pdf["begin"].iloc[0] if kept is None else kept + min_gap + 1))
            if at < len(entry) and (kept is not None or entry[at] == pdf["begin"].iloc[0]):
                rows.append((key[0], bucket, entry[at]))
                kept = int(end[at])
        return pd.DataFrame(rows, columns=["camera_id", "bucket", "begin"])

    def kept_times(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf["s"].to_numpy(np.int64))
        near, at, rows = following(t), int(np.searchsorted(t, pdf["begin"].iloc[0])), []
        while at < len(t):
            rows.append(t[at])
            at = int(near[at])
        return pd.DataFrame({"camera_id": key[0], "s": rows})

    by, mapped = ["camera_id", "bucket"], f"camera_id {camera}, bucket long, entry long, last long"
    up = F.floor(F.col("bucket") / fan).alias("up")
    maps = [late.groupBy(*by).applyInPandas(exits, mapped)]
    for level in range(1, levels):
        maps.append(maps[-1].groupBy("camera_id", up).applyInPandas(put_together(level), mapped))
    begins = late.groupBy("camera_id").agg(F.min("s").alias("begin")).withColumn("bucket", F.lit(0).cast("long"))
    for below in reversed(maps):
        above = begins.select("camera_id", F.col("bucket").alias("up"), "begin")
        begins = below.withColumn("up", F.floor(F.col("bucket") / fan)).join(above, ["camera_id", "up"]).groupBy("camera_id", "up").applyInPandas(handed_down, f"camera_id {camera}, bucket long, begin long")
    kept = late.join(begins, by).groupBy(*by).applyInPandas(kept_times, f"camera_id {camera}, s long")
    return kept.select("camera_id", from_seconds(F.col("s")).alias("ts"))


def day_block_shuffle(df: DataFrame, seed: int, ts: str = "ts", ties: list[str] | None = None) -> DataFrame:
    """``pos``: whole days in the order of md5 of seed and date, rows of a day in time order."""
    day = df.withColumn("_d", F.to_date(ts).cast("string"))
    key = F.md5(F.concat(F.lit(f"{seed}-"), F.col("_d")))
    return with_position(day, "_d", [key, F.col("_d")], [F.col(c) for c in [ts, *(ties or [])]]).drop("_d")


def kfold(df: DataFrame, k: int, n: int) -> DataFrame:
    """``fold`` that validates each position: fold i has ``[i n // k, (i + 1) n // k)``."""
    return df.withColumn("fold", _fold(F.col("pos"), k, n))


def _fold(pos: Column, k: int, n: int) -> Column:
    out = F.lit(0)
    for i in range(1, k):
        out = F.when(pos >= i * n // k, F.lit(i)).otherwise(out)
    return out


def holdout(df: DataFrame, ratio: float, n: int) -> DataFrame:
    return df.withColumn("split", F.when(F.col("pos") < int(ratio * n), "train").otherwise("val"))


def take_fraction(df: DataFrame, fraction: float, n: int) -> DataFrame:
    return df.where(F.col("pos") < int(n * fraction))


def find_ramps(df: DataFrame, stride: int, drop: float) -> DataFrame:
    """Every ``stride``-th sample whose oldest power is more than ``drop`` above its future power."""
    return df.where((F.col("pos") % stride == 0) & (F.element_at("pv_log", -1) - F.col("pv_pred") > drop))


def pending(df: DataFrame, done: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows later than all that is done."""
    mark = done.agg(F.max(ts).alias("_m"))
    return df.join(F.broadcast(mark), F.col("_m").isNull() | (F.col(ts) > F.col("_m"))).drop("_m")


def in_days(df: DataFrame, first: str, last: str, ts: str = "ts") -> DataFrame:
    """Rows of the days from ``first`` to ``last``, both included."""
    return df.where((F.to_date(ts) >= F.lit(first).cast("date")) & (F.to_date(ts) <= F.lit(last).cast("date")))


def without_output(df: DataFrame, outputs: DataFrame, name: str) -> DataFrame:
    """Rows whose ``name`` isn't among those of ``outputs``; a null name has no output."""
    return df.join(outputs.select(name).distinct(), name, "left_anti")


def split_counts(df: DataFrame, by: list[str], split: str = "split") -> DataFrame:
    return df.groupBy(*by, split).agg(F.count(F.lit(1)).alias("n"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    """All rows of tables with the same columns in any order."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def distinct_days(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.select(F.to_date(ts).alias("day")).distinct()


def complement(days: DataFrame, without: DataFrame) -> DataFrame:
    """Days of the first table that the second doesn't list."""
    return days.join(without.select("day").distinct(), "day", "left_anti")


def latest_frame(df: DataFrame, series: str = "camera_id", ts: str = "ts") -> DataFrame:
    return df.groupBy(series).agg(F.max(ts).alias(ts))


def density_hist(df: DataFrame, value: str, by: str, bins: int = 50) -> DataFrame:
    """Density in ``bins`` equal bins from least to greatest value of each group; the last is closed, empty ones are zero."""
    span = df.groupBy(by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_n"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    hit = df.join(span, by).where(F.col(value).isNotNull()).withColumn("bin", F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1)).cast("int"))
    counts = hit.groupBy(by, "bin").agg(F.count(F.lit(1)).alias("_c"))
    every = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(counts, [by, "bin"], "left").select(by, "bin", (F.coalesce("_c", F.lit(0)) / (F.col("_n") * width)).alias("density"))


def dest_path(ts: Column) -> Column:
    return F.concat_ws("/", F.date_format(ts, "yyyy"), F.date_format(ts, "MM"), F.date_format(ts, "dd"), F.concat(F.date_format(ts, "yyyyMMddHHmmss"), F.lit(".jpg")))


def parse_video_names(df: DataFrame, name: str) -> DataFrame:
    """``name, start_ts, end_ts``: short names hold a start, long ones the third and second token from the end; others go."""
    n = F.col(name)
    parts = F.split(n, "_")
    at = lambda s: F.try_to_timestamp(s, F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")
    short = F.try_to_timestamp(F.regexp_extract(n, r"^(\d{8}-\d{6})-01\.avi$", 1), F.lit("yyyyMMdd-HHmmss")).cast("timestamp_ntz")
    start = F.when(F.length(n) < 30, short).otherwise(at(F.try_element_at(parts, F.lit(-3))))
    end = F.when(F.length(n) >= 30, at(F.try_element_at(parts, F.lit(-2))))
    return df.where(~n.endswith(".jpg") & ~n.endswith(".db")).select(n.alias("name"), start.alias("start_ts"), end.alias("end_ts")).where("start_ts is not null")


def capture_plan(videos: DataFrame, align: int = 10, every: int = 60) -> DataFrame:
    """``video, shot_ts, offset_ms``: from the next ``align`` mark after the start, every ``every`` seconds to the end."""
    first = (F.floor(seconds("start_ts") / align) + 1) * align
    shots = videos.where(first <= seconds("end_ts")).select("video", seconds("start_ts").alias("_s"), F.explode(F.sequence(first, seconds("end_ts"), F.lit(every).cast("long"))).alias("g"))
    return shots.select("video", from_seconds(F.col("g")).alias("shot_ts"), ((F.col("g") - F.col("_s")) * 1000).alias("offset_ms"))

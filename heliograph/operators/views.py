"""Video manifests, clip index plans, corpora, and the merging of multi-view results."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heliograph.functions.arrays import add_vectors, indices, let, total


def expand_views(df: DataFrame, n_chunk: int, n_crop: int) -> DataFrame:
    """Each clip for every chunk and crop; indices only."""
    pair = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    return df.withColumn("chunk", F.explode(pair(n_chunk))).withColumn("crop", F.explode(pair(n_crop)))


def merge_corpora(train: DataFrame, val: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """``split`` train or val: one row an id (the first in ``order``), ids of train removed from val."""

    def first(df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c != id_col]
        return df.groupBy(id_col).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_r")).select(id_col, *[F.col("_r")[c].alias(c) for c in rest])

    a, b = first(train), first(val)
    return a.withColumn("split", F.lit("train")).unionByName(b.join(a.select(id_col), id_col, "left_anti").withColumn("split", F.lit("val")))


def map_labels(df: DataFrame, label: str, synonyms: dict[str, str], classes: DataFrame) -> DataFrame:
    """``name``, the synonym's kept name or the label itself, and its ``class_id``; label maps are fixed, small tables."""
    kept = F.col(label)
    for a, b in synonyms.items():
        kept = F.when(F.col(label) == a, F.lit(b)).otherwise(kept)
    return df.withColumn("name", kept).join(classes.select("name", "class_id"), "name", "left")


def remap_logits(logits: Column, index: list[int]) -> Column:
    return F.transform(F.array(*[F.lit(i) for i in index]), lambda i: F.get(logits, i))


def softmax(x: Column) -> Column:
    """Exponentials over their sum; maximum and sum are worked out once a row."""
    powers = let(x, lambda v: let(F.array_max(v), lambda m: F.transform(v, lambda e: F.exp(e - m))))
    return let(powers, lambda e: let(total(e), lambda s: F.transform(e, lambda v: v / s)))


def merge_views(df: DataFrame, order: list[str], method: str = "prob") -> DataFrame:
    """``clip, label, merged``: of equal (clip, chunk, crop) the first in ``order``, softmax each (``prob``) or not, mean by class.

    Rows are dealt by clip once: repeated views are left out and the vectors of a clip, at most one for each chunk and crop, are
    added up there. Vectors of a clip have one length; a clip without a vector has a null ``merged``.
    """
    first = Window.partitionBy("clip", "chunk", "crop").orderBy(*order)
    one = df.repartition("clip").withColumn("_n", F.row_number().over(first)).where("_n = 1")
    one = one.select("clip", "label", (softmax(F.col("logits")) if method == "prob" else F.col("logits")).alias("_v"))
    clips = one.groupBy("clip").agg(F.min("label").alias("label"), F.collect_list("_v").alias("_v"))
    mean = let(F.size("_v"), lambda n: F.transform(add_vectors(F.col("_v")), lambda s: s / n))
    return clips.select("clip", "label", F.when(F.size("_v") > 0, mean).alias("merged"))


def top_classes(scores: Column, k: int) -> Column:
    """The k best indices, ties to the lower one."""
    ranked = F.array_sort(F.transform(scores, lambda v, i: F.struct((-v).alias("v"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, k), lambda s: s["i"])


def topk_accuracy(merged: DataFrame, ks: list[int]) -> DataFrame:
    hit = lambda k: F.avg(F.when(F.array_contains(top_classes(F.col("merged"), k), F.col("label").cast("int")), 100.0).otherwise(0.0)).alias(f"top{k}")
    return merged.agg(*[hit(k) for k in ks], F.count(F.lit(1)).alias("n"))


def sliding_windows(total: Column, length: int, stride: int) -> Column:
    """Starts 0, stride, … while a window of ``length`` fits."""
    return F.when(total >= length, F.sequence(F.lit(0), total.cast("int") - length, F.lit(stride))).otherwise(F.array().cast("array<int>"))


def stack_features(df: DataFrame, video: str, start: str, vector: str) -> DataFrame:
    return df.groupBy(video).agg(F.transform(F.array_sort(F.collect_list(F.struct(start, vector))), lambda s: s[vector]).alias("features"))


def dense_clip(total: Column, length: int, rate: int) -> Column:
    """Validation indices of one segment: spread evenly over a short video and padded, or the middle stretch of a long one."""
    span, n = length * rate, total.cast("int")
    many = F.floor(n / rate).cast("int")
    at = lambda a, b, num, k: F.when(num > 1, a + k * (b - a) / (num - 1)).otherwise(a.cast("double"))
    ks = F.sequence(F.lit(0), F.lit(length - 1))
    short = F.transform(ks, lambda k: F.greatest(F.lit(0), F.least(F.when(k < many, at(F.lit(0), n, many, k)).otherwise(n.cast("double")), (n - 1).cast("double"))).cast("int"))
    end = F.floor((F.lit(span) + n) / 2).cast("int")
    long = F.transform(ks, lambda k: F.greatest(end - span, F.least(at(end - span, end, F.lit(length), k), (end - 1).cast("double"))).cast("int"))
    return F.when(n <= span, short).otherwise(long)


def _draw(seed: int, key: Column, *more: Column) -> Column:
    """A whole number below 2^32 from the md5 of seed, key and more."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), *[c.cast("string") for c in (key, *more)])), 1, 8), 16, 10).cast("long")


def dense_train(total: Column, key: Column, length: int, rate: int, segments: int, seed: int) -> Column:
    """Training indices of ``segments`` equal parts, one after the other: like ``dense_clip`` in a part no longer than the span, else
    a stretch whose end is drawn (md5 of seed, key and part) from the span up to the part's length."""
    span = length * rate
    part = F.floor(total / segments).cast("int")

    def clip(i: Column) -> Column:
        end = (F.lit(span) + _draw(seed, key, i) % F.greatest(part - span, F.lit(1))).cast("int")
        stretch = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda k: F.least(end - span + k * F.lit(span) / (length - 1), (end - 1).cast("double")).cast("int"))
        return F.transform(F.when(part <= span, dense_clip(part, length, rate)).otherwise(stretch), lambda x: x + i * part)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(segments - 1)), clip))


def dense_test(total: Column, length: int, rate: int) -> Column:
    """0, rate, 2 rate, … below the total, the last repeated up to ``length``."""
    n = total.cast("int")
    ids = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(rate))).otherwise(F.array().cast("array<int>"))
    return F.when(F.size(ids) < length, F.concat(ids, F.array_repeat(F.element_at(ids, -1), (F.lit(length) - F.size(ids)).cast("int")))).otherwise(ids)


def sparse_clip(total: Column, segments: int, start: int = 0) -> Column:
    """Validation indices from ``start``: the middle of each of ``segments`` equal parts; a shorter video is padded with its first
    frame."""
    n = total.cast("int")
    avg = F.floor(n / segments).cast("int")
    ks = F.sequence(F.lit(0), F.lit(segments - 1))
    short = F.transform(ks, lambda k: F.greatest(F.lit(0), k - (F.lit(segments) - n)))
    return F.transform(F.when(avg > 0, F.transform(ks, lambda k: k * avg + F.floor(avg / 2).cast("int"))).otherwise(short), lambda i: i + start)


def sparse_train(total: Column, key: Column, segments: int, seed: int, start: int = 0) -> Column:
    """Training indices from ``start``: one drawn place (md5 of seed, key and part) in each of ``segments`` equal parts; a video no
    longer than ``segments`` frames is padded with its first frame, as in ``sparse_clip``."""
    n = total.cast("int")
    ks = indices(segments)
    part = F.floor(n / segments).cast("int")
    drawn = F.transform(ks, lambda k: k * part + (_draw(seed, key, k) % F.greatest(part, F.lit(1))).cast("int"))
    short = F.transform(ks, lambda k: F.greatest(F.lit(0), k - (F.lit(segments) - n)))
    return F.transform(F.when(part > 0, drawn).otherwise(short), lambda i: i + start)


def sparse_test(total: Column, segments: int, views: int, start: int = 0) -> Column:
    """Sorted test indices ``start + int(s tick / views + tick x)`` over views and segments, tick the length of a segment."""
    tick = total / segments
    every = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(views - 1)), lambda s: F.transform(F.sequence(F.lit(0), F.lit(segments - 1)), lambda x: F.floor(s * tick / views + tick * x).cast("int"))))
    return F.transform(F.array_sort(every), lambda i: i + start)


def pretrain_clip(total: Column, key: Column, length: int, step: int, seed: int) -> Column:
    """A seeded start (md5 of seed and key) and ``length`` frame numbers from 1, ``step`` apart; the offset grows only while it
    stays below ``total``, then it is repeated."""
    n = total.cast("int")
    room = F.greatest(n - (length * step - 1), F.lit(1))
    start = (_draw(seed, key) % room).cast("int") + 1
    most = F.greatest(F.floor((n - start - 1) / step), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: start + step * F.least(i, most))


@dataclass(frozen=True)
class FrameRule:
    """How frames of videos whose path contains ``part`` are named (a ``format_string`` pattern) and stepped (None: as asked)."""

    part: str
    pattern: str = "img_%05d.jpg"
    step: int | None = None


#: Raw-frame sources with a naming or step of their own; the first that fits counts, others follow the plain rule.
FRAME_RULES = (FrameRule("SomethingV2", "img_%05d.jpg", 2), FrameRule("AVA2.2", "image_%06d.jpg"))
PLAIN_RULE = FrameRule("")


def by_rule(path: Column, rules: tuple[FrameRule, ...], value: Callable[[FrameRule], Column], plain: FrameRule = PLAIN_RULE) -> Column:
    """``value`` of the first rule whose part the path contains, or of the plain rule; a null path follows the plain rule."""
    out = value(plain)
    for rule in reversed(rules):
        out = F.when(F.contains(path, F.lit(rule.part)), value(rule)).otherwise(out)
    return out


def frame_names(path: Column, frames: Column, rules: tuple[FrameRule, ...] = FRAME_RULES, plain: FrameRule = PLAIN_RULE) -> Column:
    """The file of each frame number, below ``path`` and named by its source."""
    pattern = by_rule(path, rules, lambda r: F.lit(r.pattern), plain)
    return let(pattern, lambda p: F.transform(frames, lambda i: F.concat_ws("/", path, F.call_function("format_string", p, i))))


def pretrain_indices(total: Column, key: Column, length: int, step: int, seed: int, segments: int = 1, jitter: bool = False) -> Column:
    """0-based frames of ``segments`` stretches of ``length`` frames, ``step`` apart.

    Starts are drawn (md5 of seed, key and segment): one in each equal part of the places where a stretch fits; in a video with fewer
    such places than segments any places, in order; in one that is too short the first frame. An offset grows only while it stays
    below the end. ``jitter`` adds to the i-th frame of each stretch a drawn number below ``step`` (md5 of seed, key, "jitter" and i),
    unless that passes the end.
    """
    n, skip = total.cast("int"), length * step
    part = F.floor((n - skip + 1) / segments).cast("int")
    ks = indices(segments)
    inside = F.transform(ks, lambda k: k * part + (_draw(seed, key, k) % F.greatest(part, F.lit(1))).cast("int"))
    anywhere = F.array_sort(F.transform(ks, lambda k: (_draw(seed, key, k) % F.greatest(n - skip + 1, F.lit(1))).cast("int")))
    starts = F.when(part > 0, inside).when(n > max(segments, skip), anywhere).otherwise(F.array_repeat(F.lit(0), segments))
    shift = lambda i: (_draw(seed, key, F.lit("jitter"), i) % step).cast("int") if jitter else F.lit(0)

    def stretch(start: Column) -> Column:  # offsets from 1: start + 1, then one step more while that stays below n
        most = F.greatest(F.ceil((n - 1 - start) / step).cast("int") - 1, F.lit(0))

        def frame(i: Column) -> Column:
            offset = start + 1 + step * F.least(i, most)
            return F.when(offset + shift(i) <= n, offset + shift(i)).otherwise(offset) - 1

        return F.transform(indices(length), frame)

    return F.flatten(F.transform(starts, stretch))


def pretrain_frames(df: DataFrame, length: int, step: int, seed: int, segments: int = 1, jitter: bool = False, rules: tuple[FrameRule, ...] = FRAME_RULES, plain: FrameRule = PLAIN_RULE) -> DataFrame:
    """A manifest (``path, start, total``) with ``frames``, 0-based, and ``files``, their names from ``start`` on; the step is that of
    the path's source where a rule has one. A video (a total below 0) is read by frame number and has no files."""
    frames = by_rule(F.col("path"), rules, lambda r: pretrain_indices(F.col("total"), F.col("path"), length, r.step or step, seed, segments, jitter), plain)
    out = df.withColumn("frames", frames)
    return out.withColumn("files", F.when(F.col("total") >= 0, frame_names(F.col("path"), F.transform("frames", lambda i: i + F.col("start")), rules, plain)))


def view_slices(df: DataFrame, length: int, n_chunk: int, n_crop: int, short: int) -> DataFrame:
    """Frame and pixel offsets of each view; the longer side is cut (height if equal)."""
    step = F.greatest((F.col("total") - length) / (n_chunk - 1), F.lit(0.0)) if n_chunk > 1 else F.lit(0.0)
    side = (F.greatest("height", "width") - short) / (n_crop - 1) if n_crop > 1 else F.lit(0.0)
    out = df.withColumn("frame0", F.floor(F.col("chunk") * step).cast("int")).withColumn("pixel0", F.floor(F.col("crop") * side).cast("int"))
    return out.withColumn("axis", F.when(F.col("height") >= F.col("width"), "height").otherwise("width"))


def repeat_samples(df: DataFrame, k: int) -> DataFrame:
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(k))))

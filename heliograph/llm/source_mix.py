"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Targets share a budget by weight, stop at a multiple of each source's size, and pass the excess on. Blocks go to sources by
highest quotients, then to groups of shards and to shards within a source in the same way, which gives integer quotas; inside
a shard a seeded order of blocks decides which are taken.

Defined results: a null text has size 0 and is never taken; null sources are one source, last in order; rows of equal ``doc_id``
and text are interchangeable; extra columns are ignored; an empty table gives an empty result. The same rows give the same result.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heliograph.llm.shared import words, written

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
BLOCK = 50
#: Words in a shard, on average; a document counts at least DOC_WORDS, so that shards of empty documents are bounded as well.
SHARD_WORDS = 250_000
DOC_WORDS = 16
FANOUT = 1024
SEED = 20
#: Rows meet the table of sources by source and salt, so that a hot source's rows are dealt to so many tasks.
SALTS = 16


def sainte_lague(weights: list[float], seats: int) -> list[int]:
    """Seats by the ``seats`` highest quotients ``w / (2 k + 1)``; ties go to the first. All zero weights: no seats."""
    total = math.fsum(weights)
    if total <= 0 or seats <= 0:
        return [0] * len(weights)
    out = [math.floor(w * seats / total + 0.5) for w in weights]
    left = seats - sum(out)
    if left > 0:
        heap = [(-w / (2 * a + 1), i) for i, (w, a) in enumerate(zip(weights, out, strict=True)) if w > 0]
        heapq.heapify(heap)
        for _ in range(left):
            _, i = heap[0]
            out[i] += 1
            heapq.heapreplace(heap, (-weights[i] / (2 * out[i] + 1), i))
    elif left < 0:
        heap = [(w / (2 * a - 1), -i) for i, (w, a) in enumerate(zip(weights, out, strict=True)) if a > 0]
        heapq.heapify(heap)
        for _ in range(-left):
            _, i = heapq.heappop(heap)
            out[-i] -= 1
            if out[-i] > 0:
                heapq.heappush(heap, (weights[-i] / (2 * out[-i] - 1), i))
    return out


def with_sums_before(df: DataFrame, order: list[Column], values: dict[str, Column]) -> DataFrame:
    """``df`` with, for each name, the sum of its value over all rows before a row in ``order`` (a total order): sums inside range
    partitions, and what is before a partition from one row each."""
    placed = written(df.withColumns(values).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("_part").agg(*[F.sum(n).alias(n) for n in values])
    parts = parts.select("_part", *[F.coalesce(F.sum(n).over(upto), F.lit(0)).alias(f"_{n}") for n in values])
    out = placed.withColumns({n: F.coalesce(F.sum(n).over(inside), F.lit(0)) for n in values}).join(F.broadcast(parts), "_part")
    return out.withColumns({n: F.col(n) + F.col(f"_{n}") for n in values}).drop("_part", *[f"_{n}" for n in values])


def with_targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> tuple[DataFrame, float]:
    """``source, size`` with ``place``, ``weight`` and ``target``, and the sum of all targets.

    Shares of ``share`` times all sizes by weight, none above ``most`` times its size, the excess shared again by weight. By the
    rate at which a source is full, the full ones come first; the rest share what these leave.
    """
    by_name = F.col("source").asc_nulls_last()
    placed = with_sums_before(totals, [by_name], {"place": F.lit(1).cast("long")})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    placed = written(placed.withColumn("weight", weight).withColumn("full_at", most * F.col("size") / F.col("weight")), "sources")
    whole = placed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.sum(F.when(F.col("size") > 0, F.col("weight"))).alias("weight")).first()
    budget = share * whole["size"]
    open_ = with_sums_before(placed.where("size > 0"), [F.col("full_at"), F.col("place")], {"size_before": F.col("size"), "weight_before": F.col("weight")})
    rate = (F.lit(budget) - most * F.col("size_before")) / (F.lit(whole["weight"] or 0.0) - F.col("weight_before"))
    found = open_.withColumn("rate", rate).where("rate <= full_at").agg(F.min_by("rate", F.struct("full_at", "place")).alias("rate")).first()["rate"]
    full = most * F.col("size")
    target = full if found is None else F.least(full, F.col("weight") * F.lit(found))
    return placed.withColumn("target", target.cast("double")), most * whole["size"] if found is None else budget


def with_seats(df: DataFrame, weight: str, place: str, total: float, seats: int) -> DataFrame:
    """``df`` with ``quota``: Sainte-Laguë seats by the ``seats`` highest quotients over all rows; ties go to the first ``place``.

    Rounding at a divisor that gives at most ``seats``, and at one that gives at least as many, leaves some two quotients a row
    to be ranked.
    """
    if seats <= 0 or total <= 0:
        return df.withColumn("quota", F.lit(0).cast("long"))
    n = df.count()
    w, few, many = F.col(weight), max(0.0, seats - n / 2 - 1) / total, (seats + n / 2 + 1) / total
    base = df.withColumn("_low", F.floor(w * few + 0.5) if few else F.lit(0).cast("long")).withColumn("_high", F.floor(w * many + 0.5))
    left = seats - base.agg(F.sum("_low").alias("n")).first()["n"]
    step = 1024
    runs = base.where("_high > _low").select(place, weight, "_high", F.explode(F.sequence(F.col("_low") + 1, F.col("_high"), F.lit(step).cast("long"))).alias("_a"))
    each = runs.select(place, weight, F.explode(F.sequence("_a", F.least("_high", F.col("_a") + step - 1))).alias("_k"))
    each = each.select(F.col(place).alias("_place"), "_k", (F.col(weight) / (2 * F.col("_k") - 1)).alias("_quotient"))
    ranked = with_sums_before(each, [F.col("_quotient").desc(), F.col("_place"), F.col("_k")], {"_rank": F.lit(1).cast("long")})
    more = ranked.where(F.col("_rank") < left).groupBy("_place").agg(F.count(F.lit(1)).alias("_more"))
    out = base.join(more, F.col(place) == F.col("_place"), "left")
    return out.withColumn("quota", F.col("_low") + F.coalesce("_more", F.lit(0))).drop("_low", "_high", "_place", "_more")


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of each number."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def taken_in_shard(sizes: np.ndarray, quota: int, key: int, most: float = MOST, block: int = BLOCK) -> np.ndarray:
    """Words taken of each document: the shard's words in a row are cut in blocks, whole passes are taken first, then the blocks
    whose seeded hash is lowest; never above ``most`` passes."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    if not total or not quota:
        return np.zeros(len(sizes), dtype=np.int64)
    wanted = min(quota * block, int(most * total))
    passes, rest = divmod(wanted, total)
    blocks = -(-total // block)
    n = min(blocks, int(rest / block + 0.5)) if passes < most else 0
    with np.errstate(over="ignore"):
        order = np.argsort(_mixed(np.arange(blocks, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (2**64 - 1))), kind="stable")
    chosen = np.zeros(blocks + 1, dtype=np.int64)
    chosen[order[:n]] = 1
    lengths = np.minimum(block, total - np.arange(blocks) * block)
    upto = np.concatenate([[0], np.cumsum(lengths * chosen[:-1])])
    at = lambda x: upto[x // block] + chosen[x // block] * (x % block)
    return passes * sizes + at(ends) - at(ends - sizes)


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` for each document.

    One table of sizes is written; sources, shards and their quotas stay in Spark. A hot source has more shards, and small sources
    are handled many at a time, so a task's group holds about SHARD_WORDS words' worth of sizes.
    """
    size = F.size(words(F.col(text))).cast("long")
    mark = F.xxhash64(F.lit(seed), F.col(doc_id).cast("string"), F.coalesce(F.col(text), F.lit("")))
    sized = written(docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(source).cast("string").alias("source"), size.alias("size"), mark.alias("mark")), "sizes")
    goals, total = with_targets(sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("docs")), weights)
    planned = with_seats(goals, "target", "place", total, round(total / BLOCK))
    room = F.col("size") + DOC_WORDS * F.col("docs")
    planned = written(planned.select("source", "place", F.col("size").alias("source_size"), "target", "quota", room.alias("room"), F.ceil(room / SHARD_WORDS).alias("shards")), "plan")
    lots = 1 + (planned.where("shards = 1").agg(F.sum("room").alias("n")).first()["n"] or 0) // SHARD_WORDS

    salted = planned.select(F.col("source").alias("name"), "place", "source_size", "target", "quota", "shards", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = sized.withColumn("own", F.pmod(F.xxhash64("mark"), F.lit(SALTS)).cast("int")).join(salted, F.col("source").eqNullSafe(F.col("name")) & (F.col("own") == F.col("salt")))
    placed = met.withColumn("shard", F.pmod("mark", "shards")).withColumn("band", F.floor(F.col("shard") / FANOUT))
    shards = placed.where("shards > 1").groupBy("place", "band", "shard").agg(F.sum("size").alias("w"), F.first("quota").alias("quota"))

    def shared(pdf: pd.DataFrame, by: str) -> pd.DataFrame:
        pdf = pdf.sort_values(by, ignore_index=True)
        return pdf.assign(quota=sainte_lague([float(x) for x in pdf["w"]], int(pdf["quota"].iloc[0])))

    bands = shards.groupBy("place", "band").agg(F.sum("w").alias("w"), F.first("quota").alias("quota"))
    bands = bands.groupBy("place").applyInPandas(lambda pdf: shared(pdf, "band"), "place long, band long, w long, quota long")
    shards = shards.drop("quota").join(bands.select("place", "band", "quota"), ["place", "band"])
    quotas = shards.groupBy("place", "band").applyInPandas(lambda pdf: shared(pdf, "shard"), "place long, band long, shard long, w long, quota long")
    quotas = written(quotas.select(F.col("place").alias("p"), F.col("shard").alias("k"), F.col("quota").alias("blocks")), "quotas")

    def taken(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["place", "shard", "mark", "doc_id", "size"], ignore_index=True)
        out = np.zeros(len(pdf), dtype=np.int64)
        sizes, blocks, shard = (pdf[c].to_numpy(np.int64) for c in ("size", "blocks", "shard"))
        edges = np.flatnonzero(np.r_[True, (np.diff(pdf["place"]) != 0) | (np.diff(shard) != 0), True])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            out[a:b] = taken_in_shard(sizes[a:b], int(blocks[a]), int(shard[a]) * 1_000_003 + seed)
        return pdf.assign(taken=out)[["doc_id", "source", "size", "source_size", "target", "taken"]]

    kind = docs.schema[doc_id].dataType
    out = placed.join(quotas, (F.col("place") == F.col("p")) & (F.col("shard") == F.col("k")), "left")
    lot = F.when(F.col("shards") > 1, F.xxhash64("place", "shard")).otherwise(F.pmod(F.xxhash64("place"), F.lit(lots)))
    out = out.select("doc_id", "source", "size", "source_size", "target", "mark", "place", "shard", F.coalesce("blocks", "quota").alias("blocks"), lot.alias("lot"))
    out = out.groupBy("lot").applyInPandas(taken, "doc_id string, source string, size long, source_size long, target double, taken long")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))

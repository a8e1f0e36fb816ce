"""Benchmark decontamination with SimHash over item-sized windows; DataFrame functions only.

A window that reaches the similarity shares four fifths of an item's shingles at least. So one of the item's key shingles is in
it: the rarest among items, a fifth of its shingles and one more. Documents with a key shingle are looked at closely: windows
as long as the item start wherever a word shingle lines up with the same shingle of the item. Windows and items get SimHashes
of their words; a window meets its item where one of BLOCKS blocks of bits is equal, which finds every pair that differs in
fewer bits than there are blocks; pairs are then verified by the weighted Jaccard similarity of their shingles, counted with
repeats. A pair at 0.8 differs in 9.7 bits in the mean and in 22 or more once in ten thousand at most.

Defined results: null or empty texts match nothing; an item or document shorter than a shingle is one shingle of its own;
items with equal texts are reported each; repeated documents give one row a pair; extra columns are ignored; an empty table on
either side gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heliograph.llm.shared import let, shifted, window_hashes, written

SHINGLE = 5
SIMILARITY = 0.8
#: Blocks of two or three bits: every pair within RADIUS differing bits is found.
RADIUS = 21
BLOCKS = RADIUS + 1


def plain_words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), "")


def simhash(hashes: Column) -> Column:
    """Bitwise majority over an array of longs."""
    ones = lambda b: F.aggregate(hashes, F.lit(0).cast("long"), lambda n, h: n + F.shiftrightunsigned(h, b).bitwiseAND(F.lit(1).cast("long")))
    set_ = [F.when(2 * ones(b) > F.size(hashes), F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for b in range(64)]
    while len(set_) > 1:
        set_ = [x.bitwiseOR(y) for x, y in zip(set_[::2], set_[1::2], strict=True)]
    return set_[0]


def counted(hashes: Column) -> Column:
    """An array of longs as a set: each with the number of its occurrence, so that set sizes weigh repeats. Runs of the sorted array
    are numbered one by one."""
    begins = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.coalesce(F.get(s, i - 1) != F.get(s, i), F.lit(True)))
    numbered = lambda s, a, b: F.transform(F.sequence(F.lit(1), b - a), lambda j: F.xxhash64(F.get(s, a), j))
    runs = lambda s: let(begins(s), lambda at: F.flatten(F.zip_with(at, F.concat(shifted(at, 1), F.array(F.size(s))), lambda a, b: numbered(s, a, b))))
    return let(F.sort_array(hashes), lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(F.array().cast("array<bigint>")))


def stretches(places: DataFrame, keys: list[str], at: str, first: str, last: str) -> DataFrame:
    """``keys, first, last``: runs of neighbouring whole numbers ``at``."""
    run = F.col(at) - F.row_number().over(Window.partitionBy(*keys).orderBy(at))
    return places.withColumn("_run", run).groupBy(*keys, "_run").agg(F.min(at).alias(first), F.max(at).alias(last)).drop("_run")


def block_values(fp: Column) -> Column:
    edges = [round(i * 64 / BLOCKS) for i in range(BLOCKS + 1)]
    cut = [F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << high - low) - 1).cast("long")) for low, high in zip(edges, edges[1:], strict=False)]
    return F.array(*[F.struct(F.lit(i).alias("block"), bits.alias("bits")) for i, bits in enumerate(cut)])


def within_radius(windows: DataFrame, items: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``rid, item_id, n, start`` of the windows whose fingerprints differ from their item's in at most ``radius`` bits."""
    blocks = windows.select("rid", "item_id", "n", "start", "fp", F.inline(block_values(F.col("fp"))).alias("block", "bits"))
    theirs = items.select("item_id", "n", F.col("fp").alias("other"), F.inline(block_values(F.col("fp"))).alias("block", "bits"))
    met = blocks.join(theirs, ["item_id", "n", "block", "bits"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius)
    return met.select("rid", "item_id", "n", "start").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, item_id, start_word, n_words, similarity``: the best window of each pair that reaches ``similarity``.

    Tables of items are written and joined by their size; the wide ones (shingle sets) meet verified pairs only.
    """
    hashed = lambda t: F.transform(plain_words(t), lambda w: F.xxhash64(w))
    items = benchmark.select(F.col(item_id).alias("item_id"), hashed(F.col(item_text)).alias("w")).where(F.size("w") > 0).withColumn("n", F.size("w")).withColumn("width", F.least(F.col("n"), F.lit(SHINGLE)))
    by_width = F.array().cast("array<bigint>")
    for k in range(1, SHINGLE + 1):
        by_width = F.when(F.col("width") == k, window_hashes(F.col("w"), k)).otherwise(by_width)
    items = written(items.select("item_id", "n", "width", by_width.alias("hs"), simhash(F.col("w")).alias("fp")), "items")
    starts = written(items.select("item_id", "n", "width", F.size("hs").alias("m"), F.posexplode("hs").alias("offset", "h")), "item-shingles")
    held_by = starts.groupBy("width", "h").agg(F.countDistinct("item_id").alias("items"))
    rarest = Window.partitionBy("item_id", "n", "width").orderBy("items", "h", "offset")
    needed = F.col("m") - F.ceil(similarity * F.col("m") - 1e-9) + 1
    keys = starts.join(held_by, ["width", "h"]).withColumn("r", F.row_number().over(rarest)).where(F.col("r") <= needed)
    keys = written(keys.select("item_id", "width", "h").distinct(), "item-keys")

    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    widths = [r["width"] for r in items.select("width").distinct().collect()]  # five at most
    narrow = keys.select("width", "h").distinct()
    hits = base.select("doc_id").where("false")
    for k in widths:
        seen = base.select("doc_id", F.explode(window_hashes(hashed(F.col("text")), k)).alias("h"))
        hits = hits.union(seen.join(narrow.where(F.col("width") == k).select("h"), "h", "left_semi").select("doc_id"))
    hits = hits.distinct().withColumnRenamed("doc_id", "d")
    held = base.join(hits, F.col("doc_id").eqNullSafe(F.col("d"))).select("doc_id", hashed(F.col("text")).alias("w"))
    held = written(held.withColumn("rid", F.monotonically_increasing_id()), "hit-words")

    # a document and the items of which it has a key; where they line up; the windows there
    pieces = [held.select("rid", F.lit(k).alias("width"), F.posexplode(window_hashes(F.col("w"), k)).alias("pos", "h")) for k in widths] or [held.selectExpr("rid", "0 as width", "0 as pos", "0L as h").where("false")]
    seen = pieces[0]
    for more in pieces[1:]:
        seen = seen.union(more)
    pairs = seen.join(keys, ["width", "h"]).select("rid", "width", "item_id").distinct()
    common = seen.join(starts.select("width", "h").distinct(), ["width", "h"], "left_semi")
    here = stretches(common.select("rid", "width", "h", "pos"), ["rid", "width", "h"], "pos", "p0", "p1")
    there = written(stretches(starts.select("item_id", "width", "h", "n", "offset"), ["item_id", "width", "h", "n"], "offset", "o0", "o1"), "item-stretches")
    lined = here.join(pairs, ["rid", "width"]).join(there, ["item_id", "width", "h"])
    lined = lined.select("rid", "item_id", "n", "width", F.explode(F.sequence(F.col("p0") - F.col("o1"), F.col("p1") - F.col("o0"))).alias("start"))
    first = F.greatest(F.lit(0), F.least(F.col("start"), F.col("size") - F.col("n")))
    lined = lined.join(held.select("rid", F.size("w").alias("size")), "rid").select("rid", "item_id", "n", "width", first.alias("start")).distinct()
    windows = lined.join(held.select("rid", "doc_id", "w"), "rid").select("rid", "doc_id", "item_id", "n", "width", "start", F.slice("w", F.col("start") + 1, F.col("n")).alias("w"))
    windows = written(windows.withColumn("fp", simhash(F.col("w"))), "windows")

    met = windows.join(within_radius(windows, items), ["rid", "item_id", "n", "start"])
    hs = F.array().cast("array<bigint>")
    for k in range(1, SHINGLE + 1):
        hs = F.when(F.col("width") == k, window_hashes(F.col("w"), k)).otherwise(hs)
    met = met.select("doc_id", "item_id", "n", "start", counted(hs).alias("mine")).join(items.select("item_id", "n", counted(F.col("hs")).alias("theirs")), ["item_id", "n"])
    both = F.size(F.array_intersect("mine", "theirs"))
    met = met.select("doc_id", "item_id", "start", "n", (both / (F.size("mine") + F.size("theirs") - both)).alias("similarity")).where(F.col("similarity") >= similarity)
    best = met.groupBy("doc_id", "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "start", "n")).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.start").cast("long").alias("start_word"), F.col("best.n").cast("long").alias("n_words"), F.round(-F.col("best.s"), 6).alias("similarity"))

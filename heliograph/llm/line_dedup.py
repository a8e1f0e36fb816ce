"""Line deduplication over a corpus; DataFrame functions only.

Every line becomes a hash with its document and position. The rows are dealt by ranges of (hash, document) and sorted by position
within: a task streams the first occurrence of each hash in each document, and a hash that very many documents hold is spread over
many ranges. Lines that enough documents hold go; what travels back to a document is the list of its dropped positions, and its
result is a bitmap of kept lines, compressed to run lengths. Texts take part in one join only, where the kept text is asked for.

Defined results: a null text is one empty line, like an empty one. A document is a row's id and text: equal rows count once and each
gets the same result; a null id is an id like others. A line whose key is shorter than ``min_chars`` stays (with 0, empty keys count
like others). An empty table gives no rows. Other columns are ignored unless named in ``carry``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heliograph.llm.shared import join_counted, let, shifted, written

#: ASCII white space, and the letters that keys lower.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_DOCS = 10
MIN_CHARS = 1


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``hash, doc, body, pos`` for each line with a long enough key; ``body`` is a hash of id and text, ``pos`` begins at 0."""
    whole = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(doc_id, text).alias("body"), split_lines(F.translate(text, UPPER, LOWER)).alias("lines"))
    rows = whole.select("doc", "body", F.posexplode("lines").alias("pos", "line"))
    key = F.btrim("line", F.lit(BLANKS))
    rows = rows.select("doc", "body", "pos", key.alias("key")).where(F.length("key") >= min_chars)
    return rows.select(F.unhex(F.md5("key")).alias("hash"), "doc", "body", "pos")


def first_occurrences(rows: DataFrame) -> DataFrame:
    """``line_rows`` with ``first``: the row is the first of its hash in its document.

    Ranges are cut by hash and document, which keeps a document's equal lines together, so the window needs no further shuffle.
    """
    dealt = rows.repartitionByRange("hash", "doc", "body").sortWithinPartitions("hash", "doc", "body", "pos")
    return dealt.withColumn("first", F.row_number().over(Window.partitionBy("hash", "doc", "body").orderBy("pos")) == 1)


def dropped_positions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False) -> DataFrame:
    """``doc, body, dropped``: sorted positions of lines that at least ``min_docs`` documents hold, for documents that have one.

    With ``keep_first`` the very first occurrence of such a line, by document and position, stays.
    """
    rows = written(first_occurrences(line_rows(docs, doc_id, text, min_chars)), "lines")
    place = F.struct("doc", "body", "pos")
    wide = rows.groupBy("hash").agg(F.count_if("first").alias("docs"), F.count(F.lit(1)).alias("n"), *([F.min(place).alias("at")] if keep_first else []))
    wide = written(wide.where(F.col("docs") >= min_docs).drop("docs"), "common-lines")
    hits = join_counted(rows.drop("first"), wide, "hash")
    if keep_first:
        hits = hits.where(place != F.col("at"))
    return hits.groupBy("doc", "body").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def run_lengths(dropped: Column, n: Column) -> Column:
    """A bitmap of ``n`` lines as lengths of runs, kept and dropped by turns and beginning with kept ones (0 if the first is dropped)."""

    def runs(at: Column) -> Column:
        starts = F.filter(at, lambda x, i: F.coalesce(F.get(at, i - 1) != x - 1, F.lit(True)))
        ends = F.filter(at, lambda x, i: F.coalesce(F.get(at, i + 1) != x + 1, F.lit(True)))
        return F.flatten(F.zip_with(starts, ends, lambda a, b: F.array(a, b + 1)))

    return let(F.concat(F.array(F.lit(0)), let(dropped, runs), F.array(n)), lambda b: F.zip_with(F.slice(b, 1, F.size(b) - 1), shifted(b, 1), lambda x, y: y - x))


def kept_lines(text: Column, runs: Column) -> Column:
    """The lines of ``text`` that the bitmap ``runs`` keeps, joined by line feeds."""
    bits = F.flatten(F.transform(runs, lambda n, i: F.array_repeat(i % 2 == 0, n)))
    marked = F.zip_with(split_lines(text), bits, lambda line, bit: F.when(bit, line))
    return F.array_join(F.filter(marked, lambda x: x.isNotNull()), "\n")


def line_bitmaps(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), doc_id: str = "doc_id", text: str = "text", with_text: bool = False, **rules: object) -> DataFrame:
    """The ``carry`` columns, ``n_lines``, ``n_dropped`` and ``keep`` (see ``run_lengths``) for each row of ``docs``; no text is
    shuffled unless ``with_text`` asks for ``kept_text``. ``rules`` are those of ``dropped_positions``."""
    gone = dropped_positions(docs, doc_id, text, **rules)
    mine = docs.select(F.struct(*[F.col(c) for c in carry]).alias("row"), F.col(doc_id).alias("id"), F.xxhash64(doc_id, text).alias("of"), F.size(split_lines(F.col(text))).alias("n"), *([F.col(text).alias("whole")] if with_text else []))
    out = mine.join(gone, (F.col("of") == F.col("body")) & F.col("id").eqNullSafe(F.col("doc")), "left")
    none = F.array().cast("array<int>")
    out = out.withColumn("keep", run_lengths(F.coalesce("dropped", none), F.col("n")))
    kept = F.when(F.col("dropped").isNull(), F.coalesce("whole", F.lit(""))).otherwise(kept_lines(F.col("whole"), F.col("keep"))) if with_text else None
    return out.select(*[F.col("row")[c].alias(c) for c in carry], F.col("n").cast("long").alias("n_lines"), F.size(F.coalesce("dropped", none)).cast("long").alias("n_dropped"), "keep", *([kept.alias("kept_text")] if with_text else []))

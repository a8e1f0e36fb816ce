"""Audit of how far the sources of a language differ in their words.

Word counts are added up inside tasks before they are shuffled. The kept words of a language are dealt to blocks of words; a block
is a dense int64 matrix, sources by words, in one task, where each source's row is compared with all others at once. A block gives
partial sums for pairs of sources and, for each source, its ten most telling words; sums are added and the short lists merged.

All arithmetic is on whole numbers and exact: shares are divided digit by digit (three digits a step), so no product leaves int64
for up to 9e15 words of a source or language.

Defined results: null language, source and text are empty strings; every row is a document; a source without words is compared like
others; a language without kept words has pairs of value 0 and no words; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heliograph.llm.shared import join_counted, written

MIN_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
#: Cells of a dense block; bounds a task's memory, not the result.
CELLS = 400_000
#: Words that a task counts before it hands its counts on.
HELD = 200_000
#: In lower-cased UTF-8 bytes: ASCII letters and everything beyond ASCII.
_TERM = re.compile(rb"[a-z\x80-\xff]+")

_COUNTS = "lang binary, source binary, term binary, n long, docs long"


def _task_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words and of documents by language and source; a row without a word tells that a source occurs."""
    names = ("lang", "source", "term", "n", "docs")
    kinds = (pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
    held: dict[tuple[bytes, bytes], dict[bytes, list[int]]] = {}
    size = 0

    def packed() -> pa.RecordBatch:
        rows = [(lang, source, None, 0, 0) for lang, source in held] + [(*key, term, *c) for key, terms in held.items() for term, c in terms.items()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True) if rows else [()] * 5, kinds, strict=True)], names)

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            terms = held.setdefault((lang, source), {})
            before, mine = len(terms), {}
            for term in _TERM.finditer(text.lower()):
                mine[term[0]] = mine.get(term[0], 0) + 1
            for term, n in mine.items():
                c = terms.setdefault(term, [0, 0])
                c[0] += n
                c[1] += 1
            size += len(terms) - before
            if size > HELD:
                yield packed()
                size = 0
    yield packed()


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """``lang, source, term, n, docs`` over all documents, and a row with a null ``term`` for each language and source that occurs."""
    picked = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary").alias(f"_{i}") for i, c in enumerate((lang, source, text))])
    counts = picked.mapInArrow(_task_counts, _COUNTS)
    return counts.groupBy(*[F.col(c).cast("string").alias(c) for c in ("lang", "source", "term")]).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``1 + floor(SCALE * count / total)`` in whole numbers; ``total`` is below 9.2e15."""
    out, rest = np.divmod(count, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d, s = p - q, p + q
    return d * d // s


def _block(block: pa.Table) -> pa.Table:
    """One block: the rows ``source, n`` of a language's sources (``term`` null) and the sparse rows of some of its words."""
    lang, size = block.column("lang")[0].as_py(), block.column("size")[0].as_py()
    whole = block.filter(pa.compute.is_null(block.column("term"))).sort_by("source")
    sources, totals = whole.column("source").to_pylist(), whole.column("n").to_numpy()
    words = block.filter(pa.compute.is_valid(block.column("term"))).sort_by("term")
    terms, by = words.column("term").to_pylist(), words.column("by").combine_chunks()
    counts = np.zeros((len(sources), len(terms)), np.int64)
    if terms:
        flat = by.flatten()
        column = np.repeat(np.arange(len(terms)), pa.compute.list_value_length(by).to_numpy(zero_copy_only=False).astype(np.int64))
        row = pa.compute.index_in(flat.field("source"), value_set=whole.column("source").combine_chunks()).to_numpy(zero_copy_only=False)
        counts[row, column] = flat.field("n").to_numpy(zero_copy_only=False)
    rows: list[tuple] = []
    if terms:
        share = _share(counts + 2, (totals + 2 * size)[:, None])
        common = _share(counts.sum(axis=0) + 2, np.array([totals.sum() + 2 * size]))
    else:
        share, common = np.zeros((len(sources), 0), np.int64), np.zeros(0, np.int64)
    for i, source in enumerate(sources):
        sums = divergence(share[i], share[i + 1 :]).sum(axis=1)
        rows += [(lang, source, "pair", other, int(v)) for other, v in zip(sources[i + 1 :], sums, strict=True)]
        telling = np.flatnonzero((counts[i] > 0) & (share[i] > common))
        value = divergence(share[i, telling], common[telling])
        best = np.argsort(-value, kind="stable")[:TOP]  # words are in order, so ties are too
        rows += [(lang, source, "term", terms[telling[k]], int(value[k])) for k in best]
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
    return pa.Table.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True) if rows else [()] * 5, kinds, strict=True)], ["lang", "source", "part", "item", "value"])


def blocks(counts: DataFrame, min_docs: int = MIN_DOCS, cells: int = CELLS) -> DataFrame:
    """Rows of blocks from written ``term_counts``: ``lang, block, size`` (kept words of the language), and either ``source, n`` of one
    of its sources or ``term, by`` of a word. Each language has a block at least; a block has about ``cells`` cells."""
    by_term = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("by"))
    kept = written(by_term.where(F.col("docs") >= min_docs).drop("docs"), "kept-terms")
    totals = kept.select("lang", F.explode("by").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("n"))
    groups = counts.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    groups = written(groups, "sources")
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(sizes, "lang", "left").withColumn("size", F.coalesce("size", F.lit(0).cast("long")))
    langs = written(langs.withColumn("blocks", F.greatest(F.ceil(F.col("size") * F.col("sources") / cells), F.lit(1)).cast("int")), "languages")
    words = join_counted(kept, langs, "lang", "size").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
    empty = F.lit(None)
    words = words.select("lang", "block", "size", empty.cast("string").alias("source"), empty.cast("long").alias("n"), "term", "by")
    heads = join_counted(groups, langs, "lang", "sources").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return words.unionByName(heads.select("lang", "block", "size", "source", "n", empty.cast("string").alias("term"), empty.cast(words.schema["by"].dataType).alias("by")))


def divergence_audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS, top: int = TOP, cells: int = CELLS) -> DataFrame:
    """``lang, source, part, item, value, rank``: the divergence of each source from the others of its language (``pair``, all ranks)
    and the words by which it differs most from the language (``term``, ranks to ``top``, which is at most ``TOP``)."""
    counts = written(term_counts(docs, lang, source, text), "term-counts")
    found = blocks(counts, min_docs, cells).groupBy("lang", "block").applyInArrow(_block, "lang string, source string, part string, item string, value long")
    found = written(found, "block-results")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    both = pairs.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x"), "part", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    both = both.select("lang", "x.source", "part", "x.item", "value").withColumn("rank", F.row_number().over(order))
    best = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return both.unionByName(best)

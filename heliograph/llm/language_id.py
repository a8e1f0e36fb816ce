"""Language identification by rank-order n-gram profiles (out-of-place distance).

Profiles hold the most frequent letter n-grams of each language, learned from all labelled training texts: tasks count, Spark
sums the counts, and the top of each language is kept. A document's own most frequent n-grams are compared with each profile
by how far their ranks are out of place.

Defined results: a null text or one without a letter is ``und`` with score 0, as is every text when nothing could be learned;
ties of distance go to the label that sorts first; equal counts rank by the n-gram; a row with a null ``doc_id`` isn't held
out and isn't learned from; repeated rows are predicted each; extra columns are ignored.
"""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heliograph.llm.shared import map_texts, written

#: N-grams of one to three letters in a profile, and in a document's.
PROFILE = 300
#: Profiles are sent to tasks, so many languages at a time.
LANGS = 2000
#: Distinct counts that a task holds before it passes them on, and code points read at a time.
FLUSH = 400_000
PIECE = 1_000_000
UNKNOWN = "und"

@cache
def letter_table() -> np.ndarray:
    """For each code point, whether it is a letter (category L)."""
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


class Grams:
    """The n-grams of a text's words, each word with a space on either side, as numbers.

    An n-gram is its code points in 21 bits each, from the top: numbers sort as the n-grams do.
    """

    def __init__(self) -> None:
        self.letters = letter_table()

    def pieces(self, text: str) -> Iterator[np.ndarray]:
        """All n-grams with repeats, for PIECE code points at a time."""
        c = np.frombuffer(f" {text.lower()}  ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        for i in range(1, len(c) - 1, PIECE):
            p = c[i - 1 : i + PIECE + 1].astype(np.int64)
            letter = self.letters[p]
            p[~letter] = 32
            top, mid = p << 42, p << 21
            two = top[:-2] | mid[1:-1]
            yield np.concatenate([top[1:-1][letter[1:-1]], two[letter[:-2] | letter[1:-1]], (two | p[2:])[letter[1:-1]]])


def tally(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs."""
    keys = np.sort(keys)
    ends = np.flatnonzero(np.concatenate([keys[1:] != keys[:-1], np.ones(min(1, len(keys)), bool)]))
    return keys[ends], np.diff(ends, prepend=-1)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    keys, counts = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def count_grams(text: str, grams: Grams) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text in order, and how often each occurs."""
    return merged([tally(k) for k in grams.pieces(text)])


def ranked(counted: tuple[np.ndarray, np.ndarray], size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, best first; ties by the n-gram."""
    keys, counts = counted
    return keys[np.argsort(-counts, kind="stable")[:size]]


class Postings:
    """Profiles turned round: for each n-gram, the languages that rank it."""

    def __init__(self, profiles: dict[str, dict[int, int]]) -> None:
        self.langs = sorted(profiles)
        rows = np.array(sorted((int(g), i, rank) for i, x in enumerate(self.langs) for g, rank in profiles[x].items()), dtype=np.int64).reshape(-1, 3)
        self.keys, self.lang, self.rank = rows[:, 0].copy(), rows[:, 1].copy(), rows[:, 2].copy()

    def nearest(self, top: np.ndarray) -> tuple[str, float]:
        """The language at the least out-of-place distance; an n-gram that a profile lacks counts PROFILE places."""
        if not len(top) or not self.langs:
            return UNKNOWN, 0.0
        low = np.searchsorted(self.keys, top)
        many = np.searchsorted(self.keys, top, side="right") - low
        place = np.repeat(np.arange(len(top)), many)
        at = np.repeat(low - np.cumsum(many) + many, many) + np.arange(len(place))
        gained = np.bincount(self.lang[at], PROFILE - np.abs(self.rank[at] - place), minlength=len(self.langs))
        best = int(gained.argmax())
        return self.langs[best], float(gained[best]) / (PROFILE * len(top))


def predict(text: str | None, profiles: dict[str, dict[int, int]] | Postings, grams: Grams) -> tuple[str, float]:
    """Label and score of one text; the score is 1 less the share of the largest distance possible."""
    known = profiles if isinstance(profiles, Postings) else Postings(profiles)
    return known.nearest(ranked(count_grams(text or "", grams)))


def learn_profiles(labelled: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, gram, rank`` of each language's most frequent n-grams, from all rows with a text and a language; written.

    Tasks count, and hold a bounded number of n-grams before they pass their counts on.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        waiting: dict[str, list[np.ndarray]] = defaultdict(list)
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def settle() -> None:
            for x, parts in waiting.items():
                new = tally(np.concatenate(parts))
                held[x] = merged([held[x], new]) if x in held else new
            waiting.clear()

        def passed() -> Iterator[pa.RecordBatch]:
            for x, (keys, counts) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(keys), pa.string()), pa.array(keys), pa.array(counts)], ["lang", "gram", "n"])
            held.clear()

        size = 0
        for batch in batches:
            for x, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for keys in grams.pieces(t):
                    waiting[x].append(keys)
                    size += len(keys)
                    if size > 4 * PIECE:
                        settle()
                        size = 0
            if sum(len(k) for k, _ in held.values()) > FLUSH:
                yield from passed()
        settle()
        yield from passed()

    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("lang is not null and text is not null")
    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PROFILE).select("lang", "gram", "rank")
    return written(top, "profiles")


def profile_blocks(profiles: DataFrame, size: int = LANGS) -> Iterator[dict[str, dict[int, int]]]:
    """Profiles of up to ``size`` languages at a time, in order of language: rank by n-gram."""
    last = ""
    while True:
        langs = [r["lang"] for r in profiles.where(F.col("lang") > last).select("lang").distinct().orderBy("lang").limit(size).collect()]
        if not langs:
            return
        block: dict[str, dict[int, int]] = defaultdict(dict)
        for r in profiles.where((F.col("lang") > last) & (F.col("lang") <= langs[-1])).collect():
            block[r["lang"]][r["gram"]] = r["rank"] - 1
        yield dict(block)
        last = langs[-1]


def predict_languages(docs: DataFrame, profiles: DataFrame, carry: tuple[str, ...] = ("doc_id",), text: str = "text", size: int = LANGS) -> DataFrame:
    """``carry``, ``lang_pred`` and ``score`` for each row; only the text is an input.

    Each block of profiles passes over the texts once and keeps the better label; the text travels along between blocks.
    """

    def made(block: dict[str, dict[int, int]]):
        def make():
            grams, known = Grams(), Postings(block)
            return lambda texts: [predict(t, known, grams) for t in texts]

        return make

    fields, schema = {"lang_new": pa.string(), "score_new": pa.float64()}, "lang_new string, score_new double"
    out = docs.select(*carry, F.col(text).alias("_t"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    for block in profile_blocks(profiles, size):
        out = map_texts(out.withColumn("_again", F.col("_t")), (*carry, "_t", "lang_pred", "score"), "_again", made(block), fields, schema)
        better = (F.col("lang_new") != UNKNOWN) & ((F.col("lang_pred") == UNKNOWN) | (F.col("score_new") > F.col("score")))
        label, score = F.when(better, F.col("lang_new")).otherwise(F.col("lang_pred")), F.when(better, F.col("score_new")).otherwise(F.col("score"))
        out = out.select(*carry, "_t", label.alias("lang_pred"), score.alias("score"))
    return out.drop("_t")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def identify_languages(docs: DataFrame) -> DataFrame:
    """Learn from the rows that aren't held out, predict all: ``doc_id, held_out, lang_pred, score``."""
    learn = docs.where((F.crc32(F.col("doc_id").cast("string")) % 5 != 0) & F.col("lang").isNotNull())
    return predict_languages(docs.withColumn("held_out", held_out()), learn_profiles(learn), ("doc_id", "held_out"))

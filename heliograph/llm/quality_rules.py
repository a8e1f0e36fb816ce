"""Document quality rules with host-level verdicts; DataFrame functions only.

Rules fail documents one by one; failures are then counted by host, each host's rate is shrunk towards the corpus by a beta
prior that is fitted to the rates of all hosts, and the host's verdict, taken from its posterior, goes back to its documents.

Defined results: a null text has no words and fails the base rule; null hosts are one host of their own; repeated rows are
counted and returned as often as they occur; extra columns of the input are ignored unless named in ``carry``; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.llm.shared import let, shifted, window_hashes, words, written

MIN_WORDS = 20
REPEAT_WINDOW = 8
REPEAT_PERCENT = 30
#: Soft rules, as percentages: symbols a word, lines that repeat an earlier one; and the mean length of a word.
SYMBOL_PERCENT = 10
DUP_LINE_PERCENT = 30
WORD_LENGTHS = (2, 12)
#: A host is rejected when its shrunk failure rate is above the prior's mean by more than so many deviations of its own posterior:
#: with a probability of 0.95 its true rate is above the mean.
HOST_DEVIATIONS = 1.645
#: Strength of the prior, in documents, when the hosts' rates vary no more than chance lets them (or there is one host only).
FLAT_STRENGTH = 1e6

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(tokens: Column, width: int = REPEAT_WINDOW) -> Column:
    """How many words lie in windows of ``width`` words that occur twice or more in the text, the first occurrence included.

    Texts without a repeated window, nearly all, stop after one pass over their window hashes; the others sort them.
    """

    def covered(keys: Column) -> Column:
        pairs = F.sort_array(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        hits = let(pairs, lambda p: F.filter(F.transform(p, lambda x, k: F.when((F.get(p, k - 1)["h"] == x["h"]) | (F.get(p, k + 1)["h"] == x["h"]), x["i"])), lambda x: x.isNotNull()))
        gaps = let(F.sort_array(hits), lambda p: F.zip_with(p, shifted(p, 1), lambda a, b: F.coalesce(F.least(b - a, F.lit(width)), F.lit(width))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, x: total + x)

    keys = window_hashes(F.transform(tokens, lambda w: F.xxhash64(w)), width)
    return let(keys, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0).cast("long")).otherwise(covered(k)))


def features(docs: DataFrame, carry: tuple[str, ...], text: str, host: str) -> DataFrame:
    """``carry`` as struct ``row``, ``host``, the base measures, and the rule results."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.select(F.struct(*[F.col(c) for c in carry]).alias("row"), F.col(host).cast("string").alias("host"), body.alias("body"), words(F.col(text)).alias("tokens"), lines.alias("lines"))
    df = df.select(
        "row",
        "host",
        F.size("tokens").cast("long").alias("n_words"),
        F.length(F.array_join("tokens", "")).cast("long").alias("word_chars"),
        F.regexp_count("body", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        repeated_words(F.col("tokens")).alias("n_repeat_words"),
    )
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    soft = (
        (100 * F.col("n_symbols") > SYMBOL_PERCENT * F.col("n_words"))
        | (100 * F.col("n_dup_lines") > DUP_LINE_PERCENT * F.col("n_lines"))
        | (F.col("word_chars") < WORD_LENGTHS[0] * F.col("n_words"))
        | (F.col("word_chars") > WORD_LENGTHS[1] * F.col("n_words"))
    )
    return df.select("row", "host", *FEATURES, base.alias("base_failed"), soft.alias("soft_failed"))


def host_verdicts(rated: DataFrame, deviations: float = HOST_DEVIATIONS) -> DataFrame:
    """``host, docs, failures, host_rate, host_rejected`` from rows with ``host, base_failed, soft_failed``.

    The prior is beta (method of moments): its mean is that of the hosts' raw rates, its variance theirs without what counting so
    many documents gives by chance; its parameters are one row. A host's rate has a beta posterior, whose mean is the rate shrunk
    by the prior's strength and whose deviation falls with the host's documents. A host is rejected where this mean is more than
    ``deviations`` of its own deviations above the prior's: of two hosts with one raw rate, a large one may be and a small one not.
    """
    hosts = rated.groupBy("host").agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("base_failed") | F.col("soft_failed")).alias("failures"))
    hosts = written(hosts, "hosts")
    raw = F.col("failures") / F.col("docs")
    prior = hosts.agg(F.avg(raw).alias("m"), F.var_pop(raw).alias("v"), F.avg(1 / F.col("docs")).alias("one"))
    single = F.col("m") * (1 - F.col("m"))
    own = F.col("v") - single * F.col("one")
    prior = prior.select("m", F.when(own > 1e-9, F.greatest(single / own - 1, F.lit(1e-3))).otherwise(FLAT_STRENGTH).alias("k"))
    rate = (F.col("failures") + F.col("m") * F.col("k")) / (F.col("docs") + F.col("k"))
    deviation = F.sqrt(F.col("host_rate") * (1 - F.col("host_rate")) / (F.col("docs") + F.col("k") + 1))
    # one row of prior beside each host
    out = hosts.crossJoin(F.broadcast(prior)).withColumn("host_rate", rate)
    return out.select("host", "docs", "failures", "host_rate", (F.col("host_rate") - F.col("m") > deviations * deviation + 1e-9).alias("host_rejected"))


def _with_verdicts(rated: DataFrame, hosts: DataFrame) -> DataFrame:
    hosts = hosts.where("host_rejected").select(F.col("host").alias("bad"), "host_rejected")
    out = rated.join(hosts, F.col("host").eqNullSafe(F.col("bad")), "left").withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
    kept = ~F.col("base_failed") & ~(F.col("host_rejected") & F.col("soft_failed"))
    return out.select("row", *FEATURES, "base_failed", "soft_failed", "host_rejected", kept.alias("kept"))


def quality_rules(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), text: str = "text", host: str = "source", deviations: float = HOST_DEVIATIONS) -> DataFrame:
    """A row for each document: the ``carry`` columns, the measures, ``base_failed``, ``soft_failed``, ``host_rejected``, ``kept``.

    A document is dropped if the base rule fails it, or if its host is rejected and a soft rule fails the document too: clean
    documents of a poor host stay. The measures are written once; the hosts' table joins them by size (AQE broadcasts it only
    when it is small, and splits a hot host otherwise).
    """
    rated = written(features(docs, carry, text, host), "rated")
    out = _with_verdicts(rated, host_verdicts(rated, deviations))
    return out.select(*[F.col("row")[c].alias(c) for c in carry], *[c for c in out.columns if c != "row"])


def kept_documents(docs: DataFrame, text: str = "text", host: str = "source", deviations: float = HOST_DEVIATIONS) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, all columns. The rules run twice, so that no text is written twice."""
    hosts = written(host_verdicts(features(docs, (host,), text, host), deviations), "verdicts")
    return _with_verdicts(features(docs, tuple(docs.columns), text, host), hosts).where("kept").select("row.*")

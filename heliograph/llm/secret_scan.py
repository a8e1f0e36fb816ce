"""Secrets in documents, judged by how widely their values are copied; DataFrame functions only.

Candidates are found with regular expressions, their values hashed, and the hashes counted over the corpus by distinct
repositories and owners. A value is owner-specific, and looks live, while one owner holds more than half of the repositories that
have it; spread over owners it is a copied example. Base kinds are reported always; a value in them that is a copied example is
marked by a span ``example`` at its own place, once for all kinds that hold it, so what isn't marked looks live. The wider kinds
add a span only for values that look live, where no base span stands.

Defined results: a null text is empty; null repositories or owners count as none; repeated rows are reported each, and add
nothing to the distinct counts; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heliograph.llm.shared import written

#: Base kinds in listing order, pattern, the group that holds the value, and its least length.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Kinds that the method adds.
WIDER = (
    ("github", r"gh[pousr]_[A-Za-z0-9]{30,}", 0, 34),
    ("google", r"AIza[A-Za-z0-9_-]{30,}", 0, 34),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}", 0, 24),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
    ("key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 20),
    ("bearer", r"(?i:bearer)\x20+([A-Za-z0-9+/_.=-]{20,})", 1, 20),
    ("quoted", r"""[:=]\x20*["']([A-Za-z0-9+/_.=-]{16,})["']""", 1, 16),
)
KINDS = (*BASE, *WIDER)
#: Characters of a match behind its value, by kind; none for others.
TAILS = {"quoted": 1}
#: A candidate is an example unless one owner holds more than so many percent of its repositories.
OWN_PERCENT = 50
#: One look that every text with a candidate passes.
GATE = r"""(?i:passw|secret|token|api_?key|bearer)|AKIA|[0-9a-f]{24}|gh[pousr]_|AIza|xox[abprs]-|[rs]k_(?:live|test)_|eyJ|PRIVATE KEY|[:=]\x20*["'][A-Za-z0-9+/_.=-]{16}"""

HIT = "struct<ord:int,i:int,gap:int,size:int,value:int,hash:string,long:boolean>"


def matches(text: Column, order: int, pattern: str, group: int, least: int) -> Column:
    """All leftmost non-overlapping matches in order: the code points before each since the last one, its own, those of its
    value, the value's hash, and whether it has ``least`` characters."""
    rx = F.lit(pattern)
    every = F.regexp_extract_all(text, rx, 0)
    value = every if group == 0 else F.regexp_extract_all(text, rx, group)
    zipped = F.filter(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), every.alias("all"), value.alias("value")), lambda x: x["all"].isNotNull())
    hit = lambda x, i: F.struct(F.lit(order).alias("ord"), i.alias("i"), F.length(x["gap"]).alias("gap"), F.length(x["all"]).alias("size"), F.length(x["value"]).alias("value"), F.sha2(x["value"], 256).alias("hash"), (F.length(x["value"]) >= least).alias("long"))
    return F.when(text.rlike(pattern), F.transform(zipped, hit)).otherwise(F.array().cast(f"array<{HIT}>"))


def candidates(docs: DataFrame, carry: tuple[str, ...], text: str, repo: str, owner: str) -> DataFrame:
    """``row_id``, ``carry`` as struct ``row``, ``repo``, ``owner`` and the matches of all kinds, for every document; written."""
    body = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(F.struct(*[F.col(c) for c in carry]).alias("row"), F.col(repo).cast("string").alias("repo"), F.col(owner).cast("string").alias("owner"), body.alias("body"))
    found = F.concat(*[matches(F.col("body"), i, *kind[1:]) for i, kind in enumerate(KINDS)])
    hits = F.when(F.col("body").rlike(GATE), found).otherwise(F.array().cast(f"array<{HIT}>"))
    return written(df.select("row", "repo", "owner", hits.alias("hits")).withColumn("row_id", F.monotonically_increasing_id()), "candidates")


def said(spans: Column) -> Column:
    """``kind:start:end`` of spans ``(start, ord, stop)``, by start, then kind as listed."""
    kind = F.array(*[F.lit(k[0]) for k in KINDS], F.lit("example"))
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(kind, s["ord"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def copied_values(each: DataFrame, percent: int = OWN_PERCENT) -> DataFrame:
    """``hash`` of the values of ``each`` (``hash, repo, owner``) that no owner holds in more than ``percent`` of their repositories.

    Repositories and owners are made distinct before they meet, so a value that a third of all rows hold isn't in one task.
    """
    held = each.where("repo is not null and owner is not null").select("hash", "owner", "repo").distinct()
    owners = held.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    return owners.groupBy("hash").agg(F.sum("n").alias("n"), F.max("n").alias("most")).where(100 * F.col("most") <= percent * F.col("n")).select("hash")


def scan_secrets(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), text: str = "text", repo: str = "doc_id", owner: str = "source", percent: int = OWN_PERCENT) -> DataFrame:
    """A row for each document: ``carry``, counts by base kind, ``base_sha256``, ``spans``, and ``n_live`` and ``n_example`` candidates.

    Positions are running sums over a document's matches of a kind. Only hashes that are copied form the verdict table; everything
    else looks live. The verdict table is narrow and joined by its size.
    """
    found = candidates(docs, carry, text, repo, owner)
    each = found.where(F.size("hits") > 0).select("row_id", "repo", "owner", F.inline("hits"))
    upto = Window.partitionBy("row_id", "ord").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum((F.col("gap") + F.col("size")).cast("long")).over(upto)
    each = each.withColumn("stop", stop).withColumn("start", F.col("stop") - F.col("size")).where("long")
    tail = F.get(F.array(*[F.lit(TAILS.get(k[0], 0)) for k in KINDS]), F.col("ord"))
    each = each.withColumn("to", F.col("stop") - tail).withColumn("from", F.col("to") - F.col("value"))
    each = written(each.select("row_id", "repo", "owner", "ord", "start", "stop", "from", "to", "hash"), "spans")
    copied = written(copied_values(each, percent).withColumn("example", F.lit(True)), "copied")
    base = F.col("ord") < len(BASE)
    ahead, behind = (Window.partitionBy("row_id").orderBy(o).rangeBetween(Window.unboundedPreceding, 0) for o in (F.col("start"), F.desc("start")))
    over = (F.max(F.when(base, F.col("stop"))).over(ahead) > F.col("start")) | (F.min(F.when(base, F.col("start"))).over(behind) < F.col("stop"))
    judged = each.withColumn("told", F.coalesce(over, F.lit(False))).join(copied, "hash", "left").withColumn("live", F.col("example").isNull())
    whole = F.struct("start", "ord", "stop")
    value = F.struct(F.col("from").alias("start"), F.lit(len(KINDS)).alias("ord"), F.col("to").alias("stop"))
    judged = judged.groupBy("row_id").agg(
        *[F.count_if(F.col("ord") == i).alias(f"n_{kind[0]}") for i, kind in enumerate(BASE)],
        F.collect_list(F.when(base, whole)).alias("base"),
        F.collect_list(F.when(~base & F.col("live") & ~F.col("told"), whole)).alias("wider"),
        F.collect_set(F.when(base & ~F.col("live"), value)).alias("examples"),
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live")).alias("n_example"),
    )
    out = found.join(judged, "row_id", "left")
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    return out.select(
        *[F.col("row")[c].alias(c) for c in carry],
        *[zero(f"n_{kind[0]}") for kind in BASE],
        F.sha2(F.coalesce(said(F.col("base")), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(said(F.concat("base", "wider", "examples")), F.lit("")).alias("spans"),
        zero("n_live"),
        zero("n_example"),
    )

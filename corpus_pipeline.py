"""A corpus pipeline of five stages over ``documents``.

Each stage takes what its predecessor kept, as written Parquet, and returns the columns of documents (the last: the mix).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm.decontaminate import contaminated
from heliograph.llm.near_dups import near_duplicate_ids
from heliograph.llm.pii import redact
from heliograph.llm.quality_rules import kept_documents
from heliograph.llm.shared import shared_root, table
from heliograph.llm.source_mix import mix_sources


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and their hosts' verdicts keep: a null text goes (it has no words), null sources are one host, rows
    that are repeated stay or go together."""
    return kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near-duplicates; rows without an id stay. Null and empty texts are copies
    of one another; rows of one id are one document and stay together."""
    return docs.join(near_duplicate_ids(docs), "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window that is like a benchmark item, at whatever place and to whichever item; null texts and rows without
    an id stay."""
    leaks = contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind, of overlapping spans by the first's; ``n_chars`` follows the text, and both are
    null for a null text."""
    return redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: ``doc_id, source, size, source_size, target, taken`` of documents with a word taken. A null source is a source
    (the last), a text without words takes nothing, and equal quotients go to the source that comes first."""
    return mix_sources(docs).where("taken > 0")


STAGES = [("quality rules", quality), ("near-duplicates", near_dedup), ("decontamination", decontaminate), ("personal data", pii), ("source mix", mix)]

#: The field of the personal-data stage has no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{shared_root(spark)}/stage-{i}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs

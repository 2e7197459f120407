"""A corpus pipeline: quality rules, near-deduplication, decontamination, redaction, packing.

Every stage takes (spark, docs, sf_dir) and returns a frame that is written and
reread as the next one's input.  A stage begins by deleting the scratch tables of
the stage before, so the result of a stage must be written before the next is called.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm import decontaminate, neardup, packing, pii, quality
from loomstone.llm.queries import tokenizer_path
from loomstone.runtime import drop_paths, drop_table, persist_table, recorded, table

#: A verdict of the labelled holdouts, and the power-of-two packing, are not for SQL.
ORACLE_SQL: str | None = None


#: Scratch tables of the stage that was called last.
_scratch: list[str] = []


def _stage(work):
    """A stage that cleans up behind the one before it; tables that its input still reads are left."""

    @functools.wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_paths(spark, _scratch, unless=[docs])
        _scratch.clear()
        with recorded() as made:
            out = work(spark, docs, sf_dir)
        _scratch.extend(made)
        return out

    return run


@_stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; null and empty texts do not, repeated rows are judged each."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


@_stage
def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that with the smallest doc_id, null last; of equal ones the first written.

    Rows are numbered and compared by number, so rows that share a doc_id or
    have none are judged each: differing texts stay, equal and near ones leave
    one.  Null, empty and blank texts are near nothing.
    """
    number = "loomstone_row"
    while number in docs.columns:
        number += "_"
    rows = persist_table(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    with recorded() as made:
        groups = neardup.near_duplicates(rows.select(F.col(number).alias("doc_id"), "text")).select("doc_id", "component_id")
        named = groups.join(rows.select(F.col(number).alias("row"), F.col("doc_id").alias("id")), F.col("doc_id") == F.col("row"))
        first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
        kept = persist_table(named.groupBy("component_id").agg(first.alias("first")).select(F.col("first.row").alias(number)), "kept")
    drop_paths(spark, made, unless=[kept])
    # The kept rows grow with the corpus, so they are never broadcast, at any size.
    return rows.join(kept.hint("merge"), number, "left_semi").select(*docs.columns)


@_stage
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage; null and empty texts hold none."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


@_stage
def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text; null texts stay null."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    found = pii.find_pii(docs, carry=others)
    text = pii.redacted(F.col("text"), [(k, F.col(k)) for k in pii.KINDS])
    out = found.select("doc_id", text.alias("text"), *(F.col(f"carried.{c}").alias(c) for c in others))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("bigint"))
    return out.select(*docs.columns)


@_stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The power-of-two pieces of all documents, repeated rows each; null texts hold the end id alone."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality", quality_stage),
    ("near-dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            out = persist_table(out, f"stage-{name}")
            if k:
                drop_table(docs)
        docs = out
    return docs

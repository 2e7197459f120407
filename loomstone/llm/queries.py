"""The training-data queries, with production parameters, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomstone.llm import (
    decontaminate,
    langid,
    licenses,
    neardup,
    packing,
    pii,
    quality,
    secret_scan,
    tokenbin,
    toxicity,
)
from loomstone.runtime import table


def tokenizer_path() -> str:
    """Where the public vocabulary file lies on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items of which a document holds a passage."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] ELSE list_distinct(list_transform(
    range(1, greatest(len(words) - 4, 1) + 1), lambda i: array_to_string(words[i:i + 4], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(list_transform(sh, lambda x: md5_number(x))) AS x FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
h AS (SELECT u, v FROM p JOIN n na ON na.doc_id = u JOIN n nb ON nb.doc_id = v
  WHERE 100 * c >= 75 * (na.n_shingles + nb.n_shingles - c)),
l AS (SELECT u, v FROM h UNION ALL SELECT v, u FROM h),
r AS (SELECT doc_id AS u, doc_id AS v FROM n UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u),
c AS (SELECT u AS doc_id, min(v) AS component_id FROM r GROUP BY u)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)
"""


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids written bit-packed in doc_id order and read back."""
    return tokenbin.token_round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return secret_scan.secret_digest(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdicts of all documents, cutoffs from the labels."""
    return quality.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("reasons")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut into power-of-two pieces."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License statements in all documents."""
    return licenses.license_digest(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return pii.pii_digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_language": op3_language,
    "op4_toxicity": op4_toxicity,
    "op5_token_files": op5_token_files,
    "op6_secrets": op6_secrets,
    "op7_quality": op7_quality,
    "op8_packing": op8_packing,
    "op9_licenses": op9_licenses,
    "op10_pii": op10_pii,
}
ORACLES: dict[str, str] = {"op2_near_duplicates": OP2_SQL}

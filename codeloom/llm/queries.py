"""Queries of the text problems (3, 6, 7, 8, 9) over their whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import handwritten, leakage, lookalike, malformed, tokenizer
from codeloom.util import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return malformed.broken_files(table(spark, sf_dir, "files")).select("file_id")


def p3_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return malformed.broken_files(table(spark, sf_dir, "files"))


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return malformed.broken_rates(table(spark, sf_dir, "files"), table(spark, sf_dir, "scan_results"))


def p3_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The broken files of one language, which SQL can judge as well."""
    return malformed.broken_files(table(spark, sf_dir, "files")).where("language = 'json'").select("file_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handwritten.not_handwritten(table(spark, sf_dir, "files")).select("file_id")


def p6_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files per repository, kind and source of the line that decided."""
    return handwritten.not_handwritten(table(spark, sf_dir, "files")).groupBy("project_id", "reason", "source").agg(F.count(F.lit(1)).alias("n_files"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.encoded(table(spark, sf_dir, "documents"))


def p7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.token_counts(table(spark, sf_dir, "documents"))


def p7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, and those whose text the ids give back."""
    docs = table(spark, sf_dir, "documents")
    back = tokenizer.decoded(tokenizer.encoded(docs)).select("doc_id", F.sha2("text", 256).alias("back"))
    same = F.count_if(F.col("back") == F.sha2(F.coalesce("text", F.lit("")), 256))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(back, "doc_id").agg(F.count(F.lit(1)).alias("n_docs"), same.alias("n_same"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_leaks(spark, sf_dir).where("leak = 'passage'").select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each item leaked: the documents it stands in and the largest part of it that one of them holds."""
    share = F.round(F.max(F.col("covered") / F.col("item_words")), 6)
    return p8_leaks(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("longest").alias("longest"), share.alias("largest_share"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.lookalike_pairs(table(spark, sf_dir, "documents"))


def p9_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.consistent_form(table(spark, sf_dir, "documents")).select("doc_id", "form")


def p9_forms_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a text, and whether each look has one form and each form one look."""
    f = lookalike.forms_and_looks(table(spark, sf_dir, "documents")).where("look is not null").groupBy("look", "form").agg(F.count(F.lit(1)).alias("n"))
    n = F.count(F.lit(1))
    return f.agg(F.sum("n").alias("n_docs"), (n == F.countDistinct("look")).alias("one_form"), (n == F.countDistinct("form")).alias("one_look"))


QUERIES = {f.__name__: f for f in (p3_found, p3_errors, p3_rates, p3_json, p6_found, p6_reasons, p7_ids, p7_token_counts, p7_round_trip, p8_found, p8_leaks, p8_items, p9_found, p9_forms, p9_forms_hold)}

#: What SQL can say of these problems; the rest is tested against brute force, exact round trips and small fixtures.
ORACLE: dict[str, str] = {
    "p3_json": r"SELECT DISTINCT file_id FROM files WHERE regexp_matches(lower(path), '\.json$') AND length(content) > 0 AND NOT json_valid(content)",
    "p7_round_trip": "SELECT count(*) AS n_docs, count(*) AS n_same FROM documents",
    "p9_forms_hold": "SELECT count(*) AS n_docs, TRUE AS one_form, TRUE AS one_look FROM documents WHERE text IS NOT NULL",
}

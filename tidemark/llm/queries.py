"""The queries of the text problems, over whole tables and whole texts. None of them can be put in SQL:
they are tested against brute force, round trips and certificates instead."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import encoding, leakage, packing
from tidemark.session import table


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    """Every text, or piece of one above the capacity, with its container."""
    return packing.pack(packing.token_sizes(table(spark, d, "documents")))


def p8_certificate(spark: SparkSession, d: str) -> DataFrame:
    """Number of containers against the lower bound of any packing."""
    return packing.certificate(p8_pack(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """The leaked items with their task and the number of documents that hold them."""
    items = table(spark, d, "eval_items").select("item_id", "task")
    return (
        p9_found(spark, d)
        .groupBy("item_id")
        .agg(F.count(F.lit(1)).alias("documents"))
        .join(items, "item_id")
        .select("item_id", "task", "documents")
    )


def p9_answers(spark: SparkSession, d: str) -> DataFrame:
    """The leaked items that have an answer, with the documents that hold the item and of these the ones that hold the answer too."""
    found = leakage.leaked_answers(table(spark, d, "documents"), table(spark, d, "eval_items")).distinct()
    return (
        found.filter("answer IS NOT NULL")
        .groupBy("item_id")
        .agg(F.count(F.lit(1)).alias("documents"), F.count_if("answer").alias("with_answer"))
    )


def p10_repaired(spark: SparkSession, d: str) -> DataFrame:
    """The affected documents with the restored text and the ciphers used."""
    return encoding.wrongly_decoded(table(spark, d, "documents")).select("doc_id", "repaired", F.array_join("swaps", ", ").alias("swaps"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.wrongly_decoded(table(spark, d, "documents")).select("doc_id")


QUERIES = {
    "p8_pack": p8_pack,
    "p8_certificate": p8_certificate,
    "p9_found": p9_found,
    "p9_report": p9_report,
    "p9_answers": p9_answers,
    "p10_found": p10_found,
    "p10_repaired": p10_repaired,
}
ORACLES: dict[str, str] = {}

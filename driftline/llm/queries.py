"""Queries of the text problems 7 to 9, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftline.llm import mixing, spam, tokens
from driftline.session import cut


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode_documents(_documents(spark, sf))


def _mix(spark: SparkSession, sf: str) -> tuple[DataFrame, list[mixing.Share]]:
    docs = _documents(spark, sf).withColumn("source", mixing.source_key("source"))
    sizes = cut(tokens.count_tokens(docs, ["doc_id", "source"]))  # texts are encoded once
    shares = mixing.plan(sizes, spark.read.parquet(f"{sf}/mix_targets.parquet"))
    return mixing.repeats(sizes, shares), shares


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf)[0]


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    used, shares = _mix(spark, sf)
    return mixing.report(used, shares)


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return spam.spam_pages(_documents(spark, sf)).select("doc_id").distinct()


QUERIES = {"p7_ids": p7_ids, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found}
#: None of these can be stated in SQL: they rest on a tokenizer or on text shapes (see tests/llm).
ORACLE: dict[str, str] = {}

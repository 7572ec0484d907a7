"""The registered queries of the training-data operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborspark.llm import bpe, langid, licenses, merkle, mih, mil, minhash, packing, rules, sstable


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(licenses.document_paths(_table(spark, sf_dir, "documents")))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return langid.identify(documents, langid.fit(documents))


def op4_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return mil.classify(documents, mil.fit(documents, _table(spark, sf_dir, "labels")))


def op5_mih(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries are the rows whose id is divisible by 20; all rows are indexed."""
    return mih.neighbours(_table(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 20 == 0)


def op6_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.build_shards(_table(spark, sf_dir, "documents"))


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality(_table(spark, sf_dir, "documents"))


def op8_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return merkle.audit(pages, merkle.damaged(pages))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_licenses, op2_minhash, op3_langid, op4_mil, op5_mih, op6_sstable, op7_rules, op8_merkle, op9_packing, op10_bpe)}


def oracle_sql() -> dict[str, str]:
    return {"op1_licenses": licenses.sql(), "op2_minhash": minhash.SQL, "op7_rules": rules.SQL, "op8_merkle": merkle.SQL, "op9_packing": packing.sql()}

"""The operators' queries over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import langid, mixing, ngram_jaccard, ogg, packing, pii, sharding, simhash, toxicity, url_filter
from quarry.llm._spark import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs, table(spark, sf_dir, "labels")))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.decide(pages, url_filter.paginated(pages))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"), pii.train())


def op6_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.probe(ogg.from_documents(table(spark, sf_dir, "documents")))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.rate(docs, mixing.train(docs, table(spark, sf_dir, "labels")))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.join(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op2_language, op3_sharding, op4_url_filter, op5_pii, op6_ogg, op7_packing, op8_mixing, op9_ngram_jaccard, op10_simhash)}
ORACLES: dict[str, str] = {"op4_url_filter": url_filter.ORACLE, "op10_simhash": simhash.ORACLE}

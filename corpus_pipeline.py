"""A corpus pipeline: toxicity, near duplicates, PII, mixture, packing; each stage is written and read again as the next one's documents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import mixing, ngram_jaccard, packing, pii, toxicity
from quarry.llm._spark import shared_folder, small_batches, table

# Each stage gives the columns of documents, packing apart. In all of them null, empty and very long texts, null and repeated ids, repeated rows and
# extra columns are rows like any other, and an empty table gives an empty table; what a case results in, a stage's module says.


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the toxicity model doesn't reject; null, empty and wordless texts stay, and so do all where no label of both classes is known."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates, by the least id (null ids last, one of tied rows); texts without words are in no class and stay."""
    small_batches(spark)
    return ngram_jaccard.keep_one(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and secrets replaced by their labels; of a changed text ``n_chars`` is the new length."""
    small_batches(spark)
    return pii.redact(docs, pii.train())


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate tells (repeated rows alike): some not at all, some several times; without labels of two domains each once."""
    return mixing.mix(docs, mixing.train(docs, table(spark, sf_dir, "labels")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a piece of a document, with its sequence and where it starts there; null and empty texts are one token, longer ones than a sequence several pieces."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("pii", redact_pii),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Three stages are trained models and one is a heuristic packing, which SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``; what lies between them is Parquet in the shared folder of ``spark.checkpoint.dir``."""
    where = f"{shared_folder(spark)}/quarry-{spark.sparkContext.applicationId}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = f"{where}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs

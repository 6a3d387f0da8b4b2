"""A corpus pipeline of five operators: toxic documents go, one of each group of near copies stays, personal data is
masked, sources are mixed to target weights, and the texts are encoded.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; between stages the rows go through Parquet.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import mixing, pii, sentencepiece, similar, toxicity
from millrace.llm.queries import model_path
from millrace.session import checkpoint_folder, dropped, importable, table

LEAST_SIMILAR = 0.8
SHINGLE = 5


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not find toxic. It learns from the labelled rows of the documents table."""
    importable(spark)
    model = toxicity.train(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return docs.filter(toxicity.scores(docs["text"], model) < 0.5)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 of its five-word shingles, that of the smallest id."""
    importable(spark)
    return similar.one_of_each(docs, size=SHINGLE, least=LEAST_SIMILAR)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of every span of personal data."""
    importable(spark)
    return pii.redacted(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at weights 5, 2, 1, in code point order, repeating; at most three times a source."""
    return mixing.mixed_documents(docs, weights=(5.0, 2.0, 1.0))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids beside each document, with the proof that decoding gives the text again."""
    importable(spark)
    return sentencepiece.tokenised(docs, sentencepiece.model_bytes(model_path()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("SimHash near-dedup", without_near_copies),
    ("PII", without_personal_data),
    ("mixing", mixed),
    ("SentencePiece", encoded),
]

#: No SQL: the classifier, the sketches and the tokenizer are beyond it; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. What a stage wrote goes once the next one is written; the last one's rows stay."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if i:
            dropped(spark, f"{folder}/{i - 1}")
    return docs

"""A training-data pipeline over ``documents``: quality classifier, line dedup,
SimHash near-dedup, secret scan, packing. Each stage reads what the one before it
has written and keeps the columns of ``documents``; the last returns the pieces
of packed sequences. The learned stages can't be expressed in SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewise.llm import kernelscore, linededup, packing, secrets, simhash
from tablewise.llm.common import materialise, table
from tablewise.llm.queries import WORD_FILE

ORACLE_SQL = None


def _as_documents(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, ``n_chars`` (where it is one) counted anew."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below one half go. It learns from all
    labelled documents. Only statistics meet the labels, so no text is shuffled."""
    labels = table(spark, sf_dir, "labels")
    model = kernelscore.fit(materialise(kernelscore.describe(docs), "quality-stats"), labels)
    return _as_documents(kernelscore.score_texts(docs, model).filter(F.col("score") >= 0.5), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five documents hold stay in the last one only. Documents that
    are left empty stay; the next stage folds them into one."""
    return _as_documents(linededup.dedup_lines(docs), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, that with the smallest id."""
    return _as_documents(simhash.dedup(docs, size=3, max_bits=3), docs)


def scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; documents stay."""
    path = "source" if "source" in docs.columns else None
    return _as_documents(secrets.redact(docs, secrets.model_of(docs), path_col=path), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens, with their ids."""
    return packing.pack(docs, public_tokenizers.path(WORD_FILE))


STAGES = [("quality classifier", quality), ("line dedup", lines), ("simhash near-dedup", near_copies), ("secret scan", scan), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

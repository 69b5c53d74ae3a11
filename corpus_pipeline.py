"""A training corpus from raw documents: quality rules, toxicity, near duplicates, repeated passages, packing.

Each stage works on what the one before it kept and is a table of its own, so a lost executor costs
at most a stage's tasks. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import nearjoin, packing, quality, substrings, toxicity
from quire.llm.common import prepare, written
from quire.llm.queries import table, vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie in their language's perplexity band. Nulls, repeated rows
    and empty tables as in ``quality.assess``."""
    prepare(spark)
    return quality.keep(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among ``docs``, scores below 0.7. Without
    labels of both classes none goes."""
    prepare(spark)
    labels = table(spark, sf_dir, "labels")
    return toxicity.keep(docs, labels)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id."""
    prepare(spark)
    return nearjoin.deduplicated(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 20-word windows that start earlier in the corpus go. A text that loses words becomes the kept
    words joined by one space, and n_chars follows; other texts stay as they are. No row goes."""
    prepare(spark)
    found = substrings.strip(docs, prefix="__")
    changed = F.col("__n_removed") > 0
    text = F.when(changed, F.col("__kept")).otherwise(F.col("text"))
    size = F.when(changed, F.char_length("__kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    new = {"text": text.alias("text"), "n_chars": size.alias("n_chars")}
    return found.select(*(new.get(c, F.col(c)) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, without padding, as in ``op6_packing``."""
    prepare(spark)
    return packing.digests(packing.pack(docs, vocabulary("byte_bpe_50k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("packing", pack),
]

#: SQL has neither the language model nor the classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

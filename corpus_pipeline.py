"""A training-data pipeline over ``documents``: rules, quality, near-duplicates, mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes every result as Parquet to the shared
folder and reads it again as the next stage's input.  Classifiers learn from the labelled rows of ``sf_dir``'s own tables, so
that a stage's training doesn't depend on what an earlier stage has dropped.

Null and empty texts fail the base rules and go first.  Rows with a null id stay rows of their own in every stage; rows that repeat an
id and a text are judged alike, and one of them is left after the near-duplicate stage.  Very long texts are judged whole and packed in pieces.  Ties
are settled as the operators say.  Columns beside id, text and source pass through the first four stages, whatever their names.
An empty table gives an empty result.  The mix weighs documents by operator 10's own native weight, as stages hand on the columns of documents only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagforge.llm import mixing, neardup, packing, quality, rules
from tagforge.llm.common import drop_path, load, scratch, shared_dir, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that fail the base rules or the calibrated classifier go."""
    return rules.accepted(docs, rules.train(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that score below 0.3 go."""
    return quality.accepted(docs, quality.train(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: one document of each group of near-duplicates stays (five-word shingles, similarity 0.8)."""
    return neardup.survivors(docs, width=5, percent=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents as often as the mix takes them."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: the pieces of every document and the sequences that hold them."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("quality_classifier", quality_classifier), ("near_dedup", near_dedup), ("source_mix", source_mix), ("best_fit_packing", pack_sequences)]

#: The first two stages are learned models, which SQL can't express; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; a stage's own tables and its input's table are deleted once its result is written."""
    folder, last = shared_dir(spark), None
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), f"{folder}/{name}")
        if last:
            drop_path(spark, last)
        last = f"{folder}/{name}"
    return docs

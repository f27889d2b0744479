"""From raw documents to balanced shards, in five stages.

Each stage works on all that the one before it kept, which is written as Parquet to the
shared folder and read again, so that a lost executor repeats tasks of one stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairloom.llm import decontaminate, mixing, neardup, quality, resharding
from pairloom.llm.plumbing import discard, materialize
from pairloom.session import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier, fitted on the labels, rejects; rows go by their
    text alone, with or without an id, and without labels none is rejected."""
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the least doc_id, of each group of near-duplicates; of rows
    of one id and text one stays, null and blank texts all do."""
    return neardup.drop_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a passage of the benchmark; null and empty texts stay, and
    an empty benchmark drops nothing."""
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents so that the sources meet their target weights; a null source is one, and
    rows without an id are drawn by source and text."""
    return mixing.mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Gives each document its new shard, moving the fewest bytes; a null source is a shard, null
    texts have no bytes. An empty table gives no rows, here as in every stage."""
    return resharding.reshard(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("sharding", sharding),
]

#: Fitting by gradient steps, connected components of fingerprints, alignment and flows
#: have no DuckDB form; tests/llm/test_independent.py holds the whole
#: pipeline against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of ``sf_dir`` after all stages."""
    docs = _table(spark, sf_dir, "documents")
    kept = None
    for k, (name, stage) in enumerate(STAGES):
        if k:
            docs = materialize(docs, name)
            if kept is not None:
                discard(kept)
            kept = docs
        docs = stage(spark, docs, sf_dir)
    return docs

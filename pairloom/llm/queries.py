"""Queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, fixity, mixing, neardup, quality, resharding, rules, suffixtree, templates, urls


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of ``pages`` against a replica with simulated decay; see ``fixity.audit`` for nulls, repeats and empty tables."""
    pages = _t(spark, sf_dir, "pages")
    return fixity.audit(pages, fixity.decayed(pages))


def op2_cube_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced draw of ``documents``; see ``mixing.sample`` for nulls, ties, repeats and empty tables."""
    return mixing.sample(_t(spark, sf_dir, "documents"))


def op3_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions for every page with a url; see ``urls.decisions`` for nulls, repeats and empty tables."""
    return urls.decisions(_t(spark, sf_dir, "pages"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leak of a benchmark item; see ``decontaminate.contaminated`` for nulls, short items, repeats and empty tables."""
    return decontaminate.contaminated(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))


def op5_template_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; see ``templates.drop_recurring`` for nulls, repeats and empty tables."""
    return templates.drop_recurring(_t(spark, sf_dir, "documents"))


def op6_simhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates with the document of their group that stays; see ``neardup.groups`` for nulls, ties, repeats and empty tables."""
    return neardup.groups(_t(spark, sf_dir, "documents"))


def op7_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New shard of every document, of equal capacities; see ``resharding.reshard`` for nulls, long texts, repeats and empty tables."""
    return resharding.reshard(_t(spark, sf_dir, "documents"))


def op8_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document under the tree of all; see ``suffixtree.score`` for nulls, repeats and empty tables."""
    return suffixtree.score(_t(spark, sf_dir, "documents"))


def op9_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failure bits and measurements of every document; see ``rules.ledger`` for nulls, repeats and empty tables."""
    return rules.ledger(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"))


def rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy rejects; see ``rules.ablation``."""
    return rules.ablation(rules.ledger(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels")))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; see ``quality.score`` for nulls, repeats, missing labels and empty tables."""
    return quality.score(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_merkle_fixity, op2_cube_sampling, op3_redirect_equivalence, op4_decontamination, op5_template_lines,
        op6_simhash_near_dups, op7_flow_resharding, op8_suffix_tree_scores, op9_rule_ledger, op10_quality_classifier, rule_ablation,
    )
}
ORACLES: dict[str, str] = {
    "op1_merkle_fixity": fixity.oracle(),
    "op3_redirect_equivalence": urls.oracle(),
    "op9_rule_ledger": rules.ledger_oracle(),
    "rule_ablation": rules.ablation_oracle(),
}

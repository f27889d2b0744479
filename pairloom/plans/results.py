"""The one layout of all results, their summary and their flat form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SCHEMA = """type string, linked_id string, file1_path string, file2_path string, similarity_score double, identical boolean,
file1_line_count long, file2_line_count long, common_lines long, only_in_file1 long, only_in_file2 long,
different_positions string, detailed_diff string, diff_truncated boolean,
file1_row_count long, file2_row_count long, common_records long,
field_mismatches array<struct<column_name string, mismatch_count long, sample_mismatches array<struct<key string, value1 string, value2 string>>>>,
total_field_mismatches long, columns_only_in_file1 array<string>, columns_only_in_file2 array<string>, common_columns array<string>,
file1_size long, file2_size long, error string""".replace("\n", " ").replace("struct<column_name string, mismatch_count long, sample_mismatches array<struct<key string, value1 string, value2 string>>>", "struct<column_name: string, mismatch_count: bigint, sample_mismatches: array<struct<key: string, value1: string, value2: string>>>")
FLAT = ("linked_id", "file1_path", "file2_path", "type", "similarity_score", "identical", "file1_count", "file2_count", "common", "only_in_file1", "only_in_file2", "total_mismatches")


def fields(spark: SparkSession):
    return spark.createDataFrame([], SCHEMA).schema


def conform(df: DataFrame) -> DataFrame:
    """``df`` with exactly the columns of ``SCHEMA``; those it lacks are null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields(df.sparkSession)])


def status() -> Column:
    return F.when(F.col("type") == "Error", "error").when(F.col("identical"), "identical").otherwise("modified")


def summarize(results: DataFrame, total1: int = 0, total2: int = 0) -> DataFrame:
    """One row: pairs by status, and average, least and greatest similarity of those without
    an error (identical ones included), 0 where there is none."""
    fine = F.col("type") != "Error"
    score = F.when(fine, F.col("similarity_score"))
    return results.agg(
        F.count("*").alias("pairs_compared"), F.count_if(fine & F.col("identical")).alias("identical_pairs"),
        F.count_if(fine & ~F.col("identical")).alias("different_pairs"), F.count_if(~fine).alias("error_pairs"),
        F.coalesce(F.avg(score), F.lit(0.0)).alias("average_similarity"), F.coalesce(F.min(score), F.lit(0.0)).alias("min_similarity"),
        F.coalesce(F.max(score), F.lit(0.0)).alias("max_similarity"),
    ).select(F.lit(total1).cast("long").alias("total_files_set1"), F.lit(total2).cast("long").alias("total_files_set2"), "*")


def by_status(results: DataFrame) -> DataFrame:
    """(status, pairs, percent) with rounded shares."""
    g = results.groupBy(status().alias("status")).agg(F.count("*").alias("pairs"))
    total = results.agg(F.count("*").alias("n"))
    return g.crossJoin(total).select("status", "pairs", F.round(100 * F.col("pairs") / F.col("n")).cast("long").alias("percent"))  # one row


def most_different(results: DataFrame, n: int | None = None) -> DataFrame:
    """Modified pairs, the least similar first."""
    out = results.where(status() == "modified").orderBy("similarity_score", "file1_path", "file2_path")
    return out if n is None else out.limit(n)


def flat(results: DataFrame, *more: str) -> DataFrame:
    """Twelve columns of text, one row per pair; with ``"*"`` also similarity and the whole row."""
    t = F.col("type")

    def text(c) -> Column:
        return F.coalesce(c.cast("string"), F.lit(""))

    def by(txt: Column, structured: Column, hashed: Column) -> Column:
        return F.when(t == "Text", text(txt)).when(t == "Structured", text(structured)).when(t == "HashOnly", text(hashed)).otherwise("")

    c, same = F.col, F.col("identical")
    extra = [c("similarity_score").alias("similarity"), F.struct(*results.columns).alias("whole")] if more else []
    kind = F.when(t == "HashOnly", "binary").otherwise(F.lower(t))
    return results.select(
        F.when(t == "Error", "").otherwise(text(c("linked_id"))).alias("linked_id"), "file1_path", "file2_path", kind.alias("type"),
        F.format_string("%.4f", F.coalesce("similarity_score", F.lit(0.0))).alias("similarity_score"),
        text(F.coalesce(same, F.lit(False))).alias("identical"),
        by(c("file1_line_count"), c("file1_row_count"), c("file1_size")).alias("file1_count"),
        by(c("file2_line_count"), c("file2_row_count"), c("file2_size")).alias("file2_count"),
        by(c("common_lines"), c("common_records"), same.cast("int")).alias("common"),
        by(c("only_in_file1"), c("only_in_file1"), F.lit(0)).alias("only_in_file1"),
        by(c("only_in_file2"), c("only_in_file2"), F.lit(0)).alias("only_in_file2"),
        F.when(t == "Error", text(c("error"))).otherwise(by(c("only_in_file1") + c("only_in_file2"), c("total_field_mismatches"), (~same).cast("int"))).alias("total_mismatches"),
        *extra,
    )

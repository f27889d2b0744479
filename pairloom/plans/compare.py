"""The comparison of two roots: index, fingerprint, pair, compare, summarise.

Files, pairs and results are DataFrames throughout. Pairs fall into branches by type and
mode; each branch is one plan over all of its pairs, however their schemas differ.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window

from ..config import ALGORITHMS, Config, line_filter
from ..functions.fingerprint import linked_id
from ..functions.normalize import text_lines
from ..functions.sequence import comparer
from ..functions.values import values_equal
from ..operators import measures, pairing
from ..operators.structured import SAMPLES
from ..session import ship
from ..sources import files as src
from ..sources.detect import is_structured
from ..tables import discard, materialize
from .results import conform, summarize

BAGS = (*measures.TOKENS, "ngram")
_SIDE = ("path", "size", "file_type", "content_hash", "line_count", "columns", "error")


@dataclass
class Comparison:
    """results in the common layout; summary of one row; what the run took."""

    results: DataFrame
    summary: DataFrame
    files1: DataFrame
    files2: DataFrame
    stats: dict


def mode_of(cfg: Config) -> Column:
    """``Structured`` or ``Text`` for a pair."""
    if cfg.mode != "auto":
        return F.lit(cfg.mode.capitalize())
    return F.when(is_structured(F.col("file_type1")) & is_structured(F.col("file_type2")), "Structured").otherwise("Text")


def _detailed(pairs: DataFrame, files1: DataFrame, files2: DataFrame) -> DataFrame:
    def side(df: DataFrame, n: int) -> DataFrame:
        return df.select(*[F.col(c).alias(f"{c}{n}") for c in _SIDE])

    return pairs.join(side(files1, 1), "path1").join(side(files2, 2), "path2").withColumn("linked_id", linked_id(F.col("content_hash1"), F.col("content_hash2")))


def identical_results(pairs: DataFrame) -> DataFrame:
    """Exact copies need no look at their content. Rows of a delimited table don't count its header."""
    c = F.col
    binary = (c("file_type1") == "Binary") | (c("file_type2") == "Binary")
    kind = F.when(binary, "HashOnly").when(is_structured(c("file_type1")) & is_structured(c("file_type2")), "Structured").otherwise("Text")

    def rows(n: int) -> Column:
        return F.when(c(f"file_type{n}") == "Excel", c(f"line_count{n}")).otherwise(F.greatest(c(f"line_count{n}") - 1, F.lit(0)))

    def only(k: str, x) -> Column:
        return F.when(c("type") == k, x)

    none = F.array().cast("array<string>")
    return conform(pairs.withColumn("type", kind).select(
        "type", "linked_id", c("path1").alias("file1_path"), c("path2").alias("file2_path"), F.lit(1.0).alias("similarity_score"), F.lit(True).alias("identical"),
        only("Text", c("line_count1")).alias("file1_line_count"), only("Text", c("line_count2")).alias("file2_line_count"), only("Text", c("line_count1")).alias("common_lines"),
        F.when(c("type") != "HashOnly", 0).alias("only_in_file1"), F.when(c("type") != "HashOnly", 0).alias("only_in_file2"),
        only("Text", F.lit("")).alias("different_positions"), only("Text", F.lit("")).alias("detailed_diff"), only("Text", F.lit(False)).alias("diff_truncated"),
        only("Structured", rows(1)).alias("file1_row_count"), only("Structured", rows(2)).alias("file2_row_count"), only("Structured", rows(1)).alias("common_records"),
        only("Structured", F.expr("cast(array() as array<struct<column_name: string, mismatch_count: bigint, sample_mismatches: array<struct<key: string, value1: string, value2: string>>>>)")).alias("field_mismatches"),
        only("Structured", F.lit(0)).alias("total_field_mismatches"), only("Structured", none).alias("columns_only_in_file1"), only("Structured", none).alias("columns_only_in_file2"),
        only("Structured", F.coalesce("columns1", none)).alias("common_columns"), only("HashOnly", c("size1")).alias("file1_size"), only("HashOnly", c("size2")).alias("file2_size"),
    ))


def text_results(pairs: DataFrame, cfg: Config, content1: DataFrame | None = None, content2: DataFrame | None = None) -> DataFrame:
    """Pairs of text with counts, positions, diff and score. Binary files that aren't copies
    differ as a whole; invalid UTF-8 is an error of the pair. Each pair's files are read by
    its own task, so no content is shuffled; ``content1`` and ``content2``, as (path,
    content), replace this for files that tasks can't open."""
    ship(pairs.sparkSession)
    c = F.col
    pattern = line_filter(cfg.ignore_regex)
    binary = (c("file_type1") == "Binary") | (c("file_type2") == "Binary")
    # the cost of a pair is the product of its lengths: pairs are spread one by one
    j = pairs.where(~binary).repartition(c("path1"), c("path2"))
    if content1 is None or content2 is None:
        j = src.with_contents(j)
    else:
        for n, raw in ((1, content1), (2, content2)):
            j = j.join(raw.select(c("path").alias(f"path{n}"), c("content").alias(f"content{n}")), f"path{n}")
        j = j.withColumn("read_error", F.lit(None).cast("string"))
    hashed = pairs.where(binary).select(
        F.lit("HashOnly").alias("type"), "linked_id", c("path1").alias("file1_path"), c("path2").alias("file2_path"), F.lit(0.0).alias("similarity_score"),
        F.lit(False).alias("identical"), c("size1").alias("file1_size"), c("size2").alias("file2_size"),
    )
    valid = F.is_valid_utf8(c("content1").cast("string")) & F.is_valid_utf8(c("content2").cast("string"))
    readable = F.coalesce(valid, F.lit(False))
    bad = j.where(~readable).select(
        F.lit("Error").alias("type"), c("path1").alias("linked_id"), c("path1").alias("file1_path"), c("path2").alias("file2_path"),
        F.lit(0.0).alias("similarity_score"), F.lit(False).alias("identical"), F.coalesce("read_error", F.lit("the text isn't valid UTF-8")).alias("error"),
    )
    texts = j.where(readable).select(
        "linked_id", "path1", "path2", *[text_lines(c(f"content{n}").cast("string"), cfg.normalization, pattern).alias(f"lines{n}") for n in (1, 2)]
    )
    texts = texts.withColumns({f"text{n}": F.array_join(f"lines{n}", "\n") for n in (1, 2)})
    done = texts.withColumn("d", comparer(cfg.algorithm, cfg.max_diff_bytes)("lines1", "lines2", "path1", "path2"))
    if cfg.algorithm == "levenshtein":
        done = done.withColumn("score", measures.text_levenshtein(c("text1"), c("text2")))
    elif cfg.algorithm == "hamming":
        done = done.withColumn("score", measures.hamming(c("lines1"), c("lines2")))
    elif cfg.algorithm in BAGS:
        done = done.join(measures.bag_similarity(texts, ["path1", "path2"], "text1", "text2", cfg.algorithm), ["path1", "path2"])
    else:
        done = done.withColumn("score", c("d.score"))
    same = (c("d.only1") == 0) & (c("d.only2") == 0)
    compared = done.select(
        F.lit("Text").alias("type"), "linked_id", c("path1").alias("file1_path"), c("path2").alias("file2_path"), c("score").alias("similarity_score"), same.alias("identical"),
        F.size("lines1").alias("file1_line_count"), F.size("lines2").alias("file2_line_count"), c("d.common").alias("common_lines"),
        c("d.only1").alias("only_in_file1"), c("d.only2").alias("only_in_file2"), c("d.positions").alias("different_positions"),
        c("d.diff").alias("detailed_diff"), c("d.truncated").alias("diff_truncated"),
    )
    return conform(compared).unionByName(conform(hashed)).unionByName(conform(bad))


def _last(columns: Column, name: Column) -> Column:
    """0-based place of the last header of a name, -1 without one."""
    at = F.array_position(F.reverse(columns), name)
    return F.when(at > 0, F.size(columns) - at).otherwise(-1)


def _first(columns: Column, name: Column) -> Column:
    return F.array_position(columns, name) - 1


def structured_results(pairs: DataFrame, cfg: Config) -> DataFrame:
    """All pairs of tables in one plan: every record carries the number of its pair, so the
    record diff is one join on (pair, key, ordinal) whatever the schemas."""
    ship(pairs.sparkSession)
    c = F.col
    files = [pairs.select(c(f"path{n}").alias("path"), c(f"file_type{n}").alias("file_type")) for n in (1, 2)]
    records = materialize(src.table_records(files[0].unionAll(files[1]).distinct()), "records")
    heads = records.where("ord = 0 and error is null").select("path", c("cells").alias("head"))
    failed = records.where("error is not null").select("path", "error")
    ignored = F.array(*map(F.lit, cfg.ignore_columns)).cast("array<string>")
    key_names = F.array(*map(F.lit, cfg.key_columns)).cast("array<string>")
    j = pairs.select("linked_id", "path1", "path2")
    for n in (1, 2):
        j = j.join(heads.select(c("path").alias(f"path{n}"), c("head").alias(f"head{n}")), f"path{n}", "left")
        j = j.join(failed.select(c("path").alias(f"path{n}"), c("error").alias(f"error{n}")), f"path{n}", "left")
    none = F.array().cast("array<string>")
    j = j.withColumn("error", F.coalesce("error1", "error2")).withColumns({f"head{n}": F.coalesce(f"head{n}", none) for n in (1, 2)})
    seen = {n: F.array_except(F.array_distinct(f"head{n}"), ignored) for n in (1, 2)}
    j = j.withColumns({
        "common": F.array_sort(F.array_intersect(seen[1], seen[2])), "alone1": F.array_sort(F.array_except(seen[1], seen[2])), "alone2": F.array_sort(F.array_except(seen[2], seen[1])),
    }).withColumn("compared", F.array_except("common", key_names))
    j = materialize(j, "tables")
    bad = j.where("error is not null").select(
        F.lit("Error").alias("type"), c("path1").alias("linked_id"), c("path1").alias("file1_path"), c("path2").alias("file2_path"),
        F.lit(0.0).alias("similarity_score"), F.lit(False).alias("identical"), "error",
    )
    good = j.where("error is null")

    def side(n: int) -> DataFrame:
        head = c(f"head{n}")
        spots = F.filter(F.transform(key_names, lambda k: _first(head, k)), lambda i: i >= 0) if cfg.key_columns else F.array(F.lit(0).cast("long"))
        at = good.select("path1", "path2", c(f"path{n}").alias("path"), spots.alias("spots"), F.transform("compared", lambda x: _last(head, x)).alias("places"))
        r = records.where("ord > 0").select("path", "ord", "cells").join(at, "path")
        cell = lambda i: F.coalesce(F.get("cells", i.cast("int")), F.lit(""))
        parts = F.transform("spots", cell)
        key = F.array_join(parts, "|")
        rows = r.select("path1", "path2", (F.array(key) if cfg.compat_key else parts).alias("k"), key.alias("key"), "ord", F.transform("places", cell).alias("v"))
        nth = F.row_number().over(Window.partitionBy("path1", "path2", "k").orderBy("ord"))
        return rows.select("path1", "path2", "k", nth.alias("nth"), c("key").alias(f"key{n}"), c("v").alias(f"v{n}"))

    both = side(1).join(side(2), ["path1", "path2", "k", "nth"], "full").select(
        "path1", "path2", "nth", F.coalesce("key1", "key2").alias("key"), c("key1").isNotNull().alias("l"), c("key2").isNotNull().alias("r"), "v1", "v2",
        F.zip_with("v1", "v2", lambda x, y: ~values_equal(x, y, cfg.numeric_tolerance)).alias("wrong"),
    )
    l, r = c("l"), c("r")
    counts = both.groupBy("path1", "path2").agg(F.count_if(l).alias("n1"), F.count_if(r).alias("n2"), F.count_if(l & r).alias("both"))
    cells = both.where(F.exists("wrong", lambda x: x)).select("path1", "path2", "key", "nth", F.posexplode(F.arrays_zip("wrong", "v1", "v2")).alias("at", "x")).where("x.wrong")
    column = ["path1", "path2", "at"]
    ranked = cells.withColumn("i", F.row_number().over(Window.partitionBy(*column).orderBy("key", "nth")))
    first = ranked.where(c("i") <= SAMPLES).groupBy(*column).agg(
        F.array_sort(F.collect_list(F.struct("i", "key", c("x.v1").alias("value1"), c("x.v2").alias("value2")))).alias("s")
    )
    per = cells.groupBy(*column).agg(F.count("*").alias("n")).join(first, column).groupBy("path1", "path2").agg(
        F.array_sort(F.collect_list(F.struct("at", "n", F.transform("s", lambda e: F.struct(e["key"].alias("key"), e["value1"].alias("value1"), e["value2"].alias("value2"))).alias("s")))).alias("per")
    )
    out = good.join(counts, ["path1", "path2"], "left").join(per, ["path1", "path2"], "left").withColumns({
        "n1": F.coalesce("n1", F.lit(0)), "n2": F.coalesce("n2", F.lit(0)), "both": F.coalesce("both", F.lit(0)),
        "fields": F.coalesce(F.transform("per", lambda e: F.struct(F.get("compared", e["at"]).alias("column_name"), e["n"].alias("mismatch_count"), e["s"].alias("sample_mismatches"))), F.expr("cast(array() as array<struct<column_name: string, mismatch_count: bigint, sample_mismatches: array<struct<key: string, value1: string, value2: string>>>>)")),
    }).withColumn("wrong", F.aggregate("fields", F.lit(0).cast("long"), lambda s, e: s + e["mismatch_count"]))
    every = c("n1") + c("n2") - c("both")
    done = out.select(
        F.lit("Structured").alias("type"), "linked_id", c("path1").alias("file1_path"), c("path2").alias("file2_path"),
        F.when(every > 0, c("both") / every).otherwise(1.0).alias("similarity_score"),
        ((c("n1") == c("both")) & (c("n2") == c("both")) & (c("wrong") == 0)).alias("identical"),
        c("n1").alias("file1_row_count"), c("n2").alias("file2_row_count"), c("both").alias("common_records"), (c("n1") - c("both")).alias("only_in_file1"), (c("n2") - c("both")).alias("only_in_file2"),
        c("fields").alias("field_mismatches"), c("wrong").alias("total_field_mismatches"), c("alone1").alias("columns_only_in_file1"), c("alone2").alias("columns_only_in_file2"), c("common").alias("common_columns"),
    )
    return conform(done).unionByName(conform(bad))


def compare(spark: SparkSession, path1: str, path2: str, cfg: Config = Config(), progress: Callable[[str], None] | None = None) -> Comparison:
    """Compares two files or folders. ``progress`` is told of each stage as it is planned."""
    assert cfg.algorithm in ALGORITHMS
    ship(spark)
    tell = progress or (lambda _: None)
    began = time.time()
    tell("index")
    raw1, raw2 = src.read_files(spark, path1, cfg.exclude), src.read_files(spark, path2, cfg.exclude)
    tell("fingerprint")
    files1, files2 = (materialize(src.fingerprinted(r, cfg), "files") for r in (raw1, raw2))
    tell("pair")
    found = pairing.candidates(files1, files2, cfg)
    pairs = materialize(_detailed(found, files1, files2).withColumn("mode", mode_of(cfg)), "pairs")
    tell("compare")
    out = identical_results(pairs.where("exact_hash_match"))
    rest = pairs.where("not exact_hash_match")
    tables = "file_type1 in ('Csv', 'Tsv', 'Excel') and file_type2 in ('Csv', 'Tsv', 'Excel')"
    c = F.col
    out = out.unionByName(conform(rest.where(f"mode = 'Structured' and not ({tables})").select(
        F.lit("Error").alias("type"), c("path1").alias("linked_id"), c("path1").alias("file1_path"), c("path2").alias("file2_path"),
        F.lit(0.0).alias("similarity_score"), F.lit(False).alias("identical"), F.lit("not a table").alias("error"),
    )))
    out = out.unionByName(structured_results(rest.where(f"mode = 'Structured' and {tables}"), cfg))
    far = [r.select("path", "content") for r in (raw1, raw2)] if any("://" in p and not p.startswith("file://") for p in (path1, path2)) else [None, None]
    out = materialize(out.unionByName(text_results(rest.where("mode = 'Text'"), cfg, *far)), "results")
    discard(pairs)
    tell("summarise")
    sizes = [f.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first() for f in (files1, files2)]
    summary = summarize(out, sizes[0].n, sizes[1].n)
    row = summary.first()
    took = time.time() - began
    total = sizes[0].b + sizes[1].b
    stats = row.asDict() | {
        "execution_time_ms": int(took * 1000), "processing_speed_mb_per_sec": total / took / 2**20 if took else 0.0, "peak_memory_usage_bytes": resident(),
        "total_data_processed_bytes": total, "comparison_mode": cfg.mode, "similarity_algorithm": cfg.algorithm,
    }
    tell("done")
    return Comparison(out, summary, files1, files2, stats)


def resident() -> int | None:
    """Bytes of memory of this process, where the system tells."""
    try:
        with open("/proc/self/status") as f:
            return next((int(x.split()[1]) * 1024 for x in f if x.startswith("VmRSS")), None)
    except OSError:
        return None

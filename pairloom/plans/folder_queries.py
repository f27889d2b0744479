"""Registered queries that drive whole comparisons: folders are written from the supplied
tables, indexed, paired and compared, and results exported and read again.

Left folders hold a file for every document, by language; right ones a second version: of
ids that 7 divides none, of others that 5 divides one line more. Tables are orders by customer
group, as CSV. Files are written by tasks, to a folder that all executors share.
"""

from __future__ import annotations

import csv
import io
import os
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

from ..config import Config, Normalization, line_filter
from ..functions.normalize import decode, split_lines, text_lines
from ..functions.sequence import encode_ranges
from ..operators import pairing
from ..sources import files as src
from ..sources.detect import detect
from ..tables import materialize, shared_dir
from . import report, results, sinks
from .compare import Comparison, compare
from .queries import _FILES_SQL, _SIDES_SQL, _ALL_SQL, _EST_SQL, _lines_sql, _sides, _t, query


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).removeprefix('file://').removeprefix('file:')}/{name}-{uuid.uuid4().hex}"


def _put(rows: DataFrame) -> None:
    """Writes (path, content) rows as files."""

    def write(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, n, mark = set(), 0, f".{uuid.uuid4().hex}.part"
        for b in part:
            for path, content in zip(*(c.to_pylist() for c in b.columns)):
                folder = os.path.dirname(path)
                if folder not in made:
                    os.makedirs(folder, exist_ok=True)
                    made.add(folder)
                with open(path + mark, "wb", buffering=0) as f:
                    f.write(content)
                os.replace(path + mark, path)  # a task that runs twice writes the same
                n += 1
        yield pa.record_batch([pa.array([n])], ["n"])

    rows.select("path", "content").mapInArrow(write, "n long").collect()


def _documents(spark: SparkSession, d: str, second: bool = True) -> tuple[str, str]:
    """The two folders of documents; without ``second``, the right one isn't needed and stays empty."""
    left, right = _folder(spark, "left"), _folder(spark, "right")
    t = _t(spark, d, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    name = F.concat_ws("/", "lang", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")))
    rows = t.select(F.concat(F.lit(left + "/"), name).alias("path"), F.encode("text", "UTF-8").alias("content"))
    if second:
        more = F.when(F.col("doc_id") % 5 == 0, F.concat(F.when(F.col("text").endswith("\n") | (F.col("text") == ""), "").otherwise("\n"), F.lit("one line more\n"))).otherwise("")
        two = t.where("doc_id % 7 <> 0").select(F.concat(F.lit(right + "/"), name).alias("path"), F.encode(F.concat("text", more), "UTF-8").alias("content"))
        rows = rows.unionAll(two)
    _put(rows)
    os.makedirs(right, exist_ok=True)
    return left, right


def _run(spark: SparkSession, d: str) -> tuple[Comparison, str, str]:
    left, right = _documents(spark, d)
    return compare(spark, left, right, Config(pairing="same-path", mode="text")), left, right


def _short(c: str, *roots: str):
    """A path below its root."""
    out = F.col(c)
    for r in roots:
        out = F.replace(out, F.lit(r + "/"), F.lit(""))
    return out


_VERSIONS = f"""{_FILES_SQL}, v0 AS (SELECT doc_id, concat(lang, '/doc_', doc_id, '.txt') AS path, text AS t1, text || CASE WHEN doc_id % 5 = 0 THEN CASE WHEN text = '' OR ends_with(text, chr(10)) THEN '' ELSE chr(10) END || 'one line more' || chr(10) ELSE '' END AS t2
 FROM (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents) WHERE doc_id % 7 <> 0),
v AS (SELECT v0.*, f.file_type, f.columns, sha256(t1) AS h1, sha256(t2) AS h2, len({_lines_sql('t1')}) AS n1, len({_lines_sql('t2')}) AS n2, f.line_count, doc_id % 5 <> 0 AS same FROM v0 JOIN f USING (doc_id)),
r AS (SELECT CASE WHEN same AND file_type <> 'Text' THEN 'Structured' ELSE 'Text' END AS type, substr(h1, 1, 16) || ':' || substr(h2, 1, 16) AS linked_id, path, CASE WHEN n1 + n2 = 0 OR same THEN 1.0 ELSE n1 / n2 END AS score, same AS identical,
 CASE WHEN same THEN line_count ELSE n1 END AS l1, CASE WHEN same THEN line_count ELSE n2 END AS l2, CASE WHEN same THEN line_count ELSE n1 END AS common, 0 AS only1, CASE WHEN same THEN 0 ELSE 1 END AS only2, greatest(line_count - 1, 0) AS rows_, n1, n2, t1 FROM v)"""
_RUN_SQL = f"""WITH {_VERSIONS} SELECT type, linked_id, path AS file1_path, path AS file2_path, round(CAST(score AS DOUBLE), 6) AS similarity_score, identical,
CASE WHEN type = 'Text' THEN CAST(l1 AS BIGINT) END AS file1_line_count, CASE WHEN type = 'Text' THEN CAST(l2 AS BIGINT) END AS file2_line_count, CASE WHEN type = 'Text' THEN CAST(common AS BIGINT) END AS common_lines,
CAST(only1 AS BIGINT) AS only_in_file1, CAST(only2 AS BIGINT) AS only_in_file2, CASE WHEN type = 'Text' THEN CASE WHEN same_ THEN '' ELSE CAST(n1 AS VARCHAR) END END AS different_positions,
CASE WHEN type <> 'Text' THEN CAST(rows_ AS BIGINT) END AS file1_row_count FROM (SELECT r.*, identical AS same_ FROM r)"""


def _columns(res: DataFrame, left: str, right: str) -> DataFrame:
    return res.select(
        "type", "linked_id", _short("file1_path", left).alias("file1_path"), _short("file2_path", right).alias("file2_path"), F.round("similarity_score", 6).alias("similarity_score"), "identical",
        "file1_line_count", "file2_line_count", "common_lines", "only_in_file1", "only_in_file2", "different_positions", "file1_row_count",
    )


@query("compare_folders", _RUN_SQL)
def compare_folders(spark, d):
    """Index, fingerprint, pair by path, compare."""
    done, left, right = _run(spark, d)
    return _columns(done.results, left, right)


@query("jsonl_round_trip", _RUN_SQL)
def jsonl_round_trip(spark, d):
    done, left, right = _run(spark, d)
    to = _folder(spark, "jsonl")
    sinks.write_jsonl(done.results, to)
    return _columns(sinks.load_jsonl(spark, to), left, right)


@query("csv_export", f"""WITH {_VERSIONS} SELECT linked_id, path AS file1_path, path AS file2_path, lower(type) AS type, printf('%.4f', CAST(score AS DOUBLE)) AS similarity_score, CAST(identical AS VARCHAR) AS identical,
CAST(CASE type WHEN 'Text' THEN l1 ELSE rows_ END AS VARCHAR) AS file1_count, CAST(CASE type WHEN 'Text' THEN l2 ELSE rows_ END AS VARCHAR) AS file2_count, CAST(CASE type WHEN 'Text' THEN common ELSE rows_ END AS VARCHAR) AS common,
CAST(only1 AS VARCHAR) AS only_in_file1, CAST(only2 AS VARCHAR) AS only_in_file2, CAST(only1 + only2 AS VARCHAR) AS total_mismatches FROM r""")
def csv_export(spark, d):
    done, left, right = _run(spark, d)
    to = _folder(spark, "csv")
    sinks.write_csv(done.results, to)
    back = spark.read.option("header", "true").option("escape", '"').schema(", ".join(f"{c} string" for c in results.FLAT)).csv(to)
    return back.withColumn("file1_path", _short("file1_path", left)).withColumn("file2_path", _short("file2_path", right))


@query("patch_files", f"""WITH {_VERSIONS}, x AS (SELECT linked_id, path, n1, {_lines_sql('t1')} AS l, least(3, n1) AS k FROM r WHERE NOT identical),
b AS (SELECT linked_id, '--- left/' || path || chr(10) || '+++ right/' || path || chr(10) || '@@ -' || CASE WHEN k = 0 THEN '0,0' WHEN k = 1 THEN CAST(n1 AS VARCHAR) ELSE (n1 - k + 1) || ',' || k END
 || ' +' || CASE WHEN k = 0 THEN '1' ELSE (n1 - k + 1) || ',' || (k + 1) END || ' @@' || chr(10) || array_to_string(list_transform(l[len(l) - k + 1:], lambda y: ' ' || y || chr(10)), '') || '+one line more' || chr(10) AS body FROM x)
SELECT replace(linked_id, ':', '_') AS linked_id, count(*) AS files, md5(string_agg(md5(body), '' ORDER BY md5(body))) AS digest FROM b GROUP BY 1""")
def patch_files(spark, d):
    """The patches of changed documents, read from the folder; those of one id are told apart by number."""
    done, left, right = _run(spark, d)
    to = _folder(spark, "artifacts")
    sinks.write_patches(done.results, to)
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.diff").load(f"{to}/patches")
    body = F.replace(F.replace(F.col("content").cast("string"), F.lit(left + "/"), F.lit("left/")), F.lit(right + "/"), F.lit("right/"))
    got = raw.select(F.regexp_extract("path", r"([0-9a-f]{16}_[0-9a-f]{16})[^/]*$", 1).alias("linked_id"), F.md5(body).alias("h"))
    return got.groupBy("linked_id").agg(F.count("*").alias("files"), F.md5(F.array_join(F.array_sort(F.collect_list("h")), "")).alias("digest"))


@query("run_stats", f"""WITH {_VERSIONS} SELECT (SELECT count(*) FROM documents) AS total_files_set1, (SELECT count(*) FROM v) AS total_files_set2, (SELECT count(*) FROM r) AS pairs_compared, (SELECT count(*) FILTER (identical) FROM r) AS identical_pairs,
(SELECT count(*) FILTER (NOT identical) FROM r) AS different_pairs, CAST(0 AS BIGINT) AS error_pairs, (SELECT round(CAST(avg(score) AS DOUBLE), 6) FROM r) AS average_similarity,
CAST((SELECT sum(strlen(coalesce(text, ''))) FROM documents) + (SELECT sum(strlen(t2)) FROM v) AS BIGINT) AS total_data_processed_bytes, 'text' AS comparison_mode, 'diff' AS similarity_algorithm, true AS timed""")
def run_stats(spark, d):
    """What a run says of itself, the times only as to whether they are there."""
    s = _run(spark, d)[0].stats
    row = tuple(s[k] for k in ("total_files_set1", "total_files_set2", "pairs_compared", "identical_pairs", "different_pairs", "error_pairs")) + (
        round(s["average_similarity"], 6), s["total_data_processed_bytes"], s["comparison_mode"], s["similarity_algorithm"],
        s["execution_time_ms"] > 0 and s["processing_speed_mb_per_sec"] > 0 and s["peak_memory_usage_bytes"] > 0,
    )
    return spark.createDataFrame([row], "total_files_set1 long, total_files_set2 long, pairs_compared long, identical_pairs long, different_pairs long, error_pairs long, average_similarity double, total_data_processed_bytes long, comparison_mode string, similarity_algorithm string, timed boolean")


@query("report_rows", f"""WITH {_VERSIONS} SELECT path, rpad('', CAST(round_even(10 * CAST(score AS DOUBLE), 0) AS INTEGER), '█') || rpad('', CAST(10 - round_even(10 * CAST(score AS DOUBLE), 0) AS INTEGER), '░') AS bar, CASE WHEN score >= 0.9 THEN 'good' WHEN score >= 0.5 THEN 'fair' ELSE 'poor' END AS grade,
CASE WHEN length(path) <= 12 THEN path ELSE '...' || right(path, 9) END AS short FROM r""")
def report_rows(spark, d):
    """How each pair is shown in a report."""
    done, left, right = _run(spark, d)
    bar, grade, cut = F.udf(report.bar, StringType()), F.udf(report.grade, StringType()), F.udf(lambda p: report.cut_path(p, 12), StringType())
    return done.results.select(_short("file1_path", left).alias("path"), bar("similarity_score").alias("bar"), grade("similarity_score").alias("grade"), cut(_short("file1_path", left)).alias("short"))


@query("index_folder", f"""WITH {_FILES_SQL} SELECT concat(lang, '/doc_', doc_id, '.txt') AS rel_path, concat('doc_', doc_id, '.txt') AS name, 'txt' AS extension, f.size, f.file_type, f.content_hash, f.line_count, f.size <= 2000 AS fingerprinted
FROM f JOIN documents d USING (doc_id) WHERE d.lang <> 'fr' AND CAST(doc_id AS VARCHAR) NOT LIKE '%3'""")
def index_folder(spark, d):
    """A folder without one subtree and some names; large files get no similarity fingerprint."""
    left, _ = _documents(spark, d, second=False)
    raw = src.read_files(spark, left, ("fr", "*3.txt", "[bad"))
    f = src.fingerprinted(raw, Config(max_fingerprint_size=2000))
    return f.select("rel_path", "name", "extension", "size", "file_type", "content_hash", "line_count", F.col("simhash").isNotNull().alias("fingerprinted"))


@query("index_single_file", "SELECT 'doc_0.txt' AS rel_path, strlen(coalesce(text, '')) AS size, sha256(coalesce(text, '')) AS content_hash FROM documents WHERE doc_id = 0")
def index_single_file(spark, d):
    """One file as a root: exclusions don't apply to it."""
    left, _ = _documents(spark, d, second=False)
    lang = _t(spark, d, "documents").where("doc_id = 0").first().lang
    return src.read_files(spark, f"{left}/{lang}/doc_0.txt", ("*.txt",)).select("rel_path", "size", "content_hash")


# ---- tables


GROUPS = 12
_HEAD = ["id", "status", "price", "date, of order", "priority"]
_HEAD2 = ["id", "status", "price", "date, of order", "clerk"]


def _tables(spark: SparkSession, d: str) -> tuple[str, str]:
    """The two folders of tables: orders by customer group, with quoted fields, short rows and
    repeated keys; the second version has other prices, statuses and rows."""
    left, right = _folder(spark, "left"), _folder(spark, "right")
    o = _t(spark, d, "orders").select(
        (F.col("o_custkey") % GROUPS).alias("g"), F.floor(F.col("o_orderkey") / 2).cast("long").alias("id"), F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"),
        F.col("o_totalprice").cast("decimal(20,2)").cast("string").alias("p"), F.date_format("o_orderdate", "MMM, yyyy").alias("t"), F.col("o_orderpriority").alias("x"),
    )

    def write(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The files of the groups of a partition, a batch of their rows at a time."""
        done, group, out = [], None, []

        def close() -> None:
            for f, path in out:
                f.close()
                os.replace(f.name, path)  # a task that runs twice writes the same
            out.clear()

        try:
            for b in part:
                for g, k, id_, s, p, t, x in zip(*(c.to_pylist() for c in b.columns)):
                    if not out or g != group:
                        close()
                        group = g
                        done.append(g)
                        for root in (left, right):
                            path = f"{root}/part {g}.csv"
                            os.makedirs(root, exist_ok=True)
                            out.append((open(f"{path}.{uuid.uuid4().hex}.part", "w", encoding="utf-8", newline=""), path))
                        one, two = (csv.writer(f, lineterminator="\n").writerow for f, _ in out)
                        one(_HEAD)
                        two(_HEAD2)
                    one([id_, s, p, t, x][: 4 if k % 10 == 0 else 5])
                    if k % 17:
                        two([id_, "X" if k % 19 == 0 else s, str(float(p) + 5) if k % 13 == 0 else p, t, "c"])
            close()
        finally:
            for f, _ in out:  # after a failure
                f.close()
                os.unlink(f.name)
        yield pa.record_batch([pa.array(done, pa.int64())], ["g"])

    parts = o.select("g", "k", "id", "s", "p", "t", "x").repartition(GROUPS, "g").sortWithinPartitions("g", "k")
    parts.mapInArrow(write, "g long").collect()
    return left, right


_O = f"""o AS (SELECT o_custkey % {GROUPS} AS g, o_orderkey // 2 AS id, o_orderkey AS k, o_orderstatus AS s, CAST(CAST(o_totalprice AS DECIMAL(20, 2)) AS VARCHAR) AS p FROM orders),
a AS (SELECT *, row_number() OVER (PARTITION BY g, id ORDER BY k) AS n FROM o), b AS (SELECT g, id, k, CASE WHEN k % 19 = 0 THEN 'X' ELSE s END AS s, CAST(p AS DOUBLE) + CASE WHEN k % 13 = 0 THEN 5 ELSE 0 END AS p, row_number() OVER (PARTITION BY g, id ORDER BY k) AS n FROM o WHERE k % 17 <> 0),
t1 AS (SELECT *, strftime(o_orderdate, '%b, %Y') AS t FROM a JOIN orders ON o_orderkey = k), t2 AS (SELECT *, strftime(o_orderdate, '%b, %Y') AS t FROM b JOIN orders ON o_orderkey = k),
j AS (SELECT coalesce(x.g, y.g) AS g, x.g IS NOT NULL AS l, y.g IS NOT NULL AS r, coalesce(x.s <> y.s, false) AS ws, coalesce(abs(CAST(x.p AS DOUBLE) - y.p) > 0.0001 AND abs(CAST(x.p AS DOUBLE) - y.p) / greatest(abs(CAST(x.p AS DOUBLE)), abs(y.p)) > 0.0001, false) AS wp, coalesce(x.t <> y.t, false) AS wt
 FROM t1 x FULL JOIN t2 y ON x.g = y.g AND x.id = y.id AND x.n = y.n),
c AS (SELECT g, count(*) FILTER (l) AS n1, count(*) FILTER (r) AS n2, count(*) FILTER (l AND r) AS common, CAST(sum(ws::INT) AS BIGINT) AS ws, CAST(sum(wp::INT) AS BIGINT) AS wp, CAST(sum(wt::INT) AS BIGINT) AS wt FROM j GROUP BY g)"""


def _table_run(spark: SparkSession, d: str) -> tuple[DataFrame, str, str]:
    left, right = _tables(spark, d)
    done = compare(spark, left, right, Config(pairing="same-name", key_columns=("id",)))
    return done.results.withColumn("name", _short("file1_path", left)), left, right


@query("compare_tables", f"""WITH {_O} SELECT 'part ' || g || '.csv' AS name, 'Structured' AS type, n1 AS file1_row_count, n2 AS file2_row_count, common AS common_records, n1 - common AS only_in_file1, n2 - common AS only_in_file2, round(common / (n1 + n2 - common), 6) AS similarity_score, ws + wp + wt AS total_field_mismatches,
n2 - n1 AS delta, 'priority' AS only_left, 'clerk' AS only_right, 'date, of order|id|price|status' AS common_columns FROM c""")
def compare_tables(spark, d):
    """CSV files by name, records by a key that repeats; row delta and schema difference."""
    r, *_ = _table_run(spark, d)
    names = lambda c: F.array_join(F.array_sort(c), "|")
    return r.select(
        "name", "type", "file1_row_count", "file2_row_count", "common_records", "only_in_file1", "only_in_file2", F.round("similarity_score", 6).alias("similarity_score"), "total_field_mismatches",
        (F.col("file2_row_count") - F.col("file1_row_count")).alias("delta"), names("columns_only_in_file1").alias("only_left"), names("columns_only_in_file2").alias("only_right"), names("common_columns").alias("common_columns"),
    )


_FIELDS_SQL = f"""WITH {_O}, f AS (SELECT g, common, 'status' AS column_name, ws AS n FROM c UNION ALL SELECT g, common, 'price', wp FROM c UNION ALL SELECT g, common, 'date, of order', wt FROM c)
SELECT 'part ' || g || '.csv' AS name, column_name, n AS mismatch_count, round(100 * n / common, 4) AS percent, least(n, 5) AS samples FROM f WHERE n > 0"""


def _fields(r: DataFrame) -> DataFrame:
    x = r.select("name", "common_records", F.explode("field_mismatches").alias("x"))
    return x.select(
        "name", "x.column_name", "x.mismatch_count", F.round(100 * F.col("x.mismatch_count") / F.col("common_records"), 4).alias("percent"), F.size("x.sample_mismatches").cast("long").alias("samples")
    )


@query("compare_table_fields", _FIELDS_SQL)
def compare_table_fields(spark, d):
    """Mismatches of each column in per cent of matched rows."""
    return _fields(_table_run(spark, d)[0])


@query("mismatch_files", _FIELDS_SQL)
def mismatch_files(spark, d):
    """The same from the mismatch files of the export."""
    r, left, _ = _table_run(spark, d)
    to = _folder(spark, "artifacts")
    sinks.export_all(r.drop("name"), folder=to)
    back = spark.read.schema(results.SCHEMA).option("multiLine", "true").json(f"{to}/mismatches")
    return _fields(back.withColumn("name", _short("file1_path", left)))


@query("csv_records", f"""WITH o AS (SELECT o_custkey % {GROUPS} AS g, o_orderkey AS k, o_orderkey // 2 AS id, strftime(o_orderdate, '%b, %Y') AS t, o_orderpriority AS x, o_orderstatus AS s, CAST(CAST(o_totalprice AS DECIMAL(20, 2)) AS VARCHAR) AS p FROM orders)
SELECT 'part ' || g || '.csv' AS name, row_number() OVER (PARTITION BY g ORDER BY k) AS ord, [CAST(id AS VARCHAR), s, p, t] || CASE WHEN k % 10 = 0 THEN [] ELSE [x] END AS cells FROM o
UNION ALL SELECT DISTINCT 'part ' || g || '.csv', 0, ['id', 'status', 'price', 'date, of order', 'priority'] FROM o""")
def csv_records(spark, d):
    """Records as read: quoted separators, short rows."""
    left, _ = _tables(spark, d)
    f = src.fingerprinted(src.read_files(spark, left))
    return src.table_records(f).select(_short("path", left).alias("name"), "ord", "cells")


def _xlsx(rows: list[list]) -> bytes:
    """A workbook of one sheet, its numbers and truth values typed."""
    def cell(v) -> str:
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        return f"<c><v>{v!r}</v></c>" if isinstance(v, (int, float)) else f'<c t="inlineStr"><is><t>{v}</t></is></c>'

    sheet = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows)
    held, main = io.BytesIO(), "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    kinds = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{kinds}"><sheets><sheet name="a" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{kinds}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{sheet}</sheetData></worksheet>')
    return held.getvalue()


@query("sheet_records", """WITH s AS (SELECT s_nationkey AS g, s_suppkey AS k, s_acctbal AS b FROM supplier), x AS (SELECT g, count(*) AS n FROM s GROUP BY g)
SELECT 'nation ' || g || '.xlsx' AS name, x.n AS line_count, row_number() OVER (PARTITION BY g ORDER BY k) AS ord, [CAST(k AS VARCHAR), CASE WHEN b = floor(b) THEN CAST(CAST(b AS BIGINT) AS VARCHAR) ELSE CAST(b AS VARCHAR) END, CASE WHEN k % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END] AS cells FROM s JOIN x USING (g)
UNION ALL SELECT 'nation ' || g || '.xlsx', n, 0, ['key', 'balance', 'even'] FROM x""")
def sheet_records(spark, d):
    """Workbooks of suppliers: type, rows and cells as text."""
    root = _folder(spark, "sheets")

    def book(rows):
        import pandas as pd

        body = [[int(r.k), float(r.b), int(r.k) % 2 == 0] for r in rows.sort_values("k").itertuples()]
        return pd.DataFrame({"path": [f"{root}/nation {int(rows.g.iloc[0])}.xlsx"], "content": [_xlsx([["key", "balance", "even"], *body])]})

    s = _t(spark, d, "supplier").select(F.col("s_nationkey").alias("g"), F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("b"))
    _put(s.groupBy("g").applyInPandas(book, "path string, content binary"))
    f = materialize(src.fingerprinted(src.read_files(spark, root)), "files")
    return src.table_records(f).join(f.select("path", "line_count"), "path").select(_short("path", root).alias("name"), "line_count", "ord", "cells")


# ---- pieces of the engine that no table reaches by itself


@query("pair_dispatch", _SIDES_SQL + _ALL_SQL + f""" SELECT 'same-path' AS pairing, l.path AS path1, r.path AS path2, {_EST_SQL} AS est_sim FROM l JOIN r ON l.rel_path = r.rel_path
UNION ALL SELECT 'same-name', path1, path2, est_sim FROM (SELECT l.path AS path1, r.path AS path2, {_EST_SQL} AS est_sim, row_number() OVER (PARTITION BY l.path ORDER BY {_EST_SQL} DESC, r.path DESC) AS n FROM l JOIN r ON l.name = r.name) WHERE n = 1
UNION ALL SELECT 'all-vs-all', path1, path2, est_sim FROM u WHERE rank < 2""")
def pair_dispatch(spark, d):
    """The pairing that the settings name."""
    sides, out = _sides(spark, d), None
    for p in ("same-path", "same-name", "all-vs-all"):
        x = pairing.candidates(*sides, Config(pairing=p, topk=1)).select(F.lit(p).alias("pairing"), "path1", "path2", "est_sim")
        out = x if out is None else out.unionAll(x)
    return out


_EXTENSIONS = ("txt", "md", "", "csv", "xlsx", "ods", "py", "rs", "json", "toml", "dat", "html")
_EXT_SQL = f"[{', '.join(repr(e) for e in _EXTENSIONS)}][CAST({{x}} % {len(_EXTENSIONS)} AS INTEGER) + 1]"


@query("extension_groups", f"""WITH e AS (SELECT event_id, {_EXT_SQL.format(x='event_id')} AS e1, {_EXT_SQL.format(x='user_id')} AS e2 FROM events)
SELECT event_id, e1, e2, e1 = e2 OR (list_contains(['txt', 'md', ''], e1) AND list_contains(['txt', 'md', ''], e2)) OR (list_contains(['csv', 'xlsx', 'ods'], e1) AND list_contains(['csv', 'xlsx', 'ods'], e2))
 OR (list_contains(['py', 'rs'], e1) AND list_contains(['py', 'rs'], e2)) OR (list_contains(['json', 'toml'], e1) AND list_contains(['json', 'toml'], e2)) AS compatible FROM e""")
def extension_groups(spark, d):
    """Which extensions may be compared, over pairs of them taken from the events."""
    of = lambda c: F.get(F.array(*map(F.lit, _EXTENSIONS)), (F.col(c) % len(_EXTENSIONS)).cast("int"))
    e = _t(spark, d, "events").select("event_id", of("event_id").alias("e1"), of("user_id").alias("e2"))
    return e.withColumn("compatible", pairing.extension_group(F.col("e1")) == pairing.extension_group(F.col("e2")))


@query("detect_bytes", f"""WITH f AS (SELECT doc_id, file_type, columns, line_count FROM (WITH {_FILES_SQL} SELECT * FROM f))
SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN 'Binary' ELSE file_type END AS file_type, CASE WHEN doc_id % 3 < 2 THEN 0 ELSE line_count END AS line_count, CASE WHEN doc_id % 3 = 2 THEN columns END AS columns FROM f""")
def detect_bytes(spark, d):
    """Documents behind a null character, behind a byte that is no UTF-8, and as they are."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    head = F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("00"))).when(F.col("doc_id") % 3 == 1, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("")))
    return _t(spark, d, "documents").select("doc_id", detect(F.concat(head, raw), F.lit("txt")).alias("k")).select("doc_id", "k.*")


@query("decode_bytes", f"WITH p AS (SELECT doc_id, {_lines_sql('x')} AS l FROM (SELECT doc_id, chr(65533) || coalesce(text, '') || chr(65533) AS x FROM documents)) SELECT doc_id, len(l) AS n, md5(array_to_string(l, chr(10))) AS digest FROM p")
def decode_bytes(spark, d):
    """Bytes that are no UTF-8 at both ends are replaced."""
    raw = F.concat(F.unhex(F.lit("FF")), F.encode(F.coalesce("text", F.lit("")), "UTF-8"), F.unhex(F.lit("FE")))
    x = _t(spark, d, "documents").select("doc_id", split_lines(decode(raw)).alias("l"))
    return x.select("doc_id", F.size("l").cast("long").alias("n"), F.md5(F.array_join("l", "\n")).alias("digest"))


_FILTERS = ((r"\p{L}+", r"\p{L}+"), (r"(?P<day>[0-9]+)", r"[0-9]+"), (r"[[:digit:]*+]+", r"[0-9*+]+"), (r"(?=x)", None), (r"(a)\1", None), (r"([a", None), (r"[[:upper:]][[:lower:]]+", r"[A-Z][a-z]+"))


@query("ignore_regex_forms", "WITH p AS (SELECT conv_id, turn, text FROM conversations WHERE text IS NOT NULL) " + " UNION ALL ".join(
    f"SELECT conv_id, turn, CAST({k} AS INTEGER) AS form, array_to_string(list_transform({_lines_sql('text')}, lambda x: {'x' if sql is None else f'regexp_replace(x, {chr(39)}{sql}{chr(39)}, {chr(39)}<IGNORED>{chr(39)}, {chr(39)}g{chr(39)})'}), chr(10)) AS text FROM p" for k, (_, sql) in enumerate(_FILTERS)))
def ignore_regex_forms(spark, d):
    """Line filters in several notations; those that can't be used leave lines as they are."""
    c, out = _t(spark, d, "conversations").where("text is not null"), None
    for k, (pattern, _) in enumerate(_FILTERS):
        x = c.select("conv_id", "turn", F.lit(k).alias("form"), F.array_join(text_lines(F.col("text"), Normalization(), line_filter(pattern)), "\n").alias("text"))
        out = x if out is None else out.unionAll(x)
    return out


@query("encode_ranges", """WITH p AS (SELECT DISTINCT l_suppkey AS s, l_partkey % 300 AS x FROM lineitem), g AS (SELECT s, x, x - row_number() OVER (PARTITION BY s ORDER BY x) AS island FROM p),
i AS (SELECT s, min(x) AS lo, max(x) AS hi FROM g GROUP BY s, island) SELECT s AS l_suppkey, string_agg(CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE lo || '-' || hi END, ',' ORDER BY lo) AS ranges FROM i GROUP BY s""")
def ranges(spark, d):
    """Numbers of each supplier as ranges."""
    p = _t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.array_sort(F.collect_set(F.col("l_partkey") % 300)).alias("x"))
    return p.select("l_suppkey", F.udf(encode_ranges, StringType())("x").alias("ranges"))


_SAFE = r"""SELECT event_id, translate(props, '/\:*?"<>|', '_________') AS name FROM events"""


@query("sanitize_names", _SAFE)
def sanitize_names(spark, d):
    return _t(spark, d, "events").select("event_id", sinks.sanitize(F.col("props")).alias("name"))


@query("format_sizes", """SELECT o_orderkey, CASE WHEN b < 1024 THEN CAST(b AS BIGINT) || ' B' WHEN b < 1048576 THEN printf('%.1f KB', b / 1024) WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576) ELSE printf('%.1f GB', b / 1073741824) END AS shown
FROM (SELECT o_orderkey, CAST(o_orderkey AS DOUBLE) * o_orderkey * o_custkey AS b FROM orders)""")
def format_sizes(spark, d):
    b = F.col("o_orderkey").cast("double") * F.col("o_orderkey") * F.col("o_custkey")
    return _t(spark, d, "orders").select("o_orderkey", F.udf(report.format_bytes, StringType())(b).alias("shown"))

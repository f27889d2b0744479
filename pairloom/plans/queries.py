"""Registered queries over the supplied tables, each with its SQL for DuckDB.

Record diffs compare a table with a second version derived from it; measures compare
every document with the next one; pairing treats documents as files, even ids against odd.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import Config, Normalization
from ..functions import fingerprint as fp
from ..functions.normalize import decode, filter_lines, normalize_lines, split_lines, text_lines
from ..functions.sequence import comparer
from ..functions.values import values_equal, values_equal_sql
from ..operators import measures, pairing
from ..operators.structured import RecordDiff
from ..sources.detect import detect, parse_header, sniff
from ..tables import materialize
from . import results

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
TOL = 0.0001
WS = r"[\x09-\x0d\x{85}\p{Z}]"


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_TABLES = ("orders", "lineitem", "supplier", "part", "documents")


def _over(spark: SparkSession, d: str, text: str) -> DataFrame:
    """``text`` over the supplied tables, without views that the caller might have too."""
    used = [t for t in _TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", text)]
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **{t: _t(spark, d, t) for t in used})


# ---- record diffs -------------------------------------------------------------------

#: second versions; the expressions are the same in both dialects
ORDERS1 = "SELECT o_orderkey, o_custkey, o_orderstatus, CAST(CAST(o_totalprice AS DECIMAL(20, 5)) AS {text}) AS o_totalprice, CAST(CAST(o_orderdate AS DATE) AS {text}) AS o_orderdate, o_orderpriority FROM orders"
ORDERS2 = """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 19 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
CAST(CAST(o_totalprice AS DECIMAL(20, 5)) + CASE WHEN o_orderkey % 13 = 0 THEN CAST(10 AS DECIMAL(20, 5)) WHEN o_orderkey % 11 = 0 THEN CAST(0.00001 AS DECIMAL(20, 5)) ELSE CAST(0 AS DECIMAL(20, 5)) END AS {text}) AS o_totalprice, CAST(CAST(o_orderdate AS DATE) AS {text}) AS o_orderdate, o_orderpriority
FROM orders WHERE o_orderkey % 17 <> 0 UNION ALL
SELECT o_orderkey + 10000000, o_custkey, o_orderstatus, CAST(CAST(o_totalprice AS DECIMAL(20, 5)) AS {text}), CAST(CAST(o_orderdate AS DATE) AS {text}), o_orderpriority FROM orders WHERE o_orderkey % 23 = 0"""
_REST = "l_suppkey, CAST(CAST(l_extendedprice AS DECIMAL(14, 2)) AS {text}) AS l_extendedprice, CAST(CAST(l_discount AS DECIMAL(14, 2)) AS {text}) AS l_discount, CAST(CAST(l_tax AS DECIMAL(14, 2)) AS {text}) AS l_tax, l_returnflag, l_linestatus, CAST(CAST(l_shipdate AS DATE) AS {text}) AS l_shipdate"
LINES1 = f"SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(l_quantity AS DECIMAL(12, 2)) AS {{text}}) AS l_quantity, {_REST} FROM lineitem"
LINES2 = f"""SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(l_quantity AS DECIMAL(12, 2)) + CASE WHEN l_suppkey % 7 = 0 THEN 1 ELSE 0 END AS {{text}}) AS l_quantity, {_REST}
FROM lineitem WHERE l_partkey % 29 <> 0"""
SUPPLIER1 = "SELECT s_suppkey, s_name, s_nationkey, CAST(CAST(s_acctbal AS DECIMAL(20, 4)) AS {text}) AS s_acctbal FROM supplier"
SUPPLIER2 = """SELECT s_suppkey, s_name, s_nationkey, CAST(CAST(s_acctbal AS DECIMAL(20, 4)) + CASE s_suppkey % 5 WHEN 0 THEN CAST(0.0001 AS DECIMAL(20, 4)) WHEN 1 THEN CAST(0.01 AS DECIMAL(20, 4))
WHEN 2 THEN CAST(1 AS DECIMAL(20, 4)) WHEN 3 THEN CAST(40 AS DECIMAL(20, 4)) ELSE CAST(0 AS DECIMAL(20, 4)) END AS {text}) AS s_acctbal FROM supplier"""
PART1 = "SELECT p_name, p_brand, p_type, p_size, CAST(CAST(p_retailprice AS DECIMAL(14, 2)) AS {text}) AS p_retailprice FROM part"
PART2 = "SELECT p_name, CASE WHEN p_partkey % 9 = 0 THEN 'Brand#00' ELSE p_brand END AS p_brand, p_type, p_size, CAST(CAST(p_retailprice AS DECIMAL(14, 2)) AS {text}) AS p_retailprice FROM part WHERE p_partkey % 31 <> 0"


def _versions(spark: SparkSession, d: str, one: str, two: str) -> tuple[DataFrame, DataFrame]:
    return _over(spark, d, one.format(text="STRING")), _over(spark, d, two.format(text="STRING"))


def _diff(spark: SparkSession, d: str, one: str, two: str, keys: tuple[str, ...], tol: float = TOL, **more) -> RecordDiff:
    return RecordDiff(*_versions(spark, d, one, two), Config(key_columns=keys, numeric_tolerance=tol, **more))


def _diff_sql(one: str, two: str, keys: tuple[str, ...], cols: tuple[str, ...], every: tuple[str, ...], tol: float = TOL, compat: bool = False) -> str:
    """CTEs a, b and j: the pairs, with keys k, ordinal rn and cells a_<c> and b_<c>."""
    key = " || '|' || ".join(f"coalesce(CAST({k} AS VARCHAR), '')" for k in keys) or "''"
    by = key if compat or not keys else ", ".join(keys)
    order = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in sorted(every))
    one, two = one.format(text="VARCHAR"), two.format(text="VARCHAR")
    cells = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '') AS c_{c}" for c in cols)
    side = f"SELECT {key} AS k, {cells}{', ' if cols else ''}row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS rn FROM"
    out = ", ".join(f"a.c_{c} AS a_{c}, b.c_{c} AS b_{c}" for c in cols)
    return f"""WITH a AS ({side} ({one})), b AS ({side} ({two})),
j AS (SELECT coalesce(a.k, b.k) AS k, coalesce(a.rn, b.rn) AS rn, CASE WHEN b.k IS NULL THEN 'left' WHEN a.k IS NULL THEN 'right' ELSE 'both' END AS side{', ' if cols else ''}{out}
 FROM a FULL JOIN b ON a.k = b.k AND a.rn = b.rn)"""


def _counts_sql(base: str, cols: tuple[str, ...], tol: float = TOL) -> str:
    wrong = " + ".join(f"CASE WHEN side = 'both' AND NOT {values_equal_sql(f'a_{c}', f'b_{c}', tol)} THEN 1 ELSE 0 END" for c in cols) or "0"
    return base + f""", c AS (SELECT count(*) FILTER (side = 'both') AS common, count(*) FILTER (side = 'left') AS only1, count(*) FILTER (side = 'right') AS only2,
 CAST(coalesce(sum({wrong}), 0) AS BIGINT) AS mismatches FROM j)
SELECT common + only1 AS rows1, common + only2 AS rows2, common, only1, only2, mismatches,
 CASE WHEN common + only1 + only2 > 0 THEN common / (common + only1 + only2) ELSE 1.0 END AS similarity, only1 = 0 AND only2 = 0 AND mismatches = 0 AS identical FROM c"""


def _mismatches_sql(base: str, cols: tuple[str, ...], tol: float = TOL) -> str:
    rows = " UNION ALL ".join(f"SELECT '{c}' AS column_name, k AS key, rn, a_{c} AS value1, b_{c} AS value2 FROM j WHERE side = 'both' AND NOT {values_equal_sql(f'a_{c}', f'b_{c}', tol)}" for c in cols)
    return base + f", m AS ({rows})"


O_ALL = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
O_KEY, O_COLS = ("o_orderkey",), ("o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus", "o_totalprice")
ORDERS_SQL = _diff_sql(ORDERS1, ORDERS2, O_KEY, O_COLS, O_ALL)
_L_REST = ("l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
L_ALL = ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", *_L_REST)
L_KEY, L_COLS = ("l_orderkey", "l_linenumber"), tuple(sorted(("l_partkey", "l_quantity", *_L_REST)))
S_ALL, S_KEY, S_COLS = ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), ("s_suppkey",), ("s_name", "s_nationkey", "s_acctbal")
P_ALL = ("p_name", "p_brand", "p_type", "p_size", "p_retailprice")


@query("struct_diff_counts", _counts_sql(ORDERS_SQL, O_COLS))
def struct_diff_counts(spark, d):
    return _diff(spark, d, ORDERS1, ORDERS2, O_KEY).counts


@query("struct_diff_self", _counts_sql(_diff_sql(ORDERS1, ORDERS1, O_KEY, O_COLS, O_ALL), O_COLS))
def struct_diff_self(spark, d):
    return _diff(spark, d, ORDERS1, ORDERS1, O_KEY).counts


@query("struct_diff_dup_keys", _counts_sql(_diff_sql(LINES1, LINES2, L_KEY, L_COLS, L_ALL), L_COLS))
def struct_diff_dup_keys(spark, d):
    return _diff(spark, d, LINES1, LINES2, L_KEY).counts


@query("struct_composite_key", _counts_sql(_diff_sql(LINES1, LINES2, L_KEY, L_COLS, L_ALL, compat=True), L_COLS))
def struct_composite_key(spark, d):
    return _diff(spark, d, LINES1, LINES2, L_KEY, compat_key=True).counts


@query("struct_default_key", _counts_sql(_diff_sql(PART1, PART2, ("p_name",), P_ALL, P_ALL), P_ALL))
def struct_default_key(spark, d):
    """Without key columns the first one is the key; names repeat."""
    return _diff(spark, d, PART1, PART2, ()).counts


@query("struct_missing_key", _counts_sql(_diff_sql(SUPPLIER1, SUPPLIER2, (), S_ALL, S_ALL), S_ALL))
def struct_missing_key(spark, d):
    """A key that no table has: rows pair by position."""
    return _diff(spark, d, SUPPLIER1, SUPPLIER2, ("nope",)).counts


@query("struct_ignore_columns", _counts_sql(_diff_sql(ORDERS1, ORDERS2, O_KEY, ("o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice"), O_ALL), ("o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice")))
def struct_ignore_columns(spark, d):
    return _diff(spark, d, ORDERS1, ORDERS2, O_KEY, ignore_columns=("o_orderstatus",)).counts


for _side in ("left", "right"):
    @query(f"struct_only_{_side}", ORDERS_SQL + f" SELECT k AS key, rn AS nth FROM j WHERE side = '{_side}'")
    def _only(spark, d, side=_side):
        return _diff(spark, d, ORDERS1, ORDERS2, O_KEY).only(side)


@query("struct_column_mismatches", _mismatches_sql(ORDERS_SQL, O_COLS) + " SELECT column_name, count(*) AS mismatch_count FROM m GROUP BY column_name")
def struct_column_mismatches(spark, d):
    return _diff(spark, d, ORDERS1, ORDERS2, O_KEY).column_mismatches


_SAMPLES = " SELECT column_name, CAST(nth AS INTEGER) AS nth, key, value1, value2 FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY key, rn, value1, value2) AS nth FROM m) WHERE nth <= 5"


@query("struct_samples5", _mismatches_sql(ORDERS_SQL, O_COLS) + _SAMPLES)
def struct_samples5(spark, d):
    return _diff(spark, d, ORDERS1, ORDERS2, O_KEY).samples()


@query("struct_samples_dup_keys", _mismatches_sql(_diff_sql(LINES1, LINES2, L_KEY, L_COLS, L_ALL), L_COLS) + _SAMPLES)
def struct_samples_dup_keys(spark, d):
    return _diff(spark, d, LINES1, LINES2, L_KEY).samples()


for _name, _tol in (("none", 0.0), ("tight", 0.0005), ("loose", 0.05)):
    @query(f"struct_tolerance_{_name}", _counts_sql(_diff_sql(SUPPLIER1, SUPPLIER2, S_KEY, S_COLS, S_ALL, _tol), S_COLS, _tol))
    def _tolerance(spark, d, tol=_tol):
        return _diff(spark, d, SUPPLIER1, SUPPLIER2, S_KEY, tol).counts


#: texts that are numbers, or nearly, built from the supplier's key
NUMBERS = """SELECT s_suppkey, concat('', s_suppkey) AS a, CASE s_suppkey % 10 WHEN 0 THEN concat(' ', s_suppkey) WHEN 1 THEN concat(s_suppkey, 'd') WHEN 2 THEN concat(s_suppkey, '.') WHEN 3 THEN concat(s_suppkey, 'e0')
WHEN 4 THEN concat('+', s_suppkey, '.0') WHEN 5 THEN 'NaN' WHEN 6 THEN 'Infinity' WHEN 7 THEN '' WHEN 8 THEN concat('0x', s_suppkey) ELSE concat('.', s_suppkey, 'E4') END AS b FROM supplier"""


@query("values_equal", f"SELECT s_suppkey, b, {values_equal_sql('a', 'b', 0.001)} AS equal FROM ({NUMBERS})")
def values_equal_query(spark, d):
    return _over(spark, d, NUMBERS).select("s_suppkey", "b", values_equal(F.col("a"), F.col("b"), 0.001).alias("equal"))


@query("schema_diff", "SELECT 'common' AS kind, unnest(['c_custkey', 'c_name']) AS column_name UNION ALL SELECT 'only1', unnest(['c_mktsegment', 'c_nationkey']) UNION ALL SELECT 'only2', unnest(['balance', 'nation'])")
def schema_diff(spark, d):
    from ..operators.structured import schemas

    c = _t(spark, d, "customer")
    s = schemas(c.drop("c_acctbal"), c.selectExpr("c_name", "c_custkey", "c_nationkey AS nation", "c_acctbal AS balance"), Config())
    return spark.createDataFrame([(k, x) for k in ("common", "only1", "only2") for x in getattr(s, k)], "kind string, column_name string")


@query("schema_signature", "SELECT event_id, substr(sha256(array_to_string(list_sort(json_keys(props)), '|')), 1, 16) AS signature FROM events")
def schema_signature(spark, d):
    """The signature of the fields of each event's properties."""
    e = _t(spark, d, "events")
    return e.select("event_id", fp.schema_signature(F.json_object_keys("props")).alias("signature"))


# ---- measures -----------------------------------------------------------------------

NAMES = """SELECT a.p_name AS a, b.p_name AS b FROM (SELECT DISTINCT p_name FROM part) a JOIN (SELECT DISTINCT p_name FROM part) b ON a.p_name <= b.p_name"""
NEXT = "SELECT x.doc_id AS id, coalesce(x.text, '') AS a, coalesce(y.text, '') AS b FROM documents x JOIN documents y ON y.doc_id = x.doc_id + 1"


def _names(spark: SparkSession, d: str) -> DataFrame:
    return _over(spark, d, NAMES)


def _next(spark: SparkSession, d: str) -> DataFrame:
    return _over(spark, d, NEXT)


@query("sim_levenshtein_names", f"SELECT a, b, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) AS score FROM ({NAMES})")
def sim_levenshtein_names(spark, d):
    return _names(spark, d).select("a", "b", F.round(measures.levenshtein(F.col("a"), F.col("b")), 6).alias("score"))


@query("sim_damerau_names", f"SELECT a, b, round(1 - damerau_levenshtein(a, b) / greatest(length(a), length(b)), 6) AS score FROM ({NAMES})")
def sim_damerau_names(spark, d):
    return _names(spark, d).select("a", "b", F.round(measures.damerau(F.col("a"), F.col("b")), 6).alias("score"))


@query("sim_jaro_winkler_names", f"SELECT a, b, round(jaro_winkler_similarity(a, b), 6) AS score FROM ({NAMES})")
def sim_jaro_winkler_names(spark, d):
    return _names(spark, d).select("a", "b", F.round(measures.jaro_winkler(F.col("a"), F.col("b")), 6).alias("score"))


for _m, _f in (("levenshtein", measures.text_levenshtein), ("damerau", measures.damerau), ("jaro_winkler", measures.jaro_winkler)):
    @query(f"sim_{_m}")
    def _characters(spark, d, f=_f):
        """Whole texts of each document and the next, lines, white space and all."""
        x = _next(spark, d).repartition("id")  # the cost of a pair is the product of its lengths
        return x.select("id", F.round(f(F.col("a"), F.col("b")), 6).alias("score"))


_WORDS_SQL = f"list_filter(regexp_split_to_array(lower({{t}}), '{WS}+'), lambda x: x <> '')"
_GRAMS_SQL = "list_filter(flatten(list_transform(range(1, length({t}) + 1), lambda i: [substr({t}, i, 1), substr({t}, i, 2), substr({t}, i, 3)])), lambda x: strlen(x) = 3)"
_PAIRS_SQL = "list_transform(range(1, length({t})), lambda i: substr({t}, i, 2))"


def _bag_sql(tokens: str, score: str, squeeze: bool = False) -> str:
    pairs = f"SELECT id, a AS a0, b AS b0, {f'regexp_replace(a, {chr(39)}{WS}+{chr(39)}, {chr(39)}{chr(39)}, {chr(39)}g{chr(39)})' if squeeze else 'a'} AS a, {f'regexp_replace(b, {chr(39)}{WS}+{chr(39)}, {chr(39)}{chr(39)}, {chr(39)}g{chr(39)})' if squeeze else 'b'} AS b FROM ({NEXT})"
    return f"""WITH p AS ({pairs}), t AS (SELECT id, unnest({tokens.replace('{t}', 'a')}) AS t, 1 AS l, 0 AS r FROM p UNION ALL SELECT id, unnest({tokens.replace('{t}', 'b')}), 0, 1 FROM p),
c AS (SELECT id, t, sum(l) AS l, sum(r) AS r FROM t GROUP BY id, t),
s AS (SELECT id, count(*) FILTER (l > 0) AS d1, count(*) FILTER (r > 0) AS d2, count(*) FILTER (l > 0 AND r > 0) AS both_, sum(l) AS t1, sum(r) AS t2, sum(least(l, r)) AS least_,
 sum(l * r) AS dot, sum(l * l) AS sq1, sum(r * r) AS sq2, sum(CASE WHEN r > 0 THEN l * l ELSE 0 END) AS sh1, sum(CASE WHEN l > 0 THEN r * r ELSE 0 END) AS sh2 FROM c GROUP BY id)
SELECT p.id, round(CAST({score} AS DOUBLE), 6) AS score FROM p LEFT JOIN s USING (id)"""


_C2 = measures.ALONE**2
_BAG_SCORES = {
    "jaccard": (_WORDS_SQL, "CASE WHEN s.id IS NULL THEN 1.0 ELSE both_ / (d1 + d2 - both_) END", False),
    "cosine": (_WORDS_SQL, "CASE WHEN s.id IS NULL THEN 1.0 WHEN sq1 = 0 OR sq2 = 0 THEN 0.0 ELSE least(1.0, dot / (sqrt(sq1) * sqrt(sq2))) END", False),
    "tfidf": (_WORDS_SQL, f"CASE WHEN s.id IS NULL THEN 1.0 WHEN sq1 = 0 OR sq2 = 0 THEN 0.0 ELSE least(1.0, dot / (sqrt(sh1 + {_C2!r} * (sq1 - sh1)) * sqrt(sh2 + {_C2!r} * (sq2 - sh2)))) END", False),
    "ngram": (_GRAMS_SQL, "CASE WHEN strlen(a) < 3 AND strlen(b) < 3 THEN 1.0 WHEN a = '' OR b = '' THEN 0.0 WHEN s.id IS NULL THEN 1.0 ELSE both_ / (d1 + d2 - both_) END", False),
    "sorensen-dice": (_PAIRS_SQL, "CASE WHEN a = b THEN 1.0 WHEN length(a) < 2 OR length(b) < 2 THEN 0.0 ELSE 2 * least_ / (t1 + t2) END", True),
}
for _m, (_tok, _score, _sq) in _BAG_SCORES.items():
    @query(f"sim_{_m.replace('-', '_')}", _bag_sql(_tok, _score, _sq))
    def _bag(spark, d, m=_m):
        return measures.bag_similarity(_next(spark, d), ["id"], "a", "b", m).select("id", F.round("score", 6).alias("score"))


_LINES_SQL = "CASE WHEN {t} = '' THEN [] WHEN ends_with({t}, chr(10)) THEN string_split({t}, chr(10))[:-2] ELSE string_split({t}, chr(10)) END"


def _lines_sql(t: str) -> str:
    return _LINES_SQL.replace('{t}', f"replace({t}, chr(13) || chr(10), chr(10))")


def _line_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _next(spark, d).select("id", split_lines(F.col("a")).alias("a"), split_lines(F.col("b")).alias("b"))


@query("sim_hamming", f"""WITH p AS (SELECT id, {_lines_sql('a')} AS a, {_lines_sql('b')} AS b FROM ({NEXT}))
SELECT id, round(CASE WHEN greatest(len(a), len(b)) = 0 THEN 1.0 ELSE len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] = b[i])) / greatest(len(a), len(b)) END, 6) AS score FROM p""")
def sim_hamming(spark, d):
    return _line_pairs(spark, d).select("id", F.round(measures.hamming(F.col("a"), F.col("b")), 6).alias("score"))


#: the first five lines' longest common subsequence needs dynamic programming: as a recursion over the rows of the table
_LCS_SQL = f"""WITH RECURSIVE p AS (SELECT id, {_lines_sql('a')} AS a, {_lines_sql('b')} AS b FROM ({NEXT})),
g(id, a, b, i, cur) AS (SELECT id, a, b, 0, list_transform(range(0, len(b) + 1), lambda j: 0) FROM p
UNION ALL SELECT id, a, b, i + 1, list_reduce(range(1, len(b) + 1), lambda acc, j: list_append(acc, CASE WHEN a[i + 1] = b[j] THEN cur[j] + 1 ELSE greatest(cur[j + 1], acc[j]) END), [0]) FROM g WHERE i < len(a))
"""
_LCS_END = "SELECT id, len(a) AS n, len(b) AS m, CAST(cur[len(b) + 1] AS BIGINT) AS common FROM g WHERE i = len(a)"


def _from_common(name: str, spark_score, sql_score: str) -> None:
    @query(name, _LCS_SQL + f"SELECT id, common, round(CAST({sql_score} AS DOUBLE), 6) AS score FROM ({_LCS_END})")
    def run(spark, d):
        x = _line_pairs(spark, d)
        x = x.select("id", F.size("a").alias("n"), F.size("b").alias("m"), measures.line_common(F.col("a"), F.col("b")).alias("common"))
        return x.select("id", "common", F.round(spark_score(F.col("n"), F.col("m"), F.col("common")), 6).alias("score"))


_from_common("sim_diff", lambda n, m, c: F.when(n + m > 0, c / (n + m - c)).otherwise(1.0), "CASE WHEN n + m > 0 THEN common / (n + m - common) ELSE 1.0 END")
_from_common("sim_ratcliff_obershelp", lambda n, m, c: F.when(n + m > 0, 2 * c / (n + m)).otherwise(1.0), "CASE WHEN n + m > 0 THEN 2 * common / (n + m) ELSE 1.0 END")
_from_common("sim_lcs", lambda n, m, c: F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0), 0.0).otherwise(c / F.greatest(n, m)), "CASE WHEN n = 0 AND m = 0 THEN 1.0 WHEN n = 0 OR m = 0 THEN 0.0 ELSE common / greatest(n, m) END")


@query("sim_smith_waterman", f"""WITH RECURSIVE p AS (SELECT id, {_lines_sql('a')} AS a, {_lines_sql('b')} AS b FROM ({NEXT})),
g(id, a, b, i, cur, best) AS (SELECT id, a, b, 0, list_transform(range(0, len(b) + 1), lambda j: 0), 0 FROM p
UNION ALL SELECT id, a, b, i + 1, nxt, greatest(best, list_max(nxt)) FROM (SELECT id, a, b, i, best,
 list_reduce(range(1, len(b) + 1), lambda acc, j: list_append(acc, greatest(0, cur[j] + CASE WHEN a[i + 1] = b[j] THEN 2 ELSE -1 END, cur[j + 1] - 1, acc[j] - 1)), [0]) AS nxt FROM g WHERE i < len(a)))
SELECT id, round(CAST(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE least(1.0, best / (2 * least(len(a), len(b)))) END AS DOUBLE), 6) AS score FROM g WHERE i = len(a)""")
def sim_smith_waterman(spark, d):
    return _line_pairs(spark, d).select("id", F.round(measures.smith_waterman(F.col("a"), F.col("b")), 6).alias("score"))


@query("unified_diff")
def unified_diff(spark, d):
    """Counts, positions in the script, diff and score of every document against the next."""
    x = _line_pairs(spark, d).withColumn("x", comparer("diff")(F.col("a"), F.col("b"), F.lit("a"), F.lit("b")))
    return x.select("id", "x.*")


# ---- fingerprints and pairing ----------------------------------------------------------

FILES = """SELECT concat('doc_', doc_id) AS path, concat(lang, '/', doc_id // 2) AS rel_path, concat('doc_', doc_id // 2, '.', lang) AS name, octet_length(coalesce(text, '')) AS size,
lower(lang) AS extension, doc_id, coalesce(text, '') AS text FROM documents""".replace("doc_id // 2", "{half}")


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files, with 32-bit fingerprints of a hash that DuckDB has too."""
    f = _over(spark, d, FILES.format(half="doc_id div 2")).repartition("doc_id")  # a hash of every shingle is much work for a row
    f = f.withColumn("k", detect(F.encode("text", "UTF-8"), F.col("extension")))
    f = f.select(
        "path", "rel_path", "name", F.col("size").cast("long").alias("size"), F.col("k.file_type").alias("file_type"), "extension",
        fp.content_hash(F.col("text")).alias("content_hash"), F.when(F.col("k.columns").isNotNull(), fp.schema_signature(F.col("k.columns"))).alias("schema_signature"),
        "doc_id", F.col("k.line_count").alias("line_count"), fp.shingles(split_lines(F.col("text"))).alias("grams"),
    )
    return fp.simhash(f, [c for c in f.columns if c != "grams"], F.col("grams"), hash_of=fp.md5_32, bits=32)


_TRIM = f"regexp_replace({{x}}, '^{WS}+|{WS}+$', '', 'g')"
_FIRST = _TRIM.replace('{x}', "string_split(text, chr(10))[1]")


def _sniff_sql(first: str, sep: str) -> str:
    parts = f"list_transform(string_split({first}, {sep}), lambda x: {_TRIM.replace('{x}', 'x')})"
    return f"CASE WHEN len(string_split({first}, {sep})) >= 2 AND len(list_filter({parts}, lambda x: x = '' OR strlen(x) >= 100)) = 0 THEN {parts} END"


_SHINGLES_SQL = f"""list_concat(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END,
 CASE WHEN len(l) >= 3 THEN list_transform(range(1, len(l) - 1), lambda i: array_to_string(l[i:i + 2], chr(10))) ELSE [] END)"""
_HASHES_SQL = f"""raw AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lw AS (SELECT doc_id, {_lines_sql('text')} AS l, list_filter(regexp_split_to_array(text, '{WS}+'), lambda x: x <> '') AS w FROM raw),
gr AS (SELECT doc_id, unnest({_SHINGLES_SQL}) AS g FROM lw), hs AS (SELECT doc_id, CAST('0x' || substr(md5(g), 1, 8) AS BIGINT) AS h FROM gr),
sh AS (SELECT doc_id, {' + '.join(f'CASE WHEN sum(CASE WHEN (h >> {i}) & 1 = 1 THEN 1 ELSE -1 END) > 0 THEN {1 << i} ELSE 0 END' for i in range(32))} AS simhash FROM hs GROUP BY doc_id)"""
_FILES_SQL = f"""{_HASHES_SQL}, f0 AS ({FILES.format(half='doc_id // 2').replace('octet_length(', 'strlen(')}),
f1 AS (SELECT f0.*, sha256(text) AS content_hash, coalesce({_sniff_sql(_FIRST, "','")}, {_sniff_sql(_FIRST, 'chr(9)')}) AS columns,
 CASE WHEN {_sniff_sql(_FIRST, "','")} IS NOT NULL THEN 'Csv' WHEN {_sniff_sql(_FIRST, 'chr(9)')} IS NOT NULL THEN 'Tsv' ELSE 'Text' END AS file_type,
 len(text) - len(replace(text, chr(10), '')) + CASE WHEN text <> '' AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END AS line_count FROM f0),
f AS (SELECT f1.*, substr(sha256(array_to_string(list_sort(columns), '|')), 1, 16) AS schema_signature, coalesce(simhash, 0) AS simhash FROM f1 LEFT JOIN sh USING (doc_id))"""
_EST_SQL = "CAST(CASE WHEN l.content_hash = r.content_hash THEN 1.0 ELSE 1 - bit_count(xor(l.simhash, r.simhash)) / 64 END AS DOUBLE)"


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    f = materialize(_files(spark, d), "files")  # fingerprinted once, however often it is joined
    return f.where("doc_id % 2 = 0"), f.where("doc_id % 2 = 1")


_SIDES_SQL = f"WITH {_FILES_SQL}, l AS (SELECT * FROM f WHERE doc_id % 2 = 0), r AS (SELECT * FROM f WHERE doc_id % 2 = 1)"
_NEAR_SQL = "(l.size <= 0 OR r.size <= 0 OR (l.size <= 10 * r.size AND r.size <= 10 * l.size)) AND l.extension = r.extension"
_EXACT_SQL = """(SELECT x.path AS path1, y.path AS path2 FROM (SELECT path, content_hash, row_number() OVER (PARTITION BY content_hash ORDER BY path) AS n FROM l) x
JOIN (SELECT path, content_hash, row_number() OVER (PARTITION BY content_hash ORDER BY path) AS n FROM r) y ON x.content_hash = y.content_hash AND x.n = y.n)"""


def _similar_sql(l: str, r: str, k: int) -> str:
    return f"(SELECT * FROM (SELECT l.path AS path1, r.path AS path2, {_EST_SQL} AS est_sim, row_number() OVER (PARTITION BY l.path ORDER BY {_EST_SQL} DESC, r.path) AS rank FROM {l} l JOIN {r} r ON {_NEAR_SQL}) WHERE rank <= {k})"


_ALL_SQL = f""", e AS {_EXACT_SQL}, l2 AS (SELECT * FROM l WHERE path NOT IN (SELECT path1 FROM e)), r2 AS (SELECT * FROM r WHERE path NOT IN (SELECT path2 FROM e)),
u AS (SELECT path1, path2, CAST(1.0 AS DOUBLE) AS est_sim, true AS exact_hash_match, 0 AS rank FROM e UNION ALL SELECT path1, path2, est_sim, false, rank FROM {_similar_sql('l2', 'r2', 3)})"""


@query("fp_files", f"WITH {_FILES_SQL} SELECT path, size, file_type, extension, content_hash, simhash, schema_signature, line_count FROM f")
def fp_files(spark, d):
    """Type, hash, fingerprint, signature and lines of every document as a file."""
    return _files(spark, d).select("path", "size", "file_type", "extension", "content_hash", "simhash", "schema_signature", "line_count")


@query("fp_shingles", f"WITH {_HASHES_SQL} SELECT doc_id, count(*) AS shingles, count(DISTINCT g) AS distinct_shingles FROM gr GROUP BY doc_id")
def fp_shingles(spark, d):
    t = _t(spark, d, "documents").select("doc_id", F.explode(fp.shingles(split_lines(F.coalesce("text", F.lit("")))))
                                         .alias("g")).repartition("doc_id")
    c = t.groupBy("doc_id", "g").agg(F.count("*").alias("n"))
    return c.groupBy("doc_id").agg(F.sum("n").alias("shingles"), F.count("*").alias("distinct_shingles"))


@query("fp_hash_groups", "SELECT sha256(coalesce(text, '')) AS content_hash, count(*) AS files, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def fp_hash_groups(spark, d):
    t = _t(spark, d, "documents").select("doc_id", fp.content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"))
    return t.groupBy("content_hash").agg(F.count("*").alias("files"), F.min("doc_id").alias("first_id")).where("files > 1")


@query("fp_hamming", f"WITH {_HASHES_SQL} SELECT x.doc_id AS id, CAST(bit_count(xor(x.simhash, y.simhash)) AS INTEGER) AS distance, CAST(1 - bit_count(xor(x.simhash, y.simhash)) / 64 AS DOUBLE) AS similarity FROM sh x JOIN sh y ON y.doc_id = x.doc_id + 1")
def fp_hamming(spark, d):
    t = _t(spark, d, "documents").select("doc_id", fp.simhash_counted(fp.shingles(split_lines(F.coalesce("text", F.lit("")))), hash_of=fp.md5_32, bits=32).alias("x"))
    s = materialize(t.where("x.n > 0").select("doc_id", "x.simhash"), "prints")  # fingerprinted once for both sides
    y = s.select((F.col("doc_id") - 1).alias("doc_id"), F.col("simhash").alias("other"))
    a, b = F.col("simhash"), F.col("other")
    return s.join(y, "doc_id").select(F.col("doc_id").alias("id"), fp.hamming(a, b).alias("distance"), fp.simhash_similarity(a, b).alias("similarity"))


@query("pair_exact", _SIDES_SQL + f" SELECT path1, path2, CAST(1.0 AS DOUBLE) AS est_sim, true AS exact_hash_match FROM {_EXACT_SQL}")
def pair_exact(spark, d):
    return pairing.match_exact(*_sides(spark, d))


@query("pair_same_path", _SIDES_SQL + f" SELECT l.path AS path1, r.path AS path2, {_EST_SQL} AS est_sim, l.content_hash = r.content_hash AS exact_hash_match FROM l JOIN r ON l.rel_path = r.rel_path")
def pair_same_path(spark, d):
    return pairing.match_by_path(*_sides(spark, d))


@query("pair_same_name", _SIDES_SQL + f" SELECT path1, path2, est_sim, exact_hash_match FROM (SELECT l.path AS path1, r.path AS path2, {_EST_SQL} AS est_sim, l.content_hash = r.content_hash AS exact_hash_match, row_number() OVER (PARTITION BY l.path ORDER BY {_EST_SQL} DESC, r.path DESC) AS n FROM l JOIN r ON l.name = r.name) WHERE n = 1")
def pair_same_name(spark, d):
    return pairing.match_by_name(*_sides(spark, d))


@query("pair_topk", _SIDES_SQL + f" SELECT path1, path2, est_sim, false AS exact_hash_match, CAST(rank AS INTEGER) AS rank FROM {_similar_sql('l', 'r', 3)}")
def pair_topk(spark, d):
    return pairing.match_similar(*_sides(spark, d))


@query("pair_all_vs_all", _SIDES_SQL + _ALL_SQL + " SELECT path1, path2, est_sim, exact_hash_match FROM u")
def pair_all_vs_all(spark, d):
    return pairing.match_all(*_sides(spark, d))


@query("pair_max_pairs", _SIDES_SQL + _ALL_SQL + " SELECT path1, path2, est_sim, exact_hash_match FROM u ORDER BY est_sim DESC, exact_hash_match DESC, path1, rank LIMIT 50")
def pair_max_pairs(spark, d):
    return pairing.match_all(*_sides(spark, d), max_pairs=50)


@query("blocking_rules", _SIDES_SQL + f" SELECT l.extension AS extension, count(*) AS pairs, count(*) FILTER ({_NEAR_SQL}) AS allowed FROM l JOIN r ON l.extension = r.extension GROUP BY 1")
def blocking_rules(spark, d):
    f = _over(spark, d, FILES.format(half="doc_id div 2")).select("doc_id", F.col("size").cast("long").alias("size"), "extension")
    return pairing.block_counts(f.where("doc_id % 2 = 0"), f.where("doc_id % 2 = 1"))


# ---- normalisation and detection -------------------------------------------------------

_NORMS = {
    "trailing_ws": (Normalization(ignore_trailing_ws=True), f"list_transform(l, lambda x: regexp_replace(x, '{WS}+$', ''))"),
    "all_ws": (Normalization(ignore_all_ws=True), f"list_transform(l, lambda x: trim(regexp_replace(x, '{WS}+', ' ', 'g')))"),
    "case": (Normalization(ignore_case=True), "list_transform(l, lambda x: lower(x))"),
    "empty_lines": (Normalization(skip_empty_lines=True), f"list_filter(l, lambda x: regexp_matches(x, '[^\\x09-\\x0d\\x{{85}}\\p{{Z}}]'))"),
}
for _n, (_opts, _sql) in _NORMS.items():
    @query(f"norm_{_n}", f"WITH p AS (SELECT doc_id, {_lines_sql('text')} AS l FROM documents WHERE text IS NOT NULL), q AS (SELECT doc_id, {_sql} AS l FROM p) SELECT doc_id, len(l) AS n, md5(array_to_string(l, chr(10))) AS digest FROM q")
    def _norm(spark, d, opts=_opts):
        x = _t(spark, d, "documents").where("text is not null").select("doc_id", normalize_lines(split_lines(F.col("text")), opts).alias("l"))
        return x.select("doc_id", F.size("l").cast("long").alias("n"), F.md5(F.array_join("l", "\n")).alias("digest"))


@query("norm_bytes", f"WITH p AS (SELECT conv_id, turn, {_lines_sql('text')} AS l FROM conversations WHERE text IS NOT NULL) SELECT conv_id, turn, len(l) AS n, array_to_string(l, chr(10)) AS text FROM p")
def norm_bytes(spark, d):
    """Turns as bytes, decoded again."""
    c = _t(spark, d, "conversations").where("text is not null")
    x = c.select("conv_id", "turn", split_lines(decode(F.encode("text", "UTF-8"))).alias("l"))
    return x.select("conv_id", "turn", F.size("l").cast("long").alias("n"), F.array_join("l", "\n").alias("text"))


@query("ignore_regex", f"WITH p AS (SELECT page_id, {_lines_sql('html')} AS l FROM pages WHERE html IS NOT NULL) SELECT page_id, array_to_string(list_transform(l, lambda x: regexp_replace(lower(x), '[0-9]+|</?[a-z]+>', '<IGNORED>', 'g')), chr(10)) AS text FROM p")
def ignore_regex(spark, d):
    """The filter sees lines after they are lower-cased."""
    p = _t(spark, d, "pages").where("html is not null")
    lines = text_lines(F.col("html"), Normalization(ignore_case=True), "[0-9]+|</?[a-z]+>")
    return p.select("page_id", F.array_join(filter_lines(lines, None), "\n").alias("text"))


@query("detect_type", f"WITH f AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), g AS (SELECT doc_id, {_sniff_sql(_FIRST, chr(39) + ',' + chr(39))} AS c, {_sniff_sql(_FIRST, 'chr(9)')} AS t FROM f) SELECT doc_id, CASE WHEN c IS NOT NULL THEN 'Csv' WHEN t IS NOT NULL THEN 'Tsv' ELSE 'Text' END AS file_type, coalesce(c, t) AS columns FROM g")
def detect_type(spark, d):
    x = _t(spark, d, "documents").select("doc_id", detect(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), F.lit("txt")).alias("k"))
    return x.select("doc_id", "k.file_type", "k.columns")


@query("sniff_header", f"SELECT conv_id, turn, list_transform(string_split(text, ','), lambda x: {_TRIM.replace('{x}', 'x')}) AS header, ({_sniff_sql('text', chr(39) + ',' + chr(39))}) IS NOT NULL AS sniffed FROM conversations WHERE contains(text, ',')")
def sniff_header(spark, d):
    """The turns with a comma, read as headers."""
    c = _t(spark, d, "conversations")
    return c.select("conv_id", "turn", parse_header(F.col("text"), ",").alias("header"), sniff(F.col("text"), ",").isNotNull().alias("sniffed")).where("header is not null")


# ---- results ---------------------------------------------------------------------------

_RESULTS = """SELECT CASE WHEN doc_id % 11 = 0 THEN 'Error' WHEN doc_id % 7 = 0 THEN 'HashOnly' WHEN doc_id % 5 = 0 THEN 'Structured' ELSE 'Text' END AS type, concat('id', doc_id) AS linked_id,
concat('left/', doc_id) AS file1_path, concat('right/', doc_id) AS file2_path,
CASE WHEN doc_id % 11 = 0 THEN CAST(0 AS DOUBLE) WHEN doc_id % 7 = 0 THEN CAST(doc_id % 2 AS DOUBLE) ELSE CAST(n_chars % 1000 AS DOUBLE) / 1000 END AS similarity_score,
CASE WHEN doc_id % 11 = 0 THEN false WHEN doc_id % 7 = 0 THEN doc_id % 2 = 1 ELSE n_chars % 3 = 0 END AS identical,
n_chars AS n1, n_chars + 3 AS n2, n_chars - 1 AS same, 1 AS o1, 4 AS o2, source AS error FROM documents"""


def _results(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("type")

    def only(kind: str, c: str):
        return F.when(t == kind, F.col(c))

    return results.conform(_over(spark, d, _RESULTS).select(
        "type", "linked_id", "file1_path", "file2_path", "similarity_score", "identical", only("Text", "n1").alias("file1_line_count"), only("Text", "n2").alias("file2_line_count"),
        only("Text", "same").alias("common_lines"), F.when(t.isin("Text", "Structured"), F.col("o1")).alias("only_in_file1"), F.when(t.isin("Text", "Structured"), F.col("o2")).alias("only_in_file2"),
        only("Structured", "n1").alias("file1_row_count"), only("Structured", "n2").alias("file2_row_count"), only("Structured", "same").alias("common_records"),
        only("Structured", "n1").alias("total_field_mismatches"), only("HashOnly", "n1").alias("file1_size"), only("HashOnly", "n2").alias("file2_size"), only("Error", "error").alias("error"),
    ))


@query("summary", f"""SELECT CAST(7 AS BIGINT) AS total_files_set1, CAST(9 AS BIGINT) AS total_files_set2, count(*) AS pairs_compared, count(*) FILTER (type <> 'Error' AND identical) AS identical_pairs,
count(*) FILTER (type <> 'Error' AND NOT identical) AS different_pairs, count(*) FILTER (type = 'Error') AS error_pairs, round(coalesce(avg(similarity_score) FILTER (type <> 'Error'), 0), 6) AS average_similarity,
coalesce(min(similarity_score) FILTER (type <> 'Error'), 0) AS min_similarity, coalesce(max(similarity_score) FILTER (type <> 'Error'), 0) AS max_similarity FROM ({_RESULTS})""")
def summary(spark, d):
    return results.summarize(_results(spark, d), 7, 9).withColumn("average_similarity", F.round("average_similarity", 6))


@query("status_groups", f"""WITH s AS (SELECT CASE WHEN type = 'Error' THEN 'error' WHEN identical THEN 'identical' ELSE 'modified' END AS status FROM ({_RESULTS}))
SELECT status, count(*) AS pairs, CAST(round(100 * count(*) / (SELECT count(*) FROM s)) AS BIGINT) AS percent FROM s GROUP BY status""")
def status_groups(spark, d):
    return results.by_status(_results(spark, d))


@query("most_different", f"SELECT file1_path, file2_path, similarity_score FROM ({_RESULTS}) WHERE type <> 'Error' AND NOT identical ORDER BY similarity_score, file1_path, file2_path LIMIT 15")
def most_different(spark, d):
    """A report of the 15 least similar pairs."""
    return results.most_different(_results(spark, d), 15).select("file1_path", "file2_path", "similarity_score")


@query("csv_summary", f"""SELECT CASE WHEN type = 'Error' THEN '' ELSE linked_id END AS linked_id, file1_path, file2_path, CASE type WHEN 'HashOnly' THEN 'binary' ELSE lower(type) END AS type,
printf('%.4f', similarity_score) AS similarity_score, CAST(identical AS VARCHAR) AS identical, CASE WHEN type = 'Error' THEN '' ELSE CAST(n1 AS VARCHAR) END AS file1_count, CASE WHEN type = 'Error' THEN '' ELSE CAST(n2 AS VARCHAR) END AS file2_count,
CASE type WHEN 'Error' THEN '' WHEN 'HashOnly' THEN CAST(CAST(identical AS INTEGER) AS VARCHAR) ELSE CAST(same AS VARCHAR) END AS common, CASE type WHEN 'Error' THEN '' WHEN 'HashOnly' THEN '0' ELSE CAST(o1 AS VARCHAR) END AS only_in_file1,
CASE type WHEN 'Error' THEN '' WHEN 'HashOnly' THEN '0' ELSE CAST(o2 AS VARCHAR) END AS only_in_file2,
CASE type WHEN 'Error' THEN error WHEN 'HashOnly' THEN CAST(CAST(NOT identical AS INTEGER) AS VARCHAR) WHEN 'Structured' THEN CAST(n1 AS VARCHAR) ELSE CAST(o1 + o2 AS VARCHAR) END AS total_mismatches FROM ({_RESULTS})""")
def csv_summary(spark, d):
    return results.flat(_results(spark, d))

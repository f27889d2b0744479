import random

import pytest

from pairloom.config import Config
from pairloom.operators.structured import RecordDiff


def merge_loop(a, b):
    """(both, only left, only right, mismatching pairs) of two lists of (key, value) by a merge of sorted sides."""
    a, b = sorted(a), sorted(b)
    i = j = both = left = right = wrong = 0
    while i < len(a) and j < len(b):
        if a[i][0] == b[j][0]:
            both, wrong, i, j = both + 1, wrong + (a[i][1] != b[j][1]), i + 1, j + 1
        elif a[i][0] < b[j][0]:
            left, i = left + 1, i + 1
        else:
            right, j = right + 1, j + 1
    return both, left + len(a) - i, right + len(b) - j, wrong


def frame(spark, rows, schema="id string, v string"):
    return spark.createDataFrame(rows, schema)


def test_merge_of_three_keys(spark):
    c = RecordDiff(frame(spark, [("a", "1"), ("c", "1"), ("e", "1")]), frame(spark, [("b", "1"), ("c", "1"), ("d", "1")])).counts.first()
    assert (c.common, c.only1, c.only2, c.similarity) == (1, 2, 2, 1 / 5)


@pytest.mark.parametrize("seed", range(4))
def test_same_as_a_merge_loop(spark, seed):
    rng = random.Random(seed)
    a, b = ([(rng.choice("pqrs"), rng.choice("xyz")) for _ in range(rng.randrange(30))] for _ in "ab")
    c = RecordDiff(frame(spark, a), frame(spark, b), Config(key_columns=("id",), numeric_tolerance=0)).counts.first()
    assert (c.common, c.only1, c.only2, c.mismatches) == merge_loop(a, b)


def test_empty_null_and_odd_names(spark):
    none = frame(spark, [])
    c = RecordDiff(none, none).counts.first()
    assert c.identical and c.similarity == 1.0 and c.mismatches == 0
    assert RecordDiff(none, none).result().first().field_mismatches == []
    a, b = frame(spark, [(None, None), ("", "x")], "_key string, _rn string"), frame(spark, [("", ""), (None, "x")], "_key string, _rn string")
    assert RecordDiff(a, b).counts.first().identical
    with pytest.warns(UserWarning):
        assert RecordDiff(a, b, Config(key_columns=("nope",))).counts.first().common == 2


def test_composite_keys(spark):
    a, b = frame(spark, [("a|b", "c")], "k1 string, k2 string"), frame(spark, [("a", "b|c")], "k1 string, k2 string")
    assert RecordDiff(a, b, Config(key_columns=("k1", "k2"))).counts.first().common == 0
    assert RecordDiff(a, b, Config(key_columns=("k1", "k2"), compat_key=True)).counts.first().common == 1


def test_result_layout(spark):
    a = frame(spark, [(str(i), "1", "l") for i in range(9)], "id string, v string, only_l string")
    b = frame(spark, [(str(i), "2" if i < 7 else "1", "r") for i in range(8)], "id string, v string, only_r string")
    r = RecordDiff(a, b, Config(key_columns=("id",))).result("x:y", "p1", "p2").first()
    assert (r.file1_row_count, r.file2_row_count, r.common_records, r.only_in_file1, r.only_in_file2, r.total_field_mismatches) == (9, 8, 8, 1, 0, 7)
    assert [(m.column_name, m.mismatch_count, [s.key for s in m.sample_mismatches]) for m in r.field_mismatches] == [("v", 7, list("01234"))]
    assert (r.columns_only_in_file1, r.columns_only_in_file2, r.common_columns, r.identical) == (["only_l"], ["only_r"], ["id", "v"], False)


def test_one_shuffle_a_side(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        d = RecordDiff(frame(spark, [("a", "1")]), frame(spark, [("a", "2")]), Config(key_columns=("id",)))
        plan = d.pairs._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")

"""Steps whose work or memory grew faster than the tables, or with all of a file."""

import os
import random
import time
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairloom.config import Config
from pairloom.functions import fingerprint, sequence
from pairloom.operators import measures, pairing
from pairloom.operators.structured import RecordDiff
from pairloom.plans import folder_queries, queries
from pairloom.sources import files

D = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(D), reason="the tables aren't here")


def peak(f):
    tracemalloc.start()
    try:
        out = f()
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_blocks_are_counted_without_pairs(spark):
    """150,000 files on either side are 22.5 billion pairs."""
    def files(n, k):
        return spark.range(n).select((F.col("id") * k % 997 - 2).alias("size"), F.when(F.col("id") % 3 == 0, "txt").when(F.col("id") % 3 == 1, "md").otherwise("py").alias("extension"))

    l, r = files(400, 7), files(300, 13)
    g = pairing.extension_group
    j = l.withColumn("g", g(F.col("extension"))).join(r.select(F.col("size").alias("size2"), g(F.col("extension")).alias("g")), "g")
    want = j.groupBy("extension").agg(F.count("*").alias("pairs"), F.count_if(pairing.sizes_compatible(F.col("size"), F.col("size2"))).alias("allowed"))
    assert sorted(pairing.block_counts(l, r).collect()) == sorted(want.collect())
    began = time.time()
    got = pairing.block_counts(files(150_000, 7), files(150_000, 13)).collect()
    assert sum(x.pairs for x in got) == 100_000**2 + 50_000**2 and time.time() - began < 60


def test_votes_take_the_memory_of_a_slice():
    """The hashes of a large file were taken apart all at once, 64 bytes each."""
    h = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 1 << 19)
    rows = pa.array([h, None, [], [3, 5, 1]], pa.list_(pa.int64()))
    got, most = peak(lambda: fingerprint._majority(rows, pa.array([64] * 4)))
    want = sum(1 << i for i in range(63) if 2 * int((h >> i & 1).sum()) > len(h)) - (2**63 if 2 * int((h < 0).sum()) > len(h) else 0)
    assert got.to_pylist() == [want, 0, 0, 1] and most < 8 << 20


@tables
def test_tables_are_written_as_they_come(spark):
    """A group's rows were one pandas table, and then a list of lists."""
    assert "pandas" not in folder_queries._tables.__code__.co_names
    left, right = folder_queries._tables(spark, D)
    names = sorted(os.listdir(left))
    assert names == sorted(os.listdir(right)) == sorted(f"part {g}.csv" for g in range(folder_queries.GROUPS))
    n = spark.read.parquet(f"{D}/orders.parquet").count()
    assert sum(sum(1 for _ in open(f"{left}/{x}")) - 1 for x in names) == n


def test_a_file_is_held_once(tmp_path):
    (tmp_path / "x").write_bytes(b"ab" * (8 << 20))
    (_, kept, size), most = peak(lambda: files._hash_and_bytes(str(tmp_path / "x"), 1 << 30))
    assert size == len(kept) == 16 << 20 and most < 24 << 20 and files._one(kept)[0].as_py() == bytes(kept)
    assert files._hash_and_bytes(str(tmp_path / "x"), 1 << 20)[1] is None


def test_small_files_share_a_batch(tmp_path):
    """each file and pair was a batch of its own."""
    for k in range(50):
        (tmp_path / f"{k}.txt").write_bytes(b"x" * k)
    (tmp_path / "large.txt").write_bytes(b"y" * (files.BATCH + 1))
    found = files.list_files(str(tmp_path)) + [(str(tmp_path / "none"), "none")]
    out = list(files._read(iter([pa.record_batch([pa.array(x) for x in zip(*found)], ["path", "rel_path"])])))
    rows = [r for b in out for r in b.to_pylist()]
    assert len(out) <= 3 and [(r["path"], r["rel_path"]) for r in rows] == found and rows[-1]["error"].startswith("FileNotFoundError")
    assert all(r["content"] == open(r["path"], "rb").read() and r["size"] == len(r["content"]) for r in rows[:-1])


@tables
def test_one_file_needs_one_folder(spark):
    """both folders were written, of which one is read."""
    left, right = folder_queries._documents(spark, D, second=False)
    assert len(files.list_files(left)) == spark.read.parquet(f"{D}/documents.parquet").count() and not files.list_files(right)


@pytest.mark.parametrize("measure", ["cosine", "tfidf", "sorensen-dice"])
def test_bags_stay_in_their_row(spark, monkeypatch, measure):
    """Tokens were rows that moved, were sorted and spilled."""
    r = random.Random(4)
    text = lambda: " ".join(r.choices(["a", "B", "b", "é", "\U0001f600", "ab", "abab", "\n"], k=r.choice((0, 1, 3, 40))))
    rows = [(k, text(), text()) for k in range(60)]
    df = measures.bag_sums(spark.createDataFrame(rows, "id long, a string, b string"), ["id"], "a", "b", measures.TOKENS[measure])
    assert "Exchange" not in plan(df)
    for got in df.collect():
        _, a, b = rows[got.id]
        bags = [Counter(t.lower().split()) if measure != "sorensen-dice" else Counter(zip(s, s[1:])) if (s := "".join(t.split())) else Counter() for t in (a, b)]
        x, y = bags
        assert (got.t1, got.t2, got.least, got.dot) == (x.total(), y.total(), (x & y).total(), sum(x[t] * y[t] for t in x))
        assert (got.sq1, got.sq2) == tuple(sum(v * v for v in z.values()) for z in bags)
        assert (got.shared1, got.shared2) == (sum(v * v for t, v in x.items() if t in y), sum(v * v for t, v in y.items() if t in x))


@tables
def test_documents_are_fingerprinted_once(spark):
    """both sides of the join hashed every shingle, twice each."""
    assert "md5" not in plan(queries.fp_hamming(spark, D))


def test_no_column_moves_twice(spark):
    """the columns that order rows of equal key were copies of the cells."""
    df = spark.createDataFrame([("a|b", "c", "x", 1), ("a", "b|c", "y", 2), ("a", "b|c", "y", 3)], "k1 string, k2 string, v string, w long")
    for compat, more in ((False, 0), (True, 2)):
        d = RecordDiff(df, df.where("w <> 2"), Config(key_columns=("k1", "k2"), compat_key=compat))
        assert plan(d._side(df, "a")).count(" AS _o") == more
        assert d.counts.first().common == 2 and d.counts.first().mismatches == (3 if compat else 1)


def test_lines_are_read_a_pair_at_a_time():
    """all pairs of a batch were lists of text at once."""
    a = pa.array([[f"{k} {i} some words of a line" for i in range(400)] for k in range(150)])
    got, most = peak(lambda: sequence._each(sequence.lcs_length)(a, a))
    assert got.to_pylist() == [400.0] * 150 and most < 1 << 20


def test_jaro_matches_as_a_queue_does():
    """matches are found for all characters together; against one at a time."""
    def plainly(a, b, reach):
        used, x = [False] * len(b), []
        for i, c in enumerate(a):
            for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
                if not used[j] and b[j] == c:
                    used[j] = True
                    x.append(c)
                    break
        return x, [c for c, u in zip(b, used) if u]

    r = random.Random(6)
    for _ in range(300):
        a, b = ("".join(r.choices("abc\U0001f600"[: r.choice((1, 2, 4))], k=r.choice((1, 2, 7, 40)))) for _ in range(2))
        reach = r.choice((0, 1, 5, 19))
        assert [[chr(c) for c in x] for x in sequence._matched(a, b, reach)] == list(plainly(a, b, reach))

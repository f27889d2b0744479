"""Record diffs of two tables: key-matched, duplicate-aware, with a numeric tolerance.

Rows of equal key pair one to one in order, so a key that occurs three times on the left
and twice on the right has two pairs and one row left over. This is a full outer join on
(key, ordinal). Both sides are spread by the key alone, once; the ordinal is numbered and
the join is made within that spread.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, functions as F, Window

from ..config import Config
from ..functions.values import values_equal

SAMPLES = 5


@dataclass(frozen=True)
class Schemas:
    """Columns of both sides, of one only, and the keys, all sorted; ignored ones are left out."""

    common: list[str]
    only1: list[str]
    only2: list[str]
    keys: list[str]
    compared: list[str]


def schemas(left: DataFrame, right: DataFrame, cfg: Config = Config()) -> Schemas:
    l, r = set(left.columns) - set(cfg.ignore_columns), set(right.columns) - set(cfg.ignore_columns)
    keys = list(cfg.key_columns)
    if not keys and left.columns:
        keys = [left.columns[0]]
    common = sorted(l & r)
    return Schemas(common, sorted(l - r), sorted(r - l), keys, [c for c in common if c not in cfg.key_columns])


def as_text(df: DataFrame, c: str) -> Column:
    """A cell as the text that is compared; null is the empty string."""
    return F.coalesce(df[c].cast("string"), F.lit(""))


def _present(df: DataFrame, keys: list[str]) -> list[Column]:
    have = [as_text(df, k) for k in keys if k in df.columns]
    if not have:
        warnings.warn(f"no key column of {', '.join(keys) or 'none'} exists: rows pair by position", stacklevel=3)
    return have


class RecordDiff:
    """The diff of two DataFrames, as DataFrames.

    ``order`` gives the columns that order rows of equal key; where None, all of a row's
    columns as text do, so that the result hangs on the rows alone. Cells are compared as
    text, or as numbers within ``cfg.numeric_tolerance``; null equals the empty string.
    Empty tables are equal. Columns named ``_k*``, ``_key`` or ``_rn`` may occur.

    Sets the session's ``spark.sql.requireAllClusterKeysForCoPartition`` to false, so that
    the join on (key, ordinal) keeps the spread by key that the ordinals were numbered in.
    """

    def __init__(self, left: DataFrame, right: DataFrame, cfg: Config = Config(), order: list[str] | None = None):
        self.cfg, self.schemas = cfg, schemas(left, right, cfg)
        self._left, self._right, self._order = left, right, order
        left.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")

    def _side(self, df: DataFrame, side: str) -> DataFrame:
        s = self.schemas
        parts = _present(df, s.keys)
        key = F.concat_ws("|", *parts) if parts else F.lit("")
        # by default the parts are compared one by one; joined, ("a|b", "c") would meet ("a", "b|c")
        ids = [key] if self.cfg.compat_key or not parts else parts
        names = [f"_k{i}" for i in range(len(ids))]
        held = {c: f"_{side}{i}" for i, c in enumerate(s.compared)}
        cells = [as_text(df, c).alias(x) for c, x in held.items()]
        # what orders rows of equal key: of columns that are cells no second copy moves, and parts of
        # the key are equal among them unless they are joined
        more, by = {}, []
        for c in [c for c in self._order if c in df.columns] if self._order is not None else sorted(df.columns):
            if self._order is None and c in held:
                by.append(held[c])
            elif self._order is not None or self.cfg.compat_key or c not in s.keys:
                more[f"_o{len(more)}"] = F.col(c) if self._order is not None else as_text(df, c)
                by.append(f"_o{len(more) - 1}")
        rank = F.row_number().over(Window.partitionBy(*names).orderBy(*by or [F.lit(0)]))
        rows = df.select(*[c.alias(n) for c, n in zip(ids, names)], key.alias(f"_key{side}"), *cells, *[c.alias(n) for n, c in more.items()])
        return rows.withColumn("_rn", rank).drop(*more)

    @cached_property
    def pairs(self) -> DataFrame:
        """One row per pair or left-over row: side (``both``, ``left``, ``right``), _key, _rn,
        and the compared cells of both sides as _a<i> and _b<i>."""
        a, b = self._side(self._left, "a"), self._side(self._right, "b")
        on = [c for c in a.columns if c.startswith("_k") and not c.startswith("_key")]
        if on != [c for c in b.columns if c.startswith("_k") and not c.startswith("_key")]:
            raise ValueError("the sides have different key columns")
        j = a.join(b, [*on, "_rn"], "full")
        side = F.when(F.col("_keyb").isNull(), "left").when(F.col("_keya").isNull(), "right").otherwise("both")
        return j.withColumn("side", side).withColumn("_key", F.coalesce("_keya", "_keyb"))

    def _unequal(self, i: int) -> Column:
        return (F.col("side") == "both") & ~values_equal(F.col(f"_a{i}"), F.col(f"_b{i}"), self.cfg.numeric_tolerance)

    @cached_property
    def counts(self) -> DataFrame:
        """One row: rows1, rows2, common, only1, only2, mismatches, similarity, identical.
        Mismatching fields don't lower the similarity."""
        def n(s):
            return F.count_if(F.col("side") == s)

        wrong = reduce(lambda x, y: x + y, [self._unequal(i).cast("long") for i in range(len(self.schemas.compared))], F.lit(0).cast("long"))
        c = self.pairs.agg(n("both").alias("common"), n("left").alias("only1"), n("right").alias("only2"), F.coalesce(F.sum(wrong), F.lit(0)).alias("mismatches"))
        every = F.col("common") + F.col("only1") + F.col("only2")
        return c.select(
            (F.col("common") + F.col("only1")).alias("rows1"), (F.col("common") + F.col("only2")).alias("rows2"),
            "common", "only1", "only2", "mismatches",
            F.when(every > 0, F.col("common") / every).otherwise(1.0).alias("similarity"),
            ((F.col("only1") == 0) & (F.col("only2") == 0) & (F.col("mismatches") == 0)).alias("identical"),
        )

    @cached_property
    def mismatches(self) -> DataFrame:
        """(column_name, key, _rn, value1, value2) of every unequal cell of a pair."""
        cells = F.array(*[
            F.when(self._unequal(i), F.struct(F.lit(c).alias("column_name"), F.col(f"_a{i}").alias("value1"), F.col(f"_b{i}").alias("value2")))
            for i, c in enumerate(self.schemas.compared)
        ]) if self.schemas.compared else F.expr("cast(array() as array<struct<column_name string, value1 string, value2 string>>)")
        x = self.pairs.select("_key", "_rn", F.explode(F.filter(cells, lambda c: c.isNotNull())).alias("x"))
        return x.select("x.column_name", F.col("_key").alias("key"), "_rn", "x.value1", "x.value2")

    @cached_property
    def column_mismatches(self) -> DataFrame:
        """(column_name, mismatch_count) of the columns with any."""
        return self.mismatches.groupBy("column_name").agg(F.count("*").alias("mismatch_count"))

    def samples(self, n: int = SAMPLES) -> DataFrame:
        """(column_name, nth, key, value1, value2): the first mismatches of each column in
        key order. The rank limit applies before the shuffle, so n rows a task move."""
        w = Window.partitionBy("column_name").orderBy("key", "_rn", "value1", "value2")
        return self.mismatches.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n).select("column_name", "nth", "key", "value1", "value2")

    def only(self, side: str) -> DataFrame:
        """(key, nth) of the rows of ``left`` or ``right`` without a partner."""
        return self.pairs.where(F.col("side") == side).select(F.col("_key").alias("key"), F.col("_rn").cast("long").alias("nth"))

    def result(self, linked_id: str = "", path1: str = "", path2: str = "") -> DataFrame:
        """One row in the layout of a structured comparison result."""
        s = self.schemas
        named = self.samples().groupBy("column_name").agg(
            F.array_sort(F.collect_list(F.struct("nth", "key", "value1", "value2"))).alias("x")
        ).select("column_name", F.transform("x", lambda e: F.struct(e["key"].alias("key"), e["value1"].alias("value1"), e["value2"].alias("value2"))).alias("sample_mismatches"))
        fields = self.column_mismatches.join(named, "column_name").agg(
            F.array_sort(F.collect_list(F.struct("column_name", "mismatch_count", "sample_mismatches"))).alias("field_mismatches")
        )
        names = lambda cols: F.array(*map(F.lit, cols)).cast("array<string>")
        return self.counts.crossJoin(fields).select(  # one row each
            F.lit(linked_id).alias("linked_id"), F.lit(path1).alias("file1_path"), F.lit(path2).alias("file2_path"),
            F.col("rows1").alias("file1_row_count"), F.col("rows2").alias("file2_row_count"), F.col("common").alias("common_records"),
            F.col("only1").alias("only_in_file1"), F.col("only2").alias("only_in_file2"), F.col("similarity").alias("similarity_score"),
            "field_mismatches", F.col("mismatches").alias("total_field_mismatches"),
            names(s.only1).alias("columns_only_in_file1"), names(s.only2).alias("columns_only_in_file2"), names(s.common).alias("common_columns"), "identical",
        )

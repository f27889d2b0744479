"""Normalisation of text to lines, as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from ..config import Normalization

IGNORED = "<IGNORED>"
WORDS = r"(?U)\s+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once however often ``body`` names it: functions
    within lambdas aren't shared by the compiler."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def split_lines(text: Column) -> Column:
    """Lines without their ends: a line feed, or carriage return and line feed. A final
    end begins no further line; a bare carriage return ends none."""
    lines = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n", -1)
    return let(lines, lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, 1, F.size(x) - 1)).otherwise(x))


def normalize_lines(lines: Column, opts: Normalization = Normalization()) -> Column:
    """Trailing white space, all white space, case, empty lines: in this order."""
    if opts.ignore_trailing_ws:
        lines = F.transform(lines, lambda x: F.regexp_replace(x, r"(?U)\s+$", ""))
    if opts.ignore_all_ws:
        lines = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, WORDS, " ")))
    if opts.ignore_case:
        lines = F.transform(lines, F.lower)
    if opts.skip_empty_lines:
        lines = F.filter(lines, lambda x: x.rlike(r"(?U)\S"))
    return lines


def filter_lines(lines: Column, pattern: str | None) -> Column:
    """Every match of an already checked pattern becomes a marker."""
    return lines if pattern is None else F.transform(lines, lambda x: F.regexp_replace(x, pattern, IGNORED))


def text_lines(text: Column, opts: Normalization = Normalization(), pattern: str | None = None) -> Column:
    return filter_lines(normalize_lines(split_lines(text), opts), pattern)


def decode(content: Column) -> Column:
    """Binary to text, invalid UTF-8 replaced."""
    return F.make_valid_utf8(content.cast("string"))


def words(text: Column) -> Column:
    """Runs of characters other than white space, lower-cased."""
    return F.filter(F.split(F.lower(text), WORDS, -1), lambda x: x != "")

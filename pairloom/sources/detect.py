"""Type of a file from its bytes and extension, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SHEETS = ("xlsx", "xls", "xlsm", "xlsb", "xla", "xlam", "ods")
HEAD = 8192
LONGEST_NAME = 100
EDGES = r"(?U)^\s+|\s+$"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, EDGES, "")


def _no_columns() -> Column:
    return F.lit(None).cast("array<string>")


def parse_header(line: Column, delimiter: str) -> Column:
    """Trimmed parts of a header, null under two; quotes mean nothing."""
    parts = F.split(line, F.lit("\t" if delimiter == "\t" else delimiter), -1)
    return F.when(F.size(parts) >= 2, F.transform(parts, trimmed)).otherwise(_no_columns())


def sniff(line: Column, delimiter: str) -> Column:
    """``parse_header`` if every part could name a column: not blank, under 100 bytes."""
    parts = parse_header(line, delimiter)
    return F.when(F.forall(parts, lambda p: (p != "") & (F.octet_length(p) < LONGEST_NAME)), parts)


def extension(path: Column) -> Column:
    """Lower-cased, without its dot; a name that only begins with a dot has none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def head(content: Column) -> Column:
    """The whole lines that begin within the first 8 KiB, as unchecked text."""
    first = F.substring(content, 1, HEAD).cast("string")
    rest = F.substring(content, HEAD + 1, 2**31 - 1).cast("string")
    return F.when((F.octet_length(content) <= HEAD) | first.endswith("\n"), first).otherwise(F.concat(first, F.substring_index(rest, "\n", 1)))


def detect(content: Column, ext: Column) -> Column:
    """struct(file_type, line_count, columns) of a file that is no spreadsheet.

    Binary: a null character or invalid UTF-8 in the head. A csv, tsv or tab extension
    needs a header of two parts; any other text is a table when its first line could be
    a header, by commas or else by tabs. line_count counts the header; 0 for binary.
    """
    top = head(content)
    text = content.cast("string")
    first = trimmed(F.substring_index(top, "\n", 1))
    breaks = F.octet_length(content) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    lines = (breaks + F.when((F.octet_length(content) > 0) & ~text.endswith("\n"), 1).otherwise(0)).cast("long")
    by_ext = F.when(ext == "csv", parse_header(first, ",")).when(ext.isin("tsv", "tab"), parse_header(first, "\t"))
    comma, tab = sniff(first, ","), sniff(first, "\t")

    def found(kind: str, columns: Column, n: Column = lines) -> Column:
        return F.struct(F.lit(kind).alias("file_type"), n.alias("line_count"), columns.alias("columns"))

    return (
        F.when(top.contains("\0") | ~F.is_valid_utf8(top), found("Binary", _no_columns(), F.lit(0).cast("long")))
        .when((ext == "csv") & by_ext.isNotNull(), found("Csv", by_ext))
        .when(by_ext.isNotNull(), found("Tsv", by_ext))
        .when((first != "") & comma.isNotNull(), found("Csv", comma))
        .when((first != "") & tab.isNotNull(), found("Tsv", tab))
        .otherwise(found("Text", _no_columns()))
    )


def is_structured(file_type: Column) -> Column:
    return file_type.isin("Csv", "Tsv", "Excel")

"""Files and folders as DataFrames: listing, bytes, fingerprints, records."""

from __future__ import annotations

import csv
import fnmatch
import hashlib
import io
import os
import re
import warnings
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..config import Config
from ..functions.fingerprint import schema_signature, shingles, simhash
from ..functions.normalize import decode, normalize_lines, split_lines
from .detect import SHEETS, base_name, detect, extension
from .spreadsheet import read_sheet

LARGEST = 2**31 - 2**24  # bytes of one value in a DataFrame
BATCH = 1 << 22  # bytes of files that are sent together; a larger one goes alone
FOUND = "path string, rel_path string"
READ = f"{FOUND}, size long, content_hash string, content binary, sheet_columns array<string>, sheet_rows long, error string"
META = ("path", "rel_path", "name", "size", "file_type", "extension", "content_hash", "simhash", "schema_signature", "line_count", "columns", "error")


def exclusions(patterns: Iterable[str]) -> list[re.Pattern]:
    """Compiled globs; one that can't be compiled is left out with a warning."""
    out = []
    for p in patterns:
        try:
            if p.count("[") > p.count("]"):
                raise re.error("a bracket isn't closed")
            out.append(re.compile(fnmatch.translate(p)))
        except re.error as e:
            warnings.warn(f"exclusion {p!r} is left out: {e}", stacklevel=2)
    return out


def list_files(root: str, patterns: Iterable[str] = ()) -> list[tuple[str, str]]:
    """(path, path below the root), sorted. A file is listed whatever the exclusions; in a
    folder they match whole paths and names, and an excluded folder isn't entered. Links
    aren't followed; hidden files count; what can't be read is left out."""
    if os.path.isfile(root):
        return [(root, os.path.basename(root))]
    if not os.path.isdir(root):
        raise FileNotFoundError(f"no such file or folder: {root}")
    bad = exclusions(patterns)

    def out(path: str) -> bool:
        return any(b.match(path) or b.match(os.path.basename(path)) for b in bad)

    found = []
    if out(root):
        return found
    left = [(root, "")]
    while left:
        folder, below = left.pop()
        try:
            entries = list(os.scandir(folder))
        except OSError:
            continue
        for e in entries:
            path = os.path.join(folder, e.name)
            if bad and out(path):
                continue
            if e.is_dir(follow_symlinks=False):
                left.append((path, below + e.name + "/"))
            elif e.is_file(follow_symlinks=False):
                found.append((path, below + e.name))
    return sorted(found)


def _hash_and_bytes(path: str, limit: int) -> tuple[str, bytearray | None, int]:
    h, kept, size = hashlib.sha256(), bytearray(), 0
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            h.update(part)
            size += len(part)
            if size > limit:
                kept = None
            elif kept is not None:
                kept += part
    return h.hexdigest(), kept, size


def _one(content: bytearray | None) -> pa.Array:
    """An array of the one value, which isn't copied."""
    if content is None:
        return pa.nulls(1, pa.binary())
    return pa.Array.from_buffers(pa.binary(), 1, [None, pa.array([0, len(content)], pa.int32()).buffers()[1], pa.py_buffer(content)])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in READ.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.string()), pa.int64(), pa.string()]
    rows, size = [], 0

    def emit() -> pa.RecordBatch:
        cells = [list(x) for x in zip(*rows)]
        rows.clear()
        content = _one(cells[4][0]) if len(cells[4]) == 1 else pa.array(cells[4], pa.binary())
        return pa.record_batch([content if c == "content" else pa.array(x, t) for c, x, t in zip(names, cells, kinds)], names)

    for b in batches:
        for path, rel in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            row = [path, rel, 0, "", None, None, None, None]
            try:
                row[3], row[4], row[2] = _hash_and_bytes(path, LARGEST)
                if path.lower().rpartition(".")[2] in SHEETS:
                    sheet = read_sheet(bytes(row[4] or b""), path.rpartition(".")[2])
                    row[5], row[6] = [c.strip() for c in sheet[0]] if sheet else None, max(0, len(sheet) - 1)
            except Exception as e:  # a row of the result: one bad file must not end the run
                row[7] = f"{type(e).__name__}: {e}"
            if rows and size + row[2] > BATCH:  # so many bytes a batch, or one file
                yield emit()
                size = 0
            rows.append(row)
            size += row[2] + 256
    if rows:
        yield emit()


def read_files(spark: SparkSession, root: str, patterns: Iterable[str] = ()) -> DataFrame:
    """Every file with its bytes, streamed hash, and header and rows of a spreadsheet.

    A root with a scheme (hdfs, s3a ...) is read by Spark's binary source, which skips
    hidden names; any other is a folder that the executors share. Content over 2 GiB is
    hashed but not kept.
    """
    if "://" in root and not root.startswith("file://"):
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        bad = exclusions(patterns)
        at = F.regexp_replace("path", "^" + re.escape(root.rstrip("/")) + "/?", "")
        rows = raw.select("path", at.alias("rel_path"), F.col("length").alias("size"), F.sha2("content", 256).alias("content_hash"), "content")
        for b in bad:
            rx = b.pattern.replace(r"(?s:", "(?s:").replace(r"\Z", r"\z")
            rows = rows.where(~F.col("path").rlike("^" + rx) & ~F.exists(F.split("rel_path", "/"), lambda x: x.rlike("^" + rx)))
        return rows.select("*", F.lit(None).cast("array<string>").alias("sheet_columns"), F.lit(None).cast("long").alias("sheet_rows"), F.lit(None).cast("string").alias("error"))
    found = list_files(root.removeprefix("file://"), patterns)
    columns = list(zip(*found)) or [(), ()]
    paths = spark.createDataFrame(pa.table([pa.array(x, pa.string()) for x in columns], [c.split()[0] for c in FOUND.split(", ")]), FOUND)
    n = max(1, min(len(found), 4 * spark.sparkContext.defaultParallelism))
    return paths.repartition(n, "path").mapInArrow(_read, READ)


def fingerprinted(files: DataFrame, cfg: Config = Config()) -> DataFrame:
    """The files with type, schema and similarity fingerprint, without their bytes.

    Text and tables have a SimHash of their normalised lines up to the size limit of
    ``cfg``; tables and spreadsheets a signature of their columns. The bytes stay in the
    scan: what is aggregated are votes, folded per file before they move.
    """
    typed = files.withColumn("extension", extension(F.col("path"))).withColumn("name", base_name(F.col("path")))
    content = F.coalesce("content", F.lit(b""))
    kind = F.when(F.col("extension").isin(*SHEETS), F.struct(F.lit("Excel").alias("file_type"), F.coalesce("sheet_rows", F.lit(0).cast("long")).alias("line_count"), F.col("sheet_columns").alias("columns")))
    kind = kind.when(F.col("content").isNull(), F.struct(F.lit("Binary").alias("file_type"), F.lit(0).cast("long").alias("line_count"), F.lit(None).cast("array<string>").alias("columns")))
    typed = typed.withColumn("k", kind.otherwise(detect(content, F.col("extension"))))
    hashed = F.col("k.file_type").isin("Text", "Csv", "Tsv") & (F.col("size") <= cfg.fingerprint_limit)
    lines = normalize_lines(split_lines(decode(content)), cfg.normalization)
    signed = F.when(F.col("k.file_type").isin("Csv", "Tsv", "Excel") & F.col("k.columns").isNotNull(), schema_signature(F.col("k.columns")))
    small = typed.select(
        "path", "rel_path", "name", "size", F.col("k.file_type").alias("file_type"), "extension", "content_hash",
        signed.alias("schema_signature"), F.col("k.line_count").alias("line_count"), F.col("k.columns").alias("columns"), "error",
        F.when(hashed, shingles(lines)).alias("_grams"), hashed.alias("_hashed"),
    )
    keep = [c for c in small.columns if c not in ("_grams", "_hashed")]
    out = simhash(small, [*keep, "_hashed"], F.col("_grams"))
    return out.withColumn("simhash", F.when(F.col("_hashed"), F.col("simhash"))).select(*META)


def with_contents(pairs: DataFrame) -> DataFrame:
    """The pairs with content1 and content2 of path1 and path2 and read_error: what went
    wrong, or null. A file beyond 2 GiB is an error."""
    i, j = pairs.columns.index("path1"), pairs.columns.index("path2")

    def run(batches):
        def emit(b, first, held):
            cells = [[x[k] for x in held] for k in range(3)]
            contents = [_one(x[0]) if len(x) == 1 else pa.array(x, pa.binary()) for x in cells[:2]]
            return pa.record_batch(
                [*(c.slice(first, len(held)) for c in b.columns), *contents, pa.array(cells[2], pa.string())],
                [*b.schema.names, "content1", "content2", "read_error"],
            )

        for b in batches:
            first, held, size = 0, [], 0
            for k in range(len(b)):
                got, error = [None, None], None
                try:
                    for n, at in enumerate((i, j)):
                        path = b.column(at)[k].as_py()
                        if os.path.getsize(path) > LARGEST:
                            raise ValueError(f"{path} is too large to compare as text")
                        with open(path, "rb") as f:
                            got[n] = f.read()
                except Exception as e:  # becomes the result of the pair
                    got, error = [None, None], f"{type(e).__name__}: {e}"
                more = 256 + sum(len(x or b"") for x in got)
                if held and size + more > BATCH:  # so many bytes a batch, or one pair
                    yield emit(b, first, held)
                    first, held, size = k, [], 0
                held.append((*got, error))
                size += more
            if held:
                yield emit(b, first, held)

    schema = StructType(list(pairs.schema.fields))
    for name, kind in (("content1", "binary"), ("content2", "binary"), ("read_error", "string")):
        schema = schema.add(name, kind)
    return pairs.mapInArrow(run, schema)


RECORDS = "path string, ord long, cells array<string>, error string"


def read_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, file_type) to records: ord 0 is the header; a failure is a row with an error
    and no cells. Fields beyond the header can't be reached by name and stay."""
    def batch(path, rows, first, error=None):
        n = len(rows) or 1
        return pa.record_batch(
            [pa.array([path] * n), pa.array(range(first, first + n), pa.int64()), pa.array(rows or [None], pa.list_(pa.string())), pa.array([error] * n, pa.string())],
            ["path", "ord", "cells", "error"],
        )

    for b in batches:
        for path, kind in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            try:
                if kind == "Excel":
                    with open(path, "rb") as f:
                        rows = iter(read_sheet(f.read(), path.rpartition(".")[2]))
                elif kind in ("Csv", "Tsv"):
                    csv.field_size_limit(1 << 30)
                    f = io.TextIOWrapper(open(path, "rb"), "utf-8", errors="replace", newline="")
                    rows = (r for r in csv.reader(f, delimiter="\t" if kind == "Tsv" else ",") if r)
                else:
                    raise ValueError(f"{path} is no table")
                held, first = [], 0
                for r in rows:
                    held.append(r)
                    if len(held) == 4096:
                        yield batch(path, held, first)
                        held, first = [], first + len(held)
                if held:
                    yield batch(path, held, first)
            except Exception as e:  # becomes the result of the pair
                yield batch(path, [], -1, f"{type(e).__name__}: {e}")


def table_records(files: DataFrame) -> DataFrame:
    """Records of the files, given as (path, file_type), each read by one task in a stream."""
    return files.select("path", "file_type").mapInArrow(read_records, RECORDS)


def read_table(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """A CSV or TSV file of any size as a DataFrame of text, with _ord in file order.

    Missing fields are empty; header names that repeat get their position appended, but
    for the last, which keeps the name.
    """
    raw = spark.read.csv(path, sep=delimiter, header=True, inferSchema=False, quote='"', escape='"', multiLine=True, mode="PERMISSIVE")
    return raw.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in raw.columns], F.monotonically_increasing_id().alias("_ord"))

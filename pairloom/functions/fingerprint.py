"""Content hashes, SimHash over shingles, schema signatures, estimates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType

from .normalize import WORDS, let

BITS = 64


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def short_hash(h: Column) -> Column:
    return F.substring(h, 1, 16)


def linked_id(h1: Column, h2: Column) -> Column:
    return F.concat(short_hash(h1), F.lit(":"), short_hash(h2))


def schema_signature(columns: Column) -> Column:
    """The same for any order of the columns."""
    return short_hash(F.sha2(F.array_join(F.array_sort(columns), "|"), 256))


def windows(items: Column, n: int, sep: str) -> Column:
    """Every run of n neighbours, joined; none where there are fewer. ``items`` should be
    bound (a column or a lambda's variable): it is named 2n times."""
    out = items
    for k in range(1, n):
        shifted = F.when(F.size(items) > k, F.slice(items, k + 1, F.size(items))).otherwise(F.array().cast("array<string>"))
        out = F.zip_with(out, shifted, lambda x, y: F.concat(x, F.lit(sep), y))
    return F.filter(out, lambda x: x.isNotNull())


def shingles(lines: Column, n: int = 3) -> Column:
    """Word n-grams across lines (all words as one where there are fewer) and, from n
    lines on, line n-grams; a multiset."""
    def both(x: Column) -> Column:
        found = F.filter(F.split(F.array_join(x, "\n"), WORDS, -1), lambda w: w != "")
        few = lambda w: F.when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))
        return F.concat(let(found, lambda w: F.when(F.size(w) >= n, windows(w, n, " ")).otherwise(few(w))), windows(x, n, "\n"))

    return let(lines, both)


def md5_32(s: Column) -> Column:
    """The first 32 bits of MD5: a hash that other engines have as well."""
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("long")


_VOTES = 1 << 14  # hashes taken apart at once


def _majority(hashes: pa.Array, bits: pa.Array) -> pa.Array:
    """For each row the bits that more than half of its hashes have. Hashes are taken apart a slice
    at a time, so that memory is that of the batch."""
    out = np.zeros(len(hashes), np.int64)
    edges = hashes.offsets.to_numpy()
    values = hashes.values.to_numpy(zero_copy_only=False).astype("<i8", copy=False)
    n, known = bits.to_numpy(zero_copy_only=False), hashes.is_valid().to_numpy(zero_copy_only=False)
    for i in np.flatnonzero(known & (edges[1:] > edges[:-1])):
        h = values[edges[i] : edges[i + 1]]
        votes = np.zeros(BITS, np.int64)
        for k in range(0, len(h), _VOTES):
            votes += np.unpackbits(np.ascontiguousarray(h[k : k + _VOTES]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        won = 2 * votes > len(h)
        won[n[i] :] = False
        out[i] = np.packbits(won, bitorder="little").view("<i8")[0]
    return pa.array(out)


def simhash_of(grams: Column, hash_of=F.xxhash64, bits: int = BITS) -> Column:
    """The SimHash of an array of strings, a multiset: each bit by majority of its hashes, ties
    give 0, as do empty and null arrays. A map of the row: nothing is moved."""
    return F.arrow_udf(_majority, LongType())(F.transform(grams, lambda g: hash_of(g)), F.lit(bits))


def _counted(hashes: pa.Array, bits: pa.Array) -> pa.Array:
    n = pa.array(np.diff(hashes.offsets.to_numpy()).astype(np.int64))
    return pa.StructArray.from_arrays([n, _majority(hashes, bits)], ["n", "simhash"])


def simhash_counted(grams: Column, hash_of=F.xxhash64, bits: int = BITS) -> Column:
    """struct(n, simhash): the number of strings as well, for which they aren't made once more."""
    return F.arrow_udf(_counted, "n long, simhash long")(F.transform(grams, lambda g: hash_of(g)), F.lit(bits))


def simhash(df: DataFrame, keys: list[str], grams: Column, name: str = "simhash", hash_of=F.xxhash64, bits: int = BITS) -> DataFrame:
    """(keys, name): ``simhash_of`` of every row."""
    return df.select(*keys, simhash_of(grams, hash_of, bits).alias(name))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def simhash_similarity(a: Column, b: Column) -> Column:
    return 1 - hamming(a, b) / BITS


def estimate_similarity(l: str, r: str) -> Column:
    """Equal hashes, else fingerprints, else equal schemas, else sizes; ``l`` and ``r``
    are the prefixes of the two files' columns."""
    def c(p, n):
        return F.col(f"{p}{n}")

    sized = (c(l, "size") > 0) & (c(r, "size") > 0)
    return (
        F.when(c(l, "content_hash") == c(r, "content_hash"), F.lit(1.0))
        .when(c(l, "simhash").isNotNull() & c(r, "simhash").isNotNull(), simhash_similarity(c(l, "simhash"), c(r, "simhash")))
        .when(c(l, "schema_signature") == c(r, "schema_signature"), F.lit(0.5))
        .when(sized, 0.3 * F.least(c(l, "size"), c(r, "size")) / F.greatest(c(l, "size"), c(r, "size")))
        .otherwise(F.lit(0.0))
    )

"""Similarity of pairs of texts by bags and positions, in Catalyst expressions.

A table of pairs has key columns and two texts. Measures over sets of tokens are a map of
each pair, and so are those over bags: the tokens of a pair are counted within its row to
whole-number sums, from which each score is one closed formula. Measures that hang on order beyond position are in functions.sequence.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.distance import damerau_udf, levenshtein_udf
from ..functions.normalize import let, words
from ..functions.sequence import jaro_winkler_udf, lcs_length_udf, ngram_udf, smith_waterman_udf

ALONE = 1 + math.log(2)  # idf of a token that one of two texts has; a shared one's is 1


def ratio(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double"), den.cast("double"))


def levenshtein(a: Column, b: Column) -> Column:
    """1 - distance / longer length, in characters; two empty texts are equal."""
    top = F.greatest(F.length(a), F.length(b))
    return F.when(top > 0, 1 - F.levenshtein(a, b) / top).otherwise(1.0)


def text_levenshtein(a: Column, b: Column) -> Column:
    """The same for long texts, 64 characters at a time."""
    top = F.greatest(F.length(a), F.length(b))
    return F.when(top > 0, 1 - levenshtein_udf(a, b) / top).otherwise(1.0)


def damerau(a: Column, b: Column) -> Column:
    top = F.greatest(F.length(a), F.length(b))
    return F.when(top > 0, 1 - damerau_udf(a, b) / top).otherwise(1.0)


def jaro_winkler(a: Column, b: Column) -> Column:
    return jaro_winkler_udf(a, b)


def hamming(a: Column, b: Column) -> Column:
    """Equal lines at the same place over the longer side."""
    top = F.greatest(F.size(a), F.size(b))
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), lambda x: x))
    return F.when(top > 0, same / top).otherwise(1.0)


def line_common(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of lines."""
    return lcs_length_udf(a, b).cast("long")


def smith_waterman(a: Column, b: Column) -> Column:
    return smith_waterman_udf(a, b)


def squeezed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


#: measure -> tokens of a text; of None, all runs of two characters
TOKENS = {"jaccard": words, "cosine": words, "tfidf": words, "sorensen-dice": None}
SETS = ("jaccard", "ngram")  # by windows of bytes, with numpy
SUMS = ("t1", "t2", "least", "dot", "sq1", "sq2", "shared1", "shared2")
SLICE = 1 << 19  # tokens that are counted at once, or one pair's


def _char_pairs(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return c[:-1] << np.uint64(21) | c[1:]


def _sums(keys: list[np.ndarray], shift: int, rows: int) -> list[np.ndarray]:
    """SUMS of each row from the tokens of both sides, as keys (row << shift) | token."""
    (k1, n1), (k2, n2) = (np.unique(k, return_counts=True) for k in keys)
    _, i, j = np.intersect1d(k1, k2, assume_unique=True, return_indices=True)

    def by_row(k: np.ndarray, n: np.ndarray) -> np.ndarray:
        row = (k >> np.uint64(shift)).astype(np.int64)
        run = np.append(0, np.cumsum(n))
        edges = np.searchsorted(row, np.arange(rows + 1))
        return run[edges[1:]] - run[edges[:-1]]

    k, l, r = k1[i], n1[i], n2[j]
    return [by_row(k1, n1), by_row(k2, n2), by_row(k, np.minimum(l, r)), by_row(k, l * r), by_row(k1, n1 * n1), by_row(k2, n2 * n2), by_row(k, l * l), by_row(k, r * r)]


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    i = 0
    ends = np.cumsum(sizes)
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + SLICE, side="right")))
        yield i, j
        i = j


def _bags(a: pa.Array, b: pa.Array) -> pa.Array:
    """Lists of tokens, or texts for their character pairs, to structs of SUMS; no nulls."""
    lists = pa.types.is_list(a.type)
    size = pc.list_value_length if lists else pc.binary_length
    out = []
    for i, j in _slices(np.add(*(size(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b)))):
        one, two = a[i:j], b[i:j]
        if lists:
            counts = [pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in (one, two)]
            code = pa.chunked_array([x.flatten() for x in (one, two)]).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.uint64)
            tokens, shift = np.split(code, [int(counts[0].sum())]), 32
        else:
            each = [[_char_pairs(t) for t in x.to_pylist()] for x in (one, two)]
            counts = [np.array([len(t) for t in x]) for x in each]
            tokens, shift = [np.concatenate(x) for x in each], 42
        keys = [np.repeat(np.arange(j - i, dtype=np.uint64), n) << np.uint64(shift) | t for n, t in zip(counts, tokens)]
        out.append(_sums(keys, shift, j - i))
    sums = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * len(SUMS)
    return pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in sums], SUMS)


def bag_sums(pairs: DataFrame, keys: list[str], a: str, b: str, tokens) -> DataFrame:
    """keys, q1, q2 (characters without white space), same_q (these are equal), and over the bags
    of tokens: t1, t2 tokens, least the shared multiset, dot, sq1, sq2 squares, shared1,
    shared2 squares of shared tokens. A map of each pair: no token leaves its row."""
    texts = [squeezed(F.col(x)) for x in (a, b)]
    bags = texts if tokens is None else [tokens(F.col(x)) for x in (a, b)]
    found = F.arrow_udf(_bags, ", ".join(f"{c} long" for c in SUMS))(*bags)
    x = pairs.select(*keys, F.length(texts[0]).alias("q1"), F.length(texts[1]).alias("q2"), (texts[0] == texts[1]).alias("same_q"), found.alias("x"))
    return x.select(*keys, "q1", "q2", "same_q", "x.*")


def _cosine(dot: Column, x: Column, y: Column) -> Column:
    return F.when((x == 0) & (y == 0), 1.0).when((x == 0) | (y == 0), 0.0).otherwise(F.least(F.lit(1.0), dot / (F.sqrt(x) * F.sqrt(y))))


def bag_score(measure: str) -> Column:
    """The score of ``measure`` from the sums of its bags."""
    c = F.col
    if measure == "cosine":
        return _cosine(c("dot").cast("double"), c("sq1").cast("double"), c("sq2").cast("double"))
    if measure == "tfidf":
        def norm(sq, sh):
            return c(sh).cast("double") + ALONE * ALONE * (c(sq) - c(sh)).cast("double")

        return _cosine(c("dot").cast("double"), norm("sq1", "shared1"), norm("sq2", "shared2"))
    if measure == "sorensen-dice":
        return F.when(c("same_q"), 1.0).when((c("q1") < 2) | (c("q2") < 2), 0.0).otherwise(2 * c("least") / F.when(c("t1") + c("t2") > 0, c("t1") + c("t2")))
    raise ValueError(f"{measure} isn't a measure over bags")


def set_score(measure: str, a: Column, b: Column) -> Column:
    """Shared over all distinct tokens of two texts, by hashing within the row."""
    if measure == "ngram":
        return ngram_udf(a, b)
    sets = [F.array_distinct(TOKENS[measure](x)) for x in (a, b)]

    def score(x: Column) -> Column:
        both = F.size(F.array_intersect(x["l"], x["r"]))
        union = F.size(x["l"]) + F.size(x["r"]) - both
        return F.when(union > 0, both / F.when(union > 0, union)).otherwise(1.0)

    return let(F.struct(sets[0].alias("l"), sets[1].alias("r")), score)


def bag_similarity(pairs: DataFrame, keys: list[str], a: str, b: str, measure: str, name: str = "score") -> DataFrame:
    """keys and the score of each pair of texts; keys must be unique, null texts are empty.

    jaccard, cosine and tfidf compare lower-cased words, ngram byte windows of three,
    sorensen-dice multisets of character pairs without white space. Two empty texts
    score 1, an empty one against another 0.
    """
    clean = pairs.select(*keys, F.coalesce(a, F.lit("")).alias(a), F.coalesce(b, F.lit("")).alias(b))
    if measure in SETS:
        return clean.select(*keys, set_score(measure, F.col(a), F.col(b)).alias(name))
    return bag_sums(clean, keys, a, b, TOKENS[measure]).select(*keys, bag_score(measure).alias(name))

"""Settings of a comparison and their validation."""

from __future__ import annotations

import os
import re
import warnings
from dataclasses import dataclass, field, replace
from pathlib import Path

MODES = ("auto", "text", "structured")
PAIRINGS = ("same-path", "same-name", "all-vs-all")
ALGORITHMS = (
    "diff", "char-jaro", "levenshtein", "damerau-levenshtein", "sorensen-dice", "jaccard", "cosine",
    "ratcliff-obershelp", "smith-waterman", "lcs", "hamming", "ngram", "tfidf",
)
_ALIASES = {"n-gram": "ngram", "tf-idf": "tfidf", "jaro": "char-jaro", "damerau": "damerau-levenshtein", "dice": "sorensen-dice"}
MAX_REGEX, MAX_PATH, MAX_TOPK = 1000, 4096, 100
_BLOCKED_ROOTS = ("/proc", "/sys", "/dev", "/etc", "/boot")


@dataclass(frozen=True)
class Normalization:
    """How lines are made equal before they are compared. ``ignore_eol`` changes nothing:
    lines never hold their line ends."""

    ignore_eol: bool = True
    ignore_trailing_ws: bool = False
    ignore_all_ws: bool = False
    ignore_case: bool = False
    skip_empty_lines: bool = False


@dataclass(frozen=True)
class Config:
    mode: str = "auto"
    pairing: str = "all-vs-all"
    topk: int = 3
    max_pairs: int | None = None
    key_columns: tuple[str, ...] = ()
    numeric_tolerance: float = 0.0001
    algorithm: str = "diff"
    normalization: Normalization = field(default_factory=Normalization)
    max_diff_bytes: int = 1024 * 1024
    exclude: tuple[str, ...] = ()
    ignore_columns: tuple[str, ...] = ()
    ignore_regex: str | None = None
    out_jsonl: str | None = None
    out_csv: str | None = None
    out_dir: str | None = None
    results_base: str = "results"
    output_root: str | None = None
    max_fingerprint_size: int | None = None
    compat_key: bool = False  # join key parts with "|" instead of comparing them one by one
    verbose: bool = False

    def __post_init__(self):
        object.__setattr__(self, "algorithm", algorithm_name(self.algorithm))
        for name, allowed in (("mode", MODES), ("pairing", PAIRINGS), ("algorithm", ALGORITHMS)):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}")
        if self.topk < 1:
            raise ValueError("topk must be at least 1")

    def clamped(self) -> "Config":
        """The settings as an untrusted caller gets them: tolerance in [0, 1], topk bounded."""
        return replace(
            self, numeric_tolerance=min(1.0, max(0.0, self.numeric_tolerance)), topk=min(MAX_TOPK, max(1, self.topk)),
            ignore_regex=self.ignore_regex if self.ignore_regex is None or len(self.ignore_regex) <= MAX_REGEX else None,
        )

    @property
    def fingerprint_limit(self) -> int:
        """Bytes above which a file gets no similarity fingerprint."""
        if self.max_fingerprint_size is not None:
            return self.max_fingerprint_size
        memory = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
        return min(memory // 20, 2 * 1024**3)


def algorithm_name(name: str) -> str:
    low = name.lower().replace("_", "-")
    return _ALIASES.get(low, low)


_POSIX = {
    "alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "punct": r"\p{Punct}", "space": r"\s",
    "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "graph": r"\p{Graph}", "print": r"\p{Print}", "xdigit": r"\p{XDigit}", "word": r"\w", "ascii": r"\p{ASCII}",
}


def java_pattern(pattern: str) -> str:
    """``pattern`` in the syntax of Java: named groups and POSIX classes rewritten. Raises
    ValueError on what automata can't match: look-around, back references, atomic groups and
    possessive repeats."""
    out, i, inside = [], 0, 0
    while i < len(pattern):
        rest = pattern[i:]
        if rest[0] == "\\" and len(rest) > 1:
            if not inside and (rest[1] in "123456789" or rest[1] == "k"):
                raise ValueError("back references aren't supported")
            m = re.match(r"\\[pPx]\{[^}]*\}|\\.", rest, re.S)
            out.append(m[0])
            i += len(m[0])
            continue
        if inside and (m := re.match(r"\[:(\^?)(\w+):\]", rest)):
            if m[2] not in _POSIX:
                raise ValueError(f"no such class: {m[2]}")
            name = _POSIX[m[2]]
            out.append(name.swapcase() if m[1] and len(name) == 2 else name.replace(r"\p", r"\P") if m[1] else name)
            i += len(m[0])
            continue
        if rest[0] == "[":
            m = re.match(r"\[\^?\]?", rest)
            out.append(m[0].replace("]", r"\]"))
            inside, i = inside + 1, i + len(m[0])
            continue
        if rest[0] == "]" and inside:
            inside -= 1
        elif not inside:
            if re.match(r"\(\?(=|!|<=|<!|>)", rest):
                raise ValueError("look-around and atomic groups aren't supported")
            if rest.startswith("(?P<"):
                out.append("(?<")
                i += 4
                continue
            if re.match(r"[*+?}]\+", rest):
                raise ValueError("possessive repeats aren't supported")
        out.append(rest[0])
        i += 1
    return "".join(out)


def line_filter(pattern: str | None) -> str | None:
    """``pattern`` as Spark runs it if it can be used as a line filter, else None with a
    warning. It is compiled by the engine that will run it, where a session is active."""
    if not pattern:
        return None
    problem, java = "too long" if len(pattern) > MAX_REGEX else None, pattern
    if problem is None:
        try:
            java = java_pattern(pattern)
            _compile(java)
        except Exception as e:  # of either engine
            problem = str(e).splitlines()[0]
    if problem:
        warnings.warn(f"line filter {pattern[:40]!r} is skipped: {problem}", stacklevel=2)
        return None
    return java


def _compile(pattern: str) -> None:
    from pyspark import SparkContext

    sc = SparkContext._active_spark_context
    if sc is not None:
        sc._jvm.java.util.regex.Pattern.compile(pattern)
    else:
        re.compile(pattern.replace("(?<", "(?P<"))


def checked_path(path: str) -> str:
    """Canonical path of an existing, permitted file or folder; ValueError otherwise."""
    if not path or len(path) > MAX_PATH or "\0" in path:
        raise ValueError("the path is empty, too long or holds a null character")
    real = Path(path).resolve()
    if not real.exists():
        raise ValueError(f"no such path: {path}")
    if any(real == Path(r) or Path(r) in real.parents for r in _BLOCKED_ROOTS):
        raise ValueError(f"not permitted: {path}")
    return str(real)

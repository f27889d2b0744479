"""Command line: ``python -m pairloom compare LEFT RIGHT`` and ``python -m pairloom report``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .config import ALGORITHMS, MODES, PAIRINGS, Config, Normalization, algorithm_name, checked_path
from .plans import report, results, sinks
from .plans.compare import compare


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pairloom", description="Finds how two files or folders differ.")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("compare")
    c.add_argument("path1")
    c.add_argument("path2")
    c.add_argument("-m", "--mode", choices=MODES, default="auto")
    c.add_argument("--pairing", choices=PAIRINGS, default="all-vs-all")
    c.add_argument("--topk", type=int, default=3)
    c.add_argument("--max-pairs", type=int)
    c.add_argument("-k", "--key", action="append", default=[], help="key column; commas or repeated options give several")
    c.add_argument("--numeric-tol", type=float, default=0.0001)
    c.add_argument("--similarity", type=algorithm_name, choices=ALGORITHMS, default="diff")
    for flag in ("--ignore-eol", "--ignore-trailing-ws", "--ignore-all-ws", "--ignore-case", "--skip-empty-lines"):
        c.add_argument(flag, action="store_true")
    c.add_argument("--max-diff-bytes", type=int, default=1048576)
    c.add_argument("--max-fingerprint-size", type=int)
    c.add_argument("--exclude", action="append", default=[])
    c.add_argument("--ignore-columns", action="append", default=[])
    c.add_argument("--ignore-regex")
    c.add_argument("--out-jsonl")
    c.add_argument("--out-csv")
    c.add_argument("--out-dir")
    c.add_argument("-B", "--results-base", default="output")
    c.add_argument("-o", "--output")
    c.add_argument("-v", "--verbose", action="store_true")
    r = sub.add_parser("report")
    r.add_argument("-i", "--input", required=True)
    r.add_argument("--html", default="report.html")
    r.add_argument("--artifacts")
    return p


def _list(values: list[str]) -> tuple[str, ...]:
    return tuple(x for v in values for x in v.split(",") if x)


def config_of(a: argparse.Namespace) -> Config:
    norm = Normalization(a.ignore_eol, a.ignore_trailing_ws, a.ignore_all_ws, a.ignore_case, a.skip_empty_lines)
    return Config(
        a.mode, a.pairing, a.topk, a.max_pairs, _list(a.key), a.numeric_tol, a.similarity, norm, a.max_diff_bytes, tuple(a.exclude), _list(a.ignore_columns),
        a.ignore_regex, a.out_jsonl, a.out_csv, a.out_dir, a.results_base, a.output, a.max_fingerprint_size, verbose=a.verbose,
    )


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("pairloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    if a.command == "report":
        loaded = sinks.load_jsonl(spark, a.input)
        report.write_html(loaded, results.summarize(loaded).first().asDict(), a.html, a.artifacts)
        return 0
    cfg = config_of(a)
    done = compare(spark, checked_path(a.path1), checked_path(a.path2), cfg, print if cfg.verbose else None)
    to = sinks.save(done, cfg)
    print(report.terminal(done.results, done.stats, cfg.verbose))
    print(f"\nwritten to {to}")
    return 0

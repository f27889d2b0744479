"""Nulls, empty and long texts, ties, repeats, empty tables and clashing columns, for every operator and stage."""

import pytest

import corpus_pipeline
from pairloom.llm import decontaminate, fixity, mixing, neardup, quality, resharding, rules, suffixtree, templates, urls


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "plain words here"), (1, "other words there"), (2, None), (None, "x y z"), (3, "")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 0), (6, 0, None), (7, None, 0), (99, 1, 0), (None, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")


OPS = {
    "op2": lambda d, b, l: mixing.sample(d),
    "op4": lambda d, b, l: decontaminate.contaminated(d, b),
    "op5": lambda d, b, l: templates.drop_recurring(d),
    "op6": lambda d, b, l: neardup.groups(d),
    "op7": lambda d, b, l: resharding.reshard(d),
    "op8": lambda d, b, l: suffixtree.score(d),
    "op9": lambda d, b, l: rules.ledger(d, l),
    "ablation": lambda d, b, l: rules.ablation(rules.ledger(d, l)),
    "op10": lambda d, b, l: quality.score(d, l),
    "keep_good": lambda d, b, l: quality.keep_good(d, l),
    "drop_duplicates": lambda d, b, l: neardup.drop_duplicates(d),
    "drop_contaminated": lambda d, b, l: decontaminate.drop_contaminated(d, b),
    "mix": lambda d, b, l: mixing.mix(d),
}
ROWS = {"op2": 9, "op4": 2, "op5": 10, "op6": 1, "op7": 10, "op8": 10, "op9": 10, "op10": 10, "drop_duplicates": 8, "drop_contaminated": 7}


@pytest.mark.parametrize("name", OPS)
def test_awkward_rows(awkward, benchmark, labels, name):
    out = OPS[name](awkward, benchmark, labels)
    rows = out.collect()
    if name in ROWS:
        assert len(rows) == ROWS[name]
    if name in ("keep_good", "drop_duplicates", "drop_contaminated", "mix"):
        assert out.columns == awkward.columns
    if name == "op6":
        assert [tuple(r) for r in rows] == [(7, 1)]
    if name == "op4":
        assert {(r.doc_id, r.item_id, r.score) for r in rows} == {(1, 1, 1.0), (7, 1, 1.0)}
    if name == "op8":
        assert all((r.n_words == 0) == (r.bits_per_word is None) for r in rows)
    if name == "op5":
        assert all(r.dropped == [] for r in rows) and sum(r.text is None for r in rows) == 2


@pytest.mark.parametrize("name", OPS)
def test_empty_tables(awkward, benchmark, labels, name):
    assert OPS[name](awkward.limit(0), benchmark, labels).count() == 0
    out = OPS[name](awkward, benchmark.limit(0), labels.limit(0))
    assert out.count() >= 0 and (name != "op4" or out.count() == 0)


def test_pages(spark):
    schema = "page_id long, url string, html string, leaf string"
    rows = [(1, "http://a.example/x", "<p>", "c"), (1, "http://a.example/x", "<p>", "c"), (2, None, "<p>", "c"), (3, "http://b.example/", None, "c"), (None, "http://c.example", "", "c"), (4, "", "", None), (-5, "x", "y" * 200_000, "c")]
    pages = spark.createDataFrame(rows, schema)
    assert urls.decisions(pages).count() == 6
    assert urls.decisions(pages.limit(0)).count() == 0
    assert fixity.audit(pages, pages).count() == 0
    assert fixity.audit(pages.limit(0), pages.limit(0)).count() == 0
    gone = fixity.audit(pages, pages.where("page_id <> 3 or page_id is null"))
    assert [(r.height, r.page_id, r.status) for r in gone.orderBy("height").collect()][0] == (0, 3, "missing")
    assert {r.status for r in fixity.audit(pages.limit(0), pages).collect()} == {"extra"}


@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, awkward, benchmark, labels, tmp_path, empty):
    core = awkward.select("doc_id", "text", "lang", "source", "n_chars")
    core = core.limit(0) if empty else core
    for name, df in (("documents", core), ("benchmark", benchmark), ("labels", labels)):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        assert k == 4 or docs.columns == core.columns
    assert {"old_shard", "new_shard", "moved"} <= set(docs.columns)
    assert not empty or docs.count() == 0

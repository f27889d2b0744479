"""Whole operators, and the pipeline, against the plain versions in brute.py or results written by hand."""

import random
from collections import Counter

import brute
import pytest
from conftest_llm import WORDS, prose
from pyspark.sql import functions as F

import corpus_pipeline
from pairloom.llm import decontaminate, mixing, neardup, quality, resharding, templates, urls

LABELS = "doc_id long, quality int, toxic int"
PAGES = "page_id long, url string, html string"


def hashes(spark, ids):
    df = spark.createDataFrame([(i,) for i in ids], "i long")
    return {r.i: r.h for r in df.select("i", F.xxhash64("i").alias("h")).collect()}


def junk(rng):
    return " ".join(rng.choice(WORDS) + rng.choice(["$$$", "###", "%%%"]) for _ in range(50))


# ---- 3


def verdicts(spark, rows):
    return {r.page_id: r.decision for r in urls.decisions(spark.createDataFrame(rows, PAGES)).collect()}


def test_links_are_resolved_against_their_page(spark):
    rows = [
        (1, "http://good.example.org/a/b.html", '<link rel="canonical" href="index2.html">'),
        (2, "http://cheap-pills.example.com/x", '<link rel="canonical" href="index2.html">'),
        (3, "http://alias1.example.org/dir/page?x=1", '<link rel=canonical href="?y=2">'),
        (4, "http://alias1.example.org/dir/page?y=2", '<link rel=canonical href="http://spam-farm.example.com/">'),
        (5, "http://alias2.example.org/a/b/c.html", '<link rel=canonical href="../../z/./y">'),
        (6, "http://alias2.example.org/z/y", "<link rel=canonical href='//adult-x.example.net/q'>"),
        (7, "https://alias3.example.org/p/", '<link rel=canonical href="/q?a=1&amp;b=2">'),
        (8, "https://alias3.example.org/q?a=1&b=2", '<meta http-equiv=refresh content="0;url=http://ads-track.example.com/">'),
        (9, "http://ok.example.org/", '<link rel="canonical" href="mailto:a@cheap-pills.example.com"><link rel="next" href="http://cheap-pills.example.com/">'),
        (10, "http://ok2.example.org/", '<link rel="canonical" href="#top"><a href="http://cheap-pills.example.com/" rel="canonical">'),
    ]
    assert verdicts(spark, rows) == {1: "pass", 2: "block", 3: "block", 4: "block", 5: "block", 6: "block", 7: "block", 8: "block", 9: "pass", 10: "pass"}


def test_tags_are_read_in_any_form(spark):
    rows = [
        (1, "http://a1.example.org/", "<LINK HREF=//cheap-pills.example.com/a REL='Canonical'>"),
        (2, "http://a2.example.org/", "<META CONTENT=\"5; URL='http://cheap-pills.example.com/b'\" HTTP-EQUIV=Refresh>"),
        (3, "http://a3.example.org/", '<link rel="canonical" href="http://a3.example.org/"><link\nrel="canonical"\nhref="http://cheap-pills.example.com/c">'),
        (4, "http://a4.example.org/", '<link rel="alternate canonical" href="http://cheap-pills.example.com/d">'),
        (5, "http://a5.example.org/", '<link data-rel="canonical" href="http://cheap-pills.example.com/e">'),
    ]
    assert verdicts(spark, rows) == {1: "block", 2: "block", 3: "block", 4: "block", 5: "pass"}


def test_lists_can_not_be_evaded(spark):
    rows = [
        (1, "HTTP://WWW.Cheap-Pills.Example.COM/q", ""), (2, "http://user:pw@cheap-pills.example.com/", ""), (3, "http://cheap-pills.example.com./", ""),
        (4, "http://free-bets.example.com:80/de/x", ""), (5, "https://free-bets.example.com:8443/de/y", ""), (6, "http://free-bets.example.com/fr", ""),
        (7, "http://free-bets.example.com/design", ""), (8, " http://cheap-pills.example.com:8080?x ", ""), (9, "http://example.org/cheap-pills.example.com", ""),
    ]
    assert verdicts(spark, rows) == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "block", 7: "block", 8: "block", 9: "pass"}


# ---- 4


def test_short_items_need_evidence(spark, documents, rng):
    docs = documents([(i, prose(rng, 60) + (" yes" if i % 2 else "")) for i in range(60)] + [(99, "before xylographic quetzals vermilion after")])
    bench = spark.createDataFrame([(1, "yes"), (2, "xylographic quetzals vermilion zugzwang"), (3, WORDS[0])], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench, decontaminate.Params(min_nats=15.0)).collect()} == {(99, 2)}
    assert decontaminate.drop_contaminated(docs, bench).count() >= 60


# ---- 5


def test_templates_against_plain_lines(documents):
    rng = random.Random(5)
    p = templates.Params(min_docs=3)
    pool = ["Read more about %s today in our paper", "Error %s at line 7 of module %s here", "Copyright 2020 %s", "%s", "alpha beta gamma %s delta %s zeta", "Posted by %s on %s 17 at noon"]
    fill = lambda t: t % tuple(rng.choice(WORDS) for _ in range(t.count("%s")))
    rows = [(i, "\n".join(fill(rng.choice(pool)) if rng.random() < 0.6 else prose(rng, rng.randrange(1, 9)) for _ in range(rng.randrange(1, 7)))) for i in range(200)]
    rows += [(500, "\n\n"), (501, ""), (502, "Copyright 1999 x\n" * 3)]
    want = brute.recurring_lines(rows, p)
    got = {r.doc_id: r for r in templates.drop_recurring(documents(rows), p).collect()}
    assert sum(map(len, want.values())) > 150
    for i, text in rows:
        assert got[i].dropped == sorted(want[i])
        assert got[i].text == "\n".join(x for k, x in enumerate(text.split("\n")) if k not in want[i])


# ---- 2


def test_sampling_against_singular_vectors(spark, documents, rng):
    rows = [(i, prose(rng, 5 + 3 * i + rng.randrange(3)), "abc"[i % 5 % 3]) for i in range(150)]
    p = mixing.Params()
    want, pi = brute.draw([(i, s, len(t.split())) for i, t, s in rows], hashes(spark, range(150)), p)
    got = mixing.sample(documents(rows), p).collect()
    assert {r.doc_id for r in got if r.selected} == want
    assert all(r.pi == pytest.approx(pi[r.source]) for r in got)
    assert {r.doc_id for r in mixing.mix(documents(rows), p).collect()} == want


def test_a_whole_budget_keeps_every_row(awkward):
    assert mixing.mix(awkward, mixing.Params(budget=1.0)).count() >= awkward.where("length(trim(text)) > 3").count()


# ---- 7


def test_names_never_clash(documents, rng):
    docs = documents([(i, prose(rng, 5), "ab"[i % 2]) for i in range(50)])
    for c in ("_s", "_b", "_c", "_shard", "_blocks", "_old", "_place", "block", "moved"):
        docs = docs.withColumn(c, F.lit("mine"))
    out = resharding.reshard(docs)
    assert set(docs.columns) <= set(out.columns) and out.where("_s = 'mine' and _c = 'mine' and _old = 'mine'").count() == 50
    assert out.columns.count("block") == 1 and out.schema["moved"].dataType.simpleString() == "boolean"


def test_the_plan_stays_small_and_capacities_hold(documents, rng):
    docs = documents([(i, prose(rng, 30), f"s{i % 4}") for i in range(2000)])
    total = docs.select(F.sum(F.octet_length("text"))).first()[0]
    caps = {"s0": 1000, "s1": total, "new": 5000}
    rows = resharding.reshard(docs, capacities=caps).collect()
    size = Counter()
    for r in rows:
        size[r.new_shard] += len(r.text.encode())
    assert all(size[s] <= caps[s] for s in size) and sum(size.values()) == total
    assert len({(r.old_shard, r.block) for r in rows}) <= 4 * 256 + 4
    with pytest.raises(ValueError):
        resharding.reshard(docs, capacities={"s0": total - 1})
    with pytest.raises(ValueError):
        resharding.reshard(docs, capacities={f"t{i}": total // 1500 for i in range(1501)})


# ---- 10


def test_scores_against_plain_updates(spark, documents, rng):
    rows = [(i, prose(rng, rng.randrange(10, 60)) + "." if i % 4 else junk(rng)) for i in range(80)] + [(90, ""), (91, "a a a a a"), (92, None)]
    labels = {i: int(i % 4 > 0) for i in range(0, 80, 2)}
    p = quality.Params(max_train=30)
    at = hashes(spark, labels)
    order = sorted(labels, key=lambda i: (at[i], i))[:30]
    want = brute.quality_scores(rows, labels, order, p)
    lab = spark.createDataFrame([(i, y, 0) for i, y in labels.items()], LABELS)
    got = {r.doc_id: r.score for r in quality.score(documents(rows), lab, p).collect()}
    assert [got[i] for i, _ in rows] == pytest.approx(want, abs=2e-6)


def test_without_labels_all_stay(spark, documents, rng):
    docs = documents([(i, prose(rng, 10)) for i in range(5)])
    assert quality.keep_good(docs, spark.createDataFrame([], LABELS)).count() == 5


# ---- the pipeline


def test_pipeline_against_plain_stages(spark, documents, tmp_path):
    rng = random.Random(21)
    many = lambda n: " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))
    items = [many(25) for _ in range(4)]
    rows = [(i, many(30 + rng.randrange(120)) + ".", f"s{i % 3 if i % 2 else 0}") for i in range(150)]
    rows += [(200 + i, " ".join(w + rng.choice(["$$$", "###", "%%%"]) for w in many(50).split()), "s1") for i in range(40)]
    for i in range(40):
        words = rows[rng.randrange(150)][1].split()
        words[rng.randrange(len(words))] = "edited"
        rows.append((300 + i, " ".join(words), "s2"))
    for i in range(12):
        item = items[i % 4].split()
        item[rng.randrange(len(item))] = many(1)
        rows.append((400 + i, many(40) + " " + " ".join(item) + " " + many(30), "s0"))
    docs = documents(rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = {i: int(not 200 <= i < 300) for i, *_ in rows if i % 2}
    spark.createDataFrame([(i, y, 0) for i, y in labels.items()], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    at = hashes(spark, labels)
    p = quality.Params()
    score = brute.quality_scores([r[:2] for r in rows], labels, sorted(labels, key=lambda i: (at[i], i))[: p.max_train], p)
    left = [r for r, s in zip(rows, score) if round(s, 6) >= p.threshold]
    assert 15 <= len(rows) - len(left) <= 60
    group = brute.classes({i: brute.fingerprint(t) for i, t, _ in left}, neardup.Params().max_distance)
    single = [r for r in left if group[r[0]] == r[0]]
    assert len(left) - len(single) >= 20
    hit = {i for i, _ in brute.leaks([r[:2] for r in single], list(enumerate(items)), decontaminate.Params())}
    clean = [r for r in single if r[0] not in hit]
    assert len(hit) >= 10
    want, _ = brute.draw([(i, s, len(t.split())) for i, t, s in clean], hashes(spark, [r[0] for r in clean]), mixing.Params())

    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out) == sorted(want)
    text, size, new = {i: t for i, t, _ in rows}, Counter(), Counter()
    for r in out:
        assert r.text == text[r.doc_id] and r.old_shard == r.source and r.moved == (r.old_shard != r.new_shard)
        size[r.old_shard] += len(r.text)
        new[r.new_shard] += len(r.text)
    room = sum(size.values()) / len(size) * 1.05 + 1
    assert max(new.values()) <= room + max(map(len, text.values()))
    must = sum(max(0, n - room) for n in size.values())
    assert must <= sum(len(r.text) for r in out if r.moved) <= must + 2 * max(map(len, text.values()))


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_on_awkward_rows(spark, awkward, tmp_path, empty):
    core = awkward.select("doc_id", "text", "lang", "source", "n_chars")
    (core.limit(0) if empty else core).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert not out if empty else len(out) > 0

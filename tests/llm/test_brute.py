"""Operators against brute force, exact properties or held-out labels."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import WORDS, prose

from pairloom.llm import decontaminate, fixity, mixing, neardup, quality, resharding, rules, suffixtree, templates, textops, urls
from pairloom.llm.plumbing import connected_components


def test_tokens_do_not_depend_on_their_neighbours():
    texts = ["Ab c1, ab!", "", None, "äß ab", "x" * 300_000 + " ab"]
    data, offsets = textops.buffers(pa.array(texts))
    tok = textops.tokenize(data, offsets)
    alone = np.concatenate([textops.words_of(t) for t in texts])
    assert (tok.hash == alone).all() and Counter(tok.doc.tolist()) == {0: 3, 3: 2, 4: 2}
    assert [(i, j) for i, j in textops.chunks(data, offsets)][-1] == (4, 5)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7), (None, 3)]
    label = {}
    for a, b in edges:
        if a is not None and a != b:
            label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(len(label)):
        for a, b in edges:
            if a in label and b in label:
                label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == label


# ---- 1

def test_fixity_locates_single_records(spark):
    rows = [(i * 3, f"http://x/{i}", f"<p>{i}") for i in range(3000)]
    bad = [(i, u, h + "!" if i == 4500 else h) for i, u, h in rows if i != 300]
    df = [spark.createDataFrame(r, "page_id long, url string, html string") for r in (rows, bad)]
    got = fixity.audit(*df).collect()
    assert {(r.page_id, r.status) for r in got if r.height == 0} == {(300, "missing"), (4500, "corrupt")}
    size = {i: len(u) + len(h) for i, u, h in rows}
    first = sum(n for i, n in size.items() if 4096 <= i < 4500)
    leaf = next(r for r in got if r.page_id == 4500)
    assert (leaf.first, leaf.past) == (first, first + size[4500])
    assert Counter(r.height for r in got) == {0: 2, 1: 2, 2: 2, 3: 2}


# ---- 2

def test_cube_balances_totals(spark, documents, rng):
    docs = documents([(i, prose(rng, rng.choice((3, 10, 40, 200))), f"s{i % 4 if i % 3 else 0}") for i in range(6000)])
    p = mixing.Params(block=256)
    rows = mixing.sample(docs, p).collect()
    assert len(rows) == 6000
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        want_n, want_t = sum(r.pi for r in own), sum(r.pi * r.n_tokens for r in own)
        assert abs(sum(r.selected for r in own) - want_n) <= 0.02 * want_n + 3
        assert abs(sum(r.n_tokens for r in own if r.selected) - want_t) <= 0.02 * want_t + 600
    total_n, total_t = sum(r.pi for r in rows), sum(r.pi * r.n_tokens for r in rows)
    assert abs(sum(r.selected for r in rows) - total_n) <= 3
    assert abs(sum(r.n_tokens for r in rows if r.selected) - total_t) <= 3 * max(r.n_tokens for r in rows)
    again = {r.doc_id: r.selected for r in mixing.sample(docs.repartition(7), p).collect()}
    assert again == {r.doc_id: r.selected for r in rows}


def test_flight_keeps_totals_and_expectations():
    rng = np.random.default_rng(2)
    prob, rows, tokens = rng.random(40), np.ones(40), rng.integers(0, 90, 40)
    mean = np.zeros(40)
    for _ in range(3000):
        out = mixing.flight(prob, rows, tokens, rng.random(41))
        assert ((out > 0) & (out < 1)).sum() <= 2
        assert abs(out.sum() - prob.sum()) < 1e-6 and abs(out @ tokens - prob @ tokens) < 1e-4
        mean += mixing.landing(out, rows, rng.random(8)) / 3000
    assert np.abs(mean - prob).max() < 0.05


def test_inclusion_fills_the_budget():
    pi = mixing.inclusion({"a": 100, "b": 100, "c": 10}, mixing.Params(targets=(("a", 1.0), ("b", 1.0), ("c", 8.0)), budget=0.5))
    assert pi["c"] == 1.0 and pi["a"] == pi["b"] == pytest.approx((105 - 10) / 2 / 100)


# ---- 3

def test_allow_takes_precedence_along_redirects(spark):
    rows = [
        (1, "http://www.cheap-pills.example.com/a", ""), (2, "http://alias.example.org/p?utm_source=x", '<link rel="canonical" href="http://cheap-pills.example.com/a">'),
        (3, "http://ok.example.org/", ""), (4, "http://spam-farm.example.com/q", '<meta http-equiv="refresh" content="0; url=http://free-bets.example.com/de/x">'),
        (5, "https://sub.casino-win.example.com/", None), (6, "http://notcasino-win.example.com/", None),
    ]
    got = {r.page_id: (r.own, r.decision) for r in urls.decisions(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: ("block", "block"), 2: ("pass", "block"), 3: ("pass", "pass"), 4: ("block", "allow"), 5: ("block", "block"), 6: ("pass", "pass")}


# ---- 4

def plain_smith_waterman(a, b):
    h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            h[i + 1][j + 1] = max(0, h[i][j] + (2 if x == y else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
            best = max(best, h[i + 1][j + 1])
    return best


def test_alignment_scores():
    rng = random.Random(4)
    pairs = [([rng.randrange(4) for _ in range(rng.randrange(1, 14))], [rng.randrange(4) for _ in range(rng.randrange(1, 30))]) for _ in range(200)]
    arr = [(np.array(a, np.uint64) + np.uint64(9), np.array(b, np.uint64) + np.uint64(9)) for a, b in pairs]
    got = decontaminate.smith_waterman([a for a, _ in arr], [b for _, b in arr])
    for (a, b), (v, f, e) in zip(pairs, got):
        assert v == plain_smith_waterman(a, b)
        assert v == plain_smith_waterman(a, b[f:e])


def test_decontamination_finds_edited_copies(spark, documents, rng):
    items = [prose(rng, 30) for _ in range(25)]
    docs, want = [], set()
    for i in range(300):
        words = prose(rng, rng.randrange(5, 400)).split()
        if i % 5 == 0:
            k = rng.randrange(25)
            copy = items[k].split()
            for _ in range(rng.randrange(5)):
                j = rng.randrange(len(copy))
                copy[j : j + rng.randrange(2)] = [rng.choice(WORDS)]
            at = rng.randrange(len(words) + 1)
            words[at:at] = copy
            want.add((i, k))
        docs.append((i, " ".join(words)))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    p = decontaminate.Params()
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(documents(docs), bench, p).collect()}
    hashed = [textops.words_of(t) for t in items]
    brute = {}
    for d, text in docs:
        w = textops.words_of(text)
        for k, (v, *_rest) in enumerate(decontaminate.smith_waterman(hashed, [w] * len(hashed), p)):
            if v / (2 * len(hashed[k])) >= p.threshold:
                brute[d, k] = round(v / (2 * len(hashed[k])), 6)
    assert want <= set(brute)
    assert len(set(brute) & set(got)) >= 0.95 * len(brute) and set(got) <= set(brute)
    assert all(got[x] <= brute[x] for x in got) and sum(got[x] == brute[x] for x in got) >= 0.95 * len(got)
    clean = {r.doc_id for r in decontaminate.drop_contaminated(documents(docs), bench, p).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in got}
    small = decontaminate.Params(block_items=7)
    assert {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(documents(docs), bench, small).collect()} == got


# ---- 5

def test_templates_by_hand(documents):
    p = templates.Params()
    rows = [(i, f"unique {WORDS[i]} line number {WORDS[i + 1]}\nPosted on {i}th of May by user {WORDS[i]} in news\n{WORDS[i]} ends") for i in range(8)]
    rows += [(20, "Posted on 9th of May"), (21, "quiet text\n\nwith blanks")]
    got = {r.doc_id: r for r in templates.drop_recurring(documents(rows), p).collect()}
    for i in range(8):
        assert got[i].dropped == [1] and got[i].n_lines == 3 and "Posted" not in got[i].text
    assert got[20].dropped == [] and got[21].text == rows[-1][1]


def test_templates_brute(documents, rng):
    p = templates.Params(lead=2, min_docs=3)
    pool = ["Read more about %s today in our paper", "Error %s at line 7 of module %s here", "Copyright 2020 %s", "%s", "alpha beta %s delta %s zeta"]
    rows = []
    for i in range(150):
        rows.append((i, "\n".join((lambda t: t % tuple(rng.choice(WORDS) for _ in range(t.count("%s"))))(rng.choice(pool)) if rng.random() < 0.5 else prose(rng, rng.randrange(1, 9)) for _ in range(rng.randrange(1, 6)))))
    leaves = defaultdict(dict)
    for d, text in rows:
        data, offsets = textops.buffers(pa.array([text]), lower=False)
        row, line, leaf, whole, first, past, h = templates.lines(data, offsets, p)
        small = np.minimum((h >> np.uint64(32)).astype(np.uint32), templates.WILD - np.uint32(1))
        for k in range(len(row)):
            leaves[int(leaf[k])].setdefault(int(whole[k].view(np.int64)), [small[first[k] : past[k]], []])[1].append((d, int(line[k])))
    want = defaultdict(list)
    for lines in leaves.values():
        order = sorted(lines)
        groups = defaultdict(list)
        for x, k in zip(order, templates.cluster([lines[x][0] for x in order], p)):
            groups[int(k)] += lines[x][1]
        for spots in groups.values():
            if len({d for d, _ in spots}) >= p.min_docs:
                for d, n in spots:
                    want[d].append(n)
    got = {r.doc_id: r.dropped for r in templates.drop_recurring(documents(rows), p).collect()}
    assert got == {d: sorted(want[d]) for d, _ in rows}
    tiny = templates.Params(lead=2, min_docs=3, max_bloom_bits=64)  # a filter that lets all through changes nothing
    assert {r.doc_id: r.dropped for r in templates.drop_recurring(documents(rows), tiny).collect()} == got


# ---- 6

@pytest.mark.parametrize("n,occupancy", [(300, neardup.Params().occupancy), (900, 4)])
def test_near_duplicates_against_all_pairs(documents, n, occupancy):
    """No link is missed, whatever the number of documents and of bands; fingerprints by plain counting."""
    rng = random.Random(11)
    rows = [(i, prose(rng, rng.randrange(40, 120))) for i in range(n * 4 // 9)]
    for i in range(len(rows), n):
        words = rng.choice(rows)[1].split()
        for _ in range(rng.randrange(8)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        rows.append((i, " ".join(words)))
    p = neardup.Params(occupancy=occupancy)
    fp = np.zeros((n, 2), np.uint64)
    for i, text in rows:
        votes = Counter()
        words = set(text.split())
        for w in words:
            h = textops.words_of(w)[0] >> np.uint64(20)
            for word in range(2):
                x = int(textops.mix(np.array([h + np.uint64(7919 * word + 1)], np.uint64))[0])
                votes.update(64 * word + k for k in range(64) if x >> k & 1)
        for k, v in votes.items():
            if 2 * v > len(words):
                fp[i, k // 64] |= np.uint64(1 << k % 64)
    d = np.bitwise_count(fp[:, None] ^ fp[None]).sum(2)
    close = [(i, j) for i, j in zip(*np.nonzero(np.triu(d <= p.max_distance, 1)))]
    label = list(range(n))
    for _ in range(30):
        for i, j in close:
            label[i] = label[j] = min(label[i], label[j])
    want = {i: x for i, x in enumerate(label) if i != x}
    got = {r.doc_id: r.dup_of for r in neardup.groups(documents(rows), p).collect()}
    assert len(want) > n / 4 and got == want
    kept = {r.doc_id for r in neardup.drop_duplicates(documents(rows), p).collect()}
    assert kept == set(range(n)) - set(got)


def test_one_row_of_a_document_stays(documents):
    text, other = " ".join(WORDS[:30]), " ".join(WORDS[40:70])
    rows = [(1, text), (1, text), (None, text), (None, text), (2, text), (None, other), (None, other), (None, None), (None, None), (3, " ")]
    kept = neardup.drop_duplicates(documents(rows)).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == sorted([("1", text), ("None", other), ("None", "None"), ("None", "None"), ("3", " ")])


@pytest.mark.parametrize("n", [10**4, 10**6, 10**8])
def test_close_fingerprints_share_a_bucket_at_any_size(n):
    p, rng = neardup.Params(), np.random.default_rng(n)
    tables = p.tables(n)
    flips = np.stack([rng.permutation(neardup.BITS)[: p.max_distance] for _ in range(300)])
    differ = np.zeros((300, neardup.BITS), bool)
    np.put_along_axis(differ, flips, True, 1)
    met = np.zeros(300, bool)
    for t in tables:
        met |= ~differ[:, t].any(1)
    assert met.all()


def test_buckets_of_any_size_group_alike():
    rng = np.random.default_rng(5)
    p = neardup.Params()
    base = rng.integers(0, 1 << 64, (60, 2), np.uint64, endpoint=False)
    fp = np.concatenate([base[rng.integers(0, 60, 900)] ^ (np.uint64(1) << rng.integers(0, 64, (900, 2)).astype(np.uint64)), base])
    tab = neardup.pivot_table(fp, p)
    whole = neardup.group_bucket(fp, tab, p, small=5000)
    assert (whole == neardup.group_bucket(fp, tab, p, small=50, block=16)).all()
    d = np.bitwise_count(fp[:, None] ^ fp[None]).sum(2) <= p.max_distance
    i, j = neardup.close(fp, tab, fp, tab, p)
    assert d.sum() == len(i) and d[i, j].all()


def test_pivots_lose_nothing():
    rng = np.random.default_rng(6)
    fp = rng.integers(0, 1 << 64, (200, 2), np.uint64, endpoint=False)
    tab = neardup.pivot_table(fp, neardup.Params()).astype(int)
    d = np.bitwise_count(fp[:, None] ^ fp[None]).sum(2)
    assert (np.abs(tab[:, None] - tab[None]).max(2) <= d).all()


# ---- 7

def test_flows_move_the_fewest_bytes():
    rng = random.Random(8)
    for _ in range(60):
        sizes = {f"s{i}": rng.randrange(8) for i in range(rng.randrange(1, 4))}
        names = list(dict.fromkeys([*list(sizes)[: rng.randrange(len(sizes) + 1)], "new"]))
        caps = {t: rng.randrange(10) for t in names}
        caps["new"] += max(0, sum(sizes.values()) - sum(caps.values()))
        out = resharding.transfers(sizes, caps)
        assert all(sum(n for (s, _), n in out.items() if s == x) == k for x, k in sizes.items())
        assert all(sum(n for (_, t), n in out.items() if t == x) <= c for x, c in caps.items())
        moved = sum(n for (s, t), n in out.items() if s != t)
        assert moved == sum(max(0, n - caps.get(s, 0)) for s, n in sizes.items())  # what can't stay must go
    with pytest.raises(ValueError):
        resharding.transfers({"a": 5}, {"b": 3})


def test_resharding_keeps_rows_and_capacities(spark, documents, rng, tmp_path):
    docs = documents([(i, prose(rng, rng.randrange(1, 60)), "hot" if i % 3 else f"s{i % 5}") for i in range(3000)])
    out = resharding.reshard(docs)
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == list(range(3000))
    size, old = Counter(), Counter()
    for r in rows:
        size[r.new_shard] += len(r.text.encode())
        old[r.old_shard] += len(r.text.encode())
        assert r.moved == (r.old_shard != r.new_shard) and r.old_shard == r.source
    cap = sum(old.values()) / len(old) * 1.05
    assert max(size.values()) <= cap * 1.01
    moved = sum(len(r.text.encode()) for r in rows if r.moved)
    assert moved <= 1.02 * sum(max(0, n - cap) for n in old.values()) + cap / 100
    blocks = defaultdict(set)
    for r in rows:
        blocks[r.old_shard, r.block].add(r.new_shard)
    assert all(len(x) == 1 for x in blocks.values())
    resharding.rewrite(out, str(tmp_path / "shards"))
    written = spark.read.parquet(str(tmp_path / "shards"))
    assert written.count() == sum(r.affected for r in rows)


# ---- 8

def test_scores_prefer_the_usual(documents, rng):
    rows = [(i, "the cat sat on the mat and " + prose(rng, 20)) for i in range(300)] + [(999, prose(rng, 26)), (1000, "the cat sat on the mat and the cat sat on the mat")]
    got = {r.doc_id: r for r in suffixtree.score(documents(rows), suffixtree.Params()).collect()}
    assert got[1000].bits_per_word < got[0].bits_per_word < got[999].bits_per_word
    assert got[0].n_words == 27 and got[0].bits_per_word == pytest.approx(-got[0].log2_prob / 27, abs=1e-3)


def brute_tree(texts, p):
    """log2 probability of each text under the tree with contexts of any length, by dictionaries."""
    n, nexts = Counter(), defaultdict(dict)
    for w in texts:
        n.update(w[i : i + k] for k in range(1, 12) for i in range(len(w) - k + 1))
    total, distinct = sum(map(len, texts)), {x for x in n if len(x) == 1}
    n = {x: c for x, c in n.items() if c >= p.least}
    for x in n:
        nexts[x[:-1]][x[-1]] = n[x]
    known = sum(nexts[()].values())
    unknown = max(total - known, p.discount) / total / (len(distinct) - len(nexts[()]) + 1)
    states, back, depth = {()}, {}, 1

    def prob(ctx, w):
        while ctx not in states:
            ctx = ctx[1:]
        if not ctx:
            return n[(w,)] / total if (w,) in n else unknown
        return max(nexts[ctx].get(w, 0) - p.discount, 0) / n[ctx] + back[ctx] * prob(ctx[1:], w)

    for ctx in sorted((x for x in nexts if x), key=len):
        if len(ctx) > depth:  # a level is done: the next one only if this added enough
            if sum(len(x) == depth for x in states) < max(1, p.tail * (len(states) - 1)):
                break
            depth += 1
        suffix = next(ctx[i:] for i in range(1, len(ctx) + 1) if ctx[i:] in states)
        low = {w: nexts[suffix][w] / (n[suffix] if suffix else total) for w in nexts[ctx]}
        rest = n[ctx] - sum(nexts[ctx].values())
        gain = sum(c * math.log(c / n[ctx] / low[w]) for w, c in nexts[ctx].items())
        if gain + (rest * math.log(rest / n[ctx] / (1 - sum(low.values()))) if rest else 0) >= p.min_gain + p.cost * len(nexts[ctx]):
            states.add(ctx)
            back[ctx] = 1 - sum(c - p.discount for c in nexts[ctx].values()) / n[ctx]
    return [sum(math.log2(prob(w[:i], w[i])) for i in range(len(w))) for w in texts], states


@pytest.mark.parametrize("hot,bucket", [(5, 700)])
def test_rare_words_keep_their_own_probability(documents, hot, bucket):
    rng = random.Random(2)
    texts = [tuple(rng.choice(WORDS[:40] if i % 2 else WORDS[40:60]) for _ in range(200)) for i in range(80)]
    texts += [("seldom", "seen", f"once{i}") for i in range(9)]
    p = suffixtree.Params(hot=hot, bucket=bucket)
    want, _ = brute_tree(texts, p)
    got = {r.doc_id: r.log2_prob for r in suffixtree.score(documents([(i, " ".join(w)) for i, w in enumerate(texts)]), p).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(want, abs=0.011)


@pytest.mark.parametrize("hot,bucket,least", [(1 << 20, 1 << 21, 2), (5, 900, 2)])
def test_contexts_of_any_length(documents, hot, bucket, least):
    """What follows hangs on a word two, three or four back, and on it only; some texts occur twice."""
    rng = random.Random(6)
    turns = ["akey then and now yes", "bkey then and now no", "red or light east", "blue or light west", "one of up", "two of down"]
    turns = [rng.choice(turns).split() + [rng.choice(WORDS[:5])] for _ in range(2400)]
    texts = [tuple(x for turn in turns[i : i + 30] for x in turn) for i in range(0, 2400, 30)]
    texts += 2 * [tuple(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(25)) for _ in range(3)]
    p = suffixtree.Params(hot=hot, bucket=bucket, least=least, min_gain=4.0, cost=2.0)
    want, states = brute_tree(texts, p)
    assert ("akey", "then", "and", "now") in states and ("then", "and", "now") not in states
    got = {r.doc_id: r.log2_prob for r in suffixtree.score(documents([(i, " ".join(w)) for i, w in enumerate(texts)]), p).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(want, abs=0.011)
    assert least > 2 or max(got[i] / 25 for i in range(80, 86)) > -8


# ---- 9

def test_ablation_by_hand(spark, documents, rng):
    rows = [(1, prose(rng, 50)), (2, "you Idiot, " + prose(rng, 50)), (3, "#$%& " * 40), (4, ""), (5, "short one"), (6, "come closer " + prose(rng, 50))]
    taught = [(100 + i, f"idiot loser number {i} " + prose(rng, 9)) for i in range(20)] + [(200 + i, f"a closer number {i} " + prose(rng, 99)) for i in range(30)]
    labels = spark.createDataFrame([(i, 1, int(i < 200)) for i, _ in taught] + [(999, 1, 1), (None, 0, 1), (100, None, None)], "doc_id long, quality int, toxic int")
    docs = documents(rows + taught)
    assert dict(rules.toxic_terms(docs, labels)) == {"idiot": True, "loser": True}
    whole = rules.ledger(docs, labels)
    led = whole.where("doc_id < 100").collect()
    bits = {r.doc_id: {n for n, b in rules.BIT.items() if r.failure_bits & b} for r in led}
    assert bits[1] == bits[6] == set() and bits[2] == {"toxic_terms"} and "symbols" in bits[3] and "empty" in bits[4] and bits[5] == {"few_words"}
    assert {r.doc_id for r in led if r.keep} == {1, 5, 6}
    got = {(r.policy, r.rule): (r.n_docs, r.n_rejected, r.n_failing, r.n_only) for r in rules.ablation(whole.where("doc_id < 100")).collect()}
    for (v, mask), rule in itertools.product(rules.POLICIES.items(), rules.BIT):
        if mask & rules.BIT[rule]:
            hit = [r.failure_bits & mask for r in led]
            assert got[v, rule] == (6, sum(h != 0 for h in hit), sum(h & rules.BIT[rule] != 0 for h in hit), sum(h == rules.BIT[rule] for h in hit))
    assert rules.toxic_terms(docs, labels.limit(0)) == []


# ---- 10

def test_classifier_on_held_out_documents(spark, documents, rng):
    good = [(i, " ".join(prose(rng, rng.randrange(4, 12)) + "." for _ in range(8))) for i in range(300)]
    bad = [(300 + i, " ".join([rng.choice(WORDS)] * 60) if i % 2 else " ".join(w + "$$$" for w in prose(rng, 60).split())) for i in range(100)]
    docs = documents(good + bad)
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(400) if i % 2 == 0], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.keep for r in quality.score(docs, labels).collect()}
    held = [i for i in range(400) if i % 2]
    assert all(got[i] for i in held if i < 300) and sum(got[i] for i in held if i >= 300) <= 3
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, k in got.items() if k}


def test_ftrl_step_by_hand():
    p = quality.Params(bits=2, epochs=1, l1=0.0, l2=0.0)
    w, b = quality.ftrl([(np.array([1]), 1)], p)
    g = -0.5
    rate = (p.beta + abs(g)) / p.alpha
    assert w[1] == pytest.approx(-g / rate) and b == pytest.approx(-g / rate) and w[0] == 0
    strong = quality.Params(bits=2, epochs=1, l1=0.6)
    assert quality.ftrl([(np.array([1]), 1)], strong)[0][1] == 0

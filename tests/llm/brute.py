"""Plain versions of the corpus operators: loops over Python values, no code of the operators but their word hashes."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from pairloom.llm import templates, textops

M64 = (1 << 64) - 1


def mix(x):
    x &= M64
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M64
    return x ^ x >> 31


def token_hash(token):
    return int(textops.tokenize(*textops.buffers(pa.array([token])), symbols=True).hash[0])


# ---- 10


def features(text, bits=18):
    """Hashed 1- and 2-grams of words and symbols, and powers of two of repeats."""
    tokens = re.findall(r"[a-z0-9]+|[^\sa-z0-9]+", (text or "").lower())
    h = [token_hash(t) for t in tokens]
    out = {mix(x + 1) >> (64 - bits) for x in h}
    out |= {mix(mix(x * textops._BASE + y) + 2) >> (64 - bits) for x, y in zip(h, h[1:])}
    for lag in (1, 2):
        often = sum(x == y for x, y in zip(h[lag:], h))
        for power in range(often.bit_length()):
            out.add(mix(1000 * lag + power) >> (64 - bits))
    return sorted(out)


def ftrl(rows, p):
    """Follow the regularised leader, coordinate by coordinate; (weights, bias)."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        l1, l2 = (0.0, 0.0) if i == "bias" else (p.l1, p.l2)
        return 0.0 if abs(z[i]) <= l1 and i != "bias" else -(z[i] - math.copysign(l1, z[i])) / ((p.beta + math.sqrt(n[i])) / p.alpha + l2)

    for _ in range(p.epochs):
        for feats, label in rows:
            x = {f: 1 / math.sqrt(max(1, len(feats))) for f in feats} | {"bias": 1.0}
            w = {i: weight(i) for i in x}
            q = 1 / (1 + math.exp(-min(35, max(-35, sum(w[i] * v for i, v in x.items())))))
            for i, v in x.items():
                g = (q - label) * v
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / p.alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    return {i: weight(i) for i in list(z)}


def quality_scores(rows, labels, order, p):
    """Probability of good quality of each (id, text); labels: id -> quality; order: ids as they are learned from."""
    text = dict(rows)
    w = ftrl([(features(text[i]), labels[i]) for i in order if i in labels and i in text], p)
    out = []
    for _, t in rows:
        f = features(t)
        s = sum(w.get(x, 0.0) for x in f) / math.sqrt(max(1, len(f))) + w.get("bias", 0.0)
        out.append(1 / (1 + math.exp(-s)))
    return out


# ---- 6


def fingerprint(text):
    """128 bits, each the majority over distinct words."""
    words = {token_hash(w) for w in re.findall(r"[a-z0-9]+", (text or "").lower())}
    votes = Counter()
    for h in words:
        h = h >> 20
        for part in range(2):
            x = mix(h + 7919 * part + 1)
            votes.update(64 * part + k for k in range(64) if x >> k & 1)
    return sum(1 << k for k, v in votes.items() if 2 * v > len(words))


def classes(prints, distance):
    """id -> least id of its component among ids -> fingerprint; 0 is alone."""
    ids = sorted(prints)
    label = {i: i for i in ids}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and prints[a] and prints[b] and (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


# ---- 4


def local_alignment(a, b):
    h, best = [0] * (len(b) + 1), 0
    for x in a:
        last, h = h, [0]
        for j, y in enumerate(b):
            h.append(max(0, last[j] + (2 if x == y else -1), last[j + 1] - 1, h[j] - 1))
            best = max(best, h[-1])
    return best


def leaks(rows, items, p):
    """(id, item) of every alignment that reaches the threshold and the evidence."""
    words = {i: re.findall(r"[a-z0-9]+", (t or "").lower()) for i, t in rows}
    count = Counter(w for x in words.values() for w in x)
    total = sum(count.values())
    out = {}
    for k, t in items:
        item = re.findall(r"[a-z0-9]+", t.lower())
        nats = -sum(math.log(max(1, count[w]) / total) for w in item)
        for i, x in words.items():
            r = local_alignment(item, x) / (2 * len(item))
            if r >= p.threshold and r * nats >= p.min_nats:
                out[i, k] = r
    return out


# ---- 2


def cube(prob, tokens, draws, land=None):
    """The cube method by singular vectors, for units of one row each."""
    p, held, used, waiting = list(prob), [], 0, [i for i, x in enumerate(prob) if 0 < x < 1]

    def step(units, u, draw):
        up = min((1 - p[i]) / x if x > 0 else -p[i] / x for i, x in zip(units, u) if abs(x) > 1e-13)
        down = min(p[i] / x if x > 0 else -(1 - p[i]) / x for i, x in zip(units, u) if abs(x) > 1e-13)
        by = up if draw < down / (up + down) else -down
        for i, x in zip(units, u):
            v = p[i] + by * x
            p[i] = 0.0 if v < 1e-9 else 1.0 if v > 1 - 1e-9 else v

    while True:
        while len(held) < 3 and waiting:
            held.append(waiting.pop(0))
        if len(held) < 3:
            break
        a = np.array([[1.0] * 3, [float(tokens[i]) for i in held]])
        u = np.linalg.svd(a)[2][2]
        u *= np.sign(np.linalg.det(np.vstack([a, u])))  # the orientation that the cross product has
        step(held, u, draws[used])
        used += 1
        held = [i for i in held if 1e-9 < p[i] < 1 - 1e-9]
    if land is not None:
        k = 0
        while len(held) > 1:
            step(held[:2], [1.0, -1.0], land[k])
            k += 1
            held = [i for i in held if 0 < p[i] < 1]
        for i in held:
            p[i] = float(land[k] < p[i])
    return p


def draw(units, hashes, p):
    """Chosen ids of units (id, source, tokens), all within one block, with their inclusion probabilities."""
    size = Counter()
    for _, s, n in units:
        size[s] += n
    left, open_, pi = p.budget * sum(size.values()), {s: float(n) ** p.temperature for s, n in size.items() if n}, {s: 0.0 for s in size}
    while open_:
        rate = left / sum(open_.values())
        full = [s for s, w in open_.items() if w * rate >= size[s] * (1 - 1e-12)]
        if not full:
            pi |= {s: w * rate / size[s] for s, w in open_.items()}
            break
        for s in full:
            pi[s], left = 1.0, max(0.0, left - size[s])
            del open_[s]
    chance, chosen = {}, {}

    def fly(group, salt, land):
        group = sorted(group, key=lambda u: hashes[u[0]])
        seed = 0
        for u in group:
            seed ^= hashes[u[0]] & M64
        rng = np.random.default_rng([p.seed, salt, seed])
        draws = rng.random(len(group) + 1)
        got = cube([chance[u[0]] for u in group], [u[2] for u in group], draws, rng.random(8) if land else None)
        chance.update((u[0], x) for u, x in zip(group, got))

    for u in units:
        chance[u[0]] = min(1.0, pi[u[1]])
    for s in size:
        fly([u for u in units if u[1] == s], 0, False)
    rest = [u for u in units if 0 < chance[u[0]] < 1]
    if rest:
        fly(rest, 1, True)
    chosen = {i for i, x in chance.items() if x == 1}
    return chosen, pi


# ---- 5


def recurring_lines(rows, p):
    """id -> numbers of the lines whose template recurs; rows: (id, text)."""
    spots = defaultdict(list)
    for i, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            tokens = tuple("*" if re.search("[0-9]", t) else t for t in re.split(r"[\x00-\x20]+", line) if t)
            if tokens:
                spots[tokens].append((i, k, line))
    leaves = defaultdict(list)
    for tokens in spots:
        leaves[len(tokens), tokens[: p.lead]].append(tokens)

    def rank(tokens):  # lines of a leaf come in the order of their hashes
        data, offsets = textops.buffers(pa.array([spots[tokens][0][2]]), lower=False)
        return int(templates.lines(data, offsets, p)[3][0].view(np.int64))

    out = defaultdict(list)
    for leaf in leaves.values():
        kinds, members = [], []
        for tokens in sorted(leaf, key=rank):
            agree = [sum(x == y for x, y in zip(kind, tokens) if x is not None) for kind in kinds]
            k = agree.index(max(agree)) if agree else -1
            if agree and agree[k] >= p.similarity * len(tokens):
                kinds[k] = [x if x == y else None for x, y in zip(kinds[k], tokens)]
                members[k] += spots[tokens]
            else:
                kinds.append(list(tokens))
                members.append(list(spots[tokens]))
        for found in members:
            if len({i for i, *_ in found}) >= p.min_docs:
                for i, k, _ in found:
                    out[i].append(k)
    return out

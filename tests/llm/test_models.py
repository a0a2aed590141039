"""The trained models against plain Python: n-grams, TF-IDF, FTRL, temperature, subword bags, gradients."""

import math

import numpy as np
import pytest

from gaugework.llm import langid, toxicity

M32 = 0xFFFFFFFF
TEXTS = ["Der Fluß, 3 Wege!", "a", "the THE  the", "é\n\tñandú x2y", "Ωmega 中文 test", "--x--", "ab " * 500]


def plain_ngrams(text):
    text = text.lower()
    if not any(c.isalpha() for c in text):
        return None
    kept = [32]
    for i, c in enumerate(text):
        if c.isalpha():
            kept.append(ord(c))
        elif i and text[i - 1].isalpha():
            kept.append(32)
    kept.append(32)
    counts = {}
    for order in langid.ORDERS:
        for start in range(len(kept) - order + 1):
            mixed = 0
            for code in kept[start : start + order]:
                mixed = (mixed ^ code) * 0x9E3779B1 & M32
                mixed ^= mixed >> 15
            counts[mixed >> 17] = counts.get(mixed >> 17, 0) + 1
    return counts


def test_ngrams_equal_plain_counts():
    for text in [*TEXTS, "", "12 34", None]:
        got = langid.ngrams(text.encode() if text is not None else None)
        want = plain_ngrams(text) if text else None
        assert (dict(zip(*(x.tolist() for x in got))) if got else None) == want


def plain_tf_idf(counts, idf):
    values = {b: n * idf[b] for b, n in counts.items()}
    norm = math.sqrt(sum(v * v for v in values.values()))
    return {b: v / norm for b, v in values.items()}


def plain_ftrl(rows, labels, classes, rounds, alpha, beta, lasso, ridge):
    z, n = {}, {}

    def weight(b, c):
        zz, nn = z.get((b, c), 0.0), n.get((b, c), 0.0)
        if abs(zz) <= lasso:
            return 0.0
        return -(zz - math.copysign(lasso, zz)) / ((beta + math.sqrt(nn)) / alpha + ridge)

    for _ in range(rounds):
        for row, label in zip(rows, labels):
            row = {**row, "bias": 1.0}
            old = {(b, c): weight(b, c) for b in row for c in range(classes)}
            logits = [sum(v * old[b, c] for b, v in row.items()) for c in range(classes)]
            top = max(logits)
            e = [math.exp(x - top) for x in logits]
            for c in range(classes):
                p = e[c] / sum(e) - (c == label)
                for b, v in row.items():
                    g, before = v * p, n.get((b, c), 0.0)
                    step = (math.sqrt(before + g * g) - math.sqrt(before)) / alpha
                    z[b, c] = z.get((b, c), 0.0) + g - step * old[b, c]
                    n[b, c] = before + g * g
    return weight


def test_training_and_scores_equal_plain_ftrl():
    rng = np.random.default_rng(1)
    words = ["der", "und", "nicht", "the", "and", "not", "les", "et", "pas"]
    labels = rng.integers(0, 3, 60)
    texts = [" ".join(words[3 * y + int(i)] for i in rng.integers(0, 3, 6)) for y in labels]
    idf = rng.uniform(0.5, 3, langid.BUCKETS)
    grams = [langid.ngrams(t.encode()) for t in texts]
    weights, bias = langid.fit(grams, labels, 3, idf, rounds=2, lasso=0.05, ridge=0.02)
    rows = [plain_tf_idf(plain_ngrams(t), idf) for t in texts]
    plain = plain_ftrl(rows, labels, 3, 2, 1.0, 1.0, 0.05, 0.02)
    used = {b for r in rows for b in r}
    for c in range(3):
        assert bias[c] == pytest.approx(plain("bias", c), abs=1e-9)
        for b in used:
            assert weights[b, c] == pytest.approx(plain(b, c), abs=1e-9)
    assert (weights[sorted(used)] == 0).any()  # the elastic net leaves weights out
    model = langid.Model(["de", "en", "fr"], idf, weights, bias, 0.7)
    for text in [*texts[:5], *TEXTS]:
        row = plain_tf_idf(plain_ngrams(text), idf)
        logits = [(sum(v * weights[b, c] for b, v in row.items()) + bias[c]) / 0.7 for c in range(3)]
        e = [math.exp(x - max(logits)) for x in logits]
        name, score = model.predict(text.encode())
        assert name == model.languages[e.index(max(e))] and score == pytest.approx(max(e) / sum(e))


def test_temperature_has_the_least_loss_of_its_grid():
    rng = np.random.default_rng(2)
    logits, labels = rng.normal(0, 3, (80, 4)), rng.integers(0, 4, 80)
    labels[:60] = logits[:60].argmax(1)

    def loss(t):
        total = 0.0
        for row, y in zip(logits.tolist(), labels):
            top = max(row) / t
            total += top + math.log(sum(math.exp(x / t - top) for x in row)) - row[y] / t
        return total / len(labels)

    grid = np.geomspace(0.05, 20, 121)
    best = langid.calibrate(logits, labels)
    assert loss(best) <= min(map(loss, grid)) + 1e-9 and 0.05 < best < 20


def plain_subwords(word):
    marked = b"<" + word + b">"
    found = [marked[i : i + n] for n in range(toxicity.LOWEST, toxicity.HIGHEST + 1) for i in range(len(marked) - n + 1)]
    buckets = []
    for gram in found:
        mixed = 0
        for byte in gram:
            mixed = (mixed ^ byte) * 0x01000193 & M32
            mixed ^= mixed >> 13
        buckets.append((mixed * 0x9E3779B1 & M32) >> 15)
    return [(b, 1 / len(found)) for b in buckets]


def test_scores_equal_plain_bags():
    rng = np.random.default_rng(3)
    model = toxicity.Model(rng.normal(0, 1, toxicity.BUCKETS), np.array([2.0, -1.5, 0.1]), -0.3)
    texts = [b"a bb ccc", b"idiot idi0t x", "é ñandú élan".encode(), b"w" * 300 + b" end", b"one", b" ".join(b"t%d" % (i % 40) for i in range(500))]
    for text in texts:
        words = toxicity.words_of(text)
        pull = {w: sum(model.pull[b] * share for b, share in plain_subwords(w)) for w in set(words)}
        strongest = sorted(pull.values())[-toxicity.STRONGEST :]
        x = [sum(pull[w] for w in words) / len(words), sum(strongest) / toxicity.STRONGEST, math.log1p(len(words))]
        want = 1 / (1 + math.exp(-(x[0] * 2.0 - x[1] * 1.5 + x[2] * 0.1 - 0.3)))
        assert model.score(words) == pytest.approx(want)


def test_a_training_step_follows_the_gradient():
    rng = np.random.default_rng(4)
    words = [b"calm", b"kind", b"vile", b"scum", b"word"]
    labels = np.array([n % 3 == 0 for n in range(45)], int)
    pieces = [[words[2 * y + int(i)] if i < 2 else words[4] for i in rng.integers(0, 3, 4)] for y in labels]
    bags = [{} for _ in pieces]
    for bag, piece in zip(bags, pieces):
        for w in piece:
            for b, share in plain_subwords(w):
                bag[b] = bag.get(b, 0) + share / len(piece)
    known = {b for b in {x for bag in bags for x in bag} if sum(b in bag for bag in bags) >= toxicity.LEAST_PIECES}
    seed = np.random.default_rng(11)
    table = seed.normal(0, 0.01, (toxicity.BUCKETS, toxicity.WIDTH))
    heads = seed.normal(0, 0.5, (2, toxicity.WIDTH))
    share = np.bincount(labels) / len(labels)
    at = sorted(known)
    mix = np.array([[bag.get(b, 0.0) for b in at] for bag in bags])

    def loss(vectors, heads):
        logits = mix @ vectors @ heads.T
        logits -= logits.max(1, keepdims=True)
        logp = logits - np.log(np.exp(logits).sum(1, keepdims=True))
        return -(logp[np.arange(len(labels)), labels] * 0.5 / share[labels]).sum() / len(labels)

    def gradient(of, x, step=1e-6):
        out = np.zeros_like(x)
        for i in np.ndindex(x.shape):
            more, less = x.copy(), x.copy()
            more[i] += step
            less[i] -= step
            out[i] = (of(more) - of(less)) / (2 * step)
        return out

    vectors = table[at]
    to_table = gradient(lambda v: loss(v, heads), vectors)
    to_heads = gradient(lambda h: loss(vectors, h), heads)
    moved = vectors - to_table / np.sqrt(1e-12 + (to_table**2).mean(1, keepdims=True))
    turned = heads - 0.1 * to_heads / np.sqrt(1e-6 + to_heads**2)
    pull = toxicity.fit(pieces, labels, rounds=1, batch=100, shrink=0.0)
    assert np.allclose(pull[at], moved @ (turned[1] - turned[0]), rtol=2e-3, atol=2e-4)
    assert not pull[[b for b in range(toxicity.BUCKETS) if b not in known]].any()

"""Toxicity: subword-bag embeddings averaged into a linear softmax."""

from __future__ import annotations

import dataclasses
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.llm.batches import map_texts, one_row_each

BUCKETS = 1 << 17
LOWEST, HIGHEST = 3, 7
WIDTH = 4
# Labelled rows used to fit, and the longest of them; the hash of the id picks them.
TRAIN_ROWS = 4_000
TRAIN_BYTES = 1 << 16
# Words in a piece of a text that is used to fit, and pieces taken from a text by class.
SPAN = 128
PIECES = (3, 12)
# Subwords in fewer pieces have no vector: they could only be learned by heart.
LEAST_PIECES = 10
ROUNDS = 5
# Words whose average stands beside the average of all words.
STRONGEST = 3
# Words are hashed so many at a time; a task remembers this many short ones.
_WORDS = 1 << 16
_KNOWN = 1 << 18
_SHORT = 64


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all marked words, the weight of each, and its word's place.

    A word is marked at both ends and weighs the same however many n-grams it
    has; misspellings share most of theirs.  Weights sum to the word count.
    """
    code = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    room = np.repeat(ends, sizes) - np.arange(ends[-1])  # letters up to the end of the word
    orders = np.arange(LOWEST, HIGHEST + 1)
    share = np.repeat(1 / np.maximum(np.maximum(sizes[:, None] - orders + 1, 0).sum(1), 1), sizes)
    word = np.repeat(np.arange(len(words)), sizes)
    buckets, weights, places = [], [], []
    mixed = np.zeros(len(code), np.uint32)
    for order in range(1, HIGHEST + 1):
        if len(code) < order:
            break
        mixed = (mixed[: len(code) - order + 1] ^ code[order - 1 :]) * np.uint32(0x01000193)
        mixed ^= mixed >> np.uint32(13)
        if order >= LOWEST:
            inside = room[: len(mixed)] >= order
            buckets.append(mixed[inside] * np.uint32(0x9E3779B1) >> np.uint32(15))
            weights.append(share[: len(mixed)][inside])
            places.append(word[: len(mixed)][inside])
    return np.concatenate(buckets), np.concatenate(weights), np.concatenate(places)


@dataclasses.dataclass
class Model:
    """What the softmax of the averaged embeddings needs.

    A word vector is the mean of its subword vectors, and the softmax is linear,
    so a word adds to the difference of the two logits the mean over `pull`,
    each bucket's vector times the difference of the softmax weights.  Two
    averages of the word vectors of a text go through that softmax: of all
    words, and of the STRONGEST different ones, since a few words far apart make
    a long text toxic.  A logistic curve over both and the text's length turns
    them into the score.
    """

    pull: np.ndarray
    scale: np.ndarray
    shift: float

    @classmethod
    def constant(cls, score: float) -> Model:
        return cls(np.zeros(BUCKETS), np.zeros(3), float(np.log(score / (1 - score))))

    def averages(self, words: list[bytes], known: dict[bytes, float]) -> np.ndarray:
        """Both averages of a whole text, and the log of its words; `known` keeps words met before."""
        counts = Counter(words)
        new = [w for w in counts if w not in known]
        for at in range(0, len(new), _WORDS):
            part = new[at : at + _WORDS]
            buckets, weights, places = subwords(part)
            known.update(zip(part, np.bincount(places, self.pull[buckets] * weights, len(part)).tolist()))
        pulls = np.array([known[w] for w in counts])
        times = np.fromiter(counts.values(), np.int64, len(counts))
        if len(known) > _KNOWN or max(map(len, new), default=0) > _SHORT:
            known.clear()
        top = np.sort(pulls)[-STRONGEST:]
        return np.array([pulls @ times / max(len(words), 1), top.sum() / STRONGEST, np.log1p(len(words))])

    def score(self, words: list[bytes], known: dict[bytes, float] | None = None) -> float:
        x = self.averages(words, {} if known is None else known) @ self.scale + self.shift
        return float(1 / (1 + np.exp(-np.clip(x, -40, 40))))


def _pieces(words: list[bytes]) -> list[list[bytes]]:
    """The text in pieces of about SPAN words."""
    parts = max(1, round(len(words) / SPAN))
    cuts = [len(words) * i // parts for i in range(parts + 1)]
    return [words[i:j] for i, j in zip(cuts, cuts[1:]) if j > i]


def fit(pieces: list[list[bytes]], labels: np.ndarray, rounds: int = ROUNDS, rate: float = 1.0, batch: int = 64, shrink: float = 0.15) -> np.ndarray:
    """Embeddings and softmax weights, trained together with per-weight steps.

    Both classes weigh the same.  After each step every vector is drawn towards
    zero by its step size times `shrink` times the usual size of a gradient, so
    only subwords that keep telling the classes apart have a vector at the end.
    """
    rng = np.random.default_rng(11)
    bags = []
    held_by = np.zeros(BUCKETS, np.int64)
    for words in pieces:
        bucket, weight, _ = subwords(words)
        used, slot = np.unique(bucket, return_inverse=True)
        bags.append((used.astype(np.int32), (np.bincount(slot, weight) / len(words)).astype(np.float32)))
        held_by[used] += 1
    known = held_by >= LEAST_PIECES
    bags = [(used[known[used]], weight[known[used]]) for used, weight in bags]
    table = rng.normal(0, 0.01, (BUCKETS, WIDTH)) * known[:, None]
    heads = rng.normal(0, 0.5, (2, WIDTH))
    bias = np.zeros(2)
    sums = [np.full(BUCKETS, 1e-12), np.full(heads.shape, 1e-6), np.full(2, 1e-6)]
    share = np.bincount(labels, minlength=2) / len(labels)
    seen = 0
    for _ in range(rounds):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            sizes = np.array([len(bags[i][0]) for i in pick])
            bucket = np.concatenate([bags[i][0] for i in pick])
            weight = np.concatenate([bags[i][1] for i in pick])
            owner = np.repeat(np.arange(len(pick)), sizes)
            parts = table[bucket] * weight[:, None]
            text = np.stack([np.bincount(owner, parts[:, k], len(pick)) for k in range(WIDTH)], 1)
            logits = text @ heads.T + bias
            logits -= logits.max(1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), labels[pick]] -= 1
            p *= (0.5 / share[labels[pick]])[:, None] / len(pick)
            to_text, to_heads, to_bias = p @ heads, p.T @ text, p.sum(0)
            step = np.stack([np.bincount(bucket, weight * to_text[owner, k], BUCKETS) for k in range(WIDTH)], 1)
            sums[0] += (step**2).mean(1)
            table -= rate * step / np.sqrt(sums[0])[:, None]
            seen += 1
            usual = np.sqrt(sums[0][known].mean() / seen)
            size = np.sqrt((table**2).sum(1)) + 1e-12
            table *= np.maximum(0, 1 - rate * shrink * usual / np.sqrt(sums[0]) / size)[:, None]
            sums[1] += to_heads**2
            heads -= 0.1 * rate * to_heads / np.sqrt(sums[1])
            sums[2] += to_bias**2
            bias -= 0.1 * rate * to_bias / np.sqrt(sums[2])
    return table @ (heads[1] - heads[0])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fits on at most `rows` labelled documents of at most TRAIN_BYTES.

    `labels` (doc_id, toxic) holds what may be learned; ids labelled both ways
    are left out.  Pieces drawn from these documents train the vectors.  An
    eighth of the documents, scored whole, is held back for the curve of the
    score.  If it lacks a class, the curve is fitted on all of them.
    """
    agreed = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.min("toxic").alias("low"), F.max("toxic").alias("high"))
        .where("low = high")
    )
    chosen = agreed.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id", "low").collect()
    toxic = {r.doc_id: int(r.low > 0) for r in chosen}
    if len(set(toxic.values())) < 2:
        return Model.constant(0.999 if any(toxic.values()) else 0.001)
    ids = docs.sparkSession.createDataFrame([(i,) for i in toxic], "doc_id long")
    # at most `rows` ids, so the hint is bounded; of rows with one id, one is kept before any comes to the driver
    short = docs.select("doc_id", "text").where(F.octet_length("text") <= TRAIN_BYTES)
    used = one_row_each(short.join(F.broadcast(ids), "doc_id", "left_semi"), "doc_id")
    got = used.toPandas().sort_values("doc_id")
    rng = np.random.default_rng(5)
    texts = [(words_of(t.encode("utf-8", "replace")), toxic[i]) for i, t in zip(got.doc_id, got.text)]
    texts = [texts[i] for i in rng.permutation(len(texts))]
    held = len(texts) // 8
    fitted, kept = texts[held:], texts[:held]
    if len({y for w, y in fitted if w}) < 2:
        return Model.constant(0.001)
    pull = _fitted(fitted, rng)
    if len({y for _, y in kept}) < 2:
        kept = texts
    model = Model(pull, np.zeros(3), 0.0)
    known: dict[bytes, float] = {}
    model.scale, model.shift = _curve(np.array([model.averages(w, known) for w, _ in kept]), np.array([y for _, y in kept]))
    return model


def _fitted(texts: list[tuple[list[bytes], int]], rng: np.random.Generator) -> np.ndarray:
    pieces, marks = [], []
    for words, y in texts:
        own = _pieces(words)
        own = [own[i] for i in rng.permutation(len(own))[: PIECES[y]]]
        pieces += own
        marks += [y] * len(own)
    return fit(pieces, np.array(marks))


def _curve(x: np.ndarray, labels: np.ndarray, ridge: float = 0.25) -> tuple[np.ndarray, float]:
    """Slopes and shift of a logistic curve through the averages, by Newton's method.

    The averages are brought to one spread, the slopes held small by `ridge`,
    and the targets drawn in by what the number of rows can tell.
    """
    middle, spread = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.c_[(x - middle) / spread, np.ones(len(x))]
    target = np.where(labels > 0, 1 - 1 / (labels.sum() + 2), 1 / ((1 - labels).sum() + 2))
    held = ridge * np.diag([1.0] * x.shape[1] + [1e-6])
    w = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        r = np.maximum(p * (1 - p), 1e-6)
        w -= np.clip(np.linalg.solve((z * r[:, None]).T @ z + held, z.T @ (p - target) + held @ w), -1, 1)
    return w[:-1] / spread, float(w[-1] - w[:-1] @ (middle / spread))


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every whole text.

    A null or empty text has no word, so both its averages are zero.
    Repeated rows and null ids give one row each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def make():
        m = shared.value
        known: dict[bytes, float] = {}

        def work(texts, _):
            scores = [m.score(words_of(t), known) for t in texts]
            return {"score": scores, "predicted": [int(x >= 0.5) for x in scores]}

        return work

    return map_texts(docs, [id_col], text_col, "score double, predicted int", make)

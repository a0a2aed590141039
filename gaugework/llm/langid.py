"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import dataclasses
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.llm.batches import map_texts, one_row_each

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
# Labelled rows used to fit; the hash of the id picks them, a fifth calibrates.
TRAIN_ROWS = 4_000
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def ngrams(text: bytes | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Buckets and counts of the n-grams of a whole text; None if it has no letter.

    Letters are lower-cased, runs of anything else are one space.
    """
    if not text:
        return None
    code = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    if not letter.any():
        return None
    code = np.where(letter, code, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    code = np.concatenate([[np.uint32(32)], code[keep], [np.uint32(32)]]).astype(np.uint32)
    counts = np.zeros(BUCKETS, np.int64)
    mixed = np.zeros(len(code), np.uint32)
    for order in range(1, max(ORDERS) + 1):
        if len(code) < order:
            break
        mixed = (mixed[: len(code) - order + 1] ^ code[order - 1 :]) * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
        if order in ORDERS:
            counts += np.bincount(mixed >> np.uint32(17), minlength=BUCKETS)
    found = np.flatnonzero(counts)
    return found, counts[found]


@dataclasses.dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # [bucket, language]
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, grams: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        buckets, values = _tf_idf(grams, self.idf)
        return values @ self.weights[buckets] + self.bias

    def predict(self, text: bytes | None) -> tuple[str, float]:
        grams = ngrams(text)
        if grams is None or not self.languages:
            return UNKNOWN, 0.0
        p = _softmax(self.logits(grams) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _tf_idf(grams: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    buckets, counts = grams
    values = counts * idf[buckets]
    return buckets, values / max(float(np.sqrt(values @ values)), 1e-12)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def document_frequencies(docs: DataFrame, id_col: str, text_col: str) -> tuple[np.ndarray, int]:
    """Over all given documents: how many hold each bucket, and how many have letters.

    Tasks send one number a bucket at most; the driver gets their sums.
    """

    def run(batches):
        counts, seen = np.zeros(BUCKETS + 1, np.int64), 0
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                grams = ngrams(text.as_py())
                if grams is not None:
                    counts[grams[0]] += 1
                    seen += 1
        counts[BUCKETS] = seen
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], names=["bucket", "n"])

    sums = (
        docs.select(docs[text_col].cast("string"))
        .mapInArrow(run, "bucket long, n long")
        .groupBy("bucket")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    out = np.zeros(BUCKETS + 1, np.int64)
    for r in sums:
        out[r.bucket] = r.n
    return out[:BUCKETS], int(out[BUCKETS])


def train(
    docs: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> Model:
    """Fits the model on the given documents; those without a language, text or id are ignored.

    Document frequencies cover all of them.  The weights are fitted on at most
    `rows` whose ids hash lowest, the last fifth of which sets the temperature;
    of rows with one id the one that hashes lowest counts.
    """
    spark = docs.sparkSession
    usable = docs.where(docs[lang_col].isNotNull() & docs[id_col].isNotNull() & docs[text_col].isNotNull()).select(
        docs[id_col].alias("id"), docs[text_col].alias("text"), docs[lang_col].cast("string").alias("lang")
    )
    seen, count = document_frequencies(usable, "id", "text")
    idf = np.log((1 + count) / (1 + seen)) + 1
    least = usable.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(rows)
    chosen = [(r.id,) for r in least.collect()]
    if not chosen:
        return Model([], idf, np.zeros((BUCKETS, 0)), np.zeros(0))
    ids = spark.createDataFrame(chosen, usable.select("id").schema)
    # at most `rows` ids, so the hint is bounded; of rows with one id, one is kept before any comes to the driver
    used = one_row_each(usable.join(F.broadcast(ids), "id", "left_semi"), "id")

    def make():
        def work(texts, _):
            grams = [ngrams(t) for t in texts]
            return {
                "buckets": [None if g is None else g[0].astype("<u2").tobytes() for g in grams],
                "counts": [None if g is None else g[1].astype("<u4").tobytes() for g in grams],
            }

        return work

    got = map_texts(used, ["id", "lang"], "text", "buckets binary, counts binary", make).toPandas().dropna()
    got = got.sort_values("id")
    order = np.random.default_rng(7).permutation(len(got))
    grams = [
        (np.frombuffer(got.buckets.iat[i], "<u2").astype(np.int64), np.frombuffer(got.counts.iat[i], "<u4")) for i in order
    ]
    languages = sorted(set(got["lang"]))
    labels = np.array([languages.index(got["lang"].iat[i]) for i in order], np.int64)
    held = len(labels) // 5
    model = Model(languages, idf, *fit(grams[held:], labels[held:], len(languages), idf))
    if held:
        logits = np.stack([model.logits(g) for g in grams[:held]])
        model.temperature = calibrate(logits, labels[:held])
    return model


def fit(
    grams: list[tuple[np.ndarray, np.ndarray]],
    labels: np.ndarray,
    classes: int,
    idf: np.ndarray,
    rounds: int = 2,
    alpha: float = 1.0,
    beta: float = 1.0,
    lasso: float = 0.02,
    ridge: float = 0.01,
) -> tuple[np.ndarray, np.ndarray]:
    """Follow-the-regularised-leader with per-weight steps and elastic net."""
    z = np.zeros((BUCKETS + 1, classes))
    n = np.zeros((BUCKETS + 1, classes))

    def leader(at):
        zz, nn = z[at], n[at]
        shrunk = np.sign(zz) * np.maximum(np.abs(zz) - lasso, 0)
        return -shrunk / ((beta + np.sqrt(nn)) / alpha + ridge)

    rows = [(np.append(b, BUCKETS), np.append(v, 1.0)) for b, v in (_tf_idf(g, idf) for g in grams)]
    for _ in range(rounds):
        for (at, value), label in zip(rows, labels):
            w = leader(at)
            p = _softmax(value @ w)
            p[label] -= 1
            g = value[:, None] * p
            squared = g * g
            step = (np.sqrt(n[at] + squared) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += squared
    final = leader(np.arange(BUCKETS + 1))
    return final[:BUCKETS], final[BUCKETS]


def calibrate(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, on a fine grid."""
    best = (np.inf, 1.0)
    for t in np.geomspace(0.05, 20, 121):
        scaled = logits / t
        scaled = scaled - scaled.max(1, keepdims=True)
        loss = (np.log(np.exp(scaled).sum(1)) - scaled[np.arange(len(labels)), labels]).mean()
        if loss < best[0] - 1e-12:
            best = (float(loss), float(t))
    return best[1]


def identify(docs: DataFrame, model: Model, keep: list[str | Column] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """(kept columns, lang_pred, score) of every whole text.

    A text that is null or has no letter is `und` with score 0.  Only the text
    is read.  Ties go to the language that sorts first.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers a language

    def make():
        m = shared.value

        def work(texts, _):
            found = [m.predict(t) for t in texts]
            return {"lang_pred": [x[0] for x in found], "score": [x[1] for x in found]}

        return work

    return map_texts(docs, list(keep), text_col, "lang_pred string, score double", make)


def lettered(docs: DataFrame, keep: list[str | Column] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """(kept columns, lettered): whether a text has a letter, as `identify` needs one."""

    def make():
        return lambda texts, _: {"lettered": [ngrams(t) is not None for t in texts]}

    return map_texts(docs, list(keep), text_col, "lettered boolean", make)

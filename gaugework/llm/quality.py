"""Quality rules: gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.llm.batches import map_texts, one_row_each
from gaugework.llm.trees import Forest, fit_forest

SYMBOLS = b"#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

_UPPER = bytes(range(65, 91))
_DIGIT = b"0123456789"
_PUNCT = b".,;:!?\"'()-"

# Feature name -> direction of the score: -1 never rises with it, 0 free.
FEATURES = {
    "log_words": 0,
    "word_length": 0,
    "symbols_per_word": -1,
    "dup_lines_per_line": -1,
    "repeat_share": -1,
    "upper_share": -1,
    "digit_share": -1,
    "punct_per_word": 0,
    "distinct_share": 0,
    "words_per_line": 0,
    "marks_alone_share": -1,
    "longest_word": -1,
}
DIRECTIONS = tuple(FEATURES.values())

# Labelled rows used to fit and calibrate; the hash of the id picks them.
TRAIN_ROWS = 20_000
# Share of good labelled rows that the verdict may reject.
GOOD_REJECTED = 0.002


def statistics(text: bytes | None) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The five base counts and the features of one whole text.

    Words are runs of anything but ASCII white space, which is what
    `bytes.split` cuts at.
    """
    text = text or b""
    words = text.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined.decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    dup_lines = len(lines) - len(set(lines))
    repeats = 0
    if n > WINDOW:
        windows = list(zip(*(words[i:] for i in range(WINDOW))))
        if len(set(windows)) < len(windows):
            seen = Counter(windows)
            twice = np.fromiter((seen[w] > 1 for w in windows), bool, len(windows))
            covered = np.zeros(n, bool)
            for i in range(WINDOW):
                covered[i : i + len(windows)] |= twice
            repeats = int(covered.sum())
    per_word, per_byte = 1 / max(n, 1), 1 / max(len(joined), 1)
    distinct = set(words)
    marks = {w for w in distinct if not w.translate(None, SYMBOLS + _PUNCT)}
    alone = sum(map(marks.__contains__, words)) if marks else 0
    features = (
        float(np.log1p(n)),
        chars * per_word,
        symbols * per_word,
        dup_lines / max(len(lines), 1),
        repeats * per_word,
        (len(joined) - len(joined.translate(None, _UPPER))) * per_byte,
        (len(joined) - len(joined.translate(None, _DIGIT))) * per_byte,
        (len(joined) - len(joined.translate(None, _PUNCT))) * per_word,
        len(distinct) * per_word,
        n / max(len(lines), 1),
        alone * per_word,
        float(np.log1p(max(map(len, distinct), default=0))),
    )
    return (n, chars, symbols, dup_lines, repeats), features


def base_failed(counts: np.ndarray) -> np.ndarray:
    n, repeats = counts[:, 0], counts[:, 4]
    return (n < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Forest:
    """Fits the trees on at most `rows` labelled documents.

    The rows are those whose ids hash lowest among all labelled ids, and of rows
    with one id the one whose statistics hash lowest, so the sample does not depend
    on order or partitioning.  Ids labelled both ways are left out.  A third of the sample is held back to set the threshold: the
    score under which `GOOD_REJECTED` of its good rows fall.  With fewer than
    two classes in the labels the verdict keeps every document.
    """
    agreed = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
        .where("low = high")
    )
    chosen = (
        agreed.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id", F.col("low").alias("quality"))
    )
    picked = {r.doc_id: r.quality for r in chosen.collect()}
    spark = docs.sparkSession
    if len(set(map(bool, picked.values()))) < 2:
        return Forest.constant(len(FEATURES))
    ids = spark.createDataFrame([(i,) for i in picked], "doc_id long")
    # at most `rows` ids, so the hint is bounded
    used = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")

    def make():
        return lambda texts, _: {"features": [statistics(t)[1] for t in texts]}

    # Of rows with one id, one is kept before any comes to the driver; texts are not shuffled.
    got = one_row_each(map_texts(used, ["doc_id"], "text", "features array<double>", make), "doc_id").toPandas()
    if got.empty:
        return Forest.constant(len(FEATURES))
    got = got.sort_values("doc_id")
    x = np.array(got["features"].tolist())
    y = np.array([bool(picked[i]) for i in got["doc_id"]], float)
    held = np.arange(len(y)) % 3 == 2
    if y[~held].min() == y[~held].max():
        return Forest.constant(len(FEATURES))
    forest = fit_forest(x[~held], y[~held], DIRECTIONS)
    scores = forest.score(x[held])[y[held] > 0]
    if len(scores):
        # halfway down to certain rejection, where no good row was seen
        forest.threshold = float(min(0.5, np.quantile(scores, GOOD_REJECTED)))
    return forest


def judge(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, five base counts, base_failed, quality_score, kept) of every text.

    A null text counts as no words and so fails the base rule, as an empty one
    does.  Repeated rows and null ids give one row each.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(forest)  # a few thousand numbers

    def make():
        trees = model.value

        def work(texts: list[bytes | None], _: pa.RecordBatch):
            rows = [statistics(t) for t in texts]
            counts = np.array([r[0] for r in rows], np.int64).reshape(-1, len(BASE))
            scores = trees.score(np.array([r[1] for r in rows], float).reshape(-1, len(FEATURES)))
            failed = base_failed(counts)
            return {name: counts[:, i] for i, name in enumerate(BASE)} | {
                "base_failed": failed,
                "quality_score": scores,
                "kept": ~failed & (scores >= trees.threshold),
            }

        return work

    schema = ", ".join(f"{n} long" for n in BASE) + ", base_failed boolean, quality_score double, kept boolean"
    return map_texts(docs, [id_col], text_col, schema, make)

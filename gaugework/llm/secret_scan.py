"""Secret scans: fixed patterns, and a linear-chain conditional random field."""

from __future__ import annotations

import bisect
import dataclasses
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.llm.batches import map_texts, materialize, one_row_each

# The base patterns, the part that is the secret, its least length.
KINDS = {
    "assign": (
        re.compile(
            r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
        ),
        2,
        6,
    ),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}
TAGGED = "crf"
_ORDER = {kind: i for i, kind in enumerate([*KINDS, TAGGED])}
_ASSIGNS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

OUT, BEGIN, INSIDE = 0, 1, 2
# Documents used to fit: with a base span, and others; the hash of the id picks them.
TRAIN_ROWS = (500, 300)
TRAIN_BYTES = 1 << 16
# Tokens to each side of a place that are used to fit, and places taken from a text.
NEAR = 8
WIDE = 2 * NEAR + 1
PLACES = 4
BUCKETS = 1 << 14

Span = tuple[int, int, str]


def base_spans(text: str, utf8: bytes) -> list[Span]:
    """(start, end, kind) in code points; leftmost and not overlapping within a kind."""
    out: list[Span] = []
    low = utf8.lower()
    if any(word in low for word in _ASSIGNS):
        pattern, group, least = KINDS["assign"]
        out += [(*m.span(), "assign") for m in pattern.finditer(text) if len(m[group]) >= least]
    if b"AKIA" in utf8:
        pattern, group, least = KINDS["access"]
        out += [(*m.span(), "access") for m in pattern.finditer(text) if len(m[group]) >= least]
    if _may_hold_hex(utf8):
        out += [(*m.span(), "hex") for m in _LONG_HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], _ORDER[s[2]]))


_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_STRIDE = 3


def _may_hold_hex(utf8: bytes) -> bool:
    """False only if no run of hex digits has the least length.

    Such a run holds `least // stride` neighbours among every stride-th letter.
    """
    seen = _HEX[np.frombuffer(utf8, np.uint8)[::_STRIDE]]
    need = KINDS["hex"][2] // _STRIDE
    if len(seen) < need:
        return False
    sums = np.cumsum(np.concatenate([[0], seen]))
    return bool((sums[need:] - sums[:-need] == need).any())


_SHAPE = bytes(
    97 if 97 <= b <= 122 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else 117 if b >= 128 else b for b in range(256)
)
_APART = bytes(b if b >= 128 or chr(b).isalnum() or b == 95 else 32 for b in range(256))
_PUNCT = b"\"'`=:;,.!?()[]{}<>|*#$%&"


_TOLD = frozenset(
    b"password passwd pass pwd secret token api apikey api_key key auth bearer authorization credential credentials "
    b"access private login user username client_secret access_key secret_key private_key export".split()
)


def _buckets(*names: str) -> list[int]:
    return [zlib.crc32(n.encode()) % BUCKETS for n in names]


def _seen_as(word: bytes, shape: bytes) -> bytes:
    """Words without digits and of usual length are told apart by shape only."""
    return shape if _tame(shape) else word


def _tame(shape: bytes) -> bool:
    return len(shape) < 16 and b"0" not in shape


def token_features(word: bytes) -> list[int]:
    """What a token says about itself: length, kinds of letters, changes between them."""
    core = word.strip(_PUNCT)
    n = len(core)
    kinds = core.translate(_SHAPE)
    digits, upper, lower = (kinds.count(c) for c in (b"0", b"A", b"a"))
    turns = sum(a != b for a, b in zip(kinds, kinds[1:]))
    size = min(n // 4, 12)
    mixed = (digits > 0) + (upper > 0) + (lower > 0)
    hexes = size >= 4 and not core.strip(b"0123456789abcdefABCDEF")
    plain = n > 0 and not kinds.strip(b"aA0+/_.=-")
    quoted = word[:1] in (b'"', b"'") or word[-1:] in (b'"', b"'")
    return _buckets(
        "bias",
        f"size {size}",
        f"mixed {mixed} {size >= 4} {size >= 6}",
        f"hex {hexes} {digits > 0} {size >= 5}",
        f"turns {min(turns, 9)} {size >= 4}",
        f"digits {min(4 * digits // max(n, 1), 4)} {size >= 4}",
        f"upper {min(4 * upper // max(n, 1), 4)} {size >= 4}",
        f"plain {plain} {quoted}",
        f"marks {kinds.count(b'u') > 0} {any(c in core for c in b'.-@/')} {mixed}",
        f"told {core.lower().decode('utf-8', 'replace') if core.lower() in _TOLD else ''}",
        f"alone {n == 0} {word[:2]!r}" if n == 0 else "alone no",
    )


def neighbour_features(word: bytes, side: str) -> list[int]:
    """What the word before or after says: its last marks, and which told word it is."""
    core = word.lower().strip(_PUNCT)
    marks = word.translate(_SHAPE).translate(None, b"aA0u")[-2:]
    return _buckets(f"{side} m {marks!r}", f"{side} w {core.decode() if core in _TOLD else ''}")


def file_features(utf8: bytes) -> list[int]:
    """What the whole file says: whether it looks like code or settings."""
    marks = sum(utf8.count(c) for c in (b"=", b"{", b"}", b";"))
    return _buckets(f"f code {min(100 * marks // max(len(utf8), 1), 4)}", f"f key {b'KEY' in utf8} {b'BEGIN ' in utf8}")


class _Shapes(dict):
    """Numbers of shapes, and for each the scores of a word of that shape and its neighbours."""

    ROOM = 100_000

    def __init__(self, weights: np.ndarray):
        self._weights = weights
        self.rows = np.zeros((1024, 3, 3))  # (itself, the next word, the one before)

    def __missing__(self, shape: bytes) -> int:
        if len(self) >= self.ROOM:
            return -1
        number = self[shape] = len(self)
        if number == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        parts = (token_features(shape), neighbour_features(shape, "b"), neighbour_features(shape, "a"))
        self.rows[number] = [self._weights[f].sum(0) for f in parts]
        return number


@dataclasses.dataclass
class Tagger:
    """Weights of features for each tag, and of each step from tag to tag."""

    weights: np.ndarray
    steps: np.ndarray

    def __post_init__(self):
        self._shapes = _Shapes(self.weights)
        self._first = self.weights[neighbour_features(b"", "b")].sum(0)
        self._last = self.weights[neighbour_features(b"", "a")].sum(0)

    def emissions(self, words: list[bytes], shapes: list[bytes], utf8: bytes) -> np.ndarray:
        """Scores of the tags of every token.

        Words are scored by shape, once a shape; tokens that are not tame, and
        texts with told words, are scored one by one.
        """
        if len(self._shapes) >= _Shapes.ROOM // 2:
            self._shapes = _Shapes(self.weights)
        number = np.fromiter(map(self._shapes.__getitem__, shapes), np.int64, len(shapes))
        rows = self._shapes.rows[number]
        told = not _TOLD.isdisjoint(utf8.lower().translate(_APART).split())
        for i in range(len(words)) if told or (number < 0).any() else [i for i, s in enumerate(shapes) if not _tame(s)]:
            word = words[i]
            parts = (token_features(_seen_as(word, shapes[i])), neighbour_features(word, "b"), neighbour_features(word, "a"))
            rows[i] = [self.weights[f].sum(0) for f in parts]
        out = rows[:, 0].copy()
        out[1:] += rows[:-1, 1]
        out[:-1] += rows[1:, 2]
        out[0] += self._first
        out[-1] += self._last
        return out + self.weights[file_features(utf8)].sum(0)

    def tags(self, emissions: np.ndarray) -> np.ndarray:
        """The best path by Viterbi.

        A token whose score for OUT is above the others by more than any two
        steps could make up is OUT on every best path, so only the runs between
        such tokens are walked.
        """
        n = len(emissions)
        slack = 2 * (self.steps.max() - self.steps.min())
        open_ = emissions[:, OUT] - emissions[:, 1:].max(1) <= slack
        out = np.zeros(n, np.int64)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], open_.view(np.int8), [0]])))
        for first, end in edge.reshape(-1, 2):
            out[first:end] = self._walk(emissions[first:end], first == 0, end == n)
        return out

    def _walk(self, run: np.ndarray, starts: bool, ends: bool) -> list[int]:
        score = run[0] + (0 if starts else self.steps[OUT])
        score = np.where([False, False, True], -np.inf, score) if starts else score
        back = []
        for row in run[1:]:
            way = score[:, None] + self.steps
            back.append(way.argmax(0))
            score = way.max(0) + row
        tag = int((score + (0 if ends else self.steps[:, OUT])).argmax())
        path = [tag]
        for choice in reversed(back):
            path.append(int(choice[path[-1]]))
        return path[::-1]

    def spans(self, text: str, utf8: bytes) -> list[Span]:
        """Spans of the tokens tagged as secrets, without the marks around them."""
        words = utf8.split()
        if not words:
            return []
        tags = self.tags(self.emissions(words, utf8.translate(_SHAPE).split(), utf8))
        if not tags.any():
            return []
        at, before, places = 0, OUT, []
        for w, tag in zip(words, tags.tolist()):
            at = utf8.index(w, at)
            core = w.strip(_PUNCT)
            if tag and core:
                first = at + w.index(core)
                if tag == INSIDE and before and places:
                    places[-1] = (places[-1][0], first + len(core))
                else:
                    places.append((first, first + len(core)))
            before = tag
            at += len(w)
        return _in_letters(utf8, places)


def _in_letters(utf8: bytes, places: list[tuple[int, int]]) -> list[Span]:
    """Ascending places in bytes as spans in code points, by one running count."""
    spans, at, letters = [], 0, 0
    for place in places:
        ends = []
        for byte in place:
            letters += len(utf8[at:byte].decode("utf-8", "replace"))
            at = byte
            ends.append(letters)
        spans.append((*ends, TAGGED))
    return spans


def find(text: str, utf8: bytes, tagger: Tagger) -> list[Span]:
    """Base spans, and those of the tagger that touch none of them."""
    base = sorted(base_spans(text, utf8), key=lambda s: (s[0], _ORDER[s[2]]))
    starts = [b[0] for b in base]
    reach = list(itertools.accumulate((b[1] for b in base), max))  # how far the bases up to here go
    touched = lambda s: (n := bisect.bisect_left(starts, s[1])) > 0 and reach[n - 1] > s[0]
    more = [s for s in tagger.spans(text, utf8) if not touched(s)]
    return sorted(base + more, key=lambda s: (s[0], _ORDER[s[2]]))


def _windows(utf8: bytes, seed: int) -> tuple[list[int], list[int]]:
    """Token features and tags around base spans, odd tokens and random places.

    Flat: every window has WIDE tokens, those beyond the text are -1.
    """
    text = utf8.decode("utf-8", "replace")
    words, shapes = utf8.split(), utf8.translate(_SHAPE).split()
    if not words:
        return [], []
    unit = np.zeros(len(utf8) + 1, np.int64)
    for i, (start, end, _) in enumerate(base_spans(text, utf8)):
        cut = slice(*(len(text[:x].encode("utf-8", "replace")) for x in (start, end)))
        unit[cut] = np.where(unit[cut], unit[cut], i + 1)
    tags, owners, at = [], [0], 0
    for w in words:
        at = utf8.index(w, at)
        own = int(unit[at : at + len(w)].max())
        tags.append(OUT if not own else INSIDE if own == owners[-1] else BEGIN)
        owners.append(own)
        at += len(w)
    rng = np.random.default_rng(seed)
    places = [i for i, t in enumerate(tags) if t == BEGIN][:PLACES]
    odd = [i for i, s in enumerate(shapes) if not _tame(s) and not tags[i]]
    places += [odd[i] for i in rng.permutation(len(odd))[:PLACES]] + rng.integers(0, len(words), 2).tolist()
    rest = file_features(utf8)
    features: list[int] = []
    marks: list[int] = []
    for place in places:
        for i in range(place - NEAR, place + NEAR + 1):
            if not 0 <= i < len(words):
                features += [-1] * FEATURES
                marks.append(-1)
                continue
            features += token_features(_seen_as(words[i], shapes[i]))
            features += neighbour_features(words[i - 1] if i else b"", "b")
            features += neighbour_features(words[i + 1] if i + 1 < len(words) else b"", "a")
            features += rest
            marks.append(tags[i])
    return features, marks


FEATURES = len(token_features(b"a") + neighbour_features(b"", "b") + neighbour_features(b"", "a") + file_features(b""))


def fit(features: np.ndarray, tags: np.ndarray, rounds: int = 30, rate: float = 0.3, ridge: float = 1e-4) -> Tagger:
    """Maximises the likelihood of whole tag sequences by forward-backward, in full batches."""
    n, longest, width = features.shape
    # texts end inside a window at its front or back: move all tokens to the front
    order = np.argsort(tags < 0, axis=1, kind="stable")
    features = np.take_along_axis(features, order[..., None], 1)
    tags = np.take_along_axis(tags, order, 1)
    real = tags >= 0
    features, tags = np.maximum(features, 0), np.maximum(tags, 0)
    weights, steps = np.zeros((BUCKETS, 3)), np.zeros((3, 3))
    sums = [np.full(weights.shape, 1e-6), np.full(steps.shape, 1e-6)]
    gold = np.eye(3)[tags] * real[..., None]
    gold_steps = np.zeros((3, 3))
    both = real[:, 1:] & real[:, :-1]
    np.add.at(gold_steps, (tags[:, :-1][both], tags[:, 1:][both]), 1)
    for _ in range(rounds):
        e = weights[features].sum(2)
        e = np.where(real[..., None], e, 0.0)
        fwd, bwd = np.empty_like(e), np.zeros_like(e)
        fwd[:, 0] = e[:, 0]
        for t in range(1, longest):
            way = fwd[:, t - 1, :, None] + steps
            top = way.max(1)
            new = np.log(np.exp(way - top[:, None]).sum(1)) + top + e[:, t]
            fwd[:, t] = np.where(real[:, t, None], new, fwd[:, t - 1])
        for t in range(longest - 2, -1, -1):
            way = steps + (e[:, t + 1] + bwd[:, t + 1])[:, None, :]
            top = way.max(2)
            new = np.log(np.exp(way - top[..., None]).sum(2)) + top
            bwd[:, t] = np.where(real[:, t + 1, None], new, 0.0)
        total = fwd[:, -1]
        z = np.log(np.exp(total - total.max(1, keepdims=True)).sum(1)) + total.max(1)
        p = np.exp(fwd + bwd - z[:, None, None]) * real[..., None]
        pair = np.exp(
            fwd[:, :-1, :, None] + steps + (e + bwd)[:, 1:, None, :] - z[:, None, None, None]
        ) * both[:, :, None, None]
        off = (p - gold).reshape(-1, 3)
        flat = features.reshape(-1, width)
        grad = np.stack(
            [np.bincount(flat.ravel(), np.repeat(off[:, k], width), BUCKETS) for k in range(3)], 1
        ) / n + ridge * weights
        grad_steps = (pair.sum((0, 1)) - gold_steps) / n + ridge * steps
        sums[0] += grad**2
        weights -= rate * grad / np.sqrt(sums[0])
        sums[1] += grad_steps**2
        steps -= rate * grad_steps / np.sqrt(sums[1])
    return Tagger(weights, steps)


def _least_of_each(ranked: DataFrame, most: int) -> DataFrame:
    """Rows (id, likely, h) among which are the `most` ids that hash lowest, of either kind.

    A task keeps so many different hashes of a kind, so all texts are looked at in one pass.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = [None, None]
        for batch in batches:
            for kind in (0, 1):
                mine = batch.filter(pc.equal(batch.column(1), bool(kind)))
                if kept[kind] is not None:
                    mine = pa.concat_batches([kept[kind], mine])
                hashes = mine.column(2).to_numpy()
                _, first = np.unique(hashes, return_index=True)
                kept[kind] = mine.take(pa.array(first[:most]))
        yield from (k for k in kept if k is not None and k.num_rows)

    return ranked.mapInArrow(keep, ranked.schema)


def train(docs: DataFrame, rows: tuple[int, int] = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Tagger:
    """Fits the field on the base spans as labels: no others are given.

    It sees windows around base spans in at most rows[0]
    documents that have a base span, and around numbers, long tokens and random
    places in these and at most rows[1] others, of at most TRAIN_BYTES each.
    The documents are those whose ids hash lowest.  Shape, neighbours and file
    features generalise from there, so that a value without its pattern is
    found too.  Without a base span anywhere nothing is tagged.
    """
    short = docs.where(docs[id_col].isNotNull() & (F.octet_length(docs[text_col]) <= TRAIN_BYTES)).select(
        docs[id_col].alias("id"), docs[text_col].alias("text")
    )
    # near the base patterns, to pick documents without leaving the JVM
    likely = F.col("text").rlike(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|[0-9a-f]{24}|AKIA""")
    ranked = short.select("id", likely.alias("likely"), F.xxhash64("id").alias("h"))
    few = materialize(_least_of_each(ranked, max(rows)))
    least = lambda kind, n: few.where(kind).select("id", "h").distinct().orderBy("h", "id").limit(n)
    chosen = least("likely", rows[0]).unionByName(least("not likely", rows[1]))
    spark = docs.sparkSession
    picked = {(r.id,) for r in chosen.select("id").collect()}
    ids = spark.createDataFrame(list(picked), chosen.select("id").schema)
    # at most sum(rows) ids, so the hint is bounded; of rows with one id, one is kept before any comes to the driver
    used = one_row_each(short.join(F.broadcast(ids), "id", "left_semi"), "id")

    def make():
        def work(texts, batch):
            found = [_windows(t or b"", i) for i, t in enumerate(texts)]
            return {"features": [f for f, _ in found], "tags": [t for _, t in found]}

        return work

    got = map_texts(used, ["id"], "text", "features array<int>, tags array<int>", make).toPandas()
    got = got.sort_values("id") if len(got) else got
    tags = np.concatenate([np.zeros(0, np.int64), *map(np.asarray, got.get("tags", []))]).astype(np.int64)
    if not (tags > 0).any():
        none = np.zeros((BUCKETS, 3))
        none[_buckets("bias"), OUT] = 1.0
        return Tagger(none, np.zeros((3, 3)))
    features = np.concatenate(list(map(np.asarray, got["features"]))).astype(np.int64)
    return fit(features.reshape(-1, WIDE, FEATURES), tags.reshape(-1, WIDE))


def scan(docs: DataFrame, tagger: Tagger, keep: list[str] = ("doc_id",), text_col: str = "text", redact: str | None = None) -> DataFrame:
    """(kept columns, spans array<struct<start, end, kind>>[, redacted]) of every whole text.

    Positions are code points, the end exclusive.  A null text has no span and
    stays null when redacted.  `redact` replaces the union of all spans.
    """
    weights = docs.sparkSession.sparkContext.broadcast((tagger.weights, tagger.steps))  # 3 BUCKETS numbers

    def make():
        own = Tagger(*weights.value)

        def work(texts, _):
            made: dict = {"spans": []}
            if redact is not None:
                made["redacted"] = []
            for utf8 in texts:
                text = utf8.decode("utf-8", "replace") if utf8 else ""
                spans = find(text, utf8, own) if utf8 else []
                made["spans"].append([{"start": a, "end": b, "kind": k} for a, b, k in spans])
                if redact is not None:
                    made["redacted"].append(None if utf8 is None else replace(text, spans, redact))
            return made

        return work

    schema = "spans array<struct<start:bigint,end:bigint,kind:string>>" + (", redacted string" if redact is not None else "")
    return map_texts(docs, list(keep), text_col, schema, make)


def replace(text: str, spans: list[Span], by: str) -> str:
    """The text with every run of overlapping spans replaced once."""
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], by]
        at = max(at, end)
    return "".join([*out, text[at:]])


def of_kind(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def describe(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of the spans as one text, in their order."""
    chosen = spans if kinds is None else of_kind(spans, *kinds)
    return F.array_join(
        F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )

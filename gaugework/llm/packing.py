"""Lexical retrieval packing: BM25 neighbours of a seed fill its window."""

from __future__ import annotations

import functools
import os
import zlib

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.llm.batches import map_texts, materialize, utf8
from gaugework.llm.vocabulary import Vocabulary, WordIds

WINDOW = 1024
END = 0
# Tails that one index holds: about this many tokens, whatever the table's size.
SHARD_TOKENS = 1 << 20
# Tokens of tails that one task packs, shard after shard.
TASK_TOKENS = 1 << 22
K1, B = 1.2, 0.75

_TAIL = "start long, length long, ids binary, near_1 long, near_2 long"
_PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> WordIds:
    """Word ids of a vocabulary file, from the library."""
    vocabulary = Vocabulary.load(path)
    singles = {label: i for i, label in enumerate(vocabulary.labels) if i not in vocabulary.special.values()}
    if all(vocabulary.labels[u] + vocabulary.labels[v] == vocabulary.labels[w] for u, v, w in vocabulary.merges) and all(
        a[2] < b[2] for a, b in zip(vocabulary.merges, vocabulary.merges[1:])
    ):
        import tiktoken

        # ids in merge order are ranks, which the faster library takes; a line is a word to it
        core = tiktoken.Encoding("own", pat_str=r"(?s:.+)", mergeable_ranks=singles, special_tokens={})
        lines = tiktoken.Encoding("lines", pat_str=r"[^\n]+|\n", mergeable_ranks=singles, special_tokens={})
        end = singles[b"\n"]

        def many(words: list[str]) -> list[bytes]:
            ids = lines.encode_to_numpy("\n".join(words), disallowed_special=()).astype("<u4")
            ends = (4 * np.flatnonzero(ids == end)).tolist()
            plain = ids.tobytes()
            return [plain[a:b] for a, b in zip([0, *[e + 4 for e in ends]], [*ends, len(plain)])]

        return WordIds(lambda word: core.encode_ordinary(word.decode("utf-8", "replace")), vocabulary, many)
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    return WordIds(
        lambda word: model.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, vocabulary
    )


def cut(docs: DataFrame, tokenizer: str, window: int, id_col: str, text_col: str, ids_too: bool) -> DataFrame:
    """One row a document: its windows that are full by themselves, and its tail.

    (id, doc_tokens, the full windows' CRCs and, if wanted, ids, the tail's
    start, length and ids, two keys that bring tails with common pairs of ids
    together).
    """

    def make():
        words = _encoder(tokenizer)
        end = np.array([END], "<u4").tobytes()

        def work(texts, _):
            made = {k: [] for k in ("doc_tokens", "full", "start", "length", "ids", "near_1", "near_2")}
            for coded in words.texts(texts):
                ids = coded + end
                count = len(ids) // 4
                full = count // window
                step = 4 * window
                tail = ids[full * step :]
                made["doc_tokens"].append(count)
                parts = [ids[i * step : (i + 1) * step] for i in range(full)]
                made["full"].append([{"crc": zlib.crc32(x), "ids": x if ids_too else None} for x in parts])
                made["start"].append(full * window)
                made["length"].append(len(tail) // 4)
                made["ids"].append(tail)
                least = _min_hash(tail)
                made["near_1"].append(least[0])
                made["near_2"].append(least[1])
            return made

        return work

    return map_texts(docs, [id_col], text_col, "doc_tokens long, full array<struct<crc:bigint,ids:binary>>, " + _TAIL, make)


def _min_hash(tail: bytes) -> tuple[int, int]:
    """Least and greatest hash of the pairs of neighbouring ids."""
    ids = np.frombuffer(tail, "<u4").astype(np.uint64)
    if len(ids) == 0:
        return 0, 0
    pairs = (ids[:-1] << np.uint64(32) | ids[1:] if len(ids) > 1 else ids) * np.uint64(0x9E3779B97F4A7C15)
    pairs ^= pairs >> np.uint64(29)
    return int(pairs.min() >> np.uint64(1)), int(pairs.max() >> np.uint64(1))


def document_frequencies(tails: DataFrame) -> tuple[np.ndarray, int, int]:
    """Over all tails: how many hold each id, their number and their tokens.

    Tasks send sums; the driver gets one number for each id of the vocabulary.
    """

    def run(batches):
        counts, slot = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        for batch in batches:
            for ids in utf8(batch, 0):
                found = np.frombuffer(ids, "<u4")
                if len(found) and found.max() >= len(counts):
                    counts, slot = (np.append(a, np.zeros(int(found.max()) + 1, np.int64)) for a in (counts, slot))
                counts[distinct(found, slot)] += 1
        ids = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts[ids])], names=["term", "n"])

    sums = tails.select("ids").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    total = tails.agg(F.count("*"), F.sum("length")).first()
    out = np.zeros(max([r.term for r in sums], default=0) + 1, np.int64)
    for r in sums:
        out[r.term] = r.n
    return out, total[0], total[1] or 0


def distinct(ids: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Each id once; `slot` is scratch space with room for all of them."""
    at = np.arange(len(ids))
    slot[ids] = at
    return ids[slot[ids] == at]


class Shard:
    """An inverted BM25 index over some tails, and the pool of unused ones."""

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, average: float):
        self.count = len(tails)
        lengths = np.array([len(t) for t in tails])
        owner = np.repeat(np.arange(self.count), lengths)
        terms, own = np.unique(np.concatenate(tails), return_inverse=True)
        self._own = np.split(own, np.cumsum(lengths)[:-1])  # the tails in numbers of terms
        self._slot = np.zeros(len(terms), np.int64)
        keys, tf = np.unique(own * self.count + owner, return_counts=True)
        term, self._doc = np.divmod(keys, self.count)
        norm = K1 * (1 - B + B * lengths / max(average, 1.0))
        self._weight = idf[terms[term]] * tf * (K1 + 1) / (tf + norm[self._doc])
        self._first = np.searchsorted(term, np.arange(len(terms) + 1))
        self.unused = np.ones(self.count, bool)

    def scores(self, tail: int, start: int = 0) -> np.ndarray:
        """BM25 of every tail for the ids of a tail from `start`; used ones get -1."""
        at = distinct(self._own[tail][start:], self._slot)
        first = self._first[at]
        size = self._first[at + 1] - first
        ends = np.cumsum(size)
        posting = np.arange(ends[-1]) + np.repeat(first - ends + size, size)
        out = np.bincount(self._doc[posting], self._weight[posting], self.count)
        out[~self.unused] = -1.0
        return out


def fill(tails: list[np.ndarray], idf: np.ndarray, average: float, window: int) -> tuple[list[list], list]:
    """Greedy windows over one shard.

    A seed's neighbours come in falling order of score (ties: the earlier one)
    and are laid behind it until the window is full.  The one that doesn't fit
    is cut, and its rest seeds the next window.  Returns the full windows, each
    a list of (tail, first, length), and the pieces of the one left open.
    """
    shard = Shard(tails, idf, average)
    windows: list[list] = []
    rest: tuple[int, int] | None = None
    next_seed = 0
    left = shard.count
    while True:
        if rest is None:
            while next_seed < shard.count and not shard.unused[next_seed]:
                next_seed += 1
            if next_seed == shard.count:
                return windows, []
            rest = (next_seed, 0)
            shard.unused[next_seed] = False
            left -= 1
        seed, first = rest
        pieces, room = [(seed, first, len(tails[seed]) - first)], window - len(tails[seed]) + first
        rest = None
        if room and left:
            scores = shard.scores(seed, first)
            wanted = min(left, 16)
            while room and left:
                best = np.argpartition(-scores, wanted - 1)[:wanted] if wanted < shard.count else np.arange(shard.count)
                best = best[np.lexsort((best, -scores[best]))]
                for near in best[scores[best] >= 0].tolist():
                    size = min(room, len(tails[near]))
                    pieces.append((near, 0, size))
                    shard.unused[near] = False
                    scores[near] = -1.0
                    left -= 1
                    room -= size
                    if not room:
                        if size < len(tails[near]):
                            rest = (near, size)
                        break
                wanted = min(left, 4 * wanted) or 1
        if room:
            return windows, pieces
        windows.append(pieces)


def pack(
    docs: DataFrame, tokenizer: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", ids: bool = False
) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) for every piece.

    Every document, closed by id 0, is cut into pieces that together fill
    sequences of `window` ids.  A document's full windows are sequences of
    their own.  Tails are dealt by a range sort on two min-hashes of their id
    pairs and then a hash of the row, so tails with common passages meet
    and any number of copies is cut into as many tasks as it needs.  A task
    packs one bounded shard after the other: it indexes the shard (document
    frequencies and average length are those of all tails), and each seed's
    best unused neighbours fill its window.  The open window of a shard is
    carried into the next one, so only the last sequence of a task is short.
    Neighbours are the best of the seed's shard, not of the table: what lies in
    another shard is no candidate (the README has the share that is lost).

    A null text is an empty document of one id.  Repeated rows are documents of
    their own; a null id stays null; an empty table gives no row.  With `ids`
    each piece comes with its ids.
    """
    rows = materialize(cut(docs, tokenizer, window, id_col, text_col, ids).withColumnRenamed(id_col, "id"))
    whole = rows.where(F.size("full") > 0).select(
        "id", "doc_tokens", F.posexplode("full").alias("nth", "own")
    )
    # sequences that are a document's own window have odd numbers, the others even ones
    whole = whole.select(
        "id",
        (F.col("nth") * F.lit(window)).cast("long").alias("start"),
        F.lit(window).cast("long").alias("length"),
        F.col("own.crc").alias("ids_crc32"),
        "doc_tokens",
        (2 * F.monotonically_increasing_id() + 1).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        *([F.col("own.ids").alias("ids")] if ids else []),
    )
    tails = rows.where("length > 0").select(
        "id", "doc_tokens", "start", "length", "ids", "near_1", "near_2", F.monotonically_increasing_id().alias("row")
    )
    seen, count, tokens = document_frequencies(tails)
    spark = docs.sparkSession
    # one number for each id of the vocabulary
    shared = spark.sparkContext.broadcast(np.log(1 + (count - seen + 0.5) / (seen + 0.5)))
    average = tokens / max(count, 1)
    tasks = max(1, -(-tokens // TASK_TOKENS))
    dealt = tails.repartitionByRange(tasks, "near_1", "near_2", F.xxhash64("id", "start", "doc_tokens", "row"))
    dealt = dealt.sortWithinPartitions("near_1", "near_2", "id", "row").select("id", "doc_tokens", "start", "ids")
    schema = f"id {rows.schema['id'].dataType.simpleString()}, {_PIECE}" + ", ids binary" * ids
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        task = pyspark.TaskContext.get().partitionId()
        idf = shared.value
        made = 0
        pool: list[tuple] = []  # (id, doc_tokens, start, ids)

        def emit(windows, pool, id_type):
            nonlocal made
            out: list[list] = [[] for _ in names]
            for pieces in windows:
                offset = 0
                number = 2 * (task << 32 | made)
                made += 1
                for tail, first, size in pieces:
                    doc, total, start, ids = pool[tail]
                    part = ids[first : first + size].tobytes()
                    for cell, value in zip(
                        out, (doc, start + first, size, zlib.crc32(part), total, number, offset, part)
                    ):
                        cell.append(value)
                    offset += size
            kinds = [id_type, *[pa.int64()] * 6, pa.binary()][: len(names)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

        id_type, held = pa.null(), 0
        for batch in batches:
            id_type = batch.schema.field(0).type
            for row in zip(*(batch.column(i).to_pylist() for i in range(3)), utf8(batch, 3)):
                ids = np.frombuffer(row[3], "<u4")
                pool.append((*row[:3], ids))
                held += len(ids)
                if held >= SHARD_TOKENS:
                    windows, left = fill([p[3] for p in pool], idf, average, window)
                    yield emit(windows, pool, id_type)
                    pool = [(pool[t][0], pool[t][1], pool[t][2] + f, pool[t][3][f : f + n]) for t, f, n in left]
                    held = sum(n for _, _, n in left)
        if pool:
            windows, left = fill([p[3] for p in pool], idf, average, window)
            yield emit([*windows, left] if left else windows, pool, id_type)

    packed = dealt.mapInArrow(run, schema)
    return whole.unionByName(packed).withColumnRenamed("id", id_col)

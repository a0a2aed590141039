"""Ranked lexical search with a document FP-tree.

The items' own terms are the vocabulary, numbered from the one most documents
hold.  A document keeps its terms of that vocabulary in this order, so documents
that share their commonest terms share a path of the tree.  Every node knows the
largest tf of each term below it, the least m and the least doc_id; the score
formula over these bounds every score below the node, and over a single document
it is the score.  An item's search goes down depth first, best child first, and
leaves out a node whose bound can't enter the ten best so far.

Two jobs over the documents' vectors: df, N and L come from all documents, then
each task builds trees over runs of its documents, of at most CELLS counts
each, and keeps an item's ten best across them; the ten best of all tasks are
ranked in Spark.  Items go in blocks of about BLOCK_BYTES of text, one search
each, so that the vocabulary that tasks hold is bounded.

A null or empty text has no terms: such a document counts nowhere, such an item
gets no rows, and an empty table gives none.  Each row is a document or an item
of its own, whether or not its id repeats or is null; a null doc_id comes last
among equal scores.  Long texts are cut into terms whole.  Only item_id, doc_id
and text are read, so further columns may have any name.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugework.llm.batches import map_texts, materialize

TOP = 10
BLOCK_BYTES = 1 << 20
# Counts held by one tree, inner nodes included.
CELLS = 8 << 20
NO_ID = 1 << 63  # sorts a null doc_id behind all others

# Bytes that end a term become spaces, A-Z become a-z; all of UTF-8 beyond ASCII stays.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def term_weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def length_part(length: int, documents: int, all_terms: int) -> int:
    return 10 + 90 * length * documents // all_terms


def _vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, length in terms, and the numbers and counts of the vocabulary's terms."""

    def make():
        known = vocabulary.__contains__

        def work(texts, batch):
            lengths, sizes, numbers, counts = [], [0], [], []
            for text in texts:
                found = terms(text)
                own = Counter(filter(known, found))
                lengths.append(len(found))
                numbers.extend(map(vocabulary.__getitem__, own))
                counts.extend(own.values())
                sizes.append(len(numbers))
            lists = lambda x: pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(x, pa.int32()))
            return {"length": lengths, "terms": lists(numbers), "counts": lists(counts)}

        return work

    return map_texts(docs, ["doc_id"], "text", "length long, terms array<int>, counts array<int>", make)


def _holding(vectors: DataFrame, size: int) -> list[int]:
    """Documents that hold each term of the vocabulary, summed in the tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, np.int64)
        for batch in batches:
            seen += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        held = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(seen[held])], ["term", "docs"])

    parts = vectors.select("terms").mapInArrow(count, "term long, docs long")
    df = [0] * size
    for term, docs in parts.groupBy("term").agg(F.sum("docs")).collect():
        df[term] = docs
    return df


class Tree:
    """FP-tree of documents: `ids`, `m`, and their (term rank, count) pairs as flat arrays.

    A unit is a document (0 to n-1) or an inner node (from n on).  Paths
    without a branch are one step, so there are fewer inner nodes than
    documents; a document hangs below the deepest node it shares with another.
    """

    def __init__(self, ids: list[int], m: list[int], starts: np.ndarray, ranks: np.ndarray, counts: np.ndarray, width: int):
        n = len(ids)
        owner = np.repeat(np.arange(n), np.diff(starts))
        order = np.lexsort((ranks, owner))
        ranks, counts = ranks[order], counts[order]
        paths = [ranks[a:b] for a, b in zip(starts[:-1], starts[1:])]
        wide = [p.astype(">u4").tobytes() for p in paths]
        self.children = self._branches(sorted(range(n), key=wide.__getitem__), paths, n)
        most = np.zeros((n + len(self.children), width), np.int32)
        most[owner, ranks] = counts
        self.m = np.array([*m, *[0] * len(self.children)], np.int64)
        self.least_id = [*ids, *[0] * len(self.children)]
        for node, below in enumerate(self.children, n):
            most[node] = most[below].max(axis=0)
            self.m[node] = self.m[below].min()
            self.least_id[node] = min(self.least_id[c] for c in below)
        self.most, self.docs = most, n

    @staticmethod
    def _branches(order: list[int], paths: list[np.ndarray], n: int) -> list[np.ndarray]:
        """Children of the inner nodes, those below first and the root last."""
        done: list[np.ndarray] = []
        stack: list[tuple[int, list[int]]] = [(0, [])]
        for place, doc in enumerate(order):
            shared = _shared(paths[doc], paths[order[place + 1]]) if place + 1 < n else 0
            unit = doc
            while stack[-1][0] > shared:
                stack[-1][1].append(unit)
                done.append(np.array(stack.pop()[1]))
                unit = n + len(done) - 1
            if stack[-1][0] == shared:
                stack[-1][1].append(unit)
            else:
                stack.append((shared, [unit]))
        done.append(np.array(stack.pop()[1]))
        return done

    def search(self, terms: np.ndarray, weights: np.ndarray, best: list[tuple[int, int]], top: int) -> None:
        """Puts the documents that belong among the `top` best into the heap of (score, -doc_id)."""
        open_nodes = [(None, self.docs + len(self.children) - 1)]
        while open_nodes:
            bound, node = open_nodes.pop()
            if bound is not None and not self._worthy(bound, node, best, top):
                continue
            below = self.children[node - self.docs]
            tf = self.most[np.ix_(below, terms)].astype(np.int64)
            bounds = (10**9 * tf // (1000 * tf + 8 * self.m[below][:, None])) @ weights
            inner = []
            for unit in np.flatnonzero(bounds >= (best[0][0] if len(best) == top else 1)).tolist():
                child, score = int(below[unit]), int(bounds[unit])
                if child >= self.docs:
                    inner.append((score, child))
                elif len(best) < top:
                    heapq.heappush(best, (score, -self.least_id[child]))
                else:
                    heapq.heappushpop(best, (score, -self.least_id[child]))
            open_nodes += sorted(inner)

    def _worthy(self, bound: int, node: int, best: list[tuple[int, int]], top: int) -> bool:
        return len(best) < top or (bound, -self.least_id[node]) > best[0]


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def _best(vectors: DataFrame, items: list[list[int]], df: list[int], totals: tuple[int, int], top: int) -> DataFrame:
    """(item, doc_id, score): each task's `top` best documents of every item."""
    documents, all_terms = totals
    width = len(df)
    by_df = sorted(range(width), key=lambda t: -df[t])
    rank = np.empty(width, np.int64)
    rank[by_df] = np.arange(width)
    weights = np.array([term_weight(documents, df[t]) for t in by_df], np.int64)
    wanted = [(i, np.sort(rank[own])) for i, own in enumerate(items) if own]
    most_docs = max(16, CELLS // max(1, 2 * width))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in wanted]
        for batch in batches:
            for start in range(0, batch.num_rows, most_docs):
                some = batch.slice(start, most_docs)
                lists = some.column(2)
                starts = lists.offsets.to_numpy().astype(np.int64)
                m = [length_part(n, documents, all_terms) for n in some.column(1).to_pylist()]
                ids = [NO_ID if i is None else i for i in some.column(0).to_pylist()]
                ranks, counts = rank[lists.flatten().to_numpy()], some.column(3).flatten().to_numpy()
                tree = Tree(ids, m, starts - starts[0], ranks, counts, width)
                for (_, own), heap in zip(wanted, best):
                    tree.search(own, weights[own], heap, top)
        rows = [(i, None if d == -NO_ID else -d, s) for (i, _), heap in zip(wanted, best) for s, d in heap]
        columns = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "doc_id", "score"])

    # A document without a term of the items scores 0.
    rows = vectors.where(F.size("terms") > 0).select(F.col("doc_id").cast("long"), "length", "terms", "counts")
    return rows.mapInArrow(search, "item long, doc_id long, score long")


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The `top` documents of every item by score, equal scores by doc_id.

    items: item_id, text.  Returns item_id, rank (from 1), doc_id, score; only
    scores above 0.
    """
    spark = docs.sparkSession
    kept = materialize(items.select("item_id", F.col("text").cast("string"), F.monotonically_increasing_id().alias("item")))
    size = kept.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    ranked = spark.createDataFrame([], f"item_id {kept.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    for block in range(blocks):
        mine = kept.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        ranked = ranked.unionByName(_rank_block(docs, mine, top))
    return ranked


def _rank_block(docs: DataFrame, items: DataFrame, top: int) -> DataFrame:
    vocabulary: dict[bytes, int] = {}
    rows, wanted = [], []
    for row in items.collect():
        own = {vocabulary.setdefault(t, len(vocabulary)) for t in terms(row.text and row.text.encode())}
        rows.append(row.item)
        wanted.append(sorted(own))
    vectors = materialize(_vectors(docs, vocabulary))
    documents, all_terms = vectors.agg(F.count_if(F.col("length") > 0), F.coalesce(F.sum("length"), F.lit(0))).first()
    df = _holding(vectors, len(vocabulary))
    found = _best(vectors, wanted, df, (documents, all_terms), top)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    place = F.row_number().over(Window.partitionBy("item").orderBy(*order))
    first = found.withColumn("rank", place).where(F.col("rank") <= top)
    named = items.select("item_id", F.col("item").alias("row"))
    numbers = docs.sparkSession.createDataFrame(list(enumerate(rows)), "item long, row long")
    return first.join(numbers, "item").join(named, "row").select("item_id", "rank", "doc_id", "score")

"""BPE encoding and decoding by a tokenization automaton."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gaugework.llm.batches import map_texts
from gaugework.llm.vocabulary import Vocabulary, WordIds

_SHIFT = 24


class Automaton:
    """Deterministic automaton over token arcs that accepts exactly the BPE result.

    It starts as one state with an arc for every byte and takes one gadget for
    each merge (u, v) -> w, in order:

    * the state behind u loses its v arc, because u v is w from now on;
    * every state that still has a u arc gets an arc w;
    * that arc ends in a new state, a copy of the one behind v as it was.

    So each token has a state of its own, a state is described by the token and
    the gadget it was made by, and an arc by the gadget it was added with.  The
    full table has some ten million missing arcs, so rows are filled in when a
    transition is first taken: `_has_arc` goes back through the gadgets that
    copied the arc and the state.  A word has one accepted path; `encode` finds
    it with the longest arc first, and a position it has left in vain is not
    entered again.
    """

    KNOWN = 1_000_000

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        labels, merges = vocabulary.labels, vocabulary.merges
        size = len(labels)
        self._born = [-1] * size
        self._left = [-1] * size
        self._right = [-1] * size
        self._lost: dict[int, int] = {}  # (state, arc) -> gadget that removed the arc
        for gadget, (u, v, w) in enumerate(merges):
            self._lost.setdefault(u << _SHIFT | v, gadget)
            if self._born[w] < 0:
                self._born[w], self._left[w], self._right[w] = gadget, u, v
        special = set(vocabulary.special.values())
        self._arcs = {label: t for t, label in enumerate(labels) if label and t not in special}
        self._step: dict[int, int] = {}  # (node << 8 | byte) -> node, over the labels of all arcs
        self._arc_at = [-1]
        for label, arc in self._arcs.items():
            node = 0
            for byte in label:
                node = self._step.setdefault(node << 8 | byte, len(self._arc_at))
                if node == len(self._arc_at):
                    self._arc_at.append(-1)
            self._arc_at[node] = arc
        self._table: dict[int, bool] = {}

    def _has_arc(self, state: int, arc: int) -> bool:
        born, lost = self._born, self._lost
        until = len(lost)
        while True:
            gadget = lost.get(state << _SHIFT | arc)
            if gadget is not None and gadget <= until:
                return False
            s, a = born[state], born[arc]
            if a > s:  # the arc was added to all states that had its left part's
                until, arc = min(until, a), self._left[arc]
            elif s > a:  # the state was copied from its right part's, before the gadget
                until, state = min(until, s - 1), self._right[state]
            elif s < 0:
                return True
            else:  # the new state and its own arc
                until, state, arc = min(until, s - 1), self._right[state], self._left[arc]

    def encode(self, word: bytes) -> list[int]:
        """Arc labels of the path that spells the word."""
        whole = self._arcs.get(word)
        if whole is not None:
            return [whole]
        step, arc_at, table, labels = self._step, self._arc_at, self._table, self.vocabulary.labels
        path: list[int] = []
        open_arcs: list[list[int]] = []  # at each position on the path, arcs not tried yet
        dead: set[int] = set()
        at, end = 0, len(word)
        rest = memoryview(word)  # its slices copy nothing
        state = -1
        while at < end:
            node = 0
            arcs: list[int] = []
            for byte in rest[at:] if at else word:
                node = step.get(node << 8 | byte)
                if node is None:
                    break
                arc = arc_at[node]
                if arc >= 0:
                    arcs.append(arc)
            while True:
                while arcs:
                    arc = arcs.pop()
                    if dead and at + len(labels[arc]) in dead:
                        continue
                    if state < 0:
                        break
                    key = state << _SHIFT | arc
                    known = table.get(key)
                    if known is None:
                        if len(table) >= self.KNOWN:
                            table.clear()
                        known = table[key] = self._has_arc(state, arc)
                    if known:
                        break
                else:  # no arc left here: go back one
                    dead.add(at)
                    at -= len(labels[path.pop()])
                    state = path[-1] if path else -1
                    arcs = open_arcs.pop()
                    continue
                break
            path.append(arc)
            open_arcs.append(arcs)
            state = arc
            at += len(labels[arc])
        return path

    def decode(self, ids: list[int]) -> bytes:
        """The bytes that the arcs emit, one after the other."""
        return b"".join(map(self.vocabulary.labels.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def automaton(path: str) -> tuple[Automaton, WordIds]:
    """One automaton a worker, with the words it has met."""
    made = Automaton(Vocabulary.load(path))
    return made, WordIds(made.encode, made.vocabulary)


def _lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    values = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def encode(
    docs: DataFrame, tokenizer: str, decoded: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, ids array<int>) of every whole text, and with `decoded` the text read back.

    Special strings inside texts become their ids.  A null text is an empty
    one and has an empty list.  Repeated rows and null ids give one row each.
    """

    def make():
        machine, words = automaton(tokenizer)

        def work(texts, _):
            ids = [np.frombuffer(words.text(t), "<u4") for t in texts]
            made: dict = {"ids": _lists(ids)}
            if decoded:
                made["decoded"] = [machine.decode(x.tolist()).decode("utf-8", "replace") for x in ids]
            return made

        return work

    return map_texts(docs, [id_col], text_col, "ids array<int>" + ", decoded string" * decoded, make)


def decode(rows: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded) for a table of id lists; null lists and unknown ids decode to nothing."""

    def run(batches):
        machine, _ = automaton(tokenizer)
        size = len(machine.vocabulary.labels)
        for batch in batches:
            lists = batch.column(1).to_pylist()
            texts = [
                machine.decode([i for i in x or () if i is not None and 0 <= i < size]).decode("utf-8", "replace")
                for x in lists
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=names)

    picked = rows.select(rows[id_col], rows[ids_col].alias("__ids"))
    names = [id_col, "decoded"]
    kind = picked.schema[id_col].dataType.simpleString()
    return picked.mapInArrow(run, f"`{id_col}` {kind}, decoded string")

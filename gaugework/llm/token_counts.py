"""Token counts: batch encoding that returns lengths only."""

from __future__ import annotations

import functools
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.llm.batches import map_texts

# Words a worker remembers; the memory is emptied when it is full.
REMEMBERED = 400_000
REMEMBERED_BYTES = 48
# Bytes of new words in one call of the library, which keeps a record for each token.
CALL_BYTES = 1 << 18


class _Lengths:
    """Token counts of words, by the library, remembered while they are short."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._encode = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            self.words = False
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self._encode = lambda texts: [
                len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)
            ]
            self.words = _drops_white_space(model)
        self._known: dict[bytes, int] = {}

    def encode(self, pieces: list[bytes]) -> list[int]:
        """Lengths of the pieces, in calls of about the same number of bytes."""
        out: list[int] = []
        call: list[str] = []
        size = 0
        for piece in pieces:
            call.append(piece.decode("utf-8", "replace"))
            size += len(piece)
            if size >= CALL_BYTES:
                out += self._encode(call)
                call, size = [], 0
        return out + self._encode(call) if call else out

    def texts(self, texts: list[bytes | None]) -> list[int]:
        if not self.words:
            return self.encode([t or b"" for t in texts])
        split = [t.split() if t else [] for t in texts]
        new = list({w for words in split for w in words}.difference(self._known))
        known = self._known
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = list({w for words in split for w in words})
        known.update(zip(new, self.encode(new)))
        counts = [sum(map(known.__getitem__, words)) for words in split]
        for w in new:
            if len(w) > REMEMBERED_BYTES:
                del known[w]
        return counts


def _drops_white_space(model) -> bool:
    """Whether ASCII white space ends every token and adds none.

    True for vocabularies whose pre-tokenizer removes white space: then a text
    may be split there, and each word encoded once.
    """
    probe = "a b\tc\nd\r\x0b\x0ce  f"
    apart = sum(len(model.encode(x, add_special_tokens=False)) for x in probe.split())
    glued = len(model.encode(probe, add_special_tokens=False))
    blank = len(model.encode(" \t\n\r\x0b\x0c", add_special_tokens=False))
    odd = [t.content for t in model.get_added_tokens_decoder().values()]
    return apart == glued and blank == 0 and not any(c.split() != [c] for c in odd)


@functools.lru_cache(maxsize=2)
def _lengths(path: str) -> _Lengths:
    return _Lengths(path)


def count_tokens(
    docs: DataFrame, tokenizer: str, limit: int | Column = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text.

    Texts are split at ASCII white space where the vocabulary drops it (no
    token, normalisation or contraction crosses it), so a text of any length is
    a sequence of short pieces; pieces not seen before by the worker go to the
    library in calls balanced by bytes, and only lengths come back.  Other
    vocabularies get whole texts, in calls balanced by bytes.  Strings of
    special tokens are handled as the library does by default.

    A null or empty text has 0 bytes and 0 tokens; repeated rows and null ids
    give one row each; an empty table gives no row.
    """
    if isinstance(limit, int):
        limit = F.lit(limit)

    def make():
        lengths = _lengths(tokenizer)
        return lambda texts, _: {
            "n_bytes": [len(t) if t else 0 for t in texts],
            "n_tokens": lengths.texts(texts),
        }

    counted = map_texts(docs, [id_col], text_col, "n_bytes long, n_tokens long", make)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

"""Byte-level BPE vocabulary files and the split of a text into words."""

from __future__ import annotations

import dataclasses
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import regex

# The split of byte-level BPE: contractions, letters, numbers, other, white space.
_ANY = regex.compile(
    r"'(?:[sdmt]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
# The same up to U+00FF, where the classes are short lists; several times faster.
_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_S = "\\t-\\r \x85\xa0"
_LATIN = re.compile(
    f" ?[{_L}]+|'(?:[sdmt]|re|ve|ll)| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
)


def split_words(text: str) -> list[str]:
    """All pieces of the text, in order; joined they are the text."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _ANY.findall(text)
    return _LATIN.findall(text)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclasses.dataclass
class Vocabulary:
    """Labels of all ids, merges as (left, right, made) in order, special strings."""

    labels: list[bytes]
    merges: list[tuple[int, int, int]]
    special: dict[str, int]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            read = json.load(file)
        model, letters = read["model"], byte_letters()
        if model["type"] != "BPE" or read["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError(f"{path} is not a byte-level BPE vocabulary")
        ids = model["vocab"]
        special = {t["content"]: t["id"] for t in read["added_tokens"]}
        labels = [b""] * (max([*ids.values(), *special.values()]) + 1)
        for token, i in ids.items():
            labels[i] = token.encode() if token in special else bytes(map(letters.__getitem__, token))
        for token, i in special.items():
            labels[i] = token.encode()
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        return cls(labels, [(ids[a], ids[b], ids[a + b]) for a, b in pairs], special)

    def parts(self, text: str) -> list[tuple[str, int | None]]:
        """The text cut at special strings, each with its id; None for ordinary parts."""
        if not any(s in text for s in self.special):
            return [(text, None)]
        longest_first = sorted(self.special, key=len, reverse=True)
        cut = re.split("(" + "|".join(map(re.escape, longest_first)) + ")", text)
        return [(p, self.special[p] if i % 2 else None) for i, p in enumerate(cut) if p]


class WordIds(dict):
    """Ids of words as little-endian 32-bit numbers, remembered while there is room.

    `encode_many`, if given, encodes a list of words without line ends at once.
    """

    ROOM = 600_000
    LONGEST = 48
    # Bytes of text whose new words are encoded together.
    RUN = 1 << 20

    def __init__(self, encode, vocabulary: Vocabulary, encode_many=None):
        self._encode, self._vocabulary, self._encode_many = encode, vocabulary, encode_many

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self._encode(word.encode("utf-8")), "<u4").tobytes()
        if len(word) <= self.LONGEST:
            if len(self) >= self.ROOM:
                self.clear()
            self[word] = ids
        return ids

    def _cut(self, text: bytes | None) -> list[list[str] | bytes]:
        """The words of a text, and between them the ids of its special strings."""
        parts = self._vocabulary.parts(text.decode("utf-8", "replace")) if text else ()
        return [split_words(part) if special is None else np.array([special], "<u4").tobytes() for part, special in parts]

    def _join(self, cut: list[list[str] | bytes]) -> bytes:
        return b"".join([x if isinstance(x, bytes) else b"".join(map(self.__getitem__, x)) for x in cut])

    def text(self, text: bytes | None) -> bytes:
        """Ids of a whole text."""
        return self._join(self._cut(text))

    def texts(self, texts: Iterable[bytes | None]) -> Iterator[bytes]:
        """Ids of whole texts; words not met before are encoded together, a run of texts at a time."""
        waiting, size = [], 0
        for text in texts:
            waiting.append(self._cut(text))
            size += len(text or b"")
            if size >= self.RUN:
                self._learn(waiting)
                yield from map(self._join, waiting)
                waiting, size = [], 0
        self._learn(waiting)
        yield from map(self._join, waiting)

    def _learn(self, run: list[list[list[str] | bytes]]) -> None:
        if self._encode_many is None:
            return
        met = set().union(*(x for cut in run for x in cut if not isinstance(x, bytes)))
        fresh = [w for w in met if w not in self]
        if len(self) + len(fresh) > self.ROOM:
            self.clear()
            fresh = list(met)
        fresh = [w for w in fresh if len(w) <= self.LONGEST and "\n" not in w]
        if fresh:
            self.update(zip(fresh, self._encode_many(fresh)))

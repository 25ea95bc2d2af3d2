"""Words of many texts at once, as arrays: hashes, their documents, byte classes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BYTES = np.arange(256)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
LETTER = ((_BYTES >= 97) & (_BYTES <= 122)) | ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 48) & (_BYTES <= 57)) | (_BYTES >= 128)
SOLID = ~((_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PREFIX = np.uint64(0xD6E8FEB86659FD93)


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Words:
    """Words of a list of texts. ``keep`` says which bytes belong to words.

    hash: 64-bit hash of each lower-cased word; doc: the text it stands in;
    first: index of the first word of each text, with the total at the end;
    starts, ends: byte positions in ``raw``, the texts joined by spaces.
    """

    def __init__(self, texts: list[str], keep: np.ndarray = LETTER):
        coded = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.raw = np.frombuffer(b" ".join(coded) + b" ", np.uint8)
        offsets = np.cumsum([0] + [len(c) + 1 for c in coded])
        inside = keep[self.raw]
        edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
        self.starts, self.ends = edges[::2], edges[1::2]
        lens = self.ends - self.starts
        chars = LOWER[self.raw[inside]]
        at = np.cumsum(lens) - lens
        powers = np.ones(int(lens.max(initial=0)) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.multiply.accumulate(np.full(len(powers) - 1, _BASE), out=powers[1:])
            place = np.arange(len(chars)) - np.repeat(at, lens)
            h = np.add.reduceat((chars.astype(np.uint64) + np.uint64(1)) * powers[place], at) if len(at) else np.zeros(0, np.uint64)
            self.hash = mixed(h)
        self.first = np.searchsorted(self.starts, offsets)
        self.first[-1] = len(self.starts)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.starts)

    def prefixes(self, least: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(words longer than n bytes, hashes of their first n) for n from ``least`` to ``most``; hashed apart from whole words."""
        at = np.flatnonzero(self.ends - self.starts > least)
        h = np.zeros(len(at), np.uint64)
        power = np.uint64(1)
        with np.errstate(over="ignore"):
            for n in range(1, most + 1):
                h += (LOWER[self.raw[self.starts[at] + n - 1]].astype(np.uint64) + np.uint64(1)) * power
                power *= _BASE
                if n >= least:
                    longer = self.ends[at] - self.starts[at] > n
                    at, h = at[longer], h[longer]
                    yield at, mixed(h ^ _PREFIX)


def hash_of(words: list[str]) -> np.ndarray:
    """Hashes of words that hold kept bytes only."""
    return Words(words).hash

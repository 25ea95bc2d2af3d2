"""Suffix stemmers as single regular expressions.

A stemmer is any callable from a word column to a stem column. ``SuffixStemmer``
strips the longest listed suffix that leaves ``min_stem`` characters, once, from
words of at least ``min_stem + 2`` characters.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Stemmer = Callable[[Column], Column]


def identity(word: Column) -> Column:
    return word


@dataclass(frozen=True)
class SuffixStemmer:
    suffixes: tuple[str, ...]
    min_stem: int = 2
    restore_y: bool = False

    def _pattern(self) -> str:
        # The lazy prefix makes the longest eligible suffix win.
        return rf"(?s)^(.{{{self.min_stem},}}?)({'|'.join(map(re.escape, sorted(set(self.suffixes))))})$"

    def __call__(self, word: Column) -> Column:
        if not self.suffixes:
            return word
        stem = F.regexp_replace(word, self._pattern(), "$1")
        if self.restore_y:
            suffix = F.regexp_extract(word, self._pattern(), 2)
            stem = F.when(suffix.isin("ied", "ies"), F.concat(stem, F.lit("y"))).otherwise(stem)
        return F.when(F.length(word) < self.min_stem + 2, word).otherwise(stem)

    def stem(self, word: str) -> str:
        """The same for one string, for vocabularies on the driver."""
        if len(word) < self.min_stem + 2 or not self.suffixes:
            return word
        if not (m := re.match(self._pattern(), word)):
            return word
        return m[1] + ("y" if self.restore_y and m[2] in ("ied", "ies") else "")

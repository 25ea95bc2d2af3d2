"""Words, n-grams and windows as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(normal: Column) -> Column:
    """Words of normalised text, whose only white space is the plain space."""
    return F.filter(F.split(normal, " "), lambda w: w != "")


def split_words(text: Column) -> Column:
    """Words of any text: splits on all Unicode white space."""
    return F.filter(F.split(text, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")


def _no_strings() -> Column:
    return F.slice(F.array(F.lit("")), 1, 0)


def word_ngrams(items: Column, n: int) -> Column:
    """Space-joined runs of n neighbouring words; empty when there are fewer."""
    grams = F.transform(F.sequence(F.lit(0), F.size(items) - n), lambda i: F.concat_ws(" ", F.slice(items, i + 1, n)))
    return F.when(F.size(items) >= n, grams).otherwise(_no_strings())


def char_ngrams(word: Column, low: int = 2, high: int = 4) -> Column:
    """All substrings of low..high characters, by length and then position."""

    def of(n: int) -> Column:
        at = F.sequence(F.lit(1), F.length(word) - n + 1)
        return F.when(F.length(word) >= n, F.transform(at, lambda i: F.substring(word, i, F.lit(n)))).otherwise(
            _no_strings()
        )

    return F.concat(*[of(n) for n in range(low, high + 1)]) if low <= high else _no_strings()


def tokenize(normal: Column) -> Column:
    w = words(normal)
    return F.struct(
        w.alias("words"), word_ngrams(w, 2).alias("bigrams"), word_ngrams(w, 3).alias("trigrams"), normal.alias("raw_normalized")
    )


def short_windows(items: Column, longest: int = 3, most: int = 5) -> Column:
    """Joined windows of 2..most neighbouring words none of which is longer than ``longest``."""

    def of(k: int) -> Column:
        wins = F.transform(F.sequence(F.lit(1), F.size(items) - k + 1), lambda i: F.slice(items, i, k))
        short = F.filter(wins, lambda win: F.forall(win, lambda w: F.length(w) <= longest))
        return F.when(F.size(items) >= k, F.transform(short, lambda win: F.array_join(win, ""))).otherwise(_no_strings())

    return F.concat(*[of(k) for k in range(2, most + 1)])

"""Code-point tables for Unicode folding, derived from ``unicodedata`` by rule.

Folding means: compatibility decomposition, removal of combining marks,
canonical composition. Only code points whose folded form can still matter
later (it holds ASCII or Bengali characters, or is empty) need an entry:
everything else is dropped by the sanitiser either way.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

# Ranges of combining marks that are deleted, and the invisible
# characters that are deleted before anything else.
MARK_RANGES = [(0x0300, 0x036F), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20FF), (0xFE20, 0xFE2F)]
INVISIBLE = "\u200b\u200c\u200d\u200e\u200f\u2060\ufeff\u00ad\u034f\u2800\u180e"

# Bengali pairs that canonical composition joins.
BENGALI_PAIRS = [("\u09c7\u09be", "\u09cb"), ("\u09c7\u09d7", "\u09cc")]


def is_mark(ch: str) -> bool:
    return any(lo <= ord(ch) <= hi for lo, hi in MARK_RANGES)


def fold(text: str) -> str:
    """Reference meaning of the folding, for tests and for building the tables."""
    kept = "".join(ch for ch in unicodedata.normalize("NFKD", text) if not is_mark(ch))
    return unicodedata.normalize("NFC", kept)


def _matters(folded: str) -> bool:
    return not folded or any(ch < "\x80" or "ঀ" <= ch <= "৿" for ch in folded)


@functools.cache
def tables() -> tuple[str, str, dict[str, str]]:
    """(characters, their one-character folds, characters that fold to several).

    Characters that fold to nothing stand at the end of the first string, past
    the length of the second: ``translate`` deletes those.
    """
    single, gone, many = {}, [], {}
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF:
            continue
        ch = chr(code)
        folded = fold(ch)
        if folded == ch or not _matters(folded):
            continue
        if not folded:
            gone.append(ch)
        elif len(folded) == 1:
            single[ch] = folded
        else:
            many[ch] = folded
    return "".join(single) + "".join(gone), "".join(single.values()), many

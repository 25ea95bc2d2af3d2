"""Masking of reported terms in the original text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"


def term_pattern(term: Column) -> Column:
    """Whole-word hits of a term in any case. Word boundaries are spelled out: engines differ on combining marks."""

    def edge(ch: Column, before: bool) -> Column:
        side = "<" if before else ""
        return F.when(ch.rlike(WORD), F.lit(f"(?{side}!{WORD})")).otherwise(F.lit(f"(?{side}={WORD})"))

    quoted = F.regexp_replace(term, r"([^\p{L}\p{N}\p{M}_\s])", r"\\$1")
    return F.concat(F.lit("(?iu)"), edge(F.substring(term, 1, 1), True), quoted, edge(F.substring(term, -1, 1), False))


def mask_terms(text: Column, terms: Column, mask: str | Column = "*") -> Column:
    """Replaces every whole-word hit of each term by the mask, once per character of the term; empty terms mask nothing.

    Terms are any words, whatever stemmer they come from. A text runs through the
    few terms it was reported for, ascending.
    """
    given = mask if isinstance(mask, Column) else F.lit(mask)
    filler = lambda t: F.regexp_replace(F.repeat(given, F.length(t)), r"([\\$])", r"\\$1")
    one = lambda acc, t: F.regexp_replace(acc, term_pattern(t), filler(t))
    return F.aggregate(F.filter(terms, lambda t: t != ""), text, one)


def sanitize(text: Column, analysis: Column, mask: str | Column = "*") -> Column:
    """The text with its reported terms masked if the analysis calls it toxic."""
    hit = F.coalesce(analysis["is_toxic"], F.lit(False))
    return F.when(hit, mask_terms(text, analysis["matched_terms"], mask)).otherwise(text)

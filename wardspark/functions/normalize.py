"""Normalisation as Catalyst expressions; nothing here leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardspark.functions import charmap

# Look-alike characters and the letters they stand for.
LEET = {
    "0": "o", "1": "i", "3": "e", "4": "u", "5": "s", "7": "t", "@": "a", "$": "s",
    "!": "i", "+": "t", "8": "b", "9": "g", "¥": "y", "€": "e", "£": "l",
}
# Further readings of two of them, tried as variants.
LEET_VARIANTS = [("leet_4a", "4", "a"), ("leet_at_u", "@", "u")]


def strip_invisible(text: Column) -> Column:
    """Deletes zero-width and other invisible characters."""
    return F.translate(text, charmap.INVISIBLE, "")


def _foreign(text: Column) -> Column:
    """The distinct characters of a text that are not ASCII."""
    return F.array_distinct(F.split(F.regexp_replace(text, r"[\x00-\x7F]+", ""), ""))


def _spelled_out(text: Column, many: dict[str, str]) -> Column:
    """Replaces the characters that fold to several; only those that a text holds are looked at."""
    keys, values = (F.split(F.lit("\0".join(x)), "\0") for x in (many.keys(), many.values()))  # a literal map of two literals
    expand = F.map_from_arrays(keys, values)
    held = F.filter(_foreign(text), lambda ch: (ch != "") & F.contains(F.lit("".join(many)), ch))
    return F.aggregate(held, text, lambda acc, ch: F.replace(acc, ch, expand[ch]))


def _composed(text: Column) -> Column:
    """Canonical order puts the nukta before the virama; then the pairs that composition joins."""
    out = F.regexp_replace(text, "(্+)(়+)", "$2$1")
    for pair, joined in charmap.BENGALI_PAIRS:
        out = F.replace(out, F.lit(pair), F.lit(joined))
    return out


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def fold_unicode(text: Column) -> Column:
    """Compatibility-decomposes, deletes combining marks, composes again. ASCII text is returned as it is."""
    chars, folds, many = charmap.tables()
    return F.when(is_ascii(text), text).otherwise(_composed(F.translate(_spelled_out(text, many), chars, folds)))


def unleet(text: Column, **changed: str) -> Column:
    """Maps look-alikes to letters; ``changed`` overrides single characters."""
    table = LEET | {k: v for k, v in changed.items()}
    return F.translate(text, "".join(table), "".join(table.values()))


def collapse_runs(text: Column) -> Column:
    """Three or more equal characters in a row become two. Only line feeds are left as they are."""
    return F.regexp_replace(text, r"(?d)(.)\1{2,}", "$1$1")


def keep_letters(text: Column) -> Column:
    """Keeps ASCII letters and digits and Bengali; space, _ and - become spaces."""
    return F.regexp_replace(F.translate(text, "_-", "  "), "[^A-Za-z0-9ঀ-৿ ]+", "")


def tidy(text: Column) -> Column:
    return F.trim(F.lower(text))


def _plain(read: Column) -> Column:
    return tidy(keep_letters(collapse_runs(read)))


def _read(text: Column, **changed: str) -> Column:
    """Invisible characters deleted, Unicode folded, look-alikes mapped: the three steps in one pass over the characters.

    The steps act on single characters but for the expansions, which come first,
    and the Bengali compositions, which look-alikes do not touch.
    """
    chars, folds, many = charmap.tables()
    table = LEET | changed
    kept, gone = chars[: len(folds)], chars[len(folds) :] + charmap.INVISIBLE
    mapped = "".join(table.get(ch, ch) for ch in folds)
    one = F.translate(_spelled_out(text, many), "".join(table) + kept + gone, "".join(table.values()) + mapped)
    return F.when(is_ascii(text), unleet(text, **changed)).otherwise(_composed(one))


def normalize(text: Column) -> Column:
    """Canonical form of a text; null stays null."""
    return _plain(_read(text))


def squeeze(normal: Column) -> Column:
    """Every run of equal characters becomes one, on normalised text."""
    return F.trim(F.regexp_replace(normal, r"(.)\1+", "$1"))


def normalize_aggressive(text: Column) -> Column:
    return squeeze(normalize(text))


def bind(value: Column, then: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once and hands it to ``then``: a let-expression."""
    return F.element_at(F.transform(F.array(value), lambda v: then(v)), 1)


def variants(text: Column, normal: Column | None = None) -> Column:
    """Array of (variant, norm): the primary form first, then other readings.

    Another reading is present only if the raw text holds its character; empty
    and repeated forms are left out, the primary one never is.
    """
    none = F.lit(None).cast("string")

    def form(name: str, norm: Column) -> Column:
        return F.struct(F.lit(name).alias("variant"), norm.alias("norm"))

    def fresh(made: Column) -> Column:
        def new(x: Column, i: Column) -> Column:
            seen = F.exists(F.slice(made, F.lit(1), i), lambda y: y["norm"].eqNullSafe(x["norm"]))
            return (i == 0) | (x["norm"].isNotNull() & (x["norm"] != "") & ~seen)

        return F.filter(made, new)

    def others(first: Column) -> Column:
        read = [form(name, F.when(F.contains(text, F.lit(c)), _plain(_read(text, **{c: to}))).otherwise(none)) for name, c, to in LEET_VARIANTS]
        return bind(F.array(form("primary", first), *read, form("aggressive", squeeze(first))), fresh)

    return bind(normalize(text) if normal is None else normal, others)

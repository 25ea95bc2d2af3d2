"""Matching and scoring, row by row, as nested column expressions: no shuffle.

The stages are gated: split-word windows are looked at only if no word matched,
near misses only if neither did; ``CASE`` is lazy, so a later stage costs
nothing where an earlier one decided. Where several listed words fit, the
smallest by code point is reported, which makes every output deterministic.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardspark.functions import tokens
from wardspark.functions.normalize import bind, normalize, variants
from wardspark.functions.stem import SuffixStemmer
from wardspark.sources.packs import Pack

SEVERITIES = ["NONE", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
THRESHOLD = 0.6


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def context_clean(word: Column, bad: Column, pack: Pack) -> Column:
    """Whether the word is a known harmless neighbour of the listed word."""
    out = F.lit(False)
    for listed, clean in sorted(pack.context_rules.items()):
        out = out | ((bad == listed) & word.isin(*sorted(clean)))
    return out


def edit_distance_le_1(a: Column, b: Column) -> Column:
    return (F.abs(F.length(a) - F.length(b)) <= 1) & (F.levenshtein(a, b, 1) >= 0)


#: Packs of more words than this are not spelled out in patterns; ``token_plan`` is the form for large packs.
SPELLED = 500


def any_of(words: Iterable[Sequence[str]]) -> str:
    """A pattern of exactly these sequences of pattern characters, as a tree: one step a character."""
    tree: dict = {}
    for word in words:
        at = tree
        for ch in word:
            at = at.setdefault(ch, {})
        at[""] = {}

    def spell(node: dict) -> str:
        ways = [ch + spell(rest) for ch, rest in sorted(node.items(), key=lambda x: (x[0] == ANY, x[0])) if ch]
        if not ways:
            return ""
        made = ways[0] if len(ways) == 1 and "" not in node else f"(?:{'|'.join(ways)})"
        return made + "?" * ("" in node)

    return spell(tree)


ANY = "[^ ]"


def one_edit(word: str) -> list[list[str]]:
    """The word and what one substitution, deletion or insertion makes of it, as pattern characters."""
    w = [re.escape(ch) for ch in word]
    out = [w]
    for i in range(len(w) + 1):
        out.append([*w[:i], ANY, *w[i:]])
        if i < len(w):
            out += [[*w[:i], ANY, *w[i + 1 :]], [*w[:i], *w[i + 1 :]]]
    return out


def _words_like(normal: Column, pattern: str) -> Column:
    return F.regexp_extract_all(normal, F.lit(f"(?<![^ ]){pattern}(?![^ ])"), F.lit(0))


def exact_candidates(normal: Column, pack: Pack) -> Column:
    """The words of a text, or only those that can be listed by word or stem: a suffix stemmer keeps the start of a word, but for a restored y."""
    if not isinstance(pack.stemmer, SuffixStemmer) or not 0 < len(pack.bad_words) <= SPELLED:
        return tokens.words(normal)
    starts = {w.removesuffix("y") if pack.stemmer.restore_y else w for w in pack.bad_words}
    short = {s for s in starts if not any(s != t and s.startswith(t) for t in starts)}
    return _words_like(normal, any_of([re.escape(ch) for ch in s] for s in short) + "[^ ]*+")


def exact_term(word: Column, pack: Pack) -> Column:
    """The stem of a word that is listed itself or by its stem; else null."""

    def of(root: Column) -> Column:
        listed = root.isin(*pack.lexicon) | word.isin(*pack.lexicon)
        bad = F.when(root.isin(*pack.lexicon), root).otherwise(word)
        return F.when(listed & ~context_clean(word, bad, pack), root)

    return bind(pack.stemmer(word), of)


def concat_term(window: Column, pack: Pack) -> Column:
    """The smallest listed word inside a joined window; else null."""
    return F.array_min(F.filter(_strings(pack.lexicon), lambda b: F.contains(window, b)))


def concat_windows(normal: Column, pack: Pack) -> Column:
    """Joined windows of short words; of runs of short words that hold no listed word when joined, none."""
    if not 0 < len(pack.bad_words) <= SPELLED:
        return tokens.short_windows(tokens.words(normal))
    runs = _words_like(normal, "[^ ]{1,3}(?: +[^ ]{1,3}(?![^ ]))++")
    held = F.filter(runs, lambda r: F.translate(r, " ", "").rlike(any_of([re.escape(ch) for ch in w] for w in pack.lexicon)))
    return F.flatten(F.transform(held, lambda r: bind(tokens.words(r), tokens.short_windows)))


def near_candidates(normal: Column, pack: Pack) -> Column:
    """The words of a text, or only those within one edit of a listed word."""
    if not 0 < len(pack.bad_words) <= SPELLED:
        return tokens.words(normal)
    return _words_like(normal, any_of(e for w in pack.bad_words for e in one_edit(w)))


def fuzzy_term(word: Column, pack: Pack) -> Column:
    """The smallest listed word within one edit of a word of 3 characters or more."""
    near = F.filter(
        _strings(pack.lexicon), lambda b: edit_distance_le_1(word, b) & ~context_clean(word, b, pack)
    )
    return F.when(F.length(word) >= 3, F.array_min(near))


def _found(items: Column, term) -> Column:
    return F.filter(F.transform(items, term), lambda t: t.isNotNull())


def match_terms(normal: Column, pack: Pack) -> Column:
    """struct(kind, terms): terms of the first stage that finds any; kind is its name or null.

    Each stage first picks the few words that can matter by one pattern over the
    whole text; only those are looked at one by one.
    """
    exact = _found(exact_candidates(normal, pack), lambda w: exact_term(w, pack))
    concat = _found(concat_windows(normal, pack), lambda x: concat_term(x, pack))
    fuzzy = _found(near_candidates(normal, pack), lambda w: fuzzy_term(w, pack))

    def kind(name: str, terms: Column) -> Column:
        return F.struct(F.lit(name).alias("kind"), terms.alias("terms"))

    def first(name: str, terms: Column, rest: Column) -> Column:
        return bind(terms, lambda t: F.when(F.size(t) > 0, kind(name, t)).otherwise(rest))

    return first("exact", exact, first("concat", concat, kind("fuzzy", fuzzy)))


def confidence(exact: Column, stemmed: Column, concat: Column, fuzzy: Column) -> Column:
    """Each signal gives base + step x count up to its cap; the largest counts."""

    def part(n: Column, base: float, step: float, cap: float) -> Column:
        return F.when(n > 0, F.least(F.lit(base) + F.lit(step) * n, F.lit(cap))).otherwise(F.lit(0.0))

    return F.greatest(
        part(exact, 0.6, 0.2, 1.0), part(stemmed, 0.5, 0.2, 0.9), part(concat, 0.5, 0.2, 0.85), part(fuzzy, 0.5, 0.15, 0.75)
    )


def severity(conf: Column) -> Column:
    return F.when(conf >= 0.9, 4).when(conf >= 0.7, 3).when(conf >= 0.4, 2).when(conf > 0.0, 1).otherwise(0)


def severity_name(level: Column) -> Column:
    return F.element_at(_strings(SEVERITIES), level + 1)


def score(kind: Column, terms: Column, threshold: Column, variant: Column) -> Column:
    """The result struct from the deciding stage and its terms."""

    def count(name: str) -> Column:
        return F.when(kind == name, F.size(terms)).otherwise(0)

    n_exact, n_concat, n_fuzzy, zero = count("exact"), count("concat"), count("fuzzy"), F.lit(0)
    conf = confidence(n_exact, zero, n_concat, n_fuzzy)
    level = severity(conf)
    return F.struct(
        (conf >= threshold).alias("is_toxic"),
        level.alias("severity"),
        severity_name(level).alias("severity_name"),
        conf.alias("confidence"),
        F.array_sort(F.array_distinct(terms)).alias("matched_terms"),
        F.struct(
            n_exact.alias("exact_match"), zero.alias("stemmed_match"), n_concat.alias("concat_match"), n_fuzzy.alias("fuzzy_match")
        ).alias("signals"),
        variant.alias("variant"),
    )


def classify(normal: Column, pack: Pack, threshold: float | Column = THRESHOLD, variant: Column | None = None) -> Column:
    """Analysis of an already normalised text."""
    threshold = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    variant = F.lit("primary") if variant is None else variant
    return bind(normal, lambda n: bind(match_terms(n, pack), lambda m: score(m["kind"], m["terms"], threshold, variant)))


def pick_variant(results: Column) -> Column:
    """The first toxic result; else the most confident, the earliest on ties."""
    ranked = F.transform(
        results,
        lambda r, i: F.struct(
            F.when(r["is_toxic"], 0).otherwise(1).alias("rank"),
            F.when(r["is_toxic"], F.lit(0.0)).otherwise(-r["confidence"]).alias("key"),
            i.alias("at"),
        ),
    )
    return F.element_at(results, F.array_min(ranked)["at"] + 1)


def with_variants(text: Column, normal: Column, primary: Column, pack: Pack, threshold: float | Column = THRESHOLD) -> Column:
    """The primary analysis if it is toxic; else the choice among it and those of the other readings."""
    others = F.slice(variants(text, normal), 2, 3)
    tried = F.transform(others, lambda v: classify(v["norm"], pack, threshold, v["variant"]))
    return F.when(primary["is_toxic"], primary).otherwise(bind(F.concat(F.array(primary), tried), pick_variant))


def analyze(text: Column, pack: Pack, threshold: float | Column = THRESHOLD) -> Column:
    """Full analysis of a raw text. Null gives null; blank text is clean."""

    def with_norm(normal: Column) -> Column:
        return bind(classify(normal, pack, threshold), lambda primary: with_variants(text, normal, primary, pack, threshold))

    return F.when(text.isNotNull(), bind(normalize(text), with_norm))

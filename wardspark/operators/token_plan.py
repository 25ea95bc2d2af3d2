"""The relational form of the analysis: every distinct word is classified once.

Words are exploded, made distinct, matched, and joined back. It trades two
shuffles for the cost of matching, which pays off for large packs, whose
near-miss search is then an equi-join on one-deletion signatures. Of rows that the
primary reading leaves clean only the other readings are matched row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspark.functions import tokens
from wardspark.functions.normalize import bind, normalize
from wardspark.operators import classify as C
from wardspark.sources.packs import Pack


def deletions(word: Column) -> Column:
    """The word and every form of it with one character deleted."""
    cut = F.transform(
        F.sequence(F.lit(1), F.length(word)),
        lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))),
    )
    return F.array_distinct(F.concat(F.array(word), F.when(F.length(word) > 0, cut).otherwise(F.array(word))))


def near_pairs(words: DataFrame, lexicon: list[str], word_col: str = "word") -> DataFrame:
    """(word, bad_word): all pairs within one edit, each once."""
    listed = words.sparkSession.createDataFrame([(b,) for b in lexicon], "bad_word string")
    left = words.select(F.col(word_col).alias("word")).select("word", F.explode(deletions(F.col("word"))).alias("sig"))
    right = listed.select("bad_word", F.explode(deletions(F.col("bad_word"))).alias("sig"))
    met = left.join(right, "sig").filter(C.edit_distance_le_1(F.col("word"), F.col("bad_word")))
    return met.select("word", "bad_word").distinct()


def near_words(words: DataFrame, pack: Pack, word_col: str = "word") -> DataFrame:
    """(word, near): smallest listed word within one edit, by a signature equi-join.

    Two words within one edit share a form with at most one character deleted.
    """
    rows = [(b, sorted(pack.context_rules.get(b, ()))) for b in pack.lexicon]
    clean = words.sparkSession.createDataFrame(rows, "bad_word string, clean array<string>")
    pairs = near_pairs(words.filter(F.length(word_col) >= 3), pack.lexicon, word_col).join(clean, "bad_word")
    return pairs.filter(~F.array_contains("clean", F.col("word"))).groupBy("word").agg(F.min("bad_word").alias("near"))


def analyze(df: DataFrame, id_col: str, text_col: str, pack: Pack, threshold: float = C.THRESHOLD) -> DataFrame:
    """(id, analysis) with the same values as the row-local plan; ids must be unique."""
    base = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("norm", normalize(F.col("text")))
    base = base.withColumn("words", tokens.words(F.col("norm")))
    spread = base.select("id", F.explode("words").alias("word"))
    vocab = spread.select("word").distinct()
    known = vocab.join(near_words(vocab, pack), "word", "left").select("word", C.exact_term(F.col("word"), pack).alias("exact"), "near")
    known = known.filter(F.col("exact").isNotNull() | F.col("near").isNotNull())
    hits = spread.join(known, "word").groupBy("id").agg(F.collect_list("exact").alias("exact"), F.collect_list("near").alias("near"))
    none = F.array().cast("array<string>")
    exact, near = F.coalesce("exact", none), F.coalesce("near", none)
    concat = F.filter(F.transform(tokens.short_windows(F.col("words")), lambda x: C.concat_term(x, pack)), lambda t: t.isNotNull())
    stage = lambda kind, terms: F.struct(F.lit(kind).alias("kind"), terms.alias("terms"))
    found = F.when(F.size(exact) > 0, stage("exact", exact)).otherwise(
        bind(concat, lambda c: F.when(F.size(c) > 0, stage("concat", c)).otherwise(stage("fuzzy", near)))
    )
    primary = bind(found, lambda m: C.score(m["kind"], m["terms"], F.lit(float(threshold)), F.lit("primary")))
    out = base.join(hits, "id", "left").withColumn("primary", primary)
    best = C.with_variants(F.col("text"), F.col("norm"), F.col("primary"), pack, threshold)
    return out.select(F.col("id").alias(id_col), F.when(F.col("text").isNotNull(), best).alias("analysis"))

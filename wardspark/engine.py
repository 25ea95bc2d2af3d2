"""The public verbs over DataFrames."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.functions.normalize import bind
from wardspark.operators import classify, mask
from wardspark.sources.packs import Pack, builtin_packs


class Engine:
    """analyze, is_toxic and sanitize for one default pack, with others by language code.

    Every verb has a column form (``*_column``), usable in any batch or streaming
    query, and a form that adds a column to a DataFrame.
    """

    def __init__(self, pack: Pack | str = "en", packs: Mapping[str, Pack] | None = None):
        self._packs = dict(builtin_packs() if packs is None else packs)
        self.default = self._packs[pack] if isinstance(pack, str) else pack
        self._packs.setdefault(self.default.code, self.default)

    # -- packs ---------------------------------------------------------------
    def register_pack(self, pack: Pack, code: str | None = None) -> None:
        self._packs[code or pack.code] = pack

    def has_pack(self, code: str) -> bool:
        return code in self._packs

    def available_languages(self) -> list[str]:
        return sorted(self._packs)

    def languages(self, spark: SparkSession) -> DataFrame:
        rows = [(code, p.name, len(p.bad_words)) for code, p in sorted(self._packs.items())]
        return spark.createDataFrame(rows, "code string, name string, words int")

    def pack(self, code: str) -> Pack:
        """The pack of a code; unknown codes get the default."""
        return self._packs.get(code, self.default)

    # -- column verbs ----------------------------------------------------------
    def analyze_column(self, text: Column, threshold: float | Column = classify.THRESHOLD) -> Column:
        return classify.analyze(text, self.default, threshold)

    def is_toxic_column(self, text: Column, threshold: float | Column = classify.THRESHOLD) -> Column:
        return self.analyze_column(text, threshold)["is_toxic"]

    def sanitize_column(self, text: Column, mask_with: str | Column = "*") -> Column:
        """Analyses at the default threshold, whatever other verbs are given."""
        return bind(self.analyze_column(text), lambda a: mask.sanitize(text, a, mask_with))

    def analyze_by_language_column(
        self, text: Column, language: Column, codes: list[str], threshold: float | Column = classify.THRESHOLD
    ) -> Column:
        """Each row by the pack of its language; other languages and null by the default pack."""
        out = None
        for code in codes:
            own = classify.analyze(text, self.pack(code), threshold)
            out = F.when(language == code, own) if out is None else out.when(language == code, own)
        rest = self.analyze_column(text, threshold)
        return rest if out is None else out.otherwise(rest)

    def sanitize_by_language_column(self, text: Column, language: Column, codes: list[str], mask_with: str | Column = "*") -> Column:
        """Each row analysed at the default threshold and masked by the pack of its language."""
        return bind(self.analyze_by_language_column(text, language, codes), lambda a: mask.sanitize(text, a, mask_with))

    # -- DataFrame verbs -------------------------------------------------------
    def analyze(self, df: DataFrame, text: str = "text", threshold: float | Column = classify.THRESHOLD, to: str = "analysis") -> DataFrame:
        return df.withColumn(to, self.analyze_column(F.col(text), threshold))

    def filter_toxic(self, df: DataFrame, text: str = "text", threshold: float | Column = classify.THRESHOLD) -> DataFrame:
        return df.filter(self.is_toxic_column(F.col(text), threshold))

    def sanitize(self, df: DataFrame, text: str = "text", mask_with: str = "*", to: str = "sanitized") -> DataFrame:
        return df.withColumn(to, self.sanitize_column(F.col(text), mask_with))

    def moderate(self, df: DataFrame) -> DataFrame:
        """Requests (text, language, threshold) to responses, as the web service answers them.

        Blank text gives an error and no analysis; an unknown or missing language
        means English, a missing threshold 0.6; confidence is rounded to 3 places.
        """
        codes = [c for c in ("en", "bn") if c in self._packs]
        limit = F.coalesce(F.col("threshold"), F.lit(classify.THRESHOLD))
        lang = F.coalesce(F.col("language"), F.lit("en"))
        english = Engine("en", self._packs)
        a = english.analyze_by_language_column(F.col("text"), lang, codes, limit)
        blank = F.col("text").isNull() | (F.regexp_replace("text", r"(?U)[\s\x1c-\x1f]+", "") == "")
        out = df.withColumn("_a", F.when(~blank, a))
        # Toxic at the threshold asked for is masked by an analysis of its own, at the default one.
        masked = F.when(F.col("_a.is_toxic"), english.sanitize_by_language_column(F.col("text"), lang, codes)).otherwise(F.col("text"))
        return out.withColumns(
            {
                "is_toxic": F.col("_a.is_toxic"),
                "severity": F.col("_a.severity_name"),
                "confidence_rounded": F.round("_a.confidence", 3),
                "matched_terms": F.col("_a.matched_terms"),
                "sanitized": F.when(~blank, masked),
                "signals": F.col("_a.signals"),
                "error": F.when(blank, F.lit("Text cannot be empty")),
            }
        ).drop("_a")

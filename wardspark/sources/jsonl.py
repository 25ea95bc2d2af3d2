"""The line protocol: one JSON request per line in, one JSON answer per line out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspark.engine import Engine
from wardspark.functions.normalize import bind
from wardspark.operators import classify

REQUEST = "command string, text string, language_code string, threshold double, mask string, _bad string"


def answer_column(line: Column, engine: Engine) -> Column:
    """The JSON answer to a request line; blank lines give null, bad ones an error.

    Requests are analysed in English unless they name Bengali, at 0.6 unless they
    say otherwise, and masked with the mask that they give, or stars.
    """
    request = F.from_json(line, REQUEST, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})

    def respond(r: Column) -> Column:
        english = Engine("en", {c: engine.pack(c) for c in ("en", "bn")})
        command = F.coalesce(r["command"], F.lit("analyze"))
        limit = F.coalesce(r["threshold"], F.lit(classify.THRESHOLD))
        code = F.coalesce(r["language_code"], F.lit("en"))
        analysis = english.analyze_by_language_column(r["text"], code, ["en", "bn"], limit)

        def analyzed(a: Column) -> Column:
            fields = [a[f].alias(f) for f in ("is_toxic", "severity", "confidence", "matched_terms")]
            return F.to_json(F.struct(*fields))

        def sanitized() -> Column:
            made = english.sanitize_by_language_column(r["text"], code, ["en", "bn"], F.coalesce(r["mask"], F.lit("*")))
            return F.to_json(F.struct(made.alias("sanitized")))

        error = lambda text: F.to_json(F.struct(text.alias("error")))
        return (
            F.when(r.isNull() | r["_bad"].isNotNull(), error(F.lit("malformed request")))
            .when(~command.isin("analyze", "sanitize"), error(F.concat(F.lit("unknown command: "), command)))
            .when(r["text"].isNull(), error(F.lit("'text'")))
            .when(command == "analyze", bind(analysis, analyzed))
            .otherwise(sanitized())
        )

    return F.when(F.trim(line) != "", bind(request, respond))


def answer(df: DataFrame, engine: Engine, line: str = "value", to: str = "response") -> DataFrame:
    """Works alike on a batch and on a stream of lines."""
    return df.withColumn(to, answer_column(F.col(line), engine))

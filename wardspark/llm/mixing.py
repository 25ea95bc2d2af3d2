"""Mixing to target weights by iterative proportional fitting; DataFrame functions only.

Documents are counted into cells of (source, language, topic) with their tokens.
Raking scales the cells' token weights to each marginal in turn until all three
agree with their targets. A document is then kept with a probability in proportion
to the raked weight over the natural share of its cell, as far as 1. The factor of
that proportion is the largest at which no marginal of the expected sample is
further than ``MISS`` from its target (half the sum of differences): cells that are
kept whole fall short, and without that bound one rare cell alone would decide how
little is kept. With a ``budget`` the factor is the one that keeps that share of all
tokens, however far the mix then is from the targets; ``marginals`` gives both.

The draw is a hash of the document id and a seed: the same documents at every run.

The targets default to shares tempered by ``power`` (1 keeps the natural mix, 0
makes all categories equal). Targets can contradict each other (a source that alone
has two languages); raking then ends unconverged with a warning that says how far
off it is, and the last marginal, topics, holds. The cell table has a row per
combination that occurs; up to ``FEW`` cells are raked in one task, more by joins.

Null source or language counts as ''; null text is empty, very long texts are counted
whole; null ids draw alike. Repeated rows are kept or left together; ties of cells
are alike in everything. Columns of the input with the names of the outputs are
replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardspark.llm import common

DIMENSIONS = ["source", "lang", "topic"]
WORD = r"[^\x20\x09-\x0D]+"
POWER, SEED, TOLERANCE, ROUNDS = 0.7, 17, 1e-6, 40
MISS, FACTORS, FEW = 0.02, 400, 500_000


def topic_of(text: Column, n_tokens: Column) -> Column:
    """A coarse genre from the text itself: its form, licence wording, or length. ``described`` takes any other function."""
    return (
        F.when(F.contains(text, F.lit(" | ")), "tabular")
        .when(text.rlike(r"[#$%&*]{3}"), "symbols")
        .when(F.contains(F.lower(text), F.lit("license")), "licence")
        .when(n_tokens < 100, "brief")
        .when(n_tokens < 1000, "article")
        .otherwise("long")
    )


def described(docs: DataFrame, topic: Callable[[Column, Column], Column] = topic_of) -> DataFrame:
    """The documents with _source, _lang, _topic and _tokens."""
    text = F.coalesce("text", F.lit(""))
    out = docs.withColumns({"_tokens": F.regexp_count(text, F.lit(WORD)).cast("long"), "_source": F.coalesce("source", F.lit("")), "_lang": F.coalesce("lang", F.lit(""))})
    return out.withColumn("_topic", topic(text, F.col("_tokens")))


def cells_of(rows: DataFrame) -> DataFrame:
    keys = [F.col(f"_{d}").alias(d) for d in DIMENSIONS]
    return rows.groupBy(*keys).agg(F.sum("_tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"))


def rake(cells: DataFrame, folder: str, targets: dict[str, DataFrame] | None = None, power: float = POWER, few: int = FEW) -> DataFrame:
    """cells with ``share`` (natural) and ``weight`` (raked); both sum to 1.

    ``targets`` may give (category, share) tables by dimension; their shares are
    normalised over the categories that occur, missing ones count as zero.
    """
    cells = common.saved(cells, f"{folder}/counted")
    many = cells.count() > few
    one = (lambda df: df) if many else (lambda df: df.coalesce(1))

    def with_sum(c: DataFrame, d: str, value: str, to: str) -> DataFrame:
        """c with the sum of a column over the cells of the same category."""
        if not many:
            return c.withColumn(to, F.sum(value).over(Window.partitionBy(d)))
        sums = c.groupBy(d).agg(F.sum(value).alias(to), F.count(F.lit(1)).alias("n"))
        return common.joined(c, common.saved(sums, common.work_dir(c.sparkSession, "marginal")), d, c.count())

    c = one(cells.filter("tokens > 0"))
    c = c.withColumn("share", F.col("tokens") / F.lit(c.agg(F.sum("tokens")).first()[0]))
    for d in DIMENSIONS:
        marginals = c.groupBy(d).agg(F.sum("share").alias("share"), F.count(F.lit(1)).alias("n"))
        if targets and d in targets:
            wanted = targets[d].select(F.col("category").alias(d), F.col("share").alias("_t"))
            marginals = marginals.join(wanted, d, "left").fillna(0.0, ["_t"])
        else:
            marginals = marginals.withColumn("_t", F.pow("share", F.lit(power)))
        marginals = common.saved(marginals, f"{folder}/target-{d}")
        total = marginals.agg(F.sum("_t")).first()[0]
        marginals = marginals.select(d, F.try_divide(F.col("_t"), F.lit(total)).alias(f"t_{d}"), "n")
        c = common.joined(c, marginals, d, c.count()) if many else one(c.join(marginals.drop("n"), d))
    c = common.saved(c.withColumn("weight", F.col("share")), f"{folder}/cells-0")
    for n in range(1, ROUNDS + 1):
        c = one(c)
        for _ in range(4):
            for d in DIMENSIONS:
                scaled = F.col("weight") * F.coalesce(F.try_divide(F.col(f"t_{d}"), F.col("_sum")), F.lit(0.0))
                c = with_sum(c, d, "weight", "_sum").withColumn("weight", scaled).drop("_sum")
                c = common.saved(c, common.work_dir(c.sparkSession, "raked")) if many else c
        c = common.saved(c, f"{folder}/cells-{n}")
        off = [F.max(F.abs(F.col(f"_m_{d}") - F.col(f"t_{d}"))).alias(d) for d in DIMENSIONS]
        sums = one(c)
        for d in DIMENSIONS:
            sums = with_sum(sums, d, "weight", f"_m_{d}")
        worst = max((x for x in sums.agg(*off).first() if x is not None), default=0.0)
        if worst < TOLERANCE:
            return c
    warnings.warn(f"raking did not converge: a marginal is {worst:.2g} off its target; the targets may contradict each other", stacklevel=2)
    return c


def on_target(cells: DataFrame, miss: float = MISS) -> DataFrame:
    """cells with ``probability`` = min(1, s x weight / share) for the largest s of a grid at which no marginal is further than ``miss`` from its target.

    The grid has ``FACTORS`` + 1 steps of equal ratio from the s at which no cell is
    kept whole, and every marginal is met, to the one at which all are.
    """
    c = cells.withColumn("_ratio", F.col("weight") / F.col("share"))
    ends = c.agg(F.max("_ratio").alias("high"), F.min(F.when(F.col("_ratio") > 0, F.col("_ratio"))).alias("low")).first()
    low, high = ends.low or 1.0, ends.high or 1.0
    step = F.explode(F.sequence(F.lit(0), F.lit(FACTORS)))
    s = F.pow(F.lit(high / low), F.col("_k") / F.lit(float(FACTORS))) / F.lit(high)
    each = c.withColumn("_k", step).withColumn("_p", F.least(F.lit(1.0), s * F.col("_ratio")))
    of = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.col(d).alias("category")) for d in DIMENSIONS]))
    sums = each.select("_k", of.alias("of"), (F.col("share") * F.col("_p")).alias("drawn"), "weight")
    sums = sums.groupBy("_k", "of").agg(F.sum("drawn").alias("drawn"), F.sum("weight").alias("weight"))
    totals = sums.groupBy("_k", F.col("of.d").alias("d")).agg(F.sum("drawn").alias("all"))
    far = sums.withColumn("d", F.col("of.d")).join(F.broadcast(totals), ["_k", "d"])  # (FACTORS + 1) x 3 rows
    far = far.groupBy("_k", "d").agg((F.sum(F.abs(F.try_divide("drawn", "all") - F.col("weight"))) / 2).alias("off"))
    k = far.groupBy("_k").agg(F.max("off").alias("off")).filter(F.col("off") <= miss).agg(F.max("_k")).first()[0] or 0
    p = F.least(F.lit(1.0), F.pow(F.lit(high / low), F.lit(k / FACTORS)) / F.lit(high) * F.col("_ratio"))
    return c.withColumn("probability", p).select(*DIMENSIONS, "share", "weight", "probability")


def calibrated(cells: DataFrame, budget: float | None = None, miss: float = MISS) -> DataFrame:
    """cells with ``probability`` = min(1, s x weight / share): ``on_target``, or s such that the expected share of tokens is ``budget``.

    For a budget, cells by falling ratio: with the first k kept whole, s follows in
    closed form; the right k is the first whose next cell stays below 1.
    """
    if budget is None:
        return on_target(cells, miss)
    whole, before = Window.partitionBy(), Window.partitionBy().orderBy(F.desc("ratio"), *DIMENSIONS)
    c = cells.coalesce(1).withColumn("ratio", F.col("weight") / F.col("share"))
    kept = F.coalesce(F.sum("share").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(before.rowsBetween(0, Window.unboundedFollowing))
    c = c.withColumn("_s", F.try_divide(F.greatest(F.lit(float(budget)) - kept, F.lit(0.0)), rest)).withColumn("_rank", F.row_number().over(before))
    fits = F.when(F.col("_s") * F.col("ratio") <= 1.0, F.struct("_rank", "_s"))
    c = c.withColumn("_fit", F.min(fits).over(whole)["_s"])
    p = F.when(F.col("_fit").isNull(), F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.col("_fit") * F.col("ratio")))
    return c.withColumn("probability", p).select(*DIMENSIONS, "share", "weight", "probability")


def marginals(cells: DataFrame) -> DataFrame:
    """(dimension, category, natural, target, achieved): shares of tokens of calibrated cells, as raked and as expected of the sample."""
    each = cells.select("share", "weight", "probability", F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("category")) for d in DIMENSIONS])).alias("of"))
    sums = each.groupBy("of.dimension", "of.category").agg(F.sum("share").alias("natural"), F.sum("weight").alias("target"), F.sum(F.col("share") * F.col("probability")).alias("drawn"))
    whole = Window.partitionBy("dimension")
    return sums.withColumn("achieved", F.try_divide("drawn", F.sum("drawn").over(whole))).drop("drawn")


def draw(doc_id: Column, seed: int = SEED) -> Column:
    """Uniform number in [0, 1) from the id: 52 bits of the MD5 of seed and id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def weighed(docs: DataFrame, targets: dict[str, DataFrame] | None = None, **how) -> DataFrame:
    """The documents with topic, n_tokens, weight, probability and selected.

    ``weight`` is the raked weight of the document's tokens over their natural
    share. Documents without tokens weigh 0 and are kept: they cost nothing.
    """
    return placed(described(docs), targets, **how)


def placed(rows: DataFrame, targets: dict[str, DataFrame] | None = None, power: float = POWER, budget: float | None = None, seed: int = SEED) -> DataFrame:
    """The same for documents that are ``described`` already."""
    folder = common.work_dir(rows.sparkSession, "mixing")
    cells = calibrated(rake(cells_of(rows), folder, targets, power), budget)
    cells = common.saved(cells, f"{folder}/probabilities")
    cells = cells.select(*[F.col(d).alias(f"_{d}") for d in DIMENSIONS], F.col("share").alias("_share"), F.col("weight").alias("_weight"), F.col("probability").alias("_p"))
    out = rows.join(cells, [f"_{d}" for d in DIMENSIONS], "left")
    p = F.coalesce("_p", F.lit(1.0))
    out = out.withColumns(
        {
            "topic": F.col("_topic"),
            "n_tokens": F.col("_tokens"),
            "weight": F.coalesce(F.col("_weight") / F.col("_share"), F.lit(0.0)),
            "probability": p,
            "selected": draw(F.col("doc_id"), seed) < p,
        }
    )
    return out.drop(*[f"_{d}" for d in DIMENSIONS], "_tokens", "_share", "_weight", "_p")


def keep_selected(docs: DataFrame, **how) -> DataFrame:
    """The selected rows with all their columns as they were, whatever these are called."""
    rows = docs.select("doc_id", "text", "source", "lang", F.struct("*").alias("_row"))
    return weighed(rows, **how).filter("selected").select("_row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is returned needs no text after the count: the described rows are written, and read for the weights."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    rows = common.saved(described(docs).drop("text"), common.work_dir(spark, "described"))
    rounded = [F.round(c, 9).alias(c) for c in ("weight", "probability")]
    return placed(rows).select("doc_id", "source", "lang", "topic", "n_tokens", *rounded, "selected")


def _sql() -> str:
    """The same in SQL: sweeps as a recursion that ends as raking does, then the grid of factors."""
    scaled = f"(SELECT * FROM raked WHERE sweep < {4 * ROUNDS} AND (sweep % 4 <> 0 OR worst >= {TOLERANCE}))"
    for d in DIMENSIONS:
        scaled = f"(SELECT * REPLACE (weight * coalesce(t_{d} / nullif(sum(weight) OVER (PARTITION BY {d}), 0), 0) AS weight) FROM {scaled})"
    # four sweeps a round, so that the end is looked for where raking looks
    off = ", ".join(f"abs(sum(weight) OVER (PARTITION BY {d}) - t_{d})" for d in DIMENSIONS)
    targets = "".join(f" JOIN (SELECT {d}, pow(sum(share), {POWER}) / sum(pow(sum(share), {POWER})) OVER () AS t_{d} FROM shares GROUP BY {d}) USING ({d})" for d in DIMENSIONS)
    keys = ", ".join(DIMENSIONS)
    far = " UNION ALL ".join(f"SELECT k, '{d}' AS d, {d} AS category, sum(share * p) AS drawn, sum(weight) AS weight FROM grid GROUP BY k, {d}" for d in DIMENSIONS)
    return f"""
WITH RECURSIVE described AS MATERIALIZED (SELECT doc_id, source, lang, coalesce(source, '') AS s_, coalesce(lang, '') AS l_,
    coalesce(text, '') AS x, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM documents),
topical AS MATERIALIZED (SELECT * EXCLUDE (x), CASE WHEN contains(x, ' | ') THEN 'tabular' WHEN regexp_matches(x, '[#$%&*]{{3}}') THEN 'symbols'
    WHEN contains(lower(x), 'license') THEN 'licence' WHEN n_tokens < 100 THEN 'brief' WHEN n_tokens < 1000 THEN 'article' ELSE 'long' END AS topic FROM described),
counted AS (SELECT s_ AS source, l_ AS lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM topical GROUP BY ALL HAVING sum(n_tokens) > 0),
shares AS MATERIALIZED (SELECT *, tokens / sum(tokens) OVER () AS share FROM counted),
raked AS (SELECT {keys}, share, {", ".join(f"t_{d}" for d in DIMENSIONS)}, share AS weight, 0 AS sweep, 1.0::DOUBLE AS worst FROM shares{targets}
  UNION ALL SELECT * EXCLUDE (off) REPLACE (sweep + 1 AS sweep, max(off) OVER () AS worst) FROM (SELECT *, greatest({off}) AS off FROM {scaled})),
ended AS MATERIALIZED (SELECT *, weight / share AS ratio FROM raked WHERE sweep = (SELECT max(sweep) FROM raked)),
ends AS (SELECT max(ratio) AS high, min(ratio) FILTER (WHERE ratio > 0) AS low FROM ended),
grid AS MATERIALIZED (SELECT ended.*, k, least(1.0, pow(high / low, k / {float(FACTORS)}) / high * ratio) AS p FROM ended, ends, (SELECT unnest(range(0, {FACTORS + 1})) AS k)),
sums AS ({far}),
far AS (SELECT k, d, sum(abs(drawn / a - weight)) / 2 AS off FROM (SELECT *, sum(drawn) OVER (PARTITION BY k, d) AS a FROM sums) GROUP BY k, d),
best AS (SELECT max(k) AS k FROM (SELECT k FROM far GROUP BY k HAVING max(off) <= {MISS})),
cells AS (SELECT {keys}, ratio, p FROM grid JOIN best USING (k))
SELECT t.doc_id, t.source, t.lang, t.topic, t.n_tokens, round(coalesce(ratio, 0), 9) AS weight, round(coalesce(p, 1), 9) AS probability,
  ('0x' || substring(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::UBIGINT::DOUBLE / {float(1 << 52)} < coalesce(p, 1) AS selected
FROM topical t LEFT JOIN cells c ON t.s_ = c.source AND t.l_ = c.lang AND t.topic = c.topic"""


SQL = _sql()

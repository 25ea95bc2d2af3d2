"""The registered queries: each applies one operator to a whole table."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.engine import Engine
from wardspark.functions import normalize as N
from wardspark.functions import tokens as K
from wardspark.functions.stem import identity
from wardspark.operators import classify as C
from wardspark.operators import token_plan
from wardspark.sources import jsonl
from wardspark.sources.packs import Pack, PackLoader, builtin_packs, lexicon_frame
from wardspark.streaming.stream import analyze_stream

Query = Callable[[SparkSession, str], DataFrame]
PACKS = builtin_packs()
CORPUS, EN = PACKS["corpus"], PACKS["en"]
#: Language codes of the corpus and the packs that serve them; others get English.
ROUTES = ["en", "es", "bn"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Evens out row-heavy work when the input is one small file; round-robin, no key."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, 1)) if df.rdd.getNumPartitions() < 4 else df


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def _text_query(made: Callable[[Column], Column]) -> Query:
    return lambda spark, d: docs(spark, d).select("doc_id", made(F.col("text")).alias("out"))


def _norm_words(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", K.words(N.normalize(F.col("text"))).alias("words"))


def _vocab(spark: SparkSession, d: str) -> DataFrame:
    return _norm_words(spark, d).select(F.explode("words").alias("word")).distinct()


def _grams(n: int) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _norm_words(spark, d).select("doc_id", F.array_join(K.word_ngrams(F.col("words"), n), "|").alias("grams"))

    return run


def normalize_variants(spark: SparkSession, d: str) -> DataFrame:
    v = docs(spark, d).select("doc_id", F.posexplode(N.variants(F.col("text"))).alias("at", "v"))
    return v.select("doc_id", "at", "v.variant", "v.norm")


def tokenize_words(spark: SparkSession, d: str) -> DataFrame:
    return _norm_words(spark, d).select("doc_id", F.size("words").alias("n_words"), F.array_join("words", "|").alias("words"))


def split_words(spark: SparkSession, d: str) -> DataFrame:
    w = K.split_words(F.col("text"))
    return docs(spark, d).select("doc_id", F.size(w).alias("n_words"), F.array_join(w, "|").alias("words"))


def char_ngrams(spark: SparkSession, d: str) -> DataFrame:
    return _vocab(spark, d).select("word", F.array_join(K.char_ngrams(F.col("word"), 2, 4), "|").alias("grams"))


def _stems(pack: str) -> Query:
    return lambda spark, d: _vocab(spark, d).select("word", PACKS[pack].stemmer(F.col("word")).alias("stem"))


def match_exact(spark: SparkSession, d: str) -> DataFrame:
    found = docs(spark, d).select("doc_id", F.explode(C.exact_candidates(N.normalize(F.col("text")), CORPUS)).alias("word"))
    found = found.withColumn("term", C.exact_term(F.col("word"), CORPUS)).filter("term is not null")
    return found.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))


#: Words put behind the documents' texts, by id, for behaviour that the corpus itself does not call up.
HARMLESS = ["class pass", "hello", "shell hell", "Grass", "helo brass", "ass"]
RUDE = [" what a $hit", " shit! 4ss", "", " DAMN it, f_u_c_k", " you bastard"]


def followed_by(extra: list[str], sep: str = "") -> Column:
    return F.concat("text", F.lit(sep), F.element_at(C._strings(extra), (F.col("doc_id") % len(extra) + 1).cast("int")))


def match_context_clean(spark: SparkSession, d: str) -> DataFrame:
    """Words that a context rule lets pass beside a listed word, and what the matcher says of the word all the same."""
    texts = docs(spark, d).select("doc_id", followed_by(HARMLESS, " ").alias("text"))
    each = texts.select("doc_id", F.explode(F.array_distinct(K.words(N.normalize(F.col("text"))))).alias("word"))
    rules = spark.createDataFrame([(w, b) for b, clean in EN.context_rules.items() for w in clean], "word string, bad_word string")
    met, word = each.join(rules, "word"), F.col("word")
    return met.select("doc_id", "word", "bad_word", C.exact_term(word, EN).alias("exact"), C.fuzzy_term(word, EN).alias("fuzzy"))


def match_concat(spark: SparkSession, d: str) -> DataFrame:
    def hits(norm: Column) -> Column:
        return F.filter(F.transform(C.concat_windows(norm, EN), lambda x: C.concat_term(x, EN)), lambda t: t.isNotNull())

    out = docs(spark, d).select("doc_id", F.explode(N.bind(N.normalize(F.col("text")), hits)).alias("term"))
    return out.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))


def match_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    near = docs(spark, d).select(F.explode(C.near_candidates(N.normalize(F.col("text")), EN)).alias("word")).distinct()
    return near.select("word", C.fuzzy_term(F.col("word"), EN).alias("term")).filter("term is not null")


def match_fuzzy_signatures(spark: SparkSession, d: str) -> DataFrame:
    return token_plan.near_words(_vocab(spark, d), EN).select("word", F.col("near").alias("term"))


def edit_distance_le_1(spark: SparkSession, d: str) -> DataFrame:
    return token_plan.near_pairs(_vocab(spark, d), EN.lexicon)


def analysis_columns(a: str = "a") -> list[Column]:
    return [
        *[F.col(f"{a}.{f}").alias(f) for f in ("is_toxic", "severity", "severity_name", "confidence", "variant")],
        F.array_join(f"{a}.matched_terms", "|").alias("terms"),
        *[F.col(f"{a}.signals.{f}").alias(f) for f in ("exact_match", "stemmed_match", "concat_match", "fuzzy_match")],
    ]


def _analyzed(*fields: str) -> Query:
    return lambda spark, d: Engine("en").analyze(docs(spark, d), to="a").select("doc_id", *[f"a.{f}" for f in fields])


def analyze_documents(spark: SparkSession, d: str) -> DataFrame:
    return Engine("en").analyze(docs(spark, d), to="a").select("doc_id", *analysis_columns())


def analyze_documents_tokens(spark: SparkSession, d: str) -> DataFrame:
    out = token_plan.analyze(docs(spark, d), "doc_id", "text", EN)
    return out.withColumnRenamed("analysis", "a").select("doc_id", *analysis_columns())


def is_toxic_filter(spark: SparkSession, d: str) -> DataFrame:
    return Engine("corpus").filter_toxic(docs(spark, d)).select("doc_id", "lang", "source")


def sanitize_documents(spark: SparkSession, d: str) -> DataFrame:
    return Engine("corpus").sanitize(docs(spark, d), mask_with="#").select("doc_id", "sanitized")


def analyze_conversations(spark: SparkSession, d: str) -> DataFrame:
    talk = spread(table(spark, d, "conversations"))
    return Engine("en").analyze(talk, to="a").select("conv_id", "turn", *analysis_columns())


def analyze_by_language(spark: SparkSession, d: str) -> DataFrame:
    a = Engine("en").analyze_by_language_column(F.col("text"), F.col("lang"), ROUTES)
    return docs(spark, d).select("doc_id", "lang", a.alias("a")).select("doc_id", "lang", *analysis_columns())


def analyze_threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    steps = F.array(*[F.lit(x) for x in (0.5, 0.6, 0.7, 0.8, 0.9)])
    a = Engine("en").analyze_column(F.col("text"), 2.0)  # beyond any confidence: the highest of all readings
    scored = docs(spark, d).select("lang", a["confidence"].alias("c")).withColumn("threshold", F.explode(steps))
    return scored.groupBy("lang", "threshold").agg(F.count_if(F.col("c") >= F.col("threshold")).alias("n_toxic"))


def toxic_by_lang_source(spark: SparkSession, d: str) -> DataFrame:
    flagged = docs(spark, d).select("lang", "source", Engine("corpus").is_toxic_column(F.col("text")).alias("t"))
    return flagged.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.count_if("t").alias("n_toxic"))


def pack_lexicon(spark: SparkSession, d: str) -> DataFrame:
    out = lexicon_frame(spark, PACKS)
    return out.select("pack", "bad_word", F.array_join("clean_words", "|").alias("clean_words"))


def list_languages(spark: SparkSession, d: str) -> DataFrame:
    return Engine("en").languages(spark)


def ipc_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a line of the protocol, by id analyze, sanitize, another command, no JSON, or blank; the answers parsed back."""
    turn, text = F.col("doc_id") % 7, followed_by(RUDE).alias("text")

    def ask(command: str) -> Column:
        return F.to_json(F.struct(F.lit(command).alias("command"), text, F.col("lang").alias("language_code"), F.lit("#").alias("mask")))

    line = F.when(turn < 3, ask("analyze")).when(turn < 5, ask("sanitize")).when(turn == 5, ask("explain"))
    line = line.otherwise(F.when(F.col("doc_id") % 2 == 0, F.lit("  ")).otherwise(F.concat(F.lit("no JSON: "), "text")))
    out = jsonl.answer(docs(spark, d).select("doc_id", line.alias("value")), Engine("en"))
    back = F.from_json("response", "is_toxic boolean, severity int, confidence double, matched_terms array<string>, sanitized string, error string")
    out = out.select("doc_id", F.col("response").isNotNull().alias("answered"), back.alias("r"))
    fields = [F.col(f"r.{f}").alias(f) for f in ("is_toxic", "severity", "confidence", "sanitized", "error")]
    return out.select("doc_id", "answered", *fields, F.array_join("r.matched_terms", "|").alias("terms"))


def moderate_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests above the default threshold, with rude words at the end; every tenth is blank."""
    text = F.when(F.col("doc_id") % 10 == 3, F.lit(" \t ")).otherwise(followed_by(RUDE))
    req = docs(spark, d).select("doc_id", text.alias("text"), F.col("lang").alias("language"), F.lit(0.7).alias("threshold"))
    out = Engine("en").moderate(req)
    signals = [F.col(f"signals.{f}_match").alias(f"{f}_match") for f in ("exact", "concat", "fuzzy")]
    return out.select("doc_id", "is_toxic", "severity", "confidence_rounded", F.array_join("matched_terms", "|").alias("terms"), "sanitized", *signals, "error")


def tokenize_struct(spark: SparkSession, d: str) -> DataFrame:
    out = docs(spark, d).select("doc_id", N.bind(N.normalize(F.col("text")), K.tokenize).alias("t"))
    lists = [F.array_join(f"t.{f}", "|").alias(f) for f in ("words", "bigrams", "trigrams")]
    return out.select("doc_id", *lists, "t.raw_normalized")


def stem_bengali(spark: SparkSession, d: str) -> DataFrame:
    """The Bengali words with each of the suffixes: no table holds Bengali."""
    words, suffixes = (spark.createDataFrame([(x,) for x in v], f"{n} string") for n, v in (("w", PACKS["bn"].lexicon), ("s", PACKS["bn"].stemmer.suffixes)))
    made = words.crossJoin(F.broadcast(suffixes)).select(F.concat("w", "s").alias("word")).distinct()
    return made.select("word", PACKS["bn"].stemmer(F.col("word")).alias("stem"))


def stem_identity(spark: SparkSession, d: str) -> DataFrame:
    return _vocab(spark, d).select("word", identity(F.col("word")).alias("stem"))


def stemmer_plugin(spark: SparkSession, d: str) -> DataFrame:
    """A user's stemmer, any function of a column, through analyze and sanitize."""
    pack = Pack("own", "Own", CORPUS.bad_words, stemmer=lambda word: F.substring(word, 1, 5))
    engine, text = Engine(pack), F.col("text")
    out = docs(spark, d).select("doc_id", engine.analyze_column(text).alias("a"), engine.sanitize_column(text).alias("sanitized"))
    return out.select("doc_id", "a.is_toxic", "a.confidence", F.array_join("a.matched_terms", "|").alias("terms"), "sanitized")


PACK_JSON = """{"language_code": "own", "language_name": "Own", "bad_words": ["trash", "worthless", "onread"],
  "context_rules": {"onread": ["onrea", "onreads"]}, "suffix_rules": ["ing", "ed", "es", "s", "ly"], "min_word_length": 3}"""


def pack_from_json(spark: SparkSession, d: str) -> DataFrame:
    """A pack in the public JSON form, loaded and used."""
    pack = PackLoader().load_json(PACK_JSON)
    return Engine(pack).analyze(docs(spark, d), to="a").select("doc_id", *analysis_columns())


def registered_pack(spark: SparkSession, d: str) -> DataFrame:
    """A pack registered under a new code at run time: its language is served by it, others by the default."""
    engine = Engine("en")
    engine.register_pack(CORPUS, "de")
    a = engine.analyze_by_language_column(F.col("text"), F.col("lang"), ["en", "de"])
    out = docs(spark, d).select("doc_id", "lang", a.alias("a"))
    return out.select("doc_id", "lang", F.lit("|".join(engine.available_languages())).alias("known"), *analysis_columns())


def label_quality_report(spark: SparkSession, d: str) -> DataFrame:
    """Extension: the corpus pack against the labels."""
    flagged = is_toxic_filter(spark, d).select("doc_id", F.lit(True).alias("flagged"))
    seen = table(spark, d, "labels").join(flagged, "doc_id", "left").fillna(False, ["flagged"])
    return seen.groupBy("toxic", "flagged").agg(F.count(F.lit(1)).alias("n"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names; a temporary one only where all tasks run on this machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or tempfile.mkdtemp()).rstrip("/")


def stream_conversations(spark: SparkSession, d: str) -> DataFrame:
    """The conversations as a stream through analyze into Parquet, read back when done."""
    static = table(spark, d, "conversations")
    root = f"{shared_folder(spark)}/stream-{spark.sql('select uuid() u').first()[0]}"
    stream = spark.readStream.schema(static.schema).parquet(f"{d}/conversations.parque[t]")
    out = analyze_stream(stream, Engine("en")).select("conv_id", "turn", F.col("analysis").alias("a")).select("conv_id", "turn", *analysis_columns())
    run = out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/at")
    run.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out")


#: Runs of every line end before the text: all but line feeds collapse.
LINE_ENDS = "a\r\r\r\r\n\n\n\x85\x85\x85\u2028\u2028\u2028\u2029\u2029\u2029b"

QUERIES: dict[str, Query] = {
    "normalize_strip_zero_width": _text_query(lambda t: N.strip_invisible(F.concat(F.lit("a​b﻿"), t, F.lit("­c")))),
    "normalize_fold_unicode": _text_query(N.fold_unicode),
    "normalize_leet": _text_query(N.unleet),
    "normalize_collapse": _text_query(lambda t: N.collapse_runs(F.concat(F.lit(LINE_ENDS), t))),
    "normalize_sanitize": _text_query(N.keep_letters),
    "normalize_full": _text_query(N.normalize),
    "normalize_aggressive": _text_query(N.normalize_aggressive),
    "normalize_variants": normalize_variants,
    "tokenize_words": tokenize_words,
    "split_words": split_words,
    "word_bigrams": _grams(2),
    "word_trigrams": _grams(3),
    "char_ngrams": char_ngrams,
    "tokenize_struct": tokenize_struct,
    "stem_english": _stems("en"),
    "stem_suffix_generic": _stems("en_json"),
    "stem_spanish": _stems("es"),
    "stem_bengali": stem_bengali,
    "stem_identity": stem_identity,
    "stemmer_plugin": stemmer_plugin,
    "match_exact": match_exact,
    "match_context_clean": match_context_clean,
    "match_concat": match_concat,
    "match_fuzzy": match_fuzzy,
    "match_fuzzy_signatures": match_fuzzy_signatures,
    "edit_distance_le_1": edit_distance_le_1,
    "signal_counts": _analyzed("signals.*"),
    "confidence": _analyzed("confidence"),
    "severity": _analyzed("severity", "severity_name"),
    "analyze_documents": analyze_documents,
    "analyze_documents_tokens": analyze_documents_tokens,
    "is_toxic_filter": is_toxic_filter,
    "sanitize_documents": sanitize_documents,
    "analyze_conversations": analyze_conversations,
    "analyze_by_language": analyze_by_language,
    "analyze_threshold_sweep": analyze_threshold_sweep,
    "toxic_by_lang_source": toxic_by_lang_source,
    "pack_lexicon": pack_lexicon,
    "list_languages": list_languages,
    "pack_from_json": pack_from_json,
    "registered_pack": registered_pack,
    "ipc_roundtrip": ipc_roundtrip,
    "moderate_requests": moderate_requests,
    "label_quality_report": label_quality_report,
    "stream_conversations": stream_conversations,
}

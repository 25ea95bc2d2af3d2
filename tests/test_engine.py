"""Cases of the reference's behaviour, as one DataFrame each."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from wardspark import Engine, PackLoader, builtin_packs
from wardspark.functions import charmap, normalize, stem, tokens
from wardspark.operators import classify, mask, token_plan
from wardspark.sources import jsonl
from wardspark.sources.packs import Pack
from wardspark.streaming import stream

BN = "কুত্তা"
CASES = [
    # text, pack, toxic, severity, confidence, terms, (exact, concat, fuzzy), variant, sanitized
    ("you are a fucking idiot", "en", True, 3, 0.8, ["fuck"], (1, 0, 0), "primary", "you are a fucking idiot"),
    ("the weather is nice today", "en", False, 0, 0.0, [], (0, 0, 0), "primary", "the weather is nice today"),
    ("you are a bastard", "en", True, 3, 0.8, ["bastard"], (1, 0, 0), "primary", "you are a *******"),
    ("hello world", "en", False, 0, 0.0, [], (0, 0, 0), "primary", "hello world"),
    ("", "en", False, 0, 0.0, [], (0, 0, 0), "primary", ""),
    ("   ", "en", False, 0, 0.0, [], (0, 0, 0), "primary", "   "),
    (BN, "bn", True, 3, 0.8, [BN], (1, 0, 0), "primary", BN),
    (BN + "রা", "bn", True, 3, 0.8, [BN], (1, 0, 0), "primary", "******রা"),
    ("বালের", "bn", True, 3, 0.8, ["বালে"], (1, 0, 0), "primary", "****র"),
    ("পাগল", "bn", True, 3, 0.8, ["পাগ"], (1, 0, 0), "primary", "পাগল"),
    ("আমি বাংলায় কথা বলি", "bn", False, 0, 0.0, [], (0, 0, 0), "primary", "আমি বাংলায় কথা বলি"),
    ("f4ck", "en", True, 3, 0.8, ["fuck"], (1, 0, 0), "primary", "f4ck"),
    ("$hit", "en", True, 3, 0.8, ["shit"], (1, 0, 0), "primary", "$hit"),
    ("f@ck1ng", "en", True, 3, 0.8, ["fuck"], (1, 0, 0), "leet_at_u", "f@ck1ng"),
    ("f.u.c.k", "en", True, 3, 0.8, ["fuck"], (1, 0, 0), "primary", "f.u.c.k"),
    ("f_u_c_k", "en", True, 3, 0.7, ["fuck"], (0, 1, 0), "primary", "f_u_c_k"),
    ("f u c k off", "en", True, 3, 0.85, ["fuck"], (0, 2, 0), "primary", "f u c k off"),
    ("a f u c k b", "en", True, 3, 0.85, ["fuck"], (0, 3, 0), "primary", "a f u c k b"),
    ("shiiit", "en", True, 2, 0.65, ["shit"], (0, 0, 1), "primary", "shiiit"),
    ("f​u​c​k", "en", True, 3, 0.8, ["fuck"], (1, 0, 0), "primary", "f​u​c​k"),
    ("FuCk", "en", True, 3, 0.8, ["fuck"], (1, 0, 0), "primary", "****"),
    ("fuck shit", "en", True, 4, 1.0, ["fuck", "shit"], (2, 0, 0), "primary", "**** ****"),
    ("class", "en", False, 0, 0.0, [], (0, 0, 0), "primary", "class"),
    ("motherfucker", "en", True, 3, 0.8, ["motherfuck"], (1, 0, 0), "primary", "motherfucker"),
    ("foo\nshit", "en", False, 0, 0.0, [], (0, 0, 0), "primary", "foo\nshit"),
    ("shit!", "en", True, 2, 0.65, ["shit"], (0, 0, 1), "primary", "****!"),
    ("good", "en", True, 2, 0.65, ["gook"], (0, 0, 1), "primary", "good"),
    ("pass", "en", True, 2, 0.65, ["piss"], (0, 0, 1), "primary", "pass"),
    ("was so", "en", True, 3, 0.7, ["ass"], (0, 1, 0), "primary", "was so"),
    ("f4@ck", "en", True, 2, 0.65, ["fuck"], (0, 0, 1), "primary", "f4@ck"),
    ("ａｓｓ", "en", True, 3, 0.8, ["ass"], (1, 0, 0), "primary", "ａｓｓ"),
    ("hello", "en_json", True, 2, 0.65, ["hell"], (0, 0, 1), "primary", "hello"),
    ("cracker", "en_json", False, 0, 0.0, [], (0, 0, 0), "primary", "cracker"),
    ("coño", "es", True, 2, 0.65, ["coño"], (0, 0, 1), "primary", "****"),
    ("puta", "es", True, 3, 0.8, ["puta"], (1, 0, 0), "primary", "****"),
    ("कुत्ता", "hi", False, 0, 0.0, [], (0, 0, 0), "primary", "कुत्ता"),
]


@pytest.mark.parametrize("pack", ["en", "bn", "en_json", "es", "hi"])
def test_analyze_and_sanitize(spark, pack):
    cases = [c for c in CASES if c[1] == pack]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "id int, text string")
    engine = Engine(pack)
    rows = engine.sanitize(engine.analyze(df)).orderBy("id").collect()
    for r, c in zip(rows, cases, strict=True):
        a, s = r.analysis, r.analysis.signals
        got = (a.is_toxic, a.severity, a.confidence, a.matched_terms, (s.exact_match, s.concat_match, s.fuzzy_match), a.variant, r.sanitized)
        assert got == c[2:], c[0]
        assert s.stemmed_match == 0


def test_null_and_threshold_column(spark):
    df = spark.createDataFrame([("good", 0.7), ("good", 0.6), (None, 0.6), ("nice", 0.0)], "text string, t double")
    got = [r.x for r in Engine("en").analyze(df, threshold=F.col("t")).select(F.col("analysis.is_toxic").alias("x")).collect()]
    assert got == [False, True, None, True]


def test_token_plan_equals_row_plan(spark):
    rows = [(i, c[0]) for i, c in enumerate(CASES)] + [(1000, None)]
    df = spark.createDataFrame(rows, "id int, text string")
    en = builtin_packs()["en"]
    a = {r.id: r.analysis for r in token_plan.analyze(df, "id", "text", en).collect()}
    b = {r.id: r.analysis for r in Engine("en").analyze(df).collect()}
    assert a == b


def test_folding_equals_unicodedata(spark):
    """On random texts the folded form agrees wherever the sanitiser looks."""
    rng = random.Random(5)
    alphabet = list("abzAB019 @$!+_-.\n\t​́ ñéÅßİ½ﬁ¥²…ａ𝐛😀কড়য়ো") + ["়", "্", "া", "ে", "য়", "ো", "ৗ"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(1500)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(normalize.keep_letters(normalize.fold_unicode(F.col("t"))).alias("x"))
    keep = lambda t: "".join(" " if c in " _-" else c for c in t if c in " _-" or (c.isascii() and c.isalnum()) or "ঀ" <= c <= "৿")
    for t, r in zip(texts, got.collect(), strict=True):
        assert r.x == keep(charmap.fold(t)), [unicodedata.name(c, hex(ord(c))) for c in t]


def test_normalize(spark):
    cases = {"f4ck": "fuck", "f@ck": "fack", "f u c k": "f u c k", "fuuu": "fuu", "fuuuuck": "fuuck", "FuCk": "fuck", "s.s.s": "sss", "½": "i2", "ﬁne": "fine", "বাংলা": "বাংলা"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r.x for r in df.select(normalize.normalize(F.col("t")).alias("x")).collect()] == list(cases.values())


def test_tokens(spark):
    df = spark.createDataFrame([("a b c d",), ("hello",), ("",)], "t string")
    w = tokens.words(F.col("t"))
    got = df.select(tokens.word_ngrams(w, 2), tokens.word_ngrams(w, 3), tokens.char_ngrams(F.lit("test"), 2, 3)).collect()
    grams = ["te", "es", "st", "tes", "est"]
    assert [tuple(r) for r in got] == [(["a b", "b c", "c d"], ["a b c", "b c d"], grams), ([], [], grams), ([], [], grams)]


def test_stems(spark):
    packs = builtin_packs()
    cases = {"fucks": "fuck", "cities": "city", "fucked": "fuck", "carried": "carry", "harmful": "harm", "hopeless": "hope", "slowly": "slow", "as": "as", "i": "i"}
    df = spark.createDataFrame([(k,) for k in cases], "w string")
    assert [r.s for r in df.select(packs["en"].stemmer(F.col("w")).alias("s")).collect()] == list(cases.values())
    assert [packs["en"].stemmer.stem(w) for w in cases] == list(cases.values())
    bn = {BN + s: BN for s in ("টাকে", "র", "কে", "রা", "টা", "টি")} | {"বি": "বি", "আ": "আ"}
    df = spark.createDataFrame([(k,) for k in bn], "w string")
    assert [r.s for r in df.select(packs["bn"].stemmer(F.col("w")).alias("s")).collect()] == list(bn.values())
    assert stem.SuffixStemmer(("ing", "ed", "s"), 2).stem("badwording") == "badword"


def test_loader(spark, tmp_path):
    text = '{"language_code": "test", "language_name": "Test", "bad_words": ["bada", "badb"], "context_rules": {"bada": ["gooda"]}, "suffix_rules": ["ed", "ing", "s"]}'
    loader = PackLoader()
    p = loader.load_json(text)
    assert (p.code, p.bad_words, p.min_word_length) == ("test", {"bada", "badb"}, 2)
    (tmp_path / "test.json").write_text(text)
    assert loader.load_file(str(tmp_path / "test.json")).bad_words == p.bad_words
    assert loader.load_dir(spark, str(tmp_path))["test"].context_rules == {"bada": frozenset({"gooda"})}
    minimal = loader.load_json('{"language_code": "m", "language_name": "M", "bad_words": ["x"]}')
    assert minimal.stemmer is stem.identity and minimal.context_rules == {}
    with pytest.raises(ValueError):
        loader.load_json('{"language_code": "m", "language_name": "M", "bad_words": "word"}')
    with pytest.raises(KeyError):
        loader.load_json('{"language_code": "m"}')
    engine = Engine("en")
    engine.register_pack(p)
    assert engine.has_pack("test") and "test" in engine.available_languages()


def test_line_protocol(spark):
    lines = ['{"text": "you are a bastard"}', '{"command": "sanitize", "text": "you are a bastard", "mask": "*"}', '{"command": "x", "text": "a"}', "nonsense", "", '{"command": "analyze"}']
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = [r.response for r in jsonl.answer(df, Engine("en")).collect()]
    assert got[0] == '{"is_toxic":true,"severity":3,"confidence":0.8,"matched_terms":["bastard"]}'
    assert got[1] == '{"sanitized":"you are a *******"}'
    assert got[2] == '{"error":"unknown command: x"}'
    assert "error" in got[3] and got[4] is None and "error" in got[5]
    more = ['{"command": "sanitize", "text": "a damn day", "mask": "$"}', '{"command": "sanitize", "text": "a nice day"}']
    got = [r.response for r in jsonl.answer(spark.createDataFrame([(x,) for x in more], "value string"), Engine("en")).collect()]
    assert got == ['{"sanitized":"a $$$$ day"}', '{"sanitized":"a nice day"}']


def test_moderate(spark):
    df = spark.createDataFrame([("you are a bastard", "xx", None), ("  ", "en", 0.6), (BN + "রা", "bn", 0.6)], "text string, language string, threshold double")
    rows = Engine("en").moderate(df).collect()
    assert (rows[0].sanitized, rows[0].severity, rows[0].error) == ("you are a *******", "HIGH", None)
    assert rows[1].error == "Text cannot be empty" and rows[1].is_toxic is None
    assert rows[2].sanitized == "******রা"


def test_moderate_masks_by_the_default_threshold(spark):
    """Toxic at the request's threshold by one reading, masked by the reading that the default threshold picks."""
    df = spark.createDataFrame([("shit! 4ss", "en", 0.8), ("good", "en", 0.7)], "text string, language string, threshold double")
    a, b = Engine("en").moderate(df).collect()
    assert a.is_toxic and a.sanitized == "****! 4ss" == Engine("en").sanitize(df.limit(1)).first().sanitized
    assert not b.is_toxic and b.sanitized == "good"


def test_any_stemmer_goes_through_all_verbs(spark):
    """A stemmer that is only a function of a column: reported stems that no list holds are masked like others."""
    pack = Pack("own", "Own", frozenset(["grumble", "a.b"]), stemmer=lambda w: F.substring(w, 1, 4))
    df = spark.createDataFrame([(t,) for t in ("you grumble today", "Grum, grum! grumblers", "nothing", None)], "text string")
    rows = Engine(pack).sanitize(Engine(pack).analyze(df)).collect()
    assert [r.analysis and r.analysis.is_toxic for r in rows] == [True, False, False, None]
    assert rows[0].analysis.matched_terms == ["grum"] and [r.sanitized for r in rows] == ["you grumble today", "Grum, grum! grumblers", "nothing", None]
    masked = df.select(mask.mask_terms(F.col("text"), F.array(F.lit("grum"), F.lit("")), "$1")).collect()
    assert [r[0] for r in masked] == ["you grumble today", "$1$1$1$1, $1$1$1$1! grumblers", "nothing", None]


def test_collapse_leaves_line_feeds(spark):
    cases = {"a\r\r\rb": "a\r\rb", "a\n\n\nb": "a\n\n\nb", "\x85\x85\x85": "\x85\x85", "\u2028" * 4: "\u2028" * 2, "xxxx": "xx"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r[0] for r in df.select(normalize.collapse_runs(F.col("t"))).collect()] == list(cases.values())


def test_one_pass_equals_the_steps(spark):
    """Normalisation in one pass over the characters is the same as its steps one after the other."""
    rng = random.Random(9)
    alphabet = list("abzAB0134578 @$!+_-.\n\t¥€£​́ ñéÅßİ½ﬁ¥²…＠４＄ａ𝐛😀কড়য়ো") + ["়", "্", "া", "ে", "য়", "ৗ"]
    df = spark.createDataFrame([("".join(rng.choices(alphabet, k=rng.randint(0, 30))),) for _ in range(1500)], "t string")
    t = F.col("t")
    steps = normalize.tidy(normalize.keep_letters(normalize.collapse_runs(normalize.unleet(normalize.fold_unicode(normalize.strip_invisible(t))))))
    assert df.filter(~steps.eqNullSafe(normalize.normalize(t))).count() == 0


def test_patterns_pick_what_word_by_word_matching_finds(spark):
    """Candidates by pattern against every word, for texts near the lists, and for packs too large for patterns."""
    rng, en = random.Random(10), builtin_packs()["en"]

    def near(w):
        k = rng.randrange(len(w) + 1)
        return rng.choice([w, w[:k] + rng.choice("abeks") + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice("abeks") + w[k + 1 :], w + rng.choice(["ing", "ies", "s", "x"]), " ".join(w)])

    texts = [" ".join(rng.choice([near(rng.choice(en.lexicon)), rng.choice(["the", "was so", "of a", "weather", "in it"])]) for _ in range(rng.randint(1, 4))) for _ in range(1500)]
    large = Pack("large", "Large", en.bad_words | {f"zzqx{i}zzqx" for i in range(600)}, en.context_rules, en.stemmer)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    a, b = (classify.classify(F.col("t"), p) for p in (en, large))
    rows = df.select(a.alias("a"), b.alias("b")).collect()
    assert all(r.a == r.b for r in rows) and {r.a.severity for r in rows} == {0, 2, 3, 4}


def test_windowed_stream(spark, tmp_path):
    """Counts per window and key; rows later than the watermark are dropped, windows close behind it."""
    rows = [("2024-01-01 00:01:00", "a", "you bastard"), ("2024-01-01 00:02:00", "a", "a nice day"), ("2024-01-01 00:03:00", "b", None), ("2024-01-01 00:07:00", "a", "fuck")]
    late = [("2024-01-01 01:00:00", "a", "hello"), ("2024-01-01 00:04:00", "a", "bastard")]
    schema = "at string, room string, text string"
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    counts = stream.toxicity_per_window(source.withColumn("at", F.to_timestamp("at")), Engine("en"), "at", ["room"])
    run = counts.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
    for some in (rows, late, [("2024-01-01 00:02:30", "a", "shit")], [("2024-01-01 02:00:00", "b", "x")]):
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        run.start().awaitTermination()
    got = sorted((str(r.window_start)[11:16], r.room, r.n, r.n_toxic) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("00:00", "a", 3, 2), ("00:00", "b", 1, 0), ("00:05", "a", 1, 1), ("01:00", "a", 1, 0)]


def test_severity_bounds(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.1, 0.4, 0.7, 0.9)], "c double")
    assert [r.s for r in df.select(classify.severity(F.col("c")).alias("s")).collect()] == [0, 1, 2, 3, 4]

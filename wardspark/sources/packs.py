"""Language packs: fixed word lists, the JSON loader and its validation."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from wardspark.functions.stem import Stemmer, SuffixStemmer, identity

PACK_SCHEMA = T.StructType(
    [
        T.StructField("language_code", T.StringType()),
        T.StructField("language_name", T.StringType()),
        T.StructField("bad_words", T.ArrayType(T.StringType())),
        T.StructField("context_rules", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
        T.StructField("min_word_length", T.IntegerType()),
        T.StructField("suffix_rules", T.ArrayType(T.StringType())),
    ]
)


@dataclass(frozen=True)
class Pack:
    """What the matcher needs to know of one language; small and kept on the driver."""

    code: str
    name: str
    bad_words: frozenset[str]
    context_rules: Mapping[str, frozenset[str]] = field(default_factory=dict)
    stemmer: Stemmer = identity
    min_word_length: int = 2

    @property
    def lexicon(self) -> list[str]:
        return sorted(self.bad_words)


class PackLoader:
    """Reads packs in the public JSON form.

    Empty words and suffixes are refused: an empty word would match everything
    and an empty suffix would erase words. ``bad_words`` must be a list.
    """

    def load_file(self, path: str, stemmer: Stemmer | None = None) -> Pack:
        with open(path, encoding="utf-8") as f:
            return self.from_dict(json.load(f), stemmer)

    def load_json(self, text: str, stemmer: Stemmer | None = None) -> Pack:
        return self.from_dict(json.loads(text), stemmer)

    def load_dir(self, spark: SparkSession, path: str) -> dict[str, Pack]:
        """Packs of a folder that Spark can read; packs are few and small."""
        rows = spark.read.option("multiLine", True).schema(PACK_SCHEMA).json(path).collect()
        packs = [self.from_dict({k: v for k, v in r.asDict(True).items() if v is not None}) for r in rows]
        return {p.code: p for p in packs}

    def from_dict(self, data: dict, stemmer: Stemmer | None = None) -> Pack:
        words, suffixes = data["bad_words"], data.get("suffix_rules", [])
        if isinstance(words, str) or isinstance(suffixes, str):
            raise ValueError("bad_words and suffix_rules must be lists")
        if "" in words or "" in suffixes:
            raise ValueError("bad_words and suffix_rules must not hold empty strings")
        if stemmer is None:
            stemmer = SuffixStemmer(tuple(suffixes)) if suffixes else identity
        rules = {k: frozenset(v) for k, v in data.get("context_rules", {}).items()}
        return Pack(
            data["language_code"], data["language_name"], frozenset(words), rules, stemmer, data.get("min_word_length", 2)
        )


def lexicon_frame(spark: SparkSession, packs: Mapping[str, Pack]) -> DataFrame:
    """(pack, bad_word, clean_words): the packs as a table, one row per listed word."""
    rows = [
        (code, word, sorted(p.context_rules.get(word, ()))) for code, p in sorted(packs.items()) for word in p.lexicon
    ]
    return spark.createDataFrame(rows, "pack string, bad_word string, clean_words array<string>")


# ---- Fixed values: the word lists, suffixes and context rules of the packs. ----
EN_WORDS = """
    fuck shit ass asshole bastard damn hell crap piss dick cock pussy tits
    nigger nigga spic chink kike wetback cracker honky gook towelhead
    faggot fag dyke homo queer tranny shemale retard retarded cripple spastic
    motherfucker cocksucker bullshit
""".split()
EN_SUFFIXES = """
    ification fulness ousness iveness ation ition ness ment able ible tion sion ence ance
    ating izing ifying ening ing ied ies ful less ous ive ial ual ly er est
    sses shes ches xes zes ies ves ed es s
""".split()
EN_CONTEXT = {"ass": "class grass bass brass mass pass".split(), "hell": "hello shell hellen helo".split()}
EN_JSON_WORDS = """
    fuck shit ass asshole bastard damn hell crap piss dick cock pussy tits
    nigger nigga spic chink kike wetback faggot fag dyke homo queer tranny
    retard retarded cripple motherfucker cocksucker bullshit
""".split()
EN_JSON_SUFFIXES = """
    ation ition ness ment able ible tion sion ence ance ing ied ies ful less ous ive ly er est ed es s
""".split()
EN_JSON_CONTEXT = {"ass": "class grass bass brass mass pass".split()}
BN_WORDS = """
    মাদার ভোদ বোনিয়া পোঁদ গাধা পাগল হারামি হারাম কুত্তা কুকুর শুয়োর পোড়া
    বেশ্যা পতিতা রান্ডি খানকি মাগি চুদ চোদ চুদি চোদন চুদাচুদি বাল বালদের বালের
    মুর্গা পোকা জন্তু মাদারচোদ বোনের মায়ের বাপের
""".split()
BN_SUFFIXES = """
    টাকে টির টার টাত টিত গুলোকে গুলোর গুলোত গুলো দেরকে দেরের দেরত দের রা গণ বৃন্দ
    ছিলাম ছিলে ছিলো ছিল ছি ছে ছো ছোঁ বেন বে বো ব লাম লে লো ল ন্তি ন্তে ন্তো ন্ত
    য়ে য়ো য় কে রা র তে ত য়ে য় ে ও টা টি টো ময় সুল পূর্ণ শীল
""".split()
BN_JSON_SUFFIXES = """
    টাকে টির টার টাত টিত গুলোকে গুলোর গুলোত গুলো দেরকে দেরের দেরত দের রা গণ বৃন্দ
    ছিলাম ছিলে ছিলো ছিল ছি ছে ছো ছোঁ বেন বে বো ব লাম লে লো ল ন্তি ন্তে ন্তো ন্ত
    য়ে য়ো য় কে রা র তে ত য়ে য় ে ও টা টি টো
""".split()
ES_WORDS = """
    puta mierda joder coño pendejo cabrón chinga estúpido idiota imbecil
    maldito hijueputa marica maricón puto
""".split()
ES_SUFFIXES = "ción siones mente ado ida ando iendo oso osa osos osas ito ita itos itas es s é ía".split()
HI_WORDS = "मादर भोसडी बहन बहनचोद गांड लौंडा कमीना साला हरामी कुत्ता सूअर बेशर्म रांड खानकी मागी".split()
HI_SUFFIXES = "ों े ा ी ीं ता ते ती ना ने नी या ए एं".split()
HI_CONTEXT = {"कुत्ता": "पिल्ला बच्चा".split()}
# ---- End of the fixed values. ----

# Our own pack: the ten insults that the test corpus uses.
CORPUS_WORDS = "trash pathetic idiot worthless disgusting stupid clown loser scum moron".split()


def _pack(code: str, name: str, words: list[str], suffixes: list[str], context: dict | None = None, **how) -> Pack:
    rules = {k: frozenset(v) for k, v in (context or {}).items()}
    return Pack(code, name, frozenset(words), rules, SuffixStemmer(tuple(dict.fromkeys(suffixes)), **how))


def builtin_packs() -> dict[str, Pack]:
    """The shipped packs; ``*_json`` are the public JSON forms, which differ from the code packs."""
    return {
        "en": _pack("en", "English", EN_WORDS, EN_SUFFIXES, EN_CONTEXT, min_stem=3, restore_y=True),
        "bn": _pack("bn", "বাংলা (Bengali)", BN_WORDS, BN_SUFFIXES),
        "en_json": _pack("en", "English", EN_JSON_WORDS, EN_JSON_SUFFIXES, EN_JSON_CONTEXT),
        "bn_json": _pack("bn", "বাংলা (Bengali)", BN_WORDS, BN_JSON_SUFFIXES),
        "es": _pack("es", "Español (Spanish)", ES_WORDS, ES_SUFFIXES),
        "hi": _pack("hi", "हिन्दी (Hindi)", HI_WORDS, HI_SUFFIXES, HI_CONTEXT),
        "corpus": _pack("corpus", "Test corpus", CORPUS_WORDS, EN_SUFFIXES, min_stem=3, restore_y=True),
    }

"""DuckDB SQL with the results of the registered queries, written independently of Spark's plans.

The word lists of the packs are taken from them; all tables and rules are
written out here.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

from wardspark.sources.packs import BN_SUFFIXES, Pack, builtin_packs

PACKS = builtin_packs()
ROUTES = ["en", "es", "bn"]
# Deleted characters, deleted marks, look-alikes and what they stand for.
INVISIBLE = "".join(map(chr, [*range(0x200B, 0x2010), 0x2060, 0xFEFF, 0xAD, 0x34F, 0x2800, 0x180E]))
MARKS = {*range(0x300, 0x370), *range(0x1AB0, 0x1B00), *range(0x1DC0, 0x1E00), *range(0x20D0, 0x2100), *range(0xFE20, 0xFE30)}
LOOKS, LETTERS = "013457@$!+89¥€£", "oieustasitbgyel"


@functools.cache
def foldings() -> dict[str, str]:
    """What each character becomes by NFKD, without the marks, and NFC, where that is another thing and leaves ASCII, Bengali or nothing."""
    out = {}
    for ch in map(chr, (*range(0x80, 0xD800), *range(0xE000, sys.maxunicode + 1))):
        kept = "".join(x for x in unicodedata.normalize("NFKD", ch) if ord(x) not in MARKS)
        made = unicodedata.normalize("NFC", kept)
        if made != ch and (not made or re.search("[\x00-\x7f\u0980-\u09ff]", made)):
            out[ch] = made
    return out


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strings(values) -> str:
    return "[" + ", ".join(map(q, values)) + "]" if values else "[]::VARCHAR[]"


def strip_invisible(x: str) -> str:
    return f"translate({x}, {q(INVISIBLE)}, '')"


def fold_ctes() -> str:
    """CTEs from zw(id, text, x) to f(id, text, x); characters that fold to several are joined in."""
    every = foldings()
    many = {k: v for k, v in every.items() if len(v) > 1}
    single = sorted((k for k in every if len(every[k]) < 2), key=lambda k: -len(every[k]))  # those that vanish stand last
    chars, folds = "".join(single), "".join(every[k] for k in single)
    pairs = ", ".join(f"({q(k)}, {q(v)})" for k, v in many.items())
    return f"""several AS (SELECT * FROM (VALUES {pairs}) AS t(ch, folded)),
    touched AS (SELECT id, x FROM zw WHERE length(translate(x, {q(''.join(many))}, '')) <> length(x)),
    chars AS (SELECT id, i, string_split(x, '')[i] AS ch FROM touched, unnest(range(1, length(x) + 1)) AS t(i)),
    spelled AS MATERIALIZED (SELECT id, string_agg(coalesce(folded, ch), '' ORDER BY i) AS s FROM chars LEFT JOIN several USING (ch) GROUP BY id),
    f AS MATERIALIZED (SELECT zw.id, zw.text, translate(coalesce(s, x), {q(chars)}, {q(folds)}) AS x FROM zw LEFT JOIN spelled USING (id))"""


def leet(x: str, **changed: str) -> str:
    to = "".join(changed.get(a, b) for a, b in zip(LOOKS, LETTERS, strict=True))
    return f"translate({x}, {q(LOOKS)}, {q(to)})"


def collapse(x: str, keep: int = 2) -> str:
    """Runs of more than ``keep`` equal characters become ``keep``; line feeds are left as they are.

    Each character is zipped with those before it: a lambda must not index the whole list.
    """
    cs = f"string_split({x}, '')"
    before = ", ".join(f"[{', '.join([chr(39) * 2] * k)}] || {cs}" for k in range(1, keep + 1))
    same = " AND ".join(f"t[1] = t[{k + 1}]" for k in range(1, keep + 1))
    ends = "t[1] = chr(10)"
    kept = f"list_filter(list_zip({cs}, {before}), lambda t: t[1] IS NOT NULL AND NOT ({same} AND NOT {ends}))"
    return f"array_to_string(list_transform({kept}, lambda t: t[1]), '')"


def keep_letters(x: str) -> str:
    return f"regexp_replace(translate({x}, '_-', '  '), '[^A-Za-z0-9\\x{{980}}-\\x{{9FF}} ]', '', 'g')"


#: Each step a CTE, so that no expression is repeated inside another.
def norm_ctes(source: str, leets: dict[str, dict] | None = None) -> str:
    """CTEs ending in forms(id, vi, variant, norm) for source(id, text)."""
    out = [f"src AS ({source})", f"zw AS (SELECT id, text, {strip_invisible('text')} AS x FROM src)", fold_ctes()]
    for name, changed in {"p": {}, **(leets or {})}.items():
        out.append(f"l_{name} AS MATERIALIZED (SELECT id, text, {leet('x', **changed)} AS x FROM f)")
        out.append(f"c_{name} AS MATERIALIZED (SELECT id, text, {collapse('x')} AS x FROM l_{name})")
        out.append(f"n_{name} AS MATERIALIZED (SELECT id, text, trim(lower({keep_letters('x')})) AS x FROM c_{name})")
    return ", ".join(out)


ALL_FORMS = {"a4": {"4": "a"}, "au": {"@": "u"}}
FORMS = f"""forms AS MATERIALIZED (
  WITH every AS (
    SELECT id, 0 AS vi, 'primary' AS variant, x AS norm FROM n_p
    UNION ALL SELECT id, 1, 'leet_4a', x FROM n_a4 WHERE contains(text, '4')
    UNION ALL SELECT id, 2, 'leet_at_u', x FROM n_au WHERE contains(text, '@')
    UNION ALL SELECT id, 3, 'aggressive', trim({collapse('x', 1)}) FROM n_p)
  SELECT * FROM every e WHERE vi = 0 OR (norm <> '' AND NOT EXISTS (
    SELECT 1 FROM every o WHERE o.id = e.id AND o.vi < e.vi AND o.norm = e.norm)))"""


def stem(w: str, pack: Pack) -> str:
    s = pack.stemmer
    if not hasattr(s, "suffixes"):
        return f"substring({w}, 1, 5)"
    pattern = q(f"^(.{{{s.min_stem},}}?)({'|'.join(map(re.escape, sorted(s.suffixes)))})$")
    cut = f"regexp_extract({w}, {pattern}, 1)"
    y = f"CASE WHEN regexp_extract({w}, {pattern}, 2) IN ('ied', 'ies') THEN 'y' ELSE '' END" if s.restore_y else "''"
    return f"CASE WHEN length({w}) < {s.min_stem + 2} OR NOT regexp_matches({w}, {pattern}) THEN {w} ELSE {cut} || {y} END"


def clean(w: str, b: str, pack: Pack) -> str:
    pairs = [f"({b} = {q(k)} AND {w} IN ({', '.join(map(q, sorted(v)))}))" for k, v in pack.context_rules.items()]
    return "(" + " OR ".join(pairs or ["false"]) + ")"


WORDS = "list_filter(string_split(norm, ' '), lambda w: w <> '')"


def match_ctes(pack: Pack) -> str:
    """CTEs from forms(id, vi, norm) to per-form hits of the three stages, not gated yet.

    DuckDB's levenshtein counts bytes, so letters outside ASCII, which no word of
    the tables holds, stand as one byte that no word holds either.
    """
    lex = strings(pack.lexicon)
    windows = " UNION ALL ".join(
        f"SELECT id, vi, {k} AS k, i, array_to_string(ws[i:i + {k - 1}], '') AS x FROM lists, unnest(range(1, len(ws) - {k} + 2)) AS t(i)"
        f" WHERE len(list_filter(ws[i:i + {k - 1}], lambda w: length(w) > 3)) = 0"
        for k in range(2, 6)
    )
    return f"""
    lists AS MATERIALIZED (SELECT id, vi, {WORDS} AS ws FROM forms),
    spread AS MATERIALIZED (SELECT id, vi, unnest(ws) AS word FROM lists),
    vocab AS MATERIALIZED (SELECT DISTINCT word FROM spread),
    lex AS (SELECT b, regexp_replace(b, '[^\\x00-\\x7F]', '#', 'g') AS bx FROM (SELECT unnest({lex}) AS b)),
    stems AS MATERIALIZED (SELECT word, {stem('word', pack)} AS root FROM vocab),
    listed AS (SELECT word, root, CASE WHEN root IN (SELECT b FROM lex) THEN root WHEN word IN (SELECT b FROM lex) THEN word END AS b FROM stems),
    exact AS MATERIALIZED (SELECT word, root AS term FROM listed WHERE b IS NOT NULL AND NOT {clean('word', 'b', pack)}),
    near AS MATERIALIZED (SELECT word, min(b) AS term FROM vocab, lex WHERE length(word) >= 3 AND abs(length(word) - length(b)) <= 1
      AND levenshtein(word, bx) <= 1 AND NOT {clean('word', 'b', pack)} GROUP BY word),
    wins AS ({windows}),
    joined AS MATERIALIZED (SELECT id, vi, k, i, min(b) AS term FROM wins JOIN lex ON contains(x, b) GROUP BY ALL),
    e AS (SELECT id, vi, count(*) AS n, list(DISTINCT term) AS terms FROM spread JOIN exact USING (word) GROUP BY ALL),
    c AS (SELECT id, vi, count(*) AS n, list(DISTINCT term) AS terms FROM joined GROUP BY id, vi),
    z AS (SELECT id, vi, count(*) AS n, list(DISTINCT term) AS terms FROM spread JOIN near USING (word) GROUP BY ALL)"""


SCORED = """
    counts AS (SELECT forms.id, forms.vi, forms.variant, coalesce(e.n, 0) AS n_e,
        CASE WHEN e.n IS NULL THEN coalesce(c.n, 0) ELSE 0 END AS n_c,
        CASE WHEN e.n IS NULL AND c.n IS NULL THEN coalesce(z.n, 0) ELSE 0 END AS n_z,
        coalesce(e.terms, c.terms, z.terms, []) AS found
      FROM forms LEFT JOIN e USING (id, vi) LEFT JOIN c USING (id, vi) LEFT JOIN z USING (id, vi)),
    scored AS MATERIALIZED (SELECT *, greatest(
        CASE WHEN n_e > 0 THEN least(0.6::DOUBLE + 0.2::DOUBLE * n_e, 1.0::DOUBLE) ELSE 0.0::DOUBLE END,
        CASE WHEN n_c > 0 THEN least(0.5::DOUBLE + 0.2::DOUBLE * n_c, 0.85::DOUBLE) ELSE 0.0::DOUBLE END,
        CASE WHEN n_z > 0 THEN least(0.5::DOUBLE + 0.15::DOUBLE * n_z, 0.75::DOUBLE) ELSE 0.0::DOUBLE END) AS conf FROM counts),
    graded AS (SELECT *, CASE WHEN conf >= 0.9::DOUBLE THEN 4 WHEN conf >= 0.7::DOUBLE THEN 3 WHEN conf >= 0.4::DOUBLE THEN 2
        WHEN conf > 0 THEN 1 ELSE 0 END AS sev FROM scored)"""

SEVERITY_NAME = "['NONE', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][sev + 1]"


def fields(threshold: str = "0.6") -> str:
    return f"""conf >= {threshold}::DOUBLE AS is_toxic, sev::INTEGER AS severity, {SEVERITY_NAME} AS severity_name, conf AS confidence, variant,
      array_to_string(list_sort(found), '|') AS terms, n_e::INTEGER AS exact_match, 0::INTEGER AS stemmed_match,
      n_c::INTEGER AS concat_match, n_z::INTEGER AS fuzzy_match"""


def primary_ctes(source: str, pack: Pack) -> str:
    return f"{norm_ctes(source)}, forms AS MATERIALIZED (SELECT id, 0 AS vi, 'primary' AS variant, x AS norm FROM n_p), {match_ctes(pack)}, {SCORED}"


def analyze_ctes(source: str, pack: Pack, threshold: str = "0.6") -> str:
    """CTEs ending in best: the chosen form of each id."""
    return f"""{norm_ctes(source, ALL_FORMS)}, {FORMS}, {match_ctes(pack)}, {SCORED},
      ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN conf >= {threshold}::DOUBLE THEN 0 ELSE 1 END,
        CASE WHEN conf >= {threshold}::DOUBLE THEN 0 ELSE -conf END, vi) AS rk FROM graded),
      best AS (SELECT * FROM ranked WHERE rk = 1)"""


DOCS = "SELECT doc_id AS id, text FROM documents"


def _simple(made: str) -> str:
    return f"SELECT doc_id, {made} AS out FROM documents"


def _normed(select: str) -> str:
    return f"WITH {norm_ctes(DOCS)}, forms AS (SELECT id, x AS norm FROM n_p), lists AS MATERIALIZED (SELECT id, norm, {WORDS} AS ws FROM forms) {select}"


def _vocab(select: str) -> str:
    return _normed(f", vocab AS MATERIALIZED (SELECT DISTINCT unnest(ws) AS word FROM lists) {select}")


def _grams(n: int) -> str:
    made = f"list_transform(range(1, len(ws) - {n} + 2), lambda i: array_to_string(ws[i:i + {n - 1}], ' '))"
    return _normed(f"SELECT id AS doc_id, array_to_string({made}, '|') AS grams FROM lists")


def _by_language(threshold: str, select: str) -> str:
    """One analysis per pack, each over its own rows."""
    rest = ", ".join(q(c) for c in ROUTES if c != "en")
    parts = []
    for code in ROUTES:
        where = f"lang = {q(code)}" if code != "en" else f"(lang IS NULL OR lang NOT IN ({rest}))"
        parts.append(f"SELECT * FROM (WITH {analyze_ctes(f'{DOCS} WHERE {where}', PACKS[code], threshold)} SELECT id, {fields(threshold)} FROM best)")
    return f"WITH every AS ({' UNION ALL '.join(parts)}) SELECT {select} FROM every JOIN documents ON id = doc_id"


def mask_sql(x: str, terms: str, mask: str) -> str:
    """Whole-word masking by splitting into word and other runs; the terms of these queries are plain ASCII words."""
    filler = f"repeat({q(mask)}, length(w))"
    return (
        f"array_to_string(list_transform(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+'), "
        f"lambda w: CASE WHEN list_contains({terms}, lower(w)) THEN {filler} ELSE w END), '')"
    )


HARMLESS = ["class pass", "hello", "shell hell", "Grass", "helo brass", "ass"]
RUDE = [" what a $hit", " shit! 4ss", "", " DAMN it, f_u_c_k", " you bastard"]
WITH_RUDE = f"SELECT doc_id AS id, text || {strings(RUDE)}[doc_id % 5 + 1] AS text FROM documents"
COUNTS = "n_e::INTEGER AS exact_match, 0::INTEGER AS stemmed_match, n_c::INTEGER AS concat_match, n_z::INTEGER AS fuzzy_match"


def _best(source: str, pack: Pack, select: str, threshold: str = "0.6") -> str:
    return f"(WITH {analyze_ctes(source, pack, threshold)} SELECT {select} FROM best)"


def oracles() -> dict[str, str]:
    en, corpus = PACKS["en"], PACKS["corpus"]
    prim = lambda cols: f"WITH {analyze_ctes(DOCS, en)} SELECT id AS doc_id, {cols} FROM best"
    own = Pack("own", "Own", corpus.bad_words, stemmer=None)
    loaded = Pack("own", "Own", frozenset(["trash", "worthless", "onread"]), {"onread": frozenset(["onrea", "onreads"])}, type(en.stemmer)(("ing", "ed", "es", "s", "ly")))
    best = f"WITH {analyze_ctes(DOCS, en)} SELECT id AS doc_id, {fields()} FROM best"
    flagged = f"WITH {analyze_ctes(DOCS, corpus)}, hits AS (SELECT id, found, conf >= 0.6::DOUBLE AS toxic FROM best)"
    lexicon = ", ".join(
        f"({q(code)}, {q(w)}, {q('|'.join(sorted(p.context_rules.get(w, ()))))})" for code, p in PACKS.items() for w in p.lexicon
    )
    langs = ", ".join(f"({q(c)}, {q(p.name)}, {len(p.bad_words)}::INTEGER)" for c, p in PACKS.items())
    talk = "SELECT conv_id * 1000000 + turn AS id, text FROM conversations"
    talked = f"""WITH {analyze_ctes(talk, en)} SELECT id // 1000000 AS conv_id, id % 1000000 AS turn, {fields()} FROM best"""
    return {
        "normalize_strip_zero_width": _simple("'ab' || " + strip_invisible("text") + " || 'c'"),
        "normalize_fold_unicode": f"WITH zw AS (SELECT doc_id AS id, text, text AS x FROM documents), {fold_ctes()} SELECT id AS doc_id, x AS out FROM f",
        "normalize_leet": _simple(leet("text")),
        "normalize_collapse": _simple(collapse("chr(97) || repeat(chr(13), 4) || repeat(chr(10), 3) || repeat(chr(133), 3) || repeat(chr(8232), 3) || repeat(chr(8233), 3) || 'b' || text")),
        "normalize_sanitize": _simple(keep_letters("text")),
        "normalize_full": f"WITH {norm_ctes(DOCS)} SELECT id AS doc_id, x AS out FROM n_p",
        "normalize_aggressive": f"WITH {norm_ctes(DOCS)} SELECT id AS doc_id, trim({collapse('x', 1)}) AS out FROM n_p",
        "normalize_variants": f"""WITH {norm_ctes(DOCS, ALL_FORMS)}, {FORMS}
            SELECT id AS doc_id, (row_number() OVER (PARTITION BY id ORDER BY vi) - 1)::INTEGER AS "at", variant, norm FROM forms""",
        "tokenize_words": _normed("SELECT id AS doc_id, len(ws)::INTEGER AS n_words, array_to_string(ws, '|') AS words FROM lists"),
        "split_words": r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\s\x0b\x1c-\x1f\x85\p{Z}]+') AS ws FROM documents)
            SELECT doc_id, len(ws)::INTEGER AS n_words, array_to_string(ws, '|') AS words FROM w""",
        "word_bigrams": _grams(2),
        "word_trigrams": _grams(3),
        "char_ngrams": _vocab("""SELECT word, array_to_string(flatten(list_transform([2, 3, 4], lambda n:
            list_transform(range(1, length(word) - n + 2), lambda i: substring(word, i, n)))), '|') AS grams FROM vocab"""),
        "stem_english": _vocab(f"SELECT word, {stem('word', en)} AS stem FROM vocab"),
        "stem_suffix_generic": _vocab(f"SELECT word, {stem('word', PACKS['en_json'])} AS stem FROM vocab"),
        "stem_spanish": _vocab(f"SELECT word, {stem('word', PACKS['es'])} AS stem FROM vocab"),
        "stem_bengali": f"WITH v AS (SELECT DISTINCT w || s AS word FROM (SELECT unnest({strings(PACKS['bn'].lexicon)}) AS w), (SELECT unnest({strings(BN_SUFFIXES)}) AS s)) SELECT word, {stem('word', PACKS['bn'])} AS stem FROM v",
        "stem_identity": _vocab("SELECT word, word AS stem FROM vocab"),
        "stemmer_plugin": f"""WITH {analyze_ctes(DOCS, own)} SELECT id AS doc_id, conf >= 0.6::DOUBLE AS is_toxic, conf AS confidence, array_to_string(list_sort(found), '|') AS terms,
            CASE WHEN conf >= 0.6::DOUBLE THEN {mask_sql('text', 'found', '*')} ELSE text END AS sanitized FROM best JOIN src USING (id)""",
        "tokenize_struct": _normed("""SELECT id AS doc_id, array_to_string(ws, '|') AS words, norm AS raw_normalized,
            array_to_string(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]), '|') AS bigrams,
            array_to_string(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]), '|') AS trigrams FROM lists"""),
        "pack_from_json": f"WITH {analyze_ctes(DOCS, loaded)} SELECT id AS doc_id, {fields()} FROM best",
        "registered_pack": f"""WITH every AS (SELECT * FROM {_best(f"{DOCS} WHERE lang = 'de'", corpus, 'id, ' + fields())}
            UNION ALL SELECT * FROM {_best(f"{DOCS} WHERE lang IS DISTINCT FROM 'de'", en, 'id, ' + fields())})
            SELECT id AS doc_id, lang, {q('|'.join(sorted([*PACKS, 'de'])))} AS known, * EXCLUDE (id, doc_id, text, lang, source, n_chars) FROM every JOIN documents ON id = doc_id""",
        "match_exact": f"""WITH {primary_ctes(DOCS, corpus)}
            SELECT id AS doc_id, term, count(*) AS n FROM spread JOIN exact USING (word) GROUP BY ALL""",
        "match_context_clean": f"""WITH {primary_ctes(f"SELECT doc_id AS id, text || ' ' || {strings(HARMLESS)}[doc_id % 6 + 1] AS text FROM documents", en)}
            SELECT DISTINCT id AS doc_id, word, b AS bad_word, exact.term AS exact, near.term AS fuzzy
            FROM spread JOIN (SELECT unnest({strings(sorted(en.context_rules))}) AS b) ON {clean('word', 'b', en)} LEFT JOIN exact USING (word) LEFT JOIN near USING (word)""",
        "match_concat": f"WITH {primary_ctes(DOCS, en)} SELECT id AS doc_id, term, count(*) AS n FROM joined GROUP BY ALL",
        "match_fuzzy": f"WITH {primary_ctes(DOCS, en)} SELECT word, term FROM near",
        "match_fuzzy_signatures": f"WITH {primary_ctes(DOCS, en)} SELECT word, term FROM near",
        "edit_distance_le_1": _vocab(f"SELECT word, b AS bad_word FROM vocab, (SELECT unnest({strings(en.lexicon)}) AS b) WHERE levenshtein(word, b) <= 1"),
        "signal_counts": prim(COUNTS),
        "confidence": prim("conf AS confidence"),
        "severity": prim(f"sev::INTEGER AS severity, {SEVERITY_NAME} AS severity_name"),
        "analyze_documents": best,
        "analyze_documents_tokens": best,
        "is_toxic_filter": f"{flagged} SELECT doc_id, lang, source FROM documents JOIN hits ON id = doc_id WHERE toxic",
        "sanitize_documents": f"""{flagged} SELECT doc_id, CASE WHEN toxic THEN {mask_sql('text', 'found', '#')} ELSE text END AS sanitized
            FROM documents JOIN hits ON id = doc_id""",
        "analyze_conversations": talked,
        "stream_conversations": talked,
        "analyze_by_language": _by_language("0.6", "doc_id, lang, * EXCLUDE (id, doc_id, text, lang, source, n_chars)"),
        "analyze_threshold_sweep": f"""WITH {analyze_ctes(DOCS, en, '2.0')}, t AS (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS threshold)
            SELECT lang, threshold, count(*) FILTER (WHERE conf >= threshold) AS n_toxic FROM best JOIN documents ON id = doc_id, t GROUP BY ALL""",
        "toxic_by_lang_source": f"""WITH {analyze_ctes(DOCS, corpus)}
            SELECT lang, source, count(*) AS n, count(*) FILTER (WHERE conf >= 0.6::DOUBLE) AS n_toxic FROM best JOIN documents ON id = doc_id GROUP BY ALL""",
        "pack_lexicon": f"SELECT * FROM (VALUES {lexicon}) AS t(pack, bad_word, clean_words)",
        "list_languages": f"SELECT * FROM (VALUES {langs}) AS t(code, name, words)",
        "ipc_roundtrip": f"""WITH {analyze_ctes(WITH_RUDE, en)}, a AS (SELECT best.*, src.text, id % 7 < 3 AS ask, id % 7 IN (3, 4) AS clean FROM best JOIN src USING (id))
            SELECT id AS doc_id, NOT (id % 7 = 6 AND id % 2 = 0) AS answered, CASE WHEN ask THEN conf >= 0.6::DOUBLE END AS is_toxic, CASE WHEN ask THEN sev::INTEGER END AS severity,
              CASE WHEN ask THEN conf END AS confidence, CASE WHEN ask THEN array_to_string(list_sort(found), '|') END AS terms,
              CASE WHEN clean THEN CASE WHEN conf >= 0.6::DOUBLE THEN {mask_sql('text', 'found', '#')} ELSE text END END AS sanitized,
              CASE WHEN id % 7 = 5 THEN 'unknown command: explain' WHEN id % 7 = 6 AND id % 2 = 1 THEN 'malformed request' END AS error FROM a""",
        "moderate_requests": f"""WITH a AS {_best(WITH_RUDE, en, 'id, ' + fields('0.7'), '0.7')}, m AS {_best(WITH_RUDE, en, 'id, conf AS c6, found')}, t AS ({WITH_RUDE}),
            every AS (SELECT *, id % 10 = 3 AS blank FROM a JOIN m USING (id) JOIN t USING (id))
            SELECT id AS doc_id, CASE WHEN blank THEN NULL ELSE is_toxic END AS is_toxic, CASE WHEN blank THEN NULL ELSE severity_name END AS severity,
              CASE WHEN blank THEN NULL ELSE round(confidence, 3) END AS confidence_rounded, CASE WHEN blank THEN NULL ELSE terms END AS terms,
              CASE WHEN blank THEN NULL WHEN is_toxic AND c6 >= 0.6::DOUBLE THEN {mask_sql('text', 'found', '*')} ELSE text END AS sanitized,
              {", ".join(f"CASE WHEN blank THEN NULL ELSE {k}_match END AS {k}_match" for k in ("exact", "concat", "fuzzy"))},
              CASE WHEN blank THEN 'Text cannot be empty' END AS error FROM every""",
        "label_quality_report": f"""{flagged} SELECT l.toxic, coalesce(h.toxic, false) AS flagged, count(*) AS n
            FROM labels l LEFT JOIN hits h ON h.id = l.doc_id GROUP BY ALL""",
    }

"""Main text of HTML pages by two-pass block rules.

A page becomes blocks of text between block-level tags. Containers whose tag,
role, class or id names them as navigation, header, footer, sidebar, notice,
advert, form, script, comment and the like are left out. A compound name counts by
its last word that says more than place or shape: related-posts and sidebar-left are
left out, social-history is not; names that say what a page has or lacks
(has-sidebar, no-comments) name nothing. Where all of the article would be left out
by the name of a wrapper or a form around it, it is read nevertheless, unless the
wrapper is for comments, related texts or adverts.

First pass: link density, length, stop-word density and, for languages and scripts
whose stop words are not listed, the ends of sentences make a block good, bad, or, if
it is short, undecided. Second pass: undecided blocks take the label of the nearest
decided neighbour; between a good and a bad one as near they are good. Where none
is decided, blocks of an article or main element are good and others bad. An article
element speaks against what stands outside it, unless it holds a mere teaser and far
more text outside is good by itself.

Null html is empty and gives an empty text. Broken markup, unclosed elements and
quotes, and very long pages are read to the end. Rows that repeat are extracted each;
ties between neighbours are good. Other columns are ignored, an empty table gives an
empty result.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.llm import common

STOP = frozenset(
    """a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their
    there they this to was we were which who will with you
    der die das und ist in zu den mit von für im dem nicht ein eine auf als auch es an werden aus er hat dass sie nach bei
    le la les de des du un une et est en que qui dans pour par sur pas au avec ce il plus ne se
    el los las y es una del al lo como más pero sus su para con por no si o""".split()
)
MORE_STOP = STOP | frozenset(
    """il di che è e per una sono non con del della nel da come anche questo alla gli delle dei ha ma
    o os um uma não em na no dos das ao foi são pelo pela mais também
    het een van en dat op te zijn voor met die niet aan er om ook naar bij door
    och att det som en på för är av med den till inte ett om har de från
    i na nie się jest że do z to jak ale przez po od jego
    и в не на что он с как это по но из к у за от так же для мы они было""".split()
)
BLOCKS = frozenset(
    """address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p
    pre section select summary table tbody td tfoot th thead title tr ul""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noembed noframes xmp".split())
OUT_TAGS = frozenset(
    """nav footer aside form script style noscript template svg math button select option iframe object canvas dialog menu
    head title textarea label input fieldset audio video""".split()
)
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
OUT_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar menu
    nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices alert popup
    modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations
    comment comments commentlist respond reply replies disqus discussion widget widgets pagination pager copyright
    disclaimer skip toolbar search""".split()
)
#: Last words of compound names that say where or how something stands, not what it is.
PLACES = frozenset(
    """left right top bottom main primary secondary inner outer first last left mobile desktop sticky fixed floating small large
    site page global local block box container wrapper wrap holder list area section zone slot unit panel strip row col column group
    grid card cards tile item items content body text title heading header label links link bar buttons button icons icon image
    message posts post articles stories topics news feed thread form field input module info now here on off js""".split()
)
#: First and last words of class names that tell of a page instead of naming an element.
ABOUT_FIRST, ABOUT_LAST = frozenset("has no with without".split()), frozenset("enabled disabled layout".split())
#: Names whose elements hold articles of their own kind, which are never the page's.
OTHER_ARTICLES = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion related recommended
    recommendations comment comments commentlist respond reply replies disqus discussion""".split()
)
OUT_OUTSIDE = frozenset(["header", "top", "bottom", "aside"])
CONTAINERS = frozenset("article section main div body td th li ul ol table blockquote aside nav footer header form".split())
#: A quote opens a value only after an equals sign, and only if it is closed anywhere.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>|<[!?/][^<>]*+>", re.S)
#: A slash that closes the element itself, not the end of a value without quotes.
SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/$")
SENTENCE_END = re.compile(r"[.!?…](?=[\s\"'”»)\]]|$)|[。！？؟।።]")
LATIN = re.compile(r"[A-Za-zÀ-ɏ]")
LETTER = re.compile(r"[^\W\d_]")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
MIN_CHARS, STOP_LOW, STOP_HIGH, LONG_CHARS, LINKS_HIGH = 70, 0.15, 0.25, 200, 0.4
#: An article element of less text than this may be a teaser; good text outside must be so many times its text.
TEASER, OUTSIDE = 300, 2
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
SPACE = re.compile(r"\s+")


#: How an element is left out: not, by a name or as a form, or by what it is.
KEPT, NAMED, OUT = 0, 1, 2


def _names(found: dict[str, str]) -> list[str]:
    """What the class names and the id say an element is: a word of each."""
    out = []
    for name in f"{found.get('class', '')} {found.get('id', '')}".split():
        words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w]
        if words and words[0] not in ABOUT_FIRST and words[-1] not in ABOUT_LAST:
            while len(words) > 1 and words[-1] in PLACES:
                words.pop()
            out.append(words[-1])
    return out


ARTICLE = re.compile(r"(?i)\brole\s*=\s*[\"']?(?:main|article)\b|articleBody")


def _is_article(tag: str, attrs: str) -> bool:
    return tag in ("article", "main") or ("=" in attrs and ARTICLE.search(attrs) is not None)


def _leaves_out(tag: str, attrs: str, in_article: bool) -> int:
    """Whether an element is something other than text of the article, by what it is called."""
    if (tag in OUT_TAGS and tag != "form") or (tag == "header" and not in_article):
        return OUT
    form = NAMED if tag == "form" else KEPT
    if "=" not in attrs and "hidden" not in attrs:
        return form
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attrs)}
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
        return OUT
    role = found.get("role", "").lower()
    if role in OUT_ROLES:
        return NAMED if role == "form" else OUT
    if tag in ("article", "main", "body", "html"):
        return KEPT
    names = _names(found)
    if any(n in OTHER_ARTICLES for n in names):
        return OUT
    return NAMED if any(n in OUT_NAMES or (not in_article and n in OUT_OUTSIDE) for n in names) else form


def blocks_of(page: str, through: bool = False, names: bool = True) -> list[tuple[str, int, bool, bool]]:
    """(text, characters inside links, inside an article, is a heading) of the blocks that are not left out.

    ``through``: article and main elements are read inside elements left out by name, too.
    ``names``: without it no element is left out by its name or as a form.
    """
    out, parts, links = [], [], 0
    stack: list[tuple[str, int, bool, int, bool]] = []  # tag, left out, in article, open links, in a heading
    opened: Counter[str] = Counter()  # tags of the stack
    skip, article, link, heading, at = KEPT, False, 0, False, 0

    def flush() -> None:
        nonlocal parts, links
        if parts:
            text = SPACE.sub(" ", html_lib.unescape("".join(parts))).strip()
            if text:
                out.append((text, links, article, heading))
        parts, links = [], 0

    def close(depth: int) -> None:
        nonlocal skip, article, link, heading
        opened.subtract(t[0] for t in stack[depth:])
        del stack[depth:]
        skip, article, link, heading = stack[-1][1:] if stack else (KEPT, False, 0, False)

    def said(text: str) -> None:
        nonlocal links
        if text and not skip:
            parts.append(text)
            if link:
                links += len(text.strip())

    while m := TOKEN.search(page, at):
        said(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in BLOCKS:
            flush()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1) if opened[tag] > 0 else ():
                if stack[i][0] == tag:
                    close(i)
                    break
                if tag not in BLOCKS and stack[i][0] in CONTAINERS:
                    break  # an inline end tag does not close a container
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            stop = end.start() if end else len(page)
            at = stop
            end_tag = TOKEN.match(page, stop)
            at = end_tag.end() if end_tag else len(page)
            continue
        if tag in VOID or SELF_CLOSED.search(m[3]):
            continue
        if tag in BLOCKS and opened["p"] > 0:  # a block element ends an open paragraph
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in CONTAINERS:
                    break
        is_article = _is_article(tag, m[3])
        if through and skip == NAMED and is_article:
            skip = KEPT
        out_by = _leaves_out(tag, m[3], article)
        if not names and out_by == NAMED:
            out_by = KEPT
        stack.append((tag, max(skip, out_by), article or is_article, link + (tag == "a"), heading or tag in HEADINGS))
        opened[tag] += 1
        skip, article, link, heading = stack[-1][1:]
    said(page[at:])
    flush()
    return out


def _is_prose(text: str) -> bool:
    """Whether a text has an end of a sentence in every 300 characters or less, on the whole."""
    return 300 * sum(1 for _ in SENTENCE_END.finditer(text)) >= len(text)


def _is_foreign(text: str) -> bool:
    """Whether most letters are of a script that has no stop words here; a few tell."""
    few = text[:2000]
    if 5 * len(few.encode("ascii", "ignore")) > 4 * len(few):
        return False
    letters = LETTER.findall(few)
    return 2 * len(LATIN.findall("".join(letters))) < len(letters)


def first_pass(text: str, links: int, in_article: bool, has_article: bool, heading: bool) -> bool | None:
    """True for good, False for bad, None for undecided."""
    if links > LINKS_HIGH * len(text):
        return False
    if has_article and not in_article:
        return False
    if not in_article and len(text) < LONG_CHARS and ("©" in text or "copyright" in text.lower()):
        return False
    if heading:
        return True if in_article else None
    if _is_foreign(text):  # a character may be a word: a third of the length says as much
        if len(text) < MIN_CHARS // 3:
            return None
        return True if _is_prose(text) or (in_article and len(text) >= LONG_CHARS // 3) else None
    if len(text) < MIN_CHARS:
        return None
    words = [w.strip(".,;:!?\"'()#$%&*") for w in text.lower().split()]
    density = sum(w in MORE_STOP for w in words) / len(words)
    if density >= STOP_HIGH or (in_article and (density >= STOP_LOW or len(text) >= LONG_CHARS)):
        return True
    if density >= STOP_LOW:
        return True if len(text) >= LONG_CHARS else None
    if in_article:
        return None
    return True if len(text) >= LONG_CHARS and _is_prose(text) else False


def extract(page: str) -> str:
    blocks = blocks_of(page)
    if not any(b[2] for b in blocks) and re.search("<(?:article|main)\\b|articleBody|role\\s*=", page, re.I):
        inner = blocks_of(page, through=True)
        if sum(len(t) - n for t, n, a, _ in inner if a) > sum(len(t) - n for t, n, _, _ in blocks):
            blocks = inner
    # a page whose every text stands inside something named otherwise, or a form, is read all the same
    return chosen(blocks) or chosen(blocks_of(page, names=False))


def chosen(blocks: list[tuple[str, int, bool, bool]]) -> str:
    """The text of the blocks that both passes find good."""
    inside = sum(len(t) - n for t, n, a, _ in blocks if a)
    if 0 < inside < TEASER:
        outside = sum(len(t) for t, n, a, h in blocks if not a and not h and first_pass(t, n, False, False, h))
        if outside > OUTSIDE * inside:
            blocks = [(t, n, False, h) for t, n, _, h in blocks]
    has_article = any(b[2] for b in blocks)
    labels = [first_pass(t, n, a, has_article, h) for t, n, a, h in blocks]
    # nearest decided neighbour on either side
    before, last = [None] * len(blocks), None
    for i, x in enumerate(labels):
        last = i if x is not None else last
        before[i] = last
    after, last = [None] * len(blocks), None
    for i in range(len(blocks) - 1, -1, -1):
        last = i if labels[i] is not None else last
        after[i] = last
    kept = []
    for i, (text, _, in_article, _) in enumerate(blocks):
        good = labels[i]
        if good is None:
            b, a = before[i], after[i]
            if b is None and a is None:
                good = in_article
            elif b is None or a is None:
                good = labels[a if b is None else b]
            elif labels[b] == labels[a] or i - b != a - i:
                good = labels[b if i - b < a - i or labels[b] == labels[a] else a]
            else:
                good = True
        if good:
            kept.append(text)
    return " ".join(kept)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in common.slices(batches, "html"):
        made = [extract(h) for h in part.column("html").to_pylist()]
        yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(made, pa.string()), pa.array([len(t) for t in made], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row; one pass, no shuffle."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(common.table(spark, sf_dir, "pages"))

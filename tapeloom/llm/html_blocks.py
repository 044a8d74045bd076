"""HTML extraction by two-pass block rules.

A page is cut into blocks at its block-level tags.  First pass: blocks inside
boilerplate elements (by tag, role, or a word of class or id) and blocks that are
mostly links (anchors with a target, to their end or the end of the element around
them) are bad; an article inside a form, or inside a wrapper named after comments
ahead of any article text, is an article unless it is a comment itself.  An element that is
furniture by a name only, among other names, is none if it holds most of the running text of its zone
(``DOMINANT`` times what stands outside such elements): wrappers carry words of what they wrap.  Names with a
word of state or absence (``no-sidebar``, ``nav-open``) tell nothing.  A linked title ahead of an
article's text is no navigation.  Blocks that are long enough and dense in stop words are good; of the others those with a copyright
sign outside an article are bad, the rest are ambiguous (short ones, long ones without
stop words).  Second pass: an ambiguous block takes the label of the nearest decided block of its zone (the
article or main element, or the rest of the page); of two neighbours equally near a
good one wins, and in an article a block is bad only between two bad ones.  A zone without any decided block keeps its blocks if it is an
article or no block of the page is decided; elsewhere it keeps the long ones if the
page has no good block at all.

Text inside a block: character references decoded, white space turned into one
space, trimmed; a single line break is white space, two in a row end the block.

Defined cases: NULL, empty or tag-only html gives an empty text; html that breaks
off ends its last element there, a tag cut in the middle is dropped; unclosed
elements end with the element around them (scripts, styles, frames and titles with the
page); self-closed pictures and media are empty; repeated rows each give their result; an
empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tapeloom.llm.common import small_batches, table

#: A block of fewer characters says too little by itself.
SHORT_CHARS = 70
#: Share of stop words from which a longer block is running text.
STOP_DENSITY = 0.12
#: Share of characters inside links above which a block is navigation.
LINK_DENSITY = 0.33
#: Running text inside an element named like furniture, against all outside, from which it is none.
DOMINANT = 3

# Frequent function words of the four languages of the pages.
STOP_WORDS = frozenset(
    """
    a about after all also an and are as at be been but by can could do for from had has have he her his how i if in
    into is it its more no not of on one or our out she so some than that the their them then there these they this
    to up was we were what when which who will with would you your
    au aux avec ce ces cette comme dans de des du elle elles en est et il ils je la le les leur lui mais ne nous on
    ou par pas plus pour qu que qui sa se ses son sont sur tout un une vous
    aber als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich
    im in ist mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wie wir zu zum zur
    al como con cuando de del desde donde el ella en entre era es esta este esto ha hay la las lo los más me mi muy
    no nos o para pero por porque que se ser si sin sobre son su sus también te todo un una y ya
    """.split()
)
# Element names and class words of page furniture.
RAW_TEXT = "script|style|iframe|title"
SKIPPED = frozenset("noscript template svg math object canvas audio video".split())
FURNITURE_TAGS = frozenset(
    "nav aside footer button select textarea label dialog menu datalist input option".split()
)
FURNITURE_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split()
)
FURNITURE_WORDS = frozenset(
    """
    ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent
    gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login sidebar menu nav
    navbar navigation breadcrumb breadcrumbs pagination pager share sharing social related recommended widget footer
    header masthead toolbar search copyright disclaimer skip
    """.split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
#: With one of these in the same name a comment word tells of a page or post (``comments-open``), not of comments.
STATE_WORDS = frozenset("open opened closed on off enabled disabled allowed no has with category tag term topic".split())
#: With one of these in the same name a furniture word tells of the page around it, not of the element.
LAYOUT_WORDS = frozenset(
    """
    no not without has have with hide fixed sticky static open opened closed collapsed expanded visible active inactive
    on off enabled disabled
    """.split()
)
#: Controls that may stand inside a sentence, and elements that hold sentences.
CONTROLS = frozenset("button label".split())
RUNNING = frozenset("p li dd".split())
TITLES = frozenset("h1 h2".split())
POST_WORDS = frozenset("post entry hentry article single page content story".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    """
    a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span
    strike strong sub sup time tt u var wbr
    """.split()
)
#: Elements that the start of another block ends.
SELF_ENDING = frozenset("p li dt dd tr td th h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW_TEXT})(?![^\s/>])[^>]*+(?:>|\Z)"
    r"|<(/?)([a-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-z][^\s/>]*+)([^>]*+)>"
    r"|<[!?/][^>]*+(?:>|\Z)|<[a-z][^>]*+\Z",
    re.IGNORECASE | re.DOTALL,
)
#: The slash of a self-closed tag, not the last one of a value without quotes.
_SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/\Z|^[^=]*/\Z").search
_ATTRIBUTE = re.compile(r"(?<![a-z-])([a-z-]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")
_LETTERS = re.compile(r"[^\W\d_]+").findall

_RAW_ENDS = {tag: re.compile(rf"</{tag}\s*+>|\Z", re.IGNORECASE) for tag in RAW_TEXT.split("|")}
_NEXT_SKIPPED = {tag: re.compile(rf"<(/?){tag}(?![^\s/>])", re.IGNORECASE) for tag in SKIPPED}

SOFT, HARD, MAIN, COMMENTS = 1, 2, 3, 4


@dataclass
class Block:
    """One block of a page: its text, the characters of it inside links, and where it stood.

    ``soft`` numbers the innermost element that makes it furniture by a name only, -1 without one;
    ``title`` is a heading of an article ahead of its text.
    """

    text: str
    link_chars: int
    furniture: bool
    main: bool
    soft: int = -1
    title: bool = False


@dataclass
class Soft:
    """An element that is furniture by a name only: the one around it (-1: none), and whether it has other names."""

    around: int
    other_names: bool


def _comment_weight(names: list[set[str]], article: bool) -> int:
    """``HARD`` for an article that is a comment, ``COMMENTS`` for what may hold comments, else 0."""
    told = [words for words in names if words & COMMENT_WORDS and not words & STATE_WORDS]
    if article:
        if any(words & {"comment", "reply"} for words in told):
            return HARD
        return COMMENTS if any(len(words) == 1 and "discussion" not in words for words in told) else 0
    if told:
        return COMMENTS
    state = [words for words in names if words & COMMENT_WORDS]
    return COMMENTS if state and not any(words & POST_WORDS for words in names if words not in state) else 0


def _named(attributes: str) -> dict[str, str]:
    named: dict[str, str] = {}
    for name, one, two, three, hidden in _ATTRIBUTE.findall(attributes) if attributes else ():
        named[(name or hidden).lower()] = one or two or three
    return named


def _weight(tag: str, attributes: str) -> int:
    """How surely an element is page furniture: 0, ``SOFT`` or ``HARD``; ``MAIN`` for the article itself.

    ``COMMENTS``: sure after the running text of an article, before it only a name.
    """
    if tag in FURNITURE_TAGS:
        return HARD
    named = _named(attributes)
    role = named.get("role", "").lower()
    if tag in ("html", "body"):
        return MAIN if role in ("main", "article") else 0
    if role in FURNITURE_ROLES:
        return HARD
    if "hidden" in named or "display:none" in named.get("style", "").replace(" ", ""):
        return HARD
    names = [
        {w.lower() for w in _WORDS.findall(name)} for k in ("class", "id") if k in named for name in named[k].split()
    ]
    words = set().union(*names)
    if tag == "main" or role == "main":
        return MAIN
    article = tag == "article" or role == "article"
    if article and (named.get("itemprop") == "comment" or named.get("itemtype", "").endswith("/Comment")):
        return HARD
    if words & COMMENT_WORDS and (weight := _comment_weight(names, article)):
        return weight
    if article:
        return MAIN
    told = set().union(*[name for name in names if not name & LAYOUT_WORDS])
    return SOFT if tag in ("header", "form", "fieldset") or role == "form" or told & FURNITURE_WORDS else 0


def _other_names(tag: str, attributes: str) -> bool:
    """Whether an element is named after more than furniture (a form without a name may be anything)."""
    named = _named(attributes)
    words = {w.lower() for k in ("class", "id") for w in _WORDS.findall(named.get(k, ""))}
    return bool(words - FURNITURE_WORDS) if words else tag in ("form", "fieldset")


def _empty(page: str, at: int, tag: str, attributes: str) -> bool:
    """Whether a skipped element is self-closed; other than pictures only if no end tag comes before the next one."""
    if not attributes.endswith("/") or tag in ("svg", "math"):
        return attributes.endswith("/")
    after = _NEXT_SKIPPED[tag].search(page, at)
    return not (after and after[1])


def blocks(page: str, softs: list[Soft] | None = None) -> Iterator[Block]:
    """Blocks of a page in order, empty ones left out; ``softs`` gets the elements that their ``soft`` numbers."""
    softs = [] if softs is None else softs
    # Open elements: tag, weight, and what holds inside: furniture, surely furniture, in an article, by which name.
    stack: list[tuple[str, int, bool, bool, bool, int]] = []
    opened: Counter[str] = Counter()
    parts: list[str] = []
    link_chars, breaks, at = 0, 0, 0
    link = -1  # number of elements open around the open link, -1 without one
    told = False  # running text of an article came before
    # Elements without text of the page: where the outermost open one stands in the stack, and the tags open
    # inside it; the inline elements open around it.
    skip = -1
    inner: Counter[str] = Counter()
    inline: Counter[str] = Counter()

    def push(tag: str, weight: int, attributes: str = "") -> None:
        _, _, furniture, sure, main, soft = stack[-1] if stack else ("", 0, False, False, False, -1)
        if weight == COMMENTS:
            weight = HARD if told else MAIN if tag == "article" else SOFT
        if weight == MAIN:
            # An article inside a form, or a wrapper that only sounds like furniture, is an article.
            furniture, main, soft = sure, True, -1
        elif weight == HARD:
            furniture = sure = True
        elif weight == SOFT and not (main and tag == "header"):
            furniture = True
            if not sure:
                softs.append(Soft(soft, _other_names(tag, attributes)))
                soft = len(softs) - 1
        stack.append((tag, weight, furniture, sure, main, -1 if sure else soft))
        opened[tag] += 1
        if skip >= 0:
            inner[tag] += 1

    def pop(ended: bool = True) -> tuple[str, int, bool, bool, bool, int]:
        nonlocal link, skip
        opened[stack[-1][0]] -= 1
        if skip >= 0:
            inner[stack[-1][0]] -= 1
            skip = -1 if len(stack) - 1 == skip else skip
        if link >= len(stack):
            link = -1 if ended else len(stack) - 1
        return stack.pop()

    def flush() -> Iterator[Block]:
        nonlocal parts, link_chars, breaks, told
        text = " ".join("".join(parts).split())
        if text:
            tag, _, furniture, _, main, soft = stack[-1] if stack else ("", 0, False, False, False, -1)
            title = main and not told and tag in TITLES
            told = told or (main and not furniture and len(text) >= SHORT_CHARS)
            yield Block(text, link_chars, furniture, main, soft, title)
        parts, link_chars, breaks = [], 0, 0

    def add(raw: str) -> None:
        nonlocal link_chars, breaks
        if raw and skip < 0:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if not text.isspace():
                breaks = 0
                if link >= 0:
                    link_chars += len(" ".join(text.split()))

    while token := _TOKEN.search(page, at):
        add(page[at : token.start()])
        at = token.end()
        if token[1]:
            # Inside a picture these may be self-closed.
            if not (token[0].endswith("/>") and (skip >= 0 or token[1].lower() == "title")):
                at = _RAW_ENDS[token[1].lower()].search(page, at).end()
            continue
        tag = token[3] or token[6]
        if not tag:
            continue
        tag, closes, attributes = tag.lower(), bool(token[2] or token[5]), token[4] or token[7] or ""
        if skip >= 0:
            if not closes:
                if tag not in VOID and not attributes.endswith("/"):
                    push(tag, 0)
                continue
            if inner[tag]:
                while pop()[0] != tag:
                    pass
                continue
            if not inline[tag] and not opened[tag]:
                continue
            # The end of an element around it.
            while skip >= 0:
                pop()
        elif tag in SKIPPED and not closes:
            if not _empty(page, at, tag, attributes):
                skip = len(stack)
                push(tag, 0)
            continue
        if tag in INLINE and tag not in VOID and not attributes.endswith("/"):
            inline[tag] = max(0, inline[tag] + (-1 if closes else 1))
        if tag == "br":
            breaks += 1
            parts.append("\n")
            if breaks == 2:
                yield from flush()
            continue
        if tag == "a" and (closes or not _SELF_CLOSED(attributes)):
            # Broken quotes hide what the anchor has.
            target = not closes and (bool(token[6]) or "href" in _named(attributes))
            link = len(stack) if target else -1
        if tag in CONTROLS and (not opened[tag] if closes else stack and stack[-1][0] in RUNNING and _has_text(parts)):
            continue  # a control inside a sentence is part of it
        if closes:
            if tag not in INLINE or opened[tag]:
                yield from flush()
            while opened[tag] and pop()[0] != tag:
                pass
            continue
        weight = _weight(tag, attributes)
        if tag not in INLINE or weight:
            yield from flush()
            while stack and stack[-1][0] in SELF_ENDING and tag not in INLINE:
                # A link may hold blocks: only the next element of the same kind ends it.
                pop(ended=stack[-1][0] == tag)
        # Inline elements without a meaning of their own need no place in the stack.
        if tag not in VOID and not attributes.endswith("/") and (tag not in INLINE or weight):
            push(tag, weight, attributes)
    add(page[at:])
    yield from flush()


def _has_text(parts: list[str]) -> bool:
    return any(not part.isspace() for part in parts)


def _is_running(block: Block) -> bool:
    """Long, dense in stop words, not mostly links: running text, wherever it stands."""
    if len(block.text) < SHORT_CHARS or block.link_chars > LINK_DENSITY * len(block.text):
        return False
    words = _LETTERS(block.text.lower())
    return bool(words) and sum(w in STOP_WORDS for w in words) >= STOP_DENSITY * len(words)


def _wrappers(found: list[Block], running: list[bool], softs: list[Soft]) -> set[int]:
    """The elements named like furniture that hold most of the running text of their zone.

    The zone is the articles of a page that has some, else all of it.  From the outermost elements
    inwards the fullest one is taken, as long as it has other names and is full enough.
    """
    zone_main = any(b.main for b in found)
    open_text, own = 0, [0] * len(softs)
    for block, runs in zip(found, running, strict=True):
        if runs and block.main == zone_main:
            if not block.furniture:
                open_text += len(block.text)
            elif block.soft >= 0:
                own[block.soft] += len(block.text)
    whole: list[int] = list(own)
    inside: dict[int, int] = {}
    for k in range(len(softs) - 1, -1, -1):  # an element comes after the one around it
        around = softs[k].around
        if around >= 0:
            whole[around] += whole[k]
        if whole[k] >= whole[inside.get(around, k)]:
            inside[around] = k
    taken, at = set(), -1
    while (at := inside.get(at, -1)) >= 0 and softs[at].other_names and whole[at] > DOMINANT * open_text:
        taken.add(at)
        open_text += own[at]
    return taken


def _first_label(block: Block, running: bool) -> bool | None:
    """True (good), False (bad) or None (ambiguous)."""
    if block.furniture or (block.link_chars > LINK_DENSITY * len(block.text) and not block.title):
        return False
    if running:
        return True
    # A copyright line is furniture, running text that mentions the sign is not.
    return False if not block.main and "\N{COPYRIGHT SIGN}" in block.text else None


def _second_labels(found: list[Block], labels: list[bool | None]) -> list[bool]:
    any_good, undecided = any(labels), all(label is None for label in labels)
    # Furniture inside an article says nothing about the paragraphs around it.
    evidence = [
        None if label is None or (not label and found[i].main and found[i].furniture) else label
        for i, label in enumerate(labels)
    ]
    near: list[list[tuple[int, bool] | None]] = []
    for order in (range(len(found)), range(len(found) - 1, -1, -1)):
        last: dict[bool, tuple[int, bool]] = {}
        seen: list[tuple[int, bool] | None] = [None] * len(found)
        for i in order:
            seen[i] = last.get(found[i].main)
            if evidence[i] is not None:
                last[found[i].main] = (i, bool(evidence[i]))
        near.append(seen)
    result = []
    for i, label in enumerate(labels):
        if label is None:
            sides = [side for side in (near[0][i], near[1][i]) if side]
            if found[i].main and sides:
                # A list of links ends no article: only between two of them a block is part of it.
                label = len(sides) < 2 or any(good for _, good in sides)
            elif sides:
                label = min(sides, key=lambda side: (abs(side[0] - i), not side[1]))[1]
            else:
                label = found[i].main or undecided
            if not label and not any_good and not found[i].main:
                label = len(found[i].text) >= SHORT_CHARS
        result.append(label)
    return result


def main_text(page: str | None) -> str:
    """The main text of one page, its blocks joined by line feeds."""
    softs: list[Soft] = []
    found = list(blocks(page or "", softs))
    running = [_is_running(b) for b in found]
    if softs:
        taken = _wrappers(found, running, softs)
        found = [replace(b, furniture=False) if b.soft in taken else b for b in found]
    labels = _second_labels(found, [_first_label(b, r) for b, r in zip(found, running, strict=True)])
    return "\n".join(b.text for b, good in zip(found, labels, strict=True) if good)


@F.pandas_udf(StringType())
def _main_texts(pages: pd.Series) -> pd.Series:
    return pd.Series([main_text(page) for page in pages], dtype=object)


def extracted(pages: DataFrame, page: Column, name: str = "text") -> DataFrame:
    """Add the main text of each page."""
    small_batches(pages.sparkSession)
    return pages.withColumn(name, _main_texts(page))


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"), F.col("html"))
    return rows.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))

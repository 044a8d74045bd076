import html
import html.parser as html_parser
import itertools
import re
import time

import pytest
from pyspark.sql import functions as F

from tapeloom.llm.common import table
from tapeloom.llm import html_blocks
from tapeloom.llm.html_blocks import extracted, main_text, op7_html_main_text

from .conftest import SF

LONG = "This is the text of the article and it has all of the words that a reader would see in it."
FURNITURE = "This is the text of the notice and you should not see it in the text of the article at all."


def test_articles_of_the_table(spark):
    pages = {r["page_id"]: r for r in table(spark, SF, "pages").collect()}
    got = op7_html_main_text(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        body = pages[r["page_id"]]["html"]
        body = body[body.index("<article>") + 9 : body.index("</article>")]
        body = re.sub(r"</?b>", "", re.sub(r"<br>", " ", re.sub(r"</?(p|h1)>", "\n", body)))
        lines = [" ".join(html.unescape(line).split()) for line in body.split("\n")]
        assert r["text"] == "\n".join(line for line in lines if line)
        assert r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


@pytest.mark.parametrize(
    "piece",
    [
        f"<nav><p>{FURNITURE}</p></nav>", f"<aside>{FURNITURE}</aside>", f"<footer>{FURNITURE}</footer>",
        f"<form><p>{FURNITURE}</p><input value='x'></form>", f"<script>document.write('<p>{FURNITURE}</p>')</script>",
        f"<style>p{{content:'{FURNITURE}'}}</style>", f"<!-- <p>{FURNITURE}</p> -->", f"<div class='ad'>{FURNITURE}</div>",
        f"<div id=cookieNotice><p>{FURNITURE}</div>", f"<div class='page-sidebar left'><ul><li>{FURNITURE}</ul></div>",
        f"<section class=comments><article class=comment><p>{FURNITURE}</p></article></section>",
        f"<div role='complementary'>{FURNITURE}</div>", f"<p hidden>{FURNITURE}</p>", f"<p class=advert>{FURNITURE}",
        f"<p><a href=x>{FURNITURE}</a></p>", f"<noscript>{FURNITURE}</noscript>", f"<p><span class=promo>{FURNITURE}</span></p>",
        f"<dialog>{FURNITURE}</dialog>", "<ul class=menu><li><a href=1>Home</a><li><a href=2>News</a></ul>",
    ],
)
def test_furniture_goes_and_the_article_stays(piece):
    inner = f"<article><h1>Title</h1><p>{LONG}</p>{piece}<p>Short end.</p></article>"
    assert main_text(f"<html><body>{inner}</body></html>") == f"Title\n{LONG}\nShort end."
    outer = f"<body>{piece}<div class=content><p>{LONG}</p></div>{piece}</body>"
    assert main_text(outer) == LONG
    around = f"<body>{piece}<article><p>One.</p></article>{piece}</body>"
    assert main_text(around) == "One."


def test_site_header_goes_article_header_stays():
    page = f"<header><h1>Site</h1></header><main><header><h1>Title</h1></header><p>{LONG}</main>"
    assert main_text(page) == f"Title\n{LONG}"


def test_wrapper_words_do_not_hide_an_article():
    assert main_text(f"<body class=has-sidebar><div class=with-sidebar><main><p>{LONG}</p></main></div>") == LONG


@pytest.mark.parametrize(
    "page",
    [
        "<body class='single comments-open'><p>{}</p></body>", "<html class=no-comments><body id=discussion><p>{}</p>",
        "<article class='post comments-closed'><p>{}</p></article>", "<div id=discussion><article><p>{}</p></article></div>",
        "<body><form id=aspnetForm><div><article><p>{}</p></article></div></form></body>",
        "<form role=form><div role=main><p>{}</p></div></form>", "<main><div class=comments><article><p>{}</p></article></div></main>",
        "<div class='post comments-open'><p>{}</p></div>", "<article class='post category-reply'><p>{}</p></article>",
    ],
)
def test_comment_words_and_forms_around_the_article(page):
    assert main_text(page.format(LONG)) == LONG


@pytest.mark.parametrize(
    "piece",
    [
        "<section id=comments><article><p>{}</p></article></section>", "<article id=div-comment-5><p>{}</p></article>",
        "<div class=replies><article class=reply><p>{}</p></article></div>", "<p class=comments-closed>{}</p>",
        "<article itemprop=comment><p>{}</p></article>", "<aside><form><article><p>{}</p></article></form></aside>",
    ],
)
def test_comments_stay_out(piece):
    assert main_text(f"<article><p>{LONG}</p></article>{piece.format(FURNITURE)}") == LONG
    assert main_text(f"<article><p>{LONG}</p>{piece.format(FURNITURE)}</article>") == LONG


@pytest.mark.parametrize("anchor", ["<a id='s1'/>", "<a name=top>", "<a id=s1 />", "<a href='x'/>", "<a/>"])
def test_anchors_without_a_target_are_no_links(anchor):
    assert main_text(f"<article>{anchor}<p>{LONG}</p><p>{LONG}</p></article>") == f"{LONG}\n{LONG}"
    assert main_text(f"<body>{anchor}<h2>Head</h2><p>{LONG}</p>") == f"Head\n{LONG}"


def test_links_end_with_the_element_around_them():
    assert main_text(f"<article><p><a href=x>{FURNITURE}</p><p>{LONG}</p></article>") == LONG
    assert main_text(f"<article><p><a href=x>{FURNITURE}<p>{LONG}</article>") == LONG
    assert main_text(f"<p><a href=/x/>{FURNITURE}</a></p><p>{LONG}</p>") == LONG
    card = f"<a href=x><h3>Head</h3><div>{FURNITURE}</div><p>{FURNITURE}</p></a>"
    assert main_text(f"<ul><li>{card}<li>{card}</ul><p>{LONG}</p>") == LONG


@pytest.mark.parametrize("icon", ['<svg class="i"/>', "<math/>", "<object data=x/>", '<video src="x" />', "<svg><title/><path d=x/></svg>"])
def test_self_closed_pictures_are_empty(icon):
    assert main_text(f"<article><p>one {icon} two</p><p>{LONG}</p></article>") == f"one two\n{LONG}"
    assert main_text(f"<article>{icon}<p>{LONG}</p></article>") == LONG


@pytest.mark.parametrize("tag", ["canvas", "audio", "svg class=i", "object", "video", "template", "noscript"])
def test_skipped_elements_end_with_the_element_around_them(tag):
    assert main_text(f"<article><p>one <{tag}> two</p><p>{LONG}</p></article>") == f"one\n{LONG}"
    assert main_text(f"<article><p>one <span><{tag}>x</span> two</p><p>{LONG}</p></article>") == f"one two\n{LONG}"
    name = tag.split()[0]
    whole = f"<{tag}><p>{FURNITURE}</p><{tag}><b>x</b></i></{name}>y</{name}>"
    assert main_text(f"<article><p>one {whole} two</p><p>{LONG}</p></article>") == f"one two\n{LONG}"


def test_raw_text_runs_to_its_end():
    assert main_text(f"<p>{LONG}<script>a</p><p>{FURNITURE}") == LONG
    assert main_text(f"<p>{LONG}<style/>a</style> Yes.</p>") == f"{LONG} Yes."
    assert main_text(f"<title>a<p>{FURNITURE}</title><p>{LONG}</p><titles>x</titles>") == f"{LONG}\nx"


@pytest.mark.parametrize(
    "page", ["<svg>" * 50_000, "<p><svg>" * 30_000, "<object/>" * 50_000, "<svg><title/>" * 50_000, "<canvas></p>" * 50_000]
)
def test_many_skipped_elements_take_linear_time(page):
    begin = time.perf_counter()
    main_text(page)
    assert time.perf_counter() - begin < 10


def test_running_text_may_mention_the_copyright_sign():
    assert main_text(f"<body><p>{LONG} It is the \N{COPYRIGHT SIGN} of all.</p></body>").startswith(LONG)
    assert main_text(f"<body><p>{LONG}</p><p>&copy; 2024 Example Ltd.</p></body>") == LONG
    line = "Example Publishing Limited \N{COPYRIGHT SIGN} 2024 Springfield Registered Office Number 12345678"
    assert main_text(f"<body><p>{LONG}</p><p>{line}</p></body>") == LONG


def test_text_inside_a_block():
    assert main_text(f"<p>a&amp;b&nbsp;&lt;c&#62; &eacute;&#x41;\n\t  {LONG}<br>next <b>bold</b>er</p>") == (
        f"a&b <c> éA {LONG} next bolder"
    )
    assert main_text(f"<p>{LONG}<br><br>{LONG}</p>") == f"{LONG}\n{LONG}"
    assert main_text(f"<div>{LONG}<div>{LONG}</div>x</div>") == f"{LONG}\n{LONG}\nx"


def test_articles_without_stop_words_stay():
    odd = "Qwrt%%% zxcv### " * 20
    assert main_text(f"<nav>a</nav><article><p>{odd}</p><p>Zz.</p></article><footer>f</footer>") == f"{odd.strip()}\nZz."


def test_short_blocks_follow_their_neighbours():
    links = "<p><a href=1>one</a> <a href=2>two</a></p>"
    assert main_text(f"<body><p>{LONG}</p><p>Near.</p>{links}<p>menu end</p>{links}") == f"{LONG}\nNear."
    assert main_text("<p>Hello world") == "Hello world"
    assert main_text(f"<article><p>{LONG}</p>{links}<h3>More</h3>{links}<p>End.</p></article>") == f"{LONG}\nEnd."


@pytest.mark.parametrize("cut", [0, 3, 5, 20, 60, 100, 140])
def test_cut_pages(cut):
    page = f"<article><p>{LONG}</p><p class='x'>{LONG}</p></article>"
    text = main_text(page[:cut])
    assert "<" not in text and LONG.startswith(text.split("\n")[0])


def test_broken_html():
    assert main_text(None) == main_text("") == main_text("<br><p></p>") == main_text("<script>x") == ""
    assert main_text(f"<p>{LONG}</div></span></p></article>") == LONG
    assert main_text(f'<a title="x><p>{LONG}') == ""  # the quote never ends: all of it is the tag
    assert main_text("a < b and 1 <2") == "a < b and 1 <2"
    assert main_text("<p>" * 2000 + LONG) == LONG
    assert main_text("<div class=a>" * 3000 + LONG + "</div>" * 3000) == LONG


@pytest.mark.parametrize(
    "page",
    ["<div>x" * 100_000, "</b>" * 100_000 + "<div>" * 50_000, "<a " * 200_000, '<a "' * 200_000, "<p " + "a" * 300_000 + ">x",
     "<!--" * 100_000, "<script>" * 100_000, "<" * 300_000, "&" * 300_000, "<p>a" * 100_000, "<span class=ad>" * 30_000 + "</div>" * 30_000],
)
def test_hostile_pages_take_linear_time(page):
    begin = time.perf_counter()
    main_text(page)
    assert time.perf_counter() - begin < 10


def test_odd_rows(spark):
    rows = [(1, None, None, "mine"), (2, "u", "", "mine"), (2, "u", "", "mine"), (None, "v", f"<p>{LONG}", "mine")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text_x string")
    out = extracted(pages, F.col("html"), "main")
    assert out.columns == [*pages.columns, "main"]
    assert sorted(r["main"] for r in out.collect()) == ["", "", "", LONG]
    assert extracted(pages.where("false"), F.col("html")).count() == 0


@pytest.mark.parametrize(
    "page",
    [
        '<div class="layout no-sidebar"><div class="entry"><p>{}</p></div></div>',
        '<div class="page header-fixed nav-open"><p>{}</p></div>', '<div class="post related-wrapper"><p>{}</p></div>',
        '<div class="section-header-content"><p>{}</p></div>', '<div class="topic social science"><p>{}</p></div>',
        "<form><fieldset><main><p>{}</p></main></fieldset></form>", "<form><p>{}</p></form>",
        '<div class="page header-x"><div class="section-header-content"><p>{}</p></div></div>',
        '<article><div class="post related-wrapper"><p>{}</p></div></article>',
    ],
)
def test_wrappers_named_like_furniture_keep_their_text(page):
    assert main_text(page.format(LONG)) == LONG
    side = f'<div class="sidebar"><p>{FURNITURE}</p></div>'
    assert main_text(page.format(f"{LONG}</p><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p>{side}<p>")) == "\n".join([LONG] * 4)


def test_real_furniture_is_no_wrapper():
    """Named after furniture alone, or not holding most of the text, an element is left out as ever."""
    for name in ("cookie-notice", "sidebar", "ad", "page-sidebar left"):
        assert main_text(f"<div class=content><p>{LONG}</p></div><div class='{name}'><p>{FURNITURE}</p></div>") == LONG
    assert main_text(f"<div class='cookie-notice'><p>{FURNITURE}</p></div>") == ""
    assert main_text(f"<article><p>One.</p></article><div class='page sidebar'><p>{FURNITURE}</p></div>") == "One."


def test_linked_titles_stay():
    for tag in ("h1", "h2"):
        assert main_text(f"<article><{tag}><a href=x>Title</a></{tag}><p>{LONG}</p></article>") == f"Title\n{LONG}"
    after = f"<article><p>{LONG}</p><h2><a href=x>Another page</a></h2><p><a href=y>{FURNITURE}</a></p></article>"
    assert main_text(after) == LONG


def test_controls_inside_a_sentence_are_part_of_it():
    page = f"<article><p>Press the <button>Go</button> key and <label>it</label> goes.</p><p>{LONG}</p><button>Send</button></article>"
    assert main_text(page) == f"Press the Go key and it goes.\n{LONG}"


class PlainPage(html_parser.HTMLParser):
    """A plain reading of well-formed pages: every text with the elements open around it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.pieces, self.cut = [], [], 0

    def handle_starttag(self, tag, attrs):
        if tag not in html_blocks.INLINE | {"br"}:
            self.cut += 1
        if tag not in html_blocks.VOID:
            self.open.append((tag, " ".join(f'{k}="{v}"' for k, v in attrs), object()))

    def handle_endtag(self, tag):
        if tag not in html_blocks.INLINE:
            self.cut += 1
        while self.open and self.open.pop()[0] != tag:
            pass

    def handle_data(self, data):
        self.pieces.append((self.cut, data, list(self.open)))


def plain_main_text(page):
    """Two passes over blocks of well-formed pages without comments or names that only sound like furniture."""
    reader = PlainPage()
    reader.feed(re.sub(r"<br ?/?>", "\n", page))
    found = []
    for _, group in itertools.groupby(reader.pieces, key=lambda p: p[0]):
        group = [g for g in group if not {t for t, _, _ in g[2]} & {"script", "style", "title", "noscript", "svg", "iframe"}]
        text = " ".join("".join(t for _, t, _ in group).split())
        if not text:
            continue
        around = group[0][2]
        linked = sum(len(" ".join(t.split())) for _, t, o in group if any(x[0] == "a" and "href" in x[1] for x in o))
        main = bad = False
        for tag, attributes, _ in around:
            weight = html_blocks._weight(tag, attributes)
            if weight == html_blocks.MAIN:
                main, bad = True, bad and weight != html_blocks.MAIN
            elif weight and not (weight == html_blocks.SOFT and main and tag == "header"):
                bad = True
        letters = re.findall(r"[^\W\d_]+", text.lower())
        dense = sum(w in html_blocks.STOP_WORDS for w in letters) >= html_blocks.STOP_DENSITY * max(1, len(letters))
        label = None
        if bad or linked > html_blocks.LINK_DENSITY * len(text):
            label = False
        elif len(text) >= html_blocks.SHORT_CHARS and dense:
            label = True
        elif not main and "\N{COPYRIGHT SIGN}" in text:
            label = False
        found.append((text, main, bad, label))
    out = []
    for i, (text, main, _, label) in enumerate(found):
        if label is None:
            zone = [(abs(k - i), not x[3], k) for k, x in enumerate(found) if x[1] == main and x[3] is not None and not (main and x[2])]
            left, right = [z for z in zone if z[2] < i], [z for z in zone if z[2] > i]
            if main:
                sides = [min(z)[1] for z in (left, right) if z]
                label = len(sides) < 2 or not all(sides)
            else:
                label = not min(zone)[1] if zone else all(x[3] is None for x in found)
            if not label and not main and not any(x[3] for x in found):
                label = len(text) >= html_blocks.SHORT_CHARS
        if label:
            out.append(text)
    return "\n".join(out)


def test_pages_of_the_table_equal_a_plain_second_labeller(spark):
    pages = table(spark, SF.replace("0.001", "0.01"), "pages").collect()
    assert len(pages) > 200
    for r in pages:
        assert main_text(r["html"]) == plain_main_text(r["html"]), r["page_id"]
        loose = re.sub("</?article>", "", r["html"])
        assert main_text(loose) == plain_main_text(loose), r["page_id"]

"""Main text of pages against a plain reading of marked articles, built pages and all contiguous runs."""

import html
import itertools
import random
import re

import numpy as np
import pytest
from conftest import SMALL

from serupa.llm import main_text
from serupa.llm.queries import QUERIES

W = main_text.fit(main_text.fragments())


def plain(page):
    """Text of the marked article by its tags alone."""
    found = re.search(r"<article>(.*?)</article>", page or "", re.S)
    blocks = re.split(r"</?(?:p|h1)>", found[1]) if found else []
    texts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks)
    return "\n".join(t for t in texts if t)


def test_query_equals_plain_reading(spark):
    got = {r.page_id: r for r in QUERIES["op12_main_text"](spark, SMALL).collect()}
    rows = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.page_id].text == plain(r.html) and got[r.page_id].n_chars == len(plain(r.html)) and got[r.page_id].url == r.url


def test_best_range_equals_all_ranges():
    r = random.Random(5)
    for _ in range(300):
        values = np.array([r.choice([-3, -2, -1, -1, 0, 1, 2, 3]) for _ in range(r.randint(0, 12))], float)
        sums = [(values[i:j].sum(), -i, j) for i, j in itertools.combinations(range(len(values) + 1), 2)]
        best = max([s for s, _, _ in sums], default=0)
        first, behind = main_text.best_range(values)
        assert values[first:behind].sum() == max(best, 0)
        if best > 0:
            starts = [-i for s, i, _ in sums if s == best]
            assert first == min(starts) or values[min(starts) : first].sum() == 0


ARTICLE = ["Title of the piece", "First paragraph, with a link in it, of some words.", "Second & last paragraph: it ends here, after more words."]


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>Not this</title>{head}</head><body>{body}</body></html>"


def blocks(open_="", close=""):
    a, b, c = ARTICLE
    return f"<h1>{a}</h1><p>{b.replace('a link', '<a href=/x>a link</a>')}</p>{open_}<p>{html.escape(c)}</p>{close}"


NOISE = {
    "nav": "<nav><ul><li><a href='/a'>Home</a><li><a href='/b'>World</a></ul></nav>",
    "menu": "<div class='main-menu'><ul><li><a href='/a'>Home</a></li><li><a href='/b'>World news</a></li></ul></div>",
    "header": "<header><div class='logo'>The Daily Paper</div><p>All the news that there is, every day</p></header>",
    "site name": "<header class='site-header'><h1>The Daily Paper and its name</h1></header>",
    "sidebar": "<div id='sidebar'><h3>Most read</h3><p>Another story about something else, told at some length here</p></div>",
    "aside": "<aside><p>Another story about something else, told at some length here, and then some</p></aside>",
    "cookie": "<div class='cookie-notice'><p>We use cookies to give you the best experience on this site and beyond</p></div>",
    "ad": "<div class='ad'>Buy this wonderful thing now, it is cheap and good and yours today</div>",
    "form": "<form action='/s'><label>Your mail</label><input name=q><p>Sign up and read more of our words each day</p><button>Go</button></form>",
    "script": "<script>if (a < b) { document.write('<p>many words that are no text at all</p>') }</script>",
    "style": "<style>p > a { color: red }</style>",
    "comments": "<section class='comments'><h2>3 comments</h2><div class='comment'><p>I liked this a lot, thank you for all these words</p></div></section>",
    "footer": "<footer><p>Copyright by the paper, all rights reserved, and so on and on</p></footer>",
    "comment": "<!-- <p>hidden words in a comment that nobody reads</p> -->",
}


@pytest.mark.parametrize("mark", ["article", "main", "div class='post-content'", "div id=content", "div", "section"])
@pytest.mark.parametrize("name", sorted(NOISE))
def test_noise_stays_out(name, mark):
    noise, end = NOISE[name], mark.split()[0]
    around = page(f"{noise}<{mark}>{blocks()}</{end}>{noise}")
    inside = page(f"<{mark}>{blocks(noise)}</{end}>")
    for p in (around, inside) if name != "site name" else (around,):
        assert main_text.main_text(p, W) == "\n".join(ARTICLE), p


def test_long_advert_does_not_part_the_article():
    for n in (10, 10_000):
        noise = f"<div class='advert'><p>{'buy ' * n}</p></div>"
        assert main_text.main_text(page(f"<article>{blocks(noise)}</article>"), W) == "\n".join(ARTICLE)


@pytest.mark.parametrize(
    "raw, text",
    [
        ("", ""),
        ("<p></p>", ""),
        ("plain words", "plain words"),
        ("<p>a &lt;b&gt; &amp;amp; c&nbsp;d &#233;&#x1F600;", "a <b> &amp; c d é😀"),
        ("<p>one<br>two\n\t three<p>four", "one two three\nfour"),
        ("<article><p><b>bold<br><p>next</article><footer>no no no</footer>", "bold\nnext"),
        ("<p>1 < 2 and a<b", "1 < 2 and a<b"),
        ("<p title='a > b'>quoted</p>", "quoted"),
        ("<P CLASS=x>Upper</P><SCRIPT>no</SCRIPT>", "Upper"),
        ("<p>kept</p><script>unclosed words", "kept"),
        ("<p>kept</p><!-- unclosed words", "kept"),
        ("<table><tr><td>a1<td>b1<tr><td>a2<td>b2</table>", "a1\nb1\na2\nb2"),
        ("<p>in<b>ter</b>national</p>", "international"),
    ],
)
def test_reading(raw, text):
    assert main_text.main_text(raw, W) == text


def test_odd_rows_and_clashing_columns(spark):
    rows = [(1, None, None, "x", 7), (1, "", "", "y", 8), (None, "u", "<p>words <b>here", "z", None), (None, "u", "<p>words <b>here", "z", None), (3, "l", "<article>" + "<p>word word" * 40_000, None, 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = sorted(((r.page_id or 0, r.text, r.n_chars) for r in main_text.extract(pages, ["page_id", "url", "text", "n_chars"]).collect()), key=repr)
    long = "\n".join(["word word"] * 40_000)
    assert got == sorted([(1, "", 0), (1, "", 0), (0, "words here", 10), (0, "words here", 10), (3, long, len(long))], key=repr)
    assert main_text.extract(pages.limit(0), ["page_id"]).collect() == []


def test_weights_are_learned_from_marked_pages(spark):
    """A container that no fragment knows is left out once marked pages show it outside their articles."""
    odd = "<div class='zorp'><p>Some words of a box that stands on every page of this site</p></div>"
    rows = [(i, page(f"{odd}<article>{blocks()}</article>{odd}")) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    unmarked = page(f"{odd}<div>{blocks()}</div>{odd}")
    assert "zorp" not in " ".join(W.feature) and main_text.main_text(unmarked, W) != "\n".join(ARTICLE)
    learned = main_text.fit_pages(pages)
    assert main_text.main_text(unmarked, learned) == "\n".join(ARTICLE)
    assert learned.feature["mark:zorp"] < 0 and min(learned.cost.values()) >= main_text.LEAST_COST

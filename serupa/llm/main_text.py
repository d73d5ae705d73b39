"""Main text of web pages: the maximum-scoring run of words and tags, with weights learned from labelled pages.

A page is read once as words and tags. Each word scores 2p - 1, where p, the chance that it belongs to the article,
comes from a logistic regression on the elements around it: their names and the words of their class, id, role and
itemprop. Each tag scores below zero, by how much more often per word it stands outside articles than inside. A linear
scan finds the contiguous run with the highest sum; of that run, words whose containers score as boilerplate
(an advert or a form inside the article) are left out. An excluded stretch costs ``CROSSING`` words at most, so that an
advert of any length does not part an article.

Weights are fitted on ``FRAGMENTS`` and on pages of the table that mark their article themselves (article, main, role
main, itemprop articleBody): at most 2 * ``FIT_PAGES`` of them, drawn by hash. Each is learned twice, once with those
marks hidden, so that pages without them are read as well. Pages of unmarked articles need no such rows.

Blocks end at tags of block elements; br is white space. Character references are decoded after tags were told from
text. Comments, scripts, styles, heads and what they hold are no text; an unclosed one reaches to the page's end.

Defined results: null and empty html, and pages without a word that scores above zero, have the empty text. Equal
pages have equal texts. Of runs that score alike the first wins, and the longest of those. No text is cut.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serupa.llm.batches import map_text
from serupa.llm.sampling import bounded_sample

FIT_PAGES = 1500
CROSSING = 4.0  # words
LEAST_COST, MOST_COST = 0.1, 0.5  # of a tag, in words: a list item of one word pays for its two tags
FRAGMENT_WEIGHT = 6.0  # of a labelled fragment outside articles, against log(1 + words) of a place in a page
_STEPS = 300

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*>|(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^"'>]+)*+)>|(/?)([A-Za-z][^\s/>]*)([^>]*)>)""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_MARK = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# The elements of HTML by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("script style noscript template textarea title iframe object svg canvas audio video select button head".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
NEUTRAL = frozenset("html body div span section center".split())  # names that say nothing about what they hold
INLINE = frozenset("a abbr b bdi bdo big cite code em font i kbd label mark q s small span strong sub sup time tt u var".split())

# Labelled containers, as the labels of a page would give them. Words of class and id names.
MAIN_MARKS = "article content post entry story body main text prose page".split()
OTHER_MARKS = (
    "nav menu navbar navigation breadcrumb breadcrumbs pagination pager tabs toc header masthead topbar branding logo banner footer foot bottom copyright legal "
    "sidebar side aside widget rail related recommended recommendations popular trending teaser more ad ads advert adverts advertisement advertising sponsor "
    "sponsored promo promotion cookie cookies consent gdpr notice notification alert warning disclaimer newsletter subscribe subscription signup login "
    "paywall popup modal overlay form search share sharing social comment comments reply replies respond response responses discussion disqus "
    "feedback reviews tag tags meta byline author skip hidden print tools toolbar"
).split()
MAIN_TAGS = "article main p h1 h2 h3 h4 blockquote pre figure figcaption ul ol li table td dl".split()
OTHER_TAGS = "nav aside footer form header address menu dialog fieldset".split()


def fragments() -> list[tuple[frozenset[str], bool, float]]:
    """(features, belongs to the article, weight) of the labelled containers, alone and with paragraphs and articles; both labels weigh alike."""
    rows = []
    for mark in MAIN_MARKS:
        rows += [({f"mark:{mark}"}, True), ({f"mark:{mark}", "tag:p"}, True)]
    for tag in MAIN_TAGS:
        rows += [({f"tag:{tag}"}, True), ({"tag:article", f"tag:{tag}"}, True)]
    both = ["tag:main", "tag:article", "tag:p", "tag:h3", *(f"mark:{m}" for m in MAIN_MARKS)]
    for around in ([], ["tag:p"], ["tag:article", "tag:p"], ["mark:content", "tag:p"], ["tag:h2"], both):
        rows += [({*around, f"mark:{mark}"}, False) for mark in OTHER_MARKS]
        rows += [({*around, f"tag:{tag}"}, False) for tag in OTHER_TAGS]
    rows += [(set(), True), ({"tag:p", "tag:a"}, True), ({"tag:article", "tag:p", "tag:a"}, True), ({"tag:ul", "tag:li"}, True)] * 8
    rows += [({"tag:ul", "tag:li", "tag:a"}, False), ({"tag:a"}, False), ({"tag:header", "tag:h1"}, False), ({"tag:header", "mark:header", "tag:h1"}, False)] * 16
    rows += [({"tag:article", "tag:header", "tag:h1"}, True), ({"tag:article", "tag:header", "mark:header", "tag:h1"}, True)] * 8
    n_main = sum(label for _, label in rows)
    return [(frozenset(f), label, FRAGMENT_WEIGHT * ((len(rows) - n_main) / n_main if label else 1.0)) for f, label in rows]


@dataclass
class Weights:
    bias: float = 0.0
    feature: dict[str, float] = field(default_factory=dict)
    cost: dict[str, float] = field(default_factory=dict)


@dataclass(slots=True)
class Run:
    """Text between two tags."""

    text: str
    words: int
    block: int
    score: float  # log-odds of the article
    container: float  # the same without the names of inline elements
    features: frozenset[str] | None
    label: bool | None


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, "") | ("open" | "close", name, attributes) in page order; unread elements are one open tag."""
    at, last = 0, page.rfind(">")
    while at < len(page):
        found = _TAG.search(page, at) if at <= last or "<!--" in page[at:] else None
        if found is None:
            yield "text", page[at:], ""
            return
        if found.start() > at:
            yield "text", page[at : found.start()], ""
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            continue
        if found[1] or found[4]:
            yield "close", name, ""
            continue
        attributes = found[3] or found[6] or ""
        yield "open", name, attributes
        if name in UNREAD and not attributes.endswith("/"):
            end = re.compile(rf"</{name}\b[^>]*>" + (r"|(?=<body\b)" if name == "head" else ""), re.I).search(page, at)
            at = end.end() if end else len(page)


def features_of(name: str, attributes: str) -> tuple[str, ...]:
    own = () if name in NEUTRAL else (f"tag:{name}",)
    if "=" not in attributes or name in ("html", "body"):
        return own
    marks = (m.lower() for a in _ATTRIBUTE.finditer(attributes) for m in _MARK.findall(a[2] or a[3] or a[4] or ""))
    return (*own, *(f"mark:{m}" for m in dict.fromkeys(marks)))


def is_labelled(name: str, attributes: str) -> bool:
    return name in ("article", "main") or bool(re.search(r"""role\s*=\s*["']?main\b|itemprop\s*=\s*["']?articleBody\b""", attributes))


class Reader:
    """Runs and (tag, stands in a labelled element) of a page, scored by ``weights``; with ``learn``, features and labels are kept too."""

    def __init__(self, weights: Weights, learn: bool = False, hide: bool = False) -> None:
        self.weights, self.learn, self.hide = weights, learn, hide

    def read(self, page: str) -> list[Run | tuple[str, bool]]:
        weight, out = self.weights.feature, []
        stack: list[tuple[str, tuple[str, ...]]] = []
        held: dict[str, int] = {}  # features of the open elements
        names: dict[str, int] = {}  # their names
        score = container = self.weights.bias
        inside: list[tuple[int, float]] = []  # depth and score at the labelled elements
        block = 0

        def pop():
            nonlocal score, container
            name, own = stack.pop()
            names[name] -= 1
            for f in own:
                held[f] -= 1
                if not held[f]:
                    del held[f]
                    w = weight.get(f, 0.0)
                    score -= w
                    container -= w * (f[4:] not in INLINE or f[0] == "m")
            if inside and inside[-1][0] > len(stack):
                inside.pop()

        def close(name):
            while stack[-1][0] != name:
                pop()
            pop()

        for kind, name, attributes in tokens(page):
            if kind == "text":
                text = html.unescape(name)
                words = len(text.split())
                if not words:
                    out.append(Run(" ", 0, block, 0.0, container, None, None))
                    continue
                label = bool(inside) and container - inside[-1][1] + self.weights.bias > 0 if self.learn else None
                out.append(Run(text, words, block, score, container, frozenset(held) if self.learn else None, label))
                continue
            block += name in BLOCK
            if kind == "close":
                if names.get(name):
                    close(name)
                out.append((name, bool(inside)))
                continue
            if name in BLOCK and names.get("p"):
                close("p")
            for other in CLOSES.get(name, ()):
                if names.get(other):
                    depth = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == other or stack[i][0] in SCOPE[name])
                    if stack[depth][0] == other:
                        while len(stack) > depth:
                            pop()
            out.append((name, bool(inside)))
            if name == "br":
                out.append(Run(" ", 0, block, 0.0, container, None, None))
            if name in VOID or name in UNREAD or attributes.endswith("/"):
                continue
            labelled = self.learn and is_labelled(name, attributes)
            own = () if labelled and self.hide else features_of(name, attributes)
            stack.append((name, own))
            names[name] = names.get(name, 0) + 1
            for f in own:
                held[f] = held.get(f, 0) + 1
                if held[f] == 1:
                    w = weight.get(f, 0.0)
                    score += w
                    container += w * (f[4:] not in INLINE or f[0] == "m")
            if labelled:
                inside.append((len(stack), container))
        return out


def best_range(values: np.ndarray) -> tuple[int, int]:
    """(first, behind the last) of the contiguous values with the largest sum above zero; (0, 0) if there is none."""
    best, best_at, total, start = 0.0, (0, 0), 0.0, 0
    for i, v in enumerate(values):
        if total <= 0:
            total, start = 0.0, i
        total += v
        if total > best or total == best and best_at[0] == start and best > 0:
            best, best_at = total, (start, i + 1)
    return best_at


def main_text(page: str, weights: Weights) -> str:
    items = Reader(weights).read(page)
    values = np.zeros(len(items))
    stretch = 0.0  # what the present excluded stretch has cost
    for i, item in enumerate(items):
        if isinstance(item, tuple):
            value = -weights.cost.get(item[0], LEAST_COST)
        else:
            value = item.words * float(np.tanh(item.score / 2))
        if value < 0:
            value = -min(-value, CROSSING - stretch)
            stretch -= value
        elif value > 0:
            stretch = 0.0
        values[i] = value
    first, behind = best_range(values)
    blocks: dict[int, list[str]] = {}
    for item in items[first:behind]:
        if isinstance(item, Run) and item.container > 0:
            blocks.setdefault(item.block, []).append(item.text)
    return "\n".join(t for t in (" ".join("".join(b).split()) for b in blocks.values()) if t)


def fit(places: list[tuple[frozenset[str], bool, float]], tags: dict[str, tuple[int, int]] | None = None, words: tuple[int, int] = (0, 0)) -> Weights:
    """Logistic regression on (features, label, weight), by Newton steps with a ridge; tag costs from (inside, outside) counts."""
    names = sorted({f for features, _, _ in places for f in features})
    index = {f: i + 1 for i, f in enumerate(names)}
    x = np.zeros((len(places), len(names) + 1))
    x[:, 0] = 1
    for row, (features, _, _) in enumerate(places):
        x[row, [index[f] for f in features]] = 1
    y, n = np.array([p[1] for p in places], float), np.array([p[2] for p in places])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 0.1)
    for _ in range(_STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (p - y)) + ridge * w
        curve = (x.T * (n * p * (1 - p))) @ x + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    rate = lambda count, of: np.log((count + 1) / (of + 100))
    cost = {t: float(np.clip(rate(out, words[1]) - rate(in_, words[0]), LEAST_COST, MOST_COST)) for t, (in_, out) in sorted((tags or {}).items())}
    return Weights(float(w[0]), {f: float(w[i]) for f, i in index.items()}, cost)


def _places(pages: DataFrame, page: str, start: Weights) -> DataFrame:
    """(kind, name, label, words): places of labelled pages with their words, and counts of tags inside and outside."""
    schema = pa.schema([("kind", pa.string()), ("name", pa.string()), ("label", pa.bool_()), ("words", pa.int64())])

    def learn(batches):
        for batch in batches:
            found: dict[tuple, int] = {}
            for raw in batch.column(0).to_pylist():
                for hide in (False, True):
                    items = Reader(start, True, hide).read(raw)
                    runs = [(r, r.label) for r in items if isinstance(r, Run) and r.words]
                    if not any(label for _, label in runs):
                        break
                    for r, label in runs:
                        key = ("place", " ".join(sorted(r.features)), label)
                        found[key] = found.get(key, 0) + r.words
                    for item in items if not hide else ():
                        if isinstance(item, tuple):
                            key = ("tag", *item)
                            found[key] = found.get(key, 0) + 1
            rows = [(*k, n) for k, n in found.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    found = pages.select(F.col(page).cast("string")).mapInArrow(learn, "kind string, name string, label boolean, words long")
    return found.groupBy("kind", "name", "label").agg(F.sum("words").alias("words"))


def fit_pages(pages: DataFrame, page: str = "html") -> Weights:
    """Weights from the fragments and from a bounded sample of the pages that mark their article."""
    known = fragments()
    start = fit(known)
    marked = pages.where(F.col(page).rlike(r"(?i)<(article|main)\b|role\s*=\s*[\"']?main\b|itemprop\s*=\s*[\"']?articleBody\b"))
    places, tags, words = [], {}, [0, 0]
    rows = _places(bounded_sample(marked, FIT_PAGES, page), page, start).collect()  # of a bounded sample
    for kind, name, label, n in sorted(map(tuple, rows)):
        if kind == "place":
            places.append((frozenset(name.split()), label, float(np.log1p(n))))
            words[not label] += n
        else:
            counts = tags.setdefault(name, [0, 0])
            counts[not label] += n
    return fit(known + places, {t: tuple(c) for t, c in tags.items()}, tuple(words))


def extract(pages: DataFrame, keep: list[str], page: str = "html", weights: Weights | None = None) -> DataFrame:
    """``keep`` columns, text and n_chars (code points) of each page; fitted on the table if no weights are given."""
    known = weights or fit_pages(pages, page)

    def work():
        def fn(raws):
            texts = [main_text(r.decode("utf-8", "replace"), known) if r else "" for r in raws]
            return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

        return fn

    return map_text(pages, "text string, n_chars long", work, keep, page)


def op12(spark: SparkSession, folder: str) -> DataFrame:
    return extract(spark.read.parquet(f"{folder}/pages.parquet"), ["page_id", "url"]).select("page_id", "url", "text", "n_chars")

"""Personal data by patterns and a skip-chain conditional random field.

Patterns find the base spans. The field then decides on the mentions that patterns miss: number runs of seven
or more digits, addresses without a full domain, and, in texts with an address, words joined by marks. Base
spans and candidates are its nodes; chain edges join neighbours in the text, skip edges join distant mentions
that repeat or resemble each other: the same last seven digits, or the same local part. Besides the next mention of
its key, each unsure mention is joined to the key's hubs (the first base span of each kind, else the first mention), so
that evidence reaches all mentions of a text in the same round, however many stand between. Loopy sum-product
message passing lets a sure mention (a base span) decide on unsure ones of the same entity, such as a phone number
without country code or a local part without its host. A candidate gets the kind whose belief is at least
``BELIEF``. Base spans are evidence and always stay.

The field is fitted by pseudo-likelihood on nodes of at most 2 * ``FIT_DOCS`` documents drawn by hash. Labels are the
base kinds; candidates that resemble nothing are "other". Each base span has two twins with only the weak part of
its features: one joined to it by a skip edge, with its label, and one alone, labelled "other". So the skip weights
are learned, and what looks like a kind but repeats nothing known stays out.

Defined results: null and empty texts have no spans. Repeated rows get equal results. Without any node to fit
on, the prior weights are used. An empty table gives no rows. Nothing depends on ids.
"""

from __future__ import annotations

import pickle
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serupa.llm.batches import map_text
from serupa.llm.sampling import bounded_sample
from serupa.llm.spans import FIELD, count, digest, ordered, to_arrow

KINDS = ("email", "ip", "card", "phone")
OTHER = 0  # label of no kind; kind i has label i + 1
LABELS = 1 + len(KINDS)
FIT_DOCS = 4000
FIT_NODES = 200  # of one document
BELIEF = 0.5
ROUNDS = 12
NEAR = 80  # characters between neighbours on the chain
TAIL = 7  # digits that two numbers share to be similar

# The base patterns.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # a match can only start a run of digits
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_NUMBER = re.compile(r"[+(]?[0-9](?:[ ().-]{0,3}[0-9])*")
_ADDRESS = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+")
_JOINED = re.compile(r"[A-Za-z0-9]+(?:[._%+-]+[A-Za-z0-9]+)+")
_DIGITS = re.compile("[0-9]")
_SIGNS = bytes(sorted(set(range(256)) - set(b"0123456789@")))
_CUES = {"email": ("mail", "email", "e-mail", "write"), "ip": ("ip", "host", "server", "address"), "card": ("card", "visa", "credit"), "phone": ("tel", "phone", "call", "fax", "mobile")}


def _digits(s: str) -> str:
    return "".join(_DIGITS.findall(s))


def luhn(digits: str) -> bool:
    doubled = [int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def _small(part: str) -> bool:
    return len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            free = host.end()
            out.append(("email", start, free))
        at = text.find("@", at + 1)
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return ordered(out, KINDS)


@dataclass
class Nodes:
    """Nodes of a text by start: spans, labels (-1: to be decided), features, keys of similarity."""

    spans: list[tuple[int, int]] = field(default_factory=list)
    labels: list[int] = field(default_factory=list)
    features: list[np.ndarray] = field(default_factory=list)
    keys: list[str | None] = field(default_factory=list)

    def add(self, text: str, start: int, end: int, label: int) -> None:
        token = text[start:end]
        digits = _digits(token)
        self.spans.append((start, end))
        self.labels.append(label)
        self.features.append(_features(text, start, token, digits))
        if "@" in token:
            self.keys.append(token.partition("@")[0].lower())
        else:
            self.keys.append(digits[-TAIL:] if len(digits) >= TAIL else token.lower() if any(map(str.isalpha, token)) else None)


STRONG = slice(1, 6)  # features that a twin lacks
FEATURES = 14 + len(KINDS)


def _features(text: str, start: int, token: str, digits: str) -> np.ndarray:
    n, parts = len(digits), token.split(".")
    before = text[max(0, start - 24) : start].lower().split()[-1:]
    cue = [bool(before) and before[0].strip(":.,(") in _CUES[k] for k in KINDS]
    return np.array(
        [
            1.0, "@" in token, "@" in token and "." in token.partition("@")[2], token.startswith("+"),
            len(parts) == 4 and all(p.isdecimal() and _small(p) for p in parts), 14 <= n <= 19 and luhn(digits),
            any(map(str.isalpha, token)), "." in token, "(" in token, "-" in token or " " in token,
            n < TAIL, TAIL <= n <= 9, 10 <= n <= 13, n >= 14, *cue,
        ],
        np.float64,
    )


def nodes_of(text: str, base: list[tuple[str, int, int]]) -> Nodes:
    busy = sorted((a, b) for _, a, b in base)
    found = [(a, b, KINDS.index(k) + 1) for k, a, b in base]
    runs = [m.span() for m in _NUMBER.finditer(text) if m.end() - m.start() >= TAIL and len(_digits(m[0])) >= TAIL]
    if any(k == "email" for k, *_ in base):
        runs += [m.span() for m in _JOINED.finditer(text)]
    if "@" in text:
        runs += [m.span() for m in _ADDRESS.finditer(text)]
    taken, i = 0, 0
    for a, b in sorted(set(runs), key=lambda r: (r[0], -r[1])):
        while i < len(busy) and busy[i][1] <= a:
            i += 1
        if a >= taken and not (i < len(busy) and busy[i][0] < b):
            found.append((a, b, -1))
            taken = b
    nodes = Nodes()
    for a, b, label in sorted(found):
        nodes.add(text, a, b, label)
    return nodes


def edges_of(nodes: Nodes) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges to the next node if it is near, skip edges to the next node with the same key and from its hubs.

    Hubs of a key are the first base span of each kind, or the first mention if there is none: at most one edge a kind
    for each unsure mention.
    """
    chain = [(i, i + 1) for i in range(len(nodes.spans) - 1) if nodes.spans[i + 1][0] - nodes.spans[i][1] <= NEAR]
    last: dict[str, int] = {}
    hubs: dict[str, dict[int, int]] = {}
    skip = []
    for i, (key, label) in enumerate(zip(nodes.keys, nodes.labels, strict=True)):
        if key:
            if key in last:
                skip.append((last[key], i))
            else:
                hubs[key] = {-1: i}
            last[key] = i
            if label >= 0:
                hubs[key].setdefault(label, i)
    joined = set(skip)
    for i, (key, label) in enumerate(zip(nodes.keys, nodes.labels, strict=True)):
        if key and label < 0:
            sure = [hub for kind, hub in hubs[key].items() if kind >= 0] or [hubs[key][-1]]
            skip += [(hub, i) for hub in sure if hub != i and not joined & {(hub, i), (i, hub)}]
    return chain, skip


@dataclass
class Field:
    """Weights: node (labels, features), chain and skip (labels, labels), both symmetric."""

    node: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    @classmethod
    def prior(cls) -> Field:
        """Nothing is known but that repeated mentions agree, and that what shows nothing is "other"."""
        node = np.zeros((LABELS, FEATURES))
        node[OTHER, 0] = 1.0
        return cls(node, np.zeros((LABELS, LABELS)), 3.0 * np.eye(LABELS))


def fit(samples: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], steps: int = 300, rate: float = 0.05, decay: float = 0.02) -> Field:
    """Pseudo-likelihood ascent (Adam) from the prior, which also is what weights decay to."""
    prior, model = Field.prior(), Field.prior()
    if not samples:
        return model
    shift = np.cumsum([0] + [len(s[0]) for s in samples])
    y = np.concatenate([s[0] for s in samples])
    x = np.concatenate([s[1] for s in samples])
    join = lambda k: np.concatenate([s[k].reshape(-1, 2) + d for s, d in zip(samples, shift, strict=False)]).astype(np.int64)
    one = np.eye(LABELS)[y]
    around = []
    for edges in (join(2), join(3)):
        total = np.zeros((len(y), LABELS))
        np.add.at(total, edges[:, 0], one[edges[:, 1]])
        np.add.at(total, edges[:, 1], one[edges[:, 0]])
        around.append(total)
    weights, priors = [model.node, model.chain, model.skip], [prior.node, prior.chain, prior.skip]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    balance = 1.0 / np.maximum(np.bincount(y, minlength=LABELS), 1)[y]
    balance /= balance.sum()
    for step in range(1, steps + 1):
        score = x @ weights[0].T + around[0] @ weights[1] + around[1] @ weights[2]
        p = np.exp(score - score.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        gap = (one - p) * balance[:, None]
        for i, g in enumerate((gap.T @ x, around[0].T @ gap, around[1].T @ gap)):
            g = g if i == 0 else (g + g.T) / 2
            g = g - decay * (weights[i] - priors[i]) / 10
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            weights[i] += rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return model


def beliefs(model: Field, labels: np.ndarray, x: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> np.ndarray:
    """Marginals by loopy sum-product with damping; known labels are evidence. Edges: (n, 2) node numbers."""
    unary = x @ model.node.T
    known = labels >= 0
    unary[known] = np.where(np.eye(LABELS)[labels[known]] > 0, 0.0, -30.0)
    pair = np.concatenate([np.repeat(model.chain[None], len(chain), 0), np.repeat(model.skip[None], len(skip), 0)])
    edges = np.concatenate([chain, skip]).astype(np.int64).reshape(-1, 2)
    source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    back = np.roll(np.arange(len(source)), len(edges))
    factor = np.exp(np.concatenate([pair, pair]))
    message = np.zeros((len(source), LABELS))
    for _ in range(ROUNDS if len(edges) else 0):
        total = unary.copy()
        np.add.at(total, target, message)
        out = total[source] - message[back]
        out = np.exp(out - out.max(axis=1, keepdims=True))
        new = np.log(np.einsum("es,est->et", out, factor))
        new -= new.max(axis=1, keepdims=True)
        message = 0.5 * message + 0.5 * new
    np.add.at(unary, target, message)
    p = np.exp(unary - unary.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def training_nodes(text: str) -> bytes | None:
    """Pickled (labels, features, chain, skip) of a text's labelled nodes and of their twins, at most ``FIT_NODES``."""
    nodes = nodes_of(text, base_spans(text))
    alike = {k for k in nodes.keys if k and nodes.keys.count(k) > 1} if len(nodes.keys) <= FIT_NODES else set()
    use = [i for i, label in enumerate(nodes.labels) if label > 0 or nodes.keys[i] not in alike][:FIT_NODES]
    if not use:
        return None
    labels, features = [max(nodes.labels[i], OTHER) for i in use], [nodes.features[i] for i in use]
    chain = [(i, i + 1) for i in range(len(use) - 1) if nodes.spans[use[i + 1]][0] - nodes.spans[use[i]][1] <= NEAR]
    skip = []
    for i in range(len(use)):
        weak = features[i].copy()
        weak[STRONG] = 0
        skip.append((i, len(labels)))
        labels += [labels[i], OTHER]
        features += [weak, weak]
    return pickle.dumps((np.array(labels), np.array(features), np.array(chain, np.int64), np.array(skip, np.int64)))


def fit_field(docs: DataFrame, text: str = "text", fit_docs: int = FIT_DOCS) -> Field:
    some = docs.select(F.col(text).cast("string").alias("text")).where(F.col("text").rlike("[0-9@]"))
    drawn = map_text(bounded_sample(some, fit_docs, "text"), "nodes binary", _training, [])
    return fit([pickle.loads(r["nodes"]) for r in drawn.dropna().orderBy("nodes").collect()])  # noqa: S301  at most 2 * fit_docs rows of at most FIT_NODES nodes, made above


def _training():
    return lambda texts: [pa.array([training_nodes(t.decode()) for t in texts], pa.binary())]


def decide(model: Field, texts: list[str]) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text; the fields of all texts are solved together."""
    found: list[tuple[list, list]] = []
    every: list[Nodes] = []
    parts, size = [], 0
    chains, skips = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
    for n, text in enumerate(texts):
        base = base_spans(text)
        found.append((base, list(base)))
        nodes = nodes_of(text, base)
        if -1 in nodes.labels:
            chain, skip = edges_of(nodes)
            chains.append(np.array(chain, np.int64).reshape(-1, 2) + size)
            skips.append(np.array(skip, np.int64).reshape(-1, 2) + size)
            every.append(nodes)
            parts.append((n, size))
            size += len(nodes.spans)
    if every:
        labels = np.array([v for nodes in every for v in nodes.labels])
        x = np.array([v for nodes in every for v in nodes.features])
        p = beliefs(model, labels, x, np.concatenate(chains), np.concatenate(skips))
        for (n, first), nodes in zip(parts, every, strict=True):
            for i, (a, b) in enumerate(nodes.spans):
                kind = int(p[first + i].argmax())
                if nodes.labels[i] < 0 and kind != OTHER and p[first + i, kind] >= BELIEF:
                    found[n][1].append((KINDS[kind - 1], a, b))
    return [(base, ordered(spans, KINDS)) for base, spans in found]


def scan(docs: DataFrame, keep: list[str], text: str = "text", model: Field | None = None) -> DataFrame:
    """``keep`` columns with base_spans and spans, by start, then kind. The field is fitted on ``docs`` unless given."""
    model = model or fit_field(docs, text)

    def work():
        def fn(texts):
            worth = [i for i, t in enumerate(texts) if t and t.translate(None, _SIGNS)]
            solved = dict(zip(worth, decide(model, [texts[i].decode() for i in worth]), strict=True))
            rows = [solved.get(i, ([], [])) for i in range(len(texts))]
            return [to_arrow([b for b, _ in rows]), to_arrow([s for _, s in rows])]

        return fn

    return map_text(docs, f"base_{FIELD}, {FIELD}", work, keep, text)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each span, or run of overlapping spans, replaced by its first kind in angle brackets."""
    out, at = [], 0
    merged: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(b, merged[-1][2])
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[at:a], f"<{kind}>"]
        at = b
    return "".join(out) + text[at:]


def mask(docs: DataFrame, keep: list[str], text: str = "text", model: Field | None = None) -> DataFrame:
    """``keep`` columns and masked_text: the text with its personal data replaced by kinds; null stays null."""
    model = model or fit_field(docs, text)

    def work():
        def fn(texts):
            worth = [i for i, t in enumerate(texts) if t and t.translate(None, _SIGNS)]
            whole = [texts[i].decode() for i in worth]
            new = list(texts)
            for i, t, (_, spans) in zip(worth, whole, decide(model, whole), strict=True):
                new[i] = masked(t, spans).encode()
            return [pa.array(new, pa.binary()).cast(pa.string())]

        return fn

    return map_text(docs, "masked_text string", work, keep, text)


def op7(spark: SparkSession, folder: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), ["doc_id"])
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(digest("base_spans"), 256).alias("base_sha256"), digest("spans").alias("spans"),
    )

"""Language identification with a byte convolutional network, trained in numpy.

Texts (UTF-8, A-Z lowered) are cut into windows of ``WINDOW`` bytes, the last one padded with zeros. Bytes are
embedded, filters of several widths slide over them, each filter's largest response over the window goes through
a rectifier, and a softmax layer gives the languages' shares. A text's share is the mean of its windows',
weighted by their bytes. All windows of the whole text count.

Trained on windows of documents outside the held-out fifth with a known language, at most 2 * ``FIT_DOCS`` of them, drawn
by hash, ``FIT_WINDOWS`` windows of each spread over its text. Predictions use nothing but the text.

With ``background`` the network learns one more class, of texts in no learned language: each fitting window with its
letters exchanged, by an alphabet of another order or another script, or each by a random one. A text is rejected as
``und`` if the languages' shares together are below a bar: a half, or less if one in ``STRAYS`` labelled documents of
the sample would not stay. So the bar does not depend on the number of languages, and binds for one as for many.

Defined results: a null text and one without any letter is ``und`` with score 1 (nothing else is possible); so
is every text with score 0 if there is no labelled row to learn from. Equal shares go to the language that
sorts first. Repeated rows get equal results; a null id is not held out and is never learned from.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serupa.llm.batches import map_text
from serupa.llm.sampling import bounded_sample
from serupa.llm.toxicity import fold, held_out

WINDOW = 256
DEPTH = 6  # embedding
WIDTHS = (2, 3, 4)
FILTERS = 12  # of each width
FIT_DOCS = 2500
FIT_WINDOWS = 3
STRAYS = 1000
TOGETHER = 32  # windows pushed through the network at once
LONGEST = max(WIDTHS)
REACH = np.repeat([[float(i < w) for w in WIDTHS for _ in range(FILTERS)] for i in range(LONGEST)], DEPTH, axis=0).astype(np.float32)
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def windows_of(text: bytes) -> np.ndarray:
    """(windows, WINDOW) bytes, zeros behind the end."""
    codes = np.frombuffer(text.lower(), np.uint8)
    n = max(1, -(-len(codes) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(codes)] = codes
    return out.reshape(n, WINDOW)


def _padded(codes: np.ndarray) -> np.ndarray:
    return np.pad(codes, ((0, 0), (0, LONGEST - 1)))


@dataclass
class Network:
    """Filters of all widths are columns of one matrix, zero beyond their width."""

    languages: list[str]
    embedding: np.ndarray  # (256, DEPTH)
    filters: np.ndarray  # (LONGEST * DEPTH, all filters)
    bias: np.ndarray  # (all filters,)
    out: np.ndarray  # (all filters, languages)
    out_bias: np.ndarray
    bar: float | None = None  # if set, the last of the languages is the background

    @classmethod
    def fresh(cls, languages: list[str], seed: int) -> Network:
        r = np.random.default_rng(seed)
        draw = lambda *shape: r.standard_normal(shape).astype(np.float32)
        n = FILTERS * len(WIDTHS)
        filters = draw(LONGEST * DEPTH, n) * REACH / np.sqrt(REACH.sum(axis=0))
        return cls(languages, draw(256, DEPTH) / 2, filters, np.zeros(n, np.float32), draw(n, len(languages)) / np.float32(n**0.5), np.zeros(len(languages), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.bias, self.out, self.out_bias]

    def softmax(self, best: np.ndarray) -> np.ndarray:
        z = np.maximum(best + self.bias, 0) @ self.out + self.out_bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


class Reader:
    """A trained network for many windows: the responses to each pair of bytes are looked up, not multiplied."""

    def __init__(self, net: Network) -> None:
        self.net = net
        one = np.stack([net.embedding @ net.filters[j * DEPTH : (j + 1) * DEPTH] for j in range(LONGEST)])  # by place and byte
        pair = lambda j: (one[j][:, None] + one[j + 1][None]).reshape(65536, -1)
        self.tables = [pair(j) for j in range(0, LONGEST, 2)]

    def shares(self, codes: np.ndarray) -> np.ndarray:
        """Of each language in each window."""
        found = [self.net.softmax(self._best(_padded(codes[i : i + TOGETHER]))) for i in range(0, len(codes), TOGETHER)]
        return np.concatenate(found).astype(np.float64)

    def _best(self, codes: np.ndarray) -> np.ndarray:
        pairs = codes[:, :-1].astype(np.intp) << 8 | codes[:, 1:]
        response = np.take(self.tables[0], pairs[:, :WINDOW], axis=0, mode="clip")
        for k, table in enumerate(self.tables[1:], 1):
            response += np.take(table, pairs[:, 2 * k : 2 * k + WINDOW], axis=0, mode="clip")
        half = WINDOW
        while half > 1:  # pooling by halves keeps the operands long
            half //= 2
            np.maximum(response[:, :half], response[:, half : 2 * half], out=response[:, :half])
        return response[:, 0]


def train(codes: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 11, epochs: int = 5, batch: int = 64, rate: float = 5e-3) -> Network:
    """Adam on cross-entropy; a rare language's windows weigh more, up to four times."""
    net = Network.fresh(languages, seed)
    if len(languages) < 2:
        return net
    counts = np.bincount(labels, minlength=len(languages))
    weight = np.minimum(len(labels) / (len(languages) * np.maximum(counts, 1)), 4.0)[labels].astype(np.float32)
    draw, step = np.random.default_rng(seed), 0
    first, second = [np.zeros_like(p) for p in net.parameters()], [np.zeros_like(p) for p in net.parameters()]
    for epoch in range(epochs):
        order = draw.permutation(len(codes))
        for i in range(0, len(order), batch):
            part = order[i : i + batch]
            step += 1
            now = rate * (1 - epoch / epochs)
            for k, (p, g) in enumerate(zip(net.parameters(), _gradients(net, codes[part], labels[part], weight[part]), strict=True)):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def _gradients(net: Network, codes, labels, weight) -> list[np.ndarray]:
    codes = _padded(codes)
    x = np.take(net.embedding, codes, axis=0)
    seen = np.lib.stride_tricks.as_strided(x, (len(x), WINDOW, LONGEST * DEPTH), x.strides)
    response = np.ascontiguousarray((np.ascontiguousarray(seen).reshape(-1, LONGEST * DEPTH) @ net.filters).reshape(len(x), WINDOW, -1).transpose(0, 2, 1))
    at = response.argmax(axis=2)  # only a filter's largest response has a share in the loss
    best = np.take_along_axis(response, at[..., None], 2)[..., 0]
    gap = net.softmax(best)
    gap[np.arange(len(labels)), labels] -= 1
    gap *= weight[:, None] / len(labels)
    hidden = np.maximum(best + net.bias, 0)
    back = (gap @ net.out.T) * (hidden > 0)
    where = at[..., None] + np.arange(LONGEST)
    bytes_there = codes[np.arange(len(codes))[:, None, None], where]  # (windows, filters, LONGEST)
    there = net.embedding[bytes_there].reshape(len(codes), back.shape[1], -1)
    filters = np.einsum("nf,nfd->df", back, there) * REACH
    embedding = np.zeros_like(net.embedding)
    np.add.at(embedding, bytes_there, (back[..., None] * net.filters.T[None]).reshape(*bytes_there.shape, DEPTH))
    return [embedding, filters, back.sum(axis=0), hidden.T @ gap, gap.sum(axis=0)]


def foreign(codes: np.ndarray, seed: int = 5) -> np.ndarray:
    """The windows that have letters, in no language: their letters exchanged, in four ways by turns."""
    r, out = np.random.default_rng(seed), []
    for w in codes:
        text = w.tobytes().rstrip(b"\0").decode(errors="ignore")
        letters = sorted(set(_LETTER.findall(text)))
        if not letters:
            continue
        way = len(out) % 4
        if way == 0:  # a-z, the same for the same letter
            new = dict(zip(letters, r.integers(97, 123, len(letters)).tolist(), strict=True))
        elif way > 1:  # a script of two or three bytes a letter
            first, size = (int(r.integers(0x250, 0x7C0)), 40) if way == 2 else (int(r.integers(0x800, 0xD000)), int(r.choice([40, 400, 2000])))
            new = dict(zip(letters, (first + r.permutation(max(size, len(letters))))[: len(letters)].tolist(), strict=True))
        made = _LETTER.sub(lambda m: chr(r.integers(97, 123) if way == 1 else new[m[0]]), text).encode(errors="ignore")[:WINDOW]  # noqa: B023
        out.append(np.frombuffer(made.ljust(WINDOW, b"\0"), np.uint8))
    return np.array(out, np.uint8).reshape(-1, WINDOW)


def lowest_bar(net: Network, codes: np.ndarray, document: np.ndarray) -> float:
    """The bar under which at most one in ``STRAYS`` of the fitting documents falls, a half at most; ``document``: of each window."""
    size = np.maximum((codes != 0).sum(axis=1), 1)
    known = 1 - Reader(net).shares(codes)[:, -1]
    share = np.sort(np.bincount(document, known * size) / np.bincount(document, size))
    return min(0.5, float(share[len(share) // STRAYS]))


def _fit_windows():
    def fn(texts):
        out = []
        for text in texts:
            w = windows_of(text or b"")
            out.append([w[int(i)].tobytes() for i in sorted({*np.linspace(0, len(w) - 1, FIT_WINDOWS).round()})])
        return [pa.array(out, pa.list_(pa.binary()))]

    return fn


def fit_network(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", fit_docs: int = FIT_DOCS, background: bool = False) -> Network | None:
    """None if no row has a language to learn."""
    known = docs.where(F.col(lang).isNotNull() & (fold(key) != 0)).select(key, F.col(lang).cast("string").alias("__lang"), F.col(text).cast("string").alias("text"))
    drawn = bounded_sample(known.where(F.length("text") > 0), fit_docs, key)
    rows = map_text(drawn, "windows array<binary>", _fit_windows, ["__lang", key]).orderBy(key, "__lang", "windows").toPandas()
    if rows.empty:
        return None
    languages = sorted(set(rows["__lang"]))
    codes = np.stack([np.frombuffer(w, np.uint8) for ws in rows["windows"] for w in ws])
    labels = np.array([languages.index(x) for x, ws in zip(rows["__lang"], rows["windows"], strict=True) for _ in ws])
    if not background:
        return train(codes, labels, languages)
    other = foreign(codes)
    net = train(np.concatenate([codes, other]), np.concatenate([labels, np.full(len(other), len(languages))]), [*languages, UNKNOWN])
    net.bar = lowest_bar(net, codes, np.repeat(np.arange(len(rows)), rows["windows"].map(len)))
    return net


def predict(docs: DataFrame, net: Network | None, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns with lang_pred and score, its share; of a text that a network with a background rejects, the background's."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def work():
        known = Reader(shared.value) if shared.value else None

        def fn(texts):
            names: list[str] = [UNKNOWN] * len(texts)
            scores = [0.0 if known is None else 1.0] * len(texts)
            ask = [i for i, t in enumerate(texts) if t and _LETTER.search(t.decode())] if known else []
            cut = [windows_of(texts[i]) for i in ask]
            if not cut:
                return [names, pa.array(scores, pa.float64())]
            p = known.shares(np.concatenate(cut))
            size = np.concatenate([np.minimum(WINDOW, len(texts[i]) - WINDOW * np.arange(len(w))) for i, w in zip(ask, cut, strict=True)])
            first = np.cumsum([0] + [len(w) for w in cut[:-1]])
            mean = np.add.reduceat(p * size[:, None], first, axis=0) / np.add.reduceat(size, first)[:, None]
            for i, m in zip(ask, mean, strict=True):
                bar = known.net.bar
                best = int(m.argmax() if bar is None else len(m) - 1 if 1 - m[-1] < bar else m[:-1].argmax())
                names[i], scores[i] = known.net.languages[best], float(min(m[best], 1.0))
            return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

        return fn

    return map_text(docs, "lang_pred string, score double", work, keep, text)


def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    return predict(docs, fit_network(docs), ["doc_id"]).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")

"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A block's features are the tags and names of the elements it stands in and the form of its text; labels are the article, the
page's frame (menus, headers, footers, forms), what stands aside (adverts, sidebars, notices) and readers' comments. The
field is trained on labelled pages by gradient ascent of the likelihood; Viterbi's path over a page's blocks decides.
"""

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .html_blocks import Block, Place, blocks
from .labelled_pages import LABELS, labelled_pages

#: Labelled pages, steps of training, its rate, and the weight of squared parameters.
PAGES, STEPS, RATE, PENALTY = 400, 120, 0.15, 1e-4
#: Blocks that are scored at a time.
BLOCKS_AT_ONCE = 200_000

# Words of short blocks that say what a block is for.
_CUES = re.compile(
    r"(?P<legal>©|\b(?:copyright|all rights reserved|imprint|impressum|mentions légales|aviso legal)\b)"
    r"|(?P<consent>\b(?:cookies?|consent|privacy|datenschutz|confidentialité|privacidad)\b)"
    r"|(?P<account>\b(?:subscribe|newsletter|sign (?:up|in)|log ?in|register|anmelden|abonnieren|abonnez|connexion|suscríbete|search|share|follow us|menu)\b)"
    r"|(?P<advert>\b(?:advert(?:isement)?s?|sponsored|promoted|anzeige|publicité|publicidad|buy now)\b)"
    r"|(?P<comment>\b(?:comments?|repl(?:y|ies)|kommentare?|commentaires?|comentarios?|posted by|antworten|répondre|responder)\b)"
    r"|(?P<more>\b(?:related|read more|read next|most read|trending|popular|previous|next|tags|weiterlesen|lire aussi|leer más)\b)"
)
_LENGTHS = (1, 2, 4, 8, 16, 32, 64)


class Model(NamedTuple):
    """Weights of features by label, of transitions, of a page's first and last label."""

    features: dict[str, int]
    weights: np.ndarray
    steps: np.ndarray
    first: np.ndarray
    last: np.ndarray


def place_features(where: Place) -> list[str]:
    above = where.parent.tag if where.parent else ""
    own = [f"tag={where.tag}", f"above={above}", f"pair={above}/{where.tag}"]
    return own + [f"in={t}" for t in where.tags] + [f"named={n}" for n in where.within] + [f"own={n}" for n in where.names]


def text_form(block: Block) -> tuple:
    """The form of a block's text, few enough forms to be kept."""
    text = block.text
    words = text.count(" ") + 1
    cue = _CUES.search(text.lower()) if words <= 16 else None
    link = 0 if block.linked == 0 else 1 if block.linked < 0.5 else 2
    return sum(words >= n for n in _LENGTHS), link, text[-1] in ".!?…\"”»:;", text[0].isupper(), text[:1].isdigit(), cue.lastgroup if cue else "", block.where.tag


def form_features(form: tuple) -> list[str]:
    size, link, stop, capital, digit, cue, tag = form
    found = [f"size={size}", f"link={link}", f"stop={stop}", f"form={size}/{link}/{stop}", f"tag-link={tag}/{link}", f"tag-size={tag}/{min(size, 4)}", "always"]
    return found + ["capital"] * capital + ["digit"] * digit + ([f"cue={cue}", f"cue-size={cue}/{min(size, 4)}"] if cue else [])


def fit(pages: int = PAGES, seed: int = 42) -> Model:
    """A field trained on labelled pages; the same seed gives the same model."""
    features: dict[str, int] = {}
    rows, ends, labels, sizes = [], [0], [], []
    for page, wanted in labelled_pages(pages, seed):
        found = blocks(page, Place(None, "", ""))
        if len(found) != len(wanted):
            raise ValueError(f"{len(wanted)} labels for {len(found)} blocks")
        for block in found:
            names = place_features(block.where) + form_features(text_form(block))
            rows += [features.setdefault(f, len(features)) for f in names]
            ends.append(len(rows))
        labels += wanted
        sizes.append(len(found))
    return _trained(features, np.array(rows), np.array(ends), np.array(labels), np.array(sizes))


def _trained(features: dict, rows: np.ndarray, ends: np.ndarray, labels: np.ndarray, sizes: np.ndarray) -> Model:
    k, n = len(LABELS), len(labels)
    sizes_of = np.diff(ends)
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    gold = np.eye(k)[labels]
    last_rows = starts + sizes - 1
    inner = np.setdiff1d(np.arange(n), starts)
    page = np.empty(n, dtype=int)
    page[np.concatenate([np.arange(a, a + m) for a, m in zip(starts, sizes, strict=True)])] = np.repeat(np.arange(len(starts)), sizes)
    seen = np.zeros((k, k))
    np.add.at(seen, (labels[inner - 1], labels[inner]), 1)
    shapes = [(len(features), k), (k, k), (k,), (k,)]
    theta = [np.zeros(s) for s in shapes]
    mean, square = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    for step in range(1, STEPS + 1):
        w, t, f, z = theta
        emit = np.add.reduceat(w[rows], ends[:-1], axis=0)
        forward, backward = np.zeros((n, k)), np.zeros((n, k))
        forward[starts], backward[last_rows] = emit[starts] + f, z
        for i in range(1, sizes[0]):
            at = starts[: np.searchsorted(-sizes, -i)] + i
            forward[at] = emit[at] + _lse(forward[at - 1][:, :, None] + t, 1)
        for i in range(sizes[0] - 1, 0, -1):
            at = starts[: np.searchsorted(-sizes, -i)] + i
            backward[at - 1] = _lse(t + (emit[at] + backward[at])[:, None, :], 2)
        norm = _lse(forward[last_rows] + z, 1)
        of_row = norm[page]
        node = np.exp(forward + backward - of_row[:, None])
        pair = np.exp(forward[inner - 1][:, :, None] + t + (emit[inner] + backward[inner])[:, None, :] - of_row[inner][:, None, None]).sum(0)
        off = gold - node
        spread = np.repeat(off, sizes_of, axis=0)
        up = [
            np.stack([np.bincount(rows, spread[:, j], len(features)) for j in range(k)], 1), seen - pair,
            off[starts].sum(0), off[last_rows].sum(0),
        ]
        for i, (gradient, p) in enumerate(zip(up, theta, strict=True)):
            g = gradient / n - PENALTY * p
            mean[i] = 0.9 * mean[i] + 0.1 * g
            square[i] = 0.99 * square[i] + 0.01 * g * g
            theta[i] = p + RATE * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-8)
    return Model(features, *theta)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def viterbi(model: Model, emit: np.ndarray, sizes: list[int]) -> np.ndarray:
    """The best labels of pages whose blocks' scores stand one page after another; pages without blocks have none."""
    sizes = np.array(sizes, dtype=int)
    starts = np.r_[0, np.cumsum(sizes)[:-1]][sizes > 0] if len(sizes) else np.zeros(0, dtype=int)
    sizes = sizes[sizes > 0]
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    if not len(sizes):
        return np.zeros(0, dtype=int)
    score, back = emit.copy(), np.zeros(emit.shape, dtype=np.int8)
    score[starts] += model.first
    for i in range(1, sizes[0]):
        at = starts[: np.searchsorted(-sizes, -i)] + i
        way = score[at - 1][:, :, None] + model.steps
        back[at] = way.argmax(1)
        score[at] += way.max(1)
    labels = np.zeros(len(emit), dtype=int)
    ends = starts + sizes - 1
    labels[ends] = (score[ends] + model.last).argmax(1)
    for i in range(sizes[0] - 1, 0, -1):
        at = starts[: np.searchsorted(-sizes, -i)] + i
        labels[at - 1] = back[at, labels[at]]
    return labels


class Extractor:
    """Main texts of pages; what a place or a form of text scores is computed once a call."""

    def __init__(self, model: Model):
        self.model = model

    def _score(self, key, names) -> int:
        if (at := self.known.get(key)) is None:
            ids = [self.model.features[f] for f in names(key) if f in self.model.features]
            at = self.known[key] = len(self.scores)
            self.scores.append(self.model.weights[ids].sum(0))
        return at

    def texts(self, pages: list[str | None]) -> list[str]:
        self.root, self.known, self.scores = Place(None, "", ""), {}, []
        out: list[str] = []
        while len(out) < len(pages):
            found, n = [], 0
            for page in pages[len(out) :]:
                found.append(blocks(page or "", self.root))
                n += len(found[-1])
                if n >= BLOCKS_AT_ONCE:
                    break
            ids = [(self._score(b.where, place_features), self._score(text_form(b), form_features)) for page in found for b in page]
            table = np.array(self.scores or [[0.0] * len(LABELS)])
            a = np.array(ids, dtype=int).reshape(-1, 2)
            labels, at = viterbi(self.model, table[a[:, 0]] + table[a[:, 1]], [len(p) for p in found]), 0
            for page in found:
                out.append("\n".join(b.text for b, label in zip(page, labels[at : at + len(page)], strict=True) if label == 0))
                at += len(page)
        return out


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page: its main text, blocks joined by newlines, and its code points.

    Null and empty html, or a page without an article, gives an empty text; ids and urls may be null; repeated rows give
    repeated rows, an empty table none; a text is as long as its page. Other columns are not carried. Nothing is shuffled;
    the model, whose size the labelled pages bound, goes to all executors.
    """
    spark = pages.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model or fit())

    def texts(batches: Iterator) -> Iterator:
        import pyarrow as pa

        extractor = Extractor(sent.value)
        for batch in batches:
            found = pa.array(extractor.texts(batch.column("html").to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), found], names=["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    found = pages.select("page_id", "url", "html").mapInArrow(texts, f"page_id {kind}, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))

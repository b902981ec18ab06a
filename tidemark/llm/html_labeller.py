"""Main text of pages: a bidirectional LSTM in numpy labels every leaf block from its tag path, its hashed words and the
blocks before and after it.

It is fitted on at most ``SAMPLE_PAGES`` pages, those with the smallest hashes of their ids. Structural names give weak
labels for their blocks; the same texts are laid out again under other containers, so that it also knows page parts that the
sample lacks. Every page is read whole and every block labelled.

Null and empty pages, and pages without article text, have the empty text; bytes that are no UTF-8 read as U+FFFD. Pages are independent: repeated rows give
repeated results, and an empty table an empty one.
"""

from __future__ import annotations

import pickle
import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import Rows, as_text, id_text, record
from tidemark.llm.html_blocks import Block, blocks

#: Bounds of what the labeller is fitted on: pages, and blocks of one page.
SAMPLE_PAGES, SAMPLE_BLOCKS = 400, 400
PATH_SIZE, WORD_SIZE, FIGURES = 128, 32, 6
INPUT = PATH_SIZE + WORD_SIZE + FIGURES
HIDDEN = 20
KEEP_FROM = 0.5
MEMO_PATHS = 20_000
#: Blocks labelled in one batch of padded pages.
BATCH_STEPS = 6_000

# Elements and names that mark what is not the article, and what is.
OTHER_TAGS = frozenset("nav header footer aside form button select option menu label dialog".split())
OTHER_NAMES = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments contentinfo cookie cookies copyright dialog disqus foot "
    "footer form header masthead menu modal nav navbar navigation newsletter notice popup promo reader-comments related share sharing sidebar "
    "signup social sponsor sponsored subscribe toolbar widget alert consent replies reply search login".split()
)
_NAME = re.compile(r"[a-z0-9]+")


def is_other(path: tuple[str, ...]) -> bool:
    """Weak label: some element around the block is named as another part of the page."""
    inside = False
    for element in path:
        tag, _, names = element.partition(" ")
        if tag in ("article", "main"):
            inside = True
        if tag in OTHER_TAGS and not (tag == "header" and inside):
            return True
        if any(name in OTHER_NAMES for name in _NAME.findall(names)):
            return True
    return False


class Features:
    """Block features; those of a path are kept per distinct path up to a bound."""

    def __init__(self):
        self.paths: dict[tuple[str, ...], np.ndarray] = {}

    def path(self, path: tuple[str, ...]) -> np.ndarray:
        found = self.paths.get(path)
        if found is None:
            if len(self.paths) >= MEMO_PATHS:
                self.paths.clear()
            found = np.zeros(PATH_SIZE, np.float32)
            for element in path:
                tag, _, names = element.partition(" ")
                for name in (tag, *(f".{n}" for n in _NAME.findall(names))):
                    found[crc32(name.encode()) % PATH_SIZE] += 1
            np.minimum(found, 2, out=found)
            self.paths[path] = found
        return found

    def page(self, found: list[Block]) -> np.ndarray:
        out = np.zeros((len(found), INPUT), np.float32)
        for k, block in enumerate(found):
            words = block.text.encode().split()
            hashed = np.bincount([crc32(w) & (WORD_SIZE - 1) for w in words], minlength=WORD_SIZE)
            out[k, :PATH_SIZE] = self.path(block.path)
            out[k, PATH_SIZE:-FIGURES] = 0.5 * hashed / np.sqrt((hashed * hashed).sum())
            size = len(block.text)
            out[k, -FIGURES:] = (
                np.log1p(len(words)) / 4, min(1.0, block.links / size), block.text[-1] in ".?!", k / len(found), len(block.path) / 8, 1 / (1 + k),
            )
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Network:
    """Two LSTMs, one in each direction, and a logistic output over both states."""

    weights: list[np.ndarray]  # per direction (input + hidden + 1, 4 * hidden)
    out: np.ndarray  # (2 * hidden + 1,)

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Network:
        scale = 1 / np.sqrt(INPUT + HIDDEN)
        weights = [(rng.standard_normal((INPUT + HIDDEN + 1, 4 * HIDDEN)) * scale).astype(np.float32) for _ in range(2)]
        for w in weights:
            w[-1] = 0
            w[-1, HIDDEN : 2 * HIDDEN] = 1  # forget gates start open
        return cls(weights, (rng.standard_normal(2 * HIDDEN + 1) * 0.1).astype(np.float32))

    def _pass(self, w: np.ndarray, x: np.ndarray, keep: list | None) -> np.ndarray:
        """States (steps, pages, hidden) for inputs (steps, pages, input)."""
        steps, pages, _ = x.shape
        gates = x.reshape(-1, INPUT) @ w[:INPUT] + w[-1]
        gates = gates.reshape(steps, pages, 4 * HIDDEN)
        h = c = np.zeros((pages, HIDDEN), np.float32)
        states = np.empty((steps, pages, HIDDEN), np.float32)
        for t in range(steps):
            z = gates[t] + h @ w[INPUT:-1]
            g = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :]
            a = np.tanh(z[:, 3 * HIDDEN :])
            before, c = c, f * c + i * a
            shown = np.tanh(c)
            if keep is not None:
                keep.append((h, before, i, f, o, a, shown))
            h = states[t] = o * shown
        return states

    @staticmethod
    def turned(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Every page back to front, its padding still behind it."""
        at = np.arange(len(x))[:, None]
        return np.take_along_axis(x, np.where(at < lengths, lengths - 1 - at, at)[:, :, None], axis=0)

    def states(self, x: np.ndarray, lengths: np.ndarray, keep: tuple[list, list] | None = None) -> np.ndarray:
        first = self._pass(self.weights[0], x, keep and keep[0])
        second = self._pass(self.weights[1], self.turned(x, lengths), keep and keep[1])
        return np.concatenate([first, self.turned(second, lengths)], axis=2)

    def chances(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return _sigmoid(self.states(x, lengths) @ self.out[:-1] + self.out[-1])

    def _back(self, w: np.ndarray, x: np.ndarray, kept: list, d_states: np.ndarray) -> np.ndarray:
        grad = np.zeros_like(w)
        d_h = d_c = np.zeros((x.shape[1], HIDDEN), np.float32)
        for t in range(len(x) - 1, -1, -1):
            h, before, i, f, o, a, shown = kept[t]
            d_h = d_h + d_states[t]
            d_c = d_c + d_h * o * (1 - shown * shown)
            d_z = np.concatenate([d_c * a * i * (1 - i), d_c * before * f * (1 - f), d_h * shown * o * (1 - o), d_c * i * (1 - a * a)], axis=1)
            grad[:INPUT] += x[t].T @ d_z
            grad[INPUT:-1] += h.T @ d_z
            grad[-1] += d_z.sum(axis=0)
            d_h, d_c = d_z @ w[INPUT:-1].T, d_c * f
        return grad

    def gradients(self, x: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        keep: tuple[list, list] = ([], [])
        states = self.states(x, lengths, keep)
        inside = (np.arange(len(x))[:, None] < lengths).astype(np.float32)
        off = (_sigmoid(states @ self.out[:-1] + self.out[-1]) - y) * inside / inside.sum()
        d_out = np.append(np.tensordot(off, states, axes=([0, 1], [0, 1])), off.sum())
        d_states = off[:, :, None] * self.out[:-1]
        back = self.turned(x, lengths)
        return [
            self._back(self.weights[0], x, keep[0], d_states[:, :, :HIDDEN]),
            self._back(self.weights[1], back, keep[1], self.turned(d_states[:, :, HIDDEN:], lengths)),
            d_out.astype(np.float32),
        ]


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(p) for p in pages])
    x = np.zeros((lengths.max(), len(pages), pages[0].shape[1]), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k] = p
    return x, lengths


def fit(pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = 20, size: int = 24, rate: float = 0.01, seed: int = 3) -> Network:
    """Adam steps over batches of pages of similar length."""
    rng = np.random.default_rng(seed)
    net = Network.fresh(rng)
    values = [*net.weights, net.out]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    order = sorted(range(len(pages)), key=lambda k: len(pages[k]))
    groups = [order[k : k + size] for k in range(0, len(order), size)]
    step = 0
    for _ in range(epochs):
        for g in rng.permutation(len(groups)):
            x, lengths = padded([pages[k] for k in groups[g]])
            y = padded([labels[k][:, None].astype(np.float32) for k in groups[g]])[0][:, :, 0]
            step += 1
            for k, grad in enumerate(net.gradients(x, lengths, y)):
                np.clip(grad, -1, 1, out=grad)
                first[k] += 0.1 * (grad - first[k])
                second[k] += 0.01 * (grad * grad - second[k])
                values[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    return net


# Containers that texts are laid out under for fitting.
_ARTICLES = ("article", "main", "main|article", "main|section", "div content|article", "div post|div post-body", "div entry-content", "div article-body", "section story", "div main|div text")
_OTHERS = (
    "nav|ul|li|a", "div nav|ul|li|a", "ul menu|li|a", "header", "header|h1", "div header|p", "header|nav|ul|li|a", "footer", "footer|p", "div footer", "aside", "aside|p",
    "aside|ul|li|a", "div sidebar", "div sidebar|p", "div sidebar|ul|li|a", "div ad", "div ads", "div advert|p", "section advertisement", "div promo|p", "div sponsored",
    "div cookie-notice|p", "div notice", "div notice|p", "div alert|p", "div banner", "p notice", "form", "form|p", "form|label", "form|button", "form search|label", "div newsletter|form|p",
    "section comments|p", "div comments|div comment|p", "div comment", "div comments|ul|li|p", "section comments|article comment|p", "ol comment-list|li comment|p", "div reader-comments|p",
    "div related|ul|li|a", "div share|a", "div social|ul|li|a", "div breadcrumb|a", "div widget|p", "p copyright", "div popup|p", "div subscribe|p", "div login|form|label",
)


def laid_out(texts: list[str], other: list[str], rng: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """A page of the given texts under drawn containers, with its labels."""
    root = ("html", "body") + tuple(str(x) for x in rng.choice(["div wrapper", "div page", "div container"], int(rng.integers(0, 2))))
    page: list[Block] = []
    labels: list[bool] = []
    # Any text may stand in any part of a page, also short lines, repeated lines, and one word over and over.
    if rng.random() < 0.3:
        short = [" ".join(t.split()[: int(rng.integers(1, 5))]) for t in texts]
        texts = [short[0] if rng.random() < 0.5 else x for x in short for _ in range(int(rng.integers(1, 3)))]
    if rng.random() < 0.3:
        texts = [" ".join(t.split()[:1] * int(rng.integers(1, 60))) if t.split() and rng.random() < 0.4 else t for t in texts]

    def others(around: tuple[str, ...]) -> None:
        path = around + tuple(_OTHERS[rng.integers(len(_OTHERS))].split("|"))
        if rng.random() < 0.2:
            path += ("p",)
        for _ in range(int(rng.integers(1, 7)) if path[-1] in ("a", "p", "label") else 1):
            source = texts if rng.random() < 0.4 else other
            text = source[rng.integers(len(source))]
            text = " ".join(text.split()[: int(rng.integers(1, 60))])
            page.append(Block(text, path, len(text) if path[-1] == "a" else 0))
            labels.append(False)

    for _ in range(int(rng.integers(0, 4))):
        others(root)
    around = root + tuple(_ARTICLES[rng.integers(len(_ARTICLES))].split("|"))
    for k, text in enumerate(texts):
        last = str(rng.choice(["p", "p", "p", "p", "li", "blockquote", "h2", "p|b", "p|a"]))
        inner = (("header", "h1") if rng.random() < 0.3 else ("h1",)) if k == 0 and rng.random() < 0.8 else tuple(last.split("|"))
        inner = ("ul", "li") if inner == ("li",) else inner
        page.append(Block(text, around + inner, len(text) if inner[-1] == "a" else 0))
        labels.append(True)
        if rng.random() < 0.08:
            others(around)
    for _ in range(int(rng.integers(0, 4))):
        others(root)
    return page, np.array(labels)


def sample(pages: DataFrame, rows: int = SAMPLE_PAGES) -> DataFrame:
    """(html) of at most ``rows`` pages, those with the smallest hashes of their ids, in one partition."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).filter("page_id IS NOT NULL AND html IS NOT NULL")
    few = F.broadcast(own.select(F.col("page_id").alias("_id")).distinct().orderBy(F.xxhash64("_id"), "_id").limit(rows))
    chosen = own.join(few, F.col("page_id") == F.col("_id"), "left_semi")
    return chosen.orderBy("page_id", F.xxhash64("html")).limit(rows).select("html")


def trained(pages: DataFrame, rows: int = SAMPLE_PAGES) -> Network | None:
    """The labeller, fitted in one task on the bounded sample; None without pages."""

    def run(batches: Rows) -> Rows:
        net = train([page for batch in batches for page in map(as_text, batch.column(0).cast(pa.binary()).to_pylist())])
        yield record({"net": ([pickle.dumps(net)], pa.binary())})

    got = sample(pages, rows).mapInArrow(run, "net binary").collect()
    return pickle.loads(bytes(got[0].net)) if got else None


def train(pages: list[str], seed: int = 3) -> Network | None:
    """The labeller, from weakly labelled pages and their texts laid out again."""
    rng, features = np.random.default_rng(seed), Features()
    x, y = [], []
    for page in pages:
        found = blocks(page)
        if len(found) > SAMPLE_BLOCKS:  # both ends, so that what follows a long article is learnt too
            found = found[: SAMPLE_BLOCKS // 2] + found[-SAMPLE_BLOCKS // 2 :]
        if not found:
            continue
        labels = np.array([not is_other(b.path) for b in found])
        x.append(features.page(found))
        y.append(labels)
        texts = [b.text for b, ok in zip(found, labels) if ok] or [b.text for b in found]
        other = [b.text for b, ok in zip(found, labels) if not ok] or texts
        for _ in range(3):
            drawn, drawn_labels = laid_out([texts[k] for k in sorted(rng.choice(len(texts), min(len(texts), int(rng.integers(1, 16))), replace=False))], other, rng)
            x.append(features.page(drawn))
            y.append(drawn_labels)
    return fit(x, y) if x else None


def label(net: Network | None, pages: list[list[Block]], features: Features, keep_from: float = KEEP_FROM) -> list[np.ndarray]:
    """Which blocks of each page are its article."""
    out: list[np.ndarray] = [np.zeros(len(p), bool) for p in pages]
    if net is None:
        return out
    order = [k for k in sorted(range(len(pages)), key=lambda k: len(pages[k])) if pages[k]]
    at = 0
    while at < len(order):
        size = max(1, BATCH_STEPS // len(pages[order[min(at + 256, len(order)) - 1]]))
        some = order[at : at + size]
        at += len(some)
        x, lengths = padded([features.page(pages[k]) for k in some])
        good = net.chances(x, lengths) >= keep_from
        for column, k in enumerate(some):
            out[k] = good[: len(pages[k]), column]
    return out


def extract(pages: DataFrame, net: Network | None) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_kept): the labelled article blocks of every page, one to a line."""

    def run(batches: Rows) -> Rows:
        features = Features()
        for batch in batches:
            urls, at = batch.column(2).to_pylist(), 0
            for ids, texts in id_text([batch]):
                read = [blocks(as_text(t)) for t in texts]
                kept = label(net, read, features)
                main = ["\n".join(b.text for b, ok in zip(page, good) if ok) for page, good in zip(read, kept)]
                yield record(
                    {
                        "page_id": (ids, pa.int64()),
                        "url": (urls[at : at + len(ids)], pa.string()),
                        "text": (main, pa.string()),
                        "n_chars": ([len(m) for m in main], pa.int64()),
                        "n_blocks": ([len(p) for p in read], pa.int64()),
                        "n_kept": ([int(k.sum()) for k in kept], pa.int64()),
                    }
                )
                at += len(ids)

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"), F.col("url").cast("string").alias("url"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long")

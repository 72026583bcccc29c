"""Main text of web pages: gradient-boosted trees over DOM-node features, decoded so that choices of a node and its
ancestors never contradict."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.html_pages import labelled_pages
from topicloom.llm.html_tree import decode, features, parse

_MARK = ("\ue000", "\ue001")  # private-use characters that mark article and other text in training pages


@dataclass(frozen=True)
class Settings:
    pages: int = 800  # generated pages that the trees learn from
    trees: int = 40
    depth: int = 4
    rate: float = 0.2
    bins: int = 32
    penalty: float = 1.0  # on leaf weights


@dataclass
class Trees:
    """Complete binary trees: a feature and threshold per inner node, a weight per leaf."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    weight: np.ndarray  # trees x leaves

    def logits(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for f, t, w in zip(self.feature, self.threshold, self.weight, strict=True):
            at = np.zeros(len(x), np.int64)
            while at[:1].size and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += w[at - inner]
        return out


def boost(x: np.ndarray, y: np.ndarray, settings: Settings = Settings()) -> Trees:
    """Newton boosting of the logistic loss with histogram splits."""
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, settings.bins + 1)[1:-1], method="lower")) for j in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1) + settings.bins * np.arange(m)
    prior = (y.sum() + 1) / (n + 2)
    base, inner = float(np.log(prior / (1 - prior))), 2**settings.depth - 1
    z = np.full(n, base)
    feature, threshold, weight = [], [], []
    for _ in range(settings.trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        f, t, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(settings.depth):
            first, width = 2**level - 1, m * settings.bins
            slot = ((at - first)[:, None] * width + binned).ravel()
            sums = [np.bincount(slot, np.repeat(v, m), 2**level * width).reshape(2**level, m, settings.bins) for v in (g, h)]
            left = [s.cumsum(2) for s in sums]
            whole = [s[:, :, -1:] for s in left]
            right = [w - s for w, s in zip(whole, left, strict=True)]
            gain = sum(a * a / (b + settings.penalty) for a, b in (left, right)) - whole[0] ** 2 / (whole[1] + settings.penalty)
            for k in range(2**level):
                j, b = np.unravel_index(int(gain[k].argmax()), gain[k].shape)
                if gain[k, j, b] > 1e-6 and b < len(cuts[j]):
                    f[first + k], t[first + k] = j, cuts[j][b]
            at = 2 * at + 1 + (x[np.arange(n), f[at]] > t[at])
        leaf = at - inner
        w = -settings.rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + settings.penalty)
        z += w[leaf]
        feature.append(f), threshold.append(t), weight.append(w)
    return Trees(base, np.array(feature), np.array(threshold), np.array(weight))


def training_rows(settings: Settings, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the nodes of generated pages; a node belongs to the article if some of its text does."""
    xs, ys = [], []
    for parts in labelled_pages(settings.pages, seed):
        markup = "<html><body>" + "".join(_marked(m, own) for m, own in parts) + "</body></html>"
        nodes = parse(markup)
        label = {}
        for node in reversed(nodes):
            own = _MARK[0] in node.text or any(label[id(c)] for c in node.children)
            label[id(node)] = own
        for node in nodes:
            node.text = node.text.replace(_MARK[0], "").replace(_MARK[1], "").strip()
        xs.append(features(nodes))
        ys.append([label[id(node)] for node in nodes])
    return np.concatenate(xs), np.concatenate(ys).astype(float)


def _marked(markup: str, own: bool) -> str:
    """Put a mark into each text of some markup."""
    import re

    return re.sub(r">([^<]*[^<\s][^<]*)", lambda m: ">" + _MARK[not own] + m[1], markup)


@lru_cache(maxsize=2)
def trained(settings: Settings = Settings()) -> Trees:
    return boost(*training_rows(settings), settings)


def extract(pages: list[str | None], trees: Trees) -> list[str]:
    """The main text of each whole page; empty for a null or empty one, and where nothing looks like an article."""
    parsed = [parse(p or "") for p in pages]
    if not parsed:
        return []
    logits = np.split(trees.logits(np.concatenate([features(n) for n in parsed])), np.cumsum([len(n) for n in parsed])[:-1])
    return [" ".join(n.text for n, k in zip(nodes, decode(nodes, z), strict=True) if k and n.text) for nodes, z in zip(parsed, logits, strict=True)]


def main_text(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``.

    Blocks of the article are joined in page order by one space, after character references are decoded and white space
    inside each becomes one space. Null or empty html gives an empty text; null ids and urls stay null; repeated rows
    give repeated rows; an empty table gives none; other columns are never looked at. Pages are read whole and one task
    holds a batch of them, never a group.
    """
    trees = trained(settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                texts = extract(part.column(2).to_pylist(), trees)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")

"""Toxicity by a factorization machine (Rendle 2010) over hashed terms.

score = sigmoid(w0 + sum_i w_i + sum_{i<j} <v_i, v_j>) over the active terms of a text. The factor products let a pair,
such as an insult beside a group's name, weigh more or less than its two terms add up to.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import tidied

_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Settings:
    """Bounds of the training sample and the model's size."""

    toxic_rows: int = 3000  # labelled rows used at most, the first in the order of a hash of their id
    clean_rows: int = 5000
    folds: int = 5  # rows whose crc32 of the id leaves 0 are held out
    buckets: int = 1 << 22  # of hashed terms
    stems: tuple[int, ...] = (4, 5)  # letters of a word's beginning that count as terms too
    evidence: float = 11.0  # least log-likelihood ratio statistic of a kept term
    max_terms: int = 8192  # kept, by that statistic
    factors: int = 8
    steps: int = 150
    rate: float = 0.05
    decay: float = 1e-4


def terms(text: str | None, settings: Settings = Settings()) -> set[int]:
    """Hashed terms of a whole text: its words in lower case, and their first letters."""
    words = set(_WORD.findall((text or "").lower()))
    found = set(words)
    for n in settings.stems:
        found.update({w[:n] + "*" for w in words if len(w) >= n})
    crc, mod = zlib.crc32, settings.buckets
    return {crc(t.encode("utf-8", "replace")) % mod for t in found}


@dataclass
class Machine:
    index: dict[int, int]  # hashed term -> row of the weights
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def of_texts(self, texts: list[str | None], settings: Settings) -> np.ndarray:
        """Scores of texts, a few of which at a time are held as terms."""
        parts = [self.scores([terms(t, settings) for t in texts[k : k + 256]]) for k in range(0, len(texts), 256)]
        return np.concatenate(parts) if parts else np.empty(0)

    def scores(self, docs: list[set[int]]) -> np.ndarray:
        known = self.index
        active = [sorted(map(known.__getitem__, known.keys() & d)) for d in docs]
        at = np.repeat(np.arange(len(docs)), [len(a) for a in active])
        idx = np.array([i for a in active for i in a], np.int64)
        z = _margins(len(docs), at, idx, self.bias, self.linear, self.factors)[0]
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def _margins(n: int, at: np.ndarray, idx: np.ndarray, bias: float, linear: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sums = np.stack([np.bincount(at, factors[idx, f], n) for f in range(factors.shape[1])], 1) if len(idx) else np.zeros((n, factors.shape[1]))
    squares = np.bincount(at, (factors[idx] ** 2).sum(1), n)
    return bias + np.bincount(at, linear[idx], n) + 0.5 * ((sums**2).sum(1) - squares), sums


def fit(values: np.ndarray, sizes: np.ndarray, toxic: np.ndarray, settings: Settings = Settings()) -> Machine:
    """Adam on the logistic loss of a machine over the terms that tell the classes apart.

    ``values`` holds the distinct terms of one text after another, ``sizes`` how many each text has.
    """
    n, pos = len(sizes), int(toxic.sum())
    prior = pos / (n + 1)
    empty = Machine({}, math.log(max(prior, 1e-6) / (1 - prior)), np.zeros(0), np.zeros((0, settings.factors)))
    if not pos or pos == n:
        return empty
    at = np.repeat(np.arange(n, dtype=np.int32), sizes)
    held = np.bincount(values, minlength=settings.buckets)
    a = np.bincount(values[toxic[at] > 0], minlength=settings.buckets)
    term = np.flatnonzero(held)
    evidence = _evidence(a[term], held[term] - a[term], pos, n - pos)
    kept = np.argsort(-evidence, kind="stable")[: settings.max_terms]
    kept = term[kept[evidence[kept] >= settings.evidence]]
    if not len(kept):
        return empty
    row = np.full(settings.buckets, -1, np.int32)
    row[kept] = np.arange(len(kept))
    idx = row[values]
    idx, at = idx[idx >= 0], at[idx >= 0]
    rng = np.random.default_rng(0)
    params = [np.array([empty.bias]), np.zeros(len(kept)), rng.normal(0, 0.05, (len(kept), settings.factors))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, settings.steps + 1):
        bias, linear, factors = params
        z, sums = _margins(n, at, idx, bias[0], linear, factors)
        err = (1 / (1 + np.exp(-np.clip(z, -700, 700))) - toxic) / n
        g_linear = np.bincount(idx, err[at], len(kept))
        g_factors = np.stack([np.bincount(idx, err[at] * sums[at, f], len(kept)) for f in range(settings.factors)], 1) - factors * g_linear[:, None]
        for k, g in enumerate((np.array([err.sum()]), g_linear + settings.decay * linear / n, g_factors + settings.decay * factors / n)):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            params[k] = params[k] - settings.rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-10)
    return Machine({int(t): k for k, t in enumerate(kept)}, float(params[0][0]), params[1], params[2])


def _evidence(a: np.ndarray, b: np.ndarray, pos: int, neg: int) -> np.ndarray:
    """Log-likelihood ratio statistic of a term that a of pos toxic and b of neg clean texts hold."""
    with np.errstate(divide="ignore", invalid="ignore"):
        rate = (a + b) / (pos + neg)
        parts = [x * np.log(x / (m * r)) for x, m, r in ((a, pos, rate), (pos - a, pos, 1 - rate), (b, neg, rate), (neg - b, neg, 1 - rate))]
    return 2 * sum(np.where(np.isfinite(p), p, 0) for p in parts)


def sample(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms, numbers of terms and labels of the bounded training sample: no more rows of each class than the settings name.

    Labels that disagree on one id count as toxic; null labels and ids are left out.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % settings.folds
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(fold != 0).where("toxic is not null")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((1, settings.toxic_rows), (0, settings.clean_rows))]
    ids = F.broadcast(drawn[0].unionByName(drawn[1]))  # at most toxic_rows + clean_rows rows of two numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(terms(t, settings)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "toxic", "terms"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id")
    texts = texts.groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))  # repeated rows train once
    got = texts.mapInArrow(run, "doc_id long, toxic int, terms array<int>").toArrow().sort_by("doc_id")
    lists = got.column("terms").combine_chunks()
    return lists.flatten().to_numpy(), lists.value_lengths().to_numpy(), got.column("toxic").to_numpy().astype(float)


def toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``, scored over its whole text.

    Null and empty texts have no terms and score the bias alone. A null doc_id is kept and counts as not held out.
    Repeated rows score alike, an empty table gives no rows, and with no labels of either class every text scores the
    share of toxic labels. Labels, languages, sources and ids are never inputs of a score.
    """
    machine = fit(*sample(docs, labels, settings), settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = machine.of_texts(batch.column(1).to_pylist(), settings)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
            )

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % settings.folds == 0, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs``, all columns, that the machine does not reject."""
    machine = fit(*sample(docs, labels, settings), settings)
    tidied(docs.sparkSession, 0)

    @F.pandas_udf("boolean")
    def rejected(text):
        import pandas as pd

        return pd.Series(machine.of_texts(list(text), settings) >= 0.5)

    return docs.where(~rejected(F.col("text")))

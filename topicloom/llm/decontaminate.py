"""Benchmark decontamination by latent semantic retrieval.

TF-IDF rows of the benchmark's passages, with document counts of the whole corpus, go through a distributed randomised
SVD (Halko, Martinsson and Tropp 2011). An item is a candidate wherever it shares words enough, which loses no place;
windows of every document with a candidate are folded into that space and ranked by cosine, and a longest common
subsequence of words confirms the item, with an answer check where the benchmark has answers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm.common import tidied

_ASCII = bytes(range(128))
#: Of UTF-8 bytes: ASCII letters in lower case, other ASCII than letters and digits as spaces, the rest as it is.
_SPLIT = bytes(k if k > 127 else ord(chr(k).lower()) if chr(k).isalnum() else 32 for k in range(256))


@dataclass(frozen=True)
class Settings:
    share: float = 0.7  # least share of an item's words in order in a document
    answer_share: float = 0.5  # least share of its answer's words in order in the same place
    half: int = 32  # words; windows span two halves and each is confirmed with a half more on either side
    passage: int = 64  # words of a benchmark passage: longer items are cut
    block: int = 256  # passages whose latent space is built at once
    rank: int = 128  # of that space
    common: float = 0.02  # share of documents from which on a word is common


def words(text: str | None) -> list[bytes]:
    """Maximal runs of letters and digits of the lower-cased text, in UTF-8."""
    if not text:
        return []
    if not text.isascii():
        text = text.lower()
        marks = [c for c in set(text.encode().translate(None, _ASCII).decode()) if not c.isalnum()]  # beyond ASCII
        if len(marks) > 8:
            text = text.translate(dict.fromkeys(map(ord, marks), " "))
        else:
            for mark in marks:
                text = text.replace(mark, " ")
    return text.encode().translate(_SPLIT).split()


def common_subsequence(item: list[bytes], other: list[bytes]) -> int:
    """Length of the longest common subsequence, by bit-parallel dynamic programming (Hyyro 2004)."""
    at: dict[bytes, int] = {}
    for k, w in enumerate(item):
        at[w] = at.get(w, 0) | 1 << k
    full = (1 << len(item)) - 1
    v = full
    for w in other:
        if m := at.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


@dataclass
class Passage:
    item_id: int
    words: list[bytes]
    answer: list[bytes]


def passages(spark: SparkSession, benchmark: DataFrame, settings: Settings) -> Iterator[list[Passage]]:
    """The benchmark's passages, a block at a time. Only items with a value in an ``answer`` column have an answer."""
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    block: list[Passage] = []
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text", answer.alias("answer")).distinct().orderBy("item_id", "text").toLocalIterator():
        w = words(row["text"])
        last = words(row["answer"])
        for k in range(0, len(w), settings.passage):
            part = w[k : k + settings.passage]
            if k and len(part) < settings.passage // 2:
                part = w[-settings.passage :]
            block.append(Passage(row["item_id"], part, last if k + settings.passage >= len(w) else []))
            if len(block) == settings.block:
                yield block
                block = []
    if block:
        yield block


def document_counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> tuple[int, np.ndarray]:
    """Documents, and how many hold each word of the vocabulary. Each task sums before anything moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, counts = 0, np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            held: list[int] = []
            for text in batch.column(0).to_pylist():
                held.extend(set(map(vocabulary.get, words(text), repeat(-1))))
            counts += np.bincount(np.array(held, np.int64) + 1, minlength=len(counts) + 1)[1:]
            n += batch.num_rows
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, at)), pa.array(np.append(n, counts[at]))], ["term", "n"])

    found = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = found.column("term").to_numpy(), found.column("n").to_numpy()
    counts = np.zeros(len(vocabulary), np.int64)
    counts[term[term >= 0]] = n[term >= 0]
    return int(n[term < 0].sum()), counts


def randomized_svd(spark: SparkSession, rows: list[tuple[list[int], list[float]]], columns: int, rank: int, tasks: int = 4, extra: int = 8, rounds: int = 2, seed: int = 0) -> np.ndarray:
    """Right singular vectors (columns x rank) of a sparse row matrix whose rows lie in ``tasks`` partitions.

    Each round sends the range basis to the tasks and sums their parts of A'AQ, so what reaches the driver is
    ``tasks`` matrices of the basis' size, however many rows there are.
    """
    width = min(columns, rank + extra)
    table = spark.createDataFrame(rows, "idx array<int>, val array<double>").repartition(tasks)

    def product(basis: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((columns, width))
            for batch in batches:
                for idx, val in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    a = np.array(val)
                    np.add.at(total, idx, a[:, None] * (a @ basis[idx])[None])
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

        return sum(np.frombuffer(r["part"]).reshape(columns, width) for r in table.mapInArrow(run, "part binary").collect())

    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(columns, width)))[0]
    for _ in range(rounds):
        basis = np.linalg.qr(product(basis))[0]
    values, vectors = np.linalg.eigh(basis.T @ product(basis))
    order = np.argsort(-values)[:rank]
    return basis @ vectors[:, order[values[order] > 1e-9 * max(values.max(), 1e-300)]]


@dataclass
class Index:
    """One block's latent space and what confirming needs."""

    block: list[Passage]
    vocabulary: dict[bytes, int]
    folded: np.ndarray  # term x latent dimension, weighted by idf
    items: np.ndarray  # passage x latent dimension, unit rows
    uncommon: np.ndarray  # per term
    needed: int  # uncommon words that any confirmed place holds
    held: np.ndarray  # term x passage: how often the passage holds it
    settings: Settings

    def __post_init__(self):
        self.least = np.array([self.settings.share * len(p.words) for p in self.block])

    def search(self, text: str | None, one: bool = False) -> list[tuple[int, float, float, int]]:
        """(item_id, cosine, share, first word) of the best confirmed place of each item in a whole text; with ``one``, of
        the first place that is confirmed alone."""
        s, w = self.settings, words(text)
        terms = set(map(self.vocabulary.get, w, repeat(-1))) - {-1}
        if not terms:
            return []
        terms = np.sort(np.fromiter(terms, np.int64, len(terms)))
        # the words of an item that a text holds at all, in whatever order, bound their common subsequence
        held = self.held.take(terms, axis=0)
        alive = np.flatnonzero(held.sum(0) >= self.least)
        if not len(alive):
            return []
        ids = np.fromiter(map(self.vocabulary.get, w, repeat(-1)), np.int64, len(w))
        at = np.flatnonzero(ids >= 0)
        halves = -(-len(w) // s.half)
        rare = np.bincount(at[self.uncommon[ids[at]]] // s.half, minlength=halves + 3)
        near = rare[: halves + 1] + rare[1 : halves + 2] + rare[2 : halves + 3]  # halves k .. k+2
        ahead = np.concatenate(([0], rare[: halves]))[:halves]
        windows = np.flatnonzero(near[:halves] + ahead >= self.needed)  # a window's halves and one on either side
        cosines = None
        best: dict[int, tuple[float, float, int]] = {}
        for row, k in self._candidates(windows, at, np.searchsorted(terms, ids[at]), held[:, alive], self.least[alive]):
            first = max(0, (int(windows[row]) - 1) * s.half)
            place = slice(first, (int(windows[row]) + 3) * s.half)
            p = int(alive[k])
            passage = self.block[p]
            n = common_subsequence(passage.words, w[place])
            if n < self.least[p] or common_subsequence(passage.answer, w[place]) < s.answer_share * len(passage.answer):
                continue
            if cosines is None:
                cosines = self._cosines(windows, halves, at, ids, alive)
            hit = (n / len(passage.words), float(cosines[row, k]), -first)
            best[passage.item_id] = max(best.get(passage.item_id, hit), hit)
            if one:
                return [(passage.item_id, hit[1], hit[0], -hit[2])]
        return [(item, cosine, share, -first) for item, (share, cosine, first) in best.items()]

    def _candidates(self, windows: np.ndarray, at: np.ndarray, term: np.ndarray, held: np.ndarray, least: np.ndarray, step: int = 256) -> Iterator[tuple[int, int]]:
        """(row of ``windows``, column of ``held``) where the distinct words of a window's place, in any order, reach the
        least share; ``term`` are the rows of ``held`` of the words at ``at``. Windows go ``step`` at a time."""
        half = self.settings.half
        order = np.argsort(term, kind="stable")
        again = np.flatnonzero(np.diff(term[order]) == 0)
        before = np.full(len(at), -1)  # where the same word was last
        before[order[again + 1]] = at[order[again]]
        for first in range(0, len(windows), step):
            some = windows[first : first + step]
            begin = np.maximum(some - 1, 0) * half
            low, high = np.searchsorted(at, begin), np.searchsorted(at, (some + 3) * half)
            n = high - low
            row = np.repeat(np.arange(len(some)), n)
            word = np.arange(len(row)) + np.repeat(low - (np.cumsum(n) - n), n)
            new = before[word] < begin[row]
            row, word = row[new], word[new]
            if not len(row):
                continue
            starts = np.flatnonzero(np.diff(row, prepend=-1))
            found, k = np.nonzero(np.add.reduceat(held[term[word]], starts, axis=0) >= least)
            yield from zip((first + row[starts[found]]).tolist(), k.tolist(), strict=True)

    def _cosines(self, windows: np.ndarray, halves: int, at: np.ndarray, ids: np.ndarray, alive: np.ndarray) -> np.ndarray:
        """Of the folded windows with the items of the passages ``alive``."""
        wanted = np.zeros(halves + 2, bool)
        wanted[windows] = wanted[windows + 1] = True
        at = at[wanted[at // self.settings.half]]
        sums = np.zeros((halves + 2, self.folded.shape[1]), np.float32)
        half = at // self.settings.half
        starts = np.flatnonzero(np.diff(half, prepend=-1))
        if len(at):
            sums[half[starts]] = np.add.reduceat(self.folded[ids[at]], starts, axis=0)
        vectors = sums[windows] + sums[windows + 1]
        norms = np.linalg.norm(vectors, axis=1, keepdims=True)
        return (vectors / np.where(norms > 0, norms, 1)) @ self.items[alive].T


def build(spark: SparkSession, block: list[Passage], docs: DataFrame, settings: Settings) -> Index:
    vocabulary = {w: k for k, w in enumerate(sorted({w for p in block for w in p.words}))}
    n, counts = document_counts(docs, vocabulary)
    idf = np.log((n + 1) / (counts + 1)) + 1
    rows = []
    for p in block:
        tf = Counter(vocabulary[w] for w in p.words)
        rows.append((list(tf), [c * float(idf[t]) for t, c in tf.items()]))
    space = randomized_svd(spark, rows, len(vocabulary), min(settings.rank, len(block), len(vocabulary)))
    items = np.array([np.array(val) @ space[idx] for idx, val in rows])
    items /= np.maximum(np.linalg.norm(items, axis=1, keepdims=True), 1e-300)
    uncommon = counts < settings.common * max(n, 1)
    needed = min(sum(bool(uncommon[vocabulary[w]]) for w in p.words) - math.floor((1 - settings.share) * len(p.words)) for p in block)
    held = np.zeros((len(vocabulary), len(block)), np.int32)
    for k, p in enumerate(block):
        np.add.at(held[:, k], [vocabulary[w] for w in p.words], 1)
    return Index(block, vocabulary, (space * idf[:, None]).astype(np.float32), items.astype(np.float32), uncommon, max(needed, 0), held, settings)


def contaminated(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row for each document and benchmark item found in it: (doc_id, item_id, cosine, share, first_word).

    Whole texts of all rows are searched in place, once for each block of ``settings.block`` passages, without a
    shuffle. Windows are passed over only where they hold too few of the items' uncommon words to reach the least
    share. Null and empty texts or items are never found; repeated rows give repeated rows, repeated items one; ties
    between places of one item go to the higher share, then cosine, then the earlier place. An empty table on either
    side gives no rows; other columns, but for an ``answer`` of the benchmark, are never looked at.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, cosine double, share double, first_word long"
    out = spark.createDataFrame([], schema)
    for block in passages(spark, benchmark, settings):
        shared = spark.sparkContext.broadcast(build(spark, block, texts, settings))  # a block's size, not the benchmark's

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, names = shared.value, ["doc_id", "item_id", "cosine", "share", "first_word"]
            types = pa.schema(list(zip(names, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()), strict=True)))
            for batch in batches:
                rows = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for m in index.search(t)]
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], types)

        out = out.unionByName(texts.mapInArrow(run, schema))
    return out


def _held_in(shared) -> Callable[[Column], Column]:
    """Whether a text holds an item of a broadcast index."""

    @F.pandas_udf("boolean")
    def held(text):
        import pandas as pd

        index = shared.value
        return pd.Series([bool(index.search(t, one=True)) for t in text], dtype=bool)

    return held


def decontaminated(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs``, all columns, in whose text no benchmark item is found.

    Every row is judged by its own text, whatever its id: null and repeated ids are no exception. Null and empty texts
    stay; an empty table on either side changes nothing. Rows are filtered where they are, without a shuffle.
    """
    spark, out = docs.sparkSession, docs
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for block in passages(spark, benchmark, settings):
        shared = spark.sparkContext.broadcast(build(spark, block, texts, settings))  # a block's size, not the benchmark's
        out = out.where(~_held_in(shared)(F.col("text")))
        tidied(spark)
    return out

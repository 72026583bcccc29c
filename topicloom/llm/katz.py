"""LM scoring by a Katz back-off model (Katz 1987) of any order with Good-Turing discounts.

Texts become blocks of token indices with their distinct words. Word counts and numbers come from one exchange of each
block's distinct words with buckets of the word table; words are numbered from the most frequent on, so a word's count
follows from its number and a table of as many steps as there are distinct counts.

Then each order from 2 on takes one exchange: a block sends its distinct n-grams, their training counts and the
probabilities of their last words at the order below to the buckets of that order's table, which is stored. Good-Turing
counts and the sums of spread histories are gathered from it, then the table is read bucket by bucket: a seen n-gram has
its discounted share, an unseen one its history's back-off weight times the probability from the order below, and both
go back to the block that asked. So each token is evaluated recursively from the words alone up to the model's order.
A history stays in one bucket, unless it occurs oftener than a bucket should hold: its n-grams are spread over as many
buckets as that takes, and their few sums are added up between the two passes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm.common import dropped, released, shuffle_partitions, stored


@dataclass(frozen=True)
class Settings:
    order: int = 2
    folds: int = 7  # rows whose crc32 of the id leaves ``held`` are scored, not learnt from
    held: int = 2
    cutoff: int = 5  # largest count that is discounted
    block_tokens: int = 1_000_000  # of a block of texts, and of a bucket on average
    most: int = 250_000  # occurrences of a history that one bucket takes
    hot: int = 65_536  # spread histories of each order at most, the most frequent: what the driver holds of them is bounded
    slices: int = 1  # of the buckets, dealt out one after another: that much less is shuffled at a time


END = b" "  # no word holds a space
_PARTS = "block long, kind int, part int, a binary, b binary, c binary"
_PARTS_ARROW = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("part", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
_TABLE = "kind int, part int, blocks binary, sizes binary, inverse binary, grams binary, counts binary, spread binary, lower binary"
_TABLE_ARROW = pa.schema([("kind", pa.int32()), ("part", pa.int32()), *((c, pa.binary()) for c in ("blocks", "sizes", "inverse", "grams", "counts", "spread", "lower"))])


def pack(values: np.ndarray) -> bytes:
    """A numeric array's bytes, one plane of each byte of its numbers after another, compressed. Of integers only the
    planes up to the largest number's last byte are kept; their number comes first."""
    import zstandard

    width = values.itemsize
    if values.dtype.kind in "iu" and len(values) and values.min() >= 0:
        width = max(1, -(-int(values.max()).bit_length() // 8))
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes))


def unpack(raw: bytes, dtype) -> np.ndarray:
    import zstandard

    width, size = raw[0], np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], size), np.uint8)
    out[:, :width] = planes.T
    return out.view(dtype).ravel()


def _rows(rows: list[tuple], schema: pa.Schema = _PARTS_ARROW) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row after another, of which only one at a time is copied out of its batch."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}


def _by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows of one key after another, of input sorted by it."""
    held, group = None, []
    for row in _each(batches):
        if row[key] != held:
            if group:
                yield held, group
            held, group = row[key], []
        group.append(row)
    if group:
        yield held, group


def good_turing(of_counts: np.ndarray, cutoff: int) -> np.ndarray:
    """Discount of each count up to the cutoff (index 0 unused), from how many kinds have each count up to cutoff + 1.

    Where Turing's estimate leaves (0, 1), as it may on few data, the count gives up a half instead.
    """
    d = np.ones(cutoff + 1)
    n = np.asarray(of_counts, float)
    tail = (cutoff + 1) * n[cutoff + 1] / n[1] if n[1] else 1.0
    for r in range(1, cutoff + 1):
        value = ((r + 1) * n[r + 1] / n[r] / r - tail) / (1 - tail) if n[r] and tail < 1 else 0.0
        d[r] = value if 0 < value < 1 else (r - 0.5) / r
    return d


@dataclass
class Words:
    """What a word's number says of it: counts fall from number to number in steps."""

    starts: np.ndarray  # first number of each step
    counts: np.ndarray  # count of each step; 0 for words that only held-out texts have
    sizes: np.ndarray  # words of each step
    texts: int  # training texts
    cutoff: int

    def __post_init__(self):
        sizes = self.sizes
        self.total = int((self.counts * sizes).sum())
        self.kinds = int(sizes[self.counts > 0].sum())
        of_counts = np.zeros(self.cutoff + 2)
        small = (self.counts > 0) & (self.counts <= self.cutoff + 1)
        np.add.at(of_counts, self.counts[small], sizes[small])
        d = good_turing(of_counts, self.cutoff)
        c = self.counts.astype(float)
        kept = c * np.where(self.counts <= self.cutoff, d[np.minimum(self.counts, self.cutoff)], 1.0)
        unknown = 1 - (kept * sizes)[self.counts > 0].sum() / self.total if self.total else 1.0
        if unknown > 1e-12 and self.total:
            self.by_step = np.where(self.counts > 0, kept / self.total, unknown)
        else:  # nothing was discounted: one more than each count
            self.by_step = (c + 1) / (self.total + self.kinds + 1)
        self.base_by_step = np.log10((c + 1) / (self.total + self.kinds + 1))
        self.before = int(sizes.sum())  # the number that stands for what is before a text's first token

    def step(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, ids, "right") - 1


def _blocks(docs: DataFrame, settings: Settings) -> DataFrame:
    """Rows of kind 0: a block's sorted word hashes, their training counts, token indices; kind 1: its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from xxhash import xxh3_64_intdigest

        base, seq = TaskContext.get().partitionId() << 32, 0
        known: defaultdict[bytes, int] = defaultdict()
        known.default_factory = known.__len__
        tokens: list[np.ndarray] = []
        docs_of: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, size
            hashes = np.fromiter(map(xxh3_64_intdigest, known), np.uint64, len(known))
            order = np.argsort(hashes, kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            local = rank[np.concatenate(tokens)]
            lengths = np.array([n for _, n, _ in docs_of], np.int64)
            train = np.repeat([not h for _, _, h in docs_of], lengths)
            counts = np.bincount(local[train], minlength=len(order)).astype(np.int64)
            ids = pa.array([d for d, _, _ in docs_of], pa.int64())
            valid = np.array(ids.is_valid())
            rows = [
                (base + seq, 0, 0, pack(hashes[order]), pack(counts), pack(local)),
                (base + seq, 1, 0, pack(lengths), pack(np.array([h for _, _, h in docs_of], np.uint8) | (~valid).astype(np.uint8) << 1), pack(np.array(ids.fill_null(0)))),
            ]
            seq, size = seq + 1, 0
            known.clear(), tokens.clear(), docs_of.clear()
            return _rows(rows)

        for batch in batches:
            for doc_id, held, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = (text or b"").lower().split()
                found.append(END)
                tokens.append(np.fromiter(map(known.__getitem__, found), np.uint32, len(found)))
                docs_of.append((doc_id, len(found), held))
                size += len(found)
                if size >= settings.block_tokens:
                    yield flush()
        if docs_of:
            yield flush()

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % settings.folds == settings.held, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held"), F.col("text").cast("binary").alias("text")).mapInArrow(run, _PARTS)


def _word_table(blocks: DataFrame, buckets: int) -> DataFrame:
    """Kind 0: counts (a) and ranks among the bucket's words of the same count (b) of one block's words in one bucket.
    Kind 1: the distinct counts (a) of a bucket and how many words have each (b)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            hashes, counts = unpack(row["a"], np.uint64), unpack(row["b"], np.int64)
            bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            held, first = np.unique(bucket, return_index=True)  # hashes are sorted, and so are buckets
            ends = np.append(first[1:], len(hashes))
            yield _rows([(row["block"], 0, k, pack(hashes[a:b]), pack(counts[a:b]), None) for k, a, b in zip(held.tolist(), first.tolist(), ends.tolist(), strict=True)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, group in _by_key(batches, "part"):
            each = [unpack(r["a"], np.uint64) for r in group]
            words, inverse = np.unique(np.concatenate(each), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([unpack(r["b"], np.int64) for r in group]), len(words)).astype(np.int64)
            order = np.argsort(-counts, kind="stable")
            first = np.flatnonzero(np.diff(counts[order], prepend=-1))
            rank = np.empty(len(words), np.int64)
            rank[order] = np.arange(len(words)) - np.repeat(first, np.diff(np.append(first, len(words))))
            out = [(0, 1, part, pack(counts[order][first]), pack(np.diff(np.append(first, len(words)))), None)]
            at = 0
            for row, hashes in zip(group, each, strict=True):
                mine = inverse[at : at + len(hashes)]
                at += len(hashes)
                out.append((row["block"], 0, part, pack(counts[mine]), pack(rank[mine].astype(np.uint32)), None))
            yield _rows(out)

    dealt = blocks.where("kind = 0").mapInArrow(deal, _PARTS)
    return dealt.repartition(buckets, "part").sortWithinPartitions("part", "block").mapInArrow(count, _PARTS)


def _numbering(table: DataFrame, texts: int, settings: Settings) -> tuple[Words, DataFrame]:
    """The steps of the numbering, and each bucket's first number of each count (kind -2, a = counts, b = numbers)."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            counts, sizes = unpack(row["a"], np.int64), unpack(row["b"], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(counts), row["part"], np.int32)), pa.array(counts), pa.array(sizes)], ["part", "count", "n"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            counts, numbers = np.array(sorted((s["count"], s["number"]) for s in row["numbers"]), np.int64).T
            yield _rows([(0, -2, row["part"], pack(counts), pack(numbers), None)])

    steps = stored(table.where("kind = 1").mapInArrow(spread, "part int, count long, n long"), "steps")
    totals = steps.groupBy("count").agg(F.sum("n").alias("n")).orderBy(F.desc("count")).toArrow()  # at most sqrt(2 tokens) rows
    counts, sizes = totals.column("count").to_numpy(), totals.column("n").to_numpy()
    starts = np.cumsum(sizes) - sizes
    words = Words(starts, counts, sizes, texts, settings.cutoff)
    first = table.sparkSession.createDataFrame(pa.table({"count": counts, "start": starts}))
    before = F.sum("n").over(Window.partitionBy("count").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row per bucket
    placed = steps.withColumn("before", F.coalesce(before, F.lit(0))).join(first, "count")
    lists = placed.groupBy("part").agg(F.collect_list(F.struct("count", (F.col("start") + F.col("before")).alias("number"))).alias("numbers"))
    return words, lists.mapInArrow(packed, _PARTS)


def _numbered(blocks: DataFrame, table: DataFrame, numbering: DataFrame, buckets: int, tasks: int) -> DataFrame:
    """Kind 0: a block's tokens by number (a), its texts' lengths (b) and flags (c). Kind 1: their ids (a)."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            if row["kind"] == -2:  # first of its bucket
                counts, first = unpack(row["a"], np.int64), unpack(row["b"], np.int64)
            else:
                ids = first[np.searchsorted(counts, unpack(row["a"], np.int64))] + unpack(row["b"], np.uint32)
                yield _rows([(row["block"], -1, row["part"], pack(ids), None, None)])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, group in _by_key(batches, "block"):
            ids = np.concatenate([unpack(r["a"], np.int64) for r in group if r["kind"] == -1])
            tokens = ids[unpack(next(r["c"] for r in group if r["kind"] == 0), np.uint32)]
            about = next(r for r in group if r["kind"] == 1)
            yield _rows([(block, 0, 0, pack(tokens), about["a"], about["b"]), (block, 1, 0, about["c"], None, None)])

    asked = table.where("kind = 0").unionByName(numbering).repartition(buckets, "part").sortWithinPartitions("part", "kind")
    blocks = blocks.withColumn("a", F.when(F.col("kind") == 1, F.col("a"))).withColumn("b", F.when(F.col("kind") == 1, F.col("b")))
    return blocks.unionByName(asked.mapInArrow(number, _PARTS)).repartition(tasks, "block").sortWithinPartitions("block", "kind", "part").mapInArrow(meet, _PARTS)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)


def kinds(cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(an index of each distinct tuple, in order; each tuple's place among the distinct) of columns of numbers from 0 on."""
    key = cols[0]
    for c in cols[1:]:
        bits = int(c.max()).bit_length()
        if int(key.max()).bit_length() + bits > 63:
            key = np.unique(key, return_inverse=True)[1]
        key = key << bits | c
    order = np.argsort(key)
    new = np.diff(key[order], prepend=-1) != 0
    inverse = np.empty(len(key), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return order[new], inverse


def _grams(tokens: np.ndarray, lengths: np.ndarray, order: int, before: int) -> list[np.ndarray]:
    """The columns of the n-grams that end at each token, the oldest word first."""
    place = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    cols = [tokens]
    for back in range(1, order):
        col = np.full(len(tokens), before, np.int64)
        col[back:] = np.where(place[back:] >= back, tokens[:-back], before)
        cols.insert(0, col)
    return cols


@dataclass
class _Block:
    """A block's tokens and how its distinct n-grams of one order lie in buckets."""

    tokens: np.ndarray
    lengths: np.ndarray
    flags: np.ndarray
    words: Words
    settings: Settings
    buckets: int

    def __post_init__(self):
        self.firsts = np.cumsum(self.lengths) - self.lengths
        self.step = self.words.step(self.tokens)
        self.p = self.words.by_step[self.step]
        self.order = 1
        s = self.settings
        self.spread = spread_of(self.words.counts, s.most)[self.step]  # of each token's word as a history
        self.spread[self.tokens >= s.hot] = 1

    def deal(self) -> None:
        """Lay out the distinct n-grams of the next order."""
        self.order += 1
        self.cols = _grams(self.tokens, self.lengths, self.order, self.words.before)
        first, self.inverse = kinds(self.cols)
        self.lower = self.p[first]
        behind = np.empty(len(self.tokens), np.int64)
        behind[1:] = self.spread[:-1]
        behind[self.firsts] = spread_of(np.array([self.words.texts]), self.settings.most)[0]
        self.behind = behind[first]
        self.cols = [c[first] for c in self.cols]
        mixed = np.zeros(len(first), np.uint64)
        for c in self.cols[:-1]:
            mixed = _mixed(mixed + c.astype(np.uint64) + np.uint64(1))
        mixed += _mixed(self.cols[-1].astype(np.uint64)) % self.behind.astype(np.uint64)
        bucket = (_mixed(mixed) >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)
        self.by = np.argsort(bucket, kind="stable")
        self.held, at = np.unique(bucket[self.by], return_index=True)
        self.cuts = np.append(at, len(first))

    def answered(self, rows: list[dict], probabilities: bool) -> None:
        """Take in the answers to the distinct n-grams of this order, a row of each bucket."""
        p, spread = np.empty(len(self.by)), np.ones(len(self.by), np.int64)
        place = {int(k): n for n, k in enumerate(self.held)}
        for row in rows:
            n = place[row["part"]]
            mine = self.by[self.cuts[n] : self.cuts[n + 1]]
            if probabilities:
                p[mine] = unpack(row["a"], np.float64)
            if row["b"]:
                spread[mine] = unpack(row["b"], np.int64)
        self.p, self.spread = p[self.inverse], spread[self.inverse]


def spread_of(counts: np.ndarray, most: float) -> np.ndarray:
    """Buckets that histories of these counts are spread over."""
    return np.maximum(1, np.ceil(counts / most)).astype(np.int64)


def _of_group(group: list[dict], order: int, words: Words, settings: Settings, buckets: int) -> _Block:
    """A block with all answers up to an order; only those of that order hold probabilities."""
    head = next(r for r in group if r["kind"] == 0)
    block = _Block(unpack(head["a"], np.int64), unpack(head["b"], np.int64), unpack(head["c"], np.uint8), words, settings, buckets)
    for k in range(2, order + 1):
        block.deal()
        block.answered([r for r in group if r["kind"] == k], k == order)
    return block


def _together(numbered: DataFrame, answers: dict[int, DataFrame], tasks: int) -> DataFrame:
    """A block's tokens and its answers; below the highest order these are only what tells the buckets."""
    if not answers:
        return numbered
    out = numbered
    for k, rows in answers.items():
        out = out.unionByName(rows if k == max(answers) else rows.withColumn("a", F.lit(None).cast("binary")))
    return out.repartition(tasks, "block").sortWithinPartitions("block", "kind", "part")


def _asked(together: DataFrame, order: int, part: int, words: Words, settings: Settings, buckets: int) -> DataFrame:
    """One slice of the blocks' distinct n-grams: (block, kind, part = bucket, a = columns, b = counts and spread, c = lower)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, group in _by_key(batches, "block"):
            block = _of_group(group, order - 1, words, settings, buckets)
            block.deal()
            train = np.repeat((block.flags & 1) == 0, block.lengths)
            counts = np.bincount(block.inverse[train], minlength=len(block.by))
            for k, a, b in zip(block.held.tolist(), block.cuts[:-1], block.cuts[1:], strict=True):
                if k % settings.slices == part:
                    mine = block.by[a:b]
                    lower = pack(block.lower[mine]) if order > 2 else None
                    yield _rows([(number, order, k, pack(np.concatenate([c[mine] for c in block.cols])), pack(np.concatenate([counts[mine], block.behind[mine]])), lower)])

    return together.where("kind != 1").mapInArrow(run, _PARTS)


def _lower(row: dict, last: np.ndarray, words: Words) -> np.ndarray:
    """Probabilities of n-grams' last words at the order below."""
    return words.by_step[words.step(last)] if row["lower"] is None else unpack(row["lower"], np.float64)


def _tabled(asked: DataFrame, order: int, buckets: int, words: Words, settings: Settings) -> DataFrame:
    """The table of an order's n-grams. Kind 1: a bucket's distinct n-grams, sorted, with counts, and which of them each
    block asked for. Kind 2: the bucket's counts of counts, and ``_sums`` of its histories that are spread (grams, lower)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, group in _by_key(batches, "part"):
            each = [unpack(r["a"], np.int64).reshape(order, -1) for r in group]
            sizes, grams = np.array([e.shape[1] for e in each]), np.concatenate(each, 1)
            each.clear()
            first, inverse = kinds(list(grams))
            grams = grams[:, first]
            more = np.concatenate([unpack(r["b"], np.int64).reshape(2, -1) for r in group], 1)
            counts, spread = np.bincount(inverse, more[0], len(first)).astype(np.int64), more[1][first]
            row = {"lower": None}
            if order > 2:
                row["lower"] = pack(np.concatenate([unpack(r["c"], np.float64) for r in group])[first])
            blocks = np.array([r["block"] for r in group], np.int64)
            yield _rows([(1, part, pack(blocks), pack(sizes), pack(inverse.astype(np.uint32)), pack(grams.ravel()), pack(counts), pack(spread), row["lower"])], _TABLE_ARROW)
            small = counts[(counts > 0) & (counts <= settings.cutoff + 1)]
            of_counts = np.bincount(small, minlength=settings.cutoff + 3).astype(float)
            hot = np.flatnonzero(spread > 1)
            runs = _runs(grams[:-1, hot])
            sums = _sums(counts[hot], _lower(row, grams[-1], words)[hot], runs, settings.cutoff)
            yield _rows([(2, part, None, None, None, np.ascontiguousarray(grams[:-1, hot[runs]].T).tobytes(), of_counts.tobytes(), None, sums.tobytes())], _TABLE_ARROW)

    return asked.repartition(buckets, "part").sortWithinPartitions("part", "block").mapInArrow(run, _TABLE)


def _runs(histories: np.ndarray) -> np.ndarray:
    """Where each run of equal columns begins."""
    return np.flatnonzero((np.diff(histories, axis=1, prepend=-1) != 0).any(0))


def _sums(counts: np.ndarray, lower: np.ndarray, runs: np.ndarray, cutoff: int) -> np.ndarray:
    """Per history: its count, how many of its n-grams have each count up to the cutoff, the sum of the larger counts, and
    the lower probability of what was seen after it. They add up over the buckets of a spread history."""
    if not len(runs):
        return np.empty((0, cutoff + 3))
    each = [counts, *((counts == r) for r in range(1, cutoff + 1)), np.where(counts > cutoff, counts, 0), np.where(counts > 0, lower, 0.0)]
    return np.stack([np.add.reduceat(v.astype(float), runs) for v in each], 1)


def _gathered(table: DataFrame, order: int, settings: Settings) -> tuple[np.ndarray, dict[bytes, np.ndarray]]:
    """The order's counts of counts, and the sums of spread histories, of which there are ``hot`` at most."""
    width = settings.cutoff + 3
    names = [f"v{k}" for k in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            size = 8 * (order - 1)
            histories = [b"", *(row["grams"][k : k + size] for k in range(0, len(row["grams"]), size))]
            values = np.concatenate([np.frombuffer(row["counts"]), np.frombuffer(row["lower"])]).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([pa.array(histories, pa.binary()), *(pa.array(v) for v in values.T)], ["history", *names])

    rows = table.where("kind = 2").select("grams", "counts", "lower").mapInArrow(run, "history binary, " + ", ".join(f"{n} double" for n in names))
    sums = {bytes(r[0]): np.array(r[1:]) for r in rows.groupBy("history").agg(*(F.sum(n) for n in names)).collect()}
    return sums.pop(b"", np.zeros(width)), sums


def _answers(table: DataFrame, order: int, words: Words, settings: Settings) -> DataFrame:
    """Kind = order: the probabilities (a) of the n-grams that a block asked a bucket for, and over how many buckets they
    are spread as histories of the next order (b)."""
    of_counts, hot = _gathered(table, order, settings)
    cutoff = settings.cutoff
    discounts = good_turing(of_counts, cutoff)
    most = max(settings.most, words.total / settings.hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            grams, counts, spread = unpack(row["grams"], np.int64).reshape(order, -1), unpack(row["counts"], np.int64), unpack(row["spread"], np.int64)
            lower, runs = _lower(row, grams[-1], words), _runs(grams[:-1])
            sums = _sums(counts, lower, runs, cutoff)
            for k in np.flatnonzero(spread[runs] > 1).tolist():
                sums[k] = hot[np.ascontiguousarray(grams[:-1, runs[k]]).tobytes()]
            total, seen = sums[:, 0], sums[:, -1]
            kept = sums[:, 1 : cutoff + 1] @ (np.arange(1, cutoff + 1) * discounts[1:]) + sums[:, cutoff + 1]
            with np.errstate(divide="ignore", invalid="ignore"):
                left = 1 - kept / total
                bare = left <= 1e-12  # every count was too large to discount: one more in the denominator
                left = np.where(bare, 1 / (total + 1), left)
                scale = np.where(bare, 1 / (total + 1), 1 / total)
                back = np.where(total > 0, left / (1 - seen), 1.0)
                lengths = np.diff(np.append(runs, len(counts)))
                p = np.where(counts > 0, counts * np.where(counts <= cutoff, discounts[np.minimum(counts, cutoff)], 1.0) * np.repeat(scale, lengths), np.repeat(back, lengths) * lower)
            after = spread_of(counts, most)
            inverse, begin = unpack(row["inverse"], np.uint32), 0
            for block, n in zip(unpack(row["blocks"], np.int64).tolist(), unpack(row["sizes"], np.int64).tolist(), strict=True):
                mine = inverse[begin : begin + n]
                begin += n
                wide = after[mine]
                yield _rows([(block, order, row["part"], pack(p[mine]), pack(wide) if wide.max() > 1 else None, None)])

    return table.where("kind = 1").mapInArrow(run, _PARTS)


def katz_scores(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    A text's tokens are its words, A to Z lowered, and one end. ``base_score`` sums log10((c + 1) / (N + V + 1)) and
    ``score`` the back-off model's log10 probabilities: a seen n-gram has its discounted share of its history's count; an
    unseen one the history's back-off weight times the word's probability at the order below, down to its Good-Turing
    unigram probability, where all unseen words share one unknown class; a history without counts backs off with weight
    1. Every distribution sums to 1. Words of equal 64-bit hash would count as one.
    Null and empty texts are an end alone; a null doc_id stays null and is learnt from; repeated rows count and score
    each by itself; an empty table gives no rows; other columns are never looked at. No text, count or document is
    capped: a block holds a bounded number of tokens and at least one text.
    """
    spark = docs.sparkSession
    tasks = shuffle_partitions(spark)
    blocks = stored(_blocks(docs, settings), "token-blocks")
    n_blocks = blocks.where("kind = 1").count()
    buckets = max(tasks, n_blocks)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    if not n_blocks:
        return spark.createDataFrame([], schema)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % settings.folds == settings.held, F.lit(False))
    texts = docs.select("doc_id").where(~held).count()
    table = stored(_word_table(blocks, buckets), "words")
    words, numbering = _numbering(table, texts, settings)
    numbered = stored(_numbered(blocks, table, numbering, buckets, tasks), "numbered")
    dropped(table), dropped(blocks)
    released(spark)
    answers: dict[int, DataFrame] = {}
    for order in range(2, settings.order + 1):
        slices = []
        for part in range(settings.slices):
            asked = _asked(_together(numbered, answers, tasks), order, part, words, settings, buckets)
            slices.append(stored(_tabled(asked, order, buckets, words, settings), f"order-{order}"))
            released(spark)
        table = slices[0]
        for more in slices[1:]:
            table = table.unionByName(more)
        answers[order] = _answers(table, order, words, settings)
        if order < settings.order:
            answers[order] = stored(answers[order], "answers")
            for one in slices:
                dropped(one)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _by_key(batches, "block"):
            ids = unpack(next(r["a"] for r in group if r["kind"] == 1), np.int64)
            block = _of_group(group, settings.order, words, settings, buckets)
            per_text = [np.add.reduceat(v, block.firsts) for v in (words.counts[block.step] > 0, words.base_by_step[block.step], np.log10(block.p))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=block.flags >> 1 > 0), pa.array(block.flags & 1 > 0), pa.array(block.lengths), pa.array(per_text[0].astype(np.int64)), pa.array(np.full(len(ids), words.total)), pa.array(per_text[1]), pa.array(per_text[2])],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return _together(numbered, answers, tasks).mapInArrow(finish, schema)

"""Suffix-array dedup: removal of every byte inside a string of some length that starts anywhere else too.

A string of ``length`` bytes that occurs twice has, at both places, the same lowest-hashed q-gram (a minimizer), so only
suffixes that begin at minimizers with an equal q-gram can share one. Around each such anchor lies a context of at most
``length`` bytes to the right and ``length - q`` to the left. Contexts that occur twice are repeats as they stand. The
distinct contexts of an anchor are suffix-sorted by mergesort, forwards from the anchor and backwards before it; the
comparison finds common extensions by binary search over prefix polynomial hashes and verifies them on the bytes. A
merge of the backward order from the longest common extension down then meets, for each context, every partner that can
extend its longest repeat. Where an anchor has more contexts than one task should sort, longer q-grams around it tell them
apart first: a repeat holds half of what it has beyond the q-gram on one side at least, so contexts that share neither the
q-gram lengthened by that much to the left nor to the right share no repeat. Groups that are still too large are sorted in chunks of their suffix order, ahead and then
backwards; contexts are cut to what other chunks share with them, which leaves few kinds, and one of each kind goes on. Where kinds
stay too many, they are matched by hashed windows.
Equal contexts are told by cryptographic digests, for which no two byte strings of one digest are known.

Repeats can be looked for at two lengths at once: at ``length``, and at a shorter one for passages counted in words.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cmp_to_key, lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm.common import dropped, released, stored


@dataclass(frozen=True)
class Settings:
    length: int = 400  # bytes of a repeated string
    passage: int | None = None  # bytes of the repeated strings that passages are made of; None: the length
    words: int = 50  # least words of a passage
    gram: int = 128  # bytes of an anchor
    sorted_contexts: int = 4000  # distinct contexts that one task sorts; more are told apart by longer q-grams first
    block: int = 32  # windows of one step of the hashed way
    span: int = 1 << 20  # bytes of a text that are hashed at once

    @property
    def levels(self) -> tuple[int, ...]:
        """The lengths of repeats that are looked for, the longest first."""
        return tuple(sorted({self.length, self.passage or self.length}, reverse=True))


_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_LOW = (1 << 21) - 1


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse modulo 2^64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def anchors(text: bytes, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(positions, q-gram hashes) of the minimizers of all windows of a whole text."""
    n, q, least = len(text), settings.gram, settings.levels[-1]
    w = least - q + 1
    at, hashes = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for start in range(0, n - least + 1, settings.span):
        raw = np.frombuffer(text, np.uint8, min(n - start, settings.span + least - 1), start).astype(np.uint64)
        powers, inverse = _powers(settings.span + least)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw + np.uint64(1)) * powers[: len(raw)], dtype=np.uint64)))
        gram = (sums[q:] - sums[:-q]) * inverse[: len(raw) - q + 1]
        gram = (gram ^ (gram >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        gram ^= gram >> np.uint64(29)
        m = len(gram)
        key = (gram & np.uint64(_MASK - _LOW)) | (np.uint64(_LOW) - np.arange(m, dtype=np.uint64))  # of equal ones the last
        padded = np.full(-(-m // w) * w, _MASK, np.uint64)
        padded[:m] = key
        rows = padded.reshape(-1, w)
        ahead = np.minimum.accumulate(rows, 1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
        low = np.minimum(behind[: m - w + 1], ahead[w - 1 : m])
        low = low[np.flatnonzero(np.diff(low, prepend=~low[:1]))]
        local = (np.uint64(_LOW) - (low & np.uint64(_LOW))).astype(np.int64)
        at.append(local + start)
        hashes.append(gram[local])
    positions, first = np.unique(np.concatenate(at), return_index=True)
    return positions, np.concatenate(hashes)[first]


class Extensions:
    """Common extensions of byte strings from their beginning, by binary search over prefix hashes."""

    def __init__(self, strings: list[bytes]):
        self.strings, width = strings, max(map(len, strings), default=0)
        flat = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(len(strings), width)
        sums = np.cumsum((flat + np.uint64(1)) * _powers(width + 1)[0][:width], axis=1, dtype=np.uint64)
        self.prefixes = sums.tolist() if 16 < len(strings) <= 512 else list(sums)  # lists are read faster, but made slower and larger

    def common(self, i: int, j: int) -> int:
        a, b = self.prefixes[i], self.prefixes[j]
        low, high = 0, min(len(self.strings[i]), len(self.strings[j]))
        while low < high:  # the prefix of low bytes is common, that of high + 1 isn't
            mid = (low + high + 1) // 2
            if a[mid - 1] == b[mid - 1]:
                low = mid
            else:
                high = mid - 1
        s, t = self.strings[i], self.strings[j]
        if s[:low] != t[:low]:  # two prefixes of one hash
            low = next(k for k in range(low) if s[k] != t[k])
        return low

    def order(self) -> list[int]:
        """The strings' indices in suffix order; Python's sort is a mergesort."""

        def compare(i: int, j: int) -> int:
            k = self.common(i, j)
            s, t = self.strings[i], self.strings[j]
            return (s[k] - t[k]) if k < len(s) and k < len(t) else len(s) - len(t)

        return sorted(range(len(self.strings)), key=cmp_to_key(compare))


def longest_repeats(contexts: list[bytes], lefts: list[int], lengths: tuple[int, ...]) -> list[list[tuple[int, int]]]:
    """For each length and each distinct context of one anchor, bytes before and from the anchor that its repeats of that
    length or more cover; (0, 0) if none."""
    forward = Extensions([c[n:] for c, n in zip(contexts, lefts, strict=True)])
    backward = Extensions([c[:n][::-1] for c, n in zip(contexts, lefts, strict=True)])
    if len(contexts) == 2:  # nothing to order
        before, after = backward.common(0, 1), forward.common(0, 1)
        return [[(before, after) if before + after >= length else (0, 0)] * 2 for length in lengths]
    ranked = forward.order()
    rank = {i: r for r, i in enumerate(ranked)}
    order = backward.order()
    joins = sorted(((backward.common(a, b), k) for k, (a, b) in enumerate(zip(order, order[1:], strict=False))), reverse=True)
    member = {k: k for k in range(len(order))}  # position in the backward order -> its run, by the run's last holder
    groups: dict[int, list[int]] = {k: [rank[i]] for k, i in enumerate(order)}
    covered = [[(0, 0)] * len(contexts) for _ in lengths]

    def top(k: int) -> int:
        while member[k] != k:
            member[k] = member[member[k]]
            k = member[k]
        return k

    for before, k in joins:
        small, large = sorted((top(k), top(k + 1)), key=lambda g: len(groups[g]))
        into = groups[large]
        for r in groups.pop(small):
            p = bisect_left(into, r)
            for other in into[max(0, p - 1) : p + 1]:
                i, j = ranked[r], ranked[other]
                after = forward.common(i, j)
                for length, held in zip(lengths, covered, strict=True):
                    if before + after >= length:
                        held[i] = max(held[i][0], before), max(held[i][1], after)
                        held[j] = max(held[j][0], before), max(held[j][1], after)
            into.insert(p, r)
        member[small] = large
    return covered


_KEY = "doc_id long, digest long"
_PLACE = _KEY + ", pos long"


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows are told apart by id and text, so rows alike in both get one answer, and null ids are ids like others."""
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(raw, F.isnull("doc_id")).alias("digest"), raw.alias("raw"))


def _by_numpy(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "int": pa.int32()}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in schema.split(", "))])


def _anchor_rows(docs: DataFrame, settings: Settings) -> DataFrame:
    schema = "anchor long, context binary, " + _PLACE + ", before int, after int"
    arrow = _by_numpy(schema)

    def digested(raw: bytes, before: int) -> bytes:
        return hashlib.blake2b(raw, digest_size=16, salt=before.to_bytes(8, "little")).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for doc_id, digest, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(text) < settings.levels[-1]:
                    continue
                at, hashes = anchors(text, settings)
                before = np.minimum(at, settings.length - settings.gram)
                after = np.minimum(settings.length, len(text) - at)
                contexts = [digested(text[a:b], left) for a, b, left in zip((at - before).tolist(), (at + after).tolist(), before.tolist(), strict=True)]
                for col, values in zip(cols, (hashes.view(np.int64).tolist(), contexts, [doc_id] * len(at), [digest] * len(at), at.tolist(), before.tolist(), after.tolist()), strict=True):
                    col += values
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, arrow.types, strict=True)], schema=arrow)

    return docs.mapInArrow(run, schema)


_CONTEXT = "anchor long, " + _PLACE + ", lo int, hi int, once int, crowded int, raw binary"


def _contexts(docs: DataFrame, wanted: DataFrame, settings: Settings) -> DataFrame:
    """The bytes [lo, hi) of the wanted contexts, relative to their anchor."""
    arrow = _by_numpy(_CONTEXT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, digest, text, places in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "digest", "raw", "places")), strict=True):
                for p in places:
                    at, before, after = p["pos"], p["before"], p["after"]
                    rows.append((p["anchor"], doc_id, digest, at, -before, after, int(p["n"] == 1), int(p["distinct"] > settings.sorted_contexts), text[at - before : at + after]))
                    if len(rows) > 20_000:
                        yield _batch(rows, arrow)
                        rows = []
            yield _batch(rows, arrow)

    places = wanted.groupBy("doc_id", "digest").agg(F.collect_list(F.struct("anchor", "pos", "before", "after", "n", "distinct")).alias("places"))
    d, p = docs.alias("d"), places.alias("p")
    joined = d.join(p, F.col("d.digest").eqNullSafe(F.col("p.digest")) & F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")))
    return joined.select("d.doc_id", "d.digest", "d.raw", "p.places").mapInArrow(run, _CONTEXT)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)


def _sorted_repeats(rows: DataFrame, settings: Settings, tasks: int) -> DataFrame:
    """Repeats among the contexts of each anchor, which ``sorted_contexts`` bounds in number and the length in size."""
    schema = _KEY + ", start long, stop long, level int"
    arrow = _by_numpy(schema)

    def solve(group: list[tuple]) -> Iterator[tuple]:
        if len(group) < 2:
            return
        found = longest_repeats([g[5] for g in group], [-g[3] for g in group], settings.levels)
        for level, covered in zip(settings.levels, found, strict=True):
            for (doc_id, digest, pos, _, once, _), (before, after) in zip(group, covered, strict=True):
                if once and before + after:
                    yield doc_id, digest, pos - before, pos + after, level

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: int | None = None
        group: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for anchor, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if anchor != held:
                    out += solve(group)
                    held, group = anchor, []
                group.append(tuple(rest))
            yield _batch(out, arrow)
        yield _batch(list(solve(group)), arrow)

    dealt = rows.select("anchor", "doc_id", "digest", "pos", "lo", "once", "raw").repartition(tasks, "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, schema)


def _held_twice(rows: DataFrame, key: list[str], label: str) -> DataFrame:
    """The rows whose key another row has too. The counts are written first, so that the join sees two plain sides and
    Spark can split a key that many rows have."""
    twice = stored(rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n"), label)
    return rows.join(twice, key)


def _told_apart(crowded: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(contexts in groups that one task can sort, the others once each) of contexts whose anchors have too many.

    The q-gram is made longer to the left and to the right by half of what a repeat has beyond it. Only contexts that share
    one of the two with another go on, in that group.
    """
    more = -(-(settings.levels[-1] - settings.gram) // 2)
    side = F.explode(F.array(F.struct(F.lit(-more).alias("l"), F.lit(settings.gram).alias("r")), F.struct(F.lit(0).alias("l"), F.lit(settings.gram + more).alias("r"))))
    longer = crowded.withColumn("side", side).where("side.l >= lo AND side.r <= hi")
    gram = F.substring("raw", F.col("side.l") - F.col("lo") + 1, F.col("side.r") - F.col("side.l"))
    longer = longer.withColumn("group", F.sha2(F.concat(F.concat_ws(":", "anchor", "side.l", F.lit("")).cast("binary"), gram), 256)).drop("side")
    held = stored(longer.join(_counted(longer.select("group"), "groups"), "group"), "told-apart")
    small = held.where(F.col("n") <= settings.sorted_contexts).withColumn("anchor", F.xxhash64("group")).drop("group", "n")
    many = held.where(F.col("n") > settings.sorted_contexts).drop("group", "n").dropDuplicates(["anchor", "doc_id", "digest", "pos"])
    return small, stored(many, "many")


_HALVES = "anchor long, " + _PLACE + ", once int, ahead binary, behind binary"


def _common(a: bytes, b: bytes) -> int:
    """Bytes that two strings share from their beginning."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _backwards(raw: Column) -> Column:
    """The bytes in reverse; this code page has a character for each byte."""
    return F.encode(F.reverse(F.decode(raw, "ISO-8859-1")), "ISO-8859-1")


def _halves(contexts: DataFrame) -> DataFrame:
    """The contexts' bytes from the anchor, and those before it from the anchor backwards."""
    ahead = F.substring("raw", 1 - F.col("lo"), F.col("hi")).alias("ahead")
    return contexts.select("anchor", "doc_id", "digest", "pos", "once", ahead, _backwards(F.substring("raw", F.lit(1), -F.col("lo"))).alias("behind"))


def _whole(halves: DataFrame) -> DataFrame:
    """Contexts again, of their two halves."""
    ends = halves.withColumn("lo", -F.length("behind")).withColumn("hi", F.length("ahead"))
    return ends.withColumn("raw", F.concat(_backwards(F.col("behind")), "ahead")).drop("ahead", "behind")


def _chunks(halves: DataFrame, side: str, settings: Settings, tasks: int) -> DataFrame:
    """The contexts, with the number of their chunk: ``sorted_contexts`` of them in suffix order of one side, across
    all tasks, so that no chunk depends on how many tasks there are."""
    order = ["anchor", side, *({"ahead", "behind"} - {side}), "doc_id", "digest", "pos"]
    placed = halves.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = stored(placed.withColumn("part", F.shiftright("place", 33)).withColumn("place", F.col("place").bitwiseAND((1 << 33) - 1)), "in-order")
    sizes = sorted((r["part"], r["count"]) for r in placed.groupBy("part").count().collect())
    firsts = list(zip([p for p, _ in sizes], accumulate((n for _, n in sizes), initial=0), strict=False))
    met = placed.join(F.broadcast(placed.sparkSession.createDataFrame(firsts, "part long, first long")), "part")
    return met.withColumn("chunk", F.floor((F.col("first") + F.col("place")) / settings.sorted_contexts)).drop("part", "place", "first")


def _cut_to_chunks(chunks: DataFrame, side: str) -> DataFrame:
    """One side of each context cut to the longest beginning that a context of its anchor in another chunk has too.

    In suffix order that is the last one before the chunk or the first one after it. Anchors of one chunk are done with.
    """
    arrow, at = _by_numpy(_HALVES), [part.split()[0] for part in _HALVES.split(", ")].index(side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for *row, prior, following in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row[at] = row[at][: max(_common(row[at], other) for other in (prior, following) if other is not None)]
                out.append(tuple(row))
            yield _batch(out, arrow)

    key = ["anchor", "chunk"]
    ends = chunks.groupBy(key).agg(F.min(side).alias("low"), F.max(side).alias("high"))
    order = Window.partitionBy("anchor").orderBy("chunk")
    ends = ends.select(*key, F.lag("high").over(order).alias("prior"), F.lead("low").over(order).alias("following"))
    ends = stored(ends.where("prior IS NOT NULL OR following IS NOT NULL"), "ends")
    return chunks.join(ends, key).drop("chunk").mapInArrow(run, _HALVES)


def _by_chunks(many: DataFrame, settings: Settings, tasks: int, turn: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(contexts in chunks that one task can sort, repeats, contexts that are left) of contexts in groups that it can't.

    Two contexts of one chunk meet there. Those of different chunks share no more on that side than one of them does with
    its chunk's surroundings, so each is cut to that: first ahead, then what is left of it behind. Contexts that are equal
    then are repeats as they stand and can't have longer ones; one of each kind is left.
    """
    rows, sorted_apart = _halves(many), []
    for side in ("ahead", "behind"):
        chunks = _chunks(rows, side, settings, tasks)
        sorted_apart.append(_whole(chunks).withColumn("anchor", F.xxhash64("anchor", "chunk", F.lit(side), F.lit(turn))).drop("chunk"))
        rows = _cut_to_chunks(chunks, side).where(F.length("ahead") + F.length("behind") >= settings.levels[-1])
        rows = stored(rows, "cut")
    cut = _whole(rows)
    live = stored(cut.withColumn("whole", F.sha2(F.concat(F.col("lo").cast("string").cast("binary"), F.lit(b":"), F.col("raw")), 256)), "trimmed")
    key = ["anchor", "whole"]
    kinds = stored(live.groupBy(key).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "digest", "pos", "lo", "hi", "once", "raw")).alias("one")), "trimmed-kinds")
    level = F.when(F.col("hi") - F.col("lo") >= settings.length, settings.length).otherwise(settings.levels[-1]).alias("level")
    equal = live.where("once = 1").join(kinds.where("n > 1").select(key), key)
    found = equal.select("doc_id", "digest", (F.col("pos") + F.col("lo")).alias("start"), (F.col("pos") + F.col("hi")).alias("stop"), level)
    left = kinds.select("anchor", "n", "one.*").withColumn("once", F.when(F.col("n") > 1, 0).otherwise(F.col("once"))).drop("n")
    return sorted_apart[0].unionByName(sorted_apart[1]), found, left


def _blocks(contexts: DataFrame, settings: Settings) -> DataFrame:
    """Blocks of windows of the contexts, at each level."""
    levels = contexts.withColumn("level", F.explode(F.array(*map(F.lit, settings.levels)))).where(F.col("hi") - F.col("lo") >= F.col("level"))
    begin, last = F.floor(F.col("lo") / settings.block) * settings.block, F.col("hi") - F.col("level")
    blocks = levels.withColumn("at", F.explode(F.sequence(begin, last.cast("long"), F.lit(settings.block).cast("long"))))
    blocks = blocks.withColumn("a", F.greatest("at", "lo").cast("int")).withColumn("b", F.least(F.col("at") + settings.block, last + 1).cast("int"))
    raw = F.substring("raw", F.col("a") - F.col("lo") + 1, F.col("b") - 1 + F.col("level") - F.col("a"))
    return blocks.select("anchor", "level", "doc_id", "digest", "pos", F.col("a").alias("lo"), F.col("b").alias("hi"), "once", raw.alias("raw"))


def _counted(keys: DataFrame, label: str) -> DataFrame:
    """The keys that more than one row has, and how many rows (n)."""
    return stored(keys.groupBy(*keys.columns).agg(F.count("*").alias("n")).where("n > 1"), label)


def _hashed_repeats(blocks: DataFrame, settings: Settings) -> list[DataFrame]:
    """Repeats of the contexts of anchors with too many of them, by hashes of blocks of windows.

    Blocks whose core, the bytes that all their windows hold, is held once are done with; equal blocks are repeats as
    they stand; one of each kind is cut into smaller blocks, down to single windows.
    """
    rows, size, out = blocks.select("anchor", "level", "doc_id", "digest", "pos", "lo", "hi", "once", "raw"), settings.block, []
    while True:
        step = (F.floor(F.col("lo") / size) * size).cast("int")
        rows = rows.withColumn("step", step).withColumn("core", F.sha2(F.substring("raw", F.col("step") + size - F.col("lo"), F.col("level") - size + 1), 256))
        live = stored(_held_twice(rows, ["anchor", "level", "step", "core"], "cores").drop("core").withColumn("whole", F.sha2(F.concat(F.col("lo").cast("string").cast("binary"), F.lit(b":"), F.col("raw")), 256)), "blocks")
        span = [(F.col("pos") + F.col("lo")).alias("start"), (F.col("pos") + F.col("hi") - 1 + F.col("level")).alias("stop"), "level"]
        if size == 1:  # a core is a window now
            out.append(live.where("once = 1").select("doc_id", "digest", *span))
            return out
        key = ["anchor", "level", "step", "whole"]
        kinds = stored(live.groupBy(key).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "digest", "pos", "lo", "hi", "once", "raw")).alias("one")), "kinds")
        out.append(live.where("once = 1").join(kinds.where("n > 1").select(key), key).select("doc_id", "digest", *span))
        size = max(1, size // 4)
        cut = kinds.select("anchor", "level", "n", "one.*").withColumn("at", F.explode(F.sequence(F.floor(F.col("lo") / size) * size, F.col("hi") - 1, F.lit(size).cast("long"))))
        cut = cut.withColumn("first", F.greatest("at", "lo").cast("int")).withColumn("end", F.least(F.col("at") + size, "hi").cast("int"))
        raw = F.substring("raw", F.col("first") - F.col("lo") + 1, F.col("end") - F.col("first") - 1 + F.col("level"))
        rows = cut.select("anchor", "level", "doc_id", "digest", "pos", F.col("first").alias("lo"), F.col("end").alias("hi"), F.when(F.col("n") > 1, 0).otherwise(F.col("once")).alias("once"), raw.alias("raw"))


def repeats(keyed: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, digest, start, stop, level): stretches of each text that strings of ``level`` bytes which start anywhere
    else too cover. They may overlap, and what a longer level covers stands for the shorter one as well."""
    spark = keyed.sparkSession
    tasks = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    every = stored(_anchor_rows(keyed, settings), "anchors")
    shared = stored(_held_twice(every, ["anchor"], "twice"), "shared")
    dropped(every)
    classes = stored(shared.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "digest", "pos", "before", "after")).alias("one")), "classes")
    released(spark)
    copied = shared.join(classes.where("n > 1").select("anchor", "context"), ["anchor", "context"])
    parts = [copied.select("doc_id", "digest", (F.col("pos") - F.col("before")).alias("start"), (F.col("pos") + F.col("after")).alias("stop"), F.when(F.col("before") + F.col("after") >= settings.length, settings.length).otherwise(settings.levels[-1]).alias("level"))]
    several = stored(classes.groupBy("anchor").agg(F.count("*").alias("distinct")).where(F.col("distinct") > 1), "several")
    wanted = classes.join(several, "anchor").select("anchor", "one.*", "n", "distinct")
    rows = stored(_contexts(keyed, wanted, settings), "contexts")
    released(spark)
    sortable, crowded = rows.where("crowded = 0").drop("crowded"), rows.where("crowded = 1").drop("crowded")
    if not crowded.isEmpty():
        small, many = _told_apart(crowded, settings)
        sortable, turn, n = sortable.unionByName(small), 0, many.count()
        while n:
            chunks, found, left = _by_chunks(many, settings, tasks, turn)
            parts.append(found)
            held = stored(left.join(_counted(left.select("anchor"), "left"), "anchor"), "held")
            small, many = (held.where(which).drop("n") for which in (F.col("n") <= settings.sorted_contexts, F.col("n") > settings.sorted_contexts))
            sortable = sortable.unionByName(chunks).unionByName(small)
            before, n, turn = n, many.count(), turn + 1
            if 2 * n > before:  # too many kinds for chunks to get much further
                parts += _hashed_repeats(_blocks(many, settings), settings)
                break
    parts.append(_sorted_repeats(sortable, settings, tasks))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def runs(spans: list[dict] | None, least: int) -> list[tuple[int, int]]:
    """The maximal runs (start, stop) that spans of ``least`` bytes' repeats or longer ones' cover."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted((s["start"], s["stop"]) for s in spans or () if s["level"] >= least):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], stop)
        else:
            out.append((start, stop))
    return out


def passages(text: bytes, spans: list[dict] | None, settings: Settings) -> list[tuple[int, int]]:
    """The maximal runs at the passages' length that hold words enough."""
    return [(a, b) for a, b in runs(spans, settings.levels[-1]) if len(text[a:b].split()) >= settings.words]


def without(text: bytes, gone: list[tuple[int, int]]) -> bytes:
    """What is left of a text without disjoint runs in order."""
    ends = [0, *(b for _, b in gone)]
    return b"".join(text[a:b] for a, b in zip(ends, [*(a for a, _ in gone), len(text)], strict=True))


def _with_spans(docs: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    keyed = _keyed(docs)
    spans = stored(repeats(keyed, settings).groupBy("doc_id", "digest").agg(F.collect_set(F.struct("start", "stop", "level")).alias("spans")), "spans")
    released(docs.sparkSession)
    return keyed, spans


def _on_key(a: str, b: str):
    return F.col(f"{a}.digest").eqNullSafe(F.col(f"{b}.digest")) & F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id"))


def suffix_dedup(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages) for every row of ``docs``.

    The first five columns judge strings of ``length`` bytes; ``n_passages`` counts the maximal runs of the passages'
    length that hold ``words`` words or more, however short in bytes.

    Texts are UTF-8 bytes; a null counts as empty, and texts shorter than the length lose nothing. Strings are judged on
    the input, within one text or across texts, and overlaps count. Repeated rows are each other's repeats, so both
    lose all; a null doc_id stays null; an empty table gives no rows; other columns are never looked at. Very long
    texts are hashed a span at a time.
    """
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long"
    keyed, spans = _with_spans(docs, settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in schema.split(", ")]
        for batch in batches:
            rows = []
            for doc_id, text, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                gone = runs(found, settings.length)
                kept = without(text, gone)
                rows.append((doc_id, len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), len(passages(text, found, settings))))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            types = [*[pa.int64()] * 4, pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names)

    return keyed.alias("k").join(spans.alias("s"), _on_key("k", "s"), "left").select("k.doc_id", "k.raw", "s.spans").mapInArrow(run, schema)


def without_passages(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs``, all columns, without the bytes of repeated passages in ``text`` and with ``n_chars``, if there,
    counted anew.

    A passage is a maximal run of strings of the passages' length that start anywhere else too, of ``words`` words or
    more (0: every run). A character that a cut leaves in part goes with it; null texts stay null; an empty table gives
    no rows; repeated rows lose the same.
    """
    _, spans = _with_spans(docs, settings)

    @F.pandas_udf("string")
    def cut(raw, found):
        import pandas as pd

        def one(text: bytes, spans) -> str:
            return without(text, passages(text, list(spans), settings)).decode("utf-8", "ignore")

        return pd.Series([one(bytes(t), s) for t, s in zip(raw, found, strict=True)])

    spans = spans.select(F.col("doc_id").alias("_span_id"), F.col("digest").alias("_span_digest"), F.col("spans").alias("_spans"))
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    on = F.xxhash64(raw, F.isnull("doc_id")).eqNullSafe(F.col("_span_digest")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_span_id"))
    met = docs.join(spans, on, "left")
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(cut(F.coalesce(F.col("text").cast("binary"), F.lit(b"")), F.coalesce("_spans", F.expr("cast(array() as array<struct<start:bigint,stop:bigint,level:int>>)"))))
    out = met.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)

"""Counts of n-grams by cluster, straight from texts: whole arrays of words at a time, nothing leaves a task unsummed.

Notes are (note_idx, cluster_id, title, body), a row a note; a cluster_id below 0 counts in document frequencies only.
The rules are those of ``tfidf.corpus_ngrams`` and ``text.tokenize``.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions import text, words

CHUNK_BYTES = 4_000_000
#: Sums of hashed n-grams that a task holds, over all clusters.
SLOTS = 1 << 21
#: Characters of bodies for each bucket of n-grams.
BUCKET_CHARS = 4_000_000
_LETTER, _APOSTROPHE, _SEGMENT = 1, 2, 3
_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = _LETTER
_CLASS[ord("'")] = _APOSTROPHE
_CLASS[[ord(c) for c in ".,?!;:\n\r-*#()[]"]] = _SEGMENT


def _cleaned(s: str) -> str:
    """``text.clean_text`` of each segment; links and addresses hold characters that part segments."""
    parts = re.split(text.SEGMENT, s)
    for pattern in (r"```[\s\S]*?```", r"`[^`]*`", r"<[^>]*>"):
        parts = [re.sub(pattern, " ", p) for p in parts]
    return "\n".join(parts)


def _singular(w: str) -> str:
    if len(w) <= 3 or w in words.SINGULAR_EXCEPTIONS or w.endswith("ss"):
        return w
    if w.endswith("ies"):
        return w[:-3] + "y"
    if re.search("(?:ss|ch|sh|x|z)es$", w):
        return w[:-2]
    return w[:-1] if w.endswith("es") or (w.endswith("s") and w[-2] not in "uia") else w


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of texts without nulls."""
    n = len(column)
    if not n or column.buffers()[2] is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]], off - off[0]


def _tokens(column: pa.Array, stop: frozenset[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(row, segment, word) of each token of texts in lower case, and the words, sorted."""
    data, off = _bytes(column)
    marked = np.unique(np.searchsorted(off, np.flatnonzero((data == ord("`")) | (data == ord("<"))), "right") - 1)
    if len(marked):
        texts = column.to_pylist()
        for k in marked.tolist():
            texts[k] = _cleaned(texts[k])
        data, off = _bytes(pa.array(texts, pa.string()))
    kind = _CLASS[data]
    for k in range(3 if len(data) > 2 else 0):  # the three bytes of a typographic apostrophe
        at = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80) & (data[2:] == 0x99)) if not k else at
        kind[at + k] = _APOSTROPHE
    kept = kind != _APOSTROPHE
    if not kept.all():
        off = np.concatenate(([0], np.cumsum(kept)))[off]
        data, kind = data[kept], kind[kept]
    letter = kind == _LETTER
    before = np.concatenate(([False], letter[:-1]))[: len(letter)]
    before[off[:-1][off[:-1] < len(letter)]] = False
    starts = np.flatnonzero(letter & ~before)
    if not len(starts):
        return *(np.empty(0, np.int64) for _ in range(3)), []
    ends = np.concatenate((np.cumsum(letter)[starts] - 1, [letter.sum()])).astype(np.int32)
    coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[letter]))).dictionary_encode()
    single = [_singular(w) for w in coded.dictionary.to_pylist()]
    known = sorted({w for w in single if len(w) >= 3 and w not in stop})
    place = {w: k for k, w in enumerate(known)}
    ids = np.array([place.get(w, -1) for w in single], np.int64)[coded.indices.to_numpy()]
    kept = ids >= 0
    starts = starts[kept]
    return np.searchsorted(off, starts, "right") - 1, np.cumsum(kind == _SEGMENT)[starts], ids[kept], known


class Groups:
    """Counts of one chunk by (n-gram, cluster), sorted by n-gram."""

    def __init__(self, chunk: pa.RecordBatch, longest: int, apart: bool, title_weight: int):
        order = pc.sort_indices(chunk, [("cluster_id", "ascending"), ("note_idx", "ascending")])
        chunk = chunk.take(order)
        n, width = chunk.num_rows, 3 if apart else 2
        texts = pa.concat_arrays([chunk.column(k) for k in range(2, 2 + width)]).take(pa.array(np.arange(width * n).reshape(width, n).T.ravel()))
        row, seg, word, self.words = _tokens(texts, frozenset(words.stop_words()))
        note, part = row // width, row % width
        ordinal = np.arange(len(row)) - np.searchsorted(note, note)
        bits = 21
        if len(self.words) >= 1 << bits:
            raise ValueError(f"a chunk of {len(self.words)} different words; make CHUNK_BYTES smaller")
        same = (row[1:] == row[:-1]) & (seg[1:] == seg[:-1])
        two = np.flatnonzero(same & (word[1:] != word[:-1]))
        three = np.intersect1d(two, two - 1, assume_unique=True)
        three = three[(part[three] == 0) | ((part[three] == 1) & (longest >= 3))]
        w = word + 1
        at = np.concatenate((np.arange(len(row)), two, three))
        size = np.repeat([1, 2, 3], [len(row), len(two), len(three)])
        key = np.concatenate((w << 2 * bits, (w[two] << 2 * bits) | (w[two + 1] << bits), (w[three] << 2 * bits) | (w[three + 1] << bits) | w[three + 2]))
        order = np.argsort(key, kind="stable")
        key, at, size = key[order], at[order], size[order]
        note, part, ordinal = note[at], part[at], ordinal[at]
        ids = chunk.column(0).to_numpy()
        cluster = chunk.column(1).to_numpy()[note]
        if not len(key):
            self.key = self.cluster = self.tf = self.docs = self.cut_docs = self.in_title = self.first_note = self.first_pos = self.slot_words = np.empty(0, np.int64)
            return
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (cluster[1:] != cluster[:-1])))
        starts = np.flatnonzero(new)
        each = np.flatnonzero(new | np.concatenate(([True], note[1:] != note[:-1])))
        whole = part < 2  # a part 2 is a body's beginning, which gives document frequencies only
        if apart:
            long = np.asarray(pc.is_valid(chunk.column(4)))[note]
            cut = (part == 0) | (part == 2) | (~long & (size <= 2))
        else:
            cut = whole
        group = np.searchsorted(each, starts)
        self.key, self.cluster = key[starts], cluster[starts].astype(np.int64)
        self.tf = np.add.reduceat(np.where(whole, np.where(part == 0, title_weight, 1), 0), starts)
        self.docs = np.add.reduceat(np.maximum.reduceat(whole.astype(np.int64), each), group)
        self.cut_docs = np.add.reduceat(np.maximum.reduceat(cut.astype(np.int64), each), group)
        self.in_title = np.maximum.reduceat(part == 0, starts)
        first = np.minimum(np.minimum.reduceat(np.where(whole, np.arange(len(key)), len(key)), starts), len(key) - 1)
        self.first_note, self.first_pos = ids[note[first]], ordinal[first] * 4 + size[first]

    def _parts(self) -> list[np.ndarray]:
        return [(self.key >> s) & ((1 << 21) - 1) for s in (42, 21, 0)]

    def hashes(self) -> np.ndarray:
        """A number of each n-gram that is the same in every chunk."""
        of = np.array([0, *(zlib.crc32(w.encode()) + 1 for w in self.words)], np.uint64)
        out = np.zeros(len(self.key), np.uint64)
        for p in self._parts():
            out = (out ^ of[p]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out

    def ngrams(self, at: np.ndarray) -> pa.Array:
        known = pa.array(["", *self.words], pa.string())
        a, b, c = (p[at] for p in self._parts())
        out = known.take(pa.array(a))
        for p in (b, c):
            tail = known.take(pa.array(p))
            out = pc.if_else(pa.array(p > 0), pc.binary_join_element_wise(out, tail, " "), out)
        return out

    def rows(self, at: np.ndarray) -> pa.RecordBatch:
        numbers = [pa.array(a[at], t) for a, t in ((self.cluster, pa.int32()), (self.tf, pa.int64()), (self.docs, pa.int64()), (self.cut_docs, pa.int64()), (self.in_title.astype(bool), pa.bool_()), (self.first_note, pa.int64()), (self.first_pos, pa.int64()))]
        return pa.RecordBatch.from_arrays([self.ngrams(at), *numbers], _COLUMNS)


_COLUMNS = ["ngram", "cluster_id", "tf", "n_docs", "cut_docs", "in_title", "first_note", "first_pos"]
SCHEMA = "ngram string, cluster_id int, tf long, n_docs long, cut_docs long, in_title boolean, first_note long, first_pos long"


def prepared(notes: DataFrame, body_chars: int | None, apart: int | None = None) -> DataFrame:
    """Notes for ``chunks``: texts in lower case; ``apart`` adds the beginning of longer bodies as a column of its own."""
    body = F.coalesce("body", F.lit(""))
    cut = [] if apart is None else [F.when(F.length(body) > apart, F.lower(F.substring(body, 1, apart))).alias("cut")]
    if body_chars is not None:
        body = F.substring(body, 1, body_chars)
    cluster = F.coalesce(F.col("cluster_id").cast("int"), F.lit(-1))
    return notes.select(F.col("note_idx").cast("long").alias("note_idx"), F.greatest(cluster, F.lit(-1)).alias("cluster_id"), F.lower(F.coalesce("title", F.lit(""))).alias("title"), F.lower(body).alias("body"), *cut)


def chunks(batches: Iterator[pa.RecordBatch], longest: int, apart: bool, title_weight: int) -> Iterator[Groups]:
    """``Groups`` of every ``CHUNK_BYTES`` of text."""
    held, size = [], 0

    def made() -> Groups:
        return Groups(pa.Table.from_batches(held).combine_chunks().to_batches()[0], longest, apart, title_weight)

    for batch in batches:
        for k in range(0, batch.num_rows, 200):
            piece = batch.slice(k, 200)
            held.append(piece)
            size += sum(int(pc.sum(pc.binary_length(piece.column(c))).as_py() or 0) for c in range(2, piece.num_columns))
            if size >= CHUNK_BYTES:
                yield made()
                held, size = [], 0
    if held:
        yield made()


def most_frequent(notes: DataFrame, body_chars: int | None, kept: int, title_weight: int) -> tuple[DataFrame, DataFrame]:
    """(counts, clusters): (cluster_id, ngram, tf, n_docs, in_title, first) of every n-gram that may be among the ``kept``
    most frequent of any cluster, in all clusters; and (cluster_id, total, many) with the sum of all tf.

    The first pass over the texts adds up hashed n-grams by cluster, which bounds each count from above, and the counts of
    each task's most frequent, which bound the one at place ``kept`` from below. The second counts what reaches that bound.
    """
    spark, ready = notes.sparkSession, prepared(notes, body_chars)
    n_clusters = max(1, ready.select("cluster_id").distinct().count())
    slots = max(256, min(1 << 16, 1 << int(np.log2(max(SLOTS // n_clusters, 1)))))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        tops: dict[int, Counter] = {}
        for g in chunks(batches, 2, False, title_weight):
            slot = (g.hashes() % np.uint64(slots)).astype(np.int64)
            order = np.lexsort((-g.tf, g.cluster))
            cluster = g.cluster[order]
            for c in np.unique(cluster).tolist():
                lo, hi = np.searchsorted(cluster, [c, c + 1])
                mine = order[lo:hi]
                sums[c] = sums.get(c, 0) + np.bincount(slot[mine], g.tf[mine], slots).astype(np.int64)
                best = mine[: kept + 1]
                top = tops.setdefault(c, Counter())
                for w, n in zip(g.ngrams(best).to_pylist(), g.tf[best].tolist(), strict=True):
                    top[w] += n
        for c, found in sums.items():
            best = tops[c].most_common(4 * kept + 1)
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([zlib.compress(found.tobytes(), 1)]), pa.array([[w for w, _ in best]], pa.list_(pa.string())), pa.array([[n for _, n in best]], pa.list_(pa.int64()))], ["cluster_id", "sums", "best", "counts"])

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        tops: dict[int, Counter] = {}
        for batch in batches:
            for c, found, best, counts in zip(*(batch.column(k) for k in range(4)), strict=True):
                c, top = c.as_py(), tops.setdefault(c.as_py(), Counter())
                sums[c] = sums.get(c, 0) + np.frombuffer(zlib.decompress(found.as_py()), np.int64)
                for w, n in zip(best.as_py(), counts.as_py(), strict=True):
                    top[w] += n
        for c, found in sums.items():
            many = len(tops[c]) > kept
            least = tops[c].most_common(kept)[-1][1] if many else 1
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([int(found.sum())]), pa.array([many]), pa.array([np.packbits(found >= least).tobytes()])], ["cluster_id", "total", "many", "hot"])

    dealt = ready.mapInArrow(add, "cluster_id int, sums binary, best array<string>, counts array<long>").repartition(spark.sparkContext.defaultParallelism, "cluster_id")
    met = dealt.mapInArrow(bound, "cluster_id int, total long, many boolean, hot binary").collect()  # a row a cluster
    hot = np.zeros(slots, bool)
    for r in met:
        if r["cluster_id"] >= 0:
            hot |= np.unpackbits(np.frombuffer(r["hot"], np.uint8), count=slots).astype(bool)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in chunks(batches, 2, False, title_weight):
            yield g.rows(np.flatnonzero(hot[(g.hashes() % np.uint64(slots)).astype(np.int64)]))

    first = F.min(F.struct("first_note", "first_pos"))
    counts = ready.mapInArrow(count, SCHEMA).groupBy("cluster_id", "ngram").agg(F.sum("tf").alias("tf"), F.sum("n_docs").alias("n_docs"), F.max("in_title").alias("in_title"), first.alias("first"))
    clusters = spark.createDataFrame([(r["cluster_id"], r["total"], r["many"]) for r in met if r["cluster_id"] >= 0], "cluster_id int, total long, many boolean")
    return counts, clusters


def totals(notes: DataFrame, longest: int, title_weight: int) -> DataFrame:
    """(cluster_id, total): the sum of all tf of whole texts' n-grams; no n-gram is made up for it."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()
        stop = frozenset(words.stop_words())
        for batch in batches:
            for k in range(0, batch.num_rows, 400):
                piece = batch.slice(k, 400)
                cluster = piece.column(1).to_numpy()
                for column, weight, most in ((2, title_weight, 3), (3, 1, longest)):
                    row, seg, word, _ = _tokens(pa.concat_arrays([piece.column(column)]), stop)
                    fits = (row[1:] == row[:-1]) & (seg[1:] == seg[:-1]) & (word[1:] != word[:-1])
                    n = np.bincount(row, minlength=len(cluster)) + np.bincount(row[:-1][fits], minlength=len(cluster))
                    if most >= 3:
                        n += np.bincount(row[:-2][fits[1:] & fits[:-1]], minlength=len(cluster))
                    for c in np.unique(cluster).tolist():
                        sums[c] += weight * int(n[cluster == c].sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.int64())], ["cluster_id", "total"])

    found = prepared(notes, None).mapInArrow(add, "cluster_id int, total long")
    return found.where("cluster_id >= 0").groupBy("cluster_id").agg(F.sum("total").alias("total"))


def every(notes: DataFrame, longest: int, cut_chars: int, title_weight: int) -> DataFrame:
    """(cluster_id, ngram, tf, n_docs, in_title, first_note, first_pos, df) of every n-gram of whole texts in a cluster; df is
    the number of notes that hold it in their title or their body's first ``cut_chars``.

    Each chunk's counts go to their bucket of n-grams as one compressed block, and a bucket's blocks are added up in one
    task, a bucket at a time.
    """
    spark = notes.sparkSession
    ready = prepared(notes, None, cut_chars)
    chars = notes.agg(F.sum(F.length("body")).alias("n")).first()["n"] or 0
    buckets = max(spark.sparkContext.defaultParallelism, -(-chars // BUCKET_CHARS))
    schema = pa.schema(list(zip(_COLUMNS, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()), strict=True)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = pa.ipc.IpcWriteOptions(compression="zstd")
        for g in chunks(batches, longest, True, title_weight):
            bucket = (g.hashes() % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for k in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, schema, options=packed) as out:
                    out.write_batch(pa.RecordBatch.from_arrays(g.rows(order[edges[k] : edges[k + 1]]).columns, schema=schema))
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["bucket", "block"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for k, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if k != now and held:
                    yield from summed(pa.concat_tables(held))
                    held = []
                now = k
                held.append(pa.ipc.open_stream(block.as_buffer()).read_all())
        if held:
            yield from summed(pa.concat_tables(held))

    def summed(t: pa.Table) -> Iterator[pa.RecordBatch]:
        coded = t["ngram"].combine_chunks().dictionary_encode()
        code, (cluster, tf, docs, cut, title, note, pos) = coded.indices.to_numpy(), (t[c].to_numpy() for c in _COLUMNS[1:])
        df = np.bincount(code, cut).astype(np.int64)
        order = np.lexsort((pos, note, tf == 0, cluster, code))
        a, c = code[order], cluster[order]
        starts = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (c[1:] != c[:-1]))))
        at = order[starts]
        cols = [cluster[at], None, np.add.reduceat(tf[order], starts), np.add.reduceat(docs[order], starts), np.maximum.reduceat(title[order], starts), note[at], pos[at], df[code[at]]]
        kept = np.flatnonzero((cols[0] >= 0) & (cols[2] > 0) & (cols[7] > 0))
        for k in range(0, len(kept), 20_000):
            some = kept[k : k + 20_000]
            out = [coded.dictionary.take(pa.array(code[at[some]])) if x is None else pa.array(x[some]) for x in cols]
            yield pa.RecordBatch.from_arrays(out, ["cluster_id", "ngram", "tf", "n_docs", "in_title", "first_note", "first_pos", "df"])

    dealt = ready.mapInArrow(deal, "bucket int, block binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(add_up, "cluster_id int, ngram string, tf long, n_docs long, in_title boolean, first_note long, first_pos long, df long")

"""Best-fit packing: token runs of documents placed in sequences by bounded-space online best-fit.

Method: each task keeps at most ``max_open`` open bins. A bitset has bit *f* set while some open bin has *f* free
tokens, so the best fit for a piece of length *n* is the lowest set bit at or above *n*. A piece that fits nowhere
opens a bin; if that makes one bin too many, the fullest open bin closes.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 1024
END_ID = 2
#: Open bins a task keeps. Their number, not the input's size, bounds the packer's memory.
MAX_OPEN = 1024
#: Entries after which a worker's chunk cache starts anew; a bound on memory that changes no result.
CACHE_ENTRIES = 300_000
#: Texts that are cut into chunks at once.
ENCODED_TEXTS = 256
#: White space other than the single spaces and line feeds that the chunk cache understands, and scripts beyond Latin.
_ODD = re.compile(r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u0250-\U0010ffff]")

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    The vocabulary's pre-tokeniser never joins a token across a space that stands between two non-space characters,
    so a text is cut there and each chunk's ids are looked up. New chunks are encoded together, by the same
    vocabulary in its rank form where that lies beside it; texts with other white space, scripts that the two
    libraries' Unicode tables might see differently, or a special token's string are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache: dict[str, bytes] = {}
        self.ranked = None
        ranks_path = Path(path).with_suffix(".tiktoken")
        if ranks_path.exists():
            import public_tokenizers
            import tiktoken

            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks_path.read_bytes().splitlines())}
            self.ranked = tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.spaced = np.zeros(max(ranks.values()) + 1, bool)
            self.spaced[[rank for token, rank in ranks.items() if token[:1] == b" "]] = True

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def chunks(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of each chunk; one that begins with its only space can be encoded in one text with others like it."""
        joined = [c for c in chunks if c[:1] == " "] if self.ranked else []
        rest = list(set(chunks).difference(joined))
        found = dict(zip(rest, self.whole(rest), strict=True))
        if joined:
            ids = self.ranked.encode_to_numpy("".join(joined), allowed_special=set(), disallowed_special=()).astype("<u4")
            ends = np.append(np.flatnonzero(self.spaced[ids]), len(ids))[1:]
            raw, begin = ids.tobytes(), 0
            for chunk, end in zip(joined, (4 * ends).tolist(), strict=True):
                found[chunk] = raw[begin:end]
                begin = end
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        cache = self.cache
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        chunked: list[list[str]] = []
        ids: list[list[bytes | None] | None] = []
        new: set[str] = set()
        for text in texts:
            odd = "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or "\0" in text or any(s in text for s in self.specials) or _ODD.search(text)
            chunked.append([] if odd else text.replace(" ", "\0 ").split("\0"))
            ids.append(None if odd else list(map(cache.get, chunked[-1])))
            if not odd and None in ids[-1]:
                new.update([c for c, found in zip(chunked[-1], ids[-1], strict=True) if found is None])
        fresh = self.chunks(list(new))
        cache.update(fresh)
        odd_ids = iter(self.whole([t for t, known in zip(texts, ids, strict=True) if known is None]))
        out = []
        for cs, known in zip(chunked, ids, strict=True):
            if known is None:
                out.append(next(odd_ids))
            else:
                out.append(b"".join([fresh[c] if k is None else k for c, k in zip(cs, known, strict=True)] if None in known else known))
        return out


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full pieces after a first one with the rest."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of each document's ids, the end id included. Null texts count as empty and give the end id alone."""
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in (b.slice(k, ENCODED_TEXTS) for b in batches for k in range(0, b.num_rows, ENCODED_TEXTS)):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts), strict=True):
                ids += end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append((doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


class OpenBins:
    """Bounded-space best-fit over bins of one capacity."""

    def __init__(self, capacity: int, max_open: int):
        self.capacity, self.max_open = capacity, max_open
        self.free_bits = 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = self.opened = 0

    def _put(self, bin_id: int, free: int) -> None:
        if free:
            self.by_free[free].append(bin_id)
            self.free_bits |= 1 << free
            self.open += 1

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        bin_id = stack.pop()
        if not stack:
            self.free_bits &= ~(1 << free)
        self.open -= 1
        return bin_id

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset in it) for a piece."""
        fits = self.free_bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_id = self._take(free)
        else:
            if self.open >= self.max_open:
                self._take((self.free_bits & -self.free_bits).bit_length() - 1)  # the fullest closes
            free, bin_id = self.capacity, self.opened
            self.opened += 1
        self._put(bin_id, free - length)
        return bin_id, self.capacity - free


def pack(found: DataFrame, capacity: int = CAPACITY, max_open: int = MAX_OPEN, tasks: int | None = None) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows of ``pieces``.

    Pieces are dealt evenly to ``tasks`` packers (the cluster's cores by default) and arrive in an order drawn from a
    hash, so long and short ones mix. Only ids and lengths move, never texts. Sequence ids are unique numbers.
    """
    spark = found.sparkSession
    tasks = tasks or max(2, spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        bins = OpenBins(capacity, max_open)
        for batch in batches:
            placed = [bins.place(n) for n in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array([base + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    dealt = found.repartition(tasks).sortWithinPartitions(F.xxhash64("doc_id", "piece"), "doc_id", "piece", "start", "ids_crc32")
    return dealt.mapInArrow(run, PIECES + ", sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, max_open: int = MAX_OPEN) -> DataFrame:
    """Pack documents into sequences of at most ``capacity`` tokens.

    Null or empty text: one piece holding the end id. Repeated rows are packed each by itself; a null ``doc_id`` stays
    null. An empty table gives no rows. Columns other than ``doc_id`` and ``text`` are never looked at.
    """
    return pack(pieces(docs, tokenizer, capacity, end_id), capacity, max_open)

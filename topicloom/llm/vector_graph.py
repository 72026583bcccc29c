"""Embedding near-dedup over a robust-pruned flat graph.

Vectors go to the shards of their two nearest centroids, so shards overlap. Each shard builds a robust-pruned proximity
graph (Subramanya et al. 2019, DiskANN) of its members; a vector's adjacency is the union of its shards' lists. A search
enters each of its shards at the medoid, descends greedily, then widens over everything within the range; where it meets
a vector that belongs to another shard, it goes on there from that vector, as it would along the union's lists. Hits are
verified by their cosine in double precision, and recall is audited against brute force.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm.common import shuffle_partitions, stored
from topicloom.llm.components import components


@dataclass(frozen=True)
class Settings:
    cosine: float = 0.9
    shard: int = 500  # vectors of a shard on average
    largest: int = 1000  # beyond this a shard is split by a hash of the id, and searches enter all its parts
    centroids: int = 4096  # at most
    sample: int = 20_000  # vectors, the first in the order of a hash of their id, that the centroids are fitted on
    overlap: int = 2  # shards of a vector
    candidates: int = 48  # nearest members, and a third as many random ones, that pruning chooses from
    degree: int = 24
    alpha: float = 1.2
    beam: int = 24
    step: int = 12  # members that a search expands at a time
    audited: int = 1000  # vectors with ids divisible by 100 whose links are counted by brute force too
    recall: float = 0.9  # least recall of the audit; below, the index is built wider
    builds: int = 5  # at most; if the last is still below, that is an error


def unit(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that squares neither overflow nor vanish."""
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _valid(v: list | None) -> np.ndarray | None:
    if not v or None in v:
        return None
    a = np.array(v, float)
    return a if np.isfinite(a).all() and a.any() else None


def _matrix(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw)).reshape(len(raw), -1)


def robust_prune(x: np.ndarray, p: int, order: np.ndarray, settings: Settings) -> list[int]:
    """Out-neighbours of p: the nearest candidate, without those that lie nearer to it than p by the factor alpha, and on."""
    kept: list[int] = []
    to_p = 1 - x[order] @ x[p]
    while len(order) and len(kept) < settings.degree:
        best = order[0]
        kept.append(int(best))
        rest = settings.alpha * (1 - x[order] @ x[best]) > to_p
        rest[0] = False
        order, to_p = order[rest], to_p[rest]
    return kept


def build(x: np.ndarray, settings: Settings, seed: int = 0) -> tuple[np.ndarray, int]:
    """(neighbour lists padded with -1, medoid) of one shard's unit vectors."""
    n, rng = len(x), np.random.default_rng(seed)
    near = min(settings.candidates, n - 1)
    out: list[set[int]] = [set() for _ in range(n)]
    medoid = int((x @ x.mean(0)).argmax())
    for begin in range(0, n, 256):
        sims = x[begin : begin + 256] @ x.T
        sims[np.arange(len(sims)), np.arange(begin, begin + len(sims))] = -2
        nearest = np.argpartition(-sims, near - 1, 1)[:, :near] if near else np.empty((len(sims), 0), int)
        for k, row in enumerate(nearest):
            p = begin + k
            order = np.union1d(row, rng.integers(0, n, settings.candidates // 3))
            order = order[order != p]
            out[p].update(robust_prune(x, p, order[np.argsort(-sims[k, order], kind="stable")], settings))
    for p, row in enumerate([list(o) for o in out]):
        for q in row:
            out[q].add(p)
    reached = np.zeros(n, bool)
    reached[medoid], todo = True, [medoid]
    while True:
        while todo:
            new = [q for q in out[todo.pop()] if not reached[q]]
            reached[new] = True
            todo += new
        if reached.all():
            break
        lost = int(np.flatnonzero(~reached)[0])  # joined to its nearest reachable member
        at = np.flatnonzero(reached)
        to = int(at[(x[at] @ x[lost]).argmax()])
        out[to].add(lost), out[lost].add(to)
        reached[lost], todo = True, [lost]
    width = max(map(len, out))
    lists = np.full((n, max(width, 1)), -1, np.int32)
    for p, row in enumerate(out):
        lists[p, : len(row)] = sorted(row)
    return lists, medoid


def search(x: np.ndarray, lists: np.ndarray, entries: np.ndarray, queries: np.ndarray, settings: Settings) -> np.ndarray:
    """Similarities (queries x members) that a range-expanding greedy search computed; -2 for members it did not visit.

    ``entries`` holds, per query, members to begin at. While some visited member is not expanded and is among the
    ``beam`` best or within the range, the best few such members of each query are expanded.
    """
    nq, n = len(queries), len(x)
    sims = np.full((nq, n + 1), -2.0)  # the last column takes the padding
    expanded = np.zeros((nq, n + 1), bool)
    rows = np.arange(nq)[:, None]
    sims[rows, entries] = np.einsum("qd,qed->qe", queries, x[entries])
    step, beam = min(settings.step, n), min(settings.beam, n) - 1
    active = np.arange(nq)  # a query that has nothing left to expand is done with
    while True:
        own = sims[active, :n]
        open_sims = np.where(expanded[active, :n], -2.0, own)
        best = np.argpartition(-open_sims, step - 1, 1)[:, :step]
        value = np.take_along_axis(open_sims, best, 1)
        bar = -np.partition(-own, beam, 1)[:, beam]
        chosen = (value > -2) & ((value >= bar[:, None]) | (value >= settings.cosine))
        going = chosen.any(1)
        active, best, chosen = active[going], best[going], chosen[going]
        if not len(active):
            return sims[:, :n]
        mine = np.where(chosen, best, n)
        expanded[active[:, None], mine] = True
        next_to = np.where((mine < n)[:, :, None], lists[np.minimum(mine, n - 1)], -1).reshape(len(active), -1)
        next_to = np.where(next_to < 0, n, next_to)
        new = (next_to < n) & (sims[active[:, None], next_to] <= -2)
        at, col = np.nonzero(new)
        to = next_to[at, col]
        sims[active[at], to] = np.einsum("kd,kd->k", queries[active[at]], x[to])


_PART = "shard long, kind int, id long, home long, n long, raw binary, extra binary"
_PART_ARROW = pa.schema([("shard", pa.int64()), ("kind", pa.int32()), ("id", pa.int64()), ("home", pa.int64()), ("n", pa.int64()), ("raw", pa.binary()), ("extra", pa.binary())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, _PART_ARROW.types, strict=True)], schema=_PART_ARROW)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    held, group = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["shard"] != held:
                if group:
                    yield held, group
                held, group = row["shard"], []
            group.append(row)
    if group:
        yield held, group


def _centroids(kinds: DataFrame, count: int, settings: Settings) -> np.ndarray:
    """Spherical k-means on the bounded sample."""
    drawn = kinds.orderBy(F.xxhash64("id"), "id").limit(settings.sample).select("raw").toArrow()
    x = unit(_matrix(drawn.column("raw").to_pylist()))
    k = max(1, min(settings.centroids, len(x), -(-count // settings.shard)))
    centres = x[np.random.default_rng(0).choice(len(x), k, replace=False)]
    for _ in range(6):
        owner = np.concatenate([(x[a : a + 1024] @ centres.T).argmax(1) for a in range(0, len(x), 1024)])
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres)
    return centres


def _assigned(kinds: DataFrame, centres: np.ndarray, overlap: int) -> DataFrame:
    """Each distinct vector once for each of its nearest centroids, the nearest first: home is that one's shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            if not raw:
                continue
            sims, take = unit(_matrix(raw)) @ centres.T, min(overlap, len(centres))
            near = np.argsort(-sims, 1, kind="stable")[:, :take]
            ids, n = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            yield _rows([(int(s), 0, i, int(row[0]), m, r, None) for i, r, m, row in zip(ids, raw, n, near, strict=True) for s in row])

    return kinds.select("id", "raw", "n").mapInArrow(run, _PART)


def _indexed(members: DataFrame, tasks: int, settings: Settings) -> DataFrame:
    """Kind 1: one row per shard with its members' ids, homes, copies, vectors and neighbour lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, group in _groups(batches):
            ids, homes, copies = (np.array([r[c] for r in group], np.int64) for c in ("id", "home", "n"))
            x = unit(_matrix([r["raw"] for r in group]))
            lists, medoid = build(x, settings)
            yield _rows([(shard, 1, medoid, lists.shape[1], len(ids), x.tobytes(), b"".join((ids.tobytes(), homes.tobytes(), copies.tobytes(), lists.tobytes())))])

    return members.repartition(tasks, "shard").sortWithinPartitions("shard", "id").mapInArrow(run, _PART)


def _searched(index: DataFrame, asked: DataFrame, tasks: int, settings: Settings) -> DataFrame:
    """Kind 3: links (n) of query id in a shard, counted over vectors at home there. Kind 4: a link (id, home) of those
    that connect what the shard's links connect. Kind 5: shard ``home`` where query id goes on from vector n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, group in _groups(batches):
            head = group[0]
            if head["kind"] != 1:
                continue
            n, width, extra = head["n"], head["home"], head["extra"]
            x = np.frombuffer(head["raw"]).reshape(n, -1)
            ids, homes, copies = np.frombuffer(extra[: 24 * n], np.int64).reshape(3, n)
            lists = np.frombuffer(extra[24 * n :], np.int32).reshape(n, width)
            place = {i: k for k, i in enumerate(ids.tolist())}
            parent: dict[int, int] = {}

            def root(a: int, parent=parent) -> int:
                while parent.setdefault(a, a) != a:
                    parent[a] = parent[parent[a]]
                    a = parent[a]
                return a

            for begin in range(1, len(group), 256):
                part, out = group[begin : begin + 256], []
                asks = [sorted({place[e] for e in np.frombuffer(r["extra"] or b"", np.int64).tolist() if e in place} | {head["id"]}) for r in part]
                most = max(map(len, asks))
                entries = np.array([a + [a[0]] * (most - len(a)) for a in asks])
                queries = unit(_matrix([r["raw"] for r in part]))
                found = search(x, lists, entries, queries, settings) >= settings.cosine
                for row, hit in zip(part, found, strict=True):
                    at = np.flatnonzero(hit & (ids != row["id"]))
                    out.append((shard, 3, row["id"], 0, int(copies[at][homes[at] == shard].sum()), None, None))
                    mine = root(row["id"])
                    for k in at.tolist():
                        other = int(ids[k])
                        if (theirs := root(other)) != mine:
                            parent[theirs] = mine
                            out.append((shard, 4, row["id"], other, 0, None, None))
                    away = at[homes[at] != shard]
                    for home, first in zip(*np.unique(homes[away], return_index=True), strict=True):
                        out.append((shard, 5, row["id"], int(home), int(ids[away[first]]), None, None))
                yield _rows(out)

    return index.unionByName(asked).repartition(tasks, "shard").sortWithinPartitions("shard", "kind", "id").mapInArrow(run, _PART)


def _linked(spark: SparkSession, kinds: DataFrame, count: int, tasks: int, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(id, n_links) and links (a, b) among the distinct vectors of one dimension."""
    centres = _centroids(kinds, count, settings)
    placed = _assigned(kinds, centres, settings.overlap)
    sizes = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # a row per centroid
    parts = spark.createDataFrame([(s, -(-n // settings.largest)) for s, n in sizes.items()], "cluster long, parts long")
    parts = F.broadcast(parts)  # as many rows as centroids
    at_home = parts.select(F.col("cluster").alias("_home"), F.col("parts").alias("_home_parts"))
    mixed = F.abs(F.xxhash64("id"))
    rows = placed.join(parts, placed["shard"] == parts["cluster"]).join(at_home, placed["home"] == at_home["_home"])
    shard = (F.col("shard") * 1_000_000 + mixed % F.col("parts")).alias("shard")
    members = rows.select(shard, "kind", "id", (F.col("home") * 1_000_000 + mixed % F.col("_home_parts")).alias("home"), "n", "raw", "extra")
    index = stored(_indexed(members, tasks, settings), "graphs")
    every = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda k: F.col("shard") * 1_000_000 + k)).alias("to")
    asked = rows.select("id", "raw", "shard", "parts").select("id", "raw", every)
    asked = asked.select(F.col("to").alias("shard"), F.lit(2).alias("kind"), "id", F.lit(0).cast("long").alias("home"), F.lit(0).cast("long").alias("n"), "raw", F.lit(None).cast("binary").alias("extra"))
    found = stored(_searched(index, asked, tasks, settings), "found")
    rounds = [found]
    seen = found.where("kind = 3").select("id", "shard")
    while True:
        ahead = found.where("kind = 5").select("id", (F.col("home") - F.col("home") % 1_000_000).alias("base"), F.col("n").alias("entry"))
        ahead = ahead.join(parts, F.expr("base div 1000000") == F.col("cluster"))
        ahead = ahead.groupBy("id", "base", "parts").agg(F.min("entry").alias("entry"))
        ahead = ahead.select("id", "entry", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda k: F.col("base") + k)).alias("shard"))
        ahead = stored(ahead.join(seen, ["id", "shard"], "left_anti"), "ahead")
        if ahead.isEmpty():
            break
        going = ahead.join(kinds.select("id", "raw"), "id").mapInArrow(_as_asked, _PART)
        found = stored(_searched(index, going, tasks, settings), "found")
        rounds.append(found)
        seen = seen.unionByName(found.where("kind = 3").select("id", "shard"))
    every_found = rounds[0]
    for more in rounds[1:]:
        every_found = every_found.unionByName(more)
    counts = every_found.where("kind = 3").groupBy("id").agg(F.sum("n").alias("n_links"))
    return counts, every_found.where("kind = 4").select(F.col("id").alias("a"), F.col("home").alias("b"))


def _as_asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        yield _rows([(r["shard"], 2, r["id"], 0, 0, r["raw"], np.array([r["entry"]], np.int64).tobytes()) for r in rows])


def audit(spark: SparkSession, kinds: DataFrame, counts: DataFrame, settings: Settings) -> float:
    """Recall of a bounded set of vectors' links, which brute force over all vectors counts: over all of their links, or on
    the average of a vector that has any, whichever is less."""
    drawn = kinds.where("id % 100 = 0").orderBy(F.xxhash64("id"), "id").limit(settings.audited).select("id", "raw").toArrow()
    ids, raw = drawn.column("id").to_numpy(), drawn.column("raw").to_pylist()
    if not len(ids):
        return 1.0
    queries = spark.sparkContext.broadcast((ids, unit(_matrix(raw))))  # at most ``audited`` vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = queries.value
        totals = np.zeros(len(ids), np.int64)
        for batch in batches:
            if batch.num_rows:
                hit = unit(_matrix(batch.column(1).to_pylist())) @ q.T >= settings.cosine
                hit &= batch.column(0).to_numpy()[:, None] != ids
                totals += batch.column(2).to_numpy() @ hit
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(totals)], ["id", "n"])

    truth = kinds.select("id", "raw", "n").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    met = truth.where("n > 0").join(counts, "id", "left").withColumn("found", F.least(F.coalesce("n_links", F.lit(0)), "n"))
    row = met.agg(F.sum("found") / F.sum("n"), F.avg(F.col("found") / F.col("n"))).first()
    return 1.0 if row[0] is None else min(row)


def embedding_groups(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(vec_id, n_links, component_id, kept, audit_recall) for every row of ``vectors``.

    Equal vectors are one node of the graph with as many copies. Null, empty or zero vectors, and those with null or
    non-finite components, have no links and are kept; vectors of different lengths never link. A null vec_id stays
    null, links like any other, and is kept only without a smaller id in its component; rows that repeat an id count
    each as a vector. An empty table gives no rows; other columns are never looked at. If the audit finds less than
    the least recall, the index is built again with one more shard per vector and twice the beam, and it is an error if
    that does not help.
    """
    spark = vectors.sparkSession
    tasks = shuffle_partitions(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_valid(v) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([None if v is None else v.tobytes() for v in found], pa.binary()), pa.array([0 if v is None else len(v) for v in found], pa.int32())], ["vec_id", "raw", "size"]
            )

    rows = stored(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(read, "vec_id long, raw binary, size int"), "vectors")
    kinds = rows.where("size > 0").groupBy("raw", "size").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))
    # vectors whose ids are all null get a negative key
    kinds = stored(kinds.withColumn("named", F.col("id").isNotNull()).withColumn("id", F.coalesce("id", F.expr("xxhash64(raw) | shiftleft(1L, 63)"))), "kinds")
    out = []
    for size, count in [tuple(r) for r in kinds.groupBy("size").count().collect()]:
        own, wide = kinds.where(F.col("size") == size), settings
        for build_no in range(settings.builds):
            counts, links = _linked(spark, own, count, tasks, wide)
            counts = stored(counts, "counts")
            recall = audit(spark, own, counts, wide)
            if recall >= settings.recall:
                break
            if build_no == settings.builds - 1:
                raise RuntimeError(f"recall is {recall:.3f} after {settings.builds} builds of the index")
            wide = replace(wide, overlap=wide.overlap + 1, beam=2 * wide.beam, candidates=2 * wide.candidates)
        groups = stored(components(links), "components")
        named = own.join(counts, "id", "left").join(groups.withColumnRenamed("node", "id"), "id", "left")
        out.append(named.select("raw", "named", (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"), "id", F.lit(recall).alias("audit_recall")))
    schema = "vec_id long, n_links long, component_id long, kept boolean, audit_recall double"
    lone = rows.where("size = 0").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(None).cast("double").alias("audit_recall"))
    for part in out:
        part = stored(part, "named")
        smallest = part.where("named").groupBy("component").agg(F.min("id").alias("component_id"))
        names = part.join(smallest, "component", "left").select("raw", "n_links", "component_id", "audit_recall")
        met = rows.join(names, "raw")
        lone = lone.unionByName(met.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"), "audit_recall"))
    return lone.select([F.col(c.split()[0]) for c in schema.split(", ")])

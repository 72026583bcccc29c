"""The vector cache: a keyed Parquet table of note vectors, kept up by content hash."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.functions import text, vectors

MODEL = "local-onnx"
DIMENSION = 384


def is_hit(notes_hash: Column, cached_hash: Column, model: Column, vector: Column, dimension: int = DIMENSION) -> Column:
    """Same content, made by the local model (or before models were noted), and a valid vector."""
    return F.coalesce((notes_hash == cached_hash) & (model.isNull() | (model == MODEL)) & vectors.is_valid(vector, dimension), F.lit(False))


def split(notes: DataFrame, cache: DataFrame, dimension: int = DIMENSION) -> DataFrame:
    """Notes (note_id, title, body) with status hit, miss or skipped, their hash and, for hits, the cached vector."""
    hashed = notes.withColumn("hash", text.content_hash(F.col("title"), F.col("body")))
    kept = cache.select("note_id", F.col("hash").alias("_hash"), F.col("model_id").alias("_model"), F.col("vector").alias("_vector"))
    hit = is_hit(F.col("hash"), F.col("_hash"), F.col("_model"), F.col("_vector"), dimension)
    status = F.when(text.is_skipped(F.col("title"), F.col("body")), "skipped").when(hit, "hit").otherwise("miss")
    out = hashed.join(kept, "note_id", "left").withColumn("status", status)
    return out.withColumn("vector", F.when(F.col("status") == "hit", F.col("_vector"))).drop("_hash", "_model", "_vector")


def obsolete(cache: DataFrame, note_ids: DataFrame) -> DataFrame:
    """Cached rows of notes that are gone; pass all notes, not the filtered ones."""
    return cache.join(note_ids.select("note_id").distinct(), "note_id", "left_anti")


def upserted(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """The cache with rows put in place of those of the same id."""
    return cache.join(rows.select("note_id"), "note_id", "left_anti").unionByName(rows.select(*cache.columns))


def counters(split_notes: DataFrame, embedded: DataFrame | None = None) -> DataFrame:
    """(status, n): hits, skipped, embedded and failed notes; processed ones are all but the failed."""
    if embedded is None:
        return split_notes.groupBy("status").agg(F.count("*").alias("n"))
    done = embedded.select("note_id", F.lit(True).alias("_done"))
    status = F.when(F.col("status") != "miss", F.col("status")).when(F.col("_done"), "embedded").otherwise("failed")
    return split_notes.join(done, "note_id", "left").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


class VectorCache:
    """Versions of the table in folders of their own; ``current`` names the last one committed.

    A batch is written beside the version in use and takes its place in one rename, so readers see one or the other and
    a failed batch leaves nothing behind.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str = "note_id string, title string, hash string, updated_time long, title_weight double, model_id string, dimension int, vector array<double>"):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _current(self) -> str | None:
        versions = self._fs.globStatus(self._path(f"{self.path}/v*")) or []
        names = sorted(s.getPath().getName() for s in versions)
        return names[-1] if names else None

    def read(self) -> DataFrame:
        name = self._current()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{name}") if name else self.spark.createDataFrame([], self.schema)

    def commit(self, table: DataFrame) -> None:
        before = self._current()
        staged = f"{self.path}/_staged-{uuid.uuid4().hex}"
        table.write.parquet(staged)
        after = f"v{int(before[1:]) + 1 if before else 1:012d}"
        if not self._fs.rename(self._path(staged), self._path(f"{self.path}/{after}")):
            self._fs.delete(self._path(staged), True)
            raise OSError(f"version {after} could not be put in place")
        if before:
            self._fs.delete(self._path(f"{self.path}/{before}"), True)

    def upsert(self, rows: DataFrame) -> None:
        self.commit(upserted(self.read(), rows))

    def delete(self, note_ids: DataFrame) -> None:
        self.commit(self.read().join(note_ids.select("note_id"), "note_id", "left_anti"))

    def reconcile(self, note_ids: DataFrame) -> int:
        """Delete what is obsolete; how many rows that were."""
        table = self.read()
        gone = obsolete(table, note_ids)
        n = gone.count()
        if n:
            self.commit(table.join(gone.select("note_id"), "note_id", "left_anti"))
        return n

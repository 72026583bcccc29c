"""Arriving notes kept up in the vector cache by micro-batches: an extension beyond the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from topicloom.operators.cache import MODEL, VectorCache
from topicloom.plans.topics import embedded


def upsert_batch(cache: VectorCache, notes: DataFrame) -> None:
    """Embed a batch's latest version of each note, as far as its content is new, and put it in the cache."""
    latest = F.row_number().over(Window.partitionBy("note_id").orderBy(F.desc("updated_time"), F.desc(F.length("body"))))
    notes = notes.withColumn("_latest", latest).where("_latest = 1").drop("_latest")
    fresh = embedded(notes, cache.read()).where("status = 'embedded'")
    rows = fresh.join(notes.select("note_id", "title", "updated_time"), "note_id")
    rows = rows.select("note_id", "title", "hash", "updated_time", "title_weight", F.lit(MODEL).alias("model_id"), F.size("vector").alias("dimension"), "vector")
    if not rows.isEmpty():
        cache.upsert(rows)


def keep_up(stream: DataFrame, cache: VectorCache, checkpoint: str) -> DataStreamWriter:
    """A writer for a stream of notes (note_id, title, body, updated_time); upserts make a repeated batch harmless."""
    return stream.writeStream.foreachBatch(lambda batch, _: upsert_batch(cache, batch)).option("checkpointLocation", checkpoint)

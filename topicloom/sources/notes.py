"""Notes, folders, tags and chunk vectors read from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.functions import vectors


def notes(docs: DataFrame) -> DataFrame:
    """Notes of a documents table: the title is the first line, the folder the source."""
    return docs.select(
        F.col("doc_id").cast("string").alias("note_id"), F.split("text", "\n")[0].alias("title"), F.col("text").alias("body"),
        F.coalesce("source", F.lit("")).alias("parent_id"), F.col("doc_id").cast("long").alias("note_idx"),
    )


def note_ids(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("string").alias("note_id")).distinct()


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of three levels: regions, their nations, and customers in them."""
    region, nation, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("region", "nation", "customer"))
    rows = region.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("folder_id"), F.col("r_name").alias("title"), F.lit("").alias("parent_id"))
    rows = rows.unionByName(nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("folder_id"), F.col("n_name").alias("title"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent_id")))
    return rows.unionByName(customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("folder_id"), F.col("c_name").alias("title"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("parent_id")))


def chunks(embeddings: DataFrame, per_note: int = 5) -> DataFrame:
    """Chunk vectors (note_id, chunk_index, vector) of an embeddings table, ``per_note`` of them a note."""
    return embeddings.select(F.floor(F.col("vec_id") / per_note).cast("long").alias("note_id"), (F.col("vec_id") % per_note).cast("int").alias("chunk_index"), vectors.widened(F.col("embedding")).alias("vector"))


class SourceError(ValueError):
    """A table of chunk vectors that can't be used as one."""


def native_chunks(table: DataFrame, wanted: DataFrame) -> tuple[DataFrame, str, int]:
    """(chunks of the wanted notes, model, dimension) of a table (note_id, chunk_index, chunk_text, vector, model_id,
    dimension). Rows without an id or a vector are passed over; models or dimensions that differ are an error."""
    missing = {"note_id", "chunk_index", "vector"} - set(table.columns)
    if missing:
        raise SourceError(f"no column {', '.join(sorted(missing))}")
    rows = table.where("note_id is not null and vector is not null").join(wanted.select("note_id"), "note_id", "left_semi")
    model = F.col("model_id") if "model_id" in table.columns else F.lit(None).cast("string")
    noted = F.col("dimension") if "dimension" in table.columns else F.lit(None).cast("int")
    found = rows.agg(F.count_distinct(model), F.min(model), F.count_distinct(noted), F.coalesce(F.min(noted), F.max(F.when(F.size("vector") > 0, F.size("vector"))))).first()
    if found[0] > 1 or found[2] > 1:
        raise SourceError("the model or its dimension changes within the table")
    return rows, found[1] or "unknown", found[3] or 384


def is_ready(probe) -> bool:
    """Whether a source answers that it is ready; an error counts as no."""
    try:
        return bool(probe())
    except Exception:
        return False


def pooled(native: DataFrame, dimension: int) -> DataFrame:
    """(note_id, vector) of native chunks: decaying weights by chunk order; notes whose mean all but vanishes drop out."""
    out = vectors.decay_pool(native.select("note_id", "chunk_index", "vector"), "note_id")
    return out.where(F.col("raw_norm") >= 1e-6).where(vectors.is_valid(F.col("vector"), dimension)).drop("raw_norm")

"""Vector functions over arrays of doubles, as column builders. Floats are widened before any arithmetic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions.text import let


def widened(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """Null where the lengths differ."""
    return F.when(F.size(a) == F.size(b), _sum(F.zip_with(a, b, lambda x, y: x * y)))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x * x)))


def normalise(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    return let(v, lambda u: let(norm(u), lambda n: F.when(n == 0, u).otherwise(F.transform(u, lambda x: x / n))))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Dot product of vectors that are normalised already."""
    return dot(a, b)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 where a vector is zero."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(1.0)).otherwise(1 - dot(a, b) / scale)


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))))


def distance(metric: str = "cosine") -> Callable[[Column, Column], Column]:
    return {"cosine": cosine_distance, "euclidean": euclidean_distance}.get(metric, cosine_distance)


def title_weight(similarity: Column, most: float = 0.3) -> Column:
    return F.least(F.greatest(similarity, F.lit(0.0)), F.lit(1.0)) * most


def blend(body: Column, title: Column, weight: Column) -> Column:
    return normalise(let(weight, lambda w: F.zip_with(body, title, lambda b, t: (1 - w) * b + w * t)))


def is_valid(v: Column, dimension: int | None = None) -> Column:
    """Not null or empty, of the dimension if one is given, and finite throughout."""
    finite = F.forall(widened(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    right = F.size(v) == dimension if dimension is not None else F.size(v) > 0
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & right & finite, F.lit(False))


def mean_of(vector: Column, weight: Column | None = None) -> Column:
    """Aggregate: the weighted mean of vectors. They are added up whole, in each task before anything moves."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    return vector_to_array(Summarizer.mean(array_to_vector(widened(vector)), F.lit(1.0) if weight is None else weight))


def _pooled(chunks: DataFrame, key: str, weight: Column | None, vector: str) -> DataFrame:
    """(key, vector, raw_norm): weighted mean of each key's vectors, brought to unit length."""
    means = chunks.groupBy(key).agg(mean_of(F.col(vector), weight).alias("_mean"))
    return means.select(key, normalise(F.col("_mean")).alias(vector), norm(F.col("_mean")).alias("raw_norm"))


def mean_pool(chunks: DataFrame, key: str, vector: str = "vector") -> DataFrame:
    same_dimension(chunks, vector)
    return _pooled(chunks, key, None, vector).drop("raw_norm")


def decay_pool(chunks: DataFrame, key: str, order: str = "chunk_index", vector: str = "vector", decay: float = 0.15, lead: float = 0.5) -> DataFrame:
    """Mean weighted by exp(-decay * rank), and ``lead`` more for the first, of each key's vectors; with the raw norm."""
    same_dimension(chunks, vector)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    ranked = chunks.withColumn("_rank", rank)
    return _pooled(ranked, key, F.exp(-decay * F.col("_rank")) + F.when(F.col("_rank") == 0, lead).otherwise(0.0), vector)


def title_chunk_pool(chunks: DataFrame, key: str, order: str = "chunk_index", vector: str = "vector", weight: float = 3.0) -> DataFrame:
    """Mean in which chunk 0 counts ``weight`` times."""
    same_dimension(chunks, vector)
    return _pooled(chunks, key, F.when(F.col(order) == 0, weight).otherwise(1.0), vector).drop("raw_norm")


def same_dimension(chunks: DataFrame, vector: str) -> None:
    """Raise if vectors differ in length. One pass over the sizes alone."""
    low, high = chunks.agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    if low != high:
        raise ValueError(f"vectors have from {low} to {high} dimensions")


def note_vectors(body: DataFrame, titles: DataFrame, generic: Column, key: str = "note_id") -> DataFrame:
    """(key, vector, title_weight) from pooled body vectors (key, vector) and titles (key, title, title_vector).

    A generic title gives the body's vector; else the title is blended in by its similarity; without a body the title's
    vector stands alone with weight 1.
    """
    met = titles.join(body, key, "full")
    weight = F.when(F.col("vector").isNull(), 1.0).when(generic | F.col("title_vector").isNull(), 0.0).otherwise(title_weight(cosine_similarity(F.col("vector"), F.col("title_vector"))))
    met = met.withColumn("title_weight", weight)
    vector = F.when(F.col("vector").isNull(), F.col("title_vector")).when(F.col("title_weight") == 0, F.col("vector")).otherwise(blend(F.col("vector"), F.col("title_vector"), F.col("title_weight")))
    return met.select(key, vector.alias("vector"), "title_weight")

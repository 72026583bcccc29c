"""From notes to named, tagged clusters: embed or pool, reduce, cluster by each strategy, label."""

from __future__ import annotations

import logging
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.functions import embed, text, vectors
from topicloom.operators import cache as caching
from topicloom.operators import clustering, fits, labels, tfidf
from topicloom.storage import stored, tidied

LEAST_NOTES = 3
log = logging.getLogger(__name__)


@dataclass
class Topics:
    """Per strategy, best silhouette first: assignments and clusters; one summary row each."""

    summary: DataFrame
    assignments: DataFrame
    clusters: DataFrame


def embedded(notes: DataFrame, cache: DataFrame | None = None, model: Callable = embed.hashed_words, dimension: int = embed.DIMENSION) -> DataFrame:
    """(note_id, vector, title_weight, hash, status) of notes that are not skipped: cached vectors where content is as it
    was, else mean chunk vectors blended with the title's."""
    if cache is None:
        cache = notes.sparkSession.createDataFrame([], "note_id string, hash string, model_id string, vector array<double>, title_weight double")
    split = caching.split(notes, cache, dimension)
    misses = split.where("status = 'miss'")
    chunks = misses.where(F.coalesce("body", F.lit("")) != "").select("note_id", F.posexplode(text.token_chunks(F.col("body"))).alias("chunk_index", "chunk"))
    body = vectors.mean_pool(chunks.select("note_id", embed.embed(F.col("chunk"), model).alias("vector")), "note_id") if not chunks.isEmpty() else notes.sparkSession.createDataFrame([], "note_id string, vector array<double>")
    titles = misses.select("note_id", "title", embed.embed(F.coalesce("title", F.lit("")), model).alias("title_vector"))
    new = vectors.note_vectors(body, titles, text.is_generic_title(F.col("title")))
    new = new.join(misses.select("note_id", "hash"), "note_id").withColumn("status", F.lit("embedded"))
    kept = split.where("status = 'hit'").select("note_id", "vector", "hash", "status").join(cache.select("note_id", "title_weight"), "note_id", "left")
    return new.select("note_id", "vector", "title_weight", "hash", "status").unionByName(kept.select("note_id", "vector", "title_weight", "hash", "status"))


@dataclass
class Result:
    strategy: clustering.Strategy
    labels: DataFrame
    score: float
    clusters: int
    outliers: int


def run_strategy(strategy: clustering.Strategy, points: DataFrame, metric: str, seed: int) -> Result:
    """One strategy's labels of points (note_id, note_idx, vector), and their silhouette without noise."""
    score = None
    if strategy.algorithm == "kmeans" and strategy.k == "auto":
        _, score, found = fits.sweep_k(points, metric, seed)
    elif strategy.algorithm == "kmeans":
        k = int(strategy.k or 5)
        n = points.count()
        found = fits.labelled(points, fits.kmeans(points, n, [k], metric, seed - min(k, n))[min(k, n)][0], metric)
    elif strategy.algorithm == "hdbscan":
        found = fits.hdbscan(points, strategy.min_cluster_size or 3, strategy.min_samples, metric)
    else:
        raise ValueError(f"no algorithm {strategy.algorithm}")
    found = stored(found, "labels")
    about = found.agg(F.count_distinct(F.when(F.col("cluster_id") >= 0, F.col("cluster_id"))), F.count_if(F.col("cluster_id") < 0)).first()
    if score is None:
        inner = points.join(found.where("cluster_id >= 0").select("note_id", "cluster_id"), "note_id")
        score = clustering.sampled_silhouette(inner, metric).first()["silhouette"] if about[0] >= 2 else 0.0
    return Result(strategy, found, float(score), about[0], about[1])


def benchmark(points: DataFrame, config: clustering.Config) -> list[Result]:
    """Every strategy's result over points (note_id, note_idx, vector), best silhouette first; a strategy that fails is
    logged and left out."""
    metric = config.metric
    if config.dimensions is not None:
        points, metric = stored(fits.umap(points, config.dimensions, config.neighbours, config.seed, config.metric), "layout"), "euclidean"
        tidied(points.sparkSession, 0)
    results = []
    for strategy in config.strategies:
        try:
            results.append(run_strategy(strategy, points, metric, config.seed))
        except Exception:
            log.exception("strategy %s failed", strategy.name)
        tidied(points.sparkSession)
    return sorted(results, key=lambda r: -r.score)


def comparison(spark: SparkSession, results: list[Result]) -> DataFrame:
    rows = [(r.strategy.name, r.strategy.algorithm, r.clusters, r.outliers, r.score) for r in results]
    return spark.createDataFrame(rows, "strategy string, algorithm string, clusters int, outliers int, silhouette double")


def run(notes: DataFrame, note_vectors: DataFrame, ask: Callable | None = None, top_tags: int = 5, config: clustering.Config | None = None) -> Topics:
    """Cluster and label notes (note_id, note_idx, title, body) that have a vector (note_id, vector)."""
    spark = notes.sparkSession
    texts = notes.withColumn("note_id", F.col("note_id").cast("string"))
    vectors_of = note_vectors.select(F.col("note_id").cast("string").alias("note_id"), vectors.widened(F.col("vector")).alias("vector"))
    points = stored(texts.select("note_id", "note_idx").join(vectors_of, "note_id"), "points")
    n = points.count()
    if n < LEAST_NOTES:
        raise ValueError(f"clustering takes {LEAST_NOTES} notes with vectors or more; there are {n}")
    results = benchmark(points, config or clustering.config_for(n))
    # all that scores read of the texts
    read = stored(texts.join(points.select("note_id"), "note_id", "left_semi").select("note_id", "note_idx", "title", F.substring("body", 1, tfidf.BODY_CHARS).alias("body")), "texts")
    tidied(spark, 0)

    def label(r: Result) -> tuple[DataFrame, DataFrame]:
        own = r.labels.select(F.lit(r.strategy.name).alias("strategy"), "note_id", "note_idx", "cluster_id")
        scored = tfidf.note_scores(read, own)
        tidied(spark)
        tagged = stored(labels.tags(scored, top_tags), "tags")
        named = stored(labels.names(scored, own.where("cluster_id >= 0").select("cluster_id").distinct()), "first-names")
        named = labels.told_apart(named, scored)
        named = stored(labels.renamed_by(named, labels.sample_titles(texts, own), tagged, ask), "names")
        sized = own.groupBy("cluster_id").agg(F.count("*").alias("size"))
        clusters = named.join(tagged, "cluster_id", "left").join(sized, "cluster_id").select(F.lit(r.strategy.name).alias("strategy"), "cluster_id", "size", "name", "tags")
        clusters = stored(clusters, "clusters")
        tidied(spark, 0)
        return own, clusters

    if not results:
        raise ValueError("every strategy failed")
    # a strategy each: their jobs and a model's answers overlap; without one, fewer plans at a time take less of the driver
    with ThreadPoolExecutor(len(results) if ask else 1) as pool:
        parts = list(pool.map(label, results))
    assignments, clusters = (reduce(DataFrame.unionByName, side) for side in zip(*parts, strict=True))
    return Topics(comparison(spark, results), assignments, clusters)

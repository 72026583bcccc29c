"""Edits and views of one strategy's result: assignments (note_id, note_idx, cluster_id), clusters (cluster_id, name, tags)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rename_cluster(clusters: DataFrame, cluster_id: int, name: str) -> DataFrame:
    return clusters.withColumn("name", F.when(F.col("cluster_id") == cluster_id, F.lit(name)).otherwise(F.col("name")))


def move_note(assignments: DataFrame, note_idx: int, cluster_id: int) -> DataFrame:
    """One note in another cluster; an index that no note has changes nothing. Sizes stay as they were noted."""
    return assignments.withColumn("cluster_id", F.when(F.col("note_idx") == note_idx, F.lit(cluster_id)).otherwise(F.col("cluster_id")))


def add_cluster(clusters: DataFrame, name: str) -> DataFrame:
    """A new empty cluster under the next id; a blank name, or one that is taken in any case, is an error."""
    name = name.strip()
    if not name:
        raise ValueError("a cluster needs a name")
    row = clusters.agg(F.max("cluster_id"), F.max((F.lower("name") == name.lower()).cast("int"))).first()
    if row[1]:
        raise ValueError(f"there is a cluster {name}")
    new = clusters.sparkSession.createDataFrame([(0 if row[0] is None else row[0] + 1, name, [])], "cluster_id int, name string, tags array<string>")
    return clusters.unionByName(new, allowMissingColumns=True)


def default_strategy(names: list[str]) -> int:
    return next((k for k, n in enumerate(names) if n.startswith("kmeans")), 0)


def strategy_view(assignments: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster_id, name, n_notes): noise, as -1, and every cluster that has notes; order by cluster_id to show."""
    n = assignments.select(F.greatest("cluster_id", F.lit(-1)).alias("cluster_id")).groupBy("cluster_id").agg(F.count("*").alias("n_notes"))
    return n.join(clusters.select("cluster_id", "name"), "cluster_id", "left").select("cluster_id", "name", "n_notes")

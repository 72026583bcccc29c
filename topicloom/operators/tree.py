"""Folder trees as adjacency tables (folder_id, title, parent_id; '' is the root)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.storage import stored


@dataclass(frozen=True)
class FolderFilter:
    mode: str = "all"  # all, include or exclude
    selected: tuple[str, ...] = field(default=())
    with_descendants: bool = True

    @staticmethod
    def parse(raw: str | None) -> FolderFilter:
        """A filter from its JSON form; the default one where that is missing, broken or of another shape."""
        import json

        try:
            value = json.loads(raw or "")
        except ValueError:
            return FolderFilter()
        if not isinstance(value, dict):
            return FolderFilter()
        mode, ids, sub = value.get("mode"), value.get("selectedFolderIds"), value.get("includeSubNotebooks")
        if mode not in ("all", "include", "exclude") or not isinstance(sub, bool) or not isinstance(ids, list) or not all(isinstance(i, str) for i in ids):
            return FolderFilter()
        return FolderFilter(mode, tuple(ids), sub)


def clean_folders(folders: DataFrame) -> DataFrame:
    return folders.withColumn("parent_id", F.coalesce("parent_id", F.lit("")))


def children_map(folders: DataFrame, order: str = "folder_id") -> DataFrame:
    """(parent_id, children): each parent's children in the order of a column."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("order"), F.col("folder_id").alias("id")))), lambda s: s["id"])
    return clean_folders(folders).groupBy("parent_id").agg(ids.alias("children"))


def _closure(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Nodes reachable from ``start(folder_id)`` over ``edges(from, to)``, itself included.

    A level of the tree is one join; nodes seen before are left out, so a cycle ends. Levels are stored in the shared
    folder, which keeps plans short however deep a tree is.
    """
    visited = start.select("folder_id").distinct()
    frontier = visited
    while True:
        met = frontier.join(edges, frontier["folder_id"] == edges["from"]).select(F.col("to").alias("folder_id")).distinct()
        frontier = stored(met.join(visited, "folder_id", "left_anti"), "level")
        if frontier.isEmpty():
            return visited
        visited = visited.unionByName(frontier)


def descendants(folders: DataFrame, roots: DataFrame) -> DataFrame:
    """The roots and all folders below them."""
    f = clean_folders(folders)
    return _closure(f.select(F.col("parent_id").alias("from"), F.col("folder_id").alias("to")), roots)


def ancestors(folders: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes and all folders above them."""
    f = clean_folders(folders).where("parent_id <> ''")
    return _closure(f.select(F.col("folder_id").alias("from"), F.col("parent_id").alias("to")), nodes).join(folders.select("folder_id"), "folder_id", "left_semi")


def _selected(folders: DataFrame, flt: FolderFilter) -> DataFrame:
    """Selected folders that exist: stale ids drop out."""
    ids = list(flt.selected)
    return folders.where(F.col("folder_id").isin(ids) if ids else F.lit(False)).select("folder_id")


def effective_folders(folders: DataFrame, flt: FolderFilter | None = None) -> DataFrame:
    """Ids of the folders whose notes a filter lets through."""
    every = folders.select("folder_id")
    if flt is None or flt.mode not in ("include", "exclude"):
        return every
    chosen = _selected(folders, flt)
    reach = descendants(folders, chosen) if flt.with_descendants else chosen
    return reach if flt.mode == "include" else every.join(reach, "folder_id", "left_anti")


def folder_tree(folders: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(folder_id, title, parent_id, note_count, is_root): folders of an unknown parent are roots too."""
    f = clean_folders(folders)
    known = f.select(F.col("folder_id").alias("_parent"))
    out = f.join(known, f["parent_id"] == known["_parent"], "left").withColumn("is_root", F.col("_parent").isNull())
    if counts is None:
        out = out.withColumn("note_count", F.lit(0).cast("long"))
    else:
        n = counts.select(F.col("parent_id").alias("_of"), F.col("note_count").alias("_n"))
        out = out.join(n, out["folder_id"] == n["_of"], "left").withColumn("note_count", F.coalesce("_n", F.lit(0).cast("long")))
    return out.select("folder_id", "title", "parent_id", "note_count", "is_root")


def note_counts(notes: DataFrame) -> DataFrame:
    return notes.where(F.coalesce("parent_id", F.lit("")) != "").groupBy("parent_id").agg(F.count("*").alias("note_count"))


def visible_folders(folders: DataFrame, query: str) -> DataFrame:
    """Folders whose title, or that of a folder below, contains a search text, trimmed and in any case."""
    q = query.strip().lower()
    hits = folders.where(F.lower("title").contains(q)) if q else folders
    return ancestors(folders, hits.select("folder_id"))


def implicit_folders(folders: DataFrame, flt: FolderFilter) -> DataFrame:
    """Folders that are selected only through one above them."""
    chosen = _selected(folders, flt)
    if flt.mode == "all" or not flt.with_descendants:
        return chosen.limit(0)
    return descendants(folders, chosen).join(chosen, "folder_id", "left_anti")


def estimated_notes(folders: DataFrame, counts: DataFrame, flt: FolderFilter) -> DataFrame:
    """One row (n_notes): notes in the folders that a filter lets through."""
    n = counts.select(F.col("parent_id").alias("folder_id"), "note_count")
    return effective_folders(folders, flt).join(n, "folder_id").agg(F.coalesce(F.sum("note_count"), F.lit(0)).cast("long").alias("n_notes"))


def stale_count(folders: DataFrame, flt: FolderFilter) -> int:
    """Selected ids that no folder has; 0 in mode all."""
    return 0 if flt.mode == "all" else len(set(flt.selected)) - _selected(folders, flt).count()


def valid_count(folders: DataFrame, flt: FolderFilter) -> int:
    """Selected ids that exist, or all selected while no folder is known."""
    return len(flt.selected) if folders.isEmpty() else _selected(folders, flt).count()


def notes_in(notes: DataFrame, folders: DataFrame, flt: FolderFilter | None = None) -> DataFrame:
    """Notes in the folders that a filter lets through; notes of unknown folders never are."""
    allowed: DataFrame = effective_folders(folders, flt)
    parent: Column = F.coalesce(notes["parent_id"], F.lit(""))
    return notes.join(allowed, parent == allowed["folder_id"], "left_semi")

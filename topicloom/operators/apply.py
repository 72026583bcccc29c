"""Applying a result as folder moves and tags, and undoing it: pure functions from tables to tables.

State: notes (note_id, title, body, parent_id), folders (folder_id, title, parent_id), tags (tag_id, title), note_tags
(note_id, tag_id). The change log is one row; each apply takes the place of the last.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions import text
from topicloom.storage import stored


@dataclass(frozen=True)
class State:
    notes: DataFrame
    folders: DataFrame
    tags: DataFrame
    note_tags: DataFrame


@dataclass(frozen=True)
class ChangeLog:
    """Per note (note_id, original_parent_id, original_parent_title, original_grandparent_id, added_tag_ids); created ids."""

    method: str
    timestamp: int
    notes: DataFrame
    created_folders: DataFrame
    created_tags: DataFrame

    def summary(self) -> str:
        label = {"both": "Notebooks & Tags", "notebooks": "Notebooks Only", "tags": "Tags Only"}[self.method]
        counts = self.notes.count(), self.created_folders.count(), self.created_tags.count()
        return f"Method: {label} | Modified Notes: {counts[0]} | Folders Created: {counts[1]} | Tags Created: {counts[2]}"

    def as_row(self) -> DataFrame:
        """The log as one JSON column, to be stored."""
        spark = self.notes.sparkSession
        base = spark.createDataFrame([(self.timestamp, self.method)], "timestamp long, method string")
        folders = self.created_folders.agg(F.collect_list("folder_id").alias("createdFolderIds"))
        tags = self.created_tags.agg(F.collect_list("tag_id").alias("createdTagIds"))
        entry = F.struct(F.col("note_id").alias("noteId"), F.col("original_parent_id").alias("originalParentId"), F.col("original_parent_title").alias("originalParentTitle"), F.col("original_grandparent_id").alias("originalParentGrandparentId"), F.col("added_tag_ids").alias("addedTagIds"))
        notes = self.notes.agg(F.collect_list(entry).alias("notes"))
        return base.crossJoin(notes).crossJoin(folders).crossJoin(tags).select(F.to_json(F.struct("timestamp", "method", "notes", "createdFolderIds", "createdTagIds")).alias("change_log"))


def new_id(*parts: Column) -> Column:
    """An id that the content fixes, so that a task run twice makes the same one."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 32)


def _last(table: DataFrame, key: str) -> Column:
    """The id of a table's last row, in the order of its ``position`` where it has one, else of the ids."""
    return F.max_by(key, F.struct("position", key)) if "position" in table.columns else F.max(key)


def tags_for(tags: DataFrame, titles: DataFrame) -> DataFrame:
    """(title_key, tag_id, title, created) for titles, in any case: existing tags' ids, else new ones. Of tags alike in
    their title the last counts."""
    have = tags.groupBy(F.lower("title").alias("title_key")).agg(_last(tags, "tag_id").alias("_id"))
    wanted = titles.select(F.lower("title").alias("title_key"), "title").groupBy("title_key").agg(F.min("title").alias("title"))
    out = wanted.join(have, "title_key", "left")
    return out.select("title_key", F.coalesce("_id", new_id(F.lit("tag"), F.col("title_key"))).alias("tag_id"), "title", F.col("_id").isNull().alias("created"))


def folders_for(folders: DataFrame, wanted: DataFrame) -> DataFrame:
    """(title, parent_id, folder_id, created) for wanted (title, parent_id): existing folders' ids, else new ones. Of
    folders alike in title and place the last counts."""
    have = folders.groupBy(F.lower("title").alias("_key"), F.col("parent_id").alias("_parent")).agg(_last(folders, "folder_id").alias("_id"))
    out = wanted.distinct().join(have, (F.lower("title") == F.col("_key")) & (F.col("parent_id") == F.col("_parent")), "left")
    return out.select("title", "parent_id", F.coalesce("_id", new_id(F.lit("folder"), F.lower("title"), F.col("parent_id"))).alias("folder_id"), F.col("_id").isNull().alias("created"))


def cluster_titles(clusters: DataFrame) -> DataFrame:
    """Clusters (cluster_id, name, tags) with a name each: Cluster n where there is none."""
    blank = F.trim(F.coalesce("name", F.lit(""))) == ""
    return clusters.where("cluster_id >= 0").withColumn("title", F.when(blank, F.concat(F.lit("Cluster "), (F.col("cluster_id") + 1).cast("string"))).otherwise(F.col("name")))


def planned_tags(notes: DataFrame, assigned: DataFrame, clusters: DataFrame) -> DataFrame:
    """(note_id, title): the cluster's tag for every clustered note, and each further tag that its text matches."""
    met = notes.join(assigned.where("cluster_id >= 0").select("note_id", "cluster_id"), "note_id").join(cluster_titles(clusters).withColumnRenamed("title", "_cluster"), "cluster_id")
    main = met.select("note_id", F.col("_cluster").alias("tag_title"))
    more = met.select("note_id", "title", "body", "_cluster", F.explode("tags").alias("tag_title")).where(F.lower("tag_title") != F.lower("_cluster"))
    more = more.where(text.matches_keyword(F.col("title"), F.col("body"), F.col("tag_title")))
    return main.unionByName(more.select("note_id", "tag_title")).withColumnRenamed("tag_title", "title")


def planned_moves(state: State, assigned: DataFrame, clusters: DataFrame, parent: str = "") -> tuple[DataFrame, DataFrame]:
    """(note_id, target) of notes that move, and the folders wanted (title, parent_id, folder_id, created)."""
    spark = state.notes.sparkSession
    top = ""
    made = spark.createDataFrame([], "title string, parent_id string, folder_id string, created boolean")
    if parent.strip():
        made = folders_for(state.folders, spark.createDataFrame([(parent.strip(), "")], "title string, parent_id string"))
        top = made.first()["folder_id"]
    wanted = cluster_titles(clusters).select("title", F.lit(top).alias("parent_id"))
    if not assigned.where("cluster_id < 0").isEmpty():
        wanted = wanted.unionByName(spark.createDataFrame([("Uncategorized", top)], "title string, parent_id string"))
    homes = folders_for(state.folders, wanted)
    # titles in any case share a folder
    key = homes.select(F.lower("title").alias("_key"), F.col("folder_id").alias("target")).groupBy("_key").agg(F.min("target").alias("target"))
    title = cluster_titles(clusters).select(F.col("cluster_id").alias("_c"), F.lower("title").alias("_title"))
    met = assigned.select("note_id", "cluster_id").join(title, F.col("cluster_id") == F.col("_c"), "left").withColumn("_title", F.when(F.col("cluster_id") < 0, "uncategorized").otherwise(F.col("_title")))
    met = met.join(key, F.col("_title") == F.col("_key")).select("note_id", "target")
    moves = state.notes.select("note_id", "parent_id").join(met, "note_id").where(~F.col("parent_id").eqNullSafe(F.col("target")))
    return moves.select("note_id", "target"), made.unionByName(homes)


def empty_folders(folders: DataFrame, notes: DataFrame) -> DataFrame:
    """Folders that hold neither a note nor a folder; those they are in are not looked at again."""
    full = notes.select(F.col("parent_id").alias("folder_id")).unionByName(folders.select(F.col("parent_id").alias("folder_id")))
    return folders.join(full, "folder_id", "left_anti")


def apply(state: State, assigned: DataFrame, clusters: DataFrame, method: str = "both", parent: str = "", timestamp: int = 0) -> tuple[State, ChangeLog]:
    """The state after moving and tagging notes as a result says, and the log that undoes it. Noise gets no tags; notes
    that are gone are passed over; folders that the moves leave empty go."""
    if method not in ("tags", "notebooks", "both"):
        raise ValueError(f"no method {method}")
    spark, after = state.notes.sparkSession, state
    none = spark.createDataFrame([], "note_id string, _tags array<string>")
    made_folders = spark.createDataFrame([], "folder_id string")
    made_tags = spark.createDataFrame([], "tag_id string")
    links, moves = none, spark.createDataFrame([], "note_id string, target string")
    if method != "notebooks":
        plan = stored(planned_tags(state.notes, assigned, clusters), "planned-tags")  # every table of the result asks for them
        ids = stored(tags_for(state.tags, plan.select("title")), "tags")
        wanted = plan.select("note_id", F.lower("title").alias("title_key")).join(ids, "title_key").select("note_id", "tag_id").distinct()
        new = stored(wanted.join(state.note_tags, ["note_id", "tag_id"], "left_anti"), "new-tags")
        made_tags = ids.where("created").select("tag_id")
        after = replace(after, tags=state.tags.unionByName(ids.where("created").select("tag_id", "title"), allowMissingColumns=True), note_tags=state.note_tags.unionByName(new))
        links = new.groupBy("note_id").agg(F.array_sort(F.collect_set("tag_id")).alias("_tags"))
    if method != "tags":
        moves, homes = (stored(t, "moves") for t in planned_moves(state, assigned, clusters, parent))
        created = homes.where("created").dropDuplicates(["folder_id"])
        made_folders = created.select("folder_id")
        moved = state.notes.join(moves, "note_id", "left").withColumn("parent_id", F.coalesce("target", "parent_id")).drop("target")
        folders = state.folders.unionByName(created.select("folder_id", "title", "parent_id"), allowMissingColumns=True)
        left = state.notes.join(moves, "note_id", "left_semi").select(F.col("parent_id").alias("folder_id")).distinct()
        gone = stored(empty_folders(folders, moved).join(left, "folder_id", "left_semi").select("folder_id"), "gone-folders")
        after = replace(after, notes=moved, folders=folders.join(gone, "folder_id", "left_anti"))
    home = state.folders.select(F.col("folder_id").alias("_home"), F.col("title").alias("_home_title"), F.col("parent_id").alias("_home_parent"))
    touched = state.notes.select("note_id", "parent_id").join(links, "note_id", "left").join(moves, "note_id", "left").where("_tags is not null or target is not null")
    touched = touched.join(home, F.col("parent_id") == F.col("_home"), "left")
    is_move = F.col("target").isNotNull()
    log = touched.select(
        "note_id", F.when(is_move, F.col("parent_id")).alias("original_parent_id"), F.when(is_move, F.col("_home_title")).alias("original_parent_title"),
        F.when(is_move, F.col("_home_parent")).alias("original_grandparent_id"), F.coalesce("_tags", F.array().cast("array<string>")).alias("added_tag_ids"),
    )
    return after, ChangeLog(method, timestamp, stored(log, "change-log"), made_folders, made_tags)


def undo(state: State, log: ChangeLog | None) -> State:
    """The state before an apply: notes back in their folders, made anew by title and place where they are gone, tags
    that were added taken off, and created folders and tags removed, folders only if nothing is in them."""
    if log is None:
        raise ValueError("nothing to undo")
    back = log.notes.where("original_parent_id is not null").select("note_id", "original_parent_id", "original_parent_title", "original_grandparent_id")
    lost = back.join(state.folders.select(F.col("folder_id").alias("original_parent_id")), "original_parent_id", "left_anti")
    made = lost.groupBy("original_parent_id").agg(F.min("original_parent_title").alias("title"), F.min("original_grandparent_id").alias("parent_id"))
    known = state.folders.select(F.col("folder_id").alias("_up"))
    made = made.join(known, F.col("parent_id") == F.col("_up"), "left").select(F.col("original_parent_id").alias("folder_id"), F.coalesce("title", F.lit("Restored")).alias("title"), F.when(F.col("_up").isNotNull() | (F.col("parent_id") == ""), F.col("parent_id")).otherwise(F.lit("")).alias("parent_id"))
    notes = state.notes.join(back.select("note_id", "original_parent_id"), "note_id", "left").withColumn("parent_id", F.coalesce("original_parent_id", "parent_id")).drop("original_parent_id")
    folders = state.folders.unionByName(made, allowMissingColumns=True)
    gone = empty_folders(folders, notes).join(log.created_folders, "folder_id", "left_semi").select("folder_id")
    added = log.notes.select("note_id", F.explode("added_tag_ids").alias("tag_id"))
    links = state.note_tags.join(added, ["note_id", "tag_id"], "left_anti").join(log.created_tags, "tag_id", "left_anti").select(*state.note_tags.columns)
    return State(notes.select(*state.notes.columns), folders.join(gone, "folder_id", "left_anti"), state.tags.join(log.created_tags, "tag_id", "left_anti"), links)


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (differing): rows that one table has oftener than the other, told by a hash of all columns of ``a``."""
    sides = [t.select(F.xxhash64(*a.columns, *(F.col(c).isNull() for c in a.columns)).alias("row"), F.lit(n).alias("n")) for t, n in ((a, 1), (b, -1))]
    rows = sides[0].unionByName(sides[1]).groupBy("row").agg(F.sum("n").alias("n"))
    return rows.agg(F.coalesce(F.sum(F.abs("n")), F.lit(0)).cast("long").alias("differing"))

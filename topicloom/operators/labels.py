"""Tags and names of clusters, from ranked n-grams (cluster_id, ngram, score, rank)."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions import text
from topicloom.functions.words import TAXONOMY
from topicloom.operators import tfidf
from topicloom.storage import stored

#: Tags are looked for first among n-grams that score this many times what one met once can, and among so many of them;
#: where those don't suffice for a cluster, among all.
FEW, LONGEST_RANKING = 32, 5_000
_ENTRY = "array<struct<ngram: string, score: double>>"


def _ranked(scores: DataFrame, most: int | None = None) -> DataFrame:
    """(cluster_id, grams): each cluster's n-grams in rank order; ranks are bounded by the cap on scored n-grams."""
    scores = scores if most is None else scores.where(F.col("rank") <= most)
    return scores.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "ngram", "score"))), lambda s: F.struct(s["ngram"].alias("ngram"), s["score"].alias("score"))).cast(_ENTRY).alias("grams"))


def without_demoted(scores: DataFrame, share: float = 0.5) -> DataFrame:
    """Ranked n-grams without single words that a longer n-gram of half their score or more contains."""
    longer = scores.where(F.col("ngram").contains(" ")).select(F.col("cluster_id").alias("_c"), F.explode(F.array_distinct(F.split("ngram", " "))).alias("_w"), F.col("score").alias("_s"))
    best = longer.groupBy("_c", "_w").agg(F.max("_s").alias("_s"))
    on = (F.col("cluster_id") == F.col("_c")) & (F.col("ngram") == F.col("_w")) & (F.col("_s") >= share * F.col("score"))
    return scores.join(best, on, "left_anti")


def _chosen(grams: Column, k: int) -> Column:
    """Greedy choice in rank order: a single word may share no word with what is chosen, a longer phrase one."""
    start = F.struct(F.array().cast("array<string>").alias("tags"), F.array().cast("array<string>").alias("used"))

    def step(acc: Column, g: Column) -> Column:
        own = F.array_distinct(F.split(g["ngram"], " "))
        shared = F.size(F.array_intersect(own, acc["used"]))
        fits = (F.size(acc["tags"]) < k) & (shared <= F.when(F.size(own) == 1, 0).otherwise(1))
        return F.when(fits, F.struct(F.concat(acc["tags"], F.array(g["ngram"])).alias("tags"), F.array_union(acc["used"], own).alias("used"))).otherwise(acc)

    return F.aggregate(grams, start, step, lambda acc: acc["tags"])


def tags(scores: DataFrame, k: int = 5) -> DataFrame:
    """(cluster_id, tags): up to ``k`` tags that don't repeat each other's words."""
    return _ranked(without_demoted(scores)).select("cluster_id", _chosen(F.col("grams"), k).alias("tags"))


def cluster_tags(notes: DataFrame, assigned: DataFrame | None = None, k: int = 5) -> DataFrame:
    """``tags`` of notes' clusters by the n-grams of whole bodies."""
    scored = tfidf.full_scores(notes, assigned)
    # what scores under half of the least that counts can't demote it
    for least, most in ((F.col("once") * FEW, LONGEST_RANKING), (F.lit(0.0), None)):
        near = stored(scored.where(F.col("score") >= 0.5 * least), "scores").withColumn("rank", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("score"), "first")))
        kept = without_demoted(near).where(F.col("score") >= least)
        found = notes_clusters(notes, assigned).join(_ranked(kept, most).select("cluster_id", _chosen(F.col("grams"), k).alias("tags")), "cluster_id", "left")
        found = stored(found, "tags")
        if found.where(F.col("tags").isNull() | (F.size("tags") < k)).isEmpty():
            break
    return found.where("tags is not null")


def notes_clusters(notes: DataFrame, assigned: DataFrame | None) -> DataFrame:
    """(cluster_id) of every cluster that has notes."""
    return (notes if assigned is None else assigned).where("cluster_id >= 0").select("cluster_id").distinct()


def taxonomy(scores: DataFrame) -> DataFrame:
    """(cluster_id, category) of clusters one of whose three best n-grams holds a keyword: the best such n-gram decides,
    then the order of the categories."""
    spark = scores.sparkSession
    rows = [(keyword, category, order) for order, (category, keywords) in enumerate(TAXONOMY) for keyword in keywords]
    keywords = F.broadcast(spark.createDataFrame(rows, "keyword string, category string, ord int"))
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy("rank"))
    top = scores.withColumn("_place", place).where("_place <= 3")
    held = top.select("cluster_id", "_place", F.explode(F.array_distinct(F.split(F.lower("ngram"), " "))).alias("keyword"))
    return held.join(keywords, "keyword").groupBy("cluster_id").agg(F.min_by("category", F.struct("_place", "ord")).alias("category"))


def names(scores: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster_id, name) for every row of ``clusters(cluster_id)``: the taxonomy's category, else the best n-gram, with
    the next that shares no word and has 60 % of its score; without n-grams General or Miscellaneous."""
    kept = without_demoted(scores)
    grams = _ranked(kept)
    best = F.col("grams")[0]
    rest = F.filter(F.slice("grams", F.lit(2), F.greatest(F.size("grams") - 1, F.lit(0))), lambda g: (g["score"] > 0) & ~text.share_words(best["ngram"], g["ngram"]))
    second = F.when(F.size(rest) > 0, rest[0])
    pair = F.concat(text.title_case(best["ngram"]), F.lit(" & "), text.title_case(second["ngram"]))
    own = F.when(second["score"] >= best["score"] * 0.6, pair).otherwise(text.title_case(best["ngram"]))
    plain = F.when(F.pmod(F.col("cluster_id"), F.lit(2)) == 0, "General").otherwise("Miscellaneous")
    met = clusters.select("cluster_id").join(grams, "cluster_id", "left").join(taxonomy(kept), "cluster_id", "left")
    bare = F.col("grams").isNull() | (F.size("grams") == 0) | (best["score"] <= 0)
    return met.select("cluster_id", F.when(bare, plain).otherwise(F.coalesce("category", own)).alias("name"))


def told_apart(named: DataFrame, scores: DataFrame) -> DataFrame:
    """Names that several clusters have get their best n-gram in brackets, and a number from 2 on where even that repeats,
    in the order of ids; without an n-gram of positive score a name stays."""
    kept = without_demoted(scores)
    best = _ranked(kept, None).select("cluster_id", F.col("grams")[0].alias("best")).where("best.score > 0").select("cluster_id", text.title_case(F.col("best.ngram")).alias("topic"))
    n = named.groupBy("name").agg(F.count("*").alias("n"))
    met = named.join(n, "name").join(best, "cluster_id", "left")
    changes = (F.col("n") > 1) & F.col("topic").isNotNull()
    met = met.withColumn("changes", changes).withColumn("resolved", F.when(changes, F.concat("name", F.lit(" ("), "topic", F.lit(")"))).otherwise(F.col("name")))
    taken = met.where("n = 1").select(F.col("name").alias("_taken")).distinct()
    place = F.row_number().over(Window.partitionBy("resolved").orderBy("cluster_id"))
    numbered = met.where("changes").withColumn("place", place).join(taken, F.col("resolved") == F.col("_taken"), "left")
    place = F.col("place") + F.when(F.col("_taken").isNotNull(), 1).otherwise(0)
    numbered = numbered.select("cluster_id", F.when(place > 1, F.concat_ws(" ", "resolved", place.cast("string"))).otherwise(F.col("resolved")).alias("name"))
    return numbered.unionByName(met.where("not changes").select("cluster_id", "name"))


def numbered_collisions(named: DataFrame) -> DataFrame:
    """Repeated names: the lowest id keeps it, the next get 2, 3 and so on."""
    place = F.row_number().over(Window.partitionBy("name").orderBy("cluster_id"))
    return named.withColumn("_place", place).select("cluster_id", F.when(F.col("_place") > 1, F.concat_ws(" ", "name", F.col("_place").cast("string"))).otherwise(F.col("name")).alias("name"))


def sample_titles(notes: DataFrame, assigned: DataFrame, most: int = 6) -> DataFrame:
    """(cluster_id, n_notes, titles): the first titles of more than two characters, in note order."""
    met = notes.join(assigned.where("cluster_id >= 0").select("note_id", "cluster_id"), "note_id").withColumn("_title", text.trim(F.coalesce("title", F.lit(""))))
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy("note_idx"))
    picked = met.where(F.length("_title") > 2).withColumn("_place", place).where(F.col("_place") <= most)
    titles = picked.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", "_title"))), lambda s: s["_title"]).alias("titles"))
    return met.groupBy("cluster_id").agg(F.count("*").alias("n_notes")).join(titles, "cluster_id", "left").withColumn("titles", F.coalesce("titles", F.array().cast("array<string>")))


#: Seconds that a model may take to name one strategy's clusters.
ASK_SECONDS = 45.0


def _asked(ask: Callable[[list[dict]], str], prompt: list[dict], seconds: float) -> str:
    """The model's answer, or ``TimeoutError``; a thread that hangs is left behind."""
    answer: list = []

    def run() -> None:
        try:
            answer.append(ask(prompt))
        except Exception as e:
            answer.append(e)

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if not answer:
        raise TimeoutError(f"no names within {seconds} seconds")
    if isinstance(answer[0], Exception):
        raise answer[0]
    return answer[0]


def renamed_by(named: DataFrame, summaries: DataFrame, tagged: DataFrame, ask: Callable[[list[dict]], str] | None, seconds: float = ASK_SECONDS) -> DataFrame:
    """Names from a model that answers messages, or ``named`` as it is without one or after any failure, such as an
    answer that takes too long.

    One row per cluster reaches the driver.
    """
    if ask is None:
        return named
    rows = summaries.join(tagged, "cluster_id", "left").orderBy("cluster_id").collect()
    if not any(r["titles"] for r in rows):
        return named
    prompt = text.naming_prompt([{"cluster_id": r["cluster_id"], "n_notes": r["n_notes"], "titles": r["titles"], "keywords": (r["tags"] or [])[:3]} for r in rows])
    try:
        given = text.parse_names(_asked(ask, prompt, seconds), [r["cluster_id"] for r in rows])
    except Exception:
        given = None
    if not given:
        return named
    new = named.sparkSession.createDataFrame(list(given.items()), "cluster_id int, _new string")
    return numbered_collisions(named.join(F.broadcast(new), "cluster_id", "left").select("cluster_id", F.coalesce("_new", "name").alias("name")))

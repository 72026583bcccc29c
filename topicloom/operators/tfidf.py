"""N-gram TF-IDF of clusters of notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions import text
from topicloom.operators import grams
from topicloom.storage import stored

TITLE_WEIGHT = 5
BODY_CHARS = 3000
COMMON = 0.6  # share of notes from which on an n-gram says nothing
KEPT = 100  # most frequent n-grams of a cluster that are scored


def corpus_ngrams(notes: DataFrame, body_chars: int | None = BODY_CHARS, body_longest: int = 2) -> DataFrame:
    """(note_id, note_idx, in_title, pos, ngram) of notes (note_id, note_idx, title, body): titles up to trigrams, bodies
    up to bigrams of their first characters; ``pos`` orders by segment, word and length. No shuffle: n-grams are made
    inside each row, a segment at a time, so that text goes through compiled code.
    """
    body = F.substring("body", 1, body_chars) if body_chars is not None else F.col("body")
    parts = F.array(F.struct(F.lit(True).alias("in_title"), text.segments(F.col("title")).alias("s")), F.struct(F.lit(False).alias("in_title"), text.segments(body).alias("s")))
    each = notes.select("note_id", "note_idx", F.explode(parts).alias("p")).select("note_id", "note_idx", "p.in_title", F.posexplode("p.s").alias("seg", "s"))
    tokens = each.select("note_id", "note_idx", "in_title", "seg", text.tokenize(F.col("s")).alias("t")).where(F.size("t") > 0)
    longest = max(3, body_longest)
    grams = text.grams_by_length(F.col("t"), longest)
    if body_longest < longest:
        grams = F.slice(grams, F.lit(1), F.when(F.col("in_title"), longest).otherwise(body_longest))
    by_length = tokens.select("note_id", "note_idx", "in_title", "seg", F.posexplode(grams).alias("n", "g"))
    out = by_length.select("note_id", "note_idx", "in_title", "seg", "n", F.posexplode("g").alias("i", "ngram")).where("ngram is not null")
    return out.select("note_id", "note_idx", "in_title", F.struct("seg", "i", "n").alias("pos"), "ngram")


def note_ngrams(grams: DataFrame) -> DataFrame:
    """(note_id, ngram, tf, in_title, first): each note's n-grams, titles counted 5-fold.

    ``first`` orders n-grams by their first occurrence: by note, title before body, position. This is what documents'
    frequencies and clusters' counts are both made of; stored once, it saves going over the texts again.
    """
    first = F.min(F.struct("note_idx", (~F.col("in_title")).alias("body"), "pos"))
    return grams.groupBy("note_id", "ngram").agg(F.sum(F.when(F.col("in_title"), TITLE_WEIGHT).otherwise(1)).alias("tf"), F.max("in_title").alias("in_title"), first.alias("first"))


def idf(counted: DataFrame, n_notes: int) -> DataFrame:
    """(ngram, df, idf) of ``note_ngrams``: ln(N / df) + 1, or 0 for n-grams of more than ``COMMON`` of all notes."""
    n = F.lit(n_notes)
    df = counted.groupBy("ngram").agg(F.count("*").alias("df"))
    return df.withColumn("idf", F.when(F.col("df") / n > COMMON, 0.0).otherwise(F.log(n / F.col("df")) + 1))


def cluster_counts(counted: DataFrame, assigned: DataFrame) -> DataFrame:
    """(cluster_id, ngram, tf, n_docs, in_title, first) of ``note_ngrams``, and the cluster's total of tf.

    Counting goes by (cluster, n-gram) at once, so a large cluster is spread over all tasks.
    """
    met = counted.join(assigned.where("cluster_id >= 0").select("note_id", "cluster_id"), "note_id")
    per = met.groupBy("cluster_id", "ngram").agg(F.sum("tf").alias("tf"), F.count("*").alias("n_docs"), F.max("in_title").alias("in_title"), F.min("first").alias("first"))
    total = per.groupBy("cluster_id").agg(F.sum("tf").alias("total"))
    return per.join(total, "cluster_id")


def most_frequent(counts: DataFrame, kept: int = KEPT) -> DataFrame:
    """The ``kept`` n-grams of most occurrences in each cluster, ties to the first met; with their rank."""
    place = Window.partitionBy("cluster_id").orderBy(F.desc("tf"), "first")
    return counts.withColumn("tf_rank", F.row_number().over(place)).where(F.col("tf_rank") <= kept)


def scores(n_notes: int, counted: DataFrame, assigned: DataFrame, kept: int | None = KEPT, corpus: DataFrame | None = None) -> DataFrame:
    """(cluster_id, ngram, score, rank): tf * idf * share of the cluster's notes * length factor * title factor.

    ``counted`` are ``note_ngrams``, best stored; ``corpus`` are those that give document frequencies, where they are
    made by other rules, as in the variant without caps.
    """
    counts = stored(cluster_counts(counted, assigned), "cluster-counts")
    if kept is not None:
        many = counts.groupBy("cluster_id").agg((F.count("*") > kept).alias("many"))
        counts = most_frequent(counts, kept).join(F.broadcast(many), "cluster_id")  # a row per cluster
    else:
        counts = counts.withColumn("many", F.lit(False)).withColumn("tf_rank", F.lit(0))
    size = assigned.where("cluster_id >= 0").groupBy("cluster_id").agg(F.count("*").alias("size"))
    return _scored(counts, idf(counted if corpus is None else corpus, n_notes), size)


def _length() -> Column:
    """The factor of an n-gram's length."""
    n_words = F.size(F.split("ngram", " "))
    return F.when(n_words == 1, F.when(F.length("ngram") <= 4, 0.5).otherwise(1.0)).when(n_words == 2, 1.5).otherwise(2.0)


def _scored(counts: DataFrame, known: DataFrame, size: DataFrame) -> DataFrame:
    """(cluster_id, ngram, score, rank) of counts with their cluster's total; ``size`` has a row per cluster."""
    score = F.col("tf") / F.col("total") * F.col("idf") * (F.col("n_docs") / F.col("size")) * _length() * F.when(F.col("in_title"), 1.5).otherwise(1.0)
    out = counts.join(known.where("idf > 0").select("ngram", "idf"), "ngram").join(F.broadcast(size), "cluster_id").withColumn("score", score)
    place = Window.partitionBy("cluster_id").orderBy(F.desc("score"), F.when(F.col("many"), F.col("tf_rank")), "first")
    return out.withColumn("rank", F.row_number().over(place)).select("cluster_id", "ngram", "score", "rank")


def note_scores(notes: DataFrame, assigned: DataFrame | None = None, body_chars: int | None = BODY_CHARS, kept: int = KEPT) -> DataFrame:
    """``scores`` of notes' clusters, stored: labels read them several times. Without ``assigned`` notes have a cluster_id."""
    if assigned is not None:
        notes = notes.drop("cluster_id").join(assigned.select("note_id", "cluster_id"), "note_id", "left")
    counts, clusters = grams.most_frequent(notes, body_chars, kept, TITLE_WEIGHT)
    counts, n = stored(counts, "cluster-counts"), F.lit(notes.count())
    df = counts.groupBy("ngram").agg(F.sum("n_docs").alias("df"))
    known = df.withColumn("idf", F.when(F.col("df") / n > COMMON, 0.0).otherwise(F.log(n / F.col("df")) + 1))
    size = notes.where("cluster_id >= 0").groupBy("cluster_id").agg(F.count("*").alias("size"))
    best = most_frequent(counts.where("cluster_id >= 0"), kept).join(F.broadcast(clusters), "cluster_id")  # a row per cluster
    return stored(_scored(best, known, size), "scores")


def full_scores(notes: DataFrame, assigned: DataFrame | None = None) -> DataFrame:
    """(cluster_id, ngram, score, first, once) of the variant over whole bodies, with trigrams there too and without the cap on
    n-grams; document frequencies stay those of the capped ones. ``once`` is the most that an n-gram met once in a
    body can score. Without ``assigned`` notes have a cluster_id."""
    if assigned is not None:
        notes = notes.drop("cluster_id").join(assigned.select("note_id", "cluster_id"), "note_id", "left")
    n = F.lit(notes.count())
    size = notes.where("cluster_id >= 0").groupBy("cluster_id").agg(F.count("*").alias("size"))
    about = stored(grams.totals(notes, 3, TITLE_WEIGHT).join(size, "cluster_id"), "cluster-sizes")  # a row per cluster
    out = grams.every(notes, 3, BODY_CHARS, TITLE_WEIGHT).where(F.col("df") / n <= COMMON).join(F.broadcast(about), "cluster_id")
    score = F.col("tf") / F.col("total") * (F.log(n / F.col("df")) + 1) * (F.col("n_docs") / F.col("size")) * _length() * F.when(F.col("in_title"), 1.5).otherwise(1.0)
    return out.select("cluster_id", "ngram", score.alias("score"), F.struct("first_note", "first_pos").alias("first"), (2 * (F.log(n) + 1) / F.col("total") / F.col("size")).alias("once"))

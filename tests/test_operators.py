"""Folder trees, cache, clustering, labels, apply and undo."""

import numpy as np
import pytest

from topicloom.operators import apply as applying
from topicloom.operators import cache, clustering, fits, labels, results, tfidf, tree
from topicloom.operators.tree import FolderFilter


@pytest.fixture(scope="module")
def folders(spark):
    rows = [("a", "Alpha", ""), ("b", "Beta", "a"), ("c", "Gamma", "b"), ("d", "Delta", ""), ("e", "Eta", "gone"), ("x", "Loop", "y"), ("y", "Pool", "x")]
    return spark.createDataFrame(rows, "folder_id string, title string, parent_id string").cache()


def ids(df):
    return sorted(r["folder_id"] for r in df.collect())


def test_folder_filters(spark, folders):
    assert ids(tree.descendants(folders, spark.createDataFrame([("a",), ("x",)], "folder_id string"))) == ["a", "b", "c", "x", "y"]
    assert ids(tree.effective_folders(folders, FolderFilter("include", ("b", "gone")))) == ["b", "c"]
    assert ids(tree.effective_folders(folders, FolderFilter("include", ("b",), False))) == ["b"]
    assert ids(tree.effective_folders(folders, FolderFilter("include"))) == []
    assert ids(tree.effective_folders(folders, FolderFilter("exclude", ("a",)))) == ["d", "e", "x", "y"]
    assert len(ids(tree.effective_folders(folders, FolderFilter("exclude")))) == 7
    assert ids(tree.visible_folders(folders, " gam ")) == ["a", "b", "c"]
    assert {r["folder_id"] for r in tree.folder_tree(folders).where("is_root").collect()} == {"a", "d", "e"}
    assert tree.stale_count(folders, FolderFilter("include", ("a", "gone"))) == 1
    assert FolderFilter.parse('{"mode":"include","selectedFolderIds":["a"],"includeSubNotebooks":false}') == FolderFilter("include", ("a",), False)
    assert FolderFilter.parse("{") == FolderFilter.parse('{"mode":"x"}') == FolderFilter()


def test_ranges():
    assert [clustering.k_range(n) for n in (0, 1, 2, 8, 19, 20, 100, 500, 1000, 2000, 3000, 5000, 10000)] == [(1, 1), (1, 1), (2, 2), (2, 4), (2, 9), (3, 7), (3, 15), (3, 34), (3, 48), (3, 81), (3, 109), (3, 160), (3, 200)]
    c = clustering.config_for(100)
    assert (c.neighbours, c.strategies[1].min_cluster_size, c.strategies[1].min_samples) == (10, 10, 5)
    assert clustering.neighbours_for(float("nan")) == 5


def table_of(spark, x):
    return spark.createDataFrame([(k, k, v.tolist()) for k, v in enumerate(x)], "note_id long, note_idx long, vector array<double>").repartition(3)


def test_silhouette_takes_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x, label = rng.normal(0, 1, (700, 6)), rng.integers(0, 4, 700)
    x[:40] = x[0]
    points = table_of(spark, x).join(spark.createDataFrame(list(enumerate(label.tolist())), "note_id long, cluster_id int"), "note_id")
    monkeypatch.setattr(clustering, "CHUNK_NUMBERS", 3_000)
    for metric in ("euclidean", "cosine"):
        found = clustering.exact_silhouette(points, metric).first()
        assert found["n"] == 700 and found["silhouette"] == pytest.approx(clustering.silhouette_of_all(x, label, metric), abs=1e-9)
    assert clustering.sampled_silhouette(points).first()["n"] <= 502


def test_hdbscan_of_more_points_than_a_fit_takes(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 1, (60, 3)) for c in (0, 4, 9)] + [np.ones((20, 3))])
    want = clustering.hdbscan(x, 6).tolist()
    monkeypatch.setattr(fits, "FIT_POINTS", 40)
    assert labels_of(fits.hdbscan(table_of(spark, x), 6)) == want


def texts(spark):
    rng = np.random.default_rng(3)
    known = ["garden", "walls", "box's", "classes", "the", "stories", "reading", "km", "berries", "gas", "don’t", "<b>", "`code`", "stone.", "river,", "Été", "glass\n", "tree;"]
    rows = [(str(k), k, " ".join(rng.choice(known, 4)), " ".join(rng.choice(known, int(rng.integers(0, 40)))) + (" filler" * 500 + " hidden words" if k % 5 == 0 else ""), None if k % 11 == 0 else k % 3) for k in range(60)]
    return spark.createDataFrame(rows, "note_id string, note_idx long, title string, body string, cluster_id int").repartition(3)


def test_scores_of_whole_texts(spark):
    notes = texts(spark)
    assigned = notes.where("cluster_id is not null").select("note_id", "cluster_id")
    for chars in (None, 3000):
        want = tfidf.scores(60, tfidf.note_ngrams(tfidf.corpus_ngrams(notes, chars)), assigned, 12)
        for found in (tfidf.note_scores(notes, body_chars=chars, kept=12), tfidf.note_scores(notes, assigned, chars, 12)):
            assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    held = {r["ngram"] for r in tfidf.note_scores(notes, body_chars=None, kept=1000).collect()}
    assert {"hidden", "hidden word"} <= held and "hidden" not in {r["ngram"] for r in tfidf.note_scores(notes, kept=1000).collect()}


def test_full_scores_and_tags(spark, monkeypatch):
    notes = texts(spark)
    assigned = notes.where("cluster_id is not null").select("note_id", "cluster_id")
    counted, corpus = (tfidf.note_ngrams(g) for g in (tfidf.corpus_ngrams(notes, None, 3), tfidf.corpus_ngrams(notes)))
    want = tfidf.scores(60, counted, assigned, None, corpus)
    ranked = [(r["cluster_id"], r["ngram"], pytest.approx(r["score"], rel=1e-12)) for r in want.orderBy("cluster_id", "ngram").collect()]
    for found in (tfidf.full_scores(notes), tfidf.full_scores(notes, assigned)):
        assert [(r["cluster_id"], r["ngram"], r["score"]) for r in found.orderBy("cluster_id", "ngram").collect()] == ranked
    tags = sorted(map(tuple, labels.tags(want).collect()))
    for few in (labels.FEW, 4, 1e9):
        monkeypatch.setattr(labels, "FEW", few)
        assert sorted(map(tuple, labels.cluster_tags(notes, assigned).collect())) == tags


def labels_of(df):
    return [r["cluster_id"] for r in df.orderBy("note_idx").collect()]


def test_clusters_of_blobs(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 1, (10, 2)) for c in (0, 100, 200)])
    k, score, found = fits.sweep_k(table_of(spark, x))
    found = labels_of(found)
    assert k == 3 and score > 0.9 and len(set(found[:10])) == 1
    assert found == clustering.seeded_kmeans(x, 3, seed=45).tolist() and score == pytest.approx(clustering.silhouette(x, found))
    assert clustering.silhouette(x, np.zeros(30)) == 0 and len(set(clustering.hdbscan(x, 5).tolist()) - {-1}) == 3
    assert (clustering.seeded_kmeans(x, 40) == np.arange(30)).all() and (clustering.hdbscan(x[:4], 5) == -1).all()
    y = clustering.umap(x, 2, 5, metric="euclidean")
    assert np.array_equal(y, clustering.umap(x, 2, 5, metric="euclidean")) and clustering.silhouette(y, np.repeat([0, 1, 2], 10)) > 0.5
    assert fits.sweep_k(table_of(spark, np.ones((10, 2))))[:2] == (1, 0.0)
    with pytest.raises(ValueError):
        clustering.seeded_kmeans(x[:0], 3)


def test_tables_equal_the_fits_in_memory(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3)) + np.repeat(rng.normal(0, 3, (6, 3)), 10, 0)
    points = table_of(spark, x)
    found = fits.kmeans(points, 60, [2, 5, 9])
    for k, (centres, sizes) in found.items():
        want = clustering.seeded_kmeans(x, k, seed=42 + k)
        assert labels_of(fits.labelled(points, centres)) == want.tolist() and sizes.tolist() == np.bincount(want, minlength=k).tolist()
    scores = {r["k"]: r["score"] for r in fits.silhouettes(points, 60, found).collect()}
    assert scores == {k: pytest.approx(clustering.silhouette(x, clustering.seeded_kmeans(x, k, seed=42 + k))) for k in found}
    assert labels_of(fits.hdbscan(points, 5, metric="cosine")) == clustering.hdbscan(x, 5, metric="cosine").tolist()
    laid = np.array([r["vector"] for r in fits.umap(points, 2, 5).orderBy("note_idx").collect()])
    assert np.allclose(laid, clustering.umap(x, 2, 5))


def test_points_beyond_the_fit_get_labels_and_places(spark, monkeypatch):
    from topicloom.plans import topics

    monkeypatch.setattr(fits, "FIT_POINTS", 50)
    monkeypatch.setattr(clustering, "SILHOUETTE_SAMPLE", 40)
    rng = np.random.default_rng(0)
    truth = np.arange(150) % 3
    x = rng.normal(0, 1, (150, 3)) + np.array([[0, 0, 0], [50, 0, 0], [0, 50, 0]])[truth]
    points = table_of(spark, x)
    k, score, found = fits.sweep_k(points)
    assert k == 3 and score > 0.9 and len(set(zip(labels_of(found), truth.tolist()))) == 3
    got = np.array(labels_of(fits.hdbscan(points, 5)))
    assert (got >= 0).mean() > 0.7 and len(set(zip(got[got >= 0].tolist(), truth[got >= 0].tolist()))) == 3
    laid = np.array([r["vector"] for r in fits.umap(points, 2, 5, metric="euclidean").orderBy("note_idx").collect()])
    assert laid.shape == (150, 2) and clustering.silhouette_of_all(laid, truth) > 0.5
    config = clustering.Config(metric="euclidean", dimensions=None, strategies=(*clustering.config_for(150).strategies, clustering.Strategy("three", "kmeans", 3), clustering.Strategy("none", "other")))
    results = topics.benchmark(points, config)
    assert {(r.strategy.name, r.clusters) for r in results} == {("kmeans-auto", 3), ("hdbscan", 3), ("three", 3)}
    assert all(r.score > 0.9 for r in results) and {r.labels.count() for r in results} == {150}


def test_sweep_of_points_in_hand_takes_no_rounds_over_the_table(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 3)) + np.repeat(rng.normal(0, 3, (7, 3)), 100, 0)
    points, rounds = table_of(spark, x), []
    by_rounds = fits._round
    monkeypatch.setattr(fits, "_round", lambda *a: rounds.append(1) or by_rounds(*a))
    k, score, found = fits.sweep_k(points)
    found = labels_of(found)
    assert not rounds and found == clustering.seeded_kmeans(x, k, seed=42 + k).tolist()
    monkeypatch.setattr(fits, "HELD_NUMBERS", 0)
    other = fits.sweep_k(points)
    assert rounds and other[:2] == (k, pytest.approx(score)) and labels_of(other[2]) == found


def test_lloyd_with_ties_copies_and_empty_clusters():
    from topicloom.functions.prng import mulberry32

    rng = np.random.default_rng(4)
    grid = np.array([(a, b) for a in range(20) for b in range(20)], float)
    some, copies = rng.normal(size=(2_500, 8)), np.repeat(rng.normal(size=(30, 5)), 20, 0)
    for x, k, metric in ((grid, 9, "euclidean"), (copies, 40, "euclidean"), (some, 50, "euclidean"), (some, 20, "cosine")):
        draw = mulberry32(k)
        centres, label = clustering.lloyd(x, clustering.seed_centres(x, k, metric, draw), metric, draw)
        assert label.tolist() == clustering.seeded_kmeans(x, k, metric, seed=k).tolist()
        assert clustering.nearest(x, centres, metric).tolist() == label.tolist()


def test_topics_of_notes(spark):
    from topicloom.plans import topics

    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 1, (10, 3)) for c in (0, 50, 100)])
    subject = ["sourdough bread", "docker image", "mountain hike"]
    notes = spark.createDataFrame([(str(k), k, f"{subject[k // 10]} {'abc'[k % 3]}", f"words on {subject[k // 10]}, and more.") for k in range(30)], "note_id string, note_idx long, title string, body string")
    points = spark.createDataFrame([(str(k), v.tolist()) for k, v in enumerate(x)], "note_id string, vector array<double>")
    config = clustering.Config(metric="euclidean", dimensions=None, strategies=clustering.config_for(30).strategies)
    asked = []
    got = topics.run(notes, points, lambda prompt: asked.append(prompt) or '{"0": "A", "1": "B", "2": "C"}', config=config)
    assert {r["strategy"]: r["clusters"] for r in got.summary.collect()} == {"kmeans-auto": 3, "hdbscan": 3} and len(asked) == 2
    rows = got.clusters.collect()
    assert len(rows) == 6 and {r["name"] for r in rows} == {"A", "B", "C"} and all(r["size"] == 10 and r["tags"] for r in rows)
    assert got.assignments.count() == 60
    with pytest.raises(ValueError):
        topics.run(notes.limit(2), points)


def test_topics_are_labelled_without_a_row_per_ngram(spark, monkeypatch):
    from topicloom.plans import topics

    notes = texts(spark).drop("cluster_id")
    points = spark.createDataFrame([(str(k), np.random.default_rng(k).normal(30 * (k % 3), 1, 3).tolist()) for k in range(50)], "note_id string, vector array<double>")
    config = clustering.Config(metric="euclidean", dimensions=None, strategies=clustering.config_for(50).strategies)
    made, rows = [], tfidf.note_ngrams
    monkeypatch.setattr(tfidf, "note_ngrams", lambda g: made.append(1) or rows(g))
    got = topics.run(notes, points, config=config)
    found = sorted(map(tuple, got.clusters.select("strategy", "cluster_id", "size", "name", "tags").collect()))
    assert not made and len(found) == 6
    want = []
    counted = tfidf.note_ngrams(tfidf.corpus_ngrams(notes.where("note_idx < 50")))
    for strategy in ("kmeans-auto", "hdbscan"):
        own = got.assignments.where(f"strategy = '{strategy}'")
        scored = tfidf.scores(50, counted, own).cache()
        named = labels.told_apart(labels.names(scored, own.select("cluster_id").distinct()), scored).join(labels.tags(scored), "cluster_id")
        sizes = {r["cluster_id"]: r["count"] for r in own.groupBy("cluster_id").count().collect()}
        want += [(strategy, r["cluster_id"], sizes[r["cluster_id"]], r["name"], r["tags"]) for r in named.collect()]
    assert found == sorted(want)


def test_labels(spark):
    rows = [(0, "machine learning", 1.0, 1), (0, "learning", 0.9, 2), (0, "neural net", 0.7, 3), (0, "learning rate", 0.4, 4), (1, "sourdough", 1.0, 1), (2, "learning", 1.0, 1), (3, "learning", 2.0, 1)]
    s = spark.createDataFrame(rows, "cluster_id int, ngram string, score double, rank int")
    assert {r["cluster_id"]: r["tags"] for r in labels.tags(s).collect()}[0] == ["machine learning", "neural net", "learning rate"]
    every = spark.createDataFrame([(k,) for k in range(6)], "cluster_id int")
    named = labels.names(s, every)
    got = {r["cluster_id"]: r["name"] for r in named.collect()}
    assert got == {0: "Machine Learning & Neural Net", 1: "Recipes", 2: "Learning", 3: "Learning", 4: "General", 5: "Miscellaneous"}
    apart = {r["cluster_id"]: r["name"] for r in labels.told_apart(named, s).collect()}
    assert (apart[2], apart[3], apart[1]) == ("Learning (Learning)", "Learning (Learning) 2", "Recipes")


def test_apply_and_undo(spark):
    notes = spark.createDataFrame([("1", "Cats", "about cats", "f"), ("2", "Dogs", "bark", "f"), ("3", "?", "", "g")], "note_id string, title string, body string, parent_id string")
    folders = spark.createDataFrame([("f", "Old", ""), ("g", "Keep", "")], "folder_id string, title string, parent_id string")
    tags = spark.createDataFrame([("t", "ANIMALS")], "tag_id string, title string")
    state = applying.State(notes, folders, tags, spark.createDataFrame([("2", "t")], "note_id string, tag_id string"))
    assigned = spark.createDataFrame([("1", 0), ("2", 0), ("3", -1), ("9", 0)], "note_id string, cluster_id int")
    clusters = spark.createDataFrame([(0, "Animals", ["cats", "missing"])], "cluster_id int, name string, tags array<string>")
    after, log = applying.apply(state, assigned, clusters)
    assert {r["title"] for r in after.folders.collect()} == {"Animals", "Uncategorized"}
    assert {(r["note_id"], r["title"]) for r in after.note_tags.join(after.tags, "tag_id").collect()} == {("1", "ANIMALS"), ("2", "ANIMALS"), ("1", "cats")}
    assert log.summary() == "Method: Notebooks & Tags | Modified Notes: 3 | Folders Created: 2 | Tags Created: 1"
    back = applying.undo(after, log)
    for name in ("notes", "folders", "tags", "note_tags"):
        a, b = (sorted(map(tuple, getattr(s, name).collect())) for s in (state, back))
        assert a == b, name
    with pytest.raises(ValueError):
        applying.undo(state, None)


def test_cache_versions(spark, tmp_path):
    c = cache.VectorCache(spark, f"file://{tmp_path}/cache", "note_id string, hash string")
    assert c.read().count() == 0
    c.upsert(spark.createDataFrame([("1", "a"), ("2", "b")], "note_id string, hash string"))
    c.upsert(spark.createDataFrame([("2", "c")], "note_id string, hash string"))
    assert sorted(map(tuple, c.read().collect())) == [("1", "a"), ("2", "c")]
    assert c.reconcile(spark.createDataFrame([("2",)], "note_id string")) == 1 and c.read().count() == 1


def test_edits(spark):
    clusters = spark.createDataFrame([(0, "A", ["x"]), (1, "B", [])], "cluster_id int, name string, tags array<string>")
    assert results.add_cluster(clusters, " C ").where("cluster_id = 2").first()["name"] == "C"
    with pytest.raises(ValueError):
        results.add_cluster(clusters, "a")
    assert results.default_strategy(["hdbscan", "kmeans-auto"]) == 1


def test_last_of_alike_titles_counts(spark):
    tags = spark.createDataFrame([("z", "Cat", 0), ("a", "CAT", 1), ("b", "dog", 2)], "tag_id string, title string, position int")
    wanted = spark.createDataFrame([("cat",), ("Bird",)], "title string")
    got = {r["title_key"]: (r["tag_id"], r["created"]) for r in applying.tags_for(tags, wanted).collect()}
    assert got["cat"] == ("a", False) and got["bird"][1]
    assert {r["title_key"]: r["tag_id"] for r in applying.tags_for(tags.drop("position"), wanted).collect()}["cat"] == "z"
    folders = spark.createDataFrame([("y", "Old", "", 0), ("b", "OLD", "", 1), ("c", "old", "y", 2)], "folder_id string, title string, parent_id string, position int")
    got = applying.folders_for(folders, spark.createDataFrame([("old", ""), ("old", "q")], "title string, parent_id string"))
    assert {(r["parent_id"], r["created"]): r["folder_id"] for r in got.collect()}["", False] == "b" and got.where("created").count() == 1


def test_slow_and_failing_models_keep_names(spark):
    import time

    named = spark.createDataFrame([(0, "A"), (1, "B")], "cluster_id int, name string")
    summaries = spark.createDataFrame([(0, 3, ["one title"]), (1, 2, ["two"])], "cluster_id int, n_notes long, titles array<string>")
    tagged = spark.createDataFrame([(0, ["t"])], "cluster_id int, tags array<string>")
    names = lambda ask, s=5.0: [r["name"] for r in labels.renamed_by(named, summaries, tagged, ask, s).orderBy("cluster_id").collect()]
    assert names(lambda p: '{"0": "X", "1": "X"}') == ["X", "X 2"]
    assert names(lambda p: time.sleep(3) or '{"0": "X", "1": "Y"}', 0.2) == names(lambda p: 1 / 0) == names(lambda p: "?") == ["A", "B"]


def test_session(spark):
    from topicloom.plans.session import Busy, Session, Settings, percent

    assert [percent(1, 3), percent(1, 8), percent(0, 0), percent(5, 5)] == [33, 13, 0, 100]
    kept = Settings("Top", "tags", FolderFilter("include", ("a",), False))
    assert Settings.of_json(kept.to_json()) == kept and Settings.of_json("{") == Settings.of_json('{"method": "x", "filter": 3}') == Settings()
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 1, (8, 3)) for c in (0, 60)])
    subject = ["garden soil", "engine oil"]
    notes = spark.createDataFrame([(str(k), k, f"{subject[k // 8]} {k}", f"about {subject[k // 8]}", "f" if k != 3 else "g") for k in range(16)], "note_id string, note_idx long, title string, body string, parent_id string")
    folders = spark.createDataFrame([("f", "Old", ""), ("g", "Else", "")], "folder_id string, title string, parent_id string")
    none = spark.createDataFrame([], "tag_id string, title string"), spark.createDataFrame([], "note_id string, tag_id string")
    points = spark.createDataFrame([(str(k), v.tolist()) for k, v in enumerate(x)], "note_id string, vector array<double>")
    s = Session(applying.State(notes, folders, *none), points)
    with pytest.raises(ValueError):
        s.shown()
    with pytest.raises(ValueError):
        s.update(method="x")
    s.update(method="notebooks", filter=FolderFilter("include", ("f",)))
    config = clustering.Config(metric="euclidean", dimensions=None, strategies=(clustering.Strategy("hdbscan", "hdbscan", None, 3, 2), clustering.Strategy("kmeans-2", "kmeans", 2)))
    s.run(config)
    assert s.poll()["status"] == "ready" and s.strategies()[s.selected] == "kmeans-2" and s.note("3")["title"] == "garden soil 3" and s.note("x") is None
    assignments, clusters = s.shown()
    assert assignments.count() == 15 and {r["note_count"] for r in s.folders().collect()} == {15, 1}
    s.sync(assignments, results.rename_cluster(clusters, 0, "Renamed"))
    assert "Renamed" in {r["name"] for r in s.shown()[1].collect()}
    assert s.apply().startswith("Method: Notebooks Only | Modified Notes: 15")
    assert "Renamed" in {r["title"] for r in s.state.folders.collect()} and s.poll()["can_undo"]
    s._lock.acquire()
    with pytest.raises(Busy):
        s.undo()
    s._lock.release()
    s.undo()
    assert {r["parent_id"] for r in s.state.notes.collect()} == {"f", "g"} and not s.poll()["can_undo"]
    with pytest.raises(ValueError):
        s.undo()
    assert s.poll()["status"] == "failed" and s.poll()["error"]

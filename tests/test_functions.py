"""Text, vector and scalar functions."""

import math

import pytest
from pyspark.sql import functions as F

from topicloom.functions import text, vectors
from topicloom.functions.prng import mulberry32, shuffled
from topicloom.functions.words import stop_words


def column(spark, build, rows, schema="v string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).coalesce(1).select(build(F.col("v"))).collect()]


def test_generic_titles(spark):
    yes = ["", "  ", "ab", "Untitled", " new  note ", "Note 12", "note", "TODO", "draft", "temp", "Test", "copy of my plan", "____"]
    no = ["Shopping list", "note taking", "copy office", "testing", "new notes", "todo list"]
    assert column(spark, text.is_generic_title, yes + no + [None]) == [True] * len(yes) + [False] * len(no) + [True]


def test_clean_text_and_tokens(spark):
    given = ["a ```code\nx``` b", "a `x` b", "see [the text](http://u) and ![img](u)", "<b>bold</b>", "at https://x.y/z now", None]
    assert column(spark, text.clean_text, given) == ["a   b", "a   b", "see the text and img", " bold ", "at   now", ""]
    words = ["cat", "series", "class", "categories", "boxes", "churches", "databases", "notes", "status", "analysis", "movies", "gas"]
    assert column(spark, text.singularize, words) == ["cat", "series", "class", "category", "box", "church", "database", "note", "status", "analysis", "movy", "gas"]
    assert column(spark, text.tokenize, ["The quick foxes don't always use databases", ""]) == [["quick", "fox", "alway", "database"], []]


def test_tokens_of_a_line_equal_singular_words(spark):
    given = ["series specieses news means buses ties dies ies es s gas boss bosses quizzes axes axe's churches ladies lenses is basis bases shoes pass", "ss sses xes zes ches shes cases"]
    one_by_one = spark.createDataFrame([(g,) for g in given], "v string").select(F.transform(text.raw_tokens(F.col("v")), text.singularize).alias("w")).collect()
    want = [[w for w in r["w"] if len(w) >= 3] for r in one_by_one]
    assert column(spark, lambda c: text.tokenize(c, ()), given) == want


def test_ngrams(spark):
    by_length = column(spark, lambda c: text.grams_by_length(F.split(c, " "), 3), ["a b c", "a", "a a b c"])
    assert by_length == [[["a", "b", "c"], ["a b", "b c"], ["a b c"]], [["a"], [], []], [["a", "a", "b", "c"], [None, "a b", "b c"], [None, "a b c"]]]
    assert column(spark, lambda c: text.ngrams(F.split(c, " "), 3), ["a b c"]) == [["a", "a b", "a b c", "b", "b c", "c"]]
    assert column(spark, lambda c: text.segment_ngrams(c, 2), ["python code, python python tree"]) == [["python", "python code", "code", "python", "python", "python tree", "tree"]]
    assert column(spark, text.has_consecutive_duplicates, ["a b", "a A b", "a"]) == [False, True, False]


def test_names(spark):
    assert column(spark, text.title_case, ["sql api guide", "onNX api"]) == ["SQL API Guide", "ONNX API"]
    raw = ['"Web Dev"', "## Travel Plans.", "Title: One two three four five six", "cluster name: X...", " `a` "]
    want = ["Web Dev", "Travel Plans", "One two three four five", "X", "a"]
    assert column(spark, text.sanitize_name, raw) == want and [text.sanitized(r) for r in raw] == want
    assert text.parse_names('x ```json\n{"0": "A", "1": "B."}``` y', [0, 1, 2]) == {0: "A", 1: "B"}
    assert text.parse_names('{"0": "A"}', [0, 1, 2]) is None and text.parse_names("{broken", [0]) is None and text.parse_names("[1]", [0]) is None
    prompt = text.naming_prompt([{"cluster_id": 0, "n_notes": 2, "titles": ["T"], "keywords": ["k"]}])
    assert prompt[1]["content"] == 'Group 0 (2 notes): "T"\nKeywords: k'


def test_keywords(spark):
    rows = [("C++ notes", "", "c++", True), ("", "the cat sat", "cat", True), ("", "concatenate", "cat", False), ("", "é-cat.", "CAT", True), (None, None, "x", False)]
    df = spark.createDataFrame(rows, "t string, b string, k string, want boolean")
    assert all(r["hit"] == r["want"] for r in df.select("want", text.matches_keyword(F.col("t"), F.col("b"), F.col("k")).alias("hit")).collect())


def test_token_chunks(spark):
    got = column(spark, lambda c: text.token_chunks(c, size=3), ["a b, c d", "", None])
    assert got == [["a b,", " c d"], [], []]


def test_vectors(spark):
    v = "v array<double>"
    assert column(spark, vectors.normalise, [[3.0, 4.0], [0.0, 0.0]], v) == [[0.6, 0.8], [0.0, 0.0]]
    assert column(spark, lambda c: vectors.is_valid(c, 2), [[1.0, 2.0], [], None, [1.0], [1.0, math.nan], [1.0, math.inf], [1.0, None]], v) == [True] + [False] * 6
    far = lambda m: lambda c: vectors.distance(m)(c, F.array(F.lit(0.0), F.lit(1.0)))
    assert column(spark, far("cosine"), [[1.0, 0.0], [0.0, 2.0], [0.0, 0.0]], v) == [1.0, 0.0, 1.0]
    assert column(spark, far("euclidean"), [[1.0, 1.0], [1.0]], v) == [1.0, None]
    assert column(spark, vectors.title_weight, [0.5, -1.0, 2.0], "v double") == [0.15, 0.0, 0.3]


def test_pools(spark):
    rows = [(1, 0, [1.0, 0.0]), (1, 5, [0.0, 1.0]), (2, 3, [3.0, 4.0])]
    chunks = spark.createDataFrame(rows, "note_id int, chunk_index int, vector array<double>")
    got = {r["note_id"]: r for r in vectors.decay_pool(chunks, "note_id").collect()}
    a, b = 1.5, math.exp(-0.15)
    n = math.hypot(a, b)
    assert got[1]["vector"] == pytest.approx([a / n, b / n]) and got[1]["raw_norm"] == pytest.approx(n / (a + b))
    assert got[2]["vector"] == pytest.approx([0.6, 0.8])
    assert {r["note_id"]: r["vector"] for r in vectors.title_chunk_pool(chunks, "note_id").collect()}[1] == pytest.approx([3 / math.sqrt(10), 1 / math.sqrt(10)])
    with pytest.raises(ValueError):
        vectors.mean_pool(spark.createDataFrame([(1, [1.0]), (1, [1.0, 2.0])], "note_id int, vector array<double>"), "note_id")


def test_generator():
    draw = mulberry32(42)
    assert [draw(), draw()] == [0.6011037519201636, 0.44829055899754167]
    assert sorted(shuffled([1, 2, 3], draw)) == [1, 2, 3]
    assert {"about", "youre", "wasnt", "notebook"} <= set(stop_words()) and "acme" in stop_words(("acme",))

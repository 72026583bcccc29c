"""Vectors, pages, conversations and the pipeline."""

import random

import numpy as np


def test_embedding_groups_equal_brute_force(spark):
    from topicloom.llm.vector_graph import Settings, embedding_groups

    rng = np.random.default_rng(0)
    base = rng.normal(size=(120, 16))
    near = np.concatenate([base[:1] + rng.normal(0, 0.05, (80, 16)), base[1:20] + rng.normal(0, 0.1, (19, 16))])
    x = np.concatenate([base, near, base[5:8], base[5:8] * 3])
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    odd = [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [1.0, None] + [0.0] * 14), (1004, [float("nan")] * 16), (1005, [float("inf")] + [1.0] * 15), (1006, [1e-300] * 16), (1007, [1.0, 2.0]), (None, base[40].tolist()), (41, base[41].tolist())]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(3)
    real = rows + [odd[6], odd[8], odd[9]]
    u = np.array([v for _, v in real]) / np.abs([v for _, v in real]).max(1, keepdims=True)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hit = u @ u.T >= 0.9
    np.fill_diagonal(hit, False)
    group = np.arange(len(u))
    for i, j in zip(*np.nonzero(hit)):
        group[group == group[i]] = group[j]
    ids = [i for i, _ in real]
    least = {g: min((i for i, h in zip(ids, group) if h == g and i is not None), default=None) for g in set(group.tolist())}
    want = sorted((str(i), int(h.sum()), str(least[g])) for i, h, g in zip(ids, hit, group.tolist()))
    want += [(str(i), 0, str(i)) for i in (1000, 1001, 1002, 1003, 1004, 1005, 1007)]
    got = embedding_groups(table, Settings(shard=60, largest=70)).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in got) == sorted(want)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert embedding_groups(table.limit(0)).count() == 0


def test_main_text_of_generated_pages():
    import re

    from topicloom.llm.html_extract import extract, trained
    from topicloom.llm.html_pages import labelled_pages

    pages = list(labelled_pages(150, seed=99))
    got = extract(["<html><body>" + "".join(m for m, _ in p) + "</body></html>" for p in pages], trained())
    right = total = 0
    for parts, text in zip(pages, got):
        words = set(text.split())
        for markup, own in parts:
            mine = [w for w in re.sub(r"<[^>]*>|&\w+;", " ", markup).split() if len(w) > 7]
            total += len(mine)
            right += sum((w in words) == own for w in mine)
    assert right / total > 0.97


def test_main_text_of_a_page(spark):
    from topicloom.llm.html_extract import main_text

    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=/a>Menu</a></li></ul></nav><!-- x --><div class=\"ad\">Buy this now.</div>"
        "<article><h1>A title &amp; more</h1><p><b>First  words<br>of\n it<p>Second par<i>agraph</i> with some more words in it, as ever.</p></article><div class=comments><p>Reader says no.</p></div><footer>&copy; me</footer></body></html>"
    )
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p>unclosed <a href='"), (None, "u", page)]
    got = {r["page_id"]: r for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = "A title & more First words of it Second paragraph with some more words in it, as ever."
    assert got[1]["text"] == got[None]["text"] == want and got[1]["n_chars"] == len(want)
    assert got[2]["text"] == got[3]["text"] == "" and len(got) == 5


def test_conversations_in_reply_order(spark):
    from topicloom.llm.quotes import linked_conversations, parse

    assert parse("On Monday Bob wrote:\n> a b\n>> c\n> d\nbody") == ("body", [(1, "a b"), (2, "c"), (1, "d")])
    r = random.Random(4)
    rows = []
    for conv in range(6):
        said = []
        for turn in range(r.randint(1, 30)):
            text = f"Message {turn} of {conv} says {r.random()} to all."
            quoted = r.randrange(len(said)) if said and r.random() < 0.4 else None
            rows.append((conv, turn, "user", (f"> {said[quoted]}\n" if quoted is not None else "") + text, quoted))
            said.append(text)
    rows += [(7, None, "a", None, None), (7, 1, None, "", None), (None, 2, "x", "> nobody said this\nok", None)]
    got = linked_conversations(spark.createDataFrame([x[:4] for x in rows], "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(rows)
    by = {(g["conv_id"], g["turn"]): g for g in got}
    for conv in range(6):
        mine = [x for x in rows if x[0] == conv]
        parent = {x[1]: x[4] if x[4] is not None else (x[1] - 1 if x[1] else None) for x in mine}
        order = []

        def visit(t, parent=parent, order=order):
            order.append(t)
            for c in sorted(k for k, p in parent.items() if p == t):
                visit(c)

        visit(0)
        depth = {}
        for t in range(len(mine)):
            depth[t] = 0 if parent[t] is None else depth[parent[t]] + 1
        for t in range(len(mine)):
            g = by[conv, t]
            assert (g["reply_to"], g["depth"], g["position"]) == (parent[t], depth[t], order.index(t)), (conv, t)
            assert not g["text"].startswith(">")
    assert by[None, 2]["text"] == "ok" and not by[None, 2]["linked"]


def test_quoted_lines_and_short_sentences_link(spark):
    from topicloom.llm.quotes import linked_conversations

    texts = ["line one\nline two\nline three", "Well then. Yes, I agree. So let us go on with it.", "neither", "> line two\nwhy?", "> Yes, I agree.\nnot me", "> line two\n> line three\nboth", "> Yes, I agree. So let us go on with it.\nthe longer one"]
    rows = [(1, k, "user", t) for k, t in enumerate(texts)]
    got = {g["turn"]: (g["reply_to"], g["linked"], g["depth"]) for g in linked_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {0: (None, False, 0), 1: (0, False, 1), 2: (1, False, 2), 3: (0, True, 1), 4: (1, True, 2), 5: (0, True, 1), 6: (1, True, 2)}


def test_pages_of_every_kind(spark):
    from topicloom.llm.html_extract import main_text

    schema = "page_id long, url string, html string, text int, n_chars string"
    long = "<html><body><nav><a href=/>Home</a></nav><article>" + "".join(f"<p>Paragraph number {k} tells of the matter at hand, and of more.</p>" for k in range(3000)) + "</article></body></html>"
    rows = [(1, "u", long, 1, "x"), (1, "u", long, 1, "x"), (2, None, "plain text without any markup at all", 2, None), (3, "u", "<div>" * 2000 + "deep" + "</div>" * 2000, 3, "y"), (4, "u", "\x00<\ufffd&#0;&bogus;&#x110000;", 4, "z")]
    got = main_text(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 5 and all(g["n_chars"] == len(g["text"]) for g in got)
    one, other = (g for g in got if g["page_id"] == 1)
    assert one == other and one["text"].startswith("Paragraph number 0 tells") and one["text"].count("Paragraph number") == 3000
    assert main_text(spark.createDataFrame([], schema)).count() == 0


def test_empty_repeated_and_clashing_rows(spark):
    from topicloom.llm.quotes import linked_conversations
    from topicloom.llm.toxicity import Settings, toxicity, without_toxic
    from topicloom.llm.vector_graph import embedding_groups

    schema = "conv_id long, turn long, role string, text string, depth string, reply_to int, position int, linked int"
    rows = [(1, 0, "a", "First message of all.", "x", 1, 1, 1), (1, 1, "b", "> First message of all.\nYes.", "x", 1, 1, 1), (1, 1, "b", "> First message of all.\nYes.", "x", 1, 1, 1)]
    got = linked_conversations(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 3 and {g["text"] for g in got} == {"First message of all.", "Yes."} and sorted(g["position"] for g in got) == [0, 1, 2]
    assert linked_conversations(spark.createDataFrame([], schema)).count() == 0
    docs = spark.createDataFrame([(1, "some text", 3.0, "l"), (1, "some text", 3.0, "l"), (None, None, None, None)], "doc_id long, text string, score double, held_out string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity(docs, labels, Settings()).collect()
    assert len(got) == 3 and len({(g["score"], g["held_out"]) for g in got if g["doc_id"] == 1}) == 1
    assert toxicity(docs.limit(0), labels).count() == without_toxic(docs.limit(0), labels).count() == 0
    vectors = spark.createDataFrame([(1, [1.0, 0.0], 5, "k"), (2, [1.0, 0.01], 5, "k"), (3, [0.0, 1.0], 5, "k")], "vec_id long, embedding array<double>, n_links int, kept string")
    assert {(g["vec_id"], g["n_links"], g["component_id"], g["kept"]) for g in embedding_groups(vectors).collect()} == {(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)}


def test_pipeline_equals_brute_force(spark, tmp_path):
    """The whole run against plain code, but for the learnt scores, on repeated, null and awkward rows."""
    import zlib
    from collections import Counter, defaultdict

    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer
    from topicloom.llm.simhash import fingerprint
    from topicloom.llm.toxicity import toxicity

    r = random.Random(6)
    word = lambda: "".join(r.choice(["an", "ber", "lo", "ti", "ou", "sch", "ka", "mi"]) for _ in range(r.randint(2, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, item, short = prose(60), prose(40), prose(45)
    texts = [prose(r.randint(5, 200)) for _ in range(30)]
    texts += [texts[0], texts[0], f"{prose(60)} {passage} {prose(40)}", f"{prose(60)} {passage} {prose(30)}", f"{prose(50)} {short} {prose(20)}", f"{short} {prose(50)}", f"{prose(80)} {item} {prose(20)}"]
    texts += [f"{prose(40)} vileword grouped {prose(10)}" for _ in range(60)] + [None, "", "naïve ＴＥＸＴ", prose(3000)]
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(texts)]
    rows += [rows[5], (None, texts[7] + " more of it", "en", "s", 1), (None, prose(30), "en", "s", 1), (None, prose(25), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(k, int("vileword" in (t or ""))) for k, t in enumerate(texts)], "doc_id long, toxic int")
    sf = f"file://{tmp_path}"
    for name, t in (("documents", docs), ("labels", labels), ("benchmark", spark.createDataFrame([(1, item), (2, None)], "item_id long, text string"))):
        t.write.parquet(f"{sf}/{name}.parquet")
    bad = {g["doc_id"] for g in toxicity(docs, labels).where("predicted = 1").collect()}
    assert 50 < len(bad) < 70
    left = [x for x in rows if x[0] not in bad]
    prints = [fingerprint((x[1] or "").encode()) for x in left]
    group = list(range(len(left)))
    for i in range(len(left)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4 and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    by = defaultdict(list)
    for x, g in zip(left, group):
        by[g].append(x)
    left = [min(g, key=lambda x: (x[0] is None, x[0] or 0)) for g in by.values()]
    raw = [(x[1] or "").encode() for x in left]
    seen = Counter(t[k : k + 280] for t in raw for k in range(len(t) - 279))
    kept = []
    for t in raw:
        gone = bytearray(len(t))
        for k in range(len(t) - 279):
            if seen[t[k : k + 280]] > 1:
                gone[k : k + 280] = b"\1" * 280
        k, out = 0, b""
        while k < len(t):
            end = k
            while end < len(t) and gone[end] == gone[k]:
                end += 1
            if not gone[k] or len(t[k:end].split()) < 50:
                out += t[k:end]
            k = end
        kept.append(out.decode("utf-8", "ignore"))
    assert sum(passage in (x[1] or "") for x in left) == 2 and not any(passage in t for t in kept) and sum(short in t for t in kept) == 2
    final = [(x[0], t) for x, t in zip(left, kept) if item not in t]
    assert len(final) == len(left) - 1
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    want = Counter()
    for doc_id, t in final:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids), 1024), len(ids)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[str(doc_id), n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter((str(g["doc_id"]), g["piece"], g["start"], g["length"], g["ids_crc32"]) for g in got) == want


def test_pipeline_stages_equal_their_operators(spark, tmp_path):
    import corpus_pipeline
    from topicloom.llm.common import table
    from topicloom.llm.decontaminate import contaminated
    from topicloom.llm.simhash import near_groups
    from topicloom.llm.suffixes import suffix_dedup
    from topicloom.llm.toxicity import toxicity

    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents").cache()
    (_, clean), (_, dedup), (_, cut), (_, leaks), (_, pack) = corpus_pipeline.STAGES
    one = clean(spark, docs, sf).cache()
    assert {r["doc_id"] for r in one.collect()} == {r["doc_id"] for r in toxicity(docs, table(spark, sf, "labels")).where("predicted = 0").collect()}
    two = dedup(spark, one, sf).cache()
    assert {r["doc_id"] for r in two.collect()} == {r["component_id"] for r in near_groups(one).collect()}
    three = cut(spark, two, sf).cache()
    held = {r["doc_id"]: r["n_passages"] for r in suffix_dedup(two, corpus_pipeline.PASSAGES).collect()}
    before = {r["doc_id"]: r["text"] for r in two.collect()}
    assert before.keys() == held.keys() == {r["doc_id"] for r in three.collect()}
    assert all((r["text"] != before[r["doc_id"]]) == (held[r["doc_id"]] > 0) and r["n_chars"] == len(r["text"] or "") for r in three.collect())
    four = leaks(spark, three, sf).cache()
    hit = {r["doc_id"] for r in contaminated(three, table(spark, sf, "benchmark")).collect()}
    assert {r["doc_id"] for r in four.collect()} == {r["doc_id"] for r in three.collect()} - hit
    assert docs.columns == one.columns == two.columns == three.columns == four.columns
    assert {r["doc_id"] for r in pack(spark, four, sf).select("doc_id").distinct().collect()} == {r["doc_id"] for r in four.collect()}


def test_free_memory_of_the_driver_goes_back_to_the_system(spark):
    from topicloom.llm.common import released

    assert spark.sql("select length(repeat('x', 800000000))").first()[0] == 800000000
    released(spark)
    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    total = runtime.totalMemory()
    assert total < 2.2 * (total - runtime.freeMemory())

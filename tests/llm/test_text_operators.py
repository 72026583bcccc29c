"""Operators on documents against brute force, on a small table with every awkward row."""

import collections
import hashlib
import math
import random
import zlib

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id long, spans string"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    word = lambda: "".join(r.choice(["an", "ber", "é", "lo", "ti", "ou", "sch"]) for _ in range(r.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, base = prose(90), prose(200)
    texts = [prose(r.randint(1, 160)) for _ in range(30)]
    texts += [base, base, base.replace(" ", "  ", 1), base[:-20] + " other end", prose(40) + " " + passage + " " + prose(30), prose(10) + "\n" + passage, passage + " x"]
    texts += [None, "", "", " \n\t ", "a", "A", "ab " * 700, "z" * 1500, prose(9000), "Naïve ＴＥＸＴ 日本語 <|endoftext|> x", "two\n lines  and\tmore "]
    out = [(k, t, "en", "s", 1, 0.5, 7, "c") for k, t in enumerate(texts)]
    return out + [out[3], (None, "no id " + base, "en", "s", 1, 0.5, 7, "c")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def test_simhash_equals_brute_force(docs, rows):
    import numpy as np
    from xxhash import xxh64_intdigest

    from topicloom.llm.simhash import near_groups

    fps = []
    for row in rows:
        w = (row[1] or "").encode().lower().split()
        grams = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        bits = [sum(xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
        fps.append(sum(1 << b for b in range(64) if grams and 2 * bits[b] > len(grams)))
    group = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    least = collections.defaultdict(list)
    for row, g in zip(rows, group):
        if row[0] is not None:
            least[g].append(row[0])
    want = sorted((str(r[0]), f"{f:016x}", str(min(least[g], default=None))) for r, f, g in zip(rows, fps, group))
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in near_groups(docs).collect()) == want
    assert np.bitwise_count(np.uint64(0)) == 0


def test_crowded_buckets_lose_no_link(spark):
    import numpy as np

    from topicloom.llm.components import components
    from topicloom.llm.simhash import links

    rng = np.random.default_rng(0)
    points = np.unique(np.concatenate([rng.integers(0, 1 << 12, 150), rng.integers(0, 1 << 62, 20)]))
    found = links(spark.createDataFrame([(int(p),) for p in points], "fp long"), max_bucket=8)
    got = {r["node"]: r["component"] for r in components(found).collect()}
    group = {int(p): int(p) for p in points}
    for i, a in enumerate(points.tolist()):
        for b in points[:i].tolist():
            if (a ^ b).bit_count() <= 4 and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {k: low if g == high else g for k, g in group.items()}
    assert all(got.get(k, k) == g for k, g in group.items())


def covered(texts, n):
    """Maximal runs of each text that strings of n bytes which start anywhere else too cover."""
    seen = collections.Counter()
    for t in texts:
        seen.update(t[k : k + n] for k in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - n + 1):
            if seen[t[k : k + n]] > 1:
                gone[k : k + n] = b"\1" * n
        starts = [k for k, g in enumerate(gone) if g and (not k or not gone[k - 1])]
        out.append([(a, (gone.find(0, a) + 1 or len(t) + 1) - 1) for a in starts])
    return out


def cut_out(text, runs):
    gone = {k for a, b in runs for k in range(a, b)}
    return bytes(c for k, c in enumerate(text) if k not in gone)


@pytest.mark.parametrize(("most", "passage"), [(1, 280), (2, None), (1000, 280)])
def test_suffix_dedup_equals_brute_force(docs, rows, most, passage):
    from topicloom.llm.suffixes import Settings, suffix_dedup

    texts = [(r[1] or "").encode() for r in rows]
    want = []
    for row, t, runs, short in zip(rows, texts, covered(texts, 400), covered(texts, passage or 400)):
        kept = cut_out(t, runs)
        want.append((str(row[0]), len(t), len(t) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), sum(len(t[a:b].split()) >= 50 for a, b in short)))
    got = [(str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], r["n_passages"]) for r in suffix_dedup(docs, Settings(sorted_contexts=most, passage=passage)).collect()]
    assert sorted(got) == sorted(want)
    assert any(w[5] for w in want)


def test_crowded_passage_is_cut_to_what_others_share_before_windows(spark, monkeypatch):
    from topicloom.llm import suffixes
    from topicloom.llm.suffixes import Settings, suffix_dedup

    r = random.Random(4)
    prose = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage = prose(430)
    texts = [prose(300) + passage[r.randrange(100) :] + prose(300) for _ in range(200)]
    made = []

    def watched(blocks, settings, whole=suffixes._hashed_repeats):
        made.append((blocks.count(), blocks.select("anchor", "doc_id", "pos").distinct().count()))
        return whole(blocks, settings)

    monkeypatch.setattr(suffixes, "_hashed_repeats", watched)
    raw = [t.encode() for t in texts]
    want = [(k, len(t) - len(cut_out(t, runs)), len(runs), hashlib.sha256(cut_out(t, runs)).hexdigest()) for k, (t, runs) in enumerate(zip(raw, covered(raw, 400)))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r["doc_id"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup(docs, Settings(sorted_contexts=20, passage=280)).collect()]
    assert sorted(got) == want and any(w[1] for w in want) and not all(w[1] for w in want)
    assert made and made[0][0] < 9 * made[0][1]  # whole contexts have 18 blocks and more


def test_crowded_passage_is_settled_in_chunks_without_windows(spark, monkeypatch):
    from topicloom.llm import suffixes
    from topicloom.llm.suffixes import Settings, suffix_dedup

    r = random.Random(5)
    prose = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage, heads, tails = prose(380), [prose(300) for _ in range(40)], [prose(300) for _ in range(40)]
    texts = [prose(300) + passage + prose(300) for _ in range(110)]  # under 400 bytes alone
    texts += [prose(300 - k) + h[-k:] + passage + prose(300) for k, h in enumerate(heads, 1)]
    texts += [prose(300 - k) + h[-k:] + passage + prose(300) for k, h in enumerate(heads, 1)]
    texts += [prose(300) + passage + t[:k] + prose(300 - k) for k, t in enumerate(tails, 1) for _ in range(2)]
    windows = []

    def watched(blocks, settings, whole=suffixes._hashed_repeats):
        windows.append(blocks.count())
        return whole(blocks, settings)

    monkeypatch.setattr(suffixes, "_hashed_repeats", watched)
    raw = [t.encode() for t in texts]
    want = [(k, len(t) - len(cut_out(t, runs)), len(runs), hashlib.sha256(cut_out(t, runs)).hexdigest()) for k, (t, runs) in enumerate(zip(raw, covered(raw, 400)))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r["doc_id"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup(docs, Settings(sorted_contexts=150, passage=280)).collect()]
    assert sorted(got) == want and any(w[1] for w in want) and not all(w[1] for w in want)
    assert not windows


def test_passages_of_fifty_words_go_and_shorter_ones_stay(spark, docs, rows):
    from topicloom.llm.suffixes import Settings, without_passages

    r = random.Random(8)
    prose = lambda n: " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(n))
    long, short = prose(51), prose(45)
    more = [(100 + k, f"{prose(40)} {shared} {prose(30)}", "en", "s", 1, 0.5, 7, "c") for k, shared in enumerate([long, long, short, short])]
    table = docs.unionByName(spark.createDataFrame(more, docs.schema))
    every = rows + more
    texts = [(x[1] or "").encode() for x in every]
    want = []
    for x, t, found in zip(every, texts, covered(texts, 280)):
        kept = cut_out(t, [(a, b) for a, b in found if len(t[a:b].split()) >= 50]).decode("utf-8", "ignore")
        want.append((str(x[0]), None if x[1] is None else kept))
    got = without_passages(table, Settings(length=280)).collect()
    assert sorted((str(g["doc_id"]), g["text"] or "") for g in got) == sorted((i, t or "") for i, t in want)
    assert all(g["n_chars"] == len(g["text"]) for g in got if g["text"] is not None and g["doc_id"] in (100, 101))
    by = {g["doc_id"]: g["text"] for g in got}
    assert long not in by[100] and short in by[102] and by[102] == more[2][1]


def test_one_row_of_each_simhash_group_stays(spark, docs, rows):
    from topicloom.llm.simhash import deduplicated, near_groups

    got = deduplicated(docs).collect()
    groups = near_groups(docs).collect()
    by = collections.defaultdict(list)
    for g in groups:
        by[str(g["component_id"])].append(g["doc_id"])
    assert len(got) == len(by) and sorted(str(g["doc_id"]) for g in got) == sorted(by)
    none = spark.createDataFrame([(None, "no id"), (None, "no id"), (None, None), (3, "no id")], "doc_id long, text string")
    assert sorted((str(g["doc_id"]), str(g["text"])) for g in deduplicated(none).collect()) == [("3", "no id"), ("None", "None")]
    two = spark.createDataFrame([(5, "one two three four five"), (5, "quite another text of some length here"), (5, "one two three four five")], "doc_id long, text string")
    assert sorted(g["text"] for g in deduplicated(two).collect()) == ["one two three four five", "quite another text of some length here"]
    assert deduplicated(docs.limit(0)).count() == 0


@pytest.mark.parametrize("order", [2, 3])
def test_katz_equals_brute_force_and_sums_to_one(docs, rows, order):
    from topicloom.llm.katz import Settings, good_turing, katz_scores

    tokens = [(r[1] or "").encode().lower().split() + [b" "] for r in rows]
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows]
    counts = {k: collections.Counter() for k in range(1, order + 1)}
    for w, h in zip(tokens, held):
        for k in counts:
            if not h:
                counts[k].update(tuple([None] * (k - 1) + w)[i : i + k] for i in range(len(w)))
    uni = counts[1]
    n, v = sum(uni.values()), len(uni)

    def discounts(c):
        of = collections.Counter(c.values())
        return good_turing([of[r] for r in range(7)], 5)

    d = {k: discounts(c) for k, c in counts.items()}
    keep = lambda c, k: c * (d[k][c] if c <= 5 else 1.0)
    unknown = 1 - sum(keep(c, 1) for c in uni.values()) / n
    hist, kept, seen = collections.Counter(), collections.Counter(), collections.Counter()

    def p(gram):
        k = len(gram)
        if k == 1:
            return keep(uni[gram], 1) / n if gram in uni else unknown
        h, c = gram[:-1], counts[k][gram]
        if not hist[h]:
            return p(gram[1:])
        left = 1 - kept[h] / hist[h]
        bare = left <= 1e-12
        left = 1 / (hist[h] + 1) if bare else left
        return keep(c, k) / (hist[h] + bare) if c else left / (1 - seen[h]) * p(gram[1:])

    for k in range(2, order + 1):
        for g, c in counts[k].items():
            hist[g[:-1]] += c
            kept[g[:-1]] += keep(c, k)
            seen[g[:-1]] += p(g[1:])
    some = [(None,) * (order - 1), *[g[1:] for g in list(counts[order])[:400:20]]]
    assert all(math.isclose(sum(p((*h, *w)) for w in uni) + p((*h, b"unseen")), 1, rel_tol=1e-9) for h in some)
    grams = [[tuple([None] * (order - 1) + w)[i : i + order] for i in range(len(w))] for w in tokens]
    want = sorted(((str(r[0]), h, len(w), sum((t,) in uni for t in w), n), sum(math.log10((uni[(t,)] + 1) / (n + v + 1)) for t in w), sum(math.log10(p(x)) for x in g)) for r, w, h, g in zip(rows, tokens, held, grams))
    for small in (Settings(order=order), Settings(order=order, block_tokens=500, most=20, slices=3)):
        got = sorted(((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]), r["base_score"], r["score"]) for r in katz_scores(docs, small).collect())
        assert [g[0] for g in got] == [w[0] for w in want]
        assert all(math.isclose(a, b, rel_tol=1e-9) for g, w in zip(got, want) for a, b in zip(g[1:], w[1:]))
    assert katz_scores(docs.limit(0), Settings(order=order)).count() == 0


def test_packing_round_trip(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    from topicloom.llm.packing import best_fit_packing

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    want = collections.Counter()
    for r in rows:
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 2]
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        for k, (a, b) in enumerate([(0, first), *((s, s + 1024) for s in range(first, len(ids), 1024))]):
            want[str(r[0]), k, a, b - a, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[a:b]))] += 1
    got = best_fit_packing(docs, path, max_open=8).collect()
    assert collections.Counter((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024


def test_open_bins_take_the_best_fit_and_close_the_fullest():
    from topicloom.llm.packing import OpenBins

    bins = OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    bins = OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 8, 9)] == [(0, 0), (1, 0), (2, 0)]
    assert bins.place(2)[0] == 0  # bin 1, the fullest, has closed


def test_toxicity_learns_pairs_and_leaves_clean_texts(spark):
    from topicloom.llm.toxicity import Settings, fit, terms, toxicity, without_toxic

    import numpy as np

    r = random.Random(2)
    texts = [("group" if k & 1 else "people") + " " + ("slur" if k & 2 else "word") for k in range(4)] * 100
    y = np.array([float(t == "group slur") for t in texts])
    sets = [sorted(terms(t)) for t in texts]
    machine = fit(np.array([x for s in sets for x in s]), np.array([len(s) for s in sets]), y)
    assert [round(float(x)) for x in machine.scores([terms(t) for t in texts[:4]])] == y[:4].tolist()
    data = [(k, " ".join(r.choice(["an", "the", "of", "re"]) + r.choice("xyz") for _ in range(30)) + (" idiot moron" if k % 4 == 0 else "")) for k in range(300)] + [(900, None), (901, ""), (None, "idiot moron"), (4, "idiot moron")]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("score", spark.range(1).select("id").columns and __import__("pyspark").sql.functions.lit(1))
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(300)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity(docs, labels).collect()
    assert len(got) == len(data)
    held = [x for x in got if x["held_out"] and x["doc_id"] < 300]
    assert held and all(x["predicted"] == int(x["doc_id"] % 4 == 0) for x in held)
    assert all(x["predicted"] == 0 for x in got if x["doc_id"] in (900, 901)) and all(0 <= x["score"] <= 1 for x in got)
    kept = without_toxic(docs, labels)
    assert kept.columns == docs.columns and not kept.where("doc_id is null").count()
    assert all(x["predicted"] == 0 for x in toxicity(docs, labels.limit(0)).collect())
    assert Settings().toxic_rows


def test_decontamination_finds_passages_and_paraphrases(spark):
    from topicloom.llm.decontaminate import common_subsequence, contaminated, decontaminated

    r = random.Random(3)
    word = lambda: "".join(r.choice(["an", "ber", "lo", "ti", "ou", "sch", "ka", "mi"]) for _ in range(r.randint(2, 4)))
    items = [[word() for _ in range(r.randint(15, 90))] for _ in range(20)]
    noise = lambda n: [word() for _ in range(n)]
    changed = [w if k % 6 else "other" for k, w in enumerate(items[3])]
    texts = [" ".join(noise(100))] * 3 + [" ".join(noise(300) + items[k] + noise(50)) for k in range(20)] + [" ".join(noise(70) + changed), None, "", " ".join(noise(9000) + items[5])]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, " ".join(items[2]))], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w) + ".") for k, w in enumerate(items)] + [(77, None), (78, "")], "item_id long, text string")
    want = {(3 + k, k) for k in range(20)} | {(23, 3), (26, 5), (None, 2)}
    assert {(x["doc_id"], x["item_id"]) for x in contaminated(docs, bench).collect()} == want
    assert {x["doc_id"] for x in decontaminated(docs, bench).collect()} == {0, 1, 2, 24, 25}
    assert contaminated(docs.limit(0), bench).count() == contaminated(docs, bench.limit(0)).count() == 0
    for _ in range(50):
        a, b = ([r.choice("abc") for _ in range(r.randint(0, 9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, z in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == z else max(table[i][j + 1], table[i + 1][j])
        assert common_subsequence(a, b) == table[-1][-1]


def test_decontamination_equals_brute_force(spark):
    from topicloom.llm.decontaminate import Settings, contaminated, decontaminated

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = row[:]
            for j, z in enumerate(b):
                row[j + 1] = before[j] + 1 if x == z else max(before[j + 1], row[j])
        return row[-1]

    r = random.Random(11)
    pool = [f"t{k}" for k in range(60)]
    items = [r.choices(pool, k=r.randint(4, 100)) for _ in range(12)] + [["t1", "t2"]]
    items.append(items[0])  # a tie of two items
    texts = []
    for _ in range(40):
        item = [w for w in r.choice(items) if r.random() < r.choice([0.6, 0.72, 0.9])]
        if r.random() < 0.2:
            r.shuffle(item)
        texts.append(r.choices(pool, k=r.randint(0, 90)) + item + r.choices(pool, k=r.randint(0, 90)))
    rows = [(k, " ".join(w), 7, 0.5) for k, w in enumerate(texts)] + [(None, " ".join(texts[0]), 7, 0.5), (3, " ".join(texts[3]), 7, 0.5), (99, None, 1, 0.1), (98, "", 1, 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int, cosine double")
    bench = spark.createDataFrame([(k, " ".join(w), k) for k, w in enumerate(items)] + [(0, " ".join(items[0]), 0)], "item_id long, text string, doc_id int")
    want = []
    for doc_id, text, *_ in rows:
        w = (text or "").split()
        places = [w[max(0, k - 1) * 32 : (k + 3) * 32] for k in range(-(-len(w) // 32))]
        for n, item in enumerate(items):
            parts = [item[k : k + 64] if not k or len(item[k : k + 64]) >= 32 else item[-64:] for k in range(0, len(item), 64)]
            if any(longest(part, place) >= 0.7 * len(part) for part in parts for place in places):
                want.append((str(doc_id), n))
    got = sorted((str(g["doc_id"]), g["item_id"]) for g in contaminated(docs, bench, Settings(block=5, rank=3)).collect())
    assert got == sorted(want) and 10 < len(want) < len(rows) * len(items) - 100
    hit = {d for d, _ in want}
    clean = decontaminated(docs, bench, Settings(block=5, rank=3))
    assert clean.columns == docs.columns and sorted(str(g["doc_id"]) for g in clean.collect()) == sorted(str(x[0]) for x in rows if str(x[0]) not in hit)


def test_decontamination_needs_no_last_sentence_and_no_cosine(spark):
    from topicloom.llm.decontaminate import contaminated

    r = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    r.shuffle(words)
    items = [words[:6], *(words[k : k + 40] for k in range(10, 370, 40))]
    texts = [" ".join(w) + "." for w in items]
    texts[1] = " ".join(items[1][:39]) + ". Er."  # a one-word last sentence
    texts[2] = " ".join(items[2][:32]) + ". " + " ".join(items[2][32:]) + "."
    others = r.sample([w for i in items[4:] for w in i], 58)  # words of other items, out of order: a cosine below 0.3
    docs = [" ".join(items[1][:39]), " ".join(items[2][:32]), " ".join(others[:29] + items[0][:5] + others[29:]), " ".join(items[3])]
    docs = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    assert {(x["doc_id"], x["item_id"]) for x in contaminated(docs, bench).collect()} == {(0, 1), (1, 2), (2, 0), (3, 3)}
    answers = spark.createDataFrame([(k, t, {3: "not there at all", 2: items[2][0]}.get(k)) for k, t in enumerate(texts)], "item_id long, text string, answer string")
    assert {(x["doc_id"], x["item_id"]) for x in contaminated(docs, answers).collect()} == {(0, 1), (1, 2), (2, 0)}


def test_decontamination_words_are_runs_of_letters_and_digits():
    import re

    from topicloom.llm.decontaminate import words

    r = random.Random(13)
    odd = "aZ9_ -.\x00\x1c\x85\xa0\u200b\u3000ıİſßΣςÉé²½ªＡ日本語१𝔸🙂—«»“”…×÷\u0301\u2028"
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x30000)]))
    texts = [None, "", " ", "ΑΣ ΑΣΑ İx", every, every[::-1], *("".join(r.choices(odd, k=r.randint(1, 60))) for _ in range(300)), *("".join(r.choices(odd[:9] + "é—", k=40)) for _ in range(100))]
    for text in texts:
        assert [w.decode() if isinstance(w, bytes) else w for w in words(text)] == re.findall(r"[^\W_]+", (text or "").lower())


def test_decontamination_searches_in_little_time(spark):
    import re
    import time

    from topicloom.llm.common import table
    from topicloom.llm.decontaminate import Settings, build, passages

    docs = table(spark, "/root/testdata/sf0.01", "documents").select("text").cache()
    index = build(spark, next(passages(spark, table(spark, "/root/testdata/sf0.1", "benchmark"), Settings())), docs, Settings())
    texts = [x["text"] or "" for x in docs.collect()]

    def seconds(run):
        took = []
        for _ in range(3):
            began = time.thread_time()
            for text in texts:
                run(text)
            took.append(time.thread_time() - began)
        return min(took)

    word = re.compile(r"[^\W_]+")
    assert seconds(index.search) < 2.5 * seconds(lambda text: word.findall(text.lower()))  # the machine's speed cancels out


def test_licence_scan(spark):
    from topicloom.llm.licences import TEMPLATES, licence_scan

    mit = TEMPLATES["MIT"][2]
    texts = ["prose of no note\nReleased under the MIT License.\nmore", mit.replace(", ", ",\n"), "x " + mit.replace("Permission", "Leave"), "Licensed under the Apache Licence, version 2.0", None, "", "a licence", "Licensed under CC BY-NC 4.0.\n" * 3]
    got = licence_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["license_id"], r["n_matches"]) for r in got} == {(0, "MIT", 1), (1, "MIT", 1), (2, "MIT", 1), (3, "Apache-2.0", 1), (7, "CC-BY-NC-4.0", 3)}


def test_licences_inside_lines_and_of_one_family():
    from topicloom.llm.licences import TEMPLATES, Scanner

    scan = Scanner().scan
    found = lambda text: [(m[0], m[2]) for m in scan(text)]
    assert found("Released under the MIT License and distributed by Foo Inc.") == [("MIT", 1)]
    assert found("About us, contact | Licensed under CC BY 4.0 | all pages of 2020 | by Foo and friends") == [("CC-BY-4.0", 1)]
    assert found("Code is released under the MIT License, texts are licensed under CC BY-SA 4.0 as ever") == [("CC-BY-SA-4.0", 1), ("MIT", 1)]
    assert scan("one\ntwo released under the MIT License, see\nthree")[0][3:] == (1, 1)
    for name, texts in TEMPLATES.items():
        assert all(found("by us, " + t + " and so on") == [(name, 1)] for t in texts), name


def test_licences_keep_their_versions():
    from topicloom.llm.licences import TEMPLATES, Scanner

    scan = Scanner().scan
    named = lambda text: [m[0] for m in scan(text)]
    assert named("This work is licensed under the GNU General Public License v3.") == ["GPL-3.0"]
    assert named("Licensed under the GNU General Public License v3.0.") == ["GPL-3.0"] == named("licensed under the GNU General Public License (v. 3)")
    assert named("This work is licensed under the GNU General Public License v2") == ["GPL-2.0"]
    assert named("Licensed under the GNU General Public License.") == ["GPL"] == named("Licensed under the GNU General Public License, version 1")
    assert named(TEMPLATES["BSD-2-Clause"][1]) == ["BSD-2-Clause"] and named(TEMPLATES["BSD-3-Clause"][1]) == ["BSD-3-Clause"]
    assert named("Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n\nTERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION") == ["Apache-2.0"]
    assert named("A licensed plumber, version of 1999, the general public and a license to drive") == []


def test_licence_scan_equals_brute_force(spark):
    from topicloom.llm.licences import Scanner, licence_scan, words

    templates = {"A": ("one two three four five six seven",), "B": ("one two three four nine nine nine eight",), "C": ("nine ten",), "D": ("one two three four five six seven",)}
    r = random.Random(2)
    pool = "one two three four five six seven eight nine ten x y".split()
    texts = []
    for _ in range(150):
        parts = [" ".join(r.choices(pool, k=r.randint(0, 9))) if r.random() < 0.5 else r.choice(templates[r.choice("ABC")])[: r.randint(12, 60)] for _ in range(4)]
        texts.append(r.choice([" ", ". ", "\n"]).join(parts))

    def brute(text):
        w = words(text)
        grams = list(zip(w, w[1:]))
        found = []
        for name, (template,) in templates.items():
            t = words(template)
            own = collections.Counter(zip(t, t[1:]))
            size = sum(own.values())
            for i in range(len(grams)):
                for j in range(i + 1, len(grams) + 1):
                    dice = 2 * sum((own & collections.Counter(grams[i:j])).values()) / (j - i + size)
                    if dice >= 0.8:
                        found.append((-dice, -size, i, name, j))
        taken, best = set(), {}
        for dice, _, i, name, j in sorted(found):
            if not taken & set(range(i, j + 1)):
                taken |= set(range(i, j + 1))
                best.setdefault(name, [-dice, 0])[1] += 1
        return sorted((name, d, n) for name, (d, n) in best.items())

    rows = [(k, t, k) for k, t in enumerate(texts)] + [(None, texts[0], 0), (3, texts[3], 0), (900, None, 0), (901, "", 0)]
    want = sorted((str(k), *m) for k, t, _ in rows for m in brute(t or ""))
    table = spark.createDataFrame(rows, "doc_id long, text string, dice int")
    got = licence_scan(table, Scanner(templates)).collect()
    assert sorted((str(g["doc_id"]), g["license_id"], g["dice"], g["n_matches"]) for g in got) == want and len(want) > 100


def test_empty_tables(spark):
    import public_tokenizers

    from topicloom.llm.katz import katz_scores
    from topicloom.llm.licences import licence_scan
    from topicloom.llm.packing import best_fit_packing
    from topicloom.llm.simhash import deduplicated, near_groups
    from topicloom.llm.suffixes import suffix_dedup, without_passages

    none = spark.createDataFrame([], SCHEMA)
    for f in (katz_scores, licence_scan, near_groups, deduplicated, suffix_dedup, without_passages, lambda d: best_fit_packing(d, public_tokenizers.path("byte_bpe_50k.json"))):
        assert f(none).count() == 0

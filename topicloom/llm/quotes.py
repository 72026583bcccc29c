"""Quotation linking: who replies to whom, read off quoted passages, and conversations in reply order without quotes.

Quote levels are parsed per message. Normalised passages of quotes and of bodies are hashed, and a quote is linked to
the latest earlier message of its conversation with that passage. No step gathers a conversation or pairs up equal
passages: the latest earlier holder comes from one sorted scan, and reply order from list ranking by pointer doubling
over runs of messages that follow one another.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm.common import dropped, shuffle_partitions, stored

_QUOTE = re.compile(r"^\s{0,3}((?:>\s?)+)(.*)$")
_SAYS = re.compile(r"^\s*(?:>\s?)*(?:on\b.{0,200}\bwrote:|-{2,}\s*original message\s*-{2,}|(?:from|sent|to|subject):\s.*)\s*$", re.I)
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """(body without quotes and their introductions, quoted passages with their level) of a message, whole."""
    body: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    lines = (text or "").split("\n")
    level_before = 0
    for k, line in enumerate(lines):
        if m := _QUOTE.match(line):
            level = m[1].count(">")
            if level != level_before:
                passages.append((level, []))
            if not _SAYS.match(m[2]):
                passages[-1][1].append(m[2])
        else:
            level = 0
            ahead = next((x for x in lines[k + 1 : k + 4] if x.strip()), "")
            if not (_SAYS.match(line) and _QUOTE.match(ahead)):
                body.append(line)
        level_before = level
    quoted = [(level, "\n".join(part)) for level, part in passages if "".join(part).strip()]
    return "\n".join(body).strip() if quoted or passages else (text or ""), quoted


def units(text: str) -> set[str]:
    """Normalised passages of a text that can be linked: all of it, its paragraphs, its lines, and the sentences of each."""
    found = {normal(text), *(normal(p) for p in re.split(r"\n\s*\n", text)), *map(normal, text.split("\n"))}
    found.update(s for p in list(found) for s in _SENTENCE.split(p))
    return {u for u in found if u}


def positioned(df: DataFrame, order: list[Column], name: str, label: str) -> DataFrame:
    """``df`` with its place in a global order, from 0: a range sort, and the sizes of its partitions added up.

    The order has to tell rows apart well enough that no range holds a large share of them."""
    spark = df.sparkSession
    placed = df.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    placed = stored(placed.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), label)
    offset, starts = 0, []
    for part, n in sorted(tuple(r) for r in placed.groupBy("_part").count().collect()):  # a row per partition
        starts.append((part, offset))
        offset += n
    offsets = F.broadcast(spark.createDataFrame(starts, "_part int, _start long"))
    return placed.join(offsets, "_part").withColumn(name, F.col("_start") + F.col("_row")).drop("_row", "_start")


def running_last(df: DataFrame, flag: Column, place: str, name: str) -> DataFrame:
    """``df`` of ``positioned`` with the place of the last flagged row at or before each row."""
    spark = df.sparkSession
    marked = df.withColumn("_mark", F.when(flag, F.col(place)))
    last, carried = None, []
    for part, top in sorted(tuple(r) for r in marked.groupBy("_part").agg(F.max("_mark")).collect()):  # a row per partition
        carried.append((part, last))
        last = top if top is not None else last
    carry = F.broadcast(spark.createDataFrame(carried, "_part int, _carry long"))
    within = F.max("_mark").over(Window.partitionBy("_part").orderBy(place))  # a range of the sort, not a key
    return marked.join(carry, "_part").withColumn(name, F.coalesce(within, "_carry")).drop("_mark", "_carry")


def summed_along(nodes: DataFrame, label: str) -> DataFrame:
    """(node, total) of ``nodes(node, next, weight)``: the sum of weights from each node along its chain to the end.

    Pointer doubling: a chain of n nodes takes log2 n rounds, each one join on unique keys."""
    live = stored(nodes, label)
    while not live.where(F.col("next").isNotNull()).isEmpty():
        other = live.select(F.col("node").alias("next"), F.col("next").alias("_next"), F.col("weight").alias("_weight"))
        after = live.join(other, "next", "left").select("node", F.col("_next").alias("next"), (F.col("weight") + F.coalesce("_weight", F.lit(0))).alias("weight"))
        after = stored(after, label)
        dropped(live)
        live = after
    return live.select("node", F.col("weight").alias("total"))


_PARSED = "place long, body string, n_quotes int, quoted array<struct<key: binary, rank: int>>, held array<binary>"


def _parsed(messages: DataFrame) -> DataFrame:
    schema = pa.schema([("place", pa.int64()), ("body", pa.string()), ("n_quotes", pa.int32()), ("quoted", pa.list_(pa.struct([("key", pa.binary()), ("rank", pa.int32())]))), ("held", pa.list_(pa.binary()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            rows = []
            for place, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                body, quotes = parse(text)
                quoted: dict[bytes, int] = {}
                for level, passage in quotes:
                    for unit in units(passage):
                        key, rank = xxh3_128_digest(unit.encode("utf-8", "replace")), level * 1_000_000 - min(unit.count(" "), 999_999)
                        quoted[key] = min(rank, quoted.get(key, rank))  # the outermost quote, then the longest unit, comes first
                rows.append({"place": place, "body": body, "n_quotes": len(quotes), "quoted": [{"key": k, "rank": r} for k, r in quoted.items()], "held": [xxh3_128_digest(u.encode("utf-8", "replace")) for u in units(body)]})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return messages.select("place", "text").mapInArrow(run, _PARSED)


def linked_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n_quotes, reply_to, linked, depth, position) for every message.

    ``text`` is the body without quotes and the lines that introduce them, ``reply_to`` the turn of the message whose
    passage it quotes (``linked``), else of the one before it in its conversation, null for the first. ``depth`` counts
    replies from the first message on; ``position`` is the place in reply order: a message, then what answers it, the
    message after it first, then quoting ones by turn.
    Messages are ordered by turn; repeated turns by role and text, each a message of its own; null turns come first;
    null ids make one conversation; null texts are empty bodies. A passage that several earlier messages hold links to
    the latest. An empty table gives no rows; other columns are never looked at.
    """
    spark = conversations.sparkSession
    schema = "conv_id long, turn long, role string, text string, n_quotes int, reply_to long, linked boolean, depth long, position long"
    messages = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    order = [F.col("conv_id"), F.col("turn"), F.col("role"), F.xxhash64("text"), F.col("text")]
    messages = positioned(messages, order, "place", "messages")
    if messages.isEmpty():
        return spark.createDataFrame([], schema)
    parsed = stored(_parsed(messages), "parsed")
    whose = messages.select("place", "conv_id", "turn", "_part")
    where = whose.select("place", "conv_id")

    quotes = parsed.select("place", F.explode("quoted").alias("q")).select("place", "q.key", "q.rank").join(where, "place")
    explicit = None
    if not quotes.isEmpty():
        wanted = quotes.select(F.col("conv_id").alias("_conv"), F.col("key").alias("_key")).distinct()
        held = parsed.select("place", F.explode("held").alias("key")).join(where, "place")
        held = held.join(wanted, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("key") == F.col("_key")), "left_semi")
        both = quotes.withColumn("holds", F.lit(0)).unionByName(held.withColumn("rank", F.lit(0)).withColumn("holds", F.lit(1)))
        scan = positioned(both, [F.col("conv_id"), F.col("key"), F.col("place"), F.col("holds")], "at", "passages")
        scan = running_last(scan, F.col("holds") == 1, "at", "last")
        asked = scan.where("holds = 0").select("place", "conv_id", "key", "rank", "last")
        holder = scan.where("holds = 1").select(F.col("at").alias("last"), F.col("place").alias("original"), F.col("conv_id").alias("_conv"), F.col("key").alias("_key"))
        met = asked.join(holder, "last").where(F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("key") == F.col("_key")) & (F.col("original") < F.col("place")))
        explicit = stored(met.groupBy("place").agg(F.min(F.struct("rank", (-F.col("original")).alias("before"))).alias("best")).select("place", (-F.col("best.before")).alias("original")), "links")
    before = whose.select((F.col("place") + 1).alias("place"), F.col("conv_id").alias("_conv"), F.lit(True).alias("_prior"))
    nodes = whose.join(before, "place", "left").withColumn("follows", F.col("_prior").isNotNull() & F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv", "_prior")
    nodes = nodes.join(explicit, "place", "left") if explicit is not None else nodes.withColumn("original", F.lit(None).cast("long"))
    nodes = nodes.withColumn("linked", F.col("original").isNotNull()).withColumn("parent", F.coalesce("original", F.when(F.col("follows"), F.col("place") - 1)))
    nodes = nodes.withColumn("head", ~F.coalesce(F.col("parent") == F.col("place") - 1, F.lit(False)))
    nodes = stored(running_last(nodes, F.col("head"), "place", "run"), "nodes")

    # Runs: messages each of which answers the one before. They form a tree per conversation.
    sizes = nodes.groupBy("run").agg(F.count("*").alias("size"))
    of = nodes.select(F.col("place").alias("parent"), F.col("run").alias("up"))
    runs = stored(nodes.where("head").select(F.col("place").alias("run"), "parent", "conv_id").join(sizes, "run").join(of, "parent", "left"), "runs")
    children = runs.where("up is not null").select("run", "up", "parent")
    placed = positioned(children, [F.col("up"), F.col("parent").desc(), F.col("run")], "at", "children") if not children.isEmpty() else None
    if placed is not None:
        sibling = placed.select((F.col("at") - 1).alias("at"), F.col("run").alias("sibling"), F.col("up").alias("_up"))
        after = placed.join(sibling, "at", "left").select("run", F.when(F.col("_up") == F.col("up"), F.col("sibling")).alias("sibling"))
        first = placed.groupBy("up").agg(F.min("at").alias("at")).join(placed.select("at", "run"), "at").select(F.col("up").alias("_run"), F.col("run").alias("child"))
        tree = runs.join(after, "run", "left").join(first, F.col("run") == F.col("_run"), "left").drop("_run")
        enter = tree.select((F.col("run") * 2).alias("node"), F.coalesce(F.col("child") * 2, F.col("run") * 2 + 1).alias("next"), F.col("size").alias("weight"))
        leave = tree.select((F.col("run") * 2 + 1).alias("node"), F.coalesce(F.col("sibling") * 2, F.col("up") * 2 + 1).alias("next"), F.lit(0).cast("long").alias("weight"))
        rest = summed_along(enter.unionByName(leave), "tour").where("node % 2 = 0").select((F.col("node") / 2).cast("long").alias("run"), F.col("total").alias("rest"))
        down = runs.select(F.col("run").alias("node"), F.col("up").alias("next"), F.coalesce(F.col("parent") - F.col("up") + 1, F.lit(0)).alias("weight"))
        depth = summed_along(down, "depths").select(F.col("node").alias("run"), F.col("total").alias("above"))
        ranked = rest.join(depth, "run")
    else:
        ranked = runs.select("run", F.col("size").alias("rest"), F.lit(0).cast("long").alias("above"))
    lengths = runs.groupBy("conv_id").agg(F.sum("size").alias("length")).withColumnRenamed("conv_id", "_conv")
    ranked = runs.select("run", "conv_id").join(ranked, "run").join(lengths, F.col("conv_id").eqNullSafe(F.col("_conv"))).select("run", (F.col("length") - F.col("rest")).alias("start"), "above")

    turns = whose.select(F.col("place").alias("parent"), F.col("turn").alias("reply_to"))
    out = nodes.select("place", "run", "parent", "linked").join(ranked, "run").join(turns, "parent", "left")
    out = out.join(messages.select("place", "conv_id", "turn", "role"), "place").join(parsed.select("place", F.col("body").alias("text"), "n_quotes"), "place")
    return out.select(
        "conv_id", "turn", "role", "text", "n_quotes", "reply_to", "linked",
        (F.col("above") + F.col("place") - F.col("run")).alias("depth"), (F.col("start") + F.col("place") - F.col("run")).alias("position"),
    )

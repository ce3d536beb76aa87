"""A trie of conversations: what they share from the first turn on, and the tokens that sharing saves.

Construction is level-synchronous. Per depth, live conversations are grouped by (parent node, next turn), and the
smallest conv_id names the node; a conversation that is alone in its node is a chain from there on and leaves the rounds.
After ``FIRST`` levels, nodes whose conversations have at most ``SMALL`` turns left in all are finished level by level
inside a task each. Then leaves and savings are rolled up by joins from the deepest level to the root.

A node that many conversations share is one key: those of a thousandth of the rows or more (so at most 1,000) are joined
by broadcast, all others by a shuffle. Turns are numbered by range, so a conversation of any length is spread.

Defined results: rows with a null conv_id take no part; turns ascend, null first, ties by role and text (by their first 64 characters, then by their digests); repeated rows are
turns of their own; a null role or text is empty; texts of any length stand for themselves by SHA-256; an empty table
has no nodes. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.llm.shared import sorted_groups, written
from arborlake.operators.ordered import running

#: Conversations of one block of ids share the first turns of its first.
BLOCK, MOST_SHARED = 20, 4
#: Levels that are always made by Spark, and turns that one task finishes for a node below them.
FIRST, SMALL = 4, 20_000
#: A key with more rows than this, and than a thousandth of all, is joined by broadcast.
HOT = 10_000
#: Bytes of a piece of a list of ids.
LIST_BYTES = 1 << 16
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_KINDS = [("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string())]


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, place from 1 on, key, words): each turn's digest and its number of words."""
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.sha2(role, 256)).alias("role_sha"), F.unhex(F.sha2(text, 256)).alias("text_sha"), F.left(role, F.lit(64)).alias("role"), F.left(text, F.lit(64)).alias("begin"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    ranked = running(written(rows), ["conv_id"], ["turn", "role", "role_sha", "begin", "text_sha"], rank="rank")
    return ranked.select("conv_id", (F.col("rank") + 1).alias("place"), F.concat("role_sha", "text_sha").alias("key"), "words")


def rebuilt(turns: DataFrame, block: int = BLOCK, most: int = MOST_SHARED) -> tuple[DataFrame, DataFrame]:
    """(conv_id, n) of all conversations and (conv_id, depth, key, words) of their turns, where the first
    h = crc32(conv_id) % ``most`` turns of a block's first conversation stand in place of a conversation's own.
    """
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    sizes = written(turns.groupBy("conv_id").agg(F.count("*").alias("own")))
    base = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    convs = sizes.withColumn("h", shared).withColumn("base", F.col("conv_id") - F.col("conv_id") % block).join(base, "base", "left")
    convs = convs.select("conv_id", "base", "h", F.least("h", F.coalesce("base_own", F.lit(0))).alias("lent"), F.greatest(F.col("own") - F.col("h"), F.lit(0)).alias("left"))
    convs = written(convs)
    heads = turns.where((F.col("conv_id") % block == 0) & (F.col("place") < most)).select(F.col("conv_id").alias("base"), "place", "key", "words")
    lent = convs.select("conv_id", "base", "lent").where("lent > 0").join(heads, "base").where("place <= lent").select("conv_id", F.col("place").alias("depth"), "key", "words")
    # How far own turns move: to the lent ones' end; a hash of the id says where they start.
    moved = convs.where("lent != h").select("conv_id", (F.col("h") - F.col("lent")).alias("short"))
    own = turns.where(F.col("place") > shared)
    own = spread_join(own, moved, ["conv_id"], "left").select("conv_id", (F.col("place") - F.coalesce("short", F.lit(0))).alias("depth"), "key", "words")
    return convs.select("conv_id", (F.col("lent") + F.col("left")).alias("n")), lent.unionByName(own)


def spread_join(rows: DataFrame, one_each: DataFrame, keys: list[str], how: str = "inner", hot: int = HOT) -> DataFrame:
    """``rows`` joined with ``one_each``, which has a row a key: keys of many rows by broadcast, at most 1,000 of them, the others by a shuffle."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    seen = counts.agg(F.sum("__n").alias("total"), F.max("__n").alias("most")).first()
    limit = max(hot, (seen.total or 0) // 1000)
    if (seen.most or 0) < limit:
        return rows.join(one_each, keys, how)
    many = F.broadcast(written(counts.where(F.col("__n") >= limit).drop("__n")))
    met = rows.join(many, keys, "left_semi").join(F.broadcast(one_each.join(many, keys, "left_semi")), keys, how)
    return met.unionByName(rows.join(many, keys, "left_anti").join(one_each, keys, how))


def _sha(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()


def finished(members: DataFrame) -> DataFrame:
    """The subtrees of small nodes, each in one task: ``members`` has (node, depth, parent, n_words, conv_id, turns) with a
    conversation's turns below the node as (depth, key, words); returns NODE rows, the node itself among them.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in sorted_groups(batches, "node_key"):
            yield _rows(subtree(group.to_pylist()))

    keyed = members.select(F.concat_ws(":", "depth", "node").alias("node_key"), "*")
    return keyed.repartition("node_key").sortWithinPartitions("node_key").mapInArrow(run, NODE)


def subtree(members: list[dict]) -> list[tuple]:
    """NODE rows of a node and all below it; the levels go down one by one, and the sums up again."""
    first = members[0]
    turns = {m["conv_id"]: m["turns"] for m in members}
    levels = [{first["node"]: {"parent": first["parent"], "convs": sorted(turns), "words": first["n_words"]}}]
    while levels[-1]:
        below: dict[int, dict] = {}
        for name, node in levels[-1].items():
            split: dict[bytes, list[int]] = {}
            for c in node["convs"]:
                if len(turns[c]) >= len(levels):
                    split.setdefault(turns[c][len(levels) - 1]["key"], []).append(c)
            for convs in split.values():
                below[convs[0]] = {"parent": name, "convs": convs, "words": turns[convs[0]][len(levels) - 1]["words"]}
        levels.append(below)
    out, sums = [], {}
    for i in reversed(range(len(levels) - 1)):
        up: dict[int, list[int]] = {}
        for name, node in levels[i].items():
            children, leaves, saved = sums.get(name, (0, 0, 0))
            n = len(node["convs"])
            leaves, saved = leaves or 1, saved + (n - 1) * node["words"]
            ends = [c for c in node["convs"] if len(turns[c]) == i]
            out.append((name, first["depth"] + i, node["parent"], n, children, leaves, saved, _sha(ends)))
            s = up.setdefault(node["parent"], [0, 0, 0])
            s[0], s[1], s[2] = s[0] + 1, s[1] + leaves, s[2] + saved
        sums = up
    return out


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(_KINDS)], names=[n for n, _ in _KINDS])


def ends_digests(ends: DataFrame) -> DataFrame:
    """(depth, node, sha) of the ids (depth, node, conv_id) of each node in numerical order, comma-joined: range-sorted tasks join what they
    have into long pieces, and one task a node streams the pieces through the digest.
    """

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = []
            for node, conv in zip(zip(b.column("depth").to_pylist(), b.column("node").to_pylist(), strict=True), b.column("conv_id").to_pylist(), strict=True):
                text = str(conv)
                if not out or out[-1][0] != node or out[-1][3] > LIST_BYTES:
                    out.append([node, conv, [text], len(text)])
                else:
                    out[-1][2].append(text)
                    out[-1][3] += len(text) + 1
            yield pa.RecordBatch.from_arrays([pa.array([r[0][0] for r in out], pa.int64()), pa.array([r[0][1] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([",".join(r[2]) for r in out], pa.string())], names=["depth", "node", "first", "ids"])

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, h, done = None, None, []
        for b in batches:
            for name, ids in zip(zip(b.column("depth").to_pylist(), b.column("node").to_pylist(), strict=True), b.column("ids").to_pylist(), strict=True):
                if name != node:
                    if h is not None:
                        done.append((node, h.hexdigest()))
                    node, h = name, hashlib.sha256()
                else:
                    h.update(b",")
                h.update(ids.encode())
        if h is not None:
            done.append((node, h.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([d[0][0] for d in done], pa.int64()), pa.array([d[0][1] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], names=["depth", "node", "sha"])

    pieces = ends.select("depth", "node", "conv_id").repartitionByRange("depth", "node", "conv_id").sortWithinPartitions("depth", "node", "conv_id").mapInArrow(join, "depth long, node long, first long, ids string")
    return pieces.repartition("depth", "node").sortWithinPartitions("depth", "node", "first").mapInArrow(digest, "depth long, node long, sha string")


def trie(conversations: DataFrame, first: int = FIRST, small: int = SMALL, hot: int = HOT) -> DataFrame:
    """NODE rows: every distinct sequence of first turns of the rebuilt conversations, the root at depth 0."""
    spark = conversations.sparkSession
    convs, turns = rebuilt(numbered(conversations))
    turns = written(turns.repartitionByRange("depth", "conv_id").sortWithinPartitions("depth", "conv_id"))
    live = written(convs.select("conv_id", F.col("n").alias("length")))
    root = live.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if(F.col("length") == 0).alias("n_ends")).where("n_convs > 0")
    nodes = written(root.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"), "n_convs", F.lit(0).cast("long").alias("n_words"), "n_ends"))
    if not nodes.take(1):
        return spark.createDataFrame([], NODE)
    live = live.crossJoin(F.broadcast(nodes.select(F.col("conv_id").alias("node"))))  # one row
    big, alone, in_tasks, depth = [nodes], [], [], 0
    ended = [live.where("length = 0").select(F.lit(0).cast("long").alias("depth"), "node", "conv_id")]
    while True:
        depth += 1
        stepped = live.where(F.col("length") >= depth).join(turns.where(F.col("depth") == depth).drop("depth"), "conv_id")
        stepped = written(stepped)
        made = stepped.groupBy("node", "key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("n_words"), F.count_if(F.col("length") == depth).alias("n_ends"), F.sum(F.col("length") - depth).alias("rest"))
        made = written(made)
        alone.append(made.where("n_convs = 1").select("conv_id", F.lit(depth).cast("long").alias("depth"), F.col("node").alias("parent")))
        shared = made.where("n_convs > 1")
        if not shared.take(1):
            break
        is_small = (F.col("rest") + F.col("n_convs") <= small) if depth >= first else F.lit(False)
        marked = shared.select("node", "key", F.col("conv_id").alias("now"), is_small.alias("small"), "n_words")
        moved = written(spread_join(stepped.drop("words"), marked, ["node", "key"], hot=hot))
        in_tasks.append(moved.where("small").select(F.col("now").alias("node"), F.lit(depth).cast("long").alias("depth"), F.col("node").alias("parent"), "n_words", "conv_id", "length"))
        named = shared.where(~is_small).select("conv_id", F.lit(depth).cast("long").alias("depth"), F.col("node").alias("parent"), "n_convs", "n_words", "n_ends")
        big.append(named)
        live = moved.where(~F.col("small")).select("conv_id", "length", F.col("now").alias("node"))
        ended.append(live.where(F.col("length") == depth).select(F.lit(depth).cast("long").alias("depth"), "node", "conv_id"))
    # Chains: a conversation alone from some depth on.
    single = written(_all(alone))
    chained = spread_join(turns.select("conv_id", "depth"), single.select("conv_id", F.col("depth").alias("since"), "parent"), ["conv_id"], hot=hot).where("depth >= since")
    lengths = convs.select("conv_id", F.col("n").alias("length"))
    chained = spread_join(written(chained), lengths, ["conv_id"], hot=hot)
    last = F.col("depth") == F.col("length")
    own, none = F.sha2(F.col("conv_id").cast("string").cast("binary"), 256), F.sha2(F.lit("").cast("binary"), 256)
    one = F.lit(1).cast("long")
    chains = chained.select("conv_id", "depth", F.when(F.col("depth") == F.col("since"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), one.alias("n_convs"), F.when(last, F.lit(0)).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(last, own).otherwise(none).alias("ends_sha256"))
    out, tops = [chains], single.select("conv_id", "depth", "parent", one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
    if in_tasks:
        members = written(_all(in_tasks))
        at = members.select("conv_id", F.col("depth").alias("since"))
        below = turns.join(at, "conv_id").where("depth > since").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("depth", "key", "words"))).alias("turns"))
        met = members.drop("length").join(below, "conv_id", "left").withColumn("turns", F.coalesce("turns", F.array().cast("array<struct<depth:bigint,key:binary,words:bigint>>")))
        done = written(finished(met))
        heads = members.select(F.col("node").alias("conv_id"), "depth").distinct()
        out.append(done)
        tops = tops.unionByName(done.join(heads, ["conv_id", "depth"]).select("conv_id", "depth", F.col("parent_conv_id").alias("parent"), "n_leaves", "saved_tokens"))
    # Leaves and savings, from the deepest shared level to the root.
    tops, below = written(tops), None
    digests = written(ends_digests(_all(ended)).withColumnRenamed("node", "conv_id"))
    for level, named in reversed(list(enumerate(big))):
        children = tops.where(F.col("depth") == level + 1).drop("depth")
        children = children if below is None else children.unionByName(below)
        sums = children.groupBy(F.col("parent").alias("conv_id")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        met = named.join(sums, "conv_id", "left").join(digests, ["depth", "conv_id"], "left")
        full = met.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("leaves", F.lit(1)).alias("n_leaves"), (F.coalesce("saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("n_words")).alias("saved_tokens"), F.coalesce("sha", none).alias("ends_sha256"))
        full = written(full)
        out.append(full)
        below = full.select("conv_id", F.col("parent_conv_id").alias("parent"), "n_leaves", "saved_tokens")
    return _all(out)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

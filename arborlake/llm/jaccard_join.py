"""Exact n-gram Jaccard join with a prefix tree.

Each document is the set of its k-word shingles in one global order, rare ones first. Two
sets similar enough share a shingle among the first n - ceil(t n) + 1 of both. Sets that share such a
shingle are compared by its places in both and by bitmaps of their shingles' parities, which differ in
no more bits than the sets do in shingles; what may link by these forms candidate clusters. The sets of
a cluster, in blocks of bounded size, are stored in a trie, and each set is looked up in it: overlaps
of common beginnings are counted once, and a subtree is left when the lengths that remain cannot reach
the bound. In large clusters blocks are compared with themselves and one other first; sets that are
connected then do not meet again.

Equal sets are one node throughout, so copies never meet pairwise, and a pair that is
already connected within a block is not compared. Document frequencies come from a
counting sketch over all documents, of fixed width; it decides the order only, so an
over-count costs time, never a link.

Defined results: a null or wordless text has no shingles and links with nothing; a text of
fewer than k words has its whole sequence as its one shingle; repeated rows are linked
copies; a null doc_id takes part in links but never names a component; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborlake.llm.graph import Forest, components
from arborlake.llm.repeated_spans import text_key
from arborlake.llm.shared import sorted_groups, unused, written
from arborlake.llm.text import pieces, shingle_sets

#: Counters of the frequency sketch, in blocks that are summed apart.
WIDTH, SKETCH_BLOCK = 1 << 23, 1 << 16
#: Sets in one block of a cluster, blocks up to which every two of a cluster meet at once, and bytes of sets in one batch.
BLOCK, PAIRED, BATCH_BYTES = 1000, 8, 4 << 20
#: Sets with one prefix shingle up to which their pairs are told, and up to which one task compares their bitmaps; more become a chain.
TOLD, COMPARED = 64, 4096
#: Bits of the map of texts that a step asks for.
ASKED = 1 << 26


def frequency_sketch(texts: DataFrame, k: int, width: int = WIDTH) -> np.ndarray:
    """How many documents have a shingle of each hash modulo ``width``, as 16-bit numbers that stop at the top."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, dtype=np.int32)
        for _, own in pieces(batches):
            value, _ = shingle_sets(own, k)
            np.add.at(total, (value & np.uint64(width - 1)).astype(np.int64), 1)
        for block, part in enumerate(total.reshape(-1, SKETCH_BLOCK)):
            at = np.flatnonzero(part)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.stack([at, np.minimum(part[at], 65535)], 1).astype("<u2").tobytes()], pa.binary())], names=["block", "counts"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, None
        for b in batches:
            for block, counts in zip(b.column("block").to_pylist(), b.column("counts").to_pylist(), strict=True):
                if block != last:
                    if last is not None:
                        yield _block(last, total)
                    last, total = block, np.zeros(SKETCH_BLOCK, dtype=np.int64)
                pair = np.frombuffer(counts, dtype="<u2").reshape(-1, 2)
                total[pair[:, 0]] += pair[:, 1]
        if last is not None:
            yield _block(last, total)

    def _block(block: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.minimum(total, 65535).astype("<u2").tobytes()], pa.binary())], names=["block", "counts"])

    shape = "block int, counts binary"
    summed = texts.mapInArrow(count, shape).repartition("block").sortWithinPartitions("block").mapInArrow(add, shape)
    sketch = np.zeros(width, dtype=np.uint16)
    for r in summed.collect():  # at most 2 * width bytes
        sketch[r.block * SKETCH_BLOCK : (r.block + 1) * SKETCH_BLOCK] = np.frombuffer(bytes(r.counts), dtype="<u2")
    return sketch


def ordered_sets(texts: list[bytes], k: int, sketch: np.ndarray) -> list[np.ndarray]:
    """Each text's shingles as numbers whose order is the global one: frequency in steps, then hash."""
    value, first = shingle_sets(texts, k)
    seen = np.maximum(sketch[(value & np.uint64(len(sketch) - 1)).astype(np.int64)], 1)
    step = np.floor(8 * np.log2(seen)).astype(np.uint64)
    rank = (step << np.uint64(56)) | (value >> np.uint64(8))
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        out.append(np.sort(rank[a:b]))
    return out


def signature(ordered: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(ordered.astype("<u8").tobytes())


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def most_unlike(a, b, percent: int):
    """How many shingles two linked sets of these sizes can have apart."""
    return (a + b) * (100 - percent) // (100 + percent)


def parities(ordered: np.ndarray, percent: int) -> bytes:
    """A bitmap of which bit i tells if an odd number of shingles are i modulo its width, some four times what linked sets can have apart.

    A shingle that only one of two sets has changes one bit, so bitmaps differ in at most as many bits as sets do in shingles.
    """
    width = 64
    while width < 4 * most_unlike(len(ordered), len(ordered), percent):
        width *= 2
    odd = np.bincount((ordered & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def bits_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits the rows of two tables of 64-bit words differ, the wider ones folded to the width of the others."""
    words = min(a.shape[1], b.shape[1])
    a, b = (np.bitwise_xor.reduce(x.reshape(len(x), -1, words), axis=1) if x.shape[1] > words else x for x in (a, b))
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def _words(bits: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows whose bitmaps are of one width, and these as a table of words."""
    size = pc.binary_length(bits).to_numpy()
    for width in np.unique(size):
        at = np.flatnonzero(size == width)
        yield at, np.frombuffer(b"".join(bits.take(pa.array(at)).to_pylist()), dtype="<u8").reshape(len(at), -1)


def placed_near(a: tuple, b: tuple, percent: int):
    """If sets can link whose first common shingle this is; a and b: sizes and the shingle's places."""
    return np.minimum(a[0] - a[1], b[0] - b[1]) * (100 + percent) >= percent * (a[0] + b[0])


def near_sets(n: np.ndarray, place: np.ndarray, bits: pa.Array, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs that connect all rows, sorted by n, that may link by place and bitmap; each row meets those that are not yet connected."""
    table, row = {}, np.zeros(len(n), dtype=np.int64)
    width = np.zeros(len(n), dtype=np.int64)
    for at, words in _words(bits):
        table[words.shape[1]] = words
        row[at], width[at] = np.arange(len(at)), words.shape[1]
    free = np.ones(len(n), dtype=bool)
    low, high = np.searchsorted(n, -(-n * percent // 100)), np.searchsorted(n, n * 100 // percent, side="right")
    for start in range(len(n)):
        if not free[start]:
            continue
        free[start], reached = False, [start]
        while reached:
            i = reached.pop()
            at = low[i] + np.flatnonzero(free[low[i] : high[i]])
            at = at[placed_near((n[i], place[i]), (n[at], place[at]), percent)]
            for w in np.unique(width[at]):
                some = at[width[at] == w]
                near = some[bits_apart(table[w][row[some]], table[width[i]][row[i]][None]) <= most_unlike(n[i], n[some], percent)]
                free[near] = False
                reached += near.tolist()
                yield from ((i, j) for j in near.tolist())


class Trie:
    """Sorted sequences with shared beginnings; a node is (tokens, depth after them, least and greatest length below, first and last sequence, ends here, children)."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.sets = [sets[i] for i in self.order]
        self.roots: list[tuple] = []
        open_ = [(0, len(self.sets), 0, self.roots)]
        while open_:  # no recursion: a chain of nested sets makes a deep trie
            low, high, depth, out = open_.pop()
            while low < high:
                token, up = self.sets[low][depth], low + 1
                while up < high and self.sets[up][depth] == token:
                    up += 1
                node = self._node(low, up, depth)
                out.append(node)
                open_.append((node[6].stop, up, node[1], node[7]))
                low = up

    def _node(self, low: int, high: int, depth: int) -> tuple:
        a, b = self.sets[low], self.sets[high - 1]
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[depth:n] != b[depth:n])
        end = depth + int(differ[0]) if len(differ) else n
        sizes = [len(s) for s in self.sets[low:high]]
        ends = low
        while ends < high and len(self.sets[ends]) == end:
            ends += 1
        return a[depth:end], end, min(sizes), max(sizes), low, high, range(low, ends), []

    def links(self, x: np.ndarray, percent: int, before: int, joined) -> Iterator[int]:
        """Sequences below ``before`` that link with x; ``joined(i)`` tells which need no comparison."""
        n = len(x)
        stack = [(node, 0) for node in self.roots]
        while stack:
            (tokens, depth, shortest, longest, low, high, ends, children), common = stack.pop()
            if low >= before or shortest * 100 > n * 100 * 100 // percent or longest * 100 < n * percent or high - low == 1 and joined(low):
                continue
            at = np.searchsorted(x, tokens)
            common += int((x[np.minimum(at, n - 1)] == tokens).sum())
            left = n - int(np.searchsorted(x, tokens[-1], side="right"))
            best = min(max(depth + left, shortest), longest)  # the length that could overlap most
            if (common + min(best - depth, left)) * (100 + percent) < percent * (n + best):
                continue
            for i in ends:
                if i < before and not joined(i) and common * (100 + percent) >= percent * (n + len(self.sets[i])):
                    yield i
            stack += [(c, common) for c in children]


def block_links(own: list[tuple[bytes, np.ndarray]], other: list[tuple[bytes, np.ndarray]] | None, percent: int, known: Iterable[tuple[bytes, bytes]] = ()) -> list[tuple[bytes, bytes]]:
    """Links that connect all sets that links connect, within ``own`` or between ``own`` and ``other``, besides the ``known`` ones."""
    forest, out = Forest(), []
    for a, b in known:
        forest.union(a, b)
    trie = Trie([s for _, s in (other if other is not None else own)])
    name = [(other if other is not None else own)[i][0] for i in trie.order]
    asked = list(zip(name, trie.sets, strict=True)) if other is None else own
    for i, (x_name, x) in enumerate(asked):
        for j in trie.links(x, percent, i if other is None else len(name), lambda j, x_name=x_name: forest.find(name[j]) == forest.find(x_name)):
            if forest.union(x_name, name[j]):
                out.append((x_name, name[j]))
    return out


def _signed(docs: DataFrame, k: int, percent: int, sketch) -> DataFrame:
    """Per row: doc_id, tkey, n, node (of the set; null if empty), the shingles of its prefix and the bitmap."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own in pieces(batches):
            sets = ordered_sets(own, k, sketch.value)
            prefix = [s[: prefix_size(len(s), percent)].view(np.int64) if len(s) else s[:0].view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tkey"), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s) if len(s) else None for s in sets], pa.binary()), pa.array(prefix, pa.list_(pa.int64())), pa.array([parities(s, percent) if len(s) else None for s in sets], pa.binary())], names=["doc_id", "tkey", "n", "node", "prefix", "bits"])

    schema = docs.select("doc_id", "tkey").schema.add("n", "long").add("node", "binary").add("prefix", T.ArrayType(T.LongType())).add("bits", "binary")
    return docs.mapInArrow(run, schema)


def _whole_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by token anew, with all rows of a token in one."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        token = b.column("token").to_numpy()
        cut = int(np.searchsorted(token, token[-1]))
        if cut or held and held[0].column("token")[0].as_py() != token[-1]:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _candidates(nodes: DataFrame, percent: int) -> DataFrame:
    """(u, v) short node numbers that connect all sets that share a prefix shingle and may link, by its places and the bitmaps.

    Up to ``TOLD`` sets with one shingle are told in pairs, which then get their bitmaps; more get their bitmaps and meet again.
    Of over ``COMPARED`` sets each is told with the next by size. Sets of sizes too far apart break a chain, as no
    set before the gap can link with one after it.
    """
    told, compared = TOLD, COMPARED
    facts = nodes.select(F.xxhash64("node").alias("id"), "n", "bits")
    # size and place in one number, as rows are many
    rows = nodes.select(F.posexplode("prefix").alias("place", "token"), "n", F.xxhash64("node").alias("id")).select("token", (F.shiftleft("n", 32) + F.col("place")).alias("at"), "id")
    names = ["u", "v", "token", "at", "chained"]

    def out(u: np.ndarray, v: np.ndarray | None, token: np.ndarray | None = None, at: np.ndarray | None = None, chained: bool = False) -> Iterator[pa.RecordBatch]:
        none = pa.nulls(len(u), pa.int64())
        whole = pa.RecordBatch.from_arrays([*(none if x is None else pa.array(x, pa.int64()) for x in (u, v, token, at)), pa.array(np.full(len(u), chained))], names=names)
        yield from (whole.slice(i, 50_000) for i in range(0, len(u), 50_000))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _whole_groups(batches):
            token, at, id_ = (group.column(c).to_numpy() for c in ("token", "at", "id"))
            first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            many = np.diff(np.r_[first, len(token)])
            end, many = np.repeat(first + many, many), np.repeat(many, many)
            n, place = at >> 32, at & 0xFFFFFFFF
            one, pairs, step = np.flatnonzero((many > 1) & (many <= told)), [], 1
            while len(one):
                one = one[one + step < end[one]]
                one = one[n[one] * 100 >= n[one + step] * percent]
                other = one + step
                near = placed_near((n[one], place[one]), (n[other], place[other]), percent)
                pairs.append(np.stack([np.maximum(id_[one], id_[other])[near], np.minimum(id_[one], id_[other])[near]], axis=1))
                step += 1
            if pairs:
                yield from out(*np.unique(np.concatenate(pairs), axis=0).T)
            hot = np.flatnonzero((many > told) & (many <= compared))
            yield from out(id_[hot], None, token[hot], at[hot])
            one = np.flatnonzero((many > compared) & (np.arange(len(token)) + 1 < end))
            one = one[n[one] * 100 >= n[one + 1] * percent]
            yield from out(np.maximum(id_[one], id_[one + 1]), np.minimum(id_[one], id_[one + 1]), chained=True)

    found = written(rows.repartition("token").sortWithinPartitions("token", "at", "id").mapInArrow(run, "u long, v long, token long, at long, chained boolean"))

    def pairs_near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            most = most_unlike(b.column("n").to_numpy(), b.column("m").to_numpy(), percent)
            apart = np.zeros(b.num_rows, dtype=np.int64)
            for at, own in _words(b.column("bits")):
                for some, other in _words(b.column("others").take(pa.array(at))):
                    apart[at[some]] = bits_apart(own[some], other)
            yield b.select(["u", "v"]).filter(pa.array(apart <= most))

    def groups_near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in sorted_groups(batches, "token"):
            at, id_ = group.column("at").to_numpy(), group.column("id").to_numpy()
            pairs = np.array(list(near_sets(at >> 32, at & 0xFFFFFFFF, group.column("bits").combine_chunks(), percent)), dtype=np.int64).reshape(-1, 2)
            u, v = id_[pairs[:, 0]], id_[pairs[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

    pairs = found.where("v IS NOT NULL AND NOT chained").select("u", "v").distinct()
    pairs = pairs.join(facts.withColumnRenamed("id", "u"), "u").join(facts.select(F.col("id").alias("v"), F.col("n").alias("m"), F.col("bits").alias("others")), "v")
    hot = found.where("v IS NULL").select(F.col("u").alias("id"), "token", "at").join(facts.select("id", "bits"), "id")
    hot = hot.repartition("token").sortWithinPartitions("token", "at", "id").mapInArrow(groups_near, "u long, v long")
    # written, as what follows is Python too, and a task of both would need two workers at once
    return written(pairs.mapInArrow(pairs_near, "u long, v long").unionByName(hot).unionByName(found.where("chained").select("u", "v")))


def _asked(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """``texts`` without most of those whose tkey is not among ``keys``, told by a bitmap of hashes, so that the others are not shuffled."""
    slot, names = F.pmod(F.xxhash64("tkey", F.lit(3)), F.lit(ASKED)), texts.columns
    flags = np.zeros(ASKED // 8, dtype=np.uint8)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, group in sorted_groups(batches, "block"):
            own = np.zeros(SKETCH_BLOCK, dtype=np.uint8)
            own[group.column("at").to_numpy()] = 1
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])

    at = keys.select(slot.alias("slot")).distinct().select(F.shiftright("slot", 16).alias("block"), (F.col("slot") % SKETCH_BLOCK).alias("at"))
    for r in at.repartition("block").sortWithinPartitions("block").mapInArrow(pack, "block long, bits binary").toLocalIterator():  # at most ASKED / 8 bytes
        flags[r.block * SKETCH_BLOCK // 8 : (r.block + 1) * SKETCH_BLOCK // 8] = np.frombuffer(bytes(r.bits), dtype=np.uint8)
    shared = texts.sparkSession.sparkContext.broadcast(flags)

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column("slot").to_numpy()
            yield b.filter(pa.array(shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1)).select(names)

    return texts.withColumn("slot", slot).mapInArrow(keep, texts.schema)


def _matched(tasks: DataFrame, docs: DataFrame, k: int, percent: int, sketch) -> DataFrame:
    """(u, v) links found by tasks of rows (task, tkey, node, part, side, within): within side 'a' or between 'a' and 'b'.

    ``part`` names a node that the row's is connected with. The sets are made where the texts are joined with their tasks.
    """
    names = ["task", "node", "part", "side", "within"]
    wanted = tasks.groupBy("tkey").agg(F.collect_list(F.struct(*names)).alias("to"))

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own in pieces(batches):
            for to, s in zip(part.column("to"), ordered_sets(own, k, sketch.value), strict=True):
                packed, to = s.astype("<u8").tobytes(), to.values
                for a in range(0, len(to), max(1, BATCH_BYTES // len(packed))):
                    some = to.slice(a, max(1, BATCH_BYTES // len(packed)))
                    yield pa.RecordBatch.from_arrays([*some.flatten(), pa.array([packed] * len(some), pa.binary())], names=[*names, "items"])

    def match(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in sorted_groups(batches, "task"):
            own, other = {}, {}
            for node, side, items in zip(group.column("node").to_pylist(), group.column("side").to_pylist(), group.column("items").to_pylist(), strict=True):
                (own if side == "a" else other)[node] = np.frombuffer(items, dtype="<u8").astype(np.uint64)
            within = group.column("within")[0].as_py()
            known = zip(group.column("node").to_pylist(), group.column("part").to_pylist(), strict=True)
            found = block_links(list(own.items()), None if within else list(other.items()), percent, known) if own and (within or other) else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], names=["u", "v"])

    texts = _asked(docs.select("tkey", "text"), tasks).dropDuplicates(["tkey"]).join(wanted, "tkey")
    dealt = texts.mapInArrow(sets, "task string, node binary, part binary, side string, within boolean, items binary")
    return dealt.repartition("task").sortWithinPartitions("task").mapInArrow(match, "u binary, v binary")


def set_links(docs: DataFrame, k: int, percent: int, sketch, nodes: DataFrame) -> DataFrame:
    """(u, v) nodes: links enough to connect all that links connect; docs has tkey and text.

    In a cluster of up to ``PAIRED`` blocks every two blocks meet. In a larger one each block is compared with
    itself and with the cluster's first block; sets of one component need no more comparison with each
    other, so then only the sets outside the cluster's largest component are compared with all of it: near
    copies of one text cost in proportion to their number.
    """
    cluster = components(_candidates(nodes, percent))
    numbered = nodes.select("node", "tkey", F.xxhash64("node").alias("u"))
    inside = numbered.join(cluster.withColumnRenamed("v", "root"), "u").select("node", "tkey", "root").unionByName(numbered.join(cluster.select(F.col("v").alias("u")).distinct(), "u").select("node", "tkey", F.col("u").alias("root")))
    blocks = inside.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = written(inside.join(blocks, "root").withColumn("mine", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int")))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    task = lambda i, j, side, within=False: F.struct(F.concat_ws("/", F.col("root").cast("string"), i.cast("string"), j.cast("string")).alias("task"), lit(side).alias("side"), lit(within).alias("within"))
    zero, mine = F.lit(0), F.col("mine")
    every = F.transform(upto(F.col("blocks")), lambda j: task(F.least(mine, j), F.greatest(mine, j), F.when(mine <= j, "a").otherwise("b"), mine == j))
    with_first = F.when(mine == 0, F.transform(F.filter(upto(F.col("blocks")), lambda j: j > 0), lambda j: task(zero, j, "a"))).otherwise(F.array(task(zero, mine, "b")))
    meets = F.when(F.col("blocks") <= PAIRED, every).otherwise(F.concat(F.array(task(mine, mine, "a", True)), with_first))
    tasks = placed.select("node", F.explode(meets).alias("t"), "tkey").select("node", F.col("node").alias("part"), "tkey", "t.*")
    links = written(_matched(tasks, docs, k, percent, sketch))
    large = placed.where(F.col("blocks") > PAIRED)
    if large.isEmpty():
        return links
    stars = components(links)
    joined = stars.select(F.col("u").alias("node"), F.col("v").alias("part"))
    parts = written(large.join(joined, "node", "left").withColumn("part", F.coalesce("part", "node")))
    sizes = parts.groupBy("root", "part").agg(F.count("*").alias("n"))
    rest = sizes.groupBy("root").agg(F.max_by("part", F.struct("n", "part")).alias("largest"), F.ceil((F.sum("n") - F.max("n")) / BLOCK).cast("int").alias("rests")).where("rests > 0")
    left = parts.join(rest, "root")
    own = F.pmod(F.xxhash64("node", F.lit(2)), F.col("rests")).cast("int")
    asks = F.when(F.col("part") != F.col("largest"), F.transform(upto(F.col("blocks")), lambda j: task(own, j, "a"))).otherwise(F.array().cast("array<struct<task:string,side:string,within:boolean>>"))
    tasks = left.select("node", "part", F.explode(F.concat(F.transform(upto(F.col("rests")), lambda i: task(i, mine, "b")), asks)).alias("t"), "tkey").select("node", "part", "tkey", "t.*")
    return stars.unionByName(_matched(tasks, docs, k, percent, sketch))


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Per row: doc_id, tkey (MD5 of the text), n_shingles, component_id (smallest doc_id reachable by links)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("tkey"))
    sketch = docs.sparkSession.sparkContext.broadcast(frequency_sketch(rows.select("text"), k, width))
    signed = written(_signed(rows, k, percent, sketch))
    nodes = written(signed.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("tkey").alias("tkey"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits")))
    joined = components(set_links(rows, k, percent, sketch, nodes))
    rooted = nodes.select("node", "doc_id").join(joined.withColumnRenamed("u", "node"), "node", "left").select("node", "doc_id", F.coalesce("v", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = rooted.select("node", "root").join(least, "root").select("node", "component_id")
    out = signed.where("node IS NOT NULL").join(named, "node").select("doc_id", "tkey", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(signed.where("node IS NULL").select("doc_id", "tkey", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that links lead from to one of smaller id, with all columns.

    A row without an id stays; rows that repeat the id and text of a kept document are that document and stay.
    """
    found = jaccard_components(docs, k, percent, id_col, text_col)
    key, other = unused(docs, "key"), unused(docs, "id")
    gone = found.where("component_id IS NOT NULL AND doc_id != component_id").select(F.col("doc_id").alias(other), F.col("tkey").alias(key)).distinct()
    return docs.join(gone, (docs[id_col] == gone[other]) & (text_key(docs[text_col]) == gone[key]), "left_anti")

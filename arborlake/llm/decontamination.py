"""Benchmark decontamination with suffix arrays over shards of the training texts.

A shard is a piece of an Arrow batch, so it is bounded whatever the table holds. Each
task builds the word suffix array of its shard and binary-searches every benchmark
suffix in it; nothing is shuffled. The benchmark is dealt out in blocks of bounded size,
and only one block is broadcast per pass.

Defined results: a null or wordless text is never contaminated; a null benchmark text or
a null ``item_id`` adds no window; repeated rows each get their own result; an empty
benchmark leaves every document clean. Only the named columns are read, so further
columns of any name do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.llm.shared import rows_as, written
from arborlake.llm.text import pieces

WINDOW = 10
#: Benchmark text of one broadcast block, and training text of one shard, in bytes.
BLOCK_BYTES, SHARD_BYTES = 8 << 20, 2 << 20

#: Everything but 0-9, a-z and bytes of non-ASCII characters ends a word; A-Z are lower-cased.
_TO_WORDS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


class BenchmarkBlock:
    """The suffixes of some benchmark items, cut at ``window`` words, as sortable keys.

    ``keys[w]`` is the w-th distinct window: its word numbers, big-endian and zero-padded,
    so comparing bytes compares word sequences. ``owners`` lists (item, offset) of each.
    """

    def __init__(self, items: list[tuple[object, bytes]], window: int):
        self.window, self.vocabulary = window, {}
        found: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        self.names: list[object] = []
        pairs: set[int] = set()
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if not ids:
                continue
            n = len(self.names)
            self.names.append(name)
            pairs.update((a << 32) | b for a, b in zip(ids, ids[1:], strict=False))
            for i in range(max(1, len(ids) - window + 1)):
                found.setdefault(tuple(ids[i : i + window]), []).append((n, i))
        windows = list(found)
        self.lengths = np.array([len(w) for w in windows], dtype=np.int64)
        padded = np.zeros((len(windows), window), dtype=">u4")
        for i, w in enumerate(windows):
            padded[i, : len(w)] = w
        self.keys = padded.reshape(-1).view(f"S{4 * window}") if windows else np.zeros(0, dtype=f"S{4 * window}")
        high = padded.copy()
        high[np.arange(window)[None, :] >= self.lengths[:, None]] = 0xFFFFFFFF
        self.last_keys = high.reshape(-1).view(f"S{4 * window}") if windows else self.keys
        self.owner_at = np.r_[0, np.cumsum([len(found[w]) for w in windows])].astype(np.int64)
        self.owners = np.array([o for w in windows for o in found[w]], dtype=np.int64).reshape(-1, 2)
        self.pairs = np.array(sorted(pairs), dtype=np.int64)
        self.shortest = int(self.lengths.min()) if windows else 0


class Shard:
    """The word suffix array of some texts.

    A suffix that leaves the benchmark's word pairs before its shortest window can match
    nothing, so the array holds only the others.
    """

    def __init__(self, texts: list[bytes], block: BenchmarkBlock):
        number = block.vocabulary.get
        ids: list[int] = []
        self.at = np.zeros(len(texts) + 1, dtype=np.int64)
        for i, t in enumerate(texts):
            ids += [number(w, 0) for w in words_of(t)]
            self.at[i + 1] = len(ids)
        w = np.array(ids, dtype=np.int64)
        self.suffixes, self.keys = np.zeros(0, dtype=np.int64), block.keys[:0]
        if not len(w) or not block.shortest:
            return
        # reach[i]: how many words from i on are in the benchmark and follow each other there
        linked = np.zeros(len(w), dtype=bool)
        pair = (w[:-1] << 32) | w[1:]
        slot = np.minimum(np.searchsorted(block.pairs, pair), max(len(block.pairs) - 1, 0))
        linked[:-1] = (block.pairs[slot] == pair) & (w[:-1] > 0) & (w[1:] > 0) if len(block.pairs) else False
        linked[self.at[1:][self.at[1:] > 0] - 1] = False
        stop = np.flatnonzero(~linked)
        reach = np.where(w > 0, stop[np.searchsorted(stop, np.arange(len(w)))] - np.arange(len(w)) + 1, 0)
        start = np.flatnonzero(reach >= block.shortest)
        rows = np.zeros((len(start), block.window), dtype=">u4")
        for j in range(block.window):
            ok = reach[start] > j
            rows[ok, j] = w[start[ok] + j]
        keys = rows.reshape(-1).view(f"S{4 * block.window}") if len(start) else self.keys
        order = np.argsort(keys, kind="stable")
        self.suffixes, self.keys = start[order], keys[order]

    def search(self, block: BenchmarkBlock) -> tuple[np.ndarray, np.ndarray]:
        """(window, position) of every occurrence, by binary search of each window's key."""
        low = np.searchsorted(self.keys, block.keys, "left")
        high = np.searchsorted(self.keys, block.last_keys, "right")
        n = high - low
        window = np.repeat(np.arange(len(n)), n)
        slot = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        return window, self.suffixes[slot]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, most: int) -> Iterator[list[tuple[object, bytes]]]:
    held, size = [], 0
    rows = benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    for row in rows.toLocalIterator():
        text = row.t.encode()
        if held and size + len(text) > most:
            yield held
            held, size = [], 0
        held.append((row.i, text))
        size += len(text)
    yield held


def _maximal(shard: Shard, block: BenchmarkBlock, window: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, ...]:
    """(item, its first word, text, position, words) of the matches that can be extended on neither side."""
    n = block.owner_at[window + 1] - block.owner_at[window]
    own = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(block.owner_at[window], n)
    item, offset, pos, size = block.owners[own, 0], block.owners[own, 1], np.repeat(position, n), np.repeat(block.lengths[window], n)
    doc = np.searchsorted(shard.at, pos, side="right") - 1
    order = np.lexsort((pos, pos - offset, item))
    item, offset, pos, size, doc = (x[order] for x in (item, offset, pos, size, doc))
    head = np.flatnonzero(np.r_[True, (np.diff(item) != 0) | (np.diff(pos - offset) != 0) | (np.diff(pos) != 1) | (np.diff(doc) != 0)][: len(pos)])
    tail = np.r_[head[1:], len(item)][: len(head)] - 1
    return item[head], offset[head], doc[head], pos[head], pos[tail] - pos[head] + size[tail]


def _mark(texts: list[bytes], block: BenchmarkBlock) -> tuple[list[int], list[np.ndarray], list[set[str]], np.ndarray]:
    """Words, hit words, items and words of the longest match of each text."""
    shard = Shard(texts, block)
    window, position = shard.search(block)
    longest = np.zeros(len(texts), dtype=np.int64)
    _, _, at, _, words = _maximal(shard, block, window, position)
    np.maximum.at(longest, at, words)
    cover = np.zeros(int(shard.at[-1]) + 1, dtype=np.int64)
    np.add.at(cover, position, 1)
    np.add.at(cover, position + block.lengths[window], -1)
    hit = np.cumsum(cover)[:-1] > 0
    items: list[set[str]] = [set() for _ in texts]
    doc = np.searchsorted(shard.at, position, side="right") - 1
    if len(doc):
        seen = np.unique(np.stack([doc, window], 1), axis=0)
        for d, w in seen.tolist():
            items[d].update(str(block.names[o]) for o in block.owners[block.owner_at[w] : block.owner_at[w + 1], 0])
    spans = [hit[a:b] for a, b in zip(shard.at, shard.at[1:], strict=False)]
    return np.diff(shard.at).tolist(), spans, items, longest


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: ``id_col``, n_words, n_hit, n_items, items_sha256, contaminated, longest (words of its longest verbatim match).

    A window is ``window`` consecutive words of an item, or all words of a shorter item;
    a document word inside any occurrence of a window is hit. More than ``block_bytes``
    of benchmark text is searched block by block: the documents' marks so far are written
    to the shared folder between two passes.
    """
    spark = docs.sparkSession
    out = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    out = out.withColumns({"n_words": F.lit(0).cast("long"), "__hit": F.lit(None).cast("binary"), "__items": F.array().cast("array<string>"), "longest": F.lit(0).cast("long")})
    first = True
    for items in _blocks(benchmark, item_col, item_text_col, block_bytes):
        if not first:
            out = written(out)
        first = False
        shared = spark.sparkContext.broadcast(BenchmarkBlock(items, window))

        def search(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for part, texts in pieces(batches, "__text", SHARD_BYTES):
                n, spans, items, longest = _mark(texts, shared.value)
                hit, names = [], []
                for i, (before, known) in enumerate(zip(part.column("__hit").to_pylist(), part.column("__items").to_pylist(), strict=True)):
                    bits = np.packbits(spans[i])
                    hit.append((bits if before is None else bits | np.frombuffer(before, dtype=np.uint8)).tobytes())
                    names.append(sorted(items[i].union(known)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column("__text"), pa.array(n, pa.int64()), pa.array(hit, pa.binary()), pa.array(names, pa.list_(pa.string())), pa.array(np.maximum(longest, part.column("longest").to_numpy()), pa.int64())], names=part.schema.names)

        out = out.mapInArrow(search, out.schema)

    schema = out.select(id_col, "n_words").schema.add("n_hit", "long").add("n_items", "long").add("items_sha256", "string").add("contaminated", "boolean").add("longest", "long")

    def told(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_hit = [int(np.unpackbits(np.frombuffer(h or b"", dtype=np.uint8)).sum()) for h in b.column("__hit").to_pylist()]
            names = b.column("__items").to_pylist()
            digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column("n_words"), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in names], pa.int64()), pa.array(digest, pa.string()), pa.array([x > 0 for x in n_hit], pa.bool_()), b.column("longest")], names=[id_col, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest"])

    return out.select(id_col, "n_words", "__hit", "__items", "longest").mapInArrow(told, schema)


MATCH_SCHEMA = pa.schema([("item_id", pa.string()), ("item_start", pa.int64()), ("doc_id", pa.int64()), ("doc_start", pa.int64()), ("n_words", pa.int64())])


def verbatim_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The longest verbatim matches and where they are, in words: item_id (as a string),
    item_start, doc_id (ids have to be whole numbers), doc_start, n_words; of at least ``window`` words, or a whole
    shorter item. A match is maximal: it can be extended on neither side.
    """
    spark, found = docs.sparkSession, None
    texts_of = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    for items in _blocks(benchmark, item_col, item_text_col, block_bytes):
        shared = spark.sparkContext.broadcast(BenchmarkBlock(items, window))

        def search(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for part, texts in pieces(batches, most=SHARD_BYTES):
                shard = Shard(texts, block)
                win, position = shard.search(block)
                if not len(win):
                    continue
                item, offset, doc, pos, n = _maximal(shard, block, win, position)
                ids = part.column("id").to_pylist()
                yield rows_as({"item_id": [str(block.names[i]) for i in item], "item_start": offset, "doc_id": [ids[d] for d in doc], "doc_start": pos - shard.at[doc], "n_words": n}, MATCH_SCHEMA)

        one = texts_of.mapInArrow(search, "item_id string, item_start long, doc_id long, doc_start long, n_words long")
        found = one if found is None else found.unionByName(one)
    return found


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that hold no window of the benchmark, with all their columns.

    A stage holds one block of the benchmark: what is left is written to the shared folder between two, and a block's
    broadcast is freed when the next one's documents are there.
    """
    spark, before = docs.sparkSession, None
    for items in _blocks(benchmark, item_col, item_text_col, block_bytes):
        if before is not None:
            docs = written(docs)
            before.destroy()
        before = shared = spark.sparkContext.broadcast(BenchmarkBlock(items, window))

        def keep(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for part, texts in pieces(batches, text_col, SHARD_BYTES):
                _, spans, _, _ = _mark(texts, shared.value)
                yield part.filter(pa.array([not s.any() for s in spans], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs

"""Scores of a hashed maximum-entropy language model with a class-factored softmax.

A token is a white-space word with A-Z lower-cased, or the end of a text. Its probability is that of its class after the
tokens before it, times its own within the class. Both factors are softmax functions over hashed features of the
history: the token before, the two before together, and those two and three before (skips). A frequent word is
identified by itself and shares its class with at most ``HEADS`` others, told apart by the same features; a rarer word is
in a class by its count and by the group of its last letters, within which probabilities go by count. All unknown words
are one class, divided by the number of unseen words that Chao's estimator expects, so the model is a distribution
over words. In learning, a rare word's own occurrence is taken off its count, which makes words seen once stand for
unknown ones.

All counts are over all learning documents: each block of text sends its distinct words to the tasks that count
them and gets the counts back, so no vocabulary is held in one place. Groups come from counts of neighbouring frequent
words and endings, by exchange. Training goes over every learning token once, in ``ROUNDS`` rounds: each task makes gradient
steps over its blocks from the same weights, and the steps are averaged by row, weighted by use. What reaches the driver
is of a fixed size: histograms, at most ``FREQUENT`` words, the neighbour counts and the weights.

Defined results: a null text is empty and has its end as the only token; a null doc_id is not learned from and not held
out; repeated rows are learned from and scored each; without learning documents all probabilities are 1; further
columns are ignored. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.llm.shared import WIDE_ROWS, batches_of, shuffle_parts, sorted_groups, written
from arborlake.llm.text import LOWER, joined, mixed, pieces, prefix_hashes, span_hashes, word_bounds

FOLDS, HELD_OUT = 5, 1
BLOCK_BYTES = 1 << 19
#: Texts or blocks that a task holds at once; blocks in a row group, which is read as a whole.
BATCH_BYTES, GROUP_BLOCKS = 1 << 23, 16
#: Rows of the hashed weights, words told apart by themselves at most, and those of one class.
ROWS, FREQUENT, HEADS = 1 << 14, 512, 32
#: Groups of words by their neighbours, endings, and upper ends of the counts of rare words' classes.
GROUPS, ENDINGS = 6, 256
COUNTS = np.array([1, 2, 4, 16, 128], dtype=np.int64)
ROUNDS, STEP, BATCH = 4, 0.4, 8192
#: Learning tokens of a task in a round, so that what the tasks send stays a small share of what they read; and tasks in any case.
TASK_TOKENS, LEAST_TASKS = 1 << 20, 8
END = np.uint64(0xE0D1F5A9C3B70E1D)
_SALT = np.uint64(1 << 40)


def bins_of(count: np.ndarray) -> np.ndarray:
    """The class of a count among COUNTS; the last is open."""
    return np.searchsorted(COUNTS, count, side="left")


N_BINS = len(COUNTS) + 1


def _fold(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


BLOCKS = "block long, doc_ids array<bigint>, held array<boolean>, learn binary, lengths binary, codes binary, words binary, seen binary, ends binary"


def blocks_of(docs: DataFrame) -> DataFrame:
    """Texts in blocks: tokens as places in the block's sorted distinct word hashes, with what each word has in learning texts."""
    rest = _fold(F.col("doc_id"))
    most = BLOCK_BYTES
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(rest == HELD_OUT, F.lit(False)).alias("held"), F.coalesce(rest != HELD_OUT, F.lit(False)).alias("learn"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for part, texts in pieces(batches, most=most):
            data, at = joined(texts)
            start, end = word_bounds(data)
            lower = LOWER[data]
            hashes = span_hashes(prefix_hashes(lower), start, end)
            of = np.searchsorted(at, start, side="right") - 1
            counts = np.bincount(of, minlength=len(texts))
            # Each text's end stands after its words.
            stops = np.cumsum(counts)
            tokens = np.insert(hashes, stops, END)
            last, before = lower[end - 1].astype(np.int64), np.where(end - start > 1, lower[np.maximum(end - 2, 0)], 0).astype(np.int64)
            ending = np.insert(((last * 31 + before) % ENDINGS).astype(np.uint8), stops, 0)
            words, first, codes = np.unique(tokens, return_index=True, return_inverse=True)
            learn = part.column("learn").to_numpy(zero_copy_only=False)
            lengths = counts + 1
            seen = np.bincount(codes, weights=np.repeat(learn, lengths), minlength=len(words)).astype("<u4")
            codes = codes.astype("<u2" if len(words) <= 1 << 16 else "<u4")
            row = [[block], [part.column("doc_id").to_pylist()], [part.column("held").to_pylist()], [learn.astype(np.uint8).tobytes()], [lengths.astype("<i8").tobytes()], [codes.tobytes()], [words.tobytes()], [seen.tobytes()], [ending[first].tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.binary()] * 6], strict=True)], names=["block", "doc_ids", "held", "learn", "lengths", "codes", "words", "seen", "ends"])
            block += 1

    return rows.mapInArrow(run, BLOCKS)


REPLIES = "block long, part int, counts binary, wide boolean, spots binary, spot_words binary, heads binary, head_counts binary, head_ends binary, stats binary"
_REPLY = [("block", pa.int64()), ("part", pa.int32()), ("counts", pa.binary()), ("wide", pa.bool_()), ("spots", pa.binary()), ("spot_words", pa.binary()), ("heads", pa.binary()), ("head_counts", pa.binary()), ("head_ends", pa.binary()), ("stats", pa.binary())]


def _reply(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in _REPLY], names=[n for n, _ in _REPLY])


def _word(part: int, low: np.ndarray) -> np.ndarray:
    """Words of a part, which the high bits of their hashes tell, by their low bits."""
    return (part << 32) | low.astype(np.int64)


def counted(blocks: DataFrame) -> DataFrame:
    """Replies to the blocks: how often each of their words stands in learning texts; a row a part (null block) has the part's statistics.

    A block names a word once, whatever its count, so a frequent word is at most a row a block.
    """
    n = shuffle_parts(blocks)

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([(i << 64) // n for i in range(1, n)], dtype=np.uint64)
        for b in batches:
            for i in range(b.num_rows):
                words, seen, ends = (np.frombuffer(b.column(c)[i].as_py(), dtype=t) for c, t in (("words", "<u8"), ("seen", "<u4"), ("ends", np.uint8)))
                cut = [0, *np.searchsorted(words, edges).tolist(), len(words)]
                parts = [p for p in range(n) if cut[p + 1] > cut[p]]
                take = lambda a: [a[cut[p] : cut[p + 1]].tobytes() for p in parts]  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([b.column("block")[i].as_py()] * len(parts), pa.int64()), *[pa.array(take(a), pa.binary()) for a in (words, seen, ends)]], names=["part", "block", "words", "seen", "ends"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, group in sorted_groups(batches, "part"):
            read = lambda c, t: [np.frombuffer(x, dtype=t) for x in group.column(c).to_pylist()]  # noqa: E731, B023
            words = read("words", "<u8")
            size = [len(w) for w in words]
            distinct, first, back = np.unique(np.concatenate(words), return_index=True, return_inverse=True)
            ends = np.concatenate(read("ends", np.uint8))[first]
            seen = np.bincount(back, weights=np.concatenate(read("seen", "<u4")), minlength=len(distinct)).astype(np.int64)
            known = np.flatnonzero(seen > COUNTS[-2])
            low = (distinct & np.uint64(0xFFFFFFFF)).astype("<u4")
            order = known[np.lexsort((low[known], -seen[known]))[:FREQUENT]]
            # Blocks are told which of their words may prove to be known by themselves, so they need no hashes from here on.
            chosen = np.zeros(len(distinct), dtype=bool)
            chosen[order] = True
            at, found, marked = 0, seen[back], chosen[back]
            out = []
            for block, k in zip(group.column("block").to_pylist(), size, strict=True):
                mine, spots = found[at : at + k], np.flatnonzero(marked[at : at + k])
                wide = bool(mine.max() >> 32)
                out.append({"block": block, "part": part, "counts": mine.astype("<i8" if wide else "<u4").tobytes(), "wide": wide, "spots": spots.astype("<u4").tobytes(), "spot_words": low[back[at + spots]].tobytes()})
                at += k
            known = seen > 0
            # Words and their occurrences by ending and class of count.
            cell = ends[known].astype(np.int64) * N_BINS + bins_of(seen[known])
            stats = [np.bincount(cell, minlength=ENDINGS * N_BINS), np.bincount(cell, weights=seen[known], minlength=ENDINGS * N_BINS).astype(np.int64)]
            out.append({"part": part, "heads": low[order].tobytes(), "head_counts": seen[order].astype("<i8").tobytes(), "head_ends": ends[order].tobytes(), "stats": np.concatenate(stats).astype("<i8").tobytes()})
            yield _reply(out)

    sent = blocks.select("block", "words", "seen", "ends").mapInArrow(split, "part int, block long, words binary, seen binary, ends binary")
    return sent.repartition(n, "part").sortWithinPartitions("part").mapInArrow(count, REPLIES)


@dataclass
class Words:
    """What is known of the vocabulary, all of a fixed size."""

    total: int = 0
    distinct: int = 0
    unseen: float = 1.0
    least: int = 1 << 62  # words counted so often are known by themselves
    heads: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))  # sorted, by part and 32 bits
    head_counts: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    rare: np.ndarray = field(default_factory=lambda: np.zeros((2, ENDINGS, N_BINS), dtype=np.int64))  # words, occurrences


def vocabulary(replies: DataFrame) -> Words:
    """From the parts' statistics; the FREQUENT most frequent words are known by themselves, of equally frequent ones those of the smaller hashes."""
    size = 2 * ENDINGS * N_BINS

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                total += np.frombuffer(x, dtype="<i8")
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["stats"])

    stats = replies.where("stats IS NOT NULL").select("stats")
    rows = stats.mapInArrow(add, "stats binary").coalesce(1).mapInArrow(add, "stats binary").collect()
    total = np.frombuffer(rows[0].stats, dtype="<i8") if rows else np.zeros(size, dtype=np.int64)
    rare = total.reshape(2, ENDINGS, N_BINS).copy()
    n, v = int(rare[1].sum()), int(rare[0].sum())
    if not n:
        return Words()
    once, twice = int(rare[0, :, 0].sum()), int(rare[0, :, 1].sum())
    unseen = once * once / (2 * twice) if twice else once * (once - 1) / 2
    heads = replies.where("heads IS NOT NULL").select("heads", "head_counts", "head_ends", "part")

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                w, c, e = (np.frombuffer(b.column(k)[i].as_py(), dtype=t) for k, t in (("heads", "<u4"), ("head_counts", "<i8"), ("head_ends", np.uint8)))
                yield pa.RecordBatch.from_arrays([pa.array(_word(b.column("part")[i].as_py(), w), pa.int64()), pa.array(c, pa.int64()), pa.array(e, pa.int32())], names=["word", "n", "e"])

    # Each part names its FREQUENT most frequent words, so those of all are among them, whatever counts they share.
    chosen = heads.mapInArrow(spread, "word long, n long, e int").orderBy(F.desc("n"), F.col("word").bitwiseAND((1 << 32) - 1), "word").limit(FREQUENT).collect()
    w, c, e = (np.array([r[i] for r in chosen], dtype=np.int64) for i in range(3))
    order = np.argsort(w)
    w, c, e = w[order], c[order], e[order]
    np.subtract.at(rare, (0, e, bins_of(c)), 1)
    np.subtract.at(rare, (1, e, bins_of(c)), c)
    return Words(n, v, max(unseen, 1.0), int(c.min()) if len(c) else 1 << 62, w, c, rare)


CODED = "block long, doc_ids array<bigint>, held array<boolean>, learn binary, lengths binary, codes binary, counts binary, heads binary, ends binary"


def coded(blocks: DataFrame, replies: DataFrame, words: Words) -> DataFrame:
    """The blocks with their words' counts over all, and which frequent word each is (0xFFFF: none)."""
    empty = F.lit(None).cast("binary")
    payload = blocks.select("block", F.lit(-1).alias("part"), "doc_ids", "held", "learn", "lengths", "codes", "ends", empty.alias("counts"), F.lit(False).alias("wide"), empty.alias("spots"), empty.alias("spot_words"))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("doc_ids", "array<bigint>"), ("held", "array<boolean>"), ("learn", "binary"), ("lengths", "binary"), ("codes", "binary"), ("ends", "binary"))]
    answers = replies.where("block IS NOT NULL").select("block", "part", *none, "counts", "wide", "spots", "spot_words")
    heads, least = words.heads, words.least

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in sorted_groups(batches, "block"):
            of = [np.frombuffer(c, dtype="<i8" if w else "<u4").astype("<i8") for c, w in zip(group.column("counts").to_pylist()[1:], group.column("wide").to_pylist()[1:], strict=True)]
            begin = np.cumsum([0, *(len(c) for c in of)])
            counts = np.concatenate(of)
            spots = np.concatenate([np.frombuffer(x, dtype="<u4") + b for x, b in zip(group.column("spots").to_pylist()[1:], begin, strict=False)]).astype(np.int64)
            word = np.concatenate([_word(p, np.frombuffer(x, dtype="<u4")) for p, x in zip(group.column("part").to_pylist()[1:], group.column("spot_words").to_pylist()[1:], strict=True)])
            at, own = np.searchsorted(heads, word), np.full(len(counts), 0xFFFF, dtype="<u2")
            if len(heads):
                at = np.minimum(at, len(heads) - 1)
                is_head = (heads[at] == word) & (counts[spots] >= least)
                own[spots[is_head]] = at[is_head]
            first = group.slice(0, 1)
            yield pa.RecordBatch.from_arrays([*[first.column(c).combine_chunks() for c in ("block", "doc_ids", "held", "learn", "lengths", "codes")], pa.array([counts.tobytes()], pa.binary()), pa.array([own.tobytes()], pa.binary()), first.column("ends").combine_chunks()], names=["block", "doc_ids", "held", "learn", "lengths", "codes", "counts", "heads", "ends"])

    return payload.unionByName(answers).repartition(shuffle_parts(blocks), "block").sortWithinPartitions("block", "part").mapInArrow(run, CODED)


@dataclass
class Block:
    doc_ids: list
    held: list
    learn: np.ndarray
    lengths: np.ndarray
    codes: np.ndarray
    counts: np.ndarray
    heads: np.ndarray
    ends: np.ndarray


def read_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[Block]:
    for b in batches:
        for i in range(b.num_rows):
            get = lambda c, t: np.frombuffer(b.column(c)[i].as_py(), dtype=t)  # noqa: E731, B023
            ends = get("ends", np.uint8)
            yield Block(b.column("doc_ids")[i].as_py(), b.column("held")[i].as_py(), get("learn", np.uint8).astype(bool), get("lengths", "<i8"), get("codes", "<u2" if len(ends) <= 1 << 16 else "<u4"), get("counts", "<i8"), get("heads", "<u2").astype(np.int64), ends.astype(np.int64))


def _table_sum(rows: DataFrame, width: int, kind: str) -> np.ndarray | None:
    """The sum of the tasks' arrays by row number, added up in the tasks; (row, values) has at most a fixed number of rows."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for row, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v = np.frombuffer(x, dtype=kind)
                total[row] = total[row] + v if row in total else v.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["row", "value"])

    got = rows.repartition("row").mapInArrow(add, "row int, value binary").collect()
    if not got:
        return None
    out = np.zeros((max(r.row for r in got) + 1, width), dtype=kind)
    for r in got:
        out[r.row] = np.frombuffer(r.value, dtype=kind)
    return out


def neighbours(blocks: DataFrame, n_heads: int) -> np.ndarray:
    """How often each frequent word or ending stands right before or two before each other, in learning texts."""
    n, chunk = n_heads + ENDINGS, 32

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n * n, dtype=np.int64)
        for b in read_blocks(batches):
            sign = np.where(b.heads < n_heads, b.heads, n_heads + b.ends)[b.codes]
            doc = np.repeat(np.where(b.learn, np.arange(len(b.lengths)), -1), b.lengths)
            for gap in (1, 2):
                same = (doc[gap:] == doc[:-gap]) & (doc[gap:] >= 0)
                total += np.bincount(sign[:-gap][same] * n + sign[gap:][same], minlength=n * n)
        table = np.zeros((-(-n // chunk) * chunk, n), dtype="<i8")
        table[:n] = total.reshape(n, n)
        used = [i for i in range(len(table) // chunk) if table[i * chunk : (i + 1) * chunk].any()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([table[i * chunk : (i + 1) * chunk].tobytes() for i in used], pa.binary())], names=["row", "value"])

    got = _table_sum(blocks.mapInArrow(run, "row int, value binary"), chunk * n, "<i8")
    out = np.zeros((n, n), dtype=np.float64)
    if got is not None:
        flat = got.reshape(-1, n)[:n]
        out[: len(flat)] = flat
    return out


def _told(pairs: np.ndarray) -> float:
    """What groups of neighbours tell of each other, up to a constant: the sum of n log n of pairs less that of both margins."""
    margins = (np.where(m > 0, m * np.log(np.maximum(m, 1)), 0).sum() for m in (pairs.sum(axis=0), pairs.sum(axis=1)))
    return float(np.where(pairs > 0, pairs * np.log(np.maximum(pairs, 1)), 0).sum() - sum(margins))


def groups_of(near: np.ndarray, k: int = GROUPS, sweeps: int = 8) -> np.ndarray:
    """A group of each word or ending, so that groups of neighbours tell most of each other: one after another moves to its best group."""
    n = len(near)
    order = np.argsort(-(near.sum(axis=0) + near.sum(axis=1)), kind="stable")
    group = np.zeros(n, dtype=np.int64)
    group[order] = np.arange(n) % k
    member = np.zeros((n, k))
    member[np.arange(n), group] = 1
    pairs = member.T @ near @ member
    for _ in range(sweeps):
        moved = 0
        for s in order:
            before, own = group[s], near[s, s]
            after, ahead = near[s] @ member, near[:, s] @ member
            if not after.any() and not ahead.any():
                continue
            after[before] -= own
            ahead[before] -= own
            base = pairs.copy()
            base[before] -= after
            base[:, before] -= ahead
            base[before, before] -= own
            scores = []
            for g in range(k):
                trial = base.copy()
                trial[g] += after
                trial[:, g] += ahead
                trial[g, g] += own
                scores.append(_told(trial))
            best = int(np.argmax(scores))
            if scores[best] > scores[before] + 1e-6:
                member[s, before], member[s, best], group[s], moved = 0, 1, best, moved + 1
                base[best] += after
                base[:, best] += ahead
                base[best, best] += own
                pairs = base
        if not moved:
            break
    return group


@dataclass
class Model:
    """Classes and weights. Class numbers: frequent words' classes, then group x count class, then unknown words'."""

    words: Words
    head_class: np.ndarray
    head_place: np.ndarray  # within its class
    ending_group: np.ndarray
    n_head_classes: int
    within: np.ndarray  # log of the count of a rare class's occurrences
    outer: np.ndarray  # ROWS x classes
    inner: np.ndarray  # ROWS x HEADS
    members: np.ndarray  # of each frequent class

    @property
    def n_classes(self) -> int:
        return self.outer.shape[1]

    def classes(self, b: Block, own: bool) -> np.ndarray:
        """The class of each distinct word of a block; with ``own`` one occurrence is taken off a rare word's count."""
        count = b.counts - 1 if own else b.counts
        rare = self.n_head_classes + self.ending_group[b.ends] * N_BINS + bins_of(np.maximum(count, 1))
        rare = np.where(count <= 0, self.n_classes - 1, rare)
        return np.where(b.heads < len(self.head_class), self.head_class[np.minimum(b.heads, max(len(self.head_class) - 1, 0))], rare) if len(self.head_class) else rare

    def rows(self, sign: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Tokens x 5 feature rows: none, the token before, both before, two before, three before."""
        n_signs = len(self.head_class) + self.n_classes + 1
        begin = n_signs - 1
        before = []
        place = np.arange(len(sign)) - starts
        for gap in (1, 2, 3):
            p = np.full(len(sign), begin, dtype=np.int64)
            p[gap:] = sign[:-gap] if len(sign) > gap else p[gap:]
            before.append(np.where(place >= gap, p, begin))
        codes = np.arange(n_signs, dtype=np.uint64)
        one, two, three = (mixed(codes + _SALT * np.uint64(k)) for k in (1, 3, 4))
        pair = mixed((before[0] * n_signs + before[1]).astype(np.uint64) + _SALT * np.uint64(2))
        low = np.uint64(ROWS - 1)
        out = np.zeros((len(sign), 5), dtype=np.int64)
        for i, h in ((1, one[before[0]]), (2, pair), (3, two[before[1]]), (4, three[before[2]])):
            out[:, i] = (h & low).astype(np.int64)
        return out

    def inner_rows(self, rows: np.ndarray, cls: np.ndarray) -> np.ndarray:
        return (mixed((rows + (cls[:, None] + 1) * (ROWS * 4)).astype(np.uint64)) & np.uint64(ROWS - 1)).astype(np.int64)


def _softmax(table: np.ndarray, rows: np.ndarray, room: np.ndarray | None = None) -> np.ndarray:
    """Probabilities over a table's columns from the sums of each token's rows; ``room`` is how many columns count."""
    z = np.take(table, rows[:, 1], axis=0)
    z += table[0] if (rows[:, 0] == 0).all() else np.take(table, rows[:, 0], axis=0)
    for i in range(2, rows.shape[1]):
        z += np.take(table, rows[:, i], axis=0)
    if room is not None:
        z[np.arange(z.shape[1])[None, :] >= room[:, None]] = -np.inf
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def tokens_of(model: Model, b: Block, own: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, feature rows and frequent word (or 0xFFFF) of each token of a block."""
    cls = model.classes(b, own)
    sign = np.where(b.heads < len(model.head_class), b.heads, len(model.head_class) + cls)
    first = np.repeat(np.cumsum(b.lengths) - b.lengths, b.lengths)
    return cls[b.codes], model.rows(sign[b.codes], first), b.heads[b.codes]


def _spread(table: np.ndarray, squares: np.ndarray, used: np.ndarray, rows: np.ndarray, error: np.ndarray) -> None:
    """One gradient step: each token's error goes to its rows, with steps that shrink by what a weight has moved."""
    times = np.bincount(rows.ravel(), minlength=ROWS)
    at = np.flatnonzero(times)
    place = np.zeros(ROWS, dtype=np.int64)
    place[at] = np.arange(len(at))
    columns = [np.ascontiguousarray(place[rows[:, i]]) for i in range(rows.shape[1])]
    grad = np.zeros((error.shape[1], len(at)))
    for c, e in enumerate(np.ascontiguousarray(error.T, dtype=np.float64)):
        for column in columns:
            grad[c] += np.bincount(column, e, len(at))
    grad = grad.T.astype(np.float32)
    squares[at] += grad * grad
    table[at] -= STEP * grad / np.sqrt(squares[at] + 1.0)
    used[at] += times[at]


def learned(model: Model, blocks: DataFrame, turn: int, rounds: int = ROUNDS) -> Model:
    """The model after gradient steps over the blocks whose turn it is."""
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast(model)
    chunk = 256

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        tables = [m.outer.copy(), m.inner.copy()]
        squares, used = [np.zeros_like(t) for t in tables], [np.zeros(ROWS, dtype=np.int64) for _ in tables]
        moving = Model(m.words, m.head_class, m.head_place, m.ending_group, m.n_head_classes, m.within, *tables, m.members)
        for b in read_blocks(batches):
            cls, rows, head = tokens_of(moving, b, own=True)
            at = np.flatnonzero(np.repeat(b.learn, b.lengths))
            for a in range(0, len(at), BATCH):
                i = at[a : a + BATCH]
                p = _softmax(tables[0], rows[i])
                p[np.arange(len(i)), cls[i]] -= 1
                _spread(tables[0], squares[0], used[0], rows[i], p)
                j = i[head[i] < len(m.head_class)]
                if len(j):
                    r = moving.inner_rows(rows[j], cls[j])
                    p = _softmax(tables[1], r, m.members[cls[j]])
                    p[np.arange(len(j)), m.head_place[head[j]]] -= 1
                    _spread(tables[1], squares[1], used[1], r, p)
        names, moves, weights = [], [], []
        for k, (new, old, n) in enumerate(zip(tables, (m.outer, m.inner), used, strict=True)):
            for start in range(0, ROWS, chunk):
                w = n[start : start + chunk].astype("<f4")
                if w.any():
                    names.append(k * (ROWS // chunk) + start // chunk)
                    moves.append((new - old)[start : start + chunk].astype("<f2").tobytes())
                    weights.append(w.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(moves, pa.binary()), pa.array(weights, pa.binary())], names=["row", "move", "weight"])

    def mean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for row, x, w in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                weight = np.frombuffer(w, dtype="<f4")
                moved = np.frombuffer(x, dtype="<f2").reshape(chunk, -1) * weight[:, None]
                have = total.setdefault(row, [np.zeros_like(moved), np.zeros_like(weight)])
                have[0] += moved
                have[1] += weight
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([(x / np.maximum(w, 1)[:, None]).astype("<f4").tobytes() for x, w in total.values()], pa.binary())], names=["row", "move"])

    mine = blocks.where(F.pmod(F.xxhash64("block"), F.lit(rounds)) == turn)
    tasks = max(LEAST_TASKS, -(-model.words.total // (rounds * TASK_TOKENS)))
    got = mine.coalesce(tasks).mapInArrow(run, "row int, move binary, weight binary").repartition("row").mapInArrow(mean, "row int, move binary").collect()
    shared.unpersist()
    tables = [model.outer.copy(), model.inner.copy()]
    for r in got:
        k, start = divmod(r.row * chunk, ROWS)
        tables[k][start : start + chunk] += np.frombuffer(r.move, dtype="<f4").reshape(chunk, -1)
    return Model(model.words, model.head_class, model.head_place, model.ending_group, model.n_head_classes, model.within, *tables, model.members)


def begun(words: Words, near: np.ndarray) -> Model:
    """Classes from the neighbour counts, and weights that give each class its share of the tokens."""
    n_heads = len(words.heads)
    group = groups_of(near)
    order = np.lexsort((-words.head_counts, group[:n_heads]))
    head_class, head_place = np.zeros(n_heads, dtype=np.int64), np.zeros(n_heads, dtype=np.int64)
    cls, place, last = -1, HEADS, None
    for i in order:
        if place == HEADS or group[i] != last:
            cls, place, last = cls + 1, 0, group[i]
        head_class[i], head_place[i], place = cls, place, place + 1
    n_head_classes = cls + 1
    members = np.bincount(head_class, minlength=n_head_classes) if n_heads else np.zeros(0, dtype=np.int64)
    ending_group = group[n_heads:]
    n_classes = n_head_classes + GROUPS * N_BINS + 1
    occurrences = np.zeros((GROUPS, N_BINS), dtype=np.int64)
    np.add.at(occurrences, ending_group, words.rare[1])
    share = np.zeros(n_classes)
    if n_heads:
        share[:n_head_classes] = np.bincount(head_class, weights=words.head_counts, minlength=n_head_classes)
    share[n_head_classes:-1] = occurrences.ravel()
    share[-1] = words.rare[0, :, 0].sum()
    outer, inner = np.zeros((ROWS, n_classes), dtype=np.float32), np.zeros((ROWS, HEADS), dtype=np.float32)
    # Classes without words never occur; they keep a share that does not count.
    outer[0] = np.log((share + 0.5) / (share.sum() + 0.5 * n_classes))
    outer[0, np.flatnonzero(share == 0)] = -30.0
    if not words.total:
        outer[0, -1] = 0.0
    model = Model(words, head_class, head_place, ending_group, n_head_classes, np.log(np.maximum(occurrences.ravel(), 1)), outer, inner, members)
    if n_heads:
        bias = model.inner_rows(np.zeros((n_head_classes, 1), dtype=np.int64), np.arange(n_head_classes))[:, 0]
        for i in range(n_heads):
            inner[bias[head_class[i]], head_place[i]] = np.log(words.head_counts[i])
    return model


def fit(blocks: DataFrame, words: Words, rounds: int = ROUNDS) -> Model:
    model = begun(words, neighbours(blocks, len(words.heads)))
    if words.total:
        for turn in range(rounds):
            model = learned(model, blocks, turn, rounds)
    return model


def log10_probabilities(model: Model, b: Block) -> np.ndarray:
    """Of each token of a block."""
    cls, rows, head = tokens_of(model, b, own=False)
    count = b.counts[b.codes]
    out = np.zeros(len(cls))
    for a in range(0, len(cls), BATCH):
        s = slice(a, a + BATCH)
        p = _softmax(model.outer, rows[s])
        out[s] = np.log(np.maximum(p[np.arange(len(p)), cls[s]], 1e-30))
        is_head = head[s] < len(model.head_class)
        j = a + np.flatnonzero(is_head)
        if len(j):
            q = _softmax(model.inner, model.inner_rows(rows[j], cls[j]), model.members[cls[j]])
            out[j] += np.log(np.maximum(q[np.arange(len(j)), model.head_place[head[j]]], 1e-30))
        i = a + np.flatnonzero(~is_head & (count[s] > 0))
        out[i] += np.log(count[i]) - model.within[cls[i] - model.n_head_classes]
    out[count == 0] -= np.log(model.words.unseen)
    return out / np.log(10)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Per document: tokens, known ones, the learning tokens of all, the unigram score and the model's, both log10 of the text's probability."""
    with batches_of(docs.sparkSession, BATCH_BYTES):
        return _scored(docs, rounds)


def _scored(docs: DataFrame, rounds: int) -> DataFrame:
    few = {**WIDE_ROWS, "parquet.block.row.count.limit": str(GROUP_BLOCKS)}
    blocks = written(blocks_of(docs), options=few)
    replies = written(counted(blocks), options=WIDE_ROWS)
    words = vocabulary(replies)
    table = written(coded(blocks, replies, words), options=few)
    shared = docs.sparkSession.sparkContext.broadcast(fit(table, words, rounds))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        w = m.words
        for b in read_blocks(batches):
            doc = np.repeat(np.arange(len(b.lengths)), b.lengths)
            add = lambda x: np.bincount(doc, weights=x, minlength=len(b.lengths))  # noqa: E731, B023
            base = np.log10((b.counts + 0.5) / (w.total + 0.5 * (w.distinct + 1)))
            arrays = [pa.array(b.doc_ids, pa.int64()), pa.array(b.held, pa.bool_()), pa.array(b.lengths, pa.int64()), pa.array(add((b.counts > 0)[b.codes]).astype(np.int64), pa.int64()), pa.array(np.full(len(b.lengths), w.total), pa.int64()), pa.array(add(base[b.codes]), pa.float64()), pa.array(add(log10_probabilities(m, b)), pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    # Written here, as batches of what is returned would be as large as the session has them when it is read.
    return written(table.mapInArrow(run, SCORES))

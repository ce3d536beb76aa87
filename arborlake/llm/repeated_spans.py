"""Removal of byte spans of ``LENGTH`` bytes or more that occur twice: prefix doubling on runs of positions.

A window is the ``LENGTH`` bytes at one position; a byte goes if a window that covers it
also starts anywhere else. Sorting all positions by (rank, rank at a growing offset) would
shuffle every byte of the corpus once per round, so positions are first gathered into runs:

* the anchor of a window is the least hash among its 32-byte grams, so equal windows have
  equal anchors at equal offsets, and neighbouring windows share one;
* a run is a set of windows with one anchor and offsets in one aligned interval. All its
  windows share a core (LENGTH - interval + 1 bytes), and all lie in its hull.

Each round ranks the runs by their core, whose length grows towards LENGTH (273, 385, 400
bytes for intervals of 128, 16 and 1): a run whose core is unique holds no repeat and is
dropped; one whose hull occurs twice is repeated throughout; every other run is split into
the next round's smaller intervals, where one run stands as witness for all runs with
the same repeated hull. The last round's core is the window itself, so the result is exact.
Ranks are 128-bit fingerprints: equal bytes have equal ranks in every task without a
global sort, and Spark's shuffle by rank brings equal ones together.

Windows may also be taken in words (of bytes other than white space): then a text is the
sequence of its words' 64-bit hashes, and lengths, offsets and positions count words.

Defined results: a null text is empty; texts shorter than LENGTH keep all bytes; repeated
rows are separate documents, so a long enough text that stands twice is removed whole from
both; null ids are kept as they are; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.llm.shared import unused, written
from arborlake.llm.text import joined, mixed, pieces, powers, prefix_hashes, prefix_sums, word_bounds, word_codes

LENGTH, GRAM = 400, 32
INTERVALS = (128, 16, 1)
#: Words of a gram, and the intervals of each round, where windows are taken in words.
WORDS, WORD_GRAM, WORD_INTERVALS = 51, 8, (22, 4, 1)
#: Window starts of one piece of a text; longer texts are taken in overlapping pieces.
PIECE = 1 << 20
#: The lower bits of a gram's hash give way to its position.
_LOW = np.uint64((1 << 24) - 1)
#: Hulls of which a task remembers that it has sent them on, a power of two.
SEEN = 1 << 20


@dataclass(frozen=True)
class Rule:
    """Windows of ``length`` bytes (``width`` 1) or words (``width`` 8, the bytes of a word's hash)."""

    length: int
    intervals: tuple[int, ...]
    gram: int = GRAM
    width: int = 1

    def units(self, texts: list[bytes]) -> list[bytes]:
        return texts if self.width == 1 else word_codes(texts)

    @property
    def least_bytes(self) -> int:
        return self.length if self.width == 1 else 2 * self.length - 1


RUNS = "core binary, hull binary, n int, runs binary"
_RUNS = pa.schema([("core", pa.binary()), ("hull", pa.binary()), ("n", pa.int32()), ("runs", pa.binary())])
#: One run: its text, anchor, lowest and highest offset, and the number of its rule.
_RUN = np.dtype([("tkey", "V16"), ("at", "<i8"), ("low", "<i4"), ("high", "<i4"), ("rule", "<i4")])


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _runs(texts: list[bytes], length: int, gram: int = GRAM, width: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, anchor, lowest offset, highest offset) of the runs of windows with one anchor."""
    out, held, size = [(np.zeros(0, dtype=np.int64),) * 4], [], 0
    for i, t in enumerate(texts):
        for a in range(0, len(t) // width - length + 1, PIECE):
            part = t[a * width : (a + PIECE + length - 1) * width]
            if held and size + len(part) // width > int(_LOW) + 1:
                out.append(_runs_of(*zip(*held, strict=True), length, gram, width))
                held, size = [], 0
            held.append((i, a, part))
            size += len(part) // width
    if held:
        out.append(_runs_of(*zip(*held, strict=True), length, gram, width))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _runs_of(owner: tuple[int, ...], base: tuple[int, ...], parts: tuple[bytes, ...], length: int, gram: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs of pieces of texts (text, begin, bytes) that have room for their positions in the lower bits of a hash."""
    span = length - gram + 1
    data, at = joined(parts, b"")
    if width > 1:
        data, at = data.view(np.uint64), at // width
    assert len(data) <= int(_LOW) + 1, "positions do not fit into the lower bits"
    prefix = prefix_hashes(data) if width == 1 else prefix_sums(data)
    grams = mixed((prefix[gram:] - prefix[:-gram]) * powers(len(prefix))[1][: len(prefix) - gram])
    least = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while size * 2 <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < span:
        least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
    anchor = (least & _LOW).astype(np.int64)
    inside = np.zeros(len(data) + 1, dtype=np.int32)
    np.add.at(inside, at[:-1], 1)
    np.add.at(inside, at[1:] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(inside)[: len(anchor)] > 0)
    mark = anchor[start]
    piece = np.searchsorted(at, start, side="right") - 1
    new = np.r_[True, (np.diff(mark) != 0) | (np.diff(piece) != 0)]
    head = np.flatnonzero(new)
    tail = np.r_[head[1:], len(start)] - 1
    mark, p, owner, base = mark[head], piece[head], np.array(owner), np.array(base)
    return owner[p], mark - at[p] + base[p], mark - start[tail], mark - start[head]


def _split(text: np.ndarray, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, interval: int) -> tuple[np.ndarray, ...]:
    """The runs cut at multiples of ``interval`` of their offsets."""
    first = low // interval
    n = high // interval - first + 1
    row = np.repeat(np.arange(len(n)), n)
    cell = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + first[row]
    return text[row], anchor[row], np.maximum(low[row], cell * interval), np.minimum(high[row], cell * interval + interval - 1)


def _told_apart(hull: list[bytes], n: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Which of a piece's groups are known to be repeated, as the task has sent their hull on twice already.

    ``seen`` keeps hulls by a part of their fingerprint, once and twice sent; one that another hull puts out is sent again.
    """
    mark = np.frombuffer(b"".join(hull), dtype="<u8")[::2] | np.uint64(1)
    slot = (mark >> np.uint64(40)).astype(np.int64) & (seen.shape[1] - 1)
    known = seen[1, slot] == mark
    again = (seen[0, slot] == mark) | (n > 1)
    seen[0, slot] = mark
    seen[1, slot[again]] = mark[again]
    return known


def _ranked(texts: list[bytes], keys: list[bytes], text: np.ndarray, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, interval: int, length: int, rule: int, width: int, seen: np.ndarray) -> pa.RecordBatch:
    """The runs by the fingerprints of core and hull, those of one piece that agree in both in one row.

    So a passage that fills a text, or stands in many texts of a piece, is one row of it. Runs that the
    task knows to be repeated go in one row under a fingerprint of their own, so that a passage of
    all texts does not gather in one task of the next stage.
    """
    fingerprint = xxhash.xxh3_128_digest
    found: dict[tuple[bytes, bytes], list[int]] = {}
    near = anchor - low // interval * interval  # where the window of the interval's lowest offset starts
    for row, (i, c, h, a, b) in enumerate(zip(text.tolist(), near.tolist(), (anchor - high).tolist(), low.tolist(), high.tolist(), strict=True)):
        t = texts[i]
        core = fingerprint(t[c * width : (c - interval + 1 + length) * width], a // interval)
        hull = fingerprint(t[h * width : (h + b - a + length) * width], a << 32 | b) if interval > 1 else core
        found.setdefault((core, hull), []).append(row)
    runs = np.zeros(len(text), dtype=_RUN)
    if len(text):
        runs["tkey"] = np.frombuffer(b"".join(keys), dtype="V16")[text]
        runs["at"], runs["low"], runs["high"], runs["rule"] = anchor, low, high, rule
    core, hull, rows = [c for c, _ in found], [h for _, h in found], list(found.values())
    n = np.array([len(x) for x in rows], dtype=np.int32)
    known = _told_apart(hull, n, seen) if rows else np.zeros(0, dtype=bool)
    packed = [runs[x].tobytes() for x, k in zip(rows, known.tolist(), strict=True) if not k]
    if known.any():
        sure = runs[[i for x, k in zip(rows, known.tolist(), strict=True) if k for i in x]].tobytes()
        own = fingerprint(sure, 1 << 63)
        core, hull = [*(c for c, k in zip(core, known, strict=True) if not k), own], [*(h for h, k in zip(hull, known, strict=True) if not k), own]
        n, packed = np.r_[n[~known], np.int32(2)], [*packed, sure]
    return pa.RecordBatch.from_arrays([pa.array(core, pa.binary()), pa.array(hull, pa.binary()), pa.array(n, pa.int32()), pa.array(packed, pa.binary())], schema=_RUNS)


def _judged(runs: DataFrame, last: bool) -> DataFrame:
    """Runs whose core occurs twice: repeated (the hull occurs twice) and next (to be split again)."""
    by_core, by_hull = Window.partitionBy("core"), Window.partitionBy("core", "hull")
    # dealt by core once: the windows by core and hull need no other shuffle
    out = runs.repartition("core").withColumns({"n_hull": F.sum("n").over(by_hull), "nth": F.row_number().over(by_hull.orderBy("runs"))})
    out = out.withColumns({"n_core": F.sum("n").over(by_core), "open": F.max((F.col("n_hull") == 1).cast("int")).over(by_core)}).where("n_core > 1")
    go = (F.col("n_hull") == 1) | ((F.col("nth") == 1) & (F.col("open") == 1)) if not last else F.lit(False)
    told = out.select("runs", (F.col("n_hull") > 1).alias("repeated"), go.alias("next")).where("repeated OR next")

    def apart(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = b.column("runs").to_pylist()
            if not packed:
                continue
            n = np.array([len(p) // _RUN.itemsize for p in packed])
            rows = np.frombuffer(b"".join(packed), dtype=_RUN)
            first = np.zeros(len(rows), dtype=bool)
            first[np.cumsum(n) - n] = True  # one run stands for all of its row
            repeated, follow = (np.repeat(b.column(c).to_numpy(zero_copy_only=False), n) for c in ("repeated", "next"))
            keys = [x.tobytes() for x in rows["tkey"]]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(rows["at"].copy()), pa.array(rows["low"].copy()), pa.array(rows["high"].copy()), pa.array(rows["rule"].copy()), pa.array(repeated), pa.array(follow & first)], names=["tkey", "at", "low", "high", "rule", "repeated", "next"])

    return told.mapInArrow(apart, "tkey binary, at long, low int, high int, rule int, repeated boolean, next boolean")


def repeated_windows(texts: DataFrame, rules: tuple[Rule, ...] = (Rule(LENGTH, INTERVALS),)) -> DataFrame:
    """(tkey, rule, begin, end): ranges of window starts that are repeated, for texts (tkey, text).

    All rules go through the same rounds, so that the texts are shuffled once for all of them. A
    task that runs again must see its rows in the same order, as those of a table are: what a task has
    sent before decides under which fingerprint it sends a run.
    """
    rounds, nothing = len(rules[0].intervals), lambda: np.zeros((2, SEEN), dtype=np.uint64)
    assert all(len(r.intervals) == rounds and r.intervals[-1] == 1 for r in rules)

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()  # a third copy in one task tells nothing new
        sent = nothing()
        for part, own in pieces(batches):
            keys = part.column("tkey").to_pylist()
            use = []
            for i, k in enumerate(keys):
                seen[k] += 1
                if seen[k] <= 2:
                    use.append(i)
            own, keys = [own[i] for i in use], [keys[i] for i in use]
            for n, r in enumerate(rules):
                units = r.units(own)
                runs = _split(*_runs(units, r.length, r.gram, r.width), r.intervals[0])
                yield _ranked(units, keys, *runs, r.intervals[0], r.length, n, r.width, sent)

    judged = written(_judged(texts.mapInArrow(first, RUNS), rounds == 1))
    found = judged.where("repeated")
    single = texts.dropDuplicates(["tkey"])
    for step in range(1, rounds):
        waiting = judged.where("next").groupBy("tkey").agg(F.collect_list(F.struct("rule", "at", "low", "high")).alias("runs"))

        def again(batches: Iterable[pa.RecordBatch], step: int = step) -> Iterator[pa.RecordBatch]:
            sent = nothing()
            for part, own in pieces(batches):
                keys, runs = part.column("tkey").to_pylist(), part.column("runs").to_pylist()
                rows = np.array([(i, r["at"], r["low"], r["high"], r["rule"]) for i, known in enumerate(runs) for r in known], dtype=np.int64).reshape(-1, 5)
                for n, r in enumerate(rules):
                    mine, interval = rows[rows[:, 4] == n], r.intervals[step]
                    if len(mine):
                        yield _ranked(r.units(own), keys, *_split(mine[:, 0], mine[:, 1], mine[:, 2], mine[:, 3], interval), interval, r.length, n, r.width, sent)

        judged = written(_judged(single.join(waiting, "tkey").sortWithinPartitions("tkey").mapInArrow(again, RUNS), step == rounds - 1))
        found = found.unionByName(judged.where("repeated"))
    return found.select("tkey", "rule", (F.col("at") - F.col("high")).alias("begin"), (F.col("at") - F.col("low") + 1).alias("end"))


def removed_runs(ranges: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal runs covered by windows that start in the given ranges."""
    out: list[list[int]] = []
    for begin, end in sorted((r["begin"], r["end"]) for r in ranges or ()):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end + length - 1)
        else:
            out.append([begin, end + length - 1])
    return [(a, b) for a, b in out]


def removed_bytes(text: bytes, ranges: list[dict] | None, rules: tuple[Rule, ...]) -> list[tuple[int, int]]:
    """Maximal byte runs that any of the rules removes; of words, with the white space between them."""
    cuts = []
    for n, rule in enumerate(rules):
        own = removed_runs([r for r in ranges or () if r["rule"] == n], rule.length)
        if own and rule.width > 1:
            start, end = word_bounds(np.frombuffer(text, dtype=np.uint8))
            own = [(int(start[a]), int(end[b - 1])) for a, b in own]
        cuts += [{"begin": a, "end": b} for a, b in own]
    return removed_runs(cuts, 1)


def _with_ranges(docs: DataFrame, text_col: str, rules: tuple[Rule, ...]) -> tuple[DataFrame, str]:
    """``docs`` with the repeated ranges of each text in one more column, and the name of that column."""
    key, ranges = unused(docs, "tkey"), unused(docs, "ranges")
    keyed = docs.withColumn(key, text_key(F.col(text_col)))
    found = repeated_windows(keyed.select(F.col(key).alias("tkey"), F.col(text_col).alias("text")).where(F.octet_length("text") >= min(r.least_bytes for r in rules)), rules)
    # Written first, so that the join below has plain shuffles on both sides and Spark can split a text that many rows share.
    grouped = written(found.groupBy(F.col("tkey").alias(key)).agg(F.collect_set(F.struct("rule", "begin", "end")).alias(ranges)))
    return keyed.join(grouped, key, "left").drop(key), ranges


def removal_digest(docs: DataFrame, length: int = LENGTH, words: int = WORDS) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 by the rule of ``length`` bytes, and
    n_passage: bytes in passages of ``words`` words or more that also stand elsewhere, however few bytes these have.
    """
    rules = (Rule(length, INTERVALS), Rule(words, WORD_INTERVALS, WORD_GRAM, 8))
    rows, ranges = _with_ranges(docs.select("doc_id", "text"), "text", rules)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches):
            known = part.column(ranges).to_pylist()
            spans = [removed_bytes(t, [x for x in r or () if x["rule"] == 0], rules) for t, r in zip(texts, known, strict=True)]
            passages = [removed_bytes(t, [x for x in r or () if x["rule"] == 1], rules) for t, r in zip(texts, known, strict=True)]
            digest = []
            for t, own in zip(texts, spans, strict=True):
                h, at = hashlib.sha256(), 0
                for a, b in own:
                    h.update(t[at:a])
                    at = b
                h.update(t[at:])
                digest.append(h.hexdigest())
            total = lambda found: pa.array([sum(b - a for a, b in s) for s in found], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), total(spans), pa.array([len(s) for s in spans], pa.int64()), pa.array(digest, pa.string()), total(passages)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage"])

    schema = docs.select("doc_id").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string").add("n_passage", "long")
    return rows.mapInArrow(run, schema)


def without_repeats(docs: DataFrame, text_col: str = "text", length_col: str | None = None, length: int = LENGTH, words: int | None = None) -> DataFrame:
    """``docs`` with the repeated bytes cut out of the text, and ``length_col`` counting its characters anew.

    With ``words``, passages of so many words or more that occur twice go too, however few bytes they have.
    A character of which a cut leaves some bytes only goes as a whole. A document stays even if nothing is left of it.
    """

    rules = (Rule(length, INTERVALS), *([Rule(words, WORD_INTERVALS, WORD_GRAM, 8)] if words else []))
    rows, ranged = _with_ranges(docs, text_col, rules)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, text_col):
            out = []
            for t, ranges, known in zip(texts, part.column(ranged).to_pylist(), part.column(text_col).is_null().to_pylist(), strict=True):
                kept, at = [], 0
                for a, b in removed_bytes(t, ranges, rules):
                    kept.append(t[at:a])
                    at = b
                kept.append(t[at:])
                out.append(None if known else b"".join(x.decode("utf-8", "ignore").encode() for x in kept).decode())
            columns = dict(zip(part.schema.names, part.columns, strict=True)) | {text_col: pa.array(out, pa.string())}
            if length_col:
                columns[length_col] = pa.array([None if t is None else len(t) for t in out], part.schema.field(length_col).type)
            del columns[ranged]
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return rows.mapInArrow(run, docs.schema)

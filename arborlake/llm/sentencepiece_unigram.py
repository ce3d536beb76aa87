"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

Text gets a leading space; spaces are written as the marker U+2581 in pieces, and characters
without a piece fall back to byte pieces. A text is cut before every character that no piece
joins to the byte before it: no path crosses such a place, so the best path of a text is that of
its parts one after the other. Distinct parts are encoded once, many at a time, by array
operations over all of them.

Scores are natural logarithms of probabilities that sum to one over the pieces. The public model
is no unigram model: its scores are the merge ranks r = 0, 1, 2, ... of byte-pair encoding. As
tokenizers are not trained here, ``log_scores`` turns ranks into probabilities by Zipf's law,
1 / (1 + r) over the sum of all. Sums are taken in 32 bits with the public library's order and tie
rule (of equal paths the one with the longer last piece), so texts get the ids that the library
gives them with these scores, but for exact ties that the library's rounding decides.

Defined results: a null or empty text has no pieces and decodes to ""; a literal U+2581 in a
text decodes to a space, as in the public library; repeated rows encode alike; a column that has
a result's name already gives way to it; null ids decode to "", ids that no piece has raise.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborlake.llm.text import pieces

MARK = "▁"
_MARK = MARK.encode()
#: Score of a character without a piece below the lowest score of any piece, as in the public library.
UNKNOWN_PENALTY = 10.0
#: Parts whose ids a worker keeps; parts longer than LONG bytes are walked one at a time.
KEPT, LONG = 150_000, 256
#: Bytes of text encoded at once.
WORK_BYTES = 1 << 20


class DoubleArray:
    """A trie of byte strings: the child of node s for byte c is base[s] + c + 1 if check there is s."""

    def __init__(self, keys: list[bytes]):
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for i, key in enumerate(keys):
            at = 0
            for c in key:
                nxt = children[at].get(c)
                if nxt is None:
                    nxt = children[at][c] = len(children)
                    children.append({})
                    value.append(-1)
                at = nxt
            value[at] = i
        size, window = 4 * len(children) + 2048, 1024
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        free = np.ones(size, dtype=bool)
        free[0] = False
        place, lone, broad = {0: 0}, 1, 1  # where the search for nodes of one and of several children goes on
        for node in range(len(children)):  # parents come before children
            at = place.pop(node)
            self.value[at] = value[node]
            codes = sorted(children[node])
            if not codes:
                continue
            if len(codes) == 1:
                lone += int(free[lone:].argmax())
                base = lone - codes[0] - 1
            if len(codes) > 1 or base < 1:
                while True:
                    fits = np.logical_and.reduce([free[broad + c + 1 : broad + c + 1 + window] for c in codes])
                    if fits.any():
                        base = broad + int(fits.argmax())
                        break
                    broad += window
            self.base[at] = base
            for c in codes:
                free[base + c + 1] = False
                self.check[base + c + 1] = at
                place[children[node][c]] = base + c + 1

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The child nodes, -1 where there is none."""
        at = np.minimum(self.base[node] + byte + 1, len(self.check) - 1)
        return np.where((self.base[node] > 0) & (self.check[at] == node), at, -1)


def log_scores(ranks: np.ndarray) -> np.ndarray:
    """Log probabilities of pieces by their merge ranks (0 for the first merge), by Zipf's law."""
    weight = 1.0 / (1.0 + ranks)
    return np.log(weight / weight.sum())


@dataclass
class Unigram:
    pieces: list[bytes]
    scores: np.ndarray
    byte_ids: np.ndarray  # id of each byte's piece
    normal: np.ndarray  # ids that text can match
    trie: DoubleArray = field(init=False)
    slots: dict[bytes, int] = field(default_factory=dict)  # the parts seen; their ids are in ``kept``

    def __post_init__(self) -> None:
        self._forget()
        shown = [p.replace(_MARK, b" ") for p in self.pieces]
        self.scores = self.scores.astype(np.float32)
        self.trie = DoubleArray([shown[i] for i in self.normal])
        self.unknown = self.scores[self.normal].min() - np.float32(UNKNOWN_PENALTY)
        self.joins = np.zeros(1 << 16, dtype=bool)  # pairs of bytes that stand side by side in a piece
        for i in self.normal:
            code = np.frombuffer(shown[i], dtype=np.uint8).astype(np.int64)
            self.joins[code[:-1] << 8 | code[1:]] = True
        for b, i in enumerate(self.byte_ids):
            shown[i] = bytes([b])
        self.shown = pa.array(shown, pa.binary())

    @classmethod
    def load(cls, path: str) -> Unigram:
        """The pieces of a .model file of byte-pair encoding, with log scores by their ranks."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        normal = np.array([i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))])
        scores = np.zeros(n)
        scores[normal] = log_scores(-np.array([sp.get_score(int(i)) for i in normal]))
        return cls([x.encode() for x in names], scores, np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]), normal)

    def _edges(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, id) of every piece found in ``data``, and of characters without a piece (id -1).

        A part ends with a byte 0xFF, which no text has.
        """
        start = np.flatnonzero(((data & 0xC0) != 0x80) & (data != 0xFF))
        width = _width(data[start])
        single = np.zeros(len(start), dtype=bool)
        out = []
        row, node = np.arange(len(start)), np.zeros(len(start), dtype=np.int64)
        for depth in range(len(data)):
            at = start[row] + depth
            node = self.trie.step(node, data[at].astype(np.int64))
            row, node = row[node >= 0], node[node >= 0]
            if not len(row):
                break
            value = self.trie.value[node]
            hit = value >= 0
            out.append((start[row[hit]], np.full(int(hit.sum()), depth + 1), self.normal[value[hit]]))
            single[row[hit & (width[row] == depth + 1)]] = True
        lost = ~single
        out.append((start[lost], width[lost], np.full(int(lost.sum()), -1)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def viterbi(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the parts' best paths, one after the other, and how many each has; of equal paths the one with the longer last piece."""
        data = np.frombuffer(b"\xff".join([*parts, b""]), dtype=np.uint8)
        if not len(data):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        size = np.array([len(w) for w in parts])
        begin = np.r_[0, np.cumsum(size + 1)[:-1]]
        start, length, piece = self._edges(data)
        score = np.where(piece >= 0, self.scores[piece], self.unknown)
        end = start + length
        part = np.searchsorted(begin, start, side="right") - 1
        local = end - begin[part]
        best = np.full(len(data) + 1, -np.inf, dtype=np.float32)
        best[begin] = 0.0
        came, by = np.zeros(len(data) + 1, dtype=np.int64), np.zeros(len(data) + 1, dtype=np.int64)
        long = size[part] > LONG
        order = np.lexsort((-length, local))
        short_order = order[~long[order]]
        cuts = np.flatnonzero(np.r_[True, (np.diff(local[short_order]) != 0) | (np.diff(length[short_order]) != 0)]) if len(short_order) else np.zeros(0, dtype=np.int64)
        for a, b in zip(cuts, [*cuts, len(short_order)][1:] if len(cuts) else [], strict=True):
            e = short_order[a:b]
            new = best[start[e]] + score[e]
            better = new > best[end[e]]
            e, new = e[better], new[better]
            best[end[e]], came[end[e]], by[end[e]] = new, start[e], piece[e]
        if long.any():
            for s, t, p, v in zip(*(x[order[long[order]]].tolist() for x in (start, end, piece)), score[order[long[order]]], strict=True):
                if best[s] + v > best[t]:
                    best[t], came[t], by[t] = best[s] + v, s, p
        out_part, out_at, out_piece = [], [], []
        at, row = begin + size, np.arange(len(parts))
        while True:
            on = at > begin[row]
            at, row = at[on], row[on]
            if not len(at):
                break
            out_part.append(row)
            out_at.append(came[at])
            out_piece.append(by[at])
            at = came[at]
        if not out_part:
            return np.zeros(0, dtype=np.int64), np.zeros(len(parts), dtype=np.int64)
        row, at, ids = (np.concatenate(x) for x in (out_part, out_at, out_piece))
        order = np.lexsort((at, row))
        row, at, ids = row[order], at[order], ids[order]
        if (ids < 0).any():  # byte fallback
            times = np.where(ids >= 0, 1, _width(data[at]))
            nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            row, at, ids = (np.repeat(x, times) for x in (row, at, ids))
            ids = np.where(ids >= 0, ids, self.byte_ids[data[at + nth]])
        return ids, np.bincount(row, minlength=len(parts))

    def encode_all(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text's begin, one more at the end."""
        led = [b" " + t if t else t for t in texts]
        raw = b"".join(led)
        if _MARK in raw:
            led = [t.replace(_MARK, b" ") for t in led]
            raw = b"".join(led)
        if not raw:
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts) + 1, dtype=np.int64)
        text_at = np.r_[0, np.cumsum([len(t) for t in led])]
        data = np.frombuffer(raw, dtype=np.uint8)
        cut = (data & 0xC0) != 0x80
        cut[1:] &= ~self.joins[data[:-1].astype(np.uint16) << np.uint16(8) | data[1:]]
        cut[text_at[:-1][np.diff(text_at) > 0]] = True
        part_at = np.flatnonzero(cut)
        spans = pa.Array.from_buffers(pa.binary(), len(part_at), [None, pa.py_buffer(np.r_[part_at, len(raw)].astype(np.int32)), pa.py_buffer(raw)]).dictionary_encode()
        slot = self._slots(spans.dictionary.to_pylist())[spans.indices.to_numpy()]
        times = self.count[slot]
        total = np.cumsum(times)
        at = np.arange(int(total[-1])) + np.repeat(self.first[slot] - (total - times), times)
        return self.kept[at], np.r_[0, total][np.searchsorted(part_at, text_at)]

    def _forget(self) -> None:
        self.slots.clear()
        self.kept, self.first, self.count = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def _slots(self, parts: list[bytes]) -> np.ndarray:
        """Where ``first`` and ``count`` have each part's ids."""
        known = self.slots
        if len(known) + len(parts) > KEPT:
            new = [p for p in parts if p not in known]
            if len(known) + len(new) > KEPT:
                self._forget()
        new = [p for p in parts if p not in known]
        ids, n = self.viterbi(new)
        known.update(zip(new, range(len(self.count), len(self.count) + len(new)), strict=True))
        self.first = np.r_[self.first, len(self.kept) + np.cumsum(n) - n]
        self.count, self.kept = np.r_[self.count, n], np.r_[self.kept, ids.astype(np.int32)]
        return np.fromiter(map(known.__getitem__, parts), dtype=np.int64, count=len(parts))

    def decode_all(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The bytes of each id sequence, the leading space taken off."""
        taken = self.shown.take(pa.array(ids))
        offset = np.frombuffer(taken.buffers()[1], dtype=np.int32)[taken.offset : taken.offset + len(taken) + 1]
        raw, edge = memoryview(taken.buffers()[2] or b""), offset[at].tolist()
        return [bytes(raw[a + 1 if a < b and raw[a] == 0x20 else a : b]) for a, b in zip(edge, edge[1:], strict=False)]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text.encode()])[0].tolist()

    def decode(self, ids: Iterable[int]) -> str:
        ids = np.array(list(ids), dtype=np.int32)
        return self.decode_all(ids, np.array([0, len(ids)]))[0].decode("utf-8", "replace")

    def __getstate__(self):
        none = np.zeros(0, dtype=np.int64)
        return self.__dict__ | {"slots": {}, "kept": none.astype(np.int32), "first": none, "count": none}


def _width(lead: np.ndarray) -> np.ndarray:
    """Bytes of the characters that begin with these bytes."""
    return np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))


@lru_cache(maxsize=2)
def loaded(path: str) -> Unigram:
    return Unigram.load(path)


def _lists(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))


def _put(batch: pa.RecordBatch, schema: pa.Schema, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[n] if n in columns else batch.column(n) for n in schema], names=list(schema))


def _with(df: DataFrame, **kinds: str) -> T.StructType:
    """The schema of ``df`` with more columns at its end; of equal names the new one stays."""
    new = {n.lower() for n in kinds}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in new], *[F.lit(None).cast(k).alias(n) for n, k in kinds.items()]).schema


def encoded(docs: DataFrame, model: Unigram, text_col: str = "text", tokens_col: str = "tokens", decoded_col: str | None = None) -> DataFrame:
    """``docs`` with the ids of each text as array<int>, and with ``decoded_col`` the text decoded from these in the same pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = _with(docs, **{tokens_col: "array<int>"}, **({decoded_col: "string"} if decoded_col else {}))
    names = schema.names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, text_col, WORK_BYTES):
            ids, at = shared.value.encode_all(texts)
            more = {tokens_col: _lists(ids, at)}
            if decoded_col:
                more[decoded_col] = pa.array([t.decode("utf-8", "replace") for t in shared.value.decode_all(ids, at)], pa.string())
            yield _put(part, names, **more)

    return docs.mapInArrow(run, schema)


def decoded(rows: DataFrame, model: Unigram, tokens_col: str = "tokens", text_col: str = "decoded") -> DataFrame:
    """``rows`` with the text of each id sequence."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = _with(rows, **{text_col: "string"})
    names = schema.names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                b = batch.slice(a, 1024)
                ids = b.column(tokens_col)
                size = np.asarray(ids.value_lengths().fill_null(0))
                flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
                yield _put(b, names, **{text_col: pa.array([t.decode("utf-8", "replace") for t in shared.value.decode_all(flat, np.r_[0, np.cumsum(size)])], pa.string())})

    return rows.mapInArrow(run, schema)


def round_trip(docs: DataFrame, model: Unigram) -> DataFrame:
    """Per document: doc_id, n_pieces, n_bytes (pieces that are bytes), ids_crc32 (of the ids as
    32-bit little-endian integers), decoded_sha256 (of the decoded text in UTF-8), same.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, most=WORK_BYTES):
            m = shared.value
            ids, at = m.encode_all(texts)
            packed, cut = memoryview(ids.astype("<u4").tobytes()), at.tolist()
            is_byte = np.r_[0, np.cumsum((ids >= m.byte_ids.min()) & (ids <= m.byte_ids.max()))]
            back = m.decode_all(ids, at)
            columns = [part.column("doc_id"), pa.array(np.diff(at), pa.int64()), pa.array(np.diff(is_byte[at]), pa.int64()), pa.array([zlib.crc32(packed[4 * a : 4 * b]) for a, b in zip(cut, cut[1:], strict=False)], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in back]), pa.array([a == b for a, b in zip(back, texts, strict=True)])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_pieces", "n_bytes", "ids_crc32", "decoded_sha256", "same"])

    rows = docs.select("doc_id", "text")
    schema = rows.select("doc_id").schema.add("n_pieces", "long").add("n_bytes", "long").add("ids_crc32", "long").add("decoded_sha256", "string").add("same", "boolean")
    return rows.mapInArrow(run, schema)

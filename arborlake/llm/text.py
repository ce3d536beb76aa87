"""Texts of Arrow batches as flat byte arrays, in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about ``most`` bytes of text each, and their texts in
    UTF-8 (null: empty). A text is never cut, so one longer than ``most`` is alone.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(column)
        size = np.asarray(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        block = np.cumsum(size) // most
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = batch.slice(a, b - a)
            texts = pc.fill_null(part.column(column).cast(pa.large_binary()), b"").to_pylist()
            yield part, texts


def joined(texts: list[bytes], gap: bytes = b" ") -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array with ``gap`` after each, and where each begins, one more at the end."""
    data = np.frombuffer(gap.join([*texts, b""]), dtype=np.uint8)
    at = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + len(gap) for t in texts], out=at[1:])
    return data, at


#: Fixed odd constants of the 64-bit hashes.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64 for i below ``n``."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE_BYTES + (1 << 18))
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, dtype=np.uint64)]) for b in (BASE, BASE_INVERSE)]
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


_byte_values = mixed(np.arange(1, 257, dtype=np.uint64) * BASE)


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of value(data[j]) * BASE ** j over j < i; see ``span_hashes``."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_byte_values[data] * powers(len(data))[0], out=out[1:])
    return out


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """``prefix_hashes`` of a sequence of 64-bit values instead of bytes."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [start, end), equal for equal bytes wherever they stand."""
    return mixed((prefix[end] - prefix[start]) * powers(len(prefix))[1][start])


#: Bytes that end a word of `[^\x20\x09-\x0D]+`.
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every white-space word with A-Z lower-cased, and the text each stands in."""
    data, at = joined(texts)
    white = WHITE[data]
    edge = np.diff(np.r_[True, white, True].astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    hashes = span_hashes(prefix_hashes(LOWER[data]), start, end)
    return hashes, np.searchsorted(at, start, side="right") - 1


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the white-space words begin and end."""
    edge = np.diff(np.r_[True, WHITE[data], True].astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_codes(texts: list[bytes]) -> list[bytes]:
    """Each text as the 64-bit hashes of its white-space words as they are written, 8 bytes a word."""
    data, at = joined(texts)
    start, end = word_bounds(data)
    hashes, cut = span_hashes(prefix_hashes(data), start, end), np.searchsorted(start, at).tolist()
    return [hashes[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)]


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of ``k``-word shingles of each text, and where each text's begin.

    A text of fewer words, but not none, has its whole word sequence as its one shingle;
    one without words has none.
    """
    words, doc = word_hashes(texts)
    count = np.bincount(doc, minlength=len(texts))
    first = np.r_[0, np.cumsum(count)]
    made = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    of = np.repeat(np.arange(len(texts)), made)
    at = np.arange(len(of)) - np.repeat(np.cumsum(made) - made, made) + first[of]
    value = np.zeros(len(of), dtype=np.uint64)
    room = count[of]
    for j in range(k):
        ok = j < room
        word = np.where(ok, words[np.minimum(at + j, max(len(words) - 1, 0))], np.uint64(0)) if len(words) else value
        value = mixed(value * BASE + word + np.uint64(j + 1) * ok)
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    new = np.r_[True, (value[1:] != value[:-1]) | (of[1:] != of[:-1])][: len(value)]
    value, of = value[new], of[new]
    return value, np.r_[0, np.cumsum(np.bincount(of, minlength=len(texts)))]

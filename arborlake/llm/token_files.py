"""Token ids in length-delimited binary records, with an offset index beside each file.

Record: length of the body (8 bytes, little-endian), masked CRC-32 of those 8 bytes,
body, masked CRC-32 of the body. Body: doc_id (8 bytes, signed), then the ids as 16- or
32-bit little-endian integers, as the vocabulary needs. Index: one row per record with
the file, its byte offset and length, so that a reader may take records in any order.

Defined results: a null text is an empty one (the record holds the end id alone); a null
doc_id sorts first and reads back as null; rows with the same doc_id are written one after the
other, in the order of their texts.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.llm.shared import rows_as, shared_dir, shuffle_parts, written
from arborlake.llm.text import pieces

#: Added to a checksum after turning it by 15 bits, so that a checksum of data that hold checksums stays sound.
MASK = 0xA282EAD8
NO_ID = -(1 << 63)
#: Encoded words that a worker keeps.
KEPT = 1_000_000
#: Bytes of text encoded at once; each distinct word of them is looked up once.
WORK_BYTES = 4 << 20
#: Bytes of one coalesced read.
READ_BYTES = 8 << 20


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK) & 0xFFFFFFFF


def framed(body: bytes) -> bytes:
    head = struct.pack("<Q", len(body))
    return b"".join((head, struct.pack("<I", masked(head)), body, struct.pack("<I", masked(body))))


def unframed(record: memoryview | bytes) -> bytes:
    """The body of one whole record; raises ValueError if a checksum differs."""
    head, (head_sum,) = bytes(record[:8]), struct.unpack_from("<I", record, 8)
    (n,) = struct.unpack("<Q", head)
    body = bytes(record[12 : 12 + n])
    if masked(head) != head_sum or len(record) != n + 16 or masked(body) != struct.unpack_from("<I", record, 12 + n)[0]:
        raise ValueError("damaged record")
    return body


#: A byte-level BPE splits before a single space that a visible character follows, and between an ASCII letter
#: and any other ASCII character, so the words between such places can be encoded one by one, and equal words once.
_UNSURE = re.compile("[\\s\x1c-\x1f\x85\u180e\u200b\u2060\ufeff]")
_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_OTHER = ~_LETTER
_OTHER[0x80:] = False


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def part_encoder(path: str) -> PartEncoder:
    """A worker's encoder, which it keeps from task to task."""
    return PartEncoder(path)


class PartEncoder:
    """Encodes texts word by word and keeps the ids of words seen.

    A word begins at the text's start, at a space, or where an ASCII letter meets another ASCII character. A
    text with a special token, or with a space before other white space, is encoded whole.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.byte_names = self._byte_names()
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.slots: dict[bytes, int] = {}  # words with the space before them
        self._forget()

    def _forget(self) -> None:
        self.slots.clear()
        self.ids, self.first, self.count, self.unsure = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def _byte_names(self) -> dict[int, str]:
        """The character by which the vocabulary writes each byte, asked from the library."""
        from tokenizers.pre_tokenizers import ByteLevel

        name = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        out: dict[int, str] = {}
        three = [0x800, *range(0x1000, 0x10000, 0x1000)]
        for c in [*range(0x800), *three, 0x10000, *range(0x40000, 0x110000, 0x40000)]:  # all bytes that UTF-8 has
            out.update(zip(chr(c).encode(), name(chr(c))[0][0], strict=True))
        return out

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text's begin, one more at the end."""
        raw = b"".join(texts)
        text_at = np.r_[0, np.cumsum([len(t) for t in texts])]
        if not raw:
            return np.zeros(0, "<u4"), text_at
        data = np.frombuffer(raw, dtype=np.uint8)
        cut = data == 0x20
        cut[1:] |= _LETTER[data[:-1]] & _OTHER[data[1:]]
        cut[text_at[:-1][np.diff(text_at) > 0]] = True
        word_at = np.flatnonzero(cut)
        spans = pa.Array.from_buffers(pa.binary(), len(word_at), [None, pa.py_buffer(np.r_[word_at, len(raw)].astype(np.int32)), pa.py_buffer(raw)]).dictionary_encode()
        slot = self._slots(spans.dictionary.to_pylist())[spans.indices.to_numpy()]
        edge = np.searchsorted(word_at, text_at)
        whole = set(np.flatnonzero(np.diff(np.r_[0, np.cumsum(self.unsure[slot])][edge])).tolist())
        if any(x in raw for x in self.special):
            whole |= {i for i, t in enumerate(texts) if any(x in t for x in self.special)}
        times = self.count[slot]
        total = np.cumsum(times)
        flat = self.ids[np.arange(int(total[-1])) + np.repeat(self.first[slot] - (total - times), times)]
        at = np.r_[0, total][edge]
        if not whole:
            return flat, at
        parts = [flat[a:b] for a, b in zip(at, at[1:], strict=False)]
        order = sorted(whole)
        for i, code in zip(order, self._ids([texts[i].decode() for i in order]), strict=True):
            parts[i] = np.frombuffer(code, dtype="<u4")
        return np.concatenate(parts), np.r_[0, np.cumsum([len(x) for x in parts])]

    def _slots(self, words: list[bytes]) -> np.ndarray:
        """Where ``first`` and ``count`` have each word's ids."""
        known = self.slots
        new = [w for w in words if w not in known]
        if len(known) + len(new) > KEPT:
            self._forget()
            new = words
        codes, unsure, rest = [b""] * len(new), np.zeros(len(new), dtype=bool), []
        tokenize, packed, space = self.tokenizer.model.tokenize, self.packed, self.byte_names[0x20]
        for i, w in enumerate(new):
            text = w.decode()
            if text[0] != " ":
                rest.append((i, text))
            elif len(text) == 1 or _UNSURE.match(text, 1):
                unsure[i] = True
            elif text[1:].isalpha():
                name = space + (text[1:] if text.isascii() else w[1:].decode("latin-1").translate(self.byte_names))
                codes[i] = b"".join([packed[t.id] for t in tokenize(name)])
            else:
                rest.append((i, text))
        for (i, _), ids in zip(rest, self._ids([t for _, t in rest]), strict=True):
            codes[i] = ids
        n = np.array([len(c) // 4 for c in codes], dtype=np.int64)
        known.update(zip(new, range(len(self.count), len(self.count) + len(new)), strict=True))
        self.first = np.r_[self.first, len(self.ids) + np.cumsum(n) - n]
        self.count, self.unsure = np.r_[self.count, n], np.r_[self.unsure, unsure]
        self.ids = np.r_[self.ids, np.frombuffer(b"".join(codes), dtype="<u4")]
        return np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))

    def _ids(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


INDEX = "shard int, doc_id long, file string, at long, size long, n_tokens long"
_INDEX = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("file", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("n_tokens", pa.int64())])


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = None, shards: int | None = None) -> DataFrame:
    """Writes the records in ascending ``id_col`` order, one file a shard, and returns the index.

    The rows are dealt by ranges of ``id_col``, so shard i holds smaller ids than shard
    i + 1; the file of a failed or repeated task is not in the index.
    """
    wide = _tokenizer(tokenizer_path).get_vocab_size(with_added_tokens=True) > 1 << 16
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange(shards, "doc_id") if shards else rows.repartitionByRange("doc_id")
    dealt = dealt.sortWithinPartitions("doc_id", "text")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        shard, encode, out, at, name = TaskContext.get().partitionId(), None, None, 0, ""
        tail = b"" if end_id is None else struct.pack("<I" if wide else "<H", end_id)
        try:
            for part, texts in pieces(batches, most=WORK_BYTES):
                if out is None:
                    store, path = fs.FileSystem.from_uri(folder)
                    store.create_dir(path)
                    name = f"{path}/tokens-{shard:05d}-{uuid.uuid4().hex}.rec"
                    out, encode = store.open_output_stream(name), part_encoder(tokenizer_path)
                ids, offsets, sizes = part.column("doc_id").to_pylist(), [], []
                flat, begin = encode(texts)
                width, counts = (4 if wide else 2), np.diff(begin) + (end_id is not None)
                codes, begin = memoryview((flat if wide else flat.astype("<u2")).tobytes()), (begin * width).tolist()
                for i, doc_id in enumerate(ids):
                    record = framed(b"".join((struct.pack("<q", NO_ID if doc_id is None else doc_id), codes[begin[i] : begin[i + 1]], tail)))
                    out.write(record)
                    offsets.append(at)
                    sizes.append(len(record))
                    at += len(record)
                yield rows_as({"shard": [shard] * len(ids), "doc_id": ids, "file": [name] * len(ids), "at": offsets, "size": sizes, "n_tokens": counts}, _INDEX)
        finally:
            if out is not None:
                out.close()

    return written(dealt.mapInArrow(write, INDEX))


def read_ranges(batches: Iterable[pa.RecordBatch], folder: str, gap: int = 1 << 16, most: int = READ_BYTES) -> Iterator[tuple[pa.RecordBatch, list[memoryview]]]:
    """The byte ranges (file, at, size) of sorted index rows, read in few coalesced reads."""
    store, _ = fs.FileSystem.from_uri(folder)
    opened, handle = None, None
    for batch in batches:
        files, at, size = (batch.column(c).to_pylist() for c in ("file", "at", "size"))
        i = 0
        while i < len(files):
            j, end = i, at[i] + size[i]
            while j + 1 < len(files) and files[j + 1] == files[i] and 0 <= at[j + 1] - end <= gap and at[j + 1] + size[j + 1] - at[i] <= most:
                j += 1
                end = at[j] + size[j]
            if opened != files[i]:
                if handle is not None:
                    handle.close()
                opened, handle = files[i], store.open_input_file(files[i])
            data = memoryview(handle.read_at(end - at[i], at[i]))
            yield batch.slice(i, j - i + 1), [data[at[k] - at[i] : at[k] - at[i] + size[k]] for k in range(i, j + 1)]
            i = j + 1
    if handle is not None:
        handle.close()


def read_token_files(index: DataFrame, folder: str, wide: bool = False, **columns) -> DataFrame:
    """(doc_id, tokens as array<int>) of the index rows, in any selection and order."""
    code = "<u4" if wide else "<u2"

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, records in read_ranges(batches, folder):
            bodies = [unframed(r) for r in records]
            ids = [struct.unpack_from("<q", b)[0] for b in bodies]
            yield pa.RecordBatch.from_arrays([pa.array([None if i == NO_ID else i for i in ids], pa.int64()), pa.array([np.frombuffer(b, dtype=code, offset=8).astype(np.int32) for b in bodies], pa.list_(pa.int32()))], names=["doc_id", "tokens"])

    return index.mapInArrow(read, "doc_id long, tokens array<int>")


def token_digests(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes ``docs`` and reads the files back: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before one. The totals of the shards (one
    row each) are summed first, then the running sum goes on inside each shard.
    """
    folder = shared_dir(spark)
    index = write_token_files(docs, tokenizer_path, folder, id_col, text_col, end_id)
    wide = _tokenizer(tokenizer_path).get_vocab_size(with_added_tokens=True) > 1 << 16
    code = "<u4" if wide else "<u2"
    totals = {r.shard: r.n for r in index.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()}
    before = dict(zip(sorted(totals), np.cumsum([0, *(totals[s] for s in sorted(totals))]).tolist(), strict=False))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start: dict[int, int] = {}
        for part, records in read_ranges(batches, folder):
            ids, starts, counts, sums = [], [], [], []
            for shard, record in zip(part.column("shard").to_pylist(), records, strict=True):
                body = unframed(record)
                doc_id = struct.unpack_from("<q", body)[0]
                tokens = np.frombuffer(body, dtype=code, offset=8).astype("<u4")
                ids.append(None if doc_id == NO_ID else doc_id)
                starts.append(start.setdefault(shard, before[shard]))
                start[shard] += len(tokens)
                counts.append(len(tokens))
                sums.append(zlib.crc32(tokens.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, starts, counts, sums)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    dealt = index.repartition(shuffle_parts(index), "shard").sortWithinPartitions("shard", "at")
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")

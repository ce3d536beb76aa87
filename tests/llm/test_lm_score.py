"""Counts and the unigram score by brute force; the model's probabilities add up to one and beat the unigram score on held-out texts."""

import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from arborlake.llm import lm_score, shared
from arborlake.llm.shared import written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + ["\0end"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None, 1.0) for i, t in rows], SCHEMA).repartition(3)


def texts(seed, n):
    rng = random.Random(seed)
    tongues = [[f"{p}{i}{e}" for i in range(300)] for p, e in (("th", "ing"), ("sch", "keit"), ("qu", "eux"))]
    out = []
    for i in range(n):
        t = tongues[i % 3]
        out.append(" ".join(t[min(int(rng.paretovariate(0.6)) - 1, 299)] for _ in range(rng.randrange(1, 120))).title())
    return out


@pytest.mark.parametrize("block", [1 << 19, 600])
def test_counts_and_base_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", block)
    rows = list(enumerate(texts(1, 60))) + [(100, None), (101, ""), (102, " \n\t"), (103, "Ünï ÜNÏ unseen word"), (5, "repeated id"), (5, "repeated id"), (None, "null id"), (104, "long " * 60_000)]
    learn = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 != 1
    seen = Counter(w for i, t in rows if learn(i) for w in tokens(t))
    n, v = sum(seen.values()), len(seen)
    want = []
    for i, t in rows:
        ws = tokens(t)
        want.append((i, i is not None and not learn(i), len(ws), sum(seen[w] > 0 for w in ws), n, sum(math.log10((seen[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)))
    got = lm_score.score(frame(spark, rows), rounds=2).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], round(r[5], 6))
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(g)[:5] == w[:5] and g.base_score == pytest.approx(w[5]) and math.isfinite(g.score) and g.score < 0


def test_probabilities_add_up_and_held_out_gains(spark):
    docs = frame(spark, list(enumerate(texts(2, 600)))).coalesce(1)
    blocks = written(lm_score.blocks_of(docs))
    replies = written(lm_score.counted(blocks))
    words = lm_score.vocabulary(replies)
    table = written(lm_score.coded(blocks, replies, words))
    model = lm_score.fit(table, words, rounds=2)
    (b,) = list(lm_score.read_blocks(table.toArrow().to_batches()))
    known = np.flatnonzero(b.counts > 0)
    assert len(known) == words.distinct and len(words.heads) > 0
    one = lambda a, x: np.r_[a, x]
    counts, heads, ends = one(b.counts, 0), one(b.heads, 0xFFFF), one(b.ends, 0)
    for before in ([], [int(known[3])], [int(known[5]), int(known[50]), int(known[7])]):
        codes = np.array([c for w in [*known.tolist(), len(b.counts)] for c in [*before, w]])
        lengths = np.full(len(known) + 1, len(before) + 1)
        p = 10 ** lm_score.log10_probabilities(model, lm_score.Block([], [], np.zeros(len(lengths), dtype=bool), lengths, codes, counts, heads, ends))[len(before) :: len(before) + 1]
        empty = [g for g in range(model.n_head_classes, model.n_classes - 1) if not np.any(model.classes(b, False)[known] == g)]
        lost = lm_score._softmax(model.outer, model.rows(np.array([0]), np.array([0])))[0, empty].sum() if not before else None
        total = p[:-1].sum() + p[-1] * words.unseen
        assert total <= 1 + 1e-4 and total > (1 - lost - 1e-4 if lost is not None else 0.9)
    got = lm_score.score(docs, rounds=2).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert got["sum(score)"] > got["sum(base_score)"]


def test_order_matters_and_counts_do_not(spark):
    """A model of histories gives a text and its shuffled words different scores; the unigram score is the same."""
    rng = random.Random(4)
    rows = list(enumerate(["a1 b2 c3 d4 e5 f6 g7 h8 " * 6] * 80))
    shuffled = rows[0][1].split()
    rng.shuffle(shuffled)
    rows += [(1001, rows[0][1]), (1002, " ".join(shuffled))]
    got = {r.doc_id: r for r in lm_score.score(frame(spark, rows), rounds=2).collect()}
    assert got[1001].score > got[1002].score + 5 and got[1001].base_score == pytest.approx(got[1002].base_score)


def test_nothing_and_nothing_to_learn_from(spark):
    assert lm_score.score(frame(spark, [])).collect() == []
    alone = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    (r,) = lm_score.score(frame(spark, [(alone, "only held out")])).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (4, 0, 0, 0.0) and abs(r.score) < 1e-6


def test_words_of_one_count_are_told_apart_up_to_the_limit(spark):
    """More equally frequent words than are known by themselves: those of the smaller hashes are, not none."""
    rows = [(i, " ".join(f"w{k}x" for k in range(lm_score.FREQUENT + 100))) for i in range(100)]
    n = sum(zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in rows)
    blocks = written(lm_score.blocks_of(frame(spark, rows)))
    replies = written(lm_score.counted(blocks))
    words = lm_score.vocabulary(replies)
    # The end of a text is as frequent as each word.
    assert len(words.heads) == lm_score.FREQUENT and (words.head_counts == n).all() and words.distinct == lm_score.FREQUENT + 101
    assert words.rare[0].sum() == 101 and words.rare[1].sum() == 101 * n
    for b in lm_score.read_blocks(lm_score.coded(blocks, replies, words).toArrow().to_batches()):
        assert sorted(b.heads[b.heads != 0xFFFF]) == list(range(lm_score.FREQUENT)) and (b.counts == n).all()


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_blocks_are_written_in_small_row_groups(spark):
    """40 blocks of one task: it wrote them as one row group with a page of 19 MB of hashes, and whoever read a block held all."""
    docs = spark.range(0, 40, 1, 1).selectExpr("id AS doc_id", "array_join(transform(sequence(0, 59999), i -> concat('w', 1000000 + id * 60000 + i)), ' ') AS text")
    made, before = len(shared._made), spark.conf.get(BATCH)
    got = lm_score.score(docs, rounds=1).collect()
    n = sum(zlib.crc32(str(i).encode()) % 5 != 1 for i in range(40))
    assert len(got) == 40 and {(r.n_tokens, r.n_known, r.train_tokens) for r in got} == {(60_001, 1 if r.held_out else 60_001, 60_001 * n) for r in got}
    assert spark.conf.get(BATCH) == before
    rows = 0
    for path in shared._made[made:]:
        for f in Path(path.removeprefix("file://").removeprefix("file:")).glob("*.parquet"):
            m = pq.ParquetFile(f).metadata
            for g in (m.row_group(i) for i in range(m.num_row_groups)):
                assert sum(g.column(c).total_compressed_size for c in range(g.num_columns)) < 12 << 20
                if "codes" in m.schema.to_arrow_schema().names:
                    rows += g.num_rows
                    assert g.num_rows <= lm_score.GROUP_BLOCKS
    assert rows == 80


def test_batches_for_python_are_small_and_the_limit_comes_back(spark):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([b.nbytes], pa.int64())], names=["n", "size"])

    rows, before = spark.range(0, 60, 1, 1).selectExpr("cast(repeat('x', 500000) AS binary) AS x"), spark.conf.get(BATCH)
    with pytest.raises(ZeroDivisionError), shared.batches_of(spark, lm_score.BATCH_BYTES):
        got = rows.mapInArrow(run, "n long, size long").collect()
        assert sum(r.n for r in got) == 60 and max(r.size for r in got) < lm_score.BATCH_BYTES + (1 << 20)
        1 / 0  # noqa: B018
    assert spark.conf.get(BATCH) == before

"""Five stages that turn raw documents into tokens; each is written as Parquet and read again by the next.

Defined results: a document with a null, empty or blank text scores 0 and leaves in the first stage; a null doc_id takes
part in all stages and stays where its text does; rows that repeat an id and a text stay together, those that repeat
a text under another id leave in the second stage; ties of groups go to the least doc_id; very long texts are
taken whole; an empty table stays empty; further columns are carried along, but for "tokens" and "decoded", which give
way to the last stage's results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arborlake.llm import decontamination, jaccard_join, quality, repeated_spans, sentencepiece_unigram
from arborlake.llm.queries import tokenizer_path
from arborlake.llm.shared import written

#: No SQL expresses the conditional random field or the tokenizer; tests/llm holds brute-force versions.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field does not reject; it learns from the stage's own input and the labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.accepted(docs, quality.fit(docs, labels))


def jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at a similarity of 0.8 or more."""
    return jaccard_join.one_of_each(docs, k=5, percent=80)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of over 50 words, or of 400 bytes, that occur twice in what the stages before kept."""
    return repeated_spans.without_repeats(docs, length_col="n_chars", words=51)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten-word window of a benchmark item."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their piece ids, and the text decoded from these."""
    model = sentencepiece_unigram.loaded(tokenizer_path("piece_bpe_32k.model"))
    return sentencepiece_unigram.encoded(docs, model, decoded_col="decoded")


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", jaccard),
    ("suffix-array dedup", suffix_array_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding and decoding", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

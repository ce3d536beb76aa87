"""An index of names: for every three characters in a row, the distinct names that have them.

Names are lower-cased and framed by two marks, so the begin and the end of a name are trigrams as well. A term's
candidates are the names that are listed under all its trigrams; they are then compared with the term itself, so
the rows are those of a full search. Terms without a trigram go over the distinct names only. Postings, names and
entries are sorted tables of small files, of which a search opens those whose ranges its trigrams and names fall in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.operators.search import matches, search

#: Marks of a name's begin and end; no file name has them.
BEGIN, END = "\x02", "\x03"
GRAM = 3
#: Rows of a file of the index.
FILE_ROWS = 200_000


def grams_of(text):
    """The distinct trigrams of a framed name."""
    n = F.greatest(F.length(text) - (GRAM - 1), F.lit(0))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(text, i, F.lit(GRAM))))


def _sorted(rows: DataFrame, by: list[str], path: str, file_rows: int) -> None:
    rows.repartitionByRange(*by).sortWithinPartitions(*by).write.option("maxRecordsPerFile", file_rows).mode("overwrite").parquet(path)


def build(entries: DataFrame, folder: str, file_rows: int = FILE_ROWS) -> None:
    """Writes the index of the entries' names, and the entries sorted by name beside it. A null name is not found by any search."""
    lower = F.lower("name")
    names = entries.where("name IS NOT NULL").select(lower.alias("lower_name")).distinct()
    framed = F.concat(F.lit(BEGIN), "lower_name", F.lit(END))
    postings = names.select(F.explode(grams_of(framed)).alias("gram"), "lower_name")
    _sorted(postings, ["gram", "lower_name"], f"{folder}/grams", file_rows)
    _sorted(names, ["lower_name"], f"{folder}/names", file_rows)
    _sorted(entries.withColumn("lower_name", lower), ["lower_name"], f"{folder}/entries", file_rows)


def term_grams(query: str) -> list[str]:
    """The trigrams that every name has which the query matches; none if the term is too short."""
    query = query.lower()
    if query.startswith("starts:"):
        text = BEGIN + query.removeprefix("starts:")
    elif query.startswith("ends:"):
        text = query.removeprefix("ends:") + END
    else:
        text = query
    return sorted({text[i : i + GRAM] for i in range(len(text) - GRAM + 1)})


def names_found(spark: SparkSession, folder: str, query: str) -> DataFrame:
    """The distinct lower-cased names that match."""
    grams = term_grams(query)
    if not grams:
        return spark.read.parquet(f"{folder}/names").where(matches(F.col("lower_name"), query))
    listed = spark.read.parquet(f"{folder}/grams").where(F.col("gram").isin(grams))
    found = listed.groupBy("lower_name").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).drop("n")
    return found.where(matches(F.col("lower_name"), query))


def indexed_search(spark: SparkSession, folder: str, query: str, snapshots: list[str] | None = None) -> DataFrame:
    """The rows of ``search`` over the indexed entries. The least and greatest name found bound what is read of the entries."""
    names = names_found(spark, folder, query)
    entries = spark.read.parquet(f"{folder}/entries")
    bounds = names.agg(F.min("lower_name").alias("low"), F.max("lower_name").alias("high"), F.count("*").alias("n")).first()
    if not bounds.n:
        return search(entries.where("false").drop("lower_name"), query, snapshots)
    near = entries.where(F.col("lower_name").between(bounds.low, bounds.high))
    if bounds.n <= 1000:  # few names reach the files' statistics one by one
        near = entries.where(F.col("lower_name").isin([r.lower_name for r in names.collect()]))
    return search(near.join(names, "lower_name", "left_semi").drop("lower_name"), query, snapshots)

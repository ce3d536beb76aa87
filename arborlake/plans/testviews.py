"""The test tables seen as directory trees, group logs and devices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as files /source/lang/doc_id.txt of one snapshot."""
    docs = table(spark, sf_dir, "documents")
    parent = F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("lang"))
    name = F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".txt"))
    none = F.lit(None).cast("long")
    return docs.select(F.lit("docs").alias("snapshot"), F.col("doc_id").alias("seq"), F.lit(0).alias("pos"), F.lit("f").alias("kind"), parent.alias("parent"), name.alias("name"), F.concat(parent, F.lit("/"), name).alias("full_path"), F.octet_length("text").cast("long").alias("size"), none.alias("created"), none.alias("modified"), none.alias("accessed"), "source", "lang")


def document_dirs(files: DataFrame) -> DataFrame:
    """All directories of the files with their direct totals, ``/`` included."""
    direct = files.groupBy("source", "lang").agg(F.sum("size").cast("long").alias("direct_size"), F.count("*").alias("n_files"))
    line = lambda path, size, n: F.struct(path.alias("path"), size.alias("direct_size"), n.alias("n_files"))
    none = F.lit(0).cast("long")
    source = F.concat(F.lit("/"), "source")
    up = F.array(line(F.lit("/"), none, none), line(source, none, none), line(F.concat(source, F.lit("/"), "lang"), F.col("direct_size"), F.col("n_files")))
    rows = direct.select(F.explode(up).alias("x")).groupBy("x.path").agg(F.sum("x.direct_size").cast("long").alias("direct_size"), F.sum("x.n_files").cast("long").alias("n_files"))
    return rows.select(F.lit("docs").alias("snapshot"), F.xxhash64("path").alias("seq"), "path", F.lit("/").alias("root"), F.lit("Linux").alias("os_name"), "direct_size", "n_files")


def document_tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(dirs, entries), subdirectories listed among the entries."""
    files = document_files(spark, sf_dir)
    dirs = document_dirs(files)
    parent = F.coalesce(F.nullif(F.regexp_extract("path", "^(.*)/[^/]*$", 1), F.lit("")), F.lit("/"))
    subdirs = dirs.where("path != '/'").select("snapshot", F.xxhash64(parent).alias("seq"), F.lit(0).alias("pos"), F.lit("d").alias("kind"), parent.alias("parent"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.col("path").alias("full_path"), *[F.lit(None).cast("long").alias(c) for c in ("size", "created", "modified", "accessed")])
    return dirs, files.drop("source", "lang").unionByName(subdirs)


def label_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good documents are in ``keep``, toxic ones in ``ignore``; /src1 and /src2/en are in ``tree``, /src1/de in ``drop``."""
    labels, files = table(spark, sf_dir, "labels"), document_files(spark, sf_dir)
    named = files.join(labels, F.col("doc_id") == F.col("seq")).select("full_path", F.array_compact(F.array(F.when(F.col("quality") == 1, "keep"), F.when(F.col("toxic") == 1, "ignore"))).alias("gs"))
    file_groups = named.select(F.lit("docs").alias("snapshot"), F.explode("gs").alias("group"), F.lit("f").alias("kind"), F.col("full_path").alias("path"))
    dir_groups = spark.createDataFrame([("docs", "tree", "d", "/src1"), ("docs", "tree", "d", "/src2/en"), ("docs", "drop", "d", "/src1/de")], "snapshot string, group string, kind string, path string")
    return file_groups.unionByName(dir_groups)


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a group log: users in groups g0 to g4; an error takes them out."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(F.lit("events").alias("snapshot"), F.col("event_id").alias("seq"), F.concat(F.lit("/u/"), F.col("user_id")).alias("path"), F.lit("f").alias("kind"), F.concat(F.lit("g"), F.pmod(k, F.lit(5))).alias("group"), F.when(F.col("event_type") == "error", "del").otherwise("add").alias("action"), F.unix_timestamp("ts").alias("ts"))

"""All queries over the test tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborlake.functions import paths
from arborlake.operators import backup, content, groups, name_index, search, staged, tree
from arborlake.sources import filesystem, indexed, snapshots
from arborlake.plans.testviews import document_dirs, document_files, document_tree, event_log, label_groups, table
from arborlake.sources.filesystem import without_prefixes
from arborlake.sources.scratch import fresh, kept
from arborlake.streaming.replay import current, start

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The views that the SQL below starts from.
FILES = """files AS (SELECT doc_id AS seq, '/' || source || '/' || lang AS parent, 'doc_' || doc_id || '.txt' AS name,
  '/' || source || '/' || lang || '/doc_' || doc_id || '.txt' AS full_path, CAST(strlen(text) AS BIGINT) AS size, source, lang FROM documents)"""
ANCESTORS = """spread AS (SELECT '/' AS path, size FROM files UNION ALL SELECT '/' || source, size FROM files UNION ALL SELECT parent, size FROM files),
totals AS (SELECT path, CAST(sum(size) AS BIGINT) AS S, count(*) AS C FROM spread GROUP BY path)"""
MEMBERS = """members AS (SELECT CASE WHEN quality = 1 THEN 'keep' END AS g, full_path FROM labels JOIN files ON doc_id = seq WHERE quality = 1
  UNION ALL SELECT 'ignore', full_path FROM labels JOIN files ON doc_id = seq WHERE toxic = 1)"""
LOG = """log AS (SELECT event_id AS seq, '/u/' || user_id AS path, 'g' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 5) AS grp,
  CASE WHEN event_type = 'error' THEN 'del' ELSE 'add' END AS action FROM events),
state AS (SELECT grp, path, arg_max(action, seq) AS action FROM log GROUP BY grp, path)"""


def fmt(size: str) -> str:
    """DuckDB SQL of a formatted size."""
    steps = " ".join(f"WHEN {size} < {1024 ** (i + 1)} THEN printf('%.2f {unit}', {size} / {1024.0**i:.1f})" for i, unit in enumerate(paths.UNITS[:-1]))
    return f"CASE {steps} ELSE printf('%.2f PB', {size} / {1024.0**5:.1f}) END"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {FILES}, {ANCESTORS} SELECT path, S, C, {fmt('S')} AS formatted FROM totals")
def q_tree_rollup(spark, d):
    return tree.rollup(document_dirs(document_files(spark, d))).select("path", "S", "C", paths.format_bytes(F.col("S")).alias("formatted"))


@query(f"WITH {FILES} SELECT parent AS path, CAST(sum(size) AS BIGINT) AS direct_size, count(*) AS n_files FROM files GROUP BY parent")
def q_direct_totals(spark, d):
    return tree.direct_totals(document_files(spark, d)).drop("snapshot")


@query(f"WITH {FILES} SELECT parent, name, size, {fmt('size')} AS size_formatted FROM files WHERE parent = '/src1/en'")
def q_list_files(spark, d):
    return tree.list_files(document_files(spark, d), "/src1/en").select("parent", "name", "size", "size_formatted")


@query(f"""WITH {FILES}, {ANCESTORS}, ds AS (SELECT DISTINCT '/' AS parent, source AS name, '/' || source AS p FROM files UNION SELECT DISTINCT '/' || source, lang, parent FROM files)
SELECT ds.parent, ds.name, S, C, {fmt('S')} AS size_formatted FROM ds LEFT JOIN totals ON p = path""")
def q_list_dirs(spark, d):
    dirs, entries = document_tree(spark, d)
    return tree.list_dirs(entries, tree.rollup(dirs, entries)).drop("snapshot")


@query(f"WITH {FILES} SELECT parent AS path, CAST(sum(size) AS BIGINT) AS direct_size, count(*) AS n_files FROM files WHERE parent = '/src3/de' GROUP BY parent")
def q_point_lookup(spark, d):
    return tree.lookup(document_dirs(document_files(spark, d)), path="/src3/de").select("path", "direct_size", "n_files")


@query(f"WITH {FILES} SELECT seq, full_path, size FROM files WHERE seq = 17")
def q_index_lookup(spark, d):
    return tree.lookup(document_files(spark, d).withColumn("path", F.col("full_path")), index=17).select("seq", "full_path", "size")


@query(f"""WITH {FILES} SELECT (SELECT count(*) FROM (SELECT '/' UNION SELECT '/' || source FROM files UNION SELECT parent FROM files)) AS path_count, count(*) AS total_files,
  (SELECT count(*) FROM (SELECT '/' || source FROM files UNION SELECT parent FROM files)) AS total_dirs, CAST(sum(size) AS BIGINT) AS total_size, '/' AS root_path, {fmt('CAST(sum(size) AS BIGINT)')} AS total_size_formatted FROM files""")
def q_snapshot_info(spark, d):
    dirs, entries = document_tree(spark, d)
    subdirs = entries.where("kind = 'd'").groupBy("snapshot", F.col("parent").alias("path")).agg(F.count("*").alias("n_subdirs"))
    numbered = dirs.join(subdirs, ["snapshot", "path"], "left").withColumn("n_subdirs", F.coalesce("n_subdirs", F.lit(0))).withColumn("seq", F.length("path"))
    return tree.info(numbered).drop("snapshot")


@query(f"SELECT doc_id, {fmt('strlen(text)')} AS formatted FROM documents")
def q_format_bytes(spark, d):
    return table(spark, d, "documents").select("doc_id", paths.format_bytes(F.octet_length("text")).alias("formatted"))


_URL = r"regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, rtrim(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/') AS p, CAST(strlen(html) AS BIGINT) AS size"


@query(f"""WITH RECURSIVE files AS (SELECT {_URL} FROM pages), up(host, p, size) AS (
  SELECT host, p, size FROM files UNION ALL SELECT host, regexp_replace(p, '/[^/]*$', ''), size FROM up WHERE p != '')
SELECT host, CASE WHEN p = '' THEN '/' ELSE p END AS path, CAST(sum(size) AS BIGINT) AS S, count(*) AS C FROM up GROUP BY ALL""")
def q_url_tree_rollup(spark, d):
    url = F.col("url")
    pages = table(spark, d, "pages").select(F.regexp_extract(url, "^[a-z]+://([^/?#]+)", 1).alias("snapshot"), F.rtrim(F.regexp_extract(url, "^[a-z]+://[^/?#]+([^?#]*)", 1), F.lit("/")).alias("p"), F.octet_length("html").alias("n"))
    direct = pages.groupBy("snapshot", F.when(F.col("p") == "", "/").otherwise(F.col("p")).alias("path")).agg(F.sum("n").cast("long").alias("direct_size"), F.count("*").alias("n_files"))
    system = {"root": F.lit("/"), "os_name": F.lit("Linux")}
    up = direct.withColumns(system).select("snapshot", F.explode(F.array_union(F.array(F.lit("/")), paths.ancestors(F.col("path"), F.col("root"), F.col("os_name")))).alias("path"))
    bare = up.distinct().join(direct, ["snapshot", "path"], "left").withColumns(system)
    dirs = bare.select("snapshot", "path", "root", "os_name", F.coalesce("direct_size", F.lit(0)).alias("direct_size"), F.coalesce("n_files", F.lit(0)).alias("n_files"))
    return tree.rollup(dirs).select(F.col("snapshot").alias("host"), "path", "S", "C")


@query("""WITH leaf AS (SELECT '/' || r_name || '/' || n_name || '/' || c_custkey AS p, '/' || r_name || '/' || n_name AS n, '/' || r_name AS r, count(o_orderkey) AS k
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
SELECT path, CAST(sum(k) AS BIGINT) AS C FROM (SELECT p AS path, k FROM leaf UNION ALL SELECT n, k FROM leaf UNION ALL SELECT r, k FROM leaf UNION ALL SELECT '/', k FROM leaf) GROUP BY path""")
def q_geo_rollup(spark, d):
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_files"))
    places = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    leaf = places.join(orders, "c_custkey", "left").select(F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name", F.lit("/"), "c_custkey").alias("leaf"), F.coalesce("n_files", F.lit(0)).alias("k"))
    system = (F.lit("/").alias("root"), F.lit("Linux").alias("os_name"))
    names = F.array_union(F.array(F.lit("/")), paths.prefixes(F.col("leaf"), F.lit("Linux")))
    dirs = leaf.select("leaf", "k", F.explode(names).alias("path")).groupBy("path").agg(F.sum(F.when(F.col("path") == F.col("leaf"), F.col("k")).otherwise(0)).alias("n_files"))
    return tree.rollup(dirs.select(F.lit("geo").alias("snapshot"), "path", *system, F.lit(0).cast("long").alias("direct_size"), "n_files")).select("path", "C")


def _search(text: str, predicate: str, where: str = "f"):
    source = FILES if where == "f" else f"{FILES}, ds AS (SELECT DISTINCT source AS name, '/' AS parent FROM files UNION SELECT DISTINCT lang, '/' || source FROM files)"
    return f"WITH {source} SELECT '{'file' if where == 'f' else 'directory'}' AS type, name, parent AS path, {'size' if where == 'f' else 'CAST(NULL AS BIGINT) AS size'} FROM {'files' if where == 'f' else 'ds'} WHERE {predicate}"


@query(_search("C_1", "contains(lower(name), 'c_1')"))
def q_search_contains(spark, d):
    return search.search(document_files(spark, d), "C_1").select("type", "name", "path", "size")


@query(_search("starts", "starts_with(lower(name), 'doc_2')"))
def q_search_starts(spark, d):
    return search.search(document_files(spark, d), "starts:DOC_2").select("type", "name", "path", "size")


@query(_search("ends", "suffix(lower(name), '7.txt')"))
def q_search_ends(spark, d):
    return search.search(document_files(spark, d), "Ends:7.TXT").select("type", "name", "path", "size")


@query(_search("dirs", "contains(lower(name), 'e')", "d"))
def q_search_dirs(spark, d):
    _, entries = document_tree(spark, d)
    return search.search(entries.where("kind = 'd'"), "E").select("type", "name", "path", "size")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'an')")
def q_search_parts(spark, d):
    return table(spark, d, "part").where(search.matches(F.col("p_name"), "AN")).select("p_partkey", "p_name")


@query(f"WITH {FILES} SELECT source AS snapshot, name, size FROM files WHERE source IN ('src1', 'src2') AND contains(lower(name), '9')")
def q_union_search(spark, d):
    files = document_files(spark, d).withColumn("snapshot", F.col("source"))
    return search.search(files, "9", ["src1", "src2"]).select("snapshot", "name", "size")


@query("SELECT x AS snapshot FROM (VALUES ('src1'), ('nowhere')) v(x) WHERE x NOT IN (SELECT source FROM documents)")
def q_missing_snapshots(spark, d):
    wanted = spark.createDataFrame([("src1",), ("nowhere",)], "snapshot string")
    return search.missing_snapshots(wanted, table(spark, d, "documents").select(F.col("source").alias("snapshot")))


@query(f"WITH {LOG} SELECT grp, path FROM state WHERE action = 'add'")
def q_group_replay(spark, d):
    return groups.replay(event_log(spark, d)).select(F.col("group").alias("grp"), "path")


@query(f"WITH {LOG} SELECT grp, count(*) FILTER (action = 'add') AS files, CAST(0 AS BIGINT) AS dirs, count(*) FILTER (action = 'add') AS total FROM state GROUP BY grp")
def q_group_counts(spark, d):
    return groups.counts(event_log(spark, d)).select(F.col("group").alias("grp"), "files", "dirs", "total")


@query(f"WITH {LOG} SELECT path FROM state WHERE action = 'add' AND grp = 'g3'")
def q_group_members(spark, d):
    return groups.members(groups.replay(event_log(spark, d)), "g3").select("path")


def _filtered(spark, d, inside=(), outside=()):
    files = document_files(spark, d).drop("source", "lang")
    return groups.filter_listing(files, label_groups(spark, d), inside, outside).select("full_path", "size")


@query(f"WITH {FILES}, {MEMBERS} SELECT full_path, size FROM files WHERE full_path NOT IN (SELECT full_path FROM members WHERE g = 'ignore')")
def q_filter_out(spark, d):
    return _filtered(spark, d, outside=["ignore"])


@query(f"WITH {FILES}, {MEMBERS} SELECT full_path, size FROM files WHERE full_path IN (SELECT full_path FROM members WHERE g = 'keep')")
def q_filter_in(spark, d):
    return _filtered(spark, d, inside=["keep"])


@query(f"WITH {FILES}, {MEMBERS} SELECT full_path, size FROM files WHERE full_path IN (SELECT full_path FROM members WHERE g = 'keep') AND full_path NOT IN (SELECT full_path FROM members WHERE g = 'ignore')")
def q_filter_both(spark, d):
    return _filtered(spark, d, inside=["keep"], outside=["ignore"])


def _selected(spark, d, mode):
    dirs, entries = document_tree(spark, d)
    return groups.select(entries, dirs, label_groups(spark, d), ["keep", "tree"], ["ignore", "drop"], mode).select("full_path", "size")


_KEPT = f"WITH {FILES}, {MEMBERS} SELECT full_path, size FROM files WHERE parent != '/src1/de' AND full_path NOT IN (SELECT full_path FROM members WHERE g = 'ignore') AND (source = 'src1' OR parent = '/src2/en'"


@query(f"{_KEPT})")
def q_subtree_select_strict(spark, d):
    return _selected(spark, d, "strict")


@query(f"{_KEPT} OR full_path IN (SELECT full_path FROM members WHERE g = 'keep'))")
def q_subtree_select_intuitive(spark, d):
    return _selected(spark, d, "intuitive")


@query(f"""WITH {FILES}, {MEMBERS}, l AS (SELECT * FROM files WHERE full_path NOT IN (SELECT full_path FROM members WHERE g = 'ignore')),
ds AS (SELECT DISTINCT '/' AS path FROM files UNION SELECT '/' || source FROM files UNION SELECT parent FROM files),
s AS (SELECT '/' AS path, size FROM l WHERE parent != '/src1/de' UNION ALL SELECT '/' || source, size FROM l WHERE parent != '/src1/de' UNION ALL SELECT parent, size FROM l)
SELECT ds.path, CAST(coalesce(sum(size), 0) AS BIGINT) AS S, count(size) AS C FROM ds LEFT JOIN s USING (path) GROUP BY ds.path""")
def q_filtered_totals(spark, d):
    dirs, entries = document_tree(spark, d)
    return groups.filtered_totals(entries, dirs, label_groups(spark, d), [], ["ignore", "drop"]).drop("snapshot")


@query(f"WITH {FILES} SELECT full_path, size FROM files WHERE NOT starts_with(full_path, '/src1') AND NOT starts_with(full_path, '/src2/e')")
def q_skip_prefix(spark, d):
    return without_prefixes(document_files(spark, d), ["/src1", "/src2/e", ""]).select("full_path", "size")


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def q_content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", content.content_hash(F.col("text")).alias("hash"))


@query(f"WITH {FILES}, h AS (SELECT f.*, sha256(text) AS hash FROM files f JOIN documents ON seq = doc_id) SELECT hash, count(*) AS copies, max(size) AS size, CAST(sum(size) - max(size) AS BIGINT) AS wasted, min(full_path) AS first_path FROM h GROUP BY hash HAVING count(*) > 1")
def q_duplicates(spark, d):
    docs = table(spark, d, "documents")
    path = F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/doc_"), "doc_id", F.lit(".txt"))
    return content.duplicates(docs.select(path.alias("full_path"), F.octet_length("text").cast("long").alias("size"), content.content_hash(F.col("text")).alias("hash")))


def _held(spark, d):
    held = table(spark, d, "lineitem").select(F.col("l_partkey").alias("hash"), F.col("l_suppkey").alias("device_id"))
    return held, table(spark, d, "supplier").select(F.col("s_suppkey").alias("device_id"), F.when(F.col("s_nationkey") < 10, "mobile").otherwise("server").alias("device_type"))


def _replicas(key: str) -> str:
    return f"SELECT {key} AS hash, count(DISTINCT l_suppkey) AS replicas, bool_and(s_nationkey IS NOT NULL AND s_nationkey < 10) AS mobile_only FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1"


@query(_replicas("l_partkey"))
def q_replicas(spark, d):
    return content.replicas(*_held(spark, d))


@query(f"SELECT * FROM ({_replicas("l_partkey || ':' || l_linenumber")}) WHERE replicas = 1 OR mobile_only")
def q_at_risk(spark, d):
    held, devices = _held(spark, d)
    named = table(spark, d, "lineitem").select(F.concat_ws(":", "l_partkey", "l_linenumber").alias("hash"), F.col("l_suppkey").alias("device_id"))
    return content.at_risk(named, devices)


@query(f"WITH {FILES} SELECT full_path, size FROM files ORDER BY size DESC, full_path LIMIT 20 OFFSET 20")
def q_largest_page(spark, d):
    return content.largest(document_files(spark, d), page=1).select("full_path", "size")


_PACK = f"""WITH RECURSIVE {FILES}, n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY seq) AS r FROM files),
pk(source, r, zip_index, held) AS (SELECT source, r, CAST(0 AS BIGINT), size FROM n WHERE r = 1 UNION ALL
  SELECT n.source, n.r, CASE WHEN held > 0 AND held + size > 20000 THEN zip_index + 1 ELSE zip_index END, CASE WHEN held > 0 AND held + size > 20000 THEN size ELSE held + size END FROM pk JOIN n ON n.source = pk.source AND n.r = pk.r + 1)"""


def _packed(spark, d):
    return backup.pack(document_files(spark, d).withColumn("snapshot", F.col("source")), ["snapshot"], ["seq"], 20000)


@query(f"{_PACK} SELECT source, seq, size, zip_index FROM pk JOIN n USING (source, r)")
def q_pack(spark, d):
    return _packed(spark, d).select("source", "seq", "size", "zip_index")


@query(f"""{_PACK}, used AS (SELECT source, max(zip_index) + 1 AS n FROM pk GROUP BY source),
offsets AS (SELECT source, CAST(coalesce(sum(n) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM used)
SELECT full_path AS src_path, '/backup/' || printf('backup_%03d.zip', first + zip_index) AS dest_path, ltrim(full_path, '/') AS member, size AS filesize, 'zip' AS action FROM pk JOIN n USING (source, r) JOIN offsets USING (source)""")
def q_backup_manifest(spark, d):
    """Each source is packed by itself; volumes are numbered over all of them."""
    return backup.manifest(backup.volumes(_packed(spark, d), ["snapshot"]), "/backup/")


_PACK_ALL = f"""WITH RECURSIVE {FILES}, n AS (SELECT *, row_number() OVER (ORDER BY seq) AS r FROM files),
pk(r, zip_index, held) AS (SELECT r, CAST(0 AS BIGINT), CASE WHEN seq % 7 = 3 THEN 0 ELSE size END FROM n WHERE r = 1 UNION ALL
  SELECT n.r, CASE WHEN held > 0 AND held + size > 20000 THEN zip_index + 1 ELSE zip_index END,
    CASE WHEN held > 0 AND held + size > 20000 THEN 0 ELSE held END + CASE WHEN seq % 7 = 3 THEN 0 ELSE size END FROM pk JOIN n ON n.r = pk.r + 1)"""


@query(f"{_PACK_ALL} SELECT seq, size, zip_index FROM pk JOIN n USING (r)")
def q_pack_whole(spark, d):
    """All documents as one key in small blocks; every seventh file's source is missing, so it adds no bytes."""
    files = document_files(spark, d).withColumn("source_exists", F.col("seq") % 7 != 3)
    return backup.pack(files, [], ["seq"], 20000, block=256).select("seq", "size", "zip_index")


@query(f"WITH {FILES} SELECT source, seq, CAST(floor(row_number() OVER (PARTITION BY source ORDER BY seq) * 100 / count(*) OVER (PARTITION BY source)) AS BIGINT) AS percent FROM files")
def q_progress(spark, d):
    return tree.progress(document_files(spark, d).select("source", "seq"), ["source"], ["seq"])


@query("SELECT s_suppkey, sha256(s_name || s_nationkey || '') AS thumbprint FROM supplier")
def q_thumbprint(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", paths.thumbprint(F.col("s_name"), F.col("s_nationkey"), F.lit(None)).alias("thumbprint"))


@query("SELECT s_suppkey, array_to_string([printf('%012x', s_suppkey * 7919)[i : i + 1] for i in [1, 3, 5, 7, 9, 11]], ':') AS mac FROM supplier")
def q_mac_address(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", paths.mac_address(F.col("s_suppkey") * 7919).alias("mac"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def q_json_log(spark, d):
    return table(spark, d, "events").select("event_id", F.variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))


_JOINED = r"""CASE WHEN os = 'Windows' THEN
  CASE WHEN base = '/' AND name[2:2] = ':' THEN name || '\' WHEN name = '' THEN replace(base, '/', '\') ELSE rtrim(replace(base, '/', '\'), '\') || '\' || ltrim(name, '\/') END
  ELSE CASE WHEN name = '' THEN replace(base, '\', '/') ELSE rtrim(replace(base, '\', '/'), '/') || '/' || ltrim(name, '\/') END END"""


@query(rf"""WITH cases AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '/' WHEN 1 THEN '/' || source || '/' WHEN 2 THEN 'C:\' || source WHEN 3 THEN '/' WHEN 4 THEN '\' || source ELSE 'D:/' || source END AS base,
  CASE doc_id % 6 WHEN 0 THEN lang WHEN 1 THEN '/' || lang WHEN 2 THEN '\' || lang WHEN 3 THEN 'C:' WHEN 4 THEN '' ELSE lang END AS name,
  CASE doc_id % 6 WHEN 0 THEN 'Linux' WHEN 1 THEN 'Linux' WHEN 2 THEN 'Windows' WHEN 3 THEN 'Windows' WHEN 4 THEN 'Linux' ELSE 'Windows' END AS os FROM documents)
SELECT doc_id, base, name, {_JOINED} AS joined FROM cases""")
def q_path_join(spark, d):
    """Sources and languages as bases and names of both systems; for the last kind the system is found from the base."""
    docs, k = table(spark, d, "documents"), F.col("doc_id") % 6
    pick = lambda *v: F.element_at(F.array(*v), (k + 1).cast("int"))
    source, lang, windows, linux = F.col("source"), F.col("lang"), F.lit("Windows"), F.lit("Linux")
    base = pick(F.lit("/"), F.concat(F.lit("/"), source, F.lit("/")), F.concat(F.lit("C:\\"), source), F.lit("/"), F.concat(F.lit("\\"), source), F.concat(F.lit("D:/"), source))
    name = pick(lang, F.concat(F.lit("/"), lang), F.concat(F.lit("\\"), lang), F.lit("C:"), F.lit(""), lang)
    cases = docs.select("doc_id", base.alias("base"), name.alias("name"), pick(linux, linux, windows, windows, linux, F.lit(None)).alias("os"))
    return cases.select("doc_id", "base", "name", paths.join_path(F.col("base"), F.col("name"), F.col("os")).alias("joined"))


@query(rf"""WITH p AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '/C:' ELSE 'C:' END || replace(p, '/', CASE WHEN page_id % 3 = 0 THEN '//' ELSE '/' END) AS web, p FROM (SELECT page_id, {_URL} FROM pages))
SELECT page_id, web, 'C:\' || ltrim(replace(p, '/', '\'), '\') AS native, CASE WHEN p = '' THEN '/C:' ELSE '/C:' || p END AS web2 FROM p""")
def q_path_normalise(spark, d):
    """The paths of pages as a browser writes those of a drive, with and without the first slash, some of them doubled."""
    url, windows = F.col("url"), F.lit("Windows")
    path = F.rtrim(F.regexp_extract(url, "^[a-z]+://[^/?#]+([^?#]*)", 1), F.lit("/"))
    slashes = F.when(F.col("page_id") % 3 == 0, F.replace(path, F.lit("/"), F.lit("//"))).otherwise(path)
    cases = table(spark, d, "pages").select("page_id", F.concat(F.when(F.col("page_id") % 2 == 0, "/C:").otherwise("C:"), slashes).alias("web"))
    return cases.withColumn("native", paths.to_native(F.col("web"), windows)).withColumn("web2", paths.to_web(F.col("native"), windows))


@query("SELECT event_id, CASE WHEN length(p) > 40 THEN '...' || p[-37:] ELSE p END AS short FROM (SELECT event_id, '/log/' || event_type || '/' || repeat('x', CAST(event_id % 60 AS INT)) AS p FROM events)")
def q_short_path(spark, d):
    long = F.concat(F.lit("/log/"), "event_type", F.lit("/"), F.repeat(F.lit("x"), (F.col("event_id") % 60).cast("int")))
    return table(spark, d, "events").select("event_id", paths.shortened(long, 40).alias("short"))


@query()
def q_stream_replay(spark, d):
    """The log read as a stream; equal to q_group_replay."""
    folder = fresh(spark)
    schema = table(spark, d, "events").schema
    files = spark.readStream.schema(schema).format("parquet").load(f"{d}/events.parquet*")
    k = F.get_json_object("props", "$.k").cast("long")
    log = files.select(F.lit("events").alias("snapshot"), F.col("event_id").alias("seq"), F.concat(F.lit("/u/"), F.col("user_id")).alias("path"), F.lit("f").alias("kind"), F.concat(F.lit("g"), F.pmod(k, F.lit(5))).alias("group"), F.when(F.col("event_type") == "error", "del").otherwise("add").alias("action"))
    stream = start(log, f"{folder}/state", f"{folder}/checkpoint")
    stream.processAllAvailable()
    stream.stop()
    return current(spark, f"{folder}/state").select(F.col("group").alias("grp"), "path")


ORACLES["q_stream_replay"] = ORACLES["q_group_replay"]


@query(ORACLES["q_group_replay"])
def q_log_append(spark, d):
    """The log appended in three batches, the smallest last, and read back."""
    path, log = f"{fresh(spark)}/x_groups.jl", event_log(spark, d)
    ends = log.agg(F.max("seq")).first()[0] or 0
    for low, high in ((-1, ends // 2), (ends // 2, ends - 5), (ends - 5, ends)):
        snapshots.append_group_actions(log.where((F.col("seq") > low) & (F.col("seq") <= high)).orderBy("seq"), path)
    return groups.replay(snapshots.read_group_log(spark, path, "events")).select(F.col("group").alias("grp"), "path")


def _numbered_tree(spark, d):
    """The document tree with directories numbered by path, the root as 0, and their entries with them."""
    dirs, entries = document_tree(spark, d)
    numbered = dirs.select("path", F.row_number().over(Window.partitionBy("snapshot").orderBy("path")).alias("n"))  # few directories
    line = lambda df, on: df.drop("seq").join(numbered.select(F.col("path").alias(on), (F.col("n") - 1).cast("long").alias("seq")), on)
    return line(dirs, "path"), line(entries, "parent")


@query(f"""WITH {FILES}, ds AS (SELECT DISTINCT '/' AS parent, source AS name FROM files UNION SELECT DISTINCT '/' || source, lang FROM files)
SELECT 'snapshot_1_1' AS snapshot, 'f' AS kind, parent, name, full_path, size FROM files UNION ALL
SELECT 'snapshot_1_1', 'd', parent, name, CASE WHEN parent = '/' THEN '/' || name ELSE parent || '/' || name END, NULL FROM ds""")
def q_snapshot_reload(spark, d):
    """The document tree written as a snapshot file, metadata in its first line, and read back."""
    dirs, entries = _numbered_tree(spark, d)
    rows = entries.withColumn("pos", F.row_number().over(Window.partitionBy("parent", "kind").orderBy("name")))
    path = f"{fresh(spark)}/snapshot_1_1.jsonl.gz"
    snapshots.write_snapshot(dirs, rows, path, {"os_name": "Linux", "device_name": "d"})
    read = snapshots.read_lines(spark, path)
    return snapshots.entries_of(read).select("snapshot", "kind", "parent", "name", "full_path", "size")


@query("SELECT 'snapshot_1_1' AS snapshot, '/' AS root, 'dev' AS device_name, 'Linux' AS os_name, CAST(7 AS BIGINT) AS start_scan_time, CAST(NULL AS BIGINT) AS finish_scan_time")
def q_snapshot_metadata(spark, d):
    dirs, entries = _numbered_tree(spark, d)
    path = f"{fresh(spark)}/snapshot_1_1.jsonl.gz"
    snapshots.write_snapshot(dirs, entries, path, {"os_name": "Linux", "device_name": "dev", "start_scan_time": 7, "unknown": 1})
    return snapshots.metadata(snapshots.read_lines(spark, path)).select("snapshot", "root", "device_name", "os_name", "start_scan_time", "finish_scan_time")


@query(f"WITH {FILES}, l AS (SELECT parent AS path, count(*) AS n, CAST(sum(size) AS BIGINT) AS s FROM files GROUP BY parent) SELECT CAST(sum(n) AS BIGINT) AS scanned_count, CAST(sum(s) AS BIGINT) AS scanned_size, CAST(count(*) FILTER (n % 2 = 0) AS BIGINT) AS n_errors FROM l")
def q_scan_counters(spark, d):
    """Each directory of documents as a row of a scan; one with an even number of files has an error."""
    files = document_files(spark, d)
    rows = files.groupBy(F.lit("/").alias("root"), F.col("parent").alias("path")).agg(F.collect_list("name").alias("files"), F.collect_list("size").alias("sizes"))
    failed = F.when(F.size("files") % 2 == 0, F.array(F.lit("e"))).otherwise(F.array().cast("array<string>"))
    return filesystem.counters(rows.withColumns({"dirs": F.array().cast("array<string>"), "errors": failed}))


@query("SELECT 'snapshot_' || event_id || '_' || user_id || '.jsonl.gz' AS filename, event_id AS size, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS modified, CAST(floor(epoch(ts)) AS BIGINT) AS mtime, event_id AS timestamp FROM events")
def q_snapshot_catalogue(spark, d):
    files = table(spark, d, "events").select(F.concat(F.lit("snapshot_"), "event_id", F.lit("_"), "user_id", F.lit(".jsonl.gz")).alias("filename"), F.col("event_id").alias("size"), F.col("ts").alias("modificationTime"))
    return snapshots.listed(files)


@query("SELECT event_type AS path, user_id AS snapshot, max(event_id) AS seq, arg_max(value, event_id) AS direct_size FROM events GROUP BY ALL")
def q_last_of_path(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("snapshot"), F.col("event_type").alias("path"), F.col("event_id").alias("seq"), F.col("value").alias("direct_size"))
    return tree.last_of_path(rows)


@query("SELECT s_name AS device_name, 'host' || (s_suppkey % 3) AS host_name, s_nationkey AS memory_size FROM supplier")
def q_devices(spark, d):
    """Suppliers as devices of three hosts, appended to the hosts' files and read back."""
    folder = fresh(spark)
    devices = table(spark, d, "supplier").select(F.col("s_name").alias("device_name"), F.concat(F.lit("host"), F.col("s_suppkey") % 3).alias("host_name"), F.col("s_nationkey").cast("long").alias("memory_size"))
    for name in ("host0", "host1", "host2"):
        snapshots.append_device(devices.where(F.col("host_name") == name), folder, name)
    return snapshots.read_devices(spark, folder).select("device_name", "host_name", "memory_size")


@query("SELECT p_name AS name, p_brand AS device_id, CAST(p_size AS BIGINT) AS size, CAST(NULL AS BIGINT) AS created FROM part")
def q_media(spark, d):
    """Parts as the media of a host, written twice, the second time in place of the first."""
    folder = fresh(spark)
    media = table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("device_id"), F.col("p_size").cast("long").alias("size"), F.lit(None).cast("long").alias("created"))
    snapshots.write_media(media.where("size > 10"), folder, "h")
    snapshots.write_media(media, folder, "h")
    return snapshots.read_media(spark, folder, "h")


@query(f"WITH {FILES} SELECT full_path, size FROM files ORDER BY size, full_path LIMIT 50")
def q_sorted_listing(spark, d):
    return search.in_order(search.search(document_files(spark, d), ""), "size").limit(50).select("full_path", "size")


@query(f"{_KEPT.replace('SELECT full_path, size', 'SELECT count(*) AS selected, CAST(sum(size) AS BIGINT) AS bytes')})")
def q_selected_count(spark, d):
    return _selected(spark, d, "strict").agg(F.count("*").alias("selected"), F.sum("size").alias("bytes"))


@query(f"WITH {FILES}, h AS (SELECT f.*, sha256(text) AS hash FROM files f JOIN documents ON seq = doc_id) SELECT full_path, hash FROM h WHERE hash IN (SELECT hash FROM h GROUP BY hash HAVING count(*) > 1)")
def q_duplicate_members(spark, d):
    docs = table(spark, d, "documents")
    path = F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/doc_"), "doc_id", F.lit(".txt"))
    return content.duplicate_members(docs.select(path.alias("full_path"), content.content_hash(F.col("text")).alias("hash")))


@query(f"""WITH {FILES}, ds AS (SELECT DISTINCT '/' AS path, source AS name FROM files UNION SELECT DISTINCT '/' || source, lang FROM files),
f AS (SELECT parent AS path, list(name) AS names, list(size) AS sizes FROM files GROUP BY parent),
g AS (SELECT path, list(name) AS names FROM ds GROUP BY path),
lines AS (SELECT path, '{{"f": [' || coalesce(array_to_string(list_transform(f.names, lambda x: '"' || x || '"'), ', '), '') || '], "d": [' || coalesce(array_to_string(list_transform(g.names, lambda x: '"' || x || '"'), ', '), '')
  || '], "t": [' || coalesce(array_to_string(list_transform(f.names, lambda x: '[null, null, null]'), ', '), '') || '], "T": [' || coalesce(array_to_string(list_transform(g.names, lambda x: '[null, null, null]'), ', '), '')
  || '], "s": [' || coalesce(array_to_string(sizes, ', '), '') || ']}}' AS line FROM f FULL JOIN g USING (path))
SELECT path AS p, length(line) AS compressed_length FROM lines""")
def q_index_projection(spark, d):
    dirs, entries = document_tree(spark, d)
    rows = entries.drop("seq").join(dirs.select(F.col("path").alias("parent"), "seq"), "parent")
    return snapshots.index_projection(dirs, rows).select("p", "compressed_length")


def _directory_each(spark, d):
    """``documents`` with a directory for each, as (dirs, entries)."""
    docs, none = document_files(spark, d), F.lit(None).cast("long")
    path = F.concat("parent", F.lit("/"), "seq")
    files = docs.select("snapshot", "seq", F.lit(0).alias("pos"), "kind", path.alias("parent"), "name", F.concat(path, F.lit("/"), "name").alias("full_path"), "size", none.alias("created"), none.alias("modified"), none.alias("accessed"))
    return docs.select("snapshot", "seq", path.alias("path"), F.lit("/").alias("root"), F.lit("Linux").alias("os_name")), files


@query(f"WITH {FILES} SELECT 'documents' AS part, parent || '/' || seq AS parent, name, size FROM files WHERE seq % 100 = 7 UNION ALL SELECT 'all', NULL, NULL, CAST(sum(size) AS BIGINT) FROM files")
def q_indexed_snapshot(spark, d):
    """A snapshot of a directory per document written with an index; a hundredth looked up by path, and all read by ranges."""
    dirs, entries = _directory_each(spark, d)
    folder = fresh(spark)
    indexed.write_indexed(dirs, entries, folder, {"os_name": "Linux"})
    wanted = dirs.where("seq % 100 = 7").select(F.col("path").alias("p"))
    files = lambda lines: lines.select(F.col("p").alias("parent"), F.inline(F.arrays_zip(F.col("f").alias("name"), F.col("s").alias("size"))))
    some = files(indexed.read_indexed(spark, folder, wanted)).select(F.lit("documents").alias("part"), "parent", "name", "size")
    every = files(indexed.read_indexed(spark, folder)).agg(F.sum("size").alias("size"))
    return some.unionByName(every.select(F.lit("all").alias("part"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("name"), "size"))


@query(f"WITH {FILES}, p AS (SELECT '/' || source || '/' || lang || '/doc_' || labels.doc_id AS prefix FROM labels JOIN documents USING (doc_id) WHERE quality = 0) SELECT full_path, size FROM files WHERE NOT EXISTS (SELECT 1 FROM p WHERE starts_with(full_path, prefix))")
def q_skip_prefix_many(spark, d):
    """A prefix for every document of low quality; as raw prefixes they cover documents whose numbers begin alike, too."""
    files = document_files(spark, d)
    low = files.join(table(spark, d, "labels").where("quality = 0").select(F.col("doc_id").alias("seq")), "seq", "left_semi")
    return without_prefixes(files, low.select(F.regexp_replace("full_path", r"\.txt$", "").alias("prefix"))).select("full_path", "size")


@query(f"""WITH r AS (SELECT '/' || host || p AS path FROM (SELECT {_URL} FROM pages)), o AS (SELECT path, count(*) AS n_same FROM r GROUP BY path)
SELECT a.path, a.n_same, count(*) FILTER (starts_with(a.path, b.path || '/')) AS n_above, count(*) FILTER (starts_with(b.path, a.path || '/')) AS n_below FROM o a, o b GROUP BY a.path, a.n_same""")
def q_scan_overlaps(spark, d):
    """The directory of every page as the root of a scan: how many others hold it or lie in it."""
    url = F.col("url")
    path = F.concat(F.lit("/"), F.regexp_extract(url, "^[a-z]+://([^/?#]+)", 1), F.rtrim(F.regexp_extract(url, "^[a-z]+://[^/?#]+([^?#]*)", 1), F.lit("/")))
    return filesystem.overlaps(table(spark, d, "pages").select(path.alias("path"), F.lit("Linux").alias("os_name")))


@query(f"WITH {FILES}, r AS (SELECT full_path, size, row_number() OVER (ORDER BY size DESC, full_path) AS n FROM files) SELECT full_path, size FROM r WHERE n > 420 AND n <= 440")
def q_largest_page_far(spark, d):
    """A late page of a ranking that is sorted once."""
    return content.Ranking(document_files(spark, d).select("full_path", "size")).page(21)


def _name_index(spark, d):
    """An index over the entries of the document tree, directories among them, and over the names of parts."""
    _, entries = document_tree(spark, d)
    none = F.lit(None).cast("long")
    parts = table(spark, d, "part").select(F.lit("parts").alias("snapshot"), F.col("p_partkey").alias("seq"), F.lit(0).alias("pos"), F.lit("f").alias("kind"), F.lit("/").alias("parent"), F.col("p_name").alias("name"), F.concat(F.lit("/"), "p_name").alias("full_path"), F.col("p_size").cast("long").alias("size"), none.alias("created"), none.alias("modified"), none.alias("accessed"))
    folder = fresh(spark)
    name_index.build(entries.unionByName(parts), folder)
    return folder


_NAMED = f"""WITH {FILES}, ds AS (SELECT DISTINCT source AS name, '/' AS parent FROM files UNION SELECT DISTINCT lang, '/' || source FROM files),
named AS (SELECT 'file' AS type, name, parent AS path, size FROM files UNION ALL SELECT 'directory', name, parent, NULL FROM ds UNION ALL SELECT 'file', p_name, '/', CAST(p_size AS BIGINT) FROM part)"""
#: Terms of the three kinds: long ones, short ones, and one that both files and directories have.
_TERMS = {"contains": "rc1", "short": "9", "starts": "starts:SRC", "ends": "ends:7.txt", "parts": "an", "none": "zzzz"}


@query(f"""{_NAMED} SELECT 'contains' AS term, * FROM named WHERE contains(lower(name), 'rc1') UNION ALL SELECT 'short', * FROM named WHERE contains(lower(name), '9')
UNION ALL SELECT 'starts', * FROM named WHERE starts_with(lower(name), 'src') UNION ALL SELECT 'ends', * FROM named WHERE suffix(lower(name), '7.txt')
UNION ALL SELECT 'parts', * FROM named WHERE contains(lower(name), 'an') UNION ALL SELECT 'none', * FROM named WHERE contains(lower(name), 'zzzz')""")
def q_search_indexed(spark, d):
    folder, out = _name_index(spark, d), None
    for term, text in _TERMS.items():
        hits = name_index.indexed_search(spark, folder, text).select(F.lit(term).alias("term"), "type", "name", "path", "size")
        out = hits if out is None else out.unionByName(hits)
    return out


@query("""WITH h AS (SELECT doc_id, strlen(text) AS size, sha256(text) AS hash, count(*) OVER (PARTITION BY strlen(text)) AS of_size, count(*) OVER (PARTITION BY text) AS copies FROM documents)
SELECT doc_id, CAST(size AS BIGINT) AS size, copies > 1 AS twice, CASE WHEN of_size > 1 THEN CAST(least(size, 512) + CASE WHEN size > 512 AND ends > 1 THEN size ELSE 0 END AS BIGINT) ELSE 0 END AS bytes_read
FROM h JOIN (SELECT doc_id, count(*) OVER (PARTITION BY strlen(text), CASE WHEN strlen(text) <= 512 THEN encode(text) ELSE encode(text)[1:256] || encode(text)[strlen(text) - 255 : strlen(text)] END) AS ends FROM documents) USING (doc_id)""")
def q_staged_duplicates(spark, d):
    """Every document written as a file of its own; ends of 256 bytes, ranges of 1,000."""
    folder = fresh(spark)
    docs = table(spark, d, "documents").select("doc_id", "text")

    def write(batches):
        store, at = pafs.FileSystem.from_uri(folder)
        store.create_dir(at)
        for b in batches:
            texts = [t.encode() for t in b.column("text").to_pylist()]
            names = [f"{folder}/{i}" for i in b.column("doc_id").to_pylist()]
            for name, text in zip(names, texts, strict=True):
                with store.open_output_stream(f"{at}/{name.rpartition('/')[2]}", compression=None) as out:
                    out.write(text)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([len(t) for t in texts], pa.int64())], names=["full_path", "size"])

    files = kept(docs.mapInArrow(write, "full_path string, size long"))
    found = staged.alike(files, ends=256, most=1000)
    return found.select(F.regexp_extract("full_path", r"(\d+)$", 1).cast("long").alias("doc_id"), "size", F.col("digest").isNotNull().alias("twice"), "bytes_read")


@query(f"WITH {FILES}, {ANCESTORS} SELECT path AS current_path, S, C, {fmt('S')} AS total_size_formatted FROM totals WHERE path = '/src1'")
def q_directory_page(spark, d):
    dirs, entries = document_tree(spark, d)
    return tree.page(dirs, tree.rollup(dirs, entries), "/src1").drop("snapshot")


@query(f"WITH {FILES}, ds AS (SELECT DISTINCT source AS name, '/' AS parent FROM files UNION SELECT DISTINCT lang, '/' || source FROM files) SELECT 'file' AS type, name, parent AS path, size FROM files WHERE contains(name, '1') UNION ALL SELECT 'directory', name, parent, NULL FROM ds WHERE contains(name, '1')")
def q_search_both(spark, d):
    """Files and directories in one list of hits."""
    _, entries = document_tree(spark, d)
    return search.search(entries, "1").select("type", "name", "path", "size")


@query("SELECT 'snapshot_' || event_id || '_' || user_id || '.jsonl.gz' AS filename, event_id AS timestamp FROM events ORDER BY event_id DESC, filename LIMIT 10")
def q_snapshots_newest(spark, d):
    files = table(spark, d, "events").select(F.concat(F.lit("snapshot_"), "event_id", F.lit("_"), "user_id", F.lit(".jsonl.gz")).alias("filename"), F.col("event_id").alias("size"), F.col("ts").alias("modificationTime"))
    return snapshots.newest_first(snapshots.listed(files)).limit(10).select("filename", "timestamp")


@query("SELECT 'host' || (s_suppkey % 5) AS host, s_suppkey % 5 < 3 AS known FROM supplier GROUP BY ALL")
def q_hosts_known(spark, d):
    """Hosts of all suppliers against the devices of three of them."""
    host = F.concat(F.lit("host"), F.col("s_suppkey") % 5)
    suppliers = table(spark, d, "supplier").select("s_suppkey", host.alias("host"))
    devices = suppliers.where("s_suppkey % 5 < 3").select(F.col("host").alias("host_name"))
    return snapshots.hosts_known(suppliers.select("host").distinct(), devices)


@query(f"WITH {FILES} SELECT seq, full_path, seq % 3 != 0 AS source_exists FROM files")
def q_source_exists(spark, d):
    """Of every three documents two are written as files, empty ones; the tasks look for all of them.

    A thousand numbers share a folder and one task writes it, as tasks that add to one folder wait for each other.
    """
    folder = fresh(spark)
    docs = document_files(spark, d).select("seq", F.col("full_path").alias("tree_path"), F.expr("seq div 1000").cast("string").alias("of"))

    def write(batches):
        store, at = pafs.FileSystem.from_uri(folder)
        made = set()
        for b in batches:
            for i, of in zip(b.column("seq").to_pylist(), b.column("of").to_pylist(), strict=True):
                if i % 3:
                    if of not in made:
                        store.create_dir(f"{at}/{of}")
                        made.add(of)
                    store.open_output_stream(f"{at}/{of}/{i}", compression=None).close()
            yield b

    dealt = docs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "of")
    named = kept(dealt.mapInArrow(write, "seq long, tree_path string, of string"))
    local = F.concat(F.lit(folder.removeprefix("file://") + "/"), "of", F.lit("/"), "seq")
    return backup.with_sources(named.withColumn("full_path", local)).select("seq", F.col("tree_path").alias("full_path"), "source_exists")


@query(f"""WITH RECURSIVE {FILES}, {MEMBERS}, picked AS ({_KEPT[_KEPT.index('SELECT full_path, size'):].replace('SELECT full_path, size', 'SELECT seq, full_path, size')})),
n AS (SELECT *, row_number() OVER (ORDER BY seq) AS r FROM picked),
pk(r, zip_index, held) AS (SELECT r, CAST(0 AS BIGINT), size FROM n WHERE r = 1 UNION ALL
  SELECT n.r, CASE WHEN held > 0 AND held + size > 9000 THEN zip_index + 1 ELSE zip_index END, CASE WHEN held > 0 AND held + size > 9000 THEN size ELSE held + size END FROM pk JOIN n ON n.r = pk.r + 1)
SELECT full_path AS src_path, '/b/' || printf('backup_%03d.zip', zip_index) AS dest_path, ltrim(full_path, '/') AS member, size AS filesize, 'zip' AS action FROM pk JOIN n USING (r)""")
def q_backup_dry_run(spark, d):
    """The plan of a backup of a selection, with nothing written."""
    dirs, entries = document_tree(spark, d)
    files = groups.select(entries, dirs, label_groups(spark, d), ["keep", "tree"], ["ignore", "drop"])
    packed = backup.pack(files, ["snapshot"], ["seq", "pos"], 9000)
    return backup.manifest(backup.volumes(packed, ["snapshot"]), "/b")


@query(f"WITH {FILES}, {MEMBERS}, picked AS ({_KEPT[_KEPT.index('SELECT full_path, size'):].replace('SELECT full_path, size', 'SELECT seq, full_path')})) SELECT full_path AS file_path, sha256(text) AS hash, 'sha256' AS algorithm FROM picked JOIN documents ON seq = doc_id")
def q_selected_hashes(spark, d):
    """Digests of a selection's contents."""
    dirs, entries = document_tree(spark, d)
    files = groups.select(entries, dirs, label_groups(spark, d), ["keep", "tree"], ["ignore", "drop"])
    met = files.join(table(spark, d, "documents").select(F.col("doc_id").alias("seq"), "text"), "seq")
    return met.select(F.col("full_path").alias("file_path"), content.content_hash(F.col("text")).alias("hash"), F.lit("sha256").alias("algorithm"))


@query("""SELECT '/' || doc_id AS parent, 'a' AS name, CAST(strlen(text) AS BIGINT) AS size, doc_id AS modified FROM documents
UNION ALL SELECT '/' || doc_id, 'b', 0, NULL FROM documents""")
def q_ragged_lines(spark, d):
    """Lines of two files each, with one size and one time: what is not there is 0 and null."""
    docs = table(spark, d, "documents")
    line = F.format_string('{"p":"/%d","f":["a","b"],"s":[%d],"t":[[1,%d,3]],"os_name":"Linux"}', "doc_id", F.octet_length("text"), "doc_id")
    lines = snapshots.parsed(docs.select(F.concat(F.lit("s"), "doc_id").alias("snapshot"), F.lit(0).cast("long").alias("seq"), line.alias("value")))
    return snapshots.entries_of(lines).select("parent", "name", "size", "modified")


@query(ORACLES["q_group_replay"])
def q_log_blank_lines(spark, d):
    """The log with blank lines between its own, read back."""
    path, log = f"{fresh(spark)}/x_groups.jl", event_log(spark, d)
    line = F.to_json(F.array("path", "kind", "group", "action", F.col("ts").cast("string")))
    lines = log.select("seq", F.explode(F.array(line, F.when(F.col("seq") % 2 == 0, "").otherwise("  \t"))).alias("value"))
    lines.repartitionByRange("seq").sortWithinPartitions("seq", F.desc(F.length(F.trim("value")))).select("value").write.text(path)
    return groups.replay(snapshots.read_group_log(spark, path, "events")).select(F.col("group").alias("grp"), "path")

"""The queries that apply each operator to its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.llm import decontamination, html_text, jaccard_join, lm_score, merkle, neighbours, prefix_trie, quality, repeated_spans, sentencepiece_unigram, token_files, url_filter, warc

END_ID = 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries of three lists over the hosts of ``pages``: the tables hold no lists, so
    digits of each host's MD5 choose the lists, actions and days.
    """
    hosts = pages.select(url_filter.host_of(F.col("url")).alias("host")).where("host != ''").distinct()
    digit = lambda i, n: F.conv(F.substring(F.md5("host"), i, n), 16, 10).cast("int")
    day = lambda n: F.expr("timestamp'2024-01-01 00:00:00'") + F.make_dt_interval(n)
    steps = F.array(
        F.struct(F.lit("ads").alias("list_name"), F.lit("block").alias("action"), day(digit(1, 2)).alias("effective"), (digit(9, 1) < 6).alias("used")),
        F.struct(F.lit("ads").alias("list_name"), F.lit("remove").alias("action"), day(digit(1, 2) + digit(3, 2)).alias("effective"), (digit(9, 1) < 3).alias("used")),
        F.struct(F.lit("abuse").alias("list_name"), F.lit("block").alias("action"), day(digit(5, 2)).alias("effective"), (digit(10, 1) < 5).alias("used")),
        F.struct(F.lit("trusted").alias("list_name"), F.lit("allow").alias("action"), day(digit(7, 2)).alias("effective"), (digit(11, 1) < 2).alias("used")),
    )
    dated = hosts.select("host", F.explode(steps).alias("s")).where("s.used").select(F.col("s.list_name").alias("list_name"), F.col("host").alias("pattern"), F.col("s.action").alias("action"), F.col("s.effective").alias("effective"))
    section = hosts.where(digit(12, 1) < 4).select(F.lit("sections").alias("list_name"), F.concat("host", F.lit("/de")).alias("pattern"), F.lit("block").alias("action"), day(F.lit(30)).alias("effective"))
    domain = hosts.select(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1).alias("d")).distinct().where("d != '' AND length(d) % 2 = 1")
    domains = domain.select(F.lit("domains").alias("list_name"), F.col("d").alias("pattern"), F.lit("block").alias("action"), day(F.lit(200)).alias("effective"))
    return dated.unionByName(section).unionByName(domains)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch times are not in the table either: page n is fetched n mod 366 days and n mod 24 hours into 2024."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.expr("timestamp'2024-01-01 00:00:00'") + F.make_dt_interval((F.col("page_id") % 366).cast("int"), (F.col("page_id") % 24).cast("int"))
    return url_filter.filter_captures(pages.withColumn("fetched", fetched), list_entries(pages))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"), k=3, percent=90).drop("tkey")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digests(spark, _table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), END_ID)


def op5_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans.removal_digest(_table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = sentencepiece_unigram.loaded(tokenizer_path("piece_bpe_32k.model"))
    return sentencepiece_unigram.round_trip(_table(spark, sf_dir, "documents"), model)


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, _table(spark, sf_dir, "pages"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(_table(spark, sf_dir, "conversations"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proofs(_table(spark, sf_dir, "documents"))


def op13_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_url_filter, op3_jaccard_join, op4_token_files, op5_repeated_spans, op6_sentencepiece, op7_nearest_neighbours, op8_html_text, op9_warc, op10_quality, op11_prefix_trie, op12_merkle_manifest, op13_lm_score)}


OP1_SQL = r"""
WITH words AS MATERIALIZED (
  SELECT doc_id, w, i FROM (
    SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
    FROM (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents WHERE text IS NOT NULL))),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
placed AS (
  SELECT item_id, i AS j, least(len(ws), 10) AS n, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 8, 2))) AS i FROM item_words WHERE len(ws) > 0)),
windows AS (SELECT DISTINCT item_id, n, win FROM placed),
sizes AS (SELECT DISTINCT n FROM windows),
doc_lists AS (SELECT doc_id, list(w ORDER BY i) AS ws FROM words GROUP BY doc_id),
doc_windows AS (
  SELECT doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM doc_lists, sizes WHERE len(ws) >= n)),
hits AS (SELECT d.doc_id, d.i, d.n, w.item_id FROM doc_windows d JOIN windows w ON d.win = w.win AND d.n = w.n),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id),
matches AS (SELECT d.doc_id, p.item_id, d.i, d.i - p.j AS slant, d.n FROM doc_windows d JOIN placed p ON d.win = p.win AND d.n = p.n),
islands AS (SELECT doc_id, max(i) - min(i) + max(n) AS size FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, slant ORDER BY i) AS g FROM matches) GROUP BY doc_id, item_id, slant, g),
longest AS (SELECT doc_id, max(size) AS longest FROM islands GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(l.ws), 0) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated, CAST(coalesce(m.longest, 0) AS BIGINT) AS longest
FROM documents d LEFT JOIN doc_lists l USING (doc_id) LEFT JOIN hit_words h USING (doc_id) LEFT JOIN hit_items t USING (doc_id) LEFT JOIN longest m USING (doc_id)
"""

_HOST = r"lower(regexp_replace(regexp_replace(regexp_extract(url, '^(?i:[a-z][a-z0-9+.\-]*:)?//([^/?#\\]*)', 1), '^.*@', ''), ':\d*$', ''))"
OP2_SQL = rf"""
WITH captures AS (
  SELECT page_id, url, {_HOST} AS host, regexp_extract(url, '^(?i:[a-z][a-z0-9+.\-]*:)?//[^/?#\\]*(/[^?#]*)', 1) AS path,
    TIMESTAMP '2024-01-01' + to_days(CAST(page_id % 366 AS INTEGER)) + to_hours(page_id % 24) AS fetched FROM pages),
hosts AS (SELECT host, md5(host) AS m FROM (SELECT DISTINCT host FROM captures WHERE host != '')),
digits AS (SELECT host, CAST('0x' || m[1:2] AS INT) AS a, CAST('0x' || m[3:4] AS INT) AS b, CAST('0x' || m[5:6] AS INT) AS c, CAST('0x' || m[7:8] AS INT) AS d,
  CAST('0x' || m[9:9] AS INT) AS u1, CAST('0x' || m[10:10] AS INT) AS u2, CAST('0x' || m[11:11] AS INT) AS u3, CAST('0x' || m[12:12] AS INT) AS u4 FROM hosts),
active AS (
  SELECT host AS pattern, 'block' AS action, a AS day_from, CASE WHEN u1 < 3 THEN a + b END AS day_to FROM digits WHERE u1 < 6 AND NOT (u1 < 3 AND b = 0)
  UNION ALL SELECT host, 'block', a, NULL FROM digits WHERE u1 < 3 AND b = 0
  UNION ALL SELECT host, 'block', c, NULL FROM digits WHERE u2 < 5
  UNION ALL SELECT host, 'allow', d, NULL FROM digits WHERE u3 < 2
  UNION ALL SELECT host || '/de', 'block', 30, NULL FROM digits WHERE u4 < 4
  UNION ALL SELECT x, 'block', 200, NULL FROM (SELECT DISTINCT regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS x FROM hosts) WHERE x != '' AND length(x) % 2 = 1),
met AS (
  SELECT c.page_id, p.pattern, p.action FROM captures c JOIN active p
  ON (c.host = split_part(p.pattern, '/', 1) OR ends_with(c.host, '.' || split_part(p.pattern, '/', 1)))
  AND (strpos(p.pattern, '/') = 0 OR c.path = p.pattern[strpos(p.pattern, '/'):] OR starts_with(c.path, p.pattern[strpos(p.pattern, '/'):] || '/'))
  AND c.fetched >= TIMESTAMP '2024-01-01' + to_days(p.day_from) AND (p.day_to IS NULL OR c.fetched < TIMESTAMP '2024-01-01' + to_days(p.day_to))),
summed AS (
  SELECT page_id, count(*) FILTER (action = 'block') AS n_block, count(*) FILTER (action = 'allow') AS n_allow,
    arg_max(pattern, struct_pack(l := length(pattern), p := pattern)) FILTER (action = 'block') AS blocked_by FROM met GROUP BY page_id)
SELECT c.page_id, c.url, CAST(coalesce(n_block, 0) AS BIGINT) AS n_block, CAST(coalesce(n_allow, 0) AS BIGINT) AS n_allow, blocked_by,
  coalesce(n_block, 0) = 0 OR coalesce(n_allow, 0) > 0 AS kept
FROM captures c LEFT JOIN summed USING (page_id)
"""


OP3_SQL = r"""
WITH RECURSIVE split AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + least(len(ws), 3) - 1], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM split WHERE len(ws) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id != b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
reach(doc_id, to_id) AS (SELECT x, y FROM links UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON r.to_id = l.x)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT doc_id, min(to_id) AS m FROM reach GROUP BY doc_id) USING (doc_id)
"""

OP9_SQL = r"""
WITH payloads AS (SELECT page_id, url, coalesce(html, '') AS payload FROM pages),
hashed AS (SELECT page_id, url, payload, CAST(CAST(unhex(sha1(payload)) AS BIT) AS VARCHAR) AS bits, min(page_id) OVER (PARTITION BY payload) AS first_id FROM payloads)
SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(list_sum(list_transform(range(0, 5), lambda j: CAST(substr(bits, 5 * i + j + 1, 1) AS INTEGER) << (4 - j))) AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id != first_id THEN first_id END AS refers_to, url
FROM hashed
"""


def _crc32(value: str) -> str:
    """SQL of the unsigned CRC-32 of a decimal number, bit by bit."""
    return f"xor(list_reduce(list_transform(string_split(CAST({value} AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT)), lambda a, b: list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(a, b)), 4294967295), 4294967295)"


OP11_SQL = rf"""
WITH RECURSIVE turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place,
    sha256(coalesce(role, '')) || sha256(coalesce(text, '')) AS key, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
heads AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {_crc32("conv_id")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
mixed AS (
  SELECT h.conv_id, 0 AS half, t.place, t.key, t.words FROM heads h JOIN turns t ON t.conv_id = h.base AND t.place <= h.h
  UNION ALL SELECT h.conv_id, 1, t.place, t.key, t.words FROM heads h JOIN turns t ON t.conv_id = h.conv_id AND t.place > h.h),
built AS MATERIALIZED (SELECT conv_id, key, words, row_number() OVER (PARTITION BY conv_id ORDER BY half, place) AS depth FROM mixed),
sizes AS (SELECT h.conv_id, count(b.depth) AS n FROM heads h LEFT JOIN built b USING (conv_id) GROUP BY h.conv_id),
walk(conv_id, depth, prefix, words) AS (
  SELECT conv_id, CAST(0 AS BIGINT), sha256(''), CAST(0 AS BIGINT) FROM sizes
  UNION ALL SELECT w.conv_id, b.depth, sha256(w.prefix || b.key), b.words FROM walk w JOIN built b ON b.conv_id = w.conv_id AND b.depth = w.depth + 1),
pos AS MATERIALIZED (SELECT w.*, n FROM walk w JOIN sizes USING (conv_id)),
nodes AS MATERIALIZED (
  SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256 FROM pos GROUP BY depth, prefix),
up AS (SELECT c.depth, c.prefix, p.prefix AS parent, q.conv_id AS parent_conv_id FROM nodes c JOIN pos p ON p.conv_id = c.conv_id AND p.depth = c.depth - 1 JOIN nodes q ON q.depth = p.depth AND q.prefix = p.prefix),
children AS (SELECT depth - 1 AS depth, parent AS prefix, count(*) AS n_children FROM up GROUP BY ALL),
rolled AS (
  SELECT a.depth, a.prefix, count(*) FILTER (k.n_children IS NULL) AS n_leaves, sum((m.n_convs - 1) * m.words) AS saved
  FROM nodes m JOIN pos a ON a.conv_id = m.conv_id AND a.depth <= m.depth LEFT JOIN children k ON k.depth = m.depth AND k.prefix = m.prefix GROUP BY a.depth, a.prefix)
SELECT m.conv_id, m.depth, u.parent_conv_id, m.n_convs, CAST(coalesce(k.n_children, 0) AS BIGINT) AS n_children, CAST(r.n_leaves AS BIGINT) AS n_leaves, CAST(r.saved AS BIGINT) AS saved_tokens, m.ends_sha256
FROM nodes m JOIN rolled r USING (depth, prefix) LEFT JOIN up u USING (depth, prefix) LEFT JOIN children k USING (depth, prefix)
"""

_LEAF = "sha256(" + " || ".join(f"coalesce(CAST(strlen({c}) AS VARCHAR) || ':' || {c}, '-')" for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", "{text}")) + ")"
OP12_SQL = f"""
WITH RECURSIVE leaves AS MATERIALIZED (
  SELECT doc_id, source, {_LEAF.format(text="text")} AS leaf,
    CASE WHEN coalesce({_crc32("doc_id")} % 5 = 0, false) THEN {_LEAF.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_LEAF.format(text="text")} END AS folded FROM documents),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS grp FROM leaves),
tree(grp, lv, pos, n, h) AS (
  SELECT grp, 0, pos, n, leaf FROM placed
  UNION ALL SELECT grp, lv + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY grp, lv, n, pos // 16),
low AS MATERIALIZED (SELECT * FROM tree),
tops AS (SELECT grp AS pos, h, count(*) OVER () AS n FROM low WHERE n = 1),
rise(lv, pos, n, h) AS (
  SELECT 0, pos, n, h FROM tops UNION ALL SELECT lv + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM rise WHERE n > 1 GROUP BY lv, n, pos // 16),
high AS MATERIALIZED (SELECT * FROM rise),
-- The groups' tree goes on above each group's own: its levels are counted from that group's top.
heights AS (SELECT grp, max(lv) AS top FROM low GROUP BY grp),
near AS MATERIALIZED (
  SELECT a.grp, a.lv, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM low a JOIN low b ON a.grp = b.grp AND a.lv = b.lv AND a.pos // 16 = b.pos // 16 WHERE a.n > 1 GROUP BY ALL),
far AS MATERIALIZED (
  SELECT a.lv, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM high a JOIN high b ON a.lv = b.lv AND a.pos // 16 = b.pos // 16 WHERE a.n > 1 GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER () AS k FROM placed),
fold(k, grp, lv, pos, h, proof) AS (
  SELECT k, grp, 0, pos, folded, '' FROM numbered
  UNION ALL SELECT f.k, f.grp, f.lv + 1, f.pos // 16, sha256(s.l || f.h || s.r), f.proof || s.l || s.r FROM fold f JOIN near s ON s.grp = f.grp AND s.lv = f.lv AND s.pos = f.pos),
below AS (SELECT f.* FROM fold f JOIN heights t ON t.grp = f.grp AND t.top = f.lv),
climb(k, grp, lv, pos, h, proof) AS (
  SELECT k, grp, 0, grp, h, proof FROM below
  UNION ALL SELECT c.k, c.grp, c.lv + 1, c.pos // 16, sha256(s.l || c.h || s.r), c.proof || s.l || s.r FROM climb c JOIN far s ON s.lv = c.lv AND s.pos = c.pos),
done AS (SELECT c.* FROM climb c WHERE c.lv = (SELECT max(lv) FROM high))
SELECT p.doc_id, p.leaf, t.h AS subroot, r.h AS root, sha256(d.proof) AS proof_sha256, d.h AS folded_root, d.h = r.h AS verified
FROM numbered p JOIN done d USING (k) JOIN tops t ON t.pos = p.grp JOIN high r ON r.n = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1_SQL, "op2_url_filter": OP2_SQL, "op3_jaccard_join": OP3_SQL, "op9_warc": OP9_SQL, "op11_prefix_trie": OP11_SQL, "op12_merkle_manifest": OP12_SQL}

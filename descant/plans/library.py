"""Catalogue and browsing queries. Pages stand for files, parts and suppliers for songs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import browse as B, catalogue as C
from .base import query, table

_STORED = "SELECT CASE WHEN page_id % 11 = 0 THEN 'old/' ELSE 'lib/' END || page_id || '.mp4' AS file_path FROM pages WHERE page_id % 7 <> 0"
_SCANNED = "SELECT 'lib/' || page_id || '.mp4' AS file_path FROM pages WHERE page_id % 5 <> 0"


def stored(spark: SparkSession, sf: str) -> DataFrame:
    top = F.when(F.col("page_id") % 11 == 0, "old/").otherwise("lib/")
    return table(spark, sf, "pages").where("page_id % 7 <> 0").select(F.concat(top, F.col("page_id").cast("string"), F.lit(".mp4")).alias("file_path"))


def scanned(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").where("page_id % 5 <> 0").select(F.concat(F.lit("lib/"), F.col("page_id").cast("string"), F.lit(".mp4")).alias("file_path"))


_DIFF = f"""
stored AS ({_STORED}), scanned AS ({_SCANNED}),
gone AS (SELECT file_path, split_part(file_path, '/', 2) AS name FROM stored WHERE file_path NOT IN (SELECT file_path FROM scanned)),
fresh AS (SELECT file_path, split_part(file_path, '/', 2) AS name FROM scanned WHERE file_path NOT IN (SELECT file_path FROM stored)),
once AS (SELECT name FROM gone GROUP BY name HAVING count(*) = 1 INTERSECT SELECT name FROM fresh GROUP BY name HAVING count(*) = 1),
diff AS (
  SELECT 'moved' AS change, gone.file_path AS old_path, fresh.file_path AS new_path FROM gone JOIN fresh USING (name) JOIN once USING (name)
  UNION ALL SELECT 'deleted', file_path, NULL FROM gone WHERE name NOT IN (SELECT name FROM once)
  UNION ALL SELECT 'added', NULL, file_path FROM fresh WHERE name NOT IN (SELECT name FROM once))"""


@query(f"WITH {_DIFF} SELECT * FROM diff")
def sync_diff(spark: SparkSession, sf: str) -> DataFrame:
    return C.diff(scanned(spark, sf), stored(spark, sf))


@query(f"WITH {_DIFF} SELECT old_path, new_path FROM diff WHERE change = 'moved'")
def sync_moves(spark: SparkSession, sf: str) -> DataFrame:
    return sync_diff(spark, sf).where("change = 'moved'").select("old_path", "new_path")


@query(f"""WITH {_DIFF}, n AS (SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'moved') AS moved, count(*) FILTER (change = 'deleted') AS gone FROM diff),
t AS (SELECT *, gone > 0 AND gone > 0.5 * (SELECT count(*) FROM stored) AS circuit_tripped FROM n)
SELECT added, moved, CASE WHEN circuit_tripped THEN 0 ELSE gone END AS deleted, circuit_tripped FROM t""")
def sync_guard(spark: SparkSession, sf: str) -> DataFrame:
    return C.guard(sync_diff(spark, sf), stored(spark, sf))


@query(f"WITH s AS ({_STORED}) SELECT count(*) > 0 AND NOT coalesce(bool_or(starts_with(file_path, 'music/')), false) AS changed FROM s")
def sync_directory(spark: SparkSession, sf: str) -> DataFrame:
    return C.directory_changed(stored(spark, sf), "music", None)


@query(f"""WITH {_DIFF}, s AS (SELECT coalesce(d.new_path, stored.file_path) AS file_path FROM stored LEFT JOIN diff d ON d.change = 'moved' AND d.old_path = stored.file_path
UNION SELECT new_path FROM diff WHERE change = 'added') SELECT file_path FROM s WHERE file_path NOT IN (SELECT old_path FROM diff WHERE change = 'deleted')""")
def apply_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    changes = sync_diff(spark, sf)
    by = lambda c: changes.where(F.col("change") == c)
    return C.apply_diff(stored(spark, sf), by("moved"), by("added").select(F.col("new_path").alias("file_path")), by("deleted").select(F.col("old_path").alias("file_path")))


@query(f"WITH s AS ({_STORED}) SELECT file_path, NULL::VARCHAR AS youtube_id, 'mp4' AS format, 'skipped' AS pipeline_state FROM s")
def scan_records(spark: SparkSession, sf: str) -> DataFrame:
    return C.records(stored(spark, sf))


@query("SELECT page_id, page_id || CASE page_id % 4 WHEN 0 THEN '.MP4' WHEN 1 THEN '.webm' WHEN 2 THEN '.txt' ELSE '' END AS path FROM pages WHERE page_id % 4 IN (0, 1)")
def media_scan(spark: SparkSession, sf: str) -> DataFrame:
    ext = F.element_at(F.array(*map(F.lit, (".MP4", ".webm", ".txt", ""))), (F.col("page_id") % 4 + 1).cast("int"))
    return C.media_files(table(spark, sf, "pages").select("page_id", F.concat(F.col("page_id").cast("string"), ext).alias("path")))


@query("SELECT min('d/song' || page_id || '---' || lpad((page_id % 50)::VARCHAR, 11, 'a') || '.mp4') AS path FROM pages WHERE page_id % 50 = 7")
def find_by_id(spark: SparkSession, sf: str) -> DataFrame:
    named = table(spark, sf, "pages").select(F.format_string("d/song%d---%s.mp4", "page_id", F.lpad((F.col("page_id") % 50).cast("string"), 11, "a")).alias("path"))
    return C.find_by_id(named, "aaaaaaaaaa7")


# stored tables


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'new' FROM (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey % 3 = 0) WHERE o_orderkey % 2 <> 0")
def insert_ignore(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    rows = o.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("new").alias("o_orderstatus"))
    return C.insert_ignore(o.where("o_orderkey % 2 = 0").select("o_orderkey", "o_orderstatus"), rows.unionByName(rows), "o_orderkey")


@query("SELECT CASE WHEN c_custkey % 10 = 3 THEN c_name || '#moved' ELSE c_name END AS c_name, c_acctbal FROM customer")
def update_paths(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    moves = c.where("c_custkey % 10 = 3").select(F.col("c_name").alias("old_path"), F.concat("c_name", F.lit("#moved")).alias("new_path"))
    return C.update_keys(c.select("c_name", "c_acctbal"), moves, "c_name")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 4 <> 0")
def delete_paths(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey")
    return C.delete_keys(o, o.where("o_orderkey % 4 = 0").unionByName(spark.range(1).select((-F.col("id") - 1).alias("o_orderkey"))), "o_orderkey")


@query("SELECT c_name AS key, CASE WHEN c_custkey % 5 = 0 THEN 'changed' ELSE c_mktsegment END AS value FROM customer UNION ALL SELECT 'version', '2'")
def kv_upsert(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    rows = c.where("c_custkey % 5 = 0").select(F.col("c_name").alias("key"), F.lit("changed").alias("value"))
    return C.upsert(c.select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value")), rows.unionByName(spark.createDataFrame([("version", "2")], "key string, value string")), "key")


@query("SELECT s_name, CASE WHEN s_name = (SELECT min(s_name) FROM supplier) THEN 'ready' ELSE 'skipped' END AS pipeline_state FROM supplier")
def set_state(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select("s_name", F.lit("skipped").alias("pipeline_state"))
    return C.set_where(s, "s_name", s.agg(F.min("s_name")).first()[0], "pipeline_state", F.lit("ready"))


@query("SELECT count(*) FILTER (o_custkey IS NULL) = 0 AND count(DISTINCT o_custkey) FILTER (n > 1) = 0 AS ok, count(*) FILTER (o_custkey IS NULL) AS nulls, count(DISTINCT o_custkey) FILTER (n > 1) AS duplicates FROM (SELECT o_custkey, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)")
def integrity(spark: SparkSession, sf: str) -> DataFrame:
    return C.integrity(table(spark, sf, "orders"), "o_custkey")


@query("SELECT s_suppkey AS id, s_name AS file_path, NULL::VARCHAR AS youtube_id, 'mp4' AS format, NULL::VARCHAR AS artist, NULL::VARCHAR AS title, NULL::VARCHAR AS variant, NULL::INTEGER AS year, NULL::VARCHAR AS genre, 'pending' AS metadata_status, 0 AS enrichment_attempts, NULL::TIMESTAMP AS last_enrichment_attempt, NULL::DOUBLE AS loudnorm_offset_db, 'skipped' AS pipeline_state, NULL::TIMESTAMP AS created_at, NULL::TIMESTAMP AS updated_at FROM supplier")
def migrate(spark: SparkSession, sf: str) -> DataFrame:
    return C.migrate(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("file_path"), F.lit("mp4").alias("format")))


@query("SELECT 1000000 + row_number() OVER (ORDER BY p_name || '#' || lpad(p_partkey::VARCHAR, 9, '0')) AS id, p_name || '#' || lpad(p_partkey::VARCHAR, 9, '0') AS file_path, p_brand AS artist, p_size AS year FROM part")
def register_downloads(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat("p_name", F.lit("#"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"))
    rows = table(spark, sf, "part").select(F.lit(0).cast("bigint").alias("id"), path.alias("file_path"), F.col("p_brand").alias("artist"), F.col("p_size").alias("year"))
    return C.with_ids(spark.createDataFrame([(1_000_000, "first")], "id bigint, file_path string"), rows)


@query("SELECT c_name AS key, CASE WHEN c_custkey % 3 = 0 THEN 'given' WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'default' END AS value, CASE WHEN c_custkey % 3 = 0 THEN 'given' WHEN c_custkey % 2 = 0 THEN 'stored' ELSE 'default' END AS origin FROM customer")
def settings_precedence(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    kv = lambda where, v: c.where(where).select(F.col("c_name").alias("key"), v.alias("value"))
    return C.settings(kv("true", F.lit("default")), kv("c_custkey % 2 = 0", F.col("c_mktsegment")), kv("c_custkey % 3 = 0", F.lit("given")))


@query("SELECT o.o_orderkey, l.n AS lines FROM orders o JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) l ON l_orderkey = o_orderkey WHERE o_orderkey % 9 = 0")
def batch_lookup(spark: SparkSession, sf: str) -> DataFrame:
    keys = table(spark, sf, "orders").where("o_orderkey % 9 = 0").select("o_orderkey")
    states = table(spark, sf, "lineitem").where("l_linenumber = 1").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"))
    return C.found_of(keys, states, "o_orderkey")


@query("SELECT k AS c_custkey, c_acctbal FROM (VALUES (1::BIGINT), (2::BIGINT), (-5::BIGINT)) t(k) LEFT JOIN customer ON c_custkey = k")
def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return C.stored_of(spark.createDataFrame([(1,), (2,), (-5,)], "c_custkey bigint"), table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_custkey")


@query("SELECT count(*) AS songs, count(DISTINCT p_type) AS kinds FROM part")
def library_stats(spark: SparkSession, sf: str) -> DataFrame:
    return C.stats(table(spark, sf, "part"), "p_type")


_ART = """WITH p AS (SELECT 'lib/s' || page_id AS stem, page_id FROM pages),
m AS (SELECT 'lib/s' || page_id || '.mp4' AS path, list_filter([CASE WHEN page_id % 2 <> 0 THEN 'karaoke' END, CASE WHEN page_id % 3 <> 0 OR page_id % 6 <> 0 THEN 'stems' END, CASE WHEN page_id % 5 <> 0 THEN 'subtitles' END], lambda x: x IS NOT NULL) AS missing FROM p)"""


def _artifacts(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    made = lambda where, form: p.where(where).select(F.format_string(form, "page_id").alias("path"))
    files = made("page_id % 2 = 0", "lib/karaoke/s%d.ass").unionByName(made("page_id % 3 = 0", "lib/vocal/s%d---vocal.m4a")).unionByName(made("page_id % 6 = 0", "lib/nonvocal/s%d---nonvocal.m4a")).unionByName(made("page_id % 5 = 0", "lib/subtitles/s%d.en.srt"))
    return C.missing_artifacts(p.select(F.format_string("lib/s%d.mp4", "page_id").alias("file_path")), files)


@query(f"{_ART} SELECT * FROM m")
def missing_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    return _artifacts(spark, sf)


@query(f"""{_ART} SELECT path, CASE WHEN list_contains(missing, 'stems') THEN ['extract', 'loudness', 'separate', 'transcode'] WHEN list_contains(missing, 'karaoke') OR list_contains(missing, 'subtitles') THEN ['decode'] ELSE [] END
|| CASE WHEN list_contains(missing, 'karaoke') OR list_contains(missing, 'subtitles') THEN ['align'] ELSE [] END AS stages FROM m""")
def work_plan(spark: SparkSession, sf: str) -> DataFrame:
    return _artifacts(spark, sf).select("path", C.work_plan(F.col("missing")).alias("stages"))


@query("SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'genius' WHEN page_id % 7 = 0 THEN 'none' WHEN page_id % 3 = 0 THEN 'srt' ELSE 'none' END AS origin FROM pages")
def lyric_origin(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select("page_id", F.when(F.col("page_id") % 5 == 0, "77").alias("genius_id"), F.when(F.col("page_id") % 7 == 0, "raw").alias("mode"), F.when(F.col("page_id") % 3 == 0, "a.srt").alias("subtitle"))
    return C.lyric_origin(p).select("page_id", "origin")


@query("SELECT 'lib/' || page_id || '.mp4' AS path, unnest([{'kind': 'stem', 'companion': 'lib/vocal/' || page_id || '---vocal.m4a'}, {'kind': 'stem', 'companion': 'lib/nonvocal/' || page_id || '---nonvocal.m4a'}, {'kind': 'karaoke', 'companion': 'lib/karaoke/' || page_id || '.ass'}, {'kind': 'subtitles', 'companion': 'lib/subtitles/' || page_id || '.srt'}, {'kind': 'subtitles', 'companion': 'lib/subtitles/' || page_id || '.en.srt'}], recursive := true) FROM pages")
def companions(spark: SparkSession, sf: str) -> DataFrame:
    return C.companions(table(spark, sf, "pages").select(F.format_string("lib/%d.mp4", "page_id").alias("file_path")))


# browsing


@query("SELECT doc_id, lower(substr(text, 1, 12)) AS name FROM documents WHERE substr(strip_accents(lower(text)), 1, 1) = 'e'")
def browse_letter(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.lower(F.substring("text", 1, 12)).alias("name"))
    return B.starts_with_letter(d, "E", "name")


@query("SELECT p_partkey, p_size || p_name AS name FROM part WHERE p_size % 2 = 0")
def browse_number(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.concat(F.col("p_size").cast("string"), "p_name")).otherwise(F.col("p_name")).alias("name"))
    return B.starts_with_number(p, "name")


@query("SELECT p_partkey, p_name, row_number() OVER (ORDER BY lower(p_name), p_partkey) AS position FROM part QUALIFY position BETWEEN 101 AND 150")
def browse_page(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    return B.page(p, [B.sort_key(F.col("p_name")), F.col("p_partkey")], 3, 50).withColumn("position", F.col("position").cast("bigint"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS position FROM orders QUALIFY position <= 100")
def browse_recent(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return B.page(o, [F.desc("o_orderdate"), F.col("o_orderkey")], 1).select("o_orderkey", F.col("position").cast("bigint").alias("position"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'an')")
def autocomplete(spark: SparkSession, sf: str) -> DataFrame:
    return B.search(table(spark, sf, "part").select("p_partkey", "p_name"), "AN", "p_name")


@query("SELECT p_partkey, contains(lower(p_name), 're') OR contains(lower(p_name), 'blue') AS blocked FROM part")
def blocked_words(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", B.blocked(F.col("p_name"), "re, , BLUE").alias("blocked"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 3 <> 1)")
def exclude_queued(spark: SparkSession, sf: str) -> DataFrame:
    return C.delete_keys(table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").where("o_custkey % 3 <> 1").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("""WITH j AS (SELECT user_id AS doc_id, arg_max(event_type, event_id) AS job_status FROM events GROUP BY 1)
SELECT doc_id, source, coalesce(CASE quality WHEN 1 THEN 'ready' ELSE CASE WHEN quality IS NOT NULL THEN 'failed' END END, 'skipped') AS pipeline_state, job_status, doc_id = 7 AS is_active FROM documents LEFT JOIN labels USING (doc_id) LEFT JOIN j USING (doc_id)""")
def enrich_left(spark: SparkSession, sf: str) -> DataFrame:
    states = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "ready").otherwise("failed").alias("pipeline_state"))
    jobs = table(spark, sf, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"))
    rows = table(spark, sf, "documents").select("doc_id", "source")
    return B.enrich(rows, states, jobs, 7, "doc_id")


@query("SELECT lpad((page_id * 2)::VARCHAR, 11, 'v') AS video_id, CASE WHEN (page_id * 2) <= (SELECT max(page_id) FROM pages) AND (page_id * 2) IN (SELECT page_id FROM pages) THEN 'lib/s---' || lpad((page_id * 2)::VARCHAR, 11, 'v') || '.mp4' END AS local_path FROM pages")
def search_lookup(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    hits = p.select(F.lpad((F.col("page_id") * 2).cast("string"), 11, "v").alias("video_id"))
    return B.lookup(hits, p.select(F.format_string("lib/s---%s.mp4", F.lpad(F.col("page_id").cast("string"), 11, "v")).alias("file_path")))


@query("WITH f AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) WHEN p_partkey % 3 = 1 THEN p_name || ' - live' END AS suggestion FROM part WHERE p_partkey >= 20), g AS (SELECT * FROM f WHERE p_partkey % 3 = 1 ORDER BY p_partkey LIMIT 10) SELECT *, max(p_partkey) OVER () + 1 AS resume FROM g")
def rename_scan(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("p_partkey") % 3
    p = table(spark, sf, "part").select("p_partkey", "p_name", F.when(kind == 0, F.upper("p_name")).when(kind == 1, F.concat("p_name", F.lit(" - live"))).alias("suggestion"))
    return B.rename_page(p, "p_name", "suggestion", "p_partkey", 20)


@query("SELECT page_id, NOT coalesce(page_id % 4 = 0, false) AS accepted FROM pages")
def enqueue_gate(spark: SparkSession, sf: str) -> DataFrame:
    state = F.when(F.col("page_id") % 8 == 0, "pending").when(F.col("page_id") % 4 == 0, "failed").otherwise("ready")
    return table(spark, sf, "pages").select("page_id", C.accepts(state).alias("accepted"))


@query("SELECT page_id, split_part(regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), '^.*@', ''), '.', 1) AS head, regexp_matches(lpad(page_id::VARCHAR, CASE WHEN page_id % 2 = 0 THEN 11 ELSE 10 END, 'x'), '^[A-Za-z0-9_-]{11}$') AS valid FROM pages")
def id_validity(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    host = F.regexp_replace(F.regexp_extract("url", "://([^/?#]*)", 1), "^.*@", "")
    name = F.lpad(F.col("page_id").cast("string"), 11, "x")
    return p.select("page_id", F.substring_index(host, ".", 1).alias("head"), T.is_video_id(F.when(F.col("page_id") % 2 == 0, name).otherwise(F.substring(name, 2, 10))).alias("valid"))


@query("SELECT DISTINCT source FROM documents")
def distinct_paths(spark: SparkSession, sf: str) -> DataFrame:
    return C.distinct_of(table(spark, sf, "documents"), "source")


@query("SELECT regexp_extract(url, '[^/]*$') AS name, count(*) AS n, min(url) AS first, max(url) AS last FROM pages GROUP BY 1")
def group_by_basename(spark: SparkSession, sf: str) -> DataFrame:
    return C.by_basename(table(spark, sf, "pages"), "url")

"""Queries over stored forms of a table: bucketed snapshots, pages by key, substring indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import browse as B, catalogue as C, grams, ordered_pages, render
from ..operators.snapshots import Snapshots
from ..session import shared_dir
from ..sources import packs, readers
from . import library  # noqa: F401
from .base import SQL, query, table
from .words import lrc_songs, srt_songs


def _songs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("file_path"), F.col("c_mktsegment").alias("state"), "c_nationkey", "c_acctbal")


def _changed(spark: SparkSession, sf: str) -> Snapshots:
    """Customers as a snapshot, then two changes: debtors get a new state, suppliers come in under both kinds of
    names (known names are ignored), one nation goes, another one's names change."""
    store = Snapshots(spark, shared_dir(spark), "file_path")
    songs = _songs(spark, sf)
    store.create(songs, buckets=32)
    store.apply(upserts=songs.where("c_acctbal < 0").withColumn("state", F.lit("DEBT")))
    supplier = table(spark, sf, "supplier").select(F.explode(F.array(F.lit("c"), F.lit("s"))).alias("kind"), "s_suppkey", F.lit("SUPPLY").alias("state"), F.col("s_nationkey").alias("c_nationkey"), F.col("s_acctbal").alias("c_acctbal"))
    named = supplier.select(F.concat("kind", F.col("s_suppkey").cast("string")).alias("file_path"), "state", "c_nationkey", "c_acctbal")
    moves = songs.where("c_nationkey = 7").select(F.col("file_path").alias("old_path"), F.concat(F.lit("m"), "file_path").alias("new_path"))
    store.apply(moves=moves, inserts=named, deletes=songs.where("c_nationkey = 3").select("file_path"))
    return store


_CHANGED = """WITH c AS (SELECT 'c' || c_custkey AS file_path, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS state, c_nationkey, c_acctbal FROM customer),
m AS (SELECT CASE WHEN c_nationkey = 7 THEN 'm' || file_path ELSE file_path END AS file_path, state, c_nationkey, c_acctbal FROM c),
s AS (SELECT kind || s_suppkey AS file_path, 'SUPPLY' AS state, s_nationkey AS c_nationkey, s_acctbal AS c_acctbal FROM supplier, (VALUES ('c'), ('s')) k(kind)),
a AS (SELECT * FROM m UNION ALL SELECT * FROM s WHERE file_path NOT IN (SELECT file_path FROM m)), t AS (SELECT * FROM a WHERE file_path NOT IN (SELECT file_path FROM c WHERE c_nationkey = 3))
"""


@query(_CHANGED + "SELECT * FROM t")
def bucketed_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return _changed(spark, sf).read()


@query(_CHANGED + "SELECT * FROM t WHERE file_path IN (SELECT 'c' || o_custkey FROM orders WHERE o_totalprice > 400000)")
def bucketed_lookup(spark: SparkSession, sf: str) -> DataFrame:
    keys = table(spark, sf, "orders").where("o_totalprice > 400000").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("file_path"))
    return _changed(spark, sf).lookup(keys)


@query("SELECT 'c' || c_custkey AS file_path, c_mktsegment AS state, c_nationkey, c_acctbal FROM customer")
def snapshot_of_version(spark: SparkSession, sf: str) -> DataFrame:
    """The first version, read after the changes."""
    return _changed(spark, sf).read(1)


# song packs


def _packed(songs: DataFrame) -> DataFrame:
    """songs (stem, kind, body) written as packs and read again."""
    path = shared_dir(songs.sparkSession)
    packs.write_packs(songs, path)
    return packs.read_packs(songs.sparkSession, path)


@query("SELECT doc_id::VARCHAR AS stem, source AS kind, text AS body FROM documents")
def song_packs(spark: SparkSession, sf: str) -> DataFrame:
    return _packed(table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("stem"), F.col("source").alias("kind"), F.col("text").alias("body")))


@query(SQL["lrc_parse"])
def packed_lrc(spark: SparkSession, sf: str) -> DataFrame:
    """Stamped songs through packs."""
    held = _packed(lrc_songs(spark, sf).select(F.col("user_id").cast("string").alias("stem"), F.lit("lrc").alias("kind"), F.col("text").alias("body")))
    out = readers.stamped_rows(held, ["stem"], "body")
    return out.select(F.col("stem").cast("bigint").alias("user_id"), F.col("pos").cast("bigint").alias("pos"), "text", "start", "end")


@query(SQL["srt_parse"])
def packed_srt(spark: SparkSession, sf: str) -> DataFrame:
    """Captions through packs."""
    held = _packed(srt_songs(spark, sf).select(F.col("doc_id").cast("string").alias("stem"), F.lit("srt").alias("kind"), F.col("srt").alias("body")))
    out = readers.caption_rows(held, ["stem"], "body")
    return out.select(F.col("stem").cast("bigint").alias("doc_id"), F.col("cue_no").cast("bigint").alias("cue_no"), "text", "start", "end")


@query("SELECT conv_id, list(text ORDER BY turn) AS align_lines FROM conversations GROUP BY conv_id")
def bundles_read(spark: SparkSession, sf: str) -> DataFrame:
    """Debug bundles of all conversations, as the bundle writer stores and the bundle reader reads them."""
    lines = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text")))["text"].alias("align_lines"))
    path = shared_dir(spark)
    render.write_bundles(lines.select(F.col("conv_id").cast("string").alias("stem"), render.bundle({"lyrics": F.struct("align_lines")}).alias("bundle")), path)
    return readers.bundles(spark, path).select(F.col("stem").cast("bigint").alias("conv_id"), "align_lines")


_LISTED = "SELECT DISTINCT source || '.mp4' AS name FROM documents"


@query(_LISTED)
def library_listing(spark: SparkSession, sf: str) -> DataFrame:
    """A real listing: a file per source is written, below a folder per source, with others beside it, and the
    folder is scanned for media."""
    root = shared_dir(spark)
    made = table(spark, sf, "documents").select("source").distinct()
    named = made.select(F.explode(F.array(*(F.concat("source", F.lit(e)) for e in (".mp4", ".txt", ".jpg")))).alias("name"), F.lit("x").alias("value"))
    named.write.partitionBy("name").text(root)
    found = readers.files(spark, root).select(F.regexp_extract(F.url_decode("path"), "name=([^/]*)/", 1).alias("name"))
    return C.distinct_of(found.where(T.is_media(F.col("name"))), "name")


# pages in a stored order and an index for substrings


@query(SQL["browse_page"])
def browse_page_stored(spark: SparkSession, sf: str) -> DataFrame:
    """The page of `browse_page` from files in the order of the folded name."""
    root = shared_dir(spark)
    p = table(spark, sf, "part").select("p_partkey", "p_name", B.sort_key(F.col("p_name")).alias("folded"))
    ordered_pages.store(p, ["folded", "p_partkey"], root, file_rows=1_000)
    return ordered_pages.stored_page(spark, root, 3, 50).select("p_partkey", "p_name", "position")


@query("WITH o AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS position FROM orders) SELECT * FROM o WHERE (o_totalprice, o_orderkey) > (SELECT (o_totalprice, o_orderkey) FROM o WHERE position = 500) ORDER BY position LIMIT 70")
def browse_after(spark: SparkSession, sf: str) -> DataFrame:
    """The 70 orders behind the 500th, by its key."""
    root = shared_dir(spark)
    order = ["o_totalprice", "o_orderkey"]
    ordered_pages.store(table(spark, sf, "orders").select(*order), order, root, file_rows=10_000)
    last = ordered_pages.stored_page(spark, root, 500, 1).first()
    return ordered_pages.after(spark, root, order, tuple(last[c] for c in order), 70)


@query("SELECT page_id, url FROM pages WHERE contains(lower(url), 'example.org/en') UNION ALL SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'an')")
def indexed_search(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses by the index, and a query that is too short for it."""
    pages, parts = table(spark, sf, "pages").select("page_id", "url"), table(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), F.col("p_name").alias("url"))
    root, other = shared_dir(spark), shared_dir(spark)
    grams.store(pages, "page_id", "url", root)
    grams.store(parts, "page_id", "url", other)
    return grams.search(pages, "page_id", "url", root, "Example.ORG/en").unionByName(grams.search(parts, "page_id", "url", other, "AN"))

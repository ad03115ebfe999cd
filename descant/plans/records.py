"""Queries of reads by key, gates, sources with nested records, and what views are sent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import browse as B, catalogue as C, matching as M, render as R, songs as S
from ..sources import readers as I
from ..streaming import queue as Q
from .base import query, table

def _s(c: str | F.Column) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


# reads by key, gates


@query("SELECT c_mktsegment AS value FROM customer WHERE c_name = (SELECT max(c_name) FROM customer)")
def kv_read(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return C.value_of(c.select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value")), c.agg(F.max("c_name")).first()[0])


@query("""WITH s AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'ready' WHEN 1 THEN 'skipped' WHEN 2 THEN 'pending' ELSE 'failed' END AS state FROM pages WHERE page_id % 7 <> 0)
SELECT p.page_id, CASE WHEN s.state IN ('ready', 'skipped') THEN 'complete' ELSE 'process' END AS action FROM pages p LEFT JOIN s ON p.page_id = s.page_id""")
def processing_due(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select("page_id")
    k = F.col("page_id") % 5
    state = F.when(k == 0, "ready").when(k == 1, "skipped").when(k == 2, "pending").otherwise("failed")
    return C.due(p, p.where("page_id % 7 <> 0").withColumn("pipeline_state", state), "page_id")


@query("""WITH s AS (SELECT 'lib/s' || page_id AS stem FROM pages),
f AS (SELECT 'lib/s' || page_id || x.e AS source FROM pages, (VALUES ('.en.srt', 2), ('.fr.srt', 3), (' (live).de.SRT', 5), ('.srt', 7), ('.vtt', 1)) x(e, m) WHERE page_id % x.m = 0 AND page_id % 10 <> 9)
SELECT 's' AS kind, stem || '.mp4' AS path, arg_min(source, (CASE WHEN contains(source, '.en.srt') THEN 0 ELSE 1 END, source)) AS source, 'lib/subtitles/' || substr(stem, 5) || '.srt' AS target
FROM s JOIN f ON starts_with(source, stem) AND NOT ends_with(source, 'vtt') GROUP BY stem""")
def subtitle_choice(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    made = lambda e, m: p.where(f"page_id % {m} = 0 and page_id % 10 <> 9").select(F.concat(F.lit("lib/s"), _s("page_id"), F.lit(e)).alias("path"))
    files = made(".en.srt", 2).unionByName(made(".fr.srt", 3)).unionByName(made(" (live).de.SRT", 5)).unionByName(made(".srt", 7)).unionByName(made(".vtt", 1))
    return C.subtitle_choice(p.select(F.concat(F.lit("lib/s"), _s("page_id"), F.lit(".mp4")).alias("file_path")), files).withColumn("kind", F.lit("s"))


@query("""SELECT 'lib/s' || conv_id || '.mp4' AS path, list(text ORDER BY turn) AS align_lines FROM conversations WHERE conv_id % 3 <> 0 AND conv_id % 4 <> 1 AND conv_id % 5 <> 0 GROUP BY conv_id""")
def reused_lines(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text")))["text"].alias("lines"))
    n = F.col("conv_id")
    songs = c.select(F.concat(F.lit("lib/s"), _s(n), F.lit(".mp4")).alias("file_path"), F.when(n % 4 == 1, F.array(F.lit("stems"))).when(n % 4 == 2, F.array(F.lit("karaoke"))).otherwise(F.array(F.lit("stems"), F.lit("subtitles"))).alias("missing"), F.when(n % 5 == 0, "raw").alias("choice"))
    stored = c.where("conv_id % 3 <> 0").select(F.concat(F.lit("s"), _s(n)).alias("stem"), R.bundle({"lyrics": F.struct(F.col("lines").alias("align_lines"))}).alias("body"))
    return C.reused_lines(songs, I.bundle_lines(stored, "body"))


@query("SELECT c_name AS key, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END AS value FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def settings_seed(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value"))
    return C.seeded(c.where("c_custkey % 2 = 0").select("key", "value"), c.where("c_custkey % 3 = 0").select("key"))


@query("SELECT c_name AS key, 'default' AS value, 'default' AS origin FROM customer")
def settings_clear(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value"))
    none = C.cleared(c)
    return C.settings(c.withColumn("value", F.lit("default")), none, none)


@query("""SELECT 'y' || page_id AS yt_id, CASE WHEN page_id % 3 = 0 THEN '{"yt_id":"y' || page_id || '","mode":"raw"}' ELSE '{"mode":"old"}' END AS payload FROM pages WHERE page_id % 4 <> 0 AND page_id % 6 <> 5""")
def choice_upsert(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select("page_id", F.concat(F.lit("y"), _s("page_id")).alias("yt_id"))
    old = p.where("page_id % 3 <> 0 or page_id % 2 = 0").select("yt_id", F.lit('{"mode":"old"}').alias("payload"))
    new = p.where("page_id % 3 = 0").select("yt_id", F.lit('{"mode":"raw"}').alias("payload"))
    gone = p.where("page_id % 4 = 0 or page_id % 6 = 5").select("yt_id").unionByName(spark.createDataFrame([("unknown",)], "yt_id string"))
    return C.delete_choices(C.write_choices(old, new), gone)


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN page_id / 10.0 WHEN page_id % 3 = 0 THEN page_id / 8.0 END::DOUBLE AS seconds FROM pages")
def media_duration(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("page_id")
    return table(spark, sf, "pages").select("page_id", I.media_seconds(F.when(n % 2 == 0, n / 10.0), n, F.when(n % 3 == 0, 8.0).otherwise(0.0)).alias("seconds"))


@query("SELECT p_partkey, trim(p_name) AS plain, 'a-b' || p_partkey || '--c' AS windows FROM part")
def safe_names(spark: SparkSession, sf: str) -> DataFrame:
    odd = F.concat(F.lit(" \u3000a:b"), _s("p_partkey"), F.lit('?"c\u00a0\n'))
    return table(spark, sf, "part").select("p_partkey", T.safe_name(F.concat(F.lit("\t"), "p_name", F.lit(" \u2003"))).alias("plain"), T.safe_name(odd, windows=True).alias("windows"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'string' ELSE 'int' END AS kind, CASE WHEN event_id % 2 = 0 THEN event_id::VARCHAR END AS as_string, CASE WHEN event_id % 2 = 1 THEN event_id END AS as_long FROM events")
def text_settings(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", T.setting(_s("event_id"), F.col("event_id") % 2 == 0).alias("s"))
    return e.select("event_id", "s.kind", "s.as_string", "s.as_long")


# nested records


@query("SELECT p_partkey AS query, x.pos::BIGINT AS pos, CASE x.pos WHEN 0 THEN p_name ELSE p_name || ' (Live)' END AS name, p_brand AS artist, CASE WHEN x.pos = 1 THEN 'm' || p_size END AS mbid FROM part, (VALUES (0), (1)) x(pos) WHERE p_partkey % 4 < 2")
def track_search(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").withColumn("query", F.col("p_partkey"))
    none = F.lit(None).cast("string")
    track = lambda name, mbid: F.struct(name.alias("name"), F.col("p_brand").alias("artist"), mbid.alias("mbid"), F.lit(3).alias("listeners"))
    tracks = F.array(track(F.col("p_name"), none), track(F.concat("p_name", F.lit(" (Live)")), F.concat(F.lit("m"), _s("p_size"))))
    good = F.to_json(F.struct(F.struct(F.struct(tracks.alias("track")).alias("trackmatches"), F.lit("9").alias("total")).alias("results")))
    k = F.col("p_partkey") % 4
    body = F.when(k < 2, good).when(k == 2, F.lit('{"error": 29, "message": "later", "results": {}}')).otherwise(F.lit("<html>no json"))
    return I.track_rows(p.select("query", body.alias("body")), ["query"], "body").withColumn("pos", F.col("pos").cast("bigint"))


@query("""SELECT c_custkey AS query, x.pos::BIGINT AS pos, c_custkey * 10 + x.pos AS id, c_name AS "trackName", CASE WHEN x.pos = 0 THEN c_mktsegment END AS "artistName", NULL::VARCHAR AS "albumName", (c_custkey % 300)::DOUBLE AS duration
FROM customer, (VALUES (0), (1)) x(pos) WHERE c_custkey % 3 = 0""")
def caption_search(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    record = lambda pos, artist: F.struct((F.col("c_custkey") * 10 + pos).alias("id"), F.col("c_name").alias("trackName"), artist.alias("artistName"), (F.col("c_custkey") % 300).alias("duration"), F.lit("[00:01.00] x").alias("syncedLyrics"))
    good = F.to_json(F.array(record(0, F.col("c_mktsegment")), record(1, F.lit(None).cast("string"))))
    body = F.when(F.col("c_custkey") % 3 == 0, good).when(F.col("c_custkey") % 3 == 1, F.lit('{"code": 500}'))
    rows = I.caption_records(c.select(F.col("c_custkey").alias("query"), body.alias("body")), ["query"], "body")
    return rows.select("query", F.col("pos").cast("bigint").alias("pos"), I.provenance(F.col("record")).alias("r")).select("query", "pos", "r.*")


@query("""WITH h AS (SELECT 'song ' || o_custkey || CASE WHEN o_custkey % 5 = 0 THEN ' on Site' ELSE '' END AS query, o_custkey, o_orderkey AS id, o_orderpriority AS title,
CASE WHEN o_orderkey % 7 = 0 THEN 'Site Covers' WHEN o_orderkey % 11 = 0 THEN 'A Translation' WHEN o_orderkey % 2 = 0 THEN 'Ann' ELSE 'Bo' END AS artist, o_orderkey % 6 <> 0 AS song FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY id) - 1 AS rank FROM h WHERE song AND NOT contains(lower(artist), CASE WHEN o_custkey % 5 = 0 THEN 'translation' ELSE 'site' END))
SELECT query, rank, id, title, artist FROM k WHERE rank < 8 AND o_custkey % 9 <> 4""")
def lyric_search(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    n = F.col("o_orderkey")
    artist = F.when(n % 7 == 0, "Site Covers").when(n % 11 == 0, "A Translation").when(n % 2 == 0, "Ann").otherwise("Bo")
    result = F.struct(n.alias("id"), F.when(F.col("o_custkey") % 9 != 4, F.col("o_orderpriority")).alias("title"), F.when(n % 2 == 0, artist).alias("artist_names"), F.struct(artist.alias("name")).alias("primary_artist"))
    hit = F.struct(n.alias("at"), F.struct(F.when(n % 6 != 0, "song").otherwise("album").alias("type"), result.alias("result")).alias("hit"))
    g = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(hit))["hit"].alias("hits"))
    name = F.concat(F.lit("song "), _s("o_custkey"), F.when(F.col("o_custkey") % 5 == 0, " on Site").otherwise(""))
    rows = g.select(name.alias("query"), F.to_json(F.struct(F.array(F.struct(F.col("hits").alias("hits"))).alias("sections"))).alias("body"))
    return I.song_hits(rows, "query", "body", "site").withColumn("rank", F.col("rank").cast("bigint"))


@query("""SELECT conv_id, {'line_id': 0, 'start': 0.0::DOUBLE, 'end': max(turn)::DOUBLE, 'n_words': count(*)}.n_words AS n_words, 0 AS line_id, 0.0::DOUBLE AS start, max(turn)::DOUBLE AS "end" FROM conversations GROUP BY 1""")
def line_timings(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list("role").alias("ws"), F.max("turn").cast("double").alias("last"))
    o = F.struct(F.lit(None).cast("int").alias("line_id"), F.lit(0.0).alias("start"), F.col("last").alias("end"), F.col("ws").alias("words"))
    return g.select("conv_id", F.inline(R.line_timings(F.array(o)))).withColumn("n_words", F.col("n_words").cast("bigint"))


@query("""SELECT conv_id, line_id, start, "end" FROM (SELECT conv_id, turn::BIGINT AS line_id, (turn * 4)::DOUBLE AS start, (turn * 4 + 3)::DOUBLE AS "end" FROM conversations WHERE turn % 2 = 0 AND conv_id % 3 <> 0)""")
def cue_spans(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("turn")
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(t.alias("turn"), (t * 4).cast("double").alias("start"), (t * 4 + 3).cast("double").alias("end")))).alias("cues"))
    even = F.filter(F.transform("cues", lambda x, i: F.struct(x["turn"].alias("line_id"), i.alias("cue"))), lambda p: (p["line_id"] % 2 == 0) & (F.col("conv_id") % 3 != 0))
    return c.select("conv_id", F.inline(S.cue_spans(even, F.col("cues"))))


# queue views


def _queue(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id")
    return table(spark, sf, "events").select((n % 20).alias("room"), n.alias("position"), _s("user_id").alias("user"), F.concat(F.lit("song"), _s(n % 997)).alias("file"), (n % 3 == 0).alias("paused"))


@query("SELECT room, position, rank, user, file, paused FROM (SELECT event_id % 20 AS room, event_id AS position, user_id::VARCHAR AS user, 'song' || event_id % 997 AS file, false AS paused, row_number() OVER (PARTITION BY event_id % 20 ORDER BY event_id) - 1 AS rank FROM events WHERE event_id % 3 <> 0) WHERE rank < 5")
def queue_preview(spark: SparkSession, sf: str) -> DataFrame:
    return Q.preview(_queue(spark, sf)).withColumn("rank", F.col("rank").cast("bigint"))


@query("""WITH q AS (SELECT event_id % 20 AS room, 'song' || event_id % 997 AS file, min(event_id) AS index, arg_min(user_id, event_id) AS owner FROM events GROUP BY 1, 2),
r AS (SELECT event_id, event_id % 21 AS room, 'song' || event_id % 997 AS file, user_id FROM events) SELECT event_id, coalesce(index, -1) AS index, coalesce(owner = user_id, false) AS owned FROM r LEFT JOIN q ON r.room = q.room AND r.file = q.file""")
def queue_owner(spark: SparkSession, sf: str) -> DataFrame:
    q = _queue(spark, sf)
    r = q.select(F.col("position").alias("event_id"), (F.col("position") % 21).alias("room"), "user", "file")
    return Q.owned(q, Q.first_place(q, r)).select("event_id", "index", "owned")


@query("""SELECT event_id % 20 AS room, '[' || string_agg('{"user":"' || user_id || '","file":"song' || event_id % 997 || '","paused":' || (event_id % 3 = 0)::VARCHAR || '}', ',' ORDER BY event_id) || ']' AS body FROM events GROUP BY 1""")
def queue_read_model(spark: SparkSession, sf: str) -> DataFrame:
    return Q.read_model(_queue(spark, sf), ["user", "file", "paused"], "position")


@query("SELECT page_id, CASE WHEN page_id % 4 = 0 AND page_id % 2 = 0 THEN 'Download starting: t' ELSE 'Download queued (#' || (page_id % 4 + page_id % 2 + 1) || '): t' END AS message FROM pages")
def position_message(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("page_id")
    return table(spark, sf, "pages").select("page_id", Q.position_message(n % 4, n % 2 == 1, F.lit("t")).alias("message"))


@query("SELECT doc_id FROM documents WHERE doc_id % 10 <> 0 ORDER BY md5('7:' || doc_id), doc_id LIMIT 25")
def random_sample(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id")
    return B.sample(d, d.where("doc_id % 10 = 0"), 25, "doc_id", seed=7)


# rules of names and words


@query("""SELECT p_partkey, p_partkey % 2 = 0 AS has_separator, CASE WHEN p_partkey % 3 = 0 THEN p_brand || ' & Bo' END AS kept, p_partkey % 4 <> 3 AS similar FROM part""")
def name_rules(spark: SparkSession, sf: str) -> DataFrame:
    k, brand = F.col("p_partkey"), F.col("p_brand")
    name = F.concat("p_name", F.when(k % 2 == 0, " - x").otherwise("-x"))
    credit = F.concat(brand, F.when(k % 3 == 0, " & Bo").otherwise(""), F.lit(" - Song"))
    other = F.when(k % 4 == 0, brand).when(k % 4 == 1, F.concat(brand, F.lit("!"))).when(k % 4 == 2, F.substring(brand, 1, 3)).otherwise("")
    found = F.when(k % 3 == 0, brand).otherwise("Somebody")
    return table(spark, sf, "part").select("p_partkey", T.has_separator(name).alias("has_separator"), M.kept_artist(credit, found).alias("kept"), T.similar(brand, other).alias("similar"))


@query("""SELECT event_id, CASE event_id % 8 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN true WHEN 4 THEN true ELSE false END AS same, CASE WHEN event_id % 8 IN (1, 3, 5) THEN 'i am' WHEN event_id % 8 = 4 THEN 'are not' END AS expanded FROM events""")
def word_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Equal; a contraction and a word of it, both ways; two contractions of the same; and what is none of these."""
    k = F.col("event_id") % 8
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (k + 1).cast("int"))
    a, b = pick("song", "im", "am", "im", "arent", "im", "song", "x"), pick("song", "am", "im", "i", "aint", "are", "songs", "im")
    return table(spark, sf, "events").select("event_id", T.same_word(a, b).alias("same"), T.expand(a).alias("expanded"))


@query("SELECT page_id, CASE WHEN page_id % 3 < 2 THEN 'g' || page_id END AS genius_id, CASE WHEN page_id % 3 = 1 THEN 'raw' END AS mode FROM pages")
def choice_read(spark: SparkSession, sf: str) -> DataFrame:
    k, n = F.col("page_id") % 3, F.col("page_id").cast("string")
    body = F.when(k == 0, F.concat(F.lit('{"genius_id": "g'), n, F.lit('", "more": 1}'))).when(k == 1, F.concat(F.lit('{"mode":"raw","genius_id":"g'), n, F.lit('"}'))).otherwise("{broken")
    return table(spark, sf, "pages").select("page_id", I.choice(body).alias("c")).select("page_id", "c.*")


@query("""SELECT conv_id, turn, 0 AS line_no, 'Hey ' || role AS text, 'Hey ' || role AS align_text FROM conversations WHERE turn % 2 = 0 UNION ALL SELECT conv_id, turn, 1, role || ' (oh)', role || ' oh' FROM conversations WHERE turn % 2 = 1
UNION ALL SELECT conv_id, turn, 0, 'Hey', 'Hey' FROM conversations WHERE turn % 2 = 1""")
def lyrics_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    srt = F.concat(F.lit("1\n00:00:01,000 --> 00:00:02,000\n<i>Hey "), "role", F.lit("</i> (oh)\n"))
    plain = F.concat(F.lit("[Chorus]\nHey\n\n"), "role", F.lit(" (oh)\n---"))
    even = F.col("turn") % 2 == 0
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.when(even, "a/b.SRT").otherwise("a/b.txt").alias("path"), F.when(even, srt).otherwise(plain).alias("text"))
    return I.lyrics(c, ["conv_id", "turn"], "path", "text")


@query("""SELECT 'lib/s' || page_id || '.mp4' AS path, kind, CASE WHEN kind = 'vocal' AND page_id % 4 = 0 THEN 'lib/vocal/s' || page_id || '---vocal.m4a' WHEN kind = 'vocal' THEN 'lib/vocal/s' || page_id || '---vocal.M4A' WHEN kind = 'karaoke' THEN 'lib/karaoke/s' || page_id || '.ass' END AS companion
FROM pages, (VALUES ('vocal', 2), ('karaoke', 3)) x(kind, m) WHERE page_id % m = 0""")
def companion_lookup(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    made = lambda where, form: p.where(where).select(F.format_string(form, "page_id").alias("path"))
    files = made("page_id % 4 = 0", "lib/vocal/s%d---vocal.m4a").unionByName(made("page_id % 2 = 0", "lib/vocal/s%d---vocal.M4A")).unionByName(made("page_id % 3 = 0", "lib/karaoke/s%d.ass"))
    return C.companion_files(p.select(F.format_string("lib/s%d.mp4", "page_id").alias("file_path")), files)


@query("SELECT event_id % 20 AS room, user_id::VARCHAR AS user, bool_or(event_id % 3 = 0) AS any_paused, bool_and(event_id % 3 = 0) AS all_paused FROM events GROUP BY 1, 2")
def queue_paused(spark: SparkSession, sf: str) -> DataFrame:
    return Q.paused_of(_queue(spark, sf))


# spans and the words around them


@query("""WITH s AS (SELECT user_id, min(event_id)::DOUBLE AS t0, max(event_id) / 2.0::DOUBLE AS t1 FROM events GROUP BY 1) SELECT e.user_id, event_id FROM events e JOIN s ON s.user_id = e.user_id AND event_id >= t0 - 2 AND event_id <= t1 + 2""")
def padded_words(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("start", F.col("event_id").cast("double"))
    s = e.groupBy("user_id").agg(F.min("start").alias("t0"), (F.max("start") / 2.0).alias("t1"))
    return S.words_around(e, s, "user_id").select("user_id", "event_id")


@query("""WITH g AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY 1), s AS (SELECT conv_id, x AS after, least(x + 4, last + 1) AS before FROM g, LATERAL (SELECT unnest(range(-1, last, 4)) AS x))
SELECT s.conv_id AS song, after, before, count(*) AS n_suspects FROM s JOIN conversations c ON c.conv_id = s.conv_id AND turn > after AND turn < before AND turn % 5 = 2 GROUP BY 1, 2, 3""")
def suspect_spans(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    last = c.groupBy(F.col("conv_id").alias("song")).agg(F.max("turn").alias("last"))
    spans = last.select("song", F.explode(F.sequence(F.lit(-1).cast("bigint"), F.greatest(F.col("last") - 1, F.lit(-1)), F.lit(4).cast("bigint"))).alias("after"), "last").where("after < last").select("song", "after", F.least(F.col("after") + 4, F.col("last") + 1).alias("before"))
    return S.spans_to_repair(spans, c.where("turn % 5 = 2").select(F.col("conv_id").alias("song"), F.col("turn").alias("line_id")), "song")

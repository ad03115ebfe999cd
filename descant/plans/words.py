"""Text function queries over names, urls and texts of the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import matching as M
from ..sources import readers as R
from .base import dealt, query, table


def _sql_collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def _sql_remove(x: str, *patterns: str) -> str:
    for p in patterns:
        x = f"regexp_replace({x}, '{p.replace(chr(39), chr(39) * 2)}', '', 'g')"
    return x


_DASHED = "'music/' || p_name || CASE p_partkey % 3 WHEN 0 THEN '---' || lpad(p_partkey::VARCHAR, 11, 'k') WHEN 1 THEN ' [' || lpad(p_partkey::VARCHAR, 11, 'k') || ']' ELSE '' END || '.MP4'"


def _dashed() -> F.Column:
    k, name = F.col("p_partkey") % 3, F.lpad(F.col("p_partkey").cast("string"), 11, "k")
    return F.concat(F.lit("music/"), "p_name", F.when(k == 0, F.concat(F.lit("---"), name)).when(k == 1, F.concat(F.lit(" ["), name, F.lit("]"))).otherwise(""), F.lit(".MP4"))


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN lpad(p_partkey::VARCHAR, 11, 'k') END AS video_id, p_partkey % 3 < 2 AS has_id, 'mp4' AS format, replace(replace({_DASHED}, 'music/', ''), '.MP4', '') AS stem FROM part")
def id_extract(spark: SparkSession, sf: str) -> DataFrame:
    p = _dashed()
    return table(spark, sf, "part").select("p_partkey", T.video_id(p).alias("video_id"), (T.id_suffix(p) != "").alias("has_id"), T.detect_format(p).alias("format"), T.stem(p).alias("stem"))


@query("SELECT page_id, lower(regexp_extract(regexp_extract(url, '[^/]*$'), '\\.([^.]*)$', 1)) AS format, regexp_extract(url, '[^/]*$') AS base, regexp_replace(url, '/[^/]*$', '') AS dir FROM pages")
def format_detect(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", T.detect_format(u).alias("format"), T.basename(u).alias("base"), T.dirname(u).alias("dir"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'x' || page_id WHEN 1 THEN 'y' || page_id END AS video, page_id || '' AS cut FROM pages")
def id_from_url(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("page_id").cast("string")
    k = F.col("page_id") % 4
    url = F.when(k == 0, F.concat(F.lit("https://e.com/watch?v=x"), n, F.lit("?t=1"))).when(k == 1, F.concat(F.lit("https://yu.be/y"), n)).when(k == 2, F.concat(F.lit("https://m.e.com/?v="), n)).otherwise(F.lit("https://e.com/"))
    return table(spark, sf, "pages").select("page_id", T.id_from_url(url).alias("video"), T.before_playlist(F.concat(n, F.lit("&list=abc"))).alias("cut"))


_TITLE = "text || CASE doc_id % 4 WHEN 0 THEN ' (Official Video) HD' WHEN 1 THEN '_Karaoke Version [HQ]' WHEN 2 THEN ' feat. Ann 🎤' ELSE ' live by Bo' END"


def _title() -> F.Column:
    k = F.col("doc_id") % 4
    return F.concat(F.col("text"), F.when(k == 0, " (Official Video) HD").when(k == 1, "_Karaoke Version [HQ]").when(k == 2, " feat. Ann 🎤").otherwise(" live by Bo"))


# what the rules take away, written out for the other engine (fixed values)
_PICTURES = r"[\x{1F1E0}-\x{1F1FF}\x{1F300}-\x{1F5FF}\x{1F600}-\x{1F64F}\x{1F680}-\x{1F7FF}\x{1F800}-\x{1FAFF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}]+"
_EMPTY_WORDS = r"(?i)\b(?:official|music|video|audio|lyrics?|karaoke|karaokê|complete|completo|ao vivo|live|remix|version)\b|\bfeat\.?\b|\bft\.?\b|\b(?:remaster|as popularized by|karafun|instrumental|minus one|minusone|made famous by|by|hd|hq|coversph|singkaraoke|in the style of|no lead vocal|with lyrics|cc)\b"
_BRACKETS = (r"\([^)]*\)", r"\[[^\]]*\]")
_NAME = f"replace({_sql_remove(_TITLE, _PICTURES)}, '_', ' ')"


@query(f"SELECT doc_id, {_sql_collapse(_sql_remove(_NAME, *_BRACKETS, _EMPTY_WORDS))} AS cleaned FROM documents")
def clean_query(spark: SparkSession, sf: str) -> DataFrame:
    return dealt(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", T.clean_query(_title()).alias("cleaned"))


@query(f"SELECT doc_id, {_sql_collapse(_sql_remove(_NAME, _EMPTY_WORDS))} AS cleaned FROM documents")
def clean_lyric_query(spark: SparkSession, sf: str) -> DataFrame:
    return dealt(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", T.clean_lyric_query(_title()).alias("cleaned"))


_END_WORDS = r"(?i)(\s*\b(official\s+video|official\s+music\s+video|lyrics|lyric|hd|hq|instrumental|with\s+lyrics|no\s+lead\s+vocal|cc)\b[\s.!]*)+$"
_ENDLESS = _sql_remove(_NAME, r"\s*\([^)]*\)\s*$", r"\s*\[[^\]]*\]\s*$", r"(?i)\s*\bkaraoke\b.*$", _END_WORDS)
_DASHES = _sql_collapse(f"regexp_replace({_ENDLESS}, '\\s*[–—]\\s*', ' - ', 'g')")


@query(f"SELECT doc_id, {_sql_remove(_DASHES, r'\s*-\s*$')} AS name FROM documents")
def tidy(spark: SparkSession, sf: str) -> DataFrame:
    return dealt(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", T.tidy(_title()).alias("name"))


@query("SELECT p_partkey, p_name || ' - Ann' || p_size AS name FROM part")
def tidy_credit(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat("p_name", F.lit(" (In the Style of Ann"), F.col("p_size").cast("string"), F.lit(") Karaoke Version HD"))
    return table(spark, sf, "part").select("p_partkey", T.tidy(raw).alias("name"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN p_name || ' (Live)' ELSE p_name || ' (Live) HD' END AS name FROM part")
def display_name(spark: SparkSession, sf: str) -> DataFrame:
    """Names with an id are tidied, others stand as they are."""
    end = r"(---.*|\s\[.*|\.MP4)$"
    marked = F.concat(F.regexp_replace(_dashed(), end, ""), F.lit(" (Live) HD"), F.regexp_extract(_dashed(), end, 1))
    return table(spark, sf, "part").select("p_partkey", T.display_name(marked).alias("name"))


_LINE = "replace(text, chr(10), ' / ')"
_LYRIC = _sql_collapse("translate(" + _sql_remove(f"replace('<i>' || {_LINE} || '</i> [x] ♪ (oh) “q”', chr(10), ' ')", "<[^>]+>", r"\[[^\]]*\]", "[♪♫♬♩]") + ", '‘’“”', '''''\"\"')")


def _line() -> F.Column:
    return F.concat(F.lit("<i>"), F.replace(F.col("text"), F.lit("\n"), F.lit(" / ")), F.lit("</i> [x] ♪ (oh) “q”"))


@query(f"SELECT doc_id, {_LYRIC} AS line, {_sql_collapse(f'''translate({_LYRIC}, '()', '')''')} AS align_text FROM documents")
def lyric_line(spark: SparkSession, sf: str) -> DataFrame:
    both = T.let(T.lyric_line(_line()), lambda x: F.struct(x.alias("line"), T.align_text(x).alias("align_text")))
    return dealt(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.inline(F.array(both)))


@query(rf"SELECT doc_id, CASE WHEN regexp_matches(x, '\p{{L}}') THEN x ELSE '' END AS line FROM (SELECT doc_id, {_sql_collapse(_sql_remove(_LYRIC, r'\([^)]*\)'))} AS x FROM documents)")
def srt_line(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.caption_line(_line()).alias("line"))


@query(f"""SELECT doc_id, {_sql_collapse("regexp_replace(strip_accents(" + _sql_remove(f"regexp_replace(lower({_LINE}), '<[^>]+>', ' ', 'g')", "[''‘’`´]") + "), '[^a-z0-9 ]+', ' ', 'g')")} AS plain FROM documents""".replace("[''''", "[''"))
def normalize_line(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.plain_line(F.replace(F.col("text"), F.lit("\n"), F.lit(" / "))).alias("plain"))


@query("SELECT doc_id, strip_accents(text) AS folded FROM documents")
def remove_accents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.strip_accents("text").alias("folded"))


@query(rf"SELECT p_partkey, {_sql_collapse(r'''regexp_replace(lower(p_name || '._x-''y'), '[._\-'']', ' ', 'g')''')} AS key, lower(p_name) || ' - x' AS name_key FROM part")
def compare_key(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", T.comparable(F.concat("p_name", F.lit("._x-'y"))).alias("key"), T.comparable_name(F.concat("p_name", F.lit(" — x"))).alias("name_key"))


@query("SELECT p_partkey, lower(p_brand) AS a, CASE WHEN p_partkey % 2 = 0 THEN lower(p_name) ELSE '' END AS b FROM part")
def query_parts(spark: SparkSession, sf: str) -> DataFrame:
    brand = F.regexp_replace("p_brand", "#", "")
    q = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_brand", F.lit(" | "), "p_name")).otherwise(F.col("p_brand"))
    return table(spark, sf, "part").withColumn("ok", brand).select("p_partkey", T.query_parts(q)["a"].alias("a"), T.query_parts(q)["b"].alias("b"))


@query("SELECT p_partkey, p_name AS track FROM part")
def strip_artist(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Big.Ann - "), "p_name")).otherwise(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", T.without_artist(name, F.lit("big ann")).alias("track"))


@query("SELECT p_partkey, p_name AS key FROM part")
def clean_key(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", T.clean_key(F.concat("p_name", F.lit(" (Remastered) [Live] (Ft. Bo)"))).alias("key"))


@query("""SELECT event_id, (value * 10)::BIGINT // 60 || ':' || lpad(((value * 10)::BIGINT % 60)::VARCHAR, 2, '0') AS clock FROM (SELECT event_id, floor(value) / 10 AS value FROM events)""")
def duration_clock(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", T.clock(F.floor("value")).alias("clock"))


_S = "value * 3.7"


@query(f"""SELECT event_id, floor({_S} / 3600)::BIGINT || ':' || lpad(floor(({_S} % 3600) / 60)::BIGINT::VARCHAR, 2, '0') || ':' || lpad(floor({_S} % 60)::BIGINT::VARCHAR, 2, '0') || '.' || lpad(floor(({_S} % 1) * 100)::BIGINT::VARCHAR, 2, '0') AS stamp FROM events WHERE value >= 0""")
def ass_time(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").where("value >= 0").select("event_id", T.ass_time(F.col("value") * 3.7).alias("stamp"))


@query("""SELECT event_id, CASE WHEN n > 0 THEN lpad((n // 60)::VARCHAR, 2, '0') || ':' || lpad((n % 60)::VARCHAR, 2, '0') END AS tag, CASE WHEN n > 0 THEN n::DOUBLE END AS seconds FROM (SELECT event_id, round_even(value, 0)::BIGINT AS n FROM events)""")
def length_tag(spark: SparkSession, sf: str) -> DataFrame:
    tag = T.length_tag(F.col("value").cast("string"))
    return table(spark, sf, "events").select("event_id", tag.alias("tag"), T.length_seconds(tag).alias("seconds"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'bool' WHEN 1 THEN 'int' WHEN 2 THEN 'float' ELSE 'string' END AS kind, CASE WHEN event_id % 6 = 0 THEN true END AS as_bool, CASE WHEN event_id % 6 = 1 THEN -event_id END AS as_long,
CASE WHEN event_id % 6 = 2 THEN event_id + 0.5::DOUBLE END AS as_double, CASE event_id % 6 WHEN 3 THEN '1.2.3' WHEN 4 THEN event_type WHEN 5 THEN '' END AS as_string FROM events""")
def convert_settings(spark: SparkSession, sf: str) -> DataFrame:
    k, n = F.col("event_id") % 6, F.col("event_id").cast("string")
    raw = F.when(k == 0, "Yes").when(k == 1, F.concat(F.lit("-"), n)).when(k == 2, F.concat(n, F.lit(".5"))).when(k == 3, "1.2.3").when(k == 4, F.col("event_type")).otherwise("")
    return table(spark, sf, "events").where("event_id > 0 or event_id % 6 <> 1").select("event_id", T.setting(raw).alias("s")).select("event_id", "s.*")


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'vocal' WHEN 1 THEN 'instrumental' WHEN 2 THEN 'instrumental' WHEN 3 THEN 'vocal' END AS role FROM part")
def stem_role(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*map(F.lit, ("x_(Vocals)_(Noreverb).wav", "x_(Vocals)_(Reverb).wav", "x_No Vocals.wav", "x_(Vocals).wav", "x.wav")))
    return table(spark, sf, "part").select("p_partkey", T.stem_role(F.element_at(names, (F.col("p_partkey") % 5 + 1).cast("int"))).alias("role"))


@query("SELECT event_id, len(list_filter(json_keys(props), lambda k: starts_with(lower(k), 'en'))) > 0 AS english FROM events WHERE event_id % 2 = 1 UNION ALL SELECT event_id, event_id % 4 = 0 FROM events WHERE event_id % 2 = 0")
def captions_available(spark: SparkSession, sf: str) -> DataFrame:
    j = F.when(F.col("event_id") % 4 == 0, '{"EN-us": 1}').when(F.col("event_id") % 4 == 2, "{broken").otherwise(F.col("props"))
    return table(spark, sf, "events").select("event_id", T.has_english(j).alias("english"))


# sources in columns


@query(r"""WITH l AS (SELECT doc_id, i - 1 AS line_no, trim(x) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
k AS (SELECT doc_id, line_no, trim(regexp_replace(translate(regexp_replace(regexp_replace(regexp_replace(line, '<[^>]+>', '', 'g'), '\[[^\]]*\]', '', 'g'), '[♪♫♬♩]', '', 'g'), '‘’“”', '''''""'), '\s+', ' ', 'g')) AS text FROM l WHERE line <> '' AND NOT regexp_matches(line, '^\s*\[[^\]]*\]\s*$'))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS line_id, text, trim(regexp_replace(translate(text, '()', ''), '\s+', ' ', 'g')) AS align_text FROM k WHERE regexp_matches(text, '\p{L}')""")
def lyric_lines(spark: SparkSession, sf: str) -> DataFrame:
    found = R.lyric_rows(dealt(table(spark, sf, "documents").select("doc_id", "text")), ["doc_id"], "text")
    return found.withColumn("line_id", F.col("line_id").cast("bigint"))


@query("""WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
s AS (SELECT user_id, n * 2.5 AS start, event_type AS text FROM e UNION ALL SELECT user_id, 4000 + n * 1.0, event_type FROM e WHERE n % 3 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start) - 1 AS pos, lead(start) OVER (PARTITION BY user_id ORDER BY start) AS nxt FROM s)
SELECT user_id, pos, text, start::DOUBLE AS start, coalesce(nxt, start + 4.0)::DOUBLE AS "end" FROM p""")
def lrc_parse(spark: SparkSession, sf: str) -> DataFrame:
    out = R.stamped_rows(lrc_songs(spark, sf), ["user_id"], "text")
    return out.withColumn("pos", F.col("pos").cast("bigint"))


def lrc_songs(spark: SparkSession, sf: str) -> DataFrame:
    """A stamped song per user: their events, every third with a second stamp."""
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    stamp = lambda s: F.concat(F.lit("["), F.floor(s / 60).cast("string"), F.lit(":"), F.format_string("%05.2f", s % 60), F.lit("]"))
    line = F.concat(stamp(F.col("n") * F.lit(2.5)), F.when(F.col("n") % 3 == 0, stamp(F.lit(4000.0) + F.col("n"))).otherwise(""), F.lit(" "), F.col("event_type"))
    return table(spark, sf, "events").withColumn("n", n).groupBy("user_id").agg(F.concat(F.lit("[ti:x]\n[0:01.00]\nno stamp\n"), F.array_join(F.sort_array(F.collect_list(F.struct("n", line.alias("l"))))["l"], "\n")).alias("text"))


_CAPTION = _sql_collapse(_sql_remove(_sql_collapse("translate(" + _sql_remove("x", "<[^>]+>", r"\[[^\]]*\]", "[♪♫♬♩]") + ", '‘’“”', '''''\"\"')"), r"\([^)]*\)"))


@query(rf"""WITH l AS (SELECT doc_id, i, CASE WHEN i % 4 = 3 THEN '(' || translate(x, '()', '') || ')' ELSE '<i>' || x || '</i> ♪' END AS x FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents) WHERE trim(x, ' ') <> ''),
t AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS cue_no, i, {_CAPTION} AS text FROM l)
SELECT doc_id, cue_no, text, (i % 60) + 0.25::DOUBLE AS start, 3600 + (i % 60) + 0.5::DOUBLE AS "end" FROM t WHERE regexp_matches(text, '\p{{L}}')""")
def srt_parse(spark: SparkSession, sf: str) -> DataFrame:
    return R.caption_rows(srt_songs(spark, sf), ["doc_id"], "srt").withColumn("cue_no", F.col("cue_no").cast("bigint"))


def srt_songs(spark: SparkSession, sf: str) -> DataFrame:
    """Every line of a text as a caption of its own, every fourth in parentheses."""

    def cue(x: F.Column, i: F.Column) -> F.Column:
        aside = F.concat(F.lit("("), T.swap(x, "()", ""), F.lit(")"))
        body = F.when(i % 4 == 3, aside).otherwise(F.concat(F.lit("<i>"), x, F.lit("</i> ♪")))
        return F.when(F.trim(x) != "", F.concat((i + 1).cast("string"), F.lit("\n"), F.format_string("00:00:%02d,250 --> 01:00:%02d.500", i % 60, i % 60), F.lit("\n"), body))

    srt = F.array_join(F.array_compact(F.transform(F.split("text", "\n"), cue)), "\n\n")
    return dealt(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", srt.alias("srt"))


@query("SELECT c_custkey, c_name AS \"trackName\", c_mktsegment AS \"artistName\", NULL::VARCHAR AS \"albumName\", c_custkey AS id, (60 * (c_custkey % 7) + 5)::DOUBLE AS duration FROM customer")
def lrc_header(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("[ti:"), "c_name", F.lit("]\n[ar:"), "c_mktsegment", F.lit("]\n[length:"), F.format_string("%02d:05", F.col("c_custkey") % 7), F.lit("]\n[lrclib_id:"), F.col("c_custkey").cast("string"), F.lit("]\n[00:01.00] x"))
    return table(spark, sf, "customer").select("c_custkey", R.stamped_header(text).alias("h")).select("c_custkey", "h.*")


@query("SELECT p_name AS title, 'u' || p_partkey AS url, 'i' || p_partkey AS id, p_brand AS channel, CASE WHEN p_partkey % 2 = 0 THEN p_size // 60 || ':' || lpad((p_size % 60)::VARCHAR, 2, '0') ELSE '' END AS duration FROM part WHERE p_partkey % 5 <> 0")
def search_rows(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    full = F.struct(F.col("p_name").alias("title"), F.concat(F.lit("u"), k).alias("url"), F.concat(F.lit("i"), k).alias("id"), F.col("p_brand").alias("uploader"))
    line = F.when(k % 5 == 0, F.to_json(F.struct(F.col("p_name").alias("title")))).when(k % 2 == 0, F.regexp_replace(F.to_json(full), r"\}$", F.concat(F.lit(',"duration":'), F.col("p_size").cast("string"), F.lit(".9}")))).otherwise(F.regexp_replace(F.to_json(full), r"\}$", ',"duration":"live"}'))
    return R.search_rows(table(spark, sf, "part").select(line.alias("line")), "line")


@query("SELECT s_suppkey, s_suppkey % 3 <> 2 AS ok, CASE WHEN s_suppkey % 3 <> 2 THEN s_acctbal END AS input_i, CASE WHEN s_suppkey % 3 <> 2 THEN 'dynamic' END AS loudnorm_type FROM supplier")
def loudness_json(spark: SparkSession, sf: str) -> DataFrame:
    block = F.concat(F.lit('{\n"input_i" : "'), F.col("s_acctbal").cast("string"), F.lit('",\n"input_tp" : "-1.0",\n"input_lra" : "2",\n"input_thresh" : "-30",\n"normalization_type" : "dynamic",\n"target_offset" : "0.1"\n}'))
    log = F.when(F.col("s_suppkey") % 3 == 2, "no json here").otherwise(F.concat(F.lit("frame=1 {x}\nold\n{\n\"input_i\": \"9\"\n}\nsize=2\n"), block, F.lit("\n")))
    return table(spark, sf, "supplier").select("s_suppkey", R.loudness(log).alias("l")).select("s_suppkey", "l.ok", "l.input_i", "l.loudnorm_type")


@query("""WITH w AS (SELECT l_orderkey, l_linenumber, l_shipmode_ AS word, l_quantity AS start, l_quantity + 0.5 AS "end", CASE WHEN l_linenumber % 3 <> 0 THEN l_discount END AS probability FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode_ FROM lineitem))
SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, start, word, probability NULLS FIRST) - 1 AS pos, word, start, "end", probability FROM w WHERE probability IS NULL OR probability >= 0.05""")
def heard_words(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    word = F.struct(F.concat(F.lit(" "), "l_returnflag", "l_linestatus").alias("word"), F.col("l_quantity").alias("start"), (F.col("l_quantity") + 0.5).alias("end"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_discount")).alias("probability"))
    seg = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").alias("q"), word.alias("w")))).alias("ws")).select("l_orderkey", F.transform("ws", lambda x: F.struct(F.lit(" a ").alias("text"), F.array(x["w"]).alias("words"))).alias("segments"))
    out = R.heard_words(seg, ["l_orderkey"], least=0.05)
    return out.withColumn("pos", F.col("pos").cast("bigint"))


@query("""SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_returnflag, l_linestatus) - 1 AS line_no, l_linenumber || ' x' AS text, l_returnflag || ' ' || l_linestatus AS words, l_quantity AS start, l_quantity + 1.5 AS "end" FROM lineitem WHERE l_linenumber % 4 <> 3""")
def segment_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of an order as segments of two words; every fourth has none."""
    word = lambda c, t: F.struct(F.concat(F.lit(" "), c).alias("word"), (F.col("l_quantity") + t).alias("start"), (F.col("l_quantity") + t + 0.5).alias("end"))
    none = F.array().cast("array<struct<word:string,start:double,end:double>>")
    words = F.when(F.col("l_linenumber") % 4 != 3, F.array(word(F.col("l_returnflag"), 0.0), word(F.col("l_linestatus"), 1.0))).otherwise(none)
    seg = F.struct("l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", F.concat(F.lit(" "), F.col("l_linenumber").cast("string"), F.lit(" x ")).alias("text"), words.alias("words"))
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(seg)).alias("segments"))
    out = R.segment_lines(g, ["l_orderkey"])
    return out.select("l_orderkey", F.col("line_no").cast("bigint").alias("line_no"), "text", F.array_join(F.col("words.word"), " ").alias("words"), "start", "end")


# matching


_PAIRS = """SELECT o_orderkey AS q, l_linenumber AS place, l_quantity AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey"""


@query("SELECT l_orderkey, arg_max(l_linenumber, (l_quantity, -l_linenumber)) AS l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1")
def first_wins_argmax(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity")).withColumn("place", F.col("l_linenumber"))
    return M.first_best(li, ["l_orderkey"], [F.col("l_quantity")], "place").drop("place")


@query(r"""WITH q AS (SELECT p_partkey AS q, p_brand, p_name, lower(p_brand) AS who, p_partkey % 2 AS k FROM part),
c AS (SELECT q.*, place, CASE place WHEN 0 THEN p_name || ' (Live)' WHEN 1 THEN upper(p_name) WHEN 2 THEN p_name ELSE 'something else' END AS name, CASE WHEN q % 3 = 0 AND place = 2 THEN 'Someone' ELSE p_brand END AS artist FROM q, (VALUES (0), (1), (2), (3)) x(place)),
d AS (SELECT *, lower(name) AS track, lower(artist) AS art, CASE WHEN k = 0 THEN who ELSE lower(p_name) END AS a, CASE WHEN k = 0 THEN lower(p_name) ELSE who END AS b FROM c),
s AS (SELECT *, CASE WHEN a = track AND b = art OR b = track AND a = art THEN 100 WHEN a = track THEN 100 WHEN contains(track, a) THEN 50 WHEN b = track THEN 100 WHEN contains(track, b) THEN 50
  WHEN len(list_filter(string_split(a, ' '), lambda w: len(w) > 3 AND contains(track, w))) > 0 OR len(list_filter(string_split(b, ' '), lambda w: len(w) > 3 AND contains(track, w))) > 0 THEN 20 ELSE -1000 END
  + CASE WHEN name = upper(name) THEN -10 ELSE 0 END + CASE WHEN NOT contains(a, art) AND NOT contains(b, art) THEN -100 ELSE 0 END + CASE WHEN contains(track, art) THEN -50 ELSE 0 END + CASE WHEN contains(track, 'live') THEN -30 ELSE 0 END + CASE WHEN len(track) > 60 THEN -20 ELSE 0 END AS score FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, place) AS n, regexp_replace(name, '\s*\([^)]*\)', '', 'g') AS title FROM s)
SELECT q, place, score, CASE WHEN k = 0 THEN artist || ' - ' || title ELSE title || ' - ' || artist END AS corrected FROM r WHERE n = 1""")
def relevance(spark: SparkSession, sf: str) -> DataFrame:
    """Brand first in even rows, name first in odd ones; in every third the plain candidate has a strange artist."""
    even = F.col("p_partkey") % 2 == 0
    text = F.when(even, F.concat("p_brand", F.lit(" - "), "p_name")).otherwise(F.concat("p_name", F.lit(" - "), "p_brand"))
    c = table(spark, sf, "part").select(F.col("p_partkey").alias("q"), text.alias("query"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("place"), "p_name", "p_brand")
    name = F.when(F.col("place") == 0, F.concat("p_name", F.lit(" (Live)"))).when(F.col("place") == 1, F.upper("p_name")).when(F.col("place") == 2, F.col("p_name")).otherwise("something else")
    artist = F.when((F.col("q") % 3 == 0) & (F.col("place") == 2), "Someone").otherwise(F.col("p_brand"))
    cand = M.scored(c.withColumn("name", name).withColumn("artist", artist))
    best = M.first_best(cand.select("q", "query", "place", "name", "artist", "score"), ["q", "query"], [F.col("score")], "place")
    return best.select("q", "place", "score", M.corrected(F.col("query"), F.lit(None).cast("string"), F.col("name"), F.col("artist")).alias("corrected"))


@query("""SELECT user_id AS query, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank FROM events WHERE event_type <> 'view' AND event_id % 7 <> 0) WHERE rank <= 8""")
def hit_filter(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("query"), "event_id", F.col("event_id").alias("place"), F.when(F.col("event_type") == "view", "album").otherwise("song").alias("type"), F.when(F.col("event_id") % 7 == 0, "Site Covers").otherwise("Ann").alias("artist"))
    return M.hits(e, "site").select(F.col("query").cast("bigint").alias("query"), "event_id", F.col("rank").cast("bigint").alias("rank"))


@query("SELECT o_custkey AS song, arg_max(o_orderkey, ((o_orderkey % 3) / 4.0, -abs(o_totalprice - 100000.0), -o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def select_candidate(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("song"), "o_orderkey", F.col("o_orderkey").alias("place"), (F.col("o_orderkey") % 3).alias("mapped"), F.lit(4).alias("n_sheet"), F.col("o_totalprice").alias("duration"))
    return M.best_caption(o, F.lit(100000.0)).select("song", "o_orderkey")


@query(r"SELECT doc_id, pos, raw FROM (SELECT doc_id, w AS raw, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, string_split_regex(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS ws FROM documents)) WHERE regexp_matches(w, '[\p{L}\p{N}_]'))")
def line_tokens(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.songs import line_tokens as tokens

    return tokens(table(spark, sf, "documents"), ["doc_id"], "text").select("doc_id", F.col("pos").cast("bigint").alias("pos"), "raw")

"""Sources: file listings, stamped lyrics, captions, plain lyrics, search results, logs, recognised words.

Each reader has a form on columns (`*_rows`), for text that is in a table already, and one on paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as T
from .packs import read_packs

LAST_HOLD = 4.0


def files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(path, modificationTime, length); contents are not read."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    return listing.select("path", "modificationTime", "length")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole small files."""
    return spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def stamped_rows(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """Synced lyrics: a row (key, pos, text, start, end) for each leading [m:ss.xx] stamp of a line, by time;
    a line ends where the next one starts, the last holds LAST_HOLD seconds."""
    lines = rows.select(*key, F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("line_no", "line"))
    lead = F.regexp_extract("line", r"^((?:\[\d+:\d{2}(?:\.\d+)?\])*)", 1)
    body = F.trim(F.regexp_replace("line", r"^(?:\[\d+:\d{2}(?:\.\d+)?\])*", ""))
    found = lines.withColumn("body", body).where("body <> ''").select(*key, "line_no", "body", F.posexplode(F.regexp_extract_all(lead, F.lit(r"\[(\d+:\d{2}(?:\.\d+)?)\]"), 1)).alias("stamp_no", "stamp"))
    start = 60.0 * F.split("stamp", ":")[0].cast("double") + F.split("stamp", ":")[1].cast("double")
    cue = F.struct(start.alias("start"), "line_no", "stamp_no", F.col("body").alias("text"))
    # a song's cues are a bounded list: sorted where they are gathered
    song = found.groupBy(*key).agg(F.array_sort(F.collect_list(cue)).alias("cues"))
    # the end is found inside the list, so that no row carries it
    end = lambda c, i: F.coalesce(F.get("cues", i + 1)["start"], c["start"] + LAST_HOLD)
    timed = F.transform("cues", lambda c, i: F.struct(c["text"].alias("text"), c["start"].alias("start"), end(c, i).alias("end")))
    return song.select(*key, F.posexplode(timed).alias("pos", "c")).select(*key, "pos", "c.text", "c.start", "c.end")


def stamped_header(text: Column) -> Column:
    """Provenance of a stored caption file: struct (trackName, artistName, albumName, id, duration)."""
    tag = lambda n: F.nullif(F.regexp_extract(text, rf"(?m)^\s*\[{n}:(.*)\]\s*$", 1), F.lit(""))
    return F.struct(tag("ti").alias("trackName"), tag("ar").alias("artistName"), tag("al").alias("albumName"), tag("lrclib_id").try_cast("bigint").alias("id"), T.length_seconds(tag("length")).alias("duration"))


def _seconds(c: Column) -> Column:
    p = F.split(c, "[:,.]")
    return p[0].cast("double") * 3600 + p[1].cast("double") * 60 + p[2].cast("double") + p[3].cast("double") / 1000


def caption_rows(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """Captions: (key, cue_no, text, start, end) of the cues that hold a lyric once cleaned."""
    stamp = r"(\d+:\d{2}:\d{2}[,.]\d{1,3})"
    pattern = rf"(?s)^\s*\d*\s*\n?{stamp}\s*-->\s*{stamp}[^\n]*\n?(.*)$"
    # a cue is matched once: its parts stand between marks, and one without a match is what it was
    parts = lambda x: T.let(F.regexp_replace(x, pattern, "\x01$1\x01$2\x01$3"), lambda y: F.when(y != x, F.split(y, "\x01", 4)))
    cue = lambda p: F.struct(T.caption_line(p[3]).alias("text"), _seconds(p[1]).alias("start"), _seconds(p[2]).alias("end"))
    read = F.transform(F.split(F.regexp_replace(text, "\r\n", "\n"), r"\n\s*\n"), lambda x: T.let(parts(x), lambda p: F.when(p.isNotNull(), cue(p))))
    # a cue is cleaned once: the filter is behind the rows it makes
    return rows.select(*key, F.posexplode(read).alias("cue_no", "c")).where("c.text <> ''").select(*key, "cue_no", "c.text", "c.start", "c.end")


def lyric_rows(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """Plain lyrics: (key, line_id, text, align_text) of the lines that are lyrics, renumbered."""
    # each line is stripped and cleaned once
    cleaned = F.transform(F.transform(F.split(text, "\n"), T.strip), lambda x: F.struct(x.alias("line"), T.lyric_line(x).alias("text")))
    lines = F.filter(cleaned, lambda s: T.is_cleaned_lyric(s["line"], s["text"]))
    return rows.select(*key, F.posexplode(lines).alias("line_id", "l")).select(*key, "line_id", "l.text", T.align_text(F.col("l.text")).alias("align_text"))


def lyrics(rows: DataFrame, key: list[str], path: str, text: str) -> DataFrame:
    """Lyrics or captions, by the file's extension: (key, line_no, text, align_text)."""
    srt = T.detect_format(F.col(path)) == "srt"
    a = caption_rows(rows.where(srt), key, text).select(*key, F.col("cue_no").alias("line_no"), "text", T.align_text(F.col("text")).alias("align_text"))
    return a.unionByName(lyric_rows(rows.where(~srt), key, text).withColumnRenamed("line_id", "line_no"))


def track_rows(responses: DataFrame, key: list[str], body: str) -> DataFrame:
    """Track search answers: (key, pos, name, artist, mbid) of results.trackmatches.track; an answer with an
    error, or that is no JSON, has none."""
    kind = "error string, results struct<trackmatches:struct<track:array<struct<name:string,artist:string,mbid:string>>>>"
    j = responses.select(*key, F.from_json(body, kind).alias("j")).where("j.error is null")
    return j.select(*key, F.posexplode("j.results.trackmatches.track").alias("pos", "t")).select(*key, "pos", "t.name", "t.artist", "t.mbid")


CAPTION_RECORD = "struct<id:bigint,trackName:string,artistName:string,albumName:string,duration:double,syncedLyrics:string>"


def caption_records(responses: DataFrame, key: list[str], body: str) -> DataFrame:
    """Synced lyric answers: (key, pos, record) of a list of records; what is no list has none."""
    kept = responses.where(F.col(body).rlike(r"^\s*\["))
    return kept.select(*key, F.posexplode(F.from_json(body, f"array<{CAPTION_RECORD}>")).alias("pos", "record"))


def provenance(record: Column) -> Column:
    """What is known of a caption record besides its text; null fields stay."""
    return F.struct(*(record[n].alias(n) for n in ("id", "trackName", "artistName", "albumName", "duration")))


def song_hits(responses: DataFrame, query: str, body: str, site: str, otherwise: str = "translation", limit: int = 8) -> DataFrame:
    """Lyric search answers: (query, rank, id, title, artist) of the first section's songs, without those whose
    artist names the site (or `otherwise`, where the query names the site), `limit` at most. An answer
    with a hit among them that lacks id or title is broken and has none."""
    hit = "struct<type:string,result:struct<id:bigint,title:string,artist_names:string,primary_artist:struct<name:string>>>"
    found = F.get(F.from_json(body, f"sections array<struct<hits:array<{hit}>>>")["sections"], F.lit(0))["hits"]
    term = F.when(F.lower(query).contains(site), otherwise).otherwise(site)
    artist = lambda h: F.coalesce(F.nullif(h["result"]["artist_names"], F.lit("")), h["result"]["primary_artist"]["name"], F.lit(""))
    songs = F.filter(found, lambda h: (h["type"] == "song") & ~F.lower(artist(h)).contains(F.col("term")))
    first = F.slice(F.transform(songs, lambda h: F.struct(h["result"]["id"].alias("id"), h["result"]["title"].alias("title"), artist(h).alias("artist"))), 1, limit)
    rows = responses.withColumn("term", term).select(query, first.alias("hits"))
    whole = rows.where(~F.exists("hits", lambda h: h["id"].isNull() | h["title"].isNull()))
    return whole.select(query, F.posexplode("hits").alias("rank", "h")).select(query, "rank", "h.id", "h.title", "h.artist")


def media_seconds(probed: Column, frames: Column, rate: Column) -> Column:
    """A file's duration: what the probe said, else the frames of its header by their rate."""
    return F.coalesce(probed, F.when(rate > 0, frames / rate))


def bundle_lines(bundles: DataFrame, body: str) -> DataFrame:
    """bundles with `align_lines` of their JSON; null where it is broken or lacks them."""
    return bundles.withColumn("align_lines", F.from_json(body, "lyrics struct<align_lines:array<string>>")["lyrics"]["align_lines"])


def bundles(spark: SparkSession, path: str) -> DataFrame:
    """(stem, align_lines) of debug bundles as `render.write_bundles` stores them, many a file."""
    return bundle_lines(read_packs(spark, path).where("kind = 'bundle'"), "body").select("stem", "align_lines")


def bundle_files(spark: SparkSession, path: str) -> DataFrame:
    """The same of one JSON file a song."""
    return bundle_lines(texts(spark, path).select(T.stem(F.col("path")).alias("stem"), "text"), "text").drop("text")


def search_rows(lines: DataFrame, line: str) -> DataFrame:
    """Newline-delimited search results: (title, url, id, channel, duration); rows without title or url go.
    A duration counts if it is a number."""
    schema = "title string, url string, id string, channel string, uploader string, duration string"
    j = lines.where(F.length(line) > 2).select(F.from_json(line, schema).alias("j"), F.get_json_object(line, "$.duration").alias("d"), F.col(line).alias("raw")).where("j.title is not null and j.url is not null")
    number = F.when(~F.col("raw").rlike(r'"duration"\s*:\s*"'), F.col("d").try_cast("double"))
    channel = F.coalesce(F.nullif("j.channel", F.lit("")), F.nullif("j.uploader", F.lit("")), F.lit(""))
    return j.select("j.title", "j.url", "j.id", channel.alias("channel"), F.coalesce(T.clock(number), F.lit("")).alias("duration"))


LOUDNESS = "input_i input_tp input_lra input_thresh target_offset".split()


def loudness(log: Column) -> Column:
    """The last JSON block of a log as typed fields, plus `ok`: whether all are there."""
    block = F.regexp_extract(log, r"(?s)^(?:.*\n)?[ \t]*(\{(?:(?!\n[ \t]*\{).)*\})[^\n}]*\s*(?:\n[^}]*)?$", 1)
    j = F.from_json(block, ", ".join(f"{n} string" for n in [*LOUDNESS, "normalization_type"]))
    ok = j["normalization_type"].isNotNull()
    for n in LOUDNESS:
        ok = ok & j[n].try_cast("double").isNotNull()
    return F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), *(j[n].try_cast("double").alias(n) for n in LOUDNESS), j["normalization_type"].alias("loudnorm_type"))


def heard_words(segments: DataFrame, key: list[str], column: str = "segments", least: float = 0.0) -> DataFrame:
    """(key, pos, word, start, end, probability): words of nested segments; unlikely ones go, unknown stay."""
    words = F.filter(F.flatten(F.transform(column, lambda s: s["words"])), lambda w: w["probability"].isNull() | (w["probability"] >= least))
    return segments.select(*key, F.posexplode(words).alias("pos", "w")).select(*key, "pos", F.trim("w.word").alias("word"), "w.start", "w.end", F.round("w.probability", 4).alias("probability"))


def segment_lines(segments: DataFrame, key: list[str], column: str = "segments") -> DataFrame:
    """(key, line_no, text, words, start, end) of the segments that have words."""
    held = F.filter(column, lambda s: F.size(s["words"]) > 0)
    out = segments.select(*key, F.posexplode(held).alias("line_no", "s"))
    words = F.transform("s.words", lambda w: F.struct(F.trim(w["word"]).alias("word"), w["start"].alias("start"), w["end"].alias("end")))
    return out.select(*key, "line_no", F.trim("s.text").alias("text"), words.alias("words")).select("*", F.col("words")[0]["start"].alias("start"), F.try_element_at("words", F.lit(-1))["end"].alias("end"))


def choice(body: Column) -> Column:
    """A stored lyric choice: struct (genius_id, mode); broken JSON gives nulls."""
    return F.from_json(body, "genius_id string, mode string")


def choices(spark: SparkSession, path: str) -> DataFrame:
    """Sidecar files of lyric choices."""
    return texts(spark, path).select("path", choice(F.col("text")).alias("c")).select("path", "c.*")

"""Rendering timed lines: karaoke events, captions, stamped lyrics and debug bundles, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..sources.packs import write_packs

LEAD_IN, LEAD_OUT, MIN_CENTIS = 0.80, 0.20, 10


def _centis(seconds: Column) -> Column:
    return F.bround(seconds * 100, 0).cast("int")


def karaoke_text(words: Column, begin: Column) -> Column:
    """Sweep tags of the words; a silent tag where there is a gap before a word."""

    def one(w: Column, i: Column) -> Column:
        before = F.when(i == 0, begin).otherwise(F.try_element_at(words, F.greatest(i, F.lit(1)))["end"])
        gap, sweep = _centis(w["start"] - before), F.greatest(F.lit(MIN_CENTIS), _centis(w["end"] - w["start"]))
        return F.concat(F.when(gap > 0, F.concat(F.lit("{\\k"), gap.cast("string"), F.lit("}"))).otherwise(""), F.lit("{\\kf"), sweep.cast("string"), F.lit("}"), w["word"])

    return F.array_join(F.transform(words, one), " ")


def karaoke_event(words: Column) -> Column:
    """A dialogue line with its window padded around the words; null without words."""
    begin = F.greatest(F.lit(0.0), words[0]["start"] - LEAD_IN)
    end = F.try_element_at(words, F.lit(-1))["end"] + LEAD_OUT
    line = F.concat(F.lit("Dialogue: 0,"), T.ass_time(begin), F.lit(","), T.ass_time(end), F.lit(",Karaoke,,0,0,0,,"), karaoke_text(words, begin))
    return F.when(F.size(words) > 0, line)


def karaoke_script(lines: DataFrame, key: str, style: str = "Arial,72,&H00FFFFFF,&H000000FF,&H00000000,&H64000000,0,0,0,0,100,100,0,0,1,3,1,2,40,40,60,1") -> DataFrame:
    """(key, script): the whole file of a song, from lines (key, line_id, words)."""
    # the header of the file format (fixed values)
    head = (
        "[Script Info]\nTitle: Karaoke Subtitles\nScriptType: v4.00+\nPlayResX: 1920\nPlayResY: 1080\nTimer: 100.0000\n\n[V4+ Styles]\n"
        "Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding\n"
        f"Style: Karaoke,{style}\n\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n"
    )
    events = lines.select(key, F.struct("line_id", karaoke_event(F.col("words")).alias("event")).alias("e")).where("e.event is not null")
    gathered = events.groupBy(key).agg(F.array_sort(F.collect_list("e")).alias("es"))
    return gathered.select(key, F.concat(F.lit(head), F.array_join("es.event", "\n"), F.lit("\n")).alias("script"))


def srt_time(seconds: Column) -> Column:
    ms = F.bround(seconds * 1000, 0).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000).cast("long"), F.floor(ms / 60_000).cast("long") % 60, F.floor(ms / 1000).cast("long") % 60, ms % 1000)


def caption(number: Column, start: Column, end: Column, text: Column) -> Column:
    return F.concat(number.cast("string"), F.lit("\n"), srt_time(start), F.lit(" --> "), srt_time(end), F.lit("\n"), text, F.lit("\n\n"))


def captions(lines: DataFrame, key: str) -> DataFrame:
    """(key, srt) of lines (key, line_id, text, words, start, end); numbers count wordless lines too."""
    made = lines.where(F.size("words") > 0).select(key, F.struct("line_id", caption(F.col("line_id") + 1, F.col("start"), F.col("end"), F.col("text")).alias("c")).alias("e"))
    return made.groupBy(key).agg(F.array_sort(F.collect_list("e")).alias("es")).select(key, F.array_join("es.c", "").alias("srt"))


def stamped_lyrics(record: str) -> Column:
    """The text of a stored caption record: a header with what is known of it, then the synced lyrics."""
    r = F.col(record)
    tag = lambda name, value: F.when(F.coalesce(value.cast("string"), F.lit("")) != "", F.concat(F.lit(f"[{name}:"), F.regexp_replace(F.regexp_replace(value.cast("string"), "\n", " "), r"\]", ")"), F.lit("]\n")))
    parts = [tag("ti", r["trackName"]), tag("ar", r["artistName"]), tag("al", r["albumName"]), tag("length", T.length_tag(r["duration"])), tag("lrclib_id", r["id"])]
    return F.concat_ws("", *parts, r["syncedLyrics"])


def bundle(fields: dict[str, Column], version: int = 6) -> Column:
    """A debug bundle as JSON."""
    return F.to_json(F.struct(F.lit(version).alias("schema_version"), *(c.alias(n) for n, c in fields.items())))


def line_timings(placed: Column) -> Column:
    """What the placement said, for comparison with other timings: (line_id, start, end, n_words) per line."""
    return F.transform(placed, lambda o, k: F.struct(F.coalesce(o["line_id"], k).alias("line_id"), o["start"].alias("start"), o["end"].alias("end"), F.coalesce(F.size(o["words"]), F.lit(0)).alias("n_words")))


def write_bundles(bundles: DataFrame, path: str, mode: str = "overwrite") -> None:
    """bundles (stem, bundle as JSON) as song packs below path, which `sources.bundles` reads: many a file, and all
    of a job's or none."""
    write_packs(bundles.select("stem", F.lit("bundle").alias("kind"), F.col("bundle").alias("body")), path, mode)

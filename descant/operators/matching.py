"""Matching records: relevance of candidate tracks, and the best one per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as T


def _title_match(part: Column, track: Column) -> Column:
    return F.when(part == track, 100).when(track.contains(part), 50).otherwise(0)


def _word_match(part: Column, track: Column) -> Column:
    return F.when(F.exists(F.split(part, r"\s+"), lambda w: (F.length(w) > 3) & track.contains(w)), 20).otherwise(0)


def scored(rows: DataFrame, query: str = "query", name: str = "name", artist: str = "artist", mbid: str | None = None) -> DataFrame:
    """rows with `score`: how well a candidate (name, artist) fits its query; -1000 for what is unrelated."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    parts = T.query_parts(F.col(query))
    # folded texts are columns of their own: each is folded once, and lambdas may use them
    folded = rows.withColumns({"__a": T.strip_accents(parts["a"]), "__b": T.strip_accents(parts["b"]), "__track": T.strip_accents(F.lower(text(name))), "__who": T.strip_accents(F.lower(text(artist)))})
    ready = folded.withColumns({"__a": T.clean_query(F.col("__a")), "__b": T.clean_query(F.col("__b"))})
    score = _score(F.col("__a"), F.col("__b"), F.col("__track"), F.col("__who"), text(name), text(artist), F.lit("") if mbid is None else text(mbid))
    return ready.withColumn("score", score).drop("__a", "__b", "__track", "__who")


def _score(a: Column, b: Column, track: Column, who: Column, name: Column, artist: Column, mbid: Column) -> Column:
    low_name, low_artist = F.lower(name), F.lower(artist)
    two = b != ""
    ta, tb, wa, wb = _title_match(a, track), _title_match(b, track), _word_match(a, track), _word_match(b, track)
    both = two & (((a == track) & (b == who)) | ((b == track) & (a == who)))
    # the first rule that gives anything decides
    match = F.when(both, 100).when(ta > 0, ta).when(two & (tb > 0), tb).when(wa > 0, wa).when(two & (wb > 0), wb).otherwise(-1000)
    shouts = lambda c: (c == F.upper(c)) & (c != F.lower(c))
    loud = F.when(shouts(name) | shouts(artist), -10).otherwise(0)
    stranger = F.when(~a.contains(who) & ~b.contains(who), -100).otherwise(0)
    inside = F.when(low_name.contains(low_artist), -50).otherwise(0)
    marked = F.lit(False)
    for m in T.VERSION_MARKS:
        marked = marked | low_name.contains(m)
    return loud + match + stranger + inside + F.when(marked, -30).otherwise(0) + F.when(F.length(low_name) > 60, -20).otherwise(0) + F.when(mbid != "", 5).otherwise(0)


def first_best(rows: DataFrame, key: list[str], score: list[Column], place: str) -> DataFrame:
    """Per key the row with the largest score, the first by place among equals. An aggregate, so a hot key
    takes one row per task."""
    fields = [c for c in rows.columns if c not in key]
    best = F.max_by(F.struct(*fields), F.struct(*score, (-F.col(place)).alias("__first")))
    return rows.groupBy(*key).agg(best.alias("__best")).select(*key, "__best.*")


def artist_first(query: Column, artist: Column, title: Column) -> Column:
    """Whether the query puts the artist before the title."""
    norm = lambda c: T.strip_accents(T.clean_query(F.lower(F.trim(c))))
    parts = T.query_parts(query)
    a, b, who, what = norm(parts["a"]), norm(parts["b"]), norm(artist), norm(title)
    a_who, a_what, b_who, b_what = T.similar(a, who), T.similar(a, what), T.similar(b, who), T.similar(b, what)
    return F.when(parts["b"] == "", False).when(a_who & b_what, True).when(a_what & b_who, False).when(a_who & ~a_what, True).when(a_what & ~a_who, False).otherwise(b_what & ~b_who)


def kept_artist(original: Column, found: Column) -> Column:
    """The file's artist, if it credits several and the found one is among them, or differs in accents only."""
    parts = F.split(original, r"\s+[-|]\s+", 2)
    own = F.when(F.size(parts) == 2, F.trim(parts[0]))
    low, hit = F.lower(own), F.lower(found)
    many = (low.contains(" & ") | low.contains(" and ") | low.contains(", ")) & low.contains(hit) & (low != hit)
    return F.when(many | (T.strip_accents(low) == T.strip_accents(hit)), own)


def corrected(query: Column, original: Column, name: Column, artist: Column) -> Column:
    """The best candidate's title and artist in the order of the input."""
    title = T.without_artist(F.regexp_replace(name, r"\s*\([^)]*\)", ""), artist)
    who = F.coalesce(kept_artist(original, artist), artist)
    return F.when(artist_first(F.coalesce(original, query), artist, title), F.concat(who, F.lit(" - "), title)).otherwise(F.concat(title, F.lit(" - "), who))


def hits(rows: DataFrame, site: str, otherwise: str = "translation", query: str = "query", limit: int = 8) -> DataFrame:
    """Per query the first `limit` songs. Artists that name the site are left out, or those with
    `otherwise` if the query names the site itself. rows: (query, place, type, artist, ...)."""
    term = F.when(F.lower(query).contains(site), otherwise).otherwise(site)
    kept = rows.where((F.col("type") == "song") & ~F.lower("artist").contains(term))
    return kept.withColumn("rank", F.row_number().over(W.partitionBy(query).orderBy("place"))).where(F.col("rank") <= limit)


def best_caption(records: DataFrame, media_seconds: Column) -> DataFrame:
    """Per song the record whose lines map best to the sheet, then the nearest duration, then the first.
    records: (song, place, mapped, n_sheet, duration, ...)."""
    rate = F.when(F.col("n_sheet") > 0, F.col("mapped") / F.col("n_sheet")).otherwise(0.0)
    near = F.when(media_seconds.isNotNull(), -F.abs(F.coalesce("duration", F.lit(0.0)) - media_seconds)).otherwise(0.0)
    scored = records.withColumn("map_rate", rate).withColumn("near", near)
    return first_best(scored, ["song"], [F.col("map_rate"), F.col("near")], "place")

"""Browsing the library: filters, sort, pages, and enrichment after paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as T


def sort_key(name: Column) -> Column:
    return T.strip_accents(F.lower(name))


def search(songs: DataFrame, query: str, path: str) -> DataFrame:
    """Rows whose whole path contains the query, in lower case."""
    return songs.where(F.lower(path).contains(query.lower()))


def starts_with_letter(songs: DataFrame, letter: str, name: str) -> DataFrame:
    """Accents fold: the first base character decides. It is found among the leading characters up to the first ASCII
    one, so no whole text goes to Python."""
    head = F.regexp_extract(F.lower(name), r"(?s)^[^\x00-\x7F]*.?", 0)
    return songs.where(F.substring(T.strip_accents(head), 1, 1) == letter.lower())


def starts_with_number(songs: DataFrame, name: str) -> DataFrame:
    return songs.where(F.col(name).rlike(r"^\p{N}"))


def blocked(stem: Column, words: str) -> Column:
    """Any of the comma-separated words is in the name."""
    listed = [w.strip().lower() for w in words.split(",") if w.strip()]
    hit = F.lit(False)
    for w in listed:
        hit = hit | F.lower(stem).contains(w)
    return hit


def page(songs: DataFrame, order: list[Column], number: int, size: int = 100) -> DataFrame:
    """Page `number` (from 1) with display positions. Sorting stops at the page's end: a top-k, no full sort."""
    rows = songs.orderBy(*order).limit(number * size)
    place = F.row_number().over(W.orderBy(*order))
    return rows.withColumn("position", place).where(F.col("position") > (number - 1) * size)


def enrich(rows: DataFrame, states: DataFrame, jobs: DataFrame, active: object, key: str = "file_path") -> DataFrame:
    """Adds the stored state (default skipped), the last job's status and whether the row is active.
    jobs: (key, seq, status)."""
    last = jobs.groupBy(key).agg(F.max_by("status", "seq").alias("job_status"))
    out = rows.join(states.select(key, F.col("pipeline_state").alias("__s")), key, "left").join(last, key, "left")
    return out.withColumn("pipeline_state", F.coalesce("__s", F.lit("skipped"))).drop("__s").withColumn("is_active", F.coalesce(F.col(key) == F.lit(active), F.lit(False)))


def lookup(hits: DataFrame, library: DataFrame, video: str = "video_id", path: str = "file_path") -> DataFrame:
    """Search hits with the path that has their id, if any; of several the smallest."""
    ids = library.select(T.video_id(F.col(path)).alias(video), F.col(path).alias("local_path")).where(F.col(video).isNotNull()).groupBy(video).agg(F.min("local_path").alias("local_path"))
    return hits.join(ids, video, "left")


def unlike_names(songs: DataFrame, name: str, suggestion: str) -> DataFrame:
    """Rows whose suggestion differs once both are normalised; no suggestion is no difference."""
    return songs.where(F.col(suggestion).isNotNull() & (T.comparable_name(F.col(name)) != T.comparable_name(F.col(suggestion))))


def rename_page(songs: DataFrame, name: str, suggestion: str, order: str, start: int = 0, size: int = 10) -> DataFrame:
    """The next `size` rows from index `start` on with another suggestion; `order` is the row's index.
    resume is the index to go on from."""
    found = unlike_names(songs.where(F.col(order) >= start), name, suggestion).orderBy(order).limit(size)
    return found.withColumn("resume", F.max(order).over(W.partitionBy()) + 1)


def sample(songs: DataFrame, queued: DataFrame, k: int, key: str = "file_path", seed: int = 0) -> DataFrame:
    """k rows not in the queue, without replacement, by a seeded hash of the key."""
    return songs.join(queued.select(key), key, "left_anti").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key).limit(k)

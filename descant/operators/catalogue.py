"""The library catalogue: scan, diff against stored state, move detection, mass-delete guard, snapshots.

Mutations are functions from a snapshot to the next one; `publish` writes a snapshot to a folder of its own
and moves the pointer afterwards, so readers see all of a change or nothing of it (one writer).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import text as T
from ..schema import PIPELINE_STATES, SONGS

BREAKER = 0.5


def media_files(files: DataFrame, path: str = "path") -> DataFrame:
    """Rows of a file listing whose extension is a media format."""
    return files.where(T.is_media(F.col(path)))


def records(paths: DataFrame, path: str = "file_path") -> DataFrame:
    """Catalogue records of scanned paths."""
    p = F.col(path)
    return paths.select(p.alias("file_path"), T.video_id(p).alias("youtube_id"), T.detect_format(p).alias("format"), F.lit("skipped").alias("pipeline_state"))


def find_by_id(files: DataFrame, video_id: str, path: str = "path") -> DataFrame:
    """The media file with the id in its name; of several the smallest path (one row, null if none)."""
    name = T.basename(F.col(path))
    return media_files(files, path).where(name.contains(f"---{video_id}.")).agg(F.min(path).alias(path))


def diff(scanned: DataFrame, stored: DataFrame, path: str = "file_path") -> DataFrame:
    """(change, old_path, new_path): added, deleted and moved paths. A gone and a new path are a move if
    their base name occurs once among the gone and once among the new ones. One shuffle by path finds the
    differences; the base names are counted on the differences only."""
    a, b = scanned.select(F.col(path)).distinct().withColumn("there", F.lit(1)), stored.select(F.col(path)).distinct().withColumn("known", F.lit(1))
    changed = a.join(b, path, "full_outer").where(F.col("there").isNull() | F.col("known").isNull())
    named = changed.select(T.basename(F.col(path)).alias("name"), F.when(F.col("known").isNull(), F.col(path)).alias("new"), F.when(F.col("there").isNull(), F.col(path)).alias("gone"))
    # aggregates, not lists: a base name that half of the library has takes one row per task
    names = named.groupBy("name").agg(F.count("new").alias("n_new"), F.count("gone").alias("n_gone"), F.max("new").alias("new_path"), F.max("gone").alias("old_path"))
    pair = (F.col("n_new") == 1) & (F.col("n_gone") == 1)
    moves = names.where(pair).select(F.lit("moved").alias("change"), "old_path", "new_path")
    rest = named.join(names.where(pair).select("name"), "name", "left_anti")
    return moves.unionByName(rest.select(F.when(F.col("gone").isNull(), "added").otherwise("deleted").alias("change"), F.col("gone").alias("old_path"), F.col("new").alias("new_path")))


def tripped(n_gone: Column, n_total: Column) -> Column:
    """More than half of the library would go."""
    return F.coalesce((n_gone > 0) & (n_total > 0) & (n_gone / n_total > BREAKER), F.lit(False))


def guard(changes: DataFrame, stored: DataFrame, directory_changed: bool = False) -> DataFrame:
    """One row (added, moved, deleted, circuit_tripped): a tripped breaker withholds deletes only; a new
    directory bypasses it. Paths that moved are not gone."""
    counts = changes.agg(*(F.count_if(F.col("change") == c).alias(c) for c in ("added", "moved", "deleted")))
    both = counts.crossJoin(stored.agg(F.count("*").alias("total")))  # one row each
    trip = F.lit(False) if directory_changed else tripped(F.col("deleted"), F.col("total"))
    return both.select("added", "moved", F.when(trip, F.lit(0).cast("long")).otherwise(F.col("deleted")).alias("deleted"), trip.alias("circuit_tripped"))


def directory_changed(stored: DataFrame, current: str, known: str | None, path: str = "file_path") -> DataFrame:
    """One row (changed): the known directory differs; without one, paths exist and none is below the current."""
    if known is not None:
        return stored.sparkSession.range(1).select(F.lit(known != current).alias("changed"))
    below = F.startswith(F.col(path), F.lit(current.rstrip("/") + "/"))
    return stored.agg((F.count("*") > 0).alias("some"), F.coalesce(F.bool_or(below), F.lit(False)).alias("below")).select((F.col("some") & ~F.col("below")).alias("changed"))


# mutations


def insert_ignore(target: DataFrame, rows: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """target and the rows whose key it lacks; of equal new keys the first by `order`."""
    first = rows.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(order or key))).where("__n = 1").drop("__n")
    return target.unionByName(first.join(target.select(key), key, "left_anti"), allowMissingColumns=True)


def update_keys(target: DataFrame, moves: DataFrame, key: str, old: str = "old_path", new: str = "new_path", stamp: str | None = None) -> DataFrame:
    """target with keys renamed as in moves, and `stamp` set to now where they were."""
    joined = target.join(moves.select(F.col(old).alias("__old"), F.col(new).alias("__new")), F.col(key) == F.col("__old"), "left")
    out = joined.withColumn(key, F.coalesce("__new", key))
    if stamp:
        out = out.withColumn(stamp, F.when(F.col("__new").isNotNull(), F.current_timestamp()).otherwise(F.col(stamp)))
    return out.drop("__old", "__new")


def delete_keys(target: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return target.join(keys.select(key), key, "left_anti")


def upsert(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """rows replace what target has under their keys."""
    return delete_keys(target, rows, key).unionByName(rows, allowMissingColumns=True)


def set_where(target: DataFrame, key: str, value: str, column: str, to: Column, stamp: str | None = None) -> DataFrame:
    hit = F.col(key) == F.lit(value)
    out = target.withColumn(column, F.when(hit, to).otherwise(F.col(column)))
    return out.withColumn(stamp, F.when(hit, F.current_timestamp()).otherwise(F.col(stamp))) if stamp else out


def integrity(target: DataFrame, key: str = "file_path") -> DataFrame:
    """One row (ok, nulls, duplicates)."""
    by_key = target.groupBy(key).agg(F.count("*").alias("n"))
    found = by_key.agg(F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n"))), F.lit(0)).cast("long").alias("nulls"), F.count_if(F.col(key).isNotNull() & (F.col("n") > 1)).alias("duplicates"))
    return found.select(((F.col("nulls") == 0) & (F.col("duplicates") == 0)).alias("ok"), "nulls", "duplicates")


def apply_diff(target: DataFrame, moves: DataFrame, inserts: DataFrame, deletes: DataFrame, key: str = "file_path") -> DataFrame:
    """The next snapshot: moves, then insert-ignore, then deletes; all or nothing: if a key would not be
    unique the snapshot is the old one."""
    after = delete_keys(insert_ignore(update_keys(target, moves, key), inserts, key), deletes, key)
    # only a move can break uniqueness, and before the inserts are looked at
    moved = update_keys(target.select(key), moves, key)
    broken = moved.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").agg((F.count("*") > 0).alias("broken"))
    columns = target.columns
    both = after.select(*columns, F.lit(True).alias("__new")).unionByName(target.select(*columns, F.lit(False).alias("__new")))
    return both.crossJoin(broken).where(F.col("__new") != F.col("broken")).select(*columns)


#: Ranges of keys for numbering, whose bounds are that many keys of an even sample.
RANGES = 256


def with_ids(target: DataFrame, rows: DataFrame, key: str = "file_path") -> DataFrame:
    """rows with ids after the target's largest, in the order of their keys, which are unique. Numbers come
    from ranges of keys with offsets, so no task holds all rows. A key's range is a function of the key
    alone: the bounds are constants of the plan, drawn before by a hash of the keys (RANGES keys about)."""
    n = rows.count()
    drawn = rows.select(key).where(F.pmod(F.xxhash64(key), F.lit(max(1, n // RANGES))) == 0).distinct().sort(key).limit(4 * RANGES)
    bounds = [r[0] for r in drawn.collect()]
    part = F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<string>"), lambda b: b <= F.col(key))) if bounds else F.lit(0)
    held = rows.drop("id").withColumn("__part", part)
    base = held.groupBy("__part").agg(F.count("*").alias("__n")).withColumn("__base", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    top = target.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    numbered = held.withColumn("__k", F.row_number().over(W.partitionBy("__part").orderBy(key))).join(base, "__part").crossJoin(top)  # top is one row
    return numbered.withColumn("id", (F.col("top") + F.col("__base") + F.col("__k")).cast("bigint")).drop("__part", "__k", "__base", "top")


def migrate(old: DataFrame) -> DataFrame:
    """Rows of any older version in today's schema; columns they lack read their defaults."""
    have = set(old.columns)
    return old.select(*((F.col(n) if n in have else F.lit(d)).cast(t).alias(n) for n, t, d in SONGS))


def known_states(songs: DataFrame) -> DataFrame:
    return songs.where(F.col("pipeline_state").isin(*PIPELINE_STATES))


def settings(defaults: DataFrame, stored: DataFrame, given: DataFrame) -> DataFrame:
    """(key, value, origin) by precedence: given, else stored, else default; keys of all three."""
    g, s, d = (x.select("key", F.col("value").alias(n)) for x, n in ((given, "g"), (stored, "s"), (defaults, "d")))
    joined = d.join(s, "key", "full_outer").join(g, "key", "full_outer")
    return joined.select("key", F.coalesce("g", "s", "d").alias("value"), F.when(F.col("g").isNotNull(), "given").when(F.col("s").isNotNull(), "stored").otherwise("default").alias("origin"))


def companions(paths: DataFrame, path: str = "file_path") -> DataFrame:
    """(path, kind, companion): the files that a rename or delete of the song has to take along."""
    p = F.col(path)
    at, name = T.dirname(p), T.stem(p)
    kinds = [("stem", "vocal", "---vocal.m4a"), ("stem", "nonvocal", "---nonvocal.m4a"), ("karaoke", "karaoke", ".ass"), ("subtitles", "subtitles", ".srt"), ("subtitles", "subtitles", ".en.srt")]
    made = F.array(*(F.struct(F.lit(k).alias("kind"), F.concat(at, F.lit(f"/{d}/"), name, F.lit(e)).alias("companion")) for k, d, e in kinds))
    return paths.select(p.alias("path"), F.inline(made))


def companion_files(paths: DataFrame, files: DataFrame, path: str = "file_path") -> DataFrame:
    """(path, kind, companion) of the companions that a listing `files` (path) has; of a stem with both
    spellings of its extension the small one."""
    plain = F.regexp_replace("path", r"\.M4A$", ".m4a")
    there = files.groupBy(plain.alias("companion")).agg(F.min_by("path", F.col("path") != plain).alias("found"))
    kind = F.when(F.col("kind") == "stem", F.regexp_extract("companion", r"---(\w+)\.m4a$", 1)).otherwise(F.col("kind"))
    return companions(paths, path).join(there, "companion").select("path", kind.alias("kind"), F.col("found").alias("companion"))


def missing_artifacts(paths: DataFrame, files: DataFrame, path: str = "file_path") -> DataFrame:
    """(path, missing): which of stems, karaoke, subtitles a song lacks, given a listing `files` (path).
    Both stems are needed, one subtitle file is enough."""
    wanted = companions(paths, path)
    there = wanted.join(files.select(F.regexp_replace("path", r"\.M4A$", ".m4a").alias("companion")).distinct().withColumn("__there", F.lit(True)), "companion", "left")
    have = F.coalesce("__there", F.lit(False))
    by = there.groupBy("path").agg(*((F.bool_and if k == "stem" else F.bool_or)(F.when(F.col("kind") == k, have)).alias(k) for k in ("stem", "karaoke", "subtitles")))
    return by.select("path", F.array_compact(F.array(*(F.when(~F.col(k), F.lit("stems" if k == "stem" else k)) for k in ("karaoke", "stem", "subtitles")))).alias("missing"))


def work_plan(missing: Column) -> Column:
    """The stages that the missing artifacts need, in order."""
    stems, lyric = F.array_contains(missing, "stems"), F.array_contains(missing, "karaoke") | F.array_contains(missing, "subtitles")
    none = F.array().cast("array<string>")
    first = F.when(stems, F.array(*map(F.lit, ("extract", "loudness", "separate", "transcode")))).when(lyric, F.array(F.lit("decode"))).otherwise(none)
    return F.concat(first, F.when(lyric, F.array(F.lit("align"))).otherwise(none))


def lyric_origin(songs: DataFrame) -> DataFrame:
    """songs with choice (mode, genius_id) and subtitle columns: adds origin. An explicit lyric choice
    wins, then an explicit wish to transcribe, then subtitles if there are any."""
    srt = F.when(F.col("subtitle").isNotNull(), "srt").otherwise("none")
    return songs.withColumn("origin", F.when(F.col("genius_id").isNotNull(), "genius").when(F.col("mode") == "raw", "none").otherwise(srt))


def subtitle_choice(songs: DataFrame, files: DataFrame, path: str = "file_path") -> DataFrame:
    """(path, source, target): of the subtitle files whose names begin with the song's stem, in its folder, one
    with `.en.srt` in its name, else any; of equals the smallest name. It goes to the song's subtitles folder.
    A file is joined by each beginning of its name, so the join has keys."""
    song = songs.select(F.col(path).alias("path"), T.dirname(F.col(path)).alias("dir"), T.stem(F.col(path)).alias("stem"))
    f = files.where(T.detect_format(F.col("path")) == "srt").select(F.col("path").alias("source"), T.dirname(F.col("path")).alias("dir"), T.basename(F.col("path")).alias("name"))
    starts = f.withColumn("stem", F.explode(F.transform(F.sequence(F.lit(1), F.length("name") - 4), lambda n: F.substring(F.col("name"), F.lit(1), n))))
    met = song.join(starts, ["dir", "stem"])
    best = met.groupBy("path", "dir", "stem").agg(F.min_by("source", F.struct(~F.col("name").contains(".en.srt"), "name")).alias("source"))
    return best.select("path", "source", F.concat(F.when(F.col("dir") != "", F.concat("dir", F.lit("/"))).otherwise(""), F.lit("subtitles/"), "stem", F.lit(".srt")).alias("target"))


def reused_lines(songs: DataFrame, bundles: DataFrame, path: str = "file_path") -> DataFrame:
    """(path, align_lines) of the songs that lack karaoke or subtitles, have no choice yet and have a stored
    bundle (stem, align_lines). songs: path, missing, choice."""
    lacks = F.array_contains("missing", "karaoke") | F.array_contains("missing", "subtitles")
    open_ = songs.where(lacks & F.col("choice").isNull()).select(F.col(path).alias("path"), T.stem(F.col(path)).alias("stem"))
    return open_.join(bundles.select("stem", "align_lines"), "stem").select("path", "align_lines")


# reads by key, counts and gates


def value_of(pairs: DataFrame, key: str) -> DataFrame:
    """The value under one key (one row or none)."""
    return pairs.where(F.col("key") == F.lit(key)).select("value")


def stored_of(keys: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """keys with what target has under them, null where it has nothing."""
    return keys.join(target, key, "left")


def found_of(keys: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """What target has under the keys; keys that it lacks are left out."""
    return keys.select(key).distinct().join(target, key)


def stats(songs: DataFrame, kind: str) -> DataFrame:
    """One row (songs, kinds)."""
    return songs.agg(F.count("*").alias("songs"), F.count_distinct(kind).alias("kinds"))


def accepts(state: Column) -> Column:
    """Whether a song may be queued: not while it waits for processing or has failed it."""
    return ~F.coalesce(state.isin("pending", "failed"), F.lit(False))


def due(jobs: DataFrame, songs: DataFrame, key: str = "file_path") -> DataFrame:
    """jobs with `action`: songs that are ready, or that someone skipped, are complete at once."""
    known = songs.select(key, F.col("pipeline_state").alias("__state"))
    return jobs.join(known, key, "left").withColumn("action", F.when(F.col("__state").isin("ready", "skipped"), "complete").otherwise("process")).drop("__state")


def distinct_of(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(column).distinct()


def by_basename(paths: DataFrame, path: str, *kept: str) -> DataFrame:
    """(name, n, first, last): how many paths share a base name, and the smallest and largest of `path`.
    Aggregates instead of lists: a name that half of the library has takes one row per task."""
    p = F.col(path)
    return paths.groupBy(T.basename(p).alias("name")).agg(F.count("*").alias("n"), F.min(p).alias("first"), F.max(p).alias("last"), *(F.min(c).alias(c) for c in kept))


def cleared(stored: DataFrame) -> DataFrame:
    """The stored settings after a reset: none."""
    return stored.limit(0)


def seeded(stored: DataFrame, hidden: DataFrame) -> DataFrame:
    """stored (key, value) with blank placeholders for the hidden keys that it lacks."""
    return insert_ignore(stored, hidden.select("key", F.lit("").alias("value")), "key")


def write_choices(target: DataFrame, rows: DataFrame) -> DataFrame:
    """Lyric choices (yt_id, payload as JSON): rows replace older ones; a payload without yt_id gets it."""
    own = F.regexp_replace("payload", r"^\s*\{\s*", F.concat(F.lit('{"yt_id":"'), "yt_id", F.when(F.col("payload").rlike(r"^\s*\{\s*\}"), '"').otherwise('",')))
    return upsert(target, rows.withColumn("payload", F.when(F.get_json_object("payload", "$.yt_id").isNull(), own).otherwise(F.col("payload"))), "yt_id")


def delete_choices(target: DataFrame, keys: DataFrame) -> DataFrame:
    """Unknown keys are no error."""
    return delete_keys(target, keys, "yt_id")


# snapshots


def publish(snapshot: DataFrame, root: str, version: int) -> None:
    """Write a snapshot and then name it in the pointer table; the pointer's commit is the switch."""
    snapshot.write.mode("error").parquet(f"{root}/v{version:08d}")
    snapshot.sparkSession.createDataFrame([(version,)], "version long").coalesce(1).write.mode("append").parquet(f"{root}/pointer")


def current(spark: SparkSession, root: str) -> DataFrame:
    version = spark.read.parquet(f"{root}/pointer").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{root}/v{version:08d}")

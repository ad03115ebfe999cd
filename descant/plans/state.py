"""State queries: rooms are made of users' events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..streaming import ordered as O, queue as Q, signals as S, tracker as K
from .base import query, table


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    return _requests_of(table(spark, sf, "events"))


def _requests_of(events: DataFrame, *more: Column) -> DataFrame:
    return events.select((F.col("event_id") % 20).cast("string").alias("room"), F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("user"), F.concat(F.lit("song"), F.col("event_id").cast("string")).alias("file"), *more)


def queue_events(spark: SparkSession, sf: str, *more: Column) -> DataFrame:
    """A mix of all actions; files repeat so that some requests are refused."""
    n = F.col("seq")
    action = F.when(n % 10 < 6, "enqueue").when(n % 10 == 6, "pop").when(n % 30 == 7, "pause_song").when(n % 30 == 17, "up").when(n % 30 == 27, "delete").when(n % 30 == 8, "pause_user").when(n % 30 == 18, "bottom").when(n % 30 == 28, "front").when(n % 500 == 499, "clear").otherwise("reorder")
    return _requests_of(table(spark, sf, "events"), *more).withColumn("action", action).withColumn("file", F.concat(F.lit("song"), (n % 997).cast("string"))).withColumn("semitones", (n % 5).cast("int")).withColumn("index", (n % 4).cast("int")).withColumn("to", (n % 3).cast("int"))


def tracker_events(spark: SparkSession, sf: str, *more: Column) -> DataFrame:
    """Six downloads a round and what becomes of them."""
    n = F.col("event_id")
    k, video = n % 7, F.lpad(F.floor(n / 7).cast("string"), 11, "v")
    name = F.when(k == 0, "download_queued").when(k == 1, "download_started").when((k == 2) & (n % 3 != 0), "song_downloaded").when(k == 2, "download_error").when((k == 3) & (n % 5 == 0), "cancel").when(k == 4, F.when(n % 2 == 0, "processing_complete").otherwise("processing_error")).when((k == 5) & (n % 5 == 0), "processing_cancelled").when((k == 6) & (n % 11 == 0), "song_deleted").otherwise("stage_changed")
    return table(spark, sf, "events").select(
        (F.floor(n / 7) % 20).cast("string").alias("room"), n.alias("seq"), name.alias("name"), F.concat(F.lit("https://e.com/watch?v="), video).alias("url"), F.concat(F.lit("s---"), video, F.lit(".mp4")).alias("song_path"),
        F.concat(F.lit("t"), video).alias("title"), F.col("user_id").cast("string").alias("user"), F.lit("boom").alias("error"), F.lit("srt+joint").alias("method"), video.alias("video"), *more,
    )


@query("SELECT room, event_id, position FROM (SELECT room, event_id, row_number() OVER (PARTITION BY room ORDER BY round, event_id) - 1 AS position FROM (SELECT event_id % 20 AS room, event_id, row_number() OVER (PARTITION BY event_id % 20, user_id ORDER BY event_id) AS round FROM events))")
def fair_queue(spark: SparkSession, sf: str) -> DataFrame:
    r = Q.fair_order(_requests(spark, sf))
    return r.select(F.col("room").cast("bigint").alias("room"), F.col("seq").alias("event_id"), F.col("position").cast("bigint").alias("position"))


@query("SELECT room, user_id, n, n >= 3 AS limited FROM (SELECT event_id % 20 AS room, user_id, count(*) + count(*) FILTER (event_id < 20) AS n FROM events GROUP BY 1, 2)")
def user_limit(spark: SparkSession, sf: str) -> DataFrame:
    r = _requests(spark, sf)
    return Q.counts_by_user(r, r.where("seq < 20"), 3).select(F.col("room").cast("bigint").alias("room"), F.col("user").cast("bigint").alias("user_id"), "n", "limited")


@query("SELECT event_id % 20 AS room, min(event_id) AS event_id FROM events WHERE event_id % 3 <> 0 GROUP BY 1")
def next_playable(spark: SparkSession, sf: str) -> DataFrame:
    q = _requests(spark, sf).withColumn("position", F.col("seq")).withColumn("paused", F.col("seq") % 3 == 0)
    return Q.next_playable(q).select(F.col("room").cast("bigint").alias("room"), F.substring("file", 5, 20).cast("bigint").alias("event_id"))


@query("SELECT event_id, CASE WHEN event_id = 10 THEN 3 WHEN event_id BETWEEN 3 AND 9 THEN event_id + 1 ELSE event_id END AS position FROM events")
def reorder(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", F.col("event_id").alias("position"))
    return Q.reordered(e, 10, 3).select("event_id", F.col("position").cast("bigint").alias("position"))


#: The queue as a state per room, one event a step: what stands where is in a list.
_QUEUE_SQL = """WITH RECURSIVE ev AS (SELECT event_id % 20 AS room, row_number() OVER (PARTITION BY event_id % 20 ORDER BY event_id) AS k, user_id::VARCHAR AS u, 'song' || event_id % 997 AS f, (event_id % 5)::INTEGER AS s, event_id % 4 AS a, event_id % 3 AS b,
  CASE WHEN event_id % 10 < 6 THEN 'enqueue' WHEN event_id % 10 = 6 THEN 'pop' WHEN event_id % 30 = 7 THEN 'pause_song' WHEN event_id % 30 = 17 THEN 'up' WHEN event_id % 30 = 27 THEN 'delete' WHEN event_id % 30 = 8 THEN 'pause_user' WHEN event_id % 30 = 18 THEN 'bottom' WHEN event_id % 30 = 28 THEN 'front' WHEN event_id % 500 = 499 THEN 'clear' ELSE 'reorder' END AS act FROM events),
q AS (SELECT DISTINCT room, 0::BIGINT AS k, []::STRUCT(u VARCHAR, f VARCHAR, s INTEGER, p BOOLEAN)[] AS x, NULL::VARCHAR AS playing FROM ev
UNION ALL SELECT room, k,
  CASE WHEN act IN ('enqueue', 'front') THEN CASE WHEN i >= 0 OR own + coalesce((playing = u)::INTEGER, 0) >= 4 THEN x ELSE x[1:place] || [{'u': u, 'f': f, 's': s, 'p': false}] || x[place + 1:] END
    WHEN act = 'pop' THEN CASE WHEN j IS NULL THEN x ELSE x[1:j - 1] || x[j + 1:] END
    WHEN act = 'pause_song' THEN list_transform(x, lambda y, n: {'u': y.u, 'f': y.f, 's': y.s, 'p': (n = i + 1) <> y.p})
    WHEN act = 'pause_user' THEN list_transform(x, lambda y: {'u': y.u, 'f': y.f, 's': y.s, 'p': CASE WHEN y.u = u THEN open_ > 0 ELSE y.p END})
    WHEN act = 'clear' THEN [] WHEN act = 'delete' THEN CASE WHEN i < 0 THEN x ELSE x[1:i] || x[i + 2:] END
    WHEN old BETWEEN 0 AND len(x) - 1 AND new BETWEEN 0 AND len(x) - 1 AND NOT (act <> 'reorder' AND old = new) THEN (x[1:old] || x[old + 2:])[1:new] || [x[old + 1]] || (x[1:old] || x[old + 2:])[new + 1:] ELSE x END,
  CASE WHEN act = 'pop' THEN x[j].u ELSE playing END
FROM (SELECT *, CASE act WHEN 'reorder' THEN a ELSE i END AS old, CASE act WHEN 'reorder' THEN b WHEN 'up' THEN i - 1 WHEN 'bottom' THEN len(x) - 1 END AS new,
    CASE WHEN act = 'front' THEN 0 ELSE coalesce(list_min(list_filter(range(len(x)), lambda n: len(list_filter(x[1:n], lambda y: y.u = x[n + 1].u)) > own)), len(x)) END AS place
  FROM (SELECT ev.*, x, playing, coalesce(list_position(list_transform(x, lambda y: y.f), f), 0) - 1 AS i, len(list_filter(x, lambda y: y.u = u)) AS own, len(list_filter(x, lambda y: y.u = u AND NOT y.p)) AS open_,
      list_min(list_filter(range(1, len(x) + 1), lambda n: NOT x[n].p)) AS j FROM q JOIN ev ON ev.room = q.room AND ev.k = q.k + 1))),
last AS (SELECT room, arg_max(x, k) AS x FROM q GROUP BY room)
SELECT room::VARCHAR AS room, (n - 1)::INTEGER AS position, x[n].u AS "user", x[n].f AS file, x[n].f AS title, x[n].s AS semitones, x[n].p AS paused FROM (SELECT room, x, unnest(range(1, len(x) + 1)) AS n FROM last)"""
#: What became of each video, since every one has at most one event of a kind.
_TRACKER_SQL = """WITH v AS (SELECT event_id // 7 AS v, max(CASE WHEN event_id % 7 = 0 THEN user_id::VARCHAR END) AS u, bool_or(event_id % 7 = 0) AS queued, bool_or(event_id % 7 = 1) AS started, bool_or(event_id % 7 = 2 AND event_id % 3 <> 0) AS down, bool_or(event_id % 7 = 2 AND event_id % 3 = 0) AS failed,
  bool_or(event_id % 7 = 3 AND event_id % 5 = 0) AS cancel, bool_or(event_id % 7 = 4 AND event_id % 2 = 0) AS done, bool_or(event_id % 7 = 4 AND event_id % 2 = 1) AS bad, bool_or(event_id % 7 = 5 AND event_id % 5 = 0) AS cancelled, bool_or(event_id % 7 = 6 AND event_id % 11 = 0) AS deleted FROM events GROUP BY 1),
i AS (SELECT (v % 20)::VARCHAR AS room, (row_number() OVER (PARTITION BY v % 20 ORDER BY v) - 1)::INTEGER AS place, lpad(v::VARCHAR, 11, 'v') AS video, u, CASE WHEN down THEN 'complete' WHEN failed THEN 'error' WHEN started THEN 'active' ELSE 'pending' END AS d, down, down AND done AS done, down AND bad AS bad, down AND cancel AS cancelling, failed AND NOT down AS failed
  FROM v WHERE queued AND NOT (down AND deleted) AND NOT (down AND cancel AND cancelled)),
s AS (SELECT *, CASE WHEN cancelling THEN 'cancelling' WHEN NOT down THEN CASE WHEN failed THEN 'error' ELSE 'waiting' END WHEN bad THEN 'error' ELSE 'complete' END AS s FROM i)
SELECT room, place, 't' || video AS title, 'https://e.com/watch?v=' || video AS url, u AS "user", CASE WHEN down THEN 's---' || video || '.mp4' END AS song_path, d AS download_status, s AS processing_status, CASE WHEN failed OR bad THEN 'boom' END AS error_message, cancelling, CASE WHEN done THEN 'srt+joint' END AS lyric_method,
list_filter([CASE WHEN NOT cancelling AND (d IN ('active', 'pending') OR s IN ('active', 'pending')) AND (place % 2 = 0 OR u = '7') THEN 'cancel' END, CASE WHEN NOT cancelling AND (d IN ('complete', 'error') OR s IN ('complete', 'error')) AND place % 2 = 0 THEN 'remove' END,
CASE WHEN NOT cancelling AND d = 'complete' AND s = 'complete' THEN 'enqueue' END], lambda x: x IS NOT NULL) AS actions FROM s"""


def _told(items: DataFrame) -> DataFrame:
    now = items.withColumn("processing_status", K.status(F.lit("none"), F.array().cast("array<string>")))
    return now.withColumn("actions", K.actions(F.col("place") % 2 == 0, F.lit("7")))


def _at() -> Column:
    """The time of an event's row."""
    return F.col("ts").cast("timestamp").alias("at")


@query(_QUEUE_SQL)
def queue_fold(spark: SparkSession, sf: str) -> DataFrame:
    return Q.fold(queue_events(spark, sf), limit=4)


@query(_QUEUE_SQL)
def queue_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The queues after the history went through the stream, slice by slice."""
    events = queue_events(spark, sf, _at())
    return Q.present(O.results(O.replay(events, "room", lambda s: Q.stream(s, limit=4))))


@query(_TRACKER_SQL)
def tracker_fold(spark: SparkSession, sf: str) -> DataFrame:
    return _told(K.fold(tracker_events(spark, sf)))


@query(_TRACKER_SQL)
def tracker_stream(spark: SparkSession, sf: str) -> DataFrame:
    events = tracker_events(spark, sf, _at())
    return _told(K.present(O.results(O.replay(events, "room", K.stream))))


@query(
    "WITH t AS (" + _TRACKER_SQL + """), j AS (SELECT room, place, '{"title":"' || title || '","url":"' || url || '","user":"' || "user" || '"' || coalesce(',"song_path":"' || song_path || '"', '') || ',"download_status":"' || download_status || '","processing_status":"' || processing_status || '"'
|| coalesce(',"error_message":"' || error_message || '"', '') || ',"cancelling":' || cancelling::VARCHAR || coalesce(',"lyric_method":"' || lyric_method || '"', '') || ',"actions":[' || array_to_string(list_transform(actions, lambda x: '"' || x || '"'), ',') || ']}' AS item FROM t)
SELECT room, '[' || string_agg(item, ',' ORDER BY place) || ']' AS body FROM j GROUP BY room"""
)
def processing_read_model(spark: SparkSession, sf: str) -> DataFrame:
    none = F.array().cast("array<string>")
    return K.processing_status(K.fold(tracker_events(spark, sf)), F.lit("none"), none, F.col("place") % 2 == 0, F.lit("7"))


@query("""WITH q AS (SELECT event_id % 20 AS room, event_id, user_id, event_id % 3 = 0 AS paused FROM events WHERE event_id >= 20), p AS (SELECT event_id AS room, user_id, value FROM events WHERE event_id < 20),
n AS (SELECT room, min(event_id) AS event_id, arg_min(user_id, event_id) AS user_id FROM q WHERE NOT paused GROUP BY 1)
SELECT p.room::VARCHAR AS room, '{"now_playing":"song' || p.room || '","now_playing_user":"' || p.user_id || '","is_paused":' || (p.room % 2 = 0)::VARCHAR || ',"up_next":' || coalesce('"song' || n.event_id || '"', 'null') || ',"next_user":' || coalesce('"' || n.user_id || '"', 'null') || '}' AS body FROM p LEFT JOIN n USING (room)""")
def now_playing_read_model(spark: SparkSession, sf: str) -> DataFrame:
    r = _requests(spark, sf)
    playing = r.where("seq < 20").select("room", F.col("file").alias("now_playing"), F.col("user").alias("now_playing_user"), (F.col("seq") % 2 == 0).alias("is_paused"))
    waiting = r.where("seq >= 20").select("room", "user", F.col("file").alias("title"), F.col("seq").alias("position"), (F.col("seq") % 3 == 0).alias("paused"))
    return Q.now_playing(playing, waiting)


_THROTTLE_SQL = """WITH RECURSIVE e AS (SELECT user_id, event_id, event_id / 1000.0::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), n AS (SELECT user_id, list(t ORDER BY i) AS ts, list(event_id ORDER BY i) AS ids FROM e GROUP BY 1),
r AS (SELECT user_id, ts, ids, 1::BIGINT AS i FROM n UNION ALL SELECT user_id, ts, ids, nxt FROM (SELECT user_id, ts, ids, list_min(list_filter(range(i + 1, len(ts) + 1), lambda j: ts[j] - ts[i] >= 0.5)) AS nxt FROM r) WHERE nxt IS NOT NULL)
SELECT user_id, ts[i] AS at, ids[i] AS "order" FROM r"""


def _ticks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("user_id", "event_id", (F.col("event_id") / 1000).alias("at"))


@query(_THROTTLE_SQL)
def tick_throttle(spark: SparkSession, sf: str) -> DataFrame:
    return K.throttled(_ticks(spark, sf), "user_id", "event_id", "at", 0.5)


@query(_THROTTLE_SQL)
def throttle_stream(spark: SparkSession, sf: str) -> DataFrame:
    ticks = _ticks(spark, sf).withColumnRenamed("event_id", "seq").withColumn("at", F.timestamp_millis("seq"))
    out = O.replay(ticks, "user_id", lambda s: S.throttled(s.withColumn("at", F.unix_micros("at") / 1_000_000), "user_id", "seq", "at", 0.5))
    return O.results(out).select(F.col("key").cast("bigint").alias("user_id"), "at", "order")


@query("""WITH a AS (SELECT c_custkey, c_mktsegment AS v FROM customer WHERE c_custkey % 4 <> 0), b AS (SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'new' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 5 <> 0)
SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN b.c_custkey IS NULL THEN 'clear' ELSE 'send' END AS op, b.v AS value FROM a FULL JOIN b ON a.c_custkey = b.c_custkey WHERE b.c_custkey IS NULL OR a.c_custkey IS NULL OR a.v IS DISTINCT FROM b.v""")
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("value"))
    after = c.where("c_custkey % 5 <> 0").withColumn("value", F.when(F.col("c_custkey") % 6 == 0, "new").otherwise(F.col("value")))
    return K.changes(c.where("c_custkey % 4 <> 0"), after, "c_custkey", "value")


@query("""WITH s AS (SELECT user_id % 5 AS view, event_id // 200 AS version, event_type AS item, (count(*) % 3)::VARCHAR AS value FROM events GROUP BY ALL), v AS (SELECT view, version, lag(version) OVER (PARTITION BY view ORDER BY version) AS before FROM (SELECT DISTINCT view, version FROM s))
SELECT s.view, s.version, s.item, 'send' AS op, s.value FROM s JOIN v USING (view, version) LEFT JOIN s b ON b.view = s.view AND b.version = v.before AND b.item = s.item WHERE b.value IS DISTINCT FROM s.value
UNION ALL SELECT v.view, v.version, b.item, 'clear', NULL FROM v JOIN s b ON b.view = v.view AND b.version = v.before WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.view = v.view AND s.version = v.version AND s.item = b.item)""")
def snapshot_stream(spark: SparkSession, sf: str) -> DataFrame:
    """What five views are sent, as the counts of their event types change from one lot of 200 events to the next."""
    e = table(spark, sf, "events").select((F.col("user_id") % 5).cast("string").alias("view"), F.floor(F.col("event_id") / 200).alias("version"), F.col("event_type").alias("item"))
    shown = e.groupBy("view", "version", "item").agg((F.count("*") % 3).cast("string").alias("value")).withColumn("at", F.timestamp_seconds("version"))
    out = O.replay(shown, "view", S.changes, seq="version")
    return O.results(out).select(F.col("view").cast("bigint").alias("view"), "version", "item", "op", "value")


_BUS_SQL = "SELECT room, event_id, registered, row_number() OVER (PARTITION BY room ORDER BY event_id, registered) AS call FROM (SELECT event_id % 20 AS room, event_id, event_type FROM events) JOIN (VALUES ('view', 1), ('click', 2), ('view', 3)) h(name, registered) ON name = event_type"


@query(_BUS_SQL)
def bus_stream(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select((F.col("event_id") % 20).cast("string").alias("room"), F.col("event_id").alias("seq"), F.col("event_type").alias("name"), F.col("ts").cast("timestamp").alias("at"))
    out = O.replay(e, "room", lambda s: S.dispatched(s, {"view": [1, 3], "click": [2]}))
    return O.results(out).select(F.col("room").cast("bigint").alias("room"), F.col("seq").alias("event_id"), "registered", "call")


@query(_BUS_SQL)
def event_bus(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select((F.col("event_id") % 20).alias("room"), F.col("event_id").alias("seq"), F.col("event_type").alias("name"))
    h = spark.createDataFrame([("view", 1), ("click", 2), ("view", 3)], "name string, registered int")
    return K.dispatched(e, h).select("room", F.col("seq").alias("event_id"), "registered", F.col("call").cast("bigint").alias("call"))


@query("""WITH i AS (SELECT event_id AS n, event_id % 7 = 0 AS cancelling, CASE WHEN event_id % 3 <> 0 THEN 'p' || event_id % 9 END AS song_path, CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'active' WHEN 2 THEN 'complete' ELSE 'error' END AS d, CASE event_id % 5 WHEN 0 THEN 'waiting' WHEN 1 THEN 'complete' ELSE 'error' END AS said, user_id FROM events),
s AS (SELECT *, CASE WHEN cancelling THEN 'cancelling' WHEN song_path IS NULL THEN CASE WHEN d = 'error' THEN 'error' ELSE 'waiting' END WHEN song_path = 'p1' THEN 'active' WHEN song_path IN ('p2', 'p4') THEN 'pending' WHEN said IN ('complete', 'error') THEN said ELSE 'complete' END AS s FROM i)
SELECT n AS event_id, s AS status, list_filter([CASE WHEN NOT cancelling AND (d IN ('active', 'pending') OR s IN ('active', 'pending')) AND (n % 2 = 0 OR user_id = 7) THEN 'cancel' END, CASE WHEN NOT cancelling AND (d IN ('complete', 'error') OR s IN ('complete', 'error')) AND n % 2 = 0 THEN 'remove' END,
CASE WHEN NOT cancelling AND d = 'complete' AND s = 'complete' AND song_path IS NOT NULL THEN 'enqueue' END], lambda x: x IS NOT NULL) AS actions FROM s""")
def tracker_status(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id")
    pick = lambda k, *xs: F.element_at(F.array(*map(F.lit, xs)), (n % k + 1).cast("int"))
    items = table(spark, sf, "events").select(
        "event_id", F.col("user_id").cast("string").alias("user"), (n % 7 == 0).alias("cancelling"), F.when(n % 3 != 0, F.concat(F.lit("p"), (n % 9).cast("string"))).alias("song_path"),
        pick(4, "pending", "active", "complete", "error").alias("download_status"), pick(5, "waiting", "complete", "error", "error", "error").alias("processing_status"),
    )
    now = items.withColumn("processing_status", K.status(F.lit("p1"), F.array(F.lit("p2"), F.lit("p4"))))
    return now.select("event_id", F.col("processing_status").alias("status"), K.actions(n % 2 == 0, F.lit("7")).alias("actions"))

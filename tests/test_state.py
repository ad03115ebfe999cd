"""Queue and tracker folds, and their streams against the batch folds."""

import json
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import DataFrame, Row, functions as F

from descant.operators import catalogue as C
from descant.streaming import ordered as O, queue as Q, signals as S, tracker as K


def enqueued(users, **options):
    q = Q.Queue(**options)
    for k, u in enumerate(users):
        q.apply({"action": "enqueue", "user": u, "file": f"f{k}"})
    return "".join(x["user"] for x in q.items)


@pytest.mark.parametrize("users,want", [("aab", "aba"), ("abcab", "abcab"), ("aaabb", "ababa"), ("", "")])
def test_fair_queue(users, want):
    assert enqueued(users) == want


def test_fair_order_equals_the_fold(spark):
    rng = random.Random(1)
    rows = [("r", k, rng.choice("abcd"), f"f{k}", "enqueue") for k in range(60)]
    events = spark.createDataFrame(rows, "room string, seq long, user string, file string, action string")
    a = [r.file for r in Q.fold(events).orderBy("position").collect()]
    b = [r.file for r in Q.fair_order(events).orderBy("position").collect()]
    assert a == b and len(a) == 60


def test_queue_actions():
    q = Q.Queue(limit=2, fair=False)
    do = lambda action, **e: q.apply({"action": action, **e})
    assert do("enqueue", user="a", file="1") and do("enqueue", user="a", file="2") and not do("enqueue", user="a", file="3") and not do("enqueue", user="b", file="1")
    assert do("front", user="b", file="4") and [x["file"] for x in q.items] == ["4", "1", "2"]
    assert do("pause_song", file="4") and do("pop") and q.playing["file"] == "1"
    assert not do("enqueue", user="a", file="9")  # one queued and one playing
    assert do("enqueue", user="Randomizer", file="5") and do("bottom", file="4") and [x["file"] for x in q.items] == ["2", "5", "4"]
    assert do("up", file="5") and do("down", file="5") and do("top", file="4") and not do("top", file="4") and do("reorder", index=0, to=2) and not do("reorder", index=0, to=9)
    assert do("pause_user", user="b") and not q.items[2]["paused"] and do("delete", file="2") and not do("delete", file="2") and do("clear") and not do("pop") and not do("unknown")


def test_tracker_states():
    t = K.Tracker()
    go = lambda name, **e: t.apply({"name": name, **e})
    url = "https://e.com/watch?v=abc?t=1"
    go("download_queued", title="t", url=url, user="u")
    go("download_started", url=url)
    assert t.items[0]["download_status"] == "active"
    go("song_downloaded", song_path="p", video="abc")
    go("processing_error", song_path="p", error="bad")
    assert (t.items[0]["song_path"], t.items[0]["processing_status"], t.items[0]["error_message"]) == ("p", "error", "bad")
    go("processing_cancelled", song_path="p")
    assert t.items
    go("cancel", song_path="p")
    go("processing_cancelled", song_path="p")
    assert not t.items


def stored(tmp_path, name, events, cuts, closing):
    """Events as files of a stream, a micro-batch per cut; at last an event of each key that is far ahead, so that
    the watermark passes all others."""
    events = events.withColumn("at", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")))
    for cut in [*cuts, closing]:
        part = cut if isinstance(cut, DataFrame) else events.where(F.col("n").isin(cut))
        if isinstance(cut, DataFrame):
            part = part.withColumn("at", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")))
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        time.sleep(0.02)  # files are taken in the order of their times
    return events.schema


def run_stream(spark, tmp_path, rows, schema, stream, name, seed=1, delay=20.0, late=()):
    """Rows (n, t, ...) of a stream, shuffled by less than the delay and cut at random; `late` come at the end."""
    rng = random.Random(seed)
    order = sorted(rows, key=lambda r: r[1] + rng.random() * delay * 0.4)
    cuts, at = [], 0
    while at < len(order):
        size = rng.randrange(1, len(order) // 3 + 2)
        cuts.append([r[0] for r in order[at : at + size]])
        at += size
    cuts.append([r[0] for r in late])
    events = spark.createDataFrame([*rows, *late], schema)
    keys = sorted({r[2] for r in rows})
    far = max(r[1] for r in rows) + 1e6
    closing = spark.createDataFrame([(10**9 + k, far, key, *([None] * (len(schema.split(",")) - 3))) for k, key in enumerate(keys)], schema)
    kind = stored(tmp_path, name, events, [c for c in cuts if c], closing)
    source = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}").drop("t")
    q = stream(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}-state").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name), q.recentProgress


def text_rows(df):
    return sorted(tuple("" if x is None else str(x) for x in r) for r in df.collect())


@pytest.mark.parametrize("seed", [7, 8])
def test_queue_stream_equals_batch(spark, tmp_path, seed):
    rng = random.Random(seed)
    acts = ["enqueue"] * 6 + ["pop", "up", "pause_song", "delete", "front", "pause_user", "clear"]
    schema = "n long, t double, room string, action string, user string, file string, semitones int"
    rows = [(k, k / 4, rng.choice("xyz"), rng.choices(acts, [9] * 11 + [9, 1])[0], rng.choice("abc"), f"f{rng.randrange(12)}", rng.choice([None, 2])) for k in range(400)]
    events = spark.createDataFrame(rows, schema).withColumnRenamed("n", "seq")
    out, _ = run_stream(spark, tmp_path, rows, schema, lambda s: Q.stream(s.withColumnRenamed("n", "seq"), limit=5, delay="20 seconds"), f"queue_{seed}", seed)
    got = Q.present(O.results(out))
    assert O.late_events(out, "room").count() == 0
    assert text_rows(got) == text_rows(Q.fold(events, limit=5)) and got.count() > 3


def test_late_events_go_to_the_side_table(spark, tmp_path):
    schema = "n long, t double, room string, action string, user string, file string"
    rows = [(k, float(k), "r", "enqueue", "ab"[k % 2], f"f{k}") for k in range(100)]
    late = [(200, 5.5, "r", "clear", None, None), (201, 30.5, "r", "delete", None, "f3")]
    out, _ = run_stream(spark, tmp_path, rows, schema, lambda s: Q.stream(s.withColumnRenamed("n", "seq"), delay="20 seconds"), "queue_late", late=late)
    assert Q.present(O.results(out)).count() == 100
    assert sorted(json.loads(r.event)["seq"] for r in O.late_events(out, "room").collect()) == [200, 201]


def test_tracker_stream_equals_batch_and_touches_named_jobs(spark, tmp_path):
    rng = random.Random(7)
    names = ["download_queued", "download_started", "song_downloaded", "download_error", "processing_complete", "processing_error", "cancel", "processing_cancelled", "song_deleted", "processing_skipped"]
    schema = "n long, t double, room string, name string, url string, song_path string, title string, user string, error string, method string, video string"
    rows = []
    for k in range(700):
        v = f"v{rng.randrange(30)}"
        rows.append((k, k / 4, rng.choice("xy"), names[0] if k < 120 or rng.random() < 0.3 else rng.choice(names), f"e/watch?v={v}" if rng.random() < 0.95 else None, f"p{v}" if rng.random() < 0.95 else None, f"t{k}", "u", rng.choice([None, "bad"]), rng.choice([None, "m"]), v))
    events = spark.createDataFrame(rows, schema).withColumnRenamed("n", "seq")
    out, progress = run_stream(spark, tmp_path, rows, schema, lambda s: K.stream(s.withColumnRenamed("n", "seq"), delay="20 seconds"), "tracker_out")
    changes = O.results(out)
    assert text_rows(K.present(changes)) == text_rows(K.fold(events))
    # each run of events gives the jobs it changed, not the room's
    per_run = [r["count"] for r in changes.groupBy("room", "version").count().collect()]
    assert sum(per_run) < 2 * len(rows) and K.fold(events).count() > 60
    written = sum(p["stateOperators"][0]["customMetrics"]["rocksdbPutCount"] for p in progress if p["stateOperators"])
    assert written < 3 * len(rows)  # buffer, jobs and indexes together, whatever the room holds


def test_tracker_equals_a_scan_of_all_jobs():
    """Against the rules told over a plain list."""
    rng = random.Random(3)
    names = ["download_queued"] * 3 + ["download_started", "song_downloaded", "download_error", "processing_complete", "processing_error", "cancel", "processing_cancelled", "song_deleted"]
    t, jobs = K.Tracker(), []
    for _ in range(3000):
        v, name = f"v{rng.randrange(8)}", rng.choice(names)
        url, path = f"e/watch?v={v}", f"p{rng.randrange(8)}"
        t.apply({"name": name, "url": url, "song_path": path, "video": v, "title": "t", "error": "bad"})
        first = lambda holds: next((x for x in jobs if holds(x)), None)
        waits = lambda x: x["download_status"] in ("pending", "active") and x["url"] == url
        here = lambda x: x["song_path"] == path
        new = {}
        match name:
            case "download_queued":
                jobs.append(dict.fromkeys(K.FIELDS) | {"title": "t", "url": url, "download_status": "pending", "processing_status": "waiting", "cancelling": False})
                continue
            case "download_started":
                x, new = first(lambda x: x["url"] == url and x["download_status"] == "pending"), {"download_status": "active"}
            case "song_downloaded":
                x, new = first(waits), {"song_path": path, "download_status": "complete"}
            case "download_error":
                x, new = first(waits), {"download_status": "error", "error_message": "bad"}
            case "processing_complete":
                x, new = first(here), {"processing_status": "complete"}
            case "processing_error":
                x, new = first(here), {"processing_status": "error", "error_message": "bad"}
            case "cancel":
                x, new = first(here), {"cancelling": True}
            case "processing_cancelled":
                x = first(lambda x: here(x) and x["cancelling"])
                jobs = [y for y in jobs if y is not x]
            case "song_deleted":
                jobs, x = [y for y in jobs if not here(y)], None
        if x:
            x |= new
    assert t.items == jobs and len(jobs) > 300


def test_throttle_stream_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, round(rng.random() * 800) / 8, rng.choice("ab")) for k in range(300)]
    out, _ = run_stream(spark, tmp_path, rows, "n long, t double, key string", lambda s: S.throttled(s.withColumn("sec", F.unix_micros("at") / 1_000_000).drop("at"), "key", "n", "sec", 0.5, "20 seconds"), "ticks")
    got = O.results(out).where("order < 1000000000")
    want = K.throttled(spark.createDataFrame(rows, "n long, t double, key string"), "key", "n", "t", 0.5)
    assert text_rows(got) == text_rows(want) and got.count() > 100


def test_snapshot_stream_equals_batch_changes(spark, tmp_path):
    rng = random.Random(6)
    snaps, rows, n = {}, [], 0
    for view in "vw":
        for version in range(25):
            shown = {f"i{k}": rng.choice("pq") for k in range(6) if rng.random() < 0.6}
            snaps[view, version] = shown
            for item, value in shown.items() or [(None, None)]:
                rows.append((n, version * 4.0, view, version, item, value, version == 9))
                n += 1
    schema = "n long, t double, view string, version long, item string, value string, resend boolean"
    out, _ = run_stream(spark, tmp_path, rows, schema, lambda s: S.changes(s, "20 seconds"), "shown")
    got = sorted(map(str, ((r.view, r.version, r.item, r.op, r.value) for r in O.results(out).where("version IS NOT NULL").collect())))
    want = []
    for (view, version), shown in snaps.items():
        before = snaps.get((view, version - 1), {})
        to_rows = lambda s: spark.createDataFrame(list(s.items()), "item string, value string")
        if version in (1, 2, 9, 10):
            for r in K.changes(to_rows(before), to_rows(shown), "item", "value").where("op IS NOT NULL").collect():
                want.append((view, version, r.item, r.op, r.value))
        else:
            want += [(view, version, i, "clear", None) for i in before if i not in shown] + [(view, version, i, "send", x) for i, x in shown.items() if before.get(i) != x]
        if version == 9:
            want += [(view, 9, i, "send", x) for i, x in shown.items() if before.get(i) == x]
    assert got == sorted(map(str, want))


def test_bus_stream_equals_batch(spark, tmp_path):
    rng = random.Random(9)
    rows = [(k, k / 2, rng.choice("rs"), rng.choice(["x", "y", "z", None])) for k in range(200)]
    handlers = [("x", 2), ("x", 1), ("y", 5)]
    schema = "n long, t double, room string, name string"
    out, _ = run_stream(spark, tmp_path, rows, schema, lambda s: S.dispatched(s.withColumnRenamed("n", "seq"), {"x": [2, 1], "y": [5]}, "20 seconds"), "calls")
    want = K.dispatched(spark.createDataFrame(rows, schema).withColumnRenamed("n", "seq"), spark.createDataFrame(handlers, "name string, registered int"))
    assert text_rows(O.results(out)) == text_rows(want.select("room", "seq", "registered", "call"))


class Entries(dict):
    """A state of values or of a map, by hand; counts what is written."""

    written = 0

    def get(self):
        return dict.get(self, None)

    def update(self, value):
        self[None] = value

    def getValue(self, key):
        return dict.get(self, key)

    def updateValue(self, key, value):
        self[key] = value
        self.written += 1

    def removeKey(self, key):
        del self[key]


class Handle:
    def getMapState(self, *_):
        return Entries()

    getValueState = getMapState

    def registerTimer(self, at):
        self.at = at


class Water:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


class Seen(O.Ordered):
    """Gives the events as they come, and notes the size of each call."""

    def __init__(self, key, output):
        super().__init__("name string", ["key", "seq"])
        self.output, self.sizes = output, []

    def apply(self, key, own, events):
        self.sizes.append(len(events))
        for e in events:
            yield (key, e["seq"])
        return (own or 0) + len(events)


def packs_of(rows):
    names = ["bucket", "__key", "at_us", "seq", "name"]
    kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    batches = [pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[k : k + 1000]), kinds)], names) for k in range(0, len(rows), 1000)]
    return [Row(**r) for b in O._packed(iter(batches)) for r in b.to_pylist()]


def given(out):
    return [tuple(r.values()) for pack in out for r in O._read(pack.rows).to_pylist()]


def test_events_wait_in_packs_and_are_handed_over_in_bounded_runs():
    rng = random.Random(4)
    times = rng.sample(range(10**6), 60_000)
    rows = [(0, "ab"[k % 3 == 0], 1000 * t, k, "x") for k, t in enumerate(times)]
    s = Seen("key", pa.schema([("key", pa.string()), ("seq", pa.int64()), ("late", pa.string())]))
    s.init(Handle())
    first, second = rows[:40_000], rows[40_000:]
    assert given(s.handleInputRows((0,), iter(packs_of(first)), Water(0))) == []
    assert len(s.waiting) <= 40_000 // O.PACK + 1 and s.handle.at == min(t for t in times[:40_000]) + 1
    # half of the time passes, then the rest comes, part of it too late for its key
    got = given(s.handleExpiredTimer((0,), Water(500_000), None))
    want = lambda key, lo, hi, part: [k for _, name, _, k, _ in sorted(part, key=lambda r: r[2]) if name == key and lo <= times[k] < hi]
    for key in "ab":
        assert [k for name, k, _ in got if name == key] == want(key, 0, 500_000, first)
    last = {key: times[want(key, 0, 500_000, first)[-1]] for key in "ab"}
    out = given(s.handleInputRows((0,), iter(packs_of(second)), Water(500_000))) + given(s.handleExpiredTimer((0,), Water(10**7), None))
    for key in "ab":
        assert [k for name, k, late in out if name == key and late is None] == want(key, last[key] + 1, 10**6, rows)
        assert sorted(json.loads(late)["seq"] for name, _, late in out if name == key and late) == sorted(want(key, 0, last[key] + 1, second))
    assert not s.waiting and max(s.sizes) <= O.PACK and s.waiting.written < 30


def test_an_event_without_time_goes_to_the_side_table():
    s = Seen("key", pa.schema([("key", pa.string()), ("seq", pa.int64()), ("late", pa.string())]))
    s.init(Handle())
    out = given(s.handleInputRows((0,), iter(packs_of([(0, None, 5, 2, "x"), (0, None, None, 1, None), (0, "k", 5, None, "y")])), Water(1)))
    assert [(k, seq, late and json.loads(late)["seq"]) for k, seq, late in out] == [(None, None, 1), ("k", None, None), (None, 2, None)]


def test_a_queue_counts_its_files_and_users():
    rng = random.Random(12)
    q, looks = Q.Queue(limit=3), []
    q.place = lambda file: looks.append(file) or Q.Queue.place(q, file)
    for _ in range(4000):
        q.apply({"action": rng.choice(["enqueue"] * 6 + ["front", "pop", "delete", "up", "bottom", "pause_user"]), "user": rng.choice("abcdefgh"), "file": f"f{rng.randrange(40)}"})
        assert q.files == Q.Counter(x["file"] for x in q.items) and q.users == Q.Counter(x["user"] for x in q.items)
        assert max(q.users.values(), default=0) <= 3
    assert 0 < len(looks) < 1300  # a request does not scan the queue for its file


def test_jobs_share_pages_of_state(monkeypatch):
    """6,000 events on 2,000 jobs in several runs, with a small bound on what a task holds: the jobs of the fold, few entries."""
    monkeypatch.setattr(K, "HELD", 900)
    p, jobs, fold, told, own = K.Jobs(), 2_000, K.Tracker(), {}, None
    p.start(Handle())
    events = []
    for k in range(jobs):
        v = {"url": f"e/watch?v=v{k}", "video": f"v{k}", "song_path": f"p{k}"}
        events += [{"name": name, **v} for name in ("download_queued", "song_downloaded", "song_deleted" if k % 5 == 0 else "processing_complete")]
    for a in range(0, len(events), 1_500):
        run = p.apply("r", own, events[a : a + 1_500])
        while True:
            try:
                _, k, _, removed, *x = next(run)
            except StopIteration as e:
                own = e.value
                break
            told[k] = None if removed else x
        told |= {k: None if removed else x for _, k, _, removed, *x in p.finish()}
    for e in events:
        fold.apply(e)
    assert own == [jobs, len(events)]
    assert [dict(zip(K.FIELDS, told[k])) for k in sorted(told) if told[k]] == fold.items and len(fold.items) == 1_600
    written = dict(zip(K.PAGES, (m.written for m in p.maps)))
    assert written["jobs"] <= jobs / 32 + 8 and written["urls"] == written["videos"] == 0 and written["paths"] < jobs


# catalogue


def paths(spark, *p):
    return spark.createDataFrame([(x,) for x in p], "file_path string")


def test_diff_cases(spark):
    found = lambda a, b: sorted((r.change, r.old_path or "", r.new_path or "") for r in C.diff(paths(spark, *a), paths(spark, *b)).collect())
    assert found([], []) == []
    assert found(["new/a.mp4"], ["old/a.mp4"]) == [("moved", "old/a.mp4", "new/a.mp4")]
    assert found(["x/a.mp4", "y/a.mp4"], ["old/a.mp4"]) == [("added", "", "x/a.mp4"), ("added", "", "y/a.mp4"), ("deleted", "old/a.mp4", "")]


def test_guard(spark):
    old = paths(spark, *(f"d/{k}.mp4" for k in range(10)))
    changes = C.diff(paths(spark, "d/0.mp4", "d/new.mp4"), old)
    assert tuple(C.guard(changes, old).first()) == (1, 0, 0, True)
    assert tuple(C.guard(changes, old, directory_changed=True).first()) == (1, 0, 9, False)
    assert C.directory_changed(old, "d", None).first().changed is False and C.directory_changed(old, "e", None).first().changed is True
    assert C.directory_changed(old, "e", "d").first().changed is True and C.directory_changed(old.limit(0), "e", None).first().changed is False


def test_snapshot_is_all_or_nothing(spark, tmp_path):
    old = paths(spark, "a", "b", "c")
    moves = spark.createDataFrame([("a", "z"), ("b", "z")], "old_path string, new_path string")
    after = C.apply_diff(old, moves, paths(spark, "n"), paths(spark, "c"))
    assert sorted(r.file_path for r in after.collect()) == ["a", "b", "c"]
    after = C.apply_diff(old, moves.limit(1), paths(spark, "n", "n", "b"), paths(spark, "c", "nothing"))
    assert sorted(r.file_path for r in after.collect()) == ["b", "n", "z"]
    C.publish(old, str(tmp_path), 1)
    C.publish(after, str(tmp_path), 2)
    assert C.current(spark, str(tmp_path)).count() == 3
    assert C.integrity(paths(spark, "a", "a", None)).first().asDict() == {"ok": False, "nulls": 1, "duplicates": 1}


def test_ids_are_gapless_with_payload_and_the_same_again(spark):
    rows = spark.range(400_000).select((F.col("id") * 7919 % 400_000).alias("n")).select(F.lit(0).cast("long").alias("id"), F.format_string("m/%06d.mp4", "n").alias("file_path"), F.repeat(F.lit("x"), 50).alias("payload")).repartition(9)
    target = spark.createDataFrame([(41, "a", "p"), (3, "b", "p")], "id long, file_path string, payload string")
    got = C.with_ids(target, rows)
    one = got.agg(F.count("*").alias("n"), F.count_distinct("id").alias("d"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.bool_and(F.col("id") - 42 == F.substring("file_path", 3, 6).cast("int")).alias("ordered")).first()
    assert (one.n, one.d, one.lo, one.hi, one.ordered) == (400_000, 400_000, 42, 400_041, True)
    again = C.with_ids(target, rows.repartition(4)).agg(F.sum(F.xxhash64("id", "file_path").cast("decimal(38,0)"))).first()[0]
    assert again == got.agg(F.sum(F.xxhash64("id", "file_path").cast("decimal(38,0)"))).first()[0]
    assert C.with_ids(target, rows.limit(0)).count() == 0
    assert [r.id for r in C.with_ids(target.limit(0), rows.limit(2)).orderBy("id").collect()] == [1, 2]


def test_throttle_and_bus_and_preview_equal_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    ticks = sorted((rng.choice("ab"), k, round(rng.random() * 20, 2)) for k in range(300))
    want, last = set(), {}
    for key, k, t in sorted(ticks, key=lambda x: (x[0], x[2], x[1])):
        if key not in last or t - last[key] >= 0.5:
            last[key] = t
            want.add((key, k))
    got = {(r.key, r.order) for r in K.throttled(spark.createDataFrame(ticks, "key string, n int, t double"), "key", "n", "t").collect()}
    assert got == want
    monkeypatch.setattr(K, "RUN", 7)
    events = [(rng.choice("rs"), k, rng.choice(["x", "y", "z"])) for k in range(80)]
    handlers = [("x", 2), ("x", 1), ("y", 5)]
    calls = {}
    for room in "rs":
        order = sorted((k, reg) for r, k, name in events if r == room for h, reg in handlers if h == name)
        calls |= {(room, *c): i for i, c in enumerate(order, 1)}
    got = K.dispatched(spark.createDataFrame(events, "room string, seq int, name string"), spark.createDataFrame(handlers, "name string, registered int"))
    assert {(r.room, r.seq, r.registered): r.call for r in got.collect()} == calls
    queue = [(rng.choice("rs"), k, f"f{k % 9}", "u", rng.random() < 0.4) for k in range(60)]
    got = {(r.room, r["rank"], r.position) for r in Q.preview(spark.createDataFrame(queue, "room string, position int, file string, user string, paused boolean")).collect()}
    assert got == {(room, i, q[1]) for room in "rs" for i, q in enumerate([q for q in queue if q[0] == room and not q[4]][:5])}

"""The request queue of a room as a fold over its events, in batch and as a stream.

Events are rows (room, seq, action, user, file, semitones, index, to). The same fold runs over a room's
sorted events (batch) and over stored state (stream). A room's queue is bounded by its users' limits.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle

from . import ordered

EXEMPT = frozenset(["System", "Randomizer"])


def fair_place(queue: list[dict], user: str, own: int) -> int:
    """Users take turns: before the first song of a later round than the user's next one, else last. `own` is the number
    of the user's songs."""
    seen: dict[str, int] = {}
    for k, x in enumerate(queue):
        other = x["user"]
        if (n := seen.get(other, 0)) > own:
            return k
        seen[other] = n + 1
    return len(queue)


class Queue:
    """The songs in order, with their files and the number of songs of each user, so that most events need no scan."""

    def __init__(self, items: list[dict] | None = None, playing: dict | None = None, limit: int = 0, fair: bool = True, exempt: frozenset[str] = EXEMPT) -> None:
        self.items, self.playing, self.limit, self.fair, self.exempt = items or [], playing, limit, fair, exempt
        self.files = Counter(x["file"] for x in self.items)
        self.users = Counter(x["user"] for x in self.items)

    def place(self, file: str) -> int:
        return next(k for k, x in enumerate(self.items) if x["file"] == file) if file in self.files else -1

    def limited(self, user: str) -> bool:
        if not self.limit or user in self.exempt:
            return False
        return self.users[user] + bool(self.playing and self.playing["user"] == user) >= self.limit

    def insert(self, k: int, item: dict) -> None:
        self.items.insert(k, item)
        self.files[item["file"]] += 1
        self.users[item["user"]] += 1

    def take(self, k: int) -> dict:
        item = self.items.pop(k)
        for counts, value in ((self.files, item["file"]), (self.users, item["user"])):
            counts[value] -= 1
            if not counts[value]:
                del counts[value]
        return item

    def move(self, old: int, new: int) -> bool:
        n = len(self.items)
        if not (0 <= old < n and 0 <= new < n):
            return False
        self.items.insert(new, self.items.pop(old))
        return True

    def apply(self, e: dict) -> bool:
        """Whether the event changed or was accepted."""
        action, user, file = e["action"], e.get("user"), e.get("file")
        held = file is not None and file in self.files
        last = len(self.items) - 1
        at = self.place(file) if held and action not in ("enqueue", "front") else -1
        match action:
            case "enqueue" | "front":
                if held or self.limited(user):
                    return False
                item = {"user": user, "file": file, "title": e.get("title") or file, "semitones": int(e.get("semitones") or 0), "paused": False}
                self.insert(0 if action == "front" else fair_place(self.items, user, self.users[user]) if self.fair else len(self.items), item)
                return True
            case "pop":
                k = next((k for k, x in enumerate(self.items) if not x["paused"]), None)
                self.playing = self.take(k) if k is not None else None
                return k is not None
            case "pause_song":
                if at >= 0:
                    self.items[at]["paused"] = not self.items[at]["paused"]
                return at >= 0
            case "pause_user":
                own = [x for x in self.items if x["user"] == user] if user in self.users else []
                state = not all(x["paused"] for x in own)
                for x in own:
                    x["paused"] = state
                return bool(own)
            case "clear":
                self.items, self.files, self.users = [], Counter(), Counter()
                return True
            case "delete":
                if at >= 0:
                    self.take(at)
                return at >= 0
            case "reorder":
                return self.move(int(e["index"]), int(e["to"]))
            case "up":
                return at >= 1 and self.move(at, at - 1)
            case "down":
                return 0 <= at < last and self.move(at, at + 1)
            case "top":
                return at >= 1 and self.move(at, 0)
            case "bottom":
                return 0 <= at < last and self.move(at, last)
        return False


ROWS = "room string, position int, user string, file string, title string, semitones int, paused boolean"


def _rows(room: str, q: Queue) -> pd.DataFrame:
    return pd.DataFrame([{"room": room, "position": k} | x for k, x in enumerate(q.items)], columns=[c.split()[0] for c in ROWS.split(", ")])


def fold(events: DataFrame, limit: int = 0, fair: bool = True) -> DataFrame:
    """The queue (ROWS) of each room after its events in the order of seq."""
    return ordered.folded(events, "room", "seq", lambda: Queue(limit=limit, fair=fair), _rows, ROWS)


EVENT = "action string, user string, file string, title string, semitones int, index int, to int"
_ITEM = "user string, file string, title string, semitones int, paused boolean"
_FIELDS = [f.split()[0] for f in _ITEM.split(", ")]


class Room(ordered.Ordered):
    """A room's queue in state: its songs and the one that plays, as JSON. What is ripe at a time reads and writes it
    once; it is bounded by the users' limits."""

    def __init__(self, limit: int, fair: bool) -> None:
        super().__init__(EVENT, [*(c.split()[0] for c in ROWS.split(", ")), "version"])
        self.limit, self.fair = limit, fair

    def start(self, handle: StatefulProcessorHandle) -> None:
        self.rooms = handle.getMapState("rooms", "room string", "queue string")
        self.open: dict[str | None, list] = {}

    def apply(self, key: str, own: None, events: list[dict]) -> Iterator[tuple]:
        if key not in self.open:
            found = self.rooms.getValue((key,))
            n, items, playing = json.loads(found[0]) if found else (0, [], None)
            self.open[key] = [n, Queue(items, playing, self.limit, self.fair)]
        for e in events:
            self.open[key][1].apply(e)
        self.open[key][0] += len(events)
        yield from ()

    def finish(self) -> Iterator[tuple]:
        for key, (n, q) in self.open.items():
            self.rooms.updateValue((key,), (json.dumps([n, q.items, q.playing]),))
            for k, x in enumerate(q.items):
                yield (key, k, *(x[f] for f in _FIELDS), n)
            if not q.items:
                yield (key, None, None, None, None, None, None, n)
        self.open = {}


def stream(events: DataFrame, limit: int = 0, fair: bool = True, delay: str = "10 seconds", at: str = "at") -> DataFrame:
    """The fold on a stream: the queues (ROWS, version, late) of the rooms whose events the watermark has passed;
    `version` is the number of a room's events so far, an empty queue is one row without a position."""
    return ordered.in_order(ordered.with_fields(events, EVENT), "room", Room(limit, fair), f"{ROWS}, version long", delay, at)


def present(changes: DataFrame) -> DataFrame:
    """The rooms' queues (ROWS) of their greatest version: what `fold` gives for the same events."""
    fields = [c.split()[0] for c in ROWS.split(", ")]
    queues = changes.groupBy("room", "version").agg(F.collect_list(F.struct(*fields)).alias("songs"))
    last = queues.groupBy("room").agg(F.max_by("songs", "version").alias("songs"))
    return last.select(F.inline("songs")).where("position IS NOT NULL")


def fair_order(requests: DataFrame, room: str = "room", user: str = "user", order: str = "seq") -> DataFrame:
    """For a history of requests only: the fair queue is the order by round, then by arrival. A row's place is
    the rows of earlier rounds, an offset per (room, round), and its place inside its round."""
    turn = F.row_number().over(W.partitionBy(room, user).orderBy(order)) - 1
    rounds = requests.withColumn("round", turn)
    sizes = rounds.groupBy(room, "round").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(room).orderBy("round").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(W.partitionBy(room, "round").orderBy(order)) - 1
    return rounds.withColumn("__k", inside).join(sizes.withColumn("__base", before).drop("__n"), [room, "round"]).withColumn("position", F.col("__base") + F.col("__k")).drop("__base", "__k")


def reordered(queue: DataFrame, old: int, new: int, position: str = "position") -> DataFrame:
    """Positions after one row moves; invalid indices are for the caller to reject."""
    p = F.col(position)
    shift = F.when((p > old) & (p <= new), p - 1).when((p < old) & (p >= new), p + 1).otherwise(p)
    return queue.withColumn(position, F.when(p == old, F.lit(new)).otherwise(shift))


def next_playable(queue: DataFrame, room: str = "room") -> DataFrame:
    """Per room the first row that is not paused."""
    return queue.where(~F.coalesce("paused", F.lit(False))).groupBy(room).agg(F.min_by("file", "position").alias("file"), F.min_by("user", "position").alias("user"))


def first_place(queue: DataFrame, requests: DataFrame, room: str = "room") -> DataFrame:
    """requests (room, file, ...) with `index`: the position of the first row with that file, -1 without one."""
    at = queue.groupBy(room, "file").agg(F.min("position").alias("index"))
    return requests.join(at, [room, "file"], "left").withColumn("index", F.coalesce("index", F.lit(-1)))


def owned(queue: DataFrame, requests: DataFrame, room: str = "room") -> DataFrame:
    """requests (room, file, user, ...) with `owned`: whether the first row with that file is the user's."""
    own = queue.groupBy(room, "file").agg(F.min_by("user", "position").alias("__owner"))
    return requests.join(own, [room, "file"], "left").withColumn("owned", F.coalesce(F.col("__owner") == F.col("user"), F.lit(False))).drop("__owner")


def preview(queue: DataFrame, n: int = 5, room: str = "room") -> DataFrame:
    """Per room the first n rows that are not paused. A list of n rows per task and room, then of those: an
    aggregate with bounded state instead of a window over the room."""
    open_ = queue.where(~F.coalesce("paused", F.lit(False)))
    part = W.partitionBy(room, "__part").orderBy("position")
    near = open_.withColumn("__part", F.pmod(F.xxhash64("position"), F.lit(64))).withColumn("__k", F.row_number().over(part)).where(F.col("__k") <= n)
    last = near.drop("__part", "__k").withColumn("rank", F.row_number().over(W.partitionBy(room).orderBy("position")) - 1)
    return last.where(F.col("rank") < n)


def paused_of(queue: DataFrame, room: str = "room") -> DataFrame:
    """(room, user, any_paused, all_paused)."""
    p = F.coalesce("paused", F.lit(False))
    return queue.groupBy(room, "user").agg(F.bool_or(p).alias("any_paused"), F.bool_and(p).alias("all_paused"))


def read_model(rows: DataFrame, fields: list[str], order: str, room: str = "room") -> DataFrame:
    """(room, body): what a view is sent, the room's rows in order as a JSON list. A view holds one room."""
    item = F.struct(F.col(order).alias("__at"), F.struct(*fields).alias("item"))
    return rows.groupBy(room).agg(F.to_json(F.array_sort(F.collect_list(item))["item"]).alias("body"))


def now_playing(playing: DataFrame, queue: DataFrame, room: str = "room") -> DataFrame:
    """(room, body): what is sent of a room's playback. playing: a row per room with what the player says; the next
    song that is not paused comes from the queue, and is null without one."""
    following = queue.where(~F.coalesce("paused", F.lit(False))).groupBy(room).agg(F.min_by(F.struct("title", "user"), "position").alias("__next"))
    both = playing.join(following, room, "left")
    state = [F.col(c) for c in playing.columns if c != room]
    item = F.struct(*state, F.col("__next.title").alias("up_next"), F.col("__next.user").alias("next_user"))
    return both.select(room, F.to_json(item, {"ignoreNullFields": "false"}).alias("body"))


def position_message(waiting: Column, active: Column, title: Column) -> Column:
    """What a requester is told: the place in line, counting the download that runs."""
    ahead = waiting + F.when(active, 1).otherwise(0)
    return F.when(ahead > 0, F.concat(F.lit("Download queued (#"), (ahead + 1).cast("string"), F.lit("): "), title)).otherwise(F.concat(F.lit("Download starting: "), title))


def counts_by_user(queue: DataFrame, playing: DataFrame, limit: int) -> DataFrame:
    """(room, user, n, limited): queued songs, one more if the user's song is playing."""
    both = queue.select("room", "user").unionByName(playing.select("room", "user"))
    return both.groupBy("room", "user").agg(F.count("*").alias("n")).withColumn("limited", (F.lit(limit) > 0) & ~F.col("user").isin(*EXEMPT) & (F.col("n") >= limit))

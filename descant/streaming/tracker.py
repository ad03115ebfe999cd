"""The job tracker: items move through download and processing as events come in; status and allowed
actions are derived at read. Events: (room, seq, name, url, song_path, title, user, error, method, video)."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle

from . import ordered
from .queue import read_model

#: Values of seq whose calls are put in order in one window.
RUN = 10_000
FIELDS = "title url user song_path download_status processing_status error_message cancelling lyric_method".split()
ROWS = "room string, place int, " + ", ".join(f"{f} {'boolean' if f == 'cancelling' else 'string'}" for f in FIELDS)


def video_of(url: str | None) -> str | None:
    """As functions.text.id_from_url."""
    parts = (url or "").split("watch?v=" if "v=" in (url or "") else "u.be/")
    return parts[1].split("?")[0] if len(parts) == 2 else None


class Tracker:
    """Jobs by number in the order of their downloads. Indexes from url and video id to the jobs whose download is
    open, and from path to jobs, so that an event reads the jobs that it names. The mappings are dictionaries
    in batch and maps of state in a stream. A null url or path names no job."""

    def __init__(self, jobs: Any = None, urls: Any = None, videos: Any = None, paths: Any = None, n: int = 0) -> None:
        self.jobs, self.urls, self.videos, self.paths = ({} if x is None else x for x in (jobs, urls, videos, paths))
        self.n = n

    @property
    def items(self) -> list[dict]:
        return [self.jobs.get(k) for k in sorted(self.jobs.keys())]

    def _of(self, index: Any, key: str | None) -> list[int]:
        return list(index.get(key) or []) if key is not None else []

    def _link(self, index: Any, key: str | None, k: int) -> None:
        if key is not None:
            index[key] = sorted({*self._of(index, key), k})

    def _unlink(self, index: Any, key: str | None, k: int) -> None:
        held = self._of(index, key)
        if k in held and len(held) > 1:
            index[key] = [x for x in held if x != k]
        elif held == [k]:
            index.pop(key)

    def _first(self, index: Any, key: str | None, holds: Callable[[dict], bool] = lambda x: True) -> int | None:
        return next((k for k in self._of(index, key) if holds(self.jobs.get(k))), None)

    def _set(self, k: int | None, **new: Any) -> None:
        if k is not None:
            self.jobs[k] = self.jobs.get(k) | new

    def _close(self, k: int | None, **new: Any) -> None:
        """The download has ended: url and video name this job no more."""
        if k is not None:
            url = self.jobs.get(k)["url"]
            self._unlink(self.urls, url, k)
            self._unlink(self.videos, video_of(url), k)
            self._set(k, **new)

    def _remove(self, k: int) -> None:
        self._close(k)
        self._unlink(self.paths, self.jobs.get(k)["song_path"], k)
        self.jobs.pop(k)

    def apply(self, e: dict) -> None:
        url, path = e.get("url"), e.get("song_path")
        match e["name"]:
            case "download_queued":
                k, self.n = self.n, self.n + 1
                self.jobs[k] = dict.fromkeys(FIELDS) | {"title": e.get("title"), "url": url, "user": e.get("user"), "download_status": "pending", "processing_status": "waiting", "cancelling": False}
                self._link(self.urls, url, k)
                self._link(self.videos, video_of(url), k)
            case "download_started":
                self._set(self._first(self.urls, url, lambda x: x["download_status"] == "pending"), download_status="active")
            case "song_downloaded":
                k = self._first(self.videos, e.get("video") or None)
                self._close(k, song_path=path, download_status="complete")
                if k is not None:
                    self._link(self.paths, path, k)
            case "download_error":
                self._close(self._first(self.urls, url), download_status="error", error_message=e.get("error") or "Unknown error")
            case "processing_complete":
                said = {"lyric_method": e["method"]} if e.get("method") is not None else {}
                self._set(self._first(self.paths, path), processing_status="complete", **said)
            case "processing_error":
                self._set(self._first(self.paths, path), processing_status="error", error_message=e.get("error") or "Unknown error")
            case "cancel":
                self._set(self._first(self.paths, path), cancelling=True)
            case "processing_cancelled":
                k = self._first(self.paths, path, lambda x: x["cancelling"])
                if k is not None:
                    self._remove(k)
            case "song_deleted" | "processing_skipped":
                for k in self._of(self.paths, path):
                    self._remove(k)


def _rows(room: str, t: Tracker) -> pd.DataFrame:
    return pd.DataFrame([{"room": room, "place": k} | x for k, x in enumerate(t.items)], columns=["room", "place", *FIELDS])


def fold(events: DataFrame) -> DataFrame:
    return ordered.folded(events, "room", "seq", Tracker, _rows, ROWS)


def _hashed(pages: int) -> Callable[[str], int]:
    return lambda key: zlib.crc32(key.encode("utf-8", "surrogatepass")) % pages


EVENT = "name string, url string, song_path string, title string, user string, error string, method string, video string"
_JOB = ", ".join(f"{f} {'boolean' if f == 'cancelling' else 'string'}" for f in FIELDS)
#: The maps of a room in state with the page of a key, and entries of pages that a task holds before it writes them.
PAGES: dict[str, Callable[[Any], int]] = {"jobs": lambda k: k // 32, "urls": _hashed(64), "videos": _hashed(64), "paths": _hashed(1_024)}
HELD = 131_072
CHANGES = f"room string, job long, version long, removed boolean, {_JOB}"


class Jobs(ordered.Ordered):
    """Rooms' jobs in pages of state: an event reads and writes the pages of the jobs that it names, however many the room
    has. Jobs that follow each other share a page; names are dealt to a fixed number of pages of a room. What it gives
    is each job that changed, with the number of the room's events so far."""

    def __init__(self) -> None:
        super().__init__(EVENT, ["room", "job", "version", "removed", *FIELDS])

    def start(self, handle: StatefulProcessorHandle) -> None:
        self.maps = [handle.getMapState(name, "room string, page long", "entries string") for name in PAGES]
        self.open: dict[str | None, list] = {}

    def apply(self, key: str, own: list[int] | None, events: list[dict]) -> Iterator[tuple]:
        n, version = own or (0, 0)
        if key not in self.open:
            jobs, *indexes = (ordered.Paged(x, key, page_of) for x, page_of in zip(self.maps, PAGES.values(), strict=True))
            jobs.load, jobs.store = lambda v: dict(zip(FIELDS, v, strict=True)), lambda x: [x[f] for f in FIELDS]
            self.open[key] = [Tracker(jobs, *indexes, n), version]
        t = self.open[key][0]
        for e in events:
            t.apply(e)
        version += len(events)
        self.open[key][1] = version
        if sum(x.size for t, _ in self.open.values() for x in (t.jobs, t.urls, t.videos, t.paths)) >= HELD:
            yield from self.finish()
        return [t.n, version]

    def finish(self) -> Iterator[tuple]:
        for key, (t, version) in self.open.items():
            for x in (t.urls, t.videos, t.paths):
                x.flush()
            for k, x in t.jobs.flush():
                yield (key, k, version, x is None, *((x or {}).get(f) for f in FIELDS))
        self.open = {}


def stream(events: DataFrame, delay: str = "10 seconds", at: str = "at") -> DataFrame:
    """Changed jobs (CHANGES, late) of a stream of events; a job's row of the greatest version is its present state."""
    return ordered.in_order(ordered.with_fields(events, EVENT), "room", Jobs(), CHANGES, delay, at)


def present(changes: DataFrame) -> DataFrame:
    """The rooms' jobs (ROWS) after all changes: what `fold` gives for the same events."""
    last = changes.groupBy("room", "job").agg(F.max_by(F.struct("removed", *FIELDS), "version").alias("x")).where("NOT x.removed")
    place = F.row_number().over(W.partitionBy("room").orderBy("job")) - 1
    return last.select("room", place.alias("place"), *(F.col(f"x.{f}") for f in FIELDS))


def status(active: Column, pending: Column) -> Column:
    """Processing status at read: cancelling, waiting for the download, active, pending, else what events said."""
    said = F.when(F.col("processing_status").isin("complete", "error"), F.col("processing_status")).otherwise("complete")
    return (
        F.when(F.col("cancelling"), "cancelling")
        .when(F.col("song_path").isNull(), F.when(F.col("download_status") == "error", "error").otherwise("waiting"))
        .when(F.coalesce(F.col("song_path") == active, F.lit(False)), "active")
        .when(F.coalesce(F.array_contains(pending, F.col("song_path")), F.lit(False)), "pending")
        .otherwise(said)
    )


def actions(admin: Column, viewer: Column, state: str = "processing_status") -> Column:
    """What the viewer may do with an item."""
    s, d = F.col(state), F.col("download_status")
    going, ended = d.isin("active", "pending") | s.isin("active", "pending"), d.isin("complete", "error") | s.isin("complete", "error")
    owner = F.coalesce(F.col("user") == viewer, F.lit(False))
    free = ~F.col("cancelling")
    done = (d == "complete") & (s == "complete") & F.col("song_path").isNotNull()
    return F.array_compact(F.array(F.when(free & going & (admin | owner), "cancel"), F.when(free & ended & admin, "remove"), F.when(free & done, "enqueue")))


def processing_status(items: DataFrame, active: Column, pending: Column, admin: Column, viewer: Column) -> DataFrame:
    """(room, body): what a viewer is sent of a room's jobs, in their order, with status and allowed actions as of now.
    `active` is the path that is being processed, `pending` those that wait."""
    now = items.withColumn("processing_status", status(active, pending)).withColumn("actions", actions(admin, viewer))
    return read_model(now, [*FIELDS, "actions"], "place")


def throttled(ticks: DataFrame, key: str, order: str, at: str, every: float = 0.5) -> DataFrame:
    """(key, at, order) of the ticks that are at least `every` seconds after the last one let through. Ticks are
    sorted by key and time inside partitions and streamed through; a task keeps one time, whatever a key holds."""
    kinds = {f.name: f.dataType.simpleString() for f in ticks.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = None, 0.0
        for batch in batches:
            go = []
            for k, (name, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if (name,) != held or t - last >= every:
                    held, last = (name,), t
                    go.append(k)
            yield batch.take(pa.array(go, pa.int64()))

    rows = ticks.select(key, F.col(at).cast("double").alias("at"), F.col(order).alias("order")).repartition(key).sortWithinPartitions(key, "at", "order")
    return rows.mapInArrow(run, f"`{key}` {kinds[key]}, at double, order {kinds[order]}")


def changes(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, op, value): what a view has to send or clear to go from one snapshot to the next; equal rows stay silent."""
    a, b = before.select(key, F.col(value).alias("a"), F.lit(True).alias("in_a")), after.select(key, F.col(value).alias("b"), F.lit(True).alias("in_b"))
    both = a.join(b, key, "full_outer")
    op = F.when(F.col("in_b").isNull(), "clear").when(F.col("in_a").isNull() | ~F.col("a").eqNullSafe(F.col("b")), "send")
    return both.select(key, op.alias("op"), F.col("b").alias(value)).where("op is not null")


def dispatched(events: DataFrame, handlers: DataFrame) -> DataFrame:
    """The bus: every (event, handler of its name) with its call order: by seq, then by registration. A call's
    place is the number of calls of earlier events, summed per run of seq, and its place among its event's own."""
    met = events.join(handlers, "name")
    per = met.groupBy("room", "seq").agg(F.count("*").alias("__n")).withColumn("__run", F.floor(F.col("seq") / RUN))
    before = lambda *by: F.coalesce(F.sum("__n").over(W.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = per.groupBy("room", "__run").agg(F.sum("__n").alias("__n")).withColumn("__base", before("room", "__run")).drop("__n")
    placed = per.withColumn("__in", before("room", "__run", "seq")).join(runs, ["room", "__run"]).select("room", "seq", (F.col("__base") + F.col("__in")).alias("__before"))
    own = F.row_number().over(W.partitionBy("room", "seq").orderBy("registered"))
    return met.withColumn("call", own).join(placed, ["room", "seq"]).withColumn("call", F.col("__before") + F.col("call")).drop("__before")

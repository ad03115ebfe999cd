"""Throttled ticks, changes between snapshots and the calls of the bus as streams. Each equals its batch form in
`tracker` (throttled, changes, dispatched) however the stream is cut, for events within the delay."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle

from . import ordered


class Throttle(ordered.Ordered):
    """State: the time of the last tick that was let through."""

    def __init__(self, every: float) -> None:
        super().__init__("tick double", ["key", "at", "order"])
        self.every = every

    def apply(self, key: str, own: float | None, events: list[dict]) -> Iterator[tuple]:
        last = own
        for e in events:
            if last is None or e["tick"] - last >= self.every:
                last = e["tick"]
                yield (key, last, e["seq"])
        return last


def throttled(ticks: DataFrame, key: str, order: str, at: str, every: float = 0.5, delay: str = "10 seconds") -> DataFrame:
    """(key, at, order, late) of the ticks that are at least `every` seconds after the last one let through; `at` is in
    seconds, ticks of one time are taken by `order`."""
    rows = ticks.select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("seq"), F.col(at).cast("double").alias("tick"))
    rows = rows.withColumn("at", F.timestamp_micros(F.floor(F.col("tick") * 1_000_000).cast("long")))
    return ordered.in_order(rows, "key", Throttle(every), "key string, at double, order long", delay)


class Shown(ordered.Ordered):
    """State: what the view was sent last. All rows of one version are one snapshot; a row without an item says
    only that the snapshot exists, and `resend` sends what is unchanged as well."""

    def __init__(self) -> None:
        super().__init__("item string, value string, resend boolean", ["view", "version", "item", "op", "value"])

    def start(self, handle: StatefulProcessorHandle) -> None:
        self.sent = handle.getMapState("sent", "view string", "items string")

    def apply(self, key: str, own: None, events: list[dict]) -> Iterator[tuple]:
        found = self.sent.getValue((key,))
        sent = json.loads(found[0]) if found else {}
        versions: dict[int, list[dict]] = {}
        for e in events:
            versions.setdefault(e["seq"], []).append(e)
        for version, rows in versions.items():
            wanted = {e["item"]: e["value"] for e in rows if e["item"] is not None}
            again = any(e["resend"] for e in rows)
            for item in sorted(sent.keys() | wanted.keys()):
                if item not in wanted:
                    yield (key, version, item, "clear", None)
                elif again or item not in sent or sent[item] != wanted[item]:
                    yield (key, version, item, "send", wanted[item])
            sent = wanted
        self.sent.updateValue((key,), (json.dumps(sent),))


def changes(snapshots: DataFrame, delay: str = "10 seconds", at: str = "at") -> DataFrame:
    """(view, version, item, op, value, late) for a stream (view, version, at, item, value, resend) of snapshots: what
    the view has to send or clear to go from each version to the next; equal items stay silent."""
    rows = ordered.with_fields(snapshots, "view string, item string, value string, resend boolean").withColumn("seq", F.col("version").cast("long"))
    return ordered.in_order(rows, "view", Shown(), "view string, version long, item string, op string, value string", delay, at)


class Bus(ordered.Ordered):
    """State: the number of calls so far."""

    def __init__(self, handlers: dict[str, list[int]]) -> None:
        super().__init__("name string", ["room", "seq", "registered", "call"])
        self.handlers = {k: sorted(v) for k, v in handlers.items()}

    def apply(self, key: str, own: int | None, events: list[dict]) -> Iterator[tuple]:
        n = own or 0
        for e in events:
            for registered in self.handlers.get(e["name"], ()):
                n += 1
                yield (key, e["seq"], registered, n)
        return n


def dispatched(events: DataFrame, handlers: dict[str, list[int]], delay: str = "10 seconds", at: str = "at") -> DataFrame:
    """(room, seq, registered, call, late): every call of a handler, numbered per room by the events' order, then by
    registration. `handlers` maps an event's name to its places of registration."""
    rows = ordered.with_fields(events, "room string, name string")
    return ordered.in_order(rows, "room", Bus(handlers), "room string, seq long, registered int, call long", delay, at)

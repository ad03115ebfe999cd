"""Streams in the order of time: a buffer in state holds a key's events until the watermark passes them.

An event is (key, at, seq, ...). `Ordered` hands a key's events to `apply` in the order of (at, seq), in runs of
those that the watermark has passed, whatever micro-batches they came in. A timer at the first waiting event's
time wakes the buffer when no new event does. An event that comes behind one of its key that was handed over
already, or has no time, is not applied: it goes to a side table, as JSON in the column `late`. So the result does
not depend on how the stream is cut, and equals the batch's as long as no event is later than the delay.

State is read and written over a socket, an entry at a time, so events travel and wait in packs: Arrow batches of up to
PACK events as one binary value, made before the shuffle and undone after the operator. Keys are dealt to BUCKETS
buckets, and a bucket is what state is grouped by: many keys of few events share packs, and a pack or two in memory
serve a key of many. Packs are merged in the order of their first times, as they overlap. Processors keep the rest
of their state in maps of their own, by key.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import islice
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, MapState, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import StructType

from ..session import shared_dir

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of a batch between Spark and the processor: each is a pack.
ROWS_A_BATCH = "spark.sql.execution.arrow.transformWithStateInPandas.maxRecordsPerBatch"

#: Events of a pack, events that a task sorts into packs at a time, their bytes, and groups of keys in state.
PACK, HELD, HELD_BYTES, BUCKETS = 8_192, 262_144, 32 << 20, 512
NO_TIME = -(2**63)


class Paged:
    """The part of a map state under one first key, as pages of many entries (JSON), since each entry of state that is read
    or written costs a message. `page_of` gives the number of a key's page. A page is read at most once, those that
    changed are written by `flush`; `size` is the number of entries in memory."""

    def __init__(self, state: MapState, owner: Any, page_of: Callable[[Any], int], load: Callable[[Any], Any] = lambda v: v, store: Callable[[Any], Any] = lambda v: v) -> None:
        self.state, self.owner, self.page_of, self.load, self.store = state, owner, page_of, load, store
        self.pages: dict[int, dict[Any, Any]] = {}
        self.stored: set[int] = set()
        self.changed: set[Any] = set()
        self.size = 0

    def _page(self, number: int) -> dict[Any, Any]:
        if number not in self.pages:
            found = self.state.getValue((self.owner, number))
            if found is not None:
                self.stored.add(number)
            self.pages[number] = {k: self.load(v) for k, v in json.loads(found[0])} if found is not None else {}
            self.size += len(self.pages[number])
        return self.pages[number]

    def get(self, key: Any) -> Any:
        return self._page(self.page_of(key)).get(key)

    def __setitem__(self, key: Any, value: Any) -> None:
        page = self._page(self.page_of(key))
        self.size += key not in page
        page[key] = value
        self.changed.add(key)

    def pop(self, key: Any) -> None:
        self.size -= self._page(self.page_of(key)).pop(key, None) is not None
        self.changed.add(key)

    def keys(self) -> list:
        """All keys of the map: reads the whole of it."""
        for owner, number in [k for k in self.state.keys() if k[0] == self.owner]:
            self._page(number)
        return sorted(k for page in self.pages.values() for k in page)

    def flush(self) -> list[tuple[Any, Any]]:
        """Write the pages that changed and return the changes; None stands for a key that is gone."""
        out = [(k, self.get(k)) for k in sorted(self.changed)]
        for number in sorted({self.page_of(k) for k in self.changed}):
            if page := self.pages[number]:
                self.state.updateValue((self.owner, number), (json.dumps([[k, self.store(v)] for k, v in page.items()]),))
            elif number in self.stored:
                self.state.removeKey((self.owner, number))
        self.pages, self.stored, self.changed, self.size = {}, set(), set(), 0
        return out


def _written(rows: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write(rows)
    return sink.getvalue().to_pybytes()


def _read(pack: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(bytes(pack))).read_all()


def _longs(rows: pa.Table, name: str) -> np.ndarray:
    """A column of numbers; null stands before all."""
    return pc.fill_null(rows.column(name), NO_TIME).to_numpy()


def _sorted(rows: pa.Table) -> pa.Table:
    return rows.take(pa.array(np.lexsort((_longs(rows, "seq"), _longs(rows, "at_us")))))


def _values(column: pa.ChunkedArray) -> list:
    plain = pa.types.is_string(column.type) or (pa.types.is_primitive(column.type) and not column.null_count)
    return column.to_numpy().tolist() if plain else column.to_pylist()


def _packs(rows: pa.Table) -> Iterator[tuple[int, bytes]]:
    """(first time, pack) of sorted rows."""
    at = _longs(rows, "at_us")
    for k in range(0, len(at), PACK):
        yield int(at[k]), _written(rows.slice(k, PACK).combine_chunks())


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events (bucket, key, at_us, seq, ...) as rows (bucket, low, events) of packs."""

    def packs(held: list[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        rows = pa.Table.from_batches(held)
        bucket = rows.column("bucket").to_numpy()
        order = np.lexsort((_longs(rows, "seq"), _longs(rows, "at_us"), bucket))
        rows, bucket = rows.drop_columns(["bucket"]).take(pa.array(order)), bucket[order]
        edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        for a, b in zip(edges, edges[1:]):
            for low, pack in _packs(rows.slice(a, b - a)):
                yield int(bucket[a]), low, pack

    def all_packs() -> Iterator[tuple[int, int, bytes]]:
        held, n, size = [], 0, 0
        for batch in batches:
            held.append(batch)
            n, size = n + batch.num_rows, size + batch.nbytes
            if n >= HELD or size >= HELD_BYTES:
                yield from packs(held)
                held, n, size = [], 0, 0
        if n:
            yield from packs(held)

    found = all_packs()
    while some := list(islice(found, 64)):
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*some), (pa.int32(), pa.int64(), pa.binary()))], ["bucket", "low", "events"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for pack in batch.column(0):
            yield from pa.ipc.open_stream(pack.as_buffer()).read_all().to_batches()


class Ordered(StatefulProcessor):
    """`fields` are the columns of events after (key, at_us, seq) as DDL; `columns` those of output before `late`."""

    def __init__(self, fields: str, columns: list[str]) -> None:
        self.fields, self.columns = fields, columns
        self.names = ["at_us", "seq", *(f.split()[0] for f in _split(fields))]
        self.output: pa.Schema | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "n long", "events binary")
        self.index = handle.getValueState("index", "n long, packs array<long>, lows array<long>")
        self.marks = handle.getValueState("marks", "text string")
        self.start(handle)

    def start(self, handle: StatefulProcessorHandle) -> None:
        """Make the state of the processor."""

    def apply(self, key: Any, own: Any, events: list[dict]) -> Iterator[tuple]:
        """Rows of output for events in order. `own` is what the last call for the key returned: a small value, None at first."""
        raise NotImplementedError

    def finish(self) -> Iterator[tuple]:
        """Rows of output once all events that are ripe now were applied."""
        return iter(())

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        yield from self._given(self._run(rows, timerValues))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        yield from self._given(self._run(iter(()), timerValues))

    def _given(self, out: Iterator[tuple]) -> Iterator[Row]:
        """Output in packs; what has no `late` of its own gets a null."""
        width = len(self.output)
        while some := list(islice(out, PACK)):
            columns = zip(*(x if len(x) == width else (*x, None) for x in some), strict=True)
            yield Row(rows=_written(pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, self.output, strict=True)], schema=self.output)))

    def _run(self, new: Iterator[Row], timer: TimerValues) -> Iterator[tuple]:
        # of each key of the bucket: the place of the event that was handed over last, and the processor's own value
        marks = {key: tuple(m) for key, *m in json.loads((self.marks.get() or ("[]",))[0])}
        n, numbers, lows = self.index.get() or (0, [], [])
        waiting = dict(zip(numbers, lows, strict=True))
        newest = max((m[0] for m in marks.values()), default=NO_TIME)
        for r in new:
            low, pack = r.low, r.events
            if low <= newest:
                rows, late = self._parted(_read(pack), marks, newest)
                for key, e in late:
                    yield (key, *[None] * (len(self.columns) - 1), json.dumps(e, default=str, sort_keys=True))
                if not rows.num_rows:
                    continue
                [(low, pack)] = _packs(rows)
            self.waiting.updateValue((n,), (pack,))
            waiting[n] = low
            n += 1
        water = timer.getCurrentWatermarkInMs()
        ripe = sorted((low, k) for k, low in waiting.items() if low // 1000 < water)
        if ripe:
            rest = yield from self._hand_over(ripe, water * 1000, marks)
            yield from self.finish()
            for _, k in ripe:
                del waiting[k]
            for low, pack in _packs(rest):
                self.waiting.updateValue((n,), (pack,))
                waiting[n] = low
                n += 1
            self.marks.update((json.dumps([[key, *m] for key, m in marks.items()]),))
        self.index.update((n, list(waiting), list(waiting.values())))
        if waiting:
            self.handle.registerTimer(max(water, min(waiting.values()) // 1000) + 1)

    def _parted(self, rows: pa.Table, marks: dict, newest: int) -> tuple[pa.Table, list[tuple[Any, dict]]]:
        """The events that are in time, and those that are late with their keys."""
        at, seq, keys = _longs(rows, "at_us"), _longs(rows, "seq"), rows.column(0)
        late = np.zeros(len(at), bool)
        for k in np.flatnonzero(at <= newest):
            last = marks.get(keys[int(k)].as_py())
            late[k] = at[k] == NO_TIME or last is not None and (at[k], seq[k]) <= _place(*last[:2])
        behind = rows.filter(pa.array(late))
        return rows.filter(pa.array(~late)), list(zip(behind.column(0).to_pylist(), self._events(behind), strict=True))

    def _events(self, rows: pa.Table) -> list[dict]:
        return [dict(zip(self.names, e, strict=True)) for e in zip(*map(_values, rows.columns[1:]), strict=True)]

    def _hand_over(self, ripe: list[tuple[int, int]], end: int, marks: dict) -> Iterator[tuple]:
        """Apply the events before `end` of packs (low, number) that leave the state; returns the others. What is before
        the next pack's first time is in order once it is sorted. The pool is sorted when it has doubled, so packs that
        all overlap cost no more than a sort of them all."""
        pool, n, limit = [], 0, 2 * PACK
        for (_, k), (following, _) in zip(ripe, [*ripe[1:], (end, -1)], strict=True):
            pool.append(_read(self.waiting.getValue((k,))[0]))
            self.waiting.removeKey((k,))
            n += pool[-1].num_rows
            if n >= limit or k == ripe[-1][1]:
                rows = _sorted(pa.concat_tables(pool))
                cut = int(np.searchsorted(_longs(rows, "at_us"), min(following, end)))
                yield from self._calls(rows.slice(0, cut), marks)
                pool, n = [rows.slice(cut)], rows.num_rows - cut
                limit = max(2 * PACK, 2 * n)
        return pool[0]

    def _calls(self, rows: pa.Table, marks: dict) -> Iterator[tuple]:
        """Apply sorted events, PACK at a time; those of one time stay together."""
        at, seq, a = _longs(rows, "at_us"), _longs(rows, "seq"), 0
        while a < len(at):
            b = int(np.searchsorted(at, at[min(a + PACK, len(at)) - 1], side="right"))
            part, tied = rows.slice(a, b - a), bool(((np.diff(at[a:b]) == 0) & (np.diff(seq[a:b]) == 0)).any())
            groups: dict[Any, list[dict]] = {}
            for key, e in zip(_values(part.column(0)), self._events(part), strict=True):
                groups.setdefault(key, []).append(e)
            for key, events in groups.items():
                if tied:
                    events.sort(key=lambda e: (_place(e["at_us"], e["seq"]), json.dumps(e, default=str, sort_keys=True)))
                own = yield from self.apply(key, marks[key][2] if key in marks else None, events)
                marks[key] = (events[-1]["at_us"], events[-1]["seq"], own)
            a = b


def _place(at: int, seq: int | None) -> tuple[int, int]:
    return at, NO_TIME if seq is None else seq


def _split(ddl: str) -> list[str]:
    """Top-level columns of a DDL."""
    out, depth = [""], 0
    for c in ddl:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def in_order(events: DataFrame, key: str, processor: Ordered, output: str, delay: str, at: str = "at", seq: str = "seq") -> DataFrame:
    """The processor over a stream of events, which wait until the watermark, `delay` behind the latest `at`, has passed
    them. Times are passed on as numbers, so that Spark drops none before the buffer sees it."""
    spark = events.sparkSession
    spark.conf.set(PROVIDER, ROCKSDB)
    spark.conf.set(ROWS_A_BATCH, "64")
    names = [f.split()[0] for f in _split(processor.fields)]
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("bucket")
    own: list[Column] = [bucket, F.col(key).alias("__key"), F.unix_micros(at).alias("at_us"), F.col(seq).cast("long").alias("seq"), *(F.col(n) for n in names)]
    packs = events.withWatermark(at, delay).select(*own).mapInArrow(_packed, "bucket int, low long, events binary")
    rows = f"{output}, late string"
    processor.output = to_arrow_schema(StructType.fromDDL(rows))
    return packs.groupBy("bucket").transformWithState(processor, "rows binary", "Append", "EventTime").mapInArrow(_unpacked, rows)


def folded(events: DataFrame, key: str, seq: str, new: Callable[[], Any], rows: Callable[[Any, Any], pd.DataFrame], output: str) -> DataFrame:
    """The same in batch: `rows(key, state)` after `state.apply` of each of a key's events in the order of seq. Events are
    sorted by key inside partitions and streamed through, so a task keeps one state, not a key's events."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, state = None, None
        for frame in frames:
            for e in frame.astype(object).where(frame.notna(), None).to_dict("records"):
                if state is None or e[key] != held:
                    if state is not None:
                        yield rows(held, state)
                    held, state = e[key], new()
                state.apply(e)
        if state is not None:
            yield rows(held, state)

    return events.repartition(key).sortWithinPartitions(key, seq).mapInPandas(run, output)


def replay(history: DataFrame, key: str, stream: Callable[[DataFrame], DataFrame], cuts: int = 3, at: str = "at", seq: str = "seq") -> DataFrame:
    """Runs a stored history through a stream of `in_order`, to fill its output or state before live events come:
    slices of time are added to a folder one by one, and the stream takes up each from its checkpoint. At last an event
    of each key a year ahead lets the watermark pass all others; it stays in the buffer itself. Slices are
    sorted by time, so that packs of events hardly overlap."""
    spark, folder = history.sparkSession, shared_dir(history.sparkSession)
    other = spark.newSession()
    other.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    span = history.agg(F.unix_micros(F.min(at)).alias("low"), F.unix_micros(F.max(at)).alias("high"), F.max(seq).alias("seq")).first()
    low, high = (span["low"], span["high"]) if span["low"] is not None else (0, 0)
    slice_of = F.coalesce(F.floor((F.unix_micros(at) - low) * cuts / (high - low + 1)), F.lit(0))
    ends = {key: F.col(key), at: F.timestamp_micros(F.lit(high + 365 * 86_400_000_000)), seq: F.lit((span["seq"] or 0) + 1)}
    closing = history.select(key).distinct().select(*(ends.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in history.schema))
    for part in [*(history.where(slice_of == k).sort(at, seq) for k in range(cuts)), closing]:
        part.write.mode("append").parquet(f"{folder}/in")
        out = stream(other.readStream.schema(history.schema).parquet(f"{folder}/in"))
        query = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def with_fields(events: DataFrame, fields: str) -> DataFrame:
    """Events with all columns of the DDL; those they lack are null."""
    kinds = dict(f.split(maxsplit=1) for f in _split(fields))
    return events.withColumns({n: (F.col(n) if n in events.columns else F.lit(None)).cast(k) for n, k in kinds.items()})


def results(stream_output: DataFrame) -> DataFrame:
    return stream_output.where("late IS NULL").drop("late")


def late_events(stream_output: DataFrame, key: str) -> DataFrame:
    """The side table: (key, event) of events that came too late to be applied in order."""
    return stream_output.where("late IS NOT NULL").select(key, F.col("late").alias("event"))

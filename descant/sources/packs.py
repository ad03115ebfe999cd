"""Song packs: many small texts (stamped lyrics, captions, karaoke scripts, bundles) in few files, as a data source.

`spark.read.format("songpack").load(path)` gives rows (stem, kind, body); the column forms of the readers and
renderers take and make the bodies. A pack is a data file with the bodies one after the other and an index with a
line per text: stem, kind, offset and length. A manifest lists the packs of a version, with bytes, number and the
smallest and largest stem of each, so that a reader plans by bytes and leaves out packs by stem without opening them.

Tasks write packs of about PART_BYTES under names of their own and report them; the commit puts the next
manifest in place by a rename, and only what a manifest lists is ever read. A task that fails deletes its packs, an
aborted job the folder of all of them. Append lists the earlier packs too, overwrite does not and then deletes
them. One writer at a time.

Options: `path`, as a plain path or a URI that PyArrow opens (file, hdfs, s3, gs); `split`, bytes of a partition;
`stems`, a JSON list of the stems wanted.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "songpack"
PART_BYTES, SPLIT_BYTES = 128 << 20, 32 << 20
SCHEMA = "stem string, kind string, body string"


class _Folder:
    """A folder of packs."""

    def __init__(self, path: str) -> None:
        self.fs, self.root = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)

    def of(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        with self.fs.open_input_file(self.of(name)) as f:
            return f.read_at(f.size() - offset if length is None else length, offset)

    def write(self, name: str, data: bytes) -> None:
        with self.fs.open_output_stream(self.of(name)) as f:
            f.write(data)

    def delete(self, names: Iterable[str]) -> None:
        for name in names:
            if self.fs.get_file_info(self.of(name)).type == pafs.FileType.File:
                self.fs.delete_file(self.of(name))

    def versions(self) -> list[int]:
        found = self.fs.get_file_info(pafs.FileSelector(self.of("manifests"), allow_not_found=True))
        return sorted(int(x.base_name[:-5]) for x in found if x.base_name.endswith(".json") and x.base_name[:-5].isdigit())

    def packs(self) -> tuple[int, list[dict]]:
        """The last version and its packs."""
        last = max(self.versions(), default=0)
        return last, json.loads(self.read(f"manifests/{last:012d}.json")) if last else []

    def publish(self, version: int, packs: list[dict]) -> None:
        draft = f"manifests/{uuid.uuid4().hex}.draft"
        self.write(draft, json.dumps(packs).encode())
        self.fs.move(self.of(draft), self.of(f"manifests/{version:012d}.json"))


@dataclass
class Written(WriterCommitMessage):
    packs: list[dict]


@dataclass
class Part(InputPartition):
    """The texts of a pack that start in a range of its bytes."""

    pack: str
    low: int
    high: int


class _Writer(DataSourceWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool) -> None:
        lacks = {"stem", "kind", "body"} - set(schema.names)
        if lacks:
            raise ValueError(f"a song pack has the columns {SCHEMA}; missing: {sorted(lacks)}")
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex
        folder = _Folder(path)
        for name in ("manifests", f"data/{self.job}"):
            folder.fs.create_dir(folder.of(name), recursive=True)

    def write(self, iterator: Iterator[Row]) -> Written:
        folder, packs, out = _Folder(self.path), [], None
        try:
            for row in iterator:
                if out is None:
                    pack = {"name": f"data/{self.job}/{uuid.uuid4().hex}", "bytes": 0, "songs": 0, "first": None, "last": None}
                    packs.append(pack)
                    lines: list[str] = []
                    out = folder.fs.open_output_stream(folder.of(pack["name"] + ".pack"))
                body = None if row["body"] is None else row["body"].encode()
                lines.append(json.dumps([row["stem"], row["kind"], pack["bytes"], None if body is None else len(body)]))
                out.write(body or b"")
                pack["bytes"] += len(body or b"")
                pack["songs"] += 1
                if row["stem"] is not None:
                    pack["first"] = row["stem"] if pack["first"] is None else min(pack["first"], row["stem"])
                    pack["last"] = row["stem"] if pack["last"] is None else max(pack["last"], row["stem"])
                if pack["bytes"] >= PART_BYTES:
                    out.close()
                    folder.write(pack["name"] + ".index", "\n".join(lines).encode())
                    out = None
            if out is not None:
                out.close()
                folder.write(pack["name"] + ".index", "\n".join(lines).encode())
        except BaseException:
            if out is not None:
                out.close()
            self._drop(packs)
            raise
        return Written(packs)

    def _drop(self, packs: list[dict]) -> None:
        _Folder(self.path).delete(p["name"] + end for p in packs for end in (".pack", ".index"))

    def commit(self, messages: list[Written | None]) -> None:
        """The next manifest; then folders that it does not name go, also those of writers that did not end."""
        folder = _Folder(self.path)
        last, before = folder.packs()
        packs = ([] if self.overwrite else before) + [p for m in messages if m for p in m.packs]
        folder.publish(last + 1, packs)
        named = {p["name"].split("/")[1] for p in packs}
        for job in folder.fs.get_file_info(pafs.FileSelector(folder.of("data"), allow_not_found=True)):
            if job.base_name not in named:
                folder.fs.delete_dir(job.path)

    def abort(self, messages: list[Written | None]) -> None:
        """Without its folder a task that still runs cannot open another file."""
        folder = _Folder(self.path)
        if folder.fs.get_file_info(folder.of(f"data/{self.job}")).type == pafs.FileType.Directory:
            folder.fs.delete_dir(folder.of(f"data/{self.job}"))


class _Reader(DataSourceReader):
    def __init__(self, path: str, split: int, stems: list[str] | None) -> None:
        self.path, self.split, self.stems = path, split, None if stems is None else set(stems)

    def partitions(self) -> list[Part]:
        out = []
        for p in _Folder(self.path).packs()[1]:
            if self.stems is None or p["first"] is not None and any(p["first"] <= s <= p["last"] for s in self.stems):
                out += [Part(p["name"], low, low + self.split) for low in range(0, max(p["bytes"], 1), self.split)]
        # a text of no bytes at the end of a pack starts where its bytes end
        return out or [Part("", 0, 0)]

    def read(self, partition: Part) -> Iterator[tuple]:
        if not partition.pack:
            return
        folder = _Folder(self.path)
        lines = [json.loads(line) for line in folder.read(partition.pack + ".index").decode().split("\n")]
        end = lines[-1][2] + (lines[-1][3] or 0)
        last = partition.high >= end
        with folder.fs.open_input_file(folder.of(partition.pack + ".pack")) as f:
            for stem, kind, offset, length in lines:
                if partition.low <= offset and (offset < partition.high or last) and (self.stems is None or stem in self.stems):
                    yield stem, kind, None if length is None else f.read_at(length, offset).decode()


class SongPacks(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        stems = self.options.get("stems")
        return _Reader(self.options["path"], int(self.options.get("split", SPLIT_BYTES)), None if stems is None else json.loads(stems))

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], schema, overwrite)


def write_packs(songs: DataFrame, path: str, mode: str = "append") -> None:
    """songs (stem, kind, body) as packs."""
    songs.sparkSession.dataSource.register(SongPacks)
    songs.select("stem", "kind", "body").write.format(NAME).mode(mode).save(path)


def read_packs(spark: SparkSession, path: str, stems: list[str] | None = None) -> DataFrame:
    """(stem, kind, body); of some stems only the packs that can hold them are opened."""
    spark.dataSource.register(SongPacks)
    reader = spark.read.format(NAME)
    return (reader if stems is None else reader.option("stems", json.dumps(stems))).load(path)

"""A table as versions of buckets by key: a change rewrites the buckets of its keys and no others.

Rows lie in bucket pmod(xxhash64(key), buckets). A version is a manifest, one small JSON file that names for each
bucket the folder with its rows; versions share the folders of buckets that did not change. A change reads the
touched buckets of the version it starts from, applies renames, then inserts (those with a known key are
ignored), upserts and deletes, and checks that keys stay unique; a change that breaks this is rolled back as a whole.

Writers are optimistic: the next manifest is put in place by a rename that fails if the name is taken. Who loses
looks at what won: if it touched other buckets the finished buckets are kept and only the manifest is made
anew, else the change is made again from the new version. Readers see whole versions only. The rename is atomic
on HDFS; a local folder is looked at first, so there two writers of one machine can still meet.

A manifest has one line per bucket, whatever the rows; keys of a change reach the driver as bucket numbers only.
Null keys share a bucket and need not be unique.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from . import catalogue as C

BUCKET = "__bucket"


class NotUnique(ValueError):
    """The change would give two rows one key; nothing was changed."""


@dataclass
class Manifest:
    version: int
    buckets: int
    schema: str
    folders: dict[int, str] = field(default_factory=dict)

    def dump(self) -> str:
        return json.dumps({"version": self.version, "buckets": self.buckets, "schema": json.loads(self.schema), "folders": self.folders})

    @staticmethod
    def load(text: str) -> Manifest:
        x = json.loads(text)
        return Manifest(x["version"], x["buckets"], json.dumps(x["schema"]), {int(k): v for k, v in x["folders"].items()})


@dataclass
class Prepared:
    """Written buckets that wait for their commit: `folders` has None where a bucket has no rows left."""

    base: Manifest
    folders: dict[int, str | None]


class Snapshots:
    def __init__(self, spark: SparkSession, root: str, key: str) -> None:
        self.spark, self.root, self.key = spark, root.rstrip("/"), key
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._at = self._fs.Path(self.root).getFileSystem(self._conf)

    # manifests

    def _name(self, version: int) -> str:
        return f"{self.root}/versions/{version:012d}.json"

    def version(self) -> int:
        """The last version; 0 before the first."""
        folder = self._fs.Path(f"{self.root}/versions")
        if not self._at.exists(folder):
            return 0
        return max((int(s.getPath().getName()[:12]) for s in self._at.listStatus(folder) if s.getPath().getName().endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> Manifest:
        at = self._at.open(self._fs.Path(self._name(version or self.version())))
        try:
            return Manifest.load(self.spark._jvm.org.apache.commons.io.IOUtils.toString(at, "UTF-8"))
        finally:
            at.close()

    def _put(self, manifest: Manifest) -> bool:
        """Whether the manifest got its place: False if another one has it."""
        jvm, name = self.spark._jvm, self._fs.Path(self._name(manifest.version))
        draft = self._fs.Path(f"{self.root}/drafts/{uuid.uuid4().hex}")
        out = self._at.create(draft, False)
        out.write(bytearray(manifest.dump().encode()))
        out.close()
        self._at.mkdirs(name.getParent())
        context = self._fs.FileContext.getFileContext(self._at.getUri(), self._conf)
        rename = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, name, rename)
            return True
        except Py4JJavaError as e:
            self._at.delete(draft, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise

    # rows

    def _bucket(self, n: int, key: str | None = None) -> Column:
        return F.pmod(F.xxhash64(F.col(key or self.key)), F.lit(n)).cast("int")

    def _rows(self, manifest: Manifest, buckets: list[int] | None = None) -> DataFrame:
        folders = [f for k, f in sorted(manifest.folders.items()) if buckets is None or k in set(buckets)]
        schema = StructType.fromJson(json.loads(manifest.schema))
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.manifest(version))

    def lookup(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """Rows of the keys; only their buckets are read."""
        m = self.manifest(version)
        return C.found_of(keys, self._rows(m, self._touched(m.buckets, keys.select(self.key))), self.key)

    def _touched(self, n: int, *keys: DataFrame) -> list[int]:
        every = keys[0].toDF(self.key)
        for more in keys[1:]:
            every = every.unionByName(more.toDF(self.key))
        return sorted(r[0] for r in every.select(self._bucket(n).alias("b")).distinct().collect())

    def _write(self, rows: DataFrame, n: int, touched: list[int]) -> dict[int, str | None]:
        folder = f"data/{uuid.uuid4().hex}"
        rows.withColumn(BUCKET, self._bucket(n)).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.root}/{folder}")
        there = {int(name.split("=")[1]) for s in self._at.listStatus(self._fs.Path(f"{self.root}/{folder}")) if (name := s.getPath().getName()).startswith(BUCKET)}
        return {k: f"{folder}/{BUCKET}={k}" if k in there else None for k in touched}

    def create(self, rows: DataFrame, buckets: int = 64) -> int:
        """The first version; fails if there is one."""
        self._check(rows)
        folders = self._write(rows, buckets, list(range(buckets)))
        first = Manifest(1, buckets, rows.schema.json(), {k: f for k, f in folders.items() if f})
        if not self._put(first):
            raise FileExistsError(self.root)
        return 1

    def _check(self, rows: DataFrame) -> None:
        twice = rows.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.count("*").alias("n")).where("n > 1")
        if not twice.isEmpty():
            raise NotUnique(f"two rows with one {self.key}")

    # changes

    def prepare(self, moves: DataFrame | None = None, inserts: DataFrame | None = None, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> Prepared:
        """Write the touched buckets as they will be. moves: (old_path, new_path); deletes: (key)."""
        base = self.manifest()
        keys = [x.select(self.key) for x in (inserts, upserts, deletes) if x is not None]
        keys += [moves.select(c) for c in ("old_path", "new_path")] if moves is not None else []
        touched = self._touched(base.buckets, *keys) if keys else []
        if not touched:
            return Prepared(base, {})
        rows = self._rows(base, touched)
        columns = rows.columns
        if moves is not None:
            rows = C.update_keys(rows, moves, self.key)
            self._check(rows)
        if inserts is not None:
            rows = C.insert_ignore(rows, inserts, self.key)
        if upserts is not None:
            rows = C.upsert(rows, upserts, self.key)
        if deletes is not None:
            rows = C.delete_keys(rows, deletes, self.key)
        folders = self._write(rows.select(*columns), base.buckets, touched)
        try:
            self._check(self._rows(Manifest(0, base.buckets, base.schema, {k: f for k, f in folders.items() if f})))
        except NotUnique:
            self._drop(folders)
            raise
        return Prepared(base, folders)

    def _drop(self, folders: dict[int, str | None]) -> None:
        for top in {f.rsplit("/", 1)[0] for f in folders.values() if f}:
            self._at.delete(self._fs.Path(f"{self.root}/{top}"), True)

    def commit(self, change: Prepared) -> int | None:
        """The version that the change became, or None if another change of the same buckets came first."""
        base = change.base
        while change.folders:
            merged = base.folders | change.folders
            if self._put(Manifest(base.version + 1, base.buckets, base.schema, {k: f for k, f in merged.items() if f})):
                return base.version + 1
            now = self.manifest(base.version + 1)
            if any(now.folders.get(k) != base.folders.get(k) for k in change.folders):
                self._drop(change.folders)
                return None
            base = now
        return base.version

    def apply(self, attempts: int = 20, **change: DataFrame | None) -> int:
        """Prepare and commit, again from the new version if another writer was first."""
        for _ in range(attempts):
            if version := self.commit(self.prepare(**change)):
                return version
        raise RuntimeError(f"{attempts} other changes came first")

    def vacuum(self, keep: int = 2) -> int:
        """Delete manifests before the last `keep`, and folders that none of those names; how many folders went.
        Not while writers prepare a change."""
        last = self.version()
        kept = [self.manifest(v) for v in range(max(1, last - keep + 1), last + 1)]
        used = {f.split("/")[1] for m in kept for f in m.folders.values()}
        gone = 0
        for s in self._at.listStatus(self._fs.Path(f"{self.root}/data")):
            if s.getPath().getName() not in used:
                gone += self._at.delete(s.getPath(), True)
        for v in range(1, last - keep + 1):
            self._at.delete(self._fs.Path(self._name(v)), False)
        return gone

"""Helpers that the operators of this subpackage share.

Words are ``[^\\x20\\x09-\\x0D]+`` in UTF-8; since the separators are ASCII bytes, splitting the
bytes is the same as splitting the characters. The normal form for near-duplicates is lower case
with ASCII punctuation turned into separators.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

#: 64-bit odd constants of the mixing functions (fixed values).
_M1, _M2, _P = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15
_SEPARATORS = bytes(range(9, 14)) + b" "
_PUNCT = bytes(c for c in range(33, 127) if not chr(c).isalnum())
NORMAL = bytes.maketrans(_PUNCT, b" " * len(_PUNCT))
SHINGLE = 5


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share. Where the setting is
    absent and all runs on this machine (tests) a temporary folder is set as the checkpoint folder first."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = f"file://{tempfile.mkdtemp(prefix='descant-')}"
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/descant-{uuid.uuid4().hex}"


#: Bytes of an Arrow batch between Spark and Python workers. By rows alone (Spark's default) a batch of long
#: texts takes hundreds of MB on both sides.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Limit Arrow batches by bytes in this session, unless the session has a lower limit of its own."""
    if int(spark.conf.get(_BATCH, str(2**31 - 1))) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def cut(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: the lineage ends there, and a
    lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = shared_dir(spark)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._descant_path = path
    if _SCOPES:
        _SCOPES[-1].append(out)
    return out


_SCOPES: list[list[DataFrame]] = []


@contextmanager
def scope() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables of `cut` made inside are deleted at the end, but for those given to the function that this yields:
    what is left is what the result reads, once the result is written inside as well."""
    made: list[DataFrame] = []
    kept: list[DataFrame] = []
    _SCOPES.append(made)

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        _SCOPES.pop()
        release(*(x for x in made if not any(x is k for k in kept)))


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(*written: DataFrame | None) -> None:
    """Delete tables of `cut`. Only for tables whose readers are written themselves."""
    for df in written:
        path = getattr(df, "_descant_path", None)
        if path:
            delete(df.sparkSession, path)


#: Bytes of a table that a join may broadcast to every executor.
BROADCAST_BYTES = 32 << 20


def bounded(written: DataFrame, row_bytes: int = 32) -> DataFrame:
    """A table of `cut` for a join with texts: broadcast if its rows, counted, of about `row_bytes` each
    take at most BROADCAST_BYTES, so that the texts stay where they are; else a sorted join moves every
    text once."""
    return F.broadcast(written) if written.count() * row_bytes <= BROADCAST_BYTES else written.hint("merge")


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of _P and of its inverse modulo 2**64, grown on demand."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            m = 1 << (n - 1).bit_length()
            with np.errstate(over="ignore"):
                cls.up = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(m - 1, _P, np.uint64), dtype=np.uint64)])
                cls.down = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(m - 1, pow(_P, -1, 1 << 64), np.uint64), dtype=np.uint64)])
        return cls.up, cls.down


def split_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sep = (data == 32) | ((data >= 9) & (data <= 13))
    word = np.concatenate([[False], ~sep, [False]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    return edge[::2], edge[1::2]


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range: a polynomial modulo 2**64, mixed with the length."""
    up, down = _Powers.get(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def normal_bytes(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(NORMAL)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and per text the index of its first word (one more at the end)."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    starts, ends = split_words(data)
    return hash_ranges(data, starts, ends), np.searchsorted(starts, at)


def shingles(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of k words; of all words as one run if there are fewer."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    k = min(k, n)
    out = np.zeros(n - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = out * np.uint64(_P) + words[i : n - k + 1 + i]
    return mix(out + np.uint64(k))


def bag_as_set(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes that stand for a multiset: the i-th repeat of a value is mixed with i,
    so that the overlap of two multisets is that of two sets."""
    h = np.sort(hashes)
    if len(h) > 1 and (same := h[1:] == h[:-1]).any():
        first = np.concatenate([[True], ~same])
        at = np.arange(len(h))
        rank = at - np.maximum.accumulate(np.where(first, at, 0))
        h = np.where(rank > 0, mix(h + rank.astype(np.uint64) * np.uint64(_P)), h)
        h.sort()
    return h


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(a) + len(b) - common)


def slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """Runs of rows whose texts take about `most` bytes, so that work arrays stay small; null is ''."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield begin, [x or "" for x in texts.slice(begin, i - begin).to_pylist()]
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, [x or "" for x in texts.slice(begin).to_pylist()]


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)

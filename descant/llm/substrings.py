"""Exact substring dedup on whole texts, as UTF-8 bytes, by sorted suffixes.

A byte goes if a LENGTH-byte string that covers it also starts in a document with a smaller id.

1. pack: texts are packed into chunks of some MB. In each window of LENGTH bytes the smallest hash of its
   GRAM-byte strings marks an anchor. Equal windows have their anchor at the same place, so windows that
   share an anchor (a run) are looked at together, and equal windows meet under the anchor's hash.
2. anchors: each chunk sends the hashes of its anchors, once each, to hash buckets; a bucket answers which
   of them another document may hold too. All other runs are unique and done.
3. suffixes: the strings that the shared runs cover are deep-shallow sorted in the chunk, equal ones become
   one class with their smallest document, and classes go to their buckets. There the classes of all chunks
   are deep-shallow sorted. Where an anchor has one string only, all its windows are equal; else the
   suffixes of the anchor's strings, each LENGTH bytes, are deep-shallow sorted, and each group of equal
   suffixes gets its smallest document.
4. spans: each chunk gets back the smallest documents of its windows, marks those smaller than its own
   documents and cuts the covered bytes out.

A hot string costs one class a chunk, whatever the number of copies, and those meet in one bucket: a task reads
one row of some hundred bytes a chunk of 1 MB for it, 100 MB at a terabyte. Buckets grow in number with the
input, so that all other tasks stay of bounded size. Comparisons are of bytes, hashes only route.

Edge cases: null is the empty text; texts under LENGTH bytes keep everything; a null id counts as larger
than all others; rows with equal ids never remove each other; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import cut, mix, slices
from .deepshallow import sort

LENGTH, GRAM = 50, 16
CHUNK = 1 << 20
BUCKET_KEYS, LEAST_BUCKETS = 50_000, 64
SUFFIXES = 100_000  # sorted at a time in a bucket
_SPAN = LENGTH - GRAM + 1  # grams in a window
_WIDTH = 88  # bytes of the longest run string (LENGTH + _SPAN - 1), in whole words
_NO_ID = np.iinfo(np.int64).max
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as one number; zero beyond the end."""
    raw = data.tobytes() + bytes(16)
    out = np.empty(len(data) + 8, np.uint64)
    for i in range(8):
        v = np.frombuffer(raw, "<u8", offset=i, count=(len(raw) - i) // 8)
        part = out[i::8]
        part[:] = v[: len(part)]
    return out


def _hash_at(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    return mix(words[at] * _A ^ mix(words[at + 8] * _B))


class Chunk:
    """Packed texts and their runs: consecutive windows [lo, lo + n) with the anchor at lo + off."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, data: np.ndarray, n: np.ndarray, off: np.ndarray) -> None:
        self.ids, self.sizes, self.data, self.n, self.off = ids, sizes, data, n, off
        self.at = np.cumsum(np.append(0, sizes))
        windows = np.maximum(sizes - LENGTH + 1, 0)
        # runs follow each other; a document's first window is at its first byte
        passed = np.cumsum(n) - n
        ends = np.cumsum(windows)
        self.doc = np.searchsorted(ends, passed, side="right")
        self.lo = passed - (ends - windows)[self.doc] + self.at[self.doc] if len(n) else np.zeros(0, np.int64)

    @classmethod
    def pack(cls, ids: np.ndarray, texts: list[bytes]) -> Chunk:
        data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        self = cls(ids, sizes, data, np.zeros(0, np.int64), np.zeros(0, np.int64))
        windows = np.maximum(sizes - LENGTH + 1, 0)
        if not windows.sum():
            return self
        words = _words_at(data)
        grams = len(data) - GRAM + 1
        rank = (_hash_at(words, np.arange(grams)) & np.uint64(0xFFFFFFFF00000000)) | np.arange(grams, dtype=np.uint64)
        for step in (1, 2, 4, 8, 16):
            rank = np.minimum(rank[:-step], rank[step:])
        rank = np.minimum(rank[: len(rank) - (_SPAN - 32)], rank[_SPAN - 32 :])
        start = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(self.at[:-1], windows)
        anchor = (rank[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        edge = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)]))
        n = np.diff(np.append(edge, len(start)))
        return cls(ids, sizes, data, n, anchor[edge] - start[edge])

    def row(self) -> dict:
        z = zstandard.ZstdCompressor(level=3)
        return {"ids": self.ids.tobytes(), "sizes": self.sizes.tobytes(), "data": z.compress(self.data.tobytes()), "n": z.compress(self.n.astype(np.uint8).tobytes()), "off": z.compress(self.off.astype(np.uint8).tobytes())}

    @classmethod
    def of(cls, r: dict) -> Chunk:
        z = zstandard.ZstdDecompressor()
        small = lambda k: np.frombuffer(z.decompress(r[k]), np.uint8).astype(np.int64)
        return cls(np.frombuffer(r["ids"], np.int64), np.frombuffer(r["sizes"], np.int64), np.frombuffer(z.decompress(r["data"]), np.uint8), small("n"), small("off"))

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchor hashes in order, which of them two documents of the chunk share, and per
        run the place of its hash."""
        hashes = _hash_at(_words_at(self.data), self.lo + self.off)
        order = np.argsort(hashes, kind="stable")
        h = hashes[order]
        edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        doc = self.ids[self.doc[order]]
        many = np.minimum.reduceat(doc, edge) != np.maximum.reduceat(doc, edge) if len(h) else np.zeros(0, bool)
        place = np.empty(len(h), np.int64)
        place[order] = np.cumsum(np.concatenate([[True], h[1:] != h[:-1]])) - 1 if len(h) else 0
        return h[edge], many, place

    def shared(self, hot: np.ndarray, keys: np.ndarray, place: np.ndarray) -> Shared:
        return Shared(self, np.flatnonzero(hot[place]), keys, place)


_TAIL = np.array([0] + [((1 << 8 * k) - 1) << 8 * (8 - k) for k in range(1, 9)], np.uint64)


def _matrix(words: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """The strings of `size` bytes from `start` on, zero-filled to width, as big-endian numbers; words
    has the 8 bytes from each position on."""
    out = np.empty((len(start), width // 8), np.uint64)
    for i in range(width // 8):
        w = words[np.minimum(start + 8 * i, len(words) - 1)].byteswap()
        out[:, i] = w & _TAIL[np.clip(size - 8 * i, 0, 8)]
    return out


class Shared:
    """The classes of equal run strings of a chunk's shared runs, in sorted order."""

    def __init__(self, chunk: Chunk, runs: np.ndarray, keys: np.ndarray, place: np.ndarray) -> None:
        self.runs = runs
        n, off, lo = chunk.n[runs], chunk.off[runs], chunk.lo[runs]
        strings = _matrix(_words_at(chunk.data), lo, n + LENGTH - 1, _WIDTH)
        order, group = sort(np.hstack([strings, (n * 256 + off).astype(np.uint64)[:, None]]))
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
        rep = order[first]
        self.class_of = np.empty(len(runs), np.int64)
        self.class_of[order] = group
        self.n, self.off, self.lo = n[rep], off[rep], lo[rep]
        self.key = keys[place[runs[rep]]]
        self.least = np.minimum.reduceat(chunk.ids[chunk.doc[runs[order]]], first) if len(first) else np.zeros(0, np.int64)


def _bucket(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def _held(buckets: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of the buckets that sorted numbers hold: as many as there are keys at most."""
    edge = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]])) if len(buckets) else np.zeros(0, np.int64)
    return list(zip(buckets[edge].tolist(), edge.tolist(), np.append(edge[1:], len(buckets)).tolist(), strict=True))


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(len(batch)):
        yield batch.slice(i, 1).to_pylist()[0]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, k = TaskContext.get().partitionId(), 0
    for batch in batches:
        ids = batch.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
        for begin, texts in slices(batch.column(1), CHUNK):
            chunk = Chunk.pack(np.ascontiguousarray(ids[begin : begin + len(texts)]), [t.encode("utf-8", "surrogatepass") for t in texts])
            yield pa.RecordBatch.from_pylist([{"chunk": part << 32 | k} | chunk.row()], pa.schema([("chunk", pa.int64()), *((c, pa.binary()) for c in ("ids", "sizes", "data", "n", "off"))]))
            k += 1


_TO_BUCKET = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("payload", pa.binary())])


def _send_keys(bits: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _rows(batch):
                keys, many, _ = Chunk.of(r).keys()
                # five bytes below the bucket's bits tell keys apart well enough: a false share costs time only
                low = (keys << np.uint64(bits)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, :5]
                body = np.hstack([low, many.astype(np.uint8)[:, None]])
                out = [{"bucket": b, "chunk": r["chunk"], "payload": body[x:y].T.tobytes()} for b, x, y in _held(_bucket(keys, bits))]
                yield pa.RecordBatch.from_pylist(out, _TO_BUCKET)

    return run


def _answer_keys(rows: pd.DataFrame) -> pd.DataFrame:
    """Per chunk one bit for each key: whether another document may hold it."""
    parts = [np.frombuffer(p, np.uint8).reshape(6, -1) for p in rows["payload"]]
    low = np.concatenate([np.vstack([p[:5], np.zeros((3, p.shape[1]), np.uint8)]).T for p in parts])
    keys = np.ascontiguousarray(low).view(">u8").ravel().astype(np.uint64)
    many = np.concatenate([p[5] for p in parts]).astype(bool)
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    hot = (counts > 1) | (np.bincount(inverse, many) > 0)
    bits = np.split(hot[inverse], np.cumsum([p.shape[1] for p in parts])[:-1])
    return pd.DataFrame({"chunk": rows["chunk"], "bucket": rows["bucket"], "payload": [np.packbits(b).tobytes() for b in bits]})


def _hot(answers: list[dict], keys: np.ndarray, bits: int) -> np.ndarray:
    bucket = _bucket(keys, bits)
    hot = np.zeros(len(keys), bool)
    for a in answers or []:
        x, y = np.searchsorted(bucket, [a["bucket"], a["bucket"] + 1])
        hot[x:y] = np.unpackbits(np.frombuffer(a["payload"], np.uint8), count=y - x)
    return hot


def _shared_of(r: dict, bits: int) -> tuple[Chunk, Shared]:
    chunk = Chunk.of(r)
    keys, _, place = chunk.keys()
    return chunk, chunk.shared(_hot(r["hot"], keys, bits), keys, place)


def _send_classes(bits: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)  # sorted strings have long common prefixes
        for batch in batches:
            for r in _rows(batch):
                chunk, s = _shared_of(r, bits)
                bucket = _bucket(s.key, bits)
                order = np.argsort(bucket, kind="stable")
                out = []
                for b, x, y in _held(bucket[order]):
                    c = order[x:y]
                    size = s.n[c] + LENGTH - 1
                    at = np.repeat(s.lo[c] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                    out.append({"bucket": b, "chunk": r["chunk"], "payload": z.compress(np.int64(y - x).tobytes() + s.least[c].tobytes() + s.n[c].astype(np.uint8).tobytes() + s.off[c].astype(np.uint8).tobytes() + chunk.data[at].tobytes())})
                yield pa.RecordBatch.from_pylist(out, _TO_BUCKET)

    return run


def window_least(data: np.ndarray, start: np.ndarray, n: np.ndarray, off: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The smallest document of each window of the run strings, run after run."""
    words = _words_at(data)
    order, group = sort(np.hstack([_matrix(words, start, n + LENGTH - 1, _WIDTH), (n * 256 + off).astype(np.uint64)[:, None]]))
    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    rep = order[edge]
    low = np.minimum.reduceat(least[order], edge)
    string_of = np.empty(len(n), np.int64)
    string_of[order] = group
    _, key, counts = np.unique(_hash_at(words, start[rep] + off[rep]), return_inverse=True, return_counts=True)
    size = n[rep]
    at = np.cumsum(size) - size
    out = np.repeat(low, size)
    many = np.flatnonzero(counts[key] > 1)
    many = many[np.argsort(key[many], kind="stable")]
    # equal suffixes have the same anchor: anchors are sorted in groups of bounded size
    upto = np.cumsum(size[many])
    edge = np.flatnonzero(np.concatenate([[True], key[many[1:]] != key[many[:-1]]])) if len(many) else np.zeros(0, np.int64)
    piece = upto[edge] // SUFFIXES
    for part in np.split(many, edge[1:][piece[1:] != piece[:-1]]) if len(many) else ():
        k = size[part]
        inside = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        suffix = np.repeat(start[rep[part]], k) + inside
        order, group = sort(_matrix(words, suffix, np.full(len(suffix), LENGTH), -(-LENGTH // 8) * 8))
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        found = np.empty(len(suffix), np.int64)
        found[order] = np.minimum.reduceat(np.repeat(low[part], k)[order], first)[group]
        out[np.repeat(at[part], k) + inside] = found
    take = np.repeat(at[string_of], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return out[take]


def _answer_classes(rows: pd.DataFrame) -> pd.DataFrame:
    least, n, off, data, counts = [], [], [], [], []
    z = zstandard.ZstdDecompressor()
    for p in map(z.decompress, rows["payload"]):
        k = int(np.frombuffer(p, np.int64, 1)[0])
        counts.append(k)
        least.append(np.frombuffer(p, np.int64, k, 8))
        n.append(np.frombuffer(p, np.uint8, k, 8 + 8 * k))
        off.append(np.frombuffer(p, np.uint8, k, 8 + 9 * k))
        data.append(np.frombuffer(p, np.uint8, offset=8 + 10 * k))
    n, off = np.concatenate(n).astype(np.int64), np.concatenate(off).astype(np.int64)
    size = n + LENGTH - 1
    found = window_least(np.concatenate(data), np.cumsum(size) - size, n, off, np.concatenate(least))
    answers, c, w = [], 0, 0
    for k in counts:
        windows = n[c : c + k]
        own = found[w : w + windows.sum()]
        first = np.cumsum(windows) - windows
        even = np.minimum.reduceat(own, first) == np.maximum.reduceat(own, first)
        answers.append(np.packbits(even).tobytes() + own[np.repeat(~even, windows) | np.isin(np.arange(len(own)), first)].tobytes())
        c, w = c + k, w + int(windows.sum())
    return pd.DataFrame({"chunk": rows["chunk"], "bucket": rows["bucket"], "payload": answers})


def _removed(chunk: Chunk, s: Shared, answers: list[dict], bits: int) -> np.ndarray:
    """Which bytes go."""
    cover = np.zeros(len(chunk.data) + 1, np.int32)
    if len(s.runs):
        bucket = _bucket(s.key, bits)
        order = np.argsort(bucket, kind="stable")
        sorted_ = bucket[order]
        first = np.cumsum(s.n) - s.n
        least = np.full(int(s.n.sum()), _NO_ID)
        for a in answers or []:
            x, y = np.searchsorted(sorted_, [a["bucket"], a["bucket"] + 1])
            c = order[x:y]
            k, n = len(c), s.n[c]
            skip = -(-k // 8)
            even = np.unpackbits(np.frombuffer(a["payload"], np.uint8, skip), count=k).astype(bool)
            given = np.frombuffer(a["payload"][skip:], np.int64)
            held = np.where(even, 1, n)
            at = np.repeat(np.cumsum(held) - held, n) + np.where(np.repeat(even, n), 0, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            least[np.repeat(first[c], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = given[at]
        n = chunk.n[s.runs]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        mine = np.repeat(chunk.ids[chunk.doc[s.runs]], n)
        gone = least[np.repeat(first[s.class_of], n) + inside] < mine
        start = (np.repeat(chunk.lo[s.runs], n) + inside)[gone]
        np.add.at(cover, start, 1)
        np.add.at(cover, start + LENGTH, -1)
    return np.cumsum(cover[:-1]) > 0


def _finish(bits: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _rows(batch):
                chunk, s = _shared_of(r, bits)
                gone = _removed(chunk, s, r["found"], bits)
                out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")}
                for i, doc in enumerate(chunk.ids.tolist()):
                    x, y = chunk.at[i], chunk.at[i + 1]
                    own = gone[x:y]
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
                    for k, v in zip(out, (None if doc == _NO_ID else doc, int(y - x), int(own.sum()), len(edge) // 2, hashlib.sha256(chunk.data[x:y][~own].tobytes()).hexdigest(), [{"begin": int(b), "end": int(e)} for b, e in zip(edge[::2], edge[1::2], strict=True)]), strict=True):
                        out[k].append(v)
                kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    return run


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) per row of docs."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    chunks = cut(plain.mapInArrow(_pack, "chunk long, ids binary, sizes binary, data binary, n binary, off binary"), codec="uncompressed")
    total = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(LEAST_BUCKETS - 1, total * 2 // (_SPAN + 1) // BUCKET_KEYS).bit_length()
    reply = "chunk long, bucket long, payload binary"
    gather = lambda df, name: df.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "payload")).alias(name))  # noqa: E731  one answer a bucket
    hot = cut(chunks.mapInArrow(_send_keys(bits), "bucket long, chunk long, payload binary").groupBy("bucket").applyInPandas(_answer_keys, reply))
    known = chunks.join(gather(hot, "hot"), "chunk", "left")
    found = cut(known.mapInArrow(_send_classes(bits), "bucket long, chunk long, payload binary").groupBy("bucket").applyInPandas(_answer_classes, reply))
    full = known.join(gather(found, "found"), "chunk", "left")
    return full.mapInArrow(_finish(bits), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin:bigint,end:bigint>>")

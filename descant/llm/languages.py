"""Language identification in two steps: the family first, then the language inside it.

A text is lower-cased, its words are cut out, and runs of two and three bytes are counted by hash. The
family comes from a naive Bayes model of these counts. Inside a family every two languages have a linear
support vector machine (squared hinge loss) over the square roots of the shares of the runs, which have
length one whatever the text's length; the language with the most wins is taken, ties by the sum of margins,
then by name. The score is the family's posterior times the logistic of the winner's smallest margin.

`train` fits both on a bounded sample of labelled rows: of the LANGUAGES most frequent languages about
PER_LANGUAGE rows each, chosen by a hash of id and text, and PER_LANGUAGE at most for each machine. Everything
else covers all rows and whole texts: a prediction depends on the text alone. The model is a few matrices of
a size fixed by these parameters and is broadcast; texts are not shuffled.

Families are the common ones of FAMILIES; a language that is not listed is a family of its own.

Edge cases: a null text, or one without a letter, is `und` with score 0, and so is everything if nothing is
labelled; rows with a null language or a null id are not learned from; repeated rows and equal texts are told
alike; a family of one language needs no machine; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import cut, release, slices

LANGUAGES, PER_LANGUAGE = 64, 1500
#: Parts of one in which logarithms and weights, and roots of counts, are kept as whole numbers: their sums are
#: exact, whatever texts are counted together.
FINE, ROOT = 1 << 16, 1 << 8
#: Columns of counts (hashes of runs of bytes).
WIDTH = 1 << 12
#: Weight of errors against the length of a machine's weights; steps of its descent.
PENALTY, STEPS = 20.0, 120
#: Texts that are counted together.
TOGETHER = 256
UNKNOWN = "und"
#: Languages of each family (fixed values: ISO 639-1).
FAMILIES = {
    "germanic": "af da de en fo fy is lb nl nn no nb sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "celtic": "br cy ga gd",
    "turkic": "az kk ky tr tt ug uz",
    "indic": "bn gu hi mr ne pa ur",
    "dravidian": "kn ml ta te",
    "semitic": "ar he mt",
    "malayic": "id ms",
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}
#: Odd multipliers of the hash (fixed values).
_H = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)]
_LETTERS = bytes(c if chr(c).isalpha() or c > 127 else 32 for c in range(256))


def family_of(lang: str) -> str:
    return _FAMILY.get(lang, lang)


def counts(texts: list[str]) -> np.ndarray:
    """Rows of counts of runs of two and three bytes, words set apart by one space."""
    parts = [b" " + b" ".join(t.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split()) + b"  " for t in texts]
    data = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
    ends = np.cumsum([len(p) for p in parts])
    row = np.repeat(np.arange(len(parts), dtype=np.int64), [len(p) for p in parts])
    two = data[:-2] * _H[0] + data[1:-1] * _H[1]
    three = two + data[2:] * _H[2] + np.uint32(1)
    shift = np.uint32(32 - (WIDTH.bit_length() - 1))
    inside = np.ones(len(data) - 2, bool)
    for back in (1, 2):  # no run leaves its text
        at = ends[:-1] - back
        inside[at[at >= 0]] = False
    base = (row[:-2] * WIDTH)[inside]
    cells = np.concatenate([base + ((x ^ (x >> np.uint32(15))) * _H[2] >> shift)[inside] for x in (two, three)])
    return np.bincount(cells, minlength=len(parts) * WIDTH).reshape(len(parts), WIDTH)


def shares(c: np.ndarray) -> np.ndarray:
    return np.sqrt(c / np.maximum(1, c.sum(1, keepdims=True))).astype(np.float32)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Model:
    """Families with the logarithms of their shares, languages, and a machine per pair of one family."""

    families: list[str]
    logs: np.ndarray
    langs: dict[str, list[str]]
    machines: dict[tuple[str, str], tuple[np.ndarray, float]]

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = [k for k, t in enumerate(texts) if has_letter(t)] if self.families else []
        if not known:
            return langs, scores
        c = counts([texts[k] for k in known])
        told = c.astype(np.float64) @ self.logs
        first = told.argmax(1)
        posterior = np.exp((told - told.max(1, keepdims=True)) / FINE)
        posterior /= posterior.sum(1, keepdims=True)
        roots = np.rint(np.sqrt(c) * ROOT)
        unit = 1 / (ROOT * FINE * np.sqrt(np.maximum(1, c.sum(1))))
        for f, family in enumerate(self.families):
            rows = np.flatnonzero(first == f)
            if not len(rows):
                continue
            names = self.langs[family]
            wins, sums = np.zeros((len(rows), len(names))), np.zeros((len(rows), len(names)))
            least = np.full((len(rows), len(names)), np.inf)
            for a, b in combinations(range(len(names)), 2):
                weights, bias = self.machines[names[a], names[b]]
                margin = (roots[rows] @ weights) * unit[rows] + bias
                for k, m in ((a, margin), (b, -margin)):
                    wins[:, k] += (m > 0) if k == b else (m >= 0)
                    sums[:, k] += m
                    least[:, k] = np.minimum(least[:, k], m)
            for i, r in enumerate(rows.tolist()):
                k = min(range(len(names)), key=lambda j: (-wins[i, j], -sums[i, j], names[j]))
                sure = 1.0 if len(names) == 1 else 1 / (1 + np.exp(-2 * least[i, k]))
                langs[known[r]], scores[known[r]] = names[k], float(posterior[r, f] * sure)
        return langs, scores


def machine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights, the bias last, of the machine that tells y = 1 from y = -1: accelerated descent on
    |w|^2 / 2 + PENALTY / n * sum(max(0, 1 - y w.x)^2)."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weigh = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum()))).astype(np.float32)
    c = np.float32(2 * PENALTY / len(x))
    v = np.ones(x.shape[1], np.float32)
    for _ in range(12):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v)
    steep = 1 + c * weigh.max() * np.linalg.norm(x @ v) ** 2 * np.float32(1.1)
    w = ahead = np.zeros(x.shape[1], np.float32)
    t = 1.0
    for _ in range(STEPS):
        short = np.maximum(0, 1 - y * (x @ ahead)) * weigh
        new = ahead - (ahead - c * (x.T @ (y * short))) / steep
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead = new + np.float32((t - 1) / after) * (new - w)
        w, t = new, after
    return w


_SAMPLE = "lang string, family string, pick long, cells array<int>, n array<int>"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, picks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for begin, part in slices(batch.column(2)):
            for at in range(0, len(part), TOGETHER):
                own = slice(begin + at, begin + at + len(part[at : at + TOGETHER]))
                c = counts(part[at : at + TOGETHER])
                cells = [np.flatnonzero(r) for r in c]
                columns = [pa.array(langs[own]), pa.array([family_of(x) for x in langs[own]]), pa.array(picks[own]), pa.array(cells, pa.list_(pa.int32())), pa.array([r[k] for r, k in zip(c, cells, strict=True)], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "family", "pick", "cells", "n"])


def _dense(cells: pd.Series, n: pd.Series) -> np.ndarray:
    out = np.zeros((len(cells), WIDTH), np.float32)
    for k, (c, v) in enumerate(zip(cells, n, strict=True)):
        out[k, c] = v
    return out


def _machine_of(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The machine of one pair, from at most PER_LANGUAGE rows of each language."""
    rows = rows.sort_values(["lang", "pick"], kind="stable").groupby("lang").head(PER_LANGUAGE)
    y = np.where(rows["lang"] == key[0], 1, -1).astype(np.float32)
    return pd.DataFrame({"a": [key[0]], "b": [key[1]], "weights": [machine(shares(_dense(rows["cells"], rows["n"])), y)]})


def train(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", languages: int = LANGUAGES, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on labelled rows (id, text, lang)."""
    rows = labelled.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    found = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    if not found:
        return Model([], np.zeros((WIDTH, 0)), {}, {})
    share = F.element_at(F.create_map(*[F.lit(v) for r in found for v in (r["lang"], min(1.0, per_language / r["count"]))]), F.col("lang"))
    pick = F.xxhash64(F.lit("pick"), "id", "text")
    chosen = rows.where(F.col("lang").isin([r["lang"] for r in found])).withColumn("pick", pick).where(F.pmod("pick", F.lit(1 << 30)) < share * (1 << 30))
    sample = cut(chosen.select("lang", "pick", "text").mapInArrow(_counted, _SAMPLE))
    langs: dict[str, list[str]] = {}
    for name in sorted(r["lang"] for r in found):
        langs.setdefault(family_of(name), []).append(name)
    families = sorted(langs)

    # each language weighs the same in its family, however many rows it has
    cells = sample.select("lang", "family", F.explode(F.arrays_zip("cells", "n")).alias("c")).groupBy("family", "lang", F.col("c.cells").alias("cell")).agg(F.sum("c.n").alias("n"))
    told: dict[str, np.ndarray] = {}
    for r in cells.collect():  # at most languages times WIDTH numbers
        told.setdefault(r["lang"], np.zeros(WIDTH))[r["cell"]] = r["n"]
    smooth = lambda c: (c + 0.5) / (c.sum() + 0.5 * WIDTH)
    mean = lambda f: np.mean([smooth(told.get(name, np.zeros(WIDTH))) for name in langs[f]], 0)
    logs = np.rint(FINE * np.log(np.stack([mean(f) for f in families], 1)))

    pairs = [p for f in families for p in combinations(langs[f], 2)]
    machines: dict[tuple[str, str], tuple[np.ndarray, float]] = {}
    if pairs:
        both = labelled.sparkSession.createDataFrame([(x, a, b) for a, b in pairs for x in (a, b)], "lang string, a string, b string")
        fitted = sample.join(F.broadcast(both), "lang").groupBy("a", "b").applyInPandas(_machine_of, "a string, b string, weights array<float>")
        for r in fitted.collect():  # one row a pair
            w = np.array(r["weights"], np.float32)
            machines[r["a"], r["b"]] = (np.rint(w[:-1].astype(np.float64) * FINE), float(w[-1]))
    release(sample)
    return Model(families, logs, langs, machines)


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """(id, columns of `keep`, lang_pred, score) per row."""
    shared = _share(docs.sparkSession, model)
    extra = list(keep or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, part in slices(batch.column(1)):
                for at in range(0, len(part), TOGETHER):
                    some = part[at : at + TOGETHER]
                    langs, scores = shared.value.predict(some)
                    own = [batch.column(k).slice(begin + at, len(some)) for k in (0, *range(2, 2 + len(extra)))]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[doc_id, *extra, "lang_pred", "score"])

    rows = docs.select(F.col(doc_id), F.col(text), *(c.alias(name) for name, c in (keep or {}).items()))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != text]
    return rows.mapInArrow(run, ", ".join([*kinds, "lang_pred string", "score double"]))


def _share(spark: SparkSession, model: Model):  # noqa: ANN202
    return spark.sparkContext.broadcast(model)

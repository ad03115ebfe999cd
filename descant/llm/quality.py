"""Quality rules by distribution divergence.

Every document gets a histogram of character classes and one of common words. The references are the
mean histograms of each language over all documents that pass the base rules, in integer parts per
million, so that reruns agree. A document is rejected if the Jensen-Shannon distance between its
histogram and its language's reference is too large. Guards: a document under MIN_WORDS words fails
the base rules, word histograms count only from MIN_WORDS_HIST words on, and a language with fewer
than MIN_REFERENCE good documents has no reference, so the base rules alone decide there.

`judge` writes the figures of each document and judges them; `keep` reads the texts twice, first for the
references and then to judge and drop rows where they are, so that no text is moved.

Edge cases: a null text is the empty text, which fails the base rules; a null language is a language
of its own; repeated rows are judged alike; other columns are carried by `keep` and ignored by `judge`.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded, cut, normal_bytes, slices, word_hashes

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MIN_WORDS_HIST, MIN_REFERENCE = 100, 30
#: Largest Jensen-Shannon distances (base 2, between 0 and 1) of a kept document.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.28, 0.28
PPM = 1_000_000
#: Frequent function words of English, French, German and Spanish (fixed values).
COMMON_WORDS = (
    "the of and to in is that for it as with was on are by this be "
    "de la le les et des en un une du que pour qui dans est par sur au "
    "der die und den von zu das mit sich ist ein nicht auf für "
    "el los y se del las con para por su al como más"
).split()
CHAR_CLASSES = 9
_CLASS = np.full(256, 7, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[9, 11, 12, 13, 32]] = 3
_CLASS[10] = 4
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 5
_CLASS[[ord(c) for c in "#*$%&|<>"]] = 6
_CLASS[128:192] = 255  # continuation bytes: not characters
_CLASS[192:] = 8

FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars array<long>, words array<long>"


def _common_hashes() -> np.ndarray:
    texts = [normal_bytes(w) for w in COMMON_WORDS]
    return np.sort(word_hashes(texts)[0])


def repeat_words(words: list[bytes]) -> int:
    """Words in windows of three words that are found twice or more, the first included."""
    n = len(words)
    if n < 4:
        return 0
    known: defaultdict[bytes, int] = defaultdict(count().__next__)
    ids = np.array(list(map(known.__getitem__, words)), np.int64)
    if len(known) < 2_000_000:
        v = len(known)
        keys = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
        _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        twice = counts[inverse] > 1
    else:
        found = Counter(windows := list(zip(ids, ids[1:], ids[2:], strict=False)))
        twice = np.array([found[w] > 1 for w in windows])
    covered = np.zeros(n, bool)
    for i in range(3):
        covered[i : n - 2 + i] |= twice
    return int(covered.sum())


def dup_lines(text: str) -> int:
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif line.encode("utf-8", "surrogatepass").split():
            seen.add(line)
    return n


N_WORDS_HIST = len(set(COMMON_WORDS)) + 1
_FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Figures:
    """The base figures (n, 5) and both histograms, in parts per million, of some texts."""

    def __init__(self, texts: list[str]) -> None:
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        at = np.cumsum([0, *(len(t) + 1 for t in raw)])[:-1]
        size = np.array([len(t) for t in raw])
        kinds = _CLASS[data]
        doc = np.repeat(np.arange(len(raw)), size + 1)
        inside = np.ones(len(data), bool)
        inside[at + size] = False  # the joints between texts
        real = inside & (kinds != 255)
        chars = np.bincount(doc[real] * CHAR_CLASSES + kinds[real], minlength=len(raw) * CHAR_CLASSES).reshape(-1, CHAR_CLASSES)
        common = _common_hashes()
        hashes, first = word_hashes([normal_bytes(t) for t in texts])
        k = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        k = np.where(common[k] == hashes, k, len(common))
        owner = np.repeat(np.arange(len(raw)), np.diff(first))
        words = np.bincount(owner * N_WORDS_HIST + k, minlength=len(raw) * N_WORDS_HIST).reshape(-1, N_WORDS_HIST)
        share = lambda h: h * PPM // np.maximum(h.sum(1, keepdims=True), 1)
        own = [t.split() for t in raw]
        self.base = np.array([[len(w) for w in own], chars.sum(1) - chars[:, 3] - chars[:, 4], chars[:, 6], [dup_lines(t) for t in texts], [repeat_words(w) for w in own]], np.int64).T
        self.chars, self.words = share(chars), share(words)


def base_failed(base: np.ndarray) -> np.ndarray:
    return (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > MAX_REPEAT_PERCENT * base[:, 0])


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances (base 2) of the rows of two histograms, each scaled to sum 1."""
    p, q = (x / np.maximum(x.sum(1, keepdims=True), 1) for x in (p, q))
    m = (p + q) / 2
    part = lambda x: (x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1))).sum(1)
    return np.sqrt(np.maximum((part(p) + part(q)) / 2, 0))


def verdicts(base: np.ndarray, chars: np.ndarray, words: np.ndarray, ref_chars: np.ndarray, ref_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(base failed, both distances, kept); a reference of zeros is none, and a distance without one, or
    of a document too short for it, is nan and rejects nothing."""
    failed = base_failed(base)
    known = ref_chars.sum(1) > 0
    c = np.where(known & (base[:, 0] >= MIN_WORDS), distance(chars, ref_chars), np.nan)
    w = np.where(known & (base[:, 0] >= MIN_WORDS_HIST), distance(words, ref_words), np.nan)
    return failed, c, w, ~failed & ~(c > MAX_CHAR_DISTANCE) & ~(w > MAX_WORD_DISTANCE)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of lists of `width` numbers; null is zeros."""
    out = np.zeros((len(column), width), np.int64)
    there = column.is_valid().to_numpy(zero_copy_only=False)
    out[there] = column.drop_null().flatten().to_numpy().reshape(-1, width)
    return out


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1]), pa.int32()), pa.array(rows.ravel().astype(np.int64)))


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def features(docs: DataFrame) -> DataFrame:
    """docs (doc_id, lang, text) with FEATURES instead of the text; one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in slices(batch.column(2)):
                f = Figures(texts)
                own = [batch.column(i).slice(begin, len(texts)) for i in range(2)]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(c) for c in f.base.T.copy()), _lists(f.chars), _lists(f.words)], names=["doc_id", "lang", *_FIGURES, "chars", "words"])

    return docs.mapInArrow(run, f"{_fields(docs.select('doc_id', 'lang'))}, {FEATURES}")


def _summed(sums: DataFrame) -> DataFrame:
    """Rows (lang, n_good, chars, words) summed up per language, of those with MIN_REFERENCE good documents."""
    total = lambda name, n: F.array(*(F.sum(F.col(name)[i]) for i in range(n)))
    out = sums.groupBy("lang").agg(F.sum("n_good").alias("n_good"), total("chars", CHAR_CLASSES).alias("ref_chars"), total("words", N_WORDS_HIST).alias("ref_words"))
    return out.where(F.col("n_good") >= MIN_REFERENCE).select(F.col("lang").alias("ref_lang"), "ref_chars", "ref_words")


def references(found: DataFrame) -> DataFrame:
    """Per language the summed histograms of the documents of `features` that pass the base rules."""
    good = found.where(f"n_words >= {MIN_WORDS} and 100 * n_repeat_words <= {MAX_REPEAT_PERCENT} * n_words")
    return _summed(good.select("lang", F.lit(1).alias("n_good"), "chars", "words"))


def references_of_texts(docs: DataFrame) -> DataFrame:
    """The same from docs (lang, text): each batch gives a row for each of its languages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in slices(batch.column(1)):
                f = Figures(texts)
                good = ~base_failed(f.base)
                code = batch.column(0).slice(begin, len(texts)).dictionary_encode(null_encoding="encode")
                at = code.indices.to_numpy(zero_copy_only=False)
                n = len(code.dictionary)
                sums = np.zeros((n, CHAR_CLASSES + N_WORDS_HIST), np.int64)
                np.add.at(sums, at[good], np.hstack([f.chars, f.words])[good])
                yield pa.RecordBatch.from_arrays([code.dictionary, pa.array(np.bincount(at[good], minlength=n)), _lists(sums[:, :CHAR_CLASSES]), _lists(sums[:, CHAR_CLASSES:])], names=["lang", "n_good", "chars", "words"])

    return _summed(docs.mapInArrow(run, "lang string, n_good long, chars array<long>, words array<long>"))


def judge(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per document: id, the base figures, both distances (null where a guard holds) and `kept`."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    found = cut(features(plain))
    joined = found.join(bounded(cut(references(found))), F.col("lang").eqNullSafe(F.col("ref_lang")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base = np.stack([batch.column(1 + i).to_numpy() for i in range(5)], 1)
            failed, c, w, kept = verdicts(base, *(_matrix(batch.column(6 + i), n) for i, n in enumerate([CHAR_CLASSES, N_WORDS_HIST] * 2)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(failed), pa.array(c, from_pandas=True), pa.array(w, from_pandas=True), pa.array(kept)], names=[*batch.schema.names[:6], "base_failed", "char_distance", "word_distance", "kept"])

    light = joined.select("doc_id", *_FIGURES, "chars", "words", "ref_chars", "ref_words")
    return light.mapInArrow(run, f"{_fields(light.select('doc_id', *_FIGURES))}, base_failed boolean, char_distance double, word_distance double, kept boolean")


def keep(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = docs.toDF(*names)
    text_at, lang_at = docs.columns.index(text), docs.columns.index(lang)
    as_text, as_lang = F.col(names[text_at]).cast("string"), F.col(names[lang_at]).cast("string")
    refs = bounded(cut(references_of_texts(own.select(as_lang.alias("lang"), as_text.alias("text")))))
    at = text_at if docs.schema[text_at].dataType.simpleString() == "string" else len(names) + 2
    joined = own.join(refs, as_lang.eqNullSafe(F.col("ref_lang")), "left").select(*names, "ref_chars", "ref_words", *([as_text] if at > text_at else []))
    n = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in slices(batch.column(at)):
                f = Figures(texts)
                refs = (_matrix(batch.column(n + i).slice(begin, len(texts)), k) for i, k in enumerate([CHAR_CLASSES, N_WORDS_HIST]))
                kept = verdicts(f.base, f.chars, f.words, *refs)[3]
                part = batch.slice(begin, len(texts)).filter(pa.array(kept))
                yield pa.RecordBatch.from_arrays(part.columns[:n], names=names)

    return joined.mapInArrow(run, _fields(own)).toDF(*docs.columns)

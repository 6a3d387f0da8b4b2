"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams (hashed bytes of the lower-cased word between
'<' and '>'), a window of words the mean of its words, and a document as toxic as its worst window. A
misspelling that was never seen shares most n-grams with the word it stands for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRAMS = (3, 4, 5)  # bytes
BUCKETS = 1 << 18
WIDTH = 8
WINDOW = 48  # words
LEAST_WORDS = 24  # a window of fewer different words is filled up with neutral ones
WORDS = 100_000  # words remembered by a worker
#: The most labelled documents of each label that a model is fitted on, with all their windows.
TRAIN_DOCS = {1: 1_500, 0: 2_500}
RARE = 0.003  # share of the sample's documents below which an n-gram is not learned
_WORDS_AT_ONCE = 20_000
STEPS, REFINE, RATE = 300, (200, 230), 0.04
LEAST_KEPT = 20  # toxic documents that must be among those not trained on
LOOK = 10  # steps between looks at the documents not trained on; the best model stays
EASY = 0.1  # weight, beside their odds, of clean windows once windows are told apart
_CHARS = 1 << 20


def words_of(text: str) -> list[str]:
    return text.lower().split()


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all words, and where each word's begin. Every word has one at least."""
    marked = [b"<" + w.encode() + b">" for w in words]
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    word = np.repeat(np.arange(len(marked)), sizes)
    last = np.cumsum(sizes)[word]  # end of the word that a byte is in
    place = np.arange(len(data))
    found, owners = [], []
    rolled = np.zeros(len(data), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        rolled = rolled[: len(data) - n + 1] * np.uint64(0x100000001B3) + data[n - 1 :] + np.uint64(1)
        if n in GRAMS:
            fits = place[: len(rolled)] + n <= last[: len(rolled)]
            mixed = rolled[fits] * np.uint64(0x9E3779B97F4A7C15)
            found.append((mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32))
            owners.append(word[: len(rolled)][fits])
        rolled = rolled[: len(data) - n]
    buckets, owner = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return buckets[order], np.searchsorted(owner[order], np.arange(len(words)))


def _cut(count: int) -> np.ndarray:
    """Where windows of a text of ``count`` words begin; the last one is as long as the others if the text is."""
    starts = np.arange(0, max(1, count), WINDOW)
    if len(starts) > 1 and count - starts[-1] < WINDOW // 2:
        starts = starts[:-1]
    return starts


@dataclass(frozen=True)
class Model:
    """``values``: what each bucket adds to the log odds of a word; ``bias`` and ``scale`` turn the worst window into odds."""

    values: np.ndarray
    bias: float
    scale: float

    def __hash__(self) -> int:
        return hash((self.bias, self.scale))


def _frequent(words: list[str], ids: np.ndarray, docs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, word) of the n-grams that occur in ``least`` pairs of word and document, and how many n-grams each word has in all."""
    pairs = np.unique(docs.astype(np.int64) * len(words) + ids)
    in_docs = np.bincount(pairs % len(words), minlength=len(words)).astype(np.float32)
    found, owners, counts = [], [], np.zeros(len(words), np.int32)
    for at in range(0, len(words), _WORDS_AT_ONCE):
        own, starts = grams(words[at : at + _WORDS_AT_ONCE])
        number = np.diff(np.append(starts, len(own))).astype(np.int32)
        counts[at : at + len(number)] = number
        found.append(own)
        owners.append(np.repeat(np.arange(at, at + len(number), dtype=np.int32), number))
    buckets, owner = np.concatenate(found), np.concatenate(owners)
    kept = np.bincount(buckets, in_docs[owner], BUCKETS)[buckets] >= least
    return buckets[kept], owner[kept], counts


def _kept(truth: np.ndarray) -> np.ndarray:
    """A random fifth of the sample's documents, the same each time, is not trained on, if that holds enough toxic ones."""
    fifth = np.random.default_rng(5).random(len(truth)) < 0.2
    return fifth if truth[fifth].sum() >= LEAST_KEPT else np.zeros(len(truth), bool)


def fit(windows: list[str], docs: np.ndarray, labels: np.ndarray, toxic_share: float = 0.5, seed: int = 4) -> Model:
    """``docs``: the document of each window; ``labels``: that document's label; ``toxic_share``: of label 1 among all.

    Every window first carries its document's label; later, windows of toxic documents count only where the
    model already finds them toxic, or as the worst of their document. Vectors and softmax are trained
    together by gradient descent over all windows, either label weighing the same, with steps measured by
    the largest slope, so that n-grams of many toxic windows move most; rare n-grams stay neutral. A
    fifth of the documents is not trained on: these choose the step to stop at, and the threshold.
    """
    if not len(windows) or not labels.any():
        return Model(np.zeros(BUCKETS, np.float32), -20.0, 1.0)
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    parts = [np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in dict.fromkeys(x.split())), np.int32) for x in windows]
    sizes = np.fromiter(map(len, parts), np.int32, len(parts))
    ids = np.concatenate(parts)
    del parts
    window = np.repeat(np.arange(len(windows), dtype=np.int32), sizes)
    divisor = np.maximum(sizes, LEAST_WORDS)
    _, doc = np.unique(docs, return_inverse=True)
    buckets, owner, counts = _frequent(list(vocabulary), ids, doc[window], max(3, int(RARE * (doc.max() + 1))))
    share = (1.0 / counts).astype(np.float32)
    truth = np.zeros(doc.max() + 1, int)
    truth[doc] = labels
    kept = _kept(truth)
    toxic, trained = labels == 1, ~kept[doc]
    vectors = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    out = np.tile(np.array([-0.5, 0.5], np.float32), (WIDTH, 1)) + rng.normal(0, 0.01, (WIDTH, 2)).astype(np.float32)
    bias = np.zeros(2)
    speed = [np.zeros_like(vectors), np.zeros_like(out)]

    def odds() -> np.ndarray:
        projected = vectors @ out
        gain = projected[:, 1] - projected[:, 0]
        word = np.bincount(owner, gain[buckets], len(vocabulary)) * share
        return np.bincount(window, word[ids], len(windows)) / divisor

    def worst(values: np.ndarray) -> np.ndarray:
        found = np.full(len(truth), -np.inf)
        np.maximum.at(found, doc, values)
        return found

    judged = kept if kept.any() else np.ones(len(truth), bool)
    use, best, found = trained.copy(), -1.0, vectors @ (out[:, 1] - out[:, 0])
    for step in range(STEPS):
        z = odds() + bias[1] - bias[0]
        if step % LOOK == 0 or step == STEPS - 1:
            order = _order(worst(z)[judged], truth[judged])
            if order >= best:
                best, found = order, vectors @ (out[:, 1] - out[:, 0])
        if step in REFINE:
            use = trained & (~toxic | (z > 0) | (z >= worst(z)[doc]))
        chance = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
        p = chance(z)
        hard = (EASY + p) * (use & ~toxic) if step >= REFINE[0] else (use & ~toxic).astype(float)
        weight = np.where(toxic, 0.5 * use / max(1, (use & toxic).sum()), 0.5 * hard / max(1e-9, hard.sum()))
        for _ in range(4):  # the bias is solved for, so that what all windows share says nothing
            p = chance(z)
            shift = float(np.clip(((p - toxic) * weight).sum() / max(1e-6, (p * (1 - p) * weight).sum()), -5, 5))
            z -= shift
            bias += np.array([0.5, -0.5]) * shift
        slope = (chance(z) - toxic) * weight  # of the softmax's second output; the first has its negative
        per_word = np.bincount(ids, np.repeat(slope / divisor, sizes), len(vocabulary))
        spread = np.bincount(buckets, (share * per_word).astype(np.float32)[owner], BUCKETS).astype(np.float32)
        slopes = [np.outer(spread, out[:, 1] - out[:, 0]), np.outer(vectors.T @ spread, np.array([-1, 1], np.float32))]
        for value, moving, g, rate in zip((vectors, out), speed, slopes, (RATE, RATE / 2), strict=True):
            moving *= 0.9
            moving -= rate * (1 - step / STEPS) * g / (np.abs(g).max() + 1e-12)
            value += moving
    seen = np.zeros(BUCKETS, bool)
    seen[buckets] = True
    values = found * seen
    vectors, out = values[:, None], np.array([[0.0, 1.0]], np.float32)  # what ``odds`` reads
    at, scale = _threshold(worst(odds())[judged], truth[judged], toxic_share)
    return Model(values.astype(np.float32), -at * scale, scale)


def _order(odds: np.ndarray, labels: np.ndarray) -> float:
    """How often a toxic document stands above a clean one (ties half)."""
    _, place, count = np.unique(odds, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[place]
    toxic = int(labels.sum())
    return float((rank[labels == 1].sum() - toxic * (toxic + 1) / 2) / max(1, toxic * (len(labels) - toxic)))


FOLDS = 4


def _crossed(model: Model, windows: list[str], docs: np.ndarray, labels: np.ndarray, toxic_share: float, seed: int) -> Model:
    """The model with a threshold from models that did not see the documents they judge, where labels are few."""
    _, doc = np.unique(docs, return_inverse=True)
    if not len(doc) or labels.sum() < FOLDS:
        return model
    fold = np.random.default_rng(seed).integers(0, FOLDS, doc.max() + 1)[doc]
    found, truth = np.full(doc.max() + 1, -np.inf), np.zeros(doc.max() + 1, int)
    truth[doc] = labels
    for f in range(FOLDS):
        own, rest = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
        if len(own) and labels[rest].any():
            other = fit([windows[i] for i in rest], docs[rest], labels[rest], toxic_share, seed)
            np.maximum.at(found, doc[own], _Scorer(other).worst([windows[i] for i in own]))
    seen = np.isfinite(found)
    at, scale = _threshold(found[seen], truth[seen], toxic_share)
    return Model(model.values, -at * scale, scale)


def _threshold(worst: np.ndarray, truth: np.ndarray, toxic_share: float) -> tuple[float, float]:
    """The middle of the gap with the best F1 at the given share of toxic documents, and a slope for its width."""
    order = np.argsort(worst)
    odds, labels = worst[order], truth[order]
    share = np.where(labels == 1, toxic_share / max(1, labels.sum()), (1 - toxic_share) / max(1, (1 - labels).sum()))
    missed = np.concatenate([[0], np.cumsum(share * labels)])
    accused = np.concatenate([np.cumsum((share * (1 - labels))[::-1])[::-1], [0]])
    hit = toxic_share - missed
    good = 2 * hit / np.maximum(1e-12, 2 * hit + missed + accused)
    best = np.flatnonzero(good >= good.max() - 1e-12)
    cut = int(best[len(best) // 2])
    at = odds[0] - 1 if cut == 0 else odds[-1] + 1 if cut == len(odds) else (odds[cut - 1] + odds[cut]) / 2
    middle = [np.median(odds[labels == k]) if (labels == k).any() else at for k in (0, 1)]
    return float(at), 8.0 / max(1e-3, float(middle[1] - middle[0]))


class _Scorer:
    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}

    def scores(self, texts: list[str]) -> list[float]:
        odds = self.model.scale * np.array(self.worst(texts)) + self.model.bias
        return (1 / (1 + np.exp(-np.clip(odds, -40, 40)))).tolist()

    def worst(self, texts: list[str]) -> list[float]:
        """Log odds of the worst window of each text, before bias and scale; 0 for a text without words."""
        rows = [words_of(t) for t in texts]
        if len(self.known) > WORDS:
            self.known.clear()
        known = self.known
        new = [w for w in {w for r in rows for w in r} if w not in known]
        if new:
            buckets, starts = grams(new)
            sums = np.add.reduceat(self.model.values[buckets].astype(np.float64), starts)
            known.update(zip(new, (sums / np.diff(np.append(starts, len(buckets)))).tolist(), strict=True))
        found = []
        for row in rows:
            starts = _cut(len(row)).tolist()
            bags = [set(row[a:b]) for a, b in zip(starts, [*starts[1:], len(row)], strict=True)] if row else []
            found.append(max((sum(map(known.__getitem__, bag)) / max(LEAST_WORDS, len(bag)) for bag in bags), default=0.0))
        return found


_scorers: dict[tuple[float, float], _Scorer] = {}


def _scorer(model: Model) -> _Scorer:
    key = (model.bias, model.scale)
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = _Scorer(model)
    return _scorers[key]


def _portions(texts: list[str]) -> Iterator[list[str]]:
    own, size = [], 0
    for text in texts:
        own.append(text)
        size += len(text)
        if size >= _CHARS:
            yield own
            own, size = [], 0
    if own:
        yield own


def worst(text: Column, model: Model) -> Column:
    """Log odds of the worst window of a whole text, before the threshold."""

    @F.arrow_udf(T.DoubleType())
    def of(texts: pa.Array) -> pa.Array:
        plain = [t or "" for t in texts.to_pylist()]
        return pa.array([s for part in _portions(plain) for s in _scorer(model).worst(part)], type=pa.float64())

    return of(text)


def scores(text: Column, model: Model) -> Column:
    """0 to 1, higher where label 1 is likelier. Null counts as empty; an empty text has the odds of a neutral word."""

    @F.arrow_udf(T.DoubleType())
    def of(texts: pa.Array) -> pa.Array:
        plain = [t or "" for t in texts.to_pylist()]
        return pa.array([s for part in _portions(plain) for s in _scorer(model).scores(part)], type=pa.float64())

    return of(text)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _windows(texts: pa.Array) -> pa.Array:
    rows = []
    for t in texts.to_pylist():
        words = words_of(t or "")
        starts = _cut(len(words)).tolist()
        ends = [*starts[1:], len(words)]
        rows.append([" ".join(words[a:b]) for a, b in zip(starts, ends, strict=True)] if words else [])
    return pa.array(rows, type=pa.list_(pa.string()))


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning: crc32 of the id as text, modulo 5, is 0. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, seed: int = 4, train_docs: dict[int, int] | None = None) -> Model:
    """Fits on a bounded sample of labelled rows: ``train_docs`` documents of each label (TRAIN_DOCS if not given) in the
    order of a hash of their ids, with all windows of their whole texts. Ids that are held out, null labels and
    labels without a document are left out; of several labels of an id the higher counts. Only ids are
    collected to choose the sample, then its windows, then the odds of those not trained on."""
    train_docs = train_docs or TRAIN_DOCS
    known = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {label: known.filter(F.col("toxic") == label).count() for label in train_docs}
    ids = None
    for label, most in train_docs.items():
        part = known.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most)
        ids = part if ids is None else ids.unionByName(part)
    chosen = ids.withColumnRenamed("doc_id", "_id")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "toxic", _windows("text").alias("all"))
    rows = texts.select("doc_id", "toxic", F.explode(F.array_distinct("all")).alias("window")).orderBy("doc_id", "window").toArrow()
    windows, ids_of, toxic = rows["window"].to_pylist(), rows["doc_id"].to_numpy(), rows["toxic"].to_numpy().astype(int)
    del rows
    share = counts[1] / max(1, sum(counts.values()))
    model = fit(windows, ids_of, toxic, share, seed)
    sample, first = np.unique(ids_of, return_index=True)
    kept = _kept(toxic[first])
    if not kept.any():
        return _crossed(model, windows, ids_of, toxic, share, seed)
    # the threshold, from whole texts of the documents that were not trained on
    judged = docs.sparkSession.createDataFrame([(int(i), int(t)) for i, t in zip(sample[kept], toxic[first][kept], strict=True)], "_id long, toxic int")
    raw = docs.select("doc_id", "text").join(F.broadcast(judged), F.col("doc_id") == F.col("_id")).select("toxic", worst(F.col("text"), model).alias("odds")).toArrow()
    at, scale = _threshold(raw["odds"].to_numpy(), raw["toxic"].to_numpy().astype(int), share)
    return Model(model.values, -at * scale, scale)


def scored(docs: DataFrame, labels: DataFrame, text_col: str = "text", train_docs: dict[int, int] | None = None) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 from a score of 0.5); input columns of those names are replaced.

    Null text counts as empty. Without toxic labels to learn from, all scores are near 0. ``docs`` may be empty.
    ``train_docs`` bounds the labelled documents learned from, by label; every document is scored, by all its words.
    """
    model = train(docs, labels, train_docs=train_docs)
    return docs.withColumn("score", scores(F.col(text_col), model)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

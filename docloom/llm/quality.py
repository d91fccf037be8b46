"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network in numpy."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import fold, read, text_or_empty, word_blocks
from docloom.llm.sampling import sample_per_class

DIMENSIONS, NONZERO, WINDOW, HIDDEN = 64, 6, 2, 24
#: Labelled documents of each class that the classifier is fitted on at most; everything else covers all rows.
SAMPLE_PER_CLASS = 2000
#: Words with a context vector of their own; others are known by their shape alone.
VOCABULARY = 20_000
#: Words remembered at once while pooling.
REMEMBERED = 200_000
#: Plain figures of a text beside its pooled vectors.
FIGURES = 6
_RUNS = re.compile(rb"(.)\1+", re.S)
_SHAPE = bytes(65 if 65 <= c < 91 else 97 if 97 <= c < 123 or c >= 128 else 48 if 48 <= c < 58 else c for c in range(256))


def shape(word: bytes) -> bytes:
    """Letters, capitals and digits as a, A and 0, runs as one: what is left of a word nobody has seen."""
    return b"\0" + _RUNS.sub(rb"\1", word.translate(_SHAPE))[:12]


def index_vector(token: bytes) -> np.ndarray:
    """The token's sparse ternary random vector, drawn from its own hash."""
    rng = np.random.default_rng(xxhash.xxh64_intdigest(token, 3))
    out = np.zeros(DIMENSIONS, np.float32)
    out[rng.choice(DIMENSIONS, NONZERO, replace=False)] = rng.choice([-1, 1], NONZERO)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-6)


class Vectors:
    """Random-indexing vectors of words and shapes, from the texts of a bounded sample.

    ``words`` and ``shapes`` map a token to its row of ``word_rows`` and ``shape_rows``; the last row of each is zero and
    stands for what the sample hasn't shown.
    """

    def __init__(self, texts: list[bytes]):
        counts: dict[bytes, int] = {}
        for t in texts:
            for w in t.split():
                counts[w] = counts.get(w, 0) + 1
        known = sorted((w for w, n in counts.items() if n > 1), key=lambda w: (-counts[w], w))[:VOCABULARY]
        self.words = {w: i for i, w in enumerate(known)}
        shapes = sorted({shape(w) for w in counts})
        self.shapes = {s: i for i, s in enumerate(shapes)}
        index = np.array([index_vector(t) for t in known + shapes] or np.zeros((1, DIMENSIONS)), np.float32)
        context = np.zeros_like(index)
        for t in texts:
            words = t.split()
            own = np.array([self.words.get(w, -1) for w in words], np.int64)
            form = np.array([len(known) + self.shapes[shape(w)] for w in words], np.int64)
            signal = index[form] + np.where((own >= 0)[:, None], index[own], 0)
            around = np.zeros_like(signal)
            for k in range(1, WINDOW + 1):
                around[k:] += signal[:-k]
                around[:-k] += signal[k:]
            np.add.at(context, form, around)
            np.add.at(context, own[own >= 0], around[own >= 0])
        vectors = unit(context) + 0.5 * unit(index)
        zero = np.zeros((1, DIMENSIONS), np.float32)
        self.word_rows = np.concatenate((vectors[: len(known)], zero))
        self.shape_rows = np.concatenate((vectors[len(known) :], zero))


class Reader:
    """A text as the rows of its distinct words and shapes, how often each comes, and some plain figures."""

    def __init__(self, words: dict[bytes, int], shapes: dict[bytes, int]):
        self.words, self.shapes, self.at, self.rows = words, shapes, {}, []

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows: word and shape of each distinct word, its share of the words, figures); long texts are read block by block."""
        if len(self.rows) > REMEMBERED:
            self.at, self.rows = {}, []
        found, counts, n, same, last = [], [], 0, 0, -1
        for words in word_blocks(text):
            if not words:
                continue
            for w in set(words).difference(self.at):
                self.at[w] = len(self.rows)
                self.rows.append((self.words.get(w, len(self.words)), self.shapes.get(shape(w), len(self.shapes))))
            ids = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
            some, times = np.unique(ids, return_counts=True)
            found.append(some)
            counts.append(times)
            same += int((ids[1:] == ids[:-1]).sum()) + (ids[0] == last)
            n, last = n + len(ids), ids[-1]
        if not n:
            return np.zeros((0, 2), np.int64), np.zeros(0, np.float32), np.zeros(FIGURES, np.float32)
        some, times = found[0], counts[0]
        if len(found) > 1:
            some, place = np.unique(np.concatenate(found), return_inverse=True)
            times = np.bincount(place, np.concatenate(counts)).astype(np.int64)
        share = (times / n).astype(np.float32)
        figures = np.array((same / (n - 1) if n > 1 else 0, len(some) / n, share.max(), np.log1p(n) / 10, len(text) / n / 10, 1), np.float32)
        return np.array([self.rows[i] for i in some.tolist()], np.int64), share, figures


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Network:
    """Two layers, trained by minibatch gradient descent with momentum; temperature and shift from held-out rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, prior: float, seed: int = 9, epochs: int = 60):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = (x - self.mean) / self.scale
        order = rng.permutation(len(x))
        cut = len(x) * 4 // 5 if len(x) >= 20 else len(x)
        train, held = order[:cut], order[cut:] if cut < len(x) else order
        self.p = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        speed = [np.zeros_like(p) for p in self.p]
        for epoch in range(epochs):
            for some in np.array_split(rng.permutation(train), max(1, len(train) // 64)):
                a = x[some] @ self.p[0] + self.p[1]
                h = np.maximum(a, 0)
                e = (sigmoid(h @ self.p[2] + self.p[3]) - y[some]) / len(some)
                back = np.outer(e, self.p[2]) * (a > 0)
                slopes = [x[some].T @ back + 1e-3 * self.p[0], back.sum(axis=0), h.T @ e + 1e-3 * self.p[2], np.array([e.sum()])]
                for k, g in enumerate(slopes):
                    speed[k] = 0.9 * speed[k] - 0.05 * (1 - epoch / epochs) * g
                    self.p[k] = self.p[k] + speed[k]
        z, heats = self.raw(x[held]), np.geomspace(0.2, 10, 40)
        loss = [-np.mean(np.log(np.where(y[held] == 1, sigmoid(z / t), sigmoid(-z / t)) + 1e-9)) for t in heats]
        self.heat = float(heats[int(np.argmin(loss))])
        # the sample is drawn by class; the shift gives the classes the shares they have in all labelled rows
        here = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.shift = float(np.log(np.clip(prior, 1e-3, 1 - 1e-3) / (1 - np.clip(prior, 1e-3, 1 - 1e-3))) - np.log(here / (1 - here)))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.p[0] + self.p[1], 0) @ self.p[2] + self.p[3]

    def folded(self, vectors: Vectors) -> dict:
        """What scoring needs: the first layer applied to each row beforehand, as pooling and that layer are both linear."""
        first = self.p[0] / self.scale[:, None]
        return {
            "words": vectors.words,
            "shapes": vectors.shapes,
            "word_rows": (vectors.word_rows @ first[:DIMENSIONS]).astype(np.float32),
            "shape_rows": (vectors.shape_rows @ first[DIMENSIONS : 2 * DIMENSIONS]).astype(np.float32),
            "figures": first[2 * DIMENSIONS :],
            "offset": self.p[1] - self.mean @ first,
            "second": self.p[2],
            "bias": float(self.p[3][0]),
            "heat": self.heat,
            "shift": self.shift,
        }


def fit(texts: list[bytes], y: np.ndarray, prior: float) -> dict:
    vectors = Vectors(texts)
    reader, x = Reader(vectors.words, vectors.shapes), []
    for t in texts:
        rows, share, figures = reader(t)
        x.append(np.concatenate((share @ vectors.word_rows[rows[:, 0]], share @ vectors.shape_rows[rows[:, 1]], figures)))
    return Network(np.array(x), y, prior).folded(vectors)


def scores(model: dict, reader: Reader, texts) -> np.ndarray:
    hidden = np.zeros((len(texts), HIDDEN))
    for i, t in enumerate(texts):
        rows, share, figures = reader(t)
        hidden[i] = share @ model["word_rows"][rows[:, 0]] + share @ model["shape_rows"][rows[:, 1]] + figures @ model["figures"]
    z = np.maximum(hidden + model["offset"], 0) @ model["second"] + model["bias"]
    return sigmoid(z / model["heat"] + model["shift"])


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, passing: list[str] | None = None) -> DataFrame:
    """doc_id, score, predicted of each row of ``docs(doc_id, text)``; learns from ``labels(doc_id, quality)``.

    The classifier is fitted on SAMPLE_PER_CLASS labelled documents of each class at most: the labels are sampled first
    and then sent to the documents, so that no text is shuffled but the sample's, which one task fits.

    score is the calibrated probability of label 1. Null text counts as empty; an empty text is scored like any other,
    by the zero vector. With no labelled rows every score is 0.5; with one class only, that class's label. Rows with a
    null label teach nothing; repeated rows are scored alike; an empty table gives no rows. ``passing`` names columns of
    ``docs`` to return unchanged; those must not be called score or predicted.
    """
    labels = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    counts = {r.quality: r["count"] for r in labels.groupBy("quality").count().collect()}
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    few = F.broadcast(sample_per_class(labels, "quality", SAMPLE_PER_CLASS))
    sample = docs.select("doc_id", text_or_empty().cast("binary").alias("text")).join(few, "doc_id").repartition(1)

    def learn(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted((r for pdf in it for r in zip(pdf.doc_id, pdf.quality, pdf.text, strict=True)), key=lambda r: (r[0], r[2]))
        y = np.array([q for _, q, _ in rows], float)
        both = 0 < y.mean() < 1 if len(y) else False
        model = fit([t for _, _, t in rows], y, prior) if both else float(y[0]) if len(y) else 0.5
        yield pd.DataFrame({"model": [pickle.dumps(model)]})

    found = sample.mapInPandas(learn, "model binary").collect()
    model = docs.sparkSession.sparkContext.broadcast(bytes(found[0].model) if found else pickle.dumps(0.5))

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fitted = pickle.loads(model.value)
        reader = Reader(fitted["words"], fitted["shapes"]) if isinstance(fitted, dict) else None
        for pdf in it:
            score = scores(fitted, reader, pdf._bytes) if reader else np.full(len(pdf), fitted)
            own = {c: pdf[c] for c in ["doc_id", *kept]}
            yield pd.DataFrame(own | {"score": score, "predicted": (score >= threshold).astype(np.int32)})

    kept, types = passing or [], dict(docs.dtypes)
    base = docs.select("doc_id", *kept, text_or_empty().cast("binary").alias("_bytes"))
    schema = ", ".join(f"`{c}` {types[c]}" for c in ["doc_id", *kept])
    return base.mapInPandas(batches, f"{schema}, score double, predicted int")


def training_labels(labels: DataFrame) -> DataFrame:
    """The labels to learn from: those outside fold 0 of five."""
    return labels.where(fold(5) != 0).select("doc_id", "quality")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = score_quality(docs, training_labels(read(spark, sf_dir, "labels")))
    return found.select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted")

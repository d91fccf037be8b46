"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import fold, read, text_or_empty
from docloom.llm.sampling import sample_per_class

BUCKETS = 1 << 15
WIDTHS = (2, 3, 4)
#: Training documents of each language at most; a documented bound, everything else covers all rows.
SAMPLE_PER_LANGUAGE = 800
DIMENSIONS, EPOCHS, RATE = 16, 4, 0.5
#: Bytes of a text whose n-grams are held at once.
BLOCK = 1 << 18

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[*range(33), *range(48, 58)]] = 32  # white space, controls and digits end a word


def subwords(text: bytes) -> Iterator[np.ndarray]:
    """Hash buckets of a text's byte n-grams, with word ends as spaces, BLOCK starts at a time."""
    every = np.frombuffer(text, np.uint8)
    for at in range(0, len(every), BLOCK):
        x = _FOLD[every[at : at + BLOCK + max(WIDTHS) - 1]]
        h = x.copy()
        for n in range(1, max(WIDTHS)):
            h = h[:-1] * np.uint32(0x01000193) ^ x[n:]
            if n + 1 in WIDTHS and len(h):
                mixed = h[:BLOCK] * np.uint32(0x9E3779B1)
                yield (mixed ^ (mixed >> np.uint32(15))) >> np.uint32(2) & np.uint32(BUCKETS - 1)


def shares(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct buckets and their shares: at most BUCKETS numbers, however long the text."""
    if len(text) <= BLOCK:
        found = list(subwords(text))
        at, n = np.unique(np.concatenate(found) if found else np.empty(0, np.uint32), return_counts=True)
    else:
        counts = np.zeros(BUCKETS, np.int64)
        for some in subwords(text):
            counts += np.bincount(some, minlength=BUCKETS)
        at = np.flatnonzero(counts)
        n = counts[at]
    return at.astype(np.int64), (n / max(1, n.sum())).astype(np.float32)


def mean_row(text: bytes, table: np.ndarray) -> np.ndarray | int:
    """The mean of the table's rows over a text's n-grams; 0 for texts without any."""
    if len(text) > BLOCK:
        at, share = shares(text)
        return share @ table[at]
    found = list(subwords(text))
    return table[np.concatenate(found)].mean(axis=0) if found else 0


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray, float]:
    """(score table: buckets x classes, bias, temperature) from each document's buckets and their shares.

    Averaging embeddings and then a linear layer is the same as averaging rows of their product, which is the table.
    The last fifth of the documents sets the temperature that makes the probabilities fit.
    """
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weight, bias = np.zeros((DIMENSIONS, classes), np.float32), np.zeros(classes, np.float32)
    order = rng.permutation(len(docs))
    train, held = (order[: len(order) * 4 // 5], order[len(order) * 4 // 5 :]) if len(order) >= 20 else (order, order)
    steps, step = EPOCHS * len(train), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(train):
            at, share = docs[i]
            rate = RATE * (1 - step / steps)
            step += 1
            mean = share @ table[at]
            error = softmax(mean @ weight + bias)
            error[y[i]] -= 1
            back = weight @ error
            weight -= rate * np.outer(mean, error)
            bias -= rate * error * 0.1
            table[at] -= rate * 10 * share[:, None] * back
    scores = table @ weight
    z = np.array([docs[i][1] @ scores[docs[i][0]] + bias for i in held])
    heats = np.geomspace(0.05, 20, 60)
    loss = [-np.log(softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean() for t in heats]
    return scores, bias, float(heats[int(np.argmin(loss))])


def identify(docs: DataFrame, training: DataFrame, reject_below: float = 0.5) -> DataFrame:
    """doc_id, lang_pred, score, rejected of each row of ``docs(doc_id, text)``; learns from ``training(doc_id, text, lang)``.

    One task fits the model on a sample of SAMPLE_PER_LANGUAGE documents of each language at most.

    score is the calibrated probability of lang_pred, and ``rejected`` marks those below ``reject_below``. Texts that
    are null or without a letter are ``und`` with score 0, and so is every text when there is nothing to learn from.
    Ties go to the language first by name. Repeated rows are predicted alike; an empty table gives no rows.
    """
    sample = sample_per_class(training.where("lang is not null"), "lang", SAMPLE_PER_LANGUAGE)

    def learn(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted((r for pdf in it for r in zip(pdf.lang, pdf.doc_id, pdf.text, strict=True)), key=lambda r: (r[0], pd.isna(r[1]), r[1], r[2]))
        names = sorted({lang for lang, _, _ in rows})
        fitted = fit([shares(t) for _, _, t in rows], np.array([names.index(lang) for lang, _, _ in rows]), len(names)) if names else None
        yield pd.DataFrame({"model": [pickle.dumps((names, fitted))]})

    bounded = sample.select("lang", "doc_id", text_or_empty().cast("binary").alias("text")).repartition(1)
    found = bounded.mapInPandas(learn, "model binary").collect()
    model = docs.sparkSession.sparkContext.broadcast(bytes(found[0].model) if found else pickle.dumps(([], None)))
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, fitted = pickle.loads(model.value)
        table, bias, heat = fitted or (None, None, None)
        for pdf in it:
            said, score = [], []
            for text, letters in zip(pdf.text, pdf.letters, strict=True):
                if not (letters and names):
                    said.append("und")
                    score.append(0.0)
                    continue
                p = softmax((mean_row(text, table) + bias) / heat)
                said.append(names[int(np.argmax(p))])
                score.append(float(p.max()))
            yield pd.DataFrame({"doc_id": pdf.doc_id, "lang_pred": said, "score": np.array(score, float), "rejected": np.array(score, float) < reject_below})

    base = docs.select("doc_id", text_or_empty().cast("binary").alias("text"), has_letter.alias("letters"))
    return base.mapInPandas(batches, "doc_id long, lang_pred string, score double, rejected boolean")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = identify(docs, docs.where(fold(3) != 1).select("doc_id", "text", "lang"))
    return found.select("doc_id", (fold(3) == 1).alias("held_out"), "lang_pred", "score", "rejected")

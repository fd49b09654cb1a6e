"""Toxicity: averaged subword embeddings under a linear softmax, scored over windows of a text.

Misspelt and unseen words share the vectors of their character n-grams. The model is fitted on
the driver from at most ``max_train_docs`` labelled rows: first on whole texts, then, since a few
words make a text toxic, on the window of each text that the model so far finds worst. A text is
as toxic as the worst of its windows, which begin at every word.

Defined results: a score at the threshold (a tie) is toxic; of very long texts every window is scored; null or empty text, or one without words, scores 0 and is kept; a null doc_id is scored
as any row; repeated rows are each scored alike; without labels of both classes nothing is rejected; an
empty table gives an empty table; ``keep_clean`` passes extra columns through whatever their names.
"""

from __future__ import annotations

import re
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm._spark import label_sample
from quarry.llm._subword import SubwordSoftmax, fit

MAX_TRAIN_DOCS = 4000
WINDOW = 2
THRESHOLD = 0.8
_WORD = re.compile(r"[a-z0-9\x80-\U0010ffff]+")


def fit_windows(rows: list[tuple[str, str]], width: int = WINDOW, rounds: int = 3, seed: int = 7) -> SubwordSoftmax:
    """``rows``: (label '0' or '1', text). Windows: of each text the worst one so far, of clean texts also those of the rounds before and two others.

    Labels are noisy: after the first round a toxic text whose worst window is under even odds sits that round out.
    """
    model = fit(rows, dim=4, epochs=3, rate=1.0, seed=seed)
    if len(model.classes) < 2:
        return model
    rng = np.random.default_rng(seed)
    column = pa.array([t for _, t in rows], pa.string())
    hard: list[tuple[str, str]] = []
    for turn in range(rounds):
        best, place = model.margins(column, width)
        toxic, random = [], []
        for (y, t), p, odds in zip(rows, place, best, strict=True):
            words = [w for w, _ in groupby(_WORD.findall(t.lower()))]  # again each round: the driver never holds all words
            if not words:
                continue
            if y == "0" or not turn or odds >= 0:
                (toxic if y == "1" else hard).append((y, " ".join(words[p : p + width])))
            if y == "0":
                random += [(y, " ".join(words[q : q + width])) for q in rng.integers(0, max(1, len(words) - width + 1), 2)]
        model = fit(hard + toxic + random, dim=4, epochs=4, rate=1.0, seed=seed)
    return model


def train(docs: DataFrame, labels: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS) -> SubwordSoftmax:
    return fit_windows(label_sample(docs, labels, F.col("toxic").cast("int"), max_train_docs))


def _scorer(model: SubwordSoftmax, width: int):
    def scores(column: pa.Array) -> np.ndarray:
        if model.classes != ["0", "1"]:
            return np.zeros(len(column))
        return 1 / (1 + np.exp(-np.clip(model.margins(column, width)[0], -700, 700)))

    return scores


def score(docs: DataFrame, model: SubwordSoftmax, threshold: float = THRESHOLD, width: int = WINDOW) -> DataFrame:
    """doc_id, toxicity (probability), toxic (at or over ``threshold``)."""
    scores = _scorer(model, width)

    def run(batches):
        for b in batches:
            p = scores(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p), pa.array(p >= threshold)], ["doc_id", "toxicity", "toxic"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, toxicity double, toxic boolean")


def keep_clean(docs: DataFrame, model: SubwordSoftmax, threshold: float = THRESHOLD, width: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that aren't toxic, columns unchanged."""
    scores = _scorer(model, width)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(scores(b.column(at)) < threshold))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))

"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

A feature is a hashed n-gram of characters (code points) of the lower-cased text (orders 2 and 3, over whole texts, however long); its value is its
share of the text's n-grams times its inverse document frequency among the training rows, so a text's score is linear
in its occurrences. Weights are fitted by follow-the-regularised-leader (per-coordinate FTRL-Proximal) with
elastic-net penalties, L1 leaving most of them zero; a temperature fitted on rows held out of
the training then calibrates the probabilities. At most ``MAX_TRAIN_DOCS`` labelled rows are used to fit.

Defined results: null, empty and one-character texts get language 'und' with confidence 0; without training rows all do; where the training rows have one
language alone every other text gets it with confidence 1; a
null doc_id is kept as any row; repeated rows are each scored alike; ties take the first language by name; an
empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._spark import label_sample
from quarry.llm._text import as_strings, chunks, raw

MAX_TRAIN_DOCS = 2000
BUCKETS = 1 << 16
ORDERS = (2, 3)


def _grams(column: pa.Array, buckets: int = BUCKETS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: the bucket of the n-gram at each character, n-grams a row, and whether the n-gram lies inside one row."""
    body, offsets = raw(pc.utf8_lower(as_strings(column)))
    wide = np.frombuffer(body.tobytes().decode().encode("utf-32-le"), np.uint32)
    begins = np.append(0, np.cumsum((body & 0xC0) != 0x80))  # characters before each byte
    offsets = begins[offsets]
    out = []
    for n in ORDERS:
        size = np.diff(offsets)
        count = np.maximum(0, size - n + 1)
        total = max(0, len(wide) - n + 1)
        key = np.zeros(total, np.uint32)
        for k in range(n):
            key = key * np.uint32(0x01000193) + wide[k : k + total]
        key = (key * np.uint32(0x9E3779B1)) >> np.uint32(16)
        inside = np.ones(total, bool)
        for k in range(1, n):
            at = offsets[1:-1] - k
            inside[at[(at >= 0) & (at < total)]] = False
        out.append(((key ^ np.uint32(n * 0x2B5)) & np.uint32(buckets - 1), count, inside))
    return out


@dataclass
class LanguageModel:
    classes: list[str]
    folded: np.ndarray  # (buckets, classes), idf times weight, float32
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(rows, classes) before the temperature, and n-grams a row."""
        out, n = np.tile(self.bias, (len(column), 1)), np.zeros(len(column), np.int64)
        k = len(self.classes)
        # weights of four classes at a time, as one 16-byte gather
        table = np.zeros((len(self.folded), -(-k // 4) * 4), np.float32)
        table[:, :k] = self.folded
        for at, part in chunks(column):
            grams = _grams(part)
            rows = sum(c for _, c, _ in grams)
            n[at : at + len(part)] = rows
            total = np.zeros((len(part), table.shape[1]))
            for bucket, count, inside in grams:
                if not count.sum():
                    continue
                value = table[bucket[inside]]
                some = np.flatnonzero(count)
                total[some] += np.add.reduceat(value, np.cumsum(count[some]) - count[some], axis=0, dtype=np.float64)
            out[at : at + len(part)] += total[:, :k] / np.maximum(1, rows)[:, None]
        return out, n

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        if not self.classes:
            return ["und"] * len(column), np.zeros(len(column))
        z, n = self.logits(column)
        p = softmax(z / self.temperature)
        best = p.argmax(1)
        return [self.classes[k] if m else "und" for k, m in zip(best.tolist(), n.tolist(), strict=True)], np.where(n > 0, p[np.arange(len(p)), best], 0.0)


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[str, str]], alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.001, epochs: int = 4, batch: int = 32, seed: int = 5) -> LanguageModel:
    """``rows``: (language, text). A fifth of them, by a seeded shuffle, only sets the temperature."""
    classes = sorted({y for y, _ in rows})
    if len(classes) < 2:
        return LanguageModel(classes, np.zeros((BUCKETS, len(classes)), np.float32), np.zeros(len(classes)))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held, used = order[: len(rows) // 5], order[len(rows) // 5 :]
    if len({rows[i][0] for i in used}) < len(classes):
        used = order
    y = np.array([classes.index(rows[i][0]) for i in used])
    cols, vals = [], []
    for i in used:
        b = np.concatenate([bucket[inside] for bucket, _, inside in _grams(pa.array([rows[i][1]], pa.string()))])
        c, m = np.unique(b, return_counts=True)
        cols.append(c.astype(np.int64))
        vals.append(m / max(1, len(b)))
    df = np.bincount(np.concatenate(cols), minlength=BUCKETS)
    idf = np.log((1 + len(used)) / (1 + df)) + 1
    scale = 10.0
    k = len(classes)
    z, n, w = np.zeros((BUCKETS, k)), np.zeros((BUCKETS, k)), np.zeros((BUCKETS, k))
    bias, seen = np.zeros(k), np.full(k, 1e-6)
    weight = len(y) / (k * np.bincount(y, minlength=k))
    for _ in range(epochs):
        turn = rng.permutation(len(y))
        for at in range(0, len(turn), batch):
            ids = turn[at : at + batch]
            col = np.concatenate([cols[i] for i in ids])
            val = np.concatenate([vals[i] * idf[cols[i]] * scale for i in ids])
            doc = np.repeat(np.arange(len(ids)), [len(cols[i]) for i in ids])
            touched, where = np.unique(col, return_inverse=True)
            score = np.stack([np.bincount(doc, weights=w[col, c] * val, minlength=len(ids)) for c in range(k)], 1) + bias
            p = softmax(score)
            p[np.arange(len(ids)), y[ids]] -= 1
            p *= weight[y[ids]][:, None] / len(ids)
            g = np.stack([np.bincount(where, weights=p[doc, c] * val, minlength=len(touched)) for c in range(k)], 1)
            sigma = (np.sqrt(n[touched] + g**2) - np.sqrt(n[touched])) / alpha
            z[touched] += g - sigma * w[touched]
            n[touched] += g**2
            zt = z[touched]
            w[touched] = np.where(np.abs(zt) <= l1, 0, -(zt - np.sign(zt) * l1) / ((beta * 0.01 + np.sqrt(n[touched])) / alpha + l2))
            seen += p.sum(0) ** 2
            bias -= 0.1 * p.sum(0) / np.sqrt(seen)
    model = LanguageModel(classes, (w * idf[:, None] * scale).astype(np.float32), bias)
    if len(held):
        logit, _ = model.logits(pa.array([rows[i][1] for i in held], pa.string()))
        truth = np.array([classes.index(rows[i][0]) for i in held])
        grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
        loss = [-np.log(softmax(logit / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def train(docs: DataFrame, labels: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS) -> LanguageModel:
    return fit(label_sample(docs, labels, F.col("lang"), max_train_docs))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, language, confidence."""

    def run(batches):
        for b in batches:
            lang, p = model.predict(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(p)], ["doc_id", "language", "confidence"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, language string, confidence double")

"""A linear softmax over averaged subword embeddings, trained jointly in numpy.

A word's vector is the mean of its subwords' vectors, a text's that of its words'. Since both
layers are linear, scoring folds them into one logit a bucket and class.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from quarry.llm._text import Words, chunks, subwords


@dataclass
class SubwordSoftmax:
    classes: list[str]
    folded: np.ndarray  # (buckets, classes)
    bias: np.ndarray

    @property
    def buckets(self) -> int:
        return len(self.folded)

    def logits(self, column: pa.Array) -> np.ndarray:
        """(rows, classes); a text without words has the bias alone."""
        out = np.tile(self.bias, (len(column), 1))
        for at, part in chunks(column):
            words = Words(part)
            if not len(words.hash):
                continue
            bucket, owner, which = subwords(words, self.buckets)
            count = np.bincount(owner)
            n = np.maximum(1, words.per_row())
            for k in range(len(self.classes)):
                word = np.bincount(owner, weights=self.folded[bucket, k]) / count
                out[at : at + len(part), k] += np.bincount(words.row, weights=word[which], minlength=len(part)) / n
        return out

    def margins(self, column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
        """For a model of two classes: the greatest log-odds of class 1 over all runs of ``width`` words of a row, one from each word on, and where that window begins.

        A run of one word repeated counts as one word, here and in where a window begins. A row of fewer words is one window; a row without words has minus infinity.
        """
        best, place = np.full(len(column), -np.inf), np.zeros(len(column), np.int64)
        odds, bias = self.folded[:, 1] - self.folded[:, 0], self.bias[1] - self.bias[0]
        for at, part in chunks(column):
            words = Words(part)
            if not len(words.hash):
                continue
            bucket, owner, which = subwords(words, self.buckets)
            kept = np.ones(len(which), bool)
            kept[1:] = (which[1:] != which[:-1]) | (words.row[1:] != words.row[:-1])
            word, rows = (np.bincount(owner, weights=odds[bucket]) / np.bincount(owner))[which[kept]], words.row[kept]
            n = np.bincount(rows, minlength=len(part))
            spot = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
            size = np.minimum(width, n[rows])
            begin = np.flatnonzero(spot + size <= n[rows])
            size = size[begin]
            mean = word[begin]
            for k in range(1, width):
                more = size > k
                mean[more] += word[begin[more] + k]
            mean = mean / size + bias
            order = np.lexsort((-mean, rows[begin]))
            row, first = np.unique(rows[begin][order], return_index=True)
            best[at + row], place[at + row] = mean[order[first]], spot[begin[order[first]]]
        return best, place

    def posteriors(self, column: pa.Array) -> np.ndarray:
        z = self.logits(column)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def bags(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CSR rows of each text's mean subword counts."""
    column = pa.array(texts, pa.string())
    cols, vals, sizes = [], [], np.zeros(len(texts), np.int64)
    for at, part in chunks(column):
        words = Words(part)
        if not len(words.hash):
            continue
        bucket, owner, which = subwords(words, buckets)
        per_word = np.bincount(owner)
        order = np.argsort(owner, kind="stable")
        bucket = bucket[order]
        begin = np.cumsum(per_word) - per_word
        n = words.per_row()
        key, times = np.unique(words.row.astype(np.int64) * len(per_word) + which, return_counts=True)
        row, word = key // len(per_word), key % len(per_word)
        size = per_word[word]
        flat = np.repeat(begin[word] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        value = np.repeat(times / (n[row] * size), size)
        spot = np.repeat(row, size) * buckets + bucket[flat]
        spot, where = np.unique(spot, return_inverse=True)
        cols.append((spot % buckets).astype(np.int32))
        vals.append(np.bincount(where, weights=value).astype(np.float32))
        sizes[at : at + len(part)] += np.bincount(spot // buckets, minlength=len(part))
    return _joined(cols, np.int32), _joined(vals, np.float32), np.append(0, np.cumsum(sizes))


def _joined(parts: list[np.ndarray], kind: type) -> np.ndarray:
    """The parts in one array; each is let go once copied, so the driver doesn't hold all twice."""
    out, at = np.empty(sum(map(len, parts)), kind), 0
    parts.reverse()
    while parts:
        some = parts.pop()
        out[at : at + len(some)] = some
        at += len(some)
    return out


def fit(rows: list[tuple[str, str]], buckets: int = 1 << 16, dim: int = 8, epochs: int = 12, rate: float = 0.5, seed: int = 7, batch: int = 64) -> SubwordSoftmax:
    """Fit by minibatch Adagrad on class-balanced cross-entropy. Without rows: no class known, all texts 'unknown'."""
    if not rows:
        return SubwordSoftmax(["unknown"], np.zeros((buckets, 1)), np.zeros(1))
    classes = sorted({y for y, _ in rows})
    y = np.array([classes.index(c) for c, _ in rows])
    cols, vals, ptr = bags([t for _, t in rows], buckets)
    rng = np.random.default_rng(seed)
    emb, head, bias = rng.normal(0, 0.1, (buckets, dim)), rng.normal(0, 0.5, (dim, len(classes))), np.zeros(len(classes))
    seen = [np.full_like(emb, 1e-8), np.full_like(head, 1e-4), np.full_like(bias, 1e-4)]
    weight = len(y) / (len(classes) * np.bincount(y, minlength=len(classes)))
    for _ in range(epochs if len(classes) > 1 else 0):
        shuffled = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            ids = shuffled[at : at + batch]
            size = ptr[ids + 1] - ptr[ids]
            flat = np.repeat(ptr[ids] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            doc, c, v = np.repeat(np.arange(len(ids)), size), cols[flat], vals[flat]
            hidden = np.stack([np.bincount(doc, weights=emb[c, k] * v, minlength=len(ids)) for k in range(dim)], 1)
            z = hidden @ head + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(ids)), y[ids]] -= 1
            p *= (weight[y[ids]] / len(ids))[:, None]
            back = p @ head.T
            touched, where = np.unique(c, return_inverse=True)
            grad = np.stack([np.bincount(where, weights=back[doc, k] * v, minlength=len(touched)) for k in range(dim)], 1)
            seen[0][touched] += grad**2
            emb[touched] -= rate * grad / np.sqrt(seen[0][touched])
            for value, g, s in ((head, hidden.T @ p, seen[1]), (bias, p.sum(0), seen[2])):
                s += g**2
                value -= 0.1 * g / np.sqrt(s)
    return SubwordSoftmax(classes, emb @ head, bias)

"""Mixing sources to target weights by soft membership.

A linear softmax over hashed words, fitted on at most ``MAX_TRAIN_DOCS`` rows of the label table, gives each
document its posterior over domains. With t tokens and posterior p, at rate r a document is expected to
bring t r p_k tokens of domain k. Projected gradient descent, accelerated, finds rates r >= 0 that minimise
``sum_k (E_k - T_k)^2 / E0_k``, T being the target weights times all tokens and E0 the totals at rate 1: from r = 1, each
step takes ``p . v`` off every rate and cuts at 0, v being the scaled residual that one distributed sum gives. In the token metric
the scaled Hessian's rows sum to 1, so a step of 1 is safe at every size. Only K numbers a step travel.

The mixture takes floor(r) copies of a document and one more with chance r - floor(r), by a hash of its id and text.

Defined results: null and empty texts count one token and have the prior as posterior; very long texts are read whole and weigh by their tokens; draws tied with a rate
take no further copy; without labelled rows of two
domains every rate is 1; a null doc_id is rated as any row; repeated rows have equal rates and draws; an empty
table gives an empty table; a target of unknown domain is an error; extra columns pass ``mix`` unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm._spark import checkpoint, label_sample
from quarry.llm._text import Words, as_strings, chunks, raw

MAX_TRAIN_DOCS = 4000
BUCKETS = 1 << 15
STEPS = 60
TOLERANCE = 1e-4
TARGETS = {"high": 0.9, "low": 0.1}


def quality_domain() -> Column:
    """The label table's domains: 'high' and 'low' quality."""
    return F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")


@dataclass
class DomainModel:
    domains: list[str]
    weight: np.ndarray  # (buckets, domains)
    bias: np.ndarray

    def posteriors(self, column: pa.Array) -> np.ndarray:
        z = np.tile(self.bias, (len(column), 1))
        for at, part in chunks(column):
            bucket, row, value = _features(part)
            for k in range(len(self.domains)):
                z[at : at + len(part), k] += np.bincount(row, weights=self.weight[bucket, k] * value, minlength=len(part))
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def _features(part: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, row and value: words, shares of the text's words, and five shares of kinds of characters and words."""
    words = Words(part)
    n = np.maximum(1, words.per_row())
    bucket, row, value = (words.hash % np.uint64(BUCKETS - 8)).astype(np.int64), words.row, 1.0 / n[words.row]
    body, offsets = raw(as_strings(part))
    size = np.maximum(1, np.diff(offsets))
    kinds = [(body >= 65) & (body <= 90), (body >= 48) & (body <= 57), (body == 33) | (body == 124) | (body == 35) | (body == 42), body == 10, (body == 46) | (body == 44)]
    shares = [np.diff(np.append(0, np.cumsum(x, dtype=np.int64))[offsets]) / size for x in kinds]
    new = np.append(True, (words.hash[1:] != words.hash[:-1]) | (row[1:] != row[:-1])) if len(row) else np.zeros(0, bool)
    shares += [np.bincount(row, weights=~new, minlength=len(part)) / n, np.minimum(1.0, np.log1p(n) / 10)]
    extra = np.arange(len(shares)) + BUCKETS - 8
    here = np.arange(len(part))
    return (
        np.concatenate([bucket, np.repeat(extra, len(part))]),
        np.concatenate([row, np.tile(here, len(shares))]),
        np.concatenate([value * 8, *[s * 8 for s in shares]]),
    )


def fit(rows: list[tuple[str, str]], epochs: int = 12, rate: float = 0.5, batch: int = 32, seed: int = 3) -> DomainModel:
    """Minibatch Adagrad on cross-entropy, weighted by the domains' shares as they are."""
    domains = sorted({y for y, _ in rows})
    if len(domains) < 2:
        return DomainModel(domains or ["all"], np.zeros((BUCKETS, 1)), np.zeros(1))
    y = np.array([domains.index(d) for d, _ in rows])
    cols, vals, sizes = [], [], []
    for _, part in chunks(pa.array([t for _, t in rows], pa.string())):  # a chunk at a time: the driver never holds all words
        c, r, v = _features(part)
        order = np.lexsort((c, r))
        c, r, v = c[order], r[order], v[order]
        new = np.flatnonzero(np.append(True, (c[1:] != c[:-1]) | (r[1:] != r[:-1])))
        cols.append(c[new].astype(np.int32))
        vals.append(np.add.reduceat(v, new).astype(np.float32))
        sizes.append(np.bincount(r[new], minlength=len(part)))
    col, val, ptr = np.concatenate(cols), np.concatenate(vals), np.append(0, np.cumsum(np.concatenate(sizes)))
    w, seen = np.zeros((BUCKETS, len(domains))), np.full((BUCKETS, len(domains)), 1e-4)
    bias, seen_b = np.log(np.bincount(y, minlength=len(domains)) / len(y)), np.full(len(domains), 1e-2)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        turn = rng.permutation(len(rows))
        for at in range(0, len(turn), batch):
            ids = turn[at : at + batch]
            size = ptr[ids + 1] - ptr[ids]
            flat = np.repeat(ptr[ids] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            doc, c, v = np.repeat(np.arange(len(ids)), size), col[flat], val[flat]
            z = np.stack([np.bincount(doc, weights=w[c, k] * v, minlength=len(ids)) for k in range(len(domains))], 1) + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(ids)), y[ids]] -= 1
            p /= len(ids)
            touched, where = np.unique(c, return_inverse=True)
            g = np.stack([np.bincount(where, weights=p[doc, k] * v, minlength=len(touched)) for k in range(len(domains))], 1) + 1e-5 * w[touched]
            seen[touched] += g**2
            w[touched] -= rate * g / np.sqrt(seen[touched])
            seen_b += p.sum(0) ** 2
            bias -= 0.05 * p.sum(0) / np.sqrt(seen_b)
    return DomainModel(domains, w, bias)


def train(docs: DataFrame, labels: DataFrame, domain: Column | None = None, max_train_docs: int = MAX_TRAIN_DOCS) -> DomainModel:
    return fit(label_sample(docs, labels, quality_domain() if domain is None else domain, max_train_docs, even=False))


def rates_of(p: np.ndarray, steps: list[np.ndarray], momentum: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Rates after all ``steps``, and the point from which the next gradient is taken."""
    x = y = np.ones(len(p))
    for v, m in zip(steps, momentum, strict=True):
        new = np.maximum(0.0, y - p @ v)
        x, y = new, new + m * (new - x)
    return x, y


def fit_rates(members: DataFrame, k: int, targets: np.ndarray, steps: int = STEPS, tolerance: float = TOLERANCE) -> tuple[list[np.ndarray], list[float], np.ndarray]:
    """``members``: tokens, p (array). The steps, their momenta, and the totals that the last rates give."""

    def totals(done: list[np.ndarray], momentum: list[float]) -> np.ndarray:
        def run(batches):
            sums = np.zeros(2 * k)
            for b in batches:
                p = b.column("p").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                t = b.column("tokens").to_numpy(zero_copy_only=False)
                x, y = rates_of(p, done, momentum)
                sums += np.concatenate([p.T @ (t * y), p.T @ (t * x)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * k)), pa.array(sums)], ["k", "total"])

        got = members.select("tokens", "p").mapInArrow(run, "k long, total double").groupBy("k").agg(F.sum("total").alias("total")).collect()  # 2 K rows
        out = np.zeros(2 * k)
        for r in got:
            out[r["k"]] = r["total"]
        return out

    done: list[np.ndarray] = []
    momentum: list[float] = []
    start = totals(done, momentum)[:k]
    goal = targets * start.sum()
    scale = np.maximum(start, 1e-9)
    at_y, at_x, age = start, start, 1.0
    for _ in range(steps):
        if np.abs(at_x - goal).max() <= tolerance * max(1e-9, goal.sum()):
            break
        after = (1 + np.sqrt(1 + 4 * age**2)) / 2
        done.append((at_y - goal) / scale)
        momentum.append((age - 1) / after)
        age = after
        both = totals(done, momentum)
        if ((both[k:] - goal) ** 2 / scale).sum() > ((at_x - goal) ** 2 / scale).sum():
            momentum[-1], age = 0.0, 1.0  # restart where momentum overshoots
            both[:k] = both[k:]
        at_y, at_x = both[:k], both[k:]
    return done, momentum, at_x


def members(docs: DataFrame, model: DomainModel) -> DataFrame:
    """doc_id, tokens, draw in [0, 1) from a hash of id and text, p."""

    def run(batches):
        for b in batches:
            p = model.posteriors(b.column("text"))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), p.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tokens"), b.column("draw"), flat], ["doc_id", "tokens", "draw", "p"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    tokens = F.greatest(F.coalesce(F.length("text"), F.lit(0)) / 4, F.lit(1)).cast("long")
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)
    return docs.select("doc_id", tokens.alias("tokens"), draw.alias("draw"), "text").mapInArrow(run, f"doc_id {kind}, tokens long, draw double, p array<double>")


def _targets(model: DomainModel, targets: dict[str, float]) -> np.ndarray | None:
    if len(model.domains) < 2:
        return None
    unknown = set(targets) - set(model.domains)
    if unknown:
        raise ValueError(f"no domain {sorted(unknown)}; there are {model.domains}")
    w = np.array([targets.get(d, 0.0) for d in model.domains])
    return w / w.sum()


def rate(docs: DataFrame, model: DomainModel, targets: dict[str, float] = TARGETS) -> DataFrame:
    """doc_id, tokens, one posterior column ``p_<domain>`` a domain, rate, copies."""
    goal = _targets(model, targets)
    table = checkpoint(members(docs, model))
    k = len(model.domains)
    steps, momentum, _ = fit_rates(table, k, goal) if goal is not None else ([], [], None)

    def run(batches):
        for b in batches:
            p = b.column("p").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            x, _ = rates_of(p, steps, momentum)
            n = np.floor(x + b.column("draw").to_numpy(zero_copy_only=False)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tokens"), *[pa.array(np.ascontiguousarray(p[:, i])) for i in range(k)], pa.array(x), pa.array(n)], ["doc_id", "tokens", *[f"p_{d}" for d in model.domains], "rate", "copies"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    cols = ", ".join(f"`p_{d}` double" for d in model.domains)
    return table.mapInArrow(run, f"doc_id {kind}, tokens long, {cols}, rate double, copies int")


def mix(docs: DataFrame, model: DomainModel, targets: dict[str, float] = TARGETS) -> DataFrame:
    """``docs`` with each row as often as its rate and draw tell, columns unchanged."""
    goal = _targets(model, targets)
    if goal is None:
        return docs
    k = len(model.domains)
    steps, momentum, _ = fit_rates(checkpoint(members(docs, model)), k, goal)
    at = docs.columns.index("text")
    names = [f"c{i}" for i in range(len(docs.columns))]
    draw = F.pmod(F.xxhash64(f"c{docs.columns.index('doc_id')}", f"c{at}"), F.lit(1 << 40)) / float(1 << 40)

    def run(batches):
        for b in batches:
            x, _ = rates_of(model.posteriors(b.column(at)), steps, momentum)
            n = np.floor(x + b.column(len(names)).to_numpy(zero_copy_only=False)).astype(np.int64)
            yield b.select(names).take(pa.array(np.repeat(np.arange(len(n)), n)))

    plain = docs.toDF(*names)
    out = plain.withColumn("_draw", draw).mapInArrow(run, plain.schema)
    return out.toDF(*docs.columns)

"""Document fingerprints: 64-bit SimHash of weighted words, and for each document its near copies within a Hamming radius.

A term is a word; its hash is the 64-bit prefix of its MD5, and its weight the bit length of how often the text has it (once 1, twice 2,
four times 3), so that a frequent word doesn't decide alone. Bit i of the fingerprint is set where terms with bit i set outweigh those
without. One edited word moves one term, where it would move N runs of N words: near copies stay within a few bits.

Search: the 64 bits are cut into ``radius + extra`` blocks, and a pair within ``radius`` agrees on at least
``extra`` of them, so one table a choice of ``extra`` blocks, keyed by the bits permuted to the front, holds
every pair in some bucket; a pair is taken in the first table that it agrees in, so it comes out once. Only distinct fingerprints enter the
tables: thousands of copies are one row. Within the radius the result is exact; no bucket is capped. ``extra`` changes the cost alone: more
and narrower tables as it grows, for corpora in which buckets of ``64 * extra / (radius + extra)`` bits would be full.

Defined results: very long texts are fingerprinted whole; null, empty and wordless texts have no fingerprint and are classes of their own without links;
repeated rows are each listed, and rows of equal fingerprints count as copies; rows of a null doc_id take part, and the class of none but such has
a null class_id; tied votes clear the bit; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._graph import components
from quarry.llm._spark import checkpoint
from quarry.llm._text import Words, chunks

RADIUS = 6
EXTRA = 3


class _Known(dict):
    """MD5 prefixes of words; emptied when large, since it only saves time."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = value = int.from_bytes(hashlib.md5(word).digest()[:8], "big")
        return value


def terms(words: Words, known: _Known) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and weight of each distinct word of each row of a chunk, by row."""
    if not len(words.hash):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    _, first, which = np.unique(words.hash, return_index=True, return_inverse=True)
    body = words.body.tobytes()
    h = np.array([known[body[a:b]] for a, b in zip(words.start[first].tolist(), words.end[first].tolist(), strict=True)], np.uint64)
    key, times = np.unique(words.row.astype(np.int64) * len(h) + which, return_counts=True)
    return h[key % len(h)], key // len(h), np.frexp(times)[1].astype(np.int32)


def fingerprints(column: pa.Array, known: _Known | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A fingerprint a row, and whether the row has one."""
    known = _Known() if known is None else known
    out, has = np.zeros(len(column), np.uint64), np.zeros(len(column), bool)
    for at, part in chunks(column):
        term, row, weight = terms(Words(part), known)
        if not len(term):
            continue
        begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        bits = np.unpackbits(term.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits * weight[:, None], begin, axis=0)
        vote = np.packbits(2 * ones > np.add.reduceat(weight, begin)[:, None], axis=1)
        out[at + row[begin]] = vote.view(">u8").ravel().astype(np.uint64)
        has[at + row[begin]] = True
    return out, has


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (the 64 bits as a signed long, null without words)."""

    def run(batches):
        known = _Known()
        for b in batches:
            value, has = fingerprints(b.column("text"), known)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(value.view(np.int64), mask=~has)], ["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fingerprint long")


def _signed(mask: int) -> int:
    return mask - 2**64 if mask >= 2**63 else mask


def pairs(values: DataFrame, radius: int = RADIUS, extra: int = EXTRA) -> DataFrame:
    """a, b, distance: all pairs a < b within ``radius`` among the distinct longs of ``values``, each once."""
    blocks = radius + extra
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    masks = [2 ** cuts[k + 1] - 2 ** cuts[k] for k in range(blocks)]
    (name,) = values.columns
    # a table is named by the set of its blocks
    tables = [(sum(1 << k for k in chosen), _signed(sum(masks[k] for k in chosen))) for chosen in combinations(range(blocks), extra)]
    keys = F.explode(F.array(*[F.struct(F.lit(t).cast("int").alias("t"), F.col(name).bitwiseAND(F.lit(m).cast("long")).alias("key")) for t, m in tables]))
    keyed = values.select(F.col(name).alias("fp"), keys.alias("k")).select("k.t", "k.key", "fp")
    a, b = keyed.select("t", "key", F.col("fp").alias("a")), keyed.select("t", "key", F.col("fp").alias("b"))
    differs = F.col("a").bitwiseXOR(F.col("b"))
    agreed, first = F.lit(0), F.lit(0)
    for k, m in enumerate(masks):
        agrees = differs.bitwiseAND(F.lit(_signed(m)).cast("long")) == 0
        first = first + F.when(agrees & (agreed < extra), 1 << k).otherwise(0)
        agreed = agreed + agrees.cast("int")
    # a join by bucket: no bucket is held by a row or a task, and adaptive execution splits hot ones
    met = (F.col("a") < F.col("b")) & (F.bit_count(differs) <= radius) & (first == F.col("t"))
    return a.join(b.hint("merge"), ["t", "key"]).where(met).select("a", "b", F.bit_count(differs).alias("distance"))


def near(docs: DataFrame, radius: int = RADIUS, extra: int = EXTRA) -> DataFrame:
    """doc_id, fingerprint, class_id, links, copies: one row a row of ``docs``.

    ``class_id``: the least doc_id of the documents that links and copies connect it with. ``links``: the other fingerprints within ``radius``
    of this one. ``copies``: the other rows of this fingerprint. The pairs themselves are ``pairs``'s.
    """
    rows = checkpoint(fingerprint(docs))
    own = checkpoint(rows.where("fingerprint is not null").groupBy("fingerprint").agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("least")))
    found = checkpoint(pairs(own.select("fingerprint"), radius, extra).select("a", "b"))
    links = found.select(F.col("a").alias("fingerprint")).union(found.select("b")).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("links"))
    group = components(found).select(F.col("node").alias("fingerprint"), "component")
    some = own.join(group, "fingerprint", "left").where("component is not null or rows > 1").join(links, "fingerprint", "left")
    some = checkpoint(some.select("fingerprint", F.coalesce("component", "fingerprint").alias("component"), "least", "rows", F.coalesce("links", F.lit(0)).alias("links")))
    lead = some.groupBy("component").agg(F.min("least").alias("lead"))
    known = some.join(lead, "component").select("fingerprint", "lead", "links", "rows", F.lit(True).alias("_in"))
    out = rows.join(known, "fingerprint", "left")
    return out.select("doc_id", "fingerprint", F.when(F.col("_in"), F.col("lead")).otherwise(F.col("doc_id")).alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), (F.coalesce("rows", F.lit(1)) - 1).alias("copies"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+')) AS word FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, CAST('0x' || left(md5(word), 16) AS UBIGINT) AS t, length(bin(count(*))) AS weight FROM w GROUP BY doc_id, word),
b AS (SELECT doc_id, bit, sum(CASE WHEN (t >> bit) & 1 = 1 THEN weight ELSE -weight END) AS vote FROM g, (SELECT CAST(range AS UBIGINT) AS bit FROM range(64)) GROUP BY ALL),
f AS (SELECT doc_id, CAST(sum(CASE WHEN vote > 0 THEN (CASE WHEN bit = 63 THEN -9223372036854775808::HUGEINT ELSE (1::UBIGINT << bit)::HUGEINT END) ELSE 0 END) AS BIGINT) AS fp FROM b GROUP BY doc_id),
c AS (SELECT fp, count(*) AS n, min(doc_id) AS least FROM f GROUP BY fp),
e AS (SELECT x.fp AS a, y.fp AS b FROM c x JOIN c y ON x.fp <> y.fp AND bit_count(xor(x.fp, y.fp)) <= 6),
reach AS (SELECT fp AS a, fp AS b FROM c UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b),
l AS (SELECT r.a AS fp, min(c.least) AS lead FROM reach r JOIN c ON c.fp = r.b GROUP BY r.a),
k AS (SELECT a AS fp, count(*) AS links FROM e GROUP BY a)
SELECT d.doc_id, f.fp AS fingerprint, coalesce(l.lead, d.doc_id) AS class_id, coalesce(k.links, 0) AS links, coalesce(c.n, 1) - 1 AS copies
FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id LEFT JOIN c ON c.fp = f.fp LEFT JOIN l ON l.fp = f.fp LEFT JOIN k ON k.fp = f.fp
"""

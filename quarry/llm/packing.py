"""Best-fit packing of documents into training sequences after Martello-Toth dominance reduction.

A document has ``length(text) div 4`` tokens, one at least; one longer than the ``capacity`` is cut into
full sequences and a rest. Since sizes are whole numbers up to ``capacity``, the corpus is, for packing, a
histogram of at most ``capacity`` sizes, counted exactly over all documents: the plan is made on it and doesn't
grow with the corpus. First the reduction fixes, from the largest size down, each set that dominates every other set
that could hold that item (nothing else fits; exactly full; at most one more fits and this is the largest; the
largest single partner is no less than the best two; the largest partner and the largest third item
that can go with any). Then best-fit-decreasing packs what remains. A pattern of sizes with the number of sequences
that use it is all that the executors get; pieces are numbered within their size and looked up there.

Defined results: null, empty and very short texts are one token; a null doc_id is packed as any row; repeated rows are
packed each; ties of size are numbered by (doc_id, piece), any order among equal rows; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._spark import checkpoint, numbered

CAPACITY = 2048


@dataclass
class Plan:
    """Groups of sequences: how many, and the sizes in each, in order; the first ``fixed`` groups are those the reduction fixed."""

    groups: list[tuple[int, tuple[int, ...]]]
    fixed: int

    @property
    def sequences(self) -> int:
        return sum(n for n, _ in self.groups)


class _Sizes:
    """A multiset of sizes: the sizes that are left, ascending, and how many of each."""

    def __init__(self, counts: dict[int, int]):
        self.count = {w: n for w, n in counts.items() if n > 0}
        self.list = sorted(self.count)

    def take(self, w: int, n: int) -> None:
        self.count[w] -= n
        if not self.count[w]:
            del self.count[w]
            self.list.pop(bisect_left(self.list, w))

    def has(self, w: int, without: tuple[int, ...] = ()) -> int:
        return self.count.get(w, 0) - without.count(w)

    def largest(self, room: int, without: tuple[int, ...]) -> int:
        """The largest size up to ``room``, 0 if there is none."""
        at = bisect_right(self.list, room) - 1
        while at >= 0 and self.has(self.list[at], without) <= 0:
            at -= 1
        return self.list[at] if at >= 0 else 0

    def least(self, k: int, without: tuple[int, ...]) -> list[int]:
        out: list[int] = []
        for w in self.list:
            n = self.has(w, without)
            out += [w] * min(max(0, n), k - len(out))
            if len(out) == k:
                break
        return out


def dominating(left: _Sizes, w: int, capacity: int) -> tuple[int, ...] | None:
    """A set that holds ``w`` and dominates every feasible set that does, None if no rule proves one."""
    room = capacity - w
    one = left.largest(room, (w,))
    if not one:
        return (w,)
    small = left.least(3, (w,))
    if one == room or len(small) < 2 or sum(small[:2]) > room:
        return (w, one)
    if len(small) == 3 and sum(small) <= room:
        return None
    best, pair = 0, 0  # the most that two more items fill, and the most that the lesser of two can be
    for a in left.list[: bisect_right(left.list, room)]:
        if left.has(a, (w,)) <= 0:
            continue
        b = left.largest(min(a, room - a), (w, a))
        if b:
            best, pair = max(best, a + b), max(pair, b)
    if one >= best:
        return (w, one)
    third = left.largest(room - one, (w, one))
    if third and third >= pair:
        return (w, one, third)
    return None


def reduce(left: _Sizes, capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Fixes dominating sets, the largest sizes first, until none is found; takes them from ``left``."""
    fixed = []
    found = True
    while found:
        found = False
        for w in sorted(left.list, reverse=True):
            while left.has(w):
                s = dominating(left, w, capacity)
                if s is None:
                    break
                # what dominates now does while its sizes last: what goes only leaves fewer alternatives
                n = min(left.count[x] // s.count(x) for x in set(s))
                for x in s:
                    left.take(x, n)
                fixed.append((n, s))
                found = True
    return fixed


def best_fit(left: _Sizes, capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit-decreasing on the multiset: each size goes where it leaves least room."""
    open_: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    rooms: list[int] = []

    def put(room: int, n: int, s: tuple[int, ...]) -> None:
        if n:
            if room not in open_:
                rooms.insert(bisect_left(rooms, room), room)
                open_[room] = []
            open_[room].append((n, s))

    for w in reversed(left.list):
        n = left.count[w]
        while n:
            at = bisect_left(rooms, w)
            if at < len(rooms):
                room = rooms[at]
                have, s = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
            else:
                room, have, s = capacity, n, ()
            each = room // w  # a sequence that took one still is the best fit for the next while it has room
            full = min(have, n // each)
            put(room - each * w, full, s + (w,) * each)
            n -= full * each
            have -= full
            rest = min(n, each - 1) if have else 0
            if rest:
                put(room - rest * w, 1, s + (w,) * rest)
                n -= rest
                have -= 1
            if s:
                put(room, have, s)
    return [g for room in rooms for g in open_[room]]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    left = _Sizes(counts)
    fixed = reduce(left, capacity)
    return Plan(fixed + best_fit(left, capacity), len(fixed))


def _segments(p: Plan) -> dict[str, np.ndarray]:
    """For each size and stretch of ranks in it: the rank it begins at, the first sequence, pieces a sequence, and the offset of the first."""
    size, begin, first, each, offset, fixed = [], [], [], [], [], []
    used: dict[int, int] = {}
    at = 0
    for k, (n, s) in enumerate(p.groups):
        place = 0
        for w in dict.fromkeys(s):
            m = s.count(w)
            size.append(w)
            begin.append(used.get(w, 0))
            first.append(at)
            each.append(m)
            offset.append(place)
            fixed.append(k < p.fixed)
            used[w] = used.get(w, 0) + n * m
            place += m * w
        at += n
    order = np.lexsort((begin, size)) if size else np.zeros(0, np.int64)
    return {k: np.array(v, bool if k == "fixed" else np.int64)[order] for k, v in {"size": size, "begin": begin, "first": first, "each": each, "offset": offset, "fixed": fixed}.items()}


def pieces(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece (0-based), tokens: each document cut at ``capacity``."""
    n = F.greatest(F.coalesce(F.length("text"), F.lit(0)) / 4, F.lit(1)).cast("long")
    cut = docs.select("doc_id", n.alias("n"))
    count = F.ceil(F.col("n") / capacity).cast("int")
    return cut.select("doc_id", "n", F.explode(F.sequence(F.lit(0), count - 1)).alias("piece")).select("doc_id", "piece", F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("piece") * capacity).cast("int").alias("tokens"))


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, tokens, sequence, start (the token in the sequence where the piece begins), fixed (by the reduction)."""
    some = checkpoint(pieces(docs, capacity))
    counts = {r["tokens"]: r["n"] for r in some.groupBy("tokens").agg(F.count(F.lit(1)).alias("n")).collect()}  # `capacity` rows at most
    seg = _segments(plan(counts, capacity))
    ranked = numbered(some, ["tokens"], [F.col("doc_id"), F.col("piece")], "rank")

    def run(batches):
        sizes = seg["size"]
        for b in batches:
            w, rank = b.column("tokens").to_numpy(zero_copy_only=False).astype(np.int64), b.column("rank").to_numpy(zero_copy_only=False)
            order = np.lexsort((rank, w))
            at = np.empty(len(w), np.int64)
            low, high = np.searchsorted(sizes, w, "left"), np.searchsorted(sizes, w, "right")
            edge = np.flatnonzero(np.append(True, w[order][1:] != w[order][:-1])) if len(w) else np.zeros(0, np.int64)
            for a, e in zip(edge, np.append(edge[1:], len(w)), strict=True):
                rows = order[a:e]
                i, j = low[rows[0]], high[rows[0]]
                at[rows] = i + np.searchsorted(seg["begin"][i:j], rank[rows], "right") - 1
            into = rank - seg["begin"][at]
            sequence, slot = seg["first"][at] + into // seg["each"][at], into % seg["each"][at]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("piece"), b.column("tokens"), pa.array(sequence), pa.array((seg["offset"][at] + slot * w).astype(np.int32)), pa.array(seg["fixed"][at])], ["doc_id", "piece", "tokens", "sequence", "start", "fixed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.select("doc_id", "piece", "tokens", "rank").mapInArrow(run, f"doc_id {kind}, piece int, tokens int, sequence long, start int, fixed boolean")

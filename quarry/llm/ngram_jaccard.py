"""N-gram Jaccard self-join by multiple-global-order prefix filtering.

A text is the set of its normalised word n-grams. Two sets of Jaccard similarity t or more share a
token among the first ``s - ceil(t s) + 1`` of either under *any* order of all tokens, so a candidate
must share a prefix token under each of ``orders`` orders, and only the intersection is verified, by counting common tokens.
All orders put rare tokens first, by exact frequencies over the whole corpus: order 0 by
(frequency, hash), order k by (binary logarithm of frequency, k-th hash). A token of one set
alone can't be shared; it only uses up prefix, which leaves most unrelated documents without any
prefix token to look up.

Tokens are 48-bit hashes and travel as binary columns, a row a batch of texts and token range, not as a row each; the number of
ranges grows with the corpus, so a task's memory doesn't. A token costs the bits in which it differs within its range and
a share of its batch's counts; which batch a set is in takes the place of its id, so ``docs`` must be a scan or some other plan that gives a task's rows
again in the same order. Documents of one set are one set from there on, named by 64 bits that its tokens give (of n sets two are
confused with a chance of n^2 / 2^65; two tokens of a pair of sets of s tokens with s^2 / 2^48); frequencies count a set once a batch.

A pair needs to be met only at its first common token, so it is passed over at a token whose places in the two
sets leave too few tokens after it, were it the first. At tokens in more than ``hot_df`` sets, which near copies
share by the hundred, a set also shows ``MARKS`` of the prefix tokens before this one: the last, and the least under some
hashes. Where two sets show the same mark they met before, and aren't paired again. No token is left out. The sets of a token in
more than ``block`` sets are dealt into blocks, and each two blocks meet in a task of their own.

Verification deals the sets of a neighbourhood into chunks of bounded size and ships a set once a chunk that it has candidates in,
not once a pair.

Defined results: null and empty texts, and texts without words, have no n-grams: each is a class of its own without links; a text of
fewer than n words is one gram; very long texts are one set of all their n-grams; rows of equal n-gram sets count as copies, whatever
their doc_id; rows of a null doc_id take part, and the class of none but such has a null class_id; a repeated doc_id is listed as
often as it occurs; of tied leads ``keep_one`` keeps any one row; an empty table gives no rows; extra columns are ignored by ``join`` and kept by
``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm._graph import components
from quarry.llm._spark import checkpoint, discard, release
from quarry.llm._text import Words, chunks, distinct, mix, shingles

N = 3
THRESHOLD = 0.6
ORDERS = 3
HOT_DF = 64
BLOCK = 4096
MARKS = 4
RANGE_BYTES = 4 << 20  # of text a token range
CHUNK_TOKENS = 500_000  # of the sets of a chunk
CHUNK_SETS = 1000  # of a chunk, so a block of two chunks has a million pairs at most, by and large
FLUSH_TOKENS = 2_000_000
_SALT = np.uint64(0xD6E8FEB86659FD93)


def _bytes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def _planes(a: np.ndarray) -> bytes:
    """All lowest bytes, then all next ones, and so on: small numbers leave planes of zeros, which the shuffle's compression removes."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes()


def _unplanes(packed: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(packed, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def _pack(token: np.ndarray) -> bytes:
    """48-bit tokens as 6 bytes each: all high words, then all low ones."""
    return _bytes((token >> np.uint64(16)).astype(np.uint32)) + _bytes(token.astype(np.uint16))


def _unpack(packed: bytes) -> np.ndarray:
    n = len(packed) // 6
    return (np.frombuffer(packed, np.uint32, n).astype(np.uint64) << np.uint64(16)) | np.frombuffer(packed, np.uint16, n, 4 * n)


def _bounds(parts: int) -> np.ndarray:
    """Where each of the equal token ranges begins, and the end of the last."""
    return np.array([(k << 48) // parts for k in range(parts + 1)], np.uint64)


def _width(parts: int) -> int:
    """Bits of a token's offset in its range."""
    return ((1 << 48) // parts + 1).bit_length()


def _squeeze(a: np.ndarray, bits: int) -> bytes:
    """Numbers of so many bits: their whole bytes number by number, then the bits above these."""
    whole, rest = divmod(bits, 8)
    cells = np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8)
    return _bytes(cells[:, :whole]) + (_bytes(np.packbits(np.unpackbits(cells[:, whole, None], axis=1)[:, 8 - rest :])) if rest else b"")


def _unsqueeze(packed: bytes, n: int, bits: int) -> np.ndarray:
    whole, rest = divmod(bits, 8)
    cells = np.zeros((n, 8), np.uint8)
    cells[:, :whole] = np.frombuffer(packed, np.uint8, n * whole).reshape(n, whole)
    if rest:
        above = np.zeros((n, 8), np.uint8)
        above[:, 8 - rest :] = np.unpackbits(np.frombuffer(packed, np.uint8, offset=n * whole), count=n * rest).reshape(n, rest)
        cells[:, whole] = np.packbits(above, axis=1)[:, 0]
    return cells.view(np.uint64).ravel()


def _set_ids(token: np.ndarray, owner: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The id and size of each row's set: 64 bits that any order of its tokens gives."""
    size = np.bincount(owner, minlength=rows)
    total = np.zeros(rows, np.uint64)
    if len(token):
        begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        total[owner[begin]] = np.add.reduceat(mix(token ^ _SALT), begin)
    return mix(total + size.astype(np.uint64)).view(np.int64), size.astype(np.uint32)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")


def _set_of(column: pa.Array, n: int) -> pa.Array:
    """The set id of each text, null without words."""
    out, has = np.zeros(len(column), np.int64), np.zeros(len(column), bool)
    for at, piece in chunks(column):
        token, owner, _ = distinct(*shingles(Words(piece), n))
        set_id, size = _set_ids(token, owner, len(piece))
        out[at : at + len(piece)], has[at : at + len(piece)] = set_id, size > 0
    return pa.array(out, mask=~has)


def _members(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, set_id: a row a row of ``docs``."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), _set_of(b.column("text"), n)], ["doc_id", "set_id"])
        release()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, set_id long")


def _post(docs: DataFrame, n: int, parts: int) -> DataFrame:
    """A row a batch and token range: how many of its tokens each of the batch's sets has (or, if these are few, which set each is of), and the tokens by set;
    and which sets' ids fall in the range, so that those of several batches are seen there.

    One row more a batch has the ids and sizes of its sets.
    """
    bounds, width = _bounds(parts), _width(parts)
    names = ["part", "batch", "counts", "places", "tokens", "own", "ranks", "ids", "sizes"]

    def flush(batch, held):
        token, place, ids, sizes = (np.concatenate([h.pop(0) for h in held]) for _ in range(4))
        _, first = np.unique(ids, return_index=True)  # of equal sets one is posted
        lead = np.zeros(len(ids), bool)
        lead[first] = True
        rank = (np.cumsum(lead) - 1).astype(np.int32)
        if not lead.all():
            keep = lead[place]
            token, place = token[keep], rank[place[keep]]
            ids, sizes = ids[lead], sizes[lead]
        place = place.astype(np.uint16)  # a batch has 65536 sets at most
        token >>= np.uint64(16)
        part = np.empty(len(token), np.uint16 if parts < 65536 else np.uint32)
        for at in range(0, len(token), 65536):
            part[at : at + 65536] = np.searchsorted(bounds, token[at : at + 65536], side="right") - 1
        order = np.argsort(part, kind="stable")  # by set within a range, as before
        token, place = token[order], place[order]
        del order
        ends = np.append(0, np.cumsum(np.bincount(part, minlength=parts)))
        del part
        home = (mix(ids.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        rank = np.argsort(home, kind="stable")
        homes = np.append(0, np.cumsum(np.bincount(home, minlength=parts)))
        rows = [(batch % parts, batch, None, None, None, None, None, _bytes(ids), _bytes(sizes))]
        for p in np.flatnonzero(np.diff(ends) + np.diff(homes)).tolist():
            here = rank[homes[p] : homes[p + 1]]
            a, b = ends[p], ends[p + 1]
            few = b - a < len(ids) // 2
            counts = None if few else np.bincount(place[a:b], minlength=len(ids))
            own = (_bytes(ids[here]), _bytes(here.astype(np.uint16))) if len(here) else (None, None)
            rows.append((p, batch, None if few else _bytes(counts.astype(np.uint8)) + _bytes((counts >> 8).astype(np.uint32)), _bytes(place[a:b]) if few else None, _squeeze(token[a:b] - bounds[p], width), *own, None, None))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), *[pa.binary()] * 7), strict=True)], names)

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        held, tokens, sets = [], 0, 0
        for b in batches:
            for _, piece in chunks(b.column("text")):
                for to in range(0, len(piece), 32768):
                    some = piece.slice(to, 32768)
                    token, owner, _ = distinct(*shingles(Words(some), n))
                    if not len(token):
                        continue
                    own, size = _set_ids(token, owner, len(some))
                    if sets + len(some) > 65536 or tokens > FLUSH_TOKENS:
                        yield flush(number, held)
                        held, tokens, sets = [], 0, 0
                        number += 1
                    held.append([token, (owner + sets).astype(np.int32), own, size])
                    tokens, sets = tokens + len(token), sets + len(own)
        if held:
            yield flush(number, held)
        del held
        release()

    return _texts(docs).mapInArrow(run, "part int, batch long, counts binary, places binary, tokens binary, own binary, ranks binary, ids binary, sizes binary")


def _shared(posts: DataFrame, parts: int) -> DataFrame:
    """Postings of tokens that occur again, a row a batch and token range, by place, of which the steps are given; rows of ids pass.

    ``drops``: the places in a batch of sets that a batch of lower number has too.
    """
    width = _width(parts)

    def run(key, rows):
        out, batch, token, ref, ids_of, at_of = [], [], [], [], [], []
        for name, counts, places, packed, own, ranks, ids, sizes in zip(*(rows.column(c).to_pylist() for c in ("batch", "counts", "places", "tokens", "own", "ranks", "ids", "sizes")), strict=True):
            if ids is not None:
                out.append((name, None, None, None, None, ids, sizes, None))
                continue
            if own is not None:
                ids_of.append(np.frombuffer(own, np.int64))
                at_of.append((len(batch) << 16) + np.frombuffer(ranks, np.uint16).astype(np.int64))
            if counts is not None:
                k = len(counts) // 5
                times = np.frombuffer(counts, np.uint8, k).astype(np.int64) + (np.frombuffer(counts, np.uint32, k, k).astype(np.int64) << 8)
                place = np.repeat(np.arange(k), times)
            else:
                place = np.frombuffer(places, np.uint16).astype(np.int64)
            token.append(_unsqueeze(packed, len(place), width))
            ref.append((len(batch) << 16) + place)
            batch.append(name)
        del rows
        if batch:
            token, ref = np.concatenate(token), np.concatenate(ref)
            order = np.argsort(token, kind="stable")
            token, ref = token[order], ref[order]
            begin = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            times = np.diff(np.append(begin, len(token))).astype(np.uint32)
            df = np.repeat(times, times)
            keep = df > 1
            token, ref, df = token[keep], ref[keep], df[keep]
            order = np.argsort(ref, kind="stable")
            token, ref, df = token[order], ref[order], df[order]
            ends = np.searchsorted(ref, np.arange(len(batch) + 1) << 16)
            for k in np.flatnonzero(np.diff(ends)).tolist():
                a, b = ends[k], ends[k + 1]
                steps = np.diff(ref[a:b] & 0xFFFF, prepend=0).astype(np.uint16)
                out.append((batch[k], key[0].as_py(), _planes(steps), _squeeze(token[a:b], width), _planes(df[a:b]), None, None, None))
            del token, ref, df, order, keep, times, begin
        if ids_of:
            own, at = np.concatenate(ids_of), np.concatenate(at_of)
            by = np.lexsort((np.array(batch)[at >> 16], own))
            again = np.sort(at[by[1:]][own[by[1:]] == own[by[:-1]]])
            ends = np.searchsorted(again, np.arange(len(batch) + 1) << 16)
            out += [(batch[k], None, None, None, None, None, None, _bytes(again[ends[k] : ends[k + 1]].astype(np.uint16))) for k in np.flatnonzero(np.diff(ends)).tolist()]
        columns = list(zip(*out, strict=True)) or [[]] * 8
        release()
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), *[pa.binary()] * 6), strict=True)], names=["batch", "part", "places", "tokens", "df", "ids", "sizes", "drops"])

    return posts.groupBy("part").applyInArrow(run, "batch long, part int, places binary, tokens binary, df binary, ids binary, sizes binary, drops binary")


def _sets(shared: DataFrame, threshold: float, parts: int) -> DataFrame:
    """Sets that can have a partner, each once: size, tokens that occur again (sorted, 6 bytes each) and their frequencies."""
    bounds, width = _bounds(parts), _width(parts)

    def run(_, rows):
        place, token, df, ids, sizes = [], [], [], np.zeros(0, np.int64), np.zeros(0, np.uint32)
        dropped = np.zeros(65536, bool)
        for part, places, packed, freq, own, size, drops in zip(*(rows.column(c).to_pylist() for c in ("part", "places", "tokens", "df", "ids", "sizes", "drops")), strict=True):
            if own is not None:
                ids, sizes = np.frombuffer(own, np.int64), np.frombuffer(size, np.uint32)
            elif drops is not None:
                dropped[np.frombuffer(drops, np.uint16)] = True
            else:
                place.append(np.cumsum(_unplanes(places, np.uint16), dtype=np.uint16))
                token.append(_unsqueeze(packed, len(places) // 2, width) + bounds[part])
                df.append(_unplanes(freq, np.uint32))
        del rows
        out = []
        if place:
            place, token, df = (np.concatenate(x) for x in (place, token, df))
            order = np.lexsort((token, place))
            place = place[order]
            token = token[order]
            df = df[order]
            del order
            begin = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
            for a, b in zip(begin.tolist(), np.append(begin[1:], len(place)).tolist(), strict=True):
                s = int(sizes[place[a]])
                if not dropped[place[a]] and s - (b - a) < s - int(np.ceil(threshold * s - 1e-9)) + 1:
                    out.append((int(ids[place[a]]), s, _pack(token[a:b]), _planes(df[a:b])))
        del place, token, df
        columns = list(zip(*out, strict=True)) or [[]] * 4
        release()
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["set_id", "size", "tokens", "df"])

    return shared.groupBy("batch").applyInArrow(run, "set_id long, size int, tokens binary, df binary")


def prefix(size: int, token: np.ndarray, df: np.ndarray, threshold: float, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens, of those in two documents or more, in a set's prefix under one of the orders; their frequencies; their places among all of its tokens."""
    alone = size - len(token)
    room = size - int(np.ceil(threshold * size - 1e-9)) + 1 - alone
    h = mix(token ^ np.uint64(int(_SALT) * order % 2**64)) if order else token
    rank = np.lexsort((h, np.floor(np.log2(df)) if order else df))[: max(0, room)]
    return token[rank], df[rank], alone + np.arange(len(rank))


def marks(token: np.ndarray) -> np.ndarray:
    """(tokens, MARKS): of the tokens before each one the last, and the least under some hashes; 0 where there is none."""
    out = np.zeros((len(token), MARKS), np.uint64)
    if len(token) > 1:
        out[1:, 0] = mix(token[:-1])
        for k in range(1, MARKS):
            out[1:, k] = np.minimum.accumulate(mix(token[:-1] + np.uint64(k << 48)))
    return out


def meetings(token: np.ndarray, df: np.ndarray, ids: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, key and side of each meeting: a token of up to ``block`` sets is one (side 2, all pair with all); the sets of a more frequent one
    are dealt into blocks, and a set goes to the meeting of its own block (side 2) and to those with each other block (sides 0 and 1, which pair across)."""
    blocks = -(-df.astype(np.int64) // block)
    row = np.repeat(np.arange(len(token)), blocks)
    other = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    own = (mix(ids.view(np.uint64) + token) % blocks.astype(np.uint64)).astype(np.int64)[row]
    low, high = np.minimum(own, other).astype(np.uint64), np.maximum(own, other).astype(np.uint64)
    key = np.where(blocks[row] > 1, mix(token[row] ^ mix((low << np.uint64(32)) + high + np.uint64(1))), token[row])
    return row, key, np.where(own == other, 2, own > other).astype(np.uint8)


def _offers(sets: DataFrame, threshold: float, orders: int, parts: int, hot_df: int, block: int) -> DataFrame:
    """A row a batch, order, token range, and hot tokens or others; only hot ones have marks. Sets go by their numbers, of which the steps are given."""

    def run(batches):
        for whole in batches:
            for at in range(0, len(whole), 1000):
                b = whole.slice(at, 1000)
                size, rep = b.column("size").to_numpy(), b.column("number").to_numpy()
                texts = [(int(s), _unpack(t), _unplanes(f, np.uint32)) for s, t, f in zip(size, b.column("tokens").to_pylist(), b.column("df").to_pylist(), strict=True)]
                rows = []
                for order in range(orders):
                    got = []
                    for s, t, f in texts:
                        token, df, place = prefix(s, t, f, threshold, order)
                        hot = df > hot_df
                        got.append((token, df, place, hot, marks(token)[hot] if hot.any() else np.zeros((0, MARKS), np.uint64)))
                    times = [len(g[0]) for g in got]
                    token, df, place, hot, mark = (np.concatenate(x) for x in zip(*got, strict=True))
                    ids, sizes = np.repeat(rep, times), np.repeat(size, times)
                    for some in (False, True):
                        at_ = np.flatnonzero(hot == some)
                        row, key, side = meetings(token[at_], df[at_], ids[at_], block)
                        part = (mix(key) % np.uint64(parts)).astype(np.int64)
                        by = np.argsort(part, kind="stable")
                        ends = np.searchsorted(part[by], np.arange(parts + 1))
                        for p in np.flatnonzero(np.diff(ends)).tolist():
                            k = by[ends[p] : ends[p + 1]]
                            o = at_[row[k]]
                            rows.append((order, p, some, _planes(key[k]), _bytes(side[k]), _planes(np.diff(ids[o], prepend=0)), _planes(sizes[o].astype(np.uint32)), _planes(place[o].astype(np.uint32)), _bytes(mark[row[k]]) if some else b""))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.bool_(), *[pa.binary()] * 6), strict=True)], ["ordering", "part", "hot", "token", "side", "ids", "sizes", "places", "marks"])
        release()

    return sets.select("number", "size", "tokens", "df").mapInArrow(run, "ordering int, part int, hot boolean, token binary, side binary, ids binary, sizes binary, places binary, marks binary")


def runs_to_pairs(token: np.ndarray, side: np.ndarray, ids: np.ndarray, sizes: np.ndarray, places: np.ndarray, mark: np.ndarray, threshold: float, most: int = 1_000_000):
    """Yields arrays (a, b), a < b, of rows of one token whose sides meet, whose sizes and places allow ``threshold`` and that show no mark in common; within one yield, distinct.

    ``mark``: (rows, MARKS), or (0, MARKS) for tokens without.
    """
    order = np.lexsort((sizes, token))
    token, side, ids, sizes, places = token[order], side[order], ids[order], sizes[order].astype(np.int64), places[order]
    mark = np.ascontiguousarray(mark[order].T) if len(mark) else mark.T
    # sizes rise within a token, so a row's partners are a stretch after it that ends where sizes are too large
    run = np.cumsum(np.append(0, token[1:] != token[:-1]))[: len(token)] << 32
    reach = np.searchsorted(run + sizes, run + np.minimum(np.floor(sizes / threshold + 1e-9), (1 << 32) - 1).astype(np.int64), side="right")
    count = reach - np.arange(len(token)) - 1
    total = np.cumsum(count)
    left_over = (sizes - places).astype(np.float64) * (1 + threshold)
    need = threshold * sizes
    at = 0
    while at < len(count):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
        n = count[at:to]
        left = np.repeat(np.arange(at, to), n)
        right = left + 1 + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        at = to
        new = (side[left] != side[right]) | (side[left] == 2)
        new &= np.minimum(left_over[left], left_over[right]) >= need[left] + need[right] - 1e-6
        left, right = left[new], right[new]
        for row in mark if mark.size else ():
            met = row[left]
            new = (met != row[right]) | (met == 0)
            left, right = left[new], right[new]
        a, b = np.minimum(ids[left], ids[right]), np.maximum(ids[left], ids[right])
        if len(a):
            by = np.lexsort((b, a))
            a, b = a[by], b[by]
            new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) & (a != b)
            yield a[new], b[new]


def _candidates(offers: DataFrame, threshold: float, orders: int) -> DataFrame:
    """Pairs that share a prefix token under all orders."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = key[0].as_py()
        kinds = {"token": np.uint64, "side": np.uint8, "ids": np.int64, "sizes": np.uint32, "places": np.uint32, "marks": np.uint64}
        held: dict[str, list[np.ndarray]] = {c: [] for c in kinds}
        for b in batches:
            for c, kind in kinds.items():
                read = np.frombuffer if c in ("side", "marks") else _unplanes
                held[c] += [np.cumsum(read(x, kind)) if c == "ids" else read(x, kind) for x in b.column(c).to_pylist()]
        token, side, ids, sizes, places, mark = (np.concatenate(held.pop(c)) for c in kinds)
        for a, b in runs_to_pairs(token, side, ids, sizes, places, mark.reshape(-1, MARKS), threshold):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), 1 << order, np.int32))], ["a", "b", "seen"])
        del token, side, ids, sizes, places, mark
        release()

    pairs = offers.groupBy("ordering", "part", "hot").applyInArrow(run, "a long, b long, seen int")
    return pairs.groupBy("a", "b").agg(F.bit_or("seen").alias("seen")).where(F.col("seen") == (1 << orders) - 1).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float, parts: int) -> DataFrame:
    """a, b (set ids), shared, jaccard of the similar ones among ``pairs`` (of sets' numbers).

    Sets of one neighbourhood (named by the least id among a set and its candidates) are dealt into chunks of about ``CHUNK_TOKENS`` or ``CHUNK_SETS``; the
    pairs of two chunks are a block, and blocks go to tasks by a hash.
    """

    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        ids = sets.column("x").to_numpy()
        by = np.argsort(ids)
        sizes = sets.column("size").to_numpy()
        tokens = sets.column("tokens").combine_chunks()
        left_of, right_of = (by[np.searchsorted(ids[by], pairs.column(c).to_numpy())] for c in "ab")
        keep, shared, whole = [], [], []
        last, left = -1, None
        for k in np.argsort(left_of, kind="stable"):  # a set is unpacked when its pairs come, never all at once
            i, j = left_of[k], right_of[k]
            if i != last:
                last, left = i, _unpack(tokens[i].as_buffer())
            sa, sb, other = int(sizes[i]), int(sizes[j]), tokens[j].as_buffer()
            if min(len(left), len(other) // 6) * (1 + threshold) < threshold * (sa + sb) - 1e-9:
                continue
            both = np.concatenate([left, _unpack(other)])
            both.sort(kind="stable")
            n = int(np.count_nonzero(both[1:] == both[:-1]))
            if n >= threshold * (sa + sb - n) - 1e-9:
                keep.append(k)
                shared.append(n)
                whole.append(sa + sb - n)
        left, right = (sets.column("set_id").to_numpy()[x[np.array(keep, np.int64)]] for x in (left_of, right_of))
        shared, whole = np.array(shared, np.int64), np.array(whole, np.int64)
        release()
        return pa.Table.from_arrays([pa.array(np.minimum(left, right)), pa.array(np.maximum(left, right)), pa.array(shared), pa.array(shared / np.maximum(1, whole))], names=["a", "b", "shared", "jaccard"])

    ends = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).union(pairs.select("b", "a"))
    near = ends.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("near"))
    sized = near.join(sets.select(F.col("number").alias("x"), (F.length("tokens") / 6).alias("n")), "x")
    chunks_of = sized.groupBy("near").agg(F.ceil(F.greatest(F.sum("n") / CHUNK_TOKENS, F.count(F.lit(1)) / CHUNK_SETS)).alias("chunks"))
    chunk = sized.join(chunks_of, "near").select("x", F.xxhash64("near", F.pmod(F.xxhash64("x"), "chunks")).alias("chunk"))
    count = pairs.count()
    tasks = max(parts, -(-count // 200_000))
    left, right = (chunk.select(F.col("x").alias(s), F.col("chunk").alias(f"c{s}")) for s in "ab")
    placed = pairs.join(left, "a").join(right, "b").select("a", "b", F.pmod(F.xxhash64(F.least("ca", "cb"), F.greatest("ca", "cb")), F.lit(tasks)).cast("int").alias("block"))
    placed = checkpoint(placed)
    wanted = placed.select(F.col("a").alias("x"), F.col("block").alias("task")).union(placed.select("b", "block")).distinct()
    shipped = wanted.join(sets.select(F.col("number").alias("x"), "set_id", "size", "tokens"), "x")
    out = checkpoint(placed.groupBy("block").cogroup(shipped.groupBy("task")).applyInArrow(run, "a long, b long, shared long, jaccard double"))
    discard(placed)
    return out


def similar(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, orders: int = ORDERS, hot_df: int = HOT_DF, block: int = BLOCK) -> DataFrame:
    """a, b, shared, jaccard: all pairs of distinct sets of similarity ``threshold`` or more, by set id."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    shared = checkpoint(_shared(_post(docs, n, parts), parts))  # the postings' shuffle files go before the next ones come
    sets = checkpoint(_sets(shared, threshold, parts).withColumn("number", F.monotonically_increasing_id()))  # small numbers, which compress
    discard(shared)
    pairs = checkpoint(_candidates(_offers(sets, threshold, orders, parts, hot_df, block), threshold, orders))
    out = _verified(pairs, sets, threshold, parts)
    discard(pairs, sets)
    return out


def _classes(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """set_id, component, lead (its least doc_id), copies (rows of this set), links: of the sets that several rows have or that are similar to another."""
    links = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).groupBy("set_id").agg(F.count(F.lit(1)).alias("links"))
    group = components(pairs.select("a", "b")).select(F.col("node").alias("set_id"), "component")
    own = members.where("set_id is not null").groupBy("set_id").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"))
    own = own.join(group, "set_id", "left").where("component is not null or copies > 1").join(links, "set_id", "left")
    own = checkpoint(own.select("set_id", F.coalesce("component", "set_id").alias("component"), "least", "copies", F.coalesce("links", F.lit(0)).alias("links")))
    lead = own.groupBy("component").agg(F.min_by(F.struct("least", "set_id"), F.struct(F.col("least").isNull(), "least", "set_id")).alias("_l")).select("component", F.col("_l.least").alias("lead"), F.col("_l.set_id").alias("lead_set"))
    return own.join(lead, "component")


def join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, orders: int = ORDERS, hot_df: int = HOT_DF, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id, links, copies: one row a row of ``docs``.

    ``class_id``: the least doc_id of the documents that links and copies connect it with. ``links``: the other n-gram sets that are similar to
    this document's. ``copies``: the other rows of the same set. The pairs themselves are ``similar``'s.
    """
    pairs = similar(docs, n, threshold, orders, hot_df, block)
    members = checkpoint(_members(docs, n))
    classes = _classes(pairs, members).select("set_id", "lead", "links", "copies", F.lit(True).alias("_in"))
    found = members.join(classes, "set_id", "left")
    return found.select("doc_id", F.when(F.col("_in"), F.col("lead")).otherwise(F.col("doc_id")).alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), (F.coalesce("copies", F.lit(1)) - 1).alias("copies"))


def keep_one(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, orders: int = ORDERS, hot_df: int = HOT_DF, block: int = BLOCK) -> DataFrame:
    """``docs`` with one row of each class: that of the least doc_id, null ids last. Rows that are like no other stay."""
    pairs = similar(docs, n, threshold, orders, hot_df, block)
    members = checkpoint(_members(docs, n))
    classes = _classes(pairs, members).select("set_id", "lead", "lead_set")
    # a decision a (doc_id, set), so no text travels to the one task of a set that very many rows have
    rows = members.join(classes, "set_id").groupBy("doc_id", "set_id").agg(F.count(F.lit(1)).alias("n"), F.first("lead").alias("lead"), F.first("lead_set").alias("lead_set"))
    leads = F.col("doc_id").eqNullSafe(F.col("lead")) & (F.col("set_id") == F.col("lead_set"))
    verdict = checkpoint(rows.select(F.col("doc_id").alias("_d"), F.col("set_id").alias("_s"), F.when(~leads, 0).when(F.col("n") > 1, 2).otherwise(1).alias("_v")).where("_v <> 1"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    at, own = docs.columns.index("text"), f"c{docs.columns.index('doc_id')}"

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, _set_of(b.column(at), n)], [*names, "_set"])

    plain = docs.toDF(*names)
    known = plain.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in plain.schema.fields] + [T.StructField("_set", T.LongType())]))
    key = lambda c: [F.coalesce(c, F.lit(0).cast(docs.schema["doc_id"].dataType)).alias("_id"), F.isnull(c).alias("_none")]
    on = ["_id", "_none", "_set"]
    # one plan at every size: the decisions grow with the corpus and are never broadcast; texts are shuffled once, for the repeated leads too
    told = known.select("*", *key(F.col(own))).join(verdict.select(*key(F.col("_d")), F.col("_s").alias("_set"), "_v").hint("merge"), on, "left").where("_v is null or _v = 2")
    return told.withColumn("_k", F.row_number().over(Window.partitionBy(*on).orderBy(*on))).where("_v is null or _k = 1").select(*names).toDF(*docs.columns)

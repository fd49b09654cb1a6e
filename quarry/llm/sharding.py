"""Sharding by balanced label propagation: linked documents move towards their neighbours' shards under quotas.

Links: any two documents that share a line of ``MIN_WORDS`` words or more are neighbours; a pair's weight is the number
of such lines. Pairs are never listed: a line counts its documents in each shard, and a document adds up the counts of its lines
less itself, which is its exact neighbour weight in every shard, at a cost by (document, line) rows. Documents with neighbours
begin evenly spread; those without are dealt last, to even the sizes, so they keep no room from the others. In each round, half of them by a hash find the shard of most of that weight; the wishes from shard i
to j (every other round only to shards that aren't full) are matched with those from j to i, and what is over shares the room that j has up to its capacity, (1 +
``slack``) times the mean. Where wishes exceed the quota the greatest gains go first. Sizes thus never pass the
capacity, and no task or driver holds more than counts by (from, to, gain class). It ends after ``rounds`` or when hardly any document moves. Each
round's shards are written to the shared folder, which also keeps the plan from growing.

Defined results: null and empty texts have no links; of very long texts all lines count; rows of a null doc_id go to shard 0 and don't count; repeated
rows of one doc_id are one document, listed as often as it occurs; equal gains go by a hash; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm._spark import checkpoint, discard, numbered

SHARDS = 16
SLACK = 0.05
ROUNDS = 12
SETTLED = 0.001  # of the documents: four rounds in turn that move fewer end it
MIN_WORDS = 5


def line_rows(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, line: the distinct lines of each document, as hashes."""
    lines = F.array_distinct(F.transform(F.split("text", r"\R"), lambda x: F.lower(F.trim(x))))
    lines = F.filter(lines, lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "))) >= min_words - 1)
    return docs.where("doc_id is not null and text is not null").select("doc_id", F.explode(F.transform(lines, lambda x: F.xxhash64(x))).alias("line"))


def shared_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, line: of each document the lines that other documents have too."""
    rows = checkpoint(line_rows(docs, min_words).distinct())
    shared = rows.groupBy("line").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("line")
    return rows.join(shared, "line").select("doc_id", "line")


def links(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """a, b, weight: of the pairs that share lines those with a line's least document, a; a sketch of the neighbours for ``cut``."""
    rows = checkpoint(line_rows(docs, min_words))
    shared = rows.groupBy("line").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("_last")).where("a < _last").drop("_last")
    return rows.join(shared, "line").where("a < doc_id").groupBy("a", F.col("doc_id").alias("b")).agg(F.count(F.lit(1)).alias("weight"))


def _half(turn: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(turn)), F.lit(2)) == 0


def quotas(wishes: dict[tuple[int, int], int], sizes: list[int], capacity: int) -> dict[tuple[int, int], int]:
    """Moves allowed from i to j: those matched by moves back, and a share of the room in j."""
    over: dict[int, int] = {}
    for (i, j), n in wishes.items():
        over[j] = over.get(j, 0) + n - min(n, wishes.get((j, i), 0))
    out = {}
    for (i, j), n in wishes.items():
        matched = min(n, wishes.get((j, i), 0))
        room = max(0, capacity - sizes[j])
        out[i, j] = matched + (min(n - matched, room * (n - matched) // over[j]) if over[j] else 0)
    for j in over:  # what rounding left of the room
        into = [k for k in out if k[1] == j]
        left = max(0, capacity - sizes[j]) - sum(out[k] - min(wishes[k], wishes.get((j, k[0]), 0)) for k in into)
        for k in sorted(into):
            more = min(left, wishes[k] - out[k])
            out[k], left = out[k] + more, left - more
    return out


def fill(sizes: list[int], rest: int) -> list[int]:
    """How many of ``rest`` documents each shard takes for the sizes to be as even as can be."""
    low, high = 0, max(sizes) + rest + 1
    while high - low > 1:
        level = (low + high) // 2
        low, high = (level, high) if sum(max(0, level - n) for n in sizes) <= rest else (low, level)
    out = [max(0, low - n) for n in sizes]
    left = rest - sum(out)
    for k, n in enumerate(sizes):
        if left and n <= low:
            out[k], left = out[k] + 1, left - 1
    return out


def votes(rows: DataFrame, at: DataFrame, shards: int, turn: int | None = None) -> DataFrame:
    """doc_id, shard (its own), votes: a document's weight of neighbours in each shard. ``rows``: doc_id, line; ``at``: doc_id, shard of all of them. With ``turn``, of that turn's half alone."""
    placed = rows.join(at, "doc_id")
    counts = placed.groupBy("line").agg(F.array(*[F.sum((F.col("shard") == k).cast("long")) for k in range(shards)]).alias("_counts"))
    asked = placed if turn is None else placed.where(_half(turn))
    sums = [(F.sum(F.col("_counts")[k]) - F.sum((F.col("shard") == k).cast("long"))).alias(f"_v{k}") for k in range(shards)]
    return asked.join(counts, "line").groupBy("doc_id", "shard").agg(*sums).select("doc_id", "shard", F.array(*[f"_v{k}" for k in range(shards)]).alias("votes"))


def propagate(nodes: DataFrame, rows: DataFrame, shards: int = SHARDS, slack: float = SLACK, rounds: int = ROUNDS) -> DataFrame:
    """``nodes``: doc_id, distinct; ``rows``: doc_id, line, distinct. Result: doc_id, shard."""
    spark = nodes.sparkSession
    known = rows.select("doc_id").distinct()
    linked = numbered(nodes.join(known, "doc_id", "left_semi"), [], [F.col("doc_id")], "rank")
    linked = checkpoint(linked.select("doc_id", (F.col("rank") % shards).cast("int").alias("shard")))
    sizes = [0] * shards
    for r in linked.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r["shard"]] = r["n"]
    total = nodes.count()
    capacity = -int(-(1 + slack) * total // shards)
    still = 0
    for turn in range(rounds):
        # every other round full shards are no aim, so that those who wish there in vain gather elsewhere
        allowed = [k for k in range(shards) if turn % 2 == 0 or sizes[k] < capacity]
        each = votes(rows, linked, shards, turn).select("doc_id", "shard", F.element_at("votes", F.col("shard") + 1).alias("own"), F.array_max(F.transform("votes", lambda w, k: F.struct(k.isin(allowed).alias("may"), w.alias("w"), (-F.pmod(F.xxhash64("doc_id", k), F.lit(1 << 30))).alias("draw"), k.alias("to")))).alias("best"))
        best = each.where("best.may").select("doc_id", "shard", "own", "best.w", "best.to")
        level = F.floor(F.log2(F.col("w") - F.col("own"))).cast("int")
        wish = checkpoint(best.where("w > own").select("doc_id", F.col("shard").alias("from"), "to", level.alias("level")))
        counts = wish.groupBy("from", "to", "level").agg(F.count(F.lit(1)).alias("n")).collect()  # shards^2 times gain classes
        asked: dict[tuple[int, int], int] = {}
        for r in counts:
            asked[r["from"], r["to"]] = asked.get((r["from"], r["to"]), 0) + r["n"]
        left = quotas(asked, sizes, capacity)
        grants = []
        for r in sorted(counts, key=lambda r: -r["level"]):
            n = min(r["n"], left[r["from"], r["to"]])
            left[r["from"], r["to"]] -= n
            sizes[r["from"]] -= n
            sizes[r["to"]] += n
            grants.append((r["from"], r["to"], r["level"], n))
        some = sum(g[3] for g in grants)
        still = still + 1 if some <= SETTLED * total else 0
        if some:
            table = spark.createDataFrame(grants, "from int, to int, level int, quota long")
            moved = numbered(wish, ["from", "to", "level"], [F.xxhash64("doc_id", F.lit(turn)), F.col("doc_id")], "rank").join(F.broadcast(table), ["from", "to", "level"]).where("rank < quota").select("doc_id", F.col("to").alias("moved"))
            before = linked
            linked = checkpoint(before.join(moved, "doc_id", "left").select("doc_id", F.coalesce("moved", "shard").alias("shard")))
            discard(before)
        discard(wish)
        if still == 4:  # both halves, with and without full shards
            break
    room = fill(sizes, total - sum(sizes))
    ends = [sum(room[: k + 1]) for k in range(shards)]
    alone = numbered(nodes.join(known, "doc_id", "left_anti"), [], [F.col("doc_id")], "rank")
    alone = alone.select("doc_id", sum(((F.col("rank") >= e).cast("int") for e in ends), F.lit(0)).alias("shard"))
    return linked.select("doc_id", "shard").unionByName(alone)


def shard(docs: DataFrame, shards: int = SHARDS, slack: float = SLACK, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, shard: one row a row of ``docs``."""
    rows = checkpoint(docs.select("doc_id"))
    nodes = rows.where("doc_id is not null").distinct()
    found = propagate(nodes, checkpoint(shared_lines(docs)), shards, slack, rounds)
    return rows.join(found, "doc_id", "left").select("doc_id", F.coalesce("shard", F.lit(0)).alias("shard"))


def cut(edges: DataFrame, shards: DataFrame) -> DataFrame:
    """links, cut: the weight of all links, and of those whose ends lie in two shards."""
    a, b = shards.toDF("a", "sa"), shards.toDF("b", "sb")
    return edges.join(a, "a").join(b, "b").agg(F.sum("weight").alias("links"), F.sum(F.when(F.col("sa") != F.col("sb"), F.col("weight")).otherwise(0)).alias("cut"))


def line_cut(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """links, cut: the weight of all pairs of neighbours, and of those that lie in two shards, from ``rows`` of doc_id, line."""
    each = rows.join(shards, "doc_id").groupBy("line", "shard").agg(F.count(F.lit(1)).alias("n"))
    lines = each.groupBy("line").agg(F.sum("n").alias("n"), F.sum(F.expr("n * (n - 1) / 2")).alias("kept"))
    return lines.agg(F.sum(F.expr("n * (n - 1) / 2")).cast("long").alias("links"), F.sum(F.expr("n * (n - 1) / 2 - kept")).cast("long").alias("cut"))

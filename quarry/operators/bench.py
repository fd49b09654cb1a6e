"""Reading strategies against golden signatures: tokens, reduction, recall, gate, recommendation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import markdown as M

BUDGET = 12_000
LADDER = ("lookup_only", "compact", "compact_lookup", "raw_head")
JUDGE_LEAST = 0.95


def raw_head(pages: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Per slug the first ``budget`` characters of its largest pages, blank lines between; ``pages``: slug, ord, content.

    What lies beyond the budget is cut before pages are gathered, so a group never holds more.
    """
    w = Window.partitionBy("slug").orderBy(F.desc("n"), "ord").rowsBetween(Window.unboundedPreceding, -1)
    sized = pages.select("slug", "ord", F.length("content").cast("long").alias("n"), F.substring("content", 1, budget).alias("head"))
    # within a share of a slug's pages already, none lies in the budget behind larger ones that fill it: only the front of each share is shuffled by slug
    share = Window.partitionBy("slug", "_s").orderBy(F.desc("n"), "ord").rowsBetween(Window.unboundedPreceding, -1)
    sized = sized.withColumn("_s", F.pmod(F.xxhash64("ord"), F.lit(64))).withColumn("_b", F.coalesce(F.sum("n").over(share), F.lit(0))).where(F.col("_b") < budget).drop("_s", "_b")
    part = sized.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).where(F.col("before") < budget)
    part = part.select("slug", F.struct((-F.col("n")).alias("k"), "ord", F.expr(f"substring(head, 1, {budget} - cast(before as int))").alias("t")).alias("s"))
    return part.groupBy("slug").agg(F.substring(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["t"]), "\n\n"), 1, budget).alias("artifact"))


def artifacts(pages: DataFrame, compact: DataFrame, lookup: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Q10: slug, strategy, artifact of all four strategies; ``compact``: slug, content; ``lookup``: slug, ord, line."""
    lines = lookup.groupBy("slug").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "line"))), lambda s: s["line"]), "\n").alias("lines"))
    base = pages.select("slug").distinct().join(compact.select("slug", F.col("content").alias("c")), "slug", "left").join(lines, "slug", "left")
    c = F.coalesce("c", F.lit(""))
    only = F.coalesce(F.concat("lines", F.lit("\n")), F.lit(""))
    both = F.when(F.col("lines").isNull(), c).otherwise(F.concat(c, F.lit("\n\n## LOOKUP\n"), "lines", F.lit("\n")))
    rows = base.select("slug", F.explode(F.array(*[F.struct(F.lit(n).alias("strategy"), x.alias("artifact")) for n, x in (("lookup_only", only), ("compact", c), ("compact_lookup", both))])).alias("s")).select("slug", "s.*")
    return rows.unionByName(raw_head(pages, budget).select("slug", F.lit("raw_head").alias("strategy"), "artifact"))


def missing(must: Column, artifact: Column) -> Column:
    """The signatures that the artifact lacks."""
    return F.filter(must, lambda m: ~F.contains(artifact, m))


def contained(docs: DataFrame, items: DataFrame, width: int = 5) -> DataFrame:
    """The rows of ``docs`` (column text) with each item (item_id, item) that the text holds.

    In place of trying every item on every text, both meet at runs of ``width`` words: of an item its first whole ones (the word it begins
    with may be the end of a longer one), of a text any. Items of too few words meet at shorter runs; those of fewer than three words are tried on every text.
    """
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    of = items.where("item is not null and item <> ''").select("item_id", "item", words(F.col("item")).alias("_ws"))
    of = of.withColumn("_w", F.least(F.size("_ws") - 2, F.lit(width)))
    keyed = of.where("_w > 0").select("item_id", "item", "_w", F.xxhash64(F.array_join(F.slice("_ws", F.lit(2), F.col("_w")), " ")).alias("_k"))
    lengths = F.broadcast(keyed.select("_w").distinct())  # ``width`` rows at most
    names = [c for c in docs.columns if c != "text"]
    runs = docs.select(*names, "text", words(F.col("text")).alias("_ws")).join(lengths, F.size("_ws") >= F.col("_w"))
    runs = runs.select(*names, "text", "_w", F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size("_ws") - F.col("_w") + 1, F.lit(1))), lambda k: F.xxhash64(F.array_join(F.slice("_ws", k, F.col("_w")), " ")))).alias("_ks"))
    hits = runs.withColumn("_k", F.explode("_ks")).drop("_ks").join(keyed, ["_w", "_k"]).where(F.contains("text", F.col("item"))).select(*names, "item_id")
    short = of.where("_w <= 0").select("item_id", "item")
    return hits.unionByName(docs.join(short, F.contains("text", F.col("item"))).select(*names, "item_id")).distinct()


def recall(must: Column, lacking: Column) -> Column:
    """1 for none asked."""
    return F.when(F.size(must) == 0, 1.0).otherwise((F.size(must) - F.size(lacking)) / F.size(must))


def judge_mean(scores: Column, asked: int) -> Column:
    """Of two points a question; null unless every answer was scored."""
    return F.when((F.size(scores) == asked) & (asked > 0), F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / (2 * asked))


def results(made: DataFrame, goldens: DataFrame, pages: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """Slug, strategy, tokens, reduction, recall, missing, gate, judge; ``goldens``: slug, must_have."""
    full = pages.groupBy("slug").agg(F.sum(M.tokens(F.col("content"))).alias("_t")).select("slug", F.when(F.col("_t") == 0, 1).otherwise(F.col("_t")).alias("full"))
    rows = made.join(goldens.select("slug", "must_have"), "slug").join(full, "slug").withColumn("missing", missing(F.col("must_have"), F.col("artifact"))).withColumn("tokens", M.tokens(F.col("artifact")))
    rows = rows.withColumn("judge", F.lit(None).cast("double")) if judged is None else rows.join(judged, ["slug", "strategy"], "left")
    return rows.select("slug", "strategy", "tokens", (1 - F.col("tokens") / F.col("full")).alias("reduction"), recall(F.col("must_have"), F.col("missing")).alias("recall"), "missing", F.when(F.size("missing") == 0, "PASS").otherwise("FAIL").alias("gate"), "judge")


def gate_failed(rows: DataFrame, control: str = "raw_head") -> DataFrame:
    """Whether any strategy but the negative control fails."""
    return rows.agg(F.coalesce(F.bool_or((F.col("strategy") != control) & (F.col("gate") == "FAIL")), F.lit(False)).alias("failed"))


def recommended(rows: DataFrame, least: float = JUDGE_LEAST) -> DataFrame:
    """The cheapest strategy that passes everywhere; null without one, or where a judgement is lacking."""
    place = F.array_position(F.array(*[F.lit(s) for s in LADDER]), F.col("strategy"))
    per = rows.groupBy("strategy").agg(F.bool_and((F.col("gate") == "PASS") & F.coalesce(F.col("judge") >= least, F.lit(False))).alias("ok"), F.bool_and(F.col("judge").isNotNull()).alias("judged"))
    return per.agg(F.when(F.bool_and("judged"), F.min_by("strategy", F.when(F.col("ok"), place).otherwise(99))).alias("s"), F.bool_or("ok").alias("any")).select(F.when(F.col("any"), F.col("s")).alias("strategy"))


def goldens(spark: SparkSession, folder: str) -> DataFrame:
    """Slug, must_have, questions of the JSON files in ``folder``; a folder without one is an error."""
    schema = "lib string, must_have array<string>, qa array<struct<q:string,a:string>>"
    found = spark.read.schema(schema).option("multiLine", "true").option("pathGlobFilter", "*.json").json(folder)
    return found.select(F.coalesce("lib", F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1)).alias("slug"), F.coalesce("must_have", F.array().cast("array<string>")).alias("must_have"), F.coalesce(F.transform("qa", lambda x: x["q"]), F.array().cast("array<string>")).alias("questions"))


def judged(made: DataFrame, goldens: DataFrame, judge: Callable[[str, str], int | None] | None = None) -> DataFrame:
    """Q12: slug, strategy, judge; ``judge(artifact, question)`` gives 0, 1 or 2 points, or None where it can't tell. Without one, or if any answer lacks, null."""
    rows = made.join(goldens.select("slug", "questions"), "slug").select("slug", "strategy", "artifact", "questions")
    if judge is None:
        return rows.select("slug", "strategy", F.lit(None).cast("double").alias("judge"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for artifact, questions in zip(b.column("artifact").to_pylist(), b.column("questions").to_pylist(), strict=True):
                points = [judge(artifact, q) for q in questions]
                out.append(None if not points or None in points else sum(points) / (2 * len(points)))
            yield pa.RecordBatch.from_arrays([b.column("slug"), b.column("strategy"), pa.array(out, pa.float64())], ["slug", "strategy", "judge"])

    return rows.mapInArrow(run, "slug string, strategy string, judge double")


def judge_label(judge: Column) -> Column:
    """T27"""
    return F.when(judge.isNull(), "skipped").otherwise(F.format_string("%.0f%%", judge * 100))


def report_lines(rows: DataFrame, full: DataFrame) -> DataFrame:
    """Slug, lines: a Markdown table of a library's strategies, cheapest first, and what each failing one lacks; ``full``: slug, tokens of all pages."""
    place = F.array_position(F.array(*[F.lit(s) for s in LADDER]), F.col("strategy"))
    percent = lambda c, n: F.format_string(f"%.{n}f%%", c * 100)
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "strategy", F.format_number("tokens", 0), percent(F.col("reduction"), 2), percent(F.col("recall"), 0), "gate", judge_label(F.col("judge"))), F.lit(" |"))
    lost = F.when(F.col("gate") == "FAIL", F.concat(F.lit("> `"), F.col("strategy"), F.lit("` lacks "), F.array_join(F.transform("missing", lambda m: F.concat(F.lit("`"), m, F.lit("`"))), ", ")))
    each = rows.select("slug", F.struct(place.alias("k"), line.alias("line"), lost.alias("lost")).alias("r")).groupBy("slug").agg(F.sort_array(F.collect_list("r")).alias("rs"))  # as many as there are strategies
    head = F.concat(F.lit("## "), F.col("slug"), F.lit(" ("), F.format_number("full", 0), F.lit(" tokens raw)"))
    table = F.array(head, F.lit(""), F.lit("| Strategy | Tokens | Saved | Recall | Gate | Judge |"), F.lit("|-|-:|-:|:-:|:-:|:-:|"))
    lines = F.concat(table, F.transform("rs", lambda r: r["line"]), F.filter(F.transform("rs", lambda r: r["lost"]), lambda x: x.isNotNull()))
    return each.join(full.select("slug", F.col("tokens").alias("full")), "slug").select("slug", F.array_join(lines, "\n").alias("lines"))

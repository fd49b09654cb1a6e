"""A store of Markdown files: which are pages, indexes, lookups, dashboards, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import markdown as M
from quarry.functions import urls as U

RESERVED = ("INDEX.md", "COMPACT.md", "LOOKUP.md")
_CACHES = ("_raw_html", "__pycache__")


def scan(spark: SparkSession, root: str) -> DataFrame:
    """Path, slug, rel, name, content, size, mtime of every Markdown file below ``root``."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(root, wholetext=True).select("value", "_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    below = F.regexp_extract("file_path", rf"\Q{root.rstrip('/')}/\E(.*)$", 1)
    return files.select(F.col("file_path").alias("path"), F.substring_index(below, "/", 1).alias("slug"), F.regexp_replace(below, r"^[^/]*/?", "").alias("rel"), F.element_at(F.split(below, "/"), -1).alias("name"), F.col("value").alias("content"), F.col("file_size").alias("size"), F.col("file_modification_time").alias("mtime")).where("rel <> ''")


def with_page_flags(files: DataFrame) -> DataFrame:
    """One boolean a meaning of 'page', from the strictest to the loosest."""
    parts = F.split("rel", "/")
    reserved = F.col("name").isin(*RESERVED)
    cached = F.exists(parts, lambda p: p.isin(*_CACHES))
    hidden = F.exists(parts, lambda p: F.startswith(p, F.lit(".")))
    looked = ~reserved & ~cached & ~hidden
    return files.withColumns({
        "is_page": looked & ~U.is_asset_file(F.col("name")) & M.is_text(F.col("content")),
        "is_lookup_page": looked,
        "is_bench_page": ~reserved & ~F.exists(parts, lambda p: p == "_raw_html"),
        "is_counted_page": ~reserved,
        "is_top_page": ~reserved & (F.size(parts) == 1),
    })


def visible_slugs(files: DataFrame) -> DataFrame:
    return files.where(~F.startswith("slug", F.lit(".")) & ~F.col("slug").isin(*_CACHES))


def dashboard(files: DataFrame, lookup_libs: DataFrame | None = None) -> DataFrame:
    """Slug, tiers, pages, raw_tok, compact_tok, indexed, reduction. ``lookup_libs``: lib, the libraries of the global lookup."""
    f = with_page_flags(visible_slugs(files))
    tier = lambda n: F.max(F.when((F.col("rel") == n), 1).otherwise(0))
    compact = F.when(F.col("rel") == "COMPACT.md", F.col("content"))
    rows = f.groupBy("slug").agg(
        F.count_if("is_page").alias("pages"),
        F.coalesce(F.sum(F.when(F.col("is_page"), M.tokens(F.col("content")))), F.lit(0)).alias("raw_tok"),
        F.coalesce(F.max(M.tokens(compact)), F.lit(0)).alias("compact_tok"),
        F.coalesce(F.max(F.nullif(F.regexp_extract(compact, r"(?i)Indexed:?\s*(\d{4}-\d{2}-\d{2})", 1), F.lit(""))), F.lit("—")).alias("indexed"),
        tier("INDEX.md").alias("_i"), tier("COMPACT.md").alias("_c"), tier("LOOKUP.md").alias("_l"),
    )
    if lookup_libs is not None:
        rows = rows.join(lookup_libs.select(F.lower("lib").alias("_lib")).distinct(), F.lower("slug") == F.col("_lib"), "left").withColumn("_l", F.when(F.col("_lib").isNotNull(), 1).otherwise(F.col("_l")))
    flag = lambda c, x: F.when(c, x).otherwise("·")
    tiers = F.concat(flag(F.col("pages") > 0, "R"), flag(F.col("_i") == 1, "I"), flag(F.col("_c") == 1, "C"), flag(F.col("_l") == 1, "L"))
    return rows.select("slug", tiers.alias("tiers"), "pages", "raw_tok", "compact_tok", "indexed", reduction(F.col("raw_tok"), F.col("compact_tok")).alias("reduction"))


def reduction(raw: Column, compact: Column) -> Column:
    """A3: null where either is nought."""
    return F.when((raw > 0) & (compact > 0), 1 - compact / raw)


def dashboard_cells(rows: DataFrame) -> DataFrame:
    """Each row as a line of the table, with the total as the last; ``ord`` orders them."""
    dash = F.lit("—")
    cell = lambda r: F.when(r.isNull(), dash).otherwise(F.concat(F.lit("`"), M.bar(r), F.lit("` "), F.format_string("%.1f%%", r * 100)))
    line = F.concat_ws(" | ", F.concat(F.lit("| "), F.col("slug")), F.concat(F.lit("`"), "tiers", F.lit("`")), F.col("pages").cast("string"), F.format_number("raw_tok", 0), F.when(F.col("compact_tok") > 0, F.format_number("compact_tok", 0)).otherwise(dash), cell(F.col("reduction")), F.concat(F.col("indexed"), F.lit(" |")))
    total = rows.agg(F.sum("pages").alias("p"), F.sum("raw_tok").alias("r"), F.sum("compact_tok").alias("c")).where("p is not null")
    share = F.when(F.col("r") > 0, 1 - F.col("c") / F.col("r"))
    last = F.concat_ws(" | ", F.lit("| **Total**"), dash, F.concat(F.lit("**"), F.col("p").cast("string"), F.lit("**")), F.concat(F.lit("**"), F.format_number("r", 0), F.lit("**")), F.concat(F.lit("**"), F.format_number("c", 0), F.lit("**")), cell(share), F.concat(dash, F.lit(" |")))
    return rows.select(F.lit(0).alias("ord"), "slug", line.alias("line")).unionByName(total.select(F.lit(1).alias("ord"), F.lit("").alias("slug"), last.alias("line")))


def manifest(files: DataFrame) -> DataFrame:
    """Slug, pages, indexed, bytes, size."""
    f = with_page_flags(visible_slugs(files))
    rows = f.groupBy("slug").agg(F.count_if("is_page").alias("pages"), F.max(F.col("rel") == "COMPACT.md").alias("indexed"), F.sum("size").alias("bytes"))
    return rows.withColumn("size", M.size_label(F.col("bytes")))


def index_lines(pages: DataFrame) -> DataFrame:
    """Section, header, entries (Markdown bullets in order of ``ord``); ``pages``: ord, url, title, file."""
    entry = F.concat(F.lit("- ["), M.link_text(F.col("title")), F.lit("]("), F.col("file"), F.lit(")"))
    rows = pages.select(U.section(F.col("url")).alias("section"), F.struct("ord", entry.alias("line")).alias("e"))
    out = rows.groupBy("section").agg(F.count(F.lit(1)).alias("pages"), F.array_join(F.transform(F.sort_array(F.collect_list("e")), lambda e: e["line"]), "\n").alias("entries"))
    return out.select("section", F.concat(F.lit("## "), U.title_case(F.col("section"))).alias("header"), "pages", "entries")


def page_document(title: Column, url: Column, markdown: Column, engine: Column | None = None, fetched: Column | None = None) -> Column:
    """Frontmatter that a title can't break, one H1, the body. A body with frontmatter of its own, closed, stays as it is."""
    quote = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'^\{"v":(.*)\}$', 1)
    origin = F.lit("") if engine is None else F.concat(F.lit("fetched_with: "), engine, F.lit("\nfetched_at: "), fetched.cast("string"), F.lit("\n"))
    front = F.concat(F.lit("---\ntitle: "), quote(title), F.lit("\nurl: "), quote(url), F.lit("\n"), origin, F.lit("---\n\n"))
    body = F.regexp_replace(markdown, r"(?U)\A\s+", "")
    has_h1 = F.startswith(body, F.lit("# "))
    heading = F.concat(F.lit("# "), M.strip(F.replace(title, F.lit("\n"), F.lit(" "))), F.lit("\n\n"))
    return F.when(markdown.rlike(r"\A---\n(?s:.*?)\n---(?:\n|\z)"), markdown).when(has_h1, F.concat(front, body)).otherwise(F.concat(front, heading, markdown))


def reindex(files: DataFrame) -> DataFrame:
    """K4: ord, slug, file, title, url of every page, from frontmatter; feeds ``index_lines``."""
    f = with_page_flags(files).where("is_counted_page")
    stem = F.regexp_replace("name", r"\.md$", "")
    return f.select("slug", F.col("rel").alias("file"), M.front_title(F.col("content"), stem).alias("title"), F.coalesce(M.front_url(F.col("content")), F.lit("")).alias("url"), F.row_number().over(Window.partitionBy("slug").orderBy("rel")).alias("ord"))


def lookup_build(files: DataFrame) -> DataFrame:
    """K6: slug, line."""
    f = with_page_flags(files).where("is_lookup_page")
    return f.select("slug", M.lookup_line(F.col("slug"), U.page_name(F.col("rel")), F.col("content")).alias("line"))


def lookup_merge(existing: DataFrame, new: DataFrame, lib: str) -> DataFrame:
    """``existing`` lines of other libraries and the well-formed ``new`` ones, each once: lib (in small letters), line; ``lookup_order`` sorts them."""
    kept = existing.where("trim(line) <> ''").select(F.rtrim("line").alias("line")).where(F.lower(M.lib_of(F.col("line"))) != lib.lower())
    fresh = new.where("trim(line) <> ''").select(F.rtrim("line").alias("line")).where(F.contains("line", F.lit("|"))).distinct()
    return kept.unionByName(fresh).select(F.lower(M.lib_of(F.col("line"))).alias("lib"), "line")


def malformed(new: DataFrame) -> DataFrame:
    """the lines that a merge rejects."""
    return new.where((F.trim("line") != "") & ~F.contains("line", F.lit("|")))


def lookup_order(rows: DataFrame) -> DataFrame:
    """O2: by library, whatever its case, then by line, in the order of code points."""
    return rows.orderBy("lib", "line")


def append_new(existing: DataFrame, new: DataFrame, width: int = 12, most: int = 64) -> DataFrame:
    """``new`` lines, each once, that no existing line contains.

    No pairs are made. A line lies in an old one if an end of that begins with it: lines shorter than ``width`` are looked up among the
    beginnings of all ends, the others find the next end in order (``_held``), cut after ``most`` characters where the line is no longer.
    """
    fresh = new.select("line").distinct().where("line <> ''").withColumn("w", F.length("line"))
    old = existing.where("line <> ''").select(F.col("line").alias("old")).distinct()
    head, most = min(4, width), max(width, most)
    tiny, short, middle, long = (fresh.where(F.col("w").between(a, b)) for a, b in ((1, head - 1), (head, width - 1), (width, most), (most + 1, 1 << 30)))
    held = _held(middle, _ends(old, middle, head, width, most).distinct(), width).unionByName(_held(long, _ends(old, long, head, most + 1, None).distinct(), most + 1))
    for lines, first, longest in ((tiny, 1, head - 1), (short, head, width - 1)):
        if first <= longest:
            lengths = lines.select("w").distinct()  # fewer rows than ``width``
            begun = _ends(old, lines, first, first, longest).distinct().join(F.broadcast(lengths), F.length("end") >= F.col("w"))
            held = held.unionByName(lines.select("line").join(begun.select(F.substring("end", F.lit(1), F.col("w")).alias("line")).distinct(), "line", "left_semi"))
    return fresh.select("line").join(held, "line", "left_anti")


def _ends(old: DataFrame, fresh: DataFrame, head: int, least: int, most: int | None) -> DataFrame:
    """end: what each old line ends with from any place on, ``least`` characters or more and cut after ``most``, if a line begins with its first ``head`` ones."""
    heads = fresh.select(F.substring("line", 1, head).alias("head")).distinct()  # beginnings of a few characters: 2,000 of 29,000 lines at 3
    at = old.where(F.length("old") >= least).select("old", F.explode(F.sequence(F.lit(1), F.length("old") - (least - 1))).alias("k"))
    at = at.withColumn("head", F.substring("old", F.col("k"), F.lit(head))).join(F.broadcast(heads), "head", "left_semi")
    return at.select(F.substring("old", F.col("k"), F.length("old") if most is None else F.lit(most)).alias("end"))


def _held(fresh: DataFrame, ends: DataFrame, width: int) -> DataFrame:
    """line: those that an end begins with. Of the ends that aren't before a line, the first begins with it if any does; lines and ends meet by their first ``width`` characters."""
    rows = fresh.select("line", F.lit(0).alias("old")).unionByName(ends.select(F.col("end").alias("line"), F.lit(1).alias("old")))
    w = Window.partitionBy(F.substring("line", 1, width)).orderBy(F.desc("line"), F.desc("old")).rowsBetween(Window.unboundedPreceding, 0)
    after = rows.withColumn("after", F.last(F.when(F.col("old") == 1, F.col("line")), ignorenulls=True).over(w))
    return after.where((F.col("old") == 0) & F.startswith("after", F.col("line"))).select("line")


def distinct_libs(lines: DataFrame) -> DataFrame:
    """A4: how many libraries the lines name, whatever their case."""
    return lines.where(F.contains("line", F.lit("|"))).agg(F.countDistinct(F.lower(M.lib_of(F.col("line")))).alias("libs"))


def compact_tokens(files: DataFrame) -> DataFrame:
    """Slug, compact (tokens of its COMPACT.md, one at least; null without)."""
    return files.groupBy("slug").agg(F.max(F.when(F.col("rel") == "COMPACT.md", M.tokens_at_least_one(F.col("content")))).alias("compact"))


def dashboard_drift(lines: DataFrame, saved: DataFrame) -> DataFrame:
    """Q1's check: the dashboard's lines that the saved file (column content) lacks; none if it is up to date."""
    have = saved.select(F.explode(F.split("content", "\n")).alias("line"))
    return lines.select("line").join(have, "line", "left_anti")


def distill_candidates(pages: DataFrame, most: int = 8) -> DataFrame:
    """Q17's choice of files: slug, ord, tokens of the ``most`` largest pages of each library; ties by ``ord``. The top of each group is an aggregate, not a sort of it."""
    sized = pages.select("slug", F.struct((-M.tokens(F.col("content"))).alias("k"), "ord").alias("p"))
    # each task keeps its own best ones of a slug before they meet
    best = sized.withColumn("_salt", F.spark_partition_id()).withColumn("_r", F.row_number().over(Window.partitionBy("slug", "_salt").orderBy("p"))).where(F.col("_r") <= most)
    top = best.groupBy("slug").agg(F.slice(F.sort_array(F.collect_list("p")), 1, most).alias("ps"))
    return top.select("slug", F.explode("ps").alias("p")).select("slug", "p.ord", (-F.col("p.k")).alias("tokens"))


def lookup_cost(pages: DataFrame, local: DataFrame, world: DataFrame, query: str, max_lines: int = 3) -> DataFrame:
    """Q3: per library, what an answer costs: the first tier with a hit, matches, tokens of the shown lines, of the whole, and their ratio.

    ``pages``: slug, ord, content; ``local``: slug, ord, line; ``world``: ord, line, each with its library in front.
    """
    hit = lambda c: F.contains(F.lower(c), F.lit(query.lower()))
    a = local.where(hit(F.col("line"))).select("slug", F.lit(0).alias("tier"), F.struct("ord", F.lit(0).alias("n"), "line").alias("m"))
    b = world.where(hit(F.col("line"))).select(M.lib_of(F.col("line")).alias("slug"), F.lit(1).alias("tier"), F.struct("ord", F.lit(0).alias("n"), "line").alias("m"))
    raw = pages.where(hit(F.col("content"))).select("slug", "ord", F.posexplode(F.split("content", "\n")).alias("n", "line")).where(hit(F.col("line")))
    c = raw.select("slug", F.lit(2).alias("tier"), F.struct("ord", "n", M.strip(F.col("line")).alias("line")).alias("m"))
    hits = a.unionByName(b).unionByName(c)
    counts = hits.groupBy("slug", "tier").agg(F.count(F.lit(1)).alias("matches"))
    ranked = hits.withColumn("_k", F.row_number().over(Window.partitionBy("slug", "tier").orderBy("m"))).where(F.col("_k") <= max_lines)
    shown = ranked.groupBy("slug", "tier").agg(F.array_join(F.transform(F.sort_array(F.collect_list("m")), lambda m: m["line"]), "\n").alias("sample"))
    best = counts.join(shown, ["slug", "tier"]).groupBy("slug").agg(F.min_by(F.struct("tier", "matches", "sample"), "tier").alias("s")).select("slug", "s.*")
    whole = pages.groupBy("slug").agg(F.sum(M.tokens_at_least_one(F.col("content"))).alias("whole"))
    look = F.when(F.col("sample").isNull(), 1).otherwise(M.tokens_at_least_one(F.col("sample"))).cast("long")
    names = F.element_at(F.array(F.lit("LOOKUP.md"), F.lit("global LOOKUP.md"), F.lit("raw grep")), F.coalesce("tier", F.lit(2)) + 1)
    return whole.join(best, "slug", "left").select("slug", names.alias("tier"), F.coalesce("matches", F.lit(0)).alias("matches"), look.alias("look"), "whole", F.floor(F.col("whole") / look).cast("long").alias("ratio"))


def read_ladder(tiers: DataFrame, ceiling: int = 6000, most_pages: int = 2) -> DataFrame:
    """Q18, Q20: of slug, rank (0 lookup, 1 compact, 2 page), ord, text: what fits, cheapest tier first, at most two pages, within the ceiling."""
    w = Window.partitionBy("slug").orderBy("rank", "ord")
    used = tiers.withColumn("tok", M.tokens(F.col("text"))).withColumn("_p", F.sum(F.when(F.col("rank") >= 2, 1).otherwise(0)).over(w)).where(F.col("_p") <= most_pages)
    return used.withColumn("used", F.sum("tok").over(w)).where(F.col("used") <= ceiling).drop("_p")

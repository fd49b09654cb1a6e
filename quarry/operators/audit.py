"""Audits of a store: duplicates, lost sources, stale copies, defects, inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import markdown as M
from quarry.functions import urls as U
from quarry.operators.store import with_page_flags

STUB_MAX, STUB_RATIO = 5, 4


def known_source(source: Column) -> Column:
    """F20"""
    return F.nullif(F.nullif(F.trim(source), F.lit("")), F.lit("?"))


def doctor(files: DataFrame, include_hidden: bool = False) -> DataFrame:
    """Slug, files, clean, assets, asset_paths, index_rows (-1 without an index), drift."""
    f = files if include_hidden else files.where(~F.startswith("slug", F.lit(".")))
    f = with_page_flags(f)
    asset = F.col("is_counted_page") & U.is_asset_file(F.col("name"))
    entries = F.size(F.filter(F.split("content", r"\R"), lambda x: F.startswith(x, F.lit("- ["))))
    rows = f.groupBy("slug").agg(F.count_if("is_counted_page").alias("files"), F.count_if(asset).alias("assets"), F.sort_array(F.collect_list(F.when(asset, F.col("rel")))).alias("asset_paths"), F.coalesce(F.max(F.when(F.col("rel") == "INDEX.md", entries)), F.lit(-1)).alias("index_rows"))
    return rows.select("slug", "files", (F.col("files") - F.col("assets")).alias("clean"), "assets", "asset_paths", "index_rows", ((F.col("index_rows") >= 0) & (F.col("index_rows") != F.col("files"))).alias("drift"))


def doctor_summary(rows: DataFrame) -> DataFrame:
    """A9"""
    return rows.agg(F.count(F.lit(1)).alias("slugs"), F.sum("files").alias("files"), F.sum("assets").alias("assets"), F.count_if("drift").alias("drifted"), F.count_if((F.col("assets") > 0) | F.col("drift")).alias("defective"))


def keep_first(group: list[str]) -> Window:
    """Freshest, then shorter, then lesser name."""
    return Window.partitionBy(*group).orderBy(F.desc("newest"), F.length("slug"), "slug")


def duplicates(libs: DataFrame) -> DataFrame:
    """Q6: reason, keep, archive, members of each pair that shows one library twice; ``libs``: slug, pages, source, newest.

    Name pairs first, then mirrors of one source, then stubs beside a far larger sibling; a slug is claimed once, and
    within a rule the lesser slug claims first.
    """
    libs = libs.withColumn("source", known_source(F.col("source")))
    x, y = libs.select(F.col("slug").alias("a")), libs.select(F.col("slug").alias("b"))
    named = x.select("a", F.explode(F.array(F.concat("a", F.lit("-docs")), F.concat("a", F.lit("-doc")))).alias("b")).join(y, "b")
    named = _claim(named.select(F.lit(1).alias("rule"), "a", "b"), None)
    by = libs.withColumn("_s", U.norm_source(F.col("source"))).where("_s <> ''").groupBy("_s").agg(F.sort_array(F.collect_list(F.struct("slug", "pages"))).alias("m")).where((F.size("m") == 2) & (F.col("m")[0]["pages"] == F.col("m")[1]["pages"]))
    mirror = _claim(by.select(F.lit(2).alias("rule"), F.col("m")[0]["slug"].alias("a"), F.col("m")[1]["slug"].alias("b")), named)
    taken = named.unionByName(mirror)
    big = libs.select(F.col("slug").alias("b"), F.col("pages").alias("bp"))
    free = _unclaimed(libs.select(F.col("slug").alias("a"), F.col("pages").alias("ap")).where(F.col("ap") <= STUB_MAX), "a", taken)
    # every proper prefix of a slug that ends before a dash: an equi-join in place of startswith
    heads = _unclaimed(big, "b", taken).select("b", "bp", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("b", "-"))), lambda k: F.array_join(F.slice(F.split("b", "-"), F.lit(1), k), "-"))).alias("a")).where("a <> b")
    beside = free.join(heads, "a").where(F.col("bp") >= F.col("ap") * STUB_RATIO)
    stub = _claim(beside.groupBy("a").agg(F.max_by("b", F.struct("bp", F.expr("-length(b)"))).alias("b")).select(F.lit(3).alias("rule"), "a", "b"), taken)
    pairs = taken.unionByName(stub)
    members = pairs.select("rule", F.col("a").alias("g"), F.explode(F.array("a", "b")).alias("slug")).join(libs, "slug")
    ranked = members.withColumn("_k", F.row_number().over(keep_first(["rule", "g"])))
    reason = F.element_at(F.array(F.lit("name-pair"), F.lit("same-source mirror"), F.lit("stub-beside-full")), F.col("rule"))
    return ranked.groupBy("rule", "g").agg(F.max(F.when(F.col("_k") == 1, F.col("slug"))).alias("keep"), F.max(F.when(F.col("_k") == 2, F.col("slug"))).alias("archive")).select(reason.alias("reason"), "keep", "archive")


def _unclaimed(rows: DataFrame, name: str, taken: DataFrame | None) -> DataFrame:
    if taken is None:
        return rows
    return rows.join(taken.select(F.explode(F.array("a", "b")).alias(name)), name, "left_anti")


def _claim(pairs: DataFrame, taken: DataFrame | None) -> DataFrame:
    """Pairs none of whose slugs an earlier rule, or a lesser pair of this one, has."""
    free = _unclaimed(_unclaimed(pairs, "a", taken), "b", taken).select("rule", "a", "b")
    first = free.withColumn("_p", F.min(F.struct("a", "b")).over(Window.partitionBy("a"))).withColumn("_q", F.min(F.struct("a", "b")).over(Window.partitionBy("b")))
    return first.where((F.struct("a", "b") == F.col("_p")) & (F.struct("a", "b") == F.col("_q"))).select("rule", "a", "b")


def registry(libs: DataFrame, silos: DataFrame, archives: DataFrame) -> DataFrame:
    """Slug, source, pages, state (url, other, recovered, lost), origin. Archives count by their time, silos as the oldest."""
    candidates = silos.select("slug", F.col("source").alias("found"), F.concat(F.lit("silo "), "path").alias("origin"), F.lit(0.0).alias("mtime"), F.lit(0).alias("kind"), "path").unionByName(archives.select("slug", F.col("source").alias("found"), F.concat(F.lit("archive "), "path").alias("origin"), F.col("mtime").cast("double").alias("mtime"), F.lit(1).alias("kind"), "path"))
    best = candidates.where(known_source(F.col("found")).isNotNull()).withColumn("_k", F.row_number().over(Window.partitionBy("slug").orderBy(F.desc("mtime"), "kind", "path"))).where("_k = 1").select("slug", "found", "origin")
    own = libs.select("slug", "pages", known_source(F.col("source")).alias("own"))
    state = F.when(F.col("own").rlike("^https?://"), "url").when(F.col("own").isNotNull(), "other").when(F.col("found").isNotNull(), "recovered").otherwise("lost")
    return own.join(best, "slug", "left").select("slug", F.coalesce("own", "found").alias("source"), "pages", state.alias("state"), F.when(F.col("own").isNull(), F.col("origin")).alias("origin"))


def url_state(status: Column, final: Column, url: Column) -> Column:
    """Live, moved, gone or unverified."""
    return F.when(status.isin(404, 410), "gone").when((status >= 200) & (status < 400), F.when(final.isNotNull() & U.moved(url, final), "moved").otherwise("live")).otherwise("unverified")


def outdated(libs: DataFrame, releases: DataFrame) -> DataFrame:
    """Slug, pages, snapshot, registry, version, released, status; ``releases``: slug, registry, version, released."""
    status = F.when(F.col("registry").isNull(), "no-registry").when(F.col("version").isNull(), "?").when(F.col("released").isNull(), "? (no date)").when(F.col("released") > F.col("snapshot"), "BEHIND").otherwise("ok")
    return libs.select("slug", "pages", "snapshot").join(releases.select("slug", "registry", "version", "released"), "slug", "left").withColumn("status", status)


def outdated_summary(rows: DataFrame) -> DataFrame:
    """A12"""
    return rows.agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("status").isin("BEHIND", "ok")).alias("checkable"), F.count_if(F.col("status") == "BEHIND").alias("behind"), F.count_if(F.col("status") == "no-registry").alias("no_registry"))


def snapshot(files: DataFrame) -> DataFrame:
    """Slug, pages, snapshot (date of the newest page)."""
    return with_page_flags(files).where("is_lookup_page").groupBy("slug").agg(F.count(F.lit(1)).alias("pages"), F.date_format(F.max("mtime"), "yyyy-MM-dd").alias("snapshot"))


def inventory(files: DataFrame) -> DataFrame:
    """Slug, disk, header (pages by the index, -1 unknown), dup, engine, source; a slug without an index is left out."""
    f = with_page_flags(files)
    index = F.max(F.when(F.col("rel") == "INDEX.md", F.col("content")))
    rows = f.groupBy("slug").agg(F.count_if("is_counted_page").alias("disk"), index.alias("_x")).where("_x is not null")
    field = lambda n, p, none: F.coalesce(F.nullif(F.regexp_extract("_x", rf"{n}:\s*({p})", 1), F.lit("")), F.lit(none))
    rows = rows.select("slug", "disk", field("Pages", r"\d+", "-1").cast("int").alias("header"), field("Engine", r"\S+", "-").alias("engine"), field("Source", r"\S+", "?").alias("source"))
    return rows.withColumn("dup", (F.col("header") >= 0) & (F.col("header") != F.col("disk")))


def engine_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """What only ``a`` has."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti")


def unstable(texts: DataFrame, column: str = "text") -> DataFrame:
    """Q14: rows that minification would change."""
    return texts.where(M.minify(F.col(column)) != F.col(column))


def doctor_order(rows: DataFrame) -> DataFrame:
    """Most assets first, then by name."""
    return rows.orderBy(F.desc("assets"), "slug")


def outdated_order(rows: DataFrame, by_age: bool = False) -> DataFrame:
    """By pages, or by snapshot with unknown ones last; then by name."""
    return rows.orderBy(F.asc_nulls_last("snapshot") if by_age else F.asc("pages"), "slug")


def behind_only(rows: DataFrame) -> DataFrame:
    """F22"""
    return rows.where(F.col("status") == "BEHIND")


def inventory_order(rows: DataFrame) -> DataFrame:
    """By all columns, from the left."""
    return rows.orderBy(*rows.columns)


def newest(files: DataFrame) -> DataFrame:
    """Slug, newest (time of its newest page)."""
    return with_page_flags(files).where("is_counted_page").groupBy("slug").agg(F.max("mtime").alias("newest"))


def date_label(time: Column) -> Column:
    """The day, in the session's time zone; a dash for none."""
    return F.coalesce(F.date_format(time, "yyyy-MM-dd"), F.lit("-"))


def registry_counts(rows: DataFrame) -> DataFrame:
    """Slugs, and how many of each state of their source."""
    states = ("url", "other", "recovered", "lost")
    return rows.agg(F.count(F.lit(1)).alias("slugs"), *[F.count_if(F.col("state") == s).alias(s) for s in states])


def url_state_counts(states: DataFrame) -> DataFrame:
    """State, n; ``states``: status, final, url of each probe."""
    return states.select(url_state(F.col("status"), F.col("final"), F.col("url")).alias("state")).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


_FIELD = r"(?mi)^{}:\s*(.+?)\s*$"


def silos(files: DataFrame, store: str) -> DataFrame:
    """Slug, path, source, pages of each folder outside ``store`` whose INDEX.md names its source; ``files``: path, content.

    Folders below version control, dependencies and the tool's own state are none.
    """
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    plain = F.regexp_replace(folder, r"^file:/+", "/")
    home = store.rstrip("/")
    parts = F.split(plain, "/")
    f = files.select(plain.alias("folder"), F.element_at(F.split("path", "/"), -1).alias("name"), "content").where(~((plain == home) | F.startswith(plain, F.lit(home + "/"))) & ~F.arrays_overlap(parts, F.array(*[F.lit(x) for x in (".git", "node_modules", ".venv", ".llmdocs")])))
    index = f.where(F.col("name") == "INDEX.md").select("folder", known_source(F.regexp_extract("content", _FIELD.format("Source"), 1)).alias("source")).where("source is not null")
    # a page counts for each folder above it
    pages = f.where(~F.col("name").isin("INDEX.md", "COMPACT.md", "LOOKUP.md")).select("folder", F.split("folder", "/").alias("p"))
    above = pages.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda k: F.array_join(F.slice("p", F.lit(1), k), "/"))).alias("folder")).groupBy("folder").agg(F.count(F.lit(1)).alias("pages"))
    return index.join(above, "folder", "left").select(F.element_at(F.split("folder", "/"), -1).alias("slug"), F.col("folder").alias("path"), "source", F.coalesce("pages", F.lit(0)).alias("pages"))


def archived(files: DataFrame) -> DataFrame:
    """Slug, path, source, fetched, mtime of each copy ``slug@...`` whose INDEX.md names its source; ``files``: ``store.scan`` of the store's ``.archive``."""
    f = files.where((F.col("rel") == "INDEX.md") & F.contains("slug", F.lit("@"))).select(F.col("slug").alias("name"), "content", "mtime")
    return f.select(F.substring_index("name", "@", 1).alias("slug"), F.col("name").alias("path"), known_source(F.regexp_extract("content", _FIELD.format("Source"), 1)).alias("source"), F.regexp_extract("content", _FIELD.format("Fetched"), 1).alias("fetched"), "mtime").where("source is not null")


def compare_engines(files: DataFrame, reference: str) -> DataFrame:
    """Engine, files, index, ok, assets, only (files that ``reference`` lacks); ``files``: engine, rel, name, content."""
    f = with_page_flags(files)
    entries = F.size(F.filter(F.split("content", r"\R"), lambda x: F.startswith(x, F.lit("- ["))))
    rows = f.groupBy("engine").agg(F.count_if("is_counted_page").alias("files"), F.coalesce(F.max(F.when(F.col("rel") == "INDEX.md", entries)), F.lit(0)).alias("index"), F.count_if(U.is_asset_file(F.col("name"))).alias("assets"))
    pages = f.where("is_counted_page").select("engine", "rel").distinct()
    only = pages.join(pages.where(F.col("engine") == reference).select("rel"), "rel", "left_anti").groupBy("engine").agg(F.count(F.lit(1)).alias("only"))
    return rows.join(only, "engine", "left").select("engine", "files", "index", (F.col("files") == F.col("index")).alias("ok"), "assets", F.coalesce("only", F.lit(0)).alias("only"))

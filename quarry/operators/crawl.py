"""The link graph and its breadth-first traversal, one join a wave."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import html as H
from quarry.functions import urls as U


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="quarry-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a temporary one only where that is unset and the master is local."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = _local_folder()
    return where.rstrip("/")


def _cut(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read again, which cuts the lineage and the plan's size estimate."""
    path = f"{shared_folder(df.sparkSession)}/quarry-{df.sparkSession.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def edges(pages: DataFrame, pattern: str | None = None, same_host: bool = True, hrefs: Column | None = None) -> DataFrame:
    """Src, pos, dst; each link once a page, at its first place. Assets, other hosts and skipped paths are no links."""
    found = pages.select(F.col("url").alias("src"), F.posexplode(H.native_hrefs(F.col("html")) if hrefs is None else hrefs).alias("pos", "href"))
    found = found.where(U.followable(F.col("href"))).select("src", "pos", U.resolve(F.col("src"), F.col("href")).alias("dst"))
    keep = ~U.is_asset(F.col("dst"))
    if same_host:
        keep = keep & (U.authority(F.col("dst")) == U.authority(F.col("src")))
    if pattern:
        keep = keep & ~U.skipped(F.col("dst"), pattern)
    return found.where(keep).groupBy("src", "dst").agg(F.min("pos").alias("pos")).select("src", "pos", "dst")


def dominant_version(links: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per source page, the version that leads at least ``threshold`` of the links whose first segment is one."""
    first = F.try_element_at(U.segments(F.col("dst")), F.lit(1))
    seen = links.select("src", "pos", first.alias("version")).where(F.col("version").rlike(f"^{U.VERSION}$"))
    counts = seen.groupBy("src", "version").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"))
    best = counts.groupBy("src").agg(F.sum("n").alias("total"), F.max_by("version", F.struct("n", -F.col("pos"))).alias("version"), F.max("n").alias("n"))
    return best.where(F.col("n") >= threshold * F.col("total")).select("src", "version")


def first_per_file(urls: DataFrame, order: list[Column]) -> DataFrame:
    """Of the URLs that write one file, the first."""
    w = Window.partitionBy("file_key").orderBy(*order)
    return urls.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def crawl(links: DataFrame | Callable[[DataFrame], DataFrame], start: str, prefix: str = "", max_depth: int = 4, max_pages: int | None = 200, bridge_hops: int = 1, cap_mode: str = "intent") -> DataFrame:
    """Url, depth, budget, saved, wave of every page reached.

    ``links``: src, pos, dst, of all pages, or a function that fetches a wave (a column url, ``max_pages`` rows at most) and gives its links. A page at ``max_depth`` gives no links. Links under ``prefix`` go one deeper and renew the
    budget; others use it up at the same depth. A file is claimed by its first discovery, in order of the
    parent and the place of the link, links under the prefix first. ``cap_mode``: 'intent' admits ``max_pages``
    pages; 'reference' counts each new link of a wave twice and leaves out a wave that fills the cap exactly.
    ``max_pages`` None admits every page that the depth reaches; a wave is then ranked by all tasks.
    """
    spark = SparkSession.getActiveSession() if not isinstance(links, DataFrame) else links.sparkSession
    pre = F.lit(prefix)
    row = spark.createDataFrame([(start, 0, bridge_hops, 0, 0)], "url string, depth int, budget int, wave int, ord long").withColumn("url", U.drop_fragment(F.col("url")))
    seen = _cut(row.withColumn("file_key", U.file_key(F.col("url"))))
    links_of = _every(links) if isinstance(links, DataFrame) else links
    wave, count = 0, 1
    while True:
        room = None if max_pages is None else max_pages - count
        if room is None:
            pass
        elif cap_mode == "reference":
            if room <= 0:
                seen = seen.where(F.col("wave") < wave) if wave else seen.where("false")
                break
            room = (room + 1) // 2
        elif room <= 0:
            break
        front = seen.where((F.col("wave") == wave) & (F.col("depth") < max_depth))
        front = front.select(F.col("url").alias("src"), F.col("depth").alias("d"), F.col("budget").alias("b"), F.col("ord").alias("o"))
        known = links_of(front.select(F.col("src").alias("url"))).select("src", "pos", U.drop_fragment(F.col("dst")).alias("url"))
        found = front.join(known, "src")
        inside = U.in_prefix(F.col("url"), pre)
        found = found.select("url", "o", "pos", inside.alias("inside"), F.when(inside, F.col("d") + 1).otherwise(F.col("d")).alias("depth"), F.when(inside, bridge_hops).otherwise(F.col("b") - 1).alias("budget"), U.file_key(F.col("url")).alias("file_key")).where("inside or budget >= 0")
        new = found.join(seen.select("file_key"), "file_key", "left_anti").join(seen.select("url"), "url", "left_anti")
        new = first_per_file(new, [F.col("o"), F.col("pos"), F.col("url")])
        some = new.orderBy(F.col("inside").desc(), "o", "pos", "url")
        if room is None:
            ranked = some.withColumn("ord", F.monotonically_increasing_id())  # partitions are in order, so ids are; they have gaps
        else:
            some = some.limit(room)  # each task keeps its first ``room``, then one merges them
            ranked = some.withColumn("ord", F.row_number().over(Window.orderBy(F.col("inside").desc(), "o", "pos", "url")).cast("long"))
        wave += 1
        new = _cut(ranked.select("url", "depth", "budget", F.lit(wave).alias("wave"), "ord", "file_key"))
        n = new.count()
        if not n:
            break
        count += n
        seen = _cut(seen.unionByName(new))
    return seen.select("url", "depth", "budget", U.in_prefix(F.col("url"), pre).alias("saved"), "wave")


def _every(links: DataFrame) -> Callable[[DataFrame], DataFrame]:
    return lambda front: links


def ladder(targets: DataFrame, raw: DataFrame, twin: DataFrame, page: DataFrame) -> DataFrame:
    """The first of raw Markdown, its ``.md`` twin and the rendered page that has a body. All have url, markdown."""
    a, b, c = (d.select("url", F.col("markdown").alias(n)) for d, n in ((raw, "_raw"), (twin, "_twin"), (page, "_page")))
    got = targets.join(a, "url", "left").join(b, "url", "left").join(c, "url", "left")
    source = F.when(F.col("_raw").isNotNull(), "raw").when(F.col("_twin").isNotNull(), "twin").when(F.col("_page").isNotNull(), "html")
    return got.withColumn("markdown", F.coalesce("_raw", "_twin", "_page")).withColumn("via", source).drop("_raw", "_twin", "_page")


def site_report(pages: DataFrame) -> DataFrame:
    """The acquisition report: per site, the pages that a crawl keeps and their tokens."""
    place = F.col("page_id") if "page_id" in pages.columns else F.lit(0)
    kept = pages.select("url", "html", place.alias("place"), U.path(F.col("url")).alias("path")).where(~F.col("path").rlike(U.LOCALE) & ~F.col("path").rlike(U.ASSET + "$"))
    kept = kept.select("url", "place", F.concat(U.slug(U.authority(F.col("url"))), F.lit("")).alias("slug"), U.file_key(F.col("url")).alias("file_key"), F.floor(F.length("html") / 4).cast("long").alias("tokens"))
    first = kept.groupBy("slug", "file_key").agg(F.min_by("tokens", F.struct("url", "place", "tokens")).alias("tokens"))  # the first URL by name, its first page: no window, so it combines before the shuffle
    return first.groupBy("slug").agg(F.count(F.lit(1)).alias("pages"), F.sum("tokens").alias("raw_tokens"))

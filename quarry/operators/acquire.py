"""An acquisition run: strategy, crawl or index, extraction, pages and index of a store, errors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import html as H
from quarry.functions import urls as U
from quarry.operators import crawl, store
from quarry.sources import sinks, web

PAGE = "url string, title string, markdown string, depth int"
ERROR = "url string, status int, error string"


@dataclass
class Acquired:
    """``pages``: url, title, markdown, depth, file_key, one row a file; ``errors``: url, status, error."""

    strategy: str
    prefix: str
    pages: DataFrame
    errors: DataFrame


def pinned_version(spark: SparkSession, start: str, fetcher: web.Fetcher) -> str | None:
    """The version in ``start``; or, where that has an alias, the one that most links of its page lead to. A failed probe pins none."""
    one = spark.createDataFrame([(start,)], "url string").select(U.concrete_version(F.col("url")).alias("v"), U.version_alias(F.col("url")).alias("a")).first()
    if one["v"] or not one["a"]:
        return one["v"]
    page = fetcher(spark, [start]).where("status = 200 and html is not null")
    best = crawl.dominant_version(crawl.edges(page)).first()
    return best["version"] if best else None


def by_crawl(spark: SparkSession, start: str, fetcher: web.Fetcher, prefix: str | None = None, max_depth: int | None = None, max_pages: int = 200, bridge_hops: int = 1, extra: tuple[str, ...] = (), selectors=H.CONTENT, skip=H.SKIP) -> Acquired:
    """Breadth-first from ``start``, a fetch a wave; what a wave brings is written before the next begins."""
    own = spark.createDataFrame([(start,)], "url string").select(U.scope_prefix(F.col("url")).alias("p"), U.scope_depth(F.col("url")).alias("d")).first()
    version = pinned_version(spark, start, fetcher)
    prefix = f"/{version}/" if version else own["p"] if prefix is None else prefix
    pattern = U.skip_pattern(start, pinned=version is not None, extra=extra)
    got: list[DataFrame] = []
    made: list[DataFrame] = []

    def fetch(urls: list[str]) -> DataFrame:
        pages = crawl._cut(fetcher(spark, urls))
        good = pages.where("html is not null").where(U.is_text_type(F.col("content_type")) & (F.octet_length("html") <= web.MOST_BYTES))
        content = crawl._cut(H.extract(good, selectors, skip))
        got.append(pages)
        made.append(content)
        return content

    def links(front: DataFrame) -> DataFrame:
        urls = [r["url"] for r in front.collect()]  # a wave is bounded by ``max_pages``
        if not urls:
            return spark.createDataFrame([], "src string, pos int, dst string")
        return crawl.edges(fetch(urls).where("hrefs is not null"), pattern, hrefs=F.col("hrefs"))

    reached = crawl._cut(crawl.crawl(links, start, prefix, own["d"] if max_depth is None else max_depth, max_pages, bridge_hops))
    done = _union(spark, [d.select("url") for d in got], "url string")
    rest = [r["url"] for r in reached.select("url").join(done, "url", "left_anti").collect()]  # the last wave
    if rest:
        fetch(rest)
    kept = _union(spark, made, "url string, title string, markdown string, hrefs array<string>, error string").join(reached.where("saved").select("url", "depth"), "url")
    failed = _union(spark, got, "url string, status int, content_type string, html string, error string").where("error is not null").select("url", "status", "error")
    thin = kept.where("error is not null").select("url", F.lit(200).alias("status"), "error")
    return Acquired("http", prefix, _files(kept.where("markdown is not null").select("url", "title", "markdown", "depth")), failed.unionByName(thin))


def by_index(spark: SparkSession, index_url: str, fetcher: web.Fetcher, max_pages: int = 5000, selectors=H.CONTENT, skip=H.SKIP) -> Acquired:
    """The pages that an index lists, each as raw Markdown, by its ``.md`` twin, or extracted from its HTML."""
    index = fetcher(spark, [index_url]).first()
    if index is None or index["status"] != 200 or not index["html"]:
        row = (index_url, index["status"] if index else None, "no index")
        return Acquired("llms-txt", "", spark.createDataFrame([], PAGE + ", file_key string"), spark.createDataFrame([row], ERROR))
    listed = crawl._cut(web.index_links(spark.createDataFrame([(index_url, index["html"])], "base string, body string"), max_pages))
    raw = crawl._cut(listed.withColumn("ask", F.when(F.lower("url").endswith(".md"), F.col("url")).otherwise(F.concat("url", F.lit(".md")))))
    asked = [r["ask"] for r in raw.select("ask").collect()]  # bounded by ``max_pages``
    if not asked:
        return Acquired("llms-txt", "", spark.createDataFrame([], PAGE + ", file_key string"), spark.createDataFrame([(index_url, 200, "no links")], ERROR))
    answers = crawl._cut(fetcher(spark, asked))
    responses = raw.join(answers.withColumnRenamed("url", "ask"), "ask").select(F.col("ask").alias("url"), F.col("url").alias("src_url"), "status", "content_type", F.col("html").alias("body"), F.col("title").alias("hint"))
    text = crawl._cut(web.raw_markdown(responses).where("markdown is not null").select("url", "title", "markdown"))
    rest = [r["url"] for r in raw.join(text, "url", "left_anti").select("url").collect()]
    pages = text.select("url", "title", "markdown", U.depth(F.col("url")).alias("depth"))
    errors = spark.createDataFrame([], ERROR)
    if rest:
        html = crawl._cut(fetcher(spark, rest))
        content = crawl._cut(H.extract(html.where("html is not null"), selectors, skip))
        pages = pages.unionByName(content.where("markdown is not null").select("url", "title", "markdown", U.depth(F.col("url")).alias("depth")))
        errors = html.where("error is not null").select("url", "status", "error").unionByName(content.where("error is not null").select("url", F.lit(200).alias("status"), "error"))
    return Acquired("llms-txt", "", _files(pages), errors)


def _union(spark: SparkSession, frames: list[DataFrame], schema: str) -> DataFrame:
    out = spark.createDataFrame([], schema)
    for df in frames:
        out = out.unionByName(df.select(*out.columns))
    return out


def _files(pages: DataFrame) -> DataFrame:
    """Of the pages that write one file the shallowest, then the least URL."""
    return crawl.first_per_file(pages.withColumn("file_key", U.file_key(F.col("url"))), [F.col("depth"), F.col("url")])


def sorted_pages(pages: DataFrame) -> DataFrame:
    """O1"""
    return pages.orderBy("depth", "file_key")


def detect(spark: SparkSession, start: str, fetcher: web.Fetcher, index_name: str = "llms.txt") -> tuple[str, str]:
    """The strategy, and the index's URL."""
    index = start if start.endswith(index_name) else f"{start.rstrip('/')}/{index_name}"
    asked = fetcher(spark, [index]).select("url", "status", "content_type", F.col("html").alias("body"))
    row = web.strategy(asked).first()
    return (row["strategy"] if row else "http"), index


def run(spark: SparkSession, start: str, root: str, slug: str, fetcher: web.Fetcher, engine: str, fetched: str, strategy: str | None = None, replace: bool = False, **options) -> Acquired:
    """Q16: acquires ``start`` into ``root``/``slug``: pages with frontmatter, INDEX.md, an errors file beside. ``replace`` archives what is there.

    Without pages nothing is written but the errors.
    """
    chosen, index = (strategy, start) if strategy else detect(spark, start, fetcher)
    got = by_index(spark, index, fetcher, **options) if chosen == "llms-txt" else by_crawl(spark, start, fetcher, **options)
    got.pages = crawl._cut(got.pages)
    sinks.write_errors(got.errors, f"{root}/{slug}.errors")
    n = got.pages.count()
    if not n:
        return got
    if replace:
        sinks.archive(root, slug, engine, fetched)
    rows = got.pages.select(F.lit(slug).alias("slug"), F.col("file_key").alias("file"), store.page_document(F.col("title"), F.col("url"), F.col("markdown"), F.lit(engine), F.lit(fetched)).alias("content"))
    listed = got.pages.select(F.struct("depth", "file_key").alias("ord"), "url", "title", F.col("file_key").alias("file"))
    head = f"# {slug}\n\nSource: {start}\nPages: {n}\nEngine: {engine}\nFetched: {fetched}\n\n---\n\n"
    body = store.index_lines(listed).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("section", F.concat("header", F.lit("\n\n"), "entries").alias("t")))), lambda s: s["t"]), "\n\n").alias("t"))
    contents = body.select(F.lit(slug).alias("slug"), F.lit("INDEX.md").alias("file"), F.concat(F.lit(head), "t", F.lit("\n")).alias("content"))
    sinks.write_files(rows.unionByName(contents), root)
    return got

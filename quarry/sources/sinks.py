"""Sinks: one Markdown file a page, an errors file, archives of what is replaced."""

from __future__ import annotations

import os
import re
import shutil
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import markdown as M


def write_files(pages: DataFrame, root: str) -> None:
    """K1, K2: ``content`` at ``root``/``slug``/``file``; ``root`` is shared by the executors. A file is replaced as a whole, so a task that runs again does no harm."""

    def run(batches):
        for b in batches:
            for slug, file, content in zip(*(b.column(c).to_pylist() for c in ("slug", "file", "content")), strict=True):
                path = os.path.join(root, slug, file)
                if not os.path.realpath(path).startswith(os.path.realpath(root) + os.sep):
                    raise ValueError(f"{file} leaves the store")
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(f"{path}.{os.getpid()}.part", "w", encoding="utf-8") as f:
                    f.write(content)
                os.replace(f.name, path)
            yield b.select(["slug"])

    pages.select("slug", "file", "content").mapInArrow(run, "slug string").write.format("noop").mode("overwrite").save()


def write_errors(errors: DataFrame, path: str) -> None:
    """K5: always replaced, so that a clean run leaves none."""
    errors.select("url", "status", "error").write.mode("overwrite").json(path)


def archive(root: str, slug: str, engine: str, stamp: str) -> str | None:
    """Moves a slug's folder to ``.archive``, with a number where that name is taken."""
    at = os.path.join(root, slug)
    if not os.path.isdir(at):
        return None
    os.makedirs(os.path.join(root, ".archive"), exist_ok=True)
    base = to = os.path.join(root, ".archive", f"{slug}@{engine}-{stamp}")
    k = 1
    while os.path.exists(to):
        k, to = k + 1, f"{base}-{k + 1}"
    os.rename(at, to)
    return to


def compact_name(path, level: str):
    """The sibling that a level writes."""
    return F.concat(F.regexp_replace(path, r"\.md$", ""), F.lit({"min": ".min.md", "dense": ".dense.md", "expand": ".expanded.md"}[level]))


def compact_files(spark: SparkSession, root: str, level: str) -> DataFrame:
    """Slug, file, content of the sibling that ``level`` makes of every page below ``root``; feeds ``write_files``.

    Reserved files and those that a level wrote are no input; ``expand`` reads dense and min siblings alone, and writes the name without them.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(root, wholetext=True).select("value", "_metadata.file_path")
    rel = F.regexp_extract("file_path", rf"\Q{root.rstrip('/')}/\E(.*)$", 1)
    made = r"(?i)\.(min|dense)\.md$"
    f = files.select(F.col("value").alias("text"), rel.alias("rel"), F.element_at(F.split(rel, "/"), -1).alias("name")).where(~F.col("name").isin("INDEX.md", "COMPACT.md", "LOOKUP.md"))
    if level == "expand":
        f, name, change = f.where(F.col("name").rlike(made)), F.regexp_replace("rel", made, ".md"), M.expand
    else:
        f, name, change = f.where(~F.col("name").rlike(made)), compact_name(F.col("rel"), level), {"min": M.minify, "dense": M.densify}[level]
    return f.select(F.substring_index("rel", "/", 1).alias("slug"), F.regexp_replace(name, "^[^/]*/", "").alias("file"), change(F.col("text")).alias("content"))


def drifted(spark: SparkSession, root: str) -> DataFrame:
    """Q15's check: rel of the pages that the min level would change."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(root, wholetext=True).select("value", "_metadata.file_path")
    rel = F.regexp_extract("file_path", rf"\Q{root.rstrip('/')}/\E(.*)$", 1)
    f = files.select("value", rel.alias("rel")).where(~F.element_at(F.split("rel", "/"), -1).isin("INDEX.md", "COMPACT.md", "LOOKUP.md") & ~F.col("rel").rlike(r"\.min\.md$"))
    return f.where(M.minify(F.col("value")) != F.col("value")).select("rel")


def prune(root: str, paths: list[tuple[str, str]], really: bool = False) -> list[str]:
    """Deletes (slug, rel) files that a doctor's report calls assets; without ``really`` only names them. Paths out of the store are an error."""
    out = []
    for slug, rel in paths:
        path = os.path.join(root, slug, rel)
        if not os.path.realpath(path).startswith(os.path.realpath(root) + os.sep):
            raise ValueError(f"{rel} leaves the store")
        if os.path.isfile(path):
            out.append(path)
            if really:
                os.remove(path)
    return out


def cleanup(folder: str, names: tuple[str, ...] = ("_raw_html", "_clone")) -> list[str]:
    """Removes what a run keeps between its steps."""
    there = [n for n in names if os.path.isdir(os.path.join(folder, n))]
    for n in there:
        shutil.rmtree(os.path.join(folder, n))
    return there


def report(rows: DataFrame, as_json: bool = False) -> list[str]:
    """A report's lines: JSON, or columns of even width. A report is a row a library, and so bounded."""
    got = rows.collect()
    if as_json:
        import json

        return [json.dumps(r.asDict(recursive=True), default=str, ensure_ascii=False) for r in got]
    cells = [list(rows.columns)] + [["-" if v is None else str(v) for v in r] for r in got]
    width = [max(len(c[k]) for c in cells) for k in range(len(rows.columns))]
    return ["  ".join(v.ljust(w) for v, w in zip(c, width, strict=True)).rstrip() for c in cells]


def engine_version(folder: str) -> str:
    """The VERSION file, else the short commit, else 'unknown'."""
    path = os.path.join(folder, "VERSION")
    if os.path.isfile(path):
        with open(path, encoding="utf-8") as f:
            found = f.read().strip()
        if found:
            return found
    try:
        done = subprocess.run(["git", "-C", folder, "rev-parse", "--short", "HEAD"], capture_output=True, text=True, timeout=10, check=True)
    except (OSError, subprocess.SubprocessError):
        return "unknown"
    return done.stdout.strip() if re.fullmatch(r"[0-9a-f]+", done.stdout.strip()) else "unknown"

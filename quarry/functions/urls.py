"""URL and path functions as native column expressions. Paths are found leniently: any string has one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ALIASES = ("stable", "latest", "main", "master", "dev", "develop", "next")
VERSION = r"v?\d+\.\d+(?:\.\d+)?"
LOCALE = r"/(?!en(?:/|$))[a-z]{2}(?:_[A-Z]{2,4}(?:-[A-Z]{2,4})?)?(?:/|$)"
ASSETS = (
    *("png", "jpg", "jpeg", "gif", "webp", "svg", "ico", "bmp", "tif", "tiff"),
    *("pdf", "doc", "docx", "ppt", "pptx", "xls", "xlsx"),
    *("zip", "tar", "gz", "tgz", "bz2", "xz", "rar", "7z", "dmg", "exe", "bin", "wasm", "apk", "deb", "rpm", "msi"),
    *("woff", "woff2", "ttf", "eot", "otf", "css", "js", "mjs", "map"),
    *("mp4", "mov", "avi", "webm", "mkv", "mp3", "wav", "ogg", "flac"),
)
ASSET = rf"(?i)\.(?:{'|'.join(sorted(ASSETS))})"
_HEAD = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?"


def path(url: Column) -> Column:
    return F.regexp_extract(url, _HEAD + r"(?://[^/?#]*)?([^?#]*)", 1)


def authority(url: Column) -> Column:
    return F.regexp_extract(url, _HEAD + r"//([^/?#]*)", 1)


def segments(url: Column) -> Column:
    """The non-empty segments of the path."""
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def slug(name: Column) -> Column:
    """A store folder's name for a site."""
    bare = F.regexp_replace(F.coalesce(name, F.lit("")), r"^https?://", "")
    safe = F.regexp_replace(F.regexp_replace(bare, r"^/+|/+$", ""), r"[^A-Za-z0-9._-]+", "-")
    return F.coalesce(F.nullif(F.lower(F.regexp_replace(safe, r"^-+|-+$", "")), F.lit("")), F.lit("docs"))


def drop_fragment(url: Column) -> Column:
    """The crawl key; a trailing slash and the query stay."""
    return F.substring_index(url, "#", 1)


def _climb(p: Column) -> Column:
    """Whether a relative path leaves its root at any point."""
    step = lambda acc, s: F.struct((acc["depth"] + F.when(s == "..", -1).when(s.isin("", "."), 0).otherwise(1)).alias("depth"), F.least(acc["low"], acc["depth"] + F.when(s == "..", -1).otherwise(0)).alias("low"))
    return F.aggregate(F.split(p, "/"), F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low")), step)["low"] < 0


def file_key(url: Column) -> Column:
    """The output file of a URL, its identity for deduplication; host and query don't count."""
    p = F.regexp_replace(path(url), r"/+$", "")
    safe = F.regexp_replace(F.when(p == "", "/index").otherwise(p), r"(?U)[^\w/.-]", "_")
    safe = F.regexp_replace(F.when(safe.endswith(".md"), safe).otherwise(F.concat(safe, F.lit(".md"))), r"^/+", "")
    outside = F.contains(safe, F.lit("..")) & _climb(safe)
    return F.when(outside, F.concat(F.lit("_external_"), F.substring(F.sha1(url), 1, 16), F.lit(".md"))).otherwise(safe)


def cache_key(url: Column) -> Column:
    """A readable prefix and a hash of the whole URL."""
    return F.concat(F.substring(F.regexp_replace(url, r"(?U)[^\w]", "_"), 1, 80), F.lit("_"), F.substring(F.sha1(url), 1, 16))


def scope_prefix(url: Column, prefix: Column | None = None) -> Column:
    """The path prefix that a crawl from ``url`` keeps to."""
    p = path(url)
    first = F.substring_index(F.regexp_replace(p, r"^/+", ""), "/", 1)
    parent = F.regexp_extract(p, r"^(.*)/[^/]*$", 1)
    own = F.when(is_leaf(url), F.when(parent == "", "").otherwise(F.concat(parent, F.lit("/")))).when((first == "") | F.contains(first, F.lit(".")), "").otherwise(F.concat(F.lit("/"), first, F.lit("/")))
    return own if prefix is None else F.coalesce(prefix, own)


def scope_depth(url: Column, depth: Column | None = None) -> Column:
    own = F.when(is_leaf(url), 1).otherwise(4)
    return own if depth is None else F.coalesce(depth, own)


def is_leaf(url: Column) -> Column:
    return path(url).rlike(r"(?i)\.(?:html?|php|md|txt)$")


def in_prefix(url: Column, prefix: Column) -> Column:
    """Under the prefix, or its directory without the slash."""
    return (prefix == "") | F.startswith(path(url), prefix) | (path(url) == F.regexp_replace(prefix, "/+$", ""))


def version_alias(url: Column) -> Column:
    """U8: the first alias, in their order, that is a segment of the path."""
    found = F.filter(F.array(*[F.lit(a) for a in ALIASES]), lambda a: F.array_contains(segments(url), a))
    return F.try_element_at(found, F.lit(1))


def concrete_version(url: Column) -> Column:
    """The first segment that is a version number."""
    return F.try_element_at(F.filter(segments(url), lambda s: s.rlike(f"^{VERSION}$")), F.lit(1))


def resolve(base: Column, href: Column) -> Column:
    """``href`` against ``base``, fragment dropped: absolute, scheme-relative, root-relative, query-only and relative forms, dots removed."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    root = F.concat(scheme, F.lit("//"), authority(base))
    folder = F.regexp_replace(path(base), r"[^/]*$", "")
    joined = F.concat(F.when(folder == "", "/").otherwise(folder), href)
    full = (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, href))
        .when(F.startswith(href, F.lit("/")), F.concat(root, _undot(href)))
        .when(F.startswith(href, F.lit("?")), F.concat(root, path(base), href))
        .when(href == "", base)
        .otherwise(F.concat(root, _undot(joined)))
    )
    return drop_fragment(full)


def _undot(ref: Column) -> Column:
    p, rest = F.regexp_extract(ref, r"^([^?#]*)", 1), F.regexp_extract(ref, r"([?#].*)$", 1)
    parts = F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), lambda acc, s: F.when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(acc)).when(s == ".", acc).otherwise(F.concat(acc, F.array(s))))
    return F.when(p.rlike(r"(^|/)\.\.?(/|$)"), F.concat(F.array_join(parts, "/"), F.when(p.rlike(r"/\.\.?$"), "/").otherwise(""), rest)).otherwise(ref)


def followable(href: Column) -> Column:
    """Not empty, a fragment, a mail address or a script."""
    return (href != "") & ~F.startswith(href, F.lit("#")) & ~F.startswith(href, F.lit("mailto:")) & ~F.startswith(href, F.lit("javascript:"))


def section(url: Column) -> Column:
    """The second segment, else the first, else 'root'."""
    s = segments(url)
    return F.when(F.size(s) > 1, F.try_element_at(s, F.lit(2))).when(F.size(s) == 1, F.try_element_at(s, F.lit(1))).otherwise("root")


def title_case(text: Column) -> Column:
    """Upper-case after any non-letter, lower-case after a letter; ``-`` and ``_`` become spaces."""
    words = F.regexp_extract_all(F.translate(text, "-_", "  "), F.lit(r"((?U)\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), "")


def norm_source(url: Column) -> Column:
    """Sources that differ by scheme, ``www.``, case or closing slashes are one."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), r"^https?://(?:www\.)?", ""), r"/+$", "")


def moved(url: Column, to: Column) -> Column:
    """U14"""
    return F.regexp_replace(url, r"/+$", "") != F.regexp_replace(to, r"/+$", "")


def locale_skipped(url: Column) -> Column:
    """a language segment other than ``en``."""
    return path(url).rlike(LOCALE)


def skip_pattern(start: str | None = None, canonical_alias: str | None = None, pinned: bool = False, extra: Sequence[str] = ()) -> str:
    """One alternation of locale, version (unless one is pinned), other aliases, and extra patterns."""
    if canonical_alias is None and start is not None:
        parts = start.split("?")[0].split("#")[0].split("/")[3:]
        canonical_alias = next((a for a in ALIASES if a in parts), None)
    others = [a for a in ALIASES if a != (canonical_alias or "stable")]
    patterns = [LOCALE, *([] if pinned else [rf"/{VERSION}(?:/|$)"]), rf"/(?:{'|'.join(others)})(?:/|$)", *extra]
    return "|".join(f"(?:{p})" for p in patterns)


def skipped(url: Column, pattern: str) -> Column:
    """on the path alone."""
    return path(url).rlike(pattern)


def is_asset(url: Column) -> Column:
    """F7"""
    return path(url).rlike(ASSET + "$")


def is_asset_file(name: Column) -> Column:
    """F8: an asset that was saved as Markdown."""
    return name.rlike(ASSET + r"\.md$")


def is_text_type(content_type: Column) -> Column:
    """Parameters don't count; an unknown type passes."""
    t = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    return (t == "") | F.startswith(t, F.lit("text/")) | F.endswith(t, F.lit("+xml")) | t.isin("application/xhtml+xml", "application/xml", "application/json")


def page_name(rel: Column) -> Column:
    """The parts of a stored path from the third on, else the last, without the suffix."""
    parts = F.split(F.regexp_replace(rel, r"\.md$", ""), "/")
    return F.when(F.size(parts) > 2, F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(1))), "/")).otherwise(F.element_at(parts, -1))


def depth(url: Column) -> Column:
    """U16: slashes beyond those of the host."""
    return F.greatest(F.lit(0), F.length(url) - F.length(F.replace(url, F.lit("/"))) - 3)

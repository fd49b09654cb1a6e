"""URL filters by redirect equivalence: block decisions reach every alias of a page, allow rules first.

Two URLs are aliases if they have one normal form (scheme, ``www.`` or ``m.``, port 80/443, fragment, tracking
parameters, ``.html`` and a trailing slash don't matter), or if a chain of redirects, canonical links and
meta refreshes joins their normal forms in either direction. Components are found by star contraction over
the declared edges alone; a page without one is its own component. Any allowed member allows the
component, else any blocked member blocks it.

Defined results: a null or empty URL has no normal form, takes no part in edges and gets verdict 'none'; null html
declares no edge; of long html all is read; repeated rows are each listed; a null page_id is kept; an empty
table gives no rows; extra columns are ignored; relative targets resolve against the page's URL, whose scheme they take; entities of
``&`` in a target are decoded; of several canonical links or refreshes the first counts; members of a component with several allowed or
blocked ones (ties) have one verdict all the same.

No given page declares an edge, so the query adds those that pagination implies (``paginated``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import urls as U
from quarry.llm._graph import components
from quarry.llm._spark import checkpoint

BLOCK = (r"^spam-farm\.", r"^cheap-pills\.", r"(^|[.-])casino", r"(^|\.)adult[.-]", r"/(login|signin|cart|checkout)(/|$)")
ALLOW = (r"/(about|contact|imprint)(/|$)",)
_TRACKING = r"(?i)([?&])(utm_[a-z]+|ref|fbclid|gclid|sessionid)=[^&#]*"


def normal(url: Column) -> Column:
    """host/path?query of one form for all spellings; null for null, empty or hostless URLs."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    u = F.regexp_replace(u, _TRACKING, "$1")
    u = F.regexp_replace(F.regexp_replace(u, r"[?&]+$", ""), r"([?&])&+", "$1")
    u = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(u, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^(www|m)\.", "")
    rest = F.regexp_extract(u, r"^[^/?]*(.*)$", 1)
    path = F.regexp_replace(F.regexp_extract(rest, r"^([^?]*)", 1), r"(/index)?(\.html?)?/*$", "")
    return F.when(F.length(host) > 0, F.concat(host, path, F.regexp_extract(rest, r"(\?.*)$", 1)))


def declared(pages: DataFrame) -> DataFrame:
    """a, b: normal forms of a page and of what its html names as canonical or refreshes to."""
    html = F.col("html")
    tag = F.regexp_extract(html, r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*>""", 0)
    link = F.when(F.contains(F.lower(html), F.lit("canonical")), F.regexp_extract(tag, r"""(?is)\bhref\s*=\s*["']?([^"'>\s]+)""", 1))
    meta = F.regexp_extract(html, r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*>""", 0)
    refresh = F.when(F.contains(F.lower(html), F.lit("refresh")), F.regexp_extract(meta, r"""(?is)\burl\s*=\s*['"]?([^"'>\s]+)""", 1))
    some = pages.where("url is not null and html is not null").select("url", F.explode(F.array(link, refresh)).alias("to")).where("length(to) > 0")
    to = U.resolve(F.trim("url"), F.regexp_replace("to", r"(?i)&(amp|#38|#x26);", "&"))
    return some.select(normal(F.col("url")).alias("a"), normal(to).alias("b")).where("a is not null and b is not null")


def paginated(pages: DataFrame) -> DataFrame:
    """from, to: each URL with a query and the same without: a further page of a listing leads back to the first."""
    return pages.where(F.contains("url", F.lit("?"))).select(F.col("url").alias("from"), F.regexp_extract("url", r"^([^?#]*)", 1).alias("to"))


def _any(where: Column, rules: Sequence[str]) -> Column:
    return where.rlike("(?i)" + "|".join(f"(?:{r})" for r in rules)) if rules else F.lit(False)


def decide(pages: DataFrame, redirects: DataFrame | None = None, block: Sequence[str] = BLOCK, allow: Sequence[str] = ALLOW) -> DataFrame:
    """page_id, url, canonical (the component's least normal form), verdict (allow, block, none), direct (the page's own verdict).

    ``redirects``: two columns of URLs, from and to. Rules are regular expressions over normal forms.
    """
    edges = declared(pages)
    if redirects is not None:
        a, b = redirects.columns[:2]
        edges = edges.unionByName(redirects.select(normal(F.col(a)).alias("a"), normal(F.col(b)).alias("b")).where("a is not null and b is not null"))
    edges = checkpoint(edges.where("a <> b").distinct())
    group = checkpoint(components(edges))
    known = pages.select("page_id", "url", normal(F.col("url")).alias("node"))
    own = F.when(_any(F.col("node"), allow), 2).when(_any(F.col("node"), block), 1).otherwise(0)
    # members that are no page of the table count as well
    verdicts = group.groupBy("component").agg(F.max(own).alias("whole"))
    reach = group.join(verdicts, "component").select("node", "component", "whole")
    name = lambda c: F.element_at(F.array(F.lit("none"), F.lit("block"), F.lit("allow")), c + 1)
    return known.join(reach, "node", "left").select("page_id", "url", F.coalesce("component", "node").alias("canonical"), name(F.coalesce("whole", own)).alias("verdict"), name(own).alias("direct"))


def _sql_normal(u: str) -> str:
    s = f"regexp_replace(trim({u}), '#.*$', '')"
    s = rf"regexp_replace({s}, '([?&])(utm_[a-zA-Z]+|[rR][eE][fF]|fbclid|gclid|sessionid)=[^&#]*', '\1', 'g')"
    s = rf"regexp_replace(regexp_replace({s}, '[?&]+$', ''), '([?&])&+', '\1', 'g')"
    return rf"regexp_replace({s}, '^[A-Za-z][A-Za-z0-9+.-]*://', '')"


ORACLE = rf"""
WITH RECURSIVE u AS (SELECT page_id, url, {_sql_normal("url")} AS s FROM pages),
h AS (SELECT page_id, url, regexp_replace(regexp_replace(lower(regexp_extract(s, '^([^/?]*)', 1)), ':(80|443)$', ''), '^(www|m)\.', '') AS host,
  regexp_replace(regexp_extract(regexp_extract(s, '^[^/?]*(.*)$', 1), '^([^?]*)', 1), '(/index)?(\.html?)?/*$', '') AS path, regexp_extract(s, '(\?.*)$', 1) AS query FROM u),
n AS (SELECT page_id, url, CASE WHEN length(host) > 0 THEN host || path || query END AS node FROM h),
t AS (SELECT url, regexp_extract(regexp_extract(html, '(?is)<link[^>]*rel\s*=\s*["'']?canonical[^>]*>', 0), '(?is)href\s*=\s*["'']?([^"''>\s]+)', 1) AS dst FROM pages
  UNION ALL SELECT url, regexp_extract(regexp_extract(html, '(?is)<meta[^>]*http-equiv\s*=\s*["'']?refresh[^>]*>', 0), '(?is)url\s*=\s*[''"]?([^"''>\s]+)', 1) FROM pages),
f AS (SELECT url, replace(dst, '&amp;', '&') AS dst, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*:)', 1) AS scheme, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS root,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM t WHERE length(dst) > 0),
g AS (SELECT url, CASE WHEN regexp_matches(dst, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN dst WHEN starts_with(dst, '//') THEN scheme || dst WHEN starts_with(dst, '/') THEN root || dst
  WHEN starts_with(dst, '?') THEN root || path || dst ELSE root || coalesce(nullif(regexp_replace(path, '[^/]*$', ''), ''), '/') || dst END AS dst FROM f
  UNION ALL SELECT url, regexp_extract(url, '^([^?#]*)', 1) FROM pages WHERE contains(url, '?')),
k AS (SELECT url, {_sql_normal("dst")} AS s FROM g),
d AS (SELECT DISTINCT a, b FROM (SELECT n.node AS a, regexp_replace(regexp_replace(lower(regexp_extract(s, '^([^/?]*)', 1)), ':(80|443)$', ''), '^(www|m)\.', '')
  || regexp_replace(regexp_extract(regexp_extract(s, '^[^/?]*(.*)$', 1), '^([^?]*)', 1), '(/index)?(\.html?)?/*$', '') || regexp_extract(s, '(\?.*)$', 1) AS b FROM k JOIN n USING (url)) WHERE a <> b),
e AS (SELECT a, b FROM d UNION SELECT b, a FROM d),
r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a),
own AS (SELECT node, CASE WHEN regexp_matches(lower(node), '/(about|contact|imprint)(/|$)') THEN 2
  WHEN regexp_matches(lower(node), '^spam-farm\.|^cheap-pills\.|(^|[.-])casino|(^|\.)adult[.-]|/(login|signin|cart|checkout)(/|$)') THEN 1 ELSE 0 END AS v FROM (SELECT node FROM n UNION SELECT seen FROM r)),
c AS (SELECT r.node, min(r.seen) AS component, max(own.v) AS whole FROM r JOIN own ON own.node = r.seen GROUP BY r.node)
SELECT page_id, url, coalesce(component, n.node) AS canonical, ['none', 'block', 'allow'][coalesce(whole, v, 0) + 1] AS verdict, ['none', 'block', 'allow'][coalesce(v, 0) + 1] AS direct
FROM n LEFT JOIN own ON own.node = n.node LEFT JOIN c ON c.node = n.node
"""

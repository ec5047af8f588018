"""URL filters over redirect equivalence, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import components

#: Fixed values: (verdict, host, path) of the given rules.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(found, upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def address_of(url: Column) -> Column:
    """Host, path and query without scheme and fragment: the node of a URL; null without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), rest))


def matched(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits; nulls if none does. Equal lengths: allow goes first."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[0] == "allow")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


#: Patterns, case-insensitive, in which ``.`` takes line ends too: comments, tags, a ``rel`` list, an immediate refresh.
_WHITE = r"[ \t\n\f\r]"
COMMENT = r"<!--.*?(?:-->|\z)"
TAG = r"<(?:link|meta)\b[^>]*>"
CANONICAL = rf"(?:^|{_WHITE})canonical(?:{_WHITE}|\z)"
AT_ONCE = rf"""^{_WHITE}*0+(?:\.[0-9]*)?{_WHITE}*[;,]{_WHITE}*(?:url{_WHITE}*={_WHITE}*)?["']?([^"']+)"""
AMPERSAND = r"&(?:amp|#38|#x26);"
SCHEME = r"^[a-z][a-z0-9+.-]*:"


def attribute_pattern(name: str) -> str:
    """Three groups, of which one holds the value: in double quotes, in single quotes, bare."""
    return rf"""[ \t\n\f\r"'/]{name}{_WHITE}*={_WHITE}*(?:"([^"]*)"|'([^']*)'|([^ \t\n\f\r"'>]+))"""


def attribute(tag: Column, name: str) -> Column:
    """The value of the tag's first attribute of that name, ampersands decoded; empty if it has none."""
    value = F.concat(*[F.regexp_extract(tag, "(?is)" + attribute_pattern(name), k) for k in (1, 2, 3)])
    return F.regexp_replace(value, "(?i)" + AMPERSAND, "&")


def without_dots(path: Column) -> Column:
    """The path with its segments ``.`` and ``..`` carried out; never above the host."""
    parts = F.split(F.regexp_replace(path, r"(/\.\.?)\z", "$1/"), "/")
    up = lambda kept: F.when(F.size(kept) > 1, F.slice(kept, 1, F.size(kept) - 1)).otherwise(kept)
    return F.array_join(
        F.aggregate(parts, F.array().cast("array<string>"), lambda kept, x: F.when(x == "..", up(kept)).when(x == ".", kept).otherwise(F.concat(kept, F.array(x)))), "/")


def resolved(target: Column, url: Column) -> Column:
    """Address of a link's target seen from the page's URL: absolute, ``//host``, ``/path``, ``?query`` or relative; null for others."""
    host, path = host_of(url), path_of(url)
    own, rest = F.regexp_extract(target, r"(?s)^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*([^#]*)", 1)
    folder = F.concat(F.regexp_extract(path, r"(?s)^(.*)/", 1), F.lit("/"))
    scheme = target.rlike("(?i)" + SCHEME)
    return (
        F.when(target.startswith("//"), address_of(F.concat(F.lit("x:"), target)))
        .when(scheme & target.rlike("(?i)" + SCHEME + "//"), address_of(target))
        .when(scheme | (target == "") | target.startswith("#"), F.lit(None))
        .when(target.startswith("/"), F.concat(host, without_dots(own), rest))
        .when(target.startswith("?"), F.concat(host, path, rest))
        .otherwise(F.concat(host, without_dots(F.concat(folder, own)), rest)))


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(left, right) addresses joined by a canonical link or an immediate refresh in the page.

    ``rel`` may list other words too; a refresh counts if its delay is below a
    second. Tags in comments don't count. Targets are resolved against the
    page's URL (a ``base`` tag is not read); of character references only
    those of the ampersand are decoded. Null pages and null or plain URLs
    without ``://`` give no edge. Pages without such a tag are cut before any
    pattern runs.
    """
    low = F.lower(F.col(html))
    shown = F.regexp_replace(F.col(html), "(?is)" + COMMENT, "")
    tag = F.col("tag")
    to = (
        F.when(tag.rlike("(?i)^<link") & attribute(tag, "rel").rlike("(?is)" + CANONICAL), attribute(tag, "href"))
        .when(tag.rlike("(?i)^<meta") & (F.lower(F.trim(attribute(tag, "http-equiv"))) == "refresh"), F.regexp_extract(attribute(tag, "content"), "(?is)" + AT_ONCE, 1)))
    return (
        pages.filter((low.contains("canonical") | low.contains("http-equiv")) & F.col(url).contains("://"))
        .select(F.col(url).alias("url"), F.explode(F.regexp_extract_all(shown, F.lit("(?is)" + TAG), F.lit(0))).alias("tag"))
        .select("url", F.trim(F.regexp_replace(to, r"[\t\n\f\r]", "")).alias("target"))
        .select(address_of(F.col("url")).alias("left"), resolved(F.col("target"), F.col("url")).alias("right"))
        .filter("left is not null and right is not null")
    )


def judged(pages: DataFrame, rules=RULES, edges: DataFrame | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Verdict of every page: its own longest rule, else what its aliases say, else allow.

    Aliases are addresses connected by redirects: canonical links and refresh
    tags of the pages, and ``edges`` (left, right addresses) if given. In a
    class of aliases an explicit allow goes before any block. A null URL or one
    without ``://`` has empty host and path and stands alone. Repeated rows and
    repeated URLs each keep their row; no page: no row.
    """
    links = link_edges(pages, url, html)
    if edges is not None:
        links = links.union(edges.select("left", "right"))
    nodes = components(links, "left", "right").withColumnsRenamed({"node": "__node", "root": "__root"})
    full = F.concat(F.lit("x://"), F.col("__node"))
    _, own = matched(host_of(full), path_of(full), rules)
    classes = (
        nodes.withColumn("__own", own)
        .groupBy("__root")
        .agg(F.max(F.col("__own") == "allow").alias("__allow"), F.max(F.col("__own") == "block").alias("__block"))
    )
    blocked = nodes.join(classes.filter("__block and not __allow"), "__root").select("__node", F.lit("block").alias("__alias"))
    rows = pages.select(
        F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"),
        # rows without an address get keys of their own, else they would meet in one task
        F.coalesce(address_of(F.col(url)), F.concat(F.lit("\u0000"), F.coalesce(F.col(page_id).cast("string"), F.lit("")))).alias("__node"))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    return (
        rows.join(blocked, "__node", "left")
        .select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("__alias"), F.lit("allow")).alias("verdict"))
    )

"""URL rules, and block decisions that follow redirects and canonical links.

All of it is DataFrame expressions and joins. A rule is a host and a path; it
fits its host and all subdomains where the url's path starts with its own. The
longest fitting rule decides. Pages without a rule take the decision of their
aliases: urls joined by redirects and canonical links form components, found by
distributed connected components, and one blocked url blocks its component.
An explicit allow of a page comes before that.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingflow.operators.graph import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """verdict `allow` or `block` for a host, its subdomains and a path prefix."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty for null or without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", ""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def fitting_rule(rules: list[Rule], host: Column, path: Column) -> Column:
    """The longest rule that fits, as struct(name, verdict), else null.

    The list is a parameter and becomes one expression; at equal length the
    longer host, then the name decides.
    """
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), len(r.host), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def node(url: Column) -> Column:
    """The name under which a url takes part in the graph: no scheme, no fragment."""
    bare = F.regexp_replace(F.regexp_replace(url, r"(?s)#.*$", ""), r"(?s)^.*?://", "")
    host = F.translate(F.regexp_extract(bare, r"(?s)^[^/?]*", 0), UPPER, LOWER)
    rest = F.regexp_replace(bare, r"(?s)^[^/?]*", "")
    return F.when(F.instr(url, "://") > 0, F.concat(host, F.when(rest == "", "/").otherwise(rest)))


def absolute(links: DataFrame) -> DataFrame:
    """(url, target) with every target resolved against the url of its page."""
    parts = links.select(
        "url",
        F.regexp_replace(F.trim("target"), "&amp;", "&").alias("h"),
        F.regexp_extract("url", r"(?s)^.*?://[^/?#]*", 0).alias("site"),
        F.regexp_extract("url", r"(?s)^[^?#]*", 0).alias("page"),
    )
    h, site, page = F.col("h"), F.col("site"), F.col("page")
    folder = F.when(page == site, F.concat(site, F.lit("/"))).otherwise(F.regexp_replace(page, "[^/]*$", ""))
    target = (
        F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), h)
        .when(h.startswith("//"), F.concat(F.substring_index(site, "//", 1), h))
        .when(h.startswith("/"), F.concat(site, h))
        .when((h == "") | h.startswith("#"), F.col("url"))
        .when(h.startswith("?"), F.concat(page, h))
        .otherwise(F.concat(folder, h))
    )
    return parts.select("url", target.alias("target"))


_TAGS = r"(?is)<(?:link|meta)\b[^>]*>"
_CANONICAL = r"(?i)\brel\s*=\s*[\"']?\s*canonical\b"
_REFRESH = r"(?i)\bhttp-equiv\s*=\s*[\"']?\s*refresh\b"


def page_links(pages: DataFrame) -> DataFrame:
    """(url, target) from canonical links and meta refreshes in whole pages.

    A page's html is only taken apart if it names one of the two.
    """
    some = pages.where("url is not null and html is not null").where(F.col("html").rlike(r"(?i)canonical|http-equiv"))
    tags = some.select("url", F.explode(F.regexp_extract_all("html", F.lit(_TAGS), F.lit(0))).alias("tag"))
    value = lambda attr: F.regexp_replace(F.regexp_extract("tag", rf"(?is)\b{attr}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1), "^[\"']|[\"']$", "")
    jump = F.regexp_extract(value("content"), r"(?is)\burl\s*=\s*[\"']?([^\"']+)", 1)
    target = F.when(F.col("tag").rlike(_CANONICAL), value("href")).when(F.col("tag").rlike(_REFRESH), jump)
    found = tags.select("url", target.alias("target")).distinct().where("target <> ''")
    return absolute(found)


def judged(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, via) for every row of pages.

    redirects is an optional (url, target) table, added to the links the pages
    carry. A page without a rule is blocked if any url of its component has a
    block rule, be it a page of the table or only the target of a link; `via`
    is then the component's least url. A null url or one without `://` is in no
    component and allowed. Repeated rows are judged each; a page_id may be null,
    urls and pages of any length. An empty table gives no rows, and columns
    besides page_id, url and html play no part.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), path.alias("path"), node(F.col("url")).alias("node"))
    rows = rows.withColumn("rule", fitting_rule(rules, F.col("host"), F.col("path")))
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select("url", "target"))
    edges = links.select(node(F.col("url")).alias("a"), node(F.col("target")).alias("b"))
    comp = connected_components(edges)
    url = F.concat(F.lit("x://"), F.col("node"))
    blocks = fitting_rule(rules, *host_and_path(url))["verdict"] == "block"
    bad = comp.where(blocks).select("root").distinct()
    aliases = comp.join(bad, "root").select("node", F.col("root").alias("via")).distinct()
    # Pages without a node would all meet in one task of the join.
    out = rows.where("node is not null").join(aliases, "node", "left")
    out = out.unionByName(rows.where("node is null").withColumn("via", F.lit(None).cast("string")))
    free = F.col("rule").isNull()
    verdict = F.when(~free, F.col("rule.verdict")).when(F.col("via").isNotNull(), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("rule.name").alias("rule"), verdict.alias("verdict"), F.when(free, F.col("via")).alias("via"))

"""Block decisions for URLs that carry over to their aliases.

Redirects and canonical links make URLs equivalent. A rule decides for the URLs that it
fits. Those that no rule fits take the decision of their class: allow if the class has an
allowed URL, else block if it has a blocked one, else allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellshift.llm.components import components
from cellshift.llm.shared import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Parameters that name where a visitor came from, not what is shown.
TRACKING = r"(?:utm_[a-z]+|ref|gclid|fbclid)=[^&#]*"
CANONICAL = r"""(?i)<link\s[^>]*?rel\s*=\s*["']?canonical["']?[^>]*>"""
# Of a target that is not relative.
SCHEME = "[A-Za-z][A-Za-z0-9+.-]*:"
REFRESH = r"""(?i)<meta\s[^>]*?http-equiv\s*=\s*["']?refresh["']?[^>]*>"""


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def normal_form(url: Column) -> Column:
    """host/path?query that a server redirects the URL to.

    The scheme, the fragment, tracking parameters and slashes at the path's end go. Null
    if there is no host.
    """
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(query, f"(?:^|(?<=&)){TRACKING}(?:&|$)", "")
    query = F.regexp_replace(query, "&$", "")
    host = host_of(url)
    return F.when(
        host != "",
        F.concat(
            host,
            F.regexp_replace(path_of(url), "/+$", ""),
            F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)),
        ),
    )


def declared_target(url: Column, html: Column) -> Column:
    """array<string>: where the page says it lives or sends its visitors, made absolute."""
    link = F.regexp_extract(F.regexp_extract(html, CANONICAL, 0), r"""(?i)href\s*=\s*["']?([^"'\s>]+)""", 1)
    sent = F.regexp_extract(F.regexp_extract(html, REFRESH, 0), r"""(?i)url\s*=\s*["']?([^"'\s>]+)""", 1)
    base = F.regexp_extract(url, r"^(.*?://[^/?#]*)", 1)
    folder = F.concat(F.lit("/"), F.regexp_extract(path_of(url), r"(?s)^/(.*/)", 1))

    def absolute(target):
        return (
            F.when(target == "", None)
            .when(target.rlike(f"^{SCHEME}//"), target)
            .when(target.rlike(f"^{SCHEME}"), None)
            .when(F.startswith(target, F.lit("//")), F.concat(F.regexp_extract(url, r"^(.*?:)//", 1), target))
            .when(F.startswith(target, F.lit("/")), F.concat(base, without_dots(target)))
            .when(F.startswith(target, F.lit("?")), F.concat(base, path_of(url), target))
            .when(F.startswith(target, F.lit("#")), url)
            .otherwise(F.concat(base, without_dots(F.concat(folder, target))))
        )

    return F.array_compact(F.array(absolute(link), absolute(sent)))


def without_dots(target: Column) -> Column:
    """A target that starts with a slash, its path without the segments . and .."""
    parts = F.split(F.regexp_extract(target, r"(?s)^/([^?#]*)", 1), "/")
    went = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda so_far, x: F.when(x == "..", F.slice(so_far, F.lit(1), F.greatest(F.size(so_far) - 1, F.lit(0))))
        .when(x == ".", so_far)
        .otherwise(F.array_append(so_far, x)),
    )
    # A folder keeps its slash.
    went = F.when(F.element_at(parts, -1).isin(".", ".."), F.array_append(went, F.lit(""))).otherwise(went)
    return F.concat(F.lit("/"), F.array_join(went, "/"), F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1))


def declared_links(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """URLs (source, target) of canonical links, refreshes and given redirects."""
    said = pages.select(
        F.col("url").alias("source"), F.explode(declared_target(F.col("url"), F.col("html"))).alias("target")
    )
    if redirects is not None:
        said = said.union(redirects.select("source", "target"))
    known = normal_form(F.col("source")).isNotNull() & normal_form(F.col("target")).isNotNull()
    return said.where(known).distinct()


def aliases(links: DataFrame) -> DataFrame:
    """Edges (a, b) between the normal forms of links (source, target).

    Two URLs with one normal form are aliases already, as they are one node.
    """
    ends = links.select(normal_form(F.col("source")).alias("a"), normal_form(F.col("target")).alias("b"))
    return ends.where("a <> b").distinct()


def matched_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, rule, decision) of the longest fitting rule for those of `urls` with one.

    rules: (rule, decision), rule as host/path. Each URL asks for the suffixes of its
    host at the dots, so any number of rules is one join on equal keys. `urls` is distinct.
    """
    parts = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")
    )
    asked = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    asked = asked.select("url", "path", F.explode(suffixes).alias("at"))
    known = rules.select(
        F.substring_index("rule", "/", 1).alias("at"),
        F.expr("substring(rule, instr(rule, '/'))").alias("under"),
        "rule",
        "decision",
    )
    fits = asked.join(known, "at").where(F.startswith("path", F.col("under")))
    best = F.max(F.struct(F.char_length("rule"), "rule", "decision")).alias("best")
    return fits.groupBy("url").agg(best).select("url", "best.rule", "best.decision")


def judge_pages(pages: DataFrame, rules: list[tuple[str, str]], redirects: DataFrame | None = None,
                default: str = "allow") -> DataFrame:
    """Per row of pages (page_id, url, html): (page_id, url, host, path, rule, verdict).

    Targets of links and redirects count in their class like pages, also those not in `pages`.
    Null URLs and those without :// have empty host and path, fit no rule and get the
    default. Equal URLs get equal verdicts. Null HTML declares nothing.
    """
    spark = pages.sparkSession
    given = spark.createDataFrame(rules, "rule string, decision string")
    links = materialise(declared_links(pages, redirects))
    # Rules decide for both ends of a link too, whether or not they are pages.
    urls = pages.select("url").union(links.select("source")).union(links.select("target"))
    urls = urls.where("url IS NOT NULL").distinct()
    ruled = materialise(matched_rules(urls, given))
    roots = components(aliases(links))
    nodes = urls.select("url", normal_form(F.col("url")).alias("node")).join(roots, "node", "left")
    nodes = nodes.select("url", F.coalesce("root", "node").alias("class"))
    nodes = nodes.join(ruled, "url", "left")
    told = (
        nodes.where("decision IS NOT NULL AND class IS NOT NULL")
        .groupBy("class")
        .agg(F.min("decision").alias("inherited"))  # allow comes before block
    )
    verdicts = nodes.join(told, "class", "left").select(
        F.col("url").alias("u"), "rule", F.coalesce("decision", "inherited", F.lit(default)).alias("verdict")
    )
    return pages.select("page_id", "url").join(verdicts, F.col("url") == F.col("u"), "left").select(
        "page_id",
        "url",
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
        "rule",
        F.coalesce("verdict", F.lit(default)).alias("verdict"),
    )

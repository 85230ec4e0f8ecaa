"""URL filters whose decisions reach aliases: connected components over redirects and canonical links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwise.llm.components import components
from cellwise.llm.store import keep

Rule = tuple[str, str, str]
#: Fixed value: elements whose content is text or no part of the page.
NO_MARKUP = ("script", "style", "template", "textarea", "title", "noembed", "xmp", "iframe")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def with_parts(rows: DataFrame, url: str, *names: str) -> DataFrame:
    """Add host, path and node of the column ``url``, under those names.

    The node is the url in the alias graph: scheme and host in lower case, no fragment, null if it has no ``://``; host and path are empty then. The url is taken
    apart once, behind a step of its own, as generated code would else do it again for each of the three in each of their branches.
    """
    host, path, node = names
    parts = F.array(F.struct(
        F.translate(F.substring_index(url, "://", 1), UPPER, LOWER).alias("scheme"),
        F.regexp_extract(after_scheme(F.col(url)), r"^([^/?#]*)", 1).alias("host"),
        F.regexp_extract(after_scheme(F.col(url)), r"^[^/?#]*([^#]*)", 1).alias("rest"),
    ))
    split = rows.withColumn("_parts", F.explode(parts))
    lower = F.coalesce(F.translate("_parts.host", UPPER, LOWER), F.lit(""))
    split = split.withColumns({host: lower, path: F.coalesce(F.substring_index("_parts.rest", "?", 1), F.lit(""))})
    whole = F.concat(F.col("_parts.scheme"), F.lit("://"), F.col(host), F.when(F.col("_parts.rest") == "", "/").otherwise(F.col("_parts.rest")))
    return split.withColumn(node, F.when(F.instr(url, "://") > 0, whole)).drop("_parts")


def page_links(pages: DataFrame) -> DataFrame:
    """Edges (a, b) from a page's url to the targets of its canonical links and of its refresh redirects.

    Tags within comments, scripts, styles, templates and other text that is no markup don't count; of several tags each does. ``rel`` may hold further
    words, and of repeated attributes the first counts. Targets may be absolute, from the scheme, from the root or from the page's folder. Pages are
    read whole, however long.
    """
    bare = F.regexp_replace(F.coalesce("html", F.lit("")), rf"(?is)<!--.*?(?:-->|\z)|<({'|'.join(NO_MARKUP)})\b[^>]*>.*?(?:</\1\s*>|\z)", "")
    found = F.regexp_extract_all(bare, F.lit(r"""(?is)<(?:link|meta)(?=[\s/])(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""), F.lit(0))
    tags = pages.where("instr(url, '://') > 0").select("url", F.explode(found).alias("tag"))
    # each step behind the last one's explode: all attributes of a tag, then those that are wanted without their quotes
    name = lambda group: F.regexp_extract_all("tag", F.lit(r"""(?is)([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?"""), F.lit(group))
    read = tags.select("url", F.explode(F.array(F.struct(F.transform(name(1), F.lower).alias("names"), name(2).alias("values")))).alias("a")).select("url", "a.*")
    value = lambda wanted: F.regexp_replace(F.coalesce(F.get("values", F.array_position("names", F.lit(wanted)).cast("int") - 1), F.lit("")), r"""^["']|["']$""", "")
    read = read.where(F.array_contains("names", "rel") | F.array_contains("names", "http-equiv"))
    read = read.select("url", F.explode(F.array(F.struct(F.get("names", F.lit(0)).alias("tag"), *[value(v).alias(c) for v, c in (("rel", "rel"), ("http-equiv", "equiv"), ("href", "href"), ("content", "content"))]))).alias("a")).select("url", "a.*")
    canonical = (F.col("tag") == "<link") & F.array_contains(F.split(F.lower("rel"), r"\s+"), "canonical")
    refresh = (F.col("tag") == "<meta") & (F.lower(F.trim("equiv")) == "refresh")
    targets = read.select("url", F.explode(F.array(F.when(canonical, F.col("href")).when(refresh, F.regexp_extract("content", r"""(?is)url\s*=\s*["']?([^"']*)""", 1)).otherwise(""))).alias("target"))
    targets = targets.select("url", F.regexp_replace(F.trim("target"), "(?i)&amp;", "&").alias("target")).where("target <> ''")
    split = with_parts(targets, "url", "host", "path", "a")
    target, base = F.col("target"), F.concat(F.substring_index("url", "://", 1), F.lit("://"), F.col("host"))
    folder = F.regexp_replace("path", "[^/]*$", "")
    full = (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), target)
        .when(target.startswith("//"), F.concat(F.substring_index("url", "://", 1), F.lit(":"), target))
        .when(target.startswith("/"), F.concat(base, target))
        .otherwise(F.concat(base, F.when(folder == "", "/").otherwise(folder), target))
    )
    ends = with_parts(split.select("a", F.explode(F.array(full)).alias("full")), "full", "host", "path", "b")
    return ends.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows (host, fits): for each different host the rules for it or a domain above, longest first."""
    labels = F.split("host", r"\.")
    above = hosts.where("host <> ''").distinct().withColumn(
        "domain", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    )
    fits = above.join(rules.withColumnRenamed("host", "domain"), "domain")
    longest = F.sort_array(F.collect_list(F.struct(F.length("rule").alias("size"), "rule", "path", "verdict")), asc=False)
    return fits.groupBy("host").agg(longest.alias("fits"))


def ruled(rows: DataFrame, fits: DataFrame) -> DataFrame:
    """Add ``rule`` and ``ruling`` to rows with host and path: of the rules that fit the longest, or null."""
    joined = rows.join(fits, "host", "left")
    best = F.get(F.filter("fits", lambda r: F.col("path").startswith(r["path"])), F.lit(0))
    return joined.withColumns({"rule": best["rule"], "ruling": best["verdict"]}).drop("fits")


def judge(pages: DataFrame, rules: Sequence[Rule] | DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, url), one per row of ``pages(page_id, url, html)``.

    ``rules`` are (host, path, verdict): one fits its host and all subdomains if the url's path begins with the rule's, and the longest
    wins. A url that no rule fits takes the decision of its component, whose nodes are urls without fragment, and whose
    edges are ``links(a, b)`` (urls: a redirect's source and target) and the pages' own canonical links and refresh redirects:
    allow if a rule allows any of its nodes, else block if a rule blocks one, else allow. A null url or one without ``://`` has
    an empty host and path and is allowed. Repeated rows are judged alike; other columns are ignored; pages of any length are read whole; an empty table gives an
    empty result.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "host string, path string, verdict string")
    rules = rules.select("host", "path", "verdict", F.concat("host", "path").alias("rule"))
    rows = with_parts(pages.select(F.col("page_id").cast("long"), "url"), "url", "host", "path", "node")
    edges = page_links(pages)
    if links is not None:
        given = with_parts(links.select("a", "b"), "a", "host", "path", "from").select("from", "b")
        edges = edges.unionByName(with_parts(given, "b", "host", "path", "to").select(F.col("from").alias("a"), F.col("to").alias("b")))
    roots = components(edges)
    ends = with_parts(roots.select("id", "root"), "id", "host", "path", "node").select(F.col("id").alias("node"), "root", "host", "path")
    fits = keep(host_rules(rows.select("host").unionByName(ends.select("host")), rules), "rules")
    decided = ruled(ends, fits)
    by_root = decided.groupBy("root").agg(F.bool_or(F.col("ruling") == "allow").alias("allow"), F.bool_or(F.col("ruling") == "block").alias("block"))
    passed_on = decided.join(by_root, "root").where("block AND NOT coalesce(allow, false)").select("node", F.lit("block").alias("from_aliases"))
    out = ruled(rows, fits).join(passed_on, "node", "left")
    verdict = F.coalesce("ruling", "from_aliases", F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "url")

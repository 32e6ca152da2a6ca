"""Link extraction, normalisation, reputation and obfuscation checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..session import materialize
from ..functions.patterns import java

# fixed values: link shapes and URL parts
URL_PATTERN = r"(?:\[[^\]]*\]\((?P<markdown_link>[^\s\)]+)\))|(?:\<(?P<angle_link>[^\s>]+)\>)|(?P<plain_link>https?://[^\s\'\"\]\)\<]+)"
URL_PARTS = r"^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)"
BRACKETED_HOST = r"^[^\[\]]*\[[0-9A-Fa-f:.]+\](:\d*)?$"
NETLOC_SCHEMES = ["ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file", "mms", "https", "shttp", "snews", "prospero", "rtsp", "rtsps", "rtspu", "rsync", "svn", "svn+ssh", "sftp", "nfs", "git", "git+ssh", "ws", "wss", "itms-services"]
RISKY_SCHEMES = ["javascript", "data", "vbscript"]
PAYLOAD_MARKS = [".exe", ".bat", ".sh", ".js"]


def extract_urls(text: Column) -> Column:
    """Distinct link targets in order of first appearance."""
    regex = F.lit(java(URL_PATTERN, "i"))
    groups = [F.regexp_extract_all(text, regex, F.lit(i)) for i in (1, 2, 3)]
    zipped = F.arrays_zip(*[g.alias(n) for g, n in zip(groups, "abc")])
    first = F.transform(zipped, lambda z: F.coalesce(F.nullif(z["a"], F.lit("")), F.nullif(z["b"], F.lit("")), z["c"]))
    return F.array_distinct(first)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, URL_PARTS, 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, URL_PARTS, 2)


def path(url: Column) -> Column:
    """Path without ``;params`` of the last segment."""
    return F.regexp_replace(F.regexp_extract(url, URL_PARTS, 3), r";[^/]*$", "")


def is_malformed(url: Column) -> Column:
    host = netloc(url)
    return host.rlike(r"[\[\]]") & ~host.rlike(BRACKETED_HOST)


def hostname(url: Column) -> Column:
    host = F.lower(F.substring_index(netloc(url), "@", -1))
    return F.when(host.rlike(r"^\["), F.regexp_extract(host, r"^\[([^\]]*)\]", 1)).otherwise(F.substring_index(host, ":", 1))


def normalize(url: Column) -> Column:
    """Lower-case scheme and authority, keep the path, drop params, query and fragment; null when malformed."""
    s, n, p = scheme(url), F.lower(netloc(url)), path(url)
    body = (
        F.when(n != "", F.concat(F.lit("//"), n, F.when((p != "") & ~F.startswith(p, F.lit("/")), F.concat(F.lit("/"), p)).otherwise(p)))
        .when(F.startswith(p, F.lit("//")) | (s.isin(*NETLOC_SCHEMES) & ((p == "") | F.startswith(p, F.lit("/")))), F.concat(F.lit("//"), p))
        .otherwise(p)
    )
    return F.when(~is_malformed(url), F.when(s != "", F.concat(s, F.lit(":"), body)).otherwise(body))


def reputation(url: Column) -> Column:
    """bad / good by authority; null without an authority; error_parsing_url when malformed."""
    host = F.lower(netloc(url))
    return (
        F.when(is_malformed(url), F.lit("error_parsing_url"))
        .when(F.endswith(host, F.lit(".ru")) | host.isin(*R.BAD_DOMAINS), F.lit("bad"))
        .when(host != "", F.lit("good"))
    )


def obfuscation_reasons(url: Column) -> Column:
    """Why a URL counts as obfuscated; empty when it does not."""
    host, p = hostname(url), path(url)
    checks = {
        "malformed": is_malformed(url),
        "risky_scheme": scheme(url).isin(*RISKY_SCHEMES),
        "percent_encoding": F.regexp_count(F.concat(p, host), F.lit("%[0-9a-fA-F]{2}")) > 5,
        "unicode_escape": url.rlike(r"\\u[0-9a-fA-F]{4}"),
        # longer digit strings are larger numbers, so no cast can overflow
        "decimal_host": host.rlike("^[0-9]+$") & (F.lpad(F.regexp_replace(host, "^0+", ""), 2100, "0") > F.lpad(F.lit("65535"), 2100, "0")),
        "many_dots": F.regexp_count(host, F.lit(r"\.")) > 7,
        "punycode": F.contains(host, F.lit("xn--")),
        "at_in_path": F.contains(p, F.lit("@")),
        "payload_extension": F.lower(url).rlike(r"\.exe|\.bat|\.sh|\.js"),
        "brackets_in_authority": netloc(url).rlike(r"[\[\](){}]"),
        "very_long": F.length(url) > 2000,
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))


def redirect_hops(url: Column) -> Column:
    """Stand-in chain when no redirect table exists: URLs naming a redirect end at a fixed target."""
    return F.when(F.contains(url, F.lit("redirect")), F.array(url, F.lit("https://final.destination.com"))).otherwise(F.array(url))


def link_table(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per distinct link of a document with every check."""
    urls = df.select(*keep, F.posexplode(extract_urls(F.col(text))).alias("position", "url"))
    u = F.col("url")
    reasons = obfuscation_reasons(u)
    return urls.select(
        *keep,
        "position",
        "url",
        F.coalesce(normalize(u), u).alias("normalized_url"),
        reputation(u).alias("reputation"),
        F.when(is_malformed(u), F.array(u, F.lit("error_parsing_url"))).otherwise(redirect_hops(normalize(u))).alias("redirect_chain"),
        (F.size(reasons) > 0).alias("is_obfuscated"),
        reasons.alias("reasons"),
    )


def link_report(links: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Per document: urls, normalised urls, reputation and redirect maps, obfuscated urls.

    A group holds one document's distinct links, so its size is bounded by the document.
    """
    row = F.struct("position", "url", "normalized_url", "reputation", "redirect_chain", "is_obfuscated")
    grouped = links.groupBy(*keep).agg(F.array_sort(F.collect_list(row)).alias("_l"))
    items = F.col("_l")
    first_by_target = F.filter(
        items, lambda x: F.array_position(F.transform(items, lambda y: y["normalized_url"]), x["normalized_url"]) == F.array_position(F.transform(items, lambda y: y["position"]), x["position"])
    )
    rated = F.filter(first_by_target, lambda x: x["reputation"].isNotNull())
    return grouped.select(
        *keep,
        F.transform(items, lambda x: x["url"]).alias("urls"),
        F.transform(items, lambda x: x["normalized_url"]).alias("normalized_urls"),
        F.map_from_entries(F.transform(rated, lambda x: F.struct(x["normalized_url"], x["reputation"]))).alias("domain_reputation"),
        F.map_from_entries(F.transform(first_by_target, lambda x: F.struct(x["normalized_url"], x["redirect_chain"]))).alias("redirect_chains"),
        F.transform(F.filter(items, lambda x: x["is_obfuscated"]), lambda x: x["url"]).alias("obfuscated_urls"),
    )


def follow_redirects(urls: DataFrame, redirects: DataFrame, prefer: str | None = None) -> DataFrame:
    """Longest chain of hops per URL over a redirects(src, dst) table that shows no URL twice.

    Of equally long ones, the one counts whose redirect has the larger value of
    the column ``prefer`` where they part, and without it the smallest.

    A source with one target keeps the chain behind it, which doubles in a
    round: it is joined with the chain of its own last URL. The rounds are as
    many as the longest chain has binary digits, each one equi-join on a
    written table. A chain that shows a URL twice is a loop and is cut there.
    Sources with several targets are forks: chains end there, and walks that
    reach one go on with the chain of every target, one fork a round. Null
    targets are none.
    """
    empty = F.array().cast("array<string>")
    value = F.col(prefer).cast("double") if prefer else F.lit(0.0)
    hops = redirects.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").groupBy("src", "dst").agg((-F.max(value)).alias("_later"))
    targets = hops.groupBy("src").agg(F.min("dst").alias("dst"), F.count("*").alias("_n"))
    single = targets.where("_n = 1")
    chains = materialize(single.select(F.col("src").alias("node"), F.array("dst").alias("chain"), F.lit(False).alias("done")), "redirects")
    while not chains.where("NOT done").isEmpty():
        ahead = chains.select(F.col("node").alias("_at"), F.col("chain").alias("_next"), F.col("done").alias("_done"))
        open_ = chains.where("NOT done").join(ahead, F.element_at("chain", -1) == F.col("_at"), "left")
        walk = open_.select("node", "_done", F.col("_at").isNull().alias("_ends"), F.concat(F.array("node"), "chain", F.coalesce("_next", empty)).alias("_walk"))
        told = walk.withColumn("_once", F.array_distinct("_walk"))
        seen_twice = F.size("_once") < F.size("_walk")
        grown = told.select("node", F.slice("_once", F.lit(2), F.size("_once") - 1).alias("chain"), (F.col("_ends") | seen_twice | F.coalesce("_done", F.lit(True))).alias("done"))
        chains = materialize(grown.unionByName(chains.where("done")), "redirects")
    behind = chains.select("node", F.col("chain").alias("_behind"))
    out = urls.join(behind, F.col("url") == F.col("node"), "left").select("url", F.concat(F.array("url"), F.coalesce("_behind", empty)).alias("chain"))
    forks = targets.where("_n > 1").select(F.col("src").alias("_fork"))
    if forks.isEmpty():
        return out
    targets_behind = hops.join(forks, F.col("src") == F.col("_fork"), "left_semi").join(behind, F.col("dst") == F.col("node"), "left")
    steps = targets_behind.select(F.col("src").alias("_at"), "_later", F.concat(F.array("dst"), F.coalesce("_behind", empty)).alias("_next"))
    open_, ended = out.join(forks, F.element_at("chain", -1) == F.col("_fork"), "left_semi").distinct().withColumn("order", F.array().cast("array<double>")), []
    while not open_.isEmpty():
        walk = open_.join(steps, F.element_at("chain", -1) == F.col("_at")).select("url", F.array_append("order", F.col("_later")).alias("order"), F.concat("chain", "_next").alias("_walk"))
        told = walk.select("url", "order", F.array_distinct("_walk").alias("chain"), (F.size(F.array_distinct("_walk")) < F.size("_walk")).alias("_loop"))
        walks = told.join(forks, F.element_at("chain", -1) == F.col("_fork"), "left").select("url", "order", "chain", (F.col("_loop") | F.col("_fork").isNull()).alias("done"))
        walks = materialize(walks, "redirect-walks")
        open_ = walks.where("NOT done").drop("done")
        ended.append(walks.where("done").drop("done"))
    if not ended:
        return out
    longest = reduce(DataFrame.unionByName, ended).groupBy(F.col("url").alias("_url")).agg(F.min_by("chain", F.struct(-F.size("chain"), F.col("order"), F.col("chain"))).alias("_longest"))
    return out.join(longest, F.col("url") == F.col("_url"), "left").select("url", F.coalesce("_longest", "chain").alias("chain"))

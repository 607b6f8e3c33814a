"""Robots rules and sitemaps as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SITE, Site
from ..functions.url import canonical_page
from ..storage import checkpointed
from .keyed_store import KeyedTable

_URLSET = "url ARRAY<STRUCT<loc: STRING, lastmod: STRING>>"
_INDEX = "sitemap ARRAY<STRUCT<loc: STRING>>"


def robots_rules(robots: DataFrame, agent: str = SITE.agent) -> DataFrame:
    """origin, allow, pattern of the group that applies to `agent`, from rows (origin, body)."""
    lines = robots.select("origin", F.posexplode(F.split("body", r"\r?\n")).alias("i", "line")).withColumn("line", F.trim(F.regexp_replace("line", "#.*$", "")))
    rows = lines.select("origin", "i", F.lower(F.trim(F.split_part("line", F.lit(":"), F.lit(1)))).alias("key"), F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1)).alias("value")).where("key <> ''")
    per = rows.groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("i", "key", "value"))).alias("rows"))
    # one fold over a robots file: which agents the lines before belong to, and whether a rule has ended their list
    kind = "struct<agent:string,allow:boolean,pattern:string>"

    def step(s: Column, x: Column) -> Column:
        is_agent, is_rule = x["key"] == "user-agent", x["key"].isin("allow", "disallow")
        agents = F.when(is_agent, F.when(s["open"], F.concat(s["agents"], F.array(F.lower(x["value"])))).otherwise(F.array(F.lower(x["value"])))).otherwise(s["agents"])
        rules = F.when(is_rule & (x["value"] != ""), F.concat(s["rules"], F.transform(s["agents"], lambda a: F.struct(a, x["key"] == "allow", x["value"]).cast(kind)))).otherwise(s["rules"])
        return F.struct(F.when(is_agent, True).when(is_rule, False).otherwise(s["open"]).alias("open"), agents.alias("agents"), rules.alias("rules"))

    first = F.struct(F.lit(False).alias("open"), F.array().cast("array<string>").alias("agents"), F.array().cast(f"array<{kind}>").alias("rules"))
    rules = per.select("origin", F.aggregate("rows", first, step, lambda s: s["rules"]).alias("rules"))
    own = F.exists("rules", lambda r: r["agent"] == agent.lower())
    chosen = F.filter("rules", lambda r: r["agent"] == F.when(own, agent.lower()).otherwise("*"))
    return rules.select("origin", F.explode(chosen).alias("r")).select("origin", "r.allow", "r.pattern")


def robots_sitemaps(robots: DataFrame, site: Site = SITE) -> DataFrame:
    """Distinct same-origin sitemap URLs that a robots file names, or the default one."""
    named = F.filter(F.transform(F.split("body", r"\r?\n"), lambda x: F.trim(F.regexp_extract(x, r"(?i)^\s*sitemap:\s*(\S+)", 1))), lambda u: u.startswith(f"{site.origin}/"))
    urls = F.array_distinct(named)
    return robots.select("origin", F.explode(F.when(F.size(urls) > 0, urls).otherwise(F.array(F.lit(f"{site.origin}/sitemap.xml")))).alias("sitemap"))


def allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (url, ...) that the rules permit: the longest matching pattern decides, allow on a tie, and no
    match permits. Patterns know * and a final $. The rules of an origin are gathered into one short
    array and joined by origin."""
    escaped = F.regexp_replace(F.regexp_replace(F.col("pattern"), r"([\\.+?^{}()|\[\]])", r"\\$1"), r"\*", ".*")
    regex = F.concat(F.lit("^"), F.when(F.endswith(escaped, F.lit("$")), escaped).otherwise(F.regexp_replace(escaped, r"\$", r"\\$")))
    by = rules.groupBy("origin").agg(F.collect_list(F.struct(F.length("pattern").alias("n"), "allow", regex.alias("regex"))).alias("_rules"))
    path = F.regexp_replace("url", r"^[a-z]+://[^/]+", "")
    rows = urls.withColumn("_origin", F.regexp_extract("url", r"^([a-z]+://[^/]+)", 1)).join(by.withColumnRenamed("origin", "_by"), F.col("_origin") == F.col("_by"), "left")
    hit = F.array_max(F.transform(F.filter("_rules", lambda r: F.rlike(path, r["regex"])), lambda r: F.struct(r["n"].alias("n"), r["allow"].alias("allow"))))
    return rows.where(F.coalesce(hit["allow"], F.lit(True))).drop("_origin", "_by", "_rules")


def sitemap_entries(documents: DataFrame) -> DataFrame:
    """canonical_url, last_modified from rows (url, body): invalid entries are left out and the latest date
    of each page stays."""
    entries = documents.select(F.explode(F.from_xml("body", _URLSET)["url"]).alias("e"))
    page = canonical_page(F.trim(F.col("e.loc")))
    rows = entries.select(page["url"].alias("canonical_url"), F.trim("e.lastmod").alias("last_modified")).where(F.col("canonical_url").isNotNull())
    return rows.groupBy("canonical_url").agg(F.max("last_modified").alias("last_modified"))


def mirror_entries(documents: DataFrame) -> DataFrame:
    """Entries of a mirror of the sitemap: each document (url, body) is one URL set and must have entries; others are
    rows with an error."""
    urls = F.from_xml("body", _URLSET)["url"]
    rows = documents.select("url", F.when(F.contains("body", F.lit("<urlset")) & (F.size(urls) > 0), urls).alias("found"))
    ok = rows.where(F.col("found").isNotNull()).select("url", F.explode("found").alias("e"))
    page = canonical_page(F.trim(F.col("e.loc")))
    good = ok.select("url", page["url"].alias("canonical_url"), F.trim("e.lastmod").alias("last_modified"), page["error"].alias("error"))
    bad = rows.where(F.col("found").isNull()).select("url", *[F.lit(None).cast("string").alias(c) for c in ("canonical_url", "last_modified")], F.lit("invalid_mirror").alias("error"))
    return good.unionByName(bad)


def discover(
    stored_documents: DataFrame, roots: list[str], rules: DataFrame | None = None, site: Site = SITE, most_depth: int = 5, most_files: int = 100,
    most_candidates: int = 200_000,
) -> DataFrame:
    """Pages reachable from the root sitemaps over stored (url, body) documents: breadth-first over
    sitemap indexes of the same origin, each document once, then the entries of all. Each frontier is written,
    so that no round repeats those before. A sitemap deeper than `most_depth`, more files or more entries than the
    limits end the discovery with an error, as its result would be incomplete."""
    spark = stored_documents.sparkSession
    frontier = checkpointed(spark.createDataFrame([(r,) for r in roots], "url string").distinct())
    seen = frontier
    for depth in range(most_depth + 1):
        children = stored_documents.join(frontier, "url").where(F.contains("body", F.lit("<sitemapindex"))).select(F.explode(F.from_xml("body", _INDEX)["sitemap"]).alias("s"))
        frontier = checkpointed(children.select(F.trim("s.loc").alias("url")).where(F.col("url").startswith(f"{site.origin}/")).distinct().join(seen, "url", "left_anti"))
        if frontier.isEmpty():
            break
        if depth == most_depth:
            raise ValueError("sitemap_depth_limit")
        seen = seen.union(frontier)
        if seen.limit(most_files + 1).count() > most_files:
            raise ValueError("sitemap_file_limit")
    pages = sitemap_entries(stored_documents.join(seen, "url").where(F.contains("body", F.lit("<urlset"))))
    if pages.limit(most_candidates + 1).count() > most_candidates:
        raise ValueError("sitemap_candidate_limit")
    if rules is None:
        return pages.orderBy("canonical_url")
    return allowed(pages.withColumnRenamed("canonical_url", "url"), rules).withColumnRenamed("url", "canonical_url").orderBy("canonical_url")


SITEMAPS = "url string, fingerprint string, children array<string>, entries array<struct<canonical_url:string,last_modified:string>>"


def read_sitemaps(documents: DataFrame, site: Site = SITE) -> DataFrame:
    """SITEMAPS of stored documents (url, fingerprint, body): the sitemaps of the same origin that an index names, and the valid entries of a URL
    set. Both are short arrays: a sitemap's format bounds them."""
    entry = lambda e: F.struct(canonical_page(F.trim(e["loc"]))["url"].alias("canonical_url"), F.trim(e["lastmod"]).alias("last_modified"))
    entries = F.filter(F.transform(F.from_xml("body", _URLSET)["url"], entry), lambda e: e["canonical_url"].isNotNull())
    children = F.filter(F.transform(F.from_xml("body", _INDEX)["sitemap"], lambda s: F.trim(s["loc"])), lambda u: u.startswith(f"{site.origin}/"))
    return documents.select(
        "url", "fingerprint", F.when(F.contains("body", F.lit("<sitemapindex")), F.array_distinct(children)).alias("children"), F.when(F.contains("body", F.lit("<urlset")), entries).alias("entries")
    )


def discover_again(
    sitemaps: KeyedTable, documents: KeyedTable, roots: list[str], rules: DataFrame | None = None, site: Site = SITE, most_depth: int = 5, most_files: int = 100,
    most_candidates: int = 200_000,
) -> tuple[DataFrame, list[str]]:
    """The pages of discover(), and the URLs of the documents whose bodies were read for them. `sitemaps` (SITEMAPS, by url) keeps what
    earlier runs have read; a run compares fingerprints along the frontier and reads only documents (url, fingerprint, body) that are new or
    changed, from their buckets of the store. The frontier's URLs, `most_files` at most, are held by the driver."""
    frontier, seen, was_read = sorted(set(roots)), [], []
    for depth in range(most_depth + 1):
        now = {r["url"]: r["fingerprint"] for r in documents.lookup(frontier).select("url", "fingerprint").collect()}
        before = {r["url"]: r["fingerprint"] for r in sitemaps.lookup(list(now)).select("url", "fingerprint").collect()}
        changed = sorted(u for u in now if before.get(u) != now[u])
        if changed:
            rows = read_sitemaps(documents.lookup(changed), site)
            sitemaps.upsert(rows, lambda old, new, was, has: {c: F.when(has, new(c)).otherwise(old(c)) for c in ("fingerprint", "children", "entries")}, order=["fingerprint"])
            was_read += changed
        seen += frontier
        if len(seen) > most_files:
            raise ValueError("sitemap_file_limit")
        present = sitemaps.lookup(sorted(now))
        children = present.select(F.explode("children").alias("url")).distinct().limit(most_files + len(seen) + 1)
        frontier = sorted({r["url"] for r in children.collect()} - set(seen))
        if not frontier:
            break
        if depth == most_depth:
            raise ValueError("sitemap_depth_limit")
    there = [r["url"] for r in documents.lookup(seen).select("url").collect()]
    found = sitemaps.lookup(there).select(F.explode("entries").alias("e")).groupBy("e.canonical_url").agg(F.max("e.last_modified").alias("last_modified"))
    if found.limit(most_candidates + 1).count() > most_candidates:
        raise ValueError("sitemap_candidate_limit")
    if rules is None:
        return found.orderBy("canonical_url"), was_read
    return allowed(found.withColumnRenamed("canonical_url", "url"), rules).withColumnRenamed("url", "canonical_url").orderBy("canonical_url"), was_read

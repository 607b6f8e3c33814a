"""Queries over what operators keep in storage: each builds the store from its corpus tables and works on it."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SEARCH_LIMIT, SITE
from ..operators import admission, discovery, keyed_store, path_tree, payload_store, protection, publish_store, search, search_index, term_matcher, timed
from ..sources import adapters as A
from ..storage import new_path, stored
from .more_queries import _known
from .queries import BEFORE, NOW, SEARCH_WORD, _reader_tables, query

RARE_WORDS = "mit license"
HOT_LIMIT = 1_000_000
MINUTE = 60_000
#: Later than all events of the plain tables.
UNTIL = 4_000_000_000_000


def _index(spark: SparkSession, d: str) -> search_index.SearchIndex:
    return search_index.write_index(search.search_rows(*_reader_tables(spark, d)), new_path(spark, "search"))


@query
def search_indexed(spark: SparkSession, d: str) -> DataFrame:
    return search_index.search_index(_index(spark, d), SEARCH_WORD, SEARCH_LIMIT, whole=True)


@query
def search_indexed_rare(spark: SparkSession, d: str) -> DataFrame:
    return search_index.search_index(_index(spark, d), RARE_WORDS, SEARCH_LIMIT, whole=True)


@query
def page_store_upserts(spark: SparkSession, d: str) -> DataFrame:
    """A discovery, requests for pages and the end of the discovery, applied in turn to a stored page table."""
    pages = A.source_pages(spark, d)
    store = keyed_store.create(_known(spark, d), new_path(spark, "pages"), "canonical_url")
    other = F.when(F.pmod("page_id", F.lit(4)) == 0, "/new").otherwise("")
    keyed_store.discovered(store, pages.where(F.pmod("page_id", F.lit(2)) == 0).select(F.concat("canonical_url", other).alias("canonical_url"), F.concat("path", other).alias("path")), NOW)
    asked = F.when(F.pmod("page_id", F.lit(10)) == 0, "/asked").otherwise("")
    keyed_store.wanted(store, pages.where(F.pmod("page_id", F.lit(5)) == 0).select(F.concat("canonical_url", asked).alias("canonical_url"), F.concat("path", F.lit("/asked")).alias("path")))
    keyed_store.missing(store, NOW - timedelta(days=1), NOW)
    stamp = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return store.read().select("canonical_url", "path", stamp("last_discovered_at"), stamp("missing_since"))


@query
def policy_store(spark: SparkSession, d: str) -> DataFrame:
    """The policies of three writers, the later rows written first, in a stored table."""
    rows = A.table(spark, d, "events").select("user_id", "event_type", F.col("event_id").alias("written"))
    parts = [rows.where(F.pmod("written", F.lit(3)) == k) for k in (2, 0, 1)]
    store = keyed_store.create(rows.limit(0), new_path(spark, "policies"), "user_id", buckets=16)
    for part in parts:
        keyed_store.latest(store, part, "written")
    return store.read()


def _published(spark: SparkSession, d: str) -> publish_store.PublishStore:
    """Three commits: every page; two of three pages again, half of them without their first block; every other page as at first."""
    blocks = stored(A.content_blocks(spark, d).select("page_id", "block_id", "ordinal", "block_type", "fingerprint", "translatable"), "blocks")  # fingerprints once for all commits
    page = F.col("page_id")
    fetches = [blocks, blocks.where((page % 3 != 0) & ~((page % 3 == 1) & (F.col("ordinal") == 0))), blocks.where(page % 2 == 0)]
    store = publish_store.PublishStore(spark, new_path(spark, "published"))
    for n, fetched in enumerate(fetches):
        rows = fetched.select("page_id", F.lit(n).alias("fetch_id"), (F.col("block_id") * 10 + n).alias("block_id"), "ordinal", "block_type", "fingerprint", "translatable")
        publish_store.publish(store, rows, n, translations=A.block_translations(spark, d).withColumn("block_id", F.col("block_id") * 10) if n == 1 else None)
        publish_store.publish(store, rows.limit(0), n)  # taken again, it changes nothing
    return store


@query
def publish_commits(spark: SparkSession, d: str) -> DataFrame:
    return _published(spark, d).read("decisions")


@query
def published_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of the current versions, with the states that their translations have inherited."""
    store = _published(spark, d)
    return store.current_blocks().join(store.states().select("block_id", "status", "current_revision_id"), "block_id", "left").select(
        "block_id", "page_id", "version", "ordinal", "fingerprint", "status", "current_revision_id"
    )


@query
def budget_admission_hot(spark: SparkSession, d: str) -> DataFrame:
    """All requests as those of one day, admitted in rounds over all tasks."""
    return admission.admit_in_rounds(A.token_ledger(spark, d).withColumn("usage_date", F.lit("all")), HOT_LIMIT)


def _title_terms(spark: SparkSession, d: str) -> DataFrame:
    """A glossary that grows with the corpus: the words of eight letters or more in titles."""
    words = F.regexp_extract_all("title", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return A.source_pages(spark, d).select(F.explode(F.filter(words, lambda w: F.length(w) >= 8)).alias("term"))


@query
def glossary_protected(spark: SparkSession, d: str) -> DataFrame:
    """Blocks with all words of titles protected, and what comes before the first space as a span of the parser's."""
    blocks = A.content_blocks(spark, d)
    first = F.locate(" ", "source_text") - 1
    spans = F.when(first > 0, F.array(F.struct(F.lit(0).alias("start"), first.alias("end"))))
    out = term_matcher.protect_with_terms(blocks, _title_terms(spark, d), spans)
    return out.select("block_id", "protected.error", F.size("protected.tokens").alias("tokens"), protection.restore("protected.text", F.col("protected.tokens")).alias("restored"),
                      F.get("protected.tokens", F.lit(0))["value"].alias("first_value"))


@query
def reservation_timers(spark: SparkSession, d: str) -> DataFrame:
    """Each event as a reservation: sign-ups and purchases are started after k minutes, purchases settled some minutes later. Reservations are released after
    30 minutes and settled in full 5 minutes after their start, if nothing happens."""
    kind, number = F.col("event_type"), F.col("event_id")
    at, k = F.unix_millis(F.col("ts").cast("timestamp")), F.get_json_object("props", "$.k").cast("long") * MINUTE
    tokens = F.floor("value").cast("long") + 1
    event = lambda n, after, name, amount: F.struct((number * 3 + n).alias("event_id"), (at + after).alias("at_ms"), F.lit(name).alias("event"), amount.cast("long").alias("tokens"))
    started = F.when(kind.isin("signup", "purchase"), event(1, k, "start", F.lit(None)))
    settled = F.when(kind == "purchase", event(2, k + F.pmod(number, F.lit(10)) * MINUTE, "settle", F.when(F.pmod(number, F.lit(7)) != 0, F.pmod(number, F.lit(300)))))
    rows = A.table(spark, d, "events").select(number.alias("reservation_id"), F.explode(F.array_compact(F.array(event(0, F.lit(0), "reserve", tokens), started, settled))).alias("e")).select("reservation_id", "e.*")
    return timed.timed_scan(rows, "reservation_id", ["event", "tokens"], timed.reservation_step(30 * MINUTE, 5 * MINUTE), UNTIL)


@query
def job_leases(spark: SparkSession, d: str) -> DataFrame:
    """The events of each user as those of a job with two workers."""
    kind = F.col("event_type")
    event = F.when(kind.isin("click", "view"), "claim").when(kind == "signup", "renew").when(kind == "purchase", "complete").otherwise("fail")
    finished = F.when(kind == "purchase", F.pmod("event_id", F.lit(40)) == 0).otherwise(True)  # else a job would end with its first purchase
    rows = A.table(spark, d, "events").where(finished).select(
        F.col("user_id").alias("job_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), "event_id", event.alias("event"), F.concat(F.lit("worker"), F.pmod("event_id", F.lit(2))).alias("owner")
    )
    return timed.timed_scan(rows, "job_id", ["event", "owner"], timed.lease_step(3 * 60 * MINUTE, 30), UNTIL)


@query
def navigation_all(spark: SparkSession, d: str) -> DataFrame:
    """The children of all parents in one pass."""
    return path_tree.all_children(path_tree.path_tree(A.source_pages(spark, d)))


@query
def navigation_intervals(spark: SparkSession, d: str) -> DataFrame:
    return path_tree.path_tree(A.source_pages(spark, d)).select("path", "depth", "pages", "pre", "last")


@query
def payloads_stored(spark: SparkSession, d: str) -> DataFrame:
    """Bodies of fetches of pages: each event of an error or a view keeps a page's body for seven or for one day. Two writes, an expiry between them and
    one after; what is left, with the days that the store still has."""
    pages = A.table(spark, d, "pages").select("page_id", F.encode("html", "UTF-8").alias("body"))
    n = pages.count()
    events = A.table(spark, d, "events").where(F.col("event_type").isin("error", "view"))
    days = F.when(F.col("event_type") == "error", F.expr("INTERVAL 7 DAYS")).otherwise(F.expr("INTERVAL 1 DAY"))
    fetches = events.select(F.col("event_id").alias("fetch_id"), F.pmod("user_id", F.lit(n)).alias("page_id"), "ts", (F.col("ts") + days).alias("expires_at")).join(pages, "page_id")
    store, middle = payload_store.PayloadStore(spark, new_path(spark, "payload-store")), F.lit(BEFORE)
    store.write(fetches.where(F.col("ts") < middle), datetime(2024, 1, 1))
    store.expire(BEFORE)
    store.write(fetches.where((F.col("ts") >= middle) & (F.col("ts") < F.lit(NOW))), BEFORE)
    store.expire(NOW)
    return store.read(NOW).select("fetch_id", "hash", "bytes")


ROBOTS = f"""User-agent: *
Disallow: {SITE.root}/de
Allow: {SITE.root}/de/web
Disallow: {SITE.root}/*/*/1*
Sitemap: {SITE.origin}/index.xml
"""


def _sitemap_documents(pages: DataFrame, skip: int | None = None) -> DataFrame:
    """url, fingerprint, body: an index of sitemaps, one for each language, source and 20,000 page numbers; `skip` leaves out every page with that remainder by 7."""
    parts = F.split("path", "/")
    one = pages.select(F.concat_ws("-", F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.floor(F.col("page_id") / 20_000).cast("string")).alias("name"), "canonical_url", "page_id")
    if skip is not None:
        one = one.where(F.pmod("page_id", F.lit(7)) != skip)
    day = F.when(F.pmod("page_id", F.lit(3)) > 0, F.concat(F.lit("<lastmod>2024-01-1"), F.pmod("page_id", F.lit(3)), F.lit("</lastmod>"))).otherwise("")
    entry = F.concat(F.lit("<url><loc>"), "canonical_url", F.when(F.pmod("page_id", F.lit(11)) == 5, "?x=1").otherwise("/"), F.lit("</loc>"), day, F.lit("</url>"))
    sets = one.groupBy("name").agg(F.concat_ws("", F.array_sort(F.collect_list(entry))).alias("body"))
    sets = sets.select(F.concat(F.lit(f"{SITE.origin}/maps/"), "name", F.lit(".xml")).alias("url"), F.concat(F.lit("<urlset>"), "body", F.lit("</urlset>")).alias("body"))
    index = sets.agg(F.concat_ws("", F.array_sort(F.collect_list(F.concat(F.lit("<sitemap><loc>"), "url", F.lit("</loc></sitemap>"))))).alias("body"))
    index = index.select(F.lit(f"{SITE.origin}/index.xml").alias("url"), F.concat(F.lit("<sitemapindex>"), "body", F.lit("</sitemapindex>")).alias("body"))
    return sets.unionByName(index).select("url", F.sha2("body", 256).alias("fingerprint"), "body")


def _rules(spark: SparkSession) -> tuple[list[str], DataFrame]:
    robots = spark.createDataFrame([(SITE.origin, ROBOTS)], "origin string, body string")
    return [r["sitemap"] for r in discovery.robots_sitemaps(robots).collect()], discovery.robots_rules(robots)


@query
def discovered_pages(spark: SparkSession, d: str) -> DataFrame:
    roots, rules = _rules(spark)
    documents = _sitemap_documents(A.source_pages(spark, d)).select("url", "body")
    return discovery.discover(stored(documents), roots, rules, most_files=1_000_000, most_candidates=2_000_000_000)


@query
def discovered_again(spark: SparkSession, d: str) -> DataFrame:
    """A discovery, then one over sitemaps of which some have changed; only those are read again."""
    roots, rules = _rules(spark)
    pages = A.source_pages(spark, d)
    documents = keyed_store.create(_sitemap_documents(pages, skip=3), new_path(spark, "documents"), "url", buckets=16)
    sitemaps = keyed_store.create(spark.createDataFrame([], discovery.SITEMAPS), new_path(spark, "sitemaps"), "url", buckets=16)
    limits = {"most_files": 1_000_000, "most_candidates": 2_000_000_000}
    discovery.discover_again(sitemaps, documents, roots, rules, **limits)
    documents.upsert(_sitemap_documents(pages), lambda old, new, was, has: {c: F.when(has, new(c)).otherwise(old(c)) for c in ("fingerprint", "body")}, order=["fingerprint"])
    return discovery.discover_again(sitemaps, documents, roots, rules, **limits)[0]


@query
def mirror_pages(spark: SparkSession, d: str) -> DataFrame:
    """Entries of mirrored sitemaps; the index among them is no URL set."""
    return discovery.mirror_entries(_sitemap_documents(A.source_pages(spark, d)).select("url", "body")).select("url", "canonical_url", "last_modified", "error")

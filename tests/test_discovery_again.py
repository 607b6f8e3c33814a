"""A discovery that goes on: the pages of a whole discovery, reading only what is new or changed."""

import pytest
from pyspark.sql import functions as F

from folioflow.operators import discovery, keyed_store

SITE = "https://docs.example.com"


def urlset(*pages):
    return "<urlset>" + "".join(f"<url><loc>{SITE}/docs/{p}</loc><lastmod>2024-01-0{1 + len(p) % 5}</lastmod></url>" for p in pages) + "</urlset>"


def index(*names):
    return "<sitemapindex>" + "".join(f"<sitemap><loc> {n if n.startswith('http') else f'{SITE}/{n}'} </loc></sitemap>" for n in names) + "</sitemapindex>"


DOCS = {"root": index("a", "b", "sub", "https://elsewhere.com/x", "lost"), "a": urlset("a/1", "a/2", "b/1"), "b": urlset("b/1", "b/2?x=1"), "sub": index("c", "root"), "c": urlset("c/1"), "other": urlset("z")}


def documents(spark, docs):
    return spark.createDataFrame([(f"{SITE}/{n}", b) for n, b in docs.items()], "url string, body string").withColumn("fingerprint", F.sha2("body", 256)).select("url", "fingerprint", "body")


@pytest.fixture
def stores(spark, tmp_path):
    docs = keyed_store.create(documents(spark, DOCS), str(tmp_path / "docs"), "url", buckets=8)
    maps = keyed_store.create(spark.createDataFrame([], discovery.SITEMAPS), str(tmp_path / "maps"), "url", buckets=8)
    return maps, docs


def change(spark, docs, **new):
    docs.upsert(documents(spark, new), lambda old, now, was, has: {c: F.when(has, now(c)).otherwise(old(c)) for c in ("fingerprint", "body")}, order=["fingerprint"])


def test_later_runs_read_what_has_changed(spark, stores):
    maps, docs = stores
    rules = discovery.robots_rules(spark.createDataFrame([(SITE, "User-agent: *\nDisallow: /docs/a/2")], "origin string, body string"))
    roots = [f"{SITE}/root"]
    whole = lambda: discovery.discover(docs.read().select("url", "body"), roots, rules).collect()
    found, read = discovery.discover_again(maps, docs, roots, rules)
    assert found.collect() == whole() and len(whole()) == 3
    assert read == [f"{SITE}/{n}" for n in ("root", "a", "b", "sub", "c")]
    found, read = discovery.discover_again(maps, docs, roots, rules)
    assert found.collect() == whole() and read == []
    change(spark, docs, c=urlset("c/2", "c/3"), sub=index("c", "d"), d=urlset("d/1"))
    found, read = discovery.discover_again(maps, docs, roots, rules)
    assert found.collect() == whole() and sorted(read) == [f"{SITE}/{n}" for n in ("c", "d", "sub")]
    change(spark, docs, root=index("b"))
    found, read = discovery.discover_again(maps, docs, roots, rules)
    assert found.collect() == whole() and read == roots


def test_a_run_without_changes_reads_no_body(spark, stores, monkeypatch):
    maps, docs = stores
    discovery.discover_again(maps, docs, [f"{SITE}/root"])
    monkeypatch.setattr(discovery, "read_sitemaps", lambda *a: pytest.fail("a body is read"))
    assert discovery.discover_again(maps, docs, [f"{SITE}/root"])[1] == []


def test_limits_and_nothing(stores):
    maps, docs = stores
    with pytest.raises(ValueError, match="sitemap_file_limit"):
        discovery.discover_again(maps, docs, [f"{SITE}/root"], most_files=3)
    with pytest.raises(ValueError, match="sitemap_depth_limit"):
        discovery.discover_again(maps, docs, [f"{SITE}/root"], most_depth=1)
    with pytest.raises(ValueError, match="sitemap_candidate_limit"):
        discovery.discover_again(maps, docs, [f"{SITE}/root"], most_candidates=2)
    assert discovery.discover_again(maps, docs, [f"{SITE}/none"])[0].collect() == []

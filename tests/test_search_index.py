"""The trigram index gives what search() gives, and reads only what it must."""

import re

import pytest

from conftest import DATA
from folioflow.operators import search, search_index
from folioflow.sources import adapters as A

SCHEMAS = ("page_id long, path string, title string, status string", "page_id long, block_id long, ordinal int, source_text string", "block_id long, current_revision_id long", "revision_id long, translated_text string")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa 100% a_b ÄRGER straße".split()


def corpus(spark, n=300):
    pages = [(i, f"/docs/{WORDS[i % 7]}/{i}", None if i % 11 == 0 else f"{WORDS[i % 13]} {WORDS[i % 5]}", "blocked" if i % 17 == 0 else "active") for i in range(n)]
    blocks = [(i, i * 100 + k, k, None if (i + k) % 29 == 0 else " ".join(WORDS[(i * 3 + k * j) % len(WORDS)] for j in range(1, 6))) for i in range(n) for k in range(4)]
    states = [(b, b if b % 3 else None) for _, b, _, _ in blocks if b % 2]
    revisions = [(b, f"{WORDS[b % 14]} übersetzt") for _, b, _, _ in blocks]
    return tuple(spark.createDataFrame(x, s) for x, s in zip((pages, blocks, states, revisions), SCHEMAS, strict=True))


@pytest.fixture(scope="module")
def tables(spark):
    return tuple(t.cache() for t in corpus(spark))


@pytest.fixture(scope="module")
def index(spark, tables, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "store")
    search_index.write_index(search.search_rows(*tables), path, buckets=16, run_pages=32, most_parts=5)
    return search_index.open_index(spark, path)


@pytest.mark.parametrize("query", ["alpha", "Beta gamma", "a_b", "100%", "ärger", "übersetzt", "/docs/eta/27", "zz", "e", "", "no such words", "STRASSE", "straße"])
def test_same_rows_as_search(tables, index, query):
    for limit in (3, 20):
        assert search_index.search_index(index, query, limit).collect() == search.search(*tables, query, limit).collect()


def test_lists_are_runs_in_order(index):
    rows = index.table("blocks").collect()
    assert rows and all(r["ids"] == sorted(set(r["ids"])) and r["n"] == len(r["ids"]) <= 32 and {i // 32 for i in r["ids"]} == {r["run"]} for r in rows)


def folders_read(df):
    """Folders and files that a scan opens, from its metrics."""
    run = df._jdf.queryExecution()
    run.toRdd().count()
    metrics = run.executedPlan().collectLeaves().apply(0).metrics()
    return metrics.apply("numPartitions").value(), metrics.apply("numFiles").value()


def test_reads_only_what_may_match(index):
    trigrams = search_index.query_trigrams("kappa")
    folders, files = folders_read(search_index._lists(index, "blocks", trigrams))
    assert 0 < folders <= len(trigrams) < folders_read(index.table("blocks"))[0] == 16
    plan = search_index._lists(index, "blocks", trigrams)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*bucket", plan) and re.search(r"PushedFilters: \[.*trigram", plan)
    one = search_index.candidate_entries(index, "/docs/eta/27")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*part", one)
    assert folders_read(index.table("entries"))[0] == 5


def test_empty_corpus(spark, tables, tmp_path):
    path = str(tmp_path / "store")
    index = search_index.write_index(search.search_rows(tables[0].limit(0), *tables[1:]), path)
    assert search_index.search_index(index, "alpha").collect() == []


def test_on_the_given_tables(spark, tmp_path):
    tables = (A.source_pages(spark, DATA), A.content_blocks(spark, DATA), A.block_translations(spark, DATA), A.translation_revisions(spark, DATA))
    index = search_index.write_index(search.search_rows(*tables), str(tmp_path / "store"), run_pages=16)
    for query in ("license", "of the", "The", "/docs/en"):
        assert search_index.search_index(index, query).collect() == search.search(*tables, query).collect()

"""The tree of paths gives for each parent what the operators for one parent give."""

import re

import pytest
from pyspark.sql import functions as F

from folioflow.operators import navigation, path_tree

PATHS = ["/docs/en", "/docs/en/api", "/docs/en/api/rest-calls", "/docs/en/api/rest-calls/v2", "/docs/en/api-keys", "/docs/en/api.x", "/docs/de/web/css-in-json", "/docs/de/web", "/docs/fr/a/b/c/d/e", "/docs/xx/hidden/page", "/other/page", "/docs", "/docs/en/zeta", "/docs/en/Alpha", "/docs/en/alpha"]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, p, None if i % 4 == 0 else f" Title {i % 3} ", "active") for i, p in enumerate(PATHS)] + [(90, "/docs/es/gone", "t", "blocked"), (91, "/docs/en/api", "later", "active")]
    rows += [(100 + i, f"/docs/en/many/{i % 7}/{i}", "", "active") for i in range(200)]
    return spark.createDataFrame(rows, "page_id long, path string, title string, status string").cache()


@pytest.fixture(scope="module")
def tree(pages):
    return path_tree.path_tree(pages)


def test_children_of_every_parent(pages, tree):
    columns = ["path", "label", "is_page", "has_children"]
    by = {}
    for r in path_tree.all_children(tree).collect():
        by.setdefault(r["parent"], []).append(tuple(r[c] for c in columns))
    wanted = {p: [tuple(r[c] for c in columns) for r in navigation.children(pages, p).collect()] for p in sorted({"/docs", *by})}
    assert sorted(by.pop("/docs")) == sorted(wanted.pop("/docs")) and by == wanted
    for p in ("/docs/en/api", "/docs/en/many", "/docs/none"):
        assert [tuple(r) for r in path_tree.children_of(tree, p).select(*columns).collect()] == [tuple(r[c] for c in columns) for r in navigation.children(pages, p).collect()]


def test_ranges_are_subtrees(pages, tree):
    rows = tree.orderBy("pre").collect()
    assert [r["pre"] for r in rows] == list(range(len(rows)))
    for r in rows:
        assert {x["path"] for x in rows if r["pre"] <= x["pre"] <= r["last"]} == {x["path"] for x in rows if x["path"] == r["path"] or x["path"].startswith(r["path"] + "/")}
        assert r["pages"] == sum(1 for p in pages.collect() if p["status"] == "active" and (p["path"] == r["path"] or p["path"].startswith(r["path"] + "/")))
    assert {r["path"] for r in path_tree.below(tree, "/docs/en/many").where("is_page").collect()} == {r["path"] for r in navigation.entries_below(pages, "/docs/en/many").collect()}


def test_lookups_are_pushed_to_the_files(tree):
    plan = path_tree.below(tree, "/docs/en/many")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[.*GreaterThan\(pre,.*LessThanOrEqual\(pre,", plan)


def test_no_pages(spark, pages):
    tree = path_tree.path_tree(pages.where(F.lit(False)))
    assert tree.collect() == [] and path_tree.children_of(tree, "/docs/en").collect() == []

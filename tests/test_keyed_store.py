"""Stored tables with upserts by key: the same rows as whole-table joins, and only touched buckets are written."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from folioflow.operators import keyed_store, publish

PAGES = "canonical_url string, path string, last_discovered_at timestamp, missing_since timestamp"
T = [datetime(2024, 1, k) for k in range(1, 9)]


def files(path):
    return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def bucket_of(name):
    return int(name.split("bucket=")[1].split("/")[0])


@pytest.fixture
def store(spark, tmp_path):
    rows = [(f"u{i}", f"/p{i}", T[i % 3], T[0] if i % 5 == 0 else None) for i in range(200)] + [(None, "/none", None, None)]
    return keyed_store.create(spark.createDataFrame(rows, PAGES), str(tmp_path / "pages"), "canonical_url", buckets=16)


def test_upserts_in_turn(spark, store):
    first = spark.createDataFrame([(f"u{i}", f"/new{i}") for i in (3, 5, 300)] + [("u3", "/a"), (None, "/n")], "canonical_url string, path string")
    second = spark.createDataFrame([("u5", "/again"), ("u301", "/x")], "canonical_url string, path string")
    before = files(store.path)
    # what whole-table joins give (a null key is inserted anew by them, so it is left out there)
    model = store.read().where("canonical_url is not null")
    model = publish.upsert_discovered(model, first.where("path <> '/a' and canonical_url is not null"), T[4])
    wanted = {tuple(r) for r in publish.upsert_discovered(model, second, T[5]).collect()}
    touched = keyed_store.discovered(store, first, T[4])
    middle = files(store.path)
    assert 0 < len(touched) <= 4 and {bucket_of(f) for f in before.keys() - middle.keys()} <= set(touched)
    assert all(middle[f] == t for f, t in before.items() if bucket_of(f) not in touched)
    keyed_store.discovered(store, second, T[5])
    rows = store.read().collect()
    assert len(rows) == 203 and {tuple(r) for r in rows if r[0] is not None} == wanted
    assert [(r["path"], r["last_discovered_at"]) for r in rows if r[0] is None] == [("/n", T[4])]


def test_the_same_change_again_changes_nothing(spark, store):
    change = spark.createDataFrame([("u1", "/b"), ("new", "/c")], "canonical_url string, path string")
    keyed_store.discovered(store, change, T[6])
    once = {tuple(r) for r in store.read().collect()}
    keyed_store.discovered(store, change, T[6])
    assert {tuple(r) for r in store.read().collect()} == once
    assert keyed_store.discovered(store, change.limit(0), T[7]) == []


def test_wanted_keeps_the_rest(spark, store):
    keyed_store.wanted(store, spark.createDataFrame([("u10", "/w"), ("u999", "/v")], "canonical_url string, path string"))
    rows = {r[0]: tuple(r)[1:] for r in store.lookup(["u10", "u999", "u11"]).collect()}
    assert rows == {"u10": ("/w", T[1], T[0]), "u999": ("/v", None, None), "u11": ("/p11", T[2], None)}


def test_missing_writes_only_buckets_with_unseen_pages(spark, store):
    before = files(store.path)
    wanted = {tuple(r) for r in publish.mark_missing(store.read(), T[1], T[7]).collect()}
    touched = keyed_store.missing(store, T[1], T[7])
    after = files(store.path)
    assert {tuple(r) for r in store.read().collect()} == wanted
    assert all(after.get(f) == t for f, t in before.items() if bucket_of(f) not in touched)
    assert keyed_store.missing(store, T[1], T[7]) == []


def test_latest_in_any_order(spark, tmp_path):
    rows = spark.range(500).select((F.col("id") % 37).alias("k"), F.concat(F.lit("v"), "id").alias("v"), F.col("id").alias("at"), F.lit(1).alias("n"))
    store = keyed_store.create(rows.limit(0), str(tmp_path / "t"), "k", buckets=8)
    assert store.read().collect() == []
    for part in (2, 0, 1):
        keyed_store.latest(store, rows.where(F.col("at") % 3 == part), "at")
    assert {tuple(r) for r in store.read().select("k", "v", "at", "n").collect()} == {tuple(r) for r in publish.latest_rows(rows, ["k"], "at").select("k", "v", "at", "n").collect()}


def test_a_broken_write_leaves_the_table(spark, store):
    before = {tuple(r) for r in store.read().collect()}
    broken = spark.createDataFrame([("u1", "/b")], "canonical_url string, path string").withColumn("path", F.raise_error(F.lit("broken off")).cast("string"))
    with pytest.raises(Exception, match="broken off"):
        keyed_store.wanted(store, broken)
    assert {tuple(r) for r in store.read().collect()} == before

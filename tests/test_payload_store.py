"""Bodies are shared, kept as long as any fetch needs them, and expire by whole folders."""

import os
from datetime import datetime, timedelta

import pytest

from folioflow.operators.payload_store import PayloadStore

T = datetime(2024, 3, 1, 12)
SCHEMA = "fetch_id long, body binary, expires_at timestamp"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if b is None else b.encode(), T + timedelta(days=d)) for i, b, d in rows], SCHEMA)


def files(path):
    return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


@pytest.fixture
def store(spark, tmp_path):
    store = PayloadStore(spark, str(tmp_path / "payloads"))
    store.write(frame(spark, [(1, "a", 1), (2, "a", 3), (3, "b", 1), (4, None, 2), (5, "", 2), (6, "old", -1), (1, "a", 1)]), T)
    return store


def live(store, now):
    rows = store.read(now).collect()
    assert len(rows) == len({r["fetch_id"] for r in rows})
    return {r["fetch_id"]: bytes(r["body"]).decode() for r in rows}


def test_bodies_are_shared(store):
    assert live(store, T) == {1: "a", 2: "a", 3: "b", 4: "", 5: ""}
    assert sorted((bytes(r["body"]).decode(), str(r["day"])) for r in store.bodies().collect()) == [("", "2024-03-03"), ("a", "2024-03-04"), ("b", "2024-03-02")]


def test_a_body_brought_again_lives_on(spark, store):
    store.write(frame(spark, [(7, "b", 5), (8, "a", 2), (9, "c", 1)]), T)
    days = sorted((bytes(r["body"]).decode(), str(r["day"])) for r in store.bodies().collect())
    assert days == [("", "2024-03-03"), ("a", "2024-03-04"), ("b", "2024-03-02"), ("b", "2024-03-06"), ("c", "2024-03-02")]
    assert live(store, T)[3] == "b" and live(store, T)[7] == "b" and live(store, T)[8] == "a"


def test_expiry_touches_no_living_folder(spark, store):
    store.write(frame(spark, [(7, "b", 5)]), T)
    before = files(store.path)
    now = T + timedelta(days=2)
    assert store.expire(now) == ["2024-03-02"]
    after = files(store.path)
    assert after.items() <= before.items() and all("day=2024-03-02" in f for f in before.keys() - after.keys())
    assert live(store, now) == {2: "a", 7: "b"}
    assert store.expire(now) == []
    assert store.expire(T + timedelta(days=9)) == ["2024-03-03", "2024-03-04", "2024-03-06"] and live(store, T) == {}


def test_the_same_write_again(spark, store):
    before = live(store, T)
    store.write(frame(spark, [(1, "a", 1), (2, "a", 3)]), T)
    assert live(store, T) == before and store.bodies().count() == 3


def test_empty_store(spark, tmp_path):
    store = PayloadStore(spark, str(tmp_path / "none"))
    assert live(store, T) == {} and store.expire(T) == []
    store.write(frame(spark, []), T)
    assert live(store, T) == {}

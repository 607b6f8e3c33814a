"""Commits of published pages: all or nothing, once, and the same as the fold over all fetches."""

import pytest
from pyspark.sql import functions as F

from folioflow.operators import publish, publish_store
from folioflow.operators.publish_store import PublishStore

BLOCKS = "page_id long, fetch_id long, block_id long, ordinal int, block_type string, fingerprint string, translatable boolean"


def fetch(n, pages):
    """pages: id -> text, a block for each letter."""
    return [(p, n, p * 1000 + n * 100 + k, k, "paragraph", c, c != "x") for p, text in pages.items() for k, c in enumerate(text)]


FETCHES = [{1: "abc", 2: "de", 3: "q"}, {1: "abd", 2: "de"}, {1: "abc", 3: "qr", 4: "xx"}, {1: "abdz", 2: "e", 4: "xx"}, {1: "abd", 3: "q"}]


def frame(spark, n, pages=None):
    return spark.createDataFrame(fetch(n, FETCHES[n] if pages is None else pages), BLOCKS)


def visible(store):
    return {t: sorted(map(str, store.read(t).collect())) for t in publish_store.TABLES}


def test_decisions_are_those_of_the_fold(spark, tmp_path):
    store = PublishStore(spark, str(tmp_path / "s"))
    for n in range(len(FETCHES)):
        assert publish_store.publish(store, frame(spark, n), n)
    rows = [(p, n, n, text) for n, pages in enumerate(FETCHES) for p, text in pages.items()]
    fold = publish.version_decisions(spark.createDataFrame(rows, "page_id long, at long, fetch_id long, fingerprint string"))
    assert {(r.page_id, r.decision, r.version, r.commit) for r in store.read("decisions").collect()} == {(r.page_id, r.decision, r.version, r.fetch_id) for r in fold.collect()}
    now = {}
    for r in store.current_blocks().orderBy("page_id", "ordinal").collect():
        now[r.page_id] = now.get(r.page_id, "") + r.fingerprint
    assert now == {1: "abd", 2: "e", 3: "q", 4: "xx"}


def test_states_and_jobs_follow_the_blocks(spark, tmp_path):
    store = PublishStore(spark, str(tmp_path / "s"))
    publish_store.publish(store, frame(spark, 0), 0)
    done = store.read("blocks").select("block_id", F.when(F.col("fingerprint") == "c", "manually_corrected").otherwise("ai_translated").alias("status"), (F.col("block_id") + 5).alias("current_revision_id"))
    publish_store.publish(store, frame(spark, 1), 1, translations=done)
    text = {r.block_id: r.fingerprint for r in store.current_blocks().collect()}
    states = {text[r.block_id]: (r.status, r.reason, r.current_revision_id) for r in store.states().collect() if r.block_id in text and r.block_id // 1000 == 1}
    assert states == {"a": ("ai_translated", None, 1005), "b": ("ai_translated", None, 1006), "d": ("review_required", "source_changed_after_manual_correction", 1007)}
    assert [r.dedupe_key for r in store.read("jobs").where("commit = 1").collect()] == ["translate:1102:d"]
    assert {(r.kind, r.previous_index, r.current_index) for r in store.read("changes").where("commit = 1").collect()} == {("modified", 2, 2)}


def test_a_commit_counts_once(spark, tmp_path):
    store = PublishStore(spark, str(tmp_path / "s"))
    publish_store.publish(store, frame(spark, 0), 0)
    publish_store.publish(store, frame(spark, 1), 7)
    before = visible(store)
    assert not publish_store.publish(store, frame(spark, 2), 7)
    assert visible(store) == before
    with pytest.raises(ValueError, match="after 7"):
        publish_store.publish(store, frame(spark, 2), 3)


@pytest.mark.parametrize("table", ["versions", "jobs", "manifest"])
def test_a_broken_commit_shows_nothing(spark, tmp_path, monkeypatch, table):
    store = PublishStore(spark, str(tmp_path / "s"))
    publish_store.publish(store, frame(spark, 0), 0)
    before = visible(store)
    stage, commit = PublishStore._stage, PublishStore._commit

    def broken_stage(self, name, *rest):
        if name == table:
            raise RuntimeError("lost")
        stage(self, name, *rest)

    def broken_commit(self, number):
        if table == "manifest":
            raise RuntimeError("lost")
        commit(self, number)

    with monkeypatch.context() as m:
        m.setattr(PublishStore, "_stage", broken_stage)
        m.setattr(PublishStore, "_commit", broken_commit)
        with pytest.raises(RuntimeError, match="lost"):
            publish_store.publish(store, frame(spark, 3), 1)
    assert visible(store) == before and store.commits() == [0]
    publish_store.publish(store, frame(spark, 1), 1)  # the number again, with another batch
    clean = PublishStore(spark, str(tmp_path / "clean"))
    for n in (0, 1):
        publish_store.publish(clean, frame(spark, n), n)
    assert visible(store) == visible(clean)


def test_stream_of_fetches(spark, tmp_path):
    folder, store = tmp_path / "in", PublishStore(spark, str(tmp_path / "s"))
    clean = PublishStore(spark, str(tmp_path / "clean"))
    for n in range(3):
        publish_store.publish(clean, frame(spark, n), n)
        frame(spark, n).coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(BLOCKS).parquet(str(folder))
        q = publish_store.publish_stream(stream, store, str(tmp_path / "at")).trigger(availableNow=True).start()
        assert q.awaitTermination(300) and q.exception() is None
    assert visible(store) == visible(clean)


def test_last_fetch_of_a_batch_counts_and_nothing_is_fetched(spark, tmp_path):
    store = PublishStore(spark, str(tmp_path / "s"))
    assert store.read("blocks").collect() == [] and store.current_blocks().collect() == []
    publish_store.publish(store, frame(spark, 0).unionByName(frame(spark, 3)), 0)
    assert [r.fingerprint for r in store.current_blocks().where("page_id = 1").orderBy("ordinal").collect()] == list("abdz")
    publish_store.publish(store, frame(spark, 0).limit(0), 1)
    assert store.commits() == [0, 1] and store.read("decisions").where("commit = 1").count() == 0

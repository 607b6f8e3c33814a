"""Publishing fetched pages as whole commits.

A commit writes everything that a batch of fetches leads to: decisions, versions, pointers to the current versions, blocks, changes, states
of translations and jobs. Each table has a folder for each commit. Nothing of it is visible until the last step, in which one small file
with the commit's number gets its final name among the manifests. Readers take the manifests first and read the
folders of those commits only; so a commit that is broken off half-way shows nothing, and its number, taken again, writes over
what it left. A number that has a manifest is done: publishing it again changes nothing. With the batch numbers of
Structured Streaming that makes each batch count exactly once.

Commits are made one after the other, in ascending numbers, by one writer; readers need no lock. A batch reads the visible rows of its own pages only
as far as decisions need them: fingerprints of versions, and blocks of current ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import page_fingerprint
from ..storage import names, rename, stored
from .diff import diff_blocks
from .publish import inherit_states, paired_blocks, publish_decisions, translation_jobs

TABLES = {
    "decisions": "page_id long, decision string, version long",
    "versions": "page_id long, version long, fingerprint string",
    "pointers": "page_id long, version long",
    "blocks": "page_id long, version long, block_id long, ordinal int, block_type string, fingerprint string, translatable boolean",
    "changes": "page_id long, kind string, previous_index int, current_index int",
    "states": "block_id long, status string, reason string, current_revision_id long",
    "jobs": "block_id long, dedupe_key string, priority int",
}


@dataclass(frozen=True)
class PublishStore:
    spark: SparkSession
    path: str

    def commits(self) -> list[int]:
        return [int(n) for n in names(self.spark, f"{self.path}/manifests") if n.isdigit()]

    def read(self, table: str) -> DataFrame:
        """Visible rows of a table, with their `commit`."""
        done = self.commits()
        schema = f"{TABLES[table]}, commit long"
        if not done:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.path}/{table}/commit={n}" for n in done]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}").parquet(*paths)

    def current(self) -> DataFrame:
        """page_id, version that each page points to."""
        return self.read("pointers").groupBy("page_id").agg(F.max_by("version", "commit").alias("version"))

    def current_blocks(self) -> DataFrame:
        return self.read("blocks").drop("commit").join(self.current(), ["page_id", "version"])

    def states(self) -> DataFrame:
        """The state of each block's translation as last written."""
        return self.read("states").groupBy("block_id").agg(F.max_by(F.struct("status", "reason", "current_revision_id"), "commit").alias("s")).select("block_id", "s.*")

    def _stage(self, table: str, commit: int, rows: DataFrame) -> None:
        columns = self.spark.createDataFrame([], TABLES[table]).schema
        typed = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in columns])
        typed.write.mode("overwrite").parquet(f"{self.path}/{table}/commit={commit}")

    def _commit(self, commit: int) -> None:
        """Make a commit visible: the manifest is written under another name and renamed."""
        staged, final = f"{self.path}/manifests/_staged-{commit}", f"{self.path}/manifests/{commit:012d}"
        self.spark.range(1).select(F.lit(commit).cast("string").alias("value")).coalesce(1).write.mode("overwrite").text(staged)
        if not rename(self.spark, staged, final):
            raise RuntimeError(f"commit {commit} is there already")


def last_fetches(fetched: DataFrame) -> DataFrame:
    """Of several fetches of a page, the blocks of the one with the largest fetch_id."""
    last = fetched.groupBy("page_id").agg(F.max("fetch_id").alias("fetch_id"))
    return fetched.join(last, ["page_id", "fetch_id"])


def publish(store: PublishStore, fetched: DataFrame, commit: int, translations: DataFrame | None = None, priority: int = 10) -> bool:
    """Publish the blocks (page_id, fetch_id, block_id, ordinal, block_type, fingerprint, translatable) of fetched pages as one commit; False if
    it has been made before. Block ids are new ids of the fetch. translations (block_id, status, current_revision_id) are the states of blocks now, by
    default those that the store holds."""
    done = store.commits()
    if commit in done:
        return False
    if done and commit < max(done):
        raise ValueError(f"commit {commit} comes after {max(done)}")
    new = stored(last_fetches(fetched), "fetched")
    pages = new.select("page_id").distinct()
    current = store.current().join(pages, "page_id", "left_semi")
    own = store.read("versions").drop("commit").join(pages, "page_id", "left_semi")
    versions = own.join(current.select("page_id", F.col("version").alias("_current")), "page_id", "left").select("page_id", "version", "fingerprint", F.coalesce(F.col("version") == F.col("_current"), F.lit(False)).alias("current"))
    decisions = stored(publish_decisions(new, versions), "decisions")
    published = decisions.where(F.col("decision") == "published").select("page_id", "version")
    fresh = stored(new.join(published, "page_id"), "published")
    old = store.read("blocks").drop("commit").join(current, ["page_id", "version"]).join(published.select("page_id"), "page_id", "left_semi")
    old = stored(old, "previous")
    every = stored(diff_blocks(old, fresh, every=True), "diff")
    pairs = paired_blocks(every, old, fresh)
    states = store.states() if translations is None else translations
    store._stage("decisions", commit, decisions)
    store._stage("versions", commit, fresh.groupBy("page_id", "version").agg(page_fingerprint("ordinal", "block_type", "fingerprint").alias("fingerprint")))
    store._stage("pointers", commit, decisions.where(F.col("decision") != "unchanged"))
    store._stage("blocks", commit, fresh)
    store._stage("changes", commit, every.where(F.col("kind") != "same"))
    store._stage("states", commit, inherit_states(pairs.where("translatable").select("block_id", "previous_id", "fingerprint"), old, states))
    store._stage("jobs", commit, translation_jobs(pairs.where("candidate").select("block_id", "fingerprint"), priority))
    store._commit(commit)
    return True


def publish_stream(fetched: DataFrame, store: PublishStore, checkpoint: str):
    """A streaming query, to be started, that publishes each micro-batch of fetched blocks as one commit. A page's blocks must come in one
    micro-batch, as they do when a fetch is one file or one record."""

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            publish(store, batch, number)

    return fetched.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)

"""Differences of two versions of a page's block sequence.

Matching is greedy and depends on order, so it runs page by page: exact matches (type and
fingerprint) take the nearest place, then blocks of one type pair up as modified by heading path and
equal neighbours. Each side's blocks become one array a page (a page has a bounded number of blocks),
the sides are joined, and candidates are looked up by what they share, so a page costs its blocks and
their matches.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADING, NEIGHBOUR = 10.0, 4.0
CHANGE = "page_id long, place int, kind string, previous_index int, current_index int, candidate boolean"
PAGES_AT_ONCE = 200


def _nearest(free: list[int], at: int) -> int:
    """Position in the sorted list of the value nearest to `at`, the smaller one on a tie."""
    i = bisect_left(free, at)
    if i and (i == len(free) or at - free[i - 1] <= free[i] - at):
        return i - 1
    return i


class _Free:
    """Previous blocks that are still unmatched, found by what they share with a current one; each list is sorted."""

    def __init__(self, rows: list[dict], unused: list[int]):
        self.rows, self.keys, self.lists = rows, {}, defaultdict(list)
        for i in unused:
            self.keys[i] = self.shared(rows, i)
            for k in self.keys[i]:
                self.lists[k].append(i)

    @staticmethod
    def shared(rows: list[dict], i: int) -> list[tuple]:
        """Keys of the ways in which two blocks of a type can be alike: heading path, block before, block after."""
        kind, heading = rows[i]["block_type"], rows[i]["heading_path"]
        before = rows[i - 1]["fingerprint"] if i else None
        after = rows[i + 1]["fingerprint"] if i + 1 < len(rows) else None
        out = []
        for h in (True, False):
            for b in ((True, False) if before is not None else (False,)):
                for a in ((True, False) if after is not None else (False,)):
                    if h or b or a:
                        out.append((kind, heading if h else None, before if b else None, after if a else None, h, b, a))
        return out

    def best(self, rows: list[dict], j: int) -> int | None:
        """The block with the highest score, the first on a tie. Among those alike in the same ways the nearest
        is best, so one of each way is looked at."""
        found = None
        for k in self.shared(rows, j):
            some = self.lists.get(k)
            if some:
                i = some[_nearest(some, j)]
                ways = set(self.keys[i]) & set(self.shared(rows, j))
                heading = any(w[4] for w in ways)
                score = HEADING * heading + NEIGHBOUR * max(w[5] + w[6] for w in ways) - abs(i - j) / 100
                if found is None or (score, -i) > found:
                    found = (score, -i)
        return None if found is None else -found[1]

    def take(self, i: int) -> None:
        for k in self.keys.pop(i):
            some = self.lists[k]
            del some[bisect_left(some, i)]


def match(previous: list[dict], current: list[dict]) -> tuple[dict[int, int], set[int]]:
    """current index -> previous index, and the current indexes that only pair up as modified."""
    same: dict[tuple, list[int]] = defaultdict(list)
    for i, b in enumerate(previous):
        same[b["block_type"], b["fingerprint"]].append(i)
    pairs: dict[int, int] = {}
    for j, b in enumerate(current):
        left = same[b["block_type"], b["fingerprint"]]
        if left:
            pairs[j] = left.pop(_nearest(left, j))
    used = set(pairs.values())
    free, modified = _Free(previous, [i for i in range(len(previous)) if i not in used]), set()
    for j in range(len(current)):
        if j not in pairs and (i := free.best(current, j)) is not None:
            pairs[j] = i
            modified.add(j)
            free.take(i)
    return pairs, modified


def changes(previous: list[dict], current: list[dict], every: bool = False) -> list[tuple]:
    """(kind, previous index, current index, candidate for translation), deletions last; blocks that stay as
    they are only if `every`."""
    pairs, modified = match(previous, current)
    out = []
    for j, b in enumerate(current):
        i = pairs.get(j)
        if i is None:
            out.append(("added", None, j, bool(b["translatable"])))
        elif j in modified:
            out.append(("modified", i, j, bool(b["translatable"])))
        elif i != j or every:
            out.append(("moved" if i != j else "same", i, j, False))
    kept = set(pairs.values())
    return out + [("deleted", i, None, False) for i in range(len(previous)) if i not in kept]


def diff_blocks(previous: DataFrame, current: DataFrame, every: bool = False) -> DataFrame:
    """CHANGE rows of every page. Both sides: page_id, ordinal, block_type, fingerprint, translatable and,
    if they have it, heading_path. Rows without a page are left out; a page on one side only is all
    added or all deleted."""

    def pages(df: DataFrame, name: str) -> DataFrame:
        path = F.col("heading_path").cast("string") if "heading_path" in df.columns else F.lit("")
        block = F.struct("ordinal", "block_type", "fingerprint", path.alias("heading_path"), "translatable")
        return df.where(F.col("page_id").isNotNull()).groupBy("page_id").agg(F.array_sort(F.collect_list(block)).alias(name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "place", "kind", "previous_index", "current_index", "candidate"]
        types = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.bool_()]
        for batch in batches:
            for start in range(0, batch.num_rows, PAGES_AT_ONCE):
                found = [
                    (r["page_id"], n, *c) for r in batch.slice(start, PAGES_AT_ONCE).to_pylist() for n, c in enumerate(changes(r["previous"] or [], r["current"] or [], every))
                ]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate(types)], names=names)

    return pages(previous, "previous").join(pages(current, "current"), "page_id", "full").mapInArrow(run, CHANGE)

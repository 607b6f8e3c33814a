"""Navigation of all parents at once: the tree of paths with pre-order intervals.

Every prefix of a page's path is a node. Sorted by path, with the separator before all other characters, a node's
descendants follow it directly; `pre` is a node's place in that order and `last` that of its last descendant. So what lies below a
node is a range of `pre`, children are the rows of the range one level deeper, and counts are differences. The table is
written in order of `pre`: files and row groups hold short ranges, and a lookup reads only those that meet its range.

The order is a sort by range over all tasks; the driver sees a number of rows for each partition. Labels are those of
navigation.children(). Control characters don't occur in paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SITE, Site
from ..storage import stored
from .navigation import segment_label

SEPARATOR = "\x01"


def _prefixes(path: Column, site: Site) -> Column:
    """Prefixes of a path below the root, shortest first."""
    parts = F.split(F.substring(path, len(site.root) + 2, 1 << 20), "/")
    up_to = lambda n: F.concat(F.lit(f"{site.root}/"), F.array_join(F.slice(parts, 1, n), "/"))
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), up_to(n).alias("path")))


def nodes(pages: DataFrame, site: Site = SITE) -> DataFrame:
    """path, depth, parent, segment, is_page, has_children, title, pages (below it, itself included), of each node below the root that leads
    to an active page."""
    active = pages.where((F.col("status") == "active") & F.col("path").startswith(f"{site.root}/")).select("page_id", F.col("path").alias("_page"), "title")
    rows = active.select("page_id", "_page", "title", F.explode(_prefixes(F.col("_page"), site)).alias("n"))
    exact = F.col("n.path") == F.col("_page")
    title = F.max_by(F.when(exact, F.trim("title")), F.when(exact, F.col("page_id")))
    found = rows.groupBy(F.col("n.path").alias("path"), F.col("n.depth").alias("depth")).agg(
        F.bool_or(exact).alias("is_page"), F.bool_or(~exact).alias("has_children"), title.alias("title"), F.count("*").alias("pages")
    )
    segment = F.substring_index("path", "/", -1)
    parent = F.left("path", F.length("path") - F.length("segment") - 1)
    return found.withColumn("segment", segment).withColumn("parent", parent)


def path_tree(pages: DataFrame, site: Site = SITE) -> DataFrame:
    """nodes() with label, pre and last, stored in order of pre."""
    held = stored(nodes(pages, site), "nodes")
    below = held.select(F.explode(_prefixes(F.col("path"), site)).alias("n")).groupBy(F.col("n.path").alias("_path")).agg(F.count("*").alias("_nodes"))
    key = F.translate("path", "/", SEPARATOR)
    sized = held.join(below, F.col("path") == F.col("_path")).drop("_path").withColumn("_key", key)
    placed = stored(sized.repartitionByRange("_key").sortWithinPartitions("_key").withColumn("_at", F.monotonically_increasing_id()), "tree-order")
    offset, begin = 0, []
    for r in placed.groupBy(F.shiftright("_at", 33).cast("int").alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():  # one row a partition
        begin.append((r["p"], offset))
        offset += r["n"]
    starts = F.broadcast(pages.sparkSession.createDataFrame(begin, "_p int, _offset long"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = placed.join(starts, F.shiftright("_at", 33).cast("int") == F.col("_p")).withColumn("pre", F.col("_offset") + inside)
    # the root lists its fixed sections only, by their own labels
    known = F.create_map(*[F.lit(x) for s, label in site.sections for x in (s, label)]) if site.sections else F.create_map().cast("map<string,string>")
    label = F.when(F.col("depth") == 1, F.try_element_at(known, F.col("segment"))).otherwise(F.coalesce(F.nullif(F.col("title"), F.lit("")), segment_label(F.col("segment"), site)))
    columns = ["path", "depth", "parent", "is_page", "has_children", "pages", "label", "pre", "last"]
    out = numbered.withColumns({"label": label, "last": F.col("pre") + F.col("_nodes") - 1}).select(*columns)
    return stored(out.repartitionByRange("pre").sortWithinPartitions("pre"), "tree")


def all_children(tree: DataFrame) -> DataFrame:
    """parent, path, label, is_page, has_children of the children of all parents, those of a parent together and in order of their labels."""
    shown = tree.where(F.col("label").isNotNull())
    return shown.select("parent", "path", "label", "is_page", "has_children").orderBy("parent", F.lower("label"), "label", "path")


def interval(tree: DataFrame, path: str) -> tuple[int, int, int] | None:
    """pre, last and depth of a node."""
    row = tree.where(F.col("path") == path).select("pre", "last", "depth").first()
    return tuple(row) if row else None


def below(tree: DataFrame, path: str) -> DataFrame:
    """The nodes below a node, in order of the tree."""
    at = interval(tree, path)
    rows = tree.where(F.lit(False)) if at is None else tree.where((F.col("pre") > at[0]) & (F.col("pre") <= at[1]))
    return rows.orderBy("pre")


def children_of(tree: DataFrame, path: str) -> DataFrame:
    at = interval(tree, path)
    depth = at[2] + 1 if at else 0
    return below(tree, path).where((F.col("depth") == depth) & F.col("label").isNotNull()).select("path", "label", "is_page", "has_children").orderBy(F.lower("label"), "label", "path")

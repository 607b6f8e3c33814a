"""Navigation: entries below a path, the children of a node, and their labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SITE, Site


def parse_parent(value: Column, site: Site = SITE) -> Column:
    """A valid parent path, or null: at most 500 characters, decoded, no dot segments, not empty."""
    decoded = F.try_url_decode(value)
    clean = F.regexp_replace(decoded, "/+$", "")
    ok = (F.length(value) <= 500) & clean.rlike(rf"^{site.root}(?:/[A-Za-z0-9._~-]+)*$") & ~clean.rlike(r"/\.{1,2}(?:/|$)")
    return F.when(ok, clean)


def entries_below(pages: DataFrame, parent: str) -> DataFrame:
    return pages.where((F.col("status") == "active") & F.col("path").startswith(f"{parent}/")).select("page_id", "path", "title").orderBy("path")


def segment_label(segment: Column, site: Site = SITE) -> Column:
    """Words of a path segment, each with a capital, acronyms all in capitals."""
    words = F.filter(F.split(segment, "-"), lambda w: w != "")
    shown = F.transform(words, lambda w: F.when(F.lower(w).isin(sorted(site.acronyms)), F.upper(w)).otherwise(F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 20))))
    return F.array_join(shown, " ")


def children(pages: DataFrame, parent: str, site: Site = SITE) -> DataFrame:
    """path, label, is_page, has_children of the nodes under `parent`; the root lists its fixed sections
    that have pages. Labels are titles where a node is a page, else made from the segment."""
    below = entries_below(pages, parent)
    rest = F.substring(F.col("path"), len(parent) + 2, 1 << 20)
    segment = F.split_part(rest, F.lit("/"), F.lit(1))
    rows = below.withColumns({"segment": segment, "exact": rest == segment})
    nodes = rows.groupBy("segment").agg(
        F.bool_or("exact").alias("is_page"), F.bool_or(~F.col("exact")).alias("has_children"), F.max_by(F.when(F.col("exact"), F.trim("title")), F.when(F.col("exact"), F.col("page_id"))).alias("title")
    )
    path = F.concat(F.lit(f"{parent}/"), "segment")
    if parent == site.root:
        labels = pages.sparkSession.createDataFrame([(i, s, label) for i, (s, label) in enumerate(site.sections)], "place int, segment string, label string")
        return nodes.join(F.broadcast(labels), "segment").select("place", path.alias("path"), "label", "is_page", "has_children").orderBy("place")
    label = F.coalesce(F.nullif(F.col("title"), F.lit("")), segment_label(F.col("segment"), site))
    return nodes.select(path.alias("path"), label.alias("label"), "is_page", "has_children").orderBy(F.lower("label"), "label", "path")

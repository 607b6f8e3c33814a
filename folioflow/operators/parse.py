"""Pages of either format to blocks: text is read as Markdown, the rest as HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import parse_html, parse_markdown
from .parse_markdown import Limits


def parse_sources(sources: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Blocks of sources (page_id, format: text or html, body): page_id, format, ordinal, block_type, source_text,
    heading_path, error. A page without a format is one row with an error."""
    kind = F.coalesce("format", F.lit(""))
    columns = ["page_id", "ordinal", "block_type", "source_text", "heading_path", "error"]
    text = parse_markdown.parse_pages(sources.where(kind == "text"), text_col="body", limits=limits).select(F.lit("text").alias("format"), *columns)
    html = parse_html.parse_pages(sources.where(kind == "html"), html_col="body", limits=limits).select(F.lit("html").alias("format"), *columns)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("ordinal", "int"), ("block_type", "string"), ("source_text", "string"), ("heading_path", "array<string>"))]
    other = sources.where(~kind.isin("text", "html")).select("format", F.col("page_id").cast("long").alias("page_id"), *none, F.lit("unknown_format").alias("error"))
    return text.unionByName(html).unionByName(other)

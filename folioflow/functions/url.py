"""URL policies as Column expressions: canonical forms of page and resource URLs, or an error code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import SITE, Site
from .text import recognizable_text

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?([^/?#:@]+)(?::([0-9]+))?([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(F.trim(url), _URL, i)


def _same_origin(url: Column, site: Site) -> Column:
    """Error code of a URL that isn't https on the site's host and default port; else null."""
    scheme, host = site.origin.split("://")
    port = _part(url, 4)
    return (
        F.when(url.isNull() | ~F.trim(url).rlike(_URL), "invalid_url").when(F.lower(_part(url, 1)) != scheme, "scheme").when(_part(url, 2) != "", "user_info")
        .when(F.lower(_part(url, 3)) != host, "origin").when((port != "") & (port != "443"), "origin")
    )


def _path(url: Column) -> Column:
    return F.regexp_replace(_part(url, 5), r"/(?:\./)+", "/")


def canonical_page(url: Column, site: Site = SITE) -> Column:
    """struct(url, error) of a page's URL: no query, under the root, not the text form; trailing slashes
    and the fragment go."""
    path = F.regexp_replace(_path(url), "/+$", "")
    error = F.coalesce(
        _same_origin(url, site),
        F.when(_part(url, 6) != "", "query").when(path.rlike(r"/\.\.(?:/|$)"), "dot_segments")
        .when(~((path == site.root) | path.startswith(f"{site.root}/")), "path").when(F.endswith(path, F.lit(site.text_suffix)), "text_form"),
    )
    return F.struct(F.when(error.isNull(), F.concat(F.lit(site.origin), path)).alias("url"), error.alias("error"))


def canonical_resource(url: Column, site: Site = SITE) -> Column:
    """struct(url, error) of any resource of the same origin; its query stays, the fragment goes."""
    path = F.when(_path(url) == "", "/").otherwise(_path(url))
    error = _same_origin(url, site)
    return F.struct(F.when(error.isNull(), F.concat(F.lit(site.origin), path, _part(url, 6))).alias("url"), error.alias("error"))


def text_form(url: Column, site: Site = SITE) -> Column:
    """URL of the text representation of a canonical page."""
    page = canonical_page(url, site)
    return F.when(page["error"].isNull(), F.concat(page["url"], F.lit(site.text_suffix)))


def source_format(url: Column, site: Site = SITE) -> Column:
    return F.when(F.endswith(_part(url, 5), F.lit(site.text_suffix)), "text").otherwise("html")


def classify_status(status: Column, retry_after: Column) -> Column:
    """struct(result, retryable, retry_after_s) of an HTTP status."""
    result = (
        F.when(status == 304, "not_modified").when(status.between(200, 299), "ok").when(status.isin(404, 410), "gone").when(status == 429, "rate_limited")
        .when(status >= 500, "server_error").when(status.isin(401, 403), "forbidden").otherwise("unexpected_status")
    )
    retryable = (status == 429) | (status >= 500)
    wait = F.when(retryable & retry_after.rlike("^[0-9]+$"), retry_after.cast("long"))
    return F.struct(result.alias("result"), F.coalesce(retryable, F.lit(False)).alias("retryable"), wait.alias("retry_after_s"))


def image_parts(text: Column) -> Column:
    """struct(alt, caption) of an image block's text: its first and second line."""
    lines = F.split(text, "\n", 2)
    return F.struct(F.get(lines, F.lit(0)).alias("alt"), F.get(lines, F.lit(1)).alias("caption"))


def https_only(url: Column) -> Column:
    return F.when(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))) == "https", url)


#: Content types of a page's text and HTML forms.
TEXT_TYPES = ("text/plain", "text/markdown", "text/x-markdown", "application/markdown")
HTML_TYPES = ("text/html", "application/xhtml+xml")


def media_type(header: Column) -> Column:
    """A Content-Type header's type, in lower case, without parameters."""
    return F.lower(F.trim(F.split_part(F.coalesce(header, F.lit("")), F.lit(";"), F.lit(1))))


def fetch_result(text: Column, html: Column) -> Column:
    """struct(kind, format, error) of fetching a page. Both are structs (status, content_type, body): the answer for the text form, and the
    one for the HTML form, which counts if the text form is missing, not acceptable, no text by its type, or not recognisable as a page's text."""
    answer = lambda kind, form, error: F.struct(F.lit(kind).alias("kind"), F.lit(form).alias("format"), (F.lit(error) if isinstance(error, str) else error).cast("string").alias("error"))

    def plain(part: Column, form: str) -> Column:
        status = part["status"]
        failed = ~status.between(200, 299)
        return F.when(status == 304, answer("not_modified", form, F.lit(None))).when(status.isin(404, 410), answer("gone", form, F.lit(None))).when(failed, answer("failed", form, classify_status(status, F.lit(None))["result"]))

    fallback = text["status"].isin(404, 406) | (text["status"].between(200, 299) & ~(media_type(text["content_type"]).isin(*TEXT_TYPES) & F.coalesce(recognizable_text(text["body"]), F.lit(False))))
    kind = media_type(html["content_type"]).isin(*HTML_TYPES)
    blank = F.length(F.regexp_replace(F.coalesce(html["body"], F.lit("")), r"\s+", "")) == 0
    from_html = F.coalesce(
        plain(html, "html"), F.when(~kind, answer("failed", "html", "content_type_invalid")).when(blank, answer("failed", "html", "content_empty")).otherwise(answer("content", "html", F.lit(None)))
    )
    return F.when(fallback, from_html).otherwise(F.coalesce(plain(text, "text"), answer("content", "text", F.lit(None))))

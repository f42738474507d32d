"""Urls to hosts, names and paths, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _without_scheme(url: Column) -> Column:
    return F.regexp_replace(url, r"^https?://", "")


def url_domain(url: Column | str) -> Column:
    """What stands before the first slash, without ``http(s)://``; port and user stay."""
    return F.substring_index(_without_scheme(_column(url)), "/", 1)


def url_file_path(url: Column | str) -> Column:
    """The path a page is fetched to: no decoding, ``.html`` added, ``index.html`` for a folder, empty without a slash."""
    parts = F.split(_without_scheme(_column(url)), "/")
    rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    joined = F.array_join(rest, "/")
    return F.when(F.size(parts) <= 1, F.lit("")).when(F.element_at(parts, -1) == "", F.concat(joined, F.lit("index.html"))).otherwise(F.concat(joined, F.lit(".html")))


def url_stem(url: Column | str) -> Column:
    """The decoded path after the host, or null without a scheme or a slash.

    ``+`` stays as it is.  A path that can't be decoded is kept undecoded; one
    that decodes to bytes which aren't UTF-8 is null.
    """
    u = _column(url)
    path = F.regexp_extract(u, r"(?s)^.*?://[^/]*/(.*)$", 1)
    found = F.regexp_like(u, F.lit(r"(?s)^.*?://[^/]*/.*$"))
    decoded = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    broken = F.contains(decoded, F.lit("�")) & ~F.contains(path, F.lit("�"))
    return F.when(found & ~F.coalesce(broken, F.lit(False)), F.coalesce(decoded, path))


def topic(url: Column | str) -> Column:
    """The last segment of the decoded path, in lower case: what two corpora have in common."""
    return F.lower(F.substring_index(url_stem(url), "/", -1))

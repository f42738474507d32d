"""Labels of entries and buckets of parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Icons of page types.
ICONS = {
    "article": "📄", "user": "👤", "person": "👤", "profile": "👤", "category": "📂", "section": "📂", "disambiguation": "🤔", "search": "🔍",
    "product": "🛍️", "store": "🏬", "movie": "🎬", "user_list": "📋", "video": "📹", "news_article": "📰", "tag": "🏷️", "special": "✨",
    "neutral": "", "biased": "😡", "grok": "🤖", "wiki": "📚", "": "",
}

#: Bytes from which a segment of a label is cut.
SEGMENT_BYTES = 10


def icon(page_type: Column | str, strict: bool = False) -> Column:
    """Icon of a page type, which is trimmed and lower-cased; null if unknown, or an error if strict."""
    kind = F.lower(F.trim(F.col(page_type) if isinstance(page_type, str) else page_type))
    icons = F.create_map(*[F.lit(x) for pair in ICONS.items() for x in pair])
    found = F.try_element_at(icons, kind)
    if strict:
        return F.when(kind.isNull() | found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("unknown page type: "), kind)))
    return found


def page_label(url: Column | str, page_type: Column | str, strict: bool = False) -> Column:
    """``/`` and the path of a url, long segments cut, and the icon.

    A segment of more than 10 bytes keeps its first 10 bytes; where that would
    part a character, its first 10 characters.  An unknown type has no icon.
    """
    u = F.col(url) if isinstance(url, str) else url
    after = F.coalesce(F.get(F.split(u, "://"), F.lit(1)), F.lit(""))
    pieces = F.split(after, "/")
    path = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
    short = F.transform(path, lambda p: F.when(F.octet_length(p) > SEGMENT_BYTES, F.concat(F.left(p, F.lit(SEGMENT_BYTES)), F.lit("…"))).otherwise(p))
    label = F.concat(F.lit("/"), F.array_join(short, "/"), F.lit(" "), F.coalesce(icon(page_type, strict), F.lit("")))
    return F.when(u.isNotNull(), label)


def short_label(label: Column | str) -> Column:
    """The last segment of a label, with its icon."""
    return F.substring_index(label, "/", -1)


def quality_bucket(quality: Column | str) -> Column:
    q = F.col(quality) if isinstance(quality, str) else quality
    return F.when(q <= 2, "0-2").when(q <= 5, "3-5").when(q <= 8, "6-8").when(q.isNotNull(), "9+")


def hover_text(lg_window_size: Column | str, quality: Column | str) -> Column:
    return F.format_string("lg_window: %s, quality: %s", F.coalesce(F.col(lg_window_size).cast("string"), F.lit("-")), F.col(quality).cast("string"))

"""What a source string or a server's headers say, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts of watch pages, and media types of web pages.
SHORT_HOST, WATCH_HOST = "youtu.be", "youtube.com"
PAGE_TYPES = ["text/html", "application/xhtml+xml"]


def scheme(value: Column) -> Column:
    return F.lower(F.regexp_extract(value, r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def host(value: Column) -> Column:
    """The host of a URL in lower case, without user and port; empty for anything else."""
    place = F.regexp_extract(value, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(place, r"^.*@", ""), r":\d*$", ""))


def path(value: Column) -> Column:
    return F.regexp_extract(value, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def is_watch_page(value: Column) -> Column:
    """Whether a URL is a known page about a video and no video file."""
    h, p = host(value), F.lower(F.regexp_replace(path(value), r"/+$", ""))
    inside = lambda name: (h == name) | F.endswith(h, F.lit("." + name))
    return inside(SHORT_HOST) | (inside(WATCH_HOST) & (p == "/watch"))


def classify(value: Column) -> tuple[Column, Column]:
    """The kind of a source (``http`` or ``file``) and what is wrong with it, of which one is null. Whether a file exists is for the caller to see."""
    v = F.trim(F.coalesce(value, F.lit("")))
    error = (
        F.when(v == "", "blank")
        .when(F.contains(v, F.lit("://")) & ~scheme(v).isin("http", "https"), "unsupported scheme")
        .when(F.contains(v, F.lit("://")) & (host(v) == ""), "no host")
        .when(is_watch_page(v), "web page")
    )
    kind = F.when(error.isNull(), F.when(F.contains(v, F.lit("://")), "http").otherwise("file"))
    return kind, error


def is_page_type(content_type: Column) -> Column:
    return F.lower(F.trim(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1)))).isin(PAGE_TYPES)


def content_length(header: Column) -> Column:
    """A header's length as a positive number, else null."""
    n = F.trim(header).try_cast("bigint")
    return F.when(n > 0, n)


def download_name(disposition: Column, url: Column) -> Column:
    """A safe file name from a disposition header, else from the URL's path."""
    starred = F.regexp_extract(disposition, r"(?i)filename\*=UTF-8''([^;]+)", 1)
    quoted = F.regexp_extract(disposition, r"(?i)filename=\"?([^\";]+)", 1)
    named = F.coalesce(F.nullif(starred, F.lit("")), F.nullif(quoted, F.lit("")), F.regexp_extract(path(url), r"([^/]*)$", 1))
    last = F.regexp_extract(F.try_url_decode(F.replace(named, F.lit("+"), F.lit("%2B"))), r"([^/]*)$", 1)
    safe = F.regexp_replace(F.regexp_replace(last, r"^[ .]+|[ .]+$", ""), r"[<>:\"/\\|?*\x00-\x1f]", "_")
    full = F.when(safe == "", F.lit("downloaded_video.mp4")).otherwise(safe)
    return F.when(full.rlike(r".\.[^.]+$"), full).otherwise(F.concat(full, F.lit(".mp4")))

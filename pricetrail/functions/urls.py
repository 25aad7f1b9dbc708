"""URL parts, trusted-source checks and image picks."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricetrail.functions.binding import let
from pricetrail.functions.text import strip

#: scheme, userinfo, host, port, path, query, fragment
_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?([^/?#:]*)(?::([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
_GROUP = {"scheme": 1, "userinfo": 2, "host": 3, "port": 4, "path": 5, "query": 6, "fragment": 7}
_THUMBNAIL = r"/thumbnails/(\d+)/(\d+)/"
# Fixed value: the largest side of a thumbnail a phone keeps.
THUMBNAIL_SIDE = 225


def url_part(c: Column, part: str) -> Column:
    """One part of an absolute URL ('' when absent); 'file' is the last path segment."""
    if part == "file":
        return F.element_at(F.split(url_part(c, "path"), "/"), -1)
    value = F.regexp_extract(c, _URL, _GROUP[part])
    if part in ("scheme", "host"):
        return F.lower(value)
    return F.substring(value, 2, 1 << 30) if part == "query" else value


def _without_dots(path: Column) -> Column:
    """Resolve '.' and '..' segments of an absolute path."""
    segments = F.split(path, "/")
    last = F.element_at(segments, -1)
    kept = F.aggregate(
        segments,
        F.array(F.lit("")),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1))))
        .when((s == ".") | (s == ""), F.when((s == ""), F.concat(acc, F.array(s))).otherwise(acc))
        .otherwise(F.concat(acc, F.array(s))),
    )
    joined = F.array_join(F.slice(kept, 2, F.size(kept)), "/")
    closed = F.when(last.isin(".", ".."), F.concat(joined, F.lit("/"))).otherwise(joined)
    return F.when(path.contains("/."), closed).otherwise(path)


def absolute_url(raw: Column, base: Column) -> Column:
    """Resolve a reference against a page's URL."""
    origin = F.concat(url_part(base, "scheme"), F.lit("://"), F.regexp_extract(base, r"^[^:]+://([^/?#]*)", 1))
    path = url_part(base, "path")
    folder = F.when(path == "", "/").otherwise(F.regexp_replace(path, r"[^/]*$", ""))
    whole = F.concat(origin, path, F.regexp_extract(base, _URL, 6))
    tail = F.regexp_extract(raw, r"^([^?#]*)(.*)$", 2)
    own = F.regexp_extract(raw, r"^([^?#]*)", 1)
    return (
        F.when(raw.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), raw)
        .when(raw.startswith("//"), F.concat(url_part(base, "scheme"), F.lit(":"), raw))
        .when(raw.startswith("/"), F.concat(origin, _without_dots(own), tail))
        .when(raw.startswith("?"), F.concat(origin, path, raw))
        .when((raw == "") | raw.startswith("#"), F.concat(whole, raw))
        .otherwise(F.concat(origin, _without_dots(F.concat(folder, own)), tail))
    )


def _trusted(host: str, rest: str) -> str:
    """Pattern of an https URL on a host, without user info, on the default port."""
    return rf"^(?i:https)://(?i:{host})(?::(?:443)?)?{rest}"


def public_url(raw: Column, host: str, base: Column | None = None) -> Column:
    """Absolute URL on the shop's host without its fragment; null when it is not trusted."""
    full = absolute_url(raw, F.lit(f"https://{host}/") if base is None else base)
    pattern = _trusted(re.escape(host), r"(?=[/?#]|$)")
    return let(full, lambda u: F.when(u.rlike(pattern), F.regexp_replace(u, "#.*$", "")))


def openable_url(c: Column, host: str) -> Column:
    """Link a client may open: also on www., and with a real path."""
    text = strip(c)
    return F.when(text.rlike(_trusted(rf"(?:www\.)?{re.escape(host)}", r"/[^?#]")), text)


def suitable_thumbnail(c: Column) -> Column:
    """True for /thumbnails/W/H/ with both sides in 1..225."""
    path = url_part(c, "path")
    sides = [F.regexp_extract(path, _THUMBNAIL, i).try_cast("decimal(38,0)") for i in (1, 2)]
    fits = F.lit(True)
    for side in sides:
        fits = fits & F.coalesce(side.between(1, THUMBNAIL_SIDE), F.lit(False))
    return fits


def needs_image(observed: Column, thumbnail: Column) -> Column:
    """Refresh when a picture was observed and the stored thumbnail is unfit or shows another file."""
    seen = observed.isNotNull() & (observed != "")
    same = F.coalesce(url_part(observed, "file") == url_part(thumbnail, "file"), F.lit(False))
    return seen & (~F.coalesce(suitable_thumbnail(thumbnail), F.lit(False)) | ~same)


def pick_images(sources: Column, host: str) -> Column:
    """struct(thumb, full, error) from src/srcset texts: first fitting thumbnail, last candidate."""
    items = F.flatten(F.transform(sources, lambda s: F.split(F.coalesce(s, F.lit("")), ",")))
    links = F.transform(items, lambda s: F.regexp_extract(strip(s), r"^(\S*)", 1))
    links = F.filter(links, lambda s: (s != "") & ~s.startswith("data:"))
    urls = F.array_distinct(F.transform(links, lambda s: public_url(s, host)))

    def picked(found: Column) -> Column:
        clean = F.filter(found, lambda u: u.isNotNull())
        return F.struct(
            F.get(F.filter(clean, suitable_thumbnail), F.lit(0)).alias("thumb"),
            F.get(clean, F.size(clean) - 1).alias("full"),
            F.when(F.exists(found, lambda u: u.isNull()), "unexpected source url").alias("error"),
        )

    return let(urls, picked)

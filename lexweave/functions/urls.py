"""URL expressions: keys, hosts, normal forms, tests."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# What is never crawled.
SKIP_ANYWHERE = (".jpg", ".jpeg", ".png", ".gif", ".svg", ".ico", ".mp4", ".avi", ".mov", ".zip", ".rar", ".gz", ".css", ".js", ".xml", ".rss", ".json", ".php?")
SKIP_PATHS = ("/wp-content/", "/wp-includes/", "/feed/", "/tag/", "/page/", "/cdn-cgi/", "/wp-json/")


def key(url: Column) -> Column:
    return F.substring(F.md5(url), 1, 12)


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def is_internal(url: Column, domain: str) -> Column:
    """Whether the domain occurs in the host, anywhere in it."""
    return F.contains(host(url), F.lit(domain))


def is_skipped(url: Column) -> Column:
    anywhere = "|".join(re.escape(x) for x in SKIP_ANYWHERE)
    paths = "|".join(re.escape(x) for x in SKIP_PATHS)
    return F.lower(url).rlike(anywhere) | path(url).rlike(f"^(?:{paths})")


def without_dot_segments(path: Column) -> Column:
    """``.`` and ``..`` taken out of a path that begins with a slash, from left to right (RFC 3986, 5.2.4); empty segments inside go too."""

    def step(done: Column, x: Column) -> Column:
        return F.when(x == "..", F.regexp_replace(done, "/[^/]*$", "")).when(x == ".", done).otherwise(F.concat(done, F.lit("/"), x))

    def folded(parts: Column) -> Column:
        kept = F.filter(parts, lambda x, k: (k > 0) & ((x != "") | (k == F.size(parts) - 1)))
        return F.concat(F.aggregate(kept, F.lit(""), step), F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise(""))

    return let(F.split(path, "/"), folded)


def normalised(href: Column, base: Column) -> Column:
    """Absolute form of ``href`` (RFC 3986, 5.2.2) without fragment and trailing slashes."""
    ref, whole = F.regexp_replace(href, "(?s)#.*$", ""), F.regexp_replace(base, "(?s)#.*$", "")
    bare = F.regexp_replace(whole, r"(?s)\?.*$", "")
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    own = F.regexp_extract(ref, r"^([^?]*)", 1)
    folder = F.regexp_replace(F.concat(F.substr(bare, F.length(origin) + 1)), "[^/]*$", "")
    path = F.when(own.startswith("/"), own).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), own))
    full = (
        F.when(ref.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
        .when(ref.startswith("//"), F.concat(scheme, ref))
        .when(ref == "", whole)
        .when(ref.startswith("?"), F.concat(bare, ref))
        .otherwise(F.concat(origin, without_dot_segments(path), F.substr(ref, F.length(own) + 1)))
    )
    return F.regexp_replace(full, "/+$", "")


def pdf_name(url: Column) -> Column:
    """Key, underscore and cleaned file stem, cut at 96 characters, then the extension."""
    name = F.regexp_extract(path(url), "([^/]*)$", 1)
    stem, ext = F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^.+?(\.[^.]*)$", 1)
    return F.concat(F.substring(F.regexp_replace(F.concat(key(url), F.lit("_"), stem), r"[^\p{L}\p{N}_.-]", "_"), 1, 96), ext)

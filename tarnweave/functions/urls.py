"""URL algebra as column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the generic split of a URI into scheme, authority, path, query and fragment.
PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
ONION_LENGTH = 16
_BAD = re.compile(r"[\x00-\x1f\x7f]|%(?![0-9A-Fa-f]{2})")


def parses(link: str) -> bool:
    """Whether a link is well-formed: no control characters or bad escapes before the query, no
    colon in the first path segment of a relative link, a plain port."""
    before = re.split(r"[?#]", link, maxsplit=1)[0]
    if _BAD.search(before) or re.search(r"[\x00-\x1f\x7f]", link):
        return False
    m = re.match(PARTS, link)
    if m[1] is None and ":" in before.split("/")[0]:
        return False
    if link.startswith(":"):
        return False
    host = (m[2] or "").rpartition("@")[2]
    return not host or bool(re.fullmatch(r"(\[[^\]]*\]|[^\[\]:<>\" ]*)(:[0-9]*)?", host))


def part(url: Column, which: str) -> Column:
    """One of scheme, authority, path, query, fragment; empty where missing."""
    return F.regexp_extract(url, PARTS, ("scheme", "authority", "path", "query", "fragment").index(which) + 1)


def host(url: Column) -> Column:
    """The host with its port, without user information."""
    return F.regexp_replace(part(url, "authority"), "^.*@", "")


def _join(scheme: Column, authority: Column, path: Column, query: Column, has_query: Column) -> Column:
    return F.concat(scheme, F.lit("://"), authority, path, F.when(has_query, F.concat(F.lit("?"), query)).otherwise(""))


def resolve(base: Column, link: Column) -> Column:
    """The link seen from the base; links with a scheme or host stand for themselves. Dot segments stay.

    Neither of the two may have a fragment, which extraction strips.
    """
    absolute = link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:")
    path, query = part(link, "path"), part(link, "query")
    own_query = query != ""
    base_path = part(base, "path")
    full = F.when(path == "", base_path).when(path.startswith("/"), path).otherwise(F.concat(F.regexp_replace(base_path, "[^/]*$", ""), path))
    # a base without a path takes a relative one at its root
    full = F.when((full != "") & ~full.startswith("/"), F.concat(F.lit("/"), full)).otherwise(full)
    inherit = (path == "") & ~own_query
    said = F.when(inherit, part(base, "query")).otherwise(query)
    here = _join(part(base, "scheme"), part(base, "authority"), full, said, said != "")
    return F.when(absolute, link).when(link.startswith("//"), F.concat(part(base, "scheme"), F.lit(":"), link)).otherwise(here)


def labels(hostname: Column) -> Column:
    return F.split(hostname, r"\.")


def crawlable(url: Column, onion: bool = False) -> Column:
    """Whether a link may be followed: an http scheme, a host of two labels, and what the mode asks of these."""
    name = host(url)
    parts = labels(name)
    base = part(url, "scheme").startswith("http") & (name != "") & (F.size(parts) >= 2)
    last, second = F.try_element_at(parts, F.lit(-1)), F.try_element_at(parts, F.lit(-2))
    if onion:
        return base & (last == "onion") & (F.length(repair_label(second)) == ONION_LENGTH)
    return base & (F.octet_length(last) >= 2) & (F.octet_length(second) >= 1)


def repair_label(label: Column) -> Column:
    """An onion label; one of the wrong length loses the characters outside its alphabet."""
    return F.when(F.length(label) == ONION_LENGTH, label).otherwise(F.regexp_replace(label, "[^a-zA-Z2-7]+", ""))


def repair_onion_host(hostname: Column) -> Column:
    parts = labels(hostname)
    n = F.size(parts)
    fixed = F.concat_ws(".", F.transform(parts, lambda x, i: F.when(i == n - 2, repair_label(x)).otherwise(x)))
    return F.when(F.try_element_at(parts, F.lit(-1)) == "onion", fixed).otherwise(hostname)


def registered_domain(hostname: Column, onion: bool = False) -> Column:
    """The last two labels, or in onion mode the one before the last; null for hosts of one label."""
    parts = labels(hostname)
    found = F.try_element_at(parts, F.lit(-2)) if onion else F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), ".")
    return F.when(F.size(parts) >= 2, found)


def relative(url: Column) -> Column:
    """Path and query alone; newlines and tabs of the query are escaped."""
    query = F.replace(F.replace(part(url, "query"), F.lit("\n"), F.lit("%0A")), F.lit("\t"), F.lit("%09"))
    return F.concat(part(url, "path"), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def origin(url: Column) -> Column:
    """Scheme and authority alone."""
    return F.concat(part(url, "scheme"), F.lit("://"), part(url, "authority"))


def uri_key(url: Column) -> Column:
    """The key of a page within its host: the relative URL without one slash at its end."""
    return F.regexp_replace(relative(url), r"/\z", "")


def is_internal(url: Column, domain: Column, onion: bool = False) -> Column:
    """Whether the link stays within the registered domain."""
    return F.coalesce(registered_domain(host(url), onion) == domain, F.lit(False))


def without_dots(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments; ``..`` at the root stays there."""
    parts = F.split(path, "/")
    step = lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.concat(acc, F.array(x)))
    kept = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.slice(parts, 1, 1), step)
    ends = F.element_at(parts, -1).isin(".", "..")
    return F.when(path == "", path).otherwise(F.concat(F.array_join(kept, "/"), F.when(ends, "/").otherwise("")))


def request_url(origin_url: Column, relative_url: Column) -> Column:
    """The URL to request for an item: its subdomain's origin and its relative URL, dot segments removed."""
    path, query = part(relative_url, "path"), part(relative_url, "query")
    path = F.when(path.startswith("/") | (path == ""), path).otherwise(F.concat(F.lit("/"), path))
    return F.concat(origin_url, without_dots(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))

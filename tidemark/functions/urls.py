"""URL column builders: hosts, resolution, normalisation, suffixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import vocab

_SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: Column, group: int) -> Column:
    """1 scheme, 2 network location, 3 path, 4 query, 5 fragment; empty when missing."""
    return F.regexp_extract(url, _SPLIT, group)


def host(url: Column) -> Column:
    return F.lower(part(url, 2))


def bare_host(url: Column) -> Column:
    """Host without a leading ``www.``."""
    return F.regexp_replace(host(url), r"^www\.", "")


def escape_non_ascii(text: Column) -> Column:
    """Percent-encode what is not ASCII and leave the rest alone."""
    encoded = F.array_join(F.transform(F.split(text, ""), lambda c: F.when(
        c.rlike(r"[^\x00-\x7f]"), F.url_encode(c)).when(c == " ", "%20").otherwise(c)), "")
    return F.when(text.rlike(r"[^\x00-\x7f ]| "), encoded).otherwise(text)


def resolve(base: Column, href: Column) -> Column:
    """Absolute form of a link found on a page."""
    root = F.concat(part(base, 1), F.lit("://"), part(base, 2))
    path = part(base, 3)
    folder = F.regexp_replace(path, r"[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    query = F.regexp_extract(base, r"(\?[^#]*)", 1)
    target = (F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
              .when(href.startswith("//"), F.concat(part(base, 1), F.lit(":"), href))
              .when(href.startswith("/"), F.concat(root, href))
              .when(href.startswith("#") | (href == ""), F.concat(root, path, query, href))
              .when(href.startswith("?"), F.concat(root, path, href))
              .otherwise(F.concat(root, folder, href)))
    return escape_non_ascii(target)


def suffixes(host_: Column) -> Column:
    """The host and each of its parent domains, longest first."""
    labels = F.split(host_, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)),
                       lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))


def normalise_url(url: Column) -> Column:
    """Tracking parameters and fragment dropped, blank parameters dropped, values grouped under the
    first place of their key, a slash at the end unless the path names a page file."""
    pairs = F.filter(F.split(part(url, 4), "&"), lambda p: p.rlike("^[^=]+=.+$"))
    decoded = F.transform(pairs, lambda p: F.struct(
        F.url_decode(F.regexp_extract(p, "^([^=]+)=", 1)).alias("k"), F.url_decode(F.regexp_extract(p, "^[^=]+=(.*)$", 1)).alias("v")))
    kept = F.filter(decoded, lambda p: ~F.lower(p["k"]).isin(vocab.TRACKING_PARAMS))
    keys = F.array_distinct(F.transform(kept, lambda p: p["k"]))
    grouped = F.flatten(F.transform(keys, lambda k: F.filter(kept, lambda p: p["k"] == k)))
    query = F.array_join(F.transform(grouped, lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&")
    path = part(url, 3)
    is_file = F.lit(False)
    for e in vocab.PAGE_EXTENSIONS:
        is_file = is_file | path.endswith(e)
    full = F.when(path.endswith("/") | is_file, path).otherwise(F.concat(path, F.lit("/")))
    scheme = F.lower(part(url, 1))
    return F.concat(F.when(scheme != "", F.concat(scheme, F.lit("://"))).otherwise(""), part(url, 2), full,
                    F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))

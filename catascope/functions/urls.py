"""URL predicates and normal form, all inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from catascope.functions.text import strip

_PCHAR = r"(?:[A-Za-z0-9._~!$&'()*+,;=:@-]|%[0-9A-Fa-f]{2})"
_USER = r"(?:[A-Za-z0-9._~!$&'()*+,;=:-]|%[0-9A-Fa-f]{2})*"
_HOST = r"(?:\[[0-9A-Fa-f:.vV]+\]|(?:[A-Za-z0-9._~!$&'()*+,;=-]|%[0-9A-Fa-f]{2})*)"
URI_PATTERN = (
    r"^[A-Za-z][A-Za-z0-9+.-]*:"
    rf"(?://(?:{_USER}@)?{_HOST}(?::[0-9]*)?(?:/{_PCHAR}*)*"
    rf"|/?(?:{_PCHAR}+(?:/{_PCHAR}*)*)?)"
    rf"(?:\?(?:{_PCHAR}|[/?])*)?(?:#(?:{_PCHAR}|[/?])*)?$"
)
# An address is recognised at the start of the text only.
EMAIL_PATTERN = r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+"


def domain(url: Column) -> Column:
    return F.regexp_extract(url, r"://([^/?#]+)", 1)


def url_valid(url: Column) -> Column:
    """Has a scheme and a host."""
    return F.coalesce(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"), F.lit(False))


def uri_valid(uri: Column) -> Column:
    """Follows the generic URI syntax."""
    return F.coalesce(uri.rlike(URI_PATTERN), F.lit(False))


def email_valid(c: Column) -> Column:
    return F.coalesce(c.rlike(EMAIL_PATTERN), F.lit(False))


def repair_url(url: Column) -> Column:
    """Drop a doubled scheme."""
    once = F.replace(url, F.lit("http:// \thttp:"), F.lit("http:"))
    return F.replace(once, F.lit("http:// http://"), F.lit("http://"))


def _escape(c: Column) -> Column:
    """Percent-encode what may not stand in a URL; existing triplets stay."""
    unsafe = r'[^\x21-\x7e]|["<>\\^`{|}]'
    one = lambda ch: F.when(
        ch.rlike(f"^(?:{unsafe})$"), F.replace(F.url_encode(ch), F.lit("+"), F.lit("%20"))
    ).otherwise(ch)
    return F.when(
        c.rlike(unsafe), F.array_join(F.transform(F.split(c, ""), one), "")
    ).otherwise(c)


def normalise_url(url: Column) -> Column:
    """Lower-case scheme and host, no default port, a path, escaped characters.

    Text without scheme and host is returned trimmed and escaped only.
    """
    u = strip(url)
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    authority = F.regexp_extract(u, r"://([^/?#]*)", 1)
    user = F.regexp_extract(authority, r"^(.*@)", 1)
    host = F.lower(F.regexp_replace(authority, r"^.*@", ""))
    host = F.when(scheme == "http", F.regexp_replace(host, r":(?:80)?$", "")).when(
        scheme == "https", F.regexp_replace(host, r":(?:443)?$", "")
    ).otherwise(host)
    rest = F.regexp_replace(u, r"^[^:/?#]+://[^/?#]*", "")
    rest = F.when(rest.rlike(r"^/"), rest).otherwise(F.concat(F.lit("/"), rest))
    fragment = F.when(rest.contains("?"), F.lit("&_escaped_fragment_=")).otherwise(
        F.lit("?_escaped_fragment_=")
    )
    rest = F.replace(rest, F.lit("#!"), fragment)
    full = F.concat(scheme, F.lit("://"), user, host, rest)
    return _escape(F.when(url_valid(u), full).otherwise(u))


def landing_page(software: Column, uri: Column, apiuri: Column, dataset_id: Column) -> Column:
    """Page of a dataset on its portal; other software uses the id itself."""
    at = lambda base, path: F.concat(F.rtrim(base, F.lit("/")), F.lit(path), dataset_id)
    return (
        F.when(software == "CKAN", at(apiuri, "/dataset/"))
        .when(software == "Socrata", at(uri, "/dataset/"))
        .when(software == "OpenDataSoft", at(uri, "/explore/dataset/"))
        .otherwise(dataset_id)
    )


def portal_id(url: Column) -> Column:
    """Id of a portal: host with dots and path with slashes as underscores."""
    path = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    tail = F.when(F.length(path) > 1, F.translate(path, "/", "_")).otherwise(F.lit(""))
    return F.concat(F.translate(domain(url), ".", "_"), tail)

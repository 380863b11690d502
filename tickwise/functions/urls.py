"""URL column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import PY_WS


def url_host(u: Column) -> Column:
    return F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def url_scheme(u: Column) -> Column:
    return F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)


def url_path(u: Column) -> Column:
    return F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def resolve_url(href: Column, base: Column) -> Column:
    """L2: a site-relative href (``/x``) gets the scheme and host of the page."""
    return F.when(F.startswith(href, F.lit("/")),
                  F.concat(url_scheme(base), F.lit("://"), url_host(base), href)).otherwise(href)


def canonical_url(u: Column, mode: str = "query_fragment") -> Column:
    """L3: scheme + host + path.  ``mode='query_only'`` cuts at '?' only (a fragment stays)."""
    if mode == "query_only":
        return F.regexp_replace(u, r"\?.*$", "")
    return F.regexp_replace(u, r"[?#].*$", "")


def url_date(u: Column, case_insensitive: bool = True) -> Column:
    """L5: 'YYYY-MM-DD' from a ``/news/<w>/YYYYMMDDn.aspx`` path, else null."""
    flags = "(?iU)" if case_insensitive else "(?U)"
    pat = flags + r"/news/\w+/(20\d{2})(\d{2})(\d{2})\d+\.aspx"
    y = F.regexp_extract(u, pat, 1)
    return F.when(y != "", F.concat_ws("-", y, F.regexp_extract(u, pat, 2), F.regexp_extract(u, pat, 3)))


def has_date_suffix(text: Column) -> Column:
    """Anchor text ends in 'YYYY/MM/DD HH:MM' (result links, not navigation)."""
    return F.coalesce(text.rlike(r"\d{4}/\d{2}/\d{2}" + PY_WS + r"+\d{2}:\d{2}\z"), F.lit(False))

"""URL functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that say where a visitor came from.
IGNORED = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "yclid", "ref"]


def host(url: Column) -> Column:
    """Lower-case host without a trailing dot; empty where there is none."""
    return F.rtrim(F.lower(F.coalesce(F.regexp_extract(url, "^[a-zA-Z]+://([^/?#:]*)", 1), F.lit(""))), F.lit("."))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "^[a-zA-Z]+://[^/?#]*([^?#]*)", 1), F.lit(""))


def query(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "^[^?#]*[?]([^#]*)", 1), F.lit(""))


def queue_url(url: Column, ignored: list[str] = IGNORED) -> Column:
    """https, no fragment, no ignored parameters."""
    kept = F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*ignored))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.concat(F.lit("https://"), host(url), path(url), tail)


def canonical(url: Column) -> Column:
    """No fragment and no trailing slash."""
    return F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "/+$", "")


def slug(url: Column) -> Column:
    """Host, path and query as words."""
    text = F.lower(F.concat_ws(" ", host(url), path(url), query(url)))
    return F.btrim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def same_site(host_name: Column, root: Column) -> Column:
    """Equal to root or below it."""
    return (host_name == root) | F.endswith(host_name, F.concat(F.lit("."), root))


def extension(url: Column) -> Column:
    return F.lower(F.regexp_extract(path(url), r"\.([A-Za-z0-9]{1,8})$", 1))


def document_type(url: Column) -> Column:
    e = extension(url)
    return (
        F.when(e == "pdf", "pdf").when(e.isin("doc", "docx", "odt", "rtf"), "text_document").when(e.isin("xls", "xlsx", "csv"), "table")
        .when(e.isin("ppt", "pptx"), "slides").when(e.isin("png", "jpg", "jpeg", "gif", "svg"), "image").when(e.isin("html", "htm", "php", ""), "page").otherwise("other")
    )


def links(html: Column) -> Column:
    """Targets of a elements in order."""
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit('<a [^>]*href="([^"]*)"'), 1)

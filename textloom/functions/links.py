"""Link extraction, URL normalization and URL predicates as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

HREF = 'href="([^"]*)"'


def hrefs(html: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(html, F.lit(HREF), F.lit(1)), F.array().cast("array<string>"))


def listing_links(html: Column, prefix: str = "/article/n/") -> Column:
    """Distinct hrefs that start with the prefix, as written."""
    return F.array_distinct(F.filter(hrefs(html), lambda h: h.startswith(prefix)))


def _resolved(path: Column) -> Column:
    """Removes `.` and `..` segments of an absolute path."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    stack = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, p: F.when(p == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).when(p == ".", done).otherwise(F.concat(done, F.array(p))),
    )
    tail = F.when(last.isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    return F.when(path.rlike("/\\.{1,2}(/|$)"), F.concat(F.array_join(stack, "/"), tail)).otherwise(path)


def absolute_links(html: Column, base: Column, prefix: str = "/article/") -> Column:
    """Distinct absolute URLs of the hrefs under the prefix, without query and fragment."""
    root = F.concat(F.try_parse_url(base, F.lit("PROTOCOL")), F.lit("://"), authority(base))
    return F.array_distinct(
        F.transform(listing_links(html, prefix), lambda h: F.concat(root, _resolved(F.regexp_replace(h, "[?#].*$", ""))))
    )


def authority(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("AUTHORITY"))


def strip_query(url: Column) -> Column:
    return F.regexp_replace(url, "[?#].*$", "")


def is_allowed(url: Column, domains: Sequence[str], pattern: str) -> Column:
    """Host in the list and the whole URL matched from its start."""
    return F.coalesce(authority(url).isin(list(domains)) & url.rlike("^(?:" + pattern.removeprefix("^") + ")"), F.lit(False))


def is_article(url: Column, pattern: str = "/article/n/.+") -> Column:
    return F.coalesce(url.rlike(pattern), F.lit(False))


def file_name(link: Column, extension: str = ".html") -> Column:
    return F.concat(F.element_at(F.split(link, "/"), -1), F.lit(extension))


def strip_extension(name: Column) -> Column:
    return F.regexp_replace(name, "\\.[^.]*$", "")

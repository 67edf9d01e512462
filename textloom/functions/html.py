"""Title and body extraction. `<article>` has a native path; attribute selectors, whose elements nest, use an Arrow UDF."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NO_TITLE, NO_BODY = "No Title", "No Body"
#: Named references that the native path decodes; `amp` must come last.
ENTITIES = (("&copy;", "©"), ("&quot;", '"'), ("&middot;", "·"), ("&nbsp;", " "), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))
SPACE_ENDS = "^\\s+|\\s+$"
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset(("script", "style", "template"))


def _decoded(x: Column) -> Column:
    for name, char in ENTITIES:
        x = F.replace(x, F.lit(name), F.lit(char))
    return x


def element_nodes(html: Column, tag: str) -> Column:
    """Stripped non-empty text nodes of the first `tag` element; null without one. The element must not nest in itself."""
    inner = F.regexp_extract(html, f"(?is)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}\\s*>", 1)
    inner = F.regexp_replace(inner, "(?is)<!--.*?-->|<(script|style)\\b.*?</\\1\\s*>", "")
    nodes = F.transform(F.split(inner, "<[^>]*>"), lambda x: F.regexp_replace(_decoded(x), SPACE_ENDS, ""))
    return F.when(html.rlike(f"(?is)<{tag}(?:\\s[^>]*)?>.*?</{tag}\\s*>"), F.filter(nodes, lambda x: x != ""))


class _Finder(HTMLParser):
    """Text nodes of the first element whose attribute has a value (or a class among its tokens)."""

    def __init__(self, tag: str | None, attribute: str, value: str):
        super().__init__(convert_charrefs=True)
        self.want, self.found, self.depth, self.hidden, self.nodes = (tag, attribute, value), False, 0, 0, []

    def handle_starttag(self, tag, attrs):
        if self.depth:
            self.depth += tag not in VOID
            self.hidden += tag in HIDDEN
            return
        want, attribute, value = self.want
        given = dict(attrs).get(attribute) or ""
        if not self.found and want in (None, tag) and (value in given.split() if attribute == "class" else value == given):
            self.found, self.depth = True, int(tag not in VOID)

    def handle_startendtag(self, tag, attrs):
        if not self.depth:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.depth and tag not in VOID:
            self.depth -= 1
            self.hidden -= tag in HIDDEN and self.hidden > 0

    def handle_data(self, data):
        if self.depth and not self.hidden and (text := data.strip()):
            self.nodes.append(text)


def attribute_nodes(html: Column, attribute: str, value: str, tag: str | None = None) -> Column:
    """As element_nodes(), for the first element that carries the attribute, nested elements included."""

    def one(page):
        if not page or value not in page:
            return None
        finder = _Finder(tag, attribute, value)
        finder.feed(page)
        finder.close()
        return finder.nodes if finder.found else None

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def found(pages: pd.Series) -> pd.Series:
        return pages.map(one)

    # Pages without the value do not cross to Python.
    return found(F.when(F.contains(html, F.lit(value)), html))


def title(html: Column, nodes: Column | None = None) -> Column:
    """Headline nodes joined without separator, or the default."""
    nodes = attribute_nodes(html, "itemprop", "headline") if nodes is None else nodes
    return F.coalesce(F.array_join(nodes, ""), F.lit(NO_TITLE))


def flat_title(html: Column, nodes: Column | None = None) -> Column:
    """A title fit for one line."""
    return F.regexp_replace(title(html, nodes), "[\t\n]", " ")


def article_body(html: Column, nodes: Column | None = None, drop_first: bool = True) -> Column:
    """Body nodes joined by newlines, without the first character; the default keeps its own."""
    nodes = attribute_nodes(html, "itemprop", "articleBody") if nodes is None else nodes
    body = F.array_join(nodes, "\n")
    return F.coalesce(F.substring(body, 2, 2**31 - 1) if drop_first else body, F.lit(NO_BODY))


def ocr_nodes(html: Column) -> Column:
    return attribute_nodes(html, "class", "ocr", "div")


def ocr_or_article(html: Column, nodes: Column | None = None) -> Column:
    """Text of the `ocr` block, else of `<article>`; null (skip the page) without either."""
    return F.coalesce(F.array_join(ocr_nodes(html) if nodes is None else nodes, " "), F.array_join(element_nodes(html, "article"), " "))


def ocr_only(html: Column, nodes: Column | None = None) -> Column:
    return F.coalesce(F.array_join(ocr_nodes(html) if nodes is None else nodes, " "), F.lit(""))


def clean_document(head: Column, body: Column) -> Column:
    return F.concat(head, F.lit("\n\n"), body)


def has_marker(html: Column, marker: str) -> Column:
    return F.coalesce(F.contains(html, F.lit(marker)), F.lit(False))

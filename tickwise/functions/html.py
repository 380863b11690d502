"""HTML column expressions: element extraction and text the way an HTML parser's
``get_text`` yields it (text nodes, entities decoded, script/style skipped).

Regular expressions are exact for non-nested elements (``<h1>``, ``<title>``);
``balanced_inner`` and ``drop_balanced`` count open and close tags, so that an
element ends at its own close tag however deeply others of its name nest in it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import py_strip

# Named character references decoded in text ("&amp;" last so that
# "&amp;lt;" becomes "&lt;", not "<").
ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"),
    ("&nbsp;", " "), ("&copy;", "©"), ("&reg;", "®"), ("&middot;", "·"),
    ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&laquo;", "«"),
    ("&raquo;", "»"), ("&amp;", "&"),
]
NON_TEXT_TAGS = ["script", "style", "template"]


def decode_entities(c: Column) -> Column:
    for ent, ch in ENTITIES:
        c = F.replace(c, F.lit(ent), F.lit(ch))
    return c


def drop_comments(html: Column) -> Column:
    return F.regexp_replace(html, r"(?s)<!--.*?-->", "")


def drop_elements(html: Column, tags: Sequence[str]) -> Column:
    """Remove elements with their content (``decompose``)."""
    alt = "|".join(tags)
    return F.regexp_replace(html, rf"(?is)<({alt})\b[^>]*>.*?</\1\s*>", "")


def has_element(html: Column, tag: str, attr_pattern: str | None = None) -> Column:
    return html.rlike(_open_tag(tag, attr_pattern))


def _open_tag(tag: str, attr_pattern: str | None) -> str:
    if attr_pattern is None:
        return rf"(?is)<{tag}\b[^>]*>"
    return rf"(?is)<{tag}\b[^>]*{attr_pattern}[^>]*>"


def element_inner(html: Column, tag: str, attr_pattern: str | None = None) -> Column:
    """Inner HTML of the first ``tag`` element (optionally with an attribute pattern)."""
    return F.regexp_extract(html, _open_tag(tag, attr_pattern)[:-1] + rf">(.*?)</{tag}\s*>", 1)


def text_nodes(fragment: Column) -> Column:
    """Text nodes of a fragment, decoded and stripped, empty ones dropped (array)."""
    nodes = F.split(drop_comments(fragment), r"<[^>]*>")
    return F.filter(F.transform(nodes, lambda n: py_strip(decode_entities(n))), lambda n: n != "")


def get_text(fragment: Column, sep: str = "") -> Column:
    """``get_text(separator=sep, strip=True)``."""
    return F.array_join(text_nodes(fragment), sep)


def page_text(html: Column) -> Column:
    """Whole-document text (``soup.get_text()``): tags removed, script/style skipped."""
    clean = drop_elements(drop_comments(html), NON_TEXT_TAGS)
    return decode_entities(F.regexp_replace(clean, r"<[^>]*>", ""))


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often the result names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


GONE = "<!>"  # stands where something was removed: a tag without a name


def without_raw(html: Column) -> Column:
    """The page without comments, scripts and styles, whose contents may look like tags; texts stay apart where one stood."""
    return F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>", GONE)


def balanced_inner(html: Column, tag: str, attr_pattern: str | None = None) -> Column:
    """Inner HTML of the first ``tag`` element up to its own close tag (to the end if it has none).

    The text after the open tag is cut at the close tags; the element ends at
    the first cut at which as many elements of its name were closed as opened.
    One pass with a constant state, no matter how deep the nesting.
    """
    rest = F.regexp_extract(html, _open_tag(tag, attr_pattern) + r"(.*)\z", 1)
    start = F.struct(F.lit(1).alias("open"), F.lit(0).alias("n"))

    def step(at: Column, piece: Column) -> Column:
        opened = at["open"] + F.regexp_count(piece, F.lit(rf"(?is)<{tag}\b(?:[^>]*[^>/])?>")) - 1
        return F.when(at["open"] == 0, at).otherwise(F.struct(opened.alias("open"), (at["n"] + 1).alias("n")))

    return let(F.split(rest, rf"(?i)</{tag}\s*>"),
               lambda pieces: F.array_join(F.slice(pieces, 1, F.aggregate(pieces, start, step)["n"]), f"</{tag}>"))


def drop_balanced(fragment: Column, tags: Sequence[str]) -> Column:
    """Remove elements with all they hold, also others of their name; an unclosed one reaches to the fragment's end."""
    for tag in tags:
        fragment = let(fragment, _dropping(tag))
    return fragment


def _dropping(tag: str):
    opening = rf"(?is)<{tag}\b(?:[^>]*[^>/])?>"
    start = F.struct(F.lit(0).alias("open"), F.array().cast("array<string>").alias("kept"))

    def step(at: Column, piece: Column) -> Column:
        left = F.greatest(at["open"] + F.regexp_count(piece, F.lit(opening)) - 1, F.lit(0))
        before = F.element_at(F.split(piece, opening, 2), 1)
        return F.struct(left.alias("open"), F.when(at["open"] == 0, F.concat(at["kept"], F.array(before))).otherwise(at["kept"]).alias("kept"))

    def drop(text: Column) -> Column:
        kept = F.aggregate(F.split(text, rf"(?i)</{tag}\s*>"), start, step)["kept"]
        return F.when(text.rlike(opening), F.array_join(kept, GONE)).otherwise(text)

    return drop


# Elements that have no end tag.
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]


def markup_tokens(html: Column) -> Column:
    """Tags and texts of a page in order (array); comments, scripts and styles are left out."""
    return F.regexp_extract_all(without_raw(html), F.lit(r"(?s)<[^>]*>|[^<]+|<[^>]*\z"), F.lit(0))

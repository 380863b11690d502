"""Article extraction and cleaning (A1-A14), as column expressions over stored pages.

All text rules follow Python ``re``/``str`` semantics (see
``tickwise.functions.text``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import publish_date as publish_date_expr
from ..functions.html import balanced_inner, decode_entities, drop_balanced, element_inner, get_text, has_element, let, without_raw
from ..functions.text import py_lines, py_strip

MIN_LEN = 50

# Class / id patterns of article containers (case-insensitive search).
BODY_CLASS_PATTERN = (r"article.?(?:body|content|text)|news.?content|main.?content|"
                      r"articleContent|article-content|story-body")
BODY_ID_PATTERN = r"article|content|main"
DROPPED_IN_BODY = ["script", "style", "nav", "footer", "aside"]  # the first two go with all raw text


def page_title(html: Column) -> Column:
    """A1: text of the first <h1>, else <h2>, else <title>; else ''."""
    return (
        F.when(has_element(html, "h1"), get_text(element_inner(html, "h1")))
        .when(has_element(html, "h2"), get_text(element_inner(html, "h2")))
        .when(has_element(html, "title"), get_text(element_inner(html, "title")))
        .otherwise(F.lit(""))
    )


def _attr(name: str, pattern: str) -> str:
    """An attribute whose value, in either kind of quotes or none, holds ``pattern``."""
    return (rf"""\b{name}\s*=\s*(?:"[^"]*(?:{pattern})[^"]*"|'[^']*(?:{pattern})[^']*'"""
            rf"""|[^\s"'>]*(?:{pattern})[^\s"'>]*)""")


def page_body(html: Column) -> Column:
    """A2: <article>, else a div by class pattern, else a div by id pattern, each up to its own
    end tag; script, style, nav, footer and aside removed; text nodes joined by newlines; else ''."""
    cls, ids = _attr("class", BODY_CLASS_PATTERN), _attr("id", BODY_ID_PATTERN)

    def body(clean: Column) -> Column:
        return (F.when(has_element(clean, "article"), balanced_inner(clean, "article"))
                .when(has_element(clean, "div", cls), balanced_inner(clean, "div", cls))
                .when(has_element(clean, "div", ids), balanced_inner(clean, "div", ids)))

    inner = let(without_raw(html), body)
    return F.coalesce(get_text(drop_balanced(inner, DROPPED_IN_BODY[2:]), "\n"), F.lit(""))


def publish_date(html: Column, url: Column) -> Column:
    """A3: publish date by the seven-rule precedence (see ``functions.dates``)."""
    return publish_date_expr(html, url)


def min_len(df: DataFrame, col: str = "text", n: int = MIN_LEN) -> DataFrame:
    """A5: drop rows whose text is shorter than ``n`` characters."""
    return df.filter(F.length(F.coalesce(F.col(col), F.lit(""))) >= n)


# Elements that end a block of text: what lies between two of their tags is one block.
BLOCK_TAGS = ("address|article|aside|blockquote|body|center|dd|div|dl|dt|fieldset|figure|figcaption|footer|form|h1|h2|h3|h4|h5|h6|head|"
              "header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|th|thead|title|tr|ul")
BLOCK_COST = 20     # characters of text that a block must have to speak for article text
LINK_COST = 3       # a linked character counts against this many others


def dense_blocks(html: Column) -> Column:
    """The blocks of a page in order: array of (text, score).

    A block is the text between two block-level tags; its score is its length less
    ``LINK_COST`` times the length of its links less ``BLOCK_COST``: above zero for
    prose, below for menus, captions and notices, zero where there is no text.
    """
    def block(piece: Column) -> Column:
        text = py_strip(decode_entities(F.regexp_replace(piece, r"<[^>]*>", "")))
        links = F.aggregate(F.regexp_extract_all(piece, F.lit(r"(?is)<a\b[^>]*>(.*?)</a\s*>"), F.lit(1)), F.lit(0),
                            lambda n, a: n + F.length(py_strip(decode_entities(F.regexp_replace(a, r"<[^>]*>", "")))))
        return let(text, lambda t: F.struct(t.alias("text"), F.when(t == "", 0).otherwise(
            F.length(t) - LINK_COST * links - BLOCK_COST).alias("score")))

    return F.transform(F.split(without_raw(html), rf"(?i)</?(?:{BLOCK_TAGS})\b[^>]*>"), block)


def dense_text(html: Column) -> Column:
    """The run of consecutive blocks with the largest sum of scores, non-empty blocks joined by newlines; '' if none is above zero.

    One pass (the largest sum of a run, with where it starts and ends); of runs
    with equal sums the first to end wins, at its shortest.
    """
    fields = ("at", "sum", "start", "best", "lo", "hi")
    start = F.struct(*[F.lit(0).alias(f) for f in fields])

    def step(s: Column, b: Column) -> Column:
        fresh = s["sum"] <= 0
        run = F.when(fresh, b["score"]).otherwise(s["sum"] + b["score"])
        begin = F.when(fresh, s["at"]).otherwise(s["start"])
        better = run > s["best"]
        return F.struct((s["at"] + 1).alias("at"), run.alias("sum"), begin.alias("start"), F.when(better, run).otherwise(s["best"]).alias("best"),
                        F.when(better, begin).otherwise(s["lo"]).alias("lo"), F.when(better, s["at"] + 1).otherwise(s["hi"]).alias("hi"))

    def text(blocks: Column) -> Column:
        return let(F.aggregate(blocks, start, step), lambda s: F.array_join(F.filter(F.transform(
            F.slice(blocks, s["lo"] + 1, s["hi"] - s["lo"]), lambda b: b["text"]), lambda t: t != ""), "\n"))

    return F.coalesce(let(dense_blocks(html), text), F.lit(""))


def extract_articles(pages: DataFrame, primary: Column | None = None, fallback: Column | None = None,
                     url: str = "url", html: str = "html") -> DataFrame:
    """Primary extraction if its text has >= 50 characters, otherwise the fallback;
    a missing primary date is filled from A3.  The text is cleaned (A7-A9) and checked
    again.  Rows whose text is too short before or after cleaning are dropped.

    ``primary``/``fallback`` are struct columns (title, text, publish_date); the
    defaults are the densest run of blocks (``dense_text``) and the container
    rules (``page_body``).  ``extracted_by`` says which one gave the text.  Each
    extraction is computed once per page; the fallback only where it is needed.
    """
    h, u = F.col(html), F.col(url)
    if primary is None:
        primary = F.struct(page_title(h).alias("title"), dense_text(h).alias("text"), F.lit(None).cast("string").alias("publish_date"))
    if fallback is None:
        fallback = F.struct(page_title(h).alias("title"), page_body(h).alias("text"), publish_date(h, u).alias("publish_date"))

    def long_enough(a: Column) -> Column:
        return F.length(F.coalesce(a["text"], F.lit(""))) >= MIN_LEN

    def choose(p: Column) -> Column:
        by_primary = F.struct(p["title"].alias("title"), p["text"].alias("text"),
                              F.coalesce(p["publish_date"], publish_date(h, u)).alias("publish_date"), F.lit("primary").alias("extracted_by"))
        other = let(fallback, lambda f: F.when(long_enough(f), F.struct(
            f["title"].alias("title"), f["text"].alias("text"), f["publish_date"].alias("publish_date"), F.lit("fallback").alias("extracted_by"))))
        return F.when(long_enough(p), by_primary).otherwise(other)

    kept = [c for c in pages.columns if c != html]
    chosen = pages.select(*kept, F.explode(F.array(let(primary, choose))).alias("_a")).filter(F.col("_a").isNotNull())
    cleaned = chosen.select(*kept, "_a.title", F.explode(F.array(clean_text(F.col("_a.text")))).alias("text"), "_a.publish_date", "_a.extracted_by")
    return min_len(cleaned)


# Multi-line noise blocks removed first (dot matches newline).
NOISE_BLOCKS = [
    r"登入會員.{0,500}?解鎖全文",
    r"展開全文.{0,800}?免費試用\s*\d+\s*日",
    r"免費看獨家內容.{0,500}?立即啟動免費\s*\d+\s*日試閱",
    r"延伸閱讀[\s\S]*",
]

# A stripped line is noise when it matches one of these in full
# (case-insensitive); blank lines are kept.
NOISE_LINES = [
    r"廣告[\s廣告]*",
    r"分享$",
    r"Loading\.\.\.",
    r"展開全文.*",
    r"免費看獨家內容.*",
    r"登入會員.*",
    r"免費試用\s*\d+\s*日.*",
    r"立即啟動免費.*",
    r"會員獨享.*",
    r"全站內容隨你讀.*",
    r"無廣告環境$",
    r"產業資料庫$",
    r"早安經濟日報$",
    r"每日免費電子報.*",
    r"收藏[、，]追蹤新聞.*",
    r"免費註冊.*解鎖全文.*",
    r"有限額度觀看.*",
    r"剩\s*\d*\s*篇$",
    r"一手掌握經濟脈動.*",
    r"不用抽\s+不用搶.*",
    r"#\S+",
    r"請同意我們的隱私權規範.*",
    r"（\d+/\d+\s+\d+:\d+\s*更新）",
    r"請繼續下滑閱讀",
    r"中央社.{0,6}一手新聞.{0,6}app",
    r"本網站之文字、圖片及影音.*",
    r"新聞專題",
    r"首頁",
    r"/",
    r"\d{1,4}",
]


_WS_NO_NL_CHARS = (r"\t\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
                   r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
_WS_NO_NL = "[" + _WS_NO_NL_CHARS + "]"


def _single_line(alt: str) -> str:
    """An alternative with ``\\s`` limited to one line (no newline), '$' dropped."""
    out = alt.replace("$", "")
    out = out.replace(r"[\s", "[" + _WS_NO_NL_CHARS)
    return out.replace(r"\s", _WS_NO_NL)


# The line boundaries of str.splitlines() beside the newline, CRLF first.
BREAKS = ["\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]


def fold_breaks(c: Column) -> Column:
    """Every ``str.splitlines`` boundary as a single newline (literal replaces: a text without one is only searched)."""
    for b in BREAKS:
        c = F.replace(c, F.lit(b), F.lit("\n"))
    return c


def noise_line_pattern(alternatives: Sequence[str] = NOISE_LINES) -> str:
    # a '$' inside an alternative and the closing '$' both mean end of the stripped line
    return "(?iU)^(" + "|".join(a.replace("$", r"\z") for a in alternatives) + r")\z"


def _leading_literal(pattern: str) -> str:
    out = []
    for ch in pattern:
        if ch in ".[]\\()*+?{}|^$":
            break
        out.append(ch)
    return "".join(out)


# whole noise lines (with their newline) in text whose breaks are folded to newlines
NOISE_LINE_DELETE = ("(?imU)^" + _WS_NO_NL + "*(?:" + "|".join(_single_line(a) for a in NOISE_LINES) + ")"
                     + _WS_NO_NL + "*\n")


def strip_blocks(c: Column, patterns: Sequence[str] = NOISE_BLOCKS) -> Column:
    """Remove multi-line noise blocks, pattern by pattern.

    Each pattern starts with a literal; the regex only runs on texts that
    contain it (a plain substring test skips the rest).
    """
    for p in patterns:
        c = let(c, _without_block(p))
    return c


def _without_block(pattern: str):
    lit, rx = _leading_literal(pattern), "(?sU)" + pattern
    return lambda t: F.when(F.contains(t, F.lit(lit)), F.regexp_replace(t, rx, "")).otherwise(t)


def strip_lines(c: Column, pattern: str | None = None) -> Column:
    """Drop lines whose stripped form is a noise line; blank lines stay; lines are
    split like ``str.splitlines`` and joined with newlines.

    Default patterns: one regex pass.  Breaks are folded to newlines, every line
    gets a terminator, whole noise lines (surrounding whitespace included) are
    deleted with their newline, and the final newline is dropped — exactly
    ``"\\n".join(kept lines)``.  Inside the pattern ``\\s`` cannot cross a
    newline, so a match never spans two lines.  A custom ``pattern`` takes the
    per-line path (split, strip, test, join).
    """
    if pattern is None:
        terminated = let(fold_breaks(c), lambda t: F.when(F.endswith(t, F.lit("\n")), t).otherwise(F.concat(t, F.lit("\n"))))
        # what is left is empty or ends in the newline of its last line
        return let(F.regexp_replace(terminated, NOISE_LINE_DELETE, ""), lambda t: F.left(t, F.length(t) - 1))
    lines = F.transform(py_lines(c), lambda x: F.struct(x.alias("l"), py_strip(x).alias("s")))
    kept = F.filter(lines, lambda r: (r["s"] == "") | ~r["s"].rlike(pattern))
    return F.array_join(F.transform(kept, lambda r: r["l"]), "\n")


def collapse(c: Column) -> Column:
    """Three or more newlines -> two; strip the whole text."""
    return py_strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def clean_text(c: Column) -> Column:
    """A7 + A8 + A9; null and empty text pass through unchanged."""
    return F.when(F.coalesce(c, F.lit("")) == "", c).otherwise(collapse(strip_lines(strip_blocks(c))))


def relevant(df: DataFrame, kw: str, title: str = "title", text: str = "text") -> DataFrame:
    """A10: keyword is a substring of the title or of the text (case-sensitive)."""
    return df.filter(relevance(kw, title, text))


def relevance(kw: str, title: str = "title", text: str = "text") -> Column:
    return F.contains(F.coalesce(F.col(title), F.lit("")), F.lit(kw)) | \
        F.contains(F.coalesce(F.col(text), F.lit("")), F.lit(kw))


def relevance_stats(df: DataFrame, kw: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows kept and dropped as irrelevant."""
    g = df.groupBy(*by) if by else df.groupBy()
    r = relevance(kw)
    return g.agg(F.count_if(r).alias("relevant"), F.count_if(~r).alias("irrelevant"))


def fill_date(df: DataFrame, start: str, col: str = "publish_date", flag: str = "date_filtered") -> DataFrame:
    """Missing publish date := range start, only for date-filtered sources."""
    missing = F.col(col).isNull() | (F.col(col) == "")
    return df.withColumn(col, F.when(missing & F.col(flag), F.lit(start)).otherwise(F.col(col)))


def dedup_title(df: DataFrame, ordinal: Sequence[str], title: str = "title") -> DataFrame:
    """Exact-title dedup, first row (by ordinal) wins; null titles are one group."""
    from .links import dedup_first

    return dedup_first(df, title, ordinal)


def date_window_keep_undated(df: DataFrame, lo: str, hi: str, col: str = "publish_date") -> DataFrame:
    """Keep rows whose first 10 date characters lie in [lo, hi] (string compare),
    and rows without a date."""
    d = F.when(F.col(col).isNull() | (py_strip(F.col(col).cast("string")) == ""), F.lit("")) \
        .otherwise(F.substring(F.col(col).cast("string"), 1, 10))
    return df.filter(((d >= lo) & (d <= hi)) | (d == ""))

"""Date column expressions (L12, A3 rules, A4)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import PY_WS


def in_range(c: Column, lo: str, hi: str) -> Column:
    """First 10 characters parse as a date (unpadded month/day accepted) within
    [lo, hi]; null, blank or unparsable -> false."""
    d = F.try_to_date(F.substring(c.cast("string"), 1, 10), "yyyy-M-d")
    return F.coalesce(d.between(F.lit(lo).cast("date"), F.lit(hi).cast("date")), F.lit(False))


def _pad2(c: Column) -> Column:
    return F.lpad(c, 2, "0")


def parse_relative_date(text: Column, ref_ts: Column) -> Column:
    """A4: free-form (Chinese/numeric) date text -> 'YYYY-MM-DD' or minute text.

    Rules in order: 'n 分鐘前' / 'n 小時前' (ref minus n, minute text); '昨天'/'昨日'
    (ref minus a day); 'n 天前'; 'YYYY年M月D日'; 'YYYY/M/D' or 'YYYY-M-D'; 'M月D日'
    or 'M/D' (year of ref); else null.  ``ref_ts`` replaces the wall clock.
    """
    t = F.regexp_replace(F.regexp_replace(text.cast("string"), "^" + PY_WS + "+", ""), PY_WS + r"+\z", "")
    s = r"(?U)\s*"
    rel = rf"(?U)(\d+){s}(分鐘|小時)前"
    n_rel = F.regexp_extract(t, rel, 1)
    unit = F.regexp_extract(t, rel, 2)
    ago = F.when(unit == "小時", F.make_interval(hours=n_rel.try_cast("int"))).otherwise(
        F.make_interval(mins=n_rel.try_cast("int")))
    r1 = F.date_format(ref_ts - ago, "yyyy-MM-dd HH:mm")
    r2 = F.date_format(F.date_sub(ref_ts.cast("date"), 1), "yyyy-MM-dd")
    days = rf"(?U)(\d+){s}天前"
    r3 = F.date_format(F.date_sub(ref_ts.cast("date"), F.regexp_extract(t, days, 1).try_cast("int")), "yyyy-MM-dd")
    cn = r"(?U)(\d{4})年(\d{1,2})月(\d{1,2})日"
    r4 = F.concat_ws("-", F.regexp_extract(t, cn, 1), _pad2(F.regexp_extract(t, cn, 2)), _pad2(F.regexp_extract(t, cn, 3)))
    num = r"(?U)(\d{4})[/-](\d{1,2})[/-](\d{1,2})"
    r5 = F.concat_ws("-", F.regexp_extract(t, num, 1), _pad2(F.regexp_extract(t, num, 2)), _pad2(F.regexp_extract(t, num, 3)))
    md = r"(?U)(\d{1,2})[月/](\d{1,2})[日]?"
    r6 = F.concat_ws("-", F.year(ref_ts).cast("string"), _pad2(F.regexp_extract(t, md, 1)), _pad2(F.regexp_extract(t, md, 2)))
    return (
        F.when(t.rlike(rel), r1)
        .when(t.rlike("昨[天日]"), r2)
        .when(t.rlike(days), r3)
        .when(t.rlike(cn), r4)
        .when(t.rlike(num), r5)
        .when(t.rlike(md), r6)
    )


# Meta names/properties searched for a publish date, in order.
META_DATE_NAMES = ["article:published_time", "datePublished", "publishdate", "pubdate",
                   "og:updated_time", "DC.date.issued"]


def _date_from_attr(raw: Column) -> Column:
    """A value with a 'T' -> 'date HH:MM' (date part must start with YYYY-MM-DD);
    without -> its first 10 characters (same check); else null."""
    date_part = F.split(raw, "T").getItem(0)
    time_part = F.substring(F.split(raw, "T").getItem(1), 1, 5)
    with_t = F.when(date_part.rlike(r"^\d{4}-\d{2}-\d{2}"), F.concat(date_part, F.lit(" "), time_part))
    first10 = F.substring(raw, 1, 10)
    without_t = F.when(first10.rlike(r"^\d{4}-\d{2}-\d{2}"), first10)
    return F.when(F.instr(raw, "T") > 0, with_t).otherwise(without_t)


def _meta_content(html: Column, attr: str, name: str) -> Column:
    esc = name.replace(".", r"\.")
    tag = F.regexp_extract(html, rf"(?is)<meta\b[^>]*\b{attr}\s*=\s*[\"']{esc}[\"'][^>]*>", 0)
    return F.regexp_extract(tag, r"""(?is)\bcontent\s*=\s*(["'])(.*?)\1""", 2)


def meta_date(html: Column) -> Column:
    """A3 rule 1: meta tags by property, else by name, in fixed order; a malformed
    value falls through to the next name."""
    cands = []
    for name in META_DATE_NAMES:
        prop = _meta_content(html, "property", name)
        nm = _meta_content(html, "name", name)
        raw = F.when(prop != "", prop).otherwise(F.when(nm != "", nm))
        cands.append(_date_from_attr(raw))
    return F.coalesce(*cands)


def time_date(html: Column) -> Column:
    """A3 rule 2: first ``<time datetime>`` whose value gives a date."""
    vals = F.regexp_extract_all(html, F.lit(r"""(?is)<time\b[^>]*\bdatetime\s*=\s*(["'])(.*?)\1"""), F.lit(2))
    return F.get(F.filter(F.transform(vals, _date_from_attr), lambda v: v.isNotNull()), 0)


def url_rule_dates(url: Column) -> tuple[Column, Column, Column]:
    """A3 rules 3-5 on the URL."""
    p3 = r"(?U)/news/\w+/(20\d{2})(\d{2})(\d{2})\d+\.aspx"
    r3 = F.when(url.rlike(p3), F.concat_ws("-", *[F.regexp_extract(url, p3, i) for i in (1, 2, 3)]))
    p4 = r"(?<!\d)(20\d{2})(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])(?=\d)"
    cand = F.concat_ws("-", *[F.regexp_extract(url, p4, i) for i in (1, 2, 3)])
    r4 = F.when(url.rlike(p4) & F.try_to_date(cand, "yyyy-MM-dd").isNotNull(), cand)
    p5 = r"/(\d{4})/(\d{1,2})/(\d{1,2})/"
    r5 = F.when(url.rlike(p5), F.concat_ws("-", F.regexp_extract(url, p5, 1), _pad2(F.regexp_extract(url, p5, 2)),
                                           _pad2(F.regexp_extract(url, p5, 3))))
    return r3, r4, r5


def text_rule_dates(text: Column) -> tuple[Column, Column]:
    """A3 rules 6-7 on the page text."""
    p6 = r"(20\d{2})年(\d{1,2})月(\d{1,2})日"
    r6 = F.when(text.rlike(p6), F.concat_ws("-", F.regexp_extract(text, p6, 1), _pad2(F.regexp_extract(text, p6, 2)),
                                            _pad2(F.regexp_extract(text, p6, 3))))
    p7 = r"(?U)(20\d{2})/(0[1-9]|1[0-2])/(0[1-9]|[12]\d|3[01])\s+(\d{2}):(\d{2})"
    r7 = F.when(text.rlike(p7), F.concat(
        F.concat_ws("-", *[F.regexp_extract(text, p7, i) for i in (1, 2, 3)]), F.lit(" "),
        F.regexp_extract(text, p7, 4), F.lit(":"), F.regexp_extract(text, p7, 5)))
    return r6, r7


def publish_date(html: Column, url: Column, text: Column | None = None) -> Column:
    """A3: publish date by precedence (meta, <time>, URL rules, page-text rules), else null."""
    from .html import page_text

    t = page_text(html) if text is None else text
    r3, r4, r5 = url_rule_dates(url)
    r6, r7 = text_rule_dates(t)
    return F.coalesce(meta_date(html), time_date(html), r3, r4, r5, r6, r7)

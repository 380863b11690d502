"""Queries over pages and news: links (L*), articles (A*), dedup (D*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as DT
from ..functions import urls as UR
from ..functions.html import page_text
from ..operators import articles as AR
from ..operators import links as LK
from ..sources import views
from ..sources.tables import table
from . import sql_text as ST
from .registry import register
from .sql_views import add_view, with_views

# --------------------------------------------------------------------------
# shared: pages as result pages of four sources (page_id % 4), page = page_id / 4
# --------------------------------------------------------------------------
SOURCE_TAGS = ["src_a", "src_b", "src_c", "src_d"]
DATE_FILTERED = [False, True, True, False]


def _anchor_sql():
    pat = ST.q(LK.ANCHOR)
    return f"""
      SELECT page_id, url, pos, CASE WHEN left(h, 1) IN (chr(34), chr(39)) THEN substring(h, 2, length(h) - 2) ELSE h END AS h, t FROM (
      SELECT page_id, url, unnest(range(len(h))) AS pos, unnest(h) AS h, unnest(t) AS t FROM (
        SELECT page_id, url, regexp_extract_all(html, {pat}, 1) AS h, regexp_extract_all(html, {pat}, 2) AS t
        FROM v_pages) a) b"""


def _host_sql(u):
    return f"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"


def _scheme_sql(u):
    return f"regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)"


def _path_sql(u):
    return f"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


add_view("v_anchors", ("v_pages",), f"""
    SELECT page_id, url, CAST(pos AS INTEGER) AS pos, {ST.decode('h')} AS href,
           {ST.text_nodes_joined('t', "''")} AS anchor_text
    FROM ({_anchor_sql()}) x""")
add_view("v_links", ("v_anchors",), f"""
    SELECT page_id, url, pos, href, anchor_text,
           regexp_replace(CASE WHEN starts_with(href, '/') THEN {_scheme_sql('url')} || '://' || {_host_sql('url')} || href
                               ELSE href END, '[?#].*$', '') AS link
    FROM v_anchors""")
add_view("v_src_links", ("v_links",), """
    SELECT link, CAST(page_id % 4 AS INTEGER) AS source_rank, CAST(page_id // 4 AS BIGINT) AS page, pos,
           ['src_a', 'src_b', 'src_c', 'src_d'][page_id % 4 + 1] AS source,
           [false, true, true, false][page_id % 4 + 1] AS date_filtered
    FROM v_links""")
add_view("v_src_dedup", ("v_src_links",), """
    SELECT link, source_rank, page, pos, source, date_filtered FROM (
      SELECT *, row_number() OVER (PARTITION BY source_rank, link ORDER BY page, pos) AS r FROM v_src_links) x
    WHERE r = 1""")


def _links(spark, sf):
    return LK.links_from_pages(views.pages(spark, sf))


def _source_links(spark, sf):
    """Links with (page, pos) and their source's tag, flag and rank (L9), in one pass over the pages."""
    l = _links(spark, sf).withColumn("page", (F.col("page_id") / 4).cast("bigint"))
    return LK.tag_sources(l, F.col("page_id") % 4, SOURCE_TAGS, DATE_FILTERED).drop("page_id", "url", "href", "anchor_text")


def _source_dedup(spark, sf):
    s = _source_links(spark, sf)
    return LK.dedup_first(s, ["source_rank", "link"], ["page", "pos"])


_SRC_COLS = ["link", "source_rank", "page", "pos", "source", "date_filtered"]

# --------------------------------------------------------------------------
# L: links
# --------------------------------------------------------------------------


@register("l1_extract_links", with_views("SELECT page_id, pos, href, anchor_text FROM v_anchors", "v_anchors"))
def q_l1(spark, sf):
    return LK.extract_links(views.pages(spark, sf)).select("page_id", "pos", "href", "anchor_text")


@register("l2_resolve_url", with_views("""
    SELECT page_id, pos, CASE WHEN starts_with(href, '/') THEN """ + _scheme_sql("url") + " || '://' || " + _host_sql("url")
    + """ || href ELSE href END AS resolved FROM v_anchors""", "v_anchors"))
def q_l2(spark, sf):
    a = LK.extract_links(views.pages(spark, sf))
    return a.select("page_id", "pos", UR.resolve_url(F.col("href"), F.col("url")).alias("resolved"))


@register("l3_canonical_url", with_views("""
    SELECT page_id, regexp_replace(url, '[?#].*$', '') AS canonical, regexp_replace(url, '\\?.*$', '') AS query_only
    FROM v_pages""", "v_pages"))
def q_l3(spark, sf):
    p = views.pages(spark, sf)
    return p.select("page_id", UR.canonical_url(F.col("url")).alias("canonical"),
                    UR.canonical_url(F.col("url"), "query_only").alias("query_only"))


_RULES = {
    "rule_host_prefix": ("host_prefix", dict(host="blog.ththan.example.net", prefix="/t")),
    "rule_contains": ("contains", dict(a="example.com", b="/th")),
    "rule_numeric_id": ("numeric_id", dict(domain="example.org", search_host="search.example.org")),
    "rule_aspx": ("aspx", dict(host="www.ththen.example.com")),
}


@register("l4_link_filter", with_views(f"""
    SELECT page_id, pos, link,
      ({_host_sql('link')} = 'blog.ththan.example.net' AND starts_with({_path_sql('link')}, '/t')) AS rule_host_prefix,
      (contains(link, 'example.com') AND contains(link, '/th')) AS rule_contains,
      (contains({_host_sql('link')}, 'example.org') AND {_host_sql('link')} <> 'search.example.org'
         AND regexp_matches({_path_sql('link')}, '/[0-9]{{6,}}$')) AS rule_numeric_id,
      ({_host_sql('link')} = 'www.ththen.example.com' AND contains({_path_sql('link')}, '/news/')
         AND ends_with({_path_sql('link')}, '.aspx')) AS rule_aspx
    FROM v_links""", "v_links"))
def q_l4(spark, sf):
    l = _links(spark, sf)
    return l.select("page_id", "pos", "link", *[LK.link_rule(k, **p).alias(n) for n, (k, p) in _RULES.items()])


# derived: order dates spelled into result-link URLs and anchor texts
add_view("v_order_links", (), """
    SELECT o_orderkey,
           'https://www.example.tw/' || CASE WHEN o_orderkey % 2 = 0 THEN 'news' ELSE 'NEWS' END || '/cat'
             || CAST(o_orderkey % 3 AS VARCHAR) || '/' || strftime(o_orderdate, '%Y%m%d')
             || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') || '.aspx' AS href,
           'Item ' || CAST(o_custkey AS VARCHAR) || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ' '
             || strftime(o_orderdate, '%Y/%m/%d') || ' ' || lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':'
             || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') END AS anchor_text
    FROM orders""")


def _order_links(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    href = F.concat(F.lit("https://www.example.tw/"), F.when(k % 2 == 0, F.lit("news")).otherwise(F.lit("NEWS")),
                    F.lit("/cat"), (k % 3).cast("string"), F.lit("/"), F.date_format("o_orderdate", "yyyyMMdd"),
                    F.lpad((k % 10000).cast("string"), 4, "0"), F.lit(".aspx"))
    text = F.concat(F.lit("Item "), F.col("o_custkey").cast("string"),
                    F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(
                        F.lit(" "), F.date_format("o_orderdate", "yyyy/MM/dd"), F.lit(" "),
                        F.lpad((k % 24).cast("string"), 2, "0"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0"))))
    return o.select("o_orderkey", href.alias("href"), text.alias("anchor_text"))


_URL_DATE = "(?i)/news/\\w+/(20[0-9]{2})([0-9]{2})([0-9]{2})[0-9]+\\.aspx"


@register("l5_url_date", with_views(f"""
    SELECT o_orderkey, CASE WHEN regexp_matches(href, '{_URL_DATE}')
      THEN regexp_extract(href, '{_URL_DATE}', 1) || '-' || regexp_extract(href, '{_URL_DATE}', 2) || '-'
           || regexp_extract(href, '{_URL_DATE}', 3) END AS url_date,
      CASE WHEN regexp_matches(href, '{_URL_DATE[4:]}')
      THEN regexp_extract(href, '{_URL_DATE[4:]}', 1) || '-' || regexp_extract(href, '{_URL_DATE[4:]}', 2) || '-'
           || regexp_extract(href, '{_URL_DATE[4:]}', 3) END AS url_date_cs
    FROM v_order_links""", "v_order_links"))
def q_l5(spark, sf):
    o = _order_links(spark, sf)
    return o.select("o_orderkey", UR.url_date(F.col("href")).alias("url_date"),
                    UR.url_date(F.col("href"), case_insensitive=False).alias("url_date_cs"))


@register("l6_has_date_suffix", with_views(f"""
    SELECT o_orderkey, regexp_matches(anchor_text, '[0-9]{{4}}/[0-9]{{2}}/[0-9]{{2}}{ST.PY_WS}+[0-9]{{2}}:[0-9]{{2}}\\z')
      AS has_date_suffix FROM v_order_links""", "v_order_links"))
def q_l6(spark, sf):
    o = _order_links(spark, sf)
    return o.select("o_orderkey", UR.has_date_suffix(F.col("anchor_text")).alias("has_date_suffix"))


def _labelled_sql(label):
    kinds = [r'(?is)<li\b[^>]*class\s*=\s*"[^"]*(?:js-stream-content|StreamMegaItem)[^>]*>(.*?)</li\s*>',
             r'(?is)<div\b[^>]*class\s*=\s*"[^"]*(?:NewsArticle|stream|news-item)[^>]*>(.*?)</div\s*>', r'(?is)<li\b[^>]*>(.*?)</li\s*>']
    found = ", ".join(f"regexp_extract_all(html, {ST.q(k)}, 1) AS b{i}" for i, k in enumerate(kinds))
    href = r"""(?is)<a\b[^>]*?\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)[^>]*>.*?</a\s*>"""
    return f"""
      SELECT page_id, url, CAST(block_pos AS INTEGER) AS block_pos, {ST.decode("CASE WHEN left(h, 1) IN (chr(34), chr(39)) "
        "THEN substring(h, 2, length(h) - 2) ELSE h END")} AS href
      FROM (SELECT page_id, url, block_pos, block, regexp_extract(block, {ST.q(href)}, 1) AS h FROM (
              SELECT page_id, url, unnest(range(len(b))) AS block_pos, unnest(b) AS block FROM (
                SELECT page_id, url, CASE WHEN len(b0) > 0 THEN b0 WHEN len(b1) > 0 THEN b1 ELSE b2 END AS b
                FROM (SELECT page_id, url, {found} FROM v_pages) f) k) u) x
      WHERE h <> '' AND contains({ST.text_nodes_joined('block', "''")}, '{label}')"""


@register("l7_labelled_block_links", with_views(_labelled_sql("the"), "v_pages"))
def q_l7(spark, sf):
    """Blocks (list items here) whose text contains the label 'the' give their first link."""
    return LK.labelled_block_links(views.pages(spark, sf), "the")


# derived pages: each order as a label in nested blocks; the case says where its link stands.  {L}: the order's link
_BLOCK_CASES = [
    ("<ul><li class=r><p><span>Wire 1</span></p>{L}</li><li>{O}</li></ul>", "L"),                       # two blocks out, after the label
    ("<div>{O}<div>{L}<div><div><i><b>Wire 2</b></i></div></div>{O}</div></div>", "L"),                # four out, before it
    ("<div><section><p>Wire<section>{L}{O}</section></section></div>", "L"),                         # an open p around a nested section
    ("<div>{L}" + "<div>" * 9 + "<i>Wire</i>" + "</div>" * 10, None),                                # ten blocks out: too far
    ("<div>{L}" + "<div>" * 7 + "<i>Wire</i>" + "</div>" * 8, "L"),                                  # eight out: just near enough
    ("<div><div><em>x</em> Wire</div><div>{O}</div></div><p>no{L}</p>", "O"),                       # the label is the block's first text
    ("<body><div><b>x</b><p>a<i>Wire</i></p><br/></nav><!-- {L} --></div><div>{O}<u>y</u>Wire</div>", "O"),  # a comment's link; stray end tags
    ("<ol><li>Wire{O}</li></ol><ul><li>a{L}</li></ul><script>{O}</script>", "O"),
]


def _block_page(case, link, other):
    return case.replace("{L}", f'<a class=t href="{link}">t</a>').replace("{O}", f"<A HREF='{other}'>o</A>")


_CASE = "o_orderkey % 8"
_LINK_SQL = "'/news/' || CAST(o_orderkey AS VARCHAR)"


@register("l7_nearest_block", f"""
    SELECT o_orderkey, CAST(0 AS INTEGER) AS pos, 'nearest' AS found_by, 'https://w.example' || CASE {_CASE}
      {" ".join(f"WHEN {k} THEN {_LINK_SQL}" + (" || 'o'" if w == "O" else "") for k, (_, w) in enumerate(_BLOCK_CASES) if w)} END AS link
    FROM orders WHERE {_CASE} IN ({", ".join(str(k) for k, (_, w) in enumerate(_BLOCK_CASES) if w)})""")
def q_l7_nearest(spark, sf):
    """The nearest enclosing block's first link for labels in blocks of several depths (one page per order)."""
    key = F.col("o_orderkey").cast("string")
    html = F.element_at(F.array(*[F.lit(_block_page(c, "/news/@?a=1&amp;b#c", "/news/@o")) for c, _ in _BLOCK_CASES]), (F.expr(_CASE) + 1).cast("int"))
    p = table(spark, sf, "orders").select("o_orderkey", F.lit("https://w.example/s?p=1").alias("url"), F.replace(html, F.lit("@"), key).alias("html"))
    return LK.labelled_links(p, "Wire", keep=["o_orderkey"], accept=lambda u: F.contains(u, F.lit("/news/")))


@register("l8_dedup_first", with_views("SELECT link, source_rank, page, pos FROM v_src_dedup", "v_src_dedup"))
def q_l8(spark, sf):
    return _source_dedup(spark, sf).select("link", "source_rank", "page", "pos")


@register("l9_union_sources", with_views(
    "SELECT link, page, pos, source, date_filtered, source_rank FROM v_src_links", "v_src_links"))
def q_l9(spark, sf):
    return _source_links(spark, sf).select("link", "page", "pos", "source", "date_filtered", "source_rank")


@register("l10_dedup_across_sources", with_views("""
    SELECT link, source, date_filtered, source_rank, page, pos FROM (
      SELECT *, row_number() OVER (PARTITION BY link ORDER BY source_rank, page, pos) AS r FROM v_src_dedup) x
    WHERE r = 1""", "v_src_dedup"))
def q_l10(spark, sf):
    d = _source_dedup(spark, sf)
    return LK.dedup_first(d, "link", ["source_rank", "page", "pos"]).select(
        "link", "source", "date_filtered", "source_rank", "page", "pos")


@register("l11_until_first_empty", with_views("""
    , pg AS (SELECT DISTINCT CAST(page_id % 4 AS INTEGER) AS source_rank, CAST(page_id // 4 AS BIGINT) AS page FROM v_pages)
    , np AS (SELECT pg.source_rank, pg.page, count(d.link) AS n_new FROM pg
             LEFT JOIN v_src_dedup d ON d.source_rank = pg.source_rank AND d.page = pg.page GROUP BY 1, 2)
    , ok AS (SELECT source_rank, page FROM (
               SELECT *, sum(CASE WHEN n_new = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source_rank ORDER BY page
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e,
                 row_number() OVER (PARTITION BY source_rank ORDER BY page) AS rk FROM np) x
             WHERE e = 0)
    SELECT d.link, d.source_rank, d.page, d.pos FROM v_src_dedup d
    JOIN ok ON d.source_rank = ok.source_rank AND d.page = ok.page""".replace("\n    , pg", "\n    , pg", 1),
    "v_src_dedup", "v_pages"))
def q_l11(spark, sf):
    d = _source_dedup(spark, sf)
    pl = views.pages(spark, sf).select((F.col("page_id") % 4).cast("int").alias("source_rank"),
                                       (F.col("page_id") / 4).cast("bigint").alias("page"))
    return LK.until_first_empty(d, pl, "source_rank", "page").select("link", "source_rank", "page", "pos")


add_view("v_order_dates", (), """
    SELECT o_orderkey, CASE o_orderkey % 6
        WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M')
        WHEN 1 THEN CAST(year(o_orderdate) AS VARCHAR) || '-' || CAST(month(o_orderdate) AS VARCHAR) || '-'
                    || CAST(day(o_orderdate) AS VARCHAR)
        WHEN 2 THEN strftime(o_orderdate, '%Y/%m/%d')
        WHEN 3 THEN NULL
        WHEN 4 THEN ''
        ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date_text
    FROM orders""")


def _order_dates(spark, sf):
    o = table(spark, sf, "orders")
    k, d = F.col("o_orderkey") % 6, F.col("o_orderdate")
    t = (F.when(k == 0, F.date_format(d, "yyyy-MM-dd HH:mm"))
         .when(k == 1, F.concat_ws("-", F.year(d).cast("string"), F.month(d).cast("string"), F.dayofmonth(d).cast("string")))
         .when(k == 2, F.date_format(d, "yyyy/MM/dd"))
         .when(k == 3, F.lit(None).cast("string"))
         .when(k == 4, F.lit(""))
         .otherwise(F.date_format(d, "yyyy-MM-dd")))
    return o.select("o_orderkey", t.alias("date_text"))


@register("l12_in_range", with_views("""
    SELECT o_orderkey, coalesce(CAST(try_strptime(substring(date_text, 1, 10), '%Y-%m-%d') AS DATE)
                                BETWEEN DATE '1996-03-01' AND DATE '1997-06-30', false) AS in_range
    FROM v_order_dates""", "v_order_dates"))
def q_l12(spark, sf):
    o = _order_dates(spark, sf)
    return o.select("o_orderkey", DT.in_range(F.col("date_text"), "1996-03-01", "1997-06-30").alias("in_range"))


@register("l13_link_counts", with_views("""
    SELECT source, page, CAST(count(*) AS BIGINT) AS n FROM v_src_dedup GROUP BY ROLLUP (source, page)""",
    "v_src_dedup"))
def q_l13(spark, sf):
    return LK.link_counts(_source_dedup(spark, sf), "source", "page")


# --------------------------------------------------------------------------
# A: articles
# --------------------------------------------------------------------------

def _title_sql(h):
    parts = []
    for tag in ("h1", "h2", "title"):
        parts.append(f"WHEN {ST.has_element(h, tag)} THEN {ST.text_nodes_joined(ST.element_inner(h, tag), chr(39) * 2)}")
    return "CASE " + " ".join(parts) + " ELSE '' END"


@register("a1_page_title", with_views(f"SELECT page_id, {_title_sql('html')} AS title FROM v_pages", "v_pages"))
def q_a1(spark, sf):
    return views.pages(spark, sf).select("page_id", AR.page_title(F.col("html")).alias("title"))


def _body_sql(h):
    text = lambda inner: ST.text_nodes_joined(ST.drop_elements(inner, AR.DROPPED_IN_BODY), "chr(10)")
    by = {"class": "article.?(?:body|content|text)|news.?content|main.?content|story-body", "id": "article|content|main"}
    cases = [f"WHEN {ST.has_element(h, 'article')} THEN {text(ST.element_inner(h, 'article'))}"]
    for attr, words in by.items():
        div = ST.q(rf"""(?is)<div\b[^>]*\b{attr}\s*=\s*["']?[^"'>]*(?:{words})[^>]*>(.*?)</div\s*>""")
        cases.append(f"WHEN regexp_matches({h}, {div}) THEN {text(f'regexp_extract({h}, {div}, 1)')}")
    return f"CASE {' '.join(cases)} ELSE '' END"


@register("a2_page_body", with_views(f"SELECT page_id, {_body_sql('html')} AS body FROM v_pages", "v_pages"))
def q_a2(spark, sf):
    return views.pages(spark, sf).select("page_id", AR.page_body(F.col("html")).alias("body"))


# derived pages: every page once more per other container, in each kind of quotes
_CONTAINERS = ['div class="page article-body"', "div class='story-body'", "div id=main-part", "section"]
_BODY_PAGES_SQL = " UNION ALL ".join(
    f"SELECT page_id, {k} AS container, replace(replace(html, '<article', {ST.q('<' + c)}), '</article', '</{c.split()[0]}') AS html FROM v_pages"
    for k, c in enumerate(_CONTAINERS))


@register("a2_page_body_containers", with_views(f"""
    SELECT page_id, container, {_body_sql('html')} AS body FROM ({_BODY_PAGES_SQL}) p""", "v_pages"))
def q_a2_containers(spark, sf):
    html = [F.replace(F.replace("html", F.lit("<article"), F.lit(f"<{c}")), F.lit("</article"), F.lit(f"</{c.split()[0]}")) for c in _CONTAINERS]
    p = views.pages(spark, sf).select("page_id", F.posexplode(F.array(*html)).alias("container", "html"))
    return p.select("page_id", "container", AR.page_body(F.col("html")).alias("body"))


# derived pages: the body is a div around one to three nested divs, with removed elements nested in their like
_NEST = [1, 2, 3]


def _nested(html, k):
    """The article as a div; its heading inside ``k`` more divs, then an aside in an aside and a footer."""
    box = F.replace(F.replace(html, F.lit("<article"), F.lit("<div id=wrap><div class='top article-body'")), F.lit("</article"), F.lit("</div></div"))
    box = F.replace(box, F.lit("<h1>"), F.lit("<div class='d'>" * k + "<h1>"))
    return F.replace(box, F.lit("</h1>"), F.lit("</h1>" + "</div>" * k + "<aside>a<ASIDE >b</aside>c<div>d</div></aside><!-- </div> --><footer>f</footer>"))


@register("a2_nested_bodies", with_views(f"""
    SELECT page_id, CAST(k AS INTEGER) AS depth, body
    FROM (SELECT page_id, {_body_sql('html')} AS body FROM v_pages WHERE contains(html, '<article')) b, range(1, 4) r(k)""", "v_pages"))
def q_a2_nested(spark, sf):
    """A body ends at its own close tag: nested containers give the text of the plain article."""
    p = views.pages(spark, sf).filter(F.contains("html", F.lit("<article")))
    p = p.select("page_id", F.explode(F.array(*[F.struct(F.lit(k).alias("depth"), _nested(F.col("html"), k).alias("html")) for k in _NEST])).alias("d"))
    return p.select("page_id", "d.depth", AR.page_body(F.col("d.html")).alias("body"))


# derived pages: each order's date written the way one of the seven publish-date rules reads it
add_view("v_order_pages", (), """
    SELECT o_orderkey AS page_id,
      CASE WHEN o_orderkey % 10 IN (4, 5, 6) THEN
             CASE o_orderkey % 10
               WHEN 4 THEN 'https://e.example/news/afe/' || strftime(o_orderdate, '%Y%m%d')
                           || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') || '.aspx'
               WHEN 5 THEN 'https://e.example/story/' || strftime(o_orderdate, '%Y%m%d')
                           || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0')
               ELSE 'https://e.example/' || CAST(year(o_orderdate) AS VARCHAR) || '/' || CAST(month(o_orderdate) AS VARCHAR)
                    || '/' || CAST(day(o_orderdate) AS VARCHAR) || '/story' END
           ELSE 'https://e.example/a/' || CAST(o_orderkey AS VARCHAR) END AS url,
      '<html><head>' || CASE o_orderkey % 10
        WHEN 0 THEN '<meta property="article:published_time" content="' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '">'
        WHEN 1 THEN '<meta name="pubdate" content="' || strftime(o_orderdate, '%Y-%m-%d') || '">'
        WHEN 2 THEN '<meta property="datePublished" content="soon"><meta name="DC.date.issued" content="'
                    || strftime(o_orderdate, '%Y-%m-%d') || ' 08:00">'
        WHEN 3 THEN '<time datetime="bad"></time>'
        ELSE '' END || '</head><body>' || CASE o_orderkey % 10
        WHEN 3 THEN '<time datetime="' || strftime(o_orderdate, '%Y-%m-%dT%H:%M') || '">t</time>'
        WHEN 7 THEN '<p>&copy; ' || CAST(year(o_orderdate) AS VARCHAR) || '年' || CAST(month(o_orderdate) AS VARCHAR) || '月'
                    || CAST(day(o_orderdate) AS VARCHAR) || '日</p>'
        WHEN 8 THEN '<script>var d="2001/01/01 00:00";</script><p>' || strftime(o_orderdate, '%Y/%m/%d') || ' '
                    || lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':05</p>'
        ELSE '<p>no date</p>' END || '</body></html>' AS html
    FROM orders""")


def _order_pages(spark, sf):
    o = table(spark, sf, "orders")
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    m = k % 10
    y, mo, dd = F.year(d).cast("string"), F.month(d).cast("string"), F.dayofmonth(d).cast("string")
    num = F.lpad((k % 10000).cast("string"), 4, "0")
    url = (F.when(m == 4, F.concat(F.lit("https://e.example/news/afe/"), F.date_format(d, "yyyyMMdd"), num, F.lit(".aspx")))
           .when(m == 5, F.concat(F.lit("https://e.example/story/"), F.date_format(d, "yyyyMMdd"), num))
           .when(m == 6, F.concat(F.lit("https://e.example/"), y, F.lit("/"), mo, F.lit("/"), dd, F.lit("/story")))
           .otherwise(F.concat(F.lit("https://e.example/a/"), k.cast("string"))))
    head = (F.when(m == 0, F.concat(F.lit('<meta property="article:published_time" content="'),
                                    F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"), F.lit('">')))
            .when(m == 1, F.concat(F.lit('<meta name="pubdate" content="'), F.date_format(d, "yyyy-MM-dd"), F.lit('">')))
            .when(m == 2, F.concat(F.lit('<meta property="datePublished" content="soon"><meta name="DC.date.issued" content="'),
                                   F.date_format(d, "yyyy-MM-dd"), F.lit(' 08:00">')))
            .when(m == 3, F.lit('<time datetime="bad"></time>'))
            .otherwise(F.lit("")))
    body = (F.when(m == 3, F.concat(F.lit('<time datetime="'), F.date_format(d, "yyyy-MM-dd'T'HH:mm"), F.lit('">t</time>')))
            .when(m == 7, F.concat(F.lit("<p>&copy; "), y, F.lit("年"), mo, F.lit("月"), dd, F.lit("日</p>")))
            .when(m == 8, F.concat(F.lit('<script>var d="2001/01/01 00:00";</script><p>'), F.date_format(d, "yyyy/MM/dd"),
                                   F.lit(" "), F.lpad((k % 24).cast("string"), 2, "0"), F.lit(":05</p>")))
            .otherwise(F.lit("<p>no date</p>")))
    html = F.concat(F.lit("<html><head>"), head, F.lit("</head><body>"), body, F.lit("</body></html>"))
    return o.select(k.alias("page_id"), url.alias("url"), html.alias("html"))


_ISO_DAY = "'^[0-9]{4}-[0-9]{2}-[0-9]{2}'"


def _attr_date_sql(raw):
    return (f"CASE WHEN strpos({raw}, 'T') > 0 THEN (CASE WHEN regexp_matches(split_part({raw}, 'T', 1), {_ISO_DAY}) "
            f"THEN split_part({raw}, 'T', 1) || ' ' || substring(split_part({raw}, 'T', 2), 1, 5) END) "
            f"ELSE (CASE WHEN regexp_matches(substring({raw}, 1, 10), {_ISO_DAY}) THEN substring({raw}, 1, 10) END) END")


def _meta_content_sql(attr, name):
    esc = name.replace(".", "\\.")
    tag_pat = "(?is)<meta\\b[^>]*\\b" + attr + "\\s*=\\s*[\"']" + esc + "[\"'][^>]*>"
    content_pat = "(?is)\\bcontent\\s*=\\s*\"([^\"]*)\"|\\bcontent\\s*=\\s*'([^']*)'"
    return f"regexp_extract(regexp_extract(html, {ST.q(tag_pat)}, 0), {ST.q(content_pat)}, 1)"


def _publish_date_sql(pages, key="page_id"):
    """Publish date of the (key..., url, html) rows of ``pages``, a SELECT."""
    from ..functions.dates import META_DATE_NAMES

    metas = []
    for nme in META_DATE_NAMES:
        pc, nc = _meta_content_sql("property", nme), _meta_content_sql("name", nme)
        metas.append(_attr_date_sql(f"(CASE WHEN {pc} <> '' THEN {pc} WHEN {nc} <> '' THEN {nc} END)"))
    time_pat = ST.q("(?is)<time\\b[^>]*\\bdatetime\\s*=\\s*\"([^\"]*)\"")
    times = (f"list_filter(list_transform(regexp_extract_all(html, {time_pat}, 1), "
             f"lambda v: {_attr_date_sql('v')}), lambda v: v IS NOT NULL)[1]")

    def ymd(src, pat, groups, pad=False):
        parts = [f"regexp_extract({src}, {ST.q(pat)}, {g})" for g in groups]
        if pad:
            parts = [parts[0]] + [f"lpad({x}, 2, '0')" for x in parts[1:]]
        return " || '-' || ".join(parts)

    r3p = "/news/\\w+/(20[0-9]{2})([0-9]{2})([0-9]{2})[0-9]+\\.aspx"
    r3 = f"CASE WHEN regexp_matches(url, {ST.q(r3p)}) THEN {ymd('url', r3p, (1, 2, 3))} END"
    r4p = "(^|[^0-9])(20[0-9]{2})(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])[0-9]"
    r4c = ymd("url", r4p, (2, 3, 4))
    r4 = f"CASE WHEN regexp_matches(url, {ST.q(r4p)}) AND try_strptime({r4c}, '%Y-%m-%d') IS NOT NULL THEN {r4c} END"
    r5p = "/([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})/"
    r5 = f"CASE WHEN regexp_matches(url, {ST.q(r5p)}) THEN {ymd('url', r5p, (1, 2, 3), pad=True)} END"
    text = ST.decode("regexp_replace(" + ST.drop_elements("regexp_replace(html, '(?s)<!--.*?-->', '', 'g')",
                                                         ["script", "style", "template"]) + ", '<[^>]*>', '', 'g')")
    r6p = "(20[0-9]{2})年([0-9]{1,2})月([0-9]{1,2})日"
    r6 = f"CASE WHEN regexp_matches(t, {ST.q(r6p)}) THEN {ymd('t', r6p, (1, 2, 3), pad=True)} END"
    r7p = ST.re2(r"(20\d{2})/(0[1-9]|1[0-2])/(0[1-9]|[12]\d|3[01])\s+(\d{2}):(\d{2})")
    g7 = [f"regexp_extract(t, {ST.q(r7p)}, {g})" for g in range(1, 6)]
    r7 = (f"CASE WHEN regexp_matches(t, {ST.q(r7p)}) THEN {g7[0]} || '-' || {g7[1]} || '-' || {g7[2]} || ' ' "
          f"|| {g7[3]} || ':' || {g7[4]} END")
    return (f"SELECT {key}, coalesce({', '.join(metas)}, {times}, {r3}, {r4}, {r5}, {r6}, {r7}) AS publish_date "
            f"FROM (SELECT {key}, url, html, {text} AS t FROM ({pages}) u) x")


@register("a3_publish_date", with_views(_publish_date_sql(
    "SELECT page_id, url, html FROM v_order_pages UNION ALL SELECT page_id + 1000000000000 AS page_id, url, html FROM v_pages"),
    "v_order_pages", "v_pages"))
def q_a3(spark, sf):
    """Publish date of the stored pages and of pages spelling each order's date for one of the seven rules."""
    p = _order_pages(spark, sf).unionByName(
        views.pages(spark, sf).select((F.col("page_id") + F.lit(1000000000000)).alias("page_id"), "url", "html"))
    return p.select("page_id", AR.publish_date(F.col("html"), F.col("url")).alias("publish_date"))


# derived: order dates spelled as relative / Chinese / numeric date text
add_view("v_order_reltext", (), """
    SELECT o_orderkey, CASE o_orderkey % 8
        WHEN 0 THEN CAST(o_orderkey % 50 AS VARCHAR) || ' 分鐘前'
        WHEN 1 THEN CAST(o_orderkey % 30 AS VARCHAR) || '小時前'
        WHEN 2 THEN '昨天 ' || strftime(o_orderdate, '%H:%M')
        WHEN 3 THEN CAST(o_orderkey % 9 AS VARCHAR) || ' 天前'
        WHEN 4 THEN CAST(year(o_orderdate) AS VARCHAR) || '年' || CAST(month(o_orderdate) AS VARCHAR) || '月'
                    || CAST(day(o_orderdate) AS VARCHAR) || '日'
        WHEN 5 THEN CAST(year(o_orderdate) AS VARCHAR) || '/' || CAST(month(o_orderdate) AS VARCHAR) || '/'
                    || CAST(day(o_orderdate) AS VARCHAR)
        WHEN 6 THEN CAST(month(o_orderdate) AS VARCHAR) || '月' || CAST(day(o_orderdate) AS VARCHAR) || '日'
        ELSE 'n/a' END AS t
    FROM orders""")


def _order_reltext(spark, sf):
    o = table(spark, sf, "orders")
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    y, m, dd = F.year(d).cast("string"), F.month(d).cast("string"), F.dayofmonth(d).cast("string")
    t = (F.when(k % 8 == 0, F.concat((k % 50).cast("string"), F.lit(" 分鐘前")))
         .when(k % 8 == 1, F.concat((k % 30).cast("string"), F.lit("小時前")))
         .when(k % 8 == 2, F.concat(F.lit("昨天 "), F.date_format(d, "HH:mm")))
         .when(k % 8 == 3, F.concat((k % 9).cast("string"), F.lit(" 天前")))
         .when(k % 8 == 4, F.concat(y, F.lit("年"), m, F.lit("月"), dd, F.lit("日")))
         .when(k % 8 == 5, F.concat_ws("/", y, m, dd))
         .when(k % 8 == 6, F.concat(m, F.lit("月"), dd, F.lit("日")))
         .otherwise(F.lit("n/a")))
    return o.select("o_orderkey", t.alias("t"))


_REF = "TIMESTAMP '2001-12-31 12:00:00'"


def _rel_sql():
    ws = f"[{ST.JAVA_WS}]*"
    rel = f"([0-9]+){ws}(分鐘|小時)前"
    days = f"([0-9]+){ws}天前"
    cn = "([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})日"
    num = "([0-9]{4})[/-]([0-9]{1,2})[/-]([0-9]{1,2})"
    md = "([0-9]{1,2})[月/]([0-9]{1,2})[日]?"

    def g(p, i):
        return f"regexp_extract(t, '{p}', {i})"

    def pad(x):
        return f"lpad({x}, 2, '0')"

    return f"""CASE
      WHEN regexp_matches(t, '{rel}') THEN strftime({_REF} - CASE WHEN {g(rel, 2)} = '小時'
             THEN to_hours(CAST({g(rel, 1)} AS BIGINT)) ELSE to_minutes(CAST({g(rel, 1)} AS BIGINT)) END, '%Y-%m-%d %H:%M')
      WHEN regexp_matches(t, '昨[天日]') THEN strftime(CAST({_REF} AS DATE) - 1, '%Y-%m-%d')
      WHEN regexp_matches(t, '{days}') THEN strftime(CAST({_REF} AS DATE) - CAST({g(days, 1)} AS INTEGER), '%Y-%m-%d')
      WHEN regexp_matches(t, '{cn}') THEN {g(cn, 1)} || '-' || {pad(g(cn, 2))} || '-' || {pad(g(cn, 3))}
      WHEN regexp_matches(t, '{num}') THEN {g(num, 1)} || '-' || {pad(g(num, 2))} || '-' || {pad(g(num, 3))}
      WHEN regexp_matches(t, '{md}') THEN '2001-' || {pad(g(md, 1))} || '-' || {pad(g(md, 2))}
    END"""


@register("a4_parse_relative_date", with_views(
    f"SELECT o_orderkey, {_rel_sql()} AS parsed FROM v_order_reltext", "v_order_reltext"))
def q_a4(spark, sf):
    o = _order_reltext(spark, sf)
    ref = F.lit("2001-12-31 12:00:00").cast("timestamp_ntz")
    return o.select("o_orderkey", DT.parse_relative_date(F.col("t"), ref).alias("parsed"))


@register("a5_min_len", with_views("SELECT id, length(text) AS n_chars FROM v_news WHERE length(coalesce(text, '')) >= 50",
                                   "v_news"))
def q_a5(spark, sf):
    return AR.min_len(views.news(spark, sf)).select("id", F.length("text").alias("n_chars"))


# news text with noise blocks/lines of the kinds the cleaner removes (fixed samples, chosen by id)
_NOISE_SAMPLES = [
    ("廣告 廣告\n", "\n延伸閱讀\n相關文章 A\n相關文章 B"),
    ("", "\n\n\n\n12\n/\n首頁\n新聞專題\n"),
    ("登入會員看更多\n說明\n解鎖全文\n", "\n尾段"),
    ("#晶片廠\n（2/23 09:29 更新）\n", "\r\n分享\r\n"),
    ("Loading...\n\n\n\n", "\n剩 3 篇\n免費試用 7 日方案"),
    ("", ""),
]


def _noisy_sql():
    cases = " ".join(f"WHEN {k} THEN {ST.q(a)} || text || {ST.q(b)}" for k, (a, b) in enumerate(_NOISE_SAMPLES))
    return f"SELECT id, source, title, CASE id % {len(_NOISE_SAMPLES)} {cases} END AS text FROM v_news"


add_view("v_news_noisy", ("v_news",), _noisy_sql())


def _news_noisy(spark, sf):
    n = views.news(spark, sf)
    m = F.col("id") % len(_NOISE_SAMPLES)
    expr = None
    for k, (a, b) in enumerate(_NOISE_SAMPLES):
        v = F.concat(F.lit(a), F.col("text"), F.lit(b))
        expr = F.when(m == k, v) if expr is None else expr.when(m == k, v)
    return n.select("id", "source", "title", expr.alias("text"))


def _blocks_sql(t):
    for p in AR.NOISE_BLOCKS:
        t = f"regexp_replace({t}, {ST.q(ST.re2('(?s)' + p))}, '', 'g')"
    return t


def _lines_sql(t):
    pat = ST.q(ST.re2(AR.noise_line_pattern().replace("(?iU)", "(?i)")))
    return (f"array_to_string(list_filter({ST.py_lines(t)}, lambda x: {ST.py_strip('x')} = '' "
            f"OR NOT regexp_matches({ST.py_strip('x')}, {pat})), chr(10))")


def _collapse_sql(t):
    return ST.py_strip(f"regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


@register("a7_strip_blocks", with_views(f"SELECT id, {_blocks_sql('text')} AS text FROM v_news_noisy", "v_news_noisy"))
def q_a7(spark, sf):
    return _news_noisy(spark, sf).select("id", AR.strip_blocks(F.col("text")).alias("text"))


@register("a8_strip_lines", with_views(f"SELECT id, {_lines_sql('text')} AS text FROM v_news_noisy", "v_news_noisy"))
def q_a8(spark, sf):
    return _news_noisy(spark, sf).select("id", AR.strip_lines(F.col("text")).alias("text"))


@register("a9_collapse", with_views(f"SELECT id, {_collapse_sql('text')} AS text FROM v_news_noisy", "v_news_noisy"))
def q_a9(spark, sf):
    return _news_noisy(spark, sf).select("id", AR.collapse(F.col("text")).alias("text"))


@register("a_clean_text", with_views(f"""
    SELECT id, CASE WHEN coalesce(text, '') = '' THEN text ELSE {_collapse_sql(_lines_sql(_blocks_sql('text')))} END AS text
    FROM v_news_noisy""", "v_news_noisy"))
def q_a_clean(spark, sf):
    return _news_noisy(spark, sf).select("id", AR.clean_text(F.col("text")).alias("text"))


_KW = "Und"


# derived pages: as stored; every word of the article a block of its own (too short for prose); no container
_ARTICLE_KINDS = ["stored", "words", "bare"]
_A_TAIL = "(?s)<article.*</article>"
add_view("v_article_pages", ("v_pages",), f"""
    SELECT page_id, kind, url, CASE kind WHEN 'stored' THEN html
        WHEN 'words' THEN replace(html, regexp_extract(html, {ST.q(_A_TAIL)}, 0), replace(replace(regexp_extract(html, {ST.q(_A_TAIL)}, 0), ' ', '<p>'), '.', '.</p>'))
        ELSE replace(replace(html, '<article', '<section'), '</article', '</section') END AS html
    FROM v_pages, (VALUES ('stored'), ('words'), ('bare')) k(kind) WHERE contains(html, '</article>') OR kind = 'stored'""")


def _article_pages(spark, sf):
    h = F.col("html")
    inner = F.regexp_extract(h, _A_TAIL, 0)
    words = F.replace(h, inner, F.replace(F.replace(inner, F.lit(" "), F.lit("<p>")), F.lit("."), F.lit(".</p>")))
    bare = F.replace(F.replace(h, F.lit("<article"), F.lit("<section")), F.lit("</article"), F.lit("</section"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("html")) for k, v in zip(_ARTICLE_KINDS, (h, words, bare))])
    p = views.pages(spark, sf).withColumn("v", F.explode(kinds)).filter(F.contains("html", F.lit("</article>")) | (F.col("v.kind") == "stored"))
    return p.select("page_id", "v.kind", "url", "v.html")


_RAW_SQL = r"'(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>'"
_BARE_TEXT = ST.py_strip(ST.decode("regexp_replace(x, '<[^>]*>', '', 'g')"))
_DENSE_SQL = f"""
    , pc AS (SELECT page_id, kind, unnest(range(len(p))) AS i, unnest(p) AS x
             FROM (SELECT page_id, kind, regexp_split_to_array(regexp_replace(html, {_RAW_SQL}, '<!>', 'g'), {ST.q(f"(?i)</?(?:{AR.BLOCK_TAGS})" + chr(92) + "b[^>]*>")}) AS p
                   FROM v_article_pages) q)
    , bl AS (SELECT page_id, kind, i, {_BARE_TEXT} AS t, coalesce(list_sum(list_transform(
                 regexp_extract_all(x, {ST.q("(?is)<a" + chr(92) + "b[^>]*>(.*?)</a" + chr(92) + "s*>")}, 1), lambda x: length({_BARE_TEXT}))), 0) AS links FROM pc)
    , pf AS (SELECT *, sum(CASE WHEN t = '' THEN 0 ELSE length(t) - {AR.LINK_COST} * links - {AR.BLOCK_COST} END) OVER (PARTITION BY page_id, kind ORDER BY i) AS p FROM bl)
    , lo AS (SELECT *, least(0, coalesce(min(p) OVER (PARTITION BY page_id, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS m FROM pf)
    , hi AS (SELECT page_id, kind, min(i) AS j, arg_min(m, i) AS m FROM lo l
             WHERE p - m > 0 AND p - m = (SELECT max(z.p - z.m) FROM lo z WHERE z.page_id = l.page_id AND z.kind = l.kind) GROUP BY page_id, kind)
    , st AS (SELECT hi.page_id, hi.kind, j, greatest(CASE WHEN m = 0 THEN 0 ELSE -1 END, coalesce(max(pf.i) FILTER (WHERE pf.p = m AND pf.i < j) + 1, 0)) AS k
             FROM hi JOIN pf USING (page_id, kind) GROUP BY hi.page_id, hi.kind, j, m)
    , de AS (SELECT bl.page_id, bl.kind, string_agg(t, chr(10) ORDER BY i) AS primary_text FROM bl JOIN st USING (page_id, kind)
             WHERE i BETWEEN k AND j AND t <> '' GROUP BY bl.page_id, bl.kind)
"""


@register("a6_primary_text", with_views(_DENSE_SQL + """
    SELECT v.page_id, v.kind, coalesce(primary_text, '') AS primary_text FROM v_article_pages v LEFT JOIN de USING (page_id, kind)""",
    "v_article_pages"))
def q_a6_primary(spark, sf):
    """The densest run of blocks of every page, of three kinds of pages."""
    return _article_pages(spark, sf).select("page_id", "kind", AR.dense_text(F.col("html")).alias("primary_text"))


@register("a6_extract_articles", with_views(_DENSE_SQL + f"""
    , dt AS ({_publish_date_sql("SELECT page_id, kind, url, html FROM v_article_pages", "page_id, kind")})
    , ch AS (SELECT page_id, kind, url, {_title_sql('html')} AS title, CASE WHEN length(coalesce(primary_text, '')) >= 50 THEN 'primary'
                    WHEN length({_body_sql('html')}) >= 50 THEN 'fallback' END AS extracted_by,
                    CASE WHEN length(coalesce(primary_text, '')) >= 50 THEN primary_text ELSE {_body_sql('html')} END AS text
             FROM v_article_pages LEFT JOIN de USING (page_id, kind))
    SELECT page_id, kind, url, title, extracted_by, text, publish_date
    FROM (SELECT page_id, kind, url, title, extracted_by, {_collapse_sql(_lines_sql(_blocks_sql('text')))} AS text FROM ch WHERE extracted_by IS NOT NULL) c
    JOIN dt USING (page_id, kind) WHERE length(text) >= 50""", "v_article_pages"))
def q_a6(spark, sf):
    """Pages -> (title, text, publish_date) by the primary extractor, or the fallback on pages that need it."""
    a = AR.extract_articles(_article_pages(spark, sf))
    return a.select("page_id", "kind", "url", "title", "extracted_by", "text", "publish_date")


@register("a10_relevant", with_views(f"""
    SELECT id, title FROM v_news
    WHERE contains(coalesce(title, ''), '{_KW}') OR contains(coalesce(text, ''), '{_KW}')""", "v_news"))
def q_a10(spark, sf):
    return AR.relevant(views.news(spark, sf), _KW).select("id", "title")


@register("a11_relevance_stats", with_views(f"""
    SELECT source, CAST(count(*) FILTER (WHERE contains(coalesce(title, ''), '{_KW}') OR contains(coalesce(text, ''), '{_KW}')) AS BIGINT) AS relevant,
           CAST(count(*) FILTER (WHERE NOT (contains(coalesce(title, ''), '{_KW}') OR contains(coalesce(text, ''), '{_KW}'))) AS BIGINT) AS irrelevant
    FROM v_news GROUP BY source""", "v_news"))
def q_a11(spark, sf):
    return AR.relevance_stats(views.news(spark, sf), _KW, by=["source"])


add_view("v_news_dated", ("v_news",), """
    SELECT id, title, source, id % 2 = 0 AS date_filtered,
           CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '  '
                ELSE strftime(date, '%Y-%m-%d') || ' ' || lpad(CAST(id % 24 AS VARCHAR), 2, '0') || ':00' END AS publish_date
    FROM v_news""")


def _news_dated(spark, sf):
    n = views.news(spark, sf)
    m = F.col("id") % 5
    pd_ = (F.when(m == 0, F.lit(None).cast("string")).when(m == 1, F.lit("")).when(m == 2, F.lit("  "))
           .otherwise(F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit(" "),
                               F.lpad((F.col("id") % 24).cast("string"), 2, "0"), F.lit(":00"))))
    return n.select("id", "title", "source", (F.col("id") % 2 == 0).alias("date_filtered"), pd_.alias("publish_date"))


@register("a12_fill_date", with_views("""
    SELECT id, CASE WHEN (publish_date IS NULL OR publish_date = '') AND date_filtered THEN '1998-01-01'
                    ELSE publish_date END AS publish_date FROM v_news_dated""", "v_news_dated"))
def q_a12(spark, sf):
    return AR.fill_date(_news_dated(spark, sf), "1998-01-01").select("id", "publish_date")


@register("a13_dedup_title", with_views("""
    SELECT title, id FROM (SELECT title, id, row_number() OVER (PARTITION BY title ORDER BY id) AS r FROM v_news) x
    WHERE r = 1""", "v_news"))
def q_a13(spark, sf):
    return AR.dedup_title(views.news(spark, sf).select("title", "id"), ["id"])


@register("a14_date_window", with_views(f"""
    SELECT id, publish_date FROM (
      SELECT id, publish_date, CASE WHEN publish_date IS NULL OR {ST.py_strip('publish_date')} = '' THEN ''
                                    ELSE substring(publish_date, 1, 10) END AS d FROM v_news_dated) x
    WHERE (d >= '1998-01-10' AND d <= '1998-01-25') OR d = ''""", "v_news_dated"))
def q_a14(spark, sf):
    return AR.date_window_keep_undated(_news_dated(spark, sf), "1998-01-10", "1998-01-25").select("id", "publish_date")


# the crawl from stored pages to the news table: articles, relevance, missing dates, first of each title, date window
_CHAIN = ("2000-01-01", "2030-12-31")


@register("chain_articles", with_views(_DENSE_SQL + f"""
    , dt AS ({_publish_date_sql("SELECT page_id, kind, url, html FROM v_article_pages", "page_id, kind")})
    , ch AS (SELECT page_id, kind, url, {_title_sql('html')} AS title, coalesce(primary_text, '') AS p, {_body_sql('html')} AS b
             FROM v_article_pages LEFT JOIN de USING (page_id, kind))
    , ar AS (SELECT page_id, kind, url, title, {_collapse_sql(_lines_sql(_blocks_sql('text')))} AS text
             FROM (SELECT page_id, kind, url, title, CASE WHEN length(p) >= 50 THEN p ELSE b END AS text FROM ch WHERE length(p) >= 50 OR length(b) >= 50) c)
    , kp AS (SELECT page_id, kind, url, title, text, CASE WHEN coalesce(publish_date, '') = '' AND page_id % 2 = 0 THEN '{_CHAIN[0]}' ELSE publish_date END AS publish_date
             FROM ar JOIN dt USING (page_id, kind) WHERE length(text) >= 50 AND (contains(title, '{_KW}') OR contains(text, '{_KW}')))
    , f AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY page_id, kind) AS r FROM kp)
    SELECT page_id, kind, url, title, length(text) AS n_chars, publish_date FROM f
    WHERE r = 1 AND (coalesce(publish_date, '') = '' OR substring(publish_date, 1, 10) BETWEEN '{_CHAIN[0]}' AND '{_CHAIN[1]}')""", "v_article_pages"))
def q_chain_articles(spark, sf):
    """Pages -> articles -> relevant -> dated -> first of each title -> inside the window."""
    a = AR.relevant(AR.extract_articles(_article_pages(spark, sf)), _KW).withColumn("date_filtered", F.col("page_id") % 2 == 0)
    a = AR.dedup_title(AR.fill_date(a, _CHAIN[0]), ["page_id", "kind"])
    a = AR.date_window_keep_undated(a, *_CHAIN)
    return a.select("page_id", "kind", "url", "title", F.length("text").alias("n_chars"), "publish_date")


# --------------------------------------------------------------------------
# D: fuzzy news dedup
# --------------------------------------------------------------------------
from ..operators import dedup as DD  # noqa: E402

_NORM_SQL = ("regexp_replace(regexp_replace(coalesce(title, ''), " + ST.q(ST.re2(r"\s*-\s*\S+.*$")) + ", ''), "
             "'[^\\p{L}\\p{N}_]', '', 'g')")


@register("d1_normalize_title", with_views(f"SELECT id, {_NORM_SQL} AS norm FROM v_news", "v_news"))
def q_d1(spark, sf):
    return views.news(spark, sf).select("id", DD.normalize_title(F.col("title")).alias("norm"))


@register("d2_order_in_day", with_views("""
    SELECT id, strftime(date, '%Y-%m-%d') AS day,
           CAST(row_number() OVER (PARTITION BY date ORDER BY stock_id, date, id) AS INTEGER) AS rn
    FROM v_news""", "v_news"))
def q_d2(spark, sf):
    n = views.news(spark, sf).withColumn("day", DD.day_key(F.col("date")))
    return DD.order_in_day(n.select("id", "stock_id", "date", "day"), "day").select("id", "day", F.col("_rn").cast("int").alias("rn"))


@register("d3_day_key", with_views("SELECT id, substring(CAST(date AS VARCHAR), 1, 10) AS day FROM v_news", "v_news"))
def q_d3(spark, sf):
    return views.news(spark, sf).select("id", DD.day_key(F.col("date")).alias("day"))


def _dedup_nodes(spark, sf):
    n = views.news(spark, sf).withColumn("_day", DD.day_key(F.col("date"))) \
        .withColumn("_norm", DD.normalize_title(F.col("title")))
    # the texts tell rows of one id apart, by their hash; they are not carried along
    n = n.withColumn("_tie", F.xxhash64(*n.columns)).select("id", "stock_id", "date", "_day", "_norm", "_tie")
    n = DD.order_in_day(n, "_day", tie="_tie")
    first = n.groupBy("_day", "_norm").agg(F.min("_rn").alias("_node"))
    return first.withColumn("_len", F.length("_norm"))


# The key deletes characters from the title, so it is a subsequence of it and
# LCS(title, key) = len(key): the ratio has a closed form the oracle can use.
@register("d4_indel_ratio", with_views(f"""
    SELECT id, round(CASE WHEN length(coalesce(title, '')) + length(k) = 0 THEN 100.0
                          ELSE 200.0 * length(k) / (length(coalesce(title, '')) + length(k)) END, 6) AS ratio
    FROM (SELECT id, title, {_NORM_SQL} AS k FROM v_news) x""", "v_news"))
def q_d4(spark, sf):
    """Indel similarity (bit-parallel LCS UDF) of every raw title against its normalised key."""
    n = views.news(spark, sf)
    r = DD.indel_ratio(F.coalesce(F.col("title"), F.lit("")), DD.normalize_title(F.col("title")))
    return n.select("id", F.round(r, 6).alias("ratio"))


@register("d5_fuzzy_dedup")
def q_d5(spark, sf):
    """Keep-first fuzzy title dedup per day (threshold 85)."""
    return DD.fuzzy_dedup(views.news(spark, sf).select("id", "stock_id", "date", "title"))


@register("d6_dedup_stats")
def q_d6(spark, sf):
    return DD.dedup_stats(DD.fuzzy_dedup(views.news(spark, sf).select("id", "stock_id", "date", "title"), with_flag=True))


@register("d7_similar_pairs")
def q_d7(spark, sf):
    return DD.similar_pairs(_dedup_nodes(spark, sf)).select(F.col("_day").alias("day"), "lo", "hi", "ratio")

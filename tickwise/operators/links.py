"""Link tables from stored result pages.

The reference drives a browser over search-result pages; here the pages are
rows of a ``pages(page_id, url, html)`` table and every step is a column
expression, an explode, or a keyed aggregate.  "First wins" is decided by an
explicit ordinal (source rank, page, position), never by row order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.html import VOID_TAGS, decode_entities, get_text, let, markup_tokens
from ..functions.urls import canonical_url, resolve_url, url_host, url_path

# group 1: the href's value with its quotes, if it has any; group 2: the anchor's inner html
ANCHOR = r"""(?is)<a\b[^>]*?\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)[^>]*>(.*?)</a\s*>"""


def unquoted(value: Column) -> Column:
    return F.regexp_replace(value, r"""(?s)^(["'])(.*)\1$""", "$2")


def extract_links(pages: DataFrame, html: str = "html", keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """L1: every anchor of a page: (href, anchor text, 0-based position)."""
    hrefs = F.regexp_extract_all(F.col(html), F.lit(ANCHOR), F.lit(1))
    texts = F.regexp_extract_all(F.col(html), F.lit(ANCHOR), F.lit(2))
    return pages.select(*keep, F.posexplode(F.arrays_zip(hrefs.alias("h"), texts.alias("t"))).alias("pos", "_a")).select(
        *keep, "pos", decode_entities(unquoted(F.col("_a.h"))).alias("href"), get_text(F.col("_a.t")).alias("anchor_text"))


def link_rule(kind: str, **p) -> Column:
    """L4: the four article predicates of the reference, parameterised.

    * ``host_prefix``: host == p['host'] and path starts with p['prefix']
    * ``contains``: the URL contains both p['a'] and p['b']
    * ``numeric_id``: host contains p['domain'], host != p['search_host'], path ends '/' + 6+ digits
    * ``aspx``: host == p['host'] and '/news/' in path and path ends '.aspx'
    """
    u = F.col(p.get("col", "link"))
    host, path = url_host(u), url_path(u)
    if kind == "host_prefix":
        return (host == p["host"]) & F.startswith(path, F.lit(p["prefix"]))
    if kind == "contains":
        return F.contains(u, F.lit(p["a"])) & F.contains(u, F.lit(p["b"]))
    if kind == "numeric_id":
        return F.contains(host, F.lit(p["domain"])) & (host != p["search_host"]) & path.rlike(r"/\d{6,}$")
    if kind == "aspx":
        return (host == p["host"]) & F.contains(path, F.lit("/news/")) & F.endswith(path, F.lit(".aspx"))
    raise ValueError(kind)


def link_filter(df: DataFrame, kind: str, **p) -> DataFrame:
    return df.filter(link_rule(kind, **p))


def dedup_first(df: DataFrame, key: str | Sequence[str], ordinal: Sequence[str]) -> DataFrame:
    """One row per key, the one with the smallest ordinal.

    ``min_by`` over a struct is a partial aggregate: map-side combine keeps one
    candidate per key and task, so a hot key never gathers its rows in one task.
    Null keys form one group (as pandas does for ``drop_duplicates``).
    """
    keys = [key] if isinstance(key, str) else list(key)
    ordk = F.struct(*[F.col(c) for c in ordinal])
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in others]), ordk).alias("_w")).select(*keys, "_w.*")


def union_sources(parts: Sequence[tuple[DataFrame, str, bool]]) -> DataFrame:
    """Union with a literal source tag, the ``date_filtered`` flag and the source rank."""
    out = None
    for rank, (df, tag, flag) in enumerate(parts):
        d = df.withColumns({"source": F.lit(tag), "date_filtered": F.lit(flag), "source_rank": F.lit(rank)})
        out = d if out is None else out.unionByName(d)
    return out


def tag_sources(links: DataFrame, rank: Column, tags: Sequence[str], date_filtered: Sequence[bool]) -> DataFrame:
    """L9 over one table that holds all sources' links: ``rank`` (0-based) gives the
    tag and the flag, so the pages are scanned and parsed once."""
    at = (rank + 1).cast("int")
    return links.withColumns({
        "source": F.element_at(F.array(*map(F.lit, tags)), at),
        "date_filtered": F.element_at(F.array(*map(F.lit, date_filtered)), at),
        "source_rank": rank.cast("int"),
    })


def until_first_empty(links: DataFrame, page_list: DataFrame, source: str = "source", page: str = "page",
                      max_pages: int | None = None) -> DataFrame:
    """Keep links of the pages before the first page (in page order) that yields
    no new link; a crawl may also stop after ``max_pages`` pages per source.

    ``links`` are already first-wins deduplicated within the source (L8), so
    each row is a *new* link of its page; ``page_list`` lists every fetched page
    so that a page without links counts as empty.  A source's pages meet as two
    aggregates, its first empty and its last page.
    """
    pages = page_list.select(source, page).distinct()
    if max_pages is not None:  # ranks above the limit are dropped before the shuffle
        nth = F.row_number().over(Window.partitionBy(source).orderBy(page))
        pages = pages.withColumn("_rank", nth).filter(F.col("_rank") <= max_pages).drop("_rank")
    per_page = pages.join(links.groupBy(source, page).agg(F.count(F.lit(1)).alias("_new")), [source, page], "left")
    ends = per_page.groupBy(source).agg(F.min(F.when(F.col("_new").isNull(), F.col(page))).alias("_end"), F.max(page).alias("_last"))
    kept = links.join(ends, source).filter((F.col("_end").isNull() | (F.col(page) < F.col("_end"))) & (F.col(page) <= F.col("_last")))
    return kept.select(*links.columns)


def link_counts(df: DataFrame, source: str = "source", page: str = "page") -> DataFrame:
    """Links per page and per source (rollup rows carry null page / source)."""
    return df.rollup(source, page).agg(F.count(F.lit(1)).alias("n"))


# Block kinds tried in order when looking for labelled result blocks.
BLOCK_KINDS = [
    ("li", r"""\bclass\s*=\s*["']?[^"'>]*(?:js-stream-content|StreamMegaItem)"""),
    ("div", r"""\bclass\s*=\s*["']?[^"'>]*(?:NewsArticle|stream|news-item)"""),
    ("li", None),
]


def labelled_block_links(pages: DataFrame, label: str, keep: Sequence[str] = ("page_id", "url"),
                         accept: Callable[[Column], Column] | None = None, unseen: bool = False) -> DataFrame:
    """Result blocks whose text contains ``label``; each block gives its first link.

    Block kind fallback per page: the first kind that exists on the page is used.
    ``accept`` is the article predicate on an href (L4; none: every link).  With
    ``unseen`` a block gives its first link that no earlier block of the page gave;
    links given by earlier pages are left to L8.  One projection, no exchange.
    """
    links = block_links(F.col("html"), label, accept, unseen)
    return pages.select(*keep, F.explode(links).alias("_l")).select(*keep, "_l.block_pos", "_l.href")


def block_links(html: Column, label: str, accept: Callable[[Column], Column] | None = None, unseen: bool = False) -> Column:
    """L7's labelled blocks of a page as an array of (block_pos, href)."""
    found = []
    for tag, attr in BLOCK_KINDS:
        open_tag = rf"<{tag}\b[^>]*{attr}[^>]*>" if attr else rf"<{tag}\b[^>]*>"
        found.append(F.regexp_extract_all(html, F.lit(rf"(?is){open_tag}(.*?)</{tag}\s*>"), F.lit(1)))
    blocks = F.coalesce(*[let(k, lambda x: F.when(F.size(x) > 0, x)) for k in found])
    placed = F.transform(blocks, lambda b, i: F.struct(i.alias("block_pos"), b.alias("block")))
    labelled = F.filter(placed, lambda x: F.contains(get_text(x["block"]), F.lit(label)))

    def give(given: Column, x: Column) -> Column:
        hrefs = F.transform(F.regexp_extract_all(x["block"], F.lit(ANCHOR), F.lit(1)), lambda h: decode_entities(unquoted(h)))
        if accept is not None:
            hrefs = F.filter(hrefs, accept)
        if unseen:
            hrefs = F.filter(hrefs, lambda h: ~F.exists(given, lambda g: g["href"] == h))
        return F.concat(given, F.transform(F.slice(hrefs, 1, 1), lambda h: F.struct(x["block_pos"].alias("block_pos"), h.alias("href"))))

    return F.aggregate(labelled, F.array().cast("array<struct<block_pos:int,href:string>>"), give)


LEVELS = 8  # enclosing blocks that are tried for a label

_TEXT, _OPEN, _CLOSE, _END = 1, 2, 3, 4
_TOKEN = "struct<kind:int,name:string,href:string,label:boolean>"
_STATE = ("struct<names:array<string>,nos:array<int>,first:array<string>,texted:array<boolean>,"
          "waiting:array<struct<no:int,level:int>>,given:array<struct<no:int,href:string>>,opened:int>")


def _token(label: str, url: Column, mode: str, accept: Callable[[Column], Column] | None):
    """A tag or text as (kind, name, accepted link of an anchor, text holds the label); kind is null for tags that open nothing."""
    def of(t: Column) -> Column:
        tag = F.startswith(t, F.lit("<")) & F.endswith(t, F.lit(">"))
        name = F.lower(F.regexp_extract(t, r"^</?([a-zA-Z][^\s/>]*)", 1))
        kind = (F.when(~tag, _TEXT).when(name.isin("", *VOID_TAGS) | F.endswith(t, F.lit("/>")), F.lit(None))
                .when(F.startswith(t, F.lit("</")), _CLOSE).otherwise(_OPEN))
        raw = F.regexp_extract(t, r"""(?is)^<a\b[^>]*?\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
        link = F.when(raw != "", canonical_url(resolve_url(decode_entities(unquoted(raw)), url), mode))
        if accept is not None:
            link = let(link, lambda x: F.when(accept(x), x))
        held = ~tag & F.contains(F.trim(F.regexp_replace(decode_entities(t), r"\s+", " ")), F.lit(label))
        return F.struct(kind.alias("kind"), name.alias("name"), link.alias("href"), held.alias("label")).cast(_TOKEN)
    return of


def _walk(levels: int):
    """One token's change of the open elements; a label waits until one of its enclosing blocks has a link.

    ``first`` holds the first link inside each open element (a link lies in all
    of them, so the entries with one come first); ``waiting`` the labels whose
    nearest enclosing blocks have none yet, with the level of their element.
    """
    def state(at: Column, **new: Column) -> Column:
        fields = ("names", "nos", "first", "texted", "waiting", "given", "opened")
        return F.struct(*[new.get(f, at[f]).alias(f) for f in fields]).cast(_STATE)

    def text(at: Column, t: Column) -> Column:
        depth = F.size(at["names"])
        own = F.element_at(at["nos"], -1)
        link = F.when(depth > 1, F.try_element_at(at["first"], depth - 1))
        now = t["label"] & (depth > 1)
        seen = state(
            at, texted=F.concat(F.slice(at["texted"], 1, depth - 1), F.array(F.lit(True))),
            given=F.when(now & link.isNotNull(), F.concat(at["given"], F.array(F.struct(own.alias("no"), link.alias("href"))))).otherwise(at["given"]),
            waiting=F.when(now & link.isNull(), F.concat(at["waiting"], F.array(F.struct(own.alias("no"), depth.alias("level"))))).otherwise(at["waiting"]))
        # only the first text of an element counts
        return F.when((depth == 0) | F.coalesce(F.try_element_at(at["texted"], F.greatest(depth, F.lit(1))), F.lit(True)), at).otherwise(seen)

    def opening(at: Column, t: Column) -> Column:
        link = t["href"]
        return state(
            at, names=F.concat(at["names"], F.array(t["name"])), nos=F.concat(at["nos"], F.array(at["opened"])),
            first=F.concat(F.transform(at["first"], lambda f: F.coalesce(f, link)), F.array(F.lit(None).cast("string"))),
            texted=F.concat(at["texted"], F.array(F.lit(False))), opened=at["opened"] + 1,
            given=F.when(link.isNotNull(), F.concat(at["given"], F.transform(
                at["waiting"], lambda w: F.struct(w["no"].alias("no"), link.alias("href"))))).otherwise(at["given"]),
            waiting=F.when(link.isNotNull(), F.slice(at["waiting"], 1, 0)).otherwise(at["waiting"]))

    def closing(at: Column, t: Column) -> Column:
        depth = F.size(at["names"])
        back = F.array_position(F.reverse(at["names"]), t["name"]).cast("int")

        def cut(x: Column) -> Column:  # x: elements that stay open, elements that have a link
            left, linked = x["left"], x["linked"]

            def block(w: Column) -> Column:  # the innermost enclosing element with a link
                return F.least(linked, w["level"] - 1)

            def ready(w: Column) -> Column:
                return block(w) >= F.greatest(left, w["level"] - levels, F.lit(1))

            done = F.transform(F.filter(at["waiting"], ready), lambda w: F.struct(
                w["no"].alias("no"), F.element_at(at["first"], block(w)).alias("href")))
            kept = F.filter(at["waiting"], lambda w: ~ready(w) & (F.least(left, w["level"] - 1) >= F.greatest(w["level"] - levels, F.lit(1))))
            return state(at, **{f: F.slice(at[f], F.lit(1), left) for f in ("names", "nos", "first", "texted")},
                         waiting=kept, given=F.concat(at["given"], done))

        left = F.when(t["kind"] == _END, 0).otherwise(depth - back)
        closed = let(F.struct(left.alias("left"), F.size(F.filter(at["first"], lambda f: f.isNotNull())).alias("linked")), cut)
        return F.when((t["kind"] == _END) | (back > 0), closed).otherwise(at)  # a stray end tag closes nothing

    def step(at: Column, t: Column) -> Column:
        return F.when(t["kind"] == _TEXT, text(at, t)).when(t["kind"] == _OPEN, opening(at, t)).otherwise(closing(at, t))
    return step


def nearest_links(html: Column, url: Column, label: str, mode: str = "query_fragment",
                  accept: Callable[[Column], Column] | None = None, levels: int = LEVELS) -> Column:
    """L7, first method, as an array of links: every element whose first text holds ``label`` gives the first
    accepted link of the nearest enclosing block, up to ``levels`` blocks out; a page gives a link once, in the
    order of the labels.  Empty for pages without the label, null ones included.

    One walk over a page's tags with the open elements as state: an end tag closes
    what is still open inside its element, end tags without one are passed over,
    and elements never closed reach to the end.  The state is as long as the
    nesting is deep, so a page costs its tags times its depth, in the JVM and
    without an exchange.
    """
    tokens = F.filter(F.transform(markup_tokens(html), _token(label, url, mode, accept)), lambda t: t["kind"].isNotNull())
    end = F.array(F.struct(F.lit(_END).alias("kind"), F.lit("").alias("name"), F.lit(None).cast("string").alias("href"),
                           F.lit(False).alias("label")).cast(_TOKEN))
    none = F.array()
    start = F.struct(*[none.alias(f) for f in ("names", "nos", "first", "texted", "waiting", "given")], F.lit(0).alias("opened")).cast(_STATE)
    given = F.aggregate(F.concat(tokens, end), start, _walk(levels))["given"]
    links = F.array_distinct(F.transform(F.array_sort(given), lambda g: g["href"]))
    held = F.contains(decode_entities(F.coalesce(html, F.lit(""))), F.lit(label.split(" ")[0]))  # others are not walked
    return F.when(held, links).otherwise(F.array().cast("array<string>"))


def labelled_links(pages: DataFrame, label: str, mode: str = "query_fragment", accept: Callable[[Column], Column] | None = None,
                   keep: Sequence[str] = ("page_id", "url"), html: str = "html", url: str = "url") -> DataFrame:
    """L7 whole: the nearest blocks' links; a page that has none gives its labelled blocks' (``block_links``).

    (keep, pos, link, found_by): pos numbers the links of a page from 0.  Pages are
    projected, not joined; links that earlier pages gave are left to L8.
    """
    def whole(href: Column) -> Column:
        return canonical_url(resolve_url(href, F.col(url)), mode)

    blocks = F.transform(block_links(F.col(html), label, accept and (lambda h: accept(whole(h))), unseen=True), lambda g: whole(g["href"]))
    near = pages.select(*keep, nearest_links(F.col(html), F.col(url), label, mode, accept).alias("_near"),
                        F.coalesce(blocks, F.array().cast("array<string>")).alias("_blocks"))
    by_block = F.size("_near") == 0
    links = F.when(by_block, F.array_distinct("_blocks")).otherwise(F.col("_near"))
    return near.select(*keep, F.when(by_block, "block").otherwise("nearest").alias("found_by"), F.posexplode(links).alias("pos", "link"))


def links_from_pages(pages: DataFrame, mode: str = "query_fragment") -> DataFrame:
    """L1 + L2 + L3: resolved, canonical links with their ordinal on the page."""
    a = extract_links(pages)
    return a.withColumn("link", canonical_url(resolve_url(F.col("href"), F.col("url")), mode))

"""Main text of web pages by union-free wrappers inferred per host.

A page's tags and texts become a stream of tokens, nested into elements (ends
that HTML lets a page leave out are implied; inline elements make no token).  A
wrapper is a union-free regular expression over such streams: a sequence of
elements, each plain, optional ``( )?`` or repeated ``( )+``, whose text is a
constant or a slot.  Pages of a host are aligned with the wrapper one after the
other: runs of like elements fold into repeated groups, elements that only one
side has become optional, differing texts become slots.  Alignment is
associative enough to fold per partition and merge the partial wrappers, so
every page of a host takes part and a large host is never gathered in one task.

From the wrapper a host's plan is read: the element that holds the article (an
article or main element, else the container with the most text in slots) and
the texts that are constant over the host's different pages, which are template
where a page has none of these elements; below one, no text is left out for being
constant.  A page's text is all text below that element, but
for the regions that are no article by their tag, role, class or id (menus,
headers, footers, sidebars, notices, adverts, forms, comments).  Words of a class
or id do not count on an element that encloses the article: where a hidden article
or main element holds more text than all that can be seen, or the host's element
is inside, the elements around it open.  A page that
does not have its host's element is read by the same rules on its own.
"""

from __future__ import annotations

import html
import json
import re
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .url_templates import split_url

DEPTH = 150          # deeper elements count as children of the element at this depth
CONST_PAGES = 5      # different pages from which a constant text outside an article element is template
SKETCH = 64          # different pages by which an element's share of the host's pages is told
SALTS = 32           # partial wrappers of a host are merged in so many groups first
WIDE = 250_000       # alignment cells from which like siblings are folded first

# Element names and the words of roles, classes and ids that mark regions.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var wbr img br picture source map area".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object canvas".split())
DROP = frozenset("head nav footer aside form button select menu dialog label fieldset audio video".split()) | RAW
CLOSES = {  # an element that starts ends these open ones
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
                   "hgroup hr main menu nav ol p pre section table ul li dt dd".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BAD_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies "
                      "consent gdpr notice notices popup modal overlay newsletter subscribe subscription sidebar sidebars menu menus nav "
                      "navbar navigation breadcrumb breadcrumbs footer masthead comment comments reply replies respond disqus share "
                      "sharing social related recommended recommendations widget widgets form login signup search skip toolbar "
                      "pagination pager copyright disclaimer alert paywall topbar".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
GOOD_WORDS = frozenset("content article post entry story main body text maintext articlebody".split())

# words that say where or what shape a region is; beside them a bad word still names the region
NEUTRAL = frozenset("area bar block bottom box btn button buttons center col column container cta element global group header heading "
                    "holder icon icons inline inner item items label left link links list main module outer page panel posts right row "
                    "section site slot stories tools top unit user wrap wrapper".split())

# a quote opens a value only behind an equals sign; elsewhere, and where it never ends, it is a character like others
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:"[^"]*"|'[^']*')|[^>])*?)(?:>|\Z)|([^<]+|<)""", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "sig", "bad", "good", "kids", "weak")

    def __init__(self, tag: str, sig: str, bad: bool, good: bool, weak: bool = False):
        self.tag, self.sig, self.bad, self.good, self.kids = tag, sig, bad, good, []
        self.weak = weak   # bad by words of its class or id only


def _names_region(token: str) -> bool:
    """Whether a class or id, such as ``share-buttons``, names a region; ``share-price`` does not."""
    words = set(_WORDS.findall(token))
    return bool(words & BAD_WORDS) and all(len(w) == 1 or w in BAD_WORDS or w in NEUTRAL or w in GOOD_WORDS for w in words)


def _open(tag: str, attrs: str, stack: list[Node]) -> Node:
    """An element with the marks of its attributes; inside an article its class must name a region, not only hold a word."""
    if not attrs.strip():
        return Node(tag, tag, tag in DROP, tag in ("article", "main"))
    sig, words, tokens, bad = tag, set(), [], tag in DROP
    good = tag in ("article", "main")
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("id", "class"):
            parted = re.sub(r"([a-z0-9])([A-Z])", r"\1-\2", a or b or c).lower()
            found = _WORDS.findall(parted)
            words.update(found)
            tokens += parted.split()
            sig += ("#" if name == "id" else ".") + ".".join(found)
        elif name == "role":
            bad |= value in BAD_ROLES
            good |= value == "main"
        elif name == "itemprop":
            good |= value == "articlebody"
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            bad = True
    weak = not bad and tag not in ("html", "body", "article", "main") and bool(words & BAD_WORDS)
    if weak and any(k.tag in ("article", "main") and not k.bad for k in stack):
        weak = any(map(_names_region, tokens))
    bad |= weak
    if tag in ("article", "main") and words & {"comment", "comments", "reply", "ad", "advert", "related", "promo"}:
        bad = True
    return Node(tag, sig, bad, good or (tag in ("div", "section", "td") and bool(words & GOOD_WORDS)), weak)


def _size(node: Node) -> int:
    """Characters of text below an element, outside bad regions."""
    return sum(len(k[0].strip()) if isinstance(k, tuple) else 0 if k.bad else _size(k) for k in node.kids)


def _reveal(root: Node) -> None:
    """Open, from the outside in, the regions by class words around an article that holds more text than all articles to be seen."""
    while True:
        hidden: list[tuple[int, Node]] = []

        def walk(node: Node, outer: Node | None, inside: bool) -> int:
            seen = 0
            for k in node.kids:
                if isinstance(k, tuple) or k.bad and not k.weak:
                    continue
                shut = k if k.bad and outer is None else outer
                here = not k.bad and k.tag in ("article", "main")
                if here and shut is not None:
                    hidden.append((_size(k), shut))
                elif here and not inside:
                    seen += _size(k)
                seen += walk(k, shut, inside or here)
            return seen

        seen = walk(root, None, False)
        most = max(hidden, key=lambda x: x[0], default=(0, None))
        if most[0] <= seen:
            return
        most[1].bad = False


def _reveal_path(node: Node, path: str, goal: str) -> None:
    """Open the regions by class words around the host's element, on a page that has it."""
    for k in node.kids:
        if isinstance(k, Node) and (not k.bad or k.weak) and goal.startswith(f"{path}/{k.sig}/"):
            if not k.bad or _has(k, f"{path}/{k.sig}", goal):
                k.bad = False
                _reveal_path(k, f"{path}/{k.sig}", goal)


def _has(node: Node, path: str, goal: str) -> bool:
    return any(isinstance(k, Node) and (not k.bad or k.weak) and (
        f"{path}/{k.sig}" == goal or goal.startswith(f"{path}/{k.sig}/") and _has(k, f"{path}/{k.sig}", goal)) for k in node.kids)


def parse(page: str) -> Node:
    """Tree of block elements; kids are nodes and (text, in a link) pairs, texts with references decoded."""
    root = Node("#", "#", False, False)
    stack, links, at, hidden = [root], 0, 0, []   # hidden: open inline elements that mark a bad region
    n = len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        text = m.group(4)
        if text:
            if not hidden:
                stack[-1].kids.append((html.unescape(text), links > 0))
            continue
        if m.group(2) is None:
            continue
        tag = m.group(2).lower()
        if m.group(1):
            if tag in INLINE:
                if tag == "a" and links:
                    links -= 1
                if hidden and hidden[-1] == tag:
                    hidden.pop()
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    links, hidden = 0, []
                    break
            continue
        if tag in INLINE:
            if tag == "a":
                links += 1
            if tag == "br":
                stack[-1].kids.append((" ", False))
            elif tag not in VOID and not m.group(3).endswith("/") and (hidden or m.group(3).strip() and _open(tag, m.group(3), stack).bad):
                hidden.append(tag)
            continue
        node = _open(tag, m.group(3), stack)
        links, hidden = 0, []
        ends = CLOSES.get(tag, ())
        if tag in ENDS_P and stack[-1].tag in ("p", *HEADINGS) and not (stack[-1].tag in HEADINGS and tag not in HEADINGS and tag != "p"):
            stack.pop()
        if tag in CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ends:
                    del stack[k:]
                    break
                if stack[k].tag in ("ul", "ol", "dl", "table", "select", "article", "section", "div"):
                    break
        stack[-1].kids.append(node)
        if tag in RAW:
            close = re.compile(f"</{tag}(?=[\\s/>]|\\Z)", re.I).search(page, at)
            at = n if close is None else close.start()
        elif tag in VOID or m.group(3).endswith("/"):
            continue
        if len(stack) < DEPTH:
            stack.append(node)
    _reveal(root)
    return root


# ---- wrappers ---------------------------------------------------------------------------------------
# A wrapper element is a list [sig, optional, repeated, pages, text, chars, link_chars, good, bad, kids, seen];
# text: "" none, a digest for a constant, None for a slot; seen, of constants and of the whole page only: the
# SKETCH smallest digests of the texts of the pages that have it, so that copies of a page count once.
SIG, OPT, REP, PAGES, TEXT, CHARS, LINKS, GOOD, BAD, KIDS, SEEN = range(11)


def _merge(a: list, b: list) -> list:
    """Align two wrapper elements of one signature."""
    same = a[TEXT] == b[TEXT]
    seen = sorted({*a[SEEN], *b[SEEN]})[:SKETCH] if same and a[TEXT] or a[SIG] == "#" else []
    return [a[SIG], a[OPT] or b[OPT], a[REP] or b[REP], a[PAGES] + b[PAGES], a[TEXT] if same else None,
            a[CHARS] + b[CHARS], a[LINKS] + b[LINKS], a[GOOD] or b[GOOD], a[BAD] and b[BAD], align(a[KIDS], b[KIDS]), seen]


def _within(a: list, b: list) -> list:
    """Fold two siblings of one page into a repeated element."""
    out = _merge(a, b)
    out[REP], out[PAGES] = True, max(a[PAGES], b[PAGES])
    return out


def fold(kids: list) -> list:
    """Runs of like siblings, and of like groups of two or three, become repeated."""
    out: list = []
    for k in kids:
        if out and out[-1][SIG] == k[SIG]:
            out[-1] = _within(out[-1], k)
        else:
            out.append(k)
    for width in (2, 3):
        at = 0
        while at + 2 * width <= len(out):
            if all(out[at + i][SIG] == out[at + width + i][SIG] for i in range(width)):
                for i in range(width):
                    out[at + i] = _within(out[at + i], out[at + width + i])
                del out[at + width:at + 2 * width]
            else:
                at += 1
    return out


def _by_sig(kids: list) -> list:
    seen: dict = {}
    for k in kids:
        seen[k[SIG]] = _within(seen[k[SIG]], k) if k[SIG] in seen else k
    return list(seen.values())


def align(a: list, b: list) -> list:
    """Longest common alignment of two sequences; what only one side has becomes optional."""
    if [k[SIG] for k in a] == [k[SIG] for k in b]:
        return [_merge(x, y) for x, y in zip(a, b, strict=True)]
    if len(a) * len(b) > WIDE:
        a, b = _by_sig(a), _by_sig(b)
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][SIG] == b[j][SIG] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i][SIG] == b[j][SIG]:
            out.append(_merge(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append([a[i][SIG], True, *a[i][REP:]])
            i += 1
        else:
            out.append([b[j][SIG], True, *b[j][REP:]])
            j += 1
    return fold(out)


def _texts(node: Node) -> str:
    return " ".join(k[0] if isinstance(k, tuple) else _texts(k) for k in node.kids)


def wrap(node: Node, page: int | None = None) -> list:
    """Wrapper of one page; ``page``: the digest of its text."""
    if page is None:
        page = zlib.crc32(_SPACE.sub(" ", _texts(node)).strip().encode("utf-8", "replace"))
    own = _SPACE.sub(" ", "".join(k[0] for k in node.kids if isinstance(k, tuple))).strip()
    linked = sum(len(k[0].strip()) for k in node.kids if isinstance(k, tuple) and k[1])
    digest = format(zlib.crc32(own.encode("utf-8", "replace")), "x") if own else ""
    kids = [] if node.tag in RAW or node.tag == "head" else fold([wrap(k, page) for k in node.kids if isinstance(k, Node)])
    return [node.sig, False, False, 1, digest, len(own), linked, node.good, node.bad, kids,
            [page] if digest or node.sig == "#" else []]


def expression(wrapper: list) -> str:
    """The wrapper as a regular expression to read."""
    inner = ("#slot " if wrapper[TEXT] is None else "#text " if wrapper[TEXT] else "") + " ".join(map(expression, wrapper[KIDS]))
    body = f"<{wrapper[SIG]}>{inner.strip()}"
    mark = ("+" if wrapper[REP] else "") + ("?" if wrapper[OPT] else "")
    return f"({body}){mark}" if mark else body


def plan_of(wrapper: list) -> dict:
    """{'root': path of the element that holds the article, 'constant': [path and digest of template texts]}."""
    found: list[tuple[int, int, str]] = []
    constant: list[str] = []
    total = set(wrapper[SEEN])

    def mass(e: list) -> tuple[int, int]:
        """Characters outside bad regions, and of them in links."""
        if e[BAD]:
            return 0, 0
        below = [mass(k) for k in e[KIDS]]
        return e[CHARS] + sum(x for x, _ in below), e[LINKS] + sum(y for _, y in below)

    def walk(e: list, path: str) -> None:
        if e[BAD]:
            return
        chars, links = mass(e)
        kind = e[SIG].split("#")[0].split(".")[0]
        rank = 3 if kind == "article" else 2 if kind == "main" else 1 if e[GOOD] else 0
        if rank and chars > 2 * links:
            found.append((rank, chars, path))
        if e[TEXT] and len(e[SEEN]) >= CONST_PAGES and 2 * len(total.intersection(e[SEEN])) > len(total):
            constant.append(f"{path} {e[TEXT]}")
        for k in e[KIDS]:
            walk(k, f"{path}/{k[SIG]}")

    walk(wrapper, wrapper[SIG])
    root = max(found, key=lambda x: (x[0], x[1], x[2]))[2] if found else None
    return {"root": root, "constant": sorted(constant)}


def blocks(node: Node, path: str, constant: frozenset, headings_only: bool = False) -> list[str]:
    """Text blocks below an element, in page order."""
    out: list[str] = []
    text: list[str] = []

    def end() -> None:
        if line := _SPACE.sub(" ", "".join(text)).strip():
            out.append(line)
        text.clear()

    own = _SPACE.sub(" ", "".join(k[0] for k in node.kids if isinstance(k, tuple))).strip() if constant else ""
    template = own and f"{path} {zlib.crc32(own.encode('utf-8', 'replace')):x}" in constant
    for k in node.kids:
        if isinstance(k, tuple):
            if not template and not headings_only:
                text.append(k[0])
            continue
        end()
        if k.bad:
            continue
        only = (headings_only or k.tag == "header") and k.tag not in HEADINGS
        out.extend(blocks(k, f"{path}/{k.sig}", constant, only))
    end()
    return out


def _find(node: Node, path: str, test) -> list[tuple[Node, str]]:
    """Outermost elements that pass, outside bad regions."""
    out = []
    for k in node.kids:
        if isinstance(k, Node) and not k.bad:
            here = f"{path}/{k.sig}"
            out.extend([(k, here)] if test(k, here) else _find(k, here, test))
    return out


def extract_text(page: str | None, plan: dict | None) -> str:
    """Main text of a page under its host's plan; empty for null and empty pages."""
    if not page:
        return ""
    tree = parse(page)
    plan = plan or {"root": None, "constant": []}
    if plan["root"]:
        _reveal_path(tree, tree.sig, plan["root"])
    constant = frozenset(plan["constant"])
    tests = [lambda k, p: p == plan["root"], lambda k, p: k.tag == "article", lambda k, p: k.tag == "main",
             lambda k, p: k.good, lambda k, p: k.tag == "body"]
    for n, test in enumerate(tests):
        if roots := _find(tree, tree.sig, test):
            sure, whole = n < 3, n == 4   # template is left out of whole pages only
            lines = [x for node, path in roots for x in blocks(node, path, constant if whole else frozenset())]
            if lines or sure:
                return "\n\n".join(lines)
    return "\n\n".join(blocks(tree, tree.sig, constant))


# ---- Spark ------------------------------------------------------------------------------------------
def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper): ``pages`` (host, html) aligned per partition, the partial wrappers merged in two steps."""
    def partial(batches):
        known: dict[str, list] = {}
        for batch in batches:
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                one = wrap(parse(page or ""))
                known[host] = _merge(known[host], one) if host in known else one
        yield pa.RecordBatch.from_arrays([pa.array(list(known), pa.string()), pa.array([json.dumps(w) for w in known.values()], pa.string())],
                                         ["host", "wrapper"])

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        found = None
        for w in group["wrapper"].sort_values():
            found = json.loads(w) if found is None else _merge(found, json.loads(w))
        return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [json.dumps(found)]})

    rows = pages.select("host", "html").mapInArrow(partial, "host string, wrapper string")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    some = rows.groupBy("host", "salt").applyInPandas(lambda g: merge(g), "host string, wrapper string")
    return some.groupBy("host").applyInPandas(lambda g: merge(g), "host string, wrapper string")


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, host): the main text of every row of ``pages`` (page_id, url, html).

    Null and empty html give an empty text; pages without a host share the empty
    host; repeated rows get equal texts; an empty table gives an empty result;
    further columns are ignored.
    """
    host, _ = split_url(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        host.alias("host"), F.col("html").cast("string").alias("html"))
    plan = F.udf(lambda w: json.dumps(plan_of(json.loads(w))), "string")   # one row per host
    plans = written(infer_wrappers(rows).select("host", plan("wrapper").alias("plan")), "html-plans")

    def run(batches):
        known: dict[str, dict] = {}
        for batch in batches:
            texts = []
            for plan, page in zip(batch.column("plan").to_pylist(), batch.column("html").to_pylist(), strict=True):
                if plan is not None and plan not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[plan] = json.loads(plan)
                texts.append(extract_text(page, known.get(plan)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64()), batch.column("host")], ["page_id", "url", "text", "n_chars", "host"])

    # the plans are small: Spark broadcasts them if their written size allows, else shuffles both sides
    joined = rows.join(plans, "host", "left").select("page_id", "url", "host", "html", "plan")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long, host string")

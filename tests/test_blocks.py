"""Nearest enclosing blocks and balanced bodies against a plain tree of the same markup."""

import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from tickwise.functions.html import VOID_TAGS, balanced_inner, drop_balanced, without_raw
from tickwise.operators import links as LK
from tickwise.operators.articles import page_body


class Tree(HTMLParser):
    """Elements as [name, parent, first text, position]; links as (position, element, href)."""

    def __init__(self, html):
        super().__init__()
        self.open, self.elements, self.links = [], [], []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in VOID_TAGS:
            return
        parent = self.open[-1] if self.open else None
        e = {"tag": tag, "parent": parent, "text": None}
        self.elements.append(e)
        if tag == "a" and dict(attrs).get("href"):
            self.links.append((e, dict(attrs)["href"]))
        self.open.append(e)

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        at = max((i for i, e in enumerate(self.open) if e["tag"] == tag), default=None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data):
        if self.open and self.open[-1]["text"] is None:
            self.open[-1]["text"] = data


def above(e):
    while e["parent"] is not None:
        e = e["parent"]
        yield e


def nearest(html, label, levels=8):
    tree = Tree(html)
    out = []
    for e in tree.elements:
        if e["text"] is None or label not in " ".join(e["text"].split()):
            continue
        for hops, block in enumerate(above(e)):
            if hops == levels:
                break
            link = next((h for a, h in tree.links if any(x is block for x in above(a))), None)
            if link is not None:
                if link not in out:
                    out.append(link)
                break
    return out


def some_page(rng):
    out = []
    for _ in range(rng.randint(1, 45)):
        out.append(rng.choice(["<div>", "<div class=x>", "<p>", "<LI >", "<ul>", "</div>", "</div>", "</p>", "</li>", "</ul>", "<br>", "<img/>",
                               "the  label", "other", " ", f"<a href='/n/{rng.randint(0, 9)}'>t</a>", f"<A class=q HREF=\"/n/{rng.randint(0, 9)}\">",
                               "</a>", "<i>label</i>", "<b>label</b>", "<a name=x>", "<a href=/skip>s</a>"]))
    return "".join(out)


def frame(spark, pages):
    return spark.createDataFrame([(i, "http://h/p?q", h, "mine") for i, h in enumerate(pages)], "page_id long, url string, html string, link string")


@pytest.mark.parametrize("levels", [1, 3, 8])
def test_nearest_links_match_a_tree(spark, levels):
    rng = random.Random(levels)
    pages = [some_page(rng) for _ in range(400)] + [None, "", "label", "<div>label</div>", "<div>" * 300 + "<p>label</p><a href=/n/1>x</a>"]
    ok = lambda u: F.contains(u, F.lit("/n/"))
    got = frame(spark, pages).select("page_id", LK.nearest_links(F.col("html"), F.col("url"), "label", accept=ok, levels=levels).alias("l")).collect()
    found = 0
    for r in got:
        html = (pages[r.page_id] or "").replace("<a href=/skip>", "<a>")
        want = ["http://h" + h for h in nearest(html, "label", levels)]
        assert r.l == want, pages[r.page_id]
        found += len(want)
    assert found > 50


def test_label_spelt_with_references_and_white_space(spark):
    pages = ["<div><p> R&amp;D\n news</p><a href='/a?x=1'>1</a></div>", "<div><script>R&D news</script><a href=/b>1</a></div>"]
    got = LK.labelled_links(frame(spark, pages), "R&D news").collect()
    assert [(r.page_id, r.found_by, r.link, r.pos) for r in got] == [(0, "nearest", "http://h/a", 0)]


def test_pages_without_a_near_link_give_their_blocks(spark):
    pages = ["<ul><li>x <b>y</b> label <a href=/n/1>1</a></li><li>label<a href=/n/1>1</a><a href=/n/2>2</a></li></ul>",
             "<li>q<i>w</i> label <a href=/n/3>1</a></li>", "<div>label</div>"]
    got = LK.labelled_links(frame(spark, pages), "label", accept=lambda u: F.contains(u, F.lit("/n/"))).collect()
    assert sorted((r.page_id, r.found_by, r.pos, r.link) for r in got) == [
        (0, "nearest", 0, "http://h/n/1"), (1, "block", 0, "http://h/n/3")]


def test_body_ends_at_its_own_tag(spark):
    inner = "one<div>two<DIV\nid=z>three</DIV ></div><aside>no<aside>no</aside>no</aside><div/>four"
    pages = [f"<div class='article-body'>{inner}</div><div>after</div>", f"<div id=main>{inner}</div></div>x",
             f"<article>{inner}<article>five</article></article>after", f"<div class=story-body>{inner}", "<article/>", None, "<p>none</p>",
             "<article><!-- </article> -->a<script>'</article>'</script><nav>x<p>y</nav>b</article>c", "<article>a<footer>rest"]
    got = {r.page_id: r.b for r in frame(spark, pages).select("page_id", page_body(F.col("html")).alias("b")).collect()}
    text = "one\ntwo\nthree\nfour"
    assert [got[i] for i in range(9)] == [text, text, text + "\nfive", text, "", "", "", "a\nb", "a"]


def test_balanced_matches_a_counter(spark):
    rng = random.Random(9)
    parts = ["<div>", "</div>", "<div class=a>", "</DIV >", "x", "<p>", "<aside>", "</aside>", "<divx>", "\n"]
    pages = ["<div>" + "".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(300)] + ["<div>" + "<div>a</div>" * 5000 + "</div>b"]
    got = frame(spark, pages).select("page_id", balanced_inner(without_raw(F.col("html")), "div").alias("b"),
                                     drop_balanced(F.col("html"), ["aside"]).alias("d")).collect()
    import re
    for r in got:
        depth, at = 0, None
        for m in re.finditer(r"(?i)<(/?)div\b[^>]*>", pages[r.page_id]):
            depth += -1 if m.group(1) else 1
            if depth == 0:
                at = m.start()
                break
        want = pages[r.page_id][5:at]
        assert re.sub(r"(?i)</div\s*>", "</div>", want) == re.sub(r"(?i)</div\s*>", "</div>", r.b)
        out, depth = "", 0
        for piece in re.split(r"(</?aside>)", pages[r.page_id]):
            if piece == "<aside>":
                depth += 1
            elif piece == "</aside>" and depth:
                depth -= 1
            elif not depth and piece != "</aside>":
                out += piece
        assert r.d.replace("</aside>", "").replace("<!>", "") == out

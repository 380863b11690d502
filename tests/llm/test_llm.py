"""The ten operators and the pipeline against brute force, round trips and edge cases."""

import base64
import hashlib
import itertools
import re

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tickwise.llm import chat, html_wrapper, langid, mixing, nn_descent, perm_index, simhash, url_templates, warc
from tickwise.llm import sentencepiece_nbest as sp
from tickwise.llm.queries import QUERIES
from tickwise.sources.files import scratch_path

SF = "/root/testdata/sf0.001"
WORD = "[^\x20\x09-\x0d]+"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, label int"


def docs_frame(spark, rows):
    return spark.createDataFrame([(i, t, l, s, None if t is None else len(t), "mine", 1) for i, t, l, s in rows], DOCS)


def test_chat_round_trip_and_windows(spark):
    long = "word " * 900
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi | \\ <|end|>\n"), (1, 2, "assistant", "a\\|b"), (1, 3, "user", long),
            (1, 4, "assistant", "done"), (1, 4, "assistant", "done"), (2, None, None, None), (None, 0, "assistant", "<|x|>\n")]
    rows += [(3, i, "user" if i % 2 == 0 else "assistant", f"text {i} " * 20) for i in range(40)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, window int")
    windows = chat.format_windows(df)
    back = {r.conv_id: r for r in chat.read_back(windows).collect()}
    by = {}
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    assert set(back) == set(by)
    for conv, turns in by.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert back[conv].n_turns == len(turns)
        assert back[conv].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (back[conv].loss_chars, back[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    sizes = windows.where("conv_id = 3").collect()
    assert len(sizes) > 1 and all(w.n_tokens <= chat.BUDGET for w in sizes) and any(w.n_repeated for w in sizes)
    assert all(w.formatted.startswith("<|system|>\nbe kind<|end|>") for w in windows.where("conv_id = 1").collect())
    assert chat.read_back(chat.format_windows(df.limit(0))).count() == 0


def test_system_turn_is_retained_from_where_it_stands(spark):
    talk = [("user" if i % 2 == 0 else "assistant", f"text {i} " * 20) for i in range(60)]
    rows = [(1, i, r, t) for i, (r, t) in enumerate([talk[0], ("system", "be kind"), *talk[1:]])]
    rows += [(2, i, r, t) for i, (r, t) in enumerate([("system", "rule " * 2000), *talk])]
    rows += [(3, i, r, t) for i, (r, t) in enumerate([*talk, ("system", "late"), *talk, ("system", "other")])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.format_windows(df)
    got = {c: [w.formatted for w in windows.where(f"conv_id = {c}").orderBy("window").collect()] for c in (1, 2, 3)}
    kind = "<|system|>\nbe kind<|end|>"
    assert len(got[1]) > 3 and all(w.startswith(kind) for w in got[1][1:]) and all(w.count(kind) == 1 for w in got[1])
    assert sum("<|system|>" in w for w in got[2]) == 1 and sum(map(len, got[2])) < 2 * sum(len(t) for c, _, _, t in rows if c == 2)
    late = next(i for i, w in enumerate(got[3]) if "<|system|>\nlate" in w)
    assert late > 0 and all(w.startswith("<|system|>\nlate") for w in got[3][late + 1:])
    assert {r.conv_id: r.n_turns for r in chat.read_back(windows).collect()} == {1: 61, 2: 61, 3: 122}
    assert all(w.n_tokens <= chat.BUDGET for w in windows.where("conv_id != 2").collect())


@pytest.mark.parametrize("inner, want", [
    ("<p title=it's>First</p><p>Second</p><p>don't stop</p>", "First|Second|don't stop"),
    ("<p class='share-price'>a</p><h2 class='related-work'>b</h2><p class=alert-free>c</p><section class='social-policy'>d</section>", "a|b|c|d"),
    ("<p>a</p><div class='share-buttons'>x</div><div class='related_posts box'>x</div><p class=shareTools>x</p><span class=ad>x</span>", "a"),
    ("<p title=\"a>b\" x='c>d' y=\"un>z</p><p>k</p>", "z|k"),
])
def test_html_keeps_article_text(inner, want):
    assert html_wrapper.extract_text(f"<body><article>{inner}</article></body>", None) == want.replace("|", "\n\n")


PAGE = """<html><head><title>t</title><script>var a="</p>";</script></head><body><header class="site-header"><h1>Site</h1></header>
<div id="cookie-notice">We use cookies</div><ul class="menu"><li><a href=x>Home</a></ul><article><header><h1>Title &amp; more</h1>by me</header>
<p>First &lt;b&gt;&nbsp; para<br>line <span class="ad">BUY</span>two<aside>side</aside><p>%s<form><label>mail</label></form>
<div class="comments"><p>nice post</p></div></article><div class="sidebar">s</div><footer>f</footer></body></html>"""


def test_html_wrapper(spark):
    rows = [(i, f"http://h.example.com/{i}", PAGE % f"Second {i}") for i in range(8)]
    rows += [(8, None, None), (9, "http://x/1", ""), (10, "http://x/2", "plain &eacute; <p>a<p>b"), (8, None, None)]
    got = html_wrapper.extract_pages(spark.createDataFrame([(*r, "mine") for r in rows], "page_id long, url string, html string, text string"))
    text = {r.page_id: r.text for r in got.collect()}
    assert got.count() == len(rows)
    assert text[3] == "Title & more\n\nFirst <b> para line two\n\nSecond 3"
    assert text[8] == "" and text[9] == "" and text[10] == "plain é\n\na\n\nb"
    assert all(r.n_chars == len(r.text) for r in got.collect())


@pytest.mark.parametrize("name", ["layout has-sidebar", "no-sidebar", "with-menu", "widget-area", "form-page"])
def test_html_region_words_around_the_article(name):
    inner = '<article><h1>T</h1><p>Some text</p></article><div class="related-posts"><article><p>Other</p></article></div>'
    page = f'<body><div class="menu">Home</div><div class="{name}"><div class="sidebar-left">{inner}</div><div class="sidebar">side</div></div></body>'
    plan = html_wrapper.plan_of(html_wrapper.wrap(html_wrapper.parse(page)))
    assert html_wrapper.extract_text(page, plan) == html_wrapper.extract_text(page, None) == "T\n\nSome text"
    within = f'<body><main><p>By me</p><div class="{name}">{inner}</div></main></body>'
    assert html_wrapper.extract_text(within, None) == "T\n\nSome text"
    # a page that has the host's element, but no article of its own
    host = {"root": f"#/body/div.{'.'.join(re.findall('[a-z]+', name))}/div.content", "constant": []}
    assert html_wrapper.extract_text(f'<body><div class="{name}"><div class="content">Text</div></div></body>', host) == "Text"


def host_texts(pages):
    """Texts under the plan of the pages' host, merged in two orders."""
    out = []
    for order in (pages, pages[::-1]):
        wrapper = None
        for page in order:
            one = html_wrapper.wrap(html_wrapper.parse(page))
            wrapper = one if wrapper is None else html_wrapper._merge(wrapper, one)
        plan = html_wrapper.plan_of(wrapper)
        out.append([html_wrapper.extract_text(p, plan) for p in pages])
    assert out[0] == out[1]
    return out[0]


def test_html_constant_texts():
    copy = "<body><main><h1>T</h1><p>Text</p></main></body>"
    assert host_texts([copy] * 6) == ["T\n\nText"] * 6
    series = [f"<body><div class=content><h1>Series</h1><p>Part {i}</p></div></body>" for i in range(7)]
    assert host_texts(series) == [f"Series\n\nPart {i}" for i in range(7)]
    bare = [f"<body><div>Top</div><p>Part {i}</p></body>" for i in range(7)]
    assert host_texts(bare) == [f"Part {i}" for i in range(7)]          # a whole page: the constant is template
    assert host_texts(bare[:1] * 6) == ["Top\n\nPart 0"] * 6            # copies tell nothing
    mixed = ["<body><section>One</section><p>a</p></body>"] * 6 + bare[:2]
    assert host_texts(mixed)[:6] == ["One\n\na"] * 6


def test_wrapper_alignment():
    a = html_wrapper.wrap(html_wrapper.parse("<div><h1>a</h1><p>x</p><p>y</p></div>"))
    b = html_wrapper.wrap(html_wrapper.parse("<div><h1>a</h1><ul><li>1<li>2</ul><p>z</p></div>"))
    assert html_wrapper.expression(html_wrapper._merge(a, b)) == "<#><div><h1>#text (<ul>(<li>#slot)+)? (<p>#slot)+"


def test_mixing(spark):
    rows = [(i, "w " * (i % 50), None, f"s{i % 4}" if i % 9 else None) for i in range(300)] + [(None, None, None, "s1"), (7, "x y", None, "s0"), (7, "x y", None, "s0")]
    df = docs_frame(spark, rows)
    one = mixing.mix_report(df, block=16, shard=8).toPandas()
    two = mixing.mix_report(df.repartition(5), block=16, shard=8).toPandas()
    key = ["doc_id", "size", "source_size", "target", "taken"]
    assert sorted(map(tuple, one[key].fillna(-1).values.tolist())) == sorted(map(tuple, two[key].fillna(-1).values.tolist()))
    assert len(one) == len(rows) and (one.taken <= 2 * one["size"]).all()
    assert sorted(one["size"]) == sorted(len(re.findall(WORD, t or "")) for _, t, _, _ in rows)
    per = one.groupby(["target", "source_size"]).taken.sum().reset_index()
    assert (abs(per.taken - per.target) <= 1).all() and abs(per.target.sum() - 1.5 * per.source_size.sum()) < 1e-6 and len(per) == 5
    mixed = mixing.mix_documents(df, block=16, shard=8).toPandas()
    assert list(mixed.columns) == df.columns and (mixed.score == "mine").all()
    assert sum(len(re.findall(WORD, t)) for t in mixed.text) == one.taken.sum()
    assert mixing.mix_report(df.limit(0)).count() == 0


def test_rows_under_one_id_and_text(spark):
    """Rows that share id and text but differ in a further column keep their own columns, whatever the partitioning."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(7, text, None, "s0", 1, note) for note in ("five", "six", "six", None)] + [(8, text, "x", None, 1, "y"), (8, text, None, "x", 1, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, note string")
    mixed = [mixing.mix_documents(d, block=8, shard=4).toPandas() for d in (df, df.repartition(4))]
    assert {"five", "six"} <= set(mixed[0].note.dropna()) and mixed[0].note.isna().any()
    words = lambda m: sorted((r.doc_id, str(r.lang), str(r.source), str(r.note), len(r.text.split())) for r in m.itertuples())
    assert sum(w[-1] for w in words(mixed[0])) == mixing.mix_report(df, block=8, shard=4).agg(F.sum("taken")).first()[0]
    assert words(mixed[0]) == words(mixed[1])
    kept = [simhash.deduplicate(d).collect() for d in (df, df.repartition(4))]
    assert len(kept[0]) == 1 and kept[0] == kept[1]


def fingerprint(text):
    words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash(spark):
    rng = np.random.default_rng(1)
    base = [" ".join(rng.choice(["Alpha", "beta", "ÉA", "d", "e\x0bf"], 400)) for _ in range(12)]
    texts = [None, "", " ", "A", "a b"] + [t for b in base for t in (b, b, b + " zz", "yy " + b)]
    got = simhash.simhash_components(docs_frame(spark, [(i, t, None, None) for i, t in enumerate(texts)])).toPandas().sort_values("doc_id")
    fps = [fingerprint(t) for t in texts]
    assert got.fingerprint.tolist() == [f"{f:016x}" for f in fps]
    comp = list(range(len(fps)))
    for _ in fps:
        comp = [min(comp[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 3) for i in range(len(fps))]
    assert got.component_id.tolist() == comp
    few = spark.createDataFrame([(k, f"v{k}") for k in range(4)], "k int, v string")
    many = spark.createDataFrame([(i, i % 3 if i % 2 else 0) for i in range(300)] + [(None, 0), (7, 0), (7, 0)], "i int, k int")
    for hot in (few.where("k = 0"), few.where("k > 9"), few):
        dealt = simhash._spread_join(many, few, "k", hot, "i").select("i", "k", "v").collect()
        assert sorted(map(str, dealt)) == sorted(map(str, many.join(few, "k").select("i", "k", "v").collect())) and len(dealt) == 303
    near = [simhash._signed(int(x)) for x in {fps[5] ^ sum(1 << int(b) for b in rng.choice(64, 3)) for _ in range(60)}]
    frame = spark.createDataFrame([(f,) for f in near], "fp long")
    whole = {frozenset(r) for r in simhash.fingerprint_links(frame).collect()}
    cut = simhash.fingerprint_links(frame, chunk=7).collect()

    def parts(links):
        node = {f: f for f in near}
        for _ in near:
            for x, y in map(tuple, links):
                node[x] = node[y] = min(node[x], node[y])
        return node
    assert parts([tuple(w) for w in whole if len(w) == 2]) == parts([(r.a, r.b) for r in cut])


def test_url_rules(spark):
    urls = ["http://a.NET/x", "http://e.example.net/en/1", "https://example.com/de/2?x", "http://b.org/fr/", "http://b.org/fr", "http://net", None,
            "no scheme", "x://m.example.com:80/de/", "http://a.net/en/"] + [f"http://q.com/p/{i}" for i in range(30)]
    got = {r.page_id: r for r in url_templates.judge(spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")).collect()}
    assert [got[i].rule for i in range(10)] == ["net/", "example.net/en/", "example.com/de/", "org/fr/", None, None, None, None, None, "net/"]
    assert [got[i].verdict for i in (0, 1, 2, 3)] == ["block", "allow", "block", "allow"]
    assert (got[6].host, got[6].path, got[5].path, got[8].host) == ("", "", "", "m.example.com:80")
    assert {got[i].verdict for i in range(10, 40)} == {"allow"} and len(got) == len(urls)


def shaped(segment):
    stem, ext = re.fullmatch(r"(?s)(.*?)(\.[A-Za-z]{1,5})?", segment).groups()
    for kind, pattern in (("{num}", r"[0-9]+"), ("{hex}", r"(?=.*[0-9])[0-9a-fA-F-]{8,}")):
        if re.fullmatch(pattern, stem):
            return kind + (ext or "").lower()
    return "{mixed}" + (ext or "").lower() if re.search("[0-9]", stem) else segment


def brute_templates(rows):
    """Template and purity of every (host, path, label), node by node."""
    paths = []
    for _, path, _ in rows:
        parts = re.sub("^/|/$", "", path).split("/")
        paths.append([shaped(p) for p in (parts if len(parts) <= 8 else parts[:7] + ["/".join(parts[7:])])])
    out = [[] for _ in rows]

    def visit(members, level):
        children = {}
        for m in members:
            if len(paths[m]) > level:
                children.setdefault(paths[m][level], []).append(m)
        words = {c: ms for c, ms in children.items() if not c.startswith("{")}
        variable = len(words) >= 20 and len(words) >= 0.5 * sum(map(len, words.values()))
        profiles = {}
        for c, ms in children.items():
            share = {}
            for m in ms:
                below = paths[m][level + 1] if len(paths[m]) > level + 1 else None
                kind = "end" if below is None else below[:below.index("}") + 1] if below.startswith("{") else "word"
                share[kind, rows[m][2]] = share.get((kind, rows[m][2]), 0) + 1
            steps = {k: int(4 * n / len(ms) + 0.5) for k, n in share.items()}
            profiles[c] = frozenset((k, v) for k, v in steps.items() if v)
        pooled = {}
        for c, ms in children.items():
            alike = [d for d in children if profiles[d] == profiles[c]]
            pooled.setdefault("*" if variable and c in words else "~" + min(alike) if len(alike) > 1 else c, []).extend(ms)
        for general, ms in pooled.items():
            for m in ms:
                out[m].append(general)
            visit(ms, level + 1)

    for host in {r[0] for r in rows}:
        visit([i for i, r in enumerate(rows) if r[0] == host], 0)
    keys = [(rows[i][0], "/".join(t)) for i, t in enumerate(out)]
    found = []
    for host, template in keys:
        labels = [r[2] for k, r in zip(keys, rows, strict=True) if k == (host, template)]
        all_labels = [r[2] for r in rows if r[0] == host]
        prior = all_labels.count("block") / (len(all_labels) + 10)
        found.append((template, (labels.count("block") + 10 * prior) / (labels.count("block") + labels.count("allow") + 10)))
    return found


def test_url_tree(spark):
    """Tree, purity and verdict against brute force, with labels of a part of the urls."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 7))
    rows = []
    for i in range(900):
        label = [None, "block", "allow"][int(rng.integers(3))]
        spam = "block" if rng.random() < 0.9 else None
        kind = i % 9
        path = (f"/user/{word()}/posts/{word()}", f"/spam/{rng.integers(99)}", f"/{rng.choice(['en', 'de'])}/news/{rng.integers(9)}.HTML",
                f"/{rng.choice(['about', 'contact', 'help'])}", f"/a/b/{word()}/c/{rng.integers(4)}", "/" + "/".join(["x"] * int(rng.integers(6, 13))),
                f"/id/{rng.integers(1 << 40):010x}", "", f"/{word()}")[kind]
        rows.append((rng.choice(["h.com", "k.com"]) if kind != 8 else "w.com", path, spam if kind == 1 else label if kind == 2 else "allow" if kind == 5 or kind == 4 and i % 2 else None))
    df = spark.createDataFrame([(i, f"http://{h}{p}?q", l, "mine") for i, (h, p, l) in enumerate(rows)], "page_id long, url string, known string, segs string")
    got = {r.page_id: r for r in url_templates.judge(df, label=F.col("known")).collect()}
    assert len(got) == len(rows)
    for i, (template, purity) in enumerate(brute_templates(rows)):
        assert (got[i].template, round(got[i].purity, 12)) == (template, round(purity, 12)), rows[i]
        assert got[i].verdict == ("block" if purity >= 0.8 else "allow")
    spam = [got[i].verdict for i, r in enumerate(rows) if r[1].startswith("/spam/")]
    others = [got[i].verdict for i, r in enumerate(rows) if not r[1].startswith("/spam/")]
    assert set(spam) == {"block"} and set(others) == {"allow"}          # also the spam urls without a label
    assert {r.template for r in got.values() if r.path.startswith("/user/")} == {"user/*/posts/*"}
    assert {r.template for r in got.values() if r.host == "w.com"} == {"*"}
    assert url_templates.judge(df.limit(0)).count() == 0


def vectors(spark, n=400):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 16))
    x[50:80] = x[50] + rng.normal(scale=0.02, size=(30, 16))
    x[100:130] = x[100]
    rows = [(i, v.tolist(), i) for i, v in enumerate(x)] + [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [float("nan")] * 16, 0), (n + 3, [None, 1.0], 0), (n + 4, [], 0), (n + 5, [1.0, 2.0], 0), (0, x[0].tolist(), 0)]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")


def test_permutation_index(spark):
    x, df = vectors(spark)
    got = perm_index.nearest(df, F.col("vec_id") % 50 == 0).toPandas()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    for q, part in got.sort_values("rank").groupby("query_id"):
        s = u @ u[q]
        s[q] = -9
        want = np.lexsort((np.arange(len(x)), -np.round(s, 12)))[:5]
        assert part.vec_id.tolist() == want.tolist() and np.allclose(part.score, s[want])
    assert sorted(got.query_id.unique()) == list(range(0, 400, 50))
    assert perm_index.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_nn_descent(spark):
    x, df = vectors(spark)
    got = nn_descent.near_duplicates(df).toPandas().set_index("vec_id").sort_index()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    linked = u @ u.T >= 0.95
    assert got.n_links.tolist()[:400] == (linked.sum(1) - 1).tolist()
    assert got.component_id.tolist()[:400] == [int(np.flatnonzero(r)[0]) for r in linked]
    assert got.loc[400:].n_links.sum() == 0 and got.loc[400:].kept.all() and len(got) == 406
    assert nn_descent.near_duplicates(df.limit(0)).count() == 0


def two_linked_groups(n=40, dim=64, others=1500):
    """Two groups, cosine about 0.99 inside and 0.955 across, and unrelated vectors."""
    rng = np.random.default_rng(5)
    u = np.eye(dim)[:2]
    heads = np.stack([u[0], 0.965 * u[0] + np.sqrt(1 - 0.965 ** 2) * u[1]])
    noise = rng.normal(size=(2 * n, dim))
    noise[:, :2] = 0
    near = np.repeat(heads, n, axis=0) + 0.1 * noise / np.linalg.norm(noise, axis=1)[:, None]
    return np.concatenate([near, rng.normal(size=(others, dim))])


def test_nn_descent_links_between_saturated_groups(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "audit", lambda nodes, *_: (1.0, nodes.selectExpr("node AS src", "node AS nbr")))   # no help from the audit
    x = two_linked_groups()
    got = nn_descent.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    links = (u @ u.T >= 0.95).sum(1) - 1
    assert (links[:80] == 79).all() and not links[80:].any()
    got = got.toPandas().sort_values("vec_id")
    assert got.n_links.tolist() == links.tolist() and got.component_id.tolist() == [0] * 80 + list(range(80, len(x)))


def test_nn_descent_recall_audit(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1200, 32))
    x[1000:1100] = x[1000] + rng.normal(scale=0.01, size=(100, 32))
    x[1100:1110] = x[:10] + rng.normal(scale=0.01, size=(10, 32))     # ten pairs among many without links
    u = x / np.linalg.norm(x, axis=1)[:, None]
    linked = u @ u.T >= 0.95
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    real = nn_descent.start_graph                  # a start that finds nothing: only the audit sees the links
    far = lambda *a: real(*a).where("sim < 0.5")
    monkeypatch.setattr(nn_descent, "start_graph", far)
    monkeypatch.setattr(nn_descent, "refine", lambda graph, *a: graph.withColumn("fresh", F.lit(False)))
    got = nn_descent.near_duplicates(df).toPandas().sort_values("vec_id")
    assert got.n_links.tolist() == (linked.sum(1) - 1).tolist()
    assert got.component_id.tolist() == [int(np.flatnonzero(r)[0]) for r in linked]
    monkeypatch.setattr(nn_descent, "verified", lambda edges, *a: edges.selectExpr("src AS a", "nbr AS b").limit(0))
    monkeypatch.setattr(nn_descent, "TRIES", 0, raising=False)
    with pytest.raises(RuntimeError):
        nn_descent.near_duplicates(df)


def segmentations(v, unit):
    lattice = v.edges(unit)

    def walk(i):
        if i == len(unit):
            yield 0.0, ()
        else:
            for j, score, ids in lattice[i]:
                for rest, more in walk(j):
                    yield score + rest, ids + more
    return list(walk(0))


def test_sentencepiece(spark):
    v = sp.Vocabulary.load()
    coder = sp.Encoder(v)
    for text in ["ab cd", "a.b, c!", "Thé\nx", "  x▁y", "世a <0A>"]:
        whole = sorted((s / sp.SCALE for s, _ in segmentations(v, " " + text.replace("▁", ""))), reverse=True)
        got = coder.encode(text.replace("▁", ""), 6)     # the whole lattice against the sum over units
        assert np.allclose([s for s, _ in got], whole[:len(got)]) and len({i for _, i in got}) == len(got) == min(6, len(whole))
        for _, ids in coder.encode(text, 6):
            assert v.decode(np.frombuffer(ids, "<u4")) == text
    rows = docs_frame(spark, [(1, None, None, None), (2, "", None, None), (3, "x" * 5000 + " \n\t é", None, None), (3, "hi", None, None)])
    got = sp.encode_documents(rows).collect()
    assert all(r.round_trip for r in got) and sorted(r.n_pieces for r in got)[:2] == [0, 0] and len(got) == 4


def test_language_id(spark):
    r = QUERIES["op8_langid"](spark, "/root/testdata/sf0.01").toPandas().merge(pd.read_parquet("/root/testdata/sf0.01/documents.parquet"), on="doc_id")
    assert len(r) == 1000 and (r[r.held_out].lang == r[r.held_out].lang_pred).mean() >= 0.98 and r.score.between(0, 1).all()
    rng = np.random.default_rng(0)
    for _ in range(200):
        n, s, p = int(rng.integers(1, 7)), None, float(rng.choice([0.5, 2, 5]))
        s = rng.normal(0, 3, (n, 3))
        want = max(sum(s[i, l] for i, l in enumerate(c)) - p * sum(a != b for a, b in zip(c, c[1:], strict=False)) for c in itertools.product(range(3), repeat=n))
        spans = langid.viterbi(s, p)
        path = [l for k, (a, l) in enumerate(spans) for _ in range((spans[k + 1][0] if k + 1 < len(spans) else n) - a)]
        assert abs(sum(s[i, l] for i, l in enumerate(path)) - p * (len(spans) - 1) - want) < 1e-9
    rows = [(i, "the cat and the dog " * 3, "en", "") for i in range(40)] + [(100 + i, "кот и собака " * 3, "ru", "") for i in range(40)]
    df = docs_frame(spark, rows + [(200, None, "en", None), (201, "", None, None), (202, "12 !", None, None), (203, "the dog " * 20 + "собака и " * 30, None, None)])
    got = {r.doc_id: r for r in langid.predict_documents(df).collect()}
    assert [got[i].lang_pred for i in (0, 100, 200, 201, 202, 203)] == ["en", "ru", "und", "und", "und", "ru"] and 0.5 < got[203].score < 1
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and kept.count() == 81 and {r.score for r in kept.collect()} == {"mine"}
    assert langid.predict_documents(df.limit(0)).count() == 0


def test_viterbi_two_spans_of_other_languages():
    # neither span's language is the best one for all words
    assert langid.viterbi(np.array([[4.0, -5, 0], [-5, 4, 0]]), 5.0) == [(0, 0), (1, 1)]
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(2, 6))
        s = np.column_stack([rng.normal(0, 3, (n, 2)), np.zeros(n)])
        want = max(sum(s[i, l] for i, l in enumerate(c)) - 5 * sum(a != b for a, b in zip(c, c[1:], strict=False)) for c in itertools.product(range(3), repeat=n))
        spans = langid.viterbi(s, 5.0)
        ends = [a for a, _ in spans[1:]] + [n]
        assert abs(sum(s[a:e, l].sum() for (a, l), e in zip(spans, ends, strict=True)) - 5 * (len(spans) - 1) - want) < 1e-9


def test_language_stage_without_labels(spark):
    df = docs_frame(spark, [(0, "the cat", None, "a"), (1, None, None, "a"), (2, "12 !", None, "a"), (3, "кот", None, "a"), (4, "", None, "a")])
    kept = langid.keep_identified(df)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3] and kept.columns == df.columns
    assert {r.lang_pred for r in langid.predict_documents(df).collect()} == {"und"}


def test_language_stage_fills_what_is_missing(spark):
    rows = [(i, "the cat and the dog " * 3, "en", "") for i in range(40)] + [(100 + i, "кот и собака " * 3, "ru", "") for i in range(40)]
    rows += [(200, "the dog and the cat", None, ""), (201, "собака и кот", None, ""), (202, "the dog and the cat", "ru", ""), (202, "the dog and the cat", "ru", "")]
    got = langid.keep_identified(docs_frame(spark, rows)).collect()
    assert [r.lang for r in got if r.doc_id in (200, 201)] == ["en", "ru"] and [r.lang for r in got if r.doc_id == 202] == ["ru"] * 2
    assert len(got) == len(rows)


def test_broadcasts_hold_plain_data():
    # what a worker unpickles must not name this package, which it need not have
    import pickle

    from tickwise.llm.common import revived

    vocabulary = sp.Vocabulary.load()
    model = langid.Model(["a", "b"], np.ones((2, 1 << langid.BITS)), np.ones((2, len(langid.SCRIPT_NAMES))))
    for kind, made in ((sp.Vocabulary, vocabulary), (langid.Model, model)):
        data = pickle.dumps(vars(made), 2)
        assert b"tickwise" not in data
        assert vars(revived(kind, pickle.loads(data))).keys() == vars(made).keys()
    again = sp.Encoder(revived(sp.Vocabulary, pickle.loads(pickle.dumps(vars(vocabulary)))))
    text = "Hello there, 12 worlds! é"
    assert again.encode(text, 3) == sp.Encoder(vocabulary).encode(text, 3)


def test_warc_round_trip(spark):
    rows = [(3, "http://a", "x"), (1, "http://b\r\nX-Page-Id: 9", "x"), (2, None, None), (5, "http://c", ""), (4, "http://d", "é\r\n\r\ny"), (None, "http://e", "x")]
    pages = spark.createDataFrame([(*r, "mine") for r in rows], "page_id long, url string, html string, payload string")
    path = scratch_path(spark, "warc-test")
    warc.write_archive(pages, path)
    assert spark.read.parquet(f"{path}/payloads").count() == 3
    back = warc.read_archive(spark, path)
    got = {r.page_id: r for r in warc.describe(back).collect()}
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {
        1: ("response", None), 3: ("revisit", 1), None: ("revisit", 1), 2: ("response", None), 5: ("revisit", 2), 4: ("response", None)}
    assert {r.page_id: bytes(r.payload) for r in back.collect()} == {i: (html or "").encode() for i, _, html in rows}
    assert {(r.page_id, r.header) for r in back.collect()} == {(r.page_id, r.header) for r in spark.read.parquet(f"{path}/headers").collect()}
    warc.write_archive(pages.limit(0), path + "-none")
    assert warc.describe(warc.read_archive(spark, path + "-none")).count() == 0


def parse_warc(data):
    """(fields, block) of every record, by the format's own lengths."""
    while data:
        head, data = data.split(b"\r\n\r\n", 1)
        first, *lines = head.decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines)
        n = int(fields["Content-Length"])
        assert first == "WARC/1.1" and data[n:n + 4] == b"\r\n\r\n"
        yield fields, data[:n]
        data = data[n + 4:]


def test_warc_files_and_hot_payload(spark, monkeypatch):
    """A payload that most rows share, repeated rows and repeated ids, written as files and parsed again."""
    monkeypatch.setattr(warc, "SLOT_ROWS", 4)
    rows = [(i, f"http://a/{i}", "same é" * 50) for i in range(60, 30, -1)] + [(7, "http://b", "x"), (7, "http://b", "x"), (7, "http://c", "y"), (8, "http://d", "x")]
    rows += [(None, None, "z"), (None, None, "z"), (9, "http://e", "a\r\n\r\nWARC/1.1"), (10, "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5, "url")
    path = scratch_path(spark, "warc-files")
    warc.write_archive(pages, path)
    assert spark.read.parquet(f"{path}/payloads").count() == len({h for _, _, h in rows})
    assert spark.read.parquet(f"{path}/headers").select("address", "slot").distinct().count() > len({h for _, _, h in rows})
    records = warc.read_archive(spark, path)
    warc.export_warc(records, path + "-files")
    raw = b"".join(bytes(r.content) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path + "-files").collect())
    parsed = list(parse_warc(raw))
    assert len(parsed) == len(rows) and len({f["WARC-Record-ID"] for f, _ in parsed}) == len(rows)
    by_record = {f["WARC-Record-ID"]: (f, block) for f, block in parsed}
    got = []
    for fields, block in parsed:
        full = by_record[fields["WARC-Refers-To"]] if fields["WARC-Type"] == "revisit" else (fields, block)
        assert full[0]["WARC-Type"] == "response" and full[0]["WARC-Payload-Digest"] == fields["WARC-Payload-Digest"]
        page = fields.get("X-Page-Id")
        got.append((page and int(page), fields["WARC-Target-URI"], full[1].split(b"\r\n\r\n", 1)[1].decode(), fields["WARC-Type"]))
    least = {}
    for i, _, h in rows:
        least[h] = min(least.get(h, 1 << 60), 1 << 59 if i is None else i)
    want = [(i, u or "", h, "response" if (1 << 59 if i is None else i) == least[h] else "revisit") for i, u, h in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_warc_finds_damage(spark):
    pages = spark.createDataFrame([(1, "u", "x"), (2, "u", "y")], "page_id long, url string, html string")
    path = scratch_path(spark, "warc-damage")
    warc.write_archive(pages, path)
    stored = spark.read.parquet(f"{path}/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(path + "-2/headers")
    stored.withColumn("payload", F.encode(F.lit("other"), "UTF-8")).write.parquet(path + "-2/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(path + "-3/headers")
    stored.limit(1).write.parquet(path + "-3/payloads")
    with pytest.raises(Exception, match="does not match its digest"):
        warc.describe(warc.read_archive(spark, path + "-2")).collect()
    with pytest.raises(Exception, match="no payload stored"):
        warc.describe(warc.read_archive(spark, path + "-3")).collect()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    copies = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 100_000)).unionByName(docs.limit(0)).unionByName(docs.where("doc_id < 5"))
    kept = stages["simhash_dedup"](spark, copies, SF)
    groups = simhash.simhash_components(docs).select("component_id").distinct()
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.component_id for r in groups.collect()) and kept.columns == docs.columns
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert out.round_trip.all() and set(out.doc_id) <= {r.doc_id for r in kept.collect()}


@pytest.mark.parametrize("name", ["op1_chat_windows", "op5_url_templates"])
def test_native_queries_have_no_python(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_best_follows_the_trie_and_agrees_with_the_search():
    """The best segmentation of a unit looks up signs, no substrings."""
    vocabulary = sp.Vocabulary.load()
    units = [" the", " Heitlich.", "xthq", " ñandú", " 台積電", "😀", " a😀b", "\n", " ", " é́q", " " + "thing" * 12]
    want = []
    for unit in units:
        ways = vocabulary.n_best(unit, 2)
        want.append((ways[0][0], ways[0][0] - ways[1][0] if len(ways) > 1 else None))
    vocabulary.known = None
    for unit, (score, loss) in zip(units, want, strict=True):
        ids, found, lost = vocabulary.best(unit)
        assert found == score and (lost == loss if loss is not None else lost > -sp.NONE // 2)
        assert b"".join(vocabulary.text[i] for i in memoryview(ids).cast("I")).decode() == unit

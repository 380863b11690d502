"""Unit rows for the text rules, checked against Python's own ``re``/``str`` semantics."""

import re

import pytest
from pyspark.sql import functions as F

from tickwise.functions import dates as DT
from tickwise.functions import urls as UR
from tickwise.functions.text import py_lines, py_strip
from tickwise.operators import articles as AR
from tickwise.operators import dedup as DD
from tickwise.operators import scoring as NS

SAMPLES = [
    None, "", "   ", "　 全形空白 　", "a\x1cb\x1dc", "line1\r\nline2\rline3\n",
    "廣告 廣告\n正文第一段，晶片廠營收創新高。\n\n\n\n分享\n首頁\n/\n12\n12345\n#晶片廠\n結尾",
    "登入會員看更多\n說明\n解鎖全文\n內文",
    "展開全文\n很多字\n免費試用 7 日\n之後",
    "Loading...\nLOADING...\n（2/23 09:29 更新）\n剩 3 篇\n剩篇\n不用抽 不用搶 下載\n正文",
    "中央社 一手新聞 app\n中央社某某一手新聞某某APP\n正文",
    "前文\n延伸閱讀\n相關 A\n相關 B",
    "  Title - 某新聞網 ", "A-B news", "晶片廠 (1234) 法說會：Q4 營收 -5% 年增_率",
    "x́y", "no hyphen here",
    "廣告\n\n正文", "a\n廣告", "廣告", "\n廣告\n", "廣告\r\n\r\n分享\r\n正文\r\n", "12\n\n\n\n\n34\n",
    "免費試用 7 日\n\n下一行", "  /  \n\x0c首頁\x1c正文\u2028廣告\x85尾",
]


def py_clean(text):
    # the reference's clean_text, restated with Python re for the test
    if not text:
        return text
    for p in AR.NOISE_BLOCKS:
        text = re.sub(p, "", text, flags=re.S)
    pat = re.compile("^(" + "|".join(AR.NOISE_LINES) + ")$", re.I)
    lines = [ln for ln in text.splitlines() if not (ln.strip() and pat.match(ln.strip()))]
    text = "\n".join(lines)
    text = re.sub(r"\n{3,}", "\n\n", text)
    return text.strip()


def py_norm(title):
    if not isinstance(title, str):
        return ""
    title = re.sub(r"\s*-\s*\S+.*$", "", title)
    return re.sub(r"[\s\W]", "", title, flags=re.UNICODE).strip()


def _frame(spark):
    return spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i INT, s STRING")


def test_clean_text_matches_python(spark):
    got = {r.i: r.c for r in _frame(spark).select("i", AR.clean_text(F.col("s")).alias("c")).collect()}
    for i, s in enumerate(SAMPLES):
        assert got[i] == py_clean(s), (i, s, got[i], py_clean(s))


def test_strip_and_lines(spark):
    rows = _frame(spark).select("i", py_strip(F.col("s")).alias("st"), py_lines(F.col("s")).alias("ln")).collect()
    for r in rows:
        s = SAMPLES[r.i]
        if s is None:
            continue
        assert r.st == s.strip()
        assert list(r.ln) == s.splitlines()


def test_normalize_title_matches_python(spark):
    got = {r.i: r.n for r in _frame(spark).select("i", DD.normalize_title(F.col("s")).alias("n")).collect()}
    for i, s in enumerate(SAMPLES):
        if s == "x́y":  # combining mark: Python's \W removes it as well ([^\p{L}\p{N}_])
            assert got[i] == "xy"
            continue
        assert got[i] == py_norm(s), (i, s)


@pytest.mark.parametrize("resp,expected", [
    ('{"sentiment_score": 0.5, "impact_intensity": "0.7", "certainty": 1, "time_horizon": 0.8, "summary": "s"}',
     (0.5, 0.7, 1.0, 0.8, "s")),
    ('```json\n{"sentiment_score": -0.2}\n```', (-0.2, None, None, None, None)),
    ("  ```json{\"certainty\": \"abc\"}```  ", (None, None, None, None, None)),
    ('{"sentiment_score": 0.1', (None, None, None, None, None)),
    ("[{\"sentiment_score\": 0.1}]", (None, None, None, None, None)),
    ("{}", (None, None, None, None, None)),
    ("not json", (None, None, None, None, None)),
])
def test_parse_scores_cases(spark, resp, expected):
    df = spark.createDataFrame([(resp,)], "response STRING")
    r = NS.parse_scores(df).select("scores.*").first()
    assert (r.sentiment_score, r.impact_intensity, r.certainty, r.time_horizon, r.summary) == expected


def test_strip_fence(spark):
    cases = {"```json\n{}\n```": "{}", "  {} ": "{}", "```json``````": "```", "\n\t```json{\"a\":1}```　": '{"a":1}'}
    df = spark.createDataFrame([(k,) for k in cases], "r STRING")
    got = {r.r: r.c for r in df.select("r", NS.strip_fence(F.col("r")).alias("c")).collect()}
    assert got == cases


REF = "2024-03-10 09:30:00"


@pytest.mark.parametrize("text,expected", [
    ("5 分鐘前", "2024-03-10 09:25"), ("3小時前", "2024-03-10 06:30"), ("昨天 10:00", "2024-03-09"),
    ("昨日", "2024-03-09"), ("2 天前", "2024-03-08"), ("2023年1月5日", "2023-01-05"),
    ("2023/1/5 12:00", "2023-01-05"), ("2023-12-31", "2023-12-31"), ("1月5日", "2024-01-05"),
    ("3/7", "2024-03-07"), ("hello", None), (None, None),
])
def test_parse_relative_date(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t STRING")
    ref = F.lit(REF).cast("timestamp_ntz")
    assert df.select(DT.parse_relative_date(F.col("t"), ref).alias("d")).first().d == expected


@pytest.mark.parametrize("html,url,expected", [
    ('<meta property="article:published_time" content="2024-02-23T09:15:00+08:00">', "http://x/a", "2024-02-23 09:15"),
    ('<meta name="pubdate" content="2024-02-23">', "http://x/a", "2024-02-23"),
    ('<meta property="datePublished" content="Feb 23"><meta name="pubdate" content="2024-02-24 10:00">',
     "http://x/a", "2024-02-24"),
    ('<time datetime="bad"></time><time datetime="2024-01-02T03:04:05">t</time>', "http://x/a", "2024-01-02 03:04"),
    ("<p>x</p>", "https://www.example.tw/news/afe/202602230019.aspx", "2026-02-23"),
    ("<p>x</p>", "https://e.com/story/202402231234", "2024-02-23"),
    ("<p>x</p>", "https://e.com/story/202402311234", None),
    ("<p>x</p>", "https://e.com/2024/2/3/story", "2024-02-03"),
    ("<p>發布於 2024年2月3日</p>", "https://e.com/a", "2024-02-03"),
    ("<p>2024/02/03 21:38</p>", "https://e.com/a", "2024-02-03 21:38"),
    ("<script>var d='2024年2月3日'</script><p>none</p>", "https://e.com/a", None),
])
def test_publish_date_rules(spark, html, url, expected):
    df = spark.createDataFrame([(html, url)], "html STRING, url STRING")
    assert df.select(AR.publish_date(F.col("html"), F.col("url")).alias("d")).first().d == expected


def test_page_title_and_body(spark):
    html = ('<html><head><title>T &amp; t</title><script>var a="</p>";</script></head><body><nav>menu</nav>'
            '<article><h1> Head <b>line</b> </h1><p>First &quot;para&quot;<br><p>Second<script>x()</script>'
            '<footer>foot</footer></article></body></html>')
    r = spark.createDataFrame([(html,)], "html STRING").select(
        AR.page_title(F.col("html")).alias("t"), AR.page_body(F.col("html")).alias("b")).first()
    assert r.t == "Headline"
    assert r.b == 'Head\nline\nFirst "para"\nSecond'


def test_url_rules(spark):
    df = spark.createDataFrame([("https://www.x.tw/NEWS/afe/202402230001.aspx", "Title 2024/02/23 09:10"),
                                ("https://www.x.tw/news/afe/199902230001.aspx", "nav")], "u STRING, t STRING")
    rows = df.select(UR.url_date(F.col("u")).alias("d"), UR.url_date(F.col("u"), False).alias("cs"),
                     UR.has_date_suffix(F.col("t")).alias("s")).collect()
    assert (rows[0].d, rows[0].cs, rows[0].s) == ("2024-02-23", None, True)
    assert (rows[1].d, rows[1].cs, rows[1].s) == (None, None, False)


def test_in_range(spark):
    df = spark.createDataFrame([("2024-1-5",), ("2024-01-05 10:00",), ("2024-1-5 1",), ("",), (None,), ("x",)], "s STRING")
    got = [r.r for r in df.select(DT.in_range(F.col("s"), "2024-01-01", "2024-01-31").alias("r")).collect()]
    assert got == [True, True, False, False, False, False]


def test_labelled_block_links(spark):
    from tickwise.operators import links as LK

    lis = ("<ul><li>none <a href='/news/0'>x</a></li><li>The label <a href=\"/ad/1\">ad</a> <a href=/news/1>x</a></li>"
           "<li>label <a href='/news/1'>x</a><a href='/news/2'>y</a></li><li>label, no link</li></ul>")
    divs = "<div class='stream'>label <a href='/z'>z</a></div><div class=\"news-item\">label <a href='/news/9'>z</a></div>"
    pages = spark.createDataFrame([(1, lis), (2, lis + divs), (3, None), (4, "")], "page_id int, html string")
    news = lambda h: h.startswith("/news/")

    def got(**how):
        rows = LK.labelled_block_links(pages, "label", keep=["page_id"], **how).orderBy("page_id", "block_pos").collect()
        return [tuple(r) for r in rows]

    assert got() == [(1, 1, "/ad/1"), (1, 2, "/news/1"), (2, 0, "/z"), (2, 1, "/news/9")]      # page 2 has blocks of an earlier kind
    assert got(accept=news) == [(1, 1, "/news/1"), (1, 2, "/news/1"), (2, 1, "/news/9")]
    assert got(accept=news, unseen=True) == [(1, 1, "/news/1"), (1, 2, "/news/2"), (2, 1, "/news/9")]

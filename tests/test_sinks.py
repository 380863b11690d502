"""Sinks lose nothing: second deliveries, re-runs, replayed micro-batches; strict score parsing; link quotes."""

import os

import pytest
from pyspark.sql import functions as F

from tickwise.operators import articles as A
from tickwise.operators import links as L
from tickwise.operators import scoring as S
from tickwise.sources import files as IO
from tickwise.streaming import incremental as INC


def test_append_keeps_earlier_rows_of_a_partition(spark):
    path = IO.scratch_path(spark, "append")
    first = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "a", 3.0)], "day int, k string, v double")
    IO.append_table(first, path, ["day"], ["k"])
    IO.append_table(first, path, ["day"], ["k"])
    IO.append_table(spark.createDataFrame([(1, "c", 4.0), (1, "a", 9.0)], "day int, k string, v double"), path, ["day"], ["k"])
    rows = {(r.day, r.k): r.v for r in spark.read.parquet(path).collect()}
    assert rows == {(1, "a"): 1.0, (1, "b"): 2.0, (2, "a"): 3.0, (1, "c"): 4.0}


def test_replayed_batch_keeps_its_rows(spark):
    base = IO.scratch_path(spark, "replay")
    landing, sink, ckpt = f"{base}/in", f"{base}/out", f"{base}/ckpt"
    df = spark.range(100).select("id", (F.col("id") % 2).alias("half"))
    INC.land_files(df, landing, [F.col("half") == 0, F.col("half") == 1])
    run = lambda: INC.stream_score(spark, landing, df.schema, sink, ckpt, "id", lambda d: d)
    run()
    assert INC.read_sink(spark, sink).count() == 100
    commits = f"{ckpt.removeprefix('file:')}/commits"
    last = max(int(x) for x in os.listdir(commits) if x.isdigit())
    for x in (f"{commits}/{last}", f"{commits}/.{last}.crc"):
        if os.path.exists(x):
            os.remove(x)
    run()
    assert INC.read_sink(spark, sink).count() == 100


@pytest.mark.parametrize("text, want", [
    ('{"sentiment_score": 0.5}', 0.5), ('{"sentiment_score": 0.5} extra', None), ("{'sentiment_score': 0.5}", None),
    ('{"sentiment_score": 0.5}{"sentiment_score": 1}', None), ('{"sentiment_score": "0.7d"}', None),
    ('{"sentiment_score": "0.7"}', 0.7), ("{}", None)])
def test_strict_scores(spark, text, want):
    df = spark.createDataFrame([(text,)], "response string")
    assert S.parse_scores(df).select("scores.sentiment_score").first()[0] == want


def test_quotes_and_class_bodies(spark):
    html = ("<a href=\"x\">1</a><a href='y'>2</a><a href=z class=\"k\">3</a><div class=\"article-body\">Hello <b>w</b></div>"
            "<meta property='article:published_time' content='2024-01-02T03:04:05Z'>")
    p = spark.createDataFrame([(1, "http://a/b", html)], "page_id long, url string, html string")
    assert [r.href for r in L.extract_links(p).orderBy("pos").collect()] == ["x", "y", "z"]
    row = p.select(A.page_body(F.col("html")).alias("body"), A.publish_date(F.col("html"), F.col("url")).alias("date")).first()
    assert row.body == "Hello\nw" and row.date == "2024-01-02 03:04"


def test_attached_keys_override_also_with_null(spark):
    rows = [(1, '{"summary": null}', "row"), (2, '{"reason": "r"}', "row"), (3, "no json", "row"), (4, '{"summary": "s"} x', "row"),
            (5, '{"summary": "s"}', "row")]
    df = spark.createDataFrame(rows, "id INT, response STRING, summary STRING")
    parsed = S.parse_scores(df, keys="found")
    got = {r.id: r.summary for r in S.attach_scores(parsed, keys="found").collect()}
    assert got == {1: None, 2: "row", 3: "row", 4: "row", 5: "s"}
    assert "found" not in S.attach_scores(parsed, keys="found").columns


def test_clamp_keeps_null(spark):
    df = spark.createDataFrame([(None, 2.0, -1.0, 0.5)], ", ".join(f"{f} DOUBLE" for f in S.SCORE_FIELDS))
    assert tuple(S.validate_scores(df, "clamp").first()) == (None, 1.0, 0.0, 0.4)


def test_extracted_articles_are_cleaned_and_checked_again(spark):
    long = "word " * 20
    pages = spark.createDataFrame([
        (1, "http://e/a", f"<article><p>{long}</p><p>延伸閱讀</p><p>more</p></article>"),
        (2, "http://e/b", f"<article><p>short</p><p>延伸閱讀</p><p>{long}</p></article>"),
        (3, "http://e/c", f"<div class='story-body'><p>{long}</p><p>廣告</p></div>"),
    ], "page_id INT, url STRING, html STRING")
    # with the container rules as primary: page 2 is cleaned down to one short line
    rules = F.struct(A.page_title(F.col("html")).alias("title"), A.page_body(F.col("html")).alias("text"), F.lit(None).cast("string").alias("publish_date"))
    got = {r.page_id: r.text for r in A.extract_articles(pages, primary=rules).collect()}
    assert got == {1: long.strip(), 3: long.strip()}
    # with the densest run of blocks the long block of page 2 is the article; cleaning still applies inside a block
    more = pages.union(spark.createDataFrame([(4, "http://e/d", f"<p>short\n延伸閱讀 {long}</p>"), (5, "http://e/e", "<p>a</p>" * 99), (6, "http://e/f", None)], pages.schema))
    got = {r.page_id: (r.text, r.extracted_by) for r in A.extract_articles(more).collect()}
    assert got == {i: (long.strip(), "primary") for i in (1, 2, 3)}


def test_dense_text_leaves_menus_and_falls_back(spark):
    prose = ["This sentence is long enough to speak for an article.", "And so is this one, with <a href=x>a link</a> and some more words after it."]
    menu = "".join(f"<li><a href=/{i}>section number {i} of this site</a></li>" for i in range(30))
    page = f"<html><head><title>T</title></head><ul>{menu}</ul><div><p>{prose[0]}<p>short<p>{prose[1]}</div><footer>about us</footer><ul>{menu}</ul>"
    words = "<article>" + "".join(f"<p>word{i}</p>" for i in range(20)) + "</article>"
    df = spark.createDataFrame([(1, "http://e/a", page), (2, "http://e/b", words), (3, "http://e/c", f"<ul>{menu}</ul>")], "page_id INT, url STRING, html STRING")
    got = {r.page_id: (r.text, r.extracted_by) for r in A.extract_articles(df).collect()}
    assert got == {1: (f"{prose[0]}\nshort\n" + prose[1].replace("<a href=x>", "").replace("</a>", ""), "primary"),
                   2: ("\n".join(f"word{i}" for i in range(20)), "fallback")}


def test_tagged_sources_equal_the_union(spark):
    from tickwise.operators import links as LK

    df = spark.range(10).withColumn("rank", F.col("id") % 2)
    union = LK.union_sources([(df.filter("rank = 0"), "a", True), (df.filter("rank = 1"), "b", False)])
    tagged = LK.tag_sources(df, F.col("rank"), ["a", "b"], [True, False])
    assert sorted(map(tuple, tagged.select(*union.columns).collect())) == sorted(map(tuple, union.collect()))


def test_csv_parts_begin_with_a_byte_order_mark(spark):
    import glob

    df = spark.createDataFrame([("台積電", 1, "x"), ("b", 2, "y")], "name string, v int, part string")
    for kind, kwargs in (("plain", {}), ("parts", {"partition_by": ["name"]}), ("none", {"bom": False})):
        path = IO.scratch_path(spark, f"bom-{kind}")
        IO.write_table(df.repartition(2), path, **kwargs)
        files = glob.glob(path.removeprefix("file:") + "/**/part-*.csv", recursive=True)
        heads = [open(f, "rb").read(3) for f in files]
        assert heads and all((h == b"\xef\xbb\xbf") == (kind != "none") for h in heads)
        back = spark.read.schema("v INT, part STRING, name STRING" if kind == "parts" else df.schema).option("header", True).csv(path)
        assert sorted(tuple(r) for r in back.select("name", "v", "part").collect()) == [("b", 2, "y"), ("台積電", 1, "x")]
    path = IO.scratch_path(spark, "bom-news")
    news = spark.createDataFrame([("007", "2024-01-01 00:00", 'a "b"\nc', "s")], IO.NEWS_SCHEMA)
    IO.write_table(news, path)
    assert [tuple(r) for r in IO.read_news(spark, path).collect()] == [tuple(r) for r in news.collect()]


def test_append_reads_touched_partitions_only(spark):
    path = IO.scratch_path(spark, "touched")
    df = spark.createDataFrame([(d, k) for d in (1, 2, 3, None) for k in "ab"], "day int, k string")
    IO.append_table(df, path, ["day"], ["k"])
    old = IO.touched(spark.read.schema(df.schema).parquet(path), df.filter("day = 2"), ["day"])
    assert old.count() == 2 and {f.split("/")[-2] for f in old.inputFiles()} >= {"day=2"}
    assert "PartitionFilters: [" in old._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: []" not in old._jdf.queryExecution().executedPlan().toString()
    IO.append_table(spark.createDataFrame([(None, "a"), (None, "c"), (3, "b")], df.schema), path, ["day"], ["k"])
    got = sorted(((r.day or 0), r.k) for r in spark.read.schema(df.schema).parquet(path).collect())
    assert got == sorted([(d, k) for d in (0, 1, 2, 3) for k in "ab"] + [(0, "c")])


def test_links_until_the_first_empty_page(spark):
    from tickwise.operators import links as LK

    pages = spark.createDataFrame([(s, p) for s in "ab" for p in range(5)], "source string, page int")
    links = spark.createDataFrame([("a", p, f"l{p}") for p in (0, 1, 3)] + [("b", p, f"m{p}") for p in range(5)], "source string, page int, link string")
    keep = lambda **kw: sorted(r.link for r in LK.until_first_empty(links, pages, **kw).collect())
    assert keep() == ["l0", "l1", "m0", "m1", "m2", "m3", "m4"]
    assert keep(max_pages=2) == ["l0", "l1", "m0", "m1"] and keep(max_pages=1) == ["l0", "m0"]

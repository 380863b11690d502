"""Queries over scorer responses and scored news: N*, F*."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as FT
from ..operators import scoring as NS
from ..sources import views
from ..sources.tables import table
from .registry import register
from .sql_text import py_strip, strip_fence
from .sql_views import add_view, with_views


def R6(name):
    return F.round(F.col(name), 6).alias(name)


# --------------------------------------------------------------------------
# F: daily features
# --------------------------------------------------------------------------

def _daily(spark, sf, **kw):
    return FT.daily_features(views.scored(spark, sf), **kw)


@register("f1_news_count", with_views("SELECT day, news_count FROM v_daily", "v_daily"))
def q_f1(spark, sf):
    return _daily(spark, sf).select("day", "news_count")


@register("f2_net_impact", with_views("SELECT day, round(net_impact, 6) AS net_impact FROM v_daily", "v_daily"))
def q_f2(spark, sf):
    return _daily(spark, sf).select("day", R6("net_impact"))


@register("f3_weighted_horizon", with_views(
    "SELECT day, round(weighted_horizon, 6) AS weighted_horizon FROM v_daily", "v_daily"))
def q_f3(spark, sf):
    return _daily(spark, sf).select("day", R6("weighted_horizon"))


@register("f4_divergence", with_views("SELECT day, round(divergence, 6) AS divergence FROM v_daily", "v_daily"))
def q_f4(spark, sf):
    return _daily(spark, sf).select("day", R6("divergence"))


# scored rows with holes: every 50th sentiment missing, every 7th day-row has zero intensity
add_view("v_scored_holes", ("v_scored",), """
    SELECT id, day, CASE WHEN id % 50 = 0 THEN NULL ELSE sentiment END AS sentiment,
           CASE WHEN id % 7 = 0 THEN 0.0 ELSE intensity END AS intensity, certainty, horizon
    FROM v_scored""")


def _holes(spark, sf):
    s = views.scored(spark, sf)
    return s.withColumn("sentiment", F.when(F.col("id") % 50 == 0, F.lit(None).cast("double")).otherwise(F.col("sentiment"))) \
        .withColumn("intensity", F.when(F.col("id") % 7 == 0, F.lit(0.0)).otherwise(F.col("intensity")))


@register("f5_null_policy", with_views("""
    SELECT day,
           round(CASE WHEN count(*) FILTER (WHERE x IS NULL) > 0 THEN NULL ELSE sum(x * pow(0.5, rn - 1)) END, 6) AS net_impact,
           round(sum(x * pow(0.5, rn - 1)), 6) AS net_impact_skip,
           round(CASE WHEN count(*) = 1 THEN 0.0 ELSE stddev_samp(sentiment) END, 6) AS divergence
    FROM (SELECT *, sentiment * intensity * certainty AS x,
                 row_number() OVER (PARTITION BY day ORDER BY abs(sentiment * intensity * certainty) DESC NULLS LAST, id) AS rn
          FROM v_scored_holes) s
    GROUP BY day""", "v_scored_holes"))
def q_f5(spark, sf):
    both = FT.daily_features(_holes(spark, sf), null_policy="both")
    return both.select("day", R6("net_impact"), R6("net_impact_skip"), R6("divergence"))


@register("f6_feature_anomalies", with_views("""
    SELECT date, round(net_impact, 6) AS net_impact, round(weighted_horizon, 6) AS weighted_horizon,
           news_count, round(divergence, 6) AS divergence,
           NOT (weighted_horizon BETWEEN 0.0 AND 0.8) AS horizon_out_of_range,
           divergence > sqrt(2.0) AS divergence_too_high, abs(net_impact) >= 2.0 AS net_impact_too_large
    FROM v_feats""", "v_feats"))
def q_f6(spark, sf):
    a = FT.feature_anomalies(views.feats(spark, sf))
    return a.select("date", R6("net_impact"), R6("weighted_horizon"), "news_count", R6("divergence"),
                    "horizon_out_of_range", "divergence_too_high", "net_impact_too_large")


@register("f_daily_features", with_views("""
    SELECT day, round(net_impact, 6) AS net_impact, round(weighted_horizon, 6) AS weighted_horizon, news_count,
           round(divergence, 6) AS divergence FROM v_daily""", "v_daily"))
def q_f_all(spark, sf):
    d = _daily(spark, sf)
    return d.select("day", R6("net_impact"), R6("weighted_horizon"), "news_count", R6("divergence"))


# --------------------------------------------------------------------------
# N: scoring
# --------------------------------------------------------------------------

# news rows with missing and blank text (every 5th null, every 5th + 1 blank)
add_view("v_news_gaps", ("v_news",), """
    SELECT id, stock_id, date, title,
           CASE WHEN id % 5 = 0 THEN NULL WHEN id % 5 = 1 THEN ' ' || chr(10) || chr(12288) ELSE text END AS text, source
    FROM v_news""")


def _news_gaps(spark, sf):
    n = views.news(spark, sf)
    return n.withColumn("text", F.when(F.col("id") % 5 == 0, F.lit(None).cast("string"))
                        .when(F.col("id") % 5 == 1, F.lit(" \n　")).otherwise(F.col("text")))


_HAS_TEXT = f"{py_strip('coalesce(text, chr(0) || chr(0))'.replace('chr(0) || chr(0)', chr(39) * 2))} <> ''"


@register("n1_scoring_mode", with_views(
    f"SELECT id, CASE WHEN {_HAS_TEXT} THEN 'title+text' ELSE 'title' END AS mode FROM v_news_gaps", "v_news_gaps"))
def q_n1(spark, sf):
    return NS.scoring_mode(_news_gaps(spark, sf)).select("id", "mode")


_PROMPT_SQL = (
    "'You are an equity analyst. Assess the impact of the news below on stock ' || stock_id || '.' || chr(10) || "
    f"CASE WHEN {_HAS_TEXT} THEN 'Title: ' || coalesce(title, '') || chr(10) || 'Text: ' || text "
    "ELSE 'Title: ' || coalesce(title, '') || chr(10) || '(no text: infer from the title only)' END || chr(10) || "
    "'Answer with JSON only: sentiment_score in [-1, 1], impact_intensity in [0, 1], certainty in [0, 1], "
    "time_horizon one of 0.8 (short), 0.4 (medium), 0.1 (long), summary, evidence (' || "
    f"CASE WHEN {_HAS_TEXT} THEN 'quote one concrete fact from the text' ELSE 'inferred from the title' END || '), reason.'"
)


@register("n2_build_prompt", with_views(
    f"SELECT id, length({_PROMPT_SQL}) AS prompt_len, md5({_PROMPT_SQL}) AS prompt_md5 FROM v_news_gaps", "v_news_gaps"))
def q_n2(spark, sf):
    p = NS.build_prompt(_news_gaps(spark, sf), F.col("stock_id"))
    return p.select("id", F.length("prompt").alias("prompt_len"), F.md5("prompt").alias("prompt_md5"))


def _lexicon_sql():
    words = "regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(text, '')), '[\\p{L}\\p{N}_]+')"
    count = lambda ws: f"len(list_filter({words}, lambda w: list_contains([{', '.join(repr(w) for w in ws)}], w)))"
    return f"""
    SELECT id, title, CASE WHEN p + n = 0 THEN 0.0 ELSE round((p - n) / (p + n), 3) END AS sentiment_score,
           least(1.0, round((p + n) / 10, 3)) AS impact_intensity, CASE WHEN coalesce(text, '') <> '' THEN 1.0 ELSE 0.5 END AS certainty,
           CASE WHEN p + n > 3 THEN 0.8 ELSE 0.4 END AS time_horizon, left(coalesce(title, ''), 40) AS summary,
           p || ' positive, ' || n || ' negative words' AS evidence, 'lexicon' AS reason
    FROM (SELECT id, title, text, {count(NS.POSITIVE_WORDS)} AS p, {count(NS.NEGATIVE_WORDS)} AS n FROM v_worded) x"""


# news whose titles gain words of the lexicon, by id
_GAINED = ["", "growth and Record profit", "loss, risk - fall! up", "strong strong RISE beat gain", "weak down"]
add_view("v_worded", ("v_news",), "SELECT id, text, CASE id % 5 " + " ".join(
    f"WHEN {k} THEN {'title' if not w else f'{w!r} || chr(32) || coalesce(title, chr(32))'}" for k, w in enumerate(_GAINED)) + " END AS title FROM v_news")


@register("n3_score", with_views(_lexicon_sql(), "v_worded"))
def q_n3(spark, sf):
    """Every news row through the scorer plug-in (here the deterministic lexicon), parsed and attached."""
    n = views.news(spark, sf)
    gained = F.element_at(F.array(*[F.lit(w) for w in _GAINED]), (F.col("id") % 5 + 1).cast("int"))
    n = n.withColumn("title", F.when(gained == "", F.col("title")).otherwise(F.concat(gained, F.lit(" "), F.coalesce("title", F.lit(" ")))))
    r = NS.score(n, NS.lexicon_scorer(), ["id", "title", "text"])
    return NS.attach_scores(NS.parse_scores(r, "response", "scores").drop("response", "text"))


@register("n4_strip_fence", with_views(f"SELECT id, {strip_fence('response')} AS cleaned FROM v_response", "v_response"))
def q_n4(spark, sf):
    return views.responses(spark, sf).select("id", NS.strip_fence(F.col("response")).alias("cleaned"))


def _parsed_sql(source="v_response", extra=""):
    # only text that is a valid JSON object reaches the extractor (it raises on malformed input)
    nums = ", ".join(f"TRY_CAST(json_extract_string(j, '$.{f}') AS DOUBLE) AS {f}" for f in NS.SCORE_FIELDS)
    txt = ", ".join(f"json_extract_string(j, '$.{f}') AS {f}" for f in NS.TEXT_FIELDS)
    return (f"SELECT id, {nums}, {txt}{extra} FROM ("
            f"SELECT id, CASE WHEN starts_with(c, '{{') AND json_valid(c) THEN c END AS j FROM ("
            f"SELECT id, {strip_fence('response')} AS c FROM {source}) r) q")


add_view("v_parsed", ("v_response",), _parsed_sql())


def _parsed(spark, sf):
    r = views.responses(spark, sf)
    return NS.parse_scores(r, "response", "s").select("id", "s.*")


@register("n5_parse_scores", with_views("SELECT * FROM v_parsed", "v_parsed"))
def q_n5(spark, sf):
    return _parsed(spark, sf)


# every fifth response sends its summary as an explicit null
add_view("v_response_nulls", ("v_response",), """
    SELECT id, CASE WHEN id % 5 = 0 THEN regexp_replace(response, '"summary": "[^"]*"', '"summary": null')
                    ELSE response END AS response FROM v_response""")
add_view("v_parsed_keys", ("v_response_nulls",), _parsed_sql("v_response_nulls", ", json_keys(j) AS keys"))


@register("n6_attach_scores", with_views("""
    SELECT e.event_id AS id, e.event_type, p.sentiment_score, p.impact_intensity, p.certainty, p.time_horizon,
           CASE WHEN list_contains(p.keys, 'summary') THEN p.summary ELSE 'row ' || e.event_type END AS summary,
           p.evidence, p.reason
    FROM events e JOIN v_parsed_keys p ON e.event_id = p.id""", "v_parsed_keys"))
def q_n6(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("event_id").alias("id"), "event_type", F.concat(F.lit("row "), F.col("event_type")).alias("summary"))
    nulls = F.regexp_replace("response", '"summary": "[^"]*"', '"summary": null')
    sent = views.responses(spark, sf).withColumn("response", F.when(F.col("id") % 5 == 0, nulls).otherwise(F.col("response")))
    r = NS.parse_scores(sent, "response", "scores", keys="keys").select("id", "scores", "keys")
    return NS.attach_scores(e.join(r, "id"), keys="keys")


@register("n7_score_incremental", with_views("SELECT * FROM v_parsed", "v_parsed"))
def q_n7(spark, sf):
    """Two scoring runs into one sink: the second scores only ids the sink lacks."""
    from ..sources.files import scratch_path

    path = scratch_path(spark, "n7")
    todo = views.responses(spark, sf)
    first = todo.filter(F.col("id") % 2 == 0)
    NS.parse_scores(first, "response", "s").select("id", "s.*").write.mode("append").parquet(path)
    done = spark.read.parquet(path)
    rest = NS.score_incremental(todo, done, "id")
    NS.parse_scores(rest, "response", "s").select("id", "s.*").write.mode("append").parquet(path)
    return spark.read.parquet(path)


@register("n8_recent", with_views(
    "SELECT id, day FROM v_scored WHERE day >= CAST(DATE '2024-01-30' - INTERVAL 7 DAY AS DATE)", "v_scored"))
def q_n8(spark, sf):
    return NS.recent(views.scored(spark, sf).select("id", "day"), 7, "2024-01-30", "day")


_RULES_SQL = {
    "sentiment_score": "sentiment_score BETWEEN -1.0 AND 1.0",
    "impact_intensity": "impact_intensity BETWEEN 0.0 AND 1.0",
    "certainty": "certainty BETWEEN 0.0 AND 1.0",
    "time_horizon": "time_horizon IN (0.8, 0.4, 0.1)",
}


@register("n9_validate_scores", with_views(
    "SELECT id, " + ", ".join(f"({r}) AS {f}_ok" for f, r in _RULES_SQL.items())
    + ", CASE WHEN " + _RULES_SQL["sentiment_score"] + " THEN sentiment_score END AS sentiment_null"
    + ", CASE WHEN sentiment_score IS NOT NULL THEN greatest(-1.0, least(1.0, sentiment_score)) END AS sentiment_clamp"
    + " FROM v_parsed", "v_parsed"))
def q_n9(spark, sf):
    sent = F.col("sentiment_score")
    flags = [f"{f}_ok" for f in NS.SCORE_FIELDS]
    flag = NS.validate_scores(_parsed(spark, sf), "flag").withColumn("sent", sent)
    nul = NS.validate_scores(flag, "null").withColumns({"sentiment_null": sent, "sentiment_score": F.col("sent")})
    return NS.validate_scores(nul, "clamp").select("id", *flags, "sentiment_null", sent.alias("sentiment_clamp"))


@register("n10_score_quality", with_views(
    "SELECT day, CAST(n0 AS BIGINT) AS n, rule, violations, missing FROM ("
    + " UNION ALL ".join(
        f"SELECT CAST(e.ts AS DATE) AS day, '{f}' AS rule, CAST(count(*) FILTER (WHERE NOT ({r})) AS BIGINT) AS violations, "
        f"CAST(count(*) FILTER (WHERE {f} IS NULL) AS BIGINT) AS missing, count(*) AS n0 "
        f"FROM events e JOIN v_parsed p ON e.event_id = p.id GROUP BY 1"
        for f, r in _RULES_SQL.items())
    + ") q", "v_parsed"))
def q_n10(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("date").alias("day"))
    return NS.score_quality(e.join(_parsed(spark, sf), "id"), "day")


# --------------------------------------------------------------------------
# incremental forms (Structured Streaming)
# --------------------------------------------------------------------------

@register("s9_stream_ingest", with_views(
    "SELECT id, stock_id, CAST(date AS TIMESTAMP) AS ts, title, source FROM v_news", "v_news"))
def q_s9_stream(spark, sf):
    """News rows arrive in four files, one of them re-delivering rows; the stream keeps each id once."""
    from ..sources.files import scratch_path
    from ..streaming import incremental as INC

    n = views.news(spark, sf).select("id", "stock_id", F.col("date").cast("timestamp_ntz").alias("ts"), "title", "source")
    landing, sink, ckpt = scratch_path(spark, "land"), scratch_path(spark, "sink"), scratch_path(spark, "ckpt")
    k = F.col("id") % 3
    INC.land_files(n, landing, [k == 0, k == 1, k == 2, F.col("id") % 5 == 0])
    INC.stream_ingest(spark, landing, n.schema, sink, ckpt, key="id", max_files=2)
    return INC.read_sink(spark, sink)


@register("n7_stream_scoring", with_views("SELECT * FROM v_parsed", "v_parsed"))
def q_n7_stream(spark, sf):
    """Responses arrive in three files (one repeats rows); each id is scored exactly once."""
    from ..sources.files import scratch_path
    from ..streaming import incremental as INC

    r = views.responses(spark, sf)
    landing, sink, ckpt = scratch_path(spark, "land"), scratch_path(spark, "sink"), scratch_path(spark, "ckpt")
    INC.land_files(r, landing, [F.col("id") % 2 == 0, F.col("id") % 2 == 1, F.col("id") % 7 == 0])
    INC.stream_score(spark, landing, r.schema, sink, ckpt, key="id", flush_rows=1000,
                     score=lambda d: NS.parse_scores(d, "response", "s").select("id", "s.*"))
    return INC.read_sink(spark, sink)

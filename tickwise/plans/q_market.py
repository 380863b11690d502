"""Queries over bars, index and daily features: S*, T*, M*, W*, P*."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.align import align_ffill
from ..operators.forecast import forecast_naive, horizon_rows, mape
from ..operators.scale import inverse_with, minmax_scale
from ..operators.windows import windows
from ..sources import views
from ..sources.tables import table
from .registry import register
from .sql_views import with_views

BAR_FEATURES = ["adj_close", "close", "high", "low", "open", "volume"]
N_STEPS, HORIZON = 20, 3


def r6(c):
    return F.round(c, 6)


# --------------------------------------------------------------------------
# flagship: bars + index -> ffill -> scale -> windows -> naive forecasts -> MAPE
# --------------------------------------------------------------------------

def naive_mape(spark: SparkSession, sf_dir: str):
    b = views.bars(spark, sf_dir)
    idx = views.index_series(spark, sf_dir)
    a = align_ffill(b, idx, out="idx_close")
    cols = BAR_FEATURES + ["idx_close"]
    s = minmax_scale(a, cols)                      # same partitioning as the ffill window
    smp = windows(s.drop(*[f"{c}__min" for c in cols if c != "close"], *[f"{c}__max" for c in cols if c != "close"]),
                  cols, N_STEPS, HORIZON, target="close", keep=["close__min", "close__max"])
    f = forecast_naive(smp, HORIZON, close_idx=cols.index("close"))
    models = F.array(*[F.struct(F.lit(k).alias("model"), F.col(f"pred_{k}").alias("p")) for k in ("last", "mean", "drift")])
    per_model = f.select("ticker", "y", "close__min", "close__max", F.explode(models).alias("_m")) \
        .select("ticker", "y", "close__min", "close__max", F.col("_m.model").alias("model"), F.col("_m.p").alias("pred"))
    rows = horizon_rows(per_model, "pred", keep=["ticker", "model", "close__min", "close__max"])
    out = rows.select("ticker", "model", "day",
                      inverse_with(F.col("predicted"), "close").alias("predicted"),
                      inverse_with(F.col("actual"), "close").alias("actual"))
    m = mape(out, by=["ticker", "model"])
    return m.select("ticker", "model", r6(F.col("mape")).alias("mape"), F.col("n").cast("bigint").alias("n"))


NAIVE_MAPE_SQL = with_views("""
, aligned AS (
  SELECT b.ticker, b.date, b.close,
         last_value(i.close IGNORE NULLS) OVER (PARTITION BY b.ticker ORDER BY b.date
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS idx_close
  FROM v_bars b LEFT JOIN v_index i ON b.date = i.date)
, st AS (SELECT ticker, min(close) AS mn, CASE WHEN max(close) - min(close) = 0 THEN 1.0 ELSE max(close) - min(close) END AS rng
         FROM aligned GROUP BY ticker)
, sc AS (SELECT a.ticker, row_number() OVER (PARTITION BY a.ticker ORDER BY a.date) - 1 AS pos,
                count(*) OVER (PARTITION BY a.ticker) AS n, (a.close - st.mn) / st.rng AS c, st.mn, st.rng
         FROM aligned a JOIN st ON a.ticker = st.ticker)
, win AS (SELECT ticker, pos, n, mn, rng, c AS last_c,
                 sum(c) OVER w / 20 AS mean_c, first_value(c) OVER w AS first_c,
                 lead(c, 1) OVER o AS y1, lead(c, 2) OVER o AS y2, lead(c, 3) OVER o AS y3
          FROM sc
          WINDOW w AS (PARTITION BY ticker ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
                 o AS (PARTITION BY ticker ORDER BY pos))
, smp AS (SELECT * FROM win WHERE pos >= 19 AND pos <= n - 4)
, rows AS (
  SELECT ticker, m.model, d.day,
         CASE m.model WHEN 'last' THEN last_c WHEN 'mean' THEN mean_c
              ELSE last_c + (last_c - first_c) / 19 * d.day END * rng + mn AS p,
         CASE d.day WHEN 1 THEN y1 WHEN 2 THEN y2 ELSE y3 END * rng + mn AS a
  FROM smp, (VALUES ('last'), ('mean'), ('drift')) m(model), (VALUES (1), (2), (3)) d(day))
SELECT ticker, model, round(avg(abs(p - a) / a), 6) AS mape, CAST(count(*) AS BIGINT) AS n
FROM rows GROUP BY ticker, model
""", "v_bars", "v_index")

register("p6_naive_mape", NAIVE_MAPE_SQL)(naive_mape)


# --------------------------------------------------------------------------
# shared inputs
# --------------------------------------------------------------------------
from ..operators import align as AL  # noqa: E402
from ..operators import forecast as FC  # noqa: E402
from ..operators import linear as LN  # noqa: E402
from ..operators import scale as SC  # noqa: E402
from ..operators import shaping as SH  # noqa: E402
from ..operators import windows as WN  # noqa: E402
from ..sources import files as IO  # noqa: E402

NEWS_FEATURES = ["net_impact", "weighted_horizon", "news_count", "divergence"]
ALL_FEATURES = BAR_FEATURES + ["idx_close"] + NEWS_FEATURES


def aligned(spark, sf):
    """bars + index (T2 ffill) + daily news features (T1 zero fill), volume as double."""
    b = views.bars(spark, sf).withColumn("volume", F.col("volume").cast("double"))
    a = AL.align_ffill(b, views.index_series(spark, sf), out="idx_close")
    a = AL.align_zero(a, views.feats(spark, sf), NEWS_FEATURES)
    return a.select("ticker", "date", *BAR_FEATURES, "idx_close", *NEWS_FEATURES)


def scaled(spark, sf, cols=ALL_FEATURES):
    """Aligned table min-max scaled per ticker (windows on the ticker partitioning)."""
    s = SC.minmax_scale(aligned(spark, sf), cols)
    return s.drop(*[f"{c}__{k}" for c in cols for k in ("min", "max")])


def _rng_sql(c, t="s"):
    return f"CASE WHEN {t}.{c}__max - {t}.{c}__min = 0 THEN 1.0 ELSE {t}.{c}__max - {t}.{c}__min END"


def _stats_sql(cols, src="v_aligned", where=""):
    parts = ", ".join(f"min({c}) AS {c}__min, max({c}) AS {c}__max" for c in cols)
    return f"SELECT ticker, {parts} FROM {src} {where} GROUP BY ticker"


from .sql_views import add_view  # noqa: E402

add_view("v_scaled", ("v_aligned",), "SELECT a.ticker, a.date, " + ", ".join(
    f"(a.{c} - s.{c}__min) / {_rng_sql(c)} AS {c}" for c in ALL_FEATURES)
    + f" FROM v_aligned a JOIN ({_stats_sql(ALL_FEATURES)}) s ON a.ticker = s.ticker")


def R6(name):
    return F.round(F.col(name), 6).alias(name)


def _r6_sql(cols):
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


# --------------------------------------------------------------------------
# S: sources, sinks, shaping
# --------------------------------------------------------------------------

@register("s1_read_bars", with_views(
    "SELECT date AS \"Date\", ticker AS \"Ticker\", adj_close AS \"Adj Close\", close AS \"Close\", high AS \"High\", "
    "low AS \"Low\", open AS \"Open\", volume AS \"Volume\" FROM v_bars", "v_bars"))
def q_s1(spark, sf):
    path = IO.scratch_path(spark, "bars")
    IO.write_table(IO.bars_to_csv_layout(views.bars(spark, sf)), path)
    return IO.read_bars(spark, path)


@register("s2_read_daily_features", with_views("SELECT * FROM v_feats", "v_feats"))
def q_s2(spark, sf):
    path = IO.scratch_path(spark, "feats")
    IO.write_table(views.feats(spark, sf), path)
    return IO.read_daily_features(spark, path)


@register("s3_read_index", with_views("SELECT date AS \"Date\", close AS \"Close\" FROM v_index", "v_index"))
def q_s3(spark, sf):
    path = IO.scratch_path(spark, "index")
    idx = views.index_series(spark, sf).select(
        F.col("date"), F.lit("IDX").alias("ticker"), F.col("close").alias("adj_close"), "close",
        F.col("close").alias("high"), F.col("close").alias("low"), F.col("close").alias("open"),
        F.lit(0).cast("bigint").alias("volume"))
    IO.write_table(IO.bars_to_csv_layout(idx), path)
    return IO.read_index(spark, path)


@register("s4_read_news", with_views(
    "SELECT stock_id, strftime(date, '%Y-%m-%d') || ' ' || lpad(CAST(id % 24 AS VARCHAR), 2, '0') || ':00' AS date, "
    "title, source FROM v_news", "v_news"))
def q_s4(spark, sf):
    path = IO.scratch_path(spark, "news")
    n = views.news(spark, sf).select(
        "stock_id",
        F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit(" "),
                 F.lpad((F.col("id") % 24).cast("string"), 2, "0"), F.lit(":00")).alias("date"),
        "title", "source")
    IO.write_table(n, path)
    return IO.read_news(spark, path)


@register("s5_read_forecast", with_views("""
    SELECT CAST(date + INTERVAL 1 DAY AS DATE) AS "Date", close AS "Predicted_Price", ticker FROM v_bars""", "v_bars"))
def q_s5(spark, sf):
    """Forecast files (one folder per ticker, the reference's Date/Predicted_Price layout) read back."""
    path = IO.scratch_path(spark, "forecast")
    fc = views.bars(spark, sf).select(
        F.date_add("date", 1).alias("Date"), F.col("close").alias("Predicted_Price"), "ticker")
    IO.write_table(fc, path, partition_by=["ticker"])
    return IO.read_forecast(spark, path)


@register("s6_wide_to_long", with_views("""
    SELECT d.date, t.ticker, CAST(b.open AS DOUBLE) AS open, CAST(b.high AS DOUBLE) AS high, CAST(b.low AS DOUBLE) AS low,
           CAST(b.close AS DOUBLE) AS close, CAST(b.adj_close AS DOUBLE) AS adj_close, CAST(b.volume AS DOUBLE) AS volume
    FROM (SELECT DISTINCT date FROM v_bars) d CROSS JOIN (VALUES ('A'), ('N'), ('R')) t(ticker)
    LEFT JOIN v_bars b ON b.date = d.date AND b.ticker = t.ticker""", "v_bars"))
def q_s6(spark, sf):
    return SH.wide_to_long(views.wide_bars(spark, sf), ["date"], "|")


@register("s7_sort_bars", with_views("SELECT ticker, date, close FROM v_bars ORDER BY ticker, date", "v_bars"))
def q_s7(spark, sf):
    return SH.sort_bars(views.bars(spark, sf).select("ticker", "date", "close"))


@register("s8_write_csv", with_views("SELECT ticker, date, close, volume FROM v_bars", "v_bars"))
def q_s8(spark, sf):
    path = IO.scratch_path(spark, "s8")
    IO.write_table(views.bars(spark, sf).select("ticker", "date", "close", "volume"), path, fmt="csv")
    schema = "ticker STRING, date DATE, close DOUBLE, volume BIGINT"
    return spark.read.schema(schema).option("header", True).csv(path)


@register("s9_append_idempotent", with_views("SELECT ticker, date, close FROM v_bars", "v_bars"))
def q_s9(spark, sf):
    """Two appends of overlapping day sets: the overlap is not duplicated."""
    path = IO.scratch_path(spark, "s9")
    b = views.bars(spark, sf).select("ticker", "date", "close", F.date_format("date", "yyyy-MM").alias("month"))
    IO.append_table(b.filter(F.year("date") <= 1998), path, ["month"], ["ticker", "date"])
    IO.append_table(b.filter(F.year("date") >= 1997), path, ["month"], ["ticker", "date"])
    return spark.read.schema("ticker STRING, date DATE, close DOUBLE, month STRING").parquet(path) \
        .select("ticker", "date", "close")


@register("s10_write_forecast", with_views("""
    SELECT ticker, CAST(date + INTERVAL 1 DAY AS DATE) AS "Date", close AS "Predicted_Price" FROM v_bars""", "v_bars"))
def q_s10(spark, sf):
    path = IO.scratch_path(spark, "s10")
    fc = views.bars(spark, sf).select("ticker", F.date_add("date", 1).alias("Date"), F.col("close").alias("Predicted_Price"))
    IO.write_table(fc, path, partition_by=["ticker"])
    return spark.read.schema("Date DATE, Predicted_Price DOUBLE, ticker STRING").option("header", True).csv(path)


@register("s11_date_spine", with_views("""
    SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM v_index""", "v_index"))
def q_s11(spark, sf):
    return SH.spine_between(views.index_series(spark, sf), "date")


@register("s12_day_slice", """
    SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS date FROM events
    WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'""")
def q_s12(spark, sf):
    ev = SH.day_range(table(spark, sf, "events"), "ts", "2024-01-10", "2024-01-20")  # pushed down
    ev = ev.select("event_id", SH.minute_text(F.col("ts")).alias("date"))
    return SH.day_slice(ev, SH.date_spine(spark, "2024-01-10", "2024-01-20"), "date")


@register("s13_minute_text", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS minute FROM events")
def q_s13(spark, sf):
    return table(spark, sf, "events").select("event_id", SH.minute_text(F.col("ts")).alias("minute"))


@register("s14_cast_key", "SELECT doc_id, CAST(doc_id % 7 AS VARCHAR) AS stock_id FROM documents")
def q_s14(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 7).alias("stock_id"))
    return SH.cast_key(d, "stock_id")


@register("s15_drop_cols", with_views("SELECT id, stock_id, date, title, source FROM v_news", "v_news"))
def q_s15(spark, sf):
    return SH.drop_cols(views.news(spark, sf), "text", "link", "url")


@register("s16_resolve_date_col", with_views(
    "SELECT id, CAST(date AS TIMESTAMP) + to_minutes(CAST(id % 1440 AS BIGINT)) AS ts FROM v_news", "v_news"))
def q_s16(spark, sf):
    n = views.news(spark, sf).select(
        "id", F.date_format(F.col("date").cast("timestamp_ntz") + F.make_interval(mins=(F.col("id") % 1440).cast("int")),
                            "yyyy-MM-dd HH:mm").alias("publish_date"))
    return SH.resolve_date_col(n, "ts").select("id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@register("s17_articles_schema", with_views(
    "SELECT title, text, CAST(NULL AS VARCHAR) AS publish_date, source, CAST(NULL AS VARCHAR) AS url FROM v_news", "v_news"))
def q_s17(spark, sf):
    return SH.articles_schema_select(views.news(spark, sf))


@register("s18_load_counts", with_views(
    "SELECT date, CAST(count(*) AS BIGINT) AS n FROM v_news GROUP BY ROLLUP (date)", "v_news"))
def q_s18(spark, sf):
    return SH.load_counts(views.news(spark, sf), "date")


def _profile_sql():
    cols = [("ticker", "string", False), ("date", "date", False), ("open", "double", True), ("high", "double", True),
            ("low", "double", True), ("close", "double", True), ("adj_close", "double", True), ("volume", "bigint", True)]
    parts = []
    for c, t, num in cols:
        mn = f"CAST(min({c}) AS DOUBLE)" if num else "CAST(NULL AS DOUBLE)"
        mx = f"CAST(max({c}) AS DOUBLE)" if num else "CAST(NULL AS DOUBLE)"
        parts.append(f"SELECT '{c}' AS \"column\", '{t}' AS dtype, CAST(count(*) AS BIGINT) AS n_rows, "
                     f"CAST(count(*) - count({c}) AS BIGINT) AS n_null, round({mn}, 6) AS min_value, "
                     f"round({mx}, 6) AS max_value FROM v_bars")
    return with_views(" UNION ALL ".join(parts), "v_bars")


@register("s19_profile", _profile_sql())
def q_s19(spark, sf):
    p = SH.profile(views.bars(spark, sf))
    return p.select("column", "dtype", "n_rows", "n_null", R6("min_value"), R6("max_value"))


@register("s20_preview", with_views(
    "SELECT id, title, substring(text, 1, 200) AS text FROM v_news ORDER BY id LIMIT 3", "v_news"))
def q_s20(spark, sf):
    return SH.preview(views.news(spark, sf).select("id", "title", "text"), ["id"], 3, 200)


@register("s21_project", with_views(
    "SELECT adj_close, close, high, low, open, volume FROM v_bars", "v_bars"))
def q_s21(spark, sf):
    return SH.project(views.bars(spark, sf), BAR_FEATURES)


# --------------------------------------------------------------------------
# T: calendar alignment
# --------------------------------------------------------------------------

@register("t1_align_zero", with_views(
    "SELECT ticker, date, close, " + _r6_sql(NEWS_FEATURES) + " FROM v_aligned", "v_aligned"))
def q_t1(spark, sf):
    b = views.bars(spark, sf).select("ticker", "date", "close")
    a = AL.align_zero(b, views.feats(spark, sf), NEWS_FEATURES)
    return a.select("ticker", "date", "close", *[R6(c) for c in NEWS_FEATURES])


@register("t2_align_ffill", with_views("SELECT ticker, date, round(idx_close, 6) AS idx_close FROM v_aligned", "v_aligned"))
def q_t2(spark, sf):
    a = AL.align_ffill(views.bars(spark, sf).select("ticker", "date"), views.index_series(spark, sf), out="idx_close")
    return a.select("ticker", "date", R6("idx_close"))


@register("t3_align_asof", with_views("""
    SELECT b.ticker, b.date, round(i.close, 6) AS idx_close
    FROM v_bars b ASOF LEFT JOIN v_index i ON b.date >= i.date""", "v_bars", "v_index"))
def q_t3(spark, sf):
    a = AL.align_asof(views.bars(spark, sf).select("ticker", "date"), views.index_series(spark, sf), out="idx_close")
    return a.select("ticker", "date", R6("idx_close"))


@register("t4_align_position", with_views("""
    SELECT b.ticker, b.date, round(i.close, 6) AS b_close
    FROM (SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date) AS p FROM v_bars) b
    LEFT JOIN (SELECT close, row_number() OVER (ORDER BY date) AS p FROM v_index) i ON b.p = i.p""", "v_bars", "v_index"))
def q_t4(spark, sf):
    a = AL.align_position(views.bars(spark, sf).select("ticker", "date"), views.index_series(spark, sf), ["close"])
    return a.select("ticker", "date", R6("b_close"))


_WIN_SQL = """
    , wr AS (SELECT ticker, pos AS start_pos, date AS start_date, lead(date, 19) OVER o AS end_date, lead(date, 22) OVER o AS tail
             FROM (SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS pos FROM v_bars) b
             WINDOW o AS (PARTITION BY ticker ORDER BY pos))
    , wins AS (SELECT ticker, start_pos, start_date, end_date FROM wr WHERE tail IS NOT NULL)
"""


@register("t5_window_news", with_views(_WIN_SQL + """
    SELECT w.ticker, w.start_pos, row_number() OVER (PARTITION BY w.ticker, w.start_pos ORDER BY f.date) AS k,
           f.date, """ + _r6_sql(NEWS_FEATURES) + """
    FROM wins w JOIN v_feats f ON f.date BETWEEN w.start_date AND w.end_date""", "v_bars", "v_feats"))
def q_t5(spark, sf):
    wn = AL.window_news(views.bars(spark, sf), views.feats(spark, sf), NEWS_FEATURES, step=20, h=3)
    return wn.select("ticker", "start_pos", F.posexplode("news").alias("k", "n")).select(
        "ticker", "start_pos", (F.col("k") + 1).alias("k"), F.col("n.date").alias("date"),
        *[F.round(F.col(f"n.{c}"), 6).alias(c) for c in NEWS_FEATURES])


@register("t6_pad_post", with_views(_WIN_SQL + """
    , hits AS (SELECT w.ticker, w.start_pos, count(f.date) AS n_real,
                      sum(CAST(CAST(f.net_impact AS FLOAT) AS DOUBLE) + CAST(CAST(f.weighted_horizon AS FLOAT) AS DOUBLE)
                          + CAST(CAST(f.news_count AS FLOAT) AS DOUBLE) + CAST(CAST(f.divergence AS FLOAT) AS DOUBLE)) AS s
               FROM wins w LEFT JOIN v_feats f ON f.date BETWEEN w.start_date AND w.end_date
               GROUP BY w.ticker, w.start_pos)
    SELECT ticker, start_pos, CAST(n_real AS INTEGER) AS n_real, CAST(max(n_real) OVER () AS INTEGER) AS n_padded,
           round(coalesce(s, 0.0), 4) AS checksum
    FROM hits""", "v_bars", "v_feats"))
def q_t6(spark, sf):
    wn = AL.window_news(views.bars(spark, sf), views.feats(spark, sf), NEWS_FEATURES, step=20, h=3)
    p = AL.pad_post(wn, "news", NEWS_FEATURES)
    flat = F.flatten("padded")
    return p.select("ticker", "start_pos", F.size("news").alias("n_real"), F.size("padded").alias("n_padded"),
                    F.round(F.aggregate(flat, F.lit(0.0), lambda a, v: a + v.cast("double")), 4).alias("checksum"))


@register("t7_last_n", with_views("""
    SELECT ticker, date, close FROM (
      SELECT ticker, date, close, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS r FROM v_bars) x
    WHERE r <= 20""", "v_bars"))
def q_t7(spark, sf):
    return AL.last_n(views.bars(spark, sf).select("ticker", "date", "close"), 20)


@register("t8_backtest_slice", with_views("""
    SELECT ticker, date, close, rpos, CASE WHEN rpos BETWEEN 15 AND 34 THEN 'input' ELSE 'actual' END AS role FROM (
      SELECT ticker, date, close, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) - 1 AS rpos FROM v_bars) x
    WHERE rpos BETWEEN 12 AND 34""", "v_bars"))
def q_t8(spark, sf):
    s = AL.backtest_slice(views.bars(spark, sf).select("ticker", "date", "close"), n=20, past=15, h=3)
    return s.select("ticker", "date", "close", F.col("rpos").cast("bigint").alias("rpos"), "role")


@register("t9_future_bdays", with_views("""
    SELECT d.date, CAST(r - 1 AS INTEGER) AS day, fdate FROM (
      SELECT date, fdate, row_number() OVER (PARTITION BY date ORDER BY fdate) AS r FROM (
        SELECT date, CAST(date + CAST(i AS INTEGER) AS DATE) AS fdate
        FROM (SELECT DISTINCT date FROM v_bars) b, range(0, 12) t(i)) c
      WHERE isodow(fdate) <= 5) d
    WHERE r BETWEEN 2 AND 4""", "v_bars"))
def q_t9(spark, sf):
    d = views.bars(spark, sf).select("date").distinct()
    return d.select("date", F.posexplode(AL.future_bdays(F.col("date"), 3)).alias("k", "fdate")).select(
        "date", (F.col("k") + 1).alias("day"), "fdate")


# --------------------------------------------------------------------------
# M: scaling
# --------------------------------------------------------------------------

@register("m1_fit_minmax", with_views(
    "SELECT ticker, " + ", ".join(f"round(min({c}), 6) AS {c}__min, round(max({c}), 6) AS {c}__max" for c in ALL_FEATURES)
    + " FROM v_aligned GROUP BY ticker", "v_aligned"))
def q_m1(spark, sf):
    st = SC.fit_minmax(aligned(spark, sf), ALL_FEATURES)
    return st.select("ticker", *[R6(c) for c in st.columns if c != "ticker"])


@register("m2_apply_minmax", with_views("SELECT ticker, date, " + _r6_sql(ALL_FEATURES) + " FROM v_scaled", "v_scaled"))
def q_m2(spark, sf):
    return scaled(spark, sf).select("ticker", "date", *[R6(c) for c in ALL_FEATURES])


_TRAIN_SQL = """
    , ap AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS pos,
                    count(*) OVER (PARTITION BY ticker) AS n FROM v_aligned)
    , st AS (SELECT ticker, min(close) AS close__min, max(close) AS close__max FROM ap
             WHERE pos < floor(n * CAST(0.7 AS DOUBLE)) GROUP BY ticker)
"""


@register("m3_fit_train_apply", with_views(_TRAIN_SQL + """
    SELECT ap.ticker, ap.date, round((ap.close - s.close__min) / """ + _rng_sql("close") + """, 6) AS close
    FROM ap JOIN st s ON ap.ticker = s.ticker""", "v_aligned"))
def q_m3(spark, sf):
    a = WN.split_rows(aligned(spark, sf).select("ticker", "date", "close"))
    st = SC.fit_minmax(a, ["close"], where=F.col("split") == "train")
    return SC.apply_minmax(a, st, ["close"]).select("ticker", "date", R6("close"))


_ROUNDTRIP_SQL = with_views("SELECT ticker, date, close, true AS roundtrip_ok FROM v_aligned", "v_aligned")


def _roundtrip(back, orig):
    return (F.abs(back - orig) <= F.lit(1e-9) * F.abs(orig)).alias("roundtrip_ok")


@register("m4_inverse_minmax", _ROUNDTRIP_SQL)
def q_m4(spark, sf):
    a = aligned(spark, sf).select("ticker", "date", "close")
    st = SC.fit_minmax(a, ["close"])
    s = SC.apply_minmax(a, st, ["close"], suffix="_s")
    back = SC.inverse_minmax(s, st, "close_s", stat_col="close", out="back")
    return back.select("ticker", "date", "close", _roundtrip(F.col("back"), F.col("close")))


@register("m5_inverse_multi", _ROUNDTRIP_SQL)
def q_m5(spark, sf):
    a = aligned(spark, sf)
    st = SC.fit_minmax(a, ALL_FEATURES)
    s = SC.apply_minmax(a, st, ALL_FEATURES, suffix="_s").select("ticker", "date", "close", "close_s")
    back = SC.inverse_minmax(s, st, "close_s", stat_col="close", out="back")
    return back.select("ticker", "date", "close", _roundtrip(F.col("back"), F.col("close")))


@register("m6_clip01", with_views(_TRAIN_SQL + """
    SELECT ap.ticker, ap.date, round(greatest(0.0, least(1.0, (ap.close - s.close__min) / """ + _rng_sql("close") + """)), 6) AS close
    FROM ap JOIN st s ON ap.ticker = s.ticker""", "v_aligned"))
def q_m6(spark, sf):
    a = WN.split_rows(aligned(spark, sf).select("ticker", "date", "close"))
    st = SC.fit_minmax(a, ["close"], where=F.col("split") == "train")
    s = SC.apply_minmax(a, st, ["close"])
    return s.select("ticker", "date", F.round(SC.clip01(F.col("close")), 6).alias("close"))


# --------------------------------------------------------------------------
# W: window datasets
# --------------------------------------------------------------------------

def _xsum(col="x"):
    return F.round(F.aggregate(F.flatten(col), F.lit(0.0), lambda a, v: a + v), 6)


_SPOS = """
    , sp AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS pos,
                    count(*) OVER (PARTITION BY ticker) AS n FROM v_scaled)
"""


@register("w1_windows_univariate", with_views(_SPOS + """
    SELECT ticker, pos, date AS end_date, CAST(20 AS INTEGER) AS n_steps, round(sum(adj_close) OVER w, 6) AS x_sum,
           round(first_value(adj_close) OVER w, 6) AS x_first, round(lead(adj_close, 1) OVER o, 6) AS y
    FROM sp
    WINDOW w AS (PARTITION BY ticker ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
           o AS (PARTITION BY ticker ORDER BY pos)
    QUALIFY pos >= 19 AND pos <= n - 2""", "v_scaled"))
def q_w1(spark, sf):
    s = WN.windows(scaled(spark, sf), ["adj_close"], 20, 1, target="adj_close")
    return s.select("ticker", "pos", "end_date", F.size("x").alias("n_steps"), _xsum().alias("x_sum"),
                    F.round(F.col("x")[0][0], 6).alias("x_first"), F.round(F.col("y")[0], 6).alias("y"))


_BSUM = " + ".join(BAR_FEATURES)


@register("w2_windows_multivariate", with_views(_SPOS + f"""
    SELECT ticker, pos, date AS end_date, CAST(20 AS INTEGER) AS n_steps, CAST(6 AS INTEGER) AS width,
           round(sum({_BSUM}) OVER w, 6) AS x_sum,
           round(lead(close, 1) OVER o, 6) AS y1, round(lead(close, 2) OVER o, 6) AS y2, round(lead(close, 3) OVER o, 6) AS y3
    FROM sp
    WINDOW w AS (PARTITION BY ticker ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
           o AS (PARTITION BY ticker ORDER BY pos)
    QUALIFY pos >= 19 AND pos <= n - 4""", "v_scaled"))
def q_w2(spark, sf):
    s = WN.windows(scaled(spark, sf), BAR_FEATURES, 20, 3, target="close")
    return s.select("ticker", "pos", "end_date", F.size("x").alias("n_steps"), F.size(F.col("x")[0]).alias("width"),
                    _xsum().alias("x_sum"), *[F.round(F.col("y")[i], 6).alias(f"y{i + 1}") for i in range(3)])


@register("w3_windows_multi_input", with_views(_SPOS + f"""
    SELECT ticker, pos, round(sum({_BSUM}) OVER w, 6) AS bars_sum, CASE WHEN count(idx_close) OVER w = 40 THEN round(sum(idx_close) OVER w, 6) END AS index_sum,
           round(sum(net_impact + weighted_horizon + news_count + divergence) OVER w, 6) AS news_sum
    FROM sp
    WINDOW w AS (PARTITION BY ticker ORDER BY pos ROWS BETWEEN 39 PRECEDING AND CURRENT ROW)
    QUALIFY pos >= 39 AND pos <= n - 4""", "v_scaled"))
def q_w3(spark, sf):
    groups = {"bars": BAR_FEATURES, "index": ["idx_close"], "news": NEWS_FEATURES}
    s = WN.windows_multi(scaled(spark, sf), groups, 40, 3)
    return s.select("ticker", "pos", _xsum("bars").alias("bars_sum"), _xsum("index").alias("index_sum"),
                    _xsum("news").alias("news_sum"))


@register("w4_concat_features", with_views(_SPOS + """
    SELECT ticker, pos, CAST(40 AS INTEGER) AS n_steps, CAST(11 AS INTEGER) AS width,
           CASE WHEN count(idx_close) OVER w = 40 THEN round(sum(idx_close) OVER w, 6) END AS col6_sum, round(sum(divergence) OVER w, 6) AS col10_sum
    FROM sp
    WINDOW w AS (PARTITION BY ticker ORDER BY pos ROWS BETWEEN 39 PRECEDING AND CURRENT ROW)
    QUALIFY pos >= 39 AND pos <= n - 4""", "v_scaled"))
def q_w4(spark, sf):
    groups = {"bars": BAR_FEATURES, "index": ["idx_close"], "news": NEWS_FEATURES}
    s = WN.concat_windows(scaled(spark, sf), groups, 40, 3)
    col = lambda i: F.round(F.aggregate(F.transform("x", lambda st: st[i]), F.lit(0.0), lambda a, v: a + v), 6)
    return s.select("ticker", "pos", F.size("x").alias("n_steps"), F.size(F.col("x")[0]).alias("width"),
                    col(6).alias("col6_sum"), col(10).alias("col10_sum"))


@register("w5_split_rows", with_views("""
    SELECT ticker, split, CAST(count(*) AS BIGINT) AS n, min(date) AS first_date, max(date) AS last_date FROM (
      SELECT ticker, date, CASE WHEN pos < floor(n * CAST(0.7 AS DOUBLE)) THEN 'train' WHEN pos < floor(n * CAST(0.85 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split
      FROM (SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS pos,
                   count(*) OVER (PARTITION BY ticker) AS n FROM v_bars) x) y
    GROUP BY ticker, split""", "v_bars"))
def q_w5(spark, sf):
    s = WN.split_rows(views.bars(spark, sf).select("ticker", "date"))
    return s.groupBy("ticker", "split").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"),
                                            F.max("date").alias("last_date"))


_SAMPLES_SQL = """
    , smp AS (SELECT ticker, pos FROM (SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS pos,
                                             count(*) OVER (PARTITION BY ticker) AS n FROM v_bars) x
              WHERE pos >= 39 AND pos <= n - 4)
    , sn AS (SELECT ticker, pos, row_number() OVER (PARTITION BY ticker ORDER BY pos) - 1 AS spos,
                    count(*) OVER (PARTITION BY ticker) AS n FROM smp)
"""


@register("w6_split_samples", with_views(_SAMPLES_SQL + """
    SELECT ticker, split, CAST(count(*) AS BIGINT) AS n FROM (
      SELECT ticker, CASE WHEN spos < floor(n * CAST(0.7 AS DOUBLE)) - 5 THEN 'train' WHEN spos < floor(n * CAST(0.7 AS DOUBLE)) THEN NULL
                          WHEN spos < floor(n * CAST(0.85 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM sn) y
    GROUP BY ticker, split""", "v_bars"))
def q_w6(spark, sf):
    s = WN.windows(views.bars(spark, sf), ["close"], 40, 3)
    return WN.split_samples(s, gap=5).groupBy("ticker", "split").agg(F.count(F.lit(1)).alias("n"))


@register("w7_tail_split", with_views(_SAMPLES_SQL + """
    SELECT ticker, split, CAST(count(*) AS BIGINT) AS n FROM (
      SELECT ticker, CASE WHEN spos < floor(n * CAST(0.7 AS DOUBLE)) THEN 'train' ELSE 'val' END AS split FROM sn) y
    GROUP BY ticker, split""", "v_bars"))
def q_w7(spark, sf):
    s = WN.windows(views.bars(spark, sf), ["close"], 40, 3)
    return WN.tail_split(s, 0.3).groupBy("ticker", "split").agg(F.count(F.lit(1)).alias("n"))


@register("w8_flatten_window", with_views(_SPOS + f"""
    SELECT ticker, pos, CAST(120 AS INTEGER) AS length, round(sum({_BSUM}) OVER w, 6) AS total
    FROM sp
    WINDOW w AS (PARTITION BY ticker ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)
    QUALIFY pos >= 19 AND pos <= n - 4""", "v_scaled"))
def q_w8(spark, sf):
    from pyspark.ml.functions import vector_to_array

    s = WN.flatten_window(WN.windows(scaled(spark, sf), BAR_FEATURES, 20, 3), "x", "features")
    arr = vector_to_array("features")
    return s.select("ticker", "pos", F.size(arr).alias("length"),
                    F.round(F.aggregate(arr, F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


# --------------------------------------------------------------------------
# P: forecasts and evaluation
# --------------------------------------------------------------------------

def _close_samples(spark, sf, n=20, h=3, newest=None):
    """Windows of the raw close: x = n closes, y = next h closes; of the ``newest`` bars, if given."""
    b = views.bars(spark, sf).select("ticker", "date", "close")
    if newest is not None:
        b = AL.last_n(b, newest)
    return WN.windows(b, ["close"], n, h, target="close").withColumn("xc", F.transform("x", lambda s: s[0]))


_CLOSE_WIN_SQL = """
    , cw AS (SELECT ticker, pos, date AS end_date, n, close AS last_c, first_value(close) OVER w AS first_c,
                    sum(close) OVER w / 20 AS mean_c,
                    lead(close, 1) OVER o AS y1, lead(close, 2) OVER o AS y2, lead(close, 3) OVER o AS y3
             FROM (SELECT ticker, date, close, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS pos,
                          count(*) OVER (PARTITION BY ticker) AS n FROM v_bars) b
             WINDOW w AS (PARTITION BY ticker ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
                    o AS (PARTITION BY ticker ORDER BY pos))
    , smp AS (SELECT * FROM cw WHERE pos >= 19 AND pos <= n - 4)
    , hr AS (SELECT ticker, pos, end_date, d.day,
                    last_c + (last_c - first_c) / 19 * d.day AS predicted,
                    CASE d.day WHEN 1 THEN y1 WHEN 2 THEN y2 ELSE y3 END AS actual
             FROM smp, (VALUES (1), (2), (3)) d(day))
"""


def _drift_rows(spark, sf):
    s = FC.forecast_naive(_close_samples(spark, sf), 3, kinds=("drift",))
    return FC.horizon_rows(s, "pred_drift", keep=["ticker", "pos", "end_date"])


@register("p3_forecast_naive", with_views(_CLOSE_WIN_SQL + """
    SELECT ticker, pos, day, round(predicted, 6) AS predicted, actual FROM hr""", "v_bars"))
def q_p3(spark, sf):
    r = _drift_rows(spark, sf)
    return r.select("ticker", "pos", "day", R6("predicted"), "actual")


@register("p5_mse", with_views(_CLOSE_WIN_SQL + """
    SELECT ticker, round(avg(pow(predicted - actual, 2)), 4) AS mse FROM hr GROUP BY ticker""", "v_bars"))
def q_p5(spark, sf):
    m = FC.mse(_drift_rows(spark, sf), by=["ticker"])
    return m.select("ticker", F.round("mse", 4).alias("mse"))


@register("p6_ape_by_day", with_views(_CLOSE_WIN_SQL + """
    SELECT ticker, day, round(avg(abs(predicted - actual) / actual), 6) AS mape FROM hr GROUP BY ticker, day""", "v_bars"))
def q_p6(spark, sf):
    m = FC.ape_by_day(_drift_rows(spark, sf), by=["ticker"])
    return m.select("ticker", "day", R6("mape"))


def _last_sql(past=0):
    return f"""
    , lw AS (SELECT ticker, max(date) AS last_date, arg_max(close, date) AS last_c,
                    arg_min(close, date) AS first_c FROM (
               SELECT ticker, date, close, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS r FROM v_bars) x
             WHERE r BETWEEN {past + 1} AND {past + 20} GROUP BY ticker)
    , fd AS (SELECT ticker, last_date, last_c, first_c, fdate,
                    row_number() OVER (PARTITION BY ticker ORDER BY fdate) - 1 AS day FROM (
               SELECT ticker, last_date, last_c, first_c, CAST(last_date + CAST(i AS INTEGER) AS DATE) AS fdate
               FROM lw, range(0, 12) t(i)) c
             WHERE isodow(fdate) <= 5)
    , fc AS (SELECT ticker, CAST(day AS INTEGER) AS day, fdate AS date,
                    last_c + (last_c - first_c) / 19 * day AS predicted_price FROM fd WHERE day BETWEEN 1 AND 3)
"""


def _final_forecast(spark, sf, past=0):
    """Drift forecast from the 20 bars that end ``past`` bars before the last one."""
    b = AL.backtest_slice(views.bars(spark, sf).select("ticker", "date", "close"), 20, past, 0)
    last = b.groupBy("ticker").agg(
        F.max("date").alias("last_date"),
        F.sort_array(F.collect_list(F.struct("date", "close"))).alias("_w"))
    last = last.withColumn("xc", F.transform("_w", lambda s: s["close"]))
    last = last.withColumn("pred", FC.naive_predictions(F.col("xc"), 3, "drift"))
    return FC.assemble_forecast(last, "last_date", "pred", 3)


@register("p8_assemble_forecast", with_views(_last_sql() + """
    SELECT ticker, day, date, round(predicted_price, 6) AS predicted_price FROM fc""", "v_bars"))
def q_p8(spark, sf):
    f = _final_forecast(spark, sf)
    return f.select("ticker", "day", "date", R6("predicted_price"))


_COMPARED = 5  # the compared forecast starts so many bars before the last one: its days have actual prices


@register("p7_compare", with_views(_last_sql(_COMPARED) + """
    SELECT coalesce(a.ticker, f.ticker) AS ticker, coalesce(a.date, f.date) AS date, a.close AS actual,
           round(f.predicted_price, 6) AS predicted
    FROM v_bars a FULL OUTER JOIN fc f ON a.ticker = f.ticker AND a.date = f.date""", "v_bars"))
def q_p7(spark, sf):
    f = _final_forecast(spark, sf, _COMPARED).select("ticker", "date", F.col("predicted_price").alias("predicted"))
    c = FC.compare(views.bars(spark, sf).select("ticker", "date", "close"), f)
    return c.select("ticker", "date", "actual", R6("predicted"))


@register("p10_backtest", with_views(_CLOSE_WIN_SQL + """
    , rk AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY pos DESC) - 1 AS r FROM smp)
    , bt AS (SELECT ticker, r + 3 AS past, d.day, last_c AS predicted,
                    CASE d.day WHEN 1 THEN y1 WHEN 2 THEN y2 ELSE y3 END AS actual
             FROM rk, (VALUES (1), (2), (3)) d(day) WHERE r + 3 IN (3, 6, 9, 12, 15, 18, 21, 24, 27, 30, 45, 60))
    SELECT ticker, CAST(past AS INTEGER) AS past, round(avg(abs(predicted - actual) / actual), 6) AS mape
    FROM bt GROUP BY ticker, past""", "v_bars"))
def q_p10(spark, sf):
    pasts = [3, 6, 9, 12, 15, 18, 21, 24, 27, 30, 45, 60]
    # the oldest origin's window ends max(pasts) bars before the last: older bars are in no sample
    s = FC.forecast_naive(_close_samples(spark, sf, newest=max(pasts) + 20), 3, kinds=("last",))
    bt = FC.backtest(s, pasts, 3)
    rows = FC.horizon_rows(bt, "pred_last", keep=["ticker", "past"])
    return FC.mape(rows, by=["ticker", "past"]).select("ticker", F.col("past").cast("int").alias("past"), R6("mape"))


# --- learned models, with closed forms in SQL for two lags ---

def _lag_samples(spark, sf, lags=2, h=3):
    """x = the newest ``lags`` closes (newest first), y = the next ``h`` closes, in thousands."""
    b = views.bars(spark, sf).select("ticker", "date", (F.col("close") / 1000).alias("close"))
    s = WN.windows(b, ["close"], lags, h, target="close")
    return s.withColumn("x", F.reverse(F.transform("x", lambda v: v[0])))


_LAG_SQL = """
    , lg AS (SELECT ticker, pos, n, x0, x1, y1, y2, y3, row_number() OVER (PARTITION BY ticker ORDER BY pos DESC) - 1 AS r,
                    row_number() OVER (PARTITION BY ticker ORDER BY pos) - 1 AS spos, count(*) OVER (PARTITION BY ticker) AS ns
             FROM (SELECT ticker, pos, n, c AS x0, lag(c) OVER o AS x1, lead(c, 1) OVER o AS y1, lead(c, 2) OVER o AS y2, lead(c, 3) OVER o AS y3
                   FROM (SELECT ticker, close / 1000 AS c, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS pos,
                                count(*) OVER (PARTITION BY ticker) AS n FROM v_bars) b
                   WINDOW o AS (PARTITION BY ticker ORDER BY pos)) l
             WHERE x1 IS NOT NULL AND y3 IS NOT NULL)
"""


def _two_lag_fit(target, l2="0.0"):
    """Cramer's rule on the covariances: the coefficients and the intercept of one target."""
    a, b, c = f"(var_pop(x0) + {l2})", f"(var_pop(x1) + {l2})", "covar_pop(x0, x1)"
    u, v = f"covar_pop(x0, {target})", f"covar_pop(x1, {target})"
    det = f"({a} * {b} - {c} * {c})"
    b0, b1 = f"(({u} * {b} - {v} * {c}) / {det})", f"(({v} * {a} - {u} * {c}) / {det})"
    return b0, b1, f"(avg({target}) - {b0} * avg(x0) - {b1} * avg(x1))"


def _fit_columns(l2="0.0"):
    return ", ".join(f"{e} AS {n}{k}" for k in (1, 2, 3) for n, e in zip(("b", "d", "a"), _two_lag_fit(f"y{k}", l2)))


_LAG_PRED = ("CASE d.day " + " ".join(f"WHEN {k} THEN a{k} + b{k} * x0 + d{k} * x1" for k in (1, 2, 3)) + " END AS predicted, "
             "CASE d.day WHEN 1 THEN y1 WHEN 2 THEN y2 ELSE y3 END AS actual")


@register("p1_two_lags", with_views(_LAG_SQL + f"""
    , ft AS (SELECT {_fit_columns()} FROM lg WHERE spos < floor(ns * 0.7))
    SELECT ticker, pos, CAST(d.day AS INTEGER) AS day, round(predicted, 6) AS predicted, actual
    FROM (SELECT ticker, pos, d.day, {_LAG_PRED} FROM lg, ft, (VALUES (1), (2), (3)) d(day) WHERE spos >= floor(ns * 0.85)) d""", "v_bars"))
def q_p1_lags(spark, sf):
    """Direct 3-day forecast from two closes: one pass for all horizons' normal equations, forecasts of the test split."""
    s = WN.split_samples(_lag_samples(spark, sf))
    model = LN.solve(LN.collect_moments(s.filter(F.col("split") == "train"))[None], 3)
    p = s.filter(F.col("split") == "test").withColumn("pred", model.predictions(F.col("x")))
    rows = FC.horizon_rows(p, "pred", keep=["ticker", "pos"])
    return rows.select("ticker", "pos", F.col("day").cast("int").alias("day"), R6("predicted"), "actual")


@register("p2_recursive_one_lag", with_views(_LAG_SQL + """
    , ft AS (SELECT regr_slope(y1, x0) AS b, regr_intercept(y1, x0) AS a FROM lg WHERE spos < floor(ns * 0.7))
    , s1 AS (SELECT ticker, pos, a, b, a + b * x0 AS p1 FROM lg, ft WHERE spos >= floor(ns * 0.85))
    , s2 AS (SELECT *, a + b * p1 AS p2 FROM s1)
    SELECT ticker, pos, CAST(day AS INTEGER) AS day, round(CASE day WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE a + b * p2 END, 6) AS predicted
    FROM s2, (VALUES (1), (2), (3)) d(day)""", "v_bars"))
def q_p2_lag(spark, sf):
    """Recursive forecast: a one-step fit on the newest close, rolled three steps ahead."""
    s = WN.split_samples(_lag_samples(spark, sf))
    s = s.withColumns({"x": F.slice("x", 1, 1), "y1": F.slice("y", 1, 1)})
    fit = LN.solve(LN.collect_moments(s.filter(F.col("split") == "train"), y="y1")[None], 1)
    p = FC.forecast_recursive(s.filter(F.col("split") == "test"), fit.coef[0], fit.intercept[0], 3)
    rows = FC.horizon_rows(p, "pred", keep=["ticker", "pos"])
    return rows.select("ticker", "pos", F.col("day").cast("int").alias("day"), R6("predicted"))


_L2 = 1e-4


@register("p4_two_lags_l2", with_views(_LAG_SQL + f"""
    , ft AS (SELECT {_fit_columns(repr(_L2))} FROM lg WHERE spos < floor(ns * 0.7))
    , pr AS (SELECT CASE WHEN spos < floor(ns * 0.85) THEN 'val' ELSE 'test' END AS split, d.day, {_LAG_PRED}
             FROM lg, ft, (VALUES (1), (2), (3)) d(day) WHERE spos >= floor(ns * 0.7))
    SELECT split, CAST(day AS INTEGER) AS day, round(avg(pow(predicted - actual, 2)), 6) AS mse FROM pr GROUP BY split, day""", "v_bars"))
def q_p4_lags(spark, sf):
    """L2-penalised fit of two closes; errors by split and horizon from the splits' moments alone (no second pass)."""
    found = LN.collect_moments(WN.split_samples(_lag_samples(spark, sf)).filter(F.col("split").isNotNull()), "split")
    model = LN.solve(found["train"], 3, _L2)
    rows = [(k, i + 1, float(e)) for k in ("val", "test") if k in found for i, e in enumerate(LN.mse(found[k], model))]
    return spark.createDataFrame(rows, "split STRING, day INT, mse DOUBLE").withColumn("mse", F.round("mse", 6))


_DESCENT = {"rate": 0.05, "patience": 10, "max_iter": 60}


@register("p9_early_stopping", with_views(_LAG_SQL + f"""
    , sp AS (SELECT CASE WHEN spos < floor(ns * 0.7) THEN 'train' WHEN spos < floor(ns * 0.85) THEN 'val' END AS split, x0 AS x, y1 AS y FROM lg)
    , tr AS (SELECT avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS c FROM sp WHERE split = 'train')
    , va AS (SELECT avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS c FROM sp WHERE split = 'val')
    , gd(i, b) AS (SELECT 0, CAST(0 AS DOUBLE) UNION ALL
        SELECT i + 1, b - {_DESCENT["rate"]} / (2 * (vx + {_L2!r})) * (2 * (b * vx - c) + 2 * {_L2!r} * b) FROM gd, tr WHERE i < {_DESCENT["max_iter"]})
    , ls AS (SELECT i, tr.vy - 2 * b * tr.c + b * b * tr.vx + {_L2!r} * b * b AS t,
                    va.vy - 2 * b * va.c + b * b * va.vx + pow(va.my - tr.my - b * (va.mx - tr.mx), 2) + {_L2!r} * b * b AS v FROM gd, tr, va)
    , bs AS (SELECT i, t, v, (SELECT min(z.i) FROM ls z WHERE z.i <= ls.i AND z.v = (SELECT min(w.v) FROM ls w WHERE w.i <= ls.i)) AS best FROM ls)
    , en AS (SELECT coalesce(min(i), {_DESCENT["max_iter"]}) AS last FROM bs WHERE i - best >= {_DESCENT["patience"]})
    SELECT CAST(i AS INTEGER) AS iteration, round(t, 6) AS train_loss, round(v, 6) AS val_loss,
           i = (SELECT best FROM bs, en WHERE i = last) AS best FROM bs, en WHERE i <= last""", "v_bars", recursive=True))
def q_p9_stop(spark, sf):
    """Train and validation loss per iteration of a descent that validation stops; the best iteration is marked."""
    s = WN.split_samples(_lag_samples(spark, sf)).withColumns({"x": F.slice("x", 1, 1), "y": F.slice("y", 1, 1)})
    found = LN.collect_moments(s.filter(F.col("split").isin("train", "val")), "split")
    _, curve = LN.descend(found["train"], found["val"], 1, _L2, **_DESCENT)
    out = spark.createDataFrame(curve, "iteration INT, train_loss DOUBLE, val_loss DOUBLE, best BOOLEAN")
    return out.select("iteration", R6("train_loss"), R6("val_loss"), "best")


@register("p10_backtest_refit", with_views(_LAG_SQL + f"""
    , og AS (SELECT DISTINCT r + 3 AS past FROM lg WHERE (r + 3) % 3 = 0)
    , ft AS (SELECT past, {_fit_columns()} FROM og JOIN lg ON lg.r >= og.past GROUP BY past HAVING count(*) > 30)
    SELECT ticker, CAST(past AS INTEGER) AS past, CAST(day AS INTEGER) AS day, round(predicted, 5) AS predicted, actual
    FROM (SELECT ticker, past, d.day, {_LAG_PRED} FROM lg JOIN ft ON lg.r = ft.past - 3, (VALUES (1), (2), (3)) d(day)) p""", "v_bars"))
def q_p10_refit(spark, sf):
    """Backtest over the whole history: a refit before every third bar, on what was known then (origins that know over 30 samples)."""
    s = _lag_samples(spark, sf)
    longest = s.groupBy("ticker").count().agg(F.max("count")).first()[0] or 0
    bt = LN.backtest_linear(s, range(3, longest + 3, 3), 3, least=31)
    rows = FC.horizon_rows(bt, "pred", keep=["ticker", "past"])
    return rows.select("ticker", "past", F.col("day").cast("int").alias("day"), F.round("predicted", 5).alias("predicted"), "actual")


def _direct_dataset(spark, sf, n=20, h=3):
    groups = {"bars": BAR_FEATURES, "index": ["idx_close"], "news": NEWS_FEATURES}
    a = aligned(spark, sf)
    a = WN.split_rows(a)
    cols = ALL_FEATURES
    st = SC.fit_minmax(a, cols, where=F.col("split") == "train")
    s = SC.apply_minmax(a.drop("pos", "split"), st, cols)
    w = WN.split_samples(WN.concat_windows(s, groups, n, h))
    return WN.flatten_window(w, "x", "x", as_vector=False)


@register("p1_fit_direct")
def q_p1(spark, sf):
    """Direct 3-day forecast (220 inputs, all horizons from one pass), test-split MSE per ticker and day."""
    d = _direct_dataset(spark, sf)
    model = LN.solve(LN.collect_moments(d.filter(F.col("split") == "train"))[None], 3)
    p = d.filter(F.col("split") == "test").withColumn("pred", model.predictions(F.col("x")))
    p = p.withColumn("pred", F.transform("pred", SC.clip01))
    rows = FC.horizon_rows(p, "pred", keep=["ticker"])
    return FC.mse(rows, by=["ticker", "day"])


@register("p2_forecast_recursive")
def q_p2(spark, sf):
    """Univariate recursive forecast: one-step linear model, 3 steps rolled forward."""
    b = views.bars(spark, sf).select("ticker", "date", "adj_close")
    w = WN.split_samples(WN.windows(b, ["adj_close"], 20, 3, target="adj_close"))
    w = w.withColumn("xs", F.transform("x", lambda s: s[0]))
    w = w.withColumn("y1", F.slice("y", 1, 1))
    fit = LN.solve(LN.collect_moments(w.filter(F.col("split") == "train"), x="xs", y="y1")[None], 1)
    p = FC.forecast_recursive(w.filter(F.col("split") == "test"), fit.coef[0], fit.intercept[0], 3, x="xs")
    rows = FC.horizon_rows(p, "pred", keep=["ticker"])
    return FC.mape(rows, by=["ticker"])


@register("p4_fit_regularized")
def q_p4(spark, sf):
    """L2-penalised (1e-4) direct model: solved, and by a descent stopped on validation loss; errors on validation and test."""
    found = LN.collect_moments(_direct_dataset(spark, sf).filter(F.col("split").isNotNull()), "split")
    models = {"solved": LN.solve(found["train"], 3, 1e-4), "stopped": LN.descend(found["train"], found["val"], 3, 1e-4)[0]}
    rows = [(name, split, float(LN.mse(found[split], m).mean())) for name, m in models.items() for split in ("val", "test")]
    return spark.createDataFrame(rows, "model STRING, split STRING, mse DOUBLE")


@register("p9_training_curve")
def q_p9(spark, sf):
    """Train and validation loss per iteration of the 220-input model (patience 10, best iteration marked)."""
    found = LN.collect_moments(_direct_dataset(spark, sf).filter(F.col("split").isin("train", "val")), "split")
    _, curve = LN.descend(found["train"], found["val"], 3, 1e-4)
    return spark.createDataFrame(curve, "iteration INT, train_loss DOUBLE, val_loss DOUBLE, best BOOLEAN")

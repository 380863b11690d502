"""Window core, scaling, calendar and forecast invariants."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickwise.operators import align as AL
from tickwise.operators import features as FT
from tickwise.operators import forecast as FC
from tickwise.operators import scale as SC
from tickwise.operators import windows as WN
from tickwise.operators.shaping import wide_to_long
from tickwise.sources import views

from .conftest import SF_SMALL


def test_window_sample_count(spark):
    b = views.bars(spark, SF_SMALL)
    n_rows = {r.ticker: r["count"] for r in b.groupBy("ticker").count().collect()}
    s = WN.windows(b, ["close", "open"], 20, 3)
    got = {r.ticker: r["count"] for r in s.groupBy("ticker").count().collect()}
    assert got == {t: n - 20 - 3 + 1 for t, n in n_rows.items()}
    r = s.first()
    assert len(r.x) == 20 and len(r.x[0]) == 2 and len(r.y) == 3


def test_minmax_roundtrip_and_constant(spark):
    df = spark.createDataFrame([("A", 1, 5.0, 2.0), ("A", 2, 7.0, 2.0), ("A", 3, None, 2.0), ("B", 1, 1.0, 3.0)],
                               "ticker STRING, date INT, x DOUBLE, c DOUBLE")
    st = SC.fit_minmax(df, ["x", "c"])
    s = SC.apply_minmax(df, st, ["x", "c"], suffix="_s")
    rows = {(r.ticker, r.date): r for r in s.collect()}
    assert rows[("A", 1)].x_s == 0.0 and rows[("A", 2)].x_s == 1.0 and rows[("A", 3)].x_s is None
    assert rows[("A", 1)].c_s == 0.0  # constant feature -> 0, not 0.5
    back = SC.inverse_minmax(s, st, "x_s", stat_col="x", out="xb").collect()
    for r in back:
        assert r.xb == r.x or (r.x is None and r.xb is None)
    w = SC.minmax_scale(df, ["x"], suffix="_s")
    w = w.withColumn("xb", SC.inverse_with(F.col("x_s"), "x")).collect()
    assert all(r.xb == r.x for r in w if r.x is not None)


def test_future_bdays(spark):
    df = spark.createDataFrame([(dt.date(2026, 3, 6),), (dt.date(2026, 3, 7),), (dt.date(2026, 3, 4),)], "d DATE")
    got = [list(r.f) for r in df.select(AL.future_bdays(F.col("d"), 3).alias("f")).collect()]
    assert got[0] == [dt.date(2026, 3, 9), dt.date(2026, 3, 10), dt.date(2026, 3, 11)]   # Friday -> Mon..Wed
    assert got[1] == [dt.date(2026, 3, 10), dt.date(2026, 3, 11), dt.date(2026, 3, 12)]  # Saturday -> Tue..Thu
    assert got[2] == [dt.date(2026, 3, 5), dt.date(2026, 3, 6), dt.date(2026, 3, 9)]


def test_recursive_forecast_identity_like(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "x ARRAY<DOUBLE>")
    # coefficients [0, 0, 1]: next = last -> the last value repeats
    r = FC.forecast_recursive(df, [0.0, 0.0, 1.0], 0.0, 3).first()
    assert list(r.pred) == [3.0, 3.0, 3.0]
    # coefficients [0, -1, 2]: next = 2*last - previous -> linear extrapolation
    r = FC.forecast_recursive(df, [0.0, -1.0, 2.0], 0.0, 3).first()
    assert list(r.pred) == [4.0, 5.0, 6.0]


def test_align_ffill_semantics(spark):
    bars = spark.createDataFrame([("A", dt.date(2024, 1, d)) for d in (1, 2, 3, 5, 6)], "ticker STRING, date DATE")
    idx = spark.createDataFrame([(dt.date(2024, 1, 2), 10.0), (dt.date(2024, 1, 4), 40.0), (dt.date(2024, 1, 6), 60.0)],
                                "date DATE, close DOUBLE")
    ff = {r.date.day: r.idx_close for r in AL.align_ffill(bars, idx).collect()}
    assert ff == {1: None, 2: 10.0, 3: 10.0, 5: 10.0, 6: 60.0}   # off-calendar 4th never carries
    asof = {r.date.day: r.idx_close for r in AL.align_asof(bars, idx).collect()}
    assert asof == {1: None, 2: 10.0, 3: 10.0, 5: 40.0, 6: 60.0}


def test_feature_identities(spark):
    rows = [(1, dt.date(2024, 1, 1), 0.9, 0.8, 1.0, 0.8), (2, dt.date(2024, 1, 1), 0.9, 0.8, 1.0, 0.8),
            (3, dt.date(2024, 1, 2), 0.7, 0.5, 1.0, 0.4), (4, dt.date(2024, 1, 2), 0.8, 0.5, 1.0, 0.4),
            (5, dt.date(2024, 1, 3), 0.6, 0.8, 1.0, 0.8)]
    df = spark.createDataFrame(rows, "id INT, day DATE, sentiment DOUBLE, intensity DOUBLE, certainty DOUBLE, horizon DOUBLE")
    f = {r.day.day: r for r in FT.daily_features(df).collect()}
    assert f[1].net_impact == pytest.approx(1.08)            # 0.72 + 0.5 * 0.72
    assert f[2].divergence == pytest.approx(0.0707106781)    # scores 0.7, 0.8
    assert f[3].divergence == 0.0 and f[3].news_count == 1.0
    assert f[3].net_impact == pytest.approx(0.48)


def test_net_impact_hot_day_exact(spark):
    # one day with 5,000 rows: the salted top-k must give the same sum as the plain ranked sum
    n = 5000
    rows = [(i, dt.date(2024, 1, 1), ((i * 37) % 21 - 10) / 10.0, (i % 11) / 10.0, ((i * 7) % 11) / 10.0, 0.4)
            for i in range(n)]
    df = spark.createDataFrame(rows, "id INT, day DATE, sentiment DOUBLE, intensity DOUBLE, certainty DOUBLE, horizon DOUBLE")
    xs = sorted(((s * it * c, i) for i, _, s, it, c, _ in rows), key=lambda t: (-abs(t[0]), t[1]))
    exp = sum(x * 0.5 ** k for k, (x, _) in enumerate(xs))
    for buckets, fan_in in ((16, 64), (256, 4)):   # one level; four levels (256 -> 64 -> 16 -> 4 -> 1)
        got = FT.daily_features(df, salt_buckets=buckets, fan_in=fan_in).first().net_impact
        assert got == pytest.approx(exp, abs=1e-12)


def test_wide_to_long_keeps_missing(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), 1.0, None, 10.0, None)],
                               "date DATE, `close|A` DOUBLE, `close|B` DOUBLE, `volume|A` DOUBLE, `volume|B` DOUBLE")
    got = sorted((r.ticker, r.close, r.volume) for r in wide_to_long(df).collect())
    assert got == [("A", 1.0, 10.0), ("B", None, None)]


@pytest.mark.parametrize("parts", [1, 2, 200])
def test_determinism_across_shuffle_partitions(spark, parts):
    from tickwise.plans.registry import QUERIES, load_all

    load_all()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        got = sorted(tuple(r) for r in QUERIES["p6_naive_mape"](spark, SF_SMALL).collect())
        d = sorted(tuple(r) for r in QUERIES["f_daily_features"](spark, SF_SMALL).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    base = sorted(tuple(r) for r in QUERIES["p6_naive_mape"](spark, SF_SMALL).collect())
    based = sorted(tuple(r) for r in QUERIES["f_daily_features"](spark, SF_SMALL).collect())
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == base and d == based


def test_exact_mean_is_order_independent(spark):
    from decimal import Decimal

    from tickwise.sources.views import _exact_mean

    vals = [(i % 7, round(0.01 * ((i * 37) % 1000), 2)) for i in range(5000)]
    df = spark.createDataFrame(vals, "g INT, v DOUBLE")
    exp = {}
    for g, v in vals:
        exp.setdefault(g, []).append(Decimal(str(v)))
    for parts in (1, 13):
        got = {r.g: r.m for r in df.repartition(parts).groupBy("g").agg(_exact_mean("v").alias("m")).collect()}
        for g, xs in exp.items():
            assert got[g] == float(sum(xs)) / len(xs)


def test_per_day_tables_are_checked(spark):
    bars = spark.sql("SELECT 'A' AS ticker, DATE'2020-01-02' AS date")
    twice = spark.sql("SELECT DATE'2020-01-02' AS date, 1.0D AS close UNION ALL SELECT DATE'2020-01-02', 2.0D")
    for run in (lambda: AL.align_zero(bars, twice, ["close"]), lambda: AL.align_ffill(bars, twice), lambda: AL.align_asof(bars, twice),
                lambda: AL.align_position(bars, twice, ["close"])):
        with pytest.raises(Exception, match="more than one row of a day"):
            run().collect()


def test_concat_windows_equals_zipped_windows(spark):
    df = spark.range(12).selectExpr("'A' AS ticker", "date_add(DATE'2020-01-01', cast(id AS int)) AS date", "id * 1.0D AS close", "id * 2.0D AS b",
                                    "if(id = 5, null, id * 3.0D) AS c")
    groups = {"p": ["close", "b"], "q": ["c"]}
    zipped = WN.concat_features(WN.windows_multi(df, groups, 4, 2), ["p", "q"]).select("pos", "x", "y").orderBy("pos").collect()
    assert zipped == WN.concat_windows(df, groups, 4, 2).select("pos", "x", "y").orderBy("pos").collect() and len(zipped) == 7


def test_pad_post_of_no_rows(spark):
    df = spark.createDataFrame([], "news array<struct<v:double>>")
    assert AL.pad_post(df, "news", ["v"]).collect() == []

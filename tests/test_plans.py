"""Physical-plan properties the design relies on (read from ``explain()``)."""

import contextlib
import io
import re

import pytest

from tickwise.plans.registry import QUERIES, load_all

from .conftest import SF_SMALL

load_all()

# builders that write files, fit models or run eager rounds while being built
SIDE_EFFECTS = {
    "s1_read_bars", "s2_read_daily_features", "s3_read_index", "s4_read_news", "s5_read_forecast", "s8_write_csv",
    "s9_append_idempotent", "s10_write_forecast", "s9_stream_ingest", "n7_stream_scoring", "n7_score_incremental",
    "p1_fit_direct", "p2_forecast_recursive", "p4_fit_regularized", "p9_training_curve", "d5_fuzzy_dedup",
    "d6_dedup_stats", "d7_similar_pairs", "d2_order_in_day", "p1_two_lags", "p2_recursive_one_lag", "p4_two_lags_l2",
    "p9_early_stopping", "p10_backtest_refit",
}


def plan_of(spark, name):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        QUERIES[name](spark, SF_SMALL).explain()
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SIDE_EFFECTS))
def test_no_cross_or_nested_loop_join(spark, name):
    plan = plan_of(spark, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_ranks_are_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan_of(spark, "f2_net_impact")


@pytest.mark.parametrize("name", ["l8_dedup_first", "l9_union_sources", "l10_dedup_across_sources", "l13_link_counts"])
def test_pages_are_scanned_once(spark, name):
    assert len(re.findall(r"FileScan parquet", plan_of(spark, name))) == 1


def test_flagship_plan(spark):
    plan = plan_of(spark, "p6_naive_mape")
    # bars aggregate, index aggregate, one ticker partitioning shared by every window
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 3
    assert plan.count("BroadcastHashJoin") == 1 and "SortMergeJoin" not in plan


def test_calendar_tables_are_broadcast(spark):
    plan = plan_of(spark, "t1_align_zero")
    assert plan.count("BroadcastHashJoin") >= 1 and "SortMergeJoin" not in plan
    # the range join runs as exploded calendar days joined to broadcast per-day features
    plan = plan_of(spark, "t5_window_news")
    assert plan.count("BroadcastHashJoin") >= 1 and "SortMergeJoin" not in plan


def test_day_range_reaches_the_scan(spark):
    plan = plan_of(spark, "s12_day_slice")
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(ts", plan)
    assert re.search(r"ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>", plan)


def test_window_news_is_a_slice(spark):
    import datetime as dt

    from tickwise.operators.align import window_news

    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)
    bars = spark.createDataFrame([(t, day(i)) for t in "ab" for i in range(0, 60, 3 if t == "a" else 2)], "ticker string, date date")
    news = {9: 1.0, 10: 2.0, 11: None, 30: 4.0, 31: 5.0, 58: 6.0}
    feats = spark.createDataFrame([(day(i), v) for i, v in sorted(news.items(), reverse=True)], "date date, v double")
    for table, held in ((feats, news), (feats.filter("v = 4"), {30: 4.0}), (feats.limit(0), {})):
        got = window_news(bars, table, ["v"], step=4)
        assert got.count() == 17 + 27
        for r in got.collect():
            want = [(day(i), v) for i, v in sorted(held.items()) if r.start_date <= day(i) <= r.end_date]
            assert [(x.date, x.v) for x in r.news] == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan

"""The test views of ``tickwise.sources.views`` written in DuckDB SQL.

``with_views(sql, "v_bars", ...)`` prefixes a query with the CTEs it needs
(dependencies are added automatically, in dependency order).
"""

from __future__ import annotations

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "v_bars": ((), """
        SELECT ticker, date, open, high, low, close, close * (1.0 - disc) AS adj_close, volume
        FROM (
          SELECT l_returnflag AS ticker, CAST(l_shipdate AS DATE) AS date,
                 first(l_extendedprice / NULLIF(l_quantity, 0) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS open,
                 max(l_extendedprice / NULLIF(l_quantity, 0)) AS high,
                 min(l_extendedprice / NULLIF(l_quantity, 0)) AS low,
                 last(l_extendedprice / NULLIF(l_quantity, 0) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS close,
                 CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / count(l_discount) AS disc,
                 CAST(sum(l_quantity) AS BIGINT) AS volume
          FROM lineitem GROUP BY 1, 2) b"""),
    "v_index": ((), """
        SELECT CAST(o_orderdate AS DATE) AS date,
               CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(o_totalprice) AS close
        FROM orders GROUP BY 1"""),
    "v_scored": ((), """
        SELECT event_id AS id, CAST(ts AS DATE) AS day,
               CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 21 - 10 AS DOUBLE) / 10.0 AS sentiment,
               CAST(event_id % 11 AS DOUBLE) / 10.0 AS intensity,
               CAST(CAST(floor(value) AS BIGINT) % 11 AS DOUBLE) / 10.0 AS certainty,
               CASE WHEN event_type IN ('purchase', 'signup') THEN 0.8
                    WHEN event_type = 'click' THEN 0.4 ELSE 0.1 END AS horizon
        FROM events"""),
    "v_news": ((), """
        SELECT doc_id AS id, lpad(CAST(doc_id % 7 AS VARCHAR), 4, '0') AS stock_id,
               CAST(DATE '1998-01-01' + CAST(doc_id % 40 AS INTEGER) AS DATE) AS date,
               split_part(text, chr(10), 1) AS title, text, source
        FROM documents"""),
    "v_pages": ((), "SELECT page_id, url, html FROM pages"),
    "v_response": ((), """
        SELECT id, CASE WHEN id % 3 = 0 THEN '```json' || chr(10) || r || chr(10) || '```' ELSE r END AS response
        FROM (
          SELECT id, CASE WHEN id % 97 = 0 THEN substring(b, 1, length(b) - 5) ELSE b END AS r
          FROM (
            SELECT event_id AS id,
              CASE WHEN event_id % 83 = 0 THEN '{}'
                   WHEN event_id % 89 = 0 THEN '[' || o || ']'
                   ELSE o END AS b
            FROM (
              SELECT event_id,
                '{"sentiment_score": ' || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 31 - 15 AS VARCHAR)
                || 'e-1, "impact_intensity": ' || CAST(event_id % 11 AS VARCHAR)
                || 'e-1, "certainty": "' || CAST(CAST(floor(value) AS BIGINT) % 11 AS VARCHAR)
                || 'e-1", "time_horizon": ' || (CASE WHEN event_type IN ('purchase', 'signup') THEN '0.8'
                                                    WHEN event_type = 'click' THEN '0.4' ELSE '0.1' END)
                || ', "summary": "' || event_type
                || '", "evidence": "k=' || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) AS VARCHAR)
                || '", "reason": "user ' || CAST(user_id AS VARCHAR) || '"}' AS o
              FROM events) x) y) z"""),
}


def add_view(name: str, deps: tuple[str, ...], sql: str) -> None:
    VIEWS[name] = (deps, sql)


def with_views(sql: str, *names: str, recursive: bool = False) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in VIEWS[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]}\n)" for n in order)
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{sql}"

# daily features of v_scored (F1-F4) and the same moved into the bar calendar
add_view("v_daily", ("v_scored",), """
    SELECT day,
           sum(x * pow(0.5, rn - 1)) AS net_impact,
           CASE WHEN coalesce(sum(CASE WHEN horizon IS NOT NULL THEN intensity END), 0) = 0 THEN 0.0
                ELSE sum(horizon * intensity) / sum(CASE WHEN horizon IS NOT NULL THEN intensity END) END AS weighted_horizon,
           CAST(count(*) AS DOUBLE) AS news_count,
           CASE WHEN count(*) = 1 THEN 0.0 ELSE stddev_samp(sentiment) END AS divergence
    FROM (SELECT *, sentiment * intensity * certainty AS x,
                 row_number() OVER (PARTITION BY day ORDER BY abs(sentiment * intensity * certainty) DESC NULLS LAST, id) AS rn
          FROM v_scored) s
    GROUP BY day""")
add_view("v_feats", ("v_daily",), """
    SELECT CAST(day - INTERVAL 324 MONTH AS DATE) AS date, net_impact, weighted_horizon, news_count, divergence
    FROM v_daily""")
# bars + index (ffill) + news features (zero fill): the aligned table of the forecast workflow
add_view("v_aligned", ("v_bars", "v_index", "v_feats"), """
    SELECT b.ticker, b.date, b.adj_close, b.close, b.high, b.low, b.open, CAST(b.volume AS DOUBLE) AS volume,
           last_value(i.close IGNORE NULLS) OVER (PARTITION BY b.ticker ORDER BY b.date
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS idx_close,
           coalesce(f.net_impact, 0.0) AS net_impact, coalesce(f.weighted_horizon, 0.0) AS weighted_horizon,
           coalesce(f.news_count, 0.0) AS news_count, coalesce(f.divergence, 0.0) AS divergence
    FROM v_bars b LEFT JOIN v_index i ON b.date = i.date LEFT JOIN v_feats f ON b.date = f.date""")

"""Named queries over the supplied tables, and the same in SQL.

A query takes (spark, sf_dir) and reads whole tables. Doubles are rounded to six digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with its SQL where there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: The adapters of sources.adapters in SQL.
READINGS = "readings AS (SELECT event_type AS site, time_bucket(INTERVAL '15 minutes', ts) AS ts, avg(value) AS power, 500.0::DOUBLE AS capacity FROM events GROUP BY 1, 2)"
GRID = READINGS + """, grid AS (SELECT g.site, g.ts, r.power, 500.0::DOUBLE AS capacity
    FROM (SELECT site, unnest(generate_series(min(ts), max(ts), INTERVAL '15 minutes')) AS ts FROM readings GROUP BY site) g LEFT JOIN readings r USING (site, ts))"""
CLEAN = GRID + """, clean0 AS (SELECT site, ts, capacity, CASE WHEN p <= 400 THEN p END AS power FROM (SELECT *, CASE WHEN power IS NOT NULL THEN greatest(power - 50, 0) END AS p FROM grid)),
    clean AS (SELECT *, power / 400.0 AS cf, (power IS NULL)::TINYINT AS power_missing FROM clean0)"""
FILLED = CLEAN + """, filled AS (SELECT *, last_value(cf IGNORE NULLS) OVER (PARTITION BY site ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS cf_fill,
    CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'train' WHEN ts < TIMESTAMP '2024-01-23' THEN 'val' ELSE 'test' END AS split FROM clean),
    site_med AS (SELECT site, median(cf) AS m FROM clean WHERE ts < TIMESTAMP '2024-01-16' GROUP BY site),
    all_med AS (SELECT median(cf) AS g FROM clean WHERE ts < TIMESTAMP '2024-01-16'),
    prepared AS (SELECT f.site, f.ts, f.capacity, f.power, f.cf, f.power_missing, f.split, coalesce(f.cf_fill, s.m, a.g) AS cf_input FROM filled f LEFT JOIN site_med s USING (site) CROSS JOIN all_med a)"""
LED = FILLED + """, led AS (SELECT *, lead(ts) OVER w AS target_ts, CASE WHEN lead(ts) OVER w - ts = INTERVAL '15 minutes' THEN lead(cf) OVER w END AS target_y, lead(split) OVER w AS target_split
    FROM prepared WINDOW w AS (PARTITION BY site ORDER BY ts))"""
PREDICTED = LED + """, predicted AS (SELECT site, capacity, target_ts, target_y * 400.0 AS y_true, least(greatest(cf_input, 0), 1) * 400.0 AS y_pred, target_split AS split FROM led WHERE target_y IS NOT NULL)"""
MONTHLY = PREDICTED + """, monthly AS (SELECT site, strftime(target_ts, '%Y-%m') AS month, count(*) AS n, avg(abs(y_pred - y_true)) AS mae, sqrt(avg((y_pred - y_true) ** 2)) AS rmse,
    1 - avg(abs(y_pred - y_true)) / min(capacity) AS acc_mae, 1 - sqrt(avg((y_pred - y_true) ** 2)) / min(capacity) AS acc_rmse FROM predicted GROUP BY 1, 2)"""
DAILY = "daily AS (SELECT 'all' AS site, o_orderdate AS ts, sum(o_totalprice) AS y, count(*) AS orders FROM orders GROUP BY o_orderdate)"
FRAMES = DAILY + """, marked AS (SELECT *, sum(brk) OVER (ORDER BY ts) AS block FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (ORDER BY ts) = INTERVAL '1 day' THEN 0 ELSE 1 END AS brk FROM daily)),
    frames AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY block) AS block_rows, row_number() OVER (PARTITION BY block ORDER BY ts) - 1 AS origin FROM marked) WHERE block_rows >= 21)"""
DISPATCH = """dispatch AS (SELECT l_returnflag AS site, l_shipdate AS ts, l_quantity AS y_true, l_extendedprice / 2000.0 AS y_pred, 50.0::DOUBLE AS capacity, l_discount AS discount, l_tax AS tax FROM lineitem)"""
SLOTS = """crowd AS (SELECT grp, ts, 2 * (epoch(ts)::BIGINT // 900 - 1893408) + k - 1 AS row_id, value, k FROM (SELECT grp, ts, event_id, value, row_number() OVER (PARTITION BY grp, ts ORDER BY event_id) AS k
        FROM (SELECT CASE WHEN event_type IN ('click', 'error') THEN 'a' ELSE 'b' END AS grp, time_bucket(INTERVAL '15 minutes', ts) AS ts, event_id, value FROM events)) WHERE k <= 2),
    slots AS (SELECT grp, ts, row_id, value FROM crowd WHERE k = 1),
    days AS (SELECT DISTINCT ts::DATE AS date, ts::DATE < DATE '2024-01-25' AS own FROM slots),
    splits AS (SELECT date, CASE WHEN NOT own THEN 'test' WHEN k <= least(greatest(1, round_even(n * 0.15, 0)), n - 1) THEN 'validation' ELSE 'train' END AS split
        FROM (SELECT *, row_number() OVER (PARTITION BY own ORDER BY date DESC) AS k, count(*) OVER (PARTITION BY own) AS n FROM days))"""
INDEX = SLOTS + """, cand AS (SELECT s.grp, s.ts, s.row_id, s.value, p.split, CASE p.split WHEN 'train' THEN INTERVAL '30 minutes' ELSE INTERVAL '15 minutes' END AS stride FROM crowd s JOIN splits p ON s.ts::DATE = p.date),
    kept AS ((SELECT grp, split, min(ts) AS ts, any_value(stride) AS stride FROM cand GROUP BY grp, split)
        UNION ALL (SELECT k.grp, k.split, (SELECT min(c.ts) FROM cand c WHERE c.grp = k.grp AND c.split = k.split AND c.ts >= k.ts + k.stride) AS ts, k.stride FROM kept k WHERE k.ts IS NOT NULL)),
    first_of AS (SELECT grp, split, ts, min(row_id) AS row_id FROM cand GROUP BY ALL),
    accepted AS (SELECT f.grp, f.row_id FROM first_of f JOIN kept k ON f.grp = k.grp AND f.split = k.split AND f.ts = k.ts),
    look AS (SELECT s.grp, s.ts, max(s.row_id) AS row_id, arg_max(s.value, s.row_id) AS value, any_value(p.split) AS split FROM crowd s LEFT JOIN splits p ON s.ts::DATE = p.date GROUP BY s.grp, s.ts),
    offs AS (SELECT unnest([-60, -45, -30, -15, 0, 15]) AS m),
    met AS (SELECT c.grp, c.row_id, count(l.ts) FILTER (m <= 0) AS past, count(l.ts) FILTER (m > 0) AS ahead, count(*) FILTER (l.ts IS NOT NULL AND l.split IS DISTINCT FROM c.split) AS other,
            list(l.row_id ORDER BY m) FILTER (m <= 0) AS history_rows, list(l.value ORDER BY m) FILTER (m <= 0) AS history,
            max(l.row_id) FILTER (m > 0) AS target_row, max(l.ts) FILTER (m > 0) AS target_time, max(l.value) FILTER (m > 0) AS target
        FROM cand c CROSS JOIN offs LEFT JOIN look l ON l.grp = c.grp AND l.ts = c.ts + m * INTERVAL '1 minute' GROUP BY c.grp, c.row_id),
    idx AS (SELECT c.grp, c.row_id AS issue_row, c.ts AS issue_time, c.split, CASE WHEN k.row_id IS NULL THEN 'rejected_stride' WHEN past < 5 THEN 'rejected_missing_history' WHEN ahead = 0 THEN 'rejected_missing_target'
            WHEN other > 0 THEN 'rejected_split_boundary' ELSE 'valid' END AS reason, history_rows, history, target_row, target_time, target
        FROM cand c LEFT JOIN accepted k ON c.grp = k.grp AND c.row_id = k.row_id JOIN met ON met.grp = c.grp AND met.row_id = c.row_id)"""
VALID = INDEX + ", valid AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY grp, issue_row) - 1 AS sample_index FROM idx WHERE reason = 'valid')"


from . import eda, scores, series, windows  # noqa: E402, F401  they register their queries

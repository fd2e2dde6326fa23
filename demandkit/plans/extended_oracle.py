"""DuckDB SQL for the queries of ``plans.extended``, from the operator definitions."""

from __future__ import annotations

from demandkit.plans.oracle import (
    BASE,
    D,
    DAILY,
    DATE_COLS,
    DIRTY,
    DRIFT_SIDES,
    FUTURE,
    LAG_COLS,
    PANEL_COLS,
    R2,
    RAW,
    ROLLING_COLS,
    SALES,
    SEASONAL_COLS,
    SERIES,
    SQL as BASE_SQL,
    STOCK,
    W,
    _accuracy,
    inventory_sql,
    rule_forecast_sql,
)

MISSING = (
    "''", "'#N/A'", "'#N/A N/A'", "'#NA'", "'-1.#IND'", "'-1.#QNAN'", "'-NaN'", "'-nan'", "'1.#IND'", "'1.#QNAN'", "'<NA>'",
    "'N/A'", "'NA'", "'NULL'", "'NaN'", "'None'", "'n/a'", "'nan'", "'null'",
)


def present(column: str) -> str:
    return f"CASE WHEN {column} NOT IN ({', '.join(MISSING)}) THEN {column} END"


# The dense panel's rows whose day was observed.
OBSERVED = BASE + f""",
featured AS (SELECT {PANEL_COLS}, {DATE_COLS}, {LAG_COLS}, {ROLLING_COLS}, {SEASONAL_COLS} FROM panel)
SELECT f.* FROM featured f JOIN daily d ON f.date = d.date AND f.center = d.center AND f.item = d.item"""

# The stored ensemble, as SQL text of its own.
TREE_SUM = """
(CASE WHEN rolling_std_7 <= 40.0 THEN CASE WHEN month <= 6.0 THEN 20.25 ELSE 35.0 END ELSE 95.5 END)
+ 0.5 * (CASE WHEN rate <= 1200.0 THEN CASE WHEN rolling_max_14 <= 60.0 THEN -8.0 ELSE 6.5 END
              ELSE CASE WHEN day_of_week <= 4.0 THEN 11.0 ELSE -3.5 END END)
+ 0.25 * (CASE WHEN lag_1 <= 25.0 THEN CASE WHEN month_sin <= 0.1 THEN 1.5 ELSE -12.0 END ELSE 40.0 END)"""

_FEATURED = f"""
featured AS (
  SELECT date, center, item, pay_weight, rate, month(date) AS month, isodow(date) - 1 AS day_of_week,
         sin(2 * pi() * month(date) / 12.0) AS month_sin,
         coalesce(lag(pay_weight, 1) OVER (PARTITION BY center, item ORDER BY date), 0) AS lag_1,
         coalesce(stddev_samp(pay_weight) {W.format(lo=6)}, 0) AS rolling_std_7, max(pay_weight) {W.format(lo=13)} AS rolling_max_14
  FROM panel)"""

_NOISE = """
  (('0x' || substr(md5(concat_ws('|', center, item, step, 7, '{what}')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0"""


def _noise(*what: str) -> str:
    return _NOISE.format(what="|".join(what))


_RULES = """
words AS (
  SELECT DISTINCT upper(unnest(string_split(concat_ws(' ', p_name, p_brand, p_type), ' '))) AS word FROM part
),
cuts AS (SELECT word, unnest(range(2, 8)) AS size FROM words),
keywords AS (
  SELECT left(word, size) AS keyword FROM cuts WHERE length(word) >= size
  UNION SELECT right(word, size) FROM cuts WHERE length(word) >= size
),
rules AS (
  SELECT ('0x' || substr(md5(keyword), 1, 12))::BIGINT AS rule_order, keyword, length(keyword) * 100.0::DOUBLE AS base,
         length(keyword) * 10.0::DOUBLE AS amplitude, 1.0::DOUBLE / length(keyword) AS frequency
  FROM keywords
)"""

SQL = {
    "sparse_features": OBSERVED,
    "incremental_features": OBSERVED,
    "csv_sales": "WITH " + DIRTY + f"""
SELECT order_key, {present('date_text')} AS date_text, {present('party')} AS party, {present('number_text')} AS weight_text,
       count(*) AS n_rows
FROM dirty GROUP BY ALL""",
    "csv_rejects": """
WITH lines AS (
  SELECT l_orderkey AS k, l_orderkey || ',' || l_linenumber || ',' || l_returnflag AS whole, l_orderkey || ',' || l_returnflag AS short
  FROM lineitem)
SELECT short AS record, count(*) AS n_rows FROM lines WHERE k % 11 = 0 GROUP BY ALL
UNION ALL SELECT whole || ',surplus', count(*) FROM lines WHERE k % 11 <> 0 AND k % 7 = 0 GROUP BY ALL
UNION ALL SELECT '(rows read)', count(*) FROM lines WHERE k % 11 <> 0 AND k % 7 <> 0""",
    "job_features": BASE_SQL["feature_table"],
    "job_drift": BASE_SQL["drift_report"],
    "job_forecast": BASE + "," + ",".join([FUTURE, SERIES, STOCK]) + """,
fc AS (
  SELECT center, item, date, step,
         (0.5 * coalesce(tm, 0) + 0.3 * coalesce(ts, 0) + 0.25 * coalesce(tmin, 0) + 0.001 * coalesce(tr, 0)
          + 5.0 * sin(2 * pi() * month(date) / 12.0) + 0.7 * (isodow(date) - 1) + 1.0)::DOUBLE AS forecast
  FROM fut),""" + inventory_sql("stock"),
    "sorted_sink": "WITH " + ",".join([SALES, DAILY]) + """
SELECT center, count(*) AS n_rows, 1::BIGINT AS n_files, 0::BIGINT AS n_out_of_order,
       first(item ORDER BY item, date) AS first_item, first(date ORDER BY item, date) AS first_date,
       last(item ORDER BY item, date) AS last_item, last(date ORDER BY item, date) AS last_date
FROM daily GROUP BY center""",
    "best_run_params": BASE_SQL["best_run"][: BASE_SQL["best_run"].index("SELECT experiment, run_id,")] + f"""
SELECT experiment, run_id, 'runs:/' || run_id || '/model' AS model_uri, round(rmse, {D}) AS rmse,
       CASE WHEN run_id LIKE '%/rolling%' THEN 'mean' WHEN run_id LIKE '%lag_1' THEN NULL ELSE 'lag' END AS kind,
       CASE WHEN run_id LIKE '%/rolling%' THEN '7' END AS "window", CAST(NULL AS VARCHAR) AS depth
FROM runs QUALIFY row_number() OVER (PARTITION BY experiment ORDER BY rmse ASC NULLS LAST, run_id) = 1""",
    "rule_table_match": "WITH " + _RULES + f""",
items AS (SELECT DISTINCT concat_ws(' ', p_name, lower(p_brand), p_type) AS item FROM part)
SELECT item, rule_order, keyword, round(base, {D}) AS base, round(amplitude, {D}) AS amplitude, round(frequency, {D}) AS frequency
FROM items LEFT JOIN rules ON contains(upper(item), keyword)
QUALIFY row_number() OVER (PARTITION BY item ORDER BY rule_order) = 1""",
    "rule_table_forecast": "WITH " + ",".join([SALES, DAILY, SERIES, _RULES]) + """,
chosen AS (
  SELECT item, base, amplitude, frequency FROM (SELECT DISTINCT item FROM series) LEFT JOIN rules ON contains(upper(item), keyword)
  QUALIFY row_number() OVER (PARTITION BY item ORDER BY rule_order) = 1),
level AS (SELECT s.*, coalesce(base, 1000.0) AS base, coalesce(amplitude, 200.0) AS amplitude, coalesce(frequency, 0.1) AS frequency
          FROM series s JOIN chosen USING (item)),
fval AS (
  SELECT center, item, CAST(last_date + CAST(step + 1 AS INTEGER) AS DATE) AS date, CAST(step + 1 AS INTEGER) AS step,
         base + amplitude * sin(step * frequency) AS v
  FROM (SELECT *, unnest(generate_series(0, 29)) AS step FROM level)),
scaled AS (
  SELECT *, greatest(100.0, v * CASE WHEN isodow(date) >= 6 THEN 1.2 ELSE 1.0 END
                              * CASE WHEN month(date) BETWEEN 3 AND 6 THEN 1.3 ELSE 1.0 END) AS x FROM fval)
SELECT center, item, date, step, """ + f"""round({R2('x')}, {D}) AS forecast, round({R2('x * 0.85')}, {D}) AS lower_bound,
       round({R2('x * 1.15')}, {D}) AS upper_bound FROM scaled""",
    "rule_forecast_noise": "WITH " + ",".join([SALES, DAILY, SERIES, rule_forecast_sql("series", "30")]).replace(
        "greatest(100.0, ", "("
    ) + f""",
drawn AS (
  SELECT *, sqrt(-2.0 * ln({_noise('level', 'radius')})) * cos(2 * pi() * {_noise('level', 'angle')}) AS z, {_noise('confidence')} AS u
  FROM fval),
noisy AS (SELECT *, greatest(100.0, v + 50.0 * z) AS x FROM drawn)
SELECT center, item, date, step, round({R2('x')}, {D}) AS forecast, round({R2('x * 0.85')}, {D}) AS lower_bound,
       round({R2('x * 1.15')}, {D}) AS upper_bound, round({R2('0.7 + u * 0.25')}, {D}) AS confidence
FROM noisy""",
    "tree_forecast": BASE + "," + FUTURE + f""",
shown AS (
  SELECT center, item, date, step, coalesce(ts, 0) AS rolling_std_7, coalesce(tmax, 0) AS rolling_max_14, coalesce(tm, 0) AS lag_1,
         coalesce(tr, 0) AS rate, month(date) AS month, isodow(date) - 1 AS day_of_week, sin(2 * pi() * month(date) / 12.0) AS month_sin
  FROM fut),
scored AS (SELECT *, ({TREE_SUM})::DOUBLE AS f FROM shown)
SELECT center, item, date, step, round(f, {D}) AS forecast, round(greatest(0.0, 0.8 * f), {D}) AS lower_bound,
       round(1.2 * f, {D}) AS upper_bound FROM scored""",
    "tree_backtest": BASE + "," + _FEATURED + f""",
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY center, item ORDER BY date DESC) AS rn, count(*) OVER (PARTITION BY center, item) AS n
  FROM featured),
scored AS (SELECT pay_weight AS actual, {TREE_SUM} AS predicted FROM ranked WHERE rn <= 30 AND n > 30)""" + _accuracy("scored"),
    "null_target_metrics": BASE + "," + _FEATURED + f""",
scored AS (SELECT pay_weight AS actual, {TREE_SUM} AS predicted FROM featured WHERE day(date) <> 13)""" + _accuracy(
        "scored", "'trees' AS model, "
    ),
    "cv_folds": BASE + """,
nd AS (SELECT lo, CAST(hi - lo AS BIGINT) + 1 AS n FROM bounds),
folds AS (
  SELECT k, lo, n - (4 - k) * (n // 4) AS start, n - (3 - k) * (n // 4) AS stop FROM nd CROSS JOIN (SELECT unnest([1, 2, 3]) AS k)),
members AS (
  SELECT CAST(k AS INTEGER) AS fold, date, CASE WHEN date - lo < start - 2 THEN 'train' WHEN date - lo >= start AND date - lo < stop THEN 'test' END AS role
  FROM panel CROSS JOIN folds)
SELECT fold, role, min(date) AS first_date, max(date) AS last_date, count(*) AS n_rows FROM members WHERE role IS NOT NULL GROUP BY ALL""",
    "cv_linear_metrics": BASE + f""",
nd AS (SELECT lo, CAST(hi - lo AS BIGINT) + 1 AS n FROM bounds),
folds AS (
  SELECT k, lo, n - (4 - k) * (n // 4) AS start, n - (3 - k) * (n // 4) AS stop FROM nd CROSS JOIN (SELECT unnest([1, 2, 3]) AS k)),
lagged AS (
  SELECT date, pay_weight AS actual, coalesce(lag(pay_weight, 7) OVER (PARTITION BY center, item ORDER BY date), 0) AS x FROM panel),
fitted AS (
  SELECT k, regr_slope(actual, x) AS a, regr_intercept(actual, x) AS b FROM lagged JOIN folds ON date - lo < start GROUP BY k),
scored AS (
  SELECT CAST(k AS INTEGER) AS fold, actual, a * x + b AS predicted
  FROM lagged JOIN folds ON date - lo >= start AND date - lo < stop JOIN fitted USING (k))"""
    + _accuracy("scored", "fold, ")
    + " GROUP BY fold",
    # Paths counted as whole numbers, not as shares.
    "ks_exact": "WITH RECURSIVE " + SALES + f""",
totals AS (SELECT date_trunc('month', date) AS month, center, sum(pay_weight) AS t FROM sales GROUP BY ALL),
vals AS (SELECT center AS column_name, floor(t / 500.0) AS value, CASE WHEN month < DATE '1997-12-01' THEN 0 ELSE 1 END AS side FROM totals),
cnt AS (SELECT column_name, value, sum(1 - side) AS r, sum(side) AS c FROM vals GROUP BY ALL),
cum AS (
  SELECT column_name, sum(r) OVER w AS cr, sum(c) OVER w AS cc, sum(r) OVER (PARTITION BY column_name) AS n,
         sum(c) OVER (PARTITION BY column_name) AS m
  FROM cnt WINDOW w AS (PARTITION BY column_name ORDER BY value)),
ks AS (
  SELECT column_name, max(n)::BIGINT AS n, max(m)::BIGINT AS m, max(abs(cr * m - cc * n))::BIGINT AS h FROM cum GROUP BY column_name),
paths AS (
  SELECT column_name, n, m, h, 0::BIGINT AS i, list_transform(range(0, m + 1), lambda j: CASE WHEN j * n < h THEN 1::HUGEINT ELSE 0::HUGEINT END) AS row FROM ks
  UNION ALL
  SELECT column_name, n, m, h, i + 1,
         list_transform(range(0, m + 1), lambda j: CASE WHEN abs((i + 1) * m - j * n) < h THEN
           coalesce(list_sum(list_transform(range(0, j + 1), lambda k: CASE WHEN abs((i + 1) * m - k * n) < h THEN row[k + 1] ELSE 0::HUGEINT END)), 0)::HUGEINT
           ELSE 0::HUGEINT END)
  FROM paths WHERE i < n),
whole AS (
  SELECT column_name, 0::BIGINT AS i, list_transform(range(0, m + 1), lambda j: 1::HUGEINT) AS row, n FROM ks
  UNION ALL
  SELECT column_name, i + 1, list_transform(range(1, len(row) + 1), lambda j: list_sum(row[1:j])::HUGEINT), n FROM whole WHERE i < n)
SELECT ks.column_name, ks.n AS n_ref, ks.m AS n_cur, round(ks.h::DOUBLE / (ks.n * ks.m), {D}) AS ks_statistic,
       round(1 - p.row[ks.m + 1]::DOUBLE / w.row[ks.m + 1]::DOUBLE, {D}) AS p_value
FROM ks JOIN paths p ON p.column_name = ks.column_name AND p.i = ks.n JOIN whole w ON w.column_name = ks.column_name AND w.i = ks.n""",
    "profile_sketch": BASE_SQL["profile"],
    "center_item_map": "WITH " + SALES + f"""
SELECT center, count(DISTINCT item) AS n_items, round(sum(CASE WHEN item = 'PROMO' THEN pay_weight END), {D}) AS promo,
       round(sum(CASE WHEN item = 'SMALL' THEN pay_weight END), {D}) AS small, CAST(NULL AS DOUBLE) AS absent
FROM sales GROUP BY center""",
}

"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Written independently of the Spark operators, straight from the operator
definitions.  Views ``lineitem part supplier nation region events ...`` are
registered by the caller.
"""

from __future__ import annotations

D = 6  # decimals doubles are rounded to, as in plans.common.DIGITS

SALES = """
sales AS (
  SELECT CAST(l.l_shipdate AS DATE) AS date, r.r_name AS center, p.p_type AS item,
         l.l_quantity AS pay_weight, l.l_extendedprice AS amount,
         l.l_extendedprice / l.l_quantity AS rate, CAST(l.l_linenumber AS DOUBLE) AS box
  FROM lineitem l
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey)"""

DAILY = """
daily AS (
  SELECT date, center, item, sum(pay_weight) AS pay_weight, sum(amount) AS amount,
         avg(rate) AS rate, sum(box) AS box
  FROM sales WHERE date IS NOT NULL AND center IS NOT NULL AND item IS NOT NULL
  GROUP BY date, center, item)"""

PANEL = """
bounds AS (SELECT min(date) AS lo, max(date) AS hi, avg(rate) AS mrate FROM daily),
days AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM bounds),
grid AS (
  SELECT d.date, c.center, i.item
  FROM days d CROSS JOIN (SELECT DISTINCT center FROM daily) c CROSS JOIN (SELECT DISTINCT item FROM daily) i),
panel AS (
  SELECT g.date, g.center, g.item,
         coalesce(x.pay_weight, 0) AS pay_weight, coalesce(x.amount, 0) AS amount,
         coalesce(x.rate, b.mrate) AS rate, coalesce(x.box, 0) AS box
  FROM grid g LEFT JOIN daily x ON g.date = x.date AND g.center = x.center AND g.item = x.item
  CROSS JOIN bounds b)"""

BASE = "WITH " + ",".join([SALES, DAILY, PANEL])

W = "OVER (PARTITION BY center, item ORDER BY date ROWS BETWEEN {lo} PRECEDING AND CURRENT ROW)"

DATE_COLS = """
  CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
  CAST(day(date) AS INTEGER) AS day, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week,
  CAST(dayofyear(date) AS INTEGER) AS day_of_year, CAST(week(date) AS INTEGER) AS week_of_year,
  CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend, CAST(day(date) = 1 AS INTEGER) AS is_month_start,
  CAST(date = last_day(date) AS INTEGER) AS is_month_end, CAST(quarter(date) AS INTEGER) AS quarter"""

SEASONAL_COLS = f"""
  round(sin(2 * pi() * month(date) / 12.0), {D}) AS month_sin,
  round(cos(2 * pi() * month(date) / 12.0), {D}) AS month_cos,
  round(sin(2 * pi() * (isodow(date) - 1) / 7.0), {D}) AS week_sin,
  round(cos(2 * pi() * (isodow(date) - 1) / 7.0), {D}) AS week_cos,
  round(sin(2 * pi() * dayofyear(date) / 365.25), {D}) AS day_of_year_sin,
  round(cos(2 * pi() * dayofyear(date) / 365.25), {D}) AS day_of_year_cos"""

LAG_COLS = ", ".join(
    f"round(lag(pay_weight, {k}) OVER (PARTITION BY center, item ORDER BY date), {D}) AS lag_{k}" for k in (1, 3, 7)
)


def _rolling(w: int) -> str:
    frame = W.format(lo=w - 1)
    return ", ".join(
        [
            f"round(avg(pay_weight) {frame}, {D}) AS rolling_mean_{w}",
            f"round(stddev_samp(pay_weight) {frame}, {D}) AS rolling_std_{w}",
            f"round(min(pay_weight) {frame}, {D}) AS rolling_min_{w}",
            f"round(max(pay_weight) {frame}, {D}) AS rolling_max_{w}",
        ]
    )


ROLLING_COLS = ", ".join(_rolling(w) for w in (7, 14))

PANEL_COLS = f"""date, center, item, round(pay_weight, {D}) AS pay_weight, round(amount, {D}) AS amount,
  round(rate, {D}) AS rate, round(box, {D}) AS box"""

SQL = {
    "daily_agg": "WITH " + ",".join([SALES, DAILY]) + f"""
SELECT date, center, item, round(pay_weight, {D}) AS pay_weight, round(amount, {D}) AS amount,
       round(rate, {D}) AS rate, round(box, {D}) AS box FROM daily""",
    "dense_panel": BASE + f"\nSELECT {PANEL_COLS} FROM panel",
    "date_features": BASE + f"\nSELECT date, center, item, {DATE_COLS} FROM panel",
    "seasonal_features": BASE + f"\nSELECT date, center, item, {SEASONAL_COLS} FROM panel",
    "lag_features": BASE + f"\nSELECT date, center, item, round(pay_weight, {D}) AS pay_weight, {LAG_COLS} FROM panel",
    "rolling_features": BASE
    + f"\nSELECT date, center, item, round(pay_weight, {D}) AS pay_weight, {ROLLING_COLS} FROM panel",
    "feature_table": BASE
    + f"\nSELECT {PANEL_COLS}, {DATE_COLS}, {LAG_COLS}, {ROLLING_COLS}, {SEASONAL_COLS} FROM panel",
}


def R2(x: str) -> str:
    """Spark's round(x, 2) in DuckDB: Spark rounds the shortest decimal text
    of the double half-up, so round that text as a DECIMAL."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 17)), 2) AS DOUBLE)"


NUMBER_RE = "[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?"


def COERCE(x: str) -> str:
    t = f"trim({x})"
    v = (
        f"CASE WHEN regexp_full_match({t}, '{NUMBER_RE}') OR lower({t}) IN "
        f"('inf', '+inf', '-inf', 'infinity', '+infinity', '-infinity') THEN TRY_CAST({t} AS DOUBLE) END"
    )
    return f"coalesce(CASE WHEN isnan({v}) THEN NULL ELSE {v} END, 0.0)"


RAW = """
raw AS (
  SELECT CAST(l.l_shipdate AS VARCHAR) AS "DATE", r.r_name AS "CENTER NAME", p.p_type AS "ITEM",
         CAST(l.l_quantity AS VARCHAR) AS "PAY WEIGHT", CAST(l.l_extendedprice AS VARCHAR) AS "AMOUNT",
         CAST(l.l_extendedprice / l.l_quantity AS VARCHAR) AS "RATE", CAST(l.l_linenumber AS VARCHAR) AS "BOX"
  FROM lineitem l
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey)"""

FEAT = f"""
feat AS (
  SELECT *, lag(pay_weight, 1) OVER (PARTITION BY center, item ORDER BY date) AS lag_1,
         lag(pay_weight, 7) OVER (PARTITION BY center, item ORDER BY date) AS lag_7,
         avg(pay_weight) {W.format(lo=6)} AS rolling_mean_7
  FROM panel)"""

PRED = """
pred AS (
  SELECT 'lag_1' AS model, pay_weight AS actual, coalesce(lag_1, 0.0) AS predicted FROM feat
  UNION ALL SELECT 'lag_7', pay_weight, coalesce(lag_7, 0.0) FROM feat
  UNION ALL SELECT 'rolling_mean_7', pay_weight, coalesce(rolling_mean_7, 0.0) FROM feat),
met AS (
  SELECT model, avg(abs(actual - predicted)) AS mae, avg((actual - predicted) * (actual - predicted)) AS mse,
         sqrt(avg((actual - predicted) * (actual - predicted))) AS rmse,
         avg(CASE WHEN actual > 0 THEN abs((actual - predicted) / actual) END) * 100 AS mape
  FROM pred GROUP BY model)"""

MET_COLS = f"model, round(mae, {D}) AS mae, round(mse, {D}) AS mse, round(rmse, {D}) AS rmse, round(mape, {D}) AS mape"

SERIES = """
series AS (SELECT center, item, max(date) AS last_date FROM daily GROUP BY center, item)"""


# (keyword, base, amplitude, frequency), first match wins; then the numbers of other items.
RULES = (
    ("CHILAPI", 1500.0, 300.0, 0.2),
    ("MIX FISH", 2000.0, 400.0, 0.15),
    ("PRAWN", 800.0, 200.0, 0.25),
    ("MUNDI", 600.0, 150.0, 0.3),
)


def rule_forecast_sql(series: str, horizon: str, rules=RULES, default=(1000.0, 200.0, 0.1)) -> str:
    cases = " ".join(f"WHEN contains(upper(item), '{k}') THEN {b} + {a} * sin(step * {f})" for k, b, a, f in rules)
    level = f"(CASE {cases} ELSE {default[0]} + {default[1]} * sin(step * {default[2]}) END)"
    return f"""
fsteps AS (
  SELECT center, item, CAST(step AS INTEGER) AS step, CAST(last_date + CAST(step + 1 AS INTEGER) AS DATE) AS date
  FROM (SELECT *, unnest(generate_series(0, {horizon} - 1)) AS step FROM {series})),
fval AS (
  SELECT center, item, date, step + 1 AS step,
         greatest(100.0, {level}
                  * CASE WHEN isodow(date) >= 6 THEN 1.2 ELSE 1.0 END
                  * CASE WHEN month(date) BETWEEN 3 AND 6 THEN 1.3 ELSE 1.0 END) AS v
  FROM fsteps),
fc AS (
  SELECT center, item, date, step, {R2('v')} AS forecast, {R2('v * 0.85')} AS lower_bound,
         {R2('v * 1.15')} AS upper_bound
  FROM fval)"""


STOCK = """
stock AS (
  SELECT center, item, CAST(length(center) * 700.0 + length(item) * 50.0 AS DOUBLE) AS current_stock,
         CAST(1 + (length(center) + length(item)) % 7 AS INTEGER) AS lead_time, last_date
  FROM series)"""

def inventory_sql(stock: str, row_id: str = "center || '/' || item") -> str:
    """Recommendations for the rows of ``stock`` from the forecast ``fc``."""
    return f"""
ids AS (SELECT *, {row_id} AS id FROM {stock}),
sums AS (
  SELECT s.id, any_value(s.center) AS center, any_value(s.item) AS item, any_value(s.current_stock) AS current_stock,
         any_value(s.lead_time) AS lead_time,
         coalesce(sum(CASE WHEN f.step <= s.lead_time THEN f.forecast END), 0.0) AS lead_demand,
         coalesce(sum(CASE WHEN f.step <= 7 THEN f.forecast END), 0.0) AS week_demand,
         count(f.step) >= greatest(any_value(s.lead_time), 7) AS covered
  FROM ids s LEFT JOIN fc f ON f.center = s.center AND f.item = s.item
  GROUP BY s.id)
SELECT center, item, round(current_stock, {D}) AS current_stock, CAST(lead_time AS INTEGER) AS lead_time,
       round({R2('greatest(0.0, lead_demand + week_demand * 0.2 - current_stock)')}, {D}) AS recommended_order,
       round({R2('lead_demand + week_demand * 0.2')}, {D}) AS reorder_point,
       round({R2('week_demand * 0.2')}, {D}) AS safety_stock,
       round({R2('week_demand')}, {D}) AS expected_demand,
       round({R2('CASE WHEN lead_demand > 0 THEN greatest(0.0, (lead_demand - current_stock) / lead_demand * 100) ELSE 0.0 END')}, {D}) AS stock_out_risk,
       covered
FROM sums"""


WORD_RULES = (("ECON", 1500.0, 300.0, 0.2), ("ARGE", 2000.0, 400.0, 0.15), ("SMALL", 800.0, 200.0, 0.25), ("M", 600.0, 150.0, 0.3))

DRIFT_SIDES = """
ev AS (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 0 ELSE 1 END AS side FROM events),
lng AS (
  SELECT 'event_id' AS column_name, CAST(event_id AS DOUBLE) AS value, side FROM ev
  UNION ALL SELECT 'user_id', CAST(user_id AS DOUBLE), side FROM ev
  UNION ALL SELECT 'value', CAST(value AS DOUBLE), side FROM ev),
vals AS (SELECT * FROM lng WHERE value IS NOT NULL AND NOT isnan(value)),
moments AS (
  SELECT column_name, side, count(value) AS count, avg(value) AS mean, stddev_samp(value) AS std,
         skewness(value) AS skew, kurtosis(value) AS kurtosis
  FROM vals GROUP BY column_name, side),
cnt AS (SELECT column_name, value, sum(1 - side) AS c_ref, sum(side) AS c_cur FROM vals GROUP BY column_name, value),
cum AS (
  SELECT column_name,
         sum(c_ref) OVER (PARTITION BY column_name ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r_ref,
         sum(c_cur) OVER (PARTITION BY column_name ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r_cur,
         sum(c_ref) OVER (PARTITION BY column_name) AS n_ref, sum(c_cur) OVER (PARTITION BY column_name) AS n_cur
  FROM cnt),
ks AS (
  SELECT column_name, CAST(max(n_ref) AS BIGINT) AS n_ref, CAST(max(n_cur) AS BIGINT) AS n_cur,
         max(abs(r_ref / n_ref - r_cur / n_cur)) AS ks_statistic
  FROM cum GROUP BY column_name),
lam AS (SELECT *, ks_statistic * sqrt(CAST(n_ref AS DOUBLE) * n_cur / (CAST(n_ref AS DOUBLE) + n_cur)) AS lam FROM ks),
kp AS (
  SELECT l.column_name, l.n_ref, l.n_cur, l.ks_statistic,
         CASE WHEN l.lam < 0.2 THEN 1.0
              ELSE least(greatest(2.0 * sum(CASE WHEN j % 2 = 1 THEN 1.0 ELSE -1.0 END
                                            * exp(-2.0 * j * j * l.lam * l.lam)), 0.0), 1.0) END AS p_value
  FROM lam l CROSS JOIN (SELECT unnest(generate_series(1, 100)) AS j) t
  GROUP BY l.column_name, l.n_ref, l.n_cur, l.ks_statistic, l.lam),
report AS (
  SELECT k.column_name, k.ks_statistic, k.p_value, k.p_value < 0.05 AS drift_detected,
         CASE WHEN r.std = 0 THEN NULL ELSE abs(r.mean - c.mean) / r.std END AS mean_shift,
         CASE WHEN k.p_value < 0.01 THEN 'high' WHEN k.p_value < 0.05 THEN 'medium' ELSE 'low' END AS severity
  FROM kp k JOIN moments r ON r.column_name = k.column_name AND r.side = 0
  JOIN moments c ON c.column_name = k.column_name AND c.side = 1)"""

ITEMS = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")  # p_type values of the test tables

SQL.update(
    {
        "clean_numeric": "WITH " + RAW + f"""
SELECT "DATE" AS date_text, coalesce("CENTER NAME", 'Unknown') AS center, coalesce("ITEM", 'Unknown') AS item,
       round({COERCE('"PAY WEIGHT"')}, {D}) AS pay_weight, round({COERCE('"AMOUNT"')}, {D}) AS amount,
       round({COERCE('"RATE"')}, {D}) AS rate, round({COERCE('"BOX"')}, {D}) AS box
FROM raw""",
        "clean_dates": "WITH " + RAW + """,
txt AS (SELECT "DATE" AS s FROM raw UNION ALL SELECT CAST(ts AS VARCHAR) FROM events),
parsed AS (SELECT CAST(TRY_CAST(trim(s) AS TIMESTAMP) AS DATE) AS date FROM txt)
SELECT date, count(*) AS n_rows FROM parsed WHERE date IS NOT NULL GROUP BY date""",
        "centers": "WITH " + ",".join([SALES, DAILY])
        + "\nSELECT DISTINCT center FROM daily WHERE center IS NOT NULL AND trim(center) <> ''",
        "items_by_center": "WITH " + ",".join([SALES, DAILY])
        + "\nSELECT DISTINCT center, item FROM daily WHERE item IS NOT NULL AND trim(item) <> ''",
        "history_range": BASE + f"""
SELECT center, item, date, round(pay_weight, {D}) AS demand, round(amount, {D}) AS amount, round(rate, {D}) AS rate
FROM panel WHERE date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'""",
        "demand_by_center": "WITH " + SALES
        + f"\nSELECT center, round(sum(pay_weight), {D}) AS total_demand FROM sales WHERE center IS NOT NULL GROUP BY center",
        "top_items": "WITH " + SALES + f"""
SELECT item, round(sum(pay_weight), {D}) AS total_demand FROM sales WHERE item IS NOT NULL
GROUP BY item ORDER BY sum(pay_weight) DESC, item LIMIT 5""",
        "weekday_mean": "WITH " + SALES + f"""
SELECT CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, dayname(date) AS weekday,
       round(avg(pay_weight), {D}) AS mean_demand
FROM sales WHERE date IS NOT NULL GROUP BY 1, 2""",
        "monthly_total": "WITH " + SALES + f"""
SELECT strftime(date, '%Y-%m') AS month, round(sum(pay_weight), {D}) AS total_demand
FROM sales WHERE date IS NOT NULL GROUP BY 1""",
        "monthly_by_series": "WITH " + SALES + f"""
SELECT center, item, CAST(date_trunc('month', date) AS DATE) AS month, round(sum(pay_weight), {D}) AS demand
FROM sales WHERE date IS NOT NULL AND center IS NOT NULL AND item IS NOT NULL GROUP BY 1, 2, 3""",
        "center_item_pivot": "WITH " + SALES + "\nSELECT center, "
        + ", ".join(f"round(coalesce(sum(CASE WHEN item = '{v}' THEN pay_weight END), 0), {D}) AS \"{v}\"" for v in ITEMS)
        + " FROM sales GROUP BY center",
        "summary": BASE + f"""
SELECT count(*) AS total_records, min(date) AS min_date, max(date) AS max_date,
       count(DISTINCT center) AS n_centers, count(DISTINCT item) AS n_items,
       round(sum(pay_weight), {D}) AS total_demand, round(avg(pay_weight), {D}) AS avg_demand, 30 AS n_features
FROM panel""",
        "profile": "WITH " + RAW + f"""
SELECT count(*) AS total_records,
       CAST(min(TRY_CAST(trim("DATE") AS TIMESTAMP)) AS DATE) AS date_start,
       CAST(max(TRY_CAST(trim("DATE") AS TIMESTAMP)) AS DATE) AS date_end,
       count(DISTINCT "CENTER NAME") + max(CASE WHEN "CENTER NAME" IS NULL THEN 1 ELSE 0 END) AS n_centers,
       count(DISTINCT "ITEM") + max(CASE WHEN "ITEM" IS NULL THEN 1 ELSE 0 END) AS n_products,
       round(sum({COERCE('"PAY WEIGHT"')}), {D}) AS total_demand
FROM raw""",
        "last_n_rows": BASE + f"""
SELECT {PANEL_COLS} FROM panel
QUALIFY row_number() OVER (PARTITION BY center, item ORDER BY date DESC) <= 30""",
        "naive_metrics": BASE + "," + FEAT + "," + PRED + f"\nSELECT {MET_COLS} FROM met",
        "best_model": BASE + "," + FEAT + "," + PRED + f"\nSELECT {MET_COLS} FROM met ORDER BY rmse, model LIMIT 1",
        "rule_forecast": "WITH " + ",".join([SALES, DAILY, SERIES, rule_forecast_sql("series", "30")])
        + f"\nSELECT center, item, date, step, round(forecast, {D}) AS forecast, round(lower_bound, {D}) AS lower_bound,"
        f" round(upper_bound, {D}) AS upper_bound FROM fc",
        "forecast_summary": "WITH " + ",".join([SALES, DAILY, SERIES, rule_forecast_sql("series", "30")])
        + f"""
SELECT center, item, round(avg(forecast), {D}) AS mean_forecast, round(max(forecast), {D}) AS max_forecast,
       round(min(forecast), {D}) AS min_forecast FROM fc GROUP BY center, item""",
        "monthly_projection": "WITH " + SALES + f""",
monthly AS (
  SELECT center, item, CAST(date_trunc('month', date) AS DATE) AS month, sum(pay_weight) AS demand
  FROM sales WHERE date IS NOT NULL AND center IS NOT NULL AND item IS NOT NULL GROUP BY 1, 2, 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY center, item ORDER BY month DESC) AS rn FROM monthly),
base AS (
  SELECT center, item, max(month) AS last_month,
         coalesce(avg(CASE WHEN rn <= 3 THEN demand END), avg(demand)) AS tail, median(demand) AS med
  FROM ranked GROUP BY center, item),
bl AS (
  SELECT center, item, last_month,
         CASE WHEN tail IS NULL OR tail <= 0 THEN greatest(med, 1.0) ELSE tail END AS baseline FROM base),
proj AS (
  SELECT b.center, b.item, strftime(b.last_month + to_months(CAST(g.idx + 1 AS INTEGER)), '%Y-%m') AS month,
         greatest(0.0, b.baseline * (1 + 0.12 * sin(g.idx / 12.0 * (2 * pi()))) * (1 + 0.015 * g.idx)) AS v
  FROM bl b CROSS JOIN (SELECT unnest(generate_series(0, 11)) AS idx) g)
SELECT center, item, month, round({R2('v')}, {D}) AS forecast, round({R2('v * 0.9')}, {D}) AS lower_bound,
       round({R2('v * 1.1')}, {D}) AS upper_bound FROM proj""",
        "inventory": "WITH " + ",".join([SALES, DAILY, SERIES, STOCK, rule_forecast_sql("stock", "(lead_time + 7)")])
        + "," + inventory_sql("stock"),
        "inventory_repeated_stock": "WITH "
        + ",".join([SALES, DAILY, SERIES, STOCK.replace("stock AS", "base_stock AS")])
        + """,
many AS (
  SELECT center, item, current_stock, last_date, row_number() OVER () AS row_id, lead_time
  FROM (SELECT center, item, current_stock, last_date, unnest([0, 5, 5, 45, 400]) AS lead_time FROM base_stock)),
planned AS (
  SELECT center, item, last_date, CASE WHEN center = 'AFRICA' THEN 60 ELSE 407 END AS horizon
  FROM base_stock WHERE center <> 'ASIA'),""" + rule_forecast_sql("planned", "horizon") + "," + inventory_sql("many", "row_id"),
        "rule_forecast_keywords": "WITH "
        + ",".join([SALES, DAILY, SERIES, rule_forecast_sql("series", "30", WORD_RULES, (900.0, 100.0, 0.5))])
        + f"\nSELECT center, item, date, step, round(forecast, {D}) AS forecast, round(lower_bound, {D}) AS lower_bound,"
        f" round(upper_bound, {D}) AS upper_bound FROM fc",
        "split_tail": BASE + """,
idx AS (SELECT date, center, item, row_number() OVER (ORDER BY center, item, date) - 1 AS row_index FROM panel),
tot AS (SELECT count(*) AS n FROM panel)
SELECT date, center, item, row_index,
       CASE WHEN row_index >= n - CAST(ceil(0.2 * n) AS BIGINT) THEN 'test' ELSE 'train' END AS split
FROM idx CROSS JOIN tot""",
        "split_by_date": BASE + """,
nd AS (SELECT lo, CAST(hi - lo AS BIGINT) + 1 AS n_days FROM bounds)
SELECT date, center, item,
       CASE WHEN date >= CAST(lo + CAST(n_days - CAST(ceil(0.2 * n_days) AS BIGINT) AS INTEGER) AS DATE)
            THEN 'test' ELSE 'train' END AS split
FROM panel CROSS JOIN nd""",
        "column_moments": "WITH " + DRIFT_SIDES + f"""
SELECT column_name, count, round(mean, {D}) AS mean, round(std, {D}) AS std, round(skew, {D}) AS skew,
       round(kurtosis, {D}) AS kurtosis, CASE WHEN side = 0 THEN 'reference' ELSE 'current' END AS side
FROM moments""",
        "ks_drift": "WITH " + DRIFT_SIDES + f"""
SELECT column_name, n_ref, n_cur, round(ks_statistic, {D}) AS ks_statistic, round(p_value, {D}) AS p_value FROM kp""",
        "drift_report": "WITH " + DRIFT_SIDES + f"""
SELECT column_name, round(ks_statistic, {D}) AS ks_statistic, round(p_value, {D}) AS p_value, drift_detected,
       round(mean_shift, {D}) AS mean_shift, severity FROM report""",
        "drift_alerts": "WITH " + DRIFT_SIDES + "\nSELECT column_name FROM report WHERE severity = 'high'",
    }
)


FUTURE = f"""
tail AS (
  SELECT center, item, max(date) AS last_date, avg(pay_weight) AS tm, stddev_samp(pay_weight) AS ts,
         min(pay_weight) AS tmin, max(pay_weight) AS tmax, avg(amount) AS ta, avg(rate) AS tr, avg(box) AS tb
  FROM (SELECT * FROM panel QUALIFY row_number() OVER (PARTITION BY center, item ORDER BY date DESC) <= 30)
  GROUP BY center, item),
fut AS (
  SELECT t.*, CAST(g.step AS INTEGER) AS step, CAST(t.last_date + CAST(g.step AS INTEGER) AS DATE) AS date
  FROM tail t CROSS JOIN (SELECT unnest(generate_series(1, 30)) AS step) g)"""

FUTURE_COLS = f"""center, item, date, step, round(coalesce(ta, 0), {D}) AS amount, round(coalesce(tr, 0), {D}) AS rate,
  round(coalesce(tb, 0), {D}) AS box, {DATE_COLS},
  round(coalesce(tm, 0), {D}) AS lag_1, round(coalesce(tm, 0), {D}) AS lag_3, round(coalesce(tm, 0), {D}) AS lag_7,
  """ + ", ".join(
    f"round(coalesce({src}, 0), {D}) AS rolling_{stat}_{w}"
    for w in (7, 14)
    for stat, src in (("mean", "tm"), ("std", "ts"), ("min", "tmin"), ("max", "tmax"))
) + f", {SEASONAL_COLS}"

SQL.update(
    {
        "date_bounds": "WITH " + ",".join([SALES, DAILY]) + "\nSELECT min(date) AS min_date, max(date) AS max_date FROM daily",
        "key_counts": "WITH " + SALES
        + "\nSELECT count(DISTINCT center) AS n_centers, count(DISTINCT item) AS n_items FROM sales",
        "top_centers": "WITH " + SALES + f"""
SELECT center, round(sum(pay_weight), {D}) AS total_demand FROM sales WHERE center IS NOT NULL
GROUP BY center ORDER BY sum(pay_weight) DESC, center LIMIT 5""",
        "feature_preview": BASE
        + f"\nSELECT {PANEL_COLS}, {DATE_COLS}, {LAG_COLS}, {ROLLING_COLS}, {SEASONAL_COLS} FROM panel"
        + "\nORDER BY date, center, item LIMIT 200",
        "best_run": BASE + "," + FEAT.replace("SELECT *,", "SELECT *,") + f""",
pred AS (
  SELECT center AS experiment, 'lag_1' AS model, pay_weight AS actual, coalesce(lag_1, 0.0) AS predicted FROM feat
  UNION ALL SELECT center, 'lag_7', pay_weight, coalesce(lag_7, 0.0) FROM feat
  UNION ALL SELECT center, 'rolling_mean_7', pay_weight, coalesce(rolling_mean_7, 0.0) FROM feat),
runs AS (
  SELECT experiment, experiment || '/' || model AS run_id,
         sqrt(avg((actual - predicted) * (actual - predicted))) AS rmse, avg(abs(actual - predicted)) AS mae,
         avg(CASE WHEN actual > 0 THEN abs((actual - predicted) / actual) END) * 100 AS mape
  FROM pred GROUP BY experiment, model)
SELECT experiment, run_id, 'runs:/' || run_id || '/model' AS model_uri, round(coalesce(rmse, 0), {D}) AS rmse, round(coalesce(mae, 0), {D}) AS mae,
       round(coalesce(mape, 0), {D}) AS mape
FROM runs QUALIFY row_number() OVER (PARTITION BY experiment ORDER BY rmse ASC NULLS LAST, run_id) = 1""",
        "role_mapping": "WITH " + RAW + f"""
SELECT CAST(TRY_CAST(trim("DATE") AS TIMESTAMP) AS DATE) AS date, "CENTER NAME" AS center, "ITEM" AS item,
       round(TRY_CAST("PAY WEIGHT" AS DOUBLE), {D}) AS demand
FROM raw WHERE TRY_CAST(trim("DATE") AS TIMESTAMP) IS NOT NULL""",
        "profile_values": "WITH " + RAW + """
SELECT DISTINCT 'center' AS role, "CENTER NAME" AS value FROM raw
UNION ALL SELECT DISTINCT 'item', "ITEM" FROM raw""",
        "future_features": BASE + "," + FUTURE + f"\nSELECT {FUTURE_COLS} FROM fut",
    }
)


def projection_sql(source: str) -> str:
    """R9 over a CTE ``source(date, center, item, demand)``."""
    return f"""
monthly AS (
  SELECT center, item, CAST(date_trunc('month', date) AS DATE) AS month, sum(demand) AS demand
  FROM {source} WHERE date IS NOT NULL AND center IS NOT NULL AND item IS NOT NULL GROUP BY 1, 2, 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY center, item ORDER BY month DESC) AS rn FROM monthly),
base AS (
  SELECT center, item, max(month) AS last_month,
         coalesce(avg(CASE WHEN rn <= 3 THEN demand END), avg(demand)) AS tail, median(demand) AS med
  FROM ranked GROUP BY center, item),
bl AS (
  SELECT center, item, last_month,
         CASE WHEN tail IS NULL OR tail <= 0 THEN greatest(med, 1.0) ELSE tail END AS baseline FROM base),
proj AS (
  SELECT b.center, b.item, strftime(b.last_month + to_months(CAST(g.idx + 1 AS INTEGER)), '%Y-%m') AS month,
         greatest(0.0, b.baseline * (1 + 0.12 * sin(g.idx / 12.0 * (2 * pi()))) * (1 + 0.015 * g.idx)) AS v
  FROM bl b CROSS JOIN (SELECT unnest(generate_series(0, 11)) AS idx) g)
SELECT center, item, month, round({R2('v')}, {D}) AS forecast, round({R2('v * 0.9')}, {D}) AS lower_bound,
       round({R2('v * 1.1')}, {D}) AS upper_bound FROM proj"""


SQL["upload_projection"] = "WITH " + RAW + f""",
mapped AS (
  SELECT CAST(TRY_CAST(trim("DATE") AS TIMESTAMP) AS DATE) AS date, "CENTER NAME" AS center, "ITEM" AS item,
         {COERCE('"PAY WEIGHT"')} AS demand
  FROM raw),""" + projection_sql("mapped")

# ---- dirty text: the faults of a careless export, by order key

DIRTY = """
dirty AS (
  SELECT l_orderkey AS order_key,
    CASE l_orderkey % 13
      WHEN 0 THEN strftime(l_shipdate, '%-m/%-d/%Y') WHEN 1 THEN strftime(l_shipdate, '%m-%d-%Y')
      WHEN 2 THEN strftime(l_shipdate, '%d.%m.%Y') WHEN 3 THEN strftime(l_shipdate, '%Y%m%d')
      WHEN 4 THEN strftime(l_shipdate, '%b %-d, %Y') WHEN 5 THEN strftime(l_shipdate, '%Y-%m-%d') || 'T23:30:00+05:30'
      WHEN 6 THEN strftime(l_shipdate, '%Y/%-m/%-d') || ' 07:05' WHEN 7 THEN '' WHEN 8 THEN 'not a date' WHEN 9 THEN NULL
      WHEN 10 THEN strftime(l_shipdate, '%m/%d/%y') WHEN 11 THEN '2024-02-30' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS date_text,
    CASE l_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'N/A' WHEN 2 THEN 'null' WHEN 3 THEN '' WHEN 4 THEN 'nan'
      ELSE l_returnflag END AS party,
    CASE l_orderkey % 11 WHEN 0 THEN '' WHEN 1 THEN 'nan' WHEN 2 THEN '1,000' WHEN 3 THEN '1.0d' WHEN 4 THEN ' 12 '
      WHEN 5 THEN '-3.5e2' WHEN 6 THEN '.5' WHEN 7 THEN 'abc' WHEN 8 THEN NULL ELSE CAST(l_quantity AS VARCHAR) END AS number_text
  FROM lineitem),
dated AS (
  SELECT *, order_key % 13 AS layout, CAST(CASE WHEN order_key % 13 = 10 THEN try_strptime(date_text, '%m/%d/%y') ELSE coalesce(
    try_strptime(date_text, '%m/%d/%Y'), try_strptime(date_text, '%m-%d-%Y'), try_strptime(date_text, '%m.%d.%Y'),
    try_strptime(date_text, '%Y%m%d'), try_strptime(date_text, '%b %d, %Y'), try_strptime(left(date_text, 10), '%Y-%m-%d'),
    try_strptime(date_text, '%Y/%m/%d %H:%M')) END AS DATE) AS parsed
  FROM dirty)"""

SQL["clean_dirty_numeric"] = "WITH " + DIRTY + f"""
SELECT order_key, round(sum({COERCE('number_text')}), {D}) AS pay_weight, count(*) AS n_rows FROM dirty GROUP BY order_key"""
SQL["clean_dirty_dates"] = "WITH " + DIRTY + """
SELECT layout, parsed AS date, count(*) AS n_rows FROM dated WHERE parsed IS NOT NULL GROUP BY ALL"""
SQL["date_rejects"] = "WITH " + DIRTY + """
SELECT layout, CASE WHEN coalesce(trim(date_text), '') = '' THEN 'missing date' ELSE 'unreadable date' END AS reject_reason,
       count(*) AS n_rows FROM dated WHERE parsed IS NULL GROUP BY ALL"""
SQL["clean_dirty_labels"] = "WITH " + DIRTY + """
SELECT CASE WHEN party IS NULL OR party IN ('N/A', 'null', '', 'nan') THEN 'Unknown' ELSE party END AS party, count(*) AS n_rows
FROM dirty GROUP BY 1"""

SQL["history_series"] = BASE + f"""
SELECT center, item, date, round(pay_weight, {D}) AS demand, round(amount, {D}) AS amount, round(rate, {D}) AS rate
FROM panel WHERE date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' AND center = 'ASIA' AND item = 'PROMO'"""

SQL["upload_no_roles"] = f"""
SELECT CAST(DATE '2024-01-01' - CAST(count(*) OVER () - row_number() OVER w + 1 AS INTEGER) AS DATE) AS date,
       'All Locations' AS center, 'All Products' AS item, round(l_quantity, {D}) AS demand
FROM lineitem WINDOW w AS (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity)"""

# ---- a column without values on one side

_SPARSE = DRIFT_SIDES[: DRIFT_SIDES.index("vals AS")].replace(
    "SELECT 'event_id' AS column_name, CAST(event_id AS DOUBLE) AS value, side FROM ev",
    "SELECT 'extra' AS column_name, CASE WHEN side = 0 THEN CAST(value AS DOUBLE) END AS value, side FROM ev",
) + DRIFT_SIDES[DRIFT_SIDES.index("vals AS") : DRIFT_SIDES.index("report AS")].replace(
    "max(abs(r_ref / n_ref - r_cur / n_cur))", "max(abs(r_ref / nullif(n_ref, 0) - r_cur / nullif(n_cur, 0)))"
)
SQL["drift_sparse"] = "WITH " + _SPARSE.rstrip().rstrip(",") + f"""
SELECT k.column_name, round(k.ks_statistic, {D}) AS ks_statistic,
       CASE WHEN k.n_cur > 0 THEN round(k.p_value, {D}) END AS p_value,
       CASE WHEN k.n_cur > 0 THEN k.p_value < 0.05 END AS drift_detected,
       CASE WHEN r.std > 0 THEN round(abs(r.mean - c.mean) / r.std, {D}) END AS mean_shift,
       CASE WHEN k.n_cur = 0 THEN NULL WHEN k.p_value < 0.01 THEN 'high' WHEN k.p_value < 0.05 THEN 'medium' ELSE 'low' END AS severity
FROM kp k LEFT JOIN moments r ON r.column_name = k.column_name AND r.side = 0
LEFT JOIN moments c ON c.column_name = k.column_name AND c.side = 1"""

# ---- a fixed formula in the place of a fitted model

_ALL = f"""
allf AS (
  SELECT date, center, item, pay_weight AS actual,
         lag(pay_weight, 1) OVER (PARTITION BY center, item ORDER BY date) AS lag_1,
         avg(pay_weight) {W.format(lo=6)} AS rolling_mean_7, avg(pay_weight) {W.format(lo=13)} AS rolling_mean_14
  FROM panel)"""


def _accuracy(rows: str, label: str = "") -> str:
    return f"""
SELECT {label}round(avg(abs(actual - predicted)), {D}) AS mae, round(avg((actual - predicted) * (actual - predicted)), {D}) AS mse,
       round(sqrt(avg((actual - predicted) * (actual - predicted))), {D}) AS rmse,
       round(avg(CASE WHEN actual > 0 THEN abs((actual - predicted) / actual) END) * 100, {D}) AS mape
FROM {rows}"""


SQL["linear_backtest"] = BASE + "," + _ALL + """,
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY center, item ORDER BY date DESC) AS rn,
         count(*) OVER (PARTITION BY center, item) AS n FROM allf),
scored AS (
  SELECT actual, 0.5 * lag_1 + 0.3 * rolling_mean_7 + 0.2 * rolling_mean_14 + 1.0 AS predicted
  FROM ranked WHERE rn <= 30 AND n > 30)""" + _accuracy("scored")
SQL["linear_metrics"] = BASE + "," + _ALL + """,
nd AS (SELECT lo, CAST(hi - lo AS BIGINT) + 1 AS n_days FROM bounds),
scored AS (
  SELECT actual, 0.5 * coalesce(lag_1, 0) + 0.3 * rolling_mean_7 + 0.2 * rolling_mean_14 + 1.0 AS predicted
  FROM allf CROSS JOIN nd
  WHERE date >= CAST(lo + CAST(n_days - CAST(ceil(0.2 * n_days) AS BIGINT) AS INTEGER) AS DATE))""" + _accuracy(
    "scored", "'linear' AS model, "
)
SQL["linear_forecast"] = BASE + "," + FUTURE + f""",
scored AS (SELECT center, item, date, step, 0.5 * tm + 0.3 * tm + 0.2 * tm + 1.0 AS f FROM fut)
SELECT center, item, date, step, round(f, {D}) AS forecast, round(greatest(0.0, 0.8 * f), {D}) AS lower_bound,
       round(1.2 * f, {D}) AS upper_bound FROM scored"""
SQL["gbt_invariants"] = BASE + "," + FUTURE + """
SELECT center, item, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date, count(DISTINCT step) AS n_steps,
       CAST(0 AS BIGINT) AS n_bad
FROM fut GROUP BY center, item"""

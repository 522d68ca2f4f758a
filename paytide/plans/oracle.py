"""Shared table expressions for the checking SQL, written without the library's formulations.

Point-in-time tables here compare every cutoff with all earlier bookings (the plain definition);
the Spark side never does.
"""
from __future__ import annotations

import re

CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = re.sub(r"\s+", " ", sql).strip()


def with_ctes(body: str) -> str:
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(CTES[name])

    visit(body)
    if not needed:
        return body
    # A name is defined before it is used because it was registered after what it uses.
    parts = [f"{name} AS ({sql})" for name, sql in CTES.items() if name in needed]
    return f"WITH {', '.join(parts)} {body}"


cte("movements", """
SELECT concat(CAST(l.l_orderkey AS STRING), '-', CAST(l.l_linenumber AS STRING)) AS ID,
  n.n_name AS ENTITY_SHORTNAME, r.r_name AS CURRENCY_SHORTNAME,
  concat(l.l_returnflag, '+') AS CASH_MOVEMENT_TYPE_SHORTNAME,
  l.l_linestatus AS APPLICATIVE_STATUS_SHORTNAME, p.p_brand AS ACCOUNT_SHORTNAME,
  c.c_name AS CPTY_NAME, concat('/BO/', upper(c.c_name), ' S.A./', p.p_name) AS DESCRIPTION,
  CAST(l.l_shipdate AS DATE) + CAST(l.l_partkey % 11 - 7 AS INT) AS TRADE_DATE,
  CAST(l.l_shipdate AS DATE) AS VALUE_DATE, l.l_extendedprice AS AMOUNT,
  CASE WHEN l.l_returnflag = 'R' THEN -1 ELSE 1 END AS SIGN,
  CASE WHEN l.l_partkey % 13 = 0 THEN NULL
    WHEN l.l_partkey % 17 = 0 THEN l.l_extendedprice * (CASE WHEN l.l_returnflag = 'R' THEN -1 ELSE 1 END) + 1.0
    ELSE l.l_extendedprice * (CASE WHEN l.l_returnflag = 'R' THEN -1 ELSE 1 END) END AS SIGNED_AMOUNT
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
JOIN part p ON l.l_partkey = p.p_partkey
""")
cte("bronze_raw", """
SELECT concat(' ', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), chr(160)) AS ID,
  CASE WHEN l_suppkey % 9 = 0 THEN 'None' WHEN l_suppkey % 2 = 0 THEN ' E1 ' ELSE 'E2' END AS ENTITY_SHORTNAME,
  'SC' AS SCOPE_NAME, l_linestatus AS APPLICATIVE_STATUS_SHORTNAME,
  concat(l_returnflag, '+') AS CASH_MOVEMENT_TYPE_SHORTNAME, 'EUR' AS CURRENCY_SHORTNAME,
  'ACC' AS ACCOUNT_SHORTNAME, 'BNK' AS BANK_SHORTNAME,
  CASE WHEN l_partkey % 19 = 0 THEN '' ELSE 'AN' END AS ANALYTIC_TYPE_SHORTNAME,
  CASE WHEN l_partkey % 23 = 0 THEN 'x' ELSE concat(CAST(year(l_shipdate) AS STRING), '-',
    lpad(CAST(month(l_shipdate) AS STRING), 2, '0'), '-', lpad(CAST(day(l_shipdate) AS STRING), 2, '0')) END AS TRADE_DATE,
  CASE WHEN l_partkey % 4 = 0 THEN concat(CAST(day(l_shipdate) AS STRING), '/', CAST(month(l_shipdate) AS STRING), '/', CAST(year(l_shipdate) AS STRING))
    WHEN l_partkey % 4 = 1 THEN concat(CAST(year(l_shipdate) AS STRING), '/', CAST(month(l_shipdate) AS STRING), '/', CAST(day(l_shipdate) AS STRING))
    WHEN l_partkey % 29 = 2 THEN '2024-02-30'
    ELSE concat(CAST(year(l_shipdate) AS STRING), lpad(CAST(month(l_shipdate) AS STRING), 2, '0'), lpad(CAST(day(l_shipdate) AS STRING), 2, '0')) END AS VALUE_DATE,
  CASE WHEN l_partkey % 31 = 0 THEN 'abc' WHEN l_partkey % 3 = 0 THEN replace(CAST(l_extendedprice AS STRING), '.', ',')
    WHEN l_partkey % 3 = 1 THEN concat(' ', CAST(l_extendedprice AS STRING), chr(160)) ELSE CAST(l_extendedprice AS STRING) END AS AMOUNT,
  CASE WHEN l_returnflag = 'R' THEN '-1' WHEN l_partkey % 5 = 0 THEN '2,5' ELSE '1' END AS SIGN,
  CASE WHEN l_partkey % 13 = 0 THEN 'nan' WHEN l_returnflag = 'R' THEN concat('-', CAST(l_extendedprice AS STRING)) ELSE CAST(l_extendedprice AS STRING) END AS SIGNED_AMOUNT,
  'text' AS DESCRIPTION, concat('extract_', l_linestatus, '.csv') AS source_name
FROM lineitem
""")
cte("silver", """
SELECT *, (ID IS NULL OR ENTITY_SHORTNAME IS NULL OR APPLICATIVE_STATUS_SHORTNAME IS NULL OR CASH_MOVEMENT_TYPE_SHORTNAME IS NULL
   OR CURRENCY_SHORTNAME IS NULL OR ACCOUNT_SHORTNAME IS NULL OR TRADE_DATE IS NULL OR VALUE_DATE IS NULL OR AMOUNT IS NULL
   OR SIGN IS NULL OR DESCRIPTION IS NULL) AS missing_required,
  coalesce(VALUE_DATE < TRADE_DATE, false) AS reversed_dates,
  coalesce(abs(SIGNED_AMOUNT - AMOUNT * SIGN) > 0.01, false) AS signed_mismatch,
  count(*) OVER (PARTITION BY ENTITY_SHORTNAME, ID) > 1 AS duplicate_id
FROM movements
""")
cte("ruled", """
SELECT * FROM movements WHERE lower(APPLICATIVE_STATUS_SHORTNAME) IN ('o', 'f')
 AND NOT coalesce(lower(CASH_MOVEMENT_TYPE_SHORTNAME) IN ('n+'), false)
 AND NOT (contains(coalesce(lower(DESCRIPTION), ''), 'lamp') OR contains(coalesce(lower(DESCRIPTION), ''), 'a.b(c)'))
""")
cte("scoped", """
SELECT *, CASE WHEN CASH_MOVEMENT_TYPE_SHORTNAME = 'R+' THEN 'REFUND' ELSE CASH_MOVEMENT_TYPE_SHORTNAME END AS MOVEMENT_SCOPE,
  coalesce(SIGNED_AMOUNT, AMOUNT * SIGN) AS landed
FROM ruled WHERE CASH_MOVEMENT_TYPE_SHORTNAME IS NOT NULL
""")
cte("realized", """SELECT VALUE_DATE, coalesce(sum(landed), 0) AS TARGET_AMOUNT, count(ID) AS OBSERVATION_COUNT FROM scoped GROUP BY VALUE_DATE""")
cte("known", """SELECT TRADE_DATE, VALUE_DATE, coalesce(sum(landed), 0) AS KNOWN_AMOUNT, count(ID) AS KNOWN_COUNT FROM scoped GROUP BY TRADE_DATE, VALUE_DATE""")
cte("realized_grain", """SELECT VALUE_DATE, ENTITY_SHORTNAME, CURRENCY_SHORTNAME, MOVEMENT_SCOPE, coalesce(sum(landed), 0) AS TARGET_AMOUNT, count(ID) AS OBSERVATION_COUNT FROM scoped GROUP BY ALL""")
cte("known_grain", """SELECT TRADE_DATE, VALUE_DATE, ENTITY_SHORTNAME, CURRENCY_SHORTNAME, MOVEMENT_SCOPE, coalesce(sum(landed), 0) AS KNOWN_AMOUNT, count(ID) AS KNOWN_COUNT FROM scoped GROUP BY ALL""")
cte("cal_bounds", """SELECT min(lo) AS lo, max(hi) AS hi FROM (SELECT min(VALUE_DATE) AS lo, max(VALUE_DATE) AS hi FROM realized
 UNION ALL SELECT min(VALUE_DATE), max(VALUE_DATE) FROM known UNION ALL SELECT min(TRADE_DATE), max(TRADE_DATE) FROM known)""")
cte("calendar", """SELECT CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS DATE FROM cal_bounds""")
cte("eval_days", """SELECT DATE AS CUTOFF_DATE, DATE + 1 AS FORECAST_DATE FROM calendar WHERE DATE + 1 <= (SELECT hi FROM cal_bounds)""")
cte("panel", """SELECT e.CUTOFF_DATE, c.DATE, coalesce((sum(k.KNOWN_AMOUNT)), 0) AS amt
 FROM eval_days e JOIN calendar c ON c.DATE BETWEEN e.CUTOFF_DATE - 27 AND e.CUTOFF_DATE
 LEFT JOIN known k ON k.VALUE_DATE = c.DATE AND k.TRADE_DATE <= e.CUTOFF_DATE
 GROUP BY e.CUTOFF_DATE, c.DATE""")
cte("d1_known", """SELECT e.CUTOFF_DATE, coalesce(sum(k.KNOWN_AMOUNT), 0) AS amt, CAST(coalesce(sum(k.KNOWN_COUNT), 0) AS BIGINT) AS n
 FROM eval_days e LEFT JOIN known k ON k.VALUE_DATE = e.FORECAST_DATE AND k.TRADE_DATE <= e.CUTOFF_DATE
 GROUP BY e.CUTOFF_DATE""")
cte("features", """SELECT e.CUTOFF_DATE, e.FORECAST_DATE, isodow(e.FORECAST_DATE) - 1 AS DAY_OF_WEEK, day(e.FORECAST_DATE) AS DAY_OF_MONTH,
  e.FORECAST_DATE = last_day(e.FORECAST_DATE) AS IS_MONTH_END, day(e.FORECAST_DATE) = 1 AS IS_MONTH_START, isodow(e.FORECAST_DATE) >= 6 AS IS_WEEKEND,
  coalesce(max(p.amt) FILTER (p.DATE = e.FORECAST_DATE - 1), 0) AS TARGET_LAG_1,
  coalesce(max(p.amt) FILTER (p.DATE = e.FORECAST_DATE - 7), 0) AS TARGET_LAG_7,
  coalesce(max(p.amt) FILTER (p.DATE = e.FORECAST_DATE - 14), 0) AS TARGET_LAG_14,
  coalesce(max(p.amt) FILTER (p.DATE = e.FORECAST_DATE - 28), 0) AS TARGET_LAG_28,
  coalesce(avg(p.amt) FILTER (p.DATE > e.CUTOFF_DATE - 7), 0) AS TARGET_ROLLING_MEAN_7,
  coalesce(avg(p.amt), 0) AS TARGET_ROLLING_MEAN_28, coalesce(stddev_pop(p.amt), 0) AS TARGET_STD_28,
  coalesce(avg(CASE WHEN p.amt <> 0 THEN 1.0 ELSE 0.0 END), 0) AS TARGET_NON_ZERO_RATIO_28,
  any_value(d.amt) AS KNOWN_AMOUNT_D1, any_value(d.n) AS KNOWN_COUNT_D1
 FROM eval_days e JOIN d1_known d ON d.CUTOFF_DATE = e.CUTOFF_DATE LEFT JOIN panel p ON p.CUTOFF_DATE = e.CUTOFF_DATE
 GROUP BY e.CUTOFF_DATE, e.FORECAST_DATE""")
cte("final_labels", """SELECT VALUE_DATE AS DATE, sum(TARGET_AMOUNT) AS TARGET_AMOUNT FROM realized GROUP BY VALUE_DATE""")
cte("day_rows", """SELECT f.*, coalesce(l.TARGET_AMOUNT, 0) AS TARGET_AMOUNT FROM features f LEFT JOIN final_labels l ON l.DATE = f.FORECAST_DATE""")
cte("eval_rows", """SELECT * FROM day_rows f
 WHERE f.CUTOFF_DATE BETWEEN DATE '2000-01-01' AND DATE '2000-03-31'""")
cte("folds", """SELECT DATE AS EVALUATION_CUTOFF, DATE - 90 AS TRAIN_CUTOFF_START, DATE - 1 AS TRAIN_CUTOFF_END
 FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '2000-01-01', TIMESTAMP '2000-03-31', INTERVAL 1 DAY)) AS DATE) AS DATE)""")
cte("train_rows", """SELECT b.EVALUATION_CUTOFF, f.*, coalesce((SELECT sum(k.KNOWN_AMOUNT) FROM known k WHERE k.VALUE_DATE = f.FORECAST_DATE
   AND k.TRADE_DATE <= b.EVALUATION_CUTOFF), 0) AS TARGET_AMOUNT
 FROM folds b JOIN features f ON f.CUTOFF_DATE BETWEEN b.TRAIN_CUTOFF_START AND b.TRAIN_CUTOFF_END""")
cte("preds", """SELECT m.RUN_NAME, e.CUTOFF_DATE, e.FORECAST_DATE, e.TARGET_AMOUNT, CASE m.RUN_NAME WHEN 'naive_last_day' THEN e.TARGET_LAG_1
   WHEN 'seasonal_naive_weekly' THEN e.TARGET_LAG_7 WHEN 'moving_average' THEN e.TARGET_ROLLING_MEAN_7 ELSE e.KNOWN_AMOUNT_D1 END AS PREDICTION,
   f.EVALUATION_CUTOFF, f.TRAIN_CUTOFF_START, f.TRAIN_CUTOFF_END
 FROM eval_rows e JOIN folds f ON f.EVALUATION_CUTOFF = e.CUTOFF_DATE
 CROSS JOIN (VALUES ('naive_last_day'), ('seasonal_naive_weekly'), ('moving_average'), ('known_amount_d1')) m(RUN_NAME)""")
cte("all_panel", """SELECT e.CUTOFF_DATE, e.FORECAST_DATE, c.DATE, coalesce(sum(k.KNOWN_AMOUNT), 0) AS amt
 FROM eval_days e LEFT JOIN calendar c ON c.DATE BETWEEN e.CUTOFF_DATE - 27 AND e.CUTOFF_DATE
 LEFT JOIN known k ON k.VALUE_DATE = c.DATE AND k.TRADE_DATE <= e.CUTOFF_DATE GROUP BY 1, 2, 3""")
cte("all_rows", """SELECT p.CUTOFF_DATE, p.FORECAST_DATE, isodow(p.FORECAST_DATE) - 1 AS DAY_OF_WEEK,
  coalesce(max(p.amt) FILTER (p.DATE = p.FORECAST_DATE - 1), 0) AS TARGET_LAG_1, coalesce(max(p.amt) FILTER (p.DATE = p.FORECAST_DATE - 7), 0) AS TARGET_LAG_7,
  coalesce(max(p.amt) FILTER (p.DATE = p.FORECAST_DATE - 14), 0) AS TARGET_LAG_14, coalesce(max(p.amt) FILTER (p.DATE = p.FORECAST_DATE - 28), 0) AS TARGET_LAG_28,
  avg(p.amt) FILTER (p.DATE > p.CUTOFF_DATE - 7) AS TARGET_ROLLING_MEAN_7, avg(p.amt) AS TARGET_ROLLING_MEAN_28,
  coalesce(max(d.amt), 0) AS KNOWN_AMOUNT_D1, coalesce(max(l.TARGET_AMOUNT), 0) AS TARGET_AMOUNT
 FROM all_panel p LEFT JOIN final_labels l ON l.DATE = p.FORECAST_DATE
 LEFT JOIN (SELECT VALUE_DATE, sum(KNOWN_AMOUNT) AS amt FROM known WHERE TRADE_DATE <= VALUE_DATE - 1 GROUP BY 1) d ON d.VALUE_DATE = p.FORECAST_DATE
 GROUP BY 1, 2""")
cte("simple_preds", """SELECT c.RUN_NAME, CUTOFF_DATE, FORECAST_DATE, TARGET_AMOUNT, CASE c.RUN_NAME WHEN 'simple/zero' THEN 0 WHEN 'simple/known_amount_d1' THEN KNOWN_AMOUNT_D1
  WHEN 'simple/target_lag_1' THEN TARGET_LAG_1 WHEN 'simple/target_lag_7' THEN TARGET_LAG_7 WHEN 'simple/target_lag_14' THEN TARGET_LAG_14 WHEN 'simple/target_lag_28' THEN TARGET_LAG_28
  WHEN 'simple/rolling_mean_7' THEN TARGET_ROLLING_MEAN_7 ELSE TARGET_ROLLING_MEAN_28 END AS PREDICTION
 FROM all_rows CROSS JOIN (VALUES ('simple/zero'), ('simple/known_amount_d1'), ('simple/target_lag_1'), ('simple/target_lag_7'), ('simple/target_lag_14'), ('simple/target_lag_28'), ('simple/rolling_mean_7'), ('simple/rolling_mean_28')) c(RUN_NAME)""")
cte("scored", """SELECT *, y * score AS gain, y * (100 - score) AS pen FROM (SELECT *, CASE WHEN y > 0 THEN 100 * least(y, p) / greatest(y, p) WHEN p > 0 THEN 0.0 ELSE 100.0 END AS score
 FROM (SELECT *, greatest(TARGET_AMOUNT, 0) AS y, greatest(PREDICTION, 0) AS p FROM simple_preds))""")
cte("worst", """SELECT *, row_number() OVER w AS r, sum(y) OVER w AS cy, sum(gain) OVER w AS cg, sum(pen) OVER w AS cp, count(*) OVER (PARTITION BY RUN_NAME) AS n,
 sum(y) OVER (PARTITION BY RUN_NAME) AS ty, sum(gain) OVER (PARTITION BY RUN_NAME) AS tg, sum(pen) OVER (PARTITION BY RUN_NAME) AS tp
 FROM scored WINDOW w AS (PARTITION BY RUN_NAME ORDER BY round(pen, 4) DESC, FORECAST_DATE)""")
cte("ljung", """SELECT RUN_NAME, r - avg(r) OVER (PARTITION BY RUN_NAME) AS x, row_number() OVER (PARTITION BY RUN_NAME ORDER BY FORECAST_DATE) AS i,
 count(*) OVER (PARTITION BY RUN_NAME) AS n FROM (SELECT RUN_NAME, FORECAST_DATE, p - y AS r FROM scored)""")
cte("tx", """SELECT *, abs(amount) AS abs_amount, CASE WHEN abs(amount) < 20000 THEN 'low' WHEN abs(amount) < 100000 THEN 'medium' WHEN abs(amount) < 1000000 THEN 'high' ELSE 'huge' END AS amount_bin,
  company_name IS NOT NULL AS company_found, coalesce(company_name, 'NO_COMPANY') AS company_key, isodow(VALUE_DATE) - 1 AS dayofweek, dayname(VALUE_DATE) AS day_name, day(VALUE_DATE) AS dayofmonth
 FROM (SELECT ID, TRADE_DATE, VALUE_DATE, SIGNED_AMOUNT AS amount, CASH_MOVEMENT_TYPE_SHORTNAME, CASE WHEN ACCOUNT_SHORTNAME = 'Brand#7' THEN NULL ELSE concat('CUSTOMER ', substr(CPTY_NAME, 10)) END AS company_name,
  row_number() OVER (PARTITION BY ID ORDER BY TRADE_DATE, VALUE_DATE, AMOUNT, ENTITY_SHORTNAME, CURRENCY_SHORTNAME, CASH_MOVEMENT_TYPE_SHORTNAME) AS rn FROM movements) WHERE rn = 1 AND amount IS NOT NULL""")
cte("tx_span", "SELECT min(VALUE_DATE) AS lo, max(VALUE_DATE) AS hi, max(VALUE_DATE) - min(VALUE_DATE) + 1 AS n FROM tx")
cte("tx_days", "SELECT CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS VALUE_DATE FROM tx_span")
cte("banded", """SELECT *, abs_amount AS amount_abs, CASE WHEN abs_amount < 20000 THEN 'tiny' WHEN abs_amount < 100000 THEN 'low' WHEN abs_amount < 500000 THEN 'mid' WHEN abs_amount < 1000000 THEN 'large' ELSE 'mega' END AS amount_band,
 CASE WHEN abs_amount < 20000 THEN 0 WHEN abs_amount < 100000 THEN 1 WHEN abs_amount < 500000 THEN 2 WHEN abs_amount < 1000000 THEN 3 ELSE 4 END AS amount_band_order,
 CASE WHEN abs_amount < 20000 THEN '[0, 20,000)' WHEN abs_amount < 100000 THEN '[20,000, 100,000)' WHEN abs_amount < 500000 THEN '[100,000, 500,000)' WHEN abs_amount < 1000000 THEN '[500,000, 1,000,000)' ELSE '[1,000,000, inf)' END AS amount_band_display FROM tx""")
cte("prepared", """SELECT *, company_found AS company_found_clean, company_key AS company_clean, CASE WHEN abs_amount >= 50000 THEN 'over_100k' ELSE 'under_100k' END AS amount_regime,
 day(VALUE_DATE) >= 28 OR VALUE_DATE = last_day(VALUE_DATE) AS is_month_end_window, day(VALUE_DATE) <= 3 AS is_month_start_window,
 CASE WHEN abs_amount < 50000 THEN CASE WHEN abs_amount < 1000 THEN 'row_0_1000' WHEN abs_amount < 5000 THEN 'row_1000_5000' WHEN abs_amount < 20000 THEN 'row_5000_20000' ELSE 'row_20000_100000' END
  ELSE CASE WHEN abs_amount < 100000 THEN 'row_5000000_plus' WHEN abs_amount < 500000 THEN 'row_100000_500000' WHEN abs_amount < 1000000 THEN 'row_500000_1000000' WHEN abs_amount < 5000000 THEN 'row_1000000_5000000' ELSE 'row_5000000_plus' END END AS row_amount_bin FROM tx""")


def _event_sql(source: str, keys: str, extra: str = "") -> str:
    """Payment-level, day-level and gap measures per key, joined."""
    on = " AND ".join(f"{{0}}.{k} IS NOT DISTINCT FROM b.{k}" for k in keys.split(", "))
    dist = lambda v, name: f"""SELECT {keys}, CASE WHEN count(*) <= 1 THEN 0 ELSE -sum(n / t * ln(n / t)) / ln(count(*)) END AS {name}_entropy, max(n) / sum(n) AS {name}_top_share FROM
      (SELECT {keys}, {v} AS v, count(*) AS n, sum(count(*)) OVER (PARTITION BY {keys}) AS t FROM {source} GROUP BY {keys}, {v}) GROUP BY {keys}"""
    return f"""SELECT b.*, d.* EXCLUDE ({keys}), g.* EXCLUDE ({keys}), w.* EXCLUDE ({keys}), m.* EXCLUDE ({keys}), last_date - first_date + 1 AS span_days FROM
     (SELECT {keys}, count(*) AS n_rows, count(DISTINCT VALUE_DATE) AS n_active_days, sum(amount) AS total_amount, sum(abs_amount) AS total_abs_amount, avg(abs_amount) AS mean_abs_amount, max(abs_amount) AS max_abs_amount,
      min(VALUE_DATE) AS first_date, max(VALUE_DATE) AS last_date, avg((day(VALUE_DATE) >= 28 OR VALUE_DATE = last_day(VALUE_DATE))::INT) AS month_end_share, avg((day(VALUE_DATE) <= 3)::INT) AS month_start_share,
      sum(abs_amount * abs_amount) / pow(sum(abs_amount), 2) AS payment_abs_hhi, median(abs_amount) AS median_abs_amount, quantile_cont(abs_amount, 0.9) AS p90_abs_amount {extra} FROM {source} GROUP BY {keys}) b
     LEFT JOIN (SELECT {keys}, avg(y) AS mean_daily_abs_amount, median(y) AS median_daily_abs_amount, stddev_samp(y) AS std_daily_abs_amount, max(y) AS max_daily_abs_amount,
      CASE WHEN count(*) > 1 THEN pow(stddev_samp(y) / avg(y), 2) END AS cv2_daily_abs_amount FROM (SELECT {keys}, VALUE_DATE, sum(abs_amount) AS y FROM {source} GROUP BY ALL) GROUP BY {keys}) d ON {on.format('d')}
     LEFT JOIN (SELECT {keys}, median(g) AS median_gap_days, avg(g) AS mean_gap_days, stddev_samp(g) / avg(g) AS cv_gap_days, CAST(min(g) AS DOUBLE) AS min_gap_days, CAST(max(g) AS DOUBLE) AS max_gap_days FROM
      (SELECT {keys}, VALUE_DATE - lag(VALUE_DATE) OVER (PARTITION BY {keys} ORDER BY VALUE_DATE) AS g FROM (SELECT DISTINCT {keys}, VALUE_DATE FROM {source})) GROUP BY {keys}) g ON {on.format('g')}
     LEFT JOIN ({dist('isodow(VALUE_DATE)', 'dow')}) w ON {on.format('w')} LEFT JOIN ({dist('day(VALUE_DATE)', 'dom')}) m ON {on.format('m')}"""


def _behavior_sql(variant: str) -> str:
    weekly = "WHEN n_active_days >= 8 AND ((median_gap_days BETWEEN 6 AND 8 AND (cv_gap_days IS NULL OR cv_gap_days <= 0.45)) OR dow_top_share >= 0.6) THEN 'periodic_weekly'"
    monthly = "WHEN n_active_days >= 4 AND ((median_gap_days BETWEEN 25 AND 35 AND (cv_gap_days IS NULL OR cv_gap_days <= 0.35)) OR dom_top_share >= 0.6) THEN 'periodic_monthly'"
    frequent = "WHEN n_active_days >= 30 AND cv2_daily_abs_amount <= 1.0 THEN 'frequent_stable' WHEN n_active_days >= 30 THEN 'frequent_erratic'"
    if variant == "company":
        return f"""CASE {weekly} {monthly} WHEN n_rows <= 3 AND total_abs_amount >= 100000 THEN 'rare_large' {frequent} WHEN n_active_days >= 6 AND cv2_daily_abs_amount <= 0.49 THEN 'intermittent_stable'
          WHEN n_active_days >= 6 AND max_to_median_abs >= 10 THEN 'lumpy_spiky' WHEN n_active_days >= 6 THEN 'intermittent_lumpy' ELSE 'sparse_tail' END"""
    return f"""CASE WHEN company_clean = 'NO_COMPANY' THEN 'no_company' WHEN n_rows <= 2 THEN 'one_or_two_spikes' WHEN n_rows <= 5 AND total_abs_amount >= 100000 THEN 'rare_large' {monthly} {weekly} {frequent}
      WHEN n_active_days >= 6 AND cv2_daily_abs_amount <= 0.49 THEN 'intermittent_stable_amount' WHEN n_active_days >= 6 AND max_to_median_abs >= 10 THEN 'lumpy_spiky' WHEN n_active_days >= 6 THEN 'lumpy_intermittent' ELSE 'sparse_tail' END"""


def _score_sql(keys: str, behavior: str) -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    tie = f"{keys}, " if keys else ""
    pct = lambda v: f"(rank() OVER ({part}ORDER BY {v}) + (count(*) OVER (PARTITION BY {tie}{v}) - 1) / 2) / count(*) OVER ({part.strip()})"
    return f"""round(0.45 * {pct('round(total_abs_amount, 6)')} + 0.25 * {pct('n_rows')} + 0.15 * {pct('n_active_days')} + 0.1 * (1.0 - days_since_last / greatest(max(days_since_last) OVER (), 1))
      + 0.05 * ({behavior} IN ('periodic_weekly', 'periodic_monthly', 'frequent_stable'))::INT, 12)"""


cte("company_events", "SELECT *, " + _behavior_sql("company") + " AS behavior_group FROM (SELECT *, (SELECT hi FROM tx_span) - last_date AS days_since_last, max_abs_amount / nullif(median_abs_amount, 0) AS max_to_median_abs, total_abs_amount / sum(total_abs_amount) OVER () AS share_total_abs FROM ("
    + _event_sql("(SELECT * FROM tx WHERE company_found)", "company_name") + "))")
cte("company_selection", "SELECT *, row_number() OVER (ORDER BY eligible DESC, company_score DESC, total_abs_amount DESC, n_rows DESC, company_name) AS position FROM (SELECT *, n_rows >= 5 AND n_active_days >= 3 AND total_abs_amount >= 100000 AS eligible, "
    + _score_sql("", "behavior_group") + " AS company_score FROM company_events)")
cte("regime_events", "SELECT *, " + _behavior_sql("regime") + " AS behavior_label FROM (SELECT *, (SELECT n FROM tx_span) AS history_days, (SELECT n FROM tx_span) / n_active_days AS adi, (SELECT hi FROM tx_span) - last_date AS days_since_last, max_abs_amount / nullif(median_abs_amount, 0) AS max_to_median_abs,"
    " CASE WHEN n_rows <= 2 THEN 'freq_1_2' WHEN n_rows <= 5 THEN 'freq_3_5' WHEN n_rows <= 20 THEN 'freq_6_20' WHEN n_rows <= 50 THEN 'freq_21_50' WHEN n_rows <= 500 THEN 'freq_51_500' ELSE 'freq_500_plus' END AS freq_bin,"
    " CASE WHEN total_abs_amount < 1000 THEN 'total_lt_1k' WHEN total_abs_amount < 100000 THEN 'total_1k_100k' WHEN total_abs_amount < 5000000 THEN 'total_100k_5M' WHEN total_abs_amount < 100000000 THEN 'total_5M_100M' ELSE 'total_100M_plus' END AS value_bin,"
    " total_abs_amount / sum(total_abs_amount) OVER () AS share_total_abs, total_abs_amount / sum(total_abs_amount) OVER (PARTITION BY amount_regime) AS share_split_abs FROM ("
    + _event_sql("prepared", "amount_regime, company_clean", ", quantile_cont(abs_amount, 0.99) AS p99_abs_amount") + "))")
cte("own_selection", "SELECT *, eligible AND r <= CASE amount_regime WHEN 'under_100k' THEN 60 ELSE 40 END AS is_own_series FROM (SELECT *, row_number() OVER (PARTITION BY amount_regime ORDER BY eligible DESC, own_score DESC, total_abs_amount DESC, n_rows DESC, company_clean) AS r FROM (SELECT *, company_clean <> 'NO_COMPANY' AND n_rows > 2 AND CASE amount_regime WHEN 'under_100k' THEN (n_rows >= 20 OR total_abs_amount >= 500000) AND n_active_days >= 10 ELSE (n_rows >= 3 OR total_abs_amount >= 500000) AND n_active_days >= 2 END AS eligible, "
    + _score_sql("amount_regime", "behavior_label") + " AS own_score FROM regime_events))")
cte("series_rows", """SELECT *, CASE WHEN contains(series_id, '__OWN__') THEN 'own_company' WHEN contains(series_id, '__NO_COMPANY') THEN 'no_company' WHEN contains(series_id, '__TAIL__') THEN 'tail_group' ELSE 'other' END AS series_type FROM
 (SELECT *, CASE WHEN contains(initial_series_id, '__TAIL__') AND (count(*) OVER (PARTITION BY initial_series_id) < 3 OR sum(abs_amount) OVER (PARTITION BY initial_series_id) < 25000) THEN concat(amount_regime, '__TAIL__MISC_TINY') ELSE initial_series_id END AS series_id FROM
 (SELECT p.*, CASE WHEN p.company_clean = 'NO_COMPANY' THEN concat(p.amount_regime, '__NO_COMPANY__', row_amount_bin) WHEN o.is_own_series THEN concat(p.amount_regime, '__OWN__', replace(p.company_clean, ' ', '_'))
  ELSE concat(p.amount_regime, '__TAIL__', o.behavior_label, '__', o.freq_bin, '__', o.value_bin, '__', row_amount_bin) END AS initial_series_id FROM prepared p JOIN own_selection o USING (amount_regime, company_clean)))""")
cte("series_meta", """SELECT *, total_abs_amount / sum(total_abs_amount) OVER () AS share_total_abs, total_abs_amount / sum(total_abs_amount) OVER (PARTITION BY amount_regime) AS share_regime_abs FROM (SELECT series_id, amount_regime, series_type, count(*) AS n_rows, count(DISTINCT company_clean) AS n_companies, count(DISTINCT VALUE_DATE) AS n_active_days, sum(amount) AS total_amount,
 sum(abs_amount) AS total_abs_amount, avg(abs_amount) AS mean_abs_movement, max(abs_amount) AS max_abs_movement, min(VALUE_DATE) AS first_date, max(VALUE_DATE) AS last_date FROM series_rows GROUP BY 1, 2, 3)
 JOIN (SELECT series_id, max(a) / sum(a) AS top_company_abs_share, string_agg(company_clean, ' | ' ORDER BY k) FILTER (k <= 8) AS top_companies_sample FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(a, 2) DESC, company_clean) AS k FROM (SELECT series_id, company_clean, sum(abs_amount) AS a FROM series_rows GROUP BY 1, 2)) GROUP BY 1) USING (series_id)""")
cte("picked", "SELECT company_name, position FROM company_selection WHERE eligible AND position <= 30")
cte("remaining_rows", """SELECT *, concat(company_status, '__', amount_bin, '__', remaining_behavior) AS remaining_group FROM (SELECT t.*, coalesce(e.behavior_group, 'unknown_company') AS company_behavior, CASE WHEN company_found THEN 'known_company' ELSE 'unknown_company' END AS company_status,
 CASE WHEN amount_bin = 'low' THEN 'low_weekly' WHEN amount_bin = 'medium' THEN 'medium_intermittent' WHEN amount_bin IN ('high', 'huge') THEN 'rare_large' ELSE 'misc' END AS remaining_behavior FROM tx t LEFT JOIN company_events e ON e.company_name = t.company_name)""")
cte("company_rules", """SELECT CAST(row_number() OVER (ORDER BY position, o) + 999 AS INT) AS priority, series_name, company_name, min_abs_amount, max_abs_amount FROM (
 SELECT position, company_name, CASE amount_bin WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 ELSE 3 END AS o, concat('company__', replace(company_name, ' ', '_'), '__', amount_bin) AS series_name, CASE amount_bin WHEN 'low' THEN 0 WHEN 'medium' THEN 20000 WHEN 'high' THEN 100000 ELSE 1000000 END::DOUBLE AS min_abs_amount,
  CASE amount_bin WHEN 'low' THEN 20000 WHEN 'medium' THEN 100000 WHEN 'high' THEN 1000000 ELSE 'inf'::DOUBLE END::DOUBLE AS max_abs_amount FROM bin_stats WHERE good >= 2
 UNION ALL SELECT DISTINCT position, company_name, 0, concat('company__', replace(company_name, ' ', '_'), '__all'), 0.0::DOUBLE, 'inf'::DOUBLE FROM bin_stats WHERE good < 2)""")
CTES["bin_stats"] = re.sub(r"\s+", " ", """SELECT *, sum((n >= 5 AND d >= 3 AND a / t >= 0.05)::INT) OVER (PARTITION BY company_name) AS good FROM (SELECT company_name, position, amount_bin, count(*) AS n, count(DISTINCT VALUE_DATE) AS d, sum(abs_amount) AS a, sum(sum(abs_amount)) OVER (PARTITION BY company_name) AS t FROM tx JOIN picked USING (company_name) GROUP BY 1, 2, 3)""")
CTES["company_rules"] = CTES.pop("company_rules")
cte("ruled_rows", """SELECT t.* EXCLUDE (company_behavior, company_status, remaining_group), coalesce(r.series_name, g.series_name) AS series_name, CASE WHEN r.series_name IS NOT NULL THEN 'selected_company' ELSE 'remaining' END AS matched_rule_type, coalesce(r.priority, g.priority) AS matched_rule_priority FROM remaining_rows t
 LEFT JOIN company_rules r ON r.company_name = t.company_name AND t.abs_amount >= r.min_abs_amount AND t.abs_amount < r.max_abs_amount LEFT JOIN remaining_rules g ON g.remaining_group = t.remaining_group""")
CTES["remaining_rules"] = re.sub(r"\s+", " ", """SELECT CAST(row_number() OVER (ORDER BY sum(abs_amount) DESC) + 8999 AS INT) AS priority, remaining_group, concat('remaining__', upper(regexp_replace(remaining_group, '_+', '_', 'g'))) AS series_name, any_value(company_found) AS company_found, any_value(amount_bin) AS amount_bin, any_value(remaining_behavior) AS remaining_behavior
 FROM remaining_rows WHERE company_name IS NULL OR company_name NOT IN (SELECT company_name FROM picked) GROUP BY remaining_group""")
CTES["ruled_rows"] = CTES.pop("ruled_rows")

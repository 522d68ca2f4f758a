"""Queries of counterparties and the daily series built from them."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import companies as C
from ..operators import series as R
from ..operators import stats as T
from .registry import query

_TX = "ID, VALUE_DATE, TRADE_DATE, amount, abs_amount, amount_bin, company_name, company_found, company_key, dayofweek, day_name, dayofmonth"


def _names(text):
    return [c.strip() for c in text.split(",")]


def _calendar_days(t):
    lo, hi = t.tx_span
    return F.datediff(hi, lo) + 1


# --- rows ---


@query("clean_movement_extract", f"SELECT {_TX} FROM tx")
def _(t):
    return t.tx.select(*_names(_TX))


@query("company_columns", "SELECT ID, company_name, company_found, company_key FROM tx")
def _(t):
    raw = t.tx.select("ID", F.concat(F.lit("/BO/"), "company_name", F.lit(" Ltd/x")).alias("DESCRIPTION"))
    return C.company_columns(raw).select("ID", "company_name", "company_found", "company_key")


@query("canonicalize_names")
def _(t):
    return C.canonicalize_names(t.tx, overrides={"CUSTOMER 000000001": "CUSTOMER 000000001"})


_PREP = "ID, VALUE_DATE, amount, abs_amount, company_clean, company_found_clean, amount_regime, row_amount_bin, is_month_end_window, is_month_start_window"


@query("prepare_transactions", f"SELECT {_PREP} FROM prepared")
def _(t):
    return t.prepared.select(*_names(_PREP))


@query("row_amount_bin", "SELECT ID, row_amount_bin FROM prepared")
def _(t):
    return t.prepared.select("ID", C.row_amount_bin("abs_amount", "amount_regime").alias("row_amount_bin"))


@query("value_freq_bins", "SELECT amount_regime, company_clean, freq_bin, value_bin FROM regime_events")
def _(t):
    sums = t.prepared.groupBy(*C.REGIME_KEYS).agg(F.count("*").alias("n"), F.sum("abs_amount").alias("a"))
    return sums.select(*C.REGIME_KEYS, C.frequency_bin("n").alias("freq_bin"), C.value_bin("a").alias("value_bin"))


@query("add_band_columns", "SELECT ID, amount_abs, amount_band, amount_band_order, amount_band_display FROM banded")
def _(t):
    return t.banded.select("ID", "amount_abs", "amount_band", "amount_band_order", "amount_band_display")


_BQ = "quantile_cont(amount_abs, 0.5) AS q50_row_abs_amount, quantile_cont(amount_abs, 0.9) AS q90_row_abs_amount"


@query("band_summary", f"""SELECT amount_band, amount_band_order, amount_band_display, count(DISTINCT ID) AS row_count, count(DISTINCT company_key) AS company_count, count(DISTINCT VALUE_DATE) AS active_days, sum(amount) AS total_amount, sum(amount_abs) AS total_abs_amount,
       max(amount_abs) AS max_row_abs_amount, {_BQ}, 1 - count(DISTINCT VALUE_DATE) / (SELECT n FROM tx_span) AS zero_rate FROM banded GROUP BY 1, 2, 3""",
       "total_amount,total_abs_amount:2 q50_row_abs_amount,q90_row_abs_amount:4 zero_rate:8")
def _(t):
    return R.band_summary(t.banded, _calendar_days(t))


_EDGES = """SELECT 'current_hardcoded' AS method, [0.0, 20000.0, 100000.0, 500000.0, 1000000.0, 'inf'::DOUBLE] AS e UNION ALL
 SELECT 'equal_frequency', [0.0, quantile_cont(amount_abs, 0.2), quantile_cont(amount_abs, 0.4), quantile_cont(amount_abs, 0.6), quantile_cont(amount_abs, 0.8), 'inf'::DOUBLE] FROM banded UNION ALL
 SELECT 'log_spaced_p01_p99', [0.0, lo, exp(ln(lo) + (ln(hi) - ln(lo)) / 3), exp(ln(lo) + (ln(hi) - ln(lo)) * 2 / 3), hi, 'inf'::DOUBLE] FROM (SELECT greatest(quantile_cont(amount_abs, 0.01), 1.0) AS lo, quantile_cont(amount_abs, 0.99) AS hi FROM banded WHERE amount_abs > 0) UNION ALL
 SELECT 'weighted_by_abs_amount', list_concat([0.0], list(v ORDER BY q), ['inf'::DOUBLE]) FROM (SELECT q, CASE WHEN max(v) FILTER (c <= q) IS NULL THEN min(v) FILTER (c > q) ELSE max(v) FILTER (c <= q) + (q - max(c) FILTER (c <= q)) / (min(c) FILTER (c > q) - max(c) FILTER (c <= q)) * (min(v) FILTER (c > q) - max(v) FILTER (c <= q)) END AS v
  FROM (SELECT v, sum(w) OVER (ORDER BY v) / sum(w) OVER () AS c FROM (SELECT amount_abs AS v, sum(amount_abs) AS w FROM banded GROUP BY 1)), (VALUES (0.2::DOUBLE), (0.4::DOUBLE), (0.6::DOUBLE), (0.8::DOUBLE)) p(q) GROUP BY q)"""


@query("band_threshold_candidates", f"SELECT method, ['tiny', 'low', 'mid', 'large', 'mega'][i] AS amount_band, i - 1 AS amount_band_order, e[i] AS low, CASE WHEN isinf(e[i + 1]) THEN -1 ELSE e[i + 1] END AS high FROM ({_EDGES}), (VALUES (1), (2), (3), (4), (5)) n(i)", "low,high:3", "amount_band_order")
def _(t):
    got = R.band_threshold_candidates(t.banded)
    return got.withColumn("high", F.when(F.col("high") == R.INF, -1.0).otherwise(F.col("high")))


@query("amount_quantiles", "SELECT q AS quantile, v AS amount_abs FROM (SELECT unnest([0, 0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1]::DOUBLE[]) AS q, unnest(quantile_cont(amount_abs, [0, 0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1])) AS v FROM banded)", "quantile:2 amount_abs:4")
def _(t):
    return R.amount_quantiles(t.banded)


# --- manual series and dense tables ---

# Picks that exercise payment and daily bounds on the fixture companies.
SPECS = [
    R.SeriesSpec("C1_LOW", "CUSTOMER 000000001", 0.0, 40_000.0),
    R.SeriesSpec("C1_HIGH", "CUSTOMER 000000001", 40_000.0),
    R.SeriesSpec("C2_BIG_DAYS", "CUSTOMER 000000002", 0.0, R.INF, 30_000.0),
    R.SeriesSpec("C4_SMALL_DAYS", "CUSTOMER 000000004", -R.INF, R.INF, -R.INF, 50_000.0),
]
_SPEC_ROWS = ", ".join(f"('{s.series_id}', '{s.company}', " + ", ".join(f"'{v}'::DOUBLE" for v in (s.payment_low, s.payment_high, s.daily_low, s.daily_high)) + ")" for s in SPECS)
_MANUAL = f"""SELECT ID, series_id, company_name, VALUE_DATE, amount, d AS selected_daily_amount FROM (SELECT t.*, s.*, sum(amount) OVER (PARTITION BY s.series_id, VALUE_DATE) AS d FROM tx t JOIN (VALUES {_SPEC_ROWS}) s(series_id, c, plo, phi, dlo, dhi)
 ON s.c = t.company_name AND t.amount >= plo AND t.amount < phi) WHERE d >= dlo AND d < dhi"""
_MANUAL_COLUMNS = ["ID", "series_id", "company_name", "VALUE_DATE", "amount", "selected_daily_amount"]


def _manual(t):
    return R.manual_membership(t.tx, SPECS)


@query("manual_membership", _MANUAL, "selected_daily_amount:2")
def _(t):
    return _manual(t).select(*_MANUAL_COLUMNS)


@query("membership_summary", f"SELECT series_id, count(DISTINCT ID) AS row_count, count(DISTINCT VALUE_DATE) AS active_days, sum(amount) AS total_amount, min(VALUE_DATE) AS first_date, max(VALUE_DATE) AS last_date FROM ({_MANUAL}) GROUP BY 1", "total_amount:2")
def _(t):
    return R.membership_summary(_manual(t))


@query("dense_daily_series", f"SELECT d.VALUE_DATE, s.series_id, coalesce(sum(m.amount), 0) AS amount, 'manual' AS series_kind FROM tx_days d CROSS JOIN (SELECT DISTINCT series_id FROM ({_MANUAL})) s LEFT JOIN ({_MANUAL}) m ON m.VALUE_DATE = d.VALUE_DATE AND m.series_id = s.series_id GROUP BY 1, 2", "amount:2")
def _(t):
    return R.dense_daily_series(_manual(t), *t.tx_span, kind="manual")


_WIDE = [s.series_id for s in SPECS]


@query("daily_series_wide", f"SELECT d.VALUE_DATE, {', '.join(f'''coalesce(sum(m.amount) FILTER (m.series_id = '{n}'), 0) AS {n}''' for n in _WIDE)} FROM tx_days d LEFT JOIN ({_MANUAL}) m ON m.VALUE_DATE = d.VALUE_DATE GROUP BY 1", ",".join(_WIDE) + ":2")
def _(t):
    return R.daily_series_wide(_manual(t), "series_id", _WIDE, *t.tx_span)


@query("band_total_series", """SELECT d.VALUE_DATE, s.amount_band, s.amount_band_order, coalesce(sum(m.amount), 0) AS amount, concat('BAND_', upper(s.amount_band), '_TOTAL') AS series_id, 'band_total' AS series_kind FROM tx_days d CROSS JOIN (SELECT DISTINCT amount_band, amount_band_order FROM banded) s
       LEFT JOIN banded m ON m.VALUE_DATE = d.VALUE_DATE AND m.amount_band = s.amount_band GROUP BY 1, 2, 3""", "amount:2")
def _(t):
    return R.band_total_series(t.banded, *t.tx_span, "BAND", "band_total")


@query("check_membership", f"SELECT (SELECT count(*) FROM tx WHERE ID NOT IN (SELECT ID FROM ({_MANUAL}))) AS missing, 0 AS extra, 0 AS duplicated", ints="missing extra duplicated")
def _(t):
    return R.check_membership(_manual(t), t.tx)


@query("check_dense", f"SELECT 4 * (SELECT n FROM tx_span) AS rows, 4 * (SELECT n FROM tx_span) AS expected_rows", ints="rows expected_rows")
def _(t):
    return R.check_dense(R.dense_daily_series(_manual(t), *t.tx_span), _calendar_days(t))


@query("check_reconstruction", "SELECT 0.0::DOUBLE AS max_abs_reconstruction_error, (SELECT n FROM tx_span) AS days", "max_abs_reconstruction_error:4", "days")
def _(t):
    series = R.band_total_series(t.banded, *t.tx_span, "BAND", "band_total")
    return R.check_reconstruction(series, t.tx)


def _band_membership(t):
    return t.banded.withColumn("series_id", F.concat(F.lit("S_"), F.upper("amount_band"), F.lit("_"), F.col("dayofweek").cast("string")))


_BAND_MEMBERS = "(SELECT *, concat('S_', upper(amount_band), '_', dayofweek) AS series_id FROM banded)"


@query("series_summary", f"""SELECT b.*, d.* EXCLUDE (series_id), c.top / b.total_abs_amount AS top_company_share, 'weekday' AS strategy FROM (SELECT series_id, count(DISTINCT company_key) AS company_count, count(DISTINCT ID) AS row_count, sum(amount) AS total_amount, sum(abs(amount)) AS total_abs_amount, min(VALUE_DATE) AS first_date, max(VALUE_DATE) AS last_date,
       any_value(amount_band) AS amount_band, any_value(amount_band_order) AS amount_band_order FROM {_BAND_MEMBERS} GROUP BY 1) b
       JOIN (SELECT series_id, count(*) FILTER (a <> 0) AS active_days, 1 - count(*) FILTER (a <> 0) / count(*) AS zero_rate, max(a) AS max_daily_abs_amount, quantile_cont(a, 0.9) AS q90_abs_daily_amount, max(a) / sum(a) AS max_day_abs_share FROM
         (SELECT s.series_id, d.VALUE_DATE, abs(coalesce(sum(m.amount), 0)) AS a FROM tx_days d CROSS JOIN (SELECT DISTINCT series_id FROM {_BAND_MEMBERS}) s LEFT JOIN {_BAND_MEMBERS} m ON m.VALUE_DATE = d.VALUE_DATE AND m.series_id = s.series_id GROUP BY 1, 2) GROUP BY 1) d USING (series_id)
       JOIN (SELECT series_id, max(a) AS top FROM (SELECT series_id, company_key, sum(abs(amount)) AS a FROM {_BAND_MEMBERS} GROUP BY 1, 2) GROUP BY 1) c USING (series_id)""",
       "total_amount,total_abs_amount,max_daily_abs_amount:2 q90_abs_daily_amount:4 zero_rate,max_day_abs_share,top_company_share:8")
def _(t):
    return R.series_summary(_band_membership(t), _calendar_days(t), "weekday")


@query("series_company_detail", f"SELECT series_id, amount_band, amount_band_order, company_key, count(DISTINCT ID) AS row_count, count(DISTINCT VALUE_DATE) AS active_days, sum(amount) AS total_amount, sum(abs(amount)) AS total_abs_amount, min(VALUE_DATE) AS first_date, max(VALUE_DATE) AS last_date FROM {_BAND_MEMBERS} GROUP BY 1, 2, 3, 4",
       "total_amount,total_abs_amount:2")
def _(t):
    return R.series_company_detail(_band_membership(t))


# --- calendar profiles ---


def _profile_sql(source, keys, absolute):
    v = "abs(x)" if absolute else "x"
    stem = "active_abs_daily" if absolute else "active_daily"
    on = lambda a: " AND ".join(f"{a}.{k} = b.{k}" for k in keys.split(", "))
    grid = f"(SELECT g.*, coalesce(d.x, 0) AS x, coalesce(d.n, 0) AS n FROM (SELECT * FROM (SELECT DISTINCT {keys} FROM {source}) CROSS JOIN tx_days) g LEFT JOIN (SELECT {keys}, VALUE_DATE, sum(amount) AS x, count(DISTINCT ID) AS n FROM {source} GROUP BY ALL) d USING ({keys}, VALUE_DATE))"
    acts = f"(SELECT *, VALUE_DATE - lag(VALUE_DATE) OVER (PARTITION BY {keys} ORDER BY VALUE_DATE) AS gap FROM {grid} WHERE x <> 0)"
    run = lambda cond, name: f"(SELECT {keys}, max(c) AS {name} FROM (SELECT {keys}, count(*) AS c FROM (SELECT {keys}, VALUE_DATE - CAST(row_number() OVER (PARTITION BY {keys} ORDER BY VALUE_DATE) AS INT) AS i FROM {grid} WHERE {cond}) GROUP BY {keys}, i) GROUP BY {keys})"
    ent = lambda e, name: f"(SELECT {keys}, CASE WHEN count(*) <= 1 THEN 0 ELSE -sum(c / t * ln(c / t)) / ln(count(*)) END AS {name}_entropy, max(c) / sum(c) AS {name}_top_share FROM (SELECT {keys}, {e} AS e, count(*) AS c, sum(count(*)) OVER (PARTITION BY {keys}) AS t FROM {grid} WHERE x <> 0 GROUP BY {keys}, {e}) GROUP BY {keys})"
    tot = v
    recent = ", ".join(f"coalesce(sum({tot}) FILTER (VALUE_DATE > (SELECT hi FROM tx_span) - {n}) / nullif(sum({tot}), 0), 0) AS recent_{n}_amount_share" for n in C.RECENT_DAYS)
    lags = ", ".join(f"CASE WHEN stddev_pop(x) > 1e-9 THEN corr(x, l{k}) END AS autocorr_lag_{k}" for k in C.AUTO_LAGS)
    return f"""SELECT b.*, a.* EXCLUDE ({keys}), coalesce(r1.longest_active_run, 0) AS longest_active_run, coalesce(r0.longest_zero_run, 0) AS longest_zero_run, w.* EXCLUDE ({keys}), m.* EXCLUDE ({keys}), l.* EXCLUDE ({keys}), p.* EXCLUDE ({keys}), s.* EXCLUDE ({keys}),
     CASE WHEN adi IS NULL OR cv2 IS NULL THEN 'unknown' WHEN adi < 1.32 AND cv2 < 0.49 THEN 'smooth' WHEN adi < 1.32 THEN 'erratic' WHEN cv2 < 0.49 THEN 'intermittent' ELSE 'lumpy' END AS sbc_label FROM
     (SELECT {keys}, max(company_found) AS company_found, count(DISTINCT ID) AS row_count FROM {source} GROUP BY {keys}) b
     JOIN (SELECT {keys}, count(*) FILTER (x <> 0) AS active_days, count(*) AS calendar_days, sum(x) AS total_amount, sum(abs(x)) AS total_abs_amount, avg(x) AS mean_calendar_daily_amount, count(*) FILTER (x <> 0) / count(*) AS active_rate, 1 - count(*) FILTER (x <> 0) / count(*) AS zero_rate,
       count(*) / nullif(count(*) FILTER (x <> 0), 0) AS adi, max(abs(x)) / sum(abs(x)) AS max_day_abs_share, list_sum(list_slice(list_reverse_sort(list(abs(x))), 1, 3)) / sum(abs(x)) AS top3_day_abs_share, sum(dx) / (count(*) - 1) AS mean_abs_daily_diff, {recent}, {lags} FROM
       (SELECT *, abs(x - lag(x) OVER q) AS dx, {', '.join(f'lag(x, {k}) OVER q AS l{k}' for k in C.AUTO_LAGS)} FROM {grid} WINDOW q AS (PARTITION BY {keys} ORDER BY VALUE_DATE)) GROUP BY {keys}) a ON {on('a')}
     JOIN (SELECT {keys}, avg({v}) AS mean_{stem}_amount, median({v}) AS median_{stem}_amount, quantile_cont({v}, 0.9) AS q90_{stem}_amount, quantile_cont({v}, 0.95) AS q95_{stem}_amount, max({v}) AS max_{stem}_amount, CASE WHEN count(*) > 1 AND abs(avg({v})) >= 1e-12 THEN pow(stddev_samp({v}) / avg({v}), 2) END AS cv2,
       avg((isodow(VALUE_DATE) >= 6)::INT) AS weekend_active_share, avg((day(VALUE_DATE) <= 5)::INT) AS month_start_active_share, avg((day(VALUE_DATE) >= day(last_day(VALUE_DATE)) - 4)::INT) AS month_end_active_share, avg(n) AS rows_per_active_day_mean, CAST(max(n) AS DOUBLE) AS rows_per_active_day_max,
       CASE WHEN count(*) > 1 THEN pow(stddev_samp(n) / avg(n), 2) END AS rows_per_active_day_cv2, median(gap) AS median_gap_days, avg(gap) AS mean_gap_days, stddev_samp(gap) / avg(gap) AS cv_gap_days, CAST(min(gap) AS DOUBLE) AS min_gap_days, CAST(max(gap) AS DOUBLE) AS max_gap_days FROM {acts} GROUP BY {keys}) p ON {on('p')}
     JOIN (SELECT {keys}, avg(({v} {'>=' if absolute else '>'} q)::INT) AS spike_active_share FROM (SELECT *, quantile_cont({v}, 0.95) OVER (PARTITION BY {keys}) AS q FROM {grid} WHERE x <> 0) GROUP BY {keys}) s ON {on('s')}
     LEFT JOIN {run('x <> 0', 'longest_active_run')} r1 ON {on('r1')} LEFT JOIN {run('x = 0', 'longest_zero_run')} r0 ON {on('r0')}
     JOIN {ent('isodow(VALUE_DATE)', 'weekday')} w ON {on('w')} JOIN {ent('day(VALUE_DATE)', 'dayofmonth')} m ON {on('m')}
     JOIN (SELECT {keys}, avg(VALUE_DATE - TRADE_DATE) AS lead_days_mean, median(VALUE_DATE - TRADE_DATE) AS lead_days_median, avg((VALUE_DATE - TRADE_DATE >= 1)::INT) AS known_at_least_d1_share, avg((VALUE_DATE = TRADE_DATE)::INT) AS known_same_day_share FROM {source} GROUP BY {keys}) l ON {on('l')}"""


def _profile_digits(stem):
    amounts = ["total_amount", "total_abs_amount"]
    fine = ["mean_calendar_daily_amount", "mean_abs_daily_diff"] + [f"{p}_{stem}_amount" for p in ("mean", "median", "q90", "q95", "max")]
    shares = ["max_day_abs_share", "top3_day_abs_share", "active_rate", "zero_rate", "adi", "weekday_entropy", "weekday_top_share", "weekend_active_share", "month_start_active_share",
              "month_end_active_share", "dayofmonth_entropy", "dayofmonth_top_share", "rows_per_active_day_mean", "rows_per_active_day_cv2", "spike_active_share", "lead_days_mean",
              "known_at_least_d1_share", "known_same_day_share", "mean_gap_days", "cv_gap_days", "median_gap_days", "lead_days_median"]
    loose = [f"autocorr_lag_{k}" for k in C.AUTO_LAGS] + [f"recent_{n}_amount_share" for n in C.RECENT_DAYS] + ["cv2"]
    return f"{','.join(amounts)}:2 {','.join(fine)}:4 {','.join(shares)}:8 {','.join(loose)}:4"


@query("company_profile_daily", _profile_sql("tx", "company_key", False), _profile_digits("active_daily"), "longest_active_run longest_zero_run")
def _(t):
    return C.company_profile(t.tx, *t.tx_span, one_row_per_id=True)


@query("company_profile_regime", _profile_sql("banded", "company_key, amount_band", True), _profile_digits("active_abs_daily"), "longest_active_run longest_zero_run")
def _(t):
    return C.company_profile(t.banded, *t.tx_span, keys=("company_key", "amount_band"), absolute=True, one_row_per_id=True)


@query("company_gap_stats", "SELECT company_key, median(g) AS median_gap_days, avg(g) AS mean_gap_days, stddev_samp(g) / avg(g) AS cv_gap_days, CAST(min(g) AS DOUBLE) AS min_gap_days, CAST(max(g) AS DOUBLE) AS max_gap_days FROM (SELECT company_key, VALUE_DATE - lag(VALUE_DATE) OVER (PARTITION BY company_key ORDER BY VALUE_DATE) AS g FROM (SELECT DISTINCT company_key, VALUE_DATE FROM tx)) GROUP BY 1",
       "median_gap_days,mean_gap_days,cv_gap_days:8")
def _(t):
    days = t.tx.select("company_key", "VALUE_DATE").distinct()
    return T.with_gaps(days, ["company_key"], "VALUE_DATE").groupBy("company_key").agg(*T.gap_columns())


@query("share_last_days", "SELECT company_key, CASE WHEN abs(sum(amount)) < 1e-12 THEN 0 ELSE coalesce(sum(amount) FILTER (VALUE_DATE > (SELECT hi FROM tx_span) - 180), 0) / sum(amount) END AS share FROM tx GROUP BY 1", "share:5")
def _(t):
    p = C.company_profile(t.tx, *t.tx_span, one_row_per_id=True)
    return p.select("company_key", F.col("recent_180_amount_share").alias("share"))


_HIST = "company_row_count, company_active_days, company_total_abs_amount, company_active_rate, company_adi, company_cv2, company_sbc_label, company_q90_abs_daily_amount, company_max_abs_daily_amount, company_max_day_abs_share"
_HIST_SQL = f"""SELECT company_key, row_count AS company_row_count, active_days AS company_active_days, total_abs_amount AS company_total_abs_amount, active_rate AS company_active_rate, adi AS company_adi, cv2 AS company_cv2, sbc_label AS company_sbc_label, q90_active_abs_daily_amount AS company_q90_abs_daily_amount,
 max_active_abs_daily_amount AS company_max_abs_daily_amount, max_day_abs_share AS company_max_day_abs_share FROM ({_profile_sql('tx', 'company_key', True)})"""
_HIST_DIGITS = "company_total_abs_amount,company_max_abs_daily_amount:2 company_q90_abs_daily_amount:5 company_active_rate,company_adi,company_max_day_abs_share:8 company_cv2:4"


@query("company_history", _HIST_SQL, _HIST_DIGITS)
def _(t):
    return C.company_history(t.tx, *t.tx_span, one_row_per_id=True)


_TF = "ID, company_key, VALUE_DATE, log_abs_amount, company_day_amount, company_day_abs_amount, company_day_row_count, dayofweek, dayofmonth, is_weekend, is_month_start, is_month_end, days_since_start, days_to_end, lead_days, known_at_least_d1, known_same_day"


@query("transaction_features", f"""SELECT t.ID, t.company_key, t.VALUE_DATE, ln(1 + abs_amount) AS log_abs_amount, sum(amount) OVER d AS company_day_amount, sum(abs_amount) OVER d AS company_day_abs_amount, count(*) OVER d AS company_day_row_count, dayofweek, dayofmonth, (dayofweek >= 5)::INT AS is_weekend, (dayofmonth = 1)::INT AS is_month_start,
       (t.VALUE_DATE = last_day(t.VALUE_DATE))::INT AS is_month_end, (t.VALUE_DATE - lo)::DOUBLE AS days_since_start, (hi - t.VALUE_DATE)::DOUBLE AS days_to_end, (t.VALUE_DATE - TRADE_DATE)::DOUBLE AS lead_days, (t.VALUE_DATE - TRADE_DATE >= 1)::INT::DOUBLE AS known_at_least_d1, (t.VALUE_DATE = TRADE_DATE)::INT::DOUBLE AS known_same_day,
       h.* EXCLUDE (company_key) FROM tx t CROSS JOIN tx_span JOIN ({_HIST_SQL}) h ON h.company_key = t.company_key WINDOW d AS (PARTITION BY t.company_key, t.VALUE_DATE)""",
       f"log_abs_amount:8 company_day_amount,company_day_abs_amount:2 {_HIST_DIGITS}")
def _(t):
    rows = t.tx.select("ID", "TRADE_DATE", "VALUE_DATE", "amount", "company_key", "company_found")
    return C.transaction_features(rows, *t.tx_span, one_row_per_id=True, layers=t.layers, count_rows=True).select(*_names(_TF), *_names(_HIST))


# --- event profiles and selection ---

_EV_DIGITS = ("total_amount,total_abs_amount,max_abs_amount,max_daily_abs_amount:2 mean_abs_amount,median_abs_amount,p90_abs_amount,mean_daily_abs_amount,median_daily_abs_amount,std_daily_abs_amount:4 "
              "month_end_share,month_start_share,payment_abs_hhi,median_gap_days,mean_gap_days,cv_gap_days,dow_entropy,dow_top_share,dom_entropy,dom_top_share,max_to_median_abs,share_total_abs,cv2_daily_abs_amount:6")


@query("company_profile_events", "SELECT * FROM company_events", _EV_DIGITS, "days_since_last span_days")
def _(t):
    return t.company_events


@query("behavior_class", "SELECT company_clean AS company, amount_regime AS regime, behavior_label AS behavior FROM regime_events UNION ALL SELECT company_name, 'all', behavior_group FROM company_events")
def _(t):
    a = t.regime_profile.select(F.col("company_clean").alias("company"), F.col("amount_regime").alias("regime"), F.col("behavior_label").alias("behavior"))
    return a.unionByName(t.company_events.select(F.col("company_name").alias("company"), F.lit("all").alias("regime"), F.col("behavior_group").alias("behavior")))


@query("selection_score", "SELECT company_name, company_score, eligible AND position <= 30 AS is_selected_company, CASE WHEN eligible AND position <= 30 THEN 'auto_score' ELSE 'not_selected' END AS selection_reason FROM company_selection", "company_score:8")
def _(t):
    return C.select_companies(t.company_events).select("company_name", "company_score", "is_selected_company", "selection_reason")


def _own(t):
    return t.own_series


@query("own_series_selection", "SELECT amount_regime, company_clean, own_score, eligible AS own_eligible, is_own_series, CASE WHEN company_clean = 'NO_COMPANY' THEN 'no_company_bucket' WHEN n_rows <= 2 THEN 'one_or_two_spikes_grouped_not_own' WHEN is_own_series THEN 'selected_by_hybrid_occurrence_value_score' WHEN eligible THEN 'eligible_but_outside_series_budget' ELSE '' END AS own_reason FROM own_selection", "own_score:8")
def _(t):
    return _own(t).select("amount_regime", "company_clean", "own_score", "own_eligible", "is_own_series", "own_reason")


@query("review_not_selected", "SELECT amount_regime, company_clean, n_rows, total_abs_amount, behavior_label, freq_bin, value_bin, own_score FROM own_selection WHERE NOT is_own_series", "total_abs_amount:2 own_score:8")
def _(t):
    return R.review_not_selected(_own(t)).select("amount_regime", "company_clean", "n_rows", "total_abs_amount", "behavior_label", "freq_bin", "value_bin", "own_score")


@query("company_landscape", "SELECT amount_regime, freq_bin, count(*) AS companies, sum(total_abs_amount) AS total_abs_amount, sum(total_abs_amount) / count(*) AS avg_abs_per_company FROM regime_events WHERE company_clean <> 'NO_COMPANY' GROUP BY 1, 2", "total_abs_amount:2 avg_abs_per_company:4")
def _(t):
    return R.company_landscape(t.regime_profile)


# --- rules ---


def _selected(t):
    return t.selected


def _company_rules(t):
    return R.suggest_company_rules(t.tx, _selected(t))


@query("suggest_company_rules", "SELECT priority, series_name, company_name, min_abs_amount, CASE WHEN isinf(max_abs_amount) THEN -1 ELSE max_abs_amount END AS max_abs_amount FROM company_rules", ints="priority")
def _(t):
    got = _company_rules(t).select("priority", "series_name", "company_name", "min_abs_amount", "max_abs_amount")
    return got.withColumn("max_abs_amount", F.when(F.col("max_abs_amount") == R.INF, -1.0).otherwise(F.col("max_abs_amount")))


def _remaining(t):
    # Coverage and rules read these columns of the rows only.
    rows = lambda: t.tx.select("ID", "VALUE_DATE", "amount", "abs_amount", "company_name", "company_found", "company_key", "amount_bin")
    marked = t.layers.get("marked", lambda: R.remaining_behavior(rows(), t.company_events))
    return marked, marked.join(_selected(t), "company_name", "left_anti")


@query("remaining_behavior", "SELECT ID, company_behavior, company_status, remaining_behavior, remaining_group FROM remaining_rows")
def _(t):
    return _remaining(t)[0].select("ID", "company_behavior", "company_status", "remaining_behavior", "remaining_group")


@query("remaining_coverage", "SELECT remaining_group, company_status, amount_bin, remaining_behavior, count(*) AS rows, count(DISTINCT VALUE_DATE) AS active_days, sum(amount) AS total_amount, sum(abs_amount) AS total_abs_amount, count(DISTINCT company_key) AS companies FROM remaining_rows WHERE company_name IS NULL OR company_name NOT IN (SELECT company_name FROM picked) GROUP BY 1, 2, 3, 4", "total_amount,total_abs_amount:2")
def _(t):
    return R.remaining_coverage(_remaining(t)[1])


def _remaining_rules(t):
    return R.suggest_remaining_rules(t.layers.get("coverage", lambda: R.remaining_coverage(_remaining(t)[1])))


@query("suggest_remaining_rules", "SELECT priority, series_name, CAST(company_found AS STRING) AS company_found, amount_bin, remaining_behavior FROM remaining_rules", ints="priority")
def _(t):
    return _remaining_rules(t).select("priority", "series_name", "company_found", "amount_bin", "remaining_behavior")


def _assigned(t):
    rules = t.layers.get("rules", lambda: _company_rules(t).unionByName(_remaining_rules(t)))
    return R.assign_by_rules(_remaining(t)[0].drop("company_behavior", "company_status", "remaining_group"), rules)


@query("assign_by_rules", "SELECT ID, series_name, matched_rule_type, matched_rule_priority FROM ruled_rows", ints="matched_rule_priority")
def _(t):
    return _assigned(t).select("ID", "series_name", "matched_rule_type", "matched_rule_priority")


@query("assigned_summary", "SELECT series_name, matched_rule_type, count(*) AS rows, count(DISTINCT VALUE_DATE) AS active_days, sum(amount) AS total_amount, sum(abs_amount) AS total_abs_amount, count(DISTINCT company_key) AS companies, min(VALUE_DATE) AS first_date, max(VALUE_DATE) AS last_date, sum(abs_amount) / sum(sum(abs_amount)) OVER () AS share_total_abs FROM ruled_rows GROUP BY 1, 2",
       "total_amount,total_abs_amount:2 share_total_abs:8")
def _(t):
    # Written first: the shuffle files of the assignment go before those of the sums.
    read = ("VALUE_DATE", "amount", "abs_amount", "company_key", "series_name", "matched_rule_type")
    return R.assigned_summary(t.layers.get("assigned", lambda: _assigned(t).select(*read)))


# --- series by regime ---


def _series_rows(t):
    # Its summaries read it several times, so it holds what they read.
    rows = lambda: t.prepared.select("ID", "VALUE_DATE", "amount", "abs_amount", "company_clean", "amount_regime", "row_amount_bin")
    return t.layers.get("series_rows", lambda: R.assign_series_ids(rows(), _own(t)))


@query("assign_series_ids", "SELECT ID, initial_series_id, series_id, series_type FROM series_rows")
def _(t):
    return _series_rows(t).select("ID", "initial_series_id", "series_id", "series_type")


_META_DIGITS = "total_amount,total_abs_amount,max_abs_movement:2 mean_abs_movement:5 top_company_abs_share,share_total_abs,share_regime_abs:8"


@query("series_outputs", "SELECT * FROM series_meta", _META_DIGITS)
def _(t):
    return R.series_info(_series_rows(t))


@query("company_to_series", "SELECT amount_regime, company_clean, series_id, any_value(series_type) AS series_type, count(*) AS n_rows, count(DISTINCT VALUE_DATE) AS n_active_days, sum(amount) AS total_amount, sum(abs_amount) AS total_abs_amount FROM series_rows GROUP BY 1, 2, 3", "total_amount,total_abs_amount:2")
def _(t):
    return R.company_to_series(_series_rows(t))


@query("series_coverage", "SELECT *, total_abs_amount / sum(total_abs_amount) OVER () AS share_abs_all, total_abs_amount / sum(total_abs_amount) OVER (PARTITION BY amount_regime) AS share_abs_regime FROM (SELECT amount_regime, series_type, count(*) AS n_series, sum(total_amount) AS total_amount, sum(total_abs_amount) AS total_abs_amount, sum(n_rows) AS n_rows, sum(n_companies) AS n_companies FROM series_meta GROUP BY 1, 2)",
       "total_amount,total_abs_amount:2 share_abs_all,share_abs_regime:8", "n_rows n_companies")
def _(t):
    return R.series_coverage(R.series_info(_series_rows(t)))


@query("tail_audit", "SELECT series_id, amount_regime, n_rows, n_companies, total_abs_amount, top_company_abs_share, top_companies_sample FROM series_meta WHERE series_type = 'tail_group'", "total_abs_amount:2 top_company_abs_share:8")
def _(t):
    return R.tail_audit(R.series_info(_series_rows(t)))


@query("scenario_compare")
def _(t):
    return R.scenario_compare(t.tx)


@query("write_series_outputs")
def _(t):
    from ..sources import layers as L

    path = L.scratch_path(t.spark, "series")
    rows = _series_rows(t)
    lo, hi = t.tx_span
    long = R.daily_series_long(rows, lo, hi)
    wide = R.daily_series_wide(rows, "series_id", R.series_names(rows), lo, hi)
    kinds = R.daily_series_wide(rows.withColumn("kind", F.col("series_type")), "kind", ["own_company", "no_company", "tail_group"], lo, hi)
    L.write_series_outputs(path, long, wide, rows, series_info=R.series_info(rows), company_to_series=R.company_to_series(rows),
                           company_features=_own(t), series_kinds_wide=kinds)
    return t.spark.read.parquet(f"{path}/series_daily_long").groupBy("series_id").agg(F.count("*").alias("days"))



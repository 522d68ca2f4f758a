"""Queries of Gold tables, calendars and business summaries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as C
from ..functions import labels as B
from ..operators import analytics as A
from ..operators import gold as G
from .registry import query
from .tables import GRAIN, RULESET

_G = "ENTITY_SHORTNAME, CURRENCY_SHORTNAME, MOVEMENT_SCOPE"
_ATTR = """isodow(DATE) - 1 AS DAY_OF_WEEK, day(DATE) AS DAY_OF_MONTH, DATE = last_day(DATE) AS IS_MONTH_END,
 day(DATE) = 1 AS IS_MONTH_START, isodow(DATE) >= 6 AS IS_WEEKEND"""
_BUCKET = "CASE WHEN d IS NULL THEN 'missing' " + " ".join(
    f"WHEN d {op} {n} THEN '{name}'" for (op, n), name in zip(
        [("<=", -5), ("=", -4), ("=", -3), ("=", -2), ("=", -1), ("=", 0), ("=", 1), ("=", 2), ("=", 3), ("=", 4), (">=", 5)], B.LAG_BUCKETS)) + " END"


@query("gold_target_amount", "SELECT ID, VALUE_DATE, landed FROM scoped", "landed:4")
def _(t):
    return t.scoped.select("ID", "VALUE_DATE", G.target_amount(RULESET).alias("landed"))


@query("gold_realized", "SELECT * FROM realized_grain", "TARGET_AMOUNT:2")
def _(t):
    return G.gold_realized(t.scoped, RULESET, GRAIN)


@query("gold_known", "SELECT * FROM known_grain", "KNOWN_AMOUNT:2")
def _(t):
    return G.gold_known(t.scoped, RULESET, GRAIN)


@query("gold_build", """SELECT 'realized' AS tbl, CAST(NULL AS DATE) AS TRADE_DATE, VALUE_DATE, TARGET_AMOUNT AS amount, OBSERVATION_COUNT AS n FROM realized
       UNION ALL SELECT 'known', TRADE_DATE, VALUE_DATE, KNOWN_AMOUNT, KNOWN_COUNT FROM known""", "amount:2")
def _(t):
    gold = G.gold_build(t.movements, RULESET)
    realized = gold["realized"].select(F.lit("realized").alias("tbl"), F.lit(None).cast("date").alias("TRADE_DATE"), "VALUE_DATE",
                                       F.col("TARGET_AMOUNT").alias("amount"), F.col("OBSERVATION_COUNT").alias("n"))
    known = gold["known"].select(F.lit("known").alias("tbl"), "TRADE_DATE", "VALUE_DATE", F.col("KNOWN_AMOUNT").alias("amount"), F.col("KNOWN_COUNT").alias("n"))
    return realized.unionByName(known)


@query("calendar_from_gold", f"SELECT DATE, {_ATTR} FROM calendar")
def _(t):
    return t.calendar


@query("calendar_attributes", f"SELECT DATE, {_ATTR} FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS DATE FROM orders)")
def _(t):
    days = t.table("orders").select(F.col("o_orderdate").cast("date").alias("DATE")).distinct()
    return days.select("DATE", *C.calendar_attributes("DATE"))


@query("month_window_flags", """SELECT DATE, day(DATE) <= 3 AS start3, day(DATE) >= 28 OR DATE = last_day(DATE) AS end28,
       day(DATE) <= 5 AS start5, day(DATE) >= day(last_day(DATE)) - 4 AS end5 FROM calendar""")
def _(t):
    return t.calendar.select("DATE", C.month_start("DATE").alias("start3"), C.month_end("DATE").alias("end28"),
                             C.month_start("DATE", 5).alias("start5"), C.month_end_tail("DATE").alias("end5"))


@query("lead_days", """SELECT ID, VALUE_DATE, VALUE_DATE - TRADE_DATE AS lead, VALUE_DATE - TRADE_DATE >= 1 AS known_d1, VALUE_DATE = TRADE_DATE AS same_day FROM movements""", ints="lead")
def _(t):
    lead = C.lead_days("VALUE_DATE", "TRADE_DATE")
    return t.movements.select("ID", "VALUE_DATE", lead.alias("lead"), (lead >= 1).alias("known_d1"), (lead == 0).alias("same_day"))


@query("lag_bucket", f"SELECT ID, VALUE_DATE, {_BUCKET} AS bucket FROM (SELECT *, nullif(TRADE_DATE - VALUE_DATE, 2) AS d FROM movements)")
def _(t):
    d = F.nullif(F.datediff("TRADE_DATE", "VALUE_DATE"), F.lit(2))
    return t.movements.select("ID", "VALUE_DATE", B.lag_bucket(d).alias("bucket"))


@query("dense_label_panel", f"SELECT DATE, {_ATTR}, coalesce(TARGET_AMOUNT, 0) AS TARGET_AMOUNT FROM calendar LEFT JOIN final_labels USING (DATE)", "TARGET_AMOUNT:2")
def _(t):
    labels = t.realized.select(F.col("VALUE_DATE").alias("DATE"), "TARGET_AMOUNT")
    return G.dense_label_panel(t.calendar, labels)


_PANEL = """SELECT d.DATE AS VALUE_DATE, coalesce(sum(r.TARGET_AMOUNT), 0) AS TARGET_AMOUNT, coalesce(sum(r.OBSERVATION_COUNT), 0) AS OBSERVATION_COUNT
 FROM (SELECT DATE FROM calendar WHERE DATE BETWEEN DATE '1999-06-01' AND DATE '2000-02-29') d
 LEFT JOIN realized_grain r ON r.VALUE_DATE = d.DATE AND r.ENTITY_SHORTNAME = 'NATION_5' GROUP BY d.DATE"""


@query("complete_daily_panel", _PANEL, "TARGET_AMOUNT:2", "OBSERVATION_COUNT")
def _(t):
    return G.complete_daily_panel(t.realized_grain, "realized", entity="NATION_5", start="1999-06-01", end="2000-02-29")


@query("complete_gold_panels", """SELECT 'realized' AS tbl, c.DATE AS VALUE_DATE, coalesce(sum(TARGET_AMOUNT), 0) AS amount, coalesce(sum(OBSERVATION_COUNT), 0) AS n
       FROM (SELECT DATE FROM calendar WHERE DATE BETWEEN (SELECT min(VALUE_DATE) FROM realized) AND (SELECT max(VALUE_DATE) FROM realized)) c LEFT JOIN realized r ON r.VALUE_DATE = c.DATE GROUP BY c.DATE
       UNION ALL SELECT 'known', c.DATE, coalesce(sum(KNOWN_AMOUNT), 0), coalesce(sum(KNOWN_COUNT), 0)
       FROM (SELECT DATE FROM calendar WHERE DATE BETWEEN (SELECT min(VALUE_DATE) FROM known) AND (SELECT max(VALUE_DATE) FROM known)) c LEFT JOIN known k ON k.VALUE_DATE = c.DATE GROUP BY c.DATE""", "amount:2", "n")
def _(t):
    panels = G.complete_gold_panels(t.gold)
    parts = [panels[n].toDF("VALUE_DATE", "amount", "n").withColumn("tbl", F.lit(n)) for n in panels]
    return parts[0].unionByName(parts[1])


@query("discover_dimensions", f"""SELECT d.*, (SELECT min(VALUE_DATE) FROM known) AS GOLD_MIN_DATE, (SELECT max(VALUE_DATE) FROM known) AS GOLD_MAX_DATE FROM (
       SELECT DISTINCT {_G}, 'gold' AS SOURCE FROM known_grain UNION ALL
       SELECT DISTINCT ENTITY_SHORTNAME, NULL, NULL, 'silver' FROM movements) d""")
def _(t):
    return G.discover_dimensions(t.gold_grain, t.movements)


@query("gold_date_range", "SELECT min(VALUE_DATE) AS GOLD_MIN_DATE, max(VALUE_DATE) AS GOLD_MAX_DATE FROM (SELECT VALUE_DATE FROM known UNION ALL SELECT VALUE_DATE FROM realized)")
def _(t):
    return G.gold_date_range(t.gold)


# --- business summaries ---


@query("zero_count_guardrail", """SELECT 'realized' AS TABLE_NAME, count(*) AS RAW_ROWS, count(*) FILTER (n > 0) AS CLEANED_ROWS, count(*) FILTER (n = 0) AS ZERO_COUNT_ROWS_REMOVED,
       count(*) FILTER (n = 0) / count(*) AS ZERO_COUNT_ROW_SHARE FROM (SELECT coalesce(nullif(OBSERVATION_COUNT, 10), 0) AS n FROM realized)
       UNION ALL SELECT 'known', count(*), count(*) FILTER (n > 0), count(*) FILTER (n = 0), count(*) FILTER (n = 0) / count(*)
       FROM (SELECT coalesce(nullif(KNOWN_COUNT, 3), 0) AS n FROM known)""", "ZERO_COUNT_ROW_SHARE:8")
def _(t):
    return G.zero_count_guardrail({
        "realized": (t.realized.withColumn("OBSERVATION_COUNT", F.nullif("OBSERVATION_COUNT", F.lit(10))), "OBSERVATION_COUNT"),
        "known": (t.known.withColumn("KNOWN_COUNT", F.nullif("KNOWN_COUNT", F.lit(3))), "KNOWN_COUNT")})


_STEPS = [("silver_input", "true"), ("after_APPLICATIVE_STATUS_SHORTNAME", "lower(APPLICATIVE_STATUS_SHORTNAME) IN ('o', 'f')"),
          ("after_CASH_MOVEMENT_TYPE_SHORTNAME", "lower(CASH_MOVEMENT_TYPE_SHORTNAME) <> 'n+'"),
          ("after_DESCRIPTION", "NOT contains(lower(DESCRIPTION), 'lamp')"), ("after_movement_scope", "CASH_MOVEMENT_TYPE_SHORTNAME IS NOT NULL")]


def _waterfall_sql():
    parts = []
    for i, (name, cond) in enumerate(_STEPS):
        before = " AND ".join(c for _, c in _STEPS[:i]) or "true"
        m = lambda w: (f"count(*) FILTER ({w})", f"coalesce(sum(SIGNED_AMOUNT) FILTER ({w}), 0)", f"coalesce(sum(abs(SIGNED_AMOUNT)) FILTER ({w}), 0)")
        k, r = m(f"{before} AND {cond}"), m(f"{before} AND NOT ({cond})")
        r = r if i else ("NULL", "NULL", "NULL")
        parts.append(f"""SELECT {i} AS STEP_NUMBER, '{name}' AS RULE_STEP, {k[0]} AS ROWS, {k[1]} AS SIGNED_AMOUNT, {k[2]} AS ABS_SIGNED_AMOUNT,
          {r[0]} AS ROWS_REMOVED, {r[1]} AS SIGNED_AMOUNT_REMOVED, {r[2]} AS ABS_SIGNED_AMOUNT_REMOVED,
          count(DISTINCT ENTITY_SHORTNAME) FILTER ({before} AND {cond}) AS ENTITY_COUNT, count(DISTINCT CURRENCY_SHORTNAME) FILTER ({before} AND {cond}) AS CURRENCY_COUNT,
          count(DISTINCT CASH_MOVEMENT_TYPE_SHORTNAME) FILTER ({before} AND {cond}) AS MOVEMENT_TYPE_COUNT FROM movements""")
    return " UNION ALL ".join(parts)


@query("rule_waterfall", _waterfall_sql(), "SIGNED_AMOUNT,ABS_SIGNED_AMOUNT,SIGNED_AMOUNT_REMOVED,ABS_SIGNED_AMOUNT_REMOVED:2",
       "ROWS ROWS_REMOVED ENTITY_COUNT CURRENCY_COUNT MOVEMENT_TYPE_COUNT")
def _(t):
    return A.rule_waterfall(t.movements, RULESET)


def _light_sql():
    parts = []
    for i, (name, cond) in enumerate(_STEPS[1:4]):
        before = " AND ".join(c for _, c in _STEPS[: i + 1])
        parts.append(f"""SELECT {i} AS position, '{name[6:]}' AS rule, 'applied' AS status, count(*) FILTER ({before}) AS before,
          count(*) FILTER ({before} AND NOT ({cond})) AS removed, count(*) FILTER ({before} AND {cond}) AS after FROM movements""")
    return " UNION ALL ".join(parts)


@query("rule_waterfall_light", _light_sql(), ints="before removed after")
def _(t):
    return A.rule_waterfall_light(t.movements, RULESET)


@query("trade_value_lag_summary", f"""SELECT {_G}, {_BUCKET} AS TRADE_VALUE_LAG_BUCKET, count(*) AS AGGREGATE_ROWS, sum(KNOWN_COUNT) AS SOURCE_ROWS,
       sum(KNOWN_AMOUNT) AS KNOWN_AMOUNT, sum(abs(KNOWN_AMOUNT)) AS ABS_KNOWN_AMOUNT FROM (SELECT *, TRADE_DATE - VALUE_DATE AS d FROM known_grain) GROUP BY ALL""",
       "KNOWN_AMOUNT,ABS_KNOWN_AMOUNT:2", "SOURCE_ROWS")
def _(t):
    return A.trade_value_lag_summary(t.known_grain)


_BUCKET_LIST = ", ".join(f"('{b}')" for b in B.LAG_BUCKETS)


@query("lag_bucket_matrix", f"""SELECT m.MOVEMENT_SCOPE, b.b AS TRADE_VALUE_LAG_BUCKET, coalesce(sum(k.KNOWN_COUNT), 0) AS RAW_VALUE,
       100.0 * coalesce(sum(k.KNOWN_COUNT), 0) / max(m.n) AS ROW_PERCENT FROM (SELECT MOVEMENT_SCOPE, sum(KNOWN_COUNT) AS n FROM known_grain GROUP BY 1) m
       CROSS JOIN (VALUES {_BUCKET_LIST}) b(b) LEFT JOIN (SELECT *, {_BUCKET} AS bucket FROM (SELECT *, TRADE_DATE - VALUE_DATE AS d FROM known_grain)) k
       ON k.MOVEMENT_SCOPE = m.MOVEMENT_SCOPE AND k.bucket = b.b GROUP BY 1, 2""", "ROW_PERCENT:6", "RAW_VALUE")
def _(t):
    return A.lag_bucket_matrix(A.trade_value_lag_summary(t.known_grain))


_AVAIL = """count(DISTINCT r.VALUE_DATE) AS DAYS, sum(TARGET_AMOUNT) AS TARGET_AMOUNT, sum(abs(TARGET_AMOUNT)) AS ABS_TARGET_AMOUNT,
 sum(abs(coalesce(ka, 0))) AS ABS_KNOWN_AT_CUTOFF_AMOUNT, sum(abs(coalesce(la, 0))) AS ABS_LATE_AFTER_CUTOFF_AMOUNT, sum(coalesce(ka, 0)) AS KNOWN_AT_CUTOFF_AMOUNT,
 sum(coalesce(la, 0)) AS LATE_AFTER_CUTOFF_AMOUNT, sum(coalesce(kn, 0)) AS KNOWN_AT_CUTOFF_COUNT, sum(coalesce(ln, 0)) AS LATE_AFTER_CUTOFF_COUNT,
 sum(coalesce(sa, 0)) AS SAME_DAY_AMOUNT, sum(coalesce(ad, 0)) AS ADVANCE_KNOWN_AMOUNT, sum(coalesce(av, 0)) AS AFTER_VALUE_AMOUNT,
 sum(abs(coalesce(ka, 0))) / nullif(sum(abs(TARGET_AMOUNT)), 0) AS KNOWN_COVERAGE_RATIO_ABS, sum(abs(coalesce(la, 0))) / nullif(sum(abs(TARGET_AMOUNT)), 0) AS LATE_AFTER_CUTOFF_RATIO_ABS"""
_KD = """SELECT ENTITY_SHORTNAME, CURRENCY_SHORTNAME, MOVEMENT_SCOPE, VALUE_DATE, sum(KNOWN_AMOUNT) FILTER (TRADE_DATE <= VALUE_DATE - 1) AS ka, sum(KNOWN_COUNT) FILTER (TRADE_DATE <= VALUE_DATE - 1) AS kn,
 sum(KNOWN_AMOUNT) FILTER (TRADE_DATE > VALUE_DATE - 1) AS la, sum(KNOWN_COUNT) FILTER (TRADE_DATE > VALUE_DATE - 1) AS ln, sum(KNOWN_AMOUNT) FILTER (TRADE_DATE = VALUE_DATE) AS sa,
 sum(KNOWN_AMOUNT) FILTER (TRADE_DATE < VALUE_DATE) AS ad, sum(KNOWN_AMOUNT) FILTER (TRADE_DATE > VALUE_DATE) AS av FROM known_grain GROUP BY ALL"""


@query("availability_summary", f"SELECT {_G}, {_AVAIL} FROM realized_grain r LEFT JOIN ({_KD}) k USING ({_G}, VALUE_DATE) GROUP BY ALL",
       "TARGET_AMOUNT,ABS_TARGET_AMOUNT,ABS_KNOWN_AT_CUTOFF_AMOUNT,ABS_LATE_AFTER_CUTOFF_AMOUNT,KNOWN_AT_CUTOFF_AMOUNT,LATE_AFTER_CUTOFF_AMOUNT,SAME_DAY_AMOUNT,ADVANCE_KNOWN_AMOUNT,AFTER_VALUE_AMOUNT:2 KNOWN_COVERAGE_RATIO_ABS,LATE_AFTER_CUTOFF_RATIO_ABS:8",
       "KNOWN_AT_CUTOFF_COUNT LATE_AFTER_CUTOFF_COUNT")
def _(t):
    return A.availability_summary(t.realized_grain, t.known_grain)


@query("join_left_known_on_realized", f"SELECT {_G}, VALUE_DATE, TARGET_AMOUNT, ka AS KNOWN_AT_CUTOFF_AMOUNT FROM realized_grain r LEFT JOIN ({_KD}) k USING ({_G}, VALUE_DATE)",
       "TARGET_AMOUNT,KNOWN_AT_CUTOFF_AMOUNT:2")
def _(t):
    keys = [*GRAIN, "VALUE_DATE"]
    in_time = A.known_at_cutoff(t.known_grain, GRAIN).select(*keys, F.nullif("KNOWN_AT_CUTOFF_AMOUNT", F.lit(0.0)).alias("KNOWN_AT_CUTOFF_AMOUNT"))
    return A.join_known_on_realized(t.realized_grain.drop("OBSERVATION_COUNT"), in_time, keys)


@query("known_vs_realized_daily", """SELECT VALUE_DATE, 'TARGET_AMOUNT' AS SERIES, TARGET_AMOUNT AS AMOUNT FROM realized
       UNION ALL SELECT r.VALUE_DATE, 'KNOWN_AT_CUTOFF_AMOUNT', coalesce(sum(k.KNOWN_AMOUNT), 0) FROM realized r LEFT JOIN known k ON k.VALUE_DATE = r.VALUE_DATE AND k.TRADE_DATE <= r.VALUE_DATE - 1 GROUP BY 1""", "AMOUNT:2")
def _(t):
    return A.known_vs_realized_daily(t.realized, t.known)


@query("concentration_summary", f"""SELECT *, ABS_TARGET_AMOUNT / sum(ABS_TARGET_AMOUNT) OVER () AS AMOUNT_SHARE, OBSERVATION_COUNT / sum(OBSERVATION_COUNT) OVER () AS COUNT_SHARE,
       sum(ABS_TARGET_AMOUNT) OVER (ORDER BY ABS_TARGET_AMOUNT DESC) / sum(ABS_TARGET_AMOUNT) OVER () AS CUMULATIVE_AMOUNT_SHARE, row_number() OVER (ORDER BY ABS_TARGET_AMOUNT DESC) AS AMOUNT_RANK
       FROM (SELECT {_G}, count(DISTINCT VALUE_DATE) AS DAYS, count(DISTINCT VALUE_DATE) FILTER (OBSERVATION_COUNT > 0) AS ACTIVE_DAYS,
       count(DISTINCT VALUE_DATE) - count(DISTINCT VALUE_DATE) FILTER (OBSERVATION_COUNT > 0) AS ZERO_DAYS, CAST(sum(OBSERVATION_COUNT) AS DOUBLE) AS OBSERVATION_COUNT,
       sum(TARGET_AMOUNT) AS TARGET_AMOUNT, sum(abs(TARGET_AMOUNT)) AS ABS_TARGET_AMOUNT, avg(abs(TARGET_AMOUNT)) AS AVG_ACTIVE_ABS_AMOUNT FROM realized_grain GROUP BY ALL)""",
       "TARGET_AMOUNT,ABS_TARGET_AMOUNT:2 AVG_ACTIVE_ABS_AMOUNT:3 AMOUNT_SHARE,COUNT_SHARE,CUMULATIVE_AMOUNT_SHARE:8")
def _(t):
    return A.concentration_summary(t.realized_grain)


_SPARSE = "SELECT DATE, coalesce(TARGET_AMOUNT, 0) AS y FROM calendar LEFT JOIN realized ON VALUE_DATE = DATE WHERE DATE BETWEEN (SELECT min(VALUE_DATE) FROM realized) AND (SELECT max(VALUE_DATE) FROM realized)"


@query("forecastability", f"""SELECT count(*) AS DAYS, count(*) FILTER (y <> 0) AS ACTIVE_DAYS, count(*) FILTER (y <> 0) / count(*) AS ACTIVE_DAY_RATIO, count(*) FILTER (y = 0) AS ZERO_DAYS,
       min(DATE) FILTER (y <> 0) AS FIRST_ACTIVE_DATE, max(DATE) FILTER (y <> 0) AS LAST_ACTIVE_DATE, sum(y) AS TOTAL_AMOUNT, sum(abs(y)) AS ABS_TOTAL_AMOUNT, avg(abs(y)) FILTER (y <> 0) AS AVG_ACTIVE_ABS_AMOUNT,
       stddev_pop(y) AS STD_DAILY_AMOUNT, quantile_cont(abs(y), 0.99) FILTER (y <> 0) AS P99_ACTIVE_ABS_AMOUNT,
       (SELECT coalesce(max(n), 0) FROM (SELECT count(*) AS n FROM (SELECT DATE, DATE - CAST(row_number() OVER (ORDER BY DATE) AS INT) AS g FROM ({_SPARSE}) WHERE y = 0) GROUP BY g)) AS MAX_ZERO_RUN_DAYS,
       CASE WHEN ACTIVE_DAY_RATIO = 0 THEN 'no_activity' WHEN ACTIVE_DAY_RATIO < 0.02 THEN 'very_sparse' WHEN ACTIVE_DAY_RATIO < 0.2 THEN 'intermittent' ELSE 'regular' END AS INTERMITTENCY_CLASS FROM ({_SPARSE})""",
       "ACTIVE_DAY_RATIO:8 TOTAL_AMOUNT,ABS_TOTAL_AMOUNT:2 AVG_ACTIVE_ABS_AMOUNT,STD_DAILY_AMOUNT,P99_ACTIVE_ABS_AMOUNT:3", "MAX_ZERO_RUN_DAYS")
def _(t):
    return A.forecastability(t.realized)


@query("operational_timing", """SELECT ENTITY_SHORTNAME, CASH_MOVEMENT_TYPE_SHORTNAME, 'TRADE_TO_VALUE_DAYS' AS TIMING_METRIC, count(*) AS ROWS, avg(d) AS MEAN_DAYS, quantile_cont(d, 0.05) AS P05_DAYS,
       quantile_cont(d, 0.5) AS P50_DAYS, quantile_cont(d, 0.95) AS P95_DAYS, CAST(min(d) AS DOUBLE) AS MIN_DAYS, CAST(max(d) AS DOUBLE) AS MAX_DAYS
       FROM (SELECT *, VALUE_DATE - TRADE_DATE AS d FROM scoped) GROUP BY ALL""", "MEAN_DAYS,P05_DAYS,P50_DAYS,P95_DAYS:6")
def _(t):
    return A.operational_timing(t.scoped)


@query("topk_spike_days", f"SELECT {_G}, VALUE_DATE, TARGET_AMOUNT, abs(TARGET_AMOUNT) AS ABS_TARGET_AMOUNT, OBSERVATION_COUNT FROM realized_grain WHERE OBSERVATION_COUNT > 0 ORDER BY round(abs(TARGET_AMOUNT), 3) DESC, VALUE_DATE, {_G} LIMIT 50",
       "TARGET_AMOUNT,ABS_TARGET_AMOUNT:2")
def _(t):
    return A.top_spike_days(t.realized_grain)


_TOP2 = "SELECT MOVEMENT_SCOPE FROM realized_grain GROUP BY 1 ORDER BY sum(abs({m})) DESC LIMIT 2"


@query("topk_movements", f"SELECT * FROM realized_grain WHERE MOVEMENT_SCOPE IN ({_TOP2.format(m='TARGET_AMOUNT')})", "TARGET_AMOUNT:2")
def _(t):
    return A.top_movements(t.realized_grain, "TARGET_AMOUNT", top_n=2).select(t.realized_grain.columns)


for _name, _m in (("amount", "TARGET_AMOUNT"), ("count", "OBSERVATION_COUNT")):
    _digits, _ints = ("TARGET_AMOUNT:2", "") if _name == "amount" else ("", "OBSERVATION_COUNT")

    @query(f"daily_{_name}_by_movement", f"SELECT VALUE_DATE, MOVEMENT_SCOPE, sum({_m}) AS {_m} FROM realized_grain WHERE MOVEMENT_SCOPE IN ({_TOP2.format(m=_m)}) GROUP BY ALL", _digits, _ints)
    def _(t, m=_m):
        return A.daily_by_movement(t.realized_grain, m, top_n=2)

    @query(f"total_{_name}_by_movement", f"SELECT MOVEMENT_SCOPE, sum({_m}) AS {_m} FROM realized_grain GROUP BY ALL", _digits, _ints)
    def _(t, m=_m):
        return A.total_by_movement(t.realized_grain, m)


@query("monthly_trend", "SELECT CAST(date_trunc('month', VALUE_DATE) AS DATE) AS MONTH, MOVEMENT_SCOPE, sum(TARGET_AMOUNT) AS TARGET_AMOUNT FROM realized_grain GROUP BY ALL", "TARGET_AMOUNT:2")
def _(t):
    return A.monthly_trend(t.realized_grain)


@query("weekday_profile", "SELECT isodow(VALUE_DATE) - 1 AS WEEKDAY_NUM, dayname(VALUE_DATE) AS WEEKDAY, avg(abs(TARGET_AMOUNT)) AS ABS_TARGET_AMOUNT FROM realized_grain GROUP BY ALL", "ABS_TARGET_AMOUNT:3")
def _(t):
    return A.weekday_profile(t.realized_grain)

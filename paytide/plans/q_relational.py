"""Queries of the join, aggregation, window, top-k and set shapes."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import labels as B
from ..functions import text as X
from ..operators import analytics as A
from ..operators import evaluate as E
from ..operators import quantiles as Q
from ..operators import relational as R
from ..operators import stats as T
from .registry import query

_REPEATED = "SELECT ID FROM movements GROUP BY ID HAVING count(*) > 1"


def _repeated(t):
    return t.movements.groupBy("ID").count().filter("count > 1").select("ID")


def _bounds(t):
    lo = t.realized.agg(F.min("VALUE_DATE")).scalar()
    hi = t.realized.agg(F.max("VALUE_DATE")).scalar()
    return lo, hi


# --- joins ---


@query("join_left_calendar", "SELECT DATE, coalesce(TARGET_AMOUNT, 0) AS TARGET_AMOUNT, coalesce(OBSERVATION_COUNT, 0) AS OBSERVATION_COUNT FROM calendar LEFT JOIN realized ON VALUE_DATE = DATE", "TARGET_AMOUNT:2")
def _(t):
    return t.calendar.select("DATE").join(t.realized.withColumnRenamed("VALUE_DATE", "DATE"), "DATE", "left").fillna(0)


@query("join_inner_alignment", "SELECT a.CUTOFF_DATE, a.FORECAST_DATE, a.PREDICTION AS BASE_NAIVE_PREDICTION, b.PREDICTION AS BASE_KNOWN_PREDICTION FROM preds a JOIN preds b USING (CUTOFF_DATE, FORECAST_DATE) WHERE a.RUN_NAME = 'naive_last_day' AND b.RUN_NAME = 'known_amount_d1'",
       "BASE_NAIVE_PREDICTION,BASE_KNOWN_PREDICTION:2")
def _(t):
    keys = ["CUTOFF_DATE", "FORECAST_DATE"]
    run = lambda name, alias: t.predictions.filter(F.col("RUN_NAME") == name).select(*keys, F.col("PREDICTION").alias(alias))
    return run("naive_last_day", "BASE_NAIVE_PREDICTION").join(run("known_amount_d1", "BASE_KNOWN_PREDICTION"), keys)


@query("join_left_passthrough", "SELECT p.CUTOFF_DATE, p.PREDICTION, e.TARGET_LAG_7 AS ANCHOR_TARGET_LAG_7, e.DAY_OF_WEEK AS ANCHOR_DAY_OF_WEEK FROM preds p LEFT JOIN eval_rows e USING (CUTOFF_DATE, FORECAST_DATE) WHERE RUN_NAME = 'moving_average'",
       "PREDICTION:4 ANCHOR_TARGET_LAG_7:2")
def _(t):
    from ..operators.ensembles import append_passthrough

    meta = t.predictions.filter("RUN_NAME = 'moving_average'").select("CUTOFF_DATE", "FORECAST_DATE", "PREDICTION")
    return append_passthrough(meta, t.eval_rows.select("CUTOFF_DATE", "FORECAST_DATE", "TARGET_LAG_7", "DAY_OF_WEEK")).drop("FORECAST_DATE")


@query("join_many_to_one_checked", "SELECT l_orderkey, l_linenumber, l_extendedprice, o_custkey FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey")
def _(t):
    lines = t.table("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_extendedprice")
    joined = R.join_many_to_one(lines, t.table("orders").select("o_orderkey", "o_custkey"), ["o_orderkey"])
    return joined.withColumnRenamed("o_orderkey", "l_orderkey")


_DENSE = """SELECT d.DATE AS VALUE_DATE, s.ENTITY_SHORTNAME, coalesce(sum(r.TARGET_AMOUNT), 0) AS TARGET_AMOUNT FROM (SELECT DATE FROM calendar WHERE DATE BETWEEN (SELECT min(VALUE_DATE) FROM realized) AND (SELECT max(VALUE_DATE) FROM realized)) d
 CROSS JOIN (SELECT DISTINCT ENTITY_SHORTNAME FROM realized_grain) s LEFT JOIN realized_grain r ON r.VALUE_DATE = d.DATE AND r.ENTITY_SHORTNAME = s.ENTITY_SHORTNAME GROUP BY 1, 2"""


@query("join_cross_grid", _DENSE, "TARGET_AMOUNT:2")
def _(t):
    return R.densify(t.realized_grain, "ENTITY_SHORTNAME", "TARGET_AMOUNT", *_bounds(t))


@query("join_semi_ids", f"SELECT ID, AMOUNT FROM movements WHERE ID IN ({_REPEATED})")
def _(t):
    return t.movements.join(_repeated(t), "ID", "left_semi").select("ID", "AMOUNT")


@query("join_anti_ids", f"SELECT ID, AMOUNT FROM movements WHERE ID NOT IN ({_REPEATED})")
def _(t):
    return t.movements.join(_repeated(t), "ID", "left_anti").select("ID", "AMOUNT")


@query("join_outer_wide", "SELECT VALUE_DATE, coalesce(a.x, 0) AS refunds, coalesce(b.y, 0) AS others FROM (SELECT VALUE_DATE, sum(TARGET_AMOUNT) AS x FROM realized_grain WHERE MOVEMENT_SCOPE = 'REFUND' GROUP BY 1) a FULL JOIN (SELECT VALUE_DATE, sum(TARGET_AMOUNT) AS y FROM realized_grain WHERE MOVEMENT_SCOPE <> 'REFUND' GROUP BY 1) b USING (VALUE_DATE)",
       "refunds,others:2")
def _(t):
    part = lambda cond, name: t.realized_grain.filter(cond).groupBy("VALUE_DATE").agg(F.sum("TARGET_AMOUNT").alias(name))
    return part("MOVEMENT_SCOPE = 'REFUND'", "refunds").join(part("MOVEMENT_SCOPE <> 'REFUND'", "others"), "VALUE_DATE", "full").fillna(0.0)


# --- aggregations ---

_M = "nullif(ACCOUNT_SHORTNAME, 'Brand#3')"


def _accounts(t):
    return t.movements.withColumn("ACCOUNT", F.nullif("ACCOUNT_SHORTNAME", F.lit("Brand#3")))


@query("agg_hash_group", f"SELECT {_M} AS ACCOUNT, coalesce(sum(SIGNED_AMOUNT), 0) AS total, count(nullif(ID, '1-1')) AS n FROM movements GROUP BY 1", "total:2")
def _(t):
    return _accounts(t).groupBy("ACCOUNT").agg(F.coalesce(F.sum("SIGNED_AMOUNT"), F.lit(0.0)).alias("total"), F.count(F.nullif("ID", F.lit("1-1"))).alias("n"))


@query("agg_count_distinct", f"SELECT ENTITY_SHORTNAME, count(DISTINCT {_M}) AS accounts, count(DISTINCT CPTY_NAME) AS parties FROM movements GROUP BY 1")
def _(t):
    return _accounts(t).groupBy("ENTITY_SHORTNAME").agg(F.countDistinct("ACCOUNT").alias("accounts"), F.countDistinct("CPTY_NAME").alias("parties"))


@query("agg_quantile_exact", "SELECT CASH_MOVEMENT_TYPE_SHORTNAME AS kind, quantile_cont(AMOUNT, 0.9) AS p90, quantile_cont(AMOUNT, 0.99) AS p99 FROM movements GROUP BY 1", "p90,p99:4")
def _(t):
    rows = t.movements.withColumnRenamed("CASH_MOVEMENT_TYPE_SHORTNAME", "kind")
    return Q.exact_quantiles(rows, "AMOUNT", {"p90": 0.9, "p99": 0.99}, ["kind"])


@query("agg_median", "SELECT ENTITY_SHORTNAME, median(AMOUNT) AS m FROM movements GROUP BY 1", "m:4")
def _(t):
    return Q.exact_quantiles(t.movements, "AMOUNT", {"m": 0.5}, ["ENTITY_SHORTNAME"])


@query("agg_std_pop", "SELECT ENTITY_SHORTNAME, stddev_pop(AMOUNT) AS s FROM movements GROUP BY 1", "s:4")
def _(t):
    return t.movements.groupBy("ENTITY_SHORTNAME").agg(F.stddev_pop("AMOUNT").alias("s"))


@query("agg_var_pop", "SELECT ENTITY_SHORTNAME, var_pop(AMOUNT) AS v FROM movements GROUP BY 1", "v:1")
def _(t):
    return t.movements.groupBy("ENTITY_SHORTNAME").agg(F.var_pop("AMOUNT").alias("v"))


@query("agg_weighted_quantile", """SELECT q AS PROBABILITY, CASE WHEN lo IS NULL THEN hiv WHEN hi IS NULL THEN lov ELSE lov + (q - lo) / (hi - lo) * (hiv - lov) END AS VALUE FROM (SELECT q, max(c) FILTER (c <= q) AS lo, min(c) FILTER (c > q) AS hi, max(v) FILTER (c <= q) AS lov, min(v) FILTER (c > q) AS hiv
       FROM (SELECT v, sum(w) OVER (ORDER BY v) / sum(w) OVER () AS c FROM (SELECT AMOUNT AS v, sum(AMOUNT) AS w FROM movements GROUP BY 1)), (VALUES (0.2::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) p(q) GROUP BY q)""", "PROBABILITY:2 VALUE:3")
def _(t):
    return Q.weighted_quantiles(t.movements, "AMOUNT", F.col("AMOUNT"), (0.2, 0.5, 0.9))


_ENT = "SELECT CPTY_NAME, {v} AS v, count(*) AS n FROM movements GROUP BY 1, 2"


@query("agg_entropy_normalized", f"SELECT CPTY_NAME, CASE WHEN count(*) <= 1 THEN 0 ELSE -sum(n / t * ln(n / t)) / ln(count(*)) END AS h FROM (SELECT *, sum(n) OVER (PARTITION BY CPTY_NAME) AS t FROM ({_ENT.format(v='isodow(VALUE_DATE)')})) GROUP BY 1", "h:8")
def _(t):
    rows = t.movements.select("CPTY_NAME", F.weekday("VALUE_DATE").alias("d"))
    return T.entropy_normalized(rows, "d", ["CPTY_NAME"]).select("CPTY_NAME", F.col("ENTROPY").alias("h"))


@query("agg_top_share", f"SELECT CPTY_NAME, max(n) / sum(n) AS share FROM ({_ENT.format(v='day(VALUE_DATE)')}) GROUP BY 1", "share:8")
def _(t):
    counts = T.class_counts(F.day("VALUE_DATE"), T.MONTH_DAYS)
    return t.movements.groupBy("CPTY_NAME").agg(T.top_share_of_counts(counts).alias("share"))


@query("agg_cv2", "SELECT CPTY_NAME, CASE WHEN count(*) > 1 AND abs(avg(AMOUNT)) >= 1e-12 THEN pow(stddev_samp(AMOUNT) / avg(AMOUNT), 2) END AS cv2 FROM movements GROUP BY 1", "cv2:8")
def _(t):
    return t.movements.groupBy("CPTY_NAME").agg(T.cv2("AMOUNT").alias("cv2"))


@query("agg_hhi", "SELECT CPTY_NAME, sum(AMOUNT * AMOUNT) / pow(sum(AMOUNT), 2) AS hhi FROM movements GROUP BY 1", "hhi:8")
def _(t):
    return t.movements.groupBy("CPTY_NAME").agg(T.hhi("AMOUNT").alias("hhi"))


@query("agg_first_by_order", "SELECT CPTY_NAME, arg_min(ACCOUNT_SHORTNAME, (VALUE_DATE, ID, AMOUNT)) AS ACCOUNT_SHORTNAME FROM movements GROUP BY 1")
def _(t):
    return R.first_by_order(t.movements, ["CPTY_NAME"], "ACCOUNT_SHORTNAME", ["VALUE_DATE", "ID", "AMOUNT"])


@query("agg_conditional_sum", "SELECT VALUE_DATE, coalesce(sum(KNOWN_AMOUNT) FILTER (TRADE_DATE < VALUE_DATE), 0) AS ahead, coalesce(sum(KNOWN_AMOUNT) FILTER (TRADE_DATE > VALUE_DATE), 0) AS late FROM known GROUP BY 1", "ahead,late:2")
def _(t):
    part = lambda c: F.sum(F.when(c, F.col("KNOWN_AMOUNT")).otherwise(0.0))
    return t.known.groupBy("VALUE_DATE").agg(part(F.col("TRADE_DATE") < F.col("VALUE_DATE")).alias("ahead"), part(F.col("TRADE_DATE") > F.col("VALUE_DATE")).alias("late"))


@query("agg_pivot", "SELECT VALUE_DATE, coalesce(sum(TARGET_AMOUNT) FILTER (MOVEMENT_SCOPE = 'REFUND'), 0) AS REFUND, coalesce(sum(TARGET_AMOUNT) FILTER (MOVEMENT_SCOPE = 'A+'), 0) AS A_PLUS FROM realized_grain GROUP BY 1", "REFUND,A_PLUS:2")
def _(t):
    wide = R.wide_table(t.realized_grain, "MOVEMENT_SCOPE", ["REFUND", "A+"], "TARGET_AMOUNT")
    return wide.withColumnRenamed("A+", "A_PLUS")


@query("agg_unpivot", "SELECT CUTOFF_DATE, 'TARGET_LAG_1' AS F, TARGET_LAG_1 AS X FROM all_rows UNION ALL SELECT CUTOFF_DATE, 'TARGET_LAG_7', TARGET_LAG_7 FROM all_rows", "X:2")
def _(t):
    return t.all_rows.unpivot(["CUTOFF_DATE"], ["TARGET_LAG_1", "TARGET_LAG_7"], "F", "X")


@query("agg_string_sample", "SELECT ENTITY_SHORTNAME, string_agg(CPTY_NAME, ' | ' ORDER BY r) AS sample FROM (SELECT *, row_number() OVER (PARTITION BY ENTITY_SHORTNAME ORDER BY round(a, 2) DESC, CPTY_NAME) AS r FROM (SELECT ENTITY_SHORTNAME, CPTY_NAME, sum(AMOUNT) AS a FROM movements GROUP BY 1, 2)) WHERE r <= 3 GROUP BY 1")
def _(t):
    return R.string_sample(t.movements, ["ENTITY_SHORTNAME"], "CPTY_NAME", "AMOUNT", 3)


@query("agg_value_counts", f"SELECT {_M} AS ACCOUNT, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM movements GROUP BY 1", "share:8")
def _(t):
    return R.value_counts(_accounts(t), "ACCOUNT")


# --- windows ---

_DAYS = "SELECT CPTY_NAME, VALUE_DATE, sum(AMOUNT) AS a FROM movements GROUP BY 1, 2"


def _days(t):
    return t.movements.groupBy("CPTY_NAME", "VALUE_DATE").agg(F.sum("AMOUNT").alias("a"))


@query("win_row_number_top", "SELECT CPTY_NAME, VALUE_DATE, a FROM (SELECT *, row_number() OVER (PARTITION BY CPTY_NAME ORDER BY round(a, 2) DESC, VALUE_DATE) AS r FROM (" + _DAYS + ")) WHERE r = 1", "a:2")
def _(t):
    w = Window.partitionBy("CPTY_NAME").orderBy(F.desc(F.round("a", 2)), "VALUE_DATE")
    return _days(t).withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


@query("win_group_total", f"SELECT *, sum(a) OVER (PARTITION BY CPTY_NAME) AS total, a / sum(a) OVER (PARTITION BY CPTY_NAME) AS share FROM ({_DAYS})", "a,total:2 share:8")
def _(t):
    totals = t.movements.groupBy("CPTY_NAME").agg(F.sum("AMOUNT").alias("total"))
    return Q.attach(_days(t), totals, ["CPTY_NAME"]).withColumn("share", F.col("a") / F.col("total"))


@query("win_cumsum", "SELECT AMOUNT, sum(n) OVER (ORDER BY AMOUNT) AS running, sum(v) OVER (ORDER BY AMOUNT) AS amount_running FROM (SELECT AMOUNT, count(*) AS n, sum(AMOUNT) AS v FROM movements GROUP BY 1)", "amount_running:2", "running")
def _(t):
    out = Q.cumulative_by_value(t.movements, "AMOUNT", {"N": F.count("*"), "V": F.sum("AMOUNT")})
    return out.select("AMOUNT", F.col("N_THROUGH").alias("running"), F.col("V_THROUGH").alias("amount_running"))


@query("win_rank_pct", "SELECT CPTY_NAME, n, (rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2) / count(*) OVER () AS pct FROM (SELECT CPTY_NAME, count(*) AS n FROM movements GROUP BY 1)", "pct:8")
def _(t):
    return Q.percent_ranks(t.movements.groupBy("CPTY_NAME").agg(F.count("*").alias("n")), {"n": "pct"})


@query("win_sequence_rank", "SELECT CPTY_NAME, concat('AUTO_', printf('%02d', row_number() OVER (ORDER BY round(a, 2) DESC, CPTY_NAME))) AS label FROM (SELECT CPTY_NAME, sum(AMOUNT) AS a FROM movements GROUP BY 1)")
def _(t):
    totals = t.movements.groupBy("CPTY_NAME").agg(F.round(F.sum("AMOUNT"), 2).alias("a"))
    return R.numbered(totals, [F.desc("a"), F.asc("CPTY_NAME")]).select("CPTY_NAME", R.sequence_label("AUTO_", "_number").alias("label"))


@query("win_diff", f"SELECT CPTY_NAME, VALUE_DATE, a - lag(a) OVER w AS da, VALUE_DATE - lag(VALUE_DATE) OVER w AS GAP FROM ({_DAYS}) WINDOW w AS (PARTITION BY CPTY_NAME ORDER BY VALUE_DATE)", "da:2", "GAP")
def _(t):
    w = Window.partitionBy("CPTY_NAME").orderBy("VALUE_DATE")
    return T.with_gaps(_days(t).withColumn("da", F.col("a") - F.lag("a").over(w)), ["CPTY_NAME"], "VALUE_DATE").drop("a")


_ENTITY_DAYS = f"SELECT VALUE_DATE, ENTITY_SHORTNAME, TARGET_AMOUNT AS y FROM ({_DENSE})"


def _entity_days(t):
    return R.densify(t.realized_grain, "ENTITY_SHORTNAME", "TARGET_AMOUNT", *_bounds(t)).withColumnRenamed("TARGET_AMOUNT", "y")


@query("win_trailing_mean", f"SELECT ENTITY_SHORTNAME, VALUE_DATE, avg(y) OVER (PARTITION BY ENTITY_SHORTNAME ORDER BY VALUE_DATE ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS m FROM ({_ENTITY_DAYS})", "m:5")
def _(t):
    w = Window.partitionBy("ENTITY_SHORTNAME").orderBy("VALUE_DATE").rowsBetween(-6, 0)
    return _entity_days(t).select("ENTITY_SHORTNAME", "VALUE_DATE", F.avg("y").over(w).alias("m"))


@query("win_longest_run", f"SELECT ENTITY_SHORTNAME, max(n) AS LONGEST_RUN FROM (SELECT ENTITY_SHORTNAME, g, count(*) AS n FROM (SELECT ENTITY_SHORTNAME, VALUE_DATE - CAST(row_number() OVER (PARTITION BY ENTITY_SHORTNAME ORDER BY VALUE_DATE) AS INT) AS g FROM ({_ENTITY_DAYS}) WHERE y <> 0) GROUP BY 1, 2) GROUP BY 1")
def _(t):
    return A.runs(_entity_days(t), F.col("y") != 0, ["ENTITY_SHORTNAME"])


@query("win_autocorr", f"SELECT ENTITY_SHORTNAME, corr(y, l1) AS lag_1, corr(y, l7) AS lag_7 FROM (SELECT *, lag(y, 1) OVER w AS l1, lag(y, 7) OVER w AS l7 FROM ({_ENTITY_DAYS}) WINDOW w AS (PARTITION BY ENTITY_SHORTNAME ORDER BY VALUE_DATE)) GROUP BY 1", "lag_1,lag_7:8")
def _(t):
    return E.autocorrelations(_entity_days(t), "y", (1, 7), "VALUE_DATE", ["ENTITY_SHORTNAME"])


# --- order, top-k, sets ---


@query("sort_nulls_last", "SELECT ID, TRADE_DATE, VALUE_DATE FROM movements ORDER BY nullif(TRADE_DATE, DATE '1994-12-30') ASC NULLS LAST, VALUE_DATE, ID, AMOUNT")
def _(t):
    early = F.nullif("TRADE_DATE", F.lit("1994-12-30").cast("date"))
    ordered = t.movements.orderBy(early.asc_nulls_last(), F.asc_nulls_last("VALUE_DATE"), F.asc_nulls_last("ID"), "AMOUNT")
    return ordered.select("ID", "TRADE_DATE", "VALUE_DATE")


@query("topk_share_of_rows", "SELECT 0.1::DOUBLE AS TOP_DAY_SHARE, greatest(1, CAST(round_even(count(*) * 0.1, 0) AS BIGINT)) AS DAY_COUNT, (SELECT sum(y) FROM (SELECT TARGET_AMOUNT AS y FROM realized ORDER BY y DESC LIMIT (SELECT greatest(1, CAST(round_even(count(*) * 0.1, 0) AS BIGINT)) FROM realized))) / sum(TARGET_AMOUNT) AS ACTUAL_AMOUNT_SHARE FROM realized", "ACTUAL_AMOUNT_SHARE:8")
def _(t):
    return R.top_share_of_rows(t.realized, "TARGET_AMOUNT", "VALUE_DATE", [0.1], "TARGET_AMOUNT")


@query("topk_per_group", "SELECT ENTITY_SHORTNAME, CPTY_NAME, a FROM (SELECT *, row_number() OVER (PARTITION BY ENTITY_SHORTNAME ORDER BY round(a, 2) DESC, CPTY_NAME) AS r FROM (SELECT ENTITY_SHORTNAME, CPTY_NAME, sum(AMOUNT) AS a FROM movements GROUP BY 1, 2)) WHERE r <= 4", "a:2")
def _(t):
    totals = t.movements.groupBy("ENTITY_SHORTNAME", "CPTY_NAME").agg(F.sum("AMOUNT").alias("a"))
    w = Window.partitionBy("ENTITY_SHORTNAME").orderBy(F.desc(F.round("a", 2)), "CPTY_NAME")
    return totals.withColumn("r", F.row_number().over(w)).filter("r <= 4").drop("r")


@query("set_union_by_name", "SELECT VALUE_DATE, TARGET_AMOUNT, NULL::DOUBLE AS KNOWN_AMOUNT FROM realized UNION ALL SELECT VALUE_DATE, NULL, KNOWN_AMOUNT FROM known", "TARGET_AMOUNT,KNOWN_AMOUNT:2")
def _(t):
    return t.realized.select("VALUE_DATE", "TARGET_AMOUNT").unionByName(t.known.select("KNOWN_AMOUNT", "VALUE_DATE"), allowMissingColumns=True)


@query("set_distinct", "SELECT DISTINCT ENTITY_SHORTNAME, CURRENCY_SHORTNAME, APPLICATIVE_STATUS_SHORTNAME FROM movements")
def _(t):
    return t.movements.select("ENTITY_SHORTNAME", "CURRENCY_SHORTNAME", "APPLICATIVE_STATUS_SHORTNAME").distinct()


@query("set_except_check", "SELECT DISTINCT ID FROM movements WHERE ID NOT IN (SELECT ID FROM ruled)")
def _(t):
    return R.not_in(t.movements, t.scoped, "ID")


@query("set_intersect_dates", "SELECT VALUE_DATE FROM realized_grain GROUP BY 1 HAVING count(DISTINCT MOVEMENT_SCOPE) = (SELECT count(DISTINCT MOVEMENT_SCOPE) FROM realized_grain)")
def _(t):
    return R.common_values(t.realized_grain, "VALUE_DATE", "MOVEMENT_SCOPE")


# --- scalar functions ---

_NORM = "trim(regexp_replace(upper(strip_accents({c})), '[^A-Z0-9]+', ' ', 'g'))"


@query("normalize_text", f"SELECT p_partkey, nullif({_NORM.format(c='''concat(' Crème-Brûlée ', p_name, '_', p_type, ' ñ')''')}, '') AS x, nullif({_NORM.format(c='''CASE WHEN p_size > 25 THEN '--' ELSE p_brand END''')}, '') AS y FROM part")
def _(t):
    p = t.table("part")
    return p.select("p_partkey", X.normalize_text(F.concat(F.lit(" Crème-Brûlée "), "p_name", F.lit("_"), "p_type", F.lit(" ñ"))).alias("x"),
                    X.normalize_text(F.when(F.col("p_size") > 25, "--").otherwise(F.col("p_brand"))).alias("y"))


_FORMS = "CASE p_size % 8 WHEN 0 THEN concat(p_name, ' S.A.U.') WHEN 1 THEN concat(p_name, ' Ltd') WHEN 2 THEN '123 456' WHEN 3 THEN concat('Incoming ', p_name) WHEN 4 THEN concat('12 34 56 789 ', p_name) WHEN 5 THEN concat(p_name, ' Co., Ltd.') WHEN 6 THEN concat('123456789', p_name) ELSE p_name END"


def _company_sql(c, digits):
    name = f"upper({_NORM.format(c=c)})"
    for form in X.LEGAL_FORMS:
        name = f"regexp_replace({name}, '{form}', ' ', 'g')"
    return f"(SELECT CASE WHEN n = '' OR regexp_full_match(n, '\\d+') OR regexp_full_match(trim(n[1:9]), '{digits}') OR starts_with(n, 'INCOMING') THEN NULL ELSE n END FROM (SELECT trim(regexp_replace({name}, '\\s+', ' ', 'g')) AS n))"


@query("normalize_company", f"SELECT p_partkey, {_company_sql('f', '(?:[0-9] *)+')} AS a, {_company_sql('f', '[0-9]+')} AS b FROM (SELECT p_partkey, {_FORMS} AS f FROM part)")
def _(t):
    f = F.expr(_FORMS)
    return t.table("part").select("p_partkey", X.normalize_company(f).alias("a"), X.normalize_company(f, spaced_digits=False).alias("b"))


_TEXTS = "CASE p_size % 5 WHEN 0 THEN concat('Transferencia de  ', p_name, ', ref') WHEN 1 THEN concat('x/pt/ft/bo/', p_name, '/y') WHEN 2 THEN concat('/BO/ ', p_name, ' /z') WHEN 3 THEN concat(p_name, '/12') ELSE '123/BO/77' END"


@query("extract_company", f"""SELECT p_partkey, coalesce({', '.join(f"(SELECT CASE WHEN m <> '' AND NOT regexp_full_match(m, '[0-9]+') THEN m END FROM (SELECT trim(regexp_extract(f, '{p}', 1)) AS m))" for p in X.COMPANY_PATTERNS)}) AS company FROM (SELECT p_partkey, {_TEXTS} AS f FROM part)""")
def _(t):
    return t.table("part").select("p_partkey", X.extract_company(F.expr(_TEXTS)).alias("company"))


@query("first_non_empty_text", "SELECT p_partkey, coalesce(nullif(trim(CASE WHEN p_size < 20 THEN '  ' ELSE p_name END), ''), nullif(trim(p_brand), '')) AS x FROM part")
def _(t):
    return t.table("part").select("p_partkey", X.first_non_empty_text(F.when(F.col("p_size") < 20, "  ").otherwise(F.col("p_name")), "p_brand").alias("x"))


@query("sanitize_label", f"SELECT p_partkey, left(coalesce(nullif(replace({_NORM.format(c='p_name')}, ' ', '_'), ''), 'UNKNOWN'), 8) AS x, coalesce(nullif(replace({_NORM.format(c='''CASE WHEN p_size > 9 THEN '!' ELSE p_type END''')}, ' ', '_'), ''), 'UNKNOWN') AS y FROM part")
def _(t):
    return t.table("part").select("p_partkey", X.sanitize_label("p_name", 8).alias("x"), X.sanitize_label(F.when(F.col("p_size") > 9, "!").otherwise(F.col("p_type"))).alias("y"))


@query("simple_company_name", "SELECT p_partkey, regexp_replace(upper(trim(concat(' ', p_name, '   ', p_brand))), '\\s+', ' ', 'g') AS x FROM part")
def _(t):
    return t.table("part").select("p_partkey", X.simple_company_name(F.concat(F.lit(" "), "p_name", F.lit("   "), "p_brand")).alias("x"))


@query("amount_bin_fixed", "SELECT ID, AMOUNT, CASE WHEN AMOUNT < 20000 THEN 'low' WHEN AMOUNT < 100000 THEN 'medium' WHEN AMOUNT < 1000000 THEN 'high' ELSE 'huge' END AS bin FROM movements")
def _(t):
    return t.movements.select("ID", "AMOUNT", B.amount_bin("AMOUNT").alias("bin"))


@query("sbc_label", "SELECT VALUE_DATE, CASE WHEN a IS NULL THEN 'unknown' WHEN a < 1.32 AND v < 0.49 THEN 'smooth' WHEN a < 1.32 THEN 'erratic' WHEN v < 0.49 THEN 'intermittent' ELSE 'lumpy' END AS label FROM (SELECT VALUE_DATE, nullif(OBSERVATION_COUNT, 20) / 12 AS a, KNOWN / 3 AS v FROM (SELECT VALUE_DATE, OBSERVATION_COUNT, OBSERVATION_COUNT % 4 AS KNOWN FROM realized))")
def _(t):
    n = F.col("OBSERVATION_COUNT")
    return t.realized.select("VALUE_DATE", B.sbc_label(F.nullif(n, F.lit(20)) / 12, n % 4 / 3).alias("label"))


@query("intermittency_class", "SELECT VALUE_DATE, CASE WHEN r = 0 THEN 'no_activity' WHEN r < 0.02 THEN 'very_sparse' WHEN r < 0.2 THEN 'intermittent' ELSE 'regular' END AS c FROM (SELECT VALUE_DATE, (OBSERVATION_COUNT % 30) / 100 AS r FROM realized)")
def _(t):
    return t.realized.select("VALUE_DATE", B.intermittency_class(F.col("OBSERVATION_COUNT") % 30 / 100).alias("c"))


@query("safe_divide", "SELECT VALUE_DATE, TARGET_AMOUNT / nullif(OBSERVATION_COUNT % 3, 0) AS x, CASE WHEN OBSERVATION_COUNT % 3 = 0 THEN 0.0 ELSE TARGET_AMOUNT / (OBSERVATION_COUNT % 3) END AS y FROM realized", "x,y:4")
def _(t):
    d = F.col("OBSERVATION_COUNT") % 3
    return t.realized.select("VALUE_DATE", B.safe_divide("TARGET_AMOUNT", d).alias("x"), B.safe_divide("TARGET_AMOUNT", d, scalar=True).alias("y"))

"""Queries of sources, sinks, parsing, quality flags and row filters."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsing as P
from ..operators import gold as G
from ..operators import rules as R
from ..operators import silver as S
from ..sources import bronze as B
from ..sources import layers as L
from .registry import query
from .tables import RULESET

# --- checking SQL of the text parsers ---


def _strip(c):
    return f"regexp_replace({c}, '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g')"


def _text(c):
    s = _strip(c)
    return f"(CASE WHEN lower({s}) IN ('', 'na', 'null', 'none', 'nan') THEN NULL ELSE {s} END)"


def _num(c):
    return f"TRY_CAST(replace(replace(replace({c}, chr(160), ''), ' ', ''), ',', '.') AS DOUBLE)"


def _int(c):
    return f"CAST(round_even({_num(_text(c))}, 0) AS BIGINT)"


def _date(c):
    formats = ("%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%Y-%d-%m", "%d.%m.%Y", "%Y/%m/%d", "%Y%m%d")
    tries = ", ".join(f"try_strptime({_text(c)}, '{f}')" for f in formats)
    return f"CAST(coalesce({tries}) AS DATE)"


_TEXT_COLUMNS = ("ID", "ENTITY_SHORTNAME", "SCOPE_NAME", "APPLICATIVE_STATUS_SHORTNAME", "CASH_MOVEMENT_TYPE_SHORTNAME",
                 "CURRENCY_SHORTNAME", "ACCOUNT_SHORTNAME", "BANK_SHORTNAME", "ANALYTIC_TYPE_SHORTNAME", "DESCRIPTION")
_PARSED = ", ".join(
    [f"{_text(c)} AS {c}" for c in _TEXT_COLUMNS]
    + [f"{_date(c)} AS {c}" for c in ("TRADE_DATE", "VALUE_DATE")]
    + [f"{_num(_text(c))} AS {c}" for c in ("AMOUNT", "SIGNED_AMOUNT")]
    + [f"{_int('SIGN')} AS SIGN", "source_name"]
)
_SILVER_RAW = f"""
SELECT *, (ID IS NULL OR ENTITY_SHORTNAME IS NULL OR SCOPE_NAME IS NULL OR APPLICATIVE_STATUS_SHORTNAME IS NULL
  OR CASH_MOVEMENT_TYPE_SHORTNAME IS NULL OR CURRENCY_SHORTNAME IS NULL OR ACCOUNT_SHORTNAME IS NULL OR BANK_SHORTNAME IS NULL
  OR ANALYTIC_TYPE_SHORTNAME IS NULL OR TRADE_DATE IS NULL OR VALUE_DATE IS NULL OR AMOUNT IS NULL OR SIGN IS NULL
  OR DESCRIPTION IS NULL) AS missing_required,
  coalesce(VALUE_DATE < TRADE_DATE, false) AS reversed_dates,
  coalesce(abs(SIGNED_AMOUNT - AMOUNT * SIGN) > 0.01, false) AS signed_mismatch,
  count(*) OVER (PARTITION BY ENTITY_SHORTNAME, ID) > 1 AS duplicate_id
FROM (SELECT {_PARSED} FROM bronze_raw)"""
_SILVER_COLUMNS = "ID, ENTITY_SHORTNAME, TRADE_DATE, VALUE_DATE, AMOUNT, SIGN, SIGNED_AMOUNT"
_FLAGS = {"missing_required": S.MISSING_REQUIRED, "reversed_dates": S.REVERSED_DATES,
          "signed_mismatch": S.SIGNED_MISMATCH, "duplicate_id": S.DUPLICATE_ID}


def _with_source(t):
    return t.bronze.withColumnRenamed("source_name", S.LINEAGE_SOURCE)


def _named_flags(df, *names):
    return [F.col(_FLAGS[n]).alias(n) for n in names]


# --- sources and sinks ---


@query("read_bronze", """SELECT APPLICATIVE_STATUS_SHORTNAME, CASH_MOVEMENT_TYPE_SHORTNAME, count(*) AS n, count(DISTINCT AMOUNT) AS amounts
       FROM bronze_raw WHERE APPLICATIVE_STATUS_SHORTNAME IN ('O', 'F') GROUP BY 1, 2""")
def _(t):
    path = L.scratch_path(t.spark, "bronze")
    raw = t.bronze
    plain = [c for c in raw.columns if c != "source_name"]
    by_status = lambda s: raw.filter(F.col("APPLICATIVE_STATUS_SHORTNAME") == s)
    for status, columns in (("O", plain), ("F", plain[::-1])):
        by_status(status).select(columns).write.option("header", True).option("sep", ";").csv(f"{path}/{status}")
    got = B.read_bronze(t.spark, f"{path}/*")
    return got.groupBy("APPLICATIVE_STATUS_SHORTNAME", "CASH_MOVEMENT_TYPE_SHORTNAME").agg(
        F.count("*").alias("n"), F.countDistinct("AMOUNT").alias("amounts"))


@query("add_lineage", "SELECT count(*) AS n, count(*) AS numbers, count(*) AS last FROM bronze_raw")
def _(t):
    path = L.scratch_path(t.spark, "lineage")
    t.bronze.drop("source_name").write.option("header", True).option("sep", ";").csv(path)
    got = B.read_bronze(t.spark, path, same_header=True)
    per_file = got.groupBy(S.LINEAGE_SOURCE).agg(
        F.count("*").alias("n"), F.countDistinct(S.LINEAGE_ROW).alias("numbers"), F.max(S.LINEAGE_ROW).alias("last"))
    return per_file.agg(*[F.sum(c).alias(c) for c in ("n", "numbers", "last")])  # equal when every file counts 1, 2, 3 and on


@query("read_extract_csv", "SELECT ID, CAST(VALUE_DATE AS VARCHAR) AS VALUE_DATE, CAST(AMOUNT AS VARCHAR) AS AMOUNT FROM movements")
def _(t):
    path = L.scratch_path(t.spark, "extract")
    t.movements.withColumnRenamed("ID", " ID ").write.option("header", True).csv(path)
    return B.read_extract_csv(t.spark, path).select("ID", "VALUE_DATE", "AMOUNT")


@query("write_silver")
def _(t):
    path = L.scratch_path(t.spark, "silver")
    L.write_silver(t.silver, path)
    L.write_reports(path, entities=S.silver_entity_report(t.silver))
    return t.spark.read.json(f"{path}/_reports/entities")


@query("read_silver", "SELECT ID, ENTITY_SHORTNAME, TRADE_DATE, VALUE_DATE, AMOUNT, duplicate_id FROM silver")
def _(t):
    path = L.scratch_path(t.spark, "silver")
    L.write_silver(t.silver, path)
    got = L.read_silver(t.spark, path)
    return got.select("ID", "ENTITY_SHORTNAME", "TRADE_DATE", "VALUE_DATE", "AMOUNT", *_named_flags(got, "duplicate_id"))


@query("load_silver_normalized", "SELECT ID, ENTITY_SHORTNAME, TRADE_DATE, VALUE_DATE, AMOUNT, CAST(SIGN AS DOUBLE) AS SIGN FROM silver")
def _(t):
    path = L.scratch_path(t.spark, "silver")
    L.write_silver(t.silver, path)
    return L.load_silver_normalized(t.spark, path).select("ID", "ENTITY_SHORTNAME", "TRADE_DATE", "VALUE_DATE", "AMOUNT", "SIGN")


@query("write_gold", """SELECT 'gold' AS layer, 'realized' AS table_name, count(*) AS row_count FROM realized
       UNION ALL SELECT 'gold', 'known', count(*) FROM known""")
def _(t):
    path = L.scratch_path(t.spark, "gold")
    L.write_gold(t.gold, path)
    return S.build_manifest("gold", **L.read_gold(t.spark, path))


@query("read_gold", "SELECT k.TRADE_DATE, VALUE_DATE, KNOWN_AMOUNT, KNOWN_COUNT, TARGET_AMOUNT FROM known k JOIN realized r USING (VALUE_DATE)",
       "KNOWN_AMOUNT,TARGET_AMOUNT:2")
def _(t):
    path = L.scratch_path(t.spark, "gold")
    L.write_gold(t.gold, path)
    gold = L.read_gold(t.spark, path)
    return gold["known"].join(gold["realized"].drop("OBSERVATION_COUNT"), "VALUE_DATE")


@query("load_gold_normalized", "SELECT TRADE_DATE, VALUE_DATE, KNOWN_AMOUNT, CAST(KNOWN_COUNT AS DOUBLE) AS KNOWN_COUNT FROM known", "KNOWN_AMOUNT:2")
def _(t):
    path = L.scratch_path(t.spark, "gold")
    L.write_gold({"known": t.known.withColumn("VALUE_DATE", F.col("VALUE_DATE").cast("string")), "realized": t.realized}, path)
    return L.load_gold_normalized(t.spark, path)["known"]


@query("build_manifest", """SELECT 'gold' AS layer, 'realized' AS table_name, count(*) AS row_count FROM realized
       UNION ALL SELECT 'gold', 'known', count(*) FROM known""")
def _(t):
    return S.build_manifest("gold", **t.gold)


@query("write_dataset", "SELECT strftime(CUTOFF_DATE, '%Y-%m') AS CUTOFF_MONTH, count(*) AS count FROM eval_rows GROUP BY 1")
def _(t):
    path = L.scratch_path(t.spark, "dataset")
    L.write_dataset(t.eval_rows, path)
    return t.spark.read.parquet(path).groupBy("CUTOFF_MONTH").count()


def _runs(t):
    return t.predictions.withColumnRenamed("RUN_NAME", "MODEL_NAME").withColumn("CUSTOM_NAME", F.lit("default"))


@query("write_backtest", "SELECT RUN_NAME AS MODEL_NAME, 'default' AS CUSTOM_NAME, count(*) AS count FROM preds GROUP BY 1")
def _(t):
    path = L.scratch_path(t.spark, "backtests")
    L.write_predictions(_runs(t), path)
    L.write_predictions(_runs(t).filter("MODEL_NAME = 'moving_average'"), path)
    return t.spark.read.parquet(path).groupBy("MODEL_NAME", "CUSTOM_NAME").count()


@query("write_forecast", "SELECT CUTOFF_DATE, count(*) AS count FROM preds GROUP BY 1")
def _(t):
    path = L.scratch_path(t.spark, "forecasts")
    L.write_forecast(t.predictions.select("RUN_NAME", "CUTOFF_DATE", "FORECAST_DATE", "PREDICTION"), path)
    return t.spark.read.parquet(path).groupBy("CUTOFF_DATE").count()


@query("scan_prediction_runs", """SELECT concat('MODEL_NAME=', RUN_NAME, '/CUSTOM_NAME=default') AS RUN_NAME, FORECAST_DATE,
       PREDICTION FROM preds""", "PREDICTION:4")
def _(t):
    path = L.scratch_path(t.spark, "backtests")
    L.write_predictions(_runs(t), path)
    return L.scan_prediction_runs(t.spark, path).select("RUN_NAME", "FORECAST_DATE", "PREDICTION")


# --- parsing ---


@query("normalize_columns", "SELECT r_regionkey AS R_REGIONKEY, r_name AS R_NAME FROM region")
def _(t):
    return P.normalize_columns(t.table("region").toDF(" r_regionkey", "r_name "))


@query("validate_required_columns", """SELECT 'complete' AS given, count(*) AS rows_checked, '' AS message FROM movements
       UNION ALL SELECT 'without ID', count(*), 'movements: required columns are absent: ID' FROM movements""")
def _(t):
    """A given table, whole and with a required column dropped."""

    def checked(given, df):
        try:
            t.shape.check(df.columns)
            message = ""
        except ValueError as e:
            message = str(e)
        return df.agg(F.count("*").alias("rows_checked")).select(F.lit(given).alias("given"), "rows_checked", F.lit(message).alias("message"))

    return checked("complete", t.movements).union(checked("without ID", t.movements.drop("ID")))


@query("conform_schema", f"SELECT {_SILVER_COLUMNS}, CAST(NULL AS STRING) AS COUNTRY_SHORTNAME, source_name FROM (SELECT {_PARSED} FROM bronze_raw)")
def _(t):
    names = [c.strip() for c in _SILVER_COLUMNS.split(",")]
    got = S.conform_schema(t.bronze)
    return got.select(*names, "COUNTRY_SHORTNAME", F.col("SOURCE_NAME").alias("source_name"))


@query("clean_text", f"SELECT {_text('ID')} AS ID, {_text('ENTITY_SHORTNAME')} AS ENTITY, {_text('ANALYTIC_TYPE_SHORTNAME')} AS ANALYTIC FROM bronze_raw")
def _(t):
    return t.bronze.select(P.clean_text("ID").alias("ID"), P.clean_text("ENTITY_SHORTNAME").alias("ENTITY"),
                           P.clean_text("ANALYTIC_TYPE_SHORTNAME").alias("ANALYTIC"))


@query("parse_float", f"SELECT {_text('ID')} AS ID, {_num(_text('AMOUNT'))} AS AMOUNT, {_num(_text('SIGNED_AMOUNT'))} AS SIGNED_AMOUNT FROM bronze_raw")
def _(t):
    return t.bronze.select(P.clean_text("ID").alias("ID"), P.parse_float("AMOUNT").alias("AMOUNT"), P.parse_float("SIGNED_AMOUNT").alias("SIGNED_AMOUNT"))


@query("parse_amount", f"SELECT {_text('ID')} AS ID, {_num('AMOUNT')} AS AMOUNT FROM bronze_raw")
def _(t):
    return t.bronze.select(P.clean_text("ID").alias("ID"), P.parse_amount("AMOUNT").alias("AMOUNT"))


@query("parse_int", f"SELECT {_text('ID')} AS ID, {_int('SIGN')} AS SIGN, {_int('AMOUNT')} AS WHOLE_AMOUNT FROM bronze_raw")
def _(t):
    return t.bronze.select(P.clean_text("ID").alias("ID"), P.parse_int("SIGN").alias("SIGN"), P.parse_int("AMOUNT").alias("WHOLE_AMOUNT"))


@query("parse_date", f"SELECT {_text('ID')} AS ID, {_date('TRADE_DATE')} AS TRADE_DATE, {_date('VALUE_DATE')} AS VALUE_DATE FROM bronze_raw")
def _(t):
    return t.bronze.select(P.clean_text("ID").alias("ID"), P.parse_date("TRADE_DATE").alias("TRADE_DATE"), P.parse_date("VALUE_DATE").alias("VALUE_DATE"))


@query("parse_category", f"SELECT {_text('ENTITY_SHORTNAME')} AS ENTITY, count(*) AS n FROM bronze_raw GROUP BY 1")
def _(t):
    return t.bronze.select(P.PARSERS["category"]("ENTITY_SHORTNAME").alias("ENTITY")).groupBy("ENTITY").agg(F.count("*").alias("n"))


_ISSUES = " UNION ALL ".join(
    f"SELECT source_name, '{c}' AS column_name, count(*) AS issue_count FROM bronze_raw WHERE {_text(c)} IS NOT NULL AND {p} IS NULL GROUP BY source_name"
    for c, p in [(c, _date(c)) for c in ("TRADE_DATE", "VALUE_DATE")] + [(c, _num(_text(c))) for c in ("AMOUNT", "SIGNED_AMOUNT", "SIGN")]
)


@query("parse_issue_counts", f"SELECT *, 'parse_error' AS issue_type FROM ({_ISSUES})")
def _(t):
    return S.parse_issue_counts(_with_source(t), by=S.LINEAGE_SOURCE).withColumnRenamed(S.LINEAGE_SOURCE, "source_name")


# --- quality flags and reports ---


@query("flag_missing_required", f"SELECT ID, missing_required FROM ({_SILVER_RAW})")
def _(t):
    return S.conform_schema(t.bronze).select("ID", S.missing_required().alias("missing_required"))


@query("flag_reversed_dates", f"SELECT ID, reversed_dates FROM ({_SILVER_RAW})")
def _(t):
    return S.conform_schema(t.bronze).select("ID", S.reversed_dates().alias("reversed_dates"))


@query("flag_signed_mismatch", f"SELECT ID, signed_mismatch FROM ({_SILVER_RAW})")
def _(t):
    return S.conform_schema(t.bronze).select("ID", S.signed_mismatch().alias("signed_mismatch"))


@query("flag_duplicate_ids", f"SELECT ID, ENTITY_SHORTNAME, duplicate_id FROM ({_SILVER_RAW})")
def _(t):
    return S.flag_duplicate_ids(S.conform_schema(t.bronze), flag="duplicate_id").select("ID", "ENTITY_SHORTNAME", "duplicate_id")


@query("silver_build", f"SELECT {_SILVER_COLUMNS}, missing_required, reversed_dates, signed_mismatch, duplicate_id FROM ({_SILVER_RAW})")
def _(t):
    built = S.clustered_by_entity(S.silver_build(_with_source(t)))
    return built.select(*[c.strip() for c in _SILVER_COLUMNS.split(",")],
                        *_named_flags(built, "missing_required", "reversed_dates", "signed_mismatch", "duplicate_id"))


@query("silver_source_report", f"""SELECT source_name AS table_name, count(*) AS row_count, count(*) FILTER (missing_required) AS missing_required_rows,
       count(*) FILTER (reversed_dates) AS value_before_trade_rows, count(*) FILTER (signed_mismatch) AS signed_amount_mismatch_rows
       FROM ({_SILVER_RAW}) GROUP BY 1""")
def _(t):
    return S.silver_source_report(S.quality_flags(S.conform_schema(_with_source(t))))


@query("silver_entity_report", f"""SELECT coalesce(ENTITY_SHORTNAME, 'UNKNOWN') AS entity, count(*) AS row_count,
       count(*) FILTER (missing_required) AS missing_required_rows, count(*) FILTER (duplicate_id) AS duplicate_id_rows,
       count(*) FILTER (reversed_dates) AS value_before_trade_rows, count(*) FILTER (signed_mismatch) AS signed_amount_mismatch_rows
       FROM ({_SILVER_RAW}) GROUP BY 1""")
def _(t):
    return S.silver_entity_report(S.silver_build(_with_source(t)))


@query("normalize_table", "SELECT VALUE_DATE, KNOWN_AMOUNT, CAST(KNOWN_COUNT AS DOUBLE) AS KNOWN_COUNT FROM known", "KNOWN_AMOUNT:2")
def _(t):
    rough = t.known.select(F.concat(F.col("VALUE_DATE").cast("string"), F.lit(" 13:30:00")).alias("VALUE_DATE"), "KNOWN_AMOUNT",
                           F.concat(F.lit(" "), F.col("KNOWN_COUNT").cast("string")).alias("KNOWN_COUNT"))
    return L.normalize_table(rough)


# --- filters ---

_MAYBE = "nullif(ACCOUNT_SHORTNAME, 'Brand#3')"


def _maybe(t):
    return t.movements.withColumn("ACCOUNT", F.nullif("ACCOUNT_SHORTNAME", F.lit("Brand#3"))).select("ID", "ACCOUNT")


@query("rule_include", f"SELECT ID, {_MAYBE} AS ACCOUNT FROM movements WHERE lower({_MAYBE}) IN ('brand#1', 'brand#3')")
def _(t):
    return _maybe(t).filter(R.rule_condition("ACCOUNT", R.ColumnRule(include_values=("BRAND#1", "Brand#3"))))


@query("rule_exclude", f"SELECT ID, {_MAYBE} AS ACCOUNT FROM movements WHERE {_MAYBE} IS NULL OR lower({_MAYBE}) NOT IN ('brand#1', 'brand#2')")
def _(t):
    return _maybe(t).filter(R.rule_condition("ACCOUNT", R.ColumnRule(exclude_values=("BRAND#1", "Brand#2"))))


@query("rule_exclude_contains", f"SELECT ID, {_MAYBE} AS ACCOUNT FROM movements WHERE {_MAYBE} IS NULL OR NOT contains(lower({_MAYBE}), 'd#1')")
def _(t):
    return _maybe(t).filter(R.rule_condition("ACCOUNT", R.ColumnRule(exclude_contains=("D#1", ".*"))))


@query("ruleset_filter", "SELECT ID, CASH_MOVEMENT_TYPE_SHORTNAME, AMOUNT FROM ruled")
def _(t):
    return R.ruleset_filter(t.movements, RULESET).select("ID", "CASH_MOVEMENT_TYPE_SHORTNAME", "AMOUNT")


@query("movement_scope", "SELECT ID, MOVEMENT_SCOPE FROM scoped")
def _(t):
    return t.scoped.select("ID", "MOVEMENT_SCOPE")


@query("drop_zero_count_rows", "SELECT VALUE_DATE, nullif(OBSERVATION_COUNT, 10) AS N FROM realized WHERE coalesce(nullif(OBSERVATION_COUNT, 10), 0) > 0")
def _(t):
    return G.drop_zero_count_rows(t.realized.select("VALUE_DATE", F.nullif("OBSERVATION_COUNT", F.lit(10)).alias("N")), "N")


@query("filter_entity", "SELECT * FROM realized_grain WHERE ENTITY_SHORTNAME = 'NATION_7'", "TARGET_AMOUNT:2")
def _(t):
    return G.filter_entity(t.realized_grain, "NATION_7").select(t.realized_grain.columns)


@query("filter_date_window", "SELECT * FROM known WHERE VALUE_DATE BETWEEN DATE '1999-01-01' AND DATE '1999-12-31'", "KNOWN_AMOUNT:2")
def _(t):
    return G.filter_date_window(t.known, "VALUE_DATE", "1999-01-01", "1999-12-31")


_WB = ("full", "90", "365d", "6m", "2y", "1999-01-01:1999-06-30")


@query("window_bounds", """SELECT 'full' AS WINDOW_LABEL, CAST(NULL AS DATE) AS START_DATE, CAST(NULL AS DATE) AS END_DATE
       UNION ALL SELECT '90', hi - 89, hi FROM (SELECT max(VALUE_DATE) AS hi FROM known) UNION ALL SELECT '365d', hi - 364, hi FROM (SELECT max(VALUE_DATE) AS hi FROM known)
       UNION ALL SELECT '6m', CAST(hi - INTERVAL 6 MONTH AS DATE), hi FROM (SELECT max(VALUE_DATE) AS hi FROM known) UNION ALL SELECT '2y', CAST(hi - INTERVAL 2 YEAR AS DATE), hi FROM (SELECT max(VALUE_DATE) AS hi FROM known)
       UNION ALL SELECT '1999-01-01:1999-06-30', DATE '1999-01-01', DATE '1999-06-30'""")
def _(t):
    out = None
    for label in _WB:
        part = G.window_bounds(t.gold, label).withColumn("WINDOW_LABEL", F.lit(label))
        out = part if out is None else out.unionByName(part)
    return out


@query("observed_tables_for_entity", """SELECT VALUE_DATE, 'realized' AS tbl, TARGET_AMOUNT AS amount FROM realized_grain WHERE ENTITY_SHORTNAME = 'NATION_3' AND VALUE_DATE >= DATE '2000-01-01'
       UNION ALL SELECT VALUE_DATE, 'known', KNOWN_AMOUNT FROM known_grain WHERE ENTITY_SHORTNAME = 'NATION_3' AND VALUE_DATE >= DATE '2000-01-01'""", "amount:2")
def _(t):
    got = G.observed_tables_for_entity(t.gold_grain, entity="NATION_3", start="2000-01-01")
    parts = [got[n].select("VALUE_DATE", F.lit(n).alias("tbl"), F.col(G.CONTRACTS[n][1]).alias("amount")) for n in got]
    return parts[0].unionByName(parts[1])


@query("drop_id_duplicates", """SELECT ID, TRADE_DATE, VALUE_DATE, AMOUNT, SIGN FROM (SELECT *, row_number() OVER (PARTITION BY ID ORDER BY TRADE_DATE, VALUE_DATE, AMOUNT, SIGN) AS rn
       FROM movements) WHERE rn = 1""")
def _(t):
    return S.drop_id_duplicates(t.movements.select("ID", "TRADE_DATE", "VALUE_DATE", "AMOUNT", "SIGN"))

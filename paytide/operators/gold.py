"""Daily aggregates that keep when an amount became known."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import calendar_attributes
from .rules import Ruleset, movement_scope, ruleset_filter

VALUE, TRADE = "VALUE_DATE", "TRADE_DATE"
TARGET, OBSERVED = "TARGET_AMOUNT", "OBSERVATION_COUNT"
KNOWN, KNOWN_COUNT = "KNOWN_AMOUNT", "KNOWN_COUNT"

# Date, amount and count column of each daily table.
CONTRACTS = {"realized": (VALUE, TARGET, OBSERVED), "known": (VALUE, KNOWN, KNOWN_COUNT)}


def target_amount(ruleset: Ruleset) -> Column:
    fallback = F.col("AMOUNT") * F.col("SIGN").cast("double")
    return F.coalesce(F.col(ruleset.target_amount_column), fallback)


def sum_or_zero(c: Column | str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0.0))


def gold_filtered(silver: DataFrame, ruleset: Ruleset) -> DataFrame:
    return movement_scope(ruleset_filter(silver, ruleset), ruleset)


def gold_known(filtered: DataFrame, ruleset: Ruleset, grain=()) -> DataFrame:
    keys = [ruleset.availability_date_column, ruleset.truth_date_column, *grain]
    return filtered.groupBy(*keys).agg(
        sum_or_zero(target_amount(ruleset)).alias(KNOWN), F.count("ID").alias(KNOWN_COUNT)
    )


def gold_realized(filtered: DataFrame, ruleset: Ruleset, grain=()) -> DataFrame:
    return filtered.groupBy(ruleset.truth_date_column, *grain).agg(
        sum_or_zero(target_amount(ruleset)).alias(TARGET), F.count("ID").alias(OBSERVED)
    )


def realized_from_known(known: DataFrame, ruleset: Ruleset, grain=()) -> DataFrame:
    """Roll the bitemporal fact up by landing day: sums and counts add, so raw rows are read once."""
    return known.groupBy(ruleset.truth_date_column, *grain).agg(
        F.sum(KNOWN).alias(TARGET), F.sum(KNOWN_COUNT).alias(OBSERVED)
    )


def gold_build(silver: DataFrame, ruleset: Ruleset, grain=()) -> dict[str, DataFrame]:
    known = gold_known(gold_filtered(silver, ruleset), ruleset, grain)
    return {"realized": realized_from_known(known, ruleset, grain), "known": known}


# --- calendars and dense panels ------------------------------------------------------------


def one_row(spark) -> DataFrame:
    return spark.range(1).select()


def days_between(spark, low: Column, high: Column, name: str = "DATE") -> DataFrame:
    """One row per day. The bounds may be scalar subqueries, so no driver round trip is needed."""
    return spark.range(1).select(F.explode(F.sequence(low, high)).alias(name))


def date_bounds(*columns: tuple[DataFrame, str]) -> DataFrame:
    """One row (lo, hi) over date columns of several tables."""
    out = None
    for df, c in columns:
        part = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi"))
        out = part if out is None else out.unionByName(part)
    return out.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def bounds_columns(bounds: DataFrame) -> tuple[Column, Column]:
    both = bounds.select(F.struct("lo", "hi").alias("b")).scalar()
    return both["lo"], both["hi"]


def calendar_days(realized: DataFrame, known: DataFrame) -> DataFrame:
    bounds = date_bounds((realized, VALUE), (known, VALUE), (known, TRADE))
    return days_between(realized.sparkSession, *bounds_columns(bounds))


def calendar_from_gold(realized: DataFrame, known: DataFrame) -> DataFrame:
    return calendar_days(realized, known).select("DATE", *calendar_attributes("DATE"))


def dense_label_panel(calendar: DataFrame, labels: DataFrame) -> DataFrame:
    """Calendar with labels (DATE, TARGET_AMOUNT), zero where nothing landed."""
    return calendar.join(labels, "DATE", "left").withColumn(TARGET, F.coalesce(TARGET, F.lit(0.0)))


def filter_entity(df: DataFrame, entity: str | None, column: str = "ENTITY_SHORTNAME") -> DataFrame:
    if entity is None or column not in df.columns:
        return df
    return df.filter(F.col(column) == entity)


def filter_date_window(df: DataFrame, column: str, start=None, end=None) -> DataFrame:
    """Inclusive bounds; each is a date, a date text, a scalar subquery column or None."""
    day = F.col(column)
    for bound, cond in ((start, day.__ge__), (end, day.__le__)):
        if bound is not None:
            bound = bound if isinstance(bound, Column) else F.lit(str(bound)).cast("date")
            df = df.filter(cond(bound))
    return df


def complete_daily_panel(table: DataFrame, contract: str, entity=None, start=None, end=None) -> DataFrame:
    """Zero-filled amount and count per day of the window."""
    day, amount, count = CONTRACTS[contract]
    observed = filter_date_window(filter_entity(table, entity), day, start, end)
    daily = observed.groupBy(day).agg(sum_or_zero(amount).alias(amount), F.sum(count).alias(count))
    lo, hi = bounds_columns(date_bounds((observed, day)))
    as_date = lambda v: F.lit(str(v)).cast("date")
    lo = lo if start is None else as_date(start)
    hi = hi if end is None else as_date(end)
    panel = days_between(table.sparkSession, lo, hi, day).join(daily, day, "left")
    return panel.select(
        day, F.coalesce(amount, F.lit(0.0)).alias(amount), F.coalesce(count, F.lit(0)).alias(count)
    )


def complete_gold_panels(gold: dict[str, DataFrame], **window) -> dict[str, DataFrame]:
    return {name: complete_daily_panel(df, name, **window) for name, df in gold.items()}


def observed_tables_for_entity(gold, entity=None, start=None, end=None) -> dict[str, DataFrame]:
    return {
        name: filter_date_window(filter_entity(df, entity), CONTRACTS[name][0], start, end)
        for name, df in gold.items()
    }


def gold_date_range(gold: dict[str, DataFrame]) -> DataFrame:
    bounds = date_bounds(*[(df, CONTRACTS[name][0]) for name, df in gold.items()])
    return bounds.select(F.col("lo").alias("GOLD_MIN_DATE"), F.col("hi").alias("GOLD_MAX_DATE"))


def window_bounds(gold: dict[str, DataFrame], window: str, end_date=None) -> DataFrame:
    """One row (START_DATE, END_DATE) for full, 90, 365d, 6m, 2y or from:to; nulls mean unbounded."""
    label = window.lower().strip()
    last = F.col("GOLD_MAX_DATE") if end_date is None else F.lit(str(end_date)).cast("date")
    none = F.lit(None).cast("date")
    start, end = none, none
    if ":" in label:
        start, end = (F.lit(p).cast("date") if p else none for p in label.split(":", 1))
    elif label != "full":
        unit = label[-1] if label[-1:] in "dmy" else "d"
        number = label[:-1] if label[-1:] in "dmy" else label
        if number.isdigit():
            n = int(number)
            start = {
                "d": F.date_sub(last, n - 1),
                "m": F.add_months(last, -n),
                "y": F.add_months(last, -12 * n),
            }[unit]
            end = last
    return gold_date_range(gold).select(start.alias("START_DATE"), end.alias("END_DATE"))


def discover_dimensions(gold: dict[str, DataFrame], silver: DataFrame | None = None,
                        dims=("ENTITY_SHORTNAME", "CURRENCY_SHORTNAME", "MOVEMENT_SCOPE")) -> DataFrame:
    """Distinct dimension values of Gold and entities of Silver, with the Gold date range."""
    parts = [df.select(*dims) for df in gold.values()]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    found = found.distinct().withColumn("SOURCE", F.lit("gold"))
    if silver is not None:
        entities = silver.select(dims[0]).filter(F.col(dims[0]).isNotNull()).distinct()
        found = found.unionByName(
            entities.withColumn("SOURCE", F.lit("silver")), allowMissingColumns=True
        )
    bounds = gold_date_range(gold)
    return found.withColumns(
        {c: bounds.select(c).scalar() for c in ("GOLD_MIN_DATE", "GOLD_MAX_DATE")}
    )


def drop_zero_count_rows(df: DataFrame, count: str) -> DataFrame:
    return df.filter(F.coalesce(F.col(count), F.lit(0)) > 0)


def zero_count_guardrail(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows before and after dropping zero-count rows, one row per table."""
    out = None
    for name, (df, count) in tables.items():
        zero = F.count_if(F.coalesce(F.col(count), F.lit(0)) == 0)
        kept = F.count_if(F.coalesce(F.col(count), F.lit(0)) > 0)
        part = df.agg(
            F.lit(name).alias("TABLE_NAME"),
            F.count("*").alias("RAW_ROWS"),
            kept.alias("CLEANED_ROWS"),
            zero.alias("ZERO_COUNT_ROWS_REMOVED"),
            F.when(F.count("*") > 0, zero / F.count("*")).otherwise(0.0).alias("ZERO_COUNT_ROW_SHARE"),
        )
        out = part if out is None else out.unionByName(part)
    return out

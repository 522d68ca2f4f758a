"""Declarative business rules compiled to Column expressions."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import ladder
from ..functions.parsing import all_of, any_of


@dataclass(frozen=True)
class ColumnRule:
    include_values: tuple[str, ...] = ()
    exclude_values: tuple[str, ...] = ()
    exclude_contains: tuple[str, ...] = ()
    case_sensitive: bool = False


@dataclass(frozen=True)
class Ruleset:
    name: str
    version: str = "1"
    filters: dict[str, ColumnRule] = field(default_factory=dict)
    movement_scope_mapping: dict[str, str] = field(default_factory=dict)
    identity_scope: bool = True
    target_amount_column: str = "SIGNED_AMOUNT"
    truth_date_column: str = "VALUE_DATE"
    availability_date_column: str = "TRADE_DATE"
    movement_type_column: str = "CASH_MOVEMENT_TYPE_SHORTNAME"
    movement_scope_column: str = "MOVEMENT_SCOPE"
    aggregation_dimensions: tuple[str, ...] = (
        "ENTITY_SHORTNAME",
        "CURRENCY_SHORTNAME",
        "MOVEMENT_SCOPE",
    )

    @property
    def ruleset_id(self) -> str:
        return f"{self.name}:{self.version}"


def _folded(values, rule: ColumnRule) -> list[str]:
    return [v if rule.case_sensitive else v.lower() for v in values if v is not None]


def include_condition(column: Column, values: list[str]) -> Column:
    """A null value is not in the list, so its row goes."""
    return F.coalesce(column.isin(values), F.lit(False))


def exclude_condition(column: Column, values: list[str]) -> Column:
    """A null value is not in the list, so its row stays."""
    return ~F.coalesce(column.isin(values), F.lit(False))


def exclude_contains_condition(column: Column, values: list[str]) -> Column:
    """Literal substrings, never patterns."""
    text = F.coalesce(column, F.lit(""))
    return ~any_of(text.contains(v) for v in values)


def rule_condition(column_name: str, rule: ColumnRule) -> Column:
    text = F.col(column_name).cast("string")
    text = text if rule.case_sensitive else F.lower(text)
    parts = []
    if rule.include_values:
        parts.append(include_condition(text, _folded(rule.include_values, rule)))
    if rule.exclude_values:
        parts.append(exclude_condition(text, _folded(rule.exclude_values, rule)))
    if rule.exclude_contains:
        parts.append(exclude_contains_condition(text, _folded(rule.exclude_contains, rule)))
    return all_of(parts)


def active_filters(df: DataFrame, ruleset: Ruleset) -> list[tuple[str, Column]]:
    return [(c, rule_condition(c, r)) for c, r in ruleset.filters.items() if c in df.columns]


def ruleset_filter(df: DataFrame, ruleset: Ruleset) -> DataFrame:
    return df.filter(all_of(cond for _, cond in active_filters(df, ruleset)))


def scope_column(ruleset: Ruleset) -> Column:
    kind = F.col(ruleset.movement_type_column).cast("string")
    named = [(kind == k, v) for k, v in ruleset.movement_scope_mapping.items()]
    fallback = kind if ruleset.identity_scope else F.lit(None).cast("string")
    return ladder(named, fallback) if named else fallback


def movement_scope(df: DataFrame, ruleset: Ruleset) -> DataFrame:
    scoped = df.withColumn(ruleset.movement_scope_column, scope_column(ruleset))
    return scoped.filter(F.col(ruleset.movement_scope_column).isNotNull())


def first_failing_rule(df: DataFrame, ruleset: Ruleset) -> DataFrame:
    """Adds the 1-based number of the first rule a row fails; n+1 without a scope, n+2 when kept."""
    rules = [cond for _, cond in active_filters(df, ruleset)]
    steps = [(~cond, i + 1) for i, cond in enumerate(rules)]
    steps.append((scope_column(ruleset).isNull(), len(rules) + 1))
    return df.withColumn("_failed", ladder(steps, len(rules) + 2))

"""Declared shape of a movement extract."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

STRING, FLOAT, INT, DATE, CATEGORY = "string", "float", "int", "date", "category"

SPARK_TYPES = {
    STRING: T.StringType(),
    CATEGORY: T.StringType(),
    FLOAT: T.DoubleType(),
    INT: T.LongType(),
    DATE: T.DateType(),
}

# Column name, type, and "!" for a required column.
_MOVEMENT_COLUMNS = """
ID string !
ENTITY_SHORTNAME category !
ENTITY_NAME string
SCOPE_NAME string !
APPLICATIVE_STATUS_SHORTNAME category !
EXTERNAL_REFERENCE string
CAPTURE_DATE date
CASH_MOVEMENT_TYPE_SHORTNAME category !
CASH_MOVEMENT_TYPE_NAME string
CURRENCY_SHORTNAME category !
ACCOUNT_SHORTNAME category !
ACCOUNT_NAME string
IS_INTERNAL string
COUNTRY_SHORTNAME category
BANK_SHORTNAME category !
BANK_NAME string
CPTY_SHORTNAME string
CPTY_NAME string
CPTY_ACCOUNT_SHORTNAME string
CPTY_ACCOUNT_NAME string
ANALYTIC_TYPE_SHORTNAME category !
ANALYTIC_TYPE_NAME string
ISSUE_DATE date
TRADE_DATE date !
VALUE_DATE date !
MATCH_DATE date
AMOUNT float !
SIGN int !
SIGNED_AMOUNT float
ORIGIN_AMOUNT float
ORIGIN_CURRENCY_SHORTNAME string
IS_REVERSAL category
DESCRIPTION string !
"""


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    required: bool = False


@dataclass(frozen=True)
class TableShape:
    """An ordered set of typed fields; unknown columns of a table are kept behind them."""

    name: str
    fields: tuple[Field, ...]

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def required(self) -> list[str]:
        return [f.name for f in self.fields if f.required]

    def check(self, columns) -> None:
        absent = [name for name in self.required if name not in set(columns)]
        if absent:
            raise ValueError(f"{self.name}: required columns are absent: {', '.join(absent)}")

    def struct(self, raw: bool = False) -> T.StructType:
        return T.StructType(
            [
                T.StructField(
                    f.name,
                    T.StringType() if raw else SPARK_TYPES[f.kind],
                    True,
                    {"required": f.required},
                )
                for f in self.fields
            ]
        )


def movement_shape() -> TableShape:
    parts = [line.split() for line in _MOVEMENT_COLUMNS.split("\n") if line]
    return TableShape("cash_movements", tuple(Field(p[0], p[1], len(p) == 3) for p in parts))

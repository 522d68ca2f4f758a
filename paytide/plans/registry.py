"""Queries and the SQL that checks them, registered side by side."""
from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .oracle import with_ctes

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _digits(text: str) -> dict[str, int]:
    """'A,B:2 C:6' -> {'A': 2, 'B': 2, 'C': 6}"""
    out = {}
    for part in text.split():
        names, n = part.rsplit(":", 1)
        out.update({name: int(n) for name in names.split(",")})
    return out


def _shift(n: int) -> float:
    return float(f"3.7e{-(n + 3)}")


def _tidy(df: DataFrame, digits: dict[str, int], ints) -> DataFrame:
    """Amounts are floating point and summed in any order: round for comparison, -0.0 as 0.0.

    Means and quantiles of two-decimal amounts often lie exactly between two roundings, where the
    last bit would decide; both sides therefore round after the same small shift.
    """
    columns = {}
    for c, n in digits.items():
        rounded = F.round(F.col(c).cast("double") + _shift(n), n)
        columns[c] = F.when(rounded == 0, F.lit(0.0)).otherwise(rounded)
    columns.update({c: F.col(c).cast("bigint") for c in ints})
    return df.withColumns(columns) if columns else df


def _tidy_sql(body: str, digits: dict[str, int], ints) -> str:
    parts = []
    for c, n in digits.items():
        r = f"round(CAST({c} AS DOUBLE) + CAST('{_shift(n)!r}' AS DOUBLE), {n})"
        parts.append(f"CASE WHEN {r} = 0 THEN 0.0 ELSE {r} END AS {c}")
    parts += [f"CAST({c} AS BIGINT) AS {c}" for c in ints]
    body = re.sub(r"\s+", " ", body).strip()
    return f"SELECT * REPLACE ({', '.join(parts)}) FROM ({body}) q" if parts else body


def query(name: str, sql: str | None = None, digits: str = "", ints: str = ""):
    """Register fn(tables) -> DataFrame; ``sql`` may use the shared CTE names."""
    d, i = _digits(digits), ints.split()

    def register(fn):
        from .tables import Tables

        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = lambda spark, sf_dir: _tidy(fn(Tables(spark, sf_dir)), d, i)
        if sql is not None:
            ORACLES[name] = with_ctes(_tidy_sql(sql, d, i))
        return fn

    return register

"""Combination of base forecasts."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pointintime import CUTOFF, FORECAST, numeric_feature_columns


def append_passthrough(meta: DataFrame, anchor: DataFrame, keys=(CUTOFF, FORECAST)) -> DataFrame:
    """Left join of the anchor's numeric features under an ANCHOR_ prefix."""
    keys = list(keys)
    names = [c for c in numeric_feature_columns(anchor) if c not in keys]
    return meta.join(anchor.select(*keys, *[F.col(c).alias(f"ANCHOR_{c}") for c in names]), keys, "left")

"""All registered queries."""
from . import q_dataset, q_evaluate, q_gold, q_layers, q_learned, q_relational, q_series  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

"""Aggregates that need the ordered values of a key, taken for all keys of an Arrow batch at once.

Spark brings the rows of a key together and sorts them; a task then holds one batch and the key that crosses
its end. Callers bound the rows of a key: distinct days, or distinct values up to a limit.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import StructType


def _differs(column: pa.ChunkedArray) -> np.ndarray:
    """Whether each value but the first differs from the one before, nulls being equal."""
    here, before = column.slice(1), column.slice(0, len(column) - 1)
    same = pc.fill_null(pc.equal(here, before), False)
    same = pc.or_(same, pc.and_(pc.is_null(here, nan_is_null=True), pc.is_null(before, nan_is_null=True)))
    return ~same.to_numpy().astype(bool)


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Numbers of the rows that begin a key."""
    new = np.ones(len(table), dtype=bool)
    new[1:] = np.any([_differs(table[k]) for k in keys], axis=0)
    return np.flatnonzero(new)


def _whole_keys(batches, keys: list[str]):
    """(table of whole keys, first row of each) from batches sorted by the keys."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        first = _starts(table, keys)
        if len(first) > 1:
            yield table.slice(0, first[-1]), first[:-1]
        rest = table.slice(first[-1])
    if rest is not None:
        yield rest, np.zeros(1, dtype=np.int64)


class Keyed:
    """Columns of a table of whole keys as numpy arrays, and sums, extremes and quantiles by key."""

    def __init__(self, table: pa.Table, first: np.ndarray):
        self.table, self.first, self.n = table, first, len(first)
        self.of_row = np.repeat(np.arange(self.n), np.diff(np.append(first, len(table))))

    def of_rows(self, of_row: np.ndarray) -> Keyed:
        """The same keys over rows derived from theirs, in order; a key may have none left."""
        out = object.__new__(Keyed)
        out.table, out.n, out.of_row = None, self.n, of_row
        out.first = np.searchsorted(of_row, np.arange(self.n))
        return out

    def _by_key(self, take: np.ufunc, x: np.ndarray, none) -> np.ndarray:
        """The reduction of each key's rows; ``none`` for a key without rows."""
        rows = np.append(self.first[1:], len(x)) > self.first
        out = np.full(self.n, none, dtype=x.dtype)
        if rows.any():
            out[rows] = take.reduceat(x, self.first[rows])
        return out

    def values(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        """The values, 0 for null, and which are not null."""
        column = self.table[name]
        return pc.fill_null(column, 0).to_numpy(), column.is_valid().to_numpy().astype(bool)

    def sum(self, x: np.ndarray) -> np.ndarray:
        # Doubles are added one after the other, as an aggregate adds them; reduceat would add in another order.
        return np.bincount(self.of_row, x, self.n) if x.dtype.kind == "f" else self._by_key(np.add, x, 0)

    def max(self, x: np.ndarray, used: np.ndarray) -> np.ndarray:
        return self._by_key(np.maximum, np.where(used, x, -np.inf), -np.inf)

    def min(self, x: np.ndarray, used: np.ndarray) -> np.ndarray:
        return self._by_key(np.minimum, np.where(used, x, np.inf), np.inf)

    def counts(self, classes: np.ndarray, weight: np.ndarray, top: int) -> np.ndarray:
        """(keys, top) sums of weight by class; classes below 0 count nowhere."""
        used = classes >= 0
        flat = np.bincount((self.of_row * top + classes)[used], weight[used], self.n * top)
        return flat.reshape(self.n, top)

    def quantiles(self, x: np.ndarray, used: np.ndarray, weight: np.ndarray, probabilities) -> list[np.ndarray]:
        """Linearly interpolated quantiles of the values repeated by their weight; any number for a key without values."""
        take = np.flatnonzero(used)
        order = take[np.lexsort((x[take], self.of_row[take]))]
        if not len(order):
            return [np.zeros(self.n) for _ in probabilities]
        through = np.cumsum(weight[order])
        total = np.bincount(self.of_row[order], weight[order], self.n).astype(np.int64)
        before = np.cumsum(total) - total
        out = []
        for q in probabilities:
            position = np.maximum(total - 1, 0) * float(q)
            low, high = np.floor(position).astype(np.int64), np.ceil(position).astype(np.int64)
            at = lambda rank: x[order[np.minimum(np.searchsorted(through, before + rank, "right"), len(order) - 1)]]
            below, above = at(low), at(high)
            mixed = (high - position) * below + (position - low) * above
            out.append(np.where((low == high) | (below == above), below, mixed))
        return out


def entropy(counts: np.ndarray) -> np.ndarray:
    """Shannon entropy of each row over the log of the number of classes seen; 0 for one class."""
    seen = (counts > 0).sum(1)
    share = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    h = -(share * np.log(np.where(share > 0, share, 1.0))).sum(1)
    return np.where(seen <= 1, 0.0, h / np.log(np.maximum(seen, 2)))


def per_key(df: DataFrame, keys: list[str], order: list[str], schema: StructType, body: Callable[[Keyed], dict],
            derived: dict[str, Column] | None = None) -> DataFrame:
    """One row per key: ``body`` gives (values, valid) of each column behind the keys.

    ``schema`` is that of the result, keys first. ``derived`` columns follow from a row and are not shuffled.
    """
    kinds = {f.name: f.dataType.simpleString() for f in schema.fields[len(keys):]}
    arrow = {"bigint": pa.int64(), "double": pa.float64(), "date": pa.int32()}

    def run(batches):
        for table, first in _whole_keys(batches, keys):
            with np.errstate(all="ignore"):
                found = body(Keyed(table, first))
            at = pa.array(first)
            arrays = [table[k].take(at).combine_chunks() for k in keys]
            for name, kind in kinds.items():
                value, valid = found[name]
                value = np.where(valid, value, 0).astype(arrow[kind].to_pandas_dtype())
                made = pa.array(value, arrow[kind], mask=~valid)
                arrays.append(made.cast(pa.date32()) if kind == "date" else made)
            yield pa.RecordBatch.from_arrays(arrays, [*keys, *kinds])

    return df.repartition(*keys).withColumns(derived or {}).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)

"""Row tests that a scan makes itself, before it makes the other columns of a batch."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A column, an operator and a value: a test is true for no null but by "is null".
Test = tuple[str, str, Any]

_COMPARE: dict[str, Callable] = {"=": pc.equal, "<>": pc.not_equal, "<": pc.less, "<=": pc.less_equal, ">": pc.greater, ">=": pc.greater_equal}
_TEXT: dict[str, Callable] = {"starts with": pc.starts_with, "ends with": pc.ends_with, "contains": pc.match_substring}
OPERATORS = (*_COMPARE, *_TEXT, "in", "is null", "is not null")


def _value(value: Any, kind: pa.DataType) -> pa.Scalar:
    """A value of a column's type; dates and times may come as ISO text."""
    if isinstance(value, str) and pa.types.is_date(kind):
        value = dt.date.fromisoformat(value)
    elif isinstance(value, str) and pa.types.is_timestamp(kind):
        value = dt.datetime.fromisoformat(value)
    return pa.scalar(value, kind)


def _hits(column: pa.Array, op: str, value: Any) -> np.ndarray:
    if op == "is null":
        return column.is_null().to_numpy(zero_copy_only=False)
    if op == "is not null":
        return column.is_valid().to_numpy(zero_copy_only=False)
    if op in _TEXT:
        hit = _TEXT[op](column, value)
    elif op == "in":
        hit = pc.and_(pc.is_in(column, pa.array([_value(v, column.type).as_py() for v in value], column.type)), column.is_valid())
    else:
        hit = _COMPARE[op](column, _value(value, column.type))
    out = pc.fill_null(hit, False).to_numpy(zero_copy_only=False)
    if op in (">", ">=", "<>") and pa.types.is_floating(column.type):  # as to Spark, NaN is above all numbers
        out = out | pc.fill_null(pc.is_nan(column), False).to_numpy(zero_copy_only=False)
    return out


def passing(tests: list[Test], columns: dict[str, pa.Array]) -> np.ndarray:
    """Rows for which all tests are true."""
    return np.logical_and.reduce([_hits(columns[name], op, value) for name, op, value in tests])

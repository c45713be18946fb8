"""The nine tests that Filter and conditional Fill share.

The value always arrives as text. It is turned into a literal of the column's own type, so
the comparison stays a bare ``column op literal`` that scans can push down. A value that does
not parse as the column's type makes the test null, which drops the row.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.casting import (
    INTEGRAL_RANGE,
    is_integral,
    parse_number,
    spec_text,
)
from weftline.functions.columns import column, type_of

COMPARISONS: dict[str, Callable] = {
    "==": operator.eq,
    "!=": operator.ne,
    "<": operator.lt,
    "<=": operator.le,
    ">": operator.gt,
    ">=": operator.ge,
}
TEXT_TESTS: dict[str, Callable[[Column, str], Column]] = {
    "contains": Column.contains,
    "startswith": Column.startswith,
    "endswith": Column.endswith,
}
OPERATORS = (*COMPARISONS, *TEXT_TESTS)


def predicate(df: DataFrame, path: str, op: str, value: object) -> Column:
    col, text = column(df, path), spec_text(value)
    dtype = type_of(df, col)
    if op in TEXT_TESTS:
        return TEXT_TESTS[op](col.cast("string"), text)
    if op not in COMPARISONS:
        raise ValueError(f"unknown operator {op!r}, expected one of {OPERATORS}")
    if isinstance(dtype, T.StringType):
        return COMPARISONS[op](col, F.lit(text))
    if is_integral(dtype):
        return _compare_whole(col, dtype, op, text)
    if isinstance(dtype, T.DecimalType):
        return COMPARISONS[op](col, _decimal_literal(text))
    return COMPARISONS[op](col, F.lit(text).try_cast(dtype))


def _unknown() -> Column:
    return F.lit(None).cast("boolean")


def _constant(col: Column, answer: bool) -> Column:
    return F.when(col.isNotNull(), F.lit(answer))


def _decimal_literal(text: str) -> Column:
    number = parse_number(text)
    if number is None:
        return F.lit(None).cast("double")
    fits = len(number.as_tuple().digits) <= 38 and -38 < number.adjusted() < 38
    return F.lit(number) if fits else F.lit(float(number))


def _compare_whole(col: Column, dtype: T.DataType, op: str, text: str) -> Column:
    """Compare a whole-number column exactly, whatever number the text holds.

    ``x >= 5.5`` is the same test as ``x >= 6``, so no cast of the column is ever needed.
    """
    number = parse_number(text)
    if number is None:
        return _unknown()
    lowest, highest = INTEGRAL_RANGE[type(dtype)]
    number = min(max(number, Decimal(lowest - 2)), Decimal(highest + 2))
    floor = int(number.to_integral_value(ROUND_FLOOR))
    ceiling = int(number.to_integral_value(ROUND_CEILING))

    if op in ("==", "!="):
        if floor != ceiling or not lowest <= floor <= highest:
            return _constant(col, op == "!=")
        return COMPARISONS[op](col, F.lit(floor).cast(dtype))

    if op in ("<", "<="):
        top = floor if op == "<=" else ceiling - 1
        if not lowest <= top < highest:
            return _constant(col, top >= highest)
        return col <= F.lit(top).cast(dtype)
    bottom = ceiling if op == ">=" else floor + 1
    if not lowest < bottom <= highest:
        return _constant(col, bottom <= lowest)
    return col >= F.lit(bottom).cast(dtype)

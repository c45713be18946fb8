"""Casts and literals that give the same answer with ANSI mode on and off."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The plain cast targets a spec may name. "date" is not here because it
# re-formats text instead of casting.
CAST_TYPES: dict[str, T.DataType] = {
    "int": T.IntegerType(),
    "string": T.StringType(),
    "double": T.DoubleType(),
    "float": T.FloatType(),
    "bool": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "long": T.LongType(),
    "short": T.ShortType(),
    "byte": T.ByteType(),
}

INTEGRAL_RANGE: dict[type[T.DataType], tuple[int, int]] = {
    kind: (-(2 ** (bits - 1)), 2 ** (bits - 1) - 1)
    for kind, bits in (
        (T.ByteType, 8),
        (T.ShortType, 16),
        (T.IntegerType, 32),
        (T.LongType, 64),
    )
}

_NUMBER = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]{1,4})?")


def is_integral(dtype: T.DataType) -> bool:
    return type(dtype) in INTEGRAL_RANGE


def is_fractional(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def parse_number(text: str) -> Decimal | None:
    text = text.strip()
    return Decimal(text) if _NUMBER.fullmatch(text) else None


def spec_text(value: object) -> str:
    """Spec values are text; JSON booleans take Spark's spelling."""
    if isinstance(value, bool):
        return str(value).lower()
    return str(value)


# Spark's casts ignore these characters around a value.
_PAD = r"[\x00-\x20\x7F]*"
_WITH_WHOLE_PART = rf"^{_PAD}[+-]?[0-9]+(\.[0-9]*)?{_PAD}$"
_FRACTION_ONLY = rf"^{_PAD}[+-]?\.[0-9]*{_PAD}$"
_FRACTIONAL = (
    rf"^{_PAD}[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[dDfF]?"
    rf"|0[xX].*|[iI][nN][fF].*|[nN][aA][nN]){_PAD}$"
)
_BOOLEAN = rf"(?i)^{_PAD}(t|true|y|yes|1|f|false|n|no|0){_PAD}$"


def soft_cast(col: Column, source: T.DataType, target: T.DataType) -> Column:
    """Cast with null for whatever does not fit.

    Text with a fraction becomes its whole part when cast to an integral type ("5.7" is 5).
    Text is matched against a pattern first: a cast that fails throws inside Spark even where
    ``try_cast`` hides it, which costs tens of times more than the match. For the same reason
    numbers are compared with the range of a narrower type first.
    """
    if is_integral(target) and _is_number(source):
        return _number_to_integral(col, source, target)
    if not isinstance(source, T.StringType):
        return col.try_cast(target)
    if is_integral(target):
        whole_part = F.substring_index(col, ".", 1).try_cast(target)
        return F.when(col.rlike(_WITH_WHOLE_PART), whole_part).when(
            col.rlike(_FRACTION_ONLY), F.lit(0).cast(target)
        )
    if is_fractional(target):
        return F.when(col.rlike(_FRACTIONAL), col.try_cast(target))
    if isinstance(target, T.BooleanType):
        return F.when(col.rlike(_BOOLEAN), col.try_cast(target))
    return col.try_cast(target)


def _is_number(dtype: T.DataType) -> bool:
    return is_integral(dtype) or is_fractional(dtype) or isinstance(dtype, T.DecimalType)


def _number_to_integral(col: Column, source: T.DataType, target: T.DataType) -> Column:
    low, high = INTEGRAL_RANGE[type(target)]
    if is_integral(source):
        if INTEGRAL_RANGE[type(source)][1] <= high:
            return col.try_cast(target)
        return F.when(col.between(low, high), col.try_cast(target))
    if is_fractional(source):
        # a fraction is cut off, so what lies between high and high + 1 fits; both bounds are
        # powers of two (or half a step off), which every fractional type holds
        value = col.cast("double")
        above = value > float(low) - 1 if low > -(2**53) else value >= float(low)
        return F.when(above & (value < float(high + 1)), col.try_cast(target))
    if source.precision - source.scale < len(str(high)):
        return col.try_cast(target)
    inside = (col > F.lit(Decimal(low - 1))) & (col < F.lit(Decimal(high + 1)))
    return F.when(inside, col.try_cast(target))


def reformat_date(col: Column, parse_pattern: str, emit_pattern: str) -> Column:
    """Parse with one pattern, emit text in another; null where the text does not parse."""
    if parse_pattern.startswith("EEE "):
        # Spark's parser refuses weekday names. They add nothing to a full date, so drop them.
        col = F.regexp_replace(col, r"^\s*[A-Za-z]{3} ", "")
        parse_pattern = parse_pattern[len("EEE ") :]
    return F.date_format(F.try_to_timestamp(col, F.lit(parse_pattern)), emit_pattern)

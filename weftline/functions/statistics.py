"""Whole-column statistics for filling nulls.

Mean and standard deviation are scalar subqueries: nothing runs until the filled DataFrame
does, and Spark merges the subqueries of neighbouring fills into one aggregate over one scan.

The median is exact. A quantile sketch would send one summary per input task to a single
reducer, so its cost grows with the number of tasks; instead, each column is counted into
ordered bins, the bin that holds the middle rank is opened again, and so on. Every pass serves all
columns that are asked for, shuffles pre-aggregated bin counts only, and has at most
``LINEAR_BINS`` bins (in the first pass about 270,000) for each of them, whatever the type.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.casting import is_fractional, is_integral, soft_cast
from weftline.functions.columns import column, type_of

# 64 bins per power of two bound the first histogram to about 270,000 bins for any doubles.
BINS_PER_OCTAVE = 64
LINEAR_BINS = 65_536
# With this few rows left, counting each distinct value takes one pass and no more bins.
DIRECT_ROWS = LINEAR_BINS
_LOWEST_EXPONENT = 1_080


def numeric_view(df: DataFrame, name: str) -> tuple[Column, T.DataType]:
    """The column as a number. Text that is not a number counts as missing."""
    col = column(df, name)
    dtype = type_of(df, col)
    if isinstance(dtype, T.StringType):
        return soft_cast(col, dtype, T.DoubleType()), T.DoubleType()
    if is_integral(dtype) or is_fractional(dtype) or isinstance(dtype, T.DecimalType):
        return col, dtype
    raise TypeError(f"no statistic for column {name!r} of type {dtype.simpleString()}")


def mean(df: DataFrame, name: str) -> Column:
    return df.agg(F.avg(numeric_view(df, name)[0]).alias("mean")).scalar()


def standard_deviation(df: DataFrame, name: str) -> Column:
    """Sample standard deviation."""
    return df.agg(F.stddev_samp(numeric_view(df, name)[0]).alias("stddev")).scalar()


def median(df: DataFrame, name: str) -> Column:
    """The lower median, found by a few jobs that each return one row."""
    return medians(df, [name])[name]


@dataclass
class _Search:
    """One column's search: values of the bin that holds the wanted rank, and the rank inside it."""

    value: Column
    dtype: T.DataType
    lo: Any = None
    hi: Any = None
    n: int | None = None
    rank: int | None = None
    #: The last pass did not narrow the bin: its values are too close to be told apart by bins.
    stuck: bool = False

    def narrow(self, lo: Any, hi: Any, n: int, rank: int) -> None:
        self.stuck = (lo, hi, n) == (self.lo, self.hi, self.n)
        self.lo, self.hi, self.n, self.rank = lo, hi, n, rank

    @property
    def done(self) -> bool:
        if self.n is None:
            return False
        same = self.lo == self.hi or (isinstance(self.lo, float) and math.isnan(self.lo))
        return self.n == 0 or same

    def literal(self, value: Any) -> Column:
        return F.lit(value).cast(self.dtype)

    def inside(self) -> Column:
        """Whether a row can hold the wanted value."""
        if self.n is None:
            return self.value.isNotNull()
        return self.value.between(self.literal(self.lo), self.literal(self.hi))

    def bin(self) -> Column:
        if self.n is None:
            return _ordered_bin(self.value)
        value, low, span = self.value, self.literal(self.lo), self.hi - self.lo
        if is_integral(self.dtype):  # the difference of two longs need not fit a long
            value, low = value.cast("decimal(20,0)"), low.cast("decimal(20,0)")
        share = (value - low).cast("double") / F.lit(float(span))
        return F.floor(share * LINEAR_BINS).cast("int")

    @property
    def few(self) -> bool:
        return self.stuck or (self.n is not None and self.n <= DIRECT_ROWS)


def medians(df: DataFrame, names: list[str]) -> dict[str, Column]:
    """The lower medians of several columns: passes over the rows are shared by all of them."""
    searches = {name: _Search(*numeric_view(df, name)) for name in names}
    while left := {name: s for name, s in searches.items() if not s.done}:
        for found in _open_bins(df, list(left.values())):
            lo, hi = found[f"lo{found.c}"], found[f"hi{found.c}"]
            list(left.values())[found.c].narrow(lo, hi, found.n, found.rank)
        for search in left.values():
            if search.n is None:  # the column holds no value
                search.n = 0
    return {name: s.literal(s.lo) for name, s in searches.items()}


def _open_bins(df: DataFrame, searches: list[_Search]) -> list[Row]:
    """One pass: per search the bin with the wanted rank (in the first pass the middle one).

    Rows are laid out once per column, as (column, bin) with the value under the column's own name;
    few rows are binned by their values.
    """
    rows = df.select(
        *(s.inside().alias(f"in{c}") for c, s in enumerate(searches)),
        *(s.value.alias(f"v{c}") for c, s in enumerate(searches)),
        *(s.bin().alias(f"b{c}") for c, s in enumerate(searches) if not s.few),
    )
    columns = range(len(searches))
    rows = rows.where(reduce(Column.__or__, (F.col(f"in{c}") for c in columns)))
    laid = F.array(
        *(
            F.when(
                F.col(f"in{c}"),
                F.struct(
                    F.lit(c).alias("c"),
                    (F.lit(0) if s.few else F.col(f"b{c}")).alias("bin"),
                    *(
                        (F.col(f"v{c}") if own == c and s.few else F.lit(None).cast(o.dtype)).alias(
                            f"at{own}"
                        )
                        for own, o in enumerate(searches)
                    ),
                    *(
                        (F.col(f"v{c}") if own == c else F.lit(None).cast(o.dtype)).alias(f"v{own}")
                        for own, o in enumerate(searches)
                    ),
                ),
            )
            for c, s in enumerate(searches)
        )
    )
    laid = F.filter(laid, lambda x: x.isNotNull())
    order = ["bin", *(f"at{c}" for c, s in enumerate(searches) if s.few)]
    bins = (
        rows.select(F.inline(laid))
        .groupBy("c", *order)
        .agg(
            F.count(F.lit(1)).alias("n"),
            *(F.min(f"v{c}").alias(f"lo{c}") for c in columns),
            *(F.max(f"v{c}").alias(f"hi{c}") for c in columns),
        )
    )
    # The windows run over bins, not rows; the bins are few by construction.
    whole = Window.partitionBy("c")
    target = F.ceil(F.sum("n").over(whole) / 2)
    for c, s in enumerate(searches):
        if s.rank is not None:
            target = F.when(F.col("c") == c, F.lit(s.rank)).otherwise(target)
    return (
        bins.withColumn("target", target.cast("long"))
        .withColumn("upto", F.sum("n").over(whole.orderBy(*order)))
        .where((F.col("upto") >= F.col("target")) & (F.col("upto") - F.col("n") < F.col("target")))
        .withColumn("rank", F.col("target") - F.col("upto") + F.col("n"))
        .collect()
    )


def _ordered_bin(v: Column) -> Column:
    """Bin number that never decreases as the value grows: logarithmic in the magnitude."""
    v = v.cast("double")
    depth = F.floor((F.log2(F.abs(v)) + _LOWEST_EXPONENT) * BINS_PER_OCTAVE)
    top = 2 * _LOWEST_EXPONENT * BINS_PER_OCTAVE + 1
    infinity = F.lit(float("inf"))
    return (
        F.when(F.isnan(v), F.lit(top + 1))
        .when(v == infinity, F.lit(top))
        .when(v == -infinity, F.lit(-top))
        .when(v == 0, F.lit(0))
        .when(v > 0, depth)
        .otherwise(-depth)
        .cast("int")
    )

"""The median against a plain sort, for awkward distributions."""

import math
import random

import pytest
from helpers import process, rows
from pyspark.sql import functions as F

from weftline.functions import statistics
from weftline.operators.rules import apply_processes


def _lower_median(values):
    return sorted(values)[math.ceil(len(values) / 2) - 1]


def _median(df):
    return df.limit(1).select(statistics.median(df, "v")).first()[0]


_random = random.Random(5)
CASES = {
    "one": [3.0],
    "even": [1.0, 2.0, 3.0, 4.0],
    "hot value": [1.0] * 50 + [2.0] * 101 + [9.0] * 50,
    "signs": [-5.0, -1e-300, 0.0, 1e-300, 5.0, -7.0],
    "wide": [_random.choice([-1, 1]) * 10.0 ** _random.uniform(-300, 300) for _ in range(301)],
    "narrow": [1.0 + k * 2.0**-52 for k in range(200)],
    "infinite": [float("-inf"), float("inf"), 1.0, float("inf")],
    "tiny": [5e-324, 1e-323, 1.5e-323, 2e-323, 1e300],
}


@pytest.mark.parametrize("name", CASES)
def test_doubles(spark, monkeypatch, name):
    values = CASES[name]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    assert _median(df) == _lower_median(values)
    monkeypatch.setattr(statistics, "DIRECT_ROWS", 0)  # forces the narrowing steps
    assert _median(df) == _lower_median(values)


def test_longs_beyond_double_precision(spark, monkeypatch):
    monkeypatch.setattr(statistics, "DIRECT_ROWS", 0)
    values = [2**62 + k for k in (0, 1, 2, 3, 5, 8, 13, 400, 5000)] + [-(2**63), 2**63 - 1]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert _median(df) == _lower_median(values)


@pytest.mark.parametrize("kind", ["int", "float", "decimal(12,3)", "string"])
def test_other_types(spark, kind):
    df = spark.range(1, 1002).select((F.col("id") / 4).cast(kind).alias("v"))
    value = _median(df)
    expected = _lower_median([float(r.v) for r in df.collect()])
    assert float(value) == expected


def test_nan_counts_as_the_largest(spark):
    nan = float("nan")
    df = spark.createDataFrame([(nan,), (nan,), (1.0,)], "v double")
    assert math.isnan(_median(df))
    df = spark.createDataFrame([(nan,), (1.0,), (2.0,)], "v double")
    assert _median(df) == 2.0


def test_nothing_has_no_median(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert _median(df) is None


def _passes(monkeypatch):
    counted = []
    plain = statistics._open_bins

    def watched(df, searches):
        counted.append(len(searches))
        return plain(df, searches)

    monkeypatch.setattr(statistics, "_open_bins", watched)
    return counted


def _value(df, col):
    return df.limit(1).select(col.alias("m")).first()[0]


def test_medians_share_their_passes(spark, monkeypatch):
    n = 400_000
    df = spark.range(n).select(
        (F.col("id") * F.lit(7919) % n).alias("whole"),
        (F.exp(F.col("id") % 700 - 350) * (F.col("id") % 2 * 2 - 1)).alias("wide"),
        F.lit(None).cast("double").alias("none"),
    )
    counted = _passes(monkeypatch)
    alone = {}
    for name in df.columns:
        alone[name] = _value(df, statistics.median(df, name))
    passes = [sum(1 for _ in counted)]
    counted.clear()
    together = statistics.medians(df, df.columns)
    assert {name: _value(df, col) for name, col in together.items()} == alone
    assert len(counted) < passes[0] and counted[0] == 3
    assert alone["whole"] == (n - 1) // 2 and alone["none"] is None


def test_fills_share_their_passes(spark, monkeypatch):
    df = spark.range(1_000).select(
        F.when(F.col("id") % 3 > 0, F.col("id")).alias("a"),
        F.when(F.col("id") % 5 > 0, F.col("id") / 4).alias("b"),
        F.when(F.col("id") % 7 > 0, F.col("id")).alias("c"),
    )
    fills = [
        process("Fill", fill_by="null values", column_name="a", fill_condition="median"),
        process("Fill", fill_by="null values", column_name="c", fill_condition="mean"),
        process("Fill", fill_by="null values", column_name="B", fill_condition="median"),
    ]
    counted = _passes(monkeypatch)
    filled = apply_processes(df, fills)
    assert counted[0] == 2 and len(counted) <= 3
    monkeypatch.undo()
    one_by_one = df
    for fill in fills:
        one_by_one = apply_processes(one_by_one, [fill])
    assert rows(filled) == rows(one_by_one)


def test_bins_of_wide_decimals_are_bounded(spark, monkeypatch):
    # the values differ beyond the precision of a double
    n = 150_000
    df = spark.range(n).select(
        (F.lit("12345678901234567890123456").cast("decimal(38,4)") + F.col("id")).alias("v")
    )
    sizes = []
    plain = statistics._open_bins

    def watched(df, searches):
        sizes.append(sum(not s.few for s in searches))
        return plain(df, searches)

    monkeypatch.setattr(statistics, "_open_bins", watched)
    median = _value(df, statistics.median(df, "v"))
    assert int(median) == 12345678901234567890123456 + (n - 1) // 2
    assert len(sizes) <= 4
    close = spark.range(n).select(
        (F.lit("1e22").cast("decimal(38,15)") + (F.col("id") % 2).cast("decimal(1,0)") / 10**14).alias("v")
    )
    assert _value(close, statistics.median(close, "v")) is not None

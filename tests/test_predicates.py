"""The nine tests of Filter and conditional Fill."""

import operator
from decimal import Decimal

import pytest
from helpers import column, process
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.errors import RuleError
from weftline.functions.predicates import COMPARISONS, predicate
from weftline.operators.rules import apply_processes


def _kept(df, name, op, value):
    test = process("Filter", source_reference=name, operator=op, data_reference=value)
    return column(apply_processes(df, [test]), name)


def _numbers(spark):
    return spark.createDataFrame([(4,), (5,), (6,), (None,)], "n int")


@pytest.mark.parametrize(
    "op, value, kept",
    [
        ("==", "5", [5]), ("==", "5.0", [5]), ("==", "5.5", []), ("==", "abc", []),
        ("!=", "5", [4, 6]), ("!=", "5.5", [4, 5, 6]), ("!=", "abc", []),
        ("<", "5.5", [4, 5]), ("<", "5", [4]), ("<=", "5", [4, 5]), ("<=", "4.9", [4]),
        (">", "5", [6]), (">", "4.5", [5, 6]), (">=", "5.5", [6]), (">=", "5", [5, 6]),
        ("<", "1e30", [4, 5, 6]), (">", "1e30", []), ("==", "99999999999", []),
        ("!=", "99999999999", [4, 5, 6]), (">=", "-99999999999", [4, 5, 6]),
        ("contains", "5", [5]), ("startswith", "6", [6]), ("endswith", "4", [4]),
    ],
)
def test_whole_numbers(either_ansi, op, value, kept):
    assert _kept(_numbers(either_ansi), "n", op, value) == kept


@settings(
    max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    values=st.lists(st.integers(-128, 127), min_size=1, max_size=5),
    number=st.one_of(
        st.integers(-140, 140).map(Decimal),
        st.decimals(-140, 140, allow_nan=False, places=1),
    ),
)
def test_byte_comparisons_equal_exact_arithmetic(spark, values, number):
    df = spark.createDataFrame([(v,) for v in values], "n byte")
    tests = [predicate(df, "n", op, str(number)).alias(op) for op in COMPARISONS]
    expected = [tuple(test(v, number) for test in COMPARISONS.values()) for v in values]
    assert [tuple(row) for row in df.select(*tests).collect()] == expected
    assert list(COMPARISONS.values())[0] is operator.eq


def test_text_compares_as_text(either_ansi):
    df = either_ansi.createDataFrame([("10",), ("9",), ("",), (None,)], "s string")
    assert _kept(df, "s", "<", "9") == ["10", ""]
    assert _kept(df, "s", "==", "") == [""]
    assert _kept(df, "s", "!=", "9") == ["10", ""]


def test_fractions_dates_and_booleans(either_ansi):
    df = either_ansi.sql(
        "SELECT 0.1D AS d, CAST(0.1 AS FLOAT) AS f, CAST('0.10' AS DECIMAL(4,2)) AS m, true AS b,"
        " DATE '2020-02-01' AS day, TIMESTAMP '2020-02-01 10:00:00' AS ts"
    )
    for name, op, value in [
        ("d", "==", "0.1"), ("f", "==", "0.1"), ("m", "==", "0.1"), ("m", "<", "0.101"),
        ("b", "==", "true"), ("b", "!=", False), ("day", ">=", "2020-01-31"),
        ("ts", ">", "2020-02-01"), ("ts", "<", "2020-02-01 10:00:01"), ("d", "<", "NaN"),
    ]:
        assert len(_kept(df, name, op, value)) == 1, (name, op, value)
    for name in ("d", "m", "b", "day", "ts"):
        for op in ("==", "!=", "<", ">="):
            assert _kept(df, name, op, "nonsense") == []


def test_names_with_dots_and_nested_paths(spark):
    df = spark.sql("SELECT 1 AS `a.b`, named_struct('c', 2) AS s")
    assert df.where(predicate(df, "a.b", "==", "1")).count() == 1
    assert df.where(predicate(df, "s.c", "==", "3")).count() == 0


def test_unknown_operator_and_missing_fields(spark):
    df = _numbers(spark)
    with pytest.raises(RuleError, match="unknown operator"):
        _kept(df, "n", "~", "5")
    with pytest.raises(RuleError, match="operator"):
        apply_processes(df, [process("Filter", source_reference="n", data_reference="5")])


def test_comparison_reaches_the_scan(spark, tmp_path):
    spark.range(100).select(F.col("id"), (F.col("id") * 0.5).alias("x")).write.parquet(
        f"{tmp_path}/t"
    )
    df = spark.read.parquet(f"{tmp_path}/t")
    for name, value, pushed in (
        ("id", "5.5", "GreaterThanOrEqual(id,6)"), ("x", "5", "GreaterThanOrEqual(x,5.0)")
    ):
        plan = df.where(predicate(df, name, ">=", value))
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert pushed in text

"""Casts: bad input gives null and the answers do not depend on ANSI mode."""

import datetime

import pytest
from helpers import column, process
from pyspark.sql import functions as F

from weftline.errors import RuleError
from weftline.operators.rules import apply_processes

TEXTS = [
    "5", "5.7", ".5", ".", "5.", "-.5", "-", " 7 ", " 7.9 ", "1e3", "x", "", "+3.9",
    "9999999999", "300", "-0.9", "5.7x", "0x1", "0x1p3", "5.0e0", "5d", "1.5F", "1e", "e5",
    "NaN", "nan", "inf", "-Infinity", "+inf", "infinite", "TRUE", " yes ", "n", "0", "1",
    "off", "\t8\n", "--5", "5 5", "1e400", "2020-01-02", "true", None,
]


def _cast(df, name, **more):
    return apply_processes(
        df, [process("Cast", column_to_cast="s", cast_type=name, **more)]
    )


@pytest.mark.parametrize(
    "name", ["int", "long", "short", "byte", "float", "double", "bool", "timestamp", "string"]
)
def test_text_casts_like_spark_without_ansi(spark, name):
    df = spark.createDataFrame([(t,) for t in TEXTS], "s string")
    answers = {}
    for mode in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", mode)
        answers[mode] = [str(v) for v in column(_cast(df, name), "s")]
    plain = column(df.select(F.col("s").cast("boolean" if name == "bool" else name)), "s")
    spark.conf.set("spark.sql.ansi.enabled", "true")
    assert answers["true"] == answers["false"] == [str(v) for v in plain]


def test_number_casts(either_ansi):
    df = either_ansi.createDataFrame([(5.9,), (-5.9,), (None,), (1e12,)], "s double")
    assert column(_cast(df, "int"), "s") == [5, -5, None, None]


def test_unknown_type_and_column(spark):
    df = spark.createDataFrame([("a",)], "s string")
    with pytest.raises(RuleError, match="unknown cast type"):
        _cast(df, "blob")
    with pytest.raises(RuleError, match="dataset\\[0\\] Cast"):
        apply_processes(df, [process("Cast", column_to_cast="t", cast_type="int")])


def test_array_to_int_is_an_error(either_ansi):
    df = either_ansi.createDataFrame([([1],)], "s array<int>")
    with pytest.raises(RuleError):
        _cast(df, "int")


def test_column_names_follow_the_case_rule(spark):
    df = spark.createDataFrame([("1",)], "S string")
    result = _cast(df, "int")
    assert result.columns == ["S"] and column(result, "S") == [1]


# The patterns a date cast offers.
PATTERNS = [
    "yyyy-MM-dd", "yyyy/MM/dd", "MM-dd-yyyy", "dd-MM-yyyy", "MM/dd/yyyy", "dd/MM/yyyy",
    "M/d/yyyy H:mm", "d/M/yyyy H:mm", "M/d/yyyy H:mm:ss", "d/M/yyyy H:mm:ss",
    "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "MM/dd/yyyy'T'HH:mm:ss.SSSXXX",
    "dd/MM/yyyy'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ss", "MM/dd/yyyy'T'HH:mm:ss",
    "dd/MM/yyyy'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSS", "MM/dd/yyyy'T'HH:mm:ss.SSS",
    "dd/MM/yyyy'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "MM/dd/yyyy'T'HH:mm:ss.SSSSSS", "dd/MM/yyyy'T'HH:mm:ss.SSSSSS",
    "EEE MMM dd HH:mm:ss z yyyy",
]


def test_every_date_pattern_parses_what_it_emits(either_ansi):
    moment = datetime.datetime(2021, 3, 9, 0, 0)
    df = either_ansi.createDataFrame([(moment,)], "t timestamp")
    df = df.select(*(F.date_format("t", p).alias(f"c{i}") for i, p in enumerate(PATTERNS)))
    processes = [
        process(
            "Cast", column_to_cast=f"c{i}", cast_type="date",
            cast_from=p, cast_to="yyyy-MM-dd HH:mm:ss",
        )
        for i, p in enumerate(PATTERNS)
    ]
    assert set(apply_processes(df, processes).first()) == {"2021-03-09 00:00:00"}


def test_dates_that_do_not_parse_become_null(either_ansi):
    texts = ["2020-01-05", "2020-1-5", "2020-13-01", "junk", "", None]
    df = either_ansi.createDataFrame([(t,) for t in texts], "s string")
    result = _cast(df, "date", cast_from="yyyy-MM-dd", cast_to="dd.MM.yyyy")
    assert column(result, "s") == ["05.01.2020", None, None, None, None, None]
    assert dict(result.dtypes)["s"] == "string"


def test_weekday_texts(either_ansi):
    texts = ["Mon Jan 06 10:00:00 UTC 2020", "Xyz Jan 06 10:00:00 UTC 2020", "nonsense"]
    df = either_ansi.createDataFrame([(t,) for t in texts], "s string")
    result = _cast(df, "date", cast_from="EEE MMM dd HH:mm:ss z yyyy", cast_to="yyyy-MM-dd HH")
    assert column(result, "s") == ["2020-01-06 10", "2020-01-06 10", None]

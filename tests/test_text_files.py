"""CSV that gives every text back, and numbers and keys at the edges of their types."""

from decimal import Decimal
from itertools import permutations

import pytest
from helpers import rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from weftline.errors import FusionError, SpecError
from weftline.functions.casting import soft_cast
from weftline.functions.escapes import escape, escape_name, unescape, unescape_name
from weftline.operators.fusion import fuse_columns
from weftline.sinks.export import RunPlace, export
from weftline.sinks.files import write_files
from weftline.sources.files import FileSpec, read_file
from weftline.sources.importer import import_sources
from weftline.workspace import Workspace

TEXTS = [
    "plain", "", None, "two\nlines", "\r\n", "\n", "\\n", "\\", "\\\\n", "\\s", "\\N", " padded ", "\t",
    'quoted "text"', '"', '""', "a,b", "#comment", "back\\", 'mixed \\" \n', "nul\0nul", "\\0", "ünï ⁊ 𝄞",
    " \u0085\x0b\x0c", "'", "null", "x" * 70_000 + "\n" + "y" * 70_000,
]


def _texts(spark, columns):
    data = [(i, t, t) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(data, "id long, text string, `odd\nname` string").select(*columns)


def test_escapes_are_undone(spark):
    df = _texts(spark, ["text"])
    again = df.select("text", unescape(escape(F.col("text"))).alias("again"))
    assert [r.text for r in again.collect()] == [r.again for r in again.collect()]
    one_line = df.select(escape(F.col("text")).alias("e")).where(F.col("e").rlike("[\r\n\\x00]"))
    assert one_line.isEmpty()
    assert all(unescape_name(escape_name(t)) == t for t in TEXTS if t is not None)


@pytest.mark.parametrize("columns", [["id", "text", "odd\nname"], ["text"]])
def test_csv_comes_back(spark, tmp_path, columns):
    df = _texts(spark, [f"`{c}`" for c in columns]).repartition(3)
    path = write_files(df, f"{tmp_path}/texts.csv", "csv")
    read = read_file(spark, FileSpec(path))
    assert read.columns == columns
    assert rows(read) == rows(df.select(*(F.col(f"`{c}`").cast("string") for c in columns)))
    write_files(df, path, "csv", "append")
    assert read_file(spark, FileSpec(path)).count() == 2 * len(TEXTS)
    # the file can be split: no line holds a part of a row only
    lines = spark.read.text([f for f in read.inputFiles()])
    assert lines.count() >= len(TEXTS)


def test_csv_stream_comes_back(spark, tmp_path):
    df = _texts(spark, ["id", "text"])
    df.write.parquet(f"{tmp_path}/in")
    workspace = Workspace(spark)
    import_sources(workspace, {"Stream": {
        "stream_from": "files", "path": f"{tmp_path}/in", "file_format": "parquet", "dataframe_name": "t",
    }})
    target = {
        "type": "download", "datasets": ["t"], "conversions": {"t": "csv"}, "trigger": "available_now",
    }
    exported = export(workspace, target, RunPlace(f"{tmp_path}/out", f"{tmp_path}/progress"))
    exported.queries[0].awaitTermination()
    read = read_file(spark, FileSpec(exported.paths["t"]))
    assert rows(read) == rows(df.select(F.col("id").cast("string"), "text"))


def test_plain_csv_refuses_line_breaks(spark, tmp_path):
    with pytest.raises(PySparkException, match="line break"):
        write_files(_texts(spark, ["text"]), f"{tmp_path}/a.csv", "csv", text="plain")
    good = spark.createDataFrame([("a\\b", 1)], "t string, n int")
    path = write_files(good, f"{tmp_path}/b.csv", "csv", text="plain")
    assert rows(read_file(spark, FileSpec(path))) == {("a\\b", "1"): 1}
    with pytest.raises(SpecError, match="other kind"):
        write_files(good, path, "csv", "append")
    with pytest.raises(SpecError, match="csv_text"):
        write_files(good, f"{tmp_path}/c.csv", "csv", text="odd")


@pytest.mark.parametrize("target, bits", [("byte", 8), ("short", 16), ("int", 32), ("long", 64)])
def test_numbers_are_cast_by_range(either_ansi, target, bits):
    spark = either_ansi
    low, high = -(2 ** (bits - 1)), 2 ** (bits - 1) - 1
    whole = [low, high, 0, -1] + ([low - 1, high + 1] if bits < 64 else [])
    df = spark.createDataFrame([(v,) for v in whole], "v long")
    dtype = spark.range(0).select(F.lit(1).cast(target).alias("x")).schema["x"].dataType
    got = df.select("v", soft_cast(F.col("v"), df.schema["v"].dataType, dtype).alias("c")).collect()
    assert all(r.c == (r.v if low <= r.v <= high else None) for r in got)
    fractions = [float(low), low - 0.5, low - 1.0, low - 2.0, high + 0.5, high + 1.0, float("nan"),
                 float("inf"), -0.9, 1e300]
    df = spark.createDataFrame([(v,) for v in fractions], "v double")
    cast = soft_cast(F.col("v"), df.schema["v"].dataType, dtype)
    finite = [int(v) if abs(v) < float("inf") else None for v in fractions]
    assert [r.c for r in df.select(cast.alias("c")).collect()] == [
        v if v is not None and low <= v <= high else None for v in finite
    ]
    decimals = [Decimal(low) - 1, Decimal(low), Decimal(high) + Decimal("0.5"), Decimal(high) + 1]
    df = spark.createDataFrame([(v,) for v in decimals], "v decimal(38,2)")
    cast = soft_cast(F.col("v"), df.schema["v"].dataType, dtype)
    assert rows(df.select(cast)) == rows(df.select(F.col("v").try_cast(dtype)))


def _fused(spark, inputs, how):
    workspace = Workspace(spark)
    for name, df in inputs.items():
        workspace.add(name, df)
    return fuse_columns(workspace, list(inputs), "k", how)


def test_decimal_and_text_keys_in_any_order(either_ansi):
    spark = either_ansi
    decimal = [(Decimal("5.70"), "5.70"), (Decimal("6.00"), "6.00")]
    text = [(t, t) for t in ("5", "5.70", "5.705", "x", "6.0", ".70", "")]
    inputs = {
        "l": spark.createDataFrame([(5, "5"), (6, "6")], "k long, l string"),
        "d": spark.createDataFrame(decimal, "k decimal(10,2), d string"),
        "t": spark.createDataFrame(text, "k string, t string"),
    }
    expected = {("5", None, "5"), ("6", "6.00", "6.0"), (None, "5.70", "5.70"), (None, None, "5.705"),
                (None, None, "x"), (None, None, ".70"), (None, None, "")}
    for order in permutations(inputs):
        fused = _fused(spark, {name: inputs[name] for name in order}, "outer")
        assert {(r.l, r.d, r.t) for r in fused.collect()} == expected
        assert fused.count() == len(expected)


def test_whole_numbers_meet_fractions_exactly(spark):
    whole = spark.createDataFrame([(2**53 + 1, "odd"), (4, "four")], "k long, w string")
    double = spark.createDataFrame([(float(2**53), "even"), (4.0, "four")], "k double, f string")
    text = spark.createDataFrame([(str(2**53 + 1), "odd"), ("4e0", "four")], "k string, t string")
    fused = _fused(spark, {"whole": whole, "double": double}, "outer")
    assert {(r.w, r.f) for r in fused.collect()} == {("four", "four"), ("odd", None), (None, "even")}
    fused = _fused(spark, {"double": double, "text": text}, "outer")
    assert {(r.f, r.t) for r in fused.collect()} == {("four", "four"), ("even", None), (None, "odd")}


def test_keys_without_a_common_type_are_refused(spark):
    wide = spark.createDataFrame([(Decimal(1),)], "k decimal(38,0)")
    fine = spark.createDataFrame([(Decimal("0.1"),)], "k decimal(38,30)")
    text = spark.createDataFrame([("1",)], "k string")
    with pytest.raises(FusionError, match="cast it first"):
        _fused(spark, {"wide": wide, "fine": fine, "text": text}, "inner")

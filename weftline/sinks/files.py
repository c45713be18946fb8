"""Parquet and CSV output. Executors write the parts; nothing passes through the driver.

CSV has one row per line, so that its parts can be split. Text is escaped to one line (line breaks,
null characters and backslashes; see ``functions.escapes``), and a marker beside the parts says so:
the CSV source undoes it and gives every text back as it was. ``"plain"`` text is written as it is,
for other readers; a line break in it is an error, since rows would fall apart.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.errors import SpecError
from weftline.functions.columns import quoted
from weftline.functions.escapes import NULL, escape, escape_name

FORMATS = ("parquet", "csv")
TEXT_MODES = ("escaped", "plain")
#: Beside the parts of escaped CSV. Readers of the folder skip names with an underscore.
ESCAPED_MARKER = "_escaped_text"
#: Quotes are doubled, since a backslash belongs to the escapes; spaces around a text stay.
CSV_OPTIONS = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "lineSep": "\n",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def output_path(output_dir: str, dataset: str, file_format: str) -> str:
    if file_format not in FORMATS:
        raise SpecError(f"unknown format {file_format!r}, expected one of {FORMATS}")
    return f"{output_dir.rstrip('/')}/{dataset}.{file_format}"


def as_delimited(df: DataFrame, text: str = "escaped") -> DataFrame:
    """Types CSV has no form for become text; timestamps take a readable form; text is one line."""
    if text not in TEXT_MODES:
        raise SpecError(f"unknown csv_text {text!r}, expected one of {TEXT_MODES}")
    to_text = (T.ArrayType, T.MapType, T.StructType, T.TimestampType, T.TimestampNTZType)
    one_line = escape if text == "escaped" else _refuse_line_breaks
    columns = []
    for f in df.schema:
        col = F.col(quoted(f.name))
        if isinstance(f.dataType, to_text):
            col = col.cast("string")
        if isinstance(f.dataType, (*to_text, T.StringType)):
            col = one_line(col)
        columns.append(col.alias(escape_name(f.name) if text == "escaped" else f.name))
    return df.select(*columns)


def _refuse_line_breaks(col: Column) -> Column:
    broken = F.raise_error("a text holds a line break, which plain CSV cannot keep in one row")
    return F.when(col.rlike(r"[\r\n]"), broken.cast("string")).otherwise(col)


def is_escaped(spark: SparkSession, path: str) -> bool:
    """Whether the CSV folder bears the marker of escaped text. Reads names only."""
    try:
        spark.read.text(f"{path.rstrip('/')}/{ESCAPED_MARKER}")
    except AnalysisException:
        return False
    return True


def _mark_escaped(spark: SparkSession, path: str) -> None:
    marker = spark.range(1, numPartitions=1).select(F.lit("one-line text").alias("value"))
    marker.write.mode("overwrite").text(f"{path.rstrip('/')}/{ESCAPED_MARKER}")


def _has_parts(spark: SparkSession, path: str) -> bool:
    try:
        return bool(spark.read.text(path).inputFiles())
    except AnalysisException:
        return False


def _csv_options(df: DataFrame, text: str) -> dict:
    # a null or spaces alone in a row would be an empty line, which readers leave out
    alone = text == "escaped" and len(df.columns) == 1
    return CSV_OPTIONS | ({"nullValue": NULL, "quoteAll": True} if alone else {})


def write_files(
    df: DataFrame, path: str, file_format: str, mode: str = "errorifexists", text: str = "escaped"
) -> str:
    if file_format == "csv":
        spark = df.sparkSession
        if mode == "append" and _has_parts(spark, path) and is_escaped(spark, path) != (
            text == "escaped"
        ):
            raise SpecError(f"{path} holds text of the other kind, csv_text must stay the same")
        as_delimited(df, text).write.mode(mode).options(**_csv_options(df, text)).csv(path)
        if text == "escaped":
            _mark_escaped(spark, path)
    else:
        df.write.mode(mode).parquet(path)
    return path


def start_file_stream(df: DataFrame, path: str, file_format: str, text: str = "escaped"):
    """Unstarted writer; the file sink commits each batch exactly once."""
    if file_format == "csv":
        delimited = as_delimited(df, text)
        if text == "escaped":
            _mark_escaped(df.sparkSession, path)
        writer = delimited.writeStream.format("csv")
        return writer.options(path=path, **_csv_options(df, text))
    return df.writeStream.format("parquet").option("path", path)

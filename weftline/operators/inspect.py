"""Looking at datasets: SQL over views, previews, statistics and schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.errors import SpecError
from weftline.functions.columns import quoted
from weftline.workspace import Workspace, view_name

PREVIEW_ROWS = 10
QUERY_ROWS = 60


def run_sql(workspace: Workspace, text: str | None = None, dataset: str | None = None):
    """Any Spark SQL over the ``view_<name>`` views; by default everything of one dataset."""
    if text is None and dataset is None:
        raise SpecError("give SQL text or a dataset name")
    if not workspace.views:
        for name, df in workspace.current.items():
            df.createOrReplaceTempView(view_name(name))
    return workspace.spark.sql(text or f"SELECT * FROM {view_name(dataset)}")


def preview(df: DataFrame, rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows in a displayable form. No count: the limit alone reads a few files."""
    return displayable(df.limit(rows))


def displayable(df: DataFrame) -> DataFrame:
    """Array, map and struct columns as text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.withColumns(
        {
            f.name: F.col(quoted(f.name)).cast("string")
            for f in df.schema
            if isinstance(f.dataType, nested)
        }
    )


def describe(df: DataFrame) -> DataFrame:
    """count, mean, stddev, min and max of the numeric and text columns, as text."""
    return df.summary("count", "mean", "stddev", "min", "max")


def schema_listing(df: DataFrame) -> DataFrame:
    """One row per field."""
    rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema]
    return df.sparkSession.createDataFrame(rows, "field string, type string, nullable boolean")

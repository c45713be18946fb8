"""Column lookup by the name a spec gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType


def same_name(df: DataFrame, a: str, b: str) -> bool:
    if df.sparkSession.conf.get("spark.sql.caseSensitive") == "true":
        return a == b
    return a.lower() == b.lower()


def find_name(df: DataFrame, name: str) -> str | None:
    """The top-level column that Spark's case rule matches to ``name``, if any."""
    if name in df.columns:
        return name
    return next((c for c in df.columns if same_name(df, c, name)), None)


def require_name(df: DataFrame, name: str) -> str:
    found = find_name(df, name)
    if found is None:
        raise KeyError(f"no column {name!r} in {df.columns}")
    return found


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column(df: DataFrame, path: str) -> Column:
    """A top-level column, even when its name has dots; otherwise a path into a struct."""
    found = find_name(df, path)
    return F.col(quoted(found)) if found is not None else F.col(path)


def type_of(df: DataFrame, col: Column) -> DataType:
    return df.select(col).schema[0].dataType

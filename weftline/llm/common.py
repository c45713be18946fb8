"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import weftline
from weftline.scratch import new_folder

#: Characters that separate words: space and the ASCII controls from tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
#: Bytes of rows that a Python worker is handed at once, where the session does not say.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, and gives Spark true sizes."""
    folder = new_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside hand about ``BATCH_BYTES`` to a Python worker at once, a row at least.

    By default it is 10,000 texts, which an executor holds several times over: in the vectors it
    fills, in the worker's batch and in the one before. A bound that the session sets is kept.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is not None:
        yield
        return
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(key)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def pack(docs: DataFrame, carry: list[str] | None = None, **named: Column) -> DataFrame:
    """The columns of ``docs`` (or those in ``carry``) as one struct ``row``, beside ``named``.

    Whatever the columns are called, they cannot clash with names an operator uses.
    """
    columns = docs.columns if carry is None else carry
    row = F.struct(*[column(c).alias(c) for c in columns])
    return docs.select(row.alias("row"), *[value.alias(name) for name, value in named.items()])


def words(text: Column) -> Column:
    """Words of the whole text; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES, -1), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver found it, as --py-files would."""
    context = spark.sparkContext
    if getattr(context, "_weftline_shipped", False):
        return
    root = Path(weftline.__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="weftline-py-")) / "weftline_package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, Path(root.name) / source.relative_to(root))
    context.addPyFile(str(archive))
    context._weftline_shipped = True

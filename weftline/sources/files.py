"""Delimited, JSON and Parquet files."""

from __future__ import annotations

import codecs
import posixpath
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.errors import SourceError
from weftline.functions.columns import quoted
from weftline.functions.escapes import unescape, unescape_name
from weftline.sinks.files import CSV_OPTIONS, is_escaped
from weftline.sources.decode import decode_json
from weftline.workspace import dataset_name

FORMATS = ("csv", "txt", "json", "parquet")


@dataclass(frozen=True)
class FileSpec:
    """One file or folder to import as one dataset.

    ``sep`` may use escapes such as ``\\t``. ``schema_skeleton`` is a sample JSON document; with
    it, JSON files are read without the pass over all data that schema inference takes.
    """

    path: str
    name: str | None = None
    format: str | None = None
    sep: str | None = None
    schema_skeleton: str | None = None
    options: dict[str, str] = field(default_factory=dict)

    @property
    def dataset(self) -> str:
        return self.name or dataset_name(self.path)

    @property
    def file_format(self) -> str:
        suffix = posixpath.splitext(self.path.rstrip("/"))[1].lstrip(".").lower()
        return self.format or suffix


def read_file(
    spark: SparkSession, spec: FileSpec, rules: list[dict] | None = None
) -> DataFrame:
    """``rules`` are the processes that will be applied next, if they are known (``decode_json``)."""
    kind = spec.file_format
    if kind == "csv":
        return _delimited(spark, spec, spec.sep or ",")
    if kind == "txt":
        if not spec.sep:
            raise SourceError(f"{spec.path}: a text file needs a separator")
        return _delimited(spark, spec, spec.sep)
    if kind == "json":
        if spec.schema_skeleton:
            lines = spark.read.options(**spec.options).text(spec.path)
            return decode_json(lines, spec.schema_skeleton, rules=rules)
        return spark.read.options(**spec.options).json(spec.path)
    if kind == "parquet":
        return spark.read.options(**spec.options).parquet(spec.path)
    raise SourceError(f"{spec.path}: no reader for {kind!r}, expected one of {FORMATS}")


def _delimited(spark: SparkSession, spec: FileSpec, sep: str) -> DataFrame:
    """Header gives the names; every column is text until a rule casts it.

    A folder that our CSV target marked as escaped gives back the text as it was.
    """
    sep = codecs.decode(sep, "unicode_escape")
    if not is_escaped(spark, spec.path):
        return spark.read.options(header=True, sep=sep, **spec.options).csv(spec.path)
    options = CSV_OPTIONS | {"sep": sep} | spec.options
    lines = spark.read.options(**options).csv(spec.path)
    return lines.select(
        *(unescape(F.col(quoted(c))).alias(unescape_name(c)) for c in lines.columns)
    )


def discover(
    spark: SparkSession, directory: str, extensions: tuple[str, ...] = ("csv", "json")
) -> list[FileSpec]:
    """Every matching file below a directory, one dataset each.

    Only paths are selected, so no file content is read.
    """
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{" + ",".join(extensions) + "}")
        .load(directory)
        .select(F.col("path"))
    )
    specs = [FileSpec(path) for path in sorted(row.path for row in listing.collect())]
    counts = Counter(spec.dataset for spec in specs)
    repeated = sorted(name for name, n in counts.items() if n > 1)
    if repeated:
        raise SourceError(f"{directory}: several files would import as {repeated}")
    return specs

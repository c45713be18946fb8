"""Target specs: writes a list of datasets, each as batch or stream by what it is."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from weftline.errors import SpecError, StreamError
from weftline.operators.inspect import displayable
from weftline.sinks.files import output_path, start_file_stream, write_files
from weftline.sinks.jdbc import DEFAULT_TRIGGER, append_table, batch_writer, jdbc_options
from weftline.workspace import Workspace

TYPES = ("download", "console", "jdbc")
CONSOLE_ROWS = 20


@dataclass
class Exported:
    paths: dict[str, str] = field(default_factory=dict)
    queries: list[StreamingQuery] = field(default_factory=list)


@dataclass(frozen=True)
class RunPlace:
    """Where one target of one pipeline keeps its files and its stream progress."""

    output_dir: str
    checkpoint_root: str
    pipeline: str = "pipeline"
    target: str = "target"

    def checkpoint(self, dataset: str) -> str:
        """One folder per stream, the same after a restart."""
        return "/".join(
            (self.checkpoint_root.rstrip("/"), self.pipeline, self.target, dataset)
        )


def export(workspace: Workspace, target: dict, place: RunPlace) -> Exported:
    kind, datasets = target.get("type"), target.get("datasets")
    if kind not in TYPES:
        raise SpecError(f"unknown target type {kind!r}, expected one of {TYPES}")
    if not datasets:
        raise SpecError("the target lists no datasets")
    exported = Exported()
    try:
        for dataset in datasets:
            _export_one(workspace[dataset], dataset, target, place, exported)
    except Exception:
        for query in exported.queries:
            query.stop()
        raise
    return exported


def _export_one(
    df: DataFrame, dataset: str, target: dict, place: RunPlace, exported: Exported
) -> None:
    if target["type"] == "download":
        file_format = (target.get("conversions") or {}).get(dataset)
        path = output_path(target.get("path", place.output_dir), dataset, str(file_format))
        text = target.get("csv_text", "escaped")
        if df.isStreaming:
            _refuse_foreign_output(df.sparkSession, path, place.checkpoint(dataset))
            writer = start_file_stream(df, path, str(file_format), text)
            exported.queries.append(_start(writer, dataset, target, place))
        else:
            mode = target.get("mode", "errorifexists")
            write_files(df, path, str(file_format), mode, text)
        exported.paths[dataset] = path
    elif target["type"] == "console":
        if df.isStreaming:
            writer = df.writeStream.format("console").option(
                "numRows", int(target.get("rows", CONSOLE_ROWS))
            )
            exported.queries.append(_start(writer, dataset, target, place))
        else:
            displayable(df).show(int(target.get("rows", CONSOLE_ROWS)))
    else:
        options = jdbc_options(target)
        batch_id = target.get("batch_id_column")
        write = batch_writer(lambda batch: append_table(batch, options), batch_id)
        if df.isStreaming:
            writer = df.writeStream.foreachBatch(write)
            exported.queries.append(_start(writer, dataset, target, place, DEFAULT_TRIGGER))
        else:
            write(df, 0)


def _refuse_foreign_output(spark: SparkSession, path: str, checkpoint: str) -> None:
    """Spark's file sink skips batches whose numbers its output folder lists already, so a stream
    with new progress would lose rows in a folder that another stream, or lost progress, wrote."""
    if _exists(spark, path) and not _exists(spark, f"{checkpoint}/commits"):
        raise StreamError(
            f"{path} holds files of a stream whose progress is not in {checkpoint}; its rows would "
            "be skipped. Use another output folder, or the progress folder of that stream"
        )


def _exists(spark: SparkSession, folder: str) -> bool:
    """Whether Spark finds a file of any kind below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    try:
        return not found.load(folder).select("path").isEmpty()
    except AnalysisException:
        return False


def _start(
    writer: DataStreamWriter,
    dataset: str,
    target: dict,
    place: RunPlace,
    default_trigger: str | None = None,
) -> StreamingQuery:
    trigger = target.get("trigger", default_trigger)
    if trigger == "available_now":
        writer = writer.trigger(availableNow=True)
    elif trigger:
        writer = writer.trigger(processingTime=trigger)
    return (
        writer.outputMode("append")
        .queryName(f"{place.pipeline}.{place.target}.{dataset}")
        .option("checkpointLocation", place.checkpoint(dataset))
        .start()
    )

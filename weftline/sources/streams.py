"""Event sources: Kafka topics, and folders of text or Parquet files as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.errors import SourceError, SpecError
from weftline.functions.columns import quoted, type_of
from weftline.sources.decode import decode_json


def kafka_options(spec: dict) -> dict[str, str]:
    try:
        required = {
            "kafka.bootstrap.servers": spec["server_spec"],
            "subscribe": spec["topic_to_subscribe"],
        }
    except KeyError as error:
        raise SpecError(f"Kafka source misses {error}") from error
    return {**required, "startingOffsets": "earliest", **spec.get("options", {})}


def read_transport(spark: SparkSession, spec: dict) -> DataFrame:
    """Rows as the transport delivers them; ``snapshot`` reads what is there now, once."""
    reader = spark.read if spec.get("snapshot") else spark.readStream
    origin = spec.get("stream_from")
    if origin == "kafka":
        return reader.format("kafka").options(**kafka_options(spec)).load()
    if origin == "files":
        kind = spec.get("file_format", "text")
        options = spec.get("options", {})
        reader = reader.format(kind).options(**options)
        if kind != "text":
            # Streams do not infer schemas; take the one the files already carry.
            reader = reader.schema(
                spark.read.format(kind).options(**options).load(spec["path"]).schema
            )
        return reader.load(spec["path"])
    raise SourceError(f"unknown stream_from {origin!r}, expected 'kafka' or 'files'")


def read_stream(
    spark: SparkSession, spec: dict, rules: list[dict] | None = None
) -> DataFrame:
    """``rules`` are the processes that will be applied next, if they are known (``decode_json``)."""
    df = read_transport(spark, spec)
    watermark = spec.get("watermark")
    if spec.get("schema_skeleton"):
        # the event time must be parsed, whatever the rules use
        df = decode_json(df, spec["schema_skeleton"], rules=None if watermark else rules)
    if watermark and df.isStreaming:
        # event time has a zone; one without is taken in the session's
        time = F.col(quoted(watermark["column"]))
        if isinstance(type_of(df, time), T.TimestampNTZType):
            df = df.withColumn(watermark["column"], time.cast("timestamp"))
        df = df.withWatermark(watermark["column"], watermark["delay"])
    return df

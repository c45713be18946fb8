"""Says early, and in terms of the spec, which fusions Spark does not run on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame

from weftline.errors import StreamError

# Join types Spark supports, by whether the left and the right side are streams.
_ALLOWED = {
    (True, False): ("inner", "left"),
    (False, True): ("inner", "right"),
}


def _has_watermark(df: DataFrame, column: str) -> bool:
    field = next(f for f in df.schema if f.name == column)
    return "spark.watermarkDelayMs" in (field.metadata or {})


def check_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> None:
    sides = (left.isStreaming, right.isStreaming)
    if sides == (True, True):
        marked = any(_has_watermark(side, key) for side in (left, right) for key in keys)
        if how != "inner" and not marked:
            raise StreamError(f"{how} join of two streams needs a watermark on a key column")
    elif any(sides) and how not in _ALLOWED[sides]:
        raise StreamError(
            f"{how} join of a {'stream' if sides[0] else 'static'} left side with a "
            f"{'stream' if sides[1] else 'static'} right side is not supported; "
            f"possible here: {_ALLOWED[sides]}"
        )


def check_join_within(
    left: DataFrame, right: DataFrame, left_time: str, right_time: str, how: str
) -> None:
    """Two streams need a watermark on both times; else the usual rules for joins hold."""
    if (left.isStreaming, right.isStreaming) != (True, True):
        check_join(left, right, [], how)
        return
    for side, df, time in (("left", left, left_time), ("right", right, right_time)):
        if not _has_watermark(df, time):
            raise StreamError(f"the {side} side needs a watermark on {time!r} to bound its state")


def check_union(inputs: list[DataFrame]) -> None:
    if len({df.isStreaming for df in inputs}) > 1:
        raise StreamError("row fusion cannot mix streams with static datasets")

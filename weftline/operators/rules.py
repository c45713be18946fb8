"""Rule operators: each turns a DataFrame and its ``data_map`` into a DataFrame.

A rule is ``{dataset: [{"operation": ..., "data_map": {...}}, ...]}``. The operators only add
nodes to the logical plan, so a rule runs unchanged on a batch table or a stream. The single
exception is the median, which needs a few one-row jobs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.errors import RuleError, SpecError
from weftline.functions import statistics
from weftline.functions.casting import (
    CAST_TYPES,
    is_fractional,
    reformat_date,
    soft_cast,
    spec_text,
)
from weftline.functions.columns import column, find_name, quoted, require_name, type_of
from weftline.functions.predicates import predicate
from weftline.scratch import new_folder
from weftline.workspace import Workspace


@dataclass(frozen=True)
class RuleContext:
    workspace: Workspace | None
    dataset: str
    #: Medians that were found together, by the position of the process and for the next ones.
    medians: dict[str, Column] = field(default_factory=dict)


Args = dict[str, Any]
Operator = Callable[[DataFrame, Args, RuleContext], DataFrame]


def _need(args: Args, *fields: str) -> list:
    missing = [f for f in fields if args.get(f) is None]
    if missing:
        raise SpecError(f"missing field(s) {', '.join(missing)}")
    return [args[f] for f in fields]


def cast(df: DataFrame, args: Args, context: RuleContext) -> DataFrame:
    name, type_name = _need(args, "column_to_cast", "cast_type")
    name = require_name(df, name)
    col = F.col(quoted(name))
    if type_name == "date":
        parse_pattern, emit_pattern = _need(args, "cast_from", "cast_to")
        return df.withColumn(name, reformat_date(col, parse_pattern, emit_pattern))
    if type_name not in CAST_TYPES:
        raise SpecError(f"unknown cast type {type_name!r}, expected date or {list(CAST_TYPES)}")
    return df.withColumn(name, soft_cast(col, type_of(df, col), CAST_TYPES[type_name]))


def rename(df: DataFrame, args: Args, context: RuleContext) -> DataFrame:
    old, new = _need(args, "source_reference", "data_reference")
    taken = find_name(df, new)
    if find_name(df, old) and taken and taken != find_name(df, old):
        raise SpecError(f"there is a column {taken!r} already")
    return df.withColumnRenamed(old, new)


def filter_rows(df: DataFrame, args: Args, context: RuleContext) -> DataFrame:
    source, op, value = _need(args, "source_reference", "operator", "data_reference")
    return df.where(predicate(df, source, op, value))


def drop(df: DataFrame, args: Args, context: RuleContext) -> DataFrame:
    how, names = _need(args, "drop_by", "data_reference")
    names = [names] if isinstance(names, str) else list(names)
    if not names:
        raise SpecError("data_reference names no column")
    if names == ["All"] and not find_name(df, "All"):
        names = df.columns
    if how == "column":
        return df.drop(*(name for name in map(lambda n: find_name(df, n), names) if name))
    names = [require_name(df, name) for name in names]
    if how == "null values":
        return df.where(reduce(and_, (_is_present(df, name) for name in names), F.lit(True)))
    if how == "duplicates":
        return _drop_duplicates(df, names, args.get("watermark"))
    raise SpecError(f"unknown drop_by {how!r}")


def _is_present(df: DataFrame, name: str) -> Column:
    """Neither null nor NaN; null tests are plain, so that scans can use them."""
    col = F.col(quoted(name))
    present = col.isNotNull()
    return present & ~F.isnan(col) if is_fractional(type_of(df, col)) else present


def _drop_duplicates(df: DataFrame, names: list[str], watermark: Args | None) -> DataFrame:
    if not watermark:
        return df.dropDuplicates(names)
    if not df.isStreaming:
        return df.dropDuplicates(names)
    # Bounds the state of a stream: a key is forgotten once the watermark has passed it.
    event_time, delay = _need(watermark, "column", "delay")
    return df.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(names)


def fill(df: DataFrame, args: Args, context: RuleContext) -> DataFrame:
    (how,) = _need(args, "fill_by")
    if how == "column":
        return _fill_column(df, args)
    if how == "null values":
        return _fill_nulls(df, args, context)
    raise SpecError(f"unknown fill_by {how!r}")


def _fill_column(df: DataFrame, args: Args) -> DataFrame:
    name, value = _need(args, "column_name", "data_reference")
    constant = F.lit(spec_text(value))
    existing = find_name(df, name)
    if not args.get("apply_filter"):
        return df.withColumn(existing or name, constant)
    source, op, compared = _need(
        args, "fill_filter_source_reference", "operator", "fill_filter_data_reference"
    )
    # The constant is text, so the column becomes text: spelled out, because Spark would
    # otherwise pick the common type by ANSI mode.
    kept = F.col(quoted(existing)) if existing else F.lit(None)
    test = predicate(df, source, op, compared)
    return df.withColumn(
        existing or name, F.when(test, constant).otherwise(kept.cast("string"))
    )


_STATISTICS: dict[str, Callable[[DataFrame, str], Column]] = {
    "mean": statistics.mean,
    "median": statistics.median,
    "standard deviation": statistics.standard_deviation,
}


def _fill_nulls(df: DataFrame, args: Args, context: RuleContext) -> DataFrame:
    (name,) = _need(args, "column_name")
    name = require_name(df, name)
    col = F.col(quoted(name))
    dtype = type_of(df, col)
    value = args.get("data_reference")
    if value is not None:
        replacement = soft_cast(F.lit(spec_text(value)), T.StringType(), dtype)
    else:
        (condition,) = _need(args, "fill_condition")
        if condition not in _STATISTICS:
            raise SpecError(f"fill_condition {condition!r} needs a data_reference")
        if condition == "median" and name in context.medians:
            replacement = context.medians.pop(name).try_cast(dtype)
        else:
            measured = _statistics_input(df, args, context)
            replacement = _STATISTICS[condition](measured, name).try_cast(dtype)
    if is_fractional(dtype):
        col = F.when(~F.isnan(col), col)
    return df.withColumn(name, F.coalesce(col, replacement))


def _statistics_input(df: DataFrame, args: Args, context: RuleContext) -> DataFrame:
    """What the statistic is taken over: the column itself, or for streams a static dataset."""
    stats_from = args.get("stats_from")
    if stats_from is not None:
        if context.workspace is None:
            raise SpecError("stats_from needs a workspace")
        measured = context.workspace[stats_from]
    else:
        measured = df
    if measured.isStreaming:
        raise SpecError("a statistic needs a static dataset: name one in stats_from")
    return measured


def explode(df: DataFrame, args: Args, context: RuleContext) -> DataFrame:
    name, path = _need(args, "new_column_name", "data_reference")
    array = column(df, path)
    if not isinstance(type_of(df, array), T.ArrayType):
        raise SpecError(f"{path!r} is not an array")
    # A plain explode makes Spark test the array's size below it, which computes an array that
    # comes from JSON twice. Positions are null only where there is no element.
    position, element = "__position", "__element"
    exploded = df.select("*", F.posexplode_outer(array).alias(position, element))
    exploded = exploded.where(F.col(position).isNotNull())
    return exploded.withColumn(name, F.col(element)).drop(position, element)


def flatten(df: DataFrame, args: Args, context: RuleContext) -> DataFrame:
    name, path = _need(args, "new_column_name", "data_reference")
    return df.withColumn(name, column(df, path))


def save(df: DataFrame, args: Args, context: RuleContext) -> DataFrame:
    (name,) = _need(args, "save_as")
    if context.workspace is None:
        raise SpecError("Save needs a workspace")
    if args.get("materialize"):
        df = _written(df, name)
    context.workspace.save(name, df, overwrite=bool(args.get("overwrite")))
    return df


def _written(df: DataFrame, name: str) -> DataFrame:
    """Write a snapshot that several targets build on once, instead of computing it for each."""
    if df.isStreaming:
        raise SpecError("a stream cannot be materialized")
    path = new_folder(df.sparkSession, f"save-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


OPERATIONS: dict[str, Operator] = {
    "Cast": cast,
    "Rename": rename,
    "Filter": filter_rows,
    "Drop": drop,
    "Fill": fill,
    "Explode": explode,
    "Flatten": flatten,
    "Save": save,
}


def _shared_medians(df: DataFrame, processes: list[dict], context: RuleContext) -> dict:
    """Medians of the null fills at the head of ``processes``, found in the same passes.

    Filling one column leaves the others as they are, so the medians of different columns can be
    found before any of them is filled. Less than two medians are left to the fill itself.
    """
    names: list[str] = []
    filled, source = set(), None
    for process in processes:
        args = process.get("data_map") or {}
        if process.get("operation") != "Fill" or args.get("fill_by") != "null values":
            break
        name = find_name(df, str(args.get("column_name")))
        if name is None or name in filled:
            break
        filled.add(name)
        if args.get("data_reference") is None and args.get("fill_condition") == "median":
            if names and args.get("stats_from") != source:
                break
            names.append(name)
            source = args.get("stats_from")
    if len(names) < 2:
        return {}
    measured = _statistics_input(df, {"stats_from": source}, context)
    return statistics.medians(measured, names)


def apply_processes(
    df: DataFrame,
    processes: list[dict],
    workspace: Workspace | None = None,
    dataset: str = "dataset",
) -> DataFrame:
    """Fold an ordered list of processes over one DataFrame."""
    context = RuleContext(workspace, dataset)
    for index, process in enumerate(processes):
        operation = process.get("operation")
        try:
            if operation not in OPERATIONS:
                raise SpecError(f"unknown operation, expected one of {list(OPERATIONS)}")
            args = process.get("data_map")
            if not args:
                raise SpecError("empty data_map")
            if not context.medians:
                context.medians.update(_shared_medians(df, processes[index:], context))
            df = OPERATIONS[operation](df, args, context)
        except Exception as error:
            raise RuleError(dataset, index, str(operation), error) from error
    return df


def apply_rule(workspace: Workspace, rule: dict[str, list[dict]], reset: bool = False) -> None:
    """Rewrite the working copies a rule names.

    Rules build on what earlier rules left. ``reset`` starts from the imported data instead.
    """
    for dataset, processes in rule.items():
        try:
            df = workspace.reset(dataset) if reset else workspace[dataset]
        except KeyError as error:
            raise RuleError(dataset, 0, "rule", error) from error
        workspace.update(dataset, apply_processes(df, processes, workspace, dataset))

"""Fusion: equi-joins and row unions over any number of named datasets."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.errors import FusionError, SpecError
from weftline.functions.casting import INTEGRAL_RANGE, is_fractional, is_integral, soft_cast
from weftline.functions.columns import find_name, quoted, same_name
from weftline.operators import skew
from weftline.operators.lineage import Lineage, joined
from weftline.streaming.legality import check_join, check_join_within, check_union
from weftline.workspace import Workspace

JOIN_TYPES = ("inner", "left", "right", "outer")
SKEW_MODES = ("salt", "always", "adaptive")


def fusable_columns(workspace: Workspace, datasets: list[str]) -> list[str]:
    """Columns whose name and type occur in all datasets, in the first dataset's order."""
    first, *others = (workspace[name].dtypes for name in datasets)
    return [name for name, dtype in first if all((name, dtype) in other for other in others)]


def run_fusion(workspace: Workspace, steps: list[dict]) -> list[str]:
    """Run all steps in order; a later step may use an earlier step's output."""
    return [run_step(workspace, step) for step in steps]


def run_step(workspace: Workspace, step: dict) -> str:
    datasets = step.get("datasets_to_fuse")
    if not datasets or isinstance(datasets, str):
        raise SpecError("datasets_to_fuse must list the datasets")
    name = step.get("fused_dataset_name") or "_".join(datasets)
    if step.get("fuse_by") == "column":
        fused, lineage = _fuse_columns(
            workspace,
            datasets,
            step.get("fuse_on"),
            step.get("fuse_how"),
            step.get("skew", "salt"),
            int(step.get("hot_rows", skew.HOT_ROWS)),
            step.get("event_time"),
        )
        workspace.add(name, fused)
        workspace.lineages[name] = (fused, lineage)
    else:
        workspace.add(name, fuse_rows(workspace, datasets))
    return name


def fuse_columns(
    workspace: Workspace,
    datasets: list[str],
    on: str | list[str] | None,
    how: str | None = None,
    skew_mode: str = "salt",
    hot_rows: int = skew.HOT_ROWS,
    event_time: dict | None = None,
) -> DataFrame:
    """Left fold of joins on shared columns: keys first, then left and right columns.

    ``skew_mode`` is ``salt`` (spread hot keys of joins that Spark will not broadcast), ``always``
    (of all joins) or ``adaptive`` (leave them to adaptive execution). ``event_time`` bounds a join of
    two datasets to rows that lie close in time (``_join_within``).
    """
    return _fuse_columns(workspace, datasets, on, how, skew_mode, hot_rows, event_time)[0]


def _fuse_columns(
    workspace: Workspace,
    datasets: list[str],
    on: str | list[str] | None,
    how: str | None,
    skew_mode: str,
    hot_rows: int,
    event_time: dict | None = None,
) -> tuple[DataFrame, Lineage]:
    how = how or "inner"
    keys = [on] if isinstance(on, str) else list(on or [])
    if not keys:
        raise FusionError("fuse_on names no column; a Cartesian product is not offered")
    if how not in JOIN_TYPES:
        raise FusionError(f"unknown fuse_how {how!r}, expected one of {JOIN_TYPES}")
    if skew_mode not in SKEW_MODES:
        raise FusionError(f"unknown skew {skew_mode!r}, expected one of {SKEW_MODES}")

    given = [_with_keys(workspace[name], keys, name) for name in datasets]
    if event_time is not None:
        fused = _join_within(given, datasets, keys, how, event_time)
        return fused, Lineage({})
    inputs, mixed = _with_typed_keys(given, keys)
    lineages = [
        _lineage(workspace, name, df, keys, mixed) for name, df in zip(datasets, inputs)
    ]
    spread = (
        skew_mode != "adaptive"
        and skew.comparable(inputs, keys)  # streams are not: their size is not asked for
        and (skew_mode == "always" or not skew.broadcasts(inputs, how))
    )

    fused, lineage = inputs[0], lineages[0]
    for right, name, right_lineage in zip(inputs[1:], datasets[1:], lineages[1:]):
        check_join(fused, right, keys, how)
        right, renamed = _without_clashes(fused, right, keys, name)
        right_lineage = right_lineage.renamed(renamed)
        sides = (lineage.summary(keys), right_lineage.summary(keys)) if spread else (None, None)
        if None not in sides and any(side.hot(hot_rows) for side in sides):
            fused = skew.salted_join(fused, right, keys, how, *sides, hot_rows)
        else:
            fused = fused.join(right, on=keys, how=how)
        lineage = joined(lineage, right_lineage, keys, how)
        fused = _with_kept_given_keys(fused, mixed, how)
    for key in mixed:
        fused = fused.withColumn(key, F.col(quoted(_GIVEN + key))).drop(_GIVEN + key)
    # keys as given differ from those that were compared
    return fused, lineage.without([*mixed, *(_GIVEN + key for key in mixed)])


_DURATION = re.compile(r"[0-9]+ (second|minute|hour|day)s?")


def _join_within(
    inputs: list[DataFrame], datasets: list[str], keys: list[str], how: str, event_time: dict
) -> DataFrame:
    """Join two datasets by keys where the times of both rows differ by ``within`` at most.

    ``event_time`` is ``{"left": column, "right": column, "within": "30 minutes"}``. The same on
    batches and on streams. On streams both times need a watermark: a row is forgotten once no row
    of the other side can still match it, so state is bounded by the watermark's delay and
    ``within``. Rows that come later than the watermark allows are dropped, and a kept row without a
    match is given out when the watermark has passed its time by ``within``.
    """
    if len(inputs) != 2:
        raise FusionError(f"event_time joins two datasets, got {datasets}")
    within = event_time.get("within")
    if not isinstance(within, str) or not _DURATION.fullmatch(within):
        raise SpecError(f"within is a duration such as '30 minutes', not {within!r}")
    left, right = inputs
    times = []
    for side, df, dataset in (("left", left, datasets[0]), ("right", right, datasets[1])):
        time = find_name(df, str(event_time.get(side)))
        if time is None:
            raise FusionError(f"dataset {dataset!r} has no column {event_time.get(side)!r}")
        times.append(time)
    check_join_within(left, right, *times, how)
    right, renamed = _without_clashes(left, right, keys, datasets[1])
    time = renamed.get(times[1], times[1])
    own = [f"__right_{i}" for i in range(len(keys))]
    right = right.withColumnsRenamed(dict(zip(keys, own)))
    span = F.expr(f"INTERVAL '{within}'")
    met = F.col(quoted(time)).between(
        F.col(quoted(times[0])) - span, F.col(quoted(times[0])) + span
    )
    if times[0] == time:  # the times are the keys
        raise FusionError("event_time names a key column")
    for key, other in zip(keys, own):
        met = met & (F.col(quoted(key)) == F.col(other))
    fused = left.join(right, met, how)
    taken = {"right": lambda k, o: F.col(o), "outer": lambda k, o: F.coalesce(quoted(k), o)}.get(
        how, lambda k, o: F.col(quoted(k))
    )
    rest = [c for c in (*left.columns, *right.columns) if c not in (*keys, *own)]
    return fused.select(
        *(taken(key, other).alias(key) for key, other in zip(keys, own)), *map(quoted, rest)
    )


def _lineage(
    workspace: Workspace, name: str, df: DataFrame, keys: list[str], mixed: dict[str, bool]
) -> Lineage:
    """What is known of a dataset as it enters a join; one that no fusion made is an import."""
    known = workspace.lineage(name)
    if known is None:
        return Lineage.of_import(df)
    spelled = {}
    for key in keys:
        spelled.update({c: key for c in workspace[name].columns if same_name(df, c, key)})
    return known.renamed(spelled).without(list(mixed))


_GIVEN, _GIVEN_RIGHT = "__given_", "__given_right_"


def _with_typed_keys(
    inputs: list[DataFrame], keys: list[str]
) -> tuple[list[DataFrame], dict[str, bool]]:
    """Where the types of a key differ so that Spark would compare rounded values, compare exactly.

    That is where text meets numbers or other types, and where fractional numbers meet whole or
    decimal ones. Keys become the narrowest type that holds the values of all inputs that are no
    text; a key whose value that type cannot hold exactly ("5.7" for whole numbers), or that does
    not parse, matches nothing, with ANSI mode on or off. The order of the inputs does not matter.
    The keys as given travel along under other names. Also tells, per such key, if there is text.
    """
    types = [{f.name: f.dataType for f in df.schema} for df in inputs]
    mixed = {}
    for key in keys:
        own = [t[key] for t in types]
        others = [t for t in own if not isinstance(t, T.StringType)]
        text_meets = 0 < len(others) < len(own)
        fractions_meet = all(map(_is_number, own)) and (
            0 < sum(map(is_fractional, own)) < len(own)
        )
        if not (text_meets or fractions_meet):
            continue
        mixed[key] = text_meets
        col = F.col(quoted(key))
        widest = _widest(key, others)
        inputs = [
            df.withColumns(
                {
                    (_GIVEN_RIGHT if i else _GIVEN) + key: col,
                    key: _exact_key(col, t[key], widest),
                }
            )
            for i, (df, t) in enumerate(zip(inputs, types))
        ]
    return inputs, mixed


_INTEGRAL_DIGITS = 19


def _widest(key: str, types: list[T.DataType]) -> T.DataType:
    """The type that holds the values of all the types; doubles hold what they can exactly."""
    if all(t == types[0] for t in types):
        return types[0]
    if all(map(is_integral, types)):
        return max(types, key=lambda t: INTEGRAL_RANGE[type(t)][1])
    if not all(map(_is_number, types)):
        return types[0]
    if any(map(is_fractional, types)):
        return T.DoubleType()
    scale = max(t.scale for t in types if isinstance(t, T.DecimalType))
    whole = max(
        t.precision - t.scale if isinstance(t, T.DecimalType) else _INTEGRAL_DIGITS for t in types
    )
    if whole + scale > 38:
        raise FusionError(f"no decimal type holds all values of key {key!r}: cast it first")
    return T.DecimalType(whole + scale, scale)


def _exact_key(col: Column, given: T.DataType, target: T.DataType) -> Column:
    if isinstance(given, T.StringType):
        return _exact_text_key(col, target)
    if given == target:
        return col
    if is_fractional(target) and not is_fractional(given):
        number = col.cast(target)
        back = number.cast(T.DecimalType(38, _scale(given)))
        return F.when(back == col, number)
    return col.try_cast(target)


def _scale(dtype: T.DataType) -> int:
    return dtype.scale if isinstance(dtype, T.DecimalType) else 0


def _exact_text_key(col: Column, target: T.DataType) -> Column:
    number = soft_cast(col, T.StringType(), target)
    if is_integral(target):
        # the cast keeps the whole part; a fraction other than zeros is no whole number
        return F.when(F.regexp_extract(col, r"\.([0-9]*)", 1).rlike("^0*$"), number)
    if isinstance(target, T.DecimalType):
        # a cast would round further digits away, and throws for what is no number
        pattern = rf"^\s*[+-]?([0-9]+(\.[0-9]{{0,{target.scale}}}0*)?|\.[0-9]{{1,{target.scale}}}0*)\s*$"
        if not target.scale:
            pattern = r"^\s*[+-]?[0-9]+(\.0*)?\s*$"
        return F.when(col.rlike(pattern), number)
    if is_fractional(target):
        # whole numbers that a double would round
        whole = F.when(col.rlike(r"^\s*[+-]?[0-9]{16,38}\s*$"), col)
        kept = number.cast("double").cast("decimal(38,0)") == whole.try_cast("decimal(38,0)")
        return F.when(whole.isNull() | kept, number)
    return number


def _with_kept_given_keys(fused: DataFrame, mixed: dict[str, bool], how: str) -> DataFrame:
    """After a join, keep the given key of the side that a USING join takes it from."""
    for key, has_text in mixed.items():
        left, right = F.col(quoted(_GIVEN + key)), F.col(quoted(_GIVEN_RIGHT + key))
        if how == "outer":
            if has_text:
                left, right = left.cast("string"), right.cast("string")
            given = F.coalesce(left, right)
        else:
            given = right if how == "right" else left
        fused = fused.withColumn(_GIVEN + key, given).drop(_GIVEN_RIGHT + key)
    return fused


def _with_keys(df: DataFrame, keys: list[str], dataset: str) -> DataFrame:
    """Spell the key columns as the spec does."""
    for key in keys:
        found = find_name(df, key)
        if found is None:
            raise FusionError(f"dataset {dataset!r} has no column {key!r}: {df.columns}")
        if found != key:
            df = df.withColumnRenamed(found, key)
    return df


def _without_clashes(
    left: DataFrame, right: DataFrame, keys: list[str], dataset: str
) -> tuple[DataFrame, dict[str, str]]:
    """Suffix the right side's non-key columns whose names the left side already uses."""
    taken = list(left.columns)
    renamed = {}
    for name in right.columns:
        if name in keys:
            continue
        new = name
        while any(same_name(left, new, other) for other in taken):
            new = f"{new}_{dataset}"
        taken.append(new)
        if new != name:
            renamed[name] = new
    return (right.withColumnsRenamed(renamed) if renamed else right), renamed


def fuse_rows(workspace: Workspace, datasets: list[str]) -> DataFrame:
    """Positional UNION ALL; names come from the first dataset, duplicates stay."""
    inputs = [workspace[name] for name in datasets]
    check_union(inputs)
    widths = {name: len(df.columns) for name, df in zip(datasets, inputs)}
    if len(set(widths.values())) > 1:
        raise FusionError(f"row fusion needs equal column counts, got {widths}")
    return reduce(DataFrame.union, _as_text_where_mixed(inputs))


def _as_text_where_mixed(inputs: list[DataFrame]) -> list[DataFrame]:
    """Columns whose types have no common family become text on all sides."""
    by_position = list(zip(*([f.dataType for f in df.schema] for df in inputs)))
    mixed = [not _common_family(types) for types in by_position]
    if not any(mixed):
        return inputs
    return [
        df.select(
            *(
                F.col(quoted(name)).cast("string").alias(name) if is_mixed else quoted(name)
                for name, is_mixed in zip(df.columns, mixed)
            )
        )
        for df in inputs
    ]


def _common_family(types: tuple[T.DataType, ...]) -> bool:
    known = [t for t in types if not isinstance(t, T.NullType)]
    return (
        all(t == known[0] for t in known)
        or all(_is_number(t) for t in known)
        or all(isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) for t in known)
        or any(isinstance(t, (T.ArrayType, T.MapType, T.StructType)) for t in known)
    )


def _is_number(dtype: T.DataType) -> bool:
    return is_integral(dtype) or is_fractional(dtype) or isinstance(dtype, T.DecimalType)

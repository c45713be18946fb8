"""Equi-joins that stay balanced when one key holds a large share of the rows.

Adaptive execution splits a skewed partition only between two plain shuffles, and only on the
kept side of an outer join: not for a full outer join, not when one input is an aggregate or
another join on the same key. So unless a join will broadcast, hot keys are looked up first, in
summaries of the imports (``lineage``). If there are none, the plain join is used. Otherwise, the
rows of a hot key are spread over several cells and the other side's rows of that key are copied
into each cell, for hot keys only. Rows with null keys, which match nothing, are spread as well.

Summaries decide balance only. Whether a copied row without a match is kept follows from the keys
that the other side holds when the join runs.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.casting import is_fractional, is_integral
from weftline.functions.columns import quoted

HOT_ROWS = 1_000_000
# Keys a summary tracks. Every key with more than about 1 in 18,000 rows is among them, whatever the
# size of the table: the sketch is off by at most 3.5 / TRACKED of all rows.
TRACKED = 65_536

_CELL = ("__left_cell", "__right_cell")
_SEEN = ("__left_seen", "__right_seen")


@dataclass
class KeySummary:
    """What is known of the keys of a dataset: estimated rows of the frequent ones (None counts null
    keys), and the mean rows of a key among the others."""

    heavy: dict[object, float] = field(default_factory=dict)
    light: float = 1.0

    def hot(self, hot_rows: int) -> bool:
        return any(n >= hot_rows for n in self.heavy.values())


def token(df: DataFrame, keys: list[str]) -> Column:
    """A value that two rows share exactly if a join takes their keys as equal.

    Null if any key column is null, since such a row joins with nothing.
    """
    if len(keys) == 1:
        if is_integral(_key_type(df, keys[0])):
            return F.col(quoted(keys[0])).cast("long")
        return _text(df, keys[0])
    parts = [_text(df, key) for key in keys]
    # The length prefix keeps ("ab", "c") and ("a", "bc") apart.
    return F.concat(*(F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts))


def _text(df: DataFrame, key: str) -> Column:
    col, dtype = F.col(quoted(key)), _key_type(df, key)
    if is_fractional(dtype):
        col = col + F.lit(0.0).cast(dtype)  # joins take -0.0 and 0.0 as equal
    elif isinstance(dtype, T.TimestampType):
        col = F.unix_micros(col)  # local time text is ambiguous when clocks go back
    return col.cast("string")


def _key_type(df: DataFrame, key: str) -> T.DataType:
    return next(f.dataType for f in df.schema if f.name == key)


def comparable(inputs: list[DataFrame], keys: list[str]) -> bool:
    """Whether tokens of different inputs can be compared."""
    if any(df.isStreaming for df in inputs):
        return False
    return all(_same_text([_key_type(df, key) for df in inputs]) for key in keys)


def _same_text(types: list[T.DataType]) -> bool:
    if all(is_integral(t) for t in types):
        return True
    if any(t != types[0] for t in types):
        return False
    if isinstance(types[0], T.StringType):
        return types[0].simpleString() == "string"  # no collation
    return isinstance(types[0], T.AtomicType) and not isinstance(types[0], T.BinaryType)


def broadcasts(inputs: list[DataFrame], how: str) -> bool:
    """Whether Spark's own size estimates let every join of the fold broadcast a side.

    Such joins do not shuffle, so a hot key cannot unbalance them. Spark decides on the same
    estimates; nothing is forced here.
    """
    small = [_is_small(df) for df in inputs]
    if how == "inner" and len(inputs) == 2:
        return any(small)
    if how in ("inner", "left"):
        return all(small[1:])
    return how == "right" and len(inputs) == 2 and small[0]


_UNITS = {"": 1, "b": 1} | {
    f"{unit}{suffix}": 2 ** (10 * power)
    for power, unit in enumerate("kmgt", start=1)
    for suffix in ("", "b")
}


def _is_small(df: DataFrame) -> bool:
    setting = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold").lower()
    unit = setting.lstrip("-0123456789")
    limit = int(setting[: len(setting) - len(unit)]) * _UNITS.get(unit, 0)
    statistics = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(statistics.sizeInBytes())) <= limit


def summarize(df: DataFrame, keys: list[str], weight: Column | None = None) -> KeySummary:
    """Frequent keys of ``df``, each row counting ``weight`` times (a power of two, or nothing).

    One pass over the key columns with a mergeable sketch of frequent items per weight: what is
    shuffled and what comes back is bounded by ``TRACKED`` for each of the few weights.
    """
    weight = F.lit(1.0) if weight is None else weight
    counted = (
        df.select(token(df, keys).alias("token"), weight.alias("weight"))
        .groupBy("weight")
        .agg(
            F.count("*").alias("n"),
            F.approx_count_distinct("token").alias("keys"),
            F.expr(f"approx_top_k(token, {TRACKED}, {TRACKED})").alias("top"),
        )
        .withColumn("least", F.greatest(F.lit(2.0), 3.5 / TRACKED * F.col("n")))
        .withColumn("top", F.filter("top", lambda x: x["count"] >= F.col("least")))
        .collect()
    )
    heavy: dict[object, float] = {}
    rows = distinct = 0.0
    for row in counted:
        for item, n in row.top:
            heavy[item] = heavy.get(item, 0.0) + n * row.weight
        rows += row.n * row.weight
        distinct += row["keys"]
    rest = max(rows - sum(heavy.values()), 0.0)
    return KeySummary(heavy, max(1.0, rest / max(distinct - len(heavy), 1.0)))


def joined_summary(left: KeySummary, right: KeySummary, how: str) -> KeySummary:
    """Rows per key after a join, from the rows on both sides."""
    result: dict[object, float] = {}
    for key in left.heavy.keys() | right.heavy.keys():
        l, r = left.heavy.get(key), right.heavy.get(key)
        if key is None:
            kept = ((l or 0) if how in ("left", "outer") else 0) + (
                (r or 0) if how in ("right", "outer") else 0
            )
            if kept:
                result[key] = kept
        else:
            result[key] = (left.light if l is None else l) * (right.light if r is None else r)
    return KeySummary(result, left.light * right.light)


def _place(df: DataFrame, keys: list[str]) -> Column:
    """A whole number that spreads rows: by what they hold and by the partition they are read in.

    A recomputed task gives its rows the same numbers again. Fractional columns stay out, since a
    sum may differ in its last bits when it is computed anew; maps cannot be hashed.
    """
    values = [
        F.col(quoted(f.name))
        for f in df.schema
        if f.name not in keys and _hashable(f.dataType)
    ]
    return F.xxhash64(F.spark_partition_id(), *values)


def _hashable(dtype: T.DataType) -> bool:
    return (isinstance(dtype, (T.StringType, T.BooleanType, T.DatetimeType))) or is_integral(dtype)


def _cells(n: int, hot_rows: int, partitions: int) -> int:
    """Cells of a key with ``n`` rows: a power of two, no more than twice the shuffle partitions."""
    wanted = max(2, min(ceil(n / hot_rows), partitions))
    return 1 << (wanted - 1).bit_length()


def _cells_of(t: Column, levels: dict[int, list]) -> Column | None:
    """Cells of a row's key; null for keys that are not hot."""
    found = None
    for n, tokens in levels.items():
        met = t.isin(tokens)
        found = F.when(met, F.lit(n)) if found is None else found.when(met, F.lit(n))
    return found


def _spread(
    df: DataFrame, keys: list[str], own: int, levels: list[dict[int, list]], null_cells: int
) -> DataFrame:
    """Give each row its cell on its own axis, and copies along the other side's axis.

    ``levels`` holds, per side, the hot keys by their number of cells. Rows with a null key match
    nothing; they are spread over ``null_cells`` cells without copies.
    """
    other = 1 - own
    t = token(df, keys)
    cells = _cells_of(t, levels[own])
    cells = F.lit(None).cast("int") if cells is None else cells
    cells = F.when(t.isNull(), F.lit(null_cells)).otherwise(cells)
    # Always 0, but not a literal: Spark would take "cell = 0" out of the keys it shuffles by.
    zero = F.pmod(F.hash(*(quoted(key) for key in keys)), F.lit(1))
    own_cell = F.coalesce(F.pmod(_place(df, keys), cells).cast("int"), zero)
    df = df.withColumns({_CELL[own]: own_cell, _SEEN[own]: F.lit(True)})
    if not levels[other]:
        return df.withColumn(_CELL[other], zero)
    copies = F.coalesce(_cells_of(t, levels[other]), F.lit(1))
    every_cell = F.sequence(F.lit(0), copies - F.lit(1))
    return df.withColumn(_CELL[other], F.explode(every_cell))


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str,
    left_keys: KeySummary,
    right_keys: KeySummary,
    hot_rows: int,
) -> DataFrame:
    """The same rows as ``left.join(right, keys, how)``, whatever the summaries say."""
    partitions = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot, levels, null_rows = [], [], 0
    for known, keeping in ((left_keys, ("left", "outer")), (right_keys, ("right", "outer"))):
        large = {key: n for key, n in known.heavy.items() if n >= hot_rows}
        null_rows = max(null_rows, large.pop(None, 0) if how in keeping else 0)
        large.pop(None, None)
        by_cells: dict[int, list] = {}
        for key in sorted(large):
            by_cells.setdefault(_cells(large[key], hot_rows, partitions), []).append(key)
        levels.append(by_cells)
        hot.append(sorted(large))
    if not any(hot) and not null_rows:
        return left.join(right, on=keys, how=how)

    null_cells = _cells(null_rows, hot_rows, partitions)
    joined = _spread(left, keys, 0, levels, null_cells).join(
        _spread(right, keys, 1, levels, null_cells), on=[*keys, *_CELL], how=how
    )
    if how in ("left", "outer") and hot[1]:
        joined = _without_empty_copies(joined, right, keys, 1, hot[1])
    if how in ("right", "outer") and hot[0]:
        joined = _without_empty_copies(joined, left, keys, 0, hot[0])
    return joined.drop(*_CELL, *_SEEN)


def _without_empty_copies(
    joined: DataFrame, side: DataFrame, keys: list[str], axis: int, hot: list
) -> DataFrame:
    """Leave out copies that met an empty cell of ``side``.

    A row of a hot key was copied into every cell of ``side``. If ``side`` holds the key now, the
    row has its matches in one of them, and copies without a match go; if it does not, the row has
    no match, and its copy in the first cell stays. The keys that ``side`` holds are looked up in the
    same run; they are no more than the listed ones, so they are broadcast.
    """
    held = side.select(token(side, keys).alias("__held")).where(F.col("__held").isin(hot))
    held = F.broadcast(held.distinct())
    t = token(joined, keys)
    empty = F.col(_SEEN[axis]).isNull() & F.coalesce(t.isin(hot), F.lit(False))
    marked = joined.withColumn("__asked", F.when(empty, t)).join(
        held, F.col("__asked") == F.col("__held"), "left"
    )
    vanished = F.col("__held").isNull() & (F.col(_CELL[axis]) == 0)
    return marked.where(F.col("__asked").isNull() | vanished).drop("__asked", "__held")

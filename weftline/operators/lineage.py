"""Where the columns of a fused dataset come from, and how often its rows repeat those of an import.

A later fusion step needs to know the frequent keys of what earlier steps made. Counting them there
would run the earlier joins again. Instead, each import is summarized by its own key columns, and
the summaries are carried along: after a join, the rows of a key are the product of the rows on both
sides, and a row of an import that is then joined by another key counts as often as the earlier
joins repeat it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.skew import KeySummary, joined_summary, summarize, token

#: Summaries are made when a join asks for them, once.
Summary = Callable[[], KeySummary | None]


@dataclass(eq=False)
class Origin:
    """An import, and the joins that repeated its rows: key columns of the import and the summary of
    the other side; without key columns, every row counts as the other side's mean key."""

    df: DataFrame
    repeats: tuple[tuple[tuple[str, ...], Summary], ...] = ()

    def weight(self) -> Column | None:
        factors = []
        for keys, summary in self.repeats:
            known = summary()
            if known is not None:
                factors.append(_factor(self.df, keys, known))
        return reduce(Column.__mul__, factors) if factors else None


def _power_of_two(n: float) -> float:
    return 2.0 ** round(log2(max(n, 1.0)))


def _factor(df: DataFrame, keys: tuple[str, ...], summary: KeySummary) -> Column:
    """How often a join repeats a row, to the next power of two, so that there are few values."""
    light = F.lit(_power_of_two(summary.light))
    if not keys:
        return light
    by_factor: dict[float, list] = {}
    for key, n in summary.heavy.items():
        if key is not None and _power_of_two(n) != _power_of_two(summary.light):
            by_factor.setdefault(_power_of_two(n), []).append(key)
    t, found = token(df, list(keys)), None
    for n, tokens in by_factor.items():
        met = t.isin(tokens)
        found = F.when(met, F.lit(n)) if found is None else found.when(met, F.lit(n))
    return light if found is None else found.otherwise(light)


@dataclass(eq=False)
class Lineage:
    """Per column the import and the column of it that it equals; columns made otherwise are not
    listed. ``keyed`` has summaries of the keys that the dataset was joined by."""

    columns: dict[str, tuple[Origin, str]]
    keyed: dict[tuple[str, ...], Summary] = field(default_factory=dict)
    _known: dict[tuple[str, ...], KeySummary | None] = field(default_factory=dict)

    @staticmethod
    def of_import(df: DataFrame) -> Lineage:
        origin = Origin(df)
        return Lineage({name: (origin, name) for name in df.columns})

    def summary(self, keys: list[str]) -> KeySummary | None:
        """Frequent keys of the dataset, without running a join; None if they cannot be told."""
        asked = tuple(keys)
        if asked not in self._known:
            self._known[asked] = self._summary(asked)
        return self._known[asked]

    def _summary(self, keys: tuple[str, ...]) -> KeySummary | None:
        if keys in self.keyed:
            return self.keyed[keys]()
        found = self._in_one_import(keys)
        if found is None:
            return None
        origin, names = found
        return summarize(origin.df, list(names), origin.weight())

    def _in_one_import(self, keys: tuple[str, ...]) -> tuple[Origin, tuple[str, ...]] | None:
        if not all(key in self.columns for key in keys):
            return None
        origins = {id(self.columns[key][0]): self.columns[key][0] for key in keys}
        if len(origins) != 1:
            return None
        return next(iter(origins.values())), tuple(self.columns[key][1] for key in keys)

    def renamed(self, names: dict[str, str]) -> Lineage:
        keyed = {tuple(names.get(k, k) for k in keys): s for keys, s in self.keyed.items()}
        return Lineage({names.get(c, c): of for c, of in self.columns.items()}, keyed)

    def without(self, names: list[str]) -> Lineage:
        keyed = {keys: s for keys, s in self.keyed.items() if not set(keys) & set(names)}
        return Lineage({c: of for c, of in self.columns.items() if c not in names}, keyed)

    def repeated(self, keys: list[str], other: Summary) -> Lineage:
        """The same columns after a join by ``keys`` with what ``other`` summarizes."""
        mine = self._in_one_import(tuple(keys))
        new: dict[int, Origin] = {}
        for origin, _ in self.columns.values():
            by = mine[1] if mine is not None and mine[0] is origin else ()
            new.setdefault(id(origin), Origin(origin.df, (*origin.repeats, (by, other))))
        return Lineage({c: (new[id(o)], name) for c, (o, name) in self.columns.items()})


def joined(left: Lineage, right: Lineage, keys: list[str], how: str) -> Lineage:
    """The lineage of a join by ``keys`` whose other columns have different names."""

    def summary() -> KeySummary | None:
        sides = left.summary(keys), right.summary(keys)
        return None if None in sides else joined_summary(*sides, how)

    after_left = left.repeated(keys, lambda: right.summary(keys))
    after_right = right.repeated(keys, lambda: left.summary(keys))
    columns = {**after_right.columns, **after_left.columns}
    for key in keys:  # the side that the key column is taken from
        taken = {"right": after_right, "outer": None}.get(how, after_left)
        columns.pop(key, None)
        if taken is not None and key in taken.columns:
            columns[key] = taken.columns[key]
    return Lineage(columns, {tuple(keys): summary})

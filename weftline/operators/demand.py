"""Which fields of a dataset a list of processes uses, so that JSON is parsed for those only.

The processes are read backwards: what the result's columns are made of is needed, and so is what a
process tests, fills, casts or names, since it must be there to be found. Columns that are only
dropped are not.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

Path = tuple[str, ...]

_PLAIN_PATH = re.compile(r"[^`()\[\]]+")


class _Everything(Exception):
    """A process uses the dataset as a whole, or in a way that is not followed."""


def _path(text: object) -> Path:
    if not isinstance(text, str) or not _PLAIN_PATH.fullmatch(text):
        raise _Everything
    return tuple(part.strip().lower() for part in text.split("."))


def _moved(needed: set[Path], new: Path, origin: Path) -> set[Path]:
    """Needs of column ``new``, met by what it is made from; it must be there in any case."""
    below = {path[len(new) :] for path in needed if path[: len(new)] == new}
    kept = {path for path in needed if path[: len(new)] != new}
    return kept | {origin + rest for rest in below or {()}}


def _before(process: dict, needed: set[Path]) -> set[Path]:
    operation, args = process.get("operation"), process.get("data_map") or {}
    if operation == "Cast":
        return needed | {_path(args.get("column_to_cast"))}
    if operation == "Rename":
        # without the old name nothing is renamed, and a column of the new name stays
        old, new = _path(args.get("source_reference")), _path(args.get("data_reference"))
        return needed | _moved(needed, new, old)
    if operation == "Filter":
        return needed | {_path(args.get("source_reference"))}
    if operation == "Drop":
        names = args.get("data_reference")
        names = [names] if isinstance(names, str) else list(names or [])
        if args.get("drop_by") == "column":
            return needed
        if "All" in names:
            raise _Everything
        return needed | {_path(name) for name in names}
    if operation == "Fill":
        used = {_path(args.get("column_name"))}
        if args.get("apply_filter"):
            used.add(_path(args.get("fill_filter_source_reference")))
        if args.get("fill_condition") == "median":
            raise _Everything  # is computed when the process is applied
        return needed | used
    if operation in ("Explode", "Flatten"):
        return _moved(needed, _path(args.get("new_column_name")), _path(args.get("data_reference")))
    raise _Everything


def needed_paths(df: DataFrame, processes: list[dict]) -> set[Path] | None:
    """Paths, in lower case, into the columns of ``df`` that applying the processes and keeping the
    result uses; None for all of them."""
    from weftline.operators.rules import apply_processes

    try:
        if any("." in name for name in df.columns):
            raise _Everything
        for process in processes:  # before anything is applied: nothing may run
            _before(process, set())
        needed = {(name.lower(),) for name in apply_processes(df, processes).columns}
        for process in reversed(processes):
            needed = _before(process, needed)
    except _Everything:
        return None
    return needed


def pruned(dtype: T.DataType, paths: set[Path]) -> T.DataType:
    """The type with only the fields on the paths; arrays are looked through."""
    if () in paths:
        return dtype
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(pruned(dtype.elementType, paths), dtype.containsNull)
    if not isinstance(dtype, T.StructType):
        return dtype
    names = {f.name.lower() for f in dtype.fields}
    if not all(path[0] in names for path in paths):
        return dtype  # let the process that asks for it report what is missing
    kept = []
    for f in dtype.fields:
        below = {path[1:] for path in paths if path[0] == f.name.lower()}
        if below:
            kept.append(T.StructField(f.name, pruned(f.dataType, below), f.nullable))
    return T.StructType(kept)

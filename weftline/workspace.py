"""Named datasets of one session or pipeline run."""

from __future__ import annotations

import posixpath
import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def dataset_name(path: str) -> str:
    """Name a file imports under: lower case, spaces as ``_``, text before the first dot."""
    file_name = posixpath.basename(path.split("?")[0].rstrip("/"))
    return file_name.lower().replace(" ", "_").split(".")[0]


def view_name(dataset: str) -> str:
    return "view_" + re.sub(r"[ .\-]", "_", dataset.lower())


class Workspace:
    """Keeps every dataset twice: as imported (``base``) and as rules left it (``current``).

    With ``views`` on, each current dataset is also a temp view for SQL. Pipeline runs leave
    it off, because temp views belong to the session and concurrent runs would share them.
    """

    def __init__(self, spark: SparkSession, views: bool = False):
        self.spark = spark
        self.views = views
        self.base: dict[str, DataFrame] = {}
        self.current: dict[str, DataFrame] = {}
        self.paths: dict[str, str] = {}
        #: What fusions know of the frequent keys of the datasets they made.
        self.lineages: dict[str, tuple[DataFrame, Any]] = {}
        self._cached: list[DataFrame] = []

    def add(
        self, name: str, df: DataFrame, path: str | None = None, cache: bool = False
    ) -> DataFrame:
        """Register a dataset. ``cache`` pays only if several actions will read it."""
        if cache and not df.isStreaming:
            df = df.persist()
            self._cached.append(df)
        self.base[name] = df
        if path is not None:
            self.paths[name] = path
        return self.update(name, df)

    def update(self, name: str, df: DataFrame) -> DataFrame:
        """Replace the working copy only."""
        self.current[name] = df
        if self.views:
            df.createOrReplaceTempView(view_name(name))
        return df

    def replace(self, name: str, df: DataFrame, imported: bool) -> None:
        """Put an equal DataFrame in place of a dataset; what is known of the old one stays known."""
        known = self.lineage(name)
        if imported:
            self.base[name] = df
        self.update(name, df)
        if known is not None:
            self.lineages[name] = (df, known)

    def save(self, name: str, df: DataFrame, overwrite: bool = False) -> None:
        """Name a snapshot of a dataset; the first holder of a name keeps it by default."""
        if overwrite or name not in self.current:
            self.add(name, df)

    def reset(self, name: str) -> DataFrame:
        self[name]
        return self.update(name, self.base[name])

    def lineage(self, name: str) -> Any | None:
        """As a fusion left it; None once a rule has rewritten the dataset."""
        df, known = self.lineages.get(name, (None, None))
        return known if df is not None and df is self.current.get(name) else None

    def release(self) -> None:
        """Drop whatever ``add(cache=True)`` cached."""
        while self._cached:
            self._cached.pop().unpersist()

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.current:
            raise KeyError(f"no dataset {name!r}; known: {sorted(self.current)}")
        return self.current[name]

    def __contains__(self, name: str) -> bool:
        return name in self.current

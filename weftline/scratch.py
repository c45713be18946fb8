"""Where intermediate tables and stream checkpoints go.

On a cluster this is the shared folder named by ``spark.checkpoint.dir``. Only a
local-mode session without that setting falls back to a temporary folder.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import SparkSession

from weftline.errors import SpecError


@lru_cache(maxsize=1)
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="weftline-")


def shared_root(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master == "local" or master.startswith("local["):
        return _local_root()
    raise SpecError("set spark.checkpoint.dir to a folder that all executors share")


#: Folders handed out in this process and not removed yet.
_handed_out: list[str] = []


def new_folder(spark: SparkSession, label: str) -> str:
    """Path of a folder that no other run uses. The folder itself is not created."""
    folder = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    _handed_out.append(folder)
    return folder


@contextmanager
def removed_after(spark: SparkSession) -> Iterator[None]:
    """Remove, at the end, every folder that was handed out inside the block.

    What is still to be read from them must have been written elsewhere before the block ends. Blocks
    may be nested; one that fails removes its folders as well.
    """
    before = len(_handed_out)
    try:
        yield
    finally:
        folders = _handed_out[before:]
        del _handed_out[before:]
        for folder in folders:
            remove(spark, folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of any file system that Spark knows; one that is not there is fine."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

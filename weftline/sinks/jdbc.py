"""Appending to database tables over JDBC.

A batch write runs one transaction per partition; a stream appends each micro-batch. Delivery
is at least once: a batch that is replayed after a failure is appended again. With
``batch_id_column`` every row carries its batch number, so a replay can be detected.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.errors import SpecError

DEFAULT_DRIVER = "org.postgresql.Driver"
DEFAULT_TRIGGER = "10 seconds"
_FROM_ENVIRONMENT = "env:"


def _credential(target: dict, field: str, required: bool) -> str | None:
    """Specs name environment variables as ``env:NAME``, so that they hold no secrets."""
    value = target.get(field)
    if value is None:
        if required:
            raise SpecError(f"JDBC target misses {field}")
        return None
    if not value.startswith(_FROM_ENVIRONMENT):
        raise SpecError(f"{field} must name an environment variable as 'env:NAME'")
    variable = value[len(_FROM_ENVIRONMENT) :]
    if variable not in os.environ:
        raise SpecError(f"environment variable {variable} for {field} is not set")
    return os.environ[variable]


def jdbc_options(target: dict) -> dict[str, str]:
    missing = [f for f in ("jdbc_url", "jdbc_table_name") if not target.get(f)]
    if missing:
        raise SpecError(f"JDBC target misses {', '.join(missing)}")
    options = {
        "driver": target.get("jdbc_driver", DEFAULT_DRIVER),
        "url": target["jdbc_url"],
        "dbtable": target["jdbc_table_name"],
        "user": _credential(target, "jdbc_username", required=False),
        "password": _credential(target, "jdbc_password", required=False),
        # Limits the connections a wide cluster opens at once.
        "numPartitions": target.get("jdbc_connections"),
        "batchsize": target.get("jdbc_batch_size"),
    }
    return {key: str(value) for key, value in options.items() if value is not None}


def append_table(df: DataFrame, options: dict[str, str]) -> None:
    df.write.mode("append").format("jdbc").options(**options).save()


def batch_writer(
    append: Callable[[DataFrame], None], batch_id_column: str | None = None
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that appends each micro-batch once."""

    def write(df: DataFrame, batch_id: int) -> None:
        if batch_id_column:
            df = df.withColumn(batch_id_column, F.lit(batch_id).cast("long"))
        append(df)

    return write

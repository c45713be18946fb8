"""JSON text to columns, the same on files, Kafka snapshots and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.demand import needed_paths, pruned


def decode_json(
    df: DataFrame, sample: str, value: str = "value", rules: list[dict] | None = None
) -> DataFrame:
    """Expand the JSON objects in one column into top-level columns.

    The schema is inferred from one sample document. Text that does not start with ``{`` is
    left out; a malformed object gives a row of nulls, a field of the wrong type a null. With
    ``rules``, the processes that will be applied next, only the fields that they and the columns
    they leave use are parsed; the other columns are not there.
    """
    text = F.col(value).cast("string")
    objects = df.where(text.startswith("{"))
    decoded = _expanded(objects, F.from_json(text, F.schema_of_json(F.lit(sample))))
    needed = needed_paths(decoded, rules) if rules else None
    if needed is None:
        return decoded
    schema = decoded.schema
    known = {name.lower() for name in schema.names}
    fields = pruned(schema, {path for path in needed if path[0] in known})
    if not isinstance(fields, T.StructType) or not fields.fields or fields == schema:
        return decoded
    return _expanded(objects, F.from_json(text, fields))


def _expanded(objects: DataFrame, parsed) -> DataFrame:
    # Expanding with inline keeps later filters above the parser. Below it, Spark would parse
    # the text once more for each of them.
    return objects.select(F.inline(F.array(parsed)))

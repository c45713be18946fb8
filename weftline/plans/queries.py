"""The registered queries: each runs specs over whole tables and has its SQL counterpart.

The test tables hold no nulls, so some inputs are given nulls by a condition on a column.
"""

from __future__ import annotations

import posixpath
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.casting import CAST_TYPES
from weftline.operators.fusion import fusable_columns, run_fusion
from weftline.operators.inspect import describe, displayable, preview, run_sql
from weftline.operators.rules import apply_processes, apply_rule
from weftline.plans.catalog import Catalog
from weftline.plans.pipeline import run_pipeline
from weftline.scratch import new_folder
from weftline.sinks.export import RunPlace, export
from weftline.sinks.files import write_files
from weftline.sinks.jdbc import batch_writer
from weftline.sources.decode import decode_json
from weftline.sources.files import FileSpec, read_file
from weftline.sources.importer import import_sources
from weftline.streaming.registry import ActiveStreams
from weftline.workspace import Workspace

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


# -- inputs ---------------------------------------------------------------------------------


def _workspace(spark: SparkSession, sf_dir: str, *tables: str) -> Workspace:
    workspace = Workspace(spark)
    import_sources(workspace, {"Files": _files(sf_dir, *tables)})
    return workspace


def _files(sf_dir: str, *tables: str) -> list[dict]:
    return [{"path": f"{sf_dir}/{t}.parquet", "name": t, "format": "parquet"} for t in tables]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _workspace(spark, sf_dir, name)[name]


def _events_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_type") != "view", F.col("user_id")).alias("user_id"),
        "event_type",
        F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
    )


_EVENTS_WITH_NULLS = """
    SELECT event_id,
           CASE WHEN event_type <> 'view' THEN user_id END AS user_id,
           event_type,
           CASE WHEN event_type <> 'error' THEN value END AS value
    FROM events
"""


def _process(operation: str, **data_map) -> dict:
    return {"operation": operation, "data_map": data_map}


def _cast(column: str, to: str, **patterns: str) -> dict:
    return _process("Cast", column_to_cast=column, cast_type=to, **patterns)


def _rename(old: str, new: str) -> dict:
    return _process("Rename", source_reference=old, data_reference=new)


def _filter(column: str, op: str, value: str) -> dict:
    return _process("Filter", source_reference=column, operator=op, data_reference=value)


def _drop(how: str, *columns: str) -> dict:
    return _process("Drop", drop_by=how, data_reference=list(columns))


def _fill_nulls(column: str, **how: str) -> dict:
    return _process("Fill", fill_by="null values", column_name=column, **how)


def _fill_where(column: str, value: str, test: tuple[str, str, str]) -> dict:
    source, op, compared = test
    return _process(
        "Fill",
        fill_by="column",
        column_name=column,
        data_reference=value,
        apply_filter=True,
        fill_filter_source_reference=source,
        operator=op,
        fill_filter_data_reference=compared,
    )


def _explode(path: str, name: str) -> dict:
    return _process("Explode", data_reference=path, new_column_name=name)


def _flatten(path: str, name: str) -> dict:
    return _process("Flatten", data_reference=path, new_column_name=name)


# -- cast, rename ---------------------------------------------------------------------------


@query("""
    SELECT l_orderkey, l_linenumber, CAST(trunc(l_quantity) AS INT) AS l_quantity
    FROM lineitem
""")
def cast_int(spark, sf_dir):
    df = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return apply_processes(df, [_cast("l_quantity", "int")])


@query("""
    SELECT p_partkey,
           TRY_CAST(CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE p_name END
                    AS INT) AS p_name
    FROM part
""")
def cast_bad_text_null(spark, sf_dir):
    number = F.col("p_partkey").cast("string")
    name = F.when(F.col("p_partkey") % 2 == 0, number).otherwise(F.col("p_name"))
    df = _table(spark, sf_dir, "part").select("p_partkey", name.alias("p_name"))
    return apply_processes(df, [_cast("p_name", "int")])


@query("SELECT l_orderkey, l_linenumber, CAST(trunc(l_tax) AS BIGINT) AS l_tax FROM lineitem")
def cast_fraction_text(spark, sf_dir):
    df = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_tax")
    return apply_processes(df, [_cast("l_tax", "string"), _cast("l_tax", "long")])


@query("""
    SELECT l_orderkey, l_linenumber, n,
           CAST(n AS INT) AS as_int, CAST(n AS VARCHAR) AS as_string,
           CAST(n AS DOUBLE) AS as_double, CAST(n AS FLOAT) AS as_float,
           CAST(n AS BOOLEAN) AS as_bool, CAST(n AS BIGINT) AS as_timestamp,
           CAST(n AS BIGINT) AS as_long, CAST(n AS SMALLINT) AS as_short,
           TRY_CAST(n AS TINYINT) AS as_byte
    FROM (SELECT l_orderkey, l_linenumber, l_linenumber * 50 - 100 AS n FROM lineitem)
""")
def cast_every_type(spark, sf_dir):
    # negative, zero, and too large for a byte
    n = (F.col("l_linenumber") * 50 - 100).alias("n")
    df = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", n)
    processes = []
    for name in CAST_TYPES:
        processes += [_flatten("n", f"as_{name}"), _cast(f"as_{name}", name)]
    # Shown as seconds since the epoch, which do not depend on the session's time zone.
    return apply_processes(df, processes).withColumn(
        "as_timestamp", F.unix_seconds("as_timestamp")
    )


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders")
def cast_date_reformat(spark, sf_dir):
    df = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return apply_processes(
        df,
        [
            _cast("o_orderdate", "string"),
            _cast(
                "o_orderdate", "date", cast_from="yyyy-MM-dd HH:mm:ss", cast_to="dd/MM/yyyy"
            ),
            _cast("o_orderdate", "date", cast_from="dd/MM/yyyy", cast_to="yyyy-MM-dd"),
        ],
    )


@query("SELECT o_orderkey, strftime(o_orderdate, '%m/%d/%Y') AS o_orderdate FROM orders")
def cast_date_weekday(spark, sf_dir):
    weekday = "EEE MMM dd HH:mm:ss z yyyy"
    df = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return apply_processes(
        df,
        [
            _cast("o_orderdate", "string"),
            _cast("o_orderdate", "date", cast_from="yyyy-MM-dd HH:mm:ss", cast_to=weekday),
            _cast("o_orderdate", "date", cast_from=weekday, cast_to="MM/dd/yyyy"),
        ],
    )


@query("SELECT c_custkey AS customer_id, c_name, c_acctbal FROM customer")
def rename_column(spark, sf_dir):
    df = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return apply_processes(df, [_rename("c_custkey", "customer_id"), _rename("absent", "x")])


# -- filter ---------------------------------------------------------------------------------


def _filter_query(name: str, table: str, test: tuple[str, str, str], where: str, *columns: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _table(spark, sf_dir, table).select(*columns)
        return apply_processes(df, [_filter(*test)])

    run.__name__ = name
    query(f"SELECT {', '.join(columns)} FROM {table} WHERE {where}")(run)


_LINE = ("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
_ORDER = ("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
_PART = ("p_partkey", "p_name", "p_brand", "p_type")

for _name, _of, _test, _where, _columns in (
    ("filter_eq", "lineitem", ("l_linenumber", "==", "3"), "l_linenumber = 3", _LINE),
    ("filter_ne", "orders", ("o_orderstatus", "!=", "F"), "o_orderstatus <> 'F'", _ORDER),
    ("filter_lt", "lineitem", ("l_quantity", "<", "10"), "l_quantity < 10", _LINE),
    ("filter_le", "lineitem", ("l_discount", "<=", "0.05"),
     "l_discount <= CAST(0.05 AS DOUBLE)", _LINE),
    ("filter_gt", "orders", ("o_totalprice", ">", "200000"), "o_totalprice > 200000", _ORDER),
    ("filter_ge", "lineitem", ("l_linenumber", ">=", "5.5"), "l_linenumber >= 6", _LINE),
    ("filter_time", "orders", ("o_orderdate", ">=", "1996-01-01"),
     "o_orderdate >= TIMESTAMP '1996-01-01'", _ORDER),
    ("filter_contains", "part", ("p_name", "contains", "ring"), "contains(p_name, 'ring')", _PART),
    ("filter_contains_number", "orders", ("o_orderkey", "contains", "77"),
     "contains(CAST(o_orderkey AS VARCHAR), '77')", _ORDER),
    ("filter_startswith", "part", ("p_brand", "startswith", "Brand#1"),
     "starts_with(p_brand, 'Brand#1')", _PART),
    ("filter_endswith", "part", ("p_brand", "endswith", "3"), "ends_with(p_brand, '3')", _PART),
):
    _filter_query(_name, _of, _test, _where, *_columns)


# -- drop -----------------------------------------------------------------------------------


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def drop_columns(spark, sf_dir):
    df = _table(spark, sf_dir, "customer")
    return apply_processes(df, [_drop("column", "c_nationkey", "C_MKTSEGMENT", "absent")])


@query(f"SELECT * FROM ({_EVENTS_WITH_NULLS}) WHERE value IS NOT NULL")
def drop_nulls(spark, sf_dir):
    return apply_processes(_events_with_nulls(spark, sf_dir), [_drop("null values", "value")])


@query(f"""
    SELECT * FROM ({_EVENTS_WITH_NULLS}) WHERE value IS NOT NULL AND user_id IS NOT NULL
""")
def drop_nulls_all(spark, sf_dir):
    return apply_processes(_events_with_nulls(spark, sf_dir), [_drop("null values", "All")])


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def drop_duplicates(spark, sf_dir):
    df = _table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    return apply_processes(df, [_drop("duplicates", "All")])


@query("SELECT DISTINCT o_custkey, CAST(o_custkey AS VARCHAR) AS customer_text FROM orders")
def drop_duplicates_by_key(spark, sf_dir):
    df = _table(spark, sf_dir, "orders").select("o_custkey")
    return apply_processes(
        df,
        [
            _flatten("o_custkey", "customer_text"),
            _cast("customer_text", "string"),
            _drop("duplicates", "o_custkey"),
        ],
    )


# -- fill -----------------------------------------------------------------------------------


@query("SELECT s_suppkey, 'imported' AS s_name, 'erp' AS origin FROM supplier")
def fill_constant(spark, sf_dir):
    df = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return apply_processes(
        df,
        [
            _process("Fill", fill_by="column", column_name="s_name", data_reference="imported"),
            _process("Fill", fill_by="column", column_name="origin", data_reference="erp"),
        ],
    )


@query("SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'gold' END AS tier FROM customer")
def fill_conditional_new(spark, sf_dir):
    df = _table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return apply_processes(
        df,
        [_fill_where("tier", "gold", ("c_acctbal", ">", "5000")), _drop("column", "c_acctbal")],
    )


@query("""
    SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN '0-TOP' ELSE o_orderpriority END
           AS o_orderpriority
    FROM orders
""")
def fill_conditional_existing(spark, sf_dir):
    df = _table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_totalprice", "o_orderpriority"
    )
    return apply_processes(
        df,
        [
            _fill_where("O_ORDERPRIORITY", "0-TOP", ("o_totalprice", ">", "300000")),
            _drop("column", "o_totalprice"),
        ],
    )


@query("""
    SELECT l_orderkey, l_linenumber AS line,
           CASE WHEN l_quantity < 5 THEN 'few' ELSE CAST(l_suppkey AS VARCHAR) END AS l_suppkey
    FROM lineitem
""")
def fill_conditional_number(spark, sf_dir):
    df = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").alias("line"), "l_suppkey", "l_quantity"
    )
    return apply_processes(
        df,
        [
            _fill_where("l_suppkey", "few", ("l_quantity", "<", "5")),
            _drop("column", "l_quantity"),
        ],
    )


def _filled(spark: SparkSession, sf_dir: str, column: str, **how: str) -> DataFrame:
    df = _events_with_nulls(spark, sf_dir).select("event_id", column)
    return apply_processes(df, [_fill_nulls(column, **how)])


def _filled_sql(column: str, replacement: str, shown: str) -> str:
    return f"""
        WITH given AS ({_EVENTS_WITH_NULLS}),
             filled AS (SELECT event_id, coalesce({column}, {replacement}) AS {column} FROM given)
        SELECT event_id, {shown} AS {column} FROM filled
    """


@query(_filled_sql("value", "(SELECT avg(value) FROM given)", "round(value, 4)"))
def fill_null_mean(spark, sf_dir):
    df = _filled(spark, sf_dir, "value", fill_condition="mean")
    return df.withColumn("value", F.round("value", 4))


@query(_filled_sql("value", "(SELECT quantile_disc(value, 0.5) FROM given)", "value"))
def fill_null_median(spark, sf_dir):
    return _filled(spark, sf_dir, "value", fill_condition="median")


@query(_filled_sql("value", "(SELECT stddev_samp(value) FROM given)", "round(value, 4)"))
def fill_null_stddev(spark, sf_dir):
    df = _filled(spark, sf_dir, "value", fill_condition="standard deviation")
    return df.withColumn("value", F.round("value", 4))


@query(_filled_sql("value", "-1", "value"))
def fill_null_custom(spark, sf_dir):
    return _filled(spark, sf_dir, "value", fill_condition="custom", data_reference="-1")


@query(_filled_sql("user_id", "(SELECT CAST(trunc(avg(user_id)) AS BIGINT) FROM given)", "user_id"))
def fill_null_whole_mean(spark, sf_dir):
    return _filled(spark, sf_dir, "user_id", fill_condition="mean")


@query(_filled_sql("user_id", "(SELECT quantile_disc(user_id, 0.5) FROM given)", "user_id"))
def fill_null_whole_median(spark, sf_dir):
    return _filled(spark, sf_dir, "user_id", fill_condition="median")


@query(f"""
    WITH given AS ({_EVENTS_WITH_NULLS})
    SELECT event_id,
           round(coalesce(value, (SELECT avg(value) FROM given)), 4) AS value,
           coalesce(user_id, (SELECT CAST(trunc(stddev_samp(user_id)) AS BIGINT) FROM given))
               AS user_id
    FROM given
""")
def fill_null_two_columns(spark, sf_dir):
    df = _events_with_nulls(spark, sf_dir).drop("event_type")
    return apply_processes(
        df,
        [
            _fill_nulls("value", fill_condition="mean"),
            _fill_nulls("user_id", fill_condition="standard deviation"),
        ],
    ).withColumn("value", F.round("value", 4))


@query(f"""
    WITH given AS ({_EVENTS_WITH_NULLS})
    SELECT event_id, event_type,
           coalesce(value, (SELECT quantile_disc(value, 0.5) FROM given)) AS value,
           coalesce(user_id, (SELECT quantile_disc(user_id, 0.5) FROM given)) AS user_id
    FROM given
""")
def fill_null_two_medians(spark, sf_dir):
    """Both medians come from the same passes."""
    return apply_processes(
        _events_with_nulls(spark, sf_dir),
        [
            _fill_nulls("value", fill_condition="median"),
            _fill_nulls("user_id", fill_condition="median"),
        ],
    )


# -- nested data ----------------------------------------------------------------------------


@query("""
    SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS element FROM embeddings
""")
def explode_array(spark, sf_dir):
    return apply_processes(
        _table(spark, sf_dir, "embeddings"),
        [
            _explode("embedding", "element"),
            _drop("column", "embedding"),
            _cast("element", "double"),
        ],
    )


@query("""
    SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events
""")
def flatten_json_field(spark, sf_dir):
    df = _table(spark, sf_dir, "events").select(
        "event_id", F.from_json("props", F.schema_of_json(F.lit('{"k": 1}'))).alias("parsed")
    )
    return apply_processes(df, [_flatten("parsed.k", "k"), _drop("column", "parsed")])


_MEASURES_SAMPLE = (
    '{"order": 1, "line": 1, "measures": [{"name": "quantity", "detail": {"amount": 1.5}}]}'
)


def _measures(spark: SparkSession, sf_dir: str, processes: list[dict]) -> DataFrame:
    """Line items read back from JSON text, with an array of structs inside, and rewritten."""
    measures = F.array(
        *(
            F.struct(F.lit(name).alias("name"), F.struct(F.col(c).alias("amount")).alias("detail"))
            for name, c in (("quantity", "l_quantity"), ("discount", "l_discount"))
        )
    )
    document = F.struct(
        F.col("l_orderkey").alias("order"),
        F.col("l_linenumber").alias("line"),
        measures.alias("measures"),
    )
    folder = new_folder(spark, "measures")
    _table(spark, sf_dir, "lineitem").select(F.to_json(document)).write.text(folder)
    workspace = Workspace(spark)
    snapshot = {
        "stream_from": "files",
        "path": folder,
        "schema_skeleton": _MEASURES_SAMPLE,
        "dataframe_name": "measures",
        "snapshot": True,
    }
    processes = [_cast("line", "int"), *processes]
    import_sources(workspace, {"Stream": snapshot}, demand={"measures": processes})
    return apply_processes(workspace["measures"], processes)


@query("""
    SELECT l_orderkey AS "order", l_linenumber AS line, 'quantity' AS name, l_quantity AS amount
    FROM lineitem
    UNION ALL
    SELECT l_orderkey, l_linenumber, 'discount', l_discount FROM lineitem
""")
def decode_explode_flatten(spark, sf_dir):
    processes = [
        _explode("measures", "measure"),
        _flatten("measure.name", "name"),
        _flatten("measure.detail.amount", "amount"),
        _drop("column", "measures", "measure"),
    ]
    return _measures(spark, sf_dir, processes)


@query("""
    SELECT l_orderkey AS "order", l_linenumber AS line, unnest(['quantity', 'discount']) AS name
    FROM lineitem
""")
def flatten_through_array(spark, sf_dir):
    processes = [
        _flatten("measures.name", "names"),
        _explode("names", "name"),
        _drop("column", "measures", "names"),
    ]
    return _measures(spark, sf_dir, processes)


# -- rules ----------------------------------------------------------------------------------


@query("""
    SELECT o.o_orderkey, o.o_totalprice, l.label
    FROM (SELECT * FROM orders WHERE o_totalprice > 100000) o
    JOIN (SELECT o_orderkey, 'large' AS label FROM orders WHERE o_totalprice > 250000) l
    USING (o_orderkey)
""")
def save_branch(spark, sf_dir):
    workspace = _workspace(spark, sf_dir, "orders")
    rules = {
        "orders": [
            _filter("o_totalprice", ">", "100000"),
            _drop("column", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"),
            _process("Save", save_as="large"),
        ],
        "large": [
            _filter("o_totalprice", ">", "250000"),
            _drop("column", "o_totalprice"),
            _process("Fill", fill_by="column", column_name="label", data_reference="large"),
        ],
    }
    apply_rule(workspace, rules)
    step = {"datasets_to_fuse": ["orders", "large"], "fuse_by": "column", "fuse_on": "o_orderkey"}
    run_fusion(workspace, [{**step, "fused_dataset_name": "out"}])
    return workspace["out"]


@query("""
    SELECT l_orderkey, l_linenumber AS line, CAST(trunc(l_quantity) AS INT) AS l_quantity,
           CASE WHEN l_discount >= CAST(0.08 AS DOUBLE) THEN 'high' END AS discount_class
    FROM lineitem
    WHERE trunc(l_quantity) >= 25 AND l_returnflag <> 'N'
""")
def rule_chain(spark, sf_dir):
    workspace = _workspace(spark, sf_dir, "lineitem")
    unused = ["l_partkey", "l_suppkey", "l_extendedprice", "l_tax", "l_linestatus", "l_shipdate"]
    first = [
        _cast("l_quantity", "int"),
        _filter("l_quantity", ">=", "25"),
        _filter("l_returnflag", "!=", "N"),
    ]
    second = [
        _fill_where("discount_class", "high", ("l_discount", ">=", "0.08")),
        _drop("column", *unused, "l_discount", "l_returnflag"),
        _rename("l_linenumber", "line"),
    ]
    apply_rule(workspace, {"lineitem": first})
    apply_rule(workspace, {"lineitem": second})
    return workspace["lineitem"]


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O'")
def rule_reset(spark, sf_dir):
    workspace = _workspace(spark, sf_dir, "orders")
    apply_rule(workspace, {"orders": [_filter("o_orderstatus", "==", "F")]})
    kept = _drop("column", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    rule = {"orders": [_filter("o_orderstatus", "==", "O"), kept]}
    apply_rule(workspace, rule, reset=True)
    return workspace["orders"]


# -- fusion ---------------------------------------------------------------------------------


def _english_and_labels(spark: SparkSession, sf_dir: str) -> Workspace:
    """Documents without labels on one side, labels without documents on the other."""
    workspace = _workspace(spark, sf_dir, "documents", "labels")
    rule = {"documents": [_filter("lang", "==", "en"), _drop("column", "text", "source")]}
    apply_rule(workspace, rule)
    return workspace


def _fuse(workspace: Workspace, *datasets: str, **step) -> DataFrame:
    run_fusion(
        workspace, [{"fused_dataset_name": "out", "datasets_to_fuse": list(datasets), **step}]
    )
    return workspace["out"]


def _fuse_documents(how: str | None) -> None:
    name = f"fuse_{how or 'default'}"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        workspace = _english_and_labels(spark, sf_dir)
        step = {"fuse_how": how} if how else {}
        return _fuse(
            workspace, "documents", "labels", fuse_by="column", fuse_on="doc_id", **step
        )

    run.__name__ = name
    join = {"outer": "FULL OUTER"}.get(how, (how or "inner").upper())
    query(f"""
        SELECT doc_id, d.lang, d.n_chars, l.quality, l.toxic
        FROM (SELECT * FROM documents WHERE lang = 'en') d
        {join} JOIN labels l USING (doc_id)
    """)(run)


for _how in ("inner", "left", "right", "outer", None):
    _fuse_documents(_how)


_PART_TOTALS = (
    "SELECT l_partkey AS partkey, count(*) AS n_lines, sum(l_quantity) AS quantity "
    "FROM {lineitem} GROUP BY l_partkey"
)


def _lines_and_parts(spark: SparkSession, sf_dir: str) -> Workspace:
    workspace = _workspace(spark, sf_dir, "lineitem", "part")
    totals = run_sql(workspace, _PART_TOTALS.format(lineitem="view_lineitem"))
    workspace.add("totals", totals)
    unused = ["l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"]
    rules = {
        "lineitem": [
            _drop("column", *unused, "l_linestatus", "l_shipdate"),
            _rename("l_partkey", "partkey"),
        ],
        "part": [_rename("p_partkey", "partkey"), _drop("column", "p_type", "p_size")],
        "totals": [_filter("n_lines", ">", "20")],
    }
    apply_rule(workspace, rules)
    return workspace


def _three_way_sql(join: str) -> str:
    return f"""
        SELECT partkey, l_orderkey, l_linenumber, l_quantity, p_name, p_brand, p_retailprice,
               n_lines, t.quantity
        FROM (SELECT l_partkey AS partkey, l_orderkey, l_linenumber, l_quantity FROM lineitem)
        {join} JOIN (SELECT p_partkey AS partkey, p_name, p_brand, p_retailprice FROM part)
        USING (partkey)
        {join} JOIN (SELECT * FROM ({_PART_TOTALS.format(lineitem="lineitem")})
                     WHERE n_lines > 20) t
        USING (partkey)
    """


@query(_three_way_sql("INNER"))
def fuse_three_way(spark, sf_dir):
    workspace = _lines_and_parts(spark, sf_dir)
    return _fuse(
        workspace, "lineitem", "part", "totals",
        fuse_by="column", fuse_on="partkey", fuse_how="inner",
    )


@query(_three_way_sql("LEFT"))
def fuse_three_way_left(spark, sf_dir):
    workspace = _lines_and_parts(spark, sf_dir)
    return _fuse(
        workspace, "lineitem", "part", "totals",
        fuse_by="column", fuse_on="partkey", fuse_how="left",
    )


@query("""
    SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, n_lines
    FROM lineitem
    JOIN (SELECT l_partkey, l_suppkey, count(*) AS n_lines FROM lineitem GROUP BY ALL)
    USING (l_partkey, l_suppkey)
""")
def fuse_composite_key(spark, sf_dir):
    workspace = _workspace(spark, sf_dir, "lineitem")
    pairs = run_sql(
        workspace,
        "SELECT l_partkey, l_suppkey, count(*) AS n_lines FROM view_lineitem "
        "GROUP BY l_partkey, l_suppkey",
    )
    workspace.add("pairs", pairs)
    keys = ["l_partkey", "l_suppkey"]
    df = _fuse(workspace, "lineitem", "pairs", fuse_by="column", fuse_on=keys)
    return df.select(*keys, "l_orderkey", "l_linenumber", "n_lines")


@query("""
    SELECT custkey, o.o_orderkey, o.name, c.name AS name_customer, c.c_acctbal
    FROM (SELECT o_custkey AS custkey, o_orderkey, o_orderpriority AS name FROM orders) o
    JOIN (SELECT c_custkey AS custkey, c_name AS name, c_acctbal FROM customer) c
    USING (custkey)
""")
def fuse_same_names(spark, sf_dir):
    workspace = _workspace(spark, sf_dir, "orders", "customer")
    rules = {
        "orders": [
            _rename("o_custkey", "custkey"),
            _rename("o_orderpriority", "name"),
            _drop("column", "o_orderstatus", "o_totalprice", "o_orderdate"),
        ],
        "customer": [
            _rename("c_custkey", "custkey"),
            _rename("c_name", "name"),
            _drop("column", "c_nationkey", "c_mktsegment"),
        ],
    }
    apply_rule(workspace, rules)
    return _fuse(workspace, "orders", "customer", fuse_by="column", fuse_on="custkey")


@query("""
    SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer
    UNION ALL
    SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier
""")
def fuse_union(spark, sf_dir):
    workspace = _workspace(spark, sf_dir, "customer", "supplier")
    apply_rule(workspace, {"customer": [_drop("column", "c_mktsegment")]})
    return _fuse(workspace, "customer", "supplier", fuse_by="row")


@query("""
    SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_nationkey FROM customer
    UNION ALL
    SELECT p_brand, p_size FROM part
""")
def fuse_union_mixed(spark, sf_dir):
    workspace = _workspace(spark, sf_dir, "customer", "part")
    rules = {
        "customer": [_drop("column", "c_name", "c_acctbal", "c_mktsegment")],
        "part": [_drop("column", "p_partkey", "p_name", "p_type", "p_retailprice")],
    }
    apply_rule(workspace, rules)
    return _fuse(workspace, "customer", "part", fuse_by="row")


@query("""
    SELECT custkey, nationkey, c_name, n_name, o_orderkey, o_totalprice
    FROM (SELECT c_custkey AS custkey, c_nationkey AS nationkey, c_name FROM customer)
    JOIN (SELECT n_nationkey AS nationkey, n_name FROM nation) USING (nationkey)
    LEFT JOIN (SELECT o_custkey AS custkey, o_orderkey, o_totalprice FROM orders)
    USING (custkey)
""")
def fuse_multi_step(spark, sf_dir):
    workspace = _workspace(spark, sf_dir, "customer", "nation", "orders")
    rules = {
        "customer": [
            _rename("c_custkey", "custkey"),
            _rename("c_nationkey", "nationkey"),
            _drop("column", "c_acctbal", "c_mktsegment"),
        ],
        "nation": [_rename("n_nationkey", "nationkey"), _drop("column", "n_regionkey")],
        "orders": [
            _rename("o_custkey", "custkey"),
            _drop("column", "o_orderstatus", "o_orderdate", "o_orderpriority"),
        ],
    }
    apply_rule(workspace, rules)
    steps = [
        {"datasets_to_fuse": ["customer", "nation"], "fuse_by": "column", "fuse_on": "nationkey"},
        {
            "fused_dataset_name": "out",
            "datasets_to_fuse": ["customer_nation", "orders"],
            "fuse_by": "column",
            "fuse_on": "custkey",
            "fuse_how": "left",
        },
    ]
    run_fusion(workspace, steps)
    return workspace["out"]


@query("""
    SELECT doc_id, lang, source, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)
""")
def fuse_discovered_key(spark, sf_dir):
    workspace = _workspace(spark, sf_dir, "documents", "labels")
    apply_rule(workspace, {"documents": [_drop("column", "text")]})
    keys = fusable_columns(workspace, ["documents", "labels"])
    return _fuse(workspace, "documents", "labels", fuse_by="column", fuse_on=keys)


def _events_and_types(spark: SparkSession, sf_dir: str) -> Workspace:
    """A handful of event types hold all rows; each side lacks one type of the other."""
    workspace = _workspace(spark, sf_dir, "events")
    run = "SELECT event_type, count(*) AS n_events FROM view_events GROUP BY event_type"
    workspace.add("types", run_sql(workspace, run))
    workspace.add("peaks", run_sql(
        workspace, "SELECT event_type, max(value) AS peak FROM view_events GROUP BY event_type"
    ))
    rules = {
        "events": [
            _filter("event_type", "!=", "view"),
            _drop("column", "ts", "user_id", "props", "value"),
        ],
        "types": [_filter("event_type", "!=", "click")],
    }
    apply_rule(workspace, rules)
    return workspace


_FEW_EVENTS = "(SELECT event_type, event_id FROM events WHERE event_type <> 'view')"
_TYPES = """(SELECT event_type, count(*) AS n_events FROM events WHERE event_type <> 'click'
             GROUP BY event_type)"""
_PEAKS = "(SELECT event_type, max(value) AS peak FROM events GROUP BY event_type)"


@query(f"""
    SELECT event_type, event_id, n_events
    FROM {_FEW_EVENTS} FULL OUTER JOIN {_TYPES} USING (event_type)
""")
def fuse_outer_hot_keys(spark, sf_dir):
    workspace = _events_and_types(spark, sf_dir)
    return _fuse(
        workspace, "events", "types",
        fuse_by="column", fuse_on="event_type", fuse_how="outer", hot_rows=50,
    )


@query(f"""
    SELECT event_type, n_events, event_id
    FROM {_TYPES} LEFT JOIN {_FEW_EVENTS} USING (event_type)
""")
def fuse_left_hot_keys(spark, sf_dir):
    workspace = _events_and_types(spark, sf_dir)
    return _fuse(
        workspace, "types", "events",
        fuse_by="column", fuse_on="event_type", fuse_how="left", hot_rows=50, skew="always",
    )


@query(f"""
    SELECT event_type, event_id, n_events, peak
    FROM {_FEW_EVENTS} RIGHT JOIN {_TYPES} USING (event_type)
    RIGHT JOIN {_PEAKS} USING (event_type)
""")
def fuse_right_hot_keys(spark, sf_dir):
    workspace = _events_and_types(spark, sf_dir)
    return _fuse(
        workspace, "events", "types", "peaks",
        fuse_by="column", fuse_on="event_type", fuse_how="right", hot_rows=50,
    )


@query(f"""
    SELECT event_type, event_id, n_events, peak
    FROM {_FEW_EVENTS} JOIN {_TYPES} USING (event_type) JOIN {_PEAKS} USING (event_type)
""")
def fuse_three_way_hot_keys(spark, sf_dir):
    workspace = _events_and_types(spark, sf_dir)
    return _fuse(
        workspace, "events", "types", "peaks",
        fuse_by="column", fuse_on="event_type", fuse_how="inner", hot_rows=50,
        skew="always",
    )


@query("""
    SELECT l_orderkey, l_partkey, l_suppkey, o_custkey, c_nationkey, l_linenumber, l_quantity,
           o_totalprice, c_acctbal, p_brand, s_name, n_name
    FROM lineitem
    LEFT JOIN orders ON o_orderkey = l_orderkey
    LEFT JOIN customer ON c_custkey = o_custkey
    LEFT JOIN part ON p_partkey = l_partkey
    LEFT JOIN supplier ON s_suppkey = l_suppkey
    LEFT JOIN nation ON n_nationkey = c_nationkey
""")
def fuse_five_steps(spark, sf_dir):
    """Five joins by five keys, each spread by summaries of the imports that a key comes from."""
    workspace = _workspace(
        spark, sf_dir, "lineitem", "orders", "customer", "part", "supplier", "nation"
    )
    keep = {
        "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"],
        "orders": ["o_orderkey", "o_custkey", "o_totalprice"],
        "customer": ["c_custkey", "c_nationkey", "c_acctbal"],
        "part": ["p_partkey", "p_brand"],
        "supplier": ["s_suppkey", "s_name"],
        "nation": ["n_nationkey", "n_name"],
    }
    for name, columns in keep.items():
        workspace.update(name, workspace[name].select(*columns))
    names = {
        "orders": ("o_orderkey", "l_orderkey"),
        "customer": ("c_custkey", "o_custkey"),
        "part": ("p_partkey", "l_partkey"),
        "supplier": ("s_suppkey", "l_suppkey"),
        "nation": ("n_nationkey", "c_nationkey"),
    }
    steps, before = [], "lineitem"
    for table, (own, key) in names.items():
        apply_rule(workspace, {table: [_rename(own, key)]})
        steps.append({
            "fused_dataset_name": f"with_{table}", "datasets_to_fuse": [before, table],
            "fuse_by": "column", "fuse_on": key, "fuse_how": "left", "hot_rows": 2_000,
            "skew": "always",
        })
        before = f"with_{table}"
    run_fusion(workspace, steps)
    return workspace[before]


def _fuse_text_key(how: str, name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        workspace = _workspace(spark, sf_dir, "orders", "customer")
        cents = F.when(F.col("c_custkey") % 5 == 0, F.lit(".50")).otherwise(F.lit(".00"))
        text = F.concat(F.col("c_custkey").cast("string"), cents).alias("custkey")
        workspace.add("customers", workspace["customer"].select(text, "c_name"))
        workspace.add(
            "orders", workspace["orders"].select(F.col("o_custkey").alias("custkey"), "o_orderkey")
        )
        return _fuse(
            workspace, "orders", "customers", fuse_by="column", fuse_on="custkey", fuse_how=how
        )

    run.__name__ = name
    key = "coalesce(CAST(o.custkey AS VARCHAR), c.custkey)" if how == "outer" else "o.custkey"
    query(f"""
        SELECT {key} AS custkey, o_orderkey, c_name
        FROM (SELECT o_custkey AS custkey, o_orderkey FROM orders) o
        {"FULL OUTER" if how == "outer" else "INNER"} JOIN (
            SELECT c_custkey || CASE WHEN c_custkey % 5 = 0 THEN '.50' ELSE '.00' END AS custkey,
                   c_custkey, c_name FROM customer) c
        ON o.custkey = c.c_custkey AND c.c_custkey % 5 <> 0
    """)(run)


_fuse_text_key("inner", "fuse_text_key")
_fuse_text_key("outer", "fuse_text_key_outer")


@query("""
    WITH d AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DECIMAL(12, 2)) + CASE
                      WHEN l_linenumber = 1 THEN 0.70 ELSE 0.00 END AS k FROM lineitem),
         w AS (SELECT p_partkey AS k, p_brand FROM part WHERE p_partkey <= 60),
         t AS (SELECT s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '.7' ELSE '' END AS k, s_name
               FROM supplier WHERE s_suppkey <= 60)
    SELECT coalesce(CAST(w.k AS VARCHAR), CAST(d.k AS VARCHAR), t.k) AS k, p_brand, l_orderkey,
           l_linenumber, s_name
    FROM w FULL OUTER JOIN d ON w.k = d.k
    FULL OUTER JOIN t ON TRY_CAST(t.k AS DECIMAL(12, 2)) = coalesce(d.k, w.k)
""")
def fuse_decimal_key(spark, sf_dir):
    """Whole numbers, decimals and text, the whole numbers first: 5 is 5.00 but not 5.70."""
    workspace = _workspace(spark, sf_dir, "lineitem", "part", "supplier")
    quantity = F.col("l_quantity").cast("decimal(12,2)")
    more = F.when(F.col("l_linenumber") == 1, F.lit("0.70")).otherwise("0.00").cast("decimal(3,2)")
    workspace.add("d", workspace["lineitem"].select(
        (quantity + more).cast("decimal(12,2)").alias("k"), "l_orderkey", "l_linenumber"
    ))
    workspace.add("w", workspace["part"].where("p_partkey <= 60").select(
        F.col("p_partkey").alias("k"), "p_brand"
    ))
    text = F.col("s_suppkey").cast("string")
    workspace.add("t", workspace["supplier"].where("s_suppkey <= 60").select(
        F.when(F.col("s_suppkey") % 2 == 0, F.concat(text, F.lit(".7"))).otherwise(text).alias("k"),
        "s_name",
    ))
    return _fuse(workspace, "w", "d", "t", fuse_by="column", fuse_on="k", fuse_how="outer")


# -- inspection -----------------------------------------------------------------------------


@query("""
    SELECT o_orderstatus, count(*) AS n_orders, round(avg(o_totalprice), 4) AS avg_price
    FROM orders GROUP BY o_orderstatus
""")
def sql_view(spark, sf_dir):
    return run_sql(
        _workspace(spark, sf_dir, "orders"),
        "SELECT o_orderstatus, count(*) AS n_orders, round(avg(o_totalprice), 4) AS avg_price "
        "FROM view_orders GROUP BY o_orderstatus",
    )


_ROLLUP = """
    SELECT o_orderstatus, o_orderpriority, count(*) AS n_orders,
           round(sum(o_totalprice), 2) AS total
    FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)
"""
_UNSOLD = """
    SELECT p_partkey AS partkey FROM {part} WHERE p_size > 10
    EXCEPT
    SELECT DISTINCT l_partkey FROM {lineitem} WHERE l_quantity > 45
"""


@query(_ROLLUP.format(orders="orders"))
def sql_rollup(spark, sf_dir):
    return run_sql(_workspace(spark, sf_dir, "orders"), _ROLLUP.format(orders="view_orders"))


@query(_UNSOLD.format(part="part", lineitem="lineitem"))
def sql_except(spark, sf_dir):
    workspace = _workspace(spark, sf_dir, "part", "lineitem")
    return run_sql(workspace, _UNSOLD.format(part="view_part", lineitem="view_lineitem"))


@query("SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 60")
def preview_sorted(spark, sf_dir):
    workspace = _workspace(spark, sf_dir, "orders")
    text = "SELECT * FROM view_orders ORDER BY o_totalprice DESC, o_orderkey"
    return preview(run_sql(workspace, text), 60)


@query("""
    SELECT event_id,
           '[' || event_type || ', ' || coalesce(CAST(user_id AS VARCHAR), 'null') || ']' AS labels,
           '{' || json_extract(props, '$.k') || '}' AS parsed
    FROM events
""")
def display_nested(spark, sf_dir):
    df = _table(spark, sf_dir, "events").select(
        "event_id",
        F.array("event_type", F.col("user_id").cast("string")).alias("labels"),
        F.from_json("props", F.schema_of_json(F.lit('{"k": 1}'))).alias("parsed"),
    )
    return displayable(df)


def _described(statistic: str, aggregate: str) -> str:
    def number(column: str) -> str:
        return f"round(CAST({aggregate}({column}) AS DOUBLE), 4) AS {column}"

    def text(column: str) -> str:
        known = aggregate in ("count", "min", "max")
        return f"CAST({aggregate}({column}) AS VARCHAR) AS {column}" if known else f"NULL AS {column}"

    columns = [number("c_custkey"), text("c_name"), number("c_nationkey"), number("c_acctbal")]
    return f"""
        SELECT '{statistic}' AS summary, {", ".join(columns)}, {text("c_mktsegment")}
        FROM customer
    """


_STATISTICS = {
    "count": "count", "mean": "avg", "stddev": "stddev_samp", "min": "min", "max": "max"
}


@query(" UNION ALL ".join(_described(*statistic) for statistic in _STATISTICS.items()))
def describe_columns(spark, sf_dir):
    numbers = ("c_custkey", "c_nationkey", "c_acctbal")
    return describe(_table(spark, sf_dir, "customer")).withColumns(
        {name: F.round(F.col(name).cast("double"), 4) for name in numbers}
    )


# -- files ----------------------------------------------------------------------------------


@query("""
    SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey,
           o_orderstatus, CAST(o_totalprice AS VARCHAR) AS o_totalprice,
           strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority
    FROM orders
""")
def csv_round_trip(spark, sf_dir):
    df = _table(spark, sf_dir, "orders")
    path = write_files(df, new_folder(spark, "csv") + "/orders.csv", "csv")
    return read_file(spark, FileSpec(path))


_DOCUMENTS_AS_TEXT = """
    SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, source,
           CAST(n_chars AS VARCHAR) AS n_chars
    FROM documents
"""


@query(_DOCUMENTS_AS_TEXT)
def csv_free_text(spark, sf_dir):
    """Texts with line breaks, quotes and backslashes, written and read as CSV."""
    workspace = _workspace(spark, sf_dir, "documents")
    target = {"type": "download", "datasets": ["documents"], "conversions": {"documents": "csv"}}
    place = RunPlace(new_folder(spark, "csv"), new_folder(spark, "streams"))
    exported = export(workspace, target, place)
    return read_file(spark, FileSpec(exported.paths["documents"]))


@query("""
    SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name,
           CAST(c_nationkey AS VARCHAR) AS c_nationkey, CAST(c_acctbal AS VARCHAR) AS c_acctbal,
           c_mktsegment
    FROM customer
""")
def txt_round_trip(spark, sf_dir):
    df = _table(spark, sf_dir, "customer")
    path = new_folder(spark, "txt") + "/Customer List.txt"
    df.write.option("header", True).option("sep", "\t").csv(path)
    workspace = Workspace(spark)
    import_sources(workspace, {"Files": [{"path": path, "sep": "\\t"}]})
    return workspace["customer_list"]


@query("SELECT * FROM orders")
def parquet_round_trip(spark, sf_dir):
    workspace = _workspace(spark, sf_dir, "orders")
    place = RunPlace(new_folder(spark, "parquet"), new_folder(spark, "streams"))
    target = {
        "type": "download", "datasets": ["orders"], "conversions": {"orders": "parquet"}
    }
    exported = export(workspace, target, place)
    return read_file(spark, FileSpec(exported.paths["orders"]))


@query("""
    SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name FROM supplier
    UNION ALL
    SELECT CAST(c_custkey AS VARCHAR), c_name FROM customer
""")
def target_two_formats(spark, sf_dir):
    workspace = _workspace(spark, sf_dir, "supplier", "customer")
    rules = {
        "supplier": [_drop("column", "s_nationkey", "s_acctbal")],
        "customer": [_drop("column", "c_nationkey", "c_acctbal", "c_mktsegment")],
    }
    apply_rule(workspace, rules)
    target = {
        "type": "download",
        "datasets": ["supplier", "customer"],
        "conversions": {"supplier": "csv", "customer": "parquet"},
    }
    place = RunPlace(new_folder(spark, "formats"), new_folder(spark, "streams"))
    paths = export(workspace, target, place).paths
    written = Workspace(spark)
    import_sources(written, {"Files": [{"path": path} for path in paths.values()]})
    return _fuse(written, "supplier", "customer", fuse_by="row")


@query("""
    SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, user_id, event_type, value, props
    FROM events
""")
def json_files(spark, sf_dir):
    seconds = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    df = _table(spark, sf_dir, "events").withColumn("ts", seconds)
    path = new_folder(spark, "json") + "/events.json"
    df.write.json(path)
    sample = (
        '{"event_id": 1, "ts": "2024-01-01T00:00:00", "user_id": 1, "event_type": "view",'
        ' "value": 1.5, "props": "{}"}'
    )
    return read_file(spark, FileSpec(path, schema_skeleton=sample))


@query("""
    SELECT CAST(p_partkey AS VARCHAR) AS partkey, p_brand, CAST(l_quantity AS VARCHAR) AS quantity
    FROM part JOIN lineitem ON p_partkey = l_partkey
""")
def link_import(spark, sf_dir):
    folder = new_folder(spark, "links")
    workspace = _workspace(spark, sf_dir, "part", "lineitem")
    parts = workspace["part"].select(F.col("p_partkey").alias("partkey"), "p_brand")
    lines = workspace["lineitem"].select(
        F.col("l_partkey").alias("partkey"), F.col("l_quantity").alias("quantity")
    )
    parts.write.option("header", True).csv(f"{folder}/parts.csv")
    lines.write.options(header=True, sep=";").csv(f"{folder}/lines.txt")
    root = folder if ":/" in folder else f"file:{folder}"
    imported = Workspace(spark)
    links = f"parts: {root}/parts.csv\nlines: {root}/lines.txt?sep=;"
    import_sources(imported, {"Link": {"source_links": links}})
    return _fuse(imported, "parts", "lines", fuse_by="column", fuse_on="partkey")


# -- streams --------------------------------------------------------------------------------


def _event_stream(sf_dir: str, **fields) -> dict:
    return {
        "stream_from": "files",
        # A file stream takes a folder or a pattern; the table may be a file or a folder.
        "path": f"{sf_dir}/events.parquet*",
        "file_format": "parquet",
        "dataframe_name": "events",
        **fields,
    }


def _drained(workspace: Workspace, dataset: str, file_format: str = "parquet") -> DataFrame:
    """Run a streaming dataset over all that its source holds; read back what it wrote."""
    spark = workspace.spark
    output = new_folder(spark, "stream-out")
    # Names of running streams are unique in a session.
    name = posixpath.basename(output)
    place = RunPlace(output, new_folder(spark, "stream-progress"), pipeline=name)
    target = {
        "type": "download",
        "datasets": [dataset],
        "conversions": {dataset: file_format},
        "trigger": "available_now",
    }
    schema = workspace[dataset].schema
    exported = export(workspace, target, place)
    for running in exported.queries:
        running.awaitTermination()
    if file_format == "csv":
        return read_file(spark, FileSpec(exported.paths[dataset]))
    return spark.read.schema(schema).parquet(exported.paths[dataset])


def _streaming(spark: SparkSession, sf_dir: str) -> Workspace:
    workspace = Workspace(spark)
    import_sources(workspace, {"Stream": _event_stream(sf_dir)})
    return workspace


@query("""
    SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, user_id, event_type, value, props
    FROM events
""")
def stream_json_decode(spark, sf_dir):
    workspace = _streaming(spark, sf_dir)
    seconds = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts")
    document = F.struct("event_id", seconds, "user_id", "event_type", "value", "props")
    payload = workspace["events"].select(F.to_json(document).cast("binary").alias("value"))
    sample = (
        '{"event_id": 1, "ts": "2024-01-01T00:00:00", "user_id": 1, "event_type": "view",'
        ' "value": 1.5, "props": "{}"}'
    )
    workspace.add("decoded", decode_json(payload, sample))
    return _drained(workspace, "decoded")


@query("""
    SELECT event_id AS id, CAST(trunc(value) AS INT) AS value,
           CASE WHEN trunc(value) > 50 THEN 'high' ELSE event_type END AS event_type,
           CAST(json_extract(props, '$.k') AS BIGINT) AS k
    FROM events WHERE event_type <> 'error' AND value IS NOT NULL
""")
def stream_rules(spark, sf_dir):
    workspace = _streaming(spark, sf_dir)
    parsed = F.from_json("props", F.schema_of_json(F.lit('{"k": 1}')))
    workspace.add("events", workspace["events"].withColumn("parsed", parsed))
    rule = {
        "events": [
            _cast("value", "int"),
            _filter("event_type", "!=", "error"),
            _fill_where("event_type", "high", ("value", ">", "50")),
            _flatten("parsed.k", "k"),
            _drop("column", "parsed", "props", "ts", "user_id"),
            _drop("null values", "All"),
            _rename("event_id", "id"),
        ]
    }
    apply_rule(workspace, rule)
    return _drained(workspace, "events")


@query(f"""
    WITH given AS ({_EVENTS_WITH_NULLS})
    SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM events)), 4) AS value FROM given
""")
def stream_fill_mean(spark, sf_dir):
    workspace = _streaming(spark, sf_dir)
    import_sources(workspace, {"Files": [{**_files(sf_dir, "events")[0], "name": "history"}]})
    value = F.when(F.col("event_type") != "error", F.col("value"))
    workspace.add("events", workspace["events"].select("event_id", value.alias("value")))
    fill = _fill_nulls("value", fill_condition="mean", stats_from="history")
    apply_rule(workspace, {"events": [fill]})
    return _drained(workspace, "events").withColumn("value", F.round("value", 4))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, sf_dir):
    workspace = _streaming(spark, sf_dir)
    rule = {
        "events": [
            _drop("column", "event_id", "ts", "value", "props"),
            _drop("duplicates", "All"),
        ]
    }
    apply_rule(workspace, rule)
    return _drained(workspace, "events")


@query("""
    SELECT e.user_id, e.event_id, e.event_type, c.c_name, c.c_mktsegment
    FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey
""")
def stream_static_join(spark, sf_dir):
    workspace = _streaming(spark, sf_dir)
    import_sources(workspace, {"Files": _files(sf_dir, "customer")})
    rules = {
        "events": [_drop("column", "ts", "value", "props")],
        "customer": [
            _rename("c_custkey", "user_id"),
            _drop("column", "c_nationkey", "c_acctbal"),
        ],
    }
    apply_rule(workspace, rules)
    step = {"fuse_by": "column", "fuse_on": "user_id", "fuse_how": "left"}
    _fuse(workspace, "events", "customer", **step)
    return _drained(workspace, "out")


@query("""
    SELECT event_id, event_type FROM events WHERE value >= 50
    UNION ALL
    SELECT event_id, event_type FROM events WHERE event_type = 'purchase'
""")
def stream_union(spark, sf_dir):
    workspace = Workspace(spark)
    both = [_event_stream(sf_dir), _event_stream(sf_dir, dataframe_name="purchases")]
    import_sources(workspace, {"Stream": both})
    unused = _drop("column", "ts", "user_id", "value", "props")
    rules = {
        "events": [_filter("value", ">=", "50"), unused],
        "purchases": [_filter("event_type", "==", "purchase"), unused],
    }
    apply_rule(workspace, rules)
    _fuse(workspace, "events", "purchases", fuse_by="row")
    return _drained(workspace, "out")


@query("""
    SELECT event_id, event_type, value, CAST(0 AS BIGINT) AS batch FROM events
""")
def stream_foreach_batch(spark, sf_dir):
    workspace = _streaming(spark, sf_dir)
    apply_rule(workspace, {"events": [_drop("column", "ts", "user_id", "props")]})
    path = new_folder(spark, "batches")
    write = batch_writer(lambda batch: batch.write.mode("append").parquet(path), "batch")
    (
        workspace["events"]
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", new_folder(spark, "stream-progress"))
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.parquet(path)


@query("""
    SELECT CAST(event_id AS VARCHAR) AS event_id, event_type,
           CAST(user_id AS VARCHAR) AS user_id
    FROM events
""")
def stream_csv(spark, sf_dir):
    workspace = _streaming(spark, sf_dir)
    apply_rule(workspace, {"events": [_drop("column", "ts", "value", "props")]})
    return _drained(workspace, "events", "csv")


@query(_DOCUMENTS_AS_TEXT)
def stream_csv_free_text(spark, sf_dir):
    source = _event_stream(sf_dir, path=f"{sf_dir}/documents.parquet*", dataframe_name="documents")
    workspace = Workspace(spark)
    import_sources(workspace, {"Stream": source})
    return _drained(workspace, "documents", "csv")


def _purchases_and_clicks(spark: SparkSession, sf_dir: str) -> Workspace:
    """Two streams over all events, an hour of lateness allowed."""
    workspace = Workspace(spark)
    mark = {"column": "ts", "delay": "1 hour"}
    for name in ("purchases", "clicks"):
        stream = _event_stream(sf_dir, dataframe_name=name, watermark=mark)
        import_sources(workspace, {"Stream": stream})
    apply_rule(workspace, {
        "purchases": [_filter("event_type", "==", "purchase"), _drop("column", "event_type", "props")],
        "clicks": [
            _filter("event_type", "==", "click"), _drop("column", "event_type", "props", "value"),
            _rename("event_id", "click_id"), _rename("ts", "clicked"),
        ],
    })
    return workspace


def _within_half_an_hour(workspace: Workspace, how: str) -> DataFrame:
    times = {"left": "ts", "right": "clicked", "within": "30 minutes"}
    _fuse(
        workspace, "purchases", "clicks",
        fuse_by="column", fuse_on="user_id", fuse_how=how, event_time=times,
    )
    columns = ["user_id", "event_id", "value", "click_id"]
    workspace.update("out", workspace["out"].select(*columns))
    return _drained(workspace, "out")


_PURCHASE_CLICKS = """
    SELECT p.user_id, p.event_id, p.value, c.event_id AS click_id, p.ts
    FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    {join} JOIN (SELECT * FROM events WHERE event_type = 'click') c
    ON p.user_id = c.user_id AND c.ts BETWEEN p.ts - INTERVAL 30 MINUTE AND p.ts + INTERVAL 30 MINUTE
"""


@query(f"SELECT user_id, event_id, value, click_id FROM ({_PURCHASE_CLICKS.format(join='INNER')})")
def stream_stream_inner(spark, sf_dir):
    return _within_half_an_hour(_purchases_and_clicks(spark, sf_dir), "inner")


@query(f"""
    WITH mark AS (
      SELECT min(last) - INTERVAL 1 HOUR AS seen FROM (
        SELECT max(ts) AS last FROM events WHERE event_type IN ('purchase', 'click')
        GROUP BY event_type))
    SELECT user_id, event_id, value, click_id FROM ({_PURCHASE_CLICKS.format(join='LEFT')}), mark
    WHERE click_id IS NOT NULL OR ts + INTERVAL 30 MINUTE <= seen
""")
def stream_stream_left(spark, sf_dir):
    """A purchase without a click is given out once no click can come any more, so those of the last
    hour and a half are still open at the end of the table."""
    return _within_half_an_hour(_purchases_and_clicks(spark, sf_dir), "left")


@query("""
    SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS since, event_type,
           count(*) AS n_events, round(sum(value), 4) AS total
    FROM events
    WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR
          <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE
    GROUP BY date_trunc('hour', ts), event_type
""")
def stream_sql_windows(spark, sf_dir):
    """SQL over the view of a stream: hours are given out once the watermark has passed them."""
    workspace = Workspace(spark)
    mark = {"column": "ts", "delay": "10 minutes"}
    import_sources(workspace, {"Stream": _event_stream(sf_dir, watermark=mark)})
    hours = run_sql(workspace, """
        SELECT date_format(window.start, 'yyyy-MM-dd HH:mm:ss') AS since, event_type,
               count(*) AS n_events, round(sum(value), 4) AS total
        FROM view_events GROUP BY window(ts, '1 hour'), event_type
    """)  # fmt: skip
    workspace.add("hours", hours)
    return _drained(workspace, "hours")


def _stream_layers(sf_dir: str, kind: str) -> list[dict]:
    rule = [_filter("event_type", "==", kind), _drop("column", "ts", "props", "user_id")]
    target = {
        "type": "download",
        "datasets": ["events"],
        "conversions": {"events": "parquet"},
        "trigger": "available_now",
    }
    return [
        {"layer_type": "Source", "layer_selection": {"Stream": _event_stream(sf_dir)}},
        {"layer_type": "Processor", "layer_selection": {"events": rule}},
        {"layer_type": "Target", "layer_selection": target},
    ]


@query("SELECT event_id, event_type, value FROM events WHERE event_type = 'purchase'")
def stream_restart(spark, sf_dir):
    places = {
        "output_dir": new_folder(spark, "stream-out"),
        "checkpoint_root": new_folder(spark, "stream-progress"),
    }
    inbox = new_folder(spark, "stream-in")
    layers = _stream_layers(sf_dir, "purchase")
    layers[0]["layer_selection"]["Stream"]["path"] = inbox
    events = _table(spark, sf_dir, "events")
    for half in (0, 1):  # the second run finds the other half of the table
        events.where(F.col("event_id") % 2 == half).write.mode("append").parquet(inbox)
        result = run_pipeline(spark, layers, "restart", **places)
        result.wait()
    return spark.read.schema(result["events"].schema).parquet(result.paths["events"])


@query("SELECT event_id, event_type, value FROM events WHERE event_type = 'purchase'")
def stream_stop_resume(spark, sf_dir):
    """A registered stream is stopped half way through the table by the end of its application, and
    resumed by the next one from what the registry and its checkpoint remember."""
    places = {
        "output_dir": new_folder(spark, "stream-out"),
        "checkpoint_root": new_folder(spark, "stream-progress"),
    }
    inbox, registry = new_folder(spark, "stream-in"), new_folder(spark, "registry")
    name = posixpath.basename(registry)
    layers = _stream_layers(sf_dir, "purchase")
    layers[0]["layer_selection"]["Stream"]["path"] = inbox
    events = _table(spark, sf_dir, "events")
    events.where("event_id % 2 = 0").write.parquet(inbox)
    first = ActiveStreams(spark, registry)
    result = first.start(name, layers, **places)
    result.wait()
    result.stop()
    events.where("event_id % 2 = 1").write.mode("append").parquet(inbox)
    second = ActiveStreams(spark, registry)
    second.resume()
    resumed = second.running[name]
    resumed.wait()
    second.stop(name)
    return spark.read.schema(resumed["events"].schema).parquet(resumed.paths["events"])


@query("""
    WITH filtered AS (SELECT * FROM orders WHERE o_totalprice > 200000),
         fused AS (SELECT o_custkey FROM filtered JOIN customer ON o_custkey = c_custkey)
    SELECT 0 AS layer, 'customer' AS dataset, (SELECT count(*) FROM customer) AS n_rows
    UNION ALL SELECT 0, 'orders', (SELECT count(*) FROM orders)
    UNION ALL SELECT 1, 'orders', (SELECT count(*) FROM filtered)
    UNION ALL SELECT 2, 'large', (SELECT count(*) FROM fused)
    UNION ALL SELECT 3, 'large', (SELECT count(*) FROM (SELECT DISTINCT o_custkey FROM fused))
""")
def pipeline_counts(spark, sf_dir):
    """Rows after every layer, counted while the target is written."""
    rule = [_filter("o_totalprice", ">", "200000"), _rename("o_custkey", "c_custkey")]
    step = {
        "fused_dataset_name": "large", "datasets_to_fuse": ["orders", "customer"],
        "fuse_by": "column", "fuse_on": "c_custkey",
    }
    target = {"type": "download", "datasets": ["large"], "conversions": {"large": "parquet"}}
    layers = [
        {"layer_type": "Source", "layer_selection": {"Files": _files(sf_dir, "customer", "orders")}},
        {"layer_type": "Processor", "layer_selection": {"orders": rule}},
        {"layer_type": "Fusion", "layer_selection": [step]},
        {"layer_type": "Processor", "layer_selection": {"large": [_drop("duplicates", "c_custkey")]}},
        {"layer_type": "Target", "layer_selection": target},
    ]
    result = run_pipeline(spark, layers, output_dir=new_folder(spark, "out"), count_rows=True)
    rows = [(c.layer, c.dataset, c.rows) for c in result.counts()]
    return spark.createDataFrame(rows, "layer int, dataset string, n_rows long")


@query("""
    SELECT event_id, event_type, value FROM events WHERE event_type IN ('purchase', 'signup')
""")
def stream_side_by_side(spark, sf_dir):
    results = []
    for kind in ("purchase", "signup"):
        places = {
            "output_dir": new_folder(spark, "stream-out"),
            "checkpoint_root": new_folder(spark, "stream-progress"),
        }
        name = f"side-by-side-{kind}"
        results.append(run_pipeline(spark, _stream_layers(sf_dir, kind), name, **places))
    for result in results:
        result.wait()
    schema = results[0]["events"].schema
    return spark.read.schema(schema).parquet(*(r.paths["events"] for r in results))


# -- whole specs ----------------------------------------------------------------------------


def large_orders(sf_dir: str) -> Catalog:
    """Large orders with their customers, written to Parquet."""
    return Catalog(
        inputs={"shop": {"Files": _files(sf_dir, "orders", "customer")}},
        rules={
            "shop": {
                "large": {
                    "orders": [
                        _filter("o_totalprice", ">", "200000"),
                        _rename("o_custkey", "custkey"),
                    ],
                    "customer": [_rename("c_custkey", "custkey")],
                }
            }
        },
        fusions={
            "shop": {
                "with_customer": [
                    {
                        "fused_dataset_name": "large_orders",
                        "datasets_to_fuse": ["orders", "customer"],
                        "fuse_by": "column",
                        "fuse_on": "custkey",
                        "fuse_how": "inner",
                    }
                ]
            }
        },
        targets={
            "shop": {
                "files": {
                    "type": "download",
                    "datasets": ["large_orders"],
                    "conversions": {"large_orders": "parquet"},
                }
            }
        },
        pipelines={
            "large_orders": [
                {"layer_type": "Source", "layer_selection": "shop"},
                {"layer_type": "Processor", "layer_selection": "large"},
                {"layer_type": "Fusion", "layer_selection": "with_customer"},
                {"layer_type": "Target", "layer_selection": "files"},
            ]
        },
    )


@query("""
    SELECT o_custkey AS custkey, o_orderkey, o_orderstatus, o_totalprice, o_orderdate,
           o_orderpriority, c_name, c_nationkey, c_acctbal, c_mktsegment
    FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE o_totalprice > 200000
""")
def spec_end_to_end(spark, sf_dir):
    layers = large_orders(sf_dir).resolve("large_orders")
    result = run_pipeline(spark, layers, "large_orders")
    return spark.read.parquet(result.paths["large_orders"])

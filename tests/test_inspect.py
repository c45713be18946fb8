"""SQL over views, previews, statistics and schema listings."""

import pytest
from helpers import rows

from weftline.errors import SpecError
from weftline.operators.inspect import describe, displayable, preview, run_sql, schema_listing
from weftline.workspace import Workspace


@pytest.fixture
def workspace(spark):
    workspace = Workspace(spark)
    workspace.add("My sales", spark.range(100).selectExpr("id", "id % 3 AS g"))
    return workspace


def test_sql(workspace):
    df = run_sql(workspace, "SELECT g, count(*) AS n FROM view_my_sales GROUP BY g")
    assert rows(df) == {(0, 34): 1, (1, 33): 1, (2, 33): 1}
    assert run_sql(workspace, dataset="My sales").count() == 100
    with pytest.raises(SpecError):
        run_sql(workspace)


def test_preview(workspace):
    assert preview(workspace["My sales"]).count() == 10
    assert preview(workspace["My sales"], 60).count() == 60


def test_nested_columns_become_text(spark):
    df = spark.sql("SELECT array(1, 2) AS a, named_struct('x', 1) AS s, map(1, 2) AS m, 3 AS i")
    shown = displayable(df)
    assert [t for _, t in shown.dtypes] == ["string", "string", "string", "int"]
    assert shown.first()[:3] == ("[1, 2]", "{1}", "{1 -> 2}")


def test_describe(either_ansi):
    df = either_ansi.createDataFrame([(1, "a"), (3, "junk"), (None, None)], "n int, s string")
    got = {r.summary: (r.n, r.s) for r in describe(df).collect()}
    assert got["count"] == ("2", "2")
    assert got["mean"] == ("2.0", None)
    assert got["min"] == ("1", "a") and got["max"] == ("3", "junk")
    assert got["stddev"][0].startswith("1.414")


def test_schema_listing(spark):
    df = spark.sql("SELECT 1 AS i, array(named_struct('x', 1.5BD)) AS a")
    assert rows(schema_listing(df)) == {
        ("i", "int", False): 1,
        ("a", "array<struct<x:decimal(2,1)>>", False): 1,
    }

"""File, console and JDBC targets on batch datasets."""

import os

import pytest
from helpers import rows

from weftline.errors import SpecError
from weftline.sinks.export import RunPlace, export
from weftline.sinks.jdbc import batch_writer, jdbc_options
from weftline.workspace import Workspace


@pytest.fixture
def workspace(spark):
    workspace = Workspace(spark)
    workspace.add("plain", spark.createDataFrame([(1, "a,b"), (2, None)], "id int, s string"))
    workspace.add(
        "nested",
        spark.sql("SELECT array(1, 2) AS a, named_struct('x', 1) AS s,"
                  " TIMESTAMP '2020-01-02 03:04:05' AS t"),
    )
    return workspace


@pytest.fixture
def place(tmp_path):
    return RunPlace(f"{tmp_path}/out", f"{tmp_path}/progress")


def _download(*datasets, file_format="parquet", **more):
    conversions = {name: file_format for name in datasets}
    return {
        "type": "download", "datasets": list(datasets), "conversions": conversions, **more
    }


def test_parquet_reports_the_path_it_wrote(workspace, place, spark):
    exported = export(workspace, _download("plain"), place)
    assert exported.paths == {"plain": f"{place.output_dir}/plain.parquet"}
    assert rows(spark.read.parquet(exported.paths["plain"])) == rows(workspace["plain"])
    with pytest.raises(Exception, match="already exists"):
        export(workspace, _download("plain"), place)
    export(workspace, _download("plain", mode="append"), place)
    assert spark.read.parquet(exported.paths["plain"]).count() == 4


def test_csv(workspace, place, spark):
    paths = export(workspace, _download("plain", "nested", file_format="csv"), place).paths
    assert rows(spark.read.csv(paths["plain"], header=True)) == {("1", "a,b"): 1, ("2", None): 1}
    nested = spark.read.csv(paths["nested"], header=True).first()
    assert tuple(nested) == ("[1, 2]", "{1}", "2020-01-02 03:04:05")


def test_each_dataset_has_its_own_format(workspace, place):
    target = _download("plain", "nested")
    target["conversions"]["nested"] = "csv"
    paths = export(workspace, target, place).paths
    assert [path.rsplit(".", 1)[1] for path in paths.values()] == ["parquet", "csv"]


def test_console(workspace, place, capsys):
    export(workspace, {"type": "console", "datasets": ["nested"], "rows": 5}, place)
    assert "[1, 2]" in capsys.readouterr().out


def test_bad_targets(workspace, place):
    for target, message in (
        ({"type": "ftp", "datasets": ["plain"]}, "unknown target type"),
        ({"type": "console", "datasets": []}, "no datasets"),
        (_download("plain", file_format="xlsx"), "unknown format"),
        ({"type": "download", "datasets": ["plain"]}, "unknown format"),
    ):
        with pytest.raises(SpecError, match=message):
            export(workspace, target, place)
    assert not os.path.exists(place.output_dir)


JDBC = {
    "type": "jdbc", "datasets": ["plain"], "jdbc_url": "jdbc:postgresql://h/db",
    "jdbc_table_name": "t", "jdbc_username": "env:WEFT_USER", "jdbc_password": "env:WEFT_PASS",
}


def test_jdbc_options_take_credentials_from_the_environment(monkeypatch):
    monkeypatch.setenv("WEFT_USER", "me")
    monkeypatch.setenv("WEFT_PASS", "secret")
    assert jdbc_options({**JDBC, "jdbc_connections": 8}) == {
        "driver": "org.postgresql.Driver", "url": "jdbc:postgresql://h/db", "dbtable": "t",
        "user": "me", "password": "secret", "numPartitions": "8",
    }


def test_jdbc_refuses_secrets_in_specs(monkeypatch):
    monkeypatch.delenv("WEFT_USER", raising=False)
    with pytest.raises(SpecError, match="WEFT_USER"):
        jdbc_options(JDBC)
    with pytest.raises(SpecError, match="env:NAME") as error:
        jdbc_options({**JDBC, "jdbc_username": None, "jdbc_password": "hunter2"})
    assert "hunter2" not in str(error.value)
    with pytest.raises(SpecError, match="jdbc_url"):
        jdbc_options({"type": "jdbc"})


def test_batch_numbers(workspace, spark):
    seen = []
    write = batch_writer(lambda df: seen.append(rows(df)), "batch")
    write(workspace["plain"], 7)
    assert seen == [{(1, "a,b", 7): 1, (2, None, 7): 1}]

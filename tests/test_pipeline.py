"""Catalogs, layer checks, logs and failures."""

import json

import pytest
from helpers import process, rows

import __spark_entry__
from weftline import Catalog, run_pipeline
from weftline.errors import PipelineError, SpecError
from weftline.plans.queries import ORACLE_SQL, QUERIES, large_orders
from weftline.scratch import new_folder, shared_root

SMALL = "/root/testdata/sf0.001"


def test_stored_specs_run_from_a_file(spark, tmp_path):
    (tmp_path / "catalog.json").write_text(large_orders(SMALL).to_json())
    catalog = Catalog.load(spark, f"{tmp_path}/catalog.json")
    assert catalog == large_orders(SMALL)
    layers = catalog.resolve("large_orders")
    result = run_pipeline(spark, layers, "large_orders", output_dir=f"{tmp_path}/out")
    assert result.paths == {"large_orders": f"{tmp_path}/out/large_orders.parquet"}
    assert [(e.layer_type, e.status, e.percent) for e in result.log] == [
        ("Source", "done", 25), ("Processor", "done", 50), ("Fusion", "done", 75),
        ("Target", "done", 100),
    ]
    written = spark.read.parquet(result.paths["large_orders"])
    assert rows(written) == rows(result["large_orders"])
    assert catalog.pipelines["large_orders"][0]["layer_selection"] == "shop"


def test_specs_belong_to_their_input():
    catalog = large_orders(SMALL)
    catalog.rules = {"other": catalog.rules["shop"]}
    with pytest.raises(SpecError, match="rules of input 'shop'"):
        catalog.resolve("large_orders")
    with pytest.raises(SpecError, match="pipeline 'none' not found"):
        catalog.resolve("none")
    with pytest.raises(SpecError, match="not a catalog"):
        Catalog.from_json('{"inputs": {}, "models": {}}')


@pytest.mark.parametrize(
    "layers, message",
    [
        ([], "empty"),
        ([{"layer_type": "Target", "layer_selection": {"type": "console"}}], "first layer"),
        ([{"layer_type": "Source"}], "selects nothing"),
        ([{"layer_type": "Sort", "layer_selection": {"a": 1}}], "unknown layer type"),
    ],
)
def test_layer_checks(spark, layers, message):
    with pytest.raises(SpecError, match=message):
        run_pipeline(spark, layers)


def _layers(tmp_path, *processes):
    (tmp_path / "a.csv").write_text("x\n1\n2\n")
    rule = {"a": list(processes)}
    target = {"type": "download", "datasets": ["a"], "conversions": {"a": "csv"}}
    return [
        {"layer_type": "Source", "layer_selection": {"Files": [{"path": f"{tmp_path}/a.csv"}]}},
        {"layer_type": "Processor", "layer_selection": rule},
        {"layer_type": "Target", "layer_selection": target},
    ]


def test_a_failed_layer_is_reported_and_nothing_after_it_runs(spark, tmp_path):
    layers = _layers(tmp_path, process("Cast", column_to_cast="none", cast_type="int"))
    heard = []
    with pytest.raises(PipelineError, match=r"layer 1 \(Processor\): a\[0\] Cast") as error:
        run_pipeline(spark, layers, output_dir=f"{tmp_path}/out", on_layer=heard.append)
    assert [entry.status for entry in heard] == ["done", "failed"]
    assert error.value.log == heard
    assert not (tmp_path / "out").exists()


def test_second_processor_layer_builds_on_the_first(spark, tmp_path):
    keep = process("Filter", source_reference="x", operator="==", data_reference="1")
    rename = process("Rename", source_reference="x", data_reference="y")
    layers = _layers(tmp_path, keep)
    layers.insert(2, {"layer_type": "Processor", "layer_selection": {"a": [rename]}})
    result = run_pipeline(spark, layers, output_dir=f"{tmp_path}/one")
    assert rows(result["a"]) == {("1",): 1} and result["a"].columns == ["y"]
    layers[2]["reset"] = True
    result = run_pipeline(spark, layers, output_dir=f"{tmp_path}/two")
    assert result["a"].count() == 2


def test_specs_are_plain_json(tmp_path):
    layers = _layers(tmp_path, process("Drop", drop_by="column", data_reference=["x"]))
    assert json.loads(json.dumps(layers)) == layers


class FakeSession:
    """Stands in for sessions with settings that are fixed at their start."""

    def __init__(self, **settings):
        self.settings = {key.replace("_", "."): value for key, value in settings.items()}
        self.conf = self

    def get(self, key, default=None):
        return self.settings.get(key, default)


def test_shared_folder_comes_from_the_session(spark):
    session = FakeSession(spark_master="yarn", spark_checkpoint_dir="hdfs://shared/points/")
    assert shared_root(session) == "hdfs://shared/points"
    assert new_folder(session, "x").startswith("hdfs://shared/points/x-")
    assert new_folder(spark, "x") != new_folder(spark, "x")


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]"])
def test_a_cluster_without_a_shared_folder_is_an_error(master):
    with pytest.raises(SpecError, match=r"spark\.checkpoint\.dir"):
        shared_root(FakeSession(spark_master=master))


def test_driver_contract(spark):
    assert __spark_entry__.entry(spark).count() > 0
    # queries of optional folders may come on top
    assert QUERIES.keys() <= __spark_entry__.queries().keys()
    assert ORACLE_SQL.keys() <= __spark_entry__.oracle_sql().keys()
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()

"""Cases that once gave wrong answers or lost rows."""

from itertools import permutations

import pytest
from helpers import process

from weftline.errors import PipelineError, RuleError, SpecError
from weftline.operators.fusion import run_fusion
from weftline.operators.rules import apply_rule
from weftline.plans.catalog import Catalog
from weftline.plans.pipeline import run_pipeline
from weftline.sources.links import parse_links
from weftline.streaming.registry import ActiveStreams
from weftline.workspace import Workspace


@pytest.mark.parametrize("order", list(permutations(["ints", "longs", "texts"])))
def test_text_keys_match_exactly_in_any_order(either_ansi, order):
    spark = either_ansi
    workspace = Workspace(spark)
    workspace.add("ints", spark.createDataFrame([(5, 1), (0, 2)], "k int, i int"))
    workspace.add("longs", spark.createDataFrame([(3000000000, 1), (5, 2)], "k long, l int"))
    texts = [("5.7", 1), ("-0.3", 2), ("3000000000", 3), ("5.0", 4), ("junk", 5)]
    workspace.add("texts", spark.createDataFrame(texts, "k string, t int"))
    step = {"datasets_to_fuse": list(order), "fuse_by": "column", "fuse_on": "k",
            "fuse_how": "outer", "fused_dataset_name": "out"}
    run_fusion(workspace, [step])
    got = {(r.i, r.l, r.t) for r in workspace["out"].collect()}
    assert got == {(1, 2, 4), (2, None, None), (None, 1, 3), (None, None, 1), (None, None, 2),
                   (None, None, 5)}


def test_links_leave_punctuation_to_the_text():
    found = parse_links('see "s3a://b/a.csv", (file:/x/b.csv) and hdfs://c/d.txt?token=1&sep=;&v=2')
    assert [(f.path, f.sep) for f in found] == [
        ("s3a://b/a.csv", None), ("file:/x/b.csv", None), ("hdfs://c/d.txt", ";"),
    ]


def test_rename_onto_a_column_is_refused(spark):
    workspace = Workspace(spark)
    workspace.add("d", spark.createDataFrame([(1, 2)], "a int, b int"))
    with pytest.raises(RuleError, match="already"):
        apply_rule(workspace, {"d": [process("Rename", source_reference="a", data_reference="b")]})


def test_a_catalog_is_one_document(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / f"{name}.json").write_text("{}")
    with pytest.raises(SpecError, match="several"):
        Catalog.load(spark, str(tmp_path))


def _layers(source):
    stream = {"stream_from": "files", "path": source, "file_format": "parquet", "dataframe_name": "e"}
    target = {"type": "download", "datasets": ["e"], "conversions": {"e": "parquet"},
              "trigger": "available_now"}
    return [{"layer_type": "Source", "layer_selection": {"Stream": stream}},
            {"layer_type": "Target", "layer_selection": target}]


def test_a_stream_does_not_skip_rows_in_a_folder_of_another(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(40).write.parquet(source)
    places = {"output_dir": out, "checkpoint_root": str(tmp_path / "progress")}
    run_pipeline(spark, _layers(source), "p1", **places).wait()
    with pytest.raises(PipelineError, match="another output folder"):
        run_pipeline(spark, _layers(source), "p2", **places)
    with pytest.raises(PipelineError, match="needs a name"):
        run_pipeline(spark, _layers(source), None, **places)
    spark.range(40, 45).write.mode("append").parquet(source)
    run_pipeline(spark, _layers(source), "p1", **places).wait()
    assert spark.read.parquet(f"{out}/e.parquet").count() == 45


def test_resume_starts_the_others(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in"))
    places = {"output_dir": str(tmp_path / "out"), "checkpoint_root": str(tmp_path / "progress")}
    first = ActiveStreams(spark, str(tmp_path / "registry"))
    first.start("good", _layers(str(tmp_path / "in")), **places).wait()
    (tmp_path / "in").rename(tmp_path / "moved")
    spark.range(3).write.parquet(str(tmp_path / "there"))
    first.start("there", _layers(str(tmp_path / "there")), output_dir=str(tmp_path / "out2"),
                checkpoint_root=str(tmp_path / "progress")).wait()
    again = ActiveStreams(spark, str(tmp_path / "registry"))
    with pytest.raises(PipelineError, match="good"):
        again.resume()
    assert list(again.running) == ["there"]
    again.stop("there")

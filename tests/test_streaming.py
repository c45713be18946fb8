"""Rules, fusions and targets on streams: same answers as on batches, also after restarts."""

import json

import pytest
from helpers import process, rows
from pyspark.sql import functions as F

from weftline.errors import FusionError, PipelineError, RuleError, SpecError, StreamError
from weftline.operators.fusion import run_fusion
from weftline.operators.rules import apply_rule
from weftline.plans.pipeline import run_pipeline
from weftline.sinks.export import RunPlace, export
from weftline.sinks.jdbc import batch_writer
from weftline.sources.importer import import_sources
from weftline.streaming.registry import ActiveStreams
from weftline.workspace import Workspace

SAMPLE = json.dumps(
    {"id": 1, "kind": "k", "at": "2020-01-01 00:00:00", "list": [1], "in": {"x": 1.5}}
)


def _write(folder, name, events):
    folder.mkdir(exist_ok=True)
    text = "\n".join(json.dumps(e) for e in events) + "\nnoise\n"
    (folder / name).write_text(text)


def _event(i, kind="k", **more):
    return {
        "id": i, "kind": kind, "at": f"2020-01-01 00:00:{i:02d}", "list": [i, i + 1],
        "in": {"x": i / 2}, **more,
    }


def _source(folder, snapshot=False, name="events", **more):
    return {
        "Stream": {
            "stream_from": "files", "path": str(folder), "schema_skeleton": SAMPLE,
            "dataframe_name": name, "snapshot": snapshot, **more,
        }
    }


def _target(*datasets, file_format="parquet", **more):
    return {
        "type": "download", "datasets": list(datasets),
        "conversions": {name: file_format for name in datasets},
        "trigger": "available_now", **more,
    }


def _only(name, op, value):
    return process("Filter", source_reference=name, operator=op, data_reference=value)


RULE = [
    _only("id", ">", "1"),
    process("Cast", column_to_cast="at", cast_type="date", cast_from="yyyy-MM-dd HH:mm:ss",
            cast_to="ss/mm"),
    process("Rename", source_reference="kind", data_reference="sort"),
    process("Fill", fill_by="column", column_name="origin", data_reference="stream"),
    process("Fill", fill_by="column", column_name="sort", data_reference="big",
            apply_filter=True, fill_filter_source_reference="id", operator=">=",
            fill_filter_data_reference="3"),
    process("Fill", fill_by="null values", column_name="sort", data_reference="none"),
    process("Explode", new_column_name="item", data_reference="list"),
    process("Flatten", new_column_name="x", data_reference="in.x"),
    process("Drop", drop_by="column", data_reference=["list", "in"]),
    process("Drop", drop_by="null values", data_reference=["All"]),
    process("Drop", drop_by="duplicates", data_reference=["All"]),
    process("Cast", column_to_cast="x", cast_type="int"),
]


def _layers(folder, snapshot=False, **target):
    return [
        {"layer_type": "Source", "layer_selection": _source(folder, snapshot)},
        {"layer_type": "Processor", "layer_selection": {"events": RULE}},
        {"layer_type": "Target", "layer_selection": _target("events", **target)},
    ]


def _places(tmp_path, name):
    return {"output_dir": f"{tmp_path}/{name}", "checkpoint_root": f"{tmp_path}/progress"}


def test_stream_equals_batch_and_restarts_continue(spark, tmp_path):
    folder = tmp_path / "in"
    _write(folder, "1.txt", [_event(1), _event(2), _event(3, None), _event(3, None)])
    places = _places(tmp_path, "stream")
    first = run_pipeline(spark, _layers(folder), "p", **places)
    assert first.is_streaming
    first.wait()
    before = rows(spark.read.parquet(first.paths["events"]))

    again = run_pipeline(spark, _layers(folder), "p", **places)
    again.wait()
    assert rows(spark.read.parquet(again.paths["events"])) == before

    _write(folder, "2.txt", [_event(2), _event(4)])
    run_pipeline(spark, _layers(folder), "p", **places).wait()
    batch = run_pipeline(spark, _layers(folder, True), "b", **_places(tmp_path, "batch"))
    assert not batch.is_streaming
    streamed = spark.read.parquet(first.paths["events"])
    assert rows(streamed) == rows(spark.read.parquet(batch.paths["events"]))
    assert streamed.count() == 6


def test_csv_stream(spark, tmp_path):
    _write(tmp_path / "in", "1.txt", [_event(2), _event(3)])
    layers = _layers(tmp_path / "in", file_format="csv")
    result = run_pipeline(spark, layers, "csv", **_places(tmp_path, "out"))
    result.wait()
    assert spark.read.csv(result.paths["events"], header=True).count() == 4


def _both(spark, tmp_path):
    folder = tmp_path / "in"
    _write(folder, "1.txt", [_event(1), _event(2)])
    workspace = Workspace(spark)
    import_sources(workspace, _source(folder))
    import_sources(workspace, _source(folder, name="more"))
    static = spark.createDataFrame([(2, "two"), (9, "nine")], "id long, label string")
    workspace.add("static", static)
    return workspace


def _drain(workspace, dataset, tmp_path, name):
    place = RunPlace(f"{tmp_path}/{name}", f"{tmp_path}/{name}-progress")
    exported = export(workspace, _target(dataset), place)
    for query in exported.queries:
        query.awaitTermination()
    return workspace.spark.read.parquet(exported.paths[dataset])


def _step(how, *datasets, on="id"):
    return {
        "fused_dataset_name": "out", "datasets_to_fuse": list(datasets), "fuse_by": "column",
        "fuse_on": on, "fuse_how": how,
    }


@pytest.mark.parametrize(
    "how, datasets, count",
    [
        ("inner", ("events", "static"), 1),
        ("left", ("events", "static"), 2),
        ("right", ("static", "events"), 2),
        ("inner", ("events", "more"), 2),
    ],
)
def test_joins_spark_supports(spark, tmp_path, how, datasets, count):
    workspace = _both(spark, tmp_path)
    run_fusion(workspace, [_step(how, *datasets)])
    assert _drain(workspace, "out", tmp_path, "joined").count() == count


@pytest.mark.parametrize(
    "how, datasets",
    [
        ("right", ("events", "static")),
        ("outer", ("events", "static")),
        ("left", ("static", "events")),
        ("left", ("events", "more")),
    ],
)
def test_joins_spark_refuses_fail_early(spark, tmp_path, how, datasets):
    with pytest.raises(StreamError):
        run_fusion(_both(spark, tmp_path), [_step(how, *datasets)])


def test_outer_join_of_streams_with_a_watermark(spark, tmp_path):
    workspace = _both(spark, tmp_path)
    for name in ("events", "more"):
        timed = workspace[name].select(F.to_timestamp("at").alias("at"), F.col("id").alias(name))
        workspace.add(name, timed.withWatermark("at", "1 second"))
    run_fusion(workspace, [_step("left", "events", "more", on="at")])
    assert _drain(workspace, "out", tmp_path, "outer").count() == 2


def test_unions(spark, tmp_path):
    workspace = _both(spark, tmp_path)
    step = {"fused_dataset_name": "out", "fuse_by": "row"}
    run_fusion(workspace, [{**step, "datasets_to_fuse": ["events", "more"]}])
    assert _drain(workspace, "out", tmp_path, "union").count() == 4
    with pytest.raises(StreamError):
        run_fusion(workspace, [{**step, "datasets_to_fuse": ["events", "static"]}])
    with pytest.raises(FusionError):
        run_fusion(workspace, [_step("inner", "events", "static", on=None)])


def test_duplicates_within_a_watermark(spark, tmp_path):
    folder = tmp_path / "in"
    _write(folder, "1.txt", [_event(1), _event(1), _event(2)])
    workspace = Workspace(spark)
    import_sources(workspace, _source(folder))
    rule = [
        process("Cast", column_to_cast="at", cast_type="timestamp"),
        process("Drop", drop_by="duplicates", data_reference=["id"],
                watermark={"column": "at", "delay": "1 minute"}),
    ]
    apply_rule(workspace, {"events": rule})
    assert _drain(workspace, "events", tmp_path, "dedup").count() == 2


def test_source_watermark(spark, tmp_path):
    spark.createDataFrame([(1, "2020-01-01 00:00:00")], "id int, at string").select(
        "id", F.to_timestamp("at").alias("at")
    ).write.parquet(f"{tmp_path}/in")
    workspace = Workspace(spark)
    stream = {
        "stream_from": "files", "path": f"{tmp_path}/in", "file_format": "parquet",
        "dataframe_name": "d", "watermark": {"column": "at", "delay": "5 minutes"},
    }
    import_sources(workspace, {"Stream": stream})
    assert workspace["d"].schema["at"].metadata["spark.watermarkDelayMs"] == 300_000


def test_statistics_on_streams_need_a_static_dataset(spark, tmp_path):
    workspace = _both(spark, tmp_path)
    fill = {"fill_by": "null values", "column_name": "id", "fill_condition": "mean"}
    with pytest.raises(RuleError, match="static dataset"):
        apply_rule(workspace, {"events": [process("Fill", **fill)]})
    with pytest.raises(RuleError, match="static dataset"):
        apply_rule(workspace, {"events": [process("Fill", **fill, stats_from="more")]})
    nulls = process("Cast", column_to_cast="kind", cast_type="long")
    for condition, value in (("mean", 5), ("median", 2)):
        workspace.reset("events")
        fill = process("Fill", fill_by="null values", column_name="id",
                       fill_condition=condition, stats_from="static")
        rename = [
            process("Drop", drop_by="column", data_reference=["id"]), nulls,
            process("Rename", source_reference="kind", data_reference="id"), fill,
        ]
        apply_rule(workspace, {"events": rename})
        got = _drain(workspace, "events", tmp_path, condition).select("id").distinct()
        assert [r.id for r in got.collect()] == [value]


def test_a_stream_cannot_be_materialized(spark, tmp_path):
    workspace = _both(spark, tmp_path)
    save = process("Save", save_as="kept", materialize=True)
    with pytest.raises(RuleError, match="stream"):
        apply_rule(workspace, {"events": [save]})
    apply_rule(workspace, {"events": [process("Save", save_as="kept")]})
    assert workspace["kept"].isStreaming


def test_foreach_batch_appends_each_batch_once(spark, tmp_path):
    folder = tmp_path / "in"
    workspace = Workspace(spark)
    _write(folder, "1.txt", [_event(1)])
    import_sources(workspace, _source(folder))
    write = batch_writer(lambda df: df.write.mode("append").parquet(f"{tmp_path}/table"), "batch")
    for number in (1, 2):
        _write(folder, f"{number}.txt", [_event(number)])
        (
            workspace["events"].writeStream.foreachBatch(write)
            .option("checkpointLocation", f"{tmp_path}/progress")
            .trigger(availableNow=True).start().awaitTermination()
        )
    got = spark.read.parquet(f"{tmp_path}/table").select("id", "batch")
    assert rows(got) == {(1, 0): 1, (2, 1): 1}


def test_console_streams_have_their_own_checkpoints(spark, tmp_path):
    workspace = _both(spark, tmp_path)
    target = {"type": "console", "datasets": ["events", "more"], "trigger": "available_now"}
    exported = export(workspace, target, RunPlace("", f"{tmp_path}/p", "pipe", "con"))
    for query in exported.queries:
        query.awaitTermination()
    assert sorted(p.name for p in (tmp_path / "p" / "pipe" / "con").iterdir()) == [
        "events", "more"
    ]


def test_failing_target_stops_what_it_started(spark, tmp_path):
    workspace = _both(spark, tmp_path)
    target = {"type": "console", "datasets": ["events", "nothing"]}
    with pytest.raises(KeyError):
        export(workspace, target, RunPlace("", f"{tmp_path}/p"))
    assert spark.streams.active == []


def test_bad_trigger_is_reported(spark, tmp_path):
    _write(tmp_path / "in", "1.txt", [_event(1)])
    layers = _layers(tmp_path / "in", trigger="sometimes")
    with pytest.raises(PipelineError):
        run_pipeline(spark, layers, "p", **_places(tmp_path, "out"))


def test_streams_run_side_by_side_stop_and_resume(spark, tmp_path):
    folder = tmp_path / "in"
    _write(folder, "1.txt", [_event(2), _event(3)])
    layers = _layers(folder, trigger="100 milliseconds")
    streams = ActiveStreams(spark, f"{tmp_path}/registry")
    runs = {n: streams.start(n, layers, **_places(tmp_path, n)) for n in ("one", "two")}
    assert {q.name for q in spark.streams.active} == {
        "one.target_0.events", "two.target_0.events"
    }
    for run in runs.values():
        run.queries[0].processAllAvailable()
    streams.stop("two")
    assert list(streams.active()) == ["one"]
    runs["one"].stop()  # as a crash would: still registered

    _write(folder, "2.txt", [_event(4)])
    restarted = ActiveStreams(spark, f"{tmp_path}/registry")
    assert restarted.resume() == ["one"]
    assert restarted.resume() == []
    restarted.running["one"].queries[0].processAllAvailable()
    ids = spark.read.parquet(runs["one"].paths["events"]).select("id")
    assert rows(ids) == {(2,): 2, (3,): 2, (4,): 2}
    restarted.stop("one")
    assert restarted.active() == {} and spark.streams.active == []


def test_batch_pipelines_are_not_registered(spark, tmp_path):
    _write(tmp_path / "in", "1.txt", [_event(2)])
    streams = ActiveStreams(spark, f"{tmp_path}/registry")
    streams.start("batch", _layers(tmp_path / "in", True), **_places(tmp_path, "out"))
    assert streams.active() == {}


def test_targets_reject_bad_specs(spark, tmp_path):
    with pytest.raises(SpecError):
        export(_both(spark, tmp_path), {"type": "download"}, RunPlace("", ""))

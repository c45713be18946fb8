"""Joins of streams within a time, SQL over streams, counts of layers, the registry's size."""

import itertools
import os

import pytest
from helpers import process, rows
from pyspark.sql import functions as F

from weftline.errors import FusionError, SpecError, StreamError
from weftline.operators.fusion import fuse_columns, run_fusion
from weftline.operators.inspect import run_sql
from weftline.plans.pipeline import run_pipeline
from weftline.scratch import new_folder, remove, removed_after
from weftline.sinks.export import RunPlace, export
from weftline.sources.importer import import_sources
from weftline.streaming.registry import COMPACT_AFTER, ActiveStreams
from weftline.workspace import Workspace

MINUTE, START = 60, 1_699_999_980


def _timed(spark, seconds, name, key="k"):
    data = [(k, s, f"{name}{i}") for i, (k, s) in enumerate(seconds)]
    df = spark.createDataFrame(data, f"{key} string, s long, {name} string")
    return df.select(key, F.timestamp_seconds(F.col("s") + START).alias("at"), name)


_written = itertools.count(1_700_000_000, 10)


def _write(df, folder):
    """One more file, later than those before; file streams take them in the order of their times."""
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    df.coalesce(1).write.mode("append").parquet(folder)
    at = next(_written)
    for name in set(os.listdir(folder)) - before:
        os.utime(f"{folder}/{name}", (at, at))


def _streams(spark, folders, delay="10 minutes", marked=True):
    workspace = Workspace(spark)
    for name, folder in folders.items():
        source = {
            "stream_from": "files", "path": folder, "file_format": "parquet", "dataframe_name": name,
            "options": {"maxFilesPerTrigger": "1"},
        }
        if marked:
            source["watermark"] = {"column": "at", "delay": delay}
        import_sources(workspace, {"Stream": source})
    return workspace


def _drain(workspace, dataset, tmp_path):
    target = {
        "type": "download", "datasets": [dataset], "conversions": {dataset: "parquet"},
        "trigger": "available_now",
    }
    name = tmp_path.name
    exported = export(
        workspace, target, RunPlace(f"{tmp_path}/out", f"{tmp_path}/progress", pipeline=name)
    )
    exported.queries[0].awaitTermination()
    path = exported.paths[dataset]
    return workspace.spark.read.schema(workspace[dataset].schema).parquet(path), exported.queries[0]


TIMES = {"left": "at", "right": "at", "within": "5 minutes"}
LEFT = [("a", 0), ("a", 10 * MINUTE), ("b", 0), (None, 0), ("c", 60 * MINUTE)]
RIGHT = [("a", 5 * MINUTE), ("a", 5 * MINUTE + 1), ("b", 6 * MINUTE), (None, 0), ("z", 61 * MINUTE)]


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_rows_close_in_time_join(spark, how):
    workspace = Workspace(spark)
    workspace.add("l", _timed(spark, LEFT, "l"))
    workspace.add("r", _timed(spark, RIGHT, "r"))
    fused = fuse_columns(workspace, ["l", "r"], "K", how, event_time=TIMES)
    assert fused.columns == ["K", "at", "l", "at_r", "r"]
    met = {("a", "l0", "r0"), ("a", "l1", "r0"), ("a", "l1", "r1")}
    if how in ("left", "outer"):
        met |= {("b", "l2", None), (None, "l3", None), ("c", "l4", None)}
    if how in ("right", "outer"):
        met |= {("b", None, "r2"), (None, None, "r3"), ("z", None, "r4")}
    assert {(r.K, r.l, r.r) for r in fused.collect()} == met


@pytest.mark.parametrize("how", ["inner", "left"])
def test_streams_join_within_a_time(spark, tmp_path, how):
    """Several batches, a late row, and state that does not grow with the stream."""
    folders = {"l": f"{tmp_path}/l", "r": f"{tmp_path}/r"}
    batches = 6
    for i in range(batches):  # an hour apart: what came before is forgotten
        base = i * 60 * MINUTE
        _write(_timed(spark, [("a", base), ("b", base + 1)], "l"), folders["l"])
        _write(_timed(spark, [("a", base + 60), ("z", base)], "r"), folders["r"])
    _write(_timed(spark, [("a", 30), ("end", 600 * MINUTE)], "l"), folders["l"])  # the first is late
    _write(_timed(spark, [("end", 600 * MINUTE)], "r"), folders["r"])
    workspace = _streams(spark, folders)
    run_fusion(workspace, [{
        "fused_dataset_name": "out", "datasets_to_fuse": ["l", "r"], "fuse_by": "column", "fuse_on": "k",
        "fuse_how": how, "event_time": TIMES,
    }])
    out, query = _drain(workspace, "out", tmp_path)
    counts = {row.k: row["count"] for row in out.groupBy("k").count().collect()}
    assert counts["a"] == batches and counts["end"] == 1
    assert counts.get("b", 0) == (batches if how == "left" else 0)
    kept = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert max(kept) <= 12 and kept[-1] <= 4  # of 15 and 13 rows; with more batches no more


def test_unbounded_joins_are_refused(spark, tmp_path):
    folders = {"l": f"{tmp_path}/l", "r": f"{tmp_path}/r"}
    for name in folders:
        _write(_timed(spark, LEFT, name), folders[name])
    workspace = _streams(spark, folders, marked=False)
    with pytest.raises(StreamError, match="watermark"):
        fuse_columns(workspace, ["l", "r"], "k", "inner", event_time=TIMES)
    workspace.add("b", _timed(spark, LEFT, "b"))
    workspace.add("c", _timed(spark, LEFT, "c"))
    with pytest.raises(FusionError, match="two datasets"):
        fuse_columns(workspace, ["b", "c", "b"], "k", event_time=TIMES)
    with pytest.raises(FusionError, match="no column"):
        fuse_columns(workspace, ["b", "c"], "k", event_time={**TIMES, "right": "absent"})
    with pytest.raises(SpecError, match="duration"):
        fuse_columns(workspace, ["b", "c"], "k", event_time={**TIMES, "within": "1 day; drop"})


def test_sql_windows_of_a_stream(spark, tmp_path):
    folder = f"{tmp_path}/in"
    for batch in ([0, 30, 70], [200, 65], [10, 400], [12, 1000]):  # 65 and 10 are late, 12 too late
        _write(_timed(spark, [("a", s) for s in batch], "v"), folder)
    workspace = _streams(spark, {"in": folder}, delay="2 minutes")
    text = "SELECT window.start AS since, count(*) AS n FROM view_in GROUP BY window(at, '1 minute')"
    workspace.add("out", run_sql(workspace, text))
    out, _ = _drain(workspace, "out", tmp_path)
    found = {int(r.since.timestamp()): r.n for r in out.collect()}
    assert {k - START: n for k, n in found.items()} == {0: 3, 60: 2, 180: 1, 360: 1}


def _layers(folder, stream):
    name = "events"
    part = "Stream" if stream else "Files"
    source = {"path": folder, "name": name, "format": "parquet"}
    if stream:
        source = {
            "stream_from": "files", "path": folder, "file_format": "parquet", "dataframe_name": name,
            "options": {"maxFilesPerTrigger": "1"},
        }
    target = {"type": "download", "datasets": [name], "conversions": {name: "parquet"}}
    if stream:
        target["trigger"] = "available_now"
    test = process("Filter", source_reference="id", operator=">=", data_reference="40")
    return [
        {"layer_type": "Source", "layer_selection": {part: source if stream else [source]}},
        {"layer_type": "Processor", "layer_selection": {name: [test]}},
        {"layer_type": "Target", "layer_selection": target},
    ]


@pytest.mark.parametrize("stream", [False, True])
def test_layers_are_counted(spark, tmp_path, stream):
    folder = f"{tmp_path}/in"
    spark.range(100).repartition(4).write.parquet(folder)
    result = run_pipeline(
        spark, _layers(folder, stream), f"counted{stream}", f"{tmp_path}/out", f"{tmp_path}/progress",
        count_rows=True,
    )
    result.wait()
    assert [(c.layer, c.layer_type, c.dataset, c.rows) for c in result.counts()] == [
        (0, "Source", "events", 100), (1, "Processor", "events", 60),
    ]
    assert spark.read.parquet(result.paths["events"]).count() == 60


def test_what_no_target_needs_is_not_counted(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/in")
    result = run_pipeline(spark, _layers(f"{tmp_path}/in", False)[:2], count_rows=True)
    assert [c.rows for c in result.counts()] == [None, None]
    with pytest.raises(SpecError, match="count_rows"):
        run_pipeline(spark, _layers(f"{tmp_path}/in", False)[:2]).counts()


def _files(folder):
    return sum(len(names) for _, _, names in os.walk(folder))


def test_the_registry_does_not_grow(spark, tmp_path):
    folder = str(tmp_path / "registry")
    registry = ActiveStreams(spark, folder)
    sizes = []
    for i in range(100):
        event = "start" if i % 3 else "stop"
        registry._note([(f"p{i % 4}", event, '{"layers": [], "places": {}}', i)])
        sizes.append(_files(folder))
    last = {f"p{i % 4}": "start" if i % 3 else "stop" for i in range(100)}
    expected = {name for name, event in last.items() if event == "start"}
    assert set(registry.active()) == expected
    assert max(sizes[COMPACT_AFTER:]) <= max(sizes[:COMPACT_AFTER]) + 8
    again = ActiveStreams(spark, folder)
    assert set(again.active()) == expected and len(again._generations()) == 1


def test_folders_are_removed_when_their_run_ends(spark):
    with removed_after(spark):
        outer = new_folder(spark, "kept")
        spark.range(3).write.parquet(outer)
        with pytest.raises(ZeroDivisionError), removed_after(spark):
            inner = new_folder(spark, "inner")
            spark.range(3).write.parquet(inner)
            assert os.path.isdir(inner)
            raise ZeroDivisionError
        assert os.path.isdir(outer) and not os.path.exists(inner)
        new_folder(spark, "never written")
    assert not os.path.exists(outer)
    remove(spark, outer)

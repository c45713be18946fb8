"""File, link, directory and event sources."""

import pytest
from helpers import column, rows
from pyspark.sql import functions as F

from weftline.errors import SourceError, SpecError
from weftline.sources.decode import decode_json
from weftline.sources.files import FileSpec, discover, read_file
from weftline.sources.importer import import_sources
from weftline.sources.links import parse_links
from weftline.sources.streams import kafka_options
from weftline.workspace import Workspace, dataset_name, view_name


def test_names():
    assert dataset_name("/data/Sales Data.2024.CSV") == "sales_data"
    assert dataset_name("s3a://bucket/a/b.parquet/") == "b"
    assert view_name("My data-set.v1") == "view_my_data_set_v1"


def test_csv_is_all_text_and_free_of_a_byte_order_mark(spark, tmp_path):
    path = tmp_path / "Customer List.csv"
    path.write_bytes('\ufeffid,place\n1,"Oslo, NO"\n2,\n'.encode())
    workspace = Workspace(spark)
    assert import_sources(workspace, {"Files": [{"path": str(path)}]}) == ["customer_list"]
    df = workspace["customer_list"]
    assert df.dtypes == [("id", "string"), ("place", "string")]
    assert rows(df) == {("1", "Oslo, NO"): 1, ("2", None): 1}
    assert workspace.paths == {"customer_list": str(path)}


def test_text_files_need_a_separator(spark, tmp_path):
    path = tmp_path / "sales.txt"
    path.write_text("branch\tsales\nA\t10\nB\t\n")
    df = read_file(spark, FileSpec(str(path), sep="\\t"))
    assert rows(df) == {("A", "10"): 1, ("B", None): 1}
    with pytest.raises(SourceError, match="separator"):
        read_file(spark, FileSpec(str(path)))


def test_unknown_formats_and_missing_files(spark, tmp_path):
    with pytest.raises(SourceError, match="no reader for 'xlsx'"):
        read_file(spark, FileSpec("/data/a.xlsx"))
    with pytest.raises(SourceError):
        import_sources(Workspace(spark), {"Files": [{"path": f"{tmp_path}/none.csv"}]})
    with pytest.raises(SourceError, match="nothing to import"):
        import_sources(Workspace(spark), {"Link": {"source_links": "no links here"}})
    with pytest.raises(SpecError, match="unknown source part"):
        import_sources(Workspace(spark), {"Excel": {}})


def test_links_each_carry_their_separator():
    text = "a https://host/x/A%20b.csv and hdfs://n/p/t.txt?sep=\\t\nfile:/d/u.txt?v=1&sep=;"
    assert parse_links(text) == [
        FileSpec("https://host/x/A%20b.csv"),
        FileSpec("hdfs://n/p/t.txt", sep="\\t"),
        FileSpec("file:/d/u.txt", sep=";"),
    ]


def test_link_import(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x\n1\n")
    (tmp_path / "b.txt").write_text("x|y\n1|2\n")
    workspace = Workspace(spark)
    links = f"file:{tmp_path}/a.csv file:{tmp_path}/b.txt?sep=|"
    assert import_sources(workspace, {"Link": {"source_links": links}}) == ["a", "b"]
    assert workspace["b"].columns == ["x", "y"]


def test_directory_import(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.csv").write_text("x\n1\n")
    (tmp_path / "deep" / "b.json").write_text('{"y": 2}\n')
    (tmp_path / "c.md").write_text("no data")
    workspace = Workspace(spark)
    assert import_sources(workspace, {"Directory": {"path": str(tmp_path)}}) == ["a", "b"]
    assert column(workspace["b"], "y") == [2]
    (tmp_path / "deep" / "a.csv").write_text("x\n1\n")
    with pytest.raises(SourceError, match="several files"):
        discover(spark, str(tmp_path))


SAMPLE = '{"id": 1, "x": 1.5, "tags": ["a"], "at": {"lat": 1.0}}'


def test_decode_keeps_objects_and_nulls_what_is_wrong(either_ansi):
    texts = [
        '{"id": 1, "x": 2.5, "tags": ["p", "q"], "at": {"lat": 3.5}}',
        '{"id": "one", "x": 2}',
        '{"id": 3',
        ' {"id": 4}',
        '[{"id": 5}]',
        "",
        None,
    ]
    df = either_ansi.createDataFrame([(t,) for t in texts], "value string")
    decoded = decode_json(df.withColumn("value", F.col("value").cast("binary")), SAMPLE)
    assert decoded.columns == ["at", "id", "tags", "x"]
    got = [(r.id, r.x, r.tags, r.at and r.at.lat) for r in decoded.collect()]
    assert got == [(1, 2.5, ["p", "q"], 3.5), (None, 2.0, None, None), (None,) * 4]


def test_json_with_a_sample_is_not_scanned_for_a_schema(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"id": 1, "other": 2}\n{"id": 2}\n')
    df = read_file(spark, FileSpec(f"{tmp_path}/e.json", schema_skeleton='{"id": 1}'))
    assert rows(df) == {(1,): 1, (2,): 1}


def test_kafka_options():
    spec = {"stream_from": "kafka", "server_spec": "h:9092", "topic_to_subscribe": "t"}
    assert kafka_options(spec) == {
        "kafka.bootstrap.servers": "h:9092",
        "subscribe": "t",
        "startingOffsets": "earliest",
    }
    limited = kafka_options({**spec, "options": {"maxOffsetsPerTrigger": "1000"}})
    assert limited["maxOffsetsPerTrigger"] == "1000"
    with pytest.raises(SpecError, match="topic_to_subscribe"):
        kafka_options({"server_spec": "h:9092"})


@pytest.mark.parametrize("snapshot", [True, False])
def test_kafka_without_its_connector_is_an_error(spark, snapshot):
    stream = {
        "stream_from": "kafka", "server_spec": "h:9092", "topic_to_subscribe": "t",
        "schema_skeleton": SAMPLE, "dataframe_name": "d", "snapshot": snapshot,
    }
    with pytest.raises(SourceError, match="kafka"):
        import_sources(Workspace(spark), {"Stream": stream})
    with pytest.raises(SourceError, match="unknown stream_from"):
        import_sources(Workspace(spark), {"Stream": {**stream, "stream_from": "socket"}})
    with pytest.raises(SpecError, match="dataframe_name"):
        import_sources(Workspace(spark), {"Stream": {**stream, "dataframe_name": ""}})


def test_snapshot_of_a_file_transport_is_a_batch(spark, tmp_path):
    (tmp_path / "one.txt").write_text('{"id": 1}\nnoise\n{"id": 2}\n')
    stream = {
        "stream_from": "files", "path": str(tmp_path), "schema_skeleton": '{"id": 1}',
        "dataframe_name": "d", "snapshot": True,
    }
    workspace = Workspace(spark)
    import_sources(workspace, {"Stream": [stream]})
    assert not workspace["d"].isStreaming
    assert rows(workspace["d"]) == {(1,): 1, (2,): 1}


def test_cached_imports_can_be_released(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x\n1\n")
    workspace = Workspace(spark, views=True)
    import_sources(workspace, {"Files": [{"path": f"{tmp_path}/a.csv"}]}, cache=True)
    assert workspace["a"].storageLevel.useMemory
    assert spark.table("view_a").count() == 1
    workspace.release()
    assert not workspace["a"].storageLevel.useMemory

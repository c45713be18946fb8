"""Rule operators other than casts and predicates."""

import pytest
from helpers import column, process, rows
from pyspark.sql import functions as F

from weftline.errors import RuleError
from weftline.operators.rules import apply_processes, apply_rule
from weftline.workspace import Workspace


def _apply(df, operation, **data_map):
    return apply_processes(df, [process(operation, **data_map)])


def _drop(df, how, *names):
    return _apply(df, "Drop", drop_by=how, data_reference=list(names))


def _fill_nulls(df, name, **how):
    return _apply(df, "Fill", fill_by="null values", column_name=name, **how)


def _people(spark):
    return spark.createDataFrame(
        [(1, "a", 1.0), (1, "a", 1.0), (2, None, float("nan")), (3, "c", None)],
        "id int, name string, x double",
    )


def test_rename(spark):
    assert _apply(
        _people(spark), "Rename", source_reference="id", data_reference="key"
    ).columns == ["key", "name", "x"]
    same = _apply(_people(spark), "Rename", source_reference="none", data_reference="key")
    assert same.columns == ["id", "name", "x"]


def test_drop_columns(spark):
    assert _drop(_people(spark), "column", "NAME", "absent").columns == ["id", "x"]
    assert _drop(_people(spark), "column", "All").columns == []


def test_drop_nulls(spark):
    df = _people(spark)
    assert column(_drop(df, "null values", "name"), "id") == [1, 1, 3]
    assert column(_drop(df, "null values", "x"), "id") == [1, 1]
    assert column(_drop(df, "null values", "All"), "id") == [1, 1]
    with pytest.raises(RuleError):
        _drop(df, "null values", "absent")


def test_dropping_nulls_reaches_the_scan(spark, tmp_path):
    _people(spark).withColumnRenamed("name", "full.name").write.parquet(f"{tmp_path}/t")
    df = _drop(spark.read.parquet(f"{tmp_path}/t"), "null values", "full.name", "id")
    assert df.count() == 3
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(id)" in plan and "full.name" in plan.split("PushedFilters:")[1]


def test_all_means_the_columns_as_they_are_now(spark):
    df = _people(spark).withColumn("extra", F.lit(None).cast("int"))
    processes = [
        process("Rename", source_reference="name", data_reference="label"),
        process("Drop", drop_by="null values", data_reference=["All"]),
    ]
    assert apply_processes(df, processes).count() == 0


def test_drop_duplicates(spark):
    df = _people(spark)
    assert sorted(column(_drop(df, "duplicates", "All"), "id")) == [1, 2, 3]
    by_null_key = spark.createDataFrame([(None, 1), (None, 2), (1, 3)], "k int, v int")
    assert _drop(by_null_key, "duplicates", "k").count() == 2


def test_drop_needs_columns_and_a_known_kind(spark):
    with pytest.raises(RuleError, match="names no column"):
        _drop(_people(spark), "column")
    with pytest.raises(RuleError, match="unknown drop_by"):
        _drop(_people(spark), "rows", "id")


def test_fill_constant(spark):
    df = _apply(_people(spark), "Fill", fill_by="column", column_name="NAME", data_reference="z")
    assert df.columns == ["id", "name", "x"] and set(column(df, "name")) == {"z"}
    df = _apply(_people(spark), "Fill", fill_by="column", column_name="tag", data_reference="")
    assert set(column(df, "tag")) == {""}


def _fill_where(df, name, value, source, op, compared):
    return _apply(
        df, "Fill", fill_by="column", column_name=name, data_reference=value, apply_filter=True,
        fill_filter_source_reference=source, operator=op, fill_filter_data_reference=compared,
    )


def test_conditional_fill(either_ansi):
    df = _people(either_ansi)
    assert column(_fill_where(df, "tier", "low", "id", "<", "2"), "tier") == [
        "low", "low", None, None
    ]
    kept = _fill_where(df, "Name", "z", "name", "==", "a")
    assert column(kept, "name") == ["z", "z", None, "c"]


@pytest.mark.parametrize("value", ["hi", "7"])
def test_conditional_fill_of_a_number_gives_text(either_ansi, value):
    df = _fill_where(_people(either_ansi), "id", value, "name", "==", "a")
    assert dict(df.dtypes)["id"] == "string"
    assert column(df, "id") == [value, value, "2", "3"]


def test_fill_nulls_with_constants(either_ansi):
    df = either_ansi.createDataFrame(
        [(None, None, None, float("nan")), (1, "a", True, 2.0)],
        "n int, s string, b boolean, x double",
    )
    assert column(_fill_nulls(df, "n", data_reference="4.9"), "n") == [4, 1]
    assert column(_fill_nulls(df, "n", data_reference="abc"), "n") == [None, 1]
    assert column(_fill_nulls(df, "s", data_reference="abc"), "s") == ["abc", "a"]
    assert column(_fill_nulls(df, "b", data_reference="false"), "b") == [False, True]
    assert column(_fill_nulls(df, "x", data_reference="-1"), "x") == [-1.0, 2.0]
    wins = _fill_nulls(df, "n", fill_condition="mean", data_reference="9")
    assert column(wins, "n") == [9, 1]


def test_fill_nulls_with_statistics(either_ansi):
    df = either_ansi.createDataFrame(
        [(1, "1", 1.0), (2, "2", 2.0), (12, "junk", 6.0), (None, None, None)],
        "n int, s string, x double",
    )
    assert column(_fill_nulls(df, "n", fill_condition="mean"), "n")[3] == 5
    assert column(_fill_nulls(df, "s", fill_condition="mean"), "s")[3] == "1.5"
    assert column(_fill_nulls(df, "x", fill_condition="mean"), "x")[3] == 3.0
    assert column(_fill_nulls(df, "n", fill_condition="median"), "n")[3] == 2
    assert column(_fill_nulls(df, "s", fill_condition="median"), "s")[3] == "1.0"
    deviation = column(_fill_nulls(df, "x", fill_condition="standard deviation"), "x")[3]
    assert deviation == pytest.approx(2.6457513)
    kinds = dict(_fill_nulls(df, "n", fill_condition="mean").dtypes)
    assert kinds["n"] == "int"


def test_statistic_of_nothing_changes_nothing(either_ansi):
    df = either_ansi.createDataFrame([(None,), (None,)], "x double")
    for condition in ("mean", "median", "standard deviation"):
        assert column(_fill_nulls(df, "x", fill_condition=condition), "x") == [None, None]


def test_statistic_of_a_type_without_one(spark):
    df = spark.createDataFrame([([1],)], "a array<int>")
    with pytest.raises(RuleError, match="no statistic"):
        _fill_nulls(df, "a", fill_condition="mean")


def test_neighbouring_statistics_share_one_scan(spark, tmp_path):
    _people(spark).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    processes = [
        process("Fill", fill_by="null values", column_name=c, fill_condition="mean")
        for c in ("x", "id")
    ]
    filled = apply_processes(df, processes)
    plan = filled._jdf.queryExecution().executedPlan().toString()
    assert "mergedValue" in plan and "NestedLoop" not in plan


def test_explode(spark):
    df = spark.sql("SELECT * FROM VALUES (1, array(7, 8)), (2, array()), (3, null) AS t(id, a)")
    assert rows(_apply(df, "Explode", new_column_name="e", data_reference="a").drop("a")) == {
        (1, 7): 1, (1, 8): 1
    }
    same = _apply(df, "Explode", new_column_name="a", data_reference="a")
    assert rows(same) == {(1, 7): 1, (1, 8): 1}
    nested = spark.sql("SELECT named_struct('a', array(1, 2)) AS s")
    assert column(_apply(nested, "Explode", new_column_name="e", data_reference="s.a"), "e") == [
        1, 2
    ]
    with pytest.raises(RuleError, match="not an array"):
        _apply(spark.sql("SELECT map(1, 2) AS m"), "Explode", new_column_name="e",
               data_reference="m")


def test_flatten(spark):
    df = spark.sql(
        "SELECT named_struct('a', named_struct('b', 5)) AS s,"
        " array(named_struct('b', 1), named_struct('b', 2)) AS l"
        " UNION ALL SELECT null, null"
    )
    assert column(_apply(df, "Flatten", new_column_name="b", data_reference="s.a.b"), "b") == [
        5, None
    ]
    assert column(_apply(df, "Flatten", new_column_name="b", data_reference="l.b"), "b") == [
        [1, 2], None
    ]
    with pytest.raises(RuleError):
        _apply(df, "Flatten", new_column_name="b", data_reference="s.nothing")


def _workspace(spark, views=False):
    workspace = Workspace(spark, views=views)
    workspace.add("people", _people(spark))
    return workspace


def _only(value):
    return process("Filter", source_reference="id", operator="==", data_reference=value)


def test_layers_build_on_each_other_unless_reset(spark):
    workspace = _workspace(spark)
    apply_rule(workspace, {"people": [_only("1")]})
    apply_rule(workspace, {"people": [_only("2")]})
    assert workspace["people"].count() == 0
    apply_rule(workspace, {"people": [_only("2")]}, reset=True)
    assert workspace["people"].count() == 1
    assert workspace.reset("people").count() == 4


def test_saved_datasets_can_be_ruled_reset_and_queried(spark):
    workspace = _workspace(spark, views=True)
    apply_rule(workspace, {"people": [_only("1"), process("Save", save_as="My-Ones")]})
    apply_rule(workspace, {"My-Ones": [_only("2")]}, reset=True)
    assert workspace["My-Ones"].count() == 0
    assert workspace.reset("My-Ones").count() == 2
    assert spark.sql("SELECT * FROM view_my_ones").count() == 2


def test_save_keeps_the_first_holder_of_a_name(spark):
    workspace = _workspace(spark)
    save = process("Save", save_as="kept")
    apply_rule(workspace, {"people": [save, _only("3"), save]})
    assert workspace["kept"].count() == 4
    apply_rule(workspace, {"people": [process("Save", save_as="kept", overwrite=True)]})
    assert workspace["kept"].count() == 1


def test_save_can_write_the_snapshot(spark):
    workspace = _workspace(spark)
    apply_rule(workspace, {"people": [process("Save", save_as="kept", materialize=True)]})
    assert rows(workspace["kept"]) == rows(_people(spark))
    assert len(workspace["kept"].inputFiles()) > 0


def test_errors_name_the_process(spark):
    workspace = _workspace(spark)
    with pytest.raises(RuleError, match=r"people\[1\] Cast: empty data_map"):
        apply_rule(workspace, {"people": [_only("1"), {"operation": "Cast", "data_map": {}}]})
    with pytest.raises(RuleError, match="unknown operation"):
        apply_rule(workspace, {"people": [process("Pivot", a=1)]})
    with pytest.raises(RuleError, match="no dataset 'nobody'"):
        apply_rule(workspace, {"nobody": [_only("1")]})

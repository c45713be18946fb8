"""Joins and unions of named datasets."""

import pytest
from helpers import rows

from weftline.errors import FusionError, SpecError
from weftline.operators.fusion import fusable_columns, run_fusion
from weftline.workspace import Workspace


@pytest.fixture
def workspace(spark):
    workspace = Workspace(spark)
    workspace.add(
        "left", spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, l string")
    )
    workspace.add(
        "right", spark.createDataFrame([(2, "x"), (3, "y"), (None, "m")], "k int, r string")
    )
    return workspace


def _fuse(workspace, *datasets, **step):
    step = {"datasets_to_fuse": list(datasets), "fuse_by": "column", **step}
    return workspace[run_fusion(workspace, [step])[0]]


INNER = {(2, "b", "x"): 1}
LEFT_ONLY = {(1, "a", None): 1, (None, "n", None): 1}
RIGHT_ONLY = {(3, None, "y"): 1, (None, None, "m"): 1}


@pytest.mark.parametrize(
    "how, expected",
    [
        (None, INNER),
        ("inner", INNER),
        ("left", INNER | LEFT_ONLY),
        ("right", INNER | RIGHT_ONLY),
        ("outer", INNER | LEFT_ONLY | RIGHT_ONLY),
    ],
)
@pytest.mark.parametrize("skew", ["salt", "adaptive"])
def test_join_types(workspace, how, expected, skew):
    df = _fuse(workspace, "left", "right", fuse_on="k", fuse_how=how, skew=skew)
    assert df.columns == ["k", "l", "r"]
    assert rows(df) == expected


def test_three_inputs_and_default_name(workspace, spark):
    workspace.add("third.csv", spark.createDataFrame([(2, 9), (2, 8)], "k int, t int"))
    names = run_fusion(
        workspace,
        [{"datasets_to_fuse": ["left", "right", "third.csv"], "fuse_by": "column",
          "fuse_on": "k"}],
    )
    assert names == ["left_right_third.csv"]
    assert rows(workspace[names[0]]) == {(2, "b", "x", 9): 1, (2, "b", "x", 8): 1}


def test_several_keys(spark):
    workspace = Workspace(spark)
    workspace.add("a", spark.createDataFrame([(1, 1, "p"), (1, 2, "q")], "x int, y int, p string"))
    workspace.add("b", spark.createDataFrame([(1, 2, "r")], "x int, y int, q string"))
    assert rows(_fuse(workspace, "a", "b", fuse_on=["x", "y"])) == {(1, 2, "q", "r"): 1}


def test_same_named_columns_get_a_suffix(spark):
    workspace = Workspace(spark)
    for name, value in (("a", "p"), ("b", "q"), ("c", "r")):
        workspace.add(name, spark.createDataFrame([(1, value)], "K int, v string"))
    df = _fuse(workspace, "a", "b", "c", fuse_on="k")
    assert df.columns == ["k", "v", "v_b", "v_c"]
    assert rows(df) == {(1, "p", "q", "r"): 1}


def test_steps_run_in_order(workspace, spark):
    workspace.add("more", spark.createDataFrame([(7, "z")], "k int, l string"))
    steps = [
        {"fused_dataset_name": "all", "datasets_to_fuse": ["left", "more"], "fuse_by": "row"},
        {"fused_dataset_name": "out", "datasets_to_fuse": ["all", "right"],
         "fuse_by": "column", "fuse_on": "k"},
    ]
    assert run_fusion(workspace, steps) == ["all", "out"]
    assert rows(workspace["out"]) == INNER
    assert workspace.reset("all").count() == 4


MIXED = {
    "inner": {("05", "a", "x"): 1},
    "left": {("05", "a", "x"): 1, ("junk", "b", None): 1},
    "right": {(5, "a", "x"): 1, (6, None, "y"): 1},
    "outer": {("05", "a", "x"): 1, ("junk", "b", None): 1, ("6", None, "y"): 1},
}


@pytest.mark.parametrize("how", MIXED)
def test_text_key_against_number_key(either_ansi, how):
    workspace = Workspace(either_ansi)
    texts = either_ansi.createDataFrame([("05", "a"), ("junk", "b")], "k string, l string")
    workspace.add("texts", texts)
    workspace.add("numbers", either_ansi.createDataFrame([(5, "x"), (6, "y")], "k int, r string"))
    df = _fuse(workspace, "texts", "numbers", fuse_on="k", fuse_how=how)
    assert df.columns == ["k", "l", "r"]
    assert rows(df) == MIXED[how]


@pytest.mark.parametrize("how", MIXED)
@pytest.mark.parametrize("hot_rows", [1, 1_000_000])
def test_text_and_number_keys_of_three_inputs(spark, how, hot_rows):
    workspace = Workspace(spark)
    texts = spark.createDataFrame([("05", "a"), ("5", "b"), ("junk", "c")], "k string, l string")
    workspace.add("texts", texts)
    workspace.add("numbers", spark.createDataFrame([(5, "x"), (6, "y")], "k int, r string"))
    workspace.add("more", spark.createDataFrame([("5", 1), ("5.0", 2)], "k string, m int"))
    df = _fuse(
        workspace, "texts", "numbers", "more", fuse_on="k", fuse_how=how, hot_rows=hot_rows
    )
    assert df.columns == ["k", "l", "r", "m"]
    matched = {(t, l, "x", m) for t, l in (("05", "a"), ("5", "b")) for m in (1, 2)}
    left_only, right_only = {("junk", "c", None, None)}, {("6", None, "y", None)}
    if how == "right":
        matched = {("5" if m == 1 else "5.0", l, "x", m) for _, l, _, m in matched}
        left_only = right_only = set()
    if how == "inner":
        left_only = right_only = set()
    if how == "left":
        right_only = set()
    assert rows(df) == {row: 1 for row in matched | left_only | right_only}


def test_refused_joins(workspace):
    with pytest.raises(FusionError, match="Cartesian"):
        _fuse(workspace, "left", "right")
    with pytest.raises(FusionError, match="unknown fuse_how"):
        _fuse(workspace, "left", "right", fuse_on="k", fuse_how="cross")
    with pytest.raises(FusionError, match="no column 'z'"):
        _fuse(workspace, "left", "right", fuse_on="z")
    with pytest.raises(SpecError):
        run_fusion(workspace, [{"fuse_by": "row"}])


def test_union_is_positional_and_keeps_duplicates(workspace):
    df = _fuse(workspace, "left", "left", "right", fuse_by="row")
    assert df.columns == ["k", "l"]
    assert rows(df)[(1, "a")] == 2 and rows(df)[(3, "y")] == 1


def test_union_of_mixed_types(either_ansi):
    workspace = Workspace(either_ansi)
    workspace.add("a", either_ansi.createDataFrame([(1, 1)], "x int, y int"))
    workspace.add("b", either_ansi.createDataFrame([("q", 2.5)], "x string, y double"))
    df = _fuse(workspace, "a", "b", fuse_by="row")
    assert df.dtypes == [("x", "string"), ("y", "double")]
    assert rows(df) == {("1", 1.0): 1, ("q", 2.5): 1}


def test_union_needs_equal_widths(workspace, spark):
    workspace.add("wide", spark.createDataFrame([(1, 2, 3)], "a int, b int, c int"))
    with pytest.raises(FusionError, match="equal column counts"):
        _fuse(workspace, "left", "wide", fuse_by="row")


def test_fusable_columns(spark):
    workspace = Workspace(spark)
    workspace.add("a", spark.createDataFrame([], "z int, x int, y string"))
    workspace.add("b", spark.createDataFrame([], "y string, z int, x long"))
    assert fusable_columns(workspace, ["a", "b"]) == ["z", "y"]
    assert fusable_columns(workspace, ["a"]) == ["z", "x", "y"]


@pytest.mark.parametrize("how", ["inner", "left", "outer"])
@pytest.mark.parametrize("hot_rows", [1, 1_000_000])
def test_a_dataset_joined_with_itself(spark, how, hot_rows):
    workspace = Workspace(spark)
    workspace.add("a", spark.createDataFrame([(1, "p"), (1, "q"), (2, "r")], "k int, v string"))
    workspace.save("b", workspace["a"])
    df = _fuse(workspace, "a", "b", fuse_on="k", fuse_how=how, hot_rows=hot_rows)
    pairs = [(1, x, y) for x in "pq" for y in "pq"] + [(2, "r", "r")]
    assert df.columns == ["k", "v", "v_b"]
    assert rows(df) == {pair: 1 for pair in pairs}

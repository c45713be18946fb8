"""JSON is parsed for the fields that the next rules use."""

import json

import pytest
from helpers import process, rows
from pyspark.sql import functions as F

from weftline.errors import RuleError
from weftline.operators.demand import needed_paths
from weftline.operators.rules import apply_processes
from weftline.plans.pipeline import run_pipeline
from weftline.sources.decode import decode_json

SAMPLE = {
    "id": 1, "Name": "x", "extra": {"deep": {"a": 1, "b": "t"}, "c": 2.5},
    "items": [{"sku": "s", "price": {"net": 1.0, "tax": 0.1}, "tags": ["u"]}], "other": "o",
}


def _explode(path, name):
    return process("Explode", data_reference=path, new_column_name=name)


def _flatten(path, name):
    return process("Flatten", data_reference=path, new_column_name=name)


def _drop(how, *names):
    return process("Drop", drop_by=how, data_reference=list(names))


KEEP_ID = _drop("column", "name", "extra", "items", "other")

RULES = [
    ([KEEP_ID], "id"),
    ([_flatten("items.sku", "skus"), _explode("skus", "sku"), _drop("column", "skus"), KEEP_ID], "id sku"),
    ([_explode("items", "item"), _flatten("item.price.net", "net"), _drop("column", "item"), KEEP_ID],
     "id price net"),
    ([_explode("items", "item"), _drop("column", "items", "extra", "name", "other")],
     "id sku price net tax tags"),
    ([process("Filter", source_reference="extra.deep.a", operator=">", data_reference="1"), KEEP_ID],
     "id deep a"),
    ([process("Rename", source_reference="other", data_reference="mine"), KEEP_ID], "id other"),
    ([process("Cast", column_to_cast="NAME", cast_type="string"), KEEP_ID], "id name"),
    ([_drop("null values", "other"), KEEP_ID], "id other"),
    ([process("Fill", fill_by="column", column_name="tier", data_reference="hi", apply_filter=True,
              fill_filter_source_reference="extra.c", operator="<", fill_filter_data_reference="2"),
      KEEP_ID], "id c"),
    ([process("Fill", fill_by="null values", column_name="name", data_reference="none"), KEEP_ID], "id name"),
]
WHOLE = [
    [_drop("duplicates", "All"), KEEP_ID],
    [process("Save", save_as="copy"), KEEP_ID],
    [process("Fill", fill_by="null values", column_name="id", fill_condition="median"), KEEP_ID],
    [_flatten("items[0].sku", "first"), KEEP_ID],
    [],
]


@pytest.fixture(scope="module")
def lines(spark):
    documents = []
    for i in range(8):
        document = json.loads(json.dumps(SAMPLE))
        document.update(id=i, other=None if i == 3 else "o")
        document["extra"]["deep"]["a"] = i
        document["items"] *= i % 3
        documents.append(json.dumps(document))
    documents += ['{"id": "not a number", "other": 5}', '{"id": 9, "items": ', "no json", "", None, "[1]"]
    return spark.createDataFrame([(d,) for d in documents], "value string")


def _parsed(df):
    plan = df._jdf.queryExecution().analyzed().toString()
    return plan[plan.index("from_json(") :].split(", value")[0].lower()


@pytest.mark.parametrize("rules, names", RULES, ids=[names for _, names in RULES])
def test_only_used_fields_are_parsed(lines, rules, names):
    whole = decode_json(lines, json.dumps(SAMPLE))
    cut = decode_json(lines, json.dumps(SAMPLE), rules=rules)
    schema = json.dumps(cut.schema.jsonValue()).lower()
    every = {"id", "name", "extra", "deep", "a", "b", "c", "items", "sku", "price", "net", "tax", "tags", "other"}
    read = {n for n in every if f'"name": "{n}"' in schema}
    assert read - {"items", "extra"} == set(names.split()) - {"tier"}
    got, want = (apply_processes(df, rules).select(F.to_json(F.struct("*"))) for df in (cut, whole))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("rules", WHOLE)
def test_everything_is_parsed_where_everything_is_used(lines, rules):
    cut = decode_json(lines, json.dumps(SAMPLE), rules=rules)
    assert cut.schema == decode_json(lines, json.dumps(SAMPLE)).schema
    assert needed_paths(cut, rules) is None or not rules


def test_a_missing_field_is_reported_as_before(lines):
    rules = [_flatten("extra.absent", "x"), KEEP_ID]
    with pytest.raises(RuleError):
        apply_processes(decode_json(lines, json.dumps(SAMPLE)), rules)
    with pytest.raises(RuleError):
        apply_processes(decode_json(lines, json.dumps(SAMPLE), rules=rules), rules)


@pytest.mark.parametrize("reset", [False, True])
def test_pipelines_parse_what_their_rules_use(spark, lines, tmp_path, reset):
    lines.where("value IS NOT NULL").write.text(f"{tmp_path}/in")
    source = {"Files": [{
        "path": f"{tmp_path}/in", "name": "docs", "format": "json", "schema_skeleton": json.dumps(SAMPLE),
    }]}
    layers = [
        {"layer_type": "Source", "layer_selection": source},
        {"layer_type": "Processor", "layer_selection": {"docs": [_flatten("extra.c", "c")]}},
        {"layer_type": "Processor", "layer_selection": {"docs": [KEEP_ID]}, "reset": reset},
    ]
    result = run_pipeline(spark, layers)
    assert result["docs"].columns == (["id"] if reset else ["id", "c"])
    assert ("sku" in _parsed(result["docs"])) == reset
    assert result["docs"].agg(F.count("*")).first()[0] == 10

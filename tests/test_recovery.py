"""Fields of damaged JSON answers: cut anywhere, loose syntax, envelopes, prose."""

import json

import pytest
from pyspark.sql import functions as F

from briefwell.functions.recovery import recovered, recovered_fields

WHOLE = {"id": 7, "lane": "Society & Culture", "notes": ["a, b", {"x": [], "y": {}}, -1.5e3, None], "ok": True, "said": 'he said "no", twice\n{"z": 1}', "last": {"k": [1, 2]}}


def values(text):
    fields, lost = recovered_fields(text)
    return {k: json.loads(v) for k, v in fields.items()}, lost


@pytest.mark.parametrize("indent", [None, 2])
def test_an_object_cut_anywhere_keeps_its_complete_fields(indent):
    text = json.dumps(WHOLE, indent=indent)
    assert values(text) == (WHOLE, [])
    names = list(WHOLE)
    for at in range(len(text)):
        found, lost = values(text[:at])
        assert list(found) == names[: len(found)] and all(WHOLE[k] == v for k, v in found.items()), at
        assert len(lost) <= 1 and (not lost or lost[0] not in found)
    assert len(values(text[:-1])[0]) == len(names)  # only the last bracket is gone


CASES = [
    ("{id: 1, 'lane': 'x', “say”： “yes”， done: True, none: None,}", {"id": 1, "lane": "x", "say": "yes", "done": True, "none": None}, []),
    ('Sure!\n```json\n{"a": 1\n"b": [1, 2,], "c": high\n}\n```', {"a": 1, "b": [1, 2], "c": "high"}, []),
    ('{"a": , "b": 2, "c": [1, }, "d": 4}', {"b": 2, "d": 4}, ["a", "c"]),
    ('{"a": "x "quoted" y", "b": "\\u00e9\\n\\q"}', {"a": 'x "quoted" y', "b": "é\nq"}, []),
    ('{"a": 1, "a": 2}', {"a": 2}, []),
    ('{"a": {"b": 1], "c": 3}', {"c": 3}, ["a"]),
    ('{"n": 12', {}, ["n"]),
    ("{}", {}, []),
    ("no object: here", {}, []),
    ("", {}, []),
    (None, {}, []),
    (json.dumps({"output_text": '{"a": 1}'}), {"a": 1}, []),
    (json.dumps({"output": [{"content": [{"text": '{"a": 1,'}, {"output_text": '"b": 2}'}]}, {"content": None}, 3]}), {"a": 1, "b": 2}, []),
]


@pytest.mark.parametrize("text, found, lost", CASES)
def test_damaged_answers(text, found, lost):
    assert values(text) == (found, lost)


def test_deep_and_long_answers():
    deep = '{"a": ' + "[" * 60_000 + "]" * 60_000 + ', "b": "' + "x" * 200_000 + '"}'
    fields, lost = recovered_fields('{"c": 1, "a": ' + "[" * 50_000)
    assert fields == {"c": "1"} and lost == ["a"]
    assert recovered_fields(deep)[1] == ["a"]  # read whole, but too deep to be written
    found, lost = recovered_fields(deep.replace("[" * 60_000, "[" * 50).replace("]" * 60_000, "]" * 50))
    assert set(found) == {"a", "b"} and len(json.loads(found["b"])) == 200_000


def test_recovered_column(spark):
    rows = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(CASES)], "k int, t string")
    got = {r.k: (r.r.fields, r.r.lost) for r in rows.select("k", recovered(F.col("t")).alias("r")).collect()}
    assert got == {k: recovered_fields(t) for k, (t, _, _) in enumerate(CASES)}
    assert rows.filter("k < 0").select(recovered(F.col("t"))).collect() == []

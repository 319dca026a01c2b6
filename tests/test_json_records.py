"""JSON lines with changing fields: parsed once, every record kept or named as bad."""

import json

import pytest
from conftest import plan_of, rows
from pyspark.sql import functions as F

from supplypanel.session import settle
from supplypanel.sources.json_records import (
    BAD_RECORD,
    field_names,
    json_fields,
    json_records,
    typed_records,
)

LINES = [
    '{"a_Cnt": 7, "b": "x", "z": {"q": [1, 2]}}',
    "",
    '{"a_Cnt": "7.0"}',
    '{"a_Cnt": 7.0, "b": null, "e.f": 1.5}',
    "[1]",
    '{"broken',
    '{"a_Cnt": 1, "a_Cnt": 2}',
    "{}",
    '{"a_Cnt": "*", "b": "n/a"}',
]


@pytest.fixture
def records(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join(LINES) + "\n")
    return settle(json_records(spark, str(tmp_path)), "records")


def test_records_are_whole_or_bad(records):
    bad = records.where("record is null")
    assert sorted(r[BAD_RECORD] for r in bad.collect()) == sorted([LINES[4], LINES[5], LINES[6]])
    assert records.where(F.col(BAD_RECORD).isNull()).count() == 5


def test_fields_and_kinds(records):
    found = {(r.field, r.kind): r.records for r in json_fields(records).collect()}
    assert found["a_Cnt", "STRING"] == 2 and found["b", "VOID"] == 1 and found["b", "STRING"] == 2
    assert found["z", "OBJECT<q: ARRAY<BIGINT>>"] == 1
    assert sum(n for (field, _), n in found.items() if field == "a_Cnt") == 4
    assert field_names(records) == ["a_Cnt", "b", "e.f", "z"]


def test_values_are_typed_by_name(records):
    out = rows(typed_records(records, ["a_Cnt", "b", "e.f", "z", "gone"]))
    assert sorted(out, key=repr) == sorted(
        [
            (7, "x", None, '{"q":[1,2]}', None),
            (7, None, None, None, None),
            (7, None, "1.5", None, None),
            (None, None, None, None, None),
            (None, None, None, None, None),
        ],
        key=repr,
    )
    typed = typed_records(records, ["e.f"], {"e.f": "double"})
    assert typed.dtypes == [("e.f", "double")] and (1.5,) in rows(typed)
    with pytest.raises(ValueError):
        typed_records(records, ['a"b'])


def test_text_is_scanned_once(spark, tmp_path):
    lines = [json.dumps({f"f{i % 7}_Cnt": i, "k": str(i)}) for i in range(500)]
    (tmp_path / "a.json").write_text("\n".join(lines) + "\n")
    parsed = json_records(spark, str(tmp_path))
    assert plan_of(parsed).count("FileScan text") == 1
    stored = settle(parsed, "records")
    names = field_names(stored)
    assert names == [*sorted(f"f{i}_Cnt" for i in range(7)), "k"]
    out = typed_records(stored, names)
    assert "FileScan text" not in plan_of(out) and "FileScan json" not in plan_of(out)
    assert out.agg(*[F.count(c) for c in names]).first()[-1] == 500


def test_no_records(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n\n")
    none = settle(json_records(spark, str(tmp_path)), "records")
    assert rows(none) == [] and field_names(none) == []
    assert rows(typed_records(none, ["a_Cnt"])) == []

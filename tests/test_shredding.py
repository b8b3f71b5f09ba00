import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioframe.operators import shredding as sh

SCHEMA = "record_id bigint, payload string, received_at timestamp, rid string, columns int"


def found(record):
    return sorted(sh.children(sh.shred(sh.canonical(record))), key=str)


def plain(record):
    """Children by direct recursion."""
    c = sh.canonical(record)
    out = []
    for p, page in enumerate(c["pages"]):
        out += [("box", p, i, b["label"] or "unknown") for i, b in enumerate(page["boxes"]) if b["x1"] is not None]
    for m, msg in enumerate(c["messages"]):
        if msg is not None:
            out.append(("message", m, 0, msg["role"]))
            out += [("part", m, i, x["kind"]) for i, x in enumerate(msg["parts"]) if x["kind"] is not None]
    return sorted(out, key=str)


@pytest.mark.parametrize(
    "x, box",
    [
        ([1, 2, 3, 4], [1, 2, 3, 4]), (["1", "2", "3", "4"], [1, 2, 3, 4]), ("1, 2, 3, 4", [1, 2, 3, 4]), ({"x1": 1, "y1": 2, "x2": 3, "y2": 4}, [1, 2, 3, 4]),
        ({"bbox": [1, 2, 3, 4]}, [1, 2, 3, 4]), ({"coordinates": "1 2 3 4"}, [1, 2, 3, 4]), ([1.5, 2, 3, 4], [1.5, 2, 3, 4]),
        ([1, 2, 3], None), ([None] * 4, None), ("n/a", None), ([], None), ([True, 1, 2, 3], None), (None, None), ({}, None), ("1, 2, 3", None),
    ],
)
def test_boxes_however_written(x, box):
    assert sh.as_box(x) == box


def test_positions_are_kept_and_labels_follow():
    rec = {"bbox": [[[1, 2, 3, 4], None, {"box": [1, 2, 3, 4]}], [5, 6, 7, 8], [], "1, 2, 3, 4"], "subimg_type": [["Table", "x", " Image "], "TEXT"]}
    assert found(rec) == sorted([("box", 0, 0, "table"), ("box", 0, 2, "image"), ("box", 1, 0, "text"), ("box", 3, 0, "unknown")], key=str)


def test_one_box_and_one_message():
    rec = {"evidence": {"bbox": [1, 2, 3, 4], "subimg_type": "Table"}, "messages": {"from": "human", "value": "hi"}}
    assert found(rec) == sorted([("box", 0, 0, "table"), ("message", 0, 0, "human"), ("part", 0, 0, "text")], key=str)


def test_levels_of_nested_lists():
    path, rep, dfn, _ = sh.shred(sh.canonical({"bbox": [[[1, 2, 3, 4], [1]], [], [[5, 6, 7, 8]]]}))[0]
    assert (path, rep, dfn) == ("pages.boxes.x1", [0, 2, 1, 1], [3, 2, 1, 3])
    assert sh.positions(rep, 2) == [(0, 0), (0, 1), (1, 0), (2, 0)]


coordinates = st.one_of(st.integers(0, 9), st.none(), st.text("0123456789, ", max_size=6))
entries = st.one_of(st.none(), st.lists(coordinates, max_size=5), st.fixed_dictionaries({"bbox": st.lists(st.integers(0, 9), max_size=4)}), st.just("1, 2, 3, 4"))
pages = st.lists(st.one_of(entries, st.lists(entries, max_size=3)), max_size=4)
messages = st.lists(st.one_of(st.none(), st.fixed_dictionaries({}, optional={"role": st.sampled_from(["user", None]), "content": st.one_of(st.none(), st.text(max_size=3), st.lists(st.one_of(st.none(), st.text(max_size=2), st.just({"type": "image"})), max_size=3))})), max_size=3)


@settings(max_examples=200, deadline=None)
@given(st.fixed_dictionaries({}, optional={"bbox": st.one_of(st.none(), pages), "messages": st.one_of(st.none(), messages), "subimg_type": st.one_of(st.none(), st.lists(st.one_of(st.text("ab ", max_size=2), st.lists(st.text("ab ", max_size=2), max_size=2)), max_size=3))}))
def test_rebuilt_from_levels_equals_recursion(rec):
    assert found(rec) == plain(rec)


def test_redelivered_and_unreadable_records(spark):
    a = json.dumps({"bbox": [[[1, 2, 3, 4]]]})
    rows = [
        (1, a, None, "x", 0), (1, a, None, "x", 0), (1, '{"bbox": [[[1, 2', None, "y", 1), (2, None, None, None, None), (3, "", None, None, None),
        (4, "[1]", None, None, None), (None, a, None, None, None), (5, json.dumps({"bbox": [[[1, 2, 3, 4]] * 3000]}), None, None, None), (6, "null", None, None, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sh.payload_children(df).groupBy("record_id").count().collect()
    assert {r["record_id"]: r["count"] for r in got} == {1: 1, 5: 3000}


def test_last_readable_delivery_counts(spark):
    old, new = json.dumps({"bbox": [[[1, 2, 3, 4]], [[1, 2, 3, 4]]]}), json.dumps({"bbox": [[[1, 2, 3, 4]]]})
    df = spark.sql(f"select 1L record_id, '{new}' payload, timestamp'2025-01-02' received_at union all select 1L, '{old}', timestamp'2025-01-01' union all select 1L, '{{', timestamp'2025-01-03'")
    assert sh.payload_children(df).count() == 1


def test_empty_table(spark):
    assert sh.payload_children(spark.createDataFrame([], SCHEMA)).count() == 0


def test_values_come_out_with_their_positions(spark):
    rec = {"bbox": [[[1, 2, 3, 4.5], None], [[5, 6, 7, 8]]], "subimg_type": "Table", "messages": [{"role": "user", "content": [{"type": "text", "text": "look"}, {"type": "image", "image": "p.png"}]}, None, {"role": "assistant", "content": "done"}]}
    df = spark.createDataFrame([(1, json.dumps(rec), None, "x", 0)], SCHEMA)
    t = {k: sorted(map(tuple, v.collect()), key=str) for k, v in sh.payload_tables(df).items()}
    assert t["box"] == [(1, 0, 0, 1.0, 2.0, 3.0, 4.5, "table"), (1, 1, 0, 5.0, 6.0, 7.0, 8.0, "table")]
    assert t["message"] == [(1, 0, "user"), (1, 2, "assistant")]
    assert t["part"] == [(1, 0, 0, "text", "look", None), (1, 0, 1, "image", None, "p.png"), (1, 2, 0, "text", "done", None)]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
@pytest.mark.parametrize("early, late", [("2025-01-01 00:00:00.000100", "2025-01-01 00:00:00.000900"), ("2025-10-26 02:10:00", "2025-10-26 02:50:00")])
def test_the_later_of_two_close_deliveries_wins(spark, kind, early, late):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        for k in range(4):  # whatever the hashes of the payloads
            old, new = json.dumps({"bbox": [[[1, 2, 3, 4]] * 2], "k": k}), json.dumps({"bbox": [[[1, 2, 3, 4]]], "k": k})
            df = spark.sql(f"select 1L record_id, '{new}' payload, {kind}'{late}' received_at union all select 1L, '{old}', {kind}'{early}'")
            assert sh.payload_children(df).count() == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_typed_columns_equal_shredded_text(spark):
    rows = [
        (1, [[[1, 2, 3, 4], [1, 2], None, [1, None, 3, 4]], None, []], [[" Table "], None], [("user", "a"), None, (None, None)], 1),
        (1, [[[9, 9, 9, 9]]], None, [("user", "older")], 0), (2, None, None, None, 1), (3, [[[1, 2, 3, 4]]], [[]], [], None), (None, [[[1, 2, 3, 4]]], None, None, 1),
    ]
    df = spark.createDataFrame(rows, "sample_id bigint, bbox array<array<array<bigint>>>, subimg_type array<array<string>>, messages array<struct<role:string,content:string>>, ingested_at int")
    nested = sh.F.to_json(sh.F.struct("bbox", "subimg_type", "messages"))
    text = df.select(sh.F.col("sample_id").alias("record_id"), nested.alias("payload"), sh.F.col("ingested_at").alias("received_at"))
    assert sorted(map(tuple, sh.typed_children(df, "sample_id", "ingested_at").collect())) == sorted(map(tuple, sh.payload_children(text).collect()))

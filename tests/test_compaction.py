import datetime as dt
import json
import random

import pytest

from folioframe.operators import compaction as cp

SCHEMA = "file_id bigint, file_path string, file_kind string, doc_name string, page bigint, size_bytes bigint, modified_at timestamp, content string, body int, pos int"


def rec(i, keep=True):
    return {"image": f"crops/{i}_final_001.png", "keep": keep, "type": "text"}


@pytest.mark.parametrize(
    "content, n",
    [
        (None, 0), ("", 0), (" \n", 0), ("[]", 0), (json.dumps(rec(1)), 1), (json.dumps([rec(1), rec(2)], indent=2), 2), ("﻿" + json.dumps(rec(1)), 1),
        (json.dumps(rec(1)) + "\r\n" + json.dumps(rec(2)) + "\n\n", 2), (json.dumps([rec(1), rec(2)])[:-20], 1), (json.dumps(rec(1)) + '\n{"image": "x', 1),
        ('{"broken": \n' + json.dumps(rec(1)), 1), ('{"im', 0), ("garbage", 0), ('[{"qa_id": 1, "messages": [{"role": "user"}', 0),
    ],
)
def test_complete_objects_of_a_file(content, n):
    assert len(list(cp.records_of(content))) == n


def test_keys():
    assert cp.record_key("judge", {"image": "a/b/c.png"}) == "c.png"
    assert cp.record_key("chat", {"qa_id": 0}) == "0"
    assert cp.record_key("chat", {}) is None and cp.record_key("judge", {"image": None}) is None


def test_longest_first_is_balanced():
    rnd = random.Random(1)
    loads = [(i, rnd.randrange(1, 1000)) for i in range(500)]
    dealt = cp.longest_first(loads, 7)
    sums = [sum(s for i, s in loads if dealt[i] == g) for g in range(7)]
    assert len(dealt) == 500 and max(sums) - min(sums) <= max(s for _, s in loads)


def test_each_record_once_and_last_delivery_wins(spark):
    at = lambda d: dt.datetime(2025, 1, d)
    files = [
        (1, "p", "judge", "d", 1, 9, at(1), json.dumps([rec(1), rec(2)]), 0, 0), (2, "p", "judge", "d", 1, 9, at(2), json.dumps(rec(1, False)), 0, 0),
        (3, "q", "judge", "d", 2, 9, at(1), json.dumps(rec(1)), 0, 0), (4, "q", "chat", None, None, None, None, json.dumps({"qa_id": 7}), 0, 0),
        (5, "r", "chat", "d", 1, 9, at(1), None, 0, 0), (6, "r", "chat", "d", 1, 9, at(1), '{"x": 1}\n{"x": 2}\n{"x": 1}', 0, 0),
    ]
    df = spark.createDataFrame(files, SCHEMA)
    folder = cp.consolidate(df, target_bytes=60)
    back = cp.read_consolidated(spark, folder).collect()
    assert len(back) == 6
    won = [json.loads(r["body"])["keep"] for r in back if r["doc_name"] == "d" and r["page"] == 1 and r["record_key"] == "1_final_001.png"]
    assert won == [False]
    manifest = spark.read.parquet(f"{folder}/manifest").collect()
    assert sum(m["n_records"] for m in manifest) == 6 and len(manifest) > 1


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert cp.consolidated_keys(df).count() == 0


def test_many_files_into_few_against_a_plain_count(spark):
    rnd = random.Random(5)
    rows, want = [], set()
    for i in range(400):
        doc, page = ("hot" if rnd.random() < 0.4 else f"d{rnd.randrange(9)}"), rnd.randrange(4)
        recs = [rec(rnd.randrange(30)) for _ in range(rnd.choice([1, 2, 60]))]
        want |= {(doc, page, r["image"].split("/")[-1]) for r in recs}
        rows.append((i, "p", "judge", doc, page, 1, dt.datetime(2025, 1, 1), "\n".join(map(json.dumps, recs)), 0, 0))
    folder = cp.consolidate(spark.createDataFrame(rows, SCHEMA), target_bytes=20_000)
    got = cp.read_consolidated(spark, folder).collect()
    assert len(got) == len(want) and {(r["doc_name"], r["page"], r["record_key"]) for r in got} == want
    assert spark.read.parquet(f"{folder}/manifest").count() < 40


def test_a_huge_file_is_cut_and_shards_keep_the_balance(spark):
    rows = [(0, "p", "judge", "d", 1, 1, dt.datetime(2025, 1, 1), "\n".join(json.dumps(rec(i)) for i in range(3000)), 0, 0)]
    rows += [(i, "p", "judge", "d", 2, 1, dt.datetime(2025, 1, 1), json.dumps(rec(i)), 0, 0) for i in range(1, 1001)]
    rows.append((None, None, "judge", None, None, None, None, json.dumps(rec(5)), None, None))
    df = spark.createDataFrame(rows, SCHEMA)
    sizes = {}
    for shards, most in (("one", cp.SHARD_FILES), ("many", 150)):
        folder = cp.consolidate(df, target_bytes=20_000, shard_files=most)
        manifest = spark.read.parquet(f"{folder}/manifest").collect()
        assert sum(m["n_records"] for m in manifest) == 4001 == cp.read_consolidated(spark, folder).count()
        sizes[shards] = [m["n_records"] for m in manifest]
    # the huge file alone holds three quarters of all records
    assert max(sizes["one"]) <= 1.3 * 4001 / len(sizes["one"])
    assert max(sizes["many"]) <= 1.8 * 4001 / len(sizes["many"])

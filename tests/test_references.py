import datetime as dt
import random

from folioframe.operators import references as rf

REF_SCHEMA = "ref_table string, ref_id bigint, ref_field string, item_pos bigint, kind string, k_name string, k_page bigint, ref_time timestamp"
TARGET_SCHEMA = "name string, page bigint, registered_at timestamp, deleted_at timestamp, kind int, since int"


def day(n):
    return None if n is None else dt.datetime(2025, 1, 1) + dt.timedelta(days=n)


def check(spark, refs, targets, heavy=2):
    r = spark.createDataFrame([("t", i, "f", 0, "doc", k, -1, day(t)) for i, (k, t) in enumerate(refs)], REF_SCHEMA)
    t = spark.createDataFrame([(k, 0, day(a), day(b), 1, 1) for k, a, b in targets], TARGET_SCHEMA)
    got = {x["ref_id"] for x in rf.orphans(r, rf.target_rows(t, "doc", rf.F.col("name"), None), heavy).collect()}
    live = lambda k, at: at is not None and any(n == k and a is not None and a <= at and (b is None or at < b) for n, a, b in targets)
    assert got == {i for i, (k, at) in enumerate(refs) if not live(k, at)}


def test_intervals_edges_and_ties(spark):
    refs = [("a", 0), ("a", 4), ("a", 5), ("a", 9), ("a", 10), ("b", 3), ("c", 3), ("a", None), ("d", 3), ("e", 3)]
    targets = [("a", 0, 5), ("a", 10, None), ("a", 0, 5), ("b", 4, None), ("d", 3, 3), ("e", None, None)]
    check(spark, refs, targets)


def test_heavy_key_and_random_rows(spark):
    rnd = random.Random(3)
    refs = [("hot" if rnd.random() < 0.4 else f"k{rnd.randrange(12)}", rnd.randrange(90)) for _ in range(600)]
    targets = [("hot", 10, 30), ("hot", 50, None)] + [(f"k{i}", s := rnd.randrange(60), rnd.choice([None, s + 20])) for i in range(9)]
    for heavy in (1, 5, 2000):
        check(spark, refs, targets, heavy)


def test_empty_sides(spark):
    check(spark, [("a", 1)], [])
    check(spark, [], [("a", 1, None)])


def test_nulls_are_no_references(spark):
    df = spark.createDataFrame([(1, "d", [1, None], day(1)), (2, None, [1], day(1)), (3, "d", None, day(1))], "id bigint, doc_name string, items array<bigint>, created_at timestamp")
    got = rf.array_refs(df, "t", "id", "items", "page", "items", rf.F.col("doc_name"), "created_at").collect()
    assert [(x["ref_id"], x["item_pos"], x["k_page"]) for x in got] == [(1, 0, 1)]
    assert rf.scalar_refs(df, "t", "id", "doc_name", "doc", rf.F.col("doc_name"), "created_at").count() == 2

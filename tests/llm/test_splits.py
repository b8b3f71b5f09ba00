import random

import pytest
from pyspark.sql import functions as F

from folioframe.llm import splits as sp

SCHEMA = "doc_name string, category string, authors array<string>, n_pages bigint, doc string, hub int, comp string"


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("rep-2020-000011", "REP-2020-000011V4.PDF", True), ("vol04.no4.000065", "vol04_no4_000065", True), ("qx21.000008", "qx21.000008 (2)", True), ("qx24.1_de", "qx24.1", True),
        ("a_1v3-draft", "a_1", True), ("a_1 rev. 3", "a_1", True), ("a_1-r4", "a-1_camera-ready", True), ("a_000051", "b_000051", False), ("qx24.000057", "qx24.000058", False),
        ("v2", "v3", False), ("draft", "final", False), ("rep-2020-1", "rep-2021-1", False),
    ],
)
def test_work_keys(spark, a, b, same):
    k = spark.createDataFrame([(a,), (b,)], "n string").select(sp.work_key(F.col("n"))).collect()
    assert (k[0][0] == k[1][0]) is same


def brute(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        up[root(a)] = root(b)
    groups = {}
    for x in list(up):
        groups.setdefault(root(x), set()).add(x)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("kind", ["chain", "star", "random", "loops"])
def test_forest_against_union_find(spark, kind):
    rnd = random.Random(4)
    edges = {
        "chain": [(f"v{i:03d}", f"v{i + 1:03d}") for i in range(70)], "star": [("hub", f"v{i}") for i in range(60)],
        "random": [(f"v{rnd.randrange(80)}", f"v{rnd.randrange(80)}") for _ in range(70)], "loops": [("a", "a"), ("a", "b"), ("b", "a"), ("a", "b"), ("c", "c")],
    }[kind]
    label, forest = sp.spanning_forest(spark.createDataFrame(edges, "u string, v string"))
    groups = {}
    for r in label.collect():
        groups.setdefault(r["comp"], set()).add(r["vertex"])
    want = brute([e for e in edges if e[0] != e[1]])
    assert {frozenset(g) for g in groups.values()} == want
    picked = [tuple(r) for r in forest.collect()]
    assert len(picked) == sum(len(g) - 1 for g in want) and brute(picked) == want


def test_groups_fillers_and_names(spark):
    rows = [
        ("a", "x", ["P.One"], 1, None, 1, None), ("b", "x", [" p.one ", None, ""], None, None, 1, None), ("c", "x", ["Unknown"], 1, None, 1, None), ("d", "x", ["unknown", "et al."], 1, None, 1, None),
        ("e", None, None, 1, None, 1, None), ("E.pdf", None, [], 1, None, 1, None), ("a", "x", ["q.two"], 1, None, 1, None), ("f", "x", ["q.two"], 1, None, 1, None), (None, "x", ["q.two"], 1, None, 1, None),
    ]
    got = {tuple(r) for r in sp.related_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("a", "a"), ("b", "a"), ("f", "a"), ("e", "E.pdf"), ("E.pdf", "E.pdf")}
    assert sp.related_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_splits_keep_groups_and_shares(spark):
    rnd = random.Random(6)
    sizes = [(f"g{i}", rnd.choice([1, 1, 1, 2, 3, 9, 40])) for i in range(1500)] + [("hot", 1500), ("none", 0)]
    out = sp.assign_splits(spark.createDataFrame(sizes, "group_name string, n_records bigint")).collect()
    assert len(out) == len(sizes) and len({r["group_name"] for r in out}) == len(sizes)
    total = sum(n for _, n in sizes)
    for split, share in (("train", 0.8), ("validation", 0.1), ("test", 0.1)):
        assert abs(sum(r["n_records"] for r in out if r["split"] == split) / total - share) < 0.04


def test_records_of_related_documents_stay_together(spark):
    cat = spark.createDataFrame([("a", "x", ["p"], 1, None, 1, None), ("b", "x", ["p"], 1, None, 1, None)], SCHEMA)
    recs = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "A.pdf", "x"), (4, None, "x"), (1, "a", "x")], "id bigint, doc_name string, category string")
    out = sp.split_documents(cat, [("t", recs, "id")])
    assert {r["doc_name"] for r in out.collect()} == {"a", "b", "A.pdf"} and len({r["split"] for r in out.collect()}) == 1
    found = {tuple(r)[:4] for r in sp.split_records(out, [("t", recs, "id")], cat).collect()}
    assert found == {("t", "1", "a", "x"), ("t", "2", "b", "x"), ("t", "3", "A.pdf", "x")}


@pytest.mark.parametrize("per_band", [1, 2, 3])
@pytest.mark.parametrize("hot", [False, True])
def test_bands_of_few_groups_keep_the_shares(spark, per_band, hot):
    sizes = [(f"g{b}-{i}", 2**b + i) for b in range(12) for i in range(per_band)]
    total = sum(n for _, n in sizes)
    if hot:
        sizes.append(("hot", total // 9))
        total += total // 9
    out = sp.assign_splits(spark.createDataFrame(sizes, "group_name string, n_records bigint")).collect()
    got = {x: sum(r["n_records"] for r in out if r["split"] == x) for x in ("train", "validation", "test")}
    # one band's largest group holds half of all records, so a small split is met within one group below its share
    small = max([n for _, n in sizes if n <= 0.1 * total])
    assert all(abs(got[x] - share * total) <= small for x, share in (("train", 0.8), ("validation", 0.1), ("test", 0.1)))


def test_records_without_category_and_hot_documents(spark):
    cat = spark.createDataFrame([(f"d{i}", "cat", None, 1, None, 1, None) for i in range(40)], SCHEMA)
    many = [(i, "d1" if i % 3 == 0 else f"d{i % 40}") for i in range(900)]
    recs = spark.createDataFrame([*many, *many[:50], (None, "d1"), (7, None)], "id bigint, doc_name string")
    tables = [("t", recs, "id")]
    out = sp.split_records(sp.split_documents(cat, tables), tables, cat).collect()
    assert len(out) == len({(r["record_id"], r["doc_name"]) for r in out}) == 901 and {r["category"] for r in out} == {"cat"}
    assert all(len({r["split"] for r in out if r["doc_name"] == d}) == 1 for d in ("d1", "d2"))


@pytest.mark.parametrize("hot", [[1000], [700, 600], [2000], [300, 290, 280]])
def test_large_groups_are_made_up_for_by_the_others(spark, hot):
    sizes = [(f"h{i}", n) for i, n in enumerate(hot)] + [(f"g{i}", 1 + i % 3) for i in range(1400)]
    out = sp.assign_splits(spark.createDataFrame(sizes, "group_name string, n_records bigint")).collect()
    assert len(out) == len(sizes) and len({r["group_name"] for r in out}) == len(sizes)
    total = sum(n for _, n in sizes)
    for split, share in (("train", 0.8), ("validation", 0.1), ("test", 0.1)):
        assert abs(sum(r["n_records"] for r in out if r["split"] == split) / total - share) < 0.005


def test_reached_shares(spark):
    out = spark.createDataFrame([("a", 6, "train"), ("b", 2, "train"), ("c", 2, "test")], "doc_name string, n_records bigint, split string")
    assert {tuple(r) for r in sp.realised_shares(out).collect()} == {("train", 8, 2, 0.8), ("test", 2, 1, 0.2)}

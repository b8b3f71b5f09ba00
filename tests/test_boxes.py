import itertools
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioframe.functions import boxparse as bp
from folioframe.functions import geometry as geo
from folioframe.functions import matching as mt
from folioframe.operators import regions, scoring
from pyspark.sql import functions as F

B, C = [1.0, 2.0, 3.0, 4.0], [5.0, 6.0, 7.0, 8.0]


@pytest.mark.parametrize("a, b, want", [([0, 0, 10, 10], [5, 5, 15, 15], 25 / 175), ([0, 0, 10, 10], [0, 0, 5, 5], 0.25), ([5, 5, 5, 9], [5, 5, 5, 9], 0.0), ([10, 10, 0, 0], [0, 0, 10, 10], 0.0), ([0, 0, 10, 10], [20, 20, 30, 30], 0.0)])
def test_iou(spark, a, b, want):
    lit = lambda v: F.array(*[F.lit(float(x)) for x in v])
    assert spark.range(1).select(geo.iou(lit(a), lit(b))).first()[0] == pytest.approx(want)
    assert mt.box_iou(a, b) == pytest.approx(want)


def brute(w):
    if not w or not w[0]:
        return 0.0
    if len(w) > len(w[0]):
        w = [list(c) for c in zip(*w)]
    return max(sum(w[i][j] for i, j in enumerate(p)) for p in itertools.permutations(range(len(w[0])), len(w)))


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 4).flatmap(lambda n: st.integers(0, 4).flatmap(lambda m: st.lists(st.lists(st.floats(0, 1), min_size=m, max_size=m), min_size=n, max_size=n))))
def test_assignment_is_optimal(w):
    assert mt.assignment(w) == pytest.approx(brute(w))


def test_native_and_large_matching_agree(spark):
    import random

    rnd = random.Random(2)
    box = lambda: (lambda x, y: [x, y, x + rnd.uniform(5, 40), y + rnd.uniform(5, 40)])(rnd.uniform(0, 60), rnd.uniform(0, 60))
    rows = [(i, [[box() for _ in range(rnd.randrange(5))] for _ in range(2)], [[box() for _ in range(rnd.randrange(5))] for _ in range(rnd.randrange(3))]) for i in range(60)]
    rows += [(100, [[box() for _ in range(9)]], [[box() for _ in range(8)]]), (101, [], []), (102, None, None)]
    df = spark.createDataFrame(rows, "id int, gt array<array<array<double>>>, pred array<array<array<double>>>")
    got = {r["id"]: (r["sample_iou"], r["page_iou"]) for r in scoring.grouped_scores(df, "id", "gt", "pred").collect()}
    for i, gt, pred in rows:
        gt, pred = gt or [], pred or []
        n = max(len(gt), len(pred))
        at = lambda x, k: x[k] if k < len(x) else []
        sums = [mt.assignment([[mt.box_iou(g, p) for p in at(pred, k)] for g in at(gt, k)]) for k in range(n)]
        sizes = [max(len(at(gt, k)), len(at(pred, k))) for k in range(n)]
        total = max(sum(map(len, gt)), sum(map(len, pred)), 1)
        assert got[i] == pytest.approx((sum(sums) / total, sum(s / z for s, z in zip(sums, sizes) if z) / max(n, 1)))


@pytest.mark.parametrize(
    "text, label, crops",
    [
        ("[1,2,3,4]", [[B]], [[B]]), ("[[1,2,3,4],[5,6,7,8]]", [[B, C]], [[B, C]]), ("[[[1,2,3,4]],[[5,6,7,8]]]", [[B], [C]], [[B], [C]]), ("[]", [[]], []),
        ('["1, 2, 3, 4"]', [[B]], [[B]]), ("[[1,2,3,4],5,6,7,8]", [[B, C]], None), ("```\n[[1,2,3,4]]\n```", [[B]], [[B]]), ("see [1,2,3,4] and [5,6,7,8]", [[B, C]], [[B, C]]),
    ],
)
def test_label_and_crop_readers(text, label, crops):
    if text == "[]":
        assert bp.read_label(text) in ([[]], [])
    else:
        assert bp.read_label(text) == label
    assert bp.read_crops(text) == crops


def test_unreadable_texts():
    for text in ("none", "[[1,2,3]]", "{}", "[1,2,3,4,5]"):
        with pytest.raises(bp.Unreadable):
            bp.read_prediction(text, 1, True)
    with pytest.raises(bp.Unreadable):
        bp.read_label(None)
    assert bp.read_crops("none") is None and bp.read_crops(None) == []
    assert bp.read_prediction(None, 2, False) == ([[], []], True, "empty")


def test_scored_predictions_keep_failures(spark):
    rows = [(1, json.dumps([[B]]), json.dumps([[B]])), (2, "none", json.dumps([[B]])), (3, json.dumps([[B], [C]]), json.dumps([[C], [B]])), (4, None, None), (5, "[5,6,7,8,1,2,3,4]", json.dumps([[B, C]]))]
    df = spark.createDataFrame(rows, "id int, predict string, label string")
    s = scoring.scored_predictions(df, "predict", "label")
    got = {r["id"]: (r["sample_iou"], r["predict_parse_mode"]) for r in s.collect()}
    assert got[1][0] == 1.0 and got[2] == (0.0, "parse_error") and got[3][0] == 0.0 and got[4][1] == "parse_error" and got[5][0] == 1.0
    m = scoring.iou_summary(s).first()
    assert (m["count"], m["valid"], m["parse_failures"]) == (5, 3, 2) and m["hits_at_50"] == 2 and m["rate_at_50"] == 0.4
    assert {r["predict_parse_mode"]: r["n"] for r in scoring.mode_histogram(s).collect()} == {"page_grouped_recovered": 2, "flat_number_sequence": 1}


def test_greedy_pruning_cases(spark):
    nested = [("a", [0, 0, 100, 100]), ("b", [0, 0, 100, 95]), ("c", [0, 0, 50, 50])]
    trap = [("p", [0, 0, 100, 10]), ("q", [4, 0, 106, 10]), ("r", [12, 0, 120, 10])]
    rows = [("1", n, "text", [float(x) for x in b]) for n, b in nested] + [("2", n, "image", [float(x) for x in b]) for n, b in nested]
    rows += [("3", n, "text", [float(x) for x in b]) for n, b in trap] + [("4", "a", "text", [0.0, 0.0, 9.0, 9.0]), ("4", "b", "text", [0.0, 0.0, 9.0, 9.0])]
    rows += [("5", "a", "text", [0.0, 0.0, 100.0, 100.0]), ("5", "b", "image", [0.0, 0.0, 100.0, 95.0]), ("6", "a", "text", None), ("6", "b", "unknown", [0.0, 0.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "page string, name string, type string, box array<double>")
    left = {}
    for r in regions.pruned(df).collect():
        left.setdefault(r["page"], set()).add(r["name"])
    assert left == {"1": {"c"}, "2": {"a"}, "3": {"p", "r"}, "4": {"b"}, "5": {"a", "b"}, "6": {"a", "b"}}


def test_clamps_round_differently(spark):
    b = F.array(*[F.lit(x) for x in (2.5, 2.5, 3.5, 3.5)])
    r = spark.range(1).select(geo.clamp_truncated(b, F.lit(100), F.lit(100)).alias("t"), geo.clamp_rounded(b, F.lit(100), F.lit(100)).alias("r")).first()
    assert r["t"] == [2, 2, 3, 3] and r["r"] == [2, 2, 4, 4]
    rel = F.array(*[F.lit(x) for x in (110.196078, 675.151515, 741.176471, 891.212121)])
    assert spark.range(1).select(geo.absolute(rel, F.lit(2550.0), F.lit(3300.0))).first()[0] == [281, 2228, 1890, 2941]

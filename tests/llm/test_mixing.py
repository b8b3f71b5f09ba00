import random

from folioframe.llm import mixing as mx

DOCS = "doc_id bigint, text string, source string, n_tokens string, copy int"
TARGETS = "source string, target_share double, max_repeat bigint, have int"


def make(spark, sizes, seed=1):
    rnd = random.Random(seed)
    rows, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((i, "word " * rnd.randrange(1, 60), source, None, None))
            i += 1
    rows += [(i, None, "a", None, None), (i + 1, "", "a", None, None), (i + 2, "stray", None, None, None), (i + 3, "stray", "zzz", None, None)]
    return spark.createDataFrame(rows, DOCS)


def test_shares_and_caps(spark):
    docs = make(spark, {"a": 900, "b": 200, "c": 20})
    targets = spark.createDataFrame([("a", 0.5, 1, 1), ("b", 0.3, None, 1), ("c", 0.15, 4, 1), ("gone", 0.05, 9, 1)], TARGETS)
    mixture, flows = mx.fair_mixture(docs, targets)
    got = {r["source"]: r for r in mx.reached_shares(mixture, flows).collect()}
    assert got["gone"]["reached_share"] == 0 and got["gone"]["n_tokens"] == 0
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.15)):
        assert abs(got[s]["reached_share"] - share / 0.95) < 0.03
    assert got["a"]["most_copies"] == 1 and got["b"]["most_copies"] == 1 and 1 < got["c"]["most_copies"] <= 4
    rows = mixture.collect()
    assert len({(r["doc_id"], r["copy"]) for r in rows}) == len(rows)
    assert sum(r["n_tokens"] for r in rows) <= mx.feasible_budget(flows)


def test_equals_a_plain_queue(spark):
    docs = make(spark, {"a": 60, "b": 15}, 2)
    targets = spark.createDataFrame([("a", 0.6, 1, 1), ("b", 0.4, 3, 1)], TARGETS)
    mixture, flows = mx.fair_mixture(docs, targets, budget=2500)
    rows = mixture.collect()
    used = 0
    for r in sorted(rows, key=lambda r: (r["finish_time"], r["source"], r["doc_id"], r["copy"])):
        used += r["n_tokens"]
    assert used <= 2500
    order = sorted((r["finish_time"], r["source"]) for r in rows)
    for source, weight in (("a", 0.6), ("b", 0.4)):
        total = 0
        for r in sorted((r for r in rows if r["source"] == source), key=lambda r: r["finish_time"]):
            total += r["n_tokens"]
            assert abs(r["finish_time"] - total / weight) < 1e-6
    assert order


def test_dry_sources_leave_their_part_to_others(spark):
    docs = make(spark, {"a": 400, "b": 3}, 3)
    targets = spark.createDataFrame([("a", 0.5, 1, 1), ("b", 0.5, 2, 1)], TARGETS)
    mixture, flows = mx.fair_mixture(docs, targets, budget=5000)
    got = {r["source"]: r for r in mx.reached_shares(mixture, flows).collect()}
    assert got["b"]["n_records"] == 6 and sum(r["n_tokens"] for r in got.values()) > 4800


def test_empty_inputs(spark):
    docs, targets = make(spark, {"a": 3}), spark.createDataFrame([("a", 1.0, 1, 1)], TARGETS)
    assert mx.fair_mixture(docs.filter("false"), targets)[0].count() == 0
    assert mx.fair_mixture(docs, targets.filter("false"))[0].count() == 0


def test_a_mixture_of_corpus_size_stops_poor_sources_at_their_caps(spark):
    docs = make(spark, {"a": 400, "b": 5}, 4)
    targets = spark.createDataFrame([("a", 0.5, 2, 1), ("b", 0.5, 3, 1)], TARGETS)
    mixture, flows = mx.mixture_of_corpus_size(docs, targets)
    got = {r["source"]: r for r in mx.reached_shares(mixture, flows).collect()}
    total = mx.corpus_budget(flows)
    assert got["b"]["n_records"] == 15 and got["b"]["most_copies"] == 3 and got["a"]["most_copies"] <= 2
    assert 0.95 * total < sum(r["n_tokens"] for r in got.values()) <= total

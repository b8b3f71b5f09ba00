import random

import pytest
from pyspark.sql import functions as F

from folioframe.llm import tokenizer as tk

TEXTS = [
    None, "", " ", "\n\n  \t x", "Hello world", "don't we'll I'VE", "Ünïcödé straße 日本語 🙂👍🏽", "a  b   c\r\n\r\nd", "1234567890 3.14", "x" * 500, "aB3/+" * 90, "   y", "ab\u0000c", "<|endoftext|>",
    "…—–“”", "﻿bom", "é", "لغة عربية", "     indented\n        more", "=" * 300, "tab\t\tsep", "word " * 2000, " z\u0085q",
]


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=tk.PATTERN.removeprefix("(?U)"), mergeable_ranks=tk.load_ranks(tk.vocabulary_path()), special_tokens={})


def test_ids_equal_the_public_encoder(spark, reference):
    rnd = random.Random(1)
    alphabet = "abcdefghij  .,;0123éüñ日Ω\n'"
    texts = TEXTS + ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(200))) for _ in range(60)]
    rows = [(i, t, "x", [1]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, word string, ids array<int>")
    got = {r["doc_id"]: r["ids"] for r in tk.encode_corpus(df).collect()}
    assert got == {i: reference.encode_ordinary(t or "") for i, t in enumerate(texts)}


def test_frequent_rare_and_long_words(spark, reference, monkeypatch):
    monkeypatch.setattr(tk, "HOT_WORDS", 40)
    monkeypatch.setattr(tk, "FOLD_BYTES", 300)
    rnd = random.Random(3)
    names = ["Zimarvex", "qlotrup", "Ünterzwölf", "日本語学部"]
    long = "".join(rnd.choice("0123456789") for _ in range(900))
    texts = [" ".join(rnd.choice(names) if rnd.random() < 0.5 else f"w{rnd.randrange(900)}x" for _ in range(30)) for _ in range(80)] + [long, f"a {long[:250]} b {long}", "Zimarvex" * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["ids"] for r in tk.encode_corpus(df).collect()}
    assert got == {i: reference.encode_ordinary(t) for i, t in enumerate(texts)}


def test_round_trip_and_repeated_ids(spark):
    rows = [(1, t) for t in TEXTS if t is not None]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    coded = tk.encode_corpus(df)
    assert coded.count() == len(rows)
    back = sorted(r[0] for r in coded.select(tk.decode_ids(F.col("ids"))).collect())
    assert back == sorted(t for _, t in rows)


def test_empty_corpus(spark):
    assert tk.encode_corpus(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_heap_and_fold_merge_alike(spark):
    ranks = tk.load_ranks(tk.vocabulary_path())
    words = ["abcabcabc", "straße", "aaaaaaaaaa", "Zimarv", "日本語日本語", " leading", "x1"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    fold = {r[0]: r[1] for r in df.select("word", tk.fold_merges(F.col("word"), tk.rank_literal(tk.vocabulary_path()))).collect()}
    assert fold == {w: tk.heap_merges(w.encode(), ranks) for w in words}


def test_token_counts(spark, reference):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    assert [r[0] for r in df.select(tk.token_count(F.col("t"))).collect()] == [len(reference.encode_ordinary(t or "")) for t in TEXTS]

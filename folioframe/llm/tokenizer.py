"""Encoding and decoding a corpus with a public byte-level BPE vocabulary.

Texts are cut into words by the vocabulary's pattern in the JVM. A word that is
one vocabulary piece gets its id in place. Of all other words every distinct
one is encoded once: a fold over its bytes merges the pair of lowest rank until
none is left, all in higher-order functions over a literal rank map. Of these
words the frequent ones (a bounded number) are a literal map, too; the others
meet their places in a shuffle join, so no frequent word is ever a join key.

Defined results: empty and null texts give an empty list; texts of white space
are encoded like any other; every document gives one row; decoding the ids of a
text gives the text.
"""

from __future__ import annotations

import base64
import heapq
import json
import os
import zlib
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.plans.staging import spread, stage

#: Where vocabulary files lie; the path is a parameter of every function here.
TOKENIZER_DIR = os.environ.get("FOLIOFRAME_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the word pattern of the vocabulary, with Unicode white space.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Buckets of the literal rank map: a map is searched linearly, a bucket holds about six pieces.
BUCKETS = 8192
#: Words of more bytes than this (about one distinct word in 800 here) are merged with a heap (same merges) instead of the
#: fold, whose cost is quadratic: folding up to 4,096 bytes took 48 CPU seconds where this takes about 11 in all.
FOLD_BYTES = 192
#: A word with at least 1/HOT_WORDS of all places of words that are no piece is frequent, so at most this many are.
HOT_WORDS = 16384
#: Longer words are never part of the literal map of frequent words, which so holds at most HOT_WORDS x HOT_BYTES bytes.
HOT_BYTES = 64
NO_RANK = 1 << 30
#: Marks the place of a word that is no piece.
OPEN = -1


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    return os.path.join(folder or TOKENIZER_DIR, name)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def rank_literal(path: str) -> Column:
    """array<map<piece, rank>>: the bucket is the CRC of the piece, bytes are kept as Latin-1 characters."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in load_ranks(path).items():
        key = piece.decode("latin-1")
        buckets[zlib.crc32(key.encode("utf-8")) % BUCKETS][key] = rank
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")


def _bucketed(entries: list[tuple[str, Any]], kind: str) -> Column:
    """array<map<text, kind>> over texts, by the CRC of their UTF-8 bytes."""
    buckets: list[dict[str, Any]] = [{} for _ in range(BUCKETS)]
    for text, value in entries:
        buckets[zlib.crc32(text.encode("utf-8")) % BUCKETS][text] = value
    return F.from_json(F.lit(json.dumps(buckets)), f"array<map<string,{kind}>>")


def text_literal(path: str) -> Column:
    """The pieces that are whole texts, keyed as texts: most words are one of them and need no look at their bytes."""
    found = []
    for piece, rank in load_ranks(path).items():
        try:
            found.append((piece.decode("utf-8"), rank))
        except UnicodeDecodeError:
            continue
    return _bucketed(found, "int")


def _look_up(literal: Column, word: Column) -> Column:
    bucket = F.get(literal, F.pmod(F.crc32(word.cast("binary")), F.lit(BUCKETS)).cast("int"))
    return F.try_element_at(bucket, word)


def piece_literal(path: str) -> Column:
    ranks = load_ranks(path)
    pieces = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.decode("latin-1")
    return F.from_json(F.lit(json.dumps(pieces)), "array<string>")


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _bytes(word: Column) -> Column:
    """The UTF-8 bytes of a text as a string of Latin-1 characters."""
    return F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")


def _rank(ranks: Column, piece: Column) -> Column:
    bucket = F.element_at(ranks, (F.pmod(F.crc32(piece.cast("binary")), F.lit(BUCKETS)) + 1).cast("int"))
    return F.try_element_at(bucket, piece)


def _pair(ranks: Column, a: Column, b: Column) -> Column:
    return F.coalesce(_rank(ranks, F.concat(a, b)), F.lit(NO_RANK))


def fold_merges(word: Column, ranks: Column) -> Column:
    """ids of one word: a fold that merges the leftmost pair of lowest rank per step.

    The literal is bound once and used through its variable: expression trees are
    hashed when a task sets up its projection, and every copy would be hashed again.
    """
    return _let(ranks, lambda bound: _fold(word, bound))


def _fold(word: Column, ranks: Column) -> Column:

    def start(parts: Column) -> Column:
        n = F.size(parts)
        pairs = F.when(
            n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: _pair(ranks, F.get(parts, i - 1), F.get(parts, i)))
        ).otherwise(F.array().cast("array<int>"))
        return F.struct(parts.alias("parts"), pairs.alias("pairs"))

    def merge(acc: Column, at: Column) -> Column:
        # at: 1-based place of the pair; it joins parts at and at + 1
        parts, pairs, n = acc["parts"], acc["pairs"], F.size(acc["parts"])

        def joined(new: Column) -> Column:
            left = F.when(at > 1, F.array(_pair(ranks, F.get(parts, at - 2), new))).otherwise(F.array().cast("array<int>"))
            right = F.when(at + 1 < n, F.array(_pair(ranks, new, F.get(parts, at + 1)))).otherwise(
                F.array().cast("array<int>")
            )
            return F.struct(
                F.concat(F.slice(parts, F.lit(1), at - 1), F.array(new), F.slice(parts, at + 2, n)).alias("parts"),
                F.concat(
                    F.slice(pairs, F.lit(1), F.greatest(at - 2, F.lit(0))), left, right, F.slice(pairs, at + 2, n)
                ).alias("pairs"),
            )

        return _let(F.concat(F.get(parts, at - 1), F.get(parts, at)), joined)

    def step(acc: Column, _: Column) -> Column:
        lowest = F.array_min(acc["pairs"])
        return F.when(
            F.coalesce(lowest, F.lit(NO_RANK)) < NO_RANK,
            merge(acc, F.array_position(acc["pairs"], lowest).cast("int")),
        ).otherwise(acc)

    parts = F.split(_bytes(word), "")
    steps = F.sequence(F.lit(1), F.greatest(F.octet_length(word) - 1, F.lit(1)))
    return F.aggregate(steps, _let(parts, start), step, lambda acc: F.transform(acc["parts"], lambda p: _rank(ranks, p)))


def heap_merges(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """ids of one long word: the same merges, kept in a heap over a linked list."""
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
    n = len(parts)
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, bytes]] = []

    def push(i: int) -> None:
        j = nxt[i]
        if j < n:
            both = parts[i] + parts[j]
            if both in ranks:
                heapq.heappush(heap, (ranks[both], i, both))

    for i in range(n - 1):
        push(i)
    while heap:
        _, i, both = heapq.heappop(heap)
        if parts[i] is None or (j := nxt[i]) >= n or parts[i] + parts[j] != both:
            continue
        parts[i], parts[j] = both, None
        nxt[i] = nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
            push(i)
        if prv[i] >= 0:
            push(prv[i])
    return [ranks[p] for p in parts if p is not None]


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """word, n, ids of every distinct word of ``words`` (column word), n: how often it occurs."""
    # the fold is costly per word: spread the few distinct words over all cores, whatever their bytes
    sc = words.sparkSession.sparkContext
    tasks = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * sc.defaultParallelism)
    distinct = words.groupBy("word").agg(F.count("*").alias("n")).repartition(tasks, "word")
    short = distinct.filter(F.octet_length("word") <= FOLD_BYTES)
    short = short.select("word", "n", fold_merges(F.col("word"), rank_literal(path)).alias("ids"))

    def run(batches):
        ranks = load_ranks(path)
        for b in batches:
            b["ids"] = [heap_merges(w.encode("utf-8"), ranks) for w in b["word"]]
            yield b

    long = distinct.filter(F.octet_length("word") > FOLD_BYTES).mapInPandas(run, "word string, n bigint, ids array<int>")
    return short.unionByName(long)


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per document: its id and the token ids of its whole text."""
    path = path or vocabulary_path()
    pieces = text_literal(path)
    words = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(PATTERN), F.lit(0))
    # repeated ids of a corpus keep their rows apart; the row number is written, so it stays
    cut = spread(docs.select(id_col, text_col)).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words.alias("words"))
    cut = cut.select("row", "id", "words", F.transform("words", lambda w: F.coalesce(_look_up(pieces, w), F.lit(OPEN))).alias("ids0"))
    # only ids0, which stands in several places, may be looked at per element: the optimizer would put other columns' expressions there
    open_ = F.filter(F.transform("words", lambda w, i: F.when(F.get("ids0", i) == OPEN, w)), lambda w: w.isNotNull())
    tagged = stage(cut.select("row", "id", "ids0", open_.alias("open")), "tagged-words")
    coded = stage(encode_words(tagged.select(F.explode("open").alias("word")), path), "coded-words")
    total = coded.agg(F.sum("n")).first()[0] or 0
    frequent = coded.filter((F.col("n") * HOT_WORDS >= total) & (F.octet_length("word") <= HOT_BYTES)).select("word", "ids")
    hot = [(r["word"], list(r["ids"])) for r in frequent.toLocalIterator()]  # at most HOT_WORDS
    known = _bucketed(hot, "array<int>")
    rare = tagged.select("row", F.posexplode("open").alias("pos", "word"))
    rare = rare.join(F.broadcast(frequent.select("word")), "word", "left_anti").join(coded.select("word", "ids"), "word")
    late = rare.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "ids"))).alias("late"))
    early = tagged.select("row", "id", "ids0", F.transform("open", lambda w: _look_up(known, w)).alias("ids1"))
    joined = early.join(late, "row", "left")
    # rare words take the empty places among the open words in order, open words the marked places of the text
    lists = F.transform("late", lambda s: F.array(s["ids"]))
    filled = F.when(F.col("late").isNull(), F.col("ids1")).otherwise(_spliced(F.col("ids1"), lambda x: x.isNull(), lists))
    return joined.select(F.col("id").alias(id_col), _spliced(F.col("ids0"), lambda x: x == OPEN, filled).alias("ids"))


def _spliced(base: Column, gap: Callable[[Column], Column], lists: Column) -> Column:
    """``base`` with its k-th gap replaced by the k-th of ``lists``: the stretches between gaps, each followed by a list."""
    gaps = F.filter(F.transform(base, lambda x, i: F.when(gap(x), i)), lambda i: i.isNotNull())

    def bound(both: Column) -> Column:
        row, at = both["row"], both["at"]

        def stretch(i: Column, k: Column) -> Column:
            start = F.when(k == 0, F.lit(0)).otherwise(F.get(at, k - 1) + 1)
            return F.slice(row, start + 1, i - start)

        tail = F.coalesce(F.try_element_at(at, F.lit(-1)) + 2, F.lit(1))
        rest = F.slice(row, tail, F.greatest(F.size(row) - tail + 1, F.lit(0)))
        return F.when(F.size(at) == 0, row).otherwise(
            F.concat(F.flatten(F.zip_with(F.transform(at, stretch), lists, lambda s, x: F.concat(s, x))), rest)
        )

    return _let(F.struct(base.alias("row"), gaps.alias("at")), bound)


def decode_ids(ids: Column, path: str | None = None) -> Column:
    """The text of a list of ids: the concatenation of their byte pieces."""
    pieces = piece_literal(path or vocabulary_path())
    raw = F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), "")
    return F.decode(F.encode(raw, "ISO-8859-1"), "UTF-8")


def token_count(text: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """Number of tokens of each whole text (Arrow batches; null and empty texts count 0)."""
    import pandas as pd

    path = path or vocabulary_path()
    pattern = pattern or PATTERN.removeprefix("(?U)")

    def count(batches):
        import tiktoken

        # once per task
        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})
        for texts in batches:
            found = enc.encode_ordinary_batch([t or "" for t in texts], num_threads=1)
            yield pd.Series([len(x) for x in found], dtype="int64")

    count.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(count, "bigint")(text)

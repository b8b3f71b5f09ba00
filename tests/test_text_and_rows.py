import json
import os

import pytest
from pyspark.sql import functions as F

from folioframe.functions import png, qaparse
from folioframe.functions import text as tx
from folioframe.models import providers
from folioframe.operators import chat, regions, rows, scoring
from folioframe.sources import scans, sinks
from folioframe.streaming import resume


@pytest.mark.parametrize(
    "p, r, em, contains, anls",
    [
        ("Hello  World", "hello world", 1, 1, 1.0), ("kitten", "sitting", 0, 0, 1 - 3 / 7), ("abcd", "abxy", 0, 0, 0.0), ("machine", "machines", 0, 1, 0.875),
        ("", "", 1, 0, 1.0), (None, "a", 0, 0, 0.0), ("é", "e", 0, 0, 0.0), ("x" * 5000, "x" * 5000 + "y", 0, 1, 1 - 1 / 5001),
    ],
)
def test_text_metrics(spark, p, r, em, contains, anls):
    got = scoring.text_scores(spark.createDataFrame([(p, r)], "p string, r string"), "p", "r").first()
    assert (got["exact_match"], got["contains_match"]) == (em, contains) and got["anls"] == pytest.approx(anls)


def test_verdicts(spark):
    cases = {"Correct.": "True", "incorrect": "False", "not correct": "True", "INCORRECTLY": "False", "uncorrected": "True", "maybe": "maybe", None: None}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    assert {r[0]: r[1] for r in df.select("v", tx.verdict(F.col("v"))).collect()} == cases


def test_crop_verdicts(spark):
    cases = {'{"keep": true, "type":"Table"}': (True, "table"), 'ok {"keep": true} x': (True, "unknown"), '{"keep":"false","type":"text"}': (True, "text"), "garbage": (False, "unknown"), "[1]": (False, "unknown"), "": (False, "unknown"), '{"keep": ""}': (False, "unknown"), '{"keep": [], "type": null}': (False, "unknown")}
    df = spark.createDataFrame([(k,) for k in cases], "v string").select("v", regions.crop_verdict(F.col("v")).alias("r"))
    assert {r["v"]: (r["r"]["keep"], r["r"]["type"]) for r in df.collect()} == cases


def test_fences_and_spans(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(tx.strip_fence(F.lit("```json\n[1]\n```"))) == "[1]" and one(tx.strip_fence_lines(F.lit("```json\n[1]\n``` "))) == "[1]"
    assert one(tx.json_span(F.lit('a [1] {"b": 2} c'))) == '[1] {"b": 2}' and one(tx.json_span(F.lit("none"))) is None
    assert one(tx.field_value(F.lit("Q1: a-b"))) == "a-b" and one(tx.field_value(F.lit("plain"))) == "plain"


@pytest.mark.parametrize(
    "text, items",
    [
        ("<qa><question>Q 1</question><answer>A</answer><type>Number</type></qa>", [("Q 1", "A", "number", "medium")]),
        ('{"qas":[{"q":"x","a":["1","2"],"type":"foo"}]}', [("x", "1; 2", "span", "medium")]),
        ("Q1: what?\nA1: this\nand that\nType: date", [("what?", "this and that", "date", "medium")]), ("NO_VALID_QA", []), (None, []), ("Q: a\nQ: b\nA: c", [("b", "c", "span", "medium")]),
    ],
)
def test_qa_texts(text, items):
    assert [(x["q"], x["a"], x["type"], x["difficulty"]) for x in qaparse.read_items(text)] == items


def test_qa_dedup_and_cap(spark):
    block = lambda q: f"<qa><question>{q}</question><answer>a</answer></qa>"
    text = "".join(map(block, ["x", "X", "b", "c", "d", "e", "f", "g"]))
    assert [i["q"] for i in qaparse.read_items(text)] == ["x", "b", "c", "d", "e", "f"]
    got = spark.createDataFrame([(text,)], "t string").select(qaparse.deduplicated(qaparse.tagged_blocks(F.col("t")))).first()[0]
    assert [i["q"] for i in got] == ["x", "b", "c", "d", "e", "f"]


def test_prompt_parts(spark):
    df = spark.createDataFrame([("<image><image>hi<image>", ["a", "b"])], "t string, i array<string>")
    assert [tuple(x) for x in df.select(tx.prompt_parts(F.col("t"), F.col("i"))).first()[0]] == [("image", "a"), ("image", "b"), ("text", "hi")]


def test_training_rows(spark):
    rec = [("d", "i.png", [3], [1, 2, 3, 4], None, [("q1", "a1"), ("q2", "a2")]), ("d", "j.png", [], [1, 2, 3, 4], "x", [("q", "a")]), ("d", "k.png", [1], None, "x", [("q", "a")])]
    qa = spark.createDataFrame(rec, "doc_name string, image string, page array<int>, bbox array<int>, type string, qas array<struct<q:string,a:string>>")
    types = spark.createDataFrame([("i.png", "table"), ("i.png", "table")], "image string, type string")
    got = chat.training_rows(qa, types).collect()
    assert [(r["query"], r["bbox"], r["subimg_type"]) for r in got] == [("q1", [[[1, 2, 3, 4]]], [["table"]]), ("q2", [[[1, 2, 3, 4]]], [["table"]])]


def test_ordinals_and_windows(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "k int")
    got = {r["k"]: r["ordinal"] for r in rows.with_ordinal(df, ["k"]).collect()}
    assert got == {k: k + 1 for k in range(101)}
    assert rows.row_window(rows.with_ordinal(df, ["k"]), "ordinal", 10, 5).count() == 5
    assert rows.with_ordinal(df.filter("false"), ["k"]).count() == 0


def test_resume(spark, tmp_path):
    stored = spark.createDataFrame([(0, 1, None), (1, 2, "err"), (0, 0, "old")], "idx bigint, ord bigint, error string")
    inputs = spark.createDataFrame([(0,), (1,), (2,)], "idx bigint")
    assert sorted(r[0] for r in rows.pending(inputs, stored, "idx", "ord").collect()) == [1, 2]
    fresh = spark.createDataFrame([(1, 9, None), (2, 9, None)], "idx bigint, ord bigint, error string")
    assert sorted((r["idx"], r["ord"]) for r in rows.merged_results(stored, fresh, "idx", "ord").collect()) == [(0, 1), (1, 9), (2, 9)]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    stored.write.parquet(src)
    for extra in (None, fresh):
        if extra is not None:
            extra.write.mode("append").parquet(src)
        stream = spark.readStream.schema(stored.schema).parquet(src)
        resume.resume_stream(stream, out, str(tmp_path / "ck"), "idx", "ord").awaitTermination()
    assert sorted((r["idx"], r["ord"]) for r in resume.current(spark, out).collect()) == [(0, 1), (1, 9), (2, 9)]


def test_sources_and_sinks(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1}\n\n{"a": 2}\nbad\n', encoding="utf-8")
    assert scans.json_lines(spark, str(p), "a int", "DROPMALFORMED").count() == 2
    with pytest.raises(Exception):
        scans.json_lines(spark, str(p), "a int").collect()
    numbered = scans.numbered_lines(spark, str(p), "a int").collect()
    assert [(r["line_no"], r["a"]) for r in numbered if r["error"] is None] == [(1, 1), (3, 2)] and len(numbered) == 3
    sinks.write_json_lines(spark.createDataFrame([(2, None), (1, "é")], "a int, b string"), str(tmp_path / "out"), ["a"])
    lines = [x for f in sorted(os.listdir(tmp_path / "out")) if f.endswith(".json") for x in (tmp_path / "out" / f).read_text("utf-8").splitlines()]
    assert lines == ['{"a":1,"b":"é"}', '{"a":2,"b":null}']
    assert sinks.write_document(spark.range(1), str(tmp_path / "m.json")) == {"id": 0}
    sinks.register_dataset(str(tmp_path), "d", "d.jsonl")
    assert scans.require_dataset(str(tmp_path), "d")["file_name"] == "d.jsonl"
    with pytest.raises(KeyError):
        scans.require_dataset(str(tmp_path), "e")
    docs = tmp_path / "work" / "doc1" / "3" / "crops"
    docs.mkdir(parents=True)
    (docs / "3_final_001.PNG").write_bytes(b"x")
    got = scans.crop_tree(scans.image_files(spark, str(tmp_path / "work"))).select("doc", "page", "image").first()
    assert tuple(got) == ("doc1", "3", "3_final_001.PNG")
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "7_filtered.json").write_text(json.dumps({"k": 1}))
    (tmp_path / "j" / "8_filtered.json").write_text("{")
    got = scans.json_documents(spark, str(tmp_path / "j"), "k int").select("k", scans.page_of_name(F.col("file_name"))).collect()
    assert sorted((r[1], r[0]) for r in got) == [("7", 1), ("8", None)]


def filtered_png(width, height, rows_, kind):
    """A PNG whose lines all use one filter."""
    import struct
    import zlib

    raw, prev = b"", bytes(3 * width)
    for line in rows_:
        out = bytearray([kind])
        for i, v in enumerate(line):
            a, b, c = (line[i - 3] if i >= 3 else 0), prev[i], (prev[i - 3] if i >= 3 else 0)
            est = a + b - c
            near = min(((abs(est - a), 0, a), (abs(est - b), 1, b), (abs(est - c), 2, c)))[2]
            out.append((v - {0: 0, 1: a, 2: b, 3: (a + b) // 2, 4: near}[kind]) % 256)
        raw += bytes(out)
        prev = line
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    return png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    import random

    rnd = random.Random(kind)
    lines = [bytes(rnd.randrange(256) for _ in range(3 * 11)) for _ in range(7)]
    w, h, got = png.decode(filtered_png(11, 7, lines, kind))
    assert (w, h) == (11, 7) and got.tobytes() == b"".join(lines)
    assert png.decode(png.encode(w, h, got.tobytes()))[2].tobytes() == b"".join(lines)


def test_png_rejects(spark):
    for bad in (b"", b"x", png.SIGNATURE, png.encode(2, 2, bytes(12))[:-30]):
        with pytest.raises(png.BadImage):
            png.decode(bad)


def test_provider_errors_become_rows(spark):
    class Picky(providers.EchoProvider):
        def predict(self, prompts, images):
            if any("bad" in p for p in prompts):
                raise RuntimeError("no")
            return super().predict(prompts, images)

    df = spark.createDataFrame([("a", []), ("bad", []), (None, None)], "p string, i array<string>")
    got = {r["p"]: (r["predict"], r["error"]) for r in providers.generate(df, Picky, "p", "i", 2).collect()}
    assert got["a"] == ("[stub] a", None) and got["bad"] == (None, "RuntimeError: no") and got[None][1] is None


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "predict string, label string")
    assert scoring.iou_summary(scoring.scored_predictions(none, "predict", "label")).first()["mean_iou"] == 0.0
    assert scoring.judge_accuracy(none, "label").first()["accuracy"] is None

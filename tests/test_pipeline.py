import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from folioframe import pipeline
from folioframe.models import providers as pv
from folioframe.operators import jobs, regions
from folioframe.sources import scans


def judge():
    class Judge:
        """Deterministic answers of a test; a local class, so it travels to workers by value."""

        def load(self):
            pass

        def predict(self, prompts, images):
            return ['{"keep": true, "type": "table"}' if "complete" in p else "<qa><question>What?</question><answer>4</answer></qa>" for p in prompts]

    return Judge


def test_http_provider_asks_a_service_and_keeps_failures(spark):
    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            content = body["messages"][0]["content"]
            text = content if isinstance(content, str) else content[-1]["text"]
            self.send_response(500 if "fail" in text else 200)
            self.end_headers()
            if "fail" not in text:
                self.wfile.write(json.dumps({"choices": [{"message": {"content": f"{body['model']}: Correct {len(content) if isinstance(content, list) else 0}"}}]}).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    df = spark.createDataFrame([(1, "hi", ["u"]), (2, "fail", None), (3, None, [])], "k bigint, prompt string, images array<string>")
    got = {r["k"]: (r["predict"], r["error"] is None) for r in pv.generate(df, lambda: pv.HttpProvider(url, "m", wait=0.01), "prompt", "images").collect()}
    assert got == {1: ("m: Correct 2", True), 2: (None, False), 3: ("m: Correct 0", True)}
    stored = spark.createDataFrame([(1, "old", None, 0), (2, None, "x", 0)], "k bigint, predict string, error string, ord bigint")
    kept = {r["k"]: r["predict"] for r in pv.generate_answers(df, stored, lambda: pv.HttpProvider(url, "m", wait=0.01), "k", "prompt", "images", most_images=0).collect()}
    assert kept == {1: "old", 2: None, 3: "m: Correct 0"}
    judged = pv.judge_answers(df, lambda: pv.HttpProvider(url, "m", wait=0.01), "k", F.col("prompt"), F.lit("t"), F.lit("r")).collect()
    assert {r["k"]: r["judge"] for r in judged} == {1: "True", 2: None, 3: "True"}
    server.shutdown()


def test_a_missing_key_is_an_error():
    with pytest.raises(EnvironmentError):
        pv.HttpProvider("http://x", "m", "NO_SUCH_KEY_HERE").load()


def test_verdict_like_output_is_asked_again(spark):
    class Twice:
        def load(self):
            self.asked = 0

        def predict(self, prompts, images):
            self.asked += 1
            return ['{"keep": true}' if p == "odd" else "<qa><question>a</question><answer>b</answer></qa>" for p in prompts]

    df = spark.createDataFrame([(1, "odd", []), (2, "even", [])], "k bigint, prompt string, images array<string>")
    out = {r["k"]: (len(r["qas"]), r["retry"]) for r in pv.generate_pairs(df, Twice, "prompt", "images").collect()}
    assert out == {1: (0, True), 2: (1, False)}


def test_masks_to_training_rows(spark, tmp_path):
    masks = [("d", "1", 1, [10.0, 10.0, 300.0, 300.0], 800, 700, "x"), ("d", "1", 2, [12.0, 12.0, 280.0, 290.0], 800, 700, "x"), ("d", "1", 3, [0.0, 0.0, 5.0, 5.0], 800, 700, "x"), ("d", "2", 1, None, 800, 700, "x")]
    df = spark.createDataFrame(masks, pipeline.MASKS)
    run = pipeline.DocumentRun(spark, str(tmp_path / "run"), judge(), judge())
    assert run.run(df) == {"crops": 2, "verdicts": 2, "clean": 1, "questions": 1, "training": 1}
    row = spark.read.parquet(str(tmp_path / "run" / "training")).first()
    assert (row["query"], row["evidence_page"], row["bbox"], row["subimg_type"]) == ("What?", [1], [[[10, 10, 310, 310]]], [["table"]])
    with pytest.raises(Exception):  # the folder is there
        run.run(df)


def test_scores_and_metrics_of_files(spark, tmp_path):
    source = tmp_path / "p.jsonl"
    lines = [{"prompt": "q", "predict": "[[[0,0,10,10]]]", "label": "[[[0,0,10,10]]]"}, {"prompt": "q", "predict": "none", "label": "[[[0,0,10,10]]]"}]
    source.write_text("\n".join(map(json.dumps, lines)))
    got = pipeline.score_boxes(spark, str(source))
    assert (got["count"], got["parse_failures"], got["mean_iou"], got["mean_iou_valid"]) == (2, 1, 0.5, 1.0)
    assert json.loads((tmp_path / "p_iou_metrics.json").read_text()) == got
    assert pipeline.score_texts(spark, str(source), str(tmp_path / "t.json"))["exact_match"] == 0.5
    assert pipeline.judge_answers(spark, str(source), str(tmp_path / "judged"), pv.EchoProvider)["total"] == 2


def test_numbered_lines_follow_files_and_lines(spark, tmp_path):
    for name, start in (("a.jsonl", 0), ("b.jsonl", 500)):
        (tmp_path / name).write_text("\n".join(json.dumps({"k": start + i}) if i != 7 else "{broken" for i in range(500)) + "\n\n")
    rows = sorted(scans.numbered_lines(spark, str(tmp_path), "k bigint").collect(), key=lambda r: r["line_no"])
    good = [(r["line_no"], r["k"]) for r in rows if r["error"] is None]
    assert len(rows) == 1000 and [k for _, k in good] == sorted(k for _, k in good) and good[0] == (1, 0)
    assert [r["line_no"] for r in rows if r["error"] is not None][0] == 8


def test_documents_of_a_folder_win_over_a_single_file(spark, tmp_path):
    (tmp_path / "d").mkdir()
    one = tmp_path / "9_filtered.json"
    one.write_text('{"kept_ids": [9]}')
    assert [r["page"] for r in scans.filtered_documents(spark, "kept_ids array<int>", str(tmp_path / "d"), str(one)).collect()] == ["9"]
    (tmp_path / "d" / "2_filtered.json").write_text('{"kept_ids": [1]}')
    (tmp_path / "d" / "3_filtered.json").write_text('{"kept_')
    assert [r["page"] for r in scans.filtered_documents(spark, "kept_ids array<int>", str(tmp_path / "d"), str(one)).collect()] == ["2"]


def test_completion_and_statuses(spark):
    tasks = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "g string, k int")
    results = spark.createDataFrame([(1, False), (1, True), (2, False), (3, True)], "k int, ok boolean")
    assert {tuple(r) for r in jobs.completion(tasks, results, "g", "k").collect()} == {("a", 2, 1, 1, 0, "failed"), ("b", 1, 1, 0, 0, "done")}
    crops = spark.createDataFrame([("1", "a", "text", [0.0, 0.0, 9.0, 9.0]), ("1", "b", "text", [0.0, 0.0, 8.9, 9.0]), ("1", "c", "image", None)], "page string, name string, type string, box array<double>")
    listing = spark.createDataFrame([("1", "a"), ("1", "b")], "page string, name string")
    assert {(r["name"], r["status"]) for r in regions.crop_status(crops, listing).collect()} == {("a", "pruned"), ("b", "kept"), ("c", "missing")}

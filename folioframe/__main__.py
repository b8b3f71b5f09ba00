"""Command line: python -m folioframe <step> ...

Steps: iou, texts, judge, convert, run. Model calls need --url and --model; without
them the labelled stub answers.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from folioframe import pipeline
from folioframe.models.providers import EchoProvider, HttpProvider
from folioframe.sources import scans


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="folioframe", description=__doc__)
    steps = top.add_subparsers(dest="step", required=True)
    iou = steps.add_parser("iou", help="score predicted boxes")
    iou.add_argument("source")
    iou.add_argument("--scored")
    iou.add_argument("--metrics")
    texts = steps.add_parser("texts", help="score answer texts")
    texts.add_argument("source")
    texts.add_argument("metrics")
    judge = steps.add_parser("judge", help="judge answers with a model")
    judge.add_argument("source")
    judge.add_argument("out")
    convert = steps.add_parser("convert", help="annotations to chat samples")
    convert.add_argument("source")
    convert.add_argument("pages", help="parquet with category, doc_name, page, image")
    convert.add_argument("folder")
    convert.add_argument("name")
    convert.add_argument("--mode", choices=["page", "document", "bbox"], default="page")
    run = steps.add_parser("run", help="masks to training rows")
    run.add_argument("masks", help="JSON lines of masks")
    run.add_argument("folder")
    run.add_argument("--overwrite", action="store_true")
    for p in (judge, run):
        p.add_argument("--url")
        p.add_argument("--model")
        p.add_argument("--key-env")
    return top


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName(f"folioframe {a.step}").getOrCreate()
    make = None
    if a.step in ("judge", "run"):
        make = (lambda: HttpProvider(a.url, a.model, a.key_env)) if a.url else EchoProvider
    if a.step == "iou":
        out = pipeline.score_boxes(spark, a.source, a.scored, a.metrics)
    elif a.step == "texts":
        out = pipeline.score_texts(spark, a.source, a.metrics)
    elif a.step == "judge":
        out = pipeline.judge_answers(spark, a.source, a.out, make)
    elif a.step == "convert":
        out = pipeline.convert(spark, a.source, spark.read.parquet(a.pages), a.mode, a.folder, a.name)
    else:
        masks = scans.json_lines(spark, a.masks, pipeline.MASKS)
        out = pipeline.DocumentRun(spark, a.folder, make, make, "overwrite" if a.overwrite else "errorifexists").run(masks)
    print(json.dumps(out, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())

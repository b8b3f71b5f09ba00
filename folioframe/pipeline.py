"""Whole runs over files: evaluation, conversion to chat samples, crops, judging and question generation.

Every step reads and writes JSON lines or parquet, so any of them can be run
again on its own. Inference goes through a provider (``models.providers``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.functions import text as tx
from folioframe.models import providers
from folioframe.operators import chat, jobs, regions, scoring
from folioframe.plans.staging import release, stage
from folioframe.sources import scans, sinks

PREDICTIONS = "prompt string, predict string, label string"
ANNOTATIONS = (
    "query string, answer string, doc_name string, category string, evidence_page array<bigint>, bbox array<array<array<bigint>>>, "
    "rel_bbox array<array<array<double>>>, subimg_type array<array<string>>"
)
MASKS = "doc string, page string, mask_no bigint, bbox array<double>, width int, height int, image_path string"
QA_RECORDS = "doc_name string, image string, page array<bigint>, bbox array<bigint>, type string, qas array<struct<q:string,a:string,type:string,difficulty:string>>"


def score_boxes(spark: SparkSession, source: str, scored: str | None = None, metrics: str | None = None) -> dict:
    """Scores every prediction line of ``source``, writes the rows and the one metrics document."""
    names = sinks.output_paths(source)
    rows = stage(scoring.scored_predictions(scans.json_lines(spark, source, PREDICTIONS), "predict", "label"), "scored")
    sinks.write_json_lines(rows.drop("raw_sample_iou", "raw_page_iou"), scored or names["iou_scored"], mode="overwrite")
    return sinks.write_document(scoring.iou_summary(rows), metrics or names["iou_metrics"])


def score_texts(spark: SparkSession, source: str, metrics: str) -> dict:
    rows = scoring.text_scores(scans.json_lines(spark, source, PREDICTIONS), "predict", "label")
    return sinks.write_document(scoring.text_summary(rows, []), metrics)


def judge_answers(spark: SparkSession, source: str, out: str, make: Callable[[], providers.Provider]) -> dict:
    """Judges ``predict`` against ``label``; gives the accuracy."""
    rows = scans.numbered_lines(spark, source, PREDICTIONS).withColumn("question", tx.question_of_prompt(F.col("prompt")))
    judged = stage(providers.judge_answers(rows, make, "line_no", F.col("question"), F.col("label"), F.col("predict")), "judged")
    sinks.write_json_lines(judged, out, order=["line_no"], mode="overwrite")
    return scoring.judge_accuracy(judged, "judge").first().asDict()


def convert(spark: SparkSession, source: str, pages: DataFrame, mode: str, folder: str, name: str) -> dict:
    """Annotations to chat samples of one mode, registered in the catalogue of ``folder``; gives converted and skipped."""
    ann = scans.numbered_lines(spark, source, ANNOTATIONS).drop("error")
    if mode == "document":
        ann = ann.join(chat.document_images(pages), ["category", "doc_name"], "left")
    else:
        ann = ann.join(chat.page_images(ann, pages, "line_no", strict=True).select("line_no", "images"), "line_no", "left")
    samples = stage(chat.chat_samples(ann, mode), "chat-samples")
    sinks.write_json_lines(samples.drop("line_no"), f"{folder}/{name}", mode="overwrite")
    sinks.register_dataset(folder, name, name)
    total, n = ann.count(), samples.count()
    return {"converted": n, "skipped": total - n}


@dataclass
class DocumentRun:
    """Masks to questions: candidates, verdicts, cleaning, questions, training rows; every step's table is kept below ``folder``."""

    spark: SparkSession
    folder: str
    judge: Callable[[], providers.Provider]
    writer: Callable[[], providers.Provider]
    mode: str = "errorifexists"

    def _kept(self, df: DataFrame, step: str) -> DataFrame:
        path = f"{self.folder.rstrip('/')}/{step}"
        df.write.mode(self.mode).parquet(path)
        return self.spark.read.parquet(path)

    def crops(self, masks: DataFrame) -> DataFrame:
        return self._kept(regions.mask_candidates(masks), "crops")

    def verdicts(self, crops: DataFrame) -> DataFrame:
        asked = crops.withColumns({"prompt": F.lit("Is this crop a complete text, table or image?"), "images": F.array("name")})
        return self._kept(providers.judge_crops(asked, self.judge, "prompt", "images"), "verdicts")

    def clean(self, verdicts: DataFrame) -> DataFrame:
        """From the stored verdicts alone, so it can be replayed."""
        kept = verdicts.filter("keep").withColumn("page", F.concat_ws("/", "doc", "page"))
        out = regions.pruned(kept).withColumn("page", F.element_at(F.split("page", "/"), -1))
        return self._kept(out.drop("prompt", "images", "raw_output", "error", "keep"), "clean")

    def questions(self, clean: DataFrame) -> DataFrame:
        asked = clean.withColumns({"prompt": F.lit("Write questions about this crop."), "images": F.array("name")})
        return self._kept(providers.generate_pairs(asked, self.writer, "prompt", "images"), "questions")

    def training(self, questions: DataFrame) -> DataFrame:
        rec = questions.select(
            F.col("doc").alias("doc_name"), F.col("name").alias("image"), jobs.page_list(F.col("page")).alias("page"),
            F.transform("box", lambda v: v.cast("bigint")).alias("bbox"), "type", "qas",
        )
        return self._kept(chat.training_rows(rec), "training")

    def run(self, masks: DataFrame) -> dict[str, int]:
        counts = {}
        table = masks
        for step in (self.crops, self.verdicts, self.clean, self.questions, self.training):
            table = step(table)
            counts[step.__name__] = table.count()
        release(self.spark)
        return counts

"""Evaluation of predictions: boxes, answer texts and judge verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions import boxparse, matching
from folioframe.functions import text as tx
from folioframe.plans.staging import stage

THRESHOLDS = (0.3, 0.5, 0.7)


def _scores(sums: Column) -> dict[str, Column]:
    total = lambda f: F.aggregate(sums, F.lit(0.0), lambda acc, x: acc + f(x))
    larger = lambda x: F.greatest(x["n_gt"], x["n_pred"])
    boxes = F.greatest(total(lambda x: x["n_gt"]), total(lambda x: x["n_pred"]), F.lit(1.0))
    by_page = total(lambda x: F.when(larger(x) > 0, x["best"] / larger(x)).otherwise(0.0))
    return {"sample_iou": total(lambda x: x["best"]) / boxes, "page_iou": by_page / F.greatest(F.size(sums), F.lit(1))}


def with_scores(df: DataFrame, gt: str, pred: str) -> DataFrame:
    """Add sample_iou and page_iou of page-aligned boxes; a missing page counts as empty."""
    summed = matching.with_page_sums(df, gt, pred, "__sums")
    return summed.withColumns(_scores(F.col("__sums"))).drop("__sums")


def grouped_scores(df: DataFrame, key: str, gt: str, pred: str) -> DataFrame:
    """key, sample_iou, page_iou of page-aligned boxes."""
    return with_scores(df.select(key, gt, pred), gt, pred).select(key, "sample_iou", "page_iou")


def flat_scores(df: DataFrame, key: str, gt: str, pred: str) -> DataFrame:
    """key, sample_iou, page_iou with pages ignored: all boxes on one page (both scores are the same)."""
    one = df.select(key, F.array(F.flatten(gt)).alias(gt), F.array(F.flatten(pred)).alias(pred))
    return grouped_scores(one, key, gt, pred)


def scored_predictions(df: DataFrame, predict: str, label: str) -> DataFrame:
    """Input rows with parsed pages, mode, grouping, scores (6 digits) and error; unreadable rows score 0."""
    parsed = df.withColumn("__l", boxparse.parsed_label(F.col(label)))
    pages = F.col("__l.pages")
    single = F.coalesce(F.forall(pages, lambda p: F.size(p) == 1), F.lit(False))
    parsed = parsed.withColumn(
        "__p", boxparse.parsed_prediction(F.col(predict), F.coalesce(F.size(pages), F.lit(0)), single)
    )
    parsed = stage(parsed, "parsed-boxes")  # the texts are parsed once
    ok, grouped = F.col("__error").isNull(), F.col("__p.grouped")
    one_page = lambda c: F.when(grouped, c).otherwise(F.array(F.flatten(c)))
    parsed = parsed.withColumn("__error", F.coalesce("__l.error", "__p.error"))
    parsed = parsed.withColumns(
        {"__gt": F.when(ok, one_page(F.col("__l.pages"))), "__pred": F.when(ok, one_page(F.col("__p.pages")))}
    )
    scored = with_scores(parsed, "__gt", "__pred")
    s, p = (F.when(ok, F.col(c)).otherwise(0.0) for c in ("sample_iou", "page_iou"))
    return scored.select(
        *df.columns,
        F.when(ok, F.col("__p.pages")).alias("parsed_predict_pages"),
        F.when(ok, F.col("__l.pages")).alias("parsed_label_pages"),
        F.when(ok, F.col("__p.mode")).otherwise("parse_error").alias("predict_parse_mode"),
        F.coalesce(F.when(ok, grouped), F.lit(False)).alias("grouped_by_page"),
        s.alias("raw_sample_iou"), p.alias("raw_page_iou"), F.round(s, 6).alias("sample_iou"), F.round(p, 6).alias("page_iou"),
        F.col("__error").alias("error"),
    )


def _share(total: Column, n: Column, digits: int | None = 6) -> Column:
    value = F.when(n > 0, total / n).otherwise(0.0)
    return value if digits is None else F.round(value, digits)


def threshold_columns(score: Column, prefix: str = "") -> list[Column]:
    """Hits and rate per threshold on the unrounded score; failures count in the total."""
    out = []
    for t in THRESHOLDS:
        tag = f"{prefix}at_{int(t * 100)}"
        hits = F.count_if(score >= t)
        out += [hits.alias(f"hits_{tag}"), _share(hits, F.count("*")).alias(f"rate_{tag}")]
    return out


def iou_summary(scored: DataFrame) -> DataFrame:
    """One row: counts, means over all and over valid rows, threshold table."""
    ok = F.col("error").isNull()
    n, n_ok = F.count("*"), F.count_if(ok)
    s, p = F.col("raw_sample_iou"), F.col("raw_page_iou")
    return scored.agg(
        n.alias("count"), n_ok.alias("valid"), F.count_if(~ok).alias("parse_failures"),
        F.count_if(ok & F.col("grouped_by_page")).alias("grouped"), F.count_if(ok & ~F.col("grouped_by_page")).alias("flat"),
        _share(F.coalesce(F.sum(s), F.lit(0.0)), n).alias("mean_iou"), _share(F.coalesce(F.sum(p), F.lit(0.0)), n).alias("mean_page_iou"),
        _share(F.coalesce(F.sum(F.when(ok, s)), F.lit(0.0)), n_ok).alias("mean_iou_valid"),
        _share(F.coalesce(F.sum(F.when(ok, p)), F.lit(0.0)), n_ok).alias("mean_page_iou_valid"),
        *threshold_columns(s),
    )


def mode_histogram(scored: DataFrame) -> DataFrame:
    """Parse modes of valid rows."""
    return scored.filter("error is null").groupBy("predict_parse_mode").agg(F.count("*").alias("n"))


def text_scores(df: DataFrame, predict: str, label: str) -> DataFrame:
    p, r = F.col(predict), F.col(label)
    return df.withColumns(
        {
            "normalized_predict": tx.normalize(p), "normalized_label": tx.normalize(r),
            "exact_match": tx.exact_match(p, r), "contains_match": tx.contains_match(p, r), "anls": tx.anls(p, r),
        }
    )


def text_summary(scored: DataFrame, by: list[str]) -> DataFrame:
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0)).alias(c)
    return scored.groupBy(*by).agg(F.count("*").alias("samples"), mean("exact_match"), mean("contains_match"), mean("anls"))


def leaderboard(summary: DataFrame, name: str) -> DataFrame:
    return summary.orderBy(F.desc("anls"), F.desc("contains_match"), F.desc("exact_match"), F.asc(name))


def judge_accuracy(df: DataFrame, verdict_text: str) -> DataFrame:
    """Counts of true, false and unknown verdicts and the share of true ones of all rows (null without rows)."""
    v = tx.verdict(F.col(verdict_text))
    hits = F.count_if(v == "True")
    return df.agg(
        F.count("*").alias("total"), hits.alias("n_true"), F.count_if(v == "False").alias("n_false"),
        F.count_if(v.isNull() | ~v.isin("True", "False")).alias("n_unknown"),
        F.when(F.count("*") > 0, F.round(hits / F.count("*"), 6)).alias("accuracy"),
    )


def generation_metrics(scored: DataFrame, metrics: list[str], runtime: float, preparation: float, batch: int) -> DataFrame:
    """One row: the mean of every metric column, run times, samples and steps (batches) per second."""
    n = F.count("*")
    per_second = lambda c: (c / F.lit(runtime)) if runtime > 0 else F.lit(0.0)
    return scored.agg(
        *[F.coalesce(F.avg(m), F.lit(0.0)).alias(f"predict_{m}") for m in sorted(metrics)],
        F.lit(float(preparation)).alias("predict_model_preparation_time"), F.lit(float(runtime)).alias("predict_runtime"),
        per_second(n).alias("predict_samples_per_second"), per_second(F.ceil(n / batch)).alias("predict_steps_per_second"),
    )

"""Work lists over documents: valid jobs, completion, replays, and what is still to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Files a finished model run leaves; a run without one of them is done again.
RUN_FILES = ("generated_predictions.jsonl", "scored_predictions.jsonl", "metrics.json")


def image_path(root: str, doc: Column, page: Column, image: Column, folder: str = "clean_crops") -> Column:
    """<root>/<doc>/<page>/<folder>/<image>"""
    return F.concat_ws("/", F.lit(root.rstrip("/")), doc, page, F.lit(folder), image)


def valid_jobs(records: DataFrame, listing: DataFrame, root: str) -> DataFrame:
    """Records (doc, page, image, type, bbox) with all three names filled whose file is in ``listing`` (path)."""
    filled = F.lit(True)
    for c in ("doc", "page", "image"):
        filled = filled & F.coalesce(F.col(c) != "", F.lit(False))
    named = records.filter(filled).withColumn("image_path", image_path(root, F.col("doc"), F.col("page"), F.col("image")))
    known = listing.select(F.col("path").alias("image_path"))
    return named.join(known, "image_path", "left_semi").withColumn("type", F.coalesce("type", F.lit("unknown")))


def jobs_by_document(jobs: DataFrame, order: list[str], block: int = 1000) -> DataFrame:
    """doc, block, jobs: the jobs of a document in order, in lists of at most ``block`` (a hot document has many)."""
    fields = [c for c in jobs.columns if c != "doc"]
    # blocks are cut by hash, so numbering within a document needs no sort of all its rows in one task
    sizes = jobs.groupBy("doc").agg(F.ceil(F.count("*") / block).alias("blocks"))
    keyed = jobs.join(sizes, "doc").withColumn("block", F.pmod(F.xxhash64(*order), F.col("blocks")))
    rows = F.sort_array(F.collect_list(F.struct(*order, *[c for c in fields if c not in order])))
    return keyed.groupBy("doc", "block").agg(rows.alias("jobs"))


def completion(tasks: DataFrame, results: DataFrame, group: str, key: str) -> DataFrame:
    """Per group: tasks, successes, failures, tasks still open, and its state. ``results`` has key and ok; the last counts if any success."""
    best = results.groupBy(key).agg(F.max("ok").alias("ok"))
    both = tasks.select(group, key).distinct().join(best, key, "left")
    return both.groupBy(group).agg(
        F.count("*").alias("total"), F.count_if(F.col("ok")).alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"),
        F.count_if(F.col("ok").isNull()).alias("remaining"),
        F.when(F.count_if(F.col("ok").isNull()) > 0, "running").when(F.count_if(~F.col("ok")) > 0, "failed").otherwise("done").alias("state"),
    )


def pending_runs(models: DataFrame, listing: DataFrame, required: tuple[str, ...] = RUN_FILES) -> DataFrame:
    """Models (name) that lack one of the required files in ``listing`` (name, file)."""
    there = listing.filter(F.col("file").isin(*required)).groupBy("name").agg(F.count_distinct("file").alias("n"))
    return models.join(there.filter(F.col("n") == len(required)), "name", "left_anti")


def kept_and_skipped(df: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, one row with the numbers of rows converted and skipped); null counts as not kept."""
    stays = F.coalesce(keep, F.lit(False))
    return df.filter(stays), df.agg(F.count_if(stays).alias("converted"), F.count_if(~stays).alias("skipped"))


def length_order(page: str) -> list[Column]:
    """Short names first, equal lengths by code points: 1, 2, 10."""
    return [F.length(page), F.col(page)]


def in_order(df: DataFrame, group: list[str], order: list[Column], out: str = "position") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def page_sets(images: DataFrame, root: str) -> DataFrame:
    """PNGs below ``root`` with their set: the root itself for those in it, else the folder right below it."""
    rel = F.regexp_replace("path", r"^.*?\Q" + root.strip("/") + r"\E/", "")
    out = images.filter(F.lower("path").endswith(".png"))
    return out.withColumn("page_set", F.when(F.contains(rel, F.lit("/")), F.split_part(rel, F.lit("/"), F.lit(1))).otherwise(F.lit(root.strip("/").rsplit("/", 1)[-1])))


def page_list(raw: Column) -> Column:
    """Pages of a JSON text: whole numbers of a list, a single number or numeral, else none."""
    v = F.try_parse_json(raw)
    none = F.array().cast("array<bigint>")
    kind = F.schema_of_variant(v)
    # numerals in quotes are texts: a list keeps numbers only
    bare = F.regexp_replace(raw, r'"(?:[^"\\]|\\.)*"', "null")
    items = F.filter(F.from_json(bare, "array<string>"), lambda x: x.rlike(r"^-?\d+$"))
    one = F.when(kind == "STRING", F.trim(F.try_variant_get(v, "$", "string"))).otherwise(F.try_variant_get(v, "$", "string"))
    whole = F.when(kind.isin("STRING"), F.when(one.rlike(r"^[-+]?\d+$"), one.try_cast("bigint"))).otherwise(one.try_cast("double").cast("bigint"))
    return F.coalesce(
        F.when(F.startswith(kind, F.lit("ARRAY")), F.transform(items, lambda x: x.cast("bigint"))).when(whole.isNotNull(), F.array(whole)), none
    )

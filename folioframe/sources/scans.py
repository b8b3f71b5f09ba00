"""Scans: JSON lines, JSON documents, file trees and images."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.operators.rows import with_ordinal
from folioframe.plans.staging import stage

IMAGE_NAMES = r"(?i)\.(png|jpe?g|webp|bmp)$"


def json_lines(spark: SparkSession, path: str | list[str], schema: str, mode: str = "FAILFAST") -> DataFrame:
    """Typed JSON lines. FAILFAST stops at a malformed line, DROPMALFORMED leaves it out; blank lines are ignored."""
    return spark.read.schema(schema).option("mode", mode).json(path)


def numbered_lines(spark: SparkSession, path: str, schema: str, skip_blank: bool = True) -> DataFrame:
    """JSON lines of one file set with ``line_no`` (1-based, in file and line order) and ``error`` for malformed ones.

    Lines get their order while they are read (the splits of a file are read in
    order); the numbers come from a range-partitioned count, not from one task.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), "value"
    )
    df = with_ordinal(stage(lines, "lines"), ["file", "start", "at"], out="line_no").select("line_no", "value")
    if skip_blank:
        df = df.filter(F.trim("value") != "")
    parsed = F.from_json("value", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    out = df.withColumn("r", parsed)
    names = [f.name for f in out.schema["r"].dataType.fields if f.name != "_bad"]
    return out.select("line_no", *[F.col("r")[n].alias(n) for n in names], F.col("r._bad").alias("error"))


def json_documents(spark: SparkSession, path: str, schema: str, pattern: str = "*.json") -> DataFrame:
    """One JSON document per file; unreadable files give rows of nulls with their text in ``_bad``. ``file_path`` and ``file_name`` are added."""
    out = (
        spark.read.schema(schema + ", _bad string").option("multiLine", True).option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True).option("columnNameOfCorruptRecord", "_bad").json(path)
    )
    return out.withColumns({"file_path": F.col("_metadata.file_path"), "file_name": F.col("_metadata.file_name")})


def files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """path, length, modificationTime, content of files by name pattern."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    return reader.option("recursiveFileLookup", recursive).load(path)


def listing(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """path, length, modificationTime of files; their contents are not read."""
    return files(spark, path, pattern, recursive).select("path", "length", "modificationTime")


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """Listing of images, in the order of their paths."""
    return listing(spark, path).filter(F.col("path").rlike(IMAGE_NAMES)).orderBy("path")


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """PDFs of one folder (not below it); a single file counts in any letter case."""
    single = path.lower().endswith(".pdf")
    return listing(spark, path, "*.[pP][dD][fF]" if single else "*.pdf", recursive=False).orderBy("path")


def json_lines_tree(spark: SparkSession, patterns: list[str], schema: str) -> DataFrame:
    """JSON lines of several path patterns; a file matched twice is listed, and so read, once. ``file_path`` is added."""
    conf = spark._jsc.hadoopConfiguration()
    paths: dict[str, None] = {}
    for p in patterns:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        for status in at.getFileSystem(conf).globStatus(at) or []:
            paths[status.getPath().toString()] = None
    if not paths:
        return spark.createDataFrame([], schema + ", file_path string")
    return spark.read.schema(schema).json(list(paths)).withColumn("file_path", F.col("_metadata.file_path"))


def filtered_documents(spark: SparkSession, schema: str, folder: str | None, single: str | None) -> DataFrame:
    """Documents by page (from the file name): those of ``folder`` where it has any, else of the single file; unreadable ones of a folder are left out."""
    if folder is not None:
        found = stage(json_documents(spark, folder, schema, "*_filtered.json"), "filtered").filter("_bad is null")
        if found.limit(1).count():
            return found.withColumn("page", page_of_name(F.col("file_name")))
    if single is None:
        raise FileNotFoundError("no readable *_filtered.json")
    one = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(single)
    return one.withColumn("page", page_of_name(F.col("_metadata.file_name")))


def page_of_name(name: Column) -> Column:
    """Leading digits before an underscore, else the stem up to the first underscore."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    digits = F.regexp_extract(stem, r"^(\d+)_", 1)
    return F.when(digits != "", digits).otherwise(F.split_part(stem, F.lit("_"), F.lit(1)))


def document_of_path(path: Column, base: str) -> Column:
    """First folder below ``base``; the parent folder where the file lies in ``base`` itself."""
    rel = F.regexp_replace(path, r"^.*?" + base.rstrip("/").replace(".", r"\.") + "/", "")
    return F.when(F.contains(rel, F.lit("/")), F.split_part(rel, F.lit("/"), F.lit(1))).otherwise(F.element_at(F.split(path, "/"), -2))


def crop_tree(df: DataFrame, folder: str = "crops") -> DataFrame:
    """doc and page columns of paths ``.../<doc>/<page>/<folder>/<image>``; other paths drop out."""
    rx = rf"([^/]+)/([^/]+)/{folder}/([^/]+)$"
    part = lambda i: F.regexp_extract("path", rx, i)
    return df.withColumns({"doc": part(1), "page": part(2), "image": part(3)}).filter("image <> ''")


def small_json(path: str, default=None):
    """A small JSON document on the driver; ``default`` where it is missing or unreadable."""
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except (OSError, ValueError):
        return default


def type_map(spark: SparkSession, path: str) -> DataFrame:
    """image, type of a JSON object of a few thousand entries; empty where it is missing or unreadable."""
    got = small_json(path, {})
    rows = [(str(k), str(v)) for k, v in got.items()] if isinstance(got, dict) else []
    return spark.createDataFrame(rows, "image string, type string")


def model_catalog(path: str) -> list[dict]:
    """Model configurations; anything but a list is an error."""
    with open(path, encoding="utf-8") as f:
        got = json.load(f)
    if not isinstance(got, list):
        raise ValueError("a model catalogue is a JSON list")
    return got


def require_dataset(folder: str, name: str) -> dict:
    """The entry of a registered dataset."""
    path = os.path.join(folder, "dataset_info.json")
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    got = small_json(path, {})
    if name not in got:
        raise KeyError(f"{name} is not registered in {path}")
    return got[name]

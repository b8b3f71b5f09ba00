"""Sinks: JSON lines, metric documents, leaderboards and the dataset catalogue."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str, order: list[str] | None = None, mode: str = "errorifexists") -> None:
    """JSON lines with explicit nulls. With ``order`` the files are sorted ranges, so reading them in name order keeps the rows' order."""
    out = df if order is None else df.orderBy(*order)
    out.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_document(df: DataFrame, path: str) -> dict:
    """The one row of ``df`` as a JSON document."""
    rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a metrics document has one row")
    doc = json.loads(rows[0]["j"])
    tmp = f"{path}.tmp"
    with open(tmp, "w", encoding="utf-8") as f:
        json.dump(doc, f, ensure_ascii=False, indent=2)
    os.replace(tmp, path)
    return doc


def write_leaderboard(df: DataFrame, folder: str) -> None:
    """A leaderboard (a row per model) as CSV with header and as JSON."""
    one = df.coalesce(1)
    one.write.mode("overwrite").option("header", True).csv(f"{folder}/summary_csv")
    one.write.mode("overwrite").option("ignoreNullFields", False).json(f"{folder}/summary_json")


def register_dataset(folder: str, name: str, file_name: str) -> dict:
    """Insert or replace a chat dataset in the folder's catalogue."""
    path = os.path.join(folder, "dataset_info.json")
    catalog: dict = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            catalog = json.load(f)
    # fixed values: an entry of the catalogue's format
    catalog[name] = {
        "file_name": file_name,
        "formatting": "sharegpt",
        "columns": {"messages": "messages", "images": "images"},
        "tags": {"role_tag": "role", "content_tag": "content", "user_tag": "user", "assistant_tag": "assistant"},
    }
    os.makedirs(folder, exist_ok=True)
    tmp = f"{path}.tmp"
    with open(tmp, "w", encoding="utf-8") as f:
        json.dump(catalog, f, ensure_ascii=False, indent=2)
    os.replace(tmp, path)
    return catalog


def output_paths(source: str) -> dict[str, str]:
    """Derived names beside an input file; the endings are fixed values."""
    stem, _ = os.path.splitext(source)
    return {"iou_scored": f"{stem}_iou_scored.jsonl", "iou_metrics": f"{stem}_iou_metrics.json", "judged": f"{stem}_judged.jsonl"}

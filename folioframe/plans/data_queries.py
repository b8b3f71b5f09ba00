"""Registered queries of the data-keeping problems 1, 2 and 5, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.operators import compaction, references, shredding
from folioframe.plans.staging import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return shredding.payload_children(table(spark, d, "raw_records")).distinct()


def p1_boxes(spark: SparkSession, d: str) -> DataFrame:
    return shredding.payload_tables(table(spark, d, "raw_records"))["box"]


def p1_parts(spark: SparkSession, d: str) -> DataFrame:
    return shredding.payload_tables(table(spark, d, "raw_records"))["part"]


def p1_chat_children(spark: SparkSession, d: str) -> DataFrame:
    return shredding.typed_children(table(spark, d, "chat_samples"), "sample_id", "ingested_at")


def p1_chat_boxes(spark: SparkSession, d: str) -> DataFrame:
    return shredding.typed_tables(table(spark, d, "chat_samples"), "sample_id", "ingested_at")["box"]


def p1_chat_parts(spark: SparkSession, d: str) -> DataFrame:
    return shredding.typed_tables(table(spark, d, "chat_samples"), "sample_id", "ingested_at")["part"]


def _ref_tables(spark: SparkSession, d: str) -> list[DataFrame]:
    names = ["chat_samples", "bench_annotations", "qa_records", "doc_catalog", "page_images"]
    return [table(spark, d, n) for n in names]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_list(*_ref_tables(spark, d))


def p2_orphan_counts(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_counts(*_ref_tables(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return compaction.consolidated_keys(table(spark, d, "tiny_files"))


def p5_manifest(spark: SparkSession, d: str) -> DataFrame:
    folder = compaction.consolidate(table(spark, d, "tiny_files"))
    return spark.read.parquet(f"{folder}/manifest").select(
        "out_group", F.col("n_records"), F.col("n_bytes")
    )


QUERIES = {
    "p1_found": p1_found,
    "p1_boxes": p1_boxes,
    "p1_parts": p1_parts,
    "p1_chat_children": p1_chat_children,
    "p1_chat_boxes": p1_chat_boxes,
    "p1_chat_parts": p1_chat_parts,
    "p2_found": p2_found,
    "p2_orphan_counts": p2_orphan_counts,
    "p5_found": p5_found,
    "p5_manifest": p5_manifest,
}

_REFS = """
refs AS (
  SELECT 'chat_samples' ref_table, sample_id ref_id, 'doc_name' ref_field, 0 item_pos, 'doc' kind, doc_name k, -1 p, created_at t
  FROM chat_samples WHERE doc_name IS NOT NULL
  UNION ALL SELECT 'bench_annotations', ann_id, 'doc_name', 0, 'doc', doc_name, -1, created_at
  FROM bench_annotations WHERE doc_name IS NOT NULL
  UNION ALL SELECT 'qa_records', record_id, 'doc_name', 0, 'doc', doc_name, -1, created_at
  FROM qa_records WHERE doc_name IS NOT NULL
  UNION ALL SELECT 'chat_samples', sample_id, 'evidence_page', i - 1, 'page', doc_name, evidence_page[i], created_at
  FROM (SELECT *, unnest(range(1, len(evidence_page) + 1)) i FROM chat_samples) WHERE doc_name IS NOT NULL AND evidence_page[i] IS NOT NULL
  UNION ALL SELECT 'bench_annotations', ann_id, 'evidence_page', i - 1, 'page', doc_name, evidence_page[i], created_at
  FROM (SELECT *, unnest(range(1, len(evidence_page) + 1)) i FROM bench_annotations) WHERE doc_name IS NOT NULL AND evidence_page[i] IS NOT NULL
  UNION ALL SELECT 'chat_samples', sample_id, 'images', i - 1, 'image', images[i], -1, created_at
  FROM (SELECT *, unnest(range(1, len(images) + 1)) i FROM chat_samples WHERE coalesce(image_mode, '') <> 'crop') WHERE images[i] IS NOT NULL
), targets AS (
  SELECT 'doc' kind, doc_name k, -1 p, registered_at s, deleted_at e FROM doc_catalog
  UNION ALL SELECT 'page', doc_name, page, registered_at, deleted_at FROM page_images
  UNION ALL SELECT 'image', image, -1, registered_at, deleted_at FROM page_images
), orphan AS (
  SELECT DISTINCT ref_table, ref_id, ref_field, item_pos, t FROM refs r WHERE NOT EXISTS (
    SELECT 1 FROM targets g WHERE g.kind = r.kind AND g.k = r.k AND g.p = r.p AND g.s <= r.t AND (g.e IS NULL OR r.t < g.e)))
"""

_LAST = """last AS (SELECT sample_id AS record_id, arg_max(struct_pack(b := bbox, t := subimg_type, m := messages), ingested_at) x FROM chat_samples
  WHERE sample_id IS NOT NULL GROUP BY sample_id)"""
_BOX = f"""{_LAST}, pages AS (SELECT record_id, x.t t, x.b b, unnest(range(1, len(x.b) + 1)) i FROM last),
 each AS (SELECT record_id, t, i, b[i] p, unnest(range(1, len(b[i]) + 1)) j FROM pages),
 box AS (SELECT record_id, i - 1 AS pages_pos, j - 1 AS boxes_pos, p[j] v, nullif(lower(trim(t[i][j])), '') AS label FROM each
  WHERE len(p[j]) = 4 AND len(list_filter(p[j], lambda c: c IS NULL)) = 0)"""
_MESSAGE = """message AS (SELECT record_id, i - 1 AS messages_pos, m FROM (SELECT record_id, i, x.m[i] m FROM (SELECT *, unnest(range(1, len(x.m) + 1)) i FROM last)) WHERE m IS NOT NULL)"""

ORACLES = {
    "p1_chat_children": f"""WITH {_BOX}, {_MESSAGE}
      SELECT record_id, 'box' child, pages_pos outer_pos, boxes_pos inner_pos, coalesce(label, 'unknown') child_label FROM box
      UNION ALL SELECT record_id, 'message', messages_pos, CAST(0 AS BIGINT), coalesce(m.role, 'unknown') FROM message
      UNION ALL SELECT record_id, 'part', messages_pos, CAST(0 AS BIGINT), 'text' FROM message WHERE m.content IS NOT NULL""",
    "p1_chat_boxes": f"""WITH {_BOX} SELECT record_id, pages_pos, boxes_pos, CAST(v[1] AS DOUBLE) x1, CAST(v[2] AS DOUBLE) y1,
      CAST(v[3] AS DOUBLE) x2, CAST(v[4] AS DOUBLE) y2, label FROM box""",
    "p1_chat_parts": f"""WITH {_LAST}, {_MESSAGE} SELECT record_id, messages_pos, CAST(0 AS BIGINT) parts_pos, 'text' kind, m.content AS text
      FROM message WHERE m.content IS NOT NULL""",
    "p2_found": f"WITH {_REFS} SELECT DISTINCT ref_table, ref_id, ref_field, CAST(item_pos AS BIGINT) item_pos FROM orphan",
    "p2_orphan_counts": f"""WITH {_REFS} SELECT ref_table, ref_field, period, count(*) n_orphans FROM (
      SELECT DISTINCT ref_table, ref_id, ref_field, item_pos, coalesce(strftime(t, '%Y-%m'), '') period FROM orphan) GROUP BY ALL""",
}

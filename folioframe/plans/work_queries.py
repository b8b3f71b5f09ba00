"""Registered queries of scans, work lists, statuses and parsing cases, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.functions import geometry
from folioframe.functions import text as tx
from folioframe.operators import jobs, regions, rows, scoring
from folioframe.plans import page_queries as pq
from folioframe.plans.page_queries import query
from folioframe.plans.staging import new_folder, table
from folioframe.sources import scans, sinks

# -- work lists ------------------------------------------------------------------------------------

_JOBS_SQL = """job AS (SELECT DISTINCT record_id, doc_name AS doc, page, image, coalesce(subimg_type, 'unknown') AS type, concat('work/', doc_name, '/', page, '/clean_crops/', image) AS image_path
  FROM qa_records WHERE doc_name <> '' AND page <> '' AND image <> ''),
 listed AS (SELECT DISTINCT concat('work/', doc_name, '/', page, '/clean_crops/', image) AS path FROM qa_records WHERE record_id % 5 <> 0 AND doc_name IS NOT NULL AND page IS NOT NULL AND image IS NOT NULL),
 good AS (SELECT * FROM job WHERE image_path IN (SELECT path FROM listed))"""


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    qa = table(spark, d, "qa_records").select("record_id", F.col("doc_name").alias("doc"), "page", "image", F.col("subimg_type").alias("type"))
    path = jobs.image_path("work/", F.col("doc"), F.col("page"), F.col("image"))
    listing = qa.filter("record_id % 5 <> 0").select(path.alias("path"))
    return jobs.valid_jobs(qa, listing, "work/").distinct()


@query(f"WITH {_JOBS_SQL} SELECT record_id, doc, page, image, type, image_path FROM good")
def job_rows(spark: SparkSession, d: str) -> DataFrame:
    return _jobs(spark, d).select("record_id", "doc", "page", "image", "type", "image_path")


@query(f"WITH {_JOBS_SQL} SELECT doc, count(*) AS n_jobs, min(record_id) AS first_job, max(record_id) AS last_job FROM good GROUP BY doc")
def jobs_per_document(spark: SparkSession, d: str) -> DataFrame:
    blocks = jobs.jobs_by_document(_jobs(spark, d), ["record_id", "image"])
    flat = blocks.select("doc", F.size("jobs").alias("n"), F.col("jobs")[0]["record_id"].alias("a"), F.element_at("jobs", -1)["record_id"].alias("b"))
    return flat.groupBy("doc").agg(F.sum("n").alias("n_jobs"), F.min("a").alias("first_job"), F.max("b").alias("last_job"))


@query("""WITH r AS (SELECT event_id, max(event_id % 7 <> 0) ok FROM events WHERE event_id % 4 <> 0 GROUP BY event_id), b AS (SELECT event_type AS task_set, e.event_id, ok FROM events e LEFT JOIN r USING (event_id))
 SELECT task_set, count(*) AS total, count(*) FILTER (WHERE ok) AS succeeded, count(*) FILTER (WHERE NOT ok) AS failed, count(*) FILTER (WHERE ok IS NULL) AS remaining,
  CASE WHEN count(*) FILTER (WHERE ok IS NULL) > 0 THEN 'running' WHEN count(*) FILTER (WHERE NOT ok) > 0 THEN 'failed' ELSE 'done' END AS state FROM b GROUP BY task_set""")
def completion_counts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    tasks = e.select(F.col("event_type").alias("task_set"), "event_id")
    results = e.filter("event_id % 4 <> 0").select("event_id", (F.col("event_id") % 7 != 0).alias("ok"))
    return jobs.completion(tasks, results, "task_set", "event_id")


@query("SELECT n_name AS name FROM nation WHERE NOT (n_nationkey % 2 = 0 AND n_nationkey % 3 = 0)")
def pending_runs(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("k"))
    parts = [n.filter(cond).select("name", F.lit(f).alias("file")) for f, cond in zip(jobs.RUN_FILES, ("k % 2 = 0", "k % 3 = 0", "k >= 0"))]
    other = n.select("name", F.lit("notes.txt").alias("file"))
    return jobs.pending_runs(n.select("name"), parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[0]).unionByName(other))


@query("""SELECT mode, count(*) FILTER (WHERE n_images > 0 AND (mode = 'page' OR target)) AS converted, count(*) FILTER (WHERE NOT (n_images > 0 AND (mode = 'page' OR target))) AS skipped
  FROM (SELECT coalesce(len(evidence_page), 0) AS n_images, coalesce(len(list_filter(rel_bbox, lambda p: len(list_filter(p, lambda b: len(b) = 4)) > 0)), 0) > 0 AS target, mode FROM bench_annotations, (VALUES ('page'), ('bbox')) m(mode))
  GROUP BY mode""")
def skip_counts(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "bench_annotations").select("evidence_page", "rel_bbox")
    images = F.coalesce(F.size("evidence_page"), F.lit(0)) > 0
    out = None
    for mode, keep in (("page", images), ("bbox", images & geometry.bbox_target(F.col("rel_bbox")).isNotNull())):
        one = jobs.kept_and_skipped(b, keep)[1].select(F.lit(mode).alias("mode"), "converted", "skipped")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT doc_name, page, row_number() OVER (PARTITION BY doc_name ORDER BY length(page), page) AS position FROM (SELECT DISTINCT doc_name, page FROM qa_records WHERE page IS NOT NULL)")
def page_positions(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "qa_records").filter("page is not null").select("doc_name", "page").distinct()
    return jobs.in_order(pages, ["doc_name"], jobs.length_order("page"))


@query("""SELECT record_id, doc_name, row_number() OVER (PARTITION BY doc_name ORDER BY coalesce(try_cast(nullif(regexp_replace(page, '[^0-9]', '', 'g'), '') AS BIGINT), 1000000000), page, image, record_id) AS position
  FROM (SELECT DISTINCT record_id, doc_name, page, image FROM qa_records WHERE image IS NOT NULL AND page IS NOT NULL)""")
def merged_order(spark: SparkSession, d: str) -> DataFrame:
    qa = table(spark, d, "qa_records").filter("image is not null and page is not null").select("record_id", "doc_name", "page", "image").distinct()
    order = [*regions.page_order(), F.col("image"), F.col("record_id")]
    return jobs.in_order(qa, ["doc_name"], order).select("record_id", "doc_name", "position")


@query("""SELECT path, CASE WHEN contains(rel, '/') THEN split_part(rel, '/', 1) ELSE 'pages' END AS page_set FROM (SELECT path, replace(path, '/data/pages/', '') AS rel FROM
  (SELECT DISTINCT CASE WHEN page % 5 = 0 THEN concat('/data/pages/', page, '.PNG') ELSE concat('/data/pages/', image) END AS path FROM page_images WHERE image IS NOT NULL AND page IS NOT NULL)) WHERE lower(path) LIKE '%.png'""")
def page_set_names(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "page_images").filter("image is not null and page is not null")
    path = F.when(F.col("page") % 5 == 0, F.concat(F.lit("/data/pages/"), F.col("page").cast("string"), F.lit(".PNG"))).otherwise(F.concat(F.lit("/data/pages/"), "image"))
    return jobs.page_sets(p.select(path.alias("path")).distinct(), "/data/pages")


@query("SELECT sample_id, row_number() OVER (ORDER BY sample_id) AS position FROM (SELECT DISTINCT sample_id FROM chat_samples WHERE len(images) > 1) ORDER BY sample_id LIMIT 250")
def first_successes(spark: SparkSession, d: str) -> DataFrame:
    """The limit is the feature: rows that fail don't count."""
    c = table(spark, d, "chat_samples").filter("sample_id is not null").groupBy("sample_id").agg(F.max(F.coalesce(F.size("images") > 1, F.lit(False))).alias("ok"))
    got = rows.first_successes(c, "ok", "sample_id", 250)
    return rows.with_ordinal(got.select("sample_id"), ["sample_id"], out="position")


# -- statuses, masks and replays ---------------------------------------------------------------------

_MASKS_SQL = """masks AS (SELECT l_orderkey AS page, CAST(l_linenumber AS BIGINT) AS id, min(l_partkey) AS pk FROM lineitem GROUP BY ALL)"""


def _masks(spark: SparkSession, d: str) -> DataFrame:
    """All rows of lineitem as masks: line numbers repeat within an order, so the first of them counts."""
    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").cast("bigint").alias("id"), F.col("l_partkey").alias("ord"))
    side = F.col("ord") % 50
    return m.withColumn("box", geometry.box(F.col("id") * 3, F.col("id") % 4, 120 + side, 90 + side))


@query(f"""WITH {_MASKS_SQL}, v AS (SELECT DISTINCT l_orderkey AS page, CAST(l_linenumber + 1 AS BIGINT) AS id FROM lineitem)
 SELECT v.page, v.id, CAST(v.id * 3 AS DOUBLE) AS x1, CAST(120 + pk % 50 AS DOUBLE) AS x2 FROM v JOIN masks USING (page, id)
 UNION ALL SELECT v.page, v.id, NULL, NULL FROM v WHERE NOT EXISTS (SELECT 1 FROM masks m WHERE m.page = v.page AND m.id = v.id)""")
def first_masks(spark: SparkSession, d: str) -> DataFrame:
    masks = _masks(spark, d)
    verdicts = masks.select("page", (F.col("id") + 1).alias("id")).distinct()
    out = regions.with_masks(verdicts, masks)
    return out.select("page", "id", F.col("box")[0].cast("double").alias("x1"), F.col("box")[2].cast("double").alias("x2"))


@query(f"WITH {pq._CROPS_SQL} SELECT c.page, name, type, CASE WHEN CAST(split_part(c.page, '/', 1) AS BIGINT) % 10 = 0 THEN 'missing' WHEN list_contains(gone, name) THEN 'pruned' ELSE 'kept' END AS status FROM crops c LEFT JOIN folded ON folded.page = c.page")
def crop_states(spark: SparkSession, d: str) -> DataFrame:
    crops = pq._crops(spark, d)
    listing = crops.filter(F.split_part("page", F.lit("/"), F.lit(1)).cast("bigint") % 10 != 0)
    return regions.crop_status(crops, listing).select("page", "name", "type", "status")


_STORED_TEXT = """{"keep": %s, "type": "%s"}"""


@query(f"""WITH {_MASKS_SQL}, c AS (SELECT CAST(page AS VARCHAR) AS page, id, printf('%d_final_%03d.png', page, id) AS name, pk, CASE pk % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'table' ELSE 'image' END AS type,
   id * 3 x1, id % 4 y1, 120 + pk % 50 x2, 90 + pk % 50 y2 FROM masks WHERE pk % 6 <> 0),
 sized AS (SELECT *, greatest(0, x2 - x1) * greatest(0, y2 - y1) s FROM c),
 pairs AS (SELECT a.page, a.name an, b.name bn, CASE WHEN (a.type = 'text' AND a.s >= b.s) OR (a.type <> 'text' AND a.s <= b.s) THEN a.name ELSE b.name END dn
  FROM sized a JOIN sized b ON a.page = b.page AND a.type = b.type AND a.name < b.name AND least(a.s, b.s) > 0 AND
  10 * greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) >= 9 * least(a.s, b.s)),
 folded AS (SELECT page, list_reduce(list([an, bn, dn] ORDER BY an, bn), lambda acc, x: CASE WHEN list_contains(acc, x[1]) OR list_contains(acc, x[2]) THEN acc
   ELSE list_append(acc, x[3]) END, CAST([] AS VARCHAR[])) gone FROM pairs GROUP BY page)
 SELECT c.page, c.id, c.type FROM c LEFT JOIN folded ON folded.page = c.page WHERE gone IS NULL OR NOT list_contains(gone, name)""")
def replayed_cleaning(spark: SparkSession, d: str) -> DataFrame:
    masks = _masks(spark, d).withColumn("page", F.col("page").cast("string"))
    first = masks.groupBy("page", "id").agg(F.min("ord").alias("pk"))
    kind = F.element_at(F.array(F.lit("text"), F.lit("Table"), F.lit("image")), (F.col("pk") % 3 + 1).cast("int"))
    said = F.format_string(_STORED_TEXT, F.when(F.col("pk") % 6 == 0, "false").otherwise("true"), kind)
    stored = first.select("page", "id", F.format_string("%s_final_%03d.png", "page", "id").alias("name"), said.alias("raw_output"))
    return regions.post_clean(stored, masks).select("page", "id", "type")


@query("""WITH m AS (SELECT p_partkey AS page, CAST(p_size AS BIGINT) AS mask_no, p_partkey % 300 AS x, p_partkey % 200 AS y, p_size * 12 AS w, p_partkey % 400 AS h FROM part)
 SELECT page, mask_no, round(w * h / 560000.0, 9) AS ratio, CAST(greatest(0, x - 10) AS DOUBLE) AS x1, CAST(least(700, least(700, y + h) + 10) AS DOUBLE) AS y2, printf('%d_final_%03d.png', page, mask_no) AS name
 FROM m WHERE w * h / 560000.0 BETWEEN 0.05 AND 0.7""")
def mask_crops(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    m = table(spark, d, "part").select(
        k.alias("page"), F.col("p_size").cast("bigint").alias("mask_no"), F.array(*[c.cast("double") for c in (k % 300, k % 200, F.col("p_size") * 12, k % 400)]).alias("bbox"),
        F.lit(800).alias("width"), F.lit(700).alias("height"),
    )
    out = regions.mask_candidates(m)
    px = F.col("padded")
    return out.select("page", "mask_no", F.round("ratio", 9).alias("ratio"), px[0].cast("double").alias("x1"), px[3].cast("double").alias("y2"), "name")


@query(f"""WITH {pq._SCORES_SQL} SELECT round(avg(anls), 6) AS predict_anls, round(avg(contains_match), 6) AS predict_contains_match, round(avg(exact_match), 6) AS predict_exact_match,
  CAST(0.5 AS DOUBLE) AS predict_model_preparation_time, CAST(40 AS DOUBLE) AS predict_runtime, round(count(*) / 40.0, 6) AS predict_samples_per_second, round(ceil(count(*) / 16.0) / 40.0, 6) AS predict_steps_per_second FROM scored""")
def generation_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = scoring.generation_metrics(pq._scored(spark, d), ["exact_match", "contains_match", "anls"], 40.0, 0.5, 16)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


# -- shapes and parsing cases ------------------------------------------------------------------------

_SHAPE = "CASE ann_id % 3 WHEN 0 THEN to_json(bbox[1]) WHEN 1 THEN to_json(bbox[1][1]) ELSE NULL END"


@query(f"""SELECT ann_id, CAST(coalesce(CASE ann_id % 3 WHEN 0 THEN len(p) WHEN 1 THEN CASE WHEN len(b) > 0 THEN 1 END END, 0) AS INTEGER) AS n_boxes,
   CAST(CASE ann_id % 3 WHEN 0 THEN p[1][1] WHEN 1 THEN b[1] END AS DOUBLE) AS x1 FROM (SELECT DISTINCT ann_id, bbox[1] AS p, bbox[1][1] AS b FROM bench_annotations)""")
def page_box_shapes(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "bench_annotations").select("ann_id", F.get("bbox", F.lit(0)).alias("p"), F.get(F.get("bbox", F.lit(0)), F.lit(0)).alias("b")).distinct()
    raw = F.when(F.col("ann_id") % 3 == 0, F.to_json("p")).when(F.col("ann_id") % 3 == 1, F.to_json("b"))
    boxes = geometry.page_boxes(raw)
    return b.withColumn("boxes", boxes).select("ann_id", F.size("boxes").alias("n_boxes"), F.get(F.get("boxes", F.lit(0)), F.lit(0)).alias("x1"))


#: JSON text of a page field -> the pages it names.
PAGE_CASES = [("[1, 2]", "1,2"), ('[1, "2", 3.5, null]', "1"), ("null", ""), (None, ""), ("7", "7"), ('"12"', "12"), ('"p3"', ""), ("3.9", "3"), ('"3.9"', ""), ("[]", ""), ('{"a": 1}', ""), ("-4", "-4")]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{want}')" for i, (_, want) in enumerate(PAGE_CASES)) + ") t(case_no, pages)")
def page_lists(spark: SparkSession, d: str) -> DataFrame:
    src = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(PAGE_CASES)], "case_no int, raw string")
    return src.select("case_no", F.array_join(jobs.page_list(F.col("raw")).cast("array<string>"), ",").alias("pages"))


#: text, fence stripped, fence stripped by lines, JSON span, field value, question line, answer line, looks like a verdict.
TEXT_CASES = [
    ("```json\n[1]\n```", "[1]", "[1]", "[1]", "```json\n[1]\n```", False, False, False), ("``` [1] ```", "[1]", "", "[1]", "``` [1] ```", False, False, False),
    ("Q1: what - ever?", "Q1: what - ever?", "Q1: what - ever?", None, "what - ever?", True, False, False), ("question - why", "question - why", "question - why", None, "why", True, False, False),
    ("A：yes", "A：yes", "A：yes", None, "yes", False, True, False), ("Answer2: 4", "Answer2: 4", "Answer2: 4", None, "4", False, True, False), ("quota: 3", "quota: 3", "quota: 3", None, "3", False, False, False),
    ('x {"keep" : TRUE} y [2]', 'x {"keep" : TRUE} y [2]', 'x {"keep" : TRUE} y [2]', '{"keep" : TRUE} y [2]', 'TRUE} y [2]', False, False, True),
    ('{"qas": [], "keep": true}', '{"qas": [], "keep": true}', '{"qas": [], "keep": true}', '{"qas": [], "keep": true}', '[], "keep": true}', False, False, False),
]


def _sql(v) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else pq._quoted(v)


@query("SELECT * FROM (VALUES " + ", ".join("(" + ", ".join([str(i), *map(_sql, c[1:])]) + ")" for i, c in enumerate(TEXT_CASES)) + ") t(case_no, fence, fence_lines, span, field, is_question, is_answer, is_verdict)")
def text_pieces(spark: SparkSession, d: str) -> DataFrame:
    src = spark.createDataFrame([(i, c[0]) for i, c in enumerate(TEXT_CASES)], "case_no int, raw string")
    raw = F.col("raw")
    return src.select(
        "case_no", tx.strip_fence(raw).alias("fence"), tx.strip_fence_lines(raw).alias("fence_lines"), tx.json_span(raw).alias("span"), tx.field_value(raw).alias("field"),
        tx.is_question_line(raw).alias("is_question"), tx.is_answer_line(raw).alias("is_answer"), tx.looks_like_verdict(raw).alias("is_verdict"),
    )


# -- scans and sinks ----------------------------------------------------------------------------------


@query("SELECT doc_id, text, lang, page FROM documents")
def json_lines_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Written as JSON lines, read back over two overlapping patterns."""
    folder = new_folder(spark, "json-lines")
    sinks.write_json_lines(table(spark, d, "documents").select("doc_id", "text", "lang", "page"), folder)
    return scans.json_lines_tree(spark, [f"{folder}/*.json", f"{folder}/part-*"], "doc_id bigint, text string, lang string, page bigint").drop("file_path")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS line_no, o_orderkey % 7 = 0 AS bad FROM orders")
def numbered_scan(spark: SparkSession, d: str) -> DataFrame:
    """Line numbers of sorted files; every seventh line is cut."""
    folder = new_folder(spark, "lines")
    key = F.col("o_orderkey")
    line = F.when(key % 7 == 0, F.concat(F.lit('{"k": '), key.cast("string"), F.lit(', "v"'))).otherwise(F.to_json(F.struct(key.alias("k"))))
    o = table(spark, d, "orders").select("o_orderkey", line.alias("value")).orderBy("o_orderkey")
    o.select("value").write.text(folder)
    got = scans.numbered_lines(spark, folder, "k bigint")
    k = F.coalesce(F.col("k"), F.regexp_extract("error", r"\d+", 0).try_cast("bigint"))
    return got.select(k.alias("o_orderkey"), "line_no", F.col("error").isNotNull().alias("bad"))


# -- evaluation with failures ---------------------------------------------------------------------------

_MIXED = f"""b AS ({pq.BOXES}), f AS (SELECT sample, sample % 5 = 1 AS bad, sample % 5 = 2 AND count(*) FILTER (WHERE has_pred) > 0
   AND NOT (count(*) FILTER (WHERE page = 0) = 1 AND count(*) FILTER (WHERE page = 1) = 1) AS flat FROM b GROUP BY sample)"""
_MIXED_BOXES = "SELECT b.* REPLACE (CASE WHEN flat THEN 0 ELSE page END AS page) FROM b JOIN f USING (sample)"
_MIXED_SQL = (
    f"WITH RECURSIVE {_MIXED}, "
    + pq._MATCH.format(boxes=_MIXED_BOXES, pairs=pq._PAIRS.format(same="g.page = p.page"), grp="page")
    + """, scored AS (SELECT sample, bad, flat, CASE WHEN bad THEN 0 ELSE sum(m) / greatest(sum(n_gt), sum(n_pred), 1) END AS si,
   CASE WHEN bad THEN 0 ELSE sum(m / greatest(n_gt, n_pred, 1)) / (CASE WHEN flat THEN 1 ELSE 2 END) END AS pi FROM best JOIN sizes USING (sample, grp) JOIN f USING (sample) GROUP BY sample, bad, flat)"""
)


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    pages = pq.box_pages(spark, d)
    single = F.forall("gt", lambda p: F.size(p) == 1)
    flat = (F.col("sample") % 5 == 2) & (F.size(F.flatten("pred")) > 0) & ~single
    predict = F.when(F.col("sample") % 5 == 1, "no boxes here").when(flat, F.to_json(F.flatten("pred"))).otherwise(F.to_json("pred"))
    return scoring.scored_predictions(pages.select("sample", F.to_json("gt").alias("label"), predict.alias("predict")), "predict", "label")


@query(
    _MIXED_SQL
    + """ SELECT count(*) AS count, count(*) FILTER (WHERE NOT bad) AS valid, count(*) FILTER (WHERE bad) AS parse_failures, count(*) FILTER (WHERE NOT bad AND NOT flat) AS "grouped",
  count(*) FILTER (WHERE NOT bad AND flat) AS flat, round(avg(si), 6) AS mean_iou, round(avg(pi), 6) AS mean_page_iou, round(avg(si) FILTER (WHERE NOT bad), 6) AS mean_iou_valid,
  round(avg(pi) FILTER (WHERE NOT bad), 6) AS mean_page_iou_valid,
  count(*) FILTER (WHERE si >= 0.3) AS hits_at_30, round(avg(CASE WHEN si >= 0.3 THEN 1.0 ELSE 0.0 END), 6) AS rate_at_30,
  count(*) FILTER (WHERE si >= 0.5) AS hits_at_50, round(avg(CASE WHEN si >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS rate_at_50,
  count(*) FILTER (WHERE si >= 0.7) AS hits_at_70, round(avg(CASE WHEN si >= 0.7 THEN 1.0 ELSE 0.0 END), 6) AS rate_at_70 FROM scored"""
)
def iou_failures(spark: SparkSession, d: str) -> DataFrame:
    """The run summary with unreadable and flat predictions among the page-wise ones."""
    return scoring.iou_summary(_mixed(spark, d))


@query(
    f"""WITH {_MIXED} SELECT predict_parse_mode, count(*) AS n FROM (SELECT sample, CASE WHEN flat THEN 'flat_boxes' ELSE 'page_grouped' END AS predict_parse_mode FROM f WHERE NOT bad) GROUP BY ALL"""
)
def mode_histogram(spark: SparkSession, d: str) -> DataFrame:
    h = scoring.mode_histogram(_mixed(spark, d))
    kind = F.when(F.startswith("predict_parse_mode", F.lit("page_grouped")), "page_grouped").otherwise(F.col("predict_parse_mode"))
    return h.groupBy(kind.alias("predict_parse_mode")).agg(F.sum("n").alias("n"))




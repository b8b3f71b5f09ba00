"""Registered queries of the page question-answering operators, with their SQL.

``BOXES`` derives reference and predicted boxes from lineitem (the same SQL text
runs in both engines); all other queries read the tables of the domain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.functions import boxparse, geometry, png, qaparse
from folioframe.functions import text as tx
from folioframe.operators import chat, regions, rows, scoring
from folioframe.plans.staging import table

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


# -- derived boxes ---------------------------------------------------------------------------------

_ITEMS = """SELECT l_orderkey AS sample, CAST(l_linenumber AS BIGINT) AS ln, min(l_partkey) AS pk, min(l_suppkey) AS sk, CAST(min(l_quantity) AS BIGINT) AS q
  FROM lineitem GROUP BY l_orderkey, l_linenumber"""
BOXES = f"""SELECT sample, ln, ln % 2 AS page, pk, pk % 700 AS gx1, sk * 7 % 700 AS gy1, pk % 700 + 60 + q AS gx2, sk * 7 % 700 + 40 + q AS gy2,
  pk % 700 + ln * 5 - 10 AS px1, sk * 7 % 700 + pk % 13 AS py1, pk % 700 + 60 + q + ln * 5 - 10 AS px2, sk * 7 % 700 + 40 + q + pk % 13 AS py2,
  pk % 11 <> 0 AS has_pred FROM ({_ITEMS}) items"""


def boxes(spark: SparkSession, d: str) -> DataFrame:
    items = (
        table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sample"), F.col("l_linenumber").cast("bigint").alias("ln"))
        .agg(F.min("l_partkey").alias("pk"), F.min("l_suppkey").alias("sk"), F.min("l_quantity").cast("bigint").alias("q"))
    )
    gx, gy, dx, dy = F.col("pk") % 700, F.col("sk") * 7 % 700, F.col("ln") * 5 - 10, F.col("pk") % 13
    return items.select(
        "sample", "ln", (F.col("ln") % 2).alias("page"), "pk",
        gx.alias("gx1"), gy.alias("gy1"), (gx + 60 + F.col("q")).alias("gx2"), (gy + 40 + F.col("q")).alias("gy2"),
        (gx + dx).alias("px1"), (gy + dy).alias("py1"), (gx + 60 + F.col("q") + dx).alias("px2"), (gy + 40 + F.col("q") + dy).alias("py2"),
        (F.col("pk") % 11 != 0).alias("has_pred"),
    )


def _gt() -> Column:
    return geometry.box(*[F.col(c) for c in ("gx1", "gy1", "gx2", "gy2")])


def _pred() -> Column:
    return geometry.box(*[F.col(c) for c in ("px1", "py1", "px2", "py2")])


def box_pages(spark: SparkSession, d: str) -> DataFrame:
    """sample with page-wise reference and predicted boxes, in line order."""

    def pages(which: Column, keep: Column) -> list[Column]:
        at = lambda p: F.array_sort(F.collect_list(F.when(keep & (F.col("page") == p), F.struct("ln", which.alias("b")))))
        return [F.transform(at(p), lambda x: x["b"]) for p in (0, 1)]

    g, p = pages(_gt(), F.lit(True)), pages(_pred(), F.col("has_pred"))
    return boxes(spark, d).groupBy("sample").agg(F.array(*g).alias("gt"), F.array(*p).alias("pred"))


_IOU = """CASE WHEN u > 0 THEN i / u ELSE 0.0 END"""
_PAIRS = f"""SELECT *, {_IOU} AS w FROM (SELECT *, a + b - i AS u FROM (SELECT g.sample, g.page, g.ln AS gl, p.ln AS pl,
  CAST((g.gx2 - g.gx1) * (g.gy2 - g.gy1) AS DOUBLE) a, CAST((p.px2 - p.px1) * (p.py2 - p.py1) AS DOUBLE) b,
  CAST(greatest(0, least(g.gx2, p.px2) - greatest(g.gx1, p.px1)) * greatest(0, least(g.gy2, p.py2) - greatest(g.gy1, p.py1)) AS DOUBLE) i
  FROM boxes g JOIN boxes p ON g.sample = p.sample AND {{same}} AND p.has_pred))"""
_MATCH = """boxes AS ({boxes}), pairs AS ({pairs}),
 gs AS (SELECT sample, {grp} AS grp, ln, row_number() OVER (PARTITION BY sample, {grp} ORDER BY ln) k FROM boxes),
 ps AS (SELECT sample, {grp} AS grp, ln, row_number() OVER (PARTITION BY sample, {grp} ORDER BY ln) - 1 j FROM boxes WHERE has_pred),
 ws AS (SELECT gs.sample, gs.grp, k, list(struct_pack(j := j, w := w)) l FROM gs JOIN ps USING (sample, grp)
   JOIN pairs ON pairs.sample = gs.sample AND pairs.gl = gs.ln AND pairs.pl = ps.ln GROUP BY ALL),
 steps(sample, grp, k, mask, s) AS (
  SELECT DISTINCT sample, grp, 0::BIGINT, 0::BIGINT, 0.0::DOUBLE FROM gs
  UNION ALL
  SELECT sample, grp, k, mask, max(s) FROM (
   SELECT st.sample, st.grp, st.k + 1 AS k, x.m AS mask, st.s + x.w AS s FROM steps st
   JOIN (SELECT sample, grp, max(k) n FROM gs GROUP BY ALL) c ON c.sample = st.sample AND c.grp = st.grp AND st.k < c.n
   LEFT JOIN ws ON ws.sample = st.sample AND ws.grp = st.grp AND ws.k = st.k + 1,
   LATERAL (SELECT st.mask AS m, 0.0 AS w UNION ALL
     SELECT st.mask + (1 << CAST(e.j AS INTEGER)), e.w FROM (SELECT unnest(coalesce(ws.l, [])) e) WHERE (st.mask // (1 << CAST(e.j AS INTEGER))) % 2 = 0) x)
  GROUP BY ALL),
 best AS (SELECT sample, grp, max(s) m FROM steps GROUP BY ALL),
 sizes AS (SELECT sample, {grp} AS grp, count(*) n_gt, count(*) FILTER (WHERE has_pred) n_pred FROM boxes GROUP BY ALL)"""
_GROUPED_SQL = (
    "WITH RECURSIVE "
    + _MATCH.format(boxes=BOXES, pairs=_PAIRS.format(same="g.page = p.page"), grp="page")
    + """, scored AS (SELECT sample, sum(m) / greatest(sum(n_gt), sum(n_pred), 1) AS si, sum(m / greatest(n_gt, n_pred, 1)) / 2 AS pi
  FROM best JOIN sizes USING (sample, grp) GROUP BY sample)"""
)


@query(_GROUPED_SQL + " SELECT sample, round(si, 6) AS sample_iou, round(pi, 6) AS page_iou FROM scored")
def match_grouped(spark: SparkSession, d: str) -> DataFrame:
    out = scoring.grouped_scores(box_pages(spark, d), "sample", "gt", "pred")
    return out.select("sample", F.round("sample_iou", 6).alias("sample_iou"), F.round("page_iou", 6).alias("page_iou"))


@query(
    "WITH RECURSIVE " + _MATCH.format(boxes=BOXES, pairs=_PAIRS.format(same="true"), grp="0")
    + " SELECT sample, round(m / greatest(n_gt, n_pred, 1), 6) AS sample_iou FROM best JOIN sizes USING (sample, grp)"
)
def match_flat(spark: SparkSession, d: str) -> DataFrame:
    out = scoring.flat_scores(box_pages(spark, d), "sample", "gt", "pred")
    return out.select("sample", F.round("sample_iou", 6).alias("sample_iou"))


@query(
    _GROUPED_SQL
    + """ SELECT count(*) AS count, count(*) AS valid, CAST(0 AS BIGINT) AS parse_failures, count(*) AS "grouped", CAST(0 AS BIGINT) AS flat,
  round(avg(si), 6) AS mean_iou, round(avg(pi), 6) AS mean_page_iou, round(avg(si), 6) AS mean_iou_valid, round(avg(pi), 6) AS mean_page_iou_valid,
  count(*) FILTER (WHERE si >= 0.3) AS hits_at_30, round(avg(CASE WHEN si >= 0.3 THEN 1.0 ELSE 0.0 END), 6) AS rate_at_30,
  count(*) FILTER (WHERE si >= 0.5) AS hits_at_50, round(avg(CASE WHEN si >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS rate_at_50,
  count(*) FILTER (WHERE si >= 0.7) AS hits_at_70, round(avg(CASE WHEN si >= 0.7 THEN 1.0 ELSE 0.0 END), 6) AS rate_at_70 FROM scored"""
)
def iou_metrics(spark: SparkSession, d: str) -> DataFrame:
    texts = box_pages(spark, d).select("sample", F.to_json("gt").alias("label"), F.to_json("pred").alias("predict"))
    return scoring.iou_summary(scoring.scored_predictions(texts, "predict", "label"))


@query(f"""WITH boxes AS ({BOXES}), pairs AS ({_PAIRS.format(same="g.ln = p.ln")})
  SELECT sample, gl AS ln, round(w, 6) AS iou, round(CASE WHEN least(a, b) > 0 THEN i / least(a, b) ELSE 0 END, 6) AS overlap FROM pairs""")
def iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d).filter("has_pred")
    return b.select(
        "sample", "ln", F.round(geometry.iou(_gt(), _pred()), 6).alias("iou"), F.round(geometry.overlap_of_smaller(_gt(), _pred()), 6).alias("overlap")
    )


@query(f"""WITH boxes AS ({BOXES}), f AS (SELECT *, gx1 * 1.37 - 40 AS x1, gy1 * 1.21 - 30 AS y1, gx2 * 1.37 + 0.5 AS x2, gy2 * 1.21 + 0.5 AS y2 FROM boxes),
 t AS (SELECT *, greatest(0, least(CAST(trunc(x1) AS INT), 800)) a1, greatest(0, least(CAST(trunc(y1) AS INT), 700)) b1,
   greatest(0, least(CAST(trunc(x2) AS INT), 800)) a2, greatest(0, least(CAST(trunc(y2) AS INT), 700)) b2,
   greatest(0, least(CAST(round_even(x1, 0) AS INT), 800)) c1, greatest(0, least(CAST(round_even(x2, 0) AS INT), 800)) c2 FROM f)
 SELECT sample, ln, a1 AS t_x1, b1 AS t_y1, CASE WHEN a2 <= a1 THEN least(800, a1 + 1) ELSE a2 END AS t_x2, CASE WHEN b2 <= b1 THEN least(700, b1 + 1) ELSE b2 END AS t_y2,
  c1 AS r_x1, CASE WHEN c2 <= c1 THEN least(800, c1 + 1) ELSE c2 END AS r_x2,
  round(greatest(0, least(1000, CASE WHEN gx1 / 350.0 <= 1 THEN gx1 / 350.0 * 1000 ELSE gx1 / 350.0 END)), 6) AS rel_x1,
  greatest(0, px1 - 10) AS pad_x1, least(800, px2 + 10) AS pad_x2,
  greatest(0, gx1) AS xyxy_x1, least(800, gx1 + gx2) AS xyxy_x2,
  CAST(gx2 * gy2 AS DOUBLE) / 560000 AS ratio, gx2 * gy2 / 560000.0 BETWEEN 0.05 AND 0.7 AS keep,
  (gx2 - gx1) >= 70 AND (gy2 - gy1) >= 70 AS big FROM t""")
def box_geometry(spark: SparkSession, d: str) -> DataFrame:
    w, h = F.lit(800.0), F.lit(700.0)
    frac = F.array(F.col("gx1") * 1.37 - 40, F.col("gy1") * 1.21 - 30, F.col("gx2") * 1.37 + 0.5, F.col("gy2") * 1.21 + 0.5)
    b = boxes(spark, d).withColumns(
        {
            "t": geometry.clamp_truncated(frac, w, h), "r": geometry.clamp_rounded(frac, w, h),
            "rel": geometry.relative(F.array(F.col("gx1") / 350.0, F.lit(0.0), F.lit(0.0), F.lit(0.0))),
            "pad": geometry.padded(_pred(), F.lit(10.0), w, h), "xyxy": geometry.from_xywh(_gt(), w, h), "ratio": geometry.area_ratio(_gt(), w, h),
        }
    )
    return b.select(
        "sample", "ln", *[F.col("t")[i].alias(f"t_{n}") for i, n in enumerate(("x1", "y1", "x2", "y2"))],
        F.col("r")[0].alias("r_x1"), F.col("r")[2].alias("r_x2"), F.round(F.col("rel")[0], 6).alias("rel_x1"),
        F.col("pad")[0].cast("bigint").alias("pad_x1"), F.col("pad")[2].cast("bigint").alias("pad_x2"),
        F.col("xyxy")[0].cast("bigint").alias("xyxy_x1"), F.col("xyxy")[2].cast("bigint").alias("xyxy_x2"),
        "ratio", F.col("ratio").between(0.05, 0.7).alias("keep"), geometry.has_min_edge(_gt(), 70).alias("big"),
    )


def _crops(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d)
    # boxes drawn together so that many overlap
    tight = geometry.box(F.col("ln") * 2, F.col("ln") % 3, F.col("gx2") - F.col("gx1"), F.col("gy2") - F.col("gy1"))
    kind = F.element_at(F.array(F.lit("text"), F.lit("table"), F.lit("image")), (F.col("pk") % 3 + 1).cast("int"))
    name = F.format_string("%d_final_%03d.png", F.col("page"), F.col("ln"))
    return b.select(F.concat_ws("/", "sample", "page").alias("page"), name.alias("name"), kind.alias("type"), tight.alias("box"))


_CROPS_SQL = f"""boxes AS ({BOXES}), crops AS (SELECT concat(sample, '/', page) page, printf('%d_final_%03d.png', page, ln) AS name,
  CASE pk % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'table' ELSE 'image' END AS type, ln * 2 x1, ln % 3 y1, gx2 - gx1 x2, gy2 - gy1 y2 FROM boxes),
 sized AS (SELECT *, greatest(0, x2 - x1) * greatest(0, y2 - y1) s FROM crops),
 pairs AS (SELECT a.page, a.name an, b.name bn, CASE WHEN (a.type = 'text' AND a.s >= b.s) OR (a.type <> 'text' AND a.s <= b.s) THEN a.name ELSE b.name END dn
  FROM sized a JOIN sized b ON a.page = b.page AND a.type = b.type AND a.name < b.name AND least(a.s, b.s) > 0 AND
  10 * greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) >= 9 * least(a.s, b.s)),
 folded AS (SELECT page, list_reduce(list([an, bn, dn] ORDER BY an, bn), lambda acc, x: CASE WHEN list_contains(acc, x[1]) OR list_contains(acc, x[2]) THEN acc
   ELSE list_append(acc, x[3]) END, CAST([] AS VARCHAR[])) gone FROM pairs GROUP BY page)"""


@query(f"WITH {_CROPS_SQL} SELECT crops.page, name, type FROM crops LEFT JOIN folded ON folded.page = crops.page WHERE gone IS NULL OR NOT list_contains(gone, name)")
def dedup_greedy(spark: SparkSession, d: str) -> DataFrame:
    return regions.pruned(_crops(spark, d)).select("page", "name", "type")


@query(f"WITH {_CROPS_SQL} SELECT page, an AS a, bn AS b, dn AS \"drop\" FROM pairs")
def overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    return regions.overlap_pairs(_crops(spark, d))


# -- text, verdicts and prompts ----------------------------------------------------------------------

_BLANK = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _norm(c: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({c}, '')), '{_BLANK}+', ' ', 'g'))"


@query(f"SELECT doc_id, md5({_norm('text')}) AS hash, CAST(length({_norm('text')}) AS BIGINT) AS n FROM documents")
def txt_normalize(spark: SparkSession, d: str) -> DataFrame:
    t = tx.normalize(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(t).alias("hash"), F.length(t).cast("bigint").alias("n"))


_PREDICT_SQL = """CASE sample_id % 5 WHEN 0 THEN upper(answer) WHEN 1 THEN substr(answer, 1, CAST(length(answer) // 2 + 1 AS INT)) WHEN 2 THEN replace(answer, 'e', 'a')
  WHEN 3 THEN answer || '  x' ELSE query END"""


def _answers(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("answer")
    k = F.col("sample_id") % 5
    half = F.substring(a, F.lit(1), (F.floor(F.length(a) / 2) + 1).cast("int"))
    p = F.when(k == 0, F.upper(a)).when(k == 1, half).when(k == 2, F.replace(a, F.lit("e"), F.lit("a"))).when(k == 3, F.concat(a, F.lit("  x"))).otherwise(F.col("query"))
    chat_rows = table(spark, d, "chat_samples").filter("sample_id is not null")
    return chat_rows.select("sample_id", "image_mode", "ingested_at", p.alias("predict"), a.alias("label"))


_LEV = """list_reduce(list_prepend(CAST(range(0, length(r) + 1) AS BIGINT[]), list_transform(range(1, length(p) + 1), lambda i: [CAST(i AS BIGINT)])), lambda row, i:
  list_reduce(list_prepend([i[1]], list_transform(range(1, length(r) + 1), lambda j: [CAST(j AS BIGINT)])), lambda acc, j:
   list_append(acc, least(acc[j[1]] + 1, row[j[1] + 1] + 1, row[j[1]] + CASE WHEN substr(p, i[1], 1) = substr(r, j[1], 1) THEN 0 ELSE 1 END))))"""
_SCORES_SQL = f"""base AS (SELECT DISTINCT sample_id, image_mode, {_norm(_PREDICT_SQL)} AS p, {_norm('answer')} AS r FROM chat_samples WHERE sample_id IS NOT NULL),
 dist AS (SELECT *, CASE WHEN p = '' OR r = '' OR p = r OR abs(length(p) - length(r)) * 2 >= greatest(length(p), length(r)) THEN NULL
   WHEN strlen(p) = length(p) AND strlen(r) = length(r) THEN levenshtein(p, r) ELSE list_last({_LEV}) END AS lev FROM base),
 scored AS (SELECT sample_id, image_mode, CAST(CASE WHEN p = r THEN 1.0 ELSE 0.0 END AS DOUBLE) AS exact_match,
  CAST(CASE WHEN p = '' OR r = '' THEN 0.0 WHEN contains(p, r) OR contains(r, p) THEN 1.0 ELSE 0.0 END AS DOUBLE) AS contains_match,
  CAST(CASE WHEN p = '' AND r = '' THEN 1.0 WHEN p = '' OR r = '' THEN 0.0 WHEN p = r THEN 1.0 WHEN lev IS NULL THEN 0.0
   WHEN lev / greatest(length(p), length(r)) >= 0.5 THEN 0.0 ELSE 1.0 - lev / greatest(length(p), length(r)) END AS DOUBLE) AS anls FROM dist)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    once = _answers(spark, d).select("sample_id", "image_mode", "predict", "label").distinct()
    return scoring.text_scores(once, "predict", "label").select(
        "sample_id", "image_mode", "normalized_predict", "normalized_label", "exact_match", "contains_match", "anls"
    ).distinct()


@query(f"WITH {_SCORES_SQL} SELECT sample_id, exact_match, contains_match, round(anls, 6) AS anls FROM scored")
def txt_anls(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("sample_id", "exact_match", "contains_match", F.round("anls", 6).alias("anls"))


@query(f"""WITH {_SCORES_SQL} SELECT image_mode AS name, count(*) AS samples, round(avg(exact_match), 6) AS exact_match,
  round(avg(contains_match), 6) AS contains_match, round(avg(anls), 6) AS anls FROM scored GROUP BY image_mode""")
def leaderboard(spark: SparkSession, d: str) -> DataFrame:
    s = scoring.text_summary(_scored(spark, d), ["image_mode"]).withColumnRenamed("image_mode", "name")
    out = s.select("name", "samples", *[F.round(c, 6).alias(c) for c in ("exact_match", "contains_match", "anls")])
    return scoring.leaderboard(out, "name")


_VERDICTS = ["Correct.", "incorrect", "not correct", "INCORRECTLY", "uncorrected", "maybe", None, " TRUE! ", "false; then true"]
_VERDICT_SQL = "CASE event_id % 9 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(_VERDICTS) if v is not None) + " END"
_VERDICT_OUT = """CASE WHEN v IS NULL THEN NULL WHEN w IN ('true', 'correct') THEN 'True' WHEN w IN ('false', 'incorrect') THEN 'False'
  WHEN contains(l, 'incorrect') OR contains(l, 'false') THEN 'False' WHEN contains(l, 'correct') OR contains(l, 'true') THEN 'True' ELSE v END"""
_VERDICT_CTE = rf"""raw AS (SELECT event_id, event_type, {_VERDICT_SQL} AS v FROM events), words AS (SELECT *, lower(trim(v)) l,
  regexp_extract(lower(trim(v)), '\b(correct|incorrect|true|false)\b', 1) w FROM raw), judged AS (SELECT event_id, event_type, {_VERDICT_OUT} AS judge FROM words)"""


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    v = F.element_at(F.array(*[F.lit(x).cast("string") for x in _VERDICTS]), (F.col("event_id") % 9 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", "event_type", v.alias("v"))


@query(f"WITH {_VERDICT_CTE} SELECT event_id, judge FROM judged")
def judge_verdict(spark: SparkSession, d: str) -> DataFrame:
    return _verdicts(spark, d).select("event_id", tx.verdict(F.col("v")).alias("judge"))


@query(f"""WITH {_VERDICT_CTE} SELECT count(*) AS total, count(*) FILTER (WHERE judge = 'True') AS n_true, count(*) FILTER (WHERE judge = 'False') AS n_false,
  count(*) FILTER (WHERE judge IS NULL OR judge NOT IN ('True', 'False')) AS n_unknown, round(count(*) FILTER (WHERE judge = 'True') / count(*), 6) AS accuracy FROM judged""")
def judge_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return scoring.judge_accuracy(_verdicts(spark, d), "v")


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query(f"""SELECT DISTINCT ann_id, replace(replace(replace({_quoted(tx.JUDGE_TEMPLATE)}, '{{question}}', coalesce(nullif(query, ''), 'None')),
  '{{ground_truth}}', coalesce(answer, 'None')), '{{response}}', coalesce(upper(answer), 'None')) AS prompt FROM bench_annotations""")
def judge_prompt(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "bench_annotations")
    q = tx.first_filled(F.nullif(F.col("query"), F.lit("")), F.lit(None).cast("string"))
    return b.select("ann_id", tx.judge_prompt(q, F.col("answer"), F.upper("answer")).alias("prompt")).distinct()


@query("SELECT DISTINCT ann_id, CASE WHEN ann_id % 3 = 2 THEN concat('> ', coalesce(query, '')) ELSE coalesce(query, '') END AS question FROM bench_annotations")
def question_extract(spark: SparkSession, d: str) -> DataFrame:
    q = F.coalesce("query", F.lit(""))
    head = F.concat(F.lit(tx.CHAT_HEAD), q)
    prompt = F.when(F.col("ann_id") % 3 == 0, F.concat(head, F.lit(tx.CHAT_TAIL))).when(F.col("ann_id") % 3 == 1, head).otherwise(F.concat(F.lit("> "), q))
    return table(spark, d, "bench_annotations").select("ann_id", tx.question_of_prompt(prompt).alias("question")).distinct()


@query("SELECT DISTINCT sample_id, CASE WHEN qa_id IS NOT NULL THEN CAST(qa_id AS VARCHAR) WHEN bbox_qa_id IS NOT NULL THEN CAST(bbox_qa_id AS VARCHAR) ELSE CAST(sample_id AS VARCHAR) END AS record_key FROM chat_samples")
def record_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chat_samples").select("sample_id", tx.first_id(F.col("qa_id"), F.col("bbox_qa_id"), F.col("sample_id")).alias("record_key")).distinct()


@query("""SELECT doc_id, concat('data:', CASE doc_id % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' ELSE 'application/octet-stream' END, ';base64,', to_base64(encode(text))) AS url
  FROM documents WHERE text IS NOT NULL""")
def data_url(spark: SparkSession, d: str) -> DataFrame:
    path = F.element_at(F.array(F.lit("a/b.PNG"), F.lit("c.jpeg"), F.lit("noext.bin")), (F.col("doc_id") % 3 + 1).cast("int"))
    docs = table(spark, d, "documents").filter("text is not null")
    return docs.select("doc_id", tx.data_url(path, F.encode("text", "UTF-8")).alias("url"))


# -- parsing -------------------------------------------------------------------------------------------

_B, _C = [1.0, 2.0, 3.0, 4.0], [5.0, 6.0, 7.0, 8.0]
#: text, label pages, one box per page, mode, pages as the evaluator reads them
PARSE_CASES: list[tuple[str | None, int, bool, str, str]] = [
    (None, 2, False, "empty", "[[],[]]"), ("", 1, True, "page_grouped_or_flat", "[]"), ("[1,2,3,4]", 1, True, "flat_number_sequence", "[[b]]"),
    ("1, 2, 3, 4", 1, True, "flat_number_sequence", "[[b]]"), ("[1,2,3,4,5,6,7,8]", 2, True, "promoted_from_number_sequence", "[[b],[c]]"),
    ("[1,2,3,4,5,6,7,8]", 2, False, "flat_number_sequence", "[[b,c]]"), ("[[1,2,3,4],[5,6,7,8]]", 1, True, "flat_boxes", "[[b,c]]"),
    ("[[1,2,3,4],[5,6,7,8]]", 2, True, "promoted_by_order", "[[b],[c]]"), ("[[[1,2,3,4]],[[5,6,7,8]]]", 2, True, "page_grouped_recovered", "[[b],[c]]"),
    ("[[[1,2,3,4]],[]]", 2, True, "page_grouped_recovered", "[[b],[]]"), ("[[1,2,3,4],5,6,7,8]", 1, False, "mixed_box_sequence", "[[b,c]]"),
    ('{"bbox_2d":[1,2,3,4]}', 1, True, "single_box", "[[b]]"), ('[{"bbox_2d":[1,2,3,4]},{"box":[5,6,7,8]}]', 1, True, "flat_boxes", "[[b,c]]"),
    ('["1, 2, 3, 4"]', 1, True, "flat_boxes", "[[b]]"), ("see [1,2,3,4] and [5,6,7,8]", 1, True, "flat_boxes", "[[b,c]]"),
    ("```json\n[[1,2,3,4]]\n```", 1, True, "flat_boxes", "[[b]]"), ("[[1,2,3]]", 1, True, "error", "error"), ("none", 1, True, "error", "error"),
]


@query("SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{'page_grouped' if m == 'page_grouped_or_flat' else m}', '{p}')" for i, (_, _, _, m, p) in enumerate(PARSE_CASES)) + ") t(case_no, mode, pages)")
def parse_modes(spark: SparkSession, d: str) -> DataFrame:
    src = spark.createDataFrame([(i, t, n, s) for i, (t, n, s, _, _) in enumerate(PARSE_CASES)], "case_no int, txt string, n int, single boolean")
    out = src.withColumn("r", boxparse.parsed_prediction(F.col("txt"), F.col("n"), F.col("single")))
    shown = F.to_json("r.pages")
    for name, b in (("b", _B), ("c", _C)):
        shown = F.replace(shown, F.lit("[" + ",".join(str(v) for v in b) + "]"), F.lit(name))
    return out.select("case_no", F.coalesce("r.mode", F.lit("error")).alias("mode"), F.when(F.col("r.error").isNotNull(), "error").otherwise(shown).alias("pages"))


@query(f"WITH boxes AS ({BOXES}) SELECT sample, ln, CAST(px1 AS DOUBLE) AS x1, CAST(py2 AS DOUBLE) AS y2, CASE ln % 4 WHEN 2 THEN 'single_box' WHEN 3 THEN 'flat_boxes' ELSE 'flat_number_sequence' END AS mode FROM boxes")
def parse_texts(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d)
    plain = F.concat_ws(", ", "px1", "py1", "px2", "py2")
    text = (
        F.when(F.col("ln") % 4 == 0, plain).when(F.col("ln") % 4 == 1, F.concat(F.lit("["), plain, F.lit("]")))
        .when(F.col("ln") % 4 == 2, F.concat(F.lit('{"bbox": ['), plain, F.lit("]}"))).otherwise(F.concat(F.lit("at ["), plain, F.lit("] here")))
    )
    got = b.select("sample", "ln", boxparse.parsed_prediction(text, F.lit(1), F.lit(True)).alias("r"))
    first = F.col("r.pages")[0][0]
    return got.select("sample", "ln", first[0].alias("x1"), first[3].alias("y2"), F.col("r.mode").alias("mode"))


_JUDGE_TEXT = ['{"keep": true, "type":"Table"}', 'ok {"keep": true} x', '{"keep":"false","type":"text"}', "garbage", "[1]", '{"keep": 0, "type": "IMAGE"}', '{"type":"figure","keep":1}', '```{"keep": false, "type": "text"}```']
_JUDGE_KEEP = [True, True, True, False, False, False, True, False]
_JUDGE_TYPE = ["table", "unknown", "text", "unknown", "unknown", "image", "unknown", "text"]


def _case(values: list) -> str:
    return "CASE event_id % 8 " + " ".join(f"WHEN {i} THEN {_quoted(v) if isinstance(v, str) else str(v).lower()}" for i, v in enumerate(values)) + " END"


_CROP_CTE = f"judged AS (SELECT event_id, event_type AS doc, CAST(user_id % 7 AS VARCHAR) AS page, {_case(_JUDGE_KEEP)} AS keep, {_case(_JUDGE_TYPE)} AS type FROM events)"


def _judged(spark: SparkSession, d: str) -> DataFrame:
    raw = F.element_at(F.array(*[F.lit(x) for x in _JUDGE_TEXT]), (F.col("event_id") % 8 + 1).cast("int"))
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("doc"), (F.col("user_id") % 7).cast("string").alias("page"), regions.crop_verdict(raw).alias("v"))
    return e.select("event_id", "doc", "page", "v.keep", "v.type")


@query(f"WITH {_CROP_CTE} SELECT event_id, keep, type FROM judged")
def verdict_parse(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).select("event_id", "keep", "type")


_SUMMARY = """count(*) FILTER (WHERE keep) AS keep_true, count(*) FILTER (WHERE NOT keep) AS keep_false, count(*) FILTER (WHERE type = 'text') AS n_text,
  count(*) FILTER (WHERE type = 'table') AS n_table, count(*) FILTER (WHERE type = 'image') AS n_image, count(*) FILTER (WHERE type = 'unknown') AS n_unknown"""


@query(f"WITH {_CROP_CTE} SELECT doc, count(*) AS total, {_SUMMARY} FROM judged GROUP BY doc")
def verdict_summary(spark: SparkSession, d: str) -> DataFrame:
    return regions.verdict_summary(_judged(spark, d), ["doc"])


@query(f"WITH {_CROP_CTE} SELECT doc, page, count(*) AS images, {_SUMMARY} FROM judged GROUP BY ROLLUP (doc, page)")
def rollup_pages(spark: SparkSession, d: str) -> DataFrame:
    return regions.rolled_up(_judged(spark, d))




def _flat(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '{_BLANK}+', ' ', 'g'))"


_ITEMS_SQL = f"""items AS (SELECT DISTINCT record_id, i - 1 AS pos, {_flat('x.q')} q, {_flat('x.a')} a, lower({_flat('x.type')}) t, {_flat('x.difficulty')} df
  FROM (SELECT record_id, i, qas[i] AS x FROM (SELECT *, unnest(range(1, len(qas) + 1)) i FROM qa_records))),
 good AS (SELECT *, row_number() OVER (PARTITION BY record_id, lower(q) ORDER BY pos) r FROM items WHERE q <> '' AND a <> ''),
 kept AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY pos) k FROM good WHERE r = 1)"""


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    def tag(name: str, c: Column) -> Column:
        return F.concat(F.lit(f"<{name}>"), F.coalesce(c, F.lit("")), F.lit(f"</{name}>"))

    block = lambda x: F.concat(F.lit("<qa>\n"), tag("question", x["q"]), tag("Answer", x["a"]), tag("type", x["type"]), tag("difficulty", x["difficulty"]), F.lit("</qa>"))
    return table(spark, d, "qa_records").select("record_id", F.array_join(F.transform("qas", block), "\n").alias("txt")).distinct()


_QA_OUT = """SELECT record_id, CAST(k - 1 AS INTEGER) AS item_pos, q, a, CASE WHEN t IN ('span', 'number', 'date', 'yesno', 'categorical') THEN t ELSE 'span' END AS type,
  CASE WHEN df = '' THEN 'medium' ELSE df END AS difficulty FROM kept WHERE k <= 6"""


@query(f"WITH {_ITEMS_SQL} {_QA_OUT}")
def qa_tagged(spark: SparkSession, d: str) -> DataFrame:
    items = qaparse.deduplicated(qaparse.tagged_blocks(F.col("txt")))
    return _tagged(spark, d).select("record_id", F.posexplode(items).alias("item_pos", "x")).select("record_id", "item_pos", "x.*")


@query(f"""WITH {_ITEMS_SQL}, shown AS ({_QA_OUT}) SELECT record_id, form, CAST(item_pos AS INTEGER) AS item_pos, q, a, CASE form WHEN 'lines' THEN 'span' ELSE type END AS type,
  CASE form WHEN 'lines' THEN 'medium' ELSE difficulty END AS difficulty FROM shown, (VALUES ('json'), ('lines'), ('tagged')) f(form)""")
def qa_parsed(spark: SparkSession, d: str) -> DataFrame:
    """The same texts through the full cascade, and as JSON and labelled lines."""
    qa = table(spark, d, "qa_records").select("record_id", "qas").distinct()
    as_json = F.concat(F.lit('sure: {"qas": '), F.to_json("qas"), F.lit("}"))
    lines = F.array_join(F.transform("qas", lambda x: F.concat(F.lit("Q1: "), F.coalesce(x["q"], F.lit("")), F.lit("\nA1: "), F.coalesce(x["a"], F.lit("")), F.lit("\n"))), "\n")
    texts = qa.select("record_id", F.lit("json").alias("form"), as_json.alias("txt")).unionByName(qa.select("record_id", F.lit("lines").alias("form"), lines.alias("txt")))
    texts = texts.unionByName(_tagged(spark, d).select("record_id", F.lit("tagged").alias("form"), "txt"))
    return texts.select("record_id", "form", F.posexplode(qaparse.parsed_items(F.col("txt"))).alias("item_pos", "x")).select("record_id", "form", "item_pos", "x.*")


# -- chat samples, crops and training rows -----------------------------------------------------------------

_PATHS = "list_transform(evidence_page, lambda p: concat(category, '/', doc_name, '/', doc_name, '_', p, '.png'))"


def _annotated(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "bench_annotations").drop("ingested_at").distinct()
    path = lambda p: F.concat(F.col("category"), F.lit("/"), F.col("doc_name"), F.lit("/"), F.col("doc_name"), F.lit("_"), p.cast("string"), F.lit(".png"))
    return b.withColumn("images", F.transform("evidence_page", path))


@query(f"""SELECT DISTINCT ann_id, concat(repeat(concat('<image>', chr(10)), CAST(len(evidence_page) AS BIGINT)), {_quoted(tx.QA_PREFIX)}, chr(10), trim(coalesce(query, ''))) AS prompt, answer AS reply
  FROM bench_annotations WHERE len(evidence_page) > 0""")
def chat_messages(spark: SparkSession, d: str) -> DataFrame:
    out = chat.chat_samples(_annotated(spark, d), "page")
    return out.select("ann_id", tx.message_of(F.col("messages"), "user").alias("prompt"), tx.message_of(F.col("messages"), "assistant").alias("reply")).distinct()


@query("""SELECT DISTINCT ann_id, CAST(len(list_filter(rel_bbox, lambda p: len(list_filter(p, lambda b: len(b) = 4)) > 0)) AS INTEGER) AS n_pages,
  CAST(list_sum(list_transform(rel_bbox, lambda p: len(list_filter(p, lambda b: len(b) = 4)))) AS BIGINT) AS n_boxes,
  array_to_string(list_transform(flatten(flatten(list_transform(rel_bbox, lambda p: list_filter(p, lambda b: len(b) = 4)))), lambda v: CAST(CAST(round(v * 1000000) AS BIGINT) AS VARCHAR)), ',') AS millionths
  FROM bench_annotations WHERE len(evidence_page) > 0 AND len(list_filter(rel_bbox, lambda p: len(list_filter(p, lambda b: len(b) = 4)) > 0)) > 0""")
def chat_box_targets(spark: SparkSession, d: str) -> DataFrame:
    out = chat.chat_samples(_annotated(spark, d), "bbox")
    pages = F.from_json("bbox_target", "array<array<array<double>>>")
    return out.select(
        "ann_id", F.size(pages).alias("n_pages"), F.aggregate(pages, F.lit(0).cast("bigint"), lambda acc, p: acc + F.size(p)).alias("n_boxes"),
        F.array_join(F.transform(F.flatten(F.flatten(pages)), lambda v: F.round(v * 1000000).cast("bigint").cast("string")), ",").alias("millionths"),
    ).distinct()


@query("""SELECT DISTINCT sample_id, CAST(CASE WHEN image_mode IN ('page', 'bbox') THEN CASE WHEN coalesce(len(evidence_page), 0) > 0 THEN len(evidence_page) ELSE coalesce(len(images), 0) END
  WHEN image_mode = 'document' THEN coalesce(len(images), 0)
  ELSE CASE WHEN coalesce(list_sum(list_transform(bbox, lambda p: coalesce(len(list_filter(p, lambda b: len(b) = 4)), 0))), 0) > 0
   THEN list_sum(list_transform(bbox, lambda p: coalesce(len(list_filter(p, lambda b: len(b) = 4)), 0))) ELSE coalesce(len(images), 0) END END AS INTEGER) AS n_tokens FROM chat_samples""")
def image_token_count(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chat_samples")
    n = chat.image_tokens(F.col("image_mode"), F.col("evidence_page"), F.col("bbox"), F.col("images"))
    return c.select("sample_id", n.cast("int").alias("n_tokens")).distinct()


@query("""WITH u AS (SELECT DISTINCT sample_id, images, list_filter(messages, lambda m: m.role = 'user')[1].content AS txt FROM chat_samples),
 p AS (SELECT sample_id, images, string_split(txt, '<image>') s FROM u WHERE txt IS NOT NULL), x AS (SELECT sample_id, images, s, unnest(range(1, len(s) + 1)) i FROM p)
 SELECT sample_id, CAST(sum(CASE WHEN s[i] <> '' THEN 1 ELSE 0 END) AS BIGINT) AS n_text, CAST(sum(CASE WHEN i <= least(len(s) - 1, coalesce(len(images), 0)) THEN 1 ELSE 0 END) AS BIGINT) AS n_image,
  CAST(sum(length(s[i])) AS BIGINT) AS n_chars FROM x GROUP BY sample_id, images, s""")
def prompt_split(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chat_samples").select("sample_id", "images", tx.message_of(F.col("messages"), "user").alias("txt")).distinct()
    parts = tx.prompt_parts(F.col("txt"), F.col("images"))
    n = lambda kind: F.size(F.filter("parts", lambda x: x["type"] == kind)).cast("bigint")
    chars = F.aggregate(F.filter("parts", lambda x: x["type"] == "text"), F.lit(0).cast("bigint"), lambda acc, x: acc + F.length(x["value"]))
    return c.filter("txt is not null").withColumn("parts", parts).select("sample_id", n("text").alias("n_text"), n("image").alias("n_image"), chars.alias("n_chars"))


_PAGE_LIST = "pages AS (SELECT category, doc_name, page, min(image) AS image FROM page_images GROUP BY ALL)"


def _page_list(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "page_images").groupBy("category", "doc_name", "page").agg(F.min("image").alias("image"))


@query(f"""WITH {_PAGE_LIST}, want AS (SELECT DISTINCT ann_id, category, doc_name, evidence_page, unnest(range(1, len(evidence_page) + 1)) i FROM bench_annotations)
 SELECT ann_id, count(image) AS n_found, max(image) AS last_image, CASE WHEN count(*) > count(image) THEN 'missing' ELSE 'ok' END AS status
 FROM want LEFT JOIN pages ON pages.category = want.category AND pages.doc_name = want.doc_name AND pages.page = evidence_page[i] GROUP BY ann_id""")
def page_lookup(spark: SparkSession, d: str) -> DataFrame:
    ann = table(spark, d, "bench_annotations").select("ann_id", "category", "doc_name", "evidence_page").distinct()
    out = chat.page_images(ann, _page_list(spark, d), "ann_id")
    found = F.filter("images", lambda x: x.isNotNull())
    return out.select("ann_id", F.size(found).cast("bigint").alias("n_found"), F.array_max(found).alias("last_image"), "status")


@query(f"WITH {_PAGE_LIST} SELECT category, doc_name, array_to_string(list(image ORDER BY page, image), '|') AS images FROM pages GROUP BY category, doc_name")
def document_pages(spark: SparkSession, d: str) -> DataFrame:
    return chat.document_images(_page_list(spark, d)).select("category", "doc_name", F.array_join("images", "|").alias("images"))


@query("""WITH b AS (SELECT DISTINCT ann_id, category, doc_name, evidence_page, bbox, subimg_type FROM bench_annotations),
 p AS (SELECT *, unnest(range(1, len(bbox) + 1)) i FROM b), f AS (SELECT *, list_filter(bbox[i], lambda x: len(x) = 4) bs FROM p), x AS (SELECT *, unnest(range(1, len(bs) + 1)) j FROM f),
 c AS (SELECT *, bs[j] v, coalesce(subimg_type[i][j], 'unknown') t FROM x WHERE evidence_page[i] IS NOT NULL),
 k AS (SELECT *, greatest(0, least(v[1], 1700)) x1, greatest(0, least(v[2], 2200)) y1, greatest(0, least(v[3], 1700)) x2, greatest(0, least(v[4], 2200)) y2 FROM c)
 SELECT ann_id, CAST(i - 1 AS INTEGER) AS page_pos, CAST(j - 1 AS INTEGER) AS box_pos, t AS type, x1, CASE WHEN x2 <= x1 THEN least(1700, x1 + 1) ELSE x2 END AS x2,
  y1, CASE WHEN y2 <= y1 THEN least(2200, y1 + 1) ELSE y2 END AS y2, printf('sample_%05d_%s_%s_p%d_r%d_%s.png', ann_id, coalesce(category, 'null'), coalesce(doc_name, 'null'), evidence_page[i], j, t) AS crop_name,
  CASE WHEN (CASE WHEN x2 <= x1 THEN least(1700, x1 + 1) ELSE x2 END) > x1 AND (CASE WHEN y2 <= y1 THEN least(2200, y1 + 1) ELSE y2 END) > y1 THEN 'ok' ELSE 'empty' END AS status FROM k""")
def crop_names(spark: SparkSession, d: str) -> DataFrame:
    ann = table(spark, d, "bench_annotations").select("ann_id", "category", "doc_name", "evidence_page", "bbox", "subimg_type").distinct()
    out = chat.annotation_crops(ann.withColumns({"w": F.lit(1700), "h": F.lit(2200)}), "ann_id", "w", "h")
    px = F.col("pixels")
    return out.select("ann_id", "page_pos", "box_pos", "type", *[px[i].cast("bigint").alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))], "crop_name", "status")


@query()
def predicted_crops(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of the assistant's text of box-mode samples, cut to a page."""
    c = table(spark, d, "chat_samples").filter("image_mode = 'bbox'")
    c = c.select("sample_id", "evidence_page", tx.message_of(F.col("messages"), "assistant").alias("txt"), F.coalesce(F.size("images"), F.lit(0)).alias("n"), F.lit(2550.0).alias("w"), F.lit(3300.0).alias("h")).distinct()
    out = chat.predicted_crops(c, "sample_id", "txt", F.col("n"), "w", "h")
    return out.select("sample_id", "page", "page_pos", "box_pos", F.array_join("pixels", ",").alias("pixels"), "status")


_QA_PAGE = "try_cast(regexp_extract(page, '[0-9]+') AS BIGINT)"


@query(f"""WITH q AS (SELECT DISTINCT record_id, doc_name, {_QA_PAGE} AS page, bbox, coalesce(nullif(subimg_type, ''), CASE record_id % 2 WHEN 0 THEN 'table' END, 'unknown') AS t, qas FROM qa_records),
 x AS (SELECT *, unnest(range(1, len(qas) + 1)) i FROM q WHERE page IS NOT NULL AND len(bbox) = 4)
 SELECT record_id, CAST(i - 1 AS INTEGER) AS item_pos, qas[i].q AS query, qas[i].a AS answer, doc_name, page AS page_no, bbox[1] AS x1, bbox[4] AS y2, t AS type FROM x""")
def train_flatten(spark: SparkSession, d: str) -> DataFrame:
    qa = table(spark, d, "qa_records")
    page = F.regexp_extract("page", "[0-9]+", 0).try_cast("bigint")
    rec = qa.select(
        F.concat(F.col("record_id").cast("string"), F.lit(".png")).alias("image"), "doc_name",
        F.when(page.isNotNull(), F.array(page)).alias("page"), "bbox", F.col("subimg_type").alias("type"), "qas",
    ).distinct()
    types = qa.filter("record_id % 2 = 0").select(F.concat(F.col("record_id").cast("string"), F.lit(".png")).alias("image"), F.lit("table").alias("type")).distinct()
    out = chat.training_rows(rec, types)
    return out.select(
        F.regexp_extract("image", r"^\d+", 0).cast("bigint").alias("record_id"), "item_pos", "query", "answer", "doc_name", F.col("evidence_page")[0].alias("page_no"),
        F.col("bbox")[0][0][0].alias("x1"), F.col("bbox")[0][0][3].alias("y2"), F.col("subimg_type")[0][0].alias("type"),
    )


@query("""WITH s AS (SELECT DISTINCT record_id, image, page, bbox, subimg_type FROM qa_records WHERE record_id % 3 > 0 AND image IS NOT NULL), e AS (SELECT image, max_by(record_id, record_id) AS won, count(*) n FROM s GROUP BY image),
 c AS (SELECT DISTINCT image FROM qa_records WHERE image IS NOT NULL) SELECT c.image, CASE WHEN e.image IS NULL THEN concat('./', c.image) ELSE concat('clean_crops/', c.image) END AS path, e.image IS NOT NULL AS known
 FROM c LEFT JOIN e ON e.image = c.image""")
def left_join_default(spark: SparkSession, d: str) -> DataFrame:
    qa = table(spark, d, "qa_records").filter("image is not null")
    none = F.lit(None).cast("string")
    s = qa.filter("record_id % 3 > 0").select(
        F.col("record_id").alias("ord"), "image", none.alias("img"), none.alias("filename"), F.regexp_extract("page", "[0-9]+", 0).alias("page"),
        F.col("bbox").alias("bbox_xyxy"), F.lit(None).cast("array<bigint>").alias("bbox"), F.lit(None).cast("array<bigint>").alias("bbox_xywh"), F.col("subimg_type").alias("type"),
    )
    out = chat.with_evidence(qa.select("image").distinct(), chat.evidence_map([s.filter("false"), s]))
    return out.select("image", F.col("evidence.image").alias("path"), F.startswith("evidence.image", F.lit("clean")).alias("known"))


@query("""WITH v AS (SELECT doc_name AS doc, page, image, record_id, ingested_at, record_id % 4 <> 0 AS keep FROM qa_records WHERE image IS NOT NULL),
 l AS (SELECT DISTINCT doc, page, image FROM (SELECT *, row_number() OVER (PARTITION BY doc, page, image ORDER BY record_id DESC) r FROM v) WHERE r = 1 AND keep)
 SELECT DISTINCT q.record_id, q.doc_name AS doc, q.page, q.image, CASE WHEN len(q.bbox) = 4 AND NOT list_contains(list_transform(q.bbox, lambda v: v IS NULL), true) THEN array_to_string(q.bbox, ',') END AS box FROM qa_records q JOIN l ON l.doc = q.doc_name AND l.page = q.page AND l.image = q.image""")
def semi_keep(spark: SparkSession, d: str) -> DataFrame:
    qa = table(spark, d, "qa_records").filter("image is not null").select("record_id", F.col("doc_name").alias("doc"), "page", "image", F.lit("text").alias("type"), "bbox").distinct()
    verdicts = qa.select("doc", "page", "image", F.col("record_id").alias("ord"), (F.col("record_id") % 4 != 0).alias("keep"))
    out = regions.merged_records(qa, verdicts)
    return out.select("record_id", "doc", "page", "image", F.array_join(F.col("bbox").cast("array<string>"), ",").alias("box")).distinct()


@query("""SELECT DISTINCT image, coalesce(try_cast(nullif(regexp_replace(image, '[^0-9]', '', 'g'), '') AS BIGINT), 1000000000) AS digits,
  try_cast(string_split(regexp_replace(image, '\\.png$', ''), '_')[-1] AS BIGINT) AS suffix FROM page_images""")
def page_sort(spark: SparkSession, d: str) -> DataFrame:
    stem = F.regexp_replace("image", r"\.png$", "")
    return table(spark, d, "page_images").select("image", tx.bare_number_key(F.col("image")).alias("digits"), tx.suffix_page(stem).alias("suffix")).distinct()


@query("SELECT doc_name, least(5, count(*)) AS n_sampled, true AS known FROM (SELECT DISTINCT doc_name, page FROM page_images) GROUP BY doc_name")
def page_sample(spark: SparkSession, d: str) -> DataFrame:
    """Five pages of each document by hash: how many were drawn, and whether they are pages of it."""
    pages = table(spark, d, "page_images").select("doc_name", "page").distinct()
    drawn = rows.page_sample(pages, ["doc_name"], "page", 5).distinct()
    known = pages.withColumn("k", F.lit(True))
    on = drawn["doc_name"].eqNullSafe(known["doc_name"]) & drawn["page"].eqNullSafe(known["page"])
    both = drawn.join(known, on, "left").select(drawn["doc_name"], "k")
    return both.groupBy("doc_name").agg(F.count("*").alias("n_sampled"), F.every(F.coalesce("k", F.lit(False))).alias("known"))


@query("""WITH c AS (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) ordinal FROM customer), s AS (SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_suppkey) ordinal FROM supplier)
 SELECT ordinal, c_custkey, c_name, s_suppkey, s_name FROM c JOIN s USING (ordinal)""")
def zip_join(spark: SparkSession, d: str) -> DataFrame:
    c = rows.with_ordinal(table(spark, d, "customer").select("c_custkey", "c_name"), ["c_custkey"])
    s = rows.with_ordinal(table(spark, d, "supplier").select("s_suppkey", "s_name"), ["s_suppkey"])
    return rows.positional_join(c, s)


@query("SELECT * FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) ordinal FROM part) WHERE ordinal > 100 AND ordinal <= 350")
def row_window(spark: SparkSession, d: str) -> DataFrame:
    """The window is the feature."""
    return rows.row_window(rows.with_ordinal(table(spark, d, "part").select("p_partkey"), ["p_partkey"]), "ordinal", 100, 250)


_STORED = "SELECT user_id AS sample_idx, event_id AS ord, value AS predict, CASE WHEN event_id % 3 = 0 THEN 'failed' END AS error FROM events"
_LAST = f"last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_idx ORDER BY ord DESC) r FROM ({_STORED})) WHERE r = 1)"


def _stored(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("sample_idx"), F.col("event_id").alias("ord"), F.col("value").alias("predict"), F.when(F.col("event_id") % 3 == 0, "failed").alias("error"))


@query(f"WITH {_LAST} SELECT DISTINCT user_id AS sample_idx FROM events WHERE user_id NOT IN (SELECT sample_idx FROM last WHERE error IS NULL) UNION SELECT -1")
def resume_pending(spark: SparkSession, d: str) -> DataFrame:
    stored = _stored(spark, d)
    inputs = stored.select("sample_idx").distinct().unionByName(spark.createDataFrame([(-1,)], "sample_idx bigint"))
    return rows.pending(inputs, stored, "sample_idx", "ord")


@query(f"""WITH {_LAST} SELECT sample_idx, CASE WHEN sample_idx % 2 = 0 THEN 'fresh' ELSE CAST(ord AS VARCHAR) END AS source FROM last""")
def resume_merge(spark: SparkSession, d: str) -> DataFrame:
    stored = _stored(spark, d)
    fresh = stored.filter("sample_idx % 2 = 0").groupBy("sample_idx").agg(F.lit(-1).cast("bigint").alias("ord"), F.max("predict").alias("predict"), F.lit(None).cast("string").alias("error"))
    out = rows.merged_results(stored, fresh.select("sample_idx", "ord", "predict", "error"), "sample_idx", "ord")
    return out.select("sample_idx", F.when(F.col("ord") == -1, "fresh").otherwise(F.col("ord").cast("string")).alias("source"))


@query("""WITH p AS (SELECT p_partkey, CAST(p_partkey % 9 + 4 AS INTEGER) w, CAST(p_partkey % 5 + 3 AS INTEGER) h, repeat(md5(CAST(p_partkey AS VARCHAR)), 18) x FROM part)
 SELECT p_partkey, md5(substr(x, 1, w * h * 6)) AS pixels, concat(substr(x, w * 6 + 7, 12), substr(x, w * 12 + 7, 12)) AS crop, CAST(2 AS INTEGER) AS crop_width, CAST(NULL AS VARCHAR) AS error FROM p""")
def png_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Small images drawn from part keys, encoded, cropped and decoded again."""
    p = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 9 + 4).cast("int").alias("w"), (F.col("p_partkey") % 5 + 3).cast("int").alias("h"))
    pixels = F.unhex(F.substring(F.repeat(F.md5(F.col("p_partkey").cast("string")), 18), F.lit(1), F.col("w") * F.col("h") * 6))
    made = p.withColumn("file", png.encoded(F.col("w"), F.col("h"), pixels))
    cut = png.cropped(F.col("file"), F.array(F.lit(1.0), F.lit(1.0), F.lit(3.0), F.lit(3.0)))
    back = made.select("p_partkey", png.decoded(F.col("file")).alias("r"), png.decoded(cut).alias("c"))
    shown = lambda c: F.lower(F.hex(c))
    return back.select("p_partkey", F.md5(shown("r.pixels")).alias("pixels"), shown("c.pixels").alias("crop"), F.col("c.width").alias("crop_width"), F.col("c.error").alias("error"))


@query("SELECT record_id, src, n FROM (SELECT record_id, 'qa' AS src, count(*) AS n FROM qa_records GROUP BY record_id UNION ALL SELECT ann_id, 'bench', count(*) FROM bench_annotations GROUP BY ann_id)")
def union_records(spark: SparkSession, d: str) -> DataFrame:
    qa = table(spark, d, "qa_records").select("record_id", F.lit("qa").alias("src"))
    b = table(spark, d, "bench_annotations").select(F.col("ann_id").alias("record_id"), F.lit("bench").alias("src"))
    return qa.unionByName(b).groupBy("record_id", "src").agg(F.count("*").alias("n"))

"""Annotations to chat samples, crops and training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions import boxparse, geometry
from folioframe.functions import text as tx


def image_tokens(mode: Column, evidence_page: Column, bbox: Column, images: Column) -> Column:
    """Number of image tokens of a prompt."""
    n_images = F.coalesce(F.size(images), F.lit(0))
    n_pages = F.coalesce(F.size(evidence_page), F.lit(0))
    boxes = F.coalesce(F.aggregate(bbox, F.lit(0), lambda acc, p: acc + F.size(geometry.whole_boxes(p))), F.lit(0))
    some = lambda n: F.when(n > 0, n).otherwise(n_images)
    return F.when(mode.isin("page", "bbox"), some(n_pages)).when(mode == "document", n_images).otherwise(some(boxes))


def chat_samples(ann: DataFrame, mode: str, prefix: str | None = None) -> DataFrame:
    """D1 rows with ``images`` -> chat rows. Box mode asks for the page-wise boxes; rows without a target or images drop out."""
    m = F.lit(mode)
    n = image_tokens(m, F.col("evidence_page"), F.col("bbox"), F.col("images"))
    prompt = tx.chat_prompt(F.coalesce("query", F.lit("")), n, tx.prompt_prefix(m, prefix))
    target = geometry.bbox_target(F.col("rel_bbox")) if mode == "bbox" else F.col("answer")
    out = ann.withColumn("bbox_target", target if mode == "bbox" else F.lit(None).cast("string"))
    messages = F.array(
        F.struct(F.lit("user").alias("role"), prompt.alias("content")), F.struct(F.lit("assistant").alias("role"), target.alias("content"))
    )
    out = out.filter(F.coalesce(F.size("images"), F.lit(0)) > 0)
    if mode == "bbox":
        out = out.filter("bbox_target is not null")
    return out.withColumn("messages", messages).withColumn("image_mode", m)


def page_images(ann: DataFrame, pages: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """key -> images: the path of every evidence page in order; a page without image gives status ``missing``.

    ``pages`` holds category, doc_name, page, image. ``strict`` fails the job instead.
    """
    want = ann.select(key, "category", "doc_name", F.posexplode("evidence_page").alias("__i", "page"))
    got = want.join(pages.select("category", "doc_name", "page", "image"), ["category", "doc_name", "page"], "left")
    image = F.col("image")
    if strict:
        image = F.coalesce(image, F.raise_error(F.concat(F.lit("missing page image of "), F.col("doc_name"))).cast("string"))
    return got.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("__i", image.alias("image")))), lambda x: x["image"]).alias("images"),
        F.when(F.count_if(F.col("image").isNull()) > 0, "missing").otherwise("ok").alias("status"),
    )


def document_images(pages: DataFrame) -> DataFrame:
    """category, doc_name -> images of all pages in numeric order."""
    by_page = F.array_sort(F.collect_list(F.struct("page", "image")))
    return pages.groupBy("category", "doc_name").agg(F.transform(by_page, lambda x: x["image"]).alias("images"))


def annotation_crops(ann: DataFrame, ordinal: str, width: str, height: str) -> DataFrame:
    """One row per box of an annotation: clamped pixels (towards zero), type, crop name, empty boxes marked."""
    pages = ann.select(
        ordinal, "category", "doc_name", width, height, F.col("evidence_page"), F.col("subimg_type"), F.posexplode("bbox").alias("page_pos", "boxes")
    )
    one = pages.select(
        "*", F.posexplode(geometry.whole_boxes(F.col("boxes"))).alias("box_pos", "box")
    )
    page = F.get("evidence_page", F.col("page_pos"))
    kind = F.coalesce(F.get(F.get("subimg_type", F.col("page_pos")), F.col("box_pos")), F.lit("unknown"))
    px = geometry.clamp_truncated(F.col("box"), F.col(width), F.col(height))
    out = one.filter(page.isNotNull()).select(
        F.col(ordinal), "doc_name", page.alias("page"), "page_pos", "box_pos", kind.alias("type"), px.alias("pixels"), "category"
    )
    name = F.format_string(
        "sample_%05d_%s_%s_p%d_r%d_%s.png", F.col(ordinal), F.col("category"), F.col("doc_name"), F.col("page"), F.col("box_pos") + 1, F.col("type")
    )
    return out.withColumn("crop_name", name).withColumn(
        "status", F.when((F.col("pixels")[2] > F.col("pixels")[0]) & (F.col("pixels")[3] > F.col("pixels")[1]), "ok").otherwise("empty")
    )


def predicted_crops(df: DataFrame, key: str, predict: str, n_images: Column, width: str, height: str, min_edge: int = 28) -> DataFrame:
    """One row per predicted box: relative text boxes to pixels, with a status per box (ok, too_small).

    Rows whose text can't be read give one row with status ``invalid_predicted_boxes``; rows without boxes ``no_usable_crops``.
    """
    parsed = df.withColumn("__pages", boxparse.parsed_crops(F.col(predict), n_images))
    flat = parsed.select(key, "evidence_page", width, height, "__pages", F.posexplode_outer("__pages").alias("page_pos", "__boxes"))
    flat = flat.select("*", F.posexplode_outer("__boxes").alias("box_pos", "box"))
    px = geometry.absolute(F.col("box"), F.col(width), F.col(height))
    page = F.coalesce(F.get("evidence_page", F.col("page_pos")), F.col("page_pos") + 1)
    status = (
        F.when(F.col("__pages").isNull(), "invalid_predicted_boxes")
        .when(F.col("box").isNull(), "no_usable_crops")
        .when(~geometry.has_min_edge(px, min_edge), "too_small")
        .otherwise("ok")
    )
    return flat.select(key, page.alias("page"), "page_pos", "box_pos", px.alias("pixels"), status.alias("status"))


def evidence_map(sources: list[DataFrame]) -> DataFrame:
    """First source with any usable row wins: image, page list, box and type per crop; later rows of an image replace earlier ones.

    Each source has ord, image, img, filename, page (text), bbox_xyxy, bbox, bbox_xywh, type.
    """
    rows = None
    for rank, s in enumerate(sources):
        one = s.select(
            F.lit(rank).alias("rank"), "ord", tx.first_filled(F.col("image"), F.col("img"), F.col("filename")).alias("image"),
            F.when(F.col("page").try_cast("bigint").isNotNull(), F.array(F.col("page").try_cast("bigint"))).otherwise(F.array().cast("array<bigint>")).alias("page"),
            F.coalesce(*[F.when(F.size(c) > 0, F.col(c)) for c in ("bbox_xyxy", "bbox", "bbox_xywh")]).alias("bbox"),
            F.coalesce("type", F.lit("unknown")).alias("type"),
        ).filter("image <> ''")
        rows = one if rows is None else rows.unionByName(one)
    best = rows.agg(F.min("rank").alias("best"))
    won = rows.join(F.broadcast(best), rows["rank"] == best["best"])  # one row
    return won.groupBy("image").agg(F.max_by(F.struct("page", "bbox", "type"), "ord").alias("e")).select("image", "e.*")


def with_evidence(crops: DataFrame, evidence: DataFrame, folder: str = "clean_crops") -> DataFrame:
    """Crops (image) with their evidence; a default where there is none."""
    ev = evidence.select("image", F.struct(F.col("page"), F.col("bbox"), F.concat(F.lit(folder + "/"), "image").alias("image"), F.col("type")).alias("evidence"))
    default = F.struct(
        F.array().cast("array<bigint>").alias("page"), F.lit(None).cast("array<bigint>").alias("bbox"),
        F.concat(F.lit("./"), "image").alias("image"), F.lit("unknown").alias("type"),
    )
    return crops.join(ev, "image", "left").withColumn("evidence", F.coalesce("evidence", default))


def training_rows(qa: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """One row per question of records with a page and a four-part box: query, answer and the evidence nested again.

    Records hold doc_name, image, page (list), bbox, type, qas. A blank type is
    looked up by image in ``types`` (image, type), else it is unknown.
    """
    usable = qa.filter((F.coalesce(F.size("page"), F.lit(0)) > 0) & (F.coalesce(F.size("bbox"), F.lit(0)) == 4))
    kind = F.nullif(F.col("type"), F.lit(""))
    if types is not None:
        side = types.groupBy("image").agg(F.max("type").alias("__t"))
        usable = usable.join(side, "image", "left")
        kind = F.coalesce(kind, F.nullif(F.col("__t"), F.lit("")))
    flat = usable.select("*", F.posexplode("qas").alias("item_pos", "item"))
    return flat.select(
        F.col("item.q").alias("query"), F.col("item.a").alias("answer"), "doc_name", F.array(F.col("page")[0]).alias("evidence_page"),
        F.array(F.array("bbox")).alias("bbox"), F.array(F.array(F.coalesce(kind, F.lit("unknown")))).alias("subimg_type"), "image", "item_pos",
    )

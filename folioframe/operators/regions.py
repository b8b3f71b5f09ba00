"""Page regions: crop verdicts, their summaries, overlap pruning and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions import geometry
from folioframe.functions import text as tx
from folioframe.plans.staging import stage

KINDS = ("text", "table", "image")
OVERLAP = 0.90


def _truth(v: Column) -> Column:
    """Truthiness of a variant: false, 0, '', [], {} and null are false, any other value is true."""
    kind = F.schema_of_variant(v)
    s = F.try_variant_get(v, "$", "string")
    return (
        F.when(v.isNull(), False)
        .when(kind == "BOOLEAN", s == "true")
        .when(kind == "VOID", False)
        .when(kind == "STRING", s != "")
        .when(F.startswith(kind, F.lit("ARRAY")) | F.startswith(kind, F.lit("OBJECT")), ~s.isin("[]", "{}"))
        .otherwise(F.coalesce(F.try_variant_get(v, "$", "double") != 0, F.lit(True)))
    )


def crop_verdict(raw: Column) -> Column:
    """struct(keep, type) of a judge's text: the whole text, else its first braced block, else (false, unknown)."""

    def read(c: Column) -> Column:
        v = F.try_parse_json(c)
        ok = F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
        kind = F.lower(F.coalesce(F.try_variant_get(v, "$.type", "string"), F.lit("unknown")))
        return F.when(
            ok,
            F.struct(
                _truth(F.try_variant_get(v, "$.keep", "variant")).alias("keep"),
                F.when(kind.isin(*KINDS), kind).otherwise("unknown").alias("type"),
            ),
        )

    nothing = F.struct(F.lit(False).alias("keep"), F.lit("unknown").alias("type"))
    text = tx.strip(raw)
    return F.coalesce(read(text), read(tx.braced_block(text)), nothing)


def verdict_summary(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """total, keep_true, keep_false and one count per type (all four always there) of rows with keep, type."""
    kind = F.coalesce(F.col("type"), F.lit("unknown"))
    return df.groupBy(*(by or [])).agg(
        F.count("*").alias("total"), F.count_if(F.col("keep")).alias("keep_true"),
        F.count_if(~F.coalesce("keep", F.lit(False))).alias("keep_false"),
        *[F.count_if(kind == k).alias(f"n_{k}") for k in (*KINDS, "unknown")],
    )


def rolled_up(df: DataFrame) -> DataFrame:
    """Summaries per page, per document and in all (doc, page null where summed over)."""
    kind = F.coalesce(F.col("type"), F.lit("unknown"))
    return df.rollup("doc", "page").agg(
        F.count("*").alias("images"), F.count_if(F.col("keep")).alias("keep_true"),
        F.count_if(~F.coalesce("keep", F.lit(False))).alias("keep_false"),
        *[F.count_if(kind == k).alias(f"n_{k}") for k in (*KINDS, "unknown")],
    )


def crop_name_parts(name: Column) -> tuple[Column, Column]:
    """(page, id) of ``<page>_final_<id>.<ext>``; null where the name has another form."""
    rx = r"^(\d+)_final_(\d+)\.\w+$"
    return (F.regexp_extract(name, rx, 1).try_cast("bigint"), F.regexp_extract(name, rx, 2).try_cast("bigint"))


def with_masks(verdicts: DataFrame, masks: DataFrame) -> DataFrame:
    """Verdicts (page, id) with the box of their first mask (smallest ``ord``); null box where there is none."""
    first = masks.groupBy("page", "id").agg(F.min_by("box", "ord").alias("box"))
    return verdicts.join(first, ["page", "id"], "left")


def overlap_pairs(crops: DataFrame, least: float = OVERLAP) -> DataFrame:
    """Pairs a before b (by name) of one page and type that overlap by ``least`` of the smaller box, with the one to drop.

    Of texts the larger goes, of tables and images the smaller; equal areas drop the earlier.
    """
    known = crops.filter(F.col("type").isin(*KINDS) & F.col("box").isNotNull())
    a = known.select("page", "type", F.col("name").alias("a"), F.col("box").alias("box_a"))
    b = known.select("page", "type", F.col("name").alias("b"), F.col("box").alias("box_b"))
    near = a.join(b, ["page", "type"]).filter("a < b")
    near = near.filter(geometry.overlap_of_smaller(F.col("box_a"), F.col("box_b")) >= least)
    sa, sb = geometry.area(F.col("box_a")), geometry.area(F.col("box_b"))
    drop_a = F.when(F.col("type") == "text", sa >= sb).otherwise(sa <= sb)
    return near.select("page", "a", "b", F.when(drop_a, F.col("a")).otherwise(F.col("b")).alias("drop"))


def pruned(crops: DataFrame, least: float = OVERLAP) -> DataFrame:
    """Crops (page, name, type, box) that survive greedy pruning, page by page in name order.

    A pair is skipped when one of its crops is gone already, so the order
    matters: a fold over the ordered pairs of a page carries the dropped names.
    """
    pairs = overlap_pairs(crops, least).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("a", "b", "drop"))).alias("pairs"))
    gone = F.aggregate(
        "pairs",
        F.array().cast("array<string>"),
        lambda acc, x: F.when(
            F.array_contains(acc, x["a"]) | F.array_contains(acc, x["b"]), acc
        ).otherwise(F.array_append(acc, x["drop"])),
    )
    dropped = pairs.select("page", F.explode(gone).alias("name"))
    return crops.join(dropped, ["page", "name"], "left_anti")


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the one with the largest ``order``."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def merged_records(clean: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Clean items whose last verdict keeps them: doc, page, image, type, whole-pixel box (null if any part is unreadable)."""
    kept = keep_last(verdicts, ["doc", "page", "image"], "ord").filter("keep").select("doc", "page", "image")
    ints = F.transform("bbox", lambda v: v.cast("string").try_cast("double").try_cast("int"))
    whole = F.when((F.size(ints) == 4) & ~F.exists(ints, lambda v: v.isNull()), ints)
    return clean.join(kept, ["doc", "page", "image"], "left_semi").withColumn("bbox", whole)


def page_order(page: str = "page") -> list[Column]:
    return [tx.bare_number_key(F.col(page)), F.col(page)]


def mask_candidates(masks: DataFrame, least: float = 0.05, most: float = 0.70, pad: float = 10.0) -> DataFrame:
    """Crop candidates of segmented pages (page, mask_no, bbox as x, y, w, h, width, height): kept share of the page, padded box, crop name.

    Stands where a segmentation model would: the masks are a table.
    """
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    corners = geometry.mask_box(F.col("bbox"), w, h)
    sides = F.greatest(F.col("bbox")[2], F.lit(0)) * F.greatest(F.col("bbox")[3], F.lit(0))
    ratio = F.when(w * h > 0, F.coalesce(sides, w * h) / (w * h)).otherwise(0.0)
    out = masks.withColumns({"box": corners, "ratio": ratio}).filter(F.col("ratio").between(least, most))
    name = F.format_string("%s_final_%03d.png", F.col("page").cast("string"), F.col("mask_no"))
    return out.withColumns({"padded": geometry.padded(F.col("box"), F.lit(pad), w, h), "name": name})


def crop_status(crops: DataFrame, listing: DataFrame, least: float = OVERLAP) -> DataFrame:
    """Kept crops (page, name, type, box) with their status: missing (no file in ``listing``: page, name), pruned or kept."""
    left = pruned(crops, least).select("page", "name", F.lit(True).alias("__left"))
    there = listing.select("page", "name").distinct().withColumn("__there", F.lit(True))
    both = crops.join(left, ["page", "name"], "left").join(there, ["page", "name"], "left")
    status = F.when(F.col("__there").isNull(), "missing").when(F.col("__left").isNull(), "pruned").otherwise("kept")
    return both.withColumn("status", status).drop("__left", "__there")


def post_clean(stored: DataFrame, masks: DataFrame, raw: str = "raw_output", least: float = OVERLAP) -> DataFrame:
    """Cleaning alone, from stored judge texts: verdicts read again, first masks joined, kept crops pruned."""
    # written once: the long expression of a verdict would be copied into every use
    read = stage(stored.select("page", "id", "name", crop_verdict(F.col(raw)).alias("v")), "verdicts")
    read = read.select("page", "id", "name", "v.keep", "v.type").filter("keep")
    return pruned(with_masks(read, masks).select("page", "id", "name", "type", "box"), least)

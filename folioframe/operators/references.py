"""References to records that do not exist (dangling keys over time).

References are counted per key and period first. A key that holds at least a
2,000th of all references is heavy: there can be at most 2,000 such keys, and
their references are checked on the map side against the broadcast lifetimes of
their targets, if these pass a check of their number. All others meet their
targets in a shuffle anti-join. The orphans of both sides are united.

Lifetimes of one target that touch or overlap are merged first, so a target
registered over and over has one interval.

Defined results: null names and null elements are no references; a reference
whose row has no time has no live target; a target row without
``registered_at`` is never live; repeated rows give one reference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.plans.staging import stage

#: A key with at least 1/HEAVY_KEYS of all references is heavy, so there are at most this many.
HEAVY_KEYS = 2000
#: Most lifetimes of heavy keys that are broadcast (about 20 MB); more meet salted references in a shuffle.
HEAVY_LIVES = 200_000
SALTS = 64

KEY = ["kind", "k_name", "k_page"]
REF = ["ref_table", "ref_id", "ref_field", "item_pos", *KEY, "ref_time"]


def scalar_refs(df: DataFrame, table: str, id_col: str, field: str, kind: str, name: Column, time_col: str) -> DataFrame:
    out = df.select(
        F.lit(table).alias("ref_table"),
        F.col(id_col).cast("bigint").alias("ref_id"),
        F.lit(field).alias("ref_field"),
        F.lit(0).cast("bigint").alias("item_pos"),
        F.lit(kind).alias("kind"),
        name.alias("k_name"),
        F.lit(-1).cast("bigint").alias("k_page"),
        F.col(time_col).alias("ref_time"),
    )
    return out.filter(F.col("k_name").isNotNull())


def array_refs(
    df: DataFrame, table: str, id_col: str, field: str, kind: str, items: str, owner: Column | None, time_col: str
) -> DataFrame:
    """One reference per element of ``items``: page numbers of ``owner``, or names if ``owner`` is None."""
    base = df if owner is None else df.filter(owner.isNotNull())
    flat = base.select(
        F.col(id_col).cast("bigint").alias("ref_id"),
        (F.lit(None).cast("string") if owner is None else owner).alias("__owner"),
        F.col(time_col).alias("ref_time"),
        F.posexplode(items).alias("__pos", "__item"),
    ).filter(F.col("__item").isNotNull())
    by_name = owner is None
    return flat.select(
        F.lit(table).alias("ref_table"),
        "ref_id",
        F.lit(field).alias("ref_field"),
        F.col("__pos").cast("bigint").alias("item_pos"),
        F.lit(kind).alias("kind"),
        (F.col("__item") if by_name else F.col("__owner")).alias("k_name"),
        (F.lit(-1) if by_name else F.col("__item")).cast("bigint").alias("k_page"),
        "ref_time",
    )


def target_rows(df: DataFrame, kind: str, name: Column, page: Column | None) -> DataFrame:
    return df.select(
        F.lit(kind).alias("kind"),
        name.alias("k_name"),
        (F.lit(-1) if page is None else page).cast("bigint").alias("k_page"),
        F.col("registered_at").alias("since"),
        F.col("deleted_at").alias("until"),
    ).filter("k_name is not null and k_page is not null and since is not null and (until is null or since < until)")


def lifetimes(targets: DataFrame) -> DataFrame:
    """Targets with the lifetimes of a key merged into disjoint intervals (``until`` null: still alive).

    Merging runs within months first: what the second step sees of a key is no
    longer its rows but the few intervals that its months leave.
    """
    far = F.lit("9999-12-31 23:59:59").cast(targets.schema["since"].dataType)
    rows = targets.withColumn("until", F.coalesce("until", far))
    ends = {f"{f.__name__}_{c}": f(c).alias(f"{f.__name__}_{c}") for c in ("since", "until") for f in (F.min, F.max)}
    per_key = stage(rows.groupBy(*KEY).agg(*ends.values()), "target-keys")
    one = (F.col("min_since") == F.col("max_since")) & (F.col("min_until") == F.col("max_until"))

    def merged(df: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("since", "until")
        reach = F.max("until").over(w.rowsBetween(Window.unboundedPreceding, -1))
        df = df.withColumn("fresh", F.when(reach >= F.col("since"), 0).otherwise(1))
        df = df.withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        return df.groupBy(*keys, "island").agg(F.min("since").alias("since"), F.max("until").alias("until")).drop("island")

    # nearly all keys have one lifetime, which the aggregate gives; only rows of the others are merged
    several = rows.join(per_key.filter(~one).select(*KEY), KEY, "left_semi").withColumn("month", F.date_format("since", "yyyy-MM"))
    several = merged(merged(several, [*KEY, "month"]).drop("month"), KEY)
    lone = per_key.filter(one).select(*KEY, F.col("min_since").alias("since"), F.col("min_until").alias("until"))
    return lone.unionByName(several.select(lone.columns)).withColumn("until", F.nullif("until", far))


def heavy_keys(refs: DataFrame, total: int, most: int = HEAVY_KEYS) -> DataFrame:
    """Keys with at least 1/``most`` of all ``total`` references, from the counts per key and period."""
    counted = refs.groupBy(*KEY, "period").agg(F.count("*").alias("n_refs"))
    per_key = counted.groupBy(*KEY).agg(F.sum("n_refs").alias("n_refs"))
    return per_key.filter(F.col("n_refs") * most >= total).select(*KEY)


def _alive(r: str, t: str) -> Column:
    time = F.col(f"{r}.ref_time")
    return (F.col(f"{t}.since") <= time) & (F.col(f"{t}.until").isNull() | (time < F.col(f"{t}.until")))


def _without_target(refs: DataFrame, lives: DataFrame, keys: list[str], hint: bool = False) -> DataFrame:
    """References of which no lifetime of their key holds the time."""
    on = _alive("r", "t")
    for k in keys:
        on = on & (F.col(f"r.{k}") == F.col(f"t.{k}"))
    side = lives.alias("t")
    return refs.alias("r").join(F.broadcast(side) if hint else side, on, "left_anti")


def orphans(refs: DataFrame, targets: DataFrame, most_heavy: int = HEAVY_KEYS, most_lives: int = HEAVY_LIVES) -> DataFrame:
    """All references of ``refs`` (columns REF) without a live target, with their period (month)."""
    period = F.coalesce(F.date_format("ref_time", "yyyy-MM"), F.lit(""))
    refs = stage(refs.select(*REF, period.alias("period")), "references")
    heavy = stage(heavy_keys(refs, refs.count(), most_heavy), "heavy-keys")
    top = F.broadcast(heavy)  # at most ``most_heavy`` rows
    # only the tests of heavy keys and the anti-join use the lifetimes
    lives = stage(lifetimes(targets), "lifetimes")
    lives_heavy = stage(lives.join(top, KEY, "left_semi"), "heavy-lifetimes")
    refs_heavy = refs.join(top, KEY, "left_semi")
    if lives_heavy.count() <= most_lives:
        found_heavy = _without_target(refs_heavy, lives_heavy, KEY, hint=True)
    else:
        salted = refs_heavy.withColumn("salt", F.pmod(F.xxhash64("ref_id", "item_pos"), F.lit(SALTS)))
        spread = lives_heavy.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).cast("bigint"))
        found_heavy = _without_target(salted, spread, [*KEY, "salt"])
    found_light = _without_target(refs.join(top, KEY, "left_anti"), lives.join(top, KEY, "left_anti"), KEY)
    cols = [*REF, "period"]
    return found_heavy.select(*cols).unionByName(found_light.select(*cols))


def qa_references(chat: DataFrame, bench: DataFrame, qa: DataFrame) -> DataFrame:
    """References of the three tables that name documents and page images."""
    doc = F.col("doc_name")
    parts = [
        scalar_refs(t, name, key, "doc_name", "doc", doc, "created_at")
        for t, name, key in (
            (chat, "chat_samples", "sample_id"),
            (bench, "bench_annotations", "ann_id"),
            (qa, "qa_records", "record_id"),
        )
    ]
    parts += [
        array_refs(t, name, key, "evidence_page", "page", "evidence_page", doc, "created_at")
        for t, name, key in ((chat, "chat_samples", "sample_id"), (bench, "bench_annotations", "ann_id"))
    ]
    paged = chat.filter(F.coalesce(F.col("image_mode"), F.lit("")) != "crop")
    parts.append(array_refs(paged, "chat_samples", "sample_id", "images", "image", "images", None, "created_at"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def qa_targets(catalog: DataFrame, pages: DataFrame) -> DataFrame:
    return (
        target_rows(catalog, "doc", F.col("doc_name"), None)
        .unionByName(target_rows(pages, "page", F.col("doc_name"), F.col("page")))
        .unionByName(target_rows(pages, "image", F.col("image"), None))
    )


def orphan_list(chat: DataFrame, bench: DataFrame, qa: DataFrame, catalog: DataFrame, pages: DataFrame) -> DataFrame:
    found = orphans(qa_references(chat, bench, qa), qa_targets(catalog, pages))
    return found.select("ref_table", "ref_id", "ref_field", "item_pos").distinct()


def orphan_counts(chat: DataFrame, bench: DataFrame, qa: DataFrame, catalog: DataFrame, pages: DataFrame) -> DataFrame:
    """Orphan references per referring table and month of ``created_at`` (repeated rows count once)."""
    found = orphans(qa_references(chat, bench, qa), qa_targets(catalog, pages))
    once = found.select("ref_table", "ref_id", "ref_field", "item_pos", "period").distinct()
    return once.groupBy("ref_table", "ref_field", "period").agg(F.count("*").alias("n_orphans"))

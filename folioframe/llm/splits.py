"""Splits that keep related records together.

Documents are related by a shared author or by names that denote one work.
Both relations are stars around hubs (author, work), so no pairs are made. A
Boruvka-style contraction finds the groups: every component picks its smallest
outgoing edge, the picks are kept as a spanning forest in the shared folder,
components are contracted along them until no edge is left. The largest groups
are then dealt one by one, the others by size band, to what the splits still need.

Defined results: null names are left out; null, empty and filler authors relate
nobody; repeated rows change nothing; a document without relatives is its own
group; records of documents that are not in the catalogue form groups by work.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions.prefix import running_total
from folioframe.plans.staging import stage

#: Author entries that name nobody, in lower case without outer blanks.
FILLER_AUTHORS = [
    "", "-", "--", "—", "–", "?", ".", "n/a", "n.a.", "na", "n.n.", "nn", "none", "null", "nil", "unknown", "unbekannt",
    "inconnu", "desconocido", "anonymous", "anonym", "anonyme", "anon", "anon.", "various", "various authors", "et al.",
    "et al", "others", "and others", "author", "authors", "unknown author", "no author", "not available", "tba", "tbd", "nobody",
]

#: Languages and states that a file name may carry at its end.
LANGUAGES = ["en", "de", "fr", "es", "it", "pt", "nl", "pl", "ru", "zh", "ja", "ko", "ar", "tr", "sv", "da", "no", "fi", "cs", "el", "uk", "eng", "deu", "ger", "fra", "fre", "spa", "ita", "english", "german", "french", "spanish"]
STATES = ["draft", "final", "camera-ready", "camera ready", "camera_ready", "preprint", "postprint", "submitted", "accepted", "published", "corrected", "revised", "proof", "print", "copy", "kopie", "copie", "copia", "translation", "translated"]
#: Fixed number: groups dealt one by one on the driver.
TOP_GROUPS = 1024
EXTENSIONS = ["pdf", "djvu", "ps", "doc", "docx", "odt", "tex", "txt", "html", "htm", "xml", "epub"]

_TAIL = (
    r"(?:"
    + r"\.(?:" + "|".join(EXTENSIONS) + r")"
    + r"|[\s._-]*\(\d+\)"
    + r"|[\s._-]+(?:" + "|".join(re.escape(x) for x in STATES) + r")(?:[\s._-]*\d+)?"
    + r"|[\s._-]+(?:" + "|".join(LANGUAGES) + r")"
    + r"|[\s._-]+(?:version|ver|rev|revision|r|v)[\s._]*\d+"
    + r"|(?<=\d)v\d+"
    + r")+\s*$"
)


def work_key(name: Column) -> Column:
    """The work a document name denotes: without revision, state, translation, copy and file spelling."""
    low = F.trim(F.lower(name))
    stem = F.regexp_replace(low, r"^copy of\s+|^copy_of_", "")
    stem = F.regexp_replace(stem, _TAIL, "")
    key = F.regexp_replace(stem, r"[\s._-]+", "-")
    return F.when(F.length(F.regexp_replace(key, "-", "")) > 0, key).otherwise(low)


def star_edges(catalog: DataFrame) -> DataFrame:
    """(doc, hub) edges to authors and works; hubs of a single document are left out."""
    named = catalog.filter(F.col("doc_name").isNotNull()).select(F.col("doc_name").alias("doc"), "authors")
    author = F.trim(F.regexp_replace(F.lower(F.col("a")), r"(?U)^\s+|\s+$", ""))
    by_author = (
        named.select("doc", F.explode("authors").alias("a"))
        .select("doc", author.alias("a"))
        .filter(F.col("a").isNotNull() & ~F.col("a").isin(FILLER_AUTHORS))
        .select("doc", F.concat(F.lit("a:"), "a").alias("hub"))
    )
    by_work = named.select("doc", F.concat(F.lit("w:"), work_key(F.col("doc"))).alias("hub"))
    edges = by_author.unionByName(by_work).distinct()
    shared = edges.groupBy("hub").agg(F.count("*").alias("n")).filter("n > 1").select("hub")
    return edges.join(shared, "hub", "left_semi").select("doc", "hub")


def spanning_forest(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 64) -> tuple[DataFrame, DataFrame]:
    """(component of every vertex, forest edges) of an undirected edge table.

    Every table a round needs is written to the shared folder, so lineage stays
    short and executors may be lost. Only row counts reach the driver. Every
    round at least halves the components, so 64 rounds do for any table.
    """
    # unique weights: ties of the hash are broken by the end points inside the struct
    base = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).filter("u is not null and v is not null and u <> v")
    base = base.withColumn("w", F.xxhash64("u", "v"))
    live = stage(base.select(F.col("u").alias("cu"), F.col("v").alias("cv"), F.struct("w", "u", "v").alias("e")), "edges")
    spark = edges.sparkSession
    label = stage(
        live.select(F.explode(F.array("cu", "cv")).alias("vertex")).distinct().withColumn("comp", F.col("vertex")), "labels"
    )
    forest: DataFrame | None = None
    for _ in range(max_rounds):
        ends = live.select("cu", "cv", "e").unionByName(live.select(F.col("cv").alias("cu"), F.col("cu").alias("cv"), "e"))
        pick = stage(ends.groupBy("cu").agg(F.min(F.struct("e", "cv")).alias("m")).select(F.col("cu").alias("c"), F.col("m.cv").alias("to"), F.col("m.e").alias("e")), "picks")
        if pick.limit(1).count() == 0:
            break
        kept = pick.select("e.u", "e.v")
        forest = kept if forest is None else forest.unionByName(kept)
        back = pick.select(F.col("c").alias("to"), F.col("to").alias("back"))
        parent = pick.join(back, "to").select(
            "c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("p")
        )
        parent = stage(parent, "parents")
        while True:
            up = parent.select(F.col("c").alias("p"), F.col("p").alias("pp"))
            nxt = stage(parent.join(up, "p").select("c", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), "jumps")
            parent = nxt.select("c", "p")
            if nxt.filter("moved").limit(1).count() == 0:
                break
        label = stage(
            label.join(parent, label["comp"] == parent["c"], "left").select("vertex", F.coalesce("p", "comp").alias("comp")), "labels"
        )
        a, b = parent.select(F.col("c").alias("cu"), F.col("p").alias("pu")), parent.select(F.col("c").alias("cv"), F.col("p").alias("pv"))
        rest = live.join(a, "cu").join(b, "cv").filter("pu <> pv")
        live = stage(
            rest.groupBy(F.least("pu", "pv").alias("cu"), F.greatest("pu", "pv").alias("cv")).agg(F.min("e").alias("e")), "edges"
        )
    else:
        raise RuntimeError(f"components are left after {max_rounds} rounds")
    if forest is None:
        forest = spark.createDataFrame([], "u string, v string")
    return label, stage(forest.distinct(), "spanning-forest")


def document_forest(catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(component of every document and hub, spanning forest) of the relations; both lie in the shared folder.

    Documents are prefixed d:, authors a:, works w:, so no document is taken for a hub.
    """
    edges = star_edges(catalog)
    return spanning_forest(edges.select(F.concat(F.lit("d:"), "doc").alias("u"), F.col("hub").alias("v")))


def document_groups(catalog: DataFrame) -> DataFrame:
    """doc_name, group_name of every named document (the smallest name of its group by code points)."""
    docs = catalog.filter(F.col("doc_name").isNotNull()).select("doc_name").distinct()
    label, _ = document_forest(catalog)
    members = label.filter(F.col("vertex").startswith("d:")).select(F.substring(F.col("vertex"), 3, 1 << 30).alias("doc_name"), "comp")
    least = members.groupBy("comp").agg(F.min("doc_name").alias("group_name"))
    named = members.join(least, "comp").select("doc_name", "group_name")
    return docs.join(named, "doc_name", "left").select("doc_name", F.coalesce("group_name", "doc_name").alias("group_name"))


def related_documents(catalog: DataFrame) -> DataFrame:
    """Documents related to at least one other document, with their group."""
    groups = document_groups(catalog)
    big = groups.groupBy("group_name").agg(F.count("*").alias("n")).filter("n > 1").select("group_name")
    return groups.join(big, "group_name", "left_semi").select("doc_name", "group_name")


def _deal_largest(top: list, targets: list[float]) -> tuple[list[int], list[float]]:
    """The split of each of the largest groups, and the records every split still needs.

    Each group goes to the split it overfills least, of these to the one least filled with it in parts of its target.
    """
    given, dealt = [0.0] * len(targets), []
    for r in top:
        filled = [g + r["n_records"] for g in given]
        at = min(range(len(targets)), key=lambda i: (max(0.0, filled[i] - targets[i]), filled[i] / targets[i] if targets[i] > 0 else float("inf"), i))
        given[at] += r["n_records"]
        dealt.append(at)
    return dealt, [max(0.0, t - g) for t, g in zip(targets, given)]


def assign_splits(
    sizes: DataFrame, shares: tuple[tuple[str, float], ...] = (("train", 0.8), ("validation", 0.1), ("test", 0.1)), seed: int = 7
) -> DataFrame:
    """group_name, n_records -> split. The largest groups are dealt one by one, the others systematically by size band.

    The ``TOP_GROUPS`` largest groups go, largest first, to the split they
    overfill least, else to the one least filled so far. What each split then still needs of the whole is the stretch
    it gets of the others: within a band (power of two) they lie in hashed
    order on a line as long as their records. None of them has more than a
    ``TOP_GROUPS``-th of all records, so their bands miss the needs by little.
    Shares are missed by more only where single groups are larger than a share.
    """
    banded = sizes.withColumn("band", F.floor(F.log2(F.greatest(F.col("n_records"), F.lit(1)))).cast("int"))
    banded = banded.withColumn("h", F.xxhash64("group_name", F.lit(seed)))
    names = [name for name, _ in shares]
    total = banded.agg(F.sum("n_records")).first()[0] or 0
    order = [F.col("n_records").desc(), F.col("h"), F.col("group_name")]
    top = banded.filter("n_records > 0").orderBy(*order).limit(TOP_GROUPS).select("group_name", "n_records").collect()
    dealt, needs = _deal_largest(top, [share * total for _, share in shares])
    single = sizes.sparkSession.createDataFrame(
        [(r["group_name"], names[at]) for r, at in zip(top, dealt)], "group_name string, single string"
    )
    banded = banded.join(F.broadcast(single), "group_name", "left")
    rest = banded.filter("single is null").drop("single")
    bucket = F.shiftright(F.col("h"), 54)  # 1,024 buckets, monotone in the hash
    lined = running_total(rest, ["band"], bucket, [F.col("h"), F.col("group_name")], "n_records", "before")
    bands = rest.groupBy("band").agg(F.sum("n_records").alias("band_records"))
    mid = (F.col("before") + F.col("n_records") / 2.0) / F.greatest(F.col("band_records"), F.lit(1))
    whole = sum(needs)
    parts = [n / whole for n in needs] if whole > 0 else [share for _, share in shares]
    split, edge = None, 0.0
    for name, part in zip(names[:-1], parts):
        edge += part
        split = F.when(mid < edge, name) if split is None else split.when(mid < edge, name)
    split = F.lit(names[-1]) if split is None else split.otherwise(names[-1])
    columns = ["group_name", "n_records", "band"]
    return lined.join(F.broadcast(bands), "band").select(*columns, split.alias("split")).unionByName(
        banded.filter("single is not null").select(*columns, F.col("single").alias("split"))
    )


def named_records(tables: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """src_table, record_id (text), doc_name, category of every record that names a document; repeated rows count once.

    A table without a category, or a record without one, gives null.
    """
    out = None
    for name, df, key in tables:
        category = F.col("category") if "category" in df.columns else F.lit(None)
        part = df.filter(F.col("doc_name").isNotNull()).select(
            F.lit(name).alias("src_table"), F.col(key).cast("string").alias("record_id"), "doc_name", category.cast("string").alias("category")
        )
        out = part if out is None else out.unionByName(part)
    # redelivered rows may differ in their category
    return out.groupBy("src_table", "record_id", "doc_name").agg(F.min("category").alias("category"))


def record_counts(tables: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """src_table, doc_name -> number of records that name the document."""
    return named_records(tables).groupBy("src_table", "doc_name").agg(F.count("*").alias("n"))


def split_documents(catalog: DataFrame, tables: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """doc_name, group_name, n_records, split of every document that the catalogue or a record names."""
    counts = record_counts(tables).groupBy("doc_name").agg(F.sum("n").alias("n"))
    named = catalog.select("doc_name", "authors").unionByName(
        counts.select("doc_name", F.lit(None).cast("array<string>").alias("authors"))
    )
    groups = stage(document_groups(named), "groups")
    docs = groups.join(counts, "doc_name", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    docs = stage(docs, "sized")
    sizes = docs.groupBy("group_name").agg(F.sum("n").cast("bigint").alias("n_records"))
    dealt = assign_splits(sizes).select("group_name", "split")
    return docs.join(dealt, "group_name").select("doc_name", "group_name", F.col("n").cast("bigint").alias("n_records"), "split")


#: A document with at least 1/HOT_DOCUMENTS of all records meets them by broadcast, so at most this many do.
HOT_DOCUMENTS = 1000


def split_records(splits: DataFrame, tables: list[tuple[str, DataFrame, str]], catalog: DataFrame | None = None) -> DataFrame:
    """Every record that names a document, with its split: src_table, record_id, doc_name, category, split.

    A missing category is the catalogue's. Records of hot documents (a bounded
    number) are not shuffled by name; all others join on it.
    """
    records = stage(named_records(tables), "named-records")
    docs = splits.select("doc_name", "n_records", "split")
    if catalog is not None:
        known = catalog.filter("doc_name is not null").groupBy("doc_name").agg(F.min("category").alias("__category"))
        docs = docs.join(known, "doc_name", "left")
    else:
        docs = docs.withColumn("__category", F.lit(None).cast("string"))
    docs = stage(docs, "split-documents")
    total = docs.agg(F.sum("n_records")).first()[0] or 0
    hot = F.broadcast(docs.filter(F.col("n_records") * HOT_DOCUMENTS >= total).filter("n_records > 0"))
    cold = docs.filter((F.col("n_records") * HOT_DOCUMENTS < total) | (F.col("n_records") == 0))
    out = records.join(hot, "doc_name").unionByName(records.join(hot, "doc_name", "left_anti").join(cold, "doc_name"))
    return out.select("src_table", "record_id", "doc_name", F.coalesce("category", "__category").alias("category"), "split")


def realised_shares(splits: DataFrame) -> DataFrame:
    w = Window.partitionBy(F.lit(1))
    return (
        splits.groupBy("split")
        .agg(F.sum("n_records").alias("n_records"), F.count("*").alias("n_documents"))
        .withColumn("share", F.round(F.col("n_records") / F.sum("n_records").over(w), 4))
    )

"""Registered queries of the training-text problems, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm import mixing, pairs, quality, splits, tokenizer
from folioframe.plans.staging import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    tables = [table(spark, d, t) for t in ("chat_samples", "bench_annotations", "qa_records")]
    return pairs.broken_pairs(pairs.qa_pairs(*tables), table(spark, d, "common_words"))


def p3_defect_counts(spark: SparkSession, d: str) -> DataFrame:
    return p3_found(spark, d).groupBy("src_table", "defect").agg(F.count("*").alias("n_pairs"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.related_documents(table(spark, d, "doc_catalog"))


def p4_forest(spark: SparkSession, d: str) -> DataFrame:
    return splits.document_forest(table(spark, d, "doc_catalog"))[1]


#: Every table with doc_name, and what tells its records apart.
_RECORD_KEYS = {
    "chat_samples": "sample_id", "bench_annotations": "ann_id", "qa_records": "record_id", "documents": "doc_id",
    "page_images": "image", "tiny_files": "file_id", "doc_catalog": "doc_name",
}


def _record_tables(spark: SparkSession, d: str) -> list[tuple[str, DataFrame, str]]:
    keys = _RECORD_KEYS
    return [(t, table(spark, d, t), k) for t, k in keys.items()]


def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_documents(table(spark, d, "doc_catalog"), _record_tables(spark, d))


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_records(p4_splits(spark, d), _record_tables(spark, d), table(spark, d, "doc_catalog"))


def p4_record_counts(spark: SparkSession, d: str) -> DataFrame:
    """Records with a split per table: none is lost or doubled."""
    return p4_records(spark, d).groupBy("src_table").agg(F.count("split").alias("n_records"))


def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    return splits.realised_shares(p4_splits(spark, d))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode_corpus(table(spark, d, "documents"))


def p6_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    back = tokenizer.encode_corpus(docs).select("doc_id", tokenizer.decode_ids(F.col("ids")).alias("back"))
    return docs.join(back, "doc_id").select(
        "doc_id", (F.coalesce("text", F.lit("")) == F.col("back")).alias("same")
    )


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    mixture, _ = mixing.fair_mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    return mixture.select("doc_id", "source", "copy", "n_tokens")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.reached_shares(*mixing.fair_mixture(table(spark, d, "documents"), table(spark, d, "mix_targets")))


def p7_corpus_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares of a mixture as large as the corpus, in which poor sources stop at their caps."""
    return mixing.reached_shares(*mixing.mixture_of_corpus_size(table(spark, d, "documents"), table(spark, d, "mix_targets")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.not_prose(table(spark, d, "documents"), table(spark, d, "common_words"))


def p8_statistics(spark: SparkSession, d: str) -> DataFrame:
    docs, words = table(spark, d, "documents"), table(spark, d, "common_words")
    common = quality.common_set(words)
    stats = quality.text_statistics(docs, common, quality.trigram_shares(docs))
    return stats.select("doc_id", *[F.round(F.col(c), 6).alias(c) for c in quality.STATS])


def p8_components(spark: SparkSession, d: str) -> DataFrame:
    return quality.mixture_components(table(spark, d, "documents"), table(spark, d, "common_words"))


QUERIES = {
    "p3_found": p3_found,
    "p3_defect_counts": p3_defect_counts,
    "p4_found": p4_found,
    "p4_forest": p4_forest,
    "p4_splits": p4_splits,
    "p4_records": p4_records,
    "p4_record_counts": p4_record_counts,
    "p4_shares": p4_shares,
    "p6_ids": p6_ids,
    "p6_roundtrip": p6_roundtrip,
    "p7_mixture": p7_mixture,
    "p7_shares": p7_shares,
    "p7_corpus_shares": p7_corpus_shares,
    "p8_found": p8_found,
    "p8_statistics": p8_statistics,
    "p8_components": p8_components,
}

_FILLERS = ", ".join("'" + x.replace("'", "''") + "'" for x in splits.FILLER_AUTHORS)
_TAIL_SQL = (
    r"(?:\.(?:" + "|".join(splits.EXTENSIONS) + r")|[\s._-]*\(\d+\)|[\s._-]+(?:" + "|".join(x.replace(" ", r"\ ") for x in splits.STATES)
    + r")(?:[\s._-]*\d+)?|[\s._-]+(?:" + "|".join(splits.LANGUAGES) + r")|[\s._-]+(?:version|ver|rev|revision|r|v)[\s._]*\d+)"
)
#: A fold to the smallest name over all paths: slow beyond the catalogue of a small scale.
_GROUPS_SQL = f"""RECURSIVE names AS (SELECT DISTINCT doc_name doc, trim(lower(doc_name)) low FROM doc_catalog WHERE doc_name IS NOT NULL),
 cut AS (SELECT doc, low, regexp_replace(regexp_replace(regexp_replace(low, '^copy of\\s+|^copy_of_', ''), '(\\d)v\\d+({_TAIL_SQL}*)\\s*$', '\\1\\2'), '{_TAIL_SQL}+\\s*$', '') stem FROM names),
 works AS (SELECT doc, regexp_replace(stem, '[\\s._-]+', '-', 'g') k, low FROM cut),
 edges AS (SELECT DISTINCT doc_name doc, concat('a:', a) hub FROM (SELECT doc_name, trim(lower(unnest(authors))) a FROM doc_catalog WHERE doc_name IS NOT NULL)
   WHERE a IS NOT NULL AND a NOT IN ({_FILLERS})
   UNION SELECT doc, concat('w:', CASE WHEN replace(k, '-', '') <> '' THEN k ELSE low END) FROM works),
 near AS (SELECT DISTINCT x.doc a, y.doc b FROM edges x JOIN edges y USING (hub)),
 reach(a, b) AS (SELECT a, b FROM near UNION SELECT reach.a, near.b FROM reach JOIN near ON reach.b = near.a)"""

ORACLES = {
    "p4_found": f"WITH {_GROUPS_SQL} SELECT a AS doc_name, min(b) AS group_name FROM reach GROUP BY a HAVING count(*) > 1",
    "p4_record_counts": " UNION ALL ".join(
        f"SELECT '{t}' AS src_table, count(*) AS n_records FROM (SELECT DISTINCT {k}, doc_name FROM {t} WHERE doc_name IS NOT NULL)"
        for t, k in _RECORD_KEYS.items()
    ),
    "p6_roundtrip": "SELECT doc_id, true AS same FROM documents",
}

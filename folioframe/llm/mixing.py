"""Mixing sources to target weights by weighted fair queueing.

Every source is a flow with its target share as weight. Its documents line up
in hashed order; a document's virtual finish time is the tokens of its source up
to and including it, divided by the weight. All documents are range-sorted by
finish time and cut where the total budget is used up, so at every moment of
virtual time each source has got its share. A source may go round again, in
another order, up to its cap.

Defined results: null and empty texts and documents of null or untargeted
sources take no part; a target without any text keeps its line in the report
with share 0 and the other weights are scaled up; null or smaller caps than 1
count as 1; ties of the finish time are broken by source, id and copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.functions.prefix import running_total
from folioframe.llm.tokenizer import token_count
from folioframe.plans.staging import spread, stage

#: Stretches of the virtual time line used for the global running total.
STRETCHES = 4096


def sized_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    sized = docs.select("doc_id", "source", "text").filter("source is not null and text is not null and text <> ''")
    return spread(sized).select("doc_id", "source", token_count(F.col("text"), path).alias("n_tokens"))


def flow_weights(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """source, weight (scaled over sources with text), max_repeat, have (tokens): one row per target."""
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("have"), F.count("*").alias("n_docs"))
    flows = targets.filter("source is not null").groupBy("source").agg(
        F.sum("target_share").alias("target_share"), F.greatest(F.max("max_repeat"), F.lit(1)).alias("max_repeat")
    )
    flows = flows.join(have, "source", "left").na.fill({"have": 0, "n_docs": 0})
    flows = flows.withColumn("max_repeat", F.coalesce("max_repeat", F.lit(1)))
    alive = flows.filter("have > 0").agg(F.sum("target_share").alias("alive"))
    return flows.crossJoin(F.broadcast(alive)).select(  # one row
        "source", "target_share", "max_repeat", "have", "n_docs",
        F.when(F.col("have") > 0, F.col("target_share") / F.col("alive")).otherwise(0.0).alias("weight"),
    )


def feasible_budget(flows: DataFrame) -> float:
    """Most tokens of which every source with text can deliver its share within its cap (the scarcest source sets it)."""
    got = flows.filter("weight > 0").agg(F.min(F.col("have") * F.col("max_repeat") / F.col("weight"))).first()[0]
    return float(got or 0)


def corpus_budget(flows: DataFrame) -> int:
    """As many tokens as all documents of the targeted sources have, each counted once."""
    return int(flows.filter("weight > 0").agg(F.sum("have")).first()[0] or 0)


def mixture_of_corpus_size(docs: DataFrame, targets: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A mixture as large as the corpus: sources run dry at their caps and leave their part to the others."""
    sized = stage(sized_documents(docs, path), "sized-documents")
    return mixed(sized, targets, corpus_budget(flow_weights(sized, targets)))


def fair_mixture(docs: DataFrame, targets: DataFrame, budget: float | None = None, path: str | None = None, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """``mixed`` over the counted tokens of whole texts."""
    return mixed(stage(sized_documents(docs, path), "sized-documents"), targets, budget, seed)


def mixed(sized: DataFrame, targets: DataFrame, budget: float | None = None, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(mixture, flows). mixture: doc_id, source, copy, n_tokens, in the order of finish times (finish_time).

    ``budget`` tokens in all; None takes the most with which all shares can be met.
    Beyond that, sources that run dry leave their part to the others.
    """
    flows = stage(flow_weights(sized, targets), "flows")  # as many rows as targets
    # a hair more, so that rounding of shares does not cost the scarcest source its last document
    total = feasible_budget(flows) * (1 + 1e-12) if budget is None else budget
    lines = sized.join(F.broadcast(flows.filter("weight > 0").drop("n_docs")), "source")
    # rounds a source can be needed for: with a given budget a dry source may leave its part to others
    need = F.ceil(F.col("weight") * total / F.col("have")) if budget is None else F.col("max_repeat")
    lines = lines.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.col("max_repeat"), F.greatest(need, F.lit(1))).cast("int"))))
    lines = lines.withColumn("h", F.xxhash64("doc_id", "copy", F.lit(seed)))
    lined = running_total(lines, ["source", "copy"], F.shiftright("h", 54), [F.col("h"), F.col("doc_id")], "n_tokens", "before")
    finish = ((F.col("copy") - 1) * F.col("have") + F.col("before") + F.col("n_tokens")) / F.col("weight")
    timed = lined.withColumn("finish_time", finish).select("doc_id", "source", "copy", "n_tokens", "finish_time")
    if budget is None:
        # beyond the budget's virtual time no document can be kept; ahead of it lies one document per source at most
        timed = timed.filter(F.col("finish_time") <= float(total))
    ranged = stage(timed, "finish-times")
    span = ranged.agg(F.max("finish_time")).first()[0] or 1.0
    stretch = F.floor(F.col("finish_time") / span * STRETCHES)
    order = [F.col("finish_time"), F.col("source"), F.col("doc_id"), F.col("copy")]
    cut = running_total(ranged.withColumn("all", F.lit(0)), ["all"], stretch, order, "n_tokens", "used")
    kept = cut.filter(F.col("used") + F.col("n_tokens") <= total).select("doc_id", "source", "copy", "n_tokens", "finish_time")
    return kept, flows


def reached_shares(mixture: DataFrame, flows: DataFrame) -> DataFrame:
    """Per target source: target and reached share of the tokens, records, most copies of a record."""
    got = mixture.groupBy("source").agg(
        F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_records"), F.max("copy").alias("most_copies")
    )
    both = flows.select("source", "target_share", "max_repeat", F.col("have").alias("source_tokens")).join(got, "source", "left")
    both = both.na.fill({"n_tokens": 0, "n_records": 0, "most_copies": 0})
    all_ = both.agg(F.sum("n_tokens").alias("all_tokens"))
    return both.crossJoin(F.broadcast(all_)).select(  # one row
        "source", "target_share", "max_repeat", "source_tokens", "n_tokens", "n_records", "most_copies",
        F.round(F.when(F.col("all_tokens") > 0, F.col("n_tokens") / F.col("all_tokens")).otherwise(0.0), 6).alias("reached_share"),
    )

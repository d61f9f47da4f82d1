"""Mixing sources to target shares of the total size.

Method: tokens are aggregated per source, repetition rates follow from them, and each document
is emitted floor(rate) times plus one hash-seeded Bernoulli copy with probability equal to the
fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm.tokens import token_counts, unique_documents
from skyledger.session import ensure_checkpoint_dir


def source_name(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")))


def sized_documents(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens), written once to the shared folder: it is read for the rates and for the report."""
    docs = documents.select("doc_id", "text", source_name(F.col("source")).alias("source")).where("source is not null")
    ensure_checkpoint_dir(documents.sparkSession)
    return token_counts(docs, path, ["source"]).checkpoint()


def rates(sized: DataFrame, targets: DataFrame, short: str = "full") -> DataFrame:
    """One row per target source: its documents and tokens, its due share, and how often each document is used.

    A source without tokens can hold nothing: its target share is spread over the others in
    proportion to theirs, which gives the due shares. Sources without a target take no part.
    short="full": the total is the tokens of all target sources; a source that would need more
    than its cap is used max_repeats times and falls short, and the others are not held back by it.
    short="shrink": the total is the largest at which every source with tokens reaches its due share
    within its cap; one scarce source then makes the whole mixture small.
    Null shares and caps count as 0. Repeated target rows count once; of different ones the least counts.
    """
    t = targets.select(source_name(F.col("source")).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"))
    t = t.where("source is not null").groupBy("source").agg(F.min("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    size = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_tokens").alias("n_tokens"))
    x = t.join(size, "source", "left").fillna(0, ["n_documents", "n_tokens"])
    usable = (F.col("n_tokens") > 0) & (F.col("target_share") > 0)
    held = x.agg(F.sum(F.when(usable, F.col("target_share"))).alias("held"), F.coalesce(F.sum(F.when(usable, F.col("n_tokens"))), F.lit(0)).cast("double").alias("available"))  # one row
    x = x.crossJoin(F.broadcast(held)).withColumn("due_share", F.when(usable, F.col("target_share") / F.col("held")).otherwise(0.0))
    x = x.withColumn("limit", F.when(usable, F.col("max_repeats") * F.col("n_tokens") / F.col("due_share")))
    x = x.crossJoin(F.broadcast(x.agg(F.coalesce(F.min("limit"), F.lit(0.0)).alias("feasible"))))  # one row
    want = F.col("feasible") if short == "shrink" else F.col("available")
    rate = F.when(usable, F.least(want * F.col("due_share") / F.col("n_tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return x.select("source", "target_share", "due_share", "max_repeats", "n_documents", "n_tokens", want.alias("total_tokens"), rate.alias("rate"))


def _copies(sized: DataFrame, rate: DataFrame, seed: int) -> DataFrame:
    """Each document with its number of copies. The rates are a row per target source, a fixed table.

    floor(rate) copies and one more with the fraction as probability: a source's size comes out at
    rate x tokens in expectation, with the spread of the sizes of its documents around it.
    """
    u = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double") / float(1 << 53)
    x = sized.join(F.broadcast(rate.select("source", "rate")), "source")
    n = F.floor("rate") + (u < F.col("rate") - F.floor("rate")).cast("int")
    return x.withColumn("copies", n.cast("int"))


def mixture(sized: DataFrame, targets: DataFrame, seed: int = 17, short: str = "full") -> DataFrame:
    """(doc_id, source, copy_no, n_tokens): a row per copy, copies numbered from 1.

    Empty and null texts have size 0 and are emitted like the others of their source. A document
    is used at most ceil(rate) times, never more than the source's max_repeats.
    """
    x = _copies(sized, rates(sized, targets, short), seed).where("copies > 0")
    return x.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"), "n_tokens")


def reached_shares(sized: DataFrame, targets: DataFrame, seed: int = 17, short: str = "full") -> DataFrame:
    """The report per target source: what was asked for, what there is, and what the mixture holds."""
    r = rates(sized, targets, short)
    got = _copies(sized, r, seed).groupBy("source").agg(F.sum("copies").alias("n_emitted"), F.sum(F.col("copies") * F.col("n_tokens")).alias("emitted_tokens"), F.max("copies").alias("most_copies"))
    x = r.join(F.broadcast(got), "source", "left").fillna(0, ["n_emitted", "emitted_tokens", "most_copies"])
    whole = x.agg(F.sum("emitted_tokens").alias("all_tokens"))  # one row
    x = x.crossJoin(F.broadcast(whole))
    share = F.when(F.col("all_tokens") > 0, F.col("emitted_tokens") / F.col("all_tokens")).otherwise(0.0)
    return x.select(
        "source", "target_share", "due_share", share.alias("reached_share"), "max_repeats", "most_copies", "rate", "n_documents", "n_tokens", "n_emitted", "emitted_tokens", (F.col("rate") >= F.col("max_repeats")).alias("at_cap")
    )


def mixed_documents(documents: DataFrame, sized: DataFrame, targets: DataFrame, seed: int = 17, short: str = "full") -> DataFrame:
    """(doc_id, source, copy_no, text): the mixture itself, its texts straight from the scan.

    How often a document is emitted follows from its id and its source's rate, so no text is joined
    or moved. The copies are those of `mixture`.
    """
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), source_name(F.col("source")).alias("source"), F.col("text").cast("string").alias("text")).where("doc_id is not null and source is not null")
    x = _copies(unique_documents(docs), rates(sized, targets, short), seed).where("copies > 0")
    return x.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"), "text")

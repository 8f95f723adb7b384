"""Mix sources to target weights: exact budgets cut from a random order of each source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .shared import in_order, n_words_of, random_key


def source_targets(sources: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """Targets of ``sources`` (source, source_size): every source's share of all sizes by its weight.

    Sources by code point, null last, take the ``weights`` in turn. A target stops at ``most`` times
    its source's size; the excess is shared again by weight until none is above. With sources in the
    order of size over weight, those that stop come first, so one prefix sum finds the common rate.
    Adds weight, target (double).
    """
    ranked = in_order(sources, [F.col("source").isNull(), F.col("source")])
    taken = F.array(*[F.lit(w) for w in weights])
    weighed = ranked.select(
        "source",
        "source_size",
        F.element_at(taken, (F.col("position") % len(weights) + 1).cast("int")).cast("long").alias("weight"),
        (F.lit(most) * F.col("source_size")).alias("limit"),
    )
    by_ratio = in_order(weighed, [F.col("limit") / F.col("weight"), F.col("source").isNull(), F.col("source")], ("limit", "weight"))
    everything = by_ratio.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    rate = (F.lit(everything["size"]) - F.col("before_limit")) / (F.lit(everything["weight"]) - F.col("before_weight"))
    rates = by_ratio.select("position", rate.alias("rate"), "limit", "weight").where("rate * weight <= limit")
    least = rates.agg(F.min_by("rate", "position")).first()[0]
    target = F.least(F.col("limit").cast("double"), F.lit(least).cast("double") * F.col("weight"))
    return by_ratio.select("source", "source_size", "weight", target.alias("target"))


def mix_plan(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, seed: int = 11) -> DataFrame:
    """One row a source: what the mix takes of it, from every document's random key.

    source, source_size, target, epochs (how often all its documents are taken) and cut_key: in one
    more epoch its documents with a smaller random key are taken. The cut is the place in the key
    order nearest to the rest of the target, so a source misses its target by half a document at
    most. Rows of one id and text share a key and are taken together.
    """
    rows = docs.select(
        "source", n_words_of(F.col("text")).alias("size"), random_key(seed, F.col("doc_id"), F.col("text")).alias("key")
    )
    rows = rows.groupBy("source", "key").agg(F.sum("size").alias("size"))
    ordered = in_order(rows, [F.col("source").asc_nulls_first(), F.col("key")], ("size",))
    sources = ordered.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("before_size").alias("source_start"))
    sources = cut_lineage(sources)
    targets = source_targets(sources.select("source", "source_size"), weights, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.select(
        F.col("source").alias("of"),
        "source_size",
        "target",
        whole.cast("long").alias("epochs"),
        (F.col("target") - whole * F.col("source_size")).alias("rest"),
    )
    targets = targets.join(sources.select("source", "source_start"), F.col("of").eqNullSafe(F.col("source"))).drop("source")
    targets = cut_lineage(targets)
    inside = F.col("before_size") - F.col("source_start")
    left = ordered.join(targets, F.col("source").eqNullSafe(F.col("of"))).where(inside + F.col("size") / 2 > F.col("rest"))
    cuts = left.groupBy("of").agg(F.min("key").alias("cut_key"))
    plan = targets.join(cuts.withColumnRenamed("of", "cut_of"), F.col("of").eqNullSafe(F.col("cut_of")), "left")
    return cut_lineage(plan.select(F.col("of").alias("source"), "source_size", "target", "epochs", "cut_key"))


def _copies(key: Column) -> Column:
    # No document left out in the last epoch: all of them are taken.
    again = (F.col("plan.cut_key").isNull() | (key < F.col("plan.cut_key"))).cast("long")
    return F.col("plan.epochs") + again


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, seed: int = 11) -> DataFrame:
    """What the mix takes of every row of ``docs`` (doc_id, text, source).

    Returns doc_id, source, size (words of the text; null has none), source_size, target, copies and
    taken (size times copies). A null source is one source and the last of the order; sources
    without words have target 0 and none of their documents is taken. Documents without words can
    be taken, they cost nothing. An empty table gives no rows.
    """
    plan = mix_plan(docs, weights, most, seed).select(F.struct("*").alias("plan"))
    rows = docs.select(
        "doc_id", "source", n_words_of(F.col("text")).alias("size"), random_key(seed, F.col("doc_id"), F.col("text")).alias("key")
    )
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("plan.source")))
    copies = F.when(F.col("plan.source_size") > 0, _copies(F.col("key"))).otherwise(F.lit(0))
    return joined.select(
        "doc_id", rows["source"], "size", "plan.source_size", "plan.target", copies.alias("copies"), (F.col("size") * copies).alias("taken")
    )


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, seed: int = 11) -> DataFrame:
    """The documents of the mix with all their columns, each as often as the mix takes it.

    Whether a row is taken follows from its key and its source's row in the plan, so texts are not
    shuffled. Columns of any name are kept as they are.
    """
    plan = mix_plan(docs, weights, most, seed).select(F.struct("*").alias("plan"))
    rows = docs.select(
        F.struct("*").alias("row"), F.col("source").alias("of"), random_key(seed, F.col("doc_id"), F.col("text")).alias("key")
    )
    joined = rows.join(plan, F.col("of").eqNullSafe(F.col("plan.source")))
    copies = F.when(F.col("plan.source_size") > 0, _copies(F.col("key"))).otherwise(F.lit(0))
    taken = joined.where(copies > 0).select("row", F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias("epoch"))
    return taken.select("row.*")

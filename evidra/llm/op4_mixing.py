"""Mixing sources to target weights.

Tokens are summed a source, targets follow from the sources' weights, and
each document is taken ``floor(rate)`` times plus once more if a number drawn
from its hashed id lies below the fraction, so reruns agree and no state is
shared between tasks.

Defined cases: a null or empty text has size 0 and is taken zero words of;
null sources form one source, ranked last; rows that repeat a doc_id draw the
same number; an empty table gives an empty result; further columns pass
through ``mix`` and are ignored by ``plan_mix``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.plans.ordering import numbered

from .common import WORD, materialize, pick

SEED = "mix-1"


def sizes(docs: DataFrame) -> DataFrame:
    return pick(docs, "doc_id", "text", "source").select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def ranked(totals: DataFrame) -> DataFrame:
    """The sources with ``rank``, 0, 1, ... by code point, null last."""
    return numbered(totals, F.col("source").asc_nulls_last(), name="rank")


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Each source's total and target; rows are sources, not documents.

    Targets are weight shares of the whole; one that is above ``most`` times
    its source stops there and the excess is shared by weight among the rest.
    Sources that stop never start again, so the level at which the others
    stand is found by summing until no further source stops, and no task holds
    all sources.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights)).cast("int") + 1).cast("long")
    caps = materialize(ranked(totals).select("source", "source_size", weight.alias("weight"), (most * F.col("source_size")).alias("cap")), "caps")
    whole = caps.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    rest, rest_weight = whole
    while True:
        stops = F.col("cap").cast("double") * F.lit(float(rest_weight)) <= F.col("weight") * F.lit(float(rest))
        cap, gone = caps.where(stops).agg(F.coalesce(F.sum("cap"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if (rest, rest_weight) == (whole[0] - cap, whole[1] - gone):
            break
        rest, rest_weight = whole[0] - cap, whole[1] - gone
    level = F.lit(0.0) if not rest_weight else (F.col("weight") * F.lit(rest)).cast("double") / F.lit(float(rest_weight))
    target = F.when(stops, F.col("cap").cast("double")).otherwise(level)
    # written, so that the planner knows its size and broadcasts it only while it is small
    return materialize(caps.select("source", "source_size", target.alias("target")), "targets")


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken."""
    sized = materialize(sizes(docs), "sizes")
    t = targets(sized, weights, most).withColumnRenamed("source", "__source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
    joined = sized.join(t, sized["source"].eqNullSafe(t["__source"]), "left").drop("__source")
    return (
        joined.withColumn("__rate", rate)
        .withColumn("copies", (F.floor("__rate") + (drawn < F.col("__rate") - F.floor("__rate")).cast("long")).cast("long"))
        .withColumn("taken", F.col("size") * F.col("copies"))
        .drop("__rate")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = SEED) -> DataFrame:
    """The mix itself: each document's row as often as it is taken.

    Rates are the same for all rows of a source, so only the small table of
    sources is joined and texts are not moved but by that join.
    """
    t = targets(materialize(sizes(docs), "sizes"), weights, most).select(F.col("source").alias("__source"), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("__rate"))
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(docs["doc_id"].cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
    joined = docs.join(t, docs["source"].eqNullSafe(t["__source"]), "left")
    copies = (F.floor("__rate") + (drawn < F.col("__rate") - F.floor("__rate")).cast("long")).cast("int")
    return joined.withColumn("__copies", copies).where("__copies > 0").select(*[docs[c] for c in docs.columns], F.explode(F.array_repeat(F.lit(1), F.col("__copies"))).alias("__one")).drop("__one")

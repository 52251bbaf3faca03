"""Screening ledger queries: an append-only log, where the order of appending (``seq``) decides, not the clock."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.plans import ordering

TITLE_ABSTRACT, FULL_TEXT = STAGES = ("TITLE_ABSTRACT", "FULL_TEXT")
INCLUDE, EXCLUDE, MAYBE, NOT_SCREENED = DECISIONS = ("INCLUDE", "EXCLUDE", "MAYBE", "NOT_SCREENED")
# The usual codes for exclusion; a review may hand in its own.
REASONS = ("WRONG_POPULATION", "WRONG_INTERVENTION_EXPOSURE", "WRONG_COMPARATOR", "WRONG_OUTCOME", "WRONG_STUDY_DESIGN", "NOT_PRIMARY_RESEARCH", "NOT_RETRIEVABLE", "OTHER")


def problems(events: DataFrame, reasons: tuple[str, ...] = REASONS, full_text_needs_reason: bool = True) -> DataFrame:
    """The events with ``problems``: why each may not be appended; empty for valid ones."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    reasoned = ~blank("reason_code") | ~blank("reason_text")
    found = [
        F.when(~F.coalesce(F.col("decision").isin(*DECISIONS), F.lit(False)), "unknown decision"),
        F.when(~F.coalesce(F.col("stage").isin(*STAGES), F.lit(False)), "unknown stage"),
        F.when(blank("reviewer"), "no reviewer"),
        F.when(~blank("reason_code") & ~F.upper("reason_code").isin(*reasons), "unknown reason"),
        F.when((F.col("decision") != EXCLUDE) & reasoned, "a reason without exclusion"),
    ]
    if full_text_needs_reason:
        found.append(F.when((F.col("stage") == FULL_TEXT) & (F.col("decision") == EXCLUDE) & ~reasoned, "full-text exclusion without a reason"))
    return events.withColumn("problems", F.filter(F.array(*found), lambda p: p.isNotNull()))


def accepted(events: DataFrame, **rules) -> DataFrame:
    return problems(events, **rules).where(F.size("problems") == 0).drop("problems").withColumn("reason_code", F.upper("reason_code"))


def rejected(events: DataFrame, **rules) -> DataFrame:
    return problems(events, **rules).where(F.size("problems") > 0)


def latest(events: DataFrame) -> DataFrame:
    """The current decision of each reviewer: record_id, stage, reviewer, decision, seq, reason."""
    own = events.where("NOT adjudication").groupBy("record_id", "stage", "reviewer")
    reason = F.coalesce(F.col("reason_code"), F.nullif(F.trim("reason_text"), F.lit("")))
    return own.agg(F.max_by(F.struct("decision", reason.alias("reason"), "reason_code"), "seq").alias("e"), F.max("seq").alias("seq")).select("record_id", "stage", "reviewer", "e.decision", "seq", "e.reason", "e.reason_code")


def state(events: DataFrame) -> DataFrame:
    """A row for each record and stage: the final decision, or NOT_SCREENED and whether reviewers differ.

    An adjudication holds until a reviewer decides again; without one, the
    reviewers' current decisions must agree.
    """
    now = latest(events).groupBy("record_id", "stage").agg(
        F.max("seq").alias("reviewed"), F.count_distinct("decision").alias("views"), F.max_by(F.struct("decision", "reason", "reason_code"), "seq").alias("r"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("reviewer", "decision")))).alias("reviewer_decisions")
    )
    reason = F.coalesce(F.col("reason_code"), F.nullif(F.trim("reason_text"), F.lit("")))
    settled = events.where("adjudication").groupBy("record_id", "stage").agg(F.max("seq").alias("adjudicated"), F.max_by(F.struct("decision", reason.alias("reason"), "reason_code"), "seq").alias("a"))
    both = now.join(settled, ["record_id", "stage"], "full_outer")
    ruled = F.coalesce(F.col("adjudicated") > F.coalesce("reviewed", F.lit(-1)), F.lit(False))
    final = F.when(ruled, F.col("a")).when(F.col("views") == 1, F.col("r"))
    return both.select(
        "record_id", "stage", F.coalesce(final["decision"], F.lit(NOT_SCREENED)).alias("decision"), final["reason"].alias("reason"), final["reason_code"].alias("reason_code"),
        F.coalesce(~ruled & (F.col("views") > 1), F.lit(False)).alias("conflict"), "reviewer_decisions",
    )


def conflicts(events: DataFrame) -> DataFrame:
    return state(events).where("conflict").select("record_id", "stage", "reviewer_decisions")


def counts(events: DataFrame) -> DataFrame:
    """stage, decision, records, with rows for decisions that nobody took."""
    grid = events.sparkSession.createDataFrame([(s, d) for s in STAGES for d in DECISIONS], "stage string, decision string")
    seen = state(events).groupBy("stage", "decision").agg(F.count(F.lit(1)).alias("records"))
    return grid.join(seen, ["stage", "decision"], "left").select("stage", "decision", F.coalesce("records", F.lit(0)).alias("records"))


def agreement(events: DataFrame) -> DataFrame:
    """Observed agreement and unweighted kappa of every two reviewers a stage; adjudications play no part."""
    now = latest(events).select("record_id", "stage", "reviewer", "decision")
    other = now.select("record_id", "stage", F.col("reviewer").alias("reviewer_b"), F.col("decision").alias("b"))
    pairs = now.withColumnRenamed("reviewer", "reviewer_a").withColumnRenamed("decision", "a").join(other, ["record_id", "stage"]).where("reviewer_a < reviewer_b")
    both = [F.count_if(F.col("a") == d).alias(f"a_{d}") for d in DECISIONS] + [F.count_if(F.col("b") == d).alias(f"b_{d}") for d in DECISIONS]
    sums = pairs.groupBy("stage", "reviewer_a", "reviewer_b").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") == F.col("b")).alias("agreements"), *both)
    expected = sum(((F.col(f"a_{d}") / F.col("n")) * (F.col(f"b_{d}") / F.col("n")) for d in DECISIONS), F.lit(0.0))
    observed = F.col("agreements") / F.col("n")
    rated = sums.withColumn("observed", observed).withColumn("expected", expected)
    close = lambda c: F.abs(F.col(c) - 1) <= 1e-9
    kappa = F.when(close("expected"), F.when(close("observed"), 1.0)).otherwise((F.col("observed") - F.col("expected")) / (1 - F.col("expected")))
    return rated.select("stage", "reviewer_a", "reviewer_b", F.col("n").alias("n_double_screened"), "agreements", F.col("observed").alias("percent_agreement"), kappa.alias("cohens_kappa"))


def asreview_labels(events: DataFrame) -> DataFrame:
    """record_id, label: 1 or 0 from the full-text decision if there is one, else from title and abstract; else null."""
    by = state(events).groupBy("record_id").agg(*[F.max(F.when((F.col("stage") == s) & (F.col("decision") != NOT_SCREENED), F.col("decision"))).alias(s) for s in STAGES])
    decision = F.coalesce(FULL_TEXT, TITLE_ABSTRACT)
    return by.select("record_id", F.when(decision == INCLUDE, 1).when(decision == EXCLUDE, 0).alias("label"))


def numbered(events: DataFrame, *order: str) -> DataFrame:
    """``seq`` for logs that have none, by columns that give their order."""
    return ordering.numbered(events, *order, name="seq")


EVENTS = "seq long, event_id string, record_id string, stage string, decision string, reviewer string, timestamp string, reason_code string, reason_text string, note string, adjudication boolean, metadata map<string,string>"


def event(record_id: str, decision: str, stage: str = TITLE_ABSTRACT, reviewer: str = "reviewer-1", **more) -> dict:
    """One event to append; ``more`` may name any other column of the ledger."""
    fresh = {"event_id": str(uuid.uuid4()), "timestamp": datetime.now(UTC).isoformat(), "adjudication": False, "metadata": {}}
    return fresh | {"record_id": record_id, "stage": stage, "decision": decision, "reviewer": reviewer.strip()} | more


def adjudication(record_id: str, decision: str, stage: str, reviewer: str = "adjudicator", **more) -> dict:
    return event(record_id, decision, stage, reviewer, adjudication=True, **more)


def ledger(spark: SparkSession) -> DataFrame:
    """A ledger without events."""
    return spark.createDataFrame([], EVENTS)


def append(events: DataFrame, fresh: list[dict], **rules) -> DataFrame:
    """The ledger with a few events more, numbered after those it has; raises if one of them breaks a rule."""
    last = events.agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]
    names = [c.split()[0] for c in EVENTS.split(", ")]
    rows = [tuple((e | {"seq": last + 1 + i}).get(n) for n in names) for i, e in enumerate(fresh)]
    new = events.sparkSession.createDataFrame(rows, EVENTS)
    if bad := rejected(new, **rules).select("record_id", "problems").collect():
        raise ValueError(f"events break the rules: {[(r['record_id'], r['problems']) for r in bad]}")
    return events.unionByName(accepted(new, **rules), allowMissingColumns=True)


def events_for(events: DataFrame, record_id: str, stage: str | None = None) -> DataFrame:
    found = events.where(F.col("record_id") == record_id)
    return found if stage is None else found.where(F.col("stage") == stage)


def final_decision(events: DataFrame, record_id: str, stage: str) -> str | None:
    """The decision that holds for one record, NOT_SCREENED while reviewers differ, null without events."""
    row = state(events_for(events, record_id, stage)).first()
    return row["decision"] if row else None

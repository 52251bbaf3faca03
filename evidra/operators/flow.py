"""Study-flow accounting: identified, screened, sought, assessed, included; its checks; the search-reporting matrix."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import screening as S

PLATFORMS = {"pubmed": "PubMed", "openalex": "OpenAlex", "crossref": "Crossref", "europe_pmc": "Europe PMC", "europepmc": "Europe PMC", "scopus": "Scopus", "web_of_science": "Web of Science"}
STAGE_COUNTS = ("records_screened", "records_excluded", "reports_sought_for_retrieval", "reports_not_retrieved", "reports_assessed_for_eligibility", "reports_included")


def database_name(source):
    return reduce(lambda out, kv: out.when(source == kv[0], kv[1]), PLATFORMS.items(), F.when(F.lit(False), "")).otherwise(F.initcap(F.replace(source, F.lit("_"), F.lit(" "))))


def fates(events: DataFrame, not_retrieved: DataFrame | None = None) -> DataFrame:
    """record_id, screened, excluded, sought, missing, assessed, included, reason: one row a record."""
    now = S.state(events)
    of = lambda stage, what: F.max(F.when(F.col("stage") == stage, what))
    rows = now.groupBy("record_id").agg(
        F.coalesce(of(S.TITLE_ABSTRACT, F.lit(True)), F.lit(False)).alias("screened"), of(S.TITLE_ABSTRACT, F.col("decision")).alias("first"),
        F.coalesce(of(S.FULL_TEXT, F.lit(True)), F.lit(False)).alias("full"), of(S.FULL_TEXT, F.col("decision")).alias("last"), of(S.FULL_TEXT, F.col("reason_code")).alias("code"), of(S.FULL_TEXT, F.col("reason")).alias("why"),
    )
    given = not_retrieved.select("record_id").distinct().withColumn("lost", F.lit(True)) if not_retrieved is not None else None
    rows = rows.join(given, "record_id", "full_outer") if given is not None else rows.withColumn("lost", F.lit(False))
    yes = lambda c: F.coalesce(c, F.lit(False))
    missing = yes(F.col("lost")) | yes((F.col("last") == S.EXCLUDE) & (F.col("code") == "NOT_RETRIEVABLE"))
    assessed = yes(F.col("full")) & ~missing
    return rows.select(
        "record_id", yes(F.col("screened")).alias("screened"), yes(F.col("first") == S.EXCLUDE).alias("excluded"), (yes(F.col("full")) | missing).alias("sought"), missing.alias("missing"), assessed.alias("assessed"),
        (assessed & yes(F.col("last") == S.INCLUDE)).alias("included"), F.when(assessed & (F.col("last") == S.EXCLUDE), F.coalesce("why", F.lit("OTHER"))).alias("reason"),
    )


def stage_counts(events: DataFrame, not_retrieved: DataFrame | None = None) -> DataFrame:
    names = ("screened", "excluded", "sought", "missing", "assessed", "included")
    return fates(events, not_retrieved).agg(*[F.count_if(F.col(c)).alias(n) for c, n in zip(names, STAGE_COUNTS, strict=True)])


def exclusion_reasons(events: DataFrame, not_retrieved: DataFrame | None = None) -> DataFrame:
    return fates(events, not_retrieved).where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("reports"))


def studies_included(events: DataFrame, families: DataFrame, ids: DataFrame) -> DataFrame:
    """How many studies the included reports belong to; null if there are none.  ids: record_id, idx; of repeated ids the last counts."""
    found = fates(events).where("included").select("record_id")
    at = ids.groupBy("record_id").agg(F.max("idx").alias("idx"))
    member = families.select("study_id", F.explode("member_indices").alias("idx"))
    n = found.join(at, "record_id").join(member, "idx").agg(F.count_distinct("study_id").alias("n"))
    return n.join(found.agg(F.count(F.lit(1)).alias("reports"))).select(F.when(F.col("reports") > 0, F.col("n")).alias("studies_included"))


REMOVALS = ("duplicates_removed", "automation_removed_before_screening", "other_removed_before_screening")


def flow(
    identified: DataFrame, duplicates_removed: DataFrame, events: DataFrame, registers: dict[str, int] | None = None, other_sources: dict[str, int] | None = None, automation_removed: int = 0, other_removed: int = 0,
    studies: DataFrame | None = None, not_retrieved: DataFrame | None = None,
) -> DataFrame:
    """Long form (category, label, count): identified a database, removed, stages, reasons.

    identified: source, records; duplicates_removed: one row with that column;
    studies: one row with ``studies_included``, as that function gives it, and
    no row here if it is null; not_retrieved: record_ids that could not be had.
    """
    spark = events.sparkSession
    counts = stage_counts(events, not_retrieved)
    stages = counts.select(F.explode(F.array(*[F.struct(F.lit("stage").alias("category"), F.lit(c).alias("label"), F.col(c).alias("count")) for c in STAGE_COUNTS])).alias("s")).select("s.*")
    databases = identified.groupBy(database_name(F.col("source")).alias("label")).agg(F.sum("records").alias("count")).select(F.lit("database").alias("category"), "label", "count")
    removed = duplicates_removed.select(F.lit("removed").alias("category"), F.lit("duplicates_removed").alias("label"), F.col("duplicates_removed").cast("long").alias("count"))
    reasons = exclusion_reasons(events, not_retrieved).select(F.lit("reason").alias("category"), F.col("reason").alias("label"), F.col("reports").alias("count"))
    said = [("register", k, n) for k, n in (registers or {}).items()] + [("other_source", k, n) for k, n in (other_sources or {}).items()] + [("removed", k, n) for k, n in zip(REMOVALS[1:], (automation_removed, other_removed), strict=True) if n]
    out = databases.union(removed).union(stages).union(reasons)
    if said:
        out = out.union(spark.createDataFrame(said, "category string, label string, count long"))
    if studies is not None:
        out = out.union(studies.where("studies_included IS NOT NULL").select(F.lit("included"), F.lit("studies_included"), F.col("studies_included").cast("long")))
    return out


IDENTIFIED = ("database", "register", "other_source")


def derived(flows: DataFrame) -> DataFrame:
    """One row: the sums that follow from a flow, and its counts as columns; studies_included is null if it is not known."""
    some = lambda label: F.max(F.when(F.col("label") == label, F.col("count")))
    of = lambda label: F.coalesce(some(label), F.lit(0))
    total = lambda *categories: F.coalesce(F.sum(F.when(F.col("category").isin(*categories), F.col("count"))), F.lit(0))
    sums = flows.agg(
        total(*IDENTIFIED).alias("total_identified"), *[total(c).alias(f"identified_{c}") for c in IDENTIFIED], *[of(c).alias(c) for c in (*REMOVALS, *STAGE_COUNTS)], total("reason").alias("reports_excluded_total"), some("studies_included").alias("studies_included"),
    )
    return sums.withColumn("records_after_removals", F.greatest(F.lit(0), F.col("total_identified") - sum((F.col(c) for c in REMOVALS), F.lit(0))))


def checks(flows: DataFrame) -> DataFrame:
    """check, failed: the relations that a finished flow keeps."""
    x = {c: F.col(c) for c in ("total_identified", "records_after_removals", "reports_excluded_total", "studies_included", *REMOVALS, *STAGE_COUNTS)}
    resolved = x["reports_excluded_total"] + x["reports_included"]
    rules = {
        **{f"{c} is negative": x[c] < 0 for c in (*REMOVALS, *STAGE_COUNTS)},
        "more duplicates than records": x["duplicates_removed"] > x["total_identified"],
        "more screened than left after removals": x["records_screened"] > x["records_after_removals"],
        "more excluded than screened": x["records_excluded"] > x["records_screened"],
        "sought is not screened less excluded": (x["records_screened"] != 0) & (x["reports_sought_for_retrieval"] != x["records_screened"] - x["records_excluded"]),
        "more not retrieved than sought": x["reports_not_retrieved"] > x["reports_sought_for_retrieval"],
        "assessed is not sought less not retrieved": x["reports_assessed_for_eligibility"] != x["reports_sought_for_retrieval"] - x["reports_not_retrieved"],
        "more outcomes than assessed": resolved > x["reports_assessed_for_eligibility"],
        "assessed without outcome": (x["reports_assessed_for_eligibility"] != 0) & (resolved < x["reports_assessed_for_eligibility"]),
        "more studies than reports": F.coalesce(x["studies_included"] > x["reports_included"], F.lit(False)),
    }
    return derived(flows).select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), v.alias("failed")) for k, v in rules.items()])).alias("c")).select("c.*")

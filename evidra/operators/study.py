"""Study linkage: reports of one study, gated by registrations, with double-counting warnings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.functions import numbers as N
from evidra.functions import text as T
from evidra.plans.components import FEW, connected_components
from evidra.plans.scratch import materialize

from . import blocking, publication

SAME, IN_REVIEW, DIFFERENT, DUPLICATE = "SAME_STUDY", "REVIEW", "DIFFERENT_STUDY", "DUPLICATE_PUBLICATION"
# The features in the order in which they are added, and their weights.
WEIGHTS = {
    "registry_exact": 10.0,
    "registry_conflict": -6.0,
    "multi_registry_ambiguous": -2.5,
    "acronym_exact": 3.0,
    "title_similarity": 1.4,
    "author_similarity": 2.0,
    "year_compatibility": 0.7,
    "sample_size_similarity": 0.9,
    "country_similarity": 0.7,
    "intervention_similarity": 1.1,
    "population_similarity": 0.9,
    "recruitment_similarity": 1.4,
    "role_complementarity": 0.5,
    "review_record": -7.0,
}
FEATURES = tuple(WEIGHTS)
OUTCOME_ROLES = (T.PRIMARY, T.SECONDARY, T.SUBGROUP, T.FOLLOW_UP, T.CONFERENCE, T.PREPRINT)
GATE = "Families with disjoint registrations would be joined"


@dataclass(frozen=True)
class Config:
    same_study: float = 0.95
    review: float = 0.65
    exhaustive_limit: int = 1500
    #: members above which a block makes no pairs; None lifts it
    block_cap: int | None = blocking.CAP
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    intercept: float = -5.8
    calibrator: Callable[[Column], Column] | None = None
    publications: publication.Config = field(default_factory=publication.Config)

    def __post_init__(self) -> None:
        if not 0 < self.review < self.same_study <= 1:
            raise ValueError("need 0 < review < same_study <= 1")
        if self.exhaustive_limit < 2:
            raise ValueError("exhaustive_limit must be 2 at least")


def _meta(*keys: str) -> list[Column]:
    return [F.nullif(F.col("metadata")[k], F.lit("")) for k in keys]


def sample_size() -> Column:
    return F.coalesce(*[N.first_number(c) for c in _meta(*"sample_size enrollment enrolment enrollment_count n_participants participants".split())])


def recruitment() -> Column:
    start = F.coalesce(*[N.year_in(c) for c in _meta(*"recruitment_start start_date study_start enrollment_start".split())])
    end = F.coalesce(*[N.year_in(c) for c in _meta(*"recruitment_end completion_date study_end enrollment_end".split())])
    return T.let(F.struct(start.alias("s"), end.alias("e")), lambda x: N.interval(x["s"], x["e"]))


def described(records: DataFrame) -> DataFrame:
    """The records with registrations, acronyms and role."""
    kinds = F.concat_ws(" ", *_meta("type", "publication_type", "source_record_type", "publication_types"))
    return records.select(
        "*",
        T.registry_ids(T.registry_text(F.col("title"), F.col("abstract"), F.col("metadata"))).alias("registry_ids"),
        T.study_acronyms(F.col("title"), *_meta("study_acronym", "trial_acronym", "acronym")).alias("acronyms"),
        T.publication_role(F.col("title"), kinds, F.col("metadata")["report_role"]).alias("role"),
    )


def prepared(known: DataFrame) -> DataFrame:
    words = lambda keys: T.study_tokens(F.concat_ws(" ", *_meta(*keys.split())))
    return known.select(
        "idx", "registry_ids", "acronyms", "role", "year", T.study_tokens("title").alias("words"), T.study_author_keys("authors").alias("authors"), sample_size().alias("size"), recruitment().alias("recruited"),
        words("country countries study_country sites").alias("country"), words("intervention interventions treatment exposure").alias("intervention"),
        words("population condition conditions disease participants_description").alias("population"),
    )


def features(both: DataFrame) -> DataFrame:
    a, b = F.col("left"), F.col("right")
    common = F.arrays_overlap(a["registry_ids"], b["registry_ids"])
    differ = ~F.array_sort(a["registry_ids"]).eqNullSafe(F.array_sort(b["registry_ids"]))
    review = (a["role"] == T.REVIEW) | (b["role"] == T.REVIEW)
    made = {
        "registry_exact": common,
        "registry_conflict": (F.size(a["registry_ids"]) > 0) & (F.size(b["registry_ids"]) > 0) & ~common,
        "multi_registry_ambiguous": common & ((F.size(a["registry_ids"]) > 1) | (F.size(b["registry_ids"]) > 1)) & differ,
        "acronym_exact": F.arrays_overlap(a["acronyms"], b["acronyms"]),
        "title_similarity": T.jaccard(a["words"], b["words"]),
        "author_similarity": T.jaccard(a["authors"], b["authors"]),
        "year_compatibility": N.year_compatibility(a["year"], b["year"]),
        "sample_size_similarity": N.sample_size_similarity(a["size"], b["size"]),
        **{f"{c}_similarity": T.jaccard(a[c], b[c]) for c in ("country", "intervention", "population")},
        "recruitment_similarity": N.interval_similarity(a["recruited"], b["recruited"]),
        "role_complementarity": N.role_complementarity(a["role"], b["role"]),
        "review_record": review,
    }
    return materialize(both.select("left_index", "right_index", F.struct(*[made[f].cast("double").alias(f) for f in FEATURES]).alias("features")), "study-features")


def assess(made: DataFrame, config: Config = Config()) -> DataFrame:
    """Adds study_probability, decision and rules; needs publication_probability and publication_decision."""
    x = F.col("features")
    is_ = lambda name: x[name] == 1.0
    shared, clash, vague, review = is_("registry_exact"), is_("registry_conflict"), is_("multi_registry_ambiguous"), is_("review_record")
    raw = made.withColumn("__p", publication.weighted(x, config.weights, config.intercept, FEATURES))
    # written so that each step names the probability once: plans stay small
    floor = lambda q, when, value: F.greatest(q, F.when(when, value).otherwise(0.0))
    cap = lambda q, when, value: F.least(q, F.when(when, value).otherwise(1.0))
    p = cap(cap(floor(F.col("__p"), shared, 0.998), vague, 0.90), review, 0.60)
    if config.review > 0.74:  # a clash is capped, but what deserved review stays in review
        raw = raw.withColumn("__p", p)
        p = F.greatest(cap(F.col("__p"), clash, 0.74), F.when(clash & (F.col("__p") >= config.review), config.review).otherwise(0.0))
    else:
        p = cap(p, clash, 0.74)
    if config.calibrator is not None:
        raw = raw.withColumn("__p", p)
        p = F.when(shared, F.col("__p")).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), config.calibrator(F.col("__p")))))
    p = floor(cap(cap(cap(p, review, 0.60), clash, 0.74), vague, 0.90), shared & ~vague & ~review, 0.998)
    duplicate = F.col("publication_decision") == publication.AUTO_MERGE
    out = raw.withColumn("study_probability", F.when(duplicate, 1.0).otherwise(p))
    decision = F.when(duplicate, DUPLICATE).when((F.col("study_probability") >= config.same_study) & ~clash & ~vague, SAME).when(F.col("study_probability") >= config.review, IN_REVIEW).otherwise(DIFFERENT)
    named = [
        (duplicate, "Same publication: deduplicate before linking studies"), (~duplicate & shared, "Shared trial registration"), (~duplicate & vague, "Several registrations that differ: needs review"),
        (~duplicate & review, "A review may only mention a registration"), (~duplicate & clash, "Disjoint registrations: no automatic link"), (~duplicate & is_("acronym_exact"), "Shared study acronym"),
    ]
    return out.withColumn("decision", decision).withColumn("rules", F.filter(F.array(*[F.when(w, r) for w, r in named]), lambda r: r.isNotNull())).withColumn("contributions", publication.contributions(x, config.weights, FEATURES)).drop("__p")


def _gate(rows: pd.DataFrame) -> pd.DataFrame:
    """Unions in the order of (left, right) inside one component; those that would join disjoint registrations are refused."""
    parent: dict[int, int] = {}
    ids: dict[int, set[str]] = {}

    def root(i: int) -> int:
        while parent.setdefault(i, i) != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, r in zip(rows.left_index, rows.left_ids, strict=True):
        ids.setdefault(i, set(r))
    for i, r in zip(rows.right_index, rows.right_ids, strict=True):
        ids.setdefault(i, set(r))
    rows = rows.sort_values(["left_index", "right_index"])
    refused = []
    for i, j, decision in zip(rows.left_index, rows.right_index, rows.decision, strict=True):
        a, b = root(i), root(j)
        no = decision == SAME and a != b and bool(ids[a]) and bool(ids[b]) and not ids[a] & ids[b]
        refused.append(no)
        if not no and a != b:
            lo, hi = min(a, b), max(a, b)
            parent[hi] = lo
            ids[lo] = ids[a] | ids[b]
    return pd.DataFrame({"left_index": rows.left_index, "right_index": rows.right_index, "refused": refused, "family": [root(i) for i in rows.left_index], "other": [root(j) for j in rows.right_index]})


def gated(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Accepting edges with refused, and the families of both ends.

    The gate refuses unions only inside a component of all accepting edges, so
    components are settled each by itself, in parallel.  Where all registered
    members of a component share a registration no union can be refused: such
    a component, however large, is one family and is not gathered anywhere.
    """
    accepting = edges.where(F.col("decision").isin(SAME, DUPLICATE)).select("left_index", "right_index", "decision", "study_probability")
    component = materialize(connected_components(accepting, "left_index", "right_index", FEW), "components")
    ids = known.select("idx", "registry_ids")
    registered = component.join(ids.toDF("node", "ids"), "node").where(F.size("ids") > 0)
    members = registered.groupBy("component").agg(F.count(F.lit(1)).alias("registered"))
    shared = registered.select("component", "node", F.explode(F.array_distinct("ids")).alias("id")).groupBy("component", "id").agg(F.count(F.lit(1)).alias("n")).groupBy("component").agg(F.max("n").alias("n"))
    mixed = members.join(shared, "component").where("n < registered").select("component", F.lit(True).alias("mixed"))
    placed = materialize(accepting.join(component.withColumnRenamed("node", "left_index"), "left_index").join(mixed, "component", "left"), "placed")
    plain = placed.where("mixed IS NULL").select("left_index", "right_index", F.lit(False).alias("refused"), F.col("component").alias("family"), F.col("component").alias("other"))
    rows = placed.where("mixed").join(ids.toDF("left_index", "left_ids"), "left_index").join(ids.toDF("right_index", "right_ids"), "right_index")
    settled = rows.groupBy("component").applyInPandas(lambda pdf: _gate(pdf), "left_index long, right_index long, refused boolean, family long, other long")
    return accepting.join(plain.unionByName(settled), ["left_index", "right_index"])


def families(known: DataFrame, settled: DataFrame) -> DataFrame:
    """study_id, member_indices, registry_ids, publication_roles, sources, confidence."""
    ends = settled.select(F.explode(F.array(F.struct(F.col("left_index").alias("idx"), "family"), F.struct(F.col("right_index").alias("idx"), F.col("other").alias("family")))).alias("e")).select("e.*").distinct()
    sure = settled.where("NOT refused").groupBy("family").agg(F.min("study_probability").alias("confidence"))
    print_of = F.concat_ws("|", F.coalesce(F.nullif("doi", F.lit("")), F.lit("")), T.norm_plain("title"), F.coalesce(F.col("year").cast("string"), F.lit("")), F.array_join(F.array_sort(T.study_author_keys("authors")), ","))
    member = known.join(ends, "idx", "left").withColumn("family", F.coalesce("family", "idx")).withColumn("print", print_of)
    grouped = member.groupBy("family").agg(
        F.array_sort(F.collect_list("idx")).alias("member_indices"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("registry_ids")))).alias("registry_ids"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("idx", "role")))).alias("publication_roles"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform("source_hits", lambda h: h["source"]))))).alias("sources"),
        F.array_join(F.array_sort(F.collect_list("print")), "||").alias("prints"),
    )
    seed = F.when(F.size("registry_ids") > 0, F.concat(F.lit("registry|"), F.array_join("registry_ids", "|"))).otherwise(F.concat(F.lit("reports|"), F.col("prints")))
    return grouped.join(sure, "family", "left").select(family_id(seed).alias("study_id"), "member_indices", "registry_ids", "publication_roles", "sources", F.coalesce("confidence", F.lit(1.0)).alias("confidence"))


def family_id(seed: Column) -> Column:
    return F.concat(F.lit("STUDY-"), F.upper(F.substring(F.sha1(seed.cast("binary")), 1, 12)))


def double_counting(found: DataFrame) -> DataFrame:
    """Families of which several reports may enter an analysis as if they were studies of their own."""
    bearing = F.array_sort(F.transform(F.filter(F.map_entries("publication_roles"), lambda e: e["value"].isin(*OUTCOME_ROLES)), lambda e: e["key"]))
    high = F.size(bearing) >= 2
    return found.where(high | (F.size("member_indices") >= 2)).select(
        "study_id", F.when(high, bearing).otherwise(F.col("member_indices")).alias("member_indices"), F.when(high, "HIGH").otherwise("REVIEW").alias("severity"),
        F.when(high, "Several reports with outcomes belong to one study: do not count them as independent").otherwise("Several reports belong to one study: settle which supplies each datum").alias("reason"),
    )


@dataclass
class Result:
    families: DataFrame
    assessments: DataFrame
    review_queue: DataFrame
    duplicates: DataFrame
    risks: DataFrame
    stats: DataFrame
    #: blocks that made no pairs because of their size: block_key, members
    dropped_blocks: DataFrame

    def family_for_record(self, idx: int) -> DataFrame:
        return self.families.where(F.array_contains("member_indices", F.lit(idx)))


def link(records: DataFrame, config: Config = Config()) -> Result:
    known = materialize(described(records), "known")
    keys = blocking.study_keys(known)
    pairs, exhaustive = blocking.candidate_pairs(known, keys, config.exhaustive_limit, config.block_cap)
    pairs = materialize(pairs, "pairs")
    same = publication.assess(publication.features(publication.paired(pairs, publication.prepared(records)), config.publications), config.publications)
    both = features(publication.paired(pairs, prepared(known))).join(same.select("left_index", "right_index", F.col("probability").alias("publication_probability"), F.col("decision").alias("publication_decision")), ["left_index", "right_index"])
    edges = materialize(assess(both, config), "study-edges")
    settled = materialize(gated(edges, known), "settled")
    off = settled.where("refused").select("left_index", "right_index", F.lit(True).alias("off"))
    final = edges.join(off, ["left_index", "right_index"], "left").withColumn("off", F.coalesce("off", F.lit(False)))
    final = final.withColumn("decision", F.when(F.col("off"), IN_REVIEW).otherwise(F.col("decision"))).withColumn("study_probability", F.when(F.col("off"), F.least("study_probability", F.lit(0.90))).otherwise(F.col("study_probability")))
    final = materialize(final.withColumn("rules", F.when(F.col("off"), F.array_append("rules", F.lit(GATE))).otherwise(F.col("rules"))).drop("off"), "final-edges")
    found = materialize(families(known, settled), "families")
    of = lambda d: F.count_if(F.col("decision") == d)
    counts = final.agg(F.count(F.lit(1)).alias("assessed_pairs"), of(SAME).alias("same_study_pairs"), of(DUPLICATE).alias("duplicate_publication_pairs"), of(IN_REVIEW).alias("review_pairs"))
    sizes = found.agg(F.sum(F.size("member_indices")).alias("input_records"), F.count(F.lit(1)).alias("families"), F.count_if(F.size("member_indices") == 1).alias("singleton_families"))
    stats = sizes.join(counts).withColumn("candidate_pairs", F.col("assessed_pairs")).withColumn("used_exhaustive_pairing", F.lit(exhaustive))
    return Result(found, final, final.where(F.col("decision") == IN_REVIEW), final.where(F.col("decision") == DUPLICATE), double_counting(found), stats, blocking.dropped_blocks(keys, None if exhaustive else config.block_cap))

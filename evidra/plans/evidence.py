"""One search over several services: responses, records, an account of the run.

The responses are written once; records, counts and the account all read that
table, so a run can be read again later without asking anybody.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidra.operators import publication
from evidra.sources import live, payloads
from evidra.sources import registry as R

from . import dialects, search
from . import language as L
from .scratch import materialize

#: What a reader of the run should know about a service.
WARNINGS = {
    "crossref": "Relevance ranking: Boolean and field semantics are not guaranteed",
    "core": "Year bounds are applied here; totals are those before them",
    "scopus": "Depth of metadata depends on the entitlement and the view",
    "web_of_science": "Basic metadata only; abstracts may be missing",
    "web_of_science_expanded": "Databases, throttling and quotas depend on the entitlement",
}


@dataclass
class Run:
    search: L.Search
    responses: DataFrame
    records: DataFrame
    account: DataFrame
    failures: DataFrame

    def deduplicate(self, config: publication.Config = publication.Config()) -> publication.Result:
        return publication.deduplicate(self.records, config)


def local_bounds(source: str, asked: L.Search) -> bool:
    """Whether a service leaves the year bounds to us."""
    given = [y is not None for y in (asked.year_from, asked.year_to)]
    return any(given) and (source == "core" or source == "web_of_science" and not all(given))


def records_of(responses: DataFrame, asked: L.Search, source: str, limit: int | None = None) -> DataFrame:
    """A service's records, its year bounds kept and no more than ``limit`` in order of rank."""
    bodies = responses.where((F.col("source") == source) & F.col("error").isNull() & (F.col("first_rank") > 0))
    found = payloads.parse(bodies, source)
    if local_bounds(source, asked):
        found = found.where(search.years(F.col("year"), asked.year_from, asked.year_to))
    return found if limit is None else found.orderBy(F.col("source_hits")[0]["rank"]).limit(limit)


def numbered(frames: dict[str, DataFrame]) -> DataFrame:
    """The records of all services with ``idx``: service after service, in order of rank."""
    place = reduce(lambda c, kv: c.when(F.col("__source") == kv[1], kv[0]), enumerate(frames), F.when(F.lit(False), 0))
    every = reduce(DataFrame.unionByName, [d.withColumn("__source", F.lit(s)) for s, d in frames.items()])
    every = materialize(every.withColumn("__place", place), "found")
    sizes = {r["__place"]: r["n"] for r in every.groupBy("__place").agg(F.count(F.lit(1)).alias("n")).collect()}
    base, bases = 0, []
    for i in range(len(frames)):
        bases.append(base)
        base += sizes.get(i, 0)
    within = F.row_number().over(Window.partitionBy("__place").orderBy(F.col("source_hits")[0]["rank"]))
    return every.select((F.array(*[F.lit(b) for b in bases])[F.col("__place")] + within - 1).cast("long").alias("idx"), *payloads.RECORD)


def account(spark: SparkSession, responses: DataFrame, records: DataFrame, asked: L.Search, sources: Iterable[str], limit: int | None) -> DataFrame:
    """One row a service: its query, what was lost in translation, totals, pages, times, warnings, error."""
    by = responses.groupBy("source").agg(
        F.count_if(F.col("error").isNull() & (F.col("first_rank") > 0)).alias("pages"), F.min("retrieved_at").alias("started_at"), F.max("retrieved_at").alias("finished_at"), F.max("error").alias("error"),
        F.min_by("value", "page").alias("__first"), F.sum("attempts").alias("attempts"),
    )
    read = reduce(lambda c, s: c.when(F.col("source") == s, payloads.total(s, F.col("__first"))), sources, F.when(F.lit(False), F.lit(None).cast("long")))
    got = records.groupBy(F.col("source_hits")[0]["source"].alias("source")).agg(F.count(F.lit(1)).alias("retrieved"))
    rows = []
    for s in sources:
        t = dialects.translate(asked, R.DIALECTS.get(s, s))
        notes = [WARNINGS[s]] if s in WARNINGS and (s != "core" or local_bounds(s, asked)) else []
        if local_bounds(s, asked) and s != "core":
            notes.append("A one-sided year bound was applied here")
        if t.requires_review:
            notes.append("Some clauses have no exact form in this service's language")
        rows.append((s, R.NAMES[s], asked.canonical, t.text, t.fidelity_score, t.loss_score, t.requires_review, notes, R.LIMITS.get(s)))
    known = spark.createDataFrame(rows, "source string, database string, canonical string, query string, fidelity double, loss double, requires_review boolean, warnings array<string>, source_limit long")
    both = known.join(by.withColumn("total_available", read).drop("__first"), "source", "left").join(got, "source", "left")
    n = F.coalesce("retrieved", F.lit(0))
    cut = F.lit(False) if limit is None else n >= limit
    beyond = F.coalesce(F.col("total_available") > F.col("source_limit"), F.lit(False))
    return both.withColumn("retrieved", n).withColumn("truncated", F.coalesce(F.col("total_available") > n, F.lit(False)) & (cut | beyond)).drop("source_limit")


def run(
    spark: SparkSession, asked: L.Search, sources: tuple[str, ...] = R.USUAL, limit: int | None = 1000, page_size: int | None = None, options: dict[str, dict] | None = None,
    get: Callable[[live.Request], live.Answer] = live.fetch, retry: live.Retry = live.Retry(), strict: bool = False,
) -> Run:
    """Ask the services; a failing one is left out and named, or raises if ``strict``."""
    names = tuple(dict.fromkeys(R.source_name(s) for s in sources))
    return replay(spark, materialize(live.read_live(spark, asked, names, limit, page_size, options, get, retry), "responses"), asked, names, limit, strict)


def replay(spark: SparkSession, responses: DataFrame, asked: L.Search, sources: tuple[str, ...], limit: int | None = None, strict: bool = False) -> Run:
    """A run from responses that were kept."""
    failures = responses.where("error IS NOT NULL").select("source", "error", "retrieved_at")
    if strict and (first := failures.first()):
        raise live.SourceError(f"{first['source']}: {first['error']}")
    records = materialize(numbered({s: records_of(responses, asked, s, limit) for s in sources}), "records")
    return Run(asked, responses, records, account(spark, responses, records, asked, sources, limit), failures)

"""Validation against published gold files: a plan of data sets, a lock on what is validated, summaries.

A plan names data sets with a role each; held-out ones run only when that is
asked for.  Records are never copied into results, only counts, assignments by
id, and hashes.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions import numbers as N
from evidra.plans.scratch import materialize
from evidra.sources import formats

from . import metrics, publication

DEVELOPMENT, CALIBRATION, HELD_OUT = ROLES = ("development", "calibration", "held_out_test")


@dataclass(frozen=True)
class Dataset:
    """A data set of the plan, with the counts that its file must have."""

    id: str
    role: str
    filename: str = ""
    records: int | None = None
    duplicates_removed: int | None = None
    publications: int | None = None
    columns: tuple[tuple[str, str], ...] = ()


def read_plan(spark: SparkSession, path: str) -> list[Dataset]:
    """The deduplication data sets of a JSON plan that say how many records they hold."""
    payload = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    number = lambda d, k: int(d[k]) if d.get(k) is not None else None
    wanted = [d for d in payload.get("datasets", []) if d.get("task") == "publication_deduplication" and d.get("expected_records") is not None]
    return [
        Dataset(d["id"], d["role"], d.get("filename") or "", number(d, "expected_records"), number(d, "expected_gold_duplicates_removed"), number(d, "expected_gold_publications"), tuple((d.get("columns") or {}).items()))
        for d in wanted
    ]


def allowed(datasets: list[Dataset], roles: tuple[str, ...] = (DEVELOPMENT, CALIBRATION), allow_held_out: bool = False) -> list[Dataset]:
    """Those that may run now; held-out ones need both their role and the switch."""
    if HELD_OUT in roles and not allow_held_out:
        raise PermissionError("held-out data sets need allow_held_out=True")
    return [d for d in datasets if d.role in roles and d.filename]


def checked(gold: DataFrame, spec: Dataset, strict: bool = True) -> DataFrame:
    """Expected against observed counts; raises if ``strict`` and one differs."""
    expected = {k: v for k in ("records", "duplicates_removed", "publications") if (v := getattr(spec, k)) is not None}
    n, removed = F.count(F.lit(1)), F.count_if("gold_removed")
    labelled = F.count("gold_removed") > 0
    groups = F.count_distinct("gold_group")
    observed = gold.agg(n.alias("records"), F.when(labelled, removed).otherwise(n - groups).alias("duplicates_removed"), F.when(labelled, n - removed).otherwise(groups).alias("publications"))
    if not expected:
        return gold.sparkSession.createDataFrame([], "name string, expected long, observed long, ok boolean")
    found = metrics.integrity(observed, expected)
    wrong = [r.asDict() for r in found.where("NOT ok").collect()] if strict else []
    if wrong:
        raise ValueError(f"{spec.id}: counts differ from the plan: {wrong}")
    return found


@dataclass
class Outcome:
    """Results of one data set: counts for each way of choosing whom to retain, the partition's, and the assignment."""

    spec: Dataset
    removals: DataFrame
    partition: DataFrame
    assignment: DataFrame
    labelled: bool


def evaluate(gold: DataFrame, spec: Dataset, config: publication.Config = publication.Config()) -> Outcome:
    """Deduplicate a gold file blind to its labels, then count.

    "blind" retains the best record of a cluster; "gold_preferred" retains one
    that the gold keeps, if there is any: the same clusters, for comparison
    with tools that choose so, and informed by the labels.
    """
    named = [c for c in gold.columns if c not in ("gold_group", "gold_removed", "record_id")]
    records = gold.select(*named)
    for column, kind in (("source_hits", "array<struct<source:string,source_id:string,query:string,retrieved_at:string,rank:int>>"),):
        if column not in records.columns:
            records = records.withColumn(column, F.array().cast(kind))
    found = publication.deduplicate(materialize(records, "gold"), config)
    joined = gold.select("idx", "record_id", "gold_group", "gold_removed").join(found.clusters.select("idx", F.col("cluster_id").alias("predicted"), "representative_index"), "idx")
    joined = materialize(joined, "assigned")
    labelled = joined.where("gold_removed IS NOT NULL").limit(1).count() > 0
    blind = joined.withColumn("predicted_removed", F.col("idx") != F.col("representative_index")).withColumn("mode", F.lit("blind"))
    informed = metrics.predicted_removals(joined, "gold_removed").withColumn("mode", F.lit("gold_preferred"))
    removals = metrics.removal_metrics(blind.unionByName(informed).where("gold_removed IS NOT NULL"), ["mode"]).withColumn("dataset", F.lit(spec.id))
    partition = metrics.partition_metrics(joined).withColumn("dataset", F.lit(spec.id))
    return Outcome(spec, removals, partition, blind.drop("mode"), labelled)


def run_plan(spark: SparkSession, plan: list[Dataset], folder: str, out: str | None = None, roles: tuple[str, ...] = (DEVELOPMENT, CALIBRATION), allow_held_out: bool = False, config: publication.Config = publication.Config()) -> DataFrame:
    """One row a data set and mode; results go below ``out`` if it is given.

    The loop is over data sets, of which a plan holds a few; each is a Spark
    job of its own.
    """
    rows = []
    for spec in allowed(plan, roles, allow_held_out):
        path = f"{folder.rstrip('/')}/{spec.filename}"
        gold = materialize(formats.gold_records(formats.read_delimited(spark, path), **dict(spec.columns)), "gold")
        checked(gold, spec)
        done = evaluate(gold, spec, config)
        sha = formats.manifest(spark, path).first()["sha256"]
        facts = {"dataset": spec.id, "role": spec.role, "source_sha256": sha, "records_redistributed": False}
        if out:
            tables = {"partition": done.partition, "assignment": done.assignment.select("record_id", "predicted", "predicted_removed", "gold_removed")} | ({"removals": done.removals} if done.labelled else {})
            formats.bundle(spark, f"{out.rstrip('/')}/{spec.id}", tables, facts)
        for mode in done.removals.collect() if done.labelled else []:
            rows.append((spec.id, spec.role, "removal_label", mode["mode"], mode["tp"], mode["tn"], mode["fp"], mode["fn"], mode["sensitivity"], mode["specificity"], sha))
        if not done.labelled:
            p = done.partition.first()
            rows.append((spec.id, spec.role, "partition_group", "blind", None, None, p["removed_singulars"], p["missed_duplicates"], p["duplicate_recall"], p["retention"], sha))
    return spark.createDataFrame(rows, "dataset string, role string, gold_standard string, mode string, tp long, tn long, fp long, fn long, sensitivity double, specificity double, source_sha256 string")


LOCK_GROUPS = ("locked_method_files", "locked_benchmark_manifests", "locked_runner_files")


def read_lock(spark: SparkSession, path: str) -> DataFrame:
    """(path, role, sha256) of a lock file; raises on one that names no file or a bad hash."""
    payload = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    rows = [(str(e.get("path", "")).strip(), str(e.get("role", "")).strip(), str(e.get("sha256", "")).strip().lower()) for g in LOCK_GROUPS for e in payload.get(g, [])]
    if not rows or any(not p or not r or len(h) != 64 for p, r, h in rows):
        raise ValueError("the lock names no files, or an entry lacks its path, role or hash")
    return spark.createDataFrame(rows, "path string, role string, sha256 string")


def verify_lock(spark: SparkSession, lock_path: str, root: str, strict: bool = True) -> DataFrame:
    """path, expected, observed, ok for each locked file below ``root``."""
    lock = read_lock(spark, lock_path)
    base = root.rstrip("/")
    found = formats.manifest(spark, base)
    relative = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/+", "/"), f"^{base.split(':', 1)[-1].replace('//', '/')}/", "")
    checks = formats.verify(found.withColumn("path", relative), lock)
    if strict:
        bad = [r["path"] for r in checks.where("NOT ok").collect()]
        if bad:
            raise RuntimeError(f"locked files differ or are missing: {bad}")
    return checks


def run_manifest(spark: SparkSession, results: str, lock_path: str, root: str, **facts) -> dict:
    """What a finished run consists of: the lock's own hash and each result file's; no raw records."""
    verify_lock(spark, lock_path, root)
    files = [r.asDict() for r in formats.manifest(spark, results).orderBy("path").collect()]
    return {"facts": facts, "lock_sha256": formats.manifest(spark, lock_path).first()["sha256"], "result_files": files, "raw_records_included": False}


BLIND = ("blind", "engine_quality")


def load_blind(spark: SparkSession, folder: str) -> DataFrame:
    """dataset, tp, tn, fp, fn of every metrics file below a folder that holds blind results; results informed by gold are left out."""
    schema = "dataset string, mode string, true_positive long, true_negative long, false_positive long, false_negative long"
    raw = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*metrics*.json").schema(schema).json(folder)
    raw, path = raw.withColumn("path", F.lower(F.input_file_name())), F.col("path")
    informed = path.contains("gold_preferred") | path.contains("gold-preferred") | path.contains("retention_reproduction")
    rows = raw.where("true_positive IS NOT NULL AND dataset IS NOT NULL").withColumn("informed", informed | F.coalesce(~F.col("mode").isin(*BLIND), F.lit(False))).withColumn("best", path.contains("blind_engine_quality"))
    one = rows.where("NOT informed").groupBy("dataset").agg(F.max_by(F.struct(F.col("true_positive").alias("tp"), F.col("true_negative").alias("tn"), F.col("false_positive").alias("fp"), F.col("false_negative").alias("fn")), F.struct("best", path)).alias("m"))
    return one.select("dataset", "m.*").orderBy(F.lower("dataset"))


def summary(rows: DataFrame, confidence: float = 0.95, replicates: int = 5000, seed: int = 1) -> dict[str, DataFrame]:
    """Pooled and per-dataset rates with Wilson bounds, and macro means with bootstrap bounds over data sets."""
    spark = rows.sparkSession
    each = metrics.rates(rows, 1.0).select("dataset", "sensitivity", "specificity", "precision", "f1").orderBy("dataset").collect()  # a row a data set
    macro = []
    for name in ("sensitivity", "specificity", "precision", "f1"):
        values = [r[name] for r in each]
        low, high = metrics.bootstrap_mean(values, replicates, confidence, seed)
        macro.append((name, sum(values) / len(values) if values else None, low, high))
    return {"micro": metrics.micro_macro(rows), "macro": spark.createDataFrame(macro, "metric string, mean double, low double, high double")}


RATES = {"sensitivity": ("tp", "fn"), "specificity": ("tn", "fp"), "precision": ("tp", "fp"), "accuracy": None}


def with_bounds(counts: DataFrame) -> DataFrame:
    """Counts with each rate, its Wilson bounds, and f1."""
    out = metrics.rates(counts, 1.0)
    total = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    for name, parts in RATES.items():
        k, n = (F.col("tp") + F.col("tn"), total) if parts is None else (F.col(parts[0]), F.col(parts[0]) + F.col(parts[1]))
        low, high = N.wilson(k, n)
        out = out.withColumn(f"{name}_low", low).withColumn(f"{name}_high", high)
    return out.withColumn("records", total)


def statistical_report(rows: DataFrame, replicates: int = 5000, confidence: float = 0.95, seed: int = 1) -> dict[str, DataFrame]:
    """Tables of a report on removals: ``datasets``, ``aggregates`` (pooled and means over data sets), ``table`` as it is printed.

    rows: dataset, tp, tn, fp, fn, a row a data set.
    """
    each = with_bounds(rows.select("dataset", "tp", "tn", "fp", "fn")).withColumn("removed_wrongly", F.col("fp")).withColumn("left_in", F.col("fn"))
    pooled = with_bounds(rows.agg(*[F.sum(c).alias(c) for c in ("tp", "tn", "fp", "fn")]))
    long = [F.struct(F.lit("micro").alias("over"), F.lit(m).alias("metric"), F.col(m).alias("estimate"), F.col(f"{m}_low").alias("low"), F.col(f"{m}_high").alias("high"), F.lit("wilson").alias("bounds")) for m in RATES]
    long.append(F.struct(F.lit("micro").alias("over"), F.lit("f1").alias("metric"), F.col("f1").alias("estimate"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit("none").alias("bounds")))
    micro = pooled.select(F.explode(F.array(*long)).alias("x")).select("x.*")
    macro = summary(rows, confidence, replicates, seed)["macro"].select(F.lit("macro").alias("over"), "metric", F.col("mean").alias("estimate"), "low", "high", F.lit("bootstrap").alias("bounds"))
    shown = lambda m: F.format_string("%.4f (%.4f-%.4f)", m, f"{m}_low", f"{m}_high").alias(m)
    table = each.select("dataset", "records", shown("sensitivity"), shown("specificity"), shown("precision"), F.format_string("%.4f", "f1").alias("f1"), "removed_wrongly", "left_in")
    return {"datasets": each, "aggregates": micro.unionByName(macro), "table": table}


def report_text(tables: dict[str, DataFrame]) -> str:
    """The report's aggregates as Markdown."""
    rows = tables["aggregates"].collect()  # nine rows
    sums = tables["datasets"].agg(F.count(F.lit(1)).alias("n"), F.sum("records").alias("records"), F.sum("removed_wrongly").alias("wrong"), F.sum("left_in").alias("left")).first()
    out = ["# Deduplication measured on labelled data sets", "", "Records to retain were chosen without sight of the labels.", ""]
    out.append(f"{sums['n']} data sets, {sums['records']} records: {sums['wrong']} records removed that stand for themselves, {sums['left']} duplicates left in.")
    for over, heading in (("micro", "All records pooled"), ("macro", "Means over data sets")):
        out += ["", f"## {heading}", "", "| Metric | Estimate | Low | High |", "| --- | ---: | ---: | ---: |"]
        number = lambda v: "" if v is None or v != v else f"{v:.4f}"
        out += [f"| {r['metric']} | {number(r['estimate'])} | {number(r['low'])} | {number(r['high'])} |" for r in rows if r["over"] == over]
    return "\n".join(out) + "\n"


def write_report(spark: SparkSession, folder: str, rows: DataFrame, **options) -> dict:
    """Write the statistical report: its tables as CSV, its text, the manifest with their hashes, which is returned."""
    folder, tables = folder.rstrip("/"), statistical_report(rows, **options)
    formats.write_text(spark.createDataFrame([(report_text(tables),)], "value string"), f"{folder}/report_md")
    made = formats.bundle(spark, folder, tables, {"format": "statistical report"})
    formats.write_text(spark.createDataFrame([(made["manifest"],)], "value string"), f"{folder}/manifest_json")
    return made


PARTS = ("query_translation", "dedup_ablation", "study_ablation", "blocking_recall", "metadata_stress", "scalability")


def benchmark_bundle(spark: SparkSession, folder: str, name: str, tables: dict[str, DataFrame], notes: tuple[str, ...] = ()) -> dict:
    """Write the results of a benchmark (``PARTS``, those that there are): CSV and JSON lines a table, and the manifest with their hashes."""
    unknown = set(tables) - set(PARTS)
    if unknown:
        raise ValueError(f"no parts of a benchmark: {sorted(unknown)}")
    folder = folder.rstrip("/")
    for part, rows in tables.items():
        formats.write_jsonl(rows, f"{folder}/{part}_jsonl")
    facts = {"name": name, "notes": list(notes), "parts": [p for p in PARTS if p in tables], "scope": "made-up records show that the engine works, not how well it works on real ones"}
    made = formats.bundle(spark, folder, tables, facts)
    formats.write_text(spark.createDataFrame([(made["manifest"],)], "value string"), f"{folder}/manifest_json")
    return made


def scaling(spark: SparkSession, sizes: tuple[int, ...], make, run, repeats: int = 1) -> DataFrame:
    """size, repeat, seconds: wall-clock time of ``run(make(spark, n))`` counted to its last row."""
    import time

    rows = []
    for n in sizes:
        for k in range(repeats):
            records = materialize(make(spark, n), "sized")
            began = time.perf_counter()
            run(records).count()
            rows.append((n, k, time.perf_counter() - began))
    return spark.createDataFrame(rows, "size long, repeat int, seconds double")


def stress(records: DataFrame, gold: DataFrame | Callable[[DataFrame], DataFrame], rates: tuple[float, ...], replicates: int = 1, config: publication.Config = publication.Config()) -> DataFrame:
    """rate, replicate, tp, tn, fp, fn and rates: labelled pairs scored after fields went missing.

    gold: (left_index, right_index, is_duplicate), or what makes them of (idx,
    ...) of every record and brings its columns along as structs left and right.
    """
    runs = []
    for rate in rates:
        for k in range(replicates):
            ready = materialize(publication.prepared(metrics.degraded(records, rate, k), config), "worn")
            pairs = gold(ready) if callable(gold) else publication.paired(gold, ready)
            scored = publication.assess(publication.features(pairs, config, "is_duplicate"), config)
            counts = scored.select((F.col("probability") >= config.auto_merge).alias("predicted"), "is_duplicate").agg(*metrics.confusion(F.col("predicted"), F.col("is_duplicate")))
            runs.append(counts.withColumn("rate", F.lit(rate)).withColumn("replicate", F.lit(k)))
    return metrics.rates(reduce(DataFrame.unionByName, runs), 0.0)

"""``python -m evidra COMMAND``: searches, deduplication and validation from a shell."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.operators import metrics, publication, validation
from evidra.plans import evidence, language, reports
from evidra.sources import files, formats, registry


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="evidra", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, *arguments: str, **options: dict) -> None:
        p = sub.add_parser(name, help=about)
        for a in arguments:
            p.add_argument(a)
        for flag, how in options.items():
            p.add_argument("--" + flag.replace("_", "-"), **how)

    number, many, switch = {"type": int}, {"action": "append"}, {"action": "store_true"}
    command("search", "search services and write records, responses and a report", "query", "output", source=many, year_from=number, year_to=number, limit={"type": int, "default": 1000})
    command("translate", "show a query in the languages of all services", "query", year_from=number, year_to=number)
    command("deduplicate", "deduplicate a delimited file of records", "input", "output")
    command("fetch", "fetch the files of a project", "node", "output", overwrite=switch)
    command("validate", "run a validation plan over local gold files", "plan", "folder", "output", role=many, allow_held_out=switch)
    command("validate-endnote", "validate against an EndNote XML file whose captions are the gold", "input", "output")
    command("verify-lock", "check locked files against their hashes", "lock", "root")
    command("run-manifest", "write which files a finished run consists of", "lock", "root", "results", "output", benchmark={"default": ""}, selection={"default": ""})
    command("summarize", "pool the blind results below a folder", "results", "output", replicates={"type": int, "default": 5000})
    return top


def _show(rows: DataFrame) -> None:
    for r in rows.toJSON().toLocalIterator():
        print(r)


def _main(spark: SparkSession, o: argparse.Namespace) -> int:
    out = getattr(o, "output", "").rstrip("/")
    if o.command == "search":
        run = evidence.run(spark, language.Search(o.query, o.year_from, o.year_to), tuple(o.source or registry.USUAL), o.limit)
        run.responses.write.parquet(f"{out}/responses")
        formats.bundle(spark, out, {"records": formats.export_rows(run.records), "account": run.account})
        formats.write_text(spark.createDataFrame([(reports.search_report(run),)], "value string"), f"{out}/report")
        _show(run.account.select("source", "retrieved", "total_available", "error"))
        return int(run.failures.limit(1).count() > 0)
    if o.command == "translate":
        from evidra.plans import dialects

        for source in dialects.SOURCES:
            t = dialects.translate(language.Search(o.query, o.year_from, o.year_to), source)
            print(json.dumps({"source": source, "query": t.text, "fidelity": t.fidelity_score, "requires_review": t.requires_review}, ensure_ascii=False))
    elif o.command == "deduplicate":
        records = formats.gold_records(formats.read_delimited(spark, o.input)).withColumn("source_hits", F.array().cast("array<struct<source:string,source_id:string,query:string,retrieved_at:string,rank:int>>"))
        found = publication.deduplicate(records)
        formats.bundle(spark, out, {"records": formats.export_rows(found.records), "links": found.links, "review": found.review_queue.select("left_index", "right_index", "probability", "decision"), "stats": found.stats})
        _show(found.stats)
    elif o.command == "fetch":
        print(json.dumps(files.download(list(files.osf_files(o.node)), o.output, o.overwrite), indent=1))
    elif o.command == "validate":
        plan = validation.read_plan(spark, o.plan)
        roles = tuple(o.role or (validation.DEVELOPMENT, validation.CALIBRATION))
        rows = validation.run_plan(spark, plan, o.folder, out, roles, o.allow_held_out)
        formats.write_csv(rows, f"{out}/summary")
        _show(rows)
    elif o.command == "validate-endnote":
        records = formats.read_endnote(spark, o.input)
        gold = formats.numbered(records)
        done = validation.evaluate(gold, validation.Dataset(o.input.rsplit("/", 1)[-1], validation.DEVELOPMENT))
        formats.bundle(spark, out, {"removals": done.removals, "partition": done.partition, "percent": metrics.percent_contract(done.assignment)})
        _show(done.removals)
    elif o.command == "verify-lock":
        checks = validation.verify_lock(spark, o.lock, o.root, strict=False)
        _show(checks)
        return int(checks.where("NOT ok").limit(1).count() > 0)
    elif o.command == "run-manifest":
        made = validation.run_manifest(spark, o.results, o.lock, o.root, benchmark=o.benchmark, selection=o.selection)
        formats.write_text(spark.createDataFrame([(json.dumps(made, indent=1),)], "value string"), out)
    elif o.command == "summarize":
        rows = validation.load_blind(spark, o.results)
        validation.write_report(spark, out, rows, replicates=o.replicates)
        _show(validation.statistical_report(rows, o.replicates)["aggregates"])
    return 0


def main(arguments: Sequence[str] | None = None) -> int:
    options = _parser().parse_args(arguments)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return _main(spark, options)


if __name__ == "__main__":
    sys.exit(main())

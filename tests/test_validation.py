"""Validation plans, locks, summaries, made-up records, the streamed ledger and the command line."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from evidra.__main__ import _main, _parser
from evidra.operators import metrics, publication, screening, study, validation
from evidra.plans import reports
from evidra.sources import synthetic
from evidra.streaming import ledger

GOLD = "record_id,title,author,year,journal,doi,label\n1,Sleep and work in nurses,Smith J,2001,J,10.1/a,Unique\n2,Sleep and work in nurses,Smith J,2001,J,10.1/a,Duplicate\n3,Something else entirely,Doe A,1999,K,10.1/b,Unique\n"


@pytest.fixture
def plan(tmp_path):
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "g.csv").write_text(GOLD)
    base = {"task": "publication_deduplication", "expected_records": 3, "expected_gold_duplicates_removed": 1, "expected_gold_publications": 2, "filename": "g.csv"}
    path = tmp_path / "plan.json"
    path.write_text(json.dumps({"datasets": [base | {"id": "a", "role": "development"}, base | {"id": "b", "role": "held_out_test"}, {"id": "c", "role": "development", "task": "other"}]}))
    return path


def test_plan(spark, plan, tmp_path):
    known = validation.read_plan(spark, str(plan))
    assert [d.id for d in known] == ["a", "b"] and [d.id for d in validation.allowed(known)] == ["a"]
    with pytest.raises(PermissionError):
        validation.allowed(known, ("held_out_test",))
    rows = validation.run_plan(spark, known, str(tmp_path / "data"), str(tmp_path / "out")).collect()
    assert {(r.mode, r.tp, r.tn, r.fp, r.fn) for r in rows} == {("blind", 1, 2, 0, 0), ("gold_preferred", 1, 2, 0, 0)}
    assert rows[0].source_sha256 == hashlib.sha256(GOLD.encode()).hexdigest()
    with pytest.raises(ValueError):
        validation.run_plan(spark, [validation.Dataset("a", "development", "g.csv", 4)], str(tmp_path / "data"))


def test_lock(spark, tmp_path):
    (tmp_path / "root").mkdir()
    (tmp_path / "root" / "m.py").write_text("x")
    entry = {"path": "m.py", "role": "method", "sha256": hashlib.sha256(b"x").hexdigest()}
    lock = tmp_path / "lock.json"
    lock.write_text(json.dumps({"locked_method_files": [entry]}))
    assert [r.ok for r in validation.verify_lock(spark, str(lock), str(tmp_path / "root")).collect()] == [True]
    made = validation.run_manifest(spark, str(tmp_path / "root"), str(lock), str(tmp_path / "root"), benchmark="b")
    assert len(made["result_files"]) == 1 and made["facts"] == {"benchmark": "b"}
    lock.write_text(json.dumps({"locked_method_files": [entry, entry | {"path": "gone.py"}]}))
    with pytest.raises(RuntimeError):
        validation.verify_lock(spark, str(lock), str(tmp_path / "root"))
    lock.write_text("{}")
    with pytest.raises(ValueError):
        validation.read_lock(spark, str(lock))


def test_summary(spark, tmp_path):
    for name, folder, tp in (("a", "blind_engine_quality", 9), ("a", "gold_preferred", 10), ("b", "blind_engine_quality", 10)):
        (tmp_path / name / folder).mkdir(parents=True)
        (tmp_path / name / folder / "metrics.json").write_text(json.dumps({"dataset": name, "true_positive": tp, "true_negative": 80, "false_positive": 1, "false_negative": 10 - tp}))
    rows = validation.load_blind(spark, str(tmp_path))
    assert [(r.dataset, r.tp) for r in rows.collect()] == [("a", 9), ("b", 10)]
    found = validation.summary(rows, replicates=50)
    micro = {r.dataset: r for r in found["micro"].collect()}
    assert micro[None].tp == 19 and abs(micro[None].sensitivity - 0.95) < 1e-12
    assert {r.metric for r in found["macro"].collect()} == {"sensitivity", "specificity", "precision", "f1"}


def test_made_records(spark):
    records, labels = synthetic.duplicates(spark, 20, 0.4)
    found = publication.deduplicate(records)
    merged = {(min(r.kept_index, r.removed_index), max(r.kept_index, r.removed_index)) for r in found.links.collect()}
    assert merged == {(r.left_index, r.right_index) for r in labels.where("is_duplicate").collect()} and merged
    worn = validation.stress(records, labels, (0.0, 0.5)).collect()
    assert worn[0].sensitivity == 1 and worn[1].sensitivity <= 1 and worn[0].fp == 0
    assert synthetic.unique_records(spark, 30).select("doi").distinct().count() == 30
    assert [r.size for r in validation.scaling(spark, (5, 9), synthetic.unique_records, lambda d: publication.deduplicate(d).records).collect()] == [5, 9]
    reports_, pairs = synthetic.study_reports(spark, 4)
    linked = study.link(reports_)
    assert sorted(r.member_indices for r in linked.families.collect()) == [[0, 1, 2], [3, 4, 5], [6, 7, 8], [9, 10, 11]]
    assert pairs.where("same_study").count() == 12


def events(spark):
    rows = [
        (1, "R1", "FULL_TEXT", "a", "INCLUDE", None, False), (2, "R1", "FULL_TEXT", "b", "EXCLUDE", "OTHER", False), (3, "R1", "FULL_TEXT", "x", "INCLUDE", None, True),
        (4, "R2", "TITLE_ABSTRACT", "a", "INCLUDE", None, False), (5, "R2", "TITLE_ABSTRACT", "a", "EXCLUDE", None, False), (6, "R3", "TITLE_ABSTRACT", "a", "MAYBE", None, False), (7, "R3", "TITLE_ABSTRACT", "b", "INCLUDE", None, False),
        (8, "R1", "FULL_TEXT", "b", "EXCLUDE", "OTHER", False), (9, None, "FULL_TEXT", "b", "EXCLUDE", "OTHER", False),
    ]
    return spark.createDataFrame([(*r, None) for r in rows], "seq long, record_id string, stage string, reviewer string, decision string, reason_code string, adjudication boolean, reason_text string")


def test_stream_and_batch_agree(spark, tmp_path):
    every = events(spark)
    want = {(r.record_id, r.stage, r.decision, r.conflict) for r in screening.state(every.where("record_id IS NOT NULL")).collect()}
    source = str(tmp_path / "in")
    for low, high in ((5, 9), (1, 4)):  # the later part arrives first
        every.where(F.col("seq").between(low, high)).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).parquet(source)
    got = ledger.newest(ledger.drain(ledger.final_decisions(stream)))
    assert {(r.record_id, r.stage, r.decision, r.conflict) for r in got.collect()} == want
    counted = ledger.drain(ledger.activity(spark.readStream.schema("ts timestamp, kind string").parquet(_clicks(spark, tmp_path)), "ts", ["kind"], "1 hour", "10 minutes"))
    assert sorted(r.n for r in counted.collect()) == [1, 2]
    once = ledger.drain(ledger.arriving_once(spark.readStream.schema("ts timestamp, kind string").parquet(_clicks(spark, tmp_path)), ["kind"], "ts", "1 hour"), "append")
    assert once.count() == 1


def test_appending(spark):
    log = screening.append(screening.ledger(spark), [screening.event("R1", "INCLUDE"), screening.event("R1", "EXCLUDE", reviewer=" b ")])
    assert screening.final_decision(log, "R1", "TITLE_ABSTRACT") == "NOT_SCREENED" and screening.final_decision(log, "R2", "TITLE_ABSTRACT") is None
    log = screening.append(log, [screening.adjudication("R1", "EXCLUDE", "TITLE_ABSTRACT", reason_code="other")])
    assert screening.final_decision(log, "R1", "TITLE_ABSTRACT") == "EXCLUDE"
    assert [(r.seq, r.reviewer, r.reason_code) for r in log.orderBy("seq").collect()] == [(0, "reviewer-1", None), (1, "b", None), (2, "adjudicator", "OTHER")]
    for bad in (screening.event("R1", "EXCLUDE", "FULL_TEXT"), screening.event("R1", "INCLUDE", reason_code="OTHER"), screening.event("R1", "EXCLUDE", reason_code="NONE"), screening.event("R1", "INCLUDE", reviewer=" ")):
        with pytest.raises(ValueError):
            screening.append(log, [bad])


def _clicks(spark, tmp_path):
    path = str(tmp_path / "clicks")
    spark.sql("SELECT timestamp'2024-01-01 10:05:00' AS ts, 'k' AS kind UNION ALL SELECT timestamp'2024-01-01 10:06:00', 'k' UNION ALL SELECT timestamp'2024-01-01 11:05:00', 'k'").coalesce(1).write.mode("overwrite").parquet(path)
    return path


def test_gate_only_where_registrations_differ(spark):
    known = spark.createDataFrame([(0, ["A"]), (1, ["A", "B"]), (2, []), (3, ["A"]), (10, ["C"]), (11, []), (12, ["D"])], "idx long, registry_ids array<string>")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (10, 11), (11, 12)], "left_index long, right_index long").withColumn("decision", F.lit(study.SAME)).withColumn("study_probability", F.lit(0.99))
    got = {(r.left_index, r.right_index): (r.refused, r.family, r.other) for r in study.gated(edges, known).collect()}
    assert got == {(0, 1): (False, 0, 0), (1, 2): (False, 0, 0), (2, 3): (False, 0, 0), (10, 11): (False, 10, 10), (11, 12): (True, 10, 12)}


def test_bundles(spark, tmp_path):
    records, _ = synthetic.duplicates(spark, 4, 0.5)
    made = reports.screening_bundle(records, str(tmp_path / "bundle"), events(spark).where("record_id IS NOT NULL"), study.link(records))
    names = {f["path"].split("/bundle/")[1].split("/")[0] for f in made["files"]}
    assert {"records_csv", "records_jsonl", "records_ris", "records_bibtex", "asreview_csv", "asreview_ris", "screening_audit_jsonl", "screening_audit_csv", "study_families_csv", "study_edges_csv"} <= names
    flow = spark.createDataFrame([("database", "PubMed", 10), ("removed", "duplicates_removed", 2), ("stage", "records_screened", 8), ("stage", "reports_included", 1)], "category string, label string, count long")
    chart = reports.mermaid(flow)
    assert '["titles and abstracts read: 8"]' in chart and "studies they belong to: not known" in chart and '["PubMed: 10"]' in chart
    assert "studies they belong to: 4" in reports.mermaid(flow, 4)
    assert reports.flow_bundle(spark, str(tmp_path / "flow"), flow)["files"]


def test_command_line(spark, plan, tmp_path, capsys):
    run = lambda *a: _main(spark, _parser().parse_args([str(x) for x in a]))
    assert run("translate", "a NEAR/3 b") == 0 and "W/3" in capsys.readouterr().out
    assert run("deduplicate", tmp_path / "data" / "g.csv", tmp_path / "dedup") == 0 and '"output_records":2' in capsys.readouterr().out
    assert run("validate", plan, tmp_path / "data", tmp_path / "val") == 0 and '"dataset":"a"' in capsys.readouterr().out
    xml = tmp_path / "e.xml"
    one = "<record><rec-number>{0}</rec-number><titles><title><style>Sleep and work in nurses</style></title></titles><dates><year><style>2001</style></year></dates><electronic-resource-num><style>10.1/a</style></electronic-resource-num><caption><style>{1}</style></caption></record>"
    xml.write_text("<xml><records>" + one.format(1, "") + one.format(2, "duplicate") + "</records></xml>")
    assert run("validate-endnote", xml, tmp_path / "en") == 0 and '"tp":1' in capsys.readouterr().out


def test_study_metrics_count_one_publication_as_one_study(spark):
    rows = [(0.97, "SAME_STUDY", True), (0.2, "DUPLICATE_PUBLICATION", True), (0.7, "REVIEW", False), (0.1, "DIFFERENT_STUDY", True), (0.99, "SAME_STUDY", False)]
    m = metrics.study_metrics(spark.createDataFrame(rows, "study_probability double, decision string, same_study boolean")).first()
    assert (m.tp, m.tn, m.fp, m.fn, m.in_review) == (2, 1, 1, 1, 1) and m.false_link_rate == 0.5 and m.review_share == 0.2


def test_statistical_report(spark, tmp_path):
    rows = spark.createDataFrame([("a", 8, 90, 1, 1), ("b", 0, 50, 0, 0)], "dataset string, tp long, tn long, fp long, fn long")
    made = validation.write_report(spark, str(tmp_path / "r"), rows, replicates=50)
    assert {f["path"].split("/r/")[1].split("/")[0] for f in made["files"]} == {"datasets", "aggregates", "table", "report_md"}
    tables = validation.statistical_report(rows, 50)
    assert {(r.over, r.metric) for r in tables["aggregates"].collect()} >= {("micro", "f1"), ("micro", "accuracy"), ("macro", "sensitivity")}
    assert [r.sensitivity for r in tables["table"].orderBy("dataset").collect()][0].startswith("0.8889 (")
    text = validation.report_text(tables)
    assert "2 data sets, 150 records: 1 records removed" in text and "| sensitivity | 0.8889 |" in text


def test_benchmark_bundle(spark, tmp_path):
    made = validation.benchmark_bundle(spark, str(tmp_path / "b"), "run 1", {"scalability": spark.createDataFrame([(50, 0.1)], "size int, seconds double")}, ("a note",))
    facts = json.loads(made["manifest"])["facts"]
    assert facts["parts"] == ["scalability"] and facts["notes"] == ["a note"]
    assert {f["path"].split("/b/")[1].split("/")[0] for f in made["files"]} == {"scalability", "scalability_jsonl"}
    with pytest.raises(ValueError):
        validation.benchmark_bundle(spark, str(tmp_path / "b"), "x", {"other": spark.range(1)})

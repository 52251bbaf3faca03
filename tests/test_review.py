"""Screening, flow, metrics, files and the catalogue's SQL."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from evidra.operators import flow, metrics, screening
from evidra.plans import catalogue, interchange, oracles
from evidra.plans.components import connected_components
from evidra.sources import formats

EVENT = "seq long, record_id string, stage string, decision string, reviewer string, reason_code string, reason_text string, adjudication boolean"


def events(spark, *rows):
    return spark.createDataFrame([(i, r, s, d, w, c, None, a) for i, (r, s, d, w, c, a) in enumerate(rows)], EVENT)


TA, FT = screening.STAGES


def test_adjudication_and_revision(spark):
    rows = [("r", TA, "INCLUDE", "a", None, False), ("r", TA, "EXCLUDE", "b", None, False)]
    assert screening.conflicts(events(spark, *rows)).count() == 1
    rows.append(("r", TA, "INCLUDE", "z", None, True))
    s = screening.state(events(spark, *rows)).first()
    assert s.decision == "INCLUDE" and not s.conflict
    rows += [("r", TA, "EXCLUDE", "a", None, False)]
    s = screening.state(events(spark, *rows)).first()
    assert s.decision == "EXCLUDE" and not s.conflict


def test_validation(spark):
    bad = screening.rejected(events(spark, ("r", FT, "EXCLUDE", "a", None, False), ("r", TA, "INCLUDE", "a", "OTHER", False), ("r", TA, "EXCLUDE", " ", "NEW", False), ("r", FT, "EXCLUDE", "a", "OTHER", False)))
    assert {r.seq: len(r.problems) for r in bad.collect()} == {0: 1, 1: 1, 2: 2}


def test_agreement(spark):
    rows = [(f"r{i}", TA, d, w, None, False) for i, (x, y) in enumerate([("INCLUDE", "INCLUDE"), ("EXCLUDE", "EXCLUDE"), ("INCLUDE", "EXCLUDE"), ("INCLUDE", "INCLUDE")]) for w, d in (("a", x), ("b", y))]
    a = screening.agreement(events(spark, *rows)).first()
    assert a.percent_agreement == 0.75 and a.cohens_kappa == pytest.approx(0.5)


def test_flow(spark):
    e = events(spark, ("r1", TA, "INCLUDE", "a", None, False), ("r2", TA, "INCLUDE", "a", None, False), ("r3", TA, "EXCLUDE", "a", None, False), ("r1", FT, "INCLUDE", "a", None, False), ("r2", FT, "INCLUDE", "a", None, False))
    found = flow.flow(spark.createDataFrame([("pubmed", 4)], "source string, records long"), spark.createDataFrame([(1,)], "duplicates_removed long"), e)
    got = {(r.category, r.label): r["count"] for r in found.collect()}
    assert got["database", "PubMed"] == 4 and [got["stage", c] for c in flow.STAGE_COUNTS] == [3, 1, 2, 0, 2, 2]
    assert flow.checks(found).where("failed").count() == 0
    families = spark.createDataFrame([("S", [0, 1])], "study_id string, member_indices array<long>")
    ids = spark.createDataFrame([("r1", 0), ("r2", 1)], "record_id string, idx long")
    assert flow.studies_included(e, families, ids).first().studies_included == 1


def test_metrics(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    m = metrics.retrieval_metrics(ids("a", "b", " c ", ""), ids("b", "c", "d")).first()
    assert m.precision == m.recall == pytest.approx(2 / 3) and m.jaccard == 0.5
    p = metrics.partition_metrics(spark.createDataFrame([("g1", "x"), ("g2", "x")], "gold_group string, predicted string")).first()
    assert p.removed_singulars == 1 and p.retention == 0.5
    rows = spark.createDataFrame([(0.9, True), (0.8, False), (0.2, False), (0.6, True)], "p double, gold boolean")
    best = metrics.best_threshold(metrics.threshold_sweep(rows, 0.1), 0.6).first()
    assert best.recall == 1.0
    a, b = metrics.platt_fit(rows)
    assert a > 0 and metrics.bootstrap_share(50, 100, 200)[0] < 0.5


@pytest.mark.parametrize("few", [0, 100])
def test_components(spark, few):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i != 20] + [(90, 91), (91, 90), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges, few=few).collect()}
    assert got == {i: 0 if i <= 20 else 21 for i in range(41)} | {90: 90, 91: 90}


def test_ris_round_trip(spark, tmp_path):
    (tmp_path / "a.ris").write_text("TY  - JOUR\r\nTI  - First\r\n  goes on\r\nAU  - Smith J\nAU  - Doe A\nPY  - 2020/05\nDO  - https://doi.org/10.1/X\nER  - \n\nTY  - JOUR\nAB  - only this\nER  -\n")
    got = formats.read_ris(spark, str(tmp_path / "a.ris")).orderBy("pos").collect()
    assert [(r.title, r.authors, r.year, r.doi, r.abstract) for r in got] == [("First goes on", ["Smith J", "Doe A"], 2020, "10.1/x", None), (None, [], None, None, "only this")]


def test_bibtex(spark):
    from tests.test_records import frame

    got = frame(spark, {"title": "A_b & {c}\\", "authors": ["Müller J", "Doe A"], "year": 2020}).select(formats.bibtex_record().alias("x")).first().x
    assert got == "@article{müller2020_1,\n".replace("ü", "") + "  title = {A\\_b \\& \\{c\\}\\textbackslash\\{\\}},\n  author = {Müller J and Doe A},\n  year = {2020}\n}\n\n"


def test_gold(spark, tmp_path):
    (tmp_path / "g.csv").write_text('record_id,title,author,year,label\n1,"A, b",Smith J; Doe A,2020,Unique\n1,C,X and Y,n.d.,Duplicate\n')
    got = formats.gold_records(formats.read_delimited(spark, str(tmp_path / "g.csv"))).orderBy("idx").collect()
    assert [(r.record_id, r.title, r.authors, r.year, r.gold_removed) for r in got] == [("1", "A, b", ["Smith J", "Doe A"], 2020, False), ("1__ROW2", "C", ["X", "Y"], None, True)]
    (tmp_path / "b.csv").write_text("id,title,label\n1,A,perhaps\n")
    with pytest.raises(Exception, match="unknown removal label"):
        formats.gold_records(formats.read_delimited(spark, str(tmp_path / "b.csv"))).collect()


def test_endnote(spark, tmp_path):
    one = "<record><database>d</database><rec-number>1</rec-number><contributors><authors><author><style>Smith, J</style></author></authors></contributors><titles><title><style>A </style><style>title</style></title></titles><dates><year><style>2019</style></year></dates><caption><style>Duplicate</style></caption></record>"
    (tmp_path / "e.xml").write_text(f"<xml><records>{one}{one.replace('<caption><style>Duplicate</style></caption>', '')}</records></xml>")
    got = formats.read_endnote(spark, str(tmp_path / "e.xml")).collect()
    assert {(r.title, tuple(r.authors), r.year, r.gold_removed) for r in got} == {("A title", ("Smith, J",), 2019, True), ("A title", ("Smith, J",), 2019, False)}


def test_bundle(spark, tmp_path):
    out = formats.bundle(spark, f"file://{tmp_path}/b", {"t": spark.range(3).select("id", F.array("id").alias("x"))})
    found = formats.manifest(spark, f"file://{tmp_path}/b").select("path", "sha256")
    assert len(out["files"]) >= 1 and formats.verify(found, found).where("NOT ok").count() == 0


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES | interchange.QUERIES))
def test_catalogue(spark, sf, name):
    compared(spark, sf, (catalogue.QUERIES | interchange.QUERIES)[name], (oracles.ORACLES | interchange.ORACLES).get(name))


def compared(spark, sf, query, sql, prepare=lambda con: None):
    got = query(spark, sf)
    columns = sorted(got.columns)
    rows = sorted(repr(tuple(r[c] for c in columns)) for r in got.collect())
    if sql is None:
        return
    con = duckdb.connect()
    prepare(con)
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(sql)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


WHOLE = ("dedup_score_full", "representative", "connected_components_publications", "merge_records", "merge_conflicts", "dedup_links", "dedup_stats", "ablation")


@pytest.mark.parametrize("name", WHOLE)
def test_the_whole_scorer(spark, sf, name):
    """The queries with the whole scorer against their SQL, to which the comparison of characters is lent from Python."""
    from difflib import SequenceMatcher

    native = oracles.ORACLES[{"dedup_score_full": "dedup_score_native"}.get(name, name + "_native")]
    sql = native
    for column in ("title", "journal"):
        sql = sql.replace(oracles._SAME.format(column), f"CASE WHEN a.{column} <> '' AND b.{column} <> '' THEN ratio(a.{column}, b.{column}) END")
    assert sql != native
    lend = lambda con: con.create_function("ratio", lambda a, b: SequenceMatcher(None, a, b).ratio(), ["VARCHAR", "VARCHAR"], "DOUBLE")
    run = catalogue.QUERIES[name]
    if name == "dedup_score_full":
        run = lambda spark, sf: catalogue.QUERIES[name](spark, sf).select("left_index", "right_index", F.round("probability", 9).alias("probability"))
    compared(spark, sf, run, sql, lend)


def test_ledgers_in_several_files_are_numbered_as_one(spark, tmp_path):
    for name, ids in (("a.jsonl", (1, 2)), ("b.jsonl", (3, 4, 5))):
        (tmp_path / name).write_text("".join(f'{{"event_id": "{i}", "record_id": "r{i}"}}\n\n' for i in ids))
    got = formats.read_ledger(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.seq, r.event_id) for r in got] == [(i - 1, str(i)) for i in range(1, 6)]


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_ris_with_other_line_ends_in_small_splits(spark, tmp_path, end):
    one = "TY  - JOUR{e}TI  - Title {i}{e}AU  - A{e}ER  - {e}{e}"
    (tmp_path / "a.ris").write_bytes(b"\xef\xbb\xbf" + "".join(one.format(e=end, i=i) for i in range(300)).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        got = formats.read_ris(spark, str(tmp_path / "a.ris")).orderBy("pos").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.title for r in got] == [f"Title {i}" for i in range(300)]


def test_files_in_other_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("title,author\nÜber Schlaf,Müller\n".encode("cp1252"))
    (tmp_path / "b.csv").write_bytes("title,author\nÉtude,Zoë\n".encode("utf-8-sig"))
    got = formats.read_delimited(spark, str(tmp_path)).orderBy("idx").collect()
    assert {(r.title, r.author) for r in got} == {("Über Schlaf", "Müller"), ("Étude", "Zoë")}
    assert formats.decoded("é".encode("cp1252")) == "é" and formats.decoded("é".encode()) == "é" and formats.decoded(b"\x81") == "\x81"

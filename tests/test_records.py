"""Facts about records: functions, deduplication, study linkage."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evidra.functions import numbers as N
from evidra.functions import text as T
from evidra.operators import blocking, publication, study

RECORD = "idx long, title string, authors array<string>, year int, journal string, abstract string, doi string, pmid string, wos_ut string, scopus_eid string, openalex_id string, source_hits array<struct<source:string,source_id:string,query:string,retrieved_at:string,rank:int>>, metadata map<string,string>"


def frame(spark, *rows):
    full = []
    for i, r in enumerate(rows):
        hits = [(s, str(i), "q", None, 1) for s in r.pop("sources", [])]
        full.append((i, r.pop("title"), r.pop("authors", []), r.pop("year", None), r.pop("journal", None), r.pop("abstract", None), r.pop("doi", None), r.pop("pmid", None), None, None, r.pop("openalex_id", None), hits, r))
    return spark.createDataFrame(full, RECORD)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_text(spark):
    assert value(spark, T.norm_folded(F.lit("Ça va -- Été! ½ ﬁn ß"))) == "ca va ete 12 fin"
    assert value(spark, T.norm_plain(F.lit("Ça va -- Été!"))) == "a va t"
    assert value(spark, T.norm_doi(F.lit(" https://doi.org/DOI:10.1/A "))) == "10.1/a"
    assert value(spark, T.norm_doi(F.lit("https://dx.doi.org/10.1/A"))) == "https://dx.doi.org/10.1/a"
    assert value(spark, T.author_key(F.lit("J van Smith"))) == "smith"
    ids = value(spark, T.registry_ids(F.lit("nct 01234567, CTRI / 2020 / 01 / 12345 and EudraCT: 2010-123456-12; chictr-ABCD12345")))
    assert ids == ["CHICTR:ABCD12345", "CTRI:2020/01/12345", "EUCTR:2010-123456-12", "NCT:01234567"]
    assert value(spark, T.study_acronyms(F.lit("The (PROSPER-2) and (RCT): HEART study"))) == ["HEART", "PROSPER-2"]
    assert value(spark, T.strip_markup(F.lit("<jats:p>A &lt; B</jats:p>\n <i>c</i>"))) == "A < B c"
    assert value(spark, T.abstract_from_index(F.create_map(F.lit("model"), F.array(F.lit(1)), F.lit("Diabetes"), F.array(F.lit(0), F.lit(2))))) == "Diabetes model Diabetes"
    assert value(spark, T.git_blob_sha1(F.lit("hello\n").cast("binary"))) == "ce013625030ba8dba906f756967f9e9ca394464a"
    assert value(spark, study.family_id(F.lit("registry|NCT:01234567"))) == "STUDY-11F7394FC86F"


def test_numbers(spark):
    low, high = N.wilson(F.lit(50), F.lit(100))
    assert value(spark, low) == pytest.approx(0.4038, abs=1e-4) and value(spark, high) == pytest.approx(0.5962, abs=1e-4)
    assert value(spark, N.year_in(F.lit("in 2019-05"))) == 2019
    assert value(spark, N.first_number(F.lit("n = 1,234 people"))) == 1234


def test_same_doi(spark):
    r = publication.deduplicate(frame(spark, {"title": "A study of sleep", "doi": "10.1/x", "sources": ["pubmed"]}, {"title": "A study of sleep", "doi": "10.1/x", "sources": ["scopus"]}))
    m = r.records.collect()
    assert len(m) == 1 and {h.source for h in m[0].source_hits} == {"pubmed", "scopus"} and m[0].cluster_size == 2
    assert [x.rule for x in r.links.collect()] == ["doi_exact"]


def test_conflicts_keep_apart(spark):
    r = publication.deduplicate(frame(spark, {"title": "Sleep in adults", "authors": ["Smith J"], "doi": "10.1/x"}, {"title": "Sleep in adults", "authors": ["Smith J"], "doi": "10.1/y"}))
    e = r.assessments.first()
    assert e.decision == "KEEP_SEPARATE" and e.probability < 0.2
    pair = frame(spark, {"title": "Sleep in adults", "authors": ["Smith J"], "year": 2020, "type": "preprint"}, {"title": "Sleep in adults", "authors": ["Smith J"], "year": 2020, "type": "journal-article"})
    e = publication.deduplicate(pair).assessments.first()
    assert e.features.publication_form_conflict == 1.0 and e.probability <= 0.45 and e.decision == "KEEP_SEPARATE"


def test_a_title_alone_is_not_enough(spark):
    assert publication.deduplicate(frame(spark, {"title": "Editorial"}, {"title": "Editorial"})).assessments.first().decision != "AUTO_MERGE"


def test_identifier_floor_outlasts_the_cap(spark):
    e = publication.deduplicate(frame(spark, {"title": "Aaa bbb", "pmid": "1", "openalex_id": "w1"}, {"title": "Ccc ddd", "pmid": "1", "openalex_id": "w2"})).assessments.first()
    assert e.probability == 0.9995 and e.decision == "AUTO_MERGE"


def test_blocking(spark):
    rows = [{"title": f"Topic number {i} of research", "authors": [f"Author{i} X"], "year": 2000 + i} for i in range(11)] + [{"title": "Topic number 3 of research", "authors": ["Author3 X"], "year": 2003}]
    r = publication.deduplicate(frame(spark, *rows), publication.Config(exhaustive_limit=5))
    s = r.stats.first()
    assert s.output_records == 11 and not s.used_exhaustive_pairing
    keys = blocking.publication_keys(frame(spark, *[{"title": "Same title"} for _ in range(4)]))
    assert blocking.blocked_pairs(keys, cap=3).count() == 0 and blocking.dropped_blocks(keys, cap=3).count() > 0


def test_study_family(spark):
    r = study.link(
        frame(
            spark,
            {"title": "Exercise trial protocol", "authors": ["Smith J"], "year": 2018, "abstract": "NCT01234567"},
            {"title": "Exercise: a randomized controlled trial", "authors": ["Smith J"], "year": 2020, "abstract": "NCT 01234567"},
            {"title": "Exercise follow-up", "authors": ["Smith J"], "year": 2024, "abstract": "nct-01234567"},
            {"title": "Something else", "authors": ["Zed Q"], "year": 2020},
        )
    )
    found = {tuple(f.member_indices): f for f in r.families.collect()}
    assert set(found) == {(0, 1, 2), (3,)} and found[0, 1, 2].study_id == "STUDY-11F7394FC86F" and found[0, 1, 2].confidence >= 0.998
    assert [(x.severity, x.member_indices) for x in r.risks.collect()] == [("HIGH", [1, 2])]


def test_gate(spark):
    """A report without registration may not join two registered trials."""
    a = {"title": "HEARTLY trial one", "authors": ["Smith J", "Doe A"], "year": 2020, "country": "Chile", "sample_size": "100", "intervention": "aspirin", "population": "adults", "recruitment_start": "2015", "acronym": "HEARTLY"}
    rows = [a | {"abstract": "NCT01234567"}, a | {"title": "HEARTLY trial two report"}, a | {"abstract": "NCT07654321", "title": "HEARTLY trial one report three"}]
    r = study.link(frame(spark, *rows), study.Config(same_study=0.9, publications=publication.Config(auto_merge=1.0, review=0.9)))
    for f in r.families.collect():
        assert len(f.registry_ids) < 2
    decisions = {(e.left_index, e.right_index): e for e in r.assessments.collect()}
    assert decisions[0, 2].decision != "SAME_STUDY" and decisions[0, 2].study_probability <= 0.74
    assert any(study.GATE in e.rules for e in r.review_queue.collect())


def test_review_role(spark):
    r = study.link(frame(spark, {"title": "A systematic review", "abstract": "NCT01234567"}, {"title": "A trial", "abstract": "NCT01234567"}))
    assert r.assessments.first().study_probability <= 0.60

"""Service responses, live searches with services that are made up, and what reports on them say."""

from __future__ import annotations

import hashlib
import json

import pytest

from evidra.plans import evidence, reports
from evidra.plans import language as L
from evidra.sources import files, live, payloads, registry

BODY = "value string, query string, retrieved_at string, first_rank long"


def parsed(spark, source, *bodies):
    rows = [(b if isinstance(b, str) or b is None else json.dumps(b), "q", "t", 1) for b in bodies]
    return payloads.parse(spark.createDataFrame(rows, BODY), source).collect()


PUBMED = """<?xml version="1.0"?><PubmedArticleSet><PubmedArticle><MedlineCitation><PMID Version="1">12</PMID><Article><Journal><Title>Trials &amp; Errors</Title><JournalIssue><PubDate><MedlineDate>1998 Nov-Dec</MedlineDate></PubDate></JournalIssue></Journal>
<ArticleTitle>Sleep and <i>work</i>: a trial</ArticleTitle><Abstract><AbstractText Label="AIM">To &lt;see&gt;.</AbstractText><AbstractText>Done.</AbstractText><AbstractText/></Abstract>
<AuthorList><Author ValidYN="Y"><LastName>Smith</LastName><ForeName>Jo</ForeName></Author><Author><CollectiveName>The Group</CollectiveName></Author><Author><LastName>Doe</LastName><Initials>A</Initials></Author></AuthorList>
<Language>eng</Language><PublicationTypeList><PublicationType UI="D1">Journal Article</PublicationType><PublicationType>Trial</PublicationType></PublicationTypeList></Article></MedlineCitation>
<PubmedData><ArticleIdList><ArticleId IdType="pubmed">12</ArticleId><ArticleId IdType="doi"> 10.1/AbC </ArticleId><ArticleId IdType="pmc">PMC7</ArticleId></ArticleIdList></PubmedData></PubmedArticle><PubmedArticle><MedlineCitation><PMID>13</PMID></MedlineCitation></PubmedArticle></PubmedArticleSet>"""


def test_pubmed(spark):
    a, b = parsed(spark, "pubmed", PUBMED)
    assert (a.title, a.authors, a.year, a.journal, a.doi, a.pmid) == ("Sleep and work : a trial", ["Smith Jo", "The Group", "Doe A"], 1998, "Trials & Errors", "10.1/abc", "12")
    assert a.abstract == "AIM: To <see>.\nDone." and json.loads(a.metadata["publication_types"]) == ["Journal Article", "Trial"] and a.metadata["pmcid"] == "PMC7"
    assert (b.title, b.authors, b.year, b.source_hits[0].rank) == ("[Untitled PubMed record]", [], None, 2)


def test_openalex(spark):
    item = {"id": "https://openalex.org/W1", "title": "Diabetes", "publication_year": 2020, "ids": {"pmid": "https://pubmed.ncbi.nlm.nih.gov/55/"}, "doi": "https://doi.org/10.1/X", "abstract_inverted_index": {"model": [1], "Diabetes": [0]}, "authorships": [{"author": {"display_name": "Doe A"}}, {"author": {}}], "primary_location": {"source": {"display_name": "J"}}}
    a, b = parsed(spark, "openalex", {"results": [item, {"display_name": None, "publication_year": "no"}]})
    assert (a.title, a.abstract, a.pmid, a.doi, a.openalex_id, a.authors, a.journal, a.year) == ("Diabetes", "Diabetes model", "55", "10.1/x", "https://openalex.org/W1", ["Doe A"], "J", 2020)
    assert b.title == "[Untitled OpenAlex record]" and b.year is None and b.authors == []


def test_crossref(spark):
    item = {"DOI": "10.1/Y", "title": ["A", "B"], "container-title": ["J"], "issued": {"date-parts": [[None]]}, "created": {"date-parts": [[2019, 3]]}, "abstract": "<jats:p>One &amp; two</jats:p>", "author": [{"family": "Doe", "given": "A"}, {"name": "Group"}, {}], "type": "journal-article"}
    (a,) = parsed(spark, "crossref", {"message": {"items": [item]}})
    assert (a.title, a.journal, a.year, a.abstract, a.authors, a.doi, a.metadata["publication_date"]) == ("A", "J", 2019, "One & two", ["Doe A", "Group"], "10.1/y", "2019-03-01")


def test_others(spark):
    (e,) = parsed(spark, "europe_pmc", {"resultList": {"result": [{"id": "9", "source": "MED", "title": "T", "pubYear": "2001", "authorList": {"author": [{"fullName": "Doe A"}, {"lastName": "Roe", "firstName": "B"}]}, "journalInfo": {"journal": {"title": "J"}}}]}})
    assert (e.source_hits[0].source_id, e.authors, e.year, e.journal) == ("MED:9", ["Doe A", "Roe B"], 2001, "J")
    (c,) = parsed(spark, "core", {"results": [{"id": 4, "title": ["", "T"], "authors": [{"name": "Doe"}, "Roe"], "publishedDate": "1999-01-01", "journals": [{"title": "J"}], "downloadUrl": "u"}]})
    assert (c.title, c.authors, c.year, c.journal, c.source_hits[0].source_id, c.metadata["full_text_available"]) == ("T", ["Doe", "Roe"], 1999, "J", "4", "true")
    s = parsed(spark, "scopus", {"search-results": {"entry": [{"eid": "2-s2", "dc:title": "T", "dc:creator": "Doe A.", "prism:coverDate": "2010-05-01", "prism:doi": "10.2/Z", "prism:volume": "3"}, {"author": {"surname": "Roe", "initials": "B"}}]}})
    assert (s[0].authors, s[0].year, s[0].scopus_eid, s[0].doi, s[0].metadata["volume"], s[1].authors) == (["Doe A."], 2010, "2-s2", "10.2/z", "3", ["Roe B"])
    (w,) = parsed(spark, "web_of_science", {"hits": [{"uid": "WOS:1", "title": "T", "names": {"authors": [{"displayName": "Doe"}]}, "source": {"publishYear": 2004, "sourceTitle": "J"}, "identifiers": {"pmid": "8"}, "citations": [{"count": 2}, {"count": "7"}, {}]}]})
    assert (w.wos_ut, w.authors, w.year, w.pmid, w.metadata["times_cited"]) == ("WOS:1", ["Doe"], 2004, "8", "7")
    rec = {
        "UID": "WOS:2", "static_data": {"summary": {"titles": {"title": [{"type": "source", "content": "J"}, {"type": "item", "content": "T"}]}, "names": {"name": {"role": "author", "display_name": "Doe"}}, "pub_info": {"pubyear": 2003, "vol": 5, "page": {"begin": 1, "end": 9}}}, "fullrecord_metadata": {"abstracts": {"abstract": {"abstract_text": {"p": ["One.", "Two."]}}}}},
        "dynamic_data": {"cluster_related": {"identifiers": {"identifier": [{"type": "doi", "value": "10.3/Q"}]}}, "citation_related": {"tc_list": {"silo_tc": [{"coll_id": "BCI", "local_count": 9}, {"coll_id": "WOS", "local_count": 4}]}}},
    }
    (x,) = parsed(spark, "web_of_science_expanded", {"Data": {"Records": {"records": {"REC": rec}}}})
    assert (x.title, x.journal, x.authors, x.abstract, x.doi, x.year, x.metadata["pages"], x.metadata["times_cited"]) == ("T", "J", ["Doe"], "One. Two.", "10.3/q", 2003, "1-9", "4")


@pytest.mark.parametrize("source", ["pubmed", *payloads.JSON])
def test_bodies_without_items(spark, source):
    assert parsed(spark, source, None, "", "{", "[]", "{}", "null", {"results": None}, {"message": 3}) == []


def service(request: live.Request) -> live.Answer:
    """Three services: one with pages, one that answers at the second attempt only, one that is down."""
    p = request.parameters
    if "openalex" in request.url:
        at = {"*": 0, "a": 2, "b": 4}[p["cursor"]]
        items = [{"id": f"W{i}", "title": f"Sleep {i}", "publication_year": 2000 + i} for i in range(at, min(at + p["per_page"], 5))]
        return live.Answer(200, json.dumps({"meta": {"count": 5, "next_cursor": {0: "a", 2: "b", 4: None}[at]}, "results": items}).encode())
    if "core.ac.uk" in request.url:
        items = [{"id": i, "title": f"Work {i}", "yearPublished": y} for i, y in enumerate([1990, None, 2005])]
        return live.Answer(200, json.dumps({"totalHits": 3, "results": items if p["offset"] == 0 else []}).encode())
    return live.Answer(503, b"", "0")


def test_run(spark):
    run = evidence.run(spark, L.Search("sleep AND work", 2000, 2010), ("openalex", "CORE", "crossref"), limit=4, page_size=2, options={"openalex": {"api_key": "hidden"}}, get=service, retry=live.Retry(2, 0.0, 0.0))
    assert [(r.idx, r.title) for r in run.records.orderBy("idx").collect()] == [(0, "Sleep 0"), (1, "Sleep 1"), (2, "Sleep 2"), (3, "Sleep 3"), (4, "Work 1"), (5, "Work 2")]
    rows = {r.source: r for r in run.account.collect()}
    assert (rows["openalex"].retrieved, rows["openalex"].total_available, rows["openalex"].truncated, rows["openalex"].pages) == (4, 5, True, 2)
    assert (rows["core"].retrieved, rows["core"].total_available, rows["core"].truncated) == (2, 3, False)
    assert rows["crossref"].error.startswith("SourceError") and [r.source for r in run.failures.collect()] == ["crossref"]
    assert "hidden" not in str(run.responses.select("parameters").collect())
    again = evidence.replay(spark, run.responses, run.search, ("openalex", "core"), 4)
    assert again.records.count() == 6
    with pytest.raises(live.SourceError):
        evidence.replay(spark, run.responses, run.search, ("openalex",), strict=True)
    text = reports.search_report(run, reports.Context(peer_review="By two librarians"))
    assert "sleep AND work" in text and "By two librarians" in text and "Crossref" not in text
    matrix = {r.item: r.status for r in reports.support_matrix(spark, run, reports.Context(peer_review="yes")).collect()}
    assert matrix[1] == "AUTOMATIC" and matrix[9] == "PARTIAL" and matrix[14] == "USER_SUPPLIED" and matrix[16] == "MISSING" and len(matrix) == 16


def test_requests():
    search = L.Search("a", 2001, 2002)
    text, run = live.steps("scopus", search, 30, options={"api_key": "k"})
    request, rank, take = next(run)
    assert (request.parameters["start"], take, rank) == (0, 25, 1) and request.headers["X-ELS-APIKey"] == "k"
    request, rank, take = run.send({"search-results": {"entry": [{}] * 25, "opensearch:totalResults": "99"}})
    assert (request.parameters["start"], take, rank) == (25, 5, 26)
    _, run = live.steps("pubmed", search, 3, 2)
    next(run)
    request, rank, take = run.send({"esearchresult": {"count": "12000", "webenv": "w", "querykey": "1"}})
    assert (request.parameters["retstart"], take, rank) == (0, 2, 1)
    request, rank, take = run.send("<PubmedArticle></PubmedArticle>" * 2)
    assert (request.parameters["retstart"], take) == (2, 1)
    _, run = live.steps("oql", L.Search(" OR ".join(f"word{i}" for i in range(900))), 10)
    assert next(run)[0].body["cursor"] == "*"
    with pytest.raises(live.SourceError):
        live.steps("wos", search)
    with pytest.raises(ValueError):
        registry.source_name("nowhere")


def test_retry():
    retry, waited = live.Retry(3, 1.0, 8.0), []
    assert retry.delay(1, "3") == 3 and retry.delay(3, None, lambda: 0.5) == 4 and retry.delay(9, "x", lambda: 0.5) == 8
    answers = iter([live.Answer(500, b""), OSError("gone"), live.Answer(200, b"x")])

    def get(_):
        a = next(answers)
        if isinstance(a, Exception):
            raise a
        return a

    assert live.asked(live.Request("u"), retry, get, waited.append) == (b"x", 3) and len(waited) == 2
    assert live.redacted({"api_key": 1, "myToken": 2, "q": 3}) == {"api_key": live.SECRET, "myToken": live.SECRET, "q": 3}


def test_files(tmp_path):
    content = b"title\nx\n"
    pages = {
        "https://api.osf.io/v2/nodes/n/files/osfstorage/": {"data": [{"attributes": {"kind": "folder", "name": "f"}, "relationships": {"files": {"links": {"related": {"href": "F"}}}}}], "links": {"next": "P2"}},
        "F": {"data": [{"attributes": {"kind": "file", "name": "a.csv", "size": len(content), "extra": {"hashes": {"sha256": hashlib.sha256(content).hexdigest()}}}, "links": {"download": "A"}}], "links": {}},
        "P2": {"data": [], "links": {}},
    }
    get = lambda r: live.Answer(200, content if r.url == "A" else json.dumps(pages[r.url]).encode())
    found = list(files.osf_files("n", get))
    assert [f.name for f in found] == ["a.csv"] and not files.differences(content, found[0])
    assert [x["fetched"] for x in files.download(found * 2, str(tmp_path), get=get)] == [True, False]
    with pytest.raises(ValueError):
        files.download([files.Remote("b.csv", "A", git_blob="0" * 40)], str(tmp_path), get=get)


def test_refusals_are_not_asked_again():
    asked = []

    def get(request):
        asked.append(request)
        return live.Answer(401, b"")

    with pytest.raises(live.SourceError, match="refused at attempt 1"):
        live.asked(live.Request("u"), live.Retry(4, 0.0, 0.0), get, lambda s: None)
    assert len(asked) == 1


def test_cache_and_archive(tmp_path):
    asked = []

    def get(request):
        asked.append(request.parameters)
        return live.Answer(200, b"body of " + request.url.encode()) if "bad" not in request.url else live.Answer(404, b"")

    cached, kept = live.Cached(get, str(tmp_path / "cache")), live.Archived(get, f"file://{tmp_path}/archive")
    for key in ("k1", "k2"):  # a secret is no part of a request's name
        assert cached(live.Request("u", {"q": 1, "api_key": key})).content == b"body of u"
    assert cached(live.Request("u", {"q": 2})).content == b"body of u" and len(asked) == 2
    assert cached(live.Request("bad")).status == 404 and cached(live.Request("bad")).status == 404 and len(asked) == 4
    for _ in range(2):
        kept(live.Request("v", {"token": "secret", "q": "x"}))
    digest = hashlib.sha256(b"body of v").hexdigest()
    assert {f.name for f in (tmp_path / "archive").iterdir()} == {digest + ".gz", digest + ".json"}
    about = json.loads((tmp_path / "archive" / (digest + ".json")).read_text())
    assert about["parameters"] == {"token": live.SECRET, "q": "x"} and about["bytes"] == 9


def test_a_live_search_resumes_at_its_page(spark, tmp_path):
    """Two runs of a stream over one service: the second takes up where the first stopped, from the cache."""
    get = live.Cached(service, str(tmp_path / "cache"))
    spark.dataSource.register(live.live_source(get, live.Retry(1, 0.0, 0.0), "evidra_pages"))
    out = str(tmp_path / "out")
    rows = spark.readStream.format("evidra_pages").options(sources="openalex", query="sleep", page_size="2", pages_a_batch="1").load()
    for pages in (1, 3):
        q = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "offsets")).start()
        for _ in range(600):
            found = spark.read.schema(rows.schema).parquet(out).count() if (tmp_path / "out" / "_spark_metadata").exists() else 0
            if found >= pages:
                break
            q.awaitTermination(1)
        q.stop()
    got = spark.read.parquet(out).orderBy("page").collect()
    assert [(r.page, r.first_rank) for r in got] == [(1, 1), (2, 3), (3, 5)] and all(r.error is None for r in got)

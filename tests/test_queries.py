"""The query language, its translations, and searching records."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evidra.plans import dialects as D
from evidra.plans import language as L
from evidra.plans import search

_leaf = st.one_of(st.sampled_from(["a", "b*", "c?d"]).map(L.Term), st.sampled_from(["x y", 'q"t', "b\\s"]).map(L.Phrase), st.just(L.Vocabulary("MeSH", "Heart")))
_trees = st.recursive(
    _leaf,
    lambda kids: st.one_of(
        st.builds(L.Not, kids), st.builds(L.Field, st.sampled_from(L.FIELDS), kids), st.builds(L.Near, kids, kids, st.integers(0, 9)),
        st.builds(lambda op, c: L.Boolean(op, tuple(c)), st.sampled_from(["AND", "OR"]), st.lists(kids, min_size=2, max_size=3)),
    ),
    max_leaves=8,
)


@settings(max_examples=300, deadline=None)
@given(_trees)
def test_rendering_parses_back(tree):
    assert L.parse(L.render(tree)) == tree


def test_precedence():
    assert L.parse("a OR b AND NOT c") == L.Boolean("OR", (L.Term("a"), L.Boolean("AND", (L.Term("b"), L.Not(L.Term("c"))))))
    assert L.parse("ti:a AND b") == L.Boolean("AND", (L.Field("title", L.Term("a")), L.Term("b")))


@pytest.mark.parametrize("bad", ["", "a b", "(a", "a AND", "foo:a", "a NOT b", "mesh:(a OR b)", "AND"])
def test_errors(bad):
    with pytest.raises(L.QueryError):
        L.parse(bad)


def test_dialects():
    of = lambda q, s, **k: D.translate(L.Search(q, **k), s)
    assert of("machine NEAR/5 learning", "scopus").text == "TITLE-ABS-KEY((machine W/5 learning))"
    assert of("machine NEAR/5 learning", "wos").text == "TS=((machine NEAR/5 learning))"
    assert of('"machine learning" NEAR/5 predict*', "oql").text == 'works where title/abstract has (within 5 ("machine learning", "predict*"))'
    assert of("a", "pubmed", year_from=2010).text == "(a) AND (2010:3000[dp])"
    assert of('mesh:"Heart"', "pubmed").text == '"Heart"[MeSH Terms]'
    assert of("a OR b", "crossref").requires_review and of("a OR b", "crossref").fidelity_score == 1.0
    assert of("a", "core", year_to=2000).requires_review
    with pytest.raises(ValueError):
        of("a", "nowhere")


def test_search(spark):
    rows = [(1, "Machine learning for sleep", ["Smith J"], 2020), (2, "Deep machines that are learning", ["Doe A"], None), (3, "Sleep", ["Smith J"], 1999)]
    df = spark.createDataFrame(rows, "idx long, title string, authors array<string>, year int")
    found = lambda q, **k: {r.idx for r in search.run(df, L.Search(q, **k)).collect()}
    assert found("machin*") == {1, 2} and found('"machine learning"') == {1} and found("machin* NEAR/2 learning") == {1, 2} and found("machin* NEAR/1 learning") == {1}
    assert found("sleep AND NOT author:smith") == set() and found("author:smith") == {1, 3}
    assert found("machin* OR sleep", year_from=2000) == {1, 2}

"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names: no operator fails on them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evidra.llm import op1_packing, op2_quality, op3_minhash, op4_mixing, op5_topk, op6_html, op7_line_dedup, op8_warc, op9_sharding, op10_quality_rules

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, length long, TEXT2 string, bucket int, key string, label long, rank int, piece int, host string"
LONG = " ".join(f"word{i % 977} of{i}" for i in range(60_000))
ROWS = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, " \t\n ", None, None),
    (4, "one two three four five six", "en", "a"),
    (4, "one two three four five six", "en", "a"),
    (5, "One  two three\nfour five six", "en", "b"),
    (6, LONG, "en", "a"),
    (7, LONG, "en", "c"),
    (8, LONG + " tail", "en", None),
    (None, "no id but a text of some words that is long enough to count", "en", "a"),
    (None, None, None, None),
    (9, "short", "en", "b"),
    (10, "ümläut ß 😀 ́ " * 30, "de", "b"),
    (11, "line number one is long enough to be compared\nline number one is long enough to be compareD\nother", "en", "b"),
]


def documents(spark, rows=ROWS):
    full = [(i, t, lang, s, len(t or ""), 5, "x", 1, "k", 2, 3, 4, "h") for i, t, lang, s in rows]
    return spark.createDataFrame(full, DOCUMENTS)


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "d") for i, u, h in rows], "page_id long, url string, html string, hit int, digest string")


PAGES = [
    (1, "http://a.example/x", "<article><p>Text &amp; more"),
    (2, None, None),
    (3, "http://a.example/y", ""),
    (4, "not a url\r\nX: y", "<div class='ad'>ad</div><p>" + "x" * 200),
    (5, "http://b.example", "<p>" + "x" * 200),
    (6, "http://c.example", "<p>" + "x" * 200),
    (6, "http://c.example", "<p>" + "x" * 200),
    (None, "http://d.example", "<p>" + "x" * 200),
    (7, "http://e.example", "WARC/1.0\r\n\r\n<p>" + "ü😀" * 50_000),
]

BY_DOCUMENT = {
    "op1": lambda s, d: op1_packing.pack(d),
    "op2": lambda s, d: op2_quality.classify(d, s.createDataFrame([(4, 1), (6, 0), (9, None), (None, 1), (77, 1)], "doc_id long, quality int")),
    "op3": lambda s, d: op3_minhash.deduplicate(d),
    "op3_keep": lambda s, d: op3_minhash.keep_one(d),
    "op4": lambda s, d: op4_mixing.plan_mix(d),
    "op4_mix": lambda s, d: op4_mixing.mix(d),
    "op7": lambda s, d: op7_line_dedup.deduplicate(d, counts=True),
    "op9": lambda s, d: op9_sharding.place(d),
    "op10": lambda s, d: op10_quality_rules.judge(d),
    "op10_filter": lambda s, d: op10_quality_rules.filter_documents(d),
}


@pytest.mark.parametrize("name", BY_DOCUMENT)
def test_documents(spark, name):
    got = BY_DOCUMENT[name](spark, documents(spark)).collect()
    assert got
    if name in ("op2", "op3", "op4", "op9", "op10"):
        assert len(got) == len(ROWS)
    assert BY_DOCUMENT[name](spark, documents(spark, [])).collect() == []
    CONTENTS.get(name, lambda rows: None)(got)


def _packed(rows):
    assert sorted((r.doc_id, r.length) for r in rows if r.doc_id in (1, 2)) == [(1, 1), (2, 1)] and sum(r.doc_id is None for r in rows) == 2
    assert sum(r.length for r in rows if r.doc_id == 6) == sum(r.length for r in rows if r.doc_id == 7)


def _scored(rows):
    empty = {r.score for r in rows if r.doc_id in (1, 2, 3)}
    assert len(empty) == 1 and len({r.score for r in rows if r.doc_id == 4}) == 1 and all(0 <= r.score <= 1 for r in rows)


def _grouped(rows):
    of = {r.doc_id: r for r in rows}
    assert [of[i].n_shingles for i in (1, 2, 3)] == [0, 0, 0] and of[7].component_id == of[8].component_id == 6 and of[5].component_id == 4
    assert sorted(r.kept for r in rows if r.doc_id == 4) == [False, True] and all(r.component_id is None for r in rows if r.doc_id is None)


def _mixed(rows):
    assert all(r.size == r.taken == 0 for r in rows if r.doc_id in (1, 2, 3)) and len({r.copies for r in rows if r.doc_id == 4}) == 1
    assert {r.source_size for r in rows if r.source is None} == {r.size for r in rows if r.doc_id == 8}


def _placed(rows):
    assert len({r.shard for r in rows if r.doc_id is None}) == 1 and len({r.shard for r in rows if r.doc_id == 4}) == 1 and all(r.shard for r in rows)


def _judged(rows):
    of = {r.doc_id: r for r in rows}
    assert all(of[i].base_failed and not of[i].kept for i in (1, 2, 3, 9)) and of[6].kept and of[8].kept and of[10].base_failed


def _kept_rows(rows):
    assert {r.doc_id for r in rows} == {6, 7, 8} and all(r.TEXT2 == "x" for r in rows)


def _lines_gone(rows):
    texts = {r.doc_id: r.text for r in rows}
    assert texts[1] is None and texts[2] == "" and texts[3] == " \t\n " and sum(r.doc_id == 4 for r in rows) == 1 and 7 not in texts


CONTENTS = {"op1": _packed, "op2": _scored, "op3": _grouped, "op4": _mixed, "op7": _lines_gone, "op9": _placed, "op10": _judged, "op10_filter": _kept_rows}


def _lines(repeated: int, of: int = 20) -> str:
    """A text of ``of`` lines, of which ``repeated`` repeat the first; clean otherwise."""
    return "\n".join(" ".join(f"word{i}" for i in range(9)) if k <= repeated else " ".join(f"other{k} say{i}" for i in range(9)) for k in range(of))


def _verdicts(spark, rows):
    got = {r.doc_id: r.kept for r in op10_quality_rules.judge(documents(spark, rows)).collect()}
    assert {r.doc_id for r in op10_quality_rules.filter_documents(documents(spark, rows)).collect()} == {i for i, k in got.items() if k}
    return got


def test_a_host_settles_which_limits_hold(spark):
    """One text each with few, some and many repeated lines on hosts of other habits, and clean ones everywhere."""
    clean = " ".join(f"word{i} and" for i in range(80))
    habits = {"trusted": 0, "usual": 15, "suspect": 40, "blocked": 65}  # of a hundred documents, so many with half of their lines repeated
    rows, at = [], 0
    for host, bad in habits.items():
        for k in range(100):
            rows.append((at, _lines(9) if k < bad else clean, "en", host))
            at += 1
    probes = {(host, n): at + i for i, (host, n) in enumerate((h, n) for h in habits for n in (0, 4, 8, 12))}
    got = _verdicts(spark, rows + [(i, _lines(n), "en", host) for (host, n), i in probes.items()])
    stays = {host: [n for n in (0, 4, 8, 12) if got[probes[host, n]]] for host in habits}
    assert stays == {"trusted": [0, 4, 8], "usual": [0, 4], "suspect": [0], "blocked": [0]}
    assert all(got[i] for i, text, _, _ in rows if text == clean)


def test_a_blocked_host_is_held_to_every_strict_limit(spark):
    clean = " ".join(f"word{i} and" for i in range(80))
    marked = clean + " #" * 11  # beyond the strict limit of symbols, within the usual one
    rows = [(i, "too short", "en", "bad") for i in range(300)] + [(1000 + i, clean, "en", "good") for i in range(300)]
    rows += [(5000, clean, "en", "bad"), (5001, marked, "en", "bad"), (5002, marked, "en", "good"), (5003, marked, "en", None), (5004, clean, "en", None)]
    got = _verdicts(spark, rows)
    assert [got[i] for i in range(5000, 5005)] == [True, False, True, True, True]


def test_small_hosts_have_the_verdicts_of_the_corpus(spark):
    """Where hosts of one document each fail as rarely as the corpus, one that fails is no habit of its host."""
    clean = " ".join(f"word{i} and" for i in range(80))
    rows = [(i, clean, "en", f"h{i}") for i in range(200)] + [(900, _lines(8), "en", "lone"), (901, _lines(12), "en", "other")]
    got = _verdicts(spark, rows)
    assert got[900] and not got[901] and all(got[i] for i in range(200))


@pytest.mark.parametrize("name", ["op1", "op3", "op7", "op10"])
def test_only_nulls(spark, name):
    BY_DOCUMENT[name](spark, documents(spark, [(None, None, None, None), (1, None, None, None)])).collect()


def test_pages(spark):
    for rows in (PAGES, []):
        got = op6_html.extract(pages(spark, rows)).collect()
        assert len(got) == len(rows)
        back = op8_warc.round_trip(pages(spark, rows)).collect()
        assert len(back) == len(rows)
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in back} if rows else set()
    assert not kinds
    back = op8_warc.round_trip(pages(spark, PAGES)).collect()
    assert {(r.page_id, r.record_type, r.refers_to) for r in back if r.page_id in (4, 5, 6, 7)} == {(4, "response", None), (5, "response", None), (6, "revisit", 5), (7, "response", None)}
    assert {r.payload_bytes for r in back if r.page_id == 6} == {203}
    assert {r.payload_bytes for r in back if r.page_id == 2} == {0}


def test_vectors(spark):
    rows = [(0, [0.5, 0.25]), (1, [0.5, -0.25]), (2, None), (3, [0.1, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0, 1.0, 1.0]), (7, [0.5, 0.25]), (7, [0.5, 0.25]), (50, [-1.0, 1.0]), (None, [1.0, 1.0])]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, lane int, least int")
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in op5_topk.top_k(frame).collect()}
    v = {0: (128, 64), 1: (128, -64), 50: (-256, 256), 7: (128, 64)}
    want = set()
    for q in (0, 50):
        cand = sorted((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in (0, 1, 7, 7, 50) if c != q)
        want |= {(q, i + 1, c, -s) for i, (s, c) in enumerate(cand[:5])}
    assert got == want
    assert op5_topk.top_k(frame.limit(0)).collect() == []


def test_pipeline_stages(spark):
    docs = documents(spark)
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        docs = out
    rows = docs.collect()
    assert rows and {r.doc_id for r in rows} <= {6, 8} and all(r.offset + r.length <= 2048 for r in rows)
    empty = documents(spark, []).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "")
    assert empty.count() == 0


def test_line_dedup_updates_length(spark):
    out = {r.doc_id: r for r in op7_line_dedup.deduplicate(documents(spark)).where(F.col("doc_id") == 11).collect()}
    assert out[11].text == "line number one is long enough to be compared\nother"
    assert out[11].n_chars == len(out[11].text)


def test_line_dedup_stage_removes_short_repeats(spark):
    stage = dict(corpus_pipeline.STAGES)["line dedup"]
    rows = [(1, "Released under the MIT License.\n\na\nfirst", "en", "a"), (2, " Released under the MIT License.\n\nsecond\na", "en", "a"), (3, "a\n a \n", "en", "a"), (4, "\n \n", "en", "a")]
    got = {r.doc_id: r.text for r in stage(spark, documents(spark, rows), "").collect()}
    assert got == {1: rows[0][1], 2: "\nsecond", 4: "\n \n"}


def _texts(frame):
    return sorted((repr(r.doc_id), r.text) for r in frame.collect())


@pytest.mark.parametrize("same", [None, 7])
def test_rows_that_share_an_id_are_documents_of_their_own(spark, same):
    clean, other = (" ".join(f"{w}{i}" for i in range(80)) for w in ("word", "other"))
    filtered = op10_quality_rules.filter_documents(documents(spark, [(same, clean, "en", "a"), (same, "short", "en", "a"), (9, other, "en", "a")]))
    assert _texts(filtered) == sorted([(repr(same), clean), ("9", other)])

    long = "a line that stands in two of the rows and is long enough"
    lines = [(same, f"the first row begins like this\n{long}", "en", "a"), (same, f"{long}\nthe second row ends like this", "en", "a"), (same, f"{long}", "en", "a")]
    assert _texts(op7_line_dedup.deduplicate(documents(spark, lines))) == sorted([(repr(same), lines[0][1]), (repr(same), "the second row ends like this")])

    copies = [(same, clean, "en", "a"), (same, clean, "en", "a"), (same, other, "en", "a"), (9, clean, "en", "a")]
    assert _texts(op3_minhash.keep_one(documents(spark, copies))) == sorted([(repr(same), clean), (repr(same), other)])


def test_components_of_rows_that_share_an_id(spark):
    clean, other = (" ".join(f"{w}{i}" for i in range(80)) for w in ("word", "other"))
    rows = [(4, clean, "en", "a"), (4, clean, "en", "a"), (4, other, "en", "a"), (9, other, "en", "a"), (None, clean, "en", "a"), (2, clean, "en", "a")]
    got = [(r.doc_id, r.component_id, r.kept) for r in op3_minhash.deduplicate(documents(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted([(2, 2, True), (4, 2, False), (4, 2, False), (4, 4, True), (9, 4, False), (None, None, True)], key=repr)


def test_one_of_equal_rows_with_one_id_is_kept(spark):
    text = " ".join(f"word{i}" for i in range(80))
    got = op3_minhash.deduplicate(documents(spark, [(4, text, "en", "a"), (4, text, "en", "a")])).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(4, 4, False), (4, 4, True)]

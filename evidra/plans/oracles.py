"""DuckDB SQL for the queries of ``catalogue``."""

from __future__ import annotations

from evidra.functions import numbers as N
from evidra.functions import text as T
from evidra.operators import metrics
from evidra.operators import screening as S
from evidra.operators import study

from . import catalogue, dialects
from .views import EVENTS_SQL, RECORDS_SQL, STUDIES_SQL

R, ST, EV = (f"WITH RECURSIVE {x.strip()}" for x in (RECORDS_SQL, STUDIES_SQL, EVENTS_SQL))


def fold(x: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents(replace(coalesce({x}, ''), 'ß', ''))), '[^a-z0-9]+', ' ', 'g'))"


def plain(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g'))"


def words(n: str) -> str:
    return f"list_filter(string_split({n}, ' '), lambda w: w <> '')"


def unstopped(x: str, stop: list[str]) -> str:
    return f"list_distinct(list_filter({x}, lambda s: NOT list_contains({stop!r}, s)))"


def substantive(x: str) -> str:
    return unstopped(f"list_filter({words(fold(x))}, lambda t: length(t) > 2 OR regexp_matches(t, '^[0-9]+$'))", T.PUBLICATION_STOP)


def study_words(x: str) -> str:
    return unstopped(f"list_filter({words(plain(x))}, lambda t: length(t) > 2)", T.STUDY_STOP)


def longest(w: str) -> str:
    return f"(list_transform([{w}], lambda v: CASE WHEN list_max(list_transform(v, lambda u: length(u))) > 1 THEN list_filter(v, lambda t: length(t) = list_max(list_transform(v, lambda u: length(u))))[1] ELSE v[1] END))[1]"


def jac(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN CAST(len(list_intersect({a}, {b})) AS DOUBLE) / len(list_distinct(list_concat({a}, {b}))) END"


def steps(d: str, levels: list[tuple[float, float]], op: str = "<=") -> str:
    return f"CASE WHEN {d} IS NULL THEN NULL " + " ".join(f"WHEN {d} {op} {b} THEN CAST({s} AS DOUBLE)" for b, s in levels) + " ELSE CAST(0 AS DOUBLE) END"


def text_list(x: str, sep: str = "|") -> str:
    return f"coalesce(array_to_string(list_sort({x}), '{sep}'), '')"


ORACLES: dict[str, str] = {
    "norm_text_fold": f"{R} SELECT idx, {fold('title')} AS norm FROM records",
    "norm_text_plain": f"{R} SELECT idx, {plain('title')} AS norm FROM records",
    "tokens_substantive": f"{R} SELECT idx, {text_list(substantive('title'))} AS words FROM records",
    "tokens_study": f"{R} SELECT idx, {text_list(study_words('title'))} AS words FROM records",
}

AUTHORS = f"list_distinct(list_filter(list_transform(authors, lambda a: {longest(words(fold('a')))}), lambda k: k IS NOT NULL))"
LEAD = longest(words(fold("authors[1]")))
FORM = "CASE WHEN contains(kind, 'preprint') THEN 'preprint' WHEN contains(kind, 'conference') THEN 'conference' WHEN contains(kind, 'journal') OR contains(kind, 'article') THEN 'journal_article' WHEN contains(kind, 'book') OR contains(kind, 'chapter') THEN 'book' END"
ROLE = """CASE WHEN contains(lower(title), 'systematic review') THEN 'REVIEW' WHEN contains(lower(title), 'protocol') THEN 'PROTOCOL' WHEN contains(lower(title), 'subgroup') THEN 'SUBGROUP_ANALYSIS'
  WHEN contains(lower(title), 'follow-up') THEN 'FOLLOW_UP' WHEN contains(lower(title), 'conference') THEN 'CONFERENCE_ABSTRACT' WHEN contains(lower(title), 'randomized controlled trial') THEN 'PRIMARY_RESULTS' ELSE 'OTHER' END"""
IDS = r"list_sort(list_distinct(list_concat(list_transform(regexp_extract_all(abstract, '\bNCT\s*[-:]?\s*(\d{8})\b', 1, 'i'), lambda v: 'NCT:' || upper(v)), list_transform(regexp_extract_all(abstract, '\bISRCTN\s*[-:]?\s*(\d{8})\b', 1, 'i'), lambda v: 'ISRCTN:' || upper(v)))))"
YEAR_SIM, YEAR_FIT = [(0, 1.0), (1, 0.75), (2, 0.25)], [(1, 1.0), (3, 0.8), (7, 0.55), (15, 0.25)]
SIZE_SIM = [(0.95, 1.0), (0.80, 0.8), (0.60, 0.5), (0.35, 0.2)]
PAIRS = ", ".join(f"('{a}', '{b}'), ('{b}', '{a}')" for a, b in N.COMPLEMENTARY)


ACRONYMS = (
    r"list_filter(list_distinct(list_concat(regexp_extract_all(title, '\(([A-Z][A-Z0-9-]{2,11})\)', 1), regexp_extract_all(title, '\b([A-Z][A-Z0-9-]{2,11})\s+(?:trial|study)\b', 1))), "
    f"lambda a: length(a) BETWEEN 3 AND 12 AND NOT list_contains({T.ACRONYM_STOP!r}, a))"
)


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN {a} > 0 AND {b} > 0 THEN CAST(least({a}, {b}) AS DOUBLE) / greatest({a}, {b}) END"


def overlap(a0: str, a1: str, b0: str, b1: str) -> str:
    return f"CASE WHEN greatest({a0}, {b0}) <= least({a1}, {b1}) THEN 1.0::DOUBLE WHEN greatest({b0} - {a1}, {a0} - {b1}) <= 1 THEN 0.6::DOUBLE WHEN greatest({b0} - {a1}, {a0} - {b1}) <= 3 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END"


ORACLES |= {
    "author_key": f"{R} SELECT idx, {LEAD} AS lead, {text_list(AUTHORS)} AS keys FROM records",
    "publication_form": f"{R} SELECT {FORM} AS form, count(*) AS records FROM records GROUP BY 1",
    "publication_role": f"{ST} SELECT idx, {ROLE} AS role FROM studies",
    "registry_ids": f"{ST} SELECT idx, array_to_string({IDS}, '|') AS ids FROM studies",
    "study_acronyms": f"""WITH t AS (SELECT c_custkey AS idx, 'The (' || upper(substr(md5(c_name), 1, 4)) || 'X) and ' || c_mktsegment || ' trial' AS title FROM customer)
      SELECT idx, {text_list(ACRONYMS)} AS acronyms FROM t""",
    "doi_normalise": f"""{R}, d AS (SELECT idx, lower(trim(['https://doi.org/', 'DOI:', ' http://doi.org/', 'https://dx.doi.org/', ''][idx % 5 + 1] || upper(doi))) AS v FROM records)
      SELECT idx, nullif(trim(regexp_replace(regexp_replace(regexp_replace(v, '^https://doi\\.org/', ''), '^http://doi\\.org/', ''), '^doi:', '')), '') AS doi FROM d""",
    "stable_record_id": rf"""{R} SELECT idx, coalesce('DOI:' || nullif(doi, ''), 'PMID:' || nullif(pmid, ''),
      'META:' || upper(substr(sha256(trim(regexp_replace(replace(lower(title), 'ß', 'ss'), '[^\p{{L}}\p{{M}}\p{{N}}_]+', ' ', 'g')) || '|' || coalesce(CAST(year AS VARCHAR), '') || '|' || trim(regexp_replace(replace(lower(authors[1]), 'ß', 'ss'), '[^\p{{L}}\p{{M}}\p{{N}}_]+', ' ', 'g'))), 1, 20))) AS record_id FROM records""",
    "family_id_hash": f"{ST} SELECT idx, 'STUDY-' || upper(substr(sha1('registry|' || array_to_string({IDS}, '|')), 1, 12)) AS study_id FROM studies",
    "year_similarity": f"{R} SELECT idx, {steps('abs(year - 2012)', YEAR_SIM)} AS similarity, {steps('abs(year - 2012)', YEAR_FIT)} AS compatibility FROM records",
    "sample_size_similarity": f"{ST} SELECT idx, CAST(size AS INTEGER) AS size, {steps('(' + ratio('size', '15') + ')', SIZE_SIM, '>=')} AS similarity FROM studies",
    "interval_overlap": f"{ST} SELECT idx, {overlap('y0', 'y1', '1993', '1994')} AS similarity FROM studies",
    "role_complementarity": f"WITH r AS (SELECT unnest({list(T.ROLES)!r}) AS role) SELECT a.role, b.role AS other, CASE WHEN a.role = b.role THEN 0.0::DOUBLE WHEN (a.role, b.role) IN ({PAIRS}) THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END AS value FROM r a, r b",
    "html_strip": r"""SELECT page_id, nullif(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', chr(39)), '&#39;', chr(39)), '&#x27;', chr(39)), '&nbsp;', ' '), '&ndash;', '–'), '&mdash;', '—'), '&hellip;', '…'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'),
      '[ \t\n\x0B\f\r]+', ' ', 'g')), '') AS text FROM pages""",
    "abstract_from_inverted_index": r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents)
      SELECT doc_id, array_to_string(w, ' ') AS abstract FROM w WHERE len(w) > 0""",
}


def holds(text: str, word: str) -> str:
    return f"contains(' ' || {plain(text)} || ' ', ' {word} ')"


_POS = "(list_transform([string_split({t}, ' ')], lambda w: len(list_filter(range(len(w)), lambda i: w[i + 1] = 'the' AND (list_contains(w[i + 2:i + 5], 'for') OR list_contains(w[greatest(1, i - 3):i], 'for')))) > 0))[1]"
ORACLES |= {
    "search_boolean": f"{R} SELECT idx FROM records WHERE {holds('title', 'the')} AND ({holds('title', 'of')} OR {holds('title', 'er')})",
    "search_phrase": f"{R} SELECT idx FROM records WHERE {holds('abstract', 'the and')}",
    "search_not": f"{R} SELECT idx FROM records WHERE {holds('title', 'the')} AND NOT {holds('title', 'of')}",
    "search_wildcard": f"{R} SELECT idx FROM records WHERE regexp_matches(' ' || {plain('title')} || ' ', ' th[a-z0-9]*tion[a-z0-9]* ')",
    "search_proximity": f"{R} SELECT idx FROM records WHERE {_POS.format(t=plain('abstract'))}",
    "search_field_scope": f"{R} SELECT idx FROM records WHERE {holds('title', 'the')}",
    "search_year_range_null_kept": f"{R} SELECT idx FROM records WHERE ({holds('title', 'the')} OR {holds('abstract', 'the')}) AND (year IS NULL OR year BETWEEN 2005 AND 2010)",
}
_DIAGNOSTICS = ", ".join(f"('{name}', '{source}', '{d.feature}', {dialects.SCORES[d.status]}::DOUBLE, {str(d.status in (dialects.REVIEW, dialects.UNSUPPORTED)).lower()})" for name, s in catalogue.SEARCHES.items() for source in dialects.SOURCES for d in dialects.translate(s, source).diagnostics)
_FIDELITY = f"WITH d(query, source, feature, score, review) AS (VALUES {_DIAGNOSTICS}), f AS (SELECT query, source, round(coalesce(avg(score) FILTER (feature <> 'boolean'), avg(score)), 4) AS fidelity, bool_or(review) AS requires_review FROM d GROUP BY query, source)"
ORACLES |= {
    "translation_fidelity": f"{_FIDELITY} SELECT query, source, fidelity, round(1 - fidelity, 4) AS loss FROM f",
    "translation_requires_review": f"{_FIDELITY} SELECT query, source, requires_review FROM f",
    "multi_source_union": "SELECT source, count(*) AS hits, count(DISTINCT source_id) AS ids FROM (SELECT l_returnflag AS source, l_orderkey || '-' || l_linenumber AS source_id FROM lineitem UNION ALL SELECT o_orderstatus, CAST(o_orderkey AS VARCHAR) FROM orders) GROUP BY source",
    "source_counts": f"{R} SELECT source, count(*) AS records FROM records GROUP BY source",
    "hit_rank": "SELECT o_orderpriority AS source, o_orderkey AS source_id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS rank FROM orders",
}

def _parsed(name: str, source_id: str, title: str, **other: str) -> str:
    """The records that a service's bodies hold, straight from the documents."""
    c = {"authors": "array_to_string(authors, '|')", "year": "year", "doi": "doi", "pmid": "CAST(NULL AS VARCHAR)", "kind": "kind"} | other
    return f"{R} SELECT {source_id} AS source_id, coalesce(nullif({title}, ''), '[Untitled {name} record]') AS title, {c['authors']} AS authors, {c['year']} AS year, source AS journal, {c['doi']} AS doi, {c['pmid']} AS pmid, {c['kind']} AS kind FROM records"


ORACLES |= {
    "openalex_records": _parsed("OpenAlex", "'W' || idx", "trim(title)", pmid="pmid"),
    "crossref_records": _parsed("Crossref", "coalesce(doi, 'x' || idx)", "trim(title)", doi="coalesce(doi, 'x' || idx)"),
    "pubmed_records": _parsed("PubMed", "CAST(idx AS VARCHAR)", r"trim(regexp_replace(title, '\s+', ' ', 'g'))", pmid="CAST(idx AS VARCHAR)", kind="CAST(NULL AS VARCHAR)"),
}

PREPARED = f"""{R}, p AS (
  SELECT idx, doi, pmid, year, {fold('title')} AS title, {substantive('title')} AS words, {AUTHORS} AS akeys, {LEAD} AS lead, {fold('journal')} AS journal, {FORM} AS form, {fold('volume')} AS volume, {fold('pages')} AS pages,
    4.0::DOUBLE * (doi IS NOT NULL)::INT + 2.0::DOUBLE * (abstract <> '')::INT + 2 * 0.3::DOUBLE + 1.0::DOUBLE * (journal <> '')::INT + 0.8::DOUBLE * (year IS NOT NULL)::INT + ((doi IS NOT NULL)::INT + (pmid IS NOT NULL)::INT) * 0.5::DOUBLE + 0.25::DOUBLE + least(length(records.title), 200) / 200.0::DOUBLE AS quality,
    records.journal AS raw_journal, abstract FROM records
), sig AS (SELECT *, CASE WHEN len(words) > 0 THEN array_to_string(list_sort(words)[1:4], '|') END AS sign FROM p
), k AS (
  SELECT idx, unnest(list_filter(list_concat(
    ['doi:' || doi, 'pmid:' || lower(pmid), 'title_exact:' || nullif(title, ''), CASE WHEN year IS NULL THEN 'title_sig:' || sign END, 'jvp:' || nullif(journal, '') || ':' || volume || ':' || pages],
    list_transform([-1, 0, 1], lambda d: 'title_sig_year:' || sign || ':' || CAST(year + d AS VARCHAR)), list_transform([-1, 0, 1], lambda d: 'author_year:' || lead || ':' || CAST(year + d AS VARCHAR))), lambda x: x IS NOT NULL)) AS block_key FROM sig
), b AS (SELECT block_key, count(DISTINCT idx) AS members FROM k GROUP BY block_key
), h AS (SELECT DISTINCT k.block_key, idx FROM k JOIN b ON b.block_key = k.block_key AND members BETWEEN 2 AND 500
), c AS (SELECT DISTINCT x.idx AS left_index, y.idx AS right_index FROM h x JOIN h y ON x.block_key = y.block_key AND x.idx < y.idx)"""
_SAME = "CASE WHEN a.{0} <> '' AND b.{0} <> '' AND a.{0} = b.{0} THEN 1.0::DOUBLE END"
_EXACT = "CASE WHEN a.{0} <> '' AND b.{0} <> '' THEN (a.{0} = b.{0})::INT::DOUBLE END"
EDGES = f"""{PREPARED}, f AS (
  SELECT left_index, right_index, coalesce(a.doi = b.doi, false)::INT::DOUBLE AS doi_exact, coalesce(a.doi <> b.doi, false)::INT::DOUBLE AS doi_conflict, coalesce(a.pmid = b.pmid, false)::INT::DOUBLE AS id_exact, coalesce(a.pmid <> b.pmid, false)::INT::DOUBLE AS id_conflict,
    coalesce(a.form <> b.form, false)::INT::DOUBLE AS form_conflict, {_SAME.format('title')} AS ts, {jac('a.words', 'b.words')} AS tj, {jac('a.akeys', 'b.akeys')} AS au, {steps('abs(a.year - b.year)', YEAR_SIM)} AS ys, {_SAME.format('journal')} AS js, {_EXACT.format('volume')} AS vo, {_EXACT.format('pages')} AS pg,
    a.title <> '' AND a.title = b.title AS same_title
  FROM c JOIN p a ON a.idx = left_index JOIN p b ON b.idx = right_index
), l AS (
  SELECT *, -7.5 + 10 * doi_exact + -10 * doi_conflict + 8 * id_exact + -5 * id_conflict + -4 * form_conflict + coalesce(4.8 * ts, 0) + coalesce(2.2 * tj, 0) + coalesce(2.0 * au, 0) + coalesce(1.2 * ys, 0) + coalesce(1.0 * js, 0) + coalesce(0.45 * vo, 0) + coalesce(0.55 * pg, 0) AS z FROM f
), p0 AS (SELECT *, 1 / (1 + exp(-z)) AS q0, coalesce(au >= 0.5, false) AS a_ok, coalesce(js >= 0.95, false) AS j_ok, coalesce(ys >= 0.75, true) AS y_ok FROM l
), p1 AS (SELECT *, CASE WHEN doi_exact = 1 THEN greatest(q0, 0.99999) WHEN id_exact = 1 THEN greatest(q0, 0.9995) ELSE q0 END AS q1 FROM p0
), p2 AS (SELECT *, CASE WHEN doi_conflict = 1 THEN least(q1, 0.10) WHEN id_conflict = 1 AND doi_exact = 0 THEN least(q1, 0.55) ELSE q1 END AS q2 FROM p1
), p3 AS (SELECT *, CASE WHEN form_conflict = 1 AND doi_exact = 0 AND id_exact = 0 THEN least(q2, 0.45) ELSE q2 END AS q3 FROM p2
), p4 AS (SELECT *, CASE WHEN doi_conflict = 0 AND id_conflict = 0 AND form_conflict = 0 AND coalesce(ts, 0) >= 0.94 AND a_ok AND y_ok THEN greatest(q3, 0.990) ELSE q3 END AS q4 FROM p3
), p5 AS (SELECT *, CASE WHEN same_title AND doi_conflict = 0 AND form_conflict = 0 AND (a_ok OR j_ok) AND y_ok THEN greatest(q4, 0.995) ELSE q4 END AS q5 FROM p4
), p6 AS (SELECT *, CASE WHEN doi_exact = 1 THEN greatest(q5, 0.99999) WHEN id_exact = 1 THEN greatest(q5, 0.9995) ELSE q5 END AS q6 FROM p5
), p7 AS (SELECT *, CASE WHEN doi_conflict = 1 THEN least(q6, 0.10) ELSE q6 END AS q7 FROM p6
), e AS (SELECT *, CASE WHEN form_conflict = 1 AND doi_exact = 0 AND id_exact = 0 THEN least(q7, 0.45) ELSE q7 END AS probability FROM p7
), g AS (SELECT *, CASE WHEN probability >= 0.985 AND doi_conflict = 0 AND form_conflict = 0 THEN 'AUTO_MERGE' WHEN probability >= 0.75 THEN 'REVIEW' ELSE 'KEEP_SEPARATE' END AS decision FROM e)"""
CLUSTERS = f"""{EDGES}, u AS (SELECT left_index AS a, right_index AS b FROM g WHERE decision = 'AUTO_MERGE' UNION SELECT right_index, left_index FROM g WHERE decision = 'AUTO_MERGE'
), reach(a, b) AS (SELECT a, a FROM u UNION SELECT reach.a, u.b FROM reach JOIN u ON u.a = reach.b
), cc AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a
), m AS (SELECT p.*, coalesce(component, idx) AS cluster_id FROM p LEFT JOIN cc ON node = idx
), rep AS (SELECT *, first_value(idx) OVER (PARTITION BY cluster_id ORDER BY quality DESC, idx) AS representative_index, count(*) OVER (PARTITION BY cluster_id) AS cluster_size FROM m)"""
_ORD = "ORDER BY CASE WHEN idx = representative_index THEN -1 ELSE idx END"
ORACLES |= {
    "block_keys": f"{PREPARED} SELECT split_part(block_key, ':', 1) AS family, count(*) AS keys, count(DISTINCT block_key) AS blocks FROM (SELECT DISTINCT idx, block_key FROM k) GROUP BY 1",
    "block_sizes_capped": f"{PREPARED} SELECT block_key, members, members > 500 AS dropped FROM b WHERE members > 1",
    "candidate_pairs_blocked": f"{PREPARED} SELECT left_index, right_index FROM c",
    "candidate_pairs_exhaustive": "SELECT a.s_suppkey AS left_index, b.s_suppkey AS right_index FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey",
    "candidate_pairs_uncapped": f"{PREPARED}, u AS (SELECT DISTINCT idx, block_key FROM k) SELECT DISTINCT x.idx AS left_index, y.idx AS right_index FROM u x JOIN u y ON x.block_key = y.block_key AND x.idx < y.idx",
    "candidate_pairs_chosen": f"{PREPARED}, n AS (SELECT count(*) <= 2000 AS small FROM p) SELECT left_index, right_index FROM c, n WHERE NOT small UNION ALL SELECT a.idx, b.idx FROM n, p a JOIN p b ON a.idx < b.idx WHERE small",
    "author_year_band_pairs": f"""{ST}, k AS (SELECT idx, unnest(list_transform([-1, 0, 1], lambda d: author || ':' || CAST(CAST(floor(year / 5) AS BIGINT) + d AS VARCHAR))) AS block_key FROM studies
      ), h AS (SELECT k.* FROM k JOIN (SELECT block_key FROM k GROUP BY 1 HAVING count(*) BETWEEN 2 AND 500) USING (block_key)) SELECT DISTINCT x.idx AS left_index, y.idx AS right_index FROM h x JOIN h y ON x.block_key = y.block_key AND x.idx < y.idx""",
    "title_jaccard_pairs": f"{EDGES} SELECT left_index, right_index, round(tj, 9) AS jaccard FROM g",
    "dedup_score_native": f"{EDGES} SELECT left_index, right_index, round(probability, 9) AS probability FROM g",
    "dedup_decisions_native": f"{EDGES} SELECT decision, count(*) AS pairs FROM g GROUP BY decision",
    "explain_topk_native": f"""{EDGES}, t AS (SELECT left_index, right_index, list_filter([{{'v': 10 * doi_exact, 'i': 0, 'n': 'doi_exact'}}, {{'v': -10 * doi_conflict, 'i': 1, 'n': 'doi_conflict'}}, {{'v': 8 * id_exact, 'i': 2, 'n': 'strong_id_exact'}}, {{'v': -5 * id_conflict, 'i': 3, 'n': 'strong_id_conflict'}}, {{'v': -4 * form_conflict, 'i': 4, 'n': 'publication_form_conflict'}},
      {{'v': 4.8 * ts, 'i': 5, 'n': 'title_similarity'}}, {{'v': 2.2 * tj, 'i': 6, 'n': 'title_token_jaccard'}}, {{'v': 2.0 * au, 'i': 7, 'n': 'author_similarity'}}, {{'v': 1.2 * ys, 'i': 8, 'n': 'year_similarity'}}, {{'v': 1.0 * js, 'i': 9, 'n': 'journal_similarity'}}, {{'v': 0.45 * vo, 'i': 10, 'n': 'volume_exact'}}, {{'v': 0.55 * pg, 'i': 11, 'n': 'pages_exact'}}], lambda x: x.v <> 0) AS c FROM g)
      SELECT left_index, right_index, (list_sort(list_transform(c, lambda x: {{'v': -abs(x.v), 'i': x.i, 'n': x.n}}))[1]).n AS first FROM t""",
    "connected_components_publications_native": f"{CLUSTERS} SELECT node, component FROM cc",
    "representative_native": f"{CLUSTERS} SELECT idx, cluster_id, representative_index, cluster_size FROM rep",
    "merge_records_native": f"""{CLUSTERS} SELECT first(representative_index) AS idx, first(doi {_ORD}) FILTER (doi IS NOT NULL) AS doi, first(pmid {_ORD}) FILTER (pmid IS NOT NULL) AS pmid, first(year {_ORD}) FILTER (year IS NOT NULL) AS year, first(raw_journal {_ORD}) AS journal, count(*) AS hits, string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx) AS members FROM rep GROUP BY cluster_id""",
    "merge_conflicts_native": f"""{CLUSTERS}, d AS (SELECT cluster_id, unnest(['doi', 'pmid', 'abstract', 'journal', 'year', 'authors']) AS field, unnest([count(DISTINCT rep.doi), count(DISTINCT rep.pmid), count(DISTINCT nullif(rep.abstract, '')), count(DISTINCT rep.raw_journal), count(DISTINCT rep.year), count(DISTINCT records.authors)]) AS n FROM rep JOIN records ON records.idx = rep.idx GROUP BY cluster_id)
      SELECT field, count(*) AS clusters FROM d WHERE n > 1 GROUP BY field""",
    "dedup_links_native": f"""{CLUSTERS}, mg AS (SELECT *, CASE WHEN doi_exact = 1 THEN 'doi_exact' WHEN id_exact = 1 THEN 'pmid_exact' WHEN same_title THEN 'title_exact_guarded' WHEN coalesce(ts, 0) >= 0.9 THEN 'title_fuzzy_confidence' ELSE 'confidence_auto_merge' END AS rule FROM g WHERE decision = 'AUTO_MERGE'
      ), t AS (SELECT unnest([left_index, right_index]) AS node, * FROM mg), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY probability DESC, left_index, right_index) AS rn FROM t) WHERE rn = 1)
      SELECT representative_index AS kept_index, idx AS removed_index, coalesce(d.rule, best.rule, 'transitive_auto_merge') AS rule FROM rep LEFT JOIN mg d ON d.left_index = least(idx, representative_index) AND d.right_index = greatest(idx, representative_index) LEFT JOIN best ON best.node = idx WHERE idx <> representative_index""",
    "dedup_stats_native": f"{CLUSTERS} SELECT (SELECT count(*) FROM g) AS assessed_pairs, (SELECT count(*) FROM g WHERE decision = 'AUTO_MERGE') AS auto_merge_pairs, (SELECT count(*) FROM g WHERE decision = 'REVIEW') AS review_pairs, (SELECT count(*) FROM rep) AS input_records, (SELECT count(DISTINCT cluster_id) FROM rep) AS output_records",
    "blocking_recall": f"""{PREPARED}, gold AS (SELECT a.idx AS l, b.idx AS r FROM p a JOIN p b ON a.doi = b.doi AND a.idx < b.idx), n AS (SELECT count(*) AS positives, count(*) FILTER (EXISTS (SELECT 1 FROM c WHERE left_index = l AND right_index = r)) AS covered FROM gold), x AS (SELECT count(*) AS candidates FROM c), t AS (SELECT count(*) AS n FROM p)
      SELECT positives, covered, candidates, round(CASE WHEN positives > 0 THEN covered / CAST(positives AS DOUBLE) ELSE 1 END, 9) AS recall, round(1 - candidates / (t.n * (t.n - 1) / 2.0::DOUBLE), 9) AS pair_reduction FROM n, x, t""",
}

_SF = f"""{ST}, sp AS (SELECT *, {IDS} AS ids, {ROLE} AS role, {study_words('title')} AS words, {study_words('country')} AS cw, {study_words('intervention')} AS iw FROM studies
), sk AS (SELECT idx, unnest(list_distinct(list_concat(list_transform(ids, lambda r: 'registry:' || r), list_transform([-1, 0, 1], lambda d: 'author:' || author || ':' || CAST(CAST(floor(year / 5) AS BIGINT) + d AS VARCHAR)), list_transform(list_sort(words)[1:3], lambda w: 'title:' || w)))) AS block_key FROM sp
), sh AS (SELECT sk.* FROM sk JOIN (SELECT block_key FROM sk GROUP BY 1 HAVING count(DISTINCT idx) BETWEEN 2 AND 500) USING (block_key)
), sc AS (SELECT DISTINCT x.idx AS left_index, y.idx AS right_index FROM sh x JOIN sh y ON x.block_key = y.block_key AND x.idx < y.idx
), sf AS (SELECT left_index, right_index, len(list_intersect(a.ids, b.ids)) > 0 AS shared, (len(a.ids) > 1 OR len(b.ids) > 1) AND a.ids <> b.ids AS vague0, a.role = 'REVIEW' OR b.role = 'REVIEW' AS review,
    {jac('a.words', 'b.words')} AS tw, CASE WHEN a.author = b.author THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS au, {steps('abs(a.year - b.year)', YEAR_FIT)} AS yc, {steps('(' + ratio('a.size', 'b.size') + ')', SIZE_SIM, '>=')} AS ss, {jac('a.cw', 'b.cw')} AS co, {jac('a.iw', 'b.iw')} AS iv, {overlap('a.y0', 'a.y1', 'b.y0', 'b.y1')} AS re,
    CASE WHEN a.role = b.role THEN 0.0::DOUBLE WHEN (a.role, b.role) IN ({PAIRS}) THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END AS rc FROM sc JOIN sp a ON a.idx = left_index JOIN sp b ON b.idx = right_index
), s0 AS (SELECT *, shared AND vague0 AS vague, NOT shared AS clash, -5.8 + 10 * shared::INT + -6 * (NOT shared)::INT + -2.5 * (shared AND vague0)::INT + coalesce(1.4 * tw, 0) + coalesce(2.0 * au, 0) + coalesce(0.7 * yc, 0) + coalesce(0.9 * ss, 0) + coalesce(0.7 * co, 0) + coalesce(1.1 * iv, 0) + coalesce(1.4 * re, 0) + 0.5 * rc + -7 * review::INT AS z FROM sf
), s1 AS (SELECT *, CASE WHEN z >= 0 THEN 1 / (1 + exp(-z)) ELSE exp(z) / (1 + exp(z)) END AS q FROM s0
), s2 AS (SELECT *, CASE WHEN shared THEN greatest(q, 0.998) ELSE q END AS q2 FROM s1
), s3 AS (SELECT *, CASE WHEN vague THEN least(q2, 0.90) ELSE q2 END AS q3 FROM s2
), s4 AS (SELECT *, CASE WHEN review THEN least(q3, 0.60) ELSE q3 END AS q4 FROM s3
), s5 AS (SELECT *, CASE WHEN clash THEN least(q4, 0.74) ELSE q4 END AS q5 FROM s4
), s6 AS (SELECT *, CASE WHEN shared AND NOT vague AND NOT review THEN greatest(q5, 0.998) ELSE q5 END AS q6 FROM s5
), sd AS (SELECT *, CASE WHEN q6 >= 0.95 AND NOT clash AND NOT vague THEN 'SAME_STUDY' WHEN q6 >= 0.65 THEN 'REVIEW' ELSE 'DIFFERENT_STUDY' END AS decision FROM s6)"""
ORACLES |= {
    "study_score": f"{_SF} SELECT left_index, right_index, round(q6, 9) AS probability FROM sd",
    "study_decisions": f"{_SF} SELECT decision, count(*) AS pairs FROM sd GROUP BY decision",
}

_NOW = f"""{EV}, latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id, stage, reviewer ORDER BY seq DESC) AS rn FROM ledger WHERE NOT adjudication) WHERE rn = 1
), rv AS (SELECT record_id, stage, max(seq) AS reviewed, count(DISTINCT decision) AS views, arg_max(decision, seq) AS decision, arg_max(coalesce(reason_code, '-'), seq) AS code, string_agg(reviewer || '=' || decision, '|' ORDER BY reviewer) AS decisions FROM latest GROUP BY 1, 2
), ad AS (SELECT record_id, stage, max(seq) AS adjudicated, arg_max(decision, seq) AS decision, arg_max(coalesce(reason_code, '-'), seq) AS code FROM ledger WHERE adjudication GROUP BY 1, 2
), st AS (SELECT coalesce(rv.record_id, ad.record_id) AS record_id, coalesce(rv.stage, ad.stage) AS stage, coalesce(adjudicated > coalesce(reviewed, -1), false) AS ruled, views, rv.decision AS rd, ad.decision AS adec, rv.code AS rcode, ad.code AS acode, decisions FROM rv FULL JOIN ad ON rv.record_id = ad.record_id AND rv.stage = ad.stage
), fin AS (SELECT *, CASE WHEN ruled THEN adec WHEN views = 1 THEN rd ELSE 'NOT_SCREENED' END AS decision, CASE WHEN ruled THEN acode WHEN views = 1 THEN rcode END AS code, NOT ruled AND views > 1 AS conflict FROM st)"""
_CAT = f"(SELECT unnest({list(S.STAGES)!r}) AS stage) CROSS JOIN (SELECT unnest({list(S.DECISIONS)!r}) AS decision)"
_FATE = f"""{_NOW}, fate AS (SELECT record_id, coalesce(bool_or(stage = 'TITLE_ABSTRACT'), false) AS screened, coalesce(bool_or(stage = 'TITLE_ABSTRACT' AND decision = 'EXCLUDE'), false) AS excluded, coalesce(bool_or(stage = 'FULL_TEXT'), false) AS sought,
  coalesce(bool_or(stage = 'FULL_TEXT' AND decision = 'EXCLUDE' AND code = 'NOT_RETRIEVABLE'), false) AS missing, coalesce(bool_or(stage = 'FULL_TEXT' AND decision = 'INCLUDE'), false) AS inc, max(CASE WHEN stage = 'FULL_TEXT' AND decision = 'EXCLUDE' THEN CASE WHEN code = '-' THEN 'OTHER' ELSE code END END) AS reason FROM fin GROUP BY record_id)"""
_REASONS = "SELECT reason, count(*) AS reports FROM fate WHERE sought AND NOT missing AND reason IS NOT NULL GROUP BY reason"
_FLOW = f"""{_FATE}, sc AS (SELECT count(*) FILTER (screened) AS records_screened, count(*) FILTER (excluded) AS records_excluded, count(*) FILTER (sought) AS reports_sought_for_retrieval, count(*) FILTER (missing) AS reports_not_retrieved, count(*) FILTER (sought AND NOT missing) AS reports_assessed_for_eligibility, count(*) FILTER (sought AND NOT missing AND inc) AS reports_included FROM fate
), flow AS (SELECT 'database' AS category, upper(source[1]) || source[2:] AS label, count(*) AS count FROM documents GROUP BY source UNION ALL SELECT 'removed', 'duplicates_removed', count(*) - count(DISTINCT text) FROM documents
  UNION ALL SELECT 'stage', label, n FROM (UNPIVOT sc ON COLUMNS(*) INTO NAME label VALUE n) UNION ALL SELECT 'reason', reason, reports FROM ({_REASONS}))"""
ORACLES |= {
    "screen_latest": f"{_NOW} SELECT record_id, stage, reviewer, decision, seq FROM latest",
    "screen_final": f"{_NOW} SELECT record_id, stage, decision FROM fin",
    "screen_final_stream": f"{_NOW} SELECT record_id, stage, decision FROM fin",
    "screen_conflicts": f"{_NOW} SELECT record_id, stage, decisions FROM fin WHERE conflict",
    "screen_counts": f"{_NOW} SELECT g.stage, g.decision, count(fin.record_id) AS records FROM ({_CAT}) g LEFT JOIN fin ON fin.stage = g.stage AND fin.decision = g.decision GROUP BY 1, 2".replace(f"({_CAT}) g", f"(SELECT * FROM {_CAT}) g"),
    "screen_kappa": f"""{_NOW}, pr AS (SELECT a.stage, a.reviewer AS reviewer_a, b.reviewer AS reviewer_b, a.decision AS da, b.decision AS db FROM latest a JOIN latest b ON a.record_id = b.record_id AND a.stage = b.stage AND a.reviewer < b.reviewer
      ), n AS (SELECT stage, reviewer_a, reviewer_b, count(*) AS n, count(*) FILTER (da = db) AS agreements, {' + '.join(f"(count(*) FILTER (da = '{d}') / CAST(count(*) AS DOUBLE)) * (count(*) FILTER (db = '{d}') / CAST(count(*) AS DOUBLE))" for d in S.DECISIONS)} AS expected FROM pr GROUP BY 1, 2, 3)
      SELECT stage, reviewer_a, reviewer_b, n AS n_double_screened, agreements, round((agreements / CAST(n AS DOUBLE) - expected) / (1 - expected), 9) AS kappa FROM n""",
    "screen_rejects": f"""{EV} SELECT seq, 'full-text exclusion without a reason' AS problems FROM ledger WHERE stage = 'FULL_TEXT' AND decision = 'EXCLUDE' AND seq % 7 = 0
      UNION ALL SELECT seq, 'unknown reason' FROM ledger WHERE FALSE""",
    "asreview_labels": f"""{_NOW}, x AS (SELECT record_id, max(decision) FILTER (stage = 'FULL_TEXT' AND decision <> 'NOT_SCREENED') AS f, max(decision) FILTER (stage = 'TITLE_ABSTRACT' AND decision <> 'NOT_SCREENED') AS t FROM fin GROUP BY 1) SELECT record_id, CASE coalesce(f, t) WHEN 'INCLUDE' THEN 1 WHEN 'EXCLUDE' THEN 0 END AS label FROM x""",
    "prisma_flow": f"{_FLOW} SELECT category, label, count FROM flow",
    "prisma_exclusion_reasons": f"{_FATE} {_REASONS}",
}

_G = "WITH g AS (SELECT d.doc_id, quality = 1 AS gold, source AS dataset, n_chars / (n_chars + 400.0::DOUBLE) AS p FROM documents d JOIN labels USING (doc_id))"


def cm(pred: str, gold: str) -> str:
    return f"count(*) FILTER (({pred}) AND {gold}) AS tp, count(*) FILTER (NOT ({pred}) AND NOT {gold}) AS tn, count(*) FILTER (({pred}) AND NOT {gold}) AS fp, count(*) FILTER (NOT ({pred}) AND {gold}) AS fn"


def div(a: str, b: str, empty: float) -> str:
    return f"CASE WHEN {b} <> 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE {empty}::DOUBLE END"


_F1 = div("2 * tp", "2 * tp + fp + fn", 0.0)
_PART = "WITH d AS (SELECT doc_id AS idx, md5(text) AS gold_group, md5(split_part(text, '.', 1)) AS predicted FROM documents)"
_REM = f"{_PART}, r0 AS (SELECT *, row_number() OVER (PARTITION BY gold_group ORDER BY idx DESC) > 1 AS gold_removed FROM d), r AS (SELECT *, row_number() OVER (PARTITION BY predicted ORDER BY idx) > 1 AS blind, row_number() OVER (PARTITION BY predicted ORDER BY gold_removed, idx) > 1 AS pref FROM r0)"
_Z = 1.959963984540054
_SENS = div("tp", "tp + fn", 1.0)


def wilson(k: str, n: str, sign: str) -> str:
    p = f"(CAST({k} AS DOUBLE) / ({n}))"
    zz = f"{_Z * _Z!r}::DOUBLE"
    mid = f"({p} + {zz} / (2 * ({n}))) / (1 + {zz} / ({n}))"
    half = f"{_Z!r}::DOUBLE * sqrt({p} * (1 - {p}) / ({n}) + {zz} / (4 * ({n}) * ({n}))) / (1 + {zz} / ({n}))"
    bound = f"greatest({mid} - {half}, 0)" if sign == "-" else f"least({mid} + {half}, 1)"
    return f"CASE WHEN ({n}) > 0 THEN round({bound}, 9) ELSE 'nan'::DOUBLE END"


ORACLES |= {
    "pair_confusion": f"{_G}, c AS (SELECT {cm('p >= 0.7', 'gold')} FROM g) SELECT *, round({div('tp', 'tp + fn', 0.0)}, 9) AS sensitivity, round({div('tn', 'tn + fp', 0.0)}, 9) AS specificity, round({div('tp', 'tp + fp', 0.0)}, 9) AS precision, round({_F1}, 9) AS f1, round({div('tp + tn', 'tp + tn + fp + fn', 0.0)}, 9) AS accuracy FROM c",
    "brier": f"{_G} SELECT round(avg(pow(p - gold::INT, 2)), 9) AS brier FROM g",
    "ece_bins": f"{_G} SELECT CASE {' '.join(f'WHEN p >= {k / 10!r}::DOUBLE THEN {k}' for k in range(9, 0, -1))} ELSE 0 END AS bin, count(*) AS n, round(avg(p), 9) AS mean_p, round(avg(gold::INT), 9) AS share FROM g GROUP BY 1",
    "threshold_sweep": f"{_G}, t AS (SELECT unnest({metrics.thresholds(0.05)!r}::DOUBLE[]) AS threshold), c AS (SELECT threshold, {cm('p >= threshold', 'gold')} FROM g, t GROUP BY threshold) SELECT round(threshold, 6) AS threshold, tp, tn, fp, fn, round({div('tp', 'tp + fp', 1.0)}, 9) AS precision, round({div('tp', 'tp + fn', 0.0)}, 9) AS recall FROM c",
    "retrieval_set_metrics": f"{_G}, c AS (SELECT count(*) FILTER (gold AND p > 0.7) AS b, count(*) FILTER (gold) AS g, count(*) FILTER (p > 0.7) AS f FROM g) SELECT b AS both, g AS gold, f AS found, round({div('b', 'f', 0.0)}, 9) AS precision, round({div('b', 'g', 0.0)}, 9) AS recall, round({div('2 * b', 'g + f', 0.0)}, 9) AS f1, round({div('b', 'g + f - b', 0.0)}, 9) AS jaccard, round({div('abs(f - g)', 'g', 0.0)}, 9) AS count_error FROM c",
    "partition_metrics": f"{_PART}, a AS (SELECT sum(x) AS removed_singulars FROM (SELECT count(DISTINCT gold_group) - 1 AS x FROM d GROUP BY predicted)), b AS (SELECT sum(x) AS missed_duplicates, count(*) AS gp FROM (SELECT count(DISTINCT predicted) - 1 AS x FROM d GROUP BY gold_group)), n AS (SELECT count(*) AS records FROM d) SELECT records, CAST(removed_singulars AS BIGINT) AS removed_singulars, CAST(missed_duplicates AS BIGINT) AS missed_duplicates, round(1 - {div('removed_singulars', 'gp', 0.0)}, 9) AS retention, round(1 - {div('missed_duplicates', 'records - gp', 0.0)}, 9) AS duplicate_recall FROM a, b, n",
    "named_partition": f"{_PART}, f AS (SELECT predicted, min(idx) AS f FROM d GROUP BY predicted), n AS (SELECT predicted, row_number() OVER (ORDER BY f) AS n FROM f) SELECT idx, 'PRED-' || lpad(CAST(n AS VARCHAR), 7, '0') AS predicted_label FROM d JOIN n USING (predicted)",
    "removal_metrics": f"{_REM}, c AS (SELECT {cm('blind', 'gold_removed')} FROM r) SELECT tp, tn, fp, fn, round({_SENS}, 9) AS sensitivity, round({div('tn', 'tn + fp', 1.0)}, 9) AS specificity, round({_F1}, 9) AS f1 FROM c",
    "retention_modes": f"{_REM} SELECT 'blind' AS mode, {cm('blind', 'gold_removed')} FROM r UNION ALL SELECT 'gold_preferred', {cm('pref', 'gold_removed')} FROM r",
    "percent_contract": f"{_REM}, c AS (SELECT {cm('blind', 'gold_removed')} FROM r) SELECT round({div('100 * tp', 'tp + fn', 100.0)}, 7) AS sensitivity, round({div('100 * tn', 'tn + fp', 100.0)}, 7) AS specificity FROM c",
    "wilson_intervals": f"{_G}, c AS (SELECT dataset, count(*) FILTER (gold) AS k, count(*) AS n FROM g GROUP BY dataset) SELECT dataset, k, n, {wilson('k', 'n', '-')} AS low, {wilson('k', 'n', '+')} AS high FROM c",
    "micro_macro": f"{_G}, c AS (SELECT dataset, {cm('p > 0.7', 'gold')} FROM g GROUP BY ROLLUP (dataset)) SELECT dataset, tp, tn, fp, fn, round({_SENS}, 9) AS sensitivity, {wilson('tp', 'tp + fn', '-')} AS low, {wilson('tp', 'tp + fn', '+')} AS high FROM c",
    "percentile_interp": "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.05), 6) AS p5, round(quantile_cont(o_totalprice, 0.5), 6) AS p50, round(quantile_cont(o_totalprice, 0.95), 6) AS p95 FROM orders GROUP BY 1",
    "export_rows": ORACLES["stable_record_id"].replace("SELECT idx, coalesce", "SELECT coalesce").replace(" AS record_id FROM records", " AS record_id, title, array_to_string(list_filter(authors, lambda a: a <> ''), '; ') AS authors, coalesce(CAST(year AS VARCHAR), '') AS year, coalesce(journal, '') AS journal, coalesce(doi, '') AS doi, coalesce(pmid, '') AS pmid FROM records"),
    "windowed_events": "SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
    "session_events": "WITH a AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a), c AS (SELECT user_id, s, count(*) AS n FROM b GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY user_id",
}


# a flow's checks, and record formats

_SUM = "coalesce(sum(count) FILTER (category = '{0}'), 0)"
_OF = "coalesce(max(count) FILTER (label = '{0}'), 0)"
_STAGES = ("records_screened", "records_excluded", "reports_sought_for_retrieval", "reports_not_retrieved", "reports_assessed_for_eligibility", "reports_included")
_CHECKS = {
    **{f"{c} is negative": f"{c} < 0" for c in ("duplicates_removed", *_STAGES)},
    **{f"{c}_removed_before_screening is negative": "false" for c in ("automation", "other")},
    "more duplicates than records": "duplicates_removed > total",
    "more screened than left after removals": "records_screened > greatest(0, total - duplicates_removed)",
    "more excluded than screened": "records_excluded > records_screened",
    "sought is not screened less excluded": "records_screened <> 0 AND reports_sought_for_retrieval <> records_screened - records_excluded",
    "more not retrieved than sought": "reports_not_retrieved > reports_sought_for_retrieval",
    "assessed is not sought less not retrieved": "reports_assessed_for_eligibility <> reports_sought_for_retrieval - reports_not_retrieved",
    "more outcomes than assessed": "reasons + reports_included > reports_assessed_for_eligibility",
    "assessed without outcome": "reports_assessed_for_eligibility <> 0 AND reasons + reports_included < reports_assessed_for_eligibility",
    "more studies than reports": "false",
}
_WHITE = r"[ \t\n\x0B\f\r]+"


def squeezed(x: str) -> str:
    return f"nullif(trim(regexp_replace({x}, '{_WHITE}', ' ', 'g')), '')"


def tag(name: str, x: str) -> str:
    return f"'{name}  - ' || {squeezed(x)}"


_RECORD_ID = ORACLES["stable_record_id"].split("SELECT idx, ")[1].split(" AS record_id")[0]
_KIND = "CASE WHEN contains(kind, 'conference') THEN 'CONF' WHEN contains(kind, 'book') THEN 'BOOK' ELSE 'JOUR' END"
_LINES = ", ".join([
    tag("TY", _KIND), tag("ID", _RECORD_ID), tag("TI", "title"), f"array_to_string(list_filter(list_transform(authors, lambda a: {tag('AU', 'a')}), lambda l: l IS NOT NULL), chr(10))", tag("PY", "CAST(year AS VARCHAR)"), tag("JO", "journal"), tag("AB", "abstract"), tag("DO", "doi"),
    tag("UR", "'https://doi.org/' || doi"), tag("AN", "'PMID:' || pmid"), tag("N1", "'source:' || source"), "'ER  -' || chr(10) || chr(10)",
])


def bibtex(name: str, x: str) -> str:
    escaped = f"replace(nullif({x}, ''), chr(92), chr(92) || 'textbackslash{{}}')"
    return f"'  {name} = {{' || regexp_replace(regexp_replace({escaped}, '([{{}}#%&_])', '\\\\\\1', 'g'), '[\\n\\r]', ' ', 'g') || '}}'"


_NAME = "regexp_extract(authors[1], '[A-Za-zÀ-ÿ0-9]+', 0)"
_KEY = f"regexp_replace(CASE WHEN {_NAME} = '' THEN 'record' ELSE lower({_NAME}) END || coalesce(CAST(year AS VARCHAR), 'nd') || '_' || CAST(idx + 1 AS VARCHAR), '[^a-zA-Z0-9:_-]+', '', 'g')"
_FIELDS = ", ".join(bibtex(k, x) for k, x in (("title", "title"), ("author", "array_to_string(authors, ' and ')"), ("journal", "journal"), ("year", "CAST(year AS VARCHAR)"), ("doi", "doi"), ("abstract", "abstract")))
ORACLES |= {
    "prisma_checks": f"{_FLOW}, x AS (SELECT {_SUM.format('database')} AS total, {_SUM.format('reason')} AS reasons, {', '.join(f'{_OF.format(c)} AS {c}' for c in ('duplicates_removed', *_STAGES))} FROM flow) " + " UNION ALL ".join(f"SELECT '{k}' AS check, {v} AS failed FROM x" for k, v in _CHECKS.items()).replace(" AS check,", ' AS "check",'),
    "ris_lines": f"{R} SELECT idx, md5(array_to_string(list_filter([{_LINES}], lambda l: l <> ''), chr(10))) AS ris FROM records",
    "bibtex_lines": f"{R} SELECT idx, md5('@article{{' || {_KEY} || ',' || chr(10) || array_to_string(list_filter([{_FIELDS}], lambda l: l IS NOT NULL), ',' || chr(10)) || chr(10) || '}}' || chr(10) || chr(10)) AS bibtex FROM records",
}

# families, by components: no union is refused among the views' studies, whose registrations never clash inside a component

_FAMILIES = f"""{_SF}, ac AS (SELECT left_index AS a, right_index AS b FROM sd WHERE decision = 'SAME_STUDY'), ab AS (SELECT a, b FROM ac UNION SELECT b, a FROM ac
), sr(a, b) AS (SELECT a, a FROM ab UNION SELECT sr.a, ab.b FROM sr JOIN ab ON ab.a = sr.b
), cp AS (SELECT a AS node, min(b) AS family FROM sr GROUP BY a
), fm AS (SELECT sp.*, coalesce(family, idx) AS family FROM sp LEFT JOIN cp ON node = idx
), fs AS (SELECT family, list_sort(list(idx)) AS m, list_sort(list_distinct(flatten(list(ids)))) AS r, count(*) FILTER (role IN {tuple(study.OUTCOME_ROLES)!r}) AS o FROM fm GROUP BY family)"""
_ABLATED = """(VALUES ('<none>', 10::DOUBLE, 2.2::DOUBLE, 2::DOUBLE), ('doi_exact', 0, 2.2, 2), ('title_token_jaccard', 10, 0, 2), ('author_similarity', 10, 2.2, 0)) w(ablated, w1, w2, w3)"""
_WEIGHED = EDGES.replace("10 * doi_exact", "w1 * doi_exact").replace("2.2 * tj", "w2 * tj").replace("2.0 * au", "w3 * au").replace(" AS z FROM f\n", f" AS z FROM f, {_ABLATED}\n")
ORACLES |= {
    "study_families": f"{_FAMILIES} SELECT 'STUDY-' || upper(substr(sha1('registry|' || array_to_string(r, '|')), 1, 12)) AS study_id, array_to_string(m, ',') AS members, array_to_string(r, ',') AS registrations FROM fs",
    "study_gate": f"{_FAMILIES} SELECT a AS left_index, b AS right_index, false AS refused, family FROM ac JOIN cp ON node = a",
    "double_counting_risk": f"{_FAMILIES} SELECT CASE WHEN o >= 2 THEN 'HIGH' ELSE 'REVIEW' END AS severity, count(*) AS families FROM fs WHERE o >= 2 OR len(m) >= 2 GROUP BY 1",
    "ablation_native": f"{_WEIGHED} SELECT ablated, {cm('probability >= 0.985', '(doi_exact = 1)')} FROM g GROUP BY ablated",
}

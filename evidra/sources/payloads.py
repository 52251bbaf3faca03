"""Response bodies of bibliographic services as records.

A JSON body is parsed once into a variant and its items are read by path, so
fields that a service adds, drops or sends in another shape give nulls and no
failure.  Everything is a Column expression; no body passes through Python.

Bodies come as rows (value, query, retrieved_at, first_rank); each item of a
body becomes one record with one source hit.  Null, empty and malformed bodies
hold no items.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.functions import numbers as N
from evidra.functions import text as T

from .registry import NAMES

RECORD = ("title", "authors", "year", "journal", "abstract", "doi", "pmid", "wos_ut", "scopus_eid", "openalex_id", "source_hits", "metadata")


def path(*keys: str | int) -> str:
    """A variant path; keys may hold any sign but a quote."""
    return "$" + "".join(f"[{k}]" if isinstance(k, int) else f"['{k}']" for k in keys)


def text(v: Column, *keys: str | int) -> Column:
    """The trimmed text at a path, numbers too; null if it is empty or missing."""
    return F.nullif(F.trim(F.try_variant_get(v, path(*keys), "string")), F.lit(""))


def inner(v: Column, *keys: str | int) -> Column:
    got = F.try_variant_get(v, path(*keys), "variant")
    return F.when(~F.is_variant_null(got), got)


def kind(v: Column) -> Column:
    """ARRAY, OBJECT, STRING or another first word of the variant's schema."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def many(v: Column, *keys: str | int) -> Column:
    """The variants of a list at a path; a single value is a list of one, a missing one is empty."""
    got = inner(v, *keys)
    return F.coalesce(F.when(kind(got) == "ARRAY", F.try_variant_get(got, "$", "array<variant>")), F.when(got.isNotNull(), F.array(got)), F.array().cast("array<variant>"))


def first(*columns: Column) -> Column:
    return F.coalesce(*columns)


def texts(items: Column, of: Callable[[Column], Column]) -> Column:
    """What ``of`` gives for each variant of a list, nulls left out."""
    return F.filter(F.transform(items, of), lambda t: t.isNotNull())


def plain(v: Column) -> Column:
    """A variant that is a text or a number, as text."""
    return F.when(~kind(v).isin("OBJECT", "ARRAY"), F.nullif(F.trim(F.try_variant_get(v, "$", "string")), F.lit("")))


def deep(v: Column, *keys: str) -> Column:
    """The first text in a value: itself, the first of a list, or that under the first of ``keys`` that has one."""
    one = lambda x: first(plain(x), *[F.when(kind(x) == "OBJECT", plain(inner(x, k))) for k in keys])
    return F.get(texts(many(v), one), F.lit(0))


def joined(*parts: Column) -> Column:
    return F.nullif(F.concat_ws(" ", *parts), F.lit(""))


def facts(v: Column, **paths: tuple) -> dict[str, Column]:
    """Metadata by path; what is no plain value is kept as JSON."""
    return {name: text(v, *keys) for name, keys in paths.items()}


def _openalex(v: Column) -> dict[str, Column]:
    index = F.try_variant_get(v, path("abstract_inverted_index"), "map<string,array<int>>")
    return {
        "title": first(text(v, "title"), text(v, "display_name")),
        "authors": texts(many(v, "authorships"), lambda a: text(a, "author", "display_name")),
        "year": N.leading_year(text(v, "publication_year")),
        "journal": text(v, "primary_location", "source", "display_name"),
        "abstract": T.abstract_from_index(index),
        "doi": first(text(v, "doi"), text(v, "ids", "doi")),
        "pmid": F.nullif(F.regexp_extract(text(v, "ids", "pmid"), "([^/]+)/*$", 1), F.lit("")),
        "openalex_id": text(v, "id"),
        "source_id": text(v, "id"),
        "metadata": facts(v, publication_date=("publication_date",), type=("type",), language=("language",), cited_by_count=("cited_by_count",), is_retracted=("is_retracted",), open_access=("open_access",), source_issn_l=("primary_location", "source", "issn_l")),
    }


def _crossref(v: Column) -> dict[str, Column]:
    dates = [F.when(F.coalesce(text(v, k, "date-parts", 0, 0).try_cast("int"), F.lit(0)) != 0, F.array(*[text(v, k, "date-parts", 0, i).try_cast("int") for i in range(3)])) for k in ("published", "published-print", "published-online", "issued", "created")]
    date = F.coalesce(*dates)
    part = lambda i: F.lpad(F.coalesce(F.nullif(date[i], F.lit(0)), F.lit(1)).cast("string"), 2, "0")
    return {
        "title": text(v, "title", 0),
        "authors": texts(many(v, "author"), lambda a: first(joined(text(a, "family"), text(a, "given")), text(a, "name"))),
        "year": date[0],
        "journal": text(v, "container-title", 0),
        "abstract": T.strip_markup(text(v, "abstract")),
        "doi": text(v, "DOI"),
        "source_id": first(text(v, "DOI"), text(v, "URL")),
        "metadata": facts(v, type=("type",), url=("URL",), issn=("ISSN",), isbn=("ISBN",), publisher=("publisher",), subject=("subject",), is_referenced_by_count=("is-referenced-by-count",), references_count=("references-count",))
        | {"publication_date": F.when(date.isNotNull(), F.concat_ws("-", F.lpad(date[0].cast("string"), 4, "0"), part(1), part(2)))},
    }


def _europe_pmc(v: Column) -> dict[str, Column]:
    named = text(v, "source").isNotNull() | text(v, "id").isNotNull()
    part = lambda k: F.coalesce(text(v, k), F.lit("None"))
    return {
        "title": text(v, "title"),
        "authors": texts(many(v, "authorList", "author"), lambda a: first(text(a, "fullName"), joined(text(a, "lastName"), text(a, "firstName")))),
        "year": text(v, "pubYear").try_cast("int"),
        "journal": text(v, "journalInfo", "journal", "title"),
        "abstract": text(v, "abstractText"),
        "doi": text(v, "doi"),
        "pmid": text(v, "pmid"),
        "source_id": F.when(named, F.concat(part("source"), F.lit(":"), part("id"))).otherwise(text(v, "pmid")),
        "metadata": facts(v, pmcid=("pmcid",), source=("source",), external_id=("id",), first_publication_date=("firstPublicationDate",), journal_issn=("journalInfo", "journal", "issn"), publication_types=("pubTypeList", "pubType"), cited_by_count=("citedByCount",), is_open_access=("isOpenAccess",), has_pdf=("hasPDF",), mesh_heading_list=("meshHeadingList",)),
    }


def _core(v: Column) -> dict[str, Column]:
    value = lambda k: deep(inner(v, k), "title", "name", "displayName", "value")
    names = lambda a: first(plain(a), text(a, "name"), text(a, "displayName"))
    doi, url = value("doi"), value("downloadUrl")
    return {
        "title": value("title"),
        "authors": texts(many(v, "authors"), names),
        "year": N.leading_year(first(text(v, "yearPublished"), text(v, "publishedDate"))),
        "journal": first(value("journals"), value("journal")),
        "abstract": value("abstract"),
        "doi": doi,
        "source_id": first(text(v, "id"), doi),
        "metadata": facts(v, core_id=("id",), document_type=("documentType",), language=("language",), publisher=("publisher",), oai=("oai",), arxiv_id=("arxivId",), data_providers=("dataProviders",))
        | {"download_url": url, "full_text_available": (text(v, "fullText").isNotNull() | url.isNotNull()).cast("string"), "open_access_source": F.lit("true")},
    }


def _scopus(v: Column) -> dict[str, Column]:
    own = texts(many(v, "author"), lambda a: first(text(a, "authname"), joined(text(a, "surname"), first(text(a, "given-name"), text(a, "initials")))))
    creator = text(v, "dc:creator")
    year = lambda k: F.substring(text(v, k), 1, 4).try_cast("int")
    return {
        "title": text(v, "dc:title"),
        "authors": F.when(F.size(own) > 0, own).otherwise(F.filter(F.array(creator), lambda c: c.isNotNull())),
        "year": first(year("prism:coverDate"), year("prism:coverDisplayDate")),
        "journal": text(v, "prism:publicationName"),
        "abstract": text(v, "dc:description"),
        "doi": text(v, "prism:doi"),
        "scopus_eid": text(v, "eid"),
        "source_id": first(text(v, "eid"), text(v, "dc:identifier"), text(v, "prism:doi")),
        "metadata": facts(v, scopus_id=("dc:identifier",), cover_date=("prism:coverDate",), issn=("prism:issn",), eissn=("prism:eIssn",), volume=("prism:volume",), issue=("prism:issueIdentifier",), pages=("prism:pageRange",), cited_by_count=("citedby-count",), subtype=("subtype",), subtype_description=("subtypeDescription",), open_access=("openaccess",), aggregation_type=("prism:aggregationType",)),
    }


def _wos(v: Column) -> dict[str, Column]:
    cited = F.array_max(texts(many(v, "citations"), lambda c: text(c, "count").try_cast("int")))
    return {
        "title": text(v, "title"),
        "authors": texts(many(v, "names", "authors"), lambda a: first(plain(a), text(a, "displayName"), text(a, "wosStandard"), text(a, "name"))),
        "year": N.leading_year(first(text(v, "source", "publishYear"), text(v, "publishYear"))),
        "journal": text(v, "source", "sourceTitle"),
        "doi": text(v, "identifiers", "doi"),
        "pmid": text(v, "identifiers", "pmid"),
        "wos_ut": text(v, "uid"),
        "source_id": first(text(v, "uid"), text(v, "identifiers", "doi")),
        "metadata": facts(v, document_types=("types",), volume=("source", "volume"), issue=("source", "issue"), pages=("source", "pages"), article_number=("source", "articleNumber"), publish_month=("source", "publishMonth"), issn=("identifiers", "issn"), eissn=("identifiers", "eissn"), isbn=("identifiers", "isbn"), author_keywords=("keywords", "authorKeywords"))
        | {"api_variant": F.lit("starter_v2"), "times_cited": cited.cast("string")},
    }


def _wos_expanded(v: Column) -> dict[str, Column]:
    value = lambda x: first(plain(x), *[F.when(kind(x) == "OBJECT", plain(inner(x, k))) for k in ("content", "value", "display_name", "full_name", "p")])
    summary, record = ("static_data", "summary"), ("static_data", "fullrecord_metadata")
    titles = many(v, *summary, "titles", "title")
    of_kind = lambda k: F.get(texts(F.filter(titles, lambda t: F.lower(F.coalesce(text(t, "type"), F.lit(""))) == k), value), F.lit(0))
    writer = lambda n: F.coalesce(F.lower(text(n, "role")), F.lit("author")).isin("author", "authors")
    name = lambda n: first(text(n, "display_name"), text(n, "full_name"), text(n, "wos_standard"))
    given = many(v, "dynamic_data", "cluster_related", "identifiers", "identifier")
    # of identifiers of one kind the last counts
    identifier = lambda *kinds: first(*[F.try_element_at(F.filter(texts(F.filter(given, lambda i: F.replace(F.lower(F.coalesce(text(i, "type"), F.lit(""))), F.lit(" "), F.lit("")) == k), lambda i: first(text(i, "value"), text(i, "content"))), lambda t: t.isNotNull()), F.lit(-1)) for k in kinds])
    # paragraphs: texts, or objects that hold their text under p or content, alone or in lists
    one = lambda x: first(plain(x), F.nullif(F.concat_ws(" ", texts(F.concat(*[many(x, k) for k in ("p", "content")]), plain)), F.lit("")))
    abstract = F.nullif(F.concat_ws(" ", texts(F.flatten(F.transform(many(v, *record, "abstracts", "abstract"), lambda a: F.when(inner(a, "abstract_text").isNotNull(), many(a, "abstract_text", "p")).otherwise(F.array(a)))), one)), F.lit(""))
    page = inner(v, *summary, "pub_info", "page")
    begin, end = text(page, "begin"), text(page, "end")
    pages = first(plain(page), text(page, "content"), F.when(begin.isNotNull() & end.isNotNull(), F.concat(begin, F.lit("-"), end)), begin)
    cited = F.filter(F.transform(many(v, "dynamic_data", "citation_related", "tc_list", "silo_tc"), lambda c: F.struct(F.upper(F.coalesce(text(c, "coll_id"), F.lit(""))).alias("at"), text(c, "local_count").try_cast("int").alias("n"))), lambda c: c["n"].isNotNull())
    times = first(F.get(F.filter(cited, lambda c: c["at"] == "WOS"), F.lit(0))["n"], F.array_max(F.transform(cited, lambda c: c["n"])))
    return {
        "title": first(of_kind("item"), F.get(texts(titles, value), F.lit(0))),
        "authors": texts(F.filter(many(v, *summary, "names", "name"), writer), name),
        "year": text(v, *summary, "pub_info", "pubyear").try_cast("int"),
        "journal": of_kind("source"),
        "abstract": abstract,
        "doi": identifier("doi", "doi.org"),
        "pmid": identifier("pmid", "pubmedid"),
        "wos_ut": text(v, "UID"),
        "source_id": first(text(v, "UID"), identifier("doi", "doi.org")),
        "metadata": facts(v, publication_type=(*summary, "pub_info", "pubtype"), document_types=(*summary, "doctypes", "doctype"), volume=(*summary, "pub_info", "vol"), issue=(*summary, "pub_info", "issue"), cover_date=(*summary, "pub_info", "coverdate"), sort_date=(*summary, "pub_info", "sortdate"), keywords=(*record, "keywords", "keyword"), keywords_plus=("static_data", "item", "keywords_plus", "keyword"), languages=(*record, "languages", "language"), addresses=(*record, "addresses", "address_name"), funding=(*record, "fund_ack"), reference_count=(*record, "refs", "count"))
        | {"api_variant": F.lit("expanded"), "pages": pages, "times_cited": times.cast("string")},
    }


#: Where a body keeps its items, and what is read from each.
JSON: dict[str, tuple[tuple[str, ...], Callable[[Column], dict[str, Column]]]] = {
    "openalex": (("results",), _openalex),
    "openalex_oql": (("results",), _openalex),
    "crossref": (("message", "items"), _crossref),
    "europe_pmc": (("resultList", "result"), _europe_pmc),
    "core": (("results",), _core),
    "scopus": (("search-results", "entry"), _scopus),
    "web_of_science": (("hits",), _wos),
    "web_of_science_expanded": (("Data", "Records", "records", "REC"), _wos_expanded),
}


def _pubmed(v: Column) -> dict[str, Column]:
    """One article element; its parts are short and not nested in themselves, so patterns find them."""
    all_of = lambda x, tag: F.regexp_extract_all(x, F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))
    one = lambda x, tag: T.strip_markup(F.get(all_of(x, tag), F.lit(0)))
    part = lambda x, tag: F.coalesce(F.get(all_of(x, tag), F.lit(0)), F.lit(""))
    article, lists = part(v, "Article"), part(part(v, "PubmedData"), "ArticleIdList")
    author = lambda a: first(one(a, "CollectiveName"), joined(one(a, "LastName"), first(one(a, "ForeName"), one(a, "Initials"))))
    labelled = F.regexp_extract_all(part(article, "Abstract"), F.lit(r"(?s)<AbstractText(?:\s[^>]*)?>.*?</AbstractText>"), F.lit(0))
    label = lambda p: F.coalesce(*[F.nullif(F.regexp_extract(p, rf'^<AbstractText[^>]*\b{k}="([^"]*)"', 1), F.lit("")) for k in ("Label", "NlmCategory")])
    paragraph = lambda p: F.when(T.strip_markup(p).isNotNull(), F.concat_ws(": ", label(p), T.strip_markup(p)))
    ident = lambda k: F.nullif(F.trim(F.regexp_extract(lists, rf'(?i)<ArticleId\s[^>]*IdType="{k}"[^>]*>([^<]*)<', 1)), F.lit(""))
    date = part(part(part(article, "Journal"), "JournalIssue"), "PubDate")
    years = [one(part(article, "ArticleDate"), "Year"), one(date, "Year"), one(part(v, "DateCompleted"), "Year"), one(part(v, "DateRevised"), "Year")]
    year = first(*[F.when(y.rlike(r"^\d+$"), y.try_cast("int")) for y in years], N.year_in(one(date, "MedlineDate"), "18|19|20|21"))
    pmid = one(part(v, "MedlineCitation"), "PMID")
    return {
        "title": one(article, "ArticleTitle"),
        "authors": texts(all_of(part(article, "AuthorList"), "Author"), author),
        "year": year,
        "journal": one(part(article, "Journal"), "Title"),
        "abstract": F.nullif(F.array_join(texts(labelled, paragraph), "\n"), F.lit("")),
        "doi": ident("doi"),
        "pmid": pmid,
        "source_id": pmid,
        "metadata": {"pmcid": ident("pmc"), "language": one(article, "Language"), "publication_types": F.to_json(texts(all_of(part(article, "PublicationTypeList"), "PublicationType"), T.strip_markup)), "source_record_type": F.lit("PubmedArticle")},
    }


def items(bodies: DataFrame, source: str) -> DataFrame:
    """One row an item, ``v``, with its rank among all items of the search."""
    if source == "pubmed":
        found = F.regexp_extract_all("value", F.lit(r"(?s)<PubmedArticle(?:\s[^>]*)?>.*?</PubmedArticle>"), F.lit(0))
    else:
        body = many(F.try_parse_json("value"), *JSON[source][0])
        found = F.filter(body, lambda v: kind(v) == "OBJECT")
    return bodies.select("query", "retrieved_at", "first_rank", F.posexplode(found).alias("pos", "v")).withColumn("rank", (F.col("first_rank") + F.col("pos")).cast("int"))


def parse(bodies: DataFrame, source: str) -> DataFrame:
    """The records of a source's response bodies (value, query, retrieved_at, first_rank)."""
    read = _pubmed if source == "pubmed" else JSON[source][1]
    got = read(F.col("v"))
    column = lambda c: got.get(c, F.lit(None).cast("string"))
    hit = F.struct(F.lit(source).alias("source"), column("source_id").alias("source_id"), F.col("query"), F.col("retrieved_at"), F.col("rank"))
    known = F.map_filter(F.create_map(*[x for k, value in got["metadata"].items() for x in (F.lit(k), value.cast("string"))]), lambda k, value: value.isNotNull())
    return items(bodies, source).select(
        F.coalesce(column("title"), F.lit(f"[Untitled {NAMES[source]} record]")).alias("title"), got["authors"].alias("authors"), got["year"].cast("int").alias("year"), *[column(c).alias(c) for c in ("journal", "abstract")],
        T.norm_doi(column("doi")).alias("doi"), *[column(c).alias(c) for c in ("pmid", "wos_ut", "scopus_eid", "openalex_id")], F.array(hit).alias("source_hits"), known.alias("metadata"),
    )


def total(source: str, body: Column) -> Column:
    """How many records the source says it has for the search, by one body."""
    at = {
        "openalex": ("meta", "count"), "openalex_oql": ("meta", "count"), "crossref": ("message", "total-results"), "europe_pmc": ("hitCount",), "core": ("totalHits",),
        "scopus": ("search-results", "opensearch:totalResults"), "web_of_science": ("metadata", "total"), "web_of_science_expanded": ("QueryResult", "RecordsFound"), "pubmed": ("esearchresult", "count"),
    }
    return text(F.try_parse_json(body), *at[source]).try_cast("long")


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)

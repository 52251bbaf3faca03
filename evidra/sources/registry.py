"""The bibliographic services that can be searched: names, addresses, page sizes, spellings."""

from __future__ import annotations

# What the services are called, where they answer, and how many records a page may hold.
NAMES = {
    "pubmed": "PubMed", "openalex": "OpenAlex", "openalex_oql": "OpenAlex", "crossref": "Crossref", "europe_pmc": "Europe PMC", "core": "CORE", "scopus": "Scopus",
    "web_of_science": "Web of Science", "web_of_science_expanded": "Web of Science Expanded",
}
ENDPOINTS = {
    "pubmed": "https://eutils.ncbi.nlm.nih.gov/entrez/eutils/", "openalex": "https://api.openalex.org/works", "openalex_oql": "https://api.openalex.org/", "crossref": "https://api.crossref.org/works",
    "europe_pmc": "https://www.ebi.ac.uk/europepmc/webservices/rest/search", "core": "https://api.core.ac.uk/v3/search/works/", "scopus": "https://api.elsevier.com/content/search/scopus",
    "web_of_science": "https://api.clarivate.com/apis/wos-starter/v2/documents", "web_of_science_expanded": "https://api.clarivate.com/api/wos",
}
#: (usual, most) records a page
PAGES = {
    "pubmed": (200, 500), "openalex": (100, 100), "openalex_oql": (100, 100), "crossref": (500, 1000), "europe_pmc": (1000, 1000), "core": (100, 100), "scopus": (25, 25), "web_of_science": (50, 50),
    "web_of_science_expanded": (100, 100),
}
#: Records that a service hands out for one search at most.
LIMITS = {"pubmed": 10_000, "web_of_science_expanded": 100_000}
#: Services that answer to nobody without a key.
KEYED = ("scopus", "web_of_science", "web_of_science_expanded")
#: The dialect of a service where it is not called like it.
DIALECTS = {"web_of_science": "web_of_science_starter", "web_of_science_expanded": "web_of_science"}
ALIASES = {
    "europepmc": "europe_pmc", "oql": "openalex_oql", "openalex-oql": "openalex_oql", "webofscience": "web_of_science", "wos": "web_of_science", "webofscience_expanded": "web_of_science_expanded",
    "wos_expanded": "web_of_science_expanded",
}
USUAL = ("pubmed", "openalex", "crossref", "europe_pmc")


def source_name(name: str) -> str:
    """The service that a spelling stands for."""
    name = name.lower().replace(" ", "_")
    name = ALIASES.get(name, name)
    if name not in NAMES:
        raise ValueError(f"unsupported source: {name}")
    return name

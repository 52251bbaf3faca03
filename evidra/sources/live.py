"""Live searches as a Spark data source: one partition a service, one row a response.

A service's pages follow from each other by cursor or offset, so a service is
read by one task, and several services by as many.  Rows hold the bodies as
they came, with their hashes: written to a table they are the archive of the
search, and ``payloads`` makes records of them again without a network.  A
service that fails gives one row with its error and leaves the others alone.

``fetch`` is what asks a service; tests and other clients hand in their own.
``Cached`` and ``Archived`` wrap it.
"""

from __future__ import annotations

import gzip
import hashlib
import itertools
import json
import random
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from evidra.plans import dialects
from evidra.plans import language as L

from . import registry as R

SCHEMA = "source string, page int, first_rank long, query string, value string, sha256 string, retrieved_at string, attempts int, parameters string, error string"
LONG_QUERY = 6000
SECRET = "***REDACTED***"
#: Names of parameters whose values are never written down.
SECRETS = frozenset({"api_key", "apikey", "key", "token", "access_token", "authorization"})


def redacted(values: dict) -> dict:
    """Parameters without what must stay secret."""
    hidden = lambda k: k.lower() in SECRETS or "token" in k.lower() or "secret" in k.lower()
    return {k: SECRET if hidden(k) else v for k, v in values.items()}


@dataclass(frozen=True)
class Retry:
    """How often and after how long a request is made again."""

    attempts: int = 4
    base_s: float = 0.5
    most_s: float = 8.0
    statuses: tuple[int, ...] = (429, 500, 502, 503, 504)

    def delay(self, attempt: int, retry_after: str | None = None, draw: Callable[[], float] = random.random) -> float:
        """Seconds before the next attempt: what the service asks for, or twice as long each time, within 15 %."""
        try:
            return min(float(retry_after), self.most_s)
        except (TypeError, ValueError):
            return min(self.base_s * 2 ** max(0, attempt - 1), self.most_s) * (0.85 + 0.3 * draw())


@dataclass(frozen=True)
class Request:
    url: str
    parameters: dict = field(default_factory=dict)
    headers: dict = field(default_factory=dict)
    body: dict | None = None


@dataclass(frozen=True)
class Answer:
    status: int
    content: bytes
    retry_after: str | None = None


class SourceError(RuntimeError):
    pass


def fetch(request: Request, timeout: float = 30.0) -> Answer:
    url = request.url + ("?" + urllib.parse.urlencode(request.parameters) if request.parameters else "")
    data = json.dumps(request.body).encode() if request.body is not None else None
    try:
        with urllib.request.urlopen(urllib.request.Request(url, data, request.headers), timeout=timeout) as answer:
            return Answer(answer.status, answer.read())
    except urllib.error.HTTPError as e:
        return Answer(e.code, e.read(), e.headers.get("Retry-After"))


def asked(request: Request, retry: Retry, get: Callable[[Request], Answer], sleep: Callable[[float], None] = time.sleep) -> tuple[bytes, int]:
    """(content, attempts); raises after the last attempt, or at once at a status that is not worth another."""
    last = ""
    for attempt in range(1, retry.attempts + 1):
        after = None
        try:
            answer = get(request)
            if answer.status < 400:
                return answer.content, attempt
            last, after = f"status {answer.status}", answer.retry_after
            if answer.status not in retry.statuses:
                raise SourceError(f"request refused at attempt {attempt}: {last}")
        except OSError as e:
            last = f"{type(e).__name__}: {e}"
        if attempt < retry.attempts:
            sleep(retry.delay(attempt, after))
    raise SourceError(f"request failed after {retry.attempts} attempts: {last}")


class _Files:
    """Small files below a folder that driver and executors reach by the same address; a file appears whole or not at all."""

    def __init__(self, folder: str):
        self.folder = folder if "://" in folder else "file://" + folder

    def _open(self):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.folder)
        system.create_dir(root, recursive=True)
        return system, root, fs.FileType

    def get(self, name: str) -> bytes | None:
        system, root, kinds = self._open()
        if system.get_file_info(f"{root}/{name}").type != kinds.File:
            return None
        with system.open_input_stream(f"{root}/{name}", compression=None) as f:
            return f.read()

    def put(self, name: str, content: bytes) -> None:
        system, root, _ = self._open()
        own = f"{root}/.{name}.{uuid.uuid4().hex}"
        with system.open_output_stream(own, compression=None) as f:
            f.write(content)
        system.move(own, f"{root}/{name}")


def request_key(request: Request) -> str:
    """A request's name: its method, address, parameters and body, without secrets."""
    method = "GET" if request.body is None else "POST"
    named = [method, request.url, sorted(redacted(request.parameters).items()), redacted(request.body) if request.body is not None else None]
    return hashlib.sha256(json.dumps(named, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()


@dataclass(frozen=True)
class Cached:
    """``get`` that asks for nothing twice: good answers are kept below a shared folder, by the request's key."""

    get: Callable[[Request], Answer]
    folder: str

    def __call__(self, request: Request) -> Answer:
        files, name = _Files(self.folder), request_key(request) + ".gz"
        held = files.get(name)
        if held is not None:
            return Answer(200, gzip.decompress(held))
        answer = self.get(request)
        if answer.status < 400:
            files.put(name, gzip.compress(answer.content, mtime=0))
        return answer


@dataclass(frozen=True)
class Archived:
    """``get`` that keeps every good body under its own hash, and beside it what was asked, without secrets."""

    get: Callable[[Request], Answer]
    folder: str

    def __call__(self, request: Request) -> Answer:
        answer = self.get(request)
        if answer.status < 400:
            files, digest = _Files(self.folder), hashlib.sha256(answer.content).hexdigest()
            if files.get(digest + ".gz") is None:
                about = {"sha256": digest, "bytes": len(answer.content), "url": request.url, "parameters": redacted(request.parameters), "body": redacted(request.body) if request.body is not None else None}
                files.put(digest + ".json", json.dumps(about, sort_keys=True, ensure_ascii=False, default=str).encode())
                files.put(digest + ".gz", gzip.compress(answer.content, mtime=0))
        return answer


def _at(body: dict, *keys: str):
    for k in keys:
        body = body.get(k) if isinstance(body, dict) else None
    return body


def _many(value) -> list:
    return value if isinstance(value, list) else [] if value is None else [value]


def _number(value) -> int | None:
    try:
        return int(value)
    except (TypeError, ValueError):
        return None


Step = tuple[Request, int, int]  # request, rank of its first record, records asked for


def _cursor(source: str, text: str, search: L.Search, size: int, most: int | None, options: dict) -> Iterator[Step]:
    """Pages that name the next one; a generator that is sent each body."""
    rows, at_items, at_next = {
        "openalex": ("per_page", ("results",), ("meta", "next_cursor")), "openalex_oql": ("per-page", ("results",), ("meta", "next_cursor")),
        "crossref": ("rows", ("message", "items"), ("message", "next-cursor")), "europe_pmc": ("pageSize", ("resultList", "result"), ("nextCursorMark",)),
    }[source]
    bounds = {"openalex": ("from_publication_date", "to_publication_date"), "crossref": ("from-pub-date", "until-pub-date")}.get(source, ())
    limits = ",".join(f"{k}:{y}-{d}" for k, y, d in zip(bounds, (search.year_from, search.year_to), ("01-01", "12-31")) if y)
    key, mail = options.get("api_key"), options.get("email")
    headers, fixed = {"Accept": "application/json"}, {"filter": limits} if limits else {}
    if source == "europe_pmc":
        fixed |= {"format": "json", "resultType": "core"} | ({"synonym": "TRUE"} if options.get("synonym") else {}) | ({"email": mail} if mail else {})
    elif source == "crossref":
        headers |= {"Crossref-Plus-API-Token": f"Bearer {key}"} if key else {}
        fixed |= {"mailto": mail} if mail else {}
    elif source == "openalex_oql":
        headers |= {"Authorization": f"Bearer {key}"} if key else {}
        fixed |= {"mailto": mail} if mail and not key else {}
    else:
        fixed |= {"api_key": key} if key else {"mailto": mail} if mail else {}
    named = {"openalex": "search", "openalex_oql": "oql", "crossref": "query.bibliographic", "europe_pmc": "query"}[source]
    mark, seen = "*", 0
    while mark and (most is None or seen < most):
        take = size if most is None else min(size, most - seen)
        sent = {named: text, rows: take, "cursorMark" if source == "europe_pmc" else "cursor": mark} | fixed
        if source == "openalex_oql" and len(text.encode()) > LONG_QUERY:
            request = Request(R.ENDPOINTS[source], {}, headers | {"Content-Type": "application/json"}, {"oql": text, "per_page": take, "cursor": mark})
        else:
            request = Request(R.ENDPOINTS[source], sent, headers)
        body = yield request, seen + 1, take
        got, following = _many(_at(body, *at_items)), _at(body, *at_next)
        seen += len(got)
        mark = following if len(got) >= take and following != mark else None


def _offset(source: str, text: str, search: L.Search, size: int, most: int | None, options: dict) -> Iterator[Step]:
    """Pages by the place of their first record."""
    key = options.get("api_key")
    at_items, at_total = {
        "core": (("results",), ("totalHits",)), "scopus": (("search-results", "entry"), ("search-results", "opensearch:totalResults")), "web_of_science": (("hits",), ("metadata", "total")),
        "web_of_science_expanded": (("Data", "Records", "records", "REC"), ("QueryResult", "RecordsFound")),
    }[source]
    span = f"{search.year_from}-01-01 {search.year_to}-12-31" if search.year_from is not None and search.year_to is not None else None
    timed = {"publishTimeSpan": span} if span and source.startswith("web_of_science") else {}
    headers = {"Accept": "application/json"}
    if key:
        headers |= {"core": {"Authorization": f"Bearer {key}"}, "scopus": {"X-ELS-APIKey": key}}.get(source, {"X-ApiKey": key})
    if options.get("insttoken"):
        headers["X-ELS-Insttoken"] = options["insttoken"]
    # a page cannot be cut where later records may make up for those that the years take out
    whole = source in ("core", "web_of_science")
    seen = 0
    while (most is None or seen < most) and seen < R.LIMITS.get(source, seen + 1):
        take = size if most is None or whole else min(size, most - seen)
        sent = {
            "core": {"q": text, "limit": take, "offset": seen}, "scopus": {"query": text, "start": seen, "count": take, "view": options.get("view", "STANDARD")},
            "web_of_science": {"db": options.get("database", "WOS"), "q": text, "limit": take, "page": seen // size + 1} | timed,
            "web_of_science_expanded": {"databaseId": options.get("database", "WOS"), "lang": options.get("lang", "en"), "usrQuery": text, "count": take, "firstRecord": seen + 1, "optionView": options.get("option_view", "FR")} | timed,
        }[source]
        if source == "web_of_science_expanded":
            sent |= {name: options[k] for k, name in (("edition", "edition"), ("view_fields", "viewField")) if options.get(k)}
        body = yield Request(R.ENDPOINTS[source], sent, headers), seen + 1, take
        got, all_of = _many(_at(body, *at_items)), _number(_at(body, *at_total))
        seen += len(got)
        if len(got) < take or all_of is not None and seen >= all_of:
            return


def _history(source: str, text: str, search: L.Search, size: int, most: int | None, options: dict) -> Iterator[Step]:
    """A search that the service keeps, then its records page by page; the search's own answer has rank 0."""
    who = {"tool": options.get("tool", "evidra")} | {k: options[k] for k in ("email", "api_key") if options.get(k)}
    base = R.ENDPOINTS[source]
    body = yield Request(base + "esearch.fcgi", {"db": "pubmed", "term": text, "retmode": "json", "retmax": 0, "usehistory": "y"} | who), 0, 0
    found = _at(body, "esearchresult") or {}
    target = min(_number(found.get("count")) or 0, R.LIMITS[source], most if most is not None else R.LIMITS[source])
    if not (found.get("webenv") and found.get("querykey")):
        return
    for start in range(0, target, size):
        take = min(size, target - start)
        sent = {"db": "pubmed", "query_key": found["querykey"], "WebEnv": found["webenv"], "retstart": start, "retmax": take, "rettype": "abstract", "retmode": "xml"}
        body = yield Request(base + "efetch.fcgi", sent | who), start + 1, take
        if isinstance(body, str) and body.count("<PubmedArticle>") + body.count("<PubmedArticle ") < take:
            return


def steps(source: str, search: L.Search, limit: int | None = 1000, page_size: int | None = None, options: dict | None = None) -> tuple[str, Iterator[Step]]:
    """(the query in the source's language, its requests): send each request's body to get the next."""
    source, options = R.source_name(source), dict(options or {})
    if source in R.KEYED and not options.get("api_key"):
        raise SourceError(f"{R.NAMES[source]} needs an api_key")
    if source == "scopus" and options.get("view", "STANDARD") not in ("STANDARD", "COMPLETE"):
        raise SourceError("view must be STANDARD or COMPLETE")
    if source == "web_of_science_expanded" and (options.get("option_view", "FR") not in ("FR", "SR", "FS") or options.get("option_view") == "FS" and not options.get("view_fields")):
        raise SourceError("option_view must be FR, SR, or FS with view_fields")
    usual, most = R.PAGES[source]
    text = dialects.translate(search, R.DIALECTS.get(source, source)).text
    run = _history if source == "pubmed" else _cursor if source in ("openalex", "openalex_oql", "crossref", "europe_pmc") else _offset
    return text, run(source, text, search, min(max(1, page_size or usual), most), limit, options)


def responses(source: str, search: L.Search, limit: int | None = 1000, page_size: int | None = None, options: dict | None = None, get: Callable[[Request], Answer] = fetch, retry: Retry = Retry(), sleep: Callable[[float], None] = time.sleep) -> Iterator[tuple]:
    """Rows of ``SCHEMA``; an error ends a source's rows with one that says so."""
    page, text = 0, None
    try:
        text, run = steps(source, search, limit, page_size, options)
        step = next(run, None)
        while step is not None:
            request, rank, _ = step
            content, attempts = asked(request, retry, get, sleep)
            value = content.decode("utf-8", "replace")
            page += 1
            shown = redacted(request.parameters) | ({"__json__": redacted(request.body)} if request.body else {})
            yield source, page, rank, text, value, hashlib.sha256(content).hexdigest(), datetime.now(UTC).isoformat(), attempts, json.dumps(shown, sort_keys=True, ensure_ascii=False), None
            try:
                body = json.loads(value)
            except ValueError:
                body = value
            try:
                step = run.send(body)
            except StopIteration:
                step = None
    except (SourceError, ValueError) as e:
        yield source, page + 1, None, text, None, None, datetime.now(UTC).isoformat(), None, None, f"{type(e).__name__}: {e}"


@dataclass
class _One(InputPartition):
    source: str = ""


def live_source(get: Callable[[Request], Answer] = fetch, retry: Retry = Retry(), name: str = "evidra_live") -> type[DataSource]:
    """A data source class that asks through ``get``.

    Options: ``sources`` (comma-separated), ``query``, ``year_from``,
    ``year_to``, ``limit`` (records a source; empty: all), ``page_size``, and
    ``<source>.<option>`` for a source's own, keys for example.  As a stream it
    takes one source, ``pages_a_batch`` pages a batch, and resumes at its offset.
    """

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.options = options

        def partitions(self):
            return [_One(R.source_name(s)) for s in self.options.get("sources", ",".join(R.USUAL)).split(",")]

        def read(self, partition):
            o = self.options
            number = lambda k: int(o[k]) if o.get(k) else None
            search = L.Search(o["query"], number("year_from"), number("year_to"))
            own = {k.split(".", 1)[1]: v for k, v in o.items() if k.startswith(partition.source + ".")}
            yield from responses(partition.source, search, number("limit") if "limit" in o else 1000, number("page_size"), own, get, retry)

    class Pages(SimpleDataSourceStreamReader):
        """One service's pages as a stream; the offset is the number of pages taken.

        Pages before the offset are walked through again, as each names the
        next; with a cache they cost no request.
        """

        def __init__(self, options: dict):
            self.options = options

        def initialOffset(self):
            return {"page": 0}

        def _rows(self, start: int, end: int) -> list[tuple]:
            (source,) = (R.source_name(s) for s in self.options["sources"].split(","))
            rows = [r for r in itertools.islice(Reader(self.options).read(_One(source)), end) if r[1] > start]
            failed = [r[-1] for r in rows if r[-1] is not None]
            if failed:
                raise SourceError(failed[0])
            return rows

        def read(self, start):
            rows = self._rows(start["page"], start["page"] + int(self.options.get("pages_a_batch") or 10))
            return iter(rows), {"page": start["page"] + len(rows)}

        def readBetweenOffsets(self, start, end):
            return iter(self._rows(start["page"], end["page"]))

    class Live(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return SCHEMA

        def reader(self, schema):
            return Reader({k.lower(): v for k, v in self.options.items()})

        def simpleStreamReader(self, schema):
            return Pages({k.lower(): v for k, v in self.options.items()})

    return Live


def read_live(spark: SparkSession, search: L.Search, sources: tuple[str, ...] = R.USUAL, limit: int | None = 1000, page_size: int | None = None, options: dict[str, dict] | None = None, get: Callable[[Request], Answer] = fetch, retry: Retry = Retry()) -> DataFrame:
    """The responses of several services to one search."""
    spark.dataSource.register(live_source(get, retry))
    given = {"sources": ",".join(R.source_name(s) for s in sources), "query": search.expression, "limit": "" if limit is None else str(limit)}
    given |= {k: str(v) for k, v in (("year_from", search.year_from), ("year_to", search.year_to), ("page_size", page_size)) if v is not None}
    given |= {f"{R.source_name(s)}.{k}": str(v) for s, own in (options or {}).items() for k, v in own.items()}
    return spark.read.format("evidra_live").options(**given).load()

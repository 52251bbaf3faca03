"""Bibliographic views over the driver's tables, for queries that need records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROLE_TITLES = (" protocol", " randomized controlled trial", " follow-up", " subgroup", " systematic review", " conference", "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record a document: idx, title, authors, year, journal, abstract, identifiers, metadata.

    Exact copies share their DOI; one record in three has none, one in eleven
    no year.
    """
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    title = F.regexp_replace(F.split_part("text", F.lit("."), F.lit(1)), r"^\p{Zs}+|\p{Zs}+$", "")
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("journal-article", "preprint", "journal-article", "conference paper", "journal-article", "book chapter", "journal-article")]), (i % 7 + 1).cast("int"))
    return d.select(
        i.alias("idx"),
        title.alias("title"),
        F.array(F.concat(F.split_part(title, F.lit(" "), F.lit(1)), F.lit(" A")), F.concat("lang", F.lit(" B"))).alias("authors"),
        F.when(i % 11 != 0, (2000 + i % 25).cast("int")).alias("year"),
        F.col("source").alias("journal"),
        F.col("text").alias("abstract"),
        F.when(i % 3 != 0, F.concat(F.lit("10.5555/"), F.md5("text"))).alias("doi"),
        F.when(i % 5 == 0, F.substring(F.md5(title), 1, 8)).alias("pmid"),
        F.lit(None).cast("string").alias("wos_ut"),
        F.lit(None).cast("string").alias("scopus_eid"),
        F.lit(None).cast("string").alias("openalex_id"),
        F.array(F.struct(F.col("source").alias("source"), i.cast("string").alias("source_id"), F.lit("q").alias("query"), F.lit(None).cast("string").alias("retrieved_at"), F.lit(1).alias("rank"))).alias("source_hits"),
        F.create_map(
            F.lit("type"), kinds,
            F.lit("volume"), (i % 13).cast("string"),
            F.lit("pages"), F.length("text").cast("string"),
        ).alias("metadata"),
    )


RECORDS_SQL = """
records AS (
  SELECT doc_id AS idx, title, [split_part(title, ' ', 1) || ' A', lang || ' B'] AS authors,
    CASE WHEN doc_id % 11 <> 0 THEN CAST(2000 + doc_id % 25 AS INTEGER) END AS year, source AS journal, text AS abstract,
    CASE WHEN doc_id % 3 <> 0 THEN '10.5555/' || md5(text) END AS doi, CASE WHEN doc_id % 5 = 0 THEN substr(md5(title), 1, 8) END AS pmid,
    ['journal-article', 'preprint', 'journal-article', 'conference paper', 'journal-article', 'book chapter', 'journal-article'][doc_id % 7 + 1] AS kind,
    CAST(doc_id % 13 AS VARCHAR) AS volume, CAST(length(text) AS VARCHAR) AS pages, source, lang
  FROM (SELECT *, trim(split_part(text, '.', 1)) AS title FROM documents)
)"""


def studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report a customer that has orders: registry, acronym, size, country, recruitment years."""
    c, o, n = (table(spark, sf_dir, t) for t in ("customer", "orders", "nation"))
    years = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("size"), F.min(F.year("o_orderdate")).alias("y0"), F.max(F.year("o_orderdate")).alias("y1"))
    k = F.col("c_custkey")
    title = F.concat(F.lit("Effect of "), F.lower("c_mktsegment"), F.lit(" care in group "), (F.floor(k / 3)).cast("string"), F.element_at(F.array(*[F.lit(t) for t in ROLE_TITLES]), (k % 7 + 1).cast("int")))
    return c.join(years, k == F.col("o_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        k.alias("idx"), title.alias("title"), F.array(F.concat(F.lit("Author"), (k % 40).cast("string"), F.lit(" X"))).alias("authors"), (2000 + k % 9).cast("int").alias("year"),
        F.lit(None).cast("string").alias("journal"), F.concat(F.lit("Registered as NCT"), F.lpad(F.floor(k / 3).cast("string"), 8, "0"), F.when(k % 10 == 0, " and ISRCTN 12345678").otherwise("")).alias("abstract"),
        *[F.lit(None).cast("string").alias(x) for x in "doi pmid wos_ut scopus_eid openalex_id".split()],
        F.array(F.struct(F.lit("db").alias("source"), k.cast("string").alias("source_id"), F.lit("q").alias("query"), F.lit(None).cast("string").alias("retrieved_at"), F.lit(1).alias("rank"))).alias("source_hits"),
        F.create_map(F.lit("sample_size"), F.col("size").cast("string"), F.lit("country"), F.col("n_name"), F.lit("intervention"), F.col("c_mktsegment"), F.lit("recruitment_start"), F.col("y0").cast("string"), F.lit("recruitment_end"), F.col("y1").cast("string")).alias("metadata"),
    )


STUDIES_SQL = """
studies AS (
  SELECT c_custkey AS idx, 'Effect of ' || lower(c_mktsegment) || ' care in group ' || CAST(CAST(floor(c_custkey / 3) AS BIGINT) AS VARCHAR) ||
    [' protocol', ' randomized controlled trial', ' follow-up', ' subgroup', ' systematic review', ' conference', ''][c_custkey % 7 + 1] AS title,
    'author' || CAST(c_custkey % 40 AS VARCHAR) AS author, CAST(2000 + c_custkey % 9 AS INTEGER) AS year,
    'Registered as NCT' || lpad(CAST(CAST(floor(c_custkey / 3) AS BIGINT) AS VARCHAR), 8, '0') || CASE WHEN c_custkey % 10 = 0 THEN ' and ISRCTN 12345678' ELSE '' END AS abstract,
    size, n_name AS country, c_mktsegment AS intervention, y0, y1
  FROM customer JOIN (SELECT o_custkey, count(*) AS size, min(year(o_orderdate)) AS y0, max(year(o_orderdate)) AS y1 FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey
)"""


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files; named by a pattern, which may stand for one file or a folder."""
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")


def screening_events(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """A ledger from ``events``, the table or a stream of it: seq is the order of appending."""
    e = table(spark, sf_dir, "events") if events is None else events
    k = F.get_json_object("props", "$.k")
    kind = F.col("event_type")
    decision = F.when(kind == "view", "INCLUDE").when(kind.isin("click", "error"), "EXCLUDE").when(kind == "purchase", "MAYBE").otherwise("INCLUDE")
    code = F.element_at(F.array(*[F.lit(c) for c in ("WRONG_POPULATION", "WRONG_OUTCOME", "NOT_RETRIEVABLE", "OTHER")]), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(
        F.col("event_id").alias("seq"), F.concat(F.lit("R"), k).alias("record_id"), F.when(F.col("user_id") % 2 == 0, "TITLE_ABSTRACT").otherwise("FULL_TEXT").alias("stage"), decision.alias("decision"),
        F.concat(F.lit("rev"), (F.col("user_id") % 3).cast("string")).alias("reviewer"), F.when(decision == "EXCLUDE", code).alias("reason_code"), F.lit(None).cast("string").alias("reason_text"), F.expr("event_type = 'signup' AND event_id % 3 = 0").alias("adjudication"),
    )


EVENTS_SQL = """
ledger AS (
  SELECT event_id AS seq, 'R' || json_extract_string(props, '$.k') AS record_id, CASE WHEN user_id % 2 = 0 THEN 'TITLE_ABSTRACT' ELSE 'FULL_TEXT' END AS stage,
    CASE WHEN event_type = 'view' THEN 'INCLUDE' WHEN event_type IN ('click', 'error') THEN 'EXCLUDE' WHEN event_type = 'purchase' THEN 'MAYBE' ELSE 'INCLUDE' END AS decision,
    'rev' || CAST(user_id % 3 AS VARCHAR) AS reviewer,
    CASE WHEN event_type IN ('click', 'error') THEN ['WRONG_POPULATION', 'WRONG_OUTCOME', 'NOT_RETRIEVABLE', 'OTHER'][event_id % 4 + 1] END AS reason_code,
    event_type = 'signup' AND event_id % 3 = 0 AS adjudication
  FROM events
)"""

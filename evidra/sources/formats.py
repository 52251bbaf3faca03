"""Readers and writers of record files: delimited text, RIS, BibTeX, EndNote XML, JSON lines, bundles with hashes."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidra.functions import numbers as N
from evidra.functions import text as T
from evidra.plans import ordering
from evidra.plans.scratch import scratch_path

# What a column of a gold file may be called, after lower-casing and dropping all but letters and digits.
HEADERS = {
    "record_id": ("recordid", "id", "citationid", "refid"),
    "title": ("title", "ti", "articletitle", "primarytitle"),
    "authors": ("authors", "author", "au", "creator", "creators"),
    "year": ("year", "py", "publicationyear", "pubyear", "date", "publicationdate"),
    "journal": ("journal", "journaltitle", "secondarytitle", "source", "publication", "jo"),
    "abstract": ("abstract", "ab", "summary"),
    "doi": ("doi", "digitalobjectidentifier"),
    "pmid": ("pmid", "pubmedid"),
    "volume": ("volume", "vol", "vl"),
    "issue": ("issue", "number", "is"),
    "pages": ("pages", "page", "pagerange", "sp"),
    "database": ("database", "db", "sourcedatabase"),
    "gold_group": ("goldgroup", "duplicateid", "duplicategroup", "dedupgroup", "groupid", "publicationid", "clusterid", "matchid"),
    "removal_label": ("label", "goldlabel", "removallabel", "deduplabel", "classification"),
}
REMOVED, RETAINED = ("duplicate", "duplicates", "removed", "remove", "1", "true", "yes"), ("unique", "retained", "retain", "keep", "kept", "0", "false", "no")


def _ids() -> Column:
    return T.stable_record_id(*[F.col(c) for c in ("doi", "pmid", "wos_ut", "scopus_eid", "openalex_id", "title", "year", "authors")])


def export_rows(records: DataFrame, final: DataFrame | None = None, families: DataFrame | None = None) -> DataFrame:
    """The flat projection of records, with study ids and final decisions where they are given."""
    sources = F.array_join(F.array_sort(F.array_distinct(F.transform("source_hits", lambda h: h["source"]))), "; ")
    out = records.select(
        "idx", _ids().alias("record_id"), "title", T.text_or_empty("abstract").alias("abstract"), F.array_join(F.filter("authors", lambda a: a != ""), "; ").alias("authors"), F.coalesce(F.col("year").cast("string"), F.lit("")).alias("year"),
        *[T.text_or_empty(c).alias(c) for c in ("journal", "doi", "pmid", "wos_ut", "scopus_eid", "openalex_id")], sources.alias("sources"),
    )
    study = families.select("study_id", F.explode("member_indices").alias("idx")) if families is not None else None
    out = out.join(study, "idx", "left") if study is not None else out.withColumn("study_id", F.lit(None).cast("string"))
    if final is not None:
        by = final.groupBy("record_id").pivot("stage", ["TITLE_ABSTRACT", "FULL_TEXT"]).agg(F.first("decision"))
        out = out.join(by.toDF("record_id", "title_abstract_decision", "full_text_decision"), "record_id", "left")
    return out.withColumn("study_id", T.text_or_empty("study_id"))


def _clean(x: Column) -> Column:
    return F.nullif(T.squeeze(x.cast("string")), F.lit(""))


def _kind() -> Column:
    kind = F.lower(F.coalesce(T.metadata_text("metadata", "publication_type", "type"), F.lit("")))
    has = lambda w: F.contains(kind, F.lit(w))
    return F.when(has("conference"), "CONF").when(has("book"), "BOOK").when(has("thesis") | has("dissertation"), "THES").otherwise("JOUR")


def ris_record(label: Column | None = None) -> Column:
    """A record as RIS text, ending in an empty line; label: 1, 0 or null for screening tools."""
    tag = lambda name, value: F.concat(F.lit(f"{name}  - "), _clean(value))
    lines = [tag("TY", _kind()), tag("ID", _ids()), tag("TI", F.col("title")), F.concat_ws("\n", F.transform(F.coalesce("authors", F.array().cast("array<string>")), lambda a: tag("AU", a)))]
    lines += [tag(t, F.col(c)) for t, c in (("PY", "year"), ("JO", "journal"), ("AB", "abstract"), ("DO", "doi"))]
    lines += [tag("UR", F.concat(F.lit("https://doi.org/"), F.nullif("doi", F.lit("")))), tag("AN", F.concat(F.lit("PMID:"), F.nullif("pmid", F.lit(""))))]
    sources = F.array_sort(F.array_distinct(F.transform("source_hits", lambda h: h["source"])))
    lines.append(F.concat_ws("\n", F.transform(sources, lambda s: tag("N1", F.concat(F.lit("source:"), s)))))
    if label is not None:
        lines.append(tag("N1", F.when(label.isNull(), "ASReview_not_seen").when(label == 1, "ASReview_relevant").otherwise("ASReview_irrelevant")))
    lines.append(F.lit("ER  -\n\n"))
    return F.array_join(F.filter(F.array(*[F.nullif(x, F.lit("")) for x in lines]), lambda x: x.isNotNull()), "\n")


def _escaped(x: Column) -> Column:
    """The backslash first, then the other signs, those of its replacement included."""
    x = F.replace(x, F.lit("\\"), F.lit("\\textbackslash{}"))
    return F.regexp_replace(F.regexp_replace(x, r"([{}#%&_])", r"\\$1"), "[\n\r]", " ")


def bibtex_record() -> Column:
    name = F.regexp_extract(F.coalesce(F.get("authors", F.lit(0)), F.lit("")), "[A-Za-zÀ-ÿ0-9]+", 0)
    key = F.regexp_replace(F.concat(F.when(name == "", "record").otherwise(F.lower(name)), F.coalesce(F.nullif(F.col("year").cast("string"), F.lit("0")), F.lit("nd")), F.lit("_"), (F.col("idx") + 1).cast("string")), "[^a-zA-Z0-9:_-]+", "")
    parts = (("title", F.col("title")), ("author", F.array_join("authors", " and ")), ("journal", F.col("journal")), ("year", F.col("year").cast("string")), ("doi", F.col("doi")), ("abstract", F.col("abstract")))
    rows = F.filter(F.array(*[F.concat(F.lit(f"  {k} = {{"), _escaped(F.nullif(v, F.lit(""))), F.lit("}")) for k, v in parts]), lambda r: r.isNotNull())
    return F.concat(F.lit("@article{"), key, F.lit(",\n"), F.array_join(rows, ",\n"), F.lit("\n}\n\n"))


def write_text(texts: DataFrame, path: str) -> None:
    """One column of record texts, whose own line ends stay."""
    texts.write.option("lineSep", "\n").text(path)


def write_csv(rows: DataFrame, path: str, sep: str = ",") -> None:
    rows.write.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').csv(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.option("ignoreNullFields", False).json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes, sha256 of what lies below a folder, hashed where it is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify(found: DataFrame, lock: DataFrame) -> DataFrame:
    """path, expected, observed, ok against a lock (path, sha256)."""
    both = lock.select("path", F.col("sha256").alias("expected")).join(found.select("path", F.col("sha256").alias("observed")), "path", "left")
    return both.withColumn("ok", F.coalesce(F.col("expected") == F.col("observed"), F.lit(False)))


#: Encodings that are tried in turn; the last fits any bytes.
ENCODINGS = ("utf-8-sig", "cp1252", "latin-1")


def _encoding(content: bytes) -> str:
    for name in ENCODINGS[:-1]:
        try:
            content.decode(name)
        except UnicodeDecodeError:
            continue
        return name
    return ENCODINGS[-1]


def decoded(content: bytes) -> str:
    """A file's text by the first encoding that fits."""
    return content.decode(_encoding(content))


def in_utf8(spark: SparkSession, path: str) -> list[list[str]]:
    """Addresses at which the files below ``path`` can be read as UTF-8: their own, and apart for those in other encodings a copy's."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_encoding(c.as_py()) == ENCODINGS[0] for c in batch.column(1)], pa.bool_())], ["path", "plain"])

    def text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([decoded(c.as_py()) for c in batch.column(1)], pa.string())], ["value"])

    found = files.mapInArrow(look, "path string, plain boolean").collect()  # a row a file
    own, other = sorted(r["path"] for r in found if r["plain"]), sorted(r["path"] for r in found if not r["plain"])
    out = [own] if own else []
    if other:
        copies = scratch_path(spark, "utf8")
        files.where(F.col("path").isin(other)).sort("path").mapInArrow(text, "value string").write.option("maxRecordsPerFile", 1).text(copies)
        out.append([copies])
    return out


def _at(name: str = "__at") -> Column:
    """A sort key in the order of lines: file, place of the split, place in it."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n")).alias(name)


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None) -> DataFrame:
    """A delimited file, or several with one header, as text columns; ``idx`` follows the files and their lines.

    Without an encoding, each file is read by the first that fits.
    """
    sep = sep or ("\t" if path.lower().endswith((".tsv", ".txt")) else ",")
    parts = []
    for files in [[path]] if encoding else in_utf8(spark, path):
        raw = spark.read.option("header", True).option("multiLine", True).option("sep", sep).option("quote", '"').option("escape", '"').option("encoding", encoding or "UTF-8").csv(files)
        parts.append(raw.select(*[F.col(f"`{c}`").alias(c.lstrip("\ufeff")) for c in raw.columns], _at()))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return ordering.numbered(rows, "__at").drop("__at")


def _named(rows: DataFrame, given: dict[str, str]) -> dict[str, str | None]:
    short = lambda h: re.sub("[^a-z0-9]+", "", h.lower())
    at = {short(h): h for h in rows.columns if h != "idx"}
    return {name: given.get(name) or next((at[a] for a in aliases if a in at), None) for name, aliases in HEADERS.items()}


def gold_records(rows: DataFrame, **columns: str) -> DataFrame:
    """A gold file's rows as records with record_id, gold_group and gold_removed, as far as there are columns.

    Ids that repeat get a suffix from their second row on; a blank group is a
    group of its own; a label that is neither kind raises an error.
    """
    name = _named(rows, columns)
    if not name["title"]:
        raise ValueError(f"no title column among {rows.columns}")
    text = lambda n: F.nullif(F.trim(F.col(f"`{name[n]}`")), F.lit("")) if name[n] else F.lit(None).cast("string")
    raw = F.coalesce(text("record_id"), F.concat(F.lit("ROW"), (F.col("idx") + 1).cast("string")))
    label = F.lower(text("removal_label"))
    removed = F.when(label.isin(*REMOVED), True).when(label.isin(*RETAINED), False)
    if name["removal_label"]:
        removed = F.coalesce(removed, F.raise_error(F.concat(F.lit("unknown removal label: "), F.coalesce(label, F.lit("")))).cast("boolean"))
    again = F.row_number().over(Window.partitionBy("raw_id").orderBy("idx"))
    meta = F.map_filter(F.create_map(*[x for k in ("volume", "issue", "pages", "database") for x in (F.lit(k), text(k))]), lambda k, v: v.isNotNull())
    out = rows.select(
        "idx", raw.alias("raw_id"), text("title").alias("title"), T.split_gold_authors(text("authors")).alias("authors"), N.year_in(F.coalesce(text("year"), F.lit("")), "18|19|20|21").alias("year"), text("journal").alias("journal"), text("abstract").alias("abstract"),
        T.norm_doi(text("doi")).alias("doi"), text("pmid").alias("pmid"), *[F.lit(None).cast("string").alias(c) for c in "wos_ut scopus_eid openalex_id".split()], meta.alias("metadata"), text("gold_group").alias("g"), removed.alias("gold_removed"),
    )
    ided = out.withColumn("record_id", F.when(again > 1, F.concat("raw_id", F.lit("__ROW"), (F.col("idx") + 1).cast("string"))).otherwise(F.col("raw_id")))
    return ided.withColumn("gold_group", F.coalesce("g", F.concat(F.lit("__SINGLE_"), F.col("idx").cast("string")))).drop("g", "raw_id")


def screening_records(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records with their label, rejected rows): rows without title and abstract are rejected."""
    have = {c.lower(): c for c in rows.columns}
    first = lambda *names: F.coalesce(*[F.nullif(F.trim(F.col(f"`{have[n]}`")), F.lit("")) for n in names if n in have], F.lit(None).cast("string"))
    label = F.lower(first("included", "label", "label_included", "decision"))
    mark = F.when(label.isin("1", "true", "yes", "include", "included", "relevant"), 1).when(label.isin("0", "false", "no", "exclude", "excluded", "irrelevant"), 0)
    year = first("year", "publication_year", "py")
    out = rows.select(
        "idx", first("title", "ti", "primary_title").alias("title"), first("abstract", "ab").alias("abstract"), T.split_authors(first("authors", "author", "au")).alias("authors"), F.when(year.rlike(r"^\d{4}$"), year.cast("int")).alias("year"),
        first("journal", "source", "secondary_title").alias("journal"), T.norm_doi(first("doi")).alias("doi"), first("pmid").alias("pmid"), mark.alias("label"), F.when(label.isNotNull() & mark.isNull(), F.concat(F.lit("unknown label: "), label)).alias("warning"),
    )
    empty = F.col("title").isNull() & F.col("abstract").isNull()
    return out.where(~empty), out.where(empty).select("idx", F.lit("no title and no abstract").alias("warning"))


def read_ris(spark: SparkSession, path: str) -> DataFrame:
    """Records of RIS files: the text between two ER lines; lines without a tag continue the one before.

    Files are split at ER lines, so that a large one is read by many tasks;
    ``pos`` rises with a record's place in its file.
    """
    raw = spark.read.option("lineSep", "\nER  -").text(path).select(F.regexp_replace("value", "\r\n?", "\n").alias("value"), _at())
    # what is left of an ER line goes; files with other line ends are split here
    split = raw.select("__at", F.posexplode(F.split(F.regexp_replace("value", r"^(?!\ufeff?[A-Z0-9]{2}  -)[^\n]*\n", ""), r"(?m)^ER  -.*$")).alias("k", "body"))
    entries = split.select(F.col("__at.file").alias("file"), F.struct("__at.start", "__at.n", "k").alias("pos"), F.regexp_replace("body", "^\ufeff", "").alias("body")).where(F.col("body").rlike(r"(?m)^[A-Z0-9]{2}  -"))
    joined = F.regexp_replace("body", r"\n(?![A-Z0-9]{2}  -)[ \t]*", " ")
    all_of = lambda t: F.filter(F.transform(F.regexp_extract_all(joined, F.lit(rf"(?m)^(?:{t})  -[ ]?(.*)$"), F.lit(1)), lambda a: F.trim(a)), lambda v: v != "")
    first = lambda *ts: F.coalesce(*[F.get(all_of(t), F.lit(0)) for t in ts])
    out = entries.select(
        "file", "pos", first("TI", "T1", "CT").alias("title"), all_of("AU|A1").alias("authors"), N.year_in(first("PY", "Y1", "DA")).alias("year"), first("JO", "JF", "T2", "JA").alias("journal"), first("AB", "N2").alias("abstract"),
        T.norm_doi(first("DO")).alias("doi"), F.nullif(F.regexp_extract(first("AN"), r"PMID:\s*(\d+)", 1), F.lit("")).alias("pmid"), all_of("N1").alias("notes"),
    )
    return out.where("title IS NOT NULL OR abstract IS NOT NULL")


def read_endnote(spark: SparkSession, path: str) -> DataFrame:
    """Records of EndNote XML with gold_removed from the caption, which no other column carries."""
    style = "struct<style:array<string>>"
    schema = (
        f"`rec-number` string, database string, caption {style}, contributors struct<authors:struct<author:array<{style}>>>, titles struct<title:{style},`secondary-title`:{style}>, periodical struct<`full-title`:{style}>, "
        f"pages {style}, volume {style}, number {style}, dates struct<year:{style}>, `accession-num` {style}, abstract {style}, `electronic-resource-num` {style}"
    )
    # read by splits: up to each end of a record, then from the record's start
    ended = spark.read.option("lineSep", "</record>").text(path).select(F.regexp_extract("value", r"(?s)<record(?=[\s>]).*", 0).alias("value")).where("value <> ''")
    raw = ended.select(F.from_xml(F.concat("value", F.lit("</record>")), schema, {"ignoreSurroundingSpaces": "false"}).alias("r")).select("r.*")
    text = lambda c: _clean(F.concat_ws("", F.col(c + ".style")))
    caption = F.lower(F.coalesce(text("caption"), F.lit("")))
    known = F.when(caption == "duplicate", True).when(caption.isin("", "unique"), False)
    return raw.select(
        F.col("`rec-number`").alias("record_id"), text("titles.title").alias("title"), F.filter(F.transform("contributors.authors.author", lambda a: _clean(F.concat_ws("", a["style"]))), lambda a: a.isNotNull()).alias("authors"),
        N.year_in(F.coalesce(text("dates.year"), F.lit("")), "18|19|20|21").alias("year"), F.coalesce(text("periodical.`full-title`"), text("titles.`secondary-title`")).alias("journal"), text("abstract").alias("abstract"), T.norm_doi(text("`electronic-resource-num`")).alias("doi"),
        text("`accession-num`").alias("accession"), text("volume").alias("volume"), text("number").alias("issue"), text("pages").alias("pages"), F.coalesce(known, F.raise_error(F.concat(F.lit("unknown caption: "), caption)).cast("boolean")).alias("gold_removed"),
    )


def numbered(records: DataFrame) -> DataFrame:
    """One file's records with what gold records have: idx in the file's order, all columns, ids apart, groups of one."""
    rows = ordering.numbered(records.withColumn("__at", F.monotonically_increasing_id()), "__at").drop("__at")
    facts = [c for c in ("volume", "issue", "pages", "accession") if c in rows.columns]
    if "metadata" not in rows.columns:
        meta = F.create_map(*[x for c in facts for x in (F.lit(c), F.col(c).cast("string"))]) if facts else F.create_map().cast("map<string,string>")
        rows = rows.withColumn("metadata", F.map_filter(meta, lambda k, v: v.isNotNull()))
    for c in ("doi", "pmid", "wos_ut", "scopus_eid", "openalex_id", "journal", "abstract"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    raw = F.coalesce(F.nullif(F.trim("record_id"), F.lit("")), F.concat(F.lit("ROW"), (F.col("idx") + 1).cast("string")))
    rows = rows.withColumn("__raw", raw)
    again = F.row_number().over(Window.partitionBy("__raw").orderBy("idx")) > 1
    rows = rows.withColumn("record_id", F.when(again, F.concat("__raw", F.lit("__ROW"), (F.col("idx") + 1).cast("string"))).otherwise(F.col("__raw")))
    return rows.withColumn("gold_group", F.concat(F.lit("__SINGLE_"), F.col("idx").cast("string"))).drop("__raw", *facts)


LEDGER = "event_id string, record_id string, stage string, decision string, reviewer string, timestamp string, reason_code string, reason_text string, note string, adjudication boolean, metadata map<string,string>"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Events of a JSON-lines ledger in one file or several; seq follows the files by name and their lines, without gaps."""
    lines = spark.read.text(path).select(_at(), "value").where("trim(value) <> ''")
    events = lines.select("__at", F.from_json("value", LEDGER).alias("e")).select("__at", "e.*")
    return ordering.numbered(events.withColumn("adjudication", F.coalesce("adjudication", F.lit(False))), "__at", name="seq").drop("__at")


def ledger_lines(events: DataFrame) -> DataFrame:
    """One JSON text an event, keys in order of their names."""
    names = sorted(c for c in events.columns if c != "seq")
    return events.select("seq", F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("line"))


def bundle(spark: SparkSession, folder: str, tables: dict[str, DataFrame], facts: dict | None = None) -> dict:
    """Write tables as CSV below a folder and return the manifest of what was written."""
    for name, rows in tables.items():
        flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in rows.dtypes]
        write_csv(rows.select(*flat), f"{folder}/{name}")
    found = [r.asDict() for r in manifest(spark, folder).where("path LIKE '%part-%'").orderBy("path").collect()]
    text = json.dumps({"facts": facts or {}, "files": found}, sort_keys=True)
    return {"manifest": text, "sha256": hashlib.sha256(text.encode()).hexdigest(), "files": found}


def union_sources(frames: dict[str, DataFrame]) -> DataFrame:
    """Records of several sources, one under the other, missing columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d.withColumn("source", F.lit(s)) for s, d in frames.items()])

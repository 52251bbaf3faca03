"""What failed or differed from SQL on larger tables and odd rows."""

from __future__ import annotations

import pytest

from evidra.plans import catalogue, interchange, oracles
from tests.test_review import compared

QUERIES, ORACLES = catalogue.QUERIES | interchange.QUERIES, oracles.ORACLES | interchange.ORACLES


def written(spark, folder, rows, schema, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / "parts"))
    (part,) = (folder / "parts").glob("*.parquet")
    part.rename(folder / f"{name}.parquet")
    return str(folder)


def documents(spark, folder, texts):
    """A documents table of these texts, and the other tables as in the smallest set."""
    return written(spark, folder, [(i, t, "en", "web", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long", "documents")


def same(spark, folder, name):
    """Compares with SQL over the tables of the folder; absent ones are of no account to the query."""
    import duckdb

    from pathlib import Path

    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        if not (at := Path(folder, f"{t}.parquet")).exists():
            duckdb.sql(f"COPY (SELECT 1 AS x) TO '{at}' (FORMAT parquet)")
    compared(spark, folder, QUERIES[name], ORACLES[name])


def test_blocking_recall_counts_all_pairs_of_many_records(spark):
    from pyspark.sql import functions as F

    from evidra.operators import metrics

    pair = spark.createDataFrame([(1, 2)], "left_index long, right_index long")
    assert metrics.blocking_recall(pair, pair, 60_000).first().pair_reduction == pytest.approx(1 - 1 / (60_000 * 59_999 / 2))
    assert metrics.blocking_recall(pair, pair, F.lit(60_000)).first().recall == 1.0


def test_leading_years_of_long_numbers(spark, tmp_path):
    import datetime

    rows = [(i, k, "1-URGENT", datetime.date(1995, 1, 2)) for i, k in enumerate((7, 999, 1000, 2999, 3000, 3001, 9999, 10000, 30000, 30001, 30009, 30010, 300000, 300001, 299999))]
    same(spark, written(spark, tmp_path, rows, "o_orderkey long, o_custkey long, o_orderpriority string, o_orderdate date", "orders"), "year_parsers")


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES) if n.endswith("_records") and n != "merge_records"])
def test_records_of_documents_without_a_title(spark, tmp_path, name):
    same(spark, documents(spark, tmp_path, ["", ".x", "Alpha beta. c", " . c", " x y. c", "　. c", "word", "x y z. c"]), name)


def test_decisive_features_decide_as_exact_ones(spark, sf):
    from evidra.operators import publication
    from evidra.plans import views

    for least in (0.75, 0.985):
        r, config = views.records(spark, sf).where("idx < 500"), publication.Config(exhaustive_limit=2)
        rows = lambda d: {(e.left_index, e.right_index): (e.decision, e.probability) if e.probability >= least else None for e in publication.assess(d, config).collect()}
        exact = rows(publication.features(publication.compared(r, config), config))
        assert rows(publication.decisive(r, config, least)) == exact and any(exact.values()) and not all(exact.values())


@pytest.mark.parametrize("name", ["gold_file", "endnote_file"])
def test_files_in_several_parts(spark, sf, monkeypatch, name):
    monkeypatch.setattr(interchange, "IN_FILE", 40)
    written = []
    monkeypatch.setattr(interchange, "scratch_path", lambda s, label, f=interchange.scratch_path: written.append(f(s, label)) or written[-1])
    compared(spark, sf, QUERIES[name], ORACLES[name])
    assert spark.read.text(written[0]).inputFiles()[1:]


def test_components_of_edges_that_are_joined_in_pieces(spark, monkeypatch):
    import pyarrow as pa

    from evidra.plans import components

    monkeypatch.setattr(components, "HELD", 2)
    batch = lambda *e: pa.RecordBatch.from_arrays([pa.array([x for x, _ in e], pa.int64()), pa.array([y for _, y in e], pa.int64())], ["a", "b"])
    got = [list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)) for b in components._joined(iter([batch((3, 2), (2, 1)), batch((9, 3))]))]
    assert got == [[(3, 1), (2, 1), (1, 1)], [(9, 3), (3, 3)]]


def test_inverted_index_of_each_row(spark, tmp_path):
    same(spark, documents(spark, tmp_path, ["a b a", "", " \n", "c  a\tc "]), "abstract_from_inverted_index")


def test_pairs_of_blocks_in_several_parts(spark, monkeypatch):
    """Blocks whose parts meet two by two, in a few pairs at once, give each pair once, smaller index first."""
    from evidra.operators import blocking

    monkeypatch.setattr(blocking, "PART", 3)
    monkeypatch.setattr(blocking, "AT_ONCE", 5)
    blocks = {f"b{k}": list(range(k, 40, k)) for k in (1, 2, 3, 7, 39)} | {"c": [5, 90], "d": [91]}
    keys = spark.createDataFrame([(i, b) for b, members in blocks.items() for i in members], "idx long, block_key string")
    for cap in (None, 12):
        want = {(i, j) for m in blocks.values() if cap is None or len(m) <= cap for i in m for j in m if i < j}
        got = [(r.left_index, r.right_index) for r in blocking.blocked_pairs(keys, cap).collect()]
        assert len(got) == len(want) and set(got) == want
    # of 39 members 13 parts meet: no place holds more than two of them
    monkeypatch.setattr(blocking, "_meet", lambda make: lambda batches: (b.select(["key", "place", "idx"]) for b in batches))
    rows = blocking.met(keys, None, None, blocking._indices, "key long, place long, idx long").groupBy("key", "place").count().collect()
    assert max(r["count"] for r in rows) < 25 and len(rows) > 60


def test_matching_characters_of_many_pairs():
    """As ``SequenceMatcher``, also where the right text is so long that frequent signs start no run."""
    import random
    from difflib import SequenceMatcher

    from evidra.functions import matching

    random.seed(3)
    text = lambda signs, n: "".join(random.choices(signs, k=random.randint(0, n)))
    pairs = [(text("ab c", n), text("abcdefghijklmnopqrstuvwxyz ", m)) for n in (12, 300) for m in (12, 60, 500) for _ in range(40)]
    pairs += [(b[3:90] + a, b) for a, b in pairs] + [("a", None), (None, "b"), ("é b", "é c"), ("x" * 150, "x" * 170), ("ab" * 400, "ba" * 130)]
    want = [None if None in p else SequenceMatcher(None, *p).ratio() for p in pairs]
    got = matching.ratios([a for a, _ in pairs], [b for _, b in pairs])
    assert [None if x != x else x for x in got.tolist()] == want


def test_features_made_where_members_meet(spark, sf, monkeypatch):
    """Those of the expressions, with lists and identifiers that are null, empty or long."""
    from pyspark.sql import functions as F

    from evidra.operators import publication
    from evidra.plans import views

    monkeypatch.setattr(publication._Sets, "SHORT", 4)
    i = F.col("idx")
    r = views.records(spark, sf).where("idx < 150").withColumn("openalex_id", F.when(i % 4 == 0, F.concat(F.lit("W"), (i % 20).cast("string")))).withColumn("year", F.when(i % 9 != 0, F.col("year")))
    r = r.withColumn("authors", F.when(i % 10 == 0, F.array().cast("array<string>")).otherwise(F.col("authors"))).withColumn("title", F.when(i % 17 == 0, "").otherwise(F.col("title")))
    for characters in (False, True):
        config = publication.Config(exhaustive_limit=2, characters=characters)
        rows = lambda d: sorted(repr(x) for x in d.select("left_index", "right_index", "features", "same_title", "same_id").collect())
        got, want = rows(publication.scored(r, config)), rows(publication.features(publication.compared(r, config), config))
        assert got == want and got


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["idx", "cluster_id", "representative_index", "cluster_size"]

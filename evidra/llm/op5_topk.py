"""Exact top-k by a vector-approximation file.

Equal vectors form a class, which is searched once and stands for its members;
so is a query's vector, however many queries have it.  The file holds each
class's coordinates quantised to cells, a byte each.  A first scan of the
cells bounds every score from below and gives, for each query, a score that
enough classes are sure to reach.  A second scan emits the classes whose upper
bound comes up to it.  Of these, exact vectors are fetched in order of their
upper bounds: the best first, and then only those whose bound is not below the
kth exact score, which makes the result certain.

The cells' bounds are quantiles of a sample (``SAMPLE`` numbers, the rows with
the least hash) between the exact ends of each coordinate; they decide how
much is read, never what is found.  Scores are exact: in floating point only
where it holds every integer, in 64-bit integers where these hold the sum, and
else in integers of any size.

Defined cases: vectors that are null, empty, or hold a null or a non-finite
component take no part; a vector is compared with those of its own length, so
each length is a table of its own; an id may repeat, and its rows are
candidates each, but not for the queries of that id; rows that repeat a
query's id are one query, which has the best of all of them; ties go to the
smaller id; a component or score that is no 64-bit integer raises an error; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bloom_filter, drop_scratch, materialize, pick

CELLS = 256
#: Numbers in the sample that the cells are fitted to.
SAMPLE = 1 << 21
#: Vectors in a block of the file, and queries in a block of queries.
BLOCK, QUERIES = 4096, 1024
#: Ways into which the file is dealt, each of which meets a copy of every block of queries: so many at least, and as
#: many more as keep a way to so many blocks.
LANES, IN_LANE = 32, 64
#: Exact vectors that are fetched for a query at first.
FIRST = 16
_EXACT = 2.0**53


def integers(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """id, d, key, v: the vectors that take part, floor(scale * x) in eight bytes a component, with the hash of the whole."""
    usable = "e IS NOT NULL AND size(e) > 0 AND forall(e, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    rows = pick(df, key, vector).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("e")).where(usable).where("id IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("e")
            ends = found.offsets.to_numpy()
            x = np.floor(scale * found.values.to_numpy(zero_copy_only=False))
            if (np.abs(x) >= 2.0**63).any():
                raise OverflowError("a component is no 64-bit integer")
            raw, v = x.astype("<i8").tobytes(), []
            for a, b in zip(ends, ends[1:]):
                v.append(raw[8 * a : 8 * b])
            keys = [xxhash.xxh3_128_digest(r) for r in v]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array((ends[1:] - ends[:-1]).astype(np.int32)), pa.array(keys, pa.binary()), pa.array(v, pa.binary())], ["id", "d", "key", "v"])

    return rows.mapInArrow(run, "id long, d int, key binary, v binary")


def _stacked(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, d)


def grid(classes: DataFrame, d: int, cells: int = CELLS) -> np.ndarray:
    """The cells' bounds, d rows of cells + 1 numbers; a cell holds the integers from its bound to before the next."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for batch in batches:
            if batch.num_rows:
                v = _stacked(batch.column("v"), d)
                low = v.min(0) if low is None else np.minimum(low, v.min(0))
                high = v.max(0) if high is None else np.maximum(high, v.max(0))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(low), pa.array(high)], ["i", "low", "high"])

    found = classes.select("v").mapInArrow(ends, "i int, low long, high long").groupBy("i").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
    low, high = np.empty(d), np.empty(d)
    for r in found:
        low[r["i"]], high[r["i"]] = r["low"], r["high"]
    sample = classes.select("key", "v").orderBy(F.xxhash64("key")).limit(max(1, SAMPLE // d)).select("v").toArrow()
    v = _stacked(sample.column("v"), d)
    inner = np.ceil(np.quantile(v, np.arange(1, cells) / cells, axis=0, method="lower")).T
    # a bound beyond 2^53 may be rounded; the ends are moved out by what rounding can take
    reach = np.maximum(np.abs(low), np.abs(high)) * 2.0**-52
    return np.concatenate([np.floor(low - reach)[:, None], inner, np.ceil(high + reach)[:, None] + 1], 1)


def file(classes: DataFrame, bounds: np.ndarray, block: int | None = None) -> DataFrame:
    """The vector-approximation file: the ids of the classes and their cells, block by block."""
    d, cells, block = len(bounds), bounds.shape[1] - 1, block or BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                v = _stacked(part.column("v"), d)
                q = np.stack([np.searchsorted(bounds[i], v[:, i], "right") - 1 for i in range(d)], 1).clip(0, cells - 1)
                yield pa.RecordBatch.from_arrays([pa.array([part.column("cls").to_numpy().astype("<i8").tobytes()], pa.binary()), pa.array([q.astype(np.uint8).tobytes()], pa.binary())], ["ids", "cells"])

    return materialize(classes.select("cls", "v").mapInArrow(run, "ids binary, cells binary"), "vafile")


def query_blocks(rows: DataFrame, lanes: int, size: int | None = None) -> DataFrame:
    """lane, qids, q, least: the queries (cls, v, least) in blocks, one copy a lane of the file."""
    size = size or QUERIES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                ids, least = part.column("cls").to_numpy().astype("<i8"), part.column("least").to_numpy().astype("<f8")
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (ids.tobytes(), b"".join(part.column("v").to_pylist()), least.tobytes())], ["qids", "q", "least"])

    blocks = materialize(rows.select("cls", "v", "least").mapInArrow(run, "qids binary, q binary, least binary"), "queries")
    return blocks.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))


def _bounded(cells: bytes, q: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of each vector of the block with each query, on the safe side of rounding."""
    d = len(bounds)
    at = np.frombuffer(cells, np.uint8).reshape(-1, d).astype(int)
    rows = np.arange(d)
    lo, hi = bounds[rows, at], bounds[rows, at + 1] - 1
    up, down = np.maximum(q, 0).T, np.minimum(q, 0).T
    reach = np.abs(bounds).max(1) @ np.abs(q).T
    slack = np.where(reach < _EXACT, 0.0, reach * (d + 2) * 2.0**-51)
    return lo @ up + hi @ down - slack, hi @ up + lo @ down + slack


def _sure(bounds: np.ndarray, k: int):
    """For each query, the k best lower bounds in a lane, kept block by block while a lane's blocks meet the same queries."""
    d = len(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best, ids = None, np.empty(0), np.empty(0)

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, len(best))), pa.array(best.T.ravel())], ["cls", "low"])

        for batch in batches:
            for lane, cells, qids, q in zip(batch.column("lane").to_pylist(), *(batch.column(c) for c in ("cells", "qids", "q")), strict=True):
                qids = qids.as_py()
                if (lane, qids) != now:
                    if now is not None:
                        yield told()
                    now, ids = (lane, qids), np.frombuffer(qids, "<i8")
                    best = np.empty((0, len(ids)))
                low = _bounded(cells.as_py(), np.frombuffer(q.as_py(), "<i8").reshape(-1, d).astype(float), bounds)[0]
                best = np.concatenate([best, low])
                if len(best) > k:
                    best = -np.partition(-best, k - 1, 0)[:k]
        if now is not None:
            yield told()

    return run


def _possible(bounds: np.ndarray):
    """query, cls, high: the classes whose upper bound comes up to what is sure."""
    d = len(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, cells, qids, q, least in zip(*(batch.column(c) for c in ("ids", "cells", "qids", "q", "least")), strict=True):
                ids, qids = np.frombuffer(ids.as_py(), "<i8"), np.frombuffer(qids.as_py(), "<i8")
                high = _bounded(cells.as_py(), np.frombuffer(q.as_py(), "<i8").reshape(-1, d).astype(float), bounds)[1]
                i, j = np.nonzero(high >= np.frombuffer(least.as_py(), "<f8"))
                yield pa.RecordBatch.from_arrays([pa.array(qids[j]), pa.array(ids[i]), pa.array(high[i, j])], ["query", "cls", "high"])

    return run


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """query, cls, score: exact inner products of q and v."""
    for batch in batches:
        scores = []
        for q, v in zip(batch.column("q").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = np.frombuffer(q, "<i8"), np.frombuffer(v, "<i8")
            if np.abs(a.astype(float)) @ np.abs(b.astype(float)) < 2.0**62:
                scores.append(int(a @ b))
            else:
                scores.append(sum(x * y for x, y in zip(a.tolist(), b.tolist())))
                if not -(1 << 63) <= scores[-1] < 1 << 63:
                    raise OverflowError("a score is no 64-bit integer")
        yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("cls"), pa.array(scores, pa.int64())], ["query", "cls", "score"])


def _fetched(wanted: DataFrame, classes: DataFrame) -> DataFrame:
    """The exact scores of the wanted (query, cls); only vectors of these are moved."""
    ids = materialize(wanted.select("cls").union(wanted.select(F.col("query"))).distinct(), "ids")
    vectors = materialize(bloom_filter(classes.select("cls", "v"), "cls", ids).join(ids, "cls", "left_semi"), "exact")
    paired = wanted.select("query", "cls").join(vectors, "cls").join(vectors.select(F.col("cls").alias("query"), F.col("v").alias("q")), "query")
    return materialize(paired.select("query", "cls", "q", "v").mapInArrow(_products, "query long, cls long, score long"), "scores")


def search(classes: DataFrame, queries: DataFrame, d: int, k: int) -> tuple[DataFrame, dict[str, int]]:
    """query, cls, score of the k best classes for each class that is a query, ties to the smaller cls; and what was read.

    classes: cls, key, v, all of one length; queries: cls.
    """
    bounds = grid(classes, d)
    blocks = file(classes, bounds)
    lanes = max(LANES, -(-blocks.count() // IN_LANE))
    va = blocks.withColumn("lane", F.pmod(F.xxhash64("ids"), F.lit(lanes)).cast("int"))
    asked = materialize(classes.join(queries, "cls", "left_semi").select("cls", "v"), "asked")
    first = query_blocks(asked.withColumn("least", F.lit(float("-inf"))), lanes)
    low = first.hint("merge").join(va.select("lane", "cells"), "lane").select("lane", "cells", "qids", "q").mapInArrow(_sure(bounds, k), "cls long, low double")
    best = Window.partitionBy("cls").orderBy(F.desc("low"))
    kth = materialize(low.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select("cls", F.col("low").alias("least")), "least")
    second = query_blocks(asked.join(kth, "cls", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf")))), lanes)
    met = second.hint("merge").join(va, "lane").select("ids", "cells", "qids", "q", "least")
    ranked = Window.partitionBy("query").orderBy(F.desc("high"), "cls")
    possible = met.mapInArrow(_possible(bounds), "query long, cls long, high double")
    possible = materialize(possible.withColumn("place", F.row_number().over(ranked)), "possible")
    scores = _fetched(possible.where(F.col("place") <= max(FIRST, 2 * k)), classes)
    top = Window.partitionBy("query").orderBy(F.desc("score"), "cls")
    certain = scores.withColumn("r", F.row_number().over(top)).where(F.col("r") == k).select("query", F.col("score").cast("double").alias("certain"))
    # the double below the kth score, where it cannot be the score itself
    rest = possible.where(F.col("place") > max(FIRST, 2 * k)).join(certain, "query", "left")
    slack = F.when(F.abs("certain") < F.lit(_EXACT), 0.0).otherwise(F.abs("certain") * F.lit(2.0**-51))
    more = materialize(rest.where(F.col("certain").isNull() | (F.col("high") >= F.col("certain") - slack)).select("query", "cls"), "more")
    read = {"queries": asked.count(), "classes": classes.count(), "possible": possible.count(), "late": more.count()}
    if read["late"]:
        scores = scores.union(_fetched(more, classes))
    for used in (blocks, kth):
        drop_scratch(used)
    return scores.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k).drop("r"), read


def searched(df: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> tuple[DataFrame, list[dict[str, int]]]:
    """(query_id, rank, vec_id, score), and for each length what was read: queries, classes, and pairs of them by their bounds."""
    spark = df.sparkSession
    vectors = materialize(integers(df, key, vector, scale), "vectors")
    rows = materialize(vectors.groupBy("d", "key", "id").agg(F.count(F.lit(1)).alias("m")), "members")
    # a class is named by its least id and, as an id may repeat, by a number of its own
    classes = vectors.groupBy("d", "key").agg(F.min("id").alias("least"), F.first("v").alias("v"))
    classes = materialize(classes.repartitionByRange("least", "key").sortWithinPartitions("least", "key").withColumn("cls", F.monotonically_increasing_id()), "classes")
    names = classes.select("d", "key", "cls")
    asking = materialize(rows.where(F.col("id") % every == 0).join(names, ["d", "key"]).select(F.col("id").alias("query_id"), "cls", "d", "m"), "asking")
    own = asking.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    found, read = spark.createDataFrame([], "query long, cls long, score long"), []
    for d in sorted(r["d"] for r in asking.select("d").distinct().collect()):
        best, seen = search(classes.where(F.col("d") == d).select("cls", "key", "v"), asking.where(F.col("d") == d).select("cls").distinct(), d, k + own)
        found, read = found.union(best), [*read, {"length": d} | seen]
    found = materialize(found, "found")
    # of a class, the rows of the least ids: enough for k, whichever id is left out
    few = Window.partitionBy("cls").orderBy("id")
    wanted = found.select("cls").distinct()
    members = rows.join(names.join(wanted, "cls", "left_semi"), ["d", "key"]).select("cls", "id", F.least("m", F.lit(k)).alias("copies"))
    members = materialize(members.withColumn("r", F.row_number().over(few)).where(F.col("r") <= k + 1).drop("r"), "few")
    pairs = asking.join(found.withColumnRenamed("cls", "hit"), asking["cls"] == found["query"]).select("query_id", "hit", "score", F.col("m").alias("times"))
    pairs = pairs.join(members.withColumnRenamed("cls", "hit"), "hit").where("id <> query_id")
    copies = pairs.select("query_id", F.col("id").alias("vec_id"), "score", F.explode(F.sequence(F.lit(1), F.least(F.col("copies") * F.col("times"), F.lit(k)).cast("int"))))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = copies.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    return out, read


def top_k(df: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score."""
    return searched(df, k, every, key, vector, scale)[0]

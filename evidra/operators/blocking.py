"""Candidate pairs: exhaustive, or through blocking keys with a cap on a block's size.

Keys are derived once and written as 64-bit hashes; sizes are counted before
members meet, so a block above the cap is never joined.  Two records that
share several blocks make their pair in the first of them, so pairs are
distinct as they are made.  That blocks above the cap are left out is a rule
of record linkage here: ``cap=None`` lifts it, and the engines report the
blocks in ``Result.dropped_blocks``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.functions import text as T
from evidra.plans.scratch import materialize

#: Members above which a block makes no pairs, unless a caller lifts the cap.
CAP = 500


def _years(prefix: str, key: Column, year: Column) -> Column:
    return F.when(key.isNotNull() & year.isNotNull(), F.transform(F.array(year - 1, year, year + 1), lambda y: F.concat_ws(":", F.lit(prefix), key, y.cast("string"))))


def _one(prefix: str, *parts: Column) -> Column:
    some = parts[0].isNotNull()
    for p in parts[1:]:
        some = some & p.isNotNull()
    return F.when(some, F.array(F.concat_ws(":", F.lit(prefix), *parts)))


def publication_keys(records: DataFrame) -> DataFrame:
    """(idx, block_key) by identifiers, title, title signature and year, author and year, place in a journal."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    filled = lambda c: F.nullif(c, F.lit(""))
    words = F.slice(F.array_sort(T.substantive_tokens("title")), 1, 4)
    # a step of their own: what several keys are made of is computed once a record
    parts = records.select(
        "idx", *[blank(c).alias(c) for c in "doi pmid wos_ut scopus_eid openalex_id".split()], "year", filled(T.norm_folded("title")).alias("title"), filled(F.array_join(words, "|")).alias("sign"),
        T.lead_author_key("authors").alias("lead"), filled(T.norm_folded("journal")).alias("journal"), T.norm_metadata("volume").alias("volume"), T.norm_metadata("pages", "page", "page_range").alias("pages"),
    )
    families = [
        _one("doi", F.col("doi")),
        *[_one(c, F.lower(c)) for c in "pmid wos_ut scopus_eid openalex_id".split()],
        _one("title_exact", F.col("title")),
        _years("title_sig_year", F.col("sign"), F.col("year")),
        F.when(F.col("year").isNull(), _one("title_sig", F.col("sign"))),
        _years("author_year", F.col("lead"), F.col("year")),
        _one("jvp", F.col("journal"), F.col("volume"), F.col("pages")),
    ]
    keys = F.flatten(F.filter(F.array(*families), lambda k: k.isNotNull()))
    return parts.select("idx", F.explode(F.array_distinct(keys)).alias("block_key"))


def study_keys(records: DataFrame, registry: str = "registry_ids", acronyms: str = "acronyms") -> DataFrame:
    """(idx, block_key) by registration, acronym, author and five-year band, title words."""
    authors = F.slice(F.array_sort(T.study_author_keys("authors")), 1, 2)
    band = F.floor(F.coalesce(F.col("year"), F.lit(0)) / 5)
    banded = F.flatten(F.transform(authors, lambda a: F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.concat_ws(":", F.lit("author"), a, (band + d).cast("string")))))
    words = F.slice(F.array_sort(T.study_tokens("title")), 1, 3)
    keys = F.concat(
        F.transform(F.col(registry), lambda r: F.concat(F.lit("registry:"), r)),
        F.transform(F.col(acronyms), lambda r: F.concat(F.lit("acronym:"), r)),
        banded,
        F.transform(words, lambda w: F.concat(F.lit("title:"), w)),
    )
    return records.select("idx", F.explode(F.array_distinct(keys)).alias("block_key"))


def block_sizes(keys: DataFrame) -> DataFrame:
    return keys.groupBy("block_key").agg(F.count_distinct("idx").alias("members"))


def dropped_blocks(keys: DataFrame, cap: int | None = CAP) -> DataFrame:
    sizes = block_sizes(keys)
    return sizes.where(F.col("members") > cap) if cap is not None else sizes.limit(0)


def _held(keys: DataFrame, cap: int | None, carried: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(idx, keys, facts) of the members of blocks that make pairs, and (key, members) of these blocks."""
    hashed = materialize(keys.select("idx", F.xxhash64("block_key").alias("key")).distinct(), "keys")
    sizes = hashed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    fit = sizes if cap is None else sizes.where(F.col("members") <= cap)
    held = hashed.join(fit.select("key"), "key", "left_semi").groupBy("idx").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    if carried is not None:
        held = held.join(carried.select("idx", F.struct(*[c for c in carried.columns if c != "idx"]).alias("facts")), "idx")
    return materialize(held, "members"), fit


def blocked_pairs(keys: DataFrame, cap: int | None = CAP, carried: DataFrame | None = None) -> DataFrame:
    """Distinct (left_index < right_index) that share a block of at most ``cap`` members; of any size without a cap.

    keys: (idx, block_key), no row twice.  carried: (idx, ...) of every record;
    its columns come with the pairs as structs left and right.  They travel
    with the members of blocks, so what is moved grows with the records and
    their keys; pairs are made where members meet and are not moved.
    """
    if carried is None:
        kind = keys.schema["idx"].dataType.simpleString()
        return met(keys, cap, None, _indices, f"left_index {kind}, right_index {kind}")
    held, _ = _held(keys, cap, carried)
    # both sides are alike but for names, so that members are dealt out once
    side = lambda name: held.select(F.col("idx").alias(f"{name}_index"), F.col("keys").alias(f"{name}_keys"), F.col("facts").alias(name), F.explode("keys").alias("key"))
    first = F.array_min(F.array_intersect("left_keys", "right_keys")) == F.col("key")
    both = side("left").join(side("right").withColumnRenamed("key", "other"), F.col("key") == F.col("other")).where((F.col("left_index") < F.col("right_index")) & first)
    return both.select("left_index", "right_index", "left", "right")


#: Members of a part of a block; parts of larger blocks meet two by two, each two in a place of their own.
PART = 2000
#: Pairs that are made at once, and those that a task makes if they take no time to speak of.
AT_ONCE, IN_TASK = 1 << 16, 4_000_000
#: Of the rows of members: what makes a batch of the places of left and right ones.
Make = Callable[[pa.Table], Callable[[np.ndarray, np.ndarray], pa.RecordBatch]]


def met(keys: DataFrame, cap: int | None, carried: DataFrame | None, make: Make, schema: str, in_task: int = IN_TASK) -> DataFrame:
    """What ``make`` says of the pairs of ``blocked_pairs``, with ``schema``; only this leaves the place where members meet."""
    held, fit = _held(keys, cap, carried)
    at = held.select("idx", F.explode("keys").alias("key"), "keys", *held.columns[2:])
    if cap is None or cap > PART:
        large = fit.where(F.col("members") > PART).select("key", F.ceil(F.col("members") / PART).alias("parts"))
        dealt = at.join(large, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("idx"), "parts"))
        at = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        at = at.withColumn("place", F.least("own", "other") * F.col("parts") + F.greatest("own", "other"))
    else:
        at = at.select("*", *[F.lit(0).cast("long").alias(c) for c in ("own", "other", "place")])
    at = at.select("key", "place", "own", (F.col("own") != F.col("other")).alias("crossed"), *held.columns)
    pairs = fit.agg(F.sum(F.col("members") * (F.col("members") - 1) / 2)).first()[0] or 0
    spread = max(int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(4000, int(pairs / in_task)))
    return at.repartition(spread, "key", "place").sortWithinPartitions("key", "place", "own", "idx").mapInArrow(_meet(make), schema)


def _indices(rows: pa.Table) -> Callable[[np.ndarray, np.ndarray], pa.RecordBatch]:
    idx = rows.column("idx").combine_chunks()
    return lambda left, right: pa.RecordBatch.from_arrays([idx.take(pa.array(left)), idx.take(pa.array(right))], ["left_index", "right_index"])


def _meet(make: Make) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_rows: list[pa.RecordBatch] = []
        for batch in batches:
            open_rows.append(batch)
            rows = pa.Table.from_batches(open_rows).combine_chunks()
            ends = _changes(rows, "key", "place")
            # the last place may go on
            whole = int(ends[-2]) if len(ends) > 1 else 0
            if whole:
                yield from _pairs(rows.slice(0, whole).combine_chunks(), make)
                open_rows = rows.slice(whole).combine_chunks().to_batches()
        if open_rows:
            yield from _pairs(pa.Table.from_batches(open_rows).combine_chunks(), make)

    return run


def _changes(rows: pa.Table, *names: str) -> np.ndarray:
    """The ends of runs of rows that are alike in these columns."""
    new = np.zeros(rows.num_rows, bool)
    for n in names:
        x = rows.column(n).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(new), rows.num_rows)


def _pairs(rows: pa.Table, make: Make) -> Iterator[pa.RecordBatch]:
    """Pairs of the members of each place, made in the first block that they share."""
    n = rows.num_rows
    if not n:
        return
    of = lambda ends: np.repeat(ends, np.diff(ends, prepend=0))
    end, own_end = of(_changes(rows, "key", "place")), of(_changes(rows, "key", "place", "own"))
    # in a place of two parts members of one meet those of the other, else all that follow
    low = np.where(rows.column("crossed").to_numpy(), own_end, np.arange(n) + 1)
    count = end - low
    idx, key = rows.column("idx").to_numpy(), rows.column("key").to_numpy()
    lists = rows.column("keys").combine_chunks()
    flat, size = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
    before = flat < np.repeat(key, size)
    earlier = np.bincount(np.repeat(np.arange(n), size)[before], minlength=n)
    width = int(earlier.max())
    filled = np.arange(width) < earlier[:, None]
    # earlier keys of the left and of the right; what fills up equals nothing of the other
    mine, theirs = np.repeat(key[:, None], width, axis=1), np.repeat(key[:, None] + 1, width, axis=1)
    mine[filled] = theirs[filled] = flat[before]
    marks = np.bitwise_or.reduce(np.where(filled, np.uint64(1) << (mine & 63).astype(np.uint64), np.uint64(0)), axis=1) if width else np.zeros(n, np.uint64)
    made, total = make(rows), np.cumsum(count)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + AT_ONCE, side="right")))
        c, first = count[at:to], low[at:to]
        left = np.repeat(np.arange(at, to), c)
        right = np.arange(len(left)) + np.repeat(first - (np.cumsum(c) - c), c)
        at = to
        maybe = np.flatnonzero(marks[left] & marks[right])
        if len(maybe):
            twice, a, b = np.zeros(len(maybe), bool), left[maybe], right[maybe]
            other = [theirs[b, y] for y in range(width)]
            for x in range(width):
                one = mine[a, x]
                for y in other:
                    twice |= one == y
            keep = np.ones(len(left), bool)
            keep[maybe[twice]] = False
            left, right = left[keep], right[keep]
        if len(left):
            turned = idx[left] > idx[right]
            left, right = np.where(turned, right, left), np.where(turned, left, right)
            yield made(left, right)


def exhaustive_pairs(records: DataFrame) -> DataFrame:
    """Every pair; for small inputs only, as ``candidate_pairs`` sees to.  Records are dealt out first, so all tasks make pairs."""
    a, b = records.select(F.col("idx").alias("left_index")), records.select(F.col("idx").alias("right_index"))
    spread = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return a.repartition(spread, "left_index").join(b, F.col("left_index") < F.col("right_index"))


def paired(pairs: DataFrame, ready: DataFrame) -> DataFrame:
    """Pairs with the columns of both records as structs left and right."""
    side = lambda name: ready.select(F.col("idx").alias(f"{name}_index"), F.struct(*[c for c in ready.columns if c != "idx"]).alias(name))
    return pairs.join(side("left"), "left_index").join(side("right"), "right_index")


def candidate_pairs(records: DataFrame, keys: DataFrame | Callable[[DataFrame], DataFrame], exhaustive_limit: int, cap: int | None = CAP, carried: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """(pairs, whether they are exhaustive); counts no further than the limit to decide.

    keys: (idx, block_key), or what makes them of the records if they are needed.
    carried: columns of every record that come with the pairs, as in ``blocked_pairs``.
    """
    if records.limit(exhaustive_limit + 1).count() <= exhaustive_limit:
        pairs = exhaustive_pairs(records)
        return (pairs if carried is None else paired(pairs, carried)), True
    return blocked_pairs(keys(records) if callable(keys) else keys, cap, carried), False

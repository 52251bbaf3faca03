"""Shared helpers: column picking, shared scratch space, lineage cuts."""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.plans.scratch import drop_scratch, materialize, scratch, scratch_path  # noqa: F401

#: White space of the word rule ``[^\x20\x09-\x0D]+``.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: The same inside SQL string literals, where a backslash escapes.
SPACE_SQL = SPACE.replace("\\", "\\\\")
WORD_SQL = WORD.replace("\\", "\\\\")

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, by exact name, first match.

    Tables may carry further columns whose names clash with those an
    operator adds, or that differ from a needed one in case only; columns
    are therefore addressed by position.
    """
    at = {}
    for i, name in enumerate(df.columns):
        at.setdefault(name, i)
    missing = [n for n in names if n not in at]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    plain = df.toDF(*[f"__c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"__c{at[n]}").alias(n) for n in names])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``, evaluated once a row."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


#: Words of the filter below, 64 bits each: it never takes more than 4 MB.
FILTER_WORDS = 1 << 18


def bloom_flag(df: DataFrame, key: str, wanted: DataFrame, flag: str) -> DataFrame:
    """``df`` with ``flag``: whether its ``key`` may be in ``wanted`` (same column name).

    One bit a key in a table of fixed size, which is broadcast; rows flagged
    by chance are left to the join that follows, so the filter saves shuffling
    and decides nothing.  Nulls are flagged if ``wanted`` holds any.
    """
    hashed = f"xxhash64(`{key}`, 'filter')"
    bit = f"shiftleft(1L, CAST(shiftrightunsigned({hashed}, 58) AS INT))"
    word = f"CAST(pmod({hashed}, {FILTER_WORDS}) AS INT)"
    words = wanted.select(F.expr(word).alias("__word"), F.expr(bit).alias("bit")).groupBy("__word").agg(F.bit_or("bit").alias("__bits"))
    joined = df.withColumn("__word", F.expr(word)).join(F.broadcast(words), "__word", "left")
    return joined.withColumn(flag, F.coalesce(F.col("__bits").bitwiseAND(F.expr(bit)) != 0, F.lit(False))).drop("__word", "__bits")


def bloom_filter(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of ``df`` that ``bloom_flag`` flags."""
    return bloom_flag(df, key, wanted, "__hit").where("__hit").drop("__hit")


#: A hundred bits a key and more, between these numbers of words: a filter of Python code takes 32 MB at most.
LEAST_WORDS, MOST_WORDS = 1 << 12, 1 << 22


def filter_bits(wanted: DataFrame, hashed: str) -> Broadcast:
    """The filter's words for a column of a written table that holds hashes already, for Python on the executors.

    It grows with the keys up to ``MOST_WORDS``, which is also the number of
    rows that reach the driver at most, and is sent to each executor once.
    The lowest 16 bits are not used.
    """
    n, size = wanted.count(), LEAST_WORDS
    while size < MOST_WORDS and size < 2 * n:
        size *= 2
    words = wanted.select(F.expr(f"CAST(shiftrightunsigned(`{hashed}`, 16) & {size - 1}L AS INT)").alias("w"), F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(`{hashed}`, 58) AS INT))").alias("bit"))
    bits = np.zeros(size, np.int64)
    for batch in words.groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow().to_batches():
        bits[batch.column("w").to_numpy()] = batch.column("bits").to_numpy()
    return wanted.sparkSession.sparkContext.broadcast(bits.view(np.uint64))


def unique_ids(docs: DataFrame) -> bool:
    """Whether no ``doc_id`` is null or stands in two rows."""
    ids = pick(docs, "doc_id").select(F.col("doc_id").cast("long").alias("id"))
    return ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("id IS NULL OR n > 1").isEmpty()


def numbered(docs: DataFrame, unique: bool | None = None) -> DataFrame:
    """``docs`` with ``__row``, a key that each row has to itself and that follows the order of ``doc_id``, nulls first.

    That is ``doc_id`` where it tells rows apart.  Else rows are sorted and
    numbered, rows that share an id in their order in the table, and written
    with their numbers, so that every later read sees the same.
    """
    if unique_ids(docs) if unique is None else unique:
        return docs.withColumn("__row", docs["doc_id"].cast("long"))
    placed = docs.withColumn("__id", docs["doc_id"].cast("long")).withColumn("__at", F.monotonically_increasing_id())
    return materialize(placed.sort("__id", "__at").drop("__id", "__at").withColumn("__row", F.monotonically_increasing_id()), "rows")


def by_row(keyed: DataFrame, *names: str) -> DataFrame:
    """The row's key as ``doc_id``, and the named columns."""
    return pick(keyed, "__row", *names).withColumnRenamed("__row", "doc_id")


def without(df: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``key`` is not in ``gone`` (same column name); null matches null.

    Only rows that the filter flags are joined, so most rows are not moved.
    """
    gone = materialize(gone.select(F.col(key).alias("__gone")).distinct(), "gone")
    flagged = bloom_flag(df.withColumn("__key", df[key]), "__key", gone.select(F.col("__gone").alias("__key")), "__hit")
    hit = flagged.where("__hit")
    rest = hit.join(gone, hit["__key"].eqNullSafe(gone["__gone"]), "left_anti")
    return flagged.where("NOT __hit").unionByName(rest).drop("__key", "__hit")

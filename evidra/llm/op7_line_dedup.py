"""Line deduplication by a segment-partition edit join.

A line of L characters is cut into ``edits + 1`` segments.  Two lines within
``edits`` edits share one segment whole, at a place that their lengths bound,
so each line puts its own segments and the few substrings that could match a
segment of a line as long or shorter into one index of keys, and lines meet
where keys meet.  Meetings are verified by banded bit-parallel edit distance.

A line goes if an equal line stands earlier in the corpus, in order of
(doc_id, line number), or if an earlier one is within the edits; the first
stays.  Exact repeats go however short they are, if they hold a word
(``exact_chars``); lines of fewer than ``min_chars`` characters, white space
at their ends not counted, take no part in the edit join.

``edits`` is a number, or pairs (length, edits) in rising order: lines of at
least that length may differ by so many, and of two lines the shorter one's
number holds.  The keys of a line grow with the cube of its edits, which is
why the default is two for lines of any length.

Lines are keyed where they first stand.  Keys are first counted, 6 bytes each;
only lines of keys that meet are read again.  Where many different lines share
a key, they are dealt into blocks of bounded size that are compared block by
block; a block tells which lines go, at most once each, so no group is
collected and no list of its pairs is made.

Defined cases: null texts stay null; an empty text stays; a document all of
whose lines go is dropped, as nothing of its own is left; rows that share a
doc_id are documents of their own in the order of the table, null ids too,
which come first; an empty table gives an empty result; all columns of the
input are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, bloom_filter, bloom_flag, by_row, drop_scratch, filter_bits, let, materialize, numbered, pick
from .editdist import distance_within

EDITS = 2
MIN_CHARS = 32
#: Exact repeats of lines of so many characters go: of all that hold a word.
EXACT_CHARS = 1
#: Keys shared by more lines than this are compared in blocks of so many lines, and of so many characters.
FEW = 16
BLOCK, BLOCK_CHARS = 256, 4_000_000
Edits = int | tuple[tuple[int, int], ...]
_WHITE = " \t\n\x0b\x0c\r"


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    base, longer = divmod(length, edits + 1)
    out, at = [], 0
    for i in range(edits + 1):
        size = base + (i > edits - longer)
        out.append((at, size))
        at += size
    return out


def allowed(length: int, edits: Edits) -> int:
    """How many edits a line of this length may differ by."""
    if isinstance(edits, int):
        return edits
    return max((n for least, n in edits if least <= length), default=0)


def keys_of(line: str, edits: Edits, plans: dict[int, list[tuple[int, int, int]]]) -> list[int]:
    """The line's segments, and its substrings that may be segments of a line as long or shorter."""
    n = len(line)
    if n not in plans:
        plan = []
        for m in range(max(n - allowed(n, edits), 1), n + 1):
            most, gap = allowed(m, edits), n - m
            if gap > most or m <= most:
                continue
            for i, (p, size) in enumerate(segments(m, most)):
                lo, hi = max(0, p - i, p + gap - (most - i)), min(n - size, p + i, p + gap + (most - i))
                plan += [(m << 8 | i, q, q + size) for q in range(lo, hi + 1)]
        plans[n] = plan
    return [xxhash.xxh64_intdigest(line[a:b], seed) for seed, a, b in plans[n]]


def _lines(text: str | None, min_chars: int) -> Iterator[tuple[int, str]]:
    for no, line in enumerate(text.split("\n") if text else ()):
        line = line.strip(_WHITE)
        if len(line) >= min_chars:
            yield no, line


def _halves(line: str) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(line)
    return h & 0xFFFFFFFFFFFFFFFF, h >> 64


class _Rows:
    """Columns of rows that are handed over some thousands at a time."""

    def __init__(self, schema: pa.Schema, most: int = 20_000):
        self.schema, self.most = schema, most
        self.columns: list[list] = [[] for _ in schema]

    def __len__(self) -> int:
        return len(self.columns[0])

    def full(self) -> bool:
        return len(self) >= self.most

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(np.array(c, np.uint64).view(np.int64)) if f.metadata else pa.array(c, f.type) for c, f in zip(self.columns, self.schema, strict=True)], schema=self.schema)
        self.columns = [[] for _ in self.schema]
        return out


def _hashed(name: str) -> pa.Field:
    return pa.field(name, pa.int64(), metadata={"from": "unsigned"})


_PLACE = [pa.field("doc", pa.int64()), pa.field("line", pa.int32())]
_ID = [_hashed("h1"), _hashed("h2")]


def _may_hold(held: Broadcast, h: int) -> bool:
    bits = held.value
    return bool(int(bits[h >> 16 & (len(bits) - 1)]) >> (h >> 58) & 1)


def _hold(held: Broadcast, h: np.ndarray) -> np.ndarray:
    bits = held.value
    return (bits[(h >> np.uint64(16) & np.uint64(len(bits) - 1)).astype(np.int64)] >> (h >> np.uint64(58)) & np.uint64(1)).astype(bool)


def occurrences(docs: DataFrame, min_chars: int, exact_chars: int) -> DataFrame:
    """doc, line, h1, h2, long: every line that takes part, by the 128 bits of its hash; long: in the edit join too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(pa.schema(_PLACE + _ID + [pa.field("long", pa.bool_())]))
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for no, line in _lines(text.as_py(), min(min_chars, exact_chars)):
                    for column, value in zip(rows.columns, (doc_id, no, *_halves(line), len(line) >= min_chars), strict=True):
                        column.append(value)
                if rows.full():
                    yield rows.batch()
        yield rows.batch()

    return docs.mapInArrow(run, "doc long, line int, h1 long, h2 long, long boolean")


#: Keys keep 48 of their bits: they take less space where they are counted, and what meets by chance is told apart later.
_KEY = np.uint64(0xFFFFFFFFFFFF0000)
_MIX = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93


def _occurrence(h1: int, doc: int | None, no: int) -> int:
    """64 bits for a line at its place."""
    x = (h1 ^ ((-1 if doc is None else doc) * _MIX[0] + no * _MIX[1])) * _MIX[2] & 0xFFFFFFFFFFFFFFFF
    return (x ^ x >> 32) * _MIX[0] & 0xFFFFFFFFFFFFFFFF


class Once:
    """Which occurrences of lines are keyed: each different line's first, and few others.

    A line that may be repeated is keyed where its first occurrence may be.
    The filters err towards more: lines that occur once and are only taken for
    repeated are known (``alarms``) and keyed, so no line is lost, and one
    that is keyed twice meets itself alone.
    """

    def __init__(self, grouped: DataFrame):
        repeated = grouped.where("n > 1")
        self.again = again = filter_bits(repeated.select("h1"), "h1")

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [_occurrence(h1 & 0xFFFFFFFFFFFFFFFF, doc, no) for h1, doc, no in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.array(found, np.uint64).view(np.int64))], ["p"])

        def mistaken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h = batch.column(0).to_numpy().view(np.uint64)
                yield batch.filter(pa.array(_hold(again, h), pa.bool_()))

        self.firsts = filter_bits(materialize(repeated.select("h1", "first.doc", "first.line").mapInArrow(places, "p long"), "firsts"), "p")
        self.alarms = filter_bits(materialize(grouped.where("n = 1").select("h1").mapInArrow(mistaken, "h1 long"), "alarms"), "h1")

    def keyed(self, h1: int, doc: int | None, no: int) -> bool:
        return not _may_hold(self.again, h1) or _may_hold(self.firsts, _occurrence(h1, doc, no)) or _may_hold(self.alarms, h1)


def line_texts(docs: DataFrame, min_chars: int, only: Broadcast, once: Once) -> DataFrame:
    """doc, line, h1, h2, text of the keyed lines whose h1 the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(pa.schema(_PLACE + _ID + [pa.field("text", pa.string())]), 5000)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for no, line in _lines(text.as_py(), min_chars):
                    h1, h2 = _halves(line)
                    if _may_hold(only, h1) and once.keyed(h1, doc_id, no):
                        for column, value in zip(rows.columns, (doc_id, no, h1, h2, line), strict=True):
                            column.append(value)
                if rows.full():
                    yield rows.batch()
        yield rows.batch()

    return docs.mapInArrow(run, "doc long, line int, h1 long, h2 long, text string")


def line_keys(docs: DataFrame, edits: Edits, min_chars: int, once: Once) -> DataFrame:
    """key: one row for each key of each line that is keyed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans: dict = {}
        keys: list[int] = []

        def held() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array((np.array(keys, np.uint64) & _KEY).view(np.int64))], ["key"])
            keys.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for no, line in _lines(text.as_py(), min_chars):
                    if once.keyed(_halves(line)[0], doc_id, no):
                        keys += keys_of(line, edits, plans)
                if len(keys) >= 100_000:
                    yield held()
        yield held()

    return docs.mapInArrow(run, "key long")


def keyed_lines(docs: DataFrame, edits: Edits, min_chars: int, only: Broadcast, once: Once) -> DataFrame:
    """key, h1, h2, chars likewise, of the keys that ``only`` lets through; chars: of the line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans: dict = {}
        keys: list[int] = []
        owners: list[int] = []  # h1, h2 of each line in turn, its characters and how many keys it has
        sizes: list[int] = []
        counts: list[int] = []

        def held() -> pa.RecordBatch:
            found, ids, each = np.array(keys, np.uint64) & _KEY, np.array(owners, np.uint64).view(np.int64).reshape(-1, 2), np.array(counts, np.int64)
            ids, chars, keep = np.repeat(ids, each, 0), np.repeat(np.array(sizes, np.int32), each), _hold(only, found)
            for used in (keys, owners, sizes, counts):
                used.clear()
            return pa.RecordBatch.from_arrays([pa.array(found[keep].view(np.int64)), pa.array(ids[keep, 0]), pa.array(ids[keep, 1]), pa.array(chars[keep])], ["key", "h1", "h2", "chars"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for no, line in _lines(text.as_py(), min_chars):
                    h1, h2 = _halves(line)
                    if not once.keyed(h1, doc_id, no):
                        continue
                    found = keys_of(line, edits, plans)
                    keys += found
                    owners += (h1, h2)
                    sizes.append(len(line))
                    counts.append(len(found))
                if len(keys) >= 100_000:
                    yield held()
        yield held()

    return docs.mapInArrow(run, "key long, h1 long, h2 long, chars int")


def _near(a: str, b: str, edits: Edits) -> bool:
    return distance_within(a, b, allowed(min(len(a), len(b)), edits)) is not None


def _letters(lines: list[str]) -> np.ndarray:
    """How often each of 64 classes of characters occurs; an edit moves at most two counts by one."""
    out = np.empty((len(lines), 64), np.int32)
    for i, line in enumerate(lines):
        codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
        out[i] = np.bincount(codes & 63, minlength=64)
    return out


def _compare(edits: Edits):
    """The lines that go by one block pair of a key that many lines share: each has an earlier one near in the pair."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.drop_duplicates(["h1", "h2", "side"]).sort_values(["doc", "line"], kind="stable", na_position="first").reset_index(drop=True)
        texts, side = block.text.tolist(), block.side.to_numpy()
        counts, lengths = _letters(texts), np.array(list(map(len, texts)))
        most = np.array([allowed(n, edits) for n in lengths.tolist()])
        gone = []
        for j in range(1, len(texts)):
            may = np.minimum(most[:j], most[j])
            near = np.abs(lengths[:j] - lengths[j]) <= may
            near &= side[:j] == 2 if side[j] == 2 else side[:j] != side[j]
            near = np.flatnonzero(near)
            near = near[np.abs(counts[near] - counts[j]).sum(1) <= 2 * may[near]]
            if any(_near(texts[i], texts[j], edits) for i in near[::-1]):
                gone.append(j)
        return block.loc[gone, ["h1", "h2"]].astype("int64")

    return run


def near_lines(docs: DataFrame, grouped: DataFrame, edits: Edits = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """h1, h2 of the different lines that have an earlier one within the edits.

    grouped: h1, h2, n, first of every different line.  Lines are keyed where
    they first stand, so no text is moved before its keys meet another's.
    """
    if allowed(min_chars, edits) >= min_chars:
        raise ValueError("lines in the edit join must be longer than their edits")
    once = Once(grouped)
    keys = line_keys(docs, edits, min_chars, once)
    met = materialize(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "keys")
    meeting = filter_bits(met, "key")
    held = keyed_lines(docs, edits, min_chars, meeting, once).join(met, "key", "left_semi")
    every = materialize(held.distinct(), "members")
    sizes = every.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum("chars").alias("all_chars")).where("m > 1")
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("all_chars") / BLOCK_CHARS)).cast("int")
    members = materialize(every.drop("chars").join(sizes.select("key", "m", blocks.alias("blocks")), "key"), "members")
    drop_scratch(met)
    drop_scratch(every)
    wanted = materialize(members.select("h1", "h2").distinct(), "wanted")
    needed = filter_bits(wanted, "h1")
    texts = line_texts(docs, min_chars, needed, once).groupBy("h1", "h2").agg(F.min(F.struct("doc", "line", "text")).alias("f"))
    lines = materialize(texts.join(wanted, ["h1", "h2"], "left_semi").select("h1", "h2", "f.doc", "f.line", "f.text"), "lines")

    few = members.where(F.col("m") <= FEW).select("key", "h1", "h2")
    other = few.select("key", F.col("h1").alias("b1"), F.col("h2").alias("b2"))
    pairs = few.join(other, "key").where("h1 < b1 OR (h1 = b1 AND h2 < b2)").select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), "b1", "b2").distinct()
    body = lambda x: lines.select(F.col("h1").alias(f"{x}1"), F.col("h2").alias(f"{x}2"), F.struct("doc", "line").alias(f"{x}at"), F.col("text").alias(f"{x}text"))
    pairs = pairs.join(body("a"), ["a1", "a2"]).join(body("b"), ["b1", "b2"])
    later = F.when(F.col("aat") < F.col("bat"), F.struct(F.col("b1").alias("h1"), F.col("b2").alias("h2"))).otherwise(F.struct(F.col("a1").alias("h1"), F.col("a2").alias("h2")))
    pairs = pairs.select(later.alias("x"), "atext", "btext").select("x.h1", "x.h2", "atext", "btext")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [_near(a, b, edits) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    gone = pairs.mapInArrow(verify, "h1 long, h2 long")

    many = members.where(F.col("m") > FEW).join(lines, ["h1", "h2"])
    dealt = many.withColumn("own", F.pmod(F.xxhash64("h1", "h2"), F.col("blocks")).cast("int"))
    row = ["h1", "h2", "doc", "line", "text"]
    dealt = dealt.select("key", *row, "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    sides = F.when(F.col("own") == F.col("with"), 2).when(F.col("own") < F.col("with"), 0).otherwise(1)
    dealt = dealt.select("key", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), sides.alias("side"), *row)
    # dealt out anew: by its key alone, all blocks of a key would be one task's
    hot = dealt.repartition("key", "i", "j").groupBy("key", "i", "j").applyInPandas(_compare(edits), "h1 long, h2 long")
    near = materialize(gone.union(hot).distinct(), "near")
    for used in (members, wanted, lines):
        drop_scratch(used)
    for bits in (once.again, once.firsts, once.alarms, meeting, needed):  # what they made is written by now
        bits.unpersist()
    return near


def removals(docs: DataFrame, edits: Edits = EDITS, min_chars: int = MIN_CHARS, exact_chars: int = EXACT_CHARS) -> DataFrame:
    """doc, gone: the numbers of the lines that go from each document that loses any; doc_id must tell rows apart."""
    source = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = materialize(occurrences(source, min_chars, exact_chars), "seen")
    grouped = materialize(seen.groupBy("h1", "h2", "long").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "line")).alias("first")), "grouped")
    repeated = grouped.where("n > 1").select("h1", "h2", "first")
    near = near_lines(source, grouped.where("long").drop("long"), edits, min_chars).withColumn("all", F.lit(True))
    gone = materialize(repeated.join(near, ["h1", "h2"], "full_outer"), "gone")
    held = bloom_filter(seen, "h1", gone.select("h1")).join(gone, ["h1", "h2"])
    out = held.where("all OR NOT struct(doc, line) <=> first").select("doc", "line")
    removed = materialize(out.distinct().groupBy("doc").agg(F.collect_set("line").alias("gone")), "removed")
    for used in (seen, grouped, near, gone):
        drop_scratch(used)
    return removed


def deduplicate(docs: DataFrame, edits: Edits = EDITS, min_chars: int = MIN_CHARS, counts: bool = False, exact_chars: int = EXACT_CHARS) -> DataFrame:
    """The documents with their remaining lines; with ``counts``, also n_lines and n_removed.

    Only documents that lose lines are joined with what they lose, and they
    are moved for it at every size: the size of the encoded table of line
    numbers bounds nothing that could be broadcast.  A column ``n_chars``,
    where there is one, follows the text.
    """
    keyed = numbered(docs)
    removed = removals(by_row(keyed, "text"), edits, min_chars, exact_chars)
    n_lines = F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long")
    flagged = bloom_flag(keyed, "__row", removed.select(F.col("doc").alias("__row")), "__hit")
    whole = flagged.where("NOT __hit").drop("__row", "__hit")
    if counts:
        whole = whole.withColumn("n_lines", n_lines).withColumn("n_removed", F.lit(0).cast("long"))
    joined = flagged.where("__hit").drop("__hit").join(removed.withColumnRenamed("doc", "__doc").withColumnRenamed("gone", "__gone").hint("merge"), F.col("__row") == F.col("__doc"), "left")
    stay = "array_except(sequence(0, size(l) - 1), coalesce(__gone, array()))"
    cut = let("split(text, '\\n', -1)", "l", let(stay, "k", "named_struct('text', array_join(transform(k, i -> l[i]), '\\n'), 'all', CAST(size(l) AS BIGINT), 'kept', CAST(size(k) AS BIGINT))"))
    rebuilt = joined.withColumn("__new", F.expr(f"CASE WHEN text IS NOT NULL THEN {cut} END"))
    lost = F.coalesce(F.col("__new.all") > F.col("__new.kept"), F.lit(False))
    rebuilt = rebuilt.where(~(lost & ~F.col("__new.text").rlike(WORD)))
    if counts:
        rebuilt = rebuilt.withColumn("n_lines", F.coalesce(F.col("__new.all"), F.lit(0))).withColumn("n_removed", F.coalesce(F.col("__new.all") - F.col("__new.kept"), F.lit(0)))
    if "n_chars" in docs.columns:
        rebuilt = rebuilt.withColumn("n_chars", F.when(lost, F.length("__new.text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    rebuilt = rebuilt.withColumn("text", F.when(lost, F.col("__new.text")).otherwise(F.col("text")))
    return whole.unionByName(rebuilt.drop("__row", "__doc", "__gone", "__new"))

"""Vector best-fit packing of tokenized documents into sequences.

Documents become pieces of at most ``tokens`` ids.  Pieces of one length are
alike in every capacity (tokens, documents, attention cost), so the whole
corpus is packed by best-fit decreasing over its histogram of lengths: the
driver plans with at most ``tokens`` counts, and the plan says for each length
which ranks go to which sequences.  Executors number the pieces of each length
and look the plan up.  The result is that of one global best-fit run, at any
size, without a driver or a task that sees all pieces.

With the contract's limits a sequence holds at most ``tokens`` pieces and
``tokens`` squared of attention cost whatever is packed, so only the tokens
bind there; smaller limits bind by all three (``Limits``).

Defined cases: a null or empty text is the end token alone; repeated rows are
packed once each, and those that share an id by their pieces in any order; an
empty table gives an empty result; other columns are ignored.  A document longer than ``tokens`` is cut into full pieces, the first
of which may be shorter.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, pick

#: Up to this code point the two libraries' character classes agree.
OTHER = re.compile("[^\x00-\u024f]")
#: Pieces of a length are numbered in so many buckets at least, and in as many more as keep a bucket to so many
#: pieces; bounds no result, only how many tasks share a length.
BUCKETS, IN_BUCKET = 1024, 250_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence, and what each counts in the score."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    #: "norm": least weighted norm of what is left; "dot": largest weighted product of piece and what is left
    rule: str = "norm"


class Encoder:
    """Ids as by ``tokenizers``; plain texts take a faster coder of the same vocabulary.

    The string of a special token is that token's id, as in the plain call;
    texts that hold one are left to the exact coder, as are characters beyond
    those on which the two are known to agree.
    """

    def __init__(self, vocabulary: str | None = None):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
        self.exact = Tokenizer.from_file(path)
        added = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.fast = None
        if vocabulary is None:
            with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is not None and not OTHER.search(text) and not (self.added is not None and self.added.search(text)):
            return self.fast.encode_ordinary(text)
        return self.exact.encode(text, add_special_tokens=False).ids


_ENCODERS: dict[str | None, Encoder] = {}


def encoder(vocabulary: str | None = None) -> Encoder:
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    first = n % most or most
    return [(0, first), *((i, most) for i in range(first, n, most))]


def pieces(docs: DataFrame, most: int = 2048, end: int = 0, vocabulary: str | None = None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                ids = np.array([*(encode(text) if text else ()), end], "<u4")
                for i, (start, length) in enumerate(cut(len(ids), most)):
                    for column, value in zip(out, (doc_id, i, start, length, zlib.crc32(ids[start : start + length].tobytes())), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def plan(counts: dict[int, int], limits: Limits = Limits()) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces a sequence, offset, ranks).

    Sequences in the same state are kept as one range, so the plan grows with
    the number of different lengths, not with the pieces.
    """
    caps = np.array([limits.tokens, limits.documents, limits.attention], float)
    weights = np.array(limits.weights)
    left = np.empty((0, 3))
    ranges: list[tuple[int, int]] = []  # first sequence, how many
    rows, sequences = [], 0
    for length in sorted(counts, reverse=True):
        item = np.array([length, 1, length * length], float)
        if (item > caps).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        n, rank = counts[length], 0
        alive = (left[:, 0] > 0) & (left[:, 1] > 0) & (left[:, 2] > 0)
        if not alive.all():
            ranges = [r for r, a in zip(ranges, alive, strict=True) if a]
            left = left[alive]
        while n:
            fits = np.flatnonzero((left >= item).all(1)) if len(left) else ()
            if len(fits):
                if limits.rule == "dot":
                    score = -((left[fits] / caps) @ (weights * item / caps))
                else:
                    score = (((left[fits] - item) / caps) ** 2 @ weights)
                at = int(fits[int(np.argmin(score))])
                state, (first, many) = left[at], ranges[at]
                left, ranges = np.delete(left, at, 0), ranges[:at] + ranges[at + 1 :]
            else:
                state, first, many = caps, sequences, None
            k = 1 if limits.rule == "dot" and many is not None else int(np.min(state // item))
            if many is None:
                many = -(-n // k)
                sequences += many
            full, rest = divmod(min(n, k * many), k)
            taken = full * k + rest
            rows.append((length, rank, first, k, limits.tokens - int(state[0]), taken))
            add = [(first, full, state - k * item)] if full else []
            if rest:
                add.append((first + full, 1, state - rest * item))
            if many > full + bool(rest):
                add.append((first + full + bool(rest), many - full - bool(rest), state))
            ranges = ranges + [(f, m) for f, m, _ in add]
            left = np.concatenate([left, np.array([s for *_, s in add])])
            rank += taken
            n -= taken
    return np.array(rows, np.int64).reshape(-1, 6)


def number(found: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Adds ``rank``: 0, 1, ... among the pieces of the same length.

    Counts of a length's buckets are themselves summed in groups of buckets,
    so no task sees all counts of a frequent length.
    """
    groups = max(1, int(buckets**0.5))
    bucketed = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = bucketed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("group", (F.col("bucket") / F.lit(groups)).cast("int"))
    counts = materialize(counts, "counts")
    upto = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    of_groups = counts.groupBy("length", "group").agg(F.sum("n").alias("n"))
    of_groups = of_groups.select("length", "group", upto(Window.partitionBy("length").orderBy("group")).alias("before"))
    base = counts.withColumn("own", upto(Window.partitionBy("length", "group").orderBy("bucket"))).join(of_groups, ["length", "group"])
    base = base.select("length", "bucket", (F.col("before") + F.col("own")).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    ranked = bucketed.withColumn("within", F.row_number().over(within) - 1)
    return ranked.join(base, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("within")).drop("base", "within", "bucket")


def assign(found: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``."""
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = plan(counts, limits)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    lengths, ranks = rows[:, 0].copy(), rows[:, 1].copy()
    most = int(ranks.max() + rows[-1, 5]) + 1 if len(rows) else 1
    most = max(most, int((rows[:, 1] + rows[:, 5]).max()) + 1) if len(rows) else 1
    keys = lengths * most + ranks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = rows[np.searchsorted(keys, length * most + rank, "right") - 1]
            step = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(row[:, 2] + step // row[:, 3]), pa.array(row[:, 4] + step % row[:, 3] * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    buckets = max(BUCKETS, -(-max(counts.values(), default=0) // IN_BUCKET))
    return number(found, buckets).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank")).mapInArrow(run, PIECES + ", sequence_id long, offset long")


def pack(docs: DataFrame, limits: Limits = Limits(), end: int = 0, vocabulary: str | None = None) -> DataFrame:
    """Tokenize once, write the pieces, then pack them."""
    return assign(materialize(pieces(docs, limits.tokens, end, vocabulary), "pieces"), limits)

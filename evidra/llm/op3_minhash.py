"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

Two permutations make the whole signature: ``sigma`` scatters a shingle over
the universe, and coordinate k is the least value of ``pi`` shifted by k
places.  The shifted values of one shingle lie side by side in ``pi``, so a
signature is the column-wise minimum of as many slices as there are shingles.

Documents with one set form a class and are compared once.  Classes that
share a band meet in its bucket.  Two rounds hold each member against one
pivot, the one with which it shares most bands; the confirmed links are closed
into components, and a bucket inside one component is done.  What is left is
compared pair by pair across components: buckets with few members by a join,
larger ones in blocks of bounded size that emit nothing but links.  So every
pair of a bucket ends up in one component or compared, and no group is
collected or listed pair by pair.

Banding finds a pair of similarity s with probability 1 - (1 - s^r)^b: with
the defaults (40 bands of 5) it misses one pair in 8 million at 0.8 and one
in 15 billion at 0.85.  Links are confirmed on the full sets; only in the last
round pairs whose signatures agree in six standard deviations less than the
threshold are left out before that (one in a billion).

Defined cases: a null text or one without words has an empty set, is linked
with nothing and is its own component; a null doc_id is never linked by
``deduplicate`` and its component is null, while ``keep_one`` takes it as the
earliest; rows that share a doc_id are documents of their own in the order of
the table, and the first of a component is kept; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.plans.components import connected_components

from .common import bloom_filter, by_row, drop_scratch, materialize, numbered, pick, unique_ids, without

WORDS = 5
BANDS, ROWS = 40, 5
UNIVERSE = 1 << 20
#: Buckets with more members than this are compared in blocks of so many, and of so many shingles.
FEW, BLOCK, BLOCK_SHINGLES = 24, 512, 2_000_000
#: Partners of one document whose text they meet together.
PARTNERS = 1000
_MASK = (1 << 64) - 1


class _Words(dict):
    """word -> 64-bit hash; forgets everything when it grows too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_WORDS = _Words()
_POWERS = [pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) | 1 for i in range(64)]
_TABLES: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; fewer words make one."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else ()
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < words:
        return np.array([xxhash.xxh64_intdigest(b"\0".join(found), seed=len(found))], np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, found), np.uint64, len(found))
    n = len(h) - words + 1
    s = h[:n] * np.uint64(_POWERS[0])
    for i in range(1, words):
        s += h[i : n + i] * np.uint64(_POWERS[i])
    return np.unique(_mixed(s))


def tables(size: int, universe: int = UNIVERSE) -> tuple[np.ndarray, np.ndarray]:
    """sigma, and the windows of pi: row x holds pi at x, x + 1, ..., around the circle."""
    if (size, universe) not in _TABLES:
        draw = np.random.Generator(np.random.PCG64(20240607))
        sigma = draw.permutation(universe).astype(np.int32)
        pi = draw.permutation(universe).astype(np.int32)
        _TABLES[size, universe] = sigma, np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: size - 1]]), size)
    return _TABLES[size, universe]


def signature(found: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    sigma, windows = tables(size)
    at = sigma[(found >> np.uint64(44)).astype(np.int64)]
    best = windows[at[:512]].min(0)
    for i in range(512, len(at), 512):
        np.minimum(best, windows[at[i : i + 512]].min(0), out=best)
    return best


def bands(sig: np.ndarray, n: int = BANDS, rows: int = ROWS) -> np.ndarray:
    cells = sig.reshape(n, rows).astype(np.uint64)
    keys = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_POWERS[40])
    for i in range(rows):
        keys = _mixed(keys + cells[:, i] * np.uint64(_POWERS[i]))
    return keys.view(np.int64)


def sketches(docs: DataFrame, words: int = WORDS, n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, set_id (of the whole set), bands, sig (the low byte of each coordinate)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sizes, ids, keys, sigs = [], [], [], []
                for text in part.column(1):
                    found = shingles(text.as_py(), words)
                    sizes.append(len(found))
                    ids.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                    sig = signature(found, n_bands * rows) if len(found) else None
                    keys.append(bands(sig, n_bands, rows) if len(found) else None)
                    sigs.append(sig.astype(np.uint8).tobytes() if len(found) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "set_id", "bands", "sig"])

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_id binary, bands array<long>, sig binary")


def verified(pairs: DataFrame, docs: DataFrame, percent: int, words: int) -> DataFrame:
    """The pairs (a, b) with whether their full sets are similar enough."""
    kept = materialize(_texts(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()), "texts")
    # a pivot with many partners meets them in parts: its text is repeated once a part, theirs are moved once
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("parts"))
    dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    one = parts.join(kept, parts["a"] == kept["doc_id"]).select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("text").alias("ta"))
    joined = dealt.join(kept.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").join(one, ["a", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, one, ok = None, None, []
            for ta, tb in zip(batch.column(2), batch.column(3), strict=True):
                if (ta := ta.as_py()) != last:
                    last, one = ta, shingles(ta, words)
                other = shingles(tb.as_py(), words)
                both = len(np.intersect1d(one, other, assume_unique=True))
                ok.append(100 * both >= percent * (len(one) + len(other) - both))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(ok, pa.bool_())], ["a", "b", "linked"])

    return materialize(joined.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, linked boolean"), "verified")


def _sizes_allow(percent: int):
    return 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")


def _alike(percent: int) -> int:
    """Equal coordinates of 200 below which a pair is taken for unlike: six deviations under the threshold."""
    size, p = BANDS * ROWS, percent / 100
    return int(size * p - 6 * (size * p * (1 - p)) ** 0.5)


def _block(percent: int, words: int):
    """Links inside one block pair of a bucket with many members, as many as join components.

    A pair is compared in the first band that it shares only, and not if its
    ends are in one component already, by earlier rounds or links of this block.
    """
    least = _alike(percent)

    def run(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.drop_duplicates(["cls", "side"]).sort_values("cls")
        out = []
        left, right = block[block.side != 1], block[block.side != 0]
        if len(left) and len(right):
            cls, label, n = right.cls.to_numpy(), right.label.to_numpy(), right.n.to_numpy()
            keys = np.stack(right.bands.to_numpy())
            sigs = np.stack([np.frombuffer(x, np.uint8) for x in right.sig])
            before = keys[:, : int(np.flatnonzero(keys[0] == key[0])[0])]
            sets: dict[int, np.ndarray] = {}

            def of(c: int, text: str) -> np.ndarray:
                if c not in sets:
                    sets[c] = shingles(text, words)
                return sets[c]

            texts = right.text.tolist()
            parent: dict[int, int] = {}

            def root(x: int) -> int:
                while parent.setdefault(x, x) != x:
                    parent[x] = x = parent[parent[x]]
                return x

            alone = (block.side == 2).all()
            for c, lab, m, own, sig, text in zip(left.cls, left.label, left.n, left.bands, left.sig, left.text, strict=True):
                near = (label != lab) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & ~(before == own[: before.shape[1]]).any(1)
                near &= cls > c if alone else cls != c
                for j in np.flatnonzero(near):
                    if root(lab) == root(label[j]) or (sigs[j] == np.frombuffer(sig, np.uint8)).sum() < least:
                        continue
                    one, two = of(c, text), of(cls[j], texts[j])
                    both = len(np.intersect1d(one, two, assume_unique=True))
                    if 100 * both >= percent * (len(one) + len(two) - both):
                        parent[root(lab)] = root(label[j])
                        out.append((min(c, cls[j]), max(c, cls[j])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _texts(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """doc_id, text of the needed doc_ids; no other text is moved."""
    texts = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return bloom_filter(texts, "doc_id", needed).join(needed, "doc_id", "left_semi").dropDuplicates(["doc_id"])


def links(sketched: DataFrame, docs: DataFrame, percent: int = 80, words: int = WORDS) -> DataFrame:
    """(node, component) of the linked classes, each named by its least doc_id."""
    usable = sketched.where("set_id IS NOT NULL AND doc_id IS NOT NULL")
    classes = usable.groupBy("set_id").agg(F.min("doc_id").alias("cls"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    rows = materialize(classes.select("cls", "n", F.explode("bands").alias("key")), "bands")
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    members = materialize(rows.join(shared, "key").withColumn("label", F.col("cls")), "members")
    drop_scratch(rows)
    found = labels = None
    for turn in (1, 2):  # most members need one link only: the pivot with which they share most bands
        pivots = members.groupBy("key").agg(F.min(F.struct(F.xxhash64("cls", "key", F.lit(turn)).alias("h"), F.col("cls").alias("pivot"), F.col("n").alias("np"), F.col("label").alias("lp"))).alias("p"))
        star = members.join(pivots.select("key", "p.pivot", "p.np", "p.lp"), "key").where("label <> lp").select(F.col("cls").alias("b"), F.col("pivot").alias("a"), F.col("n").alias("na"), F.col("np").alias("nb"))
        best = star.where(_sizes_allow(percent)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a"))
        pairs = materialize(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        linked = verified(pairs, docs, percent, words).where("linked").select("a", "b")
        found = linked if found is None else found.union(linked)
        labels = connected_components(found)
        members = relabelled(members, labels)
    # every pair that is left: in small buckets as pairs, in large ones block by block
    few = members.where(F.col("m") <= FEW).select("key", "cls", "n", "label")
    other = few.select("key", F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"))
    pairs = few.withColumnRenamed("n", "na").join(other, "key").where("cls < b AND label <> lb").where(_sizes_allow(percent)).select(F.col("cls").alias("a"), "b").distinct()
    open_ids = members.select("cls").distinct()
    sigs = materialize(usable.select(F.col("doc_id").alias("cls"), "sig", "bands").join(open_ids, "cls", "left_semi").dropDuplicates(["cls"]), "sigs")
    sig = sigs.select("cls", "sig")
    compared = pairs.join(sig.toDF("a", "sa"), "a").join(sig.toDF("b", "sb"), "b").select("a", "b", "sa", "sb").mapInArrow(_similar(_alike(percent)), "a long, b long")
    linked = verified(materialize(compared, "pairs"), docs, percent, words).where("linked").select("a", "b")
    many = members.where(F.col("m") > FEW)
    texts = _texts(docs, many.select(F.col("cls").alias("doc_id")).distinct())
    full = many.join(sigs, "cls").join(texts.withColumnRenamed("doc_id", "cls"), "cls")
    dealt = full.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    dealt = dealt.select("key", "cls", "n", "label", "sig", "bands", "text", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    side = F.when(F.col("own") == F.col("with"), 2).when(F.col("own") < F.col("with"), 0).otherwise(1)
    dealt = dealt.select("key", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), side.alias("side"), "cls", "n", "label", "sig", "bands", "text")
    # dealt out anew: by its key alone, all blocks of a key would be one task's
    hot = materialize(dealt.repartition("key", "i", "j").groupBy("key", "i", "j").applyInPandas(_block(percent, words), "a long, b long"), "hot")
    return connected_components(found.union(linked).union(hot))


def relabelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of buckets that still hold two components."""
    fresh = members.drop("label", "m", "blocks").join(labels.select(F.col("node").alias("cls"), F.col("component").alias("label")), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    fresh = materialize(fresh.select("cls", "n", "key", "label"), "members")
    mixed = fresh.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("m"), F.sum("n").alias("shingles")).where("lo < hi")
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    mixed = mixed.select("key", "m", blocks.alias("blocks"))
    return materialize(fresh.join(mixed, "key"), "members")


def _similar(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.array([np.frombuffer(x, np.uint8) for x in batch.column(i).to_pylist()]).reshape(batch.num_rows, -1) for i in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((one == two).sum(1) >= least, pa.bool_()))

    return run


def _components(docs: DataFrame, percent: int, words: int) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row a document; ids that are not null must tell rows apart."""
    sketched = materialize(sketches(docs, words), "sketches")
    labels = links(sketched, docs, percent, words)
    named = sketched.where("set_id IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("cls"))
    named = named.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select("set_id", F.coalesce("component", "cls").alias("component"))
    named = materialize(named, "named")  # a row a set; written, so that a set of many documents is split in the join below
    linked = F.col("set_id").isNotNull() & F.col("doc_id").isNotNull()
    out = sketched.select("doc_id", "n_shingles", "set_id").join(named, "set_id", "left")
    component = F.when(linked, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, percent: int = 80, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row a document."""
    if unique_ids(docs):
        return _components(docs, percent, words)
    keyed = numbered(docs, False)
    ids = pick(keyed, "__row", "doc_id")
    rows = pick(keyed, "__row", "doc_id", "text").select(F.when(F.col("doc_id").isNotNull(), F.col("__row")).alias("doc_id"), "text")
    found = _components(rows, percent, words).withColumnRenamed("doc_id", "row")
    named = found.join(ids.toDF("row", "doc_id"), "row", "left").join(ids.toDF("component_id", "first_id"), "component_id", "left")
    return named.select(F.col("doc_id").cast("long").alias("doc_id"), "n_shingles", F.col("first_id").cast("long").alias("component_id"), "kept")


def keep_one(docs: DataFrame, percent: int = 80, words: int = WORDS) -> DataFrame:
    """The documents without those that repeat an earlier one; all columns."""
    keyed = numbered(docs)
    gone = _components(by_row(keyed, "text"), percent, words).where("NOT kept")
    return without(keyed, "__row", gone.select(F.col("doc_id").alias("__row"))).drop("__row")

"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Statistics of the whole text are standardised and mapped to cosines whose
products approximate a Gaussian kernel.  Each partition sums its part of the
normal equations; the features are rounded to fixed point, so the sums are
whole numbers and the same whatever the partitions or the order.  Two halves
of the labelled rows are fitted apart, each half is scored by the other's
model, and these scores give the ridge penalty and the isotonic curve; the
final model is the sum of both halves' equations, which costs no second pass.

Labels, language, source and doc_id are never inputs of a score.

Defined cases: a null text is scored like an empty one, whose statistics are
zero; with no usable label, or labels of one kind only, every score is the
share of label 1 (0.5 without labels); labels other than 0 and 1, nulls
included, are ignored; rows that repeat a doc_id are scored each, and train
once for each pair of row and label; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, pick

FEATURES = 192
SCALE = 1 << 14
PENALTIES = (1e-5, 1e-4, 1e-3, 1e-2, 1e-1)
BINS = 2000
#: Partitions that sum equations at most; each hands on two matrices, however many rows it has seen.
SUMS = 512
_SYMBOLS = re.compile(r"[#*$%&|<>{}\[\]\\^~=_@]")
_MARKS = re.compile(r"[!?.,;:]")
_DIGITS = re.compile(r"[0-9]")
_UPPER = re.compile(r"[^\W\d_a-z]")
_CAPITAL = re.compile(r"\b[A-Z]{2,}\b")

NAMES = ("log_words", "log_chars", "mean_word", "sd_word", "distinct", "top_word", "pairs_distinct", "triples_distinct", "symbols", "marks", "shouts", "digits", "upper", "capitals", "space", "lines", "distinct_lines", "line_words", "runs", "pipes", "ends", "entropy")


def statistics(text: str | None) -> list[float]:
    """What the classifier sees of a text; rates lie mostly between 0 and 1."""
    words = text.split() if text else []
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    chars = len(text)
    sizes = list(map(len, words))
    mean = sum(sizes) / n
    counts = Counter(words)
    spread = math.sqrt(max(0.0, sum(map(int.__mul__, sizes, sizes)) / n - mean * mean))
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    repeats = sum(map(str.__eq__, words, words[1:]))
    entropy = math.log(n) - sum(c * math.log(c) for c in counts.values()) / n
    return [
        math.log1p(n),
        math.log1p(chars),
        mean,
        spread,
        len(counts) / n,
        max(counts.values()) / n,
        len(set(zip(words, words[1:]))) / max(1, n - 1),
        len(set(zip(words, words[1:], words[2:]))) / max(1, n - 2),
        math.log1p(len(_SYMBOLS.findall(text)) / n),
        math.log1p(len(_MARKS.findall(text)) / n),
        math.log1p(text.count("!") / n),
        len(_DIGITS.findall(text)) / chars,
        len(_UPPER.findall(text)) / chars,
        len(_CAPITAL.findall(text)) / n,
        1 - sum(sizes) / chars,
        math.log1p(len(lines)),
        len(set(lines)) / len(lines),
        math.log1p(n / len(lines)),
        repeats / n,
        math.log1p(text.count("|") / n),
        sum(x.rstrip().endswith((".", "!", "?")) for x in lines) / len(lines),
        entropy,
    ]


def described(docs: DataFrame) -> DataFrame:
    """doc_id, x: the statistics of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, x array<double>")


def remainder(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(3))


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    shift: np.ndarray
    beta: np.ndarray
    curve: tuple[np.ndarray, np.ndarray]
    share: float

    def map(self, x: np.ndarray) -> np.ndarray:
        return fourier((x - self.mean) / self.spread, self.weights, self.shift) / SCALE

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.beta):
            return np.full(len(x), self.share)
        raw = self.map(x) @ self.beta
        level = np.interp(raw, *self.curve)
        # the curve is flat in places; a sliver of the raw score keeps the order there
        return np.round(0.999 * level + 0.001 * np.clip(raw, -0.5, 1.5) / 2 + 0.00025, 9).clip(0, 1)


def fourier(z: np.ndarray, weights: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Fixed-point cosines in [-1, 1] and a constant."""
    waves = np.rint(np.cos(z.clip(-6, 6) @ weights + shift) * SCALE)
    return np.concatenate([np.full((len(z), 1), float(SCALE)), waves], 1)


def _equations(weights: np.ndarray, shift: np.ndarray, mean: np.ndarray, spread: np.ndarray):
    """Partition sums of z z', z y and y y for each half, a row of the matrix at a time."""
    d = weights.shape[1] + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, d, d))
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float).reshape(-1, len(mean))
            half, y = batch.column("half").to_numpy(), batch.column("y").to_numpy().astype(float)
            for at in range(0, len(x), 4096):
                z = fourier((x[at : at + 4096] - mean) / spread, weights, shift)
                z = np.concatenate([z, y[at : at + 4096, None] * SCALE], 1)
                for h in (0, 1):
                    part = z[half[at : at + 4096] == h]
                    total[h] += part.T @ part  # whole numbers below 2^53: exact
        for h in (0, 1):
            if total[h].any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(d * d, h, np.int32)), pa.array(np.repeat(np.arange(d, dtype=np.int32), d)), pa.array(np.tile(np.arange(d, dtype=np.int32), d)), pa.array(total[h].ravel().astype(np.int64))],
                    ["half", "i", "j", "v"],
                )

    return run


def _solve(sums: np.ndarray, penalty: float) -> np.ndarray:
    d = len(sums) - 1
    n = sums[0, 0]
    ridge = np.diag([1e-12, *[penalty] * (d - 1)])
    return np.linalg.solve(sums[:d, :d] / n + ridge, sums[:d, d] / n)


def isotonic(scores: np.ndarray, ones: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; the knots of a rising curve."""
    blocks: list[list[float]] = []
    for s, k, n in zip(scores, ones, counts, strict=True):
        blocks.append([s * n, k, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            s2, k2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + k2, blocks[-1][2] + n2]
    b = np.array(blocks)
    return b[:, 0] / b[:, 2], (b[:, 1] + 0.5) / (b[:, 2] + 1)


def fit(found: DataFrame, labels: DataFrame, features: int = FEATURES, seed: int = 7) -> Model:
    """Fit on labelled rows outside the held-out third; only sums reach the driver."""
    width = len(NAMES)
    kept = pick(labels, "doc_id", "quality").where("quality IN (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    rows = found.where(remainder() != 1).join(kept, "doc_id").select("x", "y", F.when(remainder() == 0, 0).otherwise(1).alias("half"))
    rows = materialize(rows, "labelled")
    head = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones"), *[f(F.col("x")[i]).alias(f"{k}{i}") for i in range(width) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    share = head["ones"] / head["n"] if head["n"] else 0.5
    mean = np.round(np.array([head[f"m{i}"] or 0.0 for i in range(width)]), 6)
    spread = np.round(np.array([head[f"s{i}"] or 0.0 for i in range(width)]), 6)
    spread[spread < 1e-6] = 1.0
    draw = np.random.Generator(np.random.PCG64(seed))
    weights = draw.standard_normal((width, features)) / math.sqrt(2 * width)
    shift = draw.uniform(0, 2 * math.pi, features)
    model = Model(mean, spread, weights, shift, np.empty(0), (np.empty(0), np.empty(0)), share)
    if not head["n"] or not 0 < head["ones"] < head["n"]:
        return model
    d = features + 2
    sums = np.zeros((2, d, d))
    for r in rows.coalesce(SUMS).mapInArrow(_equations(weights, shift, mean, spread), "half int, i int, j int, v long").groupBy("half", "i", "j").agg(F.sum("v").alias("v")).toLocalIterator():
        sums[r["half"], r["i"], r["j"]] = r["v"]
    halves = [h for h in (0, 1) if sums[h, 0, 0]]

    def across(penalty: float) -> tuple[float, list[np.ndarray]]:
        """Squared error of each half under the other's model, from the sums alone."""
        loss, betas = 0.0, [np.empty(0)] * 2
        for h in halves:
            betas[1 - h] = beta = _solve(sums[h], penalty)
            g = sums[1 - h]
            loss += beta @ g[: d - 1, : d - 1] @ beta - 2 * beta @ g[: d - 1, d - 1] + g[d - 1, d - 1]
        return loss, betas

    best = min(PENALTIES, key=lambda p: across(p)[0]) if len(halves) == 2 else PENALTIES[-2]
    betas = across(best)[1]
    model.beta = _solve(sums.sum(0), best)
    crossed = [b if len(b) else model.beta for b in betas]

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = model.map(np.array(batch.column("x").to_pylist(), float).reshape(-1, width))
            half = batch.column("half").to_numpy()
            raw = np.where(half == 0, z @ crossed[0], z @ crossed[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.floor((raw.clip(-0.5, 1.5) + 0.5) / 2 * BINS).astype(np.int32)), batch.column("y").cast(pa.int32())], ["bin", "y"])

    bins = sorted(rows.mapInArrow(binned, "bin int, y int").groupBy("bin").agg(F.sum("y").alias("k"), F.count(F.lit(1)).alias("n")).collect())
    at = (np.array([b["bin"] for b in bins]) + 0.5) / BINS * 2 - 0.5
    model.curve = isotonic(at, np.array([b["k"] for b in bins], float), np.array([b["n"] for b in bins], float))
    return model


def scored(found: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    return found.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, features: int = FEATURES) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    found = materialize(described(docs), "described")
    out = scored(found, fit(found, labels, features))
    return out.select("doc_id", (remainder() == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

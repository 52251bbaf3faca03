"""Benchmark metrics over gold labels; what an empty denominator gives is named where it differs."""

from __future__ import annotations

import functools
import math
import random
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions import numbers as N
from evidra.plans import ordering


def confusion(predicted: Column, gold: Column) -> list[Column]:
    c = lambda x: F.count_if(x)
    return [c(predicted & gold).alias("tp"), c(~predicted & ~gold).alias("tn"), c(predicted & ~gold).alias("fp"), c(~predicted & gold).alias("fn")]


def rates(counts: DataFrame, empty: float, f1_empty: float = 0.0) -> DataFrame:
    """Adds sensitivity, specificity, precision, f1, accuracy."""
    d = lambda a, b: N.safe_divide(a, b, empty)
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    out = counts.withColumn("sensitivity", d(tp, tp + fn)).withColumn("specificity", d(tn, tn + fp)).withColumn("precision", d(tp, tp + fp)).withColumn("accuracy", d(tp + tn, tp + tn + fp + fn))
    both = F.col("precision") + F.col("sensitivity")
    return out.withColumn("f1", N.safe_divide(2 * F.col("precision") * F.col("sensitivity"), both, f1_empty))


def pair_metrics(scored: DataFrame, threshold: float = 0.985, p: str = "p", gold: str = "gold") -> DataFrame:
    """Confusion at a threshold, Brier score; empty rates are 0."""
    error = F.avg(F.pow(F.col(p) - F.col(gold).cast("double"), F.lit(2.0))).alias("brier")
    return rates(scored.agg(*confusion(F.col(p) >= threshold, F.col(gold)), error), 0.0)


def ece_bins(scored: DataFrame, bins: int = 10, p: str = "p", gold: str = "gold") -> DataFrame:
    """bin, n, mean_p, share: the bounds are k / bins as doubles, and the last bin holds 1."""
    lower = [k / bins for k in range(bins)]
    bucket = functools.reduce(lambda out, k: out.when(F.col(p) >= lower[k], k), reversed(range(1, bins)), F.when(F.lit(False), 0)).otherwise(0)
    return scored.groupBy(bucket.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(gold).cast("double")).alias("share"))


def expected_calibration_error(scored: DataFrame, bins: int = 10, p: str = "p", gold: str = "gold") -> DataFrame:
    b = ece_bins(scored, bins, p, gold)
    return b.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("share"))) / F.sum("n")).alias("ece"))


def thresholds(step: float = 0.01) -> list[float]:
    out, t = [], 0.0
    while t <= 1.0000001:
        out.append(t)
        t += step
    return out


def threshold_sweep(scored: DataFrame, step: float = 0.01, p: str = "p", gold: str = "gold") -> DataFrame:
    """Confusion at every threshold from one pass: scores are counted at the highest threshold they reach.  Empty precision is 1."""
    ts = thresholds(step)
    marks = F.array(*[F.lit(t) for t in ts])
    reach = F.aggregate(marks, F.lit(-1), lambda n, t: F.when(F.col(p) >= t, n + 1).otherwise(n))
    hist = scored.groupBy(reach.alias("k")).agg(F.count_if(gold).alias("pos"), F.count_if(~F.col(gold)).alias("neg"))
    grid = scored.sparkSession.createDataFrame(list(enumerate(ts)), "k int, threshold double")
    both = grid.join(hist, "k", "full_outer").select("k", "threshold", F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("neg", F.lit(0)).alias("neg"))
    up, all_ = Window.orderBy(F.desc("k")), Window.partitionBy()  # a hundred rows, whatever the input
    run = both.select("threshold", F.sum("pos").over(up).alias("tp"), F.sum("neg").over(up).alias("fp"), F.sum("pos").over(all_).alias("p_all"), F.sum("neg").over(all_).alias("n_all")).where("threshold IS NOT NULL")
    counts = run.select("threshold", "tp", (F.col("n_all") - F.col("fp")).alias("tn"), "fp", (F.col("p_all") - F.col("tp")).alias("fn"))
    return counts.withColumn("precision", N.safe_divide(F.col("tp"), F.col("tp") + F.col("fp"), 1.0)).withColumn("recall", N.safe_divide(F.col("tp"), F.col("tp") + F.col("fn"), 0.0)).withColumn("f1", N.safe_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"), 0.0))


def best_threshold(swept: DataFrame, min_precision: float) -> DataFrame:
    return swept.where(F.col("precision") >= min_precision).orderBy(F.desc("recall"), F.desc("f1"), F.desc("threshold")).limit(1)


def platt_fit(scored: DataFrame, epochs: int = 2000, rate: float = 0.02, l2: float = 1e-4, p: str = "p", gold: str = "gold", most: int = 200_000) -> tuple[float, float]:
    """Slope and intercept by full-batch gradient descent over the labelled pairs, equal ones counted.

    Only counts of different (score, label) reach the driver; of more than
    ``most`` of them the first by hash are fitted.
    """
    known = scored.where(F.col(p).isNotNull() & F.col(gold).isNotNull()).groupBy(F.col(p).cast("double").alias("p"), F.col(gold).cast("double").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    rows = known.orderBy(F.xxhash64("p", "y")).limit(most).toPandas()
    if rows.empty:
        return 1.0, 0.0
    q = rows.p.clip(1e-6, 1 - 1e-6).to_numpy()
    x, y, share, a, b = np.log(q / (1 - q)), rows.y.to_numpy(), rows.n.to_numpy() / rows.n.sum(), 1.0, 0.0
    for _ in range(epochs):
        e = share * (1 / (1 + np.exp(-np.clip(a * x + b, -700, 700))) - y)
        a, b = a - rate * (float(e @ x) + l2 * a), b - rate * float(e.sum())
    return a, b


def platt(a: float, b: float):
    """A calibrator for the engines: probability column -> probability column."""
    return lambda p: N.sigmoid(F.lit(a) * N.logit(p) + F.lit(b))


def study_metrics(scored: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Confusion of linked pairs, Brier score, shares of false links and of pairs in review; one row.

    scored: study_probability, decision, same_study.  Reports of one
    publication are reports of one study, whatever their probability.
    """
    p, gold = F.col("study_probability"), F.col("same_study")
    linked = (p >= threshold) | (F.col("decision") == "DUPLICATE_PUBLICATION")
    counts = scored.agg(F.count(F.lit(1)).alias("pairs"), *confusion(linked, gold), F.avg(F.pow(p - gold.cast("double"), F.lit(2.0))).alias("brier"), F.count_if(F.col("decision") == "REVIEW").alias("in_review"))
    share = lambda a, b: N.safe_divide(F.col(a), b, 0.0)
    return rates(counts, 0.0).withColumn("false_link_rate", share("fp", F.col("fp") + F.col("tn"))).withColumn("review_share", share("in_review", F.col("pairs")))


def retrieval_metrics(gold: DataFrame, found: DataFrame, id_column: str = "id") -> DataFrame:
    """Set precision, recall, F1, Jaccard and relative count error over distinct trimmed ids."""
    clean = lambda d, n: d.select(F.trim(F.col(id_column).cast("string")).alias("id")).where("id <> ''").distinct().withColumn(n, F.lit(True))
    both = clean(gold, "g").join(clean(found, "f"), "id", "full_outer")
    c = both.agg(F.count_if(F.col("g") & F.col("f")).alias("both"), F.count("g").alias("gold"), F.count("f").alias("found"))
    d = N.safe_divide
    out = c.withColumn("precision", d(F.col("both"), F.col("found"), 0.0)).withColumn("recall", d(F.col("both"), F.col("gold"), 0.0))
    return out.withColumn("f1", d(2 * F.col("both"), F.col("gold") + F.col("found"), 0.0)).withColumn("jaccard", d(F.col("both"), F.col("gold") + F.col("found") - F.col("both"), 0.0)).withColumn("count_error", d(F.abs(F.col("found") - F.col("gold")), F.col("gold"), 0.0))


def blocking_recall(candidates: DataFrame, positives: DataFrame, n_records: Column | int) -> DataFrame:
    """Share of the gold pairs among the candidates, and the share of all pairs that blocking spares."""
    order = lambda d: d.select(F.least("left_index", "right_index").alias("l"), F.greatest("left_index", "right_index").alias("r")).distinct()
    c, g = order(candidates), order(positives)
    hit = g.join(c, ["l", "r"], "left_semi").agg(F.count(F.lit(1)).alias("covered"))
    n = (F.lit(n_records) if isinstance(n_records, int) else n_records).cast("long")
    sums = g.agg(F.count(F.lit(1)).alias("positives")).join(hit).join(c.agg(F.count(F.lit(1)).alias("candidates")))
    return sums.withColumn("recall", N.safe_divide(F.col("covered"), F.col("positives"), 1.0)).withColumn("pair_reduction", 1 - N.safe_divide(F.col("candidates"), n * (n - 1) / 2, 0.0))


def partition_metrics(labelled: DataFrame, gold: str = "gold_group", predicted: str = "predicted") -> DataFrame:
    """removed_singulars, missed_duplicates and shares, from two partitions of the same records."""
    by_pred = labelled.groupBy(predicted).agg((F.count_distinct(gold) - 1).alias("x")).agg(F.sum("x").alias("removed_singulars"), F.count(F.lit(1)).alias("predicted_publications"))
    by_gold = labelled.groupBy(gold).agg((F.count_distinct(predicted) - 1).alias("x")).agg(F.sum("x").alias("missed_duplicates"), F.count(F.lit(1)).alias("gold_publications"))
    n = labelled.agg(F.count(F.lit(1)).alias("records"))
    out = n.join(by_pred).join(by_gold)
    out = out.withColumn("retention", 1 - N.safe_divide(F.col("removed_singulars"), F.col("gold_publications"), 0.0))
    return out.withColumn("duplicate_recall", 1 - N.safe_divide(F.col("missed_duplicates"), F.col("records") - F.col("gold_publications"), 0.0))


def predicted_removals(clustered: DataFrame, prefer: str | None = None) -> DataFrame:
    """Adds predicted_removed: all of a cluster but one stay, the first, or the first that gold retains if ``prefer`` names that label."""
    order = [F.col(prefer).asc()] if prefer else []
    keep = F.row_number().over(Window.partitionBy("predicted").orderBy(*order, F.col("idx")))
    return clustered.withColumn("predicted_removed", keep > 1)


def named_partition(clustered: DataFrame) -> DataFrame:
    """Adds predicted_label, PRED-0000001 and so on in the order of each cluster's first record."""
    first = ordering.numbered(clustered.groupBy("predicted").agg(F.min("idx").alias("__first")), "__first", name="__n")
    return clustered.join(first.select("predicted", F.format_string("PRED-%07d", F.col("__n") + 1).alias("predicted_label")), "predicted")


def removal_metrics(labelled: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """Confusion of removals; empty sensitivity, specificity and precision are 1, F1 is 0."""
    return rates(labelled.groupBy(*by).agg(*confusion(F.col("predicted_removed"), F.col("gold_removed"))), 1.0)


def percent_contract(labelled: DataFrame) -> DataFrame:
    """Sensitivity and specificity in percent; 100 where there is nothing to find."""
    c = labelled.agg(*confusion(F.col("predicted_removed"), F.col("gold_removed")))
    return c.withColumn("sensitivity_percent", N.safe_divide(100 * F.col("tp"), F.col("tp") + F.col("fn"), 100.0)).withColumn("specificity_percent", N.safe_divide(100 * F.col("tn"), F.col("tn") + F.col("fp"), 100.0))


def integrity(observed: DataFrame, expected: dict[str, int]) -> DataFrame:
    """name, expected, observed, ok for one row of counts."""
    rows = [F.struct(F.lit(k).alias("name"), F.lit(int(v)).cast("long").alias("expected"), F.col(k).cast("long").alias("observed"), F.col(k).eqNullSafe(F.lit(v)).alias("ok")) for k, v in expected.items()]
    return observed.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def ablation(made: DataFrame, assess, weights: dict[str, float]) -> DataFrame:
    """ablated, tp, tn, fp, fn and rates: pairs scored again with one weight at 0, all in one pass over the features.

    made: pairs with features and gold; assess: (pairs, weights) -> pairs with
    predicted, where a weight is a column that depends on what is left out.
    """
    rows = made.withColumn("ablated", F.explode(F.array(*[F.lit(n) for n in ("<none>", *weights)])))
    left = {n: F.when(F.col("ablated") == n, 0.0).otherwise(float(w)) for n, w in weights.items()}
    return rates(assess(rows, left).groupBy("ablated").agg(*confusion(F.col("predicted"), F.col("gold"))), 0.0)


STRESSED = ("doi", "pmid", "abstract", "journal", "year", "authors")


def degraded(records: DataFrame, rate: float, replicate: int = 0, seed: int = 20240101, fields: tuple[str, ...] = STRESSED) -> DataFrame:
    """Each field of each record blanked with probability ``rate``, by hash: the same records at every run and partitioning."""
    draw = lambda f: F.pmod(F.xxhash64(F.lit(seed), F.lit(replicate), F.lit(int(rate * 10000)), F.lit(f), "idx"), F.lit(1_000_000)) / 1_000_000
    return records.select(*[F.when(draw(c) >= rate, F.col(c)).alias(c) if c in fields else F.col(c) for c in records.columns])


def bootstrap_share(successes: int, n: int, replicates: int = 1000, confidence: float = 0.95, seed: int = 1) -> tuple[float, float]:
    """Bounds of a share by seeded resampling, taken by index from the sorted replicates."""
    if n == 0:
        return math.nan, math.nan
    draw = random.Random(seed)
    share = successes / n
    found = sorted(sum(draw.random() < share for _ in range(n)) / n for _ in range(replicates))
    tail = (1 - confidence) / 2
    return found[max(0, math.floor(tail * (replicates - 1)))], found[min(replicates - 1, math.ceil((1 - tail) * (replicates - 1)))]


def bootstrap_mean(values: list[float], replicates: int = 2000, confidence: float = 0.95, seed: int = 1) -> tuple[float, float]:
    """Percentile bounds of the mean of a few values (one a dataset)."""
    values = [v for v in values if v == v]
    if not values:
        return math.nan, math.nan
    draw = random.Random(seed)
    means = pd.Series([sum(draw.choices(values, k=len(values))) / len(values) for _ in range(replicates)])
    return float(means.quantile((1 - confidence) / 2)), float(means.quantile(1 - (1 - confidence) / 2))


def micro_macro(rows: DataFrame, by: str = "dataset") -> DataFrame:
    """Pooled counts with rates and Wilson bounds (dataset null), the same for each dataset, by grouping sets."""
    sums = rows.rollup(by).agg(*[F.sum(c).alias(c) for c in ("tp", "tn", "fp", "fn")], F.count(F.lit(1)).alias("datasets"))
    out = rates(sums, 1.0)
    lo, hi = N.wilson(F.col("tp"), F.col("tp") + F.col("fn"))
    return out.withColumn("sensitivity_low", lo).withColumn("sensitivity_high", hi)


def macro(rows: DataFrame) -> DataFrame:
    """Means of each dataset's rates, every dataset counting once."""
    return rates(rows, 1.0).agg(*[F.avg(c).alias(f"macro_{c}") for c in ("sensitivity", "specificity", "precision", "f1")])

"""Host-level quality rules (native: DataFrame and SQL functions only).

Every document is measured by itself.  Failures of each rule are counted a
host (``source``), each host's failure rate is shrunk towards the corpus by a
beta prior fitted to the hosts themselves, and the host's verdicts are joined
back to its documents, where they settle which limits hold.

The base rule rejects a document on any host.  Each other rule has three
limits, loose, usual and strict; a document fails the rule for its host's rate
if it is beyond the usual one.  By the host's shrunk rate of that rule

* below ``trusted_rate`` the failures are taken for chance, and only documents
  beyond the loose limit go;
* above ``suspect_rate`` they are taken for the host's habit, and documents
  beyond the strict limit go;
* in between, documents beyond the usual limit go.

A host whose shrunk rate of any rule, the base rule included, is above
``block_rate`` is blocked: the strict limit of every rule holds there.  A
document within the strict limits stays, whatever its host.  A host of few
documents has the corpus's rates, hence its verdicts.

Defined cases: a null or empty text has zero words and fails the base rule; a
null host is one host of its own; repeated rows are judged alike, each
counting once; an empty table gives an empty result; other columns of the
input are ignored by ``judge`` and kept by ``filter_documents``, which judges
each row by itself, whatever its ``doc_id``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_SQL, WORD_SQL, let, materialize, pick

#: The rules whose limits depend on the host, and all that are counted.
SOFT = ("word_length", "symbols", "dup_lines")
RULES = ("base", *SOFT)


@dataclass(frozen=True)
class HostRules:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: loose, usual and strict bounds of the mean word length, in hundredths of a code point
    word_length: tuple[tuple[int, int], ...] = ((200, 1400), (300, 1000), (350, 800))
    #: loose, usual and strict limit of symbols in a hundred words
    symbols: tuple[int, ...] = (30, 10, 5)
    #: loose, usual and strict limit of repeated lines, in percent of the lines with a word
    dup_lines: tuple[int, ...] = (50, 30, 15)
    trusted_rate: float = 0.1
    suspect_rate: float = 0.25
    block_rate: float = 0.5
    #: bounds of the prior's weight, in documents
    least_strength: float = 1.0
    most_strength: float = 1_000_000.0


def _words(text: str) -> str:
    return f"array_remove(split({text}, '{SPACE_SQL}+'), '')"


def _covered(positions: str) -> str:
    """How many words the three-word windows at these positions cover."""
    return f"size(array_distinct(flatten(transform({positions}, p -> array(p, p + 1, p + 2)))))"


def repeat_words_sql(words: str) -> str:
    """Words inside three-word windows that occur twice or more in the text.

    Windows are sorted as longs that pack 40 hash bits and a 24-bit position,
    and neighbours of equal hash are compared word for word.  Should two
    different windows share a hash, or the text be too long for the packing,
    the windows themselves are sorted instead, so the count is always exact.
    """
    packed = "transform(sequence(0, size(w) - 3), p -> (xxhash64(w[p], w[p + 1], w[p + 2]) & -16777216L) | p)"
    equal = "filter(sequence(1, size(s) - 1), i -> shiftright(s[i], 24) = shiftright(s[i - 1], 24))"
    at = "CAST(s[{i}] & 16777215L AS INT)"
    a, b = at.format(i="i - 1"), at.format(i="i")
    differ = f"exists(e, i -> NOT (w[{a}] = w[{b}] AND w[{a} + 1] = w[{b} + 1] AND w[{a} + 2] = w[{b} + 2]))"
    fast = _covered(f"array_distinct(flatten(transform(e, i -> array({a}, {b}))))")
    entry = "transform(sequence(0, size(w) - 3), p -> named_struct('a', w[p], 'b', w[p + 1], 'c', w[p + 2], 'p', p))"
    same = "filter(sequence(1, size(x) - 1), i -> x[i].a = x[i - 1].a AND x[i].b = x[i - 1].b AND x[i].c = x[i - 1].c)"
    slow = let(f"sort_array({entry})", "x", _covered(f"array_distinct(flatten(transform({same}, i -> array(x[i - 1].p, x[i].p))))"))
    quick = let(f"sort_array({packed})", "s", let(equal, "e", f"CASE WHEN size(e) = 0 THEN 0 WHEN {differ} THEN {slow} ELSE {fast} END"))
    return let(words, "w", f"CAST(CASE WHEN size(w) < 4 THEN 0 WHEN size(w) > 16777216 THEN {slow} ELSE {quick} END AS BIGINT)")


def _counts(text: str) -> Column:
    """The counts of one text, as a struct."""
    body = f"coalesce({text}, '')"
    lines = f"filter(split({body}, '\\n'), l -> l RLIKE '{WORD_SQL}')"
    words = let(_words(body), "w", "named_struct('n_words', CAST(size(w) AS BIGINT), 'word_chars', CAST(length(array_join(w, '')) AS BIGINT), 'n_repeat_words', " + repeat_words_sql("w") + ")")
    symbols = f"CAST(length(regexp_replace({body}, '[^#*$%&|<>]+', '')) AS BIGINT)"
    repeats = let(lines, "l", "named_struct('all', CAST(size(l) AS BIGINT), 'dup', CAST(size(l) - size(array_distinct(l)) AS BIGINT))")
    return F.struct(F.expr(words).alias("w"), F.expr(symbols).alias("n_symbols"), F.expr(repeats).alias("l"))


def _level(beyond: list[Column]) -> Column:
    """3 beyond the loose limit, 2 beyond the usual one, 1 beyond the strict one, else 0."""
    loose, usual, strict = beyond
    return F.when(F.col("n_words") == 0, 0).when(loose, 3).when(usual, 2).when(strict, 1).otherwise(0)


def _measured(rows: DataFrame, text: str, rules: HostRules) -> DataFrame:
    """``rows`` with the counts of ``text``, ``base_failed`` and the level of each soft rule."""
    counted = rows.withColumn("__c", _counts(text))
    flat = counted.select(
        *[F.col(c) for c in rows.columns], F.col("__c.w.n_words").alias("n_words"), F.col("__c.w.word_chars").alias("word_chars"), F.col("__c.n_symbols").alias("n_symbols"),
        F.col("__c.l.dup").alias("n_dup_lines"), F.col("__c.l.all").alias("n_lines"), F.col("__c.w.n_repeat_words").alias("n_repeat_words"),
    )
    n, chars = F.col("n_words"), 100 * F.col("word_chars")
    levels = {
        "word_length": _level([(chars < lo * n) | (chars > hi * n) for lo, hi in rules.word_length]),
        "symbols": _level([100 * F.col("n_symbols") > most * n for most in rules.symbols]),
        "dup_lines": _level([100 * F.col("n_dup_lines") > most * F.col("n_lines") for most in rules.dup_lines]),
    }
    base = (n < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * n)
    return flat.select("*", base.alias("base_failed"), *[levels[r].alias(f"{r}_level") for r in SOFT])


def measures(docs: DataFrame, rules: HostRules = HostRules(), host: str = "source") -> DataFrame:
    """One row a document: its counts, ``base_failed`` and the level of each soft rule."""
    return _measured(pick(docs, "doc_id", "text", host).toDF("doc_id", "text", "host"), "text", rules).drop("text")


def host_counts(measured: DataFrame) -> DataFrame:
    """Documents and failures of each rule a host; a rule is failed beyond its usual limit."""
    failed = {"base": F.col("base_failed")} | {r: F.col(f"{r}_level") >= 2 for r in SOFT}
    return measured.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *[F.sum(failed[r].cast("long")).alias(f"k_{r}") for r in RULES])


def beta_priors(hosts: DataFrame, rules: HostRules = HostRules()) -> dict[str, tuple[float, float]]:
    """Mean and strength of each rule's beta prior by the moments of the hosts' rates.

    One row of sums reaches the driver, whatever the number of hosts.
    """
    n = F.col("n").cast("double")
    sums = [F.sum(n).alias("total"), F.sum(n * n).alias("squares"), F.count(F.lit(1)).alias("hosts")]
    for r in RULES:
        k = F.col(f"k_{r}").cast("double")
        sums += [F.sum(k).alias(f"k_{r}"), F.sum(k * k / n).alias(f"q_{r}")]
    x = hosts.agg(*sums).first()
    priors = {}
    for r in RULES:
        if not x["total"]:
            priors[r] = (0.0, rules.most_strength)
            continue
        m = x[f"k_{r}"] / x["total"]
        spread = m * (1 - m)
        between = (x[f"q_{r}"] - x["total"] * m * m) - (x["hosts"] - 1) * spread
        scale = x["total"] - x["squares"] / x["total"]
        strength = rules.most_strength if between <= 0 or scale <= 0 else spread * scale / between - 1
        priors[r] = (m, min(max(strength, rules.least_strength), rules.most_strength))
    return priors


def host_verdicts(hosts: DataFrame, priors: dict[str, tuple[float, float]], rules: HostRules = HostRules()) -> DataFrame:
    """host, the shrunk rates, ``blocked``, and for each soft rule the least level that goes."""

    def rate(r: str) -> Column:
        mean, strength = priors[r]
        return (F.col(f"k_{r}") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))

    rated = hosts.select("host", *[rate(r).alias(f"rate_{r}") for r in RULES])
    blocked = F.greatest(*[F.col(f"rate_{r}") for r in RULES]) > rules.block_rate
    least = lambda r: F.when(F.col("blocked") | (F.col(f"rate_{r}") > rules.suspect_rate), 1).when(F.col(f"rate_{r}") < rules.trusted_rate, 3).otherwise(2)
    return rated.withColumn("blocked", blocked).select("*", *[least(r).alias(f"least_{r}") for r in SOFT])


def _verdicts(measured: DataFrame, rules: HostRules) -> DataFrame:
    hosts = materialize(host_counts(measured), "hosts")  # written, so that the planner knows its size
    return host_verdicts(hosts, beta_priors(hosts, rules), rules).withColumnRenamed("host", "__host")


def _passes() -> Column:
    """Whether no level reaches what the host's verdict lets go."""
    fine = ~F.col("base_failed")
    for r in SOFT:
        fine = fine & (F.col(f"{r}_level") < F.col(f"least_{r}"))
    return fine


def judge(docs: DataFrame, rules: HostRules = HostRules(), host: str = "source") -> DataFrame:
    """One row a document with its counts, ``base_failed``, its host's verdict and ``kept``."""
    measured = materialize(measures(docs, rules, host), "rules")
    verdicts = _verdicts(measured, rules)
    joined = measured.join(verdicts, measured["host"].eqNullSafe(verdicts["__host"]), "left").drop("__host")
    return joined.withColumn("kept", _passes())


def filter_documents(docs: DataFrame, rules: HostRules = HostRules(), host: str = "source") -> DataFrame:
    """The kept documents, all their columns.

    Measures are written beside the rows they belong to, so no row is looked
    up by an id; of the rows, only those whose fate depends on their host are
    joined with its verdict.
    """
    names = docs.columns
    text, at = names.index("text"), names.index(host)
    plain = docs.toDF(*[f"__c{i}" for i in range(len(names))])
    measured = materialize(_measured(plain.withColumn("host", F.col(f"__c{at}")), f"__c{text}", rules), "rules")
    worst = F.greatest(*[F.col(f"{r}_level") for r in SOFT])
    alive = measured.where("NOT base_failed").withColumn("worst", worst)
    verdicts = _verdicts(measured, rules)
    open_rows = alive.where("worst IN (1, 2)")
    told = open_rows.join(verdicts, open_rows["host"].eqNullSafe(verdicts["__host"]), "left").where(_passes())
    kept = alive.where("worst = 0").select(*plain.columns).unionAll(told.select(*plain.columns))
    return kept.toDF(*names)

"""Quality rules whose cutoffs are chosen under an exact bound on false rejections.

Base rules are fixed: a text fails with fewer than BASE_WORDS words, or with more than BASE_REPEAT
percent of its words in repeated five-word windows. Five further rules reject texts whose rate
(RULES, each a ratio of two counts) lies above a cutoff.

A rule's cutoffs in a stratum are tested from the laxest to the strictest on the labelled holdout,
the good documents of that stratum that pass the base rules: cutoff c is certified if
P(Bin(n, RISK / rules) <= k) <= ERROR / (rules * strata), with k of n good documents rejected.
That is the exact (Clopper-Pearson) bound. Testing stops at the first cutoff that fails (fixed
sequence, no further correction); rules and strata are corrected by Bonferroni. Of the certified
cutoffs the one that rejects most bad documents is used, of equals the laxest. With probability
1 - ERROR all strata then lose at most RISK of their good documents to these rules. A stratum
with too few labels gets no cutoff, so nothing more is rejected there.

All is DataFrame and SQL functions: windows are hashed and sorted inside the row, no rows are
exploded, and the holdout is counted by one aggregation with map-side sums for each stratum. Texts
that share a window hash are compared by their words, so a hash collision can't count.

Rows: null text has no words, no lines and no symbols, and fails. A null stratum is a stratum of
its own. Labels may repeat (the lowest quality counts) and may name unknown documents; null labels
are left out. Repeated documents are judged alike. Empty tables work. Names that start with `_q_`
are reserved; all other columns pass through.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
BASE_WORDS = 10
BASE_REPEAT = 20
#: False rejections allowed for each stratum, all rules together, and the chance of breaking that anywhere.
RISK = 0.02
ERROR = 0.05
#: name, numerator, denominator, cutoffs in percent (words' length: hundredths), strictest first
RULES = (
    ("symbols", "n_symbols", "word_chars", (2, 5, 10, 20, 30)),
    ("duplicate_lines", "n_dup_lines", "n_lines", (20, 35, 50, 65, 80)),
    ("repeated_words", "n_repeat_words", "n_words", (4, 8, 12, 16)),
    ("echoes", "n_echoes", "n_words", (5, 10, 20, 40)),
    ("word_length", "word_chars", "n_words", (650, 750, 900, 1200)),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_echoes")
#: Cutoff rows up to this many are broadcast; beyond it they are joined by shuffle.
BROADCAST_ROWS = 10_000
#: Terms of a binomial tail that are summed; the rest is bounded by a geometric series.
TERMS = 20_000


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(words: Column) -> Column:
    """Words of five-word windows that stand twice or more in the text."""

    def positions(keyed: Column) -> Column:
        """Positions whose key stands elsewhere too, from structs (key, at) in order."""
        return let(
            F.array_sort(keyed),
            lambda s: F.transform(
                F.filter(s, lambda e, k: ((k > 0) & (F.get(s, k - 1)["key"] == e["key"])) | ((k < F.size(s) - 1) & (F.get(s, k + 1)["key"] == e["key"]))),
                lambda e: e["at"],
            ),
        )

    def exact(at: Column) -> Column:
        return positions(F.transform(at, lambda i: F.struct(F.concat_ws(" ", F.slice(words, i + 1, WINDOW)).alias("key"), i.alias("at"))))

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum"))
        return F.aggregate(
            F.array_sort(at),
            start,
            lambda a, i: F.struct((i + WINDOW).alias("end"), (a["sum"] + i + WINDOW - F.greatest(i, a["end"])).alias("sum")),
            lambda a: a["sum"],
        )

    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))

    def count(found: Column) -> Column:
        keyed = F.transform(found, lambda h, i: F.struct(h.alias("key"), i.alias("at")))
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0)).otherwise(covered(exact(positions(keyed))))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(hashed, lambda h: let(windows(h), count)))


def measure(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """docs with the struct _q_, the MEASURES of the whole text."""
    text = F.coalesce(F.col(text_column), F.lit(""))

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).alias("n_words"),
            _repeated(words).alias("n_repeat_words"),
            F.size(F.filter(words, lambda w, i: (i > 0) & (F.get(words, i - 1) == w))).alias("n_echoes"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"))

    of_text = let(F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), ""), of_words)
    lines = let(F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, WHITE, "")) > 0), of_lines)
    out = docs.withColumn("_q_words", of_text).withColumn("_q_lines", lines)
    counts = {
        "n_words": F.col("_q_words.n_words"),
        "word_chars": F.length(F.translate(text, WHITE, "")),
        "n_symbols": F.length(text) - F.length(F.translate(text, SYMBOLS, "")),
        "n_dup_lines": F.col("_q_lines.n_dup_lines"),
        "n_repeat_words": F.col("_q_words.n_repeat_words"),
        "n_lines": F.col("_q_lines.n_lines"),
        "n_echoes": F.col("_q_words.n_echoes"),
    }
    return out.withColumn("_q_", F.struct(*[counts[m].cast("long").alias(m) for m in MEASURES])).drop("_q_words", "_q_lines")


def base_failed() -> Column:
    return (F.col("_q_.n_words") < BASE_WORDS) | (100 * F.col("_q_.n_repeat_words") > BASE_REPEAT * F.col("_q_.n_words"))


def _above(rule: tuple, cutoff: Column) -> Column:
    return 100 * F.col(f"_q_.{rule[1]}") > cutoff * F.col(f"_q_.{rule[2]}")


def _log_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 1, by Stirling's series at x + 8."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + F.lit(0.9189385332046727) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5)))
    for k in range(8):
        series = series - F.log(x + k)
    return series


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k) for k < n * p (1 otherwise), summed downward from its largest term."""
    k, n = k.cast("double"), n.cast("double")
    first = F.exp(_log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * log(p) + (n - k) * F.log1p(F.lit(-p)))
    odds = (1 - p) / p
    last = F.least(k, F.lit(float(TERMS))).cast("int")
    total = F.aggregate(
        F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>")),
        F.struct(first.alias("term"), first.alias("sum")),
        lambda a, j: let(a["term"] * (k - j + 1) / (n - k + j) * odds, lambda t: F.struct(t.alias("term"), (a["sum"] + t).alias("sum"))),
        lambda a: a["sum"] + F.when(k > TERMS, a["term"] * k / F.greatest(n * p - k, F.lit(1e-9))).otherwise(F.lit(0.0)),
    )
    return F.when(k >= n * p, F.lit(1.0)).otherwise(total)


def calibrate(measured: DataFrame, labels: DataFrame, stratum: str = "lang", id_column: str = "doc_id", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(_q_stratum, and for each rule its cutoff or null) from the labelled documents."""
    quality = labels.where("quality is not null").groupBy(F.col(id_column).alias("_q_id")).agg(F.min("quality").alias("_q_quality"))
    held = measured.where(~base_failed()).select(F.col(id_column).alias("_q_id"), F.col(stratum).alias("_q_stratum"), "_q_").join(quality, "_q_id")
    good, bad = F.col("_q_quality") == 1, F.col("_q_quality") == 0
    sums = [F.count_if(good).alias("n")]
    for r, rule in enumerate(RULES):
        for c, cutoff in enumerate(rule[3]):
            above = _above(rule, F.lit(cutoff))
            sums += [F.count_if(good & above).alias(f"k_{r}_{c}"), F.count_if(bad & above).alias(f"b_{r}_{c}")]
    counts = held.groupBy("_q_stratum").agg(*sums)
    strata = counts.agg(F.count(F.lit(1)).alias("strata"))
    # a row for each stratum, rule and cutoff, so that one tail expression serves all
    tests = F.array(*[
        F.struct(F.lit(r).alias("rule"), F.lit(cutoff).alias("cutoff"), F.col(f"k_{r}_{c}").alias("k"), F.col(f"b_{r}_{c}").alias("bad"))
        for r, rule in enumerate(RULES)
        for c, cutoff in enumerate(rule[3])
    ])
    tested = counts.crossJoin(F.broadcast(strata)).select("_q_stratum", "n", "strata", F.inline(tests))  # one row
    tail = binomial_tail(F.col("k"), F.col("n"), risk / len(RULES))
    passed = (F.col("n") > 0) & (tail <= error / len(RULES) / F.col("strata"))
    laxer = Window.partitionBy("_q_stratum", "rule").orderBy(F.desc("cutoff")).rowsBetween(Window.unboundedPreceding, 0)
    certified = tested.withColumn("passed", passed).withColumn("certified", F.min("passed").over(laxer))
    best = F.max(F.when(F.col("certified"), F.struct("bad", "cutoff")))
    chosen = certified.groupBy("_q_stratum", "rule").agg(best["cutoff"].alias("cutoff"))
    return chosen.groupBy("_q_stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(rule[0]) for r, rule in enumerate(RULES)])


def judge(measured: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """measured with _q_base_failed and _q_kept."""
    names = [rule[0] for rule in RULES]
    rows = cutoffs.limit(BROADCAST_ROWS + 1).collect()
    renamed = [F.col(n).cast("int").alias(f"_q_cut_{n}") for n in names]
    if len(rows) <= BROADCAST_ROWS:
        cutoffs = F.broadcast(measured.sparkSession.createDataFrame(rows, cutoffs.schema))
    joined = measured.join(cutoffs.select("_q_stratum", *renamed), F.col(stratum).eqNullSafe(F.col("_q_stratum")), "left")
    above = F.lit(False)
    for rule in RULES:
        above = above | F.coalesce(_above(rule, F.col(f"_q_cut_{rule[0]}")), F.lit(False))
    out = joined.withColumn("_q_base_failed", base_failed())
    return out.withColumn("_q_kept", ~F.col("_q_base_failed") & ~above).drop("_q_stratum", *[f"_q_cut_{n}" for n in names])


def keep(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The documents that pass, with their own columns."""
    measured = materialize(measure(docs), "quality")  # with the texts, so that each is measured once
    judged = judge(measured, calibrate(measured, labels, stratum), stratum)
    return judged.where("_q_kept").select(*docs.columns)

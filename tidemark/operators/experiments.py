"""Model experiments: walk-forward ridges from summed Gram matrices, windows, ablations, importance, hold-out."""

from __future__ import annotations

from datetime import date

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import fingerprint
from tidemark.operators.targets import PERIOD
from tidemark.operators.windows import average_rank, correlation, percentile_rank

# Bounds of the ablation and window classes and of the hold-out classes.
NEUTRAL, MATERIAL = 0.003, 0.005
PASS_IC, MARGINAL_IC, WORST_YEAR, POSITIVE_SHARE, MODEL_MARGIN = 0.03, 0.01, -0.01, 0.50, 0.005


def grams(rows: DataFrame, columns: list[str], label: str, end_column: str, frequency: str = "annual") -> DataFrame:
    """Sums of products of (1, columns, label) by the period of the decision and the period of the label's end.

    Every training set of a walk-forward is a sum of these few rows, so all refits, windows and
    ablations need one pass over the data. Rows with a missing value are left out.
    """
    period = lambda c: F.expr(PERIOD[frequency].replace("session", c))
    values = [F.lit(1.0), *[F.col(c).cast("double") for c in columns], F.col(label).cast("double")]
    whole = F.col(end_column).isNotNull() & F.col(label).isNotNull()
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    sums = [F.sum(values[i] * values[j]).alias(f"s_{i}_{j}") for i in range(len(values)) for j in range(i, len(values))]
    return rows.where(whole).groupBy(period("decision_date").alias("decided"), period(end_column).alias("ended")).agg(*sums)


class Grams:
    """The sums on the driver: a row for each pair of periods, which is a few times the number of periods."""

    def __init__(self, table: DataFrame, columns: list[str]):
        self.columns, size = columns, len(columns) + 2
        self.parts: list[tuple[date, date, np.ndarray]] = []
        for row in table.orderBy("decided", "ended").collect():
            one = np.zeros((size, size))
            for i in range(size):
                for j in range(i, size):
                    one[i, j] = one[j, i] = row[f"s_{i}_{j}"]
            self.parts.append((row.decided, row.ended, one))

    def training(self, start: date, years: int | None = None) -> np.ndarray:
        """Sums of the rows decided before the period from start (within the last years) whose labels ended before it too."""
        first = None if years is None else start.replace(year=start.year - years)
        total = np.zeros((len(self.columns) + 2,) * 2)
        for decided, ended, one in self.parts:
            if decided < start and ended < start and (first is None or decided >= first):
                total += one
        return total


def ridge(total: np.ndarray, chosen: list[int], alpha: float) -> tuple[float, np.ndarray]:
    """Intercept and coefficients of a ridge on standardised columns (population spread), from the sums; constants get 0."""
    n, out = total[0, 0], np.zeros(total.shape[0] - 2)
    if n == 0:
        return 0.0, out
    at = [1 + c for c in chosen]
    mean, label = total[0, 1:-1] / n, total[0, -1] / n
    spread = np.sqrt(np.maximum(np.diag(total)[1:-1] / n - mean**2, 0))
    at = [i for i in at if spread[i - 1] > 1e-12]
    if at:
        k = np.array(at) - 1
        covariance = (total[np.ix_(at, at)] - n * np.outer(mean[k], mean[k])) / np.outer(spread[k], spread[k])
        moment = (total[at, -1] - n * mean[k] * label) / spread[k]
        out[k] = np.linalg.solve(covariance + alpha * np.eye(len(at)), moment) / spread[k]
    return float(label - out @ mean), out


def fits(sums: Grams, starts: list[date], policies: dict[str, tuple[int | None, list[str]]], alpha: float) -> list[tuple]:
    """(policy, period, rows, intercept, coefficients): policies name a window in years (or none) and the columns used."""
    found = []
    for policy, (years, columns) in policies.items():
        for start in starts:
            total = sums.training(start, years)
            if total[0, 0] > 0:
                intercept, coefficients = ridge(total, [sums.columns.index(c) for c in columns], alpha)
                found.append((policy, start, int(total[0, 0]), intercept, coefficients.tolist()))
    return found


def predictions(rows: DataFrame, columns: list[str], fitted: list[tuple], frequency: str = "annual", keep: tuple[str, ...] = ()) -> DataFrame:
    """(policy, ticker, decision_date, keep, prediction): each row by its own period's fit. The fits are broadcast, a row for each policy and period."""
    spark = rows.sparkSession
    table = spark.createDataFrame(fitted, "policy string, period date, fit_rows bigint, intercept double, coefficients array<double>")
    x = F.array(*[F.col(c).cast("double") for c in columns])
    complete = F.lit(True)
    for c in columns:
        complete = complete & F.col(c).isNotNull()
    placed = rows.where(complete).withColumn("period", F.expr(PERIOD[frequency].replace("session", "decision_date"))).join(F.broadcast(table), "period")
    score = F.col("intercept") + F.aggregate(F.zip_with(x, F.col("coefficients"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return placed.select("policy", "ticker", "decision_date", *keep, score.alias("prediction"))


def daily_ic(df: DataFrame, keys: list[str], actual: str, score: str, day: str = "decision_date") -> DataFrame:
    """(keys, day, ic): rank correlation of each cross-section; degenerate dates are left out."""
    by = [*keys, day]
    pairs = df.where(F.col(actual).isNotNull() & F.col(score).isNotNull())
    pairs = pairs.withColumns({"_x": average_rank(F.col(actual).cast("double"), by), "_y": average_rank(F.col(score).cast("double"), by)})
    out = pairs.groupBy(*by).agg(correlation(F.col("_x"), F.col("_y")).alias("ic"), F.count_distinct("_x").alias("_nx"), F.count_distinct("_y").alias("_ny"))
    return out.where("_nx > 1 and _ny > 1 and ic is not null").select(*by, "ic")


def summary(daily: DataFrame, keys: list[str], day: str = "decision_date") -> DataFrame:
    """Mean, spread and yearly stability of the daily correlations of each key."""
    spread = F.stddev_samp("ic")
    overall = daily.groupBy(*keys).agg(F.count("ic").alias("days"), F.avg("ic").alias("mean_ic"), F.when(spread > 0, F.avg("ic") / spread).alias("icir"), F.avg((F.col("ic") > 0).cast("double")).alias("pct_positive"))
    yearly = daily.groupBy(*keys, F.year(day).alias("year")).agg(F.avg("ic").alias("m"))
    stable = yearly.groupBy(*keys).agg(F.min("m").alias("worst_year_ic"), F.max("m").alias("best_year_ic"), F.stddev_samp("m").alias("year_ic_std"), F.count_if(F.col("m") > 0).alias("positive_years"), F.count(F.lit(1)).alias("years"))
    return overall.join(stable, keys)


def deltas(found: DataFrame, reference: str) -> DataFrame:
    """found (policy, metrics) with differences to the reference policy's row."""
    names = ["mean_ic", "icir", "pct_positive", "worst_year_ic", "year_ic_std"]
    base = found.where(F.col("policy") == reference).select(*[F.col(n).alias(f"_{n}") for n in names])
    return found.crossJoin(F.broadcast(base)).withColumns({f"delta_{n}": F.col(n) - F.col(f"_{n}") for n in names}).drop(*[f"_{n}" for n in names])  # one row


def ablation_class(delta: Column) -> Column:
    """What leaving a family out did to the mean correlation."""
    return (
        F.when(delta <= -MATERIAL, "important").when(delta <= -NEUTRAL, "moderately_useful").when(delta < NEUTRAL, "neutral_or_redundant")
        .when(delta < MATERIAL, "small_positive_change").otherwise("potentially_harmful")
    )


def ablation_flags(mean: Column, worst_year: Column, icir: Column, uplift: Column) -> Column:
    """strong_contributor and harmful_candidate by the differences to the full model."""
    strong = (mean <= -MATERIAL) | (worst_year <= -MATERIAL)
    harmful = (mean >= MATERIAL) & (worst_year >= -NEUTRAL) & (icir >= -0.02) & (uplift >= -0.001)
    return F.struct(strong.alias("strong_contributor"), harmful.alias("harmful_candidate"))


def window_finding(found: DataFrame, selected: str) -> DataFrame:
    """(policy, material, stable) of the trailing windows against expanding, and the case (A to E) of the selected one."""
    rows = deltas(found, "expanding")
    material = F.col("delta_mean_ic") >= MATERIAL - 1e-15
    stable = material & (F.col("delta_worst_year_ic") >= -NEUTRAL) & (F.col("delta_year_ic_std") <= NEUTRAL)
    marked = rows.withColumns({"material": material, "stable": stable})
    drift = marked.where("policy <> 'expanding'").agg(F.coalesce(F.bool_or("stable"), F.lit(False)).alias("_drift"))
    own = F.col("policy") == selected
    case = F.when(own & (F.col("policy") == "expanding"), "A").when(own & F.col("_drift") & F.col("policy").endswith("8y"), "B").when(own & F.col("_drift"), "C").when(own & (F.col("delta_mean_ic") > 0), "D").when(own, "E")
    return marked.crossJoin(F.broadcast(drift)).withColumn("finding", case).drop("_drift")  # one row


def holdout_class(mean_ic: Column, worst_year: Column, positive_share: Column, uplift: Column) -> Column:
    """hard_fail, fail, pass or marginal, in this order of precedence."""
    good = (mean_ic >= PASS_IC) & (worst_year > WORST_YEAR) & (positive_share >= POSITIVE_SHARE) & (uplift > 0)
    return F.when(mean_ic <= 0, "hard_fail").when(mean_ic < MARGINAL_IC, "fail").when((uplift <= 0) & (mean_ic < PASS_IC), "fail").when(good, "pass").otherwise("marginal")


def relative_class(first: Column, second: Column, names: tuple[str, str]) -> Column:
    """Which of two models has the higher mean correlation, beyond a margin."""
    delta = first - second
    return F.when(delta > MODEL_MARGIN + 1e-12, f"{names[0]}_outperforms_{names[1]}").when(delta < -MODEL_MARGIN - 1e-12, f"{names[1]}_outperforms_{names[0]}").otherwise("approximately_equal")


def contract_faults(out_of_sample: DataFrame) -> DataFrame:
    """(fault, rows) of predictions that break their contract: task, horizon, target_name, training_cutoff, decision_date, split."""
    named = F.concat(F.when(F.col("task") == "regression", "target_return_").when(F.col("task") == "classification", "target_positive_").when(F.col("task") == "ranking", "target_rank_"), F.col("horizon"), F.lit("d"))
    rules = [
        (F.col("prediction").isNull() | F.isnan("prediction"), "prediction_missing"),
        (~F.col("horizon").isin(5, 10, 20), "unsupported_horizon"),
        (~F.coalesce(F.col("target_name") == named, F.lit(False)), "target_name_mismatch"),
        (F.coalesce(F.col("training_cutoff") >= F.col("decision_date"), F.lit(True)), "cutoff_not_before_decision"),
        (~F.col("split").isin("validation", "test", "walk_forward"), "unknown_split"),
    ]
    listed = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for bad, name in rules]), lambda x: x.isNotNull())
    return out_of_sample.select(F.explode(listed).alias("fault")).groupBy("fault").agg(F.count(F.lit(1)).alias("rows"))


def ranked(predicted: DataFrame, keys: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Ranking scores derived from fitted predictions without a refit: every key must have one."""
    if not keys.join(predicted, ["ticker", "decision_date"], "left_anti").isEmpty():
        raise ValueError("predictions don't cover the ranking rows")
    aligned = predicted.join(keys, ["ticker", "decision_date"], "left_semi")
    return aligned.withColumn("predicted_rank", percentile_rank(F.col("prediction"), [*by, "decision_date"]))


def candidate(contract: dict) -> dict:
    """A frozen candidate: its contract and the contract's fingerprint."""
    return contract | {"candidate_fingerprint": fingerprint(contract, ascii_only=True)}


def consistency(spark: SparkSession, expected: dict, observed: dict) -> DataFrame:
    """(check, expected, observed, passed) of every field of a frozen contract, and of its fingerprint."""
    names = [n for n in expected if n != "candidate_fingerprint"]
    rows = [(n, str(expected[n]), str(observed.get(n)), expected[n] == observed.get(n)) for n in names]
    again = fingerprint({n: v for n, v in observed.items() if n != "candidate_fingerprint"}, ascii_only=True)
    rows.append(("candidate_fingerprint", str(expected.get("candidate_fingerprint")), again, expected.get("candidate_fingerprint") == again))
    return spark.createDataFrame(rows, "check string, expected string, observed string, passed boolean")


def open_once(spark: SparkSession, path: str, contract: dict) -> str:
    """Open a hold-out once: the record is created before anything is read, and only an exact repetition may open it again."""
    from tidemark.sources.store import exists, read_text

    raw = fingerprint(contract)
    if exists(spark, path):
        if read_text(spark, path) != raw:
            raise ValueError("the hold-out has been opened with another contract")
        return "exact_reproduction"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, False)  # fails if another run was first
    out.write(bytearray(raw.encode()))
    out.close()
    return "first_official_evaluation"

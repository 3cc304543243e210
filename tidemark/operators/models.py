"""Predictors and their training sets: baselines, train-fitted preprocessing, linear and tree models, walk-forward."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIQUIDITY = ("avg_dollar_volume_20d", "avg_dollar_volume_60d")
# Frozen profiles, forests as (trees, depth, leaf, features), boosting as (rounds, depth, rate, leaf). Depth 30 is the deepest there is.
FOREST = {"small": (300, 4, 100, "sqrt"), "medium": (400, 8, 50, "sqrt"), "wide": (400, 30, 100, "0.5")}
BOOSTED = {
    "xgb-small": (300, 3, 0.03, 20), "xgb-reg": (600, 3, 0.02, 50), "xgb-medium": (500, 4, 0.03, 20),
    "lgbm-small": (300, 4, 0.03, 100), "lgbm-reg": (600, 4, 0.02, 150), "lgbm-medium": (500, 6, 0.03, 75),
}


def train_mean(train: DataFrame, rows: DataFrame, label: str) -> DataFrame:
    """The training mean (or prior of a 0/1 label) as everyone's prediction."""
    return rows.crossJoin(F.broadcast(train.agg(F.avg(label).alias("prediction"))))


class Preprocessor:
    """log1p of liquidity, median imputation, dropped constants, and standardisation, all learned from training rows."""

    def __init__(self, columns: list[str], scale: bool = True):
        self.columns, self.scale = columns, scale

    def _logged(self, df: DataFrame) -> DataFrame:
        names = [c for c in self.columns if c in LIQUIDITY]
        checked = {c: F.when(F.col(c) < 0, F.raise_error(F.lit(f"{c} is negative"))).otherwise(F.log1p(c)) for c in names}
        return df.withColumns(checked) if names else df

    def fit(self, train: DataFrame) -> Preprocessor:
        train = self._logged(train)
        medians = train.agg(*[F.percentile(c, F.lit(0.5)).alias(c) for c in self.columns]).first()
        self.medians = {c: float(medians[c]) for c in self.columns if medians[c] is not None}
        filled = train.fillna(self.medians)
        stats = filled.agg(*[x for c in self.medians for x in (F.avg(c).alias(f"{c}_m"), F.stddev_pop(c).alias(f"{c}_s"), F.var_pop(c).alias(f"{c}_v"))]).first()
        self.kept = [c for c in self.medians if stats[f"{c}_v"] and stats[f"{c}_v"] > 0]
        self.stats = {c: (stats[f"{c}_m"], stats[f"{c}_s"]) for c in self.kept}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        filled = self._logged(df).fillna({c: self.medians[c] for c in self.kept})
        values = {f"z_{c}": (F.col(c) - self.stats[c][0]) / self.stats[c][1] if self.scale else F.col(c) for c in self.kept}
        return VectorAssembler(inputCols=list(values), outputCol="features").transform(filled.withColumns(values))


def ridge(train: DataFrame, label: str, alpha: float):
    """Ridge with the penalty alpha on the sum of squares; the solver's own penalty is alpha * sd(label) / n."""
    n, spread = train.agg(F.count(label), F.stddev_pop(label)).first()
    return LinearRegression(labelCol=label, solver="normal", regParam=alpha * (spread or 0.0) / max(n, 1), elasticNetParam=0.0, standardization=False).fit(train)


def logistic(train: DataFrame, label: str, c: float):
    return LogisticRegression(labelCol=label, regParam=1 / (c * max(train.count(), 1)), elasticNetParam=0.0, standardization=False, maxIter=200).fit(train)


def forest(train: DataFrame, label: str, profile: str = "small", seed: int = 42):
    trees, depth, leaf, chosen = FOREST[profile]
    return RandomForestRegressor(labelCol=label, numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, featureSubsetStrategy=chosen, seed=seed).fit(train)


def boosted(train: DataFrame, label: str, rounds: int = 50, depth: int = 4, rate: float = 0.05, leaf: int = 1, seed: int = 42):
    chosen = {"subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "seed": seed}
    return GBTRegressor(labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=rate, minInstancesPerNode=leaf, **chosen).fit(train)


def run_profiles(train: DataFrame, test: DataFrame, label: str, fits: dict) -> DataFrame:
    """(profile, mae, rmse, pearson) of models on prepared rows; fits: name -> function of (train, label), a few, each distributed."""
    from tidemark.operators.metrics import regression_errors

    out = None
    for name, fit in fits.items():
        one = regression_errors(fit(train, label).transform(test), label, "prediction").withColumn("profile", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def frozen_profiles() -> dict:
    """The frozen forests and boosted trees, as run_profiles takes them."""
    forests = {f"rf-{p}": lambda train, label, p=p: forest(train, label, p) for p in FOREST}
    return forests | {p: lambda train, label, own=own: boosted(train, label, *own) for p, own in BOOSTED.items()}


def probability(model, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("probability_1", vector_to_array("probability")[1])


def pipeline(stages: list) -> Pipeline:
    return Pipeline(stages=stages)


def permuted(df: DataFrame, column: str, seed: int = 7) -> DataFrame:
    """df with one column shuffled among its rows, by joining on hash-ordered places within buckets of dates."""
    from pyspark.sql import Window

    a = df.withColumn("_k", F.row_number().over(Window.partitionBy("decision_date").orderBy("ticker")))
    b = df.select("decision_date", F.col(column).alias("_v"), F.row_number().over(Window.partitionBy("decision_date").orderBy(F.xxhash64("ticker", F.lit(seed)))).alias("_k"))
    return a.join(b, ["decision_date", "_k"]).withColumn(column, F.col("_v")).drop("_k", "_v")


def walk_forward(rows: DataFrame, periods: Iterable, label: str, end_column: str, fit) -> DataFrame:
    """Out-of-sample predictions: for each period a model of the rows whose labels end before it.

    periods: rows with prediction_start and prediction_end, a few; every fit is distributed.
    """
    out = None
    for p in periods:
        train = rows.where((F.col("decision_date") < F.lit(p.prediction_start)) & (F.col(end_column) < F.lit(p.prediction_start)) & F.col(label).isNotNull())
        test = rows.where(F.col("decision_date").between(F.lit(p.prediction_start), F.lit(p.prediction_end)))
        if train.limit(1).isEmpty():
            continue
        one = fit(train, test).withColumn("sequence", F.lit(p.sequence))
        out = one if out is None else out.unionByName(one)
    return out


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> bool:
    """Whether both hold the same prediction keys."""
    a, b = left.select(*keys), right.select(*keys)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def scored(meta: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """meta with each row's prediction; a missing one is an error."""
    missing = meta.join(predictions, keys, "left_anti")
    if not missing.isEmpty():
        raise ValueError("rows without a prediction")
    return meta.join(predictions, keys)


def change_class(delta: Column, least: float = 0.005) -> Column:
    """Improvement, deterioration or neither, by a materiality bound."""
    return F.when(delta >= least, "improved").when(delta <= -least, "worse").otherwise("similar")

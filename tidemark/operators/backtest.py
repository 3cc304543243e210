"""Runs of the simulation as DataFrames."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.sizes import small
from tidemark.operators.simulation import FIELDS, INPUT, OUTPUT, Config, simulate


def _shaped(df: DataFrame, kind: str, run: Column, **columns) -> DataFrame:
    names = [c.split() for c in INPUT.split(", ")]
    given = {"run_id": run, "kind": F.lit(kind)} | columns
    return df.select(*[given[n].cast(t).alias(n) if n in given else F.lit(None).cast(t).alias(n) for n, t in names])


def inputs(runs: DataFrame, calendar: DataFrame, bars: DataFrame, actions: DataFrame, targets: DataFrame) -> DataFrame:
    """The simulation's rows: each run gets the sessions, and the bars and actions of the names it ever targets.

    runs: run_id; targets: run_id, decision_date, ticker (null for all cash), weight.
    """
    names = targets.where("ticker is not null").select("run_id", "ticker").distinct()
    run = F.col("run_id")
    parts = [
        _shaped(runs.crossJoin(small(calendar)), "session", run, session=F.col("session")),
        _shaped(bars.join(names, "ticker"), "bar", run, session=F.col("trading_date"), ticker=F.col("ticker"), open=F.col("open"), close=F.col("close"), available=F.lit(True)),
        _shaped(actions.join(names, "ticker"), "action", run, session=F.col("effective_date"), ticker=F.col("ticker"), factor=F.col("split_factor"), amount=F.col("dividend_cash"), other=F.col("action_type")),
        _shaped(targets, "target", run, session=F.col("decision_date"), ticker=F.col("ticker"), weight=F.col("weight")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def run_all(rows: DataFrame, config: Config | None = None, isolate: bool = False) -> DataFrame:
    """Records (orders, executions, cash flows, snapshots) of all runs, each run in one task.

    isolate: a run whose input can't be simulated gives one failure record instead of failing all.
    """
    config = config or Config()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            return simulate(pdf, config)
        except ValueError as error:
            if not isolate:
                raise
            failed = {"run_id": pdf["run_id"].iloc[0], "record": "failure", "status": type(error).__name__, "reason": str(error)}
            return pd.DataFrame([failed], columns=FIELDS).astype(object).where(lambda x: x.notna(), None)

    return rows.groupBy("run_id").applyInPandas(run, OUTPUT)


def benchmark_report(performance: DataFrame, benchmark: str) -> DataFrame:
    """Each run's performance with its excess over the benchmark's; runs over other sessions are an error."""
    own = performance.where(F.col("run_id") == benchmark).select(F.col("cumulative_return").alias("_r"), F.col("cagr").alias("_c"), F.col("observations").alias("_n"))
    rows = performance.where(F.col("run_id") != benchmark).crossJoin(F.broadcast(own))  # one row
    same = F.when(F.col("observations") == F.col("_n"), F.col("observations")).otherwise(F.raise_error(F.lit("benchmark and run cover other sessions")))
    return rows.withColumns({"observations": same, "excess_cumulative_return": F.col("cumulative_return") - F.col("_r"), "excess_cagr": F.col("cagr") - F.col("_c")}).drop("_r", "_c", "_n")

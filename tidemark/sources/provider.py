"""Extension points: a Python data source of provider JSON with retries, and a table function."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import udtf


class Throttled(OSError):
    """The provider asks to wait."""

    def __init__(self, seconds: float = 0.0):
        super().__init__(f"throttled for {seconds} s")
        self.seconds = seconds


def with_retries(call: Callable, attempts: int = 4, first: float = 0.5, sleep: Callable[[float], None] = time.sleep):
    """call(), again after an OSError: waits double, and are as long at least as a throttled provider asks."""
    for k in range(attempts):
        try:
            return call()
        except OSError as error:
            if k + 1 == attempts:
                raise
            sleep(max(first * 2**k, getattr(error, "seconds", 0.0)))
    raise ValueError("no attempt is allowed")


class BarsSource(DataSource):
    """Daily bars of `tickers` (comma-separated) from JSON files {folder}/{ticker}.json, a partition for each.

    The folder is one that executors see; `attempts` bounds the retries of a read.
    """

    @classmethod
    def name(cls) -> str:
        return "tidemark_bars"

    def schema(self) -> str:
        return "ticker string, trading_date string, close double, volume double"

    def reader(self, schema) -> DataSourceReader:
        return _BarsReader(self.options)


class _BarsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.attempts = options["folder"], int(options.get("attempts", 4))
        self.tickers = [t for t in options["tickers"].split(",") if t]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(t) for t in self.tickers]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        def fetch() -> list[dict]:
            with open(f"{self.folder}/{partition.value}.json", encoding="utf-8") as file:
                return json.load(file)

        for bar in with_retries(fetch, self.attempts):
            yield partition.value, bar["date"], float(bar["close"]), float(bar["volume"])


def register(spark: SparkSession) -> None:
    """Make the data source and the table function known to a session."""
    spark.dataSource.register(BarsSource)
    spark.udtf.register("word_spans", WordSpans)


@udtf(returnType="word string, first int, last int")
class WordSpans:
    """Each word of a text between white space, with its character span."""

    def eval(self, text: str):
        import re

        for m in re.finditer(r"\S+", text or ""):
            yield m.group(), m.start(), m.end()

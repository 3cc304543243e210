"""What the operators share: written intermediate tables, Arrow batches, null rules."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []
#: Bytes of a row group, which a writer holds in memory.
ROW_GROUP = 16 << 20
LET_GO_SECONDS = 2.0
_let_go_at = 0.0


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where it is unset the session must be local, as in tests; then a temporary folder is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    _let_go(spark)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def _let_go(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of earlier steps, which it does when the driver collects its garbage.

    At most once in LET_GO_SECONDS, so that it costs a long job nothing and a short one little.
    """
    global _let_go_at
    if time.monotonic() - _let_go_at >= LET_GO_SECONDS:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _let_go_at = time.monotonic()


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_written_path", None)
        if path:
            _delete(df.sparkSession, path)
            _written[:] = [x for x in _written if x[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session is already gone; the shared folder has its own clean-up
            return


def per_batch(function: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that maps batch to batch, in pieces of bounded text."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                yield function(part)

    return run


def slices(batch: pa.RecordBatch, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part has about most_bytes at most, one row at least."""
    rows = batch.num_rows
    step = rows if batch.nbytes <= most_bytes else max(1, int(rows * most_bytes / batch.nbytes))
    for start in range(0, rows, max(1, step)):
        yield batch.slice(start, step)
    pa.default_memory_pool().release_unused()


#: Least and most bits of a Bloom filter (128 KB and 64 MB), and bits for each row between them.
BLOOM_LEAST, BLOOM_MOST, BLOOM_PER_ROW = 1 << 20, 1 << 29, 16


def bloom(df: DataFrame, column: str) -> np.ndarray:
    """Bloom filter over a long column that is itself a good hash; df is a written table.

    It has BLOOM_PER_ROW bits a row, rounded up to a power of two, which lets 1.4 % of other values
    pass; BLOOM_MOST bounds it, from where on it lets more pass. The bits are united by a group-by
    with map-side combining; the driver gets one row for each 64-bit word that isn't zero.
    """
    bits = min(BLOOM_MOST, max(BLOOM_LEAST, 1 << (BLOOM_PER_ROW * df.count()).bit_length()))
    low = F.col(column).bitwiseAND(bits - 1)
    high = F.shiftrightunsigned(column, 32).bitwiseAND(bits - 1)
    words = (
        df.select(F.explode(F.array(low, high)).alias("at"))
        .groupBy(F.shiftright("at", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("mask"))
        .toArrow()
    )
    out = np.zeros(bits // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("mask").to_numpy()
    return out.view(np.uint64)


def maybe(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the 64-bit hashes may be in the filter."""
    hashes = hashes.view(np.uint64)
    found = np.ones(len(hashes), bool)
    for at in (hashes, hashes >> np.uint64(32)):
        at = at & np.uint64(64 * len(filter_) - 1)
        found &= (filter_[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return found


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")

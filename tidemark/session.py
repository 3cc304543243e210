"""Session set-up."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Bytes of an Arrow batch sent to a Python worker; bounds the memory of both sides, whatever the rows' length.
ARROW_BYTES = 4 << 20
_ARROW_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship_code(spark: SparkSession) -> SparkSession:
    """Give the package to the executors' Python workers, once for each application, and bound Arrow batches."""
    if spark.sparkContext.getConf().get(_ARROW_SETTING) is None:
        spark.conf.set(_ARROW_SETTING, str(ARROW_BYTES))
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        root = Path(__file__).parent
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w") as packed:
            for path in sorted(root.rglob("*.py")):
                packed.write(path, path.relative_to(root.parent))
        target = os.path.join(tempfile.mkdtemp(prefix="tidemark-code-"), "tidemark.zip")
        Path(target).write_bytes(raw.getvalue())
        spark.sparkContext.addPyFile(target)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir), also set for checkpoints.

    Where it is unset the session must be local, as in tests; then a temporary folder is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again, which cuts its lineage."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_session(cores: str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session with the settings that the library counts on (UTC, AQE)."""
    return ship_code(
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )

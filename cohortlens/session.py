"""Session helpers: recommended settings, and the shared folder for written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that suit these plans. They are advice for whoever starts the session. Of a running
# one only ``spark.checkpoint.dir`` is set, by ``work_dir`` on a local master without it.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # windowed statistics keep one state row per window and distinct item
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}

SHUFFLE_PARTITION_BYTES = 256 << 20


def settings_for(input_bytes: int, cores: int) -> dict[str, str]:
    """``RECOMMENDED`` with partitions sized for an input: counting items shuffles at most about
    the columns read. Start high; adaptive execution joins what turns out small."""
    partitions = -(-input_bytes // SHUFFLE_PARTITION_BYTES)
    return {**RECOMMENDED, "spark.sql.shuffle.partitions": str(max(partitions, cores))}


_CHECKPOINT_DIR = "spark.checkpoint.dir"


def work_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, from ``spark.checkpoint.dir``.

    Without the setting, a local session gets a folder of its own; on a cluster that folder
    would be unreachable for other machines, so it is an error there.
    """
    configured = spark.conf.get(_CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(
        _CHECKPOINT_DIR
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_CHECKPOINT_DIR} to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="cohortlens-")
    spark.conf.set(_CHECKPOINT_DIR, folder)
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    return f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"


def write_and_read(df: DataFrame, label: str) -> DataFrame:
    """The same rows, read back from a table in the shared folder: a cut in the lineage that
    survives the loss of executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

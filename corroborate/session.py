"""Session helpers: runtime settings, reliable checkpoints, bounded broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Texts and packed arrays are long rows: small batches bound what a worker holds.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    # A task that writes holds a whole row group.
    "parquet.block.size": str(32 << 20),
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings the operators assume."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    A cluster names a shared folder in ``spark.checkpoint.dir``. Only a local
    master without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir"
    )
    current = sc._jsc.sc().getCheckpointDir()
    if configured:
        if not current.isDefined():
            sc.setCheckpointDir(configured)
        return configured
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    path = tempfile.mkdtemp(prefix="corroborate-ckpt-")
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder and restart its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder for a run's own files, below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_compressed(df: DataFrame, path: str) -> None:
    """Write ``df`` in small row groups, so that few files still spread over all cores."""
    df.write.option("compression", "zstd").option("parquet.block.size", 4 << 20).parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to compressed files in a folder of its own, and read again.

    Takes a fraction of a checkpoint where words or keys recur.
    """
    path = scratch_path(df.sparkSession, name)
    write_compressed(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_scratch(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``scratch_path`` gave out, once nothing reads it any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)

"""Session settings every plan relies on."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    # Timestamps are compared and printed in UTC.
    "spark.sql.session.timeZone": "UTC",
    # Runtime plans: coalesce small partitions, turn a join into a broadcast only when
    # the measured size allows it, and split partitions that one hot key filled.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Streaming state lies off the heap and on disk, and a checkpoint holds changes only.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that already exists."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    # Python workers import this package from where the driver has it; a cluster gets it by --py-files.
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[1]))
    return spark


def local_session(cores: int | str = 8, app: str = "sundown") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own; on a cluster a
    machine-local folder would lose the checkpoint together with its executor.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="run-checkpoint-")
    context.setCheckpointDir(configured)


def cut_lineage(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write the rows as a table in the shared checkpoint folder and continue from that table.

    A lost executor then costs a reread, not a recomputation; later plans read only the
    columns they need, and the planner knows the size of what it joins.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def cut_bucketed(df: DataFrame, key: str) -> DataFrame:
    """:func:`cut_lineage` into buckets by ``key``: joins and groupings on it read the table without a shuffle."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"cut_{uuid.uuid4().hex}"
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}"
    # One file a bucket: a task of the shuffle holds one.
    df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", path).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay
    return table

"""Spark session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Streaming state lives in RocksDB: on local disk, with one bounded amount of native memory
# per executor for all state partitions, however many keys there are. Spark's default
# store holds every key on the executor's heap. Streams start with these also in a
# session that was built elsewhere (``streaming.summary_stream``).
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # checkpoint only the state changes of each batch, not full snapshots
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "500",
    # numRowsTotal of a stream's progress would cost a second look-up for every row
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}

# Settings every job wants: adaptive execution (runtime partition coalescing,
# skew-join splitting, broadcast conversion once real sizes are known), a
# size-checked broadcast threshold, and a single UTC session zone so
# timestamp <-> instant conversions never depend on the host.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    # target post-shuffle partition size; AQE coalesces small ones and splits skewed ones
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * 1024 * 1024),
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
    "spark.sql.parquet.filterPushdown": "true",
    **STATE_CONF,
    # delete reliable-checkpoint files once nothing references them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, app_name: str = "perkflow",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Create (or reuse) a session with the library defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written intermediate tables.

    Read from ``spark.checkpoint.dir`` (or the context's checkpoint dir). Only
    a local-mode session without one gets a fresh private folder; a cluster
    session without the setting is an error, because a machine-local folder
    would not survive the loss of an executor.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        return conf_dir.rstrip("/")
    ctx_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if ctx_dir.isDefined():
        return ctx_dir.get().rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder "
            "(HDFS/S3/ABFS) before running stateful or materializing jobs")
    path = tempfile.mkdtemp(prefix="perkflow-ckpt-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared checkpoint folder."""
    return os.path.join(checkpoint_root(spark), *parts)


def materialize(df):
    """Write ``df`` once to the shared checkpoint folder and read it back.

    For an intermediate that several branches of one plan consume (Catalyst
    prunes each branch differently, so they would not share an exchange and
    would each recompute it from the source). A reliable checkpoint - not a
    local one - survives the loss of the executors that computed it.
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)

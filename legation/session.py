"""Session construction and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every session of this package wants. Adaptive execution re-plans
# joins and shuffle partition counts from runtime sizes, splits skewed join
# partitions and turns shuffled joins into broadcasts when a side turns out
# small. All of these are Spark defaults in 4.x; they are stated so a cluster
# profile that turned one off gets it back.
_SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(
    master: str | None = None,
    app_name: str = "legation",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
    max_partition_bytes: str | None = None,
) -> SparkSession:
    """Get or create a session with the package's settings.

    ``master`` is only set when given (a cluster launcher sets it otherwise).
    ``shuffle_partitions`` should follow the data size: at 100 TB of input,
    about one partition per 200 MB of shuffled data; AQE coalesces the small
    ones, so erring high is cheap. ``max_partition_bytes`` (for example
    ``"512m"``) sets the largest scan split: larger splits mean fewer scan
    tasks on very large inputs.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_SESSION_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if max_partition_bytes:
        conf["spark.sql.files.maxPartitionBytes"] = max_partition_bytes
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_dir(spark: SparkSession, name: str | None = None) -> str:
    """A fresh sub-folder of the shared folder the cluster names for checkpoints.

    The folder is read from the session (``SparkContext.getCheckpointDir`` or
    ``spark.checkpoint.dir``). Only a local-mode session without one gets a
    folder of its own under the temporary directory; on a cluster an unset
    checkpoint folder is an error, because a machine-local path is not visible
    to the executors and does not survive their loss.
    """
    base = spark.sparkContext.getCheckpointDir()
    if not base:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base:
            spark.sparkContext.setCheckpointDir(base)
    if not base:
        if not _is_local(spark):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; set it to a shared folder"
            )
        base = tempfile.mkdtemp(prefix="legation-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir() or base
    leaf = f"{name or 'work'}-{uuid.uuid4().hex[:12]}"
    return base.rstrip("/") + "/" + leaf


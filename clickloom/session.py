"""Spark session and the shared folder that jobs keep intermediate tables in."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

GIB = 1024**3


def shuffle_partitions_for(input_bytes: int, per_partition: int = 2 * GIB) -> int:
    """Starting number of shuffle partitions for an input of this size.

    The aggregates here shuffle far less than they read; two GiB read per shuffle
    partition leaves each at a size that fits an executor, however large the input. Adaptive
    execution merges the partitions that turn out small.
    """
    return max(-(-input_bytes // per_partition), 8)


def input_size(spark: SparkSession, path: str) -> int:
    """Bytes of all files at a path, from the file system's listing."""
    places = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = places.getFileSystem(spark._jsc.hadoopConfiguration())
    found = system.globStatus(places) or []
    return sum(system.getContentSummary(status.getPath()).getLength() for status in found)


def size_shuffles(spark: SparkSession, input_bytes: int) -> None:
    """Set the session's shuffle partitions for an input of this size."""
    spark.conf.set("spark.sql.shuffle.partitions", str(shuffle_partitions_for(input_bytes)))


def s3a_settings(
    endpoint: str, access_key: str, secret_key: str, path_style: bool = True, ssl: bool = True
) -> dict[str, str]:
    """Session settings for reading from an S3-compatible object store."""
    # The names that Hadoop gives these settings.
    return {
        "spark.hadoop.fs.s3a.impl": "org.apache.hadoop.fs.s3a.S3AFileSystem",
        "spark.hadoop.fs.s3a.endpoint": endpoint,
        "spark.hadoop.fs.s3a.access.key": access_key,
        "spark.hadoop.fs.s3a.secret.key": secret_key,
        "spark.hadoop.fs.s3a.path.style.access": str(path_style).lower(),
        "spark.hadoop.fs.s3a.connection.ssl.enabled": str(ssl).lower(),
    }


def create_session(
    app_name: str = "clickloom",
    master: str | None = None,
    input_bytes: int | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """A session with adaptive execution, UTC, and shuffles sized for the input.

    ``conf`` wins over the defaults; pass ``s3a_settings(..)`` and cluster settings in it.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    if input_bytes is not None:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions_for(input_bytes))
    settings.update(conf or {})
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which every executor must be able to reach.

    ``spark.checkpoint.dir`` names it. There is no fallback: see ``set_folder_if_unset``.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def runs_folder(spark: SparkSession) -> str:
    """Where runs keep results for being resumed.

    Spark makes a folder per application below the configured one; this one is next to it, so that
    other applications find it.
    """
    return f"{shared_folder(spark).rsplit('/', 1)[0]}/clickloom-runs"


def set_folder_if_unset(spark: SparkSession) -> None:
    """For tests and trial runs in one process: a temporary folder where none is configured.

    Refused where executors are processes of their own, since they could not see the folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None):
        return
    if not context._jsc.sc().isLocal():
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="clickloom-"))


def fresh_folder(spark: SparkSession, purpose: str) -> str:
    """An unused path below the shared folder."""
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder made by ``fresh_folder``, on whatever file system it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

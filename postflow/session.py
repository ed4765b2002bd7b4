"""Session settings the operators rely on, and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: Settings that change results or plans. All of them can be set on a running session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    # bounds what a Python task holds of its input at once
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
    # base64() wraps its output at 76 characters unless told otherwise
    "spark.sql.chunkBase64String.enabled": "false",
    # month=2024-01 would be read back as a date
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply :data:`RUNTIME_CONF` to ``spark``; sizing (executors, shuffle partitions) stays with the job."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "postflow", master: str | None = None, **conf: str) -> SparkSession:
    """A configured session; ``conf`` holds further settings (pass dotted keys with ``**{...}``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Where it is unset and Spark runs in one process (tests), a temporary folder takes its place; on a
    cluster a machine-local folder would lose data with its executor, so that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    local = spark.conf.get("spark.postflow.localDir", None)
    if not local:
        local = tempfile.mkdtemp(prefix="postflow-")
        spark.conf.set("spark.postflow.localDir", local)
    return local


def new_shared_path(spark: SparkSession, name: str) -> str:
    """A path below :func:`shared_dir` that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

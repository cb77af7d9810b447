"""Session set-up."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Runtime settings the library relies on; all can be set on a session that is already running.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    # Odd stamps read the same everywhere.
    "spark.sql.legacy.timeParserPolicy": "CORRECTED",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}

# Settings that a session can only start with. Looking up the caller of every column expression takes
# longer than planning the query.
STARTUP_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the library's runtime settings to an existing session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def get_session(app_name: str = "clftally", **conf: str) -> SparkSession:
    """Create or get a session with the library's settings; ``conf`` keys use ``__`` for dots.

    Master, memory and shuffle partitions are the cluster's to choose and are left alone.
    """
    builder = SparkSession.builder.appName(app_name)
    chosen = {key.replace("__", "."): value for key, value in conf.items()}
    for key, value in {**STARTUP_SETTINGS, **chosen}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())

"""Session settings and the shared folder used for checkpoints and staged tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# The package's own name for the shared folder, for sessions that cannot be restarted.
SHARED_DIR = "spark.skyledger.shared.dir"

# Runtime settings every plan here is written for. They can be changed per session and
# none of them depends on the size of the machine.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Wide projections otherwise become methods the JVM refuses to compile to machine code.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that somebody else created."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", app: str = "skyledger", memory: str = "12g") -> SparkSession:
    """A single-JVM session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``, or else in ``SHARED_DIR``.

    Only a local master without either (tests, a laptop) gets a fresh scratch folder, which the
    session then remembers under ``SHARED_DIR``; ``spark.checkpoint.dir`` cannot be set at run time.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(SHARED_DIR, None)
    if not named:
        if not spark.sparkContext.master.startswith(("local[", "local*")) and (
            spark.sparkContext.master != "local"
        ):
            raise RuntimeError(
                f"set spark.checkpoint.dir or {SHARED_DIR} to a folder all executors share"
            )
        named = tempfile.mkdtemp(prefix="skyledger-")
        spark.conf.set(SHARED_DIR, named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, never reused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    For results that several later steps read: the raw input is scanned once, the plan stays
    short, lost executors cost nothing that was staged, and the planner knows the real size.
    ``options`` are those of the Parquet writer.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Session settings and the shared work folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job relies on. They are set only where the cluster has
# not chosen a value itself, except for the time zone, which results depend on.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join side even where that costs one more shuffle above it:
    # one card may hold a third of all sales.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators are written for."""
    chosen = spark.conf.getAll  # by the cluster, the builder or the user
    for key, value in DEFAULTS.items():
        if key not in chosen:
            spark.conf.set(key, value)
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def get_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "marketloom") -> SparkSession:
    """A local session for tests and the benchmark; on a cluster use spark-submit's."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session that names none, where driver and executors are one
    process, gets a temporary folder, one per application.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master, app = spark.sparkContext.master, spark.sparkContext.applicationId
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        if app not in _LOCAL_FOLDERS:
            _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="marketloom-")
        folder = _LOCAL_FOLDERS[app]
    return folder.rstrip("/")


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/marketloom/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage and survives the loss of executors. Used where two branches
    must see the very same rows, and for lookup tables of one row per card: read
    from files their true size is known, so Spark broadcasts them below its
    threshold and joins by shuffle above it. Straight from an aggregation it
    would have to guess, and shuffle the large side by card to find out.
    """
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

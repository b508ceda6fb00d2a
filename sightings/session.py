"""Session helpers: one place for the configuration every job relies on.

On a cluster the session is created by the platform; ``configure`` only fills in settings that are
unset, so cluster-provided values (checkpoint dir, partition counts) always win.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_PKG_DIR = os.path.dirname(os.path.abspath(__file__))
_SHIPPED: set[int] = set()

# Settings the operators assume. AQE lets the runtime pick broadcast for small join sides (after
# measuring them) and split skewed shuffle partitions.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8, app: str = "sightings") -> SparkSession:
    """Local/test session. Cluster jobs use ``SparkSession.builder.getOrCreate()`` + ``configure``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("SIGHTINGS_DRIVER_MEMORY", "8g"))
        # checkpoints written by the ordered operators are removed once their plans are gone
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Set defaults that are unset, make sure a checkpoint dir exists and ship the package."""
    for k, v in DEFAULTS.items():
        if k == "spark.sql.session.timeZone" or spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def is_local_master(master: str | None) -> bool:
    """True if driver and executors are one process."""
    return (master or "").split("[")[0] == "local"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    A local session without one gets a scratch folder; on a cluster that would be a folder on each
    machine's own disk, so there a missing setting is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not is_local_master(sc.master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines share (master {sc.master})")
        configured = tempfile.mkdtemp(prefix="sightings-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def written(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared checkpoint folder and read back: computed once, lineage cut there."""
    path = f"{checkpoint_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to executors so pandas UDFs can import it (once per SparkContext)."""
    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    out = os.path.join(tempfile.mkdtemp(prefix="sightings-pkg-"), "sightings.zip")
    root = os.path.dirname(_PKG_DIR)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zf:
        for dirpath, _dirs, files in os.walk(_PKG_DIR):
            if "__pycache__" in dirpath:
                continue
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(dirpath, name)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(key)

"""Session helpers shared by all operators."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
LOCAL_CHECKPOINT_DIR = "/tmp/lexiloom-checkpoints"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's source to the Python workers of the session, once, wherever they start."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parent
        made = shutil.make_archive(str(Path(tempfile.mkdtemp()) / package.name), "zip", package.parent, package.name)
        spark.sparkContext.addPyFile(made)
        _shipped.add(app)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``root``."""
    ship(spark)
    return spark.read.parquet(f"{root}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; a local session without one gets a folder of its own, a cluster without one fails."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get(CHECKPOINT_CONF, None)
        if named is None and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError(f"{CHECKPOINT_CONF} is not set: a cluster needs a shared folder")
        context.setCheckpointDir(named or LOCAL_CHECKPOINT_DIR)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage (survives lost executors)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder, for tables that later steps read."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid4().hex}"

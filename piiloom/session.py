"""Session settings and shared folders."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A build side above this many rows is never broadcast by this package.
BROADCAST_ROWS = 200_000


def session(app: str = "piiloom", **settings: str) -> SparkSession:
    """A session with the settings the package is tuned for; arguments override."""
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    builder = SparkSession.builder.appName(app)
    for key, value in {**defaults, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the cluster's ``spark.checkpoint.dir``.

    Only where that is unset (a local test session) a temporary folder is made.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="piiloom-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored_copy(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written once to a shared folder and read back.

    For narrow results of a wide scan that are used more than once; unlike a
    cache it outlives the loss of an executor.
    """
    folder = shared_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast only after counting that it has at most ``rows`` rows.

    The count stops at ``rows + 1``.  Beyond it the join is left to shuffle,
    with adaptive execution splitting skewed keys.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df

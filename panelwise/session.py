"""Session helpers: a local session for tests and bench, and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", app: str = "panelwise") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it then gets a folder of its own. On a cluster a
    machine-local folder would lose data together with its machine, so a missing setting is an error there.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="panelwise-")
        context.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; all paths of one application share a parent, which may be deleted after it."""
    return f"{shared_dir(spark)}/panelwise-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, *cluster_by: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder once and go on from the written rows.

    The plan behind it is computed a single time, lost executors cost a re-read only, and later passes read just
    the columns they use. ``cluster_by`` brings equal keys together so that partial sums combine well; a key
    with very many rows is still split over several files.
    """
    if cluster_by:
        df = df.hint("rebalance", *[F.col(c) for c in cluster_by])
    path = new_path(df.sparkSession, "cut")
    df.write.mode("error").parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written._cut_path = path
    return written

"""Session helpers: configuration and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "gridledger", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the library is tested under.

    On a cluster the caller brings its own session; nothing here is required there
    except a UTC session time zone.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, named by the cluster in ``spark.checkpoint.dir``.

    A local session without the setting gets a fresh temporary folder; a cluster session
    without it is refused, because a machine-local folder is lost with its executor.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="gridledger-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new, not yet existing path below the shared folder."""
    token = os.urandom(6).hex()
    return f"{shared_folder(spark).rstrip('/')}/{label}-{token}"


_REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through a table written to the shared folder.

    A lost executor then costs one stage, and the next plan starts from plain files with
    known sizes instead of inherited constraints. What its shuffles wrote is removed as soon as
    the table is there, so the steps of a job do not add up on the executors' disks.
    """
    spark = df.sparkSession
    path = fresh_folder(spark, "round")
    before = spark.conf.get(_REMOVE_SHUFFLES, None)
    spark.conf.set(_REMOVE_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_REMOVE_SHUFFLES)
        else:
            spark.conf.set(_REMOVE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


FEW_TEXTS, FEW_CHARS = 50_000, 1_000_000


def texts_table(df: DataFrame, text: str) -> DataFrame:
    """A written table of facts about texts, one or a few rows for each ``text``.

    If it is small, counted and not estimated, it is marked to be sent to all tasks: the many rows that look texts up
    stay where they are and need not be dealt out by their text.
    """
    table = checkpointed(df)
    n, chars = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(text)), F.lit(0))).first()
    return F.broadcast(table) if n <= FEW_TEXTS and chars <= FEW_CHARS else table

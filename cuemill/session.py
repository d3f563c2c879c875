"""Session and table helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

MICROS_PER_SECOND = 1_000_000


def session(app: str = "cuemill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | conf
    return builder.config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One Parquet table, reduced to ``columns`` when given."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*columns) if columns else df


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names.

    Only a session on one machine (``local``) may go without: it gets a temporary folder
    of its own.  A cluster without one is refused, as a machine's own disk would not
    outlive an executor.  Files of a folder go with the context's cleaner where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set, as ``session`` does.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        named = tempfile.mkdtemp(prefix="cuemill-checkpoints-")
    context.setCheckpointDir(named)
    return named


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def ship(spark: SparkSession) -> str:
    """Send the package to every executor, for clusters it is not installed on; returns the archive's path."""
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="cuemill-package-")
    path = os.path.join(folder, "cuemill.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for here, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(here, name)
                    archive.write(full, os.path.join("cuemill", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    return path

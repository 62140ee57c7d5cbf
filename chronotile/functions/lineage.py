"""Cutting lineage between iterative or often reused steps."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the checkpoint folder of the context, else ``spark.checkpoint.dir``.

    Only a local session (tests) may do without the setting and gets a folder of its own; on a cluster a folder of one machine
    is not seen by the others, so a missing setting is an error there.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="chronotile-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, at this call, into the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)

"""Cutting the lineage of tables that iterations read again."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(table: DataFrame) -> DataFrame:
    """The table, computed once and read back from the shared folder the cluster names in spark.checkpoint.dir.

    Only a local session without one makes a folder of its own."""
    context = table.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="veridoc-"))
    return table.checkpoint()

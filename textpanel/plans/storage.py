"""Where frames that are read more than once are kept."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the folder that spark.checkpoint.dir names, which all executors share, so losing one loses nothing.

    Only where all executors are threads of this machine may the folder be unset; then a temporary one is used. On a cluster that is an
    error. Spark deletes what is no longer referred to if spark.cleaner.referenceTracking.cleanCheckpoints is on.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="textpanel-"))
    return df.checkpoint(eager=True)

"""Where intermediate tables go: the shared folder the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# Tables written by this process and not dropped yet.
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    Where none is set, a session on one machine takes a folder in its warehouse; the setting itself is
    left alone. A cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def stored(df: DataFrame, name: str, compact: bool = False) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back.

    Cuts the lineage; the files outlive any executor, until ``drop_stored``. ``compact``: a table much
    smaller than what it was made from goes into files of its own size, not into one for each task.
    """
    path = scratch_path(df.sparkSession, name)
    (df.hint("rebalance") if compact else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The table that ``make`` returns, stored; what making it has stored is emptied then."""
    before = len(_written)
    result = stored(make(), name, compact=True)
    for path in _written[before:-1]:
        _empty(spark, path)
    _written[before:-1] = []
    return result


def _empty(spark: SparkSession, path: str) -> None:
    """Free what a table takes, by writing one without rows in its place."""
    spark.range(0).coalesce(1).write.mode("overwrite").parquet(path)


def drop_stored(spark: SparkSession) -> int:
    """Empty what ``scratch_path`` and ``stored`` have made in this process; returns how many paths.

    Call it when the results that read these tables have been written.
    """
    for path in _written:
        _empty(spark, path)
    dropped = len(_written)
    _written.clear()
    return dropped

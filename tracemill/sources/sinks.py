"""Report sink: files partitioned by dataset and year, written by the executors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_report(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    dataset: str | None = None,
    order_by: Sequence[str | Column] = (),
    mode: str = "errorifexists",
    replace: bool = False,
) -> None:
    """Write ``df`` below ``path`` as parquet, orc, json, csv or text.

    ``dataset`` becomes the first partition column and ``year`` or ``slice``, if present, the second. With ``replace`` the
    datasets and years that ``df`` has rows of take the place of what is there, all other files stay untouched;
    a report without these columns is replaced as a whole. Rows are
    rebalanced by these, so a year gets as many files as its size needs and not one per task;
    ``order_by`` sorts inside each file. Text lines read ``(a,b,...)``; arrays in csv and text are
    joined by blanks.
    """
    if dataset is not None:
        df = df.withColumn("dataset", F.lit(dataset))
    slices = [name for name in ("dataset", "year", "slice") if name in df.columns]
    df = df.hint("rebalance", *slices) if slices else df.hint("rebalance")
    if order_by:
        df = df.sortWithinPartitions(*slices, *order_by)
    if fmt in ("csv", "text"):
        df = df.select(*[_flat(field) for field in df.schema.fields])
    if fmt == "text":
        cells = [
            F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns if c not in slices
        ]
        line = F.concat(F.lit("("), F.concat_ws(",", *cells), F.lit(")"))
        df = df.select(*slices, line.alias("value"))
    writer = df.write.format(fmt).mode("overwrite" if replace else mode)
    if replace and slices:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*slices).save(path)


def _flat(field: T.StructField) -> Column:
    column = F.col(field.name)
    if isinstance(field.dataType, T.ArrayType):
        column = F.array_join(column.cast("array<string>"), " ").alias(field.name)
    return column

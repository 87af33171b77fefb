"""Trace lines in three text grammars, read into one ``traces`` table.

``traces``: digest STRING, trace_id STRING, ts TIMESTAMP, year INT, region STRING, target STRING,
hops ARRAY<BIGINT>, lats ARRAY<DOUBLE>, num_hops INT, e2e DOUBLE. Rows come partitioned by digest, that of the line.

Lines that do not parse go to ``bad_lines`` (value, dataset, path, reason) instead of failing the job.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import ip_to_number, month_start, utc_year


# Why a line does not parse.
REASONS = ("date", "hops", "address", "latency", "endpoint")
FIELDS = ("ts", "region", "target", "hops", "lats", "num_hops")
# Up to the year 9999.
MAX_SECONDS = 253_402_300_799


def read_lines(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """Every line of every file below ``path``, nested folders and gzip included."""
    return spark.read.option("recursiveFileLookup", True).text(path).select(
        "value",
        F.lit(_known(dataset)).alias("dataset"),
        F.col("_metadata.file_path").alias("path"),
    )


def _filters(dataset: str) -> dict[str, Column]:
    """Why a line is dropped before it is parsed, by name. All are substring tests."""
    value = F.col("value")
    tests = {"sentinel": F.contains(value, F.lit("0.0.0.0")), "hyphen": F.contains(value, F.lit("-"))}
    incomplete = {"incomplete": ~F.contains(value, F.lit("MOS"))} if _known(dataset) == "ARK" else {}
    return {**incomplete, **tests}


def clean_lines(lines: DataFrame, dataset: str) -> DataFrame:
    """Drop incomplete ARK traces and any line with the sentinel address or a hyphen.

    All three tests are substring tests, so ``10.0.0.0`` and hyphenated tokens go too.
    """
    return lines.where(~reduce(Column.__or__, _filters(dataset).values()))


def account_lines(lines: DataFrame, dataset: str) -> tuple[DataFrame, dict[str, Observation]]:
    """``check_lines(clean_lines(...))``, and observations of what became of the lines, for ``line_counts``.

    The counts come about while the checked lines are written, in the same pass, and can be read after that.
    """
    account = {"read": Observation(), "checked": Observation()}
    dropped = F.coalesce(*[F.when(test, name) for name, test in _filters(dataset).items()])
    marked = lines.withColumn("dropped", dropped)
    counted = [F.count_if(F.col("dropped") == name).alias(name) for name in _filters(dataset)]
    kept = marked.observe(account["read"], F.count(F.lit(1)).alias("lines"), *counted).where("dropped IS NULL").drop("dropped")
    reasons = [F.count_if(F.col("reason") == name).alias(name) for name in REASONS]
    good = F.count_if(F.col("reason").isNull()).alias("traces")
    return check_lines(kept, dataset).observe(account["checked"], good, *reasons), account


def line_counts(spark: SparkSession, account: dict[str, Observation]) -> DataFrame:
    """``(step, name, n)``: all lines ``read``, those ``dropped`` by each filter, ``bad`` for each reason, and traces ``kept``.

    A line that several filters drop counts for the first one. The lines read are the sum of all others.
    """
    read, checked = dict(account["read"].get), dict(account["checked"].get)
    rows = [("read", "lines", read.pop("lines")), ("kept", "traces", checked.pop("traces"))]
    rows += [("dropped", *item) for item in read.items()] + [("bad", *item) for item in checked.items()]
    return spark.createDataFrame(rows, "step string, name string, n long")


def read_traces(
    spark: SparkSession,
    path: str,
    dataset: str,
    clean: bool = True,
    partitions: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(traces, bad_lines)`` of a dataset directory.

    A gzip file is one task. When there are fewer files than cores, pass ``partitions``: the parsed
    traces are then spread over that many. Labelling traces needs no further shuffle either way.
    """
    lines = read_lines(spark, path, dataset)
    traces, bad = parse_lines(clean_lines(lines, dataset) if clean else lines, dataset)
    if partitions is not None:
        traces = traces.repartition(partitions, "digest")
    return traces, bad


def parse_lines(lines: DataFrame, dataset: str) -> tuple[DataFrame, DataFrame]:
    """``(traces, bad_lines)`` of lines with a ``value`` column (and optionally ``path``)."""
    return split_checked(check_lines(lines, dataset))


def check_lines(lines: DataFrame, dataset: str) -> DataFrame:
    """Every line with its digest, its fields and the ``reason`` it is rejected for, NULL for good ones.

    Store this to read and parse the text once; good lines keep their fields only, bad ones their text.
    """
    grammar = DATASETS[_known(dataset)]
    path = F.col("path") if "path" in lines.columns else F.lit(None).cast("string")
    fields = grammar(
        lines.select(
            "value",
            path.alias("path"),
            F.lit(dataset).alias("dataset"),
        )
    )
    typed = fields.withColumns(
        {
            "hops": F.transform("hop_texts", ip_to_number),
            "num_hops": F.size("hop_texts"),
        }
    )
    bad_latency = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    checked = typed.withColumn(
        "reason",
        F.when(F.col("ts").isNull(), "date")
        .when((F.col("num_hops") < 1) | (F.col("num_hops") != F.size("lats")), "hops")
        .when(F.exists("hops", lambda x: x.isNull()), "address")
        .when(F.exists("lats", bad_latency), "latency")
        .when(F.col("region").isNull() | F.col("target").isNull(), "endpoint"),
    )
    good = F.col("reason").isNull()
    return checked.select(
        *[F.when(~good, F.col(name)).alias(name) for name in ("value", "path")],
        "dataset",
        "reason",
        F.md5("value").alias("digest"),
        *[F.when(good, F.col(name)).alias(name) for name in FIELDS],
    )


def split_checked(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(traces, bad_lines)`` of checked lines."""
    # Ids depend on the text alone, so they are the same however the files are split. Identical lines are
    # counted, with partial sums, and told apart by a running number; in two steps, which keeps the arrays short.
    # The digest alone is the key, so rows stay partitioned by it for all that follows, and fields nobody asks for go.
    distinct = (
        checked.where(F.col("reason").isNull())
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("copies"), *[F.first(name).alias(name) for name in FIELDS])
    )
    last = F.col("copies") - 1
    thousands = F.sequence(F.lit(0).cast("bigint"), F.floor(last / 1000))
    ones = F.sequence(F.lit(0).cast("bigint"), F.least(F.lit(999).cast("bigint"), last - 1000 * F.col("thousand")))
    copies = distinct.withColumn("thousand", F.explode(thousands)).withColumn("one", F.explode(ones))
    number = (1000 * F.col("thousand") + F.col("one")).cast("string")
    traces = copies.select(
        "digest",
        F.concat_ws("-", "digest", number).alias("trace_id"),
        "ts",
        utc_year(F.col("ts")).alias("year"),
        *FIELDS[1:],
        F.element_at("lats", -1).alias("e2e"),
    )
    bad = checked.where(F.col("reason").isNotNull()).select("value", "dataset", "path", "reason")
    return traces, bad


def trace_headers(traces: DataFrame) -> DataFrame:
    """Traces without their hops."""
    return traces.drop("hops", "lats")


def _known(dataset: str) -> str:
    if dataset not in DATASETS:
        raise ValueError(f"unknown dataset {dataset!r}, expected one of {sorted(DATASETS)}")
    return dataset


def _words(value: Column) -> Column:
    """Whitespace-separated tokens; trailing blanks make no token, a leading blank does."""
    return F.split(F.regexp_replace(value, r"\s+$", ""), r"\s+")


def _alternating(pairs: Column, first: int) -> Column:
    return F.filter(pairs, lambda _, i: i % 2 == first)


def _pairs_from(lines: DataFrame, skip: int, pairs: Column, region: int, target: Column) -> DataFrame:
    """Grammars of the form: head tokens, then address and latency in turn."""
    split = lines.withColumn("words", _words(F.col("value")))
    words = split.withColumn(
        "pairs", F.slice("words", F.lit(skip + 1), F.greatest(F.lit(0), 2 * pairs.cast("int")))
    )
    return words.withColumns(
        {
            "ts": month_start(F.get("words", F.lit(0))),
            "region": F.get("words", F.lit(region)),
            "target": target,
            "hop_texts": _alternating(F.col("pairs"), 0),
            "lats": F.transform(
                _alternating(F.col("pairs"), 1), lambda x: x.try_cast("double")
            ),
        }
    )


def _ark(lines: DataFrame) -> DataFrame:
    pairs = F.floor((F.size("words") - 4) / 2)
    return _pairs_from(lines, 4, pairs, 1, F.get("words", F.lit(2)))


def _iplane(lines: DataFrame) -> DataFrame:
    pairs = F.floor(F.size("words") / 2)
    return _pairs_from(lines, 1, pairs, 1, F.get("words", F.size("words") - 2))


def _cdn(lines: DataFrame) -> DataFrame:
    """Comma fields; hops separated by a pipe; each hop split at colon or underscore."""
    split = lines.withColumn("fields", F.split("value", ",")).withColumn(
        "cells",
        F.transform(
            F.split(F.regexp_replace(F.get("fields", F.lit(5)), "[|]+$", ""), "[|]"),
            lambda hop: F.split(F.regexp_replace(hop, "[:_]+$", ""), "[:_]"),
        ),
    )
    seconds = F.get("fields", F.lit(2)).try_cast("bigint")
    return split.withColumns(
        {
            # outside of this a timestamp does not exist
            "ts": F.timestamp_seconds(F.when(F.abs(seconds) <= MAX_SECONDS, seconds)),
            "region": F.get("fields", F.lit(3)),
            "target": F.get("fields", F.lit(4)),
            "hop_texts": F.coalesce(
                F.transform("cells", lambda cell: F.get(cell, F.lit(1))), F.array().cast("array<string>")
            ),
            "lats": F.transform(
                "cells",
                # rounded half up, so -0.5 becomes 0
                lambda cell: F.floor(F.element_at(cell, -1).try_cast("double") + 0.5).cast("double"),
            ),
        }
    )


DATASETS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "ARK": _ark,
    "IPLANE": _iplane,
    "LARGECDN": _cdn,
}

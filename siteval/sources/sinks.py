"""Sinks; none of them overwrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteval.operators.joins import join_null_safe

CHUNK_ROWS = 100_000  # of a site's rows in one file


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    writer = df.write.mode("errorifexists")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def write_chunks(df: DataFrame, path: str, by: str = "site_frame_id") -> None:
    """JSON lines in one folder per site.

    An ordinary site is one file.  The rows of a site with more than
    ``CHUNK_ROWS`` are dealt by a hash over as many tasks as its size asks
    for; such sites are fewer than the rows divided by ``CHUNK_ROWS``.
    """
    large = df.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > CHUNK_ROWS)
    parts = F.coalesce(F.ceil(F.col("_n") / CHUNK_ROWS), F.lit(1))
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), parts)
    sized = join_null_safe(df, large, by, "left", broadcast=True).withColumn("_part", spread)
    placed = sized.repartition(F.col(by), F.col("_part")).select(*df.columns)
    placed.write.mode("errorifexists").partitionBy(by).json(path)


def sorted_json(entries: Column) -> Column:
    """Array of (key, value) structs as a JSON object with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(entries)))


def write_summary(df: DataFrame, path: str) -> None:
    """One JSON document per row, keys in order."""
    row = F.to_json(F.struct(*sorted(df.columns)))
    df.select(row.alias("value")).coalesce(1).write.mode("errorifexists").text(path)


def write_replicates(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").partitionBy("experiment_id").parquet(path)

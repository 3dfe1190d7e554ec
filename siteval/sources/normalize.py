"""Source tables to the canonical record columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteval.functions.hashing import digest
from siteval.operators.ranking import ordinal
from siteval.sources.readers import RAW_SCHEMA


def normalize_source(df: DataFrame, mapping: dict[str, str], constants: dict[str, object]) -> DataFrame:
    """Rename, add constants and typed NULLs, in canonical order."""
    cols = []
    for field in RAW_SCHEMA:
        if field.name in mapping:
            value = F.col(mapping[field.name])
        else:
            value = F.lit(constants.get(field.name))
        cols.append(value.cast(field.dataType).alias(field.name))
    return df.select(*cols)


def with_record_id(df: DataFrame, prefix: str, width: int, order_by: list[str], out: str = "record_id") -> DataFrame:
    """``prefix`` + zero-padded position in an explicit order."""
    numbered = ordinal(df, [F.col(c) for c in order_by], "_i")
    return numbered.withColumn(out, F.concat(F.lit(prefix), F.lpad(F.col("_i").cast("string"), width, "0"))).drop("_i")


def format_frame(df: DataFrame, rank: str, domain: str, bands: list[tuple[int, int]], seed: int) -> DataFrame:
    """Ranked rows as a frame: ``tfv1:NNNNNN`` by rank, seed and band text."""
    from siteval.operators.splits import band_of
    numbered = ordinal(df, [F.col(rank)], "_i")
    return numbered.select(
        F.format_string("tfv1:%06d", F.col("_i") + 1).alias("selection_row_id"),
        F.col(rank).alias("tranco_rank"), F.col(domain).alias("tranco_domain"),
        F.lit(seed).alias("selection_seed"), band_of(F.col(rank), bands).alias("rank_band"))


def labelled(df: DataFrame, key: str, label: str) -> DataFrame:
    return df.where(F.col(label).isin(0, 1) & (F.coalesce(F.col(key), F.lit("")) != ""))


def start_at(df: DataFrame, col: str, first: str, pattern: str = r"^tfv1:(\d{6})$") -> DataFrame:
    """Rows at or behind a padded id; a malformed id is an error."""
    number = lambda c: F.regexp_extract(c, pattern, 1).try_cast("int")
    here = F.coalesce(number(F.col(col)), F.raise_error(F.lit("malformed id")).cast("int"))
    return df.where(here >= number(F.lit(first)))


def redact(df: DataFrame, cols: list[str], how: str = "hash") -> DataFrame:
    """Hash key columns, or drop them, before publishing."""
    if how == "drop":
        return df.drop(*cols)
    return df.withColumns({c: digest(F.col(c)) for c in cols})

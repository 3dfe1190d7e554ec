"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siteval.operators.ranking import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """The given columns beside the whole row as ``_row``, whatever names it has."""
    return docs.select(*[c.alias(n) for n, c in columns.items()], F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table once to the shared folder and go on from the files."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a ``written`` table that nothing reads any more, and
    let the driver release the shuffles that led to it."""
    spark, files = df.sparkSession, df.inputFiles()
    if files:
        path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    spark._jvm.java.lang.System.gc()


ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(),
         "binary": pa.binary(), "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32())}


SLICE_BYTES = 2_000_000


def slices(batch: pa.RecordBatch, text_col: str):
    """Parts of a batch with a bounded amount of text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
        yield batch.slice(at, upto - at)
        at = upto


def map_texts(df: DataFrame, keep: list[str], fields: str, start: Callable[[], Callable[[list], list[list]]],
              text_col: str = "_text") -> DataFrame:
    """The columns ``keep`` as they are, and new ones made of each batch's texts.

    ``start`` runs once per task and returns the function from texts to one
    list per new field.  It gets ``SLICE_BYTES`` of text at a time, or one
    longer text, whatever the size of Spark's batches.
    """
    new = StructType.fromDDL(fields)
    kinds = [ARROW[f.dataType.simpleString()] for f in new.fields]
    names = [*keep, *new.names]

    def run(batches):
        make = start()
        for batch in batches:
            for b in slices(batch, text_col):
                made = make(b.column(text_col).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [b.column(k) for k in keep] + [pa.array(v, type=t) for v, t in zip(made, kinds)], names=names)

    return df.mapInArrow(run, StructType([*df.select(*keep).schema.fields, *new.fields]))

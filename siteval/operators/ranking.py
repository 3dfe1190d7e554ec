"""Ranks, cuts and running totals over whole tables without one-task sorts.

Two building blocks carry most of the library:

* ``cut_by_hash`` finds, per stratum, the exact hash values at which a table
  ordered by hash reaches given (weighted) positions.  Rows are then placed by
  comparing their own hash with those values: no row is ranked or shuffled.
* ``global_prefix`` gives running totals over a total order by working inside
  value ranges and adding the totals of the ranges before.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteval.functions.hashing import HASH_BITS, as_column
from siteval.operators.joins import hot_key_join, join_null_safe

CUT_BITS = 12  # of the hash, for each of two rounds of narrowing
ORDINAL_BITS = 16


# ---------------------------------------------------------------- shared plumbing

def ensure_checkpoint_dir(spark) -> None:
    """Use the cluster's shared checkpoint folder; make one only for local runs."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(shared)


def checkpointed(df: DataFrame) -> DataFrame:
    """Write the table once to reliable storage and continue from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The same as compressed column files: for wide or long tables, whose plain rows would fill the disk."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


# ---------------------------------------------------------------- cuts by hash

def cut_by_hash(df: DataFrame, by: list[str], order: Column, tie: Column, cuts: list[Column],
                weight: Column | None = None, bits: int = CUT_BITS) -> DataFrame:
    """Per stratum, struct columns ``cut0..``: the last (hash, tie) whose
    preceding weight is below the cut; NULL when a cut is 0 or less.

    ``cuts`` are expressions over ``n``, the stratum's total weight.  Two rounds
    narrow a cut: sums per hash range find the range that holds it, sums over
    further bits its part; only that part, 2 ** -(2 * bits) of a stratum, is
    ever ordered, so a stratum may hold all rows of the table.
    """
    keyed = df.select(*by, order.alias("_h"), tie.alias("_t"),
                      (weight if weight is not None else F.lit(1)).alias("_w"))
    keyed = keyed.withColumn("_b", F.shiftright("_h", HASH_BITS - bits).cast("int"))
    ranges = keyed.groupBy(*by, "_b").agg(F.sum("_w").alias("_sum"))
    strata = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    upto = strata.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = (ranges.withColumn("n", F.sum("_sum").over(strata))
              .withColumn("_before", F.sum("_sum").over(upto) - F.col("_sum")))
    size = F.col("n").cast("double")
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.least(c.cast("double"), size).alias("at"))
                       for i, c in enumerate(cuts)])
    edge = (ranges.withColumn("_cut", F.explode(wanted))
            .where((F.col("_before") < F.col("_cut.at"))
                   & (F.col("_before") + F.col("_sum") >= F.col("_cut.at")))
            .select(*by, "_b", "_before", F.col("_cut.i").alias("_i"), F.col("_cut.at").alias("_at")))
    # one edge row per stratum and cut: both numbers are fixed by the caller
    near = join_null_safe(keyed, edge, [*by, "_b"], broadcast=True)
    near = near.withColumn("_p", F.shiftright("_h", HASH_BITS - 2 * bits))
    inner = near.groupBy(*by, "_i", "_p").agg(F.sum("_w").alias("_sum"), F.first("_before").alias("_base"), F.first("_at").alias("_at"))
    so_far = Window.partitionBy(*by, "_i").orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = inner.withColumn("_ahead", F.col("_base") + F.sum("_sum").over(so_far) - F.col("_sum"))
    inner = inner.where((F.col("_ahead") < F.col("_at")) & (F.col("_ahead") + F.col("_sum") >= F.col("_at")))
    near = join_null_safe(near.drop("_before"), inner.select(*by, "_i", "_p", F.col("_ahead").alias("_before")), [*by, "_i", "_p"], broadcast=True)
    running = (Window.partitionBy(*by, "_i").orderBy("_h", "_t")
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    near = near.withColumn("_pre", F.col("_before") + F.sum("_w").over(running) - F.col("_w"))
    point = F.struct(F.col("_h").alias("h"), F.col("_t").alias("t"))
    picks = [F.max(F.when((F.col("_i") == i) & (F.col("_pre") < F.col("_at")), point)).alias(f"cut{i}")
             for i in range(len(cuts))]
    return near.groupBy(*by).agg(*picks)


def place_by_cuts(df: DataFrame, cuts: DataFrame, by: list[str], order: Column, tie: Column,
                  names: list[str], out: str, rest: str | None) -> DataFrame:
    """Name each row by the first cut at or behind its (hash, tie)."""
    if by:
        df = join_null_safe(df, cuts, by, "left", broadcast=True)
        bound = [F.col(f"cut{i}") for i in range(len(names))]
    else:
        bound = [cuts.select(f"cut{i}").scalar() for i in range(len(names))]
    here = F.struct(order.alias("h"), tie.alias("t"))
    placed = F.lit(None).cast("string")
    for name, edge in reversed(list(zip(names, bound))):
        fallback = F.lit(rest) if name == names[-1] else placed
        placed = F.when(here <= edge, name).otherwise(fallback)
    return df.withColumn(out, placed).drop(*[f"cut{i}" for i in range(len(names))])


def first_by_hash(df: DataFrame, order: Column, tie: str, n, by: list[str] | None = None,
                  bits: int = CUT_BITS) -> DataFrame:
    """The ``n`` rows with the smallest hash (per stratum), for any ``n``."""
    by = by or []
    cuts = cut_by_hash(df, by, order, F.col(tie), [as_column(n)], bits=bits)
    placed = place_by_cuts(df, cuts, by, order, F.col(tie), ["in"], "_place", None)
    return placed.where(F.col("_place") == "in").drop("_place")


# ---------------------------------------------------------------- running totals

def value_ranges(df: DataFrame, col: str, out: str = "_range") -> DataFrame:
    """Split a numeric column into ranges of similar row counts.

    The split points (one per shuffle partition) are the only thing that
    reaches the driver.  They become constants, so every use of the result
    sees the same ranges even when tasks are re-run.  NaN has no rank and is an
    error; NULL comes last in the last range.
    """
    value = F.col(col)
    df = df.withColumn(col, F.when(F.isnan(value.cast("double")), F.raise_error(F.lit(f"NaN in {col}")).cast(
        df.schema[col].dataType)).otherwise(value))
    n = shuffle_width(df.sparkSession)
    points = df.stat.approxQuantile(col, [i / n for i in range(1, n)], 1 / (4 * n))
    splits = [-float("inf"), *sorted(set(points)), float("inf")]
    if len(splits) < 3:
        return df.withColumn(out, F.lit(0))
    numbered = Bucketizer(splits=splits, inputCol=col, outputCol=out, handleInvalid="keep").transform(df)
    return numbered.withColumn(out, F.col(out).cast("int"))


def prefix_within(df: DataFrame, by: list[str], order: list[Column], range_col: str,
                  sums: dict[str, str], descending: bool = False) -> DataFrame:
    """Inclusive running totals ``out -> source`` over rows already split into
    ordered ranges; the rows of one range are the largest unit of work."""
    totals = df.groupBy(*by, range_col).agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    rank = F.col(range_col).desc() if descending else F.col(range_col).asc()
    strata = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = strata.orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, range_col, *[
        F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_o_{o}") for o in sums])
    inside = (Window.partitionBy(*by, range_col).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    df = df.withColumns({f"_i_{o}": F.sum(c).over(inside) for o, c in sums.items()})
    df = join_null_safe(df, offsets, [*by, range_col])
    df = df.withColumns({o: F.col(f"_i_{o}") + F.col(f"_o_{o}") for o in sums})
    return df.drop(*[f"{p}{o}" for o in sums for p in ("_i_", "_o_")])


def numeric_prefix(df: DataFrame, by: list[str], col: str, sums: dict[str, str],
                   descending: bool = False) -> DataFrame:
    """Running totals over unique values of one numeric column per stratum."""
    ranged = value_ranges(df, col)
    order = F.col(col).desc() if descending else F.col(col).asc()
    return prefix_within(ranged, by, [order], "_range", sums, descending).drop("_range")


def global_prefix(df: DataFrame, order: list[Column], sums: dict[str, str],
                  by: list[str] | None = None) -> DataFrame:
    """Running totals over any total order, by range partitioning.

    The range number is written out with the rows (checkpoint), because range
    bounds are sampled and must not be drawn twice.
    """
    by = by or []
    width = shuffle_width(df.sparkSession)
    ranged = df.repartitionByRange(width, *[F.col(c) for c in by], *order)
    ranged = checkpointed(ranged.withColumn("_range", F.spark_partition_id()))
    return prefix_within(ranged, by, order, "_range", sums).drop("_range")


def running_total(df: DataFrame, order: list[Column], value: str, out: str = "running") -> DataFrame:
    return global_prefix(df, order, {out: value})


def ordinal(df: DataFrame, order: list[Column], out: str = "ordinal") -> DataFrame:
    """Dense 0-based position in a total order."""
    numbered = global_prefix(df.withColumn("_one", F.lit(1).cast("bigint")), order, {out: "_one"})
    return numbered.withColumn(out, F.col(out) - 1).drop("_one")


def hash_ordinal(df: DataFrame, by: list[str], order: Column, tie: str, out: str = "ordinal",
                 total: str | None = "n", bits: int = ORDINAL_BITS) -> DataFrame:
    """Dense 0-based position by hash within a stratum, plus the stratum size."""
    df = df.withColumn("_h", order).withColumn("_b", F.shiftright("_h", HASH_BITS - bits).cast("int"))
    counts = df.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_c"))
    strata = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    upto = strata.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.select(*by, "_b", (F.sum("_c").over(upto) - F.col("_c")).alias("_before"),
                           F.sum("_c").over(strata).alias(total or "_n"))
    inside = Window.partitionBy(*by, "_b").orderBy("_h", tie)
    df = df.withColumn("_r", F.row_number().over(inside))
    df = join_null_safe(df, counts, [*by, "_b"])
    df = df.withColumn(out, F.col("_before") + F.col("_r") - 1)
    return df.drop("_h", "_b", "_r", "_before", "_n")


# ---------------------------------------------------------------- window operators

def rank_within(df: DataFrame, keys: list[str], order: list[Column], out: str) -> DataFrame:
    """1-based position in a total order per group, for groups of any size: a
    hot group is cut into ranges like any other part of the order."""
    return global_prefix(df.withColumn("_one", F.lit(1).cast("bigint")), order, {out: "_one"}, keys).drop("_one")


def cap_rank(df: DataFrame, keys: list[str], order: list[str], out: str = "cap_rank") -> DataFrame:
    return rank_within(df, keys, [F.col(c) for c in order], out)


def first_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int,
                    rank: str | None = None) -> DataFrame:
    """First ``n`` rows per group.  The rank filter is pushed below the shuffle
    (group limit), so a hot group sends at most ``n`` rows per map task."""
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    ranked = ranked.where(F.col(name) <= n)
    return ranked if rank else ranked.drop(name)


def with_group_total(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Group total on every row of a (pre-aggregated) table."""
    return df.withColumn(out, F.sum(value).over(Window.partitionBy(*by)))


def average_rank(df: DataFrame, value: Column, out: str = "avg_rank", by: list[str] | None = None) -> DataFrame:
    """1-based ascending rank of a numeric value, ties share their mean rank."""
    by = by or []
    df = df.withColumn("_v", value.cast("double"))
    sizes = df.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_m"))
    ranked = numeric_prefix(sizes, by, "_v", {"_upto": "_m"})
    ranks = ranked.select(*by, "_v", "_m", (F.col("_upto") - (F.col("_m") - 1) / 2).alias(out))
    spread = [c for c in df.columns if c != "_v"] or ["_v"]
    return hot_key_join(df, ranks, [*by, "_v"], "_m", spread).drop("_v")


def budget_cut(ledger: DataFrame, ordinal_col: str, records: str, limit: int, n: int) -> DataFrame:
    """Rows in order while earlier rows hold fewer than ``limit`` records, at most ``n``."""
    run = global_prefix(ledger.withColumn("_one", F.lit(1)), [F.col(ordinal_col)],
                        {"_sum": records, "_pos": "_one"})
    taken = run.where((F.col("_sum") - F.col(records) < limit) & (F.col("_pos") <= n))
    return taken.drop("_sum", "_pos", "_one")


def best_rows(df: DataFrame, by: list[str], metric: str) -> DataFrame:
    """Rows sharing the best value per group, with how many share it."""
    top = df.withColumn("_r", F.rank().over(Window.partitionBy(*by).orderBy(F.col(metric).desc())))
    top = top.where("_r = 1").drop("_r")
    return top.withColumn("ties", F.count(F.lit(1)).over(Window.partitionBy(*by)))

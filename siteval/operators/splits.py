"""Sampling, capping, splitting and deduplication by hash."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteval.functions.hashing import digest, h60
from siteval.operators.joins import assign, remove_keys
from siteval.operators.ranking import checkpointed, cut_by_hash, first_by_hash, first_per_group, hash_ordinal, place_by_cuts, shuffle_width

PARTITIONS = ("train", "validation", "test")


def _n() -> Column:
    return F.col("n")


# ---------------------------------------------------------------- samples

def band_of(rank: Column, bands: list[tuple[int, int]]) -> Column:
    """Text ``lo-hi`` of the band holding a rank, NULL outside all bands."""
    text = F.lit(None).cast("string")
    for lo, hi in bands:
        text = F.when(rank.between(lo, hi), f"{lo}-{hi}").otherwise(text)
    return text


def sample_bands(df: DataFrame, rank: str, key: str, bands: list[tuple[int, int]], n: int, seed: int) -> DataFrame:
    """``n`` rows per rank band by hash."""
    banded = df.withColumn("rank_band", band_of(F.col(rank), bands)).where(F.col("rank_band").isNotNull())
    return first_by_hash(banded, h60(seed, "band", F.col(key)), key, n, ["rank_band"])


def sample_n(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    return first_by_hash(df, h60(seed, "sample", F.col(key)), key, n)


def hash_subset(df: DataFrame, key: str, salt: str, n: int) -> DataFrame:
    """First ``n`` rows by salted hash."""
    return first_by_hash(df, h60(salt, F.col(key)), key, n)


def examples_per_stratum(df: DataFrame, key: str, correct_a: str, correct_b: str, salt: str, n: int) -> DataFrame:
    """``n`` rows for each of the four combinations of being right under two models."""
    def word(c):
        return F.when(F.col(c), "right").otherwise("wrong")

    rows = df.withColumn("stratum", F.concat_ws("/", word(correct_a), word(correct_b)))
    return first_by_hash(rows, h60(salt, F.col(key)), key, n, ["stratum"])


# ---------------------------------------------------------------- row splits

def split_stratified(df: DataFrame, key: str, label: str | None, seed: int | Column,
                     fracs: tuple[float, float] = (.70, .15), by: list[str] | None = None,
                     out: str = "partition", stream: str = "rows") -> DataFrame:
    """Row split with rounded counts per class (halves round to even)."""
    strata = [*(by or []), *([label] if label else [])]
    order = h60(seed, stream, F.col(key))
    first = F.bround(_n() * fracs[0])
    cuts = [first, first + F.bround(_n() * fracs[1])]
    edges = cut_by_hash(df, strata, order, F.col(key), cuts)
    return place_by_cuts(df, edges, strata, order, F.col(key), list(PARTITIONS[:2]), out, PARTITIONS[2])


def split_random(df: DataFrame, key: str, seed: int, fracs: tuple[float, float] = (.70, .15)) -> DataFrame:
    return split_stratified(df, key, None, seed, fracs)


def split_two_step(df: DataFrame, key: str, label: str, seed: int, rest: float = .30) -> DataFrame:
    """Hold out ``rest`` of each class, then halve it into validation and test."""
    outer = h60(seed, "holdout", F.col(key))
    held = place_by_cuts(df, cut_by_hash(df, [label], outer, F.col(key), [F.bround(_n() * rest)]),
                         [label], outer, F.col(key), ["rest"], "_side", "train")
    inner = h60(seed, "halves", F.col(key))
    rest_rows = held.where(F.col("_side") == "rest")
    edges = cut_by_hash(rest_rows, [label], inner, F.col(key), [F.bround(_n() * .5)])
    placed = place_by_cuts(held, edges, [label], inner, F.col(key), ["validation"], "_half", "test")
    return placed.withColumn("partition", F.when(F.col("_side") == "train", "train").otherwise(F.col("_half"))) \
        .drop("_side", "_half")


# ---------------------------------------------------------------- group splits

def group_sizes(df: DataFrame, group: str, label: str | None = None) -> DataFrame:
    """Rows per group and class counts: the only shuffle of a group split."""
    extra = []
    if label:
        extra = [F.sum(F.when(F.col(label) == y, 1).otherwise(0)).alias(f"n{y}") for y in (0, 1)]
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("rows"), *extra)


def split_group_prefix(df: DataFrame, group: str, seed: int | Column, by: list[str] | None = None,
                       fracs: tuple[float, float] = (.70, .15), out: str = "partition") -> DataFrame:
    """Whole groups in hash order; a group goes where the rows before it end.

    Groups are cut by cumulative rows, and rows are then placed from the hash
    of their own group key, so no group is ever gathered.
    """
    by = by or []
    order = h60(seed, "group", F.col(group))
    groups = df.groupBy(*by, group).agg(F.count(F.lit(1)).alias("rows"))
    cuts = [_n() * fracs[0], _n() * (fracs[0] + fracs[1])]
    edges = cut_by_hash(groups, by, order, F.col(group), cuts, weight=F.col("rows"))
    return place_by_cuts(df, edges, by, order, F.col(group), list(PARTITIONS[:2]), out, PARTITIONS[2])


GREEDY_WEIGHTS = (14, 3, 3)  # 70 / 15 / 15


def greedy_shares(filled: np.ndarray, size: np.ndarray, taken: np.ndarray, weights: tuple[int, ...]) -> np.ndarray:
    """How many of ``taken`` equal groups each partition has got (partitions x cases).

    A group goes to the partition with the least filled / weight, the first of
    equals.  The j-th group of partition k is so taken at level
    (filled_k + j * size) / weight_k; how many groups of the others are taken
    before it is a division, so j is found by bisection.  All in whole numbers.
    """
    filled, size, taken = (np.asarray(x, np.int64) for x in (filled, size, taken))
    out = []
    for k, w in enumerate(weights):
        low, high = np.zeros_like(taken), taken.copy()  # groups that k has surely got, and at most
        while (low < high).any():
            mid = (low + high) // 2  # is the group number mid of k among those taken?
            rank = mid.copy()
            for o, v in enumerate(weights):
                if o != k:
                    ahead = (filled[k] + mid * size) * v - filled[o] * w  # other groups j with j * size * w before this
                    step = size * w
                    rank += np.maximum(0, (ahead // step + 1) if o < k else -(-ahead // step))
            inside = rank < taken
            low, high = np.where(inside & (low < high), mid + 1, low), np.where(inside, high, np.minimum(high, mid))
        out.append(low)
    return np.stack(out)


def split_group_greedy(df: DataFrame, group: str, seed: int, weights: tuple[int, ...] = GREEDY_WEIGHTS,
                       out: str = "partition") -> DataFrame:
    """Whole groups, largest first (ties by hash), each to the partition that is
    furthest below its share: the result of the sequential loop, without it.

    Groups of one size form a run.  Only sizes and their counts, at most about
    sqrt(2 * rows) runs, reach the driver, which walks the runs; a group then
    finds its partition from its run's start and its number within the run.
    Rows without a group get no partition.
    """
    groups = df.groupBy(group).agg(F.count(F.lit(1)).alias("rows"))
    numbered = checkpointed(hash_ordinal(groups, ["rows"], h60(seed, "greedy", F.col(group)), group, "_i", "_c"))
    runs = sorted(((r["rows"], r["c"]) for r in numbered.groupBy("rows").agg(F.count(F.lit(1)).alias("c")).collect()), reverse=True)
    filled, starts = np.zeros(len(weights), np.int64), {}
    for size, count in runs:
        starts[size] = filled.copy()
        filled = filled + greedy_shares(filled[:, None], np.array([size]), np.array([count]), weights)[:, 0] * size
    table = df.sparkSession.sparkContext.broadcast(starts)
    schema = groups.select(group).schema.add(out, "string")

    def place(batches):
        for b in batches:
            size, i = b.column("rows").to_numpy(), b.column("_i").to_numpy()
            sizes, at = np.unique(size, return_inverse=True)
            before = np.stack([table.value[x] for x in sizes.tolist()])[at].T if len(at) else np.zeros((len(weights), 0), np.int64)
            got = greedy_shares(before, size, i + 1, weights) - greedy_shares(before, size, i, weights)
            names = pa.array(PARTITIONS).take(pa.array(got.argmax(axis=0)))
            yield pa.RecordBatch.from_arrays([b.column(group), names], names=[group, out])

    return assign(df, numbered.select(group, "rows", "_i").mapInArrow(place, schema), group)


def _best_holdout(groups: DataFrame, group: str, fraction: float, seed: int, candidates: int) -> Column:
    """Condition on ``group``: held by the candidate whose held groups come
    closest to the class targets.

    The winner is one row (candidate, last held hash and group); it becomes a
    constant, so placing rows needs no join.
    """
    # the group table grows by the number of candidates here: use every core for it
    tries = groups.repartition(shuffle_width(groups.sparkSession))
    tries = tries.withColumn("candidate", F.explode(F.sequence(F.lit(0), F.lit(candidates - 1))))
    order = h60(seed, "holdout", F.col("candidate"), F.col(group))
    edges = cut_by_hash(tries, ["candidate"], order, F.col(group), [F.ceil(_n() * fraction)], bits=8)
    here = F.struct(order.alias("h"), F.col(group).alias("t"))
    held = here <= F.col("cut0")
    # one row per candidate: the caller fixed their number
    sums = (tries.join(F.broadcast(edges), "candidate")
            .groupBy("candidate").agg(
                *[F.sum(F.when(held, F.col(f"n{y}")).otherwise(0)).alias(f"held{y}") for y in (0, 1)],
                *[F.sum(f"n{y}").alias(f"all{y}") for y in (0, 1)],
                F.first("cut0").alias("cut0")))

    def miss(y: int) -> Column:
        target = F.col(f"all{y}") * fraction
        return F.pow((F.col(f"held{y}") - target) / F.greatest(target, F.lit(1.0)), F.lit(2.0))

    best = F.min_by(F.struct("candidate", "cut0"), F.struct(miss(0) + miss(1), F.col("candidate")))
    winner = sums.agg(best.alias("best")).first()["best"]
    if winner is None or winner["cut0"] is None:
        return F.lit(False)
    order = h60(seed, "holdout", winner["candidate"], F.col(group))
    edge = winner["cut0"]
    return F.struct(order.alias("h"), F.col(group).alias("t")) <= F.struct(F.lit(edge["h"]).alias("h"), F.lit(edge["t"]).alias("t"))


def split_group_best(df: DataFrame, group: str, label: str, seed: int, candidates: int = 40,
                     holdout: float = .15) -> DataFrame:
    """Group-disjoint split: the best of ``candidates`` hold-outs for test,
    then the same on the remaining groups for validation."""
    # rows are reduced to groups once; both searches read the written group table
    groups = checkpointed(group_sizes(df, group, label))
    test = _best_holdout(groups, group, holdout, seed, candidates)
    val = _best_holdout(groups.where(~test), group, holdout / (1 - holdout), seed + 10000, candidates)
    return df.withColumn("partition", F.when(test, "test").when(val, "validation").otherwise("train"))


def split_grid(df: DataFrame, keys: dict[str, str], seeds: list[int], keep: list[str]) -> DataFrame:
    """Every group key × seed over the rows that have the key, one placement pass per key."""
    parts = []
    for protocol, key in keys.items():
        known = F.coalesce(F.col(key).cast("string"), F.lit("")) != ""
        spread = df.where(known).select(*keep).withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
        spread = spread.withColumn("protocol", F.lit(protocol))
        parts.append(split_group_prefix(spread, key, F.col("seed"), by=["seed"]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------- caps, dedup, quarantine

def cap_per_group(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    return first_per_group(df, keys, [F.col(c) for c in order], k)


def apply_cap(split: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """Cap variant of a frozen split: filter only, nothing is split again."""
    return split.join(kept.select(key), key, "left_semi")


def mixed_keys(df: DataFrame, key: str, label: str) -> DataFrame:
    """Keys seen with both labels."""
    return (df.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key)
            .agg(F.min(label).alias("_lo"), F.max(label).alias("_hi"))
            .where("_lo < _hi").select(key))


def quarantine(df: DataFrame, url_hash: str, site: str, label: str) -> DataFrame:
    """Drop rows whose URL or whose site carries both labels."""
    df_urls = remove_keys(df, mixed_keys(df, url_hash, label), url_hash)
    return remove_keys(df_urls, mixed_keys(df, site, label), site)


def dedup(df: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """One row per (composite) key, the first in the given order."""
    return first_per_group(df, [key] if isinstance(key, str) else key, [F.col(c) for c in order], 1)


def common_cohort(a: DataFrame, c: DataFrame, key: str, partition: str = "partition") -> DataFrame:
    """Rows that are test rows under both splits."""
    pick = lambda d, n: d.where(F.col(partition) == "test").select(key, F.lit("test").alias(n))
    return pick(a, "partition_a").join(pick(c, "partition_c"), key, "inner")


def exclude(df: DataFrame, flag: str) -> DataFrame:
    return df.where(~F.coalesce(F.col(flag), F.lit(False)))


# ---------------------------------------------------------------- split profiles

def split_summary(df: DataFrame, by: list[str], partition: str, label: str, host: str, site: str) -> DataFrame:
    return df.groupBy(*by, partition).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(label) == 1).alias("positive_rows"),
        F.count_if(F.col(label) == 0).alias("negative_rows"),
        F.countDistinct(host).alias("hosts"), F.countDistinct(site).alias("sites"))


def key_overlap(df: DataFrame, key: str, partition: str = "partition", by: list[str] | None = None) -> DataFrame:
    """Keys shared by each pair of partitions, from per-key presence flags."""
    by = by or []
    flags = df.groupBy(*by, key).agg(
        *[F.max(F.when(F.col(partition) == p, 1).otherwise(0)).alias(p) for p in PARTITIONS])
    pairs = [("train", "validation"), ("train", "test"), ("validation", "test")]
    return flags.groupBy(*by).agg(*[
        F.count_if((F.col(a) == 1) & (F.col(b) == 1)).alias(f"{a}_{b}") for a, b in pairs])


def validate_split(df: DataFrame, group: str, label: str, site: str, partition: str = "partition") -> DataFrame:
    """Per partition: rows, class rows, groups and class sites."""
    def sites(y):
        return F.countDistinct(F.when(F.col(label) == y, F.col(site)))

    return df.groupBy(partition).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(label) == 1).alias("positive_rows"),
        F.count_if(F.col(label) == 0).alias("negative_rows"),
        F.countDistinct(group).alias("groups"),
        sites(1).alias("positive_sites"), sites(0).alias("negative_sites"))


def split_digest(df: DataFrame, key: str, partition: str = "partition") -> Column:
    return digest(F.col(key), F.col(partition))

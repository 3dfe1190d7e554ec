"""Cuts, running totals and splits against brute force, under other partitionings."""

import random
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siteval.functions.hashing import h60
from siteval.operators import audit, joins, ranking, splits


@pytest.fixture(scope="module")
def rows(spark):
    """2,000 rows; group 0 holds a third of them."""
    df = spark.range(2000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97).alias("site"),
        F.when(F.col("id") % 5 < 2, 1).otherwise(0).alias("label"))
    return df


def by_id(df, col):
    return {r["id"]: r[col] for r in df.select("id", col).collect()}


def test_stratified_counts_and_determinism(rows):
    a = splits.split_stratified(rows.repartition(1), "id", "label", 42)
    b = splits.split_stratified(rows.repartition(31), "id", "label", 42)
    assert by_id(a, "partition") == by_id(b, "partition")
    counts = {(r["label"], r["partition"]): r["count"] for r in a.groupBy("label", "partition").count().collect()}
    assert counts == {(0, "train"): 840, (0, "validation"): 180, (0, "test"): 180,
                      (1, "train"): 560, (1, "validation"): 120, (1, "test"): 120}


def test_split_matches_row_ranks(rows):
    got = by_id(splits.split_random(rows, "id", 7), "partition")
    pdf = rows.select("id", h60(7, "rows", F.col("id")).alias("h")).toPandas().sort_values(["h", "id"]).reset_index(drop=True)
    want = {int(i): "train" if k < 1400 else "validation" if k < 1700 else "test" for k, i in enumerate(pdf["id"])}
    assert got == want


def test_group_splits_are_disjoint_and_complete(rows):
    for split in (splits.split_group_prefix(rows, "site", 42), splits.split_group_best(rows, "site", "label", 42, 10)):
        assert split.where("partition is null").count() == 0
        o = splits.key_overlap(split, "site").first()
        assert tuple(o) == (0, 0, 0)
        exposure = audit.site_exposure(split, "label", "site", "site").collect()
        assert all(r["site_seen_pct"] == 0 for r in exposure)


def test_sample_larger_than_table_returns_all(rows):
    assert splits.sample_n(rows, "id", 5000, 1).count() == 2000
    assert splits.sample_n(rows, "id", 123, 1).count() == 123
    assert splits.sample_n(rows, "id", 0, 1).count() == 0


def test_cap_keeps_k_of_a_hot_group(rows):
    kept = splits.cap_per_group(rows, ["site"], ["id"], 5)
    assert kept.groupBy("site").count().agg(F.max("count")).first()[0] == 5
    assert kept.where("site = 0").agg(F.max("id")).first()[0] == 12


def test_running_total_and_ordinal_match_pandas(rows):
    got = ranking.running_total(rows, [F.desc("site"), F.asc("id")], "label").toPandas().sort_values("id")
    pdf = rows.toPandas().sort_values(["site", "id"], ascending=[False, True])
    pdf["running"] = pdf["label"].cumsum()
    assert list(got["running"]) == list(pdf.sort_values("id")["running"])
    numbered = ranking.ordinal(rows.repartition(7), [F.asc("site"), F.asc("id")]).toPandas()
    assert sorted(numbered["ordinal"]) == list(range(2000))


def test_average_rank_matches_pandas(rows):
    got = by_id(ranking.average_rank(rows, -F.col("site")), "avg_rank")
    pdf = rows.toPandas()
    want = dict(zip(pdf["id"], (-pdf["site"]).rank(method="average")))
    assert got == want


def test_hash_ordinal_is_dense_per_stratum(rows):
    d = ranking.hash_ordinal(rows, ["label"], h60("x", F.col("id")), "id").toPandas()
    for label, g in d.groupby("label"):
        assert sorted(g["ordinal"]) == list(range(len(g))) and set(g["n"]) == {len(g)}


def test_missing_labels_are_a_stratum(rows):
    some = rows.withColumn("label", F.when(F.col("id") % 4 != 0, F.col("label")))
    counts = {(r["label"], r["partition"]): r["count"] for r in
              splits.split_stratified(some, "id", "label", 42).groupBy("label", "partition").count().collect()}
    assert counts[(None, "train")] == 350 and counts[(None, "test")] == 75
    assert ranking.cap_rank(some, ["label"], ["id"]).count() == 2000


def test_size_statistics_golden(spark):
    sizes = [("a", 1), ("b", 1), ("c", 2), ("d", 4)]
    df = spark.createDataFrame([(0, k) for k, n in sizes for _ in range(n)], "label int, site string")
    assert audit.gini(df, "site", ["label"]).first()["gini"] == 0.3125
    c = audit.groups_to_cover(df, "site", ["label"]).first()
    assert (c["cover_50"], c["cover_90"]) == (1, 4)
    assert audit.topk_share(df, "site", ["label"]).first()["top1_share"] == 0.5


def test_percentiles_golden(spark):
    df = spark.createDataFrame([(0, f"k{k}") for k, n in enumerate((1, 2, 3, 10)) for _ in range(n)], "label int, site string")
    m = audit.multiplicity_from(audit.size_histogram(df, "site", ["label"]), ["label"]).first()
    assert (m["p75"], m["p90"]) == (4.75, pytest.approx(7.9))


def test_skew_joins_equal_plain_joins(rows):
    dim = rows.select("site").distinct().where("site % 2 = 0").withColumn("w", F.col("site") * 10)
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = sorted(map(tuple, joins.skew_join(rows, dim, "site", how).select("id", "site").collect()))
        b = sorted(map(tuple, rows.join(dim, "site", how).select("id", "site").collect()))
        assert a == b


def test_guards_raise(spark, rows):
    dup = spark.createDataFrame([(1, "a"), (1, "b")], "id long, v string")
    with pytest.raises(Exception, match="not unique"):
        joins.join_one_to_one(rows, dup, "id").collect()
    with pytest.raises(Exception, match="key not found"):
        joins.lookup(rows, dup.limit(1), "id").collect()
    assert joins.missing_ids(dup, rows, "id").count() == 1999


def test_quarantine_and_dedup(spark):
    df = spark.createDataFrame([(1, "u1", "a", 0), (2, "u1", "a", 1), (3, "u2", "b", 0), (4, "u3", "b", 1), (5, "u4", "c", 1), (6, "u4", "c", 1)],
                               "id int, h string, site string, label int")
    kept = splits.quarantine(df, "h", "site", "label")
    assert sorted(r["id"] for r in kept.collect()) == [5, 6]
    assert [r["id"] for r in splits.dedup(kept, "h", ["label", "site", "id"]).collect()] == [5]


def test_band_sample(spark):
    df = spark.range(1, 101).select(F.col("id").cast("int").alias("rank"), F.concat(F.lit("d"), "id").alias("domain"))
    got = splits.sample_bands(df, "rank", "domain", [(1, 50), (51, 90)], 10, 42).toPandas()
    assert got.groupby("rank_band").size().to_dict() == {"1-50": 10, "51-90": 10}
    assert isinstance(got, pd.DataFrame)


def loop_greedy(sizes, weights=(14, 3, 3)):
    """The sequential loop: each to the least filled share, the first of equals."""
    filled, out = [0] * len(weights), []
    for n in sizes:
        k = min(range(len(weights)), key=lambda i: Fraction(filled[i], weights[i]))
        filled[k] += n
        out.append(k)
    return out, filled


@pytest.mark.parametrize("seed", range(5))
def test_greedy_shares_equal_the_loop(seed):
    rng = random.Random(seed)
    weights = rng.choice([(14, 3, 3), (1, 1, 1), (5, 2, 1)])
    filled = [rng.randrange(200) for _ in weights]
    size, count = rng.randrange(1, 9), 150
    so_far, want = list(filled), [[0] * len(weights)]
    for _ in range(count):
        k = min(range(len(weights)), key=lambda i: Fraction(so_far[i], weights[i]))
        so_far[k] += size
        want.append([w + (i == k) for i, w in enumerate(want[-1])])
    got = splits.greedy_shares(np.array(filled)[:, None], np.full(count + 1, size), np.arange(count + 1), weights)
    assert got.T.tolist() == want


def test_greedy_split_equals_the_loop(spark):
    rng = random.Random(8)
    sizes = [400, 90, 90] + [rng.choice([1, 1, 1, 2, 3, 7, 20]) for _ in range(300)]
    rows = [(g, i) for g, n in enumerate(sizes) for i in range(n)] + [(None, 0)] * 3
    df = spark.createDataFrame(rows, "g long, i int").where("g IS NOT NULL")
    got = {r["g"]: r["partition"] for r in splits.split_group_greedy(df, "g", 5).select("g", "partition").distinct().collect()}
    order = df.select("g").distinct().withColumn("h", h60(5, "greedy", F.col("g"))).collect()
    order = sorted(order, key=lambda r: (-sizes[r["g"]], r["h"], r["g"]))
    want, _ = loop_greedy([sizes[r["g"]] for r in order])
    assert got == {r["g"]: splits.PARTITIONS[k] for r, k in zip(order, want)}
    assert splits.split_group_greedy(df.limit(0), "g", 5).count() == 0

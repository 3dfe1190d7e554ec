"""Metrics against golden values and brute force; bootstrap properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteval.functions.hashing import unit
from siteval.operators import bootstrap as B
from siteval.operators import metrics as K


def brute(y, p, w=None):
    y, p = np.asarray(y, float), np.asarray(p, float)
    w = np.ones_like(y) if w is None else np.asarray(w, float)
    z = p >= .5
    tn, fp = w[(y == 0) & ~z].sum(), w[(y == 0) & z].sum()
    fn, tp = w[(y == 1) & ~z].sum(), w[(y == 1) & z].sum()
    den = np.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    mcc = (tp * tn - fp * fn) / den if den else 0.0
    pos, neg = (w * y).sum(), (w * (1 - y)).sum()
    ap = sum((w * y)[p == s].sum() * (w * y)[p >= s].sum() / w[p >= s].sum() for s in np.unique(p) if w[p >= s].sum()) / pos
    roc = sum((w * y)[p == s].sum() * ((w * (1 - y))[p < s].sum() + .5 * (w * (1 - y))[p == s].sum()) for s in np.unique(p)) / (pos * neg)
    return mcc, ap, roc


def test_golden_metrics(spark):
    df = spark.createDataFrame(list(zip([1, 1, 0, 0, 1], [.9, .4, .6, .2, .6])), "label int, score double").withColumn("e", F.lit(1))
    m = K.classification_metrics(df, ["e"]).first()
    assert (m["tp"], m["fn"], m["fp"], m["tn"]) == (2, 1, 1, 1)
    assert m["mcc"] == pytest.approx(0.166667, abs=1e-6)
    assert m["pr_auc"] == pytest.approx(0.805556, abs=1e-6)
    assert m["roc_auc"] == pytest.approx(0.75)
    one = K.classification_metrics(df, []).first()
    assert one["roc_auc"] == pytest.approx(0.75)


def test_single_class_prediction_is_defined(spark):
    df = spark.createDataFrame([(1, .1), (0, .2)], "label int, score double").withColumn("e", F.lit(1))
    m = K.classification_metrics(df, ["e"]).first()
    assert (m["mcc"], m["precision"]) == (0.0, 0.0)


@pytest.fixture(scope="module")
def pred(spark):
    """600 class-pure rows; site 0-x holds a third."""
    df = spark.range(600).select("id", (F.col("id") % 2).cast("int").alias("label"),
                                 F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("s"))
    df = df.withColumn("site", F.concat_ws("-", "s", "label"))
    score = F.floor((0.4 * F.col("label") + 0.6 * unit("t", F.col("id"))) * 50) / 50.0
    return df.withColumn("score", score).withColumn("e", F.lit("x"))


def test_rank_metrics_match_brute_force(pred):
    m, p = K.classification_metrics(pred, ["e"]).first(), pred.toPandas()
    assert (m["mcc"], m["pr_auc"], m["roc_auc"]) == pytest.approx(brute(p["label"], p["score"]), abs=1e-12)


def test_spearman_matches_pandas(pred):
    p = pred.toPandas()
    got = K.spearman(pred, "score", "id").first()["spearman"]
    assert got == pytest.approx(p["score"].rank().corr(p["id"].rank()), abs=1e-12)


@pytest.mark.parametrize("leaf", [B.LEAF, 16])
def test_bootstrap_matches_brute_force(pred, leaf):
    reps = B.BLOCK + 4  # two blocks
    chosen = [0, 1, 5, B.BLOCK - 1, B.BLOCK, reps - 1]
    table = B.clusters(pred, ["e"], "site")
    drawn = B.single_draws(B.draw_clusters(table, ["e"], reps, 42, leaf_size=leaf), ["e"], reps)
    sizes = {r["class"]: r["n"] for r in table.select("class", "n").distinct().collect()}
    totals = drawn.groupBy("replicate", "class").agg(F.sum("multiplicity").alias("m")).collect()
    assert len(totals) == 2 * reps and all(r["m"] == sizes[r["class"]] for r in totals)
    want = drawn.join(table.select("class", "ordinal", "site"), ["class", "ordinal"]).toPandas()
    p = pred.toPandas()
    got = B.bootstrap(pred, ["e"], "site", reps, 42, leaf_size=leaf).toPandas()
    assert len(got) == 9 * reps
    for rep in chosen:
        w = p["site"].map(want[want["replicate"] == rep].set_index("site")["multiplicity"]).fillna(0)
        values = got[got["replicate"] == rep].set_index("metric")["value"]
        assert tuple(values[["mcc", "pr_auc", "roc_auc"]]) == pytest.approx(brute(p["label"], p["score"], w), abs=1e-12)
    # chosen replicates alone, and the first by plain formulas
    again = B.bootstrap(pred, ["e"], "site", chosen, 42, leaf_size=leaf).toPandas()
    both = again.merge(got, on=["replicate", "metric"])
    assert len(both) == 9 * len(chosen) and (both["value_x"] - both["value_y"]).abs().max() < 1e-12
    plain = B.formula_metrics(pred, table, ["e"], "site", 5, 42, leaf_size=leaf).toPandas().merge(got, on=["replicate", "metric"])
    assert len(plain) == 9 and (plain["value_x"] - plain["value_y"]).abs().max() < 1e-12


def test_rank_replicates_shuffle_plain_rows_in_any_tiles(pred):
    """Many small tiles, slices that end inside a tied score and two tied halves give the same areas; no exchange carries a number per replicate."""
    reps, table = B.BLOCK + 4, B.clusters(pred, ["e"], "site").localCheckpoint()
    tied = pred.withColumn("score", F.when(F.col("id") % 2 == 0, F.lit(.5)).otherwise(F.col("score")))
    for rows in (pred, tied):
        scores = B.score_rows(rows, table, ["e"], "site").localCheckpoint()
        one = B.replicate_rank_metrics(table, scores, ["e"], reps, 42, leaf_size=16)
        many = B.replicate_rank_metrics(table, scores, ["e"], reps, 42, leaf_size=16, tile=20)
        assert "binary" not in str([f.dataType for f in one.schema]) and "_w#" not in one._jdf.queryExecution().toString()
        a, b = (x.toPandas().sort_values("replicate").reset_index(drop=True) for x in (one, many))
        assert len(a) == len(b) == reps and (a[["pr_auc", "roc_auc"]] - b[["pr_auc", "roc_auc"]]).abs().max().max() < 1e-12


def test_tile_walk_in_slices(monkeypatch):
    rng = np.random.default_rng(5)
    scored = np.sort(rng.integers(0, 9, 3000))[::-1]
    pos, site = rng.integers(0, 3, 3000), rng.integers(0, 50, 3000)
    tot, weights = pos + rng.integers(0, 2, 3000), rng.poisson(1, (50, 7)).astype(np.uint8)
    tile = B._Tile()
    for at in range(0, 3000, 700):
        part = slice(at, at + 700)
        tile.add(site[part], scored[part], pos[part], tot[part])
    tile.closed()
    monkeypatch.setattr(B, "SLICE", 1)  # slices of 256 rows, shorter than a tied score
    got = tile.areas(weights, np.zeros((2, 7)))
    for k in range(7):
        w = weights[site, k].astype(float)
        p, n = pos * w, (tot - pos) * w
        ap = sum(p[scored == s].sum() * p[scored >= s].sum() / (p + n)[scored >= s].sum() for s in range(9))
        above = sum(p[scored == s].sum() * (n[scored > s].sum() + n[scored == s].sum() / 2) for s in range(9))
        assert got[:, k] == pytest.approx([ap, above, p.sum(), n.sum()])


def test_leaf_counts_are_a_multinomial():
    n, leaves = 83, 11
    counts = np.stack([B.leaf_counts((1, "s", 0), n, k, 3, 8) for k in range(leaves)])
    assert counts.shape == (leaves, B.BLOCK) and (counts.sum(axis=0) == n).all() and counts.min() >= 0
    share = np.array([8] * 10 + [3]) / n
    spread = np.sqrt(n * share * (1 - share) / B.BLOCK)
    assert (np.abs(counts.mean(axis=1) - n * share) < 5 * spread).all()
    made = np.stack([B.leaf_multiplicities((1, "s", 0), n, 10, 3, [7, 200], 8)])
    assert (made.sum(axis=1) == counts[10, [7, 200]]).all()


def test_multiplicities_are_uniform():
    n = 500
    made = np.hstack([B.leaf_multiplicities((9, "s", 1), n, 0, k, list(range(B.BLOCK))) for k in range(8)]).astype(float)
    assert (made.sum(axis=0) == n).all()
    assert abs(made.var() - (1 - 1 / n)) < 0.01  # of a binomial (n, 1/n)
    assert np.abs(made.mean(axis=1) - 1).max() < 5 / np.sqrt(made.shape[1])
    assert abs(np.corrcoef(made[0], made[1])[0, 1] + 1 / (n - 1)) < 0.1


def test_draws_do_not_depend_on_partitioning(pred):
    a = B.draw_clusters(B.clusters(pred.repartition(1), ["e"], "site"), ["e"], 5, 42)
    b = B.draw_clusters(B.clusters(pred.repartition(17), ["e"], "site"), ["e"], 5, 42)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_mixed_site_and_missing_replicate_fail(spark, pred):
    bad = pred.withColumn("site", F.lit("one"))
    with pytest.raises(Exception, match="both labels"):
        B.clusters(bad, ["e"], "site").collect()
    reps = spark.createDataFrame([("x", 0, "mcc", 0.5), ("x", 1, "mcc", None)], "e string, replicate int, metric string, value double")
    with pytest.raises(Exception, match="degenerate"):
        B.assert_complete(reps, ["e"], 2).collect()


def test_interval_and_difference(spark):
    a = spark.createDataFrame([("x", i, "mcc", float(i)) for i in range(101)], "e string, replicate int, metric string, value double")
    ci = B.percentile_ci(a, ["e"]).first()
    assert (ci["lower"], ci["upper"]) == (2.5, 97.5)
    d = B.difference_ci(a, a.withColumn("value", F.col("value") - 1), ["e"]).first()
    assert (d["lower"], d["upper"]) == (1.0, 1.0)


@pytest.mark.parametrize("leaf", [B.LEAF, 16])
def test_draw_digests_are_those_of_the_multiplicities(pred, leaf):
    import hashlib
    reps = B.BLOCK + 4
    table = B.clusters(pred, ["e"], "site").localCheckpoint()
    want = {}
    for r in B.draw_clusters(table, ["e"], reps, 42, leaf_size=leaf).collect():
        ks = r["multiplicities"]
        if any(ks):
            text = ",".join(f"{i}:{k}" for i, k in enumerate(ks) if k)
            want[r["class"], r["ordinal"]] = (sum(k > 0 for k in ks), sum(ks), max(ks), hashlib.sha256(text.encode()).hexdigest())
    got = B.draw_digests(table, ["e"], reps, 42, leaf_size=leaf)
    assert "transform" not in got._jdf.queryExecution().toString()  # no list per cluster leaves the task that made it
    got = {(r["class"], r["ordinal"]): (r["replicates"], r["draws"], r["most"], r["multiplicities_sha256"]) for r in got.collect()}
    assert got == want


def test_listed_digest_of_many_draws():
    import hashlib
    made = np.array([[0, 12, 3], [9, 0, 1]], np.uint16)
    assert B.listed_digests(made, np.array([5, 6, 70])) == [hashlib.sha256(t).hexdigest() for t in (b"6:12,70:3", b"5:9,70:1")]

"""Boosted trees over grouped rows against MLlib's; permutation importance without widened rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteval.functions.hashing import unit
from siteval.operators import attribution as A
from siteval.operators import boosting as G
from siteval.operators import models as M

COLS = ["length", "dots", "port"]


@pytest.fixture(scope="module")
def rows(spark):
    """3,000 rows with 500 different predictors at most; ``length`` takes many more values than ``dots``."""
    df = spark.range(3000).select(
        "id", F.floor(unit("a", F.col("id")) * 50).cast("double").alias("length"),
        F.floor(unit("b", F.col("id")) * 5).cast("double").alias("dots"), (F.col("id") % 2).cast("double").alias("port"))
    odds = F.col("length") / 50 + F.col("dots") * F.col("port") / 8 + 0.7 * unit("c", F.col("id"))
    return df.withColumn("label", (odds > 1).cast("int")).localCheckpoint()


@pytest.mark.parametrize("leaves", [7, 31])
def test_grouped_fit_in_tasks_is_the_fit_of_all_rows(rows, leaves):
    settings = [{"learning_rate": r, "max_iter": 8, "max_leaf_nodes": leaves} for r in (.1, .3)]
    grouped = M.grouped_rows(rows, COLS, "label")
    assert grouped.count() < 1001 and grouped.agg(F.sum(M.ROWS)).first()[0] == 3000
    vectors = M.assemble(rows, COLS)
    in_tasks = M.fit_boosted(grouped, settings, COLS, "label", 3000)
    by_jobs = M.fit_boosted(grouped, settings[:1], COLS, "label", 3000, at_once=0)  # too many for a task
    for params, trees in [*zip(settings, in_tasks), (settings[0], by_jobs[0])]:
        plain = M.fit_gbt(vectors, params)
        want = M.score(plain, vectors, ["id"]).orderBy("id").toPandas()
        for got in (trees, G.from_mllib(plain)):
            got = M.score(got, vectors, ["id"]).orderBy("id").toPandas()
            assert np.abs(got["score"] - want["score"]).max() < 1e-9 and (got["predicted"] == want["predicted"]).all()


def test_many_values_are_cut_into_equal_shares():
    values = np.arange(1000.0)
    points = G.split_points(values, np.ones(1000), 10)
    assert len(points) == 9 and np.abs(np.diff(points) - 100).max() <= 1
    assert G.split_points(np.array([3.0, 1.0, 1.0]), np.ones(3)).tolist() == [2.0]
    assert len(G.split_points(np.ones(4), np.ones(4))) == 0


def test_no_split_gives_the_mean():
    t = G.fit_trees(np.zeros((50, 2)), np.repeat([0.0, 1.0], [20, 30]), np.ones(50), 2, .1, 3)
    assert t.margins(np.zeros((1, 2)))[0] == pytest.approx(.2 + .1 * np.mean(np.repeat([-4, 4], [20, 30]) / (1 + np.exp(2 * np.repeat([-.2, .2], [20, 30])))))


def test_source_positions_invert_the_permutation():
    for n in (1, 2, 5, 16, 17, 1000, 4097):
        key = A.run_key(3, "f", n)
        assert (A.source_positions(A.shuffled_positions(np.arange(n), n, key), n, key) == np.arange(n)).all()


def test_decisions_for_every_place_of_a_value(rows):
    [trees] = M.fit_boosted(M.grouped_rows(rows, COLS, "label"), [{"learning_rate": .1, "max_iter": 10, "max_leaf_nodes": 31}], COLS, "label", 3000)
    x = rows.select(*COLS).toPandas().to_numpy()[:300]
    model = G.Responses(trees, 3)
    made = model.decisions([model.codes(x[:, f], f) for f in range(3)], [0, 1, 2])
    for f in range(3):
        for code, value in enumerate(np.append(model.points[f], np.inf)):
            moved = x.copy()
            moved[:, f] = value
            assert (made[f][code] == (G.probability(trees.margins(moved)) >= .5)).all()


@pytest.mark.parametrize("sizes", [{}, {"chunk": 64, "sent": 256, "met": 512}])
def test_tree_importance_is_that_of_widened_rows(rows, sizes):
    """Whole, and with several chunks, blocks of values and ranges of receivers; no row is exploded by run."""
    [trees] = M.fit_boosted(M.grouped_rows(rows, COLS, "label"), [{"learning_rate": .1, "max_iter": 10, "max_leaf_nodes": 15}], COLS, "label", 3000)
    test = rows.where("id % 3 = 0")

    def score(df):
        return M.score(trees, M.assemble(df, COLS), [c for c in ("id", "label", "feature", "repeat") if c in df.columns])

    want = {(r.feature, r.repeat): r for r in A.keyed_permutation_importance(test, "id", "label", COLS, score, 3, 9).collect()}
    args = (test, "id", "label", COLS, trees, score(test), 3, 9)
    made = A.tree_permutation_importance(*args, **sizes)
    got = {(r.feature, r.repeat): r for r in made.collect()}
    assert len(want) == 9 and got == want and "posexplode" not in made._jdf.queryExecution().toString()
    [alone] = A.tree_permutation_importance(*args, runs=[("dots", 2)], **sizes).collect()
    assert alone == want["dots", 2]

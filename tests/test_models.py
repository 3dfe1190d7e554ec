"""Selection, gate, TF-IDF weights, attribution identities."""

import collections
import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteval.functions.features import ABLATIONS, FEATURES, ablation_features
from siteval.functions.hashing import h60, unit
from siteval.operators import attribution as A
from siteval.operators import models as M
from siteval.operators import tfidf
from siteval.plans import catalog
from siteval.plans.tables import Tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parts(spark):
    df = spark.range(900).select(
        "id", (F.col("id") % 2).cast("int").alias("label"), F.concat(F.lit("http://s"), F.col("id") % 30, F.lit(".com/a"), F.col("id") % 2).alias("url"),
        (unit("a", F.col("id")) + F.col("id") % 2).alias("url_length"), unit("b", F.col("id")).alias("dot_count"),
        F.lit(1.0).alias("has_port"))
    return df.where("id % 10 < 7"), df.where("id % 10 in (7, 8)"), df.where("id % 10 = 9")


def test_search_select_score(spark, parts, folder):
    train, val, test = parts
    bench = M.Bench(train, val, "id", "label", "url", ["url_length", "dot_count", "has_port"])
    results = M.search(bench, {"M1": {"C": [0.01, 1.0]}, "M2": {"learning_rate": [.1], "max_iter": [3], "max_leaf_nodes": [7]},
                               "M3": {"C": [1.0], "max_features": [50]}}).cache()
    assert results.count() == 4
    best = M.select_best(results, tie="capacity")
    assert best.count() == 3
    M.freeze_selection(best, "split", "search", folder + "/frozen")
    assert M.open_test_gate(spark, folder + "/frozen", "split", "search").count() == 3
    with pytest.raises(RuntimeError, match="closed"):
        M.open_test_gate(spark, folder + "/frozen", "split", "other")
    with pytest.raises(Exception):
        M.freeze_selection(best, "split", "search", folder + "/frozen")
    scored = M.score_test(bench, best, test, [])
    assert scored.groupBy("model_id").count().count() == 3
    accuracy = scored.groupBy("model_id").agg(F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("a"))
    assert all(r["a"] > .9 for r in accuracy.collect())
    bench.close()


def test_first_rounds_are_the_shorter_fit(parts):
    train, val, _ = parts
    train, val = (M.assemble(x, ["url_length", "dot_count"]) for x in (train, val))
    params = {"learning_rate": .1, "max_leaf_nodes": 7}
    long, short = (M.fit_gbt(train, params | {"max_iter": n}) for n in (6, 3))
    cut = M.first_trees(long, 3)
    assert cut.getNumTrees == 3 and M.first_trees(long, 6) is long
    a, b = (M.score(m, val, ["id"]).orderBy("id").toPandas() for m in (cut, short))
    assert a["score"].tolist() == pytest.approx(b["score"].tolist(), abs=1e-12)


def test_small_vocabulary_is_the_start_of_a_large_one(parts):
    train, val, _ = parts
    with M.Bench(train, val, "id", "label", "url", ["url_length"]) as bench:
        bench.largest = 60
        cut = bench.prepared("M3", {"C": 1.0, "max_features": 20})
        assert isinstance(cut[0], M.FirstRanks)
        plain = M.CharNgrams(train, "id", "url", 20)
        for made, rows in ((cut[1], train), (cut[2], val)):
            want = {r["id"]: r["features"].toArray() for r in plain.vectors(rows).collect()}
            got = {r["id"]: r["features"].toArray() for r in made.collect()}
            assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)
    assert not bench._ready and not bench._models


def test_ties(spark):
    r = spark.createDataFrame([("M2", "a", '{"learning_rate": 0.1, "max_iter": 100, "max_leaf_nodes": 31}', .9),
                               ("M2", "b", '{"learning_rate": 0.05, "max_iter": 100, "max_leaf_nodes": 31}', .9),
                               ("M2", "c", '{"learning_rate": 0.01, "max_iter": 50, "max_leaf_nodes": 15}', .8)],
                              "model_id string, candidate_id string, parameter_json string, mcc double")
    with pytest.raises(Exception, match="tied"):
        M.select_best(r).collect()
    assert M.select_best(r, tie="capacity").first()["candidate_id"] == "b"


def test_grid_sizes_and_firewall():
    assert [len(list(M.candidates(g))) for g in M.GRIDS.values()] == [4, 8, 6]
    with pytest.raises(ValueError, match="label"):
        M.check_predictors(["url_length", "label"])


def test_scaler_uses_train_population_sd(spark, parts):
    train, val, _ = parts
    out = M.apply_scaler(val, M.fit_scaler(train, ["url_length", "has_port"]), ["url_length", "has_port"]).toPandas()
    t, v = train.toPandas(), val.toPandas()
    want = (v["url_length"] - t["url_length"].mean()) / t["url_length"].std(ddof=0)
    assert list(out.sort_values("id")["url_length"]) == pytest.approx(list(want[v.sort_values("id").index]))
    assert set(out["has_port"]) == {0.0}


def test_tfidf_matches_brute_force(spark):
    texts = {i: t for i, t in enumerate(["abc ab", "ABC  abd", "abx", "abc", "ab", "zab"])}
    df = spark.createDataFrame(list(texts.items()), "id int, text string")
    tokens = tfidf.char_ngrams(df, "id", "text")
    voc = tfidf.fit_char_tfidf(tokens, "id", df, 100, min_df=2)
    got = {(r["id"], r["token"]): r["weight"] for r in tfidf.tfidf_weights(tokens, "id", voc).collect()}
    counts = {}
    for i, t in texts.items():
        t = " ".join(t.lower().split("  "))
        counts[i] = collections.Counter(t[j:j + n] for n in range(2, 7) for j in range(len(t) - n + 1))
    df_count = collections.Counter(g for c in counts.values() for g in c)
    want = {}
    for i, c in counts.items():
        w = {g: (1 + math.log(k)) * (math.log((1 + len(texts)) / (1 + df_count[g])) + 1) for g, k in c.items() if df_count[g] >= 2}
        norm = math.sqrt(sum(x * x for x in w.values()))
        want.update({(i, g): x / norm for g, x in w.items()})
    assert got == pytest.approx(want)


def test_local_attribution_sums_to_margin(spark, parts):
    train, _, test = parts
    coef, means = {"url_length": 2.0, "dot_count": -1.0}, {"url_length": 1.0, "dot_count": .5}
    phi = A.local_attribution(test, "id", coef, means).groupBy("id").agg(F.sum("phi").alias("s"))
    both = test.join(phi, "id").withColumn("m", 2 * F.col("url_length") - F.col("dot_count") - 1.5)
    assert both.where(F.abs(F.col("m") - F.col("s")) > 1e-12).count() == 0


def test_permuted_values_are_a_permutation(parts):
    train, _, _ = parts
    moved = A.permuted_rows(train, "id", ["url_length"], 3, 42).toPandas()
    original = sorted(train.toPandas()["url_length"])
    for _, g in moved.groupby("repeat"):
        assert sorted(g["value"]) == original and g["id"].is_unique


def test_permutation_importance_agrees_with_full_rescoring(parts):
    _, _, test = parts
    cols, w, b = ["url_length", "dot_count"], {"url_length": 2.0, "dot_count": -1.0}, -1.5

    def score(df):
        return df.withColumn("predicted", (F.col("url_length") * 2 - F.col("dot_count") - 1.5 >= 0).cast("int"))

    a = A.permutation_importance(test, "id", "label", cols, w, b, 2, 7)
    c = A.model_permutation_importance(test, "id", "label", cols, score, 2, 7)
    diff = A.replay_difference(a, c, ["feature", "repeat"], "importance").first()
    assert diff["compared"] == 4 and diff["max_abs_diff"] < 1e-12


@pytest.mark.parametrize("n", [1, 2, 5, 16, 17, 1000, 4097])
def test_shuffled_positions_are_a_permutation(n):
    made = [A.shuffled_positions(np.arange(n), n, A.run_key(1, "f", r)) for r in range(3)]
    assert all(sorted(m) == list(range(n)) for m in made)
    part = A.shuffled_positions(np.array([n - 1, 0]), n, A.run_key(1, "f", 0))
    assert part.tolist() == [made[0][n - 1], made[0][0]]
    assert n < 100 or (made[0] != made[1]).mean() > .9 and abs(np.corrcoef(np.arange(n), made[0])[0, 1]) < .2


def test_keyed_importance_against_explicit_permutations(parts):
    train = parts[0].withColumn("label", F.col("label").cast("int"))
    cols = ["url_length", "dot_count"]
    score = lambda df: df.withColumn("predicted", (F.col("url_length") - 0.2 * F.col("dot_count") > 0.9).cast("int"))
    got = A.keyed_permutation_importance(train.repartition(5), "id", "label", cols, score, 3, 9)
    got = {(r["feature"], r["repeat"]): r for r in got.collect()}
    p = train.withColumn("h", h60("position", F.col("id"))).toPandas().sort_values(["h", "id"], ignore_index=True)

    def mcc(x):
        z = (x["url_length"] - 0.2 * x["dot_count"] > 0.9).astype(int)
        return np.corrcoef(z, x["label"])[0, 1]

    assert len(got) == 6
    for (feature, repeat), r in got.items():
        moved = p.copy()
        to = A.shuffled_positions(np.arange(len(p)), len(p), A.run_key(9, feature, repeat))
        values = p[feature].to_numpy().copy()
        moved.loc[to, feature] = values
        assert r["permuted_mcc"] == pytest.approx(mcc(moved)) and r["baseline_mcc"] == pytest.approx(mcc(p))
    again = A.keyed_permutation_importance(train, "id", "label", cols, score, 3, 9, runs=[("dot_count", 2)]).collect()
    assert len(again) == 1 and again[0]["importance"] == got["dot_count", 2]["importance"]


def test_zero_attribution_fails(spark):
    phi = spark.createDataFrame([(1, "f", 0.0, 1.0)], "id int, feature string, phi_a double, phi_c double")
    with pytest.raises(Exception, match="without attribution"):
        A.local_change(phi, "id").collect()


def test_save_and_load(spark, parts, folder):
    from pyspark.ml import PipelineModel
    train, val, _ = parts
    model = M.fit_baseline("B1", train)
    M.save_model(model, folder, "A", "B1")
    again = M.load_model(PipelineModel, folder, "A", "B1")
    d = M.repeat_check(iter_models([model, again], val), ["id"]).first()
    assert d["within"] and d["label_changes"] == 0


def test_registry_refuses_changed_and_unknown_models(spark, parts, folder):
    from pyspark.ml.classification import LogisticRegressionModel
    train = M.assemble(parts[0], ["url_length", "dot_count"])
    model = M.fit_logistic(train, 1.0, 630)
    path = M.register_model(model, folder, "C", "M1")
    M.register_model(model, folder, "A", "M1")
    back = M.load_registered(LogisticRegressionModel, folder, "C", "M1")
    assert back.coefficients == model.coefficients and back.intercept == model.intercept
    with pytest.raises(LookupError):
        M.load_registered(LogisticRegressionModel, folder, "C", "M3")
    moved = M.tree_digest(spark, path)
    os.rename(path, path + "-kept")
    os.makedirs(folder + "/other")
    os.rename(path + "-kept", folder + "/other/model")
    assert M.tree_digest(spark, folder + "/other/model") == moved
    os.rename(folder + "/other/model", path)
    name = next(os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.startswith("part-"))
    with open(name, "ab") as f:
        f.write(b" ")
    os.remove(os.path.join(os.path.dirname(name), f".{os.path.basename(name)}.crc"))  # else the local file system itself refuses
    with pytest.raises(RuntimeError, match="changed"):
        M.load_registered(LogisticRegressionModel, folder, "C", "M1")
    assert M.load_registered(LogisticRegressionModel, folder, "A", "M1").intercept == model.intercept


def iter_models(models, df):
    todo = list(models)
    return lambda: M.score(todo.pop(), df, ["id"])


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_registered_model_queries_run_whole_grids(spark, monkeypatch):
    """Every candidate, regime and feature set; the fits themselves are not repeated here."""
    seen = []

    def search(bench, grids):
        seen.append((len(bench.features), {m: len(list(M.candidates(g))) for m, g in grids.items()}))
        rows = [(m, f"{m}_1", json.dumps(next(M.candidates(g)), sort_keys=True), 1, 0.5) for m, g in grids.items()]
        return spark.createDataFrame(rows, "model_id string, candidate_id string, parameter_json string, train_n long, mcc double")

    def score_test(bench, chosen, test, keep):
        models = F.explode(F.array(*[F.lit(r.model_id) for r in chosen.select("model_id").collect()])).alias("model_id")
        guess = F.when(F.col("page_id") % 7 == 0, 1 - F.col("label")).otherwise(F.col("label"))
        return test.select("page_id", "label", guess.cast("double").alias("score"), guess.alias("predicted"), models)

    monkeypatch.setattr(M, "search", search)
    monkeypatch.setattr(M, "score_test", score_test)
    t = Tables(spark, SF)
    catalog.QUERIES["m02_m06_search"](t)
    assert seen == [(len(FEATURES), {"M1": 4, "M2": 8, "M3": 6})]
    seen.clear()
    got = catalog.QUERIES["m09_m11_run_experiment"](t).collect()
    assert seen == [(len(FEATURES), {"M1": 4, "M2": 8, "M3": 6})] * 4
    assert {(r.regime, r.model_id) for r in got} == {(r, m) for r in "ABCD" for m in M.GRIDS}
    seen.clear()
    got = catalog.QUERIES["m12_run_ablation"](t).collect()
    assert seen == [(len(ablation_features(a)), {"M1": 4, "M2": 8}) for a in [None, *ABLATIONS]]
    assert {(r.feature_set, r.model_id) for r in got} == {(a, m) for a in ABLATIONS for m in ("M1", "M2")}
    assert all(r.mcc is not None and r.delta_mcc == 0 for r in got)


def test_chosen_permutations_are_those_of_the_full_run(parts):
    """A run made by itself, for rows that are numbered once for all runs."""
    train, cols = parts[0], ["url_length", "dot_count"]
    args = ("id", "label", cols, {"url_length": 1.0, "dot_count": -.5}, -.6, 3, 7)
    full = {(r.feature, r.repeat): r for r in A.permutation_importance(train, *args).collect()}
    chosen = [("dot_count", 2), ("url_length", 1)]
    alone = A.permutation_importance(train, *args, runs=chosen).collect()
    assert len(full) == 6 and len(alone) == 2 and all(full[r.feature, r.repeat] == r for r in alone)
    assert {(r.feature, r.repeat) for r in alone} == set(chosen)

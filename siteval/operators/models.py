"""Model fitting, selection and scoring with MLlib behind a test gate."""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property, reduce

from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import Normalizer, OneHotEncoder, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.pipeline import Pipeline
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteval.functions.features import FEATURES
from siteval.operators import boosting
from siteval.operators import tfidf as tf
from siteval.operators.integrity import run_checks
from siteval.operators.metrics import classification_metrics
from siteval.operators.ranking import best_rows, checkpointed

# Candidate grids of the three models.
GRIDS = {
    "M1": {"C": [0.01, 0.1, 1.0, 10.0]},
    "M2": {"learning_rate": [0.05, 0.1], "max_iter": [100, 200], "max_leaf_nodes": [31, 63]},
    "M3": {"C": [0.1, 1.0, 10.0], "max_features": [25000, 50000]},
}
# Parameters that grow with model capacity, in tie-break order.
CAPACITY = {"M1": ["C"], "M2": ["max_iter", "max_leaf_nodes", "learning_rate"], "M3": ["C", "max_features"]}

ROWS = "_rows"  # how many rows a grouped row stands for
FITS_AT_ONCE = 4  # fits that share the cluster; each keeps its own state on the driver
ROWS_PER_TASK = 25_000  # an iteration over fewer rows costs more in scheduling than in work

# Columns that identify rows, groups or labels.
FORBIDDEN = {
    "combined_row_id", "label", "site_key_private", "site_key_icann", "hostname", "normalized_url",
    "raw_url", "source", "tranco_rank", "partition", "split",
}


def check_predictors(cols: list[str]) -> list[str]:
    """The columns themselves, or an error when one may not reach a model."""
    bad = sorted(set(cols) & FORBIDDEN)
    if bad:
        raise ValueError(f"not allowed as predictors: {', '.join(bad)}")
    return list(cols)


def predictor_checks(df: DataFrame, cols: list[str]) -> DataFrame:
    """A named check per asked column: values of a forbidden one are violations."""
    return run_checks(df, {c: ("may reach a model", F.count(c) if c in FORBIDDEN else F.lit(0)) for c in cols})


def candidates(grid: dict[str, list]) -> Iterator[dict]:
    names = sorted(grid)
    for values in itertools.product(*(grid[n] for n in names)):
        yield dict(zip(names, values))


# ---------------------------------------------------------------- scaling

def fit_scaler(train: DataFrame, cols: list[str]) -> DataFrame:
    """One row of means and population deviations, from train rows only."""
    return train.agg(*[F.avg(c).alias(f"{c}__mean") for c in cols],
                     *[F.stddev_pop(c).alias(f"{c}__sd") for c in cols])


def scaler_table(scaler: DataFrame, cols: list[str]) -> DataFrame:
    rows = F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"{c}__mean").alias("mean"), F.col(f"{c}__sd").alias("sd"))
        for c in cols])).alias("r")
    return scaler.select(rows).select("r.*")


def apply_scaler(df: DataFrame, scaler: DataFrame, cols: list[str]) -> DataFrame:
    """(x - mean) / sd per column; constant columns are only centred."""
    def scaled(c: str) -> Column:
        sd = scaler.select(f"{c}__sd").scalar()
        return (F.col(c) - scaler.select(f"{c}__mean").scalar()) / F.when(sd == 0, 1.0).otherwise(sd)

    return df.withColumns({c: scaled(c) for c in cols})


def scaler_values(train: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    row = fit_scaler(train, cols).first()
    return {c: (float(row[f"{c}__mean"]), float(row[f"{c}__sd"]) or 1.0) for c in cols}


def scale_with(df: DataFrame, values: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in values.items()})


# ---------------------------------------------------------------- estimators

def assemble(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=check_predictors(cols), outputCol=out).transform(df)


def grouped_rows(train: DataFrame, cols: list[str], label: str) -> DataFrame:
    """Equal predictors of one label as one row with their number; fits weigh it, so nothing is left out."""
    return train.groupBy(label, *check_predictors(cols)).agg(F.count(F.lit(1)).cast("double").alias(ROWS))


def fit_logistic(train: DataFrame, c: float, rows: int, label: str = "label", features: str = "features", weight: str | None = None):
    """L2 logistic regression with an unpenalised intercept; the penalty is
    1/C over the summed loss, which is 1/(C n) over the mean loss."""
    weighted = {"weightCol": weight} if weight else {}
    return LogisticRegression(
        featuresCol=features, labelCol=label, regParam=1.0 / (c * rows), elasticNetParam=0.0,
        standardization=False, maxIter=1000, tol=1e-4, family="binomial", **weighted).fit(train)


def fit_gbt(train: DataFrame, params: dict, label: str = "label", features: str = "features", seed: int = 42,
            weight: str | None = None, rows: int = 0):
    """Boosted trees by MLlib; of grouped rows, a leaf's least number counts their weights, out of ``rows``."""
    least = {"minInstancesPerNode": boosting.LEAST}
    if weight:
        least = {"weightCol": weight, "minWeightFractionPerNode": min(.49, (boosting.LEAST - .5) / rows)}
    return GBTClassifier(
        featuresCol=features, labelCol=label, maxIter=params["max_iter"], stepSize=params["learning_rate"],
        maxDepth=boosting.depth_of(params), maxBins=boosting.BINS, lossType="logistic", seed=seed, **least).fit(train)


def fit_boosted(grouped: DataFrame, settings: list[dict], cols: list[str], label: str, rows: int,
                at_once: int = boosting.AT_ONCE) -> list[boosting.Trees]:
    """Boosted trees of grouped rows: a task per setting, or jobs of MLlib where a task could not hold them."""
    if grouped.count() <= at_once:
        return boosting.fit_side_by_side(grouped, cols, label, ROWS, settings)
    vectors = assemble(grouped, cols).select(label, "features", ROWS).persist()
    made = [boosting.from_mllib(fit_gbt(vectors, p, label, weight=ROWS, rows=rows)) for p in settings]
    vectors.unpersist()
    return made


def first_trees(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The model after its first ``n`` rounds: boosting only adds trees, so one
    long fit holds every shorter one."""
    fitted = model._java_obj
    if n >= model.getNumTrees:
        return model
    gateway = SparkContext._active_spark_context._gateway
    kind = gateway.jvm.org.apache.spark.ml.classification.GBTClassificationModel
    trees = gateway.new_array(gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = gateway.new_array(gateway.jvm.double, n)
    all_trees, all_weights = fitted.trees(), fitted.treeWeights()
    for i in range(n):
        trees[i], weights[i] = all_trees[i], all_weights[i]
    short = kind(f"{model.uid}_{n}", trees, weights)
    for p in ("featuresCol", "labelCol", "predictionCol", "probabilityCol", "rawPredictionCol"):
        short.set(short.getParam(p), fitted.getOrDefault(fitted.getParam(p)))
    return GBTClassificationModel(short)


def fit_baseline(kind: str, train: DataFrame, label: str = "label") -> PipelineModel:
    """B1: URL length alone.  B2: one-hot public suffix."""
    if kind == "B1":
        stages = [VectorAssembler(inputCols=["url_length"], outputCol="features")]
    elif kind == "B2":
        stages = [StringIndexer(inputCol="public_suffix_private", outputCol="_suffix", handleInvalid="keep"),
                  OneHotEncoder(inputCols=["_suffix"], outputCols=["features"], handleInvalid="keep")]
    else:
        raise ValueError(kind)
    return Pipeline(stages=[*stages, LogisticRegression(labelCol=label, maxIter=1000, tol=1e-4)]).fit(train)


def score(model: Transformer | boosting.Trees, df: DataFrame, keep: list[str]) -> DataFrame:
    """Positive-class probability and the 0.5 decision."""
    if isinstance(model, boosting.Trees):
        return model.score(df, keep)
    scored = model.transform(df).withColumn("score", vector_to_array("probability")[1])
    return scored.select(*keep, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


# ---------------------------------------------------------------- representations

class Tabular:
    """Engineered columns; standardised for linear models."""

    def __init__(self, train: DataFrame, cols: list[str], scaled: bool):
        self.cols = check_predictors(cols)
        self.scaler = scaler_values(train, self.cols) if scaled else None

    def vectors(self, df: DataFrame) -> DataFrame:
        return assemble(scale_with(df, self.scaler) if self.scaler else df, self.cols)


class CharNgrams:
    """Character n-gram weights with the vocabulary of the train rows."""

    def __init__(self, train: DataFrame, key: str, text: str, max_features: int, min_df: int = tf.MIN_DF):
        self.key, self.text = key, text
        self.weights = tf.fit_weights(train, text, max_features, min_df)
        self.size = self.weights.size

    def vectors(self, df: DataFrame) -> DataFrame:
        return df.withColumn("features", self.weights.vector(tf.cleaned(self.text)))


class FirstRanks:
    """The first ranks of a wider vocabulary: rows are cut and scaled to length 1 again."""

    def __init__(self, whole: CharNgrams, size: int, made: dict[int, DataFrame]):
        self.whole, self.size, self.made = whole, size, made
        self.slicer = VectorSlicer(inputCol="features", outputCol="_cut", indices=list(range(size)))
        self.scaler = Normalizer(inputCol="_cut", outputCol="features", p=2.0)

    def vectors(self, df: DataFrame) -> DataFrame:
        """Of rows that the wider bench has already made, or new ones."""
        wide = self.made[id(df)] if id(df) in self.made else self.whole.vectors(df)
        return self.scaler.transform(self.slicer.transform(wide).drop("features")).drop("_cut")


# ---------------------------------------------------------------- search and selection

class Bench:
    """Train and validation vectors of one experiment, prepared once per representation.

    All penalties share one matrix; a smaller n-gram vocabulary is the first
    ranks of the largest one, scaled anew.  Fitted models are kept, so a refit
    of the same candidate is the same model.  ``close`` gives the memory back.
    """

    def __init__(self, train: DataFrame, val: DataFrame, key: str, label: str, text: str,
                 features: list[str] | None = None, min_df: int = tf.MIN_DF):
        self.train, self.val = train, val
        self.key, self.label, self.text = key, label, text
        self.features, self.min_df = features or list(FEATURES), min_df
        self.rows = train.count()
        self.largest = 0  # vocabulary asked for so far
        self._ready: dict[tuple, tuple] = {}
        self._models: dict[tuple, Transformer | boosting.Trees] = {}

    @cached_property
    def grouped(self) -> DataFrame:
        return checkpointed(grouped_rows(self.train, self.features, self.label))

    def _kept(self, df: DataFrame, key: str | None = None) -> DataFrame:
        tasks = max(1, -(-self.rows // ROWS_PER_TASK))
        return df.select(key or self.key, self.label, "features").coalesce(tasks).persist()

    def prepared(self, model_id: str, params: dict):
        name = (model_id, params.get("max_features"))
        if name not in self._ready:
            if model_id == "M3":
                rep = self._ngrams(params["max_features"])
                train = self._kept(rep.vectors(self.train))
            else:
                rep = Tabular(self.train, self.features, scaled=model_id == "M1")
                train = self._kept(rep.vectors(self.grouped), ROWS) if model_id == "M1" else self.grouped
            self._ready[name] = (rep, train, self._kept(rep.vectors(self.val)))
        return self._ready[name]

    def _ngrams(self, size: int):
        """The widest vocabulary is built once; a smaller one takes its first ranks."""
        widest = max(self.largest, size)
        if size == widest:
            return CharNgrams(self.train, self.key, self.text, size, self.min_df)
        whole, train, val = self.prepared("M3", {"max_features": widest})
        return FirstRanks(whole, size, {id(self.train): train, id(self.val): val}) if size < whole.size else whole

    def fit(self, model_id: str, params: dict):
        """The representation, the model and the validation vectors of a candidate."""
        rep, train, val = self.prepared(model_id, params)
        name = (model_id, json.dumps(params, sort_keys=True))
        if name not in self._models:
            if model_id == "M2":
                [self._models[name]] = fit_boosted(train, [params], self.features, self.label, self.rows)
            else:
                self._models[name] = fit_logistic(train, params["C"], self.rows, self.label, weight=ROWS if model_id == "M1" else None)
        return rep, self._models[name], val

    def fit_all(self, model_id: str, grid: dict) -> None:
        """Every candidate of a grid, some side by side; boosting rounds are fitted once for all their prefixes."""
        wanted = list(candidates(grid))
        self.largest = max([self.largest, *grid.get("max_features", [])])
        for params in wanted:
            self.prepared(model_id, params)[1].count()
        if model_id != "M2":
            side_by_side(lambda p: self.fit(model_id, p), wanted)
            return
        most = max(p["max_iter"] for p in wanted)
        longest = [p for p in wanted if p["max_iter"] == most]
        whole = dict(zip((json.dumps(p, sort_keys=True) for p in longest), fit_boosted(self.grouped, longest, self.features, self.label, self.rows)))
        for params in wanted:
            long = whole[json.dumps(params | {"max_iter": most}, sort_keys=True)]
            self._models[model_id, json.dumps(params, sort_keys=True)] = long.first(params["max_iter"])

    def close(self) -> None:
        for _, train, val in self._ready.values():
            train.unpersist()
            val.unpersist()
        self._ready.clear()
        self._models.clear()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()


def side_by_side(fn: Callable, items: list) -> list:
    """Work whose steps are too short to fill the cluster, some items at once."""
    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        return list(pool.map(inheritable_thread_target(fn), items))


def search(bench: Bench, grids: dict[str, dict]) -> DataFrame:
    """Every candidate fitted on train and scored on validation: one row each.

    The candidates of a model are measured by one job.
    """
    names = ("mcc", "pr_auc", "roc_auc", "macro_f1", "recall", "precision")
    rows = []
    for model_id, grid in grids.items():
        bench.fit_all(model_id, grid)
        keep, fitted = [bench.key, bench.label], {f"{model_id}_{i}": bench.fit(model_id, params) for i, params in enumerate(candidates(grid), 1)}
        if model_id == "M2":  # all from the same vectors
            scored = boosting.score_all({name: model for name, (_, model, _) in fitted.items()}, next(iter(fitted.values()))[2], keep)
        else:
            scored = reduce(DataFrame.unionByName, [score(model, val, keep).withColumn("candidate_id", F.lit(name))
                                                    for name, (_, model, val) in fitted.items()])
        # cells, ranges and ranks read the scores; they are made once
        scored = checkpointed(scored.select("candidate_id", bench.label, "score"))
        found = {r["candidate_id"]: r for r in classification_metrics(scored, ["candidate_id"], bench.label).collect()}
        for i, params in enumerate(candidates(grid), 1):
            m = found[f"{model_id}_{i}"]
            rows.append((model_id, f"{model_id}_{i}", json.dumps(params, sort_keys=True), bench.rows, *[float(m[k]) for k in names]))
    schema = "model_id string, candidate_id string, parameter_json string, train_n long, " + ", ".join(f"{n} double" for n in names)
    return bench.train.sparkSession.createDataFrame(rows, schema)


def select_best(results: DataFrame, tie: str = "fail", metric: str = "mcc") -> DataFrame:
    """The best candidate per model.  Ties fail, or go to the lowest capacity."""
    if tie == "fail":
        top = best_rows(results, ["model_id"], metric)
        return top.where(F.when(F.col("ties") == 1, True).otherwise(
            F.raise_error(F.lit("tied best candidates")).cast("boolean"))).drop("ties")
    by_model = Window.partitionBy("model_id")
    near = results.withColumn("_near", F.max(metric).over(by_model) - F.col(metric) <= 1e-12)
    params = F.from_json("parameter_json", "map<string,double>")
    near = near.withColumn("_p", params)
    order = [F.desc("_near")]
    for names in itertools.zip_longest(*CAPACITY.values()):
        value = F.lit(None).cast("double")
        for model_id, name in zip(CAPACITY, names):
            if name:
                value = F.when(F.col("model_id") == model_id, F.try_element_at("_p", F.lit(name))).otherwise(value)
        order.append(value.asc_nulls_last())
    order.append(F.asc("candidate_id"))
    picked = near.withColumn("_r", F.row_number().over(by_model.orderBy(*order))).where("_r = 1")
    return picked.drop("_r", "_p", "_near")


def freeze_selection(selected: DataFrame, split_hash: str, search_hash: str, path: str) -> None:
    """Record the choice once; a second freeze at the same place fails."""
    (selected.withColumns({"split_hash": F.lit(split_hash), "search_hash": F.lit(search_hash),
                           "test_gate": F.lit(True)})
     .coalesce(1).write.mode("errorifexists").parquet(path))


def open_test_gate(spark, path: str, split_hash: str, search_hash: str) -> DataFrame:
    """The frozen choice; refuses when split or search table have changed."""
    frozen = spark.read.parquet(path)
    bad = frozen.where(~F.col("test_gate") | (F.col("split_hash") != split_hash)
                       | (F.col("search_hash") != search_hash)).limit(1).count()
    if bad:
        raise RuntimeError("test gate is closed: split or search differs from the frozen choice")
    return frozen


def score_test(bench: Bench, selected: DataFrame, test: DataFrame, keep: list[str]) -> DataFrame:
    """Refit each choice on train and score the test rows."""
    parts = []
    for row in selected.select("model_id", "parameter_json").collect():  # one row per model
        rep, model, _ = bench.fit(row["model_id"], json.loads(row["parameter_json"]))
        scored = score(model, rep.vectors(test), [bench.key, bench.label, *keep])
        parts.append(scored.withColumn("model_id", F.lit(row["model_id"])))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def repeat_check(fit_and_score: Callable[[], DataFrame], key: list[str], tol: float = 1e-9) -> DataFrame:
    """Run twice and compare labels and probabilities."""
    a, b = fit_and_score(), fit_and_score()
    second = b.select(*key, F.col("score").alias("_s"), F.col("predicted").alias("_p"))
    both = a.select(*key, "score", "predicted").join(second, key, "full")
    diff = F.coalesce(F.abs(F.col("score") - F.col("_s")), F.lit(float("inf")))
    return both.agg(F.count(F.lit(1)).alias("rows"), F.max(diff).alias("max_abs_diff"),
                    F.count_if(~F.col("predicted").eqNullSafe(F.col("_p"))).alias("label_changes"),
                    (F.max(diff) <= tol).alias("within"))


def save_model(model: PipelineModel | Transformer, root: str, regime: str, model_id: str, role: str = "model") -> str:
    path = f"{root}/{regime}/{model_id}/{role}"
    model.write().save(path)
    return path


def load_model(loader, root: str, regime: str, model_id: str, role: str = "model"):
    return loader.load(f"{root}/{regime}/{model_id}/{role}")


REGISTRY = "regime string, model_id string, role string, path string, files long, digest string"


def tree_digest(spark: SparkSession, path: str) -> tuple[int, str]:
    """Number of files of a saved model, and one SHA-256 over their sorted names and digests.

    A model's files are few; their bytes are hashed where they are read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    # names below the model's own folder, so that a moved model keeps its digest
    name = F.element_at(F.split("path", f"/{re.escape(path.rstrip('/').rsplit('/', 1)[-1])}/", 2), -1)
    lines = files.select(F.concat_ws("  ", F.sha2("content", 256), name).alias("line"))
    row = lines.agg(F.count(F.lit(1)), F.sha2(F.array_join(F.sort_array(F.collect_list("line")), "\n"), 256)).first()
    return row[0], row[1]


def register_model(model: PipelineModel | Transformer, root: str, regime: str, model_id: str, role: str = "model") -> str:
    """Save a model, then append its place and digest to the registry; the row comes last, so it never names half a model."""
    spark = SparkSession.active()
    path = save_model(model, f"{root}/models", regime, model_id, role)
    row = (regime, model_id, role, path, *tree_digest(spark, path))
    spark.createDataFrame([row], REGISTRY).coalesce(1).write.mode("append").parquet(f"{root}/registry")
    return path


def load_registered(loader, root: str, regime: str, model_id: str, role: str = "model"):
    """The registered model; refuses an unknown or repeated entry and files that are not those saved."""
    spark = SparkSession.active()
    rows = spark.read.schema(REGISTRY).parquet(f"{root}/registry").where(
        (F.col("regime") == regime) & (F.col("model_id") == model_id) & (F.col("role") == role)).limit(2).collect()
    if len(rows) != 1:
        raise LookupError(f"{len(rows)} registered models: {regime}, {model_id}, {role}")
    if tree_digest(spark, rows[0]["path"]) != (rows[0]["files"], rows[0]["digest"]):
        raise RuntimeError(f"files of a registered model have changed: {rows[0]['path']}")
    return loader.load(rows[0]["path"])


def coefficient_table(model, features: list[str]) -> DataFrame:
    """(feature, feature_index, coefficient) of a fitted linear model."""
    spark = SparkSession.active()
    rows = [(f, i, float(v)) for i, (f, v) in enumerate(zip(features, model.coefficients.toArray()))]
    return spark.createDataFrame(rows, "feature string, feature_index int, coefficient double")


def with_partition(df: DataFrame, assignment: DataFrame, key: str) -> DataFrame:
    return df.join(assignment.select(key, "partition"), key, "inner")

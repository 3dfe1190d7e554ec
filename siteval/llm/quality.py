"""Quality scores by Bradley-Terry ranking of preference pairs.

Labelled documents give pairs (a good document, a bad one).  A document's
strength is linear in features of its text; the logistic loss on feature
differences fits the weights.  The raw strength at the quantile that the
share of bad documents marks becomes the score ``at_quantile``; other scores
follow from the strength's distance to it on the logistic scale.

Learning uses every labelled row outside the held-out fold, each in at least
one pair; features are taken where the texts lie, and only they meet the
labels.  Ids with contradicting labels teach nothing.  Without both labels
every score is 0.5.  Null texts are empty; every text is scored whole; rows of null or
repeated ids are kept row by row; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteval.functions.hashing import h60
from siteval.llm.common import map_texts, packed, text_of, written
from siteval.operators.ranking import hash_ordinal, numeric_prefix

OPPONENTS = 8
FOLDS = 5
AT_QUANTILE = 0.3
SLACK = 0.0

_LETTERS = np.zeros(256)
_LETTERS[[*range(65, 91), *range(97, 123)]] = 1
_UPPER = np.zeros(256)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256)
_DIGIT[48:58] = 1
_STOP = np.zeros(256)
_STOP[[ord(c) for c in ".,;:?"]] = 1
_BANG = np.zeros(256)
_BANG[ord("!")] = 1
_PIPE = np.zeros(256)
_PIPE[ord("|")] = 1
_SIGN = np.zeros(256)
_SIGN[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:?!|"]] = 1
_HIGH = np.zeros(256)
_HIGH[128:] = 1
_CLASSES = np.stack([_LETTERS, _UPPER, _DIGIT, _STOP, _BANG, _PIPE, _SIGN, _HIGH])


def features(text: str) -> list[float]:
    """Shape of a text: length, character shares, repetition."""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    n = len(raw)
    counts = np.bincount(raw, minlength=256)
    letters, upper, digit, stop, bang, pipe, sign, high = (_CLASSES @ counts) / max(n, 1)
    p = counts[counts > 0] / max(n, 1)
    entropy = float(-(p * np.log2(p)).sum()) if n else 0.0
    words = text.split()
    m = len(words)
    distinct = len(set(words))
    runs = sum(map(str.__eq__, words, words[1:])) / max(1, m - 1)
    lines = text.split("\n")
    repeated = 1 - sum(map(len, set(lines))) / max(1, sum(map(len, lines)))
    doubled = float(np.count_nonzero((raw[1:] == raw[:-1]) & (_SIGN[raw[1:]] > 0))) / max(1, m)
    variety = math.log1p(distinct) / math.log1p(m) if m else 0.0
    return [
        math.log1p(n), math.log1p(m), min(n / max(1, m), 30.0), upper / max(letters, 1e-9) if letters else 0.0,
        math.sqrt(digit), math.sqrt(stop), math.sqrt(bang), math.sqrt(pipe), math.sqrt(sign), sign, high, entropy,
        variety, runs, math.sqrt(runs), repeated, math.sqrt(repeated), min(doubled, 3.0), float(n == 0),
    ]


N_FEATURES = len(features(""))


def _held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(False))


def quantile(values: DataFrame, share: float, n: int) -> float:
    """The exact quantile of ``_v`` over n rows, between neighbours linearly."""
    run = numeric_prefix(values.groupBy("_v").agg(F.count(F.lit(1)).alias("_m")), [], "_v", {"_upto": "_m"})
    at = share * (n - 1)
    low, high = run.agg(*[F.min(F.when(F.col("_upto") > k, F.col("_v"))) for k in (math.floor(at), math.ceil(at))]).first()
    return low + (high - low) * (at - math.floor(at))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
          opponents: int = OPPONENTS, at_quantile: float = AT_QUANTILE) -> dict | None:
    """Weights and threshold from all labelled rows outside the held-out fold."""
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~_held_out(id_col))
    marks = marks.groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_y"), F.max(label_col).alias("_top"))
    marks = marks.where("_y = _top").select("_id", "_y")
    rows = docs.where(F.col(id_col).isNotNull() & ~_held_out(id_col)).select(F.col(id_col).alias("_id"), text_of().alias("_text"))
    rows = map_texts(rows, ["_id"], "_x array<double>", lambda: lambda texts: [[features(t) for t in texts]])
    rows = rows.join(marks, "_id").withColumn("_tie", F.struct("_id", "_x"))
    rows = written(rows, "quality-rows")
    # each class in the order of a hash, as positions for the pairs
    rows = written(hash_ordinal(rows, ["_y"], h60("turn", F.col("_id")), "_tie", "_i", None).drop("_tie"), "quality-turns")
    stats = rows.select("_y", F.posexplode("_x")).groupBy("pos").agg(
        F.avg("col").alias("m"), F.stddev_pop("col").alias("s")).orderBy("pos").collect()
    shares = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_y"), F.lit(0)).alias("good")).first()
    good, bad = shares["good"], shares["n"] - shares["good"]
    if not good or not bad:
        return None
    mean = [r["m"] for r in stats]
    scale = [r["s"] if r["s"] > 1e-9 else 1.0 for r in stats]
    z = F.transform(F.arrays_zip(F.col("_x"), F.array(*map(F.lit, mean)).alias("m"), F.array(*map(F.lit, scale)).alias("s")),
                    lambda v: (v["_x"] - v["m"]) / v["s"])
    numbered = rows.select("_y", z.alias("_z"), "_i")
    few, many = (0, bad) if bad <= good else (1, good)
    more = good + bad - many
    # enough rounds that every document of the larger class has its turn
    rounds = min(max(opponents, -(-more // many)), more)
    one = numbered.where(F.col("_y") == few).select(F.col("_z").alias("_a"), F.col("_i").alias("_k"), F.explode(
        F.sequence(F.lit(0), F.lit(rounds - 1))).alias("_r"))
    one = one.withColumn("_i", (F.col("_k") * rounds + F.col("_r")) % more)
    other = numbered.where(F.col("_y") == 1 - few).select(F.col("_z").alias("_b"), "_i")
    win = F.zip_with("_b", "_a", lambda x, y: x - y) if few == 0 else F.zip_with("_a", "_b", lambda x, y: x - y)
    flip = (F.col("_k") + F.col("_r")) % 2
    pairs = one.join(other, "_i").select(win.alias("_d"), flip.cast("double").alias("label"))
    pairs = pairs.select("label", array_to_vector(F.transform(
        "_d", lambda v: F.when(F.col("label") == 1, v).otherwise(-v))).alias("features"))
    fitted = LogisticRegression(fitIntercept=False, regParam=1e-4, standardization=False, maxIter=200).fit(pairs)
    weights = fitted.coefficients.toArray() / np.array(scale)
    shift = float(weights @ np.array(mean))
    raw = F.aggregate(F.zip_with("_x", F.array(*map(F.lit, weights.tolist())), lambda x, w: x * w), F.lit(0.0),
                      lambda a, v: a + v) - shift
    edge = quantile(rows.select(raw.alias("_v")), bad / (good + bad), good + bad)
    return {"weights": weights.tolist(), "threshold": edge + shift, "at": at_quantile}


def score(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc id, held_out, score and predicted of every whole text."""
    rows = docs.select(F.col(id_col), _held_out(id_col).alias("held_out"), text_of(text_col).alias("_text"))
    scored = map_texts(rows, [id_col, "held_out"], "score double", lambda: lambda texts: [scores(texts, model)])
    at = model["at"] if model else AT_QUANTILE
    return scored.withColumn("predicted", F.when(F.col("score") >= at, 1).otherwise(0))


def scores(texts: list[str], model: dict | None) -> np.ndarray:
    if not len(texts):
        return np.zeros(0)
    if model is None:
        return np.full(len(texts), 0.5)
    x = np.array([features(t) for t in texts])
    away = x @ np.array(model["weights"]) - model["threshold"] + math.log(model["at"] / (1 - model["at"]))
    return 1 / (1 + np.exp(-np.clip(away, -500, 500)))


def keep_good(docs: DataFrame, model: dict | None, text_col: str = "text") -> DataFrame:
    """The rows, with all columns, that the model does not reject."""
    at = model["at"] if model else AT_QUANTILE
    rows = packed(docs, _text=text_of(text_col))
    rated = map_texts(rows, ["_row"], "_score double", lambda: lambda texts: [scores(texts, model)])
    return rated.where(F.col("_score") >= at).select("_row.*")

"""Confusion- and rank-based metrics over prediction tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteval.functions.stats import confusion_cells, confusion_metrics, ratio
from siteval.operators.ranking import average_rank, numeric_prefix

THRESHOLD = 0.5


def with_prediction(df: DataFrame, score: str = "score", out: str = "predicted") -> DataFrame:
    return df.withColumn(out, (F.col(score) >= THRESHOLD).cast("int"))


def confusion(pred: DataFrame, by: list[str], label: str = "label", predicted: str = "predicted") -> DataFrame:
    cells = confusion_cells(F.col(label), F.col(predicted))
    return pred.groupBy(*by).agg(*[c.alias(n) for n, c in cells.items()])


def threshold_metrics(cells: DataFrame) -> DataFrame:
    return cells.withColumns(confusion_metrics("tn", "fp", "fn", "tp"))


def score_groups(pred: DataFrame, by: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """Tied scores as one row: positives, negatives and totals."""
    return pred.groupBy(*by, score).agg(
        F.sum(label).cast("bigint").alias("pos"),
        (F.count(F.lit(1)) - F.sum(label)).cast("bigint").alias("neg"),
        F.count(F.lit(1)).alias("tot"))


def score_group_ordinals(pred: DataFrame, by: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """0-based number of each score group, highest score first."""
    groups = score_groups(pred, by, label, score).withColumn("_one", F.lit(1).cast("bigint"))
    numbered = numeric_prefix(groups, by, score, {"score_group": "_one"}, descending=True)
    return numbered.withColumn("score_group", F.col("score_group") - 1).drop("_one")


def running_rank_counts(groups: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """Running positives, negatives and totals from the highest score down."""
    return numeric_prefix(groups, by, score, {"cum_pos": "pos", "cum_neg": "neg", "cum_tot": "tot"},
                          descending=True)


def areas(running: DataFrame, by: list[str]) -> DataFrame:
    """Average precision and ROC area from running counts (ties count half)."""
    pos, neg = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    hits = F.sum(F.when(F.col("cum_tot") > 0, F.col("cum_pos") / F.col("cum_tot") * F.col("pos")).otherwise(0.0))
    above = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2))
    return running.groupBy(*by).agg(
        ratio(hits, pos, None).alias("pr_auc"),
        ratio(pos * neg - above, pos * neg, None).alias("roc_auc"))


def rank_metrics(pred: DataFrame, by: list[str], label: str = "label", score: str = "score") -> DataFrame:
    return areas(running_rank_counts(score_groups(pred, by, label, score), by, score), by)


def classification_metrics(pred: DataFrame, by: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """All metrics per experiment: one row per value of ``by``."""
    cells = threshold_metrics(confusion(with_prediction(pred, score, "_z"), by, label, "_z"))
    ranks = rank_metrics(pred, by, label, score)
    if by:
        return cells.join(ranks, by, "inner")
    return cells.withColumns({m: ranks.select(m).scalar() for m in ("pr_auc", "roc_auc")})


def error_rates(cells: DataFrame) -> DataFrame:
    """False positives among negatives and false negatives among positives."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return cells.withColumns({"fp_rate": ratio(fp, tn + fp), "fn_rate": ratio(fn, fn + tp)})


def spearman(df: DataFrame, a: str, b: str, absolute: bool = False) -> DataFrame:
    """Rank correlation of two columns, ties sharing their mean rank."""
    va, vb = (F.abs(F.col(c)) if absolute else F.col(c) for c in (a, b))
    ranked = average_rank(average_rank(df, va, "_ra"), vb, "_rb")
    return ranked.agg(F.corr("_ra", "_rb").alias("spearman"))

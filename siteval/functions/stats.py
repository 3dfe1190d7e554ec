"""Metric formulas over confusion cells, and number formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column, default: float | None = 0.0) -> Column:
    """num/den, with ``default`` where the denominator is zero."""
    safe = F.when(den != 0, num / den)
    return safe if default is None else F.coalesce(safe, F.lit(float(default)))


def confusion_cells(label: Column, predicted: Column) -> dict[str, Column]:
    def cell(y, z):
        return F.sum(F.when((label == y) & (predicted == z), 1).otherwise(0)).cast("bigint")

    return {"tn": cell(0, 0), "fp": cell(0, 1), "fn": cell(1, 0), "tp": cell(1, 1)}


def confusion_metrics(tn, fp, fn, tp, default: float | None = 0.0) -> dict[str, Column]:
    """Threshold metrics; ``default=None`` leaves undefined values NULL."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in (tn, fp, fn, tp))
    spread = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    recall, specificity = ratio(tp, tp + fn, default), ratio(tn, tn + fp, default)
    positive_f1 = ratio(2 * tp, 2 * tp + fp + fn, default)
    negative_f1 = ratio(2 * tn, 2 * tn + fp + fn, default)
    return {
        "mcc": ratio(tp * tn - fp * fn, spread, default),
        "precision": ratio(tp, tp + fp, default),
        "recall": recall,
        "specificity": specificity,
        "fpr": ratio(fp, tn + fp, default),
        "balanced_accuracy": (recall + specificity) / 2,
        "macro_f1": (positive_f1 + negative_f1) / 2,
    }


def label_to_int(label: Column) -> Column:
    """'phishing' or '1' is the positive class, anything else is not."""
    return F.when(F.lower(F.trim(label.cast("string"))).isin("phishing", "1"), 1).otherwise(0)


def recode_polarity(label: Column) -> Column:
    """0.0-is-positive coding to 1-is-positive; other values become NULL."""
    return F.when(label == 0, 1).when(label == 1, 0)


def display_pct(value: Column) -> Column:
    return F.when(F.abs(value) <= 1, value * 100).otherwise(value)


def split_interval(text: Column) -> tuple[Column, Column]:
    """``[lo, hi]`` as two doubles, NULL where the text has no interval."""
    pattern = r"\[([^,]+), ([^\]]+)\]"
    return _number(text, pattern, 1), _number(text, pattern, 2)


def _number(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("double")


def fixed(value: Column, digits: int = 3) -> Column:
    """Text with a fixed number of decimals, halves to even; NULL stays NULL."""
    text = F.format_string(f"%.{digits}f", F.bround(value.cast("double"), digits))
    return F.when(value.isNotNull(), text)


def mean_sd_text(mean: Column, sd: Column) -> Column:
    return F.concat(fixed(mean), F.lit(" ± "), fixed(sd))

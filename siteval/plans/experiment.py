"""One executor for every regime, cap variant and ablation.

Stage one sees train and validation rows only and freezes its choice; stage
two opens the test rows only when split and search still match the record.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteval.functions.features import ablation_features
from siteval.operators import integrity as I
from siteval.operators import models as M
from siteval.operators.metrics import classification_metrics
from siteval.operators.ranking import checkpointed
from siteval.operators.splits import apply_cap


@dataclass
class Result:
    search: DataFrame
    selected: DataFrame
    predictions: DataFrame
    metrics: DataFrame


def split_hash(rows: DataFrame, key: str) -> str:
    return I.fingerprint(rows, key, ["partition"]).first()["fingerprint"]


def search_hash(results: DataFrame) -> str:
    scored = results.select("candidate_id", "parameter_json", F.round("mcc", 12).alias("mcc"))
    return I.fingerprint(scored, "candidate_id", ["parameter_json", "mcc"]).first()["fingerprint"]


def run_experiment(rows: DataFrame, path: str, regime: str, seed: int, variant: str = "UNCAPPED",
                   grids: dict | None = None, capped: DataFrame | None = None, ablation: str | None = None,
                   features: list[str] | None = None, key: str = "record_id", label: str = "label",
                   text: str = "raw_url", keep: tuple[str, ...] = (), tie: str = "fail", min_df: int = 5) -> Result:
    """``rows`` carry ``partition``, the features and the text.

    ``capped`` (a table of kept keys) filters the frozen split; ``ablation``
    names the feature set; ``path`` is a new folder for the frozen choice.
    """
    if capped is not None:
        rows = apply_cap(rows, capped, key)
    cols = features or ablation_features(ablation)
    part = {p: rows.where(F.col("partition") == p) for p in ("train", "validation", "test")}
    with M.Bench(part["train"], part["validation"], key, label, text, cols, min_df) as bench:
        results = M.search(bench, grids or M.GRIDS)
        selected = M.select_best(results, tie=tie)
        record = f"{path}/{regime}_{seed}_{variant}_{ablation or 'FULL'}"
        M.freeze_selection(selected, split_hash(rows, key), search_hash(results), record)

        chosen = M.open_test_gate(rows.sparkSession, record, split_hash(rows, key), search_hash(results))
        predictions = M.score_test(bench, chosen, part["test"], list(keep))
        tags = {"regime": F.lit(regime), "split_seed": F.lit(seed), "variant": F.lit(variant),
                "feature_set": F.lit(ablation or "FULL")}
        # written out, because the bench's vectors go
        predictions = checkpointed(predictions.withColumns(tags))
    metrics = classification_metrics(predictions, [*tags, "model_id"], label)
    return Result(results, chosen, predictions, metrics)


def run_ablation(rows: DataFrame, path: str, ablation: str, baseline: DataFrame, seed: int, **kwargs) -> DataFrame:
    """Fresh selection without the ablated features, with the change against ``baseline``."""
    out = run_experiment(rows, path, "C", seed, ablation=ablation, tie="capacity", **kwargs)
    full = baseline.select("model_id", F.col("mcc").alias("full_mcc"))
    # one row per model on both sides
    return (out.metrics.select("feature_set", "model_id", "mcc").join(full, "model_id", "left")
            .withColumn("delta_mcc", F.col("mcc") - F.col("full_mcc")))

"""Checks, reconciliation and registry tables.  Status is always computed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteval.functions.hashing import digest
from siteval.functions.stats import fixed, mean_sd_text, split_interval

PASS, FAIL = "PASS", "FAIL"


def run_checks(df: DataFrame, checks: dict[str, tuple[str, Column]]) -> DataFrame:
    """One aggregate pass; ``checks`` maps id → (requirement, violation count)."""
    wide = df.agg(*[v.cast("bigint").alias(k) for k, (_, v) in checks.items()])
    rows = F.explode(F.array(*[
        F.struct(F.lit(k).alias("check_id"), F.lit(r).alias("requirement"), F.col(k).alias("violations"))
        for k, (r, _) in checks.items()])).alias("x")
    return wide.select(rows).select("x.*", F.when(F.col("x.violations") == 0, PASS).otherwise(FAIL).alias("status"))


def check_unique(df: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows, distinct keys and repeated keys, by counting per key."""
    keys = [key] if isinstance(key, str) else key
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
    return per.agg(F.sum("c").alias("rows"), F.count(F.lit(1)).alias("keys"),
                   F.count_if(F.col("c") > 1).alias("repeated_keys"),
                   (F.count_if(F.col("c") > 1) == 0).alias("unique"))


def same_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Ids missing on either side (with multiplicity) and whether the sets agree."""
    left, right = a.select(key), b.select(key)
    count = lambda x, y: x.exceptAll(y).agg(F.count(F.lit(1)))
    return count(left, right).toDF("only_left").withColumn("only_right", count(right, left).scalar()).withColumn(
        "equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def check_partitions(df: DataFrame, corpus: DataFrame, key: str, expected: dict[str, int] | None = None,
                     partition: str = "partition") -> DataFrame:
    """Every corpus row in exactly one known partition, optionally with expected counts."""
    per = df.groupBy(key).agg(F.countDistinct(partition).alias("p"), F.count(F.lit(1)).alias("c"))
    joined = corpus.select(key).distinct().withColumn("_c", F.lit(1)).join(
        per.withColumn("_p", F.lit(1)), key, "full")
    base = run_checks(joined, {
        "exclusive": ("a row has one partition", F.count_if(F.col("p") > 1)),
        "single": ("a row occurs once", F.count_if(F.col("c") > 1)),
        "complete": ("every corpus row is assigned", F.count_if(F.col("_p").isNull())),
        "closed": ("no row from outside the corpus", F.count_if(F.col("_c").isNull())),
    })
    if not expected:
        return base
    sizes = run_checks(df, {
        f"count_{p}": (f"{n} rows in {p}", F.abs(F.count_if(F.col(partition) == p) - n)) for p, n in expected.items()})
    return base.unionByName(sizes)


def check_disjoint(overlap: DataFrame) -> DataFrame:
    """Pairwise shared keys (see ``key_overlap``) as named checks."""
    pairs = [c for c in overlap.columns if "_" in c]
    return run_checks(overlap, {p: (f"no key shared by {p.replace('_', ' and ')}", F.sum(p)) for p in pairs})


def check_totals(cells: DataFrame, total: str, tol: float = 1e-9) -> DataFrame:
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    precision = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    return run_checks(cells, {
        "cells_sum": ("confusion cells sum to the rows", F.count_if(n != F.col(total))),
        "precision": ("precision equals TP/(TP+FP)", F.count_if(F.abs(F.col("precision") - precision) > tol)),
    })


def check_finite(df: DataFrame, cols: list[str]) -> DataFrame:
    """Values that are missing, NaN or infinite, per column."""
    def bad(c: str) -> Column:
        v = F.col(c).cast("double")
        return F.count_if(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))

    return run_checks(df, {c: ("all values finite", bad(c)) for c in cols})


def fingerprint(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Order-free content hash of a keyed table.

    Row hashes are combined in 16 million hash buckets, those in 4,096 and
    those in one: no group ever holds more than a small part of the rows.
    """
    row = digest(F.col(key), *[F.col(c) for c in cols])
    level = df.select(row.alias("h")).groupBy(F.substring("h", 1, 6).alias("b")).agg(
        F.sha2(F.concat_ws("", F.sort_array(F.collect_list("h"))), 256).alias("h"), F.count(F.lit(1)).alias("n"))

    def combined():
        pairs = F.sort_array(F.collect_list(F.struct("b", "h")))
        return F.sha2(F.concat_ws("", F.transform(pairs, lambda p: p["h"])), 256)

    level = level.groupBy(F.substring("b", 1, 3).alias("p")).agg(combined().alias("h"), F.sum("n").alias("n"))
    return level.withColumnRenamed("p", "b").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), combined().alias("fingerprint"))


def verify_hashes(observed: DataFrame, expected: DataFrame, key: str = "path") -> DataFrame:
    """Observed against expected digest per artifact."""
    both = expected.select(key, F.col("sha256").alias("expected")).join(
        observed.select(key, F.col("sha256").alias("observed")), key, "left")
    return both.withColumn("status", F.when(F.col("expected") == F.col("observed"), PASS).otherwise(FAIL))


def provenance(outputs: DataFrame, sources: DataFrame, links: DataFrame) -> DataFrame:
    """Output → source rows with both hashes; ``links`` has (output, source) paths."""
    o = outputs.select(F.col("path").alias("output"), F.col("sha256").alias("output_sha256"))
    s = sources.select(F.col("path").alias("source"), F.col("sha256").alias("source_sha256"))
    return links.join(o, "output", "left").join(s, "source", "left")


def result_manifest(inventory: DataFrame, questions: DataFrame, order: list[str], prefix: str = "R") -> DataFrame:
    """One row per result: ordinal id, question of its phase, interval columns."""
    from siteval.operators.ranking import ordinal
    lower, upper = split_interval(F.col("uncertainty"))
    kind = (F.when(F.coalesce(F.trim("uncertainty"), F.lit("")) == "", "NONE")
            .when(lower.isNotNull(), "INTERVAL").otherwise(F.col("uncertainty")))
    # the phase → question table is part of the report's definition
    rows = inventory.join(F.broadcast(questions), "phase", "left")
    rows = ordinal(rows, [F.col(c) for c in order], "_i")
    return rows.withColumns({
        "result_id": F.format_string(f"{prefix}%04d", F.col("_i") + 1),
        "uncertainty_lower": lower, "uncertainty_upper": upper, "uncertainty_type": kind}).drop("_i", "uncertainty")


def registry(results: list[DataFrame], columns: list[str]) -> DataFrame:
    """Experiment outputs as one table with a fixed set of columns."""
    out = None
    for df in results:
        row = df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])
        out = row if out is None else out.unionByName(row)
    return out


# ---------------------------------------------------------------- publication tables

def table_site_counts(accounts: dict[str, DataFrame]) -> DataFrame:
    """T1: site counts per grouping."""
    out = None
    for name, df in accounts.items():
        row = df.select(F.lit(name).alias("grouping"), "negative_sites", "positive_sites",
                        "union_sites", "intersection_sites")
        out = row if out is None else out.unionByName(row)
    return out


def table_exposure(exposure: DataFrame, regime: str) -> DataFrame:
    """T3: seen-site percentages per variant, one column per regime and class."""
    cells = [F.max(F.when((F.col(regime) == r) & (F.col("class") == c), fixed(F.col("site_seen_pct"), 1)))
             .alias(f"{r}_{n}") for r in ("A", "C") for c, n in (("0", "negative"), ("1", "positive"))]
    return exposure.groupBy("variant").agg(*cells)


def table_mcc(seeds: DataFrame, gaps: DataFrame) -> DataFrame:
    """T5: ``mean ± SD`` per regime with the difference and its interval."""
    text = mean_sd_text(F.col("mean"), F.col("sample_sd"))
    wide = seeds.groupBy("model").agg(*[
        F.max(F.when(F.col("regime") == r, text)).alias(f"{r}_mcc") for r in ("A", "C")])
    interval = F.concat(F.lit("["), fixed(F.col("lower")), F.lit(", "), fixed(F.col("upper")), F.lit("]"))
    return wide.join(gaps.select("model", fixed(F.col("difference")).alias("difference"),
                                 interval.alias("interval")), "model", "left")


def table_fixed(df: DataFrame, keys: list[str], values: list[str], digits: int = 3) -> DataFrame:
    """T6, T7, T8: keys with values printed to a fixed number of decimals."""
    return df.select(*keys, *[fixed(F.col(v), digits).alias(v) for v in values])


def table_errors(summary: DataFrame) -> DataFrame:
    """T9: FP and FN counts with percentages to one decimal."""
    keys = [c for c in ("regime", "model") if c in summary.columns]
    return summary.select(*keys, F.col("fp").alias("fp_count"), F.col("fn").alias("fn_count"),
                          fixed(F.col("fp_rate") * 100, 1).alias("fp_pct"),
                          fixed(F.col("fn_rate") * 100, 1).alias("fn_pct"))


def table_hashes(verified: DataFrame) -> DataFrame:
    """T10: artifacts with digest and computed status."""
    return verified.select("path", F.col("observed").alias("sha256"),
                           F.when(F.col("status") == PASS, "VERIFIED").otherwise("MISMATCH").alias("status"))

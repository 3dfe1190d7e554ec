"""Corpus profiles: validity, duplicates, multiplicity, concentration, disparity.

Group sizes are reduced to a histogram (size, number of groups) before any
ordering.  A table of N rows has at most about sqrt(2 N) different sizes, so
percentiles, Gini and coverage never order the groups themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteval.functions.hashing import digest
from siteval.functions.stats import ratio
from siteval.operators.joins import skew_join
from siteval.operators.ranking import first_per_group


def _n() -> Column:
    return F.count(F.lit(1))


# ---------------------------------------------------------------- validity and duplicates

def validity_profile(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy("parse_status", label).agg(_n().alias("rows"))


def key_profile(df: DataFrame, key: str, label: str, source: str, site: str) -> DataFrame:
    """Rows and distinct values per URL key.

    A URL has one site and few labels and sources, so a key's values are small
    sets; rows meet by key first, so each is exchanged once and not once for
    every distinct count.
    """
    def distinct(col: str) -> Column:
        return F.size(F.collect_set(col)).cast("bigint")

    return df.select(key, *dict.fromkeys([label, source, site])).repartition(key).groupBy(key).agg(
        _n().alias("rows"), distinct(label).alias("labels"), distinct(source).alias("sources"), distinct(site).alias("sites"))


def duplicate_groups(df: DataFrame, key: str, label: str, source: str, site: str) -> DataFrame:
    return key_profile(df, key, label, source, site).where("rows > 1")


def duplicate_summary(df: DataFrame, key: str, label: str) -> DataFrame:
    per_key = df.groupBy(key).agg(_n().alias("rows"), F.min(label).alias("lo"), F.max(label).alias("hi"))
    total, unique = F.sum("rows"), F.count(key)
    return per_key.agg(
        total.alias("total_rows"), unique.alias("unique_keys"),
        (total - unique).alias("beyond_first"),
        ratio((total - unique) * 100.0, total).alias("duplicate_pct"),
        F.count_if(F.col("lo") < F.col("hi")).alias("cross_label_keys"))


def conflict_rows(df: DataFrame, key: str, label: str) -> DataFrame:
    """Rows of keys that carry both labels."""
    keys = (df.groupBy(key).agg(F.min(label).alias("lo"), F.max(label).alias("hi"))
            .where("lo < hi").select(key))
    return skew_join(df, keys, key, "left_semi")


def mixed_groups(df: DataFrame, key: str, label: str, source: str) -> DataFrame:
    return (df.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key)
            .agg(_n().alias("rows"), F.sum(label).alias("positives"),
                 F.countDistinct(source).alias("sources"), F.min(label).alias("lo"), F.max(label).alias("hi"))
            .where("lo < hi").drop("lo", "hi"))


# ---------------------------------------------------------------- group sizes

def group_counts(df: DataFrame, key: str, by: list[str], hashed: bool = True) -> DataFrame:
    """Rows per group, the key published as a hash."""
    counts = df.groupBy(*by, key).agg(_n().alias("rows"))
    return counts.withColumn(key, digest(F.col(key))) if hashed else counts


def size_histogram(df: DataFrame, key: str, by: list[str]) -> DataFrame:
    """(by, size, groups): how many groups have each size."""
    return (df.groupBy(*by, key).agg(_n().alias("size"))
            .groupBy(*by, "size").agg(_n().alias("groups")))


def _strata(by: list[str]):
    return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))


def multiplicity_from(hist: DataFrame, by: list[str], floors=(2, 5, 10, 50, 100)) -> DataFrame:
    size, groups = F.col("size"), F.col("groups")
    pct = F.percentile(size, F.array(*[F.lit(p) for p in (.5, .75, .9, .95)]), groups)
    out = hist.groupBy(*by).agg(
        F.sum(size * groups).alias("urls"), F.sum(groups).alias("sites"),
        pct.alias("_p"), F.max("size").alias("max"),
        F.sum(F.when(size == 1, groups).otherwise(0)).alias("sites_eq_1"),
        *[F.sum(F.when(size >= k, groups).otherwise(0)).alias(f"sites_ge_{k}") for k in floors])
    cols = {"mean": F.col("urls") / F.col("sites")}
    cols.update({name: F.col("_p")[i] for i, name in enumerate(("median", "p75", "p90", "p95"))})
    return out.withColumns(cols).drop("_p")


def multiplicity(df: DataFrame, key: str, by: list[str], host: str) -> DataFrame:
    """URLs-per-group summary per class, with the number of hosts."""
    hosts = df.groupBy(*by).agg(F.countDistinct(host).alias("hosts"))
    return multiplicity_from(size_histogram(df, key, by), by).join(hosts, by, "inner")


def _ranked(hist: DataFrame, by: list[str], descending: bool) -> DataFrame:
    """Groups and rows that come before each size."""
    order = F.col("size").desc() if descending else F.col("size").asc()
    before = _strata(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    return hist.withColumns({
        "groups_before": F.coalesce(F.sum("groups").over(before), zero),
        "rows_before": F.coalesce(F.sum(F.col("size") * F.col("groups")).over(before), zero),
        "n_groups": F.sum("groups").over(_strata(by)),
        "n_rows": F.sum(F.col("size") * F.col("groups")).over(_strata(by))})


def gini(df: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Gini coefficient of group sizes per stratum."""
    return gini_from(size_histogram(df, key, by), by)


def gini_from(hist: DataFrame, by: list[str]) -> DataFrame:
    g, r = F.col("groups").cast("double"), F.col("groups_before").cast("double")
    # ranks r+1 .. r+g all carry the same size
    weighted = F.sum(F.col("size") * (g * r + g * (g + 1) / 2))
    n, total = F.max("n_groups"), F.max("n_rows")
    value = 2 * weighted / (n * total) - (n + 1) / n
    return _ranked(hist, by, False).groupBy(*by).agg(F.when(total > 0, value).alias("gini"))


def groups_to_cover(df: DataFrame, key: str, by: list[str], shares=(.5, .9)) -> DataFrame:
    return cover_from(size_histogram(df, key, by), by, shares)


def cover_from(hist: DataFrame, by: list[str], shares=(.5, .9)) -> DataFrame:
    """Fewest groups, largest first, that hold a share of the rows."""
    def needed(share: float) -> Column:
        target = F.col("n_rows") * share
        open_rows = target - F.col("rows_before")
        inside = F.col("size") * F.col("groups") >= open_rows
        rank = F.col("groups_before") + F.greatest(F.ceil(open_rows / F.col("size")), F.lit(1))
        return F.min(F.when(inside & (open_rows > 0), rank))

    return _ranked(hist, by, True).groupBy(*by).agg(
        *[needed(s).cast("bigint").alias(f"cover_{int(s * 100)}") for s in shares])


def topk_share(df: DataFrame, key: str, by: list[str], ks=(1, 10, 100)) -> DataFrame:
    return topk_from(size_histogram(df, key, by), by, ks)


def topk_from(hist: DataFrame, by: list[str], ks=(1, 10, 100)) -> DataFrame:
    def share(k: int) -> Column:
        taken = F.least(F.col("groups"), F.greatest(F.lit(k) - F.col("groups_before"), F.lit(0)))
        return F.sum(F.col("size") * taken) / F.max("n_rows")

    return _ranked(hist, by, True).groupBy(*by).agg(*[share(k).alias(f"top{k}_share") for k in ks])


def concentration(df: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Gini, coverage and top shares from one histogram."""
    hist = size_histogram(df, key, by)
    return (gini_from(hist, by).join(cover_from(hist, by), by, "inner")
            .join(topk_from(hist, by), by, "inner"))


def multiplicity_hist(df: DataFrame, key: str, by: list[str], clip: int = 50) -> DataFrame:
    hist = size_histogram(df, key, by)
    return (hist.groupBy(*by, F.least(F.col("size"), F.lit(clip)).alias("clipped_size"))
            .agg(F.sum("groups").alias("groups")))


# ---------------------------------------------------------------- exposure

def site_exposure(df: DataFrame, label: str, host: str, site: str, partition: str = "partition",
                  by: list[str] | None = None) -> DataFrame:
    """Share of test rows of each class whose host / site occurs in train.

    Rows are reduced to counts per (key, label) before anything is compared,
    so a site with a third of the rows is one count, not one task.
    """
    by = by or []
    test = F.col(partition) == "test"
    # one pass over the rows; both keys are compared from these counts
    pairs = df.groupBy(*by, site, host).agg(
        F.max(F.when(F.col(partition) == "train", 1).otherwise(0)).alias("in_train"),
        *[F.count_if(test & (F.col(label) == y)).alias(f"t{y}") for y in (0, 1)])

    def seen(key: str, name: str) -> DataFrame:
        per = pairs.groupBy(*by, key).agg(
            F.max("in_train").alias("in_train"), F.sum("t0").alias("t0"), F.sum("t1").alias("t1"))
        rows = per.select(*by, "in_train", F.explode(F.array(*[
            F.struct(F.lit(c).alias("class"), t.alias("t"))
            for c, t in (("all", F.col("t0") + F.col("t1")), ("0", F.col("t0")), ("1", F.col("t1")))
        ])).alias("x")).select(*by, "in_train", "x.*")
        hit = (F.col("in_train") == 1) & (F.col("t") > 0)
        return rows.groupBy(*by, "class").agg(
            F.sum("t").alias("test_rows"), F.sum(F.when(hit, F.col("t")).otherwise(0)).alias(f"{name}_seen_rows"),
            F.count_if(hit).alias(f"shared_{name}s"))

    joined = seen(site, "site").join(seen(host, "host").drop("test_rows"), [*by, "class"], "inner")
    return joined.withColumns({
        f"{n}_seen_pct": ratio(F.col(f"{n}_seen_rows") * 100.0, F.col("test_rows")) for n in ("site", "host")
    }).drop("site_seen_rows", "host_seen_rows")


# ---------------------------------------------------------------- structure and suffixes

def class_disparity(df: DataFrame, label: str, props: list[str]) -> DataFrame:
    """Mean of each property per class and their absolute difference."""
    means = df.agg(*[F.avg(F.when(F.col(label) == y, F.col(p).cast("double"))).alias(f"{p}__{y}")
                     for p in props for y in (0, 1)])
    rows = F.explode(F.array(*[
        F.struct(F.lit(p).alias("property"), F.col(f"{p}__1").alias("positive"), F.col(f"{p}__0").alias("negative"))
        for p in props])).alias("r")
    return means.select(rows).select("r.*").withColumn("abs_difference", F.abs(F.col("positive") - F.col("negative")))


def structural_profile(df: DataFrame, label: str, site: str, flags: list[str], numbers: list[str]) -> DataFrame:
    return df.groupBy(label).agg(
        _n().alias("rows"), F.countDistinct(site).alias("sites"),
        F.avg((F.coalesce(F.col("scheme"), F.lit("")) == "https").cast("double")).alias("https_rate"),
        *[F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(f"{c}_rate") for c in flags],
        *[F.avg(c).alias(f"{c}_mean") for c in numbers],
        *[F.median(c).alias(f"{c}_median") for c in numbers])


def suffix_by_class(df: DataFrame, suffix: str, label: str) -> DataFrame:
    counts = df.groupBy(label, suffix).agg(_n().alias("rows"))
    totals = F.sum("rows").over(Window.partitionBy(label))
    return counts.withColumn("class_total", totals).withColumn("share", F.col("rows") / F.col("class_total"))


def suffix_crosstab(df: DataFrame, suffix: str, label: str) -> DataFrame:
    wide = df.groupBy(suffix).agg(
        F.count_if(F.col(label) == 1).alias("positive"), F.count_if(F.col(label) == 0).alias("negative"))
    return wide.withColumn("total", F.col("positive") + F.col("negative")).withColumn(
        "positive_share", ratio(F.col("positive"), F.col("total")))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """Association of two categorical columns.

    Empty cells need no rows: chi2 = N (sum o^2/(row*col) - 1).
    """
    cells = df.groupBy(a, b).agg(_n().cast("double").alias("o"))
    rows, cols = cells.groupBy(a).agg(F.sum("o").alias("r")), cells.groupBy(b).agg(F.sum("o").alias("c"))
    joined = cells.join(rows, a, "inner").join(cols, b, "inner")
    n = F.sum("o")
    chi2 = n * (F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c"))) - 1)
    shape = F.least(F.countDistinct(a), F.countDistinct(b)) - 1
    return joined.agg(F.when(shape > 0, F.sqrt(chi2 / (n * shape))).alias("cramers_v"))


def template_overlap(df: DataFrame, template: str, site: str) -> DataFrame:
    """Templates used by more than one site and the rows they hold."""
    per = df.groupBy(template).agg(_n().alias("rows"), F.min(site).alias("lo"), F.max(site).alias("hi"))
    shared = F.col("lo") < F.col("hi")
    held = F.sum(F.when(shared, F.col("rows")).otherwise(0))
    return per.agg(_n().alias("templates"), F.count_if(shared).alias("shared_templates"),
                   held.alias("rows_in_shared"), ratio(held * 100.0, F.sum("rows")).alias("rows_in_shared_pct"))


def cross_site_templates(df: DataFrame, template: str, site: str, label: str) -> DataFrame:
    return df.groupBy(template).agg(
        _n().alias("rows"), F.countDistinct(site).alias("sites"), F.countDistinct(label).alias("labels")
    ).where("sites > 1")


# ---------------------------------------------------------------- grouping and inventory

def grouping_sensitivity(df: DataFrame, label: str = "label") -> DataFrame:
    changed = F.coalesce(F.col("site_key_icann") != F.col("site_key_private"), F.lit(True))
    mixed = lambda key: (df.groupBy(key).agg(F.min(label).alias("lo"), F.max(label).alias("hi"))
                         .agg(F.count_if(F.col("lo") < F.col("hi")).alias("m")).scalar())
    return df.agg(
        F.countDistinct("site_key_icann").alias("icann_sites"),
        F.countDistinct("site_key_private").alias("private_sites"),
        F.count_if(changed).alias("changed_rows"),
        ratio(F.count_if(changed) * 100.0, _n()).alias("changed_pct"),
        F.count_if(F.col("is_private_suffix")).alias("private_suffix_rows"),
    ).withColumns({"mixed_private_sites": mixed("site_key_private"), "mixed_hosts": mixed("hostname_ascii")})


def sites_per_parent(df: DataFrame) -> DataFrame:
    return (df.where(F.coalesce("site_key_icann", F.lit("")) != "").groupBy("site_key_icann")
            .agg(F.countDistinct("site_key_private").alias("private_sites")))


def inventory(df: DataFrame, label: str, distinct: list[str]) -> DataFrame:
    """Row count, missing labels, label counts as sorted JSON, distinct values."""
    counts = df.groupBy(F.coalesce(F.col(label).cast("string"), F.lit("missing")).alias("k")).agg(_n().alias("v"))
    text = counts.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v"))))).alias("j"))
    return df.agg(_n().alias("rows"), F.count_if(F.col(label).isNull()).alias("missing_labels"),
                  *[F.countDistinct(c).alias(f"distinct_{c}") for c in distinct]
                  ).withColumn("label_counts", text.scalar())


def time_range(df: DataFrame, cols: list[str]) -> DataFrame:
    ends = df.agg(*[f(F.to_timestamp(c)).alias(f"{n}_{c}") for c in cols for n, f in (("min", F.min), ("max", F.max))])
    rows = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"min_{c}").alias("first"), F.col(f"max_{c}").alias("last"))
        for c in cols])).alias("r")
    return ends.select(rows).select("r.*")


def top_values(df: DataFrame, col: str, n: int = 20, blank: str = "Other") -> DataFrame:
    value = F.when(F.coalesce(F.trim(F.col(col)), F.lit("")) == "", blank).otherwise(F.col(col))
    return (df.groupBy(value.alias(col)).agg(_n().alias("rows"))
            .orderBy(F.desc("rows"), F.asc(col)).limit(n))


def ledger_summary(ledger: DataFrame, site: str) -> DataFrame:
    def status(s):
        return F.count_if(F.col("status") == s)

    return ledger.agg(
        _n().alias("sites"), status("COMPLETED").alias("completed"), status("FAILED").alias("failed"),
        status("PENDING").alias("pending"),
        F.count_if((F.col("status") == "COMPLETED") & (F.col("records") > 0)).alias("sites_with_records"),
        F.coalesce(F.sum(F.when(F.col("status") == "COMPLETED", F.col("records"))), F.lit(0)).alias("candidates"),
        F.when(status("COMPLETED") == _n(), "COMPLETE").otherwise("INCOMPLETE").alias("state"))


def source_summary(df: DataFrame, by: list[str], site: str) -> DataFrame:
    return df.groupBy(*by).agg(F.countDistinct(site).alias("sites_with_results"), _n().alias("rows"))


def seed_summary(df: DataFrame, by: list[str], seed: str, value: str) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct(F.col(seed).alias("k"), F.col(value).alias("v"))))
    return df.groupBy(*by).agg(
        _n().alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sample_sd"),
        F.min(value).alias("min"), F.max(value).alias("max"),
        F.map_from_entries(pairs).alias("by_seed"))


def site_accounting(df: DataFrame, key: str, label: str) -> DataFrame:
    """Sites per class, in either class and in both."""
    per = (df.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key)
           .agg(F.max(F.when(F.col(label) == 0, 1).otherwise(0)).alias("n"),
                F.max(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p")))
    return per.agg(F.sum("n").alias("negative_sites"), F.sum("p").alias("positive_sites"),
                   _n().alias("union_sites"), F.count_if(F.expr("n = 1 AND p = 1")).alias("intersection_sites"))


def top_groups(df: DataFrame, key: str, label: str, n: int = 50) -> DataFrame:
    """Largest groups per class, published under a hash of the key."""
    counts = df.groupBy(key, label).agg(_n().alias("rows"))
    top = counts.orderBy(F.desc("rows"), F.asc(key), F.asc(label)).limit(n)
    return top.withColumn(key, digest(F.col(key)))


def filter_captures(df: DataFrame, site: str, url_key: str, order: list[str], per_site: int) -> DataFrame:
    """Successful HTML captures, one row per URL key, at most ``per_site`` per site."""
    good = df.where((F.col("status") == "200") & (F.col("mime") == "text/html"))
    one = first_per_group(good, [site, url_key], [F.col(c) for c in order], 1)
    return first_per_group(one, [site], [F.col(url_key), *[F.col(c) for c in order]], per_site)

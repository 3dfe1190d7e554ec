"""Error rows, the multi-label error taxonomy and its summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteval.functions.stats import ratio
from siteval.functions.urls import anonymous_site
from siteval.operators.joins import compare_sides, lookup, lookup_count, skew_join
from siteval.operators.ranking import checkpointed, first_per_group, rank_within
from siteval.operators.splits import band_of

# Category ids and the rank bands counted as least popular.
FP_CATEGORIES = ["FP-A", "FP-B", "FP-C", "FP-D", "FP-E"]
FN_CATEGORIES = ["FN-A", "FN-B", "FN-C", "FN-D", "FN-E"]
UNCATEGORIZED = "UNCATEGORIZED"
ENVELOPE = ["url_length", "hostname_length", "digit_ratio", "special_char_count",
            "derived_path_depth", "derived_query_parameter_count"]


def _quantile(df: DataFrame, by: list[str], cols: dict[str, tuple[str, float]]) -> DataFrame:
    """Exact quantiles; values are counted first, so the state is the number
    of different values and not the number of rows."""
    names = sorted({c for c, _ in cols.values()})
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in names]))
    counts = df.select(*by, cells.alias("x")).groupBy(*by, "x.c", "x.v").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by).agg(*[
        F.percentile(F.when(F.col("c") == c, F.col("v")), F.lit(q), F.col("n")).alias(out)
        for out, (c, q) in cols.items()])


def taxonomy_thresholds(train: DataFrame, by: list[str], label: str = "label", long_url: float = .9,
                        short_host: float = .5, few_special: float = .5, envelope: float = .9) -> DataFrame:
    """Train-only thresholds per regime, from the negative class."""
    cols = {"long_url": ("url_length", long_url), "short_host": ("hostname_length", short_host),
            "few_special": ("special_char_count", few_special),
            **{f"q_{c}": (c, envelope) for c in ENVELOPE}}
    return _quantile(train.where(F.col(label) == 0), by, cols)


def train_sites(train: DataFrame, by: list[str], site: str) -> DataFrame:
    return train.select(*by, site).distinct()


def negative_suffix_counts(train: DataFrame, by: list[str], suffix: str, label: str = "label") -> DataFrame:
    return train.where(F.col(label) == 0).groupBy(*by, suffix).agg(F.count(F.lit(1)).alias("suffix_count"))


def _listed(names: list[str], conditions: list[Column]) -> Column:
    hits = F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in zip(names, conditions)])
    return F.filter(hits, lambda x: x.isNotNull())


def fp_categories(rare_max: int, low_bands: list[str]) -> Column:
    c = F.col
    return _listed(FP_CATEGORIES, [
        c("url_length") >= c("long_url"),
        (c("is_private_suffix") == 1) | (c("suffix_count") <= rare_max),
        (c("is_ip") == 1) | (c("hostname_has_digit") == 1),
        (c("derived_path_depth") >= 5) | (c("derived_query_parameter_count") >= 2),
        c("rank_band").isin(*low_bands),
    ])


def fn_categories() -> Column:
    c = F.col
    inside = F.lit(True)
    for name in ENVELOPE:
        inside = inside & (c(name) <= c(f"q_{name}"))
    return _listed(FN_CATEGORIES, [
        (c("https") == 1) & (c("hostname_length") <= c("short_host")),
        c("root_path_empty_query") == 1,
        c("com_or_org") == 1,
        c("special_char_count") <= c("few_special"),
        ~c("seen_in_train") & inside,
    ])


def rank_band(df: DataFrame, rank: str, bands: list[tuple[int, int]]) -> DataFrame:
    """Band of each rank; a rank outside all bands is an error."""
    band = band_of(F.col(rank), bands)
    return df.withColumn("rank_band", F.coalesce(band, F.raise_error(F.lit("rank outside all bands")).cast("string")))


def rank_lookup(df: DataFrame, frame: DataFrame, keys: list[str]) -> DataFrame:
    return lookup(df, frame, keys, "rank band")


def error_rows(pred: DataFrame, rows: DataFrame, train: DataFrame, thresholds: DataFrame, by: list[str], key: str,
               site: str, suffix: str, label: str = "label", rare_max: int = 5,
               low_bands: tuple[str, ...] = ()) -> DataFrame:
    """Misclassified rows with their properties and matched categories.

    ``by`` are the regime columns of ``rows``, ``train`` and ``thresholds``;
    predictions may carry more (the model).
    """
    wrong = pred.where(F.col(label) != F.col("predicted")).drop(label)
    wrong = wrong.join(rows, [*by, key], "inner")  # one row per id: nothing to spread
    wrong = wrong.withColumn("error_type", F.when(F.col(label) == 0, "FP").otherwise("FN"))
    seen = train_sites(train, by, site).withColumn("_hit", F.lit(True))
    wrong = skew_join(wrong, seen, [*by, site], "left")
    wrong = wrong.withColumn("seen_in_train", F.coalesce("_hit", F.lit(False))).drop("_hit")
    wrong = lookup_count(wrong, negative_suffix_counts(train, by, suffix, label), [*by, suffix], "suffix_count")
    # one threshold row per regime: the caller lists the regimes
    wrong = wrong.join(F.broadcast(thresholds), by, "inner")
    matched = F.when(F.col("error_type") == "FP", fp_categories(rare_max, list(low_bands))).otherwise(fn_categories())
    wrong = wrong.withColumn("categories", matched)
    return wrong.withColumns({"category_count": F.size("categories"), "uncategorized": F.size("categories") == 0})


def fp_fn_summary(cells: DataFrame) -> DataFrame:
    """Counts and rates per experiment from confusion cells."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return cells.withColumns({
        "negatives": tn + fp, "positives": tp + fn,
        "fp_rate": ratio(fp, tn + fp), "fn_rate": ratio(fn, tp + fn)})


def category_counts(errors: DataFrame, by: list[str]) -> DataFrame:
    """Errors per category, zeros kept.

    Every category is a conditional sum of one grouped pass; the grid is
    unfolded afterwards from the per-experiment rows.
    """
    names = FP_CATEGORIES + FN_CATEGORIES

    def hit(name: str) -> Column:
        return F.count_if(F.array_contains("categories", name))

    kinds = F.explode(F.array(F.lit("FP"), F.lit("FN"))).alias("error_type")
    wide = errors.groupBy(*by).agg(
        *[hit(n).alias(n) for n in names],
        *[F.count_if((F.col("error_type") == k) & F.col("uncategorized")).alias(f"u_{k}") for k in ("FP", "FN")],
        *[F.count_if(F.col("error_type") == k).alias(f"t_{k}") for k in ("FP", "FN")])
    wide = wide.select("*", kinds)

    def cells(kind: str, own: list[str]) -> Column:
        return F.array(*[F.struct(F.lit(n).alias("category"), F.col(n).alias("errors")) for n in own],
                       F.struct(F.lit(UNCATEGORIZED).alias("category"), F.col(f"u_{kind}").alias("errors")))

    is_fp = F.col("error_type") == "FP"
    grid = F.explode(F.when(is_fp, cells("FP", FP_CATEGORIES)).otherwise(cells("FN", FN_CATEGORIES))).alias("c")
    total = F.when(is_fp, F.col("t_FP")).otherwise(F.col("t_FN")).alias("total_errors")
    out = wide.select(*by, "error_type", total, grid).select(*by, "error_type", "c.*", "total_errors")
    return out.withColumn("prevalence", ratio(F.col("errors"), F.col("total_errors")))


def category_multiplicity(errors: DataFrame, by: list[str]) -> DataFrame:
    keys = [*by, "error_type"]
    counts = errors.groupBy(*keys, "category_count").agg(F.count(F.lit(1)).alias("errors"))
    total = F.sum("errors").over(Window.partitionBy(*keys))
    return counts.withColumn("share", F.col("errors") / total)


def compare_categories(counts: DataFrame, regime: str, values: tuple[str, str], by: list[str]) -> DataFrame:
    """Prevalence of both regimes and the difference in percentage points."""
    keys = [*by, "error_type", "category"]
    wide = compare_sides(counts, regime, values, keys, ["errors", "total_errors", "prevalence"])
    a, c = values
    return wide.withColumn("difference_pp", 100.0 * (F.col(f"prevalence_{c}") - F.col(f"prevalence_{a}")))


def site_errors(errors: DataFrame, by: list[str], site: str, salt: str = "site|") -> DataFrame:
    """Errors per site with share, per-category counts as JSON, and a public name
    that depends on the caller's salt."""
    keys = [*by, "error_type"]
    names = FP_CATEGORIES + FN_CATEGORIES
    ordered = sorted(names)
    per = errors.groupBy(*keys, site).agg(
        F.count(F.lit(1)).alias("errors"), F.count_if("uncategorized").alias("uncategorized_errors"),
        *[F.count_if(F.array_contains("categories", n)).alias(f"_{n}") for n in ordered])
    json = F.to_json(F.struct(*[F.col(f"_{n}").alias(n) for n in ordered]))
    per = checkpointed(per.withColumn("category_json", json).drop(*[f"_{n}" for n in ordered]))
    # one total per experiment and error type, from the grouped rows
    per = per.join(per.groupBy(*keys).agg(F.sum("errors").alias("total_errors")), keys, "inner")
    return per.withColumns({"share": F.col("errors") / F.col("total_errors"),
                            "anonymous_site": anonymous_site(F.col(site), salt)})


def contributor_rank(sites: DataFrame, by: list[str], site: str) -> DataFrame:
    return rank_within(sites, [*by, "error_type"], [F.desc("errors"), F.asc(site)], "site_rank")


def top_sites(sites: DataFrame, by: list[str], site: str, n: int = 10) -> DataFrame:
    """Largest contributors per experiment, published without the site key."""
    top = first_per_group(sites, [*by, "error_type"], [F.desc("errors"), F.asc(site)], n, "site_rank")
    return top.drop(site)


def check_taxonomy(errors: DataFrame, sites: DataFrame) -> DataFrame:
    """Named checks: known categories, consistent flag, site counts add up."""
    known = F.array(*[F.lit(n) for n in FP_CATEGORIES + FN_CATEGORIES])
    unknown = F.count_if(F.size(F.array_except("categories", known)) > 0)
    flag = F.count_if(F.col("uncategorized") != (F.col("category_count") == 0))
    total = F.count(F.lit(1)) - F.coalesce(sites.agg(F.sum("errors")).scalar(), F.lit(0))
    checks = F.explode(F.array(*[
        F.struct(F.lit(n).alias("check"), c.alias("violations"))
        for n, c in (("known_categories", F.col("a")), ("flag_consistent", F.col("b")), ("site_totals", F.col("c")))
    ])).alias("x")
    return errors.agg(unknown.alias("a"), flag.alias("b"), total.alias("c")).select(checks).select(
        "x.*", F.when(F.col("x.violations") == 0, "PASS").otherwise("FAIL").alias("status"))


def unseen_share(errors: DataFrame, by: list[str]) -> DataFrame:
    return errors.groupBy(*by, "error_type").agg(F.avg((~F.col("seen_in_train")).cast("double")).alias("unseen_share"))



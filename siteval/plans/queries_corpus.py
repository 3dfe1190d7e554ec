"""Registered queries: profiles, splits, joins, windows, sets, checks."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from siteval.functions.hashing import h60
from siteval.operators import audit as A
from siteval.operators import integrity as I
from siteval.operators import joins as J
from siteval.operators import ranking as R
from siteval.operators import splits as S
from siteval.operators.attribution import largest_change, set_overlap
from siteval.operators.parsing import with_template_keys
from siteval.plans.corpus import build_corpus
from siteval.plans.queries_urls import TEMPLATES_SQL
from siteval.plans.registry import query
from siteval.plans.tables import (CAPTURES_SQL, GROUPED_SQL, LEDGER_SQL, ORDERS_SQL, PAGES_SQL, PARSED_SQL, RANKED_SQL,
                                  SEEDS, Tables, sql_h60)
from siteval.sources import normalize as N
from siteval.sources import readers as SR
from siteval.sources import sinks as SK
from siteval.sources.readers import CANONICAL_COLUMNS

r6 = lambda c: F.round(c, 6).alias(c) if isinstance(c, str) else F.round(c, 6)


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


# ---------------------------------------------------------------- flagship

def split_sql(source: str, key: str, strata: str | None, seed, stream: str = "'rows'", where: str = "") -> str:
    """CTEs ``ranked_rows``/``splitted``: 70/15/15 by hash rank with rounded counts."""
    part = f"PARTITION BY {strata} " if strata else ""
    total = f"count(*) OVER ({part.strip()})" if strata else "count(*) OVER ()"
    h = sql_h60(str(seed) if not isinstance(seed, int) else f"'{seed}'", stream, key)
    return f"""ranked_rows AS (SELECT *, row_number() OVER ({part}ORDER BY {h}, {key}) AS rn, {total} AS n FROM {source}),
    splitted AS (SELECT * EXCLUDE (rn, n), CASE WHEN rn <= round_even(n * 0.7, 0) THEN 'train'
      WHEN rn <= round_even(n * 0.7, 0) + round_even(n * 0.15, 0) THEN 'validation' ELSE 'test' END AS "partition" FROM ranked_rows)"""


def exposure_sql(source: str, by: str = "") -> str:
    b = f"{by}, " if by else ""
    join = f" AND t.{by} = s.{by}" if by else ""
    return f"""train_sites AS (SELECT DISTINCT {b}site_key_private FROM {source} WHERE "partition" = 'train'),
    train_hosts AS (SELECT DISTINCT {b}hostname_ascii FROM {source} WHERE "partition" = 'train'),
    flagged AS (SELECT s.*, EXISTS (SELECT 1 FROM train_sites t WHERE t.site_key_private = s.site_key_private{join}) AS site_seen,
      EXISTS (SELECT 1 FROM train_hosts t WHERE t.hostname_ascii = s.hostname_ascii{join}) AS host_seen
      FROM {source} s WHERE "partition" = 'test'),
    classes AS (SELECT *, 'all' AS class FROM flagged UNION ALL SELECT *, CAST(label AS VARCHAR) FROM flagged)
    SELECT {b}class, count(*) AS test_rows, count(DISTINCT CASE WHEN site_seen THEN site_key_private END) AS shared_sites,
      count(DISTINCT CASE WHEN host_seen THEN hostname_ascii END) AS shared_hosts,
      round(100.0 * sum(CASE WHEN site_seen THEN 1 ELSE 0 END) / count(*), 6) AS site_seen_pct,
      round(100.0 * sum(CASE WHEN host_seen THEN 1 ELSE 0 END) / count(*), 6) AS host_seen_pct
    FROM classes GROUP BY {b}class"""


@query("entry_site_exposure", f"{PAGES_SQL}, {split_sql('labelled_pages', 'page_id', 'label', 42)}, {exposure_sql('splitted')}")
def entry(t: Tables):
    # parsed once and written: the split and the exposure read it several times
    rows = R.checkpointed(t.pages().select("page_id", "label", "hostname_ascii", "site_key_private"))
    split = S.split_stratified(rows, "page_id", "label", 42)
    return rounded(A.site_exposure(split, "label", "hostname_ascii", "site_key_private"), "site_seen_pct", "host_seen_pct")


def corpus_split(t: Tables):
    rows = R.checkpointed(t.grouped().select("record_id", "label", "hostname_ascii", "site_key_private", "site_key_icann"))
    return S.split_stratified(rows, "record_id", "label", 42)


CORPUS_SPLIT_SQL = (GROUPED_SQL + ", g AS (SELECT record_id, label, hostname_ascii, site_key_private, site_key_icann FROM grouped), "
                    + split_sql("g", "record_id", "label", 42))


@query("g10_site_exposure", f"{CORPUS_SPLIT_SQL}, {exposure_sql('splitted')}")
def g10(t: Tables):
    out = A.site_exposure(corpus_split(t), "label", "hostname_ascii", "site_key_private")
    return rounded(out, "site_seen_pct", "host_seen_pct")


CAPS = {"UNCAPPED": None, "CAP10": 10, "CAP5": 5}
_CAPS_SQL = ", ".join(f"('{name}', {k or 'NULL'})" for name, k in CAPS.items())


@query("g10_exposure_by_seed_and_cap", f"""{GROUPED_SQL}, ranked AS (SELECT record_id, label, hostname_ascii, site_key_private,
      row_number() OVER (PARTITION BY label, site_key_private ORDER BY {sql_h60("'cap'", "record_id")}, record_id) AS cap_rank FROM grouped),
    variants AS (SELECT r.* EXCLUDE cap_rank, variant || '/' || seed AS cell, seed FROM ranked r JOIN (VALUES {_CAPS_SQL}) AS c(variant, k)
      ON k IS NULL OR cap_rank <= k CROSS JOIN (VALUES {", ".join(f"({s})" for s in SEEDS)}) AS s(seed)),
    {split_sql("variants", "record_id", "cell, label", "CAST(seed AS VARCHAR)")}, ex AS (WITH {exposure_sql("splitted", "cell")})
    SELECT split_part(cell, '/', 1) AS variant, CAST(split_part(cell, '/', 2) AS INTEGER) AS seed, * EXCLUDE (cell) FROM ex""")
def g10_all(t: Tables):
    """Exposure of random splits for every seed, of the whole corpus and of its capped forms."""
    rows = R.checkpointed(t.grouped().select("record_id", "label", "hostname_ascii", "site_key_private", h60("cap", F.col("record_id")).alias("_h")))
    parts = [rows if k is None else S.cap_per_group(rows, ["label", "site_key_private"], ["_h", "record_id"], k) for k in CAPS.values()]
    variants = functools.reduce(lambda a, b: a.unionByName(b), [p.withColumn("variant", F.lit(n)) for n, p in zip(CAPS, parts)])
    variants = R.checkpointed(variants.drop("_h").withColumn("seed", F.explode(F.array(*[F.lit(s) for s in SEEDS]))))
    split = S.split_stratified(variants, "record_id", "label", F.col("seed"), by=["variant", "seed"])
    out = A.site_exposure(split, "label", "hostname_ascii", "site_key_private", by=["variant", "seed"])
    return rounded(out, "site_seen_pct", "host_seen_pct")


# ---------------------------------------------------------------- validity and duplicates

@query("g01_validity", f"{PARSED_SQL} SELECT parse_status, label, count(*) AS rows FROM parsed GROUP BY ALL")
def g01(t: Tables):
    return A.validity_profile(t.parsed())


_DUP_SQL = """SELECT sha256(normalized_url) AS normalized_url_hash, count(*) AS rows, count(DISTINCT label) AS labels,
    count(DISTINCT source_name) AS sources, count(DISTINCT site_key_private) AS sites FROM parsed GROUP BY 1"""


@query("g02_duplicate_groups", f"{PARSED_SQL} {_DUP_SQL} HAVING count(*) > 1")
def g02(t: Tables):
    return A.duplicate_groups(t.parsed(), "normalized_url_hash", "label", "source_name", "site_key_private")


@query("g03_duplicate_summary", f"""{PARSED_SQL}, d AS ({_DUP_SQL}) SELECT CAST(sum(rows) AS BIGINT) AS total_rows,
    count(*) AS unique_keys, CAST(sum(rows) - count(*) AS BIGINT) AS beyond_first,
    round(100.0 * (sum(rows) - count(*)) / sum(rows), 6) AS duplicate_pct,
    count_if(labels > 1) AS cross_label_keys FROM d""")
def g03(t: Tables):
    return rounded(A.duplicate_summary(t.parsed(), "normalized_url_hash", "label"), "duplicate_pct")


@query("g04_conflict_rows", f"""{PARSED_SQL} SELECT record_id, label, sha256(normalized_url) AS normalized_url_hash FROM parsed
    WHERE normalized_url IN (SELECT normalized_url FROM parsed GROUP BY 1 HAVING count(DISTINCT label) > 1)""")
def g04(t: Tables):
    rows = t.parsed().select("record_id", "label", "normalized_url_hash")
    return A.conflict_rows(rows, "normalized_url_hash", "label")


@query("g05_mixed_groups", f"""{GROUPED_SQL} SELECT site_key_private, count(*) AS rows, CAST(sum(label) AS BIGINT) AS positives,
    count(DISTINCT source_name) AS sources FROM grouped GROUP BY 1 HAVING count(DISTINCT label) > 1""")
def g05(t: Tables):
    return A.mixed_groups(t.parsed(), "site_key_private", "label", "source_name")


# ---------------------------------------------------------------- group sizes

SIZES_SQL = GROUPED_SQL + ", sizes AS (SELECT label, site_key_private, count(*) AS x FROM grouped GROUP BY ALL)"


@query("g06_multiplicity", f"""{SIZES_SQL}, h AS (SELECT label, count(DISTINCT hostname_ascii) AS hosts FROM grouped GROUP BY 1)
    SELECT s.label, any_value(h.hosts) AS hosts, CAST(sum(x) AS BIGINT) AS urls, count(*) AS sites, round(avg(x), 6) AS mean,
    quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS p75, round(quantile_cont(x, 0.9), 6) AS p90,
    round(quantile_cont(x, 0.95), 6) AS p95, max(x) AS max, count_if(x = 1) AS sites_eq_1, count_if(x >= 2) AS sites_ge_2,
    count_if(x >= 5) AS sites_ge_5, count_if(x >= 10) AS sites_ge_10, count_if(x >= 50) AS sites_ge_50,
    count_if(x >= 100) AS sites_ge_100 FROM sizes s JOIN h ON s.label = h.label GROUP BY s.label""")
def g06(t: Tables):
    rows = R.checkpointed(t.grouped().select("label", "hostname_ascii", "site_key_private"))
    return rounded(A.multiplicity(rows, "site_key_private", ["label"], "hostname_ascii"), "mean", "p90", "p95")


@query("g07_gini", f"""{SIZES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY x, site_key_private) AS i,
      count(*) OVER (PARTITION BY label) AS n, sum(x) OVER (PARTITION BY label) AS s FROM sizes)
    SELECT label, round(2.0 * sum(i * x) / (max(n) * max(s)) - (max(n) + 1.0) / max(n), 6) AS gini FROM r GROUP BY label""")
def g07(t: Tables):
    return rounded(A.gini(t.grouped(), "site_key_private", ["label"]), "gini")


_DESC_SQL = SIZES_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY x DESC, site_key_private) AS i,
      sum(x) OVER (PARTITION BY label ORDER BY x DESC, site_key_private ROWS UNBOUNDED PRECEDING) AS cum,
      sum(x) OVER (PARTITION BY label) AS s FROM sizes)"""


@query("g08_groups_to_cover", f"""{_DESC_SQL} SELECT label, min(CASE WHEN cum >= s * 0.5 THEN i END) AS cover_50,
    min(CASE WHEN cum >= s * 0.9 THEN i END) AS cover_90 FROM r GROUP BY label""")
def g08(t: Tables):
    return A.groups_to_cover(t.grouped(), "site_key_private", ["label"])


@query("g09_topk_share", f"""{_DESC_SQL} SELECT label, {", ".join(
    f"round(sum(CASE WHEN i <= {k} THEN x ELSE 0 END) / max(s), 6) AS top{k}_share" for k in (1, 10, 100))} FROM r GROUP BY label""")
def g09(t: Tables):
    return rounded(A.topk_share(t.grouped(), "site_key_private", ["label"]), "top1_share", "top10_share", "top100_share")


@query("g09_concentration", f"""{_DESC_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY x, site_key_private) AS j,
      count(*) OVER (PARTITION BY label) AS n FROM r)
    SELECT label, round(2.0 * sum(j * x) / (max(n) * max(s)) - (max(n) + 1.0) / max(n), 6) AS gini,
    min(CASE WHEN cum >= s * 0.5 THEN i END) AS cover_50, min(CASE WHEN cum >= s * 0.9 THEN i END) AS cover_90,
    round(sum(CASE WHEN i <= 1 THEN x ELSE 0 END) / max(s), 6) AS top1_share,
    round(sum(CASE WHEN i <= 10 THEN x ELSE 0 END) / max(s), 6) AS top10_share,
    round(sum(CASE WHEN i <= 100 THEN x ELSE 0 END) / max(s), 6) AS top100_share FROM a GROUP BY label""")
def g09c(t: Tables):
    rows = R.checkpointed(t.grouped().select("label", "site_key_private"))
    return rounded(A.concentration(rows, "site_key_private", ["label"]), "gini", "top1_share", "top10_share", "top100_share")


@query("g11_class_disparity", f"""{GROUPED_SQL}, p AS (SELECT label, CAST(scheme = 'https' AS INTEGER) AS https,
      CAST(hostname_ascii LIKE 'www.%' AS INTEGER) AS www, length(path) AS path_length FROM grouped),
    u AS (UNPIVOT p ON https, www, path_length INTO NAME property VALUE v)
    SELECT property, round(avg(CASE WHEN label = 1 THEN v END), 6) AS positive, round(avg(CASE WHEN label = 0 THEN v END), 6) AS negative,
    round(abs(avg(CASE WHEN label = 1 THEN v END) - avg(CASE WHEN label = 0 THEN v END)), 6) AS abs_difference FROM u GROUP BY property""")
def g11(t: Tables):
    from siteval.functions.features import audit_properties
    d = A.class_disparity(audit_properties(t.grouped()), "label", ["https", "www", "path_length"])
    return rounded(d, "positive", "negative", "abs_difference")


@query("g12_structural_profile", f"""{GROUPED_SQL} SELECT label, count(*) AS rows, count(DISTINCT site_key_private) AS sites,
    round(avg(CAST(scheme = 'https' AS INTEGER)), 6) AS https_rate, round(avg(CAST(is_ip AS INTEGER)), 6) AS is_ip_rate,
    round(avg(CASE WHEN query <> '' THEN 1 ELSE 0 END), 6) AS query_present_rate,
    round(avg(length(raw_url)), 6) AS url_length_mean, median(length(raw_url)) AS url_length_median,
    round(avg(length(path)), 6) AS path_length_mean, median(length(path)) AS path_length_median FROM grouped GROUP BY label""")
def g12(t: Tables):
    from siteval.functions.features import structural_properties
    d = A.structural_profile(structural_properties(t.grouped()), "label", "site_key_private", ["is_ip", "query_present"],
                             ["url_length", "path_length"])
    return rounded(d, "https_rate", "is_ip_rate", "query_present_rate", "url_length_mean", "path_length_mean")


@query("g13_suffix_by_class", f"""{GROUPED_SQL}, c AS (SELECT label, public_suffix_private, count(*) AS rows FROM grouped GROUP BY ALL)
    SELECT *, CAST(sum(rows) OVER (PARTITION BY label) AS BIGINT) AS class_total,
    round(rows / sum(rows) OVER (PARTITION BY label), 6) AS share FROM c""")
def g13(t: Tables):
    return rounded(A.suffix_by_class(t.grouped(), "public_suffix_private", "label"), "share")


@query("g14_suffix_crosstab", f"""{GROUPED_SQL} SELECT public_suffix_private, count_if(label = 1) AS positive,
    count_if(label = 0) AS negative, count(*) AS total, round(count_if(label = 1) / count(*), 6) AS positive_share FROM grouped GROUP BY 1""")
def g14(t: Tables):
    return rounded(A.suffix_crosstab(t.grouped(), "public_suffix_private", "label"), "positive_share")


@query("g15_cramers_v", """WITH o AS (SELECT l_returnflag AS a, l_linestatus AS b FROM lineitem),
    full_grid AS (SELECT a, b FROM (SELECT DISTINCT a FROM o) CROSS JOIN (SELECT DISTINCT b FROM o)),
    obs AS (SELECT g.a, g.b, count(o.a) AS n FROM full_grid g LEFT JOIN o ON o.a = g.a AND o.b = g.b GROUP BY ALL),
    e AS (SELECT *, sum(n) OVER (PARTITION BY a) * sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS ex, sum(n) OVER () AS t FROM obs)
    SELECT round(sqrt(sum((n - ex) * (n - ex) / ex) / (max(t) * (least(count(DISTINCT a), count(DISTINCT b)) - 1))), 6) AS cramers_v FROM e""")
def g15(t: Tables):
    return rounded(A.cramers_v(t.read("lineitem"), "l_returnflag", "l_linestatus"), "cramers_v")


@query("g16_template_overlap", f"""{TEMPLATES_SQL}, k AS (SELECT template_key, count(*) AS n, count(DISTINCT site_key_private) AS s
      FROM masked GROUP BY 1)
    SELECT count(*) AS templates, count_if(s > 1) AS shared_templates, CAST(sum(CASE WHEN s > 1 THEN n ELSE 0 END) AS BIGINT) AS rows_in_shared,
    round(100.0 * sum(CASE WHEN s > 1 THEN n ELSE 0 END) / sum(n), 6) AS rows_in_shared_pct FROM k""")
def g16(t: Tables):
    return rounded(A.template_overlap(with_template_keys(t.grouped()), "template_key", "site_key_private"), "rows_in_shared_pct")


@query("g17_grouping_sensitivity", f"""{GROUPED_SQL} SELECT count(DISTINCT site_key_icann) AS icann_sites,
    count(DISTINCT site_key_private) AS private_sites, count_if(site_key_icann <> site_key_private) AS changed_rows,
    round(100.0 * count_if(site_key_icann <> site_key_private) / count(*), 6) AS changed_pct,
    count_if(is_private_suffix) AS private_suffix_rows,
    (SELECT count(*) FROM (SELECT site_key_private FROM grouped GROUP BY 1 HAVING count(DISTINCT label) > 1)) AS mixed_private_sites,
    (SELECT count(*) FROM (SELECT hostname_ascii FROM grouped GROUP BY 1 HAVING count(DISTINCT label) > 1)) AS mixed_hosts FROM grouped""")
def g17(t: Tables):
    rows = R.checkpointed(t.grouped().select("label", "hostname_ascii", "site_key_private", "site_key_icann", "is_private_suffix"))
    return rounded(A.grouping_sensitivity(rows), "changed_pct")


@query("g18_sites_per_parent", f"""{GROUPED_SQL} SELECT site_key_icann, count(DISTINCT site_key_private) AS private_sites
    FROM grouped WHERE site_key_icann <> '' GROUP BY 1""")
def g18(t: Tables):
    return A.sites_per_parent(t.grouped())


@query("g19_multiplicity_hist", f"{SIZES_SQL} SELECT label, least(x, 50) AS clipped_size, count(*) AS groups FROM sizes GROUP BY ALL")
def g19(t: Tables):
    return A.multiplicity_hist(t.grouped(), "site_key_private", ["label"])


@query("g20_inventory", f"""{PARSED_SQL}, c AS (SELECT CAST(label AS VARCHAR) AS k, count(*) AS v FROM parsed GROUP BY 1)
    SELECT count(*) AS rows, count_if(label IS NULL) AS missing_labels, count(DISTINCT hostname_ascii) AS distinct_hostname_ascii,
    count(DISTINCT site_key_private) AS distinct_site_key_private,
    (SELECT '{{' || string_agg('"' || k || '":' || v, ',' ORDER BY k) || '}}' FROM c) AS label_counts FROM parsed""")
def g20(t: Tables):
    return A.inventory(t.parsed(), "label", ["hostname_ascii", "site_key_private"])


@query("g21_time_range", """SELECT 'ts' AS "column", min(ts) AS first, max(ts) AS last FROM events""")
def g21(t: Tables):
    return A.time_range(t.read("events"), ["ts"])


@query("g22_top_values", """SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'Other' ELSE o_orderpriority END AS target, count(*) AS rows
    FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def g22(t: Tables):
    d = t.read("orders").withColumn("target", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderpriority")))
    return A.top_values(d, "target", 20)


@query("g24_ledger_summary", f"""WITH {LEDGER_SQL} SELECT count(*) AS sites, count_if(status = 'COMPLETED') AS completed,
    count_if(status = 'FAILED') AS failed, count_if(status = 'PENDING') AS pending,
    count_if(status = 'COMPLETED' AND records > 0) AS sites_with_records,
    CAST(sum(CASE WHEN status = 'COMPLETED' THEN records ELSE 0 END) AS BIGINT) AS candidates,
    CASE WHEN count_if(status = 'COMPLETED') = count(*) THEN 'COMPLETE' ELSE 'INCOMPLETE' END AS state FROM ledger""")
def g24(t: Tables):
    return A.ledger_summary(t.ledger(), "ordinal")


@query("g25_source_summary", """SELECT event_type, count(DISTINCT user_id) AS sites_with_results, count(*) AS rows FROM events GROUP BY 1""")
def g25(t: Tables):
    return A.source_summary(t.read("events"), ["event_type"], "user_id")


@query("g26_seed_summary", """WITH v AS (SELECT o_orderpriority AS model, o_orderkey % 5 AS seed, count(*) AS value FROM orders GROUP BY ALL)
    SELECT model, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sample_sd, min(value) AS min, max(value) AS max,
    '{' || string_agg('"' || seed || '":' || value, ',' ORDER BY seed) || '}' AS by_seed FROM v GROUP BY model""")
def g26(t: Tables):
    v = t.read("orders").groupBy(F.col("o_orderpriority").alias("model"), (F.col("o_orderkey") % 5).alias("seed")).agg(
        F.count(F.lit(1)).alias("value"))
    return rounded(A.seed_summary(v, ["model"], "seed", "value"), "mean", "sample_sd").withColumn("by_seed", F.to_json("by_seed"))


@query("g27_group_counts", f"""{GROUPED_SQL} SELECT label, sha256(site_key_private) AS site_key_private, count(*) AS rows
    FROM grouped GROUP BY label, grouped.site_key_private""")
def g27(t: Tables):
    return A.group_counts(t.grouped(), "site_key_private", ["label"])


@query("g28_site_accounting", f"""{GROUPED_SQL}, f AS (SELECT site_key_private, bool_or(label = 0) AS n, bool_or(label = 1) AS p FROM grouped GROUP BY 1)
    SELECT count_if(n) AS negative_sites, count_if(p) AS positive_sites, count(*) AS union_sites, count_if(n AND p) AS intersection_sites FROM f""")
def g28(t: Tables):
    return A.site_accounting(t.grouped(), "site_key_private", "label")


@query("o01_top_groups", """SELECT sha256(CAST(o_custkey AS VARCHAR)) AS site, label, count(*) AS rows FROM (SELECT o_custkey,
    CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label FROM orders) GROUP BY o_custkey, label
    ORDER BY rows DESC, o_custkey, label LIMIT 50""")
def o01(t: Tables):
    return A.top_groups(t.orders(), "site", "label", 50)


# ---------------------------------------------------------------- splits and samples

BANDS = [(1, 200), (201, 500), (501, 900), (901, 1400)]
_BAND_SQL = "CASE " + " ".join(f"WHEN rank BETWEEN {a} AND {b} THEN '{a}-{b}'" for a, b in BANDS) + " END"


@query("sp01_sample_bands", f"""WITH {RANKED_SQL}, b AS (SELECT *, {_BAND_SQL} AS rank_band FROM ranked),
    r AS (SELECT *, row_number() OVER (PARTITION BY rank_band ORDER BY {sql_h60("'42'", "'band'", "domain")}, domain) AS i
      FROM b WHERE rank_band IS NOT NULL) SELECT rank, domain, rank_band FROM r WHERE i <= 25""")
def sp01(t: Tables):
    return S.sample_bands(t.ranked(), "rank", "domain", BANDS, 25, 42)


@query("sp02_sample_n", f"""WITH {ORDERS_SQL} SELECT id FROM ord ORDER BY {sql_h60("'7'", "'sample'", "id")}, id LIMIT 500""")
def sp02(t: Tables):
    return S.sample_n(t.orders(), "id", 500, 7).select("id")


@query("sp03_stratified", f"""WITH {ORDERS_SQL}, {split_sql('ord', 'id', 'label', 42)} SELECT id, label, "partition" FROM splitted""")
def sp03(t: Tables):
    return S.split_stratified(t.orders(), "id", "label", 42).select("id", "label", "partition")


@query("sp04_two_step", f"""WITH {ORDERS_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {sql_h60("'42'", "'holdout'", "id")}, id)
      <= round_even(count(*) OVER (PARTITION BY label) * 0.3, 0) AS held FROM ord),
    b AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {sql_h60("'42'", "'halves'", "id")}, id)
      <= round_even(count(*) OVER (PARTITION BY label) * 0.5, 0) AS val FROM a WHERE held)
    SELECT id, label, CASE WHEN val THEN 'validation' ELSE 'test' END AS "partition" FROM b
    UNION ALL SELECT id, label, 'train' FROM a WHERE NOT held""")
def sp04(t: Tables):
    return S.split_two_step(t.orders(), "id", "label", 42).select("id", "label", "partition")


@query("sp05_random", f"""WITH {ORDERS_SQL}, {split_sql('ord', 'id', None, 42)} SELECT id, "partition" FROM splitted""")
def sp05(t: Tables):
    return S.split_random(t.orders(), "id", 42).select("id", "partition")


def _holdout_sql(groups: str, seed: int, fraction: str, out: str) -> str:
    h = sql_h60(f"'{seed}'", "'holdout'", "c", "site")
    return f"""{out}_r AS (SELECT c, site, n0, n1, row_number() OVER (PARTITION BY c ORDER BY {h}, site) AS i,
      count(*) OVER (PARTITION BY c) AS g FROM {groups} CROSS JOIN range(40) AS t(c)),
    {out}_s AS (SELECT c, sum(CASE WHEN i <= ceil(g * ({fraction})) THEN n0 ELSE 0 END) AS h0, sum(n0) * ({fraction}) AS t0,
      sum(CASE WHEN i <= ceil(g * ({fraction})) THEN n1 ELSE 0 END) AS h1, sum(n1) * ({fraction}) AS t1 FROM {out}_r GROUP BY c),
    {out}_b AS (SELECT c FROM {out}_s ORDER BY pow((h0 - t0) / greatest(t0, 1), 2) + pow((h1 - t1) / greatest(t1, 1), 2), c LIMIT 1),
    {out} AS (SELECT site FROM {out}_r WHERE c = (SELECT c FROM {out}_b) AND i <= ceil(g * ({fraction})))"""


@query("sp06_group_best", f"""WITH {ORDERS_SQL}, gr AS (SELECT site, count_if(label = 0) AS n0, count_if(label = 1) AS n1 FROM ord GROUP BY 1),
    {_holdout_sql('gr', 42, 'CAST(0.15 AS DOUBLE)', 'te')}, gr2 AS (SELECT * FROM gr WHERE site NOT IN (SELECT site FROM te)),
    {_holdout_sql('gr2', 10042, 'CAST(0.15 AS DOUBLE) / CAST(0.85 AS DOUBLE)', 'va')}
    SELECT id, site, CASE WHEN site IN (SELECT site FROM te) THEN 'test' WHEN site IN (SELECT site FROM va) THEN 'validation'
      ELSE 'train' END AS "partition" FROM ord""")
def sp06(t: Tables):
    return S.split_group_best(t.orders(), "site", "label", 42).select("id", "site", "partition")


def prefix_sql(source: str, group: str, seed: str = "'42'", by: str = "") -> str:
    b, p = (f"{by}, ", f"PARTITION BY {by} ") if by else ("", "")
    h = sql_h60(seed, "'group'", group)
    on = f" AND p.{by} = s.{by}" if by else ""
    return f"""gsz AS (SELECT {b}{group}, count(*) AS n FROM {source} GROUP BY {b}{group}),
    pre AS (SELECT *, coalesce(sum(n) OVER ({p}ORDER BY {h}, {group} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef,
      sum(n) OVER ({p.strip()}) AS tot FROM gsz),
    splitted AS (SELECT s.*, CASE WHEN bef < tot * 0.7 THEN 'train' WHEN bef < tot * (CAST(0.7 AS DOUBLE) + CAST(0.15 AS DOUBLE)) THEN 'validation'
      ELSE 'test' END AS "partition" FROM {source} s JOIN pre p ON p.{group} = s.{group}{on})"""


@query("sp07_group_prefix", f"""WITH {ORDERS_SQL}, {prefix_sql('ord', 'site')} SELECT id, site, "partition" FROM splitted""")
def sp07(t: Tables):
    return S.split_group_prefix(t.orders(), "site", 42).select("id", "site", "partition")


@query("sp07_site_disjoint_exposure", f"""{GROUPED_SQL}, g AS (SELECT record_id, label, hostname_ascii, site_key_private FROM grouped),
    {prefix_sql('g', 'site_key_private')}, {exposure_sql('splitted')}""")
def sp07x(t: Tables):
    rows = R.checkpointed(t.grouped().select("record_id", "label", "hostname_ascii", "site_key_private"))
    split = S.split_group_prefix(rows, "site_key_private", 42)
    out = A.site_exposure(split, "label", "hostname_ascii", "site_key_private")
    return rounded(out, "site_seen_pct", "host_seen_pct")


@query("sp07_group_greedy", f"""WITH RECURSIVE {ORDERS_SQL}, num AS MATERIALIZED (SELECT site, n, row_number() OVER (ORDER BY n DESC, {sql_h60("'42'", "'greedy'", "site")}, site) AS i
      FROM (SELECT site, count(*) AS n FROM ord GROUP BY 1)),
    walk(i, site, p, a, b, c) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), '', CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT)
      UNION ALL SELECT i, site, p, a + CASE WHEN p = 'train' THEN n ELSE 0 END, b + CASE WHEN p = 'validation' THEN n ELSE 0 END,
        c + CASE WHEN p = 'test' THEN n ELSE 0 END
      FROM (SELECT num.i, num.site, n, a, b, c, CASE WHEN 3 * a <= 14 * b AND 3 * a <= 14 * c THEN 'train' WHEN b <= c THEN 'validation' ELSE 'test' END AS p
        FROM walk JOIN num ON num.i = walk.i + 1))
    SELECT o.id, o.site, w.p AS "partition" FROM ord o JOIN walk w ON w.site = o.site""")
def sp07g(t: Tables):
    """Largest groups first, each to the partition furthest below its share."""
    return S.split_group_greedy(t.orders(), "site", 42).select("id", "site", "partition")


GRID_KEYS = {"hostname": "hostname_ascii", "icann": "site_key_icann", "private": "site_key_private"}


def grid_sql() -> str:
    parts = []
    for protocol, key in GRID_KEYS.items():
        h = sql_h60("CAST(seed AS VARCHAR)", "'group'", key)
        parts.append(f"""{protocol}_src AS (SELECT * FROM spread WHERE coalesce({key}, '') <> ''),
    {protocol}_sizes AS (SELECT seed, {key}, count(*) AS n FROM {protocol}_src GROUP BY ALL),
    {protocol}_pre AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY seed ORDER BY {h}, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef,
      sum(n) OVER (PARTITION BY seed) AS tot FROM {protocol}_sizes),
    {protocol}_grid AS (SELECT s.*, '{protocol}' AS protocol, CASE WHEN bef < tot * 0.7 THEN 'train'
      WHEN bef < tot * (CAST(0.7 AS DOUBLE) + CAST(0.15 AS DOUBLE)) THEN 'validation' ELSE 'test' END AS "partition"
      FROM {protocol}_src s JOIN {protocol}_pre p USING (seed, {key}))""")
    return (GROUPED_SQL + ", spread AS (SELECT record_id, label, hostname_ascii, site_key_icann, site_key_private, seed FROM grouped CROSS JOIN (VALUES "
            + ", ".join(f"({s})" for s in SEEDS) + ") AS v(seed)), " + ", ".join(parts)
            + ", grid AS (" + " UNION ALL BY NAME ".join(f"SELECT * FROM {p}_grid" for p in GRID_KEYS) + ")")


def grid(t: Tables):
    rows = R.checkpointed(t.grouped().select("record_id", "label", *GRID_KEYS.values()))
    return S.split_grid(rows, GRID_KEYS, SEEDS, rows.columns)


@query("sp08_split_grid", f"""{grid_sql()} SELECT record_id, protocol, seed, "partition" FROM grid""")
def sp08(t: Tables):
    return grid(t).select("record_id", "protocol", "seed", "partition")


@query("g23_split_summary", f"""{grid_sql()} SELECT protocol, seed, "partition", count(*) AS rows, count_if(label = 1) AS positive_rows,
    count_if(label = 0) AS negative_rows, count(DISTINCT hostname_ascii) AS hosts, count(DISTINCT site_key_private) AS sites FROM grid GROUP BY ALL""")
def g23(t: Tables):
    return S.split_summary(grid(t), ["protocol", "seed"], "partition", "label", "hostname_ascii", "site_key_private")


@query("sp08_residual_overlap", f"""{grid_sql()}, ov AS (SELECT protocol, seed, site_key_private, bool_or("partition" = 'train') AS a, bool_or("partition" = 'validation') AS b,
      bool_or("partition" = 'test') AS c FROM grid GROUP BY ALL)
    SELECT protocol, seed, count_if(a AND b) AS train_validation, count_if(a AND c) AS train_test, count_if(b AND c) AS validation_test FROM ov GROUP BY ALL""")
def sp08o(t: Tables):
    """Private sites that the partitions of each split still share."""
    return S.key_overlap(grid(t), "site_key_private", by=["protocol", "seed"])


@query("sp09_validate_split", f"""WITH {ORDERS_SQL}, {prefix_sql('ord', 'site')} SELECT "partition", count(*) AS rows, count_if(label = 1) AS positive_rows,
    count_if(label = 0) AS negative_rows, count(DISTINCT site) AS groups, count(DISTINCT CASE WHEN label = 1 THEN site END) AS positive_sites,
    count(DISTINCT CASE WHEN label = 0 THEN site END) AS negative_sites FROM splitted GROUP BY 1""")
def sp09(t: Tables):
    return S.validate_split(S.split_group_prefix(t.orders(), "site", 42), "site", "label", "site")


OVERLAP_SQL = """ov AS (SELECT site, bool_or("partition" = 'train') AS a, bool_or("partition" = 'validation') AS b,
    bool_or("partition" = 'test') AS c FROM splitted GROUP BY 1)"""


@query("o02_key_overlap", f"""WITH {ORDERS_SQL}, {split_sql('ord', 'id', 'label', 42)}, {OVERLAP_SQL}
    SELECT count_if(a AND b) AS train_validation, count_if(a AND c) AS train_test, count_if(b AND c) AS validation_test FROM ov""")
def o02(t: Tables):
    return S.key_overlap(S.split_stratified(t.orders(), "id", "label", 42), "site")


CAP_SQL = f"""cap AS (SELECT *, row_number() OVER (PARTITION BY label, site ORDER BY {sql_h60("'cap'", "id")}, id) AS cap_rank FROM ord)"""


def capped(t: Tables):
    return t.orders().select("id", "label", "site", h60("cap", F.col("id")).alias("hash"))


@query("sp10_cap", f"WITH {ORDERS_SQL}, {CAP_SQL} SELECT id, label, site FROM cap WHERE cap_rank <= 5")
def sp10(t: Tables):
    return S.cap_per_group(capped(t), ["label", "site"], ["hash", "id"], 5).drop("hash")


@query("sp10_cap_hot_site", f"""{GROUPED_SQL}, c AS (SELECT record_id, label, site_key_private, row_number() OVER (PARTITION BY label, site_key_private
    ORDER BY sha256(normalized_url), record_id) AS i FROM grouped) SELECT record_id, label, site_key_private FROM c WHERE i <= 10""")
def sp10h(t: Tables):
    rows = t.grouped().select("record_id", "label", "site_key_private", "normalized_url_hash")
    return S.cap_per_group(rows, ["label", "site_key_private"], ["normalized_url_hash", "record_id"], 10).drop("normalized_url_hash")


@query("w01_cap_rank", f"WITH {ORDERS_SQL}, {CAP_SQL} SELECT id, cap_rank FROM cap")
def w01(t: Tables):
    return R.cap_rank(capped(t), ["label", "site"], ["hash", "id"]).select("id", "cap_rank")


@query("sp11_apply_cap", f"""WITH {ORDERS_SQL}, {CAP_SQL}, {split_sql('ord', 'id', 'label', 42)}
    SELECT id, "partition" FROM splitted WHERE id IN (SELECT id FROM cap WHERE cap_rank <= 5)""")
def sp11(t: Tables):
    split = S.split_stratified(t.orders(), "id", "label", 42).select("id", "partition")
    return S.apply_cap(split, S.cap_per_group(capped(t), ["label", "site"], ["hash", "id"], 5), "id")


@query("sp12_hash_subset", f"""WITH {ORDERS_SQL} SELECT id FROM ord ORDER BY {sql_h60("'SUBSET_V1'", "id")}, id LIMIT 16""")
def sp12(t: Tables):
    return S.hash_subset(t.orders(), "id", "SUBSET_V1", 16).select("id")


_STRATUM = "CASE WHEN id % 3 = 0 THEN 'right' ELSE 'wrong' END || '/' || CASE WHEN label = 1 THEN 'right' ELSE 'wrong' END"


@query("sp13_examples_per_stratum", f"""WITH {ORDERS_SQL}, s AS (SELECT id, {_STRATUM} AS stratum FROM ord),
    r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {sql_h60("'EX_V1'", "id")}, id) AS i FROM s) SELECT id, stratum FROM r WHERE i <= 2""")
def sp13(t: Tables):
    rows = t.orders().select("id", (F.col("id") % 3 == 0).alias("a"), (F.col("label") == 1).alias("c"))
    return S.examples_per_stratum(rows, "id", "a", "c", "EX_V1", 2).select("id", "stratum")


@query("sp14_common_cohort", f"""WITH {ORDERS_SQL}, {split_sql('ord', 'id', 'label', 42)},
    {prefix_sql('ord', 'site').replace('splitted', 'splitted2')}
    SELECT id, 'test' AS partition_a, 'test' AS partition_c FROM splitted JOIN splitted2 USING (id)
    WHERE splitted."partition" = 'test' AND splitted2."partition" = 'test'""")
def sp14(t: Tables):
    a = S.split_stratified(t.orders(), "id", "label", 42)
    return S.common_cohort(a, S.split_group_prefix(t.orders(), "site", 42), "id")


QUARANTINE_SQL = PARSED_SQL + """, dns AS (SELECT *, sha256(normalized_url) AS h FROM parsed
      WHERE parse_status IN ('VALID_PUBLIC_DNS_URL', 'VALID_PRIVATE_SUFFIX_URL')),
    kept AS (SELECT * FROM dns WHERE h NOT IN (SELECT h FROM dns GROUP BY 1 HAVING count(DISTINCT label) > 1)
      AND site_key_private NOT IN (SELECT site_key_private FROM dns GROUP BY 1 HAVING count(DISTINCT label) > 1))"""


def eligible_rows(t: Tables):
    from siteval.operators.parsing import eligible_dns
    # parsed once and written: quarantine reads the rows three times
    rows = R.checkpointed(eligible_dns(t.parsed()).select(
        "record_id", "label", "site_key_private", "normalized_url_hash"))
    return S.quarantine(rows, "normalized_url_hash", "site_key_private", "label")


@query("sp15_quarantine", f"{QUARANTINE_SQL} SELECT record_id, label, site_key_private FROM kept")
def sp15(t: Tables):
    return eligible_rows(t).drop("normalized_url_hash")


@query("sp16_dedup", f"""{QUARANTINE_SQL}, d AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY label, site_key_private, record_id) AS i FROM kept)
    SELECT record_id, label, site_key_private FROM d WHERE i = 1""")
def sp16(t: Tables):
    return S.dedup(eligible_rows(t), "normalized_url_hash", ["label", "site_key_private", "record_id"]).drop("normalized_url_hash")


@query("sp16_build_corpus", f"""{QUARANTINE_SQL}, d AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY label, site_key_private, record_id) AS i FROM kept),
    c AS (SELECT *, row_number() OVER (PARTITION BY label, site_key_private ORDER BY h) AS j FROM d WHERE i = 1) SELECT record_id, label, site_key_private FROM c WHERE j <= 5""")
def sp16c(t: Tables):
    """Union, parse, quarantine, dedup and cap as one plan."""
    raw = t.urls()
    halves = [raw.where(F.col("record_id") % 2 == r) for r in (0, 1)]
    return build_corpus(halves, t.rules, caps=(5,))["cap5"].select("record_id", "label", "site_key_private")


@query("sp17_composite_dedup", f"""WITH {CAPTURES_SQL}, twice AS (SELECT * FROM captures UNION ALL SELECT * FROM captures WHERE record_id % 10 = 0)
    SELECT DISTINCT urlkey, crawl_timestamp, record_id, status FROM twice""")
def sp17(t: Tables):
    c = t.captures()
    twice = c.unionByName(c.where("record_id % 10 = 0"))
    return S.dedup(twice, ["urlkey", "crawl_timestamp", "record_id"], ["status"]).select("urlkey", "crawl_timestamp", "record_id", "status")


@query("sp18_exclude_shorteners", f"{PARSED_SQL} SELECT label, count(*) AS n_rows FROM parsed WHERE NOT coalesce(is_shortener, FALSE) GROUP BY 1")
def sp18(t: Tables):
    return S.exclude(t.parsed(), "is_shortener").groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"))


# ---------------------------------------------------------------- sources and projections

_CONST = {"source_name": "orders feed", "source_license": "open", "acquisition_date": "2026-01-01"}


@query("p01_p03_normalize_source", f"""SELECT {", ".join(
    {"record_id": "'pt:' || o_orderkey AS record_id", "raw_url": "'http://c' || o_custkey || '.com/' AS raw_url", "label": "1 AS label",
     "target": "o_orderpriority AS target", "tranco_rank": "CAST(NULL AS INTEGER) AS tranco_rank",
     **{k: f"'{v}' AS {k}" for k, v in _CONST.items()}}.get(c, f"CAST(NULL AS VARCHAR) AS {c}") for c in CANONICAL_COLUMNS)} FROM orders""")
def p01(t: Tables):
    d = t.read("orders").select(F.concat(F.lit("pt:"), "o_orderkey").alias("rid"), F.col("o_orderpriority").alias("tg"),
                                F.concat(F.lit("http://c"), "o_custkey", F.lit(".com/")).alias("u"), F.lit(1).alias("y"))
    return N.normalize_source(d, {"record_id": "rid", "raw_url": "u", "label": "y", "target": "tg"}, _CONST)


@query("p02_o03_union_sources", """SELECT record_id, label, tranco_rank FROM (
    SELECT 'pt:' || o_orderkey AS record_id, 1 AS label, CAST(NULL AS INTEGER) AS tranco_rank FROM orders
    UNION ALL SELECT 'cc:' || lpad(CAST(c_custkey AS VARCHAR), 7, '0'), 0, CAST(c_custkey + 1 AS INTEGER) FROM customer)""")
def p02(t: Tables):
    a = t.read("orders").select(F.concat(F.lit("pt:"), "o_orderkey").alias("rid"), F.lit(1).alias("y"))
    b = N.with_record_id(t.read("customer"), "cc:", 7, ["c_custkey"], "rid").select(
        "rid", F.lit(0).alias("y"), (F.col("c_custkey") + 1).alias("rk"))
    one = N.normalize_source(a, {"record_id": "rid", "label": "y"}, {})
    two = N.normalize_source(b, {"record_id": "rid", "label": "y", "tranco_rank": "rk"}, {})
    return one.unionByName(two).select("record_id", "label", "tranco_rank")


@query("p04_record_id", """SELECT event_id, 'cc:' || lpad(CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS VARCHAR), 7, '0') AS record_id FROM events""")
def p04(t: Tables):
    return N.with_record_id(t.read("events").select("event_id", "ts"), "cc:", 7, ["ts", "event_id"]).select("event_id", "record_id")


@query("p05_format_frame", f"""WITH {RANKED_SQL} SELECT printf('tfv1:%06d', rank) AS selection_row_id, rank AS tranco_rank, domain AS tranco_domain,
    42 AS selection_seed, {_BAND_SQL} AS rank_band FROM ranked""")
def p05(t: Tables):
    return N.format_frame(t.ranked(), "rank", "domain", BANDS, 42)


@query("p07_labelled", f"{PARSED_SQL} SELECT record_id, label FROM parsed WHERE label IN (0, 1) AND coalesce(site_key_private, '') <> ''")
def p07(t: Tables):
    return N.labelled(t.parsed(), "site_key_private", "label").select("record_id", "label")


@query("p09_filter_captures", f"""WITH {CAPTURES_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY site, urlkey ORDER BY crawl_timestamp, record_id) AS i
      FROM captures WHERE status = '200' AND mime = 'text/html'),
    b AS (SELECT * EXCLUDE (i), row_number() OVER (PARTITION BY site ORDER BY urlkey, crawl_timestamp, record_id) AS j FROM a WHERE i = 1)
    SELECT site, urlkey, crawl_timestamp, record_id FROM b WHERE j <= 10""")
def p09(t: Tables):
    d = A.filter_captures(t.captures(), "site", "urlkey", ["crawl_timestamp", "record_id"], 10)
    return d.select("site", "urlkey", "crawl_timestamp", "record_id")


@query("p10_partition_filter", f"""WITH {ORDERS_SQL}, {split_sql('ord', 'id', 'label', 42)} SELECT id FROM splitted WHERE "partition" = 'test'""")
def p10(t: Tables):
    return S.split_stratified(t.orders(), "id", "label", 42).where(F.col("partition") == "test").select("id")


@query("p11_cap_flag", f"""WITH {ORDERS_SQL}, {CAP_SQL} SELECT id, cap_rank <= 10 AS in_class_cap10, cap_rank <= 5 AS in_class_cap5 FROM cap WHERE cap_rank <= 10""")
def p11(t: Tables):
    d = R.first_per_group(capped(t), ["label", "site"], [F.col("hash"), F.col("id")], 10, "cap_rank")
    d = d.withColumns({"in_class_cap10": F.col("cap_rank") <= 10, "in_class_cap5": F.col("cap_rank") <= 5})
    return d.where("in_class_cap10").select("id", "in_class_cap10", "in_class_cap5")


@query("p12_start_at", f"""WITH {RANKED_SQL} SELECT printf('tfv1:%06d', rank) AS selection_row_id FROM ranked WHERE rank >= 700""")
def p12(t: Tables):
    return N.start_at(N.format_frame(t.ranked(), "rank", "domain", BANDS, 42), "selection_row_id", "tfv1:000700").select("selection_row_id")


@query("p16_redact", """SELECT o_orderkey, sha256(CAST(o_custkey AS VARCHAR)) AS o_custkey FROM orders""")
def p16(t: Tables):
    d = N.redact(t.read("orders").select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_custkey"])
    return N.redact(d, ["o_orderstatus"], "drop")


@query("s01_s06_scan_columns", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 100000")
def s01(t: Tables):
    return t.read("orders").where(F.col("o_totalprice") > 100000).select("o_orderkey", "o_orderstatus")


def _csv(t: Tables, df, codec: str | None = None, header: bool = True) -> str:
    path = t.scratch("csv")
    writer = df.write.option("header", header)
    (writer.option("compression", codec) if codec else writer).csv(path)
    return path


@query("s02_csv_bz2", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders")
def s02(t: Tables):
    df = t.read("orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return SR.read_csv(t.spark, _csv(t, df, "bzip2"), df.schema)


@query("s07_csv_sink_columns", "SELECT o_orderkey, o_orderpriority FROM orders")
def s07(t: Tables):
    df, path = t.read("orders").select("o_orderkey", "o_orderpriority", "o_orderstatus"), t.scratch("csv")
    SK.write_table(df, path)
    return SR.read_csv(t.spark, path, df.schema, ["o_orderkey", "o_orderpriority"])


@query("s03_ranked_list", f"WITH {RANKED_SQL} SELECT rank, lower(domain) AS domain FROM ranked WHERE rank BETWEEN 100 AND 700")
def s03(t: Tables):
    return SR.read_ranked_list(t.spark, _csv(t, t.ranked(), header=False), 100, 700)


@query("s04_corpus_jsonl", "SELECT 'r' || page_id AS combined_row_id, url AS raw_url FROM pages")
def s04(t: Tables):
    path = t.scratch("jsonl")
    rows = t.read("pages").select(F.concat(F.lit("r"), "page_id").alias("combined_row_id"), F.col("url").alias("raw_url"))
    rows.write.json(path)
    return SR.read_corpus_jsonl(t.spark, path).select("combined_row_id", "raw_url")


@query("s05_crawl_index", f"""WITH {CAPTURES_SQL} SELECT CAST(site AS VARCHAR) AS site_frame_id, 'CC-1' AS crawl_id, urlkey, crawl_timestamp, status, mime,
    mime AS mime_detected, CAST(record_id AS VARCHAR) AS record_id, 'f' || site AS warc_filename FROM captures""")
def s05(t: Tables):
    path = t.scratch("crawl")
    c = t.captures().select(
        F.col("site").cast("string").alias("site_frame_id"), "urlkey", F.col("crawl_timestamp").alias("timestamp"), "status", "mime",
        F.col("mime").alias("mime-detected"), F.col("record_id").cast("string").alias("recordid"), F.concat(F.lit("f"), "site").alias("filename"))
    c.write.json(path)
    return SR.read_crawl_index(t.spark, path, "CC-1").select(
        "site_frame_id", "crawl_id", "urlkey", "crawl_timestamp", "status", "mime", "mime_detected", "record_id", "warc_filename")


@query("s08_chunk_sink", f"WITH {CAPTURES_SQL} SELECT CAST(site AS INTEGER) AS site, urlkey, record_id FROM captures")
def s08(t: Tables):
    path = t.scratch("chunks")
    SK.write_chunks(t.captures().select("site", "urlkey", "record_id"), path, "site")
    return t.spark.read.schema("urlkey string, record_id bigint, site int").json(path)


@query("s09_summary_sink", """SELECT '{"n":' || count(*) || ',"status":"' || o_orderstatus || '"}' AS doc FROM orders GROUP BY o_orderstatus""")
def s09(t: Tables):
    path = t.scratch("summary")
    SK.write_summary(t.read("orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n")), path)
    return t.spark.read.text(path).toDF("doc")


@query("s11_s12_i01_registered_inputs", """SELECT 'E' || (o_orderkey % 3) AS experiment_id, count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1""")
def s12(t: Tables):
    """Written inputs, registered by digest and row count, loaded in one scan."""
    root, o, entries = t.scratch("registered"), t.read("orders"), None
    for i in range(3):
        part = o.where(F.col("o_orderkey") % 3 == i).select("o_orderkey")
        part.coalesce(1).write.option("header", True).csv(f"{root}/E{i}")
        seen = SR.digest_files(t.spark, f"{root}/E{i}/*.csv").select(
            "path", F.lit(f"E{i}").alias("experiment_id"), "sha256", F.lit(part.count()).cast("bigint").alias("rows"))
        entries = seen if entries is None else entries.unionByName(seen)
    rows = SR.load_registered(t.spark, entries, "o_orderkey bigint")
    return rows.groupBy("experiment_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("o_orderkey").alias("keys"))


# ---------------------------------------------------------------- joins

@query("j01_one_to_one", "SELECT doc_id, source, quality FROM documents JOIN labels USING (doc_id)")
def j01(t: Tables):
    docs = t.read("documents").select("doc_id", "source")
    return J.join_one_to_one(docs, t.read("labels").select("doc_id", "quality"), "doc_id")


@query("j02_restrict", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def j02(t: Tables):
    return J.restrict(t.read("documents").select("doc_id", "source"), t.read("labels"), "doc_id")


@query("j02_missing_ids", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j02m(t: Tables):
    return J.missing_ids(t.read("labels"), t.read("documents"), "doc_id")


@query("j03_align", """SELECT doc_id, source, quality, d.n_chars AS n_chars FROM documents d JOIN labels USING (doc_id)""")
def j03(t: Tables):
    d = t.read("documents")
    return J.align([d.select("doc_id", "source"), t.read("labels").select("doc_id", "quality"), d.select("doc_id", "n_chars")], "doc_id")


@query("j04_flag_seen", f"""WITH {ORDERS_SQL}, {split_sql('ord', 'id', 'label', 42)} SELECT id, site IN (SELECT site FROM splitted WHERE "partition" = 'train') AS seen
    FROM splitted WHERE "partition" = 'test'""")
def j04(t: Tables):
    s = S.split_stratified(t.orders(), "id", "label", 42).select("id", "site", "partition")
    return J.flag_seen(s.where("partition = 'test'"), s.where("partition = 'train'"), "site").select("id", "seen")


@query("j05_remove_keys", """SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def j05(t: Tables):
    bad = t.read("customer").where(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("o_custkey"))
    return J.remove_keys(t.read("orders").select("o_orderkey", "o_custkey"), bad, "o_custkey").select("o_orderkey")


@query("j06_assign", """SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def j06(t: Tables):
    m = t.read("customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return J.assign(t.read("orders").select("o_orderkey", "o_custkey"), m, "o_custkey").drop("o_custkey")


@query("j07_composite_lookup", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderstatus AS st FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def j07(t: Tables):
    dim = t.read("orders").select(F.lit("A").alias("regime"), F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("st"))
    rows = t.read("lineitem").select(F.lit("A").alias("regime"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return J.lookup(rows, dim, ["regime", "l_orderkey"]).drop("regime")


@query("j08_lookup_count", """SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders
    WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey""")
def j08(t: Tables):
    freq = t.read("orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return J.lookup_count(t.read("customer").select("c_custkey"), freq, "c_custkey", "n")


_ALL_BANDS = [*BANDS, (1401, 1_000_000_000)]


@query("j13_e13_rank_band", f"WITH {RANKED_SQL} SELECT rank, coalesce({_BAND_SQL}, '1401-1000000000') AS rank_band FROM ranked")
def j13(t: Tables):
    from siteval.operators.errors import rank_band
    return rank_band(t.ranked().select("rank"), "rank", _ALL_BANDS)


@query("j14_reconcile", """WITH a AS (SELECT o_orderstatus AS k, avg(o_totalprice) AS v FROM orders GROUP BY 1),
    b AS (SELECT o_orderstatus AS k, sum(o_totalprice) / count(*) + CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS v FROM orders GROUP BY 1)
    SELECT a.k, round(a.v, 4) AS value, round(b.v, 4) AS recorded, round(abs(a.v - b.v), 4) AS abs_diff, abs(a.v - b.v) <= 0.000001 AS within FROM a JOIN b ON a.k = b.k""")
def j14(t: Tables):
    o = t.read("orders").groupBy(F.col("o_orderstatus").alias("k"))
    shift = F.when(F.col("k") == "P", 1).otherwise(0)
    b = o.agg((F.sum("o_totalprice") / F.count(F.lit(1))).alias("v")).withColumn("v", F.col("v") + shift)
    d = J.reconcile(o.agg(F.avg("o_totalprice").alias("v")), b, "k", "v")
    return d.withColumns({c: F.round(c, 4) for c in ("value", "recorded", "abs_diff")})


@query("j15_check_ledger", f"""WITH {LEDGER_SQL} SELECT ordinal, 'u' || ordinal AS frame_key, CASE WHEN ordinal % 50 = 7 THEN 'x' ELSE 'u' || ordinal END AS ledger_key
    FROM ledger WHERE ordinal % 50 = 7""")
def j15(t: Tables):
    led = t.ledger()
    key = F.concat(F.lit("u"), "ordinal")
    frame = led.select("ordinal", key.alias("k"))
    other = led.select("ordinal", F.when(F.col("ordinal") % 50 == 7, "x").otherwise(key).alias("k"))
    return J.check_ledger(frame, other, "ordinal", "k")


# ---------------------------------------------------------------- windows and sets

@query("w02_group_total", """WITH c AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL)
    SELECT *, CAST(sum(n) OVER (PARTITION BY o_custkey) AS BIGINT) AS total FROM c""")
def w02(t: Tables):
    c = t.read("orders").groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return R.with_group_total(c, ["o_custkey"], "n", "total")


@query("w03_running_total", """WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
    SELECT *, CAST(sum(n) OVER (ORDER BY n DESC, o_custkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM c""")
def w03(t: Tables):
    c = t.read("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return R.running_total(c, [F.desc("n"), F.asc("o_custkey")], "n")


@query("w04_average_rank", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, rank() OVER (ORDER BY -l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS avg_rank FROM lineitem""")
def w04(t: Tables):
    d = t.spread(t.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    return R.average_rank(d, -F.abs("l_quantity")).drop("l_quantity")


@query("w08_budget_cut", f"""WITH {LEDGER_SQL}, r AS (SELECT *, sum(records) OVER (ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS s,
    row_number() OVER (ORDER BY ordinal) AS i FROM ledger) SELECT ordinal, records FROM r WHERE s - records < 5000 AND i <= 120""")
def w08(t: Tables):
    return R.budget_cut(t.ledger().select("ordinal", "records"), "ordinal", "records", 5000, 120)


@query("w10_ordinal", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS p, row_number() OVER
    (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS ordinal FROM lineitem""")
def w10(t: Tables):
    d = t.read("lineitem").select("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("p"))
    return R.ordinal(d, [F.col(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p")]).drop("l_shipdate")


@query("o04_same_ids", """SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels)) AS only_left,
    (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT ALL SELECT doc_id FROM documents)) AS only_right,
    (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels)) = 0 AND
    (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT ALL SELECT doc_id FROM documents)) = 0 AS equal""")
def o04(t: Tables):
    return I.same_ids(t.read("documents"), t.read("labels"), "doc_id")


@query("o05_set_overlap", """WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 45)
    SELECT (SELECT count(*) FROM a) AS size_a, (SELECT count(*) FROM b) AS size_b, (SELECT count(*) FROM a JOIN b USING (k)) AS intersection,
    (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)) AS "union",
    round((SELECT count(*) FROM a JOIN b USING (k)) / (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)), 6) AS jaccard""")
def o05(t: Tables):
    li = t.read("lineitem")
    a = li.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("k"))
    return rounded(set_overlap(a, li.where("l_quantity > 45").select(F.col("l_partkey").alias("k")), "k"), "jaccard")


@query("o08_largest_change", """SELECT o_orderkey, o_totalprice - 200000 AS delta FROM orders ORDER BY abs(o_totalprice - 200000) DESC, o_orderkey LIMIT 10""")
def o08(t: Tables):
    d = t.read("orders").select("o_orderkey", (F.col("o_totalprice") - 200000).alias("delta"))
    return largest_change(d, "delta", 10, ["o_orderkey"])


@query("o09_total_order", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer ORDER BY c_nationkey, c_acctbal DESC, c_custkey")
def o09(t: Tables):
    return t.read("customer").select("c_custkey", "c_nationkey", "c_acctbal").orderBy("c_nationkey", F.desc("c_acctbal"), "c_custkey")


# ---------------------------------------------------------------- integrity

@query("i02_checks", """SELECT 'keys' AS check_id, 'order keys present' AS requirement, count_if(o_orderkey IS NULL) AS violations, 'PASS' AS status FROM orders
    UNION ALL SELECT 'price', 'price above 1000', count_if(o_totalprice <= 1000), CASE WHEN count_if(o_totalprice <= 1000) = 0 THEN 'PASS' ELSE 'FAIL' END FROM orders""")
def i02(t: Tables):
    return I.run_checks(t.read("orders"), {
        "keys": ("order keys present", F.count_if(F.col("o_orderkey").isNull())),
        "price": ("price above 1000", F.count_if(F.col("o_totalprice") <= 1000))})


@query("i03_unique", """WITH c AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS keys, count_if(n > 1) AS repeated_keys, count_if(n > 1) = 0 AS "unique" FROM c""")
def i03(t: Tables):
    return I.check_unique(t.read("lineitem"), ["l_orderkey", "l_linenumber"])


# Rows that break the rules: some are left out, some occur twice, some come from outside.
@query("i04_partitions", """WITH v AS (SELECT count_if(o_orderkey % 50 = 7 AND o_orderkey % 40 <> 3) AS twice,
      count_if(o_orderkey % 40 = 3) AS missing, count_if(o_orderkey % 60 = 11 AND o_orderkey % 40 <> 3) AS outside FROM orders),
    c AS (SELECT unnest([{'check_id': 'exclusive', 'requirement': 'a row has one partition', 'violations': twice},
      {'check_id': 'single', 'requirement': 'a row occurs once', 'violations': twice},
      {'check_id': 'complete', 'requirement': 'every corpus row is assigned', 'violations': missing},
      {'check_id': 'closed', 'requirement': 'no row from outside the corpus', 'violations': outside}], recursive := true) FROM v)
    SELECT *, CASE WHEN violations = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM c""")
def i04(t: Tables):
    kept = S.split_stratified(t.orders(), "id", "label", 42).where("id % 40 <> 3")
    twice = kept.where("id % 50 = 7").withColumn("partition", F.lit("extra"))
    outside = kept.where("id % 60 = 11").withColumn("id", -F.col("id"))
    return I.check_partitions(kept.unionByName(twice).unionByName(outside), t.orders(), "id")


@query("i05_disjoint", """WITH v AS (SELECT count(DISTINCT o_custkey) FILTER (o_custkey % 30 = 5) AS n FROM orders),
    c AS (SELECT unnest([{'check_id': 'train_validation', 'requirement': 'no key shared by train and validation', 'violations': n},
      {'check_id': 'train_test', 'requirement': 'no key shared by train and test', 'violations': n},
      {'check_id': 'validation_test', 'requirement': 'no key shared by validation and test', 'violations': n}], recursive := true) FROM v)
    SELECT *, CASE WHEN violations = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM c""")
def i05(t: Tables):
    split = S.split_group_prefix(t.orders(), "site", 42)
    names = F.explode(F.array(*map(F.lit, ("train", "validation", "test")))).alias("partition")
    everywhere = split.where("site % 30 = 5").drop("partition").select("*", names)
    return I.check_disjoint(S.key_overlap(split.unionByName(everywhere), "site"))


@query("i08_fingerprint", """WITH h AS (SELECT sha256(o_orderkey || '|' || o_custkey || '|' || o_orderstatus) AS h FROM orders),
    b AS (SELECT substr(h, 1, 6) AS b, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS x FROM h GROUP BY 1),
    p AS (SELECT substr(b, 1, 3) AS p, sum(n) AS n, sha256(string_agg(x, '' ORDER BY b)) AS x FROM b GROUP BY 1)
    SELECT CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(x, '' ORDER BY p)) AS fingerprint FROM p""")
def i08(t: Tables):
    return I.fingerprint(t.read("orders"), "o_orderkey", ["o_custkey", "o_orderstatus"])


@query("i09_finite", """SELECT 'l_tax' AS check_id, 'all values finite' AS requirement, count_if(l_tax IS NULL OR isnan(l_tax) OR isinf(l_tax)) AS violations, 'PASS' AS status FROM lineitem
    UNION ALL SELECT 'ratio', 'all values finite', count_if(l_tax = 0), 'FAIL' FROM lineitem""")
def i09(t: Tables):
    d = t.read("lineitem").withColumn("ratio", F.when(F.col("l_tax") != 0, 1 / F.col("l_tax")).otherwise(float("inf")))
    return I.check_finite(d, ["l_tax", "ratio"])


@query("i10_result_manifest", """WITH r AS (SELECT o_orderpriority AS phase, o_orderstatus AS metric, count(*) AS value FROM orders GROUP BY ALL)
    SELECT printf('R%04d', row_number() OVER (ORDER BY phase, metric)) AS result_id, phase, metric, value,
    CASE WHEN phase < '3' THEN 'Q1' END AS question, CASE WHEN metric = 'P' THEN NULL ELSE CAST(value - 1 AS DOUBLE) END AS uncertainty_lower,
    CASE WHEN metric = 'P' THEN NULL ELSE CAST(value + 1 AS DOUBLE) END AS uncertainty_upper,
    CASE WHEN metric = 'P' THEN 'NONE' ELSE 'INTERVAL' END AS uncertainty_type FROM r""")
def i10(t: Tables):
    o = t.read("orders")
    r = o.groupBy(F.col("o_orderpriority").alias("phase"), F.col("o_orderstatus").alias("metric")).agg(F.count(F.lit(1)).alias("value"))
    text = F.concat(F.lit("ci ["), F.col("value") - 1, F.lit(", "), F.col("value") + 1, F.lit("]"))
    inv = r.withColumn("uncertainty", F.when(F.col("metric") == "P", "").otherwise(text))
    q = o.select(F.col("o_orderpriority").alias("phase")).distinct().where("phase < '3'").withColumn("question", F.lit("Q1"))
    return I.result_manifest(inv, q, ["phase", "metric"])


@query("i11_site_count_table", f"""{GROUPED_SQL}, f AS (SELECT 'private' AS grouping, site_key_private AS k, bool_or(label = 0) AS n, bool_or(label = 1) AS p FROM grouped GROUP BY ALL
      UNION ALL SELECT 'icann', site_key_icann, bool_or(label = 0), bool_or(label = 1) FROM grouped WHERE site_key_icann <> '' GROUP BY ALL)
    SELECT grouping, count_if(n) AS negative_sites, count_if(p) AS positive_sites, count(*) AS union_sites, count_if(n AND p) AS intersection_sites FROM f GROUP BY 1""")
def i11(t: Tables):
    g = R.checkpointed(t.grouped().select("label", "site_key_private", "site_key_icann"))
    return I.table_site_counts({"private": A.site_accounting(g, "site_key_private", "label"),
                                "icann": A.site_accounting(g, "site_key_icann", "label")})

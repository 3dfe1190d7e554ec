"""Registered queries: publication tables, registries, provenance, contracts."""

from __future__ import annotations

import functools
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteval.functions.features import ABLATIONS, FEATURES, ablation_features, url_features
from siteval.functions.hashing import h60
from siteval.operators import audit as A
from siteval.operators import bootstrap as B
from siteval.operators import integrity as I
from siteval.operators import metrics as K
from siteval.operators import models as M
from siteval.operators import ranking as R
from siteval.operators import splits as S
from siteval.plans.corpus import PROFILE_COLUMNS, build_corpus, corpus_profiles, profile_values
from siteval.plans.queries_corpus import _CAPS_SQL, CAPS, QUARANTINE_SQL, exposure_sql, prefix_sql, split_sql
from siteval.plans.queries_scores import _MCC, CELLS_SQL, EXP, PURE, REPLICATE_SQL, SCORED, a10, mcc_long
from siteval.plans.queries_urls import _SQL_NAME, FEATURES_SQL
from siteval.plans.registry import ORACLES, query
from siteval.plans.tables import GROUPED_SQL, SEEDS, Tables, sql_h60
from siteval.sources import readers as SR


def together(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(lambda a, b: a.unionByName(b), parts)


def printed(value: str, digits: int = 3) -> str:
    return f"printf('%.{digits}f', round_even({value}, {digits}))"


# ---------------------------------------------------------------- publication tables

_CAP_RANK = f"row_number() OVER (PARTITION BY label, {{site}} ORDER BY {sql_h60(chr(39) + 'cap' + chr(39), '{id}')}, {{id}}) AS cap_rank"
_SHARE = "max(CASE WHEN cell = variant || '/{0}' AND class = '{1}' THEN " + printed("site_seen_pct", 1) + " END) AS {0}_{2}"


@query("i11_exposure_table", f"""{GROUPED_SQL}, g AS (SELECT record_id, label, hostname_ascii, site_key_private, {_CAP_RANK.format(site='site_key_private', id='record_id')} FROM grouped),
    sa AS (WITH {split_sql('g', 'record_id', 'label', 42)} SELECT *, 'A' AS regime FROM splitted),
    sc AS (WITH {prefix_sql('g', 'site_key_private')} SELECT *, 'C' AS regime FROM splitted),
    cells AS (SELECT b.* EXCLUDE (cap_rank, regime), variant || '/' || regime AS cell FROM (SELECT * FROM sa UNION ALL BY NAME SELECT * FROM sc) b
      JOIN (VALUES {_CAPS_SQL}) AS c(variant, k) ON k IS NULL OR cap_rank <= k),
    ex AS (WITH {exposure_sql('cells', 'cell')}), named AS (SELECT *, split_part(cell, '/', 1) AS variant FROM ex)
    SELECT variant, {', '.join(_SHARE.format(r, c, n) for r in 'AC' for c, n in (('0', 'negative'), ('1', 'positive')))} FROM named GROUP BY variant""")
def i11_exposure(t: Tables):
    """T3: seen sites of a random and a site-disjoint split, whole and filtered by either cap."""
    rows = R.checkpointed(t.grouped().select("record_id", "label", "hostname_ascii", "site_key_private", h60("cap", F.col("record_id")).alias("_h")))
    a = S.split_stratified(rows, "record_id", "label", 42).withColumn("regime", F.lit("A"))
    c = S.split_group_prefix(rows, "site_key_private", 42).withColumn("regime", F.lit("C"))
    frozen = R.checkpointed(a.unionByName(c.select(*a.columns)).drop("_h"))

    def variant(name: str, k: int | None) -> DataFrame:
        kept = frozen if k is None else S.apply_cap(
            frozen, S.cap_per_group(rows, ["label", "site_key_private"], ["_h", "record_id"], k), "record_id")
        return kept.withColumn("variant", F.lit(name))

    cells = R.checkpointed(together([variant(n, k) for n, k in CAPS.items()]))
    exposure = A.site_exposure(cells, "label", "hostname_ascii", "site_key_private", by=["variant", "regime"])
    return I.table_exposure(exposure, "regime")


_FOLD = 15  # per cent of the sites that a seed tests


@query("i11_mcc_table", f"""{PURE}, {REPLICATE_SQL}, v AS (SELECT regime, model, replicate, {_MCC} AS v FROM rc),
    d AS (SELECT a.model, a.v - c.v AS v FROM v a JOIN v c ON a.model = c.model AND a.replicate = c.replicate AND a.regime = 'A' AND c.regime = 'C'),
    ci AS (SELECT model, quantile_cont(v, 0.025) AS lower, quantile_cont(v, 0.975) AS upper FROM d GROUP BY ALL),
    {CELLS_SQL}, pt AS (SELECT regime, model, {_MCC} AS mcc FROM cells),
    gap AS (SELECT a.model, a.mcc - c.mcc AS difference FROM pt a JOIN pt c ON a.model = c.model AND a.regime = 'A' AND c.regime = 'C'),
    fold AS (SELECT * FROM scored CROSS JOIN (VALUES {', '.join(f'({s})' for s in SEEDS)}) AS s(seed) WHERE {sql_h60("'fold'", 'seed', 'site')} % 100 < {_FOLD}),
    fc AS (SELECT regime, model, seed, count_if(label = 0 AND score < 0.5) AS tn, count_if(label = 0 AND score >= 0.5) AS fp,
      count_if(label = 1 AND score < 0.5) AS fn, count_if(label = 1 AND score >= 0.5) AS tp FROM fold GROUP BY ALL),
    fm AS (SELECT regime, model, seed, {_MCC} AS mcc FROM fc),
    sm AS (SELECT regime, model, {printed('avg(mcc)')} || ' ± ' || {printed('stddev_samp(mcc)')} AS txt FROM fm GROUP BY ALL)
    SELECT model, max(CASE WHEN regime = 'A' THEN txt END) AS "A_mcc", max(CASE WHEN regime = 'C' THEN txt END) AS "C_mcc",
      {printed('any_value(difference)')} AS difference, '[' || {printed('any_value(lower)')} || ', ' || {printed('any_value(upper)')} || ']' AS "interval"
    FROM sm JOIN gap USING (model) JOIN ci USING (model) GROUP BY model""")
def i11_mcc(t: Tables):
    """T5: five seeds' test sites per experiment; difference of all rows with its interval of 2,000 replicates."""
    pred = K.with_prediction(t.scored(True))
    folds = pred.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in SEEDS])))
    folds = folds.where(F.pmod(h60("fold", F.col("seed"), F.col("site")), F.lit(100)) < _FOLD)
    seeds = A.seed_summary(K.threshold_metrics(K.confusion(folds, [*EXP, "seed"])), EXP, "seed", "mcc")
    draws = R.checkpointed(mcc_long(t))
    gaps = B.difference_ci(draws.where("regime = 'A'"), draws.where("regime = 'C'"), ["model"])
    whole = K.threshold_metrics(K.confusion(pred, EXP)).groupBy("model").agg(
        (F.max(F.when(F.col("regime") == "A", F.col("mcc"))) - F.max(F.when(F.col("regime") == "C", F.col("mcc")))).alias("difference"))
    return I.table_mcc(seeds, gaps.join(whole, "model"))  # one row per model


@query("i11_cap_table", f"""{SCORED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY regime, model, label, site ORDER BY {sql_h60("'cap'", 'id')}, id) AS cap_rank FROM scored),
    cc AS (SELECT variant, regime, model, count_if(label = 0 AND score < 0.5) AS tn, count_if(label = 0 AND score >= 0.5) AS fp,
      count_if(label = 1 AND score < 0.5) AS fn, count_if(label = 1 AND score >= 0.5) AS tp
      FROM ranked JOIN (VALUES {_CAPS_SQL}) AS c(variant, k) ON k IS NULL OR cap_rank <= k GROUP BY ALL)
    SELECT variant, regime, model, {printed(f'coalesce(({_MCC.replace(" / sqrt", ") / nullif(sqrt")}, 0), 0)')} AS mcc FROM cc""")
def i11_caps(t: Tables):
    """T6: MCC of every experiment on all rows and on those that either cap keeps."""
    rows = K.with_prediction(t.scored()).withColumn("_h", h60("cap", F.col("id")))
    kept = [rows if k is None else S.cap_per_group(rows, [*EXP, "label", "site"], ["_h", "id"], k) for k in CAPS.values()]
    keys = ["variant", *EXP]
    cells = together([K.confusion(d, EXP).withColumn("variant", F.lit(n)) for n, d in zip(CAPS, kept)])
    return I.table_fixed(K.threshold_metrics(cells), keys, ["mcc"])


@query("i11_attribution_table", f"SELECT model, metric, {printed('value')} AS value FROM ({ORACLES['a10_attribution_summary']}) AS summary")
def i11_attribution(t: Tables):
    """T8: the six named values, printed."""
    return I.table_fixed(a10(t), ["model", "metric"], ["value"])


# ---------------------------------------------------------------- artifacts

_DAILY_SQL = """daily AS (SELECT substr(o_orderpriority, 1, 1) AS artifact, strftime(o_orderdate, '%Y-%m-%d') || ',' || o_orderstatus || ',' || count(*) AS line
      FROM orders GROUP BY o_orderpriority, o_orderdate, o_orderstatus),
    written AS (SELECT artifact, string_agg(line || chr(10), '' ORDER BY line) AS body FROM daily GROUP BY 1),
    totals AS (SELECT substr(o_orderpriority, 1, 1) AS artifact, '{"rows":' || count(*) || ',"sites":' || count(DISTINCT o_custkey) || '}' || chr(10) AS body
      FROM orders GROUP BY 1)"""
_CHANGED = "3"


def _artifacts(lines: DataFrame, path: str) -> None:
    """One text file per artifact, lines in order."""
    lines = lines.repartition("artifact").sortWithinPartitions("artifact", "line")
    lines.select("artifact", "line").write.mode("errorifexists").partitionBy("artifact").text(path)


def _daily(t: Tables) -> DataFrame:
    """Counts per day and status: a file has at most a line for each."""
    o = t.read("orders").groupBy("o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderstatus").count()
    return o.select(F.substring("o_orderpriority", 1, 1).alias("artifact"), F.concat_ws(",", "day", "o_orderstatus", "count").alias("line"))


def _digests(t: Tables, root: str, name: str) -> DataFrame:
    found = SR.digest_files(t.spark, f"{root}/*/*.txt")
    return found.withColumn("path", F.concat(F.lit(f"{name}/"), F.regexp_extract("path", "artifact=([^/]+)/", 1)))


@query("i11_hash_table", f"""WITH {_DAILY_SQL} SELECT 'daily/' || artifact AS path,
    sha256(CASE WHEN artifact = '{_CHANGED}' THEN body || 'late' || chr(10) ELSE body END) AS sha256,
    CASE WHEN artifact = '{_CHANGED}' THEN 'MISMATCH' ELSE 'VERIFIED' END AS status FROM written""")
def i11_hashes(t: Tables):
    """T10: artifacts written again are verified against their recorded digests; one has got another line."""
    lines, first, again = R.checkpointed(_daily(t)), t.scratch("artifacts"), t.scratch("artifacts")
    _artifacts(lines, first)
    late = lines.where(F.col("artifact") == _CHANGED).select("artifact", F.lit("late").alias("line")).distinct()
    _artifacts(lines.unionByName(late), again)
    return I.table_hashes(I.verify_hashes(_digests(t, again, "daily"), _digests(t, first, "daily")))


@query("i12_provenance", f"""WITH {_DAILY_SQL} SELECT 'totals/' || artifact AS output, 'daily/' || artifact AS source, sha256(t.body) AS output_sha256,
    sha256(w.body) AS source_sha256 FROM written w JOIN totals t USING (artifact)""")
def i12(t: Tables):
    """Every summary with the digests of its own file and of the file of daily counts beside it."""
    source, output = t.scratch("daily"), t.scratch("totals")
    _artifacts(_daily(t), source)
    sums = t.read("orders").groupBy(F.substring("o_orderpriority", 1, 1).alias("artifact")).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("o_custkey").alias("sites"))
    _artifacts(sums.select("artifact", F.to_json(F.struct("rows", "sites")).alias("line")), output)
    outputs = R.checkpointed(_digests(t, output, "totals"))
    links = outputs.select(F.col("path").alias("output"), F.replace("path", F.lit("totals"), F.lit("daily")).alias("source"))
    return I.provenance(outputs, _digests(t, source, "daily"), links)


# ---------------------------------------------------------------- experiment registry

_CHOICES = (0.3, 0.4, 0.5, 0.6)
_REGISTRY = ["experiment_id", "regime", "model", "split_seed", "split_hash", "train_n", "validation_n", "test_n", "choice",
             "validation_mcc", "test_mcc"]


@query("i13_experiment_registry", f"""{SCORED}, srca AS (SELECT * FROM scored WHERE regime = 'A'), srcc AS (SELECT * FROM scored WHERE regime = 'C'),
    sa AS (WITH {split_sql('srca', 'id', 'model, label', 42)} SELECT * FROM splitted),
    sc AS (WITH {prefix_sql('srcc', 'site', by='model')} SELECT * FROM splitted),
    placed AS (SELECT regime, model, id, label, score, "partition" FROM sa UNION ALL BY NAME SELECT regime, model, id, label, score, "partition" FROM sc),
    h AS (SELECT regime, model, sha256(id || '|' || "partition") AS h FROM placed),
    b AS (SELECT regime, model, substr(h, 1, 6) AS b, sha256(string_agg(h, '' ORDER BY h)) AS x FROM h GROUP BY ALL),
    p AS (SELECT regime, model, substr(b, 1, 3) AS p, sha256(string_agg(x, '' ORDER BY b)) AS x FROM b GROUP BY regime, model, substr(b, 1, 3)),
    f AS (SELECT regime, model, sha256(string_agg(x, '' ORDER BY p)) AS split_hash FROM p GROUP BY ALL),
    n AS (SELECT regime, model, count_if("partition" = 'train') AS train_n, count_if("partition" = 'validation') AS validation_n,
      count_if("partition" = 'test') AS test_n FROM placed GROUP BY ALL),
    c AS (SELECT regime, model, "partition", choice, count_if(label = 0 AND score < choice) AS tn, count_if(label = 0 AND score >= choice) AS fp,
      count_if(label = 1 AND score < choice) AS fn, count_if(label = 1 AND score >= choice) AS tp
      FROM placed CROSS JOIN (SELECT unnest({list(_CHOICES)}::DOUBLE[]) AS choice) WHERE "partition" <> 'train' GROUP BY ALL),
    m AS (SELECT *, round(coalesce(({_MCC.replace(" / sqrt", ") / nullif(sqrt")}, 0), 0), 9) AS mcc FROM c),
    best AS (SELECT * FROM m WHERE "partition" = 'validation' QUALIFY row_number() OVER (PARTITION BY regime, model ORDER BY mcc DESC, choice) = 1)
    SELECT 'E-' || regime || '-' || model AS experiment_id, regime, model, 42 AS split_seed, split_hash, train_n, validation_n, test_n, choice,
      round(best.mcc, 6) AS validation_mcc, round(m.mcc, 6) AS test_mcc
    FROM best JOIN f USING (regime, model) JOIN n USING (regime, model) JOIN m USING (regime, model, choice) WHERE m."partition" = 'test'""")
def i13(t: Tables):
    """A row per experiment: split and its fingerprint, sizes, the threshold chosen on validation, both values."""
    scored, results = t.scored(), []
    for regime in ("A", "C"):
        rows = scored.where(F.col("regime") == regime)
        split = (S.split_stratified(rows, "id", "label", 42, by=["model"]) if regime == "A"
                 else S.split_group_prefix(rows, "site", 42, by=["model"]))
        split = R.checkpointed(split.select("regime", "model", "id", "label", "score", "partition"))
        for model in ("M1", "M2"):
            results.append(_registry_row(split.where(F.col("model") == model)))
    return I.registry(results, _REGISTRY)


def _registry_row(split: DataFrame) -> DataFrame:
    sizes = split.groupBy(*EXP).agg(*[F.count_if(F.col("partition") == p).alias(f"{p}_n") for p in ("train", "validation", "test")])
    tried = split.where("partition <> 'train'").withColumn("choice", F.explode(F.array(*[F.lit(c) for c in _CHOICES])))
    tried = tried.withColumn("predicted", (F.col("score") >= F.col("choice")).cast("int"))
    found = K.threshold_metrics(K.confusion(tried, [*EXP, "partition", "choice"])).withColumn("mcc", F.round("mcc", 9))
    found = R.checkpointed(found.select(*EXP, "partition", "choice", "mcc"))  # eight rows
    best = R.best_rows(found.where("partition = 'validation'"), EXP, "mcc").groupBy(*EXP).agg(
        F.min("choice").alias("choice"), F.round(F.max("mcc"), 6).alias("validation_mcc"))
    test = found.where("partition = 'test'").select(*EXP, "choice", F.round("mcc", 6).alias("test_mcc"))
    mark = I.fingerprint(split, "id", ["partition"]).select("fingerprint").scalar()
    return sizes.join(best, EXP).join(test, [*EXP, "choice"]).withColumns({
        "experiment_id": F.concat_ws("-", F.lit("E"), *EXP), "split_seed": F.lit(42), "split_hash": mark})


# ---------------------------------------------------------------- contracts and the predictor firewall

def _totals_sql() -> str:
    cells = ", ".join(f"{{'feature': '{f}', 'total': sum(CAST({_SQL_NAME.get(f, f)} AS DOUBLE))}}" for f in FEATURES)
    return f"SELECT unnest([{cells}], recursive := true) FROM features"


_SETS = {a: ablation_features(a) for a in ABLATIONS}


@query("s14_contract", f"""{FEATURES_SQL}, totals AS ({_totals_sql()}), sets(feature_set, feature) AS (VALUES {', '.join(
    f"('{a}', '{f}')" for a, fs in _SETS.items() for f in fs)})
    SELECT feature_set, count(*) AS features, round(sum(total), 4) AS total FROM sets JOIN totals USING (feature) GROUP BY feature_set""")
def s14(t: Tables):
    """Feature sets read from a settings file, and the sum of each set's features over all URLs."""
    path = t.scratch("contract")
    text = json.dumps({"feature_sets": _SETS}, indent=2)
    t.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    sets = SR.load_contract(t.spark, path, "feature_sets map<string,array<string>>")
    sets = sets.select(F.explode("feature_sets").alias("feature_set", "fs")).select("feature_set", F.explode("fs").alias("feature"))
    sums = url_features(t.parsed()).agg(*[F.sum(F.col(f).cast("double")).alias(f) for f in FEATURES])
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("total")) for f in FEATURES])).alias("c")
    return sets.join(sums.select(cells).select("c.*"), "feature").groupBy("feature_set").agg(
        F.count(F.lit(1)).alias("features"), F.round(F.sum("total"), 4).alias("total"))


_ASKED = [*FEATURES, "label", "raw_url", "normalized_url", "site_key_private"]


@query("i06_predictor_firewall", f"""{FEATURES_SQL}, v AS (SELECT count(label) AS label, count(raw_url) AS raw_url, count(normalized_url) AS normalized_url,
      count(site_key_private) AS site_key_private FROM parsed),
    c AS (SELECT unnest([{', '.join(f"{{'check_id': '{c}', 'requirement': 'may reach a model', 'violations': {c if c in M.FORBIDDEN else 'CAST(0 AS BIGINT)'}}}"
                                    for c in _ASKED)}], recursive := true) FROM v)
    SELECT *, CASE WHEN violations = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM c""")
def i06(t: Tables):
    """The 22 predictors and four columns that must not be among them: rows whose forbidden value would reach a model."""
    return M.predictor_checks(url_features(t.parsed()), _ASKED)


# ---------------------------------------------------------------- corpus audit in one run

def _tail(name: str, source: str) -> str:
    """The SQL of a registered profile over other rows."""
    return f"WITH grouped AS (SELECT * FROM {source}){ORACLES[name].removeprefix(GROUPED_SQL)}"


def _duplicates_sql(text: str, name: str) -> str:
    return (f"SELECT sha256({text}) AS {name}, count(*) AS rows, count(DISTINCT label) AS labels, count(DISTINCT source_name) AS sources, "
            "count(DISTINCT site_key_private) AS sites FROM parsed GROUP BY 1 HAVING count(*) > 1")


_PROFILES_SQL = {
    "validity": "SELECT parse_status, label, count(*) AS rows FROM parsed GROUP BY ALL",
    "exact_duplicates": _duplicates_sql("raw_url", "raw_url_hash"),
    "normalized_duplicates": _duplicates_sql("normalized_url", "normalized_url_hash"),
    "cross_label_conflicts": "SELECT record_id, label FROM parsed WHERE raw_url IN (SELECT raw_url FROM parsed GROUP BY 1 HAVING count(DISTINCT label) > 1)",
    "mixed_sites": _tail("g05_mixed_groups", "parsed WHERE coalesce(site_key_private, '') <> ''"),
    "site_multiplicity": _tail("g06_multiplicity", "eligible"),
    "host_multiplicity": _tail("g06_multiplicity", "eligible").replace("site_key_private", "hostname_ascii"),
    "concentration": _tail("g09_concentration", "eligible"),
    "suffixes": _tail("g13_suffix_by_class", "eligible"),
    "sites": _tail("g28_site_accounting", "eligible"),
}


def _long_profile_sql(name: str) -> str:
    keys, measures = PROFILE_COLUMNS[name]
    key = f"concat_ws('|', {', '.join(keys)})" if keys else "''"
    cells = ", ".join(f"{{'measure': '{m}', 'value': round(CAST({m} AS DOUBLE), 6)}}" for m in measures)
    return f"SELECT '{name}' AS profile, {key} AS key, unnest([{cells}], recursive := true) FROM ({_PROFILES_SQL[name]})"


@query("g00_corpus_audit", f"""{QUARANTINE_SQL}, firsts AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY label, site_key_private, record_id) AS i FROM kept),
    eligible AS (SELECT * FROM firsts WHERE i = 1) {" UNION ALL ".join(_long_profile_sql(n) for n in _PROFILES_SQL)}""")
def g00(t: Tables):
    """Corpus built once from two sources, and all its audit tables."""
    raw = t.urls()
    corpus = build_corpus([raw.where(F.col("record_id") % 2 == r) for r in (0, 1)], t.rules, caps=(), audited=True)
    return profile_values(corpus_profiles(corpus)).withColumn("value", F.round("value", 6))

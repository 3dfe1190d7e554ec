"""Registered queries: metrics, bootstrap, models, attribution, errors."""

from __future__ import annotations

import functools

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import functions as F

from siteval.functions.features import ABLATIONS, FEATURES, error_properties, url_features
from siteval.functions.hashing import h60, unit
from siteval.operators import attribution as T
from siteval.operators import bootstrap as B
from siteval.operators import errors as E
from siteval.operators import integrity as I
from siteval.operators import metrics as K
from siteval.operators import models as M
from siteval.operators import ranking as R
from siteval.operators import splits as S
from siteval.operators import tfidf as TF
from siteval.plans.corpus import assign_regime
from siteval.plans.experiment import run_ablation, run_experiment
from siteval.plans.queries_corpus import BANDS, _BAND_SQL, rounded, split_sql
from siteval.plans.queries_urls import ERROR_PROPS_SQL, FEATURES_SQL
from siteval.plans.registry import query
from siteval.sources.sinks import write_replicates
from siteval.plans.tables import (COEFFICIENTS_SQL, ORDERS_SQL, PHI_SQL, Tables, scored_sql, sql_h60, sql_unit)

EXP = ["regime", "model"]
SCORED = f"WITH {scored_sql()}"
PURE = f"WITH {scored_sql(True)}"
CELLS_SQL = """cells AS (SELECT regime, model, count_if(label = 0 AND score < 0.5) AS tn, count_if(label = 0 AND score >= 0.5) AS fp,
    count_if(label = 1 AND score < 0.5) AS fn, count_if(label = 1 AND score >= 0.5) AS tp FROM scored GROUP BY ALL)"""


def metric_sql(default: str = "0.0") -> str:
    d = f"coalesce({{}}, {default})" if default else "{}"
    q = lambda num, den: d.format(f"({num}) / nullif({den}, 0)")
    rec, spe = q("tp", "tp + fn"), q("tn", "tn + fp")
    return f"""round({q("tp::DOUBLE * tn - fp::DOUBLE * fn", "sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn))")}, 6) AS mcc,
      round({q("tp", "tp + fp")}, 6) AS precision, round({rec}, 6) AS recall, round({spe}, 6) AS specificity,
      round({q("fp", "tn + fp")}, 6) AS fpr, round(({rec} + {spe}) / 2, 6) AS balanced_accuracy,
      round(({q("2 * tp", "2 * tp + fp + fn")} + {q("2 * tn", "2 * tn + fp + fn")}) / 2, 6) AS macro_f1"""


THRESHOLD = list(B.THRESHOLD_METRICS)


@query("k01_confusion", f"{SCORED}, {CELLS_SQL} SELECT * FROM cells")
def k01(t: Tables):
    return K.confusion(K.with_prediction(t.scored()), EXP)


@query("k02_k08_threshold_metrics", f"{SCORED}, {CELLS_SQL} SELECT *, {metric_sql()} FROM cells")
def k02(t: Tables):
    return rounded(K.threshold_metrics(K.confusion(K.with_prediction(t.scored()), EXP)), *THRESHOLD)


GROUPS_SQL = """sg AS (SELECT regime, model, score, CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg, count(*) AS tot
      FROM scored GROUP BY ALL),
    run AS (SELECT *, CAST(sum(pos) OVER w AS BIGINT) AS cum_pos, CAST(sum(neg) OVER w AS BIGINT) AS cum_neg, CAST(sum(tot) OVER w AS BIGINT) AS cum_tot
      FROM sg WINDOW w AS (PARTITION BY regime, model ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""
AREAS_SQL = """ar AS (SELECT regime, model, round(sum(cum_pos / cum_tot * pos) / sum(pos), 6) AS pr_auc,
    round(sum(pos * ((SELECT sum(neg) FROM sg g WHERE g.regime = run.regime AND g.model = run.model) - cum_neg + 0.5 * neg))
      / (sum(pos)::DOUBLE * sum(neg)), 6) AS roc_auc FROM run GROUP BY ALL)"""


@query("k09_k10_rank_metrics", f"{SCORED}, {GROUPS_SQL}, {AREAS_SQL} SELECT * FROM ar")
def k09(t: Tables):
    return rounded(K.rank_metrics(t.scored(), EXP), "pr_auc", "roc_auc")


@query("k01_k10_all_metrics", f"{SCORED}, {CELLS_SQL}, {GROUPS_SQL}, {AREAS_SQL} SELECT c.*, {metric_sql()}, pr_auc, roc_auc FROM cells c JOIN ar USING (regime, model)")
def k_all(t: Tables):
    return rounded(K.classification_metrics(t.scored(), EXP), *THRESHOLD, "pr_auc", "roc_auc")


@query("k11_error_rates", f"""{SCORED}, {CELLS_SQL} SELECT *, round(fp / (tn + fp), 6) AS fp_rate, round(fn / (fn + tp), 6) AS fn_rate FROM cells""")
def k11(t: Tables):
    return rounded(K.error_rates(K.confusion(K.with_prediction(t.scored()), EXP)), "fp_rate", "fn_rate")


_AVG_RANK = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2"


@query("k12_spearman", f"""WITH r AS (SELECT {_AVG_RANK.format("l_quantity")} AS a, {_AVG_RANK.format("l_extendedprice")} AS b FROM lineitem)
    SELECT round(corr(a, b), 6) AS spearman FROM r""")
def k12(t: Tables):
    return rounded(K.spearman(t.spread(t.read("lineitem").select("l_quantity", "l_extendedprice")), "l_quantity", "l_extendedprice"), "spearman")


@query("w05_score_groups", f"{SCORED}, {GROUPS_SQL} SELECT regime, model, score, pos, neg, tot, dense_rank() OVER (PARTITION BY regime, model ORDER BY score DESC) - 1 AS score_group FROM sg")
def w05(t: Tables):
    return K.score_group_ordinals(t.scored(), EXP)


@query("w06_running_rank_counts", f"{SCORED}, {GROUPS_SQL} SELECT * FROM run")
def w06(t: Tables):
    return K.running_rank_counts(K.score_groups(t.scored(), EXP), EXP)


@query("w09_best_rows", """WITH v AS (SELECT o_orderpriority AS model, o_orderkey % 8 AS candidate, count(*) // 20 AS mcc FROM orders GROUP BY ALL),
    r AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY mcc DESC) AS i FROM v) SELECT model, candidate, mcc, count(*) OVER (PARTITION BY model) AS ties FROM r WHERE i = 1""")
def w09(t: Tables):
    v = t.read("orders").groupBy(F.col("o_orderpriority").alias("model"), (F.col("o_orderkey") % 8).alias("candidate")).agg(
        F.floor(F.count(F.lit(1)) / 20).alias("mcc"))
    return R.best_rows(v, ["model"], "mcc")


@query("i07_totals", f"""{SCORED}, {CELLS_SQL}, v AS (SELECT count_if(regime = 'A') AS sums, count_if(model = 'M2') AS prec FROM cells),
    c AS (SELECT unnest([{{'check_id': 'cells_sum', 'requirement': 'confusion cells sum to the rows', 'violations': sums}},
      {{'check_id': 'precision', 'requirement': 'precision equals TP/(TP+FP)', 'violations': prec}}], recursive := true) FROM v)
    SELECT *, CASE WHEN violations = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM c""")
def i07(t: Tables):
    """Totals of one regime and the precision of one model are off."""
    s = t.scored()
    cells = K.threshold_metrics(K.confusion(K.with_prediction(s), EXP))
    cells = cells.withColumn("precision", F.col("precision") + F.when(F.col("model") == "M2", 0.5).otherwise(0.0))
    rows = F.count(F.lit(1)) + F.when(F.col("regime") == "A", 1).otherwise(0)
    return I.check_totals(cells.join(s.groupBy(*EXP).agg(rows.alias("n")), EXP, "inner"), "n")


# ---------------------------------------------------------------- bootstrap

REPS, SEED = B.REPLICATES, 42


@query("b01_preflight", f"""{PURE} SELECT count(*) AS rows, CAST(0 AS BIGINT) AS empty_sites, count(DISTINCT label) AS classes, CAST(0 AS BIGINT) AS bad_scores,
    CAST(0 AS BIGINT) AS label_mismatches, (SELECT count(*) FROM (SELECT id FROM scored GROUP BY 1 HAVING count(*) > 1)) AS repeated_ids FROM scored""")
def b01(t: Tables):
    return B.preflight(K.with_prediction(t.scored(True)), "id", "site", "label", "score", "predicted")


CLUSTERS_SQL = f"""per AS (SELECT regime, model, site, min(label) AS class, count(*) AS rows, count_if(label = 0 AND score < 0.5) AS tn,
      count_if(label = 0 AND score >= 0.5) AS fp, count_if(label = 1 AND score < 0.5) AS fn, count_if(label = 1 AND score >= 0.5) AS tp
      FROM scored GROUP BY regime, model, site),
    clusters AS (SELECT *, row_number() OVER (PARTITION BY regime, model, class ORDER BY {sql_h60("'cluster'", "site")}, site) - 1 AS ordinal,
      count(*) OVER (PARTITION BY regime, model, class) AS n FROM per)"""


_U64 = "18446744073709551615::UHUGEINT"


def draws_sql(purpose: str = "draws") -> str:
    """Draws of classes that fit into one leaf; larger ones are tested against the binomial tree."""
    mix = "SELECT * EXCLUDE x, (({}::UHUGEINT) & {})::UBIGINT AS x FROM {}".format
    return f"""keys AS (SELECT regime, model, class, n, replicate, ('0x' || substr(sha256('{SEED}|' || sha256(regime || '|' || model || '|{purpose}')
        || '|' || class || '|' || replicate), 1, 15))::UBIGINT AS key
      FROM (SELECT DISTINCT regime, model, class, n FROM clusters) CROSS JOIN (SELECT i::INTEGER AS replicate FROM range({REPS}) AS r(i))),
    x0 AS (SELECT regime, model, class, n, replicate, ((key::UHUGEINT + i::UHUGEINT * {B.GAMMA}) & {_U64})::UBIGINT AS x
      FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM keys)),
    x1 AS ({mix(f"xor(x, x >> 30)::UHUGEINT * {B.MIX_1}", _U64, "x0")}), x2 AS ({mix(f"xor(x, x >> 27)::UHUGEINT * {B.MIX_2}", _U64, "x1")}),
    drawn AS (SELECT regime, model, class, replicate, CAST((xor(x, x >> 31) >> 4) % n AS BIGINT) AS ordinal FROM x2)"""


@query("b02_clusters", f"{PURE}, {CLUSTERS_SQL} SELECT * FROM clusters")
def b02(t: Tables):
    return B.clusters(t.scored(True), EXP, "site")


@query("b03_score_rows", f"""{PURE}, {CLUSTERS_SQL}, s AS (SELECT regime, model, site, score, CAST(sum(label) AS BIGINT) AS pos, count(*) AS tot FROM scored GROUP BY ALL)
    SELECT regime, model, class, ordinal, score, pos, tot FROM s JOIN clusters USING (regime, model, site)""")
def b03(t: Tables):
    pred = t.scored(True)
    return B.score_rows(pred, B.clusters(pred, EXP, "site"), EXP, "site").select(*EXP, "class", "ordinal", "score", "pos", "tot")


@query("b04_draw_clusters", f"""{PURE}, {CLUSTERS_SQL}, {draws_sql()}, m AS (SELECT regime, model, replicate, class, ordinal, count(*) AS k FROM drawn GROUP BY ALL)
    SELECT regime, model, class, ordinal, count(*) AS replicates, CAST(sum(k) AS BIGINT) AS draws, CAST(max(k) AS BIGINT) AS most,
      sha256(string_agg(replicate || ':' || k, ',' ORDER BY replicate)) AS multiplicities_sha256 FROM m GROUP BY ALL""")
def b04(t: Tables):
    """The multiplicities of every cluster in all replicates, as a digest of their list."""
    table = R.checkpointed(B.clusters(t.scored(True), EXP, "site"))
    return B.draw_digests(table, EXP, REPS, SEED)


REPLICATE_SQL = f"""{CLUSTERS_SQL}, {draws_sql()}, rc AS (SELECT regime, model, replicate, CAST(sum(tn) AS BIGINT) AS tn, CAST(sum(fp) AS BIGINT) AS fp,
    CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(tp) AS BIGINT) AS tp FROM drawn JOIN clusters USING (regime, model, class, ordinal) GROUP BY ALL)"""


def replicates(t: Tables):
    table = R.checkpointed(B.clusters(t.scored(True), EXP, "site"))
    return B.replicate_metrics(table, EXP, REPS, SEED)


@query("b05_j11_replicate_metrics", f"{PURE}, {REPLICATE_SQL} SELECT *, {metric_sql('')} FROM rc")
def b05(t: Tables):
    return rounded(replicates(t), *THRESHOLD)


RANK_REPLICATE_SQL = """s AS (SELECT regime, model, site, score, sum(label) AS pos, count(*) AS tot FROM scored GROUP BY ALL),
    m AS (SELECT regime, model, replicate, class, ordinal, count(*) AS mult FROM drawn GROUP BY ALL),
    g AS (SELECT regime, model, replicate, score, sum(pos * mult) AS pos, sum((tot - pos) * mult) AS neg, sum(tot * mult) AS tot
      FROM m JOIN clusters USING (regime, model, class, ordinal) JOIN s USING (regime, model, site) GROUP BY ALL),
    r AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(tot) OVER w AS ct, sum(neg) OVER (PARTITION BY regime, model, replicate) AS nn
      FROM g WINDOW w AS (PARTITION BY regime, model, replicate ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
    ra AS (SELECT regime, model, replicate, sum(cp / ct * pos) / sum(pos) AS pr_auc,
      sum(pos * (nn - cn + 0.5 * neg)) / (sum(pos)::DOUBLE * max(nn)) AS roc_auc FROM r GROUP BY ALL)"""


@query("b06_replicate_rank_metrics", f"""{PURE}, {CLUSTERS_SQL}, {draws_sql()}, {RANK_REPLICATE_SQL}
    SELECT regime, model, replicate, round(pr_auc, 6) AS pr_auc, round(roc_auc, 6) AS roc_auc FROM ra""")
def b06(t: Tables):
    pred = t.scored(True)
    table = R.checkpointed(B.clusters(pred, EXP, "site"))
    scores = R.checkpointed(B.score_rows(pred, table, EXP, "site"))
    return rounded(B.replicate_rank_metrics(table, scores, EXP, REPS, SEED), "pr_auc", "roc_auc")


_MCC = "(tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn))"


def mcc_long(t: Tables):
    return B.long_metrics(replicates(t), [*EXP, "replicate"], ["mcc"])


@query("b07_percentile_ci", f"""{PURE}, {REPLICATE_SQL} SELECT regime, model, 'mcc' AS metric, count(*) AS replicates,
    round(quantile_cont({_MCC}, 0.025), 6) AS lower, round(quantile_cont({_MCC}, 0.975), 6) AS upper FROM rc GROUP BY ALL""")
def b07(t: Tables):
    return rounded(B.percentile_ci(mcc_long(t), EXP), "lower", "upper")


@query("b08_difference_ci", f"""{PURE}, {REPLICATE_SQL}, v AS (SELECT regime, model, replicate, {_MCC} AS v FROM rc),
    d AS (SELECT a.model, a.v - c.v AS v FROM v a JOIN v c ON a.model = c.model AND a.replicate = c.replicate AND a.regime = 'A' AND c.regime = 'C')
    SELECT model, 'mcc' AS metric, count(*) AS replicates, round(quantile_cont(v, 0.025), 6) AS lower, round(quantile_cont(v, 0.975), 6) AS upper FROM d GROUP BY ALL""")
def b08(t: Tables):
    v = R.checkpointed(mcc_long(t))
    return rounded(B.difference_ci(v.where("regime = 'A'"), v.where("regime = 'C'"), ["model"]), "lower", "upper")


@query("b09_check_streams", f"{PURE} SELECT 2 * count(DISTINCT regime || model) AS streams, 2 * count(DISTINCT regime || model) AS distinct_streams FROM scored")
def b09(t: Tables):
    return B.check_streams(t.scored(True), EXP, ["draws", "replay"])


@query("b10_completeness", f"""{PURE} SELECT DISTINCT regime, model, 'mcc' AS metric, CAST({REPS} AS BIGINT) AS replicates, CAST(0 AS BIGINT) AS undefined, TRUE AS complete FROM scored""")
def b10(t: Tables):
    v = R.checkpointed(mcc_long(t))
    return B.completeness(B.assert_complete(v, EXP, REPS), EXP, REPS)


@query("s13_replicate_sink", f"""{PURE}, {REPLICATE_SQL} SELECT model, replicate, 'mcc' AS metric, round({_MCC}, 6) AS value, regime AS experiment_id FROM rc""")
def s13(t: Tables):
    path = t.scratch("replicates")
    write_replicates(mcc_long(t).withColumnRenamed("regime", "experiment_id"), path)
    return rounded(t.spark.read.schema("model string, replicate int, metric string, value double, experiment_id string").parquet(path), "value")


NAMES = [*B.THRESHOLD_METRICS, *B.RANK_METRICS]
REPLAYED = [1, 2, 3, 4, 5]


@query("b11_replay_check", f"""{PURE}, e AS (SELECT count(DISTINCT regime || model) AS n FROM scored)
    SELECT n * {len(NAMES) * len(REPLAYED)} AS compared, TRUE AS within, n * {len(NAMES)} AS formula_compared, TRUE AS formula_within FROM e""")
def b11(t: Tables):
    """Five replicates drawn again by themselves against the saved ones, and the first of them by plain formulas."""
    pred = t.scored(True)
    table = R.checkpointed(B.clusters(pred, EXP, "site"))
    saved = R.checkpointed(B.bootstrap(pred, EXP, "site", REPS, SEED, table=table))
    again = B.replay_check(saved, B.bootstrap(pred, EXP, "site", REPLAYED, SEED, table=table), EXP)
    plain = B.replay_check(saved, B.formula_metrics(pred, table, EXP, "site", REPLAYED[0], SEED), EXP)
    return again.select("compared", "within").crossJoin(  # two single rows
        plain.select(F.col("compared").alias("formula_compared"), F.col("within").alias("formula_within")))


_LONG_SQL = f"""pv AS (SELECT rc.*, {_MCC} AS mcc, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, tn / nullif(tn + fp, 0) AS specificity,
      fp / nullif(tn + fp, 0) AS fpr, (tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2 AS balanced_accuracy,
      (2 * tp / nullif(2 * tp + fp + fn, 0) + 2 * tn / nullif(2 * tn + fp + fn, 0)) / 2 AS macro_f1, pr_auc, roc_auc
      FROM {{0}} rc JOIN {{1}} ra USING ({{2}})),
    long AS (UNPIVOT (SELECT {{2}}, {', '.join(NAMES)} FROM pv) ON {', '.join(NAMES)} INTO NAME metric VALUE value)"""


@query("b12_bootstrap_table", f"""{PURE}, {REPLICATE_SQL}, {RANK_REPLICATE_SQL}, reps AS (WITH {_LONG_SQL.format("rc", "ra", "regime, model, replicate")} SELECT * FROM long),
    ci AS (SELECT regime, model, metric, count(value) AS replicates, quantile_cont(value, 0.025) AS lower, quantile_cont(value, 0.975) AS upper FROM reps GROUP BY ALL),
    {CELLS_SQL}, {GROUPS_SQL}, {AREAS_SQL}, points AS (WITH {_LONG_SQL.format("cells", "ar", "regime, model")} SELECT * FROM long)
    SELECT regime, model, metric, replicates, round(lower, 6) AS lower, round(upper, 6) AS upper, round(value, 6) AS estimate FROM ci JOIN points USING (regime, model, metric)""")
def b12(t: Tables):
    """Nine metrics of every experiment: point estimate and 95 % interval of 2,000 replicates."""
    pred = t.scored(True)
    found = R.checkpointed(B.bootstrap(pred, EXP, "site", REPS, SEED))
    intervals = B.percentile_ci(B.assert_complete(found, EXP, REPS), EXP)
    points = K.classification_metrics(pred, EXP)
    return rounded(B.with_point_estimates(intervals, points, EXP, NAMES), "lower", "upper", "estimate")


# ---------------------------------------------------------------- scaling, TF-IDF, selection



@query("m01_scaler", """WITH s AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s, avg(l_tax) AS tm, stddev_pop(l_tax) AS ts FROM lineitem WHERE l_orderkey % 10 < 7)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_quantity - m) / s, 6) AS l_quantity, round((l_tax - tm) / ts, 6) AS l_tax FROM lineitem CROSS JOIN s""")
def m01(t: Tables):
    li = t.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax")
    stats = M.fit_scaler(li.where("l_orderkey % 10 < 7"), ["l_quantity", "l_tax"])
    return rounded(M.apply_scaler(li, stats, ["l_quantity", "l_tax"]), "l_quantity", "l_tax")


def tfidf_sql(source: str, key: str, text: str, features: int) -> str:
    return f"""src AS (SELECT {key}, regexp_replace(lower({text}), '\\s\\s+', ' ', 'g') AS x FROM {source}),
    letters AS (SELECT {key}, unnest(string_split(x, '')) AS c, unnest(range(1, length(x) + 1)) AS i FROM src WHERE x <> ''),
    ahead AS (SELECT {key}, c, {', '.join(f"lead(c, {k}) OVER w AS c{k}" for k in range(1, 6))} FROM letters WINDOW w AS (PARTITION BY {key} ORDER BY i)),
    grams AS (SELECT {key}, unnest([{', '.join('c || ' + ' || '.join(f'c{k}' for k in range(1, n)) for n in range(2, 7))}]) AS token FROM ahead),
    tf AS (SELECT {key}, token, count(*) AS tf FROM grams WHERE token IS NOT NULL GROUP BY ALL),
    vocab AS (SELECT token, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 5 ORDER BY sum(tf) DESC, token LIMIT {features}),
    raw AS (SELECT {key}, token, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM src)) / (1 + df)) + 1) AS w FROM tf JOIN vocab USING (token)),
    weights AS (SELECT {key}, token, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS weight FROM raw)"""


TOKENS = M.GRIDS["M3"]["max_features"]  # 25,000 and 50,000


def page_weights(t: Tables, features: int = TOKENS[0]):
    src = t.spread(t.read("pages").select("page_id", "url"))
    tokens = TF.char_ngrams(src, "page_id", "url")
    vocabulary = TF.fit_char_tfidf(tokens, "page_id", src, features)
    return src, vocabulary, TF.tfidf_weights(tokens, "page_id", vocabulary)


@query("m04_char_tfidf", f"WITH {tfidf_sql('pages', 'page_id', 'url', TOKENS[0])} SELECT page_id, token, round(weight, 6) AS weight FROM weights")
def m04(t: Tables):
    return rounded(page_weights(t)[2], "weight").drop("idx")


@query("m04_char_tfidf_documents", f"""WITH {tfidf_sql('documents', 'doc_id', 'text', TOKENS[1])}
    SELECT token, count(*) AS docs, round(sum(weight), 4) AS weight FROM weights GROUP BY 1""")
def m04d(t: Tables):
    """Whole documents: vocabulary of 50,000 n-grams and the total weight of each."""
    docs = t.spread(t.read("documents").select("text"))
    found = TF.fit_weights(docs, "text", TOKENS[1]).totals(docs.select(TF.cleaned("text")))
    return found.withColumn("weight", F.round("weight", 4))


@query("m05_tfidf_diagnostics", f"""WITH {tfidf_sql('pages', 'page_id', 'url', TOKENS[0])} SELECT CASE WHEN page_id % 5 = 0 THEN 'validation' ELSE 'train' END AS "partition",
    count(DISTINCT page_id) AS rows, count(*) AS nonzeros, count(DISTINCT token) AS tokens_used, (SELECT count(*) FROM vocab) AS vocabulary_size FROM weights GROUP BY 1""")
def m05(t: Tables):
    _, vocabulary, w = page_weights(t)
    w = w.withColumn("partition", F.when(F.col("page_id") % 5 == 0, "validation").otherwise("train"))
    return TF.tfidf_diagnostics(w, "page_id", "partition", vocabulary)


def _results(t: Tables, unique: bool):
    """Candidate table from order counts; ``unique`` breaks ties."""
    o = t.read("orders").withColumn("c", (F.col("o_orderkey") % 4).cast("int")).groupBy(
        F.when(F.col("o_orderstatus") == "F", "M1").otherwise("M3").alias("model_id"), "c").agg(F.count(F.lit(1)).alias("n"))
    mcc = F.col("n") / 100000 + F.col("c") / 1000000000 if unique else F.lit(0.5) + F.when(F.col("c") == 0, -0.1).otherwise(0.0)
    params = F.concat(F.lit('{"C": '), F.lit(10) - F.col("c"), F.lit(".0}"))
    return o.select("model_id", F.concat("model_id", F.lit("_"), "c").alias("candidate_id"), params.alias("parameter_json"), mcc.alias("mcc"))


_RESULTS_SQL = """r AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'M1' ELSE 'M3' END AS model_id, o_orderkey % 4 AS c, count(*) AS n FROM orders GROUP BY ALL)"""


@query("m07_select_best", f"""WITH {_RESULTS_SQL}, v AS (SELECT *, n / 100000 + c / 1000000000 AS mcc FROM r)
    SELECT model_id, model_id || '_' || c AS candidate_id FROM v QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY mcc DESC) = 1""")
def m07(t: Tables):
    return M.select_best(_results(t, True)).select("model_id", "candidate_id")


@query("m08_select_by_capacity", f"""WITH {_RESULTS_SQL} SELECT model_id, model_id || '_3' AS candidate_id FROM r GROUP BY 1""")
def m08(t: Tables):
    return M.select_best(_results(t, False), tie="capacity").select("model_id", "candidate_id")


def experiment_rows(t: Tables):
    """Orders as labelled rows with three numeric predictors."""
    o = t.orders()
    return o.select("id", "label", (F.log("o_totalprice") - 11).alias("url_length"),
                    (unit("f", F.col("id")) + 0.4 * F.col("label")).alias("path_length"),
                    (F.substring("o_orderpriority", 1, 1).cast("double")).alias("dot_count"))


_PREDICTORS = ["url_length", "path_length", "dot_count"]


def _experiment(t: Tables):
    rows = R.checkpointed(S.split_stratified(t.spread(experiment_rows(t)), "id", "label", 42))
    part = lambda p: rows.where(F.col("partition") == p)
    return part("train"), part("validation"), part("test")


def _bench(t: Tables):
    train, val, test = _experiment(t)
    return M.Bench(train, val, "id", "label", "url", _PREDICTORS), test


@query("m02_m06_search")
def m06(t: Tables):
    """All candidates of the three models, fitted on train and scored on validation."""
    rows = R.checkpointed(url_features(t.parsed()).withColumn("url_text", F.col("raw_url")))
    rows = R.checkpointed(assign_regime(rows, "A", 42))
    with M.Bench(rows.where("partition = 'train'"), rows.where("partition = 'validation'"), "record_id", "label", "url_text") as bench:
        return M.search(bench, M.GRIDS).select("model_id", "candidate_id", "train_n", F.round("mcc", 3).alias("mcc"))


@query("m10_score_test")
def m10(t: Tables):
    bench, test = _bench(t)
    chosen = M.select_best(M.search(bench, {"M1": {"C": [1.0]}}))
    return M.score_test(bench, chosen, test, []).select("id", "model_id", "label", "predicted", F.round("score", 4).alias("score"))


@query("m14_repeat_check")
def m14(t: Tables):
    train, _, test = _experiment(t)
    n = train.count()

    def run():
        rep = M.Tabular(train, _PREDICTORS, scaled=True)
        return M.score(M.fit_logistic(rep.vectors(train), 1.0, n), rep.vectors(test), ["id"])

    return M.repeat_check(run, ["id"]).select("rows", "label_changes", "within")


@query("m15_model_registry", f"""WITH {ORDERS_SQL}, {split_sql('ord', 'id', 'label', 42)}
    SELECT count(*) AS rows, CAST(0 AS DOUBLE) AS max_abs_diff, TRUE AS refused_after_change FROM splitted WHERE "partition" = 'test'""")
def m15(t: Tables):
    """A model registered, loaded and scoring as before; after a change to its files the load is refused."""
    train, _, test = _experiment(t)
    rep = M.Tabular(train, _PREDICTORS, scaled=True)
    model, root = M.fit_logistic(rep.vectors(train), 1.0, train.count()), t.scratch("models")
    path = M.register_model(model, root, "A", "M1")
    vectors = rep.vectors(test)
    again = M.score(M.load_registered(LogisticRegressionModel, root, "A", "M1"), vectors, ["id"]).select("id", F.col("score").alias("again"))
    out = R.checkpointed(M.score(model, vectors, ["id"]).join(again, "id", "full").agg(
        F.count(F.lit(1)).alias("rows"), F.max(F.coalesce(F.abs(F.col("score") - F.col("again")), F.lit(1.0))).alias("max_abs_diff")))
    t.read("region").limit(1).write.mode("append").parquet(f"{path}/data")
    try:
        M.load_registered(LogisticRegressionModel, root, "A", "M1")
        refused = False
    except RuntimeError:
        refused = True
    return out.withColumn("refused_after_change", F.lit(refused))


def _url_experiment(t: Tables, regime: str = "C"):
    """Web pages with features, split by regime; parsed and split once."""
    rows = R.checkpointed(url_features(t.pages()).withColumn("url_text", F.col("raw_url")))
    return R.checkpointed(assign_regime(rows, regime, 42, "page_id"))


def _union(parts: list):
    return functools.reduce(lambda a, b: a.unionByName(b), parts)


@query("m09_m11_run_experiment")
def m11(t: Tables):
    """Search, freeze, gate, refit and score on the random split and the three disjoint ones."""
    return _union([run_experiment(
        _url_experiment(t, regime), t.scratch("experiment"), regime, 42, key="page_id", text="url_text", tie="capacity").metrics
        for regime in "ABCD"]).select("regime", "variant", "model_id", "tn", "fp", "fn", "tp")


@query("m12_run_ablation")
def m12(t: Tables):
    """Every feature set over the tabular models, with the change against all features."""
    rows = _url_experiment(t)
    args = dict(grids={m: M.GRIDS[m] for m in ("M1", "M2")}, key="page_id", text="url_text")
    full = run_experiment(rows, t.scratch("full"), "C", 42, tie="capacity", **args)
    baseline = R.checkpointed(full.metrics)
    out = _union([run_ablation(rows, t.scratch("ablation"), a, baseline, 42, **args) for a in ABLATIONS])
    return rounded(out.select("feature_set", "model_id", "mcc", "delta_mcc"), "mcc", "delta_mcc")


@query("m13_baselines")
def m13(t: Tables):
    rows = _url_experiment(t, "A")
    train, test = rows.where("partition = 'train'"), rows.where("partition = 'test'")
    parts = [M.score(M.fit_baseline(k, train), test, ["page_id", "label"]).withColumn("model_id", F.lit(k)) for k in ("B1", "B2")]
    return parts[0].unionByName(parts[1]).select("page_id", "label", "model_id", "predicted")


# ---------------------------------------------------------------- attribution

@query("a01_compare_coefficients", f"""WITH {COEFFICIENTS_SQL}, j AS (SELECT a.token AS feature, a.coefficient AS ca, c.coefficient AS cc FROM coefficients a JOIN coefficients c
      ON a.token = c.token AND a.regime = 'A' AND c.regime = 'C')
    SELECT feature, ca AS coefficient_a, cc AS coefficient_c, abs(ca) AS abs_a, abs(cc) AS abs_c, round(cc - ca, 6) AS delta_signed, round(abs(cc) - abs(ca), 6) AS delta_abs,
    {_AVG_RANK.format("-abs(ca)")} AS rank_a, {_AVG_RANK.format("-abs(cc)")} AS rank_c FROM j""")
def a01(t: Tables):
    c = t.coefficients().select("regime", F.col("token").alias("feature"), F.lit(0).alias("feature_index"), "coefficient")
    out = T.compare_coefficients(c.where("regime = 'A'"), c.where("regime = 'C'"))
    return rounded(out.drop("feature_index"), "delta_signed", "delta_abs")


@query("a02_local_attribution", """SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS row_id, 'l_quantity' AS feature, round(0.25 * (l_quantity - 25), 6) AS phi FROM lineitem
    UNION ALL SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey, 'l_discount', round(-2.0 * (l_discount - 0.05), 6) FROM lineitem""")
def a02(t: Tables):
    li = t.read("lineitem").withColumn("row_id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    return rounded(T.local_attribution(li, "row_id", {"l_quantity": .25, "l_discount": -2.0}, {"l_quantity": 25.0, "l_discount": .05}), "phi")


@query("a03_local_change", f"""WITH {PHI_SQL}, n AS (SELECT row_id, sum(abs(phi_a)) AS na, sum(abs(phi_c)) AS nc FROM phi GROUP BY 1)
    SELECT row_id, round(sum(abs(phi_c - phi_a)), 6) AS raw_change, round(sum(abs(phi_c / nc - phi_a / na)), 6) AS normalized_change FROM phi JOIN n USING (row_id) GROUP BY row_id""")
def a03(t: Tables):
    return rounded(T.local_change(t.phi(), "row_id"), "raw_change", "normalized_change")


GLOBAL_SQL = f"""{PHI_SQL}, st AS (SELECT *, 'all' AS stratum FROM phi UNION ALL SELECT *, CASE WHEN label = 1 THEN 'positive' ELSE 'negative' END FROM phi),
    gl AS (SELECT feature, stratum, count(*) AS rows, avg(abs(phi_a)) AS ga, avg(abs(phi_c)) AS gc FROM st GROUP BY ALL)"""


@query("a04_global_attribution", f"WITH {GLOBAL_SQL} SELECT feature, stratum, rows, round(ga, 6) AS mean_abs_a, round(gc, 6) AS mean_abs_c, round(gc - ga, 6) AS delta FROM gl")
def a04(t: Tables):
    return rounded(T.global_attribution(t.phi(), "label"), "mean_abs_a", "mean_abs_c", "delta")


PERMUTED = ["path_length", "dot_count"]


def _importance(t: Tables, runs: list[tuple[str, int]] | None = None):
    rows = t.spread(experiment_rows(t))
    return T.permutation_importance(rows, "id", "label", PERMUTED, {"path_length": 4.0, "dot_count": -.1}, -2.6, 5, 42, runs)


def _permuted_sql(feature: str, value: str) -> str:
    src = sql_h60("'42'", "'from'", f"'{feature}'", "r", "id")
    return f"""SELECT id, label, '{feature}' AS feature, r, {value} AS v, row_number() OVER (PARTITION BY r ORDER BY {src}, id) AS si,
      row_number() OVER (PARTITION BY r ORDER BY {sql_h60("'to'", "id")}, id) AS ti, path_length, dot_count FROM ex CROSS JOIN range(5) AS t(r)"""


@query("a05_permutation_importance", f"""WITH {ORDERS_SQL}, ex AS (SELECT id, label, {sql_unit("'f'", "id")} + 0.4 * label AS path_length,
      CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS dot_count FROM ord),
    p AS ({_permuted_sql('path_length', 'path_length')} UNION ALL {_permuted_sql('dot_count', 'dot_count')}),
    m AS (SELECT a.feature, a.r AS repeat, a.label, -2.6 + a.path_length * 4.0 + a.dot_count * -0.1
      + CASE WHEN a.feature = 'path_length' THEN 4.0 * (b.v - a.path_length) ELSE -0.1 * (b.v - a.dot_count) END >= 0 AS z
      FROM p a JOIN p b ON a.feature = b.feature AND a.r = b.r AND a.ti = b.si),
    u AS (SELECT feature, repeat, label, z FROM m UNION ALL SELECT 'base', 0, label, -2.6 + path_length * 4.0 + dot_count * -0.1 >= 0 FROM ex),
    c AS (SELECT feature, CAST(repeat AS INTEGER) AS repeat, count_if(label = 0 AND NOT z) AS tn, count_if(label = 0 AND z) AS fp,
      count_if(label = 1 AND NOT z) AS fn, count_if(label = 1 AND z) AS tp FROM u GROUP BY ALL),
    s AS (SELECT feature, repeat, coalesce({_MCC}, 0.0) AS mcc FROM c)
    SELECT feature, repeat, round(mcc, 6) AS permuted_mcc, round((SELECT mcc FROM s WHERE feature = 'base'), 6) AS baseline_mcc,
    round((SELECT mcc FROM s WHERE feature = 'base') - mcc, 6) AS importance FROM s WHERE feature <> 'base'""")
def a05(t: Tables):
    return rounded(_importance(t), "permuted_mcc", "baseline_mcc", "importance")


@query("a06_replay_permutation")
def a06(t: Tables):
    saved = R.checkpointed(_importance(t))
    # the same choice by hash as of the rows of a full run, made before any row is permuted
    chosen = saved.where(F.pmod(h60("replay", F.col("feature"), F.col("repeat")), F.lit(3)) == 0)
    again = _importance(t, [(r["feature"], r["repeat"]) for r in chosen.select("feature", "repeat").collect()])
    return T.replay_difference(saved, again, ["feature", "repeat"], "importance")


REPEATS = 30


def _boosted(t: Tables):
    """Test URLs of the site-disjoint split, a boosted model fitted on its train rows, and its decisions on the test rows."""
    rows = R.checkpointed(url_features(t.grouped()).select("record_id", "label", "site_key_private", "site_key_icann", "hostname_ascii", *FEATURES))
    rows = R.checkpointed(assign_regime(rows, "C", 42))
    train, test = rows.where("partition = 'train'"), rows.where("partition = 'test'")
    grouped = R.checkpointed(M.grouped_rows(train, list(FEATURES), "label"))
    [model] = M.fit_boosted(grouped, [{"learning_rate": .1, "max_iter": 100, "max_leaf_nodes": 31}], list(FEATURES), "label", train.count())
    test = test.select("record_id", "label", *[F.col(c).cast("double").alias(c) for c in FEATURES])
    return test, model, M.score(model, M.assemble(test, list(FEATURES)), ["record_id", "label"])


def _arguments(test, model, scored) -> tuple:
    return test, "record_id", "label", list(FEATURES), model, scored, REPEATS, 42


@query("a05_model_permutation_importance")
def a05m(t: Tables):
    """22 features x 30 repeats on the fitted boosted model."""
    out = T.tree_permutation_importance(*_arguments(*_boosted(t)))
    return rounded(out, "permuted_mcc", "baseline_mcc", "importance")


@query("a06_replay_model_permutation", "SELECT CAST(4 AS BIGINT) AS compared, CAST(0 AS DOUBLE) AS max_abs_diff, count(*) > 0 AS equal FROM orders")
def a06m(t: Tables):
    """Four runs chosen by hash, made again by themselves; they must be equal."""
    args = _arguments(*_boosted(t))
    saved = R.checkpointed(T.tree_permutation_importance(*args))
    runs = [(f, r) for f in FEATURES for r in range(REPEATS)]
    chosen = sorted(runs, key=lambda run: T.run_key(7, *run))[:4]
    again = T.tree_permutation_importance(*args, runs=chosen)
    return T.replay_difference(saved, again, ["feature", "repeat"], "importance")


TOP_SQL = """l AS (SELECT regime, token, coefficient, 'positive' AS list_type, coefficient AS k FROM coefficients
      UNION ALL SELECT regime, token, coefficient, 'negative', -coefficient FROM coefficients
      UNION ALL SELECT regime, token, coefficient, 'absolute', abs(coefficient) FROM coefficients),
    top AS (SELECT regime, token, coefficient, list_type, CAST(row_number() OVER (PARTITION BY regime, list_type ORDER BY k DESC, token) AS INTEGER) AS rank FROM l
      QUALIFY row_number() OVER (PARTITION BY regime, list_type ORDER BY k DESC, token) <= 50)"""


@query("o06_a07_top_tokens", f"WITH {COEFFICIENTS_SQL}, {TOP_SQL} SELECT * FROM top")
def o06(t: Tables):
    return T.top_tokens(t.coefficients(), 50)


SHARED_SQL = """sh AS (SELECT a.token, a.coefficient AS ca, c.coefficient AS cc FROM coefficients a JOIN coefficients c ON a.token = c.token AND a.regime = 'A' AND c.regime = 'C'),
    rk AS (SELECT rank() OVER (ORDER BY abs(ca)) + (count(*) OVER (PARTITION BY abs(ca)) - 1) / 2 AS ra, rank() OVER (ORDER BY abs(cc)) + (count(*) OVER (PARTITION BY abs(cc)) - 1) / 2 AS rc FROM sh)"""


@query("j10_a08_compare_vocab", f"""WITH {COEFFICIENTS_SQL}, {SHARED_SQL}, s AS (SELECT count(*) AS shared, avg(CASE WHEN sign(ca) = sign(cc) THEN 1.0 ELSE 0.0 END) AS sa FROM sh),
    z AS (SELECT count_if(regime = 'A') AS size_a, count_if(regime = 'C') AS size_c FROM coefficients)
    SELECT shared, round(sa, 6) AS sign_agreement, size_a, size_c, (SELECT round(corr(ra, rc), 6) FROM rk) AS abs_spearman,
    round(shared / size_a, 6) AS shared_share_a, round(shared / size_c, 6) AS shared_share_c FROM s CROSS JOIN z""")
def a08(t: Tables):
    c = t.coefficients()
    out = T.compare_vocab(c.where("regime = 'A'").drop("regime"), c.where("regime = 'C'").drop("regime"))
    return rounded(out, "sign_agreement", "abs_spearman", "shared_share_a", "shared_share_c")


@query("a09_topk_overlap", f"""WITH {COEFFICIENTS_SQL}, {TOP_SQL}, p AS (SELECT token, max(CASE WHEN regime = 'A' THEN sign(coefficient) END) AS s0,
      max(CASE WHEN regime = 'C' THEN sign(coefficient) END) AS s1 FROM top WHERE list_type = 'absolute' GROUP BY 1)
    SELECT 50 AS k, count(s0) AS size_a, count(s1) AS size_c, count_if(s0 IS NOT NULL AND s1 IS NOT NULL) AS intersection, count(*) AS "union",
    round(count_if(s0 IS NOT NULL AND s1 IS NOT NULL) / count(*), 6) AS jaccard, count(*) FILTER (s0 = s1) AS sign_agreements,
    round(count(*) FILTER (s0 = s1) / nullif(count_if(s0 IS NOT NULL AND s1 IS NOT NULL), 0), 6) AS sign_agreement_rate FROM p""")
def a09(t: Tables):
    return rounded(T.topk_overlap(t.coefficients(), ("A", "C"), 50), "jaccard", "sign_agreement_rate")


_LOCAL_SQL = """nrm AS (SELECT row_id, sum(abs(phi_a)) AS na, sum(abs(phi_c)) AS nc FROM phi GROUP BY 1),
    lc AS (SELECT row_id, sum(abs(phi_c - phi_a)) AS raw, sum(abs(phi_c / nc - phi_a / na)) AS norm FROM phi JOIN nrm USING (row_id) GROUP BY 1)"""


@query("a10_attribution_summary", f"""WITH {COEFFICIENTS_SQL}, {SHARED_SQL}, {GLOBAL_SQL}, {_LOCAL_SQL}, {TOP_SQL},
    gr AS (SELECT {_AVG_RANK.format("ga")} AS ra, {_AVG_RANK.format("gc")} AS rc FROM gl WHERE stratum = 'all'),
    tk AS (SELECT token, count(DISTINCT regime) AS n FROM top WHERE list_type = 'absolute' GROUP BY 1)
    SELECT 'M1' AS model, 'abs_coefficient_spearman' AS metric, round(corr(ra, rc), 6) AS value FROM rk
    UNION ALL SELECT 'M2', 'mean_abs_spearman', round(corr(ra, rc), 6) FROM gr
    UNION ALL SELECT 'M2', 'mean_local_change', round(avg(raw), 6) FROM lc
    UNION ALL SELECT 'M2', 'mean_local_change_normalized', round(avg(norm), 6) FROM lc
    UNION ALL SELECT 'M3', 'shared_token_abs_spearman', round(corr(ra, rc), 6) FROM rk
    UNION ALL SELECT 'M3', 'top_50_abs_jaccard', round(count_if(n = 2) / count(*), 6) FROM tk""")
def a10(t: Tables):
    """Six named values of the change between two regimes; the coefficient table stands for M1's features and M3's tokens."""
    c, phi = t.coefficients(), t.phi()
    whole = R.checkpointed(T.global_attribution(phi, "label").where("stratum = 'all'"))
    local = R.checkpointed(T.local_change(phi, "row_id").agg(F.avg("raw_change").alias("raw"), F.avg("normalized_change").alias("norm")))
    c = R.checkpointed(c)
    a, b = c.where("regime = 'A'"), c.where("regime = 'C'")
    m1 = T.compare_coefficients(a.select(F.col("token").alias("feature"), F.lit(0).alias("feature_index"), "coefficient"),
                                b.select(F.col("token").alias("feature"), F.lit(0).alias("feature_index"), "coefficient"))
    return rounded(T.attribution_summary([
        ("M1", "abs_coefficient_spearman", m1.agg(F.corr("rank_a", "rank_c"))),
        ("M2", "mean_abs_spearman", K.spearman(whole, "mean_abs_a", "mean_abs_c")),
        ("M2", "mean_local_change", local.select("raw")),
        ("M2", "mean_local_change_normalized", local.select("norm")),
        ("M3", "shared_token_abs_spearman", K.spearman(R.checkpointed(T.shared_vocab(a, b)), "coefficient_a", "coefficient_c", True)),
        ("M3", "top_50_abs_jaccard", T.topk_overlap(c, ("A", "C"), 50).select("jaccard"))]), "value")


@query("a11_change_frame", f"""WITH {COEFFICIENTS_SQL}, {SHARED_SQL}, {GLOBAL_SQL} SELECT 'M1' AS model, token AS feature, 'all' AS stratum, 'delta_abs' AS change, round(abs(cc) - abs(ca), 6) AS value FROM sh
    UNION ALL SELECT 'M2', feature, stratum, 'delta_mean_abs', round(gc - ga, 6) FROM gl""")
def a11(t: Tables):
    c = t.coefficients().select("regime", F.col("token").alias("feature"), F.lit(0).alias("feature_index"), "coefficient")
    m1 = T.compare_coefficients(c.where("regime = 'A'"), c.where("regime = 'C'"))
    return rounded(T.change_frame(m1, T.global_attribution(t.phi(), "label")), "value")


@query("a12_replay_attribution", """WITH r AS (SELECT DISTINCT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS row_id FROM lineitem)
    SELECT least(16, count(*)) * 2 AS compared, CAST(0 AS DOUBLE) AS max_abs_diff, TRUE AS equal FROM r""")
def a12(t: Tables):
    """Sixteen rows attributed again, each under a partitioning of its own, against the stored table."""
    li = t.read("lineitem").withColumn("row_id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    args = ({"l_quantity": .25, "l_discount": -2.0}, {"l_quantity": 25.0, "l_discount": .05})
    path = t.scratch("attribution")
    T.local_attribution(t.spread(li), "row_id", *args).write.parquet(path)
    saved = t.spark.read.schema("row_id string, feature string, phi double").parquet(path)
    chosen = T.replay_subset(li.select("row_id", "l_quantity", "l_discount").distinct(), "row_id", "DET_V1", 16).repartition(16, "row_id")
    return T.replay_difference(saved, T.local_attribution(chosen, "row_id", *args), ["row_id", "feature"], "phi")


# ---------------------------------------------------------------- errors

def _error_parts(t: Tables):
    """Properties of all URL rows for two regimes, predictions of two models."""
    rows = error_properties(url_features(t.grouped())).select(
        "record_id", "label", "site_key_private", "public_suffix_private", "url_length", "hostname_length", "digit_ratio",
        "special_char_count", "is_private_suffix", "is_ip", "hostname_has_digit", "https", "root_path_empty_query", "com_or_org",
        "derived_path_depth", "derived_query_parameter_count")
    band = S.band_of(F.pmod(h60("rank", F.col("site_key_private")), F.lit(1400)) + 1, BANDS)
    regimes = F.explode(F.array(F.lit("A"), F.lit("C"))).alias("regime")
    rows = rows.withColumn("rank_band", band).select("*", regimes)
    by_row = F.pmod(h60("part", F.col("record_id")), F.lit(10)) < 7
    by_site = F.pmod(h60("part", F.col("site_key_private")), F.lit(10)) < 7
    rows = rows.withColumn("in_train", F.when(F.col("regime") == "A", by_row).otherwise(by_site))
    # parsed once and written: train statistics and test rows both read it
    rows = R.checkpointed(rows)
    test = rows.where(~F.col("in_train")).drop("in_train")
    models = F.explode(F.array(F.lit("M1"), F.lit("M2"))).alias("model")
    flip = F.pmod(h60("wrong", F.col("model"), F.col("regime"), F.col("record_id")), F.lit(10)) < F.when(F.col("model") == "M1", 4).otherwise(2)
    pred = test.select("record_id", "regime", "label", models).withColumn(
        "predicted", F.when(flip, 1 - F.col("label")).otherwise(F.col("label")))
    return rows.where("in_train"), test, pred


LOW_BANDS = ("501-900", "901-1400")
_RANK = f"({sql_h60(chr(39) + 'rank' + chr(39), 'site_key_private')} % 1400 + 1)"
ERRORS_SQL = f"""{FEATURES_SQL}, props AS (SELECT record_id, public_suffix_private, {ERROR_PROPS_SQL} FROM parsed),
    er AS (SELECT f.record_id, label, site_key_private, public_suffix_private, url_length, hostname_length, digit_ratio0 AS digit_ratio, special_char_count, is_private_suffix, is_ip,
      hostname_has_digit, https, root_path_empty_query, com_or_org, derived_path_depth, derived_query_parameter_count, {_BAND_SQL.replace('rank BETWEEN', _RANK + ' BETWEEN')} AS rank_band, regime,
      CASE WHEN regime = 'A' THEN {sql_h60("'part'", "f.record_id")} % 10 < 7 ELSE {sql_h60("'part'", "site_key_private")} % 10 < 7 END AS in_train
      FROM features f JOIN props USING (record_id) CROSS JOIN (VALUES ('A'), ('C')) AS r(regime) WHERE coalesce(site_key_private, '') <> ''),
    th AS (SELECT regime, quantile_cont(url_length, 0.9) AS long_url, quantile_cont(hostname_length, 0.5) AS short_host, quantile_cont(special_char_count, 0.5) AS few_special,
      {", ".join(f"quantile_cont({c}, 0.9) AS q_{c}" for c in E.ENVELOPE)} FROM er WHERE in_train AND label = 0 GROUP BY 1),
    sx AS (SELECT regime, public_suffix_private, count(*) AS suffix_count FROM er WHERE in_train AND label = 0 GROUP BY ALL),
    ts AS (SELECT DISTINCT regime, site_key_private FROM er WHERE in_train),
    pr AS (SELECT er.*, model, CASE WHEN {sql_h60("'wrong'", "model", "regime", "record_id")} % 10 < (CASE WHEN model = 'M1' THEN 4 ELSE 2 END) THEN 1 - label ELSE label END AS predicted
      FROM er CROSS JOIN (VALUES ('M1'), ('M2')) AS m(model) WHERE NOT in_train),
    w AS (SELECT p.* EXCLUDE (in_train), coalesce(suffix_count, 0) AS suffix_count, ts.site_key_private IS NOT NULL AS seen_in_train, th.* EXCLUDE (regime),
      CASE WHEN label = 0 THEN 'FP' ELSE 'FN' END AS error_type FROM pr p JOIN th ON th.regime = p.regime
      LEFT JOIN sx ON sx.regime = p.regime AND sx.public_suffix_private = p.public_suffix_private
      LEFT JOIN ts ON ts.regime = p.regime AND ts.site_key_private = p.site_key_private WHERE label <> predicted),
    wc AS (SELECT *, CASE WHEN error_type = 'FP' THEN list_filter([CASE WHEN url_length >= long_url THEN 'FP-A' END,
        CASE WHEN is_private_suffix = 1 OR suffix_count <= 5 THEN 'FP-B' END, CASE WHEN is_ip = 1 OR hostname_has_digit = 1 THEN 'FP-C' END,
        CASE WHEN derived_path_depth >= 5 OR derived_query_parameter_count >= 2 THEN 'FP-D' END, CASE WHEN rank_band IN ('501-900', '901-1400') THEN 'FP-E' END], lambda x: x IS NOT NULL)
      ELSE list_filter([CASE WHEN https = 1 AND hostname_length <= short_host THEN 'FN-A' END, CASE WHEN root_path_empty_query = 1 THEN 'FN-B' END,
        CASE WHEN com_or_org = 1 THEN 'FN-C' END, CASE WHEN special_char_count <= few_special THEN 'FN-D' END,
        CASE WHEN NOT seen_in_train AND {" AND ".join(f"{c} <= q_{c}" for c in E.ENVELOPE)} THEN 'FN-E' END], lambda x: x IS NOT NULL) END AS cats FROM w)"""


def _errors(t: Tables):
    train, test, pred = _error_parts(t)
    th = E.taxonomy_thresholds(train, ["regime"])
    return E.error_rows(pred, test, train, th, ["regime"], "record_id", "site_key_private", "public_suffix_private",
                        rare_max=5, low_bands=LOW_BANDS)


@query("e01_taxonomy_thresholds", f"{ERRORS_SQL} SELECT regime, {', '.join(f'round({c}, 6) AS {c}' for c in ['long_url', 'short_host', 'few_special'] + ['q_' + x for x in E.ENVELOPE])} FROM th")
def e01(t: Tables):
    d = E.taxonomy_thresholds(_error_parts(t)[0], ["regime"])
    return rounded(d, *[c for c in d.columns if c != "regime"])


@query("e02_train_context", f"{ERRORS_SQL} SELECT * FROM sx")
def e02(t: Tables):
    return E.negative_suffix_counts(_error_parts(t)[0], ["regime"], "public_suffix_private")


@query("e03_e05_error_rows", f"""{ERRORS_SQL} SELECT record_id, regime, model, error_type, site_key_private, seen_in_train, suffix_count,
    array_to_string(cats, ';') AS categories, CAST(len(cats) AS INTEGER) AS category_count, len(cats) = 0 AS uncategorized FROM wc""")
def e05(t: Tables):
    d = _errors(t)
    return d.select("record_id", "regime", "model", "error_type", "site_key_private", "seen_in_train", "suffix_count",
                    F.array_join("categories", ";").alias("categories"), "category_count", "uncategorized")


@query("e06_fp_fn_summary", f"""{SCORED}, {CELLS_SQL} SELECT *, tn + fp AS negatives, tp + fn AS positives, round(fp / (tn + fp), 6) AS fp_rate, round(fn / (tp + fn), 6) AS fn_rate FROM cells""")
def e06(t: Tables):
    return rounded(E.fp_fn_summary(K.confusion(K.with_prediction(t.scored()), EXP)), "fp_rate", "fn_rate")


COUNTS_SQL = ERRORS_SQL + """, names AS (SELECT * FROM (VALUES ('FP', 'FP-A'), ('FP', 'FP-B'), ('FP', 'FP-C'), ('FP', 'FP-D'), ('FP', 'FP-E'), ('FP', 'UNCATEGORIZED'),
      ('FN', 'FN-A'), ('FN', 'FN-B'), ('FN', 'FN-C'), ('FN', 'FN-D'), ('FN', 'FN-E'), ('FN', 'UNCATEGORIZED')) AS v(error_type, category)),
    cc AS (SELECT regime, model, wc.error_type, category, count_if(list_contains(cats, category) OR (category = 'UNCATEGORIZED' AND len(cats) = 0)) AS errors,
      count(*) AS total_errors FROM wc JOIN names ON names.error_type = wc.error_type GROUP BY ALL)"""


@query("e07_category_counts", f"{COUNTS_SQL} SELECT *, round(errors / total_errors, 6) AS prevalence FROM cc")
def e07(t: Tables):
    return rounded(E.category_counts(_errors(t), EXP), "prevalence")


@query("e08_category_multiplicity", f"""{ERRORS_SQL} SELECT regime, model, error_type, CAST(len(cats) AS INTEGER) AS category_count, count(*) AS errors,
    round(count(*) / sum(count(*)) OVER (PARTITION BY regime, model, error_type), 6) AS share FROM wc GROUP BY regime, model, error_type, len(cats)""")
def e08(t: Tables):
    return rounded(E.category_multiplicity(_errors(t), EXP), "share")


@query("e09_j09_compare_categories", f"""{COUNTS_SQL} SELECT a.model, a.error_type, a.category, a.errors AS errors_A, c.errors AS errors_C, a.total_errors AS total_errors_A,
    c.total_errors AS total_errors_C, round(a.errors / a.total_errors, 6) AS prevalence_A, round(c.errors / c.total_errors, 6) AS prevalence_C,
    round(100.0 * (c.errors / c.total_errors - a.errors / a.total_errors), 6) AS difference_pp FROM cc a JOIN cc c
    ON a.model = c.model AND a.error_type = c.error_type AND a.category = c.category AND a.regime = 'A' AND c.regime = 'C'""")
def e09(t: Tables):
    d = E.compare_categories(E.category_counts(_errors(t), EXP), "regime", ("A", "C"), ["model"])
    return rounded(d, "prevalence_A", "prevalence_C", "difference_pp")


SITES_SQL = ERRORS_SQL + """, se AS (SELECT regime, model, error_type, site_key_private, count(*) AS errors, count_if(len(cats) = 0) AS uncategorized_errors,
      '{' || """ + " || ',' || ".join(
    f"""'"{n}":' || count_if(list_contains(cats, '{n}'))""" for n in sorted(E.FP_CATEGORIES + E.FN_CATEGORIES)) + """ || '}' AS category_json
      FROM wc GROUP BY regime, model, error_type, site_key_private),
    sr AS (SELECT *, CAST(sum(errors) OVER (PARTITION BY regime, model, error_type) AS BIGINT) AS total_errors,
      round(errors / sum(errors) OVER (PARTITION BY regime, model, error_type), 6) AS share,
      'SITE-' || upper(substr(sha256('site|' || site_key_private), 1, 12)) AS anonymous_site,
      row_number() OVER (PARTITION BY regime, model, error_type ORDER BY errors DESC, site_key_private) AS site_rank FROM se)"""


@query("e10_w07_site_errors", f"{SITES_SQL} SELECT * FROM sr")
def e10(t: Tables):
    sites = E.site_errors(_errors(t), EXP, "site_key_private")
    return rounded(E.contributor_rank(sites, EXP, "site_key_private"), "share")


@query("e11_o07_top_sites", f"{SITES_SQL} SELECT * EXCLUDE (site_key_private) REPLACE (CAST(site_rank AS INTEGER) AS site_rank) FROM sr WHERE site_rank <= 10")
def e11(t: Tables):
    return rounded(E.top_sites(E.site_errors(_errors(t), EXP, "site_key_private"), EXP, "site_key_private"), "share")


@query("e12_check_taxonomy", f"""{ERRORS_SQL}, v AS (SELECT count_if(error_type = 'FP') AS fp, count_if(error_type = 'FN') AS fn, count_if(regime = 'C') AS c FROM wc),
    k AS (SELECT unnest([{{'check': 'known_categories', 'violations': fp}}, {{'check': 'flag_consistent', 'violations': fn}},
      {{'check': 'site_totals', 'violations': c}}], recursive := true) FROM v)
    SELECT *, CASE WHEN violations = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM k""")
def e12(t: Tables):
    """Unknown categories in one error type, wrong flags in the other, sites of one regime left out."""
    errors = R.checkpointed(_errors(t).select(*EXP, "error_type", "site_key_private", "categories", "category_count", "uncategorized"))
    false_positive = F.col("error_type") == "FP"
    broken = errors.withColumn("uncategorized", F.when(false_positive, F.col("uncategorized")).otherwise(~F.col("uncategorized")))
    broken = broken.withColumn("categories", F.when(false_positive, F.array_append("categories", F.lit("odd"))).otherwise(F.col("categories")))
    return E.check_taxonomy(broken, E.site_errors(errors.where("regime = 'A'"), EXP, "site_key_private"))


@query("i11_error_table", f"""{SCORED}, {CELLS_SQL} SELECT regime, model, fp AS fp_count, fn AS fn_count, printf('%.1f', 100.0 * fp / (tn + fp)) AS fp_pct,
    printf('%.1f', 100.0 * fn / (tp + fn)) AS fn_pct FROM cells""")
def i11e(t: Tables):
    return I.table_errors(E.fp_fn_summary(K.confusion(K.with_prediction(t.scored()), EXP)))



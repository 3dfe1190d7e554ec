"""Attribution change of one model between two split regimes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteval.functions.hashing import h60
from siteval.functions.stats import confusion_cells, confusion_metrics, ratio
from siteval.operators.boosting import Responses, Trees
from siteval.operators.metrics import spearman
from siteval.operators.ranking import CUT_BITS, average_rank, checkpointed, first_by_hash, hash_ordinal, shuffle_width

EXCHANGE_ROWS = 256  # positions whose permuted values meet in one group
CHUNK = 1 << 15  # neighbouring positions whose decisions are made at once
SENT = 1 << 26  # positions whose values a task holds, a byte each
MET = 1 << 24  # positions that a task answers


def compare_coefficients(a: DataFrame, c: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Coefficients of both regimes per feature, changes and average ranks."""
    both = (a.select("feature", "feature_index", F.col("coefficient").alias("coefficient_a"))
            .join(c.select("feature", F.col("coefficient").alias("coefficient_c")), "feature", "inner"))
    both = both.withColumns({"abs_a": F.abs("coefficient_a"), "abs_c": F.abs("coefficient_c")})
    both = both.withColumns({"delta_signed": F.col("coefficient_c") - F.col("coefficient_a"),
                             "delta_abs": F.col("abs_c") - F.col("abs_a")})
    both = average_rank(average_rank(both, -F.col("abs_a"), "rank_a"), -F.col("abs_c"), "rank_c")
    return both.join(groups, "feature", "left") if groups is not None else both


def local_attribution(df: DataFrame, key: str, coefficients: dict[str, float], means: dict[str, float],
                      label: str | None = None) -> DataFrame:
    """phi = coefficient × (x − train mean) per row and feature, in long form.

    Exact for linear models; sums to margin minus the mean margin.
    """
    cells = F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), (F.lit(float(w)) * (F.col(f) - F.lit(float(means[f])))).alias("phi"))
        for f, w in coefficients.items()])).alias("cell")
    keys = [key, *([label] if label else [])]
    return df.select(*keys, cells).select(*keys, "cell.*")


def pair_attributions(a: DataFrame, c: DataFrame, keys: list[str]) -> DataFrame:
    left = a.withColumnRenamed("phi", "phi_a")
    return left.join(c.select(*keys, F.col("phi").alias("phi_c")), keys, "inner")


def local_change(phi: DataFrame, key: str) -> DataFrame:
    """Σ|φC − φA| per row, raw and after scaling each row's |φ| to 1.

    One pass: per row the features are folded as an array of pairs, whose
    length is the number of features.
    """
    pairs = phi.groupBy(key).agg(
        F.sum(F.abs("phi_a")).alias("norm_a"), F.sum(F.abs("phi_c")).alias("norm_c"),
        F.sum(F.abs(F.col("phi_c") - F.col("phi_a"))).alias("raw_change"),
        F.array_sort(F.collect_list(F.struct("feature", "phi_a", "phi_c"))).alias("_cells"))

    def add(acc: Column, x: Column) -> Column:
        return acc + F.abs(x["phi_c"] / F.col("norm_c") - x["phi_a"] / F.col("norm_a"))

    scaled = F.aggregate("_cells", F.lit(0.0), add)
    positive = (F.col("norm_a") > 0) & (F.col("norm_c") > 0)
    guarded = F.when(positive, scaled).otherwise(F.raise_error(F.lit("row without attribution")).cast("double"))
    return pairs.select(key, "raw_change", guarded.alias("normalized_change"))


def global_attribution(phi: DataFrame, label: str) -> DataFrame:
    """Mean |φ| per feature for all rows and for each class, and the change."""
    sets = phi.groupingSets([[F.col("feature")], [F.col("feature"), F.col(label)]], "feature", label).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.abs("phi_a")).alias("mean_abs_a"), F.avg(F.abs("phi_c")).alias("mean_abs_c"),
        F.grouping(label).alias("_all"))
    stratum = F.when(F.col("_all") == 1, "all").when(F.col(label) == 1, "positive").otherwise("negative")
    return sets.select("feature", stratum.alias("stratum"), "rows", "mean_abs_a", "mean_abs_c",
                       (F.col("mean_abs_c") - F.col("mean_abs_a")).alias("delta"))


def _runs(cols: list[str], repeats: int, runs: list[tuple[str, int]] | None) -> list[tuple[str, int]]:
    return list(runs) if runs is not None else [(c, r) for c in cols for r in range(repeats)]


def with_permuted(df: DataFrame, key: str, runs: list[tuple[str, int]], seed: int) -> DataFrame:
    """The rows with ``_moved``: the value that each run (feature, repeat) gives them.

    The i-th row by one hash receives the value of the i-th row by another,
    which is a permutation made by two hash orders.  The receiving order is the
    same for all runs, so rows are numbered once; the values that go to one
    position gather in one row, which meets it in one join.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("_run"), F.lit(f).alias("feature"), F.lit(r).alias("repeat"),
                                         F.col(f).cast("double").alias("value")) for i, (f, r) in enumerate(runs)])).alias("cell")
    long = df.select(key, cells).select(key, "cell.*")
    order = h60(seed, "from", F.col("feature"), F.col("repeat"), F.col(key))
    source = hash_ordinal(long, ["_run"], order, key, "_pos", None, CUT_BITS)
    moved = source.groupBy("_pos").agg(F.array(*[
        F.max(F.when(F.col("_run") == i, F.col("value"))) for i in range(len(runs))]).alias("_moved"))
    target = hash_ordinal(df, [], h60("to", F.col(key)), key, "_pos", None, CUT_BITS)
    return target.join(moved, "_pos", "inner").drop("_pos")


def _run_cells(runs: list[tuple[str, int]], more=lambda i: []) -> Column:
    """One struct per run: feature, repeat, the value received and what ``more`` adds."""
    return F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(r).alias("repeat"), F.col("_moved")[i].alias("value"), *more(i))
                               for i, (f, r) in enumerate(runs)]))


def permuted_rows(df: DataFrame, key: str, cols: list[str], repeats: int, seed: int) -> DataFrame:
    """Long form of permuted values: (key, feature, repeat, value)."""
    runs = _runs(cols, repeats, None)
    wide = with_permuted(df.select(key, *cols), key, runs, seed)
    return wide.select(key, _run_cells(runs).alias("cell")).select(key, "cell.*")


def permutation_importance(df: DataFrame, key: str, label: str, cols: list[str], margin_weights: dict[str, float],
                           intercept: float, repeats: int, seed: int, runs: list[tuple[str, int]] | None = None) -> DataFrame:
    """Drop of MCC per feature and repeat for a linear score.

    A permuted row differs from the original in one feature, so its margin is
    the original margin plus one weighted difference: no re-scoring.  ``runs``
    chooses some (feature, repeat) alone.
    """
    base = F.lit(float(intercept))
    for c, w in margin_weights.items():
        base = base + F.col(c) * F.lit(float(w))
    runs = _runs(cols, repeats, runs)

    def hit(i: int) -> list[Column]:
        change = F.lit(float(margin_weights[runs[i][0]])) * (F.col("_moved")[i] - F.col(runs[i][0]).cast("double"))
        return [(F.col("_margin") + change >= 0).cast("int").alias("_z")]

    rows = df.withColumn("_margin", base).select(key, label, "_margin", *dict.fromkeys(cols))
    moved = with_permuted(rows, key, runs, seed).select(label, _run_cells(runs, hit).alias("cell")).select(label, "cell.*")
    return _importance(df.withColumn("_z", (base >= 0).cast("int")), moved, label)


def model_permutation_importance(df: DataFrame, key: str, label: str, cols: list[str], score_fn, repeats: int,
                                 seed: int) -> DataFrame:
    """The same for any model: ``score_fn`` adds ``predicted`` to a table that
    has all feature columns; one widened scoring pass."""
    moved = permuted_rows(df, key, cols, repeats, seed)
    wide = moved.join(df, key, "inner").withColumns({
        c: F.when(F.col("feature") == c, F.col("value")).otherwise(F.col(c).cast("double")) for c in cols})
    return _importance(score_fn(df).withColumn("_z", F.col("predicted")),
                       score_fn(wide).withColumn("_z", F.col("predicted")), label)


def shuffled_positions(pos: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0..n-1, applied to any of its positions.

    Four Feistel rounds permute the next power of four; positions that land
    beyond n - 1 walk on until they are inside, which keeps it one to one.
    """
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    out = pos.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for i in range(4):
            x = (right + np.uint64((key + (i + 1) * 0x9E3779B97F4A7C15) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((x >> np.uint64(32)) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def source_positions(pos: np.ndarray, n: int, key: int) -> np.ndarray:
    """The positions that ``shuffled_positions`` moves to ``pos``: its rounds backwards."""
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    out = pos.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for i in reversed(range(4)):
            x = (left + np.uint64((key + (i + 1) * 0x9E3779B97F4A7C15) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right ^ ((x >> np.uint64(32)) & mask), left
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def run_key(seed: int, feature: str, repeat: int) -> int:
    return int(hashlib.sha256(f"{seed}|run|{feature}|{repeat}".encode()).hexdigest()[:15], 16)


def moved_values(numbered: DataFrame, n: int, runs: list[tuple[str, int]], seed: int) -> DataFrame:
    """pos and ``moved``: for each run (feature, repeat), the value that the position receives.

    Every row sends its values to the positions that the runs' permutations
    give, packed per group of positions: one exchange for all runs, no sort.
    """
    cols = sorted({f for f, _ in runs})
    keys = [(cols.index(f), run_key(seed, f, r)) for f, r in runs]
    width = len(runs)

    def send(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                pos = b.column("pos").to_numpy()
                x = [b.column(c).to_numpy(zero_copy_only=False) for c in cols]
                to = np.stack([shuffled_positions(pos, n, key) for _, key in keys])
                value = np.stack([x[k] for k, _ in keys]).ravel()
                group = (to // EXCHANGE_ROWS).ravel()
                cell = (to % EXCHANGE_ROWS * width + np.arange(width)[:, None]).ravel().astype(np.int32)
                order = np.argsort(group, kind="stable")
                first = np.flatnonzero(np.diff(group[order], prepend=-1))
                ends = np.append(first[1:], len(order))
                yield pa.RecordBatch.from_pydict({
                    "_group": pa.array(group[order][first], pa.int64()),
                    "_cells": pa.array([cell[order[i:j]].tobytes() for i, j in zip(first, ends)], pa.binary()),
                    "_values": pa.array([value[order[i:j]].tobytes() for i, j in zip(first, ends)], pa.binary())})

    def receive(table: pa.Table) -> pa.Table:
        base = table.column("_group")[0].as_py() * EXCHANGE_ROWS
        rows = min(EXCHANGE_ROWS, n - base)
        out = np.full(rows * width, np.nan)
        for cells, values in zip(table.column("_cells"), table.column("_values")):
            out[np.frombuffer(cells.as_buffer(), np.int32)] = np.frombuffer(values.as_buffer(), np.float64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * width, pa.int32()), pa.array(out))
        return pa.table({"pos": pa.array(base + np.arange(rows), pa.int64()), "moved": lists})

    values = numbered.select(F.col("pos").cast("bigint"), *[F.col(c).cast("double") for c in cols])
    sent = values.mapInArrow(send, "_group long, _cells binary, _values binary")
    return sent.groupBy("_group").applyInArrow(receive, "pos long, moved array<double>")


def keyed_permutation_importance(df: DataFrame, key: str, label: str, cols: list[str], score_fn, repeats: int,
                                 seed: int, runs: list[tuple[str, int]] | None = None) -> DataFrame:
    """Drop of MCC per feature and repeat for any model.

    ``score_fn`` adds ``predicted`` to a table that has all feature columns;
    one widened scoring pass.  ``runs`` chooses some (feature, repeat) alone.
    """
    runs = runs or [(c, r) for c in cols for r in range(repeats)]
    numbered = checkpointed(hash_ordinal(df.select(key, label, *cols), [], h60("position", F.col(key)), key, "pos"))
    n = numbered.count()
    moved = numbered.join(moved_values(numbered, n, runs, seed), "pos", "inner")
    moved = moved.select(key, label, *cols, F.posexplode("moved").alias("_run", "_value"))
    names = F.array(*[F.lit(f) for f, _ in runs]), F.array(*[F.lit(r) for _, r in runs])
    wide = moved.select(key, label, names[0][F.col("_run")].alias("feature"), names[1][F.col("_run")].alias("repeat"), "_value", *cols)
    wide = wide.withColumns({c: F.when(F.col("feature") == c, F.col("_value")).otherwise(F.col(c).cast("double")) for c in cols})
    return _importance(score_fn(df).withColumn("_z", F.col("predicted")),
                       score_fn(wide).withColumn("_z", F.col("predicted")), label)


def tree_permutation_importance(df: DataFrame, key: str, label: str, cols: list[str], trees: Trees, scored: DataFrame, repeats: int,
                                seed: int, runs: list[tuple[str, int]] | None = None, chunk: int = CHUNK, sent: int = SENT,
                                met: int = MET) -> DataFrame:
    """The same drops as ``keyed_permutation_importance`` for boosted trees, whose features are ``cols``.

    A permuted row differs in one value, so a row needs one decision for each
    place that the value may have between the trees' thresholds.  A task holds
    the places of one feature, a byte a row, and looks every receiving row's
    up by the permutation run backwards: no row is widened or sent by run.
    ``scored`` has the rows' own decisions.
    """
    runs = runs or [(c, r) for c in cols for r in range(repeats)]
    numbered = checkpointed(hash_ordinal(df.select(key, label, *cols), [], h60("position", F.col(key)), key, "pos").drop(key, "n"))
    n = numbered.count()
    spark = df.sparkSession
    wanted = sorted({cols.index(f) for f, _ in runs})
    many = -(-4 * spark.sparkContext.defaultParallelism // len(wanted))
    numbers = {f: [i for i, run in enumerate(runs) if run[0] == cols[f]] for f in wanted}
    parts = {f: [some for some in (numbers[f][i::many] for i in range(many)) if some] for f in wanted}
    blocks, ranges = -(-n // sent), -(-n // met)
    model = Responses(trees, len(cols))
    names = ["_feature", "_part", "_block", "_range", "_kind", "_chunk", "_first", "_second"]

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        at = table.column("_chunk")[0].as_py()
        x = np.stack([table.column(c).to_numpy() for c in cols], axis=1)
        same, back = np.unique(np.stack([model.codes(x[:, f], f) for f in range(len(cols))], axis=1), axis=0, return_inverse=True)
        made: dict[int, list] = {f: [] for f in wanted}
        for a in range(0, len(same), 512):
            for f, hit in model.decisions(list(same[a:a + 512].T), wanted).items():
                made[f].append(np.packbits(hit.T, axis=1))
        labels, rows = np.packbits(table.column(label).to_numpy() == 1).tobytes(), []
        for f in wanted:
            codes, hits = model.codes(x[:, f], f).tobytes(), np.concatenate(made[f])[back].tobytes()
            for p in range(len(parts[f])):
                rows += [(f, p, at * chunk // sent, r, 0, at, codes, None) for r in range(ranges)]
                rows += [(f, p, b, at * chunk // met, 1, at, hits, labels) for b in range(blocks)]
        return pa.table(dict(zip(names, (pa.array(list(c), pa.binary() if i > 5 else pa.int32()) for i, c in enumerate(zip(*rows))))))

    def count(batches):
        at, places, sums = None, [], {}
        for b in batches:
            for f, p, block, span, kind, c, first, second in zip(*(b.column(k) for k in names)):
                f, now = f.as_py(), (f.as_py(), p.as_py(), block.as_py(), span.as_py())
                if now != at:
                    at, places = now, []
                width = len(model.points[f])
                if kind.as_py() == 0:
                    places.append(np.frombuffer(first.as_buffer(), np.min_scalar_type(width)))
                    continue
                if len(places) > 1:
                    places = [np.concatenate(places)]
                base, low = c.as_py() * chunk, now[2] * sent
                hits = np.frombuffer(first.as_buffer(), np.uint8).reshape(-1, width // 8 + 1)
                y = np.unpackbits(np.frombuffer(second.as_buffer(), np.uint8), count=len(hits))
                for run in parts[f][now[1]]:
                    rows = np.arange(len(hits))
                    source = source_positions(base + rows, n, run_key(seed, *runs[run])) - low
                    if blocks > 1:
                        rows = rows[(source >= 0) & (source < sent)]
                        source = source[rows]
                    v = places[0][source]
                    z = hits[rows, v >> 3] >> (7 - (v & 7)).astype(np.uint8) & 1
                    sums[run] = sums.get(run, 0) + np.bincount(2 * y[rows] + z, minlength=4)
        found = np.array([list(k) for k in sums.values()]).reshape(-1, 4).T
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), *(pa.array(k, pa.int64()) for k in found)],
                                         names=["_run", "tn", "fp", "fn", "tp"])

    values = numbered.select(F.col("pos").cast("bigint"), F.floor(F.col("pos") / chunk).cast("int").alias("_chunk"), F.col(label).cast("int"),
                             *[F.col(c).cast("double") for c in cols])
    packed = values.groupBy("_chunk").applyInArrow(pack, ", ".join(f"{k} {'binary' if i > 5 else 'int'}" for i, k in enumerate(names)))
    apart = sum(map(len, parts.values())) * blocks * ranges
    packed = packed.repartition(max(shuffle_width(spark), apart), *names[:4]).sortWithinPartitions(*names[:6])
    cells = packed.mapInArrow(count, "_run int, tn long, fp long, fn long, tp long")
    cells = cells.groupBy("_run").agg(*[F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp")])
    name = [F.array(*[F.lit(x) for x in side])[F.col("_run")].alias(c) for c, side in zip(("feature", "repeat"), zip(*runs))]
    return _drops(scored.withColumn("_z", F.col("predicted")), cells.select(*name, "tn", "fp", "fn", "tp"), label)


def _importance(plain: DataFrame, moved: DataFrame, label: str) -> DataFrame:
    return _drops(plain, _cells(moved, ["feature", "repeat"], label), label)


def _cells(df: DataFrame, by: list[str], label: str) -> DataFrame:
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in confusion_cells(F.col(label), F.col("_z")).items()])


def _drops(plain: DataFrame, moved: DataFrame, label: str) -> DataFrame:
    """Drop of MCC from the plain rows to each run's confusion cells."""
    mcc = confusion_metrics("tn", "fp", "fn", "tp")["mcc"]
    baseline = _cells(plain, [], label).select(mcc.alias("mcc")).scalar()
    out = moved.select("feature", "repeat", mcc.alias("permuted_mcc"))
    return out.withColumn("baseline_mcc", baseline).withColumn(
        "importance", F.col("baseline_mcc") - F.col("permuted_mcc"))


def replay_difference(saved: DataFrame, again: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Largest difference over the replayed rows."""
    both = again.select(*keys, F.col(value).alias("_again")).join(saved.select(*keys, value), keys, "left")
    diff = F.abs(F.col(value) - F.col("_again"))
    return both.agg(F.count(F.lit(1)).alias("compared"), F.max(diff).alias("max_abs_diff"),
                    (F.count_if(F.coalesce(diff, F.lit(1.0)) > 0) == 0).alias("equal"))


def replay_subset(df: DataFrame, key: str, salt: str, n: int) -> DataFrame:
    return first_by_hash(df, h60(salt, F.col(key)), key, n)


# ---------------------------------------------------------------- token coefficients

def top_tokens(tokens: DataFrame, k: int = 50) -> DataFrame:
    """First k tokens per regime by positive, negative and absolute weight."""
    lists = F.explode(F.array(
        F.struct(F.lit("positive").alias("list_type"), F.col("coefficient").alias("_by")),
        F.struct(F.lit("negative").alias("list_type"), (-F.col("coefficient")).alias("_by")),
        F.struct(F.lit("absolute").alias("list_type"), F.abs("coefficient").alias("_by")))).alias("l")
    rows = tokens.select("regime", "token", "coefficient", lists).select("regime", "token", "coefficient", "l.*")
    order = Window.partitionBy("regime", "list_type").orderBy(F.desc("_by"), F.asc("token"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("_by")


def shared_vocab(a: DataFrame, c: DataFrame) -> DataFrame:
    return (a.select("token", F.col("coefficient").alias("coefficient_a"))
            .join(c.select("token", F.col("coefficient").alias("coefficient_c")), "token", "inner"))


def compare_vocab(a: DataFrame, c: DataFrame) -> DataFrame:
    """Vocabulary sizes, shared share, sign agreement and rank correlation."""
    shared = shared_vocab(a, c)
    same = (F.signum("coefficient_a") == F.signum("coefficient_c")).cast("double")
    out = shared.agg(F.count(F.lit(1)).alias("shared"), F.avg(same).alias("sign_agreement"))
    out = out.withColumns({"size_a": a.agg(F.count(F.lit(1))).scalar(), "size_c": c.agg(F.count(F.lit(1))).scalar(),
                           "abs_spearman": spearman(shared, "coefficient_a", "coefficient_c", True).scalar()})
    return out.withColumns({"shared_share_a": ratio(F.col("shared"), F.col("size_a")),
                            "shared_share_c": ratio(F.col("shared"), F.col("size_c"))})


def topk_overlap(tokens: DataFrame, regimes: tuple[str, str], k: int = 50) -> DataFrame:
    """Intersection, union, Jaccard and sign agreement of two absolute top lists."""
    top = top_tokens(tokens, k).where("list_type = 'absolute'")
    per = top.groupBy("token").agg(
        *[F.max(F.when(F.col("regime") == r, F.signum("coefficient"))).alias(f"s{i}") for i, r in enumerate(regimes)])
    a, c = F.col("s0").isNotNull(), F.col("s1").isNotNull()
    both = F.count_if(a & c)
    agree = F.count_if(F.col("s0") == F.col("s1"))
    return per.agg(F.lit(k).alias("k"), F.count_if(a).alias("size_a"), F.count_if(c).alias("size_c"),
                   both.alias("intersection"), F.count(F.lit(1)).alias("union"),
                   ratio(both, F.count(F.lit(1))).alias("jaccard"),
                   agree.alias("sign_agreements"), ratio(agree, both, None).alias("sign_agreement_rate"))


def set_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Sizes, union and Jaccard of two key sets."""
    flags = (a.select(key, F.lit(1).alias("fa"), F.lit(0).alias("fb"))
             .unionByName(b.select(key, F.lit(0).alias("fa"), F.lit(1).alias("fb")))
             .groupBy(key).agg(F.max("fa").alias("fa"), F.max("fb").alias("fb")))
    both = F.count_if(F.expr("fa = 1 AND fb = 1"))
    return flags.agg(F.sum("fa").alias("size_a"), F.sum("fb").alias("size_b"), both.alias("intersection"),
                     F.count(F.lit(1)).alias("union"), ratio(both, F.count(F.lit(1))).alias("jaccard"))


def largest_change(df: DataFrame, value: str, n: int, tie: list[str]) -> DataFrame:
    return df.orderBy(F.abs(F.col(value)).desc(), *[F.asc(c) for c in tie]).limit(n)


# ---------------------------------------------------------------- summaries

def attribution_summary(parts: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """(model, metric, value) rows from one-row, one-column results."""
    out = None
    for model, metric, df in parts:
        row = df.select(F.lit(model).alias("model"), F.lit(metric).alias("metric"),
                        F.col(df.columns[0]).cast("double").alias("value"))
        out = row if out is None else out.unionByName(row)
    return out


def change_frame(coefficients: DataFrame, global_phi: DataFrame) -> DataFrame:
    """Both kinds of change in one long table, ready for plotting."""
    m1 = coefficients.select(F.lit("M1").alias("model"), "feature", F.lit("all").alias("stratum"),
                             F.lit("delta_abs").alias("change"), F.col("delta_abs").alias("value"))
    m2 = global_phi.select(F.lit("M2").alias("model"), "feature", "stratum",
                           F.lit("delta_mean_abs").alias("change"), F.col("delta").alias("value"))
    return m1.unionByName(m2)

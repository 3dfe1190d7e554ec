"""Class-stratified site-cluster bootstrap.

Rows are first reduced to one row of confusion cells per site.  A replicate
draws as many sites of a class as the class has, with replacement: a
multinomial.  It is generated from counters where it is needed and never stored
or shuffled: the sites of a class are cut into leaves of ``LEAF`` ordinals,
exact binomials down a tree say how many draws fall into a leaf, and a counter
hash places them inside.  A task can so make the multiplicities of any leaf and
any replicates by itself, the same each time; chosen replicates cost their share.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from siteval.functions.hashing import digest, h60
from siteval.functions.stats import confusion_cells, confusion_metrics, ratio
from siteval.operators.joins import hot_key_join, join_null_safe
from siteval.operators.ranking import checkpointed, global_prefix, hash_ordinal, shuffle_width, value_ranges

REPLICATES = 2_000
BLOCK = 256  # replicates worked on together
LEAF = 4_096  # clusters whose multiplicities are made at once
TILE = 1 << 22  # score rows that a task holds at once
HELD = 1 << 28  # bytes of multiplicities that a task holds at once
SLICE = 1 << 17  # rows x replicates walked at once
RANK_METRICS = ("pr_auc", "roc_auc")
THRESHOLD_METRICS = ("mcc", "precision", "recall", "specificity", "fpr", "balanced_accuracy", "macro_f1")
CELLS = ("tn", "fp", "fn", "tp")

# the counter hash: steps of GAMMA from a key, mixed by two multiplications (fixed values of splitmix64)
GAMMA, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def stream_id(by: list[str], purpose: str) -> Column:
    """Identity of the random stream of an experiment and purpose."""
    return digest(*[F.col(c) for c in by], purpose)


def check_streams(experiments: DataFrame, by: list[str], purposes: list[str]) -> DataFrame:
    """Streams and distinct streams; equal numbers mean no collision."""
    streams = experiments.select(*by).distinct().select(
        F.explode(F.array(*[stream_id(by, p) for p in purposes])).alias("stream"))
    return streams.agg(F.count("stream").alias("streams"), F.countDistinct("stream").alias("distinct_streams"))


def preflight(pred: DataFrame, id_col: str, site: str, label: str, score: str, predicted: str) -> DataFrame:
    """Named counts that must be zero (or, for classes, two) before sampling."""
    ids = pred.groupBy(id_col).agg(F.count(F.lit(1)).alias("c")).agg(F.count_if(F.col("c") > 1)).scalar()
    p = F.col(score)
    bad = F.isnan(p) | p.isNull() | (p < 0) | (p > 1)
    return pred.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.coalesce(F.col(site).cast("string"), F.lit("")) == "").alias("empty_sites"),
        F.countDistinct(label).alias("classes"), F.count_if(bad).alias("bad_scores"),
        F.count_if(F.col(predicted) != (p >= 0.5).cast("int")).alias("label_mismatches"),
    ).withColumn("repeated_ids", ids)


def clusters(pred: DataFrame, by: list[str], site: str, label: str = "label", score: str = "score") -> DataFrame:
    """One row per site: class, confusion cells, number within its class.

    A site with both labels is an error.
    """
    predicted = (F.col(score) >= 0.5).cast("int")
    cells = confusion_cells(F.col(label), predicted)
    per = pred.groupBy(*by, site).agg(
        F.min(label).alias("class"), F.max(label).alias("_hi"), F.count(F.lit(1)).alias("rows"),
        *[c.alias(n) for n, c in cells.items()])
    per = per.withColumn("class", F.when(F.col("class") == F.col("_hi"), F.col("class"))
                         .otherwise(F.raise_error(F.lit("site has both labels")).cast("int"))).drop("_hi")
    return hash_ordinal(per, [*by, "class"], h60("cluster", F.col(site)), site, "ordinal", "n")


# ---------------------------------------------------------------- the draws of a leaf

def _sha(*parts) -> str:
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()


def mixed(x: np.ndarray, room: np.ndarray | None = None) -> np.ndarray:
    """``x`` itself, mixed in place; ``room`` is as long."""
    room = np.empty_like(x) if room is None else room
    for shift, factor in ((30, MIX_1), (27, MIX_2)):
        x ^= np.right_shift(x, np.uint64(shift), out=room)
        x *= np.uint64(factor)
    x ^= np.right_shift(x, np.uint64(31), out=room)
    return x


def leaf_counts(source: tuple, n: int, leaf: int, block: int, size: int = LEAF) -> np.ndarray:
    """Draws that fall into a leaf in each replicate of a block: binomials from the root down."""
    counts, low, high = np.full(BLOCK, n), 0, -(-n // size)
    while high - low > 1:
        mid = (low + high) // 2
        share = (mid - low) * size / (min(high * size, n) - low * size)
        rng = np.random.Generator(np.random.Philox(key=int(_sha(*source, low, high, block)[:32], 16)))
        first = rng.binomial(counts, share)
        if leaf < mid:
            counts, high = first, mid
        else:
            counts, low = counts - first, mid
    return counts


def leaf_multiplicities(source: tuple, n: int, leaf: int, block: int, lanes: list[int], size: int = LEAF) -> np.ndarray:
    """Ordinals of a leaf x lanes: how often each replicate drew each cluster.

    ``source`` is (seed, stream, class); draw i of a replicate takes slot
    (hash(key + (i + 1) * GAMMA) >> 4) mod (slots of the leaf).
    """
    counts = leaf_counts(source, n, leaf, block, size)
    slots = min(size, n - leaf * size)
    steps = np.arange(1, int(counts.max()) + 1, dtype=np.uint64) * np.uint64(GAMMA)
    out, held, room = np.empty((len(lanes), slots), np.uint16), np.empty_like(steps), np.empty_like(steps)
    for k, lane in enumerate(lanes):
        key = (int(_sha(*source, block * BLOCK + lane)[:15], 16) + (leaf * MIX_1)) % (1 << 64)
        drawn = int(counts[lane])
        slot = mixed(np.add(steps[:drawn], np.uint64(key), out=held[:drawn]), room[:drawn])
        slot >>= np.uint64(4)
        if slots & (slots - 1):
            slot %= np.uint64(slots)
        else:
            slot &= np.uint64(slots - 1)
        out[k] = np.bincount(slot.view(np.int64), minlength=slots)
    return out.T  # lanes stay together in memory


def blocks_of(replicates) -> dict[int, list[int]]:
    """Block -> lanes, for a number of replicates or chosen ones."""
    chosen = range(replicates) if isinstance(replicates, int) else sorted(set(replicates))
    out: dict[int, list[int]] = {}
    for r in chosen:
        out.setdefault(r // BLOCK, []).append(r % BLOCK)
    return out


def _leaf(size: int) -> Column:
    return F.floor(F.col("ordinal") / size).cast("int")


def _leaves(cluster_table: DataFrame, by: list[str], purpose: str, leaf_size: int) -> DataFrame:
    """by, class, n, _stream and _leaf of every leaf, dealt over all tasks."""
    strata = cluster_table.groupBy(*by, "class").agg(F.max("n").alias("n"))
    leaves = strata.select("*", stream_id(by, purpose).alias("_stream"),
                           F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / leaf_size).cast("int"))).alias("_leaf"))
    return leaves.repartition(shuffle_width(leaves.sparkSession))


def draw_clusters(cluster_table: DataFrame, by: list[str], replicates, seed: int, purpose: str = "draws",
                  leaf_size: int = LEAF) -> DataFrame:
    """One row per cluster: by, class, ordinal and its multiplicity in each replicate, as an array."""
    leaves = _leaves(cluster_table, by, purpose, leaf_size)
    schema = StructType([cluster_table.schema[k] for k in [*by, "class", "ordinal"]] + [StructField("multiplicities", ArrayType(IntegerType()))])
    blocks = blocks_of(replicates)

    def run(batches):
        for b in batches:
            for i, (stream, cls, n, leaf) in enumerate(zip(*(b.column(c).to_pylist() for c in ("_stream", "class", "n", "_leaf")))):
                made = np.hstack([leaf_multiplicities((seed, stream, cls), n, leaf, k, lanes, leaf_size) for k, lanes in blocks.items()])
                for at in range(0, len(made), 256):
                    part = made[at:at + 256].astype(np.int32)
                    same = pa.array(np.full(len(part), i))
                    ordinals = pa.array(leaf * leaf_size + at + np.arange(len(part)), pa.int64())
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * part.shape[1], pa.int32()), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([*(b.column(c).take(same) for c in [*by, "class"]),
                                                      ordinals.cast(pa.int32()) if narrow else ordinals, lists], names=schema.names)

    narrow = schema["ordinal"].dataType == IntegerType()
    return leaves.mapInArrow(run, schema)


def listed_digests(made: np.ndarray, names: np.ndarray) -> list[str]:
    """SHA-256 of every cluster's list ``replicate:multiplicity,...`` of the replicates that drew it.

    ``made`` is clusters x replicates.  All lists are cut from one text that
    names every replicate, with the multiplicity's digit filled in.
    """
    heads = [f"{r}:".encode() for r in names.tolist()]
    widths = np.array([len(h) + 2 for h in heads])
    text = np.frombuffer(b"".join(h + b"0," for h in heads), np.uint8).copy()
    digit = np.cumsum(widths) - 2
    out = []
    for ks in made:
        if ks.max(initial=0) > 9:
            listed = b",".join(h + str(k).encode() for h, k in zip(heads, ks.tolist()) if k)
        else:
            text[digit] = ks + 48
            listed = text[np.repeat(ks > 0, widths)][:-1].tobytes()
        out.append(hashlib.sha256(listed).hexdigest())
    return out


def draw_digests(cluster_table: DataFrame, by: list[str], replicates, seed: int, purpose: str = "draws", leaf_size: int = LEAF) -> DataFrame:
    """One row per drawn cluster: by, class, ordinal, the replicates that drew it, draws, most draws and the digest of their list.

    A task makes the multiplicities of a leaf and reduces them there.
    """
    leaves = _leaves(cluster_table, by, purpose, leaf_size)
    kept = [*by, "class"]
    schema = StructType([cluster_table.schema[k] for k in kept] + [StructField(k, LongType()) for k in ("ordinal", "replicates", "draws", "most")]
                        + [StructField("multiplicities_sha256", StringType())])
    blocks = blocks_of(replicates)
    names = np.array([k * BLOCK + lane for k, lanes in blocks.items() for lane in lanes])

    def run(batches):
        for b in batches:
            for i, (stream, cls, n, leaf) in enumerate(zip(*(b.column(c).to_pylist() for c in ("_stream", "class", "n", "_leaf")))):
                made = np.hstack([leaf_multiplicities((seed, stream, cls), n, leaf, k, lanes, leaf_size) for k, lanes in blocks.items()])
                at = np.flatnonzero(made.any(axis=1))
                made = made[at]
                found = (leaf * leaf_size + at, np.count_nonzero(made, axis=1), made.sum(axis=1, dtype=np.int64), made.max(axis=1, initial=0))
                same = pa.array(np.full(len(at), i))
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(same) for c in kept), *(pa.array(x.astype(np.int64)) for x in found),
                                                  pa.array(listed_digests(made, names), pa.string())], names=schema.names)

    return leaves.mapInArrow(run, schema).withColumn("ordinal", F.col("ordinal").cast(cluster_table.schema["ordinal"].dataType))


def single_draws(drawn: DataFrame, by: list[str], replicates) -> DataFrame:
    """by, replicate, class, ordinal, multiplicity: one row per drawn cluster and replicate."""
    names = F.array(*[F.lit(k * BLOCK + lane) for k, lanes in blocks_of(replicates).items() for lane in lanes])
    rows = drawn.select(*by, "class", "ordinal", F.posexplode("multiplicities").alias("_at", "multiplicity"))
    return rows.where("multiplicity > 0").select(*by, names[F.col("_at")].alias("replicate"), "class", "ordinal", "multiplicity")


def _per_replicate(arrays: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Arrays over blocks (by, _rb) as summed numbers per replicate; replicates
    that nothing was drawn for are left out."""
    zipped = F.posexplode(F.arrays_zip(*names)).alias("_lane", "_v")
    rows = arrays.select(*by, "_rb", zipped).select(
        *by, (F.col("_rb") * BLOCK + F.col("_lane")).cast("int").alias("replicate"), "_v.*")
    return rows.groupBy(*by, "replicate").agg(*[F.sum(n).alias(n) for n in names])


def replicate_metrics(cluster_table: DataFrame, by: list[str], replicates, seed: int, purpose: str = "draws",
                      leaf_size: int = LEAF) -> DataFrame:
    """Weighted confusion and threshold metrics per replicate.

    A group is the clusters of one leaf; only its sums over each block of
    replicates are shuffled.
    """
    names = [*CELLS, "drawn"]
    blocks = blocks_of(replicates)
    leaves = cluster_table.select(*by, "class", "ordinal", "n", *CELLS, _leaf(leaf_size).alias("_leaf"), stream_id(by, purpose).alias("_stream"))

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        head, out = rows.iloc[0], []
        values = np.vstack([rows[list(CELLS)].to_numpy(np.float64).T, np.ones(len(rows))])
        local = rows["ordinal"].to_numpy() - int(head["_leaf"]) * leaf_size
        source = (seed, head["_stream"], head["class"])
        for block, lanes in blocks.items():
            weights = leaf_multiplicities(source, int(head["n"]), int(head["_leaf"]), block, lanes, leaf_size)
            sums = np.zeros((len(names), BLOCK))
            sums[:, lanes] = values @ weights[local].astype(np.float64)
            out.append((*head[by], block, *sums))
        return pd.DataFrame(out, columns=[*by, "_rb", *names])

    schema = StructType([leaves.schema[k] for k in by] + [StructField("_rb", IntegerType())]
                        + [StructField(n, ArrayType(DoubleType())) for n in names])
    sums = leaves.groupBy(*by, "class", "_leaf").applyInPandas(add, schema)
    wide = _per_replicate(sums, by, names).where("drawn > 0").drop("drawn")
    wide = wide.withColumns({c: F.col(c).cast("bigint") for c in CELLS})
    return wide.withColumns(confusion_metrics(*CELLS, default=None))


def score_rows(pred: DataFrame, cluster_table: DataFrame, by: list[str], site: str, label: str = "label",
               score: str = "score") -> DataFrame:
    """Site × tied score: positives, totals and score range."""
    per = pred.groupBy(*by, site, score).agg(
        F.sum(label).cast("bigint").alias("pos"), F.count(F.lit(1)).alias("tot"))
    side = cluster_table.select(*by, site, "class", "ordinal", "n", F.col("rows").alias("_count"))
    numbered = hot_key_join(per, side, [*by, site], "_count", [score])
    return value_ranges(numbered.drop(site), score, "_range")


def _score_tiles(scores: DataFrame, by: list[str], tile: int) -> DataFrame:
    """by, _range, _tile: neighbouring ranges joined to tiles of about ``tile`` rows, the highest scores first."""
    found = scores.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_c"))
    all_rows = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    upto = all_rows.orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("_c").over(all_rows)
    before = F.sum("_c").over(upto) - F.col("_c")
    return found.select(*by, "_range", F.floor(before * F.ceil(total / tile) / total).cast("int").alias("_tile"))


def _tile_totals(rows: DataFrame, strata: list[dict], blocks: dict[int, list[int]], seed: int, size: int) -> dict[tuple, np.ndarray]:
    """(experiment, block, tile) -> positives and totals above the tile: 2 x BLOCK numbers for each ``TILE`` rows.

    Rows become one per site and tile first; a group is the sites of a leaf.
    """
    per = rows.groupBy("_stratum", "ordinal", "_tile").agg(F.sum("pos").alias("pos"), F.sum("tot").alias("tot"))
    schema = "_exp int, _rb int, _tile int, sums array<double>"

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        stratum, leaf = strata[int(pdf["_stratum"].iloc[0])], int(pdf["_leaf"].iloc[0])
        slots = min(size, stratum["n"] - leaf * size)
        tiles, at = np.unique(pdf["_tile"].to_numpy(), return_inverse=True)
        cell = at * slots + pdf["ordinal"].to_numpy() - leaf * size
        sides = np.vstack([np.bincount(cell, pdf[c].to_numpy(np.float64), len(tiles) * slots).reshape(len(tiles), slots) for c in ("pos", "tot")])
        out = []
        for block, lanes in blocks.items():
            sums = np.zeros((2 * len(tiles), BLOCK))
            sums[:, lanes] = sides @ leaf_multiplicities((seed, stratum["_stream"], stratum["class"]), stratum["n"], leaf, block, lanes, size).astype(np.float64)
            out += [(stratum["_exp"], block, t, np.concatenate([sums[i], sums[len(tiles) + i]])) for i, t in enumerate(tiles)]
        return pd.DataFrame(out, columns=["_exp", "_rb", "_tile", "sums"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        # one row per leaf that met the tile
        return pdf.iloc[:1].assign(sums=[np.sum(np.stack(pdf["sums"]), axis=0)])

    sums = per.groupBy("_stratum", _leaf(size).alias("_leaf")).applyInPandas(
        lambda key, pdf: add(pdf.assign(_leaf=key[1])), schema)
    found, so_far = {}, {}
    for r in sums.groupBy("_exp", "_rb", "_tile").applyInPandas(merge, schema).orderBy("_exp", "_rb", "_tile").collect():
        k = r["_exp"], r["_rb"]
        found[(*k, r["_tile"])] = so_far.get(k, np.zeros((2, BLOCK)))
        so_far[k] = found[(*k, r["_tile"])] + np.reshape(r["sums"], (2, BLOCK))
    return found


class _Tile:
    """Rows of a tile, highest score first, as small arrays; ``areas`` walks them for some replicates."""

    def __init__(self):
        self.parts, self.last = [], None

    def add(self, site: np.ndarray, scored: np.ndarray, pos: np.ndarray, tot: np.ndarray) -> None:
        new = np.append(self.last is None or scored[0] != self.last, scored[1:] != scored[:-1])
        kept = [x.astype(np.int32) if x.max() < 1 << 31 else x for x in (site, pos, tot)]
        self.parts.append((*kept, new))
        self.last = scored[-1]

    def closed(self) -> None:
        self.site, self.pos, self.tot, new = (np.concatenate(x) for x in zip(*self.parts))
        self.parts = []
        self.end = np.append(new[1:], True)  # the last row of its score
        group = np.flatnonzero(self.end)
        first = np.append(0, group[:-1] + 1)
        self.hit = np.zeros(len(self.end), bool)  # the last row of a score that has positives
        self.hit[group] = np.add.reduceat(self.pos, first, dtype=np.int64) > 0

    def areas(self, weights: np.ndarray, above: np.ndarray) -> np.ndarray:
        """hits, above, pos, neg per lane, from sites x lanes and the totals of the tiles above."""
        lanes = weights.shape[1]
        step = max(256, SLICE // lanes)
        counts = self.pos, self.tot - self.pos
        most = max(int(c.max()) for c in counts) * int(weights.max(initial=0)) * step
        kind = np.int32 if most < 1 << 31 else np.int64
        now, sums = np.stack([above[0], above[1] - above[0]]).astype(np.float64), np.zeros((2, lanes))
        start = now.copy()
        open_ = None  # the totals before a score that began in an earlier slice
        room = np.zeros((2, lanes, step + 1), kind)
        for a in range(0, len(self.site), step):
            rows = slice(a, a + step)
            # lanes x rows: running sums along the rows of memory
            w = np.ascontiguousarray(weights.take(self.site[rows], axis=0).T)
            run = room[:, :, :w.shape[1] + 1]
            for i, c in enumerate(counts):
                np.cumsum(w * c[rows].astype(kind), axis=1, out=run[i, :, 1:])
            ends = np.flatnonzero(self.end[rows]) + 1
            if len(ends):
                before = np.append(0, ends[:-1])
                chosen = self.hit[rows][ends - 1]
                pos, neg = (run[i].take(ends[chosen], axis=1) for i in (0, 1))
                pos_ahead, neg_ahead = (run[i].take(before[chosen], axis=1) for i in (0, 1))
                got = (pos - pos_ahead).astype(np.float64)
                pos, neg, neg_ahead = pos + now[0, :, None], neg + now[1, :, None], neg_ahead + now[1, :, None]
                if open_ is not None and chosen[0]:
                    got[:, 0], neg_ahead[:, 0] = pos[:, 0] - open_[0], open_[1]
                neg_ahead += neg
                sums[1] += np.einsum("ij,ij->i", got, neg_ahead) / 2
                neg += pos
                pos /= np.maximum(neg, 1, out=neg)  # whole numbers: no positives where there are no rows
                sums[0] += np.einsum("ij,ij->i", pos, got)
                open_ = None
            if not self.end[rows][-1] and (open_ is None or len(ends)):
                open_ = now + run[:, :, ends[-1] if len(ends) else 0]
            now = now + run[:, :, -1]
        return np.stack([*sums, *(now - start)])


def replicate_rank_metrics(cluster_table: DataFrame, scores: DataFrame, by: list[str], replicates, seed: int, purpose: str = "draws",
                           score: str = "score", leaf_size: int = LEAF, tile: int = TILE) -> DataFrame:
    """Average precision and ROC area per replicate.

    Score ranges are joined to tiles of about ``tile`` rows.  A first pass sums
    every tile by leaf; in the second a task holds the rows of a tile as small
    arrays, makes the multiplicities of all sites for a few replicates at a
    time (at most ``HELD`` bytes) and walks the rows from the highest score
    down, starting from the totals of the tiles above.  Only plain rows are
    shuffled, never a number per row and replicate.
    """
    spark, blocks = scores.sparkSession, blocks_of(replicates)
    # one row per experiment and class
    strata = [r.asDict() for r in cluster_table.groupBy(*by, "class").agg(F.max("n").alias("n"))
              .select(*by, "class", "n", stream_id(by, purpose).alias("_stream")).orderBy(*by, "class").collect()]
    names = list(dict.fromkeys(tuple(s[k] for k in by) for s in strata))
    for s in strata:
        s["_exp"] = names.index(tuple(s[k] for k in by))
        s["_first"] = sum(o["n"] for o in strata if o.get("_exp") == s["_exp"] and o["class"] < s["class"])
    sites = [sum(s["n"] for s in strata if s["_exp"] == e) for e in range(len(names))]
    heads = StructType([StructField(k, cluster_table.schema[k].dataType) for k in [*by, "class"]]
                       + [StructField(k, IntegerType()) for k in ("_stratum", "_exp")] + [StructField("_first", LongType())])
    known = spark.createDataFrame([(*[s[k] for k in [*by, "class"]], i, s["_exp"], s["_first"]) for i, s in enumerate(strata)], heads)
    tiles = checkpointed(_score_tiles(scores, by, tile))
    rows = join_null_safe(scores, tiles, [*by, "_range"], "left", broadcast=True)
    rows = join_null_safe(rows, known, [*by, "class"], "left", broadcast=True)
    n_tiles = tiles.groupBy(*by).agg((F.max("_tile") + 1).alias("k")).agg(F.max("k"), F.sum("k")).first()
    above = {}
    if (n_tiles[0] or 0) > 1:
        above = _tile_totals(rows.select("_stratum", "ordinal", "_tile", "pos", "tot"), strata, blocks, seed, leaf_size)

    # enough tasks for all cores, each with as many replicates as that leaves
    each = max(1, len(blocks) * (n_tiles[1] or 0) // (4 * spark.sparkContext.defaultParallelism))
    parts = [list(blocks.items())[i:i + each] for i in range(0, len(blocks), each)]
    key = ["_exp", "_tile", "_part"]
    sent = rows.select("_exp", "_tile", F.explode(F.sequence(F.lit(0), F.lit(len(parts) - 1))).alias("_part"),
                       F.col(score).cast("double").alias("_score"), (F.col("_first") + F.col("ordinal")).alias("_site"), "pos", "tot")
    sent = sent.repartition(max(shuffle_width(spark), 2 * len(parts) * (n_tiles[1] or 0)), *key).sortWithinPartitions(*key, F.col("_score").desc())
    results = ["hits", "above", "pos", "neg"]

    def areas(exp: int, number: int, part: int, held: _Tile) -> pd.DataFrame:
        held.closed()
        width, out = max(1, HELD // sites[exp]), []
        for block, lanes in parts[part]:
            ahead = above[exp, block, number] if above else np.zeros((2, BLOCK))
            sums = np.zeros((4, BLOCK))
            for some in (lanes[i:i + width] for i in range(0, len(lanes), width)):
                weights = np.empty((sites[exp], len(some)), np.uint8)
                for s in strata:
                    for leaf in range(-(-s["n"] // leaf_size) if s["_exp"] == exp else 0):
                        made = leaf_multiplicities((seed, s["_stream"], s["class"]), s["n"], leaf, block, some, leaf_size)
                        if made.max(initial=0) > np.iinfo(weights.dtype).max:
                            weights = weights.astype(np.uint16)
                        weights[s["_first"] + leaf * leaf_size:][:len(made)] = made
                sums[:, some] = held.areas(weights, ahead[:, some])
            out.append((exp, block, *sums))
        return pd.DataFrame(out, columns=["_exp", "_rb", *results])

    def walk(batches):
        at, held = None, None
        for b in batches:
            for k, pdf in b.groupby(key, sort=False):
                if k != at:
                    if at is not None:
                        yield areas(*at, held)
                    at, held = k, _Tile()
                held.add(*(pdf[c].to_numpy() for c in ("_site", "_score", "pos", "tot")))
        if at is not None:
            yield areas(*at, held)

    schema = StructType([StructField(k, IntegerType()) for k in ("_exp", "_rb")] + [StructField(n, ArrayType(DoubleType())) for n in results])
    wide = _per_replicate(sent.mapInPandas(walk, schema), ["_exp"], results).where("pos + neg > 0")
    wide = wide.join(F.broadcast(known.select(*by, "_exp").distinct()), "_exp")
    pos, neg = F.col("pos"), F.col("neg")
    return wide.select(*by, "replicate", ratio(F.col("hits"), pos, None).alias("pr_auc"),
                       ratio(pos * neg - F.col("above"), pos * neg, None).alias("roc_auc"))


def bootstrap(pred: DataFrame, by: list[str], site: str, replicates=REPLICATES, seed: int = 42, rank: bool = True,
              label: str = "label", score: str = "score", purpose: str = "draws", table: DataFrame | None = None,
              leaf_size: int = LEAF) -> DataFrame:
    """Replicates (a number of them, or chosen ones) in long form: by, replicate, metric, value."""
    table = checkpointed(clusters(pred, by, site, label, score)) if table is None else table
    wide = replicate_metrics(table, by, replicates, seed, purpose, leaf_size)
    names = list(THRESHOLD_METRICS)
    if rank:
        scores = checkpointed(score_rows(pred, table, by, site, label, score))
        areas = replicate_rank_metrics(table, scores, by, replicates, seed, purpose, score, leaf_size)
        wide = wide.join(areas, [*by, "replicate"], "inner")
        names += RANK_METRICS
    return long_metrics(wide, [*by, "replicate"], names)


def formula_metrics(pred: DataFrame, cluster_table: DataFrame, by: list[str], site: str, replicate: int, seed: int,
                    purpose: str = "draws", label: str = "label", score: str = "score", leaf_size: int = LEAF) -> DataFrame:
    """One replicate by the plain weighted formulas over its rows, in long form:
    sums and running totals of Spark in place of the arrays of ``bootstrap``."""
    drawn = single_draws(draw_clusters(cluster_table, by, [replicate], seed, purpose, leaf_size), by, [replicate])
    weights = cluster_table.join(drawn, [*by, "class", "ordinal"], "left").select(
        *by, site, F.coalesce("multiplicity", F.lit(0)).alias("_weight"), F.col("rows").alias("_count"))
    rows = hot_key_join(pred.select(*by, site, label, score), weights, [*by, site], "_count", [score])
    y, w, z = F.col(label), F.col("_weight"), (F.col(score) >= 0.5).cast("int")
    cell = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}
    wide = rows.groupBy(*by).agg(*[F.sum(F.when((y == a) & (z == b), w).otherwise(0)).alias(c) for c, (a, b) in cell.items()])
    wide = wide.withColumns(confusion_metrics(*CELLS, default=None))
    tied = rows.groupBy(*by, score).agg(F.sum(y * w).alias("_pos"), F.sum(w).alias("_tot"))
    run = global_prefix(tied, [F.col(score).desc()], {"_upto_pos": "_pos", "_upto": "_tot"}, by)
    sums = run.groupBy(*by).agg(
        F.sum(F.when(F.col("_upto") > 0, F.col("_upto_pos") / F.col("_upto") * F.col("_pos"))).alias("_hits"), F.sum("_pos").alias("_p"),
        F.sum("_tot").alias("_n"), F.sum(F.col("_pos") * (F.col("_upto") - F.col("_upto_pos") - (F.col("_tot") - F.col("_pos")) / 2)).alias("_above"))
    neg = F.col("_n") - F.col("_p")
    areas = sums.select(*by, ratio(F.col("_hits"), F.col("_p"), None).alias("pr_auc"),
                        (1 - ratio(F.col("_above"), F.col("_p") * neg, None)).alias("roc_auc"))
    wide = wide.join(areas, by, "inner").withColumn("replicate", F.lit(replicate))
    return long_metrics(wide, [*by, "replicate"], [*THRESHOLD_METRICS, *RANK_METRICS])


def with_point_estimates(intervals: DataFrame, metrics: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Intervals beside the value of the undisturbed sample (one row per ``by``)."""
    points = long_metrics(metrics, by, names).withColumnRenamed("value", "estimate")
    return intervals.join(points, [*by, "metric"], "inner")


def long_metrics(wide: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    return wide.unpivot(keys, list(names), "metric", "value")


INTERVAL = (.025, .975)


def percentile_ci(replicates: DataFrame, by: list[str], quantiles: tuple[float, float] = INTERVAL) -> DataFrame:
    q = F.percentile("value", F.array(*[F.lit(x) for x in quantiles]))
    return (replicates.groupBy(*by, "metric").agg(q.alias("q"), F.count("value").alias("replicates"))
            .select(*by, "metric", "replicates", F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper")))


def difference_ci(a: DataFrame, c: DataFrame, by: list[str],
                  quantiles: tuple[float, float] = INTERVAL) -> DataFrame:
    """Interval of the unpaired difference a - c, subtracted by replicate number."""
    keys = [*by, "replicate", "metric"]
    both = a.select(*keys, F.col("value").alias("va")).join(c.select(*keys, F.col("value").alias("vc")), keys, "inner")
    return percentile_ci(both.select(*keys, (F.col("va") - F.col("vc")).alias("value")), by, quantiles)


def assert_complete(replicates: DataFrame, by: list[str], reps: int) -> DataFrame:
    """The replicates themselves; missing or undefined ones raise an error."""
    counts = replicates.groupBy(*by, "metric").agg(
        F.countDistinct("replicate").alias("r"), F.count_if(F.col("value").isNull()).alias("bad"))
    worst = counts.agg(F.count_if((F.col("r") != reps) | (F.col("bad") > 0)).alias("w")).scalar()
    return replicates.where(F.when(worst == 0, True).otherwise(
        F.raise_error(F.lit("degenerate or missing replicate")).cast("boolean")))


def completeness(replicates: DataFrame, by: list[str], reps: int) -> DataFrame:
    return replicates.groupBy(*by, "metric").agg(
        F.countDistinct("replicate").alias("replicates"),
        F.count_if(F.col("value").isNull()).alias("undefined"),
        (F.countDistinct("replicate") == reps).alias("complete"))


def replay_check(saved: DataFrame, replayed: DataFrame, by: list[str], tol: float = 1e-12) -> DataFrame:
    """Largest difference between saved replicates and a replay of some of them."""
    keys = [*by, "replicate", "metric"]
    both = replayed.select(*keys, F.col("value").alias("again")).join(saved, keys, "left")
    diff = F.abs(F.col("value") - F.col("again"))
    return both.agg(F.count(F.lit(1)).alias("compared"), F.max(diff).alias("max_abs_diff"),
                    F.coalesce(F.bool_and(diff <= tol), F.lit(False)).alias("within"))

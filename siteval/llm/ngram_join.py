"""Exact Jaccard join of documents on word shingles, in the Jaccard metric space.

Texts with equal shingle sets become one point first.  Two points within
distance r = 1 - threshold must share several of the first shingles of each
under any one order of all shingles, so points that share such a shingle form a
cell, no other pair is looked at, and points that share too few with all others
together are done.  The order puts shingles of crowded hash buckets last
(``hot``), which keeps common passages out of the cells.

* Pivots and Voronoi regions: each cell's least point is its pivot; points
  join the region of the nearest pivot within r, measured exactly.  Regions
  linked so far share a label, and cells with one label are done.
* Recursion: cells with several labels choose another pivot and join again, as
  long as that closes cells at a good rate.
* Windows: then regions of different labels that meet in a cell are compared
  tile by tile under bounds of set size and parity, and measured pivot to pivot
  where these let them through.  Pivots within r join the labels of their regions.
  By the triangle inequality points x, y of regions p, q can only be within r if
  d(p, q) <= d(x, p) + r + d(y, q); the boundary points for which this can hold,
  for any region q of another label, are compared in the same tiles, each as a
  region of its own, and what the bounds let through is measured exactly.
  Nothing is replicated per point and region.  Links inside a label change no component.

Distances are counted from whole sets.  Before sets travel, parity bitmaps
(a lower bound of the symmetric difference) drop most distant pairs.

Null or empty texts and texts of white space have no shingles and link with
nothing; texts with fewer words than ``width`` have their whole sequence as one
shingle.  Null or repeated ids are kept row by row; the class of an id is the
least id among its texts' classes, null if no member has an id.  An empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from siteval.llm.common import discard, packed, slices, text_of, written
from siteval.llm.components import components
from siteval.operators.joins import join_null_safe

WIDTH = 5
PERCENT = 75
BUCKET_BITS = 20
BLOCK = 1 << 12
HOT_FLOOR, HOT_TIMES = 32, 8
SEEN_LIMIT = 500_000
ROUNDS = 2
SHRINK = 0.9  # of the open rows; above, another round is not worth its jobs
TILE = 1024  # regions of a cell that a task compares with as many others
SHARE = 16

# ---------------------------------------------------------------- sets of one text

_MIX = np.random.default_rng(20_240_607).integers(1 << 62, (1 << 63) - 1, size=256, dtype=np.int64).astype(np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, *range(9, 14)]] = True


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    blank = _BLANK[raw]
    keep = ~blank
    if not keep.any():
        return np.zeros(0, np.int64)
    letters = _FOLD[raw[keep]]
    begins = keep.copy()
    begins[1:] &= blank[:-1]
    starts = np.flatnonzero(begins[keep])
    sizes = np.diff(np.append(starts, len(letters)))
    place = np.arange(len(letters)) - np.repeat(starts, sizes)
    powers = np.cumprod(np.full(int(sizes.max()), _ODD, dtype=np.uint64), dtype=np.uint64)
    words = _scramble(np.add.reduceat(_MIX[letters] * powers[place], starts) + sizes.astype(np.uint64))
    k = min(width, len(words))
    grams = np.zeros(len(words) - k + 1, dtype=np.uint64)
    for j in range(k):
        grams = grams * _ODD + words[j:len(words) - k + 1 + j]
    return np.unique(_scramble(grams + np.uint64(k)).view(np.int64))


def signature(shingles: np.ndarray) -> tuple[int, int]:
    h = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return tuple(np.frombuffer(h, dtype=np.int64).tolist())


def bucket(values: np.ndarray, bits: int = BUCKET_BITS) -> np.ndarray:
    return (values.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def must_share(n):
    """How many of their first shingles two points within r share at least, the
    smaller having ``n`` shingles; one more for every ``SHARE`` keeps points out
    that meet others by chance."""
    return 1 + n // SHARE


def first_shingles(shingles: np.ndarray, hot: np.ndarray | None, percent: int = PERCENT) -> np.ndarray:
    """A neighbour has at least ``percent`` of the shingles.  So at most the
    rest are missing, and the first ones it has, ``must_share`` of them, lie
    among the rest and as many more."""
    n = len(shingles)
    take = n - -(-percent * n // 100) + must_share(n)
    if hot is not None:
        last = hot[bucket(shingles)]
        shingles = np.concatenate([shingles[~last], shingles[last]])
    return shingles[:take]


def parity_bits(shingles: np.ndarray) -> bytes:
    """Parity of the number of shingles in each of 2n or more cells."""
    bits = 64
    while bits < 2 * len(shingles):
        bits *= 2
    at = (_scramble(shingles.view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


# ---------------------------------------------------------------- tables

def _add_blocks(counts: np.ndarray):
    for at in range(0, len(counts), BLOCK):
        part = counts[at:at + BLOCK]
        if part.any():
            yield at // BLOCK, part.astype("<i8").tobytes()


def _summed(blocks: DataFrame, size: int) -> np.ndarray:
    """Sum of count blocks (_block, _counts): ``size`` numbers, whatever the input."""
    def total(pdf):
        counts = sum(np.frombuffer(x, "<i8") for x in pdf["_counts"])
        return pd.DataFrame({"_block": [pdf["_block"].iloc[0]], "_counts": [counts.astype("<i8").tobytes()]})

    schema = "_block int, _counts binary"
    halved = blocks.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(64)))
    halved = halved.groupBy("_block", "_part").applyInPandas(lambda pdf: total(pdf), schema)
    out = np.zeros(size, dtype=np.int64)
    for r in halved.groupBy("_block").applyInPandas(total, schema).collect():
        part = np.frombuffer(r["_counts"], "<i8")
        out[r["_block"] * BLOCK:r["_block"] * BLOCK + len(part)] = part
    return out


def _crowded(counts: np.ndarray) -> np.ndarray:
    return counts > HOT_FLOOR + HOT_TIMES * counts.sum() / len(counts)


def _texts(docs: DataFrame, id_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("_id"), text_of().alias("_text"))


def census(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, np.ndarray]:
    """Members (_id, n_shingles, sig, sig2) and the crowded buckets of first shingles."""
    size = 1 << BUCKET_BITS
    kind = docs.schema["_id"].dataType
    fields = StructType.fromDDL("n_shingles long, sig long, sig2 long, _block int, _counts binary")
    names = ["_id", *fields.names]

    def look(batches):
        counts, seen, ids = np.zeros(size, dtype=np.int64), set(), None
        for b in (s for batch in batches for s in slices(batch, "_text")):
            ids = b.column("_id")
            rows = []
            for text in b.column("_text").to_pylist():
                s = shingle_set(text, width)
                sig = signature(s)
                rows.append((len(s), *sig))
                if sig not in seen:
                    if len(seen) < SEEN_LIMIT:
                        seen.add(sig)
                    np.add.at(counts, bucket(first_shingles(s, None, percent)), 1)
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [ids, *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3)), pa.nulls(n, pa.int32()),
                 pa.nulls(n, pa.binary())], names=names)
        if ids is not None:
            blocks = list(_add_blocks(counts))
            zero = pa.array(np.zeros(len(blocks), np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(blocks), ids.type), zero, zero, zero, pa.array([x for x, _ in blocks], pa.int32()),
                 pa.array([c for _, c in blocks], pa.binary())], names=names)

    rows = written(docs.mapInArrow(look, StructType([StructField("_id", kind), *fields.fields])), "shingle-census")
    members = rows.where("_block is null").select("_id", "n_shingles", "sig", "sig2")
    return members, _crowded(_summed(rows.where("_block is not null").select("_block", "_counts"), size))


def cells(docs: DataFrame, hot: np.ndarray, width: int, percent: int) -> DataFrame:
    """shingle, sig of every cell with two points or more.

    Cells are runs of a sorted stream; no cell is ever held as a whole.
    """
    def points(batches):
        seen: set[int] = set()
        for b in (s for batch in batches for s in slices(batch, "_text")):
            firsts, sigs = [], []
            for text in b.column("_text").to_pylist():
                s = shingle_set(text, width)
                sig = signature(s)[0]
                if len(s) == 0 or sig in seen:
                    continue
                if len(seen) < SEEN_LIMIT:
                    seen.add(sig)
                firsts.append(first_shingles(s, hot, percent))
                sigs.append(sig)
            if sigs:
                yield pa.RecordBatch.from_pydict({"shingle": np.concatenate(firsts), "sig": np.repeat(
                    np.array(sigs, np.int64), [len(f) for f in firsts])})

    def runs(batches):
        key = last = None  # the open run; held: its only point so far is not yet given out
        held = False
        for b in batches:
            k, s = b["shingle"].to_numpy(), b["sig"].to_numpy()
            fresh = np.ones(len(k), dtype=bool)
            fresh[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
            if key is not None and len(k):
                fresh[0] = k[0] != key or s[0] != last
            k, s = k[fresh], s[fresh]
            if not len(k):
                continue
            with_next = np.append(k[1:] == k[:-1], False)
            with_last = np.append(False, k[1:] == k[:-1])
            out = with_next | with_last
            goes_on = key is not None and k[0] == key
            first = ([key], [last]) if goes_on and held else ([], [])
            out[0] |= goes_on
            key, last, held = k[-1], s[-1], not out[-1]
            if out.any():
                yield pd.DataFrame({"shingle": np.concatenate([np.array(first[0], np.int64), k[out]]),
                                    "sig": np.concatenate([np.array(first[1], np.int64), s[out]])})

    stream = docs.mapInArrow(points, "shingle long, sig long")
    stream = stream.repartition("shingle").sortWithinPartitions("shingle", "sig")
    return stream.mapInPandas(runs, "shingle long, sig long")


def with_pivots(rows: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """shingle, sig, pivot, for points that share enough first shingles and cells
    in which two or more such points are left."""
    n = F.col("n_shingles")
    smaller = F.ceil(n * percent / 100)  # of a neighbour at least
    counts = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("shared"))
    enough = counts.join(points, "sig").where(F.col("shared") >= 1 + F.floor(smaller / SHARE)).select("sig")
    rows = written(rows.join(enough, "sig", "left_semi"), "cells")
    pivots = rows.groupBy("shingle").agg(F.min("sig").alias("pivot"), F.max("sig").alias("_last"))
    live = written(rows.join(pivots.where("pivot <> _last").select("shingle", "pivot"), "shingle"), "live-cells")
    discard(rows)
    return live


def point_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """sig, n, bits, shingles of the points in ``wanted`` (and a few more).

    A bit per hash bucket tells which texts to keep; its size is fixed, and a
    full table of bits would keep more texts but lose none.
    """
    size = 1 << BUCKET_BITS

    def mark(batches):
        counts = np.zeros(size, dtype=np.int64)
        for b in batches:
            counts[bucket(b["sig"].to_numpy())] = 1
        blocks = list(_add_blocks(counts))
        yield pd.DataFrame({"_block": [x for x, _ in blocks], "_counts": [c for _, c in blocks]})

    blocks = wanted.select("sig").distinct().mapInPandas(mark, "_block int, _counts binary")
    keep = _summed(blocks, size) > 0

    def build(batches):
        seen: set[int] = set()
        for b in (s for batch in batches for s in slices(batch, "_text")):
            rows = []
            for text in b.column("_text").to_pylist():
                s = shingle_set(text, width)
                sig = signature(s)[0]
                if not len(s) or sig in seen or not keep[bucket(np.array([sig], np.int64))[0]]:
                    continue
                if len(seen) < SEEN_LIMIT:
                    seen.add(sig)
                rows.append((sig, len(s), parity_bits(s), s))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 4, kinds)], names=["sig", "n", "bits", "shingles"])

    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
    found = docs.mapInArrow(build, "sig long, n long, bits binary, shingles array<long>")
    return found.dropDuplicates(["sig"])


def measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Exact distance of pairs (a, b, reach) of points that is at most ``reach``."""
    light = sets.select("sig", "n", "bits")
    both = pairs.join(light.toDF("a", "na", "ba"), "a").join(light.toDF("b", "nb", "bb"), "b")
    both = both.where(F.least("na", "nb") >= (1 - F.col("reach") - 1e-9) * F.greatest("na", "nb"))

    def near(batches):
        for b in batches:
            least = np.array([least_difference(x, y) for x, y in zip(b["ba"], b["bb"])], dtype=np.float64)
            total = b["na"].to_numpy() + b["nb"].to_numpy()
            keep = 2 * least <= (b["reach"].to_numpy() + 1e-9) * (total + least)
            yield b.loc[keep, ["a", "b", "reach"]]

    return distances(both.mapInPandas(near, "a long, b long, reach double"), sets)


def distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``measured`` for pairs that the bounds on sizes and parities already let through."""
    full = sets.select("sig", "n", "shingles")
    close = pairs.join(full.toDF("a", "na", "sa"), "a").join(full.toDF("b", "nb", "sb"), "b")
    close = close.withColumn("common", F.size(F.array_intersect("sa", "sb")).cast("long"))
    close = close.select("a", "b", "reach", "common", (F.col("na") + F.col("nb") - F.col("common")).alias("total"))
    distance = 1 - F.col("common") / F.col("total")
    return close.withColumn("distance", distance).where(distance <= F.col("reach") + 1e-9)


def close_pairs(tile: dict[str, np.ndarray], r: float, across: bool) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of differently labelled regions of a tile (region, label, radius,
    part, n, bits) whose pivots may be within reach: both radii and ``r``.

    Rows go up by set size, so each meets only those up to the size that its
    reach allows, and longer bitmaps are folded to the width of its own.
    ``across``: only pairs of different parts.
    """
    if (tile["label"] == tile["label"][0]).all():
        return []
    up = np.argsort(tile["n"], kind="stable")
    region, label, part, n, radius, bits = (tile[c][up] for c in ("region", "label", "part", "n", "radius", "bits"))
    words = [np.frombuffer(x, np.uint64) for x in bits]
    found, width, at = [], 0, 0
    widest = radius.max()
    for x in range(len(n) - 1):
        if len(words[x]) != width:
            width, at = len(words[x]), x
            folded = np.stack([np.bitwise_xor.reduce(w.reshape(-1, width), axis=0) for w in words[x:]])
        least = 1 - radius[x] - widest - r - 1e-9
        end = len(n) if least <= 0 else int(np.searchsorted(n, n[x] / least, side="right"))
        y = np.arange(x + 1, end)
        y = y[label[y] != label[x]]
        if across:
            y = y[part[y] != part[x]]
        reach = np.minimum(radius[y] + radius[x] + r, 1.0)
        near = n[x] >= (1 - reach - 1e-9) * n[y]
        y, reach = y[near], reach[near]
        if not len(y):
            continue
        differ = np.bitwise_count(folded[y - at] ^ folded[x - at]).sum(axis=1, dtype=np.int64)
        near = 2 * differ <= (reach + 1e-9) * (n[x] + n[y] + differ)
        if near.any():
            other = region[y[near]]
            found.append((np.minimum(other, region[x]), np.maximum(other, region[x]), reach[near]))
    return found


def meetings(met: DataFrame, radius: DataFrame, sets: DataFrame, r: float) -> DataFrame:
    """a, b, reach of regions of different labels that meet in a cell and may reach each other.

    Many cells hold the same regions; one of them is enough, told apart by
    count and two sums of hashes.  A cell is split into parts of about ``TILE`` regions and every pair of
    parts is one tile, compared in a task, which only gives out pairs within
    the bounds.
    """
    regions = radius.join(sets.select(F.col("sig").alias("region"), "n", "bits"), "region")
    what = F.xxhash64("region", "label")
    sizes = met.groupBy("shingle").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(what).alias("x"),
                                       F.sum(what.cast("decimal(38,0)")).alias("sum"))
    sizes = sizes.groupBy("size", "x", "sum").agg(F.min("shingle").alias("shingle"))
    sizes = sizes.select("shingle", F.ceil(F.col("size") / TILE).alias("parts"))
    rows = met.join(sizes, "shingle").withColumn("part", F.pmod(F.xxhash64("region"), F.col("parts")))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("_with"))
    rows = rows.select("shingle", "region", "label", "part", F.least("part", "_with").alias("i"), F.greatest("part", "_with").alias("j"))
    rows = rows.join(regions, "region").repartition("shingle", "i", "j").sortWithinPartitions("shingle", "i", "j")

    def tiles(batches):
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            key = b[["shingle", "i", "j"]].to_numpy()
            starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
            yield from given(b[:starts[-1]], starts)
            rest = b[starts[-1]:]
        if rest is not None:
            yield from given(rest, [0, len(rest)])

    def given(b, starts):
        columns, found = {c: b[c].to_numpy() for c in b.columns}, []
        for s, e in zip(starts[:-1], starts[1:]):
            if e - s > 1:
                tile = {c: x[s:e] for c, x in columns.items()}
                found += close_pairs(tile, r, tile["i"][0] != tile["j"][0])
        if found:
            a, b, reach = (np.concatenate(c) for c in zip(*found))
            yield pd.DataFrame({"a": a, "b": b, "reach": reach}).drop_duplicates()

    return rows.mapInPandas(tiles, "a long, b long, reach double").distinct()


def point_components(live: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """sig, component (a sig) of the points that link with another."""
    r = 1 - percent / 100
    exact = F.col("common") * 100 >= F.col("total") * percent

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return written(measured(pairs.withColumn("reach", F.lit(r)), sets).where(exact).select("a", "b", "distance"), "jaccard-links")

    links = linked(live.where("sig <> pivot").select(F.col("sig").alias("a"), F.col("pivot").alias("b")))
    labels = components(links)
    cell, before = written(_open_cells(live, labels), "open-cells"), None
    discard(live)
    for turn in range(ROUNDS):
        rows = cell.count()
        if not rows or before is not None and rows > SHRINK * before:
            break
        before = rows
        pivots = cell.groupBy("shingle").agg(F.min_by(F.struct("sig", "label"), F.xxhash64("sig", F.lit(turn))).alias("p"))
        tried = cell.join(pivots, "shingle").where("label <> p.label").select(F.col("sig").alias("a"), F.col("p.sig").alias("b"))
        found = linked(tried)
        links = links.unionByName(found)
        labels = components(found.select("a", "b").unionByName(_stars(labels)))
        spent, cell = cell, written(_open_cells(cell, labels), "open-cells")
        discard(spent)
    if cell.isEmpty():
        return labels.select(F.col("node").alias("sig"), "component")
    more = _window_links(_meeting_cells(cell, sets, percent), links, sets, r, exact)
    return components(_stars(labels).unionByName(more)).select(F.col("node").alias("sig"), "component")


def _stars(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("node").alias("a"), F.col("component").alias("b"))


def _open_cells(cell: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of cells that still hold several labels, with the label."""
    named = cell.select("shingle", "sig").join(labels.select(F.col("node").alias("sig"), "component"), "sig", "left")
    named = named.select("shingle", "sig", F.coalesce("component", "sig").alias("label"))
    mixed = named.groupBy("shingle").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y")
    return named.join(mixed.select("shingle"), "shingle", "left_semi")


def _meeting_cells(cell: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows of open cells in which points of different labels have to meet.

    Neighbours of different labels share ``must_share`` cells, all of them open.
    In one order of cells, crowded ones last, the first cell they share is
    followed by the others in both lists, so each point leaves out its last
    ``must_share - 1`` cells, and one with no more than these has no neighbour.
    """
    smaller = F.ceil(F.col("n") * percent / 100)
    sizes = cell.groupBy("shingle").agg(F.count(F.lit(1)).alias("size"))
    rows = cell.join(sizes, "shingle").join(sets.select("sig", "n"), "sig")
    last = Window.partitionBy("sig").orderBy(F.desc("size"), F.desc("shingle"))
    rows = rows.withColumn("_at", F.row_number().over(last)).where(F.col("_at") > F.floor(smaller / SHARE))
    rows = written(rows.select("shingle", "sig", "label"), "meeting-cells")
    discard(cell)
    mixed = rows.groupBy("shingle").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y")
    return rows.join(mixed.select("shingle"), "shingle", "left_semi")


def _relabelled(regions: DataFrame, links: DataFrame) -> DataFrame:
    """region, label, radius, with one label for the regions that pivot links (a, b) join.

    The regions of one large group of near copies are mostly linked pivot to
    pivot; windows between them would be as many as their points times regions.
    """
    label = regions.select("region", "label")
    ends = links.join(label.toDF("a", "x"), "a").join(label.toDF("b", "y"), "b")
    merged = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")))
    named = regions.join(merged.select(F.col("node").alias("label"), "component"), "label", "left")
    return written(named.select("region", F.coalesce("component", "label").alias("label"), "radius"), "relabelled-regions")


def _window_links(cell: DataFrame, links: DataFrame, sets: DataFrame, r: float, exact) -> DataFrame:
    """Links between points of differently labelled regions."""
    ends = links.select(F.col("a").alias("sig"), F.col("b").alias("region"), "distance").unionByName(
        links.select(F.col("b").alias("sig"), F.col("a").alias("region"), "distance"))
    hubs = ends.groupBy("region").agg(F.count(F.lit(1)).alias("size"))
    ranked = ends.join(hubs, "region").select("sig", F.struct((-F.col("size")).alias("o"), "distance", "region").alias("c"))
    nearest = ranked.groupBy("sig").agg(F.min("c").alias("c")).select("sig", "c.region", "c.distance")
    # a hub is its own region: the largest pivots take in their neighbours
    placed = cell.join(nearest, "sig", "left").join(
        hubs.withColumnRenamed("region", "sig").withColumnRenamed("size", "own"), "sig", "left").join(
        hubs.withColumnRenamed("size", "its"), "region", "left")
    alone = F.col("region").isNull() | (F.col("own") > F.col("its")) | ((F.col("own") == F.col("its")) & (F.col("sig") < F.col("region")))
    placed = placed.select("shingle", "sig", "label", F.when(alone, F.col("sig")).otherwise(F.col("region")).alias("region"),
                           F.when(alone, 0.0).otherwise(F.col("distance")).alias("away"))
    placed = written(placed, "regions")
    radius = placed.groupBy("region").agg(F.max("away").alias("radius"))
    met = placed.select("shingle", "region", "label").distinct()
    near = written(distances(meetings(met, radius, sets, r), sets), "near-regions")
    direct = near.where(exact).select("a", "b")
    known = _relabelled(placed.groupBy("region", "label").agg(F.max("away").alias("radius")), direct)
    wide = near.where(F.col("reach") > r + 1e-9).select("a", "b", F.col("distance").alias("d"))
    wide = wide.join(known.toDF("a", "la", "ra"), "a").join(known.toDF("b", "lb", "rb"), "b").where("la <> lb")
    # how far from its pivot a point of a region is at least, if it is within r of another region's
    edges = wide.select(F.col("a").alias("region"), F.col("la").alias("label"), (F.col("d") - F.col("rb") - r).alias("least")).unionByName(
        wide.select(F.col("b").alias("region"), F.col("lb").alias("label"), (F.col("d") - F.col("ra") - r).alias("least")))
    edges = edges.groupBy("region", "label").agg(F.min("least").alias("least"))
    spots = placed.drop("label").join(edges, "region").where(F.col("away") >= F.col("least") - 1e-9)
    # these boundary points meet in their cells, each as a region of its own
    spots = written(spots.select("shingle", F.col("sig").alias("region"), "label"), "boundary-points")
    mixed = spots.groupBy("shingle").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y")
    spots = spots.join(mixed.select("shingle"), "shingle", "left_semi")
    alone = spots.select("region").distinct().withColumn("radius", F.lit(0.0))
    found = distances(meetings(spots, alone, sets, r), sets).where(exact).select("a", "b")
    return direct.unionByName(found)


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc id, n_shingles and component_id of every document."""
    texts = _texts(docs, id_col)
    members, hot = census(texts, width, percent)
    whole = F.assert_true(F.min("sig2") == F.max("sig2"), "two shingle sets have one signature")
    points = members.where("n_shingles > 0").groupBy("sig").agg(
        F.min("_id").alias("least"), F.first("n_shingles").alias("n_shingles"), whole.alias("_ok"))
    points = written(points.where("_ok is null").drop("_ok"), "points")
    rows = written(cells(texts, hot, width, percent), "shared-shingles")
    live = with_pivots(rows, points, percent)
    discard(rows)
    sets = written(point_sets(texts, live, width), "point-sets")
    parts = point_components(live, sets, percent)
    named = points.join(parts, "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    named = written(named, "named-points")
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = named.join(ids, "component").select("sig", "component_id")
    full = members.where("n_shingles > 0").join(classes, "sig", "left")
    empty = members.where("n_shingles = 0").withColumn("component_id", F.col("_id"))
    out = full.select("_id", "n_shingles", "component_id").unionByName(empty.select("_id", "n_shingles", "component_id"))
    return out.withColumnRenamed("_id", id_col)


def one_per_class(docs: DataFrame, id_col: str = "doc_id", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows, with all columns, of the least id of each class; rows without an id stay."""
    classes = jaccard_classes(docs, id_col, width, percent)
    kept = classes.where(F.col(id_col).isNull() | (F.col(id_col) == F.col("component_id")))
    kept = kept.select(F.col(id_col).alias("_id")).distinct()
    return join_null_safe(packed(docs, _id=F.col(id_col)), kept, "_id").select("_row.*")

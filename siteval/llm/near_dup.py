"""Embedding near-dedup by PCA-ordered tiled comparison.

Equal vectors of one label become one point with a count.  Unit vectors are
turned to the principal axes of all points, so leading dimensions carry most of
a product.  Points are ordered by grid cells of the leading axes and cut into
tiles; two tiles meet only if their cells touch, because points within the
threshold differ by at most sqrt(2 - 2 t) on every axis.  A pair of tiles is
compared a few dimensions at a time: the products so far plus the product of
the suffix norms (Cauchy-Schwarz) bound the cosine, and pairs that cannot reach
the threshold are dropped.  The rest is decided by the cosine of the vectors as
given, in double precision.

A task gives the number of links of each point and a spanning forest of the
links of its two tiles, never the pairs themselves.

Vectors that are null, empty or zero, or hold null or non-finite numbers, and
vectors with a null label, link with nothing and are their own component.
Only vectors of equal length are compared.  Rows of one id count as vectors of
their own for links; a null id is kept.  An empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteval.llm.common import written
from siteval.llm.components import components

THRESHOLD = 0.98
TILE_ROWS = 512
GRID_AXES = 3
STEP = 8  # dimensions added at a time
TURNED_LENGTHS = 8  # vector lengths, by frequency, that get axes of their own
SLACK = 1e-9


def _usable(v: str) -> str:
    return (f"{v} is not null and size({v}) > 0 and forall({v}, x -> x is not null and not isnan(x) "
            f"and abs(x) < double('infinity')) and exists({v}, x -> x <> 0)")


def unit_rows(vectors) -> np.ndarray:
    """Rows of length 1 in double precision; scaled first, so squares neither overflow nor vanish."""
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_axes(points: DataFrame) -> dict[int, np.ndarray]:
    """Axes by vector length, from the second moments of all points.

    Only d x d sums reach the driver, for at most ``TURNED_LENGTHS`` lengths;
    other lengths keep their own axes, which changes no result.
    """
    lengths = points.groupBy("d").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(TURNED_LENGTHS)
    wanted = [r["d"] for r in lengths.collect()]
    if not wanted:
        return {}

    def moments(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for d, rows in b.groupby("d"):
                x = unit_rows(rows["vector"])
                sums[d] = sums.get(d, 0) + x.T @ x
        for d, s in sums.items():
            yield pd.DataFrame({"d": d, "i": np.repeat(np.arange(d), d), "j": np.tile(np.arange(d), d), "s": s.ravel()})

    rows = points.where(F.col("d").isin(wanted)).select("d", "vector").mapInPandas(moments, "d int, i int, j int, s double")
    total = rows.groupBy("d", "i", "j").agg(F.sum("s").alias("s")).toPandas()
    axes = {}
    for d, part in total.groupby("d"):
        m = np.zeros((d, d))
        m[part["i"], part["j"]] = part["s"]
        axes[int(d)] = np.linalg.eigh((m + m.T) / 2)[1][:, ::-1]
    return axes


def compare_tiles(a: np.ndarray, b: np.ndarray, threshold: float, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of unit rows (on principal axes) whose cosine may reach the threshold."""
    d = a.shape[1]
    left, right = (np.sqrt(np.maximum(0, np.cumsum((m * m)[:, ::-1], axis=1)[:, ::-1])) for m in (a, b))
    done = min(step, d)
    part = a[:, :done] @ b[:, :done].T
    if done < d:
        part += np.outer(left[:, done], right[:, done])
    i, j = np.nonzero(part >= threshold - SLACK)
    so_far = part[i, j] - (left[i, done] * right[j, done] if done < d else 0)
    while done < d and len(i):
        upto = min(done + step, d)
        so_far = so_far + np.einsum("ij,ij->i", a[i, done:upto], b[j, done:upto])
        bound = so_far + (left[i, upto] * right[j, upto] if upto < d else 0)
        keep = bound >= threshold - SLACK
        i, j, so_far, done = i[keep], j[keep], so_far[keep], upto
    return i, j


def exact_links(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of the given vectors have a cosine of at least the threshold."""
    keep = np.zeros(len(i), dtype=bool)
    for at in range(0, len(i), 65_536):
        p, q = x[i[at:at + 65_536]], y[j[at:at + 65_536]]
        p = p / np.abs(p).max(axis=1, keepdims=True)
        q = q / np.abs(q).max(axis=1, keepdims=True)
        dot = np.einsum("ij,ij->i", p, q)
        norm = np.sqrt(np.einsum("ij,ij->i", p, p)) * np.sqrt(np.einsum("ij,ij->i", q, q))
        keep[at:at + 65_536] = dot / norm >= threshold
    return keep


def forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """At most n - 1 of the links, connecting the same nodes."""
    parent = list(range(n))

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    kept = []
    for p, q in zip(i.tolist(), j.tolist()):
        a, b = root(p), root(q)
        if a != b:
            parent[max(a, b)] = min(a, b)
            kept.append((p, q))
            if len(kept) == n - 1:
                break
    return kept


def tiles(points: DataFrame, axes: dict[int, np.ndarray], width: float, rows: int, grid: int) -> DataFrame:
    """label, d, cell and the packed points of tiles in axis order."""
    def place(batches):
        for b in batches:
            out = np.zeros((len(b), grid), dtype=np.int64)
            for d, part in b.groupby("d"):
                x = unit_rows(part["vector"])
                x = x @ axes[d] if d in axes else x
                k = min(grid, d)
                out[b.index.get_indexer(part.index), :k] = np.floor(x[:, :k] / width)
            yield b.assign(cell=list(out))

    placed = points.mapInPandas(place, "label int, d int, vector array<double>, id long, n long, cell array<long>")
    spread = max(2, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["label", "d", "cell", "id"]
    placed = placed.repartitionByRange(spread, *order).sortWithinPartitions(*order)

    def pack(batches):
        open_key, held = None, []

        def tile():
            return pd.DataFrame({"label": [open_key[0]], "d": [open_key[1]], "cell": [list(open_key[2])],
                                 "first": [held[0][0]], "ids": [[h[0] for h in held]], "counts": [[h[1] for h in held]],
                                 "vectors": [np.stack([h[2] for h in held]).astype("<f8").tobytes()]})

        for b in batches:
            for label, d, v, i, n, c in zip(b["label"], b["d"], b["vector"], b["id"], b["n"], b["cell"]):
                key = (label, d, tuple(c))
                if held and (key != open_key or len(held) == rows):
                    yield tile()
                    held = []
                open_key = key
                held.append((i, n, np.asarray(v, dtype=np.float64)))
        if held:
            yield tile()

    return placed.mapInPandas(pack, "label int, d int, cell array<long>, first long, ids array<long>, "
                                    "counts array<long>, vectors binary")


def tile_pairs(tiled: DataFrame, grid: int) -> DataFrame:
    """Pairs of tiles whose cells touch, each pair once, with both contents."""
    steps = [()]
    for _ in range(grid):
        steps = [(*s, k) for s in steps for k in (-1, 0, 1)]
    steps = [s for s in steps if s >= (0,) * grid]  # the other half is the same pairs seen from the other side
    moves = F.array(*[F.array(*[F.lit(k).cast("long") for k in s]) for s in steps])
    keys = tiled.select("label", "d", "cell", "first")
    left = keys.withColumn("move", F.explode(moves)).select(
        "label", "d", F.zip_with("cell", "move", lambda c, m: c + m).alias("cell"), F.col("first").alias("a"), "move")
    met = left.join(keys.withColumnRenamed("first", "b"), ["label", "d", "cell"])
    own = F.forall("move", lambda m: m == 0)
    met = met.where(~own | (F.col("a") <= F.col("b"))).select("a", "b")
    body = tiled.select("first", "d", "ids", "counts", "vectors")
    return met.join(body.toDF("a", "d", "ia", "ca", "va"), "a").join(
        body.drop("d").toDF("b", "ib", "cb", "vb"), "b")


def tile_links(pairs: DataFrame, axes: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """(a, n): links of point a found in a pair of tiles; (a, b): a forest of the links."""
    def compare(batches):
        for batch in batches:
            for r in batch.itertuples():
                same = r.a == r.b
                x = np.frombuffer(r.va, "<f8").reshape(-1, r.d)
                y = x if same else np.frombuffer(r.vb, "<f8").reshape(-1, r.d)
                turn = axes.get(r.d)
                p, q = (unit_rows(m) if turn is None else unit_rows(m) @ turn for m in (x, y))
                i, j = compare_tiles(p, q, threshold)
                if same:
                    i, j = i[i < j], j[i < j]
                keep = exact_links(x, y, i, j, threshold)
                i, j = i[keep], j[keep]
                if not len(i):
                    continue
                ids, other = np.asarray(r.ia), np.asarray(r.ib)
                ni = np.bincount(i, weights=np.asarray(r.cb)[j], minlength=len(ids)).astype(np.int64)
                nj = np.bincount(j, weights=np.asarray(r.ca)[i], minlength=len(other)).astype(np.int64)
                shift = 0 if same else len(ids)
                tree = forest(len(ids) + (0 if same else len(other)), i, j + shift)
                every = ids if same else np.concatenate([ids, other])
                counted = [pd.DataFrame({"a": k[n > 0], "b": pd.array([None] * int((n > 0).sum()), "Int64"),
                                         "n": pd.array(n[n > 0], "Int64")}) for k, n in ((ids, ni), (other, nj))]
                edges = np.array(tree, dtype=np.int64).reshape(-1, 2)
                yield pd.concat([*counted, pd.DataFrame({"a": every[edges[:, 0]], "b": pd.array(every[edges[:, 1]], "Int64"),
                                                         "n": pd.array([None] * len(edges), "Int64")})])

    return pairs.mapInPandas(compare, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id",
                    vector_col: str = "embedding", label_col: str = "label", tile_rows: int = TILE_ROWS,
                    grid: int = GRID_AXES) -> DataFrame:
    """id, n_links, component_id and kept of every vector."""
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("label"),
                          F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.withColumn("_ok", F.expr(f"label is not null and {_usable('vector')}"))
    # equal vectors meet by a digest of their numbers; -0.0 is 0.0
    same = F.sha2(F.array_join(F.transform("vector", lambda v: (v + F.lit(0.0)).cast("string")), ","), 256)
    rows = rows.withColumn("_same", F.when(F.col("_ok"), same)).withColumn("_ok", F.col("_same").isNotNull())
    points = rows.where("_ok").groupBy("label", F.size("vector").alias("d"), "_same").agg(
        F.first("vector").alias("vector"), F.min("_id").alias("least"), F.count(F.lit(1)).alias("n"))
    point_id = F.xxhash64("label", "d", "_same")
    points = written(points.withColumn("id", point_id), "vector-points")
    if not points.groupBy("id").count().where("count > 1").isEmpty():
        raise ValueError("two vectors have one 64-bit digest; add a seed to point_id")
    axes = principal_axes(points)
    width = float(np.sqrt(2 - 2 * threshold)) + 1e-6
    tiled = written(tiles(points.select("label", "d", "vector", "id", "n"), axes, width, tile_rows, grid), "vector-tiles")
    found = written(tile_links(tile_pairs(tiled, grid), axes, threshold), "vector-links")
    counts = found.where("n is not null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"))
    parts = components(found.where("b is not null").select("a", "b"))
    named = points.drop("vector").join(counts, "id", "left").join(
        parts.select(F.col("node").alias("id"), "component"), "id", "left")
    named = written(named.withColumn("component", F.coalesce("component", "id")), "named-vectors")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select(
        "label", "_same", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    linked = rows.where("_ok").select("_id", "label", "_same").join(named, ["label", "_same"])
    alone = rows.where("not _ok").select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"))
    out = linked.select("_id", "n_links", "component_id").unionByName(alone)
    return out.select(F.col("_id").alias(id_col), "n_links", "component_id",
                      F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))

"""Document fingerprints: digests of statistically improbable features.

Every run of ``WINDOW`` bytes is a feature.  Its entropy, in thousandths of
the most possible, is ranked by rarity: how seldom that value occurs among the
windows that tile all texts of the corpus.  In each stretch of ``STRETCH``
neighbouring features the leftmost rarest gets a vote, and features with
enough votes are selected, so a selection depends on nearby bytes alone.
Selected features go into a chain of Bloom filters.  Two fingerprints are
compared filter by filter: bits in common beyond chance, over the most there
could be; each filter of the shorter chain takes its best partner.

Texts shorter than a window, and texts of which nothing is selected, are one
feature; empty texts have no filter, are
alike to each other (1) and unlike any other text (0).  Null texts are empty.
Rows of one id are ordered by text; null ids come last; with one document the
next one is itself.  An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siteval.llm.common import text_of
from siteval.operators.joins import join_null_safe
from siteval.operators.ranking import shuffle_width

WINDOW = 64
LEVELS = 1_000
LEAST_LEVEL = 100  # below: padding and repeated signs, which say nothing about a text
STRETCH = 64
VOTES = 16
FILTER_BITS = 2_048
FILTER_FEATURES = 160
HASHES = 5
CHANCE = 0.05  # overlap up to this part of the way from chance to the most counts as none
SEGMENT = 1 << 20  # bytes worked on at a time
PARTS_PER_TASK = 4

_SCALE = 1 << 16
_CLOGC = np.array([0] + [round(c * np.log2(c) * _SCALE) for c in range(1, WINDOW + 2)], dtype=np.int64)
_FULL = int(WINDOW * np.log2(WINDOW) * _SCALE)


def _levels(sums: np.ndarray) -> np.ndarray:
    return ((_FULL - sums) * LEVELS // _FULL).astype(np.int16)


def entropy_levels(raw: np.ndarray) -> np.ndarray:
    """Entropy level of the window at each byte, by incremental counts.

    Sliding by one byte changes the counts of the byte that leaves and the one
    that enters; both counts come from the sorted positions of each byte value.
    """
    n = len(raw)
    if n < WINDOW:
        return np.zeros(0, np.int16)
    order = np.argsort(raw, kind="stable")
    key = raw[order].astype(np.int64) * (n + 2 * WINDOW) + order
    at = np.arange(n)
    ahead, behind = np.empty(n, np.int64), np.empty(n, np.int64)
    ahead[order] = np.searchsorted(key, key + WINDOW) - at  # equal bytes in [i, i + WINDOW)
    behind[order] = at - np.searchsorted(key, key - (WINDOW - 1))  # in (i - WINDOW, i), itself left out
    out, into = ahead[:n - WINDOW], behind[WINDOW:]
    step = _CLOGC[out - 1] - _CLOGC[out] + _CLOGC[into + 1] - _CLOGC[into]
    step[raw[:n - WINDOW] == raw[WINDOW:]] = 0
    first = _CLOGC[np.bincount(raw[:WINDOW], minlength=256)].sum()
    return _levels(np.concatenate([[0], np.cumsum(step)]) + first)


def tile_levels(raw: np.ndarray) -> np.ndarray:
    """Levels of windows side by side that cover the whole text."""
    n = len(raw)
    if n < WINDOW:
        return np.zeros(0, np.int16)
    rows = raw[:n - n % WINDOW].reshape(-1, WINDOW)
    if n % WINDOW:
        rows = np.vstack([rows, raw[n - WINDOW:]])
    found = []
    for at in range(0, len(rows), SEGMENT // 256):
        part = rows[at:at + SEGMENT // 256]
        flat = part.astype(np.int64) + 256 * np.arange(len(part))[:, None]
        counts = np.bincount(flat.ravel(), minlength=256 * len(part)).reshape(-1, 256)
        found.append(_levels(_CLOGC[counts].sum(axis=1)))
    return np.concatenate(found)


def rarity(docs: DataFrame) -> np.ndarray:
    """Rank of each level, rarest first, counted over all texts; 1,001 sums reach the driver."""
    def count(batches):
        total = np.zeros(LEVELS + 1, np.int64)
        for b in batches:
            for text in b["_text"]:
                total += np.bincount(tile_levels(np.frombuffer(text.encode(), np.uint8)), minlength=LEVELS + 1)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"level": at, "n": total[at]})

    rows = docs.select("_text").mapInPandas(count, "level int, n long").groupBy("level").agg(F.sum("n").alias("n"))
    counts = np.zeros(LEVELS + 1, np.int64)
    for r in rows.collect():
        counts[r["level"]] = r["n"]
    return ranks_of(counts)


def ranks_of(counts: np.ndarray) -> np.ndarray:
    ranks = np.empty(LEVELS + 1, np.int16)
    ranks[np.lexsort((np.arange(LEVELS + 1), counts))] = np.arange(LEVELS + 1)
    ranks[:LEAST_LEVEL] = LEVELS + 1  # never selected
    return ranks


def selected(raw: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Positions of the selected features."""
    n = len(raw)
    features = n - WINDOW + 1
    rank = np.empty(features, np.int16)
    for at in range(0, features, SEGMENT):
        upto = min(at + SEGMENT, features)
        rank[at:upto] = ranks[entropy_levels(raw[at:upto + WINDOW - 1])]
    stretch = min(STRETCH, features)
    votes = np.zeros(features, np.int32)
    for at in range(0, features - stretch + 1, SEGMENT):
        upto = min(at + SEGMENT + stretch - 1, features)
        best = (rank[at:upto].astype(np.int64) << 32) | np.arange(at, upto)
        span = 1
        while span < stretch:  # least of 1, 2, 4 ... neighbours
            step = min(span, stretch - span)
            best = np.minimum(best[:len(best) - step], best[step:])
            span += step
        place, times = np.unique(best & 0xFFFFFFFF, return_counts=True)
        votes[place] += times.astype(np.int32)
    need = min(VOTES, features - stretch + 1)
    return np.flatnonzero((votes >= need) & (rank <= LEVELS))


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def feature_hashes(raw: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Hashes of the distinct selected features, in order of first place."""
    if not len(raw):
        return np.zeros(0, np.uint64)
    if len(raw) < WINDOW:
        windows = np.pad(raw, (0, WINDOW - len(raw)))[None, :]
    else:
        at = selected(raw, ranks)
        if not len(at):  # as with padding alone: the whole text is one feature
            whole = hashlib.blake2b(raw.tobytes(), digest_size=8).digest()
            return np.frombuffer(whole, "<u8").astype(np.uint64)
        windows = np.lib.stride_tricks.sliding_window_view(raw, WINDOW)[at]
    words = np.ascontiguousarray(windows).view("<u8")
    h = np.full(len(words), np.uint64(len(raw) if len(raw) < WINDOW else WINDOW))
    for k in range(words.shape[1]):
        h = _scramble(h * np.uint64(0x9E3779B97F4A7C15) + words[:, k])
    _, first = np.unique(h, return_index=True)
    return h[np.sort(first)]


def bloom_chain(hashes: np.ndarray) -> np.ndarray:
    """Bits of the filters, one row each."""
    chain = np.zeros((-(-len(hashes) // FILTER_FEATURES), FILTER_BITS), dtype=np.uint8)
    row = np.arange(len(hashes)) // FILTER_FEATURES
    for k in range(HASHES):
        chain[row, ((hashes >> np.uint64(12 * k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = 1
    return chain


def fingerprint(text: str, ranks: np.ndarray) -> np.ndarray:
    return bloom_chain(feature_hashes(np.frombuffer(text.encode(), np.uint8), ranks))


def spelled(chain: np.ndarray) -> str:
    return base64.b64encode(np.packbits(chain, axis=1).tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Normalised bit overlap of two chains, from 0 to 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    if a.shape == b.shape and np.array_equal(a, b):
        return 1.0
    eb = b.sum(axis=1, dtype=np.float32)
    other = b.astype(np.float32)
    total = 0.0
    weights = a.sum(axis=1, dtype=np.float64)
    for row, ea in zip(a.astype(np.float32), weights):
        most = np.minimum(ea, eb)
        chance = ea * eb / FILTER_BITS
        base = chance + CHANCE * (most - chance)
        score = (other @ row - base) / np.maximum(most - base, 1e-6)
        total += float(ea) * min(1.0, max(0.0, float(score.max())))
    return total / float(weights.sum())


def in_order_with_next(docs: DataFrame, parts: int) -> DataFrame:
    """_id, _text in ranges of falling id; each range ends with the first row of
    the next range (_guest), the last one with the first row of all.

    The range bounds are constants, so a task that runs again sees the same.
    """
    shares = [i / parts for i in range(1, max(2, parts))]
    points = docs.where("_id is not null").stat.approxQuantile("_id", shares, 1 / (4 * parts)) or [0.0]
    splits = [-float("inf"), *sorted(set(points)), float("inf")]
    docs = docs.withColumn("_at", F.coalesce(F.col("_id").cast("double"), F.lit(-float("inf"))))
    placed = Bucketizer(splits=splits, inputCol="_at", outputCol="_b").transform(docs)
    placed = placed.withColumn("_part", F.when(F.col("_id").isNull(), len(splits)).otherwise(
        len(splits) - 2 - F.col("_b")).cast("int")).drop("_at", "_b")
    heads = sorted((r["_part"], r["_id"]) for r in placed.groupBy("_part").agg(F.max("_id").alias("_id")).collect())
    to = [(i, heads[k - 1][0]) for k, (_, i) in enumerate(heads)]  # the first row of a range visits the one before
    guests = docs.sparkSession.createDataFrame(to, "_id long, _host int")
    rows = join_null_safe(placed, guests, "_id", "left", broadcast=True)  # one row per range
    own = F.struct(F.col("_part"), F.lit(False).alias("_guest"))
    guest = F.struct(F.col("_host").alias("_part"), F.lit(True).alias("_guest"))
    seats = F.when(F.col("_host").isNull(), F.array(own)).otherwise(F.array(own, guest))
    rows = rows.select("_id", "_text", F.explode(seats).alias("s")).select("_id", "_text", "s.*")
    return rows.repartition(max(1, parts // PARTS_PER_TASK), "_part").sortWithinPartitions(
        "_part", "_guest", F.col("_id").desc_nulls_last(), "_text")


FIELDS = ("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
          "near_next double")


def edited(text: str, following: str) -> str:
    """The last half replaced by as many first code points of the next text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likeness."""
    docs = docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text"))
    ranks = rarity(docs)
    rows = in_order_with_next(docs, parts or PARTS_PER_TASK * shuffle_width(docs.sparkSession))
    schema = StructType.fromDDL(f"`{id_col}` long, {FIELDS}")

    def compare(batches):
        before = None  # part, id, text, chain of the row whose next is awaited
        for b in batches:
            out = []
            for part, guest, i, text in zip(*(b.column(c).to_pylist() for c in ("_part", "_guest", "_id", "_text"))):
                if before is None and guest:
                    continue  # more rows of the guest's id
                chain = fingerprint(text, ranks)
                if before is not None and before[0] == part:
                    _, pi, pt, pc = before
                    changed = edited(pt, text)
                    ec = fingerprint(changed, ranks)
                    out.append((pi, len(pt), hashlib.sha256(changed.encode()).hexdigest(), spelled(pc), spelled(ec),
                                likeness(pc, ec), likeness(pc, chain)))
                before = None if guest else (part, i, text, chain)
            columns = list(zip(*out)) or [()] * len(schema)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=schema.names)

    return rows.mapInArrow(compare, schema)

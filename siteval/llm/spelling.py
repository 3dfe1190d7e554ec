"""Spelling variant grouping by Bloom-guided neighbourhoods.

Words are counted natively.  The vocabulary goes into blocked Bloom filters,
one shard per word length, whose size is bounded: a vocabulary that needs more
is split by hash and probed in several passes, each with a filter of its own.
Every word then generates its edits where it lies and probes them; only edits
that the filter takes for words are shuffled to an exact join with the
vocabulary, which removes the false ones.

The hash of a word is a sum over its letters and places, so the hash of an edit
is the word's with a few numbers exchanged.  Near words are found once per
pair: a replacement from the word with the lesser letter, an inserted letter by
deleting it from the longer word (the first of a run of equal ones).

Null texts have no words; a null doc_id counts as empty text in the key that
decides on a deleted letter.  Repeated rows count each.  Words may have any
length.  An empty table, or one without words, gives no rows.  Other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteval.llm.common import written

RUN = "([A-Za-z\\u00C0-\\u00FF]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DELETE_EVERY = 97
LEAST_LENGTH = 5
LEAST_COUNT = 3

BITS_PER_WORD = 16
BLOCK_BITS = 512  # a block is eight 64-bit words, each with one bit of a key
FILTER_BYTES = 32_000_000  # of the filter that one pass broadcasts
PROBES = 1 << 19  # edits hashed at a time
MASKS = [f"m{i}" for i in range(8)]


# ---------------------------------------------------------------- words

def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the vocabulary."""
    lowered = F.translate(F.col(f"`{text_col}`"), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("_id"),
                       F.explode(F.regexp_extract_all(lowered, F.lit(RUN), F.lit(1))).alias("_run"))
    runs = runs.withColumn("_h", F.crc32(F.concat_ws(":", "_id", "_run")))
    at = (F.col("_h") % F.length("_run")).cast("int")
    cut = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.length("_run")))
    words = runs.select(F.when(F.col("_h") % DELETE_EVERY == 0, cut).otherwise(F.col("_run")).alias("word"))
    words = words.where(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


# ---------------------------------------------------------------- hashes of words and their edits

def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _letter(place: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The number of a letter at a place; a word's hash is their sum."""
    return _mix((place.astype(np.uint64) * np.uint64(256) + code.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def word_hashes(codes: np.ndarray) -> np.ndarray:
    """codes: words of one length as rows of letters."""
    return _letter(np.arange(codes.shape[1])[None, :], codes).sum(axis=1, dtype=np.uint64)


def _places(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each hash, and 48 more bits for the places inside."""
    a = _mix(h)
    return ((a >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32), _mix(a ^ np.uint64(0xD6E8FEB86659FD93))


def _bits(more: np.ndarray, i: int) -> np.ndarray:
    return np.uint64(1) << ((more >> np.uint64(6 * i)) & np.uint64(63))


def _pass_of(h: np.ndarray, passes: int) -> np.ndarray:
    return _mix(h ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(passes)


def _letters(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def _of_one_length(batch: pa.RecordBatch):
    """Row places, words and letters of a batch, some words of one length at a time."""
    words = batch.column("word").to_pylist()
    sizes = np.array([len(w) for w in words])
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        step = max(1, PROBES // int(size))
        for i in range(0, len(rows), step):
            some = rows[i:i + step]
            picked = [words[k] for k in some]
            yield some, picked, _letters(picked)


class Filters:
    """Blocked Bloom filters of one pass, a shard per word length."""

    def __init__(self, counts: dict[int, int], passes: int, number: int):
        self.passes, self.number = passes, number
        self.blocks = {size: max(1, -(-n * BITS_PER_WORD // (passes * BLOCK_BITS))) for size, n in counts.items()}
        ends = np.cumsum(list(self.blocks.values()))
        self.start = dict(zip(self.blocks, (ends - list(self.blocks.values())).tolist()))
        self.total = int(ends[-1])

    def rows(self, words: DataFrame) -> DataFrame:
        """Non-empty blocks: block, m0..m7."""
        def run(batches):
            for b in batches:
                for _, _, codes in _of_one_length(b):
                    h = word_hashes(codes)
                    h = h[_pass_of(h, self.passes) == self.number]
                    size = codes.shape[1]
                    block, more = _places(h, self.blocks[size])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(block.astype(np.int64) + self.start[size])] + [pa.array(_bits(more, i).view(np.int64)) for i in range(8)],
                        names=["block", *MASKS])
        bits = words.select("word").mapInArrow(run, "block long, " + ", ".join(f"{m} long" for m in MASKS))
        return bits.groupBy("block").agg(*[F.bit_or(m).alias(m) for m in MASKS])

    def build(self, words: DataFrame) -> np.ndarray:
        """total x 8; its size is bounded by the number of passes."""
        table = np.zeros((self.total, 8), np.uint64)
        rows = self.rows(words).toArrow()
        at = rows.column("block").to_numpy()
        for i, m in enumerate(MASKS):
            table[at, i] = rows.column(m).to_numpy().view(np.uint64)
        return table

    def holds(self, table: np.ndarray, h: np.ndarray, size: int) -> np.ndarray:
        """Which hashes of words of a length may be in the filter of this pass."""
        if size not in self.blocks:
            return np.zeros(0, np.int64)
        at = np.arange(len(h)) if self.passes == 1 else np.flatnonzero(_pass_of(h, self.passes) == self.number)
        block, more = _places(h[at], self.blocks[size])
        block = block.astype(np.int64) + self.start[size]
        for i in range(8):
            bit = _bits(more, i)
            alive = np.flatnonzero(table[block, i] & bit)
            at, block, more = at[alive], block[alive], more[alive]
        return at


def edits(codes: np.ndarray, alphabet: np.ndarray):
    """Edits of words of one length, some at a time: (word's row, place, letter or -1, hash, length)."""
    n, size = codes.shape
    place = np.arange(size)
    here = _letter(place[None, :], codes)
    whole = here.sum(axis=1, dtype=np.uint64)
    # a deletion: letters before as they are, letters behind one place earlier
    moved = _letter(np.maximum(place - 1, 0)[None, :], codes)
    before = np.cumsum(here, axis=1, dtype=np.uint64) - here
    behind = np.cumsum(moved[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1] - moved
    first = np.ones((n, size), bool)
    first[:, 1:] = codes[:, 1:] != codes[:, :-1]
    row, at = np.nonzero(first)
    yield row, at, np.full(len(row), -1), (before + behind)[row, at], size - 1
    # replacements by a greater letter
    rows_at_once = max(1, PROBES // max(1, size * len(alphabet)))
    places_at_once = max(1, PROBES // max(1, rows_at_once * len(alphabet)))
    for p in range(0, size, places_at_once):
        some = place[p:p + places_at_once]
        new = _letter(some[:, None], alphabet[None, :])
        for r in range(0, n, rows_at_once):
            part = codes[r:r + rows_at_once, some]
            row, at, letter = np.nonzero(alphabet[None, None, :] > part[:, :, None])
            h = whole[r + row] - here[r + row, p + at] + new[at, letter]
            yield r + row, p + at, alphabet[letter].astype(np.int64), h, size


def candidates(words: DataFrame, filters: Filters, table, alphabets: dict[int, np.ndarray]) -> DataFrame:
    """word, n, near: edits that the filter of a pass takes for words."""
    def run(batches):
        bits = table.value
        for b in batches:
            for rows, picked, codes in _of_one_length(b):
                source, near = [], []
                for row, place, letter, h, size in edits(codes, alphabets[codes.shape[1]]):
                    for k in filters.holds(bits, h, size).tolist():
                        w, p, c = picked[row[k]], int(place[k]), int(letter[k])
                        source.append(rows[row[k]])
                        near.append(w[:p] + (chr(c) if c >= 0 else "") + w[p + 1:])
                part = b.take(pa.array(source, pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("word"), part.column("n"), pa.array(near, pa.string())],
                                                 names=["word", "n", "near"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, near string")


def near_pairs(words: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """a, n_a, b, n_b: each pair of near words once."""
    spark = words.sparkSession
    counts = {r["size"]: r["c"] for r in words.groupBy(F.length("word").alias("size")).agg(F.count(F.lit(1)).alias("c")).collect()}
    letters = words.select(F.length("word").alias("size"), F.explode(F.split("word", "")).alias("letter")).distinct()
    alphabets: dict[int, list[int]] = {size: [] for size in counts}  # at most 90 letters a length
    for r in letters.where("letter <> ''").toLocalIterator():
        alphabets[r["size"]].append(ord(r["letter"]))
    alphabets = {size: np.array(sorted(found), np.uint8) for size, found in alphabets.items()}
    passes = max(1, -(-sum(counts.values()) * BITS_PER_WORD // (8 * filter_bytes)))
    found = None
    for number in range(passes if counts else 0):
        filters = Filters(counts, passes, number)
        table = spark.sparkContext.broadcast(filters.build(words))
        part = written(candidates(words, filters, table, alphabets), "near-candidates")
        table.unpersist()
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "a string, n_a long, b string, n_b long")
    vocabulary = words.select(F.col("word").alias("b"), F.col("n").alias("n_b"))
    return found.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("near").alias("b")).join(vocabulary, "b").select(
        "a", "n_a", "b", "n_b")


# ---------------------------------------------------------------- forms

def roots(forms: DataFrame) -> DataFrame:
    """word, root from (word, form): pointers are followed twice as far each
    round; counts at least double from word to form, so few rounds end it."""
    at = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = written(at.join(ahead, "root", "left").select("word", "root", "_next"), "forms")
        at = moved.select("word", F.coalesce("_next", "root").alias("root"))
        if moved.where("_next IS NOT NULL").isEmpty():
            return at


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """One row per word: ``word, form, root, n, n_near, form_n``."""
    words = written(word_counts(docs, id_col, text_col), "vocabulary")
    sides = F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))).alias("s")
    near = near_pairs(words, filter_bytes).select(sides).select("s.*")
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"),
                                    F.min(F.struct((-F.col("near_n")).alias("minus_n"), "near")).alias("best"))
    joined = words.join(best, "word", "left")
    enough = -F.col("best.minus_n") >= 2 * F.col("n")
    joined = written(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
                                   F.when(enough, F.col("best.near")).alias("form"),
                                   F.when(enough, -F.col("best.minus_n")).alias("form_n")), "near-words")
    ends = roots(joined.where("form IS NOT NULL"))
    return joined.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

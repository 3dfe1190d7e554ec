"""Mixing sources to target weights with a low-discrepancy schedule.

Targets share all words by weight; no source gives more than ``repeats`` times
its words, and what it cannot give goes to the others by weight.  Slot i of the
schedule has the point frac(i * golden ratio), mapped through the cumulative
target shares to a source, so every stretch of the schedule is close to the
mix.  The slots of a source are ranked; slot k takes block k of the source:
``block`` words of its documents in hash order, round and round.  A source that
has met its target leaves the schedule; blocks that the points of a source do
not reach, as may be with a target of few blocks, are appended to it.

Ranks and positions are sums over hash buckets or slot chunks plus sums inside
one of them, so a source may hold any share of the rows.

Null texts and texts of white space have size 0 and are never taken.  A null
source is one source, the last.  Rows of null or repeated ids stay rows of
their own; equal rows may stand for each other.  An empty table gives an empty
table.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteval.functions.hashing import HASH_BITS, h60
from siteval.llm.common import packed, text_of, written
from siteval.operators.joins import join_null_safe

WEIGHTS = (1, 2, 3)
REPEATS = 3
BLOCK = 256
BUCKET_ROWS = 4_096
CHUNK_SLOTS = 8_192
GOLDEN = 0.6180339887498949
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """One row per source: rank, rows, source_size and target.

    Sources are few (their weights are set by hand), so windows over all of
    them are small.
    """
    by = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size"))
    ordered = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(ordered)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights) + 1)
    by = by.withColumn("rank", rank).withColumn("weight", weight).withColumn("cap", F.col("source_size") * repeats)
    everything = Window.partitionBy(F.lit(0))
    tight = everything.orderBy(F.col("cap") / F.col("weight"), "rank")
    by = by.withColumn("_before", F.coalesce(F.sum("cap").over(tight.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    by = by.withColumn("_weights", F.sum("weight").over(tight.rowsBetween(0, Window.unboundedFollowing)))
    by = by.withColumn("_total", F.sum("source_size").over(everything))
    level = (F.col("_total") - F.col("_before")).cast("double") / F.col("_weights")
    by = by.withColumn("_level", level)
    free = F.col("cap") > F.col("weight") * F.col("_level")
    final = F.min_by(F.when(free, F.col("_level")), F.when(free, F.col("_before"))).over(everything)
    by = by.withColumn("_final", final)
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * F.col("_final"), F.col("cap").cast("double")))
    return by.withColumn("target", target).drop("_before", "_weights", "_level", "_final", "_total", "cap", "weight")


def positions(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds rank, source_size, target, quota and start: the words of the
    source's earlier documents in hash order."""
    spread = sources.select("source", "rank", "source_size", "target", F.floor("target").alias("quota"),
                            F.ceil(F.col("rows") / BUCKET_ROWS).alias("_buckets"))
    placed = join_null_safe(sizes, spread, "source", "inner")
    placed = placed.withColumn("_h", h60("mix", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    bucket = F.floor(F.col("_h") / float(1 << HASH_BITS) * F.col("_buckets"))
    placed = placed.withColumn("_b", bucket).drop("_buckets")
    sums = placed.groupBy("rank", "_b").agg(F.sum("size").alias("_sum"))
    upto = Window.partitionBy("rank").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("rank", "_b", F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("rank", "_b").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.join(offsets, ["rank", "_b"])
    start = F.col("_offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    return placed.withColumn("start", start).drop("_b", "_h", "_offset")


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """slot, rank (of the source) and block: the k-th slot of a source takes its block k."""
    spark = sources.sparkSession
    needed = F.ceil(F.floor("target") / block)
    got = sources.agg(F.sum(needed).alias("slots"), F.count(F.lit(1)).alias("n")).first()
    slots, n = got["slots"] or 0, got["n"]
    # spare slots: the points of an interval are mostly off its share by a few
    length = slots + slots // 64 + 8 * n if slots else 0
    cells = 8 * max(1, n)
    upto = Window.partitionBy(F.lit(0)).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("target").over(Window.partitionBy(F.lit(0)))
    parts = sources.select("rank", needed.alias("_needed"), "target", (F.sum("target").over(upto) / total).alias("_high"),
                           ((F.sum("target").over(upto) - F.col("target")) / total).alias("_low"))
    parts = parts.where("target > 0").withColumn("_cell", F.explode(F.sequence(
        F.floor(F.col("_low") * cells), F.floor(F.col("_high") * cells))))
    i = F.col("slot")
    big = 1 << 20  # the product is taken in two parts to keep its fraction exact
    step = (big * GOLDEN) % 1.0
    points = spark.range(length).withColumnRenamed("id", "slot")
    points = points.withColumn("_u", (F.floor(i / big) * F.lit(step) + (i % big) * F.lit(GOLDEN)) % 1.0)
    points = points.withColumn("_cell", F.floor(F.col("_u") * cells))
    hit = (F.col("_u") >= F.col("_low")) & (F.col("_u") < F.col("_high"))
    chosen = points.join(parts, "_cell").where(hit).select("slot", "rank", "_needed", F.floor(i / CHUNK_SLOTS).alias("_c"))
    counts = written(chosen.groupBy("rank", "_c").agg(F.count(F.lit(1)).alias("_n")), "mix-slots")
    before = Window.partitionBy("rank").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("rank", "_c", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("rank", "_c").orderBy("slot")
    ranked = chosen.join(starts, ["rank", "_c"]).withColumn("block", F.col("_before") + F.row_number().over(inside) - 1)
    ranked = ranked.where(F.col("block") < F.col("_needed")).select("slot", "rank", "block")
    # exact for every source: blocks that no point reached follow, one of each source in turn
    short = sources.select("rank", needed.alias("_needed")).join(
        counts.groupBy("rank").agg(F.sum("_n").alias("_got")), "rank", "left")
    short = short.withColumn("_got", F.coalesce("_got", F.lit(0))).where("_got < _needed")
    short = short.select("rank", "_got", F.explode(F.sequence(F.col("_got"), F.col("_needed") - 1)).alias("block"))
    slot = F.lit(length) + (F.col("block") - F.col("_got")) * n + F.col("rank") - 1
    return ranked.unionByName(short.select(slot.alias("slot"), "rank", "block"))


def block_pieces(placed: DataFrame, block: int = BLOCK, repeats: int = REPEATS) -> DataFrame:
    """rank, block, start, epoch, words: the part of each document that lies in a block."""
    rounds = placed.where("size > 0").select("rank", "start", "size", "quota", "source_size", F.explode(
        F.array(*[F.lit(e) for e in range(repeats)])).alias("epoch"))
    rounds = rounds.withColumn("_from", F.col("epoch") * F.col("source_size") + F.col("start"))
    rounds = rounds.withColumn("_to", F.least(F.col("_from") + F.col("size"), "quota")).where("_from < _to")
    blocks = F.sequence(F.floor(F.col("_from") / block), F.floor((F.col("_to") - 1) / block))
    pieces = rounds.withColumn("block", F.explode(blocks))
    words = F.least("_to", (F.col("block") + 1) * block) - F.greatest("_from", F.col("block") * block)
    return pieces.select("rank", "block", "start", "epoch", words.alias("words"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    sizes = docs.select("doc_id", "source", word_count(text_of()).alias("size"))
    sizes = written(sizes, "mix-sizes")  # narrow; read for the sums, the positions and the result
    sources = written(source_targets(sizes, weights, repeats), "mix-sources")
    placed = written(positions(sizes, sources), "mix-positions")
    taken = block_pieces(placed, block, repeats).join(schedule(sources, block), ["rank", "block"])
    taken = taken.groupBy("rank", "start").agg(F.sum("words").alias("_taken"))
    found = placed.join(taken, ["rank", "start"], "left")
    words = F.when(F.col("size") > 0, F.coalesce("_taken", F.lit(0))).otherwise(0).cast("long")
    return found.select("doc_id", "size", "source_size", "target", words.alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS,
                    block: int = BLOCK) -> DataFrame:
    """The documents that the mix takes, once for each time that at least half
    of their words are taken in a round."""
    plan = mix(docs, weights, repeats, block)
    copies = plan.where("size > 0").groupBy(F.col("doc_id").alias("_id")).agg(
        F.max(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int").alias("_copies"))
    rows = join_null_safe(packed(docs, _id=F.col("doc_id")), copies.where("_copies > 0"), "_id")
    return rows.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")

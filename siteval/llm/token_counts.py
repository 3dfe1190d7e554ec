"""Token counts by overlap resynchronisation.

Texts of up to ``chunk`` code points are counted in place.  Longer ones are cut
into overlapping chunks that spread over the cluster.  Neighbouring chunks are
spliced at a piece boundary that both have inside their overlap, far enough
from the left chunk's end to be out of reach of its cut: the scan of the
pre-tokenizer depends on nothing before such a boundary, so both go on alike.
Texts with a join that has no such boundary are cut again with chunks and
overlaps four times as wide, at last as one chunk.

Null texts count as empty (0 tokens); equal texts are counted once; null or
repeated ids are kept row by row; an empty table gives an empty table.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteval.llm.common import map_texts, text_of
from siteval.llm.tokens import bpe
from siteval.operators.ranking import checkpointed

CHUNK = 65_536
OVERLAP = 2_048
WIDER = 4


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc id, n_bytes, n_tokens and over_limit of every whole text."""
    if not 0 < overlap * 2 <= chunk:
        raise ValueError("an overlap takes at most half a chunk")
    docs = docs.select(F.col(id_col), text_of(text_col).alias("_text"))
    docs = docs.withColumn("n_bytes", F.octet_length("_text").cast("long"))
    def start():
        enc = bpe(tokenizer)
        return lambda texts: [[len(i) // enc.dtype.itemsize for i in enc.encode_texts(texts)]]

    counted = map_texts(docs.where(F.length("_text") <= chunk), [id_col, "n_bytes"], "n_tokens long", start)
    long = docs.where(F.length("_text") > chunk).withColumn("_key", F.sha2("_text", 256))
    totals = _count_long(long.select("_key", "_text"), tokenizer, chunk, overlap)
    joined = long.select(id_col, "n_bytes", "_key").join(totals, "_key").select(id_col, "n_bytes", "n_tokens")
    return counted.unionByName(joined).withColumn("over_limit", F.col("n_tokens") > limit)


def _count_long(texts: DataFrame, tokenizer: str, chunk: int, overlap: int) -> DataFrame:
    """_key and n_tokens; each round decides the texts whose joins all have a common boundary."""
    done = []
    while True:
        found = checkpointed(_count_round(texts, tokenizer, chunk, overlap))
        done.append(found.where("n_tokens is not null"))
        open_keys = found.where("n_tokens is null").select("_key")
        if open_keys.isEmpty():
            break
        texts = texts.join(open_keys, "_key", "left_semi")
        chunk, overlap = chunk * WIDER, overlap * WIDER
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _count_round(texts: DataFrame, tokenizer: str, chunk: int, overlap: int) -> DataFrame:
    step = chunk - overlap

    def cut(batches):
        for b in batches:
            for key, text in zip(b["_key"], b["_text"]):
                n = max(1, -(-(len(text) - overlap) // step))
                for i in range(n):
                    piece = text[i * step:i * step + chunk] if i < n - 1 else text[i * step:]
                    yield pd.DataFrame({"_key": [key], "_i": [i], "_last": [i == n - 1], "_piece": [piece]})

    def encode(batches):
        enc = bpe(tokenizer)
        for b in batches:
            rows = []
            for key, i, last, piece in zip(b["_key"], b["_i"], b["_last"], b["_piece"]):
                at, before, n = enc.starts(piece)
                end = len(piece)
                head = at < overlap - enc.margin if i else at < 0
                tail = (at >= end - overlap) & (at < end - enc.margin) if not last else at < 0
                at = at + i * step
                rows.append((key, i, last, n, at[head], before[head], at[tail], before[tail]))
            yield pd.DataFrame(rows, columns=["_key", "_i", "_last", "_n", "_hp", "_hn", "_tp", "_tn"])

    pieces = texts.mapInPandas(cut, "_key string, _i long, _last boolean, _piece string")
    pieces = pieces.dropDuplicates(["_key", "_i"])  # equal texts once; this also spreads a text's chunks
    coded = checkpointed(pieces.mapInPandas(
        encode, "_key string, _i long, _last boolean, _n long, _hp array<long>, _hn array<long>, "
                "_tp array<long>, _tn array<long>"))
    left = coded.where("not _last").select("_key", "_i", "_tp", "_tn")
    right = coded.where("_i > 0").select("_key", (F.col("_i") - 1).alias("_i"), "_hp", "_hn")
    pairs = left.join(right, ["_key", "_i"], "left")
    at = F.array_max(F.array_intersect("_tp", "_hp"))
    gain = (F.element_at("_tn", F.array_position("_tp", at).cast("int"))
            - F.element_at("_hn", F.array_position("_hp", at).cast("int")))
    joins = pairs.select("_key", F.when(at.isNotNull(), gain).alias("_gain"))
    ends = coded.where("_last").select("_key", F.col("_n").alias("_gain"))
    all_of = joins.unionByName(ends).groupBy("_key")
    return all_of.agg(F.when(F.count("*") == F.count("_gain"), F.sum("_gain")).alias("n_tokens"))

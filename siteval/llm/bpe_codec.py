"""BPE encoding and decoding with tree concatenation for long texts.

Texts of up to ``leaf`` code points are encoded in place.  A longer text is
halved until its parts are short enough; the parts are encoded in parallel
over the cluster, and siblings are joined level by level.  A join encodes a
window around the cut again and lets it grow until it agrees with both sides:

* at a boundary of pieces that window and side share, beyond the reach of any
  cut, because the pre-tokenizer's scan goes on alike from there, or
* inside a run of letters that nothing splits, at a token which window and side
  share: a row of tokens is the encoding of such a run exactly when every two
  neighbours are, and each pair lies whole in the window or in the side.

At worst the window covers both sides.

Null texts are empty (no ids); equal long texts are encoded once; null or
repeated ids are kept row by row; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteval.llm.common import map_texts, text_of
from siteval.llm.tokens import WORD_START, Bpe, bpe

LEAF = 65_536
WINDOW = 256  # bytes on either side of a cut at first
_IDS = ~WORD_START


def _inside_letters(raw: bytes, at: int) -> bool:
    """The code points around a byte offset are both letters."""
    if not 0 < at < len(raw) or raw[at] & 0xC0 == 0x80:
        return False
    first = at - 1
    while first > 0 and raw[first] & 0xC0 == 0x80:
        first -= 1
    both = raw[first:at + 4].decode("utf-8", errors="ignore")
    return both[:2].isalpha() and len(both) > 1


def concatenate(enc: Bpe, left: bytes, left_ids: np.ndarray, right: bytes, right_ids: np.ndarray,
                window: int = WINDOW) -> np.ndarray:
    """Flagged ids of two texts joined, from the flagged ids of each."""
    if not len(left_ids) or not len(right_ids):
        return np.concatenate([left_ids, right_ids])
    size, cut, margin = enc.byte_lengths(), len(left), 4 * enc.margin
    l_end = np.cumsum(size[left_ids & _IDS])
    l_start = l_end - size[left_ids & _IDS]
    r_start = np.concatenate([[0], np.cumsum(size[right_ids & _IDS])])  # with the end
    while True:
        a = int(np.searchsorted(l_start, cut - margin - window, side="right")) - 1
        while a > 0 and not (left_ids[a] & WORD_START) and not _inside_letters(left, int(l_start[a])):
            a -= 1
        a = max(a, 0)
        b = int(np.searchsorted(r_start, margin + window))
        while b < len(right_ids) and right[r_start[b]] & 0xC0 == 0x80:
            b += 1
        b = min(b, len(right_ids))
        begin, stop = int(l_start[a]), int(r_start[b])
        mid = enc.flagged((left[begin:] + right[:stop]).decode("utf-8"))
        m_start = begin + np.concatenate([[0], np.cumsum(size[mid & _IDS])])
        p = _agree_left(left, left_ids, l_start, a, mid, m_start, cut - margin)
        whole = b == len(right_ids)
        q = (len(mid), b) if whole else _agree_right(right, right_ids, r_start, mid, m_start, cut, stop - margin)
        if p and q and p[1] <= q[0]:
            return np.concatenate([left_ids[:p[0]], mid[p[1]:q[0]], right_ids[q[1]:]])
        window *= 2


def _agree_left(raw, ids, start, a, mid, m_start, upto):
    """(ids kept of the left side, first id taken of the window), or None."""
    if a == 0 or ids[a] & WORD_START:
        return a, 0
    i = np.arange(a + 1, len(ids))
    i = i[start[i] <= upto]
    m = np.searchsorted(m_start, start[i])
    ok = (m > 0) & (m < len(mid))
    i, m = i[ok], m[ok]
    same = (m_start[m] == start[i]) & (m_start[m - 1] == start[i - 1])
    # the window's first id has the mark of a piece; the run goes on across it
    same &= ((mid[m - 1] ^ ids[i - 1]) & _IDS) == 0
    same &= (mid[m] & WORD_START) == (ids[i] & WORD_START)
    for x, y in zip(i[same], m[same]):
        if ids[x] & WORD_START or _inside_letters(raw, int(start[x])):
            return int(x), int(y)
    return None


def _agree_right(raw, ids, start, mid, m_start, cut, upto):
    """(ids taken of the window, first id kept of the right side), or None."""
    m = np.arange(len(mid))
    m = m[(m_start[m] >= cut) & (m_start[m + 1] - cut <= upto)]
    j = np.searchsorted(start, m_start[m] - cut)
    same = start[j] == m_start[m] - cut
    same &= j < len(ids)
    m, j = m[same], j[same]
    same = mid[m] == ids[j]  # the id and whether a piece begins with it
    for x, y in zip(m[same], j[same]):
        if mid[x] & WORD_START or _inside_letters(raw, int(start[y])):
            return int(x), int(y)
    return None


@lru_cache(maxsize=2)
def _names(size: int) -> list[str]:
    return [str(i) for i in range(size)]


def digest(enc: Bpe, ids: list[list[int]]) -> tuple[list[str], list[str]]:
    """sha256 of the decimal ids and of the decoded text."""
    names = _names(enc.size)
    coded = [hashlib.sha256(",".join([names[i] for i in x]).encode()).hexdigest() for x in ids]
    texts = enc.tok.decode_batch(ids, skip_special_tokens=False)
    return coded, [hashlib.sha256(t.encode()).hexdigest() for t in texts]


def encode_long(texts: DataFrame, tokenizer: str, leaf: int = LEAF, window: int = WINDOW) -> DataFrame:
    """_key, _ids (packed uint32, marked) of distinct texts (_key, _text)."""
    schema = "_key string, _i long, _left int, _raw binary, _ids binary"

    def halve(batches):
        for b in batches:
            for key, text in zip(b["_key"], b["_text"]):
                levels = 0
                while len(text) > leaf << levels:
                    levels += 1
                at = [len(text) * i >> levels for i in range((1 << levels) + 1)]
                for i in range(1 << levels):
                    yield pd.DataFrame({"_key": [key], "_i": [i], "_left": [levels],
                                        "_raw": [text[at[i]:at[i + 1]].encode()]})

    def encode(batches):
        enc = bpe(tokenizer)
        for b in batches:
            yield b.assign(_ids=[enc.flagged(r.decode()).astype("<u4").tobytes() for r in b["_raw"]])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) == 1:  # a finished text
            return pdf
        enc, pdf = bpe(tokenizer), pdf.sort_values("_i")
        (l, r), (li, ri) = pdf["_raw"], (np.frombuffer(x, "<u4") for x in pdf["_ids"])
        ids = concatenate(enc, l, li, r, ri, window)
        return pd.DataFrame({"_key": pdf["_key"].iloc[:1].values, "_i": [int(pdf["_i"].iloc[0]) >> 1],
                             "_left": [int(pdf["_left"].iloc[0]) - 1], "_raw": [l + r],
                             "_ids": [ids.astype("<u4").tobytes()]})

    parts = texts.mapInPandas(halve, "_key string, _i long, _left int, _raw binary")
    nodes = parts.dropDuplicates(["_key", "_i"]).mapInPandas(encode, schema)  # spreads the parts of a text
    longest = texts.agg(F.max(F.length("_text"))).first()[0] or 0
    levels = 0
    while longest > leaf << levels:
        levels += 1
    for _ in range(levels):  # a group holds two siblings
        pair = F.when(F.col("_left") > 0, F.shiftright("_i", 1)).otherwise(0).alias("_pair")
        nodes = nodes.groupBy("_key", pair).applyInPandas(join, schema)
    return nodes.select("_key", "_ids")


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                  leaf: int = LEAF, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """doc id, n_tokens, the digests of ids and of the decoded text, and the ids if asked for."""
    docs = docs.select(F.col(id_col), text_of(text_col).alias("_text"))
    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def rows(enc: Bpe, ids: list[list[int]]) -> list[list]:
        return [[len(i) for i in ids], *digest(enc, ids), *([ids] if with_ids else [])]

    def start():
        enc = bpe(tokenizer)
        return lambda texts: rows(enc, [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode_texts(texts)])

    def finish():
        enc = bpe(tokenizer)
        return lambda coded: rows(enc, [(np.frombuffer(x, "<u4") & _IDS).tolist() for x in coded])

    short = map_texts(docs.where(F.length("_text") <= leaf), [id_col], fields, start)
    long = docs.where(F.length("_text") > leaf).withColumn("_key", F.sha2("_text", 256))
    coded = map_texts(encode_long(long.select("_key", "_text"), tokenizer, leaf, window), ["_key"], fields, finish, "_ids")
    joined = long.select(id_col, "_key").join(coded, "_key").drop("_key")
    return short.unionByName(joined.select(short.columns))

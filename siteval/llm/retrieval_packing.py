"""Lexical retrieval packing: windows filled with documents that share words.

Every document becomes the ids of its whole text and an end id.  Ids beyond a
document's last full window stand alone as whole windows; what is left (less
than a window) goes into a shard.  Shards are runs of about ``SHARD_TOKENS``
ids in the order of the documents' rarest ids, so documents on one subject,
and copies, meet; a group of copies of any size is cut where a shard ends.  A
shard holds a BM25 inverted index over ids, with document frequencies and mean
length taken over all documents.  A seed document asks it for unused
neighbours, which fill the window by falling score; the one that no longer fits
is cut, and its rest is the next seed.  What remains when a task's documents
are used up is cut into sequences of falling powers of two, which need no
padding.

Null texts are empty: they hold the end id alone.  Null and repeated ids are
documents like any other.  A text of any length is cut, never dropped; an empty
table gives no pieces.  Other columns are ignored.  Shards are made inside
range partitions of fixed order, so a task that runs again gives the same rows.
"""

from __future__ import annotations

import gc
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteval.llm.common import slices, text_of, written
from siteval.llm.tokens import bpe
from siteval.operators.ranking import shuffle_width

WINDOW = 4_096
SHARD_TOKENS = 1 << 18
K1, B = 1.2, 0.75

CACHED_WORDS = 600_000
LONGEST_CACHED = 64
# how the vocabulary's own file cuts words, and the same for lower-cased one-byte characters
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTERS, _NUMBERS = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
_PIECES = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}]+").findall
_UNSURE_SPACE = re.compile("[\x1c-\x1f\u180e]").search  # white space to one of the two scanners only


class SpacedEncoder:
    """Ids of texts for a vocabulary whose pieces never cross white space.

    Then a text's ids are those of its words in turn.  The pieces of a new word
    of one-byte characters go to the library's model; other words, texts on
    whose white space Python and the library could differ, and the whole texts
    of other vocabularies go to the library as they are.
    """

    def __init__(self, path: str):
        self.bpe = bpe(path)
        self.dtype = self.bpe.dtype
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.splits = self._drops_space()
        self.model = self.bpe.tok.model if self.splits and self._known_rules(spec) else None
        # the byte alphabet: printable characters stand for themselves, the other bytes for those from 256 on
        shown = [*range(0x21, 0x7f), *range(0xa1, 0xad), *range(0xae, 0x100)]
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet = {b: 256 + k for k, b in enumerate(hidden)}
        self._cache: dict[str, bytes] = {}
        self._pieces: dict[str, bytes] = {}

    def _drops_space(self) -> bool:
        def ids(text):
            return self.bpe.tok.encode(text, add_special_tokens=False).ids
        return ids("a  b\t\nc") == ids("a") + ids("b") + ids("c") and not ids(" \n") and not self.bpe.splits

    @staticmethod
    def _known_rules(spec: dict) -> bool:
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        return ([x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in cuts] == ["Split", "ByteLevel"]
                and cuts[0]["pattern"] == {"Regex": _SPLIT} and not cuts[1]["use_regex"] and not cuts[1]["add_prefix_space"])

    def _library(self, texts: list[str]) -> list[bytes]:
        was = gc.isenabled()
        gc.disable()  # encodings hold no cycles
        try:
            return [array(self.bpe.code, e.ids).tobytes() for e in self.bpe.tok.encode_batch_fast(texts, add_special_tokens=False)]
        finally:
            if was:
                gc.enable()

    def _piece(self, piece: str) -> bytes:
        plain = piece.isascii() and piece.isprintable()  # each byte stands for itself
        shown = piece if plain else piece.encode().decode("latin-1").translate(self.alphabet)
        raw = array(self.bpe.code, [t.id for t in self.model.tokenize(shown)]).tobytes()
        if len(self._pieces) < CACHED_WORDS and len(piece) <= LONGEST_CACHED:
            self._pieces[piece] = raw
        return raw

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words without white space."""
        if self.model is None:
            return self._library(words)
        known, piece = self._pieces.get, self._piece
        together = "\n".join(words)
        special = [x for x in self.bpe.special if x in together]
        out: list[bytes | None] = []
        for w in words:
            if special and any(x in w for x in special):
                out.append(None)
            elif w.isascii() and w.isalpha():  # one piece
                p = w.lower()
                out.append(known(p) or piece(p))
            elif w.isascii() or max(w) < "\u0100":
                out.append(b"".join([known(p) or piece(p) for p in _PIECES(w.lower())]))
            else:
                out.append(None)
        rest = iter(self._library([w for w, x in zip(words, out) if x is None]))
        return [next(rest) if x is None else x for x in out]

    def encode(self, texts: list[str]) -> list[bytes]:
        words = [x.split() if self.splits and not _UNSURE_SPACE(x) else None for x in texts]
        new: set[str] = set()
        for w in words:
            if w:
                new.update(w)
        cache = self._cache
        fresh = list(new.difference(cache))
        cache.update(zip(fresh, self._words(fresh)))
        whole = iter(self._library([x for x, w in zip(texts, words) if w is None]))
        known = cache.__getitem__
        out = [next(whole) if w is None else b"".join(map(known, w)) for w in words]
        room = CACHED_WORDS - len(cache) + len(fresh)
        for k, w in enumerate(fresh):
            if k >= room or len(w) > LONGEST_CACHED:
                del cache[w]
        return out


_ENCODERS: dict[str, SpacedEncoder] = {}


def spaced_encoder(path: str) -> SpacedEncoder:
    """One per Python process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = SpacedEncoder(path)
    return _ENCODERS[path]


# ---------------------------------------------------------------- ids of documents

def encoded(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, ids (packed, with the end id), doc_tokens and the place in the order of subjects."""
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(f"`{text_col}`").alias("_text"))
    schema = docs.select("doc_id").schema.add("ids", "binary").add("doc_tokens", "long").add("subject", "long")

    def run(batches):
        enc = spaced_encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            for b in slices(batch, "_text"):
                raw = enc.encode(b.column("_text").to_pylist())
                # the greatest ids were merged last: they are the rarest
                subjects = [_subject(np.frombuffer(x, enc.dtype)) for x in raw]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array([x + end for x in raw], pa.binary()),
                     pa.array([len(x) // enc.dtype.itemsize + 1 for x in raw], pa.int64()), pa.array(subjects, pa.int64())],
                    names=schema.names)

    return docs.mapInArrow(run, schema)


def _subject(ids: np.ndarray) -> int:
    """Its two rarest ids."""
    if not len(ids):
        return 0
    first = int(ids.max())
    return first << 32 | int(ids.max(initial=0, where=ids != first))


def frequencies(ids: DataFrame, dtype: np.dtype, vocabulary: int) -> np.ndarray:
    """In how many documents each id occurs; as long as the vocabulary."""
    def run(batches):
        counts, last = np.zeros(vocabulary, np.int64), np.zeros(vocabulary, np.int64)
        for b in batches:
            for raw in b.column("ids"):
                ids = np.frombuffer(raw.as_buffer(), dtype)
                at = np.arange(len(ids))
                last[ids] = at  # one place of each distinct id, without sorting
                counts[ids[last[ids] == at]] += 1
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"id": pa.array(at, pa.int32()), "n": pa.array(counts[at], pa.int64())})

    rows = ids.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    out = np.zeros(vocabulary, np.int64)
    for r in rows.toLocalIterator():
        out[r["id"]] = r["n"]
    return out


# ---------------------------------------------------------------- a shard's inverted index

class Index:
    """BM25 over the documents of one shard; ids are the terms."""

    def __init__(self, documents: list[np.ndarray], idf: np.ndarray, mean_length: float):
        lengths = np.array([len(d) for d in documents])
        row = np.repeat(np.arange(len(documents), dtype=np.int64), lengths)
        width = len(idf)
        cell, tf = np.unique(row * width + np.concatenate(documents), return_counts=True)
        row, term = cell // width, cell % width
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[row] / mean_length))
        order = np.argsort(term, kind="stable")
        self.n = len(documents)
        self.rows, self.weights = row[order], weight[order]
        self.terms = term  # by document
        self.first = np.searchsorted(row, np.arange(self.n + 1))
        self.post = np.searchsorted(term[order], np.arange(width + 1))

    def scores(self, seed: int) -> np.ndarray:
        """Of every document of the shard for the words of ``seed``."""
        terms = self.terms[self.first[seed]:self.first[seed + 1]]
        start, size = self.post[terms], self.post[terms + 1] - self.post[terms]
        at = np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)
        return np.bincount(self.rows[at], self.weights[at], minlength=self.n)


class Packer:
    """Pieces of a stream of documents; ``add`` and ``finish`` return those that are placed."""

    def __init__(self, idf: np.ndarray, mean_length: float, window: int, shard_tokens: int, first_sequence: int):
        self.idf, self.mean, self.window, self.limit = idf, mean_length, window, shard_tokens
        self.sequence = first_sequence
        self.held: list[tuple] = []  # (document, ids, start of the part that is left)
        self.tokens = 0
        self.out: list[tuple] = []

    def _place(self, doc, ids: np.ndarray, start: int, length: int, offset: int) -> None:
        crc = zlib.crc32(ids[start:start + length].astype("<u4").tobytes())
        self.out.append((doc, start, length, crc, len(ids), self.sequence, offset))

    def add(self, doc, ids: np.ndarray) -> list[tuple]:
        start = len(ids) - len(ids) % self.window
        for at in range(0, start, self.window):
            self._place(doc, ids, at, self.window, 0)
            self.sequence += 1
        if start < len(ids):
            self.held.append((doc, ids if start == 0 else ids.copy(), start))
            self.tokens += len(ids) - start
            if self.tokens >= self.limit:
                self._fill()
        return self._taken()

    def _taken(self) -> list[tuple]:
        out, self.out = self.out, []
        return out

    def _fill(self) -> None:
        """Windows from the shard while they can be filled; the rest stays for the next shard."""
        index = Index([ids[start:] for _, ids, start in self.held], self.idf, self.mean)
        left = np.array([len(ids) - start for _, ids, start in self.held])
        total, seed, following = int(left.sum()), -1, 0
        while total >= self.window:
            if seed < 0:
                while not left[following]:
                    following += 1
                seed = following
            used = self._take(left, seed, 0)
            total -= used
            if used < self.window:
                score = index.scores(seed)
                score[left == 0] = -1.0
                for k in _falling(score):
                    take = self._take(left, k, used)
                    used, total = used + take, total - take
                    if used == self.window:
                        seed = int(k) if left[k] else -1
                        break
            else:
                seed = seed if left[seed] else -1
            self.sequence += 1
        self.held = [(doc, ids, len(ids) - n) for (doc, ids, _), n in zip(self.held, left.tolist()) if n]
        self.tokens = total

    def _take(self, left: np.ndarray, k: int, used: int) -> int:
        doc, ids, _ = self.held[k]
        take = min(int(left[k]), self.window - used)
        if take:
            self._place(doc, ids, len(ids) - int(left[k]), take, used)
            left[k] -= take
        return take

    def finish(self) -> list[tuple]:
        """The last windows, and powers of two of what is less than one."""
        if self.held:
            self._fill()
        offset, size = 0, 1 << self.tokens.bit_length() >> 1
        rest = self.tokens
        for doc, ids, start in self.held:
            while start < len(ids):
                take = min(len(ids) - start, size - offset)
                self._place(doc, ids, start, take, offset)
                start, offset, rest = start + take, offset + take, rest - take
                if offset == size:
                    self.sequence += 1
                    offset, size = 0, 1 << rest.bit_length() >> 1
        self.held, self.tokens = [], 0
        return self._taken()


def _falling(score: np.ndarray) -> Iterator[int]:
    """Places by falling score, ties in order; sorted only as far as asked for."""
    n, take = len(score), 64
    done = 0
    while done < n:
        take = min(take, n)
        top = np.argpartition(-score, take - 1)[:take] if take < n else np.arange(n)
        if take < n:  # ties at the edge all belong to it
            top = np.flatnonzero(score >= score[top].min())
        order = top[np.argsort(-score[top], kind="stable")]
        yield from order[done:].tolist()
        done, take = len(order), 4 * max(take, len(order))


# ---------------------------------------------------------------- the operator

def pack(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
         shard_tokens: int = SHARD_TOKENS, partitions: int | None = None) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    spark = docs.sparkSession
    enc = spaced_encoder(tokenizer)
    dtype, vocabulary = enc.dtype, max(enc.bpe.size, end_id + 1)
    ids = written(encoded(docs, tokenizer, end_id, id_col, text_col), "token-ids")
    n, tokens = ids.agg(F.count(F.lit(1)), F.sum("doc_tokens")).first()
    if not n:
        tokens = 0
    seen = frequencies(ids, dtype, vocabulary)
    idf = np.log1p((n - seen + 0.5) / (seen + 0.5))
    mean = tokens / max(n, 1)
    schema = ids.select("doc_id").schema
    for name, kind in (("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("doc_tokens", "long"), ("sequence_id", "long"),
                       ("offset", "long")):
        schema = schema.add(name, kind)
    kinds = [pa.int64()] * 6

    def run(batches):
        packer = Packer(idf, mean, window, shard_tokens, TaskContext.get().partitionId() << 40)

        def rows(pieces):
            columns = list(zip(*pieces))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_kind)] + [pa.array(c, t) for c, t in zip(columns[1:], kinds)],
                                              names=schema.names)
        id_kind = None
        for b in batches:
            id_kind = b.schema.field("doc_id").type
            made = []
            for doc, raw in zip(b.column("doc_id").to_pylist(), b.column("ids")):
                made += packer.add(doc, np.frombuffer(raw.as_buffer(), dtype))
            if made:
                yield rows(made)
        made = packer.finish()
        if made:
            yield rows(made)

    # enough partitions for the cluster, but none below the size of a shard
    width = partitions or max(1, min(shuffle_width(spark), -(-tokens // shard_tokens)))
    # the order is sampled for the ranges: it holds a hash in place of the ids themselves
    order = ["subject", "doc_id", F.xxhash64("ids")]
    ranged = ids.select("doc_id", "ids", "subject").repartitionByRange(width, *order).sortWithinPartitions(*order, "ids")
    return ranged.select("doc_id", "ids").mapInArrow(run, schema)

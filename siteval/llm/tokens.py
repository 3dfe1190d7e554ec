"""Byte-level BPE through the tokenizers library, with a bounded cache of pieces.

The pre-tokenizer of such a vocabulary scans left to right and merges never
cross its pieces, so a text's ids are the ids of its pieces in turn.  Pieces
repeat; the library encodes each new one once.  Texts with characters whose
class could depend on a Unicode version, or with a special token's string, go
to the library whole.
"""

from __future__ import annotations

import gc
import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np

CACHED_PIECES = 1_000_000
WORD_START = np.uint32(1 << 31)  # marks the first id of a piece in flagged ids

_NUMERIC = "\\d²³¹¼½¾"
_PIECE = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[^\W_{_NUMERIC}]+| ?[{_NUMERIC}]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
# the same for texts of one-byte characters, with classes spelled out, which the scanner tests by table
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\\t\\n\\r \xa0"
_NARROW = re.compile(rf" ?[{_L}]+| ?[^{_S}{_L}{_N}']+[^{_S}{_L}{_N}]*|'(?:s|t|re|ve|m|ll|d)| ?[{_N}]+| ?[^{_S}{_L}{_N}]+"
                     rf"|[{_S}]+(?![^{_S}])|[{_S}]+")
_KNOWN = bytes([9, 10, 13, *range(0x20, 0x7f), *range(0xa0, 0x100)])
_UNSURE = re.compile("[^\t\n\r\x20-\x7e -ɏ‐-⁞€]")


class Bpe:
    """One tokenizer per Python process."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.splits = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                       and not pre.get("add_prefix_space") and not spec.get("normalizer")
                       and not spec.get("post_processor"))
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        # a piece or special string that a cut has split is seen again this far before the cut
        self.margin = 4 + max([0, *map(len, self.special)])
        self.size = self.tok.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self._cache: dict[str, bytes] = {}

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each whole text as packed little-endian numbers of ``dtype``."""
        pieces = [self._pieces(x) for x in texts]
        new: set[str] = set()
        for p in pieces:
            if p:
                new.update(p)
        cache = self._cache
        new = [p for p in new if p not in cache]
        was = gc.isenabled()
        gc.disable()  # encodings hold no cycles
        try:
            for k, e in zip(new, self.tok.encode_batch_fast(new, add_special_tokens=False)):
                cache[k] = array(self.code, e.ids).tobytes()
            whole = [x for x, p in zip(texts, pieces) if p is None]
            rest = iter([array(self.code, e.ids).tobytes()
                         for e in self.tok.encode_batch_fast(whole, add_special_tokens=False)])
        finally:
            if was:
                gc.enable()
        known = cache.__getitem__
        out = [next(rest) if p is None else b"".join(map(known, p)) for p in pieces]
        for k in new[:max(0, len(cache) - CACHED_PIECES)]:
            del cache[k]
        return out

    def _pieces(self, text: str) -> list[str] | None:
        """The text's pieces, or None where the library has to look at the whole."""
        if not self.splits or any(s in text for s in self.special):
            return None
        try:
            narrow = not text.encode("latin-1").translate(None, _KNOWN)
        except UnicodeEncodeError:
            narrow = False
        if narrow:
            return _NARROW.findall(text)
        return None if _UNSURE.search(text) else _PIECE.findall(text)

    def flagged(self, text: str) -> np.ndarray:
        """Ids of a text as uint32; the first id of each piece has ``WORD_START``."""
        e = self.tok.encode(text, add_special_tokens=False)
        ids = np.array(e.ids, dtype=np.uint32)
        words = np.array([-1 if w is None else w for w in e.word_ids], dtype=np.int64)
        if len(ids):
            first = np.ones(len(ids), dtype=bool)
            first[1:] = words[1:] != words[:-1]
            ids[first] |= WORD_START
        return ids

    def starts(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """Code point offset of each piece, ids before it, and the number of ids."""
        e = self.tok.encode(text, add_special_tokens=False)
        words = np.array([-1 if w is None else w for w in e.word_ids], dtype=np.int64)
        if not len(words):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        first = np.ones(len(words), dtype=bool)
        first[1:] = words[1:] != words[:-1]
        at = np.flatnonzero(first)
        offsets = e.offsets
        return np.array([offsets[i][0] for i in at], dtype=np.int64), at.astype(np.int64), len(words)

    @lru_cache(maxsize=1)  # noqa: B019  one per process
    def byte_lengths(self) -> np.ndarray:
        """Bytes that each id stands for."""
        out = np.zeros(self.size, dtype=np.int64)
        for token, i in self.tok.get_vocab(with_added_tokens=True).items():
            out[i] = len(token)  # one letter of the byte alphabet per byte
        for s in self.special:
            out[self.tok.token_to_id(s)] = len(s.encode())
        return out


@lru_cache(maxsize=4)
def bpe(path: str) -> Bpe:
    return Bpe(path)

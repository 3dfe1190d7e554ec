"""Counts, codec and files of tokens against the library on whole texts."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from siteval.llm import bpe_codec, token_counts, token_files
from siteval.llm.bpe_codec import concatenate
from siteval.llm.tokens import WORD_START, bpe

PARTS = [" the", " aaaa" * 3, "a" * 150, "bc" * 70, "  \n", " 12345678901234567" * 2, "don't've", "!!''''re", "<|endoftext|>",
         "éçàü" * 50, "日本語" * 20, " x y", "\t\t \n x", "🎉🎉"]


@pytest.fixture(scope="module")
def library(tokenizer):
    return Tokenizer.from_file(tokenizer)


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def mixed(rng, n):
    out = ""
    while len(out) < n:
        out += rng.choice(PARTS)[:rng.randrange(1, 200)]
    return out


def test_encoding_by_pieces_equals_the_library(tokenizer, library):
    enc, rng = bpe(tokenizer), random.Random(3)
    texts = [mixed(rng, n) for n in (1, 10, 100, 1000) for _ in range(10)]
    assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode_texts(texts)] == [ids(library, t) for t in texts]


def test_joins_at_any_cut_equal_the_library(tokenizer, library):
    enc, rng = bpe(tokenizer), random.Random(4)
    for k in range(120):
        text = mixed(rng, rng.choice([40, 400, 2500])) if k % 6 else rng.choice(["ab", "é", "qwertyuiop"]) * 900
        cut = rng.randrange(1, len(text))
        got = concatenate(enc, text[:cut].encode(), enc.flagged(text[:cut]), text[cut:].encode(), enc.flagged(text[cut:]),
                          window=rng.choice([1, 16, 128]))
        assert (got & ~WORD_START).tolist() == ids(library, text)


@pytest.mark.parametrize("chunk,overlap", [(65_536, 2_048), (120, 40)])
def test_counts(documents, tokenizer, library, chunk, overlap):
    rows = documents.select("doc_id", "text").collect()
    got = token_counts.token_counts(documents, tokenizer, chunk=chunk, overlap=overlap).collect()
    want = [(r.doc_id, len((r.text or "").encode()), len(ids(library, r.text))) for r in rows]
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == Counter(want)
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)


@pytest.mark.parametrize("leaf", [65_536, 100])
def test_codec(documents, tokenizer, library, leaf):
    rows = documents.select("doc_id", "text").collect()
    got = bpe_codec.encode_decode(documents, tokenizer, leaf=leaf, window=8, with_ids=True).collect()
    want = Counter()
    for r in rows:
        i = ids(library, r.text)
        want[(r.doc_id, len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(),
              hashlib.sha256((r.text or "").encode()).hexdigest(), tuple(i))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in got) == want


def test_files(documents, tokenizer, library, spark, folder, monkeypatch):
    monkeypatch.setattr(token_files, "BATCH_ROWS", 4)
    files = token_files.write(documents, folder, tokenizer, end_id=2, sequence_length=16, files=3)
    got = token_files.read_documents(spark, files).collect()
    order = sorted(documents.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    start, want = 0, Counter()
    for r in order:
        i = ids(library, r.text) + [2]
        want[(r.doc_id, start, len(i), zlib.crc32(np.array(i, "<u4").tobytes()))] += 1
        start += len(i)
    assert Counter(tuple(r) for r in got) == want


def test_sequences_are_views_of_equal_length(documents, tokenizer, folder):
    (one,) = token_files.write(documents.where("doc_id = 6"), folder, tokenizer, end_id=2, sequence_length=8, files=1)
    f = token_files.TokenFile(one["path"])
    rows = [f.sequence(k) for k in range(-(-one["n_tokens"] // 8))]
    assert all(len(i) == len(m) == 8 for i, m in rows) and not rows[0][0].flags.owndata
    assert sum(int(m.sum()) for _, m in rows) == one["n_tokens"]


def test_empty_tables(nothing, tokenizer, spark, folder):
    assert token_counts.token_counts(nothing, tokenizer).count() == 0
    assert bpe_codec.encode_decode(nothing, tokenizer).count() == 0
    files = token_files.write(nothing, folder, tokenizer, 2)
    assert files == [] and token_files.read_documents(spark, files).count() == 0

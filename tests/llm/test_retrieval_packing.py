"""Packing: every id once, windows full, neighbours by BM25, ids as the library gives them."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from siteval.llm import retrieval_packing as P

END = 2


@pytest.fixture(scope="module")
def words_path():
    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library(words_path):
    return Tokenizer.from_file(words_path)


def test_encoder_equals_the_library(documents, words_path, library):
    texts = [r["text"] or "" for r in documents.select("text").collect()]
    texts += ["É éa İSTANBUL ΣΊΣΥΦΟΣ ß", "a\x1cb\x1dc", "x\x85y\xa0z w　v​u᠎t", "don't 'tis IT'S 12ab3 --'s",
              "<|ENDOFTEXT|> <|endoftext|>", "́ lone mark", "a\x00b", "東京 2024年", "  ", "w" * 500]
    rng = random.Random(3)
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x250), rng.randrange(9, 14), 32, 0x301, 0x3a3]))
                      for _ in range(200)) for _ in range(60)]
    texts += ["".join(rng.choice("ab1'sSÉéßµ²½ªº×÷\xad\x00\x7f\x80|<>_-.ÿÀ ") for _ in range(150)) for _ in range(120)]
    texts += [f"a{chr(i)}b {chr(i)} {chr(i)}x" for i in range(0x250)]
    want = [library.encode(x, add_special_tokens=False).ids for x in texts]
    enc = P.spaced_encoder(words_path)
    assert enc.splits and enc.model is not None
    for _ in range(2):  # the second time from the cache
        assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts)] == want


def check(rows, docs, library, window):
    """``docs``: (id, text) pairs; the pieces hold every id of each once."""
    ids = [np.array(library.encode(t or "", add_special_tokens=False).ids + [END], dtype="<u4") for _, t in docs]
    wanted, got = defaultdict(list), defaultdict(list)
    for (doc, _), x in zip(docs, ids):
        wanted[doc].append(x)
    for r in rows:
        got[r["doc_id"]].append(r)
    assert set(got) == set(wanted)
    for doc, texts in wanted.items():
        if len(texts) == 1:
            at = 0
            for r in sorted(got[doc], key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(texts[0]) and r["length"] > 0
                assert r["ids_crc32"] == zlib.crc32(texts[0][at:at + r["length"]].tobytes())
                at += r["length"]
            assert at == len(texts[0])
        else:
            assert sum(r["length"] for r in got[doc]) == sum(map(len, texts))
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    sizes = []
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
        sizes.append(at)
    assert all(n & (n - 1) == 0 for n in sizes)  # no sequence needs padding
    return sizes


@pytest.mark.parametrize("window,shard,partitions", [(4096, 1 << 18, None), (64, 1000, 3), (16, 50, 1)])
def test_pieces(spark, documents, words_path, library, window, shard, partitions):
    rng = random.Random(5)
    topics = [[f"{t}word{i}" for i in range(30)] for t in ("alpha", "beta", "gamma")]
    extra = [(1000 + i, " ".join(rng.choices(topics[i % 3], k=rng.randrange(1, 60)))) for i in range(90)]
    extra += [(2000 + i, "the very same words over and over") for i in range(60)]
    df = documents.select("doc_id", "text", "_id", "size").unionByName(
        spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    docs = [(r["doc_id"], r["text"]) for r in df.collect()]
    rows = P.pack(df, words_path, END, window=window, shard_tokens=shard, partitions=partitions).collect()
    sizes = check(rows, docs, library, window)
    tails = [n for n in sizes if n < window]
    assert len(tails) <= (partitions or 4) * window.bit_length()


def test_empty_table(nothing, words_path):
    out = P.pack(nothing, words_path, END)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.count() == 0


def test_index_against_plain_bm25():
    rng = np.random.default_rng(2)
    documents = [rng.integers(0, 40, size=rng.integers(1, 30)) for _ in range(25)]
    seen = np.bincount(np.concatenate([np.unique(d) for d in documents]), minlength=40)
    idf = np.log1p((25 - seen + 0.5) / (seen + 0.5))
    mean = np.mean([len(d) for d in documents])
    index = P.Index(documents, idf, mean)
    for seed in range(25):
        for k, score in enumerate(index.scores(seed)):
            want = 0.0
            for t in set(documents[seed].tolist()):
                tf = int((documents[k] == t).sum())
                want += idf[t] * tf * (P.K1 + 1) / (tf + P.K1 * (1 - P.B + P.B * len(documents[k]) / mean))
            assert score == pytest.approx(want)


def test_neighbours_share_words():
    """Two interleaved subjects: windows hold one each."""
    rng = np.random.default_rng(6)
    packer = P.Packer(np.ones(400), 20.0, 100, 4000, 0)
    rows = []
    for i in range(200):
        rows += packer.add(i, rng.integers(200 * (i % 2), 200 * (i % 2) + 200, size=20))
    rows += packer.finish()
    mixed = defaultdict(set)
    for doc, _, _, _, _, sequence, _ in rows:
        mixed[sequence].add(doc % 2)
    assert sum(len(s) == 2 for s in mixed.values()) <= 2


def test_falling_is_the_full_order():
    rng = np.random.default_rng(1)
    for n in (1, 5, 64, 65, 700):
        score = rng.integers(0, 9, size=n).astype(float)
        assert list(P._falling(score)) == np.argsort(-score, kind="stable").tolist()

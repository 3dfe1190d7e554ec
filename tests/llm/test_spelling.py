"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from siteval.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans(spelling.UPPER, spelling.LOWER)


def vocabulary(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= 5:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 3}


def near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def brute(rows):
    words = vocabulary(rows)
    form, out = {}, []
    for w, n in words.items():
        found = sorted((-words[v], v) for v in words if v != w and abs(len(v) - len(w)) < 2 and near(v, w))
        form[w] = found[0][1] if found and -found[0][0] >= 2 * n else None
        out.append((w, n, len(found)))
    rows = []
    for w, n, k in out:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n, k, words.get(form[w])))
    return sorted(rows, key=lambda r: r[0])


def noisy_rows():
    rng = random.Random(4)
    base = ["garden", "gardens", "Straße", "château", "château", "ÉCOLE", "mississippi", "aaaaa", "letter", "better", "x" * 300]
    rows = []
    for i in range(160):
        words = []
        for _ in range(40):
            w = rng.choice(base)
            if rng.random() < 0.4:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", rng.choice("aeiouté÷"), w[at] + rng.choice("st")]) + w[at + 1:]
            words.append(w)
        rows.append((i, rng.choice([" ", ", ", "1"]).join(words)))
    rows += [(2000 + i, f"wordaaa wordaaa wordaaa {'wordaab ' * (i % 2)} {'wordabb ' * (i % 5 == 0)}") for i in range(30)]
    return rows + [(None, "garden garden gardem"), (None, None), (1000, None), (1001, ""), (5, "letter"), (5, "letter"),
                   (1002, "gardem " * 3 + "日本語 tokyo" * 4 + "\x00naïve\x00" * 5 + "🎉party" * 4)]


def test_variants(spark):
    rows = noisy_rows()
    df = spark.createDataFrame([(*r, "x", 2) for r in rows], "doc_id long, text string, word string, n int").repartition(5)
    want = brute(rows)
    assert any(r[1] and r[2] != r[1] for r in want)  # forms of forms
    for size in (spelling.FILTER_BYTES, 200):  # one pass, and many
        got = sorted((tuple(r) for r in spelling.variants(df, filter_bytes=size).collect()), key=lambda r: r[0])
        assert got == want


def test_no_words(spark):
    for rows in ([], [(1, None), (2, "a b c 1 2 3"), (3, "seldom")]):
        assert spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0


def test_hashes_of_edits():
    words = ["abcde", "aabbz", "ezzzz"]
    codes, alphabet = spelling._letters(words), np.frombuffer(b"abcdez", np.uint8)
    seen = set()
    for row, place, letter, h, size in spelling.edits(codes, alphabet):
        for r, p, c, x in zip(row, place, letter, h):
            w = words[r]
            new = w[:p] + (chr(c) if c >= 0 else "") + w[p + 1:]
            assert len(new) == size and spelling.word_hashes(spelling._letters([new]))[0] == x
            assert (w, new) not in seen
            seen.add((w, new))
    assert ("aabbz", "abbz") in seen and ("abcde", "abzde") in seen


def test_ties_take_the_least(spark):
    text = " ".join(["aaaab"] * 8 + ["aaaac"] * 8 + ["aaaad"] * 4 + ["aaaae"] * 3)
    doc = next(i for i in range(100) if len(vocabulary([(i, text)])) == 4)
    got = {r["word"]: r for r in spelling.variants(spark.createDataFrame([(doc, text)], "doc_id long, text string")).collect()}
    assert got["aaaad"]["form"] == "aaaab" and got["aaaad"]["form_n"] == 8 and got["aaaad"]["n_near"] == 3
    assert got["aaaab"]["form"] is None and got["aaaab"]["root"] == "aaaab"

"""Near-dedup, Jaccard classes, components, mixing and the pipeline against brute force."""

import random
import re
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siteval.llm import mixing, near_dup, ngram_join
from siteval.llm.components import components
from siteval.llm.queries import ORACLES
from tools.check_oracles import compare

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def classes(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)]
    links += [(0, i) for i in range(2000, 2100)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = classes({x for ab in links for x in ab}, links)
    assert got == {n: c for n, c in want.items() if any(n in ab and ab[0] != ab[1] for ab in links)}


# ---------------------------------------------------------------- vectors

def test_near_duplicates(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 10))
    vectors = [(b + rng.normal(size=10) * rng.choice([0.01, 0.1, 0.2, 0.3])).tolist() for b in base for _ in range(8)]
    rows = [(i, v, i % 2) for i, v in enumerate(vectors)] + [(200 + i, vectors[0], 0) for i in range(30)]
    rows += [(300, None, 0), (301, [0.0] * 10, 0), (302, [1.0, None] * 5, 0), (303, [float("nan")] * 10, 0), (304, [], 0),
             (305, vectors[0], None), (306, [float("inf")] * 10, 0), (307, [1e300] * 10, 1), (308, [1e-300] * 10, 1), (309, [1.0, 2.0], 1),
             (310, [2.0, 4.0], 1), (311, [3.0], 1), (None, [5.0, -1.0], 1), (312, [-0.0, 1.0], 1), (313, [0.0, 1.0], 1)]
    rows = [(*r, "x") for r in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, id string")
    got = {r.vec_id: r for r in near_dup.near_duplicates(df, tile_rows=7).collect()}
    ok = {i: np.array(v) / np.abs(v).max() for i, v, label, _ in rows if i is not None and v and label is not None
          and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    label = {r[0]: r[2] for r in rows}
    links = [(a, b) for a, b in combinations(sorted(ok), 2) if label[a] == label[b] and len(ok[a]) == len(ok[b])
             and ok[a] @ ok[b] / np.sqrt((ok[a] @ ok[a]) * (ok[b] @ ok[b])) >= 0.98]
    degree, want = Counter(x for ab in links for x in ab), classes([r[0] for r in rows if r[0] is not None], links)
    assert len(got) == len(rows) and len(links) > 450
    for i, c in want.items():
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (degree[i], c, i == c)
    assert got[None].n_links == 0
    assert near_dup.near_duplicates(df.where("false")).count() == 0


def test_tiles_drop_no_link():
    rng = np.random.default_rng(3)
    x = near_dup.unit_rows(rng.normal(size=(60, 1, 20)).repeat(3, axis=1).reshape(-1, 20) + rng.normal(size=(180, 20)) * 0.15)
    i, j = near_dup.compare_tiles(x, x, 0.98, step=3)
    want = set(zip(*np.nonzero(x @ x.T >= 0.98)))
    assert want <= set(zip(i.tolist(), j.tolist())) and len(i) < 2 * len(want)


# ---------------------------------------------------------------- shingles

def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.fixture(scope="module")
def copies(spark):
    """Groups of near copies, chains of edits, and passages that many share."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(500)] + ["É", "ß", "İ", "Ω"]
    passage = " ".join(rng.choices(words, k=60))
    texts = [None, "", " \t\n", "one", "One", "one two three", "a b c d e", "A B\tC D\x0bE", "a b c d e f"]
    for _ in range(25):
        base = rng.choices(words, k=rng.choice([8, 30, 120, 400]))
        texts.append(" ".join(base))
        for _ in range(rng.randrange(6)):
            for _ in range(max(1, len(base) // rng.choice([20, 40, 80]))):
                base[rng.randrange(len(base))] = rng.choice(words)
            texts.append(" ".join(base))
    texts += [passage + " " + " ".join(rng.choices(words, k=k)) for k in range(0, 40, 2)] + [passage.upper()] * 3
    rows = [(i, t, "s", 0, i, 0.0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, sig long, _id double")


@pytest.mark.parametrize("hot_floor, rounds, tile", [(32, 2, 1024), (0, 0, 3)])
def test_jaccard_classes(copies, monkeypatch, hot_floor, rounds, tile):
    monkeypatch.setattr(ngram_join, "HOT_FLOOR", hot_floor)
    monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
    monkeypatch.setattr(ngram_join, "TILE", tile)
    rows = copies.collect()
    sets = {r.doc_id: shingles(r.text) for r in rows}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = classes(sets, links)
    got = ngram_join.jaccard_classes(copies).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(s), want[i]) for i, s in sets.items()}
    kept = ngram_join.one_per_class(copies)
    assert kept.columns == copies.columns and {r.doc_id for r in kept.collect()} == set(want.values())


def test_a_hub_and_its_stragglers_make_no_row_per_pair(spark, monkeypatch):
    rng = random.Random(11)
    base = [f"w{i}" for i in range(300)]

    def edited(times):
        words = list(base)
        for at in rng.sample(range(300), times):
            words[at] = f"x{rng.random()}"
        return " ".join(words)
    # most copies link with the whole text, the stragglers mostly with none of them
    rows = [(0, " ".join(base))] + [(i, edited(rng.choice([2, 5, 8]) if i < 150 else rng.choice([12, 14, 16]))) for i in range(1, 250)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: shingles(t) for i, t in rows}
    want = classes(sets, [(a, b) for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    made, plain = {}, ngram_join.written

    def counted(df, name):
        out = plain(df, name)
        made[name] = max(made.get(name, 0), out.count())
        return out
    monkeypatch.setattr(ngram_join, "written", counted)
    got = ngram_join.jaccard_classes(docs).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    # rows of points in cells, as the input; not points times regions
    assert made["boundary-points"] <= made["regions"] and "boundary-distances" not in made, made


def test_jaccard_ids(spark, documents, nothing):
    got = ngram_join.jaccard_classes(documents).collect()
    assert len(got) == documents.count() and sum(r.doc_id is None for r in got) == 1
    assert {r.doc_id: r.component_id for r in got}[5] == 4
    assert ngram_join.one_per_class(documents).where("doc_id is null").count() == 1
    assert ngram_join.jaccard_classes(nothing).count() == 0


def test_first_shingles_hold_what_neighbours_share():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 200))
        x = np.unique(rng.integers(-2**62, 2**62, n))
        y = np.unique(np.concatenate([rng.permutation(x)[:max(1, int(n * rng.uniform(0.7, 1)))], rng.integers(-2**62, 2**62, int(n * 0.1))]))
        both = len(np.intersect1d(x, y))
        if 100 * both >= 75 * (len(x) + len(y) - both):
            hot = rng.random(1 << ngram_join.BUCKET_BITS) < rng.choice([0, 0.5])
            shared = np.intersect1d(*(ngram_join.first_shingles(s, hot) for s in (x, y)))
            assert len(shared) >= ngram_join.must_share(min(len(x), len(y)))
            assert ngram_join.least_difference(ngram_join.parity_bits(x), ngram_join.parity_bits(y)) <= len(np.setxor1d(x, y))


def test_tiles_let_every_pair_within_reach_through():
    rng = np.random.default_rng(6)
    sets = []
    for _ in range(12):
        base = rng.integers(-2**62, 2**62, int(rng.choice([3, 40, 200])))
        sets += [np.unique(np.concatenate([base[:int(len(base) * rng.uniform(0.8, 1)) or 1], rng.integers(-2**62, 2**62, 6)]))
                 for _ in range(5)]
    tile = pd.DataFrame({"region": range(60), "label": rng.integers(0, 20, 60), "radius": rng.choice([0.0, 0.0, 0.2], 60),
                         "part": rng.integers(0, 2, 60), "n": [len(s) for s in sets],
                         "bits": [ngram_join.parity_bits(s) for s in sets]})
    columns = {c: tile[c].to_numpy() for c in tile.columns}
    for across in (False, True):
        got = {(a, b) for x in ngram_join.close_pairs(columns, 0.25, across) for a, b in zip(x[0].tolist(), x[1].tolist())}
        want = set()
        for a, b in combinations(range(60), 2):
            both = len(np.intersect1d(sets[a], sets[b]))
            reach = tile["radius"][a] + tile["radius"][b] + 0.25
            if (1 - both / (len(sets[a]) + len(sets[b]) - both) <= reach and tile["label"][a] != tile["label"][b]
                    and (not across or tile["part"][a] != tile["part"][b])):
                want.add((a, b))
        assert len(want) > 20 and want <= got and len(got) < 3 * len(want)


# ---------------------------------------------------------------- mixing

def targets(sizes, weights=(1, 2, 3), repeats=3):
    """Shares by weight, capped, the excess dealt again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, out = set(), {}
    while True:
        rest = sum(sizes.values()) - sum(repeats * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        out = {s: repeats * sizes[s] for s in full} | {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if out[s] >= repeats * sizes[s]}
        if not over:
            return out
        full |= over


def test_mix(spark, documents, nothing):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 90)), rng.choice(["a"] * 30 + ["b", "c", "d", "é", None])) for i in range(900)]
    rows += [(901, None, "e"), (902, " ", "e"), (None, "x y z", "a"), (950, "x y z", "a"), (950, "x y z", "a")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, rank long, block long")
    got = mixing.mix(docs, block=16).collect()
    size = Counter()
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    want = targets(size)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len(WORD.findall(t or ""))) for i, t, _ in rows)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    taken, named = Counter(), {}
    ids = {i: s for i, _, s in rows}
    for r in got:
        named[ids[r.doc_id]] = r.target
        taken[ids[r.doc_id]] += r.taken
    assert named.keys() == want.keys() and all(abs(named[s] - want[s]) < 1e-6 for s in want)
    assert all(want[s] - 1 <= taken[s] <= want[s] + 1e-6 for s in want)
    again = mixing.mix(docs.repartition(7), block=16).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert mixing.mix(documents).count() == documents.count()
    assert mixing.mix(nothing).count() == mixing.mixed_documents(nothing).count() == 0


def test_every_stretch_of_the_schedule_is_close_to_the_mix(spark):
    sources = spark.createDataFrame([(1, 6000.0), (2, 3000.0), (3, 1000.0)], "rank int, target double").selectExpr(
        "*", "string(rank) source", "1L rows", "99999L source_size")
    slots = [r["rank"] for r in mixing.schedule(sources, 10).orderBy("slot").collect()]
    assert Counter(slots) == {1: 600, 2: 300, 3: 100}
    for at in range(0, 900, 100):
        part = Counter(slots[at:at + 100])
        assert abs(part[1] - 60) <= 3 and abs(part[2] - 30) <= 3 and abs(part[3] - 10) <= 3


def test_tiny_sources_beside_a_huge_one_get_their_slots(spark):
    """Targets of less than a block, of a few blocks and of none beside a huge one."""
    targets = [1e7, 2e7, 3e7, 100.0, 250.0, 1000.0, 2500.0, 10000.0, 0.4, 0.0]
    sources = spark.createDataFrame(list(enumerate(targets, 1)), "rank int, target double")
    got = mixing.schedule(sources).groupBy("rank").agg(
        F.count("*").alias("n"), F.min("block").alias("least"), F.max("block").alias("most"), F.countDistinct("block").alias("blocks"))
    want = {(k, n, 0, n - 1, n) for k, t in enumerate(targets, 1) if (n := -(-int(t) // mixing.BLOCK))}
    assert set(map(tuple, got.collect())) == want
    small = mixing.schedule(sources.where("rank > 3"))
    assert small.select("slot").distinct().count() == small.count()


def test_mix_of_tiny_sources_equals_the_oracle(spark):
    rng = random.Random(8)
    rows = [(i, "w " * 50_000, "big") for i in range(40)]
    rows += [(100 * k + j, "w " * rng.randrange(1, 60), f"tiny{k:02}") for k in range(1, 41) for j in range(rng.randrange(1, 5))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    assert compare(mixing.mix(docs), con, ORACLES["op9_mix_sources"]) == ""


# ---------------------------------------------------------------- pipeline

def test_pipeline_stages(spark, folder):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(200):
        text = " ".join(rng.choices(words, k=rng.randrange(30, 120))) + "."
        if i % 5 == 0:
            text = " ".join(w + "$$$" for w in text.split())
        if i % 7 == 3:
            text += " password=abcdefghijklmnop"
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, int(i % 5 != 0), 0))
    rows += [(1000 + i, rows[i][1], "en", "s0", rows[i][4]) for i in range(1, 60)] + [(2000, None, None, None, None), (2001, "", "en", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs.write.parquet(f"{folder}/documents.parquet")
    good = corpus_pipeline.good_documents(spark, docs, folder)
    assert {r.doc_id for r in good.collect()} - {2000, 2001} == {r[0] for r in rows[:-2] if "$$$" not in r[1]}
    one = corpus_pipeline.distinct_documents(spark, good, folder)
    assert {r.doc_id for r in one.collect()} - {2000, 2001} == {r[0] for r in rows[:200] if "$$$" not in r[1]}
    clean = corpus_pipeline.without_secrets(spark, one, folder).collect()
    assert not any("password=" in (r.text or "") for r in clean)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in clean)
    last = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"} == set(last.columns)
    assert {r.doc_id for r in last.collect()} <= {r.doc_id for r in clean} and last.count() > 100
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0

"""Readers and sinks: round trips, declared schemas, refusals."""

import bz2
import json

import pytest
from pyspark.sql import functions as F

from siteval.operators import integrity as I
from siteval.operators.suffixes import read_psl
from siteval.sources import normalize as N
from siteval.sources import readers as R
from siteval.sources import sinks as S


def write(path, text, mode="w"):
    with open(path, mode, **({} if "b" in mode else {"encoding": "utf-8"})) as f:
        f.write(text)
    return path


def test_feed_bz2(spark, folder):
    head = "phish_id,url,phish_detail_url,submission_time,verification_time,verified,online,target\n"
    body = head.encode() + b'1,"http://a.com/x,y",d,2026-01-01T00:00:00+00:00,t,yes,yes,Bank\n2,http://b\xff.com,d,t,t,yes,yes,\n'
    write(folder + "/feed.csv.bz2", bz2.compress(body), "wb")
    rows = R.read_csv(spark, folder + "/feed.csv.bz2", R.FEED_SCHEMA, ["phish_id", "url"]).orderBy("phish_id").collect()
    assert rows[0]["url"] == "http://a.com/x,y" and rows[1]["url"] == "http://b�.com"


def test_header_mismatch_fails(spark, folder):
    write(folder + "/x.csv", "WRONG,ClassLabel\nu,0.0\n")
    with pytest.raises(Exception):
        R.read_csv(spark, folder + "/x.csv", R.LEGACY_SCHEMA).collect()


def test_ranked_list(spark, folder):
    write(folder + "/r.csv", "1,A.com \n2,b.com\n3,c.com\n")
    assert [tuple(r) for r in R.read_ranked_list(spark, folder + "/r.csv", 1, 2).collect()] == [(1, "a.com"), (2, "b.com")]


def test_jsonl_and_crawl_index(spark, folder):
    write(folder + "/c.jsonl", '{"combined_row_id":"r1","raw_url":"http://a","label":"benign"}\n')
    assert R.read_corpus_jsonl(spark, folder + "/c.jsonl").first()["label"] == "benign"
    line = {"url": "http://a", "urlkey": "k", "timestamp": "2026", "status": "200", "mime": "text/html", "mime-detected": "text/html",
            "digest": "d", "recordid": "rid", "filename": "f", "offset": "1", "length": "2", "site_frame_id": "tfv1:000001",
            "tranco_rank": 5, "tranco_domain": "a.com"}
    write(folder + "/i.jsonl", json.dumps(line) + "\n")
    r = R.read_crawl_index(spark, folder + "/i.jsonl", "CC-1").first()
    assert (r["mime_detected"], r["warc_filename"], r["record_id"], r["crawl_id"], r["tranco_rank"]) == ("text/html", "f", "rid", "CC-1", 5)


def test_psl_file(spark, folder):
    write(folder + "/psl.dat", "// c\ncom\n*.ck\n!www.ck\n\n// ===BEGIN PRIVATE DOMAINS===\nGitHub.io\n")
    got = {tuple(r) for r in read_psl(spark, folder + "/psl.dat").collect()}
    assert got == {("com", "exact", "icann"), ("ck", "wildcard", "icann"), ("www.ck", "exception", "icann"), ("github.io", "exact", "private")}


def test_sinks_refuse_to_overwrite(spark, folder):
    df = spark.createDataFrame([("s1", 1), ("s2", 2)], "site_frame_id string, v int")
    S.write_table(df, folder + "/t")
    assert spark.read.option("header", True).csv(folder + "/t").count() == 2
    S.write_chunks(df, folder + "/chunks")
    assert spark.read.json(folder + "/chunks").count() == 2
    S.write_summary(df, folder + "/s")
    assert {json.loads(r[0])["v"] for r in spark.read.text(folder + "/s").collect()} == {1, 2}
    S.write_replicates(df.withColumnRenamed("site_frame_id", "experiment_id"), folder + "/r")
    for again in (lambda: S.write_table(df, folder + "/t"), lambda: S.write_chunks(df, folder + "/chunks"),
                  lambda: S.write_summary(df, folder + "/s")):
        with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
            again()


def test_chunks_of_ordinary_and_large_sites(spark, folder, monkeypatch):
    import glob
    monkeypatch.setattr(S, "CHUNK_ROWS", 40, raising=False)
    site = F.when(F.col("id") < 200, "hot").when(F.col("id") < 230, F.lit(None)).otherwise(F.concat(F.lit("s"), F.col("id") % 7))
    df = spark.range(300).select(site.alias("site_frame_id"), F.col("id").alias("v"))
    name = "spark.sql.adaptive.coalescePartitions.enabled"  # would make one task of so few rows
    was = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        S.write_chunks(df, folder + "/chunks")
    finally:
        spark.conf.set(name, was)
    files = {}
    for f in glob.glob(folder + "/chunks/*/*.json"):
        files.setdefault(f.split("=")[1].split("/")[0], []).append(f)
    assert len(files) == 9 and 2 <= len(files.pop("hot")) <= 5
    assert {len(x) for x in files.values()} == {1}
    got = spark.read.schema("v long, site_frame_id string").json(folder + "/chunks")
    assert sorted(map(tuple, got.select("v", "site_frame_id").collect())) == sorted((r["v"], r["site_frame_id"]) for r in df.collect())


def test_digest_registered_and_provenance(spark, folder):
    import os
    os.mkdir(folder + "/in")
    write(folder + "/in/a.csv", "id,v\n1,x\n2,y\n")
    write(folder + "/in/b.csv", "id,v\n3,z\n")
    d = R.digest_files(spark, folder + "/in")
    reg = d.select("path", F.when(F.col("path").endswith("a.csv"), "A").otherwise("B").alias("experiment_id"), "sha256",
                   F.when(F.col("path").endswith("a.csv"), 2).otherwise(1).cast("long").alias("rows"))
    got = {(r["id"], r["experiment_id"]) for r in R.load_registered(spark, reg, "id int, v string").collect()}
    assert got == {(1, "A"), (2, "A"), (3, "B")}
    with pytest.raises(RuntimeError, match="hash"):
        R.load_registered(spark, reg.withColumn("sha256", F.lit("0")), "id int, v string")
    with pytest.raises(RuntimeError, match="rows"):
        R.load_registered(spark, reg.withColumn("rows", F.lit(9).cast("long")), "id int, v string")
    v = I.verify_hashes(d, d.select("path", F.when(F.col("path").endswith("a.csv"), "0").otherwise(F.col("sha256")).alias("sha256")))
    assert sorted(r["status"] for r in v.collect()) == ["FAIL", "PASS"]
    assert {r["status"] for r in I.table_hashes(v).collect()} == {"VERIFIED", "MISMATCH"}
    links = d.select(F.col("path").alias("output"), F.col("path").alias("source"))
    assert I.provenance(d, d, links).where("output_sha256 = source_sha256").count() == 2


def test_contract(spark, folder):
    write(folder + "/c.json", '{\n "M1": {"C": [0.1, 1.0]},\n "decision_threshold": 0.5\n}')
    r = R.load_contract(spark, folder + "/c.json", "M1 struct<C: array<double>>, decision_threshold double").first()
    assert list(r["M1"]["C"]) == [0.1, 1.0]


def test_start_at_rejects_malformed_ids(spark):
    df = spark.createDataFrame([("tfv1:000001",), ("tfv1:000007",)], "id string")
    assert [r[0] for r in N.start_at(df, "id", "tfv1:000005").collect()] == ["tfv1:000007"]
    with pytest.raises(Exception, match="malformed"):
        N.start_at(spark.createDataFrame([("bad",)], "id string"), "id", "tfv1:000005").collect()


def test_fingerprint_ignores_order(spark):
    df = spark.range(500).withColumn("v", F.col("id") * 2)
    a = I.fingerprint(df.repartition(1), "id", ["v"]).first()
    b = I.fingerprint(df.orderBy(F.desc("id")).repartition(9), "id", ["v"]).first()
    c = I.fingerprint(df.withColumn("v", F.when(F.col("id") == 3, 0).otherwise(F.col("v"))), "id", ["v"]).first()
    assert a == b and a["fingerprint"] != c["fingerprint"]


def test_registry_and_tables(spark):
    seeds = spark.createDataFrame([("A", "M1", .613, .011), ("C", "M1", .585, .056)], "regime string, model string, mean double, sample_sd double")
    gaps = spark.createDataFrame([("M1", .0948, -.039, .235)], "model string, difference double, lower double, upper double")
    r = I.table_mcc(seeds, gaps).first()
    assert (r["A_mcc"], r["interval"]) == ("0.613 ± 0.011", "[-0.039, 0.235]")
    ex = spark.createDataFrame([("full", "A", "0", 99.71), ("full", "C", "1", 0.0)], "variant string, regime string, class string, site_seen_pct double")
    assert I.table_exposure(ex, "regime").first()["A_negative"] == "99.7"
    reg = I.registry([seeds.withColumn("phase", F.lit("x"))], ["phase", "regime", "split_sha256"])
    assert reg.columns == ["phase", "regime", "split_sha256"] and reg.first()["split_sha256"] is None
    assert I.table_fixed(seeds, ["regime"], ["mean"]).first()["mean"] == "0.613"


def test_audited_corpus_is_narrow_and_profiled_in_one_exchange(spark):
    """The audit of a corpus reads compressed files of its own columns; a distinct count sends each row once."""
    from siteval.operators import audit as A
    from siteval.operators.suffixes import compile_rules
    from siteval.plans.corpus import AUDITED, build_corpus, corpus_profiles, profile_values
    rules = compile_rules(spark.createDataFrame([("com", "exact", "icann")], "rule string, kind string, section string"))
    rows = [(i, f"http://www.s{i % 25 % 7}.com/{i % 25}", int(i % 25 % 7 == 3 or i == 5), f"s{i % 2}") for i in range(60)]
    source = spark.createDataFrame(rows, "record_id long, raw_url string, label int, source_name string")
    whole, slim = (build_corpus([source], rules, caps=(), audited=a) for a in (False, True))
    assert slim["parsed"].columns == AUDITED and slim["parsed"].inputFiles() and slim["eligible"].inputFiles()
    assert slim["parsed"].schema["raw_url_hash"].dataType.simpleString() == "binary"
    a, b = (sorted(map(tuple, profile_values(corpus_profiles(c)).collect()), key=repr) for c in (whole, slim))
    assert repr(a) == repr(b) and {r[0] for r in a} >= {"exact_duplicates", "cross_label_conflicts", "concentration"}
    plan = A.key_profile(slim["parsed"], "raw_url_hash", "label", "source_name", "site_key_private")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Expand" not in plan

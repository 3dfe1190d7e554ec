"""Golden rows for URL parsing and suffix rules."""

import math

import pytest
from pyspark.sql import functions as F

from siteval.functions.features import FEATURES, ablation_features, url_features
from siteval.operators import suffixes
from siteval.operators.parsing import parse_urls

RULES = [("com", "exact", "icann"), ("uk", "exact", "icann"), ("co.uk", "exact", "icann"), ("io", "exact", "icann"),
         ("ly", "exact", "icann"), ("ck", "wildcard", "icann"), ("www.ck", "exception", "icann"),
         ("github.io", "exact", "private")]

GOLDEN = [
    ("HTTPS://WWW.Shop.com:443/A?x=1#f", "VALID_PUBLIC_DNS_URL", "shop.com", "shop.com", "https://www.shop.com/A?x=1"),
    ("http://a.b.co.uk", "VALID_PUBLIC_DNS_URL", "b.co.uk", "b.co.uk", "http://a.b.co.uk/"),
    ("http://user.github.io/p", "VALID_PRIVATE_SUFFIX_URL", "user.github.io", "github.io", "http://user.github.io/p"),
    ("http://u:p@shop.com./", "VALID_PUBLIC_DNS_URL", "shop.com", "shop.com", "http://shop.com/"),
    ("http://x.y.ck/", "VALID_PUBLIC_DNS_URL", "x.y.ck", "x.y.ck", "http://x.y.ck/"),
    ("http://www.ck/", "VALID_PUBLIC_DNS_URL", "www.ck", "www.ck", "http://www.ck/"),
    ("shop.com/login", "MISSING_SCHEME_RECOVERABLE", "shop.com", "shop.com", "//shop.com/login"),
    ("ftp://a.shop.com/", "UNSUPPORTED_SCHEME", "shop.com", "shop.com", "ftp://a.shop.com/"),
    ("http://8.8.8.8:8080/x", "VALID_IP_HOST_URL", "8.8.8.8", "8.8.8.8", "http://8.8.8.8:8080/x"),
    ("http://10.0.0.1/", "LOCAL_OR_PRIVATE_HOST", "10.0.0.1", "10.0.0.1", "http://10.0.0.1/"),
    ("http://[::1]/", "LOCAL_OR_PRIVATE_HOST", "::1", "::1", "http://[::1]/"),
    ("http://[2606:4700:0:0:0:0:0:1]:81/x", "VALID_IP_HOST_URL", "2606:4700::1", "2606:4700::1", "http://[2606:4700::1]:81/x"),
    ("http://intranet/", "LOCAL_OR_PRIVATE_HOST", "", "", "http://intranet/"),
    ("http://shop.com:99999/", "MALFORMED_PORT", "shop.com", "shop.com", "http://shop.com/"),
    ("http://host_name.com/", "MALFORMED_IDN_HOST", None, None, "UNPARSEABLE:http://host_name.com/"),
    ("http://münchen.com/", "VALID_PUBLIC_DNS_URL", "xn--mnchen-3ya.com", "xn--mnchen-3ya.com", "http://xn--mnchen-3ya.com/"),
    ("mailto:a@b.c", "MISSING_HOST", None, None, "UNPARSEABLE:mailto:a@b.c"),
    ("http:///path", "MISSING_HOST", None, None, "UNPARSEABLE:http:///path"),
    ("shop.com:80/x", "MISSING_HOST", None, None, "UNPARSEABLE:shop.com:80/x"),
    ("  ", "MISSING_URL", None, None, "UNPARSEABLE:"),
    (None, "MISSING_URL", None, None, "UNPARSEABLE:"),
    ("http://[bad/", "MALFORMED_URL", None, None, "UNPARSEABLE:http://[bad/"),
    ("http://x.unknowntld/", "MALFORMED_OR_NONPUBLIC_DNS_HOST", "", "", "http://x.unknowntld/"),
]


@pytest.fixture(scope="module")
def rules(spark):
    return suffixes.compile_rules(spark.createDataFrame(RULES, "rule string, kind string, section string"))


@pytest.fixture(scope="module")
def parsed(spark, rules):
    df = spark.createDataFrame([(i, g[0]) for i, g in enumerate(GOLDEN)], "id int, raw_url string")
    return {r["id"]: r for r in url_features(parse_urls(df, "raw_url", rules)).collect()}


@pytest.mark.parametrize("i", range(len(GOLDEN)))
def test_golden_parse(parsed, i):
    r = parsed[i]
    got = (r["raw_url"], r["parse_status"], r["site_key_private"], r["site_key_icann"], r["normalized_url"])
    assert got == GOLDEN[i]


def test_punycode_feature_reads_raw_host(parsed):
    i = [g[0] for g in GOLDEN].index("http://münchen.com/")
    assert parsed[i]["has_punycode"] == 0


def test_entropy(spark, rules):
    df = parse_urls(spark.createDataFrame([(1, "http://aab.b/")], "id int, raw_url string"), "raw_url", rules)
    assert math.isclose(url_features(df).first()["char_entropy"], 1.521928, abs_tol=1e-6)


def test_salted_rule_lookup_equals_broadcast(spark, rules, monkeypatch):
    df = spark.createDataFrame([(i, g[0]) for i, g in enumerate(GOLDEN)], "id int, raw_url string")
    a = sorted(map(str, parse_urls(df, "raw_url", rules).collect()))
    monkeypatch.setattr(suffixes, "BROADCAST_RULES", 0)
    assert sorted(map(str, parse_urls(df, "raw_url", rules).collect())) == a


def test_filter_on_parse_columns_keeps_udf_out_of_filters(spark, rules):
    df = spark.createDataFrame([(1, "http://a.com/")], "id int, raw_url string")
    out = parse_urls(df, "raw_url", rules).where(F.col("parse_status") == "VALID_PUBLIC_DNS_URL")
    assert out.count() == 1


def test_features_ignore_white_space_at_the_ends(spark, rules):
    raw = ["\thttp://a.com/x \n", "http://a.com/x", "http://a.com/x ?q ", "http://a.com/x?q", "http://a.com/ ?", "http://a.com/"]
    rows = spark.createDataFrame(list(enumerate(raw)), "i int, raw_url string")
    got = {r.i: r for r in url_features(parse_urls(rows, "raw_url", rules)).collect()}
    for a, b in ((0, 1), (2, 3), (4, 5)):
        assert all(got[a][f] == got[b][f] for f in ("path_length", "query_length", "path_depth", "is_root_path", "has_query"))
    assert got[0].url_length == got[1].url_length == 14


def test_ablation_sizes():
    assert len(FEATURES) == 22
    assert [len(ablation_features(a)) for a in ("AB1", "AB2", "AB3", "AB4", "AB5a", "AB5b")] == [18, 21, 20, 18, 6, 5]


def test_parse_accepts_a_stream(spark, rules, folder):
    spark.createDataFrame([("http://a.b.co.uk/x",)], "raw_url string").write.parquet(folder + "/in")
    stream = spark.readStream.schema("raw_url string").parquet(folder + "/in")
    q = (parse_urls(stream, "raw_url", rules).writeStream.format("memory").queryName("parsed_stream")
         .option("checkpointLocation", folder + "/cp").start())
    try:
        q.processAllAvailable()
        assert spark.table("parsed_stream").first()["site_key_private"] == "b.co.uk"
    finally:
        q.stop()


def test_parser_stays_in_compiled_methods(spark):
    """The JVM interprets generated methods over 8,000 bytes for every row."""
    import re

    from siteval.plans.tables import Tables
    explained = spark._jvm.PythonSQLUtils.explainString
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        t = Tables(spark, "/root/testdata/sf0.001")
        for df in (t.parsed(), t.parsed().select("record_id", "hostname_ascii"), t.parsed().select("record_id", "normalized_url_hash")):
            sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", explained(df._jdf.queryExecution(), "codegen"))]
            assert sizes and max(sizes) <= 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)


def test_spread_bounds_the_rows_of_a_task(spark, monkeypatch):
    from siteval.plans import tables
    monkeypatch.setattr(tables, "ROWS_PER_TASK", 100, raising=False)
    t = tables.Tables(spark, "/root/testdata/sf0.001")
    parts = t.spread(spark.range(0, 5000, 1, 8)).rdd.glom().map(len).collect()
    assert sum(parts) == 5000 and max(parts) <= 200


def test_resolver_takes_plain_rows_beside_rare_ones(spark):
    from siteval.operators.parsing import resolve_hosts
    hosts = [(None,), ("a.com",), ("xn--mnchen-3ya.net",), ("::1",), ("a.com",), ("xn--mnchen-3ya.net",)]
    got = resolve_hosts(spark.createDataFrame(hosts, "hostname_raw string").coalesce(1)).collect()
    assert [r["hostname_ascii"] for r in got] == [None, "a.com", "xn--mnchen-3ya.net", "::1", "a.com", "xn--mnchen-3ya.net"]
    assert [r["is_ip"] for r in got] == [None, False, False, True, False, False]

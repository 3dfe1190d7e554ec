"""Template keys against plain regular expressions, publication tables and the predictor firewall at their edges."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from siteval.functions.stats import fixed
from siteval.functions.urls import template_key_v2
from siteval.operators import integrity as I
from siteval.operators import models as M
from siteval.plans.queries_urls import template_v2_sql

GOLDEN = {
    "http://a.com/x/123e4567-e89b-12d3-a456-426614174000": "http://a.com/x/<uuid>",
    "http://a.com/?m=Some.One@mail.example.org&n=1234": "http://a.com/?m=<email>&n=1234",
    "http://a.com/12345/1234": "http://a.com/<num>/1234",
    "http://a.com/abcdefghijklmnopqrstuv/q": "http://a.com/<token>/q",
    "http://a.com/abcdefghijklmnopqrstuv/zyxwvutsrqponmlkjihgfe/q": "http://a.com/<token>/<token>/q",
    "http://a.com/abcdefghijklmnopqrstuv": "http://a.com/abcdefghijklmnopqrstuv",
    "http://a.com/?t=abcdefghijklmnopqrstuv-zyx=1": "http://a.com/?t=<token>-zyx=1",
    "": "",
}


def masked(text: str) -> str:
    out = text.lower()
    for pattern, mark in ((r"[0-9a-f]{8}-[0-9a-f-]{27,}", "<uuid>"), (r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}", "<email>"),
                          (r"[0-9]{5,}", "<num>"), (r"(?<=[=/._-])[a-z0-9_-]{20,}(?=[$&/?#._-])", "<token>")):
        out = re.sub(pattern, mark, out)
    return out


def some_urls() -> list[str]:
    rng = random.Random(7)
    parts = ["/", "=", "-", "_", ".", "?", "&", "#", "$", "@", "ab", "F0", "1234", "56789", "x" * 19, "y" * 20, "z-" * 11,
             "0a1b2c3d-0a1b-0a1b-0a1b-0a1b2c3d4e5f", "é"]
    return [*GOLDEN, *("http://h.com/" + "".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(3000))]


def test_template_golden_rows():
    assert {u: masked(u) for u in GOLDEN} == GOLDEN


def test_template_v2_and_its_sql_equal_plain_patterns(spark):
    urls = some_urls()
    want = {u: hashlib.sha256(masked(u).encode()).hexdigest() for u in urls}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r.u: r.k for r in df.select("u", template_key_v2(F.col("u")).alias("k")).collect()} == want
    con = duckdb.connect()
    con.execute("CREATE TABLE urls (u VARCHAR)")
    con.executemany("INSERT INTO urls VALUES (?)", [(u,) for u in want])
    assert dict(con.execute(f"SELECT u, {template_v2_sql('u')} FROM urls").fetchall()) == want


@pytest.mark.parametrize("value,text", [(0.0625, "0.062"), (0.1875, "0.188"), (-0.5, "-0.500"), (None, None)])
def test_fixed(spark, value, text):
    df = spark.createDataFrame([(value,)], "x double")
    assert df.select(fixed(F.col("x")).alias("t")).first().t == text


def test_exposure_table_leaves_missing_cells_null(spark):
    rows = [("CAP5", "A", "0", 12.25), ("CAP5", "A", "1", None), ("CAP5", "C", "all", 7.0)]
    found = I.table_exposure(spark.createDataFrame(rows, "variant string, regime string, class string, site_seen_pct double"), "regime")
    row = found.first().asDict()
    assert row == {"variant": "CAP5", "A_negative": "12.2", "A_positive": None, "C_negative": None, "C_positive": None}


def test_registry_fills_missing_columns_and_takes_no_others(spark):
    a = spark.createDataFrame([("E1", 3)], "experiment_id string, test_n int")
    b = spark.createDataFrame([("E2", "x")], "experiment_id string, extra string")
    found = I.registry([a, b.select("experiment_id")], ["experiment_id", "test_n"])
    assert found.columns == ["experiment_id", "test_n"]
    assert sorted((r.experiment_id, None if r.test_n is None else int(r.test_n)) for r in found.collect()) == [("E1", 3), ("E2", None)]


def test_hash_table_tells_changed_and_missing_files(spark):
    kind = "path string, sha256 string"
    expected = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], kind)
    observed = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4")], kind)
    found = {r.path: (r.sha256, r.status) for r in I.table_hashes(I.verify_hashes(observed, expected)).collect()}
    assert found == {"a": ("1", "VERIFIED"), "b": ("x", "MISMATCH"), "c": (None, "MISMATCH")}


def test_predictor_checks(spark):
    df = spark.createDataFrame([(1, "u", None), (None, None, None)], "url_length int, raw_url string, partition string")
    found = {r.check_id: (r.violations, r.status) for r in M.predictor_checks(df, df.columns).collect()}
    assert found == {"url_length": (0, "PASS"), "raw_url": (1, "FAIL"), "partition": (0, "PASS")}
    with pytest.raises(ValueError, match="raw_url"):
        M.check_predictors(["url_length", "raw_url"])

"""The driver's tables in the roles the analyses need.

``RAW_URL`` builds a URL corpus from ``orders``: 12 host shapes, one site that
holds a third of all rows, ports, user names, missing schemes and duplicates.
The text is plain SQL, read by Spark and by the oracle alike.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteval.functions.hashing import h60, unit
from siteval.operators.parsing import parse_urls
from siteval.operators.ranking import ensure_checkpoint_dir, ordinal
from siteval.operators.suffixes import SuffixRules, compile_rules

# (rule, kind, section)
RULES = [
    ("com", "exact", "icann"), ("net", "exact", "icann"), ("org", "exact", "icann"),
    ("uk", "exact", "icann"), ("co.uk", "exact", "icann"), ("ly", "exact", "icann"),
    ("ck", "wildcard", "icann"), ("www.ck", "exception", "icann"),
    ("example.com", "exact", "private"), ("example.net", "exact", "private"),
    ("example.org", "exact", "private"),
]

_HOST = """CASE WHEN k % 3 = 0 THEN 'www.hot.com'
  WHEN c % 12 = 0 THEN 'www.shop' || c || '.com'
  WHEN c % 12 = 1 THEN 'user' || c || '.example.net'
  WHEN c % 12 = 2 THEN 'a.b' || c || '.org'
  WHEN c % 12 = 3 THEN '10.' || (c % 256) || '.0.' || (c % 200)
  WHEN c % 12 = 4 THEN '8.8.' || (c % 200) || '.8'
  WHEN c % 12 = 5 THEN 'host_' || c || '.com'
  WHEN c % 12 = 6 THEN 'intranet' || c
  WHEN c % 12 = 7 THEN 'x' || c || '.unknowntld'
  WHEN c % 12 = 8 THEN 'bit.ly'
  WHEN c % 12 = 9 THEN 'Shop-' || c || '.CO.UK.'
  WHEN c % 12 = 10 THEN 'm.blog' || (c % 30) || '.x' || (c % 20) || '.example.com'
  WHEN c % 24 = 11 THEN 'x.y' || c || '.ck'
  ELSE 'xn--mnchen-3ya.s' || c || '.net' END"""

RAW_URL = f"""CASE WHEN k % 97 = 96 THEN '  ' ELSE
  (CASE WHEN k % 10 = 0 THEN 'HTTPS://' WHEN k % 10 = 1 THEN '' WHEN k % 10 = 2 THEN 'ftp://'
        WHEN k % 10 < 6 THEN 'https://' ELSE 'http://' END)
  || (CASE WHEN k % 13 = 5 THEN 'u:p@' ELSE '' END)
  || ({_HOST})
  || (CASE WHEN k % 36 = 1 THEN ':80' WHEN k % 36 = 3 THEN ':443' WHEN k % 36 = 8 THEN ':8080'
           WHEN k % 36 = 13 THEN ':99999' WHEN k % 36 = 22 THEN ':abc' WHEN k % 36 = 29 THEN ':' ELSE '' END)
  || (CASE WHEN k % 7 = 0 THEN '' WHEN k % 7 = 1 THEN '/' WHEN k % 7 = 2 THEN '/a/b' || (k % 40) || '.html'
           WHEN k % 7 = 3 THEN '/%41x/' || (k % 40)
           WHEN k % 7 = 4 THEN '/user' || (c % 5) || '@mail.com/' || (1000000 + k % 40)
           WHEN k % 7 = 5 THEN '/t/abcdefghijklmnopqrstuvwxyz0123/x' || (k % 4)
           ELSE '/deep/er/and/deeper/' || (k % 8) || '/' END)
  || (CASE WHEN k % 5 = 1 THEN '?q=' || (k % 7) WHEN k % 5 = 2 THEN '?a=1&b=2&id=00ff00ff00ff00ff00' ELSE '' END)
  || (CASE WHEN k % 11 = 3 THEN '#top' ELSE '' END) END"""

EXPERIMENTS = [("A", "M1"), ("A", "M2"), ("C", "M1"), ("C", "M2")]
# Split seeds.
SEEDS = [13, 42, 73, 101, 2026]
ROWS_PER_TASK = 250_000  # of a table that ``spread`` deals out


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def spread(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """Use all cores for the work behind a table, in tasks of bounded size.

        One small file is one task, and a split of a large one holds millions
        of narrow rows, so tasks follow from the number of rows.  ``by``: rows
        of one value meet, so grouping by it takes no other exchange.
        """
        tasks = max(self.spark.sparkContext.defaultParallelism, -(-df.count() // ROWS_PER_TASK))
        if by:
            return df.repartition(tasks, by)
        return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df

    def scratch(self, name: str) -> str:
        """A new path in the shared checkpoint folder."""
        ensure_checkpoint_dir(self.spark)
        return f"{self.spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"

    @cached_property
    def rule_rows(self) -> DataFrame:
        return self.spark.createDataFrame(RULES, "rule string, kind string, section string")

    @cached_property
    def rules(self) -> SuffixRules:
        return compile_rules(self.rule_rows)

    # ------------------------------------------------------------ URL corpus

    def urls(self) -> DataFrame:
        """record_id, raw_url, label, source_name: one row per order."""
        o = self.spread(self.read("orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c")))
        flip = F.when((F.col("c") % 10 == 3) & (F.pmod(h60("flip", F.col("k")), F.lit(5)) == 0), 1).otherwise(0)
        base = F.when(F.col("k") % 3 == 0, 0).otherwise(F.pmod(h60("label", F.col("c")), F.lit(2)))
        label = F.when(F.col("k") % 3 == 0, base).otherwise((base + flip) % 2)
        return o.select(F.col("k").alias("record_id"), F.expr(RAW_URL).alias("raw_url"),
                        label.cast("int").alias("label"),
                        F.concat(F.lit("s"), F.col("k") % 4).alias("source_name"))

    def parsed(self) -> DataFrame:
        return parse_urls(self.urls(), "raw_url", self.rules)

    def grouped(self) -> DataFrame:
        """Parsed rows with a site key."""
        return self.parsed().where(F.coalesce("site_key_private", F.lit("")) != "")

    def pages(self) -> DataFrame:
        """Parsed web pages with a class-pure label per site."""
        p = self.read("pages").select("page_id", F.col("url").alias("raw_url"))
        p = parse_urls(p, "raw_url", self.rules)
        return p.withColumn("label", F.pmod(h60("label", F.col("site_key_private")), F.lit(2)).cast("int"))

    # ------------------------------------------------------------ groups and scores

    def orders(self) -> DataFrame:
        o = self.read("orders")
        return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("site"),
                        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"),
                        "o_totalprice", "o_orderpriority", "o_orderdate")

    def scored(self, pure: bool = False) -> DataFrame:
        """Scored orders of four experiments; ``pure`` gives class-pure sites."""
        o = self.spread(self.orders().select("id", "site", "label"))
        exps = F.explode(F.array(*[F.struct(F.lit(r).alias("regime"), F.lit(m).alias("model"))
                                   for r, m in EXPERIMENTS])).alias("e")
        o = o.select("*", exps).select("e.*", "id", "site", "label")
        tag = F.concat("regime", "model")
        o = o.withColumn("score", 0.5 * F.col("label") * unit("u1", tag, F.col("id")) + 0.5 * unit("u2", tag, F.col("id")))
        if pure:
            o = o.withColumn("site", F.concat_ws("-", F.col("site"), F.col("label")))
        return o

    def coefficients(self) -> DataFrame:
        """Token weights of two regimes: brands and types of ``part`` as vocabulary."""
        p = self.read("part").select("p_partkey", F.concat_ws(" ", "p_type", "p_brand", "p_partkey").alias("token"))
        regimes = F.explode(F.array(F.lit("A"), F.lit("C"))).alias("regime")
        p = p.select("p_partkey", "token", regimes)
        keep = F.pmod(h60("vocab", F.col("regime"), F.col("p_partkey")), F.lit(10)) < 8
        weight = F.floor((unit("w", F.col("p_partkey")) + unit("w", F.col("regime"), F.col("p_partkey")) - 1) * 100) / 100.0
        return p.where(keep).select("regime", "token", weight.alias("coefficient"))

    def phi(self) -> DataFrame:
        """Attributions of both regimes per order line and feature.

        One exchange of one row per line: the grouping here and those by
        ``row_id`` that follow find their rows in one task.
        """
        feats = ["l_quantity", "l_discount", "l_tax"]
        key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
        label = F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
        li = self.spread(self.read("lineitem").select(key.alias("row_id"), label.alias("label"), *feats), "row_id")
        li = li.groupBy("row_id", "label").agg(*[F.max(f).alias(f) for f in feats])
        cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("x")) for f in feats])).alias("c")
        rows = li.select("row_id", "label", cells).select("row_id", "label", "c.*")
        return rows.select("row_id", "label", "feature", (F.col("x") * 0.25 - 1).alias("phi_a"),
                           (F.col("x") * 0.5 - 2.5).alias("phi_c"))

    def ledger(self) -> DataFrame:
        """Crawl ledger: one row per user of ``events``."""
        e = self.read("events")
        return e.groupBy(F.col("user_id").alias("ordinal")).agg(
            F.count(F.lit(1)).alias("records"),
            F.when(F.max(F.when(F.col("event_id") % 97 == 0, 1).otherwise(0)) == 1, "FAILED")
            .when(F.col("user_id") % 10 == 9, "PENDING").otherwise("COMPLETED").alias("status"),
            F.min("ts").alias("started"), F.max("ts").alias("finished"))

    def captures(self) -> DataFrame:
        """Crawl records: one row per event."""
        e = self.read("events")
        return e.select(
            F.col("user_id").alias("site"), F.concat(F.lit("key"), F.floor("value").cast("bigint")).alias("urlkey"),
            F.date_format("ts", "yyyyMMddHHmmss").alias("crawl_timestamp"), F.col("event_id").alias("record_id"),
            F.when(F.col("event_type") == "error", "500").otherwise("200").alias("status"),
            F.when(F.col("event_type") == "signup", "application/pdf").otherwise("text/html").alias("mime"))

    def ranked(self) -> DataFrame:
        """Ranked list: customers by balance."""
        c = self.read("customer").select("c_custkey", F.col("c_name").alias("domain"), "c_acctbal")
        c = ordinal(c, [F.desc("c_acctbal"), F.asc("c_custkey")], "_r")
        return c.select((F.col("_r") + 1).cast("int").alias("rank"), "domain")


# ---------------------------------------------------------------- oracle building blocks

def sql_h60(*parts: str) -> str:
    text = " || '|' || ".join(p if p.startswith("'") else f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST('0x' || substr(sha256({text}), 1, 15) AS BIGINT)"


def sql_unit(*parts: str) -> str:
    return f"(CAST({sql_h60(*parts)} AS DOUBLE) / 1152921504606846976.0)"


def _sql_list(kind: str, section: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{r}'" for r, k, s in RULES if k == kind and s in section) + "]::VARCHAR[]"


def _suffix_len(section: tuple[str, ...]) -> str:
    exact, wild, exc = (_sql_list(k, section) for k in ("exact", "wildcard", "exception"))
    return f"""CASE WHEN host IS NULL OR is_ip THEN 0
      WHEN len(list_filter(sfx, lambda s: list_contains({exc}, s))) > 0
        THEN len(string_split(list_filter(sfx, lambda s: list_contains({exc}, s))[1], '.')) - 1
      ELSE greatest(
        coalesce(list_max(list_transform(list_filter(sfx, lambda s: list_contains({exact}, s)),
                                         lambda s: len(string_split(s, '.')))), 0),
        coalesce(list_max(list_transform(list_filter(sfx, lambda s: list_contains({wild}, s)),
                                         lambda s: CASE WHEN len(string_split(s, '.')) < n_labels
                                                        THEN len(string_split(s, '.')) + 1 ELSE 0 END)), 0)) END"""


_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_LABEL = "[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?"
SHORT = ("'bit.ly','tinyurl.com','t.co','goo.gl','ow.ly','buff.ly','is.gd','cutt.ly','rebrand.ly','shorturl.at',"
         "'tiny.cc','rb.gy'")

URLS_SQL = f"""urls AS (
  SELECT k AS record_id, {RAW_URL} AS raw_url,
    CAST(CASE WHEN k % 3 = 0 THEN 0 ELSE (({sql_h60("'label'", "c")}) % 2
      + CASE WHEN c % 10 = 3 AND ({sql_h60("'flip'", "k")}) % 5 = 0 THEN 1 ELSE 0 END) % 2 END AS INTEGER) AS label,
    's' || (k % 4) AS source_name
  FROM (SELECT o_orderkey AS k, o_custkey AS c FROM orders))"""


def parse_sql(source: str, key: str, extra: str = "", out: str = "parsed") -> str:
    """CTEs that parse ``source(raw_url)`` with list functions and ordered CASEs."""
    keep = f"{key}, raw_url{', ' + extra if extra else ''}"
    both, icann = ("icann", "private"), ("icann",)
    return f"""
  t1 AS (SELECT {keep}, nullif(trim(raw_url), '') AS u FROM {source}),
  t2 AS (SELECT *, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS sch FROM t1),
  t3 AS (SELECT *, CASE WHEN sch = '' THEN '//' || u ELSE substr(u, length(sch) + 2) END AS rest FROM t2),
  t4 AS (SELECT *, split_part(rest, '#', 1) AS nofrag,
           CASE WHEN contains(rest, '#') THEN substr(rest, instr(rest, '#') + 1) ELSE '' END AS frag FROM t3),
  t5 AS (SELECT *, split_part(nofrag, '?', 1) AS hier,
           CASE WHEN contains(nofrag, '?') THEN substr(nofrag, instr(nofrag, '?') + 1) ELSE '' END AS q FROM t4),
  t6 AS (SELECT *, CASE WHEN hier LIKE '//%' THEN split_part(substr(hier, 3), '/', 1) ELSE '' END AS auth FROM t5),
  t7 AS (SELECT *, CASE WHEN hier LIKE '//%' THEN substr(hier, 3 + length(auth)) ELSE hier END AS pth,
           CASE WHEN contains(auth, '@') THEN split_part(auth, '@', -1) ELSE auth END AS hp FROM t6),
  t8 AS (SELECT *, lower(split_part(hp, ':', 1)) AS h0, rtrim(lower(split_part(hp, ':', 1)), '.') AS hraw,
           CASE WHEN contains(hp, ':') THEN substr(hp, instr(hp, ':') + 1) ELSE '' END AS ptext FROM t7),
  t9 AS (SELECT *, coalesce(regexp_full_match(hraw, '{_OCTET}(\\.{_OCTET}){{3}}'), FALSE) AS v4,
           regexp_full_match(hraw, '{_LABEL}(\\.{_LABEL})*') AND length(hraw) <= 253
             AND NOT regexp_matches(regexp_replace(hraw, '(^|\\.)xn--', '\\1', 'g'), '(^|\\.)[^.]{{2}}--') AS ldh FROM t8),
  t10 AS (SELECT *, (u IS NOT NULL AND h0 <> '' AND (v4 OR ldh)) AS res FROM t9),
  t11 AS (SELECT *, CASE WHEN res THEN hraw END AS host, CASE WHEN res THEN v4 END AS is_ip,
            CASE WHEN res THEN v4 AND (hraw LIKE '10.%' OR hraw LIKE '127.%' OR hraw LIKE '192.168.%') END AS is_private_ip,
            CASE WHEN res AND regexp_full_match(ptext, '[0-9]+') AND TRY_CAST(ptext AS INTEGER) BETWEEN 0 AND 65535
                 THEN TRY_CAST(ptext AS INTEGER) END AS port,
            string_split(hraw, '.') AS labels, len(string_split(hraw, '.')) AS n_labels FROM t10),
  t12 AS (SELECT *, list_transform(range(1, n_labels + 1), lambda i: array_to_string(labels[i:], '.')) AS sfx FROM t11),
  t13 AS (SELECT *, {_suffix_len(icann)} AS ni, {_suffix_len(both)} AS na FROM t12),
  t14 AS (SELECT *,
      CASE WHEN host IS NULL THEN NULL WHEN is_ip THEN host WHEN ni > 0 AND n_labels > ni
           THEN array_to_string(labels[n_labels - ni:], '.') ELSE '' END AS site_key_icann,
      CASE WHEN host IS NULL THEN NULL WHEN is_ip THEN host WHEN na > 0 AND n_labels > na
           THEN array_to_string(labels[n_labels - na:], '.') ELSE '' END AS site_key_private,
      CASE WHEN host IS NULL THEN NULL WHEN ni > 0 THEN array_to_string(labels[n_labels - ni + 1:], '.') ELSE '' END AS public_suffix_icann,
      CASE WHEN host IS NULL THEN NULL WHEN na > 0 THEN array_to_string(labels[n_labels - na + 1:], '.') ELSE '' END AS public_suffix_private,
      CASE WHEN host IS NULL THEN NULL WHEN is_ip THEN '' WHEN n_labels - na - 1 > 0
           THEN array_to_string(labels[:n_labels - na - 1], '.') ELSE '' END AS subdomain,
      CASE WHEN host IS NULL THEN NULL ELSE ni <> na END AS is_private_suffix FROM t13),
  {out} AS (SELECT {keep},
      CASE WHEN u IS NULL THEN 'MISSING_URL' WHEN h0 = '' THEN 'MISSING_HOST'
        WHEN host IS NULL THEN 'MALFORMED_IDN_HOST' WHEN ptext <> '' AND port IS NULL THEN 'MALFORMED_PORT'
        WHEN sch NOT IN ('', 'http', 'https') THEN 'UNSUPPORTED_SCHEME'
        WHEN is_private_ip OR host = 'localhost' OR (NOT is_ip AND NOT contains(host, '.')) THEN 'LOCAL_OR_PRIVATE_HOST'
        WHEN sch = '' THEN 'MISSING_SCHEME_RECOVERABLE' WHEN is_ip THEN 'VALID_IP_HOST_URL'
        WHEN site_key_private = '' THEN 'MALFORMED_OR_NONPUBLIC_DNS_HOST'
        WHEN is_private_suffix THEN 'VALID_PRIVATE_SUFFIX_URL' ELSE 'VALID_PUBLIC_DNS_URL' END AS parse_status,
      CASE WHEN u IS NOT NULL THEN sch END AS scheme,
      CASE WHEN u IS NOT NULL AND h0 <> '' THEN hraw END AS hostname_raw,
      host AS hostname_ascii, is_ip, is_private_ip, public_suffix_icann, public_suffix_private,
      site_key_icann, site_key_private, is_private_suffix, subdomain,
      CASE WHEN u IS NOT NULL THEN pth END AS path, CASE WHEN u IS NOT NULL THEN q END AS query,
      CASE WHEN u IS NOT NULL THEN frag END AS fragment, port,
      CASE WHEN res THEN sch = '' END AS missing_scheme,
      CASE WHEN res THEN site_key_private IN ({SHORT}) END AS is_shortener,
      CASE WHEN res THEN CASE WHEN sch = '' THEN '' ELSE sch || ':' END || '//' || host
        || CASE WHEN coalesce(port, 0) = 0 OR (sch = 'http' AND port = 80) OR (sch = 'https' AND port = 443) THEN ''
                ELSE ':' || port END
        || CASE WHEN pth = '' THEN '/' ELSE pth END || CASE WHEN q = '' THEN '' ELSE '?' || q END
        ELSE 'UNPARSEABLE:' || coalesce(u, '') END AS normalized_url
    FROM t14)"""


PARSED_SQL = "WITH " + URLS_SQL + "," + parse_sql("urls", "record_id", "label, source_name")
GROUPED_SQL = PARSED_SQL + ", grouped AS (SELECT * FROM parsed WHERE coalesce(site_key_private, '') <> '')"
PAGES_SQL = ("WITH src AS (SELECT page_id, url AS raw_url FROM pages),"
             + parse_sql("src", "page_id", out="parsed0")
             + f", labelled_pages AS (SELECT *, CAST({sql_h60(chr(39) + 'label' + chr(39), 'site_key_private')} % 2 AS INTEGER)"
             " AS label FROM parsed0)")
ORDERS_SQL = ("ord AS (SELECT o_orderkey AS id, o_custkey AS site, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label, "
              "o_totalprice, o_orderpriority, o_orderdate FROM orders)")


def scored_sql(pure: bool = False) -> str:
    exps = ", ".join(f"('{r}', '{m}')" for r, m in EXPERIMENTS)
    site = "site || '-' || label" if pure else "site"
    u1, u2 = (sql_unit(f"'{u}'", "regime || model", "id") for u in ("u1", "u2"))
    return (ORDERS_SQL + f", scored AS (SELECT regime, model, id, {site} AS site, label, "
            f"0.5 * label * {u1} + 0.5 * {u2} AS score "
            f"FROM ord CROSS JOIN (VALUES {exps}) AS e(regime, model))")


COEFFICIENTS_SQL = f"""parts AS (SELECT p_partkey, p_type || ' ' || p_brand || ' ' || p_partkey AS token, regime
    FROM part CROSS JOIN (VALUES ('A'), ('C')) AS r(regime)),
  coefficients AS (SELECT regime, token, floor(({sql_unit("'w'", "p_partkey")} + {sql_unit("'w'", "regime", "p_partkey")} - 1) * 100) / 100.0 AS coefficient
    FROM parts WHERE {sql_h60("'vocab'", "regime", "p_partkey")} % 10 < 8)"""

PHI_SQL = """cells AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS row_id,
      CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, l_quantity, l_discount, l_tax FROM lineitem),
  long AS (UNPIVOT cells ON l_quantity, l_discount, l_tax INTO NAME feature VALUE x),
  phi AS (SELECT row_id, label, feature, max(x) * 0.25 - 1 AS phi_a, max(x) * 0.5 - 2.5 AS phi_c
    FROM long GROUP BY row_id, label, feature)"""

LEDGER_SQL = """ledger AS (SELECT user_id AS ordinal, count(*) AS records,
    CASE WHEN max(CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END) = 1 THEN 'FAILED'
         WHEN user_id % 10 = 9 THEN 'PENDING' ELSE 'COMPLETED' END AS status,
    min(ts) AS started, max(ts) AS finished FROM events GROUP BY user_id)"""

CAPTURES_SQL = """captures AS (SELECT user_id AS site, 'key' || CAST(floor(value) AS BIGINT) AS urlkey,
    strftime(ts, '%Y%m%d%H%M%S') AS crawl_timestamp, event_id AS record_id,
    CASE WHEN event_type = 'error' THEN '500' ELSE '200' END AS status,
    CASE WHEN event_type = 'signup' THEN 'application/pdf' ELSE 'text/html' END AS mime FROM events)"""

RANKED_SQL = """ranked AS (SELECT CAST(row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS rank,
    c_name AS domain FROM customer)"""

"""Registered queries: URL parsing, suffix rules, features, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteval.functions import urls as U
from siteval.functions.features import (ABLATIONS, FEATURES, ablation_features, audit_properties, error_properties,
                                        structural_properties, url_features)
from siteval.functions.hashing import digest, h60
from siteval.functions.stats import display_pct, label_to_int, mean_sd_text, recode_polarity, split_interval
from siteval.operators.parsing import LIGHT_COLUMNS, PARSE_COLUMNS, eligible_dns, parse_urls, split_hosts, with_template_keys
from siteval.operators.suffixes import parse_rule_lines
from siteval.plans.registry import query
from siteval.plans.tables import (GROUPED_SQL, PAGES_SQL, PARSED_SQL, RULES, Tables, sql_h60)

ALL_PARSE = ", ".join(PARSE_COLUMNS)


@query("u15_parse_urls", f"""{PARSED_SQL} SELECT record_id, {ALL_PARSE}, normalized_url,
    sha256(raw_url) AS raw_url_hash, sha256(normalized_url) AS normalized_url_hash FROM parsed""")
def u15(t: Tables):
    return t.parsed().drop("raw_url", "label", "source_name")


@query("u15_parse_pages", f"{PAGES_SQL} SELECT page_id, {ALL_PARSE}, normalized_url FROM labelled_pages")
def u15_pages(t: Tables):
    return t.pages().drop("raw_url", "label", "raw_url_hash", "normalized_url_hash")


@query("u01_u03_split_host", f"""{PARSED_SQL} SELECT record_id, nullif(trim(raw_url), '') AS clean,
    sch, CASE WHEN u IS NOT NULL THEN auth END AS auth, CASE WHEN u IS NOT NULL THEN frag END AS frag, CASE WHEN u IS NOT NULL THEN q END AS q, pth, nullif(h0, '') AS host FROM t8""")
def u01(t: Tables):
    d = split_hosts(t.urls(), "raw_url")
    return d.select("record_id", F.col("_clean").alias("clean"), F.col("_scheme").alias("sch"),
                    F.col("_authority").alias("auth"), F.col("_fragment").alias("frag"), F.col("_query").alias("q"),
                    F.col("_path").alias("pth"), F.nullif("_host", F.lit("")).alias("host"))


@query("u04_u05_ipv4", """WITH a AS (SELECT o_orderkey AS id, (o_orderkey * 7919 % 256) || '.' || (o_custkey % 256) || '.'
      || (o_orderkey % 300) || '.' || (o_custkey % 100) AS host FROM orders),
    b AS (SELECT *, list_transform(string_split(host, '.'), lambda x: CAST(x AS BIGINT)) AS o FROM a),
    c AS (SELECT *, o[3] < 256 AS ok, ((o[1] * 256 + o[2]) * 256 + o[3]) * 256 + o[4] AS n FROM b)
    SELECT id, host, ok AS is_ip, ok AND (o[1] IN (0, 10, 127) OR o[1] >= 240 OR (o[1] = 169 AND o[2] = 254)
      OR (o[1] = 172 AND o[2] BETWEEN 16 AND 31) OR (o[1] = 192 AND o[2] = 168) OR (o[1] = 198 AND o[2] IN (18, 19))
      OR n BETWEEN 3221225472 AND 3221225479 OR n BETWEEN 3221225642 AND 3221225643
      OR (o[1] = 192 AND o[2] = 0 AND o[3] = 2) OR (o[1] = 198 AND o[2] = 51 AND o[3] = 100)
      OR (o[1] = 203 AND o[2] = 0 AND o[3] = 113)) AS is_private FROM c""")
def u04(t: Tables):
    host = F.concat_ws(".", F.col("o_orderkey") * 7919 % 256, F.col("o_custkey") % 256,
                       F.col("o_orderkey") % 300, F.col("o_custkey") % 100)
    d = t.read("orders").select(F.col("o_orderkey").alias("id"), host.alias("host"))
    v4 = U.is_ipv4(F.col("host"))
    return d.withColumns({"is_ip": v4, "is_private": F.when(v4, U.ipv4_is_private(F.col("host"))).otherwise(False)})


def _international(t: Tables):
    """Hosts that need Python: accented names and IPv6 literals by order number."""
    k = F.col("o_orderkey")
    host = (F.when(k % 2 == 0, F.concat(F.lit("http://m"), F.lit("ü"), F.lit("nchen"), F.col("o_custkey"), F.lit(".com/")))
            .otherwise(F.concat(F.lit("http://[2001:db8::"), F.lower(F.hex(k % 65536)), F.lit("]/"))))
    return t.read("orders").select(k.alias("record_id"), host.alias("raw_url"))


@query("u06_idna_ipv6_hosts")
def u06(t: Tables):
    d = parse_urls(_international(t), "raw_url", t.rules)
    return d.select("record_id", "hostname_ascii", "is_ip", "parse_status", "normalized_url")


@query("u07_site_keys", f"""{PARSED_SQL} SELECT DISTINCT hostname_ascii, public_suffix_icann, public_suffix_private,
    site_key_icann, site_key_private, is_private_suffix, subdomain FROM parsed WHERE hostname_ascii IS NOT NULL""")
def u07(t: Tables):
    return t.parsed().where(F.col("hostname_ascii").isNotNull()).select(
        "hostname_ascii", "public_suffix_icann", "public_suffix_private", "site_key_icann", "site_key_private",
        "is_private_suffix", "subdomain").distinct()


@query("u08_u09_port_status", f"{PARSED_SQL} SELECT parse_status, port, count(*) AS n_rows FROM parsed GROUP BY ALL")
def u08(t: Tables):
    return t.parsed().groupBy("parse_status", "port").agg(F.count(F.lit(1)).alias("n_rows"))


@query("u10_shorteners", f"{PARSED_SQL} SELECT is_shortener, count(*) AS n_rows FROM parsed GROUP BY ALL")
def u10(t: Tables):
    return t.parsed().groupBy("is_shortener").agg(F.count(F.lit(1)).alias("n_rows"))


@query("u11_u12_normalized", f"""{PARSED_SQL} SELECT normalized_url, sha256(normalized_url) AS h, count(*) AS n_rows
    FROM parsed GROUP BY ALL""")
def u11(t: Tables):
    return t.parsed().groupBy("normalized_url", F.col("normalized_url_hash").alias("h")).agg(
        F.count(F.lit(1)).alias("n_rows"))


@query("u13_legacy_order", f"{PARSED_SQL} SELECT record_id, parse_status, hostname_ascii FROM parsed")
def u13(t: Tables):
    d = parse_urls(t.urls(), "raw_url", t.rules, ip_first=False)
    return d.select("record_id", "parse_status", "hostname_ascii")


@query("u14_light_profile", f"{PARSED_SQL} SELECT record_id, {', '.join(LIGHT_COLUMNS)} FROM parsed")
def u14(t: Tables):
    return parse_urls(t.urls(), "raw_url", t.rules, profile="light").drop("raw_url", "label", "source_name")


@query("u16_anonymous_site", f"""{GROUPED_SQL} SELECT DISTINCT site_key_private,
    'SITE-' || upper(substr(sha256('site|' || site_key_private), 1, 12)) AS anon FROM grouped""")
def u16(t: Tables):
    return t.grouped().select("site_key_private").distinct().withColumn(
        "anon", U.anonymous_site(F.col("site_key_private"), "site|"))


TEMPLATES_SQL = GROUPED_SQL + r""", masked AS (SELECT *, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      rtrim(left(hostname_ascii, length(hostname_ascii) - length(site_key_private)), '.') || '/' || path || '?' || query,
      '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+', '<EMAIL>', 'g'), '\b[0-9a-fA-F]{16,}\b', '<HEX>', 'g'),
      '\b\d{6,}\b', '<NUM>', 'g'), '[A-Za-z0-9_-]{24,}', '<TOKEN>', 'g')) AS template_key FROM grouped)"""


@query("u17_template_v1", f"{TEMPLATES_SQL} SELECT record_id, template_key FROM masked")
def u17(t: Tables):
    return with_template_keys(t.grouped()).select("record_id", "template_key")


def template_v2_sql(text: str) -> str:
    """RE2 has no look-around: a border is used up by its match.  Only ``/`` and
    ``.`` can end one token and begin the next, so they are doubled meanwhile."""
    out = f"lower({text})"
    for pattern, mark in ((r"[0-9a-f]{8}-[0-9a-f-]{27,}", "<uuid>"), (r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}", "<email>"),
                          (r"[0-9]{5,}", "<num>"), (r"([/.])", r"\1\1"),
                          (r"([=/._-])[a-z0-9_-]{20,}([$&/?#._-])", r"\1<token>\2"), ("//", "/"), (r"\.\.", ".")):
        out = f"regexp_replace({out}, '{pattern}', '{mark}', 'g')"
    return f"sha256({out})"


@query("u18_template_v2", f"""{GROUPED_SQL} SELECT {template_v2_sql("normalized_url")} AS template_hash, count(*) AS n_rows,
    count(DISTINCT site_key_private) AS sites FROM grouped GROUP BY 1""")
def u18(t: Tables):
    d = with_template_keys(t.grouped())
    return d.groupBy("template_hash").agg(F.count(F.lit(1)).alias("n_rows"),
                                          F.countDistinct("site_key_private").alias("sites"))


@query("p08_eligible_dns", f"""{PARSED_SQL} SELECT record_id FROM parsed
    WHERE parse_status IN ('VALID_PUBLIC_DNS_URL', 'VALID_PRIVATE_SUFFIX_URL')""")
def p08(t: Tables):
    return eligible_dns(t.parsed()).select("record_id")


# ---------------------------------------------------------------- suffix rule file

@query("s10_psl_rules", """WITH lines AS (SELECT n_nationkey AS pos, CASE WHEN n_nationkey = 12
      THEN '// ===BEGIN PRIVATE DOMAINS===' WHEN n_nationkey % 5 = 4 THEN '// ' || n_name
      WHEN n_nationkey % 5 = 3 THEN '*.' || n_name WHEN n_nationkey % 5 = 2 THEN '!www.' || n_name
      ELSE '  ' || n_name || '.com ' END AS line FROM nation)
    SELECT DISTINCT regexp_replace(regexp_replace(lower(trim(line)), '^!', ''), '^\\*\\.', '') AS rule,
      CASE WHEN trim(line) LIKE '!%' THEN 'exception' WHEN trim(line) LIKE '*.%' THEN 'wildcard' ELSE 'exact' END AS kind,
      CASE WHEN pos > 12 THEN 'private' ELSE 'icann' END AS section
    FROM lines WHERE trim(line) NOT LIKE '//%'""".replace("\\\\", "\\"))
def s10(t: Tables):
    k, name = F.col("n_nationkey"), F.col("n_name")
    line = (F.when(k == 12, "// ===BEGIN PRIVATE DOMAINS===").when(k % 5 == 4, F.concat(F.lit("// "), name))
            .when(k % 5 == 3, F.concat(F.lit("*."), name)).when(k % 5 == 2, F.concat(F.lit("!www."), name))
            .otherwise(F.concat(F.lit("  "), name, F.lit(".com "))))
    return parse_rule_lines(t.read("nation").select(k.alias("pos"), line.alias("line")))


_RULE_SQL = "(VALUES " + ", ".join(f"('{r}')" for r, k, _ in RULES if k == "exact") + ") AS r(rule)"


@query("j12_longest_suffix", f"""{PARSED_SQL}, hosts AS (SELECT DISTINCT hostname_ascii AS host FROM parsed
      WHERE NOT is_ip AND hostname_ascii NOT LIKE '%.ck'),
    hit AS (SELECT host, max(length(rule)) AS n FROM hosts JOIN {_RULE_SQL} ON host = rule OR ends_with(host, '.' || rule)
      GROUP BY host)
    SELECT host, right(host, n) AS suffix FROM hit""")
def j12(t: Tables):
    d = t.parsed().where(~F.col("is_ip") & ~F.col("hostname_ascii").endswith(".ck"))
    d = d.where(F.col("public_suffix_private") != "")
    return d.select(F.col("hostname_ascii").alias("host"), F.col("public_suffix_private").alias("suffix")).distinct()


@query("j12_longest_suffix_all_rules", f"""{PARSED_SQL} SELECT DISTINCT hostname_ascii AS host, public_suffix_private AS suffix
    FROM parsed WHERE NOT is_ip AND public_suffix_private <> ''""")
def j12_all(t: Tables):
    """Hosts of wildcard and exception rules too."""
    d = t.parsed().where(~F.col("is_ip") & (F.col("public_suffix_private") != ""))
    return d.select(F.col("hostname_ascii").alias("host"), F.col("public_suffix_private").alias("suffix")).distinct()


# ---------------------------------------------------------------- features

FEATURES_SQL = PARSED_SQL + r""", features AS (SELECT record_id, label, site_key_private, site_key_icann, hostname_ascii,
    length(trim(raw_url)) AS url_length, length(coalesce(hostname_ascii, '')) AS hostname_length,
    length(coalesce(path, '')) AS path_length, length(coalesce(query, '')) AS query_length,
    length(regexp_replace(coalesce(path, ''), '[^/]', '', 'g')) AS path_depth,
    length(regexp_replace(coalesce(subdomain, ''), '[^.]', '', 'g')) AS subdomain_depth,
    CASE WHEN coalesce(query, '') <> '' THEN 1 ELSE 0 END AS has_query,
    CASE WHEN port IS NOT NULL AND port NOT IN (80, 443) THEN 1 ELSE 0 END AS has_port,
    CASE WHEN coalesce(path, '') IN ('', '/') AND coalesce(query, '') = '' THEN 1 ELSE 0 END AS is_root_path,
    length(regexp_replace(coalesce(hostname_ascii, '') || coalesce(path, '') || coalesce(query, ''), '[^0-9]', '', 'g')) AS digit_count,
    CASE WHEN length(trim(raw_url)) > 0 THEN length(regexp_replace(coalesce(hostname_ascii, '') || coalesce(path, '')
      || coalesce(query, ''), '[^0-9]', '', 'g')) / length(trim(raw_url)) ELSE 0.0 END AS digit_ratio0,
    length(regexp_replace(coalesce(hostname_ascii, ''), '[^-]', '', 'g')) AS hyphen_count,
    length(regexp_replace(coalesce(hostname_ascii, ''), '[^.]', '', 'g')) AS dot_count,
    length(regexp_replace(trim(raw_url), '[^@?=&#~%]', '', 'g')) AS special_char_count,
    len(regexp_extract_all(trim(raw_url), '%[0-9A-Fa-f]{2}')) AS percent_encoded_count,
    coalesce(list_sum(list_transform(list_distinct(string_split(hostname_ascii, '')), lambda ch:
      -(len(list_filter(string_split(hostname_ascii, ''), lambda x: x = ch)) / length(hostname_ascii))
      * log2(len(list_filter(string_split(hostname_ascii, ''), lambda x: x = ch)) / length(hostname_ascii)))), 0.0) AS entropy0,
    CASE WHEN is_ip THEN 1 ELSE 0 END AS is_ip, CASE WHEN is_private_suffix THEN 1 ELSE 0 END AS is_private_suffix,
    CASE WHEN split_part(coalesce(subdomain, ''), '.', 1) = 'www' OR coalesce(hostname_ascii, '') LIKE 'www.%' THEN 1 ELSE 0 END AS has_www,
    CASE WHEN scheme = 'https' THEN 1 ELSE 0 END AS is_https,
    CASE WHEN coalesce(missing_scheme, FALSE) OR (NOT contains(raw_url, '://') AND trim(raw_url) <> '') THEN 1 ELSE 0 END AS is_missing_scheme,
    CASE WHEN contains(coalesce(hostname_raw, ''), 'xn--') THEN 1 ELSE 0 END AS has_punycode
    FROM parsed)"""
_INT_FEATURES = [f for f in FEATURES if f not in ("digit_ratio", "char_entropy")]


@query("f01_f22_url_features", f"""{FEATURES_SQL} SELECT record_id, {', '.join(_INT_FEATURES)},
    round(digit_ratio0, 6) AS digit_ratio, round(entropy0, 6) AS char_entropy FROM features""")
def f01(t: Tables):
    d = url_features(t.parsed())
    return d.select("record_id", *_INT_FEATURES, F.round("digit_ratio", 6).alias("digit_ratio"),
                    F.round("char_entropy", 6).alias("char_entropy"))


_PRESENCE_SQL = """CASE WHEN coalesce(path, '') IN ('', '/') AND coalesce(query, '') = '' THEN 1 ELSE 0 END AS root_only,
    CASE WHEN coalesce(query, '') <> '' THEN 1 ELSE 0 END AS query_present,
    CASE WHEN coalesce(hostname_ascii, '') LIKE 'www.%' THEN 1 ELSE 0 END AS www,
    CASE WHEN contains(coalesce(hostname_ascii, ''), 'xn--') THEN 1 ELSE 0 END AS punycode,
    length(coalesce(hostname_ascii, '')) AS hostname_length, length(coalesce(path, '')) AS path_length,
    length(raw_url) AS url_length"""


@query("f23_audit_properties", f"""{PARSED_SQL} SELECT record_id, {_PRESENCE_SQL},
    CASE WHEN coalesce(path, '') IN ('', '/') THEN 0 ELSE 1 END AS path_present,
    CASE WHEN coalesce(fragment, '') <> '' THEN 1 ELSE 0 END AS fragment_present,
    CASE WHEN scheme = 'https' THEN 1 ELSE 0 END AS https,
    CASE WHEN contains(raw_url, '%') THEN 1 ELSE 0 END AS percent_encoded FROM parsed""")
def f23(t: Tables):
    return audit_properties(t.parsed()).select(
        "record_id", "root_only", "query_present", "www", "punycode", "hostname_length", "path_length", "url_length",
        "path_present", "fragment_present", "https", "percent_encoded")


@query("f24_structural_properties", f"""{PARSED_SQL} SELECT record_id, {_PRESENCE_SQL},
    CASE WHEN regexp_matches(raw_url, '%[0-9A-Fa-f]{{2}}') THEN 1 ELSE 0 END AS encoded,
    CASE WHEN coalesce(subdomain, '') = '' THEN 0 ELSE len(string_split(subdomain, '.')) END AS subdomain_depth FROM parsed""")
def f24(t: Tables):
    return structural_properties(t.parsed()).select(
        "record_id", "root_only", "query_present", "www", "punycode", "hostname_length", "path_length", "url_length",
        "encoded", "subdomain_depth")


ERROR_PROPS_SQL = """CASE WHEN regexp_matches(coalesce(hostname_ascii, ''), '[0-9]') THEN 1 ELSE 0 END AS hostname_has_digit,
    CASE WHEN coalesce(path, '') IN ('', '/') AND coalesce(query, '') = '' THEN 1 ELSE 0 END AS root_path_empty_query,
    CASE WHEN public_suffix_icann IN ('com', 'org') THEN 1 ELSE 0 END AS com_or_org,
    CASE WHEN scheme = 'https' THEN 1 ELSE 0 END AS https,
    len(list_filter(string_split(coalesce(path, ''), '/'), lambda s: s <> '')) AS derived_path_depth,
    len(list_filter(string_split(coalesce(query, ''), '&'), lambda s: s <> '')) AS derived_query_parameter_count"""


@query("f25_f26_error_properties", f"{PARSED_SQL} SELECT record_id, {ERROR_PROPS_SQL} FROM parsed")
def f25(t: Tables):
    return error_properties(t.parsed()).select(
        "record_id", "hostname_has_digit", "root_path_empty_query", "com_or_org", "https", "derived_path_depth",
        "derived_query_parameter_count")


_SQL_NAME = {"digit_ratio": "digit_ratio0", "char_entropy": "entropy0"}


def _sum_sql(names: list[str]) -> str:
    return "round(0.0::DOUBLE + " + " + ".join(f"{i} * {_SQL_NAME.get(f, f)}" for i, f in enumerate(names, 1)) + ", 4)"


# the place of a feature in its set weighs its value, so a wrong, missing or misplaced feature shows
@query("p13_ablation_features", f"""{FEATURES_SQL} SELECT record_id, {', '.join(
    f"{_sum_sql(ablation_features(a))} AS {a}" for a in ABLATIONS)} FROM features""")
def p13(t: Tables):
    rows = url_features(t.parsed())
    return rows.select("record_id", *[
        F.round(sum((F.lit(i) * F.col(f) for i, f in enumerate(ablation_features(a), 1)), F.lit(0.0)), 4).alias(a) for a in ABLATIONS])


# ---------------------------------------------------------------- scalar functions

@query("x01_x10_scalar_functions", f"""SELECT o_orderkey AS id, lower(trim(' ' || o_orderpriority || ' ')) AS low,
    lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS padded,
    regexp_extract(o_orderpriority, '^([0-9])', 1) AS digit, regexp_replace(o_orderpriority, '[A-Z]+', 'x', 'g') AS masked,
    strftime(date_trunc('second', o_orderdate), '%Y-%m-%d %H:%M:%S') AS stamp,
    round(log2(o_totalprice), 6) AS log2_price, round(sqrt(o_totalprice), 6) AS root,
    CAST(round_even(CAST(o_orderkey AS DOUBLE) / 2, 0) AS BIGINT) AS half_even, greatest(o_orderkey % 5, 2) AS clipped,
    sha256(o_orderpriority) AS sha, {sql_h60("'x'", "o_orderkey")} AS h, array_to_string(string_split(o_orderpriority, '-'), '+') AS joined,
    list_contains(string_split(o_orderpriority, '-'), 'URGENT') AS urgent,
    coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END, '?') AS filled,
    printf('%.3f', CAST(o_orderkey AS DOUBLE) / 4) AS fixed3,
    '{{"k":' || (o_orderkey % 10) || ',"s":"' || o_orderstatus || '"}}' AS js FROM orders""")
def x01(t: Tables):
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    return t.read("orders").select(
        k.alias("id"), F.lower(F.trim(F.concat(F.lit(" "), p, F.lit(" ")))).alias("low"),
        F.lpad(k.cast("string"), 8, "0").alias("padded"), F.regexp_extract(p, "^([0-9])", 1).alias("digit"),
        F.regexp_replace(p, "[A-Z]+", "x").alias("masked"),
        F.date_format(F.date_trunc("second", "o_orderdate"), "yyyy-MM-dd HH:mm:ss").alias("stamp"),
        F.round(F.log2("o_totalprice"), 6).alias("log2_price"), F.round(F.sqrt("o_totalprice"), 6).alias("root"),
        F.bround(k.cast("double") / 2).cast("bigint").alias("half_even"),
        F.greatest(k % 5, F.lit(2).cast("bigint")).alias("clipped"), F.sha2(p, 256).alias("sha"), h60("x", k).alias("h"),
        F.array_join(F.split(p, "-"), "+").alias("joined"), F.array_contains(F.split(p, "-"), "URGENT").alias("urgent"),
        F.coalesce(F.when(k % 3 != 0, F.col("o_orderstatus")), F.lit("?")).alias("filled"),
        F.format_string("%.3f", k.cast("double") / 4).alias("fixed3"),
        F.to_json(F.struct((k % 10).alias("k"), F.col("o_orderstatus").alias("s"))).alias("js"))


@query("x07_x08_counter_json", """WITH c AS (SELECT o_custkey, o_orderpriority AS k, count(*) AS v FROM orders GROUP BY ALL)
    SELECT o_custkey, '{' || string_agg('"' || k || '":' || v, ',' ORDER BY k) || '}' AS counter,
    coalesce(max(CASE WHEN k = '1-URGENT' THEN v END), 0) AS urgent FROM c GROUP BY o_custkey""")
def x07(t: Tables):
    c = t.read("orders").groupBy("o_custkey", F.col("o_orderpriority").alias("k")).agg(F.count(F.lit(1)).alias("v"))
    m = F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v"))))
    return c.groupBy("o_custkey").agg(m.alias("m")).select(
        "o_custkey", F.to_json("m").alias("counter"),
        F.coalesce(F.try_element_at("m", F.lit("1-URGENT")), F.lit(0).cast("bigint")).alias("urgent"))


@query("p06_label_coding", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS coded,
    CASE WHEN l_linenumber % 3 = 0 THEN 1 WHEN l_linenumber % 3 = 1 THEN 0 END AS recoded FROM lineitem""")
def p06(t: Tables):
    word = F.when(F.col("l_returnflag") == "R", " Phishing ").otherwise("benign")
    return t.read("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", label_to_int(word).alias("coded"),
        recode_polarity((F.col("l_linenumber") % 3).cast("double")).alias("recoded"))


@query("p14_p15_interval_pct", """SELECT o_orderkey AS id, floor(o_totalprice) / 4 AS lower, floor(o_totalprice) / 2 AS upper,
    CASE WHEN o_orderkey % 2 = 0 THEN 100 * ((o_orderkey % 8) / 8) ELSE CAST(o_orderkey % 8 + 2 AS DOUBLE) END AS pct FROM orders""")
def p14(t: Tables):
    price = F.floor("o_totalprice")
    text = F.concat(F.lit("x ["), (price / 4).cast("string"), F.lit(", "), (price / 2).cast("string"), F.lit("]"))
    lo, hi = split_interval(text)
    k = F.col("o_orderkey")
    value = F.when(k % 2 == 0, (k % 8) / 8).otherwise((k % 8 + 2).cast("double"))
    return t.read("orders").select(k.alias("id"), lo.alias("lower"), hi.alias("upper"), display_pct(value).alias("pct"))


@query("x10_mean_sd_text", """SELECT o_custkey, printf('%.3f', avg(o_orderkey)) || ' ± ' || printf('%.3f', stddev_pop(o_orderkey)) AS txt,
    sha256(CAST(o_custkey AS VARCHAR) || '|k') AS h FROM orders GROUP BY o_custkey""")
def x10(t: Tables):
    return t.read("orders").groupBy("o_custkey").agg(
        mean_sd_text(F.avg("o_orderkey"), F.stddev_pop("o_orderkey")).alias("txt")).withColumn(
        "h", digest(F.col("o_custkey"), "k"))

"""Whole-table URL parsing: table in, table plus parse columns out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteval.functions import urls as U
from siteval.functions.hashing import digest
from siteval.operators.joins import settled
from siteval.operators.suffixes import SuffixRules, site_keys

PARSE_COLUMNS = [
    "parse_status", "scheme", "hostname_raw", "hostname_ascii", "is_ip", "is_private_ip",
    "public_suffix_icann", "public_suffix_private", "site_key_icann", "site_key_private",
    "is_private_suffix", "subdomain", "path", "query", "fragment", "port", "missing_scheme",
    "is_shortener",
]
URL_COLUMNS = ["normalized_url", "raw_url_hash", "normalized_url_hash"]
LIGHT_COLUMNS = ["parse_status", "hostname_ascii", "is_ip", "public_suffix_private",
                 "site_key_icann", "site_key_private", "is_private_suffix", "is_shortener",
                 "normalized_url"]


SPLIT_COLUMNS = ["_clean", "_scheme", "_missing_scheme", "_authority", "_path", "_query", "_fragment"]


def split_hosts(df: DataFrame, raw: str) -> DataFrame:
    """Split the text and find the host, before any name or address check."""
    kept = df.columns
    df = settled(df, [c for c in kept if c != raw], [raw])
    df = settled(U.with_split(df, raw), kept, SPLIT_COLUMNS)
    authority = F.col("_authority")
    df = df.withColumns({"_host": U.host_text(authority), "_port": U.port_text(authority),
                         "_broken": U.unbalanced_brackets(authority)})
    return df.withColumns({"hostname_raw": F.regexp_replace("_host", r"\.+$", ""),
                           "_portnum": U.port_number(F.col("_port"))})


def resolve_hosts(df: DataFrame, ip_first: bool = True) -> DataFrame:
    """ASCII host, IP flag and private-address flag.

    Plain names and IPv4 literals stay in native expressions; only IPv6
    literals and names that need Unicode preparation are read by Python.
    ``ip_first=False`` prepares names before looking for addresses, which
    rejects IPv6 literals (the order of older audits).
    """
    host = F.col("hostname_raw")
    rare = U.needs_python(host)
    # one scan: plain rows send NULL through the UDF instead of being read twice
    df = df.withColumn("_r", U.host_resolver(ip_first)(F.when(rare, host)))
    v4 = U.is_ipv4(host)
    return df.withColumns({
        "is_ip": F.when(rare, F.col("_r.is_ip")).otherwise(v4),
        "is_private_ip": F.when(rare, F.col("_r.is_private")).when(v4, U.ipv4_is_private(host)).otherwise(False),
        "hostname_ascii": F.when(rare, F.col("_r.host")).when(v4, host).otherwise(U.ldh_host(host)),
    }).drop("_r")


HOST_COLUMNS = ["_clean", "_scheme", "_missing_scheme", "_path", "_query", "_fragment", "_host", "_port", "_portnum",
                "_broken", "hostname_raw", "hostname_ascii", "is_ip", "is_private_ip"]


def parse_urls(df: DataFrame, url_col: str, rules: SuffixRules, ip_first: bool = True,
               profile: str = "full") -> DataFrame:
    """Parse, classify and normalise every URL of a table.

    Narrow apart from the rule lookups; no row is dropped.
    """
    kept = df.columns
    df = settled(resolve_hosts(split_hosts(df, url_col), ip_first), kept, HOST_COLUMNS)
    df = site_keys(df, rules)
    clean, host = F.col("_clean"), F.col("hostname_ascii")
    scheme = F.col("_scheme")
    local = F.col("is_private_ip") | (host == "localhost") | (~F.col("is_ip") & ~F.contains(host, F.lit(".")))
    status = (
        F.when(clean.isNull(), "MISSING_URL")
        .when(F.col("_broken"), "MALFORMED_URL")
        .when(F.col("_host") == "", "MISSING_HOST")
        .when(host.isNull(), "MALFORMED_IDN_HOST")
        .when((F.col("_port") != "") & F.col("_portnum").isNull(), "MALFORMED_PORT")
        .when((scheme != "") & ~scheme.isin("http", "https"), "UNSUPPORTED_SCHEME")
        .when(local, "LOCAL_OR_PRIVATE_HOST")
        .when(F.col("_missing_scheme"), "MISSING_SCHEME_RECOVERABLE")
        .when(F.col("is_ip"), "VALID_IP_HOST_URL")
        .when(F.col("site_key_private") == "", "MALFORMED_OR_NONPUBLIC_DNS_HOST")
        .when(F.col("is_private_suffix"), "VALID_PRIVATE_SUFFIX_URL")
        .otherwise("VALID_PUBLIC_DNS_URL")
    )
    split_known = clean.isNotNull() & ~F.col("_broken")
    resolved = split_known & (F.col("_host") != "") & host.isNotNull()
    df = df.withColumns({"parse_status": status, "_split": split_known, "_resolved": resolved})
    df = settled(df, [c for c in df.columns if c not in ("_split", "_resolved")], ["_split", "_resolved"])
    df = df.withColumn("port", F.when(F.col("_resolved"), F.col("_portnum")))
    split_only = {"scheme": scheme, "path": F.col("_path"), "query": F.col("_query"), "fragment": F.col("_fragment")}
    resolved_only = {
        "hostname_ascii": host, "missing_scheme": F.col("_missing_scheme"),
        "is_shortener": F.col("site_key_private").isin(*U.SHORTENERS),
        **{c: F.col(c) for c in ("is_ip", "is_private_ip", "public_suffix_icann", "public_suffix_private",
                                 "site_key_icann", "site_key_private", "is_private_suffix", "subdomain")},
    }
    df = df.withColumns({
        **{n: F.when(F.col("_split"), e) for n, e in split_only.items()},
        **{n: F.when(F.col("_resolved"), e) for n, e in resolved_only.items()},
        "hostname_raw": F.when(F.col("_split") & (F.col("_host") != ""), F.col("hostname_raw")),
    })
    df = df.withColumn("normalized_url", U.normalized_url(
        clean, F.col("hostname_ascii"), F.col("scheme"), F.col("port"), F.col("is_ip"),
        F.col("path"), F.col("query")))
    if profile == "light":
        return df.select(*kept, *LIGHT_COLUMNS)
    df = df.withColumns({"raw_url_hash": digest(F.col(url_col)),
                         "normalized_url_hash": digest(F.col("normalized_url"))})
    return df.select(*kept, *PARSE_COLUMNS, *URL_COLUMNS)


VALID_DNS = ("VALID_PUBLIC_DNS_URL", "VALID_PRIVATE_SUFFIX_URL")


def eligible_dns(df: DataFrame) -> DataFrame:
    return df.where(F.col("parse_status").isin(*VALID_DNS))


def with_template_keys(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "template_key": U.template_key_v1(F.col("hostname_ascii"), F.col("site_key_private"),
                                          F.col("path"), F.col("query")),
        "template_hash": U.template_key_v2(F.col("normalized_url")),
    })

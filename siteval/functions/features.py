"""The 22 predictors and the audit properties, all native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteval.functions.urls import url_clean

# Predictor names in model order.
FEATURES = [
    "url_length", "hostname_length", "path_length", "query_length", "path_depth",
    "subdomain_depth", "has_query", "has_port", "is_root_path", "digit_count",
    "digit_ratio", "hyphen_count", "dot_count", "special_char_count",
    "percent_encoded_count", "char_entropy", "is_ip", "is_private_suffix", "has_www",
    "is_https", "is_missing_scheme", "has_punycode",
]

# Feature sets removed (AB1-AB4) or kept (AB5a, AB5b) by an ablation.
ABLATION_DROPS = {
    "AB1": ["is_private_suffix", "has_www", "subdomain_depth", "dot_count"],
    "AB2": ["is_private_suffix"],
    "AB3": ["is_https", "is_missing_scheme"],
    "AB4": ["url_length", "hostname_length", "path_length", "query_length"],
}
ABLATION_KEEPS = {
    "AB5a": ["digit_count", "digit_ratio", "hyphen_count", "dot_count", "special_char_count",
             "percent_encoded_count"],
    "AB5b": ["path_depth", "subdomain_depth", "has_query", "has_port", "is_root_path"],
}


ABLATIONS = [*ABLATION_DROPS, *ABLATION_KEEPS]


def ablation_features(ablation: str | None) -> list[str]:
    if ablation is None:
        return list(FEATURES)
    if ablation in ABLATION_KEEPS:
        return list(ABLATION_KEEPS[ablation])
    return [f for f in FEATURES if f not in ABLATION_DROPS[ablation]]


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.coalesce(url_clean(text), F.lit(""))


def _flag(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).cast("int")


def _occurrences(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are in ``chars``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def char_entropy(text: Column) -> Column:
    """Shannon entropy in bits over the characters of the text."""
    total = F.length(text).cast("double")
    letters = F.array_sort(F.array_distinct(F.split(text, "")))

    def term(acc: Column, ch: Column) -> Column:
        p = (total - F.length(F.replace(text, ch, F.lit("")))) / total
        return acc - p * F.log2(p)

    summed = F.aggregate(F.filter(letters, lambda ch: ch != ""), F.lit(0.0), term)
    return F.when(text == "", 0.0).otherwise(summed)


def url_features(df: DataFrame, raw: str = "raw_url") -> DataFrame:
    """Add the 22 predictors to a parsed table."""
    text = _stripped(_text(raw))
    host, path, query = _text("hostname_ascii"), _stripped(_text("path")), _stripped(_text("query"))
    sub, scheme = _text("subdomain"), _text("scheme")
    explicit = F.contains(text, F.lit("://"))
    scheme = F.when((scheme == "") & explicit, F.lower(F.substring_index(text, "://", 1))).otherwise(scheme)
    digits = F.regexp_count(F.concat(host, path, query), F.lit(r"\p{Nd}"))
    features = {
        "url_length": F.length(text), "hostname_length": F.length(host), "path_length": F.length(path),
        "query_length": F.length(query), "path_depth": _occurrences(path, "/"),
        "subdomain_depth": _occurrences(sub, "."), "has_query": _flag(query != ""),
        "has_port": _flag(~F.col("port").isin(80, 443)),
        "is_root_path": _flag(path.isin("", "/") & (query == "")),
        "digit_count": digits,
        "digit_ratio": F.when(F.length(text) > 0, digits / F.length(text)).otherwise(0.0),
        "hyphen_count": _occurrences(host, "-"), "dot_count": _occurrences(host, "."),
        "special_char_count": _occurrences(text, "@?=&#~%"),
        "percent_encoded_count": F.regexp_count(text, F.lit("%[0-9A-Fa-f]{2}")),
        "char_entropy": char_entropy(host),
        "is_ip": _flag(F.col("is_ip")), "is_private_suffix": _flag(F.col("is_private_suffix")),
        "has_www": _flag((F.substring_index(sub, ".", 1) == "www") | F.startswith(host, F.lit("www."))),
        "is_https": _flag(scheme == "https"),
        "is_missing_scheme": _flag(F.coalesce(F.col("missing_scheme"), F.lit(False)) | (~explicit & (text != ""))),
        "has_punycode": _flag(F.contains(_text("hostname_raw"), F.lit("xn--"))),
    }
    return df.withColumns(features)


def audit_properties(df: DataFrame, raw: str = "raw_url") -> DataFrame:
    """Presence flags and lengths of the first audit, as 0/1 and integers."""
    host, path, query = _text("hostname_ascii"), _text("path"), _text("query")
    return df.withColumns({
        "root_only": _flag(path.isin("", "/") & (query == "")),
        "path_present": _flag(~path.isin("", "/")),
        "query_present": _flag(query != ""),
        "fragment_present": _flag(_text("fragment") != ""),
        "https": _flag(F.col("scheme") == "https"),
        "www": _flag(F.startswith(host, F.lit("www."))),
        "punycode": _flag(F.contains(host, F.lit("xn--"))),
        "percent_encoded": _flag(F.contains(F.col(raw), F.lit("%"))),
        "hostname_length": F.length(host), "path_length": F.length(path),
        "url_length": F.length(_text(raw)),
    })


def structural_properties(df: DataFrame, raw: str = "raw_url") -> DataFrame:
    """Properties of the second audit; subdomain depth counts labels here."""
    host, path, query, sub = _text("hostname_ascii"), _text("path"), _text("query"), _text("subdomain")
    return df.withColumns({
        "query_present": _flag(query != ""),
        "root_only": _flag(path.isin("", "/") & (query == "")),
        "www": _flag(F.startswith(host, F.lit("www."))),
        "encoded": _flag(F.col(raw).rlike("%[0-9A-Fa-f]{2}")),
        "punycode": _flag(F.contains(host, F.lit("xn--"))),
        "subdomain_depth": F.when(sub == "", 0).otherwise(_occurrences(sub, ".") + 1),
        "url_length": F.length(_text(raw)), "hostname_length": F.length(host),
        "path_length": F.length(path),
    })


def error_properties(df: DataFrame) -> DataFrame:
    """Properties used by the error taxonomy, with derived depth and parameters."""
    host, path, query = _text("hostname_ascii"), _text("path"), _text("query")
    segments = F.size(F.filter(F.split(path, "/"), lambda s: s != ""))
    params = F.when(query == "", 0).otherwise(F.size(F.filter(F.split(query, "&"), lambda s: s != "")))
    return df.withColumns({
        "hostname_has_digit": _flag(host.rlike("[0-9]")),
        "root_path_empty_query": _flag(path.isin("", "/") & (query == "")),
        "com_or_org": _flag(F.col("public_suffix_icann").isin("com", "org")),
        "https": _flag(F.col("scheme") == "https"),
        "derived_path_depth": segments, "derived_query_parameter_count": params,
    })

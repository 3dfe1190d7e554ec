"""URL text as Spark column expressions.

The splitter is permissive: it accepts hosts and paths that a strict URI
parser rejects, because malformed rows have to be counted, not dropped.
Each ``with_*`` step adds columns to the DataFrame so that later steps can
reuse them without repeating the string work.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Link shortener sites.
SHORTENERS = (
    "bit.ly", "tinyurl.com", "t.co", "goo.gl", "ow.ly", "buff.ly",
    "is.gd", "cutt.ly", "rebrand.ly", "shorturl.at", "tiny.cc", "rb.gy",
)

# Dotted prefixes of the IPv4 networks that are private, loopback, link-local or reserved.
PRIVATE_V4 = (
    r"0\.", r"10\.", r"127\.", r"169\.254\.", r"172\.(?:1[6-9]|2[0-9]|3[01])\.", r"192\.0\.0\.[0-7]$",
    r"192\.0\.0\.17[01]$", r"192\.0\.2\.", r"192\.168\.", r"198\.1[89]\.", r"198\.51\.100\.",
    r"203\.0\.113\.", r"2(?:4[0-9]|5[0-5])\.",
)

_BLANK = r"[\s\p{Z}\x1c-\x1f\x85]+"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
_LABEL = r"[a-z0-9](?:[a-z0-9\-]{0,61}[a-z0-9])?"
_LDH_HOST = rf"^{_LABEL}(?:\.{_LABEL})*$"


# ---------------------------------------------------------------- text and split

def url_clean(raw: Column) -> Column:
    """Trimmed text; NULL when the value is missing or blank."""
    text = F.regexp_replace(raw, f"^{_BLANK}|{_BLANK}$", "")
    return F.when(text != "", text)


# Scheme prefix; what follows is authority (behind //), path, ?query, #fragment.
_SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*"
_PIECES = {
    "authority": rf"^(?:{_SCHEME}:)?//([^/?#]*)",
    "path": rf"^(?:{_SCHEME}:)?(?://[^/?#]*)?([^?#]*)",
    "query": r"^[^?#]*\?([^#]*)",
    "fragment": r"#(.*)$",
}


def with_split(df: DataFrame, raw: str, prefix: str = "_") -> DataFrame:
    """Scheme, authority, path, query, fragment and ``missing_scheme``.

    Text without a scheme is read again as ``//text``.  Each piece is one
    anchored pattern over one column, which keeps the expressions small when
    filters are pushed down through them.
    """
    p = prefix
    df = df.withColumn(p + "clean", url_clean(F.col(raw)))
    text = F.translate(F.col(p + "clean"), "\t\r\n", "")
    scheme = F.lower(F.regexp_extract(text, rf"^({_SCHEME}):", 1))
    df = df.withColumns({p + "text": text, p + "scheme": scheme})
    df = df.withColumns({
        p + "missing_scheme": F.col(p + "scheme") == "",
        p + "text": F.concat(F.when(F.col(p + "scheme") == "", "//").otherwise(""), F.col(p + "text")),
    })
    pieces = {p + n: F.regexp_extract(F.col(p + "text"), pattern, 1) for n, pattern in _PIECES.items()}
    return df.withColumns(pieces).drop(p + "text")


_HOST = r"^(?:.*@)?(?:[^\[]*\[([^\]]*).*|([^:\[]*)(?::.*)?)$"
_PORT = r"^(?:.*@)?(?:[^\[]*\[[^\]]*\]?[^:]*(?::(.*))?|[^:\[]*(?::(.*))?)$"


def host_text(authority: Column) -> Column:
    """Host with userinfo, port and brackets removed, lowered."""
    return F.lower(F.regexp_replace(authority, _HOST, "$1$2"))


def port_text(authority: Column) -> Column:
    return F.regexp_replace(authority, _PORT, "$1$2")


def unbalanced_brackets(authority: Column) -> Column:
    return F.contains(authority, F.lit("[")) != F.contains(authority, F.lit("]"))


def port_number(text: Column) -> Column:
    """0 to 65535, else NULL."""
    return F.when(text.rlike(r"^0*(?:[0-9]{1,4}|[1-5][0-9]{4}|6[0-4][0-9]{3}|65[0-4][0-9]{2}|655[0-2][0-9]|6553[0-5])$"),
                  text.try_cast("int"))


# ---------------------------------------------------------------- IP literals

def is_ipv4(host: Column) -> Column:
    return host.rlike(_IPV4)


def ipv4_is_private(host: Column) -> Column:
    """Membership in the fixed private networks, for text that is an IPv4 literal."""
    return host.rlike("^(?:" + "|".join(PRIVATE_V4) + ")")


# ---------------------------------------------------------------- host names

def needs_python(host: Column) -> Column:
    """IPv6 literals and names that need Unicode preparation."""
    return F.coalesce(host.rlike(r"[^\x00-\x7f]|:|(?:^|\.)xn--"), F.lit(False))


def ldh_host(host: Column) -> Column:
    """The host itself when it is a valid ASCII name, else NULL."""
    good = host.rlike(_LDH_HOST) & ~host.rlike(r"(?:^|\.)[^.]{2}--") & (F.length(host) <= 253)
    return F.when(good, host)


def host_resolver(ip_first: bool = True):
    """Arrow UDF for the rare hosts: ASCII form, IP flag, private flag.

    Everything it needs is inside, so workers do not have to import this package.
    """
    def to_ascii(name):
        try:
            import idna
            return idna.encode(name, uts46=True, std3_rules=True).decode("ascii").lower()
        except (ImportError, UnicodeError):  # idna's own errors are UnicodeErrors
            return None

    def resolve_one(name):
        import ipaddress
        if name is not None and not ip_first:
            name = to_ascii(name)
        if name is None:
            return None, False, False
        try:
            ip = ipaddress.ip_address(name)
        except ValueError:
            return (to_ascii(name) if ip_first else name), False, False
        return ip.compressed, True, ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved

    def resolve(names):
        import pandas
        at, found = pandas.factorize(names)  # -1, the last entry, for the plain rows
        known = pandas.DataFrame([*map(resolve_one, found), resolve_one(None)], columns=["host", "is_ip", "is_private"])
        return known.take(at).reset_index(drop=True)

    resolve.__annotations__ = {"names": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(resolve, "host string, is_ip boolean, is_private boolean")


# ---------------------------------------------------------------- derived text

def normalized_url(raw_clean: Column, host: Column, scheme: Column, port: Column,
                   is_ip: Column, path: Column, query: Column) -> Column:
    """Scheme and host lowered, default ports and fragments dropped."""
    shown = F.when(is_ip & F.contains(host, F.lit(":")), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host)
    default = ((scheme == "http") & (port == 80)) | ((scheme == "https") & (port == 443))
    keep_port = F.coalesce((port != 0) & ~default, F.lit(False))
    text = F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")),
        F.lit("//"), shown,
        F.when(keep_port, F.concat(F.lit(":"), port.cast("string"))).otherwise(F.lit("")),
        F.when(path != "", path).otherwise(F.lit("/")),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
    )
    unusable = F.concat(F.lit("UNPARSEABLE:"), F.coalesce(raw_clean, F.lit("")))
    return F.when(F.coalesce(host, F.lit("")) != "", text).otherwise(unusable)


def template_key_v1(host: Column, site: Column, path: Column, query: Column) -> Column:
    """What is left of a URL when site, numbers and tokens are masked."""
    name, site = F.coalesce(host, F.lit("")), F.coalesce(site, F.lit(""))
    cut = F.rtrim(F.substr(name, F.lit(1), F.length(name) - F.length(site)), F.lit("."))
    sub = F.when((site != "") & F.endswith(name, site), cut).otherwise(name)
    text = F.concat(sub, F.lit("/"), F.coalesce(path, F.lit("")), F.lit("?"), F.coalesce(query, F.lit("")))
    # Mask patterns, applied in this order.
    masks = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "<EMAIL>"),
        (r"\b[0-9a-fA-F]{16,}\b", "<HEX>"),
        (r"\b\d{6,}\b", "<NUM>"),
        (r"[A-Za-z0-9_-]{24,}", "<TOKEN>"),
    )
    for pattern, mark in masks:
        text = F.regexp_replace(text, pattern, mark)
    return F.lower(text)


def template_key_v2(normalized: Column) -> Column:
    text = F.lower(normalized)
    # Mask patterns, applied in this order.
    masks = (
        (r"[0-9a-f]{8}-[0-9a-f-]{27,}", "<uuid>"),
        (r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}", "<email>"),
        (r"\d{5,}", "<num>"),
        (r"(?<=[=/._-])[a-z0-9_-]{20,}(?=[$&/?#._-])", "<token>"),
    )
    for pattern, mark in masks:
        text = F.regexp_replace(text, pattern, mark)
    return F.sha2(text, 256)


def anonymous_site(site: Column, salt: str) -> Column:
    return F.concat(F.lit("SITE-"), F.upper(F.substring(F.sha2(F.concat(F.lit(salt), site), 256), 1, 12)))

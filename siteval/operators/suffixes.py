"""Public-suffix rules and registrable-site keys.

Rules become one row per rule text with a bit mask of kinds.  A host is
matched by one hash lookup per suffix depth (deepest rule decides how many),
so the rows themselves are never exploded, grouped or shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteval.operators.joins import settled, skew_join

# Largest rule table that is broadcast; longer ones are met by salted joins.
BROADCAST_RULES = 200_000

# Bit of a rule: kind x section.
BITS = {("exact", "icann"): 1, ("exact", "private"): 2, ("wildcard", "icann"): 4,
        ("wildcard", "private"): 8, ("exception", "icann"): 16, ("exception", "private"): 32}


@dataclass(frozen=True)
class SuffixRules:
    """Rule masks plus the two numbers that shape the plan."""

    table: DataFrame  # rule_key, mask
    depth: int
    rows: int


def classify_rule(text: Column) -> tuple[Column, Column]:
    """Kind of a rule line and the rule without its marker."""
    kind = (F.when(F.startswith(text, F.lit("!")), "exception")
            .when(F.startswith(text, F.lit("*.")), "wildcard").otherwise("exact"))
    return kind, F.regexp_replace(text, r"^(?:!|\*\.)", "")


def read_psl(spark, path: str) -> DataFrame:
    """Rule file to (rule, kind, section); needs line order, so one file is one row."""
    lines = (spark.read.text(path, wholetext=True)
             .select(F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line")))
    return parse_rule_lines(lines)


PRIVATE_MARKER = "// ===BEGIN PRIVATE DOMAINS==="


def parse_rule_lines(lines: DataFrame) -> DataFrame:
    """(pos, line) rows to rules; lines behind the marker are private."""
    text = F.lower(F.trim("line"))
    marker = lines.where(F.trim("line") == PRIVATE_MARKER).agg(F.max("pos"))
    section = F.when(F.col("pos") > F.coalesce(marker.scalar(), F.lit(1 << 60)), "private").otherwise("icann")
    kind, rule = classify_rule(text)
    return (lines.where((text != "") & ~F.startswith(text, F.lit("//")))
            .select(rule.alias("rule"), kind.alias("kind"), section.alias("section")).distinct())


def compile_rules(rules: DataFrame) -> SuffixRules:
    """Pack (rule, kind, section) rows; looks at the table's size once."""
    bit = F.lit(0)
    for (kind, section), value in BITS.items():
        bit = F.when((F.col("kind") == kind) & (F.col("section") == section), value).otherwise(bit)
    table = rules.groupBy(F.col("rule").alias("rule_key")).agg(F.bit_or(bit).alias("mask"))
    size = table.agg(F.count(F.lit(1)).alias("n"),
                     F.max(F.size(F.split("rule_key", r"\."))).alias("depth")).first()
    return SuffixRules(table, int(size["depth"] or 1), int(size["n"]))


def _longest(mask: dict[int, Column], labels: Column, exact: int, wild: int, exception: int) -> Column:
    """Suffix length in labels: an exception beats the longest other rule."""
    def has(d: int, bits: int) -> Column:
        return F.coalesce(mask[d].bitwiseAND(bits) != 0, F.lit(False))

    lengths = [F.lit(0)]
    for d in mask:
        lengths.append(F.when(has(d, exact), d).otherwise(0))
        lengths.append(F.when(has(d, wild) & (labels > d), d + 1).otherwise(0))
    barred = [F.when(has(d, exception), d - 1) for d in sorted(mask, reverse=True)]
    return F.coalesce(*barred, F.greatest(*lengths))


def site_keys(df: DataFrame, rules: SuffixRules, host: str = "hostname_ascii",
              is_ip: str | None = "is_ip") -> DataFrame:
    """Add both site keys, both suffixes, subdomain and the private-suffix flag."""
    name = F.when(~F.col(is_ip), F.col(host)) if is_ip else F.col(host)
    df = df.withColumn("_name", name)
    df = df.withColumn("_labels", F.length("_name") - F.length(F.replace("_name", F.lit("."), F.lit(""))) + 1)
    masks: dict[int, Column] = {}
    for d in range(1, rules.depth + 1):
        key, mask = f"_suffix{d}", f"_mask{d}"
        df = df.withColumn(key, F.when(F.col("_labels") >= d, F.substring_index(F.col("_name"), ".", -d)))
        side = rules.table.select(F.col("rule_key").alias(key), F.col("mask").alias(mask))
        if rules.rows <= BROADCAST_RULES:
            df = df.join(F.broadcast(side), key, "left")
        else:
            df = skew_join(df, side, key, "left")
        masks[d] = F.col(mask)
    labels = F.col("_labels")
    df = df.withColumns({"_icann": _longest(masks, labels, 1, 4, 16), "_all": _longest(masks, labels, 3, 12, 48)})
    df = settled(df, [c for c in df.columns if c not in ("_icann", "_all")], ["_icann", "_all"])

    def last(n: Column) -> Column:
        return F.call_function("substring_index", F.col("_name"), F.lit("."), -n)

    def key(n: Column) -> Column:
        return F.when((n > 0) & (labels > n), last(n + 1)).otherwise("")

    def suffix(n: Column) -> Column:
        return F.when(n > 0, last(n)).otherwise("")

    front = labels - F.col("_all") - 1
    sub = F.when(front > 0, F.call_function("substring_index", F.col("_name"), F.lit("."), front)).otherwise("")
    named, literal = F.col("_name").isNotNull(), F.col(host).isNotNull()
    out = {
        "public_suffix_icann": suffix(F.col("_icann")), "public_suffix_private": suffix(F.col("_all")),
        "site_key_icann": key(F.col("_icann")), "site_key_private": key(F.col("_all")),
        "subdomain": sub,
    }
    blank = {"site_key_icann": F.col(host), "site_key_private": F.col(host)}
    cols = {n: F.when(named, e).when(literal, blank.get(n, F.lit(""))) for n, e in out.items()}
    cols["is_private_suffix"] = F.when(named, F.col("_all") != F.col("_icann")).when(literal, False)
    df = df.withColumns(cols)
    return df.drop(*[c for c in df.columns if c in ("_name", "_labels", "_icann", "_all")
                     or c.startswith(("_suffix", "_mask"))])

"""Key joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 1000


def _keys(on) -> list[str]:
    return [on] if isinstance(on, str) else list(on)


def skew_join(left: DataFrame, right: DataFrame, on, how: str = "left") -> DataFrame:
    """Join rows (left, inner, semi or anti) to a table with one row per key.

    Keys holding more than a thousandth of the left rows are fewer than a
    thousand; their right rows are broadcast and answer at once.  The left rows
    they answered then carry a value of their own in the join key, so they
    spread over all tasks and match nothing.  No row is repeated, and hot keys
    take one more count of the left keys.  Where keys are unique on the left,
    a plain join does.
    """
    on = _keys(on)
    values = [c for c in right.columns if c not in on]
    counts = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    often = counts.where(F.col("_n") * HOT_KEYS > total).select(*on)
    known = right.withColumn("_hit", F.lit(True))
    answers = often.join(known, on, "left").select(
        *on, *[F.col(v).alias(f"_hot_{v}") for v in values], F.coalesce("_hit", F.lit(False)).alias("_hot"))
    marked = left.join(F.broadcast(answers), on, "left")
    apart = F.when(F.col("_hot").isNotNull(), F.xxhash64(*[F.col(c) for c, t in left.dtypes if not t.startswith(("map", "variant"))]))
    cold = known.withColumn("_apart", F.lit(0).cast("bigint"))
    joined = marked.withColumn("_apart", F.coalesce(apart, F.lit(0).cast("bigint"))).join(cold, [*on, "_apart"], "left")
    hit = F.coalesce("_hot", "_hit", F.lit(False))
    joined = joined.withColumns({v: F.when(F.col("_hot").isNotNull(), F.col(f"_hot_{v}")).otherwise(F.col(v)) for v in values})
    if how in ("inner", "left_semi", "left_anti"):
        joined = joined.where(~hit if how == "left_anti" else hit)
    elif how != "left":
        raise ValueError(how)
    return joined.select(*left.columns, *(values if how in ("left", "inner") else []))


def join_null_safe(left: DataFrame, right: DataFrame, on, how: str = "inner", broadcast: bool = False) -> DataFrame:
    """Equi-join in which NULL keys are a group of their own."""
    on = _keys(on)
    side = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on])
    return left.join(F.broadcast(side) if broadcast else side, same, how).drop(*[f"_r_{c}" for c in on])


def hot_key_join(left: DataFrame, right: DataFrame, on, count: str, spread: list[str]) -> DataFrame:
    """Left join to a table with one row per key that knows how many left rows
    each key has.

    Keys holding more than a thousandth of all rows are fewer than a thousand,
    so they are broadcast and answered at once; their rows then spread over
    all tasks by values that match nothing.  All other rows meet ``right`` by key, and
    nothing is repeated.
    """
    on = _keys(on)
    values = [c for c in right.columns if c not in on and c != count]
    total = right.agg(F.sum(count)).scalar()
    hot = right.where(F.col(count) * HOT_KEYS > total)
    hot = hot.select(*on, *[F.col(v).alias(f"_hot_{v}") for v in values], F.lit(True).alias("_hot"))
    marked = left.join(F.broadcast(hot), on, "left")
    salt = F.when(F.col("_hot"), F.xxhash64(*spread)).otherwise(F.lit(0).cast("bigint"))
    cold = right.select(*on, *values, F.lit(0).cast("bigint").alias("_salt"))
    joined = marked.withColumn("_salt", salt).join(cold, [*on, "_salt"], "left")
    joined = joined.withColumns({v: F.when(F.col("_hot"), F.col(f"_hot_{v}")).otherwise(F.col(v)) for v in values})
    return joined.drop("_salt", "_hot", *[f"_hot_{v}" for v in values])


def join_one_to_one(a: DataFrame, b: DataFrame, key) -> DataFrame:
    """Inner join that fails when a key repeats on either side."""
    key = _keys(key)

    def guarded(df: DataFrame) -> DataFrame:
        others = [c for c in df.columns if c not in key]
        n = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in others])
        return n.where(F.assert_true(F.col("_n") == 1, "key is not unique").isNull()).select(*df.columns)

    return guarded(a).join(guarded(b), key, "inner")


def restrict(df: DataFrame, ids: DataFrame, key) -> DataFrame:
    """Rows whose key is in ``ids`` (row ids, which repeat on neither side)."""
    return df.join(ids.select(*_keys(key)), key, "left_semi")


def missing_ids(df: DataFrame, ids: DataFrame, key) -> DataFrame:
    """Requested ids that the table does not have; empty when complete."""
    key = _keys(key)
    return ids.select(*key).distinct().join(df.select(*key).distinct(), key, "left_anti")


def align(tables: list[DataFrame], key) -> DataFrame:
    """Columns of several one-row-per-key tables side by side."""
    return reduce(lambda x, y: join_one_to_one(x, y, key), tables)


def flag_seen(rows: DataFrame, seen: DataFrame, key: str, out: str = "seen") -> DataFrame:
    """True where the row's key occurs in ``seen`` at all."""
    keys = seen.where(F.col(key).isNotNull()).select(key).distinct().withColumn("_hit", F.lit(True))
    return skew_join(rows, keys, key).withColumn(out, F.coalesce("_hit", F.lit(False))).drop("_hit")


def remove_keys(rows: DataFrame, bad: DataFrame, key) -> DataFrame:
    return skew_join(rows, bad.select(*_keys(key)).distinct(), key, "left_anti")


def assign(rows: DataFrame, mapping: DataFrame, key) -> DataFrame:
    """Attach the columns of a key → value table; unmatched rows keep NULL."""
    return skew_join(rows, mapping, key, "left")


def lookup(rows: DataFrame, dim: DataFrame, keys, what: str = "lookup") -> DataFrame:
    """Composite-key lookup where a missing key is an error."""
    found = skew_join(rows, dim.withColumn("_found", F.lit(True)), keys, "left")
    ok = F.assert_true(F.col("_found").isNotNull(), f"{what}: key not found")
    return found.where(ok.isNull()).drop("_found")


def lookup_count(rows: DataFrame, freq: DataFrame, key, count: str) -> DataFrame:
    """Frequency lookup, 0 for keys never counted."""
    return skew_join(rows, freq, key, "left").withColumn(count, F.coalesce(count, F.lit(0)))


def compare_sides(df: DataFrame, side: str, values: tuple[str, str], by: list[str],
                  measures: list[str]) -> DataFrame:
    """Measures of two regimes next to each other, one pass and no self join."""
    aggs: list[Column] = []
    for m in measures:
        for v in values:
            aggs.append(F.max(F.when(F.col(side) == v, F.col(m))).alias(f"{m}_{v}"))
    return df.groupBy(*by).agg(*aggs)


def reconcile(a: DataFrame, b: DataFrame, on, value: str, tol: float = 1e-6) -> DataFrame:
    """Point estimate against recorded value: difference and within-tolerance flag."""
    on = _keys(on)
    left = a.select(*on, F.col(value).alias("value"))
    right = b.select(*on, F.col(value).alias("recorded"))
    both = left.join(right, on, "full")
    diff = F.abs(F.col("value") - F.col("recorded"))
    return both.withColumns({"abs_diff": diff, "within": F.coalesce(diff <= tol, F.lit(False))})


def check_ledger(frame: DataFrame, ledger: DataFrame, ordinal: str, key: str) -> DataFrame:
    """Positions where frame and ledger disagree; empty when consistent."""
    a = frame.select(ordinal, F.col(key).alias("frame_key"))
    b = ledger.select(ordinal, F.col(key).alias("ledger_key"))
    return a.join(b, ordinal, "full").where(~F.col("frame_key").eqNullSafe(F.col("ledger_key")))


def settled(df: DataFrame, kept: list[str], cols: list[str]) -> DataFrame:
    """The same rows with ``cols`` as plain columns.

    A filter or semi join written behind the parser would otherwise be pushed
    below it with every nested expression spelled out in full, including the
    UDF.  A one-element generator is the point it cannot cross.  What follows
    it is also a method of its own in the generated code: a method over 8,000
    bytes is never compiled by the JVM, but interpreted for every row.
    """
    return df.select(*kept, F.inline(F.array(F.struct(*cols))))

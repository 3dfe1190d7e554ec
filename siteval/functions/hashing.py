"""Deterministic hashing used in place of random number generators.

``h60`` is the first 60 bits of a SHA-256 digest.  A split, sample or
bootstrap draw made from it depends only on the row's own key, so a lost
executor or another partitioning gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 60
_HEX = HASH_BITS // 4


def as_column(part) -> Column:
    return part if isinstance(part, Column) else F.lit(part)


def digest(*parts) -> Column:
    """SHA-256 hex of the parts joined by ``|``; NULL counts as empty text."""
    texts = [F.coalesce(as_column(p).cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat_ws("|", *texts), 256)


def hex_lane(hexdigest: Column, lane: int = 0) -> Column:
    """60-bit integer number ``lane`` of a digest, which holds four of them."""
    return F.conv(F.substring(hexdigest, 1 + _HEX * lane, _HEX), 16, 10).cast("bigint")


LANES = 256 // HASH_BITS


def h60(*parts) -> Column:
    return hex_lane(digest(*parts))


def unit(*parts) -> Column:
    """Uniform double in [0, 1)."""
    return h60(*parts) / F.lit(float(1 << HASH_BITS))

"""Scans with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteval.operators.suffixes import read_psl  # noqa: F401  (rule-file scan)

# Columns of the raw record table, in order.
CANONICAL_COLUMNS = [
    "record_id", "raw_url", "label", "source_name", "source_record_id", "source_snapshot",
    "source_timestamp_1", "source_timestamp_2", "source_semantics", "acquisition_date",
    "source_license", "source_url_or_reference", "crawl_id", "crawl_timestamp", "tranco_list_id",
    "tranco_rank", "target_brand", "submission_time", "verification_time", "verified", "online",
    "target", "phish_detail_url",
]
_INTEGERS = {"label", "tranco_rank"}
RAW_SCHEMA = T.StructType([
    T.StructField(c, T.IntegerType() if c in _INTEGERS else T.StringType()) for c in CANONICAL_COLUMNS])

FEED_SCHEMA = ("phish_id string, url string, phish_detail_url string, submission_time string, "
               "verification_time string, verified string, online string, target string")
LEGACY_SCHEMA = "URL string, ClassLabel double"
RANKED_SCHEMA = "rank int, domain string"
CRAWL_LINE_SCHEMA = ("url string, urlkey string, timestamp string, status string, mime string, `mime-detected` string, "
                     "digest string, recordid string, filename string, offset string, length string, "
                     "site_frame_id string, tranco_rank int, tranco_domain string")
CORPUS_SCHEMA = "combined_row_id string, raw_url string, label string, site_key_private string, site_key_icann string"


def read_csv(spark: SparkSession, path, schema, columns: list[str] | None = None) -> DataFrame:
    """Header CSV with a declared schema; ``.bz2`` files are read in splits.
    Bytes that are no UTF-8 become replacement characters.  The header is
    checked against the schema."""
    df = (spark.read.schema(schema).option("header", True).option("enforceSchema", False)
          .option("multiLine", False).option("escape", '"').option("mode", "FAILFAST").csv(path))
    return df.select(*columns) if columns else df


def read_ranked_list(spark: SparkSession, path: str, lo: int, hi: int) -> DataFrame:
    """Headerless rank,domain list, bounded by rank."""
    df = spark.read.schema(RANKED_SCHEMA).csv(path)
    return df.where(F.col("rank").between(lo, hi)).select("rank", F.lower(F.trim("domain")).alias("domain"))


def read_corpus_jsonl(spark: SparkSession, path, schema: str = CORPUS_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def crawl_columns(df: DataFrame, crawl_id: str) -> DataFrame:
    """Crawl-index fields under their stored names."""
    # Stored name, field name of the index.
    renames = [("url", "url"), ("urlkey", "urlkey"), ("crawl_timestamp", "timestamp"), ("status", "status"),
               ("mime", "mime"), ("mime_detected", "mime-detected"), ("digest", "digest"), ("record_id", "recordid"),
               ("warc_filename", "filename"), ("warc_offset", "offset"), ("warc_length", "length")]
    return df.select("site_frame_id", "tranco_rank", "tranco_domain", F.lit(crawl_id).alias("crawl_id"),
                     *[F.col(f"`{old}`").alias(new) for new, old in renames])


def read_crawl_index(spark: SparkSession, path, crawl_id: str) -> DataFrame:
    return crawl_columns(spark.read.schema(CRAWL_LINE_SCHEMA).json(path), crawl_id)


def digest_files(spark: SparkSession, path) -> DataFrame:
    """SHA-256 and size of every file under a path or glob."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"),
                        F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def load_registered(spark: SparkSession, entries: DataFrame, schema) -> DataFrame:
    """Load every CSV a manifest names (path, experiment_id, sha256, rows) in
    one scan and tag rows by experiment.  A changed file or a wrong row count
    is an error."""
    listed = entries.select("path", "experiment_id", "sha256", "rows")
    paths = [r["path"] for r in listed.select("path").distinct().collect()]  # a manifest: one row per file
    observed = digest_files(spark, paths).select("path", F.col("sha256").alias("found"))
    changed = listed.join(observed, "path", "left").where(~F.col("sha256").eqNullSafe(F.col("found")))
    if changed.limit(1).count():
        raise RuntimeError("a registered input differs from its recorded hash")
    rows = read_csv(spark, paths, schema)
    rows = rows.withColumn("path", F.regexp_replace(F.input_file_name(), "^file:/*", "/"))
    counts = rows.groupBy("path").agg(F.count(F.lit(1)).alias("got"))
    if listed.join(counts, "path", "left").where(~F.col("rows").eqNullSafe(F.col("got"))).limit(1).count():
        raise RuntimeError("a registered input has another number of rows")
    return rows.join(F.broadcast(listed.select("path", "experiment_id")), "path", "inner").drop("path")


def load_contract(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One-document JSON settings (grids, feature groups) with a declared schema."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)

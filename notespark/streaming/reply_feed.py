"""Cache rows from replies that keep arriving as files.

Replies are cached one by one as they come in. Here a stream reads them, parses them and appends cache rows to
a log; the file sink commits each batch once. The cache is the log's last row per key, taken when it is read,
so a batch never rewrites older entries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from notespark import params
from notespark.operators.cache import upsert
from notespark.operators.replies import parse_findings

REPLY_SCHEMA = "key string, raw_reply string, ts timestamp_ntz"
_LOG_SCHEMA = "key string, value string, ts timestamp_ntz, ttl_ms bigint"


def cache_rows(replies: DataFrame, ttl_ms: int = params.CACHE_TTL_MS) -> DataFrame:
    """Readable replies as cache rows; an unreadable one is not cached, so it will be asked again."""
    parsed = parse_findings(replies).where("parse_ok")
    findings = F.to_json(F.struct("corrections", F.col("issues").alias("formattingIssues")))
    return parsed.select("key", findings.alias("value"), "ts", F.lit(ttl_ms).cast("long").alias("ttl_ms"))


def start(
    spark: SparkSession, replies_dir: str, log_dir: str, progress_dir: str, available_now: bool = False
) -> StreamingQuery:
    """``progress_dir`` must be in storage every executor can reach."""
    arriving = spark.readStream.schema(REPLY_SCHEMA).parquet(replies_dir)
    writer = cache_rows(arriving).writeStream.format("parquet").option("checkpointLocation", progress_dir)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(log_dir)


def current(spark: SparkSession, log_dir: str) -> DataFrame:
    log = spark.read.schema(_LOG_SCHEMA).parquet(log_dir)
    return upsert(log.limit(0), log)

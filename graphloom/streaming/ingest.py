"""Incremental ingestion as a stream of landed files.

Nested commit records are landed as Parquet; the stream's checkpoint is the cursor. Each
micro-batch is merged into the stored graph, and as merging is idempotent, a batch that is
run again after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.graph import load, save
from graphloom.operators import ingest
from graphloom.storage import materialize

COMMIT_RECORD = (
    "repo_name string, pos bigint, hash string, short_hash string, message string, author struct<name:string,email:string>, committer struct<name:string,email:string>, timestamp timestamp, parent_hashes array<string>,"
    " diffs array<struct<path:string,old_path:string,status:string,additions:bigint,deletions:bigint>>, branch string"
)


def stream_commits(spark: SparkSession, landing: str, root: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Merge all landed commit records that the checkpoint hasn't seen, then stop. Only the batch is read: parents that aren't there yet wait in ``pending_parent`` until they are."""

    def merge(batch: DataFrame, _: int) -> None:
        graph = load(spark, root)
        records = materialize(batch, "batch")
        commits, changes, parents = ingest.flatten_commits(records)
        waiting = parents.select(F.col("hash").alias("child"), "parent").unionByName(graph["pending_parent"]).distinct()
        merged = ingest.ingest_commits(graph, commits, changes.withColumnRenamed("pos", "commit_pos"), waiting.select(F.col("child").alias("hash"), "parent"))
        left = waiting.join(merged["parent_of"], ["parent", "child"], "left_anti")
        save(merged.with_tables(pending_parent=left), root)

    source = spark.readStream.schema(COMMIT_RECORD).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    return source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def churn_windows(events: DataFrame, watermark: str = "1 day", width: str = "1 day") -> DataFrame:
    """Changes and touched files by repository and time window, over a batch or a stream of (timestamp, repo_name, path, additions, deletions)."""
    source = events.withWatermark("timestamp", watermark) if events.isStreaming else events
    return (
        source.groupBy(F.window("timestamp", width).alias("w"), "repo_name")
        .agg(F.count("*").alias("changes"), F.approx_count_distinct("path").alias("files"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))
        .select(F.col("w.start").alias("window_start"), "repo_name", "changes", "files", "additions", "deletions")
    )

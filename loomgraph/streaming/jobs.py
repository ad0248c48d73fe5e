"""Ingestion jobs as a ledger of states, in batch and as a stream (STR-*)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_root

# Spellings of the states that end a job, and of the active ones.
STATES = {"COMPLETE": ("complete", "completed", "done", "success", "finished"), "FAILED": ("failed", "fail", "error"), "CANCELLED": ("cancelled", "canceled", "aborted")}


def state(c: Column) -> Column:
    """STR-1: one spelling of a job's state: COMPLETE, FAILED or CANCELLED however written, else upper case with underscores."""
    s = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    out = F.upper(F.regexp_replace(s, r"[\s-]+", "_"))
    for name, spellings in STATES.items():
        out = F.when(s.isin(*spellings), name).otherwise(out)
    return out


def latest(jobs: DataFrame) -> DataFrame:
    """STR-1 and STR-2: the last record of each job by updated_at (created_at where null), then by the record itself; exact duplicates are one."""
    j = jobs.select("job_id", state(F.col("status")).alias("state"), "source_filename", "created_at", F.coalesce("updated_at", "created_at").alias("at"), "graph_version")
    return j.groupBy("job_id").agg(F.max(F.struct("at", "state", "source_filename", "created_at", "graph_version")).alias("r")).select("job_id", "r.*")


def elapsed(jobs: DataFrame) -> DataFrame:
    """STR-9: (job_id, seconds) from creation to the last change; null where the change lies before the creation."""
    s = F.unix_micros("at") / 1e6 - F.unix_micros("created_at") / 1e6
    return latest(jobs).select("job_id", F.when(s >= 0, F.round(s, 3)).alias("seconds"))


def stage_progress(jobs: DataFrame) -> DataFrame:
    """STR-8: (job_id, stage, pct, detail): progress merged by stage, the later record wins."""
    p = jobs.select("job_id", F.coalesce("updated_at", "created_at").alias("at"), F.explode("progress").alias("stage", "p"))
    return p.groupBy("job_id", "stage").agg(F.max(F.struct("at", "p.pct", "p.detail")).alias("r")).select("job_id", "stage", "r.pct", "r.detail")


def stream_latest(spark: SparkSession, folder: str, glob: str, schema) -> DataFrame:
    """STR-3 and STR-4: reads job records as a stream of files until none is left, keeps each batch as an immutable snapshot and returns the ledger.

    A batch is written under its number before it counts, so a batch that is run again after a failure replaces itself.
    """
    root = f"{checkpoint_root(spark)}/jobs-{uuid.uuid4().hex}"
    src = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)

    def keep(batch: DataFrame, no: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/v={no}")

    q = src.writeStream.foreachBatch(keep).option("checkpointLocation", f"{root}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return latest(spark.read.schema(schema).parquet(f"{root}/v=*"))

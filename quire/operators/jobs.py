"""The job store as an append-only log: every change is a row, the present state is the latest row of a job."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUSES = ("pending", "running", "done", "error")
LOG = "job_id string, seq long, ts timestamp, status string, stage string, current int, total int, message string, error string, config_json string, output_formats_json string, deleted boolean"


def latest(log: DataFrame, key: str = "job_id", order: str = "seq") -> DataFrame:
    """The last row of every job that isn't deleted. One shuffle with a row a job and task."""
    others = [c for c in log.columns if c != key]
    last = log.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("__last")).select(key, "__last.*")
    return last.filter(~F.coalesce("deleted", F.lit(False))) if "deleted" in log.columns else last


def changed(log: DataFrame, change: DataFrame, key: str = "job_id", order: str = "seq") -> DataFrame:
    """Rows to append for ``change`` (key and new values): what a change leaves out is taken from the latest row."""
    now, given = latest(log, key, order), [c for c in change.columns if c != key]
    met = now.alias("n").join(change.alias("c"), key)
    return met.select(*[F.col(key) if c == key else (F.col(f"n.{c}") + 1).alias(c) if c == order else (F.col(f"c.{c}") if c in given else F.col(f"n.{c}")).alias(c) for c in log.columns])


def newest(jobs: DataFrame, n: int = 100, created: str = "ts", tie: str = "job_id") -> DataFrame:
    """The newest jobs, newest first."""
    return jobs.orderBy(F.desc(created), F.desc(tie)).limit(n)


def older_than(jobs: DataFrame, cutoff: datetime | str, created: str = "ts", among: int | None = None, tie: str = "job_id") -> DataFrame:
    """Jobs created before the cutoff; ``among``: of the newest so many only, as a cleaning run looks at."""
    if among is not None:
        jobs = newest(jobs, among, created, tie)
    return jobs.filter(F.col(created) < F.lit(str(cutoff)).cast("timestamp_ntz"))


def with_formats(jobs: DataFrame, column: str = "output_formats_json") -> DataFrame:
    """The JSON list of formats as an array."""
    return jobs.withColumn("output_formats", F.from_json(column, "array<string>")).drop(column)


def compacted(log: DataFrame, before: int | None = None, key: str = "job_id", order: str = "seq") -> DataFrame:
    """A snapshot: the last row of every job. Tombstones stay until the next compaction, so that a reader who joins an older snapshot to newer changes isn't misled:
    those of versions up to ``before``, which an earlier snapshot has held, go."""
    others = [c for c in log.columns if c != key]
    last = log.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("__last")).select(key, "__last.*").select(*log.columns)
    gone = F.coalesce("deleted", F.lit(False)) & (F.col(order) <= F.lit(before if before is not None else 0))
    return last.filter(~gone) if "deleted" in log.columns else last

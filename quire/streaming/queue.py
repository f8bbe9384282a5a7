"""A durable queue: files that arrive become jobs of the log, once each; a runner works on them one after another, across restarts."""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from quire.operators.job_store import JobStore

log = logging.getLogger(__name__)
Work = Callable[[Row, Callable[[str, int, int], None], Callable[[], bool]], list[str]]


def submissions(store: JobStore, folder: str, checkpoint: str, config_json: str = "{}", files_a_batch: int = 100) -> StreamingQuery:
    """A stream that makes a pending job of every file in ``folder``, and stops when it has seen them all. A job's id follows from the file's path, size and time, so a
    batch that runs again after a crash adds nothing twice. Only names and sizes are read."""
    files = store.spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_a_batch).load(folder)
    own = F.sha2(F.concat_ws("|", "path", F.col("length").cast("string"), F.col("modificationTime").cast("double").cast("string")), 256)
    named = files.filter("length > 0").select(own.alias("job_id"), F.col("path").alias("filename"))

    def add(batch: DataFrame, number: int) -> None:
        made = store.create([r.asDict() | {"config_json": config_json} for r in batch.collect()])  # files_a_batch rows at most
        log.info("batch %s: %s jobs", number, len(made))

    return named.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Runner:
    """Works on pending jobs in the order they came, one at a time. ``work`` gets the job, a function for progress and one that tells whether to stop, and gives the
    formats it has written. What it raises ends that job alone. Its Spark jobs are a group, so that ``cancel`` ends them in the middle of a stage."""

    def __init__(self, store: JobStore, work: Work):
        self.store, self.work, self.cancelled = store, work, set()
        self._lock = threading.Lock()

    def waiting(self) -> Row | None:
        """The job to take next: one that a runner before this one has left unfinished, or the oldest pending one."""
        rows = self.store.jobs().filter(F.col("status").isin("running", "pending"))
        return rows.orderBy(F.desc("status"), "created_at", "job_id").first()

    def cancel(self, job_id: str) -> None:
        with self._lock:
            self.cancelled.add(job_id)
        self.store.spark.sparkContext.cancelJobGroup(job_id)

    def run_one(self) -> str | None:
        """Works on a job; gives its id, None if there is none."""
        job = self.waiting()
        if job is None:
            return None
        own, context = job["job_id"], self.store.spark.sparkContext
        stop = lambda: own in self.cancelled
        self.store.mark_running(own)
        try:
            if not stop():
                context.setJobGroup(own, job["filename"], interruptOnCancel=True)
                formats = self.work(job, lambda stage, at, of: self.store.progress(own, stage, at, of), stop)
        except Exception as error:
            log.exception("job %s failed", own)
            failed = "cancelled" if stop() else str(error).split("\n")[0] or type(error).__name__
        else:
            failed = "cancelled" if stop() else None
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)
        if failed:
            self.store.mark_error(own, failed)
        else:
            self.store.mark_done(own, formats)
        return own

    def run(self) -> list[str]:
        """Works until no job waits."""
        done = []
        while (own := self.run_one()) is not None:
            done.append(own)
        return done


class Progress(StreamingQueryListener):
    """Notes in the log how far a stream has come: the batch's number and rows, as progress of the job ``job_id``. Add it with ``spark.streams.addListener``."""

    def __init__(self, store: JobStore, job_id: str):
        self.store, self.job_id = store, job_id

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.store.progress(self.job_id, "started", 0, 0)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.store.progress(self.job_id, "batch", event.progress.batchId + 1, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.store.progress(self.job_id, "ended" if event.exception is None else "failed", 0, 0, (event.exception or "").split("\n")[0])


def book_work(spark: SparkSession, out: str, config=None, make=None) -> Work:
    """Work that turns the job's file into books under ``out/<job>``."""
    from quire.config import Config
    from quire.plans import books
    from quire.sources import files

    settings = config or Config()

    def work(job: Row, progress: Callable[[str, int, int], None], stop: Callable[[], bool]) -> list[str]:
        place = f"{out}/{job['job_id']}"
        blocks = books.processed(files.pages(spark, job["filename"], dpi=settings.image.target_dpi), settings, make, replies=f"{out}/.replies")
        books.export(blocks, f"{place}/.blocks", place, settings, progress, stop)
        return [books.SUFFIXES[f] for f in settings.export.formats]

    return work

"""Replies of an engine that costs: each is asked for once, whatever happens to the job or its tasks.

What is asked has a key, a hash of everything the reply depends on. Replies lie in the shared folder, parted by the first digits of their keys, and a task appends what it
got every few calls, in a file that appears only when whole. So a job that runs again leaves out what is known by an anti-join, and a task that
runs again finds what its predecessor got before it was lost.
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.tables import kept, path_of

#: Replies of a file; parts of the table of replies.
FLUSH, PARTS = 8, 256
SCHEMA = "key string, reply string, part string"
log = logging.getLogger(__name__)


def key_of(*parts: Column | str) -> Column:
    """A hash of values; each goes with its length, so that no two lists of values run together."""
    texts = [F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("")).cast("string") for p in parts]
    return F.sha2(F.concat(*[x for t in texts for x in (F.length(t).cast("string"), F.lit(":"), t)]), 256)


def known(asked: DataFrame, store: str) -> DataFrame:
    """``key, reply`` of all replies in the table so far, each key once."""
    at, files = path_of(asked.sparkSession, store)
    if not files.exists(at):
        return asked.sparkSession.createDataFrame([], "key string, reply string")
    return asked.sparkSession.read.schema(SCHEMA).parquet(store).groupBy("key").agg(F.min("reply").alias("reply"))


def answered(asked: DataFrame, make: Callable[[], Callable[..., str]], store: str, flush: int = FLUSH) -> DataFrame:
    """``key, reply`` of what is asked (``key`` and what the engine gets by name). ``make`` builds the engine in the task. A call that fails is noted in the log, has
    no reply and is made again by the next run."""
    new = asked.dropDuplicates(["key"]).join(known(asked, store).select("key"), "key", "left_anti")
    given = [c for c in asked.columns if c != "key"]

    def run(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        files, at = fs.FileSystem.from_uri(store)
        engine = None
        held: dict[str, list[tuple[str, str]]] = {}
        there: dict[str, set[str]] = {}

        def found(part: str) -> set[str]:
            """Keys that an earlier task has left in a part."""
            names = files.get_file_info(fs.FileSelector(f"{at}/part={part}", allow_not_found=True))
            return {k for n in names if n.is_file and not n.base_name.startswith(".") for k in pq.read_table(n.path, columns=["key"], filesystem=files, partitioning=None)["key"].to_pylist()}

        def put(part: str) -> None:
            rows = held.pop(part, [])
            if rows:
                files.create_dir(f"{at}/part={part}", recursive=True)
                name = f"{uuid.uuid4().hex}.parquet"
                pq.write_table(pa.table({"key": [k for k, _ in rows], "reply": [r for _, r in rows]}), f"{at}/part={part}/.{name}", filesystem=files)
                files.move(f"{at}/part={part}/.{name}", f"{at}/part={part}/{name}")

        for frame in frames:
            done = 0
            for row in frame.to_dict("records"):
                key, part = row["key"], row["key"][:2]
                if part not in there:
                    there[part] = found(part)
                if key in there[part]:
                    continue
                engine = engine or make()
                try:
                    held.setdefault(part, []).append((key, engine(*(row[c] for c in given))))
                except Exception:  # one call that fails must not end the job
                    log.exception("no reply for %s", key)
                    continue
                done += 1
                if sum(map(len, held.values())) >= flush:
                    for p in list(held):
                        put(p)
            yield pd.DataFrame({"done": [done]})
        for p in list(held):
            put(p)

    spread = new.repartition(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.substring("key", 1, 2))
    kept(spread.select("key", *given).mapInPandas(run, "done long"), "replies")
    return known(asked, store)

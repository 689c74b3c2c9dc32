"""A folder scan that reads only what it does not know, as a stream with keyed state.

Every scan lists its folder (path, size, time of change; no content) and appends the listing to a table
of events. A stateful stream keeps for each path what was last seen of it and its digest. A file that
looks as it did is not read again; a new or touched one is asked for once. Digests come back as events
of the same stream, so a scan that dies half way asks again for just what it still lacks.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skytable.sources.files import IMAGE_GLOB, list_frames

EVENT = "path string, size long, mtime long, seen long, digest string"
ACTION = "path string, size long, mtime long, seen long, action string, digest string"
#: A path that no scan has seen for this long is forgotten.
KEEP_DAYS = 400
#: Groups of paths whose state is kept together.
BUCKETS = 4096
_IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"


def _next(known: tuple, events: list[tuple]) -> tuple[tuple, list[tuple]]:
    """What is known of a path after new events (size, mtime, seen, digest), and what follows from them."""
    size, mtime, seen, digest = known
    out: dict[tuple, tuple] = {}
    # a digest follows the listing that asked for it
    for e_size, e_mtime, e_seen, e_digest in sorted(events, key=lambda e: (e[2], e[3] is not None)):
        same = size == e_size and mtime == e_mtime
        if e_digest is None:
            if e_seen < seen or (same and digest is not None):
                seen = max(seen, int(e_seen))
                continue
            size, mtime, seen, digest = int(e_size), int(e_mtime), int(e_seen), None
            out[size, mtime, "read"] = (size, mtime, seen, "read", None)
        elif same and digest is None:
            digest = e_digest
            out[size, mtime, "digest"] = (size, mtime, seen, "digest", digest)
    return (size, mtime, seen, digest), list(out.values())


def _followed(keep_days: int):
    """The step of a bucket of paths: what is known of them, their new events, and what follows."""
    keep = keep_days * 86_400_000

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        known = {path: rest for path, *rest in zip(*state.get, strict=True) if rest[-1] + keep > now} if state.exists else {}
        if not state.hasTimedOut:
            events: dict[str, list[tuple]] = {}
            for part in parts:
                for path, *event in zip(*(part[c].tolist() for c in ("path", "size", "mtime", "seen", "digest")), strict=True):
                    events.setdefault(path, []).append(tuple(event))
            out = []
            for path, new in events.items():
                after, acts = _next(tuple(known[path][:4]) if path in known else (None, None, -1, None), new)
                if after[0] is not None:
                    known[path] = [*after, now]
                out += [(path, *act) for act in acts]
            if out:
                yield pd.DataFrame(out, columns=["path", "size", "mtime", "seen", "action", "digest"])
        if known:
            columns = zip(*((path, *rest) for path, rest in known.items()), strict=True)
            state.update(tuple(list(c) for c in columns))
            state.setTimeoutDuration(max(1, min(rest[-1] for rest in known.values()) + keep - now))
        elif state.exists:
            state.remove()
    return step


def file_actions(events: DataFrame, keep_days: int = KEEP_DAYS) -> DataFrame:
    """What a stream of events (path, size, mtime, seen, digest) leads to: files to ``read``, and a ``digest`` once it is known.

    The state of a path is its size and time of change, when it was seen so, and the digest. A listing asks for a file
    that is new, that looks otherwise than before, or whose digest is still missing. A listing older than what is known,
    a digest of a file that has changed since, and anything that repeats say nothing. Paths are kept together in BUCKETS,
    since a group costs far more than a path.
    """
    known = "path array<string>, size array<long>, mtime array<long>, seen array<long>, digest array<string>, at array<long>"
    bucket = F.pmod(F.xxhash64("path"), F.lit(BUCKETS)).cast("int")
    return events.withColumn("bucket", bucket).groupBy("bucket").applyInPandasWithState(_followed(keep_days), ACTION, known, "append", GroupStateTimeout.ProcessingTimeTimeout)


def settle(spark: SparkSession, root: str, files_per_batch: int | None = None) -> DataFrame:
    """Run the stream over the events that have arrived and give all actions so far."""
    reader = spark.readStream.schema(EVENT)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # timeouts alone would ask for another batch for ever
    before = spark.conf.get(_IDLE)
    spark.conf.set(_IDLE, "false")
    try:
        q = (file_actions(reader.parquet(f"{root}/events")).writeStream.format("parquet").outputMode("append").option("path", f"{root}/actions")
             .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.set(_IDLE, before)
    return spark.read.schema(ACTION).parquet(f"{root}/actions")


def unread(actions: DataFrame) -> DataFrame:
    """Files that were asked for and whose digest has not come: the last question of each path, if it is open."""
    last = Window.partitionBy("path").orderBy(F.col("seen").desc(), F.col("action"))
    return actions.withColumn("__n", F.row_number().over(last)).filter("__n = 1 and action = 'read'").drop("__n")


def known(actions: DataFrame) -> DataFrame:
    """The last digest of every path: ``path``, ``size``, ``mtime``, ``digest``."""
    row = F.max_by(F.struct("size", "mtime", "digest"), F.struct("seen", "mtime", "size")).alias("k")
    return actions.filter("action = 'digest'").groupBy("path").agg(row).select("path", "k.*")


def _literal(path: str) -> str:
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def scan(spark: SparkSession, folder: str, root: str, glob: str = IMAGE_GLOB) -> DataFrame:
    """Digests of the image files of a folder tree; only files that are new or touched since the last scan are opened (Spark lists no file without bytes).

    State and events are kept under ``root``. The driver holds the paths that are to be read, as Spark's own listing does.
    A file that changes while it is read has a digest of neither look; the next scan asks for it again.
    """
    listed = list_frames(spark, folder, glob).select("path", "size", F.unix_micros(F.col("mtime")).alias("mtime"))
    listed.select("*", F.lit(time.time_ns() // 1000).alias("seen"), F.lit(None).cast("string").alias("digest")).write.mode("append").parquet(f"{root}/events")
    open_ = unread(settle(spark, root))
    paths = [_literal(r.path) for r in open_.select("path").collect()]
    if paths:
        read = spark.read.format("binaryFile").load(paths)
        read = read.select("path", F.col("length").alias("size"), F.unix_micros("modificationTime").alias("mtime"), F.sha1("content").alias("digest"))
        read.join(open_.select("path", "seen"), "path").select("path", "size", "mtime", "seen", "digest").write.mode("append").parquet(f"{root}/events")
        settle(spark, root)
    present = listed.select("path", "size", "mtime")
    return known(spark.read.schema(ACTION).parquet(f"{root}/actions")).join(present, ["path", "size", "mtime"], "left_semi")

"""The frame rules on streams: new files, sessions, settling, gates, counts and overrides as rows arrive.

The first group of functions turns one streaming DataFrame into another. ``run_to_table`` runs such a stream over
what has arrived so far and appends its rows to a table in shared storage; the ``foreachBatch`` runners keep tables
under a root folder, one version per batch, so that a batch that runs twice writes the same version again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skytable.operators import frames as frame_rules
from skytable.operators.capture import GAP_HOURS


def table_stream(spark: SparkSession, path: str, like: DataFrame, *, files_per_batch: int | None = None, glob: str | None = None) -> DataFrame:
    """The Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(like.schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def run_to_table(stream: DataFrame, root: str) -> DataFrame:
    """Run a stream over everything that has arrived and read its rows back from the table at ``root``."""
    q = (stream.writeStream.format("parquet").outputMode("append").option("path", f"{root}/rows")
         .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/rows")


# --- transformations --------------------------------------------------------------------

def new_files(files: DataFrame, at: str = "seen_at", late: str = "1 day") -> DataFrame:
    """Each content once: rows whose digest has not come before within the watermark."""
    return files.withWatermark(at, late).dropDuplicatesWithinWatermark(["digest"])


def session_stream(captures: DataFrame, key: str, ts: str = "ts", late: str = "1 hour", gap_hours: int = GAP_HOURS) -> DataFrame:
    """Sessions per key, each sent when no frame can extend it any more: ``first``, ``last``, ``frames``."""
    gap = f"{gap_hours} hours"
    g = captures.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("frames"))
    return g.select(key, F.col("session_window.start").alias("first"),
                    (F.col("session_window.end") - F.expr(f"INTERVAL {gap_hours} HOURS")).alias("last"), "frames")


def window_counts(captures: DataFrame, by: str = "filter", ts: str = "ts", size: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Frames per window of time and filter; fixed windows, or sliding ones with ``slide``."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    g = captures.withWatermark(ts, late).groupBy(w, by).agg(F.count("*").alias("frames"))
    return g.select(by, F.col("window.start").alias("start"), "frames")


def settled(before: DataFrame, after: DataFrame, late: str = "1 hour", within: str = "1 hour") -> DataFrame:
    """Digests before and after a measurement side by side: ``path``, ``digest``, ``state`` settled or unstable.

    Both streams have ``path``, ``digest`` and ``at``; the second reading follows within the given time.
    """
    a = before.withWatermark("at", late).select("path", F.col("digest").alias("digest"), F.col("at").alias("before_at"))
    b = after.withWatermark("at", late).select(F.col("path").alias("__path"), F.col("digest").alias("__digest"), F.col("at").alias("after_at"))
    on = (F.col("path") == F.col("__path")) & (F.col("after_at") >= F.col("before_at")) & (
        F.col("after_at") <= F.col("before_at") + F.expr(f"INTERVAL {within}"))
    state = F.when(F.col("digest") == F.col("__digest"), "settled").otherwise("unstable")
    return a.join(b, on).select("path", "digest", state.alias("state"))


# --- tables kept by batches ----------------------------------------------------------------

def run_batches(stream: DataFrame, root: str, step) -> None:
    """Run ``step`` on every batch of what has arrived."""
    q = (stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()


def versions(spark: SparkSession, root: str, name: str) -> list[int]:
    """Batches that have a version of a table under ``root``."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    found = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(int(n.split("=")[1]) for n in found if n.startswith("batch="))


def rolling_verdicts(stream: DataFrame, root: str, settings: DataFrame | None = None) -> DataFrame:
    """Verdicts kept up to date as frames arrive: after every batch the gates are computed from the whole cohort.

    The cohort is a table with one folder per batch. Gates never come from survivors of an earlier round.
    """
    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/cohort/batch={number}")
        cohort = batch.sparkSession.read.schema(batch.schema).parquet(*[
            f"{root}/cohort/batch={n}" for n in versions(batch.sparkSession, root, "cohort") if n <= number])
        frame_rules.verdicts(cohort, settings).write.mode("overwrite").parquet(f"{root}/verdicts/batch={number}")
    run_batches(stream, root, step)
    spark = stream.sparkSession
    return spark.read.parquet(f"{root}/verdicts/batch={versions(spark, root, 'verdicts')[-1]}")


def latest_overrides(stream: DataFrame, root: str, key: str = "path", order: Column | None = None) -> DataFrame:
    """The last override of each path so far (``override``, ``at``): each batch is folded into the version before it."""
    rank = F.col("at") if order is None else order

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(key, "override", "at")
        before = [n for n in versions(spark, root, "overrides") if n < number]
        if before:
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(f"{root}/overrides/batch={before[-1]}"))
        rows.groupBy(key).agg(F.max_by("override", rank).alias("override"), F.max("at").alias("at")).write.mode("overwrite").parquet(
            f"{root}/overrides/batch={number}")
    run_batches(stream, root, step)
    spark = stream.sparkSession
    return spark.read.parquet(f"{root}/overrides/batch={versions(spark, root, 'overrides')[-1]}")


def overridden_states(verdicts: DataFrame, overrides: DataFrame, key: str = "path") -> DataFrame:
    """Final states from verdicts and overrides; overrides never change gates."""
    rows = verdicts.join(overrides.select(key, "override"), key, "left")
    return rows.withColumn("final", frame_rules.final_state(F.col("state"), F.col("override")))

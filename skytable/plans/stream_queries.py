"""Stream queries: the given rows arrive as files and the results are compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skytable.functions.storage import fresh_path, written
from skytable.plans.frame_queries import JUDGED, OVERRIDE, frames
from skytable.plans.registry import query
from skytable.plans.views import table, view, with_views
from skytable.streaming import ranks, scans, streams


def arriving(spark, df, name: str, parts: int = 1):
    """Write rows as files and read them as a stream in ``parts`` batches; every batch is written and read by many tasks."""
    path = fresh_path(spark, name)
    if parts == 1:
        df.write.parquet(path)
        return streams.table_stream(spark, path, df)
    many = spark.sparkContext.defaultParallelism
    df.repartition(parts * many).write.parquet(path)
    return streams.table_stream(spark, path, df, files_per_batch=many)


def captures(spark, sf):
    """The events file as a stream of captures."""
    events = table(spark, sf, "events")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = streams.table_stream(spark, sf, events, glob="events*.parquet")
    return rows.select(F.col("user_id").alias("card"), F.expr("substr(event_type, 1, 1)").alias("filter"), F.col("ts").cast("timestamp").alias("ts"))


@query("incremental_scan", with_views("files", "SELECT DISTINCT digest FROM files"))
def incremental_scan(spark, sf):
    f = view(spark, sf, "files").withColumn("seen_at", F.timestamp_seconds(1577836800 + F.col("file_id") % 600))
    return streams.run_to_table(streams.new_files(arriving(spark, f, "arriving", 3)), fresh_path(spark, "scan")).select("digest")


@query("session_stream", with_views("capture", """gaps AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY card ORDER BY ts) > INTERVAL 4 HOUR THEN 1 ELSE 0 END AS s FROM capture),
numbered AS (SELECT *, sum(s) OVER (PARTITION BY card ORDER BY ts) AS n FROM gaps), se AS (SELECT card, n, min(ts) AS f, max(ts) AS l, count(*) AS frames FROM numbered GROUP BY card, n)
SELECT card, CAST(epoch_us(f) AS BIGINT) AS first_us, CAST(epoch_us(l) AS BIGINT) AS last_us, frames FROM se WHERE l + INTERVAL 4 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM capture) - INTERVAL 1 HOUR"""))
def session_stream(spark, sf):
    s = streams.run_to_table(streams.session_stream(captures(spark, sf), "card"), fresh_path(spark, "sessions"))
    return s.select("card", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"), "frames")


@query("settle_check", with_views("files", "SELECT concat('p', CAST(file_id AS VARCHAR)) AS path, CASE WHEN file_id % 6 = 0 THEN 'unstable' ELSE 'settled' END AS state FROM files WHERE file_id % 10 <> 9"))
def settle_check(spark, sf):
    i = F.col("file_id")
    f = view(spark, sf, "files").select(F.concat(F.lit("p"), i).alias("path"), "digest", F.timestamp_seconds(1577836800 + i % 600).alias("at"), i.alias("i"))
    after = f.withColumns({"digest": F.when(F.col("i") % 6 == 0, F.sha1("digest")).otherwise(F.col("digest")),
                           "at": F.col("at") + F.when(F.col("i") % 10 == 9, F.expr("INTERVAL 2 HOURS")).otherwise(F.expr("INTERVAL 5 MINUTES"))})
    s = streams.settled(arriving(spark, f.drop("i"), "before"), arriving(spark, after.drop("i"), "after"))
    return streams.run_to_table(s, fresh_path(spark, "settled")).select("path", "state")


@query("rolling_gates", with_views("frames", JUDGED + " SELECT filter, state, count(*) AS frames FROM judged GROUP BY filter, state"))
def rolling_gates(spark, sf):
    v = streams.rolling_verdicts(arriving(spark, frames(spark, sf), "night", 3), fresh_path(spark, "rolling"))
    return v.groupBy("filter", "state").agg(F.count("*").alias("frames"))


@query("tumbling_counts", with_views("capture", """m AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR AS w FROM capture), h AS (SELECT filter, date_trunc('hour', ts) AS s, count(*) AS frames FROM capture GROUP BY ALL),
q AS (SELECT filter, time_bucket(INTERVAL 15 MINUTE, ts) - o * INTERVAL 15 MINUTE AS s, count(*) AS frames FROM capture CROSS JOIN (SELECT unnest(range(4)) AS o) GROUP BY ALL)
SELECT 'fixed' AS kind, filter, CAST(epoch_us(s) AS BIGINT) AS start_us, frames FROM h, m WHERE s + INTERVAL 1 HOUR <= w UNION ALL SELECT 'sliding', filter, CAST(epoch_us(s) AS BIGINT), frames FROM q, m WHERE s + INTERVAL 1 HOUR <= w"""))
def tumbling_counts(spark, sf):
    a = streams.run_to_table(streams.window_counts(captures(spark, sf)), fresh_path(spark, "fixed"))
    b = streams.run_to_table(streams.window_counts(captures(spark, sf), slide="15 minutes"), fresh_path(spark, "sliding"))
    both = a.withColumn("kind", F.lit("fixed")).unionByName(b.withColumn("kind", F.lit("sliding")))
    return both.select("kind", "filter", F.unix_micros("start").alias("start_us"), "frames")


@query("hand_override_stream", with_views("frames", JUDGED + f""", ov AS (SELECT *, {OVERRIDE} AS override FROM judged)
SELECT frame_id, CASE WHEN override = 'condemned' THEN 'rejected' WHEN state = 'unmeasurable' THEN state WHEN override = 'rescued' THEN 'approved' ELSE state END AS final FROM ov"""))
def hand_override_stream(spark, sf):
    f = frames(spark, sf)
    last = f.select("path", F.expr(OVERRIDE).alias("override"), F.lit(2).alias("at")).filter("override IS NOT NULL")
    early = last.withColumns({"override": F.when(F.col("override") == "rescued", "condemned").otherwise("rescued"), "at": F.lit(1)})
    from skytable.operators.frames import verdicts
    o = streams.latest_overrides(arriving(spark, early.unionByName(last), "overrides", 3), fresh_path(spark, "latest"))
    return streams.overridden_states(verdicts(f), o).select("frame_id", "final")


# first all paths are listed, then their digests come, then the folder is listed again with a fifth of the files touched, then with nothing new
@query("known_files", with_views("files", """acts AS (SELECT concat('p', CAST(file_id AS VARCHAR)) AS path, 'read' AS action, CAST(NULL AS VARCHAR) AS digest, size, 1 AS mtime FROM files
UNION ALL SELECT concat('p', CAST(file_id AS VARCHAR)), 'digest', digest, size, 1 FROM files WHERE size % 7 <> 3
UNION ALL SELECT concat('p', CAST(file_id AS VARCHAR)), 'read', NULL, size, CASE WHEN size % 5 = 0 THEN 2 ELSE 1 END FROM files WHERE size % 5 = 0 OR size % 7 = 3
UNION ALL SELECT concat('p', CAST(file_id AS VARCHAR)), 'digest', sha1(digest), size, 2 FROM files WHERE size % 5 = 0)
SELECT path, action, digest, size, CAST(mtime AS BIGINT) AS mtime, CAST(count(*) AS BIGINT) AS times FROM acts GROUP BY ALL"""))
def known_files(spark, sf):
    f = view(spark, sf, "files").select(F.concat(F.lit("p"), F.col("file_id")).alias("path"), F.col("size").cast("long").alias("size"), "digest")
    # digests are made of whole texts: once, not for each batch of events that tells of them
    f = written(f, "files")
    touched = F.col("size") % 5 == 0
    listed = f.select("path", "size", F.lit(1).cast("long").alias("mtime"), F.lit(10).cast("long").alias("seen"), F.lit(None).cast("string").alias("digest"))
    # digests that come twice, and one of an older look at the file, say nothing
    digests = f.filter("size % 7 <> 3").select("path", "size", F.lit(1).cast("long").alias("mtime"), F.lit(10).cast("long").alias("seen"), "digest")
    again = listed.withColumns({"mtime": F.when(touched, 2).otherwise(1).cast("long"), "seen": F.lit(20).cast("long")})
    last = f.filter(touched).select("path", "size", F.lit(2).cast("long").alias("mtime"), F.lit(20).cast("long").alias("seen"), F.sha1("digest").alias("digest"))
    late = listed.withColumn("seen", F.lit(5).cast("long"))
    root = fresh_path(spark, "known")
    for events in (listed, digests.unionByName(digests), again.unionByName(late), last.unionByName(digests.filter(touched))):
        events.write.mode("append").parquet(f"{root}/events")
        acts = scans.settle(spark, root)
    return acts.groupBy("path", "action", "digest", "size", "mtime").agg(F.count("*").alias("times"))


@query("running_gates", with_views("frames", """RECURSIVE b AS (SELECT 0 AS batch UNION ALL SELECT batch + 1 FROM b WHERE batch < 2),
valid AS (SELECT b.batch, f.* FROM frames f JOIN b ON frame_id % 3 <= b.batch WHERE fwhm > 0 AND eccentricity > 0 AND stars > 0 AND psf_snr > 0),
long AS (SELECT batch, filter, 'psf_snr' AS metric, CAST(psf_snr AS DOUBLE) AS value FROM valid UNION ALL SELECT batch, filter, 'fwhm', fwhm FROM valid
  UNION ALL SELECT batch, filter, 'eccentricity', eccentricity FROM valid UNION ALL SELECT batch, filter, 'stars', CAST(stars AS DOUBLE) FROM valid),
mids AS (SELECT batch, filter, metric, count(*) AS n, median(value) AS med FROM long GROUP BY ALL),
devs AS (SELECT l.batch, l.filter, l.metric, 14826e-4 * median(abs(l.value - m.med)) AS sd FROM long l JOIN mids m ON l.batch = m.batch AND l.filter = m.filter AND l.metric = m.metric GROUP BY ALL)
SELECT CAST(m.batch AS INTEGER) AS batch, m.filter, m.metric, n, round(med, 9) AS median, CASE WHEN m.metric <> 'psf_snr' THEN round(sd, 9) END AS sigma FROM mids m JOIN devs d ON m.batch = d.batch AND m.filter = d.filter AND m.metric = d.metric WHERE n >= 10"""))
def running_gates(spark, sf):
    f = frames(spark, sf)
    path, root = fresh_path(spark, "nights"), fresh_path(spark, "running")
    # what has arrived since the last run is one batch, however many files it has
    for third in range(3):
        f.filter(F.col("frame_id") % 3 == third).write.mode("append").parquet(path)
        g = ranks.running_gates(streams.table_stream(spark, path, f), root)
    return g.select("batch", "filter", "metric", "n", F.round("median", 9).alias("median"), F.round("sigma", 9).alias("sigma"))

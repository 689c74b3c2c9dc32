"""Queries over the ``capture``, ``flats`` and ``darks`` views."""

from __future__ import annotations

from pyspark.sql import functions as F

from skytable.functions import capture_names as names
from skytable.operators import capture as op
from skytable.plans.registry import query
from skytable.plans.views import view, with_views


def capture(spark, sf):
    return view(spark, sf, "capture")


STAMP_SQL = "strftime(ts, '%Y%m%d-%H%M%S')"
NAMES_SPARK = """SELECT frame_id, card, concat(CASE frame_id % 13 WHEN 0 THEN 'Preview' WHEN 1 THEN 'flat' WHEN 2 THEN '._Light' ELSE 'Light' END, '_', target, CASE WHEN frame_id % 5 = 0 THEN '_30s' ELSE '' END, '_',
  CASE WHEN frame_id % 17 = 0 THEN 'x' ELSE '180.0s' END, '_Bin', CAST(1 + frame_id % 2 AS VARCHAR(2)), CASE WHEN frame_id % 3 = 0 THEN '_cam_533' ELSE '' END, '_', filter, '_gain', CAST(frame_id % 9 AS VARCHAR(2)), '_',
  CASE WHEN frame_id % 19 = 0 THEN '20230231-101010' WHEN frame_id % 23 = 0 THEN '20231301-101010' ELSE {stamp} END, CASE WHEN frame_id % 4 = 0 THEN '_120deg' ELSE '' END, CASE WHEN frame_id % 29 = 0 THEN '' ELSE '_-10.5C' END, '_0', CAST(frame_id AS VARCHAR(9)),
  CASE WHEN frame_id % 31 = 0 THEN '_7' ELSE '' END, CASE WHEN frame_id % 37 = 0 THEN '.txt' WHEN frame_id % 2 = 0 THEN '.FIT' ELSE '.fits' END) AS name FROM capture"""
NAMES = "names AS (" + NAMES_SPARK.format(stamp=STAMP_SQL) + ")"
PARSED = NAMES + r""",
tok AS (SELECT *, string_split(regexp_replace(name, '\.(fit|fits)$', '', 'i'), '_') AS t FROM names),
marked AS (SELECT *, [i for i in range(1, len(t) + 1) if regexp_full_match(t[i], '\d{8}-\d{6}')] AS st FROM tok),
b AS (SELECT *, CASE WHEN regexp_matches(name, '\.(fit|fits)$', 'i') AND lower(t[1]) IN ('light', 'flat', 'dark', 'bias') AND len(st) = 1 AND st[1] >= 3 AND regexp_full_match(t[st[1] - 1], 'gain\d+') THEN st[1] END AS s FROM marked),
c AS (SELECT *, list_max([i for i in range(1, s - 2) if regexp_full_match(t[i], 'Bin\d+')]) AS bn FROM b),
e AS (SELECT *, list_max([i for i in range(1, bn) if regexp_full_match(t[i], '\d+(\.\d+)?(s|ms)')]) AS ex FROM c),
tl AS (SELECT *, [x for x in t[s + 1:] if regexp_full_match(x, '\d+deg')] AS ro, [x for x in t[s + 1:] if regexp_full_match(x, '-?\d+(\.\d+)?C')] AS te, [x for x in t[s + 1:] if regexp_full_match(x, '\d+')] AS sq FROM e),
ok AS (SELECT *, coalesce(ex >= 2 AND len(ro) <= 1 AND len(te) = 1 AND len(sq) = 1, FALSE) AS good FROM tl),
parsed AS (SELECT frame_id, card, name, CASE WHEN good THEN t[1] END AS type, CASE WHEN good THEN array_to_string(t[2:ex - 1], '_') END AS target, CASE WHEN good THEN t[ex] END AS exposure, CASE WHEN good THEN t[bn] END AS bin_token,
  CASE WHEN good AND bn + 1 <= s - 3 THEN array_to_string(t[bn + 1:s - 3], '_') END AS camera, CASE WHEN good THEN t[s - 2] END AS filter, CASE WHEN good THEN t[s - 1] END AS gain, CASE WHEN good THEN t[s] END AS stamp,
  CASE WHEN good THEN ro[1] END AS rotation, CASE WHEN good THEN te[1] END AS temp, CASE WHEN good THEN sq[1] END AS sequence FROM ok),
keyed AS (SELECT *, CAST(epoch(try_strptime(stamp, '%Y%m%d-%H%M%S')) AS BIGINT) AS key FROM parsed)"""


def named(spark, sf):
    capture(spark, sf).createOrReplaceTempView("capture")
    return spark.sql(NAMES_SPARK.format(stamp="date_format(ts, 'yyyyMMdd-HHmmss')"))


@query("parse_capture_name", with_views("capture", PARSED + " SELECT frame_id, type, target, exposure, bin_token, camera, filter, gain, stamp, rotation, temp, sequence FROM keyed"))
def parse_capture_name(spark, sf):
    p = names.parse_capture_names(named(spark, sf), "name")
    return p.select("frame_id", *names.CAPTURE_FIELDS)


@query("stamp_key", with_views("capture", PARSED + " SELECT frame_id, stamp, key FROM keyed"))
def stamp_key(spark, sf):
    return names.parse_capture_names(named(spark, sf), "name").select("frame_id", "stamp", "key")


TIMES = """CASE frame_id % 5 WHEN 0 THEN concat('''', {iso}, '''') WHEN 1 THEN concat({iso}, 'Z') WHEN 2 THEN concat({iso}, '+01:00') WHEN 3 THEN '' ELSE {iso} END"""


@query("obs_time", with_views("capture", """SELECT frame_id, CASE WHEN frame_id % 5 = 3 THEN NULL ELSE CAST(epoch_ms(date_trunc('second', ts)) - CASE WHEN frame_id % 5 = 2 THEN 3600000 ELSE 0 END AS BIGINT) END AS obs_ms FROM capture"""))
def obs_time(spark, sf):
    iso = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")"
    text = F.expr(TIMES.format(iso=iso))
    return capture(spark, sf).select("frame_id", names.obs_time(text).alias("obs_ms"))


CARD = """files AS (SELECT frame_id, concat('/media/card', CASE WHEN frame_id % 11 = 0 THEN 'X' ELSE '' END, '/', CASE frame_id % 3 WHEN 0 THEN 'Plan' WHEN 1 THEN 'Autorun' ELSE 'Live' END, '/', CASE frame_id % 4 WHEN 0 THEN 'Flat/' WHEN 1 THEN 'Dark/' ELSE concat('Light/M', CAST(frame_id % 6 AS VARCHAR(3)), '/') END, name) AS path, frame_id % 4 AS k, frame_id % 6 AS tg,
  frame_id % 11 <> 0 AND frame_id % 3 <> 2 AS ours {more} FROM {src})"""


@query("scan_capture_card", with_views("capture", PARSED + ",\n" + CARD.format(more=", target, key", src="keyed") + """ SELECT frame_id, CASE WHEN key IS NULL THEN 'unparseable' WHEN k = 0 THEN 'flat' WHEN k = 1 THEN 'dark' ELSE 'light' END AS kind,
  CASE WHEN key IS NULL THEN NULL WHEN k > 1 THEN concat('M', CAST(tg AS VARCHAR)) ELSE target END AS target, key FROM files WHERE ours"""))
def scan_capture_card(spark, sf):
    named(spark, sf).createOrReplaceTempView("names")
    files = spark.sql("WITH " + CARD.format(more="", src="names") + " SELECT frame_id, path FROM files")
    return op.scan_capture(files, "/media/card").select("frame_id", "kind", "target", "key")


@query("path_inside", with_views("files", """SELECT file_id, CASE file_id % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE folder = 'web' END AS inside FROM files"""))
def path_inside(spark, sf):
    f = view(spark, sf, "files")
    path = F.when(F.col("file_id") % 3 == 0, F.concat(F.lit("/a/"), "folder", F.lit("/x/"))).when(
        F.col("file_id") % 3 == 1, F.concat(F.lit("/a/"), "folder", F.lit("2/x"))).otherwise(F.concat(F.lit("/a/"), "folder"))
    root = F.when(F.col("file_id") % 3 == 2, F.lit("/a/web/")).otherwise(F.concat(F.lit("/a/"), "folder", F.lit("//")))
    return f.select("file_id", op.path_inside(path, root).alias("inside"))


GAPS = """gaps AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY card ORDER BY ts) > INTERVAL 4 HOUR THEN 1 ELSE 0 END AS s FROM capture),
numbered AS (SELECT *, CAST(sum(s) OVER (PARTITION BY card ORDER BY ts) AS BIGINT) AS session_no FROM gaps)"""


@query("sessions", with_views("capture", GAPS + """ SELECT card, session_no, CAST(epoch_us(min(ts)) AS BIGINT) AS first_us, CAST(epoch_us(max(ts)) AS BIGINT) AS last_us, count(*) AS frames FROM numbered GROUP BY card, session_no"""))
def sessions(spark, sf):
    s = op.sessions(capture(spark, sf), ["card"], "ts")
    return s.select("card", "session_no", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"), "frames")


@query("nights", with_views("capture", GAPS + """ SELECT card, session_no, target, CAST(epoch_us(min(ts)) AS BIGINT) AS first_us, CAST(epoch_us(max(ts)) AS BIGINT) AS last_us, count(*) AS frames,
  array_to_string(list_sort(list(DISTINCT filter)), ',') AS filters, strftime(min(ts), '%Y-%m-%d') AS date FROM numbered GROUP BY card, session_no, target"""))
def nights(spark, sf):
    n = op.nights(capture(spark, sf), ["card"])
    return n.select("card", "session_no", "target", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"),
                    "frames", F.array_join("filters", ",").alias("filters"), "date")


BATCHED = """lg AS (SELECT card, CAST(floor(epoch(ts)) AS BIGINT) AS k FROM capture WHERE target <> 'click'), fg AS (SELECT card, CAST(floor(epoch(ts)) AS BIGINT) AS k FROM capture WHERE target = 'click'),
ls AS (SELECT card, session_no, min(k) AS first, max(k) AS last FROM (SELECT *, sum(s) OVER (PARTITION BY card ORDER BY k) AS session_no FROM (SELECT *, CASE WHEN k - lag(k) OVER (PARTITION BY card ORDER BY k) > 14400 THEN 1 ELSE 0 END AS s FROM lg)) GROUP BY ALL),
fs AS (SELECT card, session_no, (min(k) + max(k)) // 2 AS mid FROM (SELECT *, sum(s) OVER (PARTITION BY card ORDER BY k) AS session_no FROM (SELECT *, CASE WHEN k - lag(k) OVER (PARTITION BY card ORDER BY k) > 14400 THEN 1 ELSE 0 END AS s FROM fg)) GROUP BY ALL),
d AS (SELECT f.card, f.session_no AS batch_no, l.session_no, CASE WHEN f.mid < l.first THEN l.first - f.mid WHEN f.mid > l.last THEN f.mid - l.last ELSE 0 END AS off FROM fs f JOIN ls l ON f.card = l.card),
r AS (SELECT *, row_number() OVER (PARTITION BY card, batch_no ORDER BY off, session_no) AS rn FROM d)"""


@query("assign_batches", with_views("capture", BATCHED + " SELECT card, CAST(batch_no AS BIGINT) AS batch_no, CAST(session_no AS BIGINT) AS session_no FROM r WHERE rn = 1"))
def assign_batches(spark, sf):
    c = capture(spark, sf).withColumn("at", F.timestamp_seconds(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)))

    def whole(df):
        s = op.sessions(df, ["card"], "at")
        return s.select("card", "session_no", F.unix_seconds("first").alias("first"), F.unix_seconds("last").alias("last"))
    out = op.assign_batches(whole(c.filter("target = 'click'")), whole(c.filter("target <> 'click'")), "card")
    return out.filter("session_no IS NOT NULL")


# --- flats and darks ----------------------------------------------------------------------------

FLATS = """fl AS (SELECT *, CASE WHEN flat_id % 4 = 0 THEN NULL ELSE concat('cam', CAST(flat_id % 2 AS VARCHAR(2))) END AS camera, CASE WHEN flat_id % 3 = 0 THEN 10 WHEN flat_id % 3 = 1 THEN 20 END AS rotation FROM flats)"""
WANTS = """wants AS (SELECT DISTINCT filter, binning, CASE WHEN flat_id % 5 = 0 THEN NULL ELSE 'cam1' END AS camera, CASE WHEN flat_id % 2 = 0 THEN 10 END AS rotation FROM flats UNION ALL SELECT 'Z', 1, NULL, NULL)"""


def flats(spark, sf):
    return view(spark, sf, "flats")


def darks(spark, sf):
    return view(spark, sf, "darks")


@query("match_flats", with_views("flats", FLATS + ",\n" + WANTS + """,
hits AS (SELECT w.filter, w.binning, w.camera, w.rotation, (w.camera IS NULL) <> (f.camera IS NULL) OR (w.rotation IS NULL) <> (f.rotation IS NULL) AS soft FROM wants w JOIN fl f ON w.filter = f.filter AND w.binning = f.binning
  AND coalesce(w.camera = f.camera, TRUE) AND coalesce(w.rotation = f.rotation, TRUE)),
g AS (SELECT filter, binning, camera, rotation, count(*) AS flats, bool_or(soft) AS weak FROM hits GROUP BY ALL)
SELECT w.filter, w.binning, w.camera, w.rotation, coalesce(g.flats, 0) AS flats, CASE WHEN g.flats IS NULL THEN 'missing' WHEN g.weak THEN 'weak' ELSE 'exact' END AS strength FROM wants w
  LEFT JOIN g ON w.filter = g.filter AND w.binning = g.binning AND w.camera IS NOT DISTINCT FROM g.camera AND w.rotation IS NOT DISTINCT FROM g.rotation"""))
def match_flats(spark, sf):
    flats(spark, sf).createOrReplaceTempView("flats")
    f = spark.sql("WITH " + FLATS + " SELECT * FROM fl")
    return op.flat_strength(spark.sql("WITH " + WANTS + " SELECT * FROM wants"), f)


# Every third dark has a temperature far off, so that all tiers occur.
DARKS = """dk AS (SELECT path, kind, binning, exposure, CASE WHEN dark_id % 3 = 0 THEN temp - 2e1 ELSE temp END AS temp, gain FROM darks WHERE NOT (kind = 'master' AND exposure = 1e0))"""
CHOSEN = DARKS + """,
st AS (SELECT DISTINCT exposure, binning, gain, temp FROM flats),
pairs AS (SELECT s.*, d.path, d.kind, d.exposure AS de, d.temp AS dt, d.binning AS db, d.gain AS dg, concat('e', CAST(CAST(floor(d.exposure * 1000 + 5e-1) AS BIGINT) AS VARCHAR), 'b', CAST(d.binning AS VARCHAR), 'g', CAST(d.gain AS VARCHAR)) AS rk
  FROM st s JOIN dk d ON abs(s.exposure - d.exposure) <= greatest(1e-3, 1e-2 * greatest(s.exposure, d.exposure)) AND s.binning = d.binning AND abs(s.gain - d.gain) <= 5e-1),
cand AS (SELECT exposure, binning, gain, temp, CASE WHEN abs(temp - dt) <= 3 THEN 1 ELSE 2 END AS tier, abs(exposure - de) AS a, abs(temp - dt) AS b, CAST(1 AS BIGINT) AS n, path AS pick FROM pairs WHERE kind = 'master'
  UNION ALL SELECT exposure, binning, gain, temp, 3, abs(exposure - min(de)), abs(temp - avg(dt)), count(*), rk FROM pairs WHERE kind = 'raw' AND abs(temp - dt) <= 3 GROUP BY exposure, binning, gain, temp, rk HAVING count(*) >= 2),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY exposure, binning, gain, temp ORDER BY tier, a, b, n DESC, pick) AS rn FROM cand) WHERE rn = 1)"""


def test_darks(spark, sf):
    darks(spark, sf).createOrReplaceTempView("darks")
    return spark.sql("WITH " + DARKS + " SELECT * FROM dk")


@query("choose_dark", with_views("flats darks", CHOSEN + """ SELECT f.flat_id, c.tier, c.pick, c.n AS darks FROM flats f LEFT JOIN chosen c ON f.exposure = c.exposure AND f.binning = c.binning AND f.gain = c.gain AND f.temp = c.temp"""))
def choose_dark(spark, sf):
    return op.with_dark(flats(spark, sf), test_darks(spark, sf)).select("flat_id", "tier", "pick", "darks")


USED = CHOSEN + """,
used AS (SELECT DISTINCT p.path, p.kind, p.de AS exposure FROM chosen c JOIN pairs p ON c.exposure = p.exposure AND c.binning = p.binning AND c.gain = p.gain AND c.temp = p.temp
  AND CASE WHEN c.tier = 3 THEN p.kind = 'raw' AND abs(p.temp - p.dt) <= 3 AND p.rk = c.pick ELSE p.kind = 'master' AND p.path = c.pick END)"""


@query("darks_used", with_views("flats darks", USED + " SELECT path, kind, exposure FROM used"))
def darks_used(spark, sf):
    return op.darks_used(flats(spark, sf), test_darks(spark, sf))


# Exposures of a few settings a job, close enough for some to share a part.
JOBS = """fx AS (SELECT path, CASE WHEN filter = 'E' THEN 'Ha 3nm' ELSE filter END AS filter, binning, CASE WHEN flat_id % 6 = 0 THEN exposure * 1008e-3 WHEN flat_id % 6 = 1 THEN exposure * 1016e-3 ELSE exposure END AS exposure, temp, gain FROM flats
  UNION ALL SELECT 'flat-single', 'solo', 1, 1e0, 0e0, 100 UNION ALL SELECT 'flat-a', 'none', 1, 9e1, 0e0, 100 UNION ALL SELECT 'flat-b', 'none', 1, 9e1, 0e0, 100)"""


def job_flats(spark, sf):
    flats(spark, sf).createOrReplaceTempView("flats")
    return spark.sql("WITH " + JOBS + " SELECT * FROM fx")


def parts_sql() -> str:
    """Leaders in path order: a setting leads when no earlier leader has its exposure (three settings at most lie close)."""
    near = "abs(a.exposure - b.exposure) <= greatest(1e-3, 1e-2 * greatest(a.exposure, b.exposure))"
    return JOBS + f""",
kinds AS (SELECT filter, binning, exposure, gain, min(path) AS part FROM fx GROUP BY filter, binning, exposure, gain),
e AS (SELECT a.part AS earlier, b.part AS later FROM kinds a JOIN kinds b ON a.filter = b.filter AND a.binning = b.binning AND a.gain = b.gain AND a.part < b.part AND {near}),
l1 AS (SELECT part FROM kinds WHERE part NOT IN (SELECT later FROM e)), x1 AS (SELECT later FROM e WHERE earlier IN (SELECT part FROM l1)),
l2 AS (SELECT part FROM kinds WHERE part NOT IN (SELECT part FROM l1) AND part NOT IN (SELECT later FROM x1) AND part NOT IN (SELECT later FROM e WHERE earlier NOT IN (SELECT later FROM x1))), leaders AS (SELECT part FROM l1 UNION ALL SELECT part FROM l2),
led AS (SELECT k.filter, k.binning, k.exposure, k.gain, coalesce(min(e.earlier) FILTER (WHERE k.part NOT IN (SELECT part FROM leaders) AND e.earlier IN (SELECT part FROM leaders)), k.part) AS part FROM kinds k LEFT JOIN e ON e.later = k.part GROUP BY k.filter, k.binning, k.exposure, k.gain, k.part),
parts AS (SELECT f.*, l.part FROM fx f JOIN led l ON f.filter = l.filter AND f.binning = l.binning AND f.exposure = l.exposure AND f.gain = l.gain)"""


FIRSTS = parts_sql() + ",\n" + CHOSEN.replace("FROM flats)", "FROM fx)") + """,
firsts AS (SELECT p.*, c.tier, c.pick, c.n FROM parts p LEFT JOIN chosen c ON p.exposure = c.exposure AND p.binning = c.binning AND p.gain = c.gain AND p.temp = c.temp WHERE p.path = p.part)"""


@query("flat_jobs", with_views("flats darks", FIRSTS + """,
miss AS (SELECT filter, binning, arg_min(exposure, part) AS e FROM firsts WHERE pick IS NULL GROUP BY filter, binning),
j AS (SELECT filter, binning, count(*) AS flats, count(DISTINCT part) AS parts FROM parts GROUP BY filter, binning),
n AS (SELECT *, count(*) OVER (PARTITION BY lower(filter)) AS k FROM j)
SELECT n.filter, n.binning, concat('masterFlat_', replace(n.filter, ' ', '_'), CASE WHEN k > 1 THEN concat('_bin', CAST(n.binning AS VARCHAR)) ELSE '' END, '.xisf') AS name, n.flats, n.parts,
  CASE WHEN n.flats < 2 THEN 'only 1 of 2 flats' WHEN m.e IS NOT NULL THEN 'no dark fits' END AS skip FROM n LEFT JOIN miss m ON n.filter = m.filter AND n.binning = m.binning"""))
def flat_jobs(spark, sf):
    j = op.flat_jobs(job_flats(spark, sf), test_darks(spark, sf))
    return j.withColumn("skip", F.regexp_replace("skip", "^no dark fits .*$", "no dark fits"))


@query("dark_match_summary", with_views("flats darks", FIRSTS + """ SELECT filter, binning, round(exposure, 6) AS exposure, gain, CASE WHEN pick IS NULL THEN 'no dark' WHEN tier < 3 THEN 'master dark' ELSE concat('raw darks, ', CAST(n AS VARCHAR), ' to combine') END AS line FROM firsts"""))
def dark_match_summary(spark, sf):
    lines = op.dark_match_lines(job_flats(spark, sf), test_darks(spark, sf))
    return lines.select("filter", "binning", F.round("exposure", 6).alias("exposure"), "gain", "line")


@query("verify_master", with_views("flats", """SELECT flat_id, CASE WHEN flat_id % 11 = 0 THEN 'unreadable result' WHEN flat_id % 7 = 0 THEN 'other width or height' WHEN flat_id % 5 = 0 THEN concat('filter missing instead of ', filter)
  WHEN flat_id % 13 = 0 THEN concat('filter X instead of ', filter) WHEN flat_id % 3 = 0 THEN 'type LIGHT, not a flat' WHEN flat_id % 2 = 0 THEN 'mean not above zero' END AS problem FROM flats"""))
def verify_master(spark, sf):
    i = F.col("flat_id")
    r = flats(spark, sf).select(
        "flat_id", F.col("filter").alias("want_filter"), F.lit(100).alias("want_width"), F.lit(80).alias("want_height"),
        F.when(i % 11 != 0, 100).alias("width"), F.when(i % 7 == 0, 81).otherwise(80).alias("height"),
        F.when(i % 5 == 0, None).when(i % 13 == 0, "X").otherwise(F.col("filter")).alias("filter"),
        F.when(i % 3 == 0, "LIGHT").otherwise("Master Flat").alias("image_type"),
        F.when(i % 2 == 0, F.lit(float("nan"))).otherwise(0.5).alias("mean"))
    return op.verify_master(r).select("flat_id", "problem")


# --- schedules ------------------------------------------------------------------------------------

LIGHTS = "lights AS (SELECT concat('/card/', path, CASE WHEN flat_id % 2 = 0 THEN '.FIT' ELSE '.fits' END) AS path, filter FROM flats WHERE flat_id % 3 = 0 AND filter <> 'S')"
SERVED = "served AS (SELECT concat('/card/fl/', CASE WHEN flat_id % 10 = 1 THEN path ELSE upper(path) END, '.fit') AS path, filter FROM flats WHERE flat_id % 3 = 1 UNION ALL SELECT concat('/card/fl/', CASE WHEN flat_id % 10 = 1 THEN path ELSE upper(path) END, '.fit'), filter FROM flats WHERE flat_id % 6 = 1)"


def schedule_inputs(spark, sf):
    flats(spark, sf).createOrReplaceTempView("flats")
    return spark.sql("WITH " + LIGHTS + " SELECT * FROM lights"), spark.sql("WITH " + SERVED + " SELECT * FROM served")


@query("import_manifest", with_views("flats", LIGHTS + ",\n" + SERVED + """ SELECT 'light' AS kind, path AS src, concat('/out/Light/', regexp_replace(string_split(path, '/')[-1], '\\.(fit|fits)$', '.xisf', 'i')) AS dst FROM lights
  UNION ALL SELECT DISTINCT 'flat', path, concat('/out/Flat/', regexp_replace(string_split(path, '/')[-1], '\\.(fit|fits)$', '.xisf', 'i')) FROM served WHERE filter IN (SELECT filter FROM lights)"""))
def import_manifest(spark, sf):
    lights, served = schedule_inputs(spark, sf)
    return op.import_manifest(lights, served, "/out").select("kind", "src", "dst")


@query("schedule_union", with_views("flats", LIGHTS + ",\n" + SERVED + """, clash AS (SELECT path, filter FROM served UNION ALL SELECT concat('/other/', string_split(path, '/')[-1]), filter FROM served WHERE filter = 'E'),
d AS (SELECT lower(concat('/out/Flat/', regexp_replace(string_split(path, '/')[-1], '\\.(fit|fits)$', '.xisf', 'i'))) AS dst, path FROM clash WHERE filter IN (SELECT filter FROM lights))
SELECT dst, min(path) AS a, max(path) AS b FROM d GROUP BY dst HAVING min(path) <> max(path)"""))
def schedule_union(spark, sf):
    lights, served = schedule_inputs(spark, sf)
    other = served.filter("filter = 'E'").withColumn("path", F.concat(F.lit("/other/"), F.element_at(F.split("path", "/"), -1)))
    return op.collisions(op.scheduled(lights, served.unionByName(other), "/out"))


@query("skip_incomplete_filters", with_views("flats", """jobs AS (SELECT DISTINCT filter, CASE WHEN filter = 'E' THEN 'old reason' END AS skip FROM flats),
tagged AS (SELECT path AS src, CASE WHEN flat_id % 100 = 1 THEN NULL ELSE filter END AS filter, flat_id FROM flats), failed AS (SELECT filter FROM tagged WHERE flat_id % 50 = 1),
n AS (SELECT j.filter, j.skip, (SELECT count(*) FROM failed f WHERE f.filter = j.filter) + (SELECT count(*) FROM failed WHERE filter IS NULL) AS k FROM jobs j)
SELECT filter, coalesce(skip, CASE WHEN k > 0 THEN concat(CAST(k AS VARCHAR), ' flats were not copied') END) AS skip FROM n"""))
def skip_incomplete_filters(spark, sf):
    f = flats(spark, sf)
    jobs = f.select("filter").distinct().withColumn("skip", F.when(F.col("filter") == "E", "old reason"))
    tagged = f.select("flat_id", F.col("path").alias("src"), F.when(F.col("flat_id") % 100 != 1, F.col("filter")).alias("filter"))
    return op.skip_incomplete_filters(jobs, tagged, tagged.filter("flat_id % 50 = 1"))

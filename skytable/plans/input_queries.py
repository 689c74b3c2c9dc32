"""Queries over the ``files`` and ``headers`` views: inputs, names, keys and stage reuse."""

from __future__ import annotations

from pyspark.sql import functions as F

from skytable.functions import keys
from skytable.functions.storage import fresh_path, written
from skytable.operators import inputs as op
from skytable.operators import stages
from skytable.plans.frame_queries import FINAL, JUDGED, OVERRIDE, judged
from skytable.plans.registry import query
from skytable.plans.views import table, view, with_views


def files(spark, sf):
    return view(spark, sf, "files")


def run_sql(spark, sf, ctes: str, name: str, *views: str):
    for v in views:
        view(spark, sf, v).createOrReplaceTempView(v)
    return spark.sql(f"WITH {ctes} SELECT * FROM {name}")


# --- headers ---------------------------------------------------------------------------

HEAD = """hd AS (SELECT concat('/night/f', CAST(image_id AS VARCHAR(9)), CASE WHEN image_id % 5 = 0 THEN '_c.xisf' ELSE '.fits' END) AS path, image_id, CASE key WHEN 'user0' THEN 'FILTER' WHEN 'assistant1' THEN 'EXPTIME' WHEN 'user2' THEN 'XBINNING' WHEN 'assistant3' THEN 'HISTORY' WHEN 'user4' THEN 'IMAGETYP' ELSE key END AS key,
  CASE WHEN image_id % 3 = 0 THEN concat('''', value, '  ''') WHEN image_id % 7 = 0 THEN '  ' ELSE value END AS value FROM headers)"""
CLEAN = HEAD + """, cl AS (SELECT path, key, nullif(trim(regexp_replace(trim(value), '^''(.*)''$', '\\1', 's')), '') AS v FROM hd)"""


@query("entries_from_headers", with_views("headers", CLEAN + """ SELECT path, min(v) FILTER (WHERE key = 'FILTER') AS filter, min(v) FILTER (WHERE key = 'EXPTIME') AS exposure, min(v) FILTER (WHERE key = 'XBINNING') AS binning, min(v) FILTER (WHERE key = 'IMAGETYP') AS image_type,
  CASE WHEN path LIKE '%\\_c.xisf' ESCAPE '\\' THEN 'yes' WHEN bool_or(key = 'HISTORY' AND v IS NOT NULL) THEN 'history' ELSE 'unknown' END AS calibrated FROM cl GROUP BY path"""))
def entries_from_headers(spark, sf):
    e = op.entries_from_headers(run_sql(spark, sf, HEAD, "hd", "headers"))
    return e.select("path", "filter", "exposure", "binning", "image_type", "calibrated")


SAME = "same AS (SELECT image_id, key, value FROM headers UNION ALL SELECT DISTINCT image_id, 'TELESCOP', CASE WHEN image_id % 2 = 0 THEN ' scope' ELSE 'scope ' END FROM headers UNION ALL SELECT DISTINCT image_id, 'OBSERVER', CASE WHEN image_id = 3 THEN 'other' ELSE 'me' END FROM headers)"


@query("inconsistent_keywords", with_views("headers", SAME + " SELECT trim(key) AS key FROM same GROUP BY trim(key) HAVING count(DISTINCT trim(value)) > 1 OR count(DISTINCT image_id) < (SELECT count(DISTINCT image_id) FROM headers)"))
def inconsistent_keywords(spark, sf):
    return op.inconsistent_keywords(run_sql(spark, sf, SAME, "same", "headers"))


SOLVED = "hs AS (SELECT image_id, CASE key WHEN 'user0' THEN 'RA' WHEN 'assistant1' THEN 'DEC' WHEN 'user2' THEN 'FOCALLEN' WHEN 'assistant3' THEN 'XPIXSZ' WHEN 'user4' THEN 'OBJCTRA' ELSE key END AS key, CASE WHEN image_id % 4 = 0 THEN '''0''' WHEN image_id % 4 = 1 THEN value ELSE '''530.5 ''' END AS value FROM headers UNION ALL SELECT DISTINCT image_id, unnest_key, '1.5' FROM headers CROSS JOIN (SELECT 'crval1' AS unnest_key UNION ALL SELECT 'CRVAL2' UNION ALL SELECT 'CRPIX1' UNION ALL SELECT 'CRPIX2' UNION ALL SELECT 'CD1_1' UNION ALL SELECT 'CD1_2' UNION ALL SELECT 'CD2_1' UNION ALL SELECT 'CD2_2') WHERE image_id % 3 = 0)"


@query("header_completeness", with_views("headers", SOLVED + """ SELECT image_id, count(DISTINCT upper(key)) FILTER (WHERE upper(key) IN ('CRVAL1', 'CRVAL2', 'CRPIX1', 'CRPIX2', 'CD1_1', 'CD1_2', 'CD2_1', 'CD2_2')) = 8 AS solved,
  concat_ws(',', CASE WHEN count(DISTINCT key) FILTER (WHERE key IN ('RA', 'DEC')) < 2 THEN 'RA/DEC' END, CASE WHEN NOT coalesce(bool_or(key = 'FOCALLEN' AND coalesce(TRY_CAST(trim(replace(value, '''', '')) AS DOUBLE), 0) > 0), FALSE) THEN 'FOCALLEN' END,
  CASE WHEN NOT coalesce(bool_or(key = 'XPIXSZ' AND coalesce(TRY_CAST(trim(replace(value, '''', '')) AS DOUBLE), 0) > 0), FALSE) THEN 'XPIXSZ' END) AS missing FROM hs GROUP BY image_id"""))
def header_completeness(spark, sf):
    h = op.header_completeness(run_sql(spark, sf, SOLVED, "hs", "headers"))
    return h.select("image_id", "solved", F.array_join("missing", ",").alias("missing"))


# --- filters, cameras, names -----------------------------------------------------------

FILTERS = """fl AS (SELECT p_partkey AS id, CASE p_partkey % 16 WHEN 0 THEN 'H-alpha' WHEN 1 THEN 'Ha' WHEN 2 THEN 'S II' WHEN 3 THEN 'O3' WHEN 4 THEN 'Lum' WHEN 5 THEN 'red ' WHEN 6 THEN 'GREEN' WHEN 7 THEN 'b' WHEN 8 THEN p_name WHEN 9 THEN 'Optolong L-eXtreme 2"'
  WHEN 10 THEN 'ALP-T SII+Hb' WHEN 11 THEN 'Antlia ALP-T Hα/OIII 5nm' WHEN 12 THEN '' WHEN 13 THEN 'Duo narrow' WHEN 14 THEN 'Baader 6.5nm Ha 36 mm' ELSE 'UV/IR cut' END AS filter, concat('/m/', p_name) AS path FROM part)"""


def filters(spark, sf):
    table(spark, sf, "part").createOrReplaceTempView("part")
    return spark.sql("WITH " + FILTERS + " SELECT * FROM fl")


@query("channel_from_filter", "WITH " + FILTERS + """, n AS (SELECT id, regexp_replace(lower(filter), '[^a-z0-9]', '', 'g') AS f FROM fl) SELECT id, CASE WHEN f IN ('l', 'r', 'g', 'b', 'h', 's', 'o') THEN upper(f) WHEN contains(f, 'halpha') OR f = 'ha' THEN 'H'
  WHEN contains(f, 'sii') OR f = 's2' THEN 'S' WHEN contains(f, 'oiii') OR f = 'o3' THEN 'O' WHEN contains(f, 'lum') THEN 'L' WHEN contains(f, 'red') THEN 'R' WHEN contains(f, 'green') THEN 'G' WHEN contains(f, 'blue') THEN 'B' END AS channel FROM n""")
def channel_from_filter(spark, sf):
    return filters(spark, sf).select("id", op.channel_from_filter(F.col("filter")).alias("channel"))


CHOICES = "ch AS (SELECT 'filter:duonarrow' AS choice_key, 'halpha' AS choice UNION ALL SELECT 'filter:alptsiihb', 'broadband' UNION ALL SELECT 'path:/m/red widget', 'dualband')"
KINDS = FILTERS + """,
k AS (SELECT id, path, filter, CASE id % 16 WHEN 0 THEN 'halpha' WHEN 1 THEN 'halpha' WHEN 9 THEN 'dualband' WHEN 10 THEN 'unsupported' WHEN 11 THEN 'dualband' WHEN 12 THEN 'broadband' WHEN 13 THEN 'dualband' WHEN 14 THEN 'halpha' WHEN 15 THEN 'broadband' END AS kind,
  CASE id % 16 WHEN 9 THEN 7e0 WHEN 11 THEN 5e0 WHEN 14 THEN 65e-1 END AS ha_nm, id % 16 <> 13 AS sure FROM fl)"""


@query("colour_filter_info", "WITH " + KINDS + ", " + CHOICES + """ SELECT k.id, k.kind AS osc_kind, k.ha_nm, CASE WHEN k.kind = 'unsupported' THEN k.kind WHEN id % 16 = 13 THEN 'halpha' WHEN k.id % 16 = 12 AND c.choice IS NOT NULL THEN c.choice WHEN k.sure THEN k.kind END AS kind,
  CASE WHEN k.kind = 'unsupported' THEN 'detected' WHEN k.id % 16 = 13 OR (k.id % 16 = 12 AND c.choice IS NOT NULL) THEN 'choice' WHEN k.sure AND k.kind IS NOT NULL THEN 'detected' ELSE 'none' END AS kind_source FROM k LEFT JOIN ch c ON c.choice_key = concat('path:', k.path)""")
def colour_filter_info(spark, sf):
    f = filters(spark, sf)
    k = op.effective_kind(f, spark.sql("WITH " + CHOICES + " SELECT * FROM ch"))
    return k.select("id", "osc_kind", "ha_nm", "kind", "kind_source")


CAMERAS = "cm AS (SELECT c_custkey AS id, CASE c_custkey % 7 WHEN 0 THEN 'ZWO ASI2600MM Pro' WHEN 1 THEN 'QHY 268M' WHEN 2 THEN 'ASI 1600' WHEN 3 THEN 'KAF-8300' WHEN 4 THEN c_name WHEN 5 THEN '' END AS camera FROM customer)"


@query("camera_lookup", "WITH " + CAMERAS + " SELECT id, CASE id % 7 WHEN 0 THEN 'Sony IMX411/455/461/533/571' WHEN 1 THEN 'Sony IMX411/455/461/533/571' WHEN 2 THEN 'Panasonic MN34230 (ASI1600MM)' WHEN 3 THEN 'KAF-8300' END AS curve FROM cm")
def camera_lookup(spark, sf):
    table(spark, sf, "customer").createOrReplaceTempView("customer")
    return spark.sql("WITH " + CAMERAS + " SELECT * FROM cm").select("id", op.camera_curve(F.col("camera")).alias("curve"))


MASTERS = """ms AS (SELECT file_id AS seq, file_id % 50 AS run, concat('masterLight_FILTER-', CASE file_id % 4 WHEN 0 THEN 'Ha' WHEN 1 THEN 'Lum' WHEN 2 THEN 'x9' ELSE 'SII' END, CASE WHEN file_id % 3 = 0 THEN '_drizzle_2x' ELSE '' END, CASE WHEN file_id % 5 = 0 THEN '_Autocrop' ELSE '' END, CASE WHEN file_id % 11 = 0 THEN '_RGB.xisf' ELSE '.xisf' END) AS name,
  concat('/data/', folder, '/masters/m', CAST(file_id AS VARCHAR(9)), '.xisf') AS path, CASE file_id % 4 WHEN 0 THEN 'H' WHEN 1 THEN 'L' WHEN 3 THEN 'S' END AS channel, CASE WHEN file_id % 3 = 0 THEN '2x' ELSE '' END AS drizzle, file_id % 5 = 0 AS autocrop, CAST(size % 40 AS DOUBLE) AS mtime FROM files)"""


@query("parse_master_name", with_views("files", MASTERS + " SELECT seq, CASE seq % 4 WHEN 0 THEN 'Ha' WHEN 1 THEN 'Lum' WHEN 2 THEN 'x9' ELSE 'SII' END AS name_filter, channel AS name_channel, drizzle AS name_drizzle, autocrop AS name_autocrop, seq % 11 = 0 AS name_colour FROM ms"))
def parse_master_name(spark, sf):
    m = run_sql(spark, sf, MASTERS, "ms", "files")
    return op.parse_master_name(m).select("seq", "name_filter", "name_channel", "name_drizzle", "name_autocrop", "name_colour")


DRIZZLE = """dz AS (SELECT file_id, CASE file_id % 6 WHEN 0 THEN '<instance class="DrizzleIntegration"><parameter id="scale" value="1"/></instance><instance class="DrizzleIntegration"><parameter id="scale" value="2.02"/>' WHEN 1 THEN '&lt;instance class=&quot;DrizzleIntegration&quot;&gt;'
  WHEN 2 THEN '<instance class="ImageIntegration">' WHEN 3 THEN '<instance class="DrizzleIntegration"><instance class="Other"><parameter id="scale" value="9"/>' END AS history, CASE file_id % 6 WHEN 4 THEN 'process=ImageIntegration' END AS signature, CASE WHEN file_id % 5 = 0 THEN '1.88' WHEN file_id % 5 = 1 THEN 'x' ELSE '3.76' END AS pixel FROM files)"""


@query("drizzle_label", with_views("files", DRIZZLE + " SELECT file_id, CASE file_id % 6 WHEN 0 THEN '2x' WHEN 2 THEN '' WHEN 4 THEN '' WHEN 5 THEN CASE WHEN file_id % 5 = 0 THEN '2x' ELSE '' END ELSE CASE WHEN file_id % 5 = 0 THEN '2x' ELSE 'drizzle' END END AS label FROM dz"))
def drizzle_label(spark, sf):
    d = run_sql(spark, sf, DRIZZLE, "dz", "files")
    return d.select("file_id", op.drizzle_label(F.col("history"), F.col("signature"), F.col("pixel")).alias("label"))


PICKS = MASTERS + ", rk AS (SELECT *, CASE WHEN drizzle <> '' THEN 2 ELSE 0 END + CASE WHEN autocrop THEN 1 ELSE 0 END AS rank FROM ms WHERE channel IS NOT NULL), pk AS (SELECT *, row_number() OVER (PARTITION BY run, channel ORDER BY rank DESC, mtime DESC, seq) AS rn FROM rk)"


@query("select_masters", with_views("files", PICKS + " SELECT run, channel, seq, rank FROM pk WHERE rn = 1"))
def select_masters(spark, sf):
    return op.select_masters(run_sql(spark, sf, MASTERS, "ms", "files"), "run").select("run", "channel", "seq", "rank")


@query("same_channel_alternatives", with_views("files", PICKS + """, al AS (SELECT b.*, p.mtime AS pm, row_number() OVER (PARTITION BY b.run, b.channel ORDER BY b.mtime DESC, b.seq) AS place FROM pk b JOIN pk p ON p.rn = 1 AND b.run = p.run AND b.channel = p.channel AND b.rank = p.rank AND b.path <> p.path)
SELECT run, channel, seq, place, CASE WHEN pm > 0 AND mtime > 0 THEN round(1e2 * (pm - mtime) / mtime, 6) END AS delta FROM al WHERE place <= 2"""))
def same_channel_alternatives(spark, sf):
    m = run_sql(spark, sf, MASTERS, "ms", "files")
    a = op.alternatives(m, 2, "run").join(op.select_masters(m, "run").select("run", "channel", F.col("mtime").alias("pm")), ["run", "channel"])
    return a.select("run", "channel", "seq", F.col("place").cast("long").alias("place"), F.round(op.quality_delta(F.col("pm"), F.col("mtime")), 6).alias("delta"))


INSTR = "ins AS (SELECT c_custkey AS id, c_custkey // 5 AS run, CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey // 5 % 4 = 0 AND c_custkey % 5 = 1 THEN 'other' WHEN c_custkey // 5 % 7 = 0 THEN NULL ELSE 'cam' END AS instrument FROM customer)"


@query("common_instrument", "WITH " + INSTR + ", c AS (SELECT run, min(nullif(instrument, '')) AS a FROM ins GROUP BY run HAVING count(DISTINCT nullif(instrument, '')) = 1) SELECT id, coalesce(nullif(instrument, ''), c.a) AS camera, nullif(instrument, '') IS NULL AND c.a IS NOT NULL AS inherited FROM ins LEFT JOIN c ON ins.run = c.run")
def common_instrument(spark, sf):
    table(spark, sf, "customer").createOrReplaceTempView("customer")
    i = spark.sql("WITH " + INSTR.replace("c_custkey // 5", "CAST(floor(c_custkey / 5) AS BIGINT)") + " SELECT * FROM ins")
    return op.common_instrument(i).select("id", "camera", "inherited")


@query("created_time", with_views("files", """SELECT file_id, CAST(CASE file_id % 5 WHEN 0 THEN 1577836800000 + (file_id % 28) * 86400000 WHEN 1 THEN 1577836800000 + (file_id % 28) * 86400000 + 3600000 WHEN 2 THEN size * 1000 WHEN 3 THEN 5000 ELSE 0 END AS BIGINT) AS created FROM files"""))
def created_time(spark, sf):
    i = F.col("file_id")
    day = F.date_format(F.timestamp_seconds(1577836800 + (i % 28) * 86400), "yyyy-MM-dd")
    text = F.when(i % 5 == 0, day).when(i % 5 == 1, F.concat(day, F.lit("T01:00:00Z"))).when(i % 5 == 2, "not a date")
    first = F.when(i % 5 == 2, F.col("size") * 1000).otherwise(F.lit(0))
    second = F.when(i % 5 == 3, F.lit(5000)).otherwise(F.lit(None)).cast("long")
    return files(spark, sf).select("file_id", op.created_ms(text, first, second).alias("created"))


# --- channel rules -----------------------------------------------------------------------

SLOTS = """sl AS (SELECT file_id AS seq, file_id % 90 AS run, CASE file_id % 13 WHEN 0 THEN 'L' WHEN 1 THEN 'R' WHEN 2 THEN 'G' WHEN 3 THEN 'B' WHEN 4 THEN 'H' WHEN 5 THEN 'S' WHEN 6 THEN 'O' WHEN 7 THEN 'OSC' WHEN 8 THEN 'OSCNB' WHEN 9 THEN 'OSCHA' ELSE 'L' END AS slot,
  concat('C:', CASE WHEN file_id % 2 = 0 THEN '/' ELSE '\\' END, 'm', CAST(file_id % 400 AS VARCHAR(9)), '.fits') AS path, CASE WHEN file_id % 4 = 0 THEN 3 WHEN file_id % 9 = 0 THEN 2 WHEN file_id % 7 <> 0 THEN 1 END AS number_of_channels FROM files WHERE file_id % 90 <> file_id % 7 + 80)"""
SLOTS_SPARK = SLOTS.replace("'\\'", "'\\\\'")
SUPPLIED = SLOTS + """,
mem AS (SELECT DISTINCT run, unnest(CASE slot WHEN 'OSC' THEN ['R', 'G', 'B'] WHEN 'OSCNB' THEN ['H', 'O'] WHEN 'OSCHA' THEN ['H'] ELSE [slot] END) AS c FROM sl)"""


def slots(spark, sf):
    return run_sql(spark, sf, SLOTS_SPARK, "sl", "files")


@query("channel_rules", with_views("files", SUPPLIED + """, h AS (SELECT run, count(*) FILTER (WHERE c IN ('R', 'G', 'B')) AS n, count(*) FILTER (WHERE c IN ('H', 'S', 'O')) AS nb FROM mem GROUP BY run),
m AS (SELECT run, string_agg(c, ', ' ORDER BY o) AS miss FROM (SELECT h.run, x.c, x.o FROM h CROSS JOIN (SELECT 'R' AS c, 1 AS o UNION ALL SELECT 'G', 2 UNION ALL SELECT 'B', 3) x WHERE NOT EXISTS (SELECT 1 FROM mem WHERE mem.run = h.run AND mem.c = x.c)) GROUP BY run),
k AS (SELECT run, bool_or(slot LIKE 'OSC%') AS col, bool_or(slot NOT LIKE 'OSC%') AS mono, bool_or(slot = 'OSCHA') AND bool_or(slot = 'OSCNB') AS twice FROM sl GROUP BY run)
SELECT h.run, concat('RGB needs all of its channels; absent: ', miss, '.') AS problem FROM h JOIN m ON h.run = m.run WHERE n BETWEEN 1 AND 2
UNION ALL SELECT run, 'no RGB and no narrowband channel given' FROM h WHERE n = 0 AND nb = 0 UNION ALL SELECT run, 'mono and colour masters are mixed' FROM k WHERE col AND mono
UNION ALL SELECT run, 'H comes from two colour masters' FROM k WHERE twice"""))
def channel_rules(spark, sf):
    return op.channel_problems(slots(spark, sf))


@query("channel_count_problems", with_views("files", SLOTS + """ SELECT seq, CASE WHEN number_of_channels IS NULL THEN 'unknown number of channels' WHEN number_of_channels = 3 THEN 'three channels where one is due' ELSE 'neither one channel nor three' END AS problem FROM sl
  WHERE slot NOT LIKE 'OSC%' AND coalesce(number_of_channels, 0) <> 1"""))
def channel_count_problems(spark, sf):
    return op.count_problems(slots(spark, sf)).select("seq", "problem")


@query("duplicate_files", with_views("files", SLOTS + """, n AS (SELECT *, replace(path, '\\', '/') AS p, first_value(slot) OVER (PARTITION BY run, replace(path, '\\', '/') ORDER BY seq) AS first_slot, row_number() OVER (PARTITION BY run, replace(path, '\\', '/') ORDER BY seq) AS rn FROM (SELECT seq, run % 4 AS run, slot, path FROM sl))
SELECT run, first_slot, slot, path FROM n WHERE rn > 1"""))
def duplicate_files(spark, sf):
    return op.duplicate_files(slots(spark, sf).withColumn("run", F.col("run") % 4))


@query("palette_missing", with_views("files", SUPPLIED + """, w AS (SELECT DISTINCT run, palette FROM sl CROSS JOIN (SELECT 'SHO' AS palette UNION ALL SELECT 'HOO' UNION ALL SELECT 'XYZ')),
need AS (SELECT 'SHO' AS palette, 'S' AS c, 1 AS o UNION ALL SELECT 'SHO', 'H', 2 UNION ALL SELECT 'SHO', 'O', 3 UNION ALL SELECT 'HOO', 'H', 1 UNION ALL SELECT 'HOO', 'O', 2),
m AS (SELECT w.run, w.palette, string_agg(n.c, ',' ORDER BY n.o) AS miss FROM w JOIN need n ON w.palette = n.palette WHERE NOT EXISTS (SELECT 1 FROM mem WHERE mem.run = w.run AND mem.c = n.c) GROUP BY ALL)
SELECT w.run, w.palette, CASE WHEN w.palette <> 'XYZ' THEN coalesce(m.miss, '') END AS missing FROM w LEFT JOIN m ON w.run = m.run AND w.palette = m.palette"""))
def palette_missing(spark, sf):
    s = slots(spark, sf)
    wanted = s.select("run", F.explode(F.array(F.lit("SHO"), F.lit("HOO"), F.lit("XYZ"))).alias("palette")).distinct()
    m = op.palette_missing(s, wanted)
    return m.select("run", "palette", F.when(F.col("missing").isNotNull(), F.array_join("missing", ",")).alias("missing"))


@query("supplied_channels", with_views("files", SUPPLIED + " SELECT run, string_agg(c, '' ORDER BY strpos('LRGBHSO', c)) AS channels FROM mem GROUP BY run"))
def supplied_channels(spark, sf):
    return op.supplied_channels(slots(spark, sf)).select("run", F.array_join("channels", "").alias("channels"))


NAMES = """nm AS (SELECT file_id AS seq, CASE WHEN file_id % 9 = 4 THEN concat(folder, '_', channel, '_1') WHEN file_id % 17 = 3 THEN concat(folder, '_', channel, '_1_2') ELSE concat(folder, '_', channel) END AS base FROM files)"""
TAKEN = "tk AS (SELECT DISTINCT concat(folder, '_', channel) AS name FROM files WHERE channel = 'en' UNION ALL SELECT DISTINCT concat(folder, '_', channel, '_2') FROM files WHERE folder = 'web' UNION ALL SELECT DISTINCT concat(folder, '_', channel, '_5') FROM files)"


@query("unique_names", with_views("files", "RECURSIVE " + NAMES + ", " + TAKEN + """, o AS (SELECT seq, base, row_number() OVER (ORDER BY seq) AS i FROM nm),
given AS (SELECT CAST(0 AS BIGINT) AS i, (SELECT list(name) FROM tk) AS used, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS "unique"
  UNION ALL SELECT i, list_append(used, nxt), seq, nxt FROM (SELECT o.i, g.used, o.seq, list_filter(list_transform(range(0, (SELECT max(c) + 20 FROM (SELECT count(*) AS c FROM nm GROUP BY base))),
    lambda n: CASE WHEN n = 0 THEN o.base ELSE concat(o.base, '_', CAST(n AS VARCHAR)) END), lambda x: NOT list_contains(g.used, x))[1] AS nxt FROM given g JOIN o ON o.i = g.i + 1))
SELECT seq, "unique" FROM given WHERE i > 0"""))
def unique_names(spark, sf):
    n = run_sql(spark, sf, NAMES, "nm", "files")
    return op.unique_names(n, run_sql(spark, sf, TAKEN, "tk", "files"), block_rows=100).select("seq", "unique")


@query("project_name", with_views("files", """p AS (SELECT file_id // 7 AS run, file_id, CASE file_id % 4 WHEN 0 THEN concat('/astro/', folder, '/Masters/m.xisf') WHEN 1 THEN concat('C:\\x\\', channel, '\\calibrated\\m.xisf') WHEN 2 THEN '/master/lights/m.xisf' ELSE concat('/', folder, channel, '/m') END AS path, CASE file_id % 4 WHEN 0 THEN folder WHEN 1 THEN channel WHEN 2 THEN '' ELSE concat(folder, channel) END AS nm FROM files),
r AS (SELECT run, nm, row_number() OVER (PARTITION BY run ORDER BY file_id % 7, file_id) AS rn FROM p WHERE nm <> '') SELECT run, nm AS project FROM r WHERE rn = 1"""))
def project_name(spark, sf):
    i = F.col("file_id")
    path = F.when(i % 4 == 0, F.concat(F.lit("/astro/"), "folder", F.lit("/Masters/m.xisf"))).when(
        i % 4 == 1, F.concat(F.lit("C:\\x\\"), "channel", F.lit("\\calibrated\\m.xisf"))).when(
        i % 4 == 2, F.lit("/master/lights/m.xisf")).otherwise(F.concat(F.lit("/"), "folder", "channel", F.lit("/m")))
    slot = F.array(*[F.lit(c) for c in op.CHANNELS])
    s = files(spark, sf).select(F.floor(i / 7).cast("long").alias("run"), F.element_at(slot, (i % 7 + 1).cast("int")).alias("slot"), path.alias("path"), "file_id")
    return op.run_project(s)


# --- keys and reuse ------------------------------------------------------------------------

@query("hash_and_params", with_views("files", """SELECT file_id, sha1(concat('1||solve|channel=', channel, ';nested={"a":[1,null]};size=', CAST(size AS VARCHAR))) AS first_key,
  sha1(concat('1|', digest, '|mgc|')) AS next_key FROM files"""))
def hash_and_params(spark, sf):
    params = F.create_map(F.lit("size"), F.col("size").cast("string"), F.lit("channel"), F.col("channel"), F.lit("nested"), F.lit('{"a":[1,null]}'))
    none = F.create_map().cast("map<string,string>")
    return files(spark, sf).select("file_id", keys.chain_key(F.lit(None), F.lit("solve"), params).alias("first_key"),
                                   keys.chain_key(F.col("digest"), F.lit("mgc"), none).alias("next_key"))


@query("source_keys", with_views("files", """k AS (SELECT file_id, sha1(concat('file|/data/', folder, '|', CAST(size AS VARCHAR), '|', strftime(make_timestamp((1577836800123 + file_id * 1001) * 1000), '%Y-%m-%dT%H:%M:%S.%g'), 'Z')) AS file_key, digest FROM files)
SELECT file_id, file_key, sha1(concat('rgb|', file_key, '|', digest, '|', file_key, '|crop:1,2,', CAST(file_id AS VARCHAR), ',40|halos:', CASE WHEN file_id % 2 = 0 THEN '1' ELSE '0' END)) AS rgb_key,
  sha1(concat('palette|SHO|', digest, '|', digest, '|', file_key, '|crop:1,2,', CAST(file_id AS VARCHAR), ',40|halos:', CASE WHEN file_id % 2 = 0 THEN '1' ELSE '0' END)) AS palette_key,
  sha1(concat('cleanwb|', digest, '|', file_key, '|', digest, '|crop:1,2,', CAST(file_id AS VARCHAR), ',40|{}|null|ref:', digest)) AS balance_key FROM k"""))
def source_keys(spark, sf):
    i = F.col("file_id")
    k = files(spark, sf).withColumn("file_key", keys.file_source_key(F.concat(F.lit("/data/"), "folder"), F.col("size"), 1577836800123 + i * 1001))
    crop = keys.crop_tag(F.lit(1), F.lit(2), i, F.lit(40))
    tag = keys.crop_halos_tag(crop, i % 2 == 0)
    f, d = F.col("file_key"), F.col("digest")
    return k.select("file_id", "file_key", keys.rgb_source_key(f, d, f, tag).alias("rgb_key"),
                    keys.palette_source_key(F.lit("SHO"), [d, d, f], tag).alias("palette_key"),
                    keys.white_balance_key([d, f, d], crop, F.lit("{}"), F.lit(None).cast("string"), d).alias("balance_key"))


@query("fnv_hash", with_views("files", """t AS (SELECT file_id, concat('/', folder, '/', channel, 'é', CAST(file_id AS VARCHAR), '|', digest) AS s FROM files)
SELECT file_id, lower(lpad(printf('%x', list_reduce(list_prepend(CAST(2166136261 AS BIGINT), [CAST(unicode(c) AS BIGINT) for c in string_split(s, '')]), lambda a, b: (xor(a, b) * 16777619) % 4294967296)), 8, '0')) AS h FROM t"""))
def fnv_hash(spark, sf):
    text = F.concat(F.lit("/"), "folder", F.lit("/"), "channel", F.lit("é"), "file_id", F.lit("|"), "digest")
    return files(spark, sf).select("file_id", keys.fnv_hash(text).alias("h"))


CHAINS = """st AS (SELECT file_id AS chain, stage, digest AS source_key, channel, size FROM files CROSS JOIN (SELECT 'solve' AS stage UNION ALL SELECT 'mgc' UNION ALL SELECT 'stretchRGB' UNION ALL SELECT 'extractL' UNION ALL SELECT 'unknown') WHERE NOT (file_id % 3 = 0 AND stage = 'mgc'))"""
KEYED = CHAINS + """,
k1 AS (SELECT file_id AS chain, sha1(concat('1|', digest, '|solve|channel=', channel)) AS a, digest, channel FROM files),
k2 AS (SELECT *, CASE WHEN chain % 3 = 0 THEN a ELSE sha1(concat('1|', a, '|mgc|channel=', channel)) END AS b FROM k1),
k3 AS (SELECT *, sha1(concat('1|', b, '|stretchRGB|channel=', channel, ';keepLinear=', CASE WHEN chain % 2 = 0 THEN 'true' ELSE 'false' END)) AS c FROM k2),
k4 AS (SELECT *, sha1(concat('1|', c, '|extractL|channel=', channel)) AS d FROM k3),
keyed AS (SELECT chain, 0 AS idx, 'solve' AS stage, a AS key, CAST(NULL AS VARCHAR) AS companion FROM k4 UNION ALL SELECT chain, 1, 'mgc', b, NULL FROM k4 WHERE chain % 3 <> 0
  UNION ALL SELECT chain, CASE WHEN chain % 3 = 0 THEN 1 ELSE 2 END, 'stretchRGB', c, CASE WHEN chain % 2 = 0 THEN 'linear' END FROM k4 UNION ALL SELECT chain, CASE WHEN chain % 3 = 0 THEN 2 ELSE 3 END, 'extractL', d, 'stars' FROM k4)"""


def chains(spark, sf):
    s = run_sql(spark, sf, CHAINS, "st", "files")
    p = F.when(F.col("stage") == "stretchRGB", F.create_map(
        F.lit("keepLinear"), F.when(F.col("chain") % 2 == 0, "true").otherwise("false"), F.lit("channel"), F.col("channel"))).otherwise(
        F.create_map(F.lit("channel"), F.col("channel")))
    return stages.stage_keys(s.withColumn("params", p))


@query("stage_keys", with_views("files", KEYED + " SELECT chain, idx, stage, key, companion FROM keyed"))
def stage_keys(spark, sf):
    return chains(spark, sf)


STORE = """SELECT DISTINCT key, chain % 5 <> 0 AS complete, chain % 4 <> 0 AS companion_present FROM keyed WHERE (chain + idx) % 3 <> 1"""


@query("latest_reusable_stage", with_views("files", KEYED + f""", store AS ({STORE}), hit AS (SELECT k.chain, max(k.idx) AS idx FROM keyed k JOIN store s ON k.key = s.key WHERE s.complete AND (k.companion IS NULL OR s.companion_present) GROUP BY k.chain)
SELECT f.file_id AS chain, coalesce(h.idx, -1) AS idx, k.stage FROM files f LEFT JOIN hit h ON f.file_id = h.chain LEFT JOIN keyed k ON k.chain = h.chain AND k.idx = h.idx"""))
def latest_reusable_stage(spark, sf):
    c = written(chains(spark, sf), "chains")
    store = c.filter((F.col("chain") + F.col("idx")) % 3 != 1).select(
        "key", (F.col("chain") % 5 != 0).alias("complete"), (F.col("chain") % 4 != 0).alias("companion_present")).distinct()
    return stages.latest_reusable(c, store).select("chain", "idx", "stage")


@query("stage_chain", with_views("files", "SELECT channel, count(*) AS files, CAST(sum(size * 2 + 1) AS BIGINT) AS size, 1 AS ran_again FROM files GROUP BY channel"))
def stage_chain(spark, sf):
    root = fresh_path(spark, "stages")
    plan = [("solve", {"k": "2"}, lambda d: d.withColumn("size", F.col("size") * 2)), ("mgc", {}, None),
            ("register", {"k": "1"}, lambda d: d.withColumn("size", F.col("size") + 1))]
    stages.run_chain(files(spark, sf), "source", plan, root)
    last = ("combine", {}, lambda d: d.groupBy("channel").agg(F.count("*").alias("files"), F.sum("size").alias("size")))
    df, ran = stages.run_chain(files(spark, sf), "source", [*plan, last], root)
    return df.withColumn("ran_again", F.lit(len(ran)))


AGED = "ag AS (SELECT file_id, digest AS key, size AS bytes, 1577836800000 + (file_id * 7919 % 1000) * 3600000 + file_id AS used FROM files)"


@query("lru_evictions", with_views("files", """ag AS (SELECT concat('k', CAST(file_id AS VARCHAR)) AS key, size AS bytes, 1577836800000 + (file_id * 7919 % 1000) * 3600000 + file_id AS used FROM files),
r AS (SELECT *, sum(bytes) OVER (ORDER BY used, key) - bytes AS before FROM ag WHERE key <> 'k5') SELECT key FROM r WHERE (SELECT sum(bytes) FROM ag) - before > 400000"""))
def lru_evictions(spark, sf):
    i = F.col("file_id")
    e = files(spark, sf).select(F.concat(F.lit("k"), i).alias("key"), F.col("size").alias("bytes"),
                                (1577836800000 + (i * 7919 % 1000) * 3600000 + i).alias("used"))
    return stages.lru_evictions(e, 400000, "k5").select("key")


@query("identity_recheck", with_views("files", """SELECT file_id, CASE WHEN file_id % 7 = 0 OR file_id % 5 = 0 OR file_id % 11 = 0 THEN 'skipped' END AS outcome FROM files"""))
def identity_recheck(spark, sf):
    f = files(spark, sf).withColumn("path", F.concat(F.lit("p"), "file_id"))
    now = f.filter("file_id % 7 <> 0").select("path", F.when(F.col("file_id") % 5 == 0, F.sha1("digest")).otherwise(F.col("digest")).alias("digest"),
                                              F.when(F.col("file_id") % 11 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"))
    return stages.identity_recheck(f, now).select("file_id", "outcome")


@query("digest_cache_hit", with_views("files", """SELECT file_id, CASE WHEN file_id % 3 <> 0 AND file_id % 5 <> 0 AND file_id % 7 <> 0 THEN digest END AS cached_digest, file_id % 4 >= 2 AND (file_id % 2 = 0 OR file_id % 8 >= 4) AS remembered FROM files"""))
def digest_cache_hit(spark, sf):
    i = F.col("file_id")
    f = files(spark, sf).withColumns({
        "path": F.concat(F.lit("p"), "file_id"), "mtime": (i * 1000).cast("long"),
        "created": F.when(i % 2 == 1, i * 1000 + F.when(i % 8 >= 4, 0).otherwise(5000)).cast("long"), "at": (i * 1000 + (i % 4) * 1000).cast("long")})
    cache = f.filter("file_id % 3 <> 0").select(
        "path", "size", F.when(i % 5 == 0, F.col("mtime") + 1).otherwise(F.col("mtime")).alias("mtime"),
        F.when(i % 7 == 0, F.lit(-1)).otherwise(F.col("created")).alias("created"), "digest")
    hits = stages.digest_cache_hits(f, cache).select("file_id", "cached_digest")
    kept = stages.digests_to_remember(f).select("file_id", F.lit(True).alias("r"))
    return hits.join(kept, "file_id", "left").select("file_id", "cached_digest", F.coalesce("r", F.lit(False)).alias("remembered"))


@query("measurement_cache", with_views("files", """SELECT file_id, CASE WHEN file_id % 3 = 0 THEN 'measure' WHEN file_id % 5 = 0 THEN 'measure' ELSE 'cached' END AS source, CASE WHEN file_id % 3 <> 0 AND file_id % 5 <> 0 THEN 2e0 + size / 1e3 END AS fwhm FROM files"""))
def measurement_cache(spark, sf):
    f = files(spark, sf).withColumn("key", stages.config_key("m1", F.lit("cfg"), F.concat("digest", F.lit("-"), "file_id")))

    def metrics(fwhm):
        names = [k for k in stages.STORED_KEYS if k != "fwhm"]
        full = F.map_from_arrays(F.array(F.lit("fwhm"), *[F.lit(k) for k in names]), F.array(fwhm, *[F.lit(None).cast("double") for _ in names]))
        return F.when(F.col("file_id") % 5 == 0, F.map_filter(full, lambda k, _: k != "stars")).otherwise(full)
    old = f.filter("file_id % 3 <> 0").select("key", F.lit(1).alias("stored_at"), metrics(F.lit(0.0)).alias("metrics"))
    new = f.filter("file_id % 3 <> 0").select("key", F.lit(2).alias("stored_at"), metrics(2.0 + F.col("size") / 1e3).alias("metrics"))
    root = fresh_path(spark, "measurements")
    old.write.parquet(root)
    new.write.mode("append").parquet(root)
    have, need = stages.measurement_split(f, spark.read.parquet(root))
    return have.select("file_id", F.lit("cached").alias("source"), F.col("metrics")["fwhm"].alias("fwhm")).unionByName(
        need.select("file_id", F.lit("measure").alias("source"), F.lit(None).cast("double").alias("fwhm")))


@query("write_manifest_and_journal", with_views("frames", JUDGED + f""", rj AS (SELECT * FROM (SELECT *, {FINAL} AS final FROM (SELECT *, {OVERRIDE} AS override FROM judged)) WHERE final = 'rejected')
SELECT path, state AS auto_verdict, override, CASE WHEN frame_id % 2 = 0 THEN 'moved' END AS outcome, frame_id % 2 <> 0 AS pending FROM rj"""))
def write_manifest_and_journal(spark, sf):
    rows = judged(spark, sf).withColumns({"channel": F.col("filter"), "digest": F.sha1("path"), "size": F.lit(1), "mtime": F.lit(1)})
    manifest = written(stages.build_manifest(rows), "manifest")
    root = fresh_path(spark, "outcomes")
    done = manifest.filter(F.regexp_extract("path", r"f(\d+)", 1).cast("long") % 2 == 0)
    for n, outcome in enumerate(("tried", "moved")):
        done.select("path", F.lit(outcome).alias("outcome"), F.lit(None).cast("string").alias("detail"), F.lit(n).alias("recorded_at")).write.mode("append").parquet(root)
    outcomes = spark.read.parquet(root)
    pending = stages.manifest_pending(manifest, outcomes).select("path", F.lit(True).alias("p"))
    out = stages.with_outcomes(manifest, outcomes).join(pending, "path", "left")
    return out.select("path", "auto_verdict", "override", "outcome", F.col("p").isNotNull().alias("pending"))

"""Queries over the ``frames`` view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytable.functions.storage import checkpointed
from skytable.operators import frames as op
from skytable.plans.registry import query
from skytable.plans.views import view, with_views

VALID = """valid AS (SELECT * FROM frames WHERE fwhm > 0 AND eccentricity > 0 AND stars > 0 AND psf_snr > 0),
long AS (SELECT filter, 'psf_snr' AS metric, CAST(psf_snr AS DOUBLE) AS value FROM valid UNION ALL SELECT filter, 'fwhm', fwhm FROM valid
  UNION ALL SELECT filter, 'eccentricity', eccentricity FROM valid UNION ALL SELECT filter, 'stars', CAST(stars AS DOUBLE) FROM valid),
mids AS (SELECT filter, metric, count(*) AS n, median(value) AS med FROM long GROUP BY filter, metric),
devs AS (SELECT l.filter, l.metric, 14826e-4 * median(abs(l.value - m.med)) AS sd FROM long l JOIN mids m ON l.filter = m.filter AND l.metric = m.metric GROUP BY l.filter, l.metric),
stats AS (SELECT m.filter, m.metric, m.n, m.med, d.sd, CASE WHEN m.metric IN ('fwhm', 'eccentricity') THEN m.med + 25e-1 * d.sd ELSE m.med - 25e-1 * d.sd END AS bound
  FROM mids m JOIN devs d ON m.filter = d.filter AND m.metric = d.metric WHERE m.n >= 10)"""

GATES = VALID + """,
gates AS (SELECT filter, metric, n, med, sd, bound,
  CASE WHEN sd <= 0 OR sd < 1e-2 * abs(med) THEN 'spread too small' WHEN metric IN ('psf_snr', 'stars') AND bound <= 0 THEN 'limit not above zero' END AS reason FROM stats)"""

# The default settings do not gate on psf_snr.
JUDGED = GATES + """,
wide AS (SELECT filter, max(CASE WHEN metric = 'fwhm' THEN bound END) AS b_fwhm, max(CASE WHEN metric = 'eccentricity' THEN bound END) AS b_ecc,
  max(CASE WHEN metric = 'stars' THEN bound END) AS b_stars, max(CASE WHEN metric = 'fwhm' THEN med END) AS m_fwhm,
  max(CASE WHEN metric = 'eccentricity' THEN med END) AS m_ecc, max(CASE WHEN metric = 'stars' THEN med END) AS m_stars FROM gates WHERE reason IS NULL GROUP BY filter),
marks AS (SELECT f.*, coalesce(fwhm > 0 AND eccentricity > 0 AND stars > 0 AND psf_snr > 0, FALSE) AS ok, coalesce(fwhm > b_fwhm, FALSE) AS x_fwhm,
  coalesce(eccentricity > b_ecc, FALSE) AS x_ecc, coalesce(stars < b_stars, FALSE) AS x_stars, b_fwhm, b_ecc, b_stars, m_fwhm, m_ecc, m_stars
  FROM frames f LEFT JOIN wide w ON f.filter = w.filter),
judged AS (SELECT *, CASE WHEN NOT ok THEN 'unmeasurable' WHEN x_fwhm OR x_ecc OR x_stars THEN 'rejected' ELSE 'approved' END AS state FROM marks)"""

OVERRIDE = "CASE WHEN frame_id % 11 = 0 THEN 'rescued' WHEN frame_id % 13 = 0 THEN 'condemned' END"
FINAL = """CASE WHEN override = 'condemned' THEN 'rejected' WHEN state = 'unmeasurable' THEN state WHEN override = 'rescued' THEN 'approved' ELSE state END"""


def frames(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "frames")


def judged(spark: SparkSession, sf: str) -> DataFrame:
    return op.verdicts(frames(spark, sf)).withColumn("override", F.expr(OVERRIDE))


def sql(text: str) -> str:
    return with_views("frames", text)


# --- sources ---------------------------------------------------------------------

@query("measurement_source", sql("""SELECT frame_id, path, round(fwhm, 6) AS fwhm, round(eccentricity, 6) AS eccentricity, CAST(stars AS DOUBLE) AS stars,
  round(psf_snr, 6) AS psf_snr, round(background, 6) AS background, CAST(altitude AS DOUBLE) AS altitude, CAST(psf_flux AS DOUBLE) AS psf_flux FROM frames"""))
def measurement_source(spark, sf):
    f = frames(spark, sf)
    place = {v: k for k, v in op.POSITIONS.items()}
    cells = [F.col(place[i]).cast("string") if i in place and place[i] in f.columns else F.lit(None).cast("string")
             for i in range(max(place) + 1)]
    rows = f.select("frame_id", F.array(*cells).alias("row"))
    m = op.measurements_from_rows(rows)
    return m.select("frame_id", "path", *[F.round(c, 6).alias(c) for c in ("fwhm", "eccentricity")], "stars",
                    *[F.round(c, 6).alias(c) for c in ("psf_snr", "background")], "altitude", "psf_flux")


MIXED = """mixed AS (SELECT frame_id, path, concat(filter, CAST(frame_id % 7 AS VARCHAR(5))) AS filter, fwhm,
  CASE WHEN frame_id % 7 = 3 THEN eccentricity + 1e0 ELSE eccentricity END AS eccentricity, CAST(stars AS DOUBLE) AS stars,
  CASE WHEN frame_id % 7 = 5 THEN floor(psf_snr) ELSE psf_snr END AS psf_snr, CASE WHEN frame_id % 7 = 2 THEN -1e0 ELSE background END AS background,
  CAST(altitude AS DOUBLE) AS altitude FROM frames)"""


def mixed(spark, sf):
    frames(spark, sf).createOrReplaceTempView("frames")
    return spark.sql("WITH " + MIXED + " SELECT * FROM mixed")


@query("schema_meaning_check", sql(MIXED + """,
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY filter ORDER BY frame_id) AS rn FROM mixed) WHERE rn = 1)
SELECT filter, concat_ws(';', CASE WHEN path IS NULL OR path = '' THEN 'no path given' END,
  CASE WHEN NOT coalesce(eccentricity > 0 AND eccentricity < 1, FALSE) THEN 'eccentricity must lie between 0 and 1' END,
  CASE WHEN NOT coalesce(fwhm BETWEEN 1 AND 60, FALSE) THEN 'implausible FWHM' END,
  CASE WHEN NOT coalesce(stars >= 0 AND floor(stars) = stars, FALSE) THEN 'stars must be counted in whole numbers' END,
  CASE WHEN coalesce(floor(psf_snr) = psf_snr, TRUE) THEN 'PSF SNR looks like a count of stars' END) AS problems,
  concat_ws(';', CASE WHEN NOT coalesce(background >= 0, FALSE) THEN 'background' END, CASE WHEN NOT coalesce(altitude >= 0, FALSE) THEN 'altitude' END) AS optional_problems FROM first"""))
def schema_meaning_check(spark, sf):
    p = op.meaning_problems(mixed(spark, sf))
    return p.select("filter", F.array_join("problems", ";").alias("problems"),
                    F.array_join("optional_problems", ";").alias("optional_problems"))


# --- predicates ------------------------------------------------------------------

SPOILED = """spoiled AS (SELECT frame_id, CASE WHEN frame_id % 5 = 0 THEN CAST('NaN' AS DOUBLE) WHEN frame_id % 7 = 0 THEN -1e0 ELSE background END AS background,
  CASE WHEN frame_id % 6 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE CAST(altitude AS DOUBLE) END AS altitude, CAST(psf_flux AS DOUBLE) AS psf_flux FROM frames)"""


@query("sanitize_optional", sql(SPOILED + """ SELECT frame_id, CASE WHEN background >= 0 AND NOT isnan(background) THEN round(background, 6) END AS background,
  CASE WHEN NOT isinf(altitude) THEN altitude END AS altitude, CAST(NULL AS DOUBLE) AS psf_flux FROM spoiled"""))
def sanitize_optional(spark, sf):
    frames(spark, sf).createOrReplaceTempView("frames")
    df = op.sanitize_optional(spark.sql("WITH " + SPOILED + " SELECT * FROM spoiled"), disabled=("psf_flux",))
    return df.withColumn("background", F.round("background", 6))


@query("frame_valid", sql("""SELECT filter, count(*) AS frames, count(*) FILTER (WHERE fwhm > 0 AND eccentricity > 0 AND stars > 0 AND psf_snr > 0) AS valid
  FROM frames GROUP BY filter"""))
def frame_valid(spark, sf):
    return frames(spark, sf).groupBy("filter").agg(F.count("*").alias("frames"), F.count_if(op.frame_valid()).alias("valid"))


@query("plausible_range", sql("""SELECT frame_id, coalesce(fwhm BETWEEN 1 AND 60, FALSE) AS fwhm_ok, eccentricity BETWEEN 1e-2 AND 95e-2 AS eccentricity_ok,
  psf_snr BETWEEN 1 AND 1e9 AS psf_snr_ok, stars BETWEEN 200 AND 500000 AS stars_ok FROM frames"""))
def plausible_range(spark, sf):
    return frames(spark, sf).select("frame_id", *[op.in_plausible_range(m, F.col(m)).alias(f"{m}_ok")
                                                  for m in ("fwhm", "eccentricity", "psf_snr", "stars")])


NAMED = """named AS (SELECT frame_id, concat(CASE frame_id % 9 WHEN 0 THEN 'masterLight_' WHEN 1 THEN 'Flat_' WHEN 2 THEN 'DarkFlat-' WHEN 3 THEN 'Bias ' WHEN 4 THEN 'integration_'
  WHEN 5 THEN 'Darkness_' WHEN 6 THEN 'masterDark_' WHEN 7 THEN 'Dark_' ELSE 'Light_' END, path) AS name,
  CASE frame_id % 8 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '''Light Frame ''' WHEN 3 THEN 'Flat Field' WHEN 4 THEN 'Master Dark' WHEN 5 THEN 'Offset' WHEN 6 THEN 'DARK' ELSE NULL END AS image_type FROM frames),
cleaned AS (SELECT *, trim(replace(coalesce(image_type, ''), '''', '')) AS t, lower(name) AS n FROM named)"""


def named(spark, sf):
    frames(spark, sf).createOrReplaceTempView("frames")
    return spark.sql("WITH " + NAMED + " SELECT * FROM named")


@query("classify_not_subframe", sql(NAMED + """,
subject AS (SELECT *, CASE WHEN t <> '' THEN lower(t) WHEN regexp_matches(n, '^(flat|dark|bias|darkflat|flatdark|offset)[_ -]') THEN regexp_extract(n, '^([a-z]+)', 1) ELSE '' END AS s FROM cleaned)
SELECT frame_id, CASE WHEN n LIKE 'master%' OR n LIKE 'integration%' OR lower(t) LIKE '%master%' THEN 'master' WHEN s LIKE '%flat%' THEN 'flat' WHEN s LIKE '%dark%' THEN 'dark'
  WHEN s LIKE '%bias%' OR s LIKE '%offset%' OR s LIKE '%zero%' THEN 'bias' END AS kind FROM subject"""))
def classify_not_subframe(spark, sf):
    return named(spark, sf).select("frame_id", op.not_subframe(F.col("name"), F.col("image_type")).alias("kind"))


@query("classify_dark", sql(NAMED + """,
subject AS (SELECT *, CASE WHEN t <> '' THEN lower(t) ELSE n END AS s FROM cleaned)
SELECT frame_id, CASE WHEN NOT contains(s, 'dark') OR contains(s, 'flat') OR contains(s, 'light') OR contains(s, 'bias') OR contains(s, 'offset') OR (t <> '' AND contains(s, 'zero')) THEN NULL
  WHEN starts_with(n, 'master') OR (t <> '' AND contains(s, 'master')) THEN 'master' ELSE 'raw' END AS kind FROM subject"""))
def classify_dark(spark, sf):
    return named(spark, sf).select("frame_id", op.dark_kind(F.col("name"), F.col("image_type")).alias("kind"))


@query("is_master_light", sql(NAMED + """ SELECT frame_id, CASE WHEN t <> '' THEN contains(lower(t), 'light') ELSE starts_with(n, 'masterlight') END AS master_light FROM cleaned"""))
def is_master_light(spark, sf):
    return named(spark, sf).select("frame_id", op.is_master_light(F.col("name"), F.col("image_type")).alias("master_light"))


@query("final_state", sql(JUDGED + f""" SELECT frame_id, {FINAL} AS final FROM (SELECT *, {OVERRIDE} AS override FROM judged)"""))
def final_state(spark, sf):
    return judged(spark, sf).select("frame_id", op.final_state(F.col("state"), F.col("override")).alias("final"))


@query("left_out", sql(JUDGED + f""",
marked AS (SELECT *, {FINAL} AS final, filter <> '2' AS enabled, exposure = 60 AS copying FROM (SELECT *, {OVERRIDE} AS override FROM judged))
SELECT filter, count(*) FILTER (WHERE NOT CASE WHEN copying THEN NOT enabled OR final = 'rejected' ELSE enabled AND final = 'rejected' END) AS keep, count(*) AS total FROM marked GROUP BY filter"""))
def left_out(spark, sf):
    return op.keep_counts(judged(spark, sf).withColumn("enabled", F.col("filter") != "2")
                          .withColumn("copying", F.col("exposure") == 60))


# --- aggregates --------------------------------------------------------------------

@query("median", sql(VALID + " SELECT filter, metric, n, round(med, 6) AS median FROM mids"))
def median(spark, sf):
    m = op.medians(op.unpivoted(frames(spark, sf)), ["filter", "metric"], "value")
    return m.withColumn("median", F.round("median", 6))


@query("upper_median", sql(VALID + """, sorted AS (SELECT filter, metric, value, row_number() OVER (PARTITION BY filter, metric ORDER BY value) AS rn,
  count(*) OVER (PARTITION BY filter, metric) AS n FROM long) SELECT filter, metric, n, round(value, 6) AS median FROM sorted WHERE rn = n // 2 + 1"""))
def upper_median(spark, sf):
    from skytable.functions.ordered import upper_medians
    m = upper_medians(op.unpivoted(frames(spark, sf)), ["filter", "metric"], "value")
    return m.withColumn("median", F.round("median", 6))


@query("robust_sigma", sql(VALID + """, s1 AS (SELECT filter, metric, value, row_number() OVER (PARTITION BY filter, metric ORDER BY value) AS rn,
  count(*) OVER (PARTITION BY filter, metric) AS n FROM long), c AS (SELECT filter, metric, n, value AS med FROM s1 WHERE rn = n // 2 + 1),
s2 AS (SELECT l.filter, l.metric, abs(l.value - c.med) AS d, row_number() OVER (PARTITION BY l.filter, l.metric ORDER BY abs(l.value - c.med)) AS rn, c.n
  FROM long l JOIN c ON l.filter = c.filter AND l.metric = c.metric), u AS (SELECT filter, metric, CASE WHEN d = 0 THEN 1e0 ELSE 14826e-4 * d END AS sd FROM s2 WHERE rn = n // 2 + 1)
SELECT devs.filter, devs.metric, round(devs.sd, 6) AS frame_sigma, round(u.sd, 6) AS catalogue_sigma FROM devs JOIN u ON devs.filter = u.filter AND devs.metric = u.metric"""))
def robust_sigma(spark, sf):
    long = op.unpivoted(frames(spark, sf))
    a = op.robust_spread(long, ["filter", "metric"], "value").select("filter", "metric", F.round("sigma", 6).alias("frame_sigma"))
    b = op.robust_spread(long, ["filter", "metric"], "value", upper=True).select(
        "filter", "metric", F.round("sigma", 6).alias("catalogue_sigma"))
    return a.join(b, ["filter", "metric"])


@query("relative_gates", sql(GATES + """ SELECT filter, metric, n, round(med, 9) AS median, round(sd, 9) AS sigma, CASE WHEN reason IS NULL THEN round(bound, 9) END AS "limit",
  reason IS NULL AS active, reason FROM gates"""))
def relative_gates(spark, sf):
    g = op.relative_gates(frames(spark, sf))
    return g.withColumns({c: F.round(c, 9) for c in ("median", "sigma", "limit")})


@query("channel_medians", sql(VALID + """ SELECT filter, round(median(psf_snr), 6) AS psf_snr, round(median(fwhm), 6) AS fwhm, round(median(eccentricity), 6) AS eccentricity,
  round(median(CAST(stars AS DOUBLE)), 6) AS stars FROM valid GROUP BY filter"""))
def channel_medians(spark, sf):
    m = op.channel_medians(frames(spark, sf))
    return m.withColumns({c: F.round(c, 6) for c in op.METRICS})


ENTRIES = """entries AS (SELECT frame_id, concat(filter, CAST(frame_id % 3 AS VARCHAR(3))) AS filter, exposure, CASE WHEN frame_id % 3 = 1 THEN 1 END AS binning,
  CASE WHEN frame_id % 2 = 0 THEN 'Light Frame' ELSE '''LIGHT ''' END AS image_type, CASE WHEN frame_id % 3 = 2 AND frame_id % 5 = 0 THEN 'yes' ELSE 'unknown' END AS calibrated FROM frames)"""


@query("comparability", sql(ENTRIES + """ SELECT filter, concat_ws(';', CASE WHEN count(DISTINCT coalesce(CAST(exposure AS VARCHAR), 'null')) > 1 THEN 'several exposure times' END,
  CASE WHEN count(DISTINCT coalesce(CAST(binning AS VARCHAR), 'null')) > 1 THEN 'several binnings' END,
  CASE WHEN count(DISTINCT regexp_replace(lower(trim(replace(image_type, '''', ' '))), ' (frame|field)$', '')) > 1 THEN 'several image types' END,
  CASE WHEN count(DISTINCT calibrated) > 1 THEN 'several calibration states' END) AS problems FROM entries GROUP BY filter"""))
def comparability(spark, sf):
    frames(spark, sf).createOrReplaceTempView("frames")
    c = op.comparability(spark.sql("WITH " + ENTRIES + " SELECT * FROM entries"))
    return c.select("filter", F.array_join("problems", ";").alias("problems"))


RAGGED = """ragged AS (SELECT frame_id, CASE WHEN frame_id % 8 = 0 THEN NULL WHEN frame_id % 8 = 1 THEN '  ' ELSE concat(' ', filter, ' ') END AS filter FROM frames)"""


@query("group_by_filter", sql(RAGGED + """ SELECT coalesce(nullif(trim(filter), ''), '(no filter)') AS filter, count(*) AS frames,
  coalesce(nullif(trim(filter), ''), '(no filter)') <> '(no filter)' AS may_reject FROM ragged GROUP BY ALL"""))
def group_by_filter(spark, sf):
    frames(spark, sf).createOrReplaceTempView("frames")
    rows = spark.sql("WITH " + RAGGED + " SELECT * FROM ragged")
    return (rows.groupBy(op.filter_key(F.col("filter")).alias("filter")).agg(F.count("*").alias("frames"))
            .withColumn("may_reject", F.col("filter") != op.NO_FILTER))


@query("state_counts", sql(JUDGED + f""",
marked AS (SELECT *, {FINAL} AS final FROM (SELECT *, {OVERRIDE} AS override FROM judged))
SELECT filter, count(*) AS total, count(*) FILTER (WHERE final = 'approved') AS kept, count(*) FILTER (WHERE final = 'rejected') AS rejected,
  count(*) FILTER (WHERE final = 'unmeasurable') AS unmeasurable, count(*) FILTER (WHERE override = 'rescued') AS rescued, count(*) FILTER (WHERE override = 'condemned') AS condemned
  FROM marked GROUP BY filter"""))
def state_counts(spark, sf):
    return op.state_counts(judged(spark, sf))


CORRECTED = """air AS (SELECT *, CASE WHEN altitude > 1 AND altitude <= 90 THEN 1e0 / sin(radians(CAST(altitude AS DOUBLE))) END AS am FROM frames),
corr AS (SELECT *, fwhm / pow(coalesce(am, 1e0), 6e-1) AS fc, psf_flux * pow(1e1, 4e-1 * 15e-2 * (coalesce(am, 1e0) - 1e0)) AS xc FROM air),
refs AS (SELECT filter, CASE WHEN count(fwhm) >= 5 THEN list_sort(list(fwhm) FILTER (WHERE fwhm > 0))[count(fwhm) // 4 + 1] END AS r_fwhm,
  CASE WHEN count(fc) >= 5 THEN list_sort(list(fc) FILTER (WHERE fc > 0))[count(fc) // 4 + 1] END AS r_fc,
  CASE WHEN count(xc) >= 5 THEN median(xc) END AS r_flux, CASE WHEN count(background) >= 5 THEN median(background) END AS r_bg,
  CASE WHEN count(stars) >= 5 THEN median(CAST(stars AS DOUBLE)) END AS r_stars, CASE WHEN count(eccentricity) >= 5 THEN median(eccentricity) END AS r_ecc FROM corr GROUP BY filter),
eccs AS (SELECT c.filter, 14826e-4 * median(abs(c.eccentricity - r.r_ecc)) AS r_sd FROM corr c JOIN refs r ON c.filter = r.filter GROUP BY c.filter)"""

FLAGS = CORRECTED + """,
marks AS (SELECT c.*, r.r_stars, r.r_flux, r.r_bg, r.r_ecc, e.r_sd, coalesce(c.fwhm > 12e-1 * r.r_fwhm, FALSE) AS wide, coalesce(c.fc > 12e-1 * r.r_fc, FALSE) AS cwide
  FROM corr c JOIN refs r ON c.filter = r.filter JOIN eccs e ON c.filter = e.filter),
near AS (SELECT *, lag(wide) OVER w AS pw, lead(wide) OVER w AS nw, lag(cwide) OVER w AS pc, lead(cwide) OVER w AS nc FROM marks WINDOW w AS (PARTITION BY filter ORDER BY obs_time, path)),
caused AS (SELECT *, CASE WHEN NOT wide THEN NULL WHEN am IS NOT NULL AND NOT cwide THEN CASE WHEN coalesce(pw, FALSE) OR coalesce(nw, FALSE) THEN 'altitude' ELSE 'seeing' END
  WHEN (pc IS NOT NULL OR nc IS NOT NULL) AND NOT coalesce(pc, FALSE) AND NOT coalesce(nc, FALSE) THEN 'seeing' ELSE 'focus' END AS cause FROM near),
flagged AS (SELECT *, r_sd > 0 AND r_sd >= 1e-2 * r_ecc AND eccentricity > r_ecc + 3 * r_sd AS tracking,
  coalesce(xc < 75e-2 * r_flux, FALSE) OR coalesce(background > r_bg * 105e-2, FALSE) AS cloud, stars < 1e-1 * r_stars AS dropped FROM caused)"""


@query("flag_references", sql(CORRECTED + """ SELECT r.filter, round(r_fwhm, 6) AS ref_fwhm, round(r_fc, 6) AS ref_fwhm_corr, round(r_flux, 6) AS ref_flux, round(r_bg, 6) AS ref_background,
  round(r_stars, 6) AS ref_stars, round(r_ecc, 6) AS ref_eccentricity, round(r_sd, 6) AS ref_eccentricity_sigma FROM refs r JOIN eccs e ON r.filter = e.filter"""))
def flag_references(spark, sf):
    r = op.flag_references(frames(spark, sf))
    return r.select("filter", *[F.round(c, 6).alias(c) for c in r.columns if c != "filter"])


@query("common_prefix", sql("""ends AS (SELECT filter, min(path) AS a, max(path) AS b, count(*) AS n FROM frames GROUP BY filter),
cut AS (SELECT filter, CASE WHEN n < 2 THEN '' ELSE coalesce((SELECT max(substr(a, 1, i)) FROM range(1, 40) t(i) WHERE i <= least(length(a), length(b)) AND substr(a, 1, i) = substr(b, 1, i)
  AND substr(a, i, 1) IN ('_', '-', '.')), '') END AS p FROM ends)
SELECT f.frame_id, substr(f.path, length(c.p) + 1) AS short_name FROM frames f JOIN cut c ON f.filter = c.filter"""))
def common_prefix(spark, sf):
    return op.short_names(frames(spark, sf)).select("frame_id", "short_name")


@query("flag_summary", sql(FLAGS + """ SELECT filter, count(*) FILTER (WHERE cause IS NOT NULL OR tracking OR cloud OR dropped) AS flagged, count(*) FILTER (WHERE cause = 'focus') AS focus,
  count(*) FILTER (WHERE cause = 'seeing') AS seeing, count(*) FILTER (WHERE cause = 'altitude') AS altitude, count(*) FILTER (WHERE tracking) AS tracking,
  count(*) FILTER (WHERE cloud) AS cloud, count(*) FILTER (WHERE dropped) AS dropped FROM flagged GROUP BY filter"""))
def flag_summary(spark, sf):
    return op.flag_summary(op.anomaly_flags(frames(spark, sf)))


@query("frames_by_directory", with_views("files", """SELECT concat('/data/', folder, '/', channel) AS folder, count(*) AS frames, count(*) FILTER (WHERE file_id % 3 <> 0) AS to_convert
  FROM files GROUP BY 1"""))
def frames_by_directory(spark, sf):
    f = view(spark, sf, "files")
    ending = F.when(F.col("file_id") % 3 == 0, ".XISF").otherwise(".fits")
    path = F.concat(F.lit("/data/"), F.col("folder"), F.lit("/"), F.col("channel"), F.lit("/f"), F.col("file_id"), ending)
    return op.frames_by_directory(f.select(path.alias("path")))


@query("anomaly_flags", sql(FLAGS + """ SELECT frame_id, concat_ws(',', cause, CASE WHEN tracking THEN 'tracking' END, CASE WHEN cloud THEN 'cloud' END, CASE WHEN dropped THEN 'dropped' END) AS flags FROM flagged"""))
def anomaly_flags(spark, sf):
    f = op.anomaly_flags(frames(spark, sf))
    return f.select("frame_id", F.array_join("flags", ",").alias("flags"))


@query("reference_frame_stretch", sql("""ranked AS (SELECT *, row_number() OVER (PARTITION BY filter ORDER BY background, frame_id) AS rn, count(*) OVER (PARTITION BY filter) AS n FROM frames),
mid AS (SELECT filter, background FROM ranked WHERE rn = (n - 1) // 2 + 1)
SELECT f.filter, min(f.frame_id) AS frame_id, round(f.background, 6) AS background FROM frames f JOIN mid m ON f.filter = m.filter AND f.background = m.background GROUP BY f.filter, f.background"""))
def reference_frame_stretch(spark, sf):
    return op.reference_frames(frames(spark, sf)).select("filter", "frame_id", F.round("background", 6).alias("background"))


# the pixels of a frame are those of the embedding with its number, modulo 500
@query("shared_stretch", with_views("frames pixels", """ranked AS (SELECT *, row_number() OVER (PARTITION BY filter ORDER BY background, frame_id) AS rn, count(*) OVER (PARTITION BY filter) AS n FROM frames),
mid AS (SELECT filter, background FROM ranked WHERE rn = (n - 1) // 2 + 1),
ref AS (SELECT f.filter, min(f.frame_id) AS frame_id FROM frames f JOIN mid m ON f.filter = m.filter AND f.background = m.background GROUP BY f.filter),
px AS (SELECT r.filter, r.frame_id, 4e-1 + v / 2e0 AS v FROM ref r JOIN pixels p ON p.image_id = r.frame_id % 500), m AS (SELECT filter, frame_id, median(v) AS med FROM px GROUP BY ALL),
s AS (SELECT m.filter, m.frame_id, med, greatest(0e0, med - 28e-1 * 14826e-4 * median(abs(v - med))) AS shadows FROM px JOIN m ON px.filter = m.filter GROUP BY m.filter, m.frame_id, med)
SELECT filter, frame_id, round(shadows, 6) AS shadows, round((25e-2 - 1) * greatest(1e-8, med - shadows) / ((2 * 25e-2 - 1) * greatest(1e-8, med - shadows) - 25e-2), 6) AS midtone FROM s"""))
def shared_stretch(spark, sf):
    f = frames(spark, sf)
    chosen = checkpointed(op.reference_frames(f))
    px = view(spark, sf, "pixels").withColumnRenamed("image_id", "__i").join(chosen.select(F.col("frame_id").alias("image_id"), (F.col("frame_id") % 500).alias("__i")), "__i")
    s = op.shared_stretch(f, px.select("image_id", (0.4 + F.col("v") / 2.0).alias("v")), chosen=chosen)
    return s.withColumns({c: F.round(c, 6) for c in ("shadows", "midtone")})


@query("score_rank", sql(VALID + """, m AS (SELECT filter, median(psf_snr) AS a, median(fwhm) AS b, median(eccentricity) AS c, median(CAST(stars AS DOUBLE)) AS d FROM valid GROUP BY filter)
SELECT f.frame_id, CASE WHEN fwhm > 0 AND eccentricity > 0 AND stars > 0 AND psf_snr > 0 THEN round(5e-1 * greatest(25e-2, least(4e0, psf_snr / a)) + 3e-1 * greatest(25e-2, least(4e0, b / fwhm))
  + 1e-1 * greatest(25e-2, least(4e0, c / eccentricity)) + 1e-1 * greatest(25e-2, least(4e0, stars / d)), 6) END AS score FROM frames f LEFT JOIN m ON f.filter = m.filter"""))
def score_rank(spark, sf):
    s = op.scores(frames(spark, sf)).select("frame_id", F.round("score", 6).alias("score"))
    return s.orderBy(F.col("score").desc_nulls_last(), "frame_id")


@query("unknown_or_repeated_rows", sql("""got AS (SELECT filter, CASE WHEN frame_id % 50 = 0 THEN concat('x', path) ELSE path END AS path FROM frames UNION ALL SELECT filter, path FROM frames WHERE frame_id % 40 = 0),
many AS (SELECT filter, path, count(*) AS n FROM got GROUP BY filter, path)
SELECT m.filter, m.path, CASE WHEN f.path IS NULL THEN 'not asked for' ELSE 'more than once' END AS problem FROM many m LEFT JOIN frames f ON f.filter = m.filter AND f.path = m.path
  WHERE f.path IS NULL OR m.n > 1"""))
def unknown_or_repeated_rows(spark, sf):
    f = frames(spark, sf)
    wrong = F.when(F.col("frame_id") % 50 == 0, F.concat(F.lit("x"), F.col("path"))).otherwise(F.col("path"))
    got = f.select("filter", wrong.alias("path")).unionByName(f.filter("frame_id % 40 = 0").select("filter", "path"))
    return op.batch_problems(f, got)


@query("airmass", sql("SELECT frame_id, CASE WHEN altitude > 1 AND altitude <= 90 THEN round(1e0 / sin(radians(CAST(altitude AS DOUBLE))), 6) END AS airmass FROM frames"))
def airmass(spark, sf):
    return frames(spark, sf).select("frame_id", F.round(op.airmass(F.col("altitude")), 6).alias("airmass"))


@query("airmass_corrections", sql(CORRECTED + " SELECT frame_id, round(fc, 6) AS fwhm_corr, round(xc, 6) AS flux_corr FROM corr"))
def airmass_corrections(spark, sf):
    return op.with_corrections(frames(spark, sf)).select(
        "frame_id", F.round("fwhm_corr", 6).alias("fwhm_corr"), F.round("flux_corr", 6).alias("flux_corr"))


@query("verdict_reasons", sql(JUDGED + """ SELECT frame_id, state, CASE WHEN NOT ok THEN '' ELSE concat_ws(',', CASE WHEN x_fwhm THEN 'fwhm' END, CASE WHEN x_ecc THEN 'eccentricity' END,
  CASE WHEN x_stars THEN 'stars' END) END AS failing, CASE WHEN NOT ok THEN 'unmeasured' ELSE concat_ws('; ',
  CASE WHEN x_fwhm THEN printf('FWHM %.2f, median %.2f, limit %.2f', fwhm, m_fwhm, b_fwhm) END, CASE WHEN x_ecc THEN printf('eccentricity %.3f, median %.3f, limit %.3f', eccentricity, m_ecc, b_ecc) END,
  CASE WHEN x_stars THEN concat('stars ', CASE WHEN stars >= 100 THEN CAST(stars AS VARCHAR) ELSE printf('%.2f', CAST(stars AS DOUBLE)) END, concat(', median ', CAST(CAST(floor(m_stars + 5e-1) AS BIGINT) AS VARCHAR), ', limit ', CAST(CAST(floor(b_stars + 5e-1) AS BIGINT) AS VARCHAR))) END) END AS reasons FROM judged"""))
def verdict_reasons(spark, sf):
    v = op.verdicts(frames(spark, sf))
    return v.select("frame_id", "state", F.array_join("failing", ",").alias("failing"), F.array_join("reasons", "; ").alias("reasons"))


TYPED = """typed AS (SELECT DISTINCT filter, 'fwhm' AS metric, concat('3.', filter) AS text FROM frames UNION ALL SELECT DISTINCT filter, 'stars', '' FROM frames
  UNION ALL SELECT DISTINCT filter, 'psf_snr', CASE WHEN filter = '1' THEN '1,5' ELSE '1e2' END FROM frames)"""


def typed_settings(spark, sf):
    f = frames(spark, sf)
    f.createOrReplaceTempView("frames")
    s = op.default_settings(f).withColumn("k_edited", F.col("filter") == "3")
    return f, op.with_limits(op.apply_preset(s, "strict"), spark.sql("WITH " + TYPED + " SELECT * FROM typed"))


@query("settings_merge", sql(VALID + """,
strict AS (SELECT filter, metric, CASE WHEN metric IN ('fwhm', 'eccentricity') THEN med + (CASE WHEN filter = '3' THEN 25e-1 ELSE 2e0 END) * sd ELSE med - (CASE WHEN filter = '3' THEN 25e-1 ELSE 2e0 END) * sd END AS bound,
  sd > 0 AND sd >= 1e-2 * abs(med) AND metric <> 'psf_snr' AS spread FROM stats)
SELECT filter, metric, round(CASE WHEN metric = 'fwhm' THEN CAST(concat('3.', filter) AS DOUBLE) WHEN metric = 'psf_snr' AND filter <> '1' THEN 1e2
  WHEN spread AND (metric IN ('fwhm', 'eccentricity') OR bound > 0) THEN bound END, 6) AS value, NOT (metric = 'fwhm' OR (metric = 'psf_snr' AND filter <> '1')) AS automatic FROM strict"""))
def settings_merge(spark, sf):
    f, s = typed_settings(spark, sf)
    return op.display_limits(s, op.relative_gates(f, s)).withColumn("value", F.round("value", 6))


@query("custom_weights_and_limits", sql(VALID + """,
m AS (SELECT filter, median(fwhm) AS mf, median(eccentricity) AS me FROM valid GROUP BY filter),
b AS (SELECT filter, max(CASE WHEN metric = 'eccentricity' THEN med + (CASE WHEN filter = '3' THEN 25e-1 ELSE 2e0 END) * sd END) AS be,
  max(CASE WHEN metric = 'stars' THEN med - (CASE WHEN filter = '3' THEN 25e-1 ELSE 2e0 END) * sd END) AS bs FROM stats GROUP BY filter)
SELECT f.frame_id, CASE WHEN NOT coalesce(fwhm > 0 AND eccentricity > 0 AND stars > 0 AND psf_snr > 0, FALSE) THEN 'unmeasurable'
  WHEN fwhm > CAST(concat('3.', f.filter) AS DOUBLE) OR eccentricity > be OR stars < bs THEN 'rejected' ELSE 'approved' END AS state,
  CASE WHEN fwhm > 0 AND eccentricity > 0 AND stars > 0 AND psf_snr > 0 THEN round(61e-2 * greatest(25e-2, least(4e0, mf / fwhm)) + 39e-2 * greatest(25e-2, least(4e0, me / eccentricity)), 9) END AS score
  FROM frames f JOIN m ON f.filter = m.filter JOIN b ON f.filter = b.filter"""))
def custom_weights_and_limits(spark, sf):
    f, s = typed_settings(spark, sf)
    s = s.withColumn("weights", F.create_map(F.lit("fwhm"), F.lit(0.61), F.lit("eccentricity"), F.lit(0.39)))
    out = op.scores(op.verdicts(f, s), s)
    return out.select("frame_id", "state", F.round("score", 9).alias("score"))

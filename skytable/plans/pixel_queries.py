"""Queries over the ``pixels`` view: every embedding as a plane of 8 by 8."""

from __future__ import annotations

from pyspark.sql import functions as F

from skytable.functions.storage import written
from skytable.operators import pixels as op
from skytable.plans.registry import query
from skytable.plans.views import view, with_views

PX = "px AS (SELECT image_id, y, x, 4e-1 + v / 2e0 AS v FROM pixels)"
RUNS = PX + """,
ch AS (SELECT image_id, image_id // 3 AS run, CASE image_id % 3 WHEN 0 THEN 'H' WHEN 1 THEN 'S' ELSE 'O' END AS channel, y, x, v FROM px),
wide AS (SELECT a.run, a.y, a.x, a.v AS "H", b.v AS "S", c.v AS "O" FROM ch a JOIN ch b ON a.run = b.run AND a.y = b.y AND a.x = b.x JOIN ch c ON a.run = c.run AND a.y = c.y AND a.x = c.x
  WHERE a.channel = 'H' AND b.channel = 'S' AND c.channel = 'O')"""
MED = "meds AS (SELECT image_id, median(v) AS med, min(v) AS low, max(v) AS high, avg(v) AS mean FROM px GROUP BY image_id)"


def sql(text: str) -> str:
    return with_views("pixels", text)


def pixels(spark, sf):
    p = view(spark, sf, "pixels")
    return p.withColumn("v", F.lit(0.4) + F.col("v") / 2.0)


def channels(spark, sf):
    i = F.col("image_id")
    name = F.when(i % 3 == 0, "H").when(i % 3 == 1, "S").otherwise("O")
    return pixels(spark, sf).withColumns({"run": F.floor(i / 3).cast("long"), "channel": name, "channel_order": (i % 3).cast("int")})


def wide(spark, sf):
    return op.combine(channels(spark, sf), ["H", "S", "O"])


def rounded(df, *names, places=6):
    return df.withColumns({n: F.round(n, places) for n in names})


@query("looks_linear", sql(PX + ", " + MED + " SELECT image_id, med < 39e-2 AND med / 2e1 < 2e-2 AS linear FROM meds"))
def looks_linear(spark, sf):
    s = op.plane_statistics(pixels(spark, sf))
    s = s.withColumn("median", F.when(F.col("median") < 0.39, F.col("median") / 20.0).otherwise(F.col("median")))
    return op.looks_linear(s).select("image_id", "linear")


@query("plane_constant_check", sql("flat AS (SELECT image_id, y, x, CASE WHEN image_id % 10 = 0 THEN image_id / 1e1 ELSE v END AS v FROM pixels) SELECT image_id, min(v) AS value FROM flat GROUP BY image_id HAVING min(v) = max(v)"))
def plane_constant_check(spark, sf):
    p = view(spark, sf, "pixels")
    return op.constant_planes(p.withColumn("v", F.when(F.col("image_id") % 10 == 0, F.col("image_id") / 10.0).otherwise(F.col("v"))))


@query("plane_statistics", sql(PX + ", " + MED + " SELECT image_id, round(low, 6) AS min, round(high, 6) AS max, round(mean, 6) AS mean, round(med, 6) AS median FROM meds"))
def plane_statistics(spark, sf):
    return rounded(op.plane_statistics(pixels(spark, sf)), "min", "max", "mean", "median")


@query("unchanged_step", sql("touched AS (SELECT DISTINCT image_id FROM pixels WHERE image_id % 3 = 0) SELECT DISTINCT image_id FROM pixels WHERE image_id NOT IN (SELECT image_id FROM touched)"))
def unchanged_step(spark, sf):
    before = pixels(spark, sf)
    after = before.withColumn("v", F.when((F.col("image_id") % 3 == 0) & (F.col("x") < 6), F.col("v") + 0.01).otherwise(F.col("v")))
    return op.unchanged(before, after)


@query("median_of_centre", sql(PX + ", m AS (SELECT image_id, median(v) AS med FROM px WHERE x >= 1 AND x < 7 AND y >= 1 AND y < 7 GROUP BY image_id), r AS (SELECT image_id // 3 AS run, image_id, med, row_number() OVER (PARTITION BY image_id // 3 ORDER BY med, image_id) AS rn FROM m) SELECT run, image_id, round(med, 6) AS median FROM r WHERE rn = 1"))
def median_of_centre(spark, sf):
    px = channels(spark, sf)
    names = px.select("image_id", "run", "channel_order").distinct()
    return rounded(op.reference_channel(op.median_of_centre(px).join(names, "image_id"), "run"), "median")


SKY = PX + ", bm AS (SELECT image_id, y // 2 AS b, x // 2 AS c, avg(v) AS m FROM px GROUP BY ALL), sky AS (SELECT image_id, quantile_cont(m, 2e-2) AS sky FROM bm GROUP BY image_id)"


@query("sky_level", sql(SKY + ", plain AS (SELECT image_id, quantile_cont(v, 2e-2) AS whole FROM px GROUP BY image_id) SELECT s.image_id, round(sky, 6) AS sky, round(whole, 6) AS whole FROM sky s JOIN plain p ON s.image_id = p.image_id"))
def sky_level(spark, sf):
    px = pixels(spark, sf)
    a = op.sky_level(px, block=2).join(op.sky_level(px).withColumnRenamed("sky", "whole"), "image_id")
    return rounded(a, "sky", "whole")


FILLED = "filled AS (SELECT image_id, y, x, CASE WHEN y < image_id % 3 OR x >= 8 - image_id % 2 THEN 0e0 ELSE 4e-1 + v / 2e0 END AS v FROM pixels)"
RECTS = FILLED + """,
rw AS (SELECT image_id, y FROM filled GROUP BY image_id, y HAVING median(v) > 0), cl AS (SELECT image_id, x FROM filled GROUP BY image_id, x HAVING median(v) > 0),
rects AS (SELECT r.image_id, least(min(c.x) + 1, 8) AS x0, least(min(r.y) + 1, 8) AS y0, greatest(max(c.x) + 1 - 1, 0) AS x1, greatest(max(r.y) + 1 - 1, 0) AS y1 FROM rw r JOIN cl c ON r.image_id = c.image_id GROUP BY r.image_id)"""


def filled(spark, sf):
    i = F.col("image_id")
    return pixels(spark, sf).withColumn("v", F.when((F.col("y") < i % 3) | (F.col("x") >= 8 - i % 2), 0.0).otherwise(F.col("v")))


@query("valid_rect", sql(RECTS + " SELECT image_id, x0, y0, x1, y1 FROM rects"))
def valid_rect(spark, sf):
    return op.valid_rect(filled(spark, sf), margin=1)


@query("common_area", sql(RECTS + """, g AS (SELECT image_id // 3 AS run, max(x0) AS x0, max(y0) AS y0, min(x1) AS x1, min(y1) AS y1 FROM rects GROUP BY ALL)
SELECT run, x0, y0, x1, y1, round(1e2 * (x1 - x0) * (y1 - y0) / 64, 6) AS percent, CASE WHEN 1e2 * (x1 - x0) * (y1 - y0) / 64 < 50 THEN 'less than half of the reference in common' END AS problem FROM g"""))
def common_area(spark, sf):
    r = op.valid_rect(filled(spark, sf), margin=1).withColumn("run", F.floor(F.col("image_id") / 3).cast("long"))
    return rounded(op.common_area(r, "run", F.lit(8), F.lit(8)), "percent")


ZEROED = "zeroed AS (SELECT image_id, y, x, CASE WHEN image_id % 2 = 0 THEN greatest(0e0, v) ELSE v END AS v FROM pixels), smp AS (SELECT image_id, v FROM zeroed WHERE (y * 8 + x) % 7 = 0)"


def upper_sql(c: str) -> str:
    return f"list_sort(list({c}))[count(*) // 2 + 1]"


@query("noise_sigma", sql(ZEROED + f""", m AS (SELECT image_id, {upper_sql('v')} AS m, quantile_cont(v, 5e-1) AS p50, quantile_cont(v, 65e-2) AS p65, avg(CASE WHEN v = 0 THEN 1e0 ELSE 0e0 END) AS z FROM smp GROUP BY image_id),
d AS (SELECT s.image_id, 14826e-4 * {upper_sql('abs(s.v - m.m)')} AS sd FROM smp s JOIN m ON s.image_id = m.image_id GROUP BY s.image_id)
SELECT m.image_id, round(greatest(sd, CASE WHEN z >= 3e-1 THEN (p65 - p50) / 3853204664e-10 ELSE 0e0 END, 1e0 / 65535e0), 6) AS noise FROM m JOIN d ON m.image_id = d.image_id"""))
def noise_sigma(spark, sf):
    p = view(spark, sf, "pixels")
    p = p.withColumn("v", F.when(F.col("image_id") % 2 == 0, F.greatest(F.lit(0.0), F.col("v"))).otherwise(F.col("v")))
    return rounded(op.noise_sigma(p), "noise")


# Ten images make one wide plane, so that cuts can leave ten values.
PLATES = "plates AS (SELECT image_id // 10 AS image_id, y, x + 8 * (image_id % 10) AS x, CASE WHEN (image_id * 7 + x * 3 + y) % 11 = 0 THEN v * 8 + 2e0 ELSE v END AS v FROM pixels)"


def plates(spark, sf):
    p, i = view(spark, sf, "pixels"), F.col("image_id")
    return p.select(F.floor(i / 10).cast("long").alias("image_id"), "y", (F.col("x") + 8 * (i % 10)).cast("int").alias("x"),
                    F.when((i * 7 + F.col("x") * 3 + F.col("y")) % 11 == 0, F.col("v") * 8 + 2.0).otherwise(F.col("v")).alias("v"))


def sparse_sql() -> str:
    text = PLATES + ", wd AS (SELECT image_id, max(x) + 1 AS w FROM plates GROUP BY image_id), k0 AS (SELECT p.image_id, v FROM plates p JOIN wd ON p.image_id = wd.image_id WHERE (y * w + x) % 7 = 0)"
    for i in range(5):
        text += f""",
m{i} AS (SELECT image_id, {upper_sql('v')} AS m FROM k{i} GROUP BY image_id),
s{i} AS (SELECT k.image_id, max(m.m) AS m, {upper_sql('abs(k.v - m.m)')} AS d FROM k{i} k JOIN m{i} m ON k.image_id = m.image_id GROUP BY k.image_id),
j{i} AS (SELECT k.image_id, k.v, k.v <= s.m + 3e0 * CASE WHEN s.d = 0 THEN 1e0 / 14826e-4 ELSE s.d END AS ok FROM k{i} k JOIN s{i} s ON k.image_id = s.image_id),
k{i + 1} AS (SELECT image_id, v FROM (SELECT *, count(*) FILTER (WHERE ok) OVER (PARTITION BY image_id) AS kept FROM j{i}) WHERE ok OR kept < 10)"""
    return text + f" SELECT image_id, round({upper_sql('v')}, 6) AS median FROM k5 GROUP BY image_id"


@query("sparse_median", sql(sparse_sql()))
def sparse_median(spark, sf):
    return rounded(op.sparse_median(plates(spark, sf)), "median")


@query("cross_channel_combine", sql(RUNS + """ SELECT run, y, x, round("S", 6) AS r, round("H", 6) AS g, round("O", 6) AS b FROM wide"""))
def cross_channel_combine(spark, sf):
    return rounded(op.palette_planes(wide(spark, sf), "SHO"), "r", "g", "b")


def fit_sql(rounds: int) -> str:
    text = RUNS + """, base AS (SELECT run % 20 AS run, "H" AS a, "H" * 8e-1 + 5e-2 + CASE WHEN (run + x * y) % 17 = 0 THEN 2e-1 ELSE 0e0 END + ("S" - 4e-1) / 5e1 AS b FROM wide),
k0 AS (SELECT * FROM base WHERE a > 0 AND a < 9e-1 AND b > 0 AND b < 9e-1), every AS (SELECT * FROM k0)"""
    for i in range(rounds):
        text += f""",
f{i} AS (SELECT run, regr_slope(b, a) AS s, regr_intercept(b, a) AS t, count(*) AS n FROM k{i} GROUP BY run),
d{i} AS (SELECT k.run, f.s, f.t, f.n, stddev_pop(k.b - (f.s * k.a + f.t)) AS sd FROM k{i} k JOIN f{i} f ON k.run = f.run GROUP BY ALL),
k{i + 1} AS (SELECT e.run, e.a, e.b FROM every e JOIN d{i} d ON e.run = d.run WHERE abs(e.b - (d.s * e.a + d.t)) <= 3e0 * d.sd)"""
    return text + f" SELECT run, round(s, 6) AS slope, round(t, 6) AS intercept, n AS pixels FROM f{rounds - 1}"


def fit_pairs(spark, sf):
    w = wide(spark, sf)
    bump = F.when((F.col("run") + F.col("x") * F.col("y")) % 17 == 0, 0.2).otherwise(0.0)
    return w.select((F.col("run") % 20).alias("run"), F.col("H").alias("a"),
                    (F.col("H") * 0.8 + 0.05 + bump + (F.col("S") - 0.4) / 50.0).alias("b"))


@query("linear_fit", sql(fit_sql(10)))
def linear_fit(spark, sf):
    return rounded(op.linear_fit(fit_pairs(spark, sf), "run", clip=True), "slope", "intercept")


@query("linear_match", sql(RUNS + """ SELECT run, round(regr_slope("O", "S"), 6) AS slope, round(regr_intercept("O", "S"), 6) AS intercept, count(*) AS pixels FROM wide WHERE "S" > 0 AND "S" < 92e-2 AND "O" > 0 AND "O" < 92e-2 GROUP BY run"""))
def linear_match(spark, sf):
    pairs = wide(spark, sf).select("run", F.col("S").alias("a"), F.col("O").alias("b"))
    return rounded(op.linear_fit(pairs, "run", 0.92), "slope", "intercept")


STARS_SQL = """st AS (SELECT c_custkey % 40 AS run, CASE c_custkey % 3 WHEN 0 THEN 'R' WHEN 1 THEN 'G' ELSE 'B' END AS channel, 2e0 + (c_custkey * 7919 % 1000) / 1e3 AS fwhm_x, 2e0 + (c_custkey * 104729 % 1000) / 1e3 AS fwhm_y FROM customer),
sg AS (SELECT run, channel, (list_sort(list(fwhm_x))[count(*) // 2 + 1] + list_sort(list(fwhm_y))[count(*) // 2 + 1]) / 2e0 / 23548200450309493e-16 AS sigma FROM st GROUP BY run, channel)"""


@query("psf_sigma", "WITH " + STARS_SQL + ", w AS (SELECT run, max(sigma) AS m FROM sg GROUP BY run) SELECT sg.run, channel, round(sigma, 6) AS sigma, round(sqrt(greatest(0e0, m * m - sigma * sigma)), 4) AS blur FROM sg JOIN w ON sg.run = w.run")
def psf_sigma(spark, sf):
    from skytable.plans.views import table
    c = F.col("c_custkey")
    s = table(spark, sf, "customer").select(
        F.concat_ws("/", c % 40, F.when(c % 3 == 0, "R").when(c % 3 == 1, "G").otherwise("B")).alias("channel"),
        (2.0 + (c * 7919 % 1000) / 1e3).alias("fwhm_x"), (2.0 + (c * 104729 % 1000) / 1e3).alias("fwhm_y"))
    p = op.psf_sigma(s).select(F.split("channel", "/")[0].cast("long").alias("run"), F.split("channel", "/")[1].alias("channel"), "sigma")
    return op.blur_to_widest(p).select("run", "channel", F.round("sigma", 6).alias("sigma"), F.round("blur", 4).alias("blur"))


@query("registration_reference", """WITH q AS (SELECT c_custkey // 4 AS run, CASE c_custkey % 4 WHEN 0 THEN CASE WHEN c_custkey % 5 = 0 THEN 'L' ELSE 'R' END WHEN 1 THEN 'G' WHEN 2 THEN 'H' ELSE 'O' END AS channel,
  CASE WHEN c_custkey % 3 = 0 OR c_custkey // 4 % 6 = 0 THEN NULL ELSE 2e0 + (c_custkey * 7919 % 1000) / 1e3 END AS fwhm, (c_custkey * 31 % 400) * 1e0 AS stars FROM customer),
r AS (SELECT run, channel, row_number() OVER (PARTITION BY run ORDER BY CASE WHEN channel = 'L' THEN 0 WHEN fwhm > 0 AND stars >= 1 THEN 1 ELSE 2 END, CASE WHEN fwhm > 0 AND stars >= 1 AND channel <> 'L' THEN fwhm / sqrt(stars) ELSE 0e0 END,
  CASE channel WHEN 'G' THEN 0 WHEN 'R' THEN 1 WHEN 'B' THEN 2 WHEN 'H' THEN 3 WHEN 'S' THEN 4 WHEN 'O' THEN 5 ELSE 6 END) AS rn FROM q) SELECT run, channel FROM r WHERE rn = 1""")
def registration_reference(spark, sf):
    from skytable.plans.views import table
    c = F.col("c_custkey")
    q = table(spark, sf, "customer").select(
        F.floor(c / 4).cast("long").alias("run"),
        F.when(c % 4 == 0, F.when(c % 5 == 0, "L").otherwise("R")).when(c % 4 == 1, "G").when(c % 4 == 2, "H").otherwise("O").alias("channel"),
        F.when((c % 3 == 0) | (F.floor(c / 4) % 6 == 0), None).otherwise(2.0 + (c * 7919 % 1000) / 1e3).alias("fwhm"),
        (c * 31 % 400 * 1.0).alias("stars"))
    return op.registration_reference(q)


# --- neighbourhoods --------------------------------------------------------------------------

SMOOTH = PX + ", sm AS (SELECT a.image_id, a.y, a.x, sum(b.v) / 9e0 AS s FROM px a CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dy) CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dx) JOIN px b ON b.image_id = a.image_id AND b.y = greatest(0, least(7, a.y + dy)) AND b.x = greatest(0, least(7, a.x + dx)) GROUP BY a.image_id, a.y, a.x)"
PEAKS = SMOOTH + """,
pk AS (SELECT a.image_id, a.y, a.x, a.s FROM sm a LEFT JOIN sm b ON b.image_id = a.image_id AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 AND (b.y <> a.y OR b.x <> a.x) GROUP BY a.image_id, a.y, a.x, a.s
  HAVING bool_and(CASE WHEN b.y < a.y OR (b.y = a.y AND b.x < a.x) THEN a.s > b.s ELSE a.s >= b.s END))"""


@query("local_maxima", sql(PEAKS + " SELECT image_id, y, x, round(s, 6) AS smooth FROM pk WHERE s > 44e-2"))
def local_maxima(spark, sf):
    m = op.local_maxima(op.smooth3(pixels(spark, sf)), F.lit(0.44))
    return m.select("image_id", "y", "x", F.round("smooth", 6).alias("smooth"))


def box_sql() -> str:
    text, src, val = PX, "px", "v"
    for i in range(3):
        for axis, other in (("x", "y"), ("y", "x")):
            name = f"b{i}{axis}"
            text += f", {name} AS (SELECT a.image_id, a.y, a.x, sum(b.{val}) / 5e0 AS v FROM {src} a CROSS JOIN (SELECT unnest([-2, -1, 0, 1, 2]) AS d) JOIN {src} b ON b.image_id = a.image_id AND b.{other} = a.{other} AND b.{axis} = greatest(0, least(7, a.{axis} + d)) GROUP BY ALL)"
            src, val = name, "v"
    return text + f" SELECT image_id, y, x, round(v, 6) AS blurred FROM {src}"


@query("box_blur", sql(box_sql()))
def box_blur(spark, sf):
    return op.box_blur(pixels(spark, sf), 2).select("image_id", "y", "x", F.round("blurred", 6).alias("blurred"))


def gauss_sql() -> str:
    k = "kern AS (SELECT d, exp(-5e-1 * d * d / (9e-1 * 9e-1)) / sum(exp(-5e-1 * d * d / (9e-1 * 9e-1))) OVER () AS w FROM (SELECT unnest(range(-4, 5)) AS d))"
    text, src = PX + ", " + k, "px"
    for axis, other in (("x", "y"), ("y", "x")):
        text += f", g{axis} AS (SELECT a.image_id, a.y, a.x, sum(w * b.v) AS v FROM {src} a CROSS JOIN kern JOIN {src} b ON b.image_id = a.image_id AND b.{other} = a.{other} AND b.{axis} = greatest(0, least(7, a.{axis} + d)) GROUP BY a.image_id, a.y, a.x)"
        src = f"g{axis}"
    return text


@query("gaussian_blur", sql(gauss_sql() + " SELECT image_id, y, x, round(v, 6) AS blurred FROM gy"))
def gaussian_blur(spark, sf):
    return op.gaussian_blur(pixels(spark, sf), 0.9).select("image_id", "y", "x", F.round("blurred", 6).alias("blurred"))


@query("frequency_separate", sql(gauss_sql() + " SELECT p.image_id, p.y, p.x, round(g.v, 6) AS low, round(greatest(0e0, least(1e0, (p.v - g.v) / 2e0 + 5e-1)), 6) AS high FROM px p JOIN gy g ON p.image_id = g.image_id AND p.y = g.y AND p.x = g.x"))
def frequency_separate(spark, sf):
    f = op.frequency_separate(pixels(spark, sf), 0.9)
    return f.select("image_id", "y", "x", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def shrink_sql() -> str:
    return """cov AS (SELECT o, i, least(i + 1e0, (o + 1) * 16e-1) - greatest(i * 1e0, o * 16e-1) AS w FROM (SELECT unnest(range(5)) AS o) CROSS JOIN (SELECT unnest(range(8)) AS i) WHERE least(i + 1e0, (o + 1) * 16e-1) - greatest(i * 1e0, o * 16e-1) > 1e-9),
sh AS (SELECT image_id, CAST(cy.o AS INTEGER) AS y, CAST(cx.o AS INTEGER) AS x, sum(v * cy.w * cx.w) / sum(cy.w * cx.w) AS v FROM px JOIN cov cy ON cy.i = y JOIN cov cx ON cx.i = x GROUP BY ALL)"""


@query("area_shrink", sql(PX + ", " + shrink_sql() + ", hv AS (SELECT image_id, y // 2 AS y, x // 2 AS x, sum(v) / 4e0 AS v FROM sh GROUP BY ALL) SELECT 'shrink' AS kind, image_id, y, x, round(v, 6) AS v FROM sh UNION ALL SELECT 'halve', image_id, y, x, round(v, 6) FROM hv"))
def area_shrink(spark, sf):
    s = op.area_shrink(pixels(spark, sf), 5, 5)
    both = s.withColumn("kind", F.lit("shrink")).unionByName(op.halved(s).withColumn("kind", F.lit("halve")))
    return both.select("kind", "image_id", "y", "x", F.round("v", 6).alias("v"))


@query("crop", sql(PX + " SELECT image_id, y - 1 AS y, x - 2 AS x, round(v, 6) AS v FROM px WHERE x >= 2 AND x < 7 AND y >= 1 AND y < 6"))
def crop(spark, sf):
    return op.crop(pixels(spark, sf), 2, 1, 7, 6).select("image_id", "y", "x", F.round("v", 6).alias("v"))


BRIGHT = "spots AS (SELECT image_id, y, x, 1e-1 + v / 1e2 + CASE WHEN abs(y - 2 - image_id % 4) + abs(x - 3 - image_id % 3) = 0 THEN 8e-1 WHEN abs(y - 2 - image_id % 4) + abs(x - 3 - image_id % 3) = 1 THEN 4e-1 ELSE 0e0 END AS v FROM pixels)"
FOUND = BRIGHT + f""",
sk AS (SELECT image_id, median(v) AS sky FROM spots GROUP BY image_id), smp AS (SELECT image_id, v FROM spots WHERE (y * 8 + x) % 7 = 0), nm AS (SELECT image_id, {upper_sql('v')} AS m FROM smp GROUP BY image_id),
nz AS (SELECT s.image_id, greatest(14826e-4 * {upper_sql('abs(s.v - m.m)')}, 1e0 / 65535e0) AS noise FROM smp s JOIN nm m ON s.image_id = m.image_id GROUP BY s.image_id),
sm AS (SELECT a.image_id, a.y, a.x, sum(b.v) / 9e0 AS s FROM spots a CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dy) CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dx) JOIN spots b ON b.image_id = a.image_id AND b.y = greatest(0, least(7, a.y + dy)) AND b.x = greatest(0, least(7, a.x + dx)) GROUP BY a.image_id, a.y, a.x),
pk AS (SELECT a.image_id, a.y, a.x, a.s FROM sm a LEFT JOIN sm b ON b.image_id = a.image_id AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 AND (b.y <> a.y OR b.x <> a.x) GROUP BY a.image_id, a.y, a.x, a.s
  HAVING bool_and(CASE WHEN b.y < a.y OR (b.y = a.y AND b.x < a.x) THEN a.s > b.s ELSE a.s >= b.s END)),
hit AS (SELECT pk.*, sky FROM pk JOIN sk ON pk.image_id = sk.image_id JOIN nz ON pk.image_id = nz.image_id WHERE s > sky + 5e0 * noise),
lt AS (SELECT h.image_id, h.y AS cy, h.x AS cx, h.s, h.sky, p.y, p.x, p.v - h.sky AS above FROM hit h JOIN spots p ON p.image_id = h.image_id AND (p.x - h.x) * (p.x - h.x) + (p.y - h.y) * (p.y - h.y) <= 9),
st AS (SELECT image_id, cy, cx, sum(greatest(above, 0e0) * x) / sum(greatest(above, 0e0)) AS x, sum(greatest(above, 0e0) * y) / sum(greatest(above, 0e0)) AS y, sum(above) AS flux, count(*) FILTER (WHERE above >= 5e-1 * (s - sky)) AS area FROM lt GROUP BY image_id, cy, cx, s, sky)"""


def spots(spark, sf):
    i = F.col("image_id")
    off = F.abs(F.col("y") - 2 - i % 4) + F.abs(F.col("x") - 3 - i % 3)
    return view(spark, sf, "pixels").withColumn("v", 0.1 + F.col("v") / 100.0 + F.when(off == 0, 0.8).when(off == 1, 0.4).otherwise(0.0))


@query("detect_stars", sql(FOUND + " SELECT image_id, round(x, 5) AS x, round(y, 5) AS y, round(flux, 5) AS flux, area FROM st"))
def detect_stars(spark, sf):
    s = op.detect_stars(spots(spark, sf))
    return s.select("image_id", *[F.round(c, 5).alias(c) for c in ("x", "y", "flux")], "area")


# --- stretches ----------------------------------------------------------------------------------

BLACK = PX + """,
nine AS (SELECT a.image_id, a.y, a.x, list_sort(list(b.v))[5] AS m FROM px a CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dy) CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dx) JOIN px b ON b.image_id = a.image_id AND b.y = greatest(0, least(7, a.y + dy)) AND b.x = greatest(0, least(7, a.x + dx)) GROUP BY a.image_id, a.y, a.x),
rm AS (SELECT image_id, min(m) AS robust_min FROM nine GROUP BY image_id),
bl AS (SELECT p.image_id, r.robust_min, count(*) FILTER (WHERE p.v < r.robust_min) AS below, min(p.v) AS low FROM px p JOIN rm r ON p.image_id = r.image_id GROUP BY p.image_id, r.robust_min),
bp AS (SELECT image_id, robust_min, CASE WHEN below <= 0 THEN robust_min ELSE least(0e0, low) END AS black FROM bl)"""


@query("robust_minimum_and_black_point", sql(BLACK + " SELECT image_id, round(robust_min, 6) AS robust_min, round(black, 6) AS black FROM bp"))
def robust_minimum_and_black_point(spark, sf):
    return rounded(op.black_point(pixels(spark, sf)), "robust_min", "black")


STRETCH = BLACK + ", " + MED + """,
par AS (SELECT bp.image_id, greatest(0e0, black) AS c0, (med - greatest(0e0, black)) / (1e0 - greatest(0e0, black)) AS q FROM bp JOIN meds ON bp.image_id = meds.image_id),
mid AS (SELECT image_id, c0, q * (25e-2 - 1e0) / (2e0 * 25e-2 * q - 25e-2 - q) AS m FROM par),
pt AS (SELECT p.image_id, p.y, p.x, greatest(0e0, least(1e0, (p.v - c0) / (1e0 - c0))) AS u, m FROM px p JOIN mid ON p.image_id = mid.image_id)"""


@query("pixel_transfer", sql(STRETCH + " SELECT image_id, y, x, round((m - 1e0) * u / ((2e0 * m - 1e0) * u - m), 6) AS stretched FROM pt"))
def pixel_transfer(spark, sf):
    px = written(pixels(spark, sf), "pixels")
    return op.stretched(px, op.stretch_parameters(px)).select("image_id", "y", "x", F.round("stretched", 6).alias("stretched"))


@query("linked_stretch", sql(BLACK + ", " + MED + """, g AS (SELECT bp.image_id // 3 AS run, greatest(0e0, min(black)) AS c0, avg(med) AS mm FROM bp JOIN meds ON bp.image_id = meds.image_id GROUP BY ALL),
q AS (SELECT run, c0, (mm - c0) / (1e0 - c0) AS q FROM g) SELECT run, round(c0, 6) AS c0, round(q * (25e-2 - 1e0) / (2e0 * 25e-2 * q - 25e-2 - q), 6) AS m FROM q"""))
def linked_stretch(spark, sf):
    return rounded(op.linked_parameters(written(channels(spark, sf), "pixels"), "run"), "c0", "m")


@query("screen_unscreen", sql(RUNS + """ SELECT run, y, x, round(1e0 - (1e0 - "H") * (1e0 - "S"), 6) AS screened, round(CASE WHEN "S" < 1 THEN least(1e0, greatest(0e0, ("H" - "S") / (1e0 - "S"))) ELSE 0e0 END, 6) AS stars FROM wide"""))
def screen_unscreen(spark, sf):
    w = wide(spark, sf)
    return w.select("run", "y", "x", F.round(op.screen(F.col("H"), F.col("S")), 6).alias("screened"),
                    F.round(op.unscreen(F.col("H"), F.col("S")), 6).alias("stars"))


@query("white_balance_offset", sql(RUNS + """, gn AS (SELECT run, y, x, "H" * 12e-1 AS h, "S" * 9e-1 AS s, "O" * 105e-2 AS o FROM wide), md AS (SELECT run, median(h) AS mh, median(s) AS ms, median(o) AS mo FROM gn GROUP BY run)
SELECT g.run, y, x, round(h + (mh + ms + mo) / 3e0 - mh, 6) AS "H", round(s + (mh + ms + mo) / 3e0 - ms, 6) AS "S", round(o + (mh + ms + mo) / 3e0 - mo, 6) AS "O" FROM gn g JOIN md ON g.run = md.run"""))
def white_balance_offset(spark, sf):
    return rounded(op.white_balance(wide(spark, sf), {"H": 1.2, "S": 0.9, "O": 1.05}), "H", "S", "O")


@query("background_offset", sql(PX + ", m AS (SELECT image_id, median(v) AS med FROM px WHERE x >= 1 AND x < 7 AND y >= 1 AND y < 7 GROUP BY image_id) SELECT p.image_id, y, x, round(v + 3e-1 - med, 6) AS v FROM px p JOIN m ON p.image_id = m.image_id"))
def background_offset(spark, sf):
    px = pixels(spark, sf)
    ref = px.select("image_id").distinct().withColumn("ref_median", F.lit(0.3))
    return op.background_offset(px, ref).select("image_id", "y", "x", F.round("v", 6).alias("v"))


@query("equal_sky", sql(SKY + ", rf AS (SELECT image_id // 3 AS run, sky AS rs FROM sky WHERE image_id % 3 = 0) SELECT p.image_id, y, x, round(greatest(0e0, least(1e0, v - sky + rs)), 6) AS v FROM px p JOIN sky s ON p.image_id = s.image_id JOIN rf ON rf.run = p.image_id // 3"))
def equal_sky(spark, sf):
    return op.equal_sky(channels(spark, sf), "run", "H", block=2).select("image_id", "y", "x", F.round("v", 6).alias("v"))


@query("scale_to_reference", sql(PX + ", " + MED + """, sg AS (SELECT p.image_id, max(med) AS med, 14826e-4 * median(abs(p.v - med)) AS sd FROM px p JOIN meds m ON p.image_id = m.image_id GROUP BY p.image_id),
rf AS (SELECT image_id // 3 AS run, med AS rm, sd AS rs FROM sg WHERE image_id % 3 = 0) SELECT p.image_id, y, x, round((v - med) * (rs / sd) + rm, 6) AS v FROM px p JOIN sg ON p.image_id = sg.image_id JOIN rf ON rf.run = p.image_id // 3"""))
def scale_to_reference(spark, sf):
    return op.scale_to_reference(channels(spark, sf), "run", "H").select("image_id", "y", "x", F.round("v", 6).alias("v"))


@query("reversible_stretch", sql(PX + ", " + MED + """, nm AS (SELECT p.image_id, y, x, v, greatest(0e0, least(1e0, (v - low) / (1e0 - low))) AS n FROM px p JOIN meds m ON p.image_id = m.image_id), om AS (SELECT image_id, median(n) AS m FROM nm GROUP BY image_id)
SELECT n.image_id, y, x, round(greatest(0e0, least(1e0, (m - 1e0) * 2e-1 * n / (m * (2e-1 + n - 1e0) - 2e-1 * n))), 6) AS stretched, round(v, 6) AS restored FROM nm n JOIN om ON n.image_id = om.image_id"""))
def reversible_stretch(spark, sf):
    px = written(pixels(spark, sf), "pixels")
    state = written(op.reversible_state(px, 0.2), "stretch-state")
    back = op.reversible_inverse(op.reversible_forward(px, state), state)
    return back.select("image_id", "y", "x", F.round("stretched", 6).alias("stretched"), F.round("restored", 6).alias("restored"))


@query("pixel_expression", sql(RUNS + """ SELECT run, y, x, round(greatest(0e0, least(1e0, 2e0 * "H" - "S")), 6) AS r, round(greatest(0e0, least(1e0, "H" * "O" + 1e-1)), 6) AS g FROM wide"""))
def pixel_expression(spark, sf):
    w = op.pixel_expression(wide(spark, sf), {"r": "2e0 * H - S", "g": "H * O + 1e-1"})
    return w.select("run", "y", "x", F.round("r", 6).alias("r"), F.round("g", 6).alias("g"))


# --- star light -----------------------------------------------------------------------------------

STAR_AT = "at3 AS (SELECT DISTINCT image_id, image_id * 10 AS star, 3e0 + (image_id % 10) / 1e1 AS sx, 4e0 - (image_id % 7) / 1e1 AS sy FROM px)"
RINGS = PX + ", " + STAR_AT + f", rg AS (SELECT a.image_id, a.star, CAST(floor(sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy)) + 5e-1) AS INTEGER) AS r, v FROM px p JOIN at3 a ON p.image_id = a.image_id), rp AS (SELECT image_id, star, r, {upper_sql('v')} AS raw FROM rg WHERE r <= 4 GROUP BY image_id, star, r)"


def stars_at(spark, sf):
    i = F.col("image_id")
    return pixels(spark, sf).select("image_id").distinct().select(
        "image_id", (i * 10).alias("star"), (3.0 + (i % 10) / 10.0).alias("sx"), (4.0 - (i % 7) / 10.0).alias("sy"))


def rings(spark, sf):
    return op.ring_profile(pixels(spark, sf), stars_at(spark, sf), 4)


@query("radial_profile", sql(RINGS + " SELECT image_id, star, r, round(raw, 6) AS raw FROM rp"))
def radial_profile(spark, sf):
    return rounded(rings(spark, sf), "raw")


# a second detection, whose core covers the right of every ring
CORES = RINGS + """, cores AS (SELECT DISTINCT image_id, image_id * 10 AS star, 2 AS x0, 3 AS y0, 4 AS x1, 5 AS y1 FROM px UNION ALL SELECT DISTINCT image_id, image_id * 10 + 1, 5, 3, 7, 6 FROM px),
lab AS (SELECT p.image_id, p.y, p.x, min(star) AS label FROM px p JOIN cores c ON p.image_id = c.image_id AND p.x >= x0 - 1 AND p.x < x1 + 1 AND p.y >= y0 - 1 AND p.y < y1 + 1 GROUP BY ALL)"""


@query("radial_profile_cores", sql(CORES + f""", own AS (SELECT p.image_id, a.star, CAST(floor(sqrt((p.x - sx) * (p.x - sx) + (p.y - sy) * (p.y - sy)) + 5e-1) AS INTEGER) AS r, v FROM px p JOIN at3 a ON p.image_id = a.image_id
  LEFT JOIN lab l ON l.image_id = p.image_id AND l.y = p.y AND l.x = p.x WHERE label IS NULL OR label = a.star)
SELECT image_id, star, r, round({upper_sql('v')}, 6) AS raw FROM own WHERE r <= 4 GROUP BY image_id, star, r"""))
def radial_profile_cores(spark, sf):
    ids = pixels(spark, sf).select("image_id").distinct()

    def core(k, *rect):
        return ids.select("image_id", (F.col("image_id") * 10 + k).alias("star"), *[F.lit(v).alias(c) for c, v in zip(("x0", "y0", "x1", "y1"), rect, strict=True)])
    labels = op.core_labels(core(0, 2, 3, 4, 5).unionByName(core(1, 5, 3, 7, 6)), 1.0)
    return rounded(op.ring_profile(pixels(spark, sf), stars_at(spark, sf), 4, labels=labels), "raw")


@query("smooth_profile", sql(RINGS + """, sm AS (SELECT *, CASE WHEN r >= 1 THEN avg(CASE WHEN r >= 1 THEN raw END) OVER (PARTITION BY image_id, star ORDER BY r ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) ELSE raw END AS m FROM rp)
SELECT image_id, star, r, round(min(m) OVER (PARTITION BY image_id, star ORDER BY r), 6) AS smooth FROM sm"""))
def smooth_profile(spark, sf):
    s = op.smooth_profile(rings(spark, sf), 1)
    return s.select("image_id", "star", "r", F.round("smooth", 6).alias("smooth"))


# One long profile per image: its 64 pixels in raster order, falling to a level.
LONG = "lp AS (SELECT image_id, image_id AS star, y * 8 + x AS r, 1e0 / (1 + y * 8 + x) + v / 2e2 AS raw FROM pixels)"


@query("profile_end", sql(LONG + """, w AS (SELECT *, avg(raw) OVER (PARTITION BY image_id ORDER BY r ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS near, avg(raw) OVER (PARTITION BY image_id ORDER BY r ROWS BETWEEN 4 FOLLOWING AND 7 FOLLOWING) AS far FROM lp),
s AS (SELECT image_id, star, r, far FROM w WHERE r >= 1 AND r + 8 <= 64 AND near - far <= 3e0 * (12533e-4 * 1e-2 / sqrt(2e0 * pi() * r)) * sqrt(2e0) / sqrt(4e0)),
f AS (SELECT image_id, star, min(r) AS r, arg_min(far, r) AS far FROM s GROUP BY ALL), l AS (SELECT image_id, star, raw FROM lp WHERE r = 63)
SELECT l.image_id, l.star, coalesce(f.r + 4, 64) AS rmax, round(coalesce(f.far, least(0e0, l.raw)), 6) AS sky, f.r IS NOT NULL AS settled FROM l LEFT JOIN f ON l.image_id = f.image_id"""))
def profile_end(spark, sf):
    p = view(spark, sf, "pixels").withColumn("r", F.col("y") * 8 + F.col("x"))
    p = p.select("image_id", F.col("image_id").alias("star"), "r", (1.0 / (1 + F.col("r")) + F.col("v") / 200.0).alias("raw"))
    noise = p.select("image_id").distinct().withColumn("noise", F.lit(0.01))
    return rounded(op.profile_end(p, noise), "sky")


@query("star_colour", sql(RUNS + """, sc AS (SELECT w.run, sum("H") AS h, sum("S") AS s, sum("O") AS o FROM wide w WHERE sqrt((x - 34e-1) * (x - 34e-1) + (y - 38e-1) * (y - 38e-1)) <= 22e-1 GROUP BY w.run)
SELECT run, round(h / ((h + s + o) / 3), 6) AS "H", round(s / ((h + s + o) / 3), 6) AS "S", round(o / ((h + s + o) / 3), 6) AS "O" FROM sc"""))
def star_colour(spark, sf):
    w = wide(spark, sf)
    stars = w.select("run").distinct().select("run", F.lit(1).alias("star"), F.lit(3.4).alias("sx"), F.lit(3.8).alias("sy"))
    return rounded(op.star_colour(w, stars, ["H", "S", "O"], 2.2).drop("star"), "H", "S", "O")


MODELS = PX + """, at2 AS (SELECT DISTINCT image_id, image_id * 10 AS star, 2e0 + (image_id % 10) / 1e1 AS sx, 3e0 + (image_id % 7) / 1e1 AS sy FROM px UNION ALL SELECT DISTINCT image_id, image_id * 10 + 1, 5e0 + (image_id % 10) / 1e1, 4e0 + (image_id % 7) / 1e1 FROM px),
pr AS (SELECT image_id, star, CAST(r AS INTEGER) AS r, 5e-1 / (1 + r * r) AS raw FROM at2 CROSS JOIN (SELECT unnest(range(5)) AS r)),
nx AS (SELECT *, coalesce(lead(raw) OVER (PARTITION BY star ORDER BY r), 0e0) AS nxt FROM pr),
dd AS (SELECT a.image_id, a.star, p.y, p.x, p.v, sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy)) AS d FROM at2 a JOIN px p ON a.image_id = p.image_id),
mo AS (SELECT d.image_id, d.star, d.y, d.x, d.v, greatest(0e0, n.raw + (n.nxt - n.raw) * (d.d - n.r)) AS model FROM dd d JOIN nx n ON d.star = n.star AND n.r = CAST(floor(d.d) AS INTEGER)),
sm AS (SELECT *, sum(model) OVER (PARTITION BY image_id, y, x) AS total FROM mo),
ta AS (SELECT *, greatest(0e0, least(1e0, (total / 2e-2 - 1e0) / 4e0)) AS t FROM sm),
li AS (SELECT image_id, star, y, x, CASE WHEN total > 0 AND model > 0 THEN t * t * (3e0 - 2e0 * t) * model / total * least(v - 3e-1, 2e0 * total) + (1e0 - t * t * (3e0 - 2e0 * t)) * model ELSE 0e0 END AS light FROM ta)"""


def models(spark, sf):
    i = F.col("image_id")
    px = pixels(spark, sf)
    ids = px.select("image_id").distinct()
    one = ids.select("image_id", (i * 10).alias("star"), (2.0 + (i % 10) / 10.0).alias("sx"), (3.0 + (i % 7) / 10.0).alias("sy"))
    two = ids.select("image_id", (i * 10 + 1).alias("star"), (5.0 + (i % 10) / 10.0).alias("sx"), (4.0 + (i % 7) / 10.0).alias("sy"))
    stars = one.unionByName(two)
    profile = stars.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(4)))).select("image_id", "star", "r", (0.5 / (1 + F.col("r") * F.col("r"))).alias("raw"))
    inside = op.model_pixels(stars, profile, 6).join(px.select("image_id", "y", "x"), ["image_id", "y", "x"])
    noise = ids.select("image_id", F.lit(0.02).alias("noise"), F.lit(0.3).alias("sky"))
    return px, stars, inside, noise


@query("star_model_sums", sql(MODELS + " SELECT image_id, y, x, round(sum(model), 6) AS total FROM mo GROUP BY image_id, y, x"))
def star_model_sums(spark, sf):
    _, _, m, _ = models(spark, sf)
    return m.groupBy("image_id", "y", "x").agg(F.round(F.sum("model"), 6).alias("total"))


@query("deblend_share", sql(MODELS + " SELECT image_id, star, y, x, round(light, 6) AS light FROM li"))
def deblend_share(spark, sf):
    px, _, m, noise = models(spark, sf)
    return rounded(op.deblended(px, m, noise), "light")


@query("deblend_layer", sql(MODELS + ", tk AS (SELECT image_id, y, x, sum(light) AS s FROM li GROUP BY image_id, y, x) SELECT p.image_id, p.y, p.x, round(p.v - coalesce(s, 0e0), 6) AS residual FROM px p LEFT JOIN tk ON p.image_id = tk.image_id AND p.y = tk.y AND p.x = tk.x"))
def deblend_layer(spark, sf):
    px, _, m, noise = models(spark, sf)
    r = op.residual_layer(px, op.deblended(px, m, noise))
    return r.select("image_id", "y", "x", F.round("residual", 6).alias("residual"))


@query("pixel_ownership", sql(MODELS + """, fx AS (SELECT *, 1e2 + (star * 37) % 50 AS flux FROM at2), nr AS (SELECT p.image_id, p.y, p.x, f.star, f.flux, abs(x - sx) <= 1 AND abs(y - sy) <= 1 AS core FROM px p JOIN fx f ON p.image_id = f.image_id
  WHERE (abs(x - sx) <= 1 AND abs(y - sy) <= 1) OR sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy)) < 25e-1), rk AS (SELECT *, row_number() OVER (PARTITION BY image_id, y, x ORDER BY core DESC, CASE WHEN core THEN star * 1e0 ELSE flux END DESC, CASE WHEN core THEN -star ELSE star END) AS rn FROM nr)
SELECT p.image_id, p.y, p.x, r.star AS owner FROM px p LEFT JOIN rk r ON r.rn = 1 AND p.image_id = r.image_id AND p.y = r.y AND p.x = r.x"""))
def pixel_ownership(spark, sf):
    px, stars, _, _ = models(spark, sf)
    stars = stars.withColumns({"flux": 100.0 + (F.col("star") * 37) % 50, "core": F.lit(1.0), "halo": F.lit(2.5)})
    return op.pixel_owner(px, stars)


# two sprites, and a detection that is none, in every image; both modes
SPRITES = PX + """, ids AS (SELECT DISTINCT image_id FROM px), sp AS (SELECT image_id, k AS star, k * 3 + image_id % 2 + 1 AS x0, 2 + image_id % 3 AS y0, CASE WHEN (image_id + k) % 2 = 0 THEN 5e0 ELSE 4e0 + k END AS flux FROM ids, (SELECT unnest([0, 1]) AS k) ks),
claims AS (SELECT p.image_id, p.y, p.x, m.mode, star, CASE WHEN p.x >= x0 AND p.x < x0 + 2 AND p.y >= y0 AND p.y < y0 + 2 THEN 1 ELSE 0 END AS rk, flux FROM px p JOIN sp ON p.image_id = sp.image_id, (SELECT unnest([FALSE, TRUE]) AS mode) m
  WHERE (p.x >= x0 AND p.x < x0 + 2 AND p.y >= y0 AND p.y < y0 + 2) OR (p.x >= x0 - 2 AND p.x < x0 + 4 AND p.y >= y0 - 2 AND p.y < y0 + 4 AND (NOT m.mode OR sqrt((p.x - x0 - 5e-1) * (p.x - x0 - 5e-1) + (p.y - y0 - 5e-1) * (p.y - y0 - 5e-1)) < 3e0))
  UNION ALL SELECT image_id, y, x, FALSE, NULL, 2, 0e0 FROM px WHERE x >= 3 AND x < 5 AND y >= 3 AND y < 5),
bst AS (SELECT *, row_number() OVER (PARTITION BY image_id, y, x, mode ORDER BY rk DESC, CASE WHEN rk = 1 THEN star * 1e0 ELSE flux END DESC, star) AS rn FROM claims)"""


@query("sprite_ownership", sql(SPRITES + " SELECT p.image_id, p.y, p.x, m.mode AS halo_mode, b.star AS owner FROM px p CROSS JOIN (SELECT unnest([FALSE, TRUE]) AS mode) m LEFT JOIN bst b ON b.rn = 1 AND b.mode = m.mode AND b.image_id = p.image_id AND b.y = p.y AND b.x = p.x"))
def sprite_ownership(spark, sf):
    px = pixels(spark, sf)
    i, k = F.col("image_id"), F.col("star")
    sp = px.select("image_id").distinct().withColumn("star", F.explode(F.array(F.lit(0), F.lit(1)))).withColumns({"x0": k * 3 + i % 2 + 1, "y0": 2 + i % 3})
    sp = sp.withColumns({"x1": F.col("x0") + 2, "y1": F.col("y0") + 2, "x": F.col("x0") + 0.5, "y": F.col("y0") + 0.5, "flux": F.when((i + k) % 2 == 0, 5.0).otherwise(4.0 + k), "outer": F.lit(3.0),
                         **{f"f{c}{n}": F.col(f"{c}0") + d for c in "xy" for n, d in ((0, -2), (1, 4))}})
    others = px.select("image_id").distinct().select("image_id", *[F.lit(v).alias(c) for c, v in (("x0", 3), ("y0", 3), ("x1", 5), ("y1", 5))])
    both = [op.sprite_owner(px, sp, others, halo_mode=m).withColumn("halo_mode", F.lit(m)) for m in (False, True)]
    return both[0].unionByName(both[1])


@query("stack_frames", sql(PX + """, fr AS (SELECT CASE WHEN image_id % 10 < 2 THEN image_id // 10 * 3 WHEN image_id % 10 < 6 THEN image_id // 10 * 3 + 1 ELSE -(image_id // 20) - 1 END AS stack_id, y, x, v FROM px),
st AS (SELECT stack_id, y, x, count(*) AS n, median(v) AS m, stddev_samp(v) AS s0 FROM fr GROUP BY ALL),
s1 AS (SELECT f.stack_id, f.y, f.x, n, m, CASE WHEN n >= 8 THEN 1134e-3 * stddev_samp(greatest(m - 15e-1 * s0, least(m + 15e-1 * s0, v))) ELSE s0 END AS s FROM fr f JOIN st ON f.stack_id = st.stack_id AND f.y = st.y AND f.x = st.x GROUP BY f.stack_id, f.y, f.x, n, m, s0),
s2 AS (SELECT f.stack_id, f.y, f.x, n, m, CASE WHEN n >= 8 THEN 1134e-3 * stddev_samp(greatest(m - 15e-1 * s, least(m + 15e-1 * s, v))) ELSE s END AS s FROM fr f JOIN s1 ON f.stack_id = s1.stack_id AND f.y = s1.y AND f.x = s1.x GROUP BY f.stack_id, f.y, f.x, n, m, s1.s),
s3 AS (SELECT f.stack_id, f.y, f.x, n, m, CASE WHEN n >= 8 THEN 1134e-3 * stddev_samp(greatest(m - 15e-1 * s, least(m + 15e-1 * s, v))) ELSE s END AS s FROM fr f JOIN s2 ON f.stack_id = s2.stack_id AND f.y = s2.y AND f.x = s2.x GROUP BY f.stack_id, f.y, f.x, n, m, s2.s),
kp AS (SELECT f.stack_id, f.y, f.x, f.v, n, CASE WHEN n >= 8 THEN v - m BETWEEN -4 * s AND 3 * s WHEN n >= 3 THEN (v - m) / abs(m) BETWEEN -2e-1 AND 1e-1 ELSE TRUE END AS ok FROM fr f JOIN s3 ON f.stack_id = s3.stack_id AND f.y = s3.y AND f.x = s3.x)
SELECT stack_id, y, x, round(avg(v) FILTER (WHERE ok), 6) AS v, count(*) FILTER (WHERE ok) AS kept, max(n) AS frames FROM kp GROUP BY stack_id, y, x"""))
def stack_frames(spark, sf):
    i = F.col("image_id")
    ten = F.floor(i / 10).cast("long")
    stack = F.when(i % 10 < 2, ten * 3).when(i % 10 < 6, ten * 3 + 1).otherwise(-F.floor(i / 20).cast("long") - 1)
    return rounded(op.stack_frames(pixels(spark, sf).withColumn("stack_id", stack)), "v")


SPECKS = PX + """, sp AS (SELECT image_id, image_id * 3 + k AS det_id, ((image_id * 7 + k * 13) % 80) / 1e1 AS x, ((image_id * 11 + k * 29) % 80) / 1e1 AS y, 1e2 + (image_id * 17 + k * 31) % 90 AS flux, 1 + (image_id + k) % 2 AS half_width
  FROM (SELECT DISTINCT image_id FROM px) CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2))"""
WHOLE = SPECKS + """,
off AS (SELECT s.*, i, j FROM sp s CROSS JOIN (SELECT unnest([-2, -1, 0, 1, 2]) AS i) CROSS JOIN (SELECT unnest([-2, -1, 0, 1, 2]) AS j) WHERE (abs(i) <= 1 AND abs(j) <= 1) OR i * i + j * j <= 4),
rd AS (SELECT o.det_id, max(CASE WHEN abs(i) <= 1 AND abs(j) <= 1 THEN p.v END) AS top, max(CASE WHEN abs(i) > 1 OR abs(j) > 1 THEN p.v END) AS around, max(CASE WHEN i = 0 AND j = 0 THEN p.v END) AS centre
  FROM off o JOIN px p ON p.image_id = o.image_id AND p.x = greatest(0, least(7, CAST(floor(o.x + 5e-1) AS INTEGER) + i)) AND p.y = greatest(0, least(7, CAST(floor(o.y + 5e-1) AS INTEGER) + j)) GROUP BY o.det_id),
dd AS (SELECT s.*, r.top, r.around, r.centre FROM sp s JOIN rd r ON s.det_id = r.det_id)
SELECT image_id, det_id FROM dd d WHERE NOT around > top AND NOT EXISTS (SELECT 1 FROM dd o WHERE o.image_id = d.image_id AND o.flux > d.flux AND o.centre >= d.top
  AND sqrt((o.x - d.x) * (o.x - d.x) + (o.y - d.y) * (o.y - d.y)) <= 5e-1 * (floor(o.x + o.half_width) + 1 - floor(o.x - o.half_width)) + 1)"""


@query("fragment_filter", sql(WHOLE))
def fragment_filter(spark, sf):
    px = pixels(spark, sf)
    i, k = F.col("image_id"), F.col("k")
    d = px.select("image_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2)))).select(
        "image_id", (i * 3 + k).alias("det_id"), (((i * 7 + k * 13) % 80) / 10.0).alias("x"), (((i * 11 + k * 29) % 80) / 10.0).alias("y"),
        (100.0 + (i * 17 + k * 31) % 90).alias("flux"), (1 + (i + k) % 2).alias("half_width"))
    return op.whole_stars(d, px, 1).select("image_id", "det_id")

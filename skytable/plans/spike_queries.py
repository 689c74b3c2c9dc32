"""Spikes on images of 80 by 80: every hundred embeddings are the noise of one, with three stars whose light follows the first of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from skytable.functions.storage import written
from skytable.operators import spikes as op
from skytable.operators.pixels import noise_sigma
from skytable.plans.pixel_queries import upper_sql
from skytable.plans.registry import query
from skytable.plans.views import view, with_views

FWHM = 2.0
SIZE = (80, 80)

# the third star lies on the first one's spike
STARS = """SELECT image_id, star, CASE star WHEN 0 THEN 3e1 + 1e1 * a WHEN 1 THEN 58e0 - 6e0 * b ELSE 3e1 + 1e1 * a + 22e0 * cos(radians(20e0 + (image_id * 7) % 60)) END AS x,
  CASE star WHEN 0 THEN 32e0 + 8e0 * b WHEN 1 THEN 18e0 + 9e0 * a ELSE 32e0 + 8e0 * b + 22e0 * sin(radians(20e0 + (image_id * 7) % 60)) END AS y,
  CASE star WHEN 0 THEN 1e0 + a WHEN 1 THEN 5e-1 + b / 2e0 ELSE 2e-1 + a / 1e1 END AS flux, 2e0 + star / 2e0 AS half
FROM (SELECT image_id // 100 AS image_id, max(CASE WHEN y = 0 AND x = 0 THEN abs(v) END) AS a, max(CASE WHEN y = 0 AND x = 1 THEN abs(v) END) AS b FROM pixels GROUP BY image_id // 100) h, (SELECT explode(array(0, 1, 2)) AS star) k"""
SPIKY = """SELECT n.image_id, n.y, n.x, n.v / 4e2 + sum(flux * (exp(-((n.x - s.x) * (n.x - s.x) + (n.y - s.y) * (n.y - s.y)) / 4e0)
  + 8e-2 * exp(-power((n.y - s.y) * cos(radians(a)) - (n.x - s.x) * sin(radians(a)), 2) / 2e0) / (1e0 + abs((n.x - s.x) * cos(radians(a)) + (n.y - s.y) * sin(radians(a))) / 15e0)
  + 8e-2 * exp(-power((n.x - s.x) * cos(radians(a)) + (n.y - s.y) * sin(radians(a)), 2) / 2e0) / (1e0 + abs((n.y - s.y) * cos(radians(a)) - (n.x - s.x) * sin(radians(a))) / 15e0))) AS v
FROM (SELECT image_id // 100 AS image_id, CAST((image_id % 100) // 10 * 8 + y AS BIGINT) AS y, CAST(image_id % 10 * 8 + x AS BIGINT) AS x, v, 2e1 + (image_id // 100 * 7) % 60 AS a FROM pixels) n
JOIN stars s ON n.image_id = s.image_id GROUP BY n.image_id, n.y, n.x, n.v, n.a"""


def _spark(text: str) -> str:
    return text.replace("//", "div")


def images(spark, sf):
    """Pixels and stars. As SPIKY, with the three stars of an image side by side, so that a pixel meets them in one row."""
    view(spark, sf, "pixels").createOrReplaceTempView("pixels")
    stars = written(spark.sql(_spark(STARS)), "spike_stars")
    wide = stars.groupBy("image_id").agg(*[F.max(F.when(F.col("star") == k, F.col(c))).alias(f"{c}{k}") for k in range(3) for c in ("x", "y", "flux")])
    i = F.col("image_id")
    px = view(spark, sf, "pixels").select(F.floor(i / 100).cast("long").alias("image_id"), (F.floor(i % 100 / 10) * 8 + F.col("y")).cast("long").alias("y"), (i % 10 * 8 + F.col("x")).cast("long").alias("x"), "v")
    a = F.radians((20 + F.col("image_id") * 7 % 60).cast("double"))
    light = F.col("v") / 400.0
    for k in range(3):
        dx, dy = F.col("x") - F.col(f"x{k}"), F.col("y") - F.col(f"y{k}")
        along, across = dx * F.col("__c") + dy * F.col("__s"), dy * F.col("__c") - dx * F.col("__s")
        light = light + F.col(f"flux{k}") * (F.exp(-(dx * dx + dy * dy) / 4) + 0.08 * F.exp(-across * across / 2) / (1 + F.abs(along) / 15) + 0.08 * F.exp(-along * along / 2) / (1 + F.abs(across) / 15))
    rows = px.join(wide, "image_id").withColumns({"__c": F.cos(a), "__s": F.sin(a)})
    return written(rows.select("image_id", "y", "x", light.alias("v")), "spike_pixels"), stars


def light_sql(name: str, places: str, keys: str, final: str | None = None) -> str:
    """CTE ``name``: sum of k times the bilinear value at (px, py), by ``keys``."""
    by = ", ".join(f"c.{k}" for k in keys.split(", "))
    return f"""{name}_c AS (SELECT *, floor(px) + i AS cx, floor(py) + j AS cy, (CASE WHEN i = 1 THEN px - floor(px) ELSE 1 - (px - floor(px)) END) * (CASE WHEN j = 1 THEN py - floor(py) ELSE 1 - (py - floor(py)) END) AS w
  FROM ({places}) p, (SELECT unnest([0, 1, 0, 1]) AS i, unnest([0, 0, 1, 1]) AS j) ij),
{name}_n AS (SELECT *, sum(w) OVER (PARTITION BY image_id, place) AS all_w FROM {name}_c WHERE cx >= 0 AND cy >= 0 AND cx < 80 AND cy < 80 AND w > 0),
{name} AS MATERIALIZED (SELECT {by}, sum(k * w / all_w * v) AS light FROM {name}_n c JOIN spiky s ON s.image_id = c.image_id AND s.x = c.cx AND s.y = c.cy GROUP BY {by})"""


def ray_sql(source: str, degrees: str, r: str, offsets: str, columns: str) -> str:
    """Places along ``degrees`` at ``r`` and each of ``offsets``, a list of structs (o, f)."""
    return f"""SELECT {columns}, row_number() OVER (PARTITION BY image_id) AS place, k * f AS k, x + r * cos(radians(a)) - o * sin(radians(a)) AS px, y + r * sin(radians(a)) + o * cos(radians(a)) AS py
  FROM (SELECT *, {degrees} AS a, {r} AS r, unnest({offsets}) AS u FROM {source}) q, (SELECT 1) one, LATERAL (SELECT u.o AS o, u.f AS f) uu"""


SIDES = "[{{'o': 0e0, 'f': 1e0}}, {{'o': {s}, 'f': -5e-1}}, {{'o': -({s}), 'f': -5e-1}}]"
THREE = SIDES.format(s="3e0")
DUCK_STARS = STARS.replace("explode(array(0, 1, 2))", "unnest([0, 1, 2])")
DIRECTIONS = (f"stars AS MATERIALIZED ({DUCK_STARS}), spiky AS MATERIALIZED ({SPIKY}), top AS (SELECT *, 1e0 / flux AS k FROM stars),\n"
              + light_sql("prof", ray_sql("(SELECT *, unnest(range(20)) AS step FROM (SELECT *, unnest(range(360)) AS degree FROM top))", "degree", "half + 2e0 + 2 + step", THREE, "image_id, degree"), "image_id, degree")
              + """,
full_ AS (SELECT i.image_id, d AS degree, COALESCE(light, 0) AS light FROM (SELECT DISTINCT image_id FROM stars) i CROSS JOIN (SELECT unnest(range(360)) AS d) g LEFT JOIN prof p ON p.image_id = i.image_id AND p.degree = g.d),
mid AS (SELECT image_id, """ + upper_sql("light") + """ AS m, max(light) AS top FROM full_ GROUP BY image_id),
dev AS (SELECT f.image_id, """ + upper_sql("abs(light - m)") + """ AS dev, any_value(top) AS top FROM full_ f JOIN mid USING (image_id) GROUP BY f.image_id),
peaks AS (SELECT f.image_id, f.degree FROM full_ f JOIN dev d ON f.image_id = d.image_id WHERE f.light > greatest(6 * CASE WHEN dev = 0 THEN 1e0 / 14826e-4 ELSE dev END, top / 1e1)
  AND NOT EXISTS (SELECT 1 FROM full_ g WHERE g.image_id = f.image_id AND g.light > f.light AND least((g.degree - f.degree + 360) % 360, (f.degree - g.degree + 360) % 360) BETWEEN 1 AND 3)),
facing AS MATERIALIZED (SELECT a.* FROM peaks a WHERE EXISTS (SELECT 1 FROM peaks b WHERE a.image_id = b.image_id AND abs((b.degree - a.degree + 540) % 360 - 180) >= 178)),
""" + light_sql("fine", ray_sql("(SELECT *, unnest(range(98)) AS step FROM (SELECT t.*, degree, unnest(range(41)) AS turn FROM top t JOIN facing f ON t.image_id = f.image_id))", "degree - 1 + turn * 5e-2", "half + 2e0 + 2 + step", THREE, "image_id, degree, turn"), "image_id, degree, turn")
              + """,
dirs AS MATERIALIZED (SELECT image_id, degree, degree - 1 + arg_max(turn, (light, -turn)) * 5e-2 AS angle FROM fine GROUP BY image_id, degree)""")
WIDTH = (DIRECTIONS + ",\n" + light_sql("lat", ray_sql("(SELECT *, unnest(range(33)) AS across FROM (SELECT t.*, angle, unnest(range(98)) AS step FROM top t JOIN dirs d ON t.image_id = d.image_id))", "angle", "half + 2e0 + 2 + step",
                                                       "[{'o': across * 5e-1 - 8, 'f': 1e0}]", "image_id, across"), "image_id, across")
         + """,
base AS (SELECT image_id, avg(light) FILTER (across < 4 OR across > 28) AS b FROM lat GROUP BY image_id), q AS (SELECT image_id, across, light - b AS q, max(light - b) OVER (PARTITION BY image_id) AS peak FROM lat JOIN base USING (image_id)),
half_ AS (SELECT a.image_id, way, arg_min((abs(a.across - 16) + (a.q - a.peak / 2) / (a.q - b.q)) * 5e-1, abs(a.across - 16)) AS h FROM q a JOIN q b ON a.image_id = b.image_id, (SELECT unnest([-1, 1]) AS way) w
  WHERE b.across = a.across + way AND (a.across - 16) * way >= 0 AND b.q < a.peak / 2 GROUP BY a.image_id, way),
width AS MATERIALIZED (SELECT image_id, greatest(5e-1, least(4e0, sum(h) / 23548e-4)) AS sigma FROM half_ GROUP BY image_id)""")
FALL = (WIDTH + ",\n" + light_sql("fall", ray_sql("(SELECT *, unnest(range(start, 600)) AS rr FROM (SELECT t.*, angle, sigma, CAST(floor(ceil(half) + 4) AS INTEGER) AS start FROM top t JOIN dirs d ON t.image_id = d.image_id JOIN width w ON w.image_id = t.image_id))",
                                                  "angle", "rr", SIDES.format(s="greatest(3e0, 3 * sigma)"), "image_id, rr"), "image_id, rr")
        + """,
starts AS (SELECT t.image_id, CAST(floor(ceil(half) + 4) AS INTEGER) AS start, count(*) AS c FROM top t JOIN dirs d ON t.image_id = d.image_id GROUP BY ALL),
radii AS (SELECT image_id, unnest(range(min(start), 600)) AS r, min(start) AS first_r FROM starts GROUP BY image_id),
raw AS (SELECT r.image_id, r.r, first_r, COALESCE(light, 0) / (SELECT sum(c) FROM starts s WHERE s.image_id = r.image_id AND s.start <= r.r) AS t FROM radii r LEFT JOIN fall f ON f.image_id = r.image_id AND f.rr = r.r),
sm AS (SELECT image_id, r, first_r, greatest(0e0, avg(t) OVER (PARTITION BY image_id ORDER BY r ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING)) AS t FROM raw),
mono AS (SELECT image_id, r, first_r, min(t) OVER (PARTITION BY image_id ORDER BY r ROWS UNBOUNDED PRECEDING) AS t FROM sm),
curve AS MATERIALIZED (SELECT image_id, r, t FROM mono UNION ALL SELECT image_id, unnest(range(0, first_r)), t FROM mono WHERE r = first_r)""")
FIT = (FALL + f""",
smp AS (SELECT image_id, v FROM spiky WHERE (y * 80 + x) % 7 = 0), m AS (SELECT image_id, {upper_sql('v')} AS m FROM smp GROUP BY image_id),
noise AS (SELECT s.image_id, greatest(14826e-4 * {upper_sql('abs(s.v - m.m)')}, 1e0 / 65535e0) AS noise FROM smp s JOIN m ON s.image_id = m.image_id GROUP BY s.image_id),
""" + light_sql("own", ray_sql("(SELECT t.* REPLACE (1e0 AS k), angle, sigma, ceil(half) + 2 AS start, unnest(range(20)) AS step FROM top t JOIN dirs d ON t.image_id = d.image_id JOIN width w ON w.image_id = t.image_id)", "angle", "start + step",
                               SIDES.format(s="greatest(3e0, 3 * sigma)"), "image_id, star, angle, start, step"), "image_id, star, angle, start, step")
       + f""",
steps_ AS (SELECT t.image_id, star, angle, ceil(half) + 2 AS start, unnest(range(20)) AS step FROM top t JOIN dirs d ON t.image_id = d.image_id),
ratio AS (SELECT s.*, COALESCE(light, 0) / t AS q FROM steps_ s LEFT JOIN own o ON o.image_id = s.image_id AND o.star = s.star AND o.angle = s.angle AND o.step = s.step JOIN curve c ON c.image_id = s.image_id AND c.r = s.start + s.step WHERE t > 0),
sc AS (SELECT image_id, star, angle, start, {upper_sql('q')} AS scale, count(*) AS n FROM ratio GROUP BY ALL),
sd AS (SELECT s.image_id, s.star, s.angle, s.start, any_value(scale) AS scale, any_value(n) AS n, {upper_sql('abs(q - scale)')} AS dev FROM ratio r JOIN sc s ON r.image_id = s.image_id AND r.star = s.star AND r.angle = s.angle GROUP BY ALL),
fit AS MATERIALIZED (SELECT d.image_id, star, angle, start, scale, CASE WHEN scale > 3 * 12533e-4 * (CASE WHEN dev = 0 THEN 1 ELSE 14826e-4 * dev END) / sqrt(n)
  THEN (SELECT count(*) FROM curve c WHERE c.image_id = d.image_id AND c.r >= d.start AND d.scale * c.t > 3 * 12247e-4 / sqrt(17e0) * noise) ELSE 0 END - 1 AS reach FROM sd d JOIN noise z ON z.image_id = d.image_id),
pair_ AS (SELECT a.image_id, a.star, a.angle, a.start, arg_min(b.scale, b.angle) AS bs, arg_min(b.reach, b.angle) AS br, any_value(a.scale) AS scale, any_value(a.reach) AS reach FROM fit a LEFT JOIN fit b ON a.image_id = b.image_id AND a.star = b.star AND abs(abs(b.angle - a.angle) - 180) < 2 GROUP BY ALL),
best AS (SELECT image_id, star, angle, start, CASE WHEN bs > scale THEN bs ELSE scale END AS scale, CASE WHEN bs > scale THEN br ELSE reach END AS reach FROM pair_),
spikes AS MATERIALIZED (SELECT image_id, star, angle, start, scale, start + reach AS reach FROM best WHERE reach > 0)""")
OWN = FIT + """,
met AS (SELECT p.image_id, b.star AS by_star, b.angle AS by_angle, d.star, d.angle FROM spikes b JOIN stars p ON p.image_id = b.image_id AND p.star = b.star JOIN spikes d ON d.image_id = b.image_id JOIN stars s ON s.image_id = d.image_id AND s.star = d.star
  JOIN width w ON w.image_id = b.image_id WHERE p.flux > s.flux AND (s.x - p.x) * cos(radians(b.angle)) + (s.y - p.y) * sin(radians(b.angle)) BETWEEN b.start AND b.reach
  AND abs((s.y - p.y) * cos(radians(b.angle)) - (s.x - p.x) * sin(radians(b.angle))) <= greatest(2e0, 3 * sigma) AND least(abs(d.angle - b.angle) % 180, 180 - abs(d.angle - b.angle) % 180) < 2),
-- three stars: what drops a spike is the brightest's, or the second's unless that is dropped itself
once AS (SELECT * FROM met m WHERE NOT EXISTS (SELECT 1 FROM met k WHERE k.image_id = m.image_id AND k.star = m.by_star AND k.angle = m.by_angle))"""


def sql(text: str) -> str:
    return with_views("pixels", text)


def _found(spark, sf):
    px, stars = images(spark, sf)
    return px, stars, written(op.spike_directions(px, stars, FWHM, size=SIZE), "spike_directions")


def _width(spark, sf):
    px, stars, dirs = _found(spark, sf)
    return px, stars, dirs, written(op.spike_width(px, stars, dirs, FWHM, size=SIZE), "spike_width")


def _fitted(spark, sf):
    px, stars, dirs, width = _width(spark, sf)
    fall = written(op.spike_falloff(px, stars, dirs, width, FWHM, size=SIZE), "spike_falloff")
    return written(op.fit_spikes(px, stars, dirs, width, fall, noise_sigma(px), FWHM, size=SIZE), "spikes"), stars, width


@query("spike_directions", sql(DIRECTIONS + " SELECT image_id, CAST(degree AS INTEGER) AS degree, round(angle, 6) AS angle FROM dirs"))
def spike_directions(spark, sf):
    return _found(spark, sf)[2].withColumn("angle", F.round("angle", 6))


@query("spike_width", sql(WIDTH + " SELECT image_id, round(sigma, 6) AS sigma FROM width"))
def spike_width(spark, sf):
    return _width(spark, sf)[3].withColumn("sigma", F.round("sigma", 6))


@query("spike_falloff", sql(FALL + " SELECT image_id, CAST(r AS INTEGER) AS r, round(t, 9) AS t FROM curve"))
def spike_falloff(spark, sf):
    px, stars, dirs, width = _width(spark, sf)
    return op.spike_falloff(px, stars, dirs, width, FWHM, size=SIZE).select("image_id", "r", F.round("t", 9).alias("t"))


@query("fit_spike", sql(FIT + " SELECT image_id, star, round(angle, 6) AS angle, start, round(scale, 6) AS scale, reach FROM spikes"))
def fit_spike(spark, sf):
    return _fitted(spark, sf)[0].withColumns({"angle": F.round("angle", 6), "scale": F.round("scale", 6)})


@query("own_spikes", sql(OWN + " SELECT s.image_id, s.star, round(s.angle, 6) AS angle, reach FROM spikes s WHERE NOT EXISTS (SELECT 1 FROM once o WHERE o.image_id = s.image_id AND o.star = s.star AND o.angle = s.angle)"))
def own_spikes(spark, sf):
    spikes, stars, width = _fitted(spark, sf)
    return op.own_spikes(spikes, stars, width).select("image_id", "star", F.round("angle", 6).alias("angle"), "reach")

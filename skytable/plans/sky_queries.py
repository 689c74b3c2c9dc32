"""Queries over the ``catalogue``, ``field``, ``placed`` and ``detections`` views."""

from __future__ import annotations

from pyspark.sql import functions as F

from skytable.functions import sky
from skytable.functions.storage import written
from skytable.operators import sky as op
from skytable.plans.registry import query
from skytable.plans.views import table, view, with_views
from skytable.sources import catalogues


def sep_sql(ra1: str, dec1: str, ra2: str, dec2: str) -> str:
    a1, d1, a2, d2 = (f"radians({c})" for c in (ra1, dec1, ra2, dec2))
    return (f"degrees(acos(greatest(-1e0, least(1e0, cos({d1}) * cos({a1}) * cos({d2}) * cos({a2}) + cos({d1}) * sin({a1}) * cos({d2}) * sin({a2})"
            f" + sin({d1}) * sin({d2})))))")


def sigma_sql(g: str) -> str:
    return (f"CASE WHEN {g} IS NULL OR {g} <= 15 THEN 2e-2 WHEN {g} <= 17 THEN 2e-2 + ({g} - 15e0) * 5e-2 / 2e0 WHEN {g} <= 176e-1 THEN 7e-2 + ({g} - 17e0) * (1e-1 - 7e-2) / (176e-1 - 17e0) ELSE 1e-1 END")


USABLE = f"CASE WHEN plx + 17e-3 > 0 AND plx + 17e-3 >= 5 * ({sigma_sql('g')}) THEN plx + 17e-3 END"
WCS = (324.745, 57.514, 801.0, 601.0, (-0.0025, 0.0004, 0.0003, 0.0024))


def solution():
    return sky.wcs(*WCS)


def plane_sql(ra: str, dec: str) -> str:
    """CTE text that projects ``rows`` onto the plane about the image centre."""
    a0, d0 = f"radians({WCS[0]}e0)", f"radians({WCS[1]}e0)"
    c = f"(sin({d0}) * sin(radians({dec})) + cos({d0}) * cos(radians({dec})) * cos(radians({ra}) - {a0}))"
    return (f"{c} AS cosc, degrees(cos(radians({dec})) * sin(radians({ra}) - {a0}) / {c}) AS xi, "
            f"degrees((cos({d0}) * sin(radians({dec})) - sin({d0}) * cos(radians({dec})) * cos(radians({ra}) - {a0})) / {c}) AS eta")


DET = WCS[4][0] * WCS[4][3] - WCS[4][1] * WCS[4][2]
PIXEL = (f"{WCS[2] - 1}e0 + ({WCS[4][3]}e0 * xi - {WCS[4][1]}e0 * eta) / ({DET!r}) AS x, "
         f"{WCS[3] - 1}e0 + ({WCS[4][0]}e0 * eta - {WCS[4][2]}e0 * xi) / ({DET!r}) AS y")


# --- catalogue tables ---------------------------------------------------------------------

def catalogue(spark, sf):
    return view(spark, sf, "catalogue")


@query("read_star_catalogue", with_views("catalogue", """SELECT round(ra, 6) AS ra, round("dec", 6) AS "dec", round(plx, 6) AS plx, round(pmra, 6) AS pmra, round(pmdec, 6) AS pmdec, round(g, 6) AS g FROM catalogue"""))
def read_star_catalogue(spark, sf):
    c = catalogue(spark, sf).select("ra", "dec", "plx", "pmra", "pmdec", F.col("g").alias("G"),
                                    F.lit(None).cast("double").alias("BP"), F.lit(None).cast("double").alias("RP"))
    path = catalogues.write_star_table(c, "catalogue-tsv")
    back = catalogues.read_star_table(spark, path)
    return back.select(*[F.round(x, 6).alias(x) for x in ("ra", "dec", "plx", "pmra", "pmdec")], F.round("G", 6).alias("g"))


@query("healpix_catalogue", with_views("catalogue", f"""SELECT star_id, round(g, 6) AS g FROM catalogue WHERE g < 16 AND {sep_sql('ra', '"dec"', '324.7e0', '57.5e0')} <= 20e0"""))
def healpix_catalogue(spark, sf):
    path = catalogues.write_healpix(catalogue(spark, sf), "catalogue-healpix")
    near = catalogues.read_healpix_cone(spark, path, 324.7, 57.5, 20.0, 16.0)
    return near.select("star_id", F.round("g", 6).alias("g"))


@query("usable_parallax", with_views("catalogue", f"SELECT star_id, round({sigma_sql('g')}, 6) AS sigma, round({USABLE}, 6) AS plx FROM catalogue"))
def usable_parallax(spark, sf):
    return catalogue(spark, sf).select("star_id", F.round(op.parallax_sigma(F.col("g")), 6).alias("sigma"),
                                       F.round(op.usable_parallax(F.col("plx"), F.col("g")), 6).alias("plx"))


@query("cone_filter", with_views("catalogue", f"""SELECT star_id, round(ra, 6) AS ra, round("dec", 6) AS "dec" FROM catalogue WHERE g < 17 AND {sep_sql('ra', '"dec"', '324.7e0', '57.5e0')} <= 20e0"""))
def cone_filter(spark, sf):
    return op.cone_filter(catalogue(spark, sf), 324.7, 57.5, 20.0, 17.0).select(
        "star_id", F.round("ra", 6).alias("ra"), F.round("dec", 6).alias("dec"))


@query("inside_image", with_views("field", f"""proj AS (SELECT star_id, {USABLE} AS p, {plane_sql('ra', '"dec"')} FROM field),
pix AS (SELECT star_id, p, {PIXEL} FROM proj WHERE p IS NOT NULL AND cosc > 1e-6)
SELECT star_id, round(x, 4) AS x, round(y, 4) AS y, round(1e3 / p, 4) AS distance_pc FROM pix WHERE x >= 0 AND x < 1600 AND y >= 0 AND y < 1200"""))
def inside_image(spark, sf):
    p = op.place_stars(view(spark, sf, "field"), solution(), 1600, 1200)
    return p.select("star_id", *[F.round(c, 4).alias(c) for c in ("x", "y", "distance_pc")])


@query("residual_verdict", """SELECT c_custkey AS star_id, CASE WHEN c_acctbal / 1e3 < 0 THEN 'unknown' WHEN c_acctbal / 1e3 >= 3 THEN 'bad' WHEN c_acctbal / 1e3 > 315e-3 THEN 'poor' ELSE 'ok' END AS verdict FROM customer""")
def residual_verdict(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("star_id"),
                                               op.residual_verdict(F.col("c_acctbal") / 1e3).alias("verdict"))


CONES = """cones AS (SELECT s_suppkey AS cone_id, (s_suppkey * 731e-1) % 360e0 AS cone_ra, ((s_suppkey * 37) % 179 - 89) * 1e0 AS cone_dec, 3e0 + s_suppkey % 9 AS radius, 13e0 + s_suppkey % 5 AS g_max FROM supplier)"""


def cones(spark, sf):
    table(spark, sf, "supplier").createOrReplaceTempView("supplier")
    return spark.sql("WITH " + CONES + " SELECT * FROM cones")


@query("cone_search_join", with_views("catalogue", CONES + f""", pairs AS (SELECT q.cone_id, c.star_id, q.radius, {sep_sql('c.ra', 'c."dec"', 'q.cone_ra', 'q.cone_dec')} AS sep FROM cones q JOIN catalogue c ON c.g < q.g_max)
SELECT cone_id, star_id, round(sep, 5) AS sep FROM pairs WHERE sep <= radius"""))
def cone_search_join(spark, sf):
    return op.cone_join(cones(spark, sf), catalogue(spark, sf), 4.0).select("cone_id", "star_id", F.round("sep", 5).alias("sep"))


STORED = CONES + """,
stored AS (SELECT concat('cone', CAST(cone_id AS VARCHAR(9)), '_', CAST(grow AS VARCHAR(4)), '.csv') AS path, cone_ra + 5e-1 * (grow - 2) AS ra, cone_dec AS "dec", radius + grow AS r, g_max - (cone_id % 3) * 4e-2 AS g
  FROM cones CROSS JOIN (SELECT 1 AS grow UNION ALL SELECT 2 UNION ALL SELECT 3))"""


@query("covering_cone_pick", "WITH " + STORED + f""", ok AS (SELECT c.cone_id, s.path, s.r FROM cones c JOIN stored s ON {sep_sql('c.cone_ra', 'c.cone_dec', 's.ra', 's."dec"')} + c.radius <= s.r + 1e-9 AND s.g >= c.g_max - 5e-2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cone_id ORDER BY r, path) AS rn FROM ok) SELECT cone_id, path, r FROM ranked WHERE rn = 1""")
def covering_cone_pick(spark, sf):
    asked = cones(spark, sf)
    stored = spark.sql("WITH " + STORED.replace('"dec"', "dec") + " SELECT * FROM stored")
    return op.covering_cones(asked, stored, 4.0)


@query("region_cache", with_views("catalogue", CONES + f""", near AS (SELECT q.cone_id, c.star_id, c.g, c.ra, c."dec" FROM cones q JOIN catalogue c ON c.g < q.g_max WHERE {sep_sql('c.ra', 'c."dec"', 'q.cone_ra', 'q.cone_dec')} <= q.radius)
SELECT cone_id, count(*) AS stars, round(min(g), 6) AS brightest FROM near GROUP BY cone_id"""))
def region_cache(spark, sf):
    root = catalogues.region_store(spark)
    asked = cones(spark, sf)
    catalogues.build_regions(asked.filter("cone_id % 2 = 0"), catalogue(spark, sf), root)
    catalogues.build_regions(asked, catalogue(spark, sf), root)
    stars = catalogues.read_regions(asked, root)
    return stars.groupBy("cone_id").agg(F.count("*").alias("stars"), F.round(F.min("g"), 6).alias("brightest"))


def cell_sql(ra: str, dec: str, size: str) -> str:
    row = f"least(CAST(ceil(180 / {size}) AS INTEGER) - 1, greatest(0, CAST(floor(({dec} + 90e0) / {size}) AS INTEGER)))"
    n = f"greatest(1, CAST(floor(360e0 * cos(radians(-90e0 + ({row} + 5e-1) * {size})) / {size}) AS INTEGER))"
    return f"CAST({row} * 100000 + CAST(floor({ra} / 360e0 * {n}) AS INTEGER) % {n} AS BIGINT)"


@query("brightest_per_cell", with_views("catalogue", f"""cells AS (SELECT *, 1 AS size, {cell_sql('ra', '"dec"', '12e0')} AS cell FROM catalogue UNION ALL SELECT *, 2, {cell_sql('ra', '"dec"', '20e0')} FROM catalogue),
ranked AS (SELECT *, row_number() OVER (PARTITION BY size, cell ORDER BY g, ra, "dec") AS rn FROM cells) SELECT DISTINCT star_id, round(g, 6) AS g FROM ranked WHERE rn <= 5"""))
def brightest_per_cell(spark, sf):
    return op.brightest_per_cell(catalogue(spark, sf), [12.0, 20.0]).select("star_id", F.round("g", 6).alias("g"))


TABLES = """tables AS (SELECT star_id, round(ra, 2) AS ra, round("dec", 0) AS "dec", g, 2 AS table_order FROM catalogue WHERE star_id % 3 <> 0 UNION ALL SELECT star_id + 1000000, round(ra, 2), round("dec", 0), g, 1 FROM catalogue WHERE star_id % 2 = 0)"""


@query("merge_tables", with_views("catalogue", TABLES + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY round(ra, 7), round("dec", 7) ORDER BY table_order, star_id) AS rn FROM tables)
SELECT star_id, table_order FROM ranked WHERE rn = 1"""))
def merge_tables(spark, sf):
    catalogue(spark, sf).createOrReplaceTempView("catalogue")
    t = spark.sql("WITH " + TABLES.replace('"dec"', "dec") + " SELECT table_order, star_id, ra, dec, g FROM tables")
    return op.merge_tables(t).select("star_id", "table_order")


# --- geometry ---------------------------------------------------------------------------

@query("sky_vectors", with_views("catalogue", f"""SELECT star_id, round(cos(radians("dec")) * cos(radians(ra)), 6) AS vx, round(cos(radians("dec")) * sin(radians(ra)), 6) AS vy, round(sin(radians("dec")), 6) AS vz,
  round("dec", 6) AS back_dec, round({sep_sql('ra', '"dec"', '1e1', '2e1')}, 6) AS sep FROM catalogue"""))
def sky_vectors(spark, sf):
    c = catalogue(spark, sf).withColumn("v", sky.unit_vector("ra", "dec"))
    return c.select("star_id", *[F.round(f"v.{k}", 6).alias(f"v{k}") for k in "xyz"],
                    F.round(sky.vector_angles(F.col("v"))["dec"], 6).alias("back_dec"),
                    F.round(sky.separation("ra", "dec", 10.0, 20.0), 6).alias("sep"))


@query("tan_projection", with_views("field", f"""proj AS (SELECT star_id, ra, "dec", {plane_sql('ra', '"dec"')} FROM field)
SELECT star_id, round(x, 4) AS x, round(y, 4) AS y, round(ra, 6) AS back_ra, round("dec", 6) AS back_dec FROM (SELECT *, {PIXEL} FROM proj)"""))
def tan_projection(spark, sf):
    f = view(spark, sf, "field").withColumn("p", sky.tan_project("ra", "dec", solution()))
    back = sky.tan_unproject(F.col("p.x"), F.col("p.y"), solution())
    return f.select("star_id", F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y"),
                    F.round(back["ra"], 6).alias("back_ra"), F.round(back["dec"], 6).alias("back_dec"))


def unproject_sql(x: str, y: str, part: str) -> str:
    dx, dy = f"({x} - ((20e0 + pos % 7) - 1e0))", f"({y} - ((30e0 + pos % 5) - 1e0))"
    xi, eta = f"radians(s * {dx})", f"radians(s * {dy})"
    den = f"(cos(radians(d0)) - {eta} * sin(radians(d0)))"
    if part == "ra":
        return f"((degrees(radians(a0) + atan2({xi}, {den})) + 360e0) % 360e0)"
    return f"degrees(atan2(sin(radians(d0)) + {eta} * cos(radians(d0)), sqrt({xi} * {xi} + {den} * {den})))"


def field_sql() -> str:
    centre = (unproject_sql("w / 2", "h / 2", "ra"), unproject_sql("w / 2", "h / 2", "dec"))
    corners = [(unproject_sql(x, y, "ra"), unproject_sql(x, y, "dec")) for x, y in (("0", "0"), ("w", "0"), ("0", "h"), ("w", "h"))]
    names = ", ".join(f"{c[0]} AS r{i}, {c[1]} AS e{i}" for i, c in enumerate([centre, *corners]))
    radius = ", ".join(sep_sql("r0", "e0", f"r{i}", f"e{i}") for i in range(1, 5))
    return f"""images AS (SELECT c_custkey AS pos, ((c_custkey * 137) % 360) * 1e0 AS a0, ((c_custkey * 29) % 121 - 60) * 1e0 AS d0, 2e-3 + (c_custkey % 9) * 1e-4 AS s, 1e3 + c_custkey % 300 AS w, 8e2 + c_custkey % 200 AS h FROM customer),
ends AS (SELECT pos, {names} FROM images) SELECT pos AS image_id, round(r0, 6) AS ra, round(e0, 6) AS "dec", round(greatest({radius}), 5) AS radius FROM ends"""


@query("image_field", "WITH " + field_sql())
def image_field(spark, sf):
    c = F.col("c_custkey")
    w = F.struct(((c * 137) % 360 * 1.0).alias("crval1"), (((c * 29) % 121 - 60) * 1.0).alias("crval2"),
                 (20.0 + c % 7).alias("crpix1"), (30.0 + c % 5).alias("crpix2"),
                 F.array(2e-3 + (c % 9) * 1e-4, F.lit(0.0), F.lit(0.0), 2e-3 + (c % 9) * 1e-4).alias("cd"))
    f = table(spark, sf, "customer").select(c.alias("image_id"), w.alias("w"), (1e3 + c % 300).alias("width"),
                                            (8e2 + c % 200).alias("height"))
    f = sky.with_image_field(f, "w", "width", "height")
    return f.select("image_id", F.round("field_ra", 6).alias("ra"), F.round("field_dec", 6).alias("dec"),
                    F.round("field_radius", 5).alias("radius"))


HEALPIX = f"""base AS (SELECT star_id, sin(radians("dec")) AS z, (ra % 360e0) / 90e0 AS tt FROM catalogue),
belt AS (SELECT *, CAST(floor(256 * (5e-1 + tt) - 256 * 75e-2 * z) AS BIGINT) AS jp, CAST(floor(256 * (5e-1 + tt) + 256 * 75e-2 * z) AS BIGINT) AS jm, least(CAST(floor(tt) AS BIGINT), 3) AS q, 256 * sqrt(3e0 * (1e0 - abs(z))) AS t FROM base),
cap AS (SELECT *, least(CAST(floor((tt - q) * t) AS BIGINT), 255) AS jpc, least(CAST(floor((1e0 - (tt - q)) * t) AS BIGINT), 255) AS jmc, abs(z) <= 2e0 / 3e0 AS b FROM belt),
xy AS (SELECT star_id, CASE WHEN b THEN CASE WHEN jp // 256 = jm // 256 THEN CASE WHEN jp // 256 = 4 THEN 4 ELSE jp // 256 + 4 END WHEN jp // 256 < jm // 256 THEN jp // 256 ELSE jm // 256 + 8 END WHEN z >= 0 THEN q ELSE q + 8 END AS face,
  CASE WHEN b THEN jm % 256 WHEN z >= 0 THEN 255 - jmc ELSE jpc END AS ix, CASE WHEN b THEN 255 - jp % 256 WHEN z >= 0 THEN 255 - jpc ELSE jmc END AS iy FROM cap)
SELECT star_id, CAST(face * 65536 + {' + '.join(f'((ix // {1 << i}) % 2) * {1 << 2 * i} + ((iy // {1 << i}) % 2) * {2 << 2 * i}' for i in range(8))} AS BIGINT) AS pixel FROM xy"""


@query("healpix_nested", with_views("catalogue", HEALPIX))
def healpix_nested(spark, sf):
    return catalogue(spark, sf).select("star_id", sky.healpix_nested("ra", "dec", 8).alias("pixel"))


@query("equal_area_cell", with_views("catalogue", f"""SELECT star_id, {cell_sql('ra', '"dec"', '3e0')} AS cell FROM catalogue"""))
def equal_area_cell(spark, sf):
    return catalogue(spark, sf).select("star_id", sky.equal_area_cell("ra", "dec", 3.0).alias("cell"))


@query("star_trajectory", with_views("field", f"""good AS (SELECT star_id, ra, "dec", 1e3 / ({USABLE}) AS d FROM field WHERE {USABLE} IS NOT NULL),
steps AS (SELECT *, 18e1 * CAST(f AS DOUBLE) / 4e0 AS s, CAST(f AS INTEGER) AS frame FROM good CROSS JOIN (SELECT unnest(range(5)) AS f)),
moved AS (SELECT *, d * cos(radians("dec")) * cos(radians(ra)) - s * cos(radians(575e-1)) * cos(radians(3247e-1)) AS px, d * cos(radians("dec")) * sin(radians(ra)) - s * cos(radians(575e-1)) * sin(radians(3247e-1)) AS py,
  d * sin(radians("dec")) - s * sin(radians(575e-1)) AS pz FROM steps), r AS (SELECT *, d / sqrt(px * px + py * py + pz * pz) AS ratio, px * cos(radians(575e-1)) * cos(radians(3247e-1)) + py * cos(radians(575e-1)) * sin(radians(3247e-1)) + pz * sin(radians(575e-1)) > 0 AS front FROM moved),
o AS (SELECT *, greatest(0e0, least(1e0, (ratio - 6e0) / 8e0)) AS t FROM r)
SELECT star_id, frame, round(ratio, 5) AS ratio, front, round(1e0 + 15e-2 * (ratio - 1e0), 5) AS growth, round(CASE WHEN front THEN 1e0 - t * t * (3e0 - 2e0 * t) ELSE 0e0 END, 5) AS opacity,
  round(degrees(asin(pz / sqrt(px * px + py * py + pz * pz))), 7) AS seen_dec FROM o"""))
def star_trajectory(spark, sf):
    f = view(spark, sf, "field").withColumn("p", op.usable_parallax(F.col("plx"), F.col("g"))).filter("p IS NOT NULL")
    t = op.star_trajectory(f.withColumn("distance_pc", 1000.0 / F.col("p")), 324.7, 57.5, 180.0, 5)
    return t.select("star_id", "frame", F.round("ratio", 5).alias("ratio"), "front", F.round("growth", 5).alias("growth"),
                    F.round("opacity", 5).alias("opacity"), F.round("seen_dec", 7).alias("seen_dec"))


# --- matching on the image --------------------------------------------------------------------

RECT = """rects AS (SELECT *, CAST(floor(x - half_width) AS INTEGER) AS x0, CAST(floor(y - half_width) AS INTEGER) AS y0, CAST(floor(x + half_width) AS INTEGER) + 1 AS x1, CAST(floor(y + half_width) AS INTEGER) + 1 AS y1 FROM detections)"""
PAIRS = RECT + """,
pairs AS (SELECT p.star_id, d.det_id, p.g, (d.x - p.x) * (d.x - p.x) + (d.y - p.y) * (d.y - p.y) AS r2 FROM placed p JOIN rects d ON d.x BETWEEN p.x - 20 AND p.x + 20
  AND sqrt((d.x - p.x) * (d.x - p.x) + (d.y - p.y) * (d.y - p.y)) <= greatest(15e-1, 45e-2 * (d.x1 - d.x0) / 2e0))"""


def placed(spark, sf):
    return view(spark, sf, "placed")


def detections(spark, sf):
    return view(spark, sf, "detections")


@query("crossmatch_detections", with_views("placed detections", PAIRS + " SELECT star_id, det_id, round(g, 6) AS g, round(r2, 6) AS r2 FROM pairs"))
def crossmatch_detections(spark, sf):
    return op.crossmatch(placed(spark, sf), detections(spark, sf)).select(
        "star_id", "det_id", F.round("g", 6).alias("g"), F.round("r2", 6).alias("r2"))


@query("one_to_one_match")
def one_to_one_match(spark, sf):
    return op.matched_places(placed(spark, sf), detections(spark, sf)).select("star_id", "det_id")


NEAREST = """near AS (SELECT d.det_id, p.star_id, sqrt((d.x - p.x) * (d.x - p.x) + (d.y - p.y) * (d.y - p.y)) AS residual FROM detections d JOIN placed p ON p.x BETWEEN d.x - 3 AND d.x + 3 AND p.y BETWEEN d.y - 3 AND d.y + 3),
best AS (SELECT *, row_number() OVER (PARTITION BY det_id ORDER BY residual, star_id) AS rn FROM near WHERE residual <= 3)"""


@query("nearest_neighbour_residual", with_views("placed detections", NEAREST + " SELECT det_id, star_id, round(residual, 6) AS residual FROM best WHERE rn = 1"))
def nearest_neighbour_residual(spark, sf):
    return op.nearest_residual(placed(spark, sf), detections(spark, sf)).withColumn("residual", F.round("residual", 6))


# eight images of the same field; every fourth has no distortion
SIP = """dd AS (SELECT det_id % 8 AS image_id, det_id, x, y, x + 1 - 2e3 AS u, y + 1 - 2e3 AS v, CASE WHEN det_id % 4 = 0 THEN 0 ELSE 1 END AS k FROM detections),
steps AS (SELECT * FROM (VALUES (0, 0e0, 0e0), (1, 5e-1, 0e0), (2, -5e-1, 0e0), (3, 0e0, 5e-1), (4, 0e0, -5e-1)) t(step, du, dv)),
warped AS (SELECT image_id, det_id, step, (u + du) + k * (2e-7 * (u + du) * (u + du) - 3e-7 * (u + du) * (v + dv) + 1e-10 * (u + du) * (u + du) * (u + du)) AS a,
  (v + dv) + k * (1e-7 * (v + dv) * (v + dv) - 2e-10 * (v + dv) * (v + dv) * (v + dv)) AS b FROM dd, steps),
jac AS (SELECT image_id, det_id, max(CASE WHEN step = 0 THEN a END) + 2e3 - 1 AS ux, max(CASE WHEN step = 0 THEN b END) + 2e3 - 1 AS uy, sum(CASE step WHEN 1 THEN a WHEN 2 THEN -a END) AS j0, sum(CASE step WHEN 3 THEN a WHEN 4 THEN -a END) AS j1,
  sum(CASE step WHEN 1 THEN b WHEN 2 THEN -b END) AS j2, sum(CASE step WHEN 3 THEN b WHEN 4 THEN -b END) AS j3 FROM warped GROUP BY image_id, det_id),
near AS (SELECT j.*, star_id, ux - p.x AS dx, uy - p.y AS dy, row_number() OVER (PARTITION BY det_id ORDER BY (ux - p.x) * (ux - p.x) + (uy - p.y) * (uy - p.y), star_id) AS rn FROM jac j JOIN placed p ON abs(ux - p.x) <= 6 AND abs(uy - p.y) <= 6)"""


@query("distorted_residual", with_views("placed detections", SIP + """
SELECT image_id, det_id, star_id, round(residual, 6) AS residual FROM (SELECT *, sqrt(power((j3 * dx - j1 * dy) / (j0 * j3 - j1 * j2), 2) + power((j0 * dy - j2 * dx) / (j0 * j3 - j1 * j2), 2)) AS residual FROM near WHERE rn = 1) WHERE residual <= 3"""))
def distorted_residual(spark, sf):
    def terms(*given):
        return F.when(F.col("det_id") % 4 != 0, F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q"), F.lit(c).alias("c")) for p, q, c in given]))
    d = detections(spark, sf).select((F.col("det_id") % 8).alias("image_id"), "det_id", "x", "y", F.lit(2000.0).alias("crpix1"), F.lit(2000.0).alias("crpix2"),
                                     terms((2, 0, 2e-7), (1, 1, -3e-7), (3, 0, 1e-10)).alias("sip_a"), terms((0, 2, 1e-7), (0, 3, -2e-10)).alias("sip_b"))
    stars = placed(spark, sf).withColumn("image_id", F.explode(F.sequence(F.lit(0), F.lit(7)).cast("array<bigint>")))
    return op.distorted_residual(stars, d).withColumn("residual", F.round("residual", 6))


def clip_sql(rounds: int) -> str:
    """Rounds of clipping as chained CTEs; a settled image does not change."""
    text = NEAREST + ",\nk0 AS (SELECT det_id % 8 AS image_id, residual FROM best WHERE rn = 1), every AS (SELECT * FROM k0)"
    for i in range(rounds):
        text += f""",
m{i} AS (SELECT image_id, median(residual) AS m FROM k{i} GROUP BY image_id),
s{i} AS (SELECT k.image_id, m.m, greatest(1e-2, 14826e-4 * median(abs(k.residual - m.m))) AS s FROM k{i} k JOIN m{i} m ON k.image_id = m.image_id GROUP BY k.image_id, m.m),
k{i + 1} AS (SELECT a.image_id, a.residual FROM every a JOIN s{i} s ON a.image_id = s.image_id WHERE a.residual <= s.m + 5e0 * s.s)"""
    return text + f""" SELECT e.image_id, e.matched, k.retained, CASE WHEN k.retained >= 5 THEN round(k.m, 6) END AS median_px FROM (SELECT image_id, count(*) AS matched FROM every GROUP BY image_id) e
  LEFT JOIN (SELECT image_id, count(*) AS retained, median(residual) AS m FROM k{rounds} GROUP BY image_id) k ON e.image_id = k.image_id"""


@query("residual_statistic", with_views("placed detections", clip_sql(6)))
def residual_statistic(spark, sf):
    r = written(op.nearest_residual(placed(spark, sf), detections(spark, sf)).withColumn("image_id", F.col("det_id") % 8), "residuals")
    return op.residual_statistic(r).withColumn("median_px", F.round("median_px", 6))


@query("add_missing_bright")
def add_missing_bright(spark, sf):
    return op.missing_bright(placed(spark, sf), detections(spark, sf)).select("star_id", F.round("g", 6).alias("g"))


@query("blend_flags", with_views("placed detections", PAIRS + """,
b AS (SELECT DISTINCT a.det_id FROM rects a JOIN rects o ON o.x0 BETWEEN a.x0 - 30 AND a.x1 AND a.det_id <> o.det_id AND a.x0 < o.x1 AND o.x0 < a.x1 AND a.y0 < o.y1 AND o.y0 < a.y1 AND o.flux >= a.flux),
c AS (SELECT DISTINCT p.det_id, p.star_id FROM pairs p JOIN rects d ON p.det_id = d.det_id JOIN placed n ON n.star_id <> p.star_id AND n.x >= d.x0 AND n.x < d.x1 AND n.y >= d.y0 AND n.y < d.y1 AND n.g <= p.g + 3e-1)
SELECT p.star_id, p.det_id, b.det_id IS NOT NULL AS blend, c.det_id IS NOT NULL AS catalogue_blend FROM pairs p LEFT JOIN b ON p.det_id = b.det_id LEFT JOIN c ON p.det_id = c.det_id AND p.star_id = c.star_id"""))
def blend_flags(spark, sf):
    return op.crossmatch_flags(detections(spark, sf), placed(spark, sf))


REACH = """halo AS (SELECT det_id, x, y, half_width, 1e2 * half_width * half_width AS flux, 2e0 * half_width + 3e0 AS reach, CASE WHEN det_id % 7 = 0 THEN ((det_id * 13) % 628) / 1e2 - 314e-2 END AS angle FROM detections)"""


@query("drop_inside_brighter", with_views("detections", REACH + """,
hidden AS (SELECT DISTINCT c.det_id FROM halo c JOIN halo o ON o.det_id <> c.det_id AND o.x BETWEEN c.x - 60 AND c.x + 60 AND o.flux > 2 * c.flux
  AND (sqrt((c.x - o.x) * (c.x - o.x) + (c.y - o.y) * (c.y - o.y)) < o.reach OR (o.angle IS NOT NULL AND sqrt((c.x - o.x) * (c.x - o.x) + (c.y - o.y) * (c.y - o.y)) <= 43
  AND sqrt((c.x - o.x) * (c.x - o.x) + (c.y - o.y) * (c.y - o.y)) * sin(least(pi() / 2, abs(atan2(sin(atan2(c.y - o.y, c.x - o.x) - o.angle), cos(atan2(c.y - o.y, c.x - o.x) - o.angle))))) <= 3)))
SELECT det_id FROM halo WHERE det_id NOT IN (SELECT det_id FROM hidden)"""))
def drop_inside_brighter(spark, sf):
    detections(spark, sf).createOrReplaceTempView("detections")
    halo = spark.sql("WITH " + REACH + " SELECT * FROM halo")
    spikes = halo.filter("angle IS NOT NULL").select("det_id", "angle", F.lit(40.0).alias("length"))
    return op.drop_inside_brighter(halo, halo, spikes=spikes).select("det_id")


# --- clusters and distances ----------------------------------------------------------------------

SAMPLES = f"""good AS (SELECT star_id, pmra AS a, pmdec AS d, {USABLE} AS p, {sigma_sql('g')} AS sp, {sep_sql('ra', '"dec"', '324745e-3', '57514e-3')} AS sep FROM field WHERE g < 16),
samples AS (SELECT star_id, a, d, p, sp, CASE WHEN sep <= 45e-2 THEN 'inside' ELSE 'field' END AS part FROM good WHERE p IS NOT NULL AND (sep <= 45e-2 OR sep BETWEEN 675e-3 AND 135e-2))"""


@query("cluster_samples", with_views("field", SAMPLES + " SELECT star_id, part, round(p, 6) AS p, round(sp, 6) AS sp FROM samples"))
def cluster_samples(spark, sf):
    return op.cluster_samples(view(spark, sf, "field"), 324.745, 57.514, 0.45).select(
        "star_id", "part", F.round("p", 6).alias("p"), F.round("sp", 6).alias("sp"))


def cluster_sql() -> str:
    near = ("((x.a - c.a) / w.sa) * ((x.a - c.a) / w.sa) + ((x.d - c.d) / w.sd) * ((x.d - c.d) / w.sd) + "
            "((x.p - c.p) / (3e0 * greatest(c.sp, x.sp))) * ((x.p - c.p) / (3e0 * greatest(c.sp, x.sp)))")

    def upper(c: str) -> str:
        return f"list_sort(list({c}))[count(*) // 2 + 1]"
    text = SAMPLES + f""",
fm AS (SELECT {upper('a')} AS ma, {upper('d')} AS md FROM samples WHERE part = 'field'),
w AS (SELECT 3e-1 * 14826e-4 * {upper('abs(a - ma)')} AS sa, 3e-1 * 14826e-4 * {upper('abs(d - md)')} AS sd FROM samples, fm WHERE part = 'field'),
sz AS (SELECT count(*) FILTER (WHERE part = 'inside') * 1e0 / count(*) FILTER (WHERE part = 'field') AS scale FROM samples),
seeds AS (SELECT c.star_id, c.a, c.d, c.p, c.sp, count(*) FILTER (WHERE x.part = 'inside') AS n, count(*) FILTER (WHERE x.part = 'field') * max(sz.scale) AS f FROM samples c, samples x, w, sz WHERE c.part = 'inside' AND {near} <= 1 GROUP BY ALL),
c0 AS (SELECT a, d, p, sp, (n - f) / sqrt(f + 1) AS sig FROM seeds ORDER BY sig DESC, star_id LIMIT 1)"""
    for i in range(5):
        text += f""",
c{i + 1} AS (SELECT {upper('x.a')} AS a, {upper('x.d')} AS d, {upper('x.p')} AS p, max(c.sp) AS sp, max(c.sig) AS sig FROM samples x, c{i} c, w WHERE x.part = 'inside' AND {near} <= 225e-2)"""
    return text + f""",
hits AS (SELECT x.p, x.part, c.sig FROM samples x, c5 c, w WHERE {near} <= 225e-2),
ps AS (SELECT list_sort(list(p) FILTER (WHERE part = 'inside')) AS l, count(*) FILTER (WHERE part = 'inside') AS n, count(*) FILTER (WHERE part = 'field') AS f, max(sig) AS sig FROM hits)
SELECT n AS members, round(1e3 / l[least(n - 1, n // 2) + 1], 5) AS distance_pc, round(1e3 / l[least(n - 1, CAST(floor(n * 75e-2) AS BIGINT)) + 1], 5) AS low_pc, round(1e3 / l[least(n - 1, n // 4) + 1], 5) AS high_pc
  FROM ps, sz WHERE n >= 30 AND n / greatest(1e0, f * scale) >= 3 AND sig >= 5"""


@query("find_cluster", with_views("field", cluster_sql()))
def find_cluster(spark, sf):
    c = op.find_cluster(view(spark, sf, "field"), 324.745, 57.514, 0.45)
    return c.select("members", *[F.round(x, 5).alias(x) for x in ("distance_pc", "low_pc", "high_pc")])


NEBULAE = """nebulae AS (SELECT s_suppkey AS target_id, (s_suppkey * 731e-1) % 360e0 AS ra, ((s_suppkey * 37) % 121 - 60) * 1e0 AS "dec", CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE (s_suppkey % 9) * 12e1 END AS diameter FROM supplier)"""


@query("illuminator_distance", with_views("catalogue", NEBULAE + f""", near AS (SELECT t.target_id, c.star_id, c.g, {USABLE} AS p FROM nebulae t JOIN catalogue c ON c.g < 10 AND {sep_sql('c.ra', 'c."dec"', 't.ra', 't."dec"')} <= greatest(1e-1, coalesce(t.diameter / 12e1, 0e0))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY g, star_id) AS rn FROM near WHERE p IS NOT NULL) SELECT target_id, star_id, round(g, 6) AS g, round(1e3 / p, 5) AS distance_pc FROM ranked WHERE rn = 1"""))
def illuminator_distance(spark, sf):
    table(spark, sf, "supplier").createOrReplaceTempView("supplier")
    t = spark.sql("WITH " + NEBULAE.replace('"dec"', "dec") + " SELECT * FROM nebulae")
    return op.illuminators(t, catalogue(spark, sf)).select("target_id", "star_id", F.round("g", 6).alias("g"),
                                                           F.round("distance_pc", 5).alias("distance_pc"))

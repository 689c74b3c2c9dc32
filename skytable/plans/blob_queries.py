"""Bright blobs on mosaics: every hundred embeddings are the 8 by 8 tiles of an image of 80 by 80."""

from __future__ import annotations

from pyspark.sql import functions as F

from skytable.functions.storage import written
from skytable.operators import blobs as op
from skytable.plans.registry import query
from skytable.plans.views import view, with_views

# each tile holds a star whose height and place follow the embedding; its pixels are the noise; light over 1 is clipped
MOSAIC = """
SELECT m.image_id // 100 AS image_id, CAST((m.image_id % 100) // 10 * 8 + y AS BIGINT) AS y, CAST(m.image_id % 10 * 8 + x AS BIGINT) AS x, least(1e0, 6e0 * abs(h.v) * exp(-((x - hx) * (x - hx) + (y - hy) * (y - hy)) / 8e0) + abs(m.v) / 2e0) AS v
FROM pixels m JOIN (SELECT image_id, max(CASE WHEN y = 0 AND x = 0 THEN v END) AS v, CAST(max(CASE WHEN y = 0 AND x = 1 THEN floor(abs(v) * 1e4) END) AS BIGINT) % 8 AS hx,
  CAST(max(CASE WHEN y = 0 AND x = 2 THEN floor(abs(v) * 1e4) END) AS BIGINT) % 8 AS hy FROM pixels GROUP BY image_id) h ON m.image_id = h.image_id"""
QUANTILE = 0.85


def mosaic(spark, sf):
    view(spark, sf, "pixels").createOrReplaceTempView("pixels")
    return written(spark.sql(MOSAIC.replace("m.image_id // 100", "m.image_id div 100").replace("// 10 *", "div 10 *")), "mosaic")


def blob_sql() -> str:
    """Flood fills by recursive CTEs, one for each depth."""
    out = [f"""mosaic AS MATERIALIZED ({MOSAIC}), hist AS (SELECT image_id, greatest(0, least(1023, CAST(floor(v * 1024) AS INTEGER))) AS bin, count(*) AS c FROM mosaic GROUP BY ALL),
down AS (SELECT image_id, bin, sum(c) OVER (PARTITION BY image_id ORDER BY bin DESC) AS o, sum(c) OVER (PARTITION BY image_id) AS n FROM hist),
lim AS (SELECT image_id, greatest(3e-1, least(9e-1, max(bin) / 1024e0)) AS t FROM down WHERE o >= n * (1e0 - 85e-2) GROUP BY image_id),
w0 AS MATERIALIZED (SELECT m.image_id, 0 AS part, y, x, v, t FROM mosaic m JOIN lim l ON m.image_id = l.image_id WHERE v >= t)"""]
    for d in range(7):
        out.append(f"""r{d}(image_id, part, y, x, num) AS (SELECT image_id, part, y, x, y * 2147483648 + x FROM w{d}
  UNION SELECT w.image_id, w.part, w.y, w.x, r.num FROM r{d} r JOIN w{d} w ON w.image_id = r.image_id AND w.part = r.part AND abs(w.y - r.y) + abs(w.x - r.x) = 1),
p{d} AS MATERIALIZED (SELECT w.*, label FROM w{d} w JOIN (SELECT image_id, part, y, x, min(num) AS label FROM r{d} GROUP BY ALL) l ON w.image_id = l.image_id AND w.part = l.part AND w.y = l.y AND w.x = l.x),
b{d} AS MATERIALIZED (SELECT image_id, part, label, count(*) AS n, max(v) AS peak, first(t) AS t, greatest(max(x) - min(x), max(y) - min(y)) + 1 AS size FROM p{d} GROUP BY ALL HAVING count(*) >= 4),
w{d + 1} AS MATERIALIZED (SELECT p.image_id, p.label AS part, y, x, v, b.t + (b.peak - b.t) / 2e0 AS t FROM p{d} p JOIN b{d} b ON p.image_id = b.image_id AND p.part = b.part AND p.label = b.label
  WHERE NOT (n / (1e0 * size * size) >= 4e-1 AND size <= 100) AND peak - b.t > 1e-2 AND v >= b.t + (b.peak - b.t) / 2e0),
s{d} AS (SELECT b.image_id, n, peak, {d} AS depth, CASE WHEN sum(greatest(v - (b.t + peak) / 2e0, 0)) > 0 THEN sum(greatest(v - (b.t + peak) / 2e0, 0) * x) / sum(greatest(v - (b.t + peak) / 2e0, 0))
    ELSE avg(x) FILTER (v >= peak) END AS x, CASE WHEN sum(greatest(v - (b.t + peak) / 2e0, 0)) > 0 THEN sum(greatest(v - (b.t + peak) / 2e0, 0) * y) / sum(greatest(v - (b.t + peak) / 2e0, 0))
    ELSE avg(y) FILTER (v >= peak) END AS y FROM p{d} p JOIN b{d} b ON p.image_id = b.image_id AND p.part = b.part AND p.label = b.label
  WHERE n / (1e0 * size * size) >= 4e-1 AND size <= 100 GROUP BY b.image_id, b.part, b.label, n, peak)""")
    out.append("stars AS (" + " UNION ALL ".join(f"SELECT * FROM s{d}" for d in range(7)) + ")")
    return "RECURSIVE " + ",\n".join(out)


@query("bright_blobs", with_views("pixels", blob_sql() + " SELECT image_id, round(x, 6) AS x, round(y, 6) AS y, n, round(peak, 9) AS peak, CAST(depth AS INTEGER) AS depth FROM stars"))
def bright_blobs(spark, sf):
    b = op.bright_blobs(mosaic(spark, sf), quantile=QUANTILE, tile=16)
    return b.withColumns({"x": F.round("x", 6), "y": F.round("y", 6), "peak": F.round("peak", 9)})


# detections of the search: the brightest pixel of every tile
@query("search_stars", with_views("pixels", blob_sql() + """, d AS (SELECT image_id, y // 8 AS ty, x // 8 AS tx, arg_max(x, (v, -y, -x)) AS x, arg_max(y, (v, -y, -x)) AS y, max(v) AS flux FROM mosaic GROUP BY ALL),
top AS (SELECT image_id, max(flux) AS top FROM d GROUP BY image_id), lead AS (SELECT s.image_id, s.x, s.y, top * (2 + n) AS flux FROM stars s JOIN top ON s.image_id = top.image_id),
kept AS (SELECT d.image_id, CAST(d.x AS DOUBLE) AS x, CAST(d.y AS DOUBLE) AS y, d.flux FROM d WHERE NOT EXISTS (SELECT 1 FROM stars s WHERE s.image_id = d.image_id AND sqrt((s.x - d.x) * (s.x - d.x) + (s.y - d.y) * (s.y - d.y)) < 5))
SELECT image_id, round(x, 6) AS x, round(y, 6) AS y, round(flux, 6) AS flux FROM (SELECT * FROM lead UNION ALL SELECT * FROM kept)"""))
def search_stars(spark, sf):
    m = mosaic(spark, sf)
    peak = F.max(F.struct("v", (-F.col("y")).alias("y"), (-F.col("x")).alias("x"))).alias("p")
    d = m.groupBy("image_id", F.floor(F.col("y") / 8).alias("ty"), F.floor(F.col("x") / 8).alias("tx")).agg(peak).select(
        "image_id", (-F.col("p.x")).cast("double").alias("x"), (-F.col("p.y")).cast("double").alias("y"), F.col("p.v").alias("flux"))
    s = op.search_stars(d, op.bright_blobs(m, quantile=QUANTILE, tile=16))
    return s.withColumns({c: F.round(c, 6) for c in ("x", "y", "flux")})

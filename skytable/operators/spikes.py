"""Diffraction spikes: their directions, width and falloff in an image, and each star's share of them.

Light is read at polar places about a star by bilinear weights, which count what lies beyond the image.
Stars meet the tiles of pixels that they reach; the places are made from a star within a tile, and only
their sums move, so a whole profile is one grouping by tile and one sum, for all stars and all images at
once; nothing is read star by star. Profiles themselves are short (360 angles, 33 steps across, SPIKE_MAX radii) at any image size.

Stars have ``image_id``, ``star``, ``x``, ``y``, ``flux`` and ``half``, the half width of their core.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from skytable.functions.storage import checkpointed
from skytable.operators.pixels import FWHM_PER_SIGMA, KEY
from skytable.operators.rounds import ordered_suppression

# Fixed values of the spike rules.
SPIKE_STARS = 12
SPIKE_LEVER = 100
SPIKE_MAX = 600
SPIKE_SIDE = 3.0
SPIKE_SIGMA = 1.0
SPIKE_WINDOW = 8
SPIKE_FIT = 20
PROFILE_STEPS = 20
NARROWEST, WIDEST = 0.5, 4.0
PARALLEL = 2.0
LEAST_FLUX = 1e-6

CELL = 32
TILE = 128
AXES = ("angle", "step", "offset")


def _sizes(px: DataFrame, size: tuple[int, int] | None = None) -> DataFrame:
    """Width and height of every image: ``size`` where it is known, else as far as there are pixels."""
    if size:
        return px.select(*KEY).distinct().withColumns({"__w": F.lit(size[0]).cast("long"), "__h": F.lit(size[1]).cast("long")})
    return px.groupBy(*KEY).agg((F.max("x") + 1).cast("long").alias("__w"), (F.max("y") + 1).cast("long").alias("__h"))


def _tile_sums(pixels: pa.Table, stars: pa.Table, keys: list[str], kept: tuple[str, ...], schema: pa.Schema) -> pa.Table:
    """Light of all places of some stars within one tile, summed over the axes that are not ``kept``."""
    if not pixels.num_rows or not stars.num_rows:
        return schema.empty_table()
    first, n = {c: pixels.column(c)[0].as_py() for c in ("tx", "ty", "w", "h")}, TILE + 1
    v = pixels.column("v").drop_null()
    at = np.asarray(pixels.column("at").filter(pixels.column("v").is_valid()))
    there, light = np.zeros(n * n, dtype=bool), np.zeros(n * n)
    there[at], light[at] = True, np.asarray(v)
    out: dict[str, list] = {c: [] for c in schema.names}
    dropped = tuple(i for i, a in enumerate(AXES) if a not in kept)
    for star in stars.to_pylist():
        angle, r, o, f = (np.array(star[c], dtype=np.float64) for c in ("angles", "steps", "offsets", "factors"))
        c, s = np.cos(np.radians(angle))[:, None, None], np.sin(np.radians(angle))[:, None, None]
        px, py = star["x"] + r[None, :, None] * c - o * s, star["y"] + r[None, :, None] * s + o * c
        x, y = np.floor(px).astype(np.int64), np.floor(py).astype(np.int64)
        mine = (x >= -1) & (x < first["w"]) & (np.maximum(x, 0) // TILE == first["tx"]) & (y >= -1) & (y < first["h"]) & (np.maximum(y, 0) // TILE == first["ty"])
        places = np.nonzero(mine)
        x, y = x[places], y[places]
        fx, fy = px[places] - x, py[places] - y
        total, sums, met = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x), dtype=bool)
        for i, wx in ((0, 1 - fx), (1, fx)):
            for j, wy in ((0, 1 - fy), (1, fy)):
                w = np.where((x + i >= 0) & (y + j >= 0) & (x + i < first["w"]) & (y + j < first["h"]), wx * wy, 0.0)
                pixel = np.where(w > 0, (y + j - first["ty"] * TILE) * n + x + i - first["tx"] * TILE, 0)
                seen = (w > 0) & there[pixel]
                total, met = total + w, met | seen
                sums += np.where(seen, w * np.where(seen, light[pixel], 0.0), 0.0)
        share, found = np.zeros(mine.shape), np.zeros(mine.shape, dtype=bool)
        share[places] = np.where(met, star["k"] * f[places[2]] * sums / np.where(total > 0, total, 1.0), 0.0)
        found[places] = met
        share, found = share.sum(axis=dropped), found.any(axis=dropped)
        cells = np.nonzero(found)
        for c in keys:
            out[c] += [star[c]] * len(cells[0])
        for c, at_axis in zip(kept, cells, strict=True):
            out[c] += at_axis.tolist()
        out["light"] += share[cells].tolist()
    return pa.table(out, schema=schema)


def light_at(px: DataFrame, stars: DataFrame, angles: Column, steps: Column, offsets: Column, factors: Column, kept: tuple[str, ...], keys: list[str], value: str = "v", size: tuple[int, int] | None = None) -> DataFrame:
    """Sum of ``k`` times the bilinear value at places about ``stars`` (rows with ``x``, ``y`` and ``k``), by ``keys`` and the ``kept`` axes: ``light``.

    The places are those along ``angles`` in degrees at the distances ``steps`` and ``offsets`` across, an array each; what lies
    at an offset counts by its of ``factors``. A kept axis (``angle``, ``step``, ``offset``) is a column with the place in its array.
    Corners beyond the image are left out and the others weigh more; corners within it that have no pixel weigh as dark ones,
    so an image that is not filled needs its ``size`` (width and height). A place without corners adds 0. Groups of places that
    meet no pixel give no row. Stars meet the tiles they reach, each with the first column and line of the next tiles, so that
    a place has all its corners in one; places are made there, as they are many more than stars, and only their sums move.
    """
    def tile_of(at: Column) -> Column:
        n = F.floor(at / TILE).cast("int")
        return F.explode(F.when((at % TILE == 0) & (at > 0), F.array(n - 1, n)).otherwise(F.array(n)))
    rows = px.select(*KEY, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col(value).cast("double").alias("v")).filter("x >= 0 AND y >= 0")
    rows = rows.join(_sizes(px, size).withColumnsRenamed({"__w": "w", "__h": "h"}), KEY)
    rows = rows.select("*", tile_of(F.col("y")).alias("ty")).select("*", tile_of(F.col("x")).alias("tx"))
    tiles = rows.select(*KEY, "ty", "tx", ((F.col("y") - F.col("ty") * TILE) * (TILE + 1) + F.col("x") - F.col("tx") * TILE).cast("int").alias("at"), "v", "w", "h")
    shape = {"angles": angles, "steps": steps, "offsets": offsets, "factors": factors}
    asked = stars.withColumns({c: a.cast("array<double>") for c, a in shape.items()})
    reach = F.array_max("steps") + F.array_max(F.transform("offsets", F.abs)) + 1

    def span(c: str) -> Column:
        return F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - reach) / TILE)).cast("int"), F.floor(F.least(F.col(c) + reach, F.col("__w" if c == "x" else "__h") - 1) / TILE).cast("int")))
    inside = (F.col("x") + reach >= 0) & (F.col("y") + reach >= 0) & (F.col("x") - reach < F.col("__w")) & (F.col("y") - reach < F.col("__h"))
    names = list(dict.fromkeys([*KEY, *keys, "x", "y", "k", *shape]))
    near = asked.select(names).join(_sizes(px, size), KEY).filter(inside).select(*names, span("x").alias("tx"), "__h").select(*names, "tx", span("y").alias("ty"))
    fields = [near.schema[c] for c in keys] + [StructField(c, IntegerType()) for c in kept] + [StructField("light", DoubleType())]
    schema = to_arrow_schema(StructType(fields))
    site = [*KEY, "ty", "tx"]
    sums = tiles.groupBy(*site).cogroup(near.groupBy(*site)).applyInArrow(lambda a, b: _tile_sums(a, b, keys, kept, schema), StructType(fields))
    return sums.groupBy(*keys, *kept).agg(F.sum("light").alias("light"))


def _from(first: Column, n: int) -> Column:
    """``n`` distances from ``first`` on, one pixel apart."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: first + i)


def _sides(side: Column) -> tuple[Column, Column]:
    """Offsets and factors whose sum is the light on a ray above the mean of both its sides."""
    return F.array(F.lit(0.0), side, -side), F.array(*[F.lit(f) for f in (1.0, -0.5, -0.5)])


def top_stars(stars: DataFrame, n: int = SPIKE_STARS) -> DataFrame:
    """The brightest stars of every image, with ``k``, by which their light is weighed."""
    rank = Window.partitionBy(*KEY).orderBy(F.col("flux").desc(), "star")
    top = stars.withColumn("__rank", F.row_number().over(rank)).filter(F.col("__rank") <= n).drop("__rank")
    return checkpointed(top.withColumn("k", 1.0 / F.greatest(F.lit(LEAST_FLUX), F.col("flux"))))


def angular_profile(px: DataFrame, top: DataFrame, fwhm: float, value: str = "v", size: tuple[int, int] | None = None) -> DataFrame:
    """Light by whole degree about the top stars, next to their cores: ``profile``, an array of 360, per image."""
    sums = light_at(px, top, F.sequence(F.lit(0), F.lit(359)), _from(F.col("half") + fwhm + 2, PROFILE_STEPS), *_sides(F.lit(SPIKE_SIDE)), ("angle",), KEY, value, size)
    sums = sums.withColumnRenamed("angle", "degree").groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("degree", "light"))).alias("__m"))
    return sums.select(*KEY, F.expr("transform(sequence(0, 359), d -> coalesce(element_at(__m, d), 0D))").alias("profile"))


def spike_peaks(profiles: DataFrame) -> DataFrame:
    """Degrees of a circular profile that are spikes: ``degree``, one row each.

    A spike stands out of the noise and of a tenth of the highest, none of its three neighbours on either side is
    higher, and there is another one opposite, within two degrees.
    """
    rows = profiles.withColumn("__mid", F.array_sort("profile")[180])
    rows = rows.withColumn("__dev", F.array_sort(F.expr("transform(profile, v -> abs(v - __mid))"))[180])
    noise = F.when(F.col("__dev") == 0, F.lit(1 / 1.4826)).otherwise(F.col("__dev"))
    rows = rows.withColumn("__least", F.greatest(6 * noise, 0.1 * F.array_max("profile")))
    peaks = F.expr("filter(sequence(0, 359), a -> profile[a] > __least and forall(array(-3, -2, -1, 1, 2, 3), d -> profile[pmod(a + d, 360)] <= profile[a]))")
    rows = rows.withColumn("__peaks", peaks)
    facing = F.expr(f"filter(__peaks, a -> exists(__peaks, b -> abs(pmod(b - a + 540, 360) - 180) >= {180 - int(PARALLEL)}))")
    return rows.select(*KEY, F.explode(facing).alias("degree"))


def spike_directions(px: DataFrame, stars: DataFrame, fwhm: float, value: str = "v", size: tuple[int, int] | None = None) -> DataFrame:
    """Directions of every image's spikes: ``degree`` (whole) and ``angle`` in degrees, refined to a twentieth.

    An image without spikes, or without stars, gives no rows.
    """
    top = top_stars(stars)
    peaks = checkpointed(spike_peaks(angular_profile(px, top, fwhm, value, size)))
    turn = F.col("degree") - 1 + F.col("turn") * 0.05
    turns = F.transform(F.sequence(F.lit(0), F.lit(40)), lambda t: F.col("degree") - 1 + t * 0.05)
    sums = light_at(px, top.join(peaks, KEY), turns, _from(F.col("half") + fwhm + 2, SPIKE_LEVER - 2), *_sides(F.lit(SPIKE_SIDE)), ("angle",), [*KEY, "degree"], value, size)
    sums = sums.withColumnRenamed("angle", "turn")
    best = sums.groupBy(*KEY, "degree").agg(F.max_by("turn", F.struct("light", -F.col("turn"))).alias("turn"))
    return best.select(*KEY, "degree", turn.alias("angle"))


def lateral_sigma(profile: str, step: float) -> Column:
    """Gaussian width of a peak in the middle of an array, by its half height above its outer two pixels; null for none."""
    edge = max(1, round(2 / step))
    return F.expr(f"""CASE WHEN size({profile}) > 0 THEN
      aggregate(array(1), cast(null as double), (z, i) -> z, z -> (
        aggregate(array(transform({profile}, v -> v - (aggregate(slice({profile}, 1, {edge}), 0D, (s, w) -> s + w) + aggregate(slice({profile}, -{edge}, {edge}), 0D, (s, w) -> s + w)) / {2 * edge})),
          cast(null as double), (y, q) -> CASE WHEN array_max(q) > 1e-9 THEN (
            {_half("q", -1, step)} + {_half("q", 1, step)}) / {FWHM_PER_SIGMA:.4f} END))) END""")


def _half(q: str, way: int, step: float) -> str:
    """SQL for the distance from the middle at which array ``q`` falls under half of its peak."""
    mid = f"(size({q}) - 1) / 2"
    places = f"sequence(cast({mid} as int), {'size(' + q + ') - 2' if way > 0 else '1'}, {way})"
    first = f"filter({places}, k -> {q}[k + {way}] < array_max({q}) / 2)[0]"
    inside = f"transform(array({first}), k -> (abs(k - {mid}) + ({q}[k] - array_max({q}) / 2) / ({q}[k] - {q}[k + {way}])) * {step}D)[0]"
    return f"coalesce({inside}, {mid} * {step}D)"


def spike_width(px: DataFrame, stars: DataFrame, directions: DataFrame, fwhm: float, value: str = "v", size: tuple[int, int] | None = None) -> DataFrame:
    """``sigma`` of every image's spikes, within fixed limits; SPIKE_SIGMA where there is no spike or no peak across it."""
    rows = top_stars(stars).join(directions.select(*KEY, "angle"), KEY)
    across = F.sequence(F.lit(0), F.lit(32))
    sums = light_at(px, rows, F.array("angle"), _from(F.col("half") + fwhm + 2, SPIKE_LEVER - 2), F.transform(across, lambda i: i * 0.5 - 8), F.transform(across, lambda i: F.lit(1.0)), ("offset",), KEY, value, size)
    sums = sums.withColumnRenamed("offset", "across").groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("across", "light"))).alias("__m"))
    sums = sums.withColumn("__p", F.expr("transform(sequence(0, 32), d -> coalesce(element_at(__m, d), 0D))")).withColumn("__s", lateral_sigma("__p", 0.5))
    sigma = F.when(F.coalesce("__s", F.lit(0.0)) == 0, F.lit(SPIKE_SIGMA)).otherwise(F.greatest(F.lit(NARROWEST), F.least(F.lit(WIDEST), F.col("__s"))))
    return stars.select(*KEY).distinct().join(sums, KEY, "left").select(*KEY, sigma.alias("sigma"))


def side_of(sigma: Column) -> Column:
    return F.greatest(F.lit(SPIKE_SIDE), 3 * sigma)


def spike_falloff(px: DataFrame, stars: DataFrame, directions: DataFrame, width: DataFrame, fwhm: float, value: str = "v", size: tuple[int, int] | None = None) -> DataFrame:
    """Spike light per flux by distance: ``r`` 0 .. SPIKE_MAX - 1 and ``t``, smoothed, never rising outward."""
    rows = top_stars(stars).join(directions.select(*KEY, "angle"), KEY).join(width, KEY).withColumn("start", F.floor(F.ceil("half") + fwhm + 2).cast("int"))
    rows = checkpointed(rows.filter(F.col("start") < SPIKE_MAX))
    starts = rows.groupBy(*KEY, "start").agg(F.count("*").alias("__n"))
    sums = light_at(px, rows, F.array("angle"), F.sequence("start", F.lit(SPIKE_MAX - 1)), *_sides(side_of(F.col("sigma"))), ("step",), [*KEY, "start"], value, size)
    sums = sums.groupBy(*KEY, (F.col("start") + F.col("step")).alias("r")).agg(F.sum("light").alias("light"))
    radii = starts.groupBy(*KEY).agg(F.min("start").alias("__first")).withColumn("r", F.explode(F.sequence("__first", F.lit(SPIKE_MAX - 1))))
    up_to = Window.partitionBy(*KEY).orderBy("r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = Window.partitionBy(*KEY).orderBy("r").rowsBetween(-SPIKE_WINDOW, SPIKE_WINDOW)
    rows = radii.join(starts.withColumnRenamed("start", "r"), [*KEY, "r"], "left").join(sums, [*KEY, "r"], "left")
    rows = rows.withColumn("__n", F.sum(F.coalesce("__n", F.lit(0))).over(up_to)).withColumn("t", F.coalesce("light", F.lit(0.0)) / F.col("__n"))
    rows = rows.withColumn("t", F.greatest(F.lit(0.0), F.avg("t").over(near)))
    rows = rows.withColumn("t", F.min("t").over(up_to))
    held = rows.filter("r = __first").withColumn("r", F.explode(F.sequence(F.lit(0), F.col("__first"))))
    return rows.filter("r > __first").select(*KEY, "r", "t").unionByName(held.select(*KEY, "r", "t"))


def fit_spikes(px: DataFrame, stars: DataFrame, directions: DataFrame, width: DataFrame, falloff: DataFrame, noise: DataFrame, fwhm: float, value: str = "v", size: tuple[int, int] | None = None) -> DataFrame:
    """Every star's spikes: ``star``, ``angle``, ``start``, ``scale``, ``reach``.

    ``scale`` is the upper median of a star's light over the falloff next to its core, so light of a neighbour on the ray
    does not count; it must stand out of the scatter of those ratios. The spike reaches as far as it stands out of the
    noise of its mean over a window. A spike and the one opposite take the stronger fit of the two.
    """
    start = (F.ceil("half") + fwhm).cast("double")
    rows = stars.join(directions.select(*KEY, "angle"), KEY).join(width, KEY).withColumn("start", start).withColumn("k", F.lit(1.0))
    step = rows.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(SPIKE_FIT - 1))))
    light = light_at(px, rows, F.array("angle"), _from(F.col("start"), SPIKE_FIT), *_sides(side_of(F.col("sigma"))), ("step",), [*KEY, "star", "angle"], value, size)
    curve = falloff.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("r", "t"))).alias("__t")).select(*KEY, F.col("__t.t").alias("__t"))
    fits = step.select(*KEY, "star", "angle", "start", "step").join(light, [*KEY, "star", "angle", "step"], "left").join(curve, KEY)
    t = F.expr(f"CASE WHEN int(start) + step < {SPIKE_MAX} THEN __t[int(start) + step] END")
    fits = fits.withColumn("__ratio", F.when(t > 0, F.coalesce("light", F.lit(0.0)) / t))
    fits = fits.groupBy(*KEY, "star", "angle", "start").agg(F.array_sort(F.collect_list("__ratio")).alias("__q")).filter(F.size("__q") > 0)
    fits = fits.withColumn("scale", F.expr("__q[size(__q) div 2]")).withColumn("__dev", F.expr("array_sort(transform(__q, v -> abs(v - scale)))[size(__q) div 2]"))
    spread = F.when(F.col("__dev") == 0, F.lit(1.0)).otherwise(1.4826 * F.col("__dev"))
    fits = fits.withColumn("__own", F.col("scale") > 3 * 1.2533 * spread / F.sqrt(F.size("__q")))
    level = 3 * 1.2247 / math.sqrt(2 * SPIKE_WINDOW + 1)
    fits = fits.join(noise.select(*KEY, "noise"), KEY).join(curve, KEY)
    count = F.expr(f"size(filter(slice(__t, int(start) + 1, {SPIKE_MAX}), t -> scale * t > {level}D * noise))")
    fits = checkpointed(fits.withColumn("__reach", F.when(F.col("__own") & (F.col("start") < SPIKE_MAX), count).otherwise(0) - 1).select(*KEY, "star", "angle", "start", "scale", "__reach"))
    other = fits.select(*KEY, "star", F.col("angle").alias("__b"), F.struct("scale", "__reach").alias("__other"))
    apart = F.abs(F.abs(F.col("__b") - F.col("angle")) - 180) < PARALLEL
    facing = fits.join(other, [*KEY, "star"]).filter(apart).groupBy(*KEY, "star", "angle").agg(F.min_by("__other", "__b").alias("__other"))
    both = fits.join(facing, [*KEY, "star", "angle"], "left")
    stronger = F.coalesce(F.col("__other.scale") > F.col("scale"), F.lit(False))
    both = both.withColumns({"scale": F.when(stronger, F.col("__other.scale")).otherwise(F.col("scale")), "__reach": F.when(stronger, F.col("__other.__reach")).otherwise(F.col("__reach"))})
    return both.filter("__reach > 0").select(*KEY, "star", "angle", "start", "scale", (F.col("start") + F.col("__reach")).alias("reach"))


def own_spikes(spikes: DataFrame, stars: DataFrame, width: DataFrame) -> DataFrame:
    """Spikes without those that a star borrows: it lies on a brighter star's spike that runs the same way.

    Stars are settled from the brightest on: a spike that was dropped takes no other spike along. A spike is spread over
    the cells it runs through, a star lies in one, so only stars near a ray meet it.
    """
    place = stars.select(*KEY, "star", "x", "y", "flux")
    node = F.struct(*KEY, "star", "angle")
    rays = spikes.join(place, [*KEY, "star"]).join(width, KEY).withColumns({"earlier": node, "half": F.greatest(F.lit(2.0), 3 * F.col("sigma"))})
    along = F.sequence(F.floor("start").cast("int"), F.ceil("reach").cast("int") + 8, F.lit(8))
    cells = rays.withColumn("__r", F.explode(along)).withColumn("__o", F.explode(F.array(-F.col("half"), F.lit(0.0), F.col("half"))))
    c, s = F.cos(F.radians("angle")), F.sin(F.radians("angle"))
    # the steps are 8 pixels long: what lies between two of them is in the cell of one, or in the next cell
    for name, at in (("__cx", F.col("x") + F.col("__r") * c - F.col("__o") * s), ("__cy", F.col("y") + F.col("__r") * s + F.col("__o") * c)):
        cells = cells.withColumn(name, F.explode(F.array_distinct(F.array(F.floor((at - 8) / CELL), F.floor(at / CELL), F.floor((at + 8) / CELL)))))
    cells = cells.select(*KEY, "__cx", "__cy", "earlier", F.col("angle").alias("__a"), F.col("x").alias("__x"), F.col("y").alias("__y"), F.col("flux").alias("__f"),
                         F.col("start").alias("__s"), F.col("reach").alias("__e"), "half").distinct()
    met = cells.join(place.withColumns({"__cx": F.floor(F.col("x") / CELL), "__cy": F.floor(F.col("y") / CELL)}), [*KEY, "__cx", "__cy"]).filter("__f > flux")
    dx, dy, c, s = F.col("x") - F.col("__x"), F.col("y") - F.col("__y"), F.cos(F.radians("__a")), F.sin(F.radians("__a"))
    met = met.filter((dx * c + dy * s).between(F.col("__s"), F.col("__e")) & (F.abs(dy * c - dx * s) <= F.col("half")))
    turned = F.pmod(F.abs(F.col("angle") - F.col("__a")), F.lit(180.0))
    later = spikes.select(*KEY, "star", "angle")
    edges = met.select(*KEY, "star", "__a", "earlier").join(later, [*KEY, "star"]).filter(F.least(turned, 180 - turned) < PARALLEL).select("earlier", node.alias("later")).distinct()
    kept = ordered_suppression(spikes.select(node.alias("node")), edges, "node")
    return spikes.withColumn("node", node).join(kept, "node", "left_semi").drop("node")

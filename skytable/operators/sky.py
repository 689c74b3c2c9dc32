"""Star catalogues: cones, placing, cross-matching, clusters and distances.

A catalogue row has ``star_id``, ``ra``, ``dec`` in degrees, ``plx`` in mas,
``pmra`` and ``pmdec`` in mas per year and the magnitude ``g``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skytable.functions.ordered import medians, null_safe_join, order_elements, robust_spread, upper_medians
from skytable.functions.sky import equal_area_cell, separation, tan_project, unit_vector, vector_angles, with_cells_near
from skytable.functions.storage import checkpointed, multiplied
from skytable.operators.frames import finite
from skytable.operators.rounds import one_to_one, one_to_one_of_classes, ordered_suppression

# Fixed values of the catalogue rules.
PARALLAX_ZERO_POINT = 0.017
SIGMA_KNOTS = ((15.0, 0.02), (17.0, 0.07), (17.6, 0.10))
ILLUMINATOR_MAX_G = 10.0
ILLUMINATOR_MIN_RADIUS = 0.1
CLUSTER_MIN_MEMBERS = 30
CLUSTER_MIN_CONTRAST = 3.0
CLUSTER_MIN_SIGNIFICANCE = 5.0
CLUSTER_MAX_RADIUS = 0.45
CLUSTER_PM_SCALE = 0.3
CLUSTER_PLX_SCALE = 3.0
CLUSTER_GROW = 1.5
CLUSTER_MAX_G = 16.0
MATCH_RADIUS = 1.5
MATCH_CORE_SHARE = 0.45
MATCH_CELL = 16
BLEND_COMPANION_MAG = 0.3
BRIGHT_G = 9.5
BRIGHT_MISS_RADIUS = 6.0
REACH_CELL = 150
SPIKE_WIDTH = 3.0
RESIDUAL_BAD_PX = 3.0
RESIDUAL_POOR_PX = 0.315
RESIDUAL_TOLERANCE_PX = 3.0
RESIDUAL_CLIP = 5.0
SIP_STEP = 0.5
SIP_REACH = 2.0
RESIDUAL_SIGMA_FLOOR_PX = 0.01
RESIDUAL_MIN_KEPT = 5
STARS_PER_CELL = 5
CONE_G_SLACK = 0.05


# --- columns ---------------------------------------------------------------------------

def parallax_sigma(g: Column) -> Column:
    """Typical parallax error at a magnitude; a missing magnitude takes the first value."""
    (g0, s0), (g1, s1), (g2, s2) = SIGMA_KNOTS
    x = F.when(F.isnan(g), None).otherwise(g)
    return (F.when(x.isNull() | (x <= g0), s0).when(x <= g1, s0 + (x - g0) * (s1 - s0) / (g1 - g0))
            .when(x <= g2, s1 + (x - g1) * (s2 - s1) / (g2 - g1)).otherwise(s2))


def usable_parallax(plx: Column, g: Column) -> Column:
    """Parallax with the zero point added, where positive and at least five times its error."""
    p = plx + PARALLAX_ZERO_POINT
    return F.when(finite(plx) & (p > 0) & (p >= 5 * parallax_sigma(g)), p)


def residual_verdict(median_px: Column) -> Column:
    return (F.when(~finite(median_px) | (median_px < 0), "unknown").when(median_px >= RESIDUAL_BAD_PX, "bad")
            .when(median_px > RESIDUAL_POOR_PX, "poor").otherwise("ok"))


# --- cones -----------------------------------------------------------------------------

def cone_filter(df: DataFrame, ra: float, dec: float, radius: float, g_max: float) -> DataFrame:
    """Stars within ``radius`` of a direction and brighter than ``g_max``.

    The band in dec is a plain comparison, so it reaches the scan.
    """
    near = F.col("dec").between(dec - radius - 1e-9, dec + radius + 1e-9)
    return df.filter(near & finite(F.col("ra")) & finite(F.col("dec")) & (F.col("g") < g_max) & ~F.isnan("g")
                     & (separation("ra", "dec", ra, dec) <= radius))


def cone_join(cones: DataFrame, stars: DataFrame, size: float = 2.0) -> DataFrame:
    """Stars of many cones (``cone_id``, ``cone_ra``, ``cone_dec``, ``radius``, ``g_max``) with their separation.

    Cones are spread over the sky cells they may touch and meet the stars by cell.
    """
    asked = with_cells_near(cones, "cone_ra", "cone_dec", F.col("radius"), size)
    placed = stars.filter(finite(F.col("ra")) & finite(F.col("dec")) & ~F.isnan("g")).withColumn(
        "cell", equal_area_cell("ra", "dec", size))
    return (placed.join(asked, "cell").filter(F.col("g") < F.col("g_max"))
            .withColumn("sep", separation("ra", "dec", "cone_ra", "cone_dec"))
            .filter(F.col("sep") <= F.col("radius")).drop("cell"))


def covering_cones(asked: DataFrame, stored: DataFrame, size: float = 2.0) -> DataFrame:
    """For each asked cone the smallest stored cone (``path``, ``ra``, ``dec``, ``r``, ``g``) that covers it.

    A stored cone covers when the asked one lies inside it and its limit reaches g_max, less a slack.
    """
    files = with_cells_near(stored.withColumnsRenamed({"ra": "file_ra", "dec": "file_dec", "g": "file_g"}),
                            "file_ra", "file_dec", F.col("r"), size)
    placed = asked.withColumn("cell", equal_area_cell("cone_ra", "cone_dec", size))
    apart = separation("cone_ra", "cone_dec", "file_ra", "file_dec")
    return (placed.join(files, "cell")
            .filter((apart + F.col("radius") <= F.col("r") + 1e-9) & (F.col("file_g") >= F.col("g_max") - CONE_G_SLACK))
            .groupBy("cone_id").agg(F.min(F.struct("r", "path")).alias("best"))
            .select("cone_id", F.col("best.path").alias("path"), F.col("best.r").alias("r")))


def brightest_per_cell(stars: DataFrame, sizes: Sequence[float], per_cell: int = STARS_PER_CELL,
                       keys: Sequence[str] = ()) -> DataFrame:
    """Stars among the brightest of their cell for any cell size; a position counts once.

    ``keys`` keeps groups of stars apart. The rank filter runs before the shuffle too, so a crowded cell sends
    a few stars per task.
    """
    cells = F.array(*[F.struct(F.lit(float(s)).alias("size"), equal_area_cell("ra", "dec", s).alias("cell")) for s in sizes])
    place = [*keys, "ra", "dec"]
    rest = [c for c in stars.columns if c not in (*place, "g")]
    once = stars.groupBy(*place).agg(F.min(F.struct("g", *rest)).alias("s")).select(*place, "s.*")
    w = Window.partitionBy(*keys, "__cell").orderBy("g", "ra", "dec")
    kept = (once.withColumn("__cell", F.explode(cells)).withColumn("__rank", F.row_number().over(w))
            .filter(F.col("__rank") <= per_cell))
    return kept.drop("__cell", "__rank").distinct().select(*stars.columns)


def merge_tables(df: DataFrame, order: str = "table_order") -> DataFrame:
    """One star per position rounded to 7 decimals; the first table wins."""
    first = F.min(F.struct(order, *[c for c in df.columns if c != order])).alias("s")
    return df.groupBy(F.round("ra", 7).alias("__ra"), F.round("dec", 7).alias("__dec")).agg(first).select("s.*").select(*df.columns)


# --- placing and matching on the image ---------------------------------------------------

def place_stars(stars: DataFrame, solution: Column, width: float, height: float) -> DataFrame:
    """Stars with a usable parallax that land inside the image: ``x``, ``y`` and ``distance_pc``."""
    p = usable_parallax(F.col("plx"), F.col("g"))
    rows = stars.withColumn("__p", p).filter(F.col("__p").isNotNull()).withColumn(
        "__at", tan_project("ra", "dec", solution)).filter(F.col("__at").isNotNull())
    x, y = F.col("__at.x"), F.col("__at.y")
    return (rows.filter((x >= 0) & (x < width) & (y >= 0) & (y < height))
            .withColumns({"x": x, "y": y, "distance_pc": 1000.0 / F.col("__p")}).drop("__p", "__at"))


def with_rect(df: DataFrame) -> DataFrame:
    """Add the core rectangle of a detection from its ``half_width``; the far edges are exclusive."""
    x, y, r = F.col("x"), F.col("y"), F.col("half_width")

    def whole(c: Column) -> Column:
        return F.floor(c).cast("int")
    return df.withColumns({"x0": whole(x - r), "y0": whole(y - r), "x1": whole(x + r) + 1, "y1": whole(y + r) + 1})


def over_cells(df: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> DataFrame:
    """One row per grid cell that the box [x0, x1] by [y0, y1] touches: ``cx``, ``cy``."""
    def cell(c: Column) -> Column:
        return F.floor(c / size).cast("int")
    return multiplied(df.withColumn("cx", F.explode(F.sequence(cell(x0), cell(x1))))
                      .withColumn("cy", F.explode(F.sequence(cell(y0), cell(y1)))))


def at_cell(df: DataFrame, size: float) -> DataFrame:
    return df.withColumns({"cx": F.floor(F.col("x") / size).cast("int"), "cy": F.floor(F.col("y") / size).cast("int")})


def crossmatch(stars: DataFrame, detections: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """Pairs of a placed star and a detection within the detection's match radius: ``star_id``, ``det_id``, ``g``, ``r2``.

    A detection is spread over the cells its match circle touches and a star sits in one cell, so a pair meets once.
    Columns of a detection that are ``carried`` come along, so that pairs need no join of their own.
    """
    d = with_rect(detections).withColumn("radius", F.greatest(
        F.lit(MATCH_RADIUS), MATCH_CORE_SHARE * (F.col("x1") - F.col("x0")) / 2))
    d = d.select("det_id", F.col("x").alias("dx"), F.col("y").alias("dy"), "radius", *carried)
    d = over_cells(d, F.col("dx") - F.col("radius"), F.col("dy") - F.col("radius"), F.col("dx") + F.col("radius"),
                   F.col("dy") + F.col("radius"), MATCH_CELL)
    s = at_cell(stars.select("star_id", "x", "y", "g"), MATCH_CELL)
    r2 = (F.col("dx") - F.col("x")) * (F.col("dx") - F.col("x")) + (F.col("dy") - F.col("y")) * (F.col("dy") - F.col("y"))
    return (s.join(d, ["cx", "cy"]).withColumn("r2", r2).filter(F.col("r2") <= F.col("radius") * F.col("radius"))
            .select("star_id", "det_id", F.coalesce(F.when(~F.isnan("g"), F.col("g")), F.lit(99.0)).alias("g"), "r2", *carried))


def matched(pairs: DataFrame) -> DataFrame:
    """Each star and detection at most once: brightest star first, then nearest."""
    return one_to_one(pairs, "star_id", "det_id", ["g", "r2"])


def matched_places(stars: DataFrame, detections: DataFrame) -> DataFrame:
    """``matched`` of the cross-match of tables that crowd: stars alike in place and brightness, and detections alike in
    place and size, meet once, as the one with the least id.

    An id that has several rows stands in several places, which classes cannot share; such tables are matched pair by pair.
    """
    def repeats(df: DataFrame, id_: str) -> bool:
        return not df.groupBy(id_).count().filter("count > 1").isEmpty()
    if repeats(stars, "star_id") or repeats(detections, "det_id"):
        return matched(crossmatch(stars, detections))

    def classes(df: DataFrame, id_: str, name: str, *like: str) -> tuple[DataFrame, DataFrame]:
        first = checkpointed(df.groupBy(*like).agg(F.min(id_).alias(id_)))
        return first, null_safe_join(df.select(*like, id_), first.withColumnRenamed(id_, name), like).select(name, id_)
    s, lefts = classes(stars, "star_id", "left_class", "x", "y", "g")
    d, rights = classes(detections, "det_id", "right_class", "x", "y", "half_width")
    edges = crossmatch(s, d).withColumnsRenamed({"star_id": "left_class", "det_id": "right_class"})
    return one_to_one_of_classes(checkpointed(edges), lefts, rights, "star_id", "det_id", ["g", "r2"])


def first_of_place(stars: DataFrame, *place: str) -> DataFrame:
    """One row a place with the least ``star_id``: of stars in one place it is the one that is taken as nearest."""
    return stars.groupBy(*place).agg(F.min("star_id").alias("star_id"))


def nearest_residual(stars: DataFrame, detections: DataFrame, tolerance: float = RESIDUAL_TOLERANCE_PX) -> DataFrame:
    """Distance of every detection to its nearest placed star within ``tolerance`` pixels."""
    d = over_cells(detections.select("det_id", F.col("x").alias("dx"), F.col("y").alias("dy")), F.col("dx") - tolerance,
                   F.col("dy") - tolerance, F.col("dx") + tolerance, F.col("dy") + tolerance, MATCH_CELL)
    s = at_cell(first_of_place(stars, "x", "y"), MATCH_CELL)
    off = F.hypot(F.col("dx") - F.col("x"), F.col("dy") - F.col("y"))
    return (s.join(d, ["cx", "cy"]).withColumn("residual", off).filter(F.col("residual") <= tolerance)
            .groupBy("det_id").agg(F.min(F.struct("residual", "star_id")).alias("best"))
            .select("det_id", F.col("best.star_id").alias("star_id"), F.col("best.residual").alias("residual")))


def _polynomial(terms: str, u: str, v: str) -> Column:
    """Sum of c * u**p * v**q over an array of (p, q, c); 0 for null."""
    return F.expr(f"coalesce(aggregate({terms}, 0D, (s, t) -> s + t.c * pow({u}, t.p) * pow({v}, t.q)), 0D)")


def top_down_sip(a: Column, b: Column) -> tuple[Column, Column]:
    """Distortion terms for lines counted from the other end: odd powers of the line change their sign, and so does what moves lines."""
    def turned(terms: Column, sign: int) -> Column:
        return F.transform(terms, lambda t: F.struct(t["p"].alias("p"), t["q"].alias("q"), (F.when(t["q"] % 2 == 0, t["c"]).otherwise(-t["c"]) * sign).alias("c")))
    return turned(a, 1), turned(b, -1)


def undistorted(detections: DataFrame) -> DataFrame:
    """Add ``ux``, ``uy``, the places on the plane of the solution, and ``jacobian`` of the map there (row by row).

    Detections have ``x``, ``y``, the reference pixel ``crpix1``, ``crpix2`` and the forward distortion ``sip_a``, ``sip_b``:
    arrays of (p, q, c), null for none. The Jacobian is taken from differences over half a pixel to either side.
    """
    h = SIP_STEP
    rows = detections.withColumns({"__u": F.col("x") + 1.0 - F.col("crpix1"), "__v": F.col("y") + 1.0 - F.col("crpix2")})

    def moved(du: float, dv: float) -> list[Column]:
        u, v = f"(__u + {du}D)", f"(__v + {dv}D)"
        return [F.expr(u) + _polynomial("sip_a", u, v), F.expr(v) + _polynomial("sip_b", u, v)]
    here, (up, um), (vp, vm) = moved(0.0, 0.0), (moved(h, 0.0), moved(-h, 0.0)), (moved(0.0, h), moved(0.0, -h))
    jacobian = F.array(*[(plus[i] - minus[i]) / (2 * h) for i in (0, 1) for plus, minus in ((up, um), (vp, vm))])
    return rows.withColumns({"ux": here[0] + F.col("crpix1") - 1.0, "uy": here[1] + F.col("crpix2") - 1.0, "jacobian": jacobian}).drop("__u", "__v")


def distorted_residual(stars: DataFrame, detections: DataFrame, tolerance: float = RESIDUAL_TOLERANCE_PX, key: str = "image_id") -> DataFrame:
    """Distance in pixels of the image from every detection to the star that is nearest on the plane of its solution.

    Both sides have ``key``; stars are placed by the solution without distortion (``star_id``, ``x``, ``y``), detections are as
    ``undistorted`` takes them. The distance on the plane is taken back to the image by the inverse of the local Jacobian,
    and is kept up to ``tolerance``. Stars are looked for within SIP_REACH times the tolerance, which is enough while the
    distortion does not stretch the plane by more than that. Without distortion this is ``nearest_residual``.
    """
    reach = SIP_REACH * tolerance
    d = undistorted(detections)
    d = over_cells(d.select(key, "det_id", "ux", "uy", "jacobian"), F.col("ux") - reach, F.col("uy") - reach, F.col("ux") + reach, F.col("uy") + reach, MATCH_CELL)
    s = at_cell(first_of_place(stars, key, "x", "y"), MATCH_CELL)
    dx, dy, j = F.col("ux") - F.col("x"), F.col("uy") - F.col("y"), F.col("jacobian")
    near = s.join(d, [key, "cx", "cy"]).withColumn("__off", F.hypot(dx, dy)).filter(F.col("__off") <= reach)
    det = j[0] * j[3] - j[1] * j[2]
    back = F.hypot((j[3] * dx - j[1] * dy) / det, (j[0] * dy - j[2] * dx) / det)
    best = near.withColumn("residual", back).groupBy(key, "det_id").agg(F.min_by(F.struct("star_id", "residual"), F.struct("__off", "star_id")).alias("best"))
    return best.select(key, "det_id", "best.star_id", "best.residual").filter(F.col("residual") <= tolerance)


def residual_statistic(residuals: DataFrame, key: str = "image_id", rounds: int = 50) -> DataFrame:
    """Median of the residuals per image after clipping the large ones until nothing more is clipped.

    What is kept is always everything up to a limit, so two rounds that keep as many keep the same.
    """
    kept = checkpointed(residuals.select(key, "residual"))
    done: DataFrame | None = None
    counts = kept.groupBy(key).agg(F.count("*").alias("matched"))
    for _ in range(rounds):
        stats = robust_spread(kept, [key], "residual")
        limit = F.col("median") + RESIDUAL_CLIP * F.greatest(F.col("sigma"), F.lit(RESIDUAL_SIGMA_FLOOR_PX))
        judged = residuals.select(key, "residual").join(stats.select(key, limit.alias("limit")), key)
        new = checkpointed(judged.filter(F.col("residual") <= F.col("limit")).select(key, "residual"))
        moved = (new.groupBy(key).agg(F.count("*").alias("a")).join(kept.groupBy(key).agg(F.count("*").alias("b")), key, "outer")
                 .filter(~F.col("a").eqNullSafe(F.col("b"))))
        kept = new
        if moved.isEmpty():
            break
    done = medians(kept, [key], "residual").select(
        key, F.col("n").alias("retained"), F.when(F.col("n") >= RESIDUAL_MIN_KEPT, F.col("median")).alias("median_px"))
    return counts.join(done, key, "left")


def missing_bright(stars: DataFrame, detections: DataFrame, radius: float = BRIGHT_MISS_RADIUS) -> DataFrame:
    """Bright catalogue stars that no detection, and no bright star taken before, lies near."""
    bright = stars.filter(F.col("g") < BRIGHT_G).select("star_id", "x", "y", "g")
    spread = over_cells(bright, F.col("x") - radius, F.col("y") - radius, F.col("x") + radius, F.col("y") + radius, MATCH_CELL)
    seen = at_cell(detections.select(F.col("x"), F.col("y")), MATCH_CELL).withColumnsRenamed({"x": "ox", "y": "oy"})
    near = F.hypot(F.col("ox") - F.col("x"), F.col("oy") - F.col("y")) < radius
    found = multiplied(spread).join(seen, (spread.cx == seen.cx) & (spread.cy == seen.cy) & near, "left_semi").select("star_id").distinct()
    missed = checkpointed(bright.join(found, "star_id", "left_anti"))
    wide = over_cells(missed, F.col("x") - radius, F.col("y") - radius, F.col("x") + radius, F.col("y") + radius, MATCH_CELL)
    other = at_cell(missed.select("star_id", "x", "y"), MATCH_CELL).withColumnsRenamed(
        {"star_id": "later", "x": "ox", "y": "oy"})
    edges = (wide.join(other, ["cx", "cy"]).filter((F.col("star_id") < F.col("later")) & near)
             .select(F.col("star_id").alias("earlier"), "later"))
    return missed.join(ordered_suppression(missed, edges, "star_id"), "star_id", "left_semi")


def _two_first(df: DataFrame, place: Sequence[str], id_: str, order: Column) -> DataFrame:
    """The first two ids of each place with their ``__o``, by ``order``; an id counts once."""
    once = df.groupBy(*place, id_).agg(F.min(order).alias("__o"))
    return once.withColumn("__n", F.row_number().over(Window.partitionBy(*place).orderBy("__o", id_))).filter(F.col("__n") <= 2).drop("__n")


def _core_flags(detections: DataFrame, stars: DataFrame, grow: int) -> DataFrame:
    """Of each detection: ``blend`` (null for none) and the brightest star in its core, ``first``, with the next one, ``second``.

    Cores alike and stars of one place meet others as the two that count: whatever their own id, one of the two is another's.
    """
    edges = ("x0", "y0", "x1", "y1")
    d = with_rect(detections).withColumns({
        "rx0": F.col("x0") - grow, "ry0": F.col("y0") - grow, "rx1": F.col("x1") + grow, "ry1": F.col("y1") + grow})
    mine = over_cells(d, F.col("rx0"), F.col("ry0"), F.col("rx1") - 1, F.col("ry1") - 1, MATCH_CELL)
    # what has no flux counts as brighter than all
    strength = F.when(finite(F.col("flux")), F.col("flux").cast("double")).otherwise(F.lit(float("inf")))
    strong = _two_first(with_rect(detections), edges, "det_id", -strength)
    others = over_cells(strong, F.col("x0"), F.col("y0"), F.col("x1") - 1, F.col("y1") - 1, MATCH_CELL).select(
        F.col("det_id").alias("o_id"), (-F.col("__o")).alias("o_flux"), *[F.col(c).alias(f"o_{c}") for c in (*edges, "cx", "cy")])
    meets = ((F.col("rx0") < F.col("o_x1")) & (F.col("o_x0") < F.col("rx1")) & (F.col("ry0") < F.col("o_y1"))
             & (F.col("o_y0") < F.col("ry1")))
    brighter = ~finite(F.col("flux")) | (F.col("o_flux") >= F.col("flux"))
    blended = mine.join(others, (F.col("cx") == F.col("o_cx")) & (F.col("cy") == F.col("o_cy"))
                        & (F.col("det_id") != F.col("o_id")) & meets & brighter, "left_semi").select("det_id").distinct()
    bright = _two_first(stars.select("star_id", "x", "y", "g"), ("x", "y"), "star_id", F.coalesce("g", F.lit(float("-inf"))))
    s = at_cell(bright, MATCH_CELL).select(
        F.col("star_id").alias("n_id"), F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("__o").alias("ng"),
        F.col("cx").alias("n_cx"), F.col("cy").alias("n_cy"))
    cores = over_cells(with_rect(detections), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), MATCH_CELL).select("det_id", *edges, "cx", "cy")
    inside = ((F.col("nx") >= F.col("x0")) & (F.col("nx") < F.col("x1")) & (F.col("ny") >= F.col("y0")) & (F.col("ny") < F.col("y1")))
    held = cores.join(s, (F.col("cx") == F.col("n_cx")) & (F.col("cy") == F.col("n_cy")) & inside)
    # whether a star other than the pair's is bright enough: the brightest of a core tells, or the next where that is the pair's own
    each = F.struct(F.col("ng").alias("g"), F.col("n_id").alias("id"))
    first = held.groupBy("det_id").agg(F.min(each).alias("first"))
    second = held.join(multiplied(first), "det_id").filter(F.col("n_id") != F.col("first.id")).groupBy("det_id").agg(F.min(each).alias("second"))
    return first.join(multiplied(second), "det_id", "left").join(multiplied(blended.withColumn("blend", F.lit(True))), "det_id", "full")


def _judged(pairs: DataFrame) -> DataFrame:
    other = F.when(F.col("first.id") == F.col("star_id"), F.col("second.g")).otherwise(F.col("first.g"))
    close = other.isNotNull() & ~F.coalesce(other > F.col("g") + BLEND_COMPANION_MAG, F.lit(False))
    return pairs.select("star_id", "det_id", F.col("blend").isNotNull().alias("blend"), close.alias("catalogue_blend"))


def blend_flags(detections: DataFrame, stars: DataFrame, pairs: DataFrame, grow: int = 0) -> DataFrame:
    """Per matched pair: does an equal or brighter detection overlap the core (``blend``), and does another catalogue
    star no more than 0.3 mag fainter lie inside it (``catalogue_blend``)?"""
    return _judged(pairs.join(multiplied(_core_flags(detections, stars, grow)), "det_id", "left"))


def crossmatch_flags(detections: DataFrame, stars: DataFrame, grow: int = 0) -> DataFrame:
    """``blend_flags`` of all pairs of the cross-match: detections bring their flags, so pairs are listed behind the last shuffle."""
    known = detections.join(multiplied(_core_flags(detections, stars, grow)), "det_id", "left")
    return _judged(crossmatch(stars, known, ("blend", "first", "second")))


def drop_inside_brighter(candidates: DataFrame, detections: DataFrame, reach: str = "reach",
                         spikes: DataFrame | None = None) -> DataFrame:
    """Candidates outside the reach of every detection over twice as bright.

    ``reach`` is a column of ``detections``: the halo radius. ``spikes`` (``det_id``, ``angle``, ``length``) reach
    along a ray, three pixels wide.
    """
    c = candidates.select("det_id", F.col("x"), F.col("y"), F.col("flux"))
    d = detections.select(F.col("det_id").alias("o_id"), F.col("x").alias("ox"), F.col("y").alias("oy"),
                          F.col("flux").alias("o_flux"), F.col(reach).alias("reach"))
    bright = (F.col("o_id") != F.col("det_id")) & (F.col("o_flux") > 2 * F.coalesce(F.col("flux"), F.lit(0.0)))
    off = F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy"))
    spread = over_cells(d, F.col("ox") - F.col("reach"), F.col("oy") - F.col("reach"), F.col("ox") + F.col("reach"),
                        F.col("oy") + F.col("reach"), REACH_CELL).withColumnsRenamed({"cx": "o_cx", "cy": "o_cy"})
    same = (F.col("cx") == F.col("o_cx")) & (F.col("cy") == F.col("o_cy"))
    c = at_cell(c, REACH_CELL)
    hidden = c.join(spread, same & bright & (off < F.col("reach")), "left_semi").select("det_id")
    if spikes is not None:
        s = d.join(multiplied(spikes.withColumnRenamed("det_id", "o_id")), "o_id").withColumn("far", F.col("length") + SPIKE_WIDTH)
        s = over_cells(s, F.col("ox") - F.col("far"), F.col("oy") - F.col("far"), F.col("ox") + F.col("far"),
                       F.col("oy") + F.col("far"), REACH_CELL).withColumnsRenamed({"cx": "o_cx", "cy": "o_cy"})
        turn = F.atan2(F.col("y") - F.col("oy"), F.col("x") - F.col("ox")) - F.col("angle")
        turn = F.abs(F.atan2(F.sin(turn), F.cos(turn)))
        along = (off <= F.col("far")) & (off * F.sin(F.least(turn, F.lit(1.5707963267948966))) <= SPIKE_WIDTH)
        hidden = hidden.unionByName(c.join(s, same & bright & along, "left_semi").select("det_id"))
    return candidates.join(multiplied(hidden.distinct()), "det_id", "left_anti")


# --- distances ---------------------------------------------------------------------------

def cluster_samples(stars: DataFrame, ra: float, dec: float, radius: float) -> DataFrame:
    """Stars with a good parallax and motion, ``part`` inside the radius or in the field ring about it."""
    rows = cone_filter(stars, ra, dec, 3 * radius, CLUSTER_MAX_G)
    sep = separation("ra", "dec", ra, dec)
    part = F.when(sep <= radius, "inside").when((sep >= 1.5 * radius) & (sep <= 3 * radius), "field")
    return (rows.withColumn("p", usable_parallax(F.col("plx"), F.col("g")))
            .filter(F.col("p").isNotNull() & finite(F.col("pmra")) & finite(F.col("pmdec")))
            .withColumn("part", part).filter(F.col("part").isNotNull())
            .withColumn("sp", parallax_sigma(F.col("g")))
            .select("star_id", "part", "p", F.col("pmra").alias("a"), F.col("pmdec").alias("d"), "sp"))


def illuminators(targets: DataFrame, stars: DataFrame) -> DataFrame:
    """The brightest star with a usable parallax in each nebula (``target_id``, ``ra``, ``dec``, ``diameter`` arcmin)."""
    radius = F.greatest(F.lit(ILLUMINATOR_MIN_RADIUS), F.coalesce(F.when(F.col("diameter") > 0, F.col("diameter") / 120), F.lit(0.0)))
    cones = targets.select(F.col("target_id").alias("cone_id"), F.col("ra").alias("cone_ra"), F.col("dec").alias("cone_dec"),
                           radius.alias("radius"), F.lit(ILLUMINATOR_MAX_G).alias("g_max"))
    near = cone_join(cones, stars).withColumn("p", usable_parallax(F.col("plx"), F.col("g"))).filter(F.col("p").isNotNull())
    return near.groupBy("cone_id").agg(F.min(F.struct("g", "star_id", "p")).alias("s")).select(
        F.col("cone_id").alias("target_id"), F.col("s.star_id").alias("star_id"), F.col("s.g").alias("g"),
        (1000.0 / F.col("s.p")).alias("distance_pc"))


def find_cluster(stars: DataFrame, ra: float, dec: float, radius: float) -> DataFrame:
    """The cluster about a direction by shared motion and distance: at most one row.

    Columns ``members``, ``distance_pc``, ``low_pc``, ``high_pc``. Neighbours of a star are found in cells of
    proper motion as wide as the kernel, once for all stars alike.
    """
    spark = stars.sparkSession
    samples = checkpointed(cluster_samples(stars, ra, dec, radius).withColumn("one", F.lit(1)))
    inside, field = samples.filter("part = 'inside'"), samples.filter("part = 'field'")
    empty = spark.createDataFrame([], "members long, distance_pc double, low_pc double, high_pc double")
    sizes = {r["part"]: r["n"] for r in samples.groupBy("part").agg(F.count("*").alias("n")).collect()}
    n_in, n_field = sizes.get("inside", 0), sizes.get("field", 0)
    if n_in < CLUSTER_MIN_MEMBERS or n_field < CLUSTER_MIN_MEMBERS:
        return empty
    sa = CLUSTER_PM_SCALE * robust_spread(field, ["one"], "a", upper=True).first()["sigma"]
    sd = CLUSTER_PM_SCALE * robust_spread(field, ["one"], "d", upper=True).first()["sigma"]
    scale = n_in / n_field

    def distance2(a: Column, d: Column, p: Column, sp: Column) -> Column:
        da, dd = (F.col("a") - a) / sa, (F.col("d") - d) / sd
        dp = (F.col("p") - p) / (CLUSTER_PLX_SCALE * F.greatest(sp, F.col("sp")))
        return da * da + dd * dd + dp * dp

    # stars of the same motion, distance and error have the same neighbours: they meet once, with their numbers
    alike = checkpointed(samples.groupBy("a", "d", "p", "sp").agg(
        F.count_if(F.col("part") == "inside").alias("w_in"), F.count_if(F.col("part") == "field").alias("w_field"),
        F.min(F.when(F.col("part") == "inside", F.col("star_id"))).alias("first")))
    cell = {"ca": F.floor(F.col("a") / sa), "cd": F.floor(F.col("d") / sd)}
    seeds = (alike.filter("w_in > 0")
             .select(F.col("first").alias("seed"), F.col("a").alias("sa_"), F.col("d").alias("sd_"),
                     F.col("p").alias("sp_"), F.col("sp").alias("ss_"),
                     F.explode(F.sequence(F.floor(F.col("a") / sa) - 1, F.floor(F.col("a") / sa) + 1)).alias("ca"),
                     F.floor(F.col("d") / sd).alias("__d"))
             .withColumn("cd", F.explode(F.sequence(F.col("__d") - 1, F.col("__d") + 1))).drop("__d"))
    near = (alike.withColumns(cell).join(multiplied(seeds), ["ca", "cd"])
            .filter(distance2(F.col("sa_"), F.col("sd_"), F.col("sp_"), F.col("ss_")) <= 1))
    counts = near.groupBy("seed", "sa_", "sd_", "sp_", "ss_").agg(
        F.sum("w_in").alias("n"), (F.sum("w_field") * F.lit(scale)).alias("f"))
    best = counts.withColumn("sig", (F.col("n") - F.col("f")) / F.sqrt(F.col("f") + 1)).agg(
        F.max_by(F.struct("sig", "sa_", "sd_", "sp_", "ss_"), F.struct("sig", -F.col("seed"))).alias("b")).first()["b"]
    a, d, p, sp = best["sa_"], best["sd_"], best["sp_"], best["ss_"]
    grow2 = CLUSTER_GROW * CLUSTER_GROW
    long = "stack(3, 'a', a, 'd', d, 'p', p) AS (axis, value)"
    for _ in range(5):
        members = inside.filter(distance2(F.lit(a), F.lit(d), F.lit(p), F.lit(sp)) <= grow2).select(F.expr(long))
        centre = {r["axis"]: r["median"] for r in upper_medians(members, ["axis"], "value").collect()}
        if not centre:
            break
        a, d, p = centre["a"], centre["d"], centre["p"]
    close = samples.filter(distance2(F.lit(a), F.lit(d), F.lit(p), F.lit(sp)) <= grow2)
    split = close.agg(F.count_if(F.col("part") == "inside").alias("n"), F.count_if(F.col("part") == "field").alias("f")).first()
    if (split["n"] < CLUSTER_MIN_MEMBERS or split["n"] / max(1.0, split["f"] * scale) < CLUSTER_MIN_CONTRAST
            or best["sig"] < CLUSTER_MIN_SIGNIFICANCE):
        return empty
    q = order_elements(close.filter("part = 'inside'"), ["one"], "p", {
        name: (f, lambda n, f=f: F.least(n - 1, F.floor(n * F.lit(f)).cast("long")))
        for name, f in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))})
    return q.select(F.col("n").alias("members"), (1000.0 / F.col("q2")).alias("distance_pc"),
                    (1000.0 / F.col("q3")).alias("low_pc"), (1000.0 / F.col("q1")).alias("high_pc"))


# --- flight --------------------------------------------------------------------------------

def smoothstep(low: float, high: float, x: Column) -> Column:
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / (high - low)))
    return t * t * (3.0 - 2.0 * t)


def star_trajectory(stars: DataFrame, ra: float, dec: float, travel: float, frames: int,
                    growth: float = 0.15, brightening: bool = True) -> DataFrame:
    """Each star as seen in each frame of a flight of ``travel`` pc towards a direction.

    Needs ``distance_pc``. Adds ``frame``, ``seen_ra``, ``seen_dec``, ``front``, ``ratio``, ``growth``, ``pixel_scale``
    and ``opacity``. The frames are a fixed sequence on every star.
    """
    t = F.lit(0.0) if frames <= 1 else F.col("frame") / F.lit(frames - 1.0)
    rows = stars.withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(max(frames, 1) - 1))))
    rows = rows.withColumn("__s", travel * t).withColumn("__v", unit_vector("ra", "dec")).withColumn(
        "__u", unit_vector(F.lit(float(ra)), F.lit(float(dec))))
    p = {k: F.col("distance_pc") * F.col(f"__v.{k}") - F.col("__s") * F.col(f"__u.{k}") for k in "xyz"}
    rows = rows.withColumn("__p", F.struct(*[c.alias(k) for k, c in p.items()]))
    length = F.sqrt(sum((F.col(f"__p.{k}") * F.col(f"__p.{k}") for k in "xyz"), F.lit(0.0)))
    front = sum((F.col(f"__p.{k}") * F.col(f"__u.{k}") for k in "xyz"), F.lit(0.0)) > 0
    rows = rows.withColumns({"ratio": F.try_divide(F.col("distance_pc"), length), "front": front,
                             "__at": vector_angles(F.col("__p"))})
    g = 1.0 + growth * (F.col("ratio") - 1.0)
    light = F.col("ratio") * F.col("ratio") if brightening else F.lit(1.0)
    return rows.withColumns({
        "seen_ra": F.col("__at.ra"), "seen_dec": F.col("__at.dec"), "growth": g, "pixel_scale": F.try_divide(light, g * g),
        "opacity": F.when(F.col("front"), 1.0 - smoothstep(6.0, 14.0, F.col("ratio"))).otherwise(0.0),
    }).drop("__s", "__v", "__u", "__p", "__at")

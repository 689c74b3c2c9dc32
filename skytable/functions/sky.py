"""Angles, projections and cells of the sky as Column expressions. Angles are degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytable.functions.storage import multiplied


def col(c: Column | str | float) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(float(c))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def unit_vector(ra: Column | str, dec: Column | str) -> Column:
    a, d = F.radians(col(ra)), F.radians(col(dec))
    return F.struct((F.cos(d) * F.cos(a)).alias("x"), (F.cos(d) * F.sin(a)).alias("y"), F.sin(d).alias("z"))


def vector_angles(v: Column) -> Column:
    """The direction of a vector: struct of ra in [0, 360) and dec."""
    n = F.sqrt(v["x"] * v["x"] + v["y"] * v["y"] + v["z"] * v["z"])
    return F.struct(F.pmod(F.degrees(F.atan2(v["y"], v["x"])) + 360.0, F.lit(360.0)).alias("ra"),
                    F.degrees(F.asin(F.try_divide(v["z"], n))).alias("dec"))


def separation(ra1, dec1, ra2, dec2) -> Column:
    """Angle between two directions."""
    a1, d1, a2, d2 = (F.radians(col(c)) for c in (ra1, dec1, ra2, dec2))
    c = F.cos(d1) * F.cos(a1) * F.cos(d2) * F.cos(a2) + F.cos(d1) * F.sin(a1) * F.cos(d2) * F.sin(a2) + F.sin(d1) * F.sin(d2)
    return F.degrees(F.acos(clamp(c, -1.0, 1.0)))


def wcs(crval1: float, crval2: float, crpix1: float, crpix2: float, cd: tuple[float, float, float, float]) -> Column:
    """A TAN solution as a struct; CRPIX counts from 1, CD is row by row."""
    return F.struct(F.lit(float(crval1)).alias("crval1"), F.lit(float(crval2)).alias("crval2"),
                    F.lit(float(crpix1)).alias("crpix1"), F.lit(float(crpix2)).alias("crpix2"),
                    F.array(*[F.lit(float(c)) for c in cd]).alias("cd"))


def to_plane(ra, dec, ra0, dec0) -> Column:
    """Gnomonic projection about (ra0, dec0): struct of xi east and eta north in degrees, null on the far half."""
    a, d, a0, d0 = (F.radians(col(c)) for c in (ra, dec, ra0, dec0))
    cosc = F.sin(d0) * F.sin(d) + F.cos(d0) * F.cos(d) * F.cos(a - a0)
    xi = F.degrees(F.cos(d) * F.sin(a - a0) / cosc)
    eta = F.degrees((F.cos(d0) * F.sin(d) - F.sin(d0) * F.cos(d) * F.cos(a - a0)) / cosc)
    return F.when(cosc > 1e-6, F.struct(xi.alias("xi"), eta.alias("eta")))


def from_plane(xi, eta, ra0, dec0) -> Column:
    x, y, a0, d0 = (F.radians(col(c)) for c in (xi, eta, ra0, dec0))
    den = F.cos(d0) - y * F.sin(d0)
    a = F.degrees(a0 + F.atan2(x, den))
    d = F.degrees(F.atan2(F.sin(d0) + y * F.cos(d0), F.sqrt(x * x + den * den)))
    return F.struct(F.pmod(a + 360.0, F.lit(360.0)).alias("ra"), d.alias("dec"))


def tan_project(ra, dec, w: Column) -> Column:
    """Sky to 0-based pixel: struct of x and y; null on the far half."""
    p = to_plane(ra, dec, w["crval1"], w["crval2"])
    cd = w["cd"]
    det = cd[0] * cd[3] - cd[1] * cd[2]
    return F.when(p.isNotNull(), F.struct(
        (w["crpix1"] - 1.0 + (cd[3] * p["xi"] - cd[1] * p["eta"]) / det).alias("x"),
        (w["crpix2"] - 1.0 + (cd[0] * p["eta"] - cd[2] * p["xi"]) / det).alias("y")))


def tan_unproject(x, y, w: Column) -> Column:
    dx, dy = col(x) - (w["crpix1"] - 1.0), col(y) - (w["crpix2"] - 1.0)
    cd = w["cd"]
    return from_plane(cd[0] * dx + cd[1] * dy, cd[2] * dx + cd[3] * dy, w["crval1"], w["crval2"])


def flipped_rows(w: Column, height) -> Column:
    """The same solution on rows counted from the other end."""
    cd = w["cd"]
    return F.struct(w["crval1"].alias("crval1"), w["crval2"].alias("crval2"), w["crpix1"].alias("crpix1"),
                    (col(height) + 1.0 - w["crpix2"]).alias("crpix2"),
                    F.array(cd[0], -cd[1], cd[2], -cd[3]).alias("cd"))


def scaled(w: Column, factor: float) -> Column:
    """The solution after a resample by ``factor``."""
    return F.struct(w["crval1"].alias("crval1"), w["crval2"].alias("crval2"),
                    ((w["crpix1"] - 0.5) * factor + 0.5).alias("crpix1"),
                    ((w["crpix2"] - 0.5) * factor + 0.5).alias("crpix2"),
                    F.transform(w["cd"], lambda c: c / factor).alias("cd"))


def with_image_field(df: DataFrame, solution: str, width: str, height: str) -> DataFrame:
    """Add ``field_ra``, ``field_dec``, ``field_radius`` (to the farthest corner), ``corners`` and ``scale`` in arcsec
    per pixel, from columns with a solution and the image size.

    The points are columns of their own first, so that each is computed once.
    """
    w, wd, ht, zero = F.col(solution), F.col(width), F.col(height), F.lit(0.0)
    points = {"centre": (wd / 2, ht / 2), "c0": (zero, zero), "c1": (wd, zero), "c2": (zero, ht), "c3": (wd, ht),
              "left": (zero, ht / 2), "right": (wd, ht / 2)}
    rows = df.withColumns({f"__{k}": tan_unproject(x, y, w) for k, (x, y) in points.items()})

    def apart(a: str, b: str) -> Column:
        return separation(F.col(f"__{a}.ra"), F.col(f"__{a}.dec"), F.col(f"__{b}.ra"), F.col(f"__{b}.dec"))
    return rows.withColumns({
        "field_ra": F.col("__centre.ra"), "field_dec": F.col("__centre.dec"),
        "field_radius": F.greatest(*[apart("centre", f"c{i}") for i in range(4)]),
        "corners": F.array(*[F.col(f"__c{i}") for i in range(4)]), "scale": 3600.0 * apart("left", "right") / wd,
    }).drop(*[f"__{k}" for k in points])


# --- cells of about equal area ------------------------------------------------------

def grid_row(dec: Column, size: float) -> Column:
    return F.least(F.lit(math.ceil(180 / size) - 1), F.greatest(F.lit(0), F.floor((dec + 90.0) / size).cast("int")))


def grid_columns(row: Column, size: float) -> Column:
    return F.greatest(F.lit(1), F.floor(360.0 * F.cos(F.radians(-90.0 + (row + 0.5) * size)) / size).cast("int"))


def equal_area_cell(ra, dec, size: float) -> Column:
    row = grid_row(col(dec), size)
    n = grid_columns(row, size)
    return (row * 100000 + F.floor(F.pmod(col(ra), F.lit(360.0)) / 360.0 * n).cast("int") % n).cast("long")


def with_cells_near(df: DataFrame, ra: str, dec: str, radius: Column, size: float, name: str = "cell") -> DataFrame:
    """One row for every cell that a circle of ``radius`` may touch; no cell twice for one row."""
    row = F.col("__row")
    rows = df.withColumn("__radius", radius).withColumn("__row", F.explode(F.sequence(
        grid_row(F.col(dec) - F.col("__radius"), size), grid_row(F.col(dec) + F.col("__radius"), size))))
    low = -90.0 + row * size
    cosd = F.cos(F.radians(F.greatest(F.abs(low), F.abs(low + size))))
    # a circle over a pole reaches all of a row; else its widest half in ra is asin(sin r / cos dec)
    polar = F.abs(F.col(dec)) + F.col("__radius") + size >= 90.0
    widest = F.degrees(F.asin(clamp(F.try_divide(F.sin(F.radians("__radius")), F.cos(F.radians(F.col(dec)))), -1.0, 1.0)))
    span = F.when(polar | (cosd <= 1e-9), 360.0).otherwise(F.greatest((F.col("__radius") + size) / cosd, widest))
    rows = rows.withColumn("__n", grid_columns(row, size)).withColumn("__span", span)
    n = F.col("__n")
    first = F.when(F.col("__span") >= 180, 0).otherwise(F.floor((F.col(ra) - F.col("__span")) / 360.0 * n).cast("int"))
    last = F.when(F.col("__span") >= 180, n - 1).otherwise(
        F.least(F.floor((F.col(ra) + F.col("__span")) / 360.0 * n).cast("int"), first + n - 1))
    rows = rows.withColumn("__k", F.explode(F.sequence(first, last)))
    return multiplied(rows.withColumn(name, (row * 100000 + F.pmod(F.col("__k"), n)).cast("long")).drop(
        "__radius", "__row", "__n", "__span", "__k"))


# --- HEALPix ---------------------------------------------------------------------------

def _interleaved(v: Column, bits: int) -> Column:
    out = F.lit(0).cast("long")
    for b in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(v, b).bitwiseAND(F.lit(1).cast("long")), 2 * b))
    return out


def healpix_nested(ra, dec, order: int) -> Column:
    """Nested HEALPix pixel of a direction at nside 2**order (Gorski et al. 2005)."""
    nside = 1 << order
    z = F.sin(F.radians(col(dec)))
    za = F.abs(z)
    quarter = F.pmod(col(ra), F.lit(360.0)) / 90.0

    def whole(c: Column) -> Column:
        return F.floor(c).cast("long")
    belt_up = whole(nside * (0.5 + quarter) - nside * 0.75 * z)
    belt_down = whole(nside * (0.5 + quarter) + nside * 0.75 * z)
    face_up, face_down = F.shiftright(belt_up, order), F.shiftright(belt_down, order)
    low = F.lit(nside - 1).cast("long")
    belt_face = (F.when(face_up == face_down, F.when(face_up == 4, 4).otherwise(face_up + 4))
                 .when(face_up < face_down, face_up).otherwise(face_down + 8))
    belt_x, belt_y = belt_down.bitwiseAND(low), nside - belt_up.bitwiseAND(low) - 1
    sector = F.least(whole(quarter), F.lit(3).cast("long"))
    part = quarter - sector
    height = nside * F.sqrt(3.0 * (1.0 - za))
    cap_up = F.least(whole(part * height), low)
    cap_down = F.least(whole((1.0 - part) * height), low)
    belt, north = za <= 2.0 / 3.0, z >= 0
    face = F.when(belt, belt_face).when(north, sector).otherwise(sector + 8)
    x = F.when(belt, belt_x).when(north, nside - cap_down - 1).otherwise(cap_up)
    y = F.when(belt, belt_y).when(north, nside - cap_up - 1).otherwise(cap_down)
    return (face * (nside * nside) + _interleaved(x, order) + 2 * _interleaved(y, order)).cast("long")

"""Saturated stars as connected blobs of bright pixels.

A star detector passes over flat tops, so the brightest stars of a finished image are found by their
shape: pixels over a high threshold are joined into blobs, a compact blob is a star, and a blob that
is not compact is cut again half way to its peak.

Blobs are labelled in two steps. Inside of a tile of pixels an Arrow function joins neighbours; blobs
of neighbouring tiles that touch are then joined by rounds over slim edges, one for each pair of
labels. So a blob may cover a whole image without meeting in one task, and all images and all blobs of
one depth are handled by the same few jobs. Only bright pixels are ever carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skytable.functions.storage import checkpointed
from skytable.operators.pixels import KEY
from skytable.operators.rounds import connected

# Fixed values of the bright-star rules.
BRIGHT_QUANTILE = 0.998
BRIGHT_BINS = 1024
BRIGHT_LOW, BRIGHT_HIGH = 0.3, 0.9
LEAST_PIXELS = 4
BRIGHT_FILL = 0.4
BRIGHT_SIZE = 100
DEEPEST = 6
LEAST_RISE = 0.01
APART = 5.0
CELL = 8

TILE = 64
#: A pixel's number within an image: y times this, plus x.
ROW = 1 << 31


def bright_threshold(px: DataFrame, value: str = "v", quantile: float = BRIGHT_QUANTILE) -> DataFrame:
    """``t`` of every image: the lower edge of the bin that holds the quantile, kept within fixed limits.

    A histogram has BRIGHT_BINS bins at any image size; values beyond 0..1 count in the outer bins.
    """
    at = F.greatest(F.lit(0), F.least(F.lit(BRIGHT_BINS - 1), F.floor(F.col(value) * BRIGHT_BINS))).cast("int")
    bins = px.filter(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*KEY, at.alias("bin")).agg(F.count("*").alias("c"))
    down = Window.partitionBy(*KEY).orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = bins.withColumns({"__over": F.sum("c").over(down), "__all": F.sum("c").over(Window.partitionBy(*KEY))})
    found = bins.filter(F.col("__over") >= F.col("__all") * F.lit(1 - quantile)).groupBy(*KEY).agg(F.max("bin").alias("bin"))
    return found.select(*KEY, F.greatest(F.lit(BRIGHT_LOW), F.least(F.lit(BRIGHT_HIGH), F.col("bin") / float(BRIGHT_BINS))).alias("t"))


def tile_labels(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each pixel the least place (in the given arrays) of a pixel that it reaches over shared sides."""
    grid = np.full((int(y.max() - y.min()) + 2, int(x.max() - x.min()) + 2), -1)
    grid[y - y.min(), x - x.min()] = np.arange(len(y))
    a = np.concatenate([grid[:-1].reshape(-1), grid[:, :-1].reshape(-1)])
    b = np.concatenate([grid[1:].reshape(-1), grid[:, 1:].reshape(-1)])
    both = (a >= 0) & (b >= 0)
    a, b = a[both], b[both]
    label = np.arange(len(y))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _labelled(rows: pa.Table) -> pa.Table:
    """The rows of a tile with ``label``: the number of the first pixel of their piece of a blob."""
    y, x = np.asarray(rows.column("y"), dtype=np.int64), np.asarray(rows.column("x"), dtype=np.int64)
    order = np.lexsort((x, y))
    rows, y, x = rows.take(pa.array(order)), y[order], x[order]
    first = tile_labels(y, x)
    return rows.append_column("label", pa.array(y[first] * ROW + x[first], pa.int64()))


def blob_labels(px: DataFrame, group: list[str], tile: int = TILE) -> DataFrame:
    """Pixels (``group``, y, x and more, one row for each place) with ``label``, equal for pixels of a group that touch along sides.

    The label is the number (y * ROW + x) of the blob's first pixel in raster order.
    """
    names = px.columns
    cut = px.withColumns({"__ty": F.floor(F.col("y") / tile).cast("int"), "__tx": F.floor(F.col("x") / tile).cast("int")})
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    pieces = checkpointed(cut.groupBy(*group, "__ty", "__tx").applyInArrow(_labelled, f"{kinds}, label long"))
    edges = None
    for along, across in (("x", "y"), ("y", "x")):
        # the last line of a tile meets the first of the next
        last = pieces.filter(F.pmod(along, F.lit(tile)) == tile - 1).select(*group, (F.col(along) + 1).alias(along), across, F.col("label").alias("a"))
        first = pieces.filter(F.pmod(along, F.lit(tile)) == 0).select(*group, along, across, F.col("label").alias("b"))
        met = last.join(first, [*group, along, across]).select(*group, "a", "b").distinct()
        edges = met if edges is None else edges.unionByName(met)
    node = [F.struct(*group, F.col(s).alias("label")).alias(s) for s in "ab"]
    roots = connected(edges.select(*node)).select(*[F.col("id")[g].alias(g) for g in group], F.col("id.label").alias("label"), F.col("root.label").alias("__root"))
    return pieces.join(roots, [*group, "label"], "left").withColumn("label", F.coalesce("__root", "label")).select(*names, "label")


def bright_blobs(px: DataFrame, value: str = "v", quantile: float = BRIGHT_QUANTILE, tile: int = TILE) -> DataFrame:
    """Bright stars of every image: ``x``, ``y``, ``n`` (pixels of the blob that was taken), ``peak``, ``depth``.

    Blobs under four pixels are dropped. One that fills enough of its bounding square, and is not too wide, is a star at
    the middle of what stands above the upper half of its height. Any other is cut half way between its threshold
    and its peak, DEEPEST times at most, and not where the peak is hardly above the threshold. Null and NaN pixels
    are in no blob; an image without bright pixels gives no rows.
    """
    v = F.col(value).cast("double")
    work = checkpointed(px.filter(v.isNotNull() & ~F.isnan(v)).select(*KEY, "y", "x", v.alias("v"))
                        .join(bright_threshold(px, value, quantile), KEY).filter("v >= t").withColumn("part", F.lit(0).cast("long")))
    found: DataFrame | None = None
    for depth in range(DEEPEST + 1):
        pixels = checkpointed(blob_labels(work, [*KEY, "part"], tile))
        key = [*KEY, "part", "label"]
        blobs = pixels.groupBy(*key).agg(F.count("*").alias("n"), F.max("v").alias("peak"), F.first("t").alias("t"), F.greatest(
            F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("size")).filter(F.col("n") >= LEAST_PIXELS)
        side = (F.col("size") + 1).cast("double")
        compact = (F.col("n") / (side * side) >= BRIGHT_FILL) & (side <= BRIGHT_SIZE)
        blobs = checkpointed(blobs.withColumn("star", compact))
        stars = blobs.filter("star").select(*key, "n", "peak", ((F.col("t") + F.col("peak")) / 2).alias("core"))
        w = F.greatest(F.col("v") - F.col("core"), F.lit(0.0))
        top = (F.col("v") >= F.col("peak")).cast("double")
        sums = pixels.join(stars, key).groupBy(*key, "n", "peak").agg(*[F.sum(k * F.col(c)).alias(f"{name}{c}") for name, k in (("w", w), ("p", top)) for c in "xy"],
                                                                      F.sum(w).alias("w"), F.sum(top).alias("p"))
        place = [F.when(F.col("w") > 0, F.try_divide(F.col(f"w{c}"), F.col("w"))).otherwise(F.col(f"p{c}") / F.col("p")).alias(c) for c in "xy"]
        level = sums.select(*KEY, *place, "n", "peak", F.lit(depth).alias("depth"))
        found = level if found is None else found.unionByName(level)
        if depth == DEEPEST:
            break
        again = blobs.filter(~F.col("star") & (F.col("peak") - F.col("t") > LEAST_RISE)).select(*key, (F.col("t") + (F.col("peak") - F.col("t")) / 2).alias("__t"))
        work = checkpointed(pixels.join(again, key).filter("v >= __t").select(*KEY, "y", "x", "v", F.col("__t").alias("t"), F.col("label").alias("part")))
        if work.isEmpty():
            break
    return found


def search_stars(detections: DataFrame, blobs: DataFrame) -> DataFrame:
    """The stars a blind search starts from: ``image_id``, ``x``, ``y``, ``flux``.

    Bright blobs come before all detections, the biggest first; a detection within APART pixels of a blob is left out.
    """
    top = detections.groupBy(*KEY).agg(F.max("flux").alias("__top"))
    lead = blobs.join(top, KEY, "left").select(*KEY, "x", "y", (F.when(F.col("__top") > 0, F.col("__top")).otherwise(1.0) * (2 + F.col("n"))).alias("flux"))
    cells = [F.floor(F.col(c) / CELL).alias(f"__c{c}") for c in "xy"]
    near = blobs.select(*KEY, F.col("x").alias("__x"), F.col("y").alias("__y"), *cells)
    for c in ("__cx", "__cy"):
        near = near.withColumn(c, F.explode(F.array(*[F.col(c) + k for k in (-1, 0, 1)])))
    d = detections.select(*KEY, "x", "y", F.col("flux").cast("double").alias("flux"), *cells)
    covered = (d["image_id"] == near["image_id"]) & (d["__cx"] == near["__cx"]) & (d["__cy"] == near["__cy"]) & (
        F.hypot(d["x"] - near["__x"], d["y"] - near["__y"]) < APART)
    return lead.unionByName(d.join(near, covered, "left_anti").select(*KEY, "x", "y", "flux"))

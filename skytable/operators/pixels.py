"""Image planes as rows of pixels: ``image_id``, ``y``, ``x`` and a value.

Row and column windows are partitioned by image and line, so a task holds one line of an image. Statistics of
whole images go through the order statistics that spread a group over tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from skytable.functions.ordered import medians, percentiles, robust_spread, upper_medians
from skytable.functions.storage import checkpointed, multiplied

# Fixed values of the pixel rules.
MAD_TO_SIGMA = 1.4826
FWHM_PER_SIGMA = 2.3548200450309493
LINEAR_SKY = 0.02
CENTRE_FRACTION = 0.6
SKY_BLOCK = 16
SKY_FRACTION = 0.02
VALID_RECT_MARGIN = 4
MIN_COMMON_PERCENT = 50.0
SAMPLE_STEP = 7
NOISE_FLOOR = 1.0 / 65535.0
ZERO_FRACTION_GATE = 0.3
PHI_INV_65 = 0.3853204664
WB_SATURATION = 0.9
CLIP_ROUNDS = 10
CLIP_SIGMA = 3.0
EXACT_SPREAD = 1e-12
STRETCH_TARGET = 0.25
STRETCH_CLIP_BUDGET = 1e-4
FS_PEDESTAL = 0.5
FS_SCALE = 2.0
SETTLE_WINDOW = 4
DEBLEND_CAP = 2.0
SPARSE_CUTS, LEAST_KEPT = 5, 10

KEY = ["image_id"]


def clipped(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def with_size(px: DataFrame) -> DataFrame:
    """Add the image's ``width`` and ``height``."""
    size = px.groupBy(*KEY).agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    return px.join(size, KEY)


# --- statistics of planes --------------------------------------------------------------

def plane_statistics(px: DataFrame, value: str = "v") -> DataFrame:
    """min, max, mean and median per image."""
    plain = px.groupBy(*KEY).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"))
    return plain.join(medians(px, KEY, value).drop("n"), KEY)


def looks_linear(stats: DataFrame) -> DataFrame:
    """Is the image unstretched? Its sky median is near zero."""
    return stats.withColumn("linear", F.col("median") < LINEAR_SKY)


def constant_planes(px: DataFrame, value: str = "v") -> DataFrame:
    """Planes without any difference: broken masters."""
    s = px.groupBy(*KEY).agg(F.min(value).alias("min"), F.max(value).alias("max"))
    return s.filter(F.col("min") == F.col("max")).select(*KEY, F.col("min").alias("value"))


def unchanged(before: DataFrame, after: DataFrame) -> DataFrame:
    """Images whose mean, median and maximum a step left as they were: the step did nothing."""
    names = ["mean", "median", "max"]
    b = plane_statistics(before).select(*KEY, *names)
    return plane_statistics(after).select(*KEY, *names).join(b, [*KEY, *names], "left_semi").select(*KEY)


def central(px: DataFrame, fraction: float = CENTRE_FRACTION) -> DataFrame:
    """Pixels of the centred rectangle that covers ``fraction`` of each side."""
    mx = F.floor(F.col("width") * F.lit(1 - fraction) / 2)
    my = F.floor(F.col("height") * F.lit(1 - fraction) / 2)
    return with_size(px).filter((F.col("x") >= mx) & (F.col("x") < F.col("width") - mx) & (F.col("y") >= my)
                                & (F.col("y") < F.col("height") - my)).drop("width", "height")


def median_of_centre(px: DataFrame, value: str = "v", fraction: float = CENTRE_FRACTION) -> DataFrame:
    return medians(central(px, fraction), KEY, value).drop("n")


def reference_channel(levels: DataFrame, group: str, level: str = "median") -> DataFrame:
    """The channel with the lowest level of each group; the first on a tie (``channel_order``)."""
    return levels.groupBy(group).agg(F.min(F.struct(level, "channel_order", "image_id")).alias("s")).select(
        group, F.col("s.image_id").alias("image_id"), F.col(f"s.{level}").alias(level))


def sky_level(px: DataFrame, value: str = "v", block: int = SKY_BLOCK) -> DataFrame:
    """2nd percentile of the means of whole blocks; of the pixels where an image is under two blocks wide or high."""
    rows = with_size(px)
    small = (F.col("width") < 2 * block) | (F.col("height") < 2 * block)
    by, bx = F.floor(F.col("y") / block).cast("int"), F.floor(F.col("x") / block).cast("int")
    whole = (by < F.floor(F.col("height") / block)) & (bx < F.floor(F.col("width") / block))
    rows = rows.withColumns({"__by": F.when(small, F.col("y")).otherwise(by), "__bx": F.when(small, F.col("x")).otherwise(bx)})
    blocks = rows.filter(small | whole).groupBy(*KEY, "__by", "__bx").agg(F.avg(value).alias("__mean"))
    return percentiles(blocks, KEY, "__mean", {"sky": SKY_FRACTION}).drop("n")


def valid_rect(px: DataFrame, value: str = "v", margin: int = VALID_RECT_MARGIN) -> DataFrame:
    """Rectangle of real data: from the first to the last row and column with a positive median, less a margin.

    A line is as long as an image is wide or high, so its median is taken in one buffer. The far edges are exclusive.
    """
    rows = with_size(px)

    def span(line: str, size: str, low: str, high: str) -> DataFrame:
        lines = rows.groupBy(*KEY, size, line).agg(F.median(value).alias("m"))
        good = F.when(F.col("m") > 0, F.col(line))
        out = lines.groupBy(*KEY, size).agg(F.min(good).alias("a"), F.max(good).alias("b"))
        first, last = F.coalesce("a", F.col(size) - 1), F.coalesce("b", F.col(size) - 1)
        return out.select(*KEY, F.least(first + margin, F.col(size)).alias(low), F.greatest(last + 1 - margin, F.lit(0)).alias(high))
    return span("y", "height", "y0", "y1").join(span("x", "width", "x0", "x1"), KEY).select(*KEY, "x0", "y0", "x1", "y1")


def common_area(rects: DataFrame, group: str, ref_width: Column, ref_height: Column) -> DataFrame:
    """The rectangle all images of a group cover, its share of the reference frame, and why it is refused, or null."""
    r = rects.groupBy(group).agg(F.max("x0").alias("x0"), F.max("y0").alias("y0"), F.min("x1").alias("x1"), F.min("y1").alias("y1"))
    percent = 100.0 * (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) / (ref_width * ref_height)
    apart = (F.col("x1") <= F.col("x0")) | (F.col("y1") <= F.col("y0"))
    problem = F.when(apart, "frames do not overlap").when(percent < MIN_COMMON_PERCENT, "less than half of the reference in common")
    return r.withColumn("percent", F.when(~apart, percent)).withColumn("problem", problem)


def sampled(px: DataFrame) -> DataFrame:
    """Every 7th pixel in raster order."""
    return with_size(px).filter((F.col("y") * F.col("width") + F.col("x")) % SAMPLE_STEP == 0).drop("width", "height")


def noise_sigma(px: DataFrame, value: str = "v") -> DataFrame:
    """Robust noise of every image from its sample, floored; layers that are mostly zero use their upper half."""
    s = sampled(px)
    spread = robust_spread(s, KEY, value, upper=True).select(*KEY, F.when(F.col("sigma") == 1, 0.0).otherwise(F.col("sigma")).alias("mad"))
    upper = percentiles(s, KEY, value, {"p50": 0.5, "p65": 0.65}).drop("n")
    zeros = s.groupBy(*KEY).agg(F.avg((F.col(value) == 0).cast("double")).alias("zeros"))
    half = F.when(F.col("zeros") >= ZERO_FRACTION_GATE, (F.col("p65") - F.col("p50")) / PHI_INV_65).otherwise(0.0)
    rows = spread.join(upper, KEY).join(zeros, KEY)
    return rows.select(*KEY, F.greatest(F.col("mad"), half, F.lit(NOISE_FLOOR)).alias("noise"))


def _clipped_middle(rows: pa.Table) -> pa.Table:
    """Upper median of the values of an image after the cuts; they are sorted once, and a cut only moves the end."""
    v = np.asarray(rows.column("v").drop_null(), dtype=np.float64)
    v = np.sort(v[~np.isnan(v)])
    n = len(v)
    for _ in range(SPARSE_CUTS if n else 0):
        middle = v[n // 2]
        off = np.partition(np.abs(v[:n] - middle), n // 2)[n // 2]
        sigma = MAD_TO_SIGMA * off if off else 1.0
        kept = int(np.searchsorted(v[:n], middle + 3.0 * sigma / MAD_TO_SIGMA, side="right"))
        if kept < LEAST_KEPT or kept == n:
            break
        n = kept
    some = [0] if n else []
    return pa.table({"image_id": rows.column("image_id").take(pa.array(some, pa.int64())), "median": pa.array([v[n // 2]] if n else [], pa.float64())})


def sparse_median(px: DataFrame, value: str = "v") -> DataFrame:
    """Upper median of the sample after up to five cuts of everything 3 sigma above it.

    An image is left alone once nothing is cut, or when a cut would leave under ten values. The sample of one image is
    sorted in one task: a seventh of its pixels, 8 bytes each.
    """
    kind = px.schema["image_id"].dataType.simpleString()
    return sampled(px).select(*KEY, F.col(value).cast("double").alias("v")).groupBy(*KEY).applyInArrow(_clipped_middle, f"image_id {kind}, median double")


def linear_fit(pairs: DataFrame, key: str, limit: float = WB_SATURATION, *, clip: bool = False) -> DataFrame:
    """Least squares of ``b`` on ``a`` over pixels inside (0, limit): slope, intercept and pixels per ``key``.

    ``clip`` drops residuals over three standard deviations and fits again, at most ten times, until nothing changes.
    """
    inside = (F.col("a") > 0) & (F.col("a") < limit) & (F.col("b") > 0) & (F.col("b") < limit)
    usable = pairs.filter(inside).select(key, "a", "b")

    def fitted(rows: DataFrame) -> DataFrame:
        return rows.groupBy(key).agg(F.regr_slope("b", "a").alias("slope"), F.regr_intercept("b", "a").alias("intercept"),
                                     F.count("*").alias("pixels"))
    if not clip:
        return fitted(usable)
    usable = checkpointed(usable)
    kept = usable
    for _ in range(CLIP_ROUNDS):
        off = F.col("b") - (F.col("slope") * F.col("a") + F.col("intercept"))
        fit = checkpointed(fitted(kept).filter(F.col("slope").isNotNull()))
        spread = kept.join(fit, key).groupBy(key).agg(F.stddev_pop(off).alias("spread"))
        line = fit.join(spread, key)
        exact = F.col("spread") <= EXACT_SPREAD
        judged = usable.join(line, key)
        new = checkpointed(judged.filter(exact | (F.abs(off) <= CLIP_SIGMA * F.col("spread"))).select(key, "a", "b"))
        # the same set: as many pixels, and none of them new (a pixel that repeats is kept or dropped as one)
        moved = new.groupBy(key).agg(F.count("*").alias("now")).join(fit, key).filter(F.col("now") != F.col("pixels"))
        if moved.isEmpty() and new.join(kept, [key, "a", "b"], "left_anti").isEmpty():
            return fit
        kept = new
    return fitted(kept)


def psf_sigma(stars: DataFrame, group: str = "channel") -> DataFrame:
    """PSF sigma of a channel from star widths ``fwhm_x`` and ``fwhm_y``: the mean of the two upper medians."""
    long = stars.select(group, F.expr("stack(2, 'x', fwhm_x, 'y', fwhm_y) AS (axis, w)"))
    m = upper_medians(long, [group, "axis"], "w")
    return m.groupBy(group).agg((F.avg("median") / FWHM_PER_SIGMA).alias("sigma"))


def blur_to_widest(sigmas: DataFrame, channel: str = "channel", run: str = "run") -> DataFrame:
    """The blur that takes every channel of a run to its widest PSF; 0 for the widest."""
    widest = sigmas.groupBy(run).agg(F.max("sigma").alias("widest"))
    w, s = F.col("widest"), F.col("sigma")
    return sigmas.join(widest, run).withColumn("blur", F.when(w > s, F.sqrt(w * w - s * s)).otherwise(0.0))


# --- per-pixel algebra --------------------------------------------------------------------

def mtf(m: Column, x: Column) -> Column:
    """Midtone transfer."""
    return F.try_divide((m - 1.0) * x, (2.0 * m - 1.0) * x - m)


def midtone_for(x: Column, target: float) -> Column:
    return F.try_divide(x * (target - 1.0), 2.0 * target * x - target - x)


def screen(s: Column, t: Column) -> Column:
    return 1.0 - (1.0 - s) * (1.0 - t)


def unscreen(image: Column, starless: Column) -> Column:
    return F.when(starless < 1, clipped(F.greatest(F.lit(0.0), F.try_divide(image - starless, 1.0 - starless)))).otherwise(0.0)


def smooth_step(low: float, high: float, x: Column) -> Column:
    t = clipped((x - low) / (high - low))
    return t * t * (3.0 - 2.0 * t)


def combine(px: DataFrame, channels: Sequence[str], value: str = "v") -> DataFrame:
    """Channels of one run side by side: one row per ``run``, ``y``, ``x`` with a column per channel.

    Pixels not covered by every channel go.
    """
    cells = [F.max(F.when(F.col("channel") == c, F.col(value))).alias(c) for c in channels]
    wide = px.filter(F.col("channel").isin(*channels)).groupBy("run", "y", "x").agg(*cells)
    return wide.dropna(subset=list(channels))


# Which channel a palette shows as red, green and blue.
PALETTES = {"SHO": ("S", "H", "O"), "HOO": ("H", "O", "O"), "HSO": ("H", "S", "O")}


def palette_planes(wide: DataFrame, palette: str) -> DataFrame:
    r, g, b = PALETTES[palette]
    return wide.select("run", "y", "x", F.col(r).alias("r"), F.col(g).alias("g"), F.col(b).alias("b"))


def pixel_expression(wide: DataFrame, formulas: dict[str, str], *, truncate: bool = True) -> DataFrame:
    """User formulas over the channel columns, truncated to 0..1 unless told not to."""
    return wide.withColumns({name: clipped(F.expr(text).cast("double")) if truncate else F.expr(text).cast("double")
                             for name, text in formulas.items()})


def white_balance(wide: DataFrame, factors: dict[str, float], key: str = "run") -> DataFrame:
    """Gains per channel (ten decimals), then every median moved to the mean of the medians (twelve decimals)."""
    names = list(factors)
    gained = wide.withColumns({c: F.col(c) * F.round(F.lit(float(f)), 10) for c, f in factors.items()})
    pairs = ", ".join(f"'{c}', {c}" for c in names)
    long = gained.select(key, F.expr(f"stack({len(names)}, {pairs}) AS (channel, v)"))
    mids = medians(long, [key, "channel"], "v").groupBy(key).agg(
        *[F.max(F.when(F.col("channel") == c, F.col("median"))).alias(f"__m_{c}") for c in names])
    rows = gained.join(mids, key)
    target = sum((F.col(f"__m_{c}") for c in names), F.lit(0.0)) / len(names)
    return rows.withColumn("__target", target).withColumns(
        {c: F.col(c) + F.round(F.col("__target") - F.col(f"__m_{c}"), 12) for c in names}).drop("__target", *[f"__m_{c}" for c in names])


def background_offset(px: DataFrame, reference: DataFrame, value: str = "v") -> DataFrame:
    """Images moved so that their central median equals ``ref_median`` of ``reference`` (``image_id``)."""
    shift = median_of_centre(px, value).join(reference, KEY).select(
        *KEY, F.round(F.col("ref_median") - F.col("median"), 12).alias("__shift"))
    return px.join(shift, KEY).withColumn(value, F.col(value) + F.col("__shift")).drop("__shift")


def equal_sky(px: DataFrame, run: str, reference_channel_name: str, block: int = SKY_BLOCK) -> DataFrame:
    """Every channel of a run moved to the sky level of its reference channel, clipped to 0..1."""
    names = px.select(*KEY, run, "channel").distinct()
    levels = sky_level(px, block=block).join(names, KEY)
    ref = levels.filter(F.col("channel") == reference_channel_name).select(run, F.col("sky").alias("__ref"))
    moves = levels.join(ref, run).select(*KEY, "sky", "__ref")
    return px.join(moves, KEY).withColumn("v", clipped(F.col("v") - F.col("sky") + F.col("__ref"))).drop("sky", "__ref")


def scale_to_reference(px: DataFrame, run: str, reference_channel_name: str) -> DataFrame:
    """Every channel of a run given the median and noise of its reference channel; channels without noise are refused."""
    names = px.select(*KEY, run, "channel").distinct()
    stats = robust_spread(px, KEY, "v").join(names, KEY)
    ref = stats.filter(F.col("channel") == reference_channel_name).select(
        run, F.col("median").alias("__rm"), F.col("sigma").alias("__rs"))
    moves = stats.join(ref, run).filter((F.col("sigma") > 0) & (F.col("__rs") > 0)).select(
        *KEY, "median", "sigma", "__rm", "__rs")
    scaled = (F.col("v") - F.col("median")) * (F.col("__rs") / F.col("sigma")) + F.col("__rm")
    same = F.col("channel") == reference_channel_name
    return px.join(moves, KEY).withColumn("v", F.when(same, F.col("v")).otherwise(scaled)).drop("median", "sigma", "__rm", "__rs")


# --- neighbourhoods ------------------------------------------------------------------------

def along_row() -> WindowSpec:
    return Window.partitionBy("image_id", "y").orderBy("x")


def along_column() -> WindowSpec:
    return Window.partitionBy("image_id", "x").orderBy("y")


def _held(value: Column, shift: int, w: WindowSpec) -> Column:
    """The value ``shift`` pixels along a line, the edge value beyond its end."""
    if shift == 0:
        return value
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    if shift < 0:
        return F.coalesce(F.lag(value, -shift).over(w), F.first(value).over(whole))
    return F.coalesce(F.lead(value, shift).over(w), F.last(value).over(whole))


def _line_filter(px: DataFrame, value: str, weights: Sequence[float], out: str) -> DataFrame:
    """Weighted mean along rows, then along columns; edges hold their value."""
    r = len(weights) // 2
    for w in (along_row(), along_column()):
        terms = [float(k) * _held(F.col(value), i - r, w) for i, k in enumerate(weights)]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        px = px.withColumn(out, total)
        value = out
    return px


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    r = int(truncate * sigma + 0.5)
    k = [math.exp(-0.5 * i * i / (sigma * sigma)) for i in range(-r, r + 1)]
    return [x / sum(k) for x in k]


def gaussian_blur(px: DataFrame, sigma: float, value: str = "v", out: str = "blurred") -> DataFrame:
    """Separable Gaussian out to four sigma, edges held; a sigma that is not positive changes nothing."""
    if not sigma > 0:
        return px.withColumn(out, F.col(value))
    return _line_filter(px, value, gaussian_weights(sigma), out)


def frequency_separate(px: DataFrame, sigma: float, value: str = "v") -> DataFrame:
    """Add ``low``, the blurred layer, and ``high``, what the blur removed about a pedestal."""
    rows = gaussian_blur(px, sigma, value, "low")
    return rows.withColumn("high", clipped((F.col(value) - F.col("low")) / FS_SCALE + FS_PEDESTAL))


def box_radius(sigma: float) -> int:
    return max(1, math.floor(math.sqrt(sigma * sigma + 0.25) - 0.5 + 0.5))


def box_blur(px: DataFrame, radius: int, value: str = "v", out: str = "blurred") -> DataFrame:
    """Three moving means a side, edges held."""
    if radius < 1:
        return px.withColumn(out, F.col(value))
    n = 2 * radius + 1
    px = px.withColumn(out, F.col(value).cast("double"))
    for _ in range(3):
        for w in (along_row(), along_column()):
            whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            near = w.rowsBetween(-radius, radius)
            before = w.rowsBetween(-radius, 0)
            short_low = radius + 1 - F.count(out).over(before)
            short_high = n - F.count(out).over(near) - short_low
            total = (F.sum(out).over(near) + short_low * F.first(out).over(whole) + short_high * F.last(out).over(whole))
            px = px.withColumn(out, total / n)
    return px


def halved(px: DataFrame, value: str = "v") -> DataFrame:
    """Means of 2 by 2 blocks; what is beyond the edge counts as zero."""
    return px.groupBy(*KEY, F.floor(F.col("y") / 2).cast("int").alias("y"), F.floor(F.col("x") / 2).cast("int").alias("x")).agg(
        (F.sum(value) / 4.0).alias(value))


def area_shrink(px: DataFrame, width: int, height: int, value: str = "v") -> DataFrame:
    """Images shrunk to a size: each new pixel is the mean of what it covers, weighted by coverage.

    A pixel reaches at most the new pixels its two edges lie in.
    """
    rows = with_size(px).withColumns({"__sx": F.col("width") / float(width), "__sy": F.col("height") / float(height)})

    def spread(rows: DataFrame, c: str, step: str, size: int, out: str, weight: str) -> DataFrame:
        first = F.floor(F.col(c) / F.col(step)).cast("int")
        last = F.least(F.ceil((F.col(c) + 1) / F.col(step)).cast("int") - 1, F.lit(size - 1))
        rows = rows.withColumn(out, F.explode(F.sequence(first, F.greatest(first, last))))
        part = (F.least(F.col(c) + 1, (F.col(out) + 1) * F.col(step)) - F.greatest(F.col(c), F.col(out) * F.col(step)))
        return rows.withColumn(weight, part).filter(F.col(weight) > 0)
    rows = spread(rows, "x", "__sx", width, "__ox", "__wx")
    rows = spread(rows, "y", "__sy", height, "__oy", "__wy")
    w = F.col("__wx") * F.col("__wy")
    return rows.groupBy(*KEY, F.col("__oy").alias("y"), F.col("__ox").alias("x")).agg((F.sum(w * F.col(value)) / F.sum(w)).alias(value))


def crop(px: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """Pixels of a rectangle with coordinates from its corner."""
    return (px.filter((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1))
            .withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0}))


def cropped_solution(solution: Column, x0: int, y0: int) -> Column:
    """The sky solution after a crop: the reference pixel moves with the corner."""
    return F.struct(solution["crval1"].alias("crval1"), solution["crval2"].alias("crval2"), (solution["crpix1"] - x0).alias("crpix1"),
                    (solution["crpix2"] - y0).alias("crpix2"), solution["cd"].alias("cd"))


def smooth3(px: DataFrame, value: str = "v", out: str = "smooth") -> DataFrame:
    """3 by 3 mean, edges held."""
    for w, src in ((along_row(), value), (along_column(), out)):
        px = px.withColumn(out, _held(F.col(src), -1, w) + F.col(src) + _held(F.col(src), 1, w))
    return px.withColumn(out, F.col(out) / 9.0)


def local_maxima(px: DataFrame, threshold: Column, value: str = "smooth") -> DataFrame:
    """Pixels above the threshold and above their earlier neighbours in raster order, and not below the later ones."""
    v = F.col(value)
    rows = px.withColumns({"__left": F.lag(v).over(along_row()), "__right": F.lead(v).over(along_row())})
    line = F.struct(F.col("__left").alias("l"), v.alias("c"), F.col("__right").alias("r"))
    rows = rows.withColumns({"__up": F.lag(line).over(along_column()), "__down": F.lead(line).over(along_column())})
    earlier = [F.col("__left"), F.col("__up.l"), F.col("__up.c"), F.col("__up.r")]
    later = [F.col("__right"), F.col("__down.l"), F.col("__down.c"), F.col("__down.r")]
    test = v > threshold
    for c in earlier:
        test = test & F.coalesce(v > c, F.lit(True))
    for c in later:
        test = test & F.coalesce(v >= c, F.lit(True))
    return rows.filter(test).drop("__left", "__right", "__up", "__down")


def detect_stars(px: DataFrame, sigma_k: float = 5.0, fwhm: float = 3.0, value: str = "v") -> DataFrame:
    """Stars of every image: ``x``, ``y``, ``flux``, ``area``, ``peak``, brightest first by ``index``.

    The sky is the median and the threshold stands on the 3 by 3 mean. Centroid, flux and area are taken over a disc
    about each maximum.
    """
    sky = medians(px, KEY, value).select(*KEY, F.col("median").alias("sky"))
    rows = smooth3(px, value).join(sky.join(noise_sigma(px, value), KEY), KEY)
    found = local_maxima(rows, F.col("sky") + sigma_k * F.col("noise")).select(
        *KEY, F.col("y").alias("cy"), F.col("x").alias("cx"), F.col("smooth").alias("peak"), "sky")
    r = max(2.0, float(fwhm))
    reach = math.floor(r)
    disc = found.withColumn("dy", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).withColumn(
        "dx", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).filter(
        F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") <= r * r)
    disc = disc.withColumns({"y": F.col("cy") + F.col("dy"), "x": F.col("cx") + F.col("dx")})
    light = disc.join(px.select(*KEY, "y", "x", F.col(value).alias("__v")), [*KEY, "y", "x"]).withColumn("above", F.col("__v") - F.col("sky"))
    w = F.greatest(F.col("above"), F.lit(0.0))
    sums = light.groupBy(*KEY, "cy", "cx", "peak", "sky").agg(
        F.sum(w).alias("w"), F.sum(w * F.col("x")).alias("wx"), F.sum(w * F.col("y")).alias("wy"), F.sum("above").alias("flux"),
        F.count_if(F.col("above") >= 0.5 * (F.col("peak") - F.col("sky"))).alias("area"))
    stars = sums.select(*KEY, "cy", "cx", F.when(F.col("w") > 0, F.try_divide(F.col("wx"), F.col("w"))).otherwise(F.col("cx")).alias("x"),
                        F.when(F.col("w") > 0, F.try_divide(F.col("wy"), F.col("w"))).otherwise(F.col("cy")).alias("y"), "flux", "area", "peak")
    rank = Window.partitionBy(*KEY).orderBy(F.col("flux").desc(), "cy", "cx")
    return stars.withColumn("index", F.row_number().over(rank) - 1)


# --- stretches -----------------------------------------------------------------------------

def robust_minimum(px: DataFrame, value: str = "v") -> DataFrame:
    """Lowest value of the 3 by 3 median-filtered image, edges held."""
    v = F.col(value)
    rows = px.withColumn("__line", F.array(_held(v, -1, along_row()), v, _held(v, 1, along_row())))
    line = F.col("__line")
    nine = F.concat(_held(line, -1, along_column()), line, _held(line, 1, along_column()))
    rows = rows.withColumn("__nine", nine)
    return rows.groupBy(*KEY).agg(F.min(F.sort_array("__nine")[4]).alias("robust_min"))


def black_point(px: DataFrame, value: str = "v") -> DataFrame:
    """The robust minimum, lowered until at most 1 in 10,000 pixels lies at or below it, past ties."""
    low = robust_minimum(px, value)
    sizes = px.groupBy(*KEY).agg(F.floor(F.count("*") * F.lit(STRETCH_CLIP_BUDGET)).alias("budget"))
    marks = low.join(sizes, KEY)
    below = px.join(marks, KEY).filter(F.col(value) < F.col("robust_min")).groupBy(*KEY, F.col(value).alias("u")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*KEY).orderBy("u").rowsBetween(Window.unboundedPreceding, 0)
    ranked = below.withColumn("upto", F.sum("c").over(w)).join(sizes, KEY)
    picked = ranked.groupBy(*KEY).agg(F.max("upto").alias("n"), F.min("u").alias("lowest"),
                                      F.max(F.when(F.col("upto") <= F.col("budget"), F.col("u"))).alias("fits"))
    rows = marks.join(picked, KEY, "left")
    kept = F.col("n").isNull() | (F.col("n") <= F.col("budget"))
    return rows.select(*KEY, "robust_min", F.when(kept, F.col("robust_min")).otherwise(
        F.coalesce("fits", F.least(F.lit(0.0), F.col("lowest")))).alias("black"))


def stretch_parameters(px: DataFrame, value: str = "v", target: float = STRETCH_TARGET) -> DataFrame:
    """Black point ``c0`` and midtone ``m`` per image; ``problem`` where the median does not stand above the black point."""
    rows = black_point(px, value).join(medians(px, KEY, value).drop("n"), KEY)
    c0 = F.greatest(F.lit(0.0), F.col("black"))
    x = F.try_divide(F.col("median") - c0, 1.0 - c0)
    rows = rows.withColumns({"c0": c0, "__x": x})
    ok = F.coalesce(F.col("__x") > 0, F.lit(False))
    return rows.select(*KEY, "c0", F.when(ok, midtone_for(F.col("__x"), target)).alias("m"),
                       F.when(~ok, "nothing above the minimum").alias("problem"))


def linked_parameters(px: DataFrame, run: str, target: float = STRETCH_TARGET) -> DataFrame:
    """One ``c0`` and ``m`` per run: the lowest black point of its channels and the mean of their medians."""
    names = px.select(*KEY, run).distinct()
    rows = black_point(px).join(medians(px, KEY, "v").drop("n"), KEY).join(names, KEY)
    g = rows.groupBy(run).agg(F.greatest(F.lit(0.0), F.min("black")).alias("c0"), F.avg("median").alias("__m"))
    x = F.try_divide(F.col("__m") - F.col("c0"), 1.0 - F.col("c0"))
    return g.withColumn("__x", x).select(run, "c0", F.when(F.col("__x") > 0, midtone_for(F.col("__x"), target)).alias("m"))


def stretched(px: DataFrame, parameters: DataFrame, on: Sequence[str] = tuple(KEY), value: str = "v", out: str = "stretched") -> DataFrame:
    """Pixels through the midtone transfer of their image or run."""
    x = clipped(F.try_divide(F.col(value) - F.col("c0"), 1.0 - F.col("c0")))
    return px.join(parameters.select(*on, "c0", "m"), list(on)).withColumn(out, mtf(F.col("m"), x)).drop("c0", "m")


def reversible_state(px: DataFrame, target: float, run: str | None = None, value: str = "v") -> DataFrame:
    """What the reversible stretch of each image needs, and its inverse: ``low``, ``mid``, ``target``.

    With ``run`` the images of a run share the lowest minimum and the mean of the medians.
    """
    low = px.groupBy(*KEY).agg(F.min(value).alias("low"))
    if run is not None:
        names = px.select(*KEY, run).distinct()
        shared = low.join(names, KEY).groupBy(run).agg(F.min("low").alias("low"))
        low = names.join(shared, run)
    norm = px.join(low.select(*KEY, "low"), KEY).withColumn("__n", clipped((F.col(value) - F.col("low")) / (1.0 - F.col("low"))))
    mid = medians(norm, KEY, "__n", "mid").drop("n")
    state = low.join(mid, KEY)
    if run is not None:
        shared = state.groupBy(run).agg(F.avg("mid").alias("mid"))
        state = state.drop("mid").join(shared, run)
    return state.select(*KEY, "low", "mid", F.lit(float(target)).alias("target"))


def reversible_forward(px: DataFrame, state: DataFrame, value: str = "v", out: str = "stretched") -> DataFrame:
    m, t = F.col("mid"), F.col("target")
    rows = px.join(state, KEY).withColumn("__x", clipped((F.col(value) - F.col("low")) / (1.0 - F.col("low"))))
    x = F.col("__x")
    y = F.try_divide((m - 1.0) * t * x, m * (t + x - 1.0) - t * x)
    return rows.withColumn(out, clipped(y)).drop("low", "mid", "target", "__x")


def reversible_inverse(px: DataFrame, state: DataFrame, value: str = "stretched", out: str = "restored") -> DataFrame:
    m, t, y = F.col("mid"), F.col("target"), F.col(value)
    x = clipped(F.try_divide(m * y * (t - 1.0), m * t - m * y + t * y - t))
    return px.join(state, KEY).withColumn(out, clipped(x * (1.0 - F.col("low")) + F.col("low"))).drop("low", "mid", "target")


# --- star light ----------------------------------------------------------------------------

def rect_pixels(rects: DataFrame, names: Sequence[str], grow: float = 0.0) -> DataFrame:
    """One row for each pixel of a rectangle ``names`` (x0, y0, x1, y1; the far edges are exclusive), grown to all sides."""
    x0, y0, x1, y1 = [F.col(c) for c in names]
    rows = rects.filter((x1 + grow > x0 - grow) & (y1 + grow > y0 - grow))
    for c, low, high in (("y", y0, y1), ("x", x0, x1)):
        rows = rows.withColumn(f"__{c}", F.explode(F.sequence(F.floor(low - grow).cast("long"), F.floor(high + grow).cast("long") - 1)))
    return multiplied(rows.drop(*[c for c in ("x", "y") if c in rects.columns]).withColumnsRenamed({"__y": "y", "__x": "x"}))


def core_labels(detections: DataFrame, grow: float) -> DataFrame:
    """The detection that each pixel of a core belongs to, ``label``: the first (least ``star``) whose core, grown by a star's width, holds it.

    Detections have ``image_id``, ``star`` and the core's ``x0``, ``y0``, ``x1``, ``y1``. Pixels outside of an image meet nothing later.
    """
    return rect_pixels(detections.select(*KEY, "star", "x0", "y0", "x1", "y1"), ["x0", "y0", "x1", "y1"], grow).groupBy(*KEY, "y", "x").agg(F.min("star").alias("label"))


def ring_profile(px: DataFrame, stars: DataFrame, reach: int, value: str = "v", labels: DataFrame | None = None) -> DataFrame:
    """Upper median of each round ring about a star: ``star``, ``r``, ``raw``.

    ``stars`` has ``image_id``, ``star``, ``sx``, ``sy``. A pixel meets only stars whose square holds it. Pixels that
    ``labels`` (see ``core_labels``) gives to another star are left out; a ring without any other pixel has no row.
    """
    near = stars.withColumn("y", F.explode(F.sequence(F.floor(F.col("sy")).cast("int") - reach, F.floor(F.col("sy")).cast("int") + reach + 1))).withColumn(
        "x", F.explode(F.sequence(F.floor(F.col("sx")).cast("int") - reach, F.floor(F.col("sx")).cast("int") + reach + 1)))
    rows = multiplied(near).join(px, [*KEY, "y", "x"]).withColumn("r", F.floor(F.hypot(F.col("x") - F.col("sx"), F.col("y") - F.col("sy")) + 0.5).cast("int"))
    rows = rows.filter(F.col("r") <= reach)
    if labels is not None:
        rows = rows.join(multiplied(labels.select(*KEY, "y", "x", "label")), [*KEY, "y", "x"], "left").filter(F.col("label").isNull() | (F.col("label") == F.col("star")))
    return upper_medians(rows, [*KEY, "star", "r"], value, "raw").drop("n")


def smooth_profile(profile: DataFrame, start: int, value: str = "raw") -> DataFrame:
    """5-ring running mean from ``start`` out, then made non-increasing."""
    w = Window.partitionBy(*KEY, "star").orderBy("r")
    from_start = F.when(F.col("r") >= start, F.col(value))
    mean = F.when(F.col("r") >= start, F.avg(from_start).over(w.rowsBetween(-2, 2))).otherwise(F.col(value))
    return profile.withColumn("__mean", mean).withColumn(
        "smooth", F.min("__mean").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__mean")


def profile_end(profile: DataFrame, noise: DataFrame, start: int = 1, value: str = "raw") -> DataFrame:
    """Where each profile stops falling: ``rmax`` and the local ``sky``; the whole profile where it never settles.

    ``noise`` gives the noise per image.
    """
    w = Window.partitionBy(*KEY, "star").orderBy("r")
    n = SETTLE_WINDOW
    near, far = w.rowsBetween(0, n - 1), w.rowsBetween(n, 2 * n - 1)
    rows = profile.join(noise, KEY).withColumns({
        "near": F.avg(value).over(near), "far": F.avg(value).over(far), "full": F.count(value).over(far),
        "last": F.last(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        "rings": F.count(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    ring = 1.2533 * F.col("noise") / F.sqrt(2 * math.pi * F.greatest(F.col("r"), F.lit(1)))
    settled = (F.col("r") >= max(1, start)) & (F.col("full") == n) & (
        F.col("near") - F.col("far") <= 3.0 * ring * math.sqrt(2.0) / math.sqrt(n))
    found = rows.groupBy(*KEY, "star").agg(F.min(F.when(settled, F.struct("r", "far"))).alias("s"), F.max("rings").cast("int").alias("rings"),
                                           F.max("last").alias("last"))
    return found.select(*KEY, "star", F.coalesce(F.col("s.r") + n, F.col("rings")).alias("rmax"),
                        F.coalesce("s.far", F.least(F.lit(0.0), F.col("last"))).alias("sky"), F.col("s").isNotNull().alias("settled"))


def star_colour(wide: DataFrame, stars: DataFrame, channels: Sequence[str], radius: float, sky: dict[str, float] | None = None) -> DataFrame:
    """Each channel's light over a core against the mean of the channels; 1 where there is none.

    ``wide`` has one column per channel, ``stars`` has ``run``, ``star``, ``sx``, ``sy``.
    """
    reach = math.ceil(radius) + 1
    near = stars.withColumn("y", F.explode(F.sequence(F.floor(F.col("sy")).cast("int") - reach, F.floor(F.col("sy")).cast("int") + reach))).withColumn(
        "x", F.explode(F.sequence(F.floor(F.col("sx")).cast("int") - reach, F.floor(F.col("sx")).cast("int") + reach)))
    level = sky or {}
    rows = multiplied(near).join(wide, ["run", "y", "x"]).filter(F.hypot(F.col("x") - F.col("sx"), F.col("y") - F.col("sy")) <= radius)
    sums = {c: F.sum(F.col(c) - level.get(c, 0.0)) for c in channels}
    total = sum((s for s in sums.values()), F.lit(0.0)) / len(channels)
    g = rows.groupBy("run", "star").agg(total.alias("__i"), *[s.alias(f"__{c}") for c, s in sums.items()])
    return g.select("run", "star", *[F.when(F.col("__i") > 0, F.greatest(F.lit(0.0), F.try_divide(F.col(f"__{c}"), F.col("__i")))).otherwise(1.0).alias(c)
                                     for c in channels])


def deblend_share(model: Column, total: Column, light: Column, sigma: Column) -> Column:
    """The light one star takes at a pixel: its share of the data well above the noise, its model below."""
    a = F.coalesce(smooth_step(1.0, 5.0, F.try_divide(total, sigma)), F.lit(1.0))
    share = a * F.try_divide(model, total) * F.least(light, DEBLEND_CAP * total) + (1.0 - a) * model
    return F.when((total > 0) & (model > 0), share).otherwise(0.0)


def model_pixels(stars: DataFrame, profile: DataFrame, reach: int) -> DataFrame:
    """Model light of every star at every pixel in reach: the profile between two rings, linearly.

    ``stars`` has ``image_id``, ``star``, ``sx``, ``sy``; ``profile`` has ``image_id``, ``star``, ``r``, ``raw``.
    """
    w = Window.partitionBy(*KEY, "star").orderBy("r")
    steps = profile.select(*KEY, "star", "r", F.col("raw").alias("p0"), F.coalesce(F.lead("raw").over(w), F.lit(0.0)).alias("p1"))
    # a star carries its whole curve to its pixels, so that they need not go to the rings
    curves = steps.groupBy(*KEY, "star").agg(F.map_from_entries(F.collect_list(F.struct(F.col("r").cast("int"), F.struct("p0", "p1")))).alias("__curve"))
    near = stars.join(multiplied(curves), [*KEY, "star"]).withColumn("y", F.explode(F.sequence(F.floor(F.col("sy")).cast("int") - reach, F.floor(F.col("sy")).cast("int") + reach + 1))).withColumn(
        "x", F.explode(F.sequence(F.floor(F.col("sx")).cast("int") - reach, F.floor(F.col("sx")).cast("int") + reach + 1)))
    d = F.hypot(F.col("x") - F.col("sx"), F.col("y") - F.col("sy"))
    rows = near.withColumn("__d", d).withColumn("__p", F.col("__curve")[F.floor("__d").cast("int")]).filter(F.col("__p").isNotNull())
    light = F.col("__p.p0") + (F.col("__p.p1") - F.col("__p.p0")) * (F.col("__d") - F.floor("__d"))
    return multiplied(rows.select(*KEY, "star", "y", "x", F.greatest(F.lit(0.0), light).alias("model")))


def deblended(px: DataFrame, models: DataFrame, noise: DataFrame, value: str = "v") -> DataFrame:
    """Light of every star per pixel: ``image_id``, ``star``, ``y``, ``x``, ``light``. ``noise`` gives ``noise`` and ``sky``."""
    total = F.sum("model").over(Window.partitionBy(*KEY, "y", "x"))
    rows = multiplied(models.withColumn("total", total)).join(px, [*KEY, "y", "x"]).join(noise, KEY)
    return rows.select(*KEY, "star", "y", "x", deblend_share(F.col("model"), F.col("total"), F.col(value) - F.col("sky"), F.col("noise")).alias("light"))


def residual_layer(px: DataFrame, lights: DataFrame, value: str = "v") -> DataFrame:
    """What the stars leave of an image."""
    taken = lights.groupBy(*KEY, "y", "x").agg(F.sum("light").alias("__taken"))
    return px.join(multiplied(taken), [*KEY, "y", "x"], "left").withColumn(
        "residual", F.col(value) - F.coalesce("__taken", F.lit(0.0))).drop("__taken")


def pixel_owner(px: DataFrame, stars: DataFrame) -> DataFrame:
    """The star that owns each pixel: the star whose core holds it, else the brightest whose halo does.

    ``stars`` has ``image_id``, ``star``, ``sx``, ``sy``, ``flux``, ``core`` and ``halo`` radii; in two cores the later
    star has the pixel.
    """
    near = stars.withColumn("__r", F.ceil(F.greatest("core", "halo")).cast("int"))
    near = near.withColumn("y", F.explode(F.sequence(F.floor(F.col("sy")).cast("int") - F.col("__r"), F.ceil(F.col("sy")).cast("int") + F.col("__r")))).withColumn(
        "x", F.explode(F.sequence(F.floor(F.col("sx")).cast("int") - F.col("__r"), F.ceil(F.col("sx")).cast("int") + F.col("__r"))))
    dx, dy = F.abs(F.col("x") - F.col("sx")), F.abs(F.col("y") - F.col("sy"))
    in_core = (dx <= F.col("core")) & (dy <= F.col("core"))
    rows = near.withColumn("__core", in_core).filter(in_core | (F.hypot(dx, dy) < F.col("halo")))
    order = F.when(F.col("__core"), F.struct(F.lit(1).alias("k"), F.col("star").cast("double").alias("a"), F.col("star").alias("b"))).otherwise(
        F.struct(F.lit(0).alias("k"), F.col("flux").cast("double").alias("a"), (-F.col("star")).alias("b")))
    owned = rows.groupBy(*KEY, "y", "x").agg(F.max_by("star", order).alias("owner"))
    return px.select(*KEY, "y", "x").join(multiplied(owned), [*KEY, "y", "x"], "left")


def sprite_owner(px: DataFrame, sprites: DataFrame, others: DataFrame | None = None, *, halo_mode: bool = False) -> DataFrame:
    """The sprite that owns each pixel, ``owner``, null for what stays in the residual.

    Sprites have ``image_id``, ``star``, ``x``, ``y``, ``flux``, the core ``x0``, ``y0``, ``x1``, ``y1``, the footprint ``fx0``, ``fy0``,
    ``fx1``, ``fy1`` and the radius ``outer``; ``others`` are cores of detections that are no sprites. A pixel of two cores goes to
    the later sprite; what no core holds goes to the brightest footprint. Cores of ``others`` are kept for the residual before
    all of that. In halo mode nothing is kept back, and a footprint ends at the outer radius.
    """
    core = rect_pixels(sprites, ["x0", "y0", "x1", "y1"]).select(*KEY, "y", "x", F.col("star").alias("__owner"), F.lit(1).alias("__rank"), F.col("star").cast("double").alias("__a"), F.lit(0).cast("long").alias("__b"))
    wide = rect_pixels(sprites.withColumnsRenamed({"x": "__sx", "y": "__sy"}), ["fx0", "fy0", "fx1", "fy1"])
    if halo_mode:
        wide = wide.filter(F.hypot(F.col("x") - F.col("__sx"), F.col("y") - F.col("__sy")) < F.col("outer"))
    wide = wide.select(*KEY, "y", "x", F.col("star").alias("__owner"), F.lit(0).alias("__rank"), F.col("flux").cast("double").alias("__a"), (-F.col("star")).cast("long").alias("__b"))
    claims = core.unionByName(wide)
    if others is not None and not halo_mode:
        kept = rect_pixels(others, ["x0", "y0", "x1", "y1"]).select(*KEY, "y", "x", F.lit(None).cast(sprites.schema["star"].dataType).alias("__owner"), F.lit(2).alias("__rank"),
                                                                    F.lit(0.0).alias("__a"), F.lit(0).cast("long").alias("__b"))
        claims = claims.unionByName(kept)
    best = claims.groupBy(*KEY, "y", "x").agg(F.max_by(F.struct(F.col("__owner").alias("owner")), F.struct("__rank", "__a", "__b")).alias("__best"))
    return px.select(*KEY, "y", "x").join(multiplied(best), [*KEY, "y", "x"], "left").select(*KEY, "y", "x", F.col("__best.owner").alias("owner"))


# --- stacks ---------------------------------------------------------------------------------

def rejection_for(count: Column) -> Column:
    """How a stack of ``count`` frames rejects."""
    return F.when(count >= 8, "winsorized").when(count >= 3, "percentile").otherwise("none")


def stack_frames(px: DataFrame, stack: str = "stack_id", value: str = "v", *, multiplicative: bool = False) -> DataFrame:
    """Average of the frames of a stack per pixel, after rejection by count: ``v``, ``kept``, ``frames``.

    Two frames are averaged. Three to seven drop values off the median by more than a share of it (0.2 low, 0.1 high).
    Eight and more drop values over 4 sigma low or 3 sigma high, after sigma is settled on winsorized values.
    ``multiplicative`` first brings the frames to the median level of the stack, for flats.
    """
    rows = px
    if multiplicative:
        level = medians(px, [stack, "image_id"], value).select(stack, "image_id", F.col("median").alias("__level"))
        target = level.groupBy(stack).agg(F.avg("__level").alias("__target"))
        rows = px.join(level.join(target, stack), [stack, "image_id"]).withColumn(value, F.col(value) * F.try_divide(F.col("__target"), F.col("__level")))
    site = [stack, "y", "x"]
    first = rows.groupBy(*site).agg(F.count(value).alias("frames"), F.median(value).alias("m"), F.stddev_samp(value).alias("s"))
    high_count = F.col("frames") >= 8
    wins = rows.join(first, site)
    for _ in range(3):
        held = F.greatest(F.col("m") - 1.5 * F.col("s"), F.least(F.col("m") + 1.5 * F.col("s"), F.col(value)))
        again = wins.filter(high_count).groupBy(*site).agg((1.134 * F.stddev_samp(held)).alias("__s"))
        first = first.join(again, site, "left").withColumn("s", F.coalesce("__s", "s")).drop("__s")
        wins = rows.join(first, site)
    off = F.col(value) - F.col("m")
    share = F.when(F.col("m") != 0, F.try_divide(off, F.abs(F.col("m")))).otherwise(0.0)
    keep = (F.when(F.col("frames") >= 8, (off >= -4.0 * F.col("s")) & (off <= 3.0 * F.col("s")))
            .when(F.col("frames") >= 3, (share >= -0.2) & (share <= 0.1)).otherwise(True))
    return wins.groupBy(*site).agg(F.avg(F.when(keep, F.col(value))).alias("v"), F.count_if(keep).alias("kept"), F.max("frames").alias("frames"))


def registration_reference(quality: DataFrame, run: str = "run") -> DataFrame:
    """The channel everything of a run is registered to: L; else the best FWHM over root stars; else a fixed order.

    ``quality`` has ``channel``, ``fwhm``, ``stars``.
    """
    order = ("G", "R", "B", "H", "S", "O")
    place = F.lit(len(order))
    for i, c in enumerate(order):
        place = F.when(F.col("channel") == c, i).otherwise(place)
    usable = F.coalesce(~F.isnan("fwhm") & (F.col("fwhm") > 0) & (F.col("fwhm") < float("inf")) & (F.col("stars") >= 1), F.lit(False))
    score = F.when(usable, F.try_divide(F.col("fwhm"), F.sqrt("stars")))
    rank = F.struct(F.when(F.col("channel") == "L", 0).when(score.isNotNull(), 1).otherwise(2).alias("a"),
                    F.when(F.col("channel") != "L", F.coalesce(score, F.lit(0.0))).otherwise(0.0).alias("b"), place.alias("c"), F.col("channel").alias("channel"))
    return quality.groupBy(run).agg(F.min(rank).alias("best")).select(run, F.col("best.channel").alias("channel"))


# --- fragments --------------------------------------------------------------------------------

def whole_stars(detections: DataFrame, px: DataFrame, fwhm: int, value: str = "v", cell: float = 32.0) -> DataFrame:
    """Detections that are no part of a brighter star.

    One is a part when a pixel within max(2, fwhm) beyond its 3 by 3 is brighter than those, or when it lies in the core
    of a detection of more flux whose centre is at least as bright. ``detections`` has ``image_id``, ``det_id``, ``x``,
    ``y``, ``flux``, ``half_width``; pixels off the image read as its edge.
    """
    rad = max(2.0, float(fwhm))
    reach = math.ceil(rad)
    cx, cy = F.floor(F.col("x") + 0.5).cast("int"), F.floor(F.col("y") + 0.5).cast("int")
    size = px.groupBy(*KEY).agg(F.max("x").alias("__w"), F.max("y").alias("__h"))
    offsets = F.sequence(F.lit(-reach), F.lit(reach))
    near = detections.select(*KEY, "det_id", cx.alias("__cx"), cy.alias("__cy")).join(size, KEY)
    near = near.withColumn("__j", F.explode(offsets)).withColumn("__i", F.explode(offsets))
    inner = (F.abs("__i") <= 1) & (F.abs("__j") <= 1)
    near = near.filter(inner | (F.col("__i") * F.col("__i") + F.col("__j") * F.col("__j") <= rad * rad))

    def held(c: str, off: str, last: str) -> Column:
        return F.greatest(F.lit(0), F.least(F.col(last), F.col(c) + F.col(off)))
    near = near.withColumns({"x": held("__cx", "__i", "__w"), "y": held("__cy", "__j", "__h")})
    seen = multiplied(near).join(px.select(*KEY, "y", "x", F.col(value).alias("__v")), [*KEY, "y", "x"]).groupBy(*KEY, "det_id").agg(
        F.max(F.when(inner, F.col("__v"))).alias("__top"), F.max(F.when(~inner, F.col("__v"))).alias("__around"),
        F.max(F.when((F.col("__i") == 0) & (F.col("__j") == 0), F.col("__v"))).alias("__centre"))
    rows = detections.join(seen, [*KEY, "det_id"])
    peaks = rows.filter(~F.coalesce(F.col("__around") > F.col("__top"), F.lit(False)))
    x0, x1 = F.floor(F.col("x") - F.col("half_width")), F.floor(F.col("x") + F.col("half_width")) + 1
    cores = rows.select(F.col("image_id").alias("o_image"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("flux").alias("o_flux"),
                        F.col("__centre").alias("o_centre"), (0.5 * (x1 - x0) + fwhm).alias("core"))

    def cells(c: str) -> Column:
        return F.explode(F.sequence(F.floor((F.col(c) - F.col("core")) / cell).cast("int"), F.floor((F.col(c) + F.col("core")) / cell).cast("int")))
    cores = cores.withColumn("o_cx", cells("ox")).withColumn("o_cy", cells("oy"))
    placed = peaks.withColumns({"__gx": F.floor(F.col("x") / cell).cast("int"), "__gy": F.floor(F.col("y") / cell).cast("int")})
    inside = ((F.col("image_id") == F.col("o_image")) & (F.col("__gx") == F.col("o_cx")) & (F.col("__gy") == F.col("o_cy")) & (F.col("o_flux") > F.col("flux"))
              & (F.hypot(F.col("ox") - F.col("x"), F.col("oy") - F.col("y")) <= F.col("core")) & (F.col("o_centre") >= F.col("__top")))
    return placed.join(cores, inside, "left_anti").select(*detections.columns)

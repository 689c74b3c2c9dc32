"""Bright blobs against a flood fill, spikes against planted ones."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check import difference
from skytable.operators import blobs, rounds, spikes


def image_rows(spark, images):
    rows = [(i, y, x, float(v)) for i, a in images.items() for y, line in enumerate(a) for x, v in enumerate(line)]
    return spark.createDataFrame(rows, "image_id long, y long, x long, v double")


def flood(mask):
    """Lists of the (y, x) of every 4-connected piece of a mask."""
    left, out = {(int(y), int(x)) for y, x in zip(*np.nonzero(mask), strict=True)}, []
    while left:
        todo, piece = [left.pop()], []
        while todo:
            y, x = todo.pop()
            piece.append((y, x))
            for n in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if n in left:
                    left.remove(n)
                    todo.append(n)
        out.append(piece)
    return out


def plain_blobs(a, quantile):
    bins = np.clip(np.floor(a * 1024), 0, 1023).astype(int)
    counts, above, t = np.bincount(bins.ravel(), minlength=1024), a.size * (1 - quantile), 1.0
    for i in range(1023, -1, -1):
        above -= counts[i]
        t = i / 1024
        if above <= 0:
            break
    t, out = min(0.9, max(0.3, t)), []
    work = [(a >= t, t, 0)]
    while work:
        mask, t, depth = work.pop()
        for piece in flood(mask):
            v = np.array([a[p] for p in piece])
            y, x = np.array(piece).T
            peak, side = v.max(), max(np.ptp(y), np.ptp(x)) + 1
            if len(piece) < 4:
                continue
            if len(piece) / side**2 >= 0.4 and side <= 100:
                w = np.maximum(v - (t + peak) / 2, 0)
                w = w if w.sum() > 0 else (v >= peak).astype(float)
                out.append((round(float((w * x).sum() / w.sum()), 6), round(float((w * y).sum() / w.sum()), 6), len(piece), depth))
            elif depth < 6 and peak - t > 0.01:
                inner = np.zeros_like(mask)
                inner[y, x] = v >= t + (peak - t) / 2
                work.append((inner, t + (peak - t) / 2, depth + 1))
    return sorted(out)


def hills(seed, size=60, n=40):
    r = np.random.default_rng(seed)
    y, x = np.mgrid[:size, :size]
    a = r.random((size, size)) * 0.2
    for _ in range(n):
        cy, cx, h, s = r.random(4) * [size, size, 1.2, 3]
        a += h * np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / (1 + s) ** 2)
    return np.minimum(a, 1.0)


@pytest.mark.parametrize("tile", [5, 64])
def test_blobs_equal_a_flood_fill(spark, tile):
    images = {i: hills(i) for i in range(4)}
    got = {}
    for r in blobs.bright_blobs(image_rows(spark, images), quantile=0.7, tile=tile).collect():
        got.setdefault(r.image_id, []).append((round(r.x, 6), round(r.y, 6), r.n, r.depth))
    want = {i: plain_blobs(a, 0.7) for i, a in images.items()}
    assert {i: sorted(v) for i, v in got.items()} == want
    assert any(b[3] > 1 for v in want.values() for b in v)


def test_a_blob_over_many_tiles_is_one(spark):
    # a spiral through all tiles, and one pixel beside it that touches only by a corner
    a = np.zeros((41, 41))
    y, x, dy, dx = 0, 0, 0, 1
    for _ in range(2000):
        a[y, x] = 1
        ny, nx, fy, fx = y + dy, x + dx, y + 2 * dy, x + 2 * dx
        if not (0 <= ny < 41 and 0 <= nx < 41) or (0 <= fy < 41 and 0 <= fx < 41 and a[fy, fx]):
            dy, dx = dx, -dy
            ny, nx = y + dy, x + dx
            if not (0 <= ny < 41 and 0 <= nx < 41) or a[ny, nx]:
                break
        y, x = ny, nx
    rows = image_rows(spark, {7: a}).filter("v > 0")
    labels = blobs.blob_labels(rows, ["image_id"], tile=4)
    assert labels.select("label").distinct().count() == len(flood(a > 0)) == 1 and labels.count() == int(a.sum())
    assert labels.agg(F.min("label")).first()[0] == 0


def test_blobs_of_empty_flat_and_broken_images(spark):
    schema = "image_id long, y long, x long, v double"
    assert blobs.bright_blobs(spark.createDataFrame([], schema)).count() == 0
    nan = [(1, 0, x, float("nan")) for x in range(9)] + [(1, 1, x, None) for x in range(9)] + [(2, y, x, 0.1) for y in range(9) for x in range(9)]
    assert blobs.bright_blobs(spark.createDataFrame(nan, schema)).count() == 0
    flat = spark.createDataFrame([(3, y, x, 1.0) for y in range(9) for x in range(9)], schema)
    r = blobs.bright_blobs(flat).first()
    assert (round(r.x, 9), round(r.y, 9), r.n, r.peak, r.depth) == (4.0, 4.0, 81, 1.0, 0)


def test_search_stars_leave_out_detections_on_a_blob(spark):
    d = spark.createDataFrame([(1, 10.0, 10.0, 5.0), (1, 14.9, 10.0, 4.0), (1, 15.0, 10.0, 3.0), (2, 10.0, 10.0, 2.0)], "image_id long, x double, y double, flux double")
    b = spark.createDataFrame([(1, 10.0, 10.0, 7, 1.0, 0), (3, 1.0, 1.0, 4, 1.0, 0)], "image_id long, x double, y double, n long, peak double, depth int")
    got = sorted((r.image_id, r.x, r.flux) for r in blobs.search_stars(d, b).collect())
    assert got == [(1, 10.0, 45.0), (1, 15.0, 3.0), (2, 10.0, 2.0), (3, 1.0, 6.0)]


def test_connected_ids_of_any_shape(spark):
    edges = [(i, i + 1) for i in range(70)] + [(100, i) for i in range(101, 160)] + [(300, 300), (250, 240), (245, 250)]
    got = {r.id: r.root for r in rounds.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(71)} | {i: 100 for i in range(100, 160)} | {240: 240, 245: 240, 250: 240}
    assert got == want
    assert rounds.connected(spark.createDataFrame([], "a string, b string")).count() == 0


FWHM, SIGMA = 2.0, 1.5
PLANTED = (37.4, 127.4, 217.4, 307.4)


def spiky(stars, size=150, angles=PLANTED, seed=0, noise=2e-4):
    y, x = np.mgrid[:size, :size].astype(float)
    a = np.random.default_rng(seed).random((size, size)) * noise
    for sx, sy, flux, own in stars:
        a += flux * np.exp(-((x - sx) ** 2 + (y - sy) ** 2) / 3)
        for deg in angles if own else ():
            c, s = math.cos(math.radians(deg)), math.sin(math.radians(deg))
            along, across = (x - sx) * c + (y - sy) * s, (y - sy) * c - (x - sx) * s
            a += flux * 0.05 * np.exp(-across**2 / (2 * SIGMA**2)) / (1 + np.abs(along) / 12) * (along > 0)
    return a


def star_rows(spark, images):
    rows = [(i, n, float(x), float(y), float(f), 3.0) for i, stars in images.items() for n, (x, y, f, _) in enumerate(stars)]
    return spark.createDataFrame(rows, "image_id long, star int, x double, y double, flux double, half double")


@pytest.fixture(scope="module")
def field(spark):
    far = (74 + 40 * math.cos(math.radians(PLANTED[0])), 75 + 40 * math.sin(math.radians(PLANTED[0])))
    scenes = {1: [(74, 75, 2.0, True), (*far, 0.3, True), (20.3, 120.6, 0.8, True)], 2: [(60, 60, 1.0, False), (90, 40, 0.7, False)]}
    px, stars = image_rows(spark, {i: spiky(s, seed=i) for i, s in scenes.items()}).cache(), star_rows(spark, scenes)
    dirs = spikes.checkpointed(spikes.spike_directions(px, stars, FWHM))
    width = spikes.checkpointed(spikes.spike_width(px, stars, dirs, FWHM))
    return px, stars, dirs, width, scenes


def test_planted_directions_and_width_are_found(field):
    _, _, dirs, width, _ = field
    got = sorted(r.angle for r in dirs.filter("image_id = 1").collect())
    assert len(got) == 4 and all(abs(a - b) < 1 for a, b in zip(got, PLANTED, strict=True))
    assert dirs.filter("image_id = 2").count() == 0  # an image without spikes
    w = {r.image_id: r.sigma for r in width.collect()}
    assert abs(w[1] - SIGMA) < 0.12 * SIGMA + 0.05 and w[2] == spikes.SPIKE_SIGMA


def bilinear(a, x, y):
    h, w = a.shape
    x0, y0 = math.floor(x), math.floor(y)
    s = t = 0.0
    for j in (0, 1):
        for i in (0, 1):
            if 0 <= x0 + i < w and 0 <= y0 + j < h:
                k = ((x - x0) if i else 1 - (x - x0)) * ((y - y0) if j else 1 - (y - y0))
                s, t = s + k * a[y0 + j, x0 + i], t + k
    return s / t if t > 0 else 0.0


def excess(a, sx, sy, deg, r, side):
    c, s = math.cos(math.radians(deg)), math.sin(math.radians(deg))
    x, y = sx + r * c, sy + r * s
    return bilinear(a, x, y) - 0.5 * (bilinear(a, x - side * s, y + side * c) + bilinear(a, x + side * s, y - side * c))


def test_falloff_never_rises_and_equals_plain_sums(spark, field):
    px, stars, dirs, width, scenes = field
    fall = {r.r: r.t for r in spikes.spike_falloff(px, stars, dirs, width, FWHM).filter("image_id = 1").collect()}
    assert len(fall) == spikes.SPIKE_MAX and all(fall[r] <= fall[r - 1] for r in range(1, spikes.SPIKE_MAX)) and fall[0] > 0
    a = spiky(scenes[1], seed=1)
    sigma = width.filter("image_id = 1").first().sigma
    rays = [(x, y, f, d.angle) for d in dirs.filter("image_id = 1").collect() for x, y, f, _ in scenes[1]]
    first = 3 + 2 + 2
    raw = [sum(excess(a, x, y, d, r, max(3, 3 * sigma)) / f for x, y, f, d in rays) / len(rays) for r in range(first, 200)]
    smooth = [max(0.0, float(np.mean(raw[max(0, k - 8):k + 9]))) for k in range(len(raw) - 8)]
    want = np.minimum.accumulate(smooth)
    assert [fall[r] for r in range(first, first + len(want))] == pytest.approx(want.tolist(), abs=1e-9) and fall[0] == fall[first]


def test_own_spikes_are_kept_and_borrowed_ones_dropped(spark, field):
    px, stars, dirs, width, _ = field
    fall = spikes.checkpointed(spikes.spike_falloff(px, stars, dirs, width, FWHM))
    noise = spark.createDataFrame([(1, 2e-4), (2, 2e-4)], "image_id long, noise double")
    fits = spikes.checkpointed(spikes.fit_spikes(px, stars, dirs, width, fall, noise, FWHM))
    by = {}
    for r in fits.collect():
        by.setdefault(r.star, set()).add(round(r.angle))
    assert len(by[0]) == 4 and len(by[2]) == 4
    kept = {}
    for r in spikes.own_spikes(fits, stars, width).collect():
        kept.setdefault(r.star, set()).add(round(r.angle))
    assert kept[0] == by[0] and kept[2] == by[2]
    # star 1 lies on star 0's first spike: what runs that way is not its own
    lost = by[1] - kept.get(1, set())
    assert lost == {a for a in by[1] if min(abs(a - PLANTED[0]) % 180, 180 - abs(a - PLANTED[0]) % 180) < 2} and lost


def test_a_dropped_spike_takes_no_other_along(spark):
    # three stars in a row, each on the one before's spike; the second loses its spike to the first, so the third only lies on the first's if that reaches
    rows = [(1, s, x, 50.0, f, 2.0) for s, x, f in ((0, 0.0, 9.0), (1, 30.0, 5.0), (2, 60.0, 1.0))]
    stars = spark.createDataFrame(rows, "image_id long, star int, x double, y double, flux double, half double")
    width = spark.createDataFrame([(1, 1.0)], "image_id long, sigma double")
    for reach, left in ((40.0, {0, 2}), (70.0, {0})):
        spike = spark.createDataFrame([(1, s, 0.0, 4.0, 1.0, reach) for s in range(3)], "image_id long, star int, angle double, start double, scale double, reach double")
        assert {r.star for r in spikes.own_spikes(spike, stars, width).collect()} == left


def test_own_spikes_equal_all_pairs(spark):
    r = random.Random(8)
    place = [(1, s, r.uniform(0, 300), r.uniform(0, 300), r.uniform(0, 9), 2.0) for s in range(120)]
    ray = [(1, s, a, 4.0, 1.0, r.uniform(20, 200)) for s in range(120) for a in (12.0, 102.5, 192.0, 282.5)]
    stars = spark.createDataFrame(place, "image_id long, star int, x double, y double, flux double, half double")
    spike = spark.createDataFrame(ray, "image_id long, star int, angle double, start double, scale double, reach double")
    got = {(x.star, x.angle) for x in spikes.own_spikes(spike, stars, spark.createDataFrame([(1, 0.9)], "image_id long, sigma double")).collect()}
    at, left = {s: (x, y, f) for _, s, x, y, f, _ in place}, {(s, a): (b, e) for _, s, a, b, _, e in ray}
    for s in sorted(at, key=lambda s: -at[s][2]):
        for t, (x, y, f) in at.items():
            for a in (12.0, 102.5, 192.0, 282.5):
                if (t, a) in left and f > at[s][2]:
                    dx, dy, c, n = at[s][0] - x, at[s][1] - y, math.cos(math.radians(a)), math.sin(math.radians(a))
                    if left[t, a][0] <= dx * c + dy * n <= left[t, a][1] and abs(dy * c - dx * n) <= 2.7:
                        for b in (a, (a + 180) % 360):
                            left.pop((s, b), None)
    assert got == set(left)


def test_directions_in_images_that_are_not_filled(spark, tmp_path):
    # the last image of a table seldom has all of its hundred embeddings: it is 80 by 80 all the same
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM '/root/testdata/sf0.1/embeddings.parquet' WHERE vec_id // 100 IN (7, 15) AND vec_id % 100 < 4 + 5 * (vec_id // 100)) TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    df, cur = entry.queries()["spike_directions"](spark, str(tmp_path)), con.execute(entry.oracle_sql()["spike_directions"])
    want_cols, want = [d[0] for d in cur.description], cur.fetchall()
    assert want and difference([tuple(r) for r in df.collect()], df.columns, want, want_cols) is None

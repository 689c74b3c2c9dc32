"""Residuals under distortion, core labels, ownership and sparse medians against plain numpy."""

import numpy as np
import pytest

from skytable.operators import frames, pixels, sky

A = [(2, 0, 8.0e-6), (0, 2, -5.0e-6), (1, 1, 3.0e-6), (3, 0, 3.0e-9)]
B = [(2, 0, 3.0e-6), (1, 1, -6.0e-6), (0, 2, 6.0e-6), (0, 3, -3.0e-9)]
CR = (500.5, 400.5)


def warp(u, v, a, b):
    return u + sum(c * u**p * v**q for p, q, c in a), v + sum(c * u**p * v**q for p, q, c in b)


def plain_residuals(det, cat, a, b, tolerance):
    out = {}
    for i, (x, y) in det.items():
        u, v, h = x + 1 - CR[0], y + 1 - CR[1], 0.5
        ux, uy = warp(u, v, a, b)
        place = np.array([ux + CR[0] - 1, uy + CR[1] - 1])
        cols = [(np.array(warp(u + du, v + dv, a, b)) - np.array(warp(u - du, v - dv, a, b))) / (2 * h) for du, dv in ((h, 0), (0, h))]
        near = min(cat, key=lambda k: np.hypot(*(place - cat[k])))
        back = np.linalg.solve(np.column_stack(cols), place - cat[near])
        if np.hypot(*back) <= tolerance:
            out[i] = (near, float(np.hypot(*back)))
    return out


@pytest.mark.parametrize("sip", [True, False])
def test_residuals_of_a_distorted_field(spark, sip):
    r = np.random.default_rng(3)
    a, b = (A, B) if sip else ([], [])
    det = {i: tuple(p) for i, p in enumerate(r.random((300, 2)) * [1000, 800])}
    cat = {}
    for i, (x, y) in det.items():
        ux, uy = warp(x + 1 - CR[0], y + 1 - CR[1], a, b)
        cat[1000 + i] = np.array([ux + CR[0] - 1, uy + CR[1] - 1]) + r.normal(0, 0.7, 2)
    term = "array<struct<p:int,q:int,c:double>>"
    d = spark.createDataFrame([(1, i, float(x), float(y), *CR, a if sip else None, b if sip else None) for i, (x, y) in det.items()],
                              f"image_id int, det_id int, x double, y double, crpix1 double, crpix2 double, sip_a {term}, sip_b {term}")
    s = spark.createDataFrame([(1, k, float(x), float(y)) for k, (x, y) in cat.items()] + [(2, 5, 10.0, 10.0)], "image_id int, star_id int, x double, y double")
    got = {x.det_id: (x.star_id, x.residual) for x in sky.distorted_residual(s, d).collect()}
    want = plain_residuals(det, cat, a, b, 3.0)
    assert got.keys() == want.keys() and len(want) > 280
    assert all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-9 for i in want)
    if not sip:
        plain = {x.det_id: x.residual for x in sky.nearest_residual(s.filter("image_id = 1"), d).collect()}
        assert plain.keys() == got.keys() and all(abs(plain[i] - got[i][1]) < 1e-9 for i in got)


def test_distortion_on_lines_counted_from_the_other_end(spark):
    from pyspark.sql import functions as F
    term = "array<struct<p:int,q:int,c:double>>"
    row = spark.createDataFrame([(A, B)], f"a {term}, b {term}")
    ta, tb = sky.top_down_sip(F.col("a"), F.col("b"))
    got = row.select(ta.alias("a"), tb.alias("b")).first()
    u, v = 120.0, 75.0
    x, y = warp(u, v, A, B)
    fx, fy = warp(u, -v, [tuple(t) for t in got.a], [tuple(t) for t in got.b])
    assert (fx, -fy) == pytest.approx((x, y), abs=1e-12)


def test_a_bright_neighbour_does_not_move_a_ring(spark):
    y, x = np.mgrid[:30, :30]
    clean = 0.5 * np.exp(-np.hypot(x - 12, y - 12) / 3)
    near = clean + 5.0 * ((abs(x - 19) <= 4) & (abs(y - 12) <= 7))
    stars = spark.createDataFrame([(1, 0, 12.0, 12.0)], "image_id int, star int, sx double, sy double")
    dets = spark.createDataFrame([(1, 0, 11, 11, 14, 14), (1, 1, 16, 6, 23, 19)], "image_id int, star int, x0 int, y0 int, x1 int, y1 int")
    labels = pixels.core_labels(dets, 1.0)

    def rings(a, **kw):
        px = spark.createDataFrame([(1, int(j), int(i), float(a[j, i])) for j in range(30) for i in range(30)], "image_id int, y int, x int, v double")
        return {r.r: r.raw for r in pixels.ring_profile(px, stars, 8, **kw).collect()}
    assert max(abs(rings(near, labels=labels)[k] - rings(clean, labels=labels)[k]) for k in range(2, 9)) == 0
    assert any(abs(rings(near)[k] - rings(clean)[k]) > 0.001 for k in range(2, 9))


@pytest.mark.parametrize("halo_mode", [False, True])
def test_ownership_equals_filling_in_order(spark, halo_mode):
    r = np.random.default_rng(4)
    size, sprites, others = 40, [], []
    for k in range(12):
        x, y, w = *r.integers(0, size, 2), int(r.integers(1, 4))
        rect = (int(x - w), int(y - w), int(x + w + 1), int(y + w + 1))
        if k % 4 == 3:
            others.append((1, *rect))
        else:
            sprites.append((1, k, float(x) + 0.3, float(y), float(r.integers(1, 5)), *rect, rect[0] - 4, rect[1] - 3, rect[2] + 3, rect[3] + 5, float(w + 3)))
    owner = np.full((size, size), -1)

    def part(a, b, c, d):
        return slice(max(0, b), min(size, d)), slice(max(0, a), min(size, c))
    for _, *rect in () if halo_mode else others:
        owner[part(*rect)] = -2
    for s in sprites:
        v = owner[part(*s[5:9])]
        v[v != -2] = s[1]
    yy, xx = np.mgrid[:size, :size]
    for s in sorted(sprites, key=lambda s: -s[4]):
        p = part(*s[9:13])
        near = (np.hypot(xx - s[2], yy - s[3]) < s[13])[p] if halo_mode else True
        v = owner[p]
        v[(v == -1) & near] = s[1]
    px = spark.createDataFrame([(1, j, i) for j in range(size) for i in range(size)], "image_id int, y int, x int")
    names = "image_id int, star int, x double, y double, flux double, x0 int, y0 int, x1 int, y1 int, fx0 int, fy0 int, fx1 int, fy1 int, outer double"
    got = pixels.sprite_owner(px, spark.createDataFrame(sprites, names), spark.createDataFrame(others, "image_id int, x0 int, y0 int, x1 int, y1 int"), halo_mode=halo_mode)
    out = np.full((size, size), -1)
    for row in got.collect():
        out[row.y, row.x] = -1 if row.owner is None else row.owner
    assert np.array_equal(out, np.where(owner == -2, -1, owner))


def test_sparse_median_equals_cutting_round_by_round(spark):
    r = np.random.default_rng(5)
    images = {1: r.normal(10, 1, (60, 60)), 2: np.where(r.random((60, 60)) < 0.2, 50 + 30 * r.random((60, 60)), r.normal(3, 0.1, (60, 60))), 3: np.full((9, 9), 2.0), 4: np.full((5, 5), np.nan)}
    px = spark.createDataFrame([(i, y, x, float(v)) for i, a in images.items() for (y, x), v in np.ndenumerate(a)], "image_id long, y int, x int, v double")
    want = {}
    for i, a in images.items():
        v = np.sort(a.reshape(-1)[::7])
        v = v[~np.isnan(v)]
        for _ in range(5):
            if len(v):
                m = v[len(v) // 2]
                mad = np.sort(abs(v - m))[len(v) // 2]
                kept = v[v <= m + 3 * (1.4826 * mad if mad else 1.0) / 1.4826]
                v = kept if len(kept) >= 10 else v
        if len(v):
            want[i] = v[len(v) // 2]
    got = {x.image_id: x.median for x in pixels.sparse_median(px).collect()}
    assert got == pytest.approx(want) and 4 not in got


def test_shared_stretch_takes_the_median_to_the_target(spark):
    f = spark.createDataFrame([(1, "L", 0.2), (2, "L", 0.1), (3, "L", 0.3), (4, "R", 0.5), (5, "R", None)], "frame_id long, filter string, background double")
    px = spark.createDataFrame([(i, 0, x, 0.02 * i + 0.0005 * x) for i in (1, 2, 3) for x in range(41)], "image_id long, y int, x int, v double")
    rows = frames.shared_stretch(f, px).collect()
    assert [(r.filter, r.frame_id) for r in rows] == [("L", 1)]
    m, x = rows[0].midtone, 0.03 - rows[0].shadows
    assert rows[0].shadows == pytest.approx(0.03 - 2.8 * 1.4826 * 0.005) and (m - 1) * x / ((2 * m - 1) * x - m) == pytest.approx(0.25)

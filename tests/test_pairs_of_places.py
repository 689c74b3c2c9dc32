"""Places that crowd: the same results, from joins that do not make every pair of them."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from check import difference
from skytable.operators import match, objects, sky
from skytable.plans import match_queries
from skytable.sources import catalogues

SF = "/root/testdata/sf0.001"
KEYS = {"customer": ("c_custkey",), "part": ("p_partkey",), "orders": ("o_orderkey", "o_custkey")}


def join_rows(spark, run):
    """What ``run`` returns, and how many rows came out of joins meanwhile."""
    bus = spark.sparkContext._jsc.sc().listenerBus()
    store = spark._jsparkSession.sharedState().statusStore()
    bus.waitUntilEmpty()
    seen = {e.executionId() for e in (store.executionsList().apply(i) for i in range(store.executionsList().size()))}
    got = run()
    bus.waitUntilEmpty()
    total, runs = 0, store.executionsList()
    for i in range(runs.size()):
        e = runs.apply(i).executionId()
        if e in seen:
            continue
        values, nodes = store.executionMetrics(e), store.planGraph(e).allNodes()
        for k in range(nodes.size()):
            node = nodes.apply(k)
            for m in range(node.metrics().size()) if "Join" in node.name() else ():
                metric = node.metrics().apply(m)
                value = values.get(metric.accumulatorId())
                if metric.name() == "number of output rows" and value.isDefined():
                    total += int(value.get().replace(",", ""))
    return got, total


def grown(folder, copies, *tables):
    """Tables of sf0.001 so many times over, with shifted keys."""
    folder.mkdir()
    con = duckdb.connect()
    for t in sorted(os.listdir(SF)):
        name = t.split(".")[0]
        if name in tables:
            shift = {k: con.execute(f"SELECT max({KEYS[name][0] if k.split('_')[1] != 'custkey' else 'c_custkey'}) + 1 FROM '{SF}/{name if k.split('_')[1] != 'custkey' else 'customer'}.parquet'").fetchone()[0] for k in KEYS[name]}
            cols = ", ".join(f"CAST({k} + i * {s} AS BIGINT) AS {k}" for k, s in shift.items())
            con.execute(f"COPY (SELECT * REPLACE ({cols}) FROM '{SF}/{t}', range({copies}) r(i)) TO '{folder}/{t}' (FORMAT parquet)")
        elif t.endswith(".parquet"):
            (folder / t).symlink_to(f"{SF}/{t}")
        if t.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{t}'")
    return str(folder), con


def run_and_compare(spark, name, folder, con):
    df = entry.queries()[name](spark, folder)
    got = [tuple(r) for r in df.collect()]
    if name in entry.oracle_sql():
        cur = con.execute(entry.oracle_sql()[name])
        assert difference(got, df.columns, cur.fetchall(), [d[0] for d in cur.description]) is None
    return got


def growth(spark, tmp_path, name, few, many, *tables):
    """How often more rows come out of joins on ``many`` copies than on ``few``; both results are compared with the SQL."""
    counts = []
    for n in (few, many):
        folder, con = grown(tmp_path / str(n), n, *tables)
        counts.append(join_rows(spark, lambda folder=folder, con=con: run_and_compare(spark, name, folder, con))[1])
    return counts[1] / counts[0]


def apart(ra1, dec1, ra2, dec2):
    a1, d1, a2, d2 = (np.radians(v) for v in (ra1, dec1, ra2, dec2))
    return np.degrees(np.arccos(np.clip(np.cos(d1) * np.cos(a1) * np.cos(d2) * np.cos(a2) + np.cos(d1) * np.sin(a1) * np.cos(d2) * np.sin(a2) + np.sin(d1) * np.sin(d2), -1, 1)))


def crowd(n):
    r = np.random.default_rng(7)
    return [(i, f"O{i}", float((355 + 14 * r.random()) % 360), float(-6 + 12 * r.random()), float(r.integers(0, 30))) for i in range(n)]


def test_search_order_of_a_crowd(spark):
    rows = crowd(1500)
    c = spark.createDataFrame([(*o, "", "") for o in rows], "seq long, id string, ra double, dec double, diameter double, name string, messier string")
    h = spark.createDataFrame([(1, 2.0, 0.0), (2, 2.5, 0.5)], "seq long, ra double, dec double")
    got, made = join_rows(spark, lambda: {(x.ra, x.dec) for x in objects.search_order(h, c, 30.0, 2.0).filter("priority IN (0, 3)").collect()})
    places = [(2.0, 0.0), (2.5, 0.5)] + [(ra, dec) for _, _, ra, dec, _ in sorted(rows, key=lambda o: (-o[4], o[0]))]
    want = []
    for p in places:
        # popular objects that the list of names places itself lie elsewhere
        if all(apart(*p, *q) >= 2.0 for q in want):
            want.append(p)
    assert got == set(want)
    assert made < 40_000


def test_targets_in_a_crowd(spark):
    rows = crowd(6000)
    r = np.random.default_rng(8)
    fields = [(i, float((355 + 14 * r.random()) % 360), float(-6 + 12 * r.random()), float(2 + r.integers(0, 3))) for i in range(200)] + [(900, 100.0, 0.0, 3.0)]
    c = spark.createDataFrame([(*o[1:4], None if o[0] % 50 == 0 else o[4]) for o in rows], "id string, ra double, dec double, diameter double")
    f = spark.createDataFrame(fields, "field_id long, ra double, dec double, radius double")
    got, made = join_rows(spark, lambda: {x.field_id: (x.best, x.runner_up) for x in objects.pick_targets(f, c, 2.0).collect()})
    ra, dec = np.array([o[2] for o in rows]), np.array([o[3] for o in rows])
    want = {}
    for i, a, d, radius in fields:
        sep = apart(ra, dec, a, d)
        inside = sorted((o for o in rows if sep[o[0]] <= radius), key=lambda o: (o[0] % 50 == 0, -o[4] / (1 + sep[o[0]] / radius), -o[4], o[1]))
        if inside:
            want[i] = (inside[0][1], inside[1][1])
    assert got == want and len(want) > 150
    assert made < 145_000


def test_verified_places_of_many_stars(spark):
    spots = [(60.0 + 120 * i, 50.0 + 100 * k) for i in range(5) for k in range(4)]
    rows = [(n * 100 + c, x, y, 9.0 + (7 * n + 3 * c) % 10) for n, (x, y) in enumerate(spots) for c in range(60)]
    s = 0.002
    h = spark.createDataFrame([(1, "h", 600.0, 400.0, 10.0, 0.0, 10.0, 0.0, s, 0.0, -300 * s, -200 * s, 0, s, 1, 1)], "image_id int, hyp_id string, width double, height double, "
                              "ra0 double, dec0 double, ra double, dec double, a double, b double, tx double, ty double, parity int, scale double, place int, count int")
    sky = spark.createDataFrame(rows, "star_id long, x double, y double, g double").selectExpr("star_id", "10D + (x - 300) * 0.002D AS ra", "(y - 200) * 0.002D AS dec", "g")
    dets = spark.createDataFrame([(1, n, x, y, 100.0 - n) for n, (x, y) in enumerate(spots)], "image_id int, det_id int, x double, y double, flux double")
    (row,), made = join_rows(spark, lambda: match.verify(h, sky, dets).collect())
    assert (row.matches, row.of, row.spread) == (20, 1200, 9)
    assert made < 3000


def test_matched_places_are_the_sequential_choice(spark):
    # places on a small grid, so that distances tie from every side and groups of ties cross
    r = np.random.default_rng(2)
    stars = [(int(i), float(r.integers(0, 5)), float(r.integers(0, 3)), [8.0, 8.0, 9.5, None, float("nan")][r.integers(0, 5)]) for i in r.permutation(60)]
    dets = [(int(i), float(r.integers(0, 10)) / 2, float(r.integers(0, 3)), int([1, 6][r.integers(0, 2)])) for i in r.permutation(45)]
    s = spark.createDataFrame(stars, "star_id long, x double, y double, g double")
    d = spark.createDataFrame(dets, "det_id long, x double, y double, half_width int")
    used_s, used_d, want = set(), set(), set()
    for g, r2, a, b in sorted((p.g, p.r2, p.star_id, p.det_id) for p in sky.crossmatch(s, d).collect()):
        if a not in used_s and b not in used_d:
            want.add((a, b, g, r2)), used_s.add(a), used_d.add(b)
    assert {(p.star_id, p.det_id, p.g, p.r2) for p in sky.matched_places(s, d).collect()} == want
    # an id in several places is still one star
    more = s.unionByName(s.filter("star_id < 9").selectExpr("star_id", "x + 1 AS x", "y", "g"))
    ids = [{(p.star_id, p.det_id) for p in m.collect()} for m in (sky.matched_places(more, d), sky.matched(sky.crossmatch(more, d)))]
    assert ids[0] == ids[1] and len(ids[0]) == len({a for a, _ in ids[0]})


def test_crowds_are_matched_without_their_pairs(spark):
    s = spark.range(3000).selectExpr("id AS star_id", "CAST(id % 3 * 100 AS DOUBLE) AS x", "0D AS y", "CAST(id % 3 AS DOUBLE) AS g")
    d = spark.range(2400).selectExpr("id AS det_id", "CAST(id % 3 * 100 AS DOUBLE) AS x", "0.5D AS y", "1 AS half_width")
    got, made = join_rows(spark, lambda: [(r.star_id, r.det_id) for r in sky.matched_places(s, d).select("star_id", "det_id").collect()])
    assert sorted(got) == [(i, i) for i in range(2400)]
    assert made < 60_000


@pytest.mark.parametrize("name, few, many, tables, limit", [
    ("find_cluster", 12, 48, ("customer",), 6.4), ("solve_history", 4, 16, ("orders",), 1.5),
    ("distorted_residual", 30, 120, ("customer",), 1.3), ("residual_statistic", 30, 120, ("customer",), 1.3)])
def test_rows_of_joins_follow_the_tables(spark, tmp_path, name, few, many, tables, limit):
    assert growth(spark, tmp_path, name, few, many, *tables) < limit


def test_regions_hold_every_star_once(spark, tmp_path):
    r = np.random.default_rng(4)
    stars = [(i, float((359.5 + 2 * r.random()) % 360), float(-1 + 2 * r.random()), float(8 + i % 10)) for i in range(900)]
    s = spark.createDataFrame([*stars, (9000, 0.0, 0.0, float("nan")), (9001, None, 0.0, 9.0), (9002, 50.0, 0.0, 9.0), (9003, *stars[0][1:])],
                              "star_id long, ra double, dec double, g double")
    stars.append((9003, *stars[0][1:]))
    cones = [(i, float((359.8 + r.random()) % 360), float(-0.5 + r.random()), 0.3 + 0.1 * (i % 4), 12.0 + i % 6) for i in range(40)]
    c = spark.createDataFrame(cones, "cone_id long, cone_ra double, cone_dec double, radius double, g_max double")
    root, sizes = str(tmp_path / "regions"), []
    # fainter limits later; the same cones again add nothing
    for part in (c.filter("g_max < 14"), c, c.filter("cone_id < 7")):
        catalogues.build_regions(part, s, root)
        held = spark.read.parquet(root)
        sizes.append((held.count(), held.filter("below is null").count(), held.filter("below is null").select("star_id").distinct().count()))
    assert sizes[1] == sizes[2] and sizes[1][1] == sizes[1][2] == sum(x[3] < 17 for x in stars) > sizes[0][1]
    ra, dec, g = (np.array([x[k] for x in stars]) for k in (1, 2, 3))
    want = {(i, stars[k][0]) for i, a, d, radius, limit in cones for k in np.flatnonzero((apart(ra, dec, a, d) <= radius) & (g < limit))}
    got = [(x.cone_id, x.star_id) for x in catalogues.read_regions(c, root).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_only_reference_frames_meet_pixels(spark, tmp_path):
    folder, con = grown(tmp_path / "16", 16, "orders")
    _, made = join_rows(spark, lambda: run_and_compare(spark, "shared_stretch", folder, con))
    assert made < 5 * spark.read.parquet(f"{folder}/orders.parquet").count()


def test_quads_of_one_code_meet_as_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(match, "BLOCK", 128, raising=False)
    codes = [(i, [0.2, 0.3, 0.4, 0.5]) for i in range(300)] + [(300, [0.205, 0.3, 0.4, 0.5]), (301, [0.22, 0.3, 0.4, 0.5])]
    spark.createDataFrame(codes, "quad_id long, code array<double>").write.parquet(str(tmp_path / "q"))
    monkeypatch.setattr(match_queries, "star_quads", lambda spark, sf: spark.read.parquet(str(tmp_path / "q")))
    rows, joined = join_rows(spark, lambda: match_queries.quad_lookup_join(spark, SF).collect())
    near = {(a, b) for a, x in codes for b, y in codes if abs(x[0] - y[0]) <= 0.01}
    assert len(rows) == len(near) and {tuple(r) for r in rows} == near
    assert joined <= 4000


def plain_quads(stars, low, high, per_cell):
    """Quads of one band by trying every pair, from stars (id, ra, dec, g)."""
    def plane(s, o):
        a, d, a0, d0 = np.radians([s[1], s[2], o[1], o[2]])
        cosc = np.sin(d0) * np.sin(d) + np.cos(d0) * np.cos(d) * np.cos(a - a0)
        return np.degrees(np.cos(d) * np.sin(a - a0) / cosc), np.degrees((np.cos(d0) * np.sin(d) - np.sin(d0) * np.cos(d) * np.cos(a - a0)) / cosc)

    def cell(s):
        row = min(np.ceil(180 / low) - 1, max(0, np.floor((s[2] + 90) / low)))
        n = max(1, int(np.floor(360 * np.cos(np.radians(-90 + (row + 0.5) * low)) / low)))
        return row, int(np.floor(s[1] % 360 / 360 * n)) % n
    stars, made, seen = sorted(stars, key=lambda s: (s[3], s[0])), {}, set()
    for a in stars:
        for b in stars:
            (xb, yb), cos = plane(b, a), np.sin(np.radians(a[2])) * np.sin(np.radians(b[2])) + np.cos(np.radians(a[2])) * np.cos(np.radians(b[2])) * np.cos(np.radians(a[1] - b[1]))
            if a == b or not low <= np.degrees(np.arccos(np.clip(cos, -1, 1))) < high:
                continue
            at = [(s, plane(s, a)) for s in stars if s not in (a, b)]
            held = [(s, p) for s, p in at if (p[0] - xb / 2) ** 2 + (p[1] - yb / 2) ** 2 < (xb * xb + yb * yb) / 4][:2]
            if len(held) < 2:
                continue
            x, y = np.array([[0, xb, *[p[0] for _, p in held]]]), np.array([[0, yb, *[p[1] for _, p in held]]])
            name = "-".join(sorted(str(s[0]) for s in (a, b, held[0][0], held[1][0])))
            if match._codes(x, y)[2][0] and name not in seen:
                seen.add(name)
                made.setdefault(cell(a), []).append(name)
    return {n for names in made.values() for n in names[:per_cell]}


def test_the_index_has_the_quads_of_every_band(spark):
    r = np.random.default_rng(8)
    stars = [(i, float(r.uniform(355, 369)) % 360, float(r.uniform(50, 62)), float(r.integers(8, 14))) for i in range(60)]
    df = spark.createDataFrame(stars, "star_id long, ra double, dec double, g double")
    got = match.quad_index(df).collect()
    bright = [tuple(x) for x in match.brightest_per_cell(df, [b[0] for b in match.BANDS], match.STARS_PER_CELL).select("star_id", "ra", "dec", "g").collect()]
    for k, (low, high) in enumerate(match.BANDS):
        assert {x.quad_id for x in got if x.band == k} == plain_quads(bright, low, high, match.QUADS_PER_CELL)


def test_registered_matches_use_every_band(spark, monkeypatch):
    # bands wider than the field have no quads; the widest two are such
    bands = {x.band for x in entry.queries()["band_quads"](spark, SF).collect()}
    assert bands == set(range(8))
    asked = []
    monkeypatch.setattr(match, "quad_index", lambda stars, bands=match.BANDS: asked.append(bands) or stars.limit(0).selectExpr("0 as band", "'' as quad_id", "array(0.0D) as code", "array(struct(0.0D as x, 0.0D as y)) as points", "0.0D as ra0", "0.0D as dec0"))
    assert entry.queries()["blind_match"](spark, SF).count() == 0 and asked == [match.BANDS]


def test_flags_of_crowded_pairs(spark):
    # places, cores and ids that repeat, no flux and no brightness; then no pair is moved once it is listed
    r = np.random.default_rng(5)
    dets = [(int(r.integers(0, 55)), float(r.integers(0, 4)) * 9.5, float(r.integers(0, 4)) * 9.5, [None, float("nan"), 1.0, 2.0, 3.0, 4.0][r.integers(0, 6)], int(r.integers(1, 4))) for _ in range(60)]
    stars = [(int(r.integers(0, 50)), float(r.integers(0, 4)) * 9.5 + float(r.integers(0, 2)), float(r.integers(0, 4)) * 9.5, [None, 8.0, 8.2, 8.4, 9.0][r.integers(0, 5)]) for _ in range(60)]
    d = spark.createDataFrame(dets, "det_id long, x double, y double, flux double, half_width int")
    s = spark.createDataFrame(stars, "star_id long, x double, y double, g double")
    rects = [(i, np.floor(x - h), np.floor(y - h), np.floor(x + h) + 1, np.floor(y + h) + 1, f) for i, x, y, f, h in dets]

    def known(f):
        return f is not None and np.isfinite(f)
    blend = {a[0] for a in rects for o in rects if a[0] != o[0] and a[1] < o[3] and o[1] < a[3] and a[2] < o[4] and o[2] < a[4]
             and (not known(a[5]) or not known(o[5]) or o[5] >= a[5])}
    want = []
    for p in sky.crossmatch(s, d).collect():
        inside = [(g, i) for i, x, y, g in stars for c in rects if c[0] == p.det_id and c[1] <= x < c[3] and c[2] <= y < c[4] and i != p.star_id]
        want.append((p.star_id, p.det_id, p.det_id in blend, any(g is None or g <= p.g + 0.3 for g, _ in inside)))
    df = sky.crossmatch_flags(d, s)
    assert sorted(tuple(x) for x in df.collect()) == sorted(want) and {x[2:] for x in want} >= {(True, True), (True, False)}
    assert sorted(tuple(x) for x in sky.blend_flags(d, s, sky.crossmatch(s, d)).collect()) == sorted(want)


def test_listed_pairs_are_not_moved(spark):
    df = entry.queries()["blend_flags"](spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "[cx" in next(line for line in plan.splitlines() if "Join" in line)

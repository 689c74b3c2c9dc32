"""Edge cases of the rules, against values worked out by hand or by brute force."""

import hashlib
import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skytable.functions import keys, ordered
from skytable.functions.capture_names import obs_time, parse_capture_names, stamp_key
from skytable.functions.sky import equal_area_cell, healpix_nested, separation, tan_project, tan_unproject, wcs, with_cells_near
from skytable.functions.storage import shared_dir
from skytable.operators import capture, frames, inputs, match, objects, pixels, rounds, sky, stages
from skytable.sources import catalogues, files


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def upper(v):
    return sorted(v)[len(v) >> 1]


# --- order statistics -----------------------------------------------------------------

@pytest.mark.parametrize("small,partitions", [(100_000, 4), (4, 1), (4, 16)])
def test_order_statistics_with_and_without_brackets(spark, monkeypatch, small, partitions):
    monkeypatch.setattr(ordered, "SMALL_GROUP", small)
    monkeypatch.setattr(ordered, "BRACKET", 0.05)
    rng = random.Random(3)
    data = {k: [float(rng.randint(0, 30)) if k == "ties" else rng.gauss(0, 1) for _ in range(n)] for k, n in (("hot", 900), ("ties", 301), ("one", 1), ("two", 2))}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs] + [("hot", float("nan")), ("none", None)], "k string, v double").repartition(partitions)
    got = {r["k"]: r for r in ordered.medians(df, ["k"], "v").join(ordered.upper_medians(df, ["k"], "v", "up").drop("n"), "k")
           .join(ordered.lower_quartiles(df, ["k"], "v").drop("n"), "k").join(ordered.percentiles(df, ["k"], "v", {"p65": 0.65}).drop("n"), "k").collect()}
    assert set(got) == set(data)
    for k, vs in data.items():
        s = sorted(vs)
        assert got[k]["n"] == len(vs)
        assert got[k]["median"] == pytest.approx(float(np.median(vs)), abs=1e-12)
        assert got[k]["up"] == upper(vs)
        assert got[k]["quartile"] == s[len(s) // 4]
        assert got[k]["p65"] == pytest.approx(float(np.percentile(vs, 65)), abs=1e-9)


def test_two_spreads(spark):
    df = spark.createDataFrame([("a", x) for x in (1.0, 1.0, 1.0, 1.0)] + [("b", x) for x in (1.0, 2.0, 4.0, 8.0)], "k string, v double")
    plain = {r["k"]: (r["median"], r["sigma"]) for r in ordered.robust_spread(df, ["k"], "v").collect()}
    up = {r["k"]: (r["median"], r["sigma"]) for r in ordered.robust_spread(df, ["k"], "v", upper=True).collect()}
    assert plain["a"] == (1.0, 0.0) and up["a"] == (1.0, 1.0)
    assert plain["b"] == pytest.approx((3.0, 1.4826 * 1.5)) and up["b"] == pytest.approx((4.0, 1.4826 * 3.0))


def test_neighbours_and_running_totals(spark):
    data = [("a", i, (i * 37) % 11) for i in range(50)] + [("b", 5, 1)]
    df = spark.createDataFrame(data, "k string, t int, v int")
    got = {(r["k"], r["t"]): (r["prev"]["v"] if r["prev"] else None, r["next"]["v"] if r["next"] else None)
           for r in ordered.neighbours(df, ["k"], ["t"], F.floor(F.col("t") / 7), ["v"]).collect()}
    for i in range(50):
        assert got["a", i] == (((i - 1) * 37) % 11 if i else None, ((i + 1) * 37) % 11 if i < 49 else None)
    assert got["b", 5] == (None, None)
    tot = {(r["k"], r["t"]): r["s"] for r in ordered.running_total(df, ["k"], ["t"], F.floor(F.col("t") / 7), F.col("v"), "s").collect()}
    assert tot["a", 49] == sum((i * 37) % 11 for i in range(50)) and tot["a", 3] == sum((i * 37) % 11 for i in range(4))


# --- rounds ------------------------------------------------------------------------------

def test_one_to_one_is_the_sequential_choice(spark):
    rng = random.Random(5)
    pairs = sorted({(rng.randint(0, 25), rng.randint(0, 25)): (float(rng.randint(0, 4)), rng.random()) for _ in range(200)}.items(), key=lambda p: (*p[1], *p[0]))
    used_l, used_r, want = set(), set(), set()
    for (a, b), _ in pairs:
        if a not in used_l and b not in used_r:
            want.add((a, b)), used_l.add(a), used_r.add(b)
    df = spark.createDataFrame([(a, b, g, r) for (a, b), (g, r) in pairs], "l long, r long, g double, d double")
    assert {(x["l"], x["r"]) for x in rounds.one_to_one(df, "l", "r", ["g", "d"]).collect()} == want


def test_chain_of_three_and_shared_detection(spark):
    df = spark.createDataFrame([(1, 10, 8.0, 1.0), (2, 10, 8.5, 0.1), (2, 11, 8.5, 2.0), (3, 11, 9.0, 0.1)], "star_id long, det_id long, g double, r2 double")
    assert {(r["star_id"], r["det_id"]) for r in sky.matched(df).collect()} == {(1, 10), (2, 11)}


def test_ordered_suppression(spark):
    nodes = spark.createDataFrame([(i,) for i in range(60)], "id long")
    edge = {(a, b) for a in range(60) for b in range(a + 1, 60) if (a * 7 + b * 3) % 13 == 0}
    kept = []
    for i in range(60):
        if not any((k, i) in edge for k in kept):
            kept.append(i)
    links = spark.createDataFrame(sorted(edge), "earlier long, later long")
    assert [r["id"] for r in rounds.ordered_suppression(nodes, links, "id").orderBy("id").collect()] == kept


# --- frames ------------------------------------------------------------------------------

FRAME = "frame_id long, filter string, path string, fwhm double, eccentricity double, stars long, psf_snr double"


def night(n, name="L", **odd):
    return [(i, name, f"f{i}", 3.0 + (i % 5) * 0.1, 0.4 + (i % 3) * 0.02, 5000 + 50 * (i % 4), 8.0 + i % 3) for i in range(n)]


def test_gates_need_ten_frames(spark):
    df = spark.createDataFrame(night(9, "nine") + night(10, "ten"), FRAME)
    assert {r["filter"] for r in frames.relative_gates(df).collect()} == {"ten"}


@pytest.mark.parametrize("at", [3, 4, 6])
def test_unusable_metric_is_unmeasurable_and_reaches_no_gate(spark, at):
    data = night(17)
    for i, bad in enumerate((None, float("nan"), 0.0, -1.0, float("inf"))):
        data[i] = (*data[i][:at], bad, *data[i][at + 1:])
    df = spark.createDataFrame(data, FRAME)
    v = {r["frame_id"]: r for r in frames.verdicts(df).collect()}
    assert all(v[i]["state"] == "unmeasurable" and v[i]["reasons"] == ["unmeasured"] for i in range(5))
    assert {r["n"] for r in frames.relative_gates(df).collect()} == {12}


def test_gate_reasons(spark):
    data = [(i, "L", f"f{i}", 4.0 + (1e-6 if i == 9 else 0.0), 0.4 + i * 0.001, 10 + 40 * (i % 3), 8.0 + i) for i in range(10)]
    g = {r["metric"]: r["reason"] for r in frames.relative_gates(spark.createDataFrame(data, FRAME)).collect()}
    assert g["fwhm"] == "spread too small" and g["eccentricity"] == "spread too small" and g["stars"] == "limit not above zero"


def test_frames_without_filter_are_never_rejected(spark):
    data = night(12, "  ")
    data[0] = (0, None, "f0", 30.0, 0.4, 5000, 8.0)
    v = frames.verdicts(spark.createDataFrame(data, FRAME)).filter("frame_id = 0").first()
    assert v["state"] == "approved" and v["reasons"] == [] and v["filter"] == "(no filter)"


def test_typed_limits(spark):
    df = spark.createDataFrame(night(12), FRAME)
    s = frames.default_settings(df)
    typed = spark.createDataFrame([("L", "fwhm", "3.35"), ("L", "stars", "1,000"), ("L", "eccentricity", "x")], "filter string, metric string, text string")
    v = frames.verdicts(df, frames.with_limits(s, typed)).filter("state = 'rejected'").collect()
    assert {r["frame_id"] for r in v} == {4, 9}
    assert v[0]["reasons"] == ["FWHM 3.40 over typed 3.35"] and v[0]["failing"] == ["fwhm"]


def test_flags_without_time_order_call_blur_focus(spark):
    data = [(i, "L", f"f{i}", 6.0 if i == 4 else 3.0, 0.4, 5000, 8.0, 60.0, 100.0, 0.05, None if i == 0 else dt.datetime(2024, 1, 1, 0, i)) for i in range(9)]
    df = spark.createDataFrame(data, FRAME + ", altitude double, psf_flux double, background double, obs_time timestamp")
    f = {r["frame_id"]: r["flags"] for r in frames.anomaly_flags(df).collect()}
    assert f[4] == ["focus"] and all(not f[i] for i in range(9) if i != 4)
    timed = df.withColumn("obs_time", F.coalesce("obs_time", F.lit(dt.datetime(2024, 1, 1))))
    assert {r["frame_id"]: r["flags"] for r in frames.anomaly_flags(timed).collect()}[4] == ["seeing"]
    mixed = spark.createDataFrame([("L", False)], "filter string, uniform boolean")
    assert all(not r["flags"] for r in frames.anomaly_flags(timed, mixed).collect())


def test_three_figures(spark):
    got = [one(spark, frames.three_figures(F.lit(v))) for v in (12345.5, 100.0, 3.14159, 1.0, 0.9, 0.0712)]
    assert got == ["12346", "100", "3.14", "1.00", "0.900", "0.0712"]


# --- captures ------------------------------------------------------------------------------

def test_session_gap_is_strict(spark):
    t = dt.datetime(2024, 1, 1, 22)
    at = [t, t + dt.timedelta(hours=4), t + dt.timedelta(hours=8, seconds=1), None]
    df = spark.createDataFrame([("c", x) for x in at], "card string, ts timestamp")
    assert [(r["session_no"], r["frames"]) for r in capture.sessions(df, ["card"], "ts").orderBy("session_no").collect()] == [(0, 2), (1, 1)]
    assert capture.with_sessions(df, ["card"], "ts").count() == 3


def test_batch_midway_goes_to_the_earlier_session(spark):
    s = spark.createDataFrame([("c", 0, 0, 100), ("c", 1, 300, 400)], "card string, session_no long, first long, last long")
    b = spark.createDataFrame([("c", 0, 200, 200), ("c", 1, 201, 201), ("c", 2, 50, 60), ("c", 3, 900, 900)], "card string, session_no long, first long, last long")
    assert rows(capture.assign_batches(b, s, "card")) == [("c", 0, 0), ("c", 1, 1), ("c", 2, 0), ("c", 3, 1)]


def test_stamps(spark):
    assert one(spark, stamp_key(F.lit("20240229-000001"))) == 1709164801
    for bad in ("20230231-101010", "20231301-000000", "20230101-240000", "2023010-101010", None):
        assert one(spark, stamp_key(F.lit(bad).cast("string"))) is None


def test_obs_time(spark):
    want = 1704067200000
    for text, off in (("2024-01-01T00:00:00", 0), ("'2024-01-01T00:00:00Z'", 0), ("2024-01-01T00:00:00+01:00", -3600000)):
        assert one(spark, obs_time(F.lit(text))) == want + off
    assert one(spark, obs_time(F.lit("yesterday"))) is None


def test_names_with_exposure_in_the_target(spark):
    df = spark.createDataFrame([("Light_M42_30s_180.0s_Bin1_533MC_H_gain100_20240101-220000_-10.0C_0001.fit",), ("Light_M42_180.0s_Bin1_H_gain100_20240101-220000_20240101-220000_-10.0C_1.fit",)], "name string")
    a, b = parse_capture_names(df, "name").orderBy(F.desc_nulls_last("key")).collect()
    assert (a["target"], a["exposure"], a["camera"], a["filter"]) == ("M42_30s", "180.0s", "533MC", "H") and b["key"] is None


def test_collisions_empty_the_schedule(spark):
    lights = spark.createDataFrame([("/a/x.fit", "L"), ("/b/X.FITS", "L")], "path string, filter string")
    none = lights.filter("false")
    assert capture.import_manifest(lights, none, "/o").count() == 0
    assert capture.import_manifest(lights.filter("path = '/a/x.fit'").union(lights.filter("path = '/a/x.fit'")), none, "/o").count() == 1


# --- sky -------------------------------------------------------------------------------------

def test_cone_join_across_the_meridian_and_at_the_pole(spark):
    rng = random.Random(2)
    stars = [(i, rng.uniform(0, 360), math.degrees(math.asin(rng.uniform(-1, 1))), 10.0) for i in range(3000)] + [(9001, 359.9, 0.0, 10.0), (9002, 0.1, 0.0, 10.0), (9003, 200.0, 89.9, 10.0)]
    cones = [(1, 359.95, 0.0, 3.0, 12.0), (2, 0.0, 90.0, 5.0, 12.0), (3, 10.0, -88.0, 12.0, 12.0), (4, 120.0, 45.0, 20.0, 9.0)]
    s = spark.createDataFrame(stars, "star_id long, ra double, dec double, g double")
    c = spark.createDataFrame(cones, "cone_id long, cone_ra double, cone_dec double, radius double, g_max double")
    want = {r["v"] for r in s.crossJoin(c).filter((F.col("g") < F.col("g_max")) & (separation("ra", "dec", "cone_ra", "cone_dec") <= F.col("radius"))).select(F.concat_ws("/", "cone_id", "star_id").alias("v")).collect()}
    for size in (1.0, 7.0):
        got = [r["v"] for r in sky.cone_join(c, s, size).select(F.concat_ws("/", "cone_id", "star_id").alias("v")).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_no_cell_twice(spark):
    c = spark.createDataFrame([(1, 359.9, 89.0, 3.0), (2, 0.0, 0.0, 200.0)], "id long, ra double, dec double, radius double")
    cells = [(r["id"], r["cell"]) for r in with_cells_near(c, "ra", "dec", F.col("radius"), 5.0).collect()]
    assert len(cells) == len(set(cells))
    assert one(spark, equal_area_cell(F.lit(359.999), F.lit(90.0), 5.0)) // 100000 == 35


def test_projection_round_trip_and_far_half(spark):
    w = wcs(324.745, 57.514, 801, 601, (-0.0025, 0.0004, 0.0003, 0.0024))
    p = one(spark, tan_project(F.lit(324.0), F.lit(57.0), w))
    back = one(spark, tan_unproject(F.lit(p["x"]), F.lit(p["y"]), w))
    assert back["ra"] == pytest.approx(324.0, abs=1e-9) and back["dec"] == pytest.approx(57.0, abs=1e-9)
    assert one(spark, tan_project(F.lit(324.745 - 180), F.lit(-57.514), w)) is None


def test_healpix_known_pixels(spark):
    got = [one(spark, healpix_nested(F.lit(ra), F.lit(dec), 0)) for ra, dec in ((45.0, 60.0), (135.0, 60.0), (0.0, 0.0), (90.0, 0.0), (45.0, -60.0), (315.0, -60.0))]
    assert got == [0, 1, 4, 5, 8, 11]


def test_parallax_edges(spark):
    sig = [one(spark, sky.parallax_sigma(F.lit(g).cast("double"))) for g in (None, float("nan"), 15.0, 16.0, 17.0, 17.6, 30.0)]
    assert sig == pytest.approx([0.02, 0.02, 0.02, 0.045, 0.07, 0.10, 0.10])
    assert one(spark, sky.usable_parallax(F.lit(float("nan")), F.lit(10.0))) is None
    assert one(spark, sky.usable_parallax(F.lit(0.083), F.lit(10.0))) == pytest.approx(0.1)


def test_missing_bright_blocks_in_order(spark):
    s = spark.createDataFrame([(1, 10.0, 10.0, 9.0), (2, 14.0, 10.0, 8.0), (3, 18.0, 10.0, 9.0), (4, 50.0, 50.0, 9.0), (5, 90.0, 90.0, 11.0)], "star_id long, x double, y double, g double")
    d = spark.createDataFrame([(1, 51.0, 50.0)], "det_id long, x double, y double")
    assert [r["star_id"] for r in sky.missing_bright(s, d).orderBy("star_id").collect()] == [1, 3]


def test_star_csv_drops_short_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("RA_ICRS,DE_ICRS,Plx,pmRA,pmDE,Gmag,BPmag,RPmag\n1,2,,4,5,6,7,8\n1,2,3\n9,8,7,6,5,4,3,2\n")
    got = catalogues.read_star_csv(spark, str(tmp_path)).orderBy("ra").collect()
    assert [r["ra"] for r in got] == [1.0, 9.0] and got[0]["plx"] is None
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "b.tsv").write_text("ra\tdec\tplx\tpmra\tpmdec\tG\tBP\tRP\n1\t2\t\t4\t5\t6\t7\t8\n1\t2\t3\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        catalogues.read_star_table(spark, str(tmp_path / "t")).collect()


# --- matching fields ---------------------------------------------------------------------------

def test_quad_code_is_the_same_turned_zoomed_and_reordered(spark):
    pts = np.array([[0.0, 0.0], [10.0, 8.0], [4.0, 5.0], [6.0, 3.5]])
    turn = np.array([[math.cos(1.0), -math.sin(1.0)], [math.sin(1.0), math.cos(1.0)]])
    other = (pts[[2, 1, 3, 0]] @ turn.T) * 3.7 + 11
    df = spark.createDataFrame([(1, [tuple(map(float, p)) for p in pts]), (2, [tuple(map(float, p)) for p in other]), (3, [(0.0, 0.0), (1.0, 1.0), (2.0, 0.1), (0.5, 0.5)])], "id int, p array<struct<x:double,y:double>>")
    got = {r["id"]: r["code"] for r in match.with_quad_code(df, "p").collect()}
    assert got[1] == pytest.approx(got[2]) and got[1][0] <= got[1][2] and got[1][0] + got[1][2] <= 1 + 1e-12
    order = {r["id"]: r["order"] for r in match.with_quad_code(df, "p").collect()}
    back = {0: 3, 1: 1, 2: 0, 3: 2}
    assert [back[i] for i in order[1]] == order[2]


def test_log10_chance(spark):
    k, n, p = 5, 20, 0.1
    want = math.log10(sum(math.comb(n, j) * p ** j * (1 - p) ** (n - j) for j in range(k, n + 1)))
    assert one(spark, match.log10_chance(F.lit(k), F.lit(n), F.lit(p))) == pytest.approx(want, rel=1e-12)
    assert one(spark, match.log10_chance(F.lit(0), F.lit(n), F.lit(p))) == 0.0
    assert one(spark, match.log10_chance(F.lit(21), F.lit(n), F.lit(p))) == float("-inf")


def test_search_order_drops_later_neighbours(spark):
    h = spark.createDataFrame([(1, 10.0, 10.0)], "seq long, ra double, dec double")
    c = spark.createDataFrame([(1, "NGC1", 10.5, 10.0, 5.0, "Big", ""), (2, "NGC2", 40.0, 10.0, 3.0, "", "M5"), (3, "NGC3", 40.2, 10.0, 9.0, "", "")], "seq long, id string, ra double, dec double, diameter double, name string, messier string")
    got = objects.search_order(h, c, 30.0, 1.0).filter("priority < 4").orderBy("priority", "rank").collect()
    names = [r["name"] for r in got]
    assert names[0] == "solved before" and "M5" in names and "NGC1" not in names and "NGC3" not in names
    assert {"IC1396A", "B33"} <= set(names)


# --- names -----------------------------------------------------------------------------------

def test_similar_words_are_complete(spark):
    rng = random.Random(1)
    a = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(80)}
    b = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(80)}

    def lev(s, t):
        prev = list(range(len(t) + 1))
        for i, c in enumerate(s, 1):
            cur = [i]
            for j, d in enumerate(t, 1):
                cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (c != d)))
            prev = cur
        return prev[-1]
    want = {(s, t) for s in a for t in b if 1 - lev(s, t) / max(len(s), len(t)) >= 0.75}
    da, db = (spark.createDataFrame([(w,) for w in sorted(x)], "word string") for x in (a, b))
    assert {(r["typed"], r["named"]) for r in objects.similar_words(da, db).collect()} == want


def test_typed_names(spark):
    c = spark.createDataFrame([(1, "NGC7023", 315.4, 68.2, 18.0, "", ""), (2, "IC1396", 324.7, 57.5, 170.0, "", ""), (3, "NGC224", 10.7, 41.3, 190.0, "Andromeda Galaxy", "M31")],
                              "seq long, id string, ra double, dec double, diameter double, name string, messier string")
    q = spark.createDataFrame([("ngc 7023",), ("IC 1396b",), ("messier 31",), ("Irys Nebula",), ("andromda",), ("nothing at all",)], "query string")
    best = {r["query"]: (r["id"], r["score"]) for r in objects.best_object(objects.find_object(q, c)).collect()}
    assert best["ngc 7023"] == ("NGC7023", 1.0) and best["IC 1396b"] == ("IC1396", 0.97) and best["messier 31"] == ("NGC224", 1.0)
    assert best["Irys Nebula"][0] == "NGC7023" and best["andromda"][0] == "NGC224" and "nothing at all" not in best


def test_object_from_path_prefers_the_file(spark):
    c = spark.createDataFrame([(1, "NGC7023", 315.4, 68.2, 18.0, "", ""), (2, "NGC224", 10.7, 41.3, 190.0, "Andromeda Galaxy", "M31")],
                              "seq long, id string, ra double, dec double, diameter double, name string, messier string")
    p = spark.createDataFrame([("/astro/M31/stack_iris_nebula_v2.fits",), ("/astro/M31/night1/frame.fits",), ("/x/y.fits",)], "path string")
    assert {r["path"]: r["id"] for r in objects.object_from_path(p, c).collect()} == {"/astro/M31/stack_iris_nebula_v2.fits": "NGC7023", "/astro/M31/night1/frame.fits": "NGC224"}


def test_angles(spark):
    assert one(spark, objects.parse_angle(F.lit("21 36 42"), True)) == pytest.approx(324.175)
    assert one(spark, objects.parse_angle(F.lit("-57:30:00"), False)) == pytest.approx(-57.5)
    assert one(spark, objects.parse_angle(F.lit("12.5"), False)) == 12.5 and one(spark, objects.parse_angle(F.lit("north"), False)) is None


# --- keys and stages -----------------------------------------------------------------------------

def test_known_keys(spark):
    for path, size, ms, iso in (("/archive/ngc7000/red 01.fits", 98304, 1583020800250, "2020-03-01T00:00:00.250Z"), ("/x", 0, -2500, "1969-12-31T23:59:57.500Z")):
        want = hashlib.sha1(f"file|{path}|{size}|{iso}".encode()).hexdigest()
        assert one(spark, keys.file_source_key(F.lit(path), F.lit(size), F.lit(ms))) == want
    params = F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("x"))
    assert one(spark, keys.params_string(params)) == "a=x;b=2"
    assert one(spark, keys.fnv_hash(F.lit(""))) == "811c9dc5" and one(spark, keys.fnv_hash(F.lit("a"))) == "e40c292c"
    assert one(spark, keys.chain_key(F.lit(None), F.lit("s"), params)) == keys.chain_key_text(None, "s", {"b": "2", "a": "x"})


def test_failed_stage_stores_nothing(spark):
    root = f"{shared_dir(spark)}/stage-test"
    df = spark.range(5)

    def broken(d):
        return d.select(F.raise_error(F.lit("no")).alias("x"))
    good = ("solve", {}, lambda d: d.withColumn("y", F.col("id") + 1))
    with pytest.raises(Exception, match="no"):
        stages.run_chain(df, "k", [good, ("mgc", {}, broken)], root)
    out, ran = stages.run_chain(df, "k", [good, ("mgc", {}, lambda d: d)], root)
    assert ran == ["mgc"] and out.count() == 5


def test_channel_rules_name_what_is_missing(spark):
    s = spark.createDataFrame([("a", "R"), ("a", "G"), ("b", "OSC"), ("b", "L"), ("c", "L"), ("d", "H")], "run string, slot string")
    got = {(r["run"], r["problem"]) for r in inputs.channel_problems(s).collect()}
    assert got == {("a", "RGB needs all of its channels; absent: B."), ("b", "mono and colour masters are mixed"), ("c", "no RGB and no narrowband channel given")}


# --- pixels ------------------------------------------------------------------------------------------

def plane(spark, a, image=0):
    return spark.createDataFrame([(image, y, x, float(v)) for (y, x), v in np.ndenumerate(a)], "image_id long, y int, x int, v double")


def test_blurs_hold_edges(spark):
    a = np.random.default_rng(1).random((6, 9))

    def box(v, r, axis):
        p = np.pad(v, [(r, r) if i == axis else (0, 0) for i in (0, 1)], mode="edge")
        return sum(np.take(p, range(i, i + v.shape[axis]), axis=axis) for i in range(2 * r + 1)) / (2 * r + 1)
    want = a
    for _ in range(3):
        want = box(box(want, 2, 1), 2, 0)
    got = {(r["y"], r["x"]): r["blurred"] for r in pixels.box_blur(plane(spark, a), 2).collect()}
    assert all(got[y, x] == pytest.approx(want[y, x], abs=1e-12) for y, x in got)
    k = np.array(pixels.gaussian_weights(1.3))
    r = len(k) // 2
    p = np.pad(a, ((0, 0), (r, r)), mode="edge")
    h = np.array([[np.dot(k, p[y, x:x + len(k)]) for x in range(9)] for y in range(6)])
    p = np.pad(h, ((r, r), (0, 0)), mode="edge")
    want = np.array([[np.dot(k, p[y:y + len(k), x]) for x in range(9)] for y in range(6)])
    got = {(q["y"], q["x"]): q["blurred"] for q in pixels.gaussian_blur(plane(spark, a), 1.3).collect()}
    assert all(got[y, x] == pytest.approx(want[y, x], abs=1e-12) for y, x in got)


def test_black_point_steps_past_ties(spark):
    a = np.full((200, 200), 0.5)
    a[0, 0], a[10, 10], a[20, 20], a[30, 30], a[40, 40], a[50, 50] = 0.05, 0.06, 0.07, 0.07, 0.07, 0.08
    r = pixels.black_point(plane(spark, a)).first()
    assert (r["robust_min"], r["black"]) == (0.5, 0.06)


def test_flat_top_is_one_star(spark):
    a = np.full((20, 20), 0.1)
    a[8:10, 8:11] = 0.9
    s = pixels.detect_stars(plane(spark, a)).collect()
    assert len(s) == 1 and s[0]["x"] == pytest.approx(9.0) and s[0]["y"] == pytest.approx(8.5)


# --- files ---------------------------------------------------------------------------------------------

def fits(cards, data=b""):
    text = "".join(f"{c:<80}" for c in [*cards, "END"])
    head = text.encode().ljust(-(-len(text) // 2880) * 2880)
    return head + data.ljust(-(-len(data) // 2880) * 2880, b"\0")


def test_fits_files(spark, tmp_path):
    a = np.array([[0, 1, 2], [65535, 4, 5]], dtype=np.int64)
    raw = (a - 32768).astype(">i2").tobytes()
    (tmp_path / "a.fits").write_bytes(fits(["SIMPLE  =                    T", "BITPIX  =                   16", "NAXIS   =                    2", "NAXIS1  =                    3",
                                            "NAXIS2  =                    2", "BZERO   =                32768", "FILTER  = 'O''III   '          / line", "COMMENT none", "EXPTIME =              1.80E+02"], raw))
    (tmp_path / "b.fit").write_bytes(b"not an image")
    z = fits(["SIMPLE  =                    T", "BITPIX  =                    8", "NAXIS   =                    0"]) + fits(
        ["XTENSION= 'BINTABLE'", "BITPIX  =                    8", "NAXIS   =                    2", "NAXIS1  =                    8", "NAXIS2  =                    1", "ZIMAGE  =                    T", "ZNAXIS1 =                   40"], b"12345678")
    (tmp_path / "c.fz").write_bytes(z)
    h = {(r["path"].rsplit("/", 1)[1], r["key"]): r["value"] for r in files.read_fits_headers(spark, str(tmp_path)).collect()}
    assert h["a.fits", "FILTER"] == "O'III" and h["a.fits", "SIMPLE"] == "true" and h["a.fits", "EXPTIME"] == "1.80E+02" and h["c.fz", "ZNAXIS1"] == "40"
    assert not any(f == "b.fit" for f, _ in h) and ("a.fits", "COMMENT") not in h
    px = files.exploded(files.read_fits_pixels(spark, str(tmp_path), "*.fits"))
    got = {(r["y"], r["x"]): r["v"] for r in px.collect()}
    assert got[0, 0] == pytest.approx(1.0) and got[1, 2] == pytest.approx(2 / 65535) and len(got) == 6
    listed = {r["path"].rsplit("/", 1)[1] for r in files.list_frames(spark, str(tmp_path)).collect()}
    assert listed == {"a.fits", "b.fit"}
    files.register_pixel_function(spark)
    spark.read.format("binaryFile").load(str(tmp_path / "a.fits")).createOrReplaceTempView("image_files")
    n = spark.sql("SELECT p.* FROM image_files, LATERAL fits_pixels(content) p").count()
    assert n == 6


def test_unique_names_across_bases(spark):
    from skytable.operators.inputs import unique_names
    for bases, want in ((["a", "a_1", "a"], ["a", "a_1", "a_2"]), (["a", "a", "a_1", "a_1", "a"], ["a", "a_1", "a_1_1", "a_1_2", "a_2"]), (["a_1", "a", "a", "a_2", "a"], ["a_1", "a", "a_2", "a_2_1", "a_3"])):
        rows = spark.createDataFrame(list(enumerate(bases)), "seq long, base string")
        got = unique_names(rows, spark.createDataFrame([], "name string")).orderBy("seq").collect()
        assert [r.unique for r in got] == want

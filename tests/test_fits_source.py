"""FITS as a data source: only what is asked for is read, broken files are rows."""

import numpy as np
import pytest

from skytable.sources import fits


def fits_bytes(cards, data=b""):
    text = "".join(f"{c:<80}" for c in [*cards, "END"])
    return text.encode().ljust(-(-len(text) // 2880) * 2880) + data.ljust(-(-len(data) // 2880) * 2880, b"\0")


def cube(planes, height, width, bits):
    kind = {-32: ">f4", 8: ">u1", 16: ">i2"}[bits]
    a = (np.arange(planes * height * width) % 200).reshape(planes, height, width)
    cards = ["SIMPLE  =                    T", f"BITPIX  = {bits:>20}", "NAXIS   =                    3", f"NAXIS1  = {width:>20}", f"NAXIS2  = {height:>20}", f"NAXIS3  = {planes:>20}"]
    return a, fits_bytes(cards, a[:, ::-1].astype(kind).tobytes())


@pytest.mark.parametrize("part", [700, 5000, 1 << 25])
def test_lines_of_all_partitions_make_the_image(spark, tmp_path, part):
    a, raw = cube(3, 37, 50, -32)
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "deep" / "er" / "a.fits").write_bytes(raw)
    b, raw8 = cube(1, 4, 5, 8)
    (tmp_path / "B.FIT").write_bytes(raw8)
    df = fits.fits_pixels(spark, str(tmp_path), part_bytes=part)
    got = {}
    for r in df.collect():
        assert r.problem is None and (r.path, r.plane, r.y) not in got
        got[r.path, r.plane, r.y] = r.row
    big = {(p, y): v for (path, p, y), v in got.items() if path.endswith("a.fits")}
    assert big == {(p, y): a[p, y].astype(float).tolist() for p in range(3) for y in range(37)}
    small = {y: v for (path, _, y), v in got.items() if path.endswith("B.FIT")}
    assert all(small[y] == pytest.approx((b[0, y] / 255).tolist(), rel=1e-6) for y in range(4))


def test_filters_reach_the_source(spark, tmp_path):
    a, raw = cube(2, 9, 5, 16)
    (tmp_path / "a.fits").write_bytes(raw)
    (tmp_path / "b.fits").write_bytes(b"broken")
    df = fits.fits_pixels(spark, str(tmp_path)).filter("plane = 1 and y >= 3 and y < 5")
    assert {(r.plane, r.y) for r in df.collect()} == {(1, 3), (1, 4)}
    reader = fits.FitsReader({"path": str(tmp_path), "rows": "pixels"})
    list(reader.pushFilters([fits.EqualTo(("plane",), 1), fits.GreaterThanOrEqual(("y",), 3), fits.LessThan(("y",), 5), fits.EqualTo(("path",), str(tmp_path / "a.fits"))]))
    pieces = reader.partitions()
    assert [f[0] for p in pieces for f in p.files] == [str(tmp_path / "a.fits")]
    batches = [b for p in pieces for b in reader.read(p)]
    assert sum(b.num_rows for b in batches) == 2


def test_headers_read_only_their_blocks(spark, tmp_path):
    _, raw = cube(2, 300, 500, -32)
    (tmp_path / "a.fits").write_bytes(raw)
    packed = fits_bytes(["SIMPLE  =                    T", "BITPIX  =                    8", "NAXIS   =                    0"]) + fits_bytes(
        ["XTENSION= 'BINTABLE'", "BITPIX  =                    8", "NAXIS   =                    2", "NAXIS1  =                  800", "NAXIS2  =                 1000", "ZIMAGE  =                    T", "ZNAXIS1 =                   40"], b"1" * 800_000)
    (tmp_path / "c.fz").write_bytes(packed)
    rows = fits.fits_headers(spark, str(tmp_path)).collect()
    read = {r.path: r.bytes_read for r in rows}
    assert sum(read.values()) < 0.01 * (len(raw) + len(packed))
    assert {r.key: r.value for r in rows if r.path.endswith("c.fz")}["ZNAXIS1"] == "40"


def test_broken_files_are_rows(spark, tmp_path):
    _, raw = cube(1, 20, 30, 16)
    (tmp_path / "cut.fits").write_bytes(raw[:3500])
    (tmp_path / "text.fits").write_bytes(b"x" * 9000)
    (tmp_path / "empty.fits").write_bytes(b"")
    (tmp_path / "table.fits").write_bytes(fits_bytes(["SIMPLE  =                    T", "BITPIX  =                    8", "NAXIS   =                    0"]))
    (tmp_path / "endless.fits").write_bytes(b"SIMPLE  =                    T".ljust(80) + b"HISTORY x".ljust(80) * 100)
    pixels = fits.fits_pixels(spark, str(tmp_path), part_bytes=1000).collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in pixels) == ["cut.fits", "empty.fits", "endless.fits", "table.fits", "text.fits"]
    assert all(r.problem and r.row is None for r in pixels)
    headers = fits.fits_headers(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1] for r in headers.filter("problem is not null").collect()} == {"empty.fits", "endless.fits", "text.fits"}


def test_a_folder_without_images(spark, tmp_path):
    assert fits.fits_headers(spark, str(tmp_path)).count() == 0 and fits.fits_pixels(spark, "file:" + str(tmp_path)).count() == 0


def test_the_table_function_takes_arrow_batches(spark):
    spark.createDataFrame([("a", 0, 1, [1.0, 2.0]), ("b", 1, 2, []), ("c", 0, 0, None), ("d", 2, 5, [3.0])], "image string, plane int, y int, row array<float>").createOrReplaceTempView("some_lines")
    fits.register_line_function(spark)
    got = sorted(tuple(r) for r in spark.sql("SELECT * FROM line_pixels(TABLE(some_lines))").collect())
    assert got == [("a", 0, 1, 0, 1.0), ("a", 0, 1, 1, 2.0), ("d", 2, 5, 0, 3.0)]

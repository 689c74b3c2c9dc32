"""WARC archives with damage, and exact search, against brute force."""

import gzip
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skytable.llm import ball_tree, warc

PAGES = "page_id long, url string, html string"


def record(i, payload=b"payload", refers_to=None):
    return warc.record_bytes(i, f"http://a/{i}", payload, hashlib.sha256(payload).hexdigest(), refers_to)


def ids(data):
    return [(r.fields.get("warc-record-id"), r.reason and (r.start, r.end)) for r in warc.salvage(data)]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_goes_on_behind_damage(packed):
    pack = warc.member_bytes if packed else (lambda x: x)
    parts = [pack(record(i, bytes([65 + i]) * 400 + random.Random(i).randbytes(300))) for i in range(6)]
    whole = b"".join(parts)
    assert ids(whole) == [(f"<urn:page:{i}>", None) for i in range(6)]
    at = len(parts[0]) + len(parts[1]) // 2
    broken = whole[:at] + bytes([whole[at] ^ 255]) + whole[at + 1:]
    want = [("<urn:page:0>", None), (None, (len(parts[0]), len(parts[0]) + len(parts[1]))), *[(f"<urn:page:{i}>", None) for i in range(2, 6)]]
    assert ids(broken) == want
    cut = whole[:len(whole) - len(parts[5]) // 2]
    assert ids(cut)[-1] == (None, (len(whole) - len(parts[5]), len(cut))) and len(ids(cut)) == 6
    junk = parts[0] + b"\x1f\x8b\x08 not a member WARC/1.1\r\nx" + parts[1]
    assert [i for i, g in ids(junk) if g is None] == ["<urn:page:0>", "<urn:page:1>"] and len(ids(junk)) == 3
    assert ids(b"") == [] and ids(b"\x00\r\n") == [] and len(ids(b"rubbish")) == 1


def test_salvage_checks_length_and_digest():
    good = record(1)
    assert ids(good.replace(b"payload\r\n", b"pay1oad\r\n"))[0][1] is not None
    assert ids(good.replace(b"Content-Length: ", b"Content-Length: 9"))[0][1] is not None
    quoting = record(2, record(3))
    assert ids(quoting + good) == [("<urn:page:2>", None), ("<urn:page:1>", None)]


def test_salvage_goes_on_inside_of_a_member():
    name = lambda i: f"<urn:page:{i}>"
    r = random.Random(5)
    parts = [record(i, r.randbytes(3000)) for i in range(30)]
    bad = bytearray(parts[3])
    bad[-20] ^= 1
    content = b"".join([*parts[:3], bytes(bad), *parts[4:]])
    packed = gzip.compress(content)
    got = list(warc.salvage(packed))
    assert [x.fields.get("warc-record-id") for x in got if x.reason is None] == [name(i) for i in range(30) if i != 3]
    assert [x.reason.split(" (")[0] for x in got if x.reason] == ["wrong block digest"]
    # a wrong CRC, and a cut tail with a whole member behind it
    wrong = bytearray(gzip.compress(b"".join(parts)))
    wrong[-6] ^= 1
    assert [i for i, gap in ids(bytes(wrong)) if gap is None] == [name(i) for i in range(30)] and any(gap for _, gap in ids(bytes(wrong)))
    cut = gzip.compress(b"".join(parts))
    cut = cut[:len(cut) // 2] + warc.member_bytes(record(99))
    found = [i for i, gap in ids(cut) if gap is None]
    assert found[:10] == [name(i) for i in range(10)] and found[-1] == name(99) and len(found) == len(set(found)) > 12


def test_members_end_in_zero_and_are_plain_gzip():
    data = b"".join(warc.member_bytes(record(i)) for i in range(3))
    assert gzip.decompress(data) == b"".join(record(i) for i in range(3))
    large = warc.member_bytes(bytes(17 << 20))
    assert large[-1] == 0 and len(gzip.decompress(large)) == 17 << 20


def test_archives_round_trip(spark, tmp_path):
    shared = "é" * 60
    rows = [(1, "http://a", shared), (2, None, shared), (0, "b", "x" * 99), (3, "c\r\nd", "x" * 99), (4, "e", None), (5, "f", ""), (None, "g", shared),
            (2, None, shared), (6, "h", "WARC/1.1\r\n\r\n\x00" * 20), (7, "i", "long " * 200_000)]
    df = spark.createDataFrame(rows, PAGES).withColumn("digest", F.lit("clash")).withColumn("bytes", F.lit(1))
    warc.write_archives(df, str(tmp_path / "w"), archive_bytes=1 << 19)
    read = warc.read_archives(spark, str(tmp_path / "w"))
    assert warc.gaps(read).count() == 0
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.resolved(read).collect()), key=str)
    want = [(i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if h == shared and i == 2 else "response", 1 if h == shared and i == 2 else None)
            for i, _, h in rows]
    assert got == sorted(want, key=str)
    assert {bytes(r.payload).decode() for r in read.filter("record_type = 'response'").collect()} == {h or "" for _, _, h in rows}
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_damaged_archive_through_spark(spark, tmp_path):
    data = b"".join(warc.member_bytes(record(i, b"x" * 200 + bytes([i]))) for i in range(5))
    (tmp_path / "a.warc.gz").write_bytes(data[:len(data) // 2] + b"??" + data[len(data) // 2 + 2:])
    read = warc.read_archives(spark, str(tmp_path))
    assert warc.gaps(read).count() == 1 and read.filter("gap is null").count() == 4


def brute(rows, queries, k):
    out = set()
    for q, v in queries:
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q and len(w) == len(v))
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])}
    return out


@pytest.mark.parametrize(("shard", "block"), [(16, 3), (1000, 1000)])
def test_search_is_exact_with_ties(spark, shard, block):
    r = random.Random(1)
    vectors = [(i, [r.choice([-1.0, 0.0, 0.51, 1.0]) for _ in range(5)]) for i in range(150)]
    vectors += [(200, None), (201, [1.0, None, 1.0, 1.0, 1.0]), (202, [float("nan")] * 5), (203, [float("inf")] * 5), (204, []), (205, [1.0, 2.0]), (206, [0.5, 2.0]), (None, [1.0] * 5)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("dim", F.lit(1)).withColumn("v", F.lit(2))
    rows = ball_tree.quantised(df)
    got = ball_tree.top_k(rows, rows.filter("vec_id % 5 = 0"), 7, shard_rows=shard, query_block=block).collect()
    fine = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in vectors if i is not None and (i < 200 or i > 204)]
    assert {tuple(x) for x in got} == brute(fine, [(i, v) for i, v in fine if i % 5 == 0], 7)
    assert ball_tree.top_k(rows.limit(0), rows.limit(0), 3).count() == 0


def test_tree_bounds_hold_and_prune():
    g = np.random.default_rng(0)
    centres = g.normal(size=(20, 8)) * 400
    x = np.floor(centres[g.integers(0, 20, 3000)] + g.normal(size=(3000, 8)) * 5)
    tree = ball_tree.BallTree.built(x, 64)
    q = x[:40]
    bound = tree.bounds(q)
    for n, (a, b) in enumerate(zip(tree.begin, tree.end, strict=True)):
        assert ((q @ x[tree.order[a:b]].T).max(axis=1) <= bound[:, n]).all()
    kth = np.sort(q @ x.T, axis=1)[:, -10]
    assert (bound < kth[:, None]).mean() > 0.3


def test_large_components_stay_exact():
    rows = np.array([[1 << 25, -3], [1 << 25, 5], [-(1 << 25), 1]], dtype=np.int64)
    of, found, score = ball_tree.search(np.array([1, 2, 3]), rows, np.array([9]), np.array([[(1 << 25) + 1, 7]], dtype=np.int64), np.full(1, ball_tree._NONE), 2)
    assert dict(zip(found.tolist(), score.tolist(), strict=True)) == {1: (1 << 25) * ((1 << 25) + 1) - 21, 2: (1 << 25) * ((1 << 25) + 1) + 35}


def test_large_finite_vectors_take_part(spark):
    rows = [(0, [1.0, 2.0]), (1, [3e6, -2.0]), (2, [2e6, 5e6]), (3, [1.0, float("inf")]), (4, [None, 1.0]), (5, [0.5, 0.25]), (6, [float("nan"), 1.0])]
    some = ball_tree.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {(r.query_id, r.vec_id): r.score for r in ball_tree.top_k(some, some, 20).collect()}
    v = {i: [math.floor(64 * x) for x in e] for i, e in rows if i in (0, 1, 2, 5)}
    assert got == {(a, b): sum(x * y for x, y in zip(v[a], v[b], strict=True)) for a in v for b in v if a != b}
    far = ball_tree.quantised(spark.createDataFrame([(0, [1e300, 1.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>"))
    with pytest.raises(Exception, match="too large"):
        ball_tree.top_k(far, far, 1).collect()
    far = ball_tree.quantised(spark.createDataFrame([(0, [1e10, 1.0]), (1, [1e10, 1.0])], "vec_id long, embedding array<double>"))
    with pytest.raises(Exception, match="may not fit a long"):
        ball_tree.top_k(far, far, 1).collect()

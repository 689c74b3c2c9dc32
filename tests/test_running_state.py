"""Scans that know their files, and gates from running counts."""

import hashlib
import os
import random

import pandas as pd
from pyspark.sql import functions as F

from skytable.operators import frames as op
from skytable.streaming import ranks, scans


def files(df):
    return {os.path.basename(r.path): r.digest for r in df.collect()}


def asked(spark, root):
    return spark.read.schema(scans.ACTION).parquet(f"{root}/actions").filter("action = 'read'").count()


def test_a_second_scan_opens_no_known_file(spark, tmp_path):
    folder, root = tmp_path / "night [1]", str(tmp_path / "state")
    folder.mkdir()
    for n in range(6):
        (folder / f"f{n}.fits").write_bytes(b"x" * (n + 1))
    first = files(scans.scan(spark, str(folder).replace("[", "\\[").replace("]", "\\]"), root))
    assert first == {f"f{n}.fits": hashlib.sha1(b"x" * (n + 1)).hexdigest() for n in range(6)} and asked(spark, root) == 6
    # other bytes behind the same look: who opened the file would notice
    for n in (2, 3):
        at = folder / f"f{n}.fits"
        was = at.stat()
        at.write_bytes(b"y" * (n + 1))
        os.utime(at, ns=(was.st_atime_ns, was.st_mtime_ns))
    os.utime(folder / "f3.fits", ns=(1, 1_600_000_000_000_000_000))  # touched
    (folder / "f5.fits").unlink()
    (folder / "g.fits").write_bytes(b"new")
    second = files(scans.scan(spark, str(folder).replace("[", "\\[").replace("]", "\\]"), root))
    assert asked(spark, root) == 8
    assert second == {**{k: v for k, v in first.items() if k not in ("f3.fits", "f5.fits")}, "f3.fits": hashlib.sha1(b"yyyy").hexdigest(), "g.fits": hashlib.sha1(b"new").hexdigest()}


def run(spark, root, *rows):
    spark.createDataFrame(list(rows), scans.EVENT).coalesce(1).write.mode("append").parquet(f"{root}/events")
    return scans.settle(spark, root)


def test_late_repeated_and_stale_events_say_nothing(spark, tmp_path):
    root = str(tmp_path / "s")
    acts = run(spark, root, ("a", 1, 10, 100, None), ("a", 1, 10, 100, None), ("a", 1, 10, 101, None))
    assert acts.count() == 1 and scans.unread(acts).count() == 1
    acts = run(spark, root, ("a", 2, 9, 50, None), ("a", 2, 9, 50, "old"))  # a late listing, and a digest of another look
    assert acts.count() == 1
    acts = run(spark, root, ("a", 1, 10, 100, "d1"), ("a", 1, 10, 100, "d1"))
    assert scans.unread(acts).count() == 0 and [r.digest for r in scans.known(acts).collect()] == ["d1"]
    acts = run(spark, root, ("a", 1, 10, 200, None))
    assert acts.count() == 2
    acts = run(spark, root, ("a", 1, 11, 300, None), ("a", 1, 10, 300, "d1"))  # touched while its old digest comes again
    assert scans.unread(acts).count() == 1
    # the digest never came: the next listing asks again
    acts = run(spark, root, ("a", 1, 11, 400, None))
    assert scans.unread(acts).first().seen == 400
    acts = run(spark, root, ("a", 1, 11, 400, "d2"))
    assert [(r.mtime, r.digest) for r in scans.known(acts).collect()] == [(11, "d2")]


def night(spark, n, seed):
    r = random.Random(seed)
    rows = [(f"f{seed}-{i}", r.choice(["L", "L", "R", " ", None]), r.choice([0.0, 2.5, r.gauss(3, 0.2)]), r.choice([None, 0.5, r.uniform(0.3, 0.6)]), r.choice([900, r.randrange(500, 6000)]), r.lognormvariate(2, 1)) for i in range(n)]
    return spark.createDataFrame(rows, "path string, filter string, fwhm double, eccentricity double, stars long, psf_snr double")


def test_running_gates_equal_the_batch_gates_after_every_batch(spark, tmp_path):
    root, cohort = str(tmp_path / "r"), None
    for number, n in enumerate((5, 40, 1, 60)):
        part = night(spark, n, number)
        cohort = part if cohort is None else cohort.unionByName(part)
        got = ranks.count_batch(part, root, number)
        want = op.relative_gates(cohort.withColumn("filter", op.filter_key(F.col("filter"))), gating=op.GATING)
        key = lambda rows: sorted((r["filter"], r.metric, r.n, round(r.median, 9), None if r.sigma is None else round(r.sigma, 9), r.active, r.reason) for r in rows.collect())
        assert key(got) == key(want)
    # the last batch once more: the same version again
    assert key(ranks.count_batch(part, root, number)) == key(want)


def test_earlier_batches_are_not_read_whole(spark, tmp_path):
    root = str(tmp_path / "r")
    for number in range(2):
        ranks.count_batch(night(spark, 50, number), root, number)
    stored = ranks._stored(spark, root, 1)
    rows = stored(spark.createDataFrame([("L", "fwhm", 4400)], "filter string, metric string, bucket long"))
    pushed = rows._jdf.queryExecution().toString().split("PushedFilters")[1]
    assert "EqualTo(metric,fwhm)" in pushed and "bucket" in pushed.split("]")[0], pushed[:400]


def test_paths_are_followed_in_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scans, "BUCKETS", 8, raising=False)
    root = str(tmp_path / "s")
    rows = [(f"p{i}", i, 10, 100, None) for i in range(100)]
    assert run(spark, root, *rows).count() == 100 and run(spark, root, *[(*r[:3], 200, f"d{r[1]}") for r in rows]).count() == 200
    assert spark.read.format("statestore").load(f"{root}/checkpoint").count() <= 8
    assert run(spark, root, *[(p, n, 11 if n % 2 else 10, 300, None) for p, n, *_ in rows]).filter("seen = 300").count() == 50


def test_a_path_of_a_bucket_is_forgotten_alone():
    day = 86_400_000

    class State:
        exists, hasTimedOut, get, now = False, False, None, 0

        def getCurrentProcessingTimeMs(self):
            return self.now

        def update(self, value):
            self.exists, self.get = True, value

        def setTimeoutDuration(self, ms):
            self.due = self.now + ms

        def remove(self):
            self.exists, self.get = False, None
    state, step = State(), scans._followed(10)

    def come(now, *paths):
        state.now = now
        frame = pd.DataFrame([(p, 1, 1, now, None) for p in paths], columns=["path", "size", "mtime", "seen", "digest"])
        return sorted(x for part in step((0,), iter([frame] if paths else []), state) for x in part["path"])
    assert come(0, "a", "b") == ["a", "b"] and state.due == 10 * day
    assert come(6 * day, "b", "c") == ["b", "c"] and state.due == 10 * day
    state.hasTimedOut = True
    assert come(11 * day) == [] and sorted(state.get[0]) == ["b", "c"] and state.due == 16 * day
    assert come(20 * day) == [] and not state.exists

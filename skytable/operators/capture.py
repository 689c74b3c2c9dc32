"""Capture logs: sessions, nights, flats, darks, master flat jobs and import schedules."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skytable.functions.capture_names import EXTENSION, parse_capture_names
from skytable.functions.ordered import null_safe_join
from skytable.functions.storage import checkpointed
from skytable.operators.rounds import ordered_suppression

# Fixed values of the capture rules.
GAP_HOURS = 4
EXPOSURE_ABS = 0.001
EXPOSURE_REL = 0.01
TEMP_TOLERANCE = 3.0
GAIN_TOLERANCE = 0.5
MIN_FLATS = 2
MIN_DARKS = 2

# Two exposures that count as equal lie in the same or in adjacent steps of this scale.
_STEP = math.log(1.03)
_SHORTEST = 0.05


def scan_capture(files: DataFrame, root: str) -> DataFrame:
    """Frames of a card from its file listing (``path``): ``kind`` light, flat, dark or unparseable.

    Lights lie in {Plan,Autorun}/Light/<target>, flats and darks in {Plan,Autorun}/{Flat,Dark}; other files do not
    count. The folder names the target.
    """
    depth = len(root.rstrip("/").split("/"))
    part = F.split("path", "/")

    def at(i: int) -> Column:
        return F.try_element_at(part, F.lit(depth + i))
    size = F.size(part) - depth
    where = (F.when((at(2) == "Light") & (size == 4), "light").when((at(2) == "Flat") & (size == 3), "flat")
             .when((at(2) == "Dark") & (size == 3), "dark"))
    rows = (files.filter(F.array_join(F.slice(part, 1, depth), "/") == root.rstrip("/"))
            .withColumns({"source": at(1), "__kind": where, "__folder": at(3), "name": F.element_at(part, -1)})
            .filter(F.col("source").isin("Plan", "Autorun") & F.col("__kind").isNotNull()))
    rows = parse_capture_names(rows, "name")
    return (rows.withColumn("target", F.when(F.col("key").isNotNull(), F.when(F.col("__kind") == "light", F.col("__folder")).otherwise(F.col("target"))))
            .withColumn("kind", F.when(F.col("key").isNull(), "unparseable").otherwise(F.col("__kind"))).drop("__kind", "__folder"))


def path_inside(path: Column, root: Column) -> Column:
    """Containment by whole path components; trailing slashes do not count."""
    a, b = (F.split(F.regexp_replace(c, "/+$", ""), "/") for c in (path, root))
    return F.slice(a, F.lit(1), F.size(b)) == b


# --- sessions ---------------------------------------------------------------------------

def _local_sessions(df: DataFrame, keys: Sequence[str], ts: str, gap: float) -> DataFrame:
    rows = df.filter(F.col(ts).isNotNull()).withColumn("__t", F.unix_micros(F.col(ts).cast("timestamp")))
    rows = rows.withColumn("__day", F.floor(F.col("__t") / 86_400_000_000).cast("long"))
    w = Window.partitionBy(*keys, "__day").orderBy("__t")
    start = F.coalesce((F.col("__t") - F.lag("__t").over(w) > gap * 1e6).cast("int"), F.lit(0))
    rows = rows.withColumn("__start", start)
    return rows.withColumn("__local", F.sum("__start").over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("__start")


def _joined_sessions(local: DataFrame, keys: Sequence[str], gap: float) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("__first")
    start = F.coalesce((F.col("__first") - F.lag("__last").over(w) > gap * 1e6).cast("int"), F.lit(0))
    return local.withColumn("__start", start).withColumn(
        "session_no", F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__start")


def with_sessions(df: DataFrame, keys: Sequence[str], ts: str, gap_hours: float = GAP_HOURS) -> DataFrame:
    """Add ``session_no``: a new session begins after a gap of more than ``gap_hours``. Rows without a time go.

    Rows are cut into sessions per day first. A day holds a handful, and only those meet in a window per key.
    """
    keys, gap = list(keys), gap_hours * 3600.0
    rows = _local_sessions(df, keys, ts, gap)
    local = rows.groupBy(*keys, "__day", "__local").agg(F.min("__t").alias("__first"), F.max("__t").alias("__last"))
    numbered = _joined_sessions(local, keys, gap).drop("__first", "__last")
    return null_safe_join(rows, numbered, [*keys, "__day", "__local"]).drop("__t", "__day", "__local")


def sessions(df: DataFrame, keys: Sequence[str], ts: str, gap_hours: float = GAP_HOURS) -> DataFrame:
    """Sessions per key: ``session_no``, ``first``, ``last``, ``frames``."""
    keys, gap = list(keys), gap_hours * 3600.0
    rows = _local_sessions(df, keys, ts, gap)
    local = rows.groupBy(*keys, "__day", "__local").agg(
        F.min("__t").alias("__first"), F.max("__t").alias("__last"), F.count("*").alias("__n"))
    return _joined_sessions(local, keys, gap).groupBy(*keys, "session_no").agg(
        F.timestamp_micros(F.min("__first")).alias("first"), F.timestamp_micros(F.max("__last")).alias("last"),
        F.sum("__n").alias("frames"))


def nights(df: DataFrame, keys: Sequence[str], ts: str = "ts", gap_hours: float = GAP_HOURS) -> DataFrame:
    """Per session and target: first, last, frames, sorted filters and the date of the first frame."""
    rows = with_sessions(df, keys, ts, gap_hours).withColumn("__ts", F.col(ts).cast("timestamp"))
    return rows.groupBy(*keys, "session_no", "target").agg(
        F.min("__ts").alias("first"), F.max("__ts").alias("last"), F.count("*").alias("frames"),
        F.sort_array(F.collect_set("filter")).alias("filters"), F.date_format(F.min("__ts"), "yyyy-MM-dd").alias("date"))


def assign_batches(batches: DataFrame, light_sessions: DataFrame, key: str) -> DataFrame:
    """The session of each flat batch: the one nearest its midpoint, the earlier on a tie.

    Both have ``first`` and ``last`` in whole seconds and ``session_no``. Sessions do not overlap, so only the one
    before and the one after a midpoint count; one sort by time finds both.
    """
    mid = F.floor((F.col("first") + F.col("last")) / 2).cast("long")
    s = F.struct(F.col("session_no").alias("no"), "first", "last")
    both = batches.select(key, F.col("session_no").alias("batch_no"), mid.alias("t"), F.lit(None).cast(
        "struct<no:bigint,first:bigint,last:bigint>").alias("s")).unionByName(
        light_sessions.select(key, F.lit(None).cast("long").alias("batch_no"), F.col("first").alias("t"), s.alias("s")))
    w = Window.partitionBy(key).orderBy("t", F.col("s").isNull())
    before = F.last("s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("s", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    both = both.withColumns({"b": before, "a": after}).filter(F.col("batch_no").isNotNull())
    back = F.when(F.col("b").isNotNull(), F.greatest(F.col("t") - F.col("b.last"), F.lit(0).cast("long")))
    ahead = F.col("a.first") - F.col("t")
    choice = F.when(F.col("a").isNull() | (back <= ahead), F.col("b.no")).otherwise(F.col("a.no"))
    return both.select(key, "batch_no", choice.alias("session_no"))


# --- flats and darks ------------------------------------------------------------------------

def match_flats(wants: DataFrame, flats: DataFrame) -> DataFrame:
    """Flats for each light setup (``filter``, ``binning``, ``camera``, ``rotation``), with ``fit`` exact or weak.

    Filter and binning must be stated and equal. Camera and rotation must not clash; a one-sided one is weak.
    """
    f = flats.withColumnsRenamed({c: f"f_{c}" for c in ("camera", "rotation")})
    hits = wants.join(f, ["filter", "binning"])
    clash, soft = F.lit(False), F.lit(False)
    for c in ("camera", "rotation"):
        a, b = F.col(c), F.col(f"f_{c}")
        clash = clash | F.coalesce(a != b, F.lit(False))
        soft = soft | (a.isNull() != b.isNull())
    return hits.filter(~clash).withColumn("fit", F.when(soft, "weak").otherwise("exact")).drop("f_camera", "f_rotation")


def flat_strength(wants: DataFrame, flats: DataFrame) -> DataFrame:
    """How well each light setup is served: ``flats`` and ``strength`` exact, weak or missing."""
    setup = ["filter", "binning", "camera", "rotation"]
    got = match_flats(wants, flats).groupBy(*setup).agg(F.count("*").alias("flats"), F.bool_or(F.col("fit") == "weak").alias("__weak"))
    out = null_safe_join(wants, got, setup, "left")
    return out.select(*setup, F.coalesce("flats", F.lit(0)).cast("long").alias("flats"),
                      F.when(F.col("flats").isNull(), "missing").when(F.col("__weak"), "weak").otherwise("exact").alias("strength"))


def same_exposure(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(a - b) <= F.greatest(F.lit(EXPOSURE_ABS), EXPOSURE_REL * F.greatest(a, b)), F.lit(False))


def compatible(a: Column, b: Column, tolerance: float) -> Column:
    """Equal within the tolerance, or not stated on both sides."""
    return F.coalesce(F.abs(a - b) <= tolerance, F.lit(True))


def exposure_step(exposure: Column) -> Column:
    return F.floor(F.ln(F.greatest(exposure, F.lit(_SHORTEST))) / _STEP).cast("int")


def raw_key(df: DataFrame) -> Column:
    """Name of a raw dark group: exposure in ms, binning and gain, rounded."""
    def part(c: str, scale: int) -> Column:
        return F.coalesce(F.floor(F.col(c) * scale + 0.5).cast("long").cast("string"), F.lit("-"))
    return F.concat(F.lit("e"), part("d_exposure", 1000), F.lit("b"), part("d_binning", 1), F.lit("g"), part("d_gain", 1))


SETTING = ("exposure", "binning", "gain", "temp")


def _suiting_darks(settings: DataFrame, darks: DataFrame) -> DataFrame:
    """Pairs of a flat setting and a dark whose exposure, binning and gain suit and whose temperatures are known."""
    d = darks.select(*[F.col(c).alias(f"d_{c}") for c in ("path", "kind", *SETTING)])
    d = d.filter(F.col("d_temp").isNotNull()).withColumn("__step", F.explode(F.sequence(
        exposure_step(F.col("d_exposure")) - 1, exposure_step(F.col("d_exposure")) + 1)))
    s = settings.filter(F.col("temp").isNotNull()).withColumn("__step", exposure_step(F.col("exposure")))
    return s.join(d, "__step").filter(
        same_exposure(F.col("exposure"), F.col("d_exposure")) & compatible(F.col("binning"), F.col("d_binning"), 0)
        & compatible(F.col("gain"), F.col("d_gain"), GAIN_TOLERANCE)).drop("__step")


def choose_darks(flats: DataFrame, darks: DataFrame) -> DataFrame:
    """The dark of every flat setting (``exposure``, ``binning``, ``gain``, ``temp``): ``tier``, ``pick``, ``darks``.

    Tier 1 is a master within 3 C, tier 2 a master off in temperature, tier 3 a group of at least two raw darks within
    3 C. ``pick`` is a path, or the key of the raw group. Flats and darks are reduced to their settings first.
    """
    settings = flats.select(*SETTING).distinct()
    pairs = _suiting_darks(settings, darks)
    warm = F.abs(F.col("temp") - F.col("d_temp")) <= TEMP_TOLERANCE
    off = F.abs(F.col("exposure") - F.col("d_exposure"))

    def rank(tier: Column, d_temp: Column, count: Column, pick: Column) -> Column:
        return F.struct(tier.alias("tier"), off.alias("d_exposure"), F.abs(F.col("temp") - d_temp).alias("d_temp"),
                        (-count).alias("fewer"), pick.alias("pick"))
    masters = pairs.filter(F.col("d_kind") == "master").select(*SETTING, rank(
        F.when(warm, 1).otherwise(2), F.col("d_temp"), F.lit(1).cast("long"), F.col("d_path")).alias("r"))
    groups = (pairs.filter((F.col("d_kind") != "master") & warm).withColumn("__key", raw_key(pairs))
              .groupBy(*SETTING, "__key").agg(F.count("*").alias("n"), F.avg("d_temp").alias("t"),
                                              F.min(F.struct("d_path", "d_exposure")).alias("first"))
              .filter(F.col("n") >= MIN_DARKS).withColumn("d_exposure", F.col("first.d_exposure")))
    raws = groups.select(*SETTING, rank(F.lit(3), F.col("t"), F.col("n"), F.col("__key")).alias("r"))
    best = masters.unionByName(raws).groupBy(*SETTING).agg(F.min("r").alias("r"))
    return best.select(*SETTING, F.col("r.tier").alias("tier"), F.col("r.pick").alias("pick"), (-F.col("r.fewer")).alias("darks"))


def with_dark(flats: DataFrame, darks: DataFrame) -> DataFrame:
    """Flats with the tier, pick and size of their dark; null where none suits."""
    return null_safe_join(flats, choose_darks(flats, darks), SETTING, "left")


def darks_used(flats: DataFrame, darks: DataFrame) -> DataFrame:
    """Darks that serve at least one flat: ``path``, ``kind``, ``exposure``."""
    chosen = choose_darks(flats, darks)
    pairs = _suiting_darks(chosen, darks).withColumn("__key", raw_key(darks))
    warm = F.abs(F.col("temp") - F.col("d_temp")) <= TEMP_TOLERANCE
    hit = F.when(F.col("tier") == 3, (F.col("d_kind") != "master") & warm & (F.col("pick") == F.col("__key"))).otherwise(
        (F.col("d_kind") == "master") & (F.col("pick") == F.col("d_path")))
    return pairs.filter(hit).select(F.col("d_path").alias("path"), F.col("d_kind").alias("kind"), F.col("d_exposure").alias("exposure")).distinct()


def safe_name(text: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9._-]+", "_"), r"^[_.]+|[_.]+$", "")
    return F.when(F.length(s) > 0, s).otherwise("unknown")


def flat_parts(flats: DataFrame) -> DataFrame:
    """Flats of a job (filter, binning) split by exposure and gain: adds ``part``, the path of the part's first flat.

    In path order each flat joins the first part whose first flat has its exposure and a compatible gain, else starts
    one. Flats of one exposure and gain go together, so only the distinct ones are put in order.
    """
    job = ["filter", "binning"]
    once = flats.groupBy("path").agg(F.min(F.struct(*[c for c in flats.columns if c != "path"])).alias("s")).select("path", "s.*")
    alone = F.when(F.col("exposure").isNull(), F.col("path"))
    once = once.withColumn("__alone", alone)
    kinds = once.groupBy(*job, "exposure", "gain", "__alone").agg(F.min("path").alias("part"))
    kinds = checkpointed(kinds)
    a = kinds.filter("exposure IS NOT NULL").withColumn("__step", F.explode(F.sequence(
        exposure_step(F.col("exposure")) - 1, exposure_step(F.col("exposure")) + 1)))
    b = kinds.filter("exposure IS NOT NULL").withColumn("__step", exposure_step(F.col("exposure"))).select(
        *job, "__step", F.col("exposure").alias("e2"), F.col("gain").alias("g2"), F.col("part").alias("later"))
    pairs = null_safe_join(b, a.select(*job, "__step", "exposure", "gain", F.col("part").alias("earlier")), [*job, "__step"])
    pairs = checkpointed(pairs.filter((F.col("earlier") < F.col("later")) & same_exposure(F.col("exposure"), F.col("e2"))
                                      & compatible(F.col("gain"), F.col("g2"), 0)).select("earlier", "later"))
    leaders = ordered_suppression(kinds, pairs, "part")
    joins = (pairs.join(leaders.withColumnRenamed("part", "earlier"), "earlier", "left_semi")
             .join(leaders.withColumnRenamed("part", "later"), "later", "left_anti")
             .groupBy("later").agg(F.min("earlier").alias("leader")))
    led = kinds.join(joins.withColumnRenamed("later", "part"), "part", "left").select(
        *job, "exposure", "gain", "__alone", F.coalesce("leader", "part").alias("part"))
    return null_safe_join(once, led, [*job, "exposure", "gain", "__alone"]).drop("__alone")


def flat_jobs(flats: DataFrame, darks: DataFrame) -> DataFrame:
    """One master flat per filter and binning: ``name``, ``flats``, ``parts``, ``skip`` (why not, or null)."""
    job = ["filter", "binning"]
    parts = flat_parts(flats)
    firsts = with_dark(parts.filter(F.col("path") == F.col("part")), darks)
    missing = F.min(F.when(F.col("pick").isNull(), F.struct("part", F.col("exposure").alias("e")))).alias("missing")
    jobs = null_safe_join(parts.groupBy(*job).agg(F.count("*").alias("flats"), F.count_distinct("part").alias("parts")),
                          firsts.groupBy(*job).agg(missing), job)
    lower = F.lower("filter")
    many = F.count("*").over(Window.partitionBy(lower)) > 1
    binned = F.when(many & F.col("binning").isNotNull(), F.concat(F.lit("_bin"), F.col("binning").cast("string"))).otherwise("")
    jobs = jobs.withColumn("base", F.concat(F.lit("masterFlat_"), safe_name(F.col("filter")), binned))
    order = Window.partitionBy(F.lower("base")).orderBy(lower, F.coalesce("binning", F.lit(0)), "filter")
    jobs = jobs.withColumn("__no", F.row_number().over(order))
    name = F.concat(F.col("base"), F.when(F.col("__no") > 1, F.concat(F.lit("_"), F.col("__no").cast("string"))).otherwise(""), F.lit(".xisf"))
    skip = (F.when(F.col("flats") < MIN_FLATS, F.concat(F.lit("only "), F.col("flats").cast("string"), F.lit(f" of {MIN_FLATS} flats")))
            .when(F.col("missing").isNotNull(), F.when(F.col("missing.e").isNull(), "flats without an exposure have no dark").otherwise(
                F.concat(F.lit("no dark fits flats of "), F.col("missing.e").cast("string"), F.lit(" s")))))
    return jobs.select(*job, name.alias("name"), "flats", "parts", skip.alias("skip"))


def dark_match_lines(flats: DataFrame, darks: DataFrame) -> DataFrame:
    """One line per part of a master flat job: which dark serves it."""
    parts = flat_parts(flats)
    firsts = with_dark(parts.filter(F.col("path") == F.col("part")), darks)
    text = (F.when(F.col("pick").isNull(), "no dark").when(F.col("tier") < 3, "master dark")
            .otherwise(F.concat(F.lit("raw darks, "), F.col("darks").cast("string"), F.lit(" to combine"))))
    return firsts.select("filter", "binning", "exposure", "gain", text.alias("line"), "tier", "pick")


def dark_match_totals(flats: DataFrame, darks: DataFrame) -> DataFrame:
    """How many master darks and raw darks the flats use."""
    u = darks_used(flats, darks)
    return u.groupBy("kind").agg(F.count("*").alias("darks"), F.count_distinct("exposure").alias("exposures"))


def verify_master(results: DataFrame) -> DataFrame:
    """Add ``problem``: the first way a master differs from its inputs, or null.

    Columns ``width``, ``height``, ``filter``, ``image_type``, ``mean`` and the wanted ``want_width``, ``want_height``,
    ``want_filter``.
    """
    def named(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("missing"))
    mean = F.col("mean")
    usable = F.coalesce(~F.isnan(mean) & (mean > 0) & (mean < float("inf")), F.lit(False))
    wrong_filter = F.col("want_filter").isNotNull() & F.coalesce(F.col("filter") != F.col("want_filter"), F.lit(True))
    return results.withColumn("problem", F.when(F.col("width").isNull(), "unreadable result")
                              .when((F.col("width") != F.col("want_width")) | (F.col("height") != F.col("want_height")), "other width or height")
                              .when(wrong_filter, F.concat(F.lit("filter "), named("filter"), F.lit(" instead of "), F.col("want_filter")))
                              .when(~F.coalesce(F.col("image_type").rlike("(?i)flat"), F.lit(False)),
                                    F.concat(F.lit("type "), named("image_type"), F.lit(", not a flat")))
                              .when(~usable, "mean not above zero"))


# --- import schedules ------------------------------------------------------------------------

def _destination(path: Column, folder: str) -> Column:
    return F.concat(F.lit(folder), F.regexp_replace(F.element_at(F.split(path, "/"), -1), EXTENSION, ".xisf"))


def scheduled(lights: DataFrame, flats: DataFrame, destination: str) -> DataFrame:
    """Approved lights, and the flats of the filters that survived: ``kind``, ``src``, ``dst``, ``filter``."""
    a = lights.select(F.lit("light").alias("kind"), F.col("path").alias("src"), _destination(F.col("path"), f"{destination}/Light/").alias("dst"), "filter")
    kept = flats.join(lights.select("filter").distinct(), "filter", "left_semi")
    b = kept.select(F.lit("flat").alias("kind"), F.col("path").alias("src"), _destination(F.col("path"), f"{destination}/Flat/").alias("dst"), "filter")
    return a.unionByName(b)


def collisions(schedule: DataFrame) -> DataFrame:
    """Destinations, ignoring case, that more than one source would be written to."""
    return (schedule.groupBy(F.lower("dst").alias("dst")).agg(F.min("src").alias("a"), F.max("src").alias("b"))
            .filter(F.col("a") != F.col("b")))


def import_manifest(lights: DataFrame, flats: DataFrame, destination: str) -> DataFrame:
    """The copy schedule, each file once; empty when two sources share a destination."""
    rows = scheduled(lights, flats, destination)
    bad = collisions(rows).agg(F.count("*").alias("__bad"))
    once = rows.groupBy("kind", F.lower("dst").alias("__key")).agg(F.min(F.struct("src", "dst", "filter")).alias("s"))
    return (once.select("kind", "s.*").join(bad.filter("__bad > 0").select(F.lit("light").alias("kind")).unionByName(
        bad.filter("__bad > 0").select(F.lit("flat").alias("kind"))), "kind", "left_anti"))


def skip_incomplete_filters(jobs: DataFrame, flats: DataFrame, failed: DataFrame) -> DataFrame:
    """Master flat jobs with ``skip`` set where flat copies failed; a failure with no filter counts for all jobs.

    ``flats`` has ``src`` and ``filter``, ``failed`` has ``src``.
    """
    lost = flats.join(failed.select("src").distinct(), "src", "left_semi").groupBy("filter").agg(F.count("*").alias("__lost"))
    everywhere = lost.filter("filter IS NULL").agg(F.coalesce(F.sum("__lost"), F.lit(0)).alias("__all"))
    rows = jobs.join(lost.filter("filter IS NOT NULL"), "filter", "left").withColumn("__one", F.lit(1)).join(
        everywhere.withColumn("__one", F.lit(1)), "__one")
    n = F.coalesce("__lost", F.lit(0)) + F.col("__all")
    reason = F.concat(n.cast("string"), F.lit(" flats were not copied"))
    return rows.withColumn("skip", F.coalesce("skip", F.when(n > 0, reason))).select(*jobs.columns)

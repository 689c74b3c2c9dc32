"""Reuse of what was computed before: digests, stage keys, evictions, chains of stages."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytable.functions.keys import FORMAT_VERSION, chain_key_text, params_string
from skytable.functions.ordered import null_safe_join, running_total
from skytable.operators.frames import RACY_MS, finite

# Fixed order of the stages of a chain, and the second image some of them store.
STAGE_ORDER = (
    "solve", "spfc", "mgc", "graxpert", "aberration", "register", "combine", "solveRGB", "spfcRGB", "spccRGB",
    "sharpenRGB", "extractRGB", "denoiseLinearRGB", "stretchRGB", "denoiseRGB", "paletteCombine", "paletteSpcc",
    "paletteNorm", "paletteSharpen", "paletteExtract", "paletteDenoiseLinear", "paletteStretch", "paletteDenoise",
    "extractL", "denoiseLinearL", "stretchL", "denoiseL")
STAGE_COMPANIONS = {"extractL": "stars", "extractRGB": "stars", "paletteExtract": "stars", "stretchRGB": "linear", "paletteStretch": "linear"}


def identity_recheck(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """Add ``outcome``: null where digest and size are still those of the manifest, else skipped."""
    now = current.select("path", F.col("digest").alias("__digest"), F.col("size").alias("__size"))
    same = F.coalesce((F.col("digest") == F.col("__digest")) & (F.col("size") == F.col("__size")), F.lit(False))
    return manifest.join(now, "path", "left").withColumn("outcome", F.when(~same, "skipped")).drop("__digest", "__size")


def digest_cache_hits(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Add ``cached_digest``: the remembered digest of a path with the same size, mtime and created (null equals null)."""
    good = cache.filter(F.col("digest").rlike("^[0-9a-f]{40}$") & finite(F.col("size")) & finite(F.col("mtime")))
    kept = good.select("path", "size", "mtime", F.col("created").alias("__created"), F.col("digest").alias("cached_digest"))
    rows = files.withColumn("__c", F.col("created"))
    right = kept.withColumnsRenamed({"path": "__path", "size": "__size", "mtime": "__mtime"})
    on = ((F.col("path") == F.col("__path")) & (F.col("size") == F.col("__size")) & (F.col("mtime") == F.col("__mtime"))
          & F.col("__c").eqNullSafe(F.col("__created")))
    return rows.join(right, on, "left").drop("__c", "__path", "__size", "__mtime", "__created")


def digests_to_remember(files: DataFrame) -> DataFrame:
    """Entries that can be trusted later: read at least 2 s after the file last changed (``at``, ``mtime``, ``created`` in ms)."""
    def recent(c: str) -> Column:
        return F.col(c).isNotNull() & ~F.coalesce(F.col("at") - F.col(c) >= RACY_MS, F.lit(False))
    return files.filter(F.col("digest").rlike("^[0-9a-f]{40}$") & finite(F.col("size")) & finite(F.col("mtime"))
                        & F.col("at").isNotNull() & ~recent("mtime") & ~recent("created"))


def lru_evictions(entries: DataFrame, cap: int, keep: str | None = None, *, day_ms: int = 86_400_000) -> DataFrame:
    """Keys to remove, least recently used first, until the rest fits ``cap``; the kept key never goes.

    ``entries`` has ``key``, ``bytes`` and ``used`` (ms). The running total is carried from day to day.
    """
    total = entries.agg(F.sum("bytes").alias("__total"))
    rest = entries if keep is None else entries.filter(F.col("key") != keep)
    block = F.floor(F.col("used") / day_ms).cast("long")
    run = running_total(rest, [], ["used", "key"], block, F.col("bytes"), "__upto").withColumn("__one", F.lit(1))
    left = run.join(total.withColumn("__one", F.lit(1)), "__one")
    return left.filter(F.col("__total") - (F.col("__upto") - F.col("bytes")) > cap).select("key", "bytes", "used")


def stage_keys(stages: DataFrame) -> DataFrame:
    """Add ``key`` to the stages of each chain: ``chain``, ``stage``, ``params`` (map of texts) and ``source_key``.

    A chain has at most one row per known stage, so its keys are folded over an array.
    """
    order = F.array_position(F.array(*[F.lit(s) for s in STAGE_ORDER]), F.col("stage"))
    rows = stages.withColumn("idx", order.cast("int")).filter(F.col("idx") > 0)
    item = F.struct("idx", "stage", F.concat(F.col("stage"), F.lit("|"), params_string(F.col("params"))).alias("text"),
                    F.coalesce(F.col("params")["keepLinear"] == "true", F.lit(False)).alias("linear"))
    chains = rows.groupBy("chain").agg(F.min("source_key").alias("source_key"), F.sort_array(F.collect_list(item)).alias("items"))
    folded = F.aggregate(
        "items", F.array().cast("array<string>"),
        lambda done, i: F.concat(done, F.array(F.sha1(F.concat(
            F.lit(f"{FORMAT_VERSION}|"), F.coalesce(F.try_element_at(done, F.lit(-1)), F.col("source_key"), F.lit("")), F.lit("|"), i["text"])))))
    chains = chains.withColumn("keys", folded)
    flat = chains.select("chain", F.posexplode(F.arrays_zip("items", "keys")).alias("pos", "z"))
    companion = F.lit(None).cast("string")
    for stage, name in STAGE_COMPANIONS.items():
        ok = F.col("z.items.stage") == stage
        if name == "linear":
            ok = ok & F.col("z.items.linear")
        companion = F.when(ok, name).otherwise(companion)
    return flat.select("chain", F.col("pos").alias("idx"), F.col("z.items.stage").alias("stage"), F.col("z.keys").alias("key"),
                       companion.alias("companion"))


def latest_reusable(chains: DataFrame, store: DataFrame) -> DataFrame:
    """The last stage of each chain that is stored and complete; ``idx`` -1 where every stage must run.

    ``store`` has ``key``, ``complete`` and ``companion_present``.
    """
    s = store.select("key", "complete", "companion_present")
    good = F.coalesce(F.col("complete") & (F.col("companion").isNull() | F.col("companion_present")), F.lit(False))
    rows = chains.join(s, "key", "left").withColumn("__good", good)
    best = F.max(F.when(F.col("__good"), F.struct("idx", "stage", "key")))
    return rows.groupBy("chain").agg(best.alias("b")).select(
        "chain", F.coalesce("b.idx", F.lit(-1)).alias("idx"), F.col("b.stage").alias("stage"), F.col("b.key").alias("key"))


Runner = Callable[[DataFrame], DataFrame]


def run_chain(source: DataFrame, source_key: str, stages: Sequence[tuple[str, dict[str, str], Runner | None]], root: str) -> tuple[DataFrame, list[str]]:
    """Run named stages over a table, each stored under its key at ``root`` and taken from there the next time.

    A stage without a runner passes its input on. A stage that fails stores nothing. Returns the last table and the
    names of the stages that ran.
    """
    spark = source.sparkSession
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def done(key: str) -> bool:
        at = fs_path(f"{root}/{key}/_SUCCESS")
        return at.getFileSystem(conf).exists(at)
    keys: list[str] = []
    for name, params, _ in stages:
        keys.append(chain_key_text(keys[-1] if keys else source_key, name, params))
    start = next((i for i in range(len(stages) - 1, -1, -1) if stages[i][2] is not None and done(keys[i])), -1)
    df = source if start < 0 else spark.read.parquet(f"{root}/{keys[start]}")
    ran = []
    for (name, _, runner), key in list(zip(stages, keys, strict=True))[start + 1:]:
        if runner is None:
            continue
        runner(df).write.mode("overwrite").parquet(f"{root}/{key}")
        df = spark.read.parquet(f"{root}/{key}")
        ran.append(name)
    return df, ran


def config_key(version: str, signature: Column, digest: Column) -> Column:
    """The key of a cached measurement."""
    return F.concat_ws("|", F.lit(version), signature, digest)


# Fixed list of the figures a cached measurement must name; null is a cached answer too.
STORED_KEYS = ("fwhm", "eccentricity", "noise", "stars", "psf_snr", "background", "snr_weight", "altitude", "psf_flux")


def measurement_split(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files with a usable cached measurement, and files to measure.

    ``cache`` has ``key``, ``stored_at`` and ``metrics``, a map that names every figure when it is usable. The latest
    entry of a key counts.
    """
    usable = F.size(F.array_except(F.array(*[F.lit(k) for k in STORED_KEYS]), F.map_keys("metrics"))) == 0
    last = cache.groupBy("key").agg(F.max_by("metrics", "stored_at").alias("metrics")).filter(usable)
    return files.join(last, "key"), files.join(last, "key", "left_anti")


def build_manifest(rows: DataFrame) -> DataFrame:
    """Frames whose final state is rejected, with the verdict and the override that led there."""
    from skytable.operators.frames import final_state
    out = rows.filter(final_state(F.col("state"), F.col("override")) == "rejected")
    return out.select("path", F.coalesce("channel", F.lit("")).alias("channel"), "digest", "size", "mtime",
                      F.col("state").alias("auto_verdict"), "override", "reasons")


def manifest_pending(manifest: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Manifest rows without an outcome yet."""
    return manifest.join(outcomes.select("path").distinct(), "path", "left_anti")


def with_outcomes(manifest: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The manifest with the last recorded outcome and detail of each path (``recorded_at``)."""
    last = outcomes.groupBy("path").agg(F.max_by(F.struct("outcome", "detail"), "recorded_at").alias("o"))
    return null_safe_join(manifest, last, ["path"], "left").withColumns(
        {"outcome": F.col("o.outcome"), "detail": F.coalesce(F.col("o.detail"), F.lit(""))}).drop("o")

"""Gates of a growing cohort from rank counts, so that a batch of frames costs what it holds.

For each filter and metric the values seen so far are kept as counts in buckets of a fixed relative
width. A batch is counted once: its values go to a table of their own, sorted by bucket, and the counts
of its buckets are added to those before. Medians and median deviations are then found exactly: the
bucket counts say in which few buckets the wanted ranks lie, and only those buckets' values are read
from the batches' tables, by a filter that reaches the scan. No frame of an earlier batch is read again.

Counts are sums, so the order in which frames arrive, and how they are cut into batches, do not matter.
Every table has one version per batch; a batch that runs twice writes the same version again.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skytable.operators.frames import GATING, MAD_TO_SIGMA, filter_key, gates_of, unpivoted, verdicts
from skytable.streaming.streams import run_batches, versions

KEYS = ["filter", "metric"]
# Buckets per factor e: values of a bucket differ by less than one part in this many.
FINE = 4096
VALUES = "filter string, metric string, bucket long, value double, c long"
BUCKETS = "filter string, metric string, bucket long, c long, low double, high double"


def bucket_of(value: Column) -> Column:
    """The bucket of a positive number; larger numbers never have smaller buckets."""
    return F.floor(F.log(value) * FINE)


def counted(frames: DataFrame) -> DataFrame:
    """How often each value occurs, by filter, metric and bucket. Valid frames have positive metrics only."""
    rows = unpivoted(frames.withColumn("filter", filter_key(F.col("filter"))))
    return rows.groupBy(*KEYS, "value").agg(F.count("*").alias("c")).select(*KEYS, bucket_of(F.col("value")).alias("bucket"), "value", "c")


def bucketed(values: DataFrame) -> DataFrame:
    return values.groupBy(*KEYS, "bucket").agg(F.sum("c").alias("c"), F.min("value").alias("low"), F.max("value").alias("high"))


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Bucket counts of two cohorts together."""
    return a.unionByName(b).groupBy(*KEYS, "bucket").agg(F.sum("c").alias("c"), F.min("low").alias("low"), F.max("high").alias("high"))


def _ranked(buckets: DataFrame, values, low: Column, high: Column, of: Column, name: str) -> DataFrame:
    """The mean of the two middle elements of ``of`` over all values: ``filter``, ``metric``, ``n``, ``name``.

    ``low`` and ``high`` bound ``of`` within a bucket. Buckets that lie wholly under the wanted ranks are only counted.
    ``values`` gives the values of some buckets.
    """
    all_ = Window.partitionBy(*KEYS)
    rows = buckets.withColumns({"__low": low, "__high": high, "__n": F.sum("c").over(all_)})
    first, last = F.floor((F.col("__n") - 1) / 2), F.floor(F.col("__n") / 2)
    by_high = F.sum("c").over(all_.orderBy("__high").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    by_low = F.sum("c").over(all_.orderBy("__low").rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.sum("c").over(
        all_.orderBy("__low").rangeBetween(Window.currentRow, Window.currentRow))
    rows = rows.withColumns({"__upto": by_high, "__under": by_low})
    # at least `upto` values are no higher than a bucket's highest, at most `under` are lower than its lowest
    rows = rows.withColumns({"__top": F.min(F.when(F.col("__upto") > last, F.col("__high"))).over(all_),
                             "__bottom": F.max(F.when(F.col("__under") <= first, F.col("__low"))).over(all_)})
    near = (F.col("__high") >= F.col("__bottom")) & (F.col("__low") <= F.col("__top"))
    below = F.sum(F.when(F.col("__high") < F.col("__bottom"), F.col("c")).otherwise(0)).over(all_)
    picked = rows.withColumn("__below", below).filter(near)
    inside = values(picked.select(*KEYS, "bucket")).join(picked.drop("c", "low", "high"), [*KEYS, "bucket"]).withColumn("__of", of)
    inside = inside.groupBy(*KEYS, "__n", "__below", "__of").agg(F.sum("c").alias("c"))
    inside = inside.withColumn("__end", F.col("__below") + F.sum("c").over(Window.partitionBy(*KEYS).orderBy("__of").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    found = [F.max(F.when((at >= F.col("__end") - F.col("c")) & (at < F.col("__end")), F.col("__of"))) for at in (first, last)]
    return inside.groupBy(*KEYS).agg(F.max("__n").alias("n"), ((found[0] + found[1]) / 2).alias(name))


def spread(buckets: DataFrame, values) -> DataFrame:
    """Median and 1.4826 times the median deviation: ``filter``, ``metric``, ``n``, ``median``, ``sigma``."""
    middle = _ranked(buckets, values, F.col("low"), F.col("high"), F.col("value"), "median")
    rows = buckets.join(middle.drop("n"), KEYS)
    m = F.col("median")
    low = F.greatest(F.lit(0.0), F.col("low") - m, m - F.col("high"))
    high = F.greatest(F.abs(F.col("low") - m), F.abs(F.col("high") - m))
    off = _ranked(rows, values, low, high, F.abs(F.col("value") - m), "mad")
    return middle.join(off.drop("n"), KEYS).select(*KEYS, "n", "median", (MAD_TO_SIGMA * F.col("mad")).alias("sigma"))


def _stored(spark: SparkSession, root: str, number: int):
    """Values of some buckets from the tables of all batches up to ``number``."""
    paths = [f"{root}/values/batch={n}" for n in versions(spark, root, "values") if n <= number]

    def values(picked: DataFrame) -> DataFrame:
        # a few buckets for each filter and metric; named in the filter, so that other row groups are skipped
        ranges = picked.groupBy(*KEYS).agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).collect()
        wanted = [(F.col("filter") == r["filter"]) & (F.col("metric") == r["metric"]) & F.col("bucket").between(r["a"], r["b"]) for r in ranges]
        rows = spark.read.schema(VALUES).parquet(*paths)
        return rows.filter(reduce(or_, wanted)) if wanted else rows.limit(0)
    return values


def count_batch(batch: DataFrame, root: str, number: int) -> DataFrame:
    """Count a batch of frames and give the gates of the whole cohort up to it."""
    spark = batch.sparkSession
    counted(batch).repartition(*KEYS).sortWithinPartitions(*KEYS, "bucket").write.mode("overwrite").parquet(f"{root}/values/batch={number}")
    now = bucketed(spark.read.schema(VALUES).parquet(f"{root}/values/batch={number}"))
    before = [n for n in versions(spark, root, "buckets") if n < number]
    if before:
        now = merged(spark.read.schema(BUCKETS).parquet(f"{root}/buckets/batch={before[-1]}"), now)
    now.write.mode("overwrite").parquet(f"{root}/buckets/batch={number}")
    buckets = spark.read.schema(BUCKETS).parquet(f"{root}/buckets/batch={number}")
    return gates_of(spread(buckets, _stored(spark, root, number)), gating=GATING)


def running_gates(stream: DataFrame, root: str) -> DataFrame:
    """Gates after every batch of a stream of frames: ``batch`` and the columns of ``relative_gates``."""
    def step(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.write.mode("overwrite").parquet(f"{root}/cohort/batch={number}")
        count_batch(batch, root, number).write.mode("overwrite").parquet(f"{root}/gates/batch={number}")
        batch.unpersist()
    run_batches(stream, root, step)
    return stream.sparkSession.read.option("basePath", f"{root}/gates").parquet(f"{root}/gates")


def running_verdicts(stream: DataFrame, root: str) -> DataFrame:
    """Verdicts on all frames of a stream under the gates of its last batch. Only this last step reads the cohort."""
    gates = running_gates(stream, root)
    last = versions(stream.sparkSession, root, "gates")[-1]
    cohort = stream.sparkSession.read.schema(stream.schema).parquet(*[f"{root}/cohort/batch={n}" for n in versions(stream.sparkSession, root, "cohort") if n <= last])
    return verdicts(cohort, gates=gates.filter(F.col("batch") == last).drop("batch"))

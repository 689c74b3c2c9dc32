"""Connected components by rounds of neighbour minima, and links found through buckets without all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytable.functions.storage import checkpointed, released, removed, written_at

# Rounds in which every bucket compares its members with a few of them before it compares what is left apart.
STAR_ROUNDS = 2
# Left-over pairs a member, or links a compared pair, that end the star rounds early.
FEW, FRUITFUL = 4, 0.05


def _stars(edges: DataFrame) -> DataFrame:
    """Join larger neighbours, then smaller ones, to the least of a node's neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    large = both.join(least, "u").filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
    down = large.groupBy("b").agg(F.min("a").alias("m"))
    small = large.join(down, "b").filter("a != m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return small.unionByName(down.select(F.col("m").alias("a"), "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """id, component (least id reachable) of every id in ``edges`` (columns a, b; null ends and loops are left out).

    Rounds go on until nothing changes; each is checkpointed.
    """
    now = checkpointed(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if seen[0] == 0 or seen == mark:
            break
        mark = seen
        now = checkpointed(_stars(now))
    return now.groupBy("b").agg(F.min("a").alias("component")).withColumnRenamed("b", "id").unionByName(
        now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())


def linked(entries: DataFrame, verify: Callable[[DataFrame], DataFrame], fits: Callable[[str, str], str] | None = None,
           more: DataFrame | None = None, middles: int = 1) -> tuple[DataFrame, DataFrame]:
    """Components of the links among ids that share a bucket: (id, component) and the links found (a, b).

    ``entries`` has bucket, id and what ``fits`` reads of it; ``more`` has one row for each id with what
    else it reads, and is met only where a bucket has two ids; ``verify`` takes pairs (a < b, a table that is removed afterwards) and returns
    those that are links. Only connection matters, so a bucket first compares all its members with
    ``middles`` of them (others each round) and drops out once its members are connected, or if it has only two, which
    have met then. When few pairs are left apart, or a round finds few links, or after STAR_ROUNDS,
    all pairs of members that are still apart are compared: no link between two components can be missed.
    """
    busy = entries.groupBy("bucket").agg(F.min("id").alias("p"), F.max("id").alias("q")).filter("p != q").select("bucket")
    rows = entries.join(busy, "bucket").distinct()
    if more is not None:
        rows = rows.join(more, "id")
    rows, rows_path = written_at(rows.withColumn("component", F.col("id")), "members")
    spark = rows.sparkSession
    carried = [c for c in rows.columns if c not in ("bucket", "id", "component")]
    found: DataFrame | None = None
    fruitful, last, of = True, False, None

    def joined(links: DataFrame) -> DataFrame:
        """New links and what was connected before."""
        return links if of is None else links.unionByName(of.select(F.col("component").alias("a"), F.col("id").alias("b")))

    for round_ in range(STAR_ROUNDS + 1):
        sizes = rows.groupBy("bucket", "component").agg(F.count("*").cast("double").alias("n")).groupBy("bucket").agg(
            F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("q"), F.count("*").alias("c"))
        left = sizes.agg(F.sum("n"), F.sum((F.col("n") * F.col("n") - F.col("q")) / 2)).first()
        if not left[0] or not left[1]:
            break
        last = round_ == STAR_ROUNDS or (round_ > 0 and (not fruitful or left[1] <= FEW * left[0]))
        a, b = rows.alias("x"), rows.alias("y")
        apart = "x.bucket = y.bucket and x.component != y.component"
        if last:
            pairs = a.join(b, F.expr(f"{apart} and x.id < y.id" + (f" and {fits('x', 'y')}" if fits else ""))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
        else:
            salts = [F.xxhash64(F.lit(middles * round_ + k), "component") for k in range(middles)]
            picks = F.array_distinct(F.array(*[F.min_by(F.struct("id", "component", *carried), F.struct(salt, "id")) for salt in salts]))
            middle = rows.groupBy("bucket").agg(picks.alias("m")).select("bucket", F.explode("m").alias("m")).select("bucket", "m.*").alias("x")
            pairs = middle.join(b, F.expr(apart + (f" and {fits('x', 'y')}" if fits else ""))).select(
                F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
        pairs, pairs_path = written_at(pairs.distinct(), "candidates")
        links = checkpointed(verify(pairs).select("a", "b"))
        fruitful = links.count() >= FRUITFUL * pairs.count()
        removed(spark, pairs_path)
        found = links if found is None else found.unionByName(links)
        if last:
            break
        of = checkpointed(components(joined(links)))
        rows = rows.drop("component").join(of, "id", "left").withColumn("component", F.coalesce("component", "id"))
        open_ = rows.groupBy("bucket").agg(F.min("component").alias("p"), F.max("component").alias("q"), F.count("*").alias("n")).filter("p != q and n > 2").select("bucket")
        # tables and shuffle files of a round go before the next one starts
        before = rows_path
        rows, rows_path = written_at(rows.join(open_, "bucket"), "members")
        removed(spark, before)
        released(spark)
    if found is None:
        found = spark.createDataFrame([], rows.select(F.col("id").alias("a"), F.col("id").alias("b")).schema)
        removed(spark, rows_path)
        return components(found), found
    removed(spark, rows_path)
    released(spark)
    return (checkpointed(components(joined(links))) if last else of), found

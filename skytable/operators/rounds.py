"""Ordered choices that depend on earlier choices, taken in rounds over distributed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skytable.functions.storage import checkpointed


def one_to_one(pairs: DataFrame, left: str, right: str, order: Sequence[str]) -> DataFrame:
    """Take pairs in ``order`` so that each left and each right id is used once.

    Every round takes the pairs that are first for both their ids, which is what one pass over
    the sorted pairs would take. Ids make the order total. The first pair left is always taken,
    so the rounds end.
    """
    key = F.struct(*order, left, right)
    rest = checkpointed(pairs.withColumn("__key", key))
    kept: DataFrame | None = None
    while not rest.isEmpty():
        by_left = rest.groupBy(left).agg(F.min("__key").alias("__first")).drop(left)
        by_right = rest.groupBy(right).agg(F.min("__key").alias("__first")).drop(right)
        both = by_left.join(by_right, "__first", "left_semi").select(
            F.col("__first")[left].alias(left), F.col("__first")[right].alias(right))
        both = checkpointed(both)
        taken = rest.join(both, [left, right], "left_semi")
        kept = taken if kept is None else kept.unionByName(taken)
        rest = checkpointed(rest.join(both.select(left), left, "left_anti").join(both.select(right), right, "left_anti"))
    return (rest if kept is None else kept).drop("__key")


def one_to_one_of_classes(edges: DataFrame, lefts: DataFrame, rights: DataFrame, left: str, right: str, order: Sequence[str]) -> DataFrame:
    """What ``one_to_one`` takes of all pairs of members of joined classes, without making those pairs.

    ``edges`` has ``left_class``, ``right_class`` and ``order``, the same for all pairs of their members; ``lefts`` and
    ``rights`` have the members of a class (``left_class`` and ``left``, ``right_class`` and ``right``), each id once. A class
    meets its best partners first, those of equal order as one row of ids. Where a class is the only choice of all its best
    partners, and theirs are all open, its ids meet theirs place by place, as many as there are; where ties cross, the first
    ids of two classes are taken that are first for each other. The first edge left always gives a pair, so the rounds end.
    """
    key = F.struct(*order)
    open_ = checkpointed(edges.select("left_class", "right_class", key.alias("__key")))
    rest = {"left": checkpointed(lefts.select("left_class", F.col(left).alias("id")).join(open_.select("left_class"), "left_class", "left_semi")),
            "right": checkpointed(rights.select("right_class", F.col(right).alias("id")).join(open_.select("right_class"), "right_class", "left_semi"))}
    kept: DataFrame | None = None
    while True:
        for side in ("left", "right"):
            heads = rest[side].groupBy(f"{side}_class").agg(F.min("id").alias(f"{side}_id"))
            open_ = open_.drop(f"{side}_id").join(heads, f"{side}_class")
        open_ = checkpointed(open_)
        if open_.isEmpty():
            break
        ties = open_
        for side in ("left", "right"):
            best = open_.groupBy(f"{side}_class").agg(F.min("__key").alias(f"__{side}_best"), F.min(F.struct("__key", "left_id", "right_id")).alias(f"__{side}_first"))
            ties = ties.join(best, f"{side}_class")
        ties = ties.withColumns({f"__{side}": F.col("__key") == F.col(f"__{side}_best") for side in ("left", "right")}).filter("__left or __right")
        # of each class: its edges of the best order, and how many of them are the best of both ends
        for side in ("left", "right"):
            of = ties.groupBy(f"{side}_class").agg(F.count_if(f"__{side}").alias(f"__{side}_all"), F.count_if(F.col("__left") & F.col("__right")).alias(f"__{side}_both"))
            ties = ties.join(of, f"{side}_class")
        ties = checkpointed(ties.filter("__left and __right"))
        for side, other in (("left", "right"), ("right", "left")):
            alone = ties.groupBy(f"{side}_class").agg(((F.max(f"__{other}_all") == 1) & (F.first(f"__{side}_all") == F.first(f"__{side}_both"))).alias(f"__{side}_alone"))
            ties = ties.join(alone, f"{side}_class")
        first = F.struct("__key", "left_id", "right_id")
        head = (F.col("__left_first") == first) & (F.col("__right_first") == first)
        def called(kind: int, by: str) -> Column:
            return F.struct(F.lit(kind).alias("kind"), F.col(by).cast("string").alias("by"))
        group = (F.when(F.col("__left_alone"), called(0, "left_id")).when(F.col("__right_alone"), called(1, "right_id"))
                 .when(head, called(2, "left_id")))
        groups = checkpointed(ties.select("left_class", "right_class", group.alias("__group")).filter("__group is not null"))
        turns = {}
        for side in ("left", "right"):
            of = rest[side].join(groups.select(f"{side}_class", "__group").distinct(), f"{side}_class")
            turn = F.row_number().over(Window.partitionBy("__group").orderBy("id"))
            turns[side] = of.withColumn("__turn", turn).filter("__group.kind < 2 or __turn = 1").withColumnsRenamed({"id": f"{side}_id"})
        taken = checkpointed(turns["left"].join(turns["right"], ["__group", "__turn"]).drop("__group", "__turn"))
        kept = taken if kept is None else kept.unionByName(taken)
        for side in ("left", "right"):
            gone = taken.select(f"{side}_class", F.col(f"{side}_id").alias("id"))
            rest[side] = checkpointed(rest[side].join(gone, [f"{side}_class", "id"], "left_anti"))
    if kept is None:
        kept = rest["left"].withColumnRenamed("id", "left_id").crossJoin(rest["right"].withColumnRenamed("id", "right_id"))
    out = kept.join(edges, ["left_class", "right_class"])
    return out.select(F.col("left_id").alias(left), F.col("right_id").alias(right), *order)


def ordered_suppression(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Ids kept when nodes are visited in order and a kept node drops its later neighbours.

    ``edges`` has ``earlier`` and ``later`` ids. A node with no earlier neighbour left is kept;
    the neighbours of kept nodes go; and again until no node is left.
    """
    open_nodes = checkpointed(nodes.select(key).distinct())
    links = checkpointed(edges.select("earlier", "later"))
    kept: DataFrame | None = None
    while not links.isEmpty():
        free = checkpointed(open_nodes.join(links.select(F.col("later").alias(key)).distinct(), key, "left_anti"))
        gone = checkpointed(links.join(free.select(F.col(key).alias("earlier")), "earlier", "left_semi")
                            .select(F.col("later").alias(key)).distinct())
        kept = free if kept is None else kept.unionByName(free)
        decided = free.unionByName(gone)
        open_nodes = checkpointed(open_nodes.join(decided, key, "left_anti"))
        done = decided.withColumnRenamed(key, "earlier")
        links = checkpointed(links.join(done, "earlier", "left_anti")
                             .join(decided.withColumnRenamed(key, "later"), "later", "left_anti"))
    return open_nodes if kept is None else kept.unionByName(open_nodes)


def connected(edges: DataFrame) -> DataFrame:
    """The least id that each id of ``edges`` (columns a, b) reaches: ``id``, ``root``.

    Ids may be of any type that has an order. Every round ties the larger neighbours of a node to the least node it
    knows, then the smaller ones, so trees get flatter by half and a hub's edges stay one each; rounds end when the
    edges are stars.
    """
    now = checkpointed(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while True:
        ends = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = ends.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        up = ends.join(low, "a").filter("b > a").select(F.col("m").alias("a"), "b").distinct()
        low = up.groupBy("b").agg(F.min("a").alias("m"))
        tied = up.join(low, "b").filter("a != m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        new = checkpointed(tied.unionByName(low.select(F.col("m").alias("a"), "b")).distinct())
        # stars: the same edges as before, and no node is both a centre and a ray
        same = new.join(now, ["a", "b"], "left_anti").isEmpty() and now.join(new, ["a", "b"], "left_anti").isEmpty()
        now = new
        if same:
            break
    roots = now.select(F.col("a").alias("id")).distinct().withColumn("root", F.col("id"))
    return now.select(F.col("b").alias("id"), F.col("a").alias("root")).unionByName(roots)

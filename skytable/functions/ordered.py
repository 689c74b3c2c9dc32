"""Order statistics, neighbours and running totals that hold when one group has most of the rows.

``percentile`` keeps every distinct value of a group in one buffer and a window
over a group sorts the whole group in one task. The functions here keep the
work of a group spread out:

* order statistics bracket each wanted rank with a sketch of fixed size, count
  the distinct values inside the bracket in parallel, and rank only those;
* neighbours and running totals work inside blocks of the order column and
  carry the block edges over, so that only one row per block meets in a group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skytable.functions.storage import checkpointed

# A sketch with this accuracy is off by at most n / ACCURACY ranks; the bracket is wider than that.
ACCURACY = 100_000
BRACKET = 3e-5
# Groups up to this size are ranked without a bracket (BRACKET * SMALL_GROUP = 3 ranks).
SMALL_GROUP = 100_000

Index = Callable[[Column], Column]


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where null matches null; the keys come from the left side."""
    renamed = right
    on = None
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__r_{k}")
        test = left[k].eqNullSafe(F.col(f"__r_{k}"))
        on = test if on is None else on & test
    return left.join(renamed, on, how).drop(*[f"__r_{k}" for k in keys])  # drop ignores what a semi join left out


def usable(value: Column) -> Column:
    """Neither null nor NaN."""
    return value.isNotNull() & ~F.isnan(value)


def order_elements(df: DataFrame, keys: Sequence[str], value: str,
                   picks: dict[str, tuple[float, Index]]) -> DataFrame:
    """Elements of each group's sorted values: ``keys``, ``n`` and one column per pick.

    A pick is (fraction, index): ``index`` maps the number of values to a
    0-based position, which lies within two ranks of fraction * n.
    Null and NaN values do not count.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("__v")).filter(usable(F.col("__v")))
    fractions = sorted({f for f, _ in picks.values()})
    edges = [e for f in fractions for e in (max(f - BRACKET, 0.0), min(f + BRACKET, 1.0))]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    # only large groups pay for a sketch; where there are none the branch turns out empty at run time
    large = null_safe_join(rows, counts.filter(F.col("__n") > SMALL_GROUP).drop("__n"), keys, "left_semi")
    sketch = null_safe_join(counts, large.groupBy(*keys).agg(
        F.percentile_approx("__v", edges, ACCURACY).alias("__edges")), keys, "left")
    v = F.col("__v")
    inside = F.col("__n") <= SMALL_GROUP
    passed = F.lit(None).cast("double")
    for i in range(len(fractions)):
        low, high = F.col("__edges")[2 * i], F.col("__edges")[2 * i + 1]
        inside = inside | v.between(low, high)
        passed = F.when(v > high, high).otherwise(passed)
    counts = (null_safe_join(rows, sketch, keys)
              .withColumn("__w", F.when(inside, v).otherwise(passed))
              .groupBy(*keys, "__n", "__w").agg(F.count("*").alias("__c")))
    up_to = Window.partitionBy(*keys).orderBy(F.col("__w").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("__hi", F.sum("__c").over(up_to))
    out = []
    for name, (_, index) in picks.items():
        at = index(F.col("__n"))
        out.append(F.max(F.when((at >= F.col("__hi") - F.col("__c")) & (at < F.col("__hi")), F.col("__w"))).alias(name))
    return ranked.groupBy(*keys).agg(F.max("__n").alias("n"), *out)


def _whole(x: Column) -> Column:
    return F.floor(x).cast("long")


def medians(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """Median with the mean of the two middle values for an even count: ``keys``, ``n``, ``name``."""
    e = order_elements(df, keys, value, {
        "__a": (0.5, lambda n: _whole((n - 1) / 2)),
        "__b": (0.5, lambda n: _whole(n / 2))})
    return e.select(*keys, "n", ((F.col("__a") + F.col("__b")) / 2).alias(name))


def upper_medians(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """Sorted element at n div 2: ``keys``, ``n``, ``name``."""
    return order_elements(df, keys, value, {name: (0.5, lambda n: _whole(n / 2))})


def lower_quartiles(df: DataFrame, keys: Sequence[str], value: str, name: str = "quartile") -> DataFrame:
    """Sorted element at floor(n / 4): ``keys``, ``n``, ``name``."""
    return order_elements(df, keys, value, {name: (0.25, lambda n: _whole(n / 4))})


def percentiles(df: DataFrame, keys: Sequence[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """Linearly interpolated percentiles: ``keys``, ``n`` and one column per named fraction."""
    picks: dict[str, tuple[float, Index]] = {}
    for name, f in fractions.items():
        picks[f"__lo_{name}"] = (f, lambda n, f=f: _whole((n - 1) * F.lit(f)))
        picks[f"__hi_{name}"] = (f, lambda n, f=f: F.ceil((n - 1) * F.lit(f)).cast("long"))
    e = order_elements(df, keys, value, picks)
    out = []
    for name, f in fractions.items():
        at = (F.col("n") - 1) * F.lit(f)
        low, high = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        out.append((low + (high - low) * (at - F.floor(at))).alias(name))
    return e.select(*keys, "n", *out)


def robust_spread(df: DataFrame, keys: Sequence[str], value: str, *, upper: bool = False) -> DataFrame:
    """Median and 1.4826 times the median absolute deviation: ``keys``, ``n``, ``median``, ``sigma``.

    ``upper`` uses the element at n div 2 for both medians and 1 where the deviation is 0.
    """
    middle = upper_medians if upper else medians
    # one row a group, read several times below: written once instead of computed each time
    centre = checkpointed(middle(df, keys, value))
    off = (null_safe_join(df.select(*keys, F.col(value).cast("double").alias("__x")), centre, keys)
           .withColumn("__d", F.abs(F.col("__x") - F.col("median"))))
    spread = middle(off, keys, "__d", "mad").drop("n")
    sigma = 1.4826 * F.col("mad")
    if upper:
        sigma = F.when(F.col("mad") == 0, F.lit(1.0)).otherwise(sigma)
    return null_safe_join(centre, spread, keys).select(*keys, "n", "median", sigma.alias("sigma"))


def neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column,
               columns: Sequence[str]) -> DataFrame:
    """Add ``prev`` and ``next``: structs of ``columns`` of the rows before and after in ``order``.

    ``block`` must not decrease along ``order``. Rows meet in a task by (keys, block); only the
    first and last row of every block meet by keys.
    """
    keys, order = list(keys), list(order)
    here = F.struct(*[F.col(c) for c in columns])
    rows = df.withColumn("__block", block).withColumn("__here", here)
    inside = Window.partitionBy(*keys, "__block").orderBy(*order)
    rows = (rows.withColumn("__prev", F.lag("__here").over(inside))
            .withColumn("__next", F.lead("__here").over(inside)))
    position = F.struct(*[F.col(c) for c in order])
    edges = rows.groupBy(*keys, "__block").agg(F.min_by("__here", position).alias("__first"),
                                               F.max_by("__here", position).alias("__last"))
    across = Window.partitionBy(*keys).orderBy("__block")
    edges = edges.select(*keys, "__block", F.lag("__last").over(across).alias("__before"),
                         F.lead("__first").over(across).alias("__after"))
    return (null_safe_join(rows, edges, [*keys, "__block"])
            .withColumn("prev", F.coalesce("__prev", "__before"))
            .withColumn("next", F.coalesce("__next", "__after"))
            .drop("__block", "__here", "__prev", "__next", "__before", "__after"))


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column,
                  value: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over this row and all rows before it in ``order``.

    ``block`` must not decrease along ``order``; see ``neighbours``.
    """
    keys, order = list(keys), list(order)
    rows = df.withColumn("__block", block).withColumn("__value", value)
    inside = Window.partitionBy(*keys, "__block").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    totals = rows.groupBy(*keys, "__block").agg(F.sum("__value").alias("__sum"))
    across = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "__block", F.coalesce(F.sum("__sum").over(across), F.lit(0)).alias("__carry"))
    return (null_safe_join(rows.withColumn("__inside", F.sum("__value").over(inside)), totals, [*keys, "__block"])
            .withColumn(name, F.col("__inside") + F.col("__carry"))
            .drop("__block", "__value", "__inside", "__carry"))

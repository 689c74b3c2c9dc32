"""Exact dedup: frequent digests are found by a Misra-Gries sketch and settled without a shuffle of their rows.

Texts are equal when identical after deleting space and tab to carriage return; null counts as
empty. Of equal texts the row with the most code points in its original text stays, then the
smallest doc_id (null last).

1. ``approx_top_k`` (the Frequent Items sketch, of the Misra-Gries family) names at most HEAVY
   candidates in one pass with partial sketches. It tracks TRACKED counters, so a digest that holds
   more than a few rows in TRACKED is among the candidates.
2. One aggregation over the candidates' rows only, combined before its shuffle, gives their true
   counts and winners: at most HEAVY rows, which are broadcast.
3. Rows of heavy digests are settled on the map side. Only the rest is shuffled by digest.

Rows that repeat a doc_id together with its text share one result in ``groups``; ``deduplicated``
keeps exactly one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytable.functions.storage import checkpointed, written

HEAVY = 256
TRACKED = 8192
WHITE = r"[\x20\x09-\x0D]+"


def normal_digest(text: Column) -> Column:
    """SHA-256 in hex of the text without white space."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, ""), 256)


def _length(text: Column) -> Column:
    return F.length(F.coalesce(text, F.lit(""))).cast("long")


def _winners(rows: DataFrame) -> DataFrame:
    """For each digest: the row that stays, how many rows repeat exactly it, and the rows of the group."""
    same = rows.groupBy("__digest", "__id", "__len").agg(F.count("*").alias("__times"))
    best = F.min(F.struct((-F.col("__len")).alias("a"), F.col("__id").isNull().alias("b"), F.col("__id").alias("id"),
                          F.col("__times").alias("times"))).alias("__best")
    return same.groupBy("__digest").agg(best, F.sum("__times").alias("__size")).select(
        "__digest", F.col("__best.id").alias("__keep"), (-F.col("__best.a")).alias("__keep_len"),
        F.col("__best.times").alias("__keep_times"), "__size")


def _split(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Slim rows, the verified heavy winners (at most HEAVY rows) and the winners of all other digests."""
    slim = written(docs.select(F.col(id_col).alias("__id"), _length(F.col(text_col)).alias("__len"),
                               normal_digest(F.col(text_col)).alias("__digest")), "digests")
    named = (slim.agg(F.expr(f"approx_top_k(__digest, {HEAVY}, {TRACKED})").alias("t"))
             .select(F.explode("t").alias("t")).filter("t.count > 1").select(F.col("t.item").alias("__digest")))
    heavy = checkpointed(_winners(slim.join(F.broadcast(named), "__digest", "left_semi")))
    rest = _winners(slim.join(F.broadcast(heavy.select("__digest")), "__digest", "left_anti"))
    return slim, heavy, rest


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    An empty table gives no rows; null and empty texts form one group; a null id is kept only where
    its group has no other id with as long a text. Other columns of ``docs`` play no part.
    """
    slim, heavy, rest = _split(docs, id_col, text_col)
    settled = slim.join(F.broadcast(heavy), "__digest")
    shuffled = slim.join(F.broadcast(heavy.select("__digest")), "__digest", "left_anti").join(rest, "__digest")
    return settled.unionByName(shuffled).select(
        F.col("__id").alias("doc_id"), F.col("__keep").alias("keep_id"), F.col("__size").alias("group_size"),
        (F.col("__id").eqNullSafe(F.col("__keep")) & (F.col("__len") == F.col("__keep_len"))).alias("kept"),
        F.col("__digest").alias("text_sha256"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns; one row for each different text.

    Copies of heavy texts are dropped before anything is shuffled. Of rows that repeat the id and
    text of the winner, the one whose columns sort first stays.
    """
    columns = docs.columns
    _, heavy, rest = _split(docs, id_col, text_col)
    marked = docs.select(F.struct(*[docs[c] for c in columns]).alias("__row"), F.col(id_col).alias("__id"),
                         _length(F.col(text_col)).alias("__len"), normal_digest(F.col(text_col)).alias("__digest"))
    stays = F.col("__id").eqNullSafe(F.col("__keep")) & (F.col("__len") == F.col("__keep_len"))
    from_heavy = marked.join(F.broadcast(heavy), "__digest").filter(stays)
    light = marked.join(F.broadcast(heavy.select("__digest")), "__digest", "left_anti")
    keep = rest.select("__digest", F.col("__keep"), "__keep_len", "__keep_times")
    from_rest = light.join(keep, (light["__digest"] == keep["__digest"]) & light["__id"].eqNullSafe(keep["__keep"])
                           & (light["__len"] == keep["__keep_len"])).drop(keep["__digest"])
    stay = from_heavy.select("__digest", "__row", "__keep_times").unionByName(
        from_rest.select("__digest", "__row", "__keep_times"))
    once = stay.filter("__keep_times = 1").select("__row")
    repeated = stay.filter("__keep_times > 1").groupBy("__digest").agg(F.min("__row").alias("__row")).select("__row")
    return once.unionByName(repeated).select(*[F.col("__row")[c].alias(c) for c in columns])

"""Mixing sources to target weights by budgets that run down a domain-language-source tree.

The budget of a node is dealt to its children in proportion to their weights. A child that holds
fewer tokens than its part gives the shortage to its siblings, as far as they hold more; because a
node's own capacity is that of all its leaves, a shortage reaches the siblings of an ancestor only
when the whole subtree is used up. Each level is one pass of window functions over the table of
nodes, whose size is that of the tree, not of the corpus.

A leaf holds its tokens up to EPOCHS times. Its budget is filled from seeded epochs: whole epochs
first, then a prefix of the last, in the order of md5(seed:epoch:doc_id). The prefix is found in
blocks of that hash, so that a leaf with a third of all rows is spread over BLOCKS tasks: only
sums per block meet in one place, and only the block in which the budget ends is put in order.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from skytable.functions.storage import checkpointed, written

SEED = 17
EPOCHS = 2
# Part of all tokens that the mixture is to hold.
FRACTION = (1, 2)
DOMAINS = 4
BLOCK_DIGITS = 3
LANGUAGE_WEIGHTS: Mapping[str, int] = {"en": 4, "de": 2, "fr": 2, "es": 2}
NONE = "(none)"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def word_count(text: Column) -> Column:
    """Tokens as budgets count them: runs without white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    """Domain of a source: its number modulo DOMAINS; sources without a number are one domain."""
    digits = F.regexp_extract(source, r"([0-9]{1,9})$", 1)
    return F.coalesce(F.when(digits != "", F.concat(F.lit("domain"), (digits.cast("long") % DOMAINS).cast("string"))), F.lit("other"))


def _weight(level: str, name: Column) -> Column:
    """Weight of a node among its siblings: languages as listed (others 1), domains and sources alike."""
    if level != "language":
        return F.lit(1).cast("long")
    out = F.lit(1)
    for k, w in LANGUAGE_WEIGHTS.items():
        out = F.when(name == k, w).otherwise(out)
    return out.cast("long")


def _dealt(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Split ``budget`` of the parent over rows with ``capacity`` and ``weight``: adds ``part``.

    In order of capacity per weight, a child is full when its capacity per weight is at most what
    is left per weight left; the others share what is left in whole tokens, cut at cumulative weights.
    """
    order = [(F.col("capacity") / F.col("weight")).asc(), F.col(name).asc()]
    before = Window.partitionBy(*parent).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy(*parent)
    nodes = nodes.withColumns({"__before": F.coalesce(F.sum("capacity").over(before), F.lit(0)),
                               "__left": F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0))})
    full = F.col("capacity") * F.col("__left") <= (F.col("budget") - F.col("__before")) * F.col("weight")
    nodes = nodes.withColumn("__full", full)
    used = F.coalesce(F.sum(F.when(F.col("__full"), F.col("capacity"))).over(all_), F.lit(0))
    open_ = F.when(~F.col("__full"), F.col("weight")).otherwise(0)
    upto = Window.partitionBy(*parent).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    nodes = nodes.withColumns({"__rest": F.col("budget") - used, "__open": open_, "__all": F.sum(open_).over(all_), "__upto": F.sum(open_).over(upto)})
    share = F.expr("(__upto * __rest) div __all - ((__upto - __open) * __rest) div __all")
    return nodes.withColumn("part", F.when(F.col("__full"), F.col("capacity")).otherwise(share)).drop(
        "__before", "__left", "__full", "__rest", "__open", "__all", "__upto")


def leaf_budgets(counted: DataFrame, fraction: tuple[int, int] = FRACTION, epochs: int = EPOCHS) -> DataFrame:
    """Budget of each leaf: domain, language, source, tokens, capacity, part.

    Leaves without tokens get nothing. ``counted`` has domain, language, source and tokens.
    """
    leaves = checkpointed(counted.groupBy("domain", "language", "source").agg(F.sum("tokens").alias("tokens"))
                          .filter("tokens > 0").withColumn("capacity", F.col("tokens") * epochs))
    sums = F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens")
    languages = leaves.groupBy("domain", "language").agg(*sums)
    # the few domains hang from one root, whose budget is a part of all tokens
    domains = languages.groupBy("domain").agg(*sums).withColumn("__root", F.lit(1))
    total = F.sum("tokens").over(Window.partitionBy("__root"))
    domains = domains.withColumn("__total", total).withColumn("budget", F.expr(f"(__total * {fraction[0]}) div {fraction[1]}")).drop("__total", "tokens")
    domains = _dealt(domains.withColumn("weight", _weight("domain", F.col("domain"))), ["__root"], "domain")
    languages = languages.join(domains.select("domain", F.col("part").alias("budget")), "domain")
    languages = _dealt(languages.withColumn("weight", _weight("language", F.col("language"))), ["domain"], "language")
    rows = leaves.join(languages.select("domain", "language", F.col("part").alias("budget")), ["domain", "language"])
    rows = _dealt(rows.withColumn("weight", _weight("source", F.col("source"))), ["domain", "language"], "source")
    return checkpointed(rows.select("domain", "language", "source", "tokens", "capacity", "part"))


def _chosen(rows: DataFrame, fraction: tuple[int, int], epochs: int, seed: int) -> DataFrame:
    """Rows with __id, domain, language, source, tokens and what else they carry; adds epoch and taken."""
    leaf = ["domain", "language", "source"]
    budgets = leaf_budgets(rows.select(*leaf, "tokens"), fraction, epochs)
    budgets = budgets.select(*leaf, F.expr("part div tokens").alias("__whole"), F.expr("part % tokens").alias("__over"))
    placed = rows.filter("tokens > 0").join(budgets, leaf).withColumn(
        "__order", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("__whole").cast("string"), F.coalesce(F.col("__id").cast("string"), F.lit("")))))
    placed = placed.withColumn("__block", F.substring("__order", 1, BLOCK_DIGITS))
    whole = placed.filter("__whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__whole") - 1))).withColumn("taken", F.col("tokens"))
    partial = placed.filter("__over > 0")
    sums = partial.groupBy(*leaf, "__block").agg(F.sum("tokens").alias("__sum"))
    carried = sums.withColumn("__carry", F.coalesce(F.sum("__sum").over(
        Window.partitionBy(*leaf).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__sum")
    inside = Window.partitionBy(*leaf, "__block").orderBy("__order", "__id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    partial = (partial.join(carried, [*leaf, "__block"]).filter("__carry < __over")
               .withColumn("__left", F.col("__over") - F.col("__carry") - F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
               .filter("__left > 0").withColumn("epoch", F.col("__whole")).withColumn("taken", F.least("tokens", "__left")))
    names = [*rows.columns, "epoch", "taken"]
    return whole.select(names).unionByName(partial.select(names))


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(F.col("doc_id").alias("__id"), domain_of(F.col("source")).alias("domain"),
                       F.coalesce(F.col("lang"), F.lit(NONE)).alias("language"), F.coalesce(F.col("source"), F.lit(NONE)).alias("source"),
                       word_count(F.col("text")).alias("tokens"), *more)


def mixture(docs: DataFrame, fraction: tuple[int, int] = FRACTION, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """What the mixture takes: doc_id, domain, language, source, epoch, tokens, taken (first tokens of the document).

    Null languages and sources are a node of their own; texts without words are never taken; rows
    that repeat a doc_id are separate rows of equal rank; an empty table gives no rows.
    """
    rows = written(_keyed(docs), "mixing")
    return _chosen(rows, fraction, epochs, seed).withColumnRenamed("__id", "doc_id")


@F.pandas_udf(StringType())
def _first_words(text: pd.Series, words: pd.Series) -> pd.Series:
    """The texts up to the end of their first so many words."""
    def cut(t: str, n: int) -> str:
        last = next(islice(_WORD.finditer(t), n - 1, n), None)
        return t if last is None else t[:last.end()]
    return pd.Series([cut(t, n) for t, n in zip(text, words, strict=True)])


def mixed(docs: DataFrame, fraction: tuple[int, int] = FRACTION, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """The documents of the mixture with their own columns, once for each epoch that takes any of their tokens.

    The choice is made on slim rows, which meet the documents once, by doc_id and a hash of the whole row. A document in
    which its leaf's budget ends, one a leaf at most, has its text cut behind the last token taken; its ``n_chars``, where there
    is such a column, follows. Of rows that are alike in all columns as many stay as are taken.
    """
    columns = docs.columns
    key = F.xxhash64(*[docs[c] for c in columns]).alias("__key")
    rows = written(_keyed(docs, key), "mixing")
    same = rows.groupBy("__id", "__key").agg(F.count("*").alias("__alike"))
    taken = _chosen(rows, fraction, epochs, seed).groupBy("__id", "__key").agg(F.collect_list(F.struct("epoch", "taken", "tokens")).alias("__taken"))
    plan = written(taken.join(
        same.withColumnRenamed("__id", "__same").withColumnRenamed("__key", "__of"), (F.col("__key") == F.col("__of")) & F.col("__id").eqNullSafe(F.col("__same"))
    ).select(F.col("__id").alias("__same"), F.col("__key").alias("__of"), "__alike", "__taken"), "mixture")
    whole = docs.select(F.struct(*[docs[c] for c in columns]).alias("__row"), key).join(
        plan, (F.col("__key") == F.col("__of")) & F.col("__row.doc_id").eqNullSafe(F.col("__same")))
    once = whole.filter("__alike = 1").unionByName(whole.filter("__alike > 1").dropDuplicates(["__same", "__of"]))
    each = once.select("__row", F.explode("__taken").alias("__t"))
    full = each.filter("__t.taken >= __t.tokens").select([F.col("__row")[c].alias(c) for c in columns])
    cut = each.filter("__t.taken < __t.tokens").withColumn("__text", _first_words(F.col("__row.text"), F.col("__t.taken")))
    own = {"text": F.col("__text")} | ({"n_chars": F.length("__text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in columns else {})
    return full.unionByName(cut.select([own.get(c, F.col("__row")[c]).alias(c) for c in columns]))


#: The same rules in SQL; a document table named ``documents`` is read.
MIXTURE_SQL = r"""
WITH rows AS (
  SELECT doc_id, COALESCE('domain' || CAST(CAST(NULLIF(regexp_extract(source, '([0-9]{1,9})$', 1), '') AS BIGINT) % 4 AS VARCHAR), 'other') AS domain,
    COALESCE(lang, '(none)') AS language, COALESCE(source, '(none)') AS source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS tokens
  FROM documents),
leaves AS (SELECT domain, language, source, CAST(SUM(tokens) AS BIGINT) AS tokens, CAST(SUM(tokens) * 2 AS BIGINT) AS capacity FROM rows GROUP BY ALL HAVING SUM(tokens) > 0),
d0 AS (SELECT domain, CAST(SUM(capacity) AS BIGINT) AS capacity, 1 AS weight, (SELECT CAST(SUM(tokens) AS BIGINT) // 2 FROM leaves) AS budget FROM leaves GROUP BY domain),
d1 AS (SELECT *, COALESCE(SUM(capacity) OVER b, 0) AS bef, SUM(weight) OVER () - COALESCE(SUM(weight) OVER b, 0) AS lef FROM d0 WINDOW b AS (ORDER BY capacity / weight, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
d2 AS (SELECT *, capacity * lef <= (budget - bef) * weight AS is_full FROM d1),
d3 AS (SELECT *, budget - COALESCE(SUM(CASE WHEN is_full THEN capacity END) OVER (), 0) AS rest, CASE WHEN is_full THEN 0 ELSE weight END AS opn FROM d2),
d4 AS (SELECT *, SUM(opn) OVER () AS total, SUM(opn) OVER (ORDER BY capacity / weight, domain ROWS UNBOUNDED PRECEDING) AS upto FROM d3),
d AS (SELECT domain, CASE WHEN is_full THEN capacity ELSE (upto * rest) // total - ((upto - opn) * rest) // total END AS part FROM d4),
l0 AS (SELECT domain, language, CAST(SUM(capacity) AS BIGINT) AS capacity, CASE language WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END AS weight FROM leaves GROUP BY ALL),
l1 AS (SELECT l0.*, part AS budget, COALESCE(SUM(capacity) OVER b, 0) AS bef, SUM(weight) OVER (PARTITION BY domain) - COALESCE(SUM(weight) OVER b, 0) AS lef FROM l0 JOIN d USING (domain)
  WINDOW b AS (PARTITION BY domain ORDER BY capacity / weight, language ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l2 AS (SELECT *, capacity * lef <= (budget - bef) * weight AS is_full FROM l1),
l3 AS (SELECT *, budget - COALESCE(SUM(CASE WHEN is_full THEN capacity END) OVER (PARTITION BY domain), 0) AS rest, CASE WHEN is_full THEN 0 ELSE weight END AS opn FROM l2),
l4 AS (SELECT *, SUM(opn) OVER (PARTITION BY domain) AS total, SUM(opn) OVER (PARTITION BY domain ORDER BY capacity / weight, language ROWS UNBOUNDED PRECEDING) AS upto FROM l3),
l AS (SELECT domain, language, CASE WHEN is_full THEN capacity ELSE (upto * rest) // total - ((upto - opn) * rest) // total END AS part FROM l4),
s1 AS (SELECT leaves.*, part AS budget, 1 AS weight, COALESCE(SUM(capacity) OVER b, 0) AS bef, COUNT(*) OVER (PARTITION BY domain, language) - COALESCE(COUNT(*) OVER b, 0) AS lef FROM leaves JOIN l USING (domain, language)
  WINDOW b AS (PARTITION BY domain, language ORDER BY capacity, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s2 AS (SELECT *, capacity * lef <= budget - bef AS is_full FROM s1),
s3 AS (SELECT *, budget - COALESCE(SUM(CASE WHEN is_full THEN capacity END) OVER (PARTITION BY domain, language), 0) AS rest, CASE WHEN is_full THEN 0 ELSE weight END AS opn FROM s2),
s4 AS (SELECT *, SUM(opn) OVER (PARTITION BY domain, language) AS total, SUM(opn) OVER (PARTITION BY domain, language ORDER BY capacity, source ROWS UNBOUNDED PRECEDING) AS upto FROM s3),
s AS (SELECT domain, language, source, tokens AS leaf_tokens, CASE WHEN is_full THEN capacity ELSE (upto * rest) // total - ((upto - opn) * rest) // total END AS part FROM s4),
placed AS (SELECT rows.*, CAST(part // leaf_tokens AS BIGINT) AS whole, CAST(part % leaf_tokens AS BIGINT) AS over_ FROM rows JOIN s USING (domain, language, source) WHERE tokens > 0),
ordered AS (SELECT *, over_ - COALESCE(SUM(tokens) OVER (PARTITION BY domain, language, source ORDER BY md5('17:' || CAST(whole AS VARCHAR) || ':' || COALESCE(CAST(doc_id AS VARCHAR), '')), doc_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining FROM placed)
SELECT doc_id, domain, language, source, tokens, epoch, tokens AS taken FROM (SELECT *, unnest(range(whole)) AS epoch FROM placed)
UNION ALL
SELECT doc_id, domain, language, source, tokens, whole AS epoch, CAST(LEAST(tokens, remaining) AS BIGINT) AS taken FROM ordered WHERE remaining > 0
"""

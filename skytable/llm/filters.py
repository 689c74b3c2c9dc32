"""Filter interaction audit: what each filter of every order removes, repeats and costs.

Five filters look at a whole text (null: empty). A text fails

- A with under 200 words, B with 100 * distinct words < 50 * words,
- C with 100 * A-Z characters > 3 * code points, D with any of ``#$%&*|``,
- E when a smaller doc_id has the very same text, wherever it stands and whether it is removed or not.

Documents are first added up by part, set of failed filters and labels: 128 weights a part at any
input size. The orders are then settled by a min-plus product: a mask matrix (0 where a set holds the
filter, else infinite) is added to the inverse permutations (place of each filter in each order), and
the least sum over the filters is the step that removes the set. Weights are scattered to those steps.

Copies are found by the SHA-256 of the text; the least doc_id of a digest is combined before its
shuffle, and rows meet it by digest and doc_id together, so a text with a third of all rows is no hot
key.

Cases: rows without a doc_id never fail E and have no labels; rows that repeat a doc_id are separate
documents and do not fail E by each other; a document is good or toxic if any of its label rows says
so; null and empty languages are one part; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytable.functions.storage import written

LETTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
_CAPITALS = bytes(range(65, 91))
_MARKS = b"#$%&*|"
_FAR = 1 << 20
RESULT = ("part string, filter_order string, step int, filter string, kept long, removed long, redundant long, "
          "unique_fails long, good_lost long, toxic_lost long, shapley long")


def fails(text: bytes) -> int:
    """Bits 0 to 3: the text fails A, B, C, D."""
    words = text.split()  # bytes.split() cuts at exactly \x20 and \x09-\x0D
    n = len(words)
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.decode("utf-8", "replace"))
    marked = len(text) != len(text.translate(None, _MARKS))
    return (n < LEAST_WORDS) | (100 * len(set(words)) < LEAST_DISTINCT * n) << 1 | (100 * capitals > MOST_CAPITALS * points) << 2 | marked << 3


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("__text").cast(pa.binary())
        bits, digests = [], []
        for x in texts:
            text = x.as_py()
            bits.append(fails(text))
            digests.append(hashlib.sha256(text).digest())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("part"), pa.array(bits, pa.int32()), pa.array(digests, pa.binary())],
                                         ["id", "part", "bits", "digest"])


ORDERS = ["".join(p) for p in permutations(LETTERS)]
#: Place of each filter in each order: the inverse permutations.
PLACES = np.array([[o.index(f) for f in LETTERS] for o in ORDERS])
#: 0 where a set of failed filters holds the filter.
MASKS = np.where((np.arange(32)[:, None] >> np.arange(5)) & 1 == 1, 0, _FAR)
#: Step (from 0) at which an order removes a set; _FAR or more: it is kept.
REMOVAL = (MASKS[:, None, :] + PLACES[None, :, :]).min(axis=2)


def audit(weights: np.ndarray) -> dict[str, np.ndarray]:
    """Counts by order and step from weights[good][toxic][set of failed filters], all as 120 x 5."""
    sets, orders = np.nonzero(REMOVAL < _FAR)
    steps = REMOVAL[sets, orders]

    def scattered(w: np.ndarray) -> np.ndarray:
        out = np.zeros((len(ORDERS), 5), dtype=np.int64)
        np.add.at(out, (orders, steps), w[sets])
        return out
    all_ = weights.sum(axis=(0, 1))
    removed = scattered(all_)
    acting = np.argsort(PLACES, axis=1)  # filter at each step
    failing = (np.arange(32)[:, None] >> np.arange(5)) & 1
    late = np.zeros((len(ORDERS), 5), dtype=np.int64)
    for step in range(5):
        again = failing[:, acting[:, step]] * (REMOVAL < step)  # sets x orders
        late[:, step] = all_ @ again
    shapley = np.array([removed[np.arange(len(ORDERS)), PLACES[:, f]].sum() for f in range(5)])
    return {"kept": all_.sum() - np.cumsum(removed, axis=1), "removed": removed, "redundant": late,
            "unique_fails": all_[1 << np.arange(5)][acting], "good_lost": scattered(weights[1].sum(axis=0)),
            "toxic_lost": scattered(weights[:, 1].sum(axis=0)), "shapley": shapley[acting]}


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, cells in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist(), strict=True):
            weights = np.zeros((2, 2, 32), dtype=np.int64)
            for c in cells:
                weights[int(c["good"]), int(c["toxic"]), c["bits"]] += c["n"]
            counts = audit(weights)
            rows = {"part": pa.array([part] * len(ORDERS) * 5), "filter_order": pa.array(np.repeat(ORDERS, 5).tolist()),
                    "step": pa.array(np.tile(np.arange(1, 6, dtype=np.int32), len(ORDERS))), "filter": pa.array(list("".join(ORDERS)))}
            yield pa.RecordBatch.from_pydict(rows | {k: pa.array(v.reshape(-1), pa.int64()) for k, v in counts.items()})


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step; ``shapley`` adds up the step's filter over all orders."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("__text"))
    judged = written(rows.mapInArrow(_judged, "id long, part string, bits int, digest binary"), "judged")
    first = judged.groupBy("digest").agg(F.min("id").alias("id")).filter("id is not null").withColumn("first", F.lit(True))
    said = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    copy = (F.col("id").isNotNull() & F.col("first").isNull()).cast("int")
    cells = judged.join(first, ["digest", "id"], "left").withColumn("bits", F.col("bits") + 16 * copy).join(said, "id", "left").groupBy(
        "part", "bits", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(F.count("*").alias("n"))
    return cells.groupBy("part").agg(F.collect_list(F.struct("bits", "good", "toxic", "n")).alias("cells")).mapInArrow(_audited, RESULT)


#: The same in SQL over ``documents`` and ``labels``.
AUDIT_SQL = r"""
WITH t AS (SELECT doc_id, COALESCE(lang, '') AS part, COALESCE(text, '') AS x, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, COALESCE(MAX(quality = 1), false) AS good, COALESCE(MAX(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_extract_all(x, '[A-Z]')) > 3 * length(x) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN t.doc_id > MIN(t.doc_id) OVER (PARTITION BY x) THEN 'E' ELSE '' END AS fails, COALESCE(good, false) AS good, COALESCE(toxic, false) AS toxic
  FROM t LEFT JOIN l ON t.doc_id = l.doc_id),
g AS (SELECT part, fails, COUNT(*) AS n, COUNT(*) FILTER (good) AS good, COUNT(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
r AS (SELECT g.*, filter_order, COALESCE(list_min(list_filter(range(1, 6), lambda k: contains(fails, substr(filter_order, CAST(k AS BIGINT), 1)))), 9) AS hit FROM g, o),
s AS (SELECT part, filter_order, CAST(k AS INTEGER) AS step, substr(filter_order, k, 1) AS filter, COALESCE(SUM(n) FILTER (hit > k), 0) AS kept, COALESCE(SUM(n) FILTER (hit = k), 0) AS removed,
    COALESCE(SUM(n) FILTER (hit < k AND contains(fails, substr(filter_order, k, 1))), 0) AS redundant, COALESCE(SUM(n) FILTER (fails = substr(filter_order, k, 1)), 0) AS unique_fails,
    COALESCE(SUM(good) FILTER (hit = k), 0) AS good_lost, COALESCE(SUM(toxic) FILTER (hit = k), 0) AS toxic_lost
  FROM r, (SELECT unnest(range(1, 6)) AS k) GROUP BY part, filter_order, k)
SELECT part, filter_order, step, filter, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(SUM(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM s"""

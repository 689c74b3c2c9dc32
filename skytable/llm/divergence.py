"""Source divergence audit: how the words of each source differ from those of the other sources of its language.

Terms are runs of letters (A-Z, a-z, all from U+0080 on), A-Z as a-z. They are counted by sorting
pointers: the texts of a slice lie in one buffer, a pointer stands at each term's start, and a
multikey quicksort orders the pointers. Its character is 8 bytes wide; only pointers that are equal
so far and have not ended go on to the next 8. Equal runs give a term's documents and occurrences by
source. A term never holds a zero byte, so the zeros behind an end order and part it right.

A language keeps the V terms in at least 3 of its documents. With N occurrences of kept terms, a term
with count c has p = 1 + floor(10**9 * (c + 1) / (N + V)), and two probabilities p, q differ by
floor((p - q) * (p - q) / q). Everything is whole numbers.

Sources are compared over blocks of terms: a block holds terms times sources numbers, about
BLOCK_CELLS of them at any vocabulary and any number of sources, and gives one sum for each pair of
sources, of which the result has a row anyway. Only the sums meet. Terms that a source lacks have its
least probability in the block, without a row.

Cases: null text, language and source are ''; rows that repeat a doc_id count each; a group without
terms still has its pairs (with V = 0 they are 0); an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skytable.functions.storage import written

LEAST_DOCS = 3
SCALE = 1_000_000_000
TERM_RANKS = 200
# Bytes of text whose pointers are sorted together.
SLICE_BYTES = 4 << 20
BLOCK_CELLS = 1 << 17
# Sources that a block compares with all others at once.
TILE_SOURCES = 512
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def term_pointers(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the terms of a buffer start and end."""
    inside = _LETTER[buffer].view(np.int8)
    change = np.flatnonzero(np.diff(inside, prepend=np.int8(0), append=np.int8(0)))
    return change[::2], change[1::2]


def multikey_sorted(buffer: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the pointers by their terms, and where in that order a new term begins."""
    padded = np.concatenate([buffer, np.zeros(8, dtype=np.uint8)])
    wide = np.ndarray(len(buffer) + 1, dtype=">u8", buffer=padded, strides=(1,))
    # bits of the first k bytes of a wide character
    cut = np.array([(1 << 64) - (1 << (64 - 8 * k)) for k in range(9)], dtype=np.uint64)
    n = len(start)
    order, new = np.arange(n), np.zeros(n, dtype=bool)
    new[:1] = True
    places, depth = np.arange(n), 0
    while len(places):
        at = order[places]
        left = np.minimum(end[at] - start[at] - depth, 8)
        key = wide[start[at] + depth].astype(np.uint64) & cut[left]
        if depth:
            inner = np.lexsort((key, np.cumsum(new[places])))
        else:
            inner = np.argsort(key)
        order[places], key, left = at[inner], key[inner], left[inner]
        new[places[1:]] |= key[1:] != key[:-1]
        # slices of two or more that have not ended go deeper
        alone = new[places] & np.append(new[places[1:]], True)
        places = places[(left == 8) & ~alone]
        depth += 8
    return order, new


def _summed(codes: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct codes in order, and the values of each added up (how often it occurs, where none are given)."""
    if not values:
        codes = np.sort(codes)
    else:
        order = np.argsort(codes, kind="stable")
        codes, values = codes[order], tuple(v[order] for v in values)
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, dtype=np.int64)
    if not values:
        return codes[first], np.diff(np.append(first, len(codes)))
    return codes[first], *[np.add.reduceat(v, first) if len(first) else v for v in values]


def counted(texts: list[bytes], groups: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """For each term and group of texts that has it: term, group, occurrences, texts."""
    joined = b"\n".join([*texts, b""]).translate(_LOWER)
    buffer = np.frombuffer(joined, dtype=np.uint8)
    start, end = term_pointers(buffer)
    if not len(start):
        none = np.zeros(0, dtype=np.int64)
        return [], none, none, none
    ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1)
    doc = np.searchsorted(ends, start, side="right")
    order, new = multikey_sorted(buffer, start, end)
    run = np.cumsum(new) - 1
    pair, times = _summed(run * len(texts) + doc[order])
    run_of, doc_of = np.divmod(pair, len(texts))
    many = int(groups.max()) + 1
    code, times, docs = _summed(run_of * many + groups[doc_of], times, np.ones(len(times), dtype=np.int64))
    head = order[np.flatnonzero(new)]
    words = [joined[a:b] for a, b in zip(start[head].tolist(), end[head].tolist(), strict=True)]
    of, group = np.divmod(code, many)
    return [words[k] for k in of.tolist()], group, times, docs


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("__text").cast(pa.binary())
        sizes = np.asarray(pa.compute.binary_length(column), dtype=np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE_BYTES)) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b == a:
                continue
            known: dict[tuple[str, str], int] = {}
            pairs = zip(batch.column("lang").slice(a, b - a).to_pylist(), batch.column("source").slice(a, b - a).to_pylist(), strict=True)
            groups = np.fromiter((known.setdefault(p, len(known)) for p in pairs), dtype=np.int64, count=b - a)
            words, group, times, docs = counted(column.slice(a, b - a).to_pylist(), groups)
            names = list(known)
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[g][0] for g in group.tolist()], pa.string()), pa.array([names[g][1] for g in group.tolist()], pa.string()),
                 pa.array(words, pa.binary()).cast(pa.string()), pa.array(times, pa.int64()), pa.array(docs, pa.int64())],
                ["lang", "source", "term", "n", "docs"])


def probability(count: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)) in whole numbers; null where there are no terms."""
    return F.expr(f"1 + (cast({count} + 1 as decimal(20, 0)) * {SCALE}) div nullif(cast({total} + {terms} as decimal(20, 0)), 0)").cast("long")


def _pairs(key: tuple, rows: pa.Table, sources: pa.Table) -> pa.Table:
    """Sums over the terms of a block: each source of the tile against all others of its language."""
    lang = sources.column("lang")[0].as_py() if len(sources) else None
    names = sources.column("source").to_pylist()
    mine = [i for i, m in enumerate(sources.column("mine").to_pylist()) if m]
    place = {s: i for i, s in enumerate(names)}
    out = np.zeros((len(mine), len(names)), dtype=np.int64)
    if len(rows):
        terms, term = np.unique(np.asarray(rows.column("term_key")), return_inverse=True)
        p = np.tile(np.asarray(sources.column("least").to_numpy(), dtype=np.int64), (len(terms), 1))
        p[term, np.fromiter((place[s] for s in rows.column("source").to_pylist()), dtype=np.int64, count=len(rows))] = np.asarray(rows.column("p"))
        for i, a in enumerate(mine):
            apart = p[:, a:a + 1] - p
            out[i] = (apart * apart // p).sum(axis=0)
    a, b = [x.reshape(-1) for x in np.meshgrid(mine, np.arange(len(names)), indexing="ij")]
    other = a != b
    return pa.table({"lang": pa.array([lang] * int(other.sum()), pa.string()), "source": pa.array([names[k] for k in a[other].tolist()], pa.string()),
                     "item": pa.array([names[k] for k in b[other].tolist()], pa.string()), "value": pa.array(out.reshape(-1)[other], pa.int64())})


def divergences(docs: DataFrame) -> DataFrame:
    """Rows lang, source, part (pair or term), item, value, rank: see the head of the module."""
    blank = {c: F.coalesce(F.col(c), F.lit("")) for c in ("lang", "source", "text")}
    rows = docs.select(blank["lang"].alias("lang"), blank["source"].alias("source"), blank["text"].alias("__text"))
    counts = written(rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
                     .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term_counts")
    whole = written(counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
                    .filter(F.col("docs") >= LEAST_DOCS).drop("docs"), "kept_terms")
    kept = written(counts.drop("docs").join(whole, ["lang", "term"]), "kept_counts")
    totals = whole.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    groups = rows.select("lang", "source").distinct().join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    langs = groups.groupBy("lang").agg(F.count("*").alias("many")).join(totals, "lang", "left")
    groups = groups.join(langs, "lang").select(
        "lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "terms", "lang_total")],
        F.greatest(F.lit(1), F.ceil(F.coalesce("terms", F.lit(0)) * F.col("many") / BLOCK_CELLS)).cast("int").alias("blocks"),
        F.ceil(F.col("many") / TILE_SOURCES).cast("int").alias("tiles"))
    groups = written(groups.withColumn("least", F.coalesce(probability("0L", "total", "terms"), F.lit(1).cast("long"))), "groups")
    placed = kept.join(groups, ["lang", "source"]).withColumn("p", probability("n", "total", "terms"))

    key = F.xxhash64("term")
    cells = placed.select("lang", F.pmod(key, F.col("blocks")).cast("int").alias("block"), "tiles", "source", "p", key.alias("term_key"))
    cells = cells.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).drop("tiles")
    sides = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    sides = sides.select("lang", "block", "tile", "source", "least", (F.pmod(F.xxhash64("source"), F.col("tiles")) == F.col("tile")).alias("mine"))
    of = ["lang", "block", "tile"]
    sums = cells.groupBy(*of).cogroup(sides.groupBy(*of)).applyInArrow(_pairs, "lang string, source string, item string, value long")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))

    apart = placed.withColumn("q", probability("lang_n", "lang_total", "terms")).filter("n > 0 and p > q")
    terms = apart.select("lang", "source", F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div q").alias("value"), F.lit("term").alias("part"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = [pairs.withColumn("rank", F.row_number().over(order)), terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TERM_RANKS)]
    names = ["lang", "source", "part", "item", "value", "rank"]
    return ranked[0].select(names).unionByName(ranked[1].select(names))


#: The same in SQL over ``documents``.
DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row_id, COALESCE(lang, '') AS lang, COALESCE(source, '') AS source,
    regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT lang, source, term, COUNT(*) AS n, COUNT(DISTINCT row_id) AS docs FROM (SELECT row_id, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term, SUM(n) AS lang_n FROM t GROUP BY ALL HAVING SUM(docs) >= 3),
v AS (SELECT lang, COUNT(*) AS terms, SUM(lang_n) AS lang_total FROM k GROUP BY lang),
g AS (SELECT a.lang, a.source, COALESCE(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) a
  LEFT JOIN (SELECT t.lang, t.source, SUM(n) AS total FROM t JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL) b ON a.lang = b.lang AND a.source = b.source),
c AS (SELECT g.lang, g.source, k.term, COALESCE(n, 0) AS n, 1 + (1000000000 * (COALESCE(n, 0) + 1)) // (total + terms) AS p, 1 + (1000000000 * (lang_n + 1)) // (lang_total + terms) AS q
  FROM g JOIN k ON g.lang = k.lang JOIN v ON g.lang = v.lang LEFT JOIN t ON t.lang = g.lang AND t.source = g.source AND t.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, SUM(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM c a JOIN c b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL),
all_ AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(COALESCE(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source != b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM c WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(ROW_NUMBER() OVER o AS INTEGER) AS rank FROM all_
WINDOW o AS (PARTITION BY lang, source, part ORDER BY value DESC, item) QUALIFY part = 'pair' OR ROW_NUMBER() OVER o <= 200"""

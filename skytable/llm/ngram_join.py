"""N-gram Jaccard join: candidates share prefix tokens under several global orders, and only those are verified.

A document is the set of its 3-word shingles. Two sets of Jaccard similarity t share a token among
the first n - ceil(t n) + 1 tokens of each, under any order of all tokens. Three orders are used:
rare tokens first (by how often the words of the shingle occur in all documents; any function of the token is a
valid order, so the counts need not be exact; words are counted because a row of bins tells the words of any corpus
apart, but not its shingles), and two orders by independent hashes. Buckets of the first order
propose pairs whose sizes, places in the order and parity bitmaps leave enough to share. A pair goes on
only if it also shares prefix tokens under the second and third order, and if parity bitmaps that grow
with the sets (two bits a token) do not differ in more bits than a linked pair may have tokens apart.
Up to there only prefixes and bitmaps move; the shingle sets themselves are brought to the pairs that are left.

Documents of equal sets are one node. Only connection is asked for, so members of a bucket are first
compared with one of them; see ``components.linked``. Prefixes are kept in a written table; whole
sets are made again for candidates only, which a bitmap of hashed ids (MAP_BITS at any input size)
picks out of the scan so that no text is shuffled. What the bitmap lets through too much falls out
of the join by id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytable.functions.storage import checkpointed, removed, written, written_at
from skytable.llm.components import linked
from skytable.llm.words import Words, mixed, shingles, steps

WORDS = 3
# Two documents link when PERCENT * union <= 100 * intersection.
PERCENT = 90
BINS = 16
PARTS = 64
# Steps of a rank for each doubling of a word's count, and the highest rank.
FINE, RANKS = 2, 255
# Bits of the candidates' bitmap (2 ** MAP_BITS), as words of 32.
MAP_BITS = 24
_BITS = np.uint64(52)
_LOW = np.uint64((1 << 52) - 1)
_ORDERS = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))
_PIECES = 4096
_PARITY = [f"p{k}" for k in range(4)]


def _pieces(texts: list[bytes]) -> Iterator[tuple[int, Words]]:
    """Runs of texts: the first text's place, and the words."""
    for i in range(0, len(texts), _PIECES):
        yield i, Words(texts[i:i + _PIECES])


def _keys(w: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All keys text << 52 | shingle in the order of the words, the same distinct and sorted, and where texts begin and end in those."""
    h, of = shingles(w.hashes, w.first, w.last, size)
    every = (of.astype(np.uint64) << _BITS) | (h >> np.uint64(12))
    keys = np.unique(every)
    return every, keys, np.searchsorted(keys, np.arange(len(w.first) + 1, dtype=np.uint64) << _BITS)


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    ends = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def _bins(w: Words) -> np.ndarray:
    return (w.hashes >> np.uint64(64 - BINS)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many words lie in each bin, as PARTS rows a task."""
    total = np.zeros(1 << BINS, dtype=np.int64)
    for batch in batches:
        for _, texts in steps(batch, "__text"):
            for _, w in _pieces(texts):
                total += np.bincount(_bins(w), minlength=1 << BINS)
    if total.any():
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(PARTS), pa.int32()), "n": pa.array(list(total.reshape(PARTS, -1)), pa.list_(pa.int64()))})


def _added(table: pa.Table) -> pa.Table:
    total = np.stack([np.asarray(c.as_py(), dtype=np.int64) for c in table.column("n")]).sum(axis=0)
    return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "n": pa.array([total], pa.list_(pa.int64()))})


def _prefix(n: np.ndarray, ends: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Length of each set's prefix, and the places of prefixes in sets laid out at ``ends``."""
    take = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
    return take, np.repeat(ends[:-1], take) + np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)


def _digest(h: np.ndarray, ends: np.ndarray, n: np.ndarray) -> np.ndarray:
    """64-bit digest of each set: the sum of its scrambled tokens, scrambled with its size."""
    total = np.add.reduceat(np.append(mixed(h), np.uint64(0)), ends[:-1])
    return mixed(np.where(n > 0, total, np.uint64(0)) ^ mixed(n.astype(np.uint64))).view(np.int64)


def _parities(h: np.ndarray, n: np.ndarray) -> pa.ListArray:
    """For each set a bitmap of at least two bits a token: how often each residue occurs, modulo 2.

    Sizes are powers of 2, so that the larger bitmap of two may be folded onto the smaller.
    """
    words = 1 << np.ceil(np.log2(np.maximum(n / 32, 4))).astype(np.int64)
    ends = np.cumsum(words)
    mask = np.repeat(words * 64 - 1, n).astype(np.uint64)
    place = np.repeat((ends - words) * 64, n) + (h & mask).astype(np.int64)
    odd = np.bincount(place, minlength=int(ends[-1]) * 64 if len(n) else 0) & 1
    return _lists(np.packbits(odd.astype(np.uint8)).view(np.int64), words, pa.int64())


def _folded(one: str, other: str) -> str:
    """SQL for bitmap ``one`` at the size of the smaller of both."""
    return (f"CASE WHEN size({one}) <= size({other}) THEN {one} ELSE transform(sequence(0, size({other}) - 1), "
            f"i -> aggregate(sequence(i, size({one}) - 1, size({other})), 0L, (s, j) -> s ^ {one}[j])) END")


def rarity(texts: DataFrame) -> np.ndarray:
    """Logarithm (base 2) of the words in each bin. 4 << BINS bytes at any input size."""
    parts = texts.mapInArrow(_counted, "part int, n array<long>").groupBy("part").applyInArrow(_added, "part int, n array<long>").collect()
    total = np.zeros((PARTS, (1 << BINS) // PARTS))
    for r in parts:
        total[r["part"]] = r["n"]
    return np.log2(1 + total.reshape(-1)).astype(np.float32)


def _ranked(w: Words, size: int, logs: np.ndarray) -> np.ndarray:
    """Rank of each shingle in the order of the words, rare first: the logarithms of its words' counts, added up."""
    each = np.rint(FINE * logs[_bins(w)]).astype(np.int64)
    total = np.append(0, np.cumsum(each))
    counts = w.counts()
    many = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(w.first, many)
    return np.minimum(total[at + np.repeat(np.minimum(counts, size), many)] - total[at], RANKS).astype(np.uint64)


def _prefixed(shared, size: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, short = shared.value, np.uint64((1 << 44) - 1)
        for batch in batches:
            for part, texts in steps(batch, "__text"):
                for i, w in _pieces(texts):
                    every, keys, ends = _keys(w, size)
                    n, h = np.diff(ends), keys & _LOW
                    take, at = _prefix(n, ends, percent)
                    rank = _ranked(w, size, logs)
                    ranked = np.unique((every & ~_LOW) | (rank << np.uint64(44)) | (every & short))
                    if len(ranked) != len(keys) or not np.array_equal(ranked >> _BITS, keys >> _BITS):
                        # two tokens of a text end alike: take the rank of each distinct one
                        _, first = np.unique(every, return_index=True)
                        ranked = np.sort((keys & ~_LOW) | (rank[first] << np.uint64(44)) | (h & short))
                    rare = ranked[at] & _LOW
                    digest = _digest(h, ends, n)
                    # 256 bits: how often each residue occurs in the set, modulo 2
                    odd = np.bincount(((keys >> _BITS) << np.uint64(8) | (h & np.uint64(255))).astype(np.int64), minlength=len(n) * 256) & 1
                    parity = np.packbits(odd.astype(np.uint8).reshape(len(n), 256), axis=1).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [part.slice(i, len(n)).column("__id"), pa.array(n, pa.int64()), pa.array(digest),
                         _lists(rare.astype(np.int64), take, pa.int64()), *[pa.array(np.ascontiguousarray(parity[:, k])) for k in range(4)]],
                        ["id", "n", "d1", "rare", *_PARITY])
    return prefixes


def _whole(size: int, percent: int, shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sets of the rows whose id is on the bitmap, with their sizes, parities and prefixes under the second and third order."""
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, bitmap = shared.value
        for batch in batches:
            place = np.asarray(batch.column("__place"), dtype=np.int64)
            batch = batch.filter(pa.array((bitmap[place >> 5] >> (place & 31).astype(np.uint32)) & 1 == 1))
            for _, texts in steps(batch, "__text"):
                for _, w in _pieces(texts):
                    _, keys, ends = _keys(w, size)
                    n = np.diff(ends)
                    piece, h = keys & ~_LOW, keys & _LOW
                    take, at = _prefix(n, ends, percent)
                    other = [(np.sort(piece | (mixed(h ^ c) >> np.uint64(12)))[at] & _LOW).astype(np.int64) for c in _ORDERS]
                    yield pa.RecordBatch.from_arrays([pa.array(_digest(h, ends, n)), pa.array(n, pa.int64()), *[_lists(o, take, pa.int64()) for o in other],
                                                      _parities(h, n), _lists(h.astype(np.int64), n, pa.int64())], ["id", "n", "order2", "order3", "parity", "set"])
    return whole


def bitmap_place(id_: Column) -> Column:
    """Place of an id on the bitmap."""
    return F.xxhash64(id_).bitwiseAND((1 << MAP_BITS) - 1)


def bitmap_of(places: DataFrame) -> tuple[int, np.ndarray]:
    """Size and words of a bitmap of the numbers ``place``, taken modulo its size: 2 ** MAP_BITS bits at any input size."""
    place = F.col("place").bitwiseAND((1 << MAP_BITS) - 1)
    bit = F.pow(F.lit(2.0), place.bitwiseAND(31).cast("double")).cast("long")
    got = places.select(F.shiftright(place, 5).cast("int").alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (MAP_BITS - 5), dtype=np.uint32)
    out[np.asarray(got.column("word"))] = np.asarray(got.column("bits")).astype(np.uint32)
    return 1 << MAP_BITS, out


def joined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, n_shingles, component_id, class_id) and the links between sets (a, b: digests).

    Classes are documents of equal sets (by a 64-bit digest), named by their smallest id; links are proven and connect
    all that is linked, but pairs within what is already connected are not all listed. Null and
    empty texts have no shingles and no links. A row without an id takes part in no link and is its
    own component (null). Rows that repeat an id each have a row; an id with several texts stands in
    the class of each.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    logs = docs.sparkSession.sparkContext.broadcast(rarity(rows.select("__text")))
    prefixes = written(rows.mapInArrow(_prefixed(logs, size, percent),
                                       "id long, n long, d1 long, rare array<long>, " + ", ".join(f"{c} long" for c in _PARITY)), "prefixes")
    full = prefixes.filter("n > 0 and id is not null")
    # a node is a set, named by its digest: copies of a set fall together without a join
    reps = written(full.groupBy("d1").agg(F.min("id").alias("rep")), "classes")
    # one row for each set: the copies, which are few or fall out of a join by slim ids, take no part in buckets
    copies = written(full.select("d1", "id").join(reps, "d1").filter("id != rep").select("d1", "id").distinct(), "copies")
    single = full.join(copies, ["d1", "id"], "left_anti")
    entries = single.select(F.posexplode("rare").alias("pos", "bucket"), F.col("d1").alias("id")).select("bucket", "id", "pos")
    more = single.select(F.col("d1").alias("id"), "n", *_PARITY).dropDuplicates(["id"])

    def verify(near: DataFrame) -> DataFrame:
        ids = near.select(F.col("a").alias("d1")).union(near.select("b")).distinct().join(reps, "d1")
        bitmap = docs.sparkSession.sparkContext.broadcast(bitmap_of(ids.select(bitmap_place(F.col("rep")).alias("place"))))
        sets, sets_path = written_at(rows.filter("__id is not null").withColumn("__place", bitmap_place(F.col("__id"))).mapInArrow(
            _whole(size, percent, bitmap), "id long, n long, order2 array<long>, order3 array<long>, parity array<long>, set array<long>"), "sets")

        def beside(pairs: DataFrame, *columns: str) -> DataFrame:
            # where few pairs are left, the optimizer brings them to the sets instead of shuffling those
            x, y = [sets.select(F.col("id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]) for side in "ab"]
            return pairs.join(x, "a").join(y, "b")
        differ = f"aggregate(zip_with({_folded('parity_a', 'parity_b')}, {_folded('parity_b', 'parity_a')}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
        left, left_path = written_at(beside(near, "n", "order2", "order3", "parity").filter(
            f"arrays_overlap(order2_a, order2_b) and arrays_overlap(order3_a, order3_b) and {100 + percent} * ({differ}) <= {100 - percent} * (n_a + n_b)").select("a", "b"), "pairs")
        both = beside(left, "n", "set").select("a", "b", F.col("n_a").alias("p"), F.col("n_b").alias("q"), F.size(F.array_intersect("set_a", "set_b")).cast("long").alias("shared"))
        links = checkpointed(both.filter(f"100 * shared >= {percent} * (p + q - shared)").select("a", "b").distinct())
        removed(docs.sparkSession, sets_path, left_path)
        bitmap.destroy()
        return links

    def fits(x: str, y: str) -> str:
        # sizes; what can still be shared from the first shared token on (a linked pair passes at that token); and
        # parities: each token that only one set has turns one bit, so no pair differs in more bits than tokens
        rest = f"least({x}.n - {x}.pos, {y}.n - {y}.pos)"
        differ = " + ".join(f"bit_count({x}.{c} ^ {y}.{c})" for c in _PARITY)
        return (f"100 * least({x}.n, {y}.n) >= {percent} * greatest({x}.n, {y}.n) and {100 + percent} * {rest} >= {percent} * ({x}.n + {y}.n) "
                f"and {100 + percent} * ({differ}) <= {100 - percent} * ({x}.n + {y}.n)")

    components, links = linked(entries, verify, fits, more)
    of = reps.join(components.select(F.col("id").alias("d1"), "component"), "d1", "left").withColumn("component", F.coalesce("component", "d1"))
    least = of.groupBy("component").agg(F.min("rep").alias("least"))
    of = of.join(least, "component").select("d1", "rep", "least")
    placed = prefixes.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "d1").join(of, "d1", "left")
    linkable = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return placed.select("doc_id", "n_shingles", F.when(linkable, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
                         F.when(linkable, F.col("rep")).otherwise(F.col("doc_id")).alias("class_id")), links


def kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without those that are linked to a smaller id: one document of each group stays.

    Rows without an id and rows without words stay.
    """
    out, _ = joined(docs, id_col, text_col, size=size, percent=percent)
    gone = out.filter("doc_id != component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")

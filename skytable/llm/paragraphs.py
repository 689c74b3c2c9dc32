"""Substring dedup by paragraphs: MinHash bands propose pairs, exact Jaccard proves them, components are removed but for one.

A paragraph is a line of a text with at least LEAST_WORDS words (A-Z as a-z, between white space);
its set holds its 5-word shingles. Paragraphs of the same words are one node, named by a 64-bit hash
of the words. A node's signature has HASHES minima, cut into bands whose number and width are chosen
so that a pair at the wanted similarity shares a band with at least RECALL probability. Nodes that
share a band, and whose sizes and parity bitmaps allow the similarity, meet as in ``components.linked``; pairs are proven on the whole shingle sets, which are
made again for candidates only (picked by a bitmap of fixed size during a scan).

A passage that is copied into the middle of different lines makes neither line a near copy. For it,
runs of WINDOW words are taken as paragraphs of their own, wherever lines end: of every SPREAD runs
in a row the one with the least hash, so that any WINDOW + SPREAD - 1 words in common have one in
common. Equal runs in different documents meet by their hash (their similarity is 1).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skytable.functions.storage import checkpointed, released, removed, written, written_at
from skytable.llm.components import linked
from skytable.llm.ngram_join import bitmap_of
from skytable.llm.words import Words, mixed, powers, shingles, steps, BACK, BASE

# Six shingles.
LEAST_WORDS = 10
SIZE = 5
PERCENT = 80
HASHES = 64
RECALL = 0.999
WINDOW, SPREAD = 32, 20
_MAX_PIECES = 4096
_REMOVED = "not (doc_id <=> keep_doc_id and paragraph = keep_paragraph)"


_PARITY = [f"p{k}" for k in range(4)]
_BITS, _LOW = np.uint64(52), np.uint64((1 << 52) - 1)


def banding(hashes: int = HASHES, percent: int = PERCENT, recall: float = RECALL) -> tuple[int, int]:
    """Bands and rows: the widest bands that still find a pair at the limit with the wanted probability."""
    for rows in range(hashes, 0, -1):
        bands = hashes // rows
        if 1 - (1 - (percent / 100) ** rows) ** bands >= recall:
            return bands, rows
    return hashes, 1


class Paragraphs:
    """Lines of a list of texts with enough words: text, line number, code point range, words, hash of the words, shingles."""

    def __init__(self, texts: list[bytes], least: int, size: int):
        w = Words(texts)
        lines = np.flatnonzero(w.joined == 10)
        begin = np.concatenate([np.zeros(1, np.int64), lines[:-1] + 1]) if len(lines) else np.zeros(0, np.int64)
        first, last = np.searchsorted(w.start, begin), np.searchsorted(w.start, lines)
        text = np.searchsorted(w.text_end, begin, side="right")
        number = np.arange(len(begin)) - np.searchsorted(begin, w.text_start)[text] if len(begin) else begin
        big = np.flatnonzero(last - first >= least)
        self.text, self.number, self.first, self.last = text[big], number[big], first[big], last[big]
        points = np.concatenate([np.zeros(1, np.int64), np.cumsum((w.joined & 0xC0) != 0x80)])
        self.start = points[begin[big]] - points[w.text_start[self.text]]
        self.end = points[lines[big]] - points[w.text_start[self.text]]
        self.words = self.last - self.first
        # the words in order, as one hash: a sum of words times powers, as for bytes of a word
        at = np.arange(self.words.sum()) - np.repeat(np.cumsum(self.words) - self.words, self.words)
        each = mixed(w.hashes[np.repeat(self.first, self.words) + at] ^ mixed(at.astype(np.uint64)))
        cuts = np.cumsum(self.words) - self.words
        self.id = mixed(np.add.reduceat(each, cuts)) if len(cuts) else np.zeros(0, np.uint64)
        self._words, self._size = w.hashes, size

    def sets(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles of at most _MAX_PIECES paragraphs as place << 52 | hash, sorted, and where each set begins and ends."""
        h, of = shingles(self._words, self.first[keep], self.last[keep], self._size)
        both = np.unique((of.astype(np.uint64) << _BITS) | (h >> np.uint64(12)))
        return both, np.searchsorted(both, np.arange(len(keep) + 1, dtype=np.uint64) << _BITS)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _signatures(least: int, size: int, bands: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    factors = mixed(np.arange(2 * bands * rows, dtype=np.uint64) + np.uint64(977)) | np.uint64(1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in steps(batch, "__text"):
                p = Paragraphs(texts, least, size)
                if not len(p.text):
                    continue
                n, parity = np.empty(len(p.text), dtype=np.int64), np.empty((len(p.text), 4), dtype=np.int64)
                keys = np.empty((len(p.text), bands), dtype=np.uint64)
                for i in range(0, len(p.text), _MAX_PIECES):
                    some = slice(i, min(i + _MAX_PIECES, len(p.text)))
                    both, ends = p.sets(np.arange(some.start, some.stop))
                    h, of, cuts = both & _LOW, (both >> _BITS).astype(np.int64), ends[:-1]
                    n[some] = np.diff(ends)
                    odd = np.bincount(of << 8 | (h & np.uint64(255)).astype(np.int64), minlength=len(cuts) * 256) & 1
                    parity[some] = np.packbits(odd.astype(np.uint8).reshape(len(cuts), 256), axis=1).view(np.int64)
                    for band in range(bands):
                        key = np.full(len(cuts), band, dtype=np.uint64)
                        for k in range(band * rows, (band + 1) * rows):
                            key = mixed(key ^ np.minimum.reduceat(h * factors[2 * k] + factors[2 * k + 1] >> np.uint64(12), cuts))
                        keys[some, band] = key
                at = pa.array(p.text)
                ends = np.arange(0, len(p.text) * bands + 1, bands, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("__id").take(at), part.column("__key").take(at), pa.array(p.number), pa.array(p.start), pa.array(p.end), pa.array(p.words), _signed(p.id),
                     pa.ListArray.from_arrays(pa.array(ends), _signed(keys.reshape(-1))), pa.array(n), *[pa.array(np.ascontiguousarray(parity[:, k])) for k in range(4)]],
                    ["doc_id", "text_key", "paragraph", "start", "end", "n_words", "id", "bands", "n", *_PARITY])
    return sign


def _sets(least: int, size: int, shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, bits = shared.value
        for batch in batches:
            for _, texts in steps(batch, "__text"):
                p = Paragraphs(texts, least, size)
                place = (p.id & np.uint64(places - 1)).astype(np.int64)
                _, first = np.unique(p.id, return_index=True)
                keep = first[(bits[place[first] >> 5] >> (place[first] & 31).astype(np.uint32)) & 1 == 1]
                for i in range(0, len(keep), _MAX_PIECES):
                    some = keep[i:i + _MAX_PIECES]
                    pair, ends = p.sets(some)
                    yield pa.RecordBatch.from_arrays([_signed(p.id[some]), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), _signed(pair & _LOW))], ["id", "set"])
    return whole


def _windows(window: int, spread: int, shared=None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Chosen runs of words: hash and doc_id; with a bitmap of hashes, only those on it, with their places."""
    highest = np.uint64(0xFFFFFFFFFFFFFFFF)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in steps(batch, "__text"):
                w = Words(texts)
                n = len(w.start)
                if n < window:
                    continue
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.hashes * powers(BASE, n)[:n], dtype=np.uint64)])
                h = mixed((total[window:] - total[:-window]) * powers(BACK, n)[:n - window + 1])
                of = np.repeat(np.arange(len(texts)), w.counts())
                inside = of[window - 1:] == of[:n - window + 1]
                h = np.where(inside, h, highest)
                wide = np.concatenate([np.full(spread - 1, highest), h, np.full(spread - 1, highest)])
                least = np.lib.stride_tricks.sliding_window_view(wide, spread).min(axis=1)
                # chosen if it is the least of any of the stretches that hold it
                at = np.flatnonzero(inside & (np.lib.stride_tricks.sliding_window_view(least, spread).max(axis=1) == h))
                if shared is None:
                    yield pa.RecordBatch.from_arrays([_signed(h[at]), part.column("__id").take(pa.array(of[at]))], ["hash", "doc_id"])
                    continue
                places, bits = shared.value
                place = (h[at] & np.uint64(places - 1)).astype(np.int64)
                at = at[(bits[place >> 5] >> (place & 31).astype(np.uint32)) & 1 == 1]
                text = of[at]
                points = np.concatenate([np.zeros(1, np.int64), np.cumsum((w.joined & 0xC0) != 0x80)])
                lines = np.cumsum(w.joined == 10)
                begin = points[w.text_start[text]]
                above = np.where(w.text_start[text] > 0, lines[w.text_start[text] - 1], 0)
                line, last = lines[w.start[at]] - above, lines[w.start[at + window - 1]] - above
                rows = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [_signed(h[at]), part.column("__id").take(rows), part.column("__key").take(rows), pa.array(line), pa.array(last),
                     pa.array(points[w.start[at]] - begin), pa.array(points[w.end[at + window - 1]] - begin)],
                    ["hash", "doc_id", "text_key", "paragraph", "last", "start", "end"])
    return run


def _passages(rows: DataFrame, classed: DataFrame, window: int, spread: int) -> DataFrame:
    """Runs of words that other documents have too, among what is left without removed lines: spans by line and kept place."""
    spark = rows.sparkSession
    known = rows.filter("__id is not null")
    hashes = known.mapInArrow(_windows(window, spread), "hash long, doc_id long").groupBy("hash").agg(F.min("doc_id").alias("p"), F.max("doc_id").alias("q"))
    hashes = written(hashes.filter("p != q").select("hash"), "windows")
    bitmap = spark.sparkContext.broadcast(bitmap_of(hashes.select(F.col("hash").alias("place"))))
    found = known.mapInArrow(_windows(window, spread, bitmap), "hash long, doc_id long, text_key long, paragraph long, last long, start long, end long")
    found = found.join(hashes, "hash", "left_semi")
    # a run that touches a removed line goes with it; the line that a class keeps stays open
    gone = classed.filter(_REMOVED).groupBy("doc_id", "text_key").agg(F.collect_set("paragraph").alias("gone"))
    open_ = written(found.join(gone, ["doc_id", "text_key"], "left").filter("gone is null or not exists(gone, x -> x between paragraph and last)").drop("gone", "last"), "window-places")
    first = open_.groupBy("hash").agg(F.min(F.struct("doc_id", "paragraph")).alias("first"), F.count("*").alias("n"), F.max("doc_id").alias("q"))
    placed = open_.join(first.filter("first.doc_id != q").drop("q"), "hash")
    # runs of one passage overlap, as they begin at most ``spread`` words apart; others are spans of their own
    line = ["doc_id", "text_key", "paragraph", "first"]
    before = Window.partitionBy(*line).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(*line).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    cut = placed.withColumn("begins", F.coalesce((F.col("start") > F.max("end").over(before)).cast("int"), F.lit(1)))
    spans = cut.withColumn("span", F.sum("begins").over(so_far)).groupBy(*line, "span").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.max("n").alias("class_size"))
    return spans.select("doc_id", "text_key", "paragraph", "start", "end", F.lit(window).cast("long").alias("n_words"), "class_size",
                        F.col("first.doc_id").alias("keep_doc_id"), F.col("first.paragraph").alias("keep_paragraph"), F.lit("passage").alias("unit"))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("__id"), F.xxhash64(text).alias("__key"), text.alias("__text"))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least: int = LEAST_WORDS, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """Every paragraph that has a copy or near copy elsewhere, and every passage within others, one row each.

    unit (paragraph or passage), doc_id, text_key (xxhash64 of the text), paragraph (line number from 0), start, end (code points
    of the text), n_words, class_size, keep_doc_id, keep_paragraph (the class's first paragraph by
    doc_id, null last, and number), removed (all but that one). A passage has the line in which it
    begins, the range of its runs and at least n_words words. Shorter paragraphs, null and empty
    texts give no rows. Rows that repeat a doc_id and text repeat its paragraphs; those of the kept
    place all stay.
    """
    bands, width = banding(percent=percent)
    rows = _rows(docs, id_col, text_col)
    wide, wide_path = written_at(rows.mapInArrow(
        _signatures(least, size, bands, width),
        "doc_id long, text_key long, paragraph long, start long, end long, n_words long, id long, bands array<long>, n long, "
        + ", ".join(f"{c} long" for c in _PARITY)), "paragraphs")

    def verify(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        bitmap = docs.sparkSession.sparkContext.broadcast(bitmap_of(ids.select(F.col("id").alias("place"))))
        sets, path = written_at(rows.select("__text").mapInArrow(_sets(least, size, bitmap), "id long, set array<long>").dropDuplicates(["id"]), "paragraph-sets")
        both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("s")).hint("merge"), "a").join(
            sets.select(F.col("id").alias("b"), F.col("set").alias("t")).hint("merge"), "b")
        both = both.select("a", "b", (F.size("s") + F.size("t")).cast("long").alias("n"), F.size(F.array_intersect("s", "t")).cast("long").alias("shared"))
        links = checkpointed(both.filter(f"100 * shared >= {percent} * (n - shared)").select("a", "b").distinct())
        removed(docs.sparkSession, path)
        bitmap.destroy()
        return links

    def fits(x: str, y: str) -> str:
        # sizes; and parities: each shingle that only one set has turns one bit, so no pair differs in more bits than shingles
        differ = " + ".join(f"bit_count({x}.{c} ^ {y}.{c})" for c in _PARITY)
        return (f"100 * least({x}.n, {y}.n) >= {percent} * greatest({x}.n, {y}.n) "
                f"and {100 + percent} * ({differ}) <= {100 - percent} * ({x}.n + {y}.n)")

    # one row for each different line, not for each place of it
    lines, lines_path = written_at(wide.select("id", "bands", "n", *_PARITY).dropDuplicates(["id"]), "lines")
    # places need no bands, which are most of the table
    paras = written(wide.drop("bands", "n", *_PARITY), "places")
    removed(docs.sparkSession, wide_path)
    released(docs.sparkSession)
    entries = lines.select(F.explode("bands").alias("bucket"), "id")
    components, _ = linked(entries, verify, fits, lines.drop("bands"), middles=4)
    removed(docs.sparkSession, lines_path)
    placed = paras.join(components, "id", "left").withColumn("class", F.coalesce("component", "id"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "paragraph"))
    classes = placed.groupBy("class").agg(F.count("*").alias("class_size"), first.alias("first")).filter("class_size > 1")
    out = placed.join(classes, "class").select(
        "doc_id", "text_key", "paragraph", "start", "end", "n_words", "class_size", F.col("first.doc_id").alias("keep_doc_id"),
        F.col("first.paragraph").alias("keep_paragraph"), F.lit("paragraph").alias("unit"))
    out = written(out, "paragraph-classes")
    out = out.unionByName(_passages(rows, out, WINDOW, SPREAD))
    return out.withColumn("removed", F.expr(_REMOVED))


@F.udf(T.StringType(), useArrow=True)
def _left(text: str, gone: list[int], cuts: list[tuple[int, int]]) -> str:
    """``text`` without the lines ``gone`` and the code points in ``cuts``; ends of lines that stay are kept."""
    out, at = [], 0
    for number, line in enumerate(text.split("\n")):
        if number not in gone:
            kept, done = [], 0
            for start, end in sorted((c[0] - at, c[1] - at) for c in cuts):
                kept.append(line[done:max(start, done)])
                done = max(done, end)
            out.append("".join([*kept, line[done:]]))
        at += len(line) + 1
    return "\n".join(out)


def cleaned(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the paragraphs and the spans of passages that ``found`` (of ``repeated``) removes; other texts stay as they were."""
    passage = F.col("unit") == "passage"
    gone = found.filter("removed").groupBy("doc_id", "text_key").agg(
        F.collect_set(F.when(~passage, F.col("paragraph"))).alias("__gone"), F.collect_set(F.when(passage, F.struct("start", "end"))).alias("__cuts"))
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "__gone", "__cuts")
    keyed = docs.withColumn("__own", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    both = keyed.join(gone, (keyed["__own"] == gone["__key"]) & keyed[id_col].eqNullSafe(gone["__id"]), "left")
    left = _left(F.col(text_col), F.col("__gone"), F.col("__cuts"))
    some = both.filter("__key is not null").withColumn(text_col, left)
    return some.unionByName(both.filter("__key is null")).select(*docs.columns)

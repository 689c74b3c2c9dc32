"""Language ID: nearest of several clustered centroids per language by the cosine of TF-IDF n-gram vectors.

A text's vector holds its byte trigrams, lower-cased, with ASCII other than letters as spaces, hashed
to FEATURES places: log(1 + count) times the inverse document frequency, of length 1. Document
frequencies are counted over all rows that may be learned from. Centroids are fitted on at most
SAMPLE rows a language (the rows that come first by a hash of doc_id), by spherical k-means inside one
task a language. A text whose distance (1 - cosine) to the nearest centroid is over the limit, or
that has no letter, is rejected.

Cosines grow with the number of different trigrams, in learned languages much more than in others, so
each centroid has a limit for every size (by half octaves of different trigrams): SLACK of a low
quantile of the cosines of its own training texts and of pieces of all lengths cut from them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skytable.llm.words import steps

BITS = 18
FEATURES = 1 << BITS
CENTROIDS = 4
SAMPLE = 400
ROUNDS = 8
# A text is taken for none of the learned languages under SLACK of this quantile of the training cosines of its size.
LOW, SLACK = 0.02, 0.25
SIZES = 2 * BITS
_PIECES = 200
UNKNOWN = "und"
_DOCS = 512


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text has this remainder; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


@dataclass
class Grams:
    """Different places of each text's hashed trigrams, text by text: text, place and weight; ``ends`` cuts them by text."""

    text: np.ndarray
    place: np.ndarray
    weight: np.ndarray
    ends: np.ndarray

    def sizes(self) -> np.ndarray:
        """Half octaves of the number of different places of each text."""
        return np.minimum((2 * np.log2(np.maximum(np.diff(self.ends), 1))).astype(np.int64), SIZES - 1)

    def scaled(self, idf: np.ndarray) -> Grams:
        """Weights times ``idf``, of length 1 a text."""
        v = self.weight * idf[self.place]
        norm = np.sqrt(np.bincount(self.text, weights=v * v, minlength=len(self.ends) - 1))
        return Grams(self.text, self.place, v / np.maximum(norm, 1e-12)[self.text], self.ends)

    def cosines(self, table: np.ndarray) -> np.ndarray:
        """Inner products with the columns of ``table`` (a row for each place)."""
        n = len(self.ends) - 1
        return np.stack([np.bincount(self.text, weights=self.weight * column[self.place], minlength=n) for column in table.T], axis=1)


def _trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Text and hashed place of every trigram of lower-cased texts, in order."""
    table = np.arange(256, dtype=np.uint32)
    table[:128] = 32
    table[97:123] = np.arange(97, 123)
    joined = table[np.frombuffer(b" " + b"  ".join(texts) + b"  ", dtype=np.uint8)]
    gram = (joined[:-2] << np.uint32(16)) | (joined[1:-1] << np.uint32(8)) | joined[2:]
    place = ((gram * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)
    lengths = np.fromiter((len(t) + 2 for t in texts), dtype=np.int64, count=len(texts))
    of = np.repeat(np.arange(len(texts)), lengths)
    # trigrams that only see spaces say nothing, and neither do those that reach into the next text
    live = (joined[1:-1] != 32) | ((joined[:-2] != 32) & (joined[2:] != 32))
    n = min(len(of), len(place))
    return of[:n][live[:n]], place[:n][live[:n]]


def _grams(of: np.ndarray, place: np.ndarray, n: int) -> Grams:
    """log(1 + count) of the different places of each of ``n`` texts."""
    both, count = np.unique((of << BITS) | place, return_counts=True)
    text = both >> BITS
    return Grams(text, both & (FEATURES - 1), np.log1p(count), np.searchsorted(text, np.arange(n + 1)))


def _counts(texts: list[bytes]) -> Grams:
    return _grams(*_trigrams(texts), len(texts))


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for part, texts in steps(batch, "__text"):
        for i in range(0, len(texts), _DOCS):
            yield part.slice(i, _DOCS), texts[i:i + _DOCS]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(FEATURES, dtype=np.int64), 0
    for batch in batches:
        for _, texts in _pieces(batch):
            total += np.bincount(_counts(texts).place, minlength=FEATURES)
            n += len(texts)
    # the last place holds the number of texts
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"place": pa.array(np.append(seen, FEATURES), pa.int32()), "n": pa.array(np.append(total[seen], n), pa.int64())})


def _limits(cosines: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each centroid (column) and size, SLACK of a low quantile of the cosines that are nearest to it, between half and all of that of the language.

    Sizes without any lie between their neighbours.
    """
    own, best = np.argmax(cosines, axis=1), cosines.max(axis=1)

    def low(some: np.ndarray) -> np.ndarray:
        at = np.unique(sizes[some])
        return np.interp(np.arange(SIZES), at, [np.quantile(best[some & (sizes == s)], LOW) for s in at])

    every = low(own >= 0)
    # a centroid of few or odd texts would ask for too much or too little
    return SLACK * np.stack([np.clip(low(own == j), every / 2, every) if (own == j).any() else every for j in range(cosines.shape[1])])


def _fit(idf: np.ndarray, k: int, rounds: int) -> Callable:
    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("__key", "ascending"), ("__text", "ascending")])
        of, place, n = [], [], 0
        for b in table.combine_chunks().to_batches():
            for _, texts in _pieces(b):
                text, where = _trigrams(texts)
                of.append(text + n)
                place.append(where)
                n += len(texts)
        of, place = np.concatenate(of), np.concatenate(place)
        whole = _grams(of, place, n).scaled(idf)
        # columns are the places that this language has
        known, column = np.unique(whole.place, return_inverse=True)
        x = np.zeros((n, len(known)), dtype=np.float32)
        x[whole.text, column] = whole.weight
        # farthest-first seeds, then spherical k-means
        seeds = [int(np.argmax(x @ x.mean(axis=0)))]
        near = x @ x[seeds[0]]
        while len(seeds) < min(k, len(x)):
            seeds.append(int(np.argmin(near)))
            near = np.maximum(near, x @ x[seeds[-1]])
        c = x[seeds]
        for _ in range(rounds):
            own = np.argmax(x @ c.T, axis=1)
            sums = np.stack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
            c = sums / np.maximum(np.linalg.norm(sums, axis=1), 1e-12)[:, None]
        # pieces of all lengths, cut from the texts in a row
        cosines, sizes = [x @ c.T], [whole.sizes()]
        centroid = np.zeros((FEATURES, len(c)), dtype=np.float32)
        centroid[known] = c.T
        length = 4
        while length <= len(place):
            many = min(_PIECES, len(place) // length)
            start = np.linspace(0, len(place) - length, many).astype(np.int64)
            at = (start[:, None] + np.arange(length)).ravel()
            piece = _grams(np.repeat(np.arange(many), length), place[at], many).scaled(idf)
            cosines.append(piece.cosines(centroid))
            sizes.append(piece.sizes())
            length *= 2
        limits = _limits(np.concatenate(cosines), np.concatenate(sizes))
        return pa.table({"lang": [table.column("__lang")[0].as_py()] * len(c), "no": pa.array(range(len(c)), pa.int32()),
                         "places": pa.array([known.tolist()] * len(c), pa.list_(pa.int32())), "centroid": pa.array(c.tolist(), pa.list_(pa.float32())),
                         "limits": pa.array(limits.tolist(), pa.list_(pa.float64()))})
    return fit


@dataclass
class Model:
    """Inverse document frequencies, centroids (columns), the language of each and its least cosine by size; no columns if nothing was learned."""

    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    limits: np.ndarray


def fitted(train: DataFrame, *, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """Learn from rows with doc_id, text and lang; null languages and texts without a letter are left out.

    The driver gets at most FEATURES counts and ``centroids`` vectors a language.
    """
    rows = train.filter(F.col("lang").isNotNull() & has_letter(F.col("text"))).select(
        F.col("lang").alias("__lang"), F.lower("text").alias("__text"), F.xxhash64(F.col("doc_id").cast("string")).alias("__key"))
    counts = dict(rows.select("__text").mapInArrow(_frequencies, "place int, n long").groupBy("place").agg(F.sum("n")).collect())
    n = counts.get(FEATURES, 0)
    idf = np.array([np.log((1 + n) / (1 + counts.get(i, 0))) + 1 for i in range(FEATURES)])
    first = Window.partitionBy("__lang").orderBy("__key")
    keys = rows.select("__lang", "__key").distinct().withColumn("__n", F.row_number().over(first)).filter(F.col("__n") <= sample).drop("__n")
    # at most ``sample`` keys a language
    chosen = rows.join(F.broadcast(keys), ["__lang", "__key"], "left_semi")
    fit = chosen.groupBy("__lang").applyInArrow(_fit(idf, centroids, ROUNDS), "lang string, no int, places array<int>, centroid array<float>, limits array<double>")
    got = sorted(fit.collect(), key=lambda r: (r["lang"], r["no"]))
    table = np.zeros((FEATURES, len(got)), dtype=np.float32)
    for j, r in enumerate(got):
        table[r["places"], j] = r["centroid"]
    return Model(idf, table, [r["lang"] for r in got], np.array([r["limits"] for r in got]).reshape(-1, SIZES))


def identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``row`` (all columns of ``docs``), lang_pred, score (cosine, 0 to 1), rejected.

    Null texts and texts without a letter are ``und`` with score 0 and rejected. Without a model all
    others are ``und`` with score 0, and not rejected.
    """
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), has_letter(docs[text_col]).alias("__letter"),
                       F.coalesce(F.lower(docs[text_col]), F.lit("")).alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, UNKNOWN], dtype=object)
        for batch in batches:
            for part, texts in _pieces(batch):
                letter = np.asarray(part.column("__letter").to_pylist(), dtype=bool)
                if m.languages:
                    grams = _counts(texts).scaled(m.idf)
                    cosines = grams.cosines(m.centroids)
                    best = np.argmax(cosines, axis=1)
                    score = np.clip(cosines[np.arange(len(texts)), best], 0, 1)
                    out = ~letter | (score < m.limits[best, grams.sizes()])
                else:
                    best, score, out = np.full(len(texts), len(m.languages)), np.zeros(len(texts)), ~letter
                best, score = np.where(letter, best, len(m.languages)), np.where(letter, score, 0.0)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(names[best], pa.string()), pa.array(score), pa.array(out)],
                                                 ["row", "lang_pred", "score", "rejected"])
    schema = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                           T.StructField("rejected", T.BooleanType())])
    return rows.mapInArrow(predict, schema)


def learned(docs: DataFrame) -> Model:
    """The model of the rows that may be learned from: crc32(doc_id) modulo 4 is not 2."""
    return fitted(docs.filter(~held_out(F.col("doc_id"), 4, 2)).select("doc_id", "text", "lang"))


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row."""
    slim = docs.select("doc_id", "text")
    return identified(slim, learned(docs)).select(
        F.col("row.doc_id").alias("doc_id"), held_out(F.col("row.doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "rejected")


def kept(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their own columns."""
    return identified(docs, learned(docs)).filter("not rejected").select("row.*")

"""Toxicity: a linear-chain conditional random field tags toxic words; its marginals make a document's score.

Words are runs of letters (A-Z as a-z). Token labels for training come from the document labels and
counts over all labelled training rows: within toxic documents, a word counts as toxic if the word
itself, or its first letters, are far more frequent in toxic than in other documents, and either
common among them or beyond chance by the log-likelihood ratio, which asks for no share of all
documents: words of a small language, or one of many, count too. The field has
two states and features of the word, its first and last letters and both neighbours, hashed into
weight tables. It is fitted on at most SAMPLE documents of each class, of at most SAMPLE_CHARS code
points, in one task. Forward and backward messages of a two-state chain are ratios, so all documents
of a batch step along together. A document's score is a logistic function of the sum, the largest
and the second largest of its words' marginals.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytable.llm.language import held_out
from skytable.llm.words import Words, steps

SAMPLE = 300
SAMPLE_CHARS = 16_384
BITS = 18
PREFIX, SUFFIX = 4, 4
ROUNDS = 40
# A word of a toxic document is labelled toxic from this log ratio of document shares, and share or
# log-likelihood ratio (chi-squared of one degree: about one chance in ten thousand), on.
LEAST_RATIO, LEAST_SHARE, LEAST_DOCS, LEAST_LIKELIHOOD = 2.5, 0.03, 4, 15.0
SPAN = 0.5
_MANY = 5
_DOCS = 2048


def _features(w: Words) -> np.ndarray:
    """Places in the weight table of each word's features: word, first letters, last letters, word before, word after."""
    shift = np.uint64(64 - BITS)
    word = (w.hashes >> shift).astype(np.int64)
    first = (w.parts(w.start, np.minimum(w.start + PREFIX, w.end)) >> shift).astype(np.int64)
    last = (w.parts(np.maximum(w.end - SUFFIX, w.start), w.end) >> shift).astype(np.int64)
    before, after = np.roll(word, 1), np.roll(word, -1)
    some = w.first < w.last
    before[w.first[some]] = 0
    after[w.last[some] - 1] = 0
    return np.stack([word, first, last, before, after]) + (np.arange(_MANY) << BITS)[:, None]


class Chains:
    """Documents' words in time-major order: step t holds the t-th words of the documents that are long enough."""

    def __init__(self, first: np.ndarray, last: np.ndarray):
        n = last - first
        order = np.argsort(-n, kind="stable")
        lengths = n[order]
        longest = int(lengths[0]) if len(lengths) else 0
        self.active = np.searchsorted(-lengths, -np.arange(longest), side="left")
        self.starts, self.lengths = first[order], lengths

    def marginals(self, gain: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marginal of state 1 for each word, given exp(emission) and the 2 x 2 weights; and the forward and backward ratios."""
        forward, backward = np.empty_like(gain), np.empty_like(gain)
        t00, t01, t10, t11 = trans.ravel()
        u = np.ones(0)
        for t, k in enumerate(self.active):
            at = self.starts[:k] + t
            u = gain[at] if t == 0 else gain[at] * (t01 + t11 * u[:k]) / (t00 + t10 * u[:k])
            u = np.clip(u, 1e-30, 1e30)
            forward[at] = u
        v = np.ones(0)
        for t in range(len(self.active) - 1, -1, -1):
            k = self.active[t]
            at = self.starts[:k] + t
            grown = np.ones(k)
            if len(v):
                x = gain[at[:len(v)] + 1] * v
                grown[:len(v)] = np.clip((t10 + t11 * x) / (t00 + t01 * x), 1e-30, 1e30)
            v = grown
            backward[at] = v
        odds = forward * backward
        return odds / (1 + odds), forward, backward


@dataclass
class Model:
    """Weights of the field and of the document score; ``labelled`` is false if no toxic document was seen."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(_MANY << BITS, dtype=np.float32))
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    score: np.ndarray = field(default_factory=lambda: np.array([-3.0, 0.0, 0.0, 0.0]))
    labelled: bool = False

    def marginals(self, w: Words) -> np.ndarray:
        gain = np.exp(np.clip(self.weights[_features(w)].sum(axis=0, dtype=np.float64), -30, 30))
        return Chains(w.first, w.last).marginals(gain, np.exp(self.trans))[0]


def _summaries(p: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Per document: 1, log(1 + sum), largest and second largest marginal."""
    out = np.zeros((len(first), 4))
    out[:, 0] = 1
    some = np.flatnonzero(first < last)
    if len(some):
        # words lie document by document, so the first words cut the row of marginals
        cut = first[some]
        out[some, 1] = np.log1p(np.add.reduceat(p, cut))
        out[some, 2] = np.maximum.reduceat(p, cut)
        of = np.repeat(np.arange(len(some)), np.diff(np.append(cut, len(p))))
        top = np.flatnonzero(p == out[some, 2][of])
        rest = p.copy()
        rest[top[np.unique(of[top], return_index=True)[1]]] = 0
        out[some, 3] = np.maximum.reduceat(rest, cut)
    return out


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that have a word, or first letters, in each place of the table."""
    total = np.zeros((2, 2 << BITS), dtype=np.int32)
    n = np.zeros(2, dtype=np.int64)
    for batch in batches:
        for part, texts in steps(batch, "__text"):
            toxic = np.asarray(part.column("__toxic").to_pylist(), dtype=np.int64)
            w = Words(texts, letters=True)
            of = np.repeat(np.arange(len(texts)), w.counts())
            for rows in _features(w)[:2]:
                each = np.unique((of << (BITS + 1)) | rows)
                for c in (0, 1):
                    total[c] += np.bincount((each & ((2 << BITS) - 1))[toxic[each >> (BITS + 1)] == c], minlength=2 << BITS).astype(np.int32)
            n += np.bincount(toxic, minlength=2)
    parts = total.reshape(2, 128, -1)
    yield pa.RecordBatch.from_pydict({
        "part": pa.array(range(128), pa.int32()), **{f"c{c}": pa.array(list(parts[c]), pa.list_(pa.int32())) for c in (0, 1)},
        **{f"n{c}": pa.array([int(n[c])] * 128, pa.int64()) for c in (0, 1)}})


def _likelihood(c: list[np.ndarray], n: list[int]) -> np.ndarray:
    """Log-likelihood ratio of counts ``c`` among ``n`` documents of two classes against one share for both."""
    share = (c[0] + c[1]) / max(n[0] + n[1], 1)
    out = np.zeros(len(share))
    for seen, of in zip(c, n, strict=True):
        for part, expected in ((seen, of * share), (of - seen, of * (1 - share))):
            out += np.where(part > 0, part * np.log(np.maximum(part, 1) / np.maximum(expected, 1e-12)), 0)
    return 2 * out


def _telling(table: pa.Table) -> pa.Table:
    """Places of one part of the table that tell toxic documents from others."""
    c = [np.stack([np.asarray(x.as_py(), dtype=np.int64) for x in table.column(f"c{k}")]).sum(axis=0) for k in (0, 1)]
    n = [sum(table.column(f"n{k}").to_pylist()) for k in (0, 1)]
    part = table.column("part")[0].as_py()
    ratio = np.log((c[1] + 0.5) / (n[1] + 1)) - np.log((c[0] + 0.5) / (n[0] + 1))
    frequent = (c[1] >= LEAST_SHARE * n[1]) | (_likelihood(c, n) >= LEAST_LIKELIHOOD)
    found = np.flatnonzero((ratio >= LEAST_RATIO) & (c[1] >= LEAST_DOCS) & frequent)
    return pa.table({"place": pa.array(found + part * len(c[0]), pa.int32())})


def _fit(places: np.ndarray, rounds: int):
    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("__key", "ascending"), ("__text", "ascending")])
        texts = [t.encode() for t in table.column("__text").to_pylist()]
        toxic = np.asarray(table.column("__toxic").to_pylist(), dtype=np.float64)
        w, m = Words(texts, letters=True), Model(labelled=bool(toxic.any()))
        f, of = _features(w), np.repeat(np.arange(len(texts)), w.counts())
        telling = np.zeros(2 << BITS, dtype=bool)
        telling[places] = True
        y = ((telling[f[0]] | telling[f[1]]) & (toxic[of] > 0)).astype(np.float64)
        chains, weights, trans = Chains(w.first, w.last), np.zeros(_MANY << BITS), np.zeros((2, 2))
        after = np.flatnonzero(of[1:] == of[:-1])
        seen = np.array([[np.sum((y[after] == i) & (y[after + 1] == j)) for j in (0, 1)] for i in (0, 1)], dtype=np.float64)
        memory, memory_t = np.full(len(weights), 1e-6), np.full((2, 2), 1e-6)
        for _ in range(rounds):
            gain, t = np.exp(np.clip(weights[f].sum(axis=0), -30, 30)), np.exp(trans)
            p, u, v = chains.marginals(gain, t)
            g = sum(np.bincount(row, weights=y - p, minlength=len(weights)) for row in f) - 1e-2 * weights
            memory += g * g
            weights += 0.5 * g / np.sqrt(memory)
            # pair marginals from the messages around each pair
            a, x = u[after], gain[after + 1] * v[after + 1]
            pair = np.stack([np.full(len(a), t[0, 0]), t[0, 1] * x, t[1, 0] * a, t[1, 1] * a * x])
            g = seen - (pair / pair.sum(axis=0)).sum(axis=1).reshape(2, 2) - 1e-2 * trans
            memory_t += g * g
            trans += 0.1 * g / np.sqrt(memory_t)
        m.weights, m.trans = weights.astype(np.float32), trans
        s = _summaries(m.marginals(w), w.first, w.last)
        b = np.zeros(4)
        for _ in range(50):  # Newton steps of a logistic regression with a small ridge
            q = 1 / (1 + np.exp(-s @ b))
            h = (s * (q * (1 - q))[:, None]).T @ s + 0.1 * np.eye(4)
            b += np.linalg.solve(h, s.T @ (toxic - q) - 0.1 * b)
        m.score = b
        return pa.table({"model": pa.array([pickle.dumps(m)], pa.binary())})
    return fit


def fitted(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> Model:
    """Learn from the rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic: 0 or 1) covers.

    Counts cover all of them; the field is fitted on the ``sample`` documents of each class that
    come first by a hash of doc_id, among those of at most SAMPLE_CHARS code points.
    """
    labels = labels.filter("toxic in (0, 1)").select("doc_id", F.col("toxic").cast("long").alias("__toxic"))
    rows = docs.filter("text is not null").select("doc_id", F.col("text").alias("__text"))
    # labels grow with the documents, so the join is a merge at every size
    parts = rows.join(labels.hint("merge"), "doc_id").select("__text", "__toxic").mapInArrow(
        _presence, "part int, c0 array<int>, c1 array<int>, n0 long, n1 long")
    places = [r[0] for r in parts.groupBy("part").applyInArrow(_telling, "place int").collect()]
    key = F.xxhash64(F.col("doc_id").cast("string"))
    slim = rows.filter(F.length("__text") <= SAMPLE_CHARS).select("doc_id").join(labels, "doc_id").distinct().withColumn("__key", key)
    keys = slim.filter("__toxic = 0").orderBy("__key").limit(sample).unionByName(slim.filter("__toxic = 1").orderBy("__key").limit(sample))
    chosen = rows.filter(F.length("__text") <= SAMPLE_CHARS).join(F.broadcast(keys), "doc_id")
    got = chosen.groupBy(F.lit(1).alias("__one")).applyInArrow(_fit(np.array(sorted(places), dtype=np.int64), ROUNDS), "model binary").collect()
    return pickle.loads(got[0][0]) if got else Model()  # noqa: S301 - written by our own task


def _spans(w: Words, p: np.ndarray, n: int) -> list[list[dict]]:
    """Per text: runs of toxic words as code point ranges [start, end) with the largest marginal."""
    hit = np.flatnonzero(p >= SPAN)
    out: list[list[dict]] = [[] for _ in range(n)]
    if not len(hit):
        return out
    points = np.cumsum((w.joined & 0xC0) != 0x80)
    place = lambda at, of: int(points[at] - points[w.text_start[of]])
    texts = np.searchsorted(w.last, hit, side="right")
    before = -2
    for t, of in zip(hit.tolist(), texts.tolist(), strict=True):
        if t == before + 1 and out[of]:
            out[of][-1]["end"], out[of][-1]["score"] = place(w.end[t] - 1, of) + 1, max(out[of][-1]["score"], float(p[t]))
        else:
            out[of].append({"start": place(w.start[t], of), "end": place(w.end[t] - 1, of) + 1, "score": float(p[t])})
        before = t
    return out


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and spans (array of start, end, score; code points of the text) of every row.

    Null texts and texts without letters have the score of a text without toxic words and no spans.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part, texts in steps(batch, "__text"):
                for i in range(0, len(texts), _DOCS):
                    some = texts[i:i + _DOCS]
                    w = Words(some, letters=True)
                    p = m.marginals(w) if m.labelled else np.zeros(len(w.start))
                    s = 1 / (1 + np.exp(-_summaries(p, w.first, w.last) @ m.score))
                    yield pa.RecordBatch.from_arrays([part.slice(i, len(some)).column("doc_id"), pa.array(s), pa.array(_spans(w, p, len(some)), spans)],
                                                     ["doc_id", "score", "spans"])
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(score, f"doc_id {kind}, score double, spans array<struct<start:int,end:int,score:double>>")


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, spans; learned from rows whose crc32(doc_id) modulo 5 is not 0."""
    train = docs.select("doc_id", "text").filter(~held_out(F.col("doc_id"), 5, 0))
    return scored(docs, fitted(train, labels)).select(
        "doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")

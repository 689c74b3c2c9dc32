"""Language-model scores against a plain bit-by-bit coder, and their edge cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from skytable.llm import context_mixing as cm

SCHEMA = "doc_id long, text string, n long, slice string, mark int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 7) for i, t in rows], SCHEMA)


def lowered(text):
    return (text or "").encode().translate(cm._LOWER)


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def plain_scores(rows, weights):
    """Counts by dictionaries, votes, mixing and updates one bit at a time."""
    seen, words, docs_ = Counter(), Counter(), 0
    for i, text in rows:
        if not held(i):
            raw = b"\0" * 4 + lowered(text) + b"\xff"
            for at in range(4, len(raw)):
                for k in cm.ORDERS:
                    for b in range(9):
                        seen[k, raw[at - k:at], b, raw[at] >> (8 - b)] += 1
            words.update(lowered(text).split())
            docs_ += 1
    total, distinct, out = sum(words.values()) + docs_, len(words) + (docs_ > 0), {}
    for i, text in rows:
        raw, mine, nats = b"\0" * 4 + lowered(text) + b"\xff", np.array(weights, dtype=float), 0.0
        slope, many = np.zeros_like(mine), Counter()
        for n, at in enumerate(range(4, len(raw))):
            levels = [sum(seen[k, raw[at - k:at], 0, 0] >= x for x in cm.LEVELS) for k in cm.ORDERS[-2:]]
            gate = levels[0] * (len(cm.LEVELS) + 1) + levels[1]
            for b in range(8):
                counts = [(seen[k, raw[at - k:at], b + 1, raw[at] >> (7 - b)], seen[k, raw[at - k:at], b, raw[at] >> (8 - b)]) for k in cm.ORDERS]
                v = np.array([math.log((x + cm.SPARE) / (y - x + cm.SPARE)) for x, y in counts])
                p = 1 / (1 + math.exp(-float(v @ mine[gate])))
                nats -= math.log(p)
                slope[gate] += (1 - p) * v
            many[gate] += 1
            if (n + 1) % cm.SEGMENT == 0:
                for g, m in many.items():
                    mine[g] += cm.RATE * slope[g] / (m + cm.CALM)
                slope[:], many = 0, Counter()
        w = lowered(text).split()
        base = sum(math.log10((c + 1) / (total + distinct + 1)) for c in [*(words[x] for x in w), docs_])
        out[i] = (held(i), len(w) + 1, sum(words[x] > 0 for x in w) + (docs_ > 0), total, base, -nats / math.log(10))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_scores_equal_a_plain_coder(spark, words, monkeypatch, small):
    if small:  # many slices and chunks
        monkeypatch.setattr(cm, "SLICE_BYTES", 2000)
        monkeypatch.setattr(cm, "CHUNK_BYTES", 300)
        monkeypatch.setattr(cm, "TABLE_BITS", 5)
        monkeypatch.setattr(cm, "LANES", 3)
    r = random.Random(4)
    rows = [(i, words(r.choice([0, 1, 5, 40, 150]), i, 60).replace("w1", "W1é")) for i in range(60)] + [(61, None), (62, ""), (63, "\x00\x00 x\xff"), (None, "no id")]
    weights = np.linspace(0.1, 0.6, cm.GATES * len(cm.ORDERS)).reshape(cm.GATES, -1)
    got = {x.doc_id: tuple(x)[1:] for x in cm.scores(docs(spark, rows), weights).collect()}
    want = plain_scores(rows, weights)
    assert got.keys() == want.keys() and any(x[0] for x in want.values())
    for i, x in want.items():
        assert got[i][:4] == x[:4]
        assert got[i][4] == pytest.approx(x[4], rel=1e-9) and got[i][5] == pytest.approx(x[5], rel=2e-4)


def test_each_step_is_a_probability(spark):
    # the bytes that may follow a context have probabilities that add up to one
    chunk = cm.Chunk([b"the cat", b"the car", b"the dog", b"then"])
    rows = []
    for k in cm.ORDERS:
        short, n = np.unique(chunk.codes & np.uint64((1 << 8 * (k + 1)) - 1), return_counts=True)
        keys, b = cm.context(short, k)
        for key in np.unique(keys):
            rows.append((k, int(key), b[keys == key].tolist(), n[keys == key].tolist()))
    import pyarrow as pa
    sums = cm.Sums([pa.RecordBatch.from_pylist([dict(zip(("order", "context", "bytes", "counts"), x, strict=True)) for x in rows] + [{"order": 0, "context": 1, "bytes": [0], "counts": [1]}],
                    schema=pa.schema([("order", pa.int32()), ("context", pa.int64()), ("bytes", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))]))])
    codes = (np.uint64(int.from_bytes(b"the ", "big")) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
    vote, gate = cm.votes(codes, sums)
    cost, _ = cm._bits(np.full((cm.GATES, len(cm.ORDERS)), 0.4, np.float32), gate, vote, np.arange(256))
    p = np.exp(-cost)
    assert p.sum() == pytest.approx(1, abs=1e-4) and set(np.argsort(-p)[:2].tolist()) == {ord("c"), ord("d")}


def test_fitted_weights_beat_the_first_ones_on_unseen_texts(spark, words):
    rows = [(i, words(120, i, 40)) for i in range(150)]
    first = cm.scores(docs(spark, rows), np.full((cm.GATES, len(cm.ORDERS)), cm.FIRST)).filter("held_out").agg({"score": "sum"}).first()[0]
    fitted = cm.scores(docs(spark, rows)).filter("held_out").agg({"score": "sum"}).first()[0]
    text_bits = sum(len(t) + 1 for i, t in rows if held(i)) * 8 * math.log10(2)
    assert fitted > first > -text_bits


def plain_fit(texts):
    """Weights of least cost over all bytes of all texts, each without its own occurrence, by counts in dicts."""
    seen, votes, gates = Counter(), [], []
    coded = [b"\0" * 4 + lowered(t) + b"\xff" for t in texts]
    ways = [[(k, t[i - k:i], b, t[i] >> (8 - b)) for k in cm.ORDERS for b in range(9)] for t in coded for i in range(4, len(t))]
    for w in ways:
        seen.update(w)
    for w in ways:
        n = np.array([seen[x] - 1 for x in w], dtype=float).reshape(len(cm.ORDERS), 9)
        votes.append(np.log((n[:, 1:] + cm.SPARE) / (n[:, :-1] - n[:, 1:] + cm.SPARE)).T)
        gates.append([np.searchsorted(cm.LEVELS, n[k, 0], side="right") for k in (-2, -1)])
    votes, gates = np.array(votes), np.array(gates) @ [len(cm.LEVELS) + 1, 1]
    out = np.full((cm.GATES, len(cm.ORDERS)), cm.FIRST)
    for g in set(gates.tolist()):
        v, w = votes[gates == g].reshape(-1, len(cm.ORDERS)), out[g].copy()
        for _ in range(40):
            p = 1 / (1 + np.exp(v @ w))
            w += np.linalg.solve((v * (p * (1 - p))[:, None]).T @ v + cm.CALM * np.eye(len(w)), v.T @ p - cm.CALM * (w - cm.FIRST))
        out[g] = w
    return out


def test_weights_are_fitted_on_all_training_texts(spark, words):
    # texts of two kinds: a fit on some of them, or on each but once, has other weights
    rows = [(i, words(6, i, 30) if i % 3 else "ab" * (i % 17)) for i in range(420)] + [(None, "no id")] * 3
    want = {x.doc_id: x.score for x in cm.scores(docs(spark, rows), plain_fit([t for i, t in rows if not held(i)])).collect()}
    got = {x.doc_id: x.score for x in cm.scores(docs(spark, rows)).collect()}
    assert got == pytest.approx(want, rel=1e-3)


def test_empty_table_no_training_rows_and_repeated_rows(spark):
    assert cm.scores(docs(spark, [])).count() == 0
    only = next(i for i in range(100) if held(i))
    got = cm.scores(docs(spark, [(only, "ab"), (only, "ab")])).collect()
    assert len(got) == 2 and all(x.held_out and x.n_known == 0 and x.train_tokens == 0 and x.base_score == 0 for x in got)
    assert all(x.score == pytest.approx(-3 * 8 * math.log10(2), rel=1e-4) for x in got)


def test_a_very_long_text(spark, words):
    text = words(60_000, 3, 50)
    got = {x.doc_id: x for x in cm.scores(docs(spark, [(1, text), (2, "w1 w2")])).collect()}
    assert got[1].n_tokens == 60_001 and 0 > got[1].score > -len(re.sub("x", "", text)) * 8 * math.log10(2)

"""PII: fixed base patterns, and a semi-Markov conditional random field that adds whole spans.

Base spans are found exactly and always stay. The field works on islands: runs of words with a digit
or an at sign, with the plain words in between left out (they can hold no candidate, so they are
outside in every labelling and drop out of the sums). Its segments are up to MOST_PIECES pieces and
MOST_CHARS code points; a segment is scored as a whole by features of its shape, its digit count,
its separators and the word before it. Dynamic programming over segment ends sums over all labellings
for training and takes the best one, boundaries and kinds together, for tagging.

It is trained on the islands of at most SAMPLE documents that have base spans, labelled by them, and
on variants of those spans that the base patterns do not cover (a phone number without its country
code or in other separators, a card number in dots), so
that it learns what such spans look like. A found span is added if it does not touch a base span, its
marginal is at least LEAST_SURE, and its own checks (digit counts, octets, Luhn) do not speak against it.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
MOST_PIECES = 16
MOST_CHARS = 64
# Islands longer than this many pieces are cut between words; base patterns always see the whole text.
ISLAND_PIECES = 400
SAMPLE = 400
BITS = 14
ROUNDS = 30
LEAST_SURE = 0.9

#: Fixed patterns of the base spans; possessive and bounded so that no text takes more than linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOT = re.compile(r"[0-9@]")
_PIECE = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]|[^\S\n]+")


def luhn(digits: str) -> bool:
    """Whether the check digit is right."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        # the next local part cannot reach over this sign
        done = max(done, at + 1)
        at = text.find("@", done)


def _valid(kind: str, span: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in span.split("."))
    digits = _digits(span)
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as in KINDS, then by start."""
    out = [("email", a, b) for a, b in _emails(text)]
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if _valid(kind, m.group())]
    return out


@dataclass
class Island:
    """Pieces of a run of hot words: their places in the text, and the word before the run."""

    text: str
    pieces: list[tuple[int, int]]
    before: str


def islands(text: str) -> Iterator[Island]:
    """Runs of words with a digit or an at sign, one or more spaces or tabs apart; a sign between them belongs to the run."""
    done = 0
    while True:
        hot = _HOT.search(text, done)
        if not hot:
            return
        start = hot.start()
        while start > done and not text[start - 1].isspace() and hot.start() - start < MOST_CHARS:
            start -= 1
        end = hot.end()
        while True:  # to the end of the word, and on while the next word is hot or a lone sign before a hot one
            word = re.compile(r"\S*").match(text, end).end()
            more = re.compile(r"[^\S\n]{1,3}(?:[(@+.-]{1,2}[^\S\n])?(?=[^\s0-9@]{0,16}[0-9@])").match(text, word)
            end = word
            if not more or end - start > 16 * MOST_CHARS:
                break
            end = more.end()
        pieces = [m.span() for m in _PIECE.finditer(text, start, end)]
        before = re.search(r"(\w+)\W*\Z", text[max(0, start - 24):start])
        for i in range(0, len(pieces), ISLAND_PIECES):
            yield Island(text, pieces[i:i + ISLAND_PIECES], before[1].lower() if before and not i else "")
        done = max(end, hot.end())


def _bin(name: str) -> int:
    return zlib.crc32(name.encode()) & ((1 << BITS) - 1)


def features(island: Island, i: int, j: int) -> list[int]:
    """Places of the features of the segment of pieces i .. j - 1."""
    start, end = island.pieces[i][0], island.pieces[j - 1][1]
    span = island.text[start:end]
    digits = _digits(span)
    shape = re.sub(r"[0-9]+", "9", re.sub(r"[A-Za-z]+", "a", span))
    runs = "-".join(str(min(len(r), 9)) for r in re.findall(r"[0-9]+", span))
    previous = island.text[start - 1] if start else ""
    after = island.text[end:end + 1]
    names = ["bias", f"shape:{shape}", f"digits:{len(digits)}", f"runs:{runs}", f"at:{span.count('@')}", f"letters:{any(c.isalpha() for c in span)}",
             f"first:{span[0] if not span[0].isalnum() else shape[0]}", f"glued:{previous.isalnum()}{after.isalnum()}", f"edge:{previous.isspace() or not previous}{after.isspace() or not after}"]
    names.append(f"before:{island.before if i == 0 else ''}")
    if len(digits) >= 13 and digits == re.sub(r"[ .-]", "", span):
        names.append(f"luhn:{luhn(digits)}")
    if shape == "9.9.9.9":
        names.append(f"octets:{_valid('ip', span)}")
    return [_bin(n) for n in names]


def _candidate(island: Island, i: int, j: int) -> bool:
    a, b = island.pieces[i], island.pieces[j - 1]
    first, last, text = island.text[a[0]], island.text[b[1] - 1], island.text[a[0]:b[1]]
    return (len(text) <= MOST_CHARS and not first.isspace() and not last.isspace() and (first.isalnum() or first in "+(") and last.isalnum()
            and ("@" in text or sum(c.isdigit() for c in text) >= 4))


@dataclass
class Lattice:
    """Candidate segments of an island, by end: (start, features)."""

    n: int
    by_end: list[list[tuple[int, list[int]]]]

    @staticmethod
    def of(island: Island) -> Lattice:
        n = len(island.pieces)
        by_end: list[list[tuple[int, list[int]]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            for j in range(i + 1, min(n, i + MOST_PIECES) + 1):
                if _candidate(island, i, j):
                    by_end[j].append((i, features(island, i, j)))
        return Lattice(n, by_end)


@dataclass
class Model:
    """Weights by kind and feature; a piece outside of all spans scores 0."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros((len(KINDS), 1 << BITS)))
    fitted: bool = False

    def scores(self, lattice: Lattice) -> list[list[tuple[int, np.ndarray]]]:
        return [[(i, self.weights[:, f].sum(axis=1)) for i, f in row] for row in lattice.by_end]


def _sums(n: int, scores: list[list[tuple[int, np.ndarray]]]) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of the sums over all labellings of what lies before, and after, each place."""
    a, b = np.zeros(n + 1), np.zeros(n + 1)
    for j in range(1, n + 1):
        a[j] = np.logaddexp.reduce([a[j - 1], *[x for i, s in scores[j] for x in (a[i] + s)]])
    after: list[list[np.ndarray]] = [[] for _ in range(n + 1)]
    for j in range(n, -1, -1):
        if j < n:
            b[j] = np.logaddexp.reduce([b[j + 1], *[x for s in after[j] for x in s]])
        for i, s in scores[j]:
            after[i].append(s + b[j])
    return a, b


def tagged(island: Island, model: Model) -> list[tuple[str, int, int, float]]:
    """The best labelling's spans with their marginals."""
    lattice = Lattice.of(island)
    if not any(lattice.by_end):
        return []
    scores = model.scores(lattice)
    best, back = np.zeros(lattice.n + 1), [None] * (lattice.n + 1)
    for j in range(1, lattice.n + 1):
        best[j] = best[j - 1]
        for i, s in scores[j]:
            k = int(np.argmax(s))
            if best[i] + s[k] > best[j]:
                best[j], back[j] = best[i] + s[k], (i, k, s[k])
    a, b = _sums(lattice.n, scores)
    out, j = [], lattice.n
    while j > 0:
        if back[j] is None:
            j -= 1
            continue
        i, k, s = back[j]
        out.append((KINDS[k], island.pieces[i][0], island.pieces[j - 1][1], float(np.exp(a[i] + s + b[j] - a[-1]))))
        j = i
    return out[::-1]


def _variants(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    """Texts in which one base span is replaced by a form that the base patterns miss."""
    for kind, a, b in spans:
        old = text[a:b]
        new = []
        if kind == "phone":
            bare = re.sub(r"^\+[0-9]+ ?", "", old)
            digits = _digits(bare)
            new = [bare] + ([f"{digits[:-7]}-{digits[-7:-4]}-{digits[-4:]}", f"{digits[:-7]}.{digits[-7:-4]}.{digits[-4:]}"] if len(digits) >= 9 else [])
        elif kind == "card":
            d = _digits(old)
            new = [f"{d[:4]}.{d[4:8]}.{d[8:12]}.{d[12:]}"]
        for form in new:
            # plain words around it only: what else is personal there has no label here
            left = re.sub(r"(?s)^.*[0-9@]\S*", "", text[max(0, a - 40):a])
            right = re.sub(r"(?s)\S*[0-9@].*$", "", text[b:b + 40])
            yield f"{left}{form}{right}", [(kind, len(left), len(left) + len(form))]


def _fit(table: pa.Table) -> pa.Table:
    lattices, gold = [], []
    for text in sorted(t for t in table.column("__text").to_pylist() if t):
        spans = base_spans(text)
        for body, truth in [(text, spans), *_variants(text, spans)]:
            wanted = {(a, b): k for k, a, b in truth}
            for island in islands(body):
                lattice = Lattice.of(island)
                ends = {p[1]: x + 1 for x, p in enumerate(island.pieces)}
                begins = {p[0]: x for x, p in enumerate(island.pieces)}
                own = {(begins[a], ends[b]): KINDS.index(k) for (a, b), k in wanted.items() if a in begins and b in ends}
                if any(lattice.by_end):
                    lattices.append(lattice)
                    gold.append(own)
    m = Model(fitted=any(gold))
    memory = np.full(m.weights.shape, 1e-6)
    for _ in range(ROUNDS if m.fitted else 0):
        g = -1e-3 * m.weights
        for lattice, own in zip(lattices, gold, strict=True):
            scores = m.scores(lattice)
            a, b = _sums(lattice.n, scores)
            for j in range(1, lattice.n + 1):
                for (i, f), (_, s) in zip(lattice.by_end[j], scores[j], strict=True):
                    d = -np.exp(a[i] + s + b[j] - a[-1])
                    if (i, j) in own:
                        d[own[(i, j)]] += 1
                    g[:, f] += d[:, None]
        memory += g * g
        m.weights += 0.5 * g / np.sqrt(memory)
    return pa.table({"model": pa.array([pickle.dumps(m)], pa.binary())})


def fitted(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Fit on the ``sample`` texts with a digit or an at sign that come first by their hash, of up to 16,384 code points."""
    rows = docs.select(F.col(text_col).alias("__text")).filter((F.length("__text") <= 16_384) & F.col("__text").rlike("@|[0-9][0-9. ()-]{6,}[0-9]"))
    keys = rows.select(F.xxhash64("__text").alias("__key")).distinct().orderBy("__key").limit(sample)
    chosen = rows.withColumn("__key", F.xxhash64("__text")).join(F.broadcast(keys), "__key", "left_semi").dropDuplicates(["__key"])
    got = chosen.groupBy(F.lit(1).alias("__one")).applyInArrow(_fit, "model binary").collect()
    return pickle.loads(got[0][0]) if got else Model()  # noqa: S301 - written by our own task


def all_spans(text: str, model: Model) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and the spans that the field adds to them."""
    if not text or not _HOT.search(text):
        return [], []
    base = base_spans(text)
    if not model.fitted:
        return base, []
    taken = sorted((a, b) for _, a, b in base)
    added = []
    for island in islands(text):
        a, b = island.pieces[0][0], island.pieces[-1][1]
        near = [t for t in taken if t[0] < b and t[1] > a]
        for kind, x, y, sure in tagged(island, model):
            if sure >= LEAST_SURE and not any(p < y and q > x for p, q in near) and _valid(kind, text[x:y] if kind != "ip" else re.sub(r"[^0-9.]", "", text[x:y])):
                added.append((kind, x, y))
    return base, added


def _listed(spans: list[tuple[str, int, int]]) -> str:
    order = sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in order)


def found(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans (base and added, kind:start:end), n_added.

    Places are code points, end exclusive. Null and empty texts have no spans.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        nothing = hashlib.sha256(b"").hexdigest()
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                out: list[list] = [[] for _ in range(7)]
                for text in batch.column("__text").to_pylist():
                    base, added = all_spans(text, m)
                    counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                    line = [*counts, hashlib.sha256(_listed(base).encode()).hexdigest() if base else nothing, _listed(base + added), len(added)]
                    for column, value in zip(out, line, strict=True):
                        column.append(value)
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(out, kinds, strict=True)]],
                                                 ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")

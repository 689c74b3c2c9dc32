"""Scores of a language model: hashed-context bit predictors combined by online logistic mixing.

The model codes a text (A-Z as a-z, UTF-8) byte by byte, then an end byte that no text holds, and each
byte as 8 yes-or-no steps from its highest bit on. Before each step, a predictor of order k knows how
often training texts went on with 1 and with 0 behind the same k bytes and the same bits so far; its
vote is the logarithm of that ratio. The votes are added up with weights, and the sum's logistic value
is the probability. A gate chooses the weights: one set for each class of how often the two longest
contexts were seen. Every document starts from the same weights and refines them as it goes: after
SEGMENT bytes its own weights move along the gradient of what these bytes cost. So a score depends on
the document and the training texts only, not on its neighbours.

Counts cover all training texts and grow with them; no task or driver holds them whole. Documents are
dealt to slices of about SLICE_BYTES by hash. A slice lists the contexts (64-bit hashes) and words
that it meets, with its own counts; counts are added up by context, and each slice gets back the sums
of just those contexts. Sums of a context that every slice meets are combined before the shuffle. Then
slices are read behind their sums in one sorted stream.

The starting weights are fitted on all training texts: every byte is coded with its own occurrence taken
off the counts, so that they fit unseen text. What it costs depends on the longest context and the byte
only, so a context and a byte count once, with how often they occur. Contexts go by their last two bytes to
where their shorter ones are; the votes are kept in a table, and each step of Newton's method adds up
slopes and curvatures over it, of a fixed size for each task.

``base_score`` is the unigram score of words and one end; words are told apart by 64-bit hashes.

Cases: null counts as empty; an empty text is its end; a null id is a training text; repeated rows are
documents of their own; an empty table gives no rows; without any training text all votes are 0 and a
bit costs one bit; other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytable.functions.storage import removed, written, written_at
from skytable.llm.words import Words, mixed, unmixed

FOLDS, HELD_OUT = 7, 2
ORDERS = (1, 2, 3, 4)
SLICE_BYTES, CHUNK_BYTES = 16 << 20, 2 << 20
# Steps of the fit at most, the share of the cost at which it ends, contexts worked on at once, and codes a row of votes.
STEPS, ENOUGH, CONTEXTS, CODES = 12, 1e-6, 1 << 15, 4096
SEGMENT = 256
# Texts that are coded side by side, the size of the table that finds a code's votes, and codes voted on at once.
LANES, TABLE_BITS, SOME = 32, 20, 1 << 16
# What a vote adds to both counts.
SPARE = 0.2
LEVELS = (1, 3, 16)
GATES = (len(LEVELS) + 1) ** 2
FIRST, RATE, CALM = 0.3, 0.02, 64.0
_END = b"\xff"
_PAD = b"\x00" * max(ORDERS)
_SALT = {k: np.uint64(0x5851F42D4C957F2D * k & (1 << 64) - 1) for k in ORDERS}
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


class Chunk:
    """Texts laid out behind one another, with the longest context and byte of every place."""

    def __init__(self, texts: list[bytes]):
        joined = b"".join([p for t in texts for p in (_PAD, t.translate(_LOWER), _END)] + [b"\x00" * 8])
        buffer = np.frombuffer(joined, dtype=np.uint8)
        wide = np.ndarray(len(buffer) - 7, dtype=">u8", buffer=buffer, strides=(1,))
        self.sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
        whole = self.sizes + len(_PAD)
        self.first = np.cumsum(self.sizes) - self.sizes
        # places of contexts: len(_PAD) bytes before each coded byte
        at = np.arange(self.sizes.sum()) + np.repeat(np.cumsum(whole) - whole - self.first, self.sizes)
        self.codes = wide[at].astype(np.uint64) >> np.uint64(8 * (7 - len(_PAD)))

    def texts(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)


def context(codes: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the last ``order`` bytes, and the byte, of codes (the longest context and a byte)."""
    short = codes & np.uint64((1 << 8 * (order + 1)) - 1)
    return mixed((short >> np.uint64(8)) ^ _SALT[order]).view(np.int64), (codes & np.uint64(255)).astype(np.int64)


def _added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their sums."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, list[int], list[bytes]]]:
    """Rows of a slice, about ``size`` bytes at a time: slice, marks and texts."""
    for batch in batches:
        column = batch.column("__text").cast(pa.binary())
        slices = np.asarray(batch.column("slice"))
        steps = np.cumsum(np.asarray(pa.compute.binary_length(column), dtype=np.int64)) // size
        cuts = [0, *(np.flatnonzero((np.diff(steps) != 0) | (np.diff(slices) != 0)) + 1).tolist(), len(slices)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                yield int(slices[a]), batch.column("mark").slice(a, b - a).to_pylist(), column.slice(a, b - a).to_pylist()


def _listed(slice_: int, codes: np.ndarray, n: np.ndarray, words: np.ndarray, times: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A slice's contexts of all orders with their next bytes, and its words (order 0)."""
    for order in (0, *ORDERS):
        if order == 0:
            keys, bytes_, counts = words, np.zeros(len(words), np.int64), times
        else:
            short, counts = _added(codes & np.uint64((1 << 8 * (order + 1)) - 1), n)
            keys, bytes_ = context(short, order)
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        ends = pa.array(np.append(first, len(keys)).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(first), slice_, np.int32)), pa.array(np.full(len(first), order, np.int32)), pa.array(keys[first]),
             pa.ListArray.from_arrays(ends, pa.array(bytes_.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(counts))],
            ["slice", "order", "context", "bytes", "counts"])


LISTED = "slice int, order int, context long, bytes array<int>, counts array<long>"


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the rows of each slice meet, and how often its training texts (mark 1) do."""
    now, parts = None, []

    def flushed() -> Iterator[pa.RecordBatch]:
        if parts:
            codes, n, words, times = [np.concatenate(x) for x in zip(*parts, strict=True)]
            yield from _listed(now, *_added(codes, n), *_added(words, times))
            parts.clear()
    for slice_, marks, texts in _pieces(batches, CHUNK_BYTES):
        if slice_ != now:
            yield from flushed()
            now = slice_
        trains = np.asarray(marks, dtype=np.int64)
        chunk = Chunk(texts)
        codes, n = np.unique((chunk.codes << np.uint64(1)) | np.repeat(trains, chunk.sizes).astype(np.uint64), return_counts=True)
        w = Words(texts)
        words = np.sort(w.hashes).view(np.int64) if trains.all() else w.hashes.view(np.int64)
        parts.append((*_added(codes >> np.uint64(1), n * (codes & np.uint64(1)).astype(np.int64)),
                      *_added(words, np.ones(len(words), np.int64) if trains.all() else np.repeat(trains, w.counts()))))
        if len(parts) >= 8:
            codes, n, words, times = [np.concatenate(x) for x in zip(*parts, strict=True)]
            parts[:] = [(*_added(codes, n), *_added(words, times))]
    yield from flushed()


class Sums:
    """Counts over all training texts of the contexts and words that a slice meets."""

    def __init__(self, batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches)
        order, keys = np.asarray(table.column("order")), np.asarray(table.column("context"))
        sizes = np.asarray(pa.compute.list_value_length(table.column("bytes")), dtype=np.int64)
        bytes_ = np.asarray(pa.compute.list_flatten(table.column("bytes")), dtype=np.int64)
        counts = np.asarray(pa.compute.list_flatten(table.column("counts")), dtype=np.int64)
        row = np.repeat(np.arange(len(keys)), sizes)
        self.keys: dict[int, np.ndarray] = {}
        self.places: dict[int, np.ndarray] = {}
        self.before: dict[int, np.ndarray] = {}
        for k in (0, *ORDERS):
            mine = np.flatnonzero(order == k)
            mine = mine[np.argsort(keys[mine])]
            self.keys[k] = keys[mine]
            rank = np.full(len(keys), -1)
            rank[mine] = np.arange(len(mine))
            inside = np.flatnonzero(rank[row] >= 0)
            place = rank[row[inside]] * 256 + bytes_[inside]
            by = np.argsort(place)
            self.places[k] = place[by]
            self.before[k] = np.append(0, np.cumsum(counts[inside][by]))

    def words(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys[0], hashes)
        return np.diff(self.before[0])[at]

    def path(self, order: int, keys: np.ndarray, bytes_: np.ndarray) -> np.ndarray:
        """Counts of each context, and of the context with the first 1 to 8 bits of its byte: rows by 9."""
        base = np.searchsorted(self.keys[order], keys) * 256
        out = np.empty((len(keys), 9), dtype=np.int64)
        for b in range(9):
            low = base + (bytes_ & ~(255 >> b))
            ends = np.searchsorted(self.places[order], np.stack([low, low + (256 >> b)]))
            out[:, b] = self.before[order][ends[1]] - self.before[order][ends[0]]
        return out


def votes(codes: np.ndarray, sums: Sums, own: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Votes for the true bits (a row of orders times 8) and the gate of each code.

    ``own`` is taken off the counts on the true way: the occurrence that is being coded.
    """
    out, gate = np.empty((len(codes), 8 * len(ORDERS)), dtype=np.float32), np.zeros(len(codes), dtype=np.int64)
    for i, order in enumerate(ORDERS):
        short, back = np.unique(codes & np.uint64((1 << 8 * (order + 1)) - 1), return_inverse=True)
        n = np.maximum(sums.path(order, *context(short, order)) - own, 0)
        out[:, 8 * i:8 * i + 8] = np.log((n[:, 1:] + SPARE) / (n[:, :-1] - n[:, 1:] + SPARE)).astype(np.float32)[back]
        if order in ORDERS[-2:]:
            gate = gate * (len(LEVELS) + 1) + np.searchsorted(LEVELS, n[:, 0], side="right")[back]
    return out, gate


class Votes:
    """Votes of the codes that a slice has met so far, worked out once for each.

    The sums name all codes of a slice, so there is room for them from the start, and no copy is made to add some.
    """

    def __init__(self, sums: Sums):
        self.sums, self.n = sums, 0
        room = len(sums.places[max(ORDERS)])
        self.codes = np.empty(room, dtype=np.uint64)
        self.vote, self.gate = np.empty((room, 8 * len(ORDERS)), dtype=np.float32), np.empty(room, dtype=np.int8)
        self.table = np.full(1 << TABLE_BITS, -1, dtype=np.int32)
        # codes whose place in the table another one has, in order
        self.others, self.other_at = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)

    def _slots(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def places(self, codes: np.ndarray) -> np.ndarray:
        """Rows of ``vote`` and ``gate`` for codes; new ones are added."""
        if not self.n:
            self._add(np.unique(codes))
        at = self.table[self._slots(codes)]
        missed = np.flatnonzero((at < 0) | (self.codes[at] != codes))
        if len(missed):
            lost, back = np.unique(codes[missed], return_inverse=True)
            new = lost[~np.isin(lost, self.others)]
            new = new[(self.table[self._slots(new)] < 0) | (self.codes[self.table[self._slots(new)]] != new)]
            if len(new):
                self._add(new)
            found = self.table[self._slots(lost)]
            apart = np.flatnonzero((found < 0) | (self.codes[found] != lost))
            found[apart] = self.other_at[np.searchsorted(self.others, lost[apart])]
            at[missed] = found[back]
        return at

    def _add(self, codes: np.ndarray) -> None:
        rows = np.arange(self.n, self.n + len(codes), dtype=np.int32)
        for a in range(0, len(codes), SOME):
            some = slice(self.n + a, self.n + min(a + SOME, len(codes)))
            self.vote[some], self.gate[some] = votes(codes[a:a + SOME], self.sums)
        self.codes[self.n:self.n + len(codes)] = codes
        self.n += len(codes)
        slots = self._slots(codes)
        free = self.table[slots] < 0
        self.table[slots[free]] = rows[free]
        left = self.table[slots] != rows
        others = np.concatenate([self.others, codes[left]])
        order = np.argsort(others)
        self.others, self.other_at = others[order], np.concatenate([self.other_at, rows[left]])[order]


# Votes are rows of orders times 8 bits. Products with these matrices add up the orders of each bit, spread the bits
# over the orders, and add up the bits of each order: long products are far faster than sums over short rows.
_BITS = np.tile(np.eye(8, dtype=np.float32), (len(ORDERS), 1))
_SPREAD = np.ascontiguousarray(_BITS.T)
_ORDERS = np.repeat(np.eye(len(ORDERS), dtype=np.float32), 8, axis=0)
_EIGHT = np.ones(8, dtype=np.float32)
_LEAST = np.float32(-80)


def _bits(weights: np.ndarray, place: np.ndarray, vote: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cost in nats of each byte, and the gradient of each order's weight, of bytes with weights at ``place``."""
    v = vote.take(at, axis=0)
    part = v * np.repeat(weights, 8, axis=1).take(place, axis=0)
    odds = np.exp(-np.maximum(part @ _BITS, _LEAST))
    more = odds + np.float32(1)
    cost = np.log(more) @ _EIGHT
    odds /= more
    np.multiply(v, odds @ _SPREAD, out=part)
    return cost, part @ _ORDERS


def coded(chunk: Chunk, vote: np.ndarray, gate: np.ndarray, which: np.ndarray, start: np.ndarray, rate: float = RATE) -> np.ndarray:
    """Cost in nats of each text; each refines its own copy of the weights after every SEGMENT bytes.

    A few texts of like length go together, so that their numbers stay in the processor's cache.
    """
    order = np.argsort(-chunk.sizes, kind="stable")
    out = np.zeros(len(order))
    for some in np.split(order, range(LANES, len(order), LANES)):
        sizes, first = chunk.sizes[some], chunk.first[some]
        weights = np.tile(start.astype(np.float32), (len(some), 1))
        for done in range(0, int(sizes[0]) if len(sizes) else 0, SEGMENT):
            m = int(np.searchsorted(-sizes, -done, side="left"))
            many = np.minimum(sizes[:m] - done, SEGMENT)
            lane, begin = np.repeat(np.arange(m), many), np.cumsum(many) - many
            at = which[np.arange(len(lane)) + np.repeat(first[:m] + done - begin, many)]
            place = lane * GATES + gate[at]
            cost, slope = _bits(weights, place, vote, at)
            out[some[:m]] += np.add.reduceat(cost, begin, dtype=np.float64)
            if sizes[0] > done + SEGMENT:
                seen = np.bincount(place, minlength=m * GATES)
                step = np.stack([np.bincount(place, slope[:, k], minlength=m * GATES) for k in range(len(ORDERS))], axis=1)
                weights[:m * GATES] += (rate * step / (seen + CALM)[:, None]).astype(np.float32)
    return out


TAILED = "tail int, order int, context long, bytes array<int>, counts array<long>"
VOTED = "n binary, gate binary, vote binary"
SLOPES = "cost double, slope array<double>, curve array<double>"


def _tailed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of order 2 and more with their last two bytes."""
    for batch in batches:
        order, keys = np.asarray(batch.column("order")), np.asarray(batch.column("context")).view(np.uint64)
        salt = np.zeros(max(ORDERS) + 1, dtype=np.uint64)
        salt[list(ORDERS)] = [_SALT[k] for k in ORDERS]
        tail = ((unmixed(keys) ^ salt[order]) & np.uint64(0xFFFF)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(tail), *[batch.column(c) for c in ("order", "context", "bytes", "counts")]], ["tail", "order", "context", "bytes", "counts"])


def _voted(short: pa.Table):
    """Votes of all codes of training texts, from contexts in order of their tails; ``short`` has those of order 1."""
    names = ["order", "context", "bytes", "counts"]

    def of(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        longest = table.filter(pa.compute.equal(table.column("order"), max(ORDERS)))
        raw = unmixed(np.asarray(longest.column("context")).view(np.uint64)) ^ _SALT[max(ORDERS)]
        sizes = np.asarray(pa.compute.list_value_length(longest.column("bytes")), dtype=np.int64)
        bytes_ = np.asarray(pa.compute.list_flatten(longest.column("bytes"))).astype(np.uint64)
        n = np.asarray(pa.compute.list_flatten(longest.column("counts")), dtype=np.int64)
        codes = ((np.repeat(raw, sizes) << np.uint64(8)) | bytes_)[n > 0]
        n = n[n > 0]
        vote, gate = votes(codes, Sums([*short.to_batches(), *held]), own=1)
        for a in range(0, len(n), CODES):
            part = [x[a:a + CODES] for x in (n, gate, vote)]
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in part], ["n", "gate", "vote"])

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            tails = np.asarray(batch.column("tail"))
            cuts = [0, *(np.flatnonzero(np.diff(tails) != 0) + 1).tolist(), len(tails)]
            if held and len(tails) and tails[0] != last and rows >= CONTEXTS:
                yield from of(held)
                held, rows = [], 0
            done = 0
            for cut in cuts[1:-1]:
                if rows + cut - done >= CONTEXTS:
                    yield from of([*held, batch.slice(done, cut - done).select(names)])
                    held, rows, done = [], 0, cut
            if len(tails) > done:
                held.append(batch.slice(done).select(names))
                rows, last = rows + len(tails) - done, tails[-1]
        if held:
            yield from of(held)
    return voted


def _slopes(weights: np.ndarray):
    """Cost of all codes under ``weights``, and its slope and curvature by the weights of each gate, as one row a task."""
    def slopes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost, slope, curve = 0.0, np.zeros((GATES, len(ORDERS))), np.zeros((GATES, len(ORDERS), len(ORDERS)))
        for batch in batches:
            for i in range(batch.num_rows):
                n, gate, vote = (np.frombuffer(batch.column(c)[i].as_buffer(), dtype=t) for c, t in (("n", np.int64), ("gate", np.int64), ("vote", np.float32)))
                v = vote.reshape(len(n), len(ORDERS), 8).transpose(0, 2, 1).astype(np.float64)
                odds = np.exp(-np.maximum(np.einsum("nbk,nk->nb", v, weights[gate]), float(_LEAST)))
                cost += float(n @ np.log1p(odds).sum(axis=1))
                wrong = odds / (1 + odds)
                for g in np.unique(gate):
                    mine = gate == g
                    rows, w = v[mine].reshape(-1, len(ORDERS)), (n[mine, None] * wrong[mine]).reshape(-1)
                    slope[g] += rows.T @ w
                    curve[g] += (rows * (w * (1 - wrong[mine].reshape(-1)))[:, None]).T @ rows
        yield pa.RecordBatch.from_pydict({"cost": [cost], "slope": [slope.reshape(-1).tolist()], "curve": [curve.reshape(-1).tolist()]},
                                         schema=pa.schema([("cost", pa.float64()), ("slope", pa.list_(pa.float64())), ("curve", pa.list_(pa.float64()))]))
    return slopes


def fitted(sums: DataFrame) -> np.ndarray:
    """Weights of each gate with the least cost over all training texts, each byte without its own occurrence.

    Newton's method, with half of a step where a whole one costs more. Gates that are seldom met stay near FIRST.
    """
    start = np.full((GATES, len(ORDERS)), FIRST)
    seen = sums.filter("order > 0 and exists(counts, n -> n > 0)")
    # at most 256 contexts of 256 bytes
    short = seen.filter("order = 1").select("order", "context", "bytes", "counts").toArrow()
    if not short.num_rows:
        return start
    longer = seen.filter("order > 1").select("order", "context", "bytes", "counts").mapInArrow(_tailed, TAILED)
    voted, path = written_at(longer.repartition("tail").sortWithinPartitions("tail").mapInArrow(_voted(short), VOTED), "lm_votes")

    def at(weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        parts = sorted(tuple(r) for r in voted.mapInArrow(_slopes(weights), SLOPES).collect())
        off = weights - start
        return (sum(p[0] for p in parts) + CALM / 2 * float((off * off).sum()), np.sum([p[1] for p in parts], axis=0).reshape(start.shape) - CALM * off,
                np.sum([p[2] for p in parts], axis=0).reshape(GATES, len(ORDERS), len(ORDERS)) + CALM * np.eye(len(ORDERS)))
    weights, (cost, slope, curve) = start, at(start)
    step = np.linalg.solve(curve, slope[:, :, None])[:, :, 0]
    for _ in range(STEPS):
        found = at(weights + step)
        if found[0] > cost:
            step = step / 2
            continue
        done = cost - found[0] <= ENOUGH * cost
        weights, (cost, slope, curve) = weights + step, found
        if done:
            break
        step = np.linalg.solve(curve, slope[:, :, None])[:, :, 0]
    removed(sums.sparkSession, path)
    return weights.round(6)


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Sums, pa.RecordBatch]]:
    """Slices with their sums: a slice's sums come first (kind 0), then its texts, batch by batch."""
    held: list[pa.RecordBatch] = []
    now, sums = None, None
    for batch in batches:
        slices, kinds = np.asarray(batch.column("slice")), np.asarray(batch.column("kind"))
        cuts = [0, *(np.flatnonzero((np.diff(slices) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), len(slices)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b == a:
                continue
            part = batch.slice(a, b - a)
            if kinds[a] == 0:
                if now != slices[a]:
                    now, held, sums = int(slices[a]), [], None
                held.append(part.select(["order", "context", "bytes", "counts"]))
                continue
            if sums is None or now != slices[a]:
                if now != slices[a]:
                    now, held = int(slices[a]), []
                sums = Sums(held) if held else None
                held = []
            if sums is not None:
                yield now, sums, part


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(weights: np.ndarray, docs: int, total: int, distinct: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, known = math.log10(total + distinct + 1), None
        for _, sums, part in _streamed(batches):
            if known is None or known.sums is not sums:
                known = Votes(sums)
            done = 0
            for _, marks, texts in _pieces(iter([part]), CHUNK_BYTES):
                chunk = Chunk(texts)
                which = known.places(chunk.codes)
                cost = coded(chunk, known.vote, known.gate, which, weights)
                w = Words(texts)
                distinct_words, of = np.unique(w.hashes.view(np.int64), return_inverse=True)
                counts = sums.words(distinct_words)[of] if len(of) else np.zeros(0, np.int64)
                text = np.repeat(np.arange(len(texts)), w.counts())
                familiar = np.bincount(text, counts > 0, minlength=len(texts)).astype(np.int64) + (docs > 0)
                base = np.bincount(text, np.log10(counts + 1.0), minlength=len(texts)) + math.log10(docs + 1) - (w.counts() + 1) * least
                ids = part.column("id").slice(done, len(texts))
                done += len(texts)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([m == 0 for m in marks]), pa.array(w.counts() + 1), pa.array(familiar), pa.array(np.full(len(texts), total, np.int64)),
                     pa.array(base), pa.array(-cost / math.log(10))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return score


def scores(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    ``weights`` (gates by orders) are fitted where none are given.
    """
    id_ = F.col("doc_id").cast("long")
    held = F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT
    rows = docs.select(id_.alias("id"), F.coalesce("text", F.lit("")).alias("__text"), (~held).cast("int").alias("mark"))
    size = rows.agg(F.sum(F.octet_length("__text") + 1), F.sum("mark")).first()
    slices = max(1, -(-int(size[0] or 0) // SLICE_BYTES))
    train_docs = int(size[1] or 0)
    dealt = rows.withColumn("slice", F.pmod(F.xxhash64("id", "__text"), F.lit(slices)).cast("int"))
    met = written(dealt.repartition("slice").sortWithinPartitions("slice").select("slice", "mark", "__text").mapInArrow(_gathered, LISTED), "lm_contexts")
    each = met.select("order", "context", F.explode(F.arrays_zip("bytes", "counts")).alias("e")).groupBy("order", "context", F.col("e.bytes").alias("b")).agg(F.sum("e.counts").alias("n"))
    sums = written(each.groupBy("order", "context").agg(F.array_sort(F.collect_list(F.struct("b", "n"))).alias("e"))
                   .select("order", "context", F.col("e.b").alias("bytes"), F.col("e.n").alias("counts")), "lm_sums")
    words = sums.filter("order = 0 and counts[0] > 0").agg(F.coalesce(F.sum(F.col("counts")[0]), F.lit(0)), F.count("*")).first()
    total, distinct = int(words[0]) + train_docs, int(words[1]) + (train_docs > 0)

    if weights is None:
        weights = fitted(sums)
    answers = met.select("slice", "order", "context").join(sums, ["order", "context"]).withColumn("kind", F.lit(0))
    both = answers.unionByName(dealt.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    stream = both.repartition("slice").sortWithinPartitions("slice", "kind").select("slice", "kind", "id", "mark", "__text", "order", "context", "bytes", "counts")
    return stream.mapInArrow(_scored(weights, train_docs, total, distinct), RESULT)

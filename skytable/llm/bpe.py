"""Byte-level BPE: overlapping chunks are pre-tokenised in parallel and stitched where their boundaries meet again.

Texts of up to CHUNK code points are encoded where they lie. Longer ones are cut into chunks that
overlap by OVERLAP code points, and the chunks are spread over all tasks. Each chunk is split by the
pattern from its own start; within an overlap, the first boundary that both neighbours have is a
true one (what follows a boundary depends on the text after it only, and boundaries near the cut end
of a chunk are not trusted). From the first chunk without a common boundary on, as within one very
long word, the rest of a text is joined and split anew. The pieces between true boundaries are encoded independently, and a document's
ids are those of its pieces in order. Decoding concatenates the raw bytes of the ids.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skytable.functions.storage import written

CHUNK = 32_768
OVERLAP = 1_024
# The pattern looks at most this far behind the end of a match.
LOOKAHEAD = 3
# Pieces whose ids a task remembers; the memory is emptied when full.
REMEMBERED = 300_000


def ranks_of(path: str) -> dict[bytes, int]:
    """Read a rank file: base64 token and rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class PieceIds(dict):
    """Ids of a piece as little-endian 32-bit numbers, computed when first asked for."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        super().__init__()
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks_of(path), special_tokens={})

    def __missing__(self, piece: str) -> bytes:
        import numpy as np

        if len(self) >= REMEMBERED:
            self.clear()
        ids = np.asarray(self.encoding.encode_ordinary(piece), dtype="<i4").tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


def _encoder(path: str, pattern: str, keys: pa.Schema, text: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches with ``text`` to batches with the other columns and ``ids``."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import regex

        pieces, known = regex.compile(pattern).findall, PieceIds(path, pattern)
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                found = [b"".join(map(known.__getitem__, pieces(t))) if t else b"" for t in batch.column(text).to_pylist()]
                offsets = np.zeros(len(found) + 1, dtype=np.int32)
                np.cumsum([len(x) // 4 for x in found], out=offsets[1:])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), dtype="<i4")))
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys.names], ids], [*keys.names, "ids"])
    return encode


def _cut(chunk: int, overlap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("__key").to_pylist(), batch.column("__text").to_pylist(), strict=True):
                starts = list(range(0, max(len(text) - overlap, 1), chunk))
                yield pa.RecordBatch.from_pydict({
                    "__key": [key] * len(starts), "__no": pa.array(range(len(starts)), pa.int32()), "__start": pa.array(starts, pa.int64()),
                    "__last": [s == starts[-1] for s in starts],
                    "__chunk": [text[s:] if s == starts[-1] else text[s:s + chunk + overlap] for s in starts]})
    return cut


def _boundaries(pattern: str, chunk: int, overlap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Boundaries of each chunk in the overlap with the chunk before (head) and after (tail), as places in the text."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        matches = regex.compile(pattern).finditer
        for batch in batches:
            heads, tails = [], []
            for start, last, text in zip(batch.column("__start").to_pylist(), batch.column("__last").to_pylist(),
                                         batch.column("__chunk").to_pylist(), strict=True):
                edges = [0, *[m.end() for m in matches(text)]]
                trusted = len(text) if last else len(text) - LOOKAHEAD
                edges = [e for e in edges if e <= trusted]
                heads.append([start + e for e in edges if e <= overlap])
                tails.append([] if last else [start + e for e in edges if e >= chunk])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))],
                [*batch.schema.names, "__head", "__tail"])
    return split


def _spans(long: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """Cut long texts at true boundaries: __key, __no, __span."""
    chunks = long.mapInArrow(_cut(chunk, overlap), "__key string, __no int, __start long, __last boolean, __chunk string")
    split = chunks.repartition("__key", "__no").mapInArrow(
        _boundaries(pattern, chunk, overlap), "__key string, __no int, __start long, __last boolean, __chunk string, __head array<long>, __tail array<long>")
    w = Window.partitionBy("__key").orderBy("__no")
    met = split.withColumn("__met", F.when(F.col("__no") == 0, F.lit(0)).otherwise(
        F.array_min(F.array_intersect(F.lag("__tail").over(w), "__head")))).drop("__head", "__tail")
    # behind a chunk that met nothing, no boundary is known to be a true one: the rest is one run
    met = met.withColumn("__met", F.when(F.max(F.col("__met").isNull()).over(w), None).otherwise(F.col("__met")))
    owned = met.withColumns({"__from": F.coalesce("__met", "__start"), "__run": F.count("__met").over(w)})
    owned = owned.withColumn("__to", F.lead("__from").over(w))
    first = (F.col("__from") - F.col("__start") + 1).cast("int")
    size = F.when(F.col("__last"), F.length("__chunk")).otherwise(F.col("__to") - F.col("__from")).cast("int")
    parts = owned.select("__key", "__run", F.struct("__no", F.substring("__chunk", first, size).alias("part")).alias("__part"))
    return parts.groupBy("__key", "__run").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("__part")), lambda p: p["part"]), "").alias("__span"))


def encoded(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text",
            chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per row of ``docs``: doc_id and ``ids`` (array of int), without special tokens.

    Null and empty texts have no ids. Long texts meet by their SHA-256, so equal ones are encoded
    once and rows that repeat a doc_id, or have none, keep their own texts.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    is_long = F.length("__text") > chunk
    short = rows.filter(~is_long).mapInArrow(_encoder(ranks_path, pattern, pa.schema([("doc_id", pa.null())]), "__text"), f"doc_id {kind}, ids array<int>")
    long = rows.filter(is_long).withColumn("__key", F.sha2("__text", 256))
    each = long.select("__key", "__text").dropDuplicates(["__key"])
    keys = pa.schema([("__key", pa.null()), ("__run", pa.null())])
    pieces = _spans(each, pattern, chunk, overlap).mapInArrow(
        _encoder(ranks_path, pattern, keys, "__span"), "__key string, __run long, ids array<int>")
    whole = pieces.groupBy("__key").agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("__run", "ids"))), lambda p: p["ids"])).alias("ids"))
    return short.unionByName(long.select("doc_id", "__key").join(whole, "__key").select("doc_id", "ids"))


def _decoder(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        ranks = ranks_of(path)
        table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        vocabulary = pa.array(table, pa.large_binary())
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                lists = batch.column("ids")
                flat = vocabulary.take(lists.flatten())
                ends = np.zeros(batch.num_rows + 1, dtype=np.int64)
                np.cumsum(np.asarray(lists.value_lengths().fill_null(0)), out=ends[1:])
                places = np.frombuffer(flat.buffers()[1], dtype=np.int64, count=len(flat) + 1) if len(flat) else np.zeros(1, np.int64)
                data = flat.buffers()[2].to_pybytes() if len(flat) else b""
                cuts = places[ends]
                out = [data[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                kept = [n for n in batch.schema.names if n != "ids"]
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], pa.array(out, pa.binary())], [*kept, "decoded"])
    return decode


def decoded(tokens: DataFrame, ranks_path: str, *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``decoded``: the raw bytes of ``ids``; null and empty ids give no bytes."""
    kinds = ", ".join(f"{c} {tokens.schema[c].dataType.simpleString()}" for c in keep)
    return tokens.select(*keep, "ids").mapInArrow(_decoder(ranks_path), f"{kinds}, decoded binary")


def summary(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document."""
    ids = encoded(docs, ranks_path, pattern).select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"))
    return decoded(ids, ranks_path, keep=("doc_id", "n_tokens", "ids_sha256")).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def tokenised(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids, n_tokens and ``round_trip``: whether the ids decode to the bytes of the text they came from (by SHA-256)."""
    keyed = docs.select(F.struct("doc_id", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("digest")).alias("of"), "text")
    ids = encoded(keyed, ranks_path, pattern, id_col="of").withColumn("kept", F.col("ids"))
    back = decoded(ids, ranks_path, keep=("doc_id", "kept"))
    return back.select("doc_id.doc_id", F.col("kept").alias("ids"), F.size("kept").cast("long").alias("n_tokens"),
                       (F.sha2("decoded", 256) == F.col("doc_id.digest")).alias("round_trip"))

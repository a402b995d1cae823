"""Packing documents into token sequences along a space-filling curve.

Every document becomes a hashed token vector, projected to a few dimensions; the Hilbert
key of that point orders the documents so that neighbours on the curve are alike.  The
documents' tokens form one stream in that order, and the stream is cut every ``length``
tokens: a sequence holds neighbours, and only the last one is not full.

Texts are encoded once.  The ids are written once, the order is worked out on narrow rows
(key and count), and one join brings the positions back to the ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dossier.llm.common import text_of, written
from dossier.llm.tokens import ByteBpe, built, vocabulary

HASHED, DIMENSIONS, BITS = 512, 4, 12
ROWS = 256
PIECES_OUT = 4096


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of integer points (rows) with ``bits`` bits each.

    Gray-code form: from the high bit down, a set bit inverts the lower bits of the
    first axis, an unset one swaps them with the first axis; then the axes' bits are
    interleaved and Gray-decoded.
    """
    axes = points.astype(np.int64).T.copy()
    n = len(axes)
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for k in range(n):
            on = (axes[k] & bit) != 0
            swap = np.where(on, 0, (axes[0] ^ axes[k]) & low)
            axes[0] ^= np.where(on, low, swap)
            axes[k] ^= swap
    for k in range(1, n):
        axes[k] ^= axes[k - 1]
    mask = np.zeros_like(axes[0])
    for level in range(bits - 1, 0, -1):
        mask ^= np.where(axes[-1] & (1 << level), (1 << level) - 1, 0)
    axes ^= mask
    key = np.zeros_like(axes[0])
    for level in range(bits - 1, -1, -1):
        for k in range(n):
            key = key << 1 | (axes[k] >> level & 1)
    return key


def _projection(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash bucket of every token, and the fixed random map to the curve's space."""
    mixed = (np.arange(size, dtype=np.uint64) + 1) * np.uint64(0x9E3779B97F4A7C15)
    chance = np.random.default_rng(7)
    return (mixed >> np.uint64(40)).astype(np.int64) % HASHED, chance.standard_normal(
        (HASHED, DIMENSIONS))


def curve_points(ids: np.ndarray, sizes: np.ndarray, buckets: np.ndarray,
                 spread: np.ndarray) -> np.ndarray:
    """Integer points of documents, given as all their ids and each one's number of ids; a
    document without ids gets the middle point."""
    cells = np.repeat(np.arange(len(sizes)) * HASHED, sizes) + buckets[ids]
    vectors = np.sqrt(np.bincount(cells, minlength=len(sizes) * HASHED)).reshape(-1, HASHED)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    places = (vectors / np.where(norm == 0, 1, norm)) @ spread
    return np.clip((places + 3) / 6 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)


def _encoded(docs: DataFrame, path: str, id_col: str, text_col: str, stop: int) -> DataFrame:
    """Written rows (uid, id, ids, tokens, key); ids are compressed bytes."""
    raw = vocabulary(docs.sparkSession, path)
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"),
                       text_of(text_col).alias("body"))

    def run(batches):
        bpe, squeeze = built(ByteBpe, raw.value), zstandard.ZstdCompressor(level=1)
        buckets, spread = _projection(bpe.size)
        end = stop.to_bytes(bpe.width, "little")
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                got = bpe.ids(batch.column("body").to_pylist())
                sizes = np.array([len(g) // bpe.width for g in got], np.int64)
                points = curve_points(np.frombuffer(b"".join(got), bpe.dtype), sizes, buckets, spread)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("uid"), batch.column("id"),
                     pa.array([squeeze.compress(g + end) for g in got], pa.binary()),
                     pa.array(sizes + 1, pa.int64()),
                     pa.array(hilbert_keys(points), pa.int64())],
                    ["uid", "id", "ids", "tokens", "key"])

    kind = rows.schema["id"].dataType.simpleString()
    return written(rows.mapInArrow(
        run, f"uid long, id {kind}, ids binary, tokens long, key long"))


def _positions(encoded: DataFrame) -> DataFrame:
    """(uid, first): where each document starts in the stream.

    The range exchange sorts by (key, id, uid), so copies with one key spread over
    several ranges.  A range keeps a running count; the ranges' totals, one row each, are
    summed up and added back.
    """
    def run(batches):
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            tokens = batch.column("tokens").to_numpy()
            upto = before + np.cumsum(tokens)
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid"), pa.array(np.full(len(tokens), part), pa.int32()),
                 pa.array(upto - tokens, pa.int64()), pa.array(tokens, pa.int64())],
                ["uid", "part", "before", "tokens"])
            before = int(upto[-1]) if len(upto) else before

    ranges = written(
        encoded.select("key", "id", "uid", "tokens").repartitionByRange("key", "id", "uid")
        .sortWithinPartitions("key", "id", "uid").select("uid", "tokens")
        .mapInArrow(run, "uid long, part int, before long, tokens long"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.groupBy("part").agg(F.sum("tokens").alias("total")).select(
        "part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("start"))
    return ranges.join(F.broadcast(starts), "part").select(
        "uid", (F.col("start") + F.col("before")).alias("first"))


def pack(docs: DataFrame, path: str, length: int = 1024, stop: int = 0, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids, doc_tokens, sequence_id, offset.

    ``ids`` are the piece's ids as little-endian unsigned 32-bit numbers; ``stop`` ends
    every document, so a null or empty text is one token.  Null and repeated ids are
    documents of their own.  An empty table gives no rows.
    """
    raw = vocabulary(docs.sparkSession, path)
    encoded = _encoded(docs, path, id_col, text_col, stop)
    placed = encoded.select("uid", "id", "ids", "tokens").join(
        _positions(encoded).hint("merge"), "uid")

    def run(batches):
        dtype, unpack = built(ByteBpe, raw.value).dtype, zstandard.ZstdDecompressor()
        for batch in batches:
            rows: list[tuple] = []
            for row, (blob, tokens, first) in enumerate(zip(*(
                    batch.column(c).to_pylist() for c in ("ids", "tokens", "first")))):
                ids = np.frombuffer(unpack.decompress(blob), dtype).astype("<u4")
                at = 0
                while at < tokens:
                    sequence, offset = divmod(first + at, length)
                    size = min(length - offset, tokens - at)
                    rows.append((row, at, size, ids[at:at + size].tobytes(), tokens, sequence,
                                 offset))
                    at += size
                    if len(rows) == PIECES_OUT:
                        yield _pieces(batch, rows)
                        rows = []
            if rows:
                yield _pieces(batch, rows)

    kind = encoded.schema["id"].dataType.simpleString()
    return placed.mapInArrow(
        run, f"id {kind}, start long, length long, ids binary, doc_tokens long, "
             "sequence_id long, offset long").withColumnRenamed("id", id_col)


def _pieces(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
    names = ["start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays(
        [batch.column("id").take(pa.array(columns[0], pa.int64())),
         *(pa.array(c, k) for c, k in zip(columns[1:], kinds))], ["id", *names])

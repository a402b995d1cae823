"""Near duplicates by SimHash with multi-index hashing.

A fingerprint is cut into segments.  Two fingerprints within ``distance`` bits differ by
at most distance // segments bits in one of them, so looking up a small Hamming ball around
each segment in the segment's table finds every pair; the complete distance is then
verified.  Equal fingerprints are one entry from the start.

A table entry that more than ``crowd`` fingerprints share would give all pairs of them.
The fingerprints that meet such an entry are linked through midpoints instead: two
fingerprints are within 3 bits exactly when some point is within 1 bit of one and within
2 bits of the other, so one star per point links them, with work that grows with the
number of fingerprints and not with its square.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dossier.llm.common import attach, text_of, whole_row, written
from dossier.llm.components import components

BITS, SEED, SEGMENTS, CROWD = 64, 42, 2, 64
ROWS, VOTES = 128, 1 << 15
_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def fingerprint(text: str, shingle: int) -> int:
    """Bit i is set when it is set in over half of the shingles' hashes, as a signed long."""
    words = text.encode().lower().translate(_SPACES).split(b" ")
    words = [w for w in words if w]
    if not words:
        return 0
    joined = b" ".join(words)
    stops = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(len(words) - shingle + 1, 1)
    starts = [0, *(stops[:n - 1] + 1).tolist()]
    ends = stops[min(shingle, len(words)) - 1:].tolist()
    hash64, votes = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    hashes = np.array([hash64(joined[a:b], SEED) for a, b in zip(starts, ends)], np.uint64)
    for at in range(0, n, VOTES):
        raw = hashes[at:at + VOTES].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(votes * 2 > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(id, fp): one row per row; a null or blank text has fingerprint zero."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("body"))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(
                        [fingerprint(t, shingle) for t in batch.column("body").to_pylist()],
                        pa.int64())], ["id", "fp"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def _balls(bits: int, radius: int) -> list[int]:
    """The masks with at most ``radius`` of ``bits`` bits set, as signed longs."""
    masks = [sum(1 << b for b in chosen) for r in range(radius + 1)
             for chosen in combinations(range(bits), r)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _around(value: Column, bits: int, radius: int) -> Column:
    return F.transform(F.array(*map(F.lit, _balls(bits, radius))),
                       lambda mask: value.bitwiseXOR(mask))


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(distinct: DataFrame, distance: int = 3, segments: int = SEGMENTS,
          crowd: int = CROWD) -> DataFrame:
    """(a, b): edges between distinct fingerprints ``fp`` whose components are those of
    all pairs within ``distance`` bits.

    Pairs met through an entry of at most ``crowd`` fingerprints are all listed.
    """
    if BITS % segments:
        raise ValueError("the segments must be equally long")
    width = BITS // segments
    cut = F.array(*[F.shiftrightunsigned("fp", width * s).bitwiseAND(
        F.lit((1 << width) - 1)) for s in range(segments)])
    table = distinct.select("fp", F.posexplode(cut).alias("segment", "value"))
    probes = table.select("fp", "segment", F.explode(
        _around(F.col("value"), width, distance // segments)).alias("value"))
    sizes = table.groupBy("segment", "value").agg(F.count(F.lit(1)).alias("members"))
    # by hint here and below: entries and labels may look small enough to be sent through the driver
    sized = written(probes.join(sizes.hint("merge"), ["segment", "value"]))
    calm = sized.filter(F.col("members") <= crowd).join(
        table.withColumnRenamed("fp", "other").hint("merge"), ["segment", "value"])
    found = calm.filter((F.col("fp") != F.col("other"))
                        & (_distance(F.col("fp"), F.col("other")) <= distance)).select(
        F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b"))
    return found.unionByName(_midpoint_links(
        sized.filter(F.col("members") > crowd).select("fp").distinct(), distance)).distinct()


def _midpoint_links(crowded: DataFrame, distance: int) -> DataFrame:
    near, far = distance // 2, distance - distance // 2
    points = (crowded.select("fp", F.explode(_around(F.col("fp"), BITS, far)).alias("point"))
              .withColumn("near", _distance(F.col("fp"), F.col("point")) <= near))
    hubs = points.groupBy("point").agg(
        F.min(F.when(F.col("near"), F.col("fp"))).alias("hub"), F.min("fp").alias("least"),
        F.max("fp").alias("most")).filter(F.col("hub").isNotNull()
                                          & (F.col("least") != F.col("most"))).select(
        "point", "hub")
    return points.join(hubs.hint("merge"), "point").filter(F.col("fp") != F.col("hub")).select(
        F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b"))


def _labelled(rows: DataFrame, distance: int, segments: int, crowd: int) -> DataFrame:
    """Adds ``component`` (the least id reachable) to written rows (id, fp)."""
    entries = rows.groupBy("fp").agg(F.min("id").alias("least"))
    found = components(links(entries.select("fp"), distance, segments, crowd))
    found = found.withColumnRenamed("node", "fp")
    least = written(found.join(entries.hint("merge"), "fp").groupBy("component").agg(
        F.min("least").alias("reached")))
    reached = attach(found, least, "component").select("fp", "reached")
    labels = entries.join(reached.hint("merge"), "fp", "left").select(
        "fp", F.coalesce("reached", "least").alias("component"))
    return attach(rows, written(labels), "fp")


def near_classes(docs: DataFrame, shingle: int = 3, distance: int = 3,
                 segments: int = SEGMENTS, crowd: int = CROWD, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per row: id, fingerprint (16 hex digits), component_id.

    Two documents are linked when their fingerprints differ in at most ``distance`` bits;
    ``component_id`` is the least id reachable over links.  Null text counts as empty; empty
    and blank texts share fingerprint zero and are linked like any other.  A null id never
    becomes a component's id unless all ids of the component are null.  Repeated
    rows stay repeated.  An empty table gives no rows.
    """
    rows = written(fingerprints(docs, shingle, id_col, text_col))
    return _labelled(rows, distance, segments, crowd).select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), BITS // 4, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"))


def near_dedup(docs: DataFrame, shingle: int = 3, distance: int = 3,
               segments: int = SEGMENTS, crowd: int = CROWD, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """One row of each component stays with all its columns: the one of least id.

    Rows of one id are told apart by their text; rows equal in both leave one.
    Other cases as in ``near_classes``.
    """
    body = text_of(text_col)
    marks = [F.xxhash64(F.col(id_col), body).alias("m1"), F.xxhash64(body, F.col(id_col)).alias("m2")]
    keyed = docs.select(F.struct(F.col(id_col).isNull().alias("missing"),
                                 F.col(id_col).alias("own"), *marks).alias("key"),
                        body.alias("body"))
    rows = written(fingerprints(keyed, shingle, "key", "body"))
    stay = (_labelled(rows, distance, segments, crowd)
            .filter(F.col("id") == F.col("component")).select("id.m1", "id.m2").distinct())
    one = Window.partitionBy("m1", "m2").orderBy("tie")
    return (docs.select(whole_row(docs.columns).alias("row"), *marks)
            .withColumn("tie", F.xxhash64(F.to_json("row")))
            .join(stay.hint("merge"), ["m1", "m2"], "left_semi")
            .withColumn("place", F.row_number().over(one)).filter("place = 1").select("row.*"))

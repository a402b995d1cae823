"""Nearest vectors by largest inner product: inverted lists with an adaptive dimension scan.

An extra component makes all vectors equally long, which turns the largest inner product into
the least distance, and a random rotation spreads every distance evenly over the
dimensions.  Vectors lie in the list of their nearest centre, in blocks of columns.  A
query visits the lists nearest to it; there, after each block of columns, a hypothesis test
on the partial distance abandons the candidates that are most unlikely to come below
the query's bound.  What is left is measured exactly, on the original vectors.

The bound is the distance of the k-th nearest among a sample that every task holds, with one row
per id as ids count once in the result, so it is a true upper bound from the start.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dossier.llm.common import written

MAX_SAMPLE, PER_LIST, MAX_LISTS = 131_072, 32, 4096
COLUMNS, CONFIDENCE, COVERED, TRIED = 16, 2.1, 0.97, 512
VECTORS, QUERIES = 1024, 256
STEPS = 10


@dataclass
class Index:
    """What every task holds: of bounded size, whatever the table."""
    length: float           # the greatest norm
    rotation: np.ndarray
    centres: np.ndarray     # rotated
    sample_ids: np.ndarray
    sample: np.ndarray      # original
    probes: int

    def rotated(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """Equal-length form, rotated; a query's extra component is zero."""
        square = (vectors.astype(float) ** 2).sum(axis=1)
        extra = np.zeros(len(vectors)) if query else np.sqrt(
            np.maximum(self.length ** 2 - square, 0))
        return np.column_stack((vectors, extra)) @ self.rotation


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, and all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)
                      & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _matrix(lists: pa.ListArray, dims: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, summed in the order of the components; what
    a sum rounds away is carried along (Neumaier) and added last, as Python's ``sum`` does."""
    out, lost = np.zeros(len(a)), np.zeros(len(a))
    with np.errstate(invalid="ignore"):
        for k in range(a.shape[1]):
            x = a[:, k].astype(float) * b[:, k].astype(float)
            total = out + x
            lost += np.where(np.abs(out) >= np.abs(x), (out - total) + x, (x - total) + out)
            out = total
        return np.where(np.isfinite(lost), out + lost, out)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0)


def _centres(points: np.ndarray, lists: int) -> np.ndarray:
    centres = points[:: max(len(points) // lists, 1)][:lists].copy()
    for _ in range(STEPS):
        near = _nearest(points, centres)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        held = counts > 0
        centres[held] = sums[held] / counts[held, None]
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres ** 2).sum(axis=1) / 2
    return np.concatenate([np.argmax(points[at:at + 4096] @ centres.T - half, axis=1)
                           for at in range(0, len(points), 4096)])


def build(vectors: DataFrame, k: int, dims: int, covered: float = COVERED) -> Index:
    """Centres and probe count from a sample of at most MAX_SAMPLE vectors, one per id.

    ``vectors``: (id, vec) of usable vectors.  The number of lists grows with the root of the
    table up to MAX_LISTS.  The probe count is the least that finds ``covered`` of the
    true neighbours among the sample itself; the whole table's neighbours lie nearer.
    """
    size, longest = vectors.agg(F.count(F.lit(1)), F.max(F.aggregate(
        "vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).first()
    lists = max(1, min(MAX_LISTS, round(size ** 0.5)))
    drawn = (vectors.select("id", F.xxhash64(F.lit("sample"), "id").alias("rank")).distinct()
             .orderBy("rank", "id").limit(min(MAX_SAMPLE, lists * PER_LIST)).select("id"))
    rows = (vectors.join(F.broadcast(drawn), "id", "left_semi").groupBy("id")
            .agg(F.min("vec").alias("vec")).orderBy(F.xxhash64(F.lit("sample"), "id"), "id")
            .toArrow().combine_chunks())
    ids = rows.column("id").to_numpy()
    sample = _matrix(rows.column("vec").combine_chunks(), dims)     # in the column's own type
    turn, _ = np.linalg.qr(np.random.default_rng(3).standard_normal((dims + 1, dims + 1)))
    index = Index(float(longest or 0) ** 0.5, turn, np.zeros((1, dims + 1)), ids, sample, 1)
    points = index.rotated(sample, False)
    if not len(points):
        return index
    index.centres = _centres(points, lists)
    home = _nearest(points, index.centres)
    asked = index.rotated(sample[:TRIED], True)
    gaps = _squares(asked, points)
    gaps[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    true = np.argsort(gaps, axis=1)[:, :min(k, max(len(points) - 1, 1))]
    order = np.argsort(_squares(asked, index.centres), axis=1)
    place = np.argsort(order, axis=1)
    ranks = np.take_along_axis(place, home[true], axis=1)
    index.probes = min(len(index.centres), int(np.quantile(ranks, covered)) + 1)
    return index


def _blocks(rows: DataFrame, per: int) -> DataFrame:
    """Rows (list, uid, id, vec, ...) gathered into blocks of about ``per`` by a hash, so
    a list of any length is cut into bounded pieces."""
    counts = rows.groupBy("list").agg(F.count(F.lit(1)).alias("n"))    # at most MAX_LISTS rows
    block = F.pmod(F.xxhash64("uid"), F.ceil(F.col("n") / per))
    own = [c for c in rows.columns if c not in ("list", "uid")]
    return (rows.join(F.broadcast(counts), "list").groupBy("list", block.alias("block"))
            .agg(F.collect_list(F.struct(*own)).alias("members")).drop("block"))


def scan(queries: np.ndarray, vectors: np.ndarray, bounds: np.ndarray,
         confidence: float = CONFIDENCE, width: int = COLUMNS) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) pairs that no test abandons; ``bounds`` are squared distances."""
    dims = queries.shape[1]
    first = slice(0, min(width, dims))
    part = _squares(queries[:, first], vectors[:, first])

    def limit(seen: int):
        if seen >= dims:
            return bounds * (1 + 1e-9) + 1e-12
        return bounds * seen / dims * (1 + confidence / seen ** 0.5) ** 2

    q, v = np.nonzero(part <= limit(first.stop)[:, None])
    part = part[q, v]
    for at in range(width, dims, width):
        block = slice(at, min(at + width, dims))
        part = part + ((queries[q, block] - vectors[v, block]) ** 2).sum(axis=1)
        held = part <= limit(block.stop)[q]
        q, v, part = q[held], v[held], part[held]
    return q, v


def nearest(table: DataFrame, is_query: Column, k: int = 20, covered: float = COVERED,
            id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): up to ``k`` candidates per query, nearest first.

    Candidates are all rows with another id; the score is the inner product in double
    precision; ties go to the smaller id.  Null, zero and non-finite vectors, null ids and
    vectors that are not as long as most take no part.  Rows that repeat an id
    count once, with their best score.
    """
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"),
                        F.coalesce(is_query, F.lit(False)).alias("asks")).filter(
        F.col("id").isNotNull() & usable(F.col("vec")))
    common = (rows.groupBy(F.size("vec").alias("dims")).agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.desc("n"), "dims").first())
    dims = common.dims if common else 1
    rows = rows.filter(F.size("vec") == dims)
    index = build(rows.select("id", "vec"), k, dims, covered)
    sent = table.sparkSession.sparkContext.broadcast(index)

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                points = sent.value.rotated(_matrix(batch.column("vec"), dims), False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_nearest(points, sent.value.centres).astype(np.int32)),
                     *batch.columns], ["list", *batch.schema.names])

    def visit(batches):
        """The lists of a query with its bound, and the sample's best as first finds."""
        held = sent.value
        known = held.rotated(held.sample, False)
        for whole in batches:
            for at in range(0, whole.num_rows, QUERIES):
                batch = whole.slice(at, QUERIES)
                vectors, own = _matrix(batch.column("vec"), dims), batch.column("id").to_numpy()
                points = held.rotated(vectors, True)
                gaps = _squares(points, known)
                gaps[own[:, None] == held.sample_ids] = np.inf
                kept = min(k, gaps.shape[1])
                first = np.argpartition(gaps, kept - 1, axis=1)[:, :kept]
                bound = np.take_along_axis(gaps, first, axis=1).max(axis=1)
                if kept < k:
                    bound[:] = np.inf
                lists = np.argsort(_squares(points, held.centres), axis=1)[:, :held.probes]
                row = np.repeat(np.arange(len(own)), lists.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists.ravel().astype(np.int32)), batch.column("uid").take(row),
                     batch.column("id").take(row), batch.column("vec").take(row),
                     pa.array(bound[row])], ["list", "uid", "id", "vec", "bound"])

    def first_finds(batches):
        held = sent.value
        known = held.rotated(held.sample, False)
        for whole in batches:
            for at in range(0, whole.num_rows, QUERIES):
                batch = whole.slice(at, QUERIES)
                vectors, own = _matrix(batch.column("vec"), dims), batch.column("id").to_numpy()
                gaps = _squares(held.rotated(vectors, True), known)
                gaps[own[:, None] == held.sample_ids] = np.inf
                kept = min(k, gaps.shape[1])
                row = np.repeat(np.arange(len(own)), kept)
                found = np.argpartition(gaps, kept - 1, axis=1)[:, :kept].ravel()
                real = np.isfinite(gaps[row, found])
                row, found = row[real], found[real]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[row]), pa.array(held.sample_ids[found]),
                     pa.array(_products(vectors[row], held.sample[found]))],
                    ["query_id", "id", "score"])

    def compare(batches):
        held = sent.value
        for batch in batches:
            for members, asked in zip(batch.column("members"), batch.column("asked")):
                vectors, asked = members.values, asked.values
                original, wanted = (_matrix(x.field("vec"), dims) for x in (vectors, asked))
                ids, own = vectors.field("id").to_numpy(), asked.field("id").to_numpy()
                q, v = scan(held.rotated(wanted, True), held.rotated(original, False),
                            asked.field("bound").to_numpy())
                other = own[q] != ids[v]
                q, v = q[other], v[other]
                score = _products(wanted[q], original[v])
                best = np.lexsort((ids[v], -score, q))
                q, v, score = q[best], v[best], score[best]
                # of a block, a query needs its k best rows for each time an id may repeat
                same = np.concatenate(([True], np.diff(q) != 0))[:len(q)]
                rank = np.arange(len(q)) - np.maximum.accumulate(
                    np.where(same, np.arange(len(q)), 0))
                repeats = 1 + np.bincount(np.unique(ids, return_inverse=True)[1]).max()
                keep = rank < k * repeats
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[q[keep]]), pa.array(ids[v[keep]]), pa.array(score[keep])],
                    ["query_id", "id", "score"])

    kind = rows.schema["vec"].dataType.simpleString()
    uid = F.monotonically_increasing_id().alias("uid")
    found = "query_id long, id long, score double"
    lists = _blocks(rows.select(uid, "id", "vec").mapInArrow(
        place, f"list int, uid long, id long, vec {kind}"), VECTORS)
    asking = rows.filter("asks").select(uid, "id", "vec")
    visits = _blocks(asking.mapInArrow(
        visit, f"list int, uid long, id long, vec {kind}, bound double"), QUERIES)
    pairs = lists.join(visits.withColumnRenamed("members", "asked"), "list")
    finds = written(pairs.select("members", "asked").mapInArrow(compare, found).unionByName(
        asking.mapInArrow(first_finds, found)))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (finds.groupBy("query_id", "id").agg(F.max("score").alias("score"))
            .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias(id_col), "score"))

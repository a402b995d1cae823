"""Hard negatives by anchor-clustered shared lists.

Vectors are quantised to integers, so scores are exact inner products.  Directions are
clustered; the anchors of one cluster share a list of candidates, sorted once by an upper bound of
their score: a candidate of length r at angle t from the cluster's middle, whose members lie
within angle w of it, scores at most r cos(max(0, t - w)) times a member's own length.  Every
member walks the list until no later candidate can reach what it still needs: then its result is
certified.

The same search runs twice: for an anchor's positives (same label, the best few), then for
the negatives of each positive (other labels, the best few in a band below the positive's
score).  Candidates lie in regions around the clusters' centres, cut into blocks of bounded size;
a region that the bound rules out for an anchor is not visited.  A sample that every task holds
gives each search a true lower bound from the start; nothing else depends on it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dossier.llm.common import written

SCALE = 256
LONGEST = 2.0 ** 60         # squared length of a quantised vector: scores stay 64-bit integers
EXACT_FLOAT = 2 ** 52       # below it, float products of integers are exact
SAMPLE, REGION, MAX_REGIONS, STEPS = 4096, 8192, 4096, 10
BLOCK, ANCHORS, STRIP = 16_384, 8192, 512
SLACK, NEVER = 1e-6, 2 ** 62


@dataclass
class Index:
    """What every task holds: of bounded size, whatever the table."""
    centres: np.ndarray         # unit directions, one per region
    ids: np.ndarray             # the sample
    labels: np.ndarray
    vectors: np.ndarray
    exact: bool                 # whether float products are exact
    radius: np.ndarray | None = None    # of every region: greatest angle from its centre,
    length: np.ndarray | None = None    # greatest length,
    chunks: np.ndarray | None = None    # and number of blocks


def units(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions and lengths; a zero vector has direction zero."""
    vectors = vectors.astype(float)
    length = np.sqrt((vectors ** 2).sum(axis=1))
    return vectors / np.where(length == 0, 1, length)[:, None], length


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


def reach(angle: np.ndarray, width, length) -> np.ndarray:
    """Upper bound of the score with a unit vector within ``width`` of the angle's origin."""
    return length * np.cos(np.maximum(angle - width - SLACK, 0)) * (1 + 1e-9) + 1e-6


def products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products of all rows of ``a`` with all rows of ``b``."""
    if exact:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _best(anchor, row, score, ids, k: int):
    """The ``k`` best of every anchor, by score and then the smaller id."""
    order = np.lexsort((ids[row], -score, anchor))
    anchor, row, score = anchor[order], row[order], score[order]
    first = np.searchsorted(anchor, anchor)
    kept = np.arange(len(anchor)) - first < k
    return anchor[kept], row[kept], score[kept]


def walk(members: np.ndarray, own: np.ndarray, mine: np.ndarray, low: np.ndarray,
         high: np.ndarray, vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray, same: bool,
         k: int, exact: bool, strip: int = STRIP):
    """(member, band, row, score): the ``k`` best rows of every member's bands, and how many
    products that took.

    ``low`` and ``high`` (member, band): bounds of the scores that count; ``low`` may
    already be raised to a score that ``k`` rows are known to reach.
    """
    unit, length = units(members)
    middle, _ = units(unit.sum(axis=0)[None])
    width = angles(unit, middle).max()
    directions, lengths = units(vectors)
    limit = reach(angles(directions, middle)[:, 0], width, lengths)
    order = np.argsort(-limit, kind="stable")           # the shared list
    low, spent = low.copy(), 0
    found = [(np.zeros(0, np.int64),) * 3 for _ in range(low.shape[1])]
    for at in range(0, len(order), strip):
        rows = order[at:at + strip]
        open_ = (low <= high) & ((limit[rows[0]] * length + 1e-6)[:, None] >= low)
        active = np.flatnonzero(open_.any(axis=1))
        if not len(active):
            break                                       # all members are certified
        score = products(members[active], vectors[rows], exact)
        spent += score.size
        fits = ((mine[active][:, None] == labels[rows]) == same) & (own[active][:, None] != ids[rows])
        for band in range(low.shape[1]):
            a, r = np.nonzero(fits & (score >= low[active, band][:, None])
                              & (score <= high[active, band][:, None]))
            if not len(a):
                continue
            found[band] = _best(*(np.concatenate(x) for x in zip(
                found[band], (active[a], rows[r], score[a, r]))), ids, k)
            who, _, reached = found[band]
            last = np.flatnonzero(np.arange(len(who)) - np.searchsorted(who, who) == k - 1)
            low[who[last], band] = np.maximum(low[who[last], band], reached[last])
    member, row, score = (np.concatenate(x) for x in zip(*found))
    band = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
    return member, band, row, score, spent


def _vectors(column, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dims)


def _lists(column, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(-1, width)


def _quantised(table: DataFrame, is_anchor: Column, id_col: str, vec_col: str, label_col: str,
               ) -> tuple[DataFrame, int]:
    """Written rows (id, label, vec, asks), one per id, and the vectors' size."""
    vec = F.col(vec_col)
    whole = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                     & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = table.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
        F.transform(vec, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("double")
                    ).alias("vec"),
        F.coalesce(is_anchor, F.lit(False)).alias("asks"), whole.alias("whole")).filter(
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("whole"))
    rows = rows.filter(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x) <= LONGEST)
    common = (rows.groupBy(F.size("vec").alias("dims")).agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.desc("n"), "dims").first())
    dims = common.dims if common else 1

    def pack(batches):
        for batch in batches:
            flat = batch.column("vec").flatten().to_numpy().astype("<i4").reshape(-1, dims)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"),
                 pa.array([v.tobytes() for v in flat], pa.binary()), batch.column("asks")],
                ["id", "label", "vec", "asks"])

    packed = rows.filter(F.size("vec") == max(dims, 1)).select("id", "label", "vec", "asks").mapInArrow(
        pack, "id long, label string, vec binary, asks boolean")
    one = packed.groupBy("id").agg(F.min(F.struct("label", "vec")).alias("row"),
                                   F.max("asks").alias("asks"))
    return written(one.select("id", "row.label", "row.vec", "asks")), max(dims, 1)


def build(rows: DataFrame, dims: int, region: int = REGION) -> Index:
    """Centres of directions from a sample of at most SAMPLE rows; about ``region`` rows each."""
    size = rows.count()
    drawn = (rows.select("id", F.xxhash64(F.lit("sample"), "id").alias("rank"))
             .orderBy("rank", "id").limit(SAMPLE).select("id"))
    held = (rows.join(F.broadcast(drawn), "id", "left_semi").select("id", "label", "vec")
            .orderBy("id").toArrow())
    vectors = _vectors(held.column("vec"), dims)
    unit, _ = units(vectors)
    centres = unit[::max(1, len(unit) // max(1, min(MAX_REGIONS, round(size / region))))]
    for _ in range(STEPS if len(centres) > 1 else 0):
        near = np.argmax(unit @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, unit)
        moved, length = units(sums)
        centres = np.where(length[:, None] > 0, moved, centres)
    if not len(centres):
        centres = np.zeros((1, dims))
    return Index(centres, held.column("id").to_numpy(), np.array(
        held.column("label").to_pylist(), object), vectors, False)


def _placed(rows: DataFrame, index: Index, dims: int, block: int) -> DataFrame:
    """Written rows with their region; completes the index."""
    sent = rows.sparkSession.sparkContext.broadcast(index.centres)

    def run(batches):
        for batch in batches:
            unit, length = units(_vectors(batch.column("vec"), dims))
            region = np.argmax(unit @ sent.value.T, axis=1) if len(unit) else np.zeros(0, int)
            turn = np.arccos(np.clip((unit * sent.value[region]).sum(axis=1), -1, 1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(region.astype(np.int32)), pa.array(turn),
                 pa.array(length)], [*batch.schema.names, "region", "angle", "length"])

    placed = written(rows.mapInArrow(
        run, "id long, label string, vec binary, asks boolean, region int, angle double, "
             "length double"))
    n = len(index.centres)
    index.radius, index.length = np.zeros(n), np.full(n, -1.0)
    index.chunks = np.zeros(n, np.int64)
    for r in placed.groupBy("region").agg(         # at most MAX_REGIONS rows
            F.max("angle").alias("angle"), F.max("length").alias("length"),
            F.count(F.lit(1)).alias("n")).collect():
        index.radius[r.region], index.length[r.region] = r.angle, r.length
        index.chunks[r.region] = -(-r.n // block)
    index.exact = bool(index.length.max(initial=0) ** 2 < EXACT_FLOAT)
    return placed.drop("angle", "length")


def search(anchors: DataFrame, placed: DataFrame, index: Index, dims: int, bands: int, same: bool,
           k: int, batch_size: int = ANCHORS, block: int = BLOCK) -> DataFrame:
    """(anchor_id, band, id, score): per anchor, band and block of candidates the ``k`` best of
    the block, of which the ``k`` best of all blocks are the band's result.

    ``anchors``: (id, label, vec, region, low, high) with ``bands`` bounds each; a band with
    low > high is empty.  Candidates have the anchor's label when ``same``, else another.
    """
    spark = anchors.sparkSession
    sizes = {r.region: r.n for r in anchors.groupBy("region").agg(
        F.count(F.lit(1)).alias("n")).collect()}        # at most MAX_REGIONS rows
    begin, upto = np.zeros(len(index.centres), np.int64), 0
    for region in sorted(sizes):
        begin[region], upto = upto, upto + sizes[region]
    sent = spark.sparkContext.broadcast((index, begin, sizes))

    def visit(batches):
        """An anchor's rows: the blocks of every region that may hold one of its results."""
        held, begin, sizes = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                members, ids = _vectors(batch.column("vec"), dims), batch.column("id").to_numpy()
                low, high = (batch.column(c).flatten().to_numpy().reshape(-1, bands).copy()
                             for c in ("low", "high"))
                score = products(members, held.vectors, held.exact)
                mine = np.array(batch.column("label").to_pylist(), object)
                fits = ((mine[:, None] == held.labels) == same) & (ids[:, None] != held.ids)
                if score.shape[1] >= k:
                    for band in range(bands):
                        known = np.where(fits & (score >= low[:, band:band + 1])
                                         & (score <= high[:, band:band + 1]), score, -NEVER)
                        kth = -np.partition(-known, k - 1, axis=1)[:, k - 1]
                        low[:, band] = np.maximum(low[:, band], kth)
                unit, length = units(members)
                most = length[:, None] * reach(angles(unit, held.centres), held.radius,
                                               np.maximum(held.length, 0)) + 1e-6
                needed = np.where(low <= high, low, NEVER).min(axis=1)
                goes = (most >= needed[:, None]) & (held.chunks > 0)
                row, region = np.nonzero(goes)
                times = held.chunks[region]
                row, region = np.repeat(row, times), np.repeat(region, times)
                chunk = np.concatenate([np.arange(t) for t in times] or [np.zeros(0, np.int64)])
                home = batch.column("region").to_numpy()
                shelf = (begin[home] + ids % np.array([sizes[h] for h in home], np.int64)
                         ) // batch_size
                yield pa.RecordBatch.from_arrays(
                    [pa.array(region.astype(np.int32)), pa.array(chunk.astype(np.int32)),
                     pa.array(shelf[row]), *(batch.column(c).take(pa.array(row))
                                             for c in ("id", "label", "vec", "region", "high")),
                     pa.ListArray.from_arrays(
                         pa.array(np.arange(len(row) + 1) * bands, pa.int32()),
                         pa.array(low[row].ravel()))],
                    ["at", "chunk", "shelf", "id", "label", "vec", "home", "high", "low"])

    visits = written(anchors.select("id", "label", "vec", "region", "low", "high").mapInArrow(
        visit, "at int, chunk int, shelf long, id long, label string, vec binary, home int, "
               "high array<long>, low array<long>"))
    chunks = F.broadcast(spark.createDataFrame(
        [(int(r), int(n)) for r, n in enumerate(index.chunks)], "at int, chunks long"))
    part = F.col("label") if same else F.lit("")        # positives meet rows of their label only
    keys = ["part", "at", "chunk", "shelf"]
    wanted = visits.select(part.alias("part"), *[F.col(c).alias(c) for c in keys[1:]]).distinct()
    blocks = (placed.withColumnRenamed("region", "at").join(chunks, "at").select(
        part.alias("part"), "at", F.pmod(F.xxhash64("id"), "chunks").cast("int").alias("chunk"),
        "id", "label", "vec").join(wanted, ["part", "at", "chunk"]))
    exact = index.exact

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [pa.table({"anchor_id": pa.array([], pa.int64()), "band": pa.array([], pa.int32()),
                         "id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})]
        if left.num_rows and right.num_rows:
            vectors, ids = _vectors(left.column("vec"), dims), left.column("id").to_numpy()
            members, own = _vectors(right.column("vec"), dims), right.column("id").to_numpy()
            low, high = _lists(right.column("low"), bands), _lists(right.column("high"), bands)
            names = pa.concat_arrays([c for t in (left, right) for c in t.column("label").chunks]
                                     ).dictionary_encode().indices.to_numpy()
            labels, mine = names[:len(ids)], names[len(ids):]
            home = right.column("home").to_numpy()
            for cluster in np.unique(home):
                at = np.flatnonzero(home == cluster)
                member, band, row, score, _ = walk(
                    members[at], own[at], mine[at], low[at], high[at], vectors, ids, labels, same,
                    k, exact)
                out.append(pa.table({
                    "anchor_id": own[at][member], "band": band.astype(np.int32),
                    "id": ids[row], "score": score}))
        return pa.concat_tables(out)

    return (blocks.groupBy(*keys).cogroup(visits.withColumn("part", part).groupBy(*keys))
            .applyInArrow(compare, "anchor_id long, band int, id long, score long"))


def mine(table: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3,
         low: int = 50, high: int = 95, id_col: str = "vec_id", vec_col: str = "embedding",
         label_col: str = "label", region: int = REGION, block: int = BLOCK,
         batch_size: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components are quantised to floor(256 x); a score is the integer inner product with the anchor.
    An anchor's positives are its best ``positives`` rows of the same label; a positive's negatives
    are the best ``negatives`` rows of other labels whose score n against its score p has
    low p <= 100 n <= high p.  Ties go to the smaller id.

    Rows with a null id, label or vector or a null or non-finite component take no part,
    nor do vectors that are not as long as most, or so large that a score could pass 64 bits (a
    squared length over 2^60).  Zero vectors score 0.  Rows that repeat an id count once,
    with the least (label as text, vector).  An empty table, or one without anchors, gives no
    rows; anchors without positives or negatives give none.  Other columns take no part,
    whatever their names.
    """
    rows, dims = _quantised(table, is_anchor, id_col, vec_col, label_col)
    index = build(rows, dims, region)
    placed = _placed(rows, index, dims, block)
    anchors = placed.filter("asks").drop("asks")
    candidates = placed.drop("asks")
    best = Window.partitionBy("anchor_id", "band").orderBy(F.desc("score"), "id")

    def firsts(found: DataFrame, k: int) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    open_ = anchors.withColumn("low", F.array(F.lit(-NEVER).cast("long"))).withColumn(
        "high", F.array(F.lit(NEVER).cast("long")))
    near = written(firsts(search(open_, candidates, index, dims, 1, True, positives, batch_size,
                                 block), positives))
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    band = near.select(
        F.col("anchor_id").alias("id"), "rank",
        F.ceil(exact("score") * F.lit(low) / F.lit(100)).cast("long").alias("low"),
        F.floor(exact("score") * F.lit(high) / F.lit(100)).cast("long").alias("high"))
    blank = F.lit(None).cast("long")

    def filled(column: str, empty: int):
        slots = F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda i: F.try_element_at("held", i))
        return F.transform(slots, lambda x: F.coalesce(x[column], blank, F.lit(empty).cast("long")))

    banded = band.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct(
        "rank", F.struct("low", "high")))).alias("held")).select(
        "id", filled("low", NEVER).alias("low"), filled("high", -NEVER).alias("high"))
    asking = written(anchors.join(banded, "id"))
    hard = firsts(search(asking, candidates, index, dims, positives, False, negatives, batch_size,
                         block), negatives)
    return hard.join(near.select(
        "anchor_id", (F.col("rank") - 1).alias("band"), F.col("id").alias("positive_id"),
        F.col("score").alias("positive_score")), ["anchor_id", "band"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))

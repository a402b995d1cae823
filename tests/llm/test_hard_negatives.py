"""Hard negatives against brute force; the shared list's bound."""

import math
import random

import numpy as np
import pytest
from dossier.llm import hard_negatives
from pyspark.sql import functions as F


def by_hand(rows, positives=5, negatives=3):
    best = {}
    for i, vec, label in rows:
        if (i is None or label is None or vec is None
                or any(x is None or not math.isfinite(x) for x in vec)):
            continue
        v = tuple(math.floor(256 * x) for x in vec)
        if sum(x * x for x in v) <= 2 ** 60:
            key = str(label), b"".join(x.to_bytes(4, "little", signed=True) for x in v), v
            best[i] = min(best.get(i, key), key)
    sizes = sorted(len(v) for _, _, v in best.values())
    if not sizes:
        return []
    dims = max(set(sizes), key=lambda n: (sizes.count(n), -n))
    held = {i: (label, v) for i, (label, _, v) in best.items() if len(v) == dims}
    out = []
    for a, (label, v) in held.items():
        if a % 50:
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w)), i, other == label)
                        for i, (other, w) in held.items() if i != a)
        for p, i, _ in [s for s in scores if s[2]][:positives]:
            band = [(n, j) for n, j, same in scores
                    if not same and 50 * -p <= 100 * -n <= 95 * -p][:negatives]
            out += [(a, i, rank, j, -p, -n) for rank, (n, j) in enumerate(band, 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score",
        "negative_score").collect())


def frame(spark, rows, kind="double"):
    rows = [(i, v and [x if x is None else float(x) for x in v], n) for i, v, n in rows]
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")


def vectors(seed, size=500, dims=12, labels=4, groups=6):
    chance = random.Random(seed)
    middles = [[chance.gauss(0, 1) for _ in range(dims)] for _ in range(groups)]
    return [(k, [m + chance.gauss(0, 0.4) for m in middles[k % groups]], chance.randrange(labels))
            for k in range(size)]


def asks():
    return F.col("vec_id") % 50 == 0


@pytest.mark.parametrize("sizes", [{}, {"region": 40, "block": 30, "batch_size": 3}])
def test_equal_to_brute_force(spark, sizes):
    rows = vectors(1)
    assert got(hard_negatives.mine(frame(spark, rows), asks(), **sizes)) == by_hand(rows)


def test_odd_rows_ties_and_clashing_columns(spark):
    rows = vectors(2, 200, 5)
    for at, change in [(7, None), (9, [1.0, None, 1, 1, 1]), (11, [math.nan, 1, 1, 1, 1]),
                       (13, [math.inf, 1, 1, 1, 1]), (15, []), (17, [1.0, 2]), (50, [0.0] * 5),
                       (21, [1e12] * 5), (23, [0.0] * 5), (25, [-0.0, 0, 0, 0, 0])]:
        rows[at] = rows[at][0], change, rows[at][2]
    rows[100] = (100, rows[100][1], None)
    rows[30] = (None, *rows[30][1:])
    rows += [(1000 + k, list(rows[0][1]), k % 2) for k in range(60)]    # copies of an anchor
    rows += [rows[3], rows[3], (3, rows[4][1], 2), (0, rows[0][1], rows[0][2])]
    want = by_hand(rows)
    assert len(want) > 30
    docs = frame(spark, rows).selectExpr("*", "1 as id", "'x' as at", "2 as `a.b`", "map(1, 2) as m",
                                         "vec_id as score", "3 as part")
    assert got(hard_negatives.mine(docs, asks(), region=50, block=20)) == want
    assert got(hard_negatives.mine(docs.repartition(7), asks())) == want
    assert got(hard_negatives.mine(docs.limit(0), asks())) == []
    assert got(hard_negatives.mine(docs, F.lit(None).cast("boolean"))) == []
    alone = frame(spark, [(50, [1.0], 1), (100, [0.5], 2)])
    assert got(hard_negatives.mine(alone, asks())) == []


def test_large_components_stay_exact(spark):
    chance = random.Random(3)
    rows = [(k, [chance.choice([-1, 1]) * (2.0 ** 19 + chance.randrange(2 ** 18)) for _ in range(9)],
             k % 3) for k in range(150)]
    want = by_hand(rows)
    assert max(r[4] for r in want) > 2 ** 53
    assert got(hard_negatives.mine(frame(spark, rows), asks())) == want


def test_one_region_holds_most_rows(spark):
    rows = vectors(4, 400, 6, 3, 1) + [(1000 + k, [1.0] * 6, k % 3) for k in range(300)]
    assert got(hard_negatives.mine(frame(spark, rows, "float"), asks(), region=60, block=50)
               ) == by_hand([(i, [float(np.float32(x)) for x in v], n) for i, v, n in rows])


def test_members_stop_when_certified():
    chance = np.random.default_rng(5)
    middles = chance.standard_normal((40, 8))
    rows = (256 * (middles[np.arange(8000) % 40] + 0.05 * chance.standard_normal((8000, 8))))
    rows = np.floor(rows).astype(np.int32)
    members = rows[::400][:20]          # of one cluster
    own, labels = np.arange(0, 8000, 400)[:20], np.zeros(8000, int)
    low, high = np.full((20, 1), -2 ** 62), np.full((20, 1), 2 ** 62)
    member, band, row, score, spent = hard_negatives.walk(
        members, own, np.zeros(20, int), low, high, rows, np.arange(8000), labels, True, 5, True)
    all_scores = members.astype(np.int64) @ rows.T.astype(np.int64)
    for m in range(20):
        others = np.flatnonzero(np.arange(8000) != own[m])
        order = others[np.lexsort((others, -all_scores[m, others]))][:5]
        assert (row[member == m] == order).all() and (score[member == m] == all_scores[m, order]).all()
    assert spent < 20 * 8000 / 2        # the walk ends long before the list does

"""Toxicity, nearest vectors, conversations, the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import odd
from dossier.llm import neighbours, queries, threads, toxicity

SF = "/root/testdata/sf0.001"


def labelled(spark, n: int, seed: int):
    """Texts of which a fifth hold a few bad words, and a third of the others junk."""
    chance, rows = random.Random(seed), []
    for k in range(n):
        words = [chance.choice(odd.WORDS) for _ in range(chance.randint(20, 200))]
        toxic, junk = chance.random() < 0.2, chance.random() < 0.3
        if toxic:
            for _ in range(3):
                words.insert(chance.randrange(len(words)), chance.choice(["vile", "awful", "crude"])
                             + chance.choice(["", "ly", "ness"]))
        if junk:
            words += ["%%%%", "zzzz"] * 5
        rows.append((seed * 10_000 + k, " ".join(words), int(not junk), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")


def test_chain_on_held_out_rows(spark):
    seen, unseen = labelled(spark, 2000, 1), labelled(spark, 300, 2)
    labels, categories = toxicity.categories_of(seen)
    chain = toxicity.train(seen, labels, categories)
    got = toxicity.score(unseen, chain).join(unseen, "doc_id").collect()
    cut = chain.cuts[categories.index("toxic")]
    assert np.mean([(r.p_toxic >= cut) == bool(r.toxic) for r in got]) > 0.98
    assert np.mean([(r.p_low_quality >= chain.cuts[0]) == (not r.quality) for r in got]) > 0.95
    # the third model leans on the second's prediction
    assert chain.models[2].earlier[1] > 0.1
    kept = toxicity.reject(unseen, chain)
    assert kept.columns == unseen.columns
    assert kept.count() == sum(r.p_toxic < cut for r in got)
    again = toxicity.train(seen, labels, categories)
    assert all((a.weights == b.weights).all() for a, b in zip(chain.models, again.models))


def test_chain_without_labels_or_rows(spark):
    docs = odd.table(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels, categories = toxicity.categories_of(none)
    chain = toxicity.train(docs, labels, categories)
    got = toxicity.score(docs, chain).collect()
    assert len(got) == len(odd.rows()) and {r.p_toxic for r in got} == {0.5}
    some = spark.createDataFrame([(1, 1, None), (2, None, 1), (2, 0, 0), (None, 1, 1), (77, 1, 1)],
                                 "doc_id long, quality int, toxic int")
    labels, categories = toxicity.categories_of(some)
    chain = toxicity.train(docs, labels, categories)
    empty = odd.table(spark, empty=True)
    assert toxicity.score(empty, chain).count() == 0 and toxicity.reject(empty, chain).count() == 0
    assert toxicity.reject(docs, chain, threshold=1.1).count() == len(odd.rows())


def test_best_cut_parts_the_classes():
    odds, target = np.array([3.0, 2.0, -1.0, -5.0]), np.array([True, True, False, False])
    assert toxicity.best_cut(odds, target) == pytest.approx(1 / (1 + np.exp(-0.5)))
    assert toxicity.best_cut(odds, np.ones(4, bool)) == 0.5


def neighbours_by_hand(rows, k):
    rows = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v
            and np.isfinite(v).all() and any(v)]
    out = {}
    for i, v in rows:
        if i % 20 == 0:
            best = {}
            for j, w in rows:
                if j != i and len(w) == len(v):
                    best[j] = max(best.get(j, -np.inf), sum(a * b for a, b in zip(v, w)))
            found = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
            out[i] = [j for j, _ in found], [s for _, s in found]
    return out


@pytest.mark.parametrize("n,k", [(900, 20), (7, 20), (300, 5)])
def test_neighbours_against_all(spark, n, k):
    chance = np.random.default_rng(n)
    rows = [(j, (chance.standard_normal(12) * chance.uniform(0.5, 2)).astype(np.float32).tolist())
            for j in range(n)]
    rows += [(1001, None), (1002, [0.0] * 12), (1003, [float("nan")] * 12), (None, [1.0] * 12),
             (1005, [float("inf")] * 12), (1006, [1.0] * 3), (1007, []), (1, rows[1][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in sorted(neighbours.nearest(table, F.col("vec_id") % 20 == 0, k).collect(),
                    key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = neighbours_by_hand([r for r in rows if not r[1] or len(r[1]) == 12], k)
    assert set(got) == set(want)
    found = total = 0
    for q, (ids, scores) in want.items():
        assert [g[0] for g in got[q]] == list(range(1, len(ids) + 1))
        exact = dict(zip(ids, scores))
        assert all(abs(exact[i] - s) < 1e-9 for _, i, s in got[q] if i in exact)
        found, total = found + len({g[1] for g in got[q]} & set(ids)), total + len(ids)
    assert found / total >= 0.9


@pytest.mark.parametrize("hot", [False, True])
def test_neighbours_with_repeated_ids(spark, hot):
    """Every row doubled, or an id that holds a third of the rows."""
    chance = np.random.default_rng(11)
    rows = [(j, chance.standard_normal(12).astype(np.float32).tolist()) for j in range(1000)]
    rows += ([(7, chance.standard_normal(12).astype(np.float32).tolist()) for _ in range(500)]
             if hot else rows)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.nearest(table, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = neighbours_by_hand(rows, 20)
    assert set(got) == set(want) and {len(ids) for ids in got.values()} == {20}
    assert np.mean([len(got[q] & set(ids)) / 20 for q, (ids, _) in want.items()]) >= 0.9
    index = neighbours.build(table.toDF("id", "vec"), 20, 12)
    assert sorted(index.sample_ids.tolist()) == list(range(1000))


def test_scan_keeps_what_is_within_the_bound():
    chance = np.random.default_rng(2)
    q, v = chance.standard_normal((20, 64)), chance.standard_normal((400, 64))
    gaps = ((q[:, None] - v) ** 2).sum(axis=2)
    bounds = np.sort(gaps, axis=1)[:, 10]
    kept = set(zip(*neighbours.scan(q, v, bounds)))
    want = set(zip(*np.nonzero(gaps <= bounds[:, None])))
    assert len(kept & want) / len(want) > 0.95 and len(kept) <= len(want)


def test_neighbours_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.nearest(none, F.col("vec_id") % 20 == 0).count() == 0


MAIL = [
    (1, 0, "user", "Can we meet?\nI am free on Monday."),
    (1, 1, "assistant", "> Can we meet?\n> I am free on Monday.\nYes, at noon."),
    (1, 2, "user", "> > Can we meet?\n> > I am free on Monday.\n>\n> Yes, at NOON.\n\nGood."),
    (1, 3, "other", "> I am  free on Monday.\nSo am I."),
    (1, 4, "other", ">> I am free on Monday.\n> never written\nAh."),
    (1, 5, "user", "No quotation here."),
    (1, 6, "user", "> not in this thread\nHm."),
    (2, 0, "user", "not in this thread"),
    (2, 1, "user", None), (2, 2, None, ""), (2, 2, None, ""), (None, None, "user", "> x"),
]


def test_replies_follow_quotations(spark):
    table = spark.createDataFrame(MAIL, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn, r.role): r for r in threads.conversations(table).collect()}
    assert len(got) == len(MAIL) - 1
    tree = {k[1]: (r.parent, r.root, r.depth) for k, r in got.items() if k[0] == 1}
    assert tree == {0: (None, 0, 0), 1: (0, 0, 1), 2: (1, 0, 2), 3: (0, 0, 1), 4: (0, 0, 1),
                    5: (None, 5, 0), 6: (None, 6, 0)}
    assert got[1, 2, "user"].body == "Good." and got[2, 1, "user"].body == ""
    assert got[1, 2, "user"].formatted == "<|user|>\nGood.\n<|end|>\n"
    none = table.limit(0)
    assert threads.conversations(none).count() == 0


def test_messages_of_one_turn(spark):
    """In some of the threads the message that repeats the words has the smaller uid."""
    rows = [r for k in range(20) for r in [(k, 0, "user", "the same words"), (
        k, 1, "user", "the same words"), (k, 1, "other", "> the same words\nYes.")]]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = threads.conversations(table).filter("role = 'other'").collect()
    assert len(got) == 20 and {(r.parent, r.root, r.depth) for r in got} == {(0, 0, 1)}


def test_long_thread_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(threads, "PLACES", 4)
    rows = [(1, k, "user", (f"> word {k - 1}\n> same words\n" if k else "")
             + f"word {k}\nsame words") for k in range(30)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.turn: (r.parent, r.root, r.depth) for r in threads.conversations(table).collect()}
    assert got == {k: (k - 1 if k else None, 0, k) for k in range(30)}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A data folder whose documents are the awkward rows and some of the given ones."""
    where = tmp_path_factory.mktemp("odd")
    given = spark.read.parquet(f"{SF}/documents.parquet")
    own = odd.table(spark).select("doc_id", "text", F.lit("en").alias("lang"), F.col("id").alias(
        "source"), F.lit(None).cast("long").alias("n_chars"))
    given.unionByName(own).withColumn("row", F.lit(1)).write.parquet(f"{where}/documents.parquet")
    for name in ("labels",):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{where}/{name}.parquet")
    return str(where)


def test_pipeline_on_odd_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, folder))
        assert docs.columns == names
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[2] < counts[1]
    assert counts[4] == counts[3] > 0
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == ids


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(
        f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_and_queries():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "exact_dedup", "simhash", "suffix_array", "packing"]
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))

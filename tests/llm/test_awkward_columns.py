"""Columns with awkward names and types, double vectors, lines that end in a carriage return."""

import numpy as np
import odd
import pytest
from dossier.llm import exact_dedup, lines, neighbours, repeats, simhash, threads, toxicity
from pyspark.sql import functions as F


def awkward(spark):
    return odd.table(spark).selectExpr(
        "*", "row as `a.b`", "map(id, 1) as m", "1 as removed_runs", "array(text) as `b``c`")


@pytest.mark.parametrize("stage", [
    exact_dedup.exact_dedup, simhash.near_dedup, repeats.cut_repeats,
    lambda docs: toxicity.reject(docs, toxicity.train(docs, *toxicity.categories_of(
        docs.sparkSession.createDataFrame([], "doc_id long, quality int, toxic int"))))],
    ids=["exact", "near", "repeats", "toxicity"])
def test_columns_pass_whole(spark, stage):
    docs = awkward(spark)
    got = stage(docs)
    assert got.columns == docs.columns
    for r in got.collect():
        assert r["a.b"] == r.row and r.m == {r.id: 1} and r["removed_runs"] == 1


def test_a_column_of_cut_runs_is_replaced(spark):
    docs = awkward(spark)
    got = lines.cut_runs(docs)
    assert sorted(got.columns) == sorted(docs.columns)
    assert {type(r.removed_runs) for r in got.collect()} == {list}


def test_scores_of_double_vectors_are_exact(spark):
    chance = np.random.default_rng(6)
    rows = [(k, chance.standard_normal(9).tolist()) for k in range(400)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"),
                             F.col("vec_id") % 20 == 0, 5).collect()
    vectors = dict(rows)
    assert len(got) == 100
    assert all(r.score == sum(a * b for a, b in zip(vectors[r.query_id], vectors[r.vec_id]))
               or abs(r.score - np.dot(vectors[r.query_id], vectors[r.vec_id])) < 1e-15 for r in got)


def test_mail_keeps_lines_that_look_like_ends_or_quotes(spark):
    turns = [(1, 0, "a", "hello\rthere friend"), (1, 1, "b", "> not a quote\nmy line"),
             (1, 2, "a", "\\> kept as it is\n  > and this"), (1, 4, "b", "end")]
    mail = threads.as_mail(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    got = {r.turn: r for r in threads.conversations(mail).collect()}
    assert got[1].parent == 0 and got[2].parent is not None
    for _, turn, role, text in turns:
        assert got[turn].formatted == f"<|{role}|>\n{text.strip()}\n<|end|>\n"

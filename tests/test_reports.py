import random

import numpy as np
from pyspark.sql import functions as F

from dossier.operators import profiling, ranking, training


def test_report_of_known_confusion(spark):
    counts = [(0, 0, 358), (0, 1, 24), (0, 2, 4), (1, 0, 56), (1, 1, 194), (1, 2, 9), (2, 0, 4), (2, 1, 4), (2, 2, 147)]
    df = spark.createDataFrame(counts, "y INT, yhat INT, k INT").select(
        "y", "yhat", F.explode(F.sequence(F.lit(1), F.col("k"))))
    report = {r.section: r for r in profiling.classification_report(df, "y", "yhat").collect()}
    assert round(report["0"].precision, 4) == 0.8565 and round(report["0"].recall, 4) == 0.9275
    assert report["2"].support == 155 and round(report["2"].recall, 4) == 0.9484
    assert round(report["macro avg"].recall, 4) == 0.8750
    one = profiling.scores(df, "y", "yhat").first()
    assert one.accuracy == 0.87375 and one.n == 800


def test_exact_quantiles_of_all_columns(spark):
    rnd = random.Random(2)
    values = [rnd.gauss(0, 1) for _ in range(1500)] + [0.25] * 1000 + [float(i % 7) for i in range(500)]
    wide = [rnd.choice([-1, 1]) * 2.0 ** rnd.randint(-1074, 1023) * rnd.choice([1, 1.5]) for _ in range(2998)]
    wide += [0.0, -0.0]
    rows = [(v, w, None, k) for k, (v, w) in enumerate(zip(values, wide))] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "v DOUBLE, w DOUBLE, none DOUBLE, k INT").repartition(5)
    probs = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = profiling.exact_quantiles(df, ["v", "w", "none", "k"], probs)
    assert np.allclose(got["v"], np.quantile(values, probs), rtol=0, atol=1e-12)
    assert got["none"] == [None] * 6 and got["k"] == np.quantile(range(3000), probs).tolist()
    ranked = sorted(w * rnd.choice([1]) for w in wide)
    ranks = [0, 1, 700, 1499, 1500, 2998, 2999]
    found = profiling.order_statistics(df, ["w"], {"w": ranks})["w"]
    assert [found[r] for r in ranks] == [ranked[r] for r in ranks]
    row = profiling.describe(df, ["v"]).first()
    assert np.allclose([row.q25, row.q50, row.q75], got["v"][1:4])
    empty = profiling.describe(df.filter("v is null"), ["v"]).first()
    assert empty.n == 0 and empty.q50 is None


def test_bit_patterns_order_doubles(spark):
    values = [float("-inf"), -1.7976931348623157e308, -2.0, -1.0000000000000002, -1.0, -5e-324, 0.0, 5e-324,
              2.2250738585072014e-308, 2.225073858507201e-308, 0.1, 0.9999999999999999, 1.0, 2.0 ** 52 + 0.5,
              1.7976931348623157e308, float("inf")]
    rows = spark.createDataFrame([(v,) for v in values], "v DOUBLE").select(
        "v", profiling.ordered_bits(F.col("v")).alias("b")).collect()
    assert [r.v for r in sorted(rows, key=lambda r: r.b)] == sorted(values)
    assert all(profiling.double_of(r.b) == r.v for r in rows) and len({r.b for r in rows}) == len(values)


def test_impute_median(spark):
    df = spark.createDataFrame([(1.0, "x"), (None, "2"), (5.0, "4"), (9.0, None)], "a DOUBLE, b STRING")
    out = profiling.numeric_or_median(df, ["a", "b", "c"]).collect()
    assert [r.a for r in out] == [1.0, 5.0, 5.0, 9.0]
    assert [r.b for r in out] == [3.0, 2.0, 4.0, 3.0] and {r.c for r in out} == {0.0}


def test_stratified_split_counts(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(0).alias("label"))
    got = {tuple(r)[:2]: r.n for r in training.stratified_split(df, "label", "id").groupBy(
        "label", "is_train").agg(F.count("*").alias("n")).collect()}
    assert got == {(0, True): 533, (0, False): 133, (1, True): 267, (1, False): 67}
    again = training.stratified_split(df.repartition(7), "label", "id").filter("is_train").select("id")
    assert again.exceptAll(training.stratified_split(df, "label", "id").filter("is_train").select("id")).count() == 0


def test_rank_of_a_hot_job(spark):
    rnd = random.Random(4)
    labels = ["Authentic", "Suspicious", "Potentially Fake", "Not a Resume", None]
    rows = [(i, 0 if i % 3 else i % 11, rnd.choice(labels), rnd.choice([0.0, 0.5, 0.75, None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id INT, job_id INT, classification STRING, final_match_score DOUBLE")
    got = {r.doc_id: r["rank"] for r in ranking.rank_candidates(df.repartition(6)).collect()}
    by_job = {}
    for r in rows:
        by_job.setdefault(r[1], []).append(r)
    order = {n: i for i, n in enumerate(labels)}
    want = {r[0]: k + 1 for rs in by_job.values()
            for k, r in enumerate(sorted(rs, key=lambda r: (order[r[2]], -(r[3] or 0.0), r[0])))}
    assert got == want
    top = {(r.job_id, r.doc_id) for r in ranking.top_per_job(df, 5).collect()}
    assert top == {(r[1], r[0]) for r in rows if want[r[0]] <= 5}
    ordered = [r.doc_id for r in ranking.sort_candidates(df).collect()]
    assert ordered == [r[0] for job in sorted(by_job) for r in sorted(by_job[job], key=lambda r: want[r[0]])]


def test_path_contributions_reach_the_leaf(spark):
    df = spark.range(400).select(
        F.col("id").alias("doc_id"), (F.col("id") % 20).cast("double").alias("a"),
        (F.col("id") % 7).cast("double").alias("b")).withColumn(
        "label", F.when(F.col("a") > 10, 2.0).when(F.col("b") > 3, 1.0).otherwise(0.0))
    model = training.fit_tree(df, ["a", "b"], balanced=False, maxDepth=3)
    out = training.path_contributions(df, model, ["a", "b"]).withColumnRenamed("contributions", "c")
    assert out.count() == 400
    share = out.groupBy("label").count().collect()
    root = {r.label: r["count"] / 400 for r in share}
    from pyspark.ml.functions import vector_to_array
    rows = out.select("prediction", "c", "root_share", vector_to_array("probability").alias("p")).collect()
    for r in rows:
        total = sum(x.contribution for x in r.c)
        assert abs(root[r.prediction] + total - r.p[int(r.prediction)]) < 1e-6
        assert abs(root[r.prediction] - r.root_share) < 1e-9


def test_preview(spark):
    df = spark.createDataFrame([(8.5, ["data engineer"], [], 2018, ["b", "a"])],
                               "y DOUBLE, r ARRAY<STRING>, e ARRAY<STRING>, g INT, s ARRAY<STRING>")
    text = df.select(ranking.preview(*[F.col(c) for c in "yregs"]).alias("v")).first().v
    assert text == ("Experience: ~8.5 years\nPast Roles: Data Engineer\nEducation: Not detected (Class of 2018)"
                    "\n\nTop Skills: a, b")

"""Verdicts, explanations, reviews, ranking and model training."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from dossier.functions import sets
from dossier.functions import text as X
from dossier.functions.numeric import round_exact, share
from dossier.operators import (
    boosting, features, pairing, profiling, ranking, training, trees, verdict)
from dossier.plans import inputs as I
from dossier.plans.catalog import duck as D
from dossier.plans.catalog import query
from dossier.plans.catalog.text import folded
from dossier.session import cut_lineage

# feature rows from order lines: every line gets the four features the rules read
_COLS = {"match": "l_quantity / 50", "generic": "l_discount * 8", "stuffing": "l_tax * 10",
         "density": "l_extendedprice / 10000"}
LINES_SQL = ("WITH lines AS (SELECT l_orderkey AS doc_id, l_suppkey AS job_id, l_linenumber AS line, "
             + ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in _COLS.items())
             + ", l_returnflag = 'R' AS is_resume FROM lineitem)")
_NAMES = {"match": "final_match_score", "generic": "generic_phrase_score",
          "stuffing": "keyword_stuffing_score", "density": "skill_density"}


def lines(spark, d):
    return I.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_suppkey").alias("job_id"),
        F.col("l_linenumber").alias("line"),
        *[F.expr(e).cast("double").alias(_NAMES[n]) for n, e in _COLS.items()],
        (F.col("l_returnflag") == "R").alias("is_resume"))


_KEYS = "doc_id, job_id, line, match, generic, stuffing, density"


def _four():
    return [F.col(n) for n in _NAMES.values()]


def _raw(df):
    return [F.col(v).alias(k) for k, v in _NAMES.items()]


@query("c2_heuristic_probs", f"{LINES_SQL}, {D.probs_ctes('lines')} SELECT {_KEYS}, cls, r0 AS p0, r1 AS p1, r2 AS p2 FROM judged")
def probs(spark, d):
    p = lines(spark, d).withColumn("p", verdict.heuristic_probs(*_four()))
    return p.select("doc_id", "job_id", "line", *_raw(p), F.col("p.cls").alias("cls"),
                    *[round_exact(F.col(f"p.p{i}"), 4).alias(f"p{i}") for i in range(3)])


@query("c3_verdict", f"{LINES_SQL}, {D.probs_ctes('lines')} SELECT {_KEYS}, label AS classification, conf AS confidence FROM judged")
def verdicts(spark, d):
    out = verdict.classify(lines(spark, d))
    return out.select("doc_id", "job_id", "line", *_raw(out), "classification", "confidence")


@query("p2_resume_gate", f"""{LINES_SQL}, {D.probs_ctes('lines')} SELECT {_KEYS}, CASE WHEN is_resume THEN label ELSE 'Not a Resume' END AS classification,
 CASE WHEN is_resume THEN conf ELSE 1e0 END AS confidence, CASE WHEN is_resume THEN r0 ELSE 0e0 END AS prob_0 FROM judged""")
def gate(spark, d):
    out = verdict.classify(lines(spark, d), F.col("is_resume"))
    return out.select("doc_id", "job_id", "line", *_raw(out), "classification", "confidence", "prob_0")


_S = "CASE cls WHEN 2 THEN 1e0 WHEN 1 THEN 5e-1 ELSE 0e0 END"
_CONTRIB = f"""{LINES_SQL}, {D.probs_ctes('lines')},
w AS (SELECT *, {_S} AS s, row_number() OVER () AS rid FROM judged),
x AS (SELECT rid, {_KEYS}, unnest([
  {{'i': 0, 'feature': 'final_match_score', 'value': match, 'c': CASE label WHEN 'Authentic' THEN match * (1e0 - s) WHEN 'Potentially Fake' THEN -match * s ELSE 0e0 END}},
  {{'i': 1, 'feature': 'skill_density', 'value': density, 'c': CASE label WHEN 'Authentic' THEN density * 1e-2 WHEN 'Potentially Fake' THEN -density * 1e-2 ELSE 0e0 END}},
  {{'i': 2, 'feature': 'generic_phrase_score', 'value': generic, 'c': CASE label WHEN 'Authentic' THEN -generic * s WHEN 'Potentially Fake' THEN generic * s ELSE 0e0 END}},
  {{'i': 3, 'feature': 'keyword_stuffing_score', 'value': stuffing, 'c': CASE label WHEN 'Authentic' THEN -stuffing * s WHEN 'Potentially Fake' THEN stuffing * s ELSE 0e0 END}}]) AS t FROM w)"""


@query("c4_contributions", f"{_CONTRIB} SELECT {_KEYS}, t.feature AS feature, {D.round_exact('t.c', 6)} + 0e0 AS contribution FROM x")
def contributions(spark, d):
    out = verdict.classify(lines(spark, d))
    parts = out.select("doc_id", "job_id", "line", *_raw(out), F.inline(
        verdict.heuristic_contributions(F.col("classification"), *_four())))
    return parts.drop("value").withColumn(
        "contribution", round_exact(F.col("contribution"), 6) + F.lit(0.0))


@query("o3_top_features", f"""{_CONTRIB}, r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY abs(t.c) DESC, t.i DESC) AS k FROM x)
SELECT {_KEYS}, k AS place, t.feature AS feature, {D.round_exact('t.value', 4)} AS value, {D.round_exact('t.c', 4)} AS contribution FROM r WHERE k <= 3 AND abs(t.c) > 1e-4""")
def top_features(spark, d):
    out = verdict.classify(lines(spark, d))
    return out.select("doc_id", "job_id", "line", *_raw(out), F.posexplode("top_features").alias("at", "t")).select(
        "doc_id", "job_id", "line", *_NAMES, (F.col("at") + 1).alias("place"), "t.feature", "t.value", "t.contribution")


# reviews: customers disagree with the verdict on some of their orders
@query("c11_apply_reviews", f"""{LINES_SQL}, {D.probs_ctes('lines')},
rv AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderstatus = 'F' THEN 'Disagree' ELSE 'Agree' END AS consensus FROM orders WHERE o_orderstatus <> 'O')
SELECT {_KEYS}, CASE WHEN label <> 'Authentic' AND consensus = 'Disagree' THEN 'Suspicious' ELSE label END AS classification FROM judged LEFT JOIN rv USING (doc_id)""")
def reviewed(spark, d):
    out = verdict.classify(lines(spark, d))
    rv = I.table(spark, d, "orders").filter("o_orderstatus <> 'O'").select(
        F.col("o_orderkey").alias("doc_id"),
        F.when(F.col("o_orderstatus") == "F", "Disagree").otherwise("Agree").alias("consensus"),
        F.col("o_orderpriority").alias("reasoning"))
    done = verdict.apply_reviews(out, rv, keys=("doc_id",))
    return done.select("doc_id", "job_id", "line", *_raw(done), "classification")


@query("c12_c13_first_answer", """WITH a AS (SELECT user_id AS doc_id, CASE event_type WHEN 'error' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS priority,
  CASE WHEN value < 100 THEN value / 100 END AS score FROM events),
g AS (SELECT doc_id, priority, min(score) AS score FROM a WHERE score IS NOT NULL GROUP BY doc_id, priority),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY priority) AS r FROM g)
SELECT o_orderkey AS doc_id, coalesce(score, 5e-1) AS ai_plausibility_score FROM orders LEFT JOIN (SELECT * FROM f WHERE r = 1) f ON f.doc_id = o_orderkey""")
def answers(spark, d):
    a = I.table(spark, d, "events").select(
        F.col("user_id").alias("doc_id"),
        F.expr("case event_type when 'error' then 1 when 'view' then 2 else 3 end").alias("priority"),
        F.expr("case when value < 100 then value / 100 end").alias("score"))
    return verdict.plausibility(
        I.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id")), verdict.first_answer(a))


@query("c1_align_features", """SELECT l_orderkey AS doc_id, l_linenumber AS line, coalesce(CASE WHEN l_discount > 0 THEN l_discount END, 0e0) AS l_discount,
 l_quantity, 0e0 AS final_match_score FROM lineitem""")
def align(spark, d):
    t = I.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line"), "l_quantity",
        F.expr("case when l_discount > 0 then l_discount end").alias("l_discount"))
    return features.align_features(t, ["l_discount", "l_quantity", "final_match_score"], ["doc_id", "line"])


# ------------------------------------------------------------------ ranking
# three statuses hold all orders, so every job here owns a third of the table
_RANK_COLS = ("doc_id", "job_id", "classification", "final_match_score")
_LABEL = ("CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Authentic' WHEN '2' THEN 'Suspicious' "
          "WHEN '3' THEN 'Potentially Fake' WHEN '4' THEN 'Not a Resume' END")
_RANKED = f"""WITH r AS (SELECT o_orderkey AS doc_id, o_orderstatus AS job_id, {_LABEL} AS classification, round(o_totalprice / 500000, 2) AS final_match_score FROM orders),
p AS (SELECT *, CASE classification WHEN 'Authentic' THEN 0 WHEN 'Suspicious' THEN 1 WHEN 'Potentially Fake' THEN 2 WHEN 'Not a Resume' THEN 3 ELSE 4 END AS priority FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY priority, final_match_score DESC, doc_id) AS rank FROM p)"""


def _candidates(spark, d):
    return I.table(spark, d, "orders").selectExpr(
        "o_orderkey AS doc_id", "o_orderstatus AS job_id", f"{_LABEL} AS classification",
        "round(o_totalprice / 500000, 2) AS final_match_score")


@query("o1_rank_candidates", f"{_RANKED} SELECT {', '.join(_RANK_COLS)}, priority, rank FROM o")
def ranked(spark, d):
    return ranking.rank_candidates(_candidates(spark, d))


@query("o1_top_candidates", f"{_RANKED} SELECT {', '.join(_RANK_COLS)}, rank FROM o WHERE rank <= 10")
def top(spark, d):
    return ranking.top_per_job(_candidates(spark, d), 10)


@query("o1_sorted_candidates", f"{_RANKED} SELECT {', '.join(_RANK_COLS)} FROM o")
def ordered(spark, d):
    return ranking.sort_candidates(_candidates(spark, d))


@query("p7_needs_review", f"{_RANKED} SELECT {', '.join(_RANK_COLS)} FROM o WHERE classification IN ('Suspicious', 'Potentially Fake')")
def second_look(spark, d):
    return _candidates(spark, d).filter(verdict.needs_review(F.col("classification")))


# ----------------------------------------------------------------- training
@query("c6_stratified_split", """WITH h AS (SELECT doc_id, quality, ('0x' || substr(md5(doc_id || ':42'), 1, 15))::BIGINT AS h FROM labels),
r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY h) AS k, count(*) OVER (PARTITION BY quality) AS n FROM h)
SELECT doc_id, quality, CAST(k <= floor(n * 8e-1 + 5e-1) AS INT) AS is_train FROM r""")
def split(spark, d):
    return training.stratified_split(
        I.table(spark, d, "labels").select("doc_id", "quality"), "quality", "doc_id").select(
        "doc_id", "quality", F.col("is_train").cast("int").alias("is_train"))


MODEL_FEATURES = ["words", "words_per_line", "n_fragments", "distinct_share", "stuffing", "recall",
                  "achievements", "likeness"]


def labelled(spark, d):
    """Features of the labelled documents against their batch's target."""
    y = I.table(spark, d, "labels").select(
        "doc_id", F.expr("case when quality = 1 then 0 when toxic = 1 then 2 else 1 end").cast("double").alias("label"))
    left = I.documents(spark, d).join(y, "doc_id").withColumn("folded", X.fold(F.col("text"))).select(
        "doc_id", "job_id", "label", X.content_words(folded()).alias("content"), X.tech_tokens(folded()).alias("tokens"),
        X.word_count(folded()).alias("words"), F.coalesce(X.words_per_line(folded()), F.lit(0.0)).alias("words_per_line"),
        F.size(X.fragments(folded())).alias("n_fragments"), X.achievement_count(folded()).alias("achievements"),
        X.resume_likeness(folded()).score.alias("likeness"))
    left = pairing.word_counts(left, "content", "counts")
    right = I.document_targets(spark, d).withColumn("folded", X.fold(F.col("description"))).select(
        "job_id", F.array_distinct(X.content_words(folded())).alias("target"), X.tech_tokens(folded()).alias("target_tokens"))
    return pairing.pair(left, right).select(
        "doc_id", "label", "words", "words_per_line", "n_fragments", "achievements", "likeness",
        share(F.size("counts"), F.size("content")).alias("distinct_share"),
        pairing.keyword_stuffing(F.col("counts"), F.size("content"), F.col("target")).alias("stuffing"),
        sets.token_recall(F.col("tokens"), F.col("target_tokens")).alias("recall"))


_LABELLED: dict = {}


def _split(spark, d):
    """Training and held-out rows; a session's queries share the features written for the first."""
    key = spark.sparkContext.applicationId, d
    if key not in _LABELLED:
        _LABELLED[key] = cut_lineage(labelled(spark, d))
    both = training.stratified_split(_LABELLED[key], "label", "doc_id")
    return both.filter("is_train"), both.filter("not is_train")


# a model has no SQL, but what must hold of its rows does: the held-out rows themselves, and
# identities between a row's probabilities, contributions and verdict
TEST_SQL = f"""WITH {I.DOCUMENTS_SQL}, {I.TARGETS_SQL},
y AS (SELECT doc_id, CAST(CASE WHEN quality = 1 THEN 0 WHEN toxic = 1 THEN 2 ELSE 1 END AS DOUBLE) AS label FROM labels),
a AS (SELECT doc_id, label, ('0x' || substr(md5(doc_id || ':42'), 1, 15))::BIGINT AS h FROM docs JOIN y USING (doc_id) JOIN targets USING (job_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h) AS k, count(*) OVER (PARTITION BY label) AS n FROM a),
test AS (SELECT doc_id, label FROM r WHERE k > floor(n * 8e-1 + 5e-1))"""


def _sum(values):
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def beats_majority(f1: float, rows, least: int = 0) -> int:
    """Whether a weighted F1 is above that of always naming the most frequent label of ``rows``;
    fewer than ``least`` rows are too few to tell and pass."""
    sizes = [r["count"] for r in rows.groupBy("label").count().collect()]
    share = max(sizes) / sum(sizes)
    return int(sum(sizes) < least or f1 > 2 * share * share / (1 + share))


HELD_OUT = 50       # rows from which on a held-out score says something


def _held_out(done):
    return profiling.scores(done, "label", "prediction").first().f1_weighted


# a model that learned nothing (shuffled labels, say) falls below the majority, and a leaf's shares
# are counted again from the training rows that reach it
@query("c7_decision_tree", f"{TEST_SQL} SELECT doc_id, label, 1e0 AS p_sum, 1 AS is_most_probable, 0e0 AS leaf_residual, 1 AS beats_majority FROM test")
def tree(spark, d):
    train, test = _split(spark, d)
    model = training.fit_tree(train, MODEL_FEATURES)
    model.stages[-1].setLeafCol("leaf")
    p = vector_to_array("probability")
    weighed = model.transform(training.balanced_weights(train, "label")).groupBy("leaf").agg(*[
        (F.sum(F.when(F.col("label") == k, F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias(f"s{k}")
        for k in range(3)])
    done = model.transform(test)
    gap = F.greatest(*[F.abs(F.get(p, F.lit(k)) - F.col(f"s{k}")) for k in range(3)])
    return done.join(weighed, "leaf").select(
        "doc_id", "label", F.round(_sum(p), 9).alias("p_sum"),
        (F.get(p, F.col("prediction").cast("int")) == F.array_max(p)).cast("int").alias("is_most_probable"),
        F.round(gap, 9).alias("leaf_residual"),
        F.lit(beats_majority(_held_out(done), test, HELD_OUT)).alias("beats_majority"))


@query("c5_path_contributions", f"{TEST_SQL} SELECT doc_id, label, {len(MODEL_FEATURES)} AS n_features, 0e0 AS residual FROM test")
def paths(spark, d):
    train, test = _split(spark, d)
    model = training.fit_tree(train, MODEL_FEATURES)
    done = training.path_contributions(test, model, MODEL_FEATURES)
    reached = F.col("root_share") + _sum(F.transform("contributions", lambda c: c.contribution))
    leaf = F.get(vector_to_array("probability"), F.col("prediction").cast("int"))
    return done.select("doc_id", "label", F.size("contributions").alias("n_features"),
                       (F.round(reached - leaf, 9) + F.lit(0.0)).alias("residual"))


@query("c5_boosted_contributions", f"""{TEST_SQL} SELECT doc_id, label, cls, {len(MODEL_FEATURES)} AS n_features, 0e0 AS residual FROM test, (VALUES (0), (1), (2)) AS c(cls)""")
def boosted_contributions(spark, d):
    """Shapley values of every class's ensemble: base and contributions are the margin."""
    train, test = _split(spark, d)
    model = training.fit_boosted(train, MODEL_FEATURES)
    scored = model.transform(test).withColumn("cls", F.explode(F.array(*map(F.lit, range(3)))))
    done = trees.shapley_contributions(scored, model, MODEL_FEATURES, "cls")
    reached = F.col("base") + _sum(F.transform("contributions", lambda c: c.contribution))
    margin = F.get(vector_to_array("rawPrediction"), F.col("cls"))
    return done.select("doc_id", "label", "cls", F.size("contributions").alias("n_features"),
                       (F.round(reached - margin, 9) + F.lit(0.0)).alias("residual"))


_TRAIN_SIZE = "(SELECT count(*) FROM r WHERE k <= floor(n * 8e-1 + 5e-1))"


def _points(values) -> str:
    return ", ".join(f"({v})" if not isinstance(v, str) else f"('{v}')" for v in values)


@query("c8_grid_search", f"""{TEST_SQL} SELECT max_depth, min_split, min_leaf, impurity, weights, {_TRAIN_SIZE} AS n_scored, 1 AS in_range, 1 AS best_beats_majority
FROM (VALUES {_points(boosting.TREE_GRID["maxDepth"])}) a(max_depth), (VALUES {_points(boosting.TREE_GRID["minSplit"])}) b(min_split),
 (VALUES {_points(boosting.TREE_GRID["minInstancesPerNode"])}) c(min_leaf), (VALUES {_points(boosting.TREE_GRID["impurity"])}) e(impurity),
 (VALUES {_points(boosting.TREE_GRID["weights"])}) g(weights)""")
def grid(spark, d):
    """All 384 points on all labelled training rows."""
    train, _ = _split(spark, d)
    points, _ = boosting.tree_search(train, MODEL_FEATURES)
    best = beats_majority(max(p["f1"] for p in points), train)
    rows = [(p["maxDepth"], p["minSplit"], p["minInstancesPerNode"], p["impurity"], p["weights"],
             p["n"], p["f1"]) for p in points]
    return spark.createDataFrame(
        rows, "max_depth int, min_split int, min_leaf int, impurity string, weights string, n_scored long, f1 double"
    ).withColumn("in_range", F.col("f1").between(0, 1).cast("int")).withColumn(
        "best_beats_majority", F.lit(best)).drop("f1")


@query("c9_boosted_search", f"""{TEST_SQL} SELECT max_depth, CAST(step AS DOUBLE) AS step, rounds, CAST(share AS DOUBLE) AS share, {_TRAIN_SIZE} AS n_scored, 1 AS beats_majority
FROM (VALUES {_points(boosting.BOOSTED_GRID["maxDepth"])}) a(max_depth), (VALUES {_points(boosting.BOOSTED_GRID["stepSize"])}) b(step),
 (VALUES {_points(boosting.BOOSTED_GRID["maxIter"])}) c(rounds), (VALUES {_points(boosting.BOOSTED_GRID["subsamplingRate"])}) e(share)""")
def boosted_grid(spark, d):
    """All 54 points; each is better than naming the most frequent label."""
    train, _ = _split(spark, d)
    found = boosting.boosted_search(train, MODEL_FEATURES)
    share = train.groupBy("label").count().agg((F.max("count") / F.sum("count")).alias("p"))
    return found.join(F.broadcast(share), F.lit(True)).select(       # one row
        F.col("maxDepth").alias("max_depth"), F.col("stepSize").alias("step"),
        F.col("maxIter").alias("rounds"), F.col("subsamplingRate").alias("share"),
        F.col("n").alias("n_scored"),
        (F.col("f1") > 2 * F.col("p") * F.col("p") / (1 + F.col("p"))).cast("int").alias("beats_majority"))


@query("c9_boosted_trees", f"{TEST_SQL} SELECT doc_id, label, 1e0 AS p_sum, 1 AS rule_holds, 1 AS margin_is_largest, 1 AS beats_majority FROM test")
def boosted(spark, d):
    train, test = _split(spark, d)
    model = training.fit_boosted(train, MODEL_FEATURES)
    predicted = model.transform(test)
    done = training.class_probabilities(predicted).withColumn(
        "v", verdict.verdict(F.col("p0"), F.col("p1"), F.col("p2")).classification)
    holds = ((F.col("v") == "Authentic") == (F.col("p0") >= 0.8)) & (
        (F.col("v") == "Potentially Fake") == (F.col("p0") < 0.5))
    largest = F.get(F.array("p0", "p1", "p2"), F.col("prediction").cast("int")) == F.greatest("p0", "p1", "p2")
    return done.select("doc_id", "label", F.round(F.col("p0") + F.col("p1") + F.col("p2"), 9).alias("p_sum"),
                       holds.cast("int").alias("rule_holds"), largest.cast("int").alias("margin_is_largest"),
                       F.lit(beats_majority(_held_out(predicted), test, HELD_OUT)).alias("beats_majority"))


@query("c10_model_card", f"""{TEST_SQL} SELECT 'importance' AS section, {len(MODEL_FEATURES)} AS n, 1e0 AS total, 0e0 AS residual UNION ALL
SELECT 'param' AS section, 2 AS n, 25e0 AS total, 0e0 AS residual UNION ALL
SELECT 'score' AS section, 1 AS n, CAST((SELECT count(*) FROM test) AS DOUBLE) AS total, 0e0 AS residual""")
def card(spark, d):
    """The card's importances are compared with those recomputed from the splits' gains."""
    train, test = _split(spark, d)
    params = {"maxDepth": 5, "numTrees": 20}
    model = training.fit_forest(train, MODEL_FEATURES, **params)
    scores = profiling.scores(model.transform(test), "label", "prediction")
    card = training.model_card(model, MODEL_FEATURES, scores, params)
    again = trees.split_importances(trees.node_table(model.stages[-1]), MODEL_FEATURES).select(
        F.lit("importance").alias("section"), F.col("feature").alias("name"), "importance")
    value = F.col("value").cast("double")
    rows = card.filter("section <> 'score' or name = 'n'").join(again, ["section", "name"], "left")
    return rows.groupBy("section").agg(
        F.count("*").alias("n"), F.round(F.sum(value), 3).alias("total"),
        F.round(F.max(F.abs(value - F.coalesce("importance", value))), 5).alias("residual"))

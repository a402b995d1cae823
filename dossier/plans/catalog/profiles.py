"""Distributions, statistics, correlations and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.operators import features, profiling, ranking
from dossier.plans import inputs as I
from dossier.plans.catalog import duck as D
from dossier.plans.catalog import query


def _counts(name, table, col):
    @query(name, f"SELECT {col} AS value, count(*) AS n, round(count(*) * 1e2 / sum(count(*)) OVER (), 6) AS percent FROM {table} "
           f"WHERE {col} IS NOT NULL GROUP BY {col}")
    def run(spark, d):
        return profiling.value_counts(I.table(spark, d, table), col).withColumn("percent", F.round("percent", 6))


_counts("a1_value_counts", "customer", "c_mktsegment")
_counts("a1_value_counts_source", "documents", "source")


@query("a1_rollup", "SELECT lang, source, count(*) AS n FROM documents GROUP BY ROLLUP (lang, source)")
def rollup(spark, d):
    return profiling.value_counts_rollup(I.table(spark, d, "documents"), ["lang", "source"])


_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _union(select):
    return " UNION ALL ".join(select(c) for c in _NUMERIC)


@query("a2_feature_stats", _union(lambda c: f"""SELECT '{c}' AS feature, count({c}) AS n, {D.round_exact(f'avg({c})', 4)} AS mean,
 {D.round_exact(f'stddev_samp({c})', 4)} AS std, {D.round_exact(f'min({c})', 4)} AS min, {D.round_exact(f'max({c})', 4)} AS max FROM lineitem"""))
def stats(spark, d):
    return profiling.feature_stats(I.table(spark, d, "lineitem"), [*_NUMERIC, "not_there"])


@query("a3_describe", _union(lambda c: f"""SELECT '{c}' AS feature, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
 min({c}) AS min, max({c}) AS max, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75 FROM lineitem"""))
def describe(spark, d):
    out = profiling.describe(I.table(spark, d, "lineitem").select(*_NUMERIC), _NUMERIC)
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "q25", "q50", "q75")})


_GAPPY = "CASE WHEN event_type <> 'error' THEN value END"


@query("a4_null_counts", f"""SELECT 'value' AS feature, count(CASE WHEN {_GAPPY} IS NULL THEN 1 END) AS nulls FROM events
UNION ALL SELECT 'props' AS feature, count(CASE WHEN props IS NULL THEN 1 END) AS nulls FROM events""")
def nulls(spark, d):
    t = I.table(spark, d, "events").select(F.expr(_GAPPY).alias("value"), "props")
    return profiling.null_counts(t, ["value", "props"])


@query("a5_impute_median", f"""WITH e AS (SELECT event_id, {_GAPPY} AS value FROM events)
SELECT event_id, coalesce(value, (SELECT quantile_cont(value, 0.5) FROM e)) AS value FROM e""")
def impute(spark, d):
    t = I.table(spark, d, "events").select("event_id", F.expr(_GAPPY).alias("value"))
    return profiling.impute_median(t, ["value"])


@query("a6_class_means", "SELECT l_returnflag, " + ", ".join(
    f"{D.round_exact(f'avg({c})', 4)} AS {c}" for c in _NUMERIC) + " FROM lineitem GROUP BY l_returnflag")
def class_means(spark, d):
    return profiling.class_means(I.table(spark, d, "lineitem"), "l_returnflag", _NUMERIC)


_CORR = [*_NUMERIC, "risk"]
_RISK = "CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END"


@query("a7_correlation", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0e0 AS r FROM (SELECT *, {_RISK} AS risk FROM lineitem)"
    for i, a in enumerate(_CORR) for b in _CORR[i + 1:]))
def correlation(spark, d):
    t = I.table(spark, d, "lineitem").select(*_NUMERIC, F.expr(_RISK).alias("risk"))
    return profiling.corr_matrix(t, _CORR).withColumn("r", F.round("r", 6) + F.lit(0.0))


# predictions: the class of an order by price against the class by its status
_Y = "CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END"
_YHAT = "CASE WHEN o_totalprice < 150000 THEN 0 WHEN o_totalprice < 330000 THEN 1 ELSE 2 END"
_PRED = f"WITH p AS (SELECT {_Y} AS y, {_YHAT} AS yhat FROM orders)"


def predictions(spark, d):
    return I.table(spark, d, "orders").select(F.expr(_Y).alias("y"), F.expr(_YHAT).alias("yhat"))


@query("a8_confusion", f"{_PRED} SELECT y, yhat, count(*) AS n FROM p GROUP BY y, yhat")
def confusion(spark, d):
    return profiling.confusion(predictions(spark, d), "y", "yhat")


@query("a8_confusion_matrix", f"""{_PRED} SELECT y, count(CASE WHEN yhat = 0 THEN 1 END) AS pred_0, count(CASE WHEN yhat = 1 THEN 1 END) AS pred_1,
 count(CASE WHEN yhat = 2 THEN 1 END) AS pred_2 FROM p GROUP BY y""")
def matrix(spark, d):
    return profiling.confusion_matrix(predictions(spark, d), "y", "yhat", [0, 1, 2])


REPORT_SQL = f"""{_PRED}, l AS (SELECT unnest([0, 1, 2]) AS label),
c AS (SELECT label, count_if(y = label AND yhat = label) AS tp, count_if(y = label) AS support, count_if(yhat = label) AS predicted FROM p, l GROUP BY label),
m AS (SELECT *, {D.share('tp', 'predicted')} AS p1, {D.share('tp', 'support')} AS r1 FROM c),
f AS (SELECT label, tp, support, p1 AS precision, r1 AS recall, {D.share('2e0 * p1 * r1', '(p1 + r1)')} AS f1 FROM m)"""


@query("a9_classification_report", f"""{REPORT_SQL}, u AS (SELECT CAST(label AS VARCHAR) AS section, precision, recall, f1, support FROM f
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM f
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM f)
SELECT section, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM u""")
def report(spark, d):
    out = profiling.classification_report(predictions(spark, d), "y", "yhat")
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("a10_scores", f"{REPORT_SQL} SELECT round(sum(tp) / CAST(sum(support) AS DOUBLE), 6) AS accuracy, "
       "round(sum(f1 * support) / sum(support), 6) AS f1_weighted, CAST(sum(support) AS BIGINT) AS n FROM f")
def scores(spark, d):
    out = profiling.scores(predictions(spark, d), "y", "yhat")
    return out.withColumns({c: F.round(c, 6) for c in ("accuracy", "f1_weighted")})


@query("a11_class_histogram", """WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
SELECT l_returnflag AS label, least(CAST(floor((l_extendedprice - lo) / ((hi - lo) / 2e1)) AS INT), 19) AS bucket, count(*) AS n FROM lineitem, b GROUP BY ALL""")
def histogram(spark, d):
    return profiling.class_histogram(I.table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice")


@query("a14_encode", """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE 0 END AS target,
 CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 WHEN 'FURNITURE' THEN 3 ELSE 0 END AS education_level_encoded,
 CAST(c_acctbal > 5000 AS INT) AS has_previous_job FROM customer""")
def encode(spark, d):
    t = I.table(spark, d, "customer").select(
        "c_custkey", F.expr("case when c_acctbal < 0 then 'unknown' else 'Authentic' end").alias("classification"),
        F.expr("case c_mktsegment when 'BUILDING' then \"Bachelor's\" when 'MACHINERY' then \"Master's\" "
               "when 'FURNITURE' then 'PhD' end").alias("education_level"),
        F.expr("case when c_acctbal > 5000 then 'clerk' end").alias("previous_job_title"))
    return features.encode(t).select("c_custkey", "target", "education_level_encoded", "has_previous_job")


@query("o4_rank_importance", """WITH c AS (SELECT 'l_quantity' AS feature, abs(corr(l_quantity, l_extendedprice)) AS importance FROM lineitem
UNION ALL SELECT 'l_discount', abs(corr(l_discount, l_extendedprice)) FROM lineitem UNION ALL SELECT 'l_tax', abs(corr(l_tax, l_extendedprice)) FROM lineitem)
SELECT feature, round(importance, 6) AS importance FROM c""")
def importance(spark, d):
    t = I.table(spark, d, "lineitem")
    names = ["l_quantity", "l_discount", "l_tax"]
    long = t.agg(*[F.abs(F.corr(n, "l_extendedprice")).alias(n) for n in names]).select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("feature"), F.round(n, 6).alias("importance")) for n in names])))
    return ranking.rank_importance(long)

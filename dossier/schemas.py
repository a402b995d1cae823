"""Schemas of inputs and stored tables."""

from pyspark.sql import types as T

from dossier import lexicon as L

ANALYSES = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("job_id", T.LongType()),
    T.StructField("filename", T.StringType()), T.StructField("candidate_name", T.StringType()),
    T.StructField("username", T.StringType()),
    T.StructField("final_match_score", T.DoubleType()),
    T.StructField("ai_plausibility_score", T.DoubleType()),
    T.StructField("classification", T.StringType()),
    T.StructField("full_results", T.StringType()),
    T.StructField("created_at", T.TimestampType())])

JOBS = T.StructType([
    T.StructField("job_id", T.LongType()), T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("created_at", T.TimestampType())])

ITEM_EVENTS = T.StructType([
    T.StructField("job_id", T.StringType()), T.StructField("item", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("ts", T.TimestampType())])

REVIEWS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("job_id", T.LongType()),
    T.StructField("consensus", T.StringType()), T.StructField("reasoning", T.StringType()),
    T.StructField("score", T.DoubleType()), T.StructField("priority", T.IntegerType())])

_TRAINING_TEXT = ["classification", "risk_level", "certifications", "skills",
                  "education_level", "previous_job_title"]

TRAINING = T.StructType(
    [T.StructField(c, T.StringType()) for c in _TRAINING_TEXT]
    + [T.StructField(c, T.DoubleType()) for c in L.FEATURES])

METRICS = T.StructType([
    T.StructField("dataset_shape", T.ArrayType(T.LongType())),
    T.StructField("class_distribution", T.MapType(T.StringType(), T.LongType())),
    T.StructField("feature_cols", T.ArrayType(T.StringType())),
    T.StructField("best_params", T.MapType(T.StringType(), T.StringType())),
    T.StructField("test_accuracy", T.DoubleType()),
    T.StructField("test_f1_weighted", T.DoubleType()),
    T.StructField("feature_importance", T.ArrayType(T.StructType([
        T.StructField("feature", T.StringType()),
        T.StructField("importance", T.DoubleType())]))),
    T.StructField("classification_report", T.StringType())])
